"""What the operators of this package share: row-wise scans of texts, words and row keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

# Letters A-Z become lower case; digits, letters and everything beyond ASCII stay; the rest separates words.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
OUTPUT_ROWS = 250
BATCH_ROWS = 1000  # of an Arrow batch on its way to Python
# What a worker remembers of words: one generation of so many, and the one before it.
MEMORY_WORDS = 60_000

_RESIDENT: dict = {}


def resident(key, make: Callable):
    """A large object that stays in the Python worker between tasks; only one does, so stages do not add up."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        if make is not None:
            _RESIDENT[key] = make()
    return _RESIDENT.get(key)


class Memory:
    """What was made of words, in two generations: those not asked for while one fills up are forgotten."""

    def __init__(self, size: int = MEMORY_WORDS):
        self.size = size
        self.young: dict = {}
        self.old: dict = {}

    def recall(self, key):
        """From the older generation, which then counts as young again; None where it is unknown."""
        found = self.old.get(key)
        if found is not None:
            self.young[key] = found
        return found

    def keep(self, key, value):
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value
        return value

    def forget(self) -> None:
        self.young, self.old = {}, {}


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words of a UTF-8 text; only A-Z are folded."""
    return text.translate(WORD_BYTES).split()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """Texts can be long, so that a session's usual 10,000 rows would make large batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(name)) not in range(1, BATCH_ROWS + 1):
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


def schema_of(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def texts_of(column: pa.Array, as_bytes: bool) -> Iterator:
    """The values of a text column one by one, null as empty; bytes are UTF-8."""
    column = pc.fill_null(column, "")
    if as_bytes:
        column = column.cast(pa.binary() if column.type == pa.string() else pa.large_binary())
    for value in column:
        yield value.as_py()


def scan_rows(
    df: DataFrame,
    columns: list[str],
    text_col: str,
    ddl: str,
    open_scanner: Callable[[], Callable],
    as_bytes: bool = True,
    beside: str | None = None,
) -> DataFrame:
    """One output row for each row of `df`: the named columns, then what the scanner makes of the text.

    `open_scanner` runs once in each task and returns a function from a text to a tuple of values in the order of
    `ddl`; if that has a `close`, it is called at the end, for workers live on after a task. Texts are looked at one at a time, so that memory is bounded by the longest of them; rows need nothing
    from each other, and a lost task is simply run again. The value of the column `beside`, if named, is a second argument.
    """
    kept = df.select(*[F.col(c) for c in columns], F.col(text_col).cast("string").alias("__text"))
    schema = StructType(kept.schema.fields[:-1] + schema_of(ddl).fields)
    if beside:
        kept = df.select(*kept.columns[:-1], F.col(text_col).cast("string").alias("__text"), F.col(beside).alias("__beside"))
    arrow = to_arrow_schema(schema)
    n = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = open_scanner()
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, OUTPUT_ROWS):
                    part = batch.slice(start, OUTPUT_ROWS)
                    texts = texts_of(part.column(n), as_bytes)
                    if beside:
                        rows = [scan(text, v.as_py()) for text, v in zip(texts, part.column(n + 1), strict=True)]
                    else:
                        rows = [scan(text) for text in texts]
                    made = zip(*rows, strict=True)
                    arrays = [part.column(i).cast(arrow.field(i).type) for i in range(n)]
                    arrays += [pa.array(list(v), arrow.field(n + i).type) for i, v in enumerate(made)]
                    yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        finally:
            getattr(scan, "close", int)()

    return small_batches(kept).mapInArrow(run, schema)


def explode_rows(
    df: DataFrame,
    columns: list[str],
    text_col: str,
    ddl: str,
    open_scanner: Callable[[], Callable],
    as_bytes: bool = True,
) -> DataFrame:
    """As `scan_rows`, but the scanner returns equally long columns (lists or arrays): many rows for one text."""
    kept = df.select(*[F.col(c) for c in columns], F.col(text_col).cast("string").alias("__text"))
    schema = StructType(kept.schema.fields[:-1] + schema_of(ddl).fields)
    arrow = to_arrow_schema(schema)
    n = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = open_scanner()
        for batch in batches:
            pieces: list[pa.RecordBatch] = []
            held = 0
            for i, text in enumerate(texts_of(batch.column(n), as_bytes)):
                made = scan(text)
                size = len(made[0])
                if not size:
                    continue
                index = pa.array([i] * size, pa.int32())
                arrays = [batch.column(c).take(index).cast(arrow.field(c).type) for c in range(n)]
                arrays += [pa.array(v, arrow.field(n + j).type) for j, v in enumerate(made)]
                pieces.append(pa.RecordBatch.from_arrays(arrays, schema=arrow))
                held += size
                if held >= 20000:
                    yield from pa.Table.from_batches(pieces, arrow).combine_chunks().to_batches()
                    pieces, held = [], 0
            if pieces:
                yield from pa.Table.from_batches(pieces, arrow).combine_chunks().to_batches()

    return small_batches(kept).mapInArrow(run, schema)


def keep_rows(df: DataFrame, text_col: str, open_test: Callable[[], Callable], beside: str | None = None) -> DataFrame:
    """The rows of `df`, all columns, whose text, with the value of the column `beside` if named, passes the test."""
    arrow = to_arrow_schema(df.schema)
    at = df.columns.index(text_col)
    besides = df.columns.index(beside) if beside else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = open_test()
        try:
            for batch in batches:
                given = [texts_of(batch.column(at), True)]
                if besides is not None:
                    given.append(v.as_py() for v in batch.column(besides))
                mask = pa.array([bool(test(*row)) for row in zip(*given, strict=True)], pa.bool_())
                yield batch.filter(mask).cast(arrow)
        finally:
            getattr(test, "close", int)()

    return small_batches(df).mapInArrow(run, df.schema)


def digest(hex_of: str):
    return F.sha2(F.encode(F.col(hex_of), "UTF-8"), 256)
