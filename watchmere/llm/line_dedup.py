"""Line dedup: of every run of lines that repeats in the whole corpus, only the first copy stays.

Texts are cut into content-defined chunks: a rolling hash over the hashes of two lines in a row decides where a chunk
ends, so an inserted line moves no boundary but its own, and a line of LONG_LINE words or more is a chunk by itself.
Chunks of several lines and LEAST_WORDS or more, and long lines, are removed where they are repeated; single short
lines stay, however common they are. First is the smallest document id, then the place in the document.

Chunks are anchors only: the lines around a repeated one, and parts of two neighbours, are repeated as well. A run is
repeated where its bytes occur in an earlier document, or end before it in its own; every line inside a repeated run of
LONG_LINE words or more is removed. It is enough to look for the least runs: for each last line the shortest one that
has the words, and for each first line likewise. Any longer run is a union of those, and equal runs have equal least
runs. That makes at most two rows a line, whatever the lines' length and whatever stands around them. Chunks and least
runs that follow on each other in a document and in the first copy are joined to stretches, line by line both ways.

Chunks and runs are looked up by 128-bit BLAKE2b digests of their lines' digests; then the bytes of each stretch are
fetched from the first copy and compared with those that stand in its place, and only equal lines are removed.

Null texts have no lines and stay null. Rows that agree in id and text count as one document and are cut alike. A
null id comes before all others. Empty tables give empty results. Other columns are carried along as they are.

Runs are counted with map-side aggregation, so a run that a third of all documents share is one row per task. A
document's stretches are chosen so that no line lies in more than two, and are joined to it by (id, hash of the text),
which gathers no more than twice what that document has. Texts are shuffled once, for the first copies and the cuts.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from watchmere.llm.common import explode_rows, small_batches, table
from watchmere.session import cut_lineage

LONG_LINE = 50
LEAST_LINES = 2
LEAST_WORDS = 20
MEAN_LINES = 3
MIX = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
DIGEST = 16  # bytes
BODIES_AT_ONCE = 4 << 20  # bytes of a batch on its way from Python
RUNS = "start int, past int, run binary"


def chunks_of(lines: list[bytes]) -> list[tuple[int, int]]:
    """Chunks as (first line, line after the last)."""
    out = []
    start, before = 0, 0
    for i, line in enumerate(lines):
        if len(line) > 2 * LONG_LINE and len(line.split()) >= LONG_LINE:
            if start < i:
                out.append((start, i))
            out.append((i, i + 1))
            start, before = i + 1, 0
            continue
        here = xxhash.xxh3_64_intdigest(line)
        rolled = ((before * MIX) & MASK) ^ here
        before = here
        if ((rolled * MIX) & MASK) >> 40 < (1 << 24) // MEAN_LINES:
            out.append((start, i + 1))
            start = i + 1
    if start < len(lines):
        out.append((start, len(lines)))
    return out


def counted_chunks(lines: list[bytes], words: list[int]) -> list[tuple[int, int]]:
    """The chunks that are removed where they are repeated, of any length."""
    out = []
    for start, past in chunks_of(lines):
        n = sum(words[start:past])
        if n >= LONG_LINE or past - start >= LEAST_LINES and n >= LEAST_WORDS:
            out.append((start, past))
    return out


def _least_runs(words: list[int], digests: bytes, person: bytes, size: int) -> Iterator[tuple[int, int, bytes]]:
    """For each last line the shortest run of LONG_LINE words, as (first line, line after the last, digest)."""
    start, held, hashed = 0, 0, None
    for i, n in enumerate(words):
        held += n
        moved = hashed is None
        while held - words[start] >= LONG_LINE:
            held -= words[start]
            start += 1
            moved = True
        if held < LONG_LINE:
            continue
        if moved:
            hashed = blake2b(digests[start * size : (i + 1) * size], digest_size=size, person=person)
        else:  # Only lines without words, so that many of them are not read again and again.
            hashed.update(digests[i * size : (i + 1) * size])
        yield start, i + 1, hashed.digest()


def counted_runs(text: bytes, size: int = DIGEST) -> list[tuple[int, int, bytes]]:
    """(first line, line after the last, digest) of all that is removed where it is repeated."""
    lines = text.split(b"\n")
    words = [len(line.split()) for line in lines]
    each = [blake2b(line, digest_size=size).digest() for line in lines]
    digests = b"".join(each)
    found, known = [], set()
    if sum(words) >= LONG_LINE:
        found = [*_least_runs(words, digests, b"last", size)]
        known = {(start, past) for start, past, _ in found}
        # From the other end. A run that is least from both ends is so wherever it occurs, and counts once.
        n = len(lines)
        for start, past, run in _least_runs(words[::-1], b"".join(each[::-1]), b"first", size):
            if (n - past, n - start) not in known:
                found.append((n - past, n - start, run))
                known.add((n - past, n - start))
    out = []
    for start, past in counted_chunks(lines, words):
        if (start, past) not in known:
            run = digests[start * size : past * size]
            out.append((start, past, blake2b(run, digest_size=size, person=b"chunk").digest()))
    return out + found


def repeated_runs(documents: DataFrame, id_col: str, text_col: str, size: int = DIGEST) -> DataFrame:
    """One row for each place whose digest is a first one's that it does not touch: (__id, __print, start, past, first)."""
    rows = documents.select(
        F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__print"), F.col(text_col).alias("__body")
    )

    def open_scanner():
        def scan(text: bytes):
            found = counted_runs(text, size)
            return [r[0] for r in found], [r[1] for r in found], [r[2] for r in found]

        return scan

    runs = explode_rows(rows, ["__id", "__print"], "__body", RUNS, open_scanner)
    firsts = (
        runs.groupBy("run")
        .agg(F.count("*").alias("n"), F.min(F.struct("__id", "__print", "start", "past")).alias("first"))
        .filter("n > 1")
        .select("run", "first")
    )
    same = F.col("__id").eqNullSafe(F.col("first.__id")) & (F.col("__print") == F.col("first.__print"))
    later = runs.join(firsts, "run").filter(~same | (F.col("start") >= F.col("first.past")))
    return later.select("__id", "__print", "start", "past", "first")


def _stretches(places: list[dict]) -> list[tuple[int, int, tuple]]:
    """(start, past, (id and print of the first copy, lines between the two)): places joined, and as few as cover them."""
    joined: dict[tuple, list[list[int]]] = {}
    for p in sorted(places, key=lambda p: p["start"]):
        first = p["first"]
        spans = joined.setdefault((first["__id"], first["__print"], p["start"] - first["start"]), [])
        if spans and p["start"] <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], p["past"])
        else:
            spans.append([p["start"], p["past"]])
    spans = sorted(((a, b, key) for key, of_key in joined.items() for a, b in of_key), key=lambda x: x[:2])
    out, i, reach = [], 0, 0
    while i < len(spans):
        reach = max(reach, spans[i][0])
        best = spans[i]
        while i < len(spans) and spans[i][0] <= reach:
            best = max(best, spans[i], key=lambda x: x[1])
            i += 1
        if best[1] > reach:
            out.append(best)
            reach = best[1]
    return out


def stretches(places: DataFrame) -> DataFrame:
    """Rows (__id, __print, start, past, __first, __first_print, from, to) of all places of each document."""
    gathered = places.groupBy("__id", "__print").agg(F.collect_set(F.struct("start", "past", "first")).alias("__places"))
    keys = [gathered.schema["__id"], gathered.schema["__print"]]
    numbers = [StructField(name, IntegerType()) for name in ("start", "past")]
    firsts = [StructField("__first", keys[0].dataType), StructField("__first_print", LongType())]
    schema = StructType([*keys, *numbers, *firsts, StructField("from", IntegerType()), StructField("to", IntegerType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, places in enumerate(batch.column(2)):
                for start, past, (first, print_, off) in _stretches(places.as_py()):
                    at.append(i)
                    rows.append((start, past, first, print_, start - off, past - off))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            index = pa.array(at, pa.int32())
            arrays = [batch.column(i).take(index).cast(arrow.field(i).type) for i in range(2)]
            arrays += [pa.array(c, arrow.field(i).type) for i, c in enumerate(columns, 2)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return gathered.mapInArrow(run, schema)


def first_bodies(keyed: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (__first, __first_print, from, to, body): the bytes of the first copies."""
    ranges = wanted.groupBy("__first", "__first_print").agg(F.collect_set(F.struct("from", "to")).alias("__ranges"))
    met = F.col(id_col).eqNullSafe(F.col("__first")) & (F.col("__text_print") == F.col("__first_print"))
    # All columns go along, so that the shuffle of the texts is the same one as for the cuts.
    joined = keyed.join(ranges, met).select(*[F.col(f"`{c}`") for c in keyed.columns], "__ranges")
    schema = StructType(
        [wanted.schema[name] for name in ("__first", "__first_print", "from", "to")] + [StructField("body", BinaryType())]
    )
    arrow = to_arrow_schema(schema)
    at, of_id, of_print = (keyed.columns.index(c) for c in (text_col, id_col, "__text_print"))
    n = len(keyed.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            ids, prints = batch.column(of_id), batch.column(of_print)
            for i, (text, wanted_) in enumerate(zip(batch.column(at).cast(pa.binary()), batch.column(n), strict=True)):
                lines = (text.as_py() or b"").split(b"\n")
                for r in wanted_.as_py():
                    body = b"\n".join(lines[r["from"] : r["to"]])
                    rows.append((ids[i].as_py(), prints[i].as_py(), r["from"], r["to"], body))
                    held += len(body)
                    if held >= BODIES_AT_ONCE:
                        yield _batch(rows, arrow)
                        rows, held = [], 0
            if rows:
                yield _batch(rows, arrow)

    return small_batches(joined).mapInArrow(run, schema)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    arrays = [pa.array(c, arrow.field(i).type) for i, c in enumerate(zip(*rows, strict=True))]
    return pa.RecordBatch.from_arrays(arrays, schema=arrow)


def remove_repeats(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = DIGEST
) -> DataFrame:
    """All rows and columns with the cleaned text, and then __lines and __lines_cut; `size` is that of digests."""
    found = cut_lineage(stretches(repeated_runs(documents, id_col, text_col, size)))
    keyed = documents.withColumn("__text_print", F.xxhash64(text_col))
    bodies = first_bodies(keyed, found, id_col, text_col).select(
        F.col("__first").alias("__of"), F.col("__first_print").alias("__of_print"), F.col("from").alias("__a"), F.col("to").alias("__b"), "body"
    )
    met = (
        F.col("__first").eqNullSafe(F.col("__of"))
        & (F.col("__first_print") == F.col("__of_print"))
        & (F.col("from") == F.col("__a"))
        & (F.col("to") == F.col("__b"))
    )
    cuts = (
        found.join(bodies, met)
        .groupBy("__id", "__print")
        .agg(F.collect_set(F.struct("start", "past", "body")).alias("__cuts"))
    )
    joined = keyed.join(
        cuts, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text_print") == F.col("__print")), "left"
    ).select(*[F.col(f"`{c}`") for c in keyed.columns], "__cuts")
    schema = StructType(
        documents.schema.fields + [StructField("__lines", LongType()), StructField("__lines_cut", LongType())]
    )
    arrow = to_arrow_schema(schema)
    at, n = documents.columns.index(text_col), len(documents.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, cut_counts = [], [], []
            for text, cut in zip(batch.column(at).cast(pa.binary()), batch.column(n + 1), strict=True):
                text, lines, gone = _cut(text.as_py(), cut.as_py())
                texts.append(text)
                counts.append(lines)
                cut_counts.append(gone)
            arrays = [batch.column(i) for i in range(n)]
            arrays[at] = pa.array(texts, pa.binary()).cast(pa.string())
            arrays = [a.cast(arrow.field(i).type) for i, a in enumerate(arrays)]
            arrays += [pa.array(counts, pa.int64()), pa.array(cut_counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return small_batches(joined).mapInArrow(run, schema)


def _equal_lines(lines: list[bytes], start: int, past: int, body: bytes) -> list[tuple[int, int]]:
    """Where a stretch has the bytes of the first copy: all of it, or else its runs of equal lines with enough words."""
    if b"\n".join(lines[start:past]) == body:
        return [(start, past)]
    out, begun, words = [], start, 0
    for i, theirs in enumerate([*body.split(b"\n"), None], start):
        if i < past and lines[i] == theirs:
            words += len(theirs.split())
            continue
        if words >= LONG_LINE:
            out.append((begun, i))
        begun, words = i + 1, 0
    return out


def _cut(text: bytes | None, cuts: list[dict] | None) -> tuple[bytes | None, int, int]:
    """The text without the lines of the cuts whose bytes are those of the first copy; its lines, and how many went."""
    if text is None:
        return None, 0, 0
    lines = text.split(b"\n")
    if not cuts:
        return text, len(lines), 0
    kept, at = [], 0
    for start, past in sorted(span for c in cuts for span in _equal_lines(lines, c["start"], c["past"], c["body"])):
        kept += lines[at:start]
        at = max(at, past)
    kept += lines[at:]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def op7_line_dedup(spark: SparkSession, root: str) -> DataFrame:
    cleaned = remove_repeats(table(spark, root, "documents").select("doc_id", "text"))
    return cleaned.select(
        "doc_id",
        F.col("__lines").alias("n_lines"),
        F.col("__lines_cut").alias("n_lines_removed"),
        F.sha2("text", 256).alias("text_sha256"),
        "text",
    )
