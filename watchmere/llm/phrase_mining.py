"""Collocations: phrases of two to four words that their parts predict, mined from sorted suffixes.

A suffix pointer is a place of a word in a piece of text; it leads to the words from there to the end of the piece, four
at most. Leading pairs of words are counted first, over all texts, and a suffix is cut in front of the first pair that
is too rare, as no frequent phrase goes across it. Equal suffixes of a block are one pointer with a weight. The
pointers are then routed over the cluster by their first three words and sorted there by a multikey three-way quicksort:
each round parts every open stretch by its middle pointer's word at the stretch's depth into less, equal and greater.
The weight of an equal part is the count of its phrase, and the part goes on one word deeper; parts with too little
weight are abandoned, from the third word on, where all pointers of a phrase are in one place.

Which pairs are frequent is told by a bitmap of BITS bits, 8 MB whatever the data: pairs that share a bit with a
frequent one only make suffixes longer than they need be. Blocks hold BLOCK_WORDS words, or one text; a task sorts
CHUNK_ROWS pointers at a time, cut where the route changes. A route that is longer than a chunk is not abandoned in
parts; what is counted in parts is added up by the last aggregation, so no key needs to fit into one task.

A null text has no words, a null language is `und`. Repeated rows count as often as they are there, an empty table
gives an empty result, and only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from watchmere.llm.common import schema_of, small_batches, table, texts_of
from watchmere.session import scratch_path

LEAST_COUNT = 30
MOST_WORDS = 4
TOP = 2000
COVERED = (100, 80)  # a phrase goes if 100 times a longer one's count is at least 80 times its own
BITS = 1 << 26
BLOCK_WORDS = 2_500_000
CHUNK_ROWS = 400_000
SALTS = 16
END = b"\xff"  # in no UTF-8 text
# Letters A-Z become lower case; marks and line ends close a piece. White space separates words.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else 0xFF if c in b".,;:!?" or 10 <= c <= 13 else c for c in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Numbers of the words of one language, dealt from a list that all languages share."""

    def __init__(self, lang: str, shared: list):
        super().__init__({END: 0})
        self.lang = lang
        self.shared = shared

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.shared)
        self.shared.append((self.lang, word))
        return number


class Block:
    """Words of many texts as numbers; 0 stands between pieces."""

    def __init__(self) -> None:
        self.words: list[tuple[str, bytes]] = [("", END)]
        self.known: dict[str, Words] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str | None, text: bytes) -> None:
        lang = "und" if lang is None else lang
        known = self.known.get(lang)
        if known is None:
            known = self.known[lang] = Words(lang, self.words)
        tokens = text.translate(FOLDED).replace(END, b" \xff ").split()
        tokens.append(END)
        self.parts.append(np.array([known[t] for t in tokens], np.int32))
        self.size += len(tokens)

    def numbers(self) -> np.ndarray:
        """All numbers, and as many zeros behind them as a suffix may look ahead."""
        return np.concatenate([*self.parts, np.zeros(MOST_WORDS, np.int32)])

    def hashes(self) -> np.ndarray:
        seeds = {lang: xxhash.xxh3_64_intdigest(lang.encode()) for lang in self.known}
        made = [xxhash.xxh3_64_intdigest(word, seeds.get(lang, 0)) for lang, word in self.words]
        return np.array(made, np.uint64)


def _joined(*hashes: np.ndarray) -> np.ndarray:
    """A hash of a sequence of hashes."""
    out = hashes[0]
    for h in hashes[1:]:
        out = (out ^ (out >> np.uint64(29))) * MIX + h
    out = out * MIX
    return out ^ (out >> np.uint64(32))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    block = Block()
    for batch in batches:
        for lang, text in zip(batch.column(0), texts_of(batch.column(1), True), strict=True):
            block.add(lang.as_py(), text)
            if block.size >= BLOCK_WORDS:
                yield block
                block = Block()
    if block.size:
        yield block


def _sliced(columns: list, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
    for start in range(0, made.num_rows, 50_000):
        yield made.slice(start, 50_000)


def frequent_pairs(texts: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """Hashes of (language, word, next word) that occur `least` times or more in all texts."""
    schema = to_arrow_schema(schema_of("pair long, n long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            numbers = block.numbers()
            at = np.flatnonzero((numbers[:-1] > 0) & (numbers[1:] > 0))
            of = block.hashes()
            pairs = _joined(of[numbers[at]], of[numbers[at + 1]])
            found, count = np.unique(pairs, return_counts=True)
            yield from _sliced([found.view(np.int64), count], schema)

    counted = small_batches(texts).mapInArrow(run, schema_of("pair long, n long"))
    return counted.groupBy("pair").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("pair")


def _bitmap(pairs: DataFrame) -> np.ndarray:
    """BITS bits, as 64-bit cells, in which those of the pairs are set: at most BITS / 64 rows come to the driver."""
    bit = F.col("pair").bitwiseAND(BITS - 1)
    cells = pairs.groupBy(F.shiftright(bit, 6).alias("cell")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))).alias("bits")
    )
    rows = cells.toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[rows.column("cell").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def _suffixes(block: Block, bitmap: np.ndarray) -> tuple[list, list, list, list]:
    """(route, language, words, weight) of the different suffixes, cut where a pair is rare; and all words per language."""
    numbers = block.numbers()
    of = block.hashes()
    at = np.flatnonzero((numbers[:-1] > 0) & (numbers[1:] > 0))
    bit = _joined(of[numbers[at]], of[numbers[at + 1]]) & np.uint64(BITS - 1)
    goes_on = np.zeros(len(numbers), bool)
    goes_on[at] = (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
    n = len(numbers) - MOST_WORDS
    depth = (numbers[:n] > 0).astype(np.int32)
    for d in range(1, MOST_WORDS):
        depth += (depth == d) & goes_on[d - 1 : n + d - 1]
    words = block.words
    routes, langs, texts, weights = [], [], [], []
    group = numbers[:n].astype(np.int64)
    places = np.flatnonzero(depth)
    for d in range(1, MOST_WORDS + 1):
        # Here `group` tells apart what the first d words of a place are.
        here = places[depth[places] == d]
        found, first, count = np.unique(group[here], return_index=True, return_counts=True)
        first = here[first]
        columns = [numbers[first + i] for i in range(d)]
        routes.append(_joined(*[of[c] for c in columns[:3]]).view(np.int64))
        weights.append(count)
        langs += [words[i][0] for i in columns[0].tolist()]
        texts += [b" ".join([words[i][1] for i in row]) for row in zip(*[c.tolist() for c in columns], strict=True)]
        places = places[depth[places] > d]
        if d < MOST_WORDS:
            _, group[places] = np.unique((group[places] << 32) | numbers[places + d], return_inverse=True)
    # The empty phrase counts all words of a language.
    used = np.bincount(numbers, minlength=len(words))
    totals: dict[str, int] = dict.fromkeys(block.known, 0)
    for (lang, _), count in zip(words[1:], used[1:].tolist(), strict=True):
        totals[lang] += count
    for lang, count in totals.items():
        langs.append(lang)
        texts.append(b"")
    routes.append(np.zeros(len(totals), np.int64))
    weights.append(np.array(list(totals.values()), np.int64))
    return [np.concatenate(routes), langs, texts, np.concatenate(weights)]


def three_way(keys: np.ndarray, weight: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Multikey quicksort of suffixes, rows of word numbers with 0 behind the last.

    Yields (depth, a row of each equal part, weight of the part). From the third word on, parts under `least` are
    abandoned; the stretches of all parts are split in the same pass over the rows.
    """
    most = keys.shape[1]
    rows = np.arange(len(keys))
    stretch = np.zeros(len(keys), np.int64)
    depth = np.zeros(1, np.int64)
    while len(rows):
        key = keys[rows, depth[stretch]]
        starts = np.flatnonzero(np.diff(stretch, prepend=-1))
        sizes = np.diff(np.append(starts, len(rows)))
        pivot = key[starts + sizes // 2][stretch]
        part = 3 * stretch + 1 + (key > pivot) - (key < pivot)
        order = np.argsort(part, kind="stable")
        rows, part = rows[order], part[order]
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        sizes = np.diff(np.append(starts, len(rows)))
        sums = np.add.reduceat(weight[rows], starts)
        at = depth[part[starts] // 3]
        equal = part[starts] % 3 == 1
        worth = (at < 2) | (sums >= least)
        present = keys[rows[starts], at] > 0
        for d in range(most):
            out = equal & present & worth & (at == d)
            if out.any():
                yield d + 1, rows[starts[out]], sums[out]
        stays = worth & np.where(equal, present & (at + 1 < most), True)
        rows = rows[np.repeat(stays, sizes)]
        depth = (at + equal)[stays]
        stretch = np.repeat(np.arange(int(stays.sum())), sizes[stays])


def _counted(chunk: pa.Table, least: int) -> tuple[list, list, list, list]:
    """(language, phrase, words, weight) of the phrases that the suffixes of a chunk begin with.

    Equal pointers of different blocks are one before they are sorted.
    """
    chunk = chunk.group_by(["lang", "words"], use_threads=False).aggregate([("n", "sum")])
    langs, texts = chunk.column("lang").to_pylist(), chunk.column("words").to_pylist()
    weight = chunk.column("n_sum").to_numpy().astype(np.int64)
    split = [t.split(" ") if t else [] for t in texts]
    known: dict[tuple[str, str], int] = {}
    keys = np.zeros((len(split), MOST_WORDS), np.int32)
    for i, (lang, words) in enumerate(zip(langs, split, strict=True)):
        for j, word in enumerate(words):
            keys[i, j] = known.setdefault((lang, word), len(known) + 1)
    out: tuple[list, list, list, list] = ([], [], [], [])
    for i in np.flatnonzero(keys[:, 0] == 0).tolist():
        for column, value in zip(out, (langs[i], "", 0, weight[i]), strict=True):
            column.append(value)
    some = np.flatnonzero(keys[:, 0] > 0)
    for d, rows, sums in three_way(keys[some], weight[some], least):
        rows = some[rows].tolist()
        out[0].extend([langs[i] for i in rows])
        out[1].extend([" ".join(split[i][:d]) for i in rows])
        out[2].extend([d] * len(rows))
        out[3].extend(sums.tolist())
    return out


COUNTED = "lang string, phrase string, words int, n long"


def _sort_pointers(
    batches: Iterator[pa.RecordBatch], schema: pa.Schema, least: int, rows: int
) -> Iterator[pa.RecordBatch]:
    """Counts of phrases from pointers in order of their route, a chunk at a time."""
    held: list[pa.RecordBatch] = []
    size, torn = 0, None

    def done(chunk: pa.Table, whole: bool) -> Iterator[pa.RecordBatch]:
        yield from _sliced(list(_counted(chunk, least if whole else 1)), schema)

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        chunk = pa.Table.from_batches(held)
        route = chunk.column("route").to_numpy()
        # The last route may go on in the next batch.
        cut = int(np.searchsorted(route, route[-1], "left"))
        whole = torn is None or torn != route[0]
        if cut == 0:
            torn, cut, whole = route[-1], len(route), False
        yield from done(chunk.slice(0, cut), whole)
        held = chunk.slice(cut).to_batches()
        size = len(route) - cut
    if size:
        chunk = pa.Table.from_batches(held)
        yield from done(chunk, torn is None or torn != chunk.column("route")[0].as_py())


def phrase_counts(texts: DataFrame, least: int = LEAST_COUNT, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(lang, phrase, words, n): phrases of up to four words with `least` occurrences; the empty one counts all words.

    `texts` has the columns lang and text.
    """
    spark = texts.sparkSession
    bitmap = spark.sparkContext.broadcast(_bitmap(frequent_pairs(texts, least)))
    found = "route long, lang string, words string, n long"
    schema = to_arrow_schema(schema_of(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            route, langs, words, weight = _suffixes(block, bitmap.value)
            words = pa.array(words, pa.binary()).cast(pa.string())
            yield from _sliced([route, langs, words, weight], schema)

    pointers = small_batches(texts).mapInArrow(run, schema_of(found))
    routed = pointers.repartition("route").sortWithinPartitions("route")
    made = to_arrow_schema(schema_of(COUNTED))
    counted = routed.mapInArrow(lambda batches: _sort_pointers(batches, made, least, chunk_rows), schema_of(COUNTED))
    return (
        counted.groupBy("lang", "phrase", "words")
        .agg(F.sum("n").alias("n"))
        .filter((F.col("n") >= least) | (F.col("words") == 0))
    )


def _exact(column: Column) -> Column:
    return column.cast("decimal(20,0)")


def collocations(
    documents: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST_COUNT, top: int = TOP,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The best `top` phrases of each language: (lang, rank, phrase, a, l, r, n, score).

    The score is floor(2,000,000 a / (l + r)) at the cut of a phrase where that is lowest, the earliest of such; a, l and
    r count the phrase, the part before the cut and the part behind it. Phrases that a longer one covers are left out.
    """
    texts = documents.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    path = scratch_path(documents.sparkSession, "phrases")
    phrase_counts(texts, least, chunk_rows).write.parquet(path)
    counts = documents.sparkSession.read.parquet(path)
    phrases = counts.filter("words > 1").withColumn("split", F.split("phrase", " "))

    # Words like articles stand in very many phrases: their counts are there SALTS times.
    salts = F.when(F.col("words") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    parts = counts.filter("words > 0").select("lang", F.col("phrase").alias("part"), "n", F.explode(salts).alias("salt"))
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    k = F.col("k")
    cuts = phrases.select("lang", "phrase", "words", "n", "split", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", F.col("n").alias("a"), "k",
        F.array_join(F.slice("split", F.lit(1), k), " ").alias("before"),
        F.array_join(F.slice("split", k + 1, F.col("words") - k), " ").alias("behind"),
        F.when(k == 1, salt).otherwise(0).alias("salt_before"),
        F.when(F.col("words") - k == 1, salt).otherwise(0).alias("salt_behind"),
    )
    left = parts.select("lang", F.col("part").alias("before"), F.col("salt").alias("salt_before"), F.col("n").alias("l"))
    right = parts.select("lang", F.col("part").alias("behind"), F.col("salt").alias("salt_behind"), F.col("n").alias("r"))
    rated = cuts.join(left, ["lang", "before", "salt_before"]).join(right, ["lang", "behind", "salt_behind"])
    rated = rated.withColumns(
        {"__scaled": _exact(F.lit(2_000_000)) * _exact(F.col("a")), "__parts": _exact(F.col("l")) + _exact(F.col("r"))}
    ).withColumn("score", F.expr("__scaled div __parts"))
    lowest = rated.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inside = phrases.filter("words > 2").select(
        "lang", F.col("n").alias("longer"), "split", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size")
    )
    inside = inside.select(
        "lang", "longer", "split", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("from")
    ).select("lang", F.array_join(F.slice("split", F.col("from"), F.col("size")), " ").alias("phrase"), "longer")
    longest = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    covered = _exact(F.lit(COVERED[0])) * _exact(F.col("longer")) >= _exact(F.lit(COVERED[1])) * _exact(F.col("a"))
    kept = lowest.join(longest, ["lang", "phrase"], "left").filter(~F.coalesce(covered, F.lit(False)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.select("lang", "phrase", "a", "cut.*").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    totals = counts.filter("words = 0").select("lang", F.col("n"))
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )


def op12_phrase_mining(spark: SparkSession, root: str) -> DataFrame:
    return collocations(table(spark, root, "documents"))


# The same from all phrases counted one by one.
ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM starts, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w)),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang),
phrases AS (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE k > 1),
cuts AS (SELECT lang, phrase, f, w, k, unnest(range(1, k)) AS c FROM phrases),
rated AS (
  SELECT cuts.lang, cuts.phrase, cuts.f AS a, x.f AS l, y.f AS r, (2000000::HUGEINT * cuts.f // (x.f + y.f))::BIGINT AS score, c
  FROM cuts JOIN counts x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:c], ' ')
  JOIN counts y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[c + 1:], ' ')
), lowest AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
kept AS (
  SELECT * FROM lowest s WHERE NOT EXISTS (SELECT 1 FROM phrases p WHERE p.lang = s.lang AND p.k > len(string_split(s.phrase, ' '))
    AND contains(' ' || p.phrase || ' ', ' ' || s.phrase || ' ') AND 100::HUGEINT * p.f >= 80::HUGEINT * s.a)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
