"""Benchmark decontamination: training words inside any word window of a benchmark are found and cut out.

An item's windows are its 13 consecutive words; an item of fewer words, but not none, is one window. The windows of
the whole benchmark form a hash set that is broadcast after its size was checked, and documents are scanned once, row
by row. A benchmark beyond the bound is joined with the document windows in a shuffle instead. Both ways compare the
words themselves, so no hash can give a false hit.

Nulls and texts without words have no windows and are never contaminated; repeated rows each get their own result;
an empty benchmark leaves everything clean. Only the id and text columns are read, other columns can have any name.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchmere.llm.common import explode_rows, keep_rows, scan_rows, table, words_of

WINDOW_WORDS = 13
# Largest benchmark, in bytes of text, whose windows are broadcast (each word starts a window of 13).
BROADCAST_BYTES = 16 << 20
FOUND = "n_words long, n_hit long, items array<string>"


class WindowSet:
    """The windows of a benchmark as tuples of word numbers, by length; each knows its items."""

    def __init__(self, items: list[tuple[str, bytes]], size: int = WINDOW_WORDS):
        self.numbers: dict[bytes, int] = {}
        self.windows: dict[int, dict[bytes, set[str]]] = defaultdict(dict)
        for item, text in items:
            numbers = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            length = min(size, len(numbers))
            if length:
                row = np.array(numbers, np.int32)
                for at in range(len(numbers) - length + 1):
                    self.windows[length].setdefault(row[at : at + length].tobytes(), set()).add(item)

    def find(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, hit places as (first word, words), and the items they belong to.

        Words that no item has are 0; only stretches free of zeros can hold a window, so the set is asked there alone.
        """
        known = self.numbers
        words = words_of(text)
        n = len(words)
        row = np.fromiter([known.get(w, 0) for w in words], np.int32, n)
        inside = np.concatenate(([0], np.cumsum(row != 0)))
        places: list[tuple[int, int]] = []
        items: set[str] = set()
        for length, held in self.windows.items():
            if n < length:
                continue
            for at in np.flatnonzero(inside[length:] - inside[:-length] == length).tolist():
                found = held.get(row[at : at + length].tobytes())
                if found:
                    places.append((at, length))
                    items |= found
        return n, places, items

    def measure(self, text: bytes) -> tuple[int, int, list[str]]:
        n, places, items = self.find(text)
        return n, covered_words(n, places), sorted(i for i in items if i is not None)


def covered_words(n: int, places: list[tuple[int, int]]) -> int:
    hit = np.zeros(n, np.bool_)
    for at, length in places:
        hit[at : at + length] = True
    return int(hit.sum())


def is_contaminated(n_words: Column, n_hit: Column) -> Column:
    """A twentieth of the words or more lie inside windows."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def window_set(benchmark: DataFrame, item_col: str, text_col: str, size: int, most_bytes: int) -> WindowSet | None:
    """The set, or None where the benchmark is larger than what may be broadcast."""
    texts = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    texts = texts.filter(F.col("text").isNotNull())
    if (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > most_bytes:
        return None
    return WindowSet([(row.item, row.text.encode()) for row in texts.toLocalIterator()], size)


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = WINDOW_WORDS,
    most_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """For each row of documents: its words, the words hit, the items with occurring windows, and the verdict."""
    windows = window_set(benchmark, item_col, item_text_col, size, most_bytes)
    if windows is None:
        found = _by_shuffle(documents, benchmark, id_col, text_col, item_col, item_text_col, size)
    else:
        shared = documents.sparkSession.sparkContext.broadcast(windows)
        found = scan_rows(documents, [id_col], text_col, FOUND, lambda: shared.value.measure)
    return found.withColumn("contaminated", is_contaminated(F.col("n_words"), F.col("n_hit")))


def _window_rows(size: int, lengths: list[int]):
    def open_scanner():
        def scan(text: bytes):
            words = words_of(text)
            at, kept, window = [], [], []
            for length in lengths:
                for i in range(len(words) - length + 1):
                    at.append(i)
                    kept.append(length)
                    window.append(b" ".join(words[i : i + length]).decode())
            return at, kept, window

        return scan

    return open_scanner


def _hits(rows, key, benchmark, item_col, item_text_col, size) -> DataFrame:
    """(key, at, length, item) of the windows of `rows` that an item has, by a join on the words themselves."""

    def item_scanner():
        def scan(text: bytes):
            words = words_of(text)
            length = min(size, len(words))
            windows = {b" ".join(words[i : i + length]).decode() for i in range(len(words) - length + 1)} if length else set()
            return [length] * len(windows), sorted(windows)

        return scan

    items = benchmark.select(
        F.col(item_col).cast("string").alias("__item"), F.col(item_text_col).alias("__item_text")
    )
    held = explode_rows(items, ["__item"], "__item_text", "length int, window string", item_scanner).distinct()
    lengths = [row[0] for row in held.select("length").distinct().collect()]  # at most `size` of them
    spots = explode_rows(rows, key, "__text", "at int, length int, window string", _window_rows(size, lengths))
    return spots.join(held, ["length", "window"])


def _by_shuffle(documents, benchmark, id_col, text_col, item_col, item_text_col, size) -> DataFrame:
    """Windows of both sides joined by their words; hits fold to one row per document afterwards."""
    rows = documents.select(
        F.col(id_col), F.col(text_col).cast("string").alias("__text"), F.xxhash64(text_col).alias("__print")
    )
    key = [id_col, "__print"]
    hits = _hits(rows, key, benchmark, item_col, item_text_col, size)
    hits = hits.withColumnsRenamed({id_col: "__id", "__print": "__p"})
    by_doc = hits.groupBy("__id", "__p").agg(
        F.array_sort(F.collect_set("__item")).alias("items"),
        F.size(
            F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("at"), F.col("at") + F.col("length") - 1))))
        )
        .cast("long")
        .alias("n_hit"),
    )
    counted = scan_rows(rows, key, "__text", "n_words long", lambda: lambda text: (len(words_of(text)),))
    joined = counted.join(by_doc, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__print") == F.col("__p")), "left")
    return joined.select(
        id_col,
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents, all columns, without the contaminated ones; others keep their whole text."""
    windows = window_set(benchmark, "item_id", "text", WINDOW_WORDS, BROADCAST_BYTES)
    if windows is None:
        # A row is known by all that decides about it; equal texts share their verdict.
        keyed = documents.withColumn("__key", F.xxhash64(text_col, F.octet_length(text_col)))
        found = contamination(keyed.select("__key", text_col), benchmark, "__key", text_col, most_bytes=-1)
        marked = found.filter("contaminated").select("__key").distinct()
        return keyed.join(marked, "__key", "left_anti").select(documents.columns)
    shared = documents.sparkSession.sparkContext.broadcast(windows)

    def open_test():
        def clean(text: bytes) -> bool:
            n, hit, _ = shared.value.measure(text)
            return not (hit and 20 * hit >= n)

        return clean

    return keep_rows(documents, text_col, open_test)


def cut_spans(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Documents' texts without the hit words: (id, text as lower-cased words joined by spaces, n_cut).

    Beyond the broadcast's bound the hits come from the shuffle join; equal texts are cut once and share the result.
    """
    windows = window_set(benchmark, "item_id", "text", WINDOW_WORDS, most_bytes)
    if windows is None:
        return _cut_by_shuffle(documents, benchmark, id_col, text_col)
    shared = documents.sparkSession.sparkContext.broadcast(windows)

    def open_scanner():
        def cut(text: bytes):
            n, places, _ = shared.value.find(text)
            return _without(words_of(text), places)

        return cut

    return scan_rows(documents, [id_col], text_col, "text string, n_cut long", open_scanner)


def _without(words: list[bytes], places: list[tuple[int, int]]) -> tuple[str, int]:
    """The words outside `places`, joined by spaces, and how many were left out."""
    hit = np.zeros(len(words), np.bool_)
    for at, length in places:
        hit[at : at + length] = True
    return b" ".join(w for w, h in zip(words, hit, strict=True) if not h).decode(), int(hit.sum())


def _cut_by_shuffle(documents, benchmark, id_col, text_col) -> DataFrame:
    text = F.col(text_col).cast("string")
    rows = documents.select(F.col(id_col).alias("__id"), text.alias("__text"), F.xxhash64(text, F.octet_length(text)).alias("__print"))
    texts = rows.groupBy("__print").agg(F.max("__text").alias("__text"))
    hits = _hits(texts, ["__print"], benchmark, "item_id", "text", WINDOW_WORDS)
    # One pair per place, however many items have it; places of one text are at most its words.
    places = hits.groupBy("__print").agg(F.collect_set(F.struct("at", "length")).alias("__places"))
    marked = rows.join(places.withColumnRenamed("__print", "__p"), F.col("__print") == F.col("__p"), "left")

    def open_scanner():
        def cut(text: bytes, places: list[dict] | None):
            return _without(words_of(text), [(p["at"], p["length"]) for p in places or ()])

        return cut

    cut = scan_rows(marked, ["__id"], "__text", "text string, n_cut long", open_scanner, beside="__places")
    return cut.withColumnRenamed("__id", id_col)


def op10_decontaminate(spark: SparkSession, root: str) -> DataFrame:
    found = contamination(table(spark, root, "documents"), table(spark, root, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


ORACLE = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT item, w, least(13, len(w)) AS n FROM item WHERE len(w) > 0),
held AS (
  SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
spot AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM held))),
hit AS (SELECT doc_id, i, spot.n AS n, item FROM spot JOIN held ON spot.n = held.n AND spot.win = held.win),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN cover ON cover.doc_id = doc.doc_id LEFT JOIN found ON found.doc_id = doc.doc_id
"""
