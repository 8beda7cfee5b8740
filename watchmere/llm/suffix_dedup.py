"""Repeated-substring removal by external induced sorting of suffixes.

Every byte covered by a string of WINDOW bytes that also starts somewhere else goes. Such a string is found from the
order of suffixes and their common prefixes, in the way of induced sorting: a sample of the suffixes is sorted, and the
order of the others follows from the sampled suffix behind them and the bytes in front of it.

1. Sample. In each WINDOW bytes the k-mer of smallest hash is an anchor, so equal windows have equal anchors at equal
   places. An anchor owns the windows it is the smallest of; what these span is its phrase.
2. Name and discard. Anchors are sorted by their k-mer's name; a suffix with a name of its own matches nothing for
   WINDOW bytes and is dropped. Equal phrases need no further look: all their windows are repeated.
3. Sort the rest. Anchors of one name with different phrases are sorted by the bytes behind them, and neighbours'
   common prefixes are kept. Sorting is Spark's external merge sort; sorted runs spill to disk and are merged from it.
4. Induce. The window that begins d bytes in front of an anchor is the tuple (d bytes, suffix at the anchor); two are
   equal where these bytes agree and the common prefix of the suffixes reaches WINDOW - d. All d are swept in turn.

Every stage is a shuffle by names or by documents with map-side folding. A name with more than GROUP phrases, as a
line that a third of all texts share, is not gathered: its windows are counted one by one in a further shuffle instead.

Null texts are empty and lose nothing. Texts of fewer than WINDOW bytes have no window. Texts that occur in several
rows are repeated as wholes. Matches never cross documents. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from watchmere.llm.common import schema_of, table
from watchmere.session import scratch_path

WINDOW = 200
KMER = 48
GROUP = 50_000  # phrases of one name that are sorted in one task
CHUNK = 1 << 20  # bytes hashed at a time, besides the rest of a document
BATCH = 20_000  # phrases induced at a time
PLACE_BITS = 26
PIECE = 1 << 25  # bytes of a text that are hashed together; with a chunk they fit into the place bits

_DRAW = np.random.default_rng(7)
_LETTERS = _DRAW.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = max(n, CHUNK + (CHUNK >> 1))
        step = np.full(size, base, np.uint64)
        step[0] = 1
        held = _powers[base] = np.multiply.accumulate(step)
    return held[:n]


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row, from block-wise minima in both directions."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def phrases_of(texts: list[bytes], window: int, kmer: int) -> tuple[np.ndarray, ...]:
    """(text, name, phrase, place of the anchor, bytes in front of it, windows) of all anchors of the texts."""
    lengths = np.array([len(t) for t in texts])
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if n < window:
        return none
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTERS[data] * powers(_BASE, n), out=sums[1:])
    undo = powers(_INVERSE, n + 1)
    names = mixed((sums[kmer:] - sums[: n - kmer + 1]) * undo[: n - kmer + 1])
    bits = np.uint64(PLACE_BITS)
    ranked = (names >> bits << bits) | np.arange(len(names), dtype=np.uint64)
    least = sliding_least(ranked, window - kmer + 1)
    place = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    text_of = np.repeat(np.arange(len(texts)), lengths)
    inside = text_of[: n - window + 1] == text_of[window - 1 :]
    fresh = inside.copy()
    fresh[1:] &= ~(inside[:-1] & (place[1:] == place[:-1]) & (text_of[1 : n - window + 1] == text_of[: n - window]))
    first = np.flatnonzero(fresh)
    if not len(first):
        return none
    # A run of windows ends before the next one begins, or where windows leave the document.
    last_inside = ends[text_of[first]] - window
    last = np.minimum(np.append(first[1:] - 1, n), last_inside)
    anchor = place[first]
    stop = last + window
    phrase = mixed((sums[stop] - sums[first]) * undo[first] + (stop - first).astype(np.uint64))
    begin = ends[text_of[first]] - lengths[text_of[first]]
    return text_of[first], names[anchor], phrase, anchor - begin, anchor - first, last - first + 1


def packed(length: np.ndarray, place: np.ndarray, before: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Place, bytes in front and windows of an anchor in one number, with bits of the document's length on top."""
    return ((length & 0x7FFF) << 48) | (place << 16) | (before << 8) | (windows - 1)


ANCHORS = "name long, phrase long, doc long, spot long"


def anchors(texts: DataFrame, window: int, kmer: int, piece: int = PIECE) -> DataFrame:
    """All anchors of (doc, body); texts that a task has met before are left out, copies are found as wholes.

    A text of more than `piece` bytes is cut into pieces that overlap by a window less a byte, so each of its windows
    lies in one of them.
    """
    schema = schema_of(ANCHORS)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()

        def made(docs: list[int], held: list[bytes], begins: list[int], lengths: list[int]) -> pa.RecordBatch:
            text, name, phrase, place, before, count = phrases_of(held, window, kmer)
            spot = packed(np.array(lengths)[text], place + np.array(begins)[text], before, count)
            columns = [name.view(np.int64), phrase.view(np.int64), np.array(docs, np.int64)[text], spot]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=arrow)

        for batch in batches:
            docs, held, begins, lengths, size = [], [], [], [], 0
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                if doc in met:
                    continue
                met.add(doc)
                body = body.as_py()
                for begin in range(0, max(len(body) - window + 1, 0), piece):
                    part = body[begin : begin + piece + window - 1] if len(body) > piece else body
                    docs.append(doc)
                    held.append(part)
                    begins.append(begin)
                    lengths.append(len(body))
                    size += len(part)
                    if size >= CHUNK:
                        yield made(docs, held, begins, lengths)
                        docs, held, begins, lengths, size = [], [], [], [], 0
            if held:
                yield made(docs, held, begins, lengths)

    return texts.mapInArrow(run, schema)


def induced(names: np.ndarray, bodies: list[bytes], before: np.ndarray, windows: np.ndarray, window: int) -> list[list[tuple[int, int]]]:
    """For each phrase, given in the order of names, the stretches of it whose windows another one of its name has."""
    m = len(bodies)
    width = window
    behind = [body[b : b + window] for body, b in zip(bodies, before, strict=True)]
    order = np.array(sorted(range(m), key=lambda i: (names[i], behind[i])))
    right = np.zeros((m, width), np.uint8)
    left = np.zeros((m, int(before.max()) + 1), np.uint8)
    for row, i in enumerate(order):
        right[row, : len(behind[i])] = np.frombuffer(behind[i], np.uint8)
        b = int(before[i])
        left[row, :b] = np.frombuffer(bodies[i], np.uint8, b)[::-1]
    names, before, windows = names[order], before[order], windows[order]
    differ = right[1:] != right[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common[names[1:] != names[:-1]] = -1
    found: list[list[int]] = [[] for _ in range(m)]
    front = np.zeros(m, np.uint64)
    for d in range(int(before.max()) + 1):
        if d:
            front = front * np.uint64(_BASE) + _LETTERS[left[:, d - 1]]
        owns = np.flatnonzero((d <= before) & (d > before - windows))
        if len(owns) < 2:
            continue
        run = np.concatenate(([0], np.cumsum(common < window - d))).astype(np.uint64)[owns]
        key = mixed(front[owns]) + run * np.uint64(0xC2B2AE3D27D4EB4F)
        by_key = np.argsort(key, kind="stable")
        same = key[by_key[1:]] == key[by_key[:-1]]
        twice = np.zeros(len(owns), np.bool_)
        twice[by_key[1:][same]] = True
        twice[by_key[:-1][same]] = True
        for row in owns[twice].tolist():
            found[row].append(d)
    out: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    for row, distances in enumerate(found):
        spans: list[tuple[int, int]] = []
        b = int(before[row])
        for d in reversed(distances):  # from the first window to the last
            start = b - d
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], start + window)
            else:
                spans.append((start, start + window))
        out[order[row]] = spans
    return out


SPANS = "doc long, size long, start long, end long"


def _unpack(spot: int) -> tuple[int, int, int, int]:
    return spot >> 48, (spot >> 16) & 0xFFFFFFFF, (spot >> 8) & 0xFF, (spot & 0xFF) + 1


def sorted_names(rows: DataFrame, window: int) -> DataFrame:
    """Stretches from phrases (name, phrase, doc, spot, n, body), dealt out and sorted by name."""
    schema = schema_of(SPANS)
    arrow = to_arrow_schema(schema)
    dealt = rows.repartition("name").sortWithinPartitions("name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def made(rows: list[tuple]) -> pa.RecordBatch:
            spots = [_unpack(r[2]) for r in rows]
            before = np.array([s[2] for s in spots])
            count = np.array([s[3] for s in spots])
            spans = induced(np.array([r[0] for r in rows]), [r[4] for r in rows], before, count, window)
            out: list[tuple] = []
            for r, s, stretches in zip(rows, spots, spans, strict=True):
                if r[3] == 1:  # else the whole phrase is known to be repeated
                    out += [(r[1], s[0], s[1] - s[2] + start, s[1] - s[2] + end) for start, end in stretches]
            return pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], pa.int64()) for i in range(4)], schema=arrow
            )

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if len(held) >= BATCH and row[0] != held[-1][0]:
                    yield made(held)
                    held = []
                held.append(row)
        if held:
            yield made(held)

    return dealt.select("name", "doc", "spot", "n", "body").mapInArrow(run, schema)


def counted_windows(rows: DataFrame, window: int) -> DataFrame:
    """The same for names with very many phrases: each window is a row, and equal ones meet in a shuffle."""
    bytes_at = F.expr(f"substring(body, d + 1, {window})")
    spot = rows.select(
        "name", "doc", "spot", "n", "body", F.explode(F.sequence(F.lit(0), F.expr("int(spot & 255)"))).alias("d")
    )
    windows = spot.select("doc", "spot", "n", "d", F.sha2(bytes_at, 256).alias("window"), F.expr("spot >> 8 & 255").alias("b"))
    often = windows.groupBy("window").agg(F.count("*").alias("m")).filter("m > 1")
    return windows.filter("n = 1").join(often, "window", "left_semi").select(
        "doc",
        F.expr("spot >> 48").alias("size"),
        F.expr("(spot >> 16 & 4294967295) - b + d").alias("start"),
        F.expr(f"(spot >> 16 & 4294967295) - b + d + {window}").alias("end"),
    )


def _small(body: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1, write_content_size=True).compress(body)


def _whole(body: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(body)


def _squeezed(texts: DataFrame) -> DataFrame:
    """Texts compressed one by one, as they go through shuffles."""
    schema = texts.schema
    at = texts.columns.index("body")
    out = schema_of(", ".join(f"`{f.name}` {'binary' if f.name == 'body' else f.dataType.simpleString()}" for f in schema))
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            columns = [c.cast(arrow.field(i).type) if i != at else c for i, c in enumerate(batch.columns)]
            columns[at] = pa.array([_small(t.as_py()) for t in batch.column(at).cast(pa.binary())], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return texts.mapInArrow(run, out)


def _phrase_bodies(found: DataFrame, window: int) -> DataFrame:
    """Rows with a compressed document, whose `body` becomes that of their phrase."""
    out = schema_of("name long, phrase long, doc long, spot long, n long, large boolean, body binary")
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            wanted, texts = batch.column(2).to_pylist(), batch.column(3)
            rows = []
            for doc, asked, text in zip(batch.column(0).to_pylist(), wanted, texts, strict=True):
                body = _whole(text.as_py())
                for w in asked:
                    _, place, before, count = _unpack(w["spot"])
                    start = place - before
                    rows.append((w["name"], w["phrase"], doc, w["spot"], w["n"], w["large"], body[start : start + count - 1 + window]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], arrow.field(i).type) for i in range(7)], schema=arrow
            )

    return found.select("doc", "size", "asked", "body").mapInArrow(run, out)


def repeated_spans(
    texts: DataFrame, window: int = WINDOW, kmer: int = KMER, group: int = GROUP, piece: int = PIECE
) -> DataFrame:
    """(doc, size, start, end): stretches of bytes to remove, from (doc, size, body)."""
    spark = texts.sparkSession
    copies = texts.groupBy("doc", "size", F.octet_length("body").cast("long").alias("end")).agg(F.count("*").alias("n"))
    copies = copies.filter(f"n > 1 AND end >= {window}").select("doc", "size", F.lit(0).cast("long").alias("start"), "end")
    found = anchors(texts.select("doc", "body"), window, kmer, piece)
    crowds = found.groupBy("name").agg(F.count("*").alias("c")).filter("c > 1").select("name")
    path = scratch_path(spark, "suffix-sample")
    found.join(crowds, "name", "left_semi").write.parquet(path)
    sample = spark.read.parquet(path)
    phrases = sample.groupBy("name", "phrase").agg(
        F.count("*").alias("n"), F.min("doc").alias("doc"), F.min_by("spot", "doc").alias("spot")
    )
    path = scratch_path(spark, "suffix-phrases")
    phrases.write.parquet(path)
    phrases = spark.read.parquet(path)
    place, before, more = "(spot >> 16 & 4294967295)", "(spot >> 8 & 255)", "(spot & 255)"
    whole = sample.join(phrases.filter("n > 1").select("name", "phrase"), ["name", "phrase"], "left_semi").select(
        "doc",
        F.expr("spot >> 48").alias("size"),
        F.expr(f"{place} - {before}").alias("start"),
        F.expr(f"{place} - {before} + {more} + {window}").alias("end"),
    )
    open_names = phrases.groupBy("name").agg(F.count("*").alias("d"), F.min("n").alias("least"))
    open_names = open_names.filter("d > 1 AND least = 1").select("name", (F.col("d") > group).alias("large"))
    asked = phrases.join(open_names, "name").select("doc", F.expr("spot >> 48").alias("size"), F.struct("name", "phrase", "spot", "n", "large").alias("ask"))
    asked = asked.groupBy("doc", "size").agg(F.collect_list("ask").alias("asked"))
    met = asked.join(_squeezed(texts), ["doc", "size"]).dropDuplicates(["doc", "size"])
    path = scratch_path(spark, "suffix-bodies")
    _phrase_bodies(met, window).write.parquet(path)
    open_phrases = spark.read.parquet(path)
    small = sorted_names(open_phrases.filter("NOT large"), window)
    large = counted_windows(open_phrases.filter("large"), window)
    return copies.unionByName(whole).unionByName(small).unionByName(large)


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted stretches, those that touch made one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


REMOVED = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    kmer: int = KMER,
    group: int = GROUP,
    kept_text: bool = False,
    piece: int = PIECE,
) -> DataFrame:
    """One row per document: its bytes, those removed, the runs of removed bytes, the digest of the rest.

    With `kept_text` the rest itself comes as a binary column `kept`.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = documents.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("doc"), (F.octet_length(text) % 32768).cast("long").alias("size"), text.alias("body")
    )
    spans = repeated_spans(named.select("doc", "size", "body"), window, kmer, group, piece)
    by_doc = spans.groupBy("doc", "size").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = _squeezed(named).join(by_doc, ["doc", "size"], "left").select("id", "body", "spans")
    id_type = named.schema["id"].dataType.simpleString()
    schema = schema_of(f"`{id_col}` {id_type}, {REMOVED}" + (", kept binary" if kept_text else ""))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                body = _whole(body.as_py())
                gone = joined_spans([(s["start"], s["end"]) for s in spans or ()])
                parts, at = [], 0
                for start, end in gone:
                    parts.append(body[at:start])
                    at = end
                kept = b"".join([*parts, body[at:]])
                row = len(body), len(body) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()
                rows.append((*row, kept) if kept_text else row)
            columns = zip(*rows, strict=True) if rows else [[] for _ in range(len(arrow) - 1)]
            arrays = [batch.column(0).cast(arrow.field(0).type)]
            arrays += [pa.array(list(c), arrow.field(1 + i).type) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return joined.mapInArrow(run, schema)


def op5_suffix_dedup(spark: SparkSession, root: str) -> DataFrame:
    return remove_repeats(table(spark, root, "documents"))
