"""Quality rules: counts of a text and its tokeniser fertility, with rejection bands per script.

Words are what ASCII white space separates. Two public vocabularies measure each text: a piece vocabulary that falls
back to bytes, and a byte-level one. Both cut words apart anyway, so each different word is tokenised once and
remembered in the Python worker, and unknown words are tokenised many at a time. Characters per token, the share of fallback bytes and the entropy of the tokens
(relative to the largest for that many) must lie in the bands of the text's language and main script. The bands are fitted
to all documents that `labels` calls good; a language of which there are few has its script's wide ones. Each document is
measured once, and the fitted bands are held against the stored measures.
Text of symbols alone is a script of its own and is rejected.

A null or empty text has no words and fails; very long texts are read whole, one at a time; repeated rows each get
their own row; an empty table gives an empty result; only the id, text and language columns are read.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from dataclasses import dataclass, replace

import numpy as np
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchmere.llm.common import Memory, keep_rows, resident, scan_rows, table
from watchmere.session import cut_lineage, scratch_path

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
FOUND = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, script string, chars_per_piece double, chars_per_byte_token double, fallback_share double, "
    "token_entropy double"
)


@dataclass(frozen=True)
class Band:
    """Limits of a script; a text outside any of them is rejected."""

    least_chars: float  # characters of words per token, by both vocabularies
    most_chars: float
    most_fallback: float  # of the tokens
    least_entropy: float  # of the largest possible
    least_piece: float = 0.0  # characters per token of the piece vocabulary
    least_byte: float = 0.0  # and of the byte-level one


# Readable text of any language of a script lies well inside; noise in encodings, symbols or endless repeats does not.
BANDS = {
    "latin": Band(1.35, 9.0, 0.10, 0.35),
    "greek": Band(0.6, 6.0, 0.30, 0.30),
    "cyrillic": Band(0.8, 7.0, 0.20, 0.30),
    "semitic": Band(0.5, 6.0, 0.40, 0.30),
    "indic": Band(0.2, 5.0, 0.90, 0.25),
    "cjk": Band(0.3, 4.0, 0.70, 0.25),
    "other": Band(0.2, 9.0, 0.95, 0.20),
    "symbols": Band(float("inf"), 9.0, 0.95, 0.20),
}
# Bands are fitted to labelled documents, from so many of a language on, at this quantile.
LEAST_SAMPLE = 50
QUANTILE = 0.005
# A text may hold a few more foreign characters than the sample's.
MORE_FALLBACK = 0.02
# Fitted limits have steps of one to so many, which bounds the counts that a quantile is taken from.
STEPS = 10000
# Words that a worker remembers in each of two generations.
MEMORY_WORDS = 200_000
# Unknown words are tokenised so many at a time, joined by spaces, if no character in them can act across a space.
AT_ONCE = 1000
PLAIN = re.compile("[\x21-\x7e\u00c0-\u024f\u0386-\u03ce\u0400-\u0482\u048a-\u052f\u4e00-\u9fff ]*")
SPACE = "\u2581"  # in pieces
# Scripts by the first byte of a character in UTF-8.
FIRST_BYTES = {
    "latin": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)],
    "greek": [0xCD, 0xCE, 0xCF],
    "cyrillic": [*range(0xD0, 0xD4)],
    "semitic": [*range(0xD6, 0xDC)],
    "indic": [0xE0],
    "cjk": [*range(0xE3, 0xEE)],
}
SCRIPTS = [*FIRST_BYTES]
WRITTEN = {"Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Me", "Nd", "Nl"}
SCRIPT_OF_BYTE = np.full(256, len(SCRIPTS))
for _number, _script in enumerate(SCRIPTS):
    SCRIPT_OF_BYTE[FIRST_BYTES[_script]] = _number


class Vocabularies:
    """Token numbers and counts of single words, remembered between texts."""

    def __init__(self, pieces: str, ranks: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.vocab_size())]
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(len(names))])
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.bytes = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        # Tokens that begin a word; joined words are told apart by them, unless a piece goes on into the next word.
        self.opens = np.array([name.startswith(SPACE) for name in names])
        self.opens_bytes = np.zeros(max(table.values()) + 1, np.bool_)
        self.opens_bytes[[rank for token, rank in table.items() if token.startswith(b" ")]] = True
        self.apart = not any(SPACE in name[1:] and name.strip(SPACE) for name in names)
        self.known = Memory(MEMORY_WORDS)

    def tokens(self, words: list[bytes]) -> tuple[np.ndarray, int]:
        """The words' pieces, and how many byte-level tokens they have."""
        young, recall = self.known.young, self.known.recall
        found = [young.get(w) or recall(w) for w in words]
        if None in found:
            new = list(dict.fromkeys([w for w, f in zip(words, found, strict=True) if f is None]))
            made = {}
            for start in range(0, len(new), AT_ONCE):
                part = new[start : start + AT_ONCE]
                for word, value in zip(part, self.tokenised([w.decode() for w in part]), strict=True):
                    made[word] = self.known.keep(word, value)
            found = [f or made[w] for w, f in zip(words, found, strict=True)]
        return np.frombuffer(b"".join([f[0] for f in found]), np.int32), sum([f[1] for f in found])

    def tokenised(self, texts: list[str]) -> list[tuple[bytes, int]]:
        """Of each word its pieces, as the bytes of an array, and its number of byte-level tokens."""
        if not self.apart:
            return self.one_by_one(texts)
        if PLAIN.fullmatch(" ".join(texts)):
            return self.joined(texts)
        plain = [t for t in texts if PLAIN.fullmatch(t)]
        odd = [t for t in texts if not PLAIN.fullmatch(t)]
        made = dict(zip(plain + odd, self.joined(plain) + self.one_by_one(odd), strict=True))
        return [made[t] for t in texts]

    def joined(self, texts: list[str]) -> list[tuple[bytes, int]]:
        if not texts:
            return []
        text = " ".join(texts)
        ids, coarse = np.array(self.pieces.encode(text), np.int32), np.array(self.bytes.encode_ordinary(" " + text))
        at, coarse_at = np.flatnonzero(self.opens[ids]), np.flatnonzero(self.opens_bytes[coarse])
        if not len(at) == len(coarse_at) == len(texts):
            return self.one_by_one(texts)
        held = ids.tobytes()
        cuts = [*(ids.itemsize * at).tolist(), len(held)]
        counts = np.diff(coarse_at, append=len(coarse)).tolist()
        return [(held[a:b], n) for a, b, n in zip(cuts, cuts[1:], counts)]

    def one_by_one(self, texts: list[str]) -> list[tuple[bytes, int]]:
        coarse = self.bytes.encode_ordinary
        pieces = self.pieces.encode(texts, num_threads=1)
        return [(np.array(ids, np.int32).tobytes(), len(coarse(" " + t))) for t, ids in zip(texts, pieces, strict=True)]


def vocabularies(pieces: str, ranks: str) -> Vocabularies:
    return resident((pieces, ranks), lambda: Vocabularies(pieces, ranks))


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three words that the text has twice or more."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    row = np.fromiter([numbers.setdefault(w, len(numbers)) for w in words], np.int64, n)
    pairs = row[:-1] * len(numbers) + row[1:]
    if len(numbers) >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(numbers) + row[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, np.bool_)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n, np.bool_)
    hit[:-2] |= twice
    hit[1:-1] |= twice
    hit[2:] |= twice
    return int(hit.sum())


def is_symbols(text: str) -> bool:
    """Whether letters, the marks that some scripts write on them, and digits are less than half of the characters."""
    return 2 * sum(unicodedata.category(c) in WRITTEN for c in text) < len(text)


class QualityScanner:
    def __init__(self, pieces: str | None = None, ranks: str | None = None, bands: dict[str, Band] | None = None):
        self.words = vocabularies(
            pieces or public_tokenizers.path("piece_bpe_32k.model"),
            ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"),
        )
        self.bands = bands or BANDS

    def close(self) -> None:
        self.words.known.forget()

    def __call__(self, text: bytes, lang: str | None = None):
        words = text.split()
        n = len(words)
        joined = b"".join(words)
        raw = np.bincount(np.frombuffer(joined, np.uint8), minlength=256)
        chars = len(joined) - int(raw[0x80:0xC0].sum())
        lines = [line for line in text.split(b"\n") if line.strip()]
        repeated = repeated_words(words)
        failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED_PERCENT * n
        by_script = np.bincount(SCRIPT_OF_BYTE, weights=raw, minlength=len(SCRIPTS) + 1)[:-1]
        script = SCRIPTS[int(by_script.argmax())] if by_script.any() else "other"
        if script == "other" and n:
            script = "symbols" if is_symbols(joined.decode()) else script
        per_piece = per_byte = fallback = entropy = None
        if n:
            ids, coarse = self.words.tokens(words)
            counts = np.unique(ids, return_counts=True)[1]
            share = counts / len(ids)
            bits = float(-(share * np.log2(share)).sum())
            entropy = round(bits / np.log2(len(ids)), 6) if len(ids) > 1 else 0.0
            per_piece, per_byte = round(chars / len(ids), 6), round(chars / coarse, 6)
            fallback = round(float(self.words.is_byte[ids].mean()), 6)
        band = self.bands.get(f"{script} {lang}", self.bands[script])
        kept = (
            not failed
            and band.least_chars <= min(per_piece, per_byte)
            and band.least_piece <= per_piece
            and band.least_byte <= per_byte
            and max(per_piece, per_byte) <= band.most_chars
            and fallback <= band.most_fallback
            and entropy >= band.least_entropy
        )
        symbols = int(raw[list(SYMBOLS)].sum())
        repeated_lines = len(lines) - len(set(lines))
        return n, chars, symbols, repeated_lines, repeated, failed, kept, script, per_piece, per_byte, fallback, entropy


def fitted_bands(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> dict[str, Band]:
    """BANDS, and narrower ones of each language and script, by what all labelled good documents measure."""
    named = documents.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), text_col)
    return bands_of(scan_rows(named, ["doc_id", "lang"], text_col, FOUND, QualityScanner), labels)


def bands_of(
    measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", lang_col: str = "lang"
) -> dict[str, Band]:
    """As `fitted_bands`, from rows that hold the measures. Entropy falls with a text's length, so that its limit stays."""
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("__good"))
    rows = measured.filter("not base_failed").select(
        F.col(id_col).alias("__id"),
        "script",
        F.col(lang_col).alias("lang"),
        (F.floor(F.col("chars_per_piece") * STEPS) / STEPS).alias("piece"),
        (F.floor(F.col("chars_per_byte_token") * STEPS) / STEPS).alias("byte"),
        (F.ceil(F.col("fallback_share") * STEPS) / STEPS).alias("fallback"),
    )
    rows = rows.join(good, F.col("__id") == F.col("__good"), "left_semi").groupBy("script", "lang").agg(
        F.count("*").alias("n"),
        F.percentile("piece", F.lit(QUANTILE)).alias("piece"),
        F.percentile("byte", F.lit(QUANTILE)).alias("byte"),
        F.percentile("fallback", F.lit(1 - QUANTILE)).alias("fallback"),
    )
    bands = dict(BANDS)
    for r in rows.filter(f"n >= {LEAST_SAMPLE}").collect():
        wide = BANDS[r.script]
        fallback = min(wide.most_fallback, r.fallback + MORE_FALLBACK)
        fitted = replace(wide, most_fallback=fallback, least_piece=r.piece, least_byte=r.byte)
        bands[f"{r.script} {r.lang}"] = fitted
    return bands


def within_bands(bands: dict[str, Band], lang_col: str = "lang") -> Column:
    """Whether a row that the scripts' wide bands keep also lies in the fitted ones, which are narrower in three limits."""
    fitted = {key: (b.least_piece, b.least_byte, b.most_fallback) for key, b in bands.items() if key not in BANDS}
    inside = F.lit(True)
    if fitted:
        parts = [F.array(*map(F.lit, x)) for x in fitted.values()]
        held = F.map_from_arrays(F.array(*map(F.lit, fitted)), F.array(*parts))
        limits = F.try_element_at(held, F.concat("script", F.lit(" "), F.coalesce(lang_col, F.lit("None"))))
        inside = limits.isNull() | (
            (F.col("chars_per_piece") >= limits[0])
            & (F.col("chars_per_byte_token") >= limits[1])
            & (F.col("fallback_share") <= limits[2])
        )
    return F.col("kept") & F.coalesce(inside, F.lit(False))


def keep_fitted(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """The rows, all columns, that pass with bands fitted to `labels`; measures are stored beside the rows, so that no
    text is measured twice or shuffled."""
    spark = documents.sparkSession
    path = scratch_path(spark, "measured")
    given = [f"__given_{i}" for i in range(len(documents.columns))]
    at = [given[documents.columns.index(c)] for c in (id_col, text_col, lang_col)]
    scan_rows(documents.toDF(*given), given, at[1], FOUND, QualityScanner).write.parquet(path)
    measured = spark.read.parquet(path)
    kept = measured.filter(within_bands(bands_of(measured, labels, at[0], at[2]), at[2]))
    return kept.select(*given).toDF(*documents.columns)


def quality(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    pieces: str | None = None,
    ranks: str | None = None,
    bands: dict[str, Band] | None = None,
    lang_col: str | None = None,
) -> DataFrame:
    """One row per document: counts, measures of both vocabularies, and the verdict."""
    return scan_rows(
        documents, [id_col], text_col, FOUND, lambda: QualityScanner(pieces, ranks, bands), beside=lang_col
    )


def keep_good(
    documents: DataFrame, text_col: str = "text", bands: dict[str, Band] | None = None, lang_col: str | None = None
) -> DataFrame:
    """The rows, all columns, that pass."""

    def open_test():
        scanner = QualityScanner(bands=bands)

        def test(text: bytes, lang: str | None = None) -> bool:
            return scanner(text, lang)[6]

        test.close = scanner.close
        return test

    return keep_rows(documents, text_col, open_test, lang_col)


def op4_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    documents = table(spark, root, "documents")
    measured = cut_lineage(scan_rows(documents, ["doc_id", "lang"], "text", FOUND, QualityScanner))
    bands = bands_of(measured, table(spark, root, "labels"))
    return measured.withColumn("kept", within_bands(bands)).drop("lang")
