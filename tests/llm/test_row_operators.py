"""Operators that look at one text at a time, against plain Python."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import ROOT, odd_documents
from watchmere.llm import bpe, license_scan, pii, quality, secrets
from watchmere.llm.queries import QUERIES
from watchmere.llm.suffix_automaton import SuffixAutomaton

ODD = [None, "", " \n\t", "x", "same words here", "same words here", "a" * 5000, "\x00\x1c\xa0 é 日本", "word " * 3000]
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_automaton_statistics():
    rnd = random.Random(2)
    machine = SuffixAutomaton()
    texts = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 12))) for _ in range(12)]
    for i, t in enumerate(texts):
        machine.add(i, t)
    machine.locate()
    for _ in range(200):
        q = "".join(rnd.choice("abcd") for _ in range(20))
        for end, (state, n) in enumerate(machine.statistics(q), 1):
            best = max((k for k in range(end + 1) if k == 0 or any(q[end - k : end] in t for t in texts)), default=0)
            assert n == best
            if n:
                part = q[end - n : end]
                places = {(i, e) for i, t in enumerate(texts) for e in range(len(part), len(t) + 1) if t[e - len(part) : e] == part}
                assert set(machine.places[state]) == places


def license_base(text):
    words = WORDS.findall(lower(text))
    places = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_license_scan(spark, given):
    extra = [*ODD, "MIT License, the mit license. GNU General Public-License", "mit mit license license", "general public apache license"]
    df = odd_documents(spark, extra)
    got = license_scan.scan_licenses(df).collect()
    assert [tuple(r)[1:6] for r in got] == [license_base(t) for t in extra]
    full = {r.doc_id: r for r in QUERIES["op1_license_scan"](spark, ROOT).collect()}
    assert {d: tuple(full[d])[1:6] for d, _ in given} == {d: license_base(t) for d, t in given}
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in full.values())
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


def test_license_templates_survive_edits(spark):
    words = license_scan.TEMPLATES["mit-text"].split()
    edited = " ".join(["noise"] * 30 + words[:20] + ["changed"] + words[22:] + ["noise"] * 30)
    scan = license_scan.LicenseScanner()
    found = scan(edited.encode())
    assert found[5] == "mit-text" and found[6] > 0.8
    span = found[7][0]
    assert span["first_word"] == 30 and span["end_word"] == 30 + len(license_scan.words_of(" ".join(words[:20] + ["changed"] + words[22:]).encode()))
    assert scan(b"permission is hereby given to nobody")[5] == ""


def secret_base(text):
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f for _, _, f in sorted(found)]


def test_secret_scan(spark, given):
    extra = [*ODD, "token=token:abcdefg password = 'hunter22' AKIA" + "A" * 16 + " " + "0f" * 12, "SECRET:\"Zz9/+=_.-\" paſſword=abcdefgh"]
    df = odd_documents(spark, extra)
    for rows, texts in ((secrets.scan_secrets(df).collect(), extra), (QUERIES["op2_secret_scan"](spark, ROOT).collect(), dict(given))):
        for r in rows:
            want = secret_base(texts[r.doc_id] or "")
            assert r.base_sha256 == sha(",".join(want))
            assert [r.n_assign, r.n_access, r.n_hex] == [sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")]
            held = r.spans if isinstance(r.spans, str) else ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans)
            assert set(want) <= set(held.split(","))
    assert secrets.scan_secrets(df.limit(0)).count() == 0


def test_field_learns_and_decodes_best_path():
    rnd = random.Random(1)
    texts = [f"some words then key {rnd.choice(':=')} {rnd.getrandbits(120):x} and version {rnd.randrange(10**6, 10**7)} more" for _ in range(150)]
    windows, tags = [], []
    for t in texts:
        at = re.search("[0-9a-f]{20,}", t)
        for w in secrets.windows_of(t):
            windows.append(w)
            tags.append(secrets.tags_of(w, [at.span()] if at else []))
    field = secrets.Field().fit(windows[:100], tags[:100])
    right = sum(field.decode(field.scores(w.features)) == t for w, t in zip(windows[100:], tags[100:], strict=True))
    assert right >= 0.9 * len(windows[100:])
    # Viterbi against all paths.
    import itertools

    scores = field.scores(windows[0].features[:6])

    def worth(path):
        before, total = secrets.OUTSIDE, 0.0
        for tag, row in zip(path, scores, strict=True):
            total += field.follow[before, tag] + row[tag]
            before = tag
        return total

    assert tuple(field.decode(scores)) == max(itertools.product(range(3), repeat=6), key=worth)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_bpe_matches_library(library):
    rnd = random.Random(4)
    texts = ["", "<|endoftext|>hi <|startoftext|> a<|x|>", "ΣΑΣ İstanbul ß", "日本語 한국어", "é ﬁ ½ ² Ⅷ", "a\x1cb\x85c\xa0d", "🎉👨‍👩‍👧 x", "WE'LL don't 's", "x" * 500, "a" * 333]
    texts += ["".join(rnd.choice("aabcdehinorst 'ABé1½.-") for _ in range(rnd.randrange(40))) for _ in range(1500)]
    vocab = bpe.vocabulary()
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        got = vocab.encode(t)
        assert got == want, t
        assert vocab.decode(got) == library.decode(want, skip_special_tokens=False)


def test_bpe_query(spark, given, library):
    got = {r.doc_id: r for r in QUERIES["op3_bpe"](spark, ROOT).collect()}
    assert len(got) == len(given)
    for d, t in given:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (got[d].n_tokens, got[d].ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert got[d].decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))
    df = odd_documents(spark, ODD)
    rows = bpe.encode(df).collect()
    assert [r.ids for r in rows] == [library.encode(t or "", add_special_tokens=False).ids for t in ODD]
    assert bpe.encode(df.limit(0)).count() == 0


def quality_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    hit = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(3)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), failed


def test_quality(spark, given):
    extra = [*ODD, "a b c a b c a b c", "\n".join(["one line"] * 30), "a a a a", "\x85\x1cword\x0b" * 60]
    df = odd_documents(spark, extra)
    assert [tuple(r)[1:7] for r in quality.quality(df).collect()] == [quality_base(t) for t in extra]
    got = {r.doc_id: r for r in QUERIES["op4_quality_rules"](spark, ROOT).collect()}
    assert {d: tuple(got[d])[1:7] for d, _ in given} == {d: quality_base(t) for d, t in given}
    assert not any(r.kept and r.base_failed for r in got.values())
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and quality.keep_good(df.limit(0)).count() == 0


def test_quality_bands_reject_noise():
    scanner = quality.QualityScanner()
    rnd = random.Random(3)
    prose = " ".join(rnd.choice("the of and water stone bridge river people evening morning".split()) + str(i % 7) * (i % 5 == 0) for i in range(300))
    noise = " ".join("".join(chr(rnd.randrange(0x2400, 0x2BFF)) for _ in range(8)) for _ in range(100))
    assert scanner(noise.encode())[10] > 0.9
    assert not quality.QualityScanner(bands={**quality.BANDS, "other": quality.Band(0.5, 9, 0.5, 0.2)})(noise.encode())[6]
    assert scanner(prose.encode())[8] > 1.2


def test_production_bands_reject_noise_and_labelled_junk(spark):
    root = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{root}/{name}.parquet") for name in ("documents", "labels"))
    bands = quality.fitted_bands(documents, labels)
    rnd = random.Random(4)
    symbols = " ".join("".join(chr(rnd.randrange(0x2400, 0x2BFF)) for _ in range(8)) for _ in range(100))
    encoded = " ".join("".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(12)) for _ in range(200))
    letters = " ".join("".join(chr(rnd.randrange(0x10A0, 0x10F0)) for _ in range(6)) for _ in range(100))
    for used in (quality.BANDS, bands):
        scanner = quality.QualityScanner(bands=used)
        assert scanner(symbols.encode())[6:8] == (False, "symbols")
        assert not scanner(encoded.encode(), "en")[6]
        assert scanner(letters.encode())[7] == "other"
    got = QUERIES["op4_quality_rules"](spark, root).join(labels, "doc_id").filter("not base_failed")
    kept = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert kept[0, False] > kept.get((0, True), 0)
    assert kept.get((1, False), 0) <= 0.03 * kept[1, True]
    assert quality.fitted_bands(documents.limit(0), labels) == quality.BANDS


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def pii_base(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }
            if good[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_spans(spark):
    rnd = random.Random(5)
    parts = ["1", "2", "45", ".", "@", "a", "b.c", "+", "-", " ", "(", "\n", "é", "😀", "4111111111111111", "10.0.0.1", "x@y.z", "_"]
    texts = [*ODD, "1" * 3000, "1 " * 2000, "a@b.c " * 300, "1." * 1500, "+1" + "2-" * 1500, "@" * 3000]
    texts += ["".join(rnd.choice(parts) for _ in range(rnd.randrange(60))) for _ in range(400)]
    df = odd_documents(spark, texts)
    found = {r.doc_id: r.base for r in pii.find_pii(df).collect()}
    for i, t in enumerate(texts):
        assert [(s.kind, s.start, s.end) for s in found[i]] == pii_base(t), t
    assert pii.find_pii(df.limit(0)).count() == 0


def test_pii_query(spark, given):
    for r in QUERIES["op9_pii"](spark, ROOT).collect():
        want = pii_base(dict(given)[r.doc_id])
        assert r.base_sha256 == sha(",".join(f"{k}:{s}:{e}" for k, s, e in want))
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(r.spans.split(","))


def test_redaction(spark):
    df = odd_documents(spark, ["mail a@b.org or call +1 234 567 8901 now", None])
    assert [r.text for r in pii.redact(df).collect()] == ["mail [email] or call [phone] now", ""]


def test_pii_in_a_text_of_very_many_matches(spark):
    rng = random.Random(6)
    kinds = ("10.0.{}.{}", "a{}@b{}.org", "+49 30 {}{}12345", "4111 1111 1111 1111 {} {}", "\U0001f600 {} é {}", "nothing {}:{}")
    text = " ".join(rng.choice(kinds).format(rng.randrange(300), rng.randrange(300)) for _ in range(16_000))
    found = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id LONG, text STRING")).first()
    assert [(s.kind, s.start, s.end) for s in found.base] == pii_base(text) and len(found.base) > 6000


def test_pii_trees_learn_from_all_different_texts(spark, monkeypatch):
    """6,000 texts of 18,000 candidates and more, past what a sample once held, copies counted once."""
    texts = [f"ref 12-{i} at 10.0.{i % 300}.{i % 7}, card {i} 4111" for i in range(6000)] + ["mail a@b.org", None, ""]
    df = odd_documents(spark, texts + texts[:500])
    given, fit = [], pii.GBTClassifier.fit

    def noted(self, rows):
        given.append(rows.agg(F.sum("n" if "n" in rows.columns else F.lit(1)), F.sum(F.col("label") * (F.col("n") if "n" in rows.columns else 1))).first())
        return fit(self, rows)

    monkeypatch.setattr(pii.GBTClassifier, "fit", noted)
    assert pii.train(df) is not None
    found = df.select("text").distinct().filter(F.pmod(F.xxhash64("text"), F.lit(4)) != 0).select(F.explode(pii.candidates(F.col("text"))).alias("c"))
    rows, bases = found.agg(F.count("*"), F.count_if("c.base")).first()
    assert given[0][0] == rows > 10_000 and bases <= given[0][1] < rows
    assert pii.train(df.limit(0)) is None


def test_pii_spans_that_overlap_no_base_span(spark):
    rng = random.Random(8)

    def spans(n):
        starts = [rng.randrange(300) for _ in range(n)]
        return [(s, s + rng.choice((1, 2, 5, 40))) for s in starts]

    rows = [(i, spans(rng.randrange(30)), spans(rng.randrange(12))) for i in range(60)] + [(60, [], []), (61, [(0, 3)], [(3, 5)])]
    span = "ARRAY<STRUCT<start: INT, end: INT>>"
    df = spark.createDataFrame(rows, f"id INT, mine {span}, others {span}")
    kept = {r.id: [tuple(s) for s in r.kept] for r in df.select("id", pii.uncovered(F.col("mine"), F.col("others")).alias("kept")).collect()}
    assert kept == {i: [c for c in mine if not any(c[0] < o[1] and o[0] < c[1] for o in others)] for i, mine, others in rows}
    text = "".join(rng.choice("ab é\U0001f600\n") for _ in range(3 * pii.CELL + 7))
    places = [0, 1, 5, 30, pii.CELL - 1, pii.CELL, pii.CELL + 1, 2 * pii.CELL + 10, len(text) - 1, len(text)]
    df = spark.createDataFrame([(text, p) for p in places], "text STRING, p INT").withColumn("cells", pii.cells_of(F.col("text")))
    for r in df.select("p", pii._around(F.col("cells"), F.col("p"), 24, 24).alias("b"), pii._around(F.col("cells"), F.col("p"), 0, 2).alias("a")).collect():
        assert (r.b, r.a) == (text[max(0, r.p - 24) : r.p], text[r.p : r.p + 2])


def test_bands_come_from_all_labelled_documents(spark, monkeypatch):
    """4,000 good documents, more than the sample once held: the limit is the quantile of all of them."""
    measures = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("latin").alias("script"), F.lit(False).alias("base_failed"),
        F.lit(True).alias("kept"), (2 + F.col("id") / 4000).alias("chars_per_piece"), (3 + F.col("id") / 4000).alias("chars_per_byte_token"),
        F.lit(0.0).alias("fallback_share"),
    )
    labels = measures.select("doc_id", F.lit(1).alias("quality"))
    bands = quality.bands_of(measures, labels)
    exact = np.percentile(np.floor((2 + np.arange(4000) / 4000) * quality.STEPS) / quality.STEPS, 100 * quality.QUANTILE)
    assert bands["latin en"].least_piece == pytest.approx(exact, abs=1e-9)
    kept = measures.withColumn("kept", quality.within_bands(bands))
    assert kept.filter("not kept").count() == 20


def test_one_measuring_keeps_what_two_do(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = documents.select("doc_id", F.lit(1).alias("quality"))
    bands = quality.fitted_bands(documents, labels)
    assert len(bands) > len(quality.BANDS)
    two = quality.keep_good(documents, bands=bands, lang_col="lang")
    one = quality.keep_fitted(documents, labels)
    assert one.schema == two.schema and sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    verdicts = quality.quality(documents, bands=bands, lang_col="lang").filter("kept")
    assert verdicts.count() == one.count()


def test_quality_words_are_tokenised_together():
    scanner = quality.QualityScanner()
    vocab = scanner.words
    vocab.known.forget()
    calls = []

    class Counted:
        def encode_ordinary(self, text, encode=vocab.bytes.encode_ordinary):
            calls.append(text)
            return encode(text)

    words = [f"w{i}ord{i * i}," for i in range(1500)] + ["Größe", "(été)", "слово", "中文字", "'s", "don't", "<0x41>", "~#$"]
    odd = ["\u2581a", "a\u2581", "x\u00a0y", "\u00a0", "\u3000z", "e\u0301", "\u00b4", "\U0001f600", "\ud55c", "\u2003\u2003"]
    given, vocab.bytes = vocab.bytes, Counted()
    try:
        got = vocab.tokenised(words[:900] + odd + words[900:])
        assert got == vocab.one_by_one(words[:900] + odd + words[900:])
        calls.clear()
        ids, coarse = vocab.tokens([w.encode() for w in words])
        assert len(calls) <= 3
    finally:
        vocab.bytes = given
        vocab.known.forget()
    assert ids.tolist() == vocab.pieces.encode(" ".join(words)) and coarse == len(given.encode_ordinary(" " + " ".join(words)))
