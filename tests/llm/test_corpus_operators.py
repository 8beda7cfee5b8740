"""Operators that compare texts with each other, against plain Python on small tables."""

import collections
import hashlib
import math
import random

import pytest

import corpus_pipeline
from tests.llm.conftest import ROOT, odd_documents
from watchmere.llm import chat_format, decontaminate, line_dedup, near_duplicates, suffix_dedup
from watchmere.llm.common import words_of
from watchmere.llm.components import components
from watchmere.llm.queries import QUERIES


def removed_bytes(texts, window):
    count = collections.Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t) + 1)
        for i in range(len(t) - window + 1):
            if count[t[i : i + window]] > 1:
                mark[i : i + window] = b"\x01" * window
        kept = bytes(x for x, m in zip(t, mark, strict=False) if not m)
        runs = sum(1 for i in range(len(t)) if mark[i] and (i == 0 or not mark[i - 1]))
        out.append((len(t), sum(mark), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group, piece", [(2, suffix_dedup.PIECE), (50_000, suffix_dedup.PIECE), (50_000, 25), (2, 64)])
def test_suffix_dedup(spark, group, piece):
    rnd = random.Random(8)

    def noise(n):
        return "".join(rnd.choice("ab\x00é ") for _ in range(n))

    shared = [noise(rnd.randrange(20, 90)) for _ in range(5)]
    texts = [None, "", "short", "ab" * 60, "ab" * 60, "a" * 100]
    for _ in range(60):
        texts.append("".join(noise(rnd.randrange(30)) + rnd.choice(shared)[rnd.randrange(5) :] for _ in range(4)))
    texts.append((6, texts[6]))
    df = odd_documents(spark, texts)
    plain = [(r.text or "").encode() for r in df.collect()]
    got = suffix_dedup.remove_repeats(df, window=24, kmer=8, group=group, piece=piece).collect()
    want = collections.Counter(zip([r.doc_id for r in df.collect()], removed_bytes(plain, 24), strict=True))
    assert collections.Counter((r.doc_id, tuple(r)[1:]) for r in got) == want
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_suffix_dedup_query(spark, given):
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op5_suffix_dedup"](spark, ROOT).collect()}
    assert [got[d] for d, _ in given] == removed_bytes([(t or "").encode() for _, t in given], 200)


def shingles(text):
    words = words_of((text or "").encode())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_classes(rows):
    """(id, class, links) by all pairs of different texts."""
    texts = sorted({t or "" for _, t in rows})
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(texts)
    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and common >= 0.8 * len(sets[i] | sets[j]) - 1e-6:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    at = {t: i for i, t in enumerate(texts)}
    least = {}
    for d, t in rows:
        r = find(at[t or ""])
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return [(d, least[find(at[t or ""])], links[at[t or ""]]) for d, t in rows]


@pytest.mark.parametrize("block", [4, 1024])
def test_jaccard_join(spark, block):
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rnd.choice(vocabulary) for _ in range(60)]
    texts = [None, "", "!!", "??", "few words", "Few words.", "few words", (None, "few words")]
    for i in range(40):
        copy = list(base)
        for _ in range(rnd.randrange(3)):
            copy[rnd.randrange(60)] = rnd.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += [" ".join(rnd.choice(vocabulary) for _ in range(30)) for _ in range(30)]
    df = odd_documents(spark, texts)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = near_duplicates.near_duplicates(df, block=block).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == sorted(brute_classes(rows), key=str)
    kept = near_duplicates.keep_one(df)
    assert kept.columns == df.columns
    assert kept.count() == len({c for _, c, _ in brute_classes(rows)})
    assert near_duplicates.near_duplicates(df.limit(0)).count() == 0 and near_duplicates.keep_one(df.limit(0)).count() == 0


def test_jaccard_query(spark, given):
    got = QUERIES["op6_jaccard_join"](spark, ROOT).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == sorted(brute_classes(given))


def test_prefixes_shorten_to_the_target():
    depth = near_duplicates.prefix_depth(0.8)
    assert 1 - (1 - 0.8**depth) ** near_duplicates.TREES >= near_duplicates.TARGET
    assert 1 - (1 - 0.8 ** (depth + 1)) ** near_duplicates.TREES < near_duplicates.TARGET


def test_crowded_prefixes_shorten_one_by_one():
    forest = near_duplicates.Forest(4)
    free = forest.depths({})
    assert free == {}
    few = forest.depths({tree: [2000, 900, 800, 700, 600] for tree in range(5)})
    assert set(few.values()) == {forest.deepest}
    sizes = {tree: [5000 - tree, 4000, 3000, 2000 if tree % 2 else 20, 10] for tree in range(forest.trees)}
    many = forest.depths(sizes)
    reached = sum(forest.weight(d) for d in many.values())
    assert 1 - math.exp(-reached) >= forest.target
    assert min(many.values()) == forest.shallow < max(many.values())
    # Every crowded tree at its shortest is the most that can be asked for.
    assert set(near_duplicates.Forest(4, target=1 - 1e-9).depths(sizes).values()) == {forest.shallow}


@pytest.mark.parametrize("crowd", [3, 20])
def test_crowded_places_lose_no_link(spark, crowd):
    rnd = random.Random(12)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = []
    for _ in range(3):
        base = [rnd.choice(vocabulary) for _ in range(90)]
        for _ in range(50):
            copy = list(base)
            for _ in range(rnd.randrange(4)):
                copy[rnd.randrange(90)] = rnd.choice(vocabulary)
            texts.append(" ".join(copy))
    # A common opening that brings texts together which are not alike.
    opening = [rnd.choice(vocabulary) for _ in range(40)]
    texts += [" ".join(opening + [rnd.choice(vocabulary) for _ in range(25)]) for _ in range(60)]
    df = odd_documents(spark, texts)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = near_duplicates.near_duplicates(df, block=16, crowd=crowd).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == sorted(brute_classes(rows), key=str)


def test_prefixes_are_counted_over_all_tasks(spark):
    forest = near_duplicates.Forest(4)
    rnd = random.Random(3)
    rows = [(rnd.randrange(2), rnd.randrange(3), rnd.choice([0, 1, 5 << 30, (5 << 30) + 1]), rnd.randrange(10**9)) for _ in range(4000)]
    frame = spark.createDataFrame(rows, "tree int, head long, tail long, hi long").repartition(7)
    got = {(r.tree, r.head, r.depth, r.prefix): r.n for r in near_duplicates.trie_nodes(frame, forest).collect()}
    wanted = collections.Counter(
        (t, h, d, tail >> (forest.bits * (forest.deepest - d))) for t, h, tail, _ in rows for d in range(5, 9)
    )
    assert got == wanted


def test_components(spark):
    rnd = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for node in near:
        seen, todo = {node}, [node]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[node] == min(seen)
    assert set(got) == set(near)


def brute_lines(rows, runs=None):
    """Cleaned texts: without the lines of repeated runs, and of short chunks of lines that came before."""
    gone = (runs or brute_least_runs)(rows)
    distinct = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    first = {}
    for d, t in distinct:
        lines = (t or "").encode().split(b"\n")
        for start, past in line_dedup.chunks_of(lines):
            words = sum(len(x.split()) for x in lines[start:past])
            if past - start >= line_dedup.LEAST_LINES and line_dedup.LEAST_WORDS <= words < line_dedup.LONG_LINE:
                seen = first.setdefault(tuple(lines[start:past]), (d, t, past))
                if t is not None and (seen[:2] != (d, t) or start >= seen[2]):
                    gone[d, t] |= set(range(start, past))
    out = []
    for d, t in rows:
        out.append((d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d, t])))
    return out


def brute_least_runs(rows):
    """As `brute_runs`, by the shortest runs alone that end, or begin, with each line."""
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = {}, {}
    for d, t in order:
        lines = (t or "").split("\n")
        words = [len(x.split()) for x in lines]
        gone = set()
        least = set()
        for turned in (False, True):
            sizes = words[::-1] if turned else words
            start = held = 0
            for i, n in enumerate(sizes):
                held += n
                while held - sizes[start] >= line_dedup.LONG_LINE:
                    held -= sizes[start]
                    start += 1
                if held >= line_dedup.LONG_LINE:
                    least.add((len(lines) - i - 1, len(lines) - start) if turned else (start, i + 1))
        for a, b in sorted(least):
            earlier = seen.setdefault(tuple(lines[a:b]), (d, t, b))
            if earlier[:2] != (d, t) or earlier[2] <= a:
                gone |= set(range(a, b))
        out[d, t] = gone
    return out


def test_line_dedup(spark, given):
    rnd = random.Random(9)
    passage = "\n".join(" ".join(rnd.choice("abcdefgh") * 3 for _ in range(12)) for _ in range(8))
    texts = [None, "", "\n\n", "common line", "common line\nother " + "w " * 60, "start one\n" + passage + "\nend", "begin two\nmore\n" + passage, passage + "\n" + passage]
    texts += [(None, passage), (5, "start one\n" + passage + "\nend")]
    df = odd_documents(spark, texts)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    cleaned = line_dedup.remove_repeats(df)
    assert cleaned.columns == [*df.columns, "__lines", "__lines_cut"]
    assert sorted(((r.doc_id, r.text) for r in cleaned.collect()), key=str) == sorted(brute_lines(rows), key=str)
    assert line_dedup.remove_repeats(df.limit(0)).count() == 0
    got = {r.doc_id: r.text for r in QUERIES["op7_line_dedup"](spark, ROOT).collect()}
    assert got == dict(brute_lines(given))
    assert sum(map(len, brute_least_runs(given).values())) > 20


def brute_runs(rows):
    """Lines of each text that lie in a run of 50 words or more which an earlier text has, or the same one before it."""
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), {}
    for d, t in order:
        lines = (t or "").split("\n")
        gone, own = set(), {}
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = tuple(lines[a:b])
                if sum(len(x.split()) for x in run) < line_dedup.LONG_LINE:
                    continue
                if run in seen or own.setdefault(run, b) <= a:
                    gone |= set(range(a, b))
        seen |= set(own)
        out[d, t] = gone
    return out


def test_every_repeated_run_of_lines_goes(spark):
    rnd = random.Random(12)

    def line(least, most):
        return " ".join(rnd.choice("abcdefgh") * 3 + str(rnd.randrange(999)) for _ in range(rnd.randrange(least, most)))

    passages = [[line(*size) for _ in range(n)] for size, n in [((1, 9), 16), ((9, 14), 6), ((20, 40), 3), ((49, 53), 1), ((0, 3), 60)]]
    texts = ["same ten words in each of the many lines here\n" * 40, "", None]
    for _ in range(50):
        parts = []
        for _ in range(rnd.randrange(1, 4)):
            chosen = rnd.choice(passages)
            cut = rnd.randrange(3)
            parts += [line(0, 12) for _ in range(rnd.randrange(3))] + chosen[cut : len(chosen) - rnd.randrange(3)]
        texts.append("\n".join([*parts, line(1, 5)]))
    df = odd_documents(spark, texts)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sum(map(len, brute_runs(rows).values())) > 500
    assert brute_runs(rows) == brute_least_runs(rows)
    cleaned = line_dedup.remove_repeats(df).collect()
    got = {r.doc_id: r for r in cleaned}
    assert sorted(((r.doc_id, r.text) for r in cleaned), key=str) == sorted(brute_lines(rows, brute_runs), key=str)
    assert got[0].text.count("same ten") == 5


def test_equal_digests_are_not_enough(spark):
    """With digests of one byte many runs only seem to be equal: what goes has the bytes of the first copy."""
    rnd = random.Random(15)
    passage = [" ".join(rnd.choice("abcdefgh") * 3 + str(rnd.randrange(999)) for _ in range(14)) for _ in range(9)]
    texts = []
    for _ in range(80):
        own = [" ".join(rnd.choice("ijklmnop") * 3 + str(rnd.randrange(9999)) for _ in range(rnd.randrange(9, 60))) for _ in range(12)]
        texts.append("\n".join(own + passage * (rnd.randrange(8) == 0)))
    df = odd_documents(spark, texts)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    due = dict(brute_lines(rows, brute_runs))
    places = line_dedup.repeated_runs(df, "doc_id", "text", 1)
    assert places.count() > 300
    for r in line_dedup.remove_repeats(df, size=1).collect():
        left = collections.Counter(r.text.split("\n"))
        left.subtract(due[r.doc_id].split("\n"))
        assert min(left.values()) >= 0
    whole = line_dedup.remove_repeats(df).collect()
    assert {r.doc_id: r.text for r in whole} == due and sum(r["__lines_cut"] for r in whole) > 20


def test_lines_that_differ_from_the_first_copy_stay():
    lines = [(f"line{i} " * 20).strip().encode() for i in range(12)]
    text = b"\n".join(lines)
    assert line_dedup._cut(text, [{"start": 2, "past": 8, "body": b"\n".join(lines[2:8])}]) == (b"\n".join(lines[:2] + lines[8:]), 12, 6)
    other = [*lines[2:5], b"another", *lines[6:8]]
    assert line_dedup._cut(text, [{"start": 2, "past": 8, "body": b"\n".join(other)}]) == (b"\n".join(lines[:2] + lines[5:]), 12, 3)


def test_stretches_cover_all_places_at_most_twice():
    rnd = random.Random(16)
    for _ in range(200):
        places = []
        for _ in range(rnd.randrange(1, 30)):
            start = rnd.randrange(60)
            first = {"__id": rnd.randrange(3), "__print": 1, "start": start + rnd.randrange(3)}
            places.append({"start": start, "past": start + rnd.randrange(1, 9), "first": first})
        given = {i for p in places for i in range(p["start"], p["past"])}
        covered = collections.Counter(i for a, b, _ in line_dedup._stretches(places) for i in range(a, b))
        assert set(covered) == given and max(covered.values()) <= 2
        same = {(p["first"]["__id"], 1, p["start"] - p["first"]["start"]) for p in places}
        assert {key for _, _, key in line_dedup._stretches(places)} <= same


def test_blank_lines_are_read_once():
    text = b"w " * 60 + b"\n" * 200_000
    found = line_dedup.counted_runs(text)
    assert len(found) == 200_001
    assert found[-1][:2] == (0, 200_001)


def test_chunk_boundaries_survive_inserted_lines():
    rnd = random.Random(1)
    lines = [" ".join(rnd.choice("abcdefgh") * 4 for _ in range(9)).encode() for _ in range(300)]
    whole = {b"\n".join(lines[a:b]) for a, b in line_dedup.chunks_of(lines)}
    shifted = [b"new", *lines[:150], b"other", *lines[150:]]
    moved = {b"\n".join(shifted[a:b]) for a, b in line_dedup.chunks_of(shifted)}
    assert len(whole - moved) <= 3


def brute_hits(documents, items, size):
    out = []
    held = []
    for item, text in items:
        words = words_of((text or "").encode())
        n = min(size, len(words))
        held.append((str(item), {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()))
    for d, t in documents:
        words = words_of((t or "").encode())
        hit, found = set(), set()
        for item, windows in held:
            for window in windows:
                for i in range(len(words) - len(window) + 1):
                    if tuple(words[i : i + len(window)]) == window:
                        hit |= set(range(i, i + len(window)))
                        found.add(item)
        out.append((d, len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words)))
    return out


@pytest.mark.parametrize("most_bytes", [1 << 20, -1])
def test_decontamination(spark, most_bytes):
    items = [(1, "one two three four five six"), (2, "Two, three"), (3, None), (4, "..."), (10, "four five six seven one two")]
    texts = [None, "", "zero one two three four", "two THREE two three", "x " * 90 + "two three", "one two three four five six", "one two three four five six", (None, "two three")]
    df = odd_documents(spark, texts)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(df, benchmark, size=4, most_bytes=most_bytes).collect()
    want = brute_hits([(r.doc_id, r.text) for r in df.collect()], items, 4)
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert decontaminate.contamination(df, benchmark.limit(0), most_bytes=most_bytes).filter("contaminated").count() == 0
    kept = decontaminate.remove_contaminated(df, benchmark)
    assert kept.columns == df.columns
    assert decontaminate.contamination(df.limit(0), benchmark).count() == 0


@pytest.mark.parametrize("most_bytes", [1 << 20, -1])
def test_cut_spans(spark, most_bytes):
    long = " ".join(f"w{i}" for i in range(20))
    items = [(1, long), (2, "Two, three"), (3, None), (None, "five"), (4, f"{long} {long}")]
    texts = [None, "", "two", f"a {long.upper()}! b five", f"{long} w0 w1", "Two three two", "Two three two", (None, "four five")]
    df = odd_documents(spark, texts)
    got = decontaminate.cut_spans(df, spark.createDataFrame(items, "item_id long, text string"), most_bytes=most_bytes)
    want = collections.Counter()
    windows = [tuple(long.split()[i : i + 13]) for i in range(8)] + [("two", "three"), ("five",)]
    windows += [tuple((long + " " + long).split()[i : i + 13]) for i in range(28)]
    for r in df.collect():
        words = [w.decode() for w in words_of((r.text or "").encode())]
        hit = {i + j for w in windows for i in range(len(words)) if tuple(words[i : i + len(w)]) == w for j in range(len(w))}
        want[r.doc_id, " ".join(w for i, w in enumerate(words) if i not in hit), len(hit)] += 1
    assert collections.Counter(tuple(r) for r in got.collect()) == want and max(n for _, _, n in want) == 22
    assert decontaminate.cut_spans(df.limit(0), spark.createDataFrame(items, "item_id long, text string"), most_bytes=most_bytes).count() == 0


@pytest.mark.parametrize("most_bytes", [1 << 20, -1])
def test_items_without_an_id_count(spark, most_bytes):
    df = odd_documents(spark, ["one two three four", "nothing of it"])
    benchmark = spark.createDataFrame([(None, "two three four"), (2, "three")], "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.contamination(df, benchmark, size=4, most_bytes=most_bytes).collect()}
    assert got == {0: (4, 3, ["2"], True), 1: (3, 0, [], False)}


def conversation_digests(rows):
    groups = collections.defaultdict(list)
    for c, turn, role, text in rows:
        groups[c].append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for c, turns in groups.items():
        turns.sort()
        targets = "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), "".join(f"{r}\n{t}\n" for _, r, t in turns), targets)
    return out


def test_chat_windows(spark):
    rnd = random.Random(3)
    rows = []
    for c in [*range(15), None]:
        for turn in range(rnd.choice([1, 2, 5, 60, 600])):
            role = rnd.choice(["user", "assistant", "assistant", "system", None, "we\nird<"])
            text = rnd.choice([None, "", "\\", "\\\\l", "<turn>a</turn>\n", "\\l<\\e\n", "x " * rnd.randrange(300), "é<"])
            rows.append((c, rnd.choice([turn, turn, None, 5]), role, text, "extra", 1))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string, fresh int")
    made = chat_format.windows(df, budget=200, history=40).collect()
    read = chat_format.read_back(spark.createDataFrame(made, chat_format.windows(df).schema)).collect()
    assert {r.conv_id: (r.n_turns, r.turns, r.targets) for r in read} == conversation_digests([r[:4] for r in rows])
    for r in made:
        turns = r.formatted.count(chat_format.OPEN)
        fresh = turns - r.repeated
        # Within budget, unless one turn alone is longer than a cell.
        assert r.tokens <= 200 or fresh == 1 or r.formatted.startswith("<turn>system")
        assert all(r.formatted[s.end :].startswith(chat_format.CLOSE) for s in r.loss)
    assert chat_format.windows(df.limit(0)).count() == 0


def test_chat_query(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{ROOT}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = r"\### Assistant: </turn> ok"
    want = conversation_digests([*given, (-7, 0, "user", said), (-7, 1, "assistant", said)])

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in QUERIES["op8_chat_format"](spark, ROOT).collect()}
    assert got == {c: (n, sha(t), len(a), sha(a)) for c, (n, t, a) in want.items()}


def test_pipeline_stages(spark, given):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "near duplicates", "decontamination", "bpe encoding"]
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    columns = docs.columns
    rows = given
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, ROOT)
        assert docs.columns == columns
        after = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "line dedup":
            assert sorted(after) == sorted(brute_lines(rows))
        elif name == "near duplicates":
            firsts = {c for _, c, _ in brute_classes(rows)}
            assert sorted(after) == sorted(r for r in rows if r[0] in firsts)
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").select("item_id", "text").collect()]
            bad = {d for d, _, _, _, c in brute_hits(rows, items, 13) if c}
            assert sorted(after) == sorted(r for r in rows if r[0] not in bad)
        rows = after
    assert corpus_pipeline.run(spark, ROOT).count() == len(rows)


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_empty_and_odd_tables(spark, stage):
    df = odd_documents(spark, [None, "", "x", "same", "same", (None, None), (3, "same")])
    _, work = corpus_pipeline.STAGES[stage]
    out = work(spark, df, ROOT)
    assert out.count() <= df.count()
    assert work(spark, df.limit(0), ROOT).count() == 0
