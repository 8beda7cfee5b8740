"""Periodic runs of words, found on a grammar of the text.

A run is a stretch of words with smallest period q, at least EXPONENT periods and LEAST_LENGTH words long, that no word
beside it extends. Re-Pair turns the word ids of a text into rules X -> Y Z and a rest without repeated pairs; the rest
is closed by a balanced tree of seams. A run lies whole in the expansion of the lowest rule or seam that holds it, and
crosses its boundary there. So the runs across the boundary are worked out once for each rule, are carried to all places
where the rule occurs in the text, and intervals of one period that share a period or more are merged. What is cut off
at the edge of an expansion is part of a longer interval that a higher rule has.

Across a boundary at b, a run of four periods or more has two of them on one side; the word at b, for one, then equals
the one q further. Periods that pass three such comparisons are extended both ways word by word. A period is skipped
where two of its periods lie inside a run with a shorter one, for then it is not the smallest.

Re-Pair replaces, in each round, all pairs with more than half the occurrences of the text's most frequent one, more
frequent ones first where they overlap; rounds run for many texts at once, with words and rules of their own. A pair
that is replaced is one that occurs twice or more, so rounds end.

A null text has no words. Repeated rows each get their own row, an empty table gives an empty result, and only the id
and text columns are read, whatever the names of others. Texts are read whole and one by one into groups of
GROUP_WORDS words, a longer one alone, so a task holds one group or one text; nothing is shuffled, and a lost task is
run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from watchmere.llm.common import OUTPUT_ROWS, schema_of, small_batches, table, texts_of

LEAST_LENGTH = 6
EXPONENT = 4
GROUP_WORDS = 200_000
CANDIDATES = 1 << 20  # compared at a time
FOUND = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Grammar:
    """Rules and rest of a group of texts; ids of different texts differ, so no rule serves two texts."""

    def __init__(self, words: np.ndarray, text_of: np.ndarray, n_symbols: int):
        self.base = n_symbols
        self.lefts: list[np.ndarray] = []
        self.rights: list[np.ndarray] = []
        self.firsts: list[np.ndarray] = []
        self.n_rules = 0
        # Lengths of symbols; rules come after the words.
        self.length = np.ones(n_symbols, np.int64)
        done_symbols, done_places = [], []
        symbols, places = words, np.arange(len(words))
        while len(symbols) > 1:
            texts = text_of[places]
            symbols, places, texts, rest = self._round(symbols, places, texts)
            done_symbols.append(rest[0])
            done_places.append(rest[1])
        done_symbols.append(symbols)
        done_places.append(places)
        symbols, places = np.concatenate(done_symbols), np.concatenate(done_places)
        order = np.argsort(places)
        self.symbols, self.places = symbols[order], places[order]
        empty = np.empty(0, np.int64)
        self.left, self.right, self.first = (
            np.concatenate([empty, *a]) for a in (self.lefts, self.rights, self.firsts)
        )

    def _round(self, symbols, places, texts):
        """One round of replacing; texts without a repeated pair leave as `rest`."""
        often = np.bincount(symbols, minlength=1) > 1
        often = often[symbols]
        at = np.flatnonzero((texts[1:] == texts[:-1]) & often[1:] & often[:-1])
        width = self.base + self.n_rules + 1
        codes = symbols[at] * width + symbols[at + 1]
        # In a stretch of one symbol every other pair counts.
        equal = symbols[at] == symbols[at + 1]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (codes[1:] != codes[:-1]) | (at[1:] != at[:-1] + 1)
        since = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        counted = ~equal | (since % 2 == 0)
        pairs, which = np.unique(codes, return_inverse=True)
        count = np.bincount(which[counted], minlength=len(pairs))
        pair_text = np.empty(len(pairs), np.int64)
        pair_text[which] = texts[at]
        most = np.zeros(texts[-1] + 1, np.int64)
        np.maximum.at(most, pair_text, count)
        going = most > 1
        stays = going[texts]
        rest = symbols[~stays], places[~stays]
        if not going.any():
            return symbols[:0], places[:0], texts[:0], rest
        rank = np.empty(len(pairs), np.int64)
        rank[np.lexsort((pairs, count))] = np.arange(1, len(pairs) + 1)
        rank[(count < 2) | (2 * count <= most[pair_text])] = 0
        weight = np.zeros(len(symbols) + 1, np.int64)
        weight[at] = rank[which]
        # Neighbouring places with one rank are a stretch of one symbol; a stretch wins against both its neighbours.
        starts = np.flatnonzero(np.diff(weight, prepend=-1))
        ranks = weight[starts]
        around = np.concatenate([[0], ranks, [0]])
        wins = (ranks > around[:-2]) & (ranks > around[2:])
        sizes = np.diff(np.append(starts, len(weight)))
        offset = np.arange(len(weight)) - np.repeat(starts, sizes)
        chosen = np.flatnonzero(np.repeat(wins, sizes) & (offset % 2 == 0))
        pair_of = np.zeros(len(symbols) + 1, np.int64)
        pair_of[at] = which
        taken = np.bincount(pair_of[chosen], minlength=len(pairs))
        chosen = chosen[taken[pair_of[chosen]] > 1]
        new = np.flatnonzero(taken > 1)
        name = np.zeros(len(pairs), np.int64)
        name[new] = self.base + self.n_rules + np.arange(len(new))
        first = np.zeros(len(pairs), np.int64)
        first[pair_of[chosen[::-1]]] = places[chosen[::-1]]
        left, right = pairs[new] // width, pairs[new] % width
        self.lefts.append(left)
        self.rights.append(right)
        self.firsts.append(first[new])
        self.length = np.concatenate([self.length, self.length[left] + self.length[right]])
        self.n_rules += len(new)
        symbols = symbols.copy()
        symbols[chosen] = name[pair_of[chosen]]
        stays[chosen + 1] = False
        return symbols[stays], places[stays], texts[stays], rest

    def seams(self, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(low, boundary, high) in words of a balanced tree over the rest of each text."""
        n = len(self.symbols)
        ends = np.append(self.places, len(text_of))
        cuts = np.flatnonzero(np.diff(text_of[self.places], prepend=-1)) if n else np.empty(0, np.int64)
        begin, end = cuts, np.append(cuts, n)[1:]
        made = []
        while len(begin):
            large = (end - begin > 1) & (ends[end] - ends[begin] >= LEAST_LENGTH)
            begin, end = begin[large], end[large]
            middle = (begin + end) // 2
            made.append((ends[begin], ends[middle], ends[end]))
            begin, end = np.concatenate([begin, middle]), np.concatenate([middle, end])
        if not made:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(part) for part in zip(*made, strict=True))

    def occurrences(self, wanted: set[int]) -> dict[int, np.ndarray]:
        """All places in the text of the rules with these numbers."""
        lefts, rights = (self.left - self.base).tolist(), (self.right - self.base).tolist()
        above = [False] * self.n_rules
        for r in range(self.n_rules):
            y, z = lefts[r], rights[r]
            above[r] = r in wanted or (y >= 0 and above[y]) or (z >= 0 and above[z])
        held: dict[int, list[np.ndarray]] = {}
        own = np.flatnonzero(self.symbols >= self.base)
        own = own[np.argsort(self.symbols[own], kind="stable")]
        numbers, starts = np.unique(self.symbols[own] - self.base, return_index=True)
        for number, part in zip(numbers.tolist(), np.split(self.places[own], starts[1:]), strict=True):
            if above[number]:
                held[number] = [part]
        found = {}
        for r in range(self.n_rules - 1, -1, -1):
            if r not in held:
                continue
            here = np.concatenate(held.pop(r))
            if r in wanted:
                found[r] = here
            for side, shift in ((lefts[r], 0), (rights[r], self.length[self.left[r]])):
                if side >= 0 and above[side]:
                    held.setdefault(side, []).append(here + shift)
        return found


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """How many words the two agree in from their beginnings."""
    n = min(len(a), len(b))
    at, step = 0, 32
    while at < n:
        stop = min(n, at + step)
        differs = np.flatnonzero(a[at:stop] != b[at:stop])
        if len(differs):
            return at + int(differs[0])
        at, step = stop, 2 * step
    return n


def _periods(words, low, middle, high) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(boundary, period, side) that may be runs, boundaries in order and periods rising; side 1 is behind."""
    sizes = (high - low) // EXPONENT
    sums = np.cumsum(sizes)
    start = 0
    while start < len(low):
        stop = max(start + 1, int(np.searchsorted(sums, (sums[start - 1] if start else 0) + CANDIDATES, "right")))
        part = np.arange(start, stop)
        start = stop
        size = sizes[part]
        before = np.repeat(np.cumsum(size) - size, size)
        of = np.repeat(part, size)
        q = np.arange(len(of)) - before + 1
        b = middle[of]
        fits = np.flatnonzero(b + 2 * q <= high[of])
        for step in (lambda q: 0, lambda q: q - 1, lambda q: q // 2):
            here = b[fits] + step(q[fits])
            fits = fits[words[here] == words[here + q[fits]]]
        ahead = np.flatnonzero(b - 2 * q >= low[of])
        for step in (lambda q: 1, lambda q: q, lambda q: 1 + q // 2):
            here = b[ahead] - step(q[ahead])
            ahead = ahead[words[here] == words[here - q[ahead]]]
        both = np.concatenate([fits, ahead])
        side = np.concatenate([np.ones(len(fits), np.int64), np.zeros(len(ahead), np.int64)])
        order = np.argsort(both, kind="stable")
        yield of[both[order]], q[both[order]], side[order]


def crossing(words: np.ndarray, low: np.ndarray, middle: np.ndarray, high: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(number, start, end, period) of the runs inside low..high that touch or cross the boundary."""
    out: list[tuple[int, int, int, int]] = []
    for of, periods, sides in _periods(words, low, middle, high):
        last, found = -1, []
        for number, q, side in zip(of.tolist(), periods.tolist(), sides.tolist(), strict=True):
            if number != last:
                last, found = number, []
                lo, b, hi = int(low[number]), int(middle[number]), int(high[number])
            if side:
                if any(s <= b and b + 2 * q <= e for s, e in found):
                    continue
                behind = _alike(words[b : hi - q], words[b + q : hi])
                if behind < q:
                    continue
                start = b - _alike(words[lo:b][::-1], words[lo + q : b + q][::-1])
                end = b + q + behind
            else:
                if any(s <= b - 2 * q and b <= e for s, e in found):
                    continue
                ahead = _alike(words[lo + q : b][::-1], words[lo : b - q][::-1])
                if ahead < q:
                    continue
                start = b - q - ahead
                end = b + _alike(words[b:hi], words[b - q : hi - q])
            if end - start >= max(LEAST_LENGTH, EXPONENT * q):
                found.append((start, end))
                out.append((number, start, end, q))
    return out


def runs_of(words: np.ndarray, text_of: np.ndarray, n_symbols: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of a group of texts, by start and period."""
    grammar = Grammar(words, text_of, n_symbols)
    found: list[tuple[np.ndarray, int, int]] = []
    length = grammar.length[grammar.base :]
    large = np.flatnonzero(length >= LEAST_LENGTH)
    low = grammar.first[large]
    inside = crossing(words, low, low + grammar.length[grammar.left[large]], low + length[large])
    places = grammar.occurrences({int(large[i]) for i, _, _, _ in inside}) if inside else {}
    for i, start, end, q in inside:
        shift = places[int(large[i])] - low[i]
        found.append((np.stack([shift + start, shift + end], axis=1), q, 0))
    for _, start, end, q in crossing(words, *grammar.seams(text_of)):
        found.append((np.array([[start, end]]), q, 0))
    if not found:
        return []
    spans = np.concatenate([f[0] for f in found])
    period = np.repeat([f[1] for f in found], [len(f[0]) for f in found])
    order = np.lexsort((spans[:, 0], period))
    merged: list[list[int]] = []
    for (start, end), q in zip(spans[order].tolist(), period[order].tolist(), strict=True):
        if merged and merged[-1][2] == q and start <= merged[-1][1] - q:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, q])
    return sorted((s, e, q) for s, e, q in merged)


class Group:
    """Texts whose runs are looked for together."""

    def __init__(self) -> None:
        self.texts: list[list[bytes]] = []
        self.ids: list[np.ndarray] = []
        self.n_symbols = 0
        self.n_words = 0

    def add(self, text: bytes) -> None:
        words = text.split()
        known: dict[bytes, int] = {}
        for word in words:
            if word not in known:
                known[word] = len(known)
        self.ids.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)) + self.n_symbols)
        self.texts.append(words)
        self.n_symbols += len(known)
        self.n_words += len(words)

    def rows(self) -> Iterator[tuple[int, list[dict], bytes]]:
        """For each text its number of words, its runs, and the words that stay."""
        words = np.concatenate([np.empty(0, np.int64), *self.ids])
        sizes = [len(t) for t in self.texts]
        text_of = np.repeat(np.arange(len(sizes)), sizes)
        runs = runs_of(words, text_of, self.n_symbols) if self.n_words >= LEAST_LENGTH else []
        at = begin = 0
        for text in self.texts:
            past = begin + len(text)
            own = []
            while at < len(runs) and runs[at][0] < past:
                start, end, q = runs[at]
                own.append((start - begin, end - begin, q))
                at += 1
            if own:
                stays = np.ones(len(text), bool)
                for start, end, q in own:
                    stays[start + q : end] = False
                kept = [text[i] for i in np.flatnonzero(stays).tolist()]
            else:
                kept = text
            yield len(text), [{"start": s, "length": e - s, "period": q} for s, e, q in own], b" ".join(kept)
            begin = past


def find_runs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its words, all its runs by start and period, and the text with one period of each left.

    A word is left out if some run holds it behind the run's first period; the others are joined by one space.
    """
    kept = documents.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    schema = StructType([kept.schema.fields[0], *schema_of(FOUND).fields])
    arrow = to_arrow_schema(schema)

    def made(ids: pa.Array, group: Group) -> pa.RecordBatch:
        n_words, runs, texts = zip(*group.rows(), strict=True)
        columns = [ids.cast(arrow.field(0).type), pa.array(n_words, pa.int64()), pa.array(runs, arrow.field(2).type)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary()).cast(pa.string())], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, begin = Group(), 0
            for i, text in enumerate(texts_of(batch.column(1), True)):
                group.add(text)
                if group.n_words >= GROUP_WORDS or len(group.texts) >= OUTPUT_ROWS:
                    yield made(batch.column(0).slice(begin, len(group.texts)), group)
                    group, begin = Group(), i + 1
            if group.texts:
                yield made(batch.column(0).slice(begin), group)

    return small_batches(kept).mapInArrow(run, schema)


def with_planted_periods(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and text; in about a tenth of the texts, chosen by the id's checksum, the words behind some place repeat.

    Let h be the checksum and g = h div 10. Where h mod 10 = 0, the words from place a = g mod n on become repetitions
    of the first p = 1 + (n - a) div (3 + g mod 8) of them. Rows without an id stay as they are.
    """
    words = F.filter(F.split(text_col, "[ \t-\r]+"), lambda w: w != "")
    rows = documents.select(id_col, text_col, F.crc32(F.col(id_col).cast("string").cast("binary")).alias("__h"))
    chosen = F.when((F.col("__h") % 10 == 0) & F.col(text_col).isNotNull(), words)
    rows = rows.withColumn("__words", chosen).withColumn("__n", F.size("__words"))
    g = F.floor(F.col("__h") / 10)

    def whole(value: Column) -> Column:
        return value.cast("int")

    rows = rows.withColumn("__a", F.when(F.col("__n") > 0, whole(g % F.col("__n"))))
    rows = rows.withColumn("__p", whole(1 + F.floor((F.col("__n") - F.col("__a")) / (3 + g % 8))))
    times = whole(F.ceil((F.col("__n") - F.col("__a")) / F.col("__p")))
    period = F.slice("__words", F.col("__a") + 1, F.col("__p"))
    behind = F.slice(F.flatten(F.array_repeat(period, times)), F.lit(1), F.col("__n") - F.col("__a"))
    text = F.array_join(F.concat(F.slice("__words", F.lit(1), F.col("__a")), behind), " ")
    return rows.select(id_col, F.when(F.col("__a").isNotNull(), text).otherwise(F.col(text_col)).alias(text_col))


def op11_periodic_runs(spark: SparkSession, root: str) -> DataFrame:
    found = find_runs(with_planted_periods(table(spark, root, "documents")))
    # The longest; of equal ones the first, then the one with the smallest period.
    best = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("before"), (-r["period"]).alias("shorter")))
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.withColumn("__best", best)
    length, period = F.col("__best.length"), -F.col("__best.shorter")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("__best.before")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("1000 * __best.length div -__best.shorter").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
