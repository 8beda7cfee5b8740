"""Personal data: generators propose spans, boosted trees score them, thresholds choose; DataFrame functions only.

Generators of high recall propose spans that may overlap: the four base kinds, and numbers of other shapes. Rules decide
the base kinds. Boosted trees are fitted on format and context features of the candidates of all different texts; base
spans are the positive examples. Equal features are one weighted row. A threshold is calibrated on the candidates of a
quarter of the texts, which the trees have not seen. The trees become one SQL expression, so that scoring is a
projection of each row: no shuffle, no grouping, nothing that grows but the row itself.

A null text is empty and has no spans. Repeated rows each get their own row. An empty table gives an empty result.
With one kind of example alone there is nothing to learn, and only the rules find spans. Only the id and text columns
are read. Patterns never go back over a run of characters; places and overlaps with base spans come from sorted marks and
running sums, so a text of n matches takes n times the root of n copied integers at most. Only likely added spans are
compared with each other, pair by pair.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchmere.llm.common import table
from watchmere.session import spread

TREES, DEPTH = 12, 3
LEAST_PRECISION = 0.95
MOST_BINS = 1024
ROWS_PER_TASK = 100_000
AROUND = 24
CELL = 512

# The base kinds. Possessive quantifiers and look-behinds only keep the matcher from trying again inside
# a run in which it has just failed; what matches is the same.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE = tuple(PATTERNS)
# Further generators; what they propose is kept only if the trees say so.
PATTERNS |= {
    "number": r"(?:(?<![0-9])|\G)[0-9]++(?:[\x20.()/-]{1,2}+[0-9]++){1,8}+",
    "account": r"(?:(?<![A-Za-z0-9])|\G)[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}+",
    "address": r"(?:(?<![^\s@])|\G)[^\s@]++@[^\s@]++",
}
KINDS = tuple(PATTERNS)
NEEDS = {"email": "@", "address": "@", "phone": "+"}
HINTS = r"(?i)\b(tel|phone|mobile|call|fax|mail|contact|card|account|iban|ssn|ip|host|address)\b"


def _bound(value: Column, body) -> Column:
    """`body` of a value that is worked out once, however often `body` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine, zero: int) -> Column:
    """`combine` of each integer of an array with all before it.

    Adding to an array copies it, so the values are taken in blocks of about the root of their number, first inside
    the blocks and then over their ends: n values cost n times the root of n copied integers, not n times n.
    """
    start, none = F.lit(zero), F.array().cast("array<int>")

    def of(v: Column) -> Column:
        block = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v).cast("double"))).cast("int"))
        numbers = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")))

        def inside(i: Column) -> Column:
            return F.aggregate(
                F.slice(v, i * block + 1, block),
                none,
                lambda done, x: F.concat(done, F.array(combine(F.coalesce(F.try_element_at(done, F.lit(-1)), start), x))),
            )

        def along(blocks: Column) -> Column:
            heads = F.aggregate(
                blocks,
                F.array(start).cast("array<int>"),
                lambda done, x: F.concat(done, F.array(combine(F.element_at(done, -1), F.element_at(x, -1)))),
            )
            pairs = F.zip_with(blocks, F.slice(heads, 1, F.size(blocks)), lambda x, h: F.transform(x, lambda y: combine(h, y)))
            return F.flatten(pairs)

        return F.coalesce(_bound(F.transform(numbers, inside), along), none)

    return _bound(values, of)


def places(text: Column, pattern: str) -> Column:
    """Leftmost matches as (start, end, value); the pieces between them give the places, in characters."""
    between = F.split(text, pattern, -1)

    def of(found: Column) -> Column:
        gaps = F.slice(between, 1, F.size(found))
        ends = running(F.zip_with(gaps, found, lambda gap, value: F.length(gap) + F.length(value)), lambda x, y: x + y, 0)
        return F.zip_with(
            ends,
            found,
            lambda end, value: F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("value")),
        )

    return _bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


def uncovered(spans: Column, others: Column) -> Column:
    """Those of `spans` that overlap none of `others`, in their order.

    Starts of the others and ends of the spans are sorted together; a span is free if the furthest end of the others
    that start before its end does not pass its start.
    """
    marks = F.concat(
        F.transform(others, lambda o: F.struct(o["start"].alias("at"), F.lit(1).alias("kind"), o["end"].alias("reach"), F.lit(0).alias("start"), F.lit(-1).alias("i"))),
        F.transform(spans, lambda c, i: F.struct(c["end"].alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("reach"), c["start"].alias("start"), i.alias("i"))),
    )

    def of(sorted_marks: Column) -> Column:
        furthest = running(F.transform(sorted_marks, lambda m: m["reach"]), lambda x, y: F.greatest(x, y), -1)
        free = F.zip_with(sorted_marks, furthest, lambda m, far: F.when(far <= m["start"], m["i"]).otherwise(-1))
        return F.sort_array(F.filter(free, lambda i: i >= 0))

    kept = F.transform(_bound(F.sort_array(marks), of), lambda i: F.get(spans, i))
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), kept).otherwise(spans)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the checksum of a digit string is right."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """The rule of a base kind."""
    digits = digits_of(value)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(False)


def _proposal(kind: str):
    return lambda p: F.struct(
        F.lit(kind).alias("kind"),
        p["start"].alias("start"),
        p["end"].alias("end"),
        p["value"].alias("value"),
        holds(kind, p["value"]).alias("base"),
    )


def _of_kind(kind: str):
    return lambda c: c["kind"] == kind


def candidates(text: Column) -> Column:
    """All proposed spans of a text: (kind, start, end, value, base)."""
    parts = []
    for kind, pattern in PATTERNS.items():
        met = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike("[0-9]")
        spans = F.transform(places(text, pattern), _proposal(kind))
        parts.append(F.when(met, spans).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,value:string,base:boolean>>")))
    return F.concat(*parts)


def cells_of(text: Column) -> Column:
    """A text cut into cells of CELL characters, so that what stands around a place is found without counting up to it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CELL}}}"), F.lit(0))


def _around(cells: Column, place: Column, back: int, n: int) -> Column:
    """Up to `back` characters in front of a place, or the `n` behind it where `back` is 0."""
    at = F.floor(place / CELL).cast("int") - (1 if back else 0)
    pair = F.concat(F.coalesce(F.get(cells, at), F.lit("")), F.coalesce(F.get(cells, at + 1), F.lit("")))
    if not back:
        return F.substr(pair, place % CELL + 1, F.lit(n))
    offset = place % CELL + F.when(at >= 0, CELL).otherwise(0)
    return F.substr(pair, F.greatest(offset - back, F.lit(0)) + 1, F.least(offset, F.lit(back)))


def features(c: Column, cells: Column) -> dict[str, Column]:
    """Format of a candidate and what stands around it; the kind that proposed it is left out, so trees can generalise."""
    value, digits = c["value"], digits_of(c["value"])
    before, after = _around(cells, c["start"], AROUND, AROUND), _around(cells, c["end"], 0, 2)
    n = F.length(value)

    def truth(x: Column) -> Column:
        return F.when(x, 1.0).otherwise(0.0)

    def count(pattern: str) -> Column:
        return F.regexp_count(value, F.lit(pattern)).cast("double")

    return {
        "length": n.cast("double"),
        "digits": F.length(digits).cast("double"),
        "letters": count("[A-Za-z]"),
        "capitals": count("[A-Z]"),
        "dots": count(r"\."),
        "groups": count("[0-9]+"),
        "longest": F.array_max(F.transform(F.split(value, "[^0-9]+"), lambda p: F.length(p))).cast("double"),
        "spaces": count(r"\x20"),
        "plus": truth(value.startswith("+")),
        "at": count("@"),
        "host": truth(value.rlike(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$")),
        "small_parts": truth(holds("ip", F.regexp_replace(value, "[^0-9.]", ""))),
        "checksum": truth(F.length(digits).between(13, 19) & luhn(F.substr(digits, F.lit(1), F.lit(19)))),
        "hinted": truth(before.rlike(HINTS)),
        "after_plus": truth(before.rlike(r"\+$")),
        "after_word": truth(before.rlike(r"[A-Za-z0-9]$")),
        "before_word": truth(after.rlike(r"^[A-Za-z0-9]")),
        "after_number": truth(before.rlike(r"[0-9][\x20.,-]?$")),
    }


NAMES = (
    "length", "digits", "letters", "capitals", "dots", "groups", "longest", "spaces", "plus", "at", "host", "small_parts",
    "checksum", "hinted", "after_plus", "after_word", "before_word", "after_number",
)


@dataclass(frozen=True)
class Trees:
    """Fitted trees as nested tuples (feature, threshold, left, right) or leaf values, and the chosen threshold."""

    weights: tuple[float, ...]
    roots: tuple
    threshold: float

    def probability(self, values: dict[str, Column]) -> Column:
        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            at, limit, left, right = node
            return F.when(values[NAMES[at]] <= limit, walk(left)).otherwise(walk(right))

        margin = F.lit(0.0)
        for weight, root in zip(self.weights, self.roots, strict=True):
            margin = margin + weight * walk(root)
        return 1.0 / (1.0 + F.exp(-2.0 * margin))


def _node(node):
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return split.featureIndex(), float(split.threshold()), _node(node.leftChild()), _node(node.rightChild())


def _with_candidates(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = documents.select(F.col(id_col), text.alias("__text"))
    return named.withColumn("__found", candidates(F.col("__text"))).withColumn(
        "__cells", F.when(F.size("__found") > 0, cells_of(F.col("__text")))
    )


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def examples(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """(held_out, label, features, n): how many candidates of different texts have the label and the features."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    chosen = documents.select(text.alias("body")).filter(F.col("body").rlike("[0-9@]"))
    found = _with_candidates(chosen.select(F.xxhash64("body").alias("p"), "body"), "p", "body")
    marked = F.transform(
        "__found",
        lambda c: F.struct(c.alias("c"), *[f.alias(name) for name, f in features(c, F.col("__cells")).items()]),
    )
    place = ["kind", "start", "end"]
    spans = found.select("p", F.inline(marked)).select("p", "c.base", *[f"c.{x}" for x in place], *NAMES)
    spans = spans.distinct().persist()  # Copies of a text count once; only their candidates are shuffled.
    # Both kinds of span are laid into cells, and those that share a cell are compared: texts full of spans stay apart.
    cell = F.explode(F.sequence(F.floor(F.col("start") / CELL), F.floor((F.col("end") - 1) / CELL))).alias("cell")
    sure = spans.filter("base").select("p", F.col("start").alias("from"), F.col("end").alias("to"), cell)
    near = spans.select("p", *place, cell).join(sure, ["p", "cell"])
    near = near.filter("start < to AND from < end AND to - from <= end - start").select("p", *place).distinct()
    rows = spans.join(near.withColumn("label", F.lit(1.0)), ["p", *place], "left").fillna(0.0, ["label"])
    held_out = (F.pmod("p", F.lit(4)) == 0).alias("held_out")
    counted = rows.groupBy(held_out, "label", *NAMES).agg(F.count("*").cast("double").alias("n")).persist()
    counted.count()
    spans.unpersist()
    return counted


def train(documents: DataFrame, text_col: str = "text") -> Trees | None:
    """Trees and threshold from the candidates of all documents, or None where they are of one kind."""
    rows = examples(documents, text_col)
    fit = rows.filter("not held_out")
    kinds, n = fit.agg(F.countDistinct("label"), F.count("*")).first()
    if kinds < 2:
        rows.unpersist()
        return None
    dealt = spread(fit, n, ROWS_PER_TASK).sortWithinPartitions(*NAMES, "label")
    dealt = VectorAssembler(inputCols=list(NAMES), outputCol="features").transform(dealt).select("label", "features", "n")
    # With bins by the square of the rows at least, Spark ML takes its splits from all rows and not from a sample.
    bins = max(MOST_BINS, math.isqrt(n) + 1)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1, maxBins=bins, weightCol="n").fit(dealt)
    trees = Trees(
        tuple(model.treeWeights), tuple(_node(t._call_java("rootNode")) for t in model.trees), 0.5
    )
    chance = trees.probability({name: F.col(name) for name in NAMES})
    scored = rows.filter("held_out").select("label", "n", F.floor(chance * 20).alias("cell"))
    cells = scored.groupBy("cell").agg(F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("good"))
    cells = {r.cell: (r.n, r.good) for r in cells.collect()}
    rows.unpersist()
    threshold, n, good = 0.95, 0, 0.0
    for cell in range(20, 9, -1):
        n, good = n + cells.get(cell, (0, 0.0))[0], good + cells.get(cell, (0, 0.0))[1]
        if n and good / n < LEAST_PRECISION:
            break
        threshold = min(threshold, cell / 20)
    return Trees(trees.weights, trees.roots, threshold)


def find_pii(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: Trees | None = None) -> DataFrame:
    """One row per document: (id, text, base, added), both spans as (kind, start, end), added ones with their score.

    Added spans overlap no base span, and of those that overlap each other the likeliest stays.
    """
    trees = trees or train(documents, text_col)
    found = _with_candidates(documents, id_col, text_col)
    found = found.withColumn("__base", F.filter("__found", lambda c: c["base"]))
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    if trees is None:
        return found.select(id_col, F.col("__text").alias("text"), F.col("__base").alias("base"), none.alias("added"))
    found = found.withColumn("__open", uncovered(F.filter("__found", lambda c: ~c["base"]), F.col("__base")))
    scored = F.transform(
        "__open",
        lambda c: F.struct(
            c["kind"].alias("kind"),
            c["start"].alias("start"),
            c["end"].alias("end"),
            trees.probability(features(c, F.col("__cells"))).alias("score"),
        ),
    )
    found = found.withColumn("__scored", F.when(F.size("__open") > 0, scored).otherwise(none))
    found = found.withColumn("__likely", F.filter("__scored", lambda c: c["score"] >= trees.threshold))

    def better(a: Column, b: Column) -> Column:
        return F.struct(-a["score"], a["start"], -a["end"], a["kind"]) < F.struct(-b["score"], b["start"], -b["end"], b["kind"])

    added = F.filter("__likely", lambda c: ~F.exists("__likely", lambda o: _overlaps(c, o) & better(o, c)))
    return found.select(id_col, F.col("__text").alias("text"), F.col("__base").alias("base"), added.alias("added"))


def redact(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: Trees | None = None) -> DataFrame:
    """(id, text) with every span replaced by its kind in brackets; base spans that overlap are replaced as one."""
    found = find_pii(documents, id_col, text_col, trees)
    plain = F.concat(
        F.transform("base", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))),
        F.transform("added", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))),
    )
    start = F.struct(F.lit("").alias("made"), F.lit(0).alias("at"))

    def further(done: Column, span: Column) -> Column:
        lead = F.substr("text", done["at"] + 1, F.greatest(span["start"] - done["at"], F.lit(0)))
        mark = F.when(span["start"] >= done["at"], F.concat(F.lit("["), span["kind"], F.lit("]"))).otherwise("")
        return F.struct(F.concat(done["made"], lead, mark).alias("made"), F.greatest(done["at"], span["end"]).alias("at"))

    whole = F.aggregate(F.array_sort(plain), start, further, lambda done: F.concat(done["made"], F.substr("text", done["at"] + 1, F.length("text"))))
    return found.select(id_col, whole.alias("text"))


def op9_pii(spark: SparkSession, root: str) -> DataFrame:
    found = find_pii(table(spark, root, "documents"))

    def listed(kinds: tuple[str, ...]) -> Column:
        """Spans by kind as listed, then by start."""
        every = [F.filter("base" if k in BASE else "added", _of_kind(k)) for k in kinds]
        both = [F.filter("added", _of_kind(k)) for k in kinds if k in BASE]
        written = [F.transform(s, lambda c: F.concat_ws(":", c["kind"], c["start"], c["end"])) for s in every]
        added = [F.transform(s, lambda c: F.concat_ws(":", F.lit("model"), c["start"], c["end"])) for s in both]
        return F.array_join(F.concat(*written, *(added if len(kinds) > len(BASE) else [])), ",")

    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(BASE), 256).alias("base_sha256"), listed(KINDS).alias("spans"))
