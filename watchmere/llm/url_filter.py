"""URL filter: fixed rules of hosts and paths first, then association rules of URL tokens mined by FP-growth.

A URL falls into tokens: each label of its host, each end of the host of two labels or more, each part of its path and
each name in its query, numbers written as `0` but in ends of hosts. FP-growth finds the token combinations that labelled pages have in
common with a verdict. A rule is kept if it has the support and the confidence asked for, lifts its verdict over the
verdict's own share, and no rule of fewer of its tokens is as sure; rules stand in an inverted index under their rarest
token. A page is judged by the surest rule all of whose tokens it has; by none, it is allowed.

Pages are labelled by `labels`, where page_id is a doc_id: low quality or toxic text is to be blocked. The rules are
fitted on all labelled pages, over all tokens that can have the support; every rule that meets the conditions is used.
Tokens that stand on the very same labelled pages are mined as one and told apart again in the rules, so repeated
shapes of URLs do not multiply combinations. Up to INDEXED rules are a constant of the plan; more are joined.

A null URL, or one without `://`, has no host, path or tokens; it is allowed unless a rule says otherwise. Pages without
an id or a label take no part in fitting. With no labelled pages, or one verdict only, there are no mined rules.
Repeated rows each get their own row; an empty table gives an empty result; other columns are not read. Matching against
INDEXED rules or fewer needs no shuffle. DataFrame functions only.
"""

from __future__ import annotations

import json

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchmere.llm.common import table

# Host, path and verdict of the rules that come first.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
DEFAULT = "allow"
LEAST_PAGES = 25
LEAST_SUPPORT = 0.002
LEAST_CONFIDENCE = 0.6
LEAST_LIFT = 1.3
INDEXED = 500
VERDICTS = ("=allow", "=block")
INDEX = "map<string,array<struct<confidence:double,support:double,name:string,verdict:string,tokens:array<string>>>>"


def _rest(url: Column) -> Column:
    """What stands behind the first `://`; empty where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def _folded(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(pages: DataFrame, columns: list[str], url_col: str = "url") -> DataFrame:
    """The named columns, then host, path and tokens."""
    rest = _rest(F.coalesce(F.col(url_col), F.lit("")))
    rows = pages.select(
        *columns,
        _folded(F.regexp_extract(rest, "^[^/?#]*", 0)).alias("host"),
        F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1).alias("path"),
        F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1).alias("__query"),
    )
    labels = F.filter(F.split("host", r"\."), lambda x: x != "")
    names_only = F.filter(F.split(F.regexp_replace("host", "[0-9]+", "0"), r"\."), lambda x: x != "")
    n = F.size(labels)
    ends = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n), ".")))
    parts = F.filter(F.split(F.regexp_replace("path", "[0-9]+", "0"), "[/.]"), lambda x: x != "")
    names = F.filter(F.transform(F.split("__query", "&"), lambda x: F.substring_index(x, "=", 1)), lambda x: x != "")

    def marked(mark: str, values: Column) -> Column:
        return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.concat(F.lit(mark), x))

    tokens = F.concat(marked("label:", names_only), marked("host:", ends), marked("path:", parts), marked("query:", names))
    return rows.select(*columns, "host", "path", F.array_distinct(tokens).alias("tokens"))


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does; rules of one length in order of their text."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, said in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, verdict) of the pages that have a label."""
    bad = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0))
    known = labels.filter(F.col("quality").isNotNull() | F.col("toxic").isNotNull()).groupBy("doc_id").agg(bad.alias("bad"))
    verdict = F.when(F.col("bad") == 1, "block").otherwise("allow")
    return pages.select("page_id", "url").join(known, F.col("page_id") == F.col("doc_id")).select("url", verdict.alias("verdict"))


def _without_longer(rules: DataFrame) -> DataFrame:
    """Rules without those that stay as sure if some of their tokens are left out."""
    shorter = F.transform("tokens", lambda t: F.array_join(F.array_remove("tokens", t), " "))
    parts = rules.select("tokens", "said", "confidence", F.explode(shorter).alias("name"))
    named = rules.select("said", F.array_join("tokens", " ").alias("name"), F.col("confidence").alias("__sure"))
    longer = parts.join(named, ["said", "name"]).filter(F.col("__sure") >= F.col("confidence"))
    left = rules.join(longer.select("tokens", "said").distinct(), ["tokens", "said"], "left_anti").persist()
    # What a rule that went would have removed is removed by a part of it that stayed.
    parts = left.select("tokens", "said", "confidence", F.explode("tokens").alias("first"))
    named = left.select(
        "said", F.col("tokens")[0].alias("first"), F.col("tokens").alias("__held"), F.col("confidence").alias("__sure")
    )
    inside = F.forall("__held", lambda t: F.array_contains("tokens", t)) & (F.size("__held") < F.size("tokens"))
    longer = parts.join(named, ["said", "first"]).filter((F.col("__sure") >= F.col("confidence")) & inside)
    return left.join(longer.select("tokens", "said").distinct(), ["tokens", "said"], "left_anti")


def _alike(pages: DataFrame, seen: DataFrame) -> DataFrame:
    """(token, as) of the tokens of `seen`: `as` is the smallest token that stands on the very same pages."""
    held = pages.join(F.broadcast(seen.select("token")), "token").groupBy("page").agg(F.array_sort(F.collect_list("token")).alias("held"))
    same = held.groupBy("held").agg(F.count("*").alias("n"))
    pairs = same.select("n", "held", F.posexplode("held").alias("i", "as"))
    pairs = pairs.select("n", "as", F.explode(F.slice("held", F.col("i") + 2, F.size("held"))).alias("token"))
    both = pairs.groupBy("as", "token").agg(F.sum("n").alias("n"))
    one = both.join(seen, ["token", "n"]).join(seen.select(F.col("token").alias("as"), "n"), ["as", "n"])
    least = one.groupBy("token").agg(F.min("as").alias("as"))
    return seen.join(least, "token", "left").select("token", F.coalesce("as", "token").alias("as"), "n")


def found_rules(
    labelled: DataFrame,
    least_pages: int = LEAST_PAGES,
    least_support: float = LEAST_SUPPORT,
    least_confidence: float = LEAST_CONFIDENCE,
    least_lift: float = LEAST_LIFT,
) -> DataFrame | None:
    """All association rules from tokens to a verdict, the tokens of each with the rarest one first; None if there can be none."""
    counts = {r["verdict"]: r["n"] for r in labelled.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    least = max(least_pages, int(least_support * n))
    if len(counts) < 2 or n < least:
        return None
    chosen = with_parts(labelled, ["verdict"]).select(F.monotonically_increasing_id().alias("page"), "verdict", "tokens").persist()
    pages = chosen.select("page", F.explode("tokens").alias("token"))
    # What stands on every page tells nothing.
    seen = pages.groupBy("token").agg(F.count("*").alias("n")).filter((F.col("n") >= least) & (F.col("n") < n))
    alike = _alike(pages, seen.persist()).persist()
    names = alike.select("token", "as").unionByName(labelled.sparkSession.createDataFrame([(v, v) for v in VERDICTS], "token string, as string"))
    every = F.concat("tokens", F.array(F.concat(F.lit("="), "verdict")))
    baskets = chosen.select("page", F.explode(every).alias("token")).join(F.broadcast(names), "token")
    baskets = baskets.groupBy("page").agg(F.collect_set("as").alias("items"))
    # Half a page less, as the share times the pages may come out above the number that is meant.
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=least_confidence).fit(baskets)
    found = model.associationRules.filter(
        F.col("consequent")[0].isin(*VERDICTS)
        & ~F.arrays_overlap("antecedent", F.array(*[F.lit(v) for v in VERDICTS]))
        & (F.col("lift") >= least_lift)
    ).select(F.array_sort("antecedent").alias("tokens"), F.col("consequent")[0].alias("said"), "confidence", "support")
    found = _without_longer(found.persist())
    # Each token of a rule stands for those that are mined as it: a rule for each choice of one of them.
    members = alike.groupBy("as").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("members"))
    parts = found.select("*", F.posexplode("tokens").alias("i", "as")).join(F.broadcast(members), "as")
    parts = parts.groupBy("tokens", "said", "confidence", "support").agg(F.array_sort(F.collect_list(F.struct("i", "members"))).alias("parts"))
    choices = F.aggregate(
        "parts",
        F.array(F.array().cast("array<struct<n:bigint,token:string>>")),
        lambda done, part: F.flatten(F.transform(done, lambda d: F.transform(part["members"], lambda m: F.concat(d, F.array(m))))),
    )
    rules = parts.select("said", "confidence", "support", F.explode(choices).alias("choice"))
    rarest = F.transform(F.array_sort("choice"), lambda m: m["token"])
    rules = rules.select("confidence", "support", F.substr("said", F.lit(2)).alias("verdict"), rarest.alias("tokens"))
    name = F.array_join(F.array_sort("tokens"), " & ").alias("name")
    return rules.select("confidence", "support", name, "verdict", "tokens")


def mine_rules(labelled: DataFrame, **limits) -> list[dict]:
    """The rules of `found_rules`, surest first; for many rules keep them as a table."""
    rules = found_rules(labelled, **limits)
    return [] if rules is None else _listed(rules)


def _listed(rules: DataFrame) -> list[dict]:
    order = [F.desc("confidence"), F.desc("support"), F.size("tokens"), "name"]
    return [r.asDict() for r in rules.orderBy(*order).collect()]


def _joined_best(rows: DataFrame, rules: DataFrame, url_col: str) -> DataFrame:
    """`rows` with the surest rule of each, by a join of different URLs on the rules' rarest tokens."""
    urls = with_parts(rows.select(F.col(url_col).alias("__url")).distinct(), ["__url"], "__url")
    named = rules.withColumn("__first", F.col("tokens")[0]).withColumnRenamed("tokens", "__needs")
    met = urls.select("__url", "tokens", F.explode("tokens").alias("__first")).join(named, "__first")
    met = met.filter(F.forall("__needs", lambda t: F.array_contains("tokens", t)))
    best = met.groupBy("__url").agg(F.max(F.struct("confidence", "support", "name", "verdict")).alias("__best"))
    return rows.join(best, F.col(url_col) == F.col("__url"), "left").drop("__url")


def judge(pages: DataFrame, rules: list[dict] | DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: host, path, the fixed rule, the verdict, and the mined rule that fits best, if any."""
    best = F.lit(None).cast("struct<confidence:double,support:double,name:string,verdict:string>")
    if isinstance(rules, DataFrame):
        pages = _joined_best(pages.select(id_col, url_col), rules, url_col)
        rows, best = with_parts(pages, [id_col, "__best"], url_col), F.col("__best")
    else:
        rows = with_parts(pages, [id_col], url_col)
    if rules and not isinstance(rules, DataFrame):
        index: dict[str, list[dict]] = {}
        for rule in rules:
            index.setdefault(rule["tokens"][0], []).append(rule)
        held = F.from_json(F.lit(json.dumps(index)), INDEX)
        none = F.array().cast(INDEX.split(",", 1)[1][:-1])
        under = F.flatten(F.transform("tokens", lambda t: F.coalesce(F.try_element_at(held, t), none)))
        fits = F.filter(under, lambda r: F.forall(r["tokens"], lambda t: F.array_contains("tokens", t)))
        sure = F.transform(fits, lambda r: F.struct(r["confidence"], r["support"], r["name"], r["verdict"]))
        best = F.array_max(sure)
    rows = rows.withColumn("__best", best)
    name, verdict = fixed_rule(F.col("host"), F.col("path"))
    return rows.select(
        id_col,
        "host",
        "path",
        name.alias("rule"),
        F.coalesce(verdict, F.col("__best.verdict"), F.lit(DEFAULT)).alias("verdict"),
        F.col("__best.name").alias("mined_rule"),
    )


def filter_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    rules = found_rules(labelled_pages(pages, labels))
    if rules is None:
        return judge(pages, [])
    rules = rules.persist()
    return judge(pages, _listed(rules) if rules.count() <= INDEXED else rules)


def op13_url_filter(spark: SparkSession, root: str) -> DataFrame:
    return filter_pages(table(spark, root, "pages"), table(spark, root, "labels"))
