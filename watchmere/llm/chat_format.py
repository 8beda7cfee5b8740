"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation's turns are laid out along the prefix sums of their tokens, and the line is cut into cells as long as
what the budget leaves beside the system turn and the history. Turns inside one cell make a window; a turn that crosses
an edge is a window of its own. Every window begins with the conversation's system turn, then repeats the turns just
before it as far as HISTORY tokens reach, then has its new turns. Only new assistant texts are under the loss mask, so
each is a target once. A turn longer than a cell is kept whole, in a window that may exceed the budget.

Prefix sums are taken in chunks of CHUNK turn numbers and over the chunks' totals, so a very long conversation is not
gathered anywhere. Turns are joined with windows by the few cells that their tokens can reach, never by ranges.

Turns are ordered by number, then role and text; a missing number comes first; repeated rows are turns of their own. A
missing role or text is empty. Rows without a conversation id form one conversation. An empty table gives no window.
The system turn is the first turn, if its role is "system". Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchmere.llm.common import table
from watchmere.session import scratch_path

BUDGET = 1024
HISTORY = 256
CHUNK = 512
TURN_TOKENS = 4  # for the marks around a turn
OPEN, CLOSE = "<turn>", "</turn>\n"
SYSTEM, ASSISTANT = "system", "assistant"


def escaped(text: Column) -> Column:
    """No "<" is left, so no mark can appear inside; a backslash is doubled."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    """Undoes `escaped`: what stands between doubled backslashes is looked at piece by piece."""
    pieces = F.split(text, r"\\\\")
    plain = F.transform(pieces, lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\e"), F.lit("\n")))
    return F.array_join(plain, "\\")


def escaped_role(role: Column) -> Column:
    """A role takes one line."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\e"))


def token_count(text: Column) -> Column:
    """Words and single marks."""
    return F.regexp_count(text, F.lit(r"[^\W_]+|[^\w\s]|_")) + F.lit(TURN_TOKENS)


def _placed(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """Turns with their number `at` in the conversation, tokens before them, the cell length and their window."""
    chunk = F.floor(F.col("turn") / CHUNK)
    chunked = turns.withColumn("chunk", chunk).withColumn("tokens", token_count(F.col("text")))
    totals = chunked.groupBy("conv", "chunk").agg(
        F.count("*").alias("rows"),
        F.sum("tokens").alias("sum"),
        F.min(F.struct("turn", "role", "text")).alias("first"),
    )
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv")
    lead = F.first("first").over(Window.partitionBy("conv").orderBy("chunk"))
    totals = totals.select(
        F.col("conv").alias("t_conv"),
        F.col("chunk").alias("t_chunk"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("tokens_before"),
        F.sum("rows").over(whole).alias("all_rows"),
        lead.alias("lead"),
    )
    inside = Window.partitionBy("conv", "chunk").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    ranked = chunked.select("*", F.row_number().over(inside.orderBy("turn", "role", "text")).alias("place"), F.sum("tokens").over(inside).alias("upto"))
    joined = ranked.join(
        totals, F.col("conv").eqNullSafe(F.col("t_conv")) & F.col("chunk").eqNullSafe(F.col("t_chunk"))
    )
    system = F.col("lead.role") == SYSTEM
    lead_tokens = F.when(system, token_count(F.col("lead.text"))).otherwise(0)
    cell = F.greatest(F.lit(budget - history) - lead_tokens, F.lit(budget // 4))
    placed = joined.select(
        "conv",
        "role",
        "text",
        (F.col("rows_before") + F.col("place") - 1).alias("at"),
        (F.col("tokens_before") + F.col("upto")).alias("end"),
        "tokens",
        "all_rows",
        system.alias("has_system"),
        cell.alias("cell"),
    )
    start = F.col("end") - F.col("tokens")
    first_cell, last_cell = F.floor(start / F.col("cell")), F.floor((F.col("end") - 1) / F.col("cell"))
    return placed.select(
        "*",
        start.alias("start"),
        (2 * first_cell + (first_cell != last_cell).cast("long")).alias("window"),
        (F.col("has_system") & (F.col("at") == 0)).alias("is_system"),
    )


def windows(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = BUDGET,
    history: int = HISTORY,
) -> DataFrame:
    """One row per window: (conversation, window, formatted, loss, repeated, tokens).

    `loss` holds the character ranges of `formatted` that are targets; the first `repeated` turns are not new.
    """
    turns = conversations.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    # Read several times below: new turns, history, system turns and where windows begin.
    path = scratch_path(conversations.sparkSession, "placed-turns")
    _placed(turns, budget, history).write.parquet(path)
    placed = conversations.sparkSession.read.parquet(path)
    part = F.struct("at", F.col("fresh"), "role", "text", "tokens")
    # A system turn alone is new in its own window; otherwise it leads the window of the turn after it.
    ordinary = placed.filter(~F.col("is_system"))
    alone = placed.filter(F.col("is_system") & (F.col("all_rows") == 1)).withColumn("fresh", F.lit(True))
    new = ordinary.withColumn("fresh", F.lit(True)).unionByName(alone)
    begins = new.groupBy("conv", "window").agg(F.min("start").alias("begin"), F.min("at").alias("first_at"))
    begins = begins.select(F.col("conv").alias("b_conv"), F.col("window").alias("b_window"), "begin", "first_at")
    same = F.col("conv").eqNullSafe(F.col("b_conv"))
    reach = F.sequence(
        2 * F.floor(F.col("end") / F.col("cell")), 2 * F.floor((F.col("start") + history) / F.col("cell")) + 1
    )
    reach = F.when(F.floor(F.col("end") / F.col("cell")) <= F.floor((F.col("start") + history) / F.col("cell")), reach)
    told = (
        ordinary.withColumn("window", F.explode(reach))
        .join(begins, same & (F.col("window") == F.col("b_window")))
        .filter((F.col("end") <= F.col("begin")) & (F.col("begin") - F.col("start") <= history))
        .withColumn("fresh", F.lit(False))
    )
    systems = placed.filter(F.col("is_system") & (F.col("all_rows") > 1)).drop("window")
    kept = systems.join(begins, same).withColumn("window", F.col("b_window")).withColumn("fresh", F.col("first_at") == 1)
    columns = ["conv", "window", "fresh", "at", "role", "text", "tokens"]
    rows = new.select(columns).unionByName(told.select(columns)).unionByName(kept.select(columns))
    made = rows.groupBy("conv", "window").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    heads = F.transform("parts", lambda p: F.concat(F.lit(OPEN), escaped_role(p["role"]), F.lit("\n")))
    bodies = F.transform("parts", lambda p: escaped(p["text"]))
    made = made.withColumn("heads", heads).withColumn("bodies", bodies)
    sizes = F.transform("parts", lambda p, i: F.length(F.element_at("heads", i + 1)) + F.length(F.element_at("bodies", i + 1)) + len(CLOSE))
    made = made.withColumn("sizes", sizes)
    ends = F.aggregate(
        "sizes",
        F.array().cast("array<int>"),
        lambda done, size: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + size)),
    )
    made = made.withColumn("ends", ends)
    spans = F.transform(
        "parts",
        lambda p, i: F.struct(
            (F.element_at("ends", i + 1) - len(CLOSE) - F.length(F.element_at("bodies", i + 1))).alias("start"),
            (F.element_at("ends", i + 1) - len(CLOSE)).alias("end"),
            (p["fresh"] & (p["role"] == ASSISTANT)).alias("target"),
        ),
    )
    loss = F.transform(F.filter(spans, lambda s: s["target"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    text = F.array_join(F.transform("parts", lambda p, i: F.concat(F.element_at("heads", i + 1), F.element_at("bodies", i + 1), F.lit(CLOSE))), "")
    return made.select(
        F.col("conv").alias(conv_col),
        "window",
        text.alias("formatted"),
        loss.alias("loss"),
        F.size(F.filter("parts", lambda p: ~p["fresh"])).alias("repeated"),
        F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["tokens"]).alias("tokens"),
    )


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation, from windows: its turns and what is under the loss mask, both unescaped."""
    segments = F.split(F.substring("formatted", len(OPEN) + 1, 1 << 30), OPEN)
    # Repeated turns come first: the system turn and the history.
    fresh = F.slice(segments, F.col("repeated") + 1, F.size(segments))
    turn = F.transform(
        fresh,
        lambda s: F.concat(
            unescaped(F.substring_index(s, "\n", 1)),
            F.lit("\n"),
            unescaped(F.substring_index(F.substr(s, F.instr(s, "\n") + 1), CLOSE, 1)),
            F.lit("\n"),
        ),
    )
    targets = F.transform("loss", lambda s: unescaped(F.substr("formatted", s["start"] + 1, s["end"] - s["start"])))
    read = formatted.select(
        conv_col,
        "window",
        F.size(fresh).alias("n"),
        F.array_join(turn, "").alias("turns"),
        F.array_join(targets, "").alias("targets"),
        F.length("formatted").alias("chars"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("window", "turns", "targets")))
    grouped = read.groupBy(conv_col).agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.count("*").alias("n_windows"), ordered.alias("all"))
    return grouped.select(
        conv_col,
        F.col("n").cast("long").alias("n_turns"),
        F.array_join(F.col("all.turns"), "").alias("turns"),
        F.array_join(F.col("all.targets"), "").alias("targets"),
        F.col("chars").cast("long").alias("formatted_chars"),
        "n_windows",
    )


def op8_chat_format(spark: SparkSession, root: str) -> DataFrame:
    conversations = table(spark, root, "conversations").select("conv_id", "turn", "role", "text")
    said = r"r'\### Assistant: </turn> ok'"
    probe = spark.sql(
        f"SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, {said} AS text UNION ALL SELECT -7L, 1L, 'assistant', {said}"
    )
    read = read_back(windows(conversations.unionByName(probe)))
    return read.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.length("targets").cast("long").alias("loss_chars"),
        F.sha2("targets", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )
