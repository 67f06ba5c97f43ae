"""Quotation linking: conversations whose quotes are replaced by links to what they quote.

A line's quote level is its number of leading ">" marks. The lines below level 1 are a message's own text;
its paragraphs, its lines and the whole of it are passages. Quoted lines, and runs of lines of one level,
are passages too. Passages are normalised (lower case, white space collapsed), hashed, and quoted
ones joined to the first message of the conversation that said them. A message replies to the earlier message from
which it quotes most characters at its outermost matched level (the later one on a tie). Following
replies upwards gives threads; ordered by (thread_turn, turn), replies come after what they answer and
threads stay together, without quotes; ``position`` is a message's place in that order of its conversation (messages of one
turn by text), and ``chat`` the message as a chat turn. Column expressions only.

What a conversation said is reduced to one row per (conversation, passage) before the join, so a passage
or a conversation of any size meets as many rows as there are quotes of it. Places are counted over ranges of the whole
order, so a conversation of any length is spread over tasks.

Defined results: a null text is empty. Rows with a null conversation or turn link to nothing and nothing to
them. Repeated rows stay repeated. A quote that no earlier message said links to nothing and is
dropped from the text like any other. Extra columns are ignored. An empty table gives no row. Work is linear in the lines of a message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, let

#: A line that only announces the quote below it.
ANNOUNCES = r"(?i)^\s*(?:on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$"
#: Longest chain of replies is at most two to this power.
ROUNDS = 40


def normalised(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def parse(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``lines``: array of (level, line), the line without marks, and ``body``: the own text."""
    raw = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)

    def one(x: Column) -> Column:
        marks = F.regexp_extract(x, r"^(?:[ \t]*>)+", 0)
        level = F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))
        line = F.when(level > 0, F.regexp_replace(x, r"^(?:[ \t]*>)+[ \t]?", "")).otherwise(x)
        return F.struct(level.alias("level"), line.alias("line"))

    d = df.withColumn("lines", F.transform(raw, one))
    quotes = F.exists("lines", lambda x: x["level"] > 0)
    own = F.filter(
        F.transform(
            "lines",
            lambda x, i: F.when(
                (x["level"] == 0) & ~(x["line"].rlike(ANNOUNCES) & (F.coalesce(F.get("lines", i + 1)["level"], F.lit(0)) > 0)), x["line"]
            ),
        ),
        lambda x: x.isNotNull(),
    )
    body = F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", "")
    return d.withColumn("body", F.when(quotes, body).otherwise(F.coalesce(F.col(text_col), F.lit(""))))


def _passages(df: DataFrame, units: Column) -> DataFrame:
    """(conv, turn, level, hash, chars) for an array of (level, text); empty ones are left out."""
    d = df.select("conv", "turn", F.explode(units).alias("u"))
    d = d.select("conv", "turn", "u.level", normalised(F.col("u.text")).alias("s")).where("s <> ''")
    return d.select("conv", "turn", "level", F.sha2("s", 256).alias("hash"), F.length("s").alias("chars"))


def _own_units() -> Column:
    unit = lambda x: F.struct(F.lit(0).alias("level"), x.alias("text"))
    whole = F.array(F.col("body"))
    return F.transform(F.array_distinct(F.concat(whole, F.split("body", r"\n\s*\n"), F.split("body", "\n"))), unit)


def _quoted_units() -> Column:
    """Quoted lines, then runs of one level; a run begins where the level changes."""
    lines = F.transform(F.filter("lines", lambda x: x["level"] > 0), lambda x: F.struct(x["level"].alias("level"), x["line"].alias("text")))

    def begins(ls: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: (i == 0) | (F.get(ls, i)["level"] != F.get(ls, i - 1)["level"]))

    def cut(ls: Column):
        def run(starts: Column) -> Column:
            def one(s, j):
                n = F.coalesce(F.get(starts, j + 1), F.size(ls)) - s
                text = F.array_join(F.transform(F.slice(ls, s + 1, n), lambda x: x["line"]), "\n")
                level = F.get(ls, s)["level"]
                return F.when((level > 0) & (n > 1), F.struct(level.alias("level"), text.alias("text")))

            return F.filter(F.transform(starts, one), lambda r: r.isNotNull())

        return let(begins(ls), run)

    runs = let(F.col("lines"), cut)
    return F.concat(lines, runs)


def link(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, body, n_quoted_lines, max_level, parent_turn, thread_turn, depth, position."""
    scratch = Scratch(df.sparkSession, "quotes")
    m = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    m = parse(m)
    known = m.where("conv is not null and turn is not null")
    quoted = known.where(F.exists("lines", lambda x: x["level"] > 0))
    asked = _passages(quoted, _quoted_units())
    said = _passages(known, _own_units()).groupBy("conv", "hash").agg(F.min("turn").alias("src"))
    met = asked.join(said, ["conv", "hash"]).where("src < turn")
    per = met.groupBy("conv", "turn", "src", "level").agg(F.sum("chars").alias("chars"))
    best = per.groupBy("conv", "turn").agg(F.max(F.struct((-F.col("level")).alias("l"), "chars", "src")).alias("b"))
    parent = scratch.cut(best.select("conv", "turn", F.col("b.src").alias("parent")), "parents")
    # Pointer doubling: after k rounds ``up`` is 2 ** k replies above, or the top.
    at = parent.select("conv", "turn", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"))
    for _ in range(ROUNDS):
        above = at.select("conv", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"))
        step = at.join(above, ["conv", "up"], "left")
        if not step.where("up2 is not null").limit(1).count():
            break
        at = scratch.cut(step.select("conv", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth")), "up")
    else:
        raise RuntimeError("chat_quotes: a chain of replies did not end")
    tops = parent.join(at, ["conv", "turn"]).select("conv", "turn", "parent", "up", "depth")
    out = m.join(tops, ["conv", "turn"], "left").select(
        "conv", "turn", "role", "body",
        F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long").alias("n_quoted_lines"),
        F.array_max(F.transform("lines", lambda x: x["level"])).cast("long").alias("max_level"),
        F.col("parent").alias("parent_turn"), F.coalesce("up", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )
    placed = _positions(out, scratch)
    return placed.select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), "body", "n_quoted_lines", "max_level",
        "parent_turn", "thread_turn", "depth", "position",
    )


def _positions(out: DataFrame, scratch: Scratch) -> DataFrame:
    """``out`` with ``position``: from 0, by (thread_turn, turn, body) in each conversation; null where conversation or turn is.

    Rows are dealt by ranges of the whole order and numbered; what a conversation has in earlier ranges comes from one row per conversation
    and range.
    """
    order = ["conv", "thread_turn", "turn", "body"]
    d = out.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    d = scratch.cut(d.withColumn("_part", F.shiftright("_at", 33)), "ordered")
    known = F.col("conv").isNotNull() & F.col("turn").isNotNull()
    here = d.where(known).groupBy("conv", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = F.sum("_n").over(Window.partitionBy("conv").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    here = here.select("conv", "_part", "_first", F.coalesce(earlier, F.lit(0)).alias("_before"))
    return d.join(here, ["conv", "_part"], "left").withColumn("position", F.when(known, F.col("_before") + F.col("_at") - F.col("_first"))).drop("_at", "_part", "_first", "_before")


def formatted(linked: DataFrame, role_col: str = "role") -> DataFrame:
    """``linked`` with ``chat``: the message as a chat turn with its role marker. Order by conversation and position."""
    return linked.withColumn("chat", F.concat(F.lit("<|"), F.coalesce(role_col, F.lit("user")), F.lit("|>\n"), "body", F.lit("\n")))
