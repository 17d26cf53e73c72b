"""Quotation linking: replies are tied to the messages that they quote.

The lines of a message are read with their quote level, the number of leading ``>``. Lines of one
level that follow one another are passages; blank lines end them. Normalised passages (small
letters, single blanks) and the lines of passages are hashed, whatever their length, and every hash
quoted at any level is tied to the latest earlier message of its conversation that has it as its own
text. The outermost level that has an original is what a message answers: of the messages quoted
there, the one with most quoted characters is the parent; of equals the latest. Chains of parents are followed by doubling
to the start of the thread, and the result is ordered by thread and turn, so that every reply
comes after what it answers. ``text`` is the message without its quotes.

Only built-in functions are used. A hash that stands in very many messages of a conversation never
meets itself in one task: the latest earlier message is a running maximum over chunks.

Defined results: NULL text stays NULL and quotes nothing. Messages without conv_id or turn are
linked with nothing. Rows that repeat a turn have the same parent; of their texts each counts. A
quote without an original links nothing. An empty table gives an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import let
from tracemill.operators.ordering import running
from tracemill.session import materialise

_QUOTE = r"^[ \t]*(>[ \t]*)+"


def _lines(text: Column) -> Column:
    """(level, body) of every line."""

    def line(x: Column) -> Column:
        mark = F.regexp_extract(x, _QUOTE, 0)
        return let(
            mark,
            lambda m: F.struct(
                F.length(F.regexp_replace(m, "[^>]", "")).alias("level"),
                F.substring(x, F.length(m) + 1, F.length(x)).alias("body"),
            ),
        )

    return F.transform(F.split(text, "\r?\n"), line)


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _passages(lines: Column) -> Column:
    """(level, body) of runs of lines of one level without a blank line, and of the lines themselves.

    Runs are cut at their ends, so the work grows with the lines. Repeated passages stay in; they
    meet in the grouping by hash.
    """

    def apart(p: Column, x: Column, i: Column) -> Column:
        """Whether the line at ``i`` does not go on with line ``x``."""
        other = F.get(p, i)
        return other.isNull() | (other["level"] != x["level"]) | (other["body"] == "")

    def places(p: Column, step: int) -> Column:
        marked = F.transform(
            p, lambda x, i: F.when((x["body"] != "") & apart(p, x, i + step), i.cast("int"))
        )
        return F.array_compact(marked)

    def runs(p: Column) -> Column:
        def run(first: Column, last: Column) -> Column:
            bodies = F.transform(F.slice(p, first + 1, last - first + 1), lambda x: x["body"])
            return F.struct(F.get(p, first)["level"].alias("level"), F.array_join(bodies, " ").alias("body"))

        return let(
            F.struct(places(p, -1).alias("first"), places(p, 1).alias("last")),
            lambda at: F.zip_with(at["first"], at["last"], run),
        )

    plain = F.transform(
        lines, lambda x: F.struct(x["level"].alias("level"), _normal(x["body"]).alias("body"))
    )
    return let(plain, lambda p: F.concat(runs(p), F.filter(p, lambda x: x["body"] != "")))


def parse_quotes(messages: DataFrame) -> DataFrame:
    """Own text, passages and deepest level of every message."""
    lines = messages.select("conv_id", "turn", "role", F.col("text").alias("raw"), _lines(F.col("text")).alias("lines"))
    own = F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["body"])
    return lines.select(
        "conv_id",
        "turn",
        "role",
        F.when(F.array_max(F.transform("lines", lambda x: x["level"])) == 0, F.col("raw"))
        .otherwise(F.btrim(F.array_join(own, "\n"), F.lit("\n")))
        .alias("text"),
        F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0)).alias("levels"),
        _passages(F.col("lines")).alias("passages"),
    )


def parents(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, parent): the earlier message that each quoting message quotes most."""
    passages = (
        parsed.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
        .select("conv_id", "turn", F.explode("passages").alias("p"))
        .select(
            "conv_id",
            "turn",
            F.xxhash64("p.body").alias("key"),
            F.length("p.body").alias("n"),
            (F.col("p.level") == 0).alias("own"),
            F.when(F.col("p.level") > 0, F.col("p.level")).alias("level"),
        )
        .groupBy("conv_id", "key", "turn")
        .agg(F.max("own").alias("own"), F.min("level").alias("level"), F.max("n").alias("n"))
    )
    # Hashes that nobody quotes are dropped before anything is ordered.
    quoted = materialise(passages.where("level is not null").select("conv_id", "key").distinct(), "quoted")
    used = materialise(passages.join(quoted, ["conv_id", "key"], "left_semi"), "passages")
    low = used.agg(F.min("turn")).first()[0] or 0
    ordered = used.withColumn("place", F.col("turn") - F.lit(low))
    linked = running(
        ordered, ["conv_id", "key"], "place", before={"origin": ("max", F.when(F.col("own"), F.col("turn")))}
    )
    votes = (
        linked.where(F.col("level").isNotNull() & F.col("origin").isNotNull())
        .groupBy("conv_id", "turn", "level", "origin")
        .agg(F.sum("n").alias("n"))
    )
    # The outermost level with an original is what the message itself answers.
    best = votes.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "n", "origin")).alias("best"))
    return best.select("conv_id", "turn", F.col("best.origin").alias("parent"))


def threads(links: DataFrame) -> DataFrame:
    """(conv_id, turn, parent, root, depth): chains of parents followed by doubling."""
    state = materialise(
        links.select("conv_id", "turn", "parent", F.col("parent").alias("root"), F.lit(1).alias("depth")), "threads"
    )
    while True:
        up = state.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("up"), F.col("depth").alias("more"))
        joined = state.join(up, ["conv_id", "root"], "left")
        step = materialise(
            joined.select(
                "conv_id",
                "turn",
                "parent",
                F.coalesce("up", "root").alias("root"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                F.col("up").isNotNull().alias("moved"),
            ),
            "threads",
        )
        if step.where("moved").isEmpty():
            return step.drop("moved")
        state = step.drop("moved")


def link_quotes(messages: DataFrame) -> DataFrame:
    """Messages without quotes, with parent, thread and depth, in the order of replies."""
    parsed = parse_quotes(messages)
    found = threads(parents(parsed))
    out = parsed.join(found, ["conv_id", "turn"], "left").select(
        "conv_id",
        "turn",
        "role",
        "text",
        "levels",
        F.col("parent").alias("parent_turn"),
        F.coalesce("root", "turn").alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
    )
    return out.orderBy("conv_id", "thread_turn", "turn")
