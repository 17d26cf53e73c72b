"""From messages to text: normalisation, parts with character offsets, whole texts.

Two layouts are served. Message rows (one row per message) are placed with ``locate_parts``,
which spreads even a single huge trajectory over many tasks. Nested rows (one row per
trajectory) are rendered by array functions inside the row, with no shuffle. Both give the same
parts table:

    trajectory_id, msg_idx, role, part, char_start, char_end, n_chars,
    tok_start, n_tok, n_tokens

where n_chars and n_tokens are totals of the trajectory and the tok_* columns are positions under
the default tokenizer. On request there is also prev_token, the last token of the part before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.arrays import running_sum
from tracemill.functions.text import (
    PLAIN,
    Template,
    called_functions,
    last_token,
    normalise_arguments,
    token_count,
    tool_call_text,
    tool_response_text,
)
from tracemill.operators.filters import drop_empty_messages, has_content
from tracemill.operators.ordering import running

def explode_messages(trajectories: DataFrame, *keep: str) -> DataFrame:
    """One row per message, in list order."""
    return trajectories.select(
        "trajectory_id", *keep, F.posexplode("trajectory").alias("msg_idx", "_message")
    ).select("trajectory_id", *keep, "msg_idx", "_message.*")


def _with_calls(role: Column, content: Column, tool_calls: Column, arguments: Column) -> Column:
    text = tool_call_text(called_functions(tool_calls), arguments)
    calling = (role == "assistant") & (F.size(tool_calls) > 0)
    return F.when(calling, F.concat(F.coalesce(content, F.lit("")), text)).otherwise(content)


def _with_response(role: Column, content: Column, name: Column) -> Column:
    return F.when(role == "tool", tool_response_text(name, content)).otherwise(content)


def _known_role(role: Column, tool_role_supported: bool) -> Column:
    return role if tool_role_supported else F.when(role == "tool", F.lit("user")).otherwise(role)


def flatten_tool_calls(messages: DataFrame) -> DataFrame:
    """Append the calls of assistant messages to their content, with nothing in between."""
    raw = F.transform(called_functions(F.col("tool_calls")), lambda function: function["arguments"])
    dumped = messages.withColumn("_arguments", normalise_arguments(F.array(raw)))
    content = _with_calls(F.col("role"), F.col("content"), F.col("tool_calls"), F.get("_arguments", F.lit(0)))
    return dumped.withColumn("content", content).drop("_arguments")


def wrap_tool_responses(messages: DataFrame) -> DataFrame:
    return messages.withColumn("content", _with_response(F.col("role"), F.col("content"), F.col("name")))


def remap_tool_role(messages: DataFrame, tool_role_supported: bool = False) -> DataFrame:
    """Give tool messages the role ``user`` unless the template knows the tool role."""
    return messages.withColumn("role", _known_role(F.col("role"), tool_role_supported))


def normalise_messages(messages: DataFrame, tool_role_supported: bool = False) -> DataFrame:
    """Tool calls, tool answers and roles of the tools path, in that order."""
    return remap_tool_role(wrap_tool_responses(flatten_tool_calls(messages)), tool_role_supported)


def normalise_trajectories(trajectories: DataFrame, tool_role_supported: bool = False) -> DataFrame:
    """The same for nested rows, inside the row."""
    raw = F.transform(
        F.col("trajectory"),
        lambda m: F.transform(called_functions(m["tool_calls"]), lambda function: function["arguments"]),
    )
    dumped = trajectories.withColumn("_arguments", normalise_arguments(raw))

    def rewrite(m: Column, arguments: Column) -> Column:
        content = _with_calls(m["role"], m["content"], m["tool_calls"], arguments)
        return F.struct(
            _known_role(m["role"], tool_role_supported).alias("role"),
            _with_response(m["role"], content, m["name"]).alias("content"),
        )

    return dumped.withColumn("trajectory", F.zip_with("trajectory", "_arguments", rewrite)).drop("_arguments")


def locate_parts(
    messages: DataFrame, template: Template = PLAIN, *, trailing: bool = False, previous: bool = False
) -> DataFrame:
    """Parts table of message rows; messages without content vanish.

    ``trailing`` counts a separator after the last part into ``n_chars``; ``previous`` adds
    prev_token.
    """
    template.check_token_safe()
    gap_chars, gap_tokens = len(template.separator), template.separator_tokens
    role = F.coalesce("role", F.lit(""))
    parts = (
        drop_empty_messages(messages)
        .select("trajectory_id", "msg_idx", role.alias("role"), template.part(role, F.col("content")).alias("part"))
        .withColumn("n_tok", token_count(F.col("part")).cast("bigint"))
    )
    before = {
        "char_start": ("sum", F.length("part") + gap_chars),
        "tok_start": ("sum", F.col("n_tok") + gap_tokens),
    }
    if previous:
        before["prev_token"] = ("last", last_token(F.col("part")))
    placed = running(
        parts,
        ["trajectory_id"],
        "msg_idx",
        before=before,
        totals={"n_chars": "char_start", "n_tokens": "tok_start"},
    )
    return placed.select(
        "trajectory_id",
        "msg_idx",
        "role",
        "part",
        "char_start",
        (F.col("char_start") + F.length("part")).alias("char_end"),
        (F.col("n_chars") - (0 if trailing else gap_chars)).alias("n_chars"),
        "tok_start",
        "n_tok",
        (F.col("n_tokens") - gap_tokens).alias("n_tokens"),
        *(["prev_token"] if previous else []),
    )


def render_trajectories(trajectories: DataFrame, template: Template = PLAIN, *, trailing: bool = False) -> DataFrame:
    """Add text, parts, assistant_ranges and prompt_boundary_char to nested rows, inside the row.

    A trajectory with no content at all gets an empty text and boundary 0.
    """
    indexed = F.transform(
        F.col("trajectory"),
        lambda message, i: F.struct(
            i.alias("msg_idx"),
            F.coalesce(message["role"], F.lit("")).alias("role"),
            message["content"].alias("content"),
        ),
    )
    parts = F.transform(
        F.filter(indexed, lambda m: has_content(m["content"])),
        lambda m: F.struct(
            m["msg_idx"].alias("msg_idx"),
            m["role"].alias("role"),
            template.part(m["role"], m["content"]).alias("part"),
        ),
    )
    width = len(template.separator)
    rendered = (
        trajectories.withColumn("_parts", F.coalesce(parts, F.array().cast("array<struct<msg_idx:int,role:string,part:string>>")))
        .withColumn("_widths", F.transform("_parts", lambda p: F.length(p["part"]) + F.lit(width)))
        .withColumn(
            "parts",
            F.zip_with(
                "_parts",
                running_sum(F.col("_widths")),
                lambda p, start: F.struct(
                    p["msg_idx"].alias("msg_idx"),
                    p["role"].alias("role"),
                    p["part"].alias("part"),
                    start.alias("char_start"),
                    (start + F.length(p["part"])).alias("char_end"),
                ),
            ),
        )
    )
    joined = F.array_join(F.transform("parts", lambda p: p["part"]), template.separator)
    if trailing:
        joined = F.when(F.size("parts") > 0, F.concat(joined, F.lit(template.separator))).otherwise(joined)
    ranges = F.transform(
        F.filter("parts", lambda p: p["role"] == "assistant"),
        lambda p: F.struct(p["char_start"].alias("start"), p["char_end"].alias("end")),
    )
    return (
        rendered.withColumn("text", joined)
        .withColumn("assistant_ranges", ranges)
        .withColumn(
            "prompt_boundary_char",
            F.coalesce(
                F.get(F.col("assistant_ranges"), F.lit(0))["start"],
                F.try_element_at(F.col("parts"), F.lit(-1))["char_end"],
                F.lit(0).cast("bigint"),
            ),
        )
        .drop("_parts", "_widths")
    )


def explode_parts(rendered: DataFrame, template: Template = PLAIN, *, previous: bool = False) -> DataFrame:
    """Parts table of rendered nested rows, with no shuffle."""
    template.check_token_safe()
    gap = template.separator_tokens
    counted = rendered.withColumn("_counts", F.transform("parts", lambda p: token_count(p["part"]) + F.lit(gap)))
    columns = [
        F.col("parts").alias("p"),
        running_sum(F.col("_counts")).alias("tok_start"),
        F.col("_counts").alias("n"),
    ]
    if previous:
        last_tokens = F.transform("parts", lambda p: last_token(p["part"]))
        columns.append(F.concat(F.array(F.lit(None).cast("string")), last_tokens).alias("prev_token"))
    exploded = counted.select(
        "trajectory_id",
        F.length("text").cast("bigint").alias("n_chars"),
        (F.aggregate("_counts", F.lit(0).cast("bigint"), lambda a, x: a + x) - gap).alias("n_tokens"),
        F.explode(F.arrays_zip(*columns)).alias("z"),
    ).filter("z.p is not null")
    return exploded.select(
        "trajectory_id",
        "z.p.msg_idx",
        "z.p.role",
        "z.p.part",
        "z.p.char_start",
        "z.p.char_end",
        "n_chars",
        "z.tok_start",
        (F.col("z.n") - gap).cast("bigint").alias("n_tok"),
        "n_tokens",
        *(["z.prev_token"] if previous else []),
    )


def assistant_ranges(parts: DataFrame) -> DataFrame:
    """Half-open character ranges of assistant parts, role tag included."""
    return parts.filter(F.col("role") == "assistant").select(
        "trajectory_id", "msg_idx", "char_start", "char_end"
    )


def prompt_boundary(parts: DataFrame) -> DataFrame:
    """Per trajectory: where its first assistant part starts, or the text length if it has none."""
    assistant = F.col("role") == "assistant"
    return parts.groupBy("trajectory_id").agg(
        F.coalesce(F.min(F.when(assistant, F.col("char_start"))), F.max("char_end")).alias("prompt_boundary_char"),
        F.coalesce(F.min(F.when(assistant, F.col("tok_start"))), F.max("n_tokens")).alias("prompt_boundary"),
        F.max("n_chars").alias("n_chars"),
        F.max("n_tokens").alias("n_tokens"),
    )


def whole_texts(parts: DataFrame, template: Template = PLAIN) -> DataFrame:
    """(trajectory_id, text, assistant_ranges, prompt_boundary_char) from a parts table.

    For tokenizers that need whole texts: a trajectory's text meets in one row.
    """
    row = F.struct("char_start", "char_end", "role", "part")
    spans = F.transform(
        F.filter("_parts", lambda p: p["role"] == "assistant"),
        lambda p: F.struct(p["char_start"].alias("start"), p["char_end"].alias("end")),
    )
    return (
        parts.groupBy("trajectory_id")
        .agg(F.sort_array(F.collect_list(row)).alias("_parts"))
        .select(
            "trajectory_id",
            F.array_join(F.transform("_parts", lambda p: p["part"]), template.separator).alias("text"),
            spans.alias("assistant_ranges"),
            F.array_max(F.transform("_parts", lambda p: p["char_end"])).alias("_end"),
        )
        .select(
            "trajectory_id",
            "text",
            "assistant_ranges",
            F.coalesce(F.get("assistant_ranges", F.lit(0))["start"], F.col("_end")).alias("prompt_boundary_char"),
        )
    )
