"""Fixed schemas of the tables the package reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

FUNCTION_CALL = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("arguments", T.StringType()),
    ]
)
TOOL_CALL = T.StructType([T.StructField("function", FUNCTION_CALL)])

MESSAGE = T.StructType(
    [
        T.StructField("role", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("tool_calls", T.ArrayType(TOOL_CALL)),
    ]
)

TRAJECTORIES = T.StructType(
    [
        T.StructField("trajectory_id", T.StringType()),
        T.StructField("instance_id", T.StringType()),
        T.StructField("repo", T.StringType()),
        T.StructField("trajectory", T.ArrayType(MESSAGE)),
        T.StructField("resolved", T.IntegerType()),
        T.StructField("exit_status", T.StringType()),
        T.StructField("model_patch", T.StringType()),
    ]
)

TOKENIZED = T.StructType(
    [
        T.StructField("input_ids", T.ArrayType(T.IntegerType())),
        T.StructField("attention_mask", T.ArrayType(T.IntegerType())),
        T.StructField("instance_id", T.StringType()),
        T.StructField("repo", T.StringType()),
        T.StructField("trajectory_id", T.StringType()),
    ]
)

# One row per token position; the K best scores stay inside the two arrays.
CACHE_POSITIONS = T.StructType(
    [
        T.StructField("trajectory_id", T.StringType()),
        T.StructField("chunk", T.IntegerType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("token_id", T.IntegerType()),
        T.StructField("loss_mask", T.IntegerType()),
        T.StructField("is_valid", T.IntegerType()),
        T.StructField("top_ids", T.ArrayType(T.IntegerType())),
        T.StructField("top_vals", T.ArrayType(T.FloatType())),
        T.StructField("run_id", T.StringType()),
        T.StructField("format", T.StringType()),
    ]
)

CACHE_HEADERS = T.StructType(
    [
        T.StructField("trajectory_id", T.StringType()),
        T.StructField("seq_len", T.IntegerType()),
        T.StructField("format", T.StringType()),
        T.StructField("prompt_boundary", T.IntegerType()),
        T.StructField("has_loss_mask", T.BooleanType()),
        T.StructField("run_id", T.StringType()),
    ]
)
