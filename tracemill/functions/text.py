"""Message text: tool calls, tool answers, role tags, and the default token pattern."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill import fixed
from tracemill.functions.json_text import redump


def fill(pattern: str, **values: Column) -> Column:
    """A format string with its ``{name}`` fields replaced by columns."""
    pieces = re.split(r"\{(\w+)\}", pattern)
    return F.concat(*(values[piece] if i % 2 else F.lit(piece) for i, piece in enumerate(pieces)))


# Every character belongs to exactly one token, so offsets are running sums of token lengths.
TOKEN_PATTERN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_]"
_NO_ARGUMENTS = fixed.NO_ARGUMENTS
_WORD = re.compile(r"[A-Za-z0-9_]")


@dataclass(frozen=True)
class Template:
    """How one message becomes a part of the text and what stands between two parts."""

    prefix: str = fixed.PART_PREFIX
    suffix: str = ""
    separator: str = fixed.PART_SEPARATOR

    def part(self, role: Column, content: Column) -> Column:
        return F.concat(fill(self.prefix, role=role), content, F.lit(self.suffix))

    @property
    def separator_tokens(self) -> int:
        return len(re.findall(TOKEN_PATTERN, self.separator))

    def check_token_safe(self) -> None:
        """Tokens may be cut part by part only if no token can reach over a part's edge."""
        opening = self.prefix.split("{role}", 1)[0]
        if not opening or _WORD.match(opening) or _WORD.match(self.separator):
            raise ValueError(
                "the default tokenizer needs a template whose prefix (and separator, if any) "
                "starts with a character outside [A-Za-z0-9_]"
            )


PLAIN = Template()


def token_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def token_count(text: Column) -> Column:
    """``size(token_list(text))`` without making the tokens: runs shrink to one character."""
    return F.length(F.regexp_replace(text, r"[A-Za-z0-9_]+", "a"))


def last_token(text: Column) -> Column:
    """The last of ``token_list(text)``, found from the end; NULL for an empty text."""
    found = F.regexp_extract(F.reverse(text), rf"\A(?:{TOKEN_PATTERN})", 0)
    return F.when(F.length(text) > 0, F.reverse(found))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def normalise_arguments(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Re-dump each JSON text, given as one list of texts per message of a trajectory.

    A text that is not JSON becomes a JSON string, a missing one an empty object.
    """

    def redump(text: str | None) -> str:
        try:
            return json.dumps(json.loads(_NO_ARGUMENTS if text is None else text))
        except json.JSONDecodeError:
            return json.dumps(text)

    def per_message(texts):
        return None if texts is None else [redump(text) for text in texts]

    for batch in batches:
        yield batch.map(lambda messages: None if messages is None else [per_message(m) for m in messages])


def native_arguments(texts: Column) -> Column:
    """``normalise_arguments`` for one list of texts, by built-in functions: no Python workers."""
    return F.transform(texts, lambda text: redump(F.coalesce(text, F.lit(_NO_ARGUMENTS))))


def called_functions(tool_calls: Column) -> Column:
    """The ``function`` structs of the calls that have one; one without any field counts as none."""
    functions = F.transform(tool_calls, lambda call: call["function"])
    return F.filter(
        functions, lambda function: function["name"].isNotNull() | function["arguments"].isNotNull()
    )


def tool_call_text(functions: Column, arguments: Column) -> Column:
    """All calls of one message, one block each; ``arguments`` are normalised already."""
    blocks = F.zip_with(
        functions,
        arguments,
        lambda function, args: fill(
            fixed.TOOL_CALL,
            name=F.coalesce(function["name"], F.lit(fixed.UNKNOWN_FUNCTION)),
            arguments=args,
        ),
    )
    return F.array_join(blocks, fixed.TOOL_CALL_SEPARATOR)


def tool_response_text(name: Column, content: Column) -> Column:
    return fill(
        fixed.TOOL_RESPONSE,
        name=F.coalesce(name, F.lit(fixed.UNNAMED_TOOL)),
        content=F.coalesce(content, F.lit("")),
    )
