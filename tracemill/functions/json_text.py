"""JSON texts written again in one canonical form, by built-in functions alone.

``redump`` gives what ``json.dumps(json.loads(text))`` gives in Python: keys in their order, of a
repeated key the last value in the first place, one space behind commas and colons, ASCII only,
whole numbers as they stand and others by their shortest digits. A text that is not JSON becomes a
JSON string. Defined here where Python raises: nesting deeper than 1,000 counts as no JSON, and
whole numbers of any length stay.

A text is cut into tokens once. A fold over their kinds checks the grammar, and joining the tokens
gives the result, both linear. Only a text in which some key occurs twice, in whatever objects, is
built up object by object, with work that grows with the square of its widest array or object.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DEPTH = 1000

# Possessive loops: others recurse in Java for each character of a string.
_STRING = r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"'
_NUMBER = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?"
_TOKEN = rf"{_STRING}|{_NUMBER}|true|false|null|NaN|-?Infinity|[ \t\n\r]++|(?s:.)"
_PLAIN = r"[ !#-\[\]-~]"
_BODY = rf"{_PLAIN}++|\\u[0-9a-fA-F]{{4}}|\\.|(?s:.)"

# The short escapes, by code point.
_SHORT = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r", 34: '\\"', 92: "\\\\"}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _cases(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    chain = F.when(*cases[0])
    for condition, value in cases[1:]:
        chain = chain.when(condition, value)
    return chain.otherwise(otherwise)


def _unicode_escape(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))


def _escaped(code: Column) -> Column:
    """The code point as it stands inside a JSON string of ASCII characters."""
    above = code - 0x10000
    pair = F.concat(
        _unicode_escape(F.shiftright(above, 10) + 0xD800), _unicode_escape(above.bitwiseAND(F.lit(0x3FF)) + 0xDC00)
    )
    return _cases(
        [(code == number, F.lit(text)) for number, text in _SHORT.items()]
        + [(code.between(32, 126), F.char(code)), (code > 0xFFFF, pair)],
        _unicode_escape(code),
    )


def _string_piece(piece: Column) -> Column:
    """One piece of a string's body: plain characters, an escape, or one other character."""
    code = F.conv(F.substring(piece, 3, 4), 16, 10).cast("bigint")
    return _cases(
        [
            (piece.rlike(rf"^{_PLAIN}"), piece),
            (piece.startswith("\\u"), _let(code, _escaped)),
            (piece == "\\/", F.lit("/")),
            (piece.startswith("\\"), piece),
        ],
        _let(F.ascii(piece).cast("bigint"), _escaped),
    )


def _string(token: Column) -> Column:
    pieces = F.regexp_extract_all(token.substr(F.lit(2), F.length(token) - 2), F.lit(_BODY), F.lit(0))
    again = F.concat(F.lit('"'), F.array_join(F.transform(pieces, _string_piece), ""), F.lit('"'))
    return F.when(token.rlike(rf'^"{_PLAIN}*+"$'), token).otherwise(again)


def quoted(text: Column) -> Column:
    """Any text as a JSON string."""
    pieces = F.regexp_extract_all(text, F.lit(rf"{_PLAIN}++|(?s:.)"), F.lit(0))

    def piece(value: Column) -> Column:
        other = _let(F.ascii(value).cast("bigint"), _escaped)
        return F.when(value.rlike(rf"^{_PLAIN}"), value).otherwise(other)

    return F.concat(F.lit('"'), F.array_join(F.transform(pieces, piece), ""), F.lit('"'))


def _parts(number: Column) -> Column:
    """Sign, digits without zeros at either end, and the place of the point before them."""

    def split(unsigned: Column) -> Column:
        mantissa = F.substring_index(unsigned, "e", 1)
        power = F.regexp_extract(unsigned, r"e\+?(-?\d+)", 1)
        power = F.when(F.length(power) == 0, F.lit(0)).otherwise(power.try_cast("bigint"))
        whole = F.substring_index(mantissa, ".", 1)
        return F.struct(
            F.replace(mantissa, F.lit("."), F.lit("")).alias("digits"),
            (F.length(whole) + power).alias("point"),
        )

    def trimmed(found: Column) -> Column:
        digits = F.regexp_replace(found["digits"], "^0+", "")
        return F.struct(
            number.startswith("-").alias("negative"),
            F.regexp_replace(digits, "0+$", "").alias("digits"),
            (found["point"] - F.length(found["digits"]) + F.length(digits)).alias("point"),
        )

    return _let(_let(F.lower(F.ltrim(number, F.lit("-"))), split), trimmed)


def _shortest(number: Column) -> Column:
    """Parts of the shortest digits that are read as the same double."""

    def by_value(value: Column) -> Column:
        # Java 17 may write more digits than needed: the fewest that are read as the value count.
        def shorter(parts: Column) -> Column:
            def same(digits: Column) -> Column:
                shift = (parts["point"] - F.length(digits)).cast("string")
                return F.concat(digits, F.lit("e"), shift).cast("double") == F.abs(value)

            def cut(n: Column) -> Column:
                kept = parts["digits"].substr(F.lit(1), n)
                last = F.right(kept, F.lit(1)).try_cast("int")
                raised = F.concat(kept.substr(F.lit(1), n - 1), (last + 1).cast("string"))
                up = parts["digits"].substr(n + 1, F.lit(1)) >= "5"
                fits = (last < 9) & same(raised)
                return F.when(up & fits, raised).when(same(kept), kept).when(fits, raised)

            cuts = F.filter(F.transform(F.sequence(F.lit(1), F.length(parts["digits"])), cut), lambda d: d.isNotNull())
            return F.struct(
                parts["negative"].alias("negative"),
                F.coalesce(F.get(cuts, F.lit(0)), F.lit("")).alias("digits"),
                parts["point"].alias("point"),
            )

        written = _parts(value.cast("string"))
        return _let(written, lambda parts: F.when(F.length(parts["digits"]) > 0, shorter(parts)).otherwise(parts))

    def choose(parts: Column) -> Column:
        # Up to 15 digits of a normal double are its shortest ones already.
        exact = (F.length(parts["digits"]) <= 15) & parts["point"].between(-290, 290)
        return F.when(exact, parts).otherwise(_let(number.cast("double"), by_value))

    return _let(_parts(number), choose)


def _float(number: Column) -> Column:
    def laid_out(parts: Column) -> Column:
        digits, point = parts["digits"], parts["point"].cast("int")
        count, power = F.length(digits), parts["point"] - 1
        rest = F.when(count > 1, F.concat(F.lit("."), digits.substr(F.lit(2), count))).otherwise("")
        sign = F.when(power < 0, F.lit("-")).otherwise("+")
        size = F.abs(power).cast("string")
        two = F.when(F.abs(power) < 10, F.concat(F.lit("0"), size)).otherwise(size)
        scientific = F.concat(F.substring(digits, 1, 1), rest, F.lit("e"), sign, two)
        text = _cases(
            [
                (count == 0, F.lit("0.0")),
                ((power < -4) | (power >= 16), scientific),
                (point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)),
                (point >= count, F.concat(digits, F.repeat(F.lit("0"), point - count), F.lit(".0"))),
            ],
            F.concat(digits.substr(F.lit(1), point), F.lit("."), digits.substr(point + 1, count)),
        )
        return F.concat(F.when(parts["negative"], F.lit("-")).otherwise(""), text)

    infinite = F.abs(number.cast("double")) == float("inf")
    endless = F.when(number.startswith("-"), F.lit("-Infinity")).otherwise("Infinity")
    return F.when(infinite, endless).otherwise(_let(_shortest(number), laid_out))


def _written(token: Column) -> Column:
    """A token as it is written again."""
    return _cases(
        [
            (token.startswith('"'), _string(token)),
            (token == "-0", F.lit("0")),
            (token.rlike(r"^-?[0-9]+[.eE]"), _float(token)),
        ],
        token,
    )


def _kind(token: Column) -> Column:
    """One letter for a token: its own for punctuation, ``s`` string, ``n`` other value, ``x`` neither."""
    return _cases(
        [
            (token.isin(*"{}[]:,"), token),
            (token.startswith('"') & (F.length(token) > 1), F.lit("s")),
            (token.rlike(r"^(?:-?[0-9]|true$|false$|null$|NaN$|-?Infinity$)"), F.lit("n")),
        ],
        F.lit("x"),
    )


def _is_json(kinds: Column) -> Column:
    """Whether the kinds of all tokens make one JSON value.

    ``next`` says what may follow: ``v`` a value, ``a`` a value or the end of the array, ``o`` a key
    or the end of the object, ``k`` a key, ``c`` a colon, ``e`` the end of a value, ``x`` nothing.
    """

    def step(state: Column, kind: Column) -> Column:
        follows, open_ = state["next"], state["open"]
        value = follows.isin("v", "a")
        inside = F.right(open_, F.lit(1))
        closes = F.when(kind == "}", (inside == "{") & follows.isin("e", "o")).otherwise(
            (inside == "[") & follows.isin("e", "a")
        )
        after = _cases(
            [
                (kind == "s", F.when(value, "e").when(follows.isin("o", "k"), "c").otherwise("x")),
                (kind == "n", F.when(value, "e").otherwise("x")),
                (kind == "{", F.when(value & (F.length(open_) < MAX_DEPTH), "o").otherwise("x")),
                (kind == "[", F.when(value & (F.length(open_) < MAX_DEPTH), "a").otherwise("x")),
                (kind == ":", F.when(follows == "c", "v").otherwise("x")),
                (
                    kind == ",",
                    F.when((follows == "e") & (inside == "{"), "k")
                    .when((follows == "e") & (inside == "["), "v")
                    .otherwise("x"),
                ),
                (kind.isin("}", "]"), F.when(closes, "e").otherwise("x")),
            ],
            F.lit("x"),
        )
        opened = _cases(
            [
                (follows == "x", open_),
                (kind.isin("{", "["), F.concat(open_, kind)),
                (kind.isin("}", "]"), open_.substr(F.lit(1), F.length(open_) - 1)),
            ],
            open_,
        )
        return F.struct(F.when(follows == "x", "x").otherwise(after).alias("next"), opened.alias("open"))

    start = F.struct(F.lit("v").alias("next"), F.lit("").alias("open"))
    return F.aggregate(kinds, start, step, lambda end: (end["next"] == "e") & (end["open"] == ""))


def _joined(tokens: Column) -> Column:
    spaced = F.transform(
        tokens, lambda t: F.when(t == ",", F.lit(", ")).when(t == ":", F.lit(": ")).otherwise(t)
    )
    return F.array_join(spaced, "")


_FRAMES = "array<struct<kind: string, key: string, keys: array<string>, parts: array<string>>>"


def _built(tokens: Column) -> Column:
    """The text of valid tokens, where a repeated key of an object keeps its first place and last value."""

    def frame(kind: Column, key: Column, keys: Column, parts: Column) -> Column:
        return F.struct(kind.alias("kind"), key.alias("key"), keys.alias("keys"), parts.alias("parts"))

    none = F.array().cast("array<string>")
    no_key = F.lit(None).cast("string")

    def below(frames: Column) -> Column:
        return F.slice(frames, F.lit(1), F.size(frames) - 1)

    def put(frames: Column, value: Column) -> Column:
        def into(top: Column) -> Column:
            place = F.array_position(top["keys"], top["key"])
            replaced = F.concat(
                F.slice(top["parts"], F.lit(1), (place - 1).cast("int")),
                F.array(value),
                F.slice(top["parts"], (place + 1).cast("int"), F.size(top["parts"])),
            )
            added = F.array_append(top["parts"], value)
            return _cases(
                [
                    (top["kind"] != "{", frame(top["kind"], no_key, top["keys"], added)),
                    (place > 0, frame(top["kind"], no_key, top["keys"], replaced)),
                ],
                frame(top["kind"], no_key, F.array_append(top["keys"], top["key"]), added),
            )

        return F.array_append(below(frames), _let(F.element_at(frames, -1), into))

    def close(top: Column) -> Column:
        members = F.zip_with(top["keys"], top["parts"], lambda key, part: F.concat(key, F.lit(": "), part))
        return F.when(top["kind"] == "{", F.concat(F.lit("{"), F.array_join(members, ", "), F.lit("}"))).otherwise(
            F.concat(F.lit("["), F.array_join(top["parts"], ", "), F.lit("]"))
        )

    def step(frames: Column, token: Column) -> Column:
        top = F.element_at(frames, -1)
        awaits_key = (top["kind"] == "{") & top["key"].isNull()
        return _cases(
            [
                (token.isin(",", ":"), frames),
                (token.isin("{", "["), F.array_append(frames, frame(token, no_key, none, none))),
                (token.isin("}", "]"), _let(_let(top, close), lambda value: put(below(frames), value))),
                (awaits_key, F.array_append(below(frames), frame(top["kind"], token, top["keys"], top["parts"]))),
            ],
            put(frames, token),
        )

    start = F.array(frame(F.lit("top"), no_key, none, none)).cast(_FRAMES)
    return F.aggregate(tokens, start, step, lambda frames: F.array_join(frames[0]["parts"], ""))


def redump(text: Column) -> Column:
    """One JSON text written again; no JSON becomes a JSON string, NULL stays NULL.

    Use it on a plain column or a lambda's argument: the text is read more than once.
    """

    def from_tokens(tokens: Column) -> Column:
        def from_written(written: Column) -> Column:
            keys = F.filter(written, lambda token, i: token.startswith('"') & (F.get(written, i + 1) == ":"))
            repeated = _let(keys, lambda found: F.size(F.array_distinct(found)) < F.size(found))
            return F.when(repeated, _built(written)).otherwise(_joined(written))

        valid = _is_json(F.transform(tokens, _kind))
        return F.when(valid, _let(F.transform(tokens, _written), from_written)).otherwise(quoted(text))

    tokens = F.filter(
        F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), lambda token: ~token.rlike(r"^[ \t\n\r]")
    )
    return F.when(text.isNotNull(), _let(tokens, from_tokens))
