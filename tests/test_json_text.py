import json
import random

import pytest
from pyspark.sql import functions as F

from tracemill import fixed
from tracemill.functions.json_text import redump


def expected(text):
    try:
        return json.dumps(json.loads(text))
    except json.JSONDecodeError:
        return json.dumps(text)


def native(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(8)
    found = rows.select("i", redump(F.col("text")).alias("out")).collect()
    return {row.i: row.out for row in found}


def differing(spark, texts):
    out = native(spark, texts)
    return [(t, out[i], expected(t)) for i, t in enumerate(texts) if out[i] != expected(t)]


HAND = [
    "{}", "[]", " { } ", "[ ]", "", " ", "null", "true", "nul", "truex", "NaN", "-Infinity", "Infinity", "-", "--1",
    '{"b": 1, "a": [1,2 , {"c":null}]}', '{"a":1,"a":2}', '{"a":1,"b":{"a":3,"a":[]},"a":{"x":[1,{"a":2}]}}',
    '[{"a":1},{"a":2}]', '{"a" 1}', '{"a":1,}', "[1,]", "[,1]", "[1 2]", "{1:2}", '{"a":}', '{"a":1', "[1}", '{"a":1]',
    "1 2", "01", "-0", "0", "-0.0", "1.", ".5", "1.0", "1e5", "1E+2", "1e16", "1e15", "123456789012345678", "1e22",
    "1e-4", "1e-5", "0.0001", "0.00001234", "123456.789e3", "1.5e300", "1e400", "-1e400", "1e-400", "2e23", "1e23",
    "0.1000", "100.0", "5.6843418860808015e-14", "2.2250738585072014e-308", "5e-324", "1.7976931348623157e308",
    "0.30000000000000004", "9007199254740993.0", "12345678901234567890.5", "0e7", "1e99999999999999999999",
    "9" * 400, '"a\\/b\\u0041\\u00e9\\u00E9\\u001f\\u0022\\u005c\\n\\u000a\\u007f"', '"é\x7f😀\\ud83d\\ude00\\ud83d"',
    '"tab\there"', '"line\nbreak"', '"bad \\x escape"', '"\\u12g4"', '"open', 'plain "text" \\ é😀\n\r\t\x08\x0c\x01',
    "﻿{}", "{} ", "\u000b{}", '{"é":1,"\\u00e9":2}', '{"":{"":0}}', "\t[1]\n", '"' + "x" * 70000 + '"',
    "[" * 900 + "]" * 900, json.dumps([{"k": i, "s": "v" * (i % 7)} for i in range(300)]), '["a","b"]:', '{"a":"b":"c"}',
]


def test_hand_cases(spark):
    assert differing(spark, HAND) == []


def test_random_values_and_broken_ones(spark):
    rng = random.Random(5)

    def value(depth):
        kind = rng.randrange(9 if depth else 7)
        if kind == 0:
            return rng.choice([None, True, False, 0, -1, 10**25])
        if kind in (1, 2):
            return rng.choice([rng.random(), rng.uniform(-1e6, 1e6), rng.random() * 10.0 ** rng.randint(-300, 300)])
        if kind in (3, 4, 5, 6):
            return "".join(rng.choice('ab "\\/\n\t\x02é€😀{}[],:') for _ in range(rng.randrange(6)))
        if kind == 7:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        return {rng.choice("abcé\""): value(depth - 1) for _ in range(rng.randrange(4))}

    texts = []
    for _ in range(1500):
        text = json.dumps(value(4), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        if rng.random() < 0.3 and text:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(['"', ",", "}", "]", "", "0", "e", "{"]) + text[at + 1 :]
        texts.append(text)
    wrong = differing(spark, texts)
    assert wrong == []


def test_null_and_depth(spark):
    deep = "[" * 5000 + "]" * 5000
    assert native(spark, [None, deep]) == {0: None, 1: json.dumps(deep)}


@pytest.mark.parametrize("text", [None, "{}", "x"])
def test_missing_arguments(spark, text):
    from tracemill.functions.text import native_arguments

    rows = spark.createDataFrame([([text],), (None,)], "texts array<string>")
    out = [row[0] for row in rows.select(native_arguments(F.col("texts"))).collect()]
    assert out == [[expected(fixed.NO_ARGUMENTS if text is None else text)], None]


def test_no_python_in_the_plan(spark, capsys):
    from tracemill.catalog.queries import all_queries

    all_queries()["m2_native_arguments"](spark, "/root/testdata/sf0.001").explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Pandas" not in plan
