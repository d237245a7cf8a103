"""The first JSON of texts and its repair."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from marlstone.functions import jsons, text


@pytest.mark.parametrize(
    ("said", "value"),
    [
        ('before {"a": 1} and {"b": 2}', {"a": 1}),
        ("{braces} in prose, then [1, 2]", [1, 2]),
        ('{"s": "a } in \\" a string", "t": [1, {"u": null}]} tail }', {"s": 'a } in " a string', "t": [1, {"u": None}]}),
        ("{'a': 'it''s', 'b': True, 'c': None}", {"a": "it''s", "b": True, "c": None}),
        ('{"a": [1, 2, 3,], "b": 2,}', {"a": [1, 2, 3], "b": 2}),
        ('{"a": [1, 2, {"b": "cut he', {"a": [1, 2, {"b": "cut he"}]}),
        ('{"a": 1 "b": 2}', {"a": 1, "b": 2}),
        ("{a: 1, b: some, c: -2.5e3}", {"a": 1, "b": "some", "c": -2500.0}),
        ('{"a": "line\nbreak", "b": "say "hi" now"}', {"a": "line\nbreak", "b": 'say "hi" now'}),
        ('{"a": 1, // told\n "b": /* in between */ 2}', {"a": 1, "b": 2}),
        ('{"a": , "b"}', {"a": None, "b": None}),
        ('{"a": [1, 2}, "b": 3', {"a": [1, 2]}),
        ('```json\n{"a": "C:\\dir\\new"}\n```', {"a": "C:\\dir\new"}),
        ("[1 2 3", [1, 2, 3]),
        ("[007, 1.]", ["007", "1."]),
        ('{"a": "\\u00e9\\u12"}', {"a": "é\\u12"}),
    ],
)
def test_by_hand(said, value):
    assert json.loads(jsons.first_value(said)) == value


@pytest.mark.parametrize("said", [None, "", "no json", "] }", '"only a string"', "12"])
def test_nothing_opens(said):
    assert jsons.first_value(said) is None


def test_cut_values_keep_what_was_whole():
    rnd = random.Random(2)

    def value(depth):
        kind = rnd.choice("osnla" if depth else "snl")
        if kind == "o":
            return {f"k{i}": value(depth - 1) for i in range(rnd.randint(0, 3))}
        if kind == "a":
            return [value(depth - 1) for _ in range(rnd.randint(0, 3))]
        return {"s": "".join(rnd.choices('ab "{}[],:\\\n', k=6)), "n": rnd.randint(-99, 99), "l": rnd.choice([True, False, None])}[kind]

    for _ in range(300):
        whole = {"first": value(3), "second": value(3)}
        said = json.dumps(whole)
        assert json.loads(jsons.first_value("so: " + said + " end")) == whole
        for cut in range(1, len(said)):
            assert isinstance(json.loads(jsons.first_value(said[:cut])), dict)
        after_first = json.dumps({"first": whole["first"]})[:-1]
        assert json.loads(jsons.first_value(after_first)) == {"first": whole["first"]}
        assert json.loads(jsons.first_value(after_first + ', "sec')) == {"first": whole["first"], "sec": None}


def test_time_grows_with_the_text():
    def seconds(n):
        began = time.process_time()
        for said in ("[" * n, "{'a':" * n, "[}" * n, '{"a" ' * n, "\\" * n + '{"' + "\\" * n):
            jsons.first_value(said)
        return time.process_time() - began

    seconds(1000)
    assert seconds(40_000) < 30 * max(seconds(4000), 0.01)


def test_columns(spark):
    df = spark.createDataFrame([(1, 'x {"k": 5,} y'), (2, None), (3, "none"), (4, '{"k": "' + "w" * 300_000)], "id int, t string")
    got = {r.id: r.k for r in df.select("id", F.try_variant_get(text.first_json(F.col("t")), "$.k", "string").alias("k")).collect()}
    assert got == {1: "5", 2: None, 3: None, 4: "w" * 300_000}
