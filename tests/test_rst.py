"""Blocks of code in reStructuredText, nested, indented and cut off."""

import time

import pytest
from pyspark.sql import functions as F

from marlstone.operators import extract, rst


@pytest.mark.parametrize(
    ("text", "codes"),
    [
        ("Intro::\n\n    literal = 1\n\n      more\n\nText\n", ["literal = 1\n\n  more"]),
        (".. code-block:: python\n   :linenos:\n   :caption: x\n\n   def f():\n       pass\n\nEnd", ["def f():\n    pass"]),
        ("* item\n\n  .. note::\n     :class: x\n\n     told::\n\n        nested = 2\n\n  * inner\n\n    .. code:: sh\n\n       ls\n", ["nested = 2", "ls"]),
        ("1. first::\n\n     a\n\n2. second\n", ["a"]),
        (">>> 1 + 1\n2\n>>> x\n\nText >>> no\n", [">>> 1 + 1\n2\n>>> x"]),
        (".. parsed-literal::\n\n   *a*\n   b\n.. a comment\n   x::\n\n      no\n", ["*a*\nb"]),
        ("Ends::\n\nnot further in\n", []),
        ("Cut off::\n\n    x = (", ["x = ("]),
        (".. code-block:: python\n\n   a\n\n\n   b\n   \nEnd", ["a\n\n\nb"]),
        (".. code-block::\n   x = 1", ["x = 1"]),
        ("\t.. code-block:: c\n\n\t\tint a;\n", ["int a;"]),
        ("", []),
    ],
)
def test_by_hand(text, codes):
    assert [b["code"] for b in rst.code_blocks(text)] == codes


def test_languages_lines_and_paragraphs():
    found = rst.code_blocks("Some words\nover two lines:\n\n.. code-block:: go\n\n   x := 1\n\nThen::\n\n  y\n")
    assert [(b["language"], b["line"], b["description"]) for b in found] == [("go", 4, "Some words over two lines:"), (None, 10, "Then:")]


def test_time_grows_with_the_text():
    def seconds(n):
        began = time.process_time()
        for piece in ("Text::\n\n  code\n\n", "* ", ".. note::\n\n ", "  x\n", "Text::\n"):
            rst.code_blocks(piece * n)
        return time.process_time() - began

    seconds(100)
    assert seconds(20_000) < 25 * max(seconds(2000), 0.01)


def test_columns(spark):
    text = "Intro::\n\n    literal = 1\n\n* item\n\n  .. code-block:: python\n\n    def f():\n        pass\n\nEnd\n"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string")
    assert {r.id: r.c for r in df.select("id", extract.rst_code(F.col("t")).alias("c")).collect()} == {1: ["literal = 1", "def f():\n    pass"], 2: None, 3: []}
