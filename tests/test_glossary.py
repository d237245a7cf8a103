"""Glossary terms by one automaton against a search for each place and term, and the time for many terms."""

import random
import time

from pyspark.sql import functions as F

from marlstone.operators import glossary


def brute_force(text, terms):
    """All whole-word places, the longest first, then by term and place."""
    word = lambda c: c.isalnum() or c == "_"
    low = text.lower()
    places = []
    for rank, term in enumerate(sorted(set(terms), key=lambda t: (-len(t), t))):
        for i in range(len(text) - len(term) + 1):
            if low[i : i + len(term)] == term.lower() and not (i and word(text[i - 1])) and not (i + len(term) < len(text) and word(text[i + len(term)])):
                places.append((rank, term, i, i + len(term)))
    out = []
    for _, term, a, b in sorted(places, key=lambda p: (p[0], p[2])):
        if all(b <= x or y <= a for _, x, y in out):
            out.append((term, a, b))
    return sorted(out, key=lambda x: x[1])


def test_places_equal_brute_force():
    rnd = random.Random(1)
    words = ["a", "b", "ab", "É", "c_d", "x-y", "12"]
    for _ in range(400):
        terms = list({" ".join(rnd.choices(words, k=rnd.randint(1, 3))) for _ in range(rnd.randint(1, 8))})
        text = "".join(rnd.choice([w, w.upper()]) + rnd.choice([" ", " ", "-", "", "."]) for w in rnd.choices(words, k=rnd.randint(0, 14)))
        assert glossary.Finder(terms).places(text) == brute_force(text, terms)


def test_odd_terms_and_texts():
    assert glossary.Finder([]).places("x") == [] and glossary.Finder(["", "x"]).places("") == []
    # a letter whose lower case is two: the others keep their places
    assert glossary.Finder(["term"]).places("İ İ term İ") == [("term", 4, 8)]
    assert glossary.Finder(["RGB", "rgb"]).places("an Rgb") == [("RGB", 3, 6)]


def test_many_terms_take_about_the_time_of_few():
    rnd = random.Random(2)
    text = " ".join("".join(rnd.choices("abcdefgh", k=6)) for _ in range(30_000))
    few, many = (glossary.Finder(["".join(rnd.choices("abcdefgh", k=6)) for _ in range(n)]) for n in (10, 50_000))

    def seconds(finder):
        began = time.process_time()
        finder.places(text)
        return time.process_time() - began

    seconds(few)
    assert seconds(many) < 8 * max(min(seconds(few) for _ in range(3)), 0.01)


def test_marks_of_many_matches(spark):
    text = "red x " * 60_000
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "no term")], "id int, text string")
    df = df.withColumn("m", glossary.find_terms(df, ["red"]))
    got = {r.id: r.marked for r in df.select("id", glossary.highlight(F.col("text"), F.col("m"), "<", ">").alias("marked")).collect()}
    assert got == {1: "<red> x " * 60_000, 2: None, 3: "", 4: "no term"}
    cut = df.filter("id = 1").withColumn("m", glossary.find_terms(df, ["red"], limit=9))
    assert cut.select(glossary.highlight(F.col("text"), F.col("m"), limit=9).alias("marked")).first().marked == "**red** x **red**"
