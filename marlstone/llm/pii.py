"""Personal data by patterns that the corpus itself teaches.

Entities found by fixed rules (e-mail, IP, payment card, phone) are the seeds.
Their contexts are lexical patterns: the word before, the two words before, the
words on both sides. Patterns and instances (seeds, and tokens that look like
identifiers) form a graph over the whole corpus; Spark scores it in rounds: the
confidence of a pattern is the share of known instances in all that stands at
its place, ordinary words that follow it included, so that ``the _`` is worth
nothing. Unknown instances of patterns of high confidence and support are known
in the next round, and support further patterns. Instances that were not seeds
are reported as ``learned`` spans, beside the seeds.

A token looks like an identifier if it has 6 or more characters and either four
or more digits, or ``@`` or ``_`` inside and no digit is needed.

Edge cases: a null or empty text has no spans. Copies count once, as instances
and followers are counted by their text. A corpus without seeds teaches no
pattern. Tables may be empty. A word cut by the edge of the window of WINDOW
characters is no context. Other columns of the input are kept by ``redact`` and
not read otherwise; rows are told apart by their texts, so null or repeated ids
do no harm, and columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import spans
from marlstone.llm.common import free_name, materialize

LOCAL = r"A-Za-z0-9._%+-"
#: The lookbehind and possessive forms find what the plain patterns do, in linear time and without recursion on long
#: runs. EMAIL is for texts whose dots all stand between characters of a domain, CARD for those whose separators do.
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9 -]+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Tokens that may be identifiers, and what makes them so.
TOKEN = r"(?<![A-Za-z0-9_@./:+-])(?=[A-Za-z./:+-]*+[0-9_@])[A-Za-z0-9_@./:+-]++"
HANDLE = r"^@[A-Za-z]|[A-Za-z]_[A-Za-z]"
#: What stands for no word when ordinary followers are counted: anything that may be or belong to an instance.
MARKED = r"(?<!\S)[^\s0-9@_]*+[0-9@_]\S*+"
BREAK = r"[\s\p{Punct}]+"

ROUNDS, MIN_CONFIDENCE, MIN_SUPPORT, WINDOW = 3, 0.9, 5, 96
#: One text in so many is looked at first, to rule out patterns that too many ordinary words follow.
FIRST_LOOK = 64


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right doubled, less 9 above 9; the sum ends in 0."""

    def value(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, i: total + value(i)) % 10 == 0


def _card(match: Column) -> Column:
    digits = _digits(match)
    return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)


def _ip(match: Column) -> Column:
    short = F.transform(F.split(match, r"\."), lambda part: F.ltrim(part, F.lit("0")))
    return F.forall(short, lambda part: (F.length(part) <= 2) | ((F.length(part) == 3) & (part <= "255")))


def seeds(text: Column) -> Column:
    """The spans of the fixed rules, by kind, then start."""
    # a dot that does not stand between characters of a domain ends it: made another character of a local part
    domains = F.regexp_replace(text, r"(?<![A-Za-z0-9-])\.|\.(?![A-Za-z0-9-])", "_")
    # a separator that does not stand between two digits ends a number: made a letter; both keep all places
    numbers = F.regexp_replace(text, "(?<![0-9])[ -]|[ -](?![0-9])", "x")
    return spans.by_rank(
        F.concat(
            F.when(text.rlike("@[A-Za-z0-9-]"), spans.find(domains, "email", 0, EMAIL)).otherwise(spans.no_spans()),
            spans.find(text, "ip", 1, IP, _ip),
            F.when(text.rlike("[0-9](?:[ -]?[0-9]){12}"), spans.find(numbers, "card", 2, CARD, _card)).otherwise(spans.no_spans()),
            spans.find(text, "phone", 3, PHONE, lambda m: F.length(_digits(m)).between(9, 15)),
        )
    )


def _apart(tokens: Column, known: Column) -> Column:
    """Those of ``tokens`` that meet none of ``known``: both are merged by start, and each token is held against
    the farthest end before it and the next start after it, so a long listing takes no quadratic time."""
    far = 2**31 - 1
    is_token = lambda s: s["rank"] == 4

    def free(merged: Column) -> Column:
        ends = spans.running(F.transform(merged, lambda s: F.when(is_token(s), 0).otherwise(s["end"])), lambda x, y: F.greatest(x, y))
        nearness = spans.running(F.transform(F.reverse(merged), lambda s: F.when(is_token(s), 0).otherwise(F.lit(far) - s["start"])), lambda x, y: F.greatest(x, y))
        placed = F.zip_with(F.zip_with(merged, ends, lambda s, end: F.struct(s.alias("s"), end.alias("end"))), F.reverse(nearness), lambda x, n: F.struct(x["s"].alias("s"), x["end"].alias("end"), (F.lit(far) - n).alias("next")))
        return F.transform(F.filter(placed, lambda x: is_token(x["s"]) & (x["end"] <= x["s"]["start"]) & (x["next"] >= x["s"]["end"])), lambda x: x["s"])

    # the merged spans are bound once, as the one element of an array
    return F.flatten(F.transform(F.array(spans.by_start(F.concat(tokens, known))), free))


def _candidates(text: Column, known: Column) -> Column:
    """Tokens that look like identifiers and do not meet a seed."""
    found = spans.find(text, "learned", 4, TOKEN, lambda m: (F.length(m) >= 6) & ((F.length(_digits(m)) >= 4) | m.rlike(HANDLE)), hint="[0-9_@]")
    return F.flatten(F.transform(F.array(found), lambda tokens: F.when((F.size(tokens) == 0) | (F.size(known) == 0), tokens).otherwise(_apart(tokens, known))))


def _patterns(two_left: Column, one_left: Column, one_right: Column) -> Column:
    """The patterns of a place by the words around it; those that lack a word are left out."""
    all_three = F.array(F.concat(one_left, F.lit(" _")), F.concat(two_left, F.lit(" "), one_left, F.lit(" _")), F.concat(one_left, F.lit(" _ "), one_right))
    return F.filter(all_three, lambda p: p.isNotNull())


def _words(part: Column) -> Column:
    return F.filter(F.split(F.lower(part), BREAK), lambda w: w != "")


def _in_context(text: Column, all_spans: Column) -> Column:
    """The spans with their text and the words around it, from a window of WINDOW characters on either side; words cut by its edge are left out."""

    def one(s: Column) -> Column:
        left = F.substring(text, F.greatest(s["start"] - WINDOW, F.lit(0)) + 1, F.least(s["start"], F.lit(WINDOW)))
        left = F.when(s["start"] > WINDOW, F.regexp_replace(left, r"^[^\s\p{Punct}]++", "")).otherwise(left)
        right = F.substring(text, s["end"] + 1, F.lit(WINDOW))
        right = F.when(s["end"] + WINDOW < F.length(text), F.regexp_replace(right, r"(?<![^\s\p{Punct}])[^\s\p{Punct}]++$", "")).otherwise(right)
        words, after = _words(left), _words(right)
        return F.struct(
            s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"),
            F.lower(F.substring(text, s["start"] + 1, s["end"] - s["start"])).alias("instance"),
            _patterns(F.get(words, F.size(words) - 2), F.get(words, F.size(words) - 1), F.get(after, F.lit(0))).alias("patterns"),
        )

    return F.transform(all_spans, one)


def text_key(text: Column) -> Column:
    """What tells texts apart."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def entities(df: DataFrame, keep: list, text_col: str = "text") -> DataFrame:
    """Per row the columns ``keep``, the key of its text, its seeds and all spans in context; one pass over the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = [free_name(df, n) for n in ("text_key", "text", "seeds", "all")]
    base = df.select("*", text_key(text).alias(names[0]), text.alias(names[1])).withColumn(names[2], seeds(F.col(names[1])))
    found = base.withColumn(names[3], F.concat(names[2], _candidates(F.col(names[1]), F.col(names[2]))))
    return found.select(*keep, F.col(names[0]).alias("text_key"), F.col(names[2]).alias("seeds"), _in_context(F.col(names[1]), F.col(names[3])).alias("mentions"))


def edges_of(found: DataFrame) -> DataFrame:
    """The graph: (pattern, instance, seed), each pair once; seed is 1 if the instance is a seed anywhere."""
    mentions = found.select(F.explode("mentions").alias("m"))
    pairs = mentions.select(F.explode("m.patterns").alias("pattern"), F.col("m.instance").alias("instance"), (F.col("m.kind") != "learned").cast("int").alias("seed"))
    return pairs.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))


def _mark(kind: int, *words: Column) -> Column:
    """A number for a pattern of a kind; equal patterns have equal ones."""
    return F.xxhash64(F.lit(kind), *words)


def followers(df: DataFrame, patterns: DataFrame, text_col: str = "text") -> DataFrame:
    """How many different ordinary words stand at the place of each of ``patterns`` (pattern), for those that have some: (pattern, others)."""
    words = _words(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), MARKED, " \uE000 "))
    inside = F.filter(F.sequence(F.lit(0), F.size("w")), lambda i: (i >= 1) & (i < F.size("w")))
    at = F.transform(inside, lambda i: F.struct(F.when(i > 1, F.get("w", i - 2)).alias("two"), F.get("w", i - 1).alias("one"), F.get("w", i).alias("word"), F.get("w", i + 1).alias("next")))
    places = df.select(words.alias("w")).select(F.inline(at)).filter("word <> '\uE000' AND one <> '\uE000'")
    # a place is held against whole patterns, by a number for each; a join by the word before alone would keep most of the corpus for one pattern of "the"
    own, piece = F.split("pattern", " "), lambda i: F.get(F.split("pattern", " "), F.lit(i))
    mark = F.when(F.size(own) == 2, _mark(0, piece(0))).when(piece(1) == "_", _mark(2, piece(0), piece(2))).otherwise(_mark(1, piece(0), piece(1)))
    marks = F.array(_mark(0, F.col("one")), _mark(1, F.col("two"), F.col("one")), _mark(2, F.col("one"), F.col("next")))
    met = places.select("*", F.explode(marks).alias("mark")).join(patterns.select(mark.alias("mark")).distinct(), "mark", "left_semi")
    placed = met.select("word", F.explode(_patterns(F.col("two"), F.col("one"), F.col("next"))).alias("pattern"))
    return placed.join(patterns.select("pattern"), "pattern", "left_semi").distinct().groupBy("pattern").agg(F.count("*").alias("others"))


def learn_patterns(df: DataFrame, found: DataFrame, text_col: str = "text", hold_out: int = 0) -> tuple[DataFrame, DataFrame]:
    """The patterns that are trusted after ROUNDS rounds (pattern, confidence, support), and the graph that they were learned from.

    With ``hold_out`` seeds whose hash is divisible by it are taken for unknown,
    to measure what is found again.
    """
    edges = edges_of(found)
    if hold_out:
        edges = edges.withColumn("seed", F.when(F.pmod(F.xxhash64("instance"), F.lit(hold_out)) == 0, 0).otherwise(F.col("seed")))
    edges = materialize(edges, "pii-edges")
    supported = materialize(edges.groupBy("pattern").agg(F.count("*").alias("instances")).filter(F.col("instances") >= MIN_SUPPORT), "pii-candidates")
    # what some texts show against a pattern all texts do: it is out, and the others are counted over all texts
    look = df.filter(F.pmod(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.lit(FIRST_LOOK)) == 0)
    possible = F.coalesce("others", F.lit(0)) * MIN_CONFIDENCE <= F.col("instances") * (1 - MIN_CONFIDENCE) + 1e-9
    left = supported
    for texts in (look, df):
        left = materialize(left.select("pattern", "instances").join(followers(texts, left, text_col), "pattern", "left").filter(possible), "pii-possible")
    sizes = left.select("pattern", (F.col("instances") + F.coalesce("others", F.lit(0))).alias("fillers"))
    graph = materialize(edges.join(sizes, "pattern"), "pii-graph")
    known, trusted = graph.withColumn("known", F.col("seed")), None
    for _ in range(ROUNDS):
        share = F.col("support") / F.col("fillers")
        trusted = known.groupBy("pattern").agg(F.max("fillers").alias("fillers"), F.sum("known").alias("support")).select("pattern", share.alias("confidence"), "support")
        trusted = materialize(trusted.filter((F.col("confidence") >= MIN_CONFIDENCE) & (F.col("support") >= MIN_SUPPORT)), "pii-patterns")
        new = graph.join(trusted.select("pattern"), "pattern", "left_semi").select("instance", F.lit(1).alias("new")).distinct()
        known = graph.join(new, "instance", "left").select("pattern", "instance", "seed", "fillers", F.greatest("seed", F.coalesce("new", F.lit(0))).alias("known"))
    return trusted, graph


def measure(df: DataFrame, text_col: str = "text", hold_out: int = 5) -> DataFrame:
    """One row of what held-out seeds show: how many there are, how many of them the learned patterns find, and how many instances they find that are no seeds."""
    found = materialize(entities(df, [], text_col), "pii-entities")
    trusted, graph = learn_patterns(df, found, text_col, hold_out)
    real = edges_of(found).groupBy("instance").agg(F.max("seed").alias("real"))
    hits = graph.filter("seed = 0").join(trusted.select("pattern"), "pattern", "left_semi").select("instance").distinct().withColumn("hit", F.lit(1))
    held = (F.col("real") == 1) & (F.pmod(F.xxhash64("instance"), F.lit(hold_out)) == 0)
    rows = real.join(hits, "instance", "left").select(held.alias("held"), "real", "hit")
    return rows.agg(F.count_if("held").alias("held_out"), F.count_if(F.col("held") & (F.col("hit") == 1)).alias("found_again"), F.count_if((F.col("real") == 0) & (F.col("hit") == 1)).alias("found_besides"))


def learned_spans(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """Per text that has some, the spans that the patterns select: (text_key, learned)."""
    unknown = found.select("text_key", F.explode(F.filter("mentions", lambda m: m["kind"] == "learned")).alias("m"))
    picked = unknown.select("text_key", "m", F.explode("m.patterns").alias("pattern")).join(patterns.select("pattern"), "pattern")
    span = F.struct(*(F.col(f"m.{c}").alias(c) for c in ("start", "rank", "kind", "end")))
    return picked.groupBy("text_key").agg(F.array_sort(F.collect_set(span)).alias("learned"))


def find_pii(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Per row the columns ``keep``, its seeds, and all spans by kind, then start; both as arrays of spans."""
    inside = [f"_keep{i}" for i in range(len(keep))]
    found = materialize(entities(df, [F.col(c).alias(i) for c, i in zip(keep, inside, strict=True)], text_col), "pii-entities")
    learned = learned_spans(found, learn_patterns(df, found, text_col)[0])
    both = found.select(*inside, "text_key", "seeds").join(learned, "text_key", "left")
    return both.select(*(F.col(i).alias(c) for c, i in zip(keep, inside, strict=True)), "seeds", F.concat("seeds", F.coalesce("learned", spans.no_spans())).alias("spans"))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with every span of personal data replaced by its kind in brackets; null texts stay null. All rows and columns stay."""
    found = materialize(entities(df.select(text_col), [], text_col), "pii-entities")
    learned = materialize(learned_spans(found, learn_patterns(df, found, text_col)[0]), "pii-learned")
    text, key, more = F.col(text_col), free_name(df, "_pii_key"), free_name(df, "_pii_learned")

    def cut(own: Column) -> Column:
        at = spans.running(F.transform(own, lambda s: s["end"]), lambda x, y: F.greatest(x, y))
        placed = F.zip_with(own, at, lambda s, at: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), at.alias("at")))
        free = F.filter(placed, lambda s: s["start"] >= s["at"])
        kept = F.transform(free, lambda s: F.concat(F.substring(text, s["at"] + 1, s["start"] - s["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.concat(F.array_join(kept, ""), F.substring(text, F.coalesce(F.array_max(F.transform(own, lambda s: s["end"])), F.lit(0)) + 1, F.length(text)))

    all_spans = spans.by_start(F.concat(seeds(text), F.coalesce(more, spans.no_spans())))
    keyed = df.withColumn(key, text_key(text))
    with_learned = keyed.join(learned.select(F.col("text_key").alias(key), F.col("learned").alias(more)), key, "left")
    return with_learned.withColumn(text_col, F.when(text.isNotNull(), F.get(F.transform(F.array(all_spans), cut), F.lit(0)))).select(*df.columns)
