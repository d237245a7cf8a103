"""Full-text, tag, keyword and vector search over DataFrames of documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import vector
from marlstone.functions.fuzzy import best_word_ratio
from marlstone.functions.text import WORD, tokens

FIELDS = ("title", "content", "description", "tags")
K1, B = 1.2, 0.75


def query_terms(query: str) -> list[str]:
    """Distinct lower-case words of a query, in order."""
    return list(dict.fromkeys(regex.findall(WORD, (query or "").lower())))


def _as_text(df: DataFrame, field: str) -> Column:
    return F.array_join(field, " ") if dict(df.dtypes)[field].startswith("array") else F.col(field)


def with_filters(df: DataFrame, filter_expr: str | None = None, tags: Sequence[str] | None = None, all_tags: bool = True) -> DataFrame:
    """Rows that meet an expression and hold all (or any) of the tags."""
    if filter_expr:
        df = df.filter(F.expr(filter_expr))
    if tags:
        have = F.coalesce("tags", F.array().cast("array<string>"))
        wanted = F.lit(list(tags))
        df = df.filter(F.size(F.array_except(wanted, have)) == 0 if all_tags else F.arrays_overlap(have, wanted))
    return df


def _whole_word(term: str) -> str:
    """A word as a pattern that no longer word meets."""
    inside = WORD[:-1]
    return rf"(?<!{inside}){regex.escape(term)}(?!{inside})"


def _occurrences(low: Column, term: str) -> Column:
    """How often a lower-case text has a word; texts without these letters are not searched for it."""
    return F.when(low.contains(term), F.regexp_count(low, F.lit(_whole_word(term)))).otherwise(0)


def _holds(low: Column, term: str) -> Column:
    return low.contains(term) & low.rlike(_whole_word(term))


def bm25_scores(df: DataFrame, query: str, fields: Sequence[str] = FIELDS, boosts: Mapping[str, float] | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """``df`` with ``score``: Okapi BM25 summed over fields; documents without any term are left out.

    Corpus statistics come from one aggregation that keeps a few numbers for each
    term; the second pass scores the rows that hold a term, each by itself. Words
    are counted, not listed, and nothing is shuffled. For many queries over one
    collection build a view instead.
    """
    terms, fields = query_terms(query), [f for f in fields if f in df.columns]
    if not terms or not fields:
        return df.limit(0).withColumn("score", F.lit(0.0))
    low = {f: F.lower(F.coalesce(_as_text(df, f), F.lit(""))) for f in fields}
    length = {f: F.regexp_count(low[f], F.lit(WORD)) for f in fields}
    aggregates = [F.count("*").alias("n"), *(F.avg(length[f]).alias(f"avg_{f}") for f in fields)]
    aggregates += [F.count_if(_holds(low[f], t)).alias(f"df_{f}_{i}") for f in fields for i, t in enumerate(terms)]
    stats = df.agg(*aggregates).first()

    def of_field(f: str) -> Column:
        held = [(i, t) for i, t in enumerate(terms) if stats[f"df_{f}_{i}"]]
        if not held:
            return F.lit(0.0)

        def total(x: Column) -> Column:
            norm = F.lit(k1) * (F.lit(1 - b) + F.lit(b) * x["n"] / F.lit(float(stats[f"avg_{f}"])))
            parts = []
            for i, _ in held:
                idf = F.log(F.lit(1 + (stats["n"] - stats[f"df_{f}_{i}"] + 0.5) / (stats[f"df_{f}_{i}"] + 0.5)))
                tf = x[f"tf{i}"].cast("double")
                parts.append(idf * tf * F.lit(k1 + 1) / (tf + norm))
            return reduce(lambda a, c: a + c, parts)

        # the counts are bound once, as the one element of an array
        counts = F.struct(length[f].alias("n"), *(_occurrences(low[f], t).alias(f"tf{i}") for i, t in held))
        return F.lit(float((boosts or {}).get(f, 1.0))) * F.get(F.transform(F.array(counts), total), F.lit(0))

    found = reduce(lambda x, y: x | y, [_holds(low[f], t) for f in fields for t in terms])
    return df.filter(found).withColumn("score", reduce(lambda a, c: a + c, [of_field(f) for f in fields]))


def page(df: DataFrame, order: Sequence[Column], top_n: int, offset: int = 0) -> DataFrame:
    """Rows offset to offset + top_n in the given order."""
    df = df.orderBy(*order)
    return (df.offset(offset) if offset else df).limit(top_n)


def bm25_search(df: DataFrame, query_text: str, search_fields: Sequence[str] = FIELDS, filter_expr: str | None = None, min_score: float = 0.1, top_n: int = 10, offset: int = 0, tag_list: Sequence[str] | None = None, boosts: Mapping[str, float] | None = None) -> DataFrame:
    """A page of the documents by BM25, then key. Statistics cover the whole collection, filters its hits."""
    hits = with_filters(bm25_scores(df, query_text, search_fields, boosts), filter_expr, tag_list).filter(F.col("score") >= min_score)
    return page(hits, [F.desc("score"), F.asc("_key")], top_n, offset)


def bm25_total(df: DataFrame, query_text: str, search_fields: Sequence[str] = FIELDS, filter_expr: str | None = None, min_score: float = 0.1, tag_list: Sequence[str] | None = None) -> DataFrame:
    """How many documents a BM25 search has before paging."""
    return with_filters(bm25_scores(df, query_text, search_fields), filter_expr, tag_list).filter(F.col("score") >= min_score).agg(F.count("*").alias("total"))


def build_view(df: DataFrame, fields: Sequence[str] = FIELDS) -> tuple[DataFrame, DataFrame]:
    """An inverted index for many queries: postings (term, _key, field, tf, dl) and statistics (field, n, avg_dl).

    Written partitioned or bucketed by term, a query reads the postings of its terms alone.
    """
    fields = [f for f in fields if f in df.columns]
    words = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), tokens(_as_text(df, f)).alias("words")) for f in fields)))
    lists = df.select("_key", words.alias("f")).select("_key", "f.field", "f.words", F.size("f.words").alias("dl"))
    postings = lists.select("_key", "field", "dl", F.explode("words").alias("term")).groupBy("term", "_key", "field").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    return postings, lists.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl"))


def search_view(postings: DataFrame, stats: DataFrame, query_text: str, k1: float = K1, b: float = B) -> DataFrame:
    """(_key, score) of a query over a built view."""
    own = postings.filter(F.col("term").isin(query_terms(query_text)))
    holding = own.groupBy("term", "field").agg(F.count("*").alias("df"))
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg_dl")))
    return own.join(holding, ["term", "field"]).join(stats, "field").groupBy("_key").agg(F.sum(weight).alias("score"))


def tag_search(df: DataFrame, tags: Sequence[str], filter_expr: str | None = None, require_all_tags: bool = False, limit: int = 10, offset: int = 0, fields: Sequence[str] | None = None) -> DataFrame:
    """Documents with any or all tags (case counts), by key, with the share of the tags they hold (case does not count)."""
    have = F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower)
    matched = F.size(F.filter(F.lit([t.lower() for t in tags]), lambda t: F.array_contains(have, t)))
    found = with_filters(df, filter_expr, tags, require_all_tags).withColumn("tag_match_score", matched / F.lit(float(max(len(tags), 1))))
    if fields:
        found = found.select(*dict.fromkeys(["_key", "tags", *fields, "tag_match_score"]))
    return page(found, [F.asc("_key")], limit, offset)


def keyword_search(df: DataFrame, search_term: str, similarity_threshold: float = 97.0, top_n: int = 10, fields: Sequence[str] = ("title", "content"), tags: Sequence[str] | None = None, filter_expr: str | None = None) -> DataFrame:
    """Documents that hold the term: 1.0 as a part of a field, 0.9 as a word of it, else the best fuzzy ratio of a word from the threshold on.

    For the fuzzy comparison each different word is compared once, if its length
    allows the ratio at all; the few words that reach it are joined back by key.
    """
    if not search_term or not search_term.strip():
        raise ValueError("a search term is needed")
    term = search_term.strip().lower()
    first = query_terms(term)[0] if query_terms(term) else term
    rows = with_filters(df, filter_expr, tags)
    texts = [F.lower(F.coalesce(_as_text(df, f), F.lit(""))) for f in fields]
    part = reduce(lambda a, b: a | b, [t.contains(term) for t in texts])
    word = reduce(lambda a, b: a | b, [_holds(t, first) for t in texts])
    size, least = len(term), search_term_ratio(similarity_threshold)
    # 2 * min / (a + b) is the most that two lengths allow
    near = lambda w: (F.length(w) >= size * least / (2 - least) - 1e-9) & (F.length(w) * least <= size * (2 - least) + 1e-9)
    words = F.array_distinct(F.flatten(F.array(*(F.filter(tokens(_as_text(df, f)), near) for f in fields))))
    held = rows.select("_key", F.explode(words).alias("_word"))
    good = held.select("_word").distinct().withColumn("_ratio", best_word_ratio(F.array("_word"), F.lit(term)) / 100).filter(F.col("_ratio") >= least)
    best = held.join(good, "_word").groupBy("_key").agg(F.max("_ratio").alias("_ratio"))
    score = F.when(word & part, 1.0).when(word, 0.9).otherwise(F.col("_ratio"))
    return page(rows.join(best, "_key", "left").withColumn("keyword_score", score).filter("keyword_score IS NOT NULL").drop("_ratio"), [F.desc("keyword_score"), F.asc("_key")], top_n)


def search_term_ratio(threshold: float) -> float:
    """A similarity threshold in percent as a share."""
    return min(max(threshold, 0.0), 100.0) / 100


def semantic_search(df: DataFrame, query: Sequence[float], embedding_field: str = "embedding", filter_expr: str | None = None, min_score: float = 0.7, top_n: int = 10, tag_list: Sequence[str] | None = None, metric: str = "cosine") -> DataFrame:
    """The nearest documents by an exact measure; filters come before the scores. Vectors of another length are left out."""
    rows = with_filters(df, filter_expr, tag_list).filter(F.size(embedding_field) == len(query))
    e = F.col(embedding_field)
    score = {"cosine": lambda: vector.cosine_to(e, query), "dot": lambda: vector.dot(e, vector.literal(query)), "l2": lambda: vector.negative_l2(e, vector.literal(query))}[metric]()
    return page(rows.withColumn("score", score).filter(F.col("score") >= min_score), [F.desc("score"), F.asc("_key")], top_n)


def simple_vector_search(df: DataFrame, query: Sequence[float], embedding_field: str = "embedding", limit: int = 10) -> DataFrame:
    """As above without a threshold; vectors of another length score 0 and only positive scores stay."""
    e = F.col(embedding_field)
    scored = df.withColumn("score", F.when(F.size(e) == len(query), vector.cosine_to(e, query)).otherwise(0.0))
    return page(scored.filter("score > 0"), [F.desc("score"), F.asc("_key")], limit)


def knn_vote(df: DataFrame, query: Sequence[float], k: int = 25, label_col: str = "label", accept: float = 0.7) -> DataFrame:
    """One row: the label of most votes among the k nearest (squared positive scores; ties go to the least label), its share, and whether it is accepted."""
    near = semantic_search(df, query, min_score=-2.0, top_n=k)
    votes = near.filter("score > 0").groupBy(label_col).agg(F.sum(F.col("score") * F.col("score")).alias("votes"), F.count("*").alias("rows"))
    best = votes.agg(F.max(F.struct("votes", (-F.col(label_col)).alias("back"))).alias("best"), F.sum("votes").alias("total"), F.sum("rows").alias("rows"))
    share = F.col("best.votes") / F.col("total")
    return best.select((-F.col("best.back")).alias(label_col), share.alias("confidence"), ((share >= accept) & (F.col("rows") >= k)).alias("auto_accept"))


def knn_majority(df: DataFrame, query: Sequence[float], k: int = 3, label_col: str = "label", positive: int = 1) -> DataFrame:
    """One row: whether at least half of the k nearest have the positive label (ties go to it)."""
    near = semantic_search(df, query, min_score=-2.0, top_n=k)
    return near.agg((F.count_if(F.col(label_col) == positive) * 2 >= F.count("*")).alias("positive"))


def substring_search(df: DataFrame, query: str, content_col: str = "content") -> DataFrame:
    """Rows that hold the query, whatever its case, with relevance = its share of the content's length, best first."""
    found = df.filter(F.instr(F.lower(content_col), query.lower()) > 0)
    return found.withColumn("relevance", F.lit(float(len(query))) / F.length(content_col)).orderBy(F.desc("relevance"), F.asc("_key"))


def any_keyword(df: DataFrame, keywords: Sequence[str], fields: Sequence[str], limit: int = 10) -> DataFrame:
    """Rows in which any keyword is a part of any field, whatever its case, by key."""
    hit = [F.lower(F.coalesce(f, F.lit(""))).contains(k.lower()) for k in keywords for f in map(F.col, fields)]
    return page(df.filter(reduce(lambda a, b: a | b, hit, F.lit(False))), [F.asc("_key")], limit)


def matching(df: DataFrame, **values: str | None) -> DataFrame:
    """Rows equal in every value that is given."""
    for name, value in values.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def search_params(top_n: int | None = None, initial_k: int | None = None) -> tuple[int, int]:
    """Defaults for counts that are missing or not positive."""
    return (top_n if top_n and top_n > 0 else 5), (initial_k if initial_k and initial_k > 0 else 20)


#: What a filtered semantic search shows of a document.
SEMANTIC_FIELDS = ("_key", "_id", "title", "content", "tags", "score")


class Views:
    """Views by name; one is built again only when its fields change."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[tuple[str, ...], tuple[DataFrame, DataFrame]]] = {}

    def ensure(self, name: str, df: DataFrame, fields: Sequence[str] = FIELDS) -> tuple[DataFrame, DataFrame]:
        shape = tuple(f for f in fields if f in df.columns)
        if name not in self.known or self.known[name][0] != shape:
            self.known[name] = shape, build_view(df, shape)
        return self.known[name][1]


def exact_search(df: DataFrame, query: Sequence[float], top_n: int = 10, min_score: float = 0.7, metric: str = "cosine") -> DataFrame:
    """A page of exact scores, each row with ``total``, the count of returned rows."""
    rows = semantic_search(df, query, min_score=min_score, top_n=top_n, metric=metric)
    return rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))  # a single row
