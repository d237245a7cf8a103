"""Collections as immutable DataFrames: every change gives the collection after it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions import vector
from marlstone.functions.text import lesson_key

EDGE_SCHEMA = "_key string, _from string, _to string, type string, rationale string, timestamp timestamp, attributes map<string,string>"
MESSAGE_SCHEMA = "_key string, conversation_id string, message_type string, content string, timestamp timestamp, metadata map<string,string>, previous_message_key string"
MEMORY_SCHEMA = "_key string, conversation_id string, content string, summary string, embedding array<double>, timestamp timestamp"
GLOSSARY_SCHEMA = "term string, term_lower string, definition string, length int"
LESSON_SCHEMA = "_key string, role string, category string, identifier string, lesson string, lesson_embedding array<double>"


@dataclass
class Registry:
    """Named collections; those not there yet are made empty with their schema."""

    spark: SparkSession
    collections: dict[str, DataFrame] = field(default_factory=dict)

    def ensure_database(self, name: str) -> None:
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")

    def ensure(self, name: str, schema: str | T.StructType) -> DataFrame:
        return self.collections.setdefault(name, self.spark.createDataFrame([], schema))

    def put(self, name: str, df: DataFrame) -> DataFrame:
        self.collections[name] = df
        return df

    def truncate(self, names: Sequence[str], force: bool = False) -> bool:
        """Empty collections; without ``force`` nothing is done."""
        if force:
            for name in names:
                self.collections[name] = self.collections[name].limit(0)
        return force

    def edge_collections(self) -> list[str]:
        """The edges of lessons, made if they are missing."""
        for name in ("prerequisites", "related_topics"):
            self.ensure(name, EDGE_SCHEMA)
        return ["prerequisites", "related_topics"]

    def memory_collections(self) -> list[str]:
        """What a store of memories needs: two collections and their edges."""
        for name, schema in (("messages", MESSAGE_SCHEMA), ("memories", MEMORY_SCHEMA), ("relationships", EDGE_SCHEMA)):
            self.ensure(name, schema)
        return ["messages", "memories", "relationships"]

    def initialize(self, lessons: DataFrame, database: str = "lessons") -> list[tuple[int, str, int]]:
        """Everything in order: database, collections, graph, seeds, view, index; (step, what, rows) of each."""
        from marlstone.operators import graph, ivf, search

        self.ensure_database(database)
        self.bootstrap()
        edges = self.edge_collections()
        named = graph.GraphDef("lessons", self.collections["prerequisites"], ["lessons"], ["lessons"])
        seeded = self.put("lessons", seed(self.collections["lessons"], lessons))
        view = search.build_view(seeded, ["lesson"])[1].count()
        index = ivf.build(seeded.select("_key", F.col("lesson_embedding").alias("embedding")), lists=4)
        counts = (("database", 1), ("collections", len(self.collections)), ("graph", named.edges.count()), ("edges", len(edges)), ("seed", seeded.count()), ("view", view), ("index", index.rows.count()))
        return [(i, name, n) for i, (name, n) in enumerate(counts)]

    def bootstrap(self) -> Registry:
        """All collections of a memory and lesson store."""
        for name, schema in {"messages": MESSAGE_SCHEMA, "memories": MEMORY_SCHEMA, "relationships": EDGE_SCHEMA, "prerequisites": EDGE_SCHEMA, "related_topics": EDGE_SCHEMA, "glossary": GLOSSARY_SCHEMA, "lessons": LESSON_SCHEMA}.items():
            self.ensure(name, schema)
        return self


def get(df: DataFrame, key: str) -> DataFrame:
    """The document of a key: one row or none."""
    return df.filter(F.col("_key") == key)


def query(df: DataFrame, filter_expr: str | None = None, sort: Sequence[Column] | None = None, limit: int | None = 100, offset: int = 0) -> DataFrame:
    """A page of the rows that meet an expression."""
    df = df.filter(filter_expr) if filter_expr else df
    df = df.orderBy(*sort) if sort else df
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def raw(spark: SparkSession, text: str, bind_vars: Mapping | None = None) -> DataFrame:
    """Any SQL with bound values; values are never written into the text."""
    return spark.sql(text, args=dict(bind_vars or {}))


def keep(df: DataFrame, fields: Sequence[str], always: Sequence[str] = ("_key", "_id", "tags")) -> DataFrame:
    """Some columns in order, each once, and those always kept; a missing one is null."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in dict.fromkeys([*always, *fields])))


def keyed(df: DataFrame, collection: str) -> DataFrame:
    """System fields: a key where there is none, and the id."""
    key = F.coalesce(F.col("_key"), F.uuid()) if "_key" in df.columns else F.uuid()
    return df.withColumn("_key", key).withColumn("_id", F.concat(F.lit(collection + "/"), "_key"))


def stamped(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """A time where there is none."""
    now = F.current_timestamp()
    return df.withColumn(column, F.coalesce(column, now) if column in df.columns else now)


def insert(df: DataFrame, incoming: DataFrame) -> DataFrame:
    """Append; columns that a side lacks are null."""
    return df.unionByName(incoming, allowMissingColumns=True)


def _latest(incoming: DataFrame, key: str) -> DataFrame:
    """One row of each key: the last in the order of all columns where a batch has several."""
    several = Window.partitionBy(key).orderBy(*(F.desc_nulls_last(F.col(c).cast("string")) for c in incoming.columns if c != key))
    return incoming.withColumn("_n", F.row_number().over(several)).filter("_n = 1").drop("_n")


def upsert(df: DataFrame, incoming: DataFrame, key: str = "_key", replace: bool = False) -> DataFrame:
    """Rows of a known key take the new values that are not null (or all, if they replace); the others are added."""
    new = _latest(incoming, key)
    both = df.withColumn("_old", F.lit(True)).alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"o.{c}").alias(c)
        if c not in df.columns:
            return F.col(f"n.{c}").alias(c)
        if replace and c != key:
            return F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
        return F.coalesce(f"n.{c}", f"o.{c}").alias(c)

    return both.select(*(value(c) for c in dict.fromkeys([*df.columns, *new.columns])))


def update(df: DataFrame, changes: DataFrame, key: str = "_key", expected_rev: str | None = None) -> DataFrame:
    """Known keys take the new values that are not null; unknown keys are left out. With ``expected_rev`` only rows of that revision change."""
    known = changes.join(df.filter(F.col("_rev") == expected_rev).select(key) if expected_rev is not None else df.select(key), key, "left_semi")
    return upsert(df, known, key)


def delete(df: DataFrame, keys: DataFrame, key: str = "_key") -> DataFrame:
    """Without the rows of the given keys; unknown ones do no harm."""
    return df.join(keys.select(key), key, "left_anti").select(df.columns)


def bulk_import(df: DataFrame, incoming: DataFrame, on_duplicate: str = "error", key: str = "_key") -> DataFrame:
    """Insert many rows; known keys raise ("error"), or are kept ("ignore"), replaced ("replace") or merged ("update")."""
    if on_duplicate == "error":
        if not incoming.join(df.select(key), key, "left_semi").isEmpty():
            raise ValueError("some keys are there already")
        return insert(df, incoming)
    if on_duplicate == "ignore":
        return insert(df, incoming.join(df.select(key), key, "left_anti").select(incoming.columns))
    if on_duplicate == "replace":
        return insert(delete(df, incoming, key), _latest(incoming, key))
    if on_duplicate == "update":
        return upsert(df, incoming, key)
    raise ValueError(f"on_duplicate: {on_duplicate}")


def revision(df: DataFrame) -> DataFrame:
    """``df`` with a revision, the digest of its other columns."""
    return df.withColumn("_rev", F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c != "_rev"))), 256))


def with_embedding(df: DataFrame, generate: bool = True, dimensions: int = vector.DIMENSIONS, sources: Sequence[str] = ("content", "text", "question", "title", "summary")) -> DataFrame:
    """``df`` with unit vectors: those given, else (if asked for) made from the first text there is; ``embedding_error`` says why one is missing."""
    text = F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in sources if c in df.columns), F.lit(None).cast("string"))
    given = F.col("embedding") if "embedding" in df.columns else F.lit(None).cast("array<double>")
    e = F.coalesce(given, vector.embed(text)) if generate else given
    df = df.withColumn("embedding", e)
    return df.withColumn("embedding_error", vector.problem(F.col("embedding"), dimensions)).withColumn("embedding", F.when(F.col("embedding_error").isNull(), vector.normalized(F.col("embedding"))))


def validated(df: DataFrame, dimensions: int = vector.DIMENSIONS) -> tuple[DataFrame, DataFrame]:
    """Rows with a good vector, and the others with the reason."""
    flagged = df.withColumn("embedding_error", vector.problem(F.col("embedding"), dimensions))
    return flagged.filter("embedding_error IS NULL").drop("embedding_error"), flagged.filter("embedding_error IS NOT NULL")


def dimension_report(df: DataFrame) -> DataFrame:
    """How many vectors there are of each length."""
    return df.groupBy(F.size("embedding").cast("long").alias("dimensions")).agg(F.count("*").alias("rows"))


def labelled_questions(df: DataFrame, rating_col: str = "rating", least: float = 0.5) -> DataFrame:
    """Questions with a rating, labelled by whether it is good enough."""
    return df.filter(F.col("question").isNotNull() & F.col(rating_col).isNotNull()).withColumn("label", (F.col(rating_col) >= least).cast("int"))


def required(df: DataFrame, key: str) -> DataFrame:
    """The document of a key; KeyError where there is none."""
    found = get(df, key)
    if found.isEmpty():
        raise KeyError(key)
    return found


def profiled(spark: SparkSession, text: str, bind_vars: Mapping | None = None) -> tuple[DataFrame, Observation]:
    """A raw query and what is observed while it runs: its count of rows, there after the first action."""
    seen = Observation()
    return raw(spark, text, bind_vars).observe(seen, F.count(F.lit(1)).alias("count")), seen


def filtered(df: DataFrame, predicate: Callable[[DataFrame], Column]) -> DataFrame:
    """Rows that a predicate, given the table, says yes to."""
    return df.filter(predicate(df))


def seed(df: DataFrame, lessons: DataFrame) -> DataFrame:
    """Lessons (role, category, identifier, lesson[, _key, lesson_embedding]) with a text overwrite those of their key; missing keys and vectors are made."""
    own = F.col("_key") if "_key" in lessons.columns else F.lit(None).cast("string")
    given = F.col("lesson_embedding") if "lesson_embedding" in lessons.columns else F.lit(None).cast("array<double>")
    good = lessons.filter(F.trim("lesson") != "")
    made = good.withColumns({"_key": F.coalesce(own, lesson_key(F.col("role"), F.col("category"), F.col("identifier").cast("string"))), "lesson_embedding": F.coalesce(given, vector.embed("lesson"))})
    return upsert(df, made, replace=True)


def create(df: DataFrame, incoming: DataFrame, overwrite: str | None = None) -> DataFrame:
    """Insert rows with times of creation and change and a uuid; known keys follow ``overwrite`` (ignore, replace, update) or raise."""
    new = stamped(stamped(incoming, "created_at"), "updated_at").withColumn("uuid", F.uuid())
    return bulk_import(df, new, overwrite or "error")


def create_checked(df: DataFrame, incoming: DataFrame, dimensions: int = vector.DIMENSIONS) -> tuple[DataFrame, DataFrame]:
    """Insert rows with a good vector; and one row that tells how many were created and how many failed."""
    good, bad = validated(incoming, dimensions)
    counts = good.select(F.lit(1).alias("c"), F.lit(0).alias("f")).unionByName(bad.select(F.lit(0).alias("c"), F.lit(1).alias("f")))
    return insert(df, good), counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("created"), F.coalesce(F.sum("f"), F.lit(0)).alias("failed"))


def replace_keeping_vector(df: DataFrame, changes: DataFrame) -> DataFrame:
    """Known keys are replaced; a row without a vector keeps the one that was there."""
    old = df.select("_key", F.col("embedding").alias("_old"))
    kept = changes.join(old, "_key").withColumn("embedding", F.coalesce("embedding", "_old")).drop("_old")
    return upsert(df, kept, replace=True)
