"""Conversations as messages, exchanges as memories, and the links between them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import vector
from marlstone.functions.text import collection_of, shorten
from marlstone.operators.graph import traverse
from marlstone.sources.shared import written

#: Vectors of a block of new and of known memories, and new ones that a product of matrices takes at once.
ASKED, KNOWN, ROWS = 8192, 32_768, 256
SORTABLE = ("created_at", "timestamp", "turn", "role", "_key")


def messages(conversations: DataFrame) -> DataFrame:
    """Turns as messages, each with the key of the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    key = lambda t: F.concat_ws("-", "conv_id", t)
    before = F.lag("turn").over(order)
    return conversations.select(
        key(F.col("turn")).alias("_key"), F.col("conv_id").cast("string").alias("conversation_id"), F.col("turn").alias("turn"), F.col("role").alias("message_type"), F.col("text").alias("content"),
        F.when(before.isNotNull(), key(before)).alias("previous_message_key"),
    )


def conversation_messages(df: DataFrame, conversation_id: str, sort_by: str = "turn", direction: str = "ASC", limit: int | None = None, offset: int = 0) -> DataFrame:
    """A conversation in order; a direction that makes no sense is ascending, and paging needs a limit."""
    if sort_by not in SORTABLE:
        raise ValueError(f"no sort by {sort_by}")
    c = F.col(sort_by)
    df = df.filter(F.col("conversation_id") == conversation_id).orderBy(c.desc() if direction.upper() == "DESC" else c.asc(), F.asc("_key"))
    if limit is None:
        return df
    return (df.offset(offset) if offset else df).limit(limit)


def conversation_context(df: DataFrame, conversation_id: str, limit: int = 10) -> DataFrame:
    return conversation_messages(df, conversation_id, "turn", "ASC", limit)


def without_conversation(df: DataFrame, edges: DataFrame, conversation_id: str, collection: str = "messages") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages and edges without a conversation and the edges at its messages; and how many messages went."""
    gone = df.filter(F.col("conversation_id") == conversation_id)
    ids = gone.select(F.concat(F.lit(collection + "/"), "_key").alias("_id"))
    rest = edges.join(ids, F.col("_from") == F.col("_id"), "left_anti").join(ids, F.col("_to") == F.col("_id"), "left_anti")
    return df.filter(F.coalesce(F.col("conversation_id") != conversation_id, F.lit(True))), rest, gone.agg(F.count("*").alias("deleted"))


def without_message(df: DataFrame, edges: DataFrame, key: str, collection: str = "messages") -> tuple[DataFrame, DataFrame]:
    ident = f"{collection}/{key}"
    return df.filter(F.col("_key") != key), edges.filter((F.col("_from") != ident) & (F.col("_to") != ident))


def exchanges(conversations: DataFrame) -> DataFrame:
    """A user's turn with the assistant's that follows it: (conv_id, turn, user_text, agent_text)."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    following = conversations.withColumn("_role", F.lead("role").over(order)).withColumn("agent_text", F.lead("text").over(order))
    return following.filter("role = 'user' AND _role = 'assistant'").select("conv_id", "turn", F.col("text").alias("user_text"), "agent_text")


def summary(user: Column, agent: Column) -> Column:
    """Both texts, shortened to 100 characters."""
    return shorten(F.concat_ws(" ", user, agent), 100)


def memories(conversations: DataFrame, embed: bool = False) -> DataFrame:
    """A memory for each exchange: (_key, conversation_id, content, summary[, embedding])."""
    content = F.concat(F.lit("User: "), "user_text", F.lit("\nAgent: "), "agent_text")
    out = exchanges(conversations).select(F.concat_ws("-", "conv_id", "turn").alias("_key"), F.col("conv_id").cast("string").alias("conversation_id"), content.alias("content"), summary(F.col("user_text"), F.col("agent_text")).alias("summary"))
    return out.withColumn("embedding", vector.embed("content")) if embed else out


def memory_edges(conversations: DataFrame) -> DataFrame:
    """RESPONSE_TO from the answer to the question, PART_OF from both to the memory: (_from, _to, type)."""
    pair = exchanges(conversations).withColumn("answer", F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")))
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = conversations.withColumn("_next", F.lead("turn").over(order)).select("conv_id", "turn", "_next")
    pair = pair.drop("answer").join(turns, ["conv_id", "turn"])
    ident = lambda kind, t: F.concat(F.lit(kind + "/"), F.concat_ws("-", "conv_id", t))
    user, agent, memory = ident("messages", F.col("turn")), ident("messages", F.col("_next")), ident("memories", F.col("turn"))
    edges = F.array(*(F.struct(a.alias("_from"), b.alias("_to"), F.lit(kind).alias("type")) for a, b, kind in ((agent, user, "RESPONSE_TO"), (user, memory, "PART_OF"), (agent, memory, "PART_OF"))))
    return pair.select(F.inline(edges))


def _vectors(df: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """(_key, embedding, _block): vectors dealt to blocks of about ``size`` rows, and how many blocks; those that are null or hold null are left out.

    Rows are numbered and written first, so that a block has the same rows whenever it is read again.
    """
    whole = df.filter(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))
    rows = written(whole.select("_key", F.col("embedding").cast("array<double>").alias("embedding"), F.monotonically_increasing_id().alias("_row")), name)
    blocks = max(1, -(-rows.count() // size))
    return rows.select("_key", "embedding", F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int").alias("_block")), blocks


def _nearest(asked: pd.DataFrame, known: pd.DataFrame, threshold: float, top_n: int) -> pd.DataFrame:
    """(_from, _to, score): for each vector asked for the best of the known ones of its length, by products of matrices."""
    unit = lambda m: m / np.where((size := np.linalg.norm(m, axis=1)) == 0, np.inf, size)[:, None]
    known = known.sort_values("_key", kind="stable")
    found = [pd.DataFrame({"_from": [], "_to": [], "score": []}).astype({"_from": object, "_to": object, "score": float})]
    lengths, own_lengths = known["embedding"].map(len).to_numpy(), asked["embedding"].map(len).to_numpy()
    for n in np.intersect1d(lengths, own_lengths):
        part, own = known[lengths == n], asked[own_lengths == n]
        keys, matrix = part["_key"].to_numpy(), unit(np.stack(part["embedding"].to_numpy()))
        for low in range(0, len(own), ROWS):
            rows = own.iloc[low : low + ROWS]
            # rounded, so that equal vectors tie whatever the order of the sums is
            scores = np.round(unit(np.stack(rows["embedding"].to_numpy())) @ matrix.T, 12)
            for name, row in zip(rows["_key"], scores, strict=True):
                near = np.flatnonzero(row > threshold)
                near = near[keys[near] != name]
                near = near[np.argsort(-row[near], kind="stable")][:top_n]
                found.append(pd.DataFrame({"_from": name, "_to": keys[near], "score": row[near]}))
    return pd.concat(found, ignore_index=True)


def similarity_edges(new: DataFrame, known: DataFrame, threshold: float = 0.7, strong: float = 0.85, top_n: int = 5, kind: str = "similar") -> DataFrame:
    """Edges from new memories to their nearest known ones: (_from, _to, type, score, rationale).

    ``new`` is the query set. Both sides are dealt to blocks by the number of
    their row, and each pair of blocks is one product of matrices in a task, which
    keeps the ``top_n`` best of a vector; so neither side passes through the driver,
    a block is sent once for each block of the other side, and what is ranked
    at the end is ``top_n`` rows for a vector and block.
    """
    (asked, n_asked), (held, n_held) = _vectors(new, ASKED, "asked"), _vectors(known, KNOWN, "known")
    asked = asked.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(n_held - 1))))
    held = held.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
    cells = asked.groupBy("_block", "_other").cogroup(held.groupBy("_other", "_block"))
    scored = cells.applyInPandas(lambda a, k: _nearest(a, k, threshold, top_n), "_from string, _to string, score double")
    best = Window.partitionBy("_from").orderBy(F.desc("score"), F.asc("_to"))
    top = scored.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= top_n).drop("_n")
    name = F.when(F.col("score") > strong, f"strong_{kind}").otherwise(kind)
    return top.select("_from", "_to", name.alias("type"), "score", F.format_string("Similarity %.2f", "score").alias("rationale"))


def related_memories(edges: DataFrame, memory: DataFrame, relationship_type: str | None = None, max_depth: int = 1, limit: int = 10) -> DataFrame:
    """Memories within ``max_depth`` steps either way, nearer ones first, then those of newer edges; the type filters by the last edge."""
    found = traverse(edges, memory, 1, max_depth, "ANY").filter(collection_of(F.col("vertex")) == "memories")
    last = edges.select(F.col("_key").alias("edge"), "type", F.col("timestamp").alias("edge_time"))
    found = found.join(last, "edge")
    if relationship_type is not None:
        found = found.filter(F.col("type") == relationship_type)
    return found.orderBy("depth", F.desc("edge_time"), "vertex", "edge").limit(limit).select("start", "vertex", "edge", "depth", "type", "edge_time")


def sample(df: DataFrame, n: int = 20, seed: int = 42, without: Sequence[str] = ()) -> DataFrame:
    """A random sample of fixed size, the same for the same seed and partitions."""
    return df.filter(~F.col("_key").isin(list(without))).orderBy(F.rand(seed)).limit(n)
