"""Exact top-k search by inner product, in three phases with one threshold for all lists.

A score is the sum of its shares over lists, each list holding a run of the
dimensions. First, a part of the candidates is looked at: each cell of queries
and candidates gives the best entries of its local lists, their scores are
completed, and the k-th best of a query is a cutoff below which no result lies.
Second, the cutoff goes with its query to all candidates: what is in no list at
the cutoff's even share or above can't reach it, the rest is collected. Third,
entries that still can reach it by their known shares are scored exactly, and
those at the cutoff or above are ranked.

Queries and candidates meet in cells of bounded blocks, each a task's matrix
products; nothing is held whole by a task, the driver or a broadcast. The work
of an exact search grows with queries times candidates; what is shuffled is
each block once for each block of the other side, and a few entries a query.

Rows: vectors that are null, hold null or not finite components or have another
length than most take no part, nor do rows without an id, nor components so
large that a score could leave a long. A row is no candidate of its own, but
another row of the same id is one; repeated queries have results each. Ties go
to the smaller id, then to the earlier row. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import materialize
from marlstone.llm.vectors import floored, length_of, usable

SCALE, K, LISTS = 64, 20, 2
#: Rows of a block at most, and products of a tile at most.
QUERY_ROWS, CANDIDATE_ROWS, TILE = 16_384, 65_536, 2_000_000
#: Blocks that small tables are dealt to, and the least rows that are worth one.
BLOCKS, LEAST_ROWS, LEAST_QUERIES = 48, 256, 64
#: One candidate of so many is looked at for the cutoffs.
LOOK = 8
NO_CUTOFF = -(2**62)


def _kind(most: int, length: int) -> type:
    """The fastest numbers in which inner products are exact."""
    bound = most * most * length
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64


def _packed(x: Column, most: int) -> tuple[Column, str]:
    """Vectors as bytes of the narrowest whole numbers, and the name of these."""
    name = next(n for n, least in (("int8", 2**7), ("int16", 2**15), ("int32", 2**31), ("int64", 2**63)) if most < least)

    @F.pandas_udf("binary")
    def pack(batch: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(v).astype(name).tobytes() for v in batch], dtype=object)

    return pack(x), name


class Cell:
    """Products of a block of queries and a block of candidates, by lists of dimensions; rows come as (row, id, packed vector)."""

    def __init__(self, queries: pd.DataFrame, candidates: pd.DataFrame, packed: str, kind: type, length: int, lists: int, k: int):
        def matrix(rows: pd.DataFrame) -> np.ndarray:
            return np.frombuffer(b"".join(rows["x"]), packed).reshape(-1, length).astype(kind)

        self.queries, self.candidates, self.k = queries, candidates, k
        self.of_queries, self.of_candidates = matrix(queries), matrix(candidates)
        self.rows, self.ids = candidates["row"].to_numpy(), candidates["id"].to_numpy()
        self.parts = [slice(a, b) for a, b in pairwise(np.linspace(0, length, lists + 1).astype(int))]

    def _tiles(self):
        step = max(1, TILE // max(1, len(self.rows)))
        for a in range(0, len(self.queries), step):
            q = self.of_queries[a : a + step]
            yield a, [q[:, p] @ self.of_candidates[:, p].T for p in self.parts]

    def gathered(self) -> pd.DataFrame:
        """(query row, score): the best entries of each list, completed; the k best of a query."""
        out = []
        for a, shares in self._tiles():
            size = min(self.k + 1, len(self.rows))
            best = np.sort(np.concatenate([np.argpartition(s, s.shape[1] - size, axis=1)[:, -size:] for s in shares], axis=1), axis=1)
            scores = sum(np.take_along_axis(s, best, axis=1) for s in shares).astype(np.int64)
            own = self.queries["row"].to_numpy()[a : a + len(best)]
            twice = np.zeros(best.shape, bool)
            twice[:, 1:] = best[:, 1:] == best[:, :-1]
            scores[twice | (self.rows[best] == own[:, None])] = NO_CUTOFF
            scores = -np.sort(-scores, axis=1)[:, : self.k]
            i, j = np.nonzero(scores > NO_CUTOFF)
            out.append(pd.DataFrame({"query_row": own[i], "score": scores[i, j]}))
        return pd.concat(out, ignore_index=True)

    def found(self) -> pd.DataFrame:
        """(query row, query id, row, id, score): the k best entries of a query that reach its cutoff."""
        out = []
        for a, shares in self._tiles():
            near = self.queries.iloc[a : a + len(shares[0])]
            cutoff = near["cutoff"].to_numpy()
            even = -(-cutoff // len(shares))
            enough = [s >= even[:, None] for s in shares]
            i, j = np.nonzero(np.logical_or.reduce(enough))
            # a share that was not collected lies below the even one
            most = sum(np.where(e[i, j], s[i, j], even[i] - 1) for e, s in zip(enough, shares, strict=True))
            i, j = (x[most >= cutoff[i]] for x in (i, j))
            score = sum(s[i, j] for s in shares).astype(np.int64)
            good = (score >= cutoff[i]) & (self.rows[j] != near["row"].to_numpy()[i])
            i, j, score = i[good], j[good], score[good]
            order = np.lexsort((self.rows[j], self.ids[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < self.k
            i, j, score = i[first], j[first], score[first]
            out.append(pd.DataFrame({"query_row": near["row"].to_numpy()[i], "query_id": near["id"].to_numpy()[i], "row": self.rows[j], "id": self.ids[j], "score": score}))
        return pd.concat(out, ignore_index=True)


def _blocks(n: int, most: int, least_blocks: int, least_rows: int = LEAST_ROWS) -> int:
    return max(1, -(-n // most), min(least_blocks, n // least_rows))


def top_k(df: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, lists: int = LISTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that meets ``is_query`` the ``k`` other rows of the highest inner products of floored vectors."""
    length = length_of(df, vector_col)
    good = df.filter(usable(F.col(vector_col), length, scale) & F.col(id_col).isNotNull())
    x = floored(F.col(vector_col), scale)
    bound = good.agg(F.max(F.array_max(F.transform(x, F.abs))).alias("most"), F.count("*").alias("n"), F.count_if(is_query).alias("queries")).first()
    most, lists = bound["most"] or 0, max(1, min(lists, length))
    packed, name = _packed(x, most)
    kind = _kind(most, length)
    rows = materialize(good.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), packed.alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks")), "rows")
    asked = rows.filter("asks").select("row", "id", "x")

    def met(queries: DataFrame, candidates: DataFrame, groups: int, blocks: int, schema: str, of_cell) -> DataFrame:
        """What a function gives of each cell of queries and candidates."""
        dealt = lambda col, parts: F.pmod(F.xxhash64(col), F.lit(parts)).cast("int")
        every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
        own = queries.select("*", dealt("row", groups).alias("group"), every(blocks).alias("block"))
        others = candidates.select("row", "id", "x", dealt("row", blocks).alias("block"), every(groups).alias("group"))
        columns = [c.split()[0] for c in schema.split(", ")]

        def one(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            if q.empty or c.empty:
                return pd.DataFrame({c: [] for c in columns}, dtype="int64")
            return of_cell(Cell(q, c, name, kind, length, lists, k))

        return own.groupBy("group", "block").cogroup(others.groupBy("group", "block")).applyInPandas(one, schema)

    look = rows.filter(F.pmod(F.xxhash64("row", F.lit(1)), F.lit(LOOK)) == 0)
    # each cell gives k scores of a query: few blocks of candidates, and small tables are dealt out by their queries
    gathered = met(asked, look, _blocks(bound["queries"], QUERY_ROWS, BLOCKS, LEAST_QUERIES), _blocks(bound["n"] // LOOK, CANDIDATE_ROWS, 1), "query_row long, score long", Cell.gathered)
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score")))
    cutoffs = gathered.withColumn("place", place).filter(F.col("place") == k).select(F.col("query_row").alias("row"), F.col("score").alias("cutoff"))
    ready = materialize(asked.join(cutoffs, "row", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(NO_CUTOFF))), "queries")
    found = met(ready, rows, _blocks(bound["queries"], QUERY_ROWS, 1), _blocks(bound["n"], CANDIDATE_ROWS, BLOCKS), "query_row long, query_id long, row long, id long, score long", Cell.found)
    best = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "id", "row"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
