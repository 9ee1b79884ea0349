"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Queries and candidates are hashed into blocks of bounded size and every query
block meets every candidate block in one group (an equi-join on the pair of
block numbers: a stated query set against all rows, in blocks). In a group the
candidates become postings (per dimension the rows with a non-zero weight);
each sparse query row scatters weight times posting into a dense score array
over the block; the block's k best are selected and the selections of all
blocks are merged.

Defined results: a vector that is null, or holds a null, NaN or infinite
component, takes no part. Vectors of different length meet on their common
dimensions; an empty vector scores 0. Rows are identified by position, so
repeated ids and repeated rows are all candidates, and each query row gets its
own ranks; only the query's own row is left out. Null ids are candidates that
lose ties. Fewer than k candidates: all of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, ship

QUERY_BLOCK = 256
CANDIDATE_BLOCK = 16384
NO_ID = np.iinfo(np.int64).max


def term_at_a_time(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Dense score array (queries x candidates), accumulated term by term."""
    scores = np.zeros((len(queries), len(candidates)), np.int64)
    for term in range(min(queries.shape[1], candidates.shape[1])):
        posting = np.flatnonzero(candidates[:, term])
        asking = np.flatnonzero(queries[:, term])
        if len(posting) == len(candidates) and len(asking) == len(queries):
            scores += queries[:, term, None] * candidates[None, :, term]
        else:
            scores[np.ix_(asking, posting)] += queries[asking, term, None] * candidates[None, posting, term]
    return scores


def select(scores: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the k best of one score row, best first; equal scores by
    position (candidates come sorted by id); position ``own`` is left out."""
    usable = np.arange(len(scores))
    if own >= 0:
        usable = np.delete(usable, own)
        scores = np.delete(scores, own)
    if len(scores) > k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > bar)
        keep = np.concatenate([above, np.flatnonzero(scores == bar)[:k - len(above)]])
    else:
        keep = np.arange(len(scores))
    keep = keep[np.lexsort((keep, -scores[keep]))]
    return usable[keep]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Quantised vectors as a dense matrix; shorter rows end in zeros."""
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    wide = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), wide), np.int64)
    out[np.arange(wide) < sizes[:, None]] = flat
    return out


def top_k(vectors: DataFrame, is_query: str, k: int = 5, scale: int = 256,
          id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k best of every row where ``is_query``
    (a predicate over ``id``) holds, scored by integer inner product of
    ``floor(scale * x)``."""
    ship(vectors.sparkSession)
    rows = (numbered(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")), "vectors")
            .where("v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
            .withColumn("v", F.expr(f"transform(v, x -> cast(floor({scale} * cast(x as double)) as bigint))")))
    asked = rows.where(is_query)
    n_all, n_asked = rows.agg(F.count("*"), F.count_if(F.expr(is_query))).first()
    n_c, n_q = max(1, math.ceil(n_all / CANDIDATE_BLOCK)), max(1, math.ceil(n_asked / QUERY_BLOCK))
    own_block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = asked.withColumn("qb", own_block(n_q)).withColumn("cb", every(n_c))
    c = rows.withColumn("cb", own_block(n_c)).withColumn("qb", every(n_q))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_row": [], "query_id": [], "id": [], "score": []}
        if left.num_rows and right.num_rows:
            ids = right.column("id").fill_null(NO_ID).to_numpy()
            at = np.lexsort((right.column("row").to_numpy(), ids))
            ids, place = ids[at], {r: n for n, r in enumerate(right.column("row").to_numpy()[at].tolist())}
            scores = term_at_a_time(_matrix(left.column("v")), _matrix(right.column("v"))[at])
            for n, row in enumerate(left.column("row").to_pylist()):
                best = select(scores[n], place.get(row, -1), k)
                out["query_row"] += [row] * len(best)
                out["query_id"] += [left.column("id")[n].as_py()] * len(best)
                out["id"] += [None if i == NO_ID else i for i in ids[best].tolist()]
                out["score"] += scores[n][best].tolist()
        return pa.table(out, pa.schema([(n, pa.int64()) for n in out]))

    best = (q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb"))
            .applyInArrow(meet, "query_row long, query_id long, id long, score long"))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return (best.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")
            .select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score"))
