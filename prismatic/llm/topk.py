"""Exact top-k search by inner product, a term at a time.

A vector's components are its terms; whole numbers are their weights. Rows and queries are dealt into
blocks, and each pair of blocks is a group of its own, so that no task holds more than a block of
either. In a group, a term's postings are the rows that hold it; a query's terms, those not 0, scatter
weight times posting into an array with a score for each row. A partition by score keeps the k best
rows, smaller ids first among equals, and the lists of all blocks merge in a window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows and queries of a block, at most; a task holds one of each. Every row goes to each block of queries, and every query to each of rows.
ROWS, QUERIES = 32_768, 65_536


def whole_weights(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id and floor(scale * x) of each component; without vectors that are null or hold a null, infinite or undefined one."""
    x = F.col("vector")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    frame = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return frame.where(x.isNotNull() & F.col("vec_id").isNotNull() & fine).select("vec_id", F.transform(x, lambda v: F.floor(v * scale)).alias("weights"))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for k, row in enumerate(column):
        out[k, : len(row)] = row
    return out


def best_of_block(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k best rows for each query; ids ascend."""
    bound = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * rows.shape[1]
    kind = np.int32 if bound < 2**31 else np.int64
    postings = []
    for weights in rows.T.astype(kind):
        at = np.flatnonzero(weights)
        # Most rows hold the term: the whole column is the posting list, and absent rows add 0.
        postings.append((slice(None), np.ascontiguousarray(weights)) if 2 * len(at) > len(ids) else (at, weights[at]))
    scores, room = np.zeros(len(ids), kind), np.empty(len(ids), kind)
    found = []
    for query, weights in zip(query_ids, queries.astype(kind), strict=True):
        scores[:] = 0
        for term in np.flatnonzero(weights):
            at, posting = postings[term]
            if isinstance(at, slice):
                np.multiply(posting, weights[term], out=room)
                scores += room
            else:
                scores[at] += posting * weights[term]
        own = np.searchsorted(ids, query)
        others = np.ones(len(ids), bool)
        while own < len(ids) and ids[own] == query:
            others[own] = False
            own += 1
        if others.all():
            at, score = None, scores
        else:
            at = np.flatnonzero(others)
            score = scores[at]
        if len(score) > k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            above = np.flatnonzero(score > least)
            best = np.concatenate([above, np.flatnonzero(score == least)[: k - len(above)]])
        else:
            best = np.arange(len(score))
        found.append((np.full(len(best), query), ids[best if at is None else at[best]], score[best].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def search(vectors: DataFrame, is_query, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows of each row for which is_query (a condition on vec_id) holds.

    Ties go to the smaller vec_id. Rows with a query's id are its own and no candidates. A short
    vector lacks the other terms. Without queries, or without other rows, the result is empty.
    """
    rows = whole_weights(vectors, id_col, vector_col, scale)
    sizes = rows.agg(F.count("*").alias("rows"), F.count_if(is_query).alias("queries")).first()
    # As many blocks of rows as tasks can run, at least.
    row_blocks, query_blocks = max(-(-sizes["rows"] // ROWS), vectors.sparkSession.sparkContext.defaultParallelism), max(1, -(-sizes["queries"] // QUERIES))

    def dealt(frame: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        return frame.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))

    left = dealt(rows, "r", row_blocks, "q", query_blocks)
    right = dealt(rows.where(is_query), "q", query_blocks, "r", row_blocks)

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        width = max(map(len, [*a["weights"], *b["weights"]]))
        a = a.sort_values("vec_id", kind="stable")
        found = best_of_block(a["vec_id"].to_numpy(), _matrix(a["weights"], width), b["vec_id"].to_numpy(), _matrix(b["weights"], width), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    lists = left.groupBy("r", "q").cogroup(right.groupBy("r", "q")).applyInPandas(work, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
