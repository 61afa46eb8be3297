"""Library matching: retrieval, group scores, evidence rules and decisions, as joins, windows and aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import score, text, vector
from ..session import checkpointed

#: A table of rules of this many rows at most is broadcast.
BROADCAST_ROWS = 20_000
#: Rows and queries meet in blocks of about this many, so many products at a time, in so many partitions at most.
BLOCK_ROWS, PRODUCTS, MOST_PARTS = 4096, 1 << 19, 4096
#: A group of this many rows at most is worked on in one task.
GROUP_ROWS = 100_000
#: So many similarities are kept while rows are placed by them.
PLACED = 1 << 22


def unit_vectors(frame: DataFrame, column: str = "vector", size: int | None = None) -> DataFrame:
    """Rows with usable vectors, scaled to length 1."""
    v = F.col(column)
    length = vector.norm(v)
    return frame.where(vector.usable(v, size)).withColumn("_n", length).withColumn(column, F.transform(v, lambda x: x / F.col("_n"))).drop("_n")


class Block:
    """Library rows that meet a block of queries, by their ids: vectors, the other columns, and the places of each group's rows."""

    def __init__(self, parts: list[pa.RecordBatch], size: int, columns: list[str], by: tuple[str, ...], ascending: bool):
        rows = pa.Table.from_batches(parts).combine_chunks()
        order = pc.sort_indices(rows, sort_keys=[("asset_id", "ascending" if ascending else "descending")])
        self.columns = {c: rows.column(c).take(order).combine_chunks() for c in columns}
        self.vectors = rows.column("vector").combine_chunks().flatten().to_numpy().reshape(len(rows), size)[order.to_numpy()]
        frame = pd.DataFrame({c: self.columns[c].to_pandas() for c in by}, index=range(len(rows)))
        self.members = list(frame.groupby(list(by), dropna=False).indices.values()) if by else [np.arange(len(rows))]


Meeting = Callable[[np.ndarray, Block], tuple[np.ndarray, np.ndarray, dict[str, np.ndarray | pa.Array]]]


def _all_pairs(products: np.ndarray, library: Block) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray | pa.Array]]:
    i, j = np.repeat(np.arange(len(products)), products.shape[1]), np.tile(np.arange(products.shape[1]), len(products))
    return i, j, {"similarity": products.ravel()}


def scored(queries: DataFrame, library: DataFrame) -> DataFrame:
    """Every query (query_id, query_vector) against every library row (asset_id, group_id, vector) of the same size: similarity, 0 to 1. All pairs are rows: what needs only the best of them asks `best_scored`, their order `placed_by_group`."""
    return _by_blocks(queries, *_dealt(library, ()), _all_pairs, {"similarity": "double"})


def best_scored(queries: DataFrame, library: DataFrame, top: int = 3, support: float = 0.78, by_group: bool = True, larger: bool = True, by: tuple[str, ...] | None = None, digits: int | None = None) -> DataFrame:
    """The `top` best library rows of each query and group (or of each query; or of each query and other columns of the library, `by`) in each block, ties to the larger (or smaller) id: similarity, and on the best of them how many rows there were (n) and how many reached `support` (s), 0 on the others.

    Rows of a group share a block, up to BLOCK_ROWS of them. So what is shuffled is a few rows for each query and group, and as many for each further
    BLOCK_ROWS rows of a group, not a row for each pair. With `digits`, similarities are rounded, as Spark does it, before they are compared.
    """
    keys = (("group_id",) if by_group else ()) if by is None else by

    def best(products: np.ndarray, library: Block) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray | pa.Array]]:
        values = products if digits is None else half_up(products, digits)
        i, j, counts = _best(values, library.members, top, support)
        return i, j, {"similarity": values[i, j]} | counts

    return _by_blocks(queries, *_dealt(library, keys), best, {"similarity": "double", "n": "long", "s": "long"}, keys, not larger)


def placed_by_group(queries: DataFrame, library: DataFrame) -> DataFrame:
    """query_id, asset_id, group_id and place (from 1) of every pair: by group, then by the greater similarity, then by the smaller id.

    A group's rows meet a block of queries in one task and are placed behind all rows of the groups before, so no pair is shuffled. Nor are vectors
    copied for each block that they meet: library and queries are dealt out once, and a cross join of their blocks reads them where they are. Groups
    that follow each other are one part, up to BLOCK_ROWS rows; those of over GROUP_ROWS rows meet fewer queries at a time, since a task keeps PLACED
    similarities. Rows come asset by asset, as columns that repeat take little in files.
    """
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_size").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = library.groupBy(F.size("vector").alias("_size"), F.col("group_id").alias("_of")).agg(F.count("*").alias("_n")).withColumn("before", before)
    counted = counted.withColumn("large", F.col("_n") > GROUP_ROWS).withColumn("_l", F.when(F.col("large"), F.col("before")).otherwise(F.floor(F.col("before") / BLOCK_ROWS)))
    counted = counted.withColumn("part", F.dense_rank().over(Window.partitionBy("large").orderBy("_size", "_l")) - 1)
    counted = checkpointed(counted.withColumn("rows", F.sum("_n").over(Window.partitionBy("large", "part"))))
    few = F.broadcast(counted) if counted.count() <= BROADCAST_ROWS else counted
    known = library.withColumn("size", F.size("vector")).join(few, (F.col("size") == F.col("_size")) & F.col("group_id").eqNullSafe(F.col("_of")))
    of_queries, placed = queries.count(), []
    for large, most, parts in counted.groupBy("large").agg(F.max("rows"), F.max("part") + 1).collect() or [(False, 1, 1)]:
        blocks = max(1, -(-of_queries * most // PLACED))
        asked = queries.withColumns({"asked_size": F.size("query_vector"), "block": F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")}).groupBy("asked_size", "block").agg(F.collect_list(F.struct("query_id", "query_vector")).alias("q"))
        asked = asked.select("asked_size", "block", F.col("q.query_id").alias("query_id"), F.flatten("q.query_vector").alias("query_vector")).repartitionById(blocks, "block")
        pieces = _pieces(known.where(F.col("large") == large)).repartitionById(parts, "part")
        both = pieces.hint("shuffle_replicate_nl").crossJoin(asked)
        types = dict(library.dtypes) | dict(queries.dtypes)
        rows = both.mapInArrow(_place_blocks, f"asset_id {types['asset_id']}, group_id {types['group_id']}, query_id array<{types['query_id']}>, place array<int>")
        rows = rows.select("asset_id", "group_id", "query_id", F.posexplode("place").alias("at", "place"))
        placed.append(rows.select(F.get("query_id", "at").alias("query_id"), "asset_id", "group_id", "place"))
    return reduce(DataFrame.unionByName, placed)


def _pieces(known: DataFrame) -> DataFrame:
    """Library rows with their size, part and its number of rows, as a row for each part in a batch: lists of ids, groups and places before, and one of all components."""
    types = dict(known.dtypes)
    lists = ["asset_id", "group_id", "before"]

    def work(batches):
        for batch in batches:
            part = batch.column("part").to_numpy()
            order = np.argsort(part, kind="stable")
            cuts = np.r_[0, np.flatnonzero(np.diff(part[order])) + 1, len(part)]
            batch = batch.take(pa.array(order))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                for at in range(a, b, BLOCK_ROWS):
                    rows = batch.slice(at, min(BLOCK_ROWS, b - at))
                    found = {c: rows.column(c).slice(0, 1) for c in ("size", "part", "rows")}
                    found |= {c: pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows.column(c)) for c in lists}
                    vectors = rows.column("vector").flatten()
                    yield pa.RecordBatch.from_pydict(found | {"vector": pa.ListArray.from_arrays(pa.array([0, len(vectors)], pa.int32()), vectors)})

    schema = ", ".join([*(f"{c} {types[c]}" for c in ("size", "part", "rows")), *(f"{c} array<{types[c]}>" for c in lists), f"vector {types['vector']}"])
    return known.select("size", "part", "rows", *lists, "vector").mapInArrow(work, schema)


def _place_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each library row and block of queries, once all pieces of its part have met the block: the ids of the queries and its places for them."""
    met: dict[tuple[int, int], list[tuple[np.ndarray, pa.RecordBatch]]] = {}
    for batch in batches:
        for at in range(len(batch)):
            row = {c: batch.column(c)[at] for c in batch.schema.names}
            size = row["size"].as_py()
            if size != row["asked_size"].as_py():
                continue
            asked, vectors = (row[c].values.to_numpy().reshape(-1, size) for c in ("query_vector", "vector"))
            own = pa.RecordBatch.from_pydict({c: row[c].values for c in ("asset_id", "group_id", "before")})
            here = met.setdefault((row["part"].as_py(), row["block"].as_py()), [])
            # not a BLAS product: equal vectors have equal products wherever they stand; taken rows don't hold the batch
            here.append((np.clip(np.einsum("id,jd->ij", asked, vectors), 0.0, 1.0), own.take(pa.array(np.arange(len(own))))))
            if sum(len(x) for _, x in here) == row["rows"].as_py():
                yield from _by_asset(row["query_id"].values, *zip(*met.pop((row["part"].as_py(), row["block"].as_py())), strict=True))


def _by_asset(asked: pa.Array, products: tuple[np.ndarray, ...], pieces: tuple[pa.RecordBatch, ...]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(pieces).combine_chunks()
    order = pc.sort_indices(rows, sort_keys=[("before", "ascending"), ("asset_id", "ascending")])
    rows, order = rows.take(order), order.to_numpy()
    before, products = rows.column("before").to_numpy(), np.concatenate(products, axis=1)
    places = np.empty((len(rows), len(asked)), np.int32)
    cuts = np.r_[0, np.flatnonzero(np.diff(before)) + 1, len(rows)].tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        step = max(1, PRODUCTS // (b - a))
        for at in range(0, len(asked), step):
            places[a:b, at : at + step] = before[a] + _ranks(products[at : at + step, order[a:b]]).T
    step = max(1, PRODUCTS // len(asked))
    asked = asked.take(pa.array(np.tile(np.arange(len(asked)), min(step, len(rows)))))
    for at in range(0, len(rows), step):
        part = places[at : at + step]
        lists = pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1])
        own = {c: rows.column(c).slice(at, step).combine_chunks() for c in ("asset_id", "group_id")}
        yield pa.RecordBatch.from_pydict(own | {"query_id": pa.ListArray.from_arrays(lists, asked.slice(0, part.size)), "place": pa.ListArray.from_arrays(lists, pa.array(part.ravel()))})


def _ranks(products: np.ndarray) -> np.ndarray:
    """The rank (from 1) of each product in its row, the largest first and earlier columns first among equals."""
    order = np.argsort(-products, axis=1)
    ranked = np.take_along_axis(products, order, axis=1)
    tied = (ranked[:, 1:] == ranked[:, :-1]).any(axis=1)
    order[tied] = np.argsort(-products[tied], axis=1, kind="stable")
    ranks = np.empty(products.shape, np.int32)
    np.put_along_axis(ranks, order, np.arange(1, products.shape[1] + 1, dtype=np.int32)[None, :], axis=1)
    return ranks


def half_up(values: np.ndarray, digits: int) -> np.ndarray:
    """Numbers from 0 to 1 rounded by their shortest decimal form, halves up."""
    scaled = values * 10**digits
    whole = np.floor(scaled)
    out = np.where(scaled - whole >= 0.5, whole + 1, whole) / 10**digits
    for at in zip(*np.nonzero(np.abs(scaled - whole - 0.5) < 1e-6), strict=True):
        out[at] = float(Decimal(repr(float(values[at]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def _dealt(library: DataFrame, by: tuple[str, ...]) -> tuple[DataFrame, int]:
    """The library with a block (l) for each row, and the number of blocks: rows of equal columns `by` share one, those of more than BLOCK_ROWS rows as few as hold them."""
    blocks = max(1, -(-library.count() // BLOCK_ROWS))
    if not by:
        return library.withColumn("l", F.pmod(F.xxhash64("asset_id"), F.lit(blocks))), blocks
    names = {c: f"_of_{c}" for c in by}
    large = library.groupBy(*(F.col(c).alias(names[c]) for c in by)).agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK_ROWS)  # not more than there are blocks
    same = [F.col(c).eqNullSafe(F.col(names[c])) for c in by]
    known = library.join(F.broadcast(large), reduce(and_, same), "left")
    part = F.when(F.col("_n").isNull(), 0).otherwise(F.pmod(F.xxhash64("asset_id"), F.ceil(F.col("_n") / BLOCK_ROWS)))
    return known.withColumn("l", F.pmod(F.xxhash64(*by, part), F.lit(blocks))).drop("_n", *names.values()), blocks


def _by_blocks(queries: DataFrame, library: DataFrame, blocks: int, meeting: Meeting, kinds: dict[str, str], by: tuple[str, ...] = (), ascending: bool = False) -> DataFrame:
    """query_id, asset_id, group_id and what `meeting` gives of the products of queries with the library's rows, which are in blocks (l).

    Queries are dealt into blocks of about BLOCK_ROWS rows too. Each pair of blocks is in one task, sorted with the library's rows first, so a task holds
    one block of the library and PRODUCTS products at a time; what they give goes on at once.
    """
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    of_queries = max(1, -(-queries.count() // BLOCK_ROWS))
    types = dict(queries.dtypes) | dict(library.dtypes)
    own = [c for c in library.columns if c != "vector"]
    asked = queries.select("query_id", F.col("query_vector").alias("vector"), F.size("query_vector").alias("size"), F.pmod(F.xxhash64("query_id"), F.lit(of_queries)).alias("q"), each(blocks).alias("l"), F.lit(1).alias("side"))
    dealt = library.withColumns({"size": F.size("vector"), "q": each(of_queries), "side": F.lit(0)})
    keys = ["size", "q", "l", "side"]
    schema = ", ".join(f"{c} {k}" for c, k in ({c: types[c] for c in ("query_id", "asset_id", "group_id")} | kinds).items())

    def products(asked: pa.RecordBatch, library: Block, size: int) -> Iterator[pa.RecordBatch]:
        vectors = asked.column("vector").flatten().to_numpy().reshape(len(asked), size)
        step = max(1, PRODUCTS // len(library.vectors))
        for at in range(0, len(asked), step):
            # not a BLAS product: equal vectors have equal products wherever they stand
            i, j, found = meeting(np.clip(np.einsum("id,jd->ij", vectors[at : at + step], library.vectors), 0.0, 1.0), library)
            i, j = pa.array(i + at), pa.array(j)
            columns = {"query_id": asked.column("query_id").take(i), "asset_id": library.columns["asset_id"].take(j), "group_id": library.columns["group_id"].take(j)}
            yield pa.RecordBatch.from_pydict(columns | {c: found[c] if isinstance(found[c], pa.Array) else pa.array(found[c]) for c in kinds})

    def work(batches):
        here, parts, block = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            marks = np.stack([batch.column(c).to_numpy() for c in keys])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                *pair, side = marks[:, a].tolist()
                if pair != here:
                    here, parts, block = pair, [], None
                if side == 0:
                    parts.append(batch.slice(a, b - a))
                elif parts:
                    block = block or Block(parts, pair[0], own, by, ascending)
                    yield from products(batch.slice(a, b - a), block, pair[0])

    both = asked.unionByName(dealt, allowMissingColumns=True).withColumns({"l": F.col("l").cast("long"), "q": F.col("q").cast("long")})
    return both.repartition(min(MOST_PARTS, 2 * blocks * of_queries), *keys[:3]).sortWithinPartitions(*keys).mapInArrow(work, schema)


def _best(products: np.ndarray, members: list[np.ndarray], top: int, support: float) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Rows and columns of the `top` largest products of each row and group of columns (`members`), earlier columns first among equals, with the counts."""
    rows, columns, n, s = [], [], [], []
    for at in members:
        part = products[:, at]
        order = np.argsort(-part, axis=1, kind="stable")[:, :top]
        rows.append(np.repeat(np.arange(len(part)), order.shape[1]))
        columns.append(at[order].ravel())
        first = np.zeros(order.shape, np.int64)
        first[:, 0] = len(at)
        n.append(first.ravel())
        reached = np.zeros(order.shape, np.int64)
        reached[:, 0] = (part >= support).sum(axis=1)
        s.append(reached.ravel())
    return np.concatenate(rows), np.concatenate(columns), {"n": np.concatenate(n), "s": np.concatenate(s)}


def nearest(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "asset_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def group_scores(scores: DataFrame, best_weight: float = 0.65, support: float = 0.78, top: int = 3) -> DataFrame:
    """A row for each query and group: best_weight of the best and the rest of the mean of the best three; ties go to the larger id. Scores may be those of `best_scored` with the same support and at least as many, which have counts of their own."""
    counted = "n" in scores.columns
    order = Window.partitionBy("query_id", "group_id").orderBy(F.desc("similarity"), F.desc("asset_id"))
    ranked = scores.withColumn("rn", F.row_number().over(order))
    first = F.max(F.when(F.col("rn") == 1, F.col("similarity")))
    mean = F.avg(F.when(F.col("rn") <= top, F.col("similarity")))
    return ranked.groupBy("query_id", "group_id").agg(
        F.max(F.when(F.col("rn") == 1, F.col("asset_id"))).alias("asset_id"),
        first.alias("best"),
        mean.alias("top_mean"),
        (best_weight * first + (1 - best_weight) * mean).alias("similarity"),
        (F.sum("n") if counted else F.count("*")).alias("prototypes"),
        (F.sum("s") if counted else F.count_if(F.col("similarity") >= support)).alias("support"),
    )


def collapsed(candidates: DataFrame, *keys: str) -> DataFrame:
    """One candidate of each key: that with the greatest final score, then similarity, then id."""
    order = F.struct("final_score", "similarity", "asset_id")
    rest = [c for c in candidates.columns if c not in keys]
    return candidates.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("c")).select(*keys, *(F.col(f"c.{c}").alias(c) for c in rest))


def decided(candidates: DataFrame, auto: float = 0.60, feature_auto: float = 0.75, listed: int = 10) -> DataFrame:
    """A row for each query with candidates (group_id, asset_id, similarity, feature_score, final_score): the best, its margin, and whether it is a match.

    Order: final score, similarity, smaller id. The margin of a lone candidate is 1. Unmatched rows keep
    their scores and have no matched asset.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), F.desc("similarity"), "asset_id")
    ranked = candidates.withColumns({"rank": F.row_number().over(order), "next": F.lead("final_score").over(order)})
    entry = F.struct("rank", "asset_id", "group_id", F.round("final_score", 4).alias("final_score"))
    first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c)))
    rows = ranked.groupBy("query_id").agg(
        *(first(c).alias(c) for c in ("asset_id", "group_id", "similarity", "feature_score", "final_score", "next")),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= listed, entry))), lambda e: e["asset_id"]).alias("candidates"),
    )
    passed = score.matched(F.col("final_score"), F.col("feature_score"), auto, feature_auto)
    return rows.select(
        "query_id",
        F.when(passed, "matched").otherwise("unmatched").alias("decision"),
        F.when(passed, F.col("asset_id")).alias("matched_asset_id"),
        F.when(passed, F.col("group_id")).alias("matched_group_id"),
        "similarity",
        "feature_score",
        "final_score",
        F.coalesce(F.col("final_score") - F.col("next"), F.lit(1.0)).alias("margin"),
        "candidates",
    )


def with_unmatched(queries: DataFrame, decisions: DataFrame) -> DataFrame:
    """Queries without any candidate are unmatched, without scores."""
    found = queries.select("query_id").join(decisions, "query_id", "left")
    return found.withColumn("decision", F.coalesce("decision", F.lit("unmatched")))


def diverse(ids: np.ndarray, vectors: np.ndarray, limit: int) -> list[int]:
    """Places of the row next to the mean and then, one by one, of the row least like those taken; ties go to the smaller id. Rows by id."""
    lengths = np.linalg.norm(vectors, axis=1)
    usable = np.flatnonzero(np.isfinite(lengths) & (lengths > 0))
    if not len(usable) or limit <= 0:
        return []
    unit = vectors[usable] / lengths[usable, None]
    mean = unit.mean(axis=0)
    size = float(np.linalg.norm(mean))
    near = np.round(unit @ (mean / size), 12) if size > 1e-9 else np.zeros(len(unit))
    return usable[_spread(unit, int(np.argmax(near)), limit)].tolist()


def _spread(unit: np.ndarray, first: int, limit: int, without: np.ndarray | None = None) -> list[int]:
    """Places of the first row and then, one by one, of the row least like those taken, of all rows but those left out."""
    without = np.zeros(0, np.int64) if without is None else without
    taken = [first]
    closest = np.round(unit @ unit[first], 12)
    while len(taken) < min(limit, len(unit) - len(without)):
        left = closest.copy()
        left[taken] = np.inf
        left[without] = np.inf
        taken.append(int(np.argmin(left)))
        closest = np.maximum(closest, np.round(unit @ unit[taken[-1]], 12))
    return taken


def diverse_without(vectors: np.ndarray, classes: np.ndarray, limit: int) -> list[list[int]]:
    """For each class of rows (0, 1, ...), what `diverse` gives for the rows that aren't of it. Rows by id, all usable.

    Leaving out k rows of length 1 moves a row's product with the sum of all by k at most, so only rows
    within 2 k of the best one left can be next to the mean. What follows the first row stays the same
    unless one of the rows left out is in it.
    """
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    exact = unit.astype(np.float64)
    total = exact.sum(axis=0)
    pull = exact @ total
    order = np.argsort(-pull, kind="stable")
    falling = -pull[order]
    members = np.split(np.argsort(classes, kind="stable"), np.cumsum(np.bincount(classes))[:-1])
    chains: dict[int, list[int]] = {}
    out = []
    for gone in members:
        k = len(gone)
        if k == len(unit) or limit <= 0:
            out.append([])
            continue
        removed = exact[gone].sum(axis=0)
        near = order[: np.searchsorted(falling, falling[k] + 2 * k + 1e-6, side="right")]
        near = np.sort(near[~np.isin(near, gone)])
        if np.linalg.norm(total - removed) > 1e-9 * len(unit):
            left = pull[near] - exact[near] @ removed
            first = int(near[np.argmax(left >= left.max() - 1e-9)])
        else:
            first = int(np.setdiff1d(np.arange(len(unit)), gone)[0])
        if first not in chains:
            chains[first] = _spread(unit, first, limit)
        chain = chains[first]
        out.append(_spread(unit, first, limit, gone) if np.isin(gone, chain).any() else chain)
    return out


def prototypes(library: DataFrame, limit: int = 12) -> DataFrame:
    """group_id, asset_id and rank (from 1) of up to `limit` diverse representatives of each group: the row next to the mean, then, one by one, the row least like those taken; ties go to the smaller id.

    Vectors that are null, without length or of another size than the group's first usable row's take no
    part. Groups of up to GROUP_ROWS rows are chosen from in one task each, larger ones in rounds over all
    their rows. Products count to twelve digits, so that the order of sums doesn't decide ties.
    """
    large = library.groupBy("group_id").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_ROWS).select("group_id")
    if large.isEmpty():
        return _prototypes_by_group(library, limit)
    rest = _prototypes_by_group(library.join(large, "group_id", "left_anti"), limit)
    return rest.unionByName(prototypes_in_rounds(library.join(large, "group_id", "left_semi"), limit))


def _prototypes_by_group(small: DataFrame, limit: int) -> DataFrame:
    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("asset_id", kind="stable", ignore_index=True)
        if not len(frame):
            return pd.DataFrame({"group_id": [], "asset_id": [], "rank": []})
        width = len(frame["vector"].iloc[0])
        frame = frame[frame["vector"].map(len) == width].reset_index(drop=True)
        places = diverse(frame["asset_id"].to_numpy(), np.stack(frame["vector"]), limit)
        return pd.DataFrame({"group_id": frame["group_id"].iloc[places], "asset_id": frame["asset_id"].iloc[places], "rank": range(1, len(places) + 1)})

    return small.where(vector.usable(F.col("vector"))).select("group_id", "asset_id", "vector").groupBy("group_id").applyInPandas(choose, "group_id int, asset_id long, rank int")


def prototypes_in_rounds(library: DataFrame, limit: int = 12) -> DataFrame:
    """What `prototypes` gives, for groups of any size: each step is a partial and a final aggregate over all rows, so no group is ever whole in one task.

    What goes from step to step is the rows taken, which Spark broadcasts while they are small.
    """
    usable = library.where(vector.usable(F.col("vector"))).select("group_id", "asset_id", F.size("vector").alias("size"))
    size = usable.groupBy("group_id").agg(F.min_by("size", "asset_id").alias("size"))
    unit = unit_vectors(library.select("group_id", "asset_id", "vector")).withColumn("size", F.size("vector")).join(size, ["group_id", "size"]).drop("size")
    unit = checkpointed(unit)
    part = unit.select("group_id", F.posexplode("vector").alias("at", "x")).groupBy("group_id", "at").agg(F.sum("x").alias("x"))
    mean = part.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("mean"))
    alike = lambda other: F.round(vector.dot(F.col("vector"), other) + F.lit(0.0), 12)
    one = F.struct("asset_id", "vector")
    length = vector.norm(F.col("mean"))
    central = F.when(length > 1e-9, alike(F.transform("mean", lambda x: x / F.col("length")))).otherwise(0.0)
    first = unit.join(mean.withColumn("length", length), "group_id").groupBy("group_id").agg(F.max_by(one, F.struct(central, -F.col("asset_id"))).alias("next"))
    taken = checkpointed(first.select("group_id", F.array("next").alias("taken"))) if limit > 0 else first.select("group_id", F.array().cast("array<struct<asset_id:long,vector:array<double>>>").alias("taken"))
    for _ in range(limit - 1):
        left = unit.join(taken, "group_id").where(~F.array_contains(F.transform("taken", lambda t: t["asset_id"]), F.col("asset_id")))
        closest = F.array_max(F.transform("taken", lambda t: alike(t["vector"])))
        least = left.groupBy("group_id").agg(F.min_by(one, F.struct(closest, "asset_id")).alias("next"))
        taken = checkpointed(taken.join(least, "group_id", "left").select("group_id", F.when(F.col("next").isNull(), F.col("taken")).otherwise(F.concat("taken", F.array("next"))).alias("taken")))
    return taken.select("group_id", F.posexplode("taken").alias("at", "t")).select("group_id", "t.asset_id", (F.col("at") + 1).alias("rank"))


def prototypes_without(library: DataFrame, limit: int = 12) -> DataFrame:
    """group_id, copy, asset_id and similarity: each group's prototypes chosen anew without the rows of each of its copies (rows of equal `copy` have equal vectors).

    library: group_id, asset_id, copy and usable vectors of one size. Similarity, 0 to 1, is that of the copy left out.
    """

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("asset_id", kind="stable", ignore_index=True)
        vectors = np.stack(frame["vector"])
        unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        classes, copies = pd.factorize(frame["copy"])
        ids, some = frame["asset_id"].to_numpy(), np.zeros(len(copies), np.int64)
        some[classes] = np.arange(len(frame))
        chosen = diverse_without(vectors.astype(np.float32), classes, limit)
        places = np.array([p for taken in chosen for p in taken], np.int64)
        of = np.repeat(np.arange(len(copies)), [len(taken) for taken in chosen])
        similarity = np.clip((unit[some[of]] * unit[places]).sum(axis=1), 0.0, 1.0)
        return pd.DataFrame({"group_id": frame["group_id"].iloc[0], "copy": np.asarray(copies)[of], "asset_id": ids[places], "similarity": similarity})

    return library.select("group_id", "asset_id", "copy", "vector").groupBy("group_id").applyInPandas(choose, "group_id int, copy string, asset_id long, similarity double")


def leave_one_out_scores(library: DataFrame, limit: int = 12) -> DataFrame:
    """query_id, asset_id, group_id and similarity of every usable asset against each group's prototypes, chosen without it and its equal copies.

    Groups without the asset or a copy of it keep their usual prototypes. An asset whose own group has
    nothing else is not asked.
    """
    library = library.where(vector.usable(F.col("vector"))).withColumn("copy", F.sha2(F.col("vector").cast("string"), 256))
    unit = unit_vectors(library)
    copies = library.groupBy("group_id", "copy").agg(F.count("*").alias("n"))
    held = copies.withColumn("total", F.sum("n").over(Window.partitionBy("group_id")))
    asked = unit.join(held.where("n < total").select("group_id", "copy"), ["group_id", "copy"], "left_semi").select(F.col("asset_id").alias("query_id"), F.col("vector").alias("query_vector"), "copy")
    usual = unit.join(prototypes(library, limit).select("asset_id"), "asset_id")
    own = asked.select("query_id", "copy").join(copies.select("copy", "group_id"), "copy").select("query_id", "group_id")
    others = scored(asked, usual).join(own, ["query_id", "group_id"], "left_anti")
    anew = asked.select("query_id", "copy").join(prototypes_without(library, limit), "copy")
    return others.select("query_id", "asset_id", "group_id", "similarity").unionByName(anew.select("query_id", "asset_id", "group_id", "similarity"))


def rule_evidence(facts: DataFrame, rules: DataFrame, least_confidence: float = 0.60) -> DataFrame:
    """query_id, group_id, score and mode of groups' rules against queries' texts.

    facts: query_id, haystack, confidence. rules: group_id, dimension, keywords, least_hits, hard_gate. A
    dimension passes if one of its rules has enough keyword hits and the text is sure enough; all pass:
    supported; a hard one fails: conflicted; else unsupported. Rules are broadcast if there are few of them (counted first);
    more are dealt into blocks, each of which meets every text in tasks of its own.
    """
    if rules.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        met = facts.crossJoin(F.broadcast(rules))
    else:
        blocks = -(-rules.count() // BROADCAST_ROWS)
        dealt = rules.withColumn("_block", F.pmod(F.xxhash64("group_id", "dimension", "keywords"), F.lit(blocks)))
        met = facts.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(dealt, "_block").drop("_block")
    hits = F.size(F.filter(F.array_distinct("keywords"), lambda k: (k != "") & F.contains(F.col("haystack"), F.lower(k))))
    direct = (F.size("keywords") > 0) & (hits >= F.col("least_hits"))
    by_rule = met.withColumn("direct", direct)
    dims = by_rule.groupBy("query_id", "group_id", "dimension").agg(
        F.max(F.when(F.col("direct"), 1.0).otherwise(0.0)).alias("score"), F.bool_or(F.col("direct") & (F.col("confidence") >= least_confidence)).alias("passed"), F.bool_or("hard_gate").alias("hard")
    )
    out = dims.groupBy("query_id", "group_id").agg(F.avg("score").alias("score"), F.bool_and("passed").alias("all"), F.bool_or(F.col("hard") & ~F.col("passed")).alias("gate"))
    return out.select("query_id", "group_id", "score", F.when(F.col("all"), "supported").when(F.col("gate"), "conflicted").otherwise("unsupported").alias("mode"))


def phrase_evidence(a: Column, b: Column, neutral: float = 0.5) -> Column:
    """struct(score, reliability, method) of two normalised phrases: equal, one within the other, alike by letter pairs, or unknown."""
    ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))
    made = lambda s, r, m: F.struct(s.cast("double").alias("score"), F.lit(float(r)).alias("reliability"), F.lit(m).alias("method"))
    by_letters = text.let(text.dice(a, b), lambda d: F.when(d >= 0.35, made(d, 1, "lexical")).otherwise(made(F.lit(neutral), 0, "inconclusive")))
    return (
        F.when((a == "") | (b == "") | a.isNull() | b.isNull(), None)
        .when(a == b, made(F.lit(1.0), 1, "exact"))
        .when(F.contains(a, b) | F.contains(b, a), made(F.greatest(F.lit(0.75), ratio), 1, "normalized"))
        .otherwise(by_letters)
    )


class PrototypeIndex:
    """The prototypes of a library as a written table, made anew when the library's generation changes or they are older than max_age seconds."""

    def __init__(self, limit: int = 12, max_age: float = 300):
        self.limit, self.max_age = limit, max_age
        self._held: tuple[object, float, DataFrame] | None = None

    def at(self, library: DataFrame, generation: object, now: float) -> DataFrame:
        """The index for a generation (null: unknown, then only its age counts) at a time in seconds."""
        held = self._held
        if held is None or now - held[1] >= self.max_age or (generation is not None and generation != held[0]):
            vectors = library.select("group_id", "asset_id", "vector")
            rows = vectors.join(prototypes(vectors, self.limit).select("asset_id", "rank"), "asset_id")
            held = self._held = (generation, now, checkpointed(rows))
        return held[2]
