"""A prefix trie of conversations: which turns begin alike, and how much is saved when each shared turn is held once.

A turn is a digest of its role and text, and a conversation a path of digests; equal paths are one row with the number
of its conversations. Paths are dealt into buckets by the digest of their first turn, and a trie of dictionaries is built
for each first turn and summed from its leaves up. A group with too many turns is not built: its first turn is
a node of its own, aggregated over all its rows, and its paths are dealt again by their next turn, and
so on until every group is small. What the groups found is then added up along these nodes, the deepest first.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .repeats import written

#: Turns of a group that one task builds a trie from, unless they are a single path.
GROUP_TURNS = 50_000
#: Turns of a bucket of such groups, about.
BUCKET_TURNS = 20_000
#: Conversations c - c % BLOCK to c are variants of the first of them, which share fewer than SHARED turns with it.
BLOCK, SHARED = 5, 9
EMPTY = bytes()
NODE = "key binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def digest(value: Column) -> Column:
    """128 bits of SHA-256."""
    return F.unhex(F.left(F.sha2(value.cast("binary"), 256), F.lit(32)))


def turn_rows(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, place (from 1), turn (digest), size (bytes of the text) of every turn; rows without conv_id are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turn = digest(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("at"), turn.alias("turn"), F.octet_length(text).cast("long").alias("size"))
    # Variants of one conversation lie together from here on.
    rows = rows.withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK).repartition("base")
    order = Window.partitionBy("base", "conv_id").orderBy(F.asc_nulls_first("at"), "turn")
    return rows.withColumn("place", F.row_number().over(order)).drop("at")


def shared_turns(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % SHARED


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, path (digests), sizes: the first turns of a conversation's base, then its own after as many."""
    own, base, place = F.col("conv_id"), F.col("base"), F.col("place")
    row = lambda conv, part: F.struct(conv.alias("conv_id"), F.lit(part).alias("part"), place.alias("place"), F.col("turn"), F.col("size"))
    near = F.array(*[F.lit(k).cast("long") for k in range(1 - BLOCK, BLOCK)])
    variants = F.filter(F.transform(near, lambda k: F.try_add(base, k)), lambda c: (c - c % BLOCK == base) & (place <= shared_turns(c)))
    none = F.array().cast("array<struct<conv_id:bigint,part:int,place:int,turn:binary,size:bigint>>")
    rows = F.concat(
        F.when(place == 1, F.array(row(own, 0))).otherwise(none),  # that there is such a conversation
        F.when((own == base) & (place < SHARED), F.transform(variants, lambda c: row(c, 1))).otherwise(none),
        F.when(place > shared_turns(own), F.array(row(own, 2))).otherwise(none),
    )
    each = turns.select("base", F.inline(rows))
    whole = each.groupBy("base", "conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "place", "turn", "size"))).alias("rows"))
    whole = whole.where(F.col("rows")[0]["part"] == 0).select("conv_id", F.slice("rows", F.lit(2), F.size("rows")).alias("rows"))
    return whole.select("conv_id", F.col("rows.turn").alias("path"), F.col("rows.size").alias("sizes"))


def ends(paths: DataFrame) -> DataFrame:
    """whole (digest of a path), ends_sha256 of its conversations' ids in order. Ids are read in order and hashed as they come, so a path may have any number of them."""

    def work(batches):
        at, running = None, hashlib.sha256()
        for batch in batches:
            found = []
            wholes, ids = batch.column("whole").to_pylist(), batch.column("conv_id").to_pylist()
            lead = [0, *(k for k in range(1, len(ids)) if wholes[k] != wholes[k - 1]), len(ids)]
            for a, b in zip(lead[:-1], lead[1:], strict=True):
                if a == b:
                    continue
                if wholes[a] == at:
                    running.update(b",")
                else:
                    if at is not None:
                        found.append((at, running.hexdigest()))
                    at, running = wholes[a], hashlib.sha256()
                running.update(",".join(map(str, ids[a:b])).encode())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([x for _, x in found], pa.string())], ["whole", "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([running.hexdigest()])], ["whole", "ends_sha256"])

    return paths.select("whole", "conv_id").repartition("whole").sortWithinPartitions("whole", "conv_id").mapInArrow(work, "whole binary, ends_sha256 string")


def group_trie(frame: pd.DataFrame) -> pd.DataFrame:
    """The nodes of all tries of a bucket, from the turn on that the paths of a trie share; key and parent are those of its top node, null for the others."""
    tops: dict[bytes, int] = {}
    children: list[dict[bytes, int]] = []
    above, depths, least, convs, size, ended, keys, parents = [], [], [], [], [], [], [], []

    def made(over: int, depth: int, conv: int, its_size: int, key: bytes | None = None, parent: bytes | None = None) -> int:
        for column, value in ((children, {}), (above, over), (depths, depth), (least, conv), (convs, 0), (size, its_size), (ended, None), (keys, key), (parents, parent)):
            column.append(value)
        return len(children) - 1

    for key, parent, depth, path, sizes, conv, n, sha in zip(*(frame[c].tolist() for c in ("key", "parent", "depth", "path", "sizes", "least", "convs", "ends_sha256")), strict=True):
        path, sizes = list(path), sizes.tolist()
        node = tops.get(key)
        if node is None:
            node = tops[key] = made(-1, depth, conv, sizes[depth - 1], key, parent)
        for k in range(depth, len(path) + 1):
            convs[node] += n
            least[node] = min(least[node], conv)
            if k < len(path):
                below = children[node].get(path[k])
                if below is None:
                    below = children[node][path[k]] = made(node, k + 1, conv, sizes[k])
                node = below
        ended[node] = sha
    leaves = [0 if c else 1 for c in children]
    saved = [(n - 1) * s for n, s in zip(convs, size, strict=True)]
    # A node is made after the one above it, so the other way round each comes after all below it.
    for node in range(len(children) - 1, -1, -1):
        if above[node] >= 0:
            leaves[above[node]] += leaves[node]
            saved[above[node]] += saved[node]
    columns = {"key": keys, "parent": parents, "conv_id": least, "depth": depths, "parent_conv_id": pd.array([least[a] if a >= 0 else None for a in above], "Int64")}
    return pd.DataFrame(columns | {"n_convs": convs, "n_children": [len(c) for c in children], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ended})


def prefix_trie(
    conversations: DataFrame, group_turns: int = GROUP_TURNS, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """A row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are in the order of their numbers, null ones first; of equal numbers in that of a digest, so repeated
    rows are turns of their own, and it doesn't matter how rows lie. Null roles and texts are empty. Rows without conv_id are left out.
    An empty table has no nodes, not even a root. Texts may have any length; a conversation is held as
    24 bytes a turn.
    """
    paths = rebuilt(turn_rows(conversations, conv_col, turn_col, role_col, text_col))
    chained = F.aggregate("path", F.lit(EMPTY), lambda key, turn: digest(F.concat(key, turn)))
    paths = written(paths.withColumn("whole", chained))
    distinct = paths.groupBy("whole").agg(F.min("conv_id").alias("least"), F.count("*").alias("convs"), F.min(F.struct("path", "sizes")).alias("rows"))
    rest = written(distinct.join(ends(paths), "whole").select("least", "convs", "rows.path", "rows.sizes", "ends_sha256", F.lit(EMPTY).alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).alias("depth")))
    depth, small, large = 0, [], []
    while not rest.isEmpty():
        here = F.when(F.size("path") == depth, F.col("ends_sha256"))
        size = F.col("sizes")[depth - 1] if depth else F.lit(0).cast("long")
        large.append(written(rest.groupBy("key").agg(F.min("parent").alias("parent"), F.min("least").alias("conv_id"), F.sum("convs").alias("n_convs"), F.min(size).alias("size"), F.max(here).alias("ends_sha256"))))
        below = rest.where(F.size("path") > depth).withColumns({"parent": F.col("key"), "key": digest(F.concat("key", F.col("path")[depth])), "depth": F.lit(depth + 1)})
        sizes = below.groupBy("key").agg(F.count("*").alias("paths"), F.sum(F.size("path") - depth).alias("turns"))
        big = (F.col("paths") > 1) & (F.col("turns") > group_turns)
        dealt = written(below.join(sizes, "key").withColumn("big", big).drop("paths", "turns"))
        small.append(dealt.where(~F.col("big")).drop("big"))
        rest = dealt.where("big").drop("big")
        depth += 1
    if not large:
        return conversations.sparkSession.createDataFrame([], NODE).drop("key", "parent")

    groups = small[0]
    for more in small[1:]:
        groups = groups.unionByName(more)
    # Many first turns are of few conversations: tries are built a bucket at a time, dealt by the digests.
    turns = groups.agg(F.sum(F.size("path") - F.col("depth") + 1)).first()[0] or 0
    buckets = groups.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(max(1, -(-turns // BUCKET_TURNS)))))
    built = written(buckets.groupBy("bucket").applyInPandas(group_trie, NODE))
    tops = built.where(F.col("key").isNotNull())
    # The nodes that no group built, from the deepest up.
    above, found = None, []
    for level in range(len(large) - 1, -1, -1):
        under = tops.where(F.col("depth") == level + 1)
        under = under.select("parent", "n_leaves", "saved_tokens") if above is None else under.select("parent", "n_leaves", "saved_tokens").unionByName(above.select("parent", "n_leaves", "saved_tokens"))
        sums = under.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        node = large[level].join(sums, "key", "left").select(
            "key", "parent", "conv_id", F.lit(level).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("size") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"), "ends_sha256",
        )
        above = written(node)
        found.append(above)
    upper = found[0]
    for more in found[1:]:
        upper = upper.unionByName(more)
    names = upper.select(F.col("key").alias("parent"), F.col("conv_id").alias("above"))
    joined = upper.unionByName(tops).join(names, "parent", "left").withColumn("parent_conv_id", F.col("above")).drop("above")
    nodes = joined.unionByName(built.where(F.col("key").isNull())).drop("key", "parent")
    return nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
