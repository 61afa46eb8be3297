"""Near-duplicates by BagMinHash, bands and exact multiset overlap.

A document is a bag of shingles (five words in a row), weighted by how often each occurs. A shingle has
a Poisson process over weight and time: weights fall into blocks [0, 1), [1, 2), [2, 4), [4, 8) and so
on, each with a process of a rate of its length, whose points come by increasing time with a place in
the block and a register. The points below the shingle's weight count. A register's value is the
time of its first point over all shingles, so two documents agree in a register with the probability
of their weighted Jaccard similarity. A document's processes stop once they are past its largest
register: about m log m points a document and one or two a shingle are made.

Equal bags are one class from the start. Of the others, those that agree in a band of registers are
candidates. In each bucket all are compared with a pivot, by the exact overlap of their bags; verified
links make classes (connected components). Most buckets are one class then, at the cost of their size.
The bags of the others, crowds of documents that are loosely alike among them, are told apart by their
rarest elements: with elements in one order, those that fewest of these bags hold first, two bags of a
similarity of t share one within the first part of either that an overlap of t leaves room for. Bags of
different classes that share such an element and could still overlap enough are compared too. This loses
no candidate link, and documents that have much in common and too little to be alike don't meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, map_slices, text_bytes
from .components import components
from .repeats import discard, written
from .superwindows import FACTOR, Spans, digest, mixed, word_hashes

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 32, 5
#: Bytes of text in a slice; the hashes and processes of a slice take some hundred bytes a byte.
BAG_BYTES = 1 << 20

#: Bytes of words, and lower case for ASCII.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def shingles(data: np.ndarray, at: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each shingle of concatenated texts, and where each text's begin and end; a text of fewer words is one shingle, one without words has none."""
    data = LOWER[data]
    inside = IN_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at[1:-1]] = True
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    first, last = np.flatnonzero(start), np.flatnonzero(stop) + 1
    word_at = np.searchsorted(first, at)
    counts = np.diff(word_at)
    each = np.maximum(counts - words + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(counts)), each)
    begin = word_at[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
    end = np.minimum(begin + words, word_at[doc + 1])
    return Spans(word_hashes(data, first, last), 4).of(begin, end), np.concatenate([[0], np.cumsum(each)])


def bags(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, element (44 bits) and weight, by document and element."""
    doc = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
    key = np.sort((doc << np.uint64(44)) | (hashes >> np.uint64(20)))
    lead = np.ones(len(key), bool)
    lead[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(lead)
    return (key[first] >> np.uint64(44)).astype(np.int64), key[first] & np.uint64((1 << 44) - 1), np.diff(np.concatenate([first, [len(key)]]))


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """The first point's time of each register; rows without elements are infinite."""
    out = np.full(docs * registers, np.inf)
    # A process for each block that begins below the weight.
    blocks = np.where(weight > 1, np.frexp(np.maximum(weight - 1, 1))[1] + 1, 1)
    which = np.repeat(np.arange(len(doc)), blocks)
    block = np.arange(len(which)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    doc, weight = doc[which], weight[which]
    low = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)
    length = np.maximum(low, 1)
    seed = mixed(element[which] * np.uint64(64) + block.astype(np.uint64))
    time = np.zeros(len(doc))
    step = 0
    while len(doc):
        step += 1
        r = mixed(seed + np.uint64(step * int(FACTOR) % (1 << 64)))
        time = time - np.log(((r >> np.uint64(24)).astype(np.float64) + 0.5) / (1 << 40)) / length
        r = mixed(r)
        place = low + ((r >> np.uint64(32)).astype(np.int64) * length >> 32)
        register = ((r & np.uint64(0xFFFFFFFF)).astype(np.int64) * registers) >> 32
        counts = place < weight
        np.minimum.at(out, doc[counts] * registers + register[counts], time[counts])
        on = time < out.reshape(docs, registers).max(axis=1)[doc]
        doc, weight, low, length, seed, time = doc[on], weight[on], low[on], length[on], seed[on], time[on]
    return out.reshape(docs, registers)


def bag_hashes(data: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """A hash of each text's whole bag, of the text itself where it has no words; its shingles; where each text's end; and the bags."""
    hashes, ends = shingles(data, at, words)
    doc, element, weight = found = bags(hashes, ends)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(element * FACTOR + weight.astype(np.uint64)), dtype=np.uint64)])
    place = np.searchsorted(doc, np.arange(len(at)))
    bag = sums[place[1:]] - sums[place[:-1]]
    for k in np.flatnonzero(np.diff(ends) == 0).tolist():
        bag[k] = digest(data[at[k] : at[k + 1]].tobytes())
    return bag, hashes, ends, found


def signed_up(texts: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, bag (the hash of the whole bag), bands array<long> (empty where it has no words) and the bag's size. texts: with text_key."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        data, at = text_bytes(part.column("text"))
        bag, _, ends, (doc, element, weight) = bag_hashes(data, at, words)
        value = signatures(doc, element, weight, part.num_rows, bands * rows).view(np.uint64).reshape(part.num_rows, bands, rows)
        key = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1), value.shape[:2]).copy()
        for k in range(rows):
            key = mixed(key * FACTOR + value[:, :, k])
        some = np.diff(ends) > 0
        counts = np.where(some, bands, 0)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(key[some].ravel().view(np.int64)))
        columns = [part.column("doc_id"), part.column("text_key"), pa.array(bag.view(np.int64)), lists, pa.array(np.diff(ends).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "bag", "bands", "size"])

    return map_slices(texts, work, "doc_id long, text_key long, bag long, bands array<long>, size int", limit=BAG_BYTES)


def bag_columns(texts: DataFrame, words: int) -> DataFrame:
    """Each text's bag: its hash, and its elements as sorted 32-bit hashes, repeated as often as they occur."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        bag, hashes, ends, _ = bag_hashes(*text_bytes(part.column("text")), words)
        small = (hashes >> np.uint64(32)).astype("<u4")
        return pa.RecordBatch.from_arrays([pa.array(bag.view(np.int64)), pa.array([np.sort(small[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["bag", "hashes"])

    return map_slices(texts, work, "bag long, hashes binary", limit=BAG_BYTES)


def elements(bag: DataFrame) -> DataFrame:
    """bag, size and element, a row for each element; the second of equal ones is another element than the first, and so on."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        flat, at = text_bytes(part.column("hashes"))
        flat, at = flat.view("<u4").astype(np.uint64), at // 4
        of = np.repeat(np.arange(part.num_rows), np.diff(at))
        lead = np.ones(len(flat), bool)
        lead[1:] = (flat[1:] != flat[:-1]) | (of[1:] != of[:-1])
        first = np.flatnonzero(lead)
        time = (np.arange(len(flat)) - first[np.cumsum(lead) - 1]).astype(np.uint64)
        element = mixed(flat << np.uint64(32) | time)
        return pa.RecordBatch.from_arrays([part.column("bag").take(pa.array(of)), pa.array(np.diff(at)[of].astype(np.int32)), pa.array(element.view(np.int64))], ["bag", "size", "element"])

    return map_slices(bag, work, "bag long, size int, element long", limit=BAG_BYTES, text_col="hashes")


def overlaps(x: np.ndarray, x_at: np.ndarray, y: np.ndarray, y_at: np.ndarray) -> np.ndarray:
    """How many elements each bag of x shares with the one of y at its place, with multiplicity."""
    n = len(x_at) - 1
    number = np.arange(n, dtype=np.uint64) << np.uint64(33)
    sides = [np.repeat(number, np.diff(at)) | (flat.astype(np.uint64) << np.uint64(1)) | np.uint64(side) for side, (flat, at) in enumerate(((x, x_at), (y, y_at)))]
    key = np.sort(np.concatenate(sides))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times, key = np.diff(np.concatenate([first, [len(key)]])), key[first]
    both = np.flatnonzero(key[1:] >> np.uint64(1) == key[:-1] >> np.uint64(1))
    return np.bincount((key[both] >> np.uint64(33)).astype(np.int64), weights=np.minimum(times[both], times[both + 1]), minlength=n).astype(np.int64)


def verified(pairs: DataFrame, bag: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose bags have at least this weighted Jaccard similarity."""
    left = bag.select(F.col("bag").alias("a"), F.col("hashes").alias("x"))
    right = bag.select(F.col("bag").alias("b"), F.col("hashes").alias("y"))

    def check(part: pa.RecordBatch) -> pa.RecordBatch:
        (x, x_at), (y, y_at) = ((data.view("<u4"), at // 4) for data, at in (text_bytes(part.column(c)) for c in "xy"))
        both = overlaps(x, x_at, y, y_at)
        good = both >= similarity * (np.diff(x_at) + np.diff(y_at) - both) - 1e-9
        return pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(good))

    return map_slices(pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y"), check, "a long, b long", limit=BAG_BYTES, text_col="x")


def with_class(frame: DataFrame, classes: DataFrame) -> DataFrame:
    """The frame with the class of its column bag; one without links is its own."""
    found = classes.select(F.col("node").alias("bag"), "component")
    return frame.join(found, "bag", "left").withColumn("class", F.coalesce("component", "bag")).drop("component")


def sharing_rare(members: DataFrame, bag: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of members of different classes that share one of their rarest elements and could reach the similarity. members: bag, class."""
    rows = elements(bag.join(members.select("bag"), "bag", "left_semi"))
    rows = written(rows)
    shared = rows.groupBy("element").agg(F.count("*").alias("held")).where(F.col("held") > 1)
    own = Window.partitionBy("bag")
    # Elements of one bag alone come first in the order, and needn't be there.
    placed = rows.join(shared, "element").withColumns({"rank": F.row_number().over(own.orderBy("held", "element")), "met": F.count("*").over(own)})
    placed = placed.withColumn("left", F.col("met") - F.col("rank") + 1).where(F.col("left") >= similarity * F.col("size") - 1e-9)
    placed = written(placed.join(members, "bag").select("element", "bag", "class", "size", "left"))
    discard(rows)
    mixed_ones = placed.groupBy("element").agg(F.min("class").alias("low"), F.max("class").alias("high")).where(F.col("low") != F.col("high")).select("element")
    placed = placed.join(mixed_ones, "element")
    a, b = placed.alias("a"), placed.alias("b")
    # From a shared element on, the smaller rest must hold the overlap.
    enough = F.least("a.left", "b.left") >= similarity / (1 + similarity) * (F.col("a.size") + F.col("b.size")) - 1e-9
    found = a.join(b, (F.col("a.element") == F.col("b.element")) & (F.col("a.class") < F.col("b.class")) & enough)
    return found.select(F.col("a.bag").alias("a"), F.col("b.bag").alias("b")).distinct()


def classified(docs: DataFrame, similarity: float, words: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key (a hash of the text) and class_id for every row of docs with an id."""
    texts = id_and_text(docs, id_col, text_col).where(F.col("doc_id").isNotNull()).withColumn("text_key", F.xxhash64("text"))
    known = written(signed_up(texts, words, bands, rows))
    reps = known.groupBy("bag").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    entries = reps.where(F.size("bands") > 0).select("bag", "rep", "size", F.explode("bands").alias("band"))
    crowds = entries.groupBy("band").agg(F.count("*").alias("crowd")).where(F.col("crowd") > 1)
    entries = written(entries.join(crowds, "band"))
    met = written(entries.groupBy("bag").agg(F.sum("crowd").alias("met"), F.min("rep").alias("rep")))
    bag = written(bag_columns(texts.join(met.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), words))
    # In half of the buckets the bag that meets most others is the pivot (as a rule, the original of many copies).
    rank = F.struct(F.when(F.col("band") % 2 == 0, -F.col("met")).otherwise(0).alias("met"), F.xxhash64("bag", "band").alias("h"), "bag", "size")
    pivots = entries.join(met.select("bag", "met"), "bag").groupBy("band").agg(F.min(rank).alias("p")).select("band", F.col("p.bag").alias("pivot"), F.col("p.size").alias("pivot_size"))
    fits = F.least("size", "pivot_size") >= similarity * F.greatest("size", "pivot_size") - 1e-9
    pairs = entries.join(pivots, "band").where((F.col("bag") != F.col("pivot")) & fits)
    pairs = pairs.select(F.least("pivot", "bag").alias("a"), F.greatest("pivot", "bag").alias("b")).distinct()
    first = components(verified(pairs, bag, similarity))
    # Buckets of more than one class: what they hold has not all been compared.
    placed = with_class(entries.select("band", "bag"), first)
    kinds = placed.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high")).where(F.col("low") != F.col("high")).select("band")
    members = written(placed.join(kinds, "band").select("bag", "class").distinct())
    links = verified(sharing_rare(members, bag, similarity), bag, similarity)
    between = with_class(with_class(links.withColumnRenamed("a", "bag"), first).select("b", F.col("class").alias("a")).withColumnRenamed("b", "bag"), first)
    second = components(between.select("a", F.col("class").alias("b")))
    class_of = with_class(with_class(reps.select("bag", "rep"), first).withColumnsRenamed({"bag": "own", "class": "bag"}), second).select(F.col("own").alias("bag"), "rep", "class")
    least = class_of.groupBy("class").agg(F.min("rep").alias("class_id"))
    class_of = written(class_of.join(least, "class").select("bag", "class_id"))
    discard(entries, met, bag, members)
    return known.select("doc_id", "text_key", "bag").join(class_of, "bag").select("doc_id", "text_key", "class_id")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and class_id (the least doc_id of the class) for every row of docs with an id.

    Words are runs of letters and digits, ASCII ones lower-cased. Texts with the same bag are of one
    class; so are texts without words that are equal, null and empty ones among them. A row is judged by
    its own text: rows that repeat an id have the classes of their texts. Rows without id are left out.
    """
    return classified(docs, similarity, words, bands, rows, id_col, text_col).select("doc_id", "class_id")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, but for those whose class has a smaller id. Rows without id stay, and so do all rows of the smallest id of a class."""
    found = classified(docs, similarity, words, bands, rows, id_col, text_col)
    gone = found.where(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key")).distinct()
    own = (docs[id_col].cast("long") == gone["_gone_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == gone["_gone_key"])
    return docs.join(gone, own, "left_anti")
