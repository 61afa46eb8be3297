"""Suffix-array dedup: repeated byte strings of a minimum length go, but for their first place.

Runs of windows (strings of the minimum length) that share an anchor meet in one shuffle. Runs of one
content need no more: all but the first go, if the bytes at their source have the same digest as their
own. Where contents differ, one run of each is fetched from
its document, and blocks of such runs are resolved by threshold-bounded interval expansion: on the
Burrows-Wheeler transform of a block, breadth-first backward extension of intervals finds the common
prefixes of neighbouring suffixes by increasing value and stops at the minimum length. Suffixes with
no border between them share a string of that length; all but the first place of it go. An anchor
with more runs than a block should hold is resolved by its single windows instead, in another shuffle.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_slices, text_bytes
from .repeats import RUN, asked_for, by_document, claims, list_slices, meet, merged, own_runs, run_batch, run_rows, witnessed, written
from .superwindows import byte_spans, runs

MINIMUM, GRAM = 100, 24
#: Runs in a block, about; an anchor with over MOST_RUNS of them is resolved by windows.
BLOCK_RUNS, MOST_RUNS = 4096, 30_000


def suffix_ranks(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first `depth` symbols or more, and each suffix's place in it. Symbols: below 512."""
    n = len(text)
    key = np.zeros(n, np.int64)
    for k in range(7):
        key <<= 9
        key[: n - k] |= text[k:]
    known = 7
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.zeros(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[False], sorted_key[1:] != sorted_key[:-1]]))
        if known > depth or rank[order[-1]] == n - 1:
            place = np.empty(n, np.int64)
            place[order] = np.arange(n)
            return order, place
        key = rank * (n + 1)
        key[: max(0, n - known)] += rank[known:] + 1
        known *= 2


def borders(text: np.ndarray, order: np.ndarray, place: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix of the order and the one before it differ within `depth` symbols; symbol 0 parts strings.

    Intervals are extended backwards, level by level. At level l, an interval's rows by the symbol that
    precedes them (the transform) map to intervals one symbol longer; where such an interval ends and no
    border was known, the common prefix of the rows on either side is l. Intervals whose end was known
    are not followed. No interval is extended over a parting symbol.
    """
    n = len(text)
    precedes = (text != 0)[order - 1]
    forward = place[order - 1].astype(np.int32)  # the row of the suffix one symbol longer
    back = np.empty(n, np.int32)
    back[forward] = np.arange(n, dtype=np.int32)
    # What is before and after a row that begins with the same symbol, one symbol shorter.
    alike = text[order][1:] == text[order][:-1]
    above, below = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    above[1:][alike] = back[:-1][alike]
    below[:-1][alike] = back[1:][alike]
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    low, high = np.zeros(1, np.int32), np.full(1, n - 1, np.int32)
    for level in range(depth):
        sizes = high - low + 1
        total = int(sizes.sum(dtype=np.int64))
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int32), sizes) + np.arange(total, dtype=np.int32)
        a, b = np.repeat(low, sizes), np.repeat(high, sizes)
        if level and not (keep := precedes[rows]).all():
            rows, a, b = rows[keep], a[keep], b[keep]
        to = forward[rows]
        x, y = above[to], below[to]
        starts, ends = np.sort(to[(x < a) | (x > b)]), np.sort(to[(y < a) | (y > b)])
        new = ~known[ends + 1]
        low, high = starts[new], ends[new]
        known[high + 1] = True
        if not len(low):
            break
    return known[:n]


def repeated_windows(texts: list[bytes], docs: np.ndarray, starts: np.ndarray, minimum: int = MINIMUM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Strings of the minimum length that also start in another of the texts, at an earlier doc or start: doc, start, in which text and where."""
    sizes = np.array([len(t) for t in texts], np.int64)
    text = np.zeros(int((sizes + 1).sum()) + 1, np.int64)
    ends = np.cumsum(sizes + 1)
    inside = np.ones(len(text), bool)
    inside[ends] = False
    inside[0] = False
    text[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    order, place = suffix_ranks(text, minimum)
    border = borders(text, order, place, minimum)
    of = np.concatenate([[0], np.repeat(np.arange(len(texts)), sizes + 1)])[order]
    offset = order - (ends[of] - sizes[of])
    valid = (offset >= 0) & (offset + minimum <= sizes[of])
    group = np.cumsum(border)[valid]
    of, offset = of[valid], offset[valid]
    if not len(of):
        return (np.zeros(0, np.int64),) * 4
    # Places as numbers in their order.
    place = (np.unique(docs, return_inverse=True)[1][of] << 32) | (starts[of] + offset)
    lead = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    first = np.repeat(np.minimum.reduceat(place, lead), np.diff(np.concatenate([lead, [len(group)]])))
    later = place != first
    of, offset = of[later], offset[later]
    return docs[of], starts[of] + offset, of, offset


def _later(run: Column, first: Column) -> Column:
    return (run["doc"] > first["doc"]) | ((run["doc"] == first["doc"]) & (run["start"] > first["start"]))


def _first(run: Column, first: Column) -> Column:
    return (run["doc"] == first["doc"]) & (run["start"] == first["start"])


def repeated_spans(docs: DataFrame, minimum: int = MINIMUM, gram: int = GRAM, block_runs: int = BLOCK_RUNS, most_runs: int = MOST_RUNS) -> DataFrame:
    """doc, start, n: strings of the minimum length that also start earlier, n from each start on, with the digest of the bytes at their source (or their own, if those were compared) or the hash of their own. docs: doc_id, text."""

    def find(data: np.ndarray, ends: np.ndarray) -> tuple:
        return *runs(byte_spans(data), len(data), ends, minimum, gram), np.concatenate([[0], ends[:-1]])

    found = meet(run_rows(docs, find), _later, _first)
    claimed = written(claims(found.where(F.col("anchor").isNull())))
    asked = found.where(F.col("anchor").isNotNull())

    def fetch(part: pa.RecordBatch) -> pa.RecordBatch:
        data, at = text_bytes(part.column("text"))
        raw, ends = data.tobytes(), at
        offsets, (apart, anchor, crowd, start, n) = list_slices(part.column("spans"), ("taken_apart", "anchor", "crowd", "start", "n"))
        row = np.repeat(np.arange(part.num_rows), np.diff(offsets))
        begin = ends[row] + start
        stop = np.minimum(begin + n - 1 + minimum, ends[row + 1])
        doc, apart = part.column("doc_id").to_numpy()[row], apart.astype(bool)
        texts = [raw[a:b] if whole else None for a, b, whole in zip(begin.tolist(), stop.tolist(), apart.tolist(), strict=True)]
        digests = [None if whole else bytes_digest(raw, a, b) for a, b, whole in zip(begin.tolist(), stop.tolist(), apart.tolist(), strict=True)]
        columns = [pa.array(anchor), pa.array(crowd), pa.array(doc), pa.array(start), pa.array(n), pa.array(texts, pa.binary()), pa.array(digests, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["anchor", "crowd", "doc", "start", "n", "bytes", "digest"])

    seen = written(map_slices(docs.join(asked_for(claimed, asked), "doc_id"), fetch, "anchor long, crowd long, doc long, start int, n int, bytes binary, digest binary"))
    whole = witnessed(claimed, seen.where(F.col("digest").isNotNull()))
    contexts = seen.where(F.col("digest").isNull()).select("anchor", "crowd", "doc", "start", "bytes")
    blocks = max(1, -(-asked.count() // block_runs))

    def expand(frame: pd.DataFrame) -> pd.DataFrame:
        texts = frame["bytes"].tolist()
        doc, start, of, offset = repeated_windows(texts, frame["doc"].to_numpy(), frame["start"].to_numpy(np.int64), minimum)
        return pd.DataFrame(dict(zip(("doc", "start", "n", "digest"), in_rows(texts, doc, start, of, offset, minimum), strict=True)))

    few = contexts.where(F.col("crowd") <= most_runs).withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)))
    by_blocks = few.groupBy("block").applyInPandas(expand, "doc long, start int, n int, digest binary").withColumn("content", F.lit(0).cast("long"))

    def windows(batches):
        for part in batches:
            data, at = text_bytes(part.column("bytes"))
            counts = np.maximum(np.diff(at) - minimum + 1, 0)
            row = np.repeat(np.arange(part.num_rows), counts)
            offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            content = byte_spans(data).of(at[row] + offset, at[row] + offset + minimum)
            anchor = part.column("anchor").to_numpy().view(np.uint64)[row] ^ content
            yield run_batch(anchor, content, part.column("doc").to_numpy()[row], part.column("start").to_numpy()[row] + offset, np.ones(len(row), np.int64))

    many = contexts.where(F.col("crowd") > most_runs).mapInArrow(windows, RUN)
    by_windows = meet(many, _later, lambda run, first: F.lit(False)).select("doc", "start", "n", "content")
    return whole.unionByName(by_blocks).unionByName(by_windows.withColumn("digest", F.lit(None).cast("binary")))


def bytes_digest(raw: bytes, a: int, b: int) -> bytes:
    return hashlib.blake2b(memoryview(raw)[a:b], digest_size=16).digest()


def in_rows(texts: list[bytes], doc: np.ndarray, start: np.ndarray, of: np.ndarray, offset: np.ndarray, minimum: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Neighbouring starts in one text as doc, first start, how many, and the digest of their bytes."""
    by = np.lexsort((offset, of))
    doc, start, of, offset = doc[by], start[by], of[by], offset[by]
    lead = np.ones(len(doc), bool)
    lead[1:] = (of[1:] != of[:-1]) | (offset[1:] != offset[:-1] + 1)
    at = np.flatnonzero(lead)
    n = np.diff(np.concatenate([at, [len(doc)]]))
    digests = [bytes_digest(texts[k], a, a + m - 1 + minimum) for k, a, m in zip(of[at].tolist(), offset[at].tolist(), n.tolist(), strict=True)]
    return doc[at], start[at].astype(np.int32), n.astype(np.int32), digests


def dedup(docs: DataFrame, minimum: int = MINIMUM, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """doc_id, n_bytes, spans (start, end: the maximal runs of removed bytes), kept binary, for every row of docs.

    A byte goes if a string of `minimum` bytes covers it that also starts earlier: in a document with a
    smaller id, or in the same one before. Strings are judged on the input and never cross documents.
    Null texts are empty; texts shorter than the minimum stay whole. Rows that repeat an id are one
    document at one place: what starts earlier in one of them goes from the others, strings at one start
    stay, equal rows get equal results, and each row is cut by its own text. Rows without id are left
    as they are.
    """
    texts = id_and_text(docs, id_col, text_col)
    spans = by_document(repeated_spans(texts, minimum, **sizes), "start", "n", "content", "digest")

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        data, at = text_bytes(part.column("text"))
        offsets, start, n = own_runs(lambda: byte_spans(data), at[:-1], at[1:], part.column("spans"), minimum, partial(bytes_digest, data.tobytes()))
        kept, found = [], []
        for k, (a, b, i, j) in enumerate(zip(at[:-1], at[1:], offsets[:-1], offsets[1:], strict=True)):
            text = data[a:b]
            if i == j:
                kept.append(text.tobytes())
                found.append([])
                continue
            low, high = merged(start[i:j], n[i:j], minimum, len(text))
            ends = [0, *np.column_stack([low, high]).ravel().tolist(), len(text)]
            kept.append(b"".join(text[x:y].tobytes() for x, y in zip(ends[::2], ends[1::2], strict=True)))
            found.append([{"start": x, "end": y} for x, y in zip(low.tolist(), high.tolist(), strict=True)])
        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at)), pa.array(found, spans_type), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return map_slices(texts.join(spans, "doc_id", "left"), cut, "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")


def without_repeats(docs: DataFrame, minimum: int = MINIMUM, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", **sizes: int) -> DataFrame:
    """The rows of docs, with all their columns, and texts without the bytes that `dedup` removes.

    Characters of which only some bytes would go stay whole. The column of text lengths, if there is
    one, follows. Texts that go altogether are empty ones then; null texts stay null.
    """
    spans = by_document(repeated_spans(id_and_text(docs, id_col, text_col), minimum, **sizes), "start", "n", "content", "digest")
    spans = spans.select(F.col("doc_id").alias("_span_doc"), F.col("spans").alias("_spans"))
    kind = docs.schema

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        column = part.column(text_col)
        data, at = text_bytes(column)
        offsets, start, n = own_runs(lambda: byte_spans(data), at[:-1], at[1:], part.column("_spans"), minimum, partial(bytes_digest, data.tobytes()))
        texts = column.to_pylist()
        for k in np.flatnonzero(np.diff(offsets)):
            i, j = offsets[k], offsets[k + 1]
            text = data[at[k] : at[k + 1]]
            low, high = merged(start[i:j], n[i:j], minimum, len(text))
            gone = np.zeros(len(text), bool)
            for x, y in zip(low, high, strict=True):
                while x < y and text[x] & 0xC0 == 0x80:
                    x += 1
                while y > x and y < len(text) and text[y] & 0xC0 == 0x80:
                    y -= 1
                gone[x:y] = True
            texts[k] = text[~gone].tobytes().decode()
        columns = [pa.array(texts, column.type) if name == text_col else part.column(name) for name in kind.names]
        return pa.RecordBatch.from_arrays(columns, kind.names)

    joined = docs.join(spans, docs[id_col] == spans["_span_doc"], "left").drop("_span_doc")
    found = map_slices(joined, cut, kind, text_col=text_col)
    return found.withColumn(chars_col, F.length(text_col).cast(kind[chars_col].dataType)) if chars_col in kind.names else found
