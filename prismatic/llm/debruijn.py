"""Substring dedup over a De Bruijn graph of words.

Thirteen words in a row are an edge between two nodes of twelve words. A run of edges of a document
that share an anchor is a path. Paths meet by anchor in one shuffle. Where all paths of an anchor are
equal the graph doesn't branch there, and they compact to one, whose source is the first document that
has it: the copies in later documents go whole, joined to the longest spans that their sources are
neighbours in, too. The words at a span's source coordinates are looked up, and the span goes only if its
own words are the same, by a digest of 128 bits. Where paths differ, the graph branches; those of each
content's first document are taken apart again, and their edges meet by content, each with its own
source. So only branching places are looked at edge by edge.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_slices, text_bytes
from .repeats import DIGESTED, asked_for, by_document, claims, list_slices, meet, merged, own_runs, run_batch, run_rows, with_digests, witnessed, written
from .superwindows import Spans, mixed, runs, word_numbers

WINDOW, GRAM = 13, 5


def _other_document(run: Column, first: Column) -> Column:
    return run["doc"] > first["doc"]


def _first_document(run: Column, first: Column) -> Column:
    return run["doc"] == first["doc"]


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc, start, n: edges that also start in a smaller document, n from each word on, with the digest of the words at their source or the hash of their own. docs: doc_id, text."""

    def find(data: np.ndarray, ends: np.ndarray) -> tuple:
        numbers, _, _, word_ends = word_numbers(data, ends)
        return *runs(Spans(numbers, 4), len(numbers), word_ends, window, gram), np.concatenate([[0], word_ends[:-1]])

    found = meet(run_rows(docs, find), _other_document, _first_document)
    claimed = written(claims(found.where(F.col("anchor").isNull())))
    wanted = asked_for(claimed, found.where(F.col("anchor").isNotNull()))

    def look(part: pa.RecordBatch) -> pa.RecordBatch:
        data, at = text_bytes(part.column("text"))
        numbers, first, last, word_ends = word_numbers(data, at[1:])
        starts = np.concatenate([[0], word_ends[:-1]])
        offsets, (apart, start, n) = list_slices(part.column("spans"), ("taken_apart", "start", "n"))
        row = np.repeat(np.arange(part.num_rows), np.diff(offsets))
        fits = starts[row] + start + n - 1 + window <= word_ends[row]  # not so only for a text that shares its id with another
        asked = fits & apart.astype(bool)
        ids = part.column("doc_id").to_numpy()
        of = np.flatnonzero(fits & ~asked)
        low = starts[row[of]] + start[of]
        digests = ids[row[of]], start[of], n[of], [words_digest(data, first, last, a, b) for a, b in zip(low.tolist(), (low + n[of] - 1 + window).tolist(), strict=True)]
        row, start, n = row[asked], start[asked], n[asked]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place, doc = np.repeat(start, n) + inner, np.repeat(row, n)
        low = starts[doc] + place
        spans = Spans(numbers, 4)
        # Two hashes that don't follow from each other: a window is its own anchor, by another one than its content.
        edges = run_batch(mixed(spans.of(low, low + window - 1)) ^ spans.of(low + 1, low + window), spans.of(low, low + window), ids[doc], place, np.ones(len(doc), np.int64))
        return with_digests(edges, *digests)

    seen = written(map_slices(docs.join(wanted, "doc_id"), look, DIGESTED))
    branching = meet(seen.where(F.col("digest").isNull()).drop("digest"), _other_document, lambda run, first: F.lit(False))
    return witnessed(claimed, seen.where(F.col("digest").isNotNull())).unionByName(branching.select("doc", "start", "n", "content", F.lit(None).cast("binary").alias("digest")))


def words_digest(data: np.ndarray, first: np.ndarray, last: np.ndarray, a: int, b: int) -> bytes:
    """A digest of the words from a to b, whatever parts them."""
    return hashlib.blake2b(b" ".join(data[first[a] : last[b - 1]].tobytes().split()), digest_size=16).digest()


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, spans (start, end: the maximal runs of removed words), kept string, for every row of docs.

    Words are what white space parts. A word goes if a window covers it whose words also start in a
    document with a smaller id; windows are judged on the input and never cross documents. Kept words
    are joined by one space. Null and empty texts have no words; shorter texts than a window stay
    whole. Rows that repeat an id are never compared with each other, and each is cut by its own text:
    equal rows get equal results. Rows without id are left as they are.
    """
    texts = id_and_text(docs, id_col, text_col)
    spans = by_document(repeated_spans(texts, window, gram), "start", "n", "content", "digest")

    def cut(part: pa.RecordBatch) -> pa.RecordBatch:
        data, at = text_bytes(part.column("text"))
        numbers, first, last, word_ends = word_numbers(data, at[1:])
        starts = np.concatenate([[0], word_ends[:-1]])
        offsets, start, n = own_runs(lambda: Spans(numbers, 4), starts, word_ends, part.column("spans"), window, lambda a, b: words_digest(data, first, last, a, b))
        kept, found = [], []
        for k, (i, j) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            a, size = starts[k], int(word_ends[k] - starts[k])
            low, high = merged(start[i:j], n[i:j], window, size)
            stay = np.ones(size, bool)
            for x, y in zip(low, high, strict=True):
                stay[x:y] = False
            text = data[at[k] : at[k + 1]].tobytes()
            begin, end = first[a : a + size] - at[k], last[a : a + size] - at[k]
            # As many words at once as stand with one space between them.
            b, e = begin[stay], end[stay]
            lead = np.ones(len(b), bool)
            lead[1:] = ~((b[1:] == e[:-1] + 1) & (np.frombuffer(text, np.uint8)[e[:-1]] == 32)) if len(b) else True
            at_lead = np.flatnonzero(lead)
            ends = np.concatenate([at_lead[1:], [len(b)]]) - 1
            kept.append(b" ".join([text[x:y] for x, y in zip(b[at_lead].tolist(), e[ends].tolist(), strict=True)]) if len(b) else b"")
            found.append([{"start": x, "end": y} for x, y in zip(low.tolist(), high.tolist(), strict=True)])
        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        words = pa.array(word_ends - starts)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), words, pa.array(found, spans_type), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "spans", "kept"])

    return map_slices(texts.join(spans, "doc_id", "left"), cut, "doc_id long, n_words long, spans array<struct<start:int,end:int>>, kept string")
