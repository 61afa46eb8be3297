"""Best-fit packing of tokenised documents by sums of squares.

Let N(g) be the number of open sequences with g places left. A piece of s tokens goes into the open
sequence with g >= s places left for which the sum of N(g) squared becomes smallest: the sum changes
by 2 (N(g - s) - N(g)) + 2, one less where the sequence becomes full, as it is then not open any
more. Ties go to the tightest fit. Where none has room, a sequence is opened. Pieces come longest
first, so that the many short ones fill what the long ones leave.

Pieces are dealt by hash into groups of about GROUP_PIECES, whatever the corpus's size, and each group
is packed by itself; a group has a few sequences at most that are not full for want of more pieces.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .bpe import byte_letters
from .common import id_and_text, map_slices

GROUP_PIECES = 32_768
NEVER = 1 << 60
#: What precedes the merges in these vocabularies; possessive forms split alike and don't go back.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


class ByteLevel:
    """Ids of whole texts as the vocabulary's own library gives them, special strings included."""

    def __init__(self, path: str):
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(byte_of[c] for c in label): n for label, n in spec["model"]["vocab"].items() if label not in self.special}
        self.plain = tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> list[int]:
        for label, n in self.special.items():
            if label in text:
                first, *rest = text.split(label)
                return sum(([n, *self.encode(x)] for x in rest), self.encode(first))
        return self.plain(text)


@lru_cache(maxsize=1)
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


def pieces(docs: DataFrame, tokenizer: str, size: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Each document's ids and an end id, cut into pieces of `size` where there are more; the first piece takes the rest.

    A null or empty text is the end id alone. Repeated rows stay repeated.
    """

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        tool, known, rows = byte_level(tokenizer), {}, []
        for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
            if (cut := known.get(text)) is None:
                ids = np.array([*tool.encode(text), end], "<u4")
                ends = range(len(ids) % size or size, len(ids) + 1, size) if len(ids) > size else [len(ids)]
                cut = known[text] = [(k, max(0, e - size) if k else 0, e - (max(0, e - size) if k else 0), zlib.crc32(raw := ids[max(0, e - size) if k else 0 : e].tobytes()), raw) for k, e in enumerate(ends)]
            rows += [(doc, *x) for x in cut]
        doc, piece, start, length, crc, raw = zip(*rows, strict=True)
        columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        if keep_ids:
            columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in raw], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return map_slices(id_and_text(docs, id_col, text_col), work, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def place(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each piece of one group, packed in the order given."""
    count = np.zeros(size + 1, np.int64)  # N(g); N(size) and N(0) stay 0
    open_at: list[list[int]] = [[] for _ in range(size + 1)]
    sequence, offset, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for k, s in enumerate(lengths.tolist()):
        gap = size
        if s < size:
            here = count[s:size]
            change = 2 * (count[: size - s] - here) + 2
            change[0] -= 1
            change[here == 0] = NEVER
            at = int(change.argmin())
            gap = s + at if change[at] < NEVER else size
        if gap == size:
            sequence[k], made = made, made + 1
        else:
            sequence[k] = open_at[gap].pop()
            count[gap] -= 1
        offset[k] = size - gap
        if gap > s:
            open_at[gap - s].append(int(sequence[k]))
            count[gap - s] += 1
    return sequence, offset


def pack(cut: DataFrame, size: int = 1024, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The pieces with sequence_id and offset. Pieces: a frame with doc_id, piece and length (1 to size); other columns stay.

    No two groups share a sequence_id. An empty frame gives none. Equal rows are packed as different pieces.
    """
    cut = checkpointed(cut)  # read twice, and tokenised once
    groups = max(1, -(-cut.count() // group_pieces))
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("long"))

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        sequence, offset = place(frame["length"].to_numpy(), size)
        return frame.assign(sequence_id=sequence + frame["group"] * (1 << 32), offset=offset).drop(columns="group")

    kinds = ", ".join(f"`{c}` {t}" for c, t in cut.dtypes)
    return dealt.groupBy("group").applyInPandas(work, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, tokenizer, size, end, id_col, text_col), size)
