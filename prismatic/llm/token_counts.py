"""Token counts: pieces are counted once per distinct pre-token, and documents sum them by frequency.

The vocabulary's pieces never cross from a letter to a following space mark, nor over a line end.
So a text falls into pre-tokens (space marks with the word after them; a line end) whose counts add
up. A task takes the pre-token frequencies of each document of a slice, counts the pieces of the
slice's distinct pre-tokens that it does not remember, joins these counts to the frequencies and
sums. No ids are kept, and one row per document leaves the task: at corpus size the pairs of document
and pre-token would be larger than the corpus, so they are never shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, map_slices, text_bytes

SPACE = "▁"
#: Pre-tokens that a task remembers, twice over: those of late and those of before.
MEMORY_WORDS = 250_000
PRE_TOKENS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


def pre_tokens(text: str) -> list[str]:
    """The text's pre-tokens with the mark that the vocabulary puts before a text; none of an empty text."""
    if not text:
        return []
    if "  " in text or SPACE in text or text[0] == " ":
        return PRE_TOKENS.findall(SPACE + text.replace(" ", SPACE))
    words = (SPACE + text.replace(" ", " " + SPACE).replace("\n", " \n ")).split(" ")
    return words if "\n" not in text else [w for w in words if w]


class Counts:
    def __init__(self, model: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def of(self, words: set[str]) -> dict[str, int]:
        if len(self.young) > MEMORY_WORDS:
            self.young, self.old = {}, self.young
        now = {w: n for w in words if (n := self.young.get(w) or self.old.get(w))}
        new = [w for w in words if w not in now]
        # The library puts a mark before a text; a line end before it stands in for that where the pre-token has none.
        asked = [w[1:] if w[0] == SPACE else "\n" + w for w in new]
        for w, ids in zip(new, self.library.encode(asked, num_threads=1), strict=True):
            now[w] = len(ids) - 2 * (w[0] != SPACE) if w != SPACE else 1
        self.young.update(now)
        return now


@lru_cache(maxsize=1)
def counts(model: str) -> Counts:
    return Counts(model)


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens for every row of docs. A null or empty text has 0 of both; repeated rows stay."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column("text").to_pylist()
        split = {t: Counter(pre_tokens(t)) for t in set(texts)}
        pieces = counts(model).of(set().union(*split.values()))
        total = {t: sum(map(mul, map(pieces.__getitem__, c), c.values())) for t, c in split.items()}
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(text_bytes(part.column("text"))[1])), pa.array([total[t] for t in texts], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return map_slices(id_and_text(docs, id_col, text_col), work, "doc_id long, n_bytes long, n_tokens long", limit=8 << 20)
