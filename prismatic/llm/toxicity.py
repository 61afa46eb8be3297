"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, turns look-alike letters of other scripts and the digits and signs that stand
for letters into Latin letters, and puts a space for everything between words. Lexicon entries are
whole words or beginnings of words. All are found in one pass; an entry inside an exception phrase
("idiot proof") doesn't count, and of entries that begin at one place only the heaviest does. The
summed weight and the same per thousand words enter a logistic curve.

Weights are log odds, learned with the curve from labelled rows; hand-written words keep their own
weight until the labels show enough of them. At most SAMPLE_ROWS labelled rows are learned from, which a
hash picks where there are more; so the model stays small, whatever the corpus's size.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_slices
from .repeats import written

SAMPLE_ROWS, LEAST_LOG_ODDS, HAND_WEIGHT = 20_000, 2.5, 5.0
#: Lengths of the word beginnings that may become entries.
BEGINNINGS = (4, 5, 6)

#: Hand-written insults and abuse, and phrases in which they are none.
WORDS = (
    "idiot idiots idiotic moron morons moronic imbecile stupid dumb dumbass loser losers scum scumbag trash worthless pathetic disgusting clown clowns jerk "
    "bastard bitch asshole bullshit shit fuck fucking crap retard retarded degenerate vermin filth filthy parasite freak pig whore slut douche creep hate ugly "
    "idiota imbécil estúpido estúpida basura asqueroso idiote imbécile crétin débile ordure connard salaud dummkopf vollidiot arschloch abschaum scheisse miststück"
).split()
EXCEPTIONS = (
    "idiot proof",
    "idiot savant",
    "stupid simple",
    "clown fish",
    "trash can",
    "trash bin",
    "trash collection",
    "sore loser",
    "dumb waiter",
    "dumb terminal",
    "guinea pig",
    "pig iron",
    "hate crime",
    "hate to say",
    "freak accident",
    "scum line",
)
#: Look-alikes in Cyrillic and Greek and full-width forms, then digits and signs, with the letters they stand for.
LOOKALIKES = dict(zip("авеіјкмнорѕстухԁԛԝαβεικνορτυχωᴀʙᴄᴅᴇ", "abeijkmhopsctyxdqwabeiknoptuxwabcde", strict=True)) | {chr(0xFF41 + k): chr(97 + k) for k in range(26)}
DIGITS = dict(zip("013457@$!", "oieastasi", strict=True))

BETWEEN = {c: " " for c in [*map(chr, range(128)), *map(chr, range(0xA0, 0xC0)), *map(chr, range(0x2000, 0x2070)), "　", "×", "÷"] if not c.isalnum() or c in "²³¹¼½¾"}
ZERO_WIDTH = dict.fromkeys("­​‌‍⁠﻿", "")
FOLD = str.maketrans(BETWEEN | LOOKALIKES | ZERO_WIDTH | {k: v for k, v in DIGITS.items() if k.isdigit()})
#: Signs stand for letters only between letters.
SIGN = re.compile(r"(?<=[^\W\d_])[@$!]+(?=[^\W\d_])")


def fold(text: str) -> str:
    text = text.lower()
    if "@" in text or "$" in text or "!" in text:
        text = SIGN.sub(lambda m: "".join(DIGITS[c] for c in m[0]), text)
    return f" {text.translate(FOLD)} "


@dataclass(frozen=True)
class Model:
    """Entries (" word " or " beginning") with weights, and the curve: a constant, and factors of the two measures."""

    entries: tuple[tuple[str, float], ...]
    curve: tuple[float, float, float]


class Matcher:
    def __init__(self, model: Model):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for entry, weight in model.entries:
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in EXCEPTIONS:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
        self.automaton.make_automaton()

    def evidence(self, text: str) -> tuple[float, int]:
        """The summed weight of what counts in the text, and its number of words."""
        folded = fold(text)
        best: dict[int, float] = {}
        exempt: list[tuple[int, int]] = []
        for end, (size, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if weight is None:
                exempt.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        for a, b in exempt:
            for start in range(a, b):
                best.pop(start, None)
        return math.fsum(best.values()), len(folded.split()) if best else 0


@lru_cache(maxsize=4)
def matcher(model: Model) -> Matcher:
    return Matcher(model)


def measures(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(total)), np.log1p(total), np.log1p(1000 * total / np.maximum(words, 1))])


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(id_col.cast("string")) % 5 == 0


def features(text: str) -> set[str]:
    words = set(fold(text).split())
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:n]}" for w in words for n in BEGINNINGS if len(w) >= n}


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from the labelled rows that are not held out. Without any it is the hand-written words and a fixed curve.

    Null labels, labels of no document and documents without label are not learned from. Of labels that
    repeat an id the highest counts, of documents that do the one whose text sorts first; equal texts of
    one label count once. So the model doesn't depend on how rows are dealt.
    """
    labelled = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    labelled = labelled.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = id_and_text(docs, id_col, text_col).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    rows = written(rows.select("text", (F.col("label") > 0).alias("toxic")).distinct())
    total = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    weights = {f" {w} ": HAND_WEIGHT for w in WORDS}
    if len(total) < 2:
        return Model(tuple(sorted(weights.items())), (-6.0, 2.0, 1.0))

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        found = (Counter(), Counter())
        for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
            found[toxic].update(features(text))
        keys = list(found[0] | found[1])
        return pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array([c[k] for k in keys], pa.int64()) for c in found)], ["entry", "clean", "toxic"])

    counted = map_slices(rows, count, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    least = max(4, math.ceil(0.005 * total[True]))
    strong = (F.col("toxic") >= least) & (F.log((F.col("toxic") + 0.5) / (total[True] + 1)) - F.log((F.col("clean") + 0.5) / (total[False] + 1)) >= LEAST_LOG_ODDS)
    # Few come back: an entry needs `least` of the sample's toxic rows, each of which has no more entries than its words have beginnings.
    found = {r["entry"]: (r["clean"], r["toxic"]) for r in counted.where(strong | F.col("entry").isin([*weights])).collect()}
    odds = {e: math.log((toxic + 0.5) / (total[True] + 1)) - math.log((clean + 0.5) / (total[False] + 1)) for e, (clean, toxic) in found.items()}
    for entry in weights.keys() & found.keys():
        if sum(found[entry]) >= 5 and odds[entry] < LEAST_LOG_ODDS:
            del weights[entry]
    for entry in sorted((e for e in found if found[e][1] >= least and odds[e] >= LEAST_LOG_ODDS), key=lambda e: (-round(odds[e] * found[e][1], 6), e)):
        begins = (weights.get(entry.rstrip()[: n + 1], 0.0) for n in BEGINNINGS if n + 1 < len(entry))
        if max(begins, default=0.0) < odds[entry] - 0.5:
            weights[entry] = max(odds[entry], weights.get(entry, 0.0))
    model = Model(tuple(sorted(weights.items())), (-6.0, 2.0, 1.0))

    def weigh(part: pa.RecordBatch) -> pa.RecordBatch:
        found = [matcher(model).evidence(t) for t in part.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([part.column("toxic"), *(pa.array(x, pa.float64()) for x in zip(*found, strict=True))], ["toxic", "total", "words"])

    # Of fixed size: no more than the sample's rows.
    table = map_slices(rows, weigh, "toxic boolean, total double, words double").toPandas().sort_values(["toxic", "total", "words"])
    return Model(model.entries, _fitted(measures(table["total"].to_numpy(), table["words"].to_numpy()), table["toxic"].to_numpy(float)))


def _fitted(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.1 * np.eye(len(w)), x.T @ (p - y) + 0.1 * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def scores(texts: list[str], model: Model) -> np.ndarray:
    found = {t: matcher(model).evidence(t) for t in set(texts)}
    total, words = np.array([found[t] for t in texts], float).reshape(-1, 2).T
    return 1 / (1 + np.exp(-np.clip(measures(total, words) @ np.array(model.curve), -30, 30)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) for every row of docs. A null or empty text has the score of one without any entry; repeated rows stay."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores(part.column("text").to_pylist(), model))], ["doc_id", "score"])

    return map_slices(id_and_text(docs, id_col, text_col), work, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is below the threshold; null texts are scored as empty ones. Each of repeated rows stays or goes as the others do."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        return part.filter(pa.array(scores([t or "" for t in part.column(text_col).to_pylist()], model) < threshold))

    return map_slices(docs, work, docs.schema, text_col=text_col)
