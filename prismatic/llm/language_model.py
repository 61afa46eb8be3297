"""Scores of whole texts by a language model that is learned from the training documents among them.

Everything is counted over all training documents: words, for the base score; ids, of which the commonest and
all single bytes make up the model's vocabulary; and pairs of neighbouring ids. The model's weights see every
training id once: documents are dealt by hash into shards, whose number follows the number of ids,
tasks learn from one shard each, and the weights are averaged by the ids that they have seen. All start from the weights that
the first shard gives when it is learned from a few times. So the model depends on the documents, not on how their rows are dealt.

Commonest words go to all tasks, as many as HEAD_WORDS at most; what the others count is joined to the documents that have them.
"""

from __future__ import annotations

import base64
import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention
from .common import BATCH_BYTES, id_and_text, map_slices, slices
from .repeats import written

#: Ids of the model, words that go to all tasks, distinct words that a task counts before it passes them on, and ids of a shard.
MODEL_IDS, HEAD_WORDS, COUNTED_WORDS, SHARD_IDS = 2048, 250_000, 800_000, 4_000_000
#: Ids that are turned into the model's at a time.
TURNED_IDS = 1 << 18
#: Times that the first shard is learned from before the others.
FIRST_EPOCHS = 3


def held_out(id_col: Column) -> Column:
    """Rows that are never learned from; those without id are among them."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 7 == 2, F.lit(True))


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, lower-cased where they are ASCII, and where each text's words start and end among them."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    each, ends = split.flatten(), split.offsets.to_numpy().astype(np.int64)
    real = pc.not_equal(pc.binary_length(each), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return each.filter(real).cast(pa.binary()), before[ends - ends[0]]


@lru_cache(maxsize=1)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(label): int(n) for label, n in map(bytes.split, lines)}
    return tiktoken.Encoding("words", pat_str=" [^ ]+", mergeable_ranks=ranks, special_tokens={}), ranks


def count_words(docs: DataFrame) -> DataFrame:
    """word (binary) and n over all documents. docs: text."""

    def summed(found: list[pa.Table]) -> pa.Table:
        out = pa.concat_tables(found).group_by("word", use_threads=False).aggregate([("n", "sum")])
        return out.rename_columns({"n_sum": "n"}).select(["word", "n"])

    def work(batches):
        found, held = [], 0
        for part in slices(batches):
            each = words(part.column("text"))[0].value_counts()
            found.append(pa.table({"word": each.field("values"), "n": each.field("counts")}))
            held += len(each)
            if held > COUNTED_WORDS:
                found = [summed(found)]
                if (held := found[0].num_rows) > COUNTED_WORDS // 2:
                    yield from found[0].to_batches()
                    found, held = [], 0
        if found:
            yield from summed(found).to_batches()

    return docs.select("text").mapInArrow(work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_of(counted: DataFrame, most: int) -> tuple[int, pa.Table]:
    """The least count from which on there are no more words than `most`, and these words with their counts."""
    step = F.floor(F.log2("n") * 8)
    sizes = sorted((r["step"], r["count"]) for r in counted.groupBy(step.alias("step")).count().collect())
    least, total = math.inf, 0
    for k, n in reversed(sizes):
        total += n
        if total > most:
            break
        least = k
    if least == math.inf:
        return 1 << 62, pa.table({"word": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
    head = counted.where(step >= int(least)).toArrow()
    return pc.min(head["n"]).as_py(), head


class Head:
    """The commonest words with the logs of their counts, and the tokenizer's ids of each, which a task finds when it first needs them."""

    def __init__(self, path: str, words: pa.Array, counts: np.ndarray):
        self.path, self.words = path, words
        self.logs = np.log10(np.append(counts, 0) + 1.0)  # the last is that of all other words
        self.begins: np.ndarray | None = None

    def begin(self) -> None:
        ranks = tokenizer(self.path)[1]
        self.begins = np.zeros(len(ranks), bool)
        self.begins[[n for label, n in ranks.items() if label[:1] == b" "]] = True
        self.ids, self.first, self.sizes = self.encoded(self.words)

    def encoded(self, some: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all these words, each after a space, where those of each start, and how many they are. Only a word's first id begins with the space."""
        text = b"".join(b" " + w for w in some.to_numpy(zero_copy_only=False)).decode()
        ids = np.array(tokenizer(self.path)[0].encode_ordinary(text), "<u2")
        first = np.flatnonzero(self.begins[ids])
        return ids, first, np.diff(first, append=len(ids))

    def look_up(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The number of each word, which is -1 for those that aren't of the head; ids; and where those of each word start and how many they are."""
        if self.begins is None:
            self.begin()
        numbers = pc.fill_null(pc.index_in(distinct, self.words), -1).to_numpy().astype(np.int64)
        other = np.flatnonzero(numbers < 0)
        ids, first, sizes = self.encoded(distinct.take(pa.array(other)))
        starts, lengths = np.append(self.first, 0)[numbers], np.append(self.sizes, 0)[numbers]
        starts[other], lengths[other] = first + len(self.ids), sizes
        return numbers, np.concatenate([self.ids, ids]), starts, lengths


READ = "doc_id long, held_out boolean, n_tokens long, n_known long, head double, tail array<struct<word:binary,n:int>>, ids binary"


def read_texts(docs: DataFrame, path: str, head: pa.Table) -> DataFrame:
    """Each row with its number of tokens, those that the head knows and their part of the base score, its other words, and the ids of its text."""
    shared = docs.sparkSession.sparkContext.broadcast(Head(path, pa.concat_arrays([pa.array([], pa.binary()), *head["word"].chunks]), head["n"].to_numpy()))

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        each, ends = words(part.column("text"))
        coded = each.dictionary_encode()
        at = coded.indices.to_numpy().astype(np.int64)
        numbers, ids, first, sizes = shared.value.look_up(coded.dictionary)
        # A slice's ids are put together at once, and cut where its texts end.
        lengths = sizes[at]
        stops = np.concatenate([[0], np.cumsum(lengths)])
        ids = ids[np.repeat(first[at] - stops[:-1], lengths) + np.arange(stops[-1])]
        cuts = pa.py_buffer((2 * stops[ends]).astype(np.int32))
        codes = pa.Array.from_buffers(pa.binary(), len(part), [None, cuts, pa.py_buffer(ids.tobytes())])
        known = numbers[at] >= 0
        logs, some = np.zeros(len(part)), np.diff(ends) > 0
        if len(at):
            logs[some] = np.add.reduceat(shared.value.logs[numbers[at]], ends[:-1][some])
        text = np.repeat(np.arange(len(part)), np.diff(ends))[~known]
        rare, times = np.unique(text << 32 | at[~known], return_counts=True)
        tail = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(rare & 0xFFFFFFFF)), pa.array(times, pa.int32())], ["word", "n"])
        parts = pa.array(np.searchsorted(rare >> 32, np.arange(len(part) + 1)), pa.int32())
        of_head = np.diff(np.concatenate([[0], np.cumsum(known)])[ends])
        columns = [part.column("doc_id"), part.column("held_out"), pa.array(np.diff(ends) + 1), pa.array(of_head), pa.array(logs), pa.ListArray.from_arrays(parts, tail), codes]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "head", "tail", "ids"])

    return map_slices(docs, work, READ)


class Vocabulary:
    """The model's ids: single bytes, the end, and the tokenizer's commonest ids; others are read as their bytes."""

    def __init__(self, path: str, counts: np.ndarray, size: int):
        ranks = tokenizer(path)[1]
        of_byte = {label[0]: n for label, n in ranks.items() if len(label) == 1}
        self.end, self.size = 256, size
        own = {of_byte[b]: b for b in range(256)}
        common = [n for n in np.argsort(-counts, kind="stable").tolist() if n not in own][: size - 257]
        own |= {n: 257 + k for k, n in enumerate(common)}
        read = [[own[n]] if n in own else list(label) for label, n in sorted(ranks.items(), key=lambda x: x[1])]
        self.sizes = np.array([len(x) for x in read], np.int32)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.flat = np.array([i for x in read for i in x], np.int32)

    def of(self, raw: bytes) -> np.ndarray:
        ids = np.frombuffer(raw, "<u2")
        sizes = self.sizes[ids]
        if len(ids) == sizes.sum():
            return self.flat[self.first[ids]]
        return self.flat[np.repeat(self.first[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]

    def of_all(self, raws: list[bytes]) -> list[np.ndarray]:
        """`of` each, many at a time."""
        out, at, sizes = [], 0, np.cumsum([0, *map(len, raws)]) // 2
        while at < len(raws):
            stop = max(at + 1, int(np.searchsorted(sizes, sizes[at] + TURNED_IDS, side="right")) - 1)
            raw = b"".join(raws[at:stop])
            turned = self.of(raw)
            ends = np.concatenate([[0], np.cumsum(self.sizes[np.frombuffer(raw, "<u2")])])[sizes[at : stop + 1] - sizes[at]].tolist()
            out += [turned[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            at = stop
        return out


def count_ids(rows: DataFrame, ids: int) -> np.ndarray:
    """How often each of the tokenizer's ids occurs in all rows."""

    def work(batches):
        total = np.zeros(ids, np.int64)
        for batch in batches:
            for raw in batch.column("ids").to_pylist():
                total += np.bincount(np.frombuffer(raw, "<u2"), minlength=ids) if len(raw) > 2 * ids else 0
                if len(raw) <= 2 * ids:
                    np.add.at(total, np.frombuffer(raw, "<u2"), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["id", "n"])

    out = np.zeros(ids, np.int64)
    found = rows.select("ids").mapInArrow(work, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out[found["id"].to_numpy()] = found["n"].to_numpy()
    return out


def count_pairs(rows: DataFrame, vocabulary) -> np.ndarray:
    """How often each of the model's ids is followed by each, ends before and after every text included; vocabulary is broadcast."""

    def work(batches):
        v = vocabulary.value
        total = np.zeros(v.size * v.size, np.int64)
        for batch in batches:
            texts = v.of_all(batch.column("ids").to_pylist())
            end = np.array([v.end], np.int32)
            run = np.concatenate([end, *(x for t in texts for x in (t, end))]).astype(np.int64)
            np.add.at(total, run[:-1] * v.size + run[1:], 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["pair", "n"])

    # At most a number for each pair of ids comes back, whatever the corpus's size.
    found = rows.select("ids").mapInArrow(work, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    size = vocabulary.value.size
    out = np.zeros(size * size)
    for batch in found.to_batches():
        out[batch.column("pair").to_numpy()] = batch.column("n").to_numpy()
    return out.reshape(size, size)


def learned(rows: DataFrame, vocabulary, counts, shards: int) -> attention.Weights:
    """Weights averaged over the shards of all rows; vocabulary and counts are broadcast."""
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "ids"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "ids")

    def from_here(frame: DataFrame, w: attention.Weights) -> attention.Weights:
        def work(shard: pd.DataFrame) -> pd.DataFrame:
            v = vocabulary.value
            texts = v.of_all(shard.sort_values(["doc_id", "ids"])["ids"].tolist())
            found, seen = attention.trained(texts, v.end, counts.value, w)
            return pd.DataFrame({"seen": [seen], "weights": [attention.flat(found).astype(float)]})

        each = frame.groupBy("shard").applyInPandas(work, "seen long, weights array<double>")
        mean = each.select("seen", F.posexplode("weights")).groupBy("pos").agg((F.sum(F.col("col") * F.col("seen")) / F.sum("seen")).alias("mean"))
        found = mean.orderBy("pos").collect()  # as many as the model has weights
        return attention.from_flat(np.array([r["mean"] for r in found])) if found else w

    first = attention.first_weights()
    for _ in range(FIRST_EPOCHS):
        first = from_here(dealt.where(F.col("shard") == 0), first)
    return from_here(dealt, first) if shards > 1 else first


def language_scores(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", model_ids: int = MODEL_IDS, head_words: int = HEAD_WORDS, shard_ids: int = SHARD_IDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Tokens are words parted by ASCII white space, and an end; a null or empty text has the end alone. score is the log10 chance of the words,
    each after one space, and the end. Rows without id are held out; repeated rows count, and are learned from, each.
    Without training rows the model knows nothing: each id has the same chance, as every token has in base_score. An
    empty table gives none. Texts may have any length: a task holds the ids of a slice of them, or of one text (some forty bytes an id).
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    texts = id_and_text(docs, id_col, text_col).withColumn("held_out", held_out(F.col("doc_id")))
    counted = written(count_words(texts.where(~F.col("held_out"))))
    least, head = head_of(counted, head_words)
    rows = written(read_texts(texts, tokenizer_path, head).withColumn("row", F.monotonically_increasing_id()))
    training = rows.where(~F.col("held_out"))

    ends = training.count()
    sums = counted.agg(F.count("*").alias("words"), F.sum("n").alias("n")).first()
    train_tokens, distinct = (sums["n"] or 0) + ends, sums["words"] + (ends > 0)
    per_token = math.log10(train_tokens + distinct + 1)

    id_counts = count_ids(training, len(tokenizer(tokenizer_path)[1]))
    vocabulary = spark.sparkContext.broadcast(Vocabulary(tokenizer_path, id_counts, model_ids))
    counts = spark.sparkContext.broadcast(attention.counts_of(count_pairs(training, vocabulary)))
    weights = learned(training, vocabulary, counts, max(1, -(-int(id_counts.sum()) // shard_ids)))

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        v = vocabulary.value
        logs = attention.log_chances(v.of_all(part.column("ids").to_pylist()), v.end, counts.value, weights)
        columns = [part.column(c) for c in ("row", "doc_id", "held_out", "n_tokens", "n_known", "head")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(logs / math.log(10))], ["row", "doc_id", "held_out", "n_tokens", "n_known", "head", "score"])

    scored = map_slices(rows.drop("tail"), work, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, head double, score double", text_col="ids")
    rare = counted.where(F.col("n") < least).withColumnRenamed("n", "count")
    tail = rows.select("row", F.inline("tail")).join(rare, "word").groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("count") + 1)).alias("log"))
    own_end = F.lit(int(ends > 0)), F.lit(math.log10(ends + 1))
    known = F.col("n_known") + F.coalesce("more", F.lit(0)) + own_end[0]
    base = F.col("head") + F.coalesce("log", F.lit(0.0)) + own_end[1] - F.col("n_tokens") * per_token
    return scored.join(tail, "row", "left").select("doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
