"""Base scores against a count of all words, the model against its own definition, a position at a time."""

import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from prismatic.llm import attention
from prismatic.llm.language_model import Head, Vocabulary, language_scores, tokenizer, words
from prismatic.llm.queries import QUERIES

from .plain import empty_documents, hard_documents

TOKENIZER = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def base_scores(texts):
    counts = Counter()
    tokens = {k: [*(t or "").encode().lower().split(), None] for k, (_, t) in enumerate(texts)}
    out = [i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts]
    for k, its in tokens.items():
        if not out[k]:
            counts.update(its)
    n, v = sum(counts.values()), len(counts)
    return [(texts[k][0], out[k], len(its), sum(counts[w] > 0 for w in its), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in its)) for k, its in tokens.items()]


@pytest.mark.parametrize("head_words", [250_000, 5, 0], ids=["all words to all tasks", "few", "none"])
def test_base_scores(spark, head_words):
    rows, docs = hard_documents(spark, more=["Long " * 300_000 + "END", "a\x0bb\x0cc\td\re\nf", " a b"])
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("doc_id", docs["doc_id"] * None))
    found = language_scores(docs.repartition(5), TOKENIZER, head_words=head_words).collect()
    texts = [(r[0], r[1]) for r in rows]
    expected = base_scores(texts + texts[:3] + [(None, t) for _, t in texts[:2]])
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert [tuple(r)[:5] for r in sorted(found, key=key)] == [e[:5] for e in sorted(expected, key=key)]
    for r, e in zip(sorted(found, key=key), sorted(expected, key=key), strict=True):
        assert r["base_score"] == pytest.approx(e[5], rel=1e-9) and -math.inf < r["score"] < 0


def test_nothing_to_learn_from(spark):
    assert language_scores(empty_documents(spark), TOKENIZER).isEmpty()
    (row,) = language_scores(spark.createDataFrame([(None, "Some words")], "doc_id long, text string"), TOKENIZER).collect()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0)
    assert row["score"] < 0


def some_counts(size=40):
    rng = np.random.default_rng(0)
    pairs = rng.poisson(1.0, (size, size)).astype(float)
    pairs[3] = 0
    return attention.counts_of(pairs), size


def test_chances_of_what_follows_add_up_to_one():
    counts, size = some_counts()
    w = {k: v + np.float32(0.1) for k, v in attention.first_weights().items()}
    for before in ([], [1, 2, 3], list(range(20))):
        one = [attention.log_chances([np.array([*before, k])], 0, counts, w)[0] for k in range(1, size)]
        # Taking the end away leaves the chance of the last id; an end in its place ends the text.
        ends = attention.log_chances([np.array(before, np.int64)], 0, counts, w)[0]
        longer = [position_by_position([*before, k], counts, w) for k in range(1, size)]
        assert np.allclose(one, [sum(x) for x in longer], atol=1e-3)
        so_far = sum(longer[0][: len(before)])
        assert math.isclose(math.fsum(math.exp(x[len(before)]) for x in longer) + math.exp(ends - so_far), 1.0, abs_tol=1e-4)


def position_by_position(ids, counts, w, end=0):
    """Natural logs of the chances of each id and the end, with sums written out."""
    out, block = [], attention.BLOCK
    inputs = [end, *ids]
    for p, target in enumerate([*ids, end]):
        first = p // block * block - block
        seen = [inputs[q] if q >= 0 else end for q in range(first, p + 1)]
        keys, own = counts.embedding[seen].astype(float), counts.embedding[inputs[p]].astype(float)
        back = np.arange(p - first, -1, -1)
        look = np.exp(np.minimum(keys @ (own @ w["look"]), 60) + w["near"][back])
        gathered = (look / look.sum()) @ keys
        hidden = np.maximum(own @ w["own"] + gathered @ w["seen"] + w["bias"], 0)
        scores = hidden @ w["out"] + counts.class_after[inputs[p]]
        out.append(scores[counts.class_of[target]] - math.log(np.exp(scores).sum()) + counts.id_after[inputs[p], target])
    return out


def test_each_text_is_scored_by_itself():
    counts, size = some_counts()
    rng = np.random.default_rng(1)
    texts = [rng.integers(1, size, n) for n in (0, 1, 7, 8, 9, 16, 100, 3)]
    w = {k: v + np.float32(0.1) for k, v in attention.first_weights().items()}
    together = attention.log_chances(texts, 0, counts, w, step_blocks=3)
    assert np.allclose(together, [sum(position_by_position(t.tolist(), counts, w)) for t in texts], rtol=1e-4)


def test_gradient_is_that_of_the_loss():
    counts, size = some_counts()
    rng = np.random.default_rng(2)
    read = attention.stream([rng.integers(1, size, n) for n in (30, 5, 17)], 0)
    ids, follows = read.windows(slice(None))
    w = {k: v + 0.2 * rng.standard_normal(v.shape) for k, v in attention.first_weights().items()}
    found = attention.gradient(ids, follows, counts, w)
    real = follows.ravel() >= 0

    def loss(weights):
        return -attention.forward(ids, follows, counts, weights)[0][real].astype(float).mean()

    for name, g in found.items():
        way = rng.standard_normal(g.shape)
        step = 1e-6
        up, down = (loss(w | {name: w[name] + sign * step * way}) for sign in (1, -1))
        assert (up - down) / (2 * step) == pytest.approx(float((g * way).sum()), rel=1e-3, abs=1e-5), name


def test_keys_are_turned_once_a_step():
    counts, size = some_counts()
    ids, follows = attention.stream([np.random.default_rng(4).integers(1, size, 40)], 0).windows(slice(None))
    *_, keys, turned = attention.forward(ids, follows, counts, attention.first_weights())
    assert turned.flags.c_contiguous and np.array_equal(turned, keys.transpose(0, 2, 1))


def test_vocabulary_keeps_every_text():
    tool, ranks = tokenizer(TOKENIZER)
    counts = np.zeros(len(ranks), np.int64)
    words = " the straße 日本 😀 of of of"
    counts[tool.encode_ordinary(words)[:2]] = 5
    v = Vocabulary(TOKENIZER, counts, 300)
    label = {n: bytes([n]) for n in range(256)}
    labels = {n: x for x, n in ranks.items()}
    common = [n for n in np.argsort(-counts, kind="stable") if len(labels[n]) > 1]
    label |= {257 + k: labels[n] for k, n in enumerate(common[:43])}
    raw = np.array(tool.encode_ordinary(words), "<u2").tobytes()
    assert b"".join(label[i] for i in v.of(raw).tolist()) == words.encode() and v.of(b"").size == 0


def test_the_query(spark, data):
    """All counts and base scores of the registered query, and a loss on documents that aren't learned from that chance wouldn't give."""
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    found = {r["doc_id"]: r for r in QUERIES["op13_language_model"](spark, data).collect()}
    for e in base_scores(texts):
        r = found[e[0]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == e[1:5] and r["base_score"] == pytest.approx(e[5], rel=1e-9)
    out = [i for i, r in found.items() if r["held_out"]]
    words = {i: (t or "").encode().lower().decode().split() for i, t in texts}
    ids = sum(len(tokenizer(TOKENIZER)[0].encode_ordinary(" " + " ".join(words[i]))) + 1 for i in out)
    assert -sum(found[i]["score"] for i in out) / ids / math.log10(2) < 6.6


def test_counts_hold_few_arrays_at_a_time():
    """The driver works these out for 2,048 ids, where an array of all pairs has 32 MB."""
    pairs = np.random.default_rng(0).poisson(1.0, (1024, 1024)).astype(float)
    tracemalloc.start()
    attention.counts_of(pairs)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2.5 * pairs.nbytes


def test_driver_collects_columns(spark, monkeypatch):
    """Counts of words, ids and pairs come to the driver as columns; rows are collected only for a few numbers."""
    collected, collect = [], type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda frame: collected.append(collect(frame)) or collected[-1])
    docs = spark.createDataFrame([(k, " ".join(f"w{n}" for n in range(k, k + 4000))) for k in range(3)], "doc_id long, text string")
    language_scores(docs, TOKENIZER)
    assert collected and all(len(rows) <= attention.flat(attention.first_weights()).size for rows in collected)


def test_words_are_parted_by_ascii_white_space_only():
    texts = ["\x0b a\x0cB\x1c\x1d\x1e\x1fc\x85d e f É İ \t\r\n x", "", "   ", " a", "a ", "\x00 \x00"]
    found, ends = words(pa.array(["cut off", *texts]).slice(1))
    assert [found[a:b].to_pylist() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)] == [t.encode().lower().split() for t in texts]


def test_a_word_is_encoded_once():
    """In a slice each other word is encoded once, the head's words once in a task."""
    head, tool = Head(TOKENIZER, pa.array([b"the", "straße".encode()]), np.array([5, 3])), tokenizer(TOKENIZER)[0]
    asked, encoded = [], head.encoded
    head.encoded = lambda some: asked.append(some.to_pylist()) or encoded(some)
    for distinct in ([b"the", "日本".encode(), b"xyzzyx"], [b"xyzzyx", b"the"], []):
        numbers, ids, first, sizes = head.look_up(pa.array(distinct, pa.binary()))
        assert [ids[a : a + n].tolist() for a, n in zip(first, sizes, strict=True)] == [tool.encode_ordinary(" " + w.decode()) for w in distinct]
        assert numbers.tolist() == [0 if w == b"the" else -1 for w in distinct]
    assert asked == [[b"the", "straße".encode()], ["日本".encode(), b"xyzzyx"], [b"xyzzyx"], []]
