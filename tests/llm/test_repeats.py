import random

import numpy as np
import pyarrow as pa
import pytest

from prismatic.llm import debruijn, suffix_dedup
from prismatic.llm.repeats import own_runs
from prismatic.llm.superwindows import Spans, byte_spans, runs, sliding_least, word_numbers

from .plain import empty_documents, hard_documents, removed_bytes, removed_words, thue_morse


@pytest.mark.parametrize("sizes", [{}, {"block_runs": 2}, {"most_runs": 0}], ids=["one block", "small blocks", "by windows"])
def test_bytes_as_by_hand(spark, sizes):
    rows, docs = hard_documents(spark)
    found = {r["doc_id"]: r for r in suffix_dedup.dedup(docs, **sizes).collect()}
    expected = removed_bytes({r[0]: r[1] for r in rows}, 100)
    assert {k: bytes(r["kept"]) for k, r in found.items()} == expected
    for k, text, *_ in rows:
        size = len((text or "").encode())
        assert found[k]["n_bytes"] == size
        assert sum(s["end"] - s["start"] for s in found[k]["spans"]) == size - len(expected[k])


def test_words_as_by_hand(spark):
    rows, docs = hard_documents(spark)
    found = {r["doc_id"]: r["kept"] for r in debruijn.dedup(docs).collect()}
    assert found == removed_words({r[0]: r[1] for r in rows}, 13)


def test_order_and_partitions_do_not_matter(spark):
    rows, docs = hard_documents(spark)
    a = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.dedup(docs.repartition(7)).collect()}
    assert a == removed_bytes({r[0]: r[1] for r in rows}, 100)


def test_equal_rows_and_rows_without_id(spark):
    rows, docs = hard_documents(spark)
    twice = docs.unionByName(docs).unionByName(docs.limit(6).withColumn("doc_id", docs["doc_id"] * None))
    found = suffix_dedup.dedup(twice).collect()
    expected = removed_bytes({r[0]: r[1] for r in rows}, 100)
    assert len(found) == 2 * len(rows) + 6
    assert all(bytes(r["kept"]) == expected[r["doc_id"]] for r in found if r["doc_id"] is not None)
    words = debruijn.dedup(twice).collect()
    by_hand = removed_words({r[0]: r[1] for r in rows}, 13)
    assert all(r["kept"] == by_hand[r["doc_id"]] for r in words if r["doc_id"] is not None)


def test_rows_that_repeat_an_id_are_cut_by_their_own_texts(spark):
    rng = random.Random(8)
    a, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(2))
    docs = spark.createDataFrame([(1, a), (5, a), (5, c), (7, c)], "doc_id long, text string")
    assert sorted((r["doc_id"], bytes(r["kept"]).decode()) for r in suffix_dedup.dedup(docs).collect()) == [(1, a), (5, ""), (5, c), (7, "")]
    assert sorted((r["doc_id"], r["kept"]) for r in debruijn.dedup(docs).collect()) == [(1, a), (5, ""), (5, c), (7, "")]
    assert sorted((r["doc_id"], r["text"]) for r in suffix_dedup.without_repeats(docs).collect()) == [(1, a), (5, ""), (5, c), (7, "")]


class Grams:
    """Spans whose grams have hashes as given."""

    def __init__(self, hashes):
        self.hashes = np.array(hashes, np.uint64)

    def grams(self, k, units):
        return self.hashes[: units - k + 1]

    def of(self, start, end):
        return np.zeros(len(start), np.uint64)


def test_anchors_do_not_depend_on_what_lies_around():
    """Grams that agree in all bits but the lowest, the order of which a place must not change, in slices of two sizes."""
    rng = np.random.default_rng(4)
    k, window = 24, 100
    own = (rng.integers(0, 3, 77).astype(np.uint64) << np.uint64(60)) | rng.integers(0, 1 << 22, 77).astype(np.uint64)
    alone = runs(Grams(own), window, np.array([window]), window, k)[0]
    for before in (5, 1000, 3_000_000):
        around = rng.integers(1 << 61, 1 << 63, before).astype(np.uint64)
        anchor, _, start, n = runs(Grams(np.concatenate([around, own])), before + window, np.array([before, before + window]), window, k)
        assert anchor[start == before] == alone and n[start == before] == 1


def test_a_string_in_slices_of_any_size(spark):
    rng = random.Random(5)
    string = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=100))
    long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5_000_000))
    docs = spark.createDataFrame([(1, long + string), (2, string), (3, "x " + string)], "doc_id long, text string")
    found = {r["doc_id"]: sum(s["end"] - s["start"] for s in r["spans"]) for r in suffix_dedup.dedup(docs).select("doc_id", "spans").collect()}
    assert found == {1: 0, 2: 100, 3: 100}


def test_words_whose_polynomials_are_equal_stay(spark):
    x, y = thue_morse(2048)
    lead = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"{lead} {x}"), (2, f"{lead} {y}")], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in debruijn.dedup(docs).collect()} == {1: f"{lead} {x}", 2: f"{lead} {y}"}
    rows = {1: x, 2: y}
    found = suffix_dedup.dedup(spark.createDataFrame([*rows.items()], "doc_id long, text string")).collect()
    assert {r["doc_id"]: bytes(r["kept"]) for r in found} == removed_bytes(rows, 100)


def test_span_hashes_follow_content_alone():
    rng = random.Random(4)
    text = bytes(rng.choice(b"ab") for _ in range(400))
    data = np.frombuffer(text * 2, np.uint8)
    spans = byte_spans(data)
    seen = {}
    for _ in range(3000):
        a = rng.randrange(700)
        b = min(800, a + rng.randrange(8, 120))
        if b - a >= 8:
            h = int(spans.of(np.array([a]), np.array([b]))[0])
            assert seen.setdefault(h, bytes(data[a:b])) == bytes(data[a:b])
            assert int(byte_spans(data[a:b]).of(np.array([0]), np.array([b - a]))[0]) == h
    words = b"a aa aaa aaaaaaaaa aaaaaaaaaaaaaaaaa aaaaaaaaaaaaaaaaaa a aaaaaaaaaaaaaaaaa b"
    numbers, *_ = word_numbers(np.frombuffer(words, np.uint8), np.array([len(words)]))
    assert len(set(numbers.tolist())) == 7 and numbers[0] == numbers[6] and numbers[4] == numbers[7]


def test_no_rows(spark):
    assert suffix_dedup.dedup(empty_documents(spark)).count() == 0
    assert debruijn.dedup(empty_documents(spark)).count() == 0


def test_the_pipeline_form_keeps_columns_and_whole_characters(spark):
    rows, docs = hard_documents(spark)
    found = suffix_dedup.without_repeats(docs)
    assert found.schema.names == docs.schema.names
    kept = removed_bytes({r[0]: r[1] for r in rows}, 100)
    for r in found.collect():
        assert (r["text"] is None) == (rows[r["doc_id"]][1] is None)
        if r["text"] is not None:
            assert r["n_chars"] == len(r["text"])
            assert len(kept[r["doc_id"]]) <= len(r["text"].encode()) <= len(rows[r["doc_id"]][1].encode())


def test_intervals_against_all_strings():
    rng = random.Random(3)
    for _ in range(60):
        least = rng.choice([3, 5, 8])
        texts = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randrange(least, 40))) for _ in range(8)]
        docs, starts = np.arange(8) // 2, np.array([0, 500] * 4)
        places = {}
        for t, d, s in zip(texts, docs.tolist(), starts.tolist(), strict=True):
            for k in range(len(t) - least + 1):
                places.setdefault(t[k : k + least], set()).add((d, s + k))
        expected = {p for at in places.values() for p in at if p != min(at)}
        doc, start, of, offset = suffix_dedup.repeated_windows(texts, docs, starts, least)
        assert set(zip(doc.tolist(), start.tolist(), strict=True)) == expected
        assert all(starts[k] + o == s and docs[k] == d for d, s, k, o in zip(doc, start, of, offset, strict=True))


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(0)
    numbers = rng.integers(0, 50, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    numbers[250:350] = numbers[50:150]
    anchor, _, start, n = runs(Spans(numbers, 4), 400, np.array([200, 400]), 13, 3)
    of = {int(s) + k: int(a) for a, s, c in zip(anchor, start, n, strict=True) for k in range(c)}
    assert set(of) == {*range(188), *range(200, 388)}
    assert all(of[50 + k] == of[250 + k] for k in range(88))


def test_sliding_least():
    x = np.random.default_rng(2).permutation(100)
    for w in (1, 2, 7, 64, 100):
        assert (sliding_least(x, w) == [x[k : k + w].min() for k in range(101 - w)]).all()


def test_a_run_goes_only_if_its_text_has_what_stands_at_the_source():
    text = b"x" * 50 + bytes(range(200)) + b"y" * 50
    spans, ends = byte_spans(np.frombuffer(text * 2, np.uint8)), np.array([300, 600])
    good = int(spans.of(np.array([60]), np.array([170]))[0].view(np.int64))
    digest = lambda a, b: (text * 2)[a:b]
    run = lambda start, content, seen: {"start": start, "n": 11, "content": content, "digest": seen}
    lists = [[run(60, 0, text[60:170]), run(61, 0, text[60:170]), run(250, 0, text[250:])], [run(60, good, None), run(61, good, None), run(200, good, None)]]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("content", pa.int64()), ("digest", pa.binary())]))
    offsets, start, n = own_runs(lambda: spans, ends - 300, ends, pa.array(lists, kind), 100, digest)
    assert (offsets.tolist(), start.tolist(), n.tolist()) == ([0, 1, 2], [60, 60], [11, 11])
