import random
from collections import Counter

import numpy as np
import pytest

from prismatic.llm import bagminhash
from prismatic.llm.components import components
from prismatic.llm.superwindows import mixed

from .plain import classes, empty_documents, hard_documents, thue_morse


def near_copies():
    base = [f"w{k}" for k in range(200)]
    out = []
    for k in range(12):
        w = list(base)
        w[(k * 16) % 200] = f"edit{k}"
        out.append(" ".join(w))
    return [*out, " ".join(base[:150]), " ".join(base[100:] + base[:90]), "same same same same same same same", "same same same same same same"]


def test_classes_as_by_hand(spark):
    rows, docs = hard_documents(spark, near_copies())
    found = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(docs).collect()}
    assert found == classes({r[0]: r[1] for r in rows})
    assert len(set(found.values())) < len(found)


def test_one_row_of_each_class_stays(spark):
    rows, docs = hard_documents(spark, near_copies())
    kept = {r["doc_id"] for r in bagminhash.one_of_each(docs).collect()}
    by_hand = classes({r[0]: r[1] for r in rows})
    assert kept == {k for k, c in by_hand.items() if k == c}
    assert bagminhash.one_of_each(docs).schema == docs.schema


def test_texts_whose_polynomials_are_equal_are_no_copies(spark):
    x, y = thue_morse(2048)
    rows = [(1, x), (2, y), (3, f"{x} one two three four five"), (4, f"{y} one two three four five")]
    found = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 2, 3: 3, 4: 4}


def test_rows_that_repeat_an_id_are_judged_by_their_own_texts(spark):
    a, b, c = "a text of its own kind", "another text that has a copy", "a third one"
    docs = spark.createDataFrame([(2, b), (5, a), (5, b), (5, c), (5, c), (7, c)], "doc_id long, text string")
    found = sorted((r["doc_id"], r["class_id"]) for r in bagminhash.near_duplicates(docs).collect())
    assert found == [(2, 2), (5, 2), (5, 5), (5, 5), (5, 5), (7, 5)]
    assert sorted((r["doc_id"], r["text"]) for r in bagminhash.one_of_each(docs).collect()) == sorted([(2, b), (5, c), (5, c), (5, a)])


def test_a_crowd_of_loosely_alike_documents(spark):
    """Copies of one text with few to many edits, the text itself not among them, so that links are scattered."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(220)]
    texts = []
    for k in range(160):
        w = list(base)
        for place in rng.sample(range(220), 1 + k % 14):
            w[place] = f"edit{k}x{place}"
        texts.append(" ".join(w[: rng.choice([220, 220, 200, 160])]))
    rows = list(enumerate(texts))
    found = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = classes(dict(rows))
    assert found == expected
    assert 1 < len(set(expected.values())) < 150


def test_rare_elements_lose_no_pair(spark):
    """Of bags in classes of their own, all pairs that are similar enough are among those found, and few others."""
    rng = random.Random(9)
    common = [f"c{k}" for k in range(60)]
    texts = [" ".join([*common[: rng.randrange(20, 60)], *(f"d{rng.randrange(400)}" for _ in range(rng.randrange(30)))]) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bag = bagminhash.written(bagminhash.bag_columns(docs, 5))
    rows = bag.collect()
    members = bag.select("bag", bag["bag"].alias("class")).distinct()
    found = {(r["a"], r["b"]) for r in bagminhash.sharing_rare(members, bag, 0.8).collect()}
    elements = {r["bag"]: Counter(np.frombuffer(r["hashes"], "<u4").tolist()) for r in rows}
    alike = {(a, b) for a in elements for b in elements if a < b and (elements[a] & elements[b]).total() >= 0.8 * (elements[a] | elements[b]).total()}
    assert alike and alike <= found
    assert {(r["a"], r["b"]) for r in bagminhash.verified(bagminhash.sharing_rare(members, bag, 0.8), bag, 0.8).collect()} == alike
    assert len(found) < 120 * 119 / 4


def test_repeated_rows_and_no_rows(spark):
    rows, docs = hard_documents(spark)
    found = bagminhash.near_duplicates(docs.unionByName(docs)).collect()
    by_hand = classes({r[0]: r[1] for r in rows})
    assert {(r["doc_id"], r["class_id"]) for r in found} == set(by_hand.items())
    assert bagminhash.near_duplicates(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_signatures_estimate_weighted_similarity(seed):
    rng = np.random.default_rng(seed)
    n = 200
    a = rng.integers(0, 9, n)
    b = np.where(rng.random(n) < 0.4, rng.integers(0, 9, n), a)
    ids = mixed(np.arange(n, dtype=np.uint64) + np.uint64(seed)) >> np.uint64(20)
    doc = np.r_[np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)]
    s = bagminhash.signatures(doc, np.r_[ids[a > 0], ids[b > 0]], np.r_[a[a > 0], b[b > 0]], 2, 8192)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.02


def test_overlap_counts_multiplicity():
    a, b = np.array([1, 1, 1, 2, 5], "<u4"), np.array([1, 1, 2, 2, 9], "<u4")
    x, y = np.concatenate([a, a, a[:0]]), np.concatenate([b, b[:0], b])
    assert bagminhash.overlaps(x, np.array([0, 5, 10, 10]), y, np.array([0, 5, 5, 10])).tolist() == [3, 0, 0]
    assert bagminhash.overlaps(a[:0], np.array([0]), b[:0], np.array([0])).tolist() == []


def test_copies_alike_to_their_original_only(spark):
    """Three edits part each copy from the original by little, and any two copies by too much."""
    base = [f"w{k}" for k in range(200)]
    texts = []
    for k in range(60):
        w = list(base)
        for place in (k % 60, 60 + (7 * k) % 60, 120 + (11 * k) % 60):
            w[place + 5] = f"edit{k}"
        texts.append(" ".join(w))
    rows = [*enumerate([*texts, " ".join(base)])]
    found = {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == classes(dict(rows))
    assert set(found.values()) == {0}


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[k] for k in range(41)} == {0} and {found[k] for k in range(100, 160)} == {100}
