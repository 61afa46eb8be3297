import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismatic.llm import licenses, media, topk, toxicity
from prismatic.llm.queries import op6_media, op7_topk

from .plain import empty_documents, hard_documents

TEXTS = ["mit license mit license", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "All rights reserved.", "MITx license", "summit license"]


def base_scan(text):
    low = "".join(c.lower() if c < "\x80" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    hits = [(k, label) for phrase, label in licenses.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    return len(words), hits


def test_base_columns_as_by_hand(spark):
    rows, docs = hard_documents(spark, TEXTS)
    for r in licenses.scan(docs).collect():
        n, hits = base_scan(rows[r["doc_id"]][1])
        assert (r["n_words"], r["n_base"]) == (n, len(hits))
        assert (r["first_word"], r["last_word"]) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in hits}))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
        assert 0 <= r["score"] <= 1


def by_hand(text):
    low = re.sub("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", f" {text} ".lower())
    if not any(g in low for g in licenses.FIRST_GATE):
        return set()
    found = [(m.start(), m.end(), p, label) for p, label, keyword, e in licenses.RULES if keyword in low for m in re.finditer(e, low)]
    over = lambda d, e: e[0] <= d[0] and e[1] >= d[1] and (e[2] > d[2] or e[2] == d[2] and (e[1] - e[0] > d[1] - d[0] or e[:2] == d[:2] and e[3] < d[3]))
    return {d[3] for d in found if not any(over(d, e) for e in found)}


def test_labels_as_by_hand(spark):
    assert len(licenses.RULES) > 200
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in licenses.scan(docs).collect():
        assert set(filter(None, r["labels"].split(","))) == by_hand(TEXTS[r["doc_id"]]) | {label for _, label in base_scan(TEXTS[r["doc_id"]])[1]}
    assert {"cc-by-nc-4.0"} == by_hand(TEXTS[3]) and "gpl-3.0" in by_hand(TEXTS[2])


def samples(pattern):
    """Every text of a rule's expression, of character classes the first member."""
    parts = [""]
    for op, av in pattern:
        op = str(op)
        if op == "LITERAL":
            more = [chr(av)]
        elif op == "IN":
            more = [chr(x if str(k) == "LITERAL" else x[0]) for k, x in av][:1] if str(av[0][0]) == "RANGE" else [chr(x) for _, x in av]
        elif op == "BRANCH":
            more = [x for branch in av[1] for x in samples(branch)]
        elif op == "SUBPATTERN":
            more = samples(av[3])
        elif op == "MAX_REPEAT":
            low, high, inner = av
            more = [x * high for x in samples(inner)] + ([] if low else [""])
        else:
            assert op == "ASSERT" or op == "ASSERT_NOT"
            more = [""]
        parts = [a + b for a in parts for b in more]
    return parts


def ungated(low):
    found = [(m.start(), m.end(), p, label) for p, label, _, e in licenses.RULES for m in re.finditer(e, low)]
    over = lambda d, e: e[0] <= d[0] and e[1] >= d[1] and (e[2] > d[2] or e[2] == d[2] and (e[1] - e[0] > d[1] - d[0] or e[:2] == d[:2] and e[3] < d[3]))
    return {d[3] for d in found if not any(over(d, e) for e in found)}, max((d[2] for d in found), default=0) / 100


def test_every_match_passes_its_gates():
    for _, _, keyword, expression in licenses.RULES:
        found = samples(re._parser.parse(expression))
        assert found
        for x in found:
            low = f" {x} "
            assert re.search(expression, low) and keyword in low and any(g in low for g in licenses.FIRST_GATE), (keyword, expression, x)


def test_gated_labels_are_ungated_labels(spark):
    texts = ["Distributed under GPL v3", "released under the Apache 2.0", "available under CC BY 4.0", "Expat license", "GNU Library General Public License", "Licensed under the GPL", "Released under the GNU LGPL.", "AGPL licence", "under the MPL 2.0 license", "is provided under EPL"]
    texts += [f"x {samples(re._parser.parse(e))[-1]} y" for _, _, _, e in licenses.RULES]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    for k, t in enumerate(texts):
        labels, score = ungated(f" {t.lower().replace('.', ' ')} ")
        base = {label for _, label in base_scan(t)[1]}
        assert set(filter(None, found[k]["labels"].split(","))) == labels | base and labels, t
        assert found[k]["score"] == max(score, 0.6 if base else 0.0)
    expected = ["gpl-3.0", "apache-2.0", "cc-by-4.0", "mit", "lgpl", "gpl", "lgpl", "agpl", "mpl-2.0", "epl"]
    assert [label in found[k]["labels"].split(",") for k, label in enumerate(expected)] == [True] * len(expected)


def test_suppression_as_by_comparing_all(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(40):
        starts = rng.integers(0, 30, int(rng.integers(0, 40)))
        rows.append([[(int(a), int(a + rng.integers(1, 12)), int(rng.choice([40, 60, 90])), str(rng.choice(["x", "y", "z"]))) for a in starts]])
    frame = spark.createDataFrame(rows, "found array<struct<start:int,end:int,priority:int,label:string>>")
    over = lambda d, e: e[0] <= d[0] and e[1] >= d[1] and (e[2] > d[2] or e[2] == d[2] and (e[1] - e[0] > d[1] - d[0] or e[:2] == d[:2] and e[3] < d[3]))
    for r in frame.select("found", licenses._kept(F.col("found")).alias("kept")).collect():
        found = [tuple(d) for d in r["found"]]
        assert sorted(map(tuple, r["kept"])) == sorted(d for d in found if not any(over(d, e) for e in found))


def test_very_many_detections_in_one_text(spark):
    docs = spark.createDataFrame([(1, "Licensed under the MIT license. " * 3000)], "doc_id long, text string")
    r = licenses.scan(docs).first()
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["labels"], len(r["detections"])) == (15000, 3000, 3, 14998, "mit", 3000)


def test_no_rows(spark):
    assert licenses.scan(empty_documents(spark)).count() == 0
    assert media.store_and_fingerprint(empty_documents(spark)).count() == 0
    model = toxicity.learn(empty_documents(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(empty_documents(spark), model).count() == 0
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 2 == 0).count() == 0


def test_media_round_trip(spark):
    rows, docs = hard_documents(spark)
    for r in media.store_and_fingerprint(docs).collect():
        text = (rows[r["doc_id"]][1] or "").encode()
        payload = text + bytes(-len(text) % 64 if text else 64)
        assert bytes(r["payload"]) == payload == media.from_wav(bytes(r["media"]))
        assert r["n_bytes"] == len(text) and len(r["times"]) == len(r["codes"])
        alone = media.fingerprints([payload])
        assert r["times"] == alone[1].tolist() and r["codes"] == alone[2].tolist()


def test_media_query_digests(spark, data):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    for r in op6_media(spark, data).collect():
        text = (docs[r["doc_id"]] or "").encode()
        payload = text + bytes(-len(text) % 64 if text else 64)
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_sha256"] == hashlib.sha256(media.to_wav(payload)).hexdigest()


def test_fingerprints_of_two_tones():
    t = np.arange(6400)
    tone = np.where(t < 3200, np.sin(2 * np.pi * t * 10 / 128), np.sin(2 * np.pi * t * 20 / 128)) * (50 + 40 * np.sin(t / 300))
    _, _, codes = media.fingerprints([(128 + tone).astype(np.uint8).tobytes()])
    assert len(codes)


def test_nearest_as_by_hand(spark, data):
    vectors = {r["vec_id"]: np.floor(64 * np.array(r["embedding"], np.float64)).astype(int) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    found = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in op7_topk(spark, data).collect()]
    expected = []
    for q in (k for k in vectors if k % 20 == 0):
        best = sorted((-int(vectors[q] @ v), k) for k, v in vectors.items() if k != q)[:20]
        expected += [(q, n + 1, k, -s) for n, (s, k) in enumerate(best)]
    assert sorted(found) == sorted(expected)


def test_search_with_ties_nulls_and_few_rows(spark):
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]), (7, [0.5]), (8, []), (None, [1.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("own"))
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(docs, F.col("vec_id") % 4 == 0, k=3).collect())
    assert found[:3] == [(0, 1, 1, 64 * 64 + 32 * 32), (0, 2, 2, 64 * 64 + 32 * 32), (0, 3, 7, 64 * 32)]
    assert [f[2:] for f in found[3:]] == [(0, 0), (1, 0), (2, 0)]


def test_blocks_do_not_matter(spark, data, monkeypatch):
    whole = {tuple(r) for r in op7_topk(spark, data).collect()}
    monkeypatch.setattr(topk, "ROWS", 60)
    monkeypatch.setattr(topk, "QUERIES", 10)
    assert {tuple(r) for r in op7_topk(spark, data).collect()} == whole


def test_folding():
    assert toxicity.fold("1d10t!") == " idiot  "
    assert toxicity.fold("mоrоn sc​um a$$hole") == " moron scum asshole "


@pytest.fixture(scope="module")
def learned(spark):
    rng = np.random.default_rng(0)
    words = np.array([f"{a}{b}" for a in ("lor", "mi", "sta", "ve", "quo") for b in ("na", "ti", "ker", "dos", "pla", "men")])
    rows = []
    for k in range(1500):
        text = list(rng.choice(words, int(rng.integers(5, 200))))
        bad = k % 6 == 0
        if bad:
            for _ in range(1 + len(text) // 50):
                text.insert(int(rng.integers(0, len(text))), str(rng.choice(["grumfed", "zartwick", "1d1ot"])))
        rows.append((k, " ".join(text), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return docs, toxicity.learn(docs.drop("toxic"), docs.select("doc_id", "toxic"))


def test_held_out_accuracy(spark, learned):
    docs, model = learned
    found = toxicity.score(docs.drop("toxic"), model).join(docs.select("doc_id", "toxic"), "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert len(found) > 200 and all((r["score"] >= 0.5) == (r["toxic"] == 1) for r in found)


def test_the_model_does_not_depend_on_partitions_or_repeated_rows(spark, learned):
    docs, model = learned
    labels = docs.select("doc_id", "toxic")
    for dealt in (docs.drop("toxic").coalesce(1), docs.drop("toxic").repartition(13), docs.drop("toxic").unionByName(docs.drop("toxic"))):
        assert toxicity.learn(dealt, labels) == model


def test_many_exceptions_in_one_text():
    found = toxicity.matcher(toxicity.Model(((" idiot ", 5.0),), (0, 0, 0))).evidence("idiot proof " * 50_000 + "idiot")
    assert found == (5.0, 100_001)


def test_held_out_labels_are_not_read(spark, learned):
    docs, model = learned
    labels = docs.select("doc_id", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic"))
    assert toxicity.learn(docs.drop("toxic"), labels) == model


def test_hard_texts_and_exceptions(spark):
    rows, docs = hard_documents(spark, ["you idiot", "this is idiot proof", "nice words only"])
    model = toxicity.learn(docs, spark.createDataFrame([(1, None), (None, 1), (9999, 1)], "doc_id long, toxic int"))
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    n = len(rows)
    assert len(found) == n and found[n - 3] > 0.5 > found[n - 2] == found[n - 1] == found[0] == found[1]
    assert {r["doc_id"] for r in toxicity.without_toxic(docs, model).collect()} == set(range(n)) - {n - 3}
