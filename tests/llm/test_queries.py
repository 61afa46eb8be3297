"""The registered queries themselves: against SQL, or against plain versions of what they return."""

import glob
import hashlib
import os
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import corpus_pipeline
from prismatic.llm import toxicity
from prismatic.llm.queries import ORACLES, QUERIES

from .plain import classes, removed_bytes


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="module")
def texts(spark, data):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}


def sha(raw):
    return hashlib.sha256(raw.encode() if isinstance(raw, str) else raw).hexdigest()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_as_sql(spark, sql, data, name):
    expected = sql.execute(ORACLES[name])
    columns = [c[0] for c in expected.description]
    found = QUERIES[name](spark, data)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(expected.fetchall())


def test_op1(spark, data, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = QUERIES["op1_bpe"](spark, data).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_op3(spark, data, texts):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    found = {r["doc_id"]: r for r in QUERIES["op3_toxicity"](spark, data).collect()}
    assert found.keys() == texts.keys()
    for k, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [k for k in labels if found[k]["held_out"]]
    assert np.mean([found[k]["predicted"] == labels[k] for k in held]) >= 0.9


def test_op4(spark, data, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    found = QUERIES["op4_token_counts"](spark, data).collect()
    assert len(found) == len(texts)
    for r in found:
        text = texts[r["doc_id"]]
        n = len(library.encode(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 4096)


def test_op5_base(spark, data, texts):
    found = QUERIES["op5_licenses"](spark, data).collect()
    assert len(found) == len(texts)
    for r in found:
        words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[r["doc_id"]]))
        places = [(k, label) for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")) for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def packed(rows, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert by_doc.keys() == texts.keys()
    for k, cut in by_doc.items():
        ids = np.array([*library.encode(texts[k], add_special_tokens=False).ids, 2], "<u4")
        cut.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in cut] == list(range(-(-len(ids) // 1024)))
        assert all(r["length"] == 1024 for r in cut[1:]) and sum(r["length"] for r in cut) == len(ids)
        for r in cut:
            assert r["start"] == sum(x["length"] for x in cut[: r["piece"]])
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for placed in by_sequence.values():
        at = 0
        for r in sorted(placed, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    return len(by_sequence), sum(r["length"] for r in rows)


def test_op8(spark, data, texts):
    n, tokens = packed(QUERIES["op8_packing"](spark, data).collect(), texts)
    assert n <= -(-tokens // 1024) + 1


def test_pipeline_stage_by_stage(spark, data, texts, tmp_path):
    """Each stage against a plain version on what its predecessor kept, and run() against the stages."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = dict(texts)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, data).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        found = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        if name == "toxicity":
            model = toxicity.learn(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet"))
            expected = {i: t for i, t in kept.items() if toxicity.scores([t], model)[0] < 0.5}
        elif name == "near duplicates":
            expected = {i: kept[i] for i, c in classes(kept).items() if i == c}
        else:  # characters that would lose some of their bytes stay whole
            expected = {i: None for i in kept}
            for i, raw in removed_bytes(kept, 100).items():
                assert re.sub("[^\\x00-\\x7F]", "", raw.decode(errors="ignore")) == re.sub("[^\\x00-\\x7F]", "", found[i])
                expected[i] = found[i]
        assert found == expected, name
        assert 0 < len(found) <= len(kept)
        kept = found
    packed(corpus_pipeline.run(spark, data).collect(), kept)
