import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from prismatic.llm import bpe, packing, token_counts

from .plain import empty_documents, hard_documents

WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


def test_encoding_and_decoding_as_the_library(spark, library):
    rows, docs = hard_documents(spark)
    found = {r["doc_id"]: r for r in bpe.encode_decode(docs, WORD).collect()}
    assert len(found) == len(rows)
    for k, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert found[k]["ids"] == ids
        assert found[k]["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_no_rows(spark):
    for frame in (bpe.encode_decode(empty_documents(spark), WORD), token_counts.count_tokens(empty_documents(spark), PIECE), packing.pack_documents(empty_documents(spark), BYTE)):
        assert frame.count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
@example(":\U0003d000")  # a letter for some Unicode tables only
@example("<\0|x<|endoftext|>Y")
def test_any_text_encodes_as_in_the_library(text):
    library = Tokenizer.from_file(WORD) if not hasattr(test_any_text_encodes_as_in_the_library, "tool") else test_any_text_encodes_as_in_the_library.tool
    test_any_text_encodes_as_in_the_library.tool = library
    ids = np.frombuffer(bpe.encoder(WORD).encode([text])[0][0], "<i4").tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids


def test_every_letter_beside_others(library):
    texts = [t for c in map(chr, [*range(1, 0x250), *range(0x250, 0x3100, 7), 0x1E9E, 0x2126, 0x212A, 0xFB01]) for t in (f"b{c}1", f"{c}b", f"'{c}", f"'s{c} {c}")]
    for text, ids in zip(texts, bpe.encoder(WORD).encode(texts)[0], strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_long_words(library):
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshr") for _ in range(n)) for n in (255, 256, 257, 3000, 20_000)] + ["ab" * 2000, "é" * 900, "x" * 5000]
    tool = bpe.automaton(WORD)
    for word in words:
        ids = np.frombuffer(bpe.encoder(WORD).encode([word])[0][0], "<i4").tolist()
        assert ids == library.encode(word, add_special_tokens=False).ids
    rows = [w.encode() for w in words[:3]]
    assert [tool._walk_long(w) for w in rows] == [tool._walk(np.frombuffer(w, np.uint8).astype(np.int64)[None], np.array([len(w)]))[0].tolist() for w in rows]


def merged_in_order(word, merges):
    parts = list(word)
    for u, v in merges:
        out = []
        for p in parts:
            if out and out[-1] == u and p == v:
                out[-1] = u + v
            else:
                out.append(p)
        parts = out
    return parts


def test_the_explicit_automaton_accepts_what_the_merges_give():
    rng = random.Random(3)
    for _ in range(40):
        tokens, merges = ["a", "b", "c"], []
        for _ in range(6):
            u, v = rng.choice(tokens), rng.choice(tokens)
            if u + v not in tokens:
                tokens.append(u + v)
                merges.append((u, v))
        start, states = bpe.explicit_automaton(["a", "b", "c"], merges)
        for _ in range(30):
            word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 8)))
            accepted = []

            def walk(state, at, path, word=word, accepted=accepted, states=states):
                if at == len(word):
                    accepted.append(path)
                for token, to in states[state].items():
                    if word.startswith(token, at):
                        walk(to, at + len(token), [*path, token])

            walk(start, 0, [])
            assert merged_in_order(word, merges) in accepted


def test_transitions_agree_with_merging():
    """A pair of tokens has an arc just if encoding their joined text gives this pair back."""
    tool, rng = bpe.automaton(WORD), random.Random(5)
    inside = [n for n, label in enumerate(tool.label) if label and not label.endswith("</w>") and label.isascii() and label.isalpha()]
    pairs = [(rng.choice(inside), rng.choice(inside)) for _ in range(400)]
    arcs = tool.arcs(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    merges = {}
    for n in range(tool.size):
        if tool.rank[n] >= 0:
            merges[int(tool.left[n]), int(tool.right[n])] = (int(tool.rank[n]), n)
    base = {label: n for n, label in enumerate(tool.label) if tool.rank[n] < 0}
    for (a, b), arc in zip(pairs, arcs, strict=True):
        parts = [base[c] for c in tool.label[a] + tool.label[b]]
        while True:
            ranked = [(merges[p][0], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in merges]
            if not ranked:
                break
            _, i = min(ranked)
            parts[i : i + 2] = [merges[parts[i], parts[i + 1]][1]]
        assert arc == (parts == [a, b])


def test_counts_as_the_library(spark):
    rows, docs = hard_documents(spark)
    found = {r["doc_id"]: r for r in token_counts.count_tokens(docs, PIECE).collect()}
    library = token_counts.Counts(PIECE).library
    for k, text, *_ in rows:
        assert found[k]["n_tokens"] == len(library.encode(text or ""))
        assert found[k]["n_bytes"] == len((text or "").encode())


def test_pieces_and_sequences(spark):
    rows, docs = hard_documents(spark)
    library = Tokenizer.from_file(BYTE)
    found = [r.asDict() for r in packing.pack_documents(docs, BYTE, size=64).collect()]
    pieces, places = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, text, *_ in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        cut = sorted(pieces[k], key=lambda r: r["piece"])
        assert sum(r["length"] for r in cut) == len(ids)
        assert [r["start"] for r in cut] == np.cumsum([0, *(r["length"] for r in cut)])[:-1].tolist()
        assert all(r["length"] == 64 for r in cut[1:]) and (len(cut) == 1 or len(ids) > 64)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in cut)
    for inside in places.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= 64


def test_packing_is_tight():
    lengths = np.sort(np.random.default_rng(1).integers(1, 1025, 6000))[::-1]
    sequence, _ = packing.place(lengths, 1024)
    assert sequence.max() + 1 <= 1.01 * -(-lengths.sum() // 1024)
