"""Plain versions of the corpus operators, and documents that are hard on them."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, spans string, start int"


def hard_documents(spark, more=()):
    """Nulls in every column, empty and long texts, copies, ties, and columns named as the operators' own."""
    rng = random.Random(7)
    words = ["alpha", "beta", "Gamma", "the", "of", "née", "straße", "日本", "😀", "x1", "MIT", "License", "under"]
    passage = " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(60))
    texts = [None, "", " ", "\n\n", "a", passage, passage, passage.replace("alpha", "omega"), f"Before. {passage} After.", f"{passage}\n{passage}", "é" * 300, "é" * 150 + "x" + "é" * 150]
    texts += ["ab" * 400, passage[: len(passage) // 2], "<|endoftext|> tail <|startoftext|>", "MIT license mit License, Apache-License; GNU general public LICENSE", "▁ odd ▁▁ marks  two  spaces"]
    texts += [" ".join(rng.choice(words) for _ in range(3000)), *(" ".join(rng.choice(words) + str(rng.randrange(9)) for _ in range(rng.randrange(1, 90))) for _ in range(20)), *more]
    rows = [(k, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else "s", None if k % 3 == 0 else len(t or ""), "own", None, k) for k, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def thue_morse(n):
    """Two words of a and b that have one value as polynomials modulo 2**64, whatever the base."""
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def removed_bytes(texts: dict[int, str | None], minimum: int) -> dict[int, bytes]:
    seen, out = set(), {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - minimum + 1):
            w = b[k : k + minimum]
            if w in seen:
                gone[k : k + minimum] = b"\1" * minimum
            seen.add(w)
        out[i] = bytes(c for c, g in zip(b, gone, strict=True) if not g)
    return out


def removed_words(texts: dict[int, str | None], window: int) -> dict[int, str]:
    first, out = {}, {}
    for i in sorted(texts):
        w = re.findall("[^\x20\x09-\x0d]+", texts[i] or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first.setdefault(tuple(w[k : k + window]), i) < i:
                gone[k : k + window] = [True] * window
        out[i] = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
    return out


def bag(text: str | None, n: int = 5) -> Counter:
    w = re.findall("[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in (text or "")))
    return Counter(tuple(w[k : k + n]) for k in range(max(len(w) - n + 1, 1))) if w else Counter()


def classes(texts: dict[int, str | None], similarity: float = 0.8) -> dict[int, int]:
    bags, root = {i: bag(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b:
                both, either = (bags[a] & bags[b]).total(), (bags[a] | bags[b]).total()
                if both >= similarity * either and either or not either and (texts[a] or "") == (texts[b] or ""):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    out, least = {}, defaultdict(lambda: 1 << 60)
    for i in texts:
        least[find(i)] = min(least[find(i)], i)
    for i in texts:
        out[i] = least[find(i)]
    return out
