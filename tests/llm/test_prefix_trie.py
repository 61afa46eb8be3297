"""The trie of conversations against one that holds every prefix."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from prismatic.llm.prefix_trie import prefix_trie

KIND = "conv_id long, turn long, role string, text string, key string, depth int, path string"
FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(x, key=lambda y: y[:2])] for c, x in own.items()}
    rebuilt = {}
    for c, its in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = turns.get(c - c % 5, [])[:h] + its[h:]
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    out = set()
    for node, convs in members.items():
        under = [x for x in members if x[: len(node)] == node]
        children = {x for x in under if len(x) == len(node) + 1}
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in under) for x in under)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x)
        ends = ",".join(str(c) for c in convs if len(rebuilt[c]) == len(node))
        out.add((convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversations():
    rng = random.Random(3)
    rows = []
    for c in [*range(60), 10**12, 10**12 + 1, (1 << 63) - 1]:
        if c % 7 == 5:
            continue  # some bases are absent
        for turn in range(rng.randrange(1, 12)):
            rows.append((c, None if turn == 0 and c % 3 == 0 else turn, rng.choice(["user", "assistant", None]) if c > 30 else "user", f"{'é' * (turn % 4)}{rng.randrange(2)}" if rng.random() < 0.9 else rng.choice([None, ""]), "own", 7, None))
    for c in range(100, 160):  # one path, and one first turn, of many
        rows += [(c, t, "user", "same" if c < 130 or t < 3 else f"own {c}", None, None, "x") for t in range(5)]
    rows += [(None, 0, "user", "lost", None, None, None), (200, 1, "user", "long " * 200_000, None, None, None)]
    return rows


@pytest.mark.parametrize("group_turns", [50_000, 40, 0], ids=["one trie", "split", "always split"])
def test_as_plain(spark, group_turns):
    rows = conversations()
    found = [tuple(r) for r in prefix_trie(spark.createDataFrame(rows, KIND).repartition(5), group_turns).select(*FIELDS).collect()]
    assert len(found) == len(set(found))
    assert set(found) == plain(rows)


def test_repeated_rows_are_turns_of_their_own(spark):
    rows = [(10, 0, "user", "a"), (10, 0, "user", "a"), (10, 1, "user", "b")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {tuple(r) for r in prefix_trie(frame).select(*FIELDS).collect()} == plain(rows)


def test_empty_table(spark):
    found = prefix_trie(spark.createDataFrame([], KIND))
    assert set(found.columns) == set(FIELDS) and found.isEmpty()
