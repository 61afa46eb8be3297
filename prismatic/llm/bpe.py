"""BPE encoding and decoding with a tokenization automaton.

A merge list compiles into a deterministic automaton over tokens. It starts as one state with a
loop for each base symbol. The gadget of a merge u v -> uv goes to every path p -u-> q -v-> r that
the automaton still has: it adds an arc p -uv-> r and takes the arc v away from the state that u
leads to. After the last merge the automaton accepts one token sequence for each word: the one that
applying the merges in order would give.

What a gadget takes away is a product of two sets: tokens that still end in u when the merge comes,
and tokens that still begin with v then. States that lost the same arcs are one state, and a token's
state follows from the chain of its right parts (its left context from the chain of left parts). The
compiled tables hold these chains and the gadgets; a transition (token, token) is worked out from
them on first use and kept in a transition table of fixed size, since the full table has 49,408
squared cells. `explicit_automaton` builds the automaton literally, gadget by gadget; tests hold the
tables against it.

Encoding walks a word's lattice of vocabulary entries from left to right. For each prefix exactly one
last token is reachable; so one step per position is enough, and words of equal length step together.
Decoding emits the arc labels, joined as a tokenizer without a decoder joins them.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, map_slices

END = "</w>"
NONE = np.int64(-1)
#: Words that a task remembers, and slots of its transition table.
MEMORY_WORDS, TRANSITION_SLOTS = 250_000, 1 << 20
#: Bytes from which on a word is walked by itself, a letter at a time.
LONG_WORD = 256


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return [letters[b] for b in range(256)]


class Table:
    """A fixed map from non-negative 64-bit keys to values, looked up by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.keys, self.values = np.full(1 << self.bits, NONE), np.full(1 << self.bits, NONE)
        left = np.arange(len(keys))
        slot = self.slot(keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.keys[slot[left]] == NONE
            at, first = np.unique(slot[left[free]], return_index=True)
            put = left[free][first]
            self.keys[at], self.values[at] = keys[put], values[put]
            done = np.zeros(len(keys), bool)
            done[put] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where a key is not there."""
        slot = self.slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        left = np.flatnonzero((found != keys) & (found != NONE))
        for _ in range(self.probes):
            if not len(left):
                break
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found != NONE)]
        return out


class MergeAutomaton:
    """Tables of a vocabulary whose words end in `</w>`, compiled from its merges in their order."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.label = [""] * size
        for label, n in [*vocab.items(), *self.special.items()]:
            self.label[n] = label
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        # The chains: what a token came from, and when; base symbols come from themselves, at -1.
        self.left, self.right, self.rank = np.arange(size), np.arange(size), np.full(size, -1)
        gadget_keys, gadget_tokens = [], []
        for rank, (u, v) in enumerate(merges):
            whole = vocab[u + v]
            self.left[whole], self.right[whole], self.rank[whole] = vocab[u], vocab[v], rank
            gadget_keys.append(vocab[u] * size + vocab[v])
            gadget_tokens.append(rank)
        self.size = size
        self.gadgets = Table(np.array(gadget_keys, np.int64), np.array(gadget_tokens, np.int64))
        # A tree of the entries' bytes; an entry inside a word and one at its end may share a node.
        step: dict[int, int] = {}
        inside, at_end = [-1], [-1]
        for label, n in vocab.items():
            ends = label.endswith(END) and len(label) > len(END)
            node = 0
            for c in label[: -len(END)] if ends else label:
                key = node * 256 + byte_of[c]
                if key not in step:
                    step[key] = len(inside)
                    inside.append(-1)
                    at_end.append(-1)
                node = step[key]
            (at_end if ends else inside)[node] = n
        self.inside, self.at_end = np.array(inside), np.array(at_end)
        self.step = Table(np.fromiter(step.keys(), np.int64, len(step)), np.fromiter(step.values(), np.int64, len(step)))
        self.steps = step
        self.transitions = np.full(TRANSITION_SLOTS, NONE)
        self.arc_of: dict[int, bool] = {}

    def allowed(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether the state after `first` still has an arc `second`."""
        key = first * self.size + second
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64) & (TRANSITION_SLOTS - 1)
        kept = self.transitions[slot]
        known = (kept >> 1) == key
        out = known & ((kept & 1) == 1)
        if len(new := np.flatnonzero(~known)):
            new_key, back = np.unique(key[new], return_inverse=True)
            found = self.arcs(new_key // self.size, new_key % self.size)
            out[new] = found[back]
            self.transitions[slot[new]] = key[new] * 2 + out[new]
        return out

    def arcs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Undo the latest merge on either side of the border until a gadget took this arc away, or nothing is left to undo."""
        out = np.ones(len(first), bool)
        limit = np.full(len(first), np.iinfo(np.int64).max)
        live, a, b = np.arange(len(first)), first.copy(), second.copy()
        while len(live):
            rank = self.gadgets.get(a * self.size + b)
            gone = (rank >= 0) & (rank < limit)
            out[live[gone]] = False
            ra, rb = self.rank[a], self.rank[b]
            on = ~gone & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb, limit = live[on], a[on], b[on], ra[on], rb[on], limit[on]
            from_a = ra > rb  # of two equal merges the left one came first, so the right one is undone first
            limit = np.where(from_a, ra, rb + 1)
            a, b = np.where(from_a, self.right[a], a), np.where(from_a, b, self.left[b])
        return out

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, 32-bit and little-endian."""
        out = [b""] * len(words)
        lengths = np.array([len(w) for w in words], np.int64)
        order = np.argsort(lengths, kind="stable")
        order = order[lengths[order] > 0]
        for i in order[lengths[order] >= LONG_WORD].tolist():
            out[i] = np.array(self._walk_long(words[i]), "<i4").tobytes()
        order = order[lengths[order] < LONG_WORD]
        first = 0
        while first < len(order):  # words of like length go together
            least = int(lengths[order[first]])
            last = int(np.searchsorted(lengths[order], least + max(3, least // 2), side="right"))
            longest = int(lengths[order[last - 1]])
            last = min(last, first + max(1, 4_000_000 // longest**2))
            part = order[first:last]
            text = np.zeros((len(part), longest), np.int64)
            flat = np.frombuffer(b"".join(words[i] for i in part), np.uint8)
            text[np.arange(longest) < lengths[part, None]] = flat
            ids, ends = self._walk(text, lengths[part])
            ids, at = ids.tobytes(), [0, *(4 * ends).tolist()]
            for k, i in enumerate(part.tolist()):
                out[i] = ids[at[k] : at[k + 1]]
            first = last
        return out

    def _arc(self, first: int, second: int) -> bool:
        key = first * self.size + second
        if (found := self.arc_of.get(key)) is None:
            if len(self.arc_of) >= TRANSITION_SLOTS:
                self.arc_of.clear()
            found = self.arc_of[key] = bool(self.arcs(np.array([first]), np.array([second]))[0])
        return found

    def _walk_long(self, word: bytes) -> list[int]:
        """The ids of one word: its lattice again, with as many steps as it has letters, times the length of the longest entry at most."""
        steps, inside, at_end, size = self.steps, self.inside.tolist(), self.at_end.tolist(), len(word)
        last, came, going = [-1] * (size + 1), [0] * (size + 1), []
        for j, byte in enumerate(word, 1):
            going.append((j - 1, 0))
            still, free = [], True
            ids = at_end if j == size else inside
            for i, node in going:
                node = steps.get(node * 256 + byte)
                if node is None:
                    continue
                still.append((i, node))
                if free and ids[node] >= 0 and (not i or self._arc(last[i], ids[node])):
                    last[j], came[j], free = ids[node], i, False
            going = still
        found, at = [], size
        while at:
            found.append(last[at])
            at = came[at]
        return found[::-1]

    def _walk(self, text: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A word a row, shortest first. The last token of each prefix, then the way back along the lattice. All ids, and where each row's end."""
        n, size = text.shape
        last, came = np.full((n, size + 1), NONE), np.zeros((n, size + 1), np.int64)
        rows = np.arange(n)
        starts: list[tuple[int, np.ndarray, np.ndarray]] = []  # start, rows, nodes: the lattice's open arcs, longest first
        for j in range(1, size + 1):
            open_from = int(np.searchsorted(lengths, j))  # the first row with a letter j
            starts.append((j - 1, rows[open_from:], np.zeros(n - open_from, np.int64)))
            free, still = np.ones(n, bool), []
            for i, row, node in starts:
                if len(row) and row[0] < open_from:
                    on = row >= open_from
                    row, node = row[on], node[on]
                node = self.step.get(node * 256 + text[row, j - 1])
                on = node >= 0
                row, node = row[on], node[on]
                if not len(row):
                    continue
                still.append((i, row, node))
                token = np.where(lengths[row] == j, self.at_end[node], self.inside[node])
                on = (token >= 0) & free[row]
                at, token = row[on], token[on]
                if i:
                    on = self.allowed(last[at, i], token)
                    at, token = at[on], token[on]
                last[at, j], came[at, j] = token, i
                free[at] = False
            starts = still
        at, live, back = lengths.copy(), rows, []
        counts = np.zeros(n, np.int64)
        while len(live):
            back.append((live, last[live, at[live]]))
            counts[live] += 1
            at[live] = came[live, at[live]]
            live = live[at[live] > 0]
        ends = np.cumsum(counts)
        ids = np.zeros(int(counts.sum()), "<i4")
        for k, (row, token) in enumerate(back):
            ids[ends[row] - 1 - k] = token
        return ids, ends


def explicit_automaton(symbols: list[str], merges: list[tuple[str, str]]) -> tuple[int, list[dict[str, int]]]:
    """The start state and each state's arcs, built one gadget after the other (small merge lists)."""
    states: list[dict[str, int]] = [{s: 0 for s in symbols}]
    for u, v in merges:
        copies: dict[int, int] = {}
        paths = [(p, arcs[u]) for p, arcs in enumerate(states) if u in arcs and v in states[arcs[u]]]
        reached = {(p, q): states[q][v] for p, q in paths}
        for p, q in paths:
            if q not in copies:
                copies[q] = len(states)
                states.append({t: r for t, r in states[q].items() if t != v})
            states[p][u] = copies[q]
            states[p][u + v] = reached[p, q]
        for q, copy in copies.items():  # a copy has the paths of its original
            if u in states[copy] and states[copy][u] in copies:
                states[copy][u] = copies[states[copy][u]]
            if u + v in states[q] and u in states[copy]:
                states[copy][u + v] = states[q][u + v]
    return 0, states


@lru_cache(maxsize=2)
def automaton(path: str) -> MergeAutomaton:
    return MergeAutomaton(path)


#: Letters and numerals below U+0250.
LETTERS, NUMERALS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
#: Characters whose lower case is one of them, too. In texts of these the library's normal form is the lower case.
PLAIN_ONES = "".join(c for c in map(chr, [9, 10, 13, *range(32, 127), *range(0xA1, 0x250)]) if len(c.lower()) == 1 and ord(c.lower()) < 0x250)
PLAIN = re.compile(f"[{re.escape(PLAIN_ONES)}]*")
PLAIN_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMERALS}]|[^\\s{LETTERS}{NUMERALS}]+")


class Encoder:
    """Whole texts to ids: special strings, normal form, words, then the automaton for words not met before."""

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.automaton = automaton(path)
        library = Tokenizer.from_file(path)
        pattern = json.loads(library.to_str())["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.normal = library.normalizer.normalize_str
        self.split = Split(Regex(pattern), "removed", invert=True)  # letters and numerals are those of the library's Unicode version
        self.special = re.compile("(" + "|".join(map(re.escape, self.automaton.special)) + ")")
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}

    def pieces(self, text: str) -> list[str]:
        parts = self.special.split(text) if "<|" in text else [text]
        return [w for part in parts for w in ([part] if part in self.automaton.special else self.split_words(part))]

    def split_words(self, text: str) -> list[str]:
        return PLAIN_WORDS.findall(text.lower()) if PLAIN.fullmatch(text) else [w for w, _ in self.split.pre_tokenize_str(self.normal(text))]

    def looked_up(self, words: set[str]) -> dict[str, tuple[bytes, str]]:
        """The ids (32-bit) and the joined labels of each word. Words of the last few slices are remembered."""
        if len(self.young) > MEMORY_WORDS:
            self.young, self.old = {}, self.young
        now = {w: found for w in words if (found := self.young.get(w) or self.old.get(w))}
        new = [w for w in words if w not in now and w not in self.automaton.special]
        label = self.automaton.label
        for w, ids in zip(new, self.automaton.encode_words([w.encode() for w in new]), strict=True):
            now[w] = ids, " ".join([label[i] for i in memoryview(ids).cast("i")])
        for w in words & self.automaton.special.keys():
            now[w] = np.array([self.automaton.special[w]], "<i4").tobytes(), w
        self.young.update(now)
        return now

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Each text's ids (32-bit, little-endian) and its labels joined by spaces."""
        split = {t: self.pieces(t) for t in set(texts)}
        now = self.looked_up(set().union(*split.values()))
        ids, labels = {w: x[0] for w, x in now.items()}, {w: x[1] for w, x in now.items()}
        done = {t: (b"".join(map(ids.__getitem__, words)), " ".join(map(labels.__getitem__, words))) for t, words in split.items()}
        return [done[t][0] for t in texts], [done[t][1] for t in texts]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded string for every row of docs; one task-local pass, no shuffle.

    A null or empty text has no ids and decodes to an empty text. A special string in a text is one
    id, as the vocabulary defines it. Repeated rows and rows without id stay; extra columns are not read.
    """

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, decoded = encoder(tokenizer).encode(part.column("text").to_pylist())
        offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
        flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return map_slices(id_and_text(docs, id_col, text_col), work, "doc_id long, ids array<int>, decoded string", limit=8 << 20)
