"""A small language model of subword ids with causal self-attention, in numpy.

The ids of a text are read in blocks of BLOCK positions. A block's queries look at its own positions up to themselves and at
the BLOCK positions before it, so windows of two blocks overlap by one, and each id is predicted once. A
layer joins the id at a position with what attention gathered, and gives the class of the next id on top
of what counts say about the class that follows this id. Which id of its class it is, counts of pairs say.
Ids are embedded, and put into classes, by the contexts that the counts show them in.
"""

from __future__ import annotations

import ctypes
import glob
import os
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Positions of a block, dimensions of an id, hidden units, classes of ids, blocks of a step (whose arrays fit a processor's own memory), and rate of the first steps.
BLOCK, WIDTH, HIDDEN, CLASSES, STEP_BLOCKS, RATE = 8, 16, 32, 32, 256, 2e-2
#: Blocks that are scored at a time.
SCORED_BLOCKS = 256
DISCOUNT, ROUNDS = 0.75, 15
f4 = np.float32


@dataclass
class Counts:
    """What all pairs of neighbouring ids tell: embeddings, the class of each id, log chances of the class after an id, and of an id after another one within its class."""

    embedding: np.ndarray
    class_of: np.ndarray
    class_after: np.ndarray
    id_after: np.ndarray


def counts_of(pairs: np.ndarray, width: int = WIDTH, classes: int = CLASSES) -> Counts:
    """From the number of times that each id (column) followed each one (row). Every id keeps some chance after every other one. Beside pairs, one array of its size is held at a time, and one of half."""
    size, rng = len(pairs), np.random.default_rng(1)
    single = pairs.sum(axis=0) + 0.5
    single = single / single.sum()
    total = pairs.sum(axis=1)
    begins = [rng.standard_normal((size, 2 * k)) for k in (2 * width, width // 2, width // 2)]
    some_rows = [slice(k, k + 256) for k in range(0, size, 256)]

    def directions(m: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The leading left singular vectors, times their values, by subspace iteration; half as many as the columns that it begins with."""
        q, k = np.linalg.qr(m @ begin)[0], begin.shape[1] // 2
        for _ in range(3):
            q = np.linalg.qr(m @ (m.T @ q))[0]
        u, s, _ = np.linalg.svd(q.T @ m, full_matrices=False)
        return (q @ u[:, :k]) * s[:k]

    def roots(m: np.ndarray, of: np.ndarray) -> np.ndarray:
        out = m / np.maximum(of, 1)[:, None]
        return np.sqrt(out, out=out)

    before = roots(pairs.T, pairs.sum(axis=0))
    places = directions(before, begins[0])
    before -= single @ before
    embedding = [directions(before, begins[2])]
    del before
    after = roots(pairs, total)
    after -= single @ after
    embedding = np.hstack([directions(after, begins[1]), *embedding])
    del after
    embedding /= np.sqrt(single @ embedding**2) + 1e-9
    # Classes are centres of what stands before their ids; the commonest ids are the first centres.
    centres = places[np.argsort(-single, kind="stable")[:classes]].copy()
    for _ in range(ROUNDS):
        class_of = ((centres**2).sum(axis=1) - 2 * places @ centres.T).argmin(axis=1)
        for c in np.unique(class_of):
            weight = single * (class_of == c)
            centres[c] = weight @ places / weight.sum()
    chance = pairs - DISCOUNT
    np.maximum(chance, 0.0, out=chance)
    for rows in some_rows:
        chance[rows] += np.minimum(pairs[rows], DISCOUNT).sum(axis=1)[:, None] * single
    chance /= np.where(total > 0, total, 1)[:, None]
    chance[total == 0] = single
    by_class = np.zeros((size, classes))
    for c in range(classes):
        by_class[:, c] = chance[:, class_of == c].sum(axis=1)
    within = np.empty((size, size), f4)
    for rows in some_rows:
        within[rows] = np.log(chance[rows] / by_class[rows][:, class_of])
    return Counts(np.clip(embedding, -4, 4).astype(f4), class_of.astype(np.int64), np.log(np.maximum(by_class, 1e-30)).astype(f4), within)


@lru_cache(maxsize=1)
def one_thread() -> None:
    """Have numpy multiply on the calling thread. Tasks run side by side, and threads of a pool that wait for small products keep their processors busy."""
    folder = os.path.join(os.path.dirname(os.path.dirname(np.__file__)), "numpy.libs")
    for path in glob.glob(os.path.join(folder, "*openblas*")):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


Weights = dict[str, np.ndarray]
SHAPES = {"look": (WIDTH, WIDTH), "near": (2 * BLOCK,), "own": (WIDTH, HIDDEN), "seen": (WIDTH, HIDDEN), "bias": (HIDDEN,), "out": (HIDDEN, CLASSES)}


def first_weights() -> Weights:
    rng = np.random.default_rng(2)
    scale = {"look": 0.02, "near": 0.0, "own": WIDTH**-0.5, "seen": WIDTH**-0.5, "bias": 0.0, "out": 0.02}
    return {name: (scale[name] * rng.standard_normal(shape)).astype(f4) for name, shape in SHAPES.items()}


def flat(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[name].ravel() for name in SHAPES])


def from_flat(numbers: np.ndarray, copy: bool = True) -> Weights:
    """Weights from their numbers, or as views of them."""
    ends = np.cumsum([int(np.prod(s)) for s in SHAPES.values()])
    return {name: part.reshape(shape).astype(f4, copy=copy) for (name, shape), part in zip(SHAPES.items(), np.split(numbers, ends[:-1]), strict=True)}


@dataclass
class Stream:
    """The ids of texts one after another; what follows at each place (-1 after the end); where each block starts; and how many blocks of each text there are before."""

    ids: np.ndarray
    follows: np.ndarray
    first: np.ndarray
    starts: np.ndarray

    def windows(self, at: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        block, ids = self.first[at] // BLOCK, self.ids.reshape(-1, BLOCK)
        return np.hstack([ids.take(block - 1, axis=0), ids.take(block, axis=0)]), self.follows.reshape(-1, BLOCK).take(block, axis=0)


def stream(texts: list[np.ndarray], end: int) -> Stream:
    """A block of end ids stands before each text, so that its first window is like any other; a text of no ids has one block, that of its end."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    counts = -(-sizes // BLOCK)
    starts = np.concatenate([[0], np.cumsum(counts)])
    at = (starts[:-1] + np.arange(1, len(texts) + 1)) * BLOCK
    length = int(starts[-1] + len(texts)) * BLOCK
    ids, follows = np.full(length, end, np.int32), np.full(length, -1, np.int32)
    for a, t in zip(at.tolist(), texts, strict=True):
        ids[a + 1 : a + 1 + len(t)] = t
        follows[a : a + len(t)] = t
    follows[at + sizes - 1] = end
    first = np.repeat(at - starts[:-1] * BLOCK, counts) + np.arange(starts[-1]) * BLOCK
    return Stream(ids, follows, first, starts)


#: How far back a query (row) looks to a position of its window (column), and whether it may.
BACK = np.clip(np.arange(BLOCK, 2 * BLOCK)[:, None] - np.arange(2 * BLOCK)[None, :], 0, None)
MAY = (np.arange(2 * BLOCK)[None, :] <= np.arange(BLOCK, 2 * BLOCK)[:, None]).astype(f4)
ONES = np.ones(max(2 * BLOCK, CLASSES), f4)
ZEROS = np.zeros((max(STEP_BLOCKS, SCORED_BLOCKS) * BLOCK, HIDDEN), f4)


def forward(ids: np.ndarray, follows: np.ndarray, counts: Counts, w: Weights) -> tuple:
    """Natural logs of the chances of the classes that follow, and what the way back needs."""
    keys = counts.embedding.take(ids, axis=0)
    return attended(keys, keys.transpose(0, 2, 1).copy(), ids[:, BLOCK:].ravel(), follows.ravel(), counts, w)


def attended(keys: np.ndarray, turned: np.ndarray, last: np.ndarray, following: np.ndarray, counts: Counts, w: Weights, tables: tuple[np.ndarray, np.ndarray] | None = None, most: float | None = None) -> tuple:
    """`forward` from the windows' embeddings, the same turned (dimensions first, each one's numbers side by side, which is faster to multiply by), and the ids at their positions. tables: what `looked_up` gives, where the weights stay as they are; most: where numbers are held below it."""
    n = len(keys)
    if tables is None:
        # What the hidden units get from each position, and a one for their bias, stand in one array, so that they take one product.
        given = np.empty((n * BLOCK, 2 * WIDTH + 1), w["own"].dtype)
        given[:, :WIDTH].reshape(n, BLOCK, WIDTH)[:] = keys[:, BLOCK:]
        given[:, 2 * WIDTH] = 1
        asks = given[:, :WIDTH] @ w["look"]
    else:
        given, asks, hidden = None, tables[0].take(last, axis=0), tables[1].take(last, axis=0)
    attention = asks.reshape(n, BLOCK, WIDTH) @ turned
    if most is not None:
        np.minimum(attention, most, out=attention)
    np.exp(attention, out=attention)
    attention *= np.exp(w["near"])[BACK] * MAY
    attention /= (attention.reshape(-1, 2 * BLOCK) @ ONES[: 2 * BLOCK]).reshape(n, BLOCK, 1)
    gathered = (attention @ keys).reshape(-1, WIDTH)
    if tables is None:
        given[:, WIDTH : 2 * WIDTH] = gathered
        hidden = given @ np.vstack([w["own"], w["seen"], w["bias"]])
    else:
        hidden += gathered @ w["seen"]
    np.maximum(hidden, ZEROS[: len(hidden)] if len(hidden) <= len(ZEROS) else 0, out=hidden)  # against one number it takes four times as long
    scores = hidden @ w["out"]
    scores += counts.class_after.take(last, axis=0)
    if most is not None:
        np.minimum(scores, most, out=scores)
    picked = np.arange(0, len(last) * CLASSES, CLASSES) + counts.class_of.take(following)
    found = scores.ravel().take(picked)
    np.exp(scores, out=scores)
    total = scores @ ONES[:CLASSES]
    if most is None and not np.isfinite(total).all():
        return attended(keys, turned, last, following, counts, w, tables, 60.0)
    return found - np.log(total), scores, total, picked, hidden, given, attention, keys, turned


def looked_up(counts: Counts, w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """What each id asks for, and gives to the hidden units, by itself."""
    return counts.embedding @ w["look"], counts.embedding @ w["own"] + w["bias"]


def log_chances(texts: list[np.ndarray], end: int, counts: Counts, w: Weights, step_blocks: int = SCORED_BLOCKS) -> np.ndarray:
    """Natural logs of the chances of whole texts, their ends included."""
    if not texts:
        return np.zeros(0)
    one_thread()
    read, tables = stream(texts, end), looked_up(counts, w)
    blocks = len(read.ids) // BLOCK
    # Blocks are taken as they stand, those between texts among them, where nothing follows.
    found = np.zeros(blocks)
    for k in range(1, blocks, step_blocks):
        stop = min(k + step_blocks, blocks)
        ids, following = read.ids[(k - 1) * BLOCK : stop * BLOCK], read.follows[k * BLOCK : stop * BLOCK]
        embedded = counts.embedding.take(ids, axis=0)
        keys = np.lib.stride_tricks.as_strided(embedded, (stop - k, 2 * BLOCK, WIDTH), (embedded.strides[0] * BLOCK, *embedded.strides), writeable=False)
        of_dimension = embedded.T.copy()
        turned = np.lib.stride_tricks.as_strided(of_dimension, (stop - k, WIDTH, 2 * BLOCK), (of_dimension.strides[1] * BLOCK, *of_dimension.strides), writeable=False)
        last = ids[BLOCK:]
        by_class = attended(keys, turned, last, following, counts, w, tables)[0]
        within = counts.id_after.ravel().take(last.astype(np.int64) * len(counts.id_after) + following, mode="wrap")
        found[k:stop] = np.where(following < 0, 0.0, by_class.astype(float) + within).reshape(-1, BLOCK).sum(axis=1)
    return np.add.reduceat(found, read.first[read.starts[:-1]] // BLOCK)


def gradient(ids: np.ndarray, follows: np.ndarray, counts: Counts, w: Weights) -> Weights:
    """Of the mean loss of the blocks' positions."""
    _, scores, total, picked, hidden, given, attention, keys, turned = forward(ids, follows, counts, w)
    n = len(ids)
    real = follows.ravel() >= 0
    each = (real / max(1, int(real.sum()))).astype(f4)
    scores *= (each / total)[:, None]
    scores.ravel()[picked] -= each
    to_hidden = scores @ w["out"].T
    to_hidden *= hidden > 0
    own, seen, bias = np.split(given.T @ to_hidden, [WIDTH, 2 * WIDTH])
    out = {"out": hidden.T @ scores, "own": own, "seen": seen, "bias": bias[0]}
    to_attention = (to_hidden @ w["seen"].T).reshape(n, BLOCK, WIDTH) @ turned
    to_attention *= attention
    to_attention -= attention * (to_attention.reshape(-1, 2 * BLOCK) @ ONES[: 2 * BLOCK]).reshape(n, BLOCK, 1)
    out["near"] = np.bincount(BACK.ravel(), weights=(to_attention.sum(axis=0) * MAY).ravel(), minlength=2 * BLOCK).astype(f4)
    out["look"] = given[:, :WIDTH].T @ (to_attention @ keys).reshape(-1, WIDTH)
    return out


def trained(texts: list[np.ndarray], end: int, counts: Counts, w: Weights, rate: float = RATE, step_blocks: int = STEP_BLOCKS) -> tuple[Weights, int]:
    """The weights after every block of the texts has been learned from, once, by Adam steps with a falling rate; and the number of ids that were predicted."""
    one_thread()
    numbers = flat(w)
    w = from_flat(numbers, copy=False)
    mean, square = np.zeros_like(numbers), np.zeros_like(numbers)
    read = stream(texts, end)
    order = np.random.default_rng(3).permutation(len(read.first))
    steps = -(-len(order) // step_blocks)
    for t in range(1, steps + 1):
        now = rate * min(1.0, t / 30) * (1 - 0.9 * t / steps)
        g = flat(gradient(*read.windows(order[(t - 1) * step_blocks : t * step_blocks]), counts, w))
        mean += 0.1 * (g - mean)
        square += 0.02 * (g * g - square)
        numbers -= (now / (1 - 0.9**t)) * mean / (np.sqrt(square / (1 - 0.98**t)) + 1e-8)
    return w, int((read.follows >= 0).sum())
