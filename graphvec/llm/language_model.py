"""Scoring of whole documents with a gated recurrent language model, trained here in numpy.

Tokens are the words of a text and one end token. Three things are learned from the training rows:

1. Counts of every word (one pass, summed in the tasks first) give the base score and the vocabulary.
2. The most frequent words, ``KNOWN`` at most, form a dictionary that is sent to the tasks (a word of more than
   ``LONG`` bytes is represented by a 128-bit hash, so the dictionary's size is bounded). All other words are
   rare: a task passes a document's distinct rare words on, and a shuffle join finds their counts.
3. The recurrent network: a gated recurrent unit over the words, and a class-factored softmax. The most
   frequent words fill ``CLASSES`` classes of ``MEMBERS`` words with a softmax each; the rest of the dictionary lies in
   ``BANDS`` classes by rank, whose members have their share of the band's count; rare and unseen words form the last
   class, with shares ``(c + 0.1) / (n + 0.1 (v + 1))`` over that class. So a word's probability is that of its class
   given the state times that of the word in its class, and the network starts at the unigram distribution.

Training takes every training row whole: its cost grows with the input. A caller may give a smaller ``share`` (by a hash of
id and text). Documents of a task run side by side in lanes, in windows of ``WINDOW`` steps; the state is carried from window to window and gradients stop at
the window's start. Replicas train on ``REPLICA_TOKENS`` tokens a round each and are averaged by their tokens after each of
``ROUNDS`` rounds, in two levels of blocks, so that no task holds more than a few hundred blocks. The model's size is fixed.

Scoring carries the state through the whole document, too, whatever its length.

Defined results: null or empty text is its end token alone. A null doc_id counts as the text '' (CRC-32 0: held out). Very long
texts are scored whole, in 4 bytes a token. Repeated rows are scored alike (up to the last digits of a float sum) and count each time.
Without training rows the counts are 0 and every score is 0; an empty table gives no rows. Ties of counts are
ranked by the word's bytes; words of one count are in the dictionary all or none. Extra columns do not matter, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphvec.llm.text import blobs, pieces, words
from graphvec.session import write_table

ADDED = 0.1
KNOWN, LONG = 200_000, 64
CLASSES, MEMBERS, BANDS, HIDDEN = 64, 64, 8, 32
#: The network learns from every training row; a smaller ``share`` is the caller's choice.
SHARE, ROUNDS, REPLICA_TOKENS = 1.0, 4, 1_200_000
LANES, WINDOW, STEP_SIZE, MOST_NORM = 512, 32, 0.01, 1.0
LEAST_LANES, SCORED_LANES, UPDATES = 8, 256, 64
#: Tokens whose documents a task scores side by side.
CHUNK_TOKENS = 2_000_000
#: Words that a task counts before it passes its sums on, and numbers of the model in a block.
FLUSH_WORDS, BLOCK = 2_000_000, 1 << 16
#: Rows of states that are read out at a time, and occurrences from which a symbol's gradients are summed at once.
ROWS, FREQUENT = 2048, 12
#: The end token's place among the words (no word is empty).
END = b""


def tokens(blob: bytes) -> list[bytes]:
    """Words with A-Z lower-cased; long ones by their hash (0xFF starts no UTF-8 text)."""
    out = words(blob.lower())
    if out and max(map(len, out)) > LONG:
        out = [w if len(w) <= LONG else b"\xff" + xxhash.xxh3_128_digest(w) for w in out]
    return out


def is_held_out(doc_id: str = "doc_id", folds: int = 10) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, n)`` of ``texts(text)``, end tokens included."""

    def batch(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = Counter(), 0
        for b in pieces(batches):
            for blob in blobs(b.column("text")):
                here = tokens(blob)
                found.update(here)
                n += len(here)
                if n >= FLUSH_WORDS:
                    yield batch(found)
                    found, n = Counter(), 0
            found[END] += b.num_rows
        if found:
            yield batch(found)

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Sizes:
    classes: int = CLASSES
    members: int = MEMBERS
    bands: int = BANDS
    hidden: int = HIDDEN

    @property
    def soft(self) -> int:
        """Words with a softmax of their own."""
        return self.classes * self.members

    @property
    def symbols(self) -> int:
        """What the network reads: soft words, bands, the rare class."""
        return self.soft + self.bands + 1

    @property
    def all_classes(self) -> int:
        return self.classes + self.bands + 1

    def shapes(self) -> dict[str, tuple[int, ...]]:
        h = self.hidden
        return {
            "read": (self.symbols, 3 * h), "keep": (h, 3 * h),
            "to_class": (h, self.all_classes), "class_bias": (self.all_classes,),
            "to_member": (self.classes, self.members, h), "member_bias": (self.classes, self.members),
        }


class Vocabulary:
    """The dictionary with its counts, and what is known of all other words."""

    def __init__(self, known: list[tuple[bytes, int]], total: int, distinct: int, sizes: Sizes):
        self.sizes, self.total, self.distinct = sizes, total, distinct
        self.index = {w: i for i, (w, _) in enumerate(known)}
        self.counts = np.array([n for _, n in known], np.int64)
        self.rest_total, self.rest_distinct = total - int(self.counts.sum()), distinct - len(known)
        n = len(known)
        # symbol of a word; bands are cut at equal steps of the rank's logarithm
        edges = np.geomspace(sizes.soft, max(n, sizes.soft + 1), sizes.bands + 1)[1:-1]
        self.symbol = np.arange(n + 1)
        self.symbol[sizes.soft :] = sizes.soft + np.searchsorted(edges, np.arange(sizes.soft, n + 1), side="right")
        self.symbol[n] = sizes.symbols - 1  # rare words (index -1)
        mass = np.zeros(sizes.symbols)
        np.add.at(mass, self.symbol[:n], self.counts)
        mass[-1] = self.rest_total + ADDED * (self.rest_distinct + 1)
        self.mass = mass
        # log of a band word's share of its band; 0 for soft and rare ones
        self.share = np.zeros(n + 1)
        self.share[sizes.soft : n] = np.log(self.counts[sizes.soft :] / mass[self.symbol[sizes.soft : n]])
        self.base = np.append(np.log10((self.counts + ADDED) / self.whole), 0.0)

    @property
    def whole(self) -> float:
        return self.total + ADDED * (self.distinct + 1)

    def encode(self, found: list[bytes]) -> np.ndarray:
        """Places in the dictionary (-1: rare), the end token last."""
        out = np.fromiter(map(self.index.get, found, repeat(-1)), np.int32, len(found))
        return np.append(out, np.int32(self.index.get(END, -1)))


def new_model(v: Vocabulary, seed: int = 1) -> dict[str, np.ndarray]:
    """Weights that give the unigram distribution."""
    rng, s = np.random.default_rng(seed), v.sizes
    m = {k: np.zeros(x, np.float32) for k, x in s.shapes().items()}
    m["read"] = rng.normal(0, 0.1, m["read"].shape).astype(np.float32)
    m["keep"] = rng.normal(0, 1 / math.sqrt(s.hidden), m["keep"].shape).astype(np.float32)
    soft = v.mass[: s.soft].reshape(s.classes, s.members)
    per_class = np.append(soft.sum(axis=1), v.mass[s.soft :])
    nothing = -1e9  # classes and members that no word fills
    with np.errstate(divide="ignore"):
        m["class_bias"] = np.where(per_class > 0, np.log(per_class / per_class.sum()), nothing).astype(np.float32)
        m["member_bias"] = np.where(soft > 0, np.log(soft / np.maximum(soft.sum(axis=1), 1)[:, None]), nothing).astype(np.float32)
    return m


def flat(m: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([m[k].ravel() for k in m])


def unflat(v: np.ndarray, s: Sizes) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in s.shapes().items():
        n = math.prod(shape)
        out[k], at = v[at : at + n].reshape(shape), at + n
    return out


# ------------------------------------------------------------------ network


class Space(dict):
    """Arrays by name, used again by the next window: fresh memory costs more than what is computed in it."""

    def __call__(self, name: str, shape: tuple[int, ...], kind=np.float32) -> np.ndarray:
        size, x = math.prod(shape), self.get(name)
        if x is None or x.size < size or x.dtype != kind:
            x = self[name] = np.empty(size, kind)
        return x[:size].reshape(shape)


def _weights(m: dict) -> tuple[np.ndarray, np.ndarray]:
    """``read`` and ``keep`` as one matrix for each gate and the candidate, so that no step works on slices of rows. Those of the
    gates are halved (the logistic function is ``(1 + tanh(x / 2)) / 2``)."""
    out = []
    for name in ("read", "keep"):
        x = np.ascontiguousarray(m[name].reshape(len(m[name]), 3, -1).transpose(1, 0, 2))
        x[:2] *= 0.5
        out.append(x)
    return out[0], out[1]


def _gates(x: np.ndarray, keep: np.ndarray, h: np.ndarray, a: np.ndarray | None = None) -> np.ndarray:
    """Turns the inputs ``x`` (3, lanes, hidden) into update gate, reset gate and candidate; returns the candidate's kept part."""
    a = np.matmul(h, keep, out=a)
    zr, c = x[:2], x[2]
    zr += a[:2]
    np.tanh(zr, out=zr)
    zr *= 0.5
    zr += 0.5
    c += zr[1] * a[2]
    np.tanh(c, out=c)
    return a[2]


def _softmax(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, place: np.ndarray, scale: float | None, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of the columns ``place``; with ``scale``, that times the gradients of their negatives, too."""
    z = np.matmul(h, weights, out=space("softmax", (len(h), len(bias)), h.dtype))
    z += bias
    rows, ones = np.arange(len(h)), np.ones(len(bias), h.dtype)
    picked = z[rows, place]
    total = np.exp(z, out=z) @ ones
    if not (total.min() > 1e-25 and total.max() < 1e30):  # far from 0: relative to each row's largest entry
        np.matmul(h, weights, out=z)
        z += bias
        z -= z.max(axis=1, keepdims=True)
        picked = z[rows, place]
        total = np.exp(z, out=z) @ ones
    if scale is not None:
        z *= (scale / total)[:, None]
        z[rows, place] -= scale
    return picked - np.log(total), z


def _output(m: dict, s: Sizes, h: np.ndarray, want: np.ndarray, grads: dict | None = None, space: Space | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probability of the symbols ``want`` given states ``h``; with ``grads``, adds the gradients of the
    mean negative log probability and returns that of ``h``. Rows go in blocks that stay in the processor's cache."""
    n, space = len(want), Space() if space is None else space
    of = np.where(want < s.soft, want // s.members, want - (s.soft - s.classes)).astype(np.int16)
    order = np.argsort(of, kind="stable")  # a radix sort; all below is in the order of classes
    of, want, h = of[order], want[order], h.take(order, axis=0, out=space("sorted", h.shape, h.dtype), mode="clip")
    logs, ones = np.empty(n), np.ones(min(n, ROWS), h.dtype)
    back, scale = (None, None) if grads is None else (space("back", h.shape, h.dtype), h.dtype.type(1 / n))
    edges = np.searchsorted(of, np.arange(s.classes + 1))
    with np.errstate(over="ignore"):
        for k in range(0, n, ROWS):
            at = slice(k, k + ROWS)
            logs[at], d = _softmax(h[at], m["to_class"], m["class_bias"], of[at], scale, space)
            if grads is not None:
                grads["to_class"] += h[at].T @ d
                grads["class_bias"] += ones[: len(d)] @ d
                np.matmul(d, m["to_class"].T, out=back[at])
        for c in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            for k in range(edges[c], edges[c + 1], ROWS):
                at = slice(k, min(k + ROWS, edges[c + 1]))
                more, d = _softmax(h[at], m["to_member"][c].T, m["member_bias"][c], want[at] - c * s.members, scale, space)
                logs[at] += more
                if grads is not None:
                    grads["to_member"][c] += d.T @ h[at]
                    grads["member_bias"][c] += ones[: len(d)] @ d
                    back[at] += d @ m["to_member"][c]
    out, down = np.empty_like(logs), None if back is None else space("down", back.shape, back.dtype)
    out[order] = logs
    if back is not None:
        down[order] = back
    return out, down


def _summed(parts: list[np.ndarray], ids: np.ndarray, size: int, space: Space) -> np.ndarray:
    """Sums of the rows of ``parts``, side by side, by their ``ids``: a frequent id at once, the others occurrence by occurrence."""
    order = np.argsort(ids.astype(np.min_scalar_type(size)), kind="stable")
    rows, ids = space("ordered", (len(parts), *parts[0].shape), parts[0].dtype), ids[order]
    for x, out in zip(parts, rows, strict=True):
        x.take(order, axis=0, out=out, mode="clip")
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    times = np.diff(np.r_[first, len(ids)])
    out = np.zeros((len(parts), size, rows.shape[2]), rows.dtype)
    for i, n in zip(first[times >= FREQUENT].tolist(), times[times >= FREQUENT].tolist(), strict=True):
        out[:, ids[i]] = rows[:, i : i + n].sum(axis=1)
    first, times = first[times < FREQUENT], times[times < FREQUENT]
    for k in range(int(times.max(initial=0))):
        at = first[times > k]
        out[:, ids[at]] += rows[:, at + k]
    return out.transpose(1, 0, 2).reshape(size, -1)


class Lanes:
    """Documents (arrays of symbols) side by side. Whole documents go to lanes of like load, the longest lane first;
    ``steps`` yields them. With ``even`` one row of all documents is cut into equal lanes, as training does: the first document
    of a lane may start in its middle; ``windows`` yields these."""

    def __init__(self, docs: list[np.ndarray], end: int, lanes: int, window: int, *, even: bool = False):
        self.window = window
        if even:
            size = max(1, -(-sum(map(len, docs)) // lanes))
            whole = _row(range(len(docs)), docs, end)
            self.want, self.doc, self.read, self.fresh = ([x[i : i + size] for i in range(0, len(x), size)] for x in whole)
            return
        loads = [(0, i) for i in range(max(1, min(lanes, len(docs))))]
        of: list[list[int]] = [[] for _ in loads]
        for i in sorted(range(len(docs)), key=lambda i: (-len(docs[i]), i)):
            load, lane = heapq.heappop(loads)
            of[lane].append(i)
            heapq.heappush(loads, (load + len(docs[i]), lane))
        of = sorted((x for x in of if x), key=lambda x: -sum(len(docs[i]) for i in x))
        self.want, self.doc, self.read, self.fresh = zip(*(_row(x, docs, end) for x in of), strict=True) if of else ([], [], [], [])

    def steps(self) -> tuple[np.ndarray, ...]:
        """Inputs, targets, starts of documents and numbers of documents of the first step, the second, ..., and where each step begins
        (the end last). Lanes that are over have left."""
        sizes = np.array([len(w) for w in self.want], np.int64)
        left = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(sizes.max(initial=0)), side="right")
        begins, out = np.append(0, np.cumsum(left)), []
        place = np.concatenate([np.zeros(0, np.int64), *(begins[:n] + i for i, n in enumerate(sizes.tolist()))])
        for source, kind in ((self.read, np.int32), (self.want, np.int32), (self.fresh, bool), (self.doc, np.int32)):
            out.append(np.empty(len(place), kind))
            out[-1][place] = np.concatenate(source) if source else 0
        return (*out, begins)

    def windows(self) -> Iterator[tuple[np.ndarray, ...]]:
        """For every ``window`` steps of even lanes inputs, targets, starts and numbers of documents as (steps, lanes) arrays; a lane
        that is over has left (targets of -1 fill its last window)."""
        size = len(self.want[0]) if self.want else 0
        missing = size - len(self.want[-1]) if self.want else 0
        tables = [np.concatenate([*x, np.full(missing, fill, x[0].dtype)]).reshape(-1, size) for x, fill in ((self.read, 0), (self.want, -1), (self.fresh, False), (self.doc, 0)) if x]
        for t in range(0, size, self.window):
            here = len(self.want) - (t >= size - missing)
            yield tuple(np.ascontiguousarray(x[:here, t : t + self.window].T) for x in tables)


def _row(some: Iterable[int], docs: list[np.ndarray], end: int) -> tuple[np.ndarray, ...]:
    """Targets, numbers, inputs and starts of some documents in a row."""
    some = list(some)
    size = [len(docs[i]) for i in some]
    want = np.concatenate([docs[i] for i in some]).astype(np.int32) if some else np.zeros(0, np.int32)
    starts = np.cumsum([0, *size])[:-1]
    read, fresh = np.roll(want, 1), np.zeros(len(want), bool)
    read[starts], fresh[starts] = end, True
    return want, np.repeat(np.array(some, np.int32), size), read, fresh


def log_probabilities(m: dict, s: Sizes, docs: list[np.ndarray], end: int, *, lanes: int = SCORED_LANES, window: int = WINDOW) -> np.ndarray:
    """Natural log of the probability of the symbols of each document. The states are read out ``lanes * window`` or more at a time,
    however few lanes are left."""
    read, want, fresh, doc, begins = Lanes(docs, end, lanes, window).steps()
    logs, (inputs, keep) = np.empty(len(want)), _weights(m)
    h = np.zeros((max(1, min(lanes, len(docs))), s.hidden), np.float32)
    space, done = Space(), 0
    states = space("states", (lanes * (window + 1), s.hidden))
    bounds = begins.tolist()
    some_fresh = np.logical_or.reduceat(fresh, begins[:-1]).tolist() if len(want) else []
    for t, here in enumerate(some_fresh):
        a, b = bounds[t], bounds[t + 1]
        h = h[: b - a]
        if here:
            h = np.where(fresh[a:b, None], np.float32(0), h)
        x = inputs.take(read[a:b], axis=1, out=space("x", (3, b - a, s.hidden)), mode="clip")
        _gates(x, keep, h, space("a", x.shape))
        now = np.subtract(h, x[2], out=states[a - done : b - done])
        now *= x[0]
        now += x[2]
        h = now
        if b - done >= lanes * window or b == len(want):
            logs[done:b] = _output(m, s, states[: b - done], want[done:b], None, space)[0]
            h, done = now.copy(), b
    return np.bincount(doc, logs, len(docs)) if len(docs) else np.zeros(0)


def _backward(m: dict, s: Sizes, h: np.ndarray, read: np.ndarray, want: np.ndarray, fresh: np.ndarray, space: Space | None = None) -> tuple[float, int, dict, np.ndarray]:
    """One window: sum of negative logs, tokens, gradients of their mean, last state."""
    k, (steps, lanes), kind, space = s.hidden, read.shape, m["keep"].dtype, Space() if space is None else space
    inputs, keep = _weights(m)
    before, states = space("before", (steps, lanes, k), kind), space("states", (steps, lanes, k), kind)
    gates, parts = space("gates", (3, steps, lanes, k), kind), space("parts", (steps, lanes, k), kind)
    some_fresh = fresh.any(axis=1).tolist()
    for t in range(steps):
        before[t] = h
        if some_fresh[t]:
            before[t][fresh[t]] = 0
        x = inputs.take(read[t], axis=1, out=space("x", (3, lanes, k), kind), mode="clip")
        parts[t] = _gates(x, keep, before[t], space("a", x.shape, kind))
        gates[:, t] = x
        h = np.subtract(before[t], x[2], out=states[t])
        h *= x[0]
        h += x[2]
    last = h.copy()
    g = {name: np.zeros(x, np.float32) for name, x in s.shapes().items()}
    states, valid = states.reshape(-1, k), want.ravel() >= 0
    if valid.all():
        logs, down = _output(m, s, states, want.ravel(), g, space)
    else:
        down = np.zeros_like(states)
        logs, down[valid] = _output(m, s, states[valid], want.ravel()[valid], g, space)
    down = down.reshape(steps, lanes, k)
    # gates, candidate and its kept part give way to the gradients of the sums inside them
    turned = np.ascontiguousarray(m["keep"].reshape(k, 3, k).transpose(1, 2, 0))
    later, some, more = np.zeros((lanes, k), kind), np.empty((lanes, k), kind), np.empty((lanes, k), kind)
    for t in range(steps - 1, -1, -1):
        (z, r, c), a, d = gates[:, t], parts[t], down[t]
        d += later
        np.multiply(d, z, out=later)
        np.subtract(1, z, out=some)
        np.subtract(before[t], c, out=more)
        more *= later
        np.multiply(more, some, out=z)
        d *= some
        np.multiply(c, c, out=some)
        np.subtract(1, some, out=some)
        np.multiply(d, some, out=c)
        np.multiply(c, a, out=some)
        some *= r
        np.multiply(c, r, out=a)
        np.subtract(1, r, out=r)
        r *= some
        for x, y in zip((z, r, a), turned, strict=True):
            later += np.matmul(x, y, out=some)
        if some_fresh[t]:
            later[fresh[t]] = 0
    flat_before = before.reshape(-1, k).T
    for i, x in enumerate((gates[0], gates[1], parts)):
        g["keep"][:, i * k : (i + 1) * k] = flat_before @ x.reshape(-1, k)
    g["read"] += _summed([x.reshape(-1, k) for x in gates], read.ravel(), s.symbols, space)
    return -float(logs.sum()), len(logs), g, last


def train_replica(m: dict, s: Sizes, docs: list[np.ndarray], end: int, *, lanes: int | None = None, window: int = WINDOW, step: float = STEP_SIZE) -> tuple[dict, float, int]:
    """``m`` after one pass over ``docs`` (Adam, fresh moments), summed loss, tokens. A replica with few tokens
    has fewer lanes, so that it takes some steps all the same."""
    lanes = lanes or min(LANES, max(LEAST_LANES, sum(map(len, docs)) // (window * UPDATES)))
    names = list(m)
    m = {k: m[k].copy() for k in names}
    one, two = ({k: np.zeros_like(m[k]) for k in names} for _ in range(2))
    h = np.zeros((lanes, s.hidden), np.float32)
    loss, count, space = 0.0, 0, Space()
    for n, (read, want, fresh, _) in enumerate(Lanes(docs, end, lanes, window, even=True).windows(), 1):
        lost, seen, g, h = _backward(m, s, h[: read.shape[1]], read, want, fresh, space)
        loss, count = loss + lost, count + seen
        norm = math.sqrt(sum(float(np.vdot(x, x)) for x in g.values()))
        scale = min(1.0, MOST_NORM / max(norm, 1e-12))
        rate = step * min(1.0, n / 10) * math.sqrt(1 - 0.99**n) / (1 - 0.9**n)
        for k in names:
            x = g[k]
            x *= np.float32(scale)
            one[k] += np.float32(0.1) * (x - one[k])
            x *= x
            two[k] += np.float32(0.01) * (x - two[k])
            np.sqrt(two[k], out=x)
            x += np.float32(1e-6)
            np.divide(one[k], x, out=x)
            x *= np.float32(rate)
            m[k] -= x
    return m, loss, count


# ------------------------------------------------------------------ on Spark


def learn_vocabulary(counts: DataFrame, *, known: int = KNOWN, sizes: Sizes = Sizes()) -> Vocabulary:
    """The dictionary from written ``counts(word, n)``: all words that occur often enough, as many as ``known`` allows. Only
    these, of at most ``LONG`` bytes each, reach the driver. (A sorted limit would send as many from every task.)"""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    # narrow the least count: the highest one is certain to be rare enough, ``low`` is not
    low, high = 0, int(total["most"]) + 1
    while high - low > 1:
        marks = sorted({low + 1 + (high - low - 1) * k // 32 for k in range(32)} | {int(low * (high / low) ** (k / 32)) for k in range(1, 32) if low} | {1 << k for k in range(60)})
        marks = [x for x in marks if low < x < high]
        above = counts.agg(*[F.sum((F.col("n") >= x).cast("long")).alias(f"m{i}") for i, x in enumerate(marks)]).first()
        fits = [x for x, n in zip(marks, above, strict=True) if n <= known]
        low, high = max((x for x in marks if x not in fits), default=low), min(fits, default=high)
    top = sorted(((bytes(r["word"]), r["n"]) for r in counts.where(F.col("n") >= high).collect()), key=lambda x: (-x[1], x[0]))
    return Vocabulary(top, int(total["n"]), int(total["v"]), sizes)


def _averaged(rows: DataFrame, *keys: str) -> DataFrame:
    """Blocks of models averaged by their tokens, for each value of ``keys``."""

    def mean(part: pd.DataFrame) -> pd.DataFrame:
        total = int(part["tokens"].sum())
        out = sum(np.frombuffer(x, np.float32).astype(np.float64) * (n / total) for x, n in zip(part["x"], part["tokens"], strict=True))
        return pd.DataFrame({**{k: [part[k].iloc[0]] for k in ("block", "salt")}, "tokens": [total], "loss": [float(part["loss"].sum())], "x": [out.astype(np.float32).tobytes()]})

    return rows.groupBy(*keys).applyInPandas(mean, "block int, salt int, tokens long, loss double, x binary")


_CODED = "doc_id long, held_out boolean, h long, n long, n_rare long, base double, share double, rare array<struct<word:binary,times:int>>, symbols binary"


def coded(docs: DataFrame, v: Vocabulary, *, seed: int = 1) -> DataFrame:
    """``docs(doc_id, held_out, text)`` as written rows with a number each: the symbols of the text, its distinct rare words, and what
    the words of the dictionary add to its scores. A text is cut into words once for training and scoring."""
    told = docs.sparkSession.sparkContext.broadcast(v)
    names = [c.split()[0] for c in _CODED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = told.value
        kind = _kind(v.sizes)
        for b in pieces(batches):
            n, n_rare, base, share, symbols, words, times, ends = [], [], [], [], [], [], [], [0]
            for blob in blobs(b.column("text")):
                found = tokens(blob)
                at = v.encode(found)
                rare = Counter(map(found.__getitem__, np.flatnonzero(at[:-1] < 0).tolist()))
                if at[-1] < 0:
                    rare[END] += 1
                n.append(len(at))
                n_rare.append(rare.total())
                base.append(float(v.base[at].sum()))
                share.append(float(v.share[at].sum()))
                symbols.append(v.symbol[at].astype(kind).tobytes())
                words.extend(rare)
                times.extend(rare.values())
                ends.append(len(words))
            rare = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(times, pa.int32())], ["word", "times"])
            rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rare)
            own = [pa.array(n, pa.int64()), pa.array(n_rare, pa.int64()), pa.array(base, pa.float64()), pa.array(share, pa.float64()), rare, pa.array(symbols, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), b.column("h"), *own], names)

    # copies with ids of their own are drawn apart
    out = docs.select("doc_id", "held_out", F.xxhash64("doc_id", "text", F.lit(seed)).alias("h"), "text").mapInArrow(run, _CODED)
    out = write_table(out.withColumn("row", F.monotonically_increasing_id()), "coded")
    told.destroy()
    return out


def _kind(s: Sizes) -> np.dtype:
    """Of symbols in a table."""
    return np.dtype("<u2" if s.symbols <= 1 << 16 else "<u4")


def train(rows: DataFrame, v: Vocabulary, *, share: float = SHARE, rounds: int = ROUNDS, replica_tokens: int = REPLICA_TOKENS, seed: int = 1) -> tuple[dict, list[float]]:
    """The network after ``rounds`` rounds over the documents of coded ``rows`` that the share takes, and the
    mean loss (natural log) of each round as it went."""
    spark, s = rows.sparkSession, v.sizes
    drawn = rows.where(F.pmod("h", F.lit(1_000_000)) < int(share * 1_000_000)).select("h", "n", "symbols")
    drawn = drawn.withColumn("round", F.pmod(F.shiftright("h", 32), F.lit(rounds)).cast("int"))
    drawn = write_table(drawn, "training_symbols")
    sizes = {r["round"]: r["n"] for r in drawn.groupBy("round").agg(F.sum("n").alias("n")).collect()}
    m, losses, end = new_model(v, seed), [], _end(v)
    for number in range(rounds):
        if not sizes.get(number):
            continue
        replicas = -(-sizes[number] // replica_tokens)
        model = spark.sparkContext.broadcast(flat(m))
        some = drawn.where(F.col("round") == number).select("h", "symbols").repartition(replicas).sortWithinPartitions("h", "symbols")
        salts = max(1, math.isqrt(replicas))
        blocks = some.mapInArrow(_replica(model, s, end), "block int, tokens long, loss double, x binary")
        blocks = blocks.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        part = write_table(_averaged(blocks, "block", "salt"), "replicas")
        done = sorted(_averaged(part, "block").collect(), key=lambda r: r["block"])
        model.destroy()
        m = unflat(np.concatenate([np.frombuffer(r["x"], np.float32) for r in done]), s)
        losses.append(done[0]["loss"] / done[0]["tokens"])
    return m, losses


def _end(v: Vocabulary) -> int:
    return int(v.symbol[v.index.get(END, -1)])


def _replica(model, s: Sizes, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = [np.frombuffer(x.as_py(), _kind(s)) for b in batches for x in b.column("symbols")]
        if not docs:
            return
        m, loss, n = train_replica(unflat(model.value, s), s, docs, end)
        out = flat(m)
        for k, at in enumerate(range(0, len(out), BLOCK)):
            columns = [pa.array([k], pa.int32()), pa.array([n], pa.int64()), pa.array([loss]), pa.array([out[at : at + BLOCK].tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "tokens", "loss", "x"])

    return run


def score_known(rows: DataFrame, v: Vocabulary, m: dict, *, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """The columns of coded ``rows`` but symbols and rare words, with ``score``: without what the shares of rare words add."""
    s, end = v.sizes, _end(v)
    told = rows.sparkSession.sparkContext.broadcast(flat(m))
    names = ["row", "doc_id", "held_out", "n", "n_rare", "base", "share"]

    def finish(held: list[pa.RecordBatch], m: dict) -> pa.Table:
        whole = pa.Table.from_batches(held)
        docs = [np.frombuffer(x.as_buffer(), _kind(s)) for b in held for x in b.column("symbols")]
        score = (log_probabilities(m, s, docs, end) + whole.column("share").to_numpy()) / math.log(10)
        return whole.drop_columns("symbols").append_column("score", pa.array(score))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = unflat(told.value, s)
        held, n = [], 0
        for b in pieces(batches):
            held.append(b)
            n += int(np.sum(b.column("n").to_numpy()))
            if n >= chunk_tokens:
                yield from finish(held, m).to_batches()
                held, n = [], 0
        if held:
            yield from finish(held, m).to_batches()

    return rows.select(*names, "symbols").mapInArrow(run, "row long, doc_id long, held_out boolean, n long, n_rare long, base double, share double, score double")


def score(docs: DataFrame, *, folds: int = 10, known: int = KNOWN, sizes: Sizes = Sizes(), **settings) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row; rows whose doc_id's CRC-32 is
    no multiple of ``folds`` are learned from."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(folds=folds).alias("held_out"), F.col("text").cast("string").alias("text"))
    counts = write_table(word_counts(rows.where(~F.col("held_out")).select("text")), "word_counts")
    v = learn_vocabulary(counts, known=known, sizes=sizes)
    rows = coded(rows, v)
    m, _ = train(rows.where(~F.col("held_out")), v, **settings)
    scored = score_known(rows, v, m)

    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times").join(counts, "word", "left")
    n = F.coalesce("n", F.lit(0))
    rest = v.rest_total + ADDED * (v.rest_distinct + 1)
    rare = rare.groupBy("row").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10((n + ADDED) / F.lit(v.whole))).alias("base_rare"),
        F.sum(F.col("times") * F.log10((n + ADDED) / F.lit(rest))).alias("score_rare"),
    )
    out = scored.join(rare, "row", "left").na.fill({"more": 0, "base_rare": 0.0, "score_rare": 0.0})
    return out.select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("n") - F.col("n_rare") + F.col("more")).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("base_rare")).alias("base_score"), (F.col("score") + F.col("score_rare")).alias("score"),
    )
