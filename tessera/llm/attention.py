"""A causal self-attention language model over subword ids, trained and run in numpy.

The next subword is predicted through classes: attention over the window gives the class; the class and the subword
before give the subword by counts, smoothed with the counts of the class alone (Witten-Bell). Texts are scored in overlapping windows; every subword and the end are scored once, each with at
least ``WINDOW - STRIDE`` subwords of context where the text has them. ``Emission`` holds the counts of one stream in
memory; where they come from a whole corpus, ``lmscore`` adds them to the scores of the classes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WINDOW, STRIDE = 32, 24
CLASSES, FREQUENT, WIDTH, HIDDEN = 32, 2048, 16, 32
#: Frequent ids whose places beside an id give its class.
CONTEXT = 256
#: Slots of the table of subword pairs; of pairs that meet in a slot the most frequent one is kept.
SLOTS = 1 << 21
#: Windows that are scored together: their arrays stay in a core's cache.
TOGETHER = 128
ONES = np.ones((CLASSES, 1), np.float32)
MASK = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)


def beside(x: np.ndarray, value: float) -> np.ndarray:
    """Rows with ``value`` as one more column."""
    return np.concatenate([x, np.full((len(x), 1), value, x.dtype)], axis=1)


def seen_often(freq: np.ndarray, kept: int = 3000) -> np.ndarray:
    """The ids that classes are told apart for, most frequent first."""
    top = np.argsort(-freq, kind="stable")[:kept]
    return top[freq[top] >= 20]


def neighbours(before: np.ndarray, ids: np.ndarray, top: np.ndarray, vocab: int, context: int = CONTEXT) -> list[tuple[np.ndarray, np.ndarray]]:
    """Which pairs count, and their cell in a table of ids ``top`` by the frequent ids on their left and right."""
    row, col = np.full(vocab, -1), np.full(vocab, context)
    row[top], col[top[:context]] = np.arange(len(top)), np.arange(min(context, len(top)))
    wide, left, right = 2 * (context + 1), row[ids] >= 0, row[before] >= 0
    return [(left, row[ids[left]] * wide + col[before[left]]), (right, row[before[right]] * wide + context + 1 + col[ids[right]])]


def grouped(top: np.ndarray, freq: np.ndarray, x: np.ndarray, vocab: int, rng: np.random.Generator, k: int = CLASSES) -> np.ndarray:
    """Class of each id: k-means over the counts ``x`` of the neighbours of ids ``top``; class 0 holds the rest."""
    out = np.zeros(vocab, np.int64)
    if len(top) < k:
        out[top] = 1 + np.arange(len(top)) % (k - 1)
        return out
    x = x.reshape(len(top), -1).astype(float)
    x = np.sqrt(x / x.sum(1, keepdims=True))
    weight = freq[top].astype(float)
    centre = x[rng.choice(len(top), k - 1, replace=False, p=weight / weight.sum())]
    for _ in range(12):
        near = ((centre * centre).sum(1)[None] - 2 * x @ centre.T).argmin(1)
        for c in range(k - 1):
            on = near == c
            if on.any():
                centre[c] = np.average(x[on], axis=0, weights=weight[on])
    out[top] = 1 + near
    return out


def classes_of(ids: np.ndarray, vocab: int, rng: np.random.Generator, k: int = CLASSES, kept: int = 3000, context: int = CONTEXT) -> np.ndarray:
    """Classes by the neighbours of the ids of one stream in memory."""
    freq = np.bincount(ids, minlength=vocab)
    top = seen_often(freq, kept)
    x = np.zeros(len(top) * 2 * (context + 1))
    for _, cell in neighbours(ids[:-1], ids[1:], top, vocab, context):
        np.add.at(x, cell, 1)
    return grouped(top, freq, x, vocab, rng, k)


def slot_of(key: np.ndarray) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)


def emission(count: np.ndarray, alone: np.ndarray, sums: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """log P(id | class, previous id) of pairs by their counts and the sums and kinds of their previous id and class."""
    room = kinds + np.float32(0.5)
    return np.log((count + room * alone) / (sums + room)).astype(np.float64)


def alone_of(freq: np.ndarray, klass: np.ndarray) -> np.ndarray:
    """id -> P(id | class) from the counts of the ids."""
    freq = freq + 0.05
    return (freq / np.bincount(klass, weights=freq, minlength=CLASSES)[klass]).astype(np.float32)


@dataclass
class Emission:
    """P(id | class, previous id): kept pair counts over slots, and their sums and kinds by previous id and class."""

    klass: np.ndarray
    alone: np.ndarray  # id -> P(id | class)
    keys: np.ndarray
    counts: np.ndarray
    sums: np.ndarray
    kinds: np.ndarray

    @classmethod
    def of(cls, stream: np.ndarray, klass: np.ndarray, vocab: int) -> Emission:
        alone = alone_of(np.bincount(stream[1:], minlength=vocab), klass)
        key, times = np.unique(stream[:-1] * vocab + stream[1:], return_counts=True)
        order = np.argsort(times, kind="stable")  # the last one written to a slot stays
        slot = slot_of(key)
        keys, counts = np.full(SLOTS, -1), np.zeros(SLOTS, np.float32)
        keys[slot[order]] = key[order]
        counts[slot[order]] = times[order]
        kept = np.flatnonzero(keys >= 0)
        cell = keys[kept] // vocab * CLASSES + klass[keys[kept] % vocab]
        sums = np.bincount(cell, weights=counts[kept], minlength=vocab * CLASSES).astype(np.float32)
        kinds = np.bincount(cell, minlength=vocab * CLASSES).astype(np.float32)
        return cls(klass, alone, keys, counts, sums, kinds)

    def log(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        key = before * len(self.klass) + ids
        slot = slot_of(key)
        count = np.where(self.keys[slot] == key, self.counts[slot], np.float32(0))
        cell = before * CLASSES + self.klass[ids]
        return emission(count, self.alone[ids], self.sums[cell], self.kinds[cell])


def steps_of(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The id before and the id of every subword and end of all texts."""
    n = counts + 1
    total = int(n.sum())
    last = np.cumsum(n) - 1
    target = np.full(total, end, np.int64)
    inner = np.ones(total, bool)
    inner[last] = False
    target[inner] = ids
    given = np.empty(total, np.int64)
    given[1:] = target[:-1]
    given[last - n + 1] = end
    return given, target


@dataclass
class AttentionModel:
    p: dict[str, np.ndarray]
    row: np.ndarray  # id -> row of the input table
    klass: np.ndarray  # id -> class
    emit: Emission | None
    end: int
    trained: int = 0  # places that the weights were fitted on, each once, after their start
    _tables: dict[str, np.ndarray] | None = None

    def steps(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The id before and the id of every subword and end of all texts."""
        return steps_of(ids, counts, self.end)

    def score(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 probability of each text, its end included; ``ids`` holds all texts' ids one after another."""
        given, target = self.steps(ids, counts)
        return self.summed(given, target, counts, self.emit.log(given, target))

    def tables(self) -> dict[str, np.ndarray]:
        """What scoring reads of the parameters, multiplied out once: inputs, with a 1 beside them, and queries, brought
        to where they meet the inputs, of every input row and every place; values by the output; ``b1`` as a row of ``W1``."""
        if self._tables is None:
            p = self.p
            among = p["Q"] @ p["K"].T * np.float32(WIDTH**-0.5)
            out = {"x": beside(p["E"], 1), "x_at": beside(p["P"], 0), "q": p["E"] @ among, "q_at": p["P"] @ among, "mixed": np.pad(p["V"] @ p["O"], (0, 1))}
            out["W1"] = np.concatenate([p["W1"], p["b1"][None]])
            out["U"] = np.concatenate([p["U"], np.zeros((1, CLASSES), np.float32), p["W2"] @ p["U"]])
            self._tables = out
        return self._tables

    def logits(self, rows: np.ndarray, first: int) -> np.ndarray:
        """Class scores, without the class before, at the places from ``first`` on of windows (m, WINDOW) of input rows."""
        t = self.tables()
        x = np.take(t["x"], rows, axis=0)
        x += t["x_at"]
        q = np.take(t["q"], rows[:, first:], axis=0)
        q += t["q_at"][first:]
        s = q @ x[:, :, :WIDTH].transpose(0, 2, 1)
        np.clip(s, -60, 30, out=s)  # no row of weights vanishes
        s += MASK[first:]
        np.exp(s, out=s)
        c = s @ x  # the last column is the weight of all places
        c *= 1 / c[:, :, WIDTH:]
        both = np.empty((*c.shape[:2], WIDTH + 1 + HIDDEN), np.float32)
        np.matmul(c, t["mixed"], out=both[:, :, : WIDTH + 1])
        both[:, :, : WIDTH + 1] += x[:, first:]
        both = both.reshape(-1, WIDTH + 1 + HIDDEN)
        z = both[:, WIDTH + 1 :]
        np.matmul(both[:, : WIDTH + 1], t["W1"], out=z)
        np.maximum(z, 0, out=z)
        return both @ t["U"]

    def summed(self, given: np.ndarray, target: np.ndarray, counts: np.ndarray, got: np.ndarray) -> np.ndarray:
        """log10 probability of each text's classes, with ``got`` (natural logarithms by step) added."""
        n, total = counts + 1, len(target)
        last = np.cumsum(n) - 1
        klass, before = self.klass[target], self.klass[given]
        many = 1 + -(-np.maximum(n - WINDOW, 0) // STRIDE)
        doc = np.repeat(np.arange(len(n)), many)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        start, stop = (last - n + 1)[doc] + k * STRIDE, last[doc] + 1
        inputs = self.row[given].astype(np.int32)
        # The first window of a text scores all of its places, later ones only those that no window before them has scored.
        for some, first in ((k == 0, 0), (k > 0, WINDOW - STRIDE)):
            begin, end = start[some], stop[some]
            for a in range(0, len(begin), TOGETHER):
                at = begin[a : a + TOGETHER, None] + np.arange(WINDOW)
                need = at[:, first:] < end[a : a + TOGETHER, None]
                flat = at[:, first:][need]
                logits = self.logits(inputs[np.minimum(at, total - 1)], first)
                logits = logits if need.all() else logits[need.ravel()]
                logits += np.take(self.p["B"], before[flat], axis=0)
                own = logits[np.arange(len(flat)), klass[flat]]
                with np.errstate(over="ignore"):
                    weight = (np.exp(logits) @ ONES)[:, 0]
                if weight.min(initial=1.0) < 1e-30 or weight.max(initial=1.0) > 1e34:  # beyond what single precision holds as it is
                    top = logits.max(1)
                    got[flat] += own - top - np.log(np.exp(logits - top[:, None]).sum(1))
                else:
                    got[flat] += own - np.log(weight)
        return np.add.reduceat(got, last - n + 1) / np.log(10) if len(n) else np.zeros(0)


def forward(p: dict[str, np.ndarray], rows: np.ndarray):
    """Hidden states of windows (m, WINDOW) of input rows, and what the backward pass needs."""
    x = p["E"][rows] + p["P"]
    q, k, v = x @ p["Q"], x @ p["K"], x @ p["V"]
    s = q @ k.transpose(0, 2, 1)
    s *= np.float32(WIDTH**-0.5)
    np.clip(s, -60, 30, out=s)  # no row of weights vanishes
    s += MASK
    np.exp(s, out=s)
    s /= s.sum(2, keepdims=True)
    c = s @ v
    y = x + c @ p["O"]
    z = np.maximum(y @ p["W1"] + p["b1"], 0)
    return y + z @ p["W2"], (x, q, k, v, s, c, y, z)


def backward(p, rows, h, kept, gh) -> dict[str, np.ndarray]:
    x, q, k, v, s, c, y, z = kept
    g = {}
    mat = lambda a, b: np.tensordot(a, b, axes=((0, 1), (0, 1)))
    g["W2"] = mat(z, gh)
    gz = (gh @ p["W2"].T) * (z > 0)
    g["W1"], g["b1"] = mat(y, gz), gz.sum((0, 1))
    gy = gh + gz @ p["W1"].T
    g["O"] = mat(c, gy)
    gc = gy @ p["O"].T
    gv = s.transpose(0, 2, 1) @ gc
    gs = gc @ v.transpose(0, 2, 1)
    gs = s * (gs - (gs * s).sum(2, keepdims=True)) * np.float32(WIDTH**-0.5)
    gq, gk = gs @ k, gs.transpose(0, 2, 1) @ q
    g["Q"], g["K"], g["V"] = mat(x, gq), mat(x, gk), mat(x, gv)
    gx = gy + gq @ p["Q"].T + gk @ p["K"].T + gv @ p["V"].T
    g["P"] = gx.sum(0)
    g["E"] = np.zeros_like(p["E"])
    np.add.at(g["E"], rows.reshape(-1), gx.reshape(-1, WIDTH))
    return g


def drawn(freq: np.ndarray, klass: np.ndarray, pairs: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Input rows of the ids, and weights before any fit; those by the class before come from the counts of class pairs."""
    top = np.argsort(-freq, kind="stable")[:FREQUENT]
    row = FREQUENT + klass
    row[top] = np.arange(len(top))
    pairs = pairs + 0.5
    draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    return row, {"E": draw(FREQUENT + CLASSES, WIDTH), "P": draw(WINDOW, WIDTH), "Q": draw(WIDTH, WIDTH), "K": draw(WIDTH, WIDTH), "V": draw(WIDTH, WIDTH), "O": draw(WIDTH, WIDTH), "W1": draw(WIDTH, HIDDEN), "b1": np.zeros(HIDDEN, np.float32), "W2": draw(HIDDEN, WIDTH), "U": draw(WIDTH, CLASSES), "B": np.log(pairs / pairs.sum(1, keepdims=True)).astype(np.float32)}


def by_row(x: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``x`` by row of a table of ``n``."""
    order = np.argsort(rows, kind="stable")
    at = rows[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    out = np.zeros((n, x.shape[1]), x.dtype)
    out[at[first]] = np.add.reduceat(np.take(x, order, axis=0), first, axis=0)
    return out


def gradients(p: dict[str, np.ndarray], rows: np.ndarray, before: np.ndarray, goal: np.ndarray, on: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean loss of windows (m, WINDOW) of input rows; ``before``, ``goal`` and ``on`` are the class
    before, the class and the weight of each place. The same as ``backward``, in single precision and fewer passes: queries
    meet keys, and values the output, through products of their weights; a last column of 1 stands beside the inputs, so
    that weights of places are summed with the values and ``b1`` is a row of ``W1``."""
    m, n = len(rows), rows.size
    scale = np.float32(WIDTH**-0.5)
    among, mixed = p["Q"] @ p["K"].T * scale, p["V"] @ p["O"]
    rows = rows.reshape(-1)
    x = np.take(beside(p["E"], 1), rows, axis=0)
    inputs = x.reshape(m, WINDOW, WIDTH + 1)
    inputs += beside(p["P"], 0)
    plain = inputs[:, :, :WIDTH]
    s = (x[:, :WIDTH] @ among).reshape(m, WINDOW, WIDTH) @ plain.transpose(0, 2, 1)
    np.clip(s, -60, 30, out=s)  # no row of weights vanishes
    s += MASK
    np.exp(s, out=s)
    c = (s @ inputs).reshape(n, WIDTH + 1)
    share = 1 / c[:, WIDTH:]
    c *= share
    y = c @ np.pad(mixed, (0, 1))
    y += x
    z = y @ np.concatenate([p["W1"], p["b1"][None]])
    np.maximum(z, 0, out=z)
    h = z @ p["W2"]
    h += y[:, :WIDTH]
    e = h @ p["U"]
    e += np.take(p["B"], before, axis=0)
    np.clip(e, -80, 80, out=e)
    np.exp(e, out=e)
    on = (on / on.sum()).astype(np.float32)
    e *= (on / (e @ ONES)[:, 0])[:, None]
    e.reshape(-1)[np.arange(0, n * CLASSES, CLASSES) + goal] -= on
    g = {"U": h.T @ e, "B": by_row(e, before, CLASSES)}
    gh = e @ p["U"].T
    g["W2"] = z.T @ gh
    gz = gh @ p["W2"].T
    gz *= z > 0
    gw = y.T @ gz
    g["W1"], g["b1"] = gw[:WIDTH], gw[WIDTH]
    gy = gz @ p["W1"].T
    gy += gh
    gm = (c.T @ gy)[:WIDTH]
    g["V"], g["O"] = gm @ p["O"].T, p["V"].T @ gm
    gc = np.empty_like(c)
    np.matmul(gy, mixed.T, out=gc[:, :WIDTH])
    np.negative(np.einsum("ij,ij->i", gc[:, :WIDTH], c[:, :WIDTH]), out=gc[:, WIDTH])
    gc *= share
    gc = gc.reshape(m, WINDOW, WIDTH + 1)
    gs = gc @ inputs.transpose(0, 2, 1)
    gs *= s
    met = np.empty((m, WINDOW, 2 * WIDTH), np.float32)
    np.matmul(gs, plain, out=met[:, :, :WIDTH])
    np.matmul(gs.transpose(0, 2, 1), plain, out=met[:, :, WIDTH:])
    met = met.reshape(n, 2 * WIDTH)
    ga = x[:, :WIDTH].T @ met[:, :WIDTH] * scale
    g["Q"], g["K"] = ga @ p["K"], ga.T @ p["Q"]
    gx = met @ np.concatenate([among.T, among])
    gx += gy
    gx.reshape(m, WINDOW, WIDTH)[:] += s.transpose(0, 2, 1) @ gc[:, :, :WIDTH]
    g["P"] = gx.reshape(m, WINDOW, WIDTH).sum(0)
    g["E"] = by_row(gx, rows, len(p["E"]))
    return g


class Descent:
    """Weights that take steps by gradients with running moments."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.cuts = np.cumsum([0, *(v.size for v in p.values())])
        self.flat = np.concatenate([v.reshape(-1) for v in p.values()])
        self.p = {k: self.flat[a:b].reshape(v.shape) for (k, v), a, b in zip(p.items(), self.cuts, self.cuts[1:])}
        self.m, self.s, self.g, self.room = (np.zeros_like(self.flat) for _ in range(4))
        self.t = 0

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        for k, a, b in zip(self.p, self.cuts, self.cuts[1:]):
            self.g[a:b] = g[k].reshape(-1)
        m, s, x, room = self.m, self.s, self.g, self.room
        m *= 0.9
        m += np.multiply(x, 0.1, out=room)
        s *= 0.99
        x *= x
        x *= 0.01
        s += x
        np.multiply(s, 1 / (1 - 0.99**self.t), out=x)
        np.sqrt(x, out=x)
        x += 1e-6
        np.multiply(m, rate / (1 - 0.9**self.t), out=room)
        room /= x
        self.flat -= room

    def start(self, rows: np.ndarray, before: np.ndarray, goal: np.ndarray, rng: np.random.Generator, steps: int = 400, batch: int = 128, rate: float = 0.01) -> None:
        """Steps on windows that start anywhere in the places given."""
        room = len(rows) - WINDOW
        for t in range(1, steps + 1 if room > 0 else 1):
            at = rng.integers(0, room, batch)[:, None] + np.arange(WINDOW)
            g = gradients(self.p, rows[at], before[at].reshape(-1), goal[at].reshape(-1), np.ones(at.size, np.float32))
            self.step(g, rate * min(1, t / 20) * (1 - 0.9 * t / steps))

    def once(self, rows: np.ndarray, before: np.ndarray, goal: np.ndarray, rng: np.random.Generator, rate: float, batch: int = 128) -> None:
        """Steps on windows side by side that hold each of the places once; the last one is filled up with weight 0."""
        n = len(rows)
        if not n:
            return
        fill = -n % WINDOW
        on = np.concatenate([np.ones(n, np.float32), np.zeros(fill, np.float32)]).reshape(-1, WINDOW)
        rows, before, goal = (np.concatenate([x, np.repeat(x[-1:], fill)]).reshape(-1, WINDOW) for x in (rows, before, goal))
        order = rng.permutation(len(rows))
        for a in range(0, len(order), batch):
            at = order[a : a + batch]
            g = gradients(self.p, rows[at], before[at].reshape(-1), goal[at].reshape(-1), on[at].reshape(-1))
            self.step(g, rate * min(1, len(at) / batch))


def train_attention(ids: np.ndarray, counts: np.ndarray, vocab: int, end: int, steps: int = 400, batch: int = 128, rate: float = 0.01, seed: int = 5, emissions: bool = True) -> AttentionModel:
    """Fit on whole sampled texts: windows start anywhere in them; ``emissions`` of these texts only if asked for."""
    rng = np.random.default_rng(seed)
    n = counts + 1
    last = np.cumsum(n) - 1
    stream = np.full(int(n.sum()) + 1, end, np.int64)
    inner = np.ones(len(stream) - 1, bool)
    inner[last] = False
    stream[1:][inner] = ids
    klass = classes_of(stream, vocab, rng)
    freq = np.bincount(stream[1:], minlength=vocab)
    emit = Emission.of(stream, klass, vocab) if emissions else None
    pairs = np.zeros((CLASSES, CLASSES))
    np.add.at(pairs, (klass[stream[:-1]], klass[stream[1:]]), 1)
    row, p = drawn(freq, klass, pairs, rng)
    fit = Descent(p)
    fit.start(row[stream[:-1]], klass[stream[:-1]], klass[stream[1:]], rng, steps, batch, rate)
    return AttentionModel(fit.p, row, klass, emit, end)
