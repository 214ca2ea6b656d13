"""Best-fit packing of token pieces into sequences by a configuration linear program.

A configuration says how many pieces of each length share a sequence. The program over the length histogram (minimise
sequences, cover every length) is solved by multiplicative weights: each round prices a configuration by a bounded
knapsack over the capacity, gives it its share of the sequences, and lowers the weights of the lengths it covers. Each
round's weights also prove a lower bound. Where the sequences do not meet it, the weights go on as those of a basis of
configurations, with the same pricing, to the program's optimum. The fractional counts are rounded down and applied;
what is left goes, longest first, to the fullest sequence that still fits it, which may be one of the configurations,
or is packed by fullest sequences, or by search where it is little: the best of these stands. Where plain best fit over
the whole histogram needs fewer sequences than that, its plan is taken. All of it works on runs of equal sequences, at
any size alike, so its work depends on the histogram's lengths (at most ``size``) and not on the corpus; pieces find
their place by their rank within their length.

Cases: a null text counts as empty and is the end id alone; a null doc_id is an id like any other; a very long text is
tokenised whole and cut into full sequences but for its last piece; repeated rows are pieces of their own, and pieces
that agree in all they carry are interchangeable; only documents longer than a sequence are cut; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .textarrays import passes
from .tokens import word_tokenizer

SIZE = 2048


def price(lengths: np.ndarray, values: np.ndarray, most: np.ndarray, size: int) -> np.ndarray:
    """Counts of the configuration with the highest value: bounded knapsack by dynamic programming over the capacity."""
    best = np.zeros(size + 1)
    steps: list[tuple[int, int, np.ndarray]] = []
    for k in np.argsort(-lengths, kind="stable").tolist():
        length, left, block = int(lengths[k]), int(min(most[k], size // lengths[k])), 1
        while left > 0:
            take = min(block, left)
            left, block = left - take, block * 2
            w = take * length
            if w > size:
                break
            other = best[:-w] + take * values[k]
            better = other > best[w:] + 1e-15
            if better.any():
                best[w:][better] = other[better]
                steps.append((k, take, better))
    counts = np.zeros(len(lengths), np.int64)
    at = size
    for k, take, better in reversed(steps):
        w = take * int(lengths[k])
        if at >= w and better[at - w]:
            counts[k] += take
            at -= w
    return counts


def solve_lp(lengths: np.ndarray, need: np.ndarray, size: int, rounds: int, rate: float = 0.5) -> tuple[list[tuple[np.ndarray, float]], float]:
    """Configurations with fractional counts, and the best lower bound that the weights met on the way prove."""
    bins = float(lengths @ need) / size
    y = lengths / size
    covered = np.zeros(len(lengths))
    out, bound = [], bins
    for t in range(rounds):
        # No more of a length in one configuration than its share of all sequences calls for, and one at least.
        most = np.maximum(1, np.ceil(2 * need / max(bins, 1))).astype(np.int64)
        counts = price(lengths, y, np.minimum(most, need), size)
        if t % 8 == 0:
            # Weights over the value of the best configuration of all are a solution of the dual program.
            best = price(lengths, y, np.minimum(need, size // lengths), size)
            bound = max(bound, float(y @ need) / float(y @ best))
        x = bins / rounds
        out.append((counts, x))
        covered += counts * x / need
        y = lengths / size * np.exp(np.clip(rate * ((t + 1) / rounds - covered) * rounds / 8, -2.0, 2.0))
    return out, bound


Sequences = dict[tuple[tuple[int, int], ...], int]


def with_pieces(config: tuple[tuple[int, int], ...], length: int, many: int) -> tuple[tuple[int, int], ...]:
    """``config``, pieces of each length (descending) with their number, with more pieces of its shortest length or a shorter one."""
    return tuple(sorted((dict(config) | {length: dict(config).get(length, 0) + many}).items(), reverse=True))


def best_fit(left: dict[int, int], size: int, opened: Sequences | None = None) -> Sequences:
    """Sequences by best fit, longest pieces first, into those of ``opened`` and new ones; equal ones move together."""
    spaces: list[Sequences] = [{} for _ in range(size + 1)]
    for config, times in (opened or {}).items():
        spaces[size - sum(n * c for n, c in config)][config] = times
    for n in sorted(left, reverse=True):
        rest = left[n]
        s = n
        while rest > 0:
            while s <= size and not spaces[s]:
                s += 1
            # A sequence that takes a piece of this length is the best fit for the next ones until it is full.
            if s <= size:
                config, times = next(iter(spaces[s].items()))
                space = s
                del spaces[s][config]
            else:
                config, times, space = (), rest, size
            each = space // n
            full = min(times, rest // each)
            steps = [(full, each)] if full else []
            if full < times and rest > full * each:
                steps.append((1, rest - full * each))
            for many, pieces in steps:
                key, to = with_pieces(config, n, pieces), space - n * pieces
                spaces[to][key] = spaces[to].get(key, 0) + many
                rest -= many * pieces
                times -= many
            if times and config:
                spaces[space][config] = spaces[space].get(config, 0) + times
    out: Sequences = {}
    for some in spaces:
        for config, times in some.items():
            out[config] = out.get(config, 0) + times
    return out


def converge(lengths: np.ndarray, need: np.ndarray, size: int, work: float = 4e9) -> tuple[list[tuple[np.ndarray, float]], float]:
    """Configurations with fractional counts of the program's optimum, and the lower bound that its weights prove.

    The weights go on from a basis of one configuration a length: each step prices a configuration by the same knapsack
    and exchanges it for one of the basis, until no configuration is worth more than a sequence. ``work`` bounds the
    numbers that are touched; where it ends the steps, the bound still holds and the counts still cover every piece.
    """
    m, most = len(lengths), np.minimum(need, size // lengths)
    basis = [np.where(np.arange(m) == k, most[k], 0) for k in range(m)]
    inverse, x, bound = np.diag(1.0 / most), need / most, 0.0
    steps = int(min(20_000, max(20, work // (m * m + 8 * m * size))))
    for step in range(steps):
        if step % 200 == 199:  # rounding errors do not pile up
            inverse = np.linalg.inv(np.array(basis, float).T)
            x = np.maximum(inverse @ need, 0.0)
        y = inverse.sum(0)
        config = price(lengths, y, most, size)
        value = float(y @ config)
        bound = max(bound, float(y @ need) / max(value, 1.0))
        if value <= 1 + 1e-9:
            break
        d = inverse @ config
        rows = np.flatnonzero(d > 1e-9)
        out = rows[np.argmin(x[rows] / d[rows])]
        theta = x[out] / d[out]
        x = np.maximum(x - theta * d, 0.0)
        x[out], basis[out] = theta, config
        inverse[out] /= d[out]
        d[out] = 0.0
        inverse -= np.outer(d, inverse[out])
    return [(c, float(t)) for c, t in zip(basis, x, strict=True) if t > 1e-9], bound


#: Pieces that are placed by search, and the nodes that it opens.
SEARCHED, NODES = 40, 20_000


def search(left: dict[int, int], size: int, fewer_than: int) -> Sequences | None:
    """Sequences of a few pieces, fewer than the given number, by depth-first search; None where it finds none."""
    pieces = [n for n in sorted(left, reverse=True) for _ in range(left[n])]
    rest = np.concatenate((np.cumsum(pieces[::-1])[::-1], [0])) if pieces else np.zeros(1)
    bins: list[list[int]] = []
    best: list[list[int]] | None = None
    limit, nodes = fewer_than, 0

    def place(k: int, free: int) -> None:
        """Place the pieces from ``k`` on; ``free`` is the room in all opened sequences."""
        nonlocal best, limit, nodes
        nodes += 1
        if nodes > NODES or len(bins) + max(0, -(-int(rest[k] - free) // size)) >= limit:
            return
        if k == len(pieces):
            best, limit = [list(b) for b in bins], len(bins)
            return
        n, seen = pieces[k], set()
        for b in sorted(bins, key=sum, reverse=True):
            room = size - sum(b)
            if room >= n and room not in seen:
                seen.add(room)
                b.append(n)
                place(k + 1, free - n)
                b.pop()
        if len(bins) + 1 < limit:
            bins.append([n])
            place(k + 1, free + size - n)
            bins.pop()

    place(0, 0)
    if best is None:
        return None
    out: Sequences = {}
    for b in best:
        key = tuple((n, b.count(n)) for n in sorted(set(b), reverse=True))
        out[key] = out.get(key, 0) + 1
    return out


def merged(*parts: Sequences) -> Sequences:
    out: Sequences = {}
    for part in parts:
        for config, times in part.items():
            out[config] = out.get(config, 0) + times
    return out


def fullest(left: dict[int, int], size: int, most: int = 400) -> Sequences:
    """Sequences filled one after another as far as the pieces allow, by the knapsack; best fit beyond ``most`` steps."""
    left, out = dict(left), {}
    for _ in range(most):
        if not left:
            return out
        lengths = np.array(sorted(left, reverse=True))
        counts = price(lengths, lengths.astype(float), np.array([left[n] for n in lengths.tolist()]), size)
        key = tuple((int(n), int(c)) for n, c in zip(lengths, counts, strict=True) if c)
        times = min(left[n] // c for n, c in key)
        out[key] = out.get(key, 0) + times
        left = {n: r for n, c in left.items() if (r := c - dict(key).get(n, 0) * times) > 0}
    return merged(out, best_fit(left, size))


def rounded(configs: list[tuple[np.ndarray, float]], lengths: np.ndarray, need: np.ndarray, size: int, share: float) -> list[Sequences]:
    """Ways to round: whole counts of each configuration, and the rest by best fit into them, by fullest sequences or by search."""
    opened: Sequences = {}
    rest = need.copy()
    for counts, x in configs:
        on = counts > 0
        times = min(int(share * x + 1e-6), int((rest[on] // counts[on]).min())) if on.any() else 0
        if times > 0:
            key = tuple((int(n), int(c)) for n, c in zip(lengths[on], counts[on], strict=True))
            opened[key] = opened.get(key, 0) + times
            rest = rest - times * counts
    left = {int(n): int(c) for n, c in zip(lengths, rest, strict=True) if c > 0}
    out = [best_fit(left, size, opened)]
    if sum(left.values()) <= 4 * size:
        out.append(merged(opened, fullest(left, size)))
    if sum(left.values()) <= SEARCHED:
        found = search(left, size, min(sum(o.values()) for o in out) - sum(opened.values()))
        out += [merged(opened, found)] if found is not None else []
    return out


def by_program(histogram: dict[int, int], size: int, rounds: int, gap: float) -> tuple[Sequences, float]:
    """Sequences from the rounded program and best fit for the rest, and a lower bound.

    Rounds of multiplicative weights double from 32 to ``rounds`` until the sequences are within ``gap`` of the bound.
    Where they are not, the program is carried on to its optimum. Less of each configuration leaves more short pieces
    for the gaps; of all ways to round, the best one stands.
    """
    lengths = np.array(sorted(histogram, reverse=True))
    need = np.array([histogram[n] for n in lengths.tolist()])
    best, bound, many = None, 0.0, 32

    def near() -> bool:
        return sum(best.values()) <= np.ceil((1 + gap) * bound - 1e-6)

    def take(configs: list[tuple[np.ndarray, float]], shares: tuple[float, ...]) -> None:
        nonlocal best
        for share in shares:
            for found in rounded(configs, lengths, need, size, share):
                if best is None or sum(found.values()) < sum(best.values()):
                    best = found
            if near():
                return

    while True:
        configs, proved = solve_lp(lengths, need, size, many)
        bound = max(bound, proved)
        take(configs, (1.0, 0.9, 0.6))
        if many >= rounds or near():
            break
        many *= 2
    if not near():
        configs, proved = converge(lengths, need, size)
        bound = max(bound, proved)
        take(configs, (1.0, 0.98, 0.9, 0.75, 0.5, 0.0))
    return best, bound


@dataclass
class Run:
    """``times`` equal sequences from ``first`` on: pieces of each length (descending) with their number in a sequence."""

    first: int
    times: int
    parts: list[tuple[int, int]]


@dataclass
class Plan:
    """Runs of sequences, how many they are, the lower bound that the program proves, and whose sequences they are."""

    runs: list[Run]
    sequences: int
    bound: float
    method: str


def plan(histogram: dict[int, int], size: int = SIZE, rounds: int = 128, gap: float = 0.0) -> Plan:
    """Runs of sequences that hold exactly the pieces of the histogram."""
    left = {n: c for n, c in histogram.items() if c > 0}
    full = left.pop(size, 0)
    found, bound, method = {}, 0.0, "program"
    if left:
        found, bound = by_program(left, size, rounds, gap)
        plain = best_fit(left, size)
        if sum(plain.values()) < sum(found.values()):
            found, method = plain, "best fit"
    runs, at = [], 0
    for config, times in [*([(((size, 1),), full)] if full else []), *found.items()]:
        runs.append(Run(at, times, list(config)))
        at += times
    return Plan(runs, at, full + bound, method)


@dataclass
class Places:
    """Where the r-th piece of a length goes: sorted keys ``length << 44 | first rank`` with run, number and offset."""

    keys: np.ndarray
    first: np.ndarray
    each: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, runs: list[Run]) -> Places:
        ranks: dict[int, int] = {}
        rows = []
        for run in runs:
            offset = 0
            for n, c in run.parts:
                rows.append((n << 44 | ranks.get(n, 0), run.first, c, offset))
                ranks[n] = ranks.get(n, 0) + c * run.times
                offset += n * c
        cols = np.array(sorted(rows), np.int64).reshape(-1, 4).T
        return cls(*cols)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.keys, length << 44 | rank, side="right") - 1
        r = rank - (self.keys[k] & ((1 << 44) - 1))
        return self.first[k] + r // self.each[k], self.offset[k] + r % self.each[k] * length


def pieces(documents: DataFrame, path: str, size: int = SIZE, end: int = 0, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document, and its token ids if asked for."""

    def run(batches):
        tokenizer = word_tokenizer(path)
        for batch, texts in passes(batches):
            flat, n = tokenizer.encode(texts)
            n = n + 1
            last = np.cumsum(n) - 1
            out = np.full(int(n.sum()), end, np.uint32)
            out[np.delete(np.arange(len(out)), last)] = flat
            out = out.astype("<u4", copy=False)
            many = -(-n // size)
            row = np.repeat(np.arange(len(n)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * size
            length = np.minimum(size, n[row] - start)
            at = (last - n + 1)[row] + start
            view = memoryview(out).cast("B") if len(out) else memoryview(b"")
            crc = [zlib.crc32(view[4 * a : 4 * (a + b)]) for a, b in zip(at.tolist(), length.tolist(), strict=True)]
            cols = [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            if ids:
                cols.append(pa.array([out[a : a + b] for a, b in zip(at.tolist(), length.tolist(), strict=True)], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids])

    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * ids
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def pack(found: DataFrame, size: int = SIZE) -> DataFrame:
    """``found`` (doc_id, piece, start, length, ...) with sequence_id and offset; it must read the same each time."""
    n = found.count()
    salts = max(16, min(1024, n // 1_000_000))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(salts)).cast("int"))
    counts = np.zeros((size + 1, salts), np.int64)
    seen = salted.groupBy("length", "salt").agg(F.count("*").alias("c")).toArrow()  # at most size x salts rows of numbers
    counts[seen["length"].to_numpy(), seen["salt"].to_numpy()] = seen["c"].to_numpy()
    places = Places.of(plan({k: int(v) for k, v in enumerate(counts.sum(1).tolist()) if v}, size).runs)
    before = np.cumsum(counts, axis=1) - counts
    held = found.sparkSession.sparkContext.broadcast((places, before))
    # Rows that are equal in all of these differ in nothing that is packed, so a task that runs again places them alike.
    rank = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(rank).cast("long"))
    fields = found.schema.names

    def run(batches):
        places, before = held.value
        for batch in batches:
            t = dict(zip(batch.schema.names, batch.columns, strict=True))
            length, salt, rank = (t[c].to_numpy(zero_copy_only=False) for c in ("length", "salt", "rank"))
            seq, offset = places.find(length, before[length, salt] + rank - 1)
            yield pa.RecordBatch.from_arrays([*(t[c] for c in fields), pa.array(seq), pa.array(offset)], names=[*fields, "sequence_id", "offset"])

    return ranked.mapInArrow(run, found.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema)


def pack_documents(documents: DataFrame, path: str, size: int = SIZE, end: int = 0) -> DataFrame:
    """Every piece of every document with its digest, sequence and offset."""
    return pack(written(pieces(documents, path, size, end), "pieces"), size)
