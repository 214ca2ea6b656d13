"""Language-model scores of whole documents: the attention model, and a unigram base over all training documents.

Counts, classes and attention weights come from all training documents. One pass over the texts gives their subwords
and, for each pass of a few megabytes, the distinct words with their
counts by document, packed in arrays and cut by ranges of the word hash. The ranges meet in tasks that hold the whole
corpus counts of their words, turn them into each document's share of the base score and send those shares back to
the passes; a range that very common words make large is dealt out over several tasks, counted in parts and added up. What is gathered grows with the corpus; no vocabulary is ever in one place. The number of ranges follows
the size of the texts, so a range holds a bounded share.

The pairs of subwords take the same way: each pass sends its distinct pairs with their training counts, and the ranges
send the corpus counts back, with the sums and kinds of each previous subword and class and the subwords' own counts,
tables bounded by the tokenizer's vocabulary that are merged in blocks and broadcast. No pair is left out. The classes
come from the same corpus counts of pairs.

The attention weights start from a few passes of texts and then see every place of every training document once, in
``ROUNDS`` rounds: in each, the tasks take steps over their passes from the same weights, and the weights that they
come to are averaged by the places behind them. The subwords kept by the first pass serve the fit and the scores.

Cases: a null text counts as empty, its only token is the end; repeated rows count and score each; a null doc_id
hashes as empty text; very long texts are scored whole, in windows; without training documents all counts are 0 and the base is finite; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .attention import CLASSES, CONTEXT, AttentionModel, Descent, alone_of, drawn, emission, grouped, neighbours, seen_often, steps_of
from .jaccard import groups_of, join_ids
from .samples import remainder, training_ids
from .shared import collect_garbage, written
from .textarrays import LOWER, SOLID, keep_top, passes, release, return_large
from .tokens import word_tokenizer

#: Bytes of text for each range of word hashes.
RANGE_BYTES = 24 << 20
#: Bytes of a range of words that one task holds; larger ranges are dealt out by chunk.
GROUP_BYTES = 64 << 20
#: Bytes of document shares a task holds before it hands them on.
HELD_BYTES = 16 << 20
DOCS = 4096
#: Bytes of text in one pass: words repeat within a pass, so a larger one sends fewer.
PASS = 3 << 19
#: Blocks in which the tables by previous subword and class are merged.
BLOCKS = 32
#: Rounds in which the attention weights see all training documents, and the rate of steps in the first; it falls to a fifth.
ROUNDS, RATE = 4, 0.003
#: Passes of texts from which the weights start.
START = 4
#: Spreads the keys of pairs over ranges; odd, so that no two keys meet.
ODD = 0x9E3779B97F4A7C15


def narrow(x: np.ndarray) -> bytes:
    """Unsigned numbers in the smallest type that holds them, their bytes by place, compressed; ``wide`` reads them."""
    if not len(x):
        return b""
    x = x.astype(np.min_scalar_type(int(x.max())))
    places = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(x).to_bytes(4, "little") + bytes([x.itemsize]) + pa.compress(places, codec="zstd", asbytes=True)


def wide(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.int64)
    n, size = int.from_bytes(raw[:4], "little"), raw[4]
    places = np.frombuffer(pa.decompress(raw[5:], n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(places.reshape(size, n).T).view(f"u{size}").reshape(-1).astype(np.int64)


def hashes_of(raw: bytes) -> np.ndarray:
    """Sorted hashes from their differences."""
    return np.cumsum(wide(raw).view(np.uint64), dtype=np.uint64)


@dataclass
class Pairs:
    """Keys of pairs of ids below ``vocab``: a bijection whose highest bits give the range."""

    vocab: int

    @property
    def half(self) -> int:
        return max(int(self.vocab - 1).bit_length(), 15)

    @property
    def mask(self) -> np.uint64:
        return np.uint64((1 << 2 * self.half) - 1)

    def keys(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return ((before.astype(np.uint64) << np.uint64(self.half) | ids.astype(np.uint64)) * np.uint64(ODD)) & self.mask

    def ids(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = ((keys.astype(np.uint64) * np.uint64(pow(ODD, -1, 1 << 64))) & self.mask).astype(np.int64)
        return k >> self.half, k & ((1 << self.half) - 1)


def paired(pairs: Pairs, given: np.ndarray, target: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs by key with their uses, and of each use the document it stands in; at most ``DOCS`` documents."""
    both = np.sort(pairs.keys(given, target) << np.uint64(12) | np.repeat(np.arange(len(counts), dtype=np.uint64), counts + 1))
    pair, where = both >> np.uint64(12), (both & np.uint64(4095)).astype(np.uint16)
    first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
    return pair[first], np.diff(np.append(first, len(both))), where


@dataclass
class Coded:
    """What one pass over the texts gives (``base``) and the counts of their pairs of subwords (``pairs``)."""

    base: DataFrame
    counted: DataFrame
    pairs: Pairs
    partitions: int
    idt: str
    seen: np.ndarray | None = None

    def freq(self) -> np.ndarray:
        """How often each subword stands in the training documents."""
        if self.seen is None:
            self.seen = gathered(self, all_of(lambda before, ids: ids), self.pairs.vocab)[0]
        return self.seen


def code_documents(documents: DataFrame, path: str, mod: int = 10, hold: int = 0) -> Coded:
    """Words, subwords and pairs of every row of ``documents``; rows of remainder ``hold`` are counted in none of them."""
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text", (remainder("doc_id", mod) == hold).alias("held"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    bits = max(3, int(np.ceil(np.log2(size / RANGE_BYTES)))) if size else 3
    bits = min(bits, 30)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    partitions = max(parts, min(1 << bits, 4 * parts))
    idt = documents.schema["doc_id"].dataType.simpleString()
    end = word_tokenizer(path).tokenizer.get_vocab_size()  # the end is an id of its own, beyond those of the tokenizer
    pairs = Pairs(end + 1)

    def describe(batches):
        return_large()
        tokenizer = word_tokenizer(path)
        part, serial = TaskContext.get().partitionId(), 0
        for batch, texts in passes(batches, size=PASS):
            s, e, owner = texts.words(SOLID)
            hashes = texts.hashes(s, e, LOWER)
            flat, counts = tokenizer.encode(texts, (s, e, owner))
            del s, e
            starts = np.concatenate(([0], np.cumsum(counts)))
            words = np.bincount(owner, minlength=len(texts))[: len(texts)]
            held = batch.column(2)
            for a in range(0, len(texts), DOCS):
                b = min(a + DOCS, len(texts))
                chunk, serial = part << 32 | serial, serial + 1
                flags = np.array(held.slice(a, b - a)).astype(np.uint8)
                lo, hi = np.searchsorted(owner, (a, b))
                h, back = np.unique(hashes[lo:hi], return_inverse=True)
                cell, times = np.unique(back * DOCS + (owner[lo:hi] - a), return_counts=True)
                which, doc = cell // DOCS, (cell % DOCS).astype(np.uint16)
                span = (h >> np.uint64(64 - bits)).astype(np.int64)
                at = np.flatnonzero(np.concatenate(([True], span[1:] != span[:-1]))) if len(span) else np.zeros(0, np.int64)
                ends = np.append(at[1:], len(h))
                cut = np.searchsorted(which, np.append(at, len(h)))
                per = np.bincount(which, minlength=len(h)).astype(np.uint16)
                own, lengths = flat[starts[a] : starts[b]], counts[a:b]
                pair, uses, where = paired(pairs, *steps_of(own.astype(np.int64), lengths, end), lengths)
                first = np.cumsum(uses) - uses
                train = np.add.reduceat((flags[where] == 0).astype(np.int64), first)
                zone = (pair >> np.uint64(2 * pairs.half - bits)).astype(np.int64)
                begin = np.flatnonzero(np.concatenate(([True], zone[1:] != zone[:-1])))
                zones = list(zip(begin, np.append(begin[1:], len(pair)), strict=True))
                n, m = len(at), len(zones)
                blank = [None] * m
                rows = {
                    "range": pa.array([*span[at].tolist(), *(-2 - zone[begin]).tolist(), -1], pa.int64()),
                    "chunk": pa.array([chunk] * (n + m + 1), pa.int64()),
                    "words": pa.array([*(narrow(np.diff(h[x:y], prepend=np.uint64(0))) for x, y in zip(at, ends, strict=True)), *(narrow(np.diff(pair[x:y], prepend=np.uint64(0))) for x, y in zones), None], pa.binary()),
                    "per": pa.array([*(per[x:y].tobytes() for x, y in zip(at, ends, strict=True)), *(narrow(train[x:y]) for x, y in zones), None], pa.binary()),
                    "docs": pa.array([*(narrow(doc[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)), *blank, None], pa.binary()),
                    "times": pa.array([*(narrow(times[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)), *blank, None], pa.binary()),
                    "held": pa.array([*[flags.tobytes()] * n, *blank, flags.tobytes()], pa.binary()),
                    "train_docs": pa.array([0] * (n + m) + [int((flags == 0).sum())], pa.int64()),
                    "ids": pa.array([None] * (n + m) + [batch.column(0).slice(a, b - a).to_pylist()], pa.list_(batch.schema.field(0).type)),
                    "n_words": pa.array([None] * (n + m) + [words[a:b]], pa.list_(pa.int64())),
                    "subwords": pa.array([None] * (n + m) + [narrow(own)], pa.binary()),
                    "lengths": pa.array([None] * (n + m) + [narrow(lengths)], pa.binary()),
                }
                yield pa.RecordBatch.from_pydict(rows)

    spec = f"range long, chunk long, words binary, per binary, docs binary, times binary, held binary, train_docs long, ids array<{idt}>, n_words array<long>, subwords binary, lengths binary"
    base = written(docs.mapInArrow(describe, spec), "lmwords")

    def count_pairs(batches):
        return_large()
        names = ["range", "chunk", "counts", "keys"]
        for t in groups_of(batches):
            ranges = t.column("range").to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], ranges[1:] != ranges[:-1])))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(ranges)), strict=True):
                keys = [np.cumsum(wide(x)) for x in t.column("words").slice(lo, hi - lo).to_pylist()]
                train = [wide(x) for x in t.column("per").slice(lo, hi - lo).to_pylist()]
                key, back = np.unique(np.concatenate(keys), return_inverse=True)
                c = np.bincount(back, weights=np.concatenate(train)).astype(np.int64)
                counts = [narrow(x) for x in np.split(c[back], np.cumsum([len(k) for k in keys])[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(ranges[lo:hi]), t.column("chunk").slice(lo, hi - lo).combine_chunks(), pa.array(counts, pa.binary()), pa.nulls(hi - lo, pa.binary())], names=names)
                whole = narrow(c[c > 0]), narrow(np.diff(key[c > 0], prepend=0))
                yield pa.RecordBatch.from_arrays([pa.array([ranges[lo]]), pa.array([None], pa.int64()), *(pa.array([x], pa.binary()) for x in whole)], names=names)

    rows = base.where("range < -1").select((-2 - F.col("range")).alias("range"), "chunk", "words", "per")
    ranged = rows.repartition(partitions, "range").sortWithinPartitions("range", "chunk")
    counted = written(ranged.mapInArrow(count_pairs, "range long, chunk long, counts binary, keys binary"), "lmpairs")
    return Coded(base, counted, pairs, partitions, idt)


def gathered(coded: Coded, cells, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and kinds of the corpus' distinct pairs by cell, below ``size``, a bound of the vocabulary alone.

    ``cells`` gives of (ids before, ids) which pairs count and their cells, as a list.
    """
    step = -(-size // BLOCKS)
    pairs = coded.pairs

    def pack(k, part, sums, kinds):
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), *(pa.array([narrow(x)], pa.binary()) for x in (part, sums, kinds))], names=["block", "cells", "sums", "kinds"])

    def add(batches):
        return_large()
        sums, kinds = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                c = wide(counts)
                for on, cell in cells(*pairs.ids(np.cumsum(wide(keys)))):
                    np.add.at(sums, cell, c[on])
                    np.add.at(kinds, cell, 1)
        full = np.flatnonzero(kinds)
        for k, part in enumerate(np.split(full, np.searchsorted(full, np.arange(1, BLOCKS) * step))):
            if len(part):
                yield pack(k, part, sums[part], kinds[part])

    def merge(batches):
        for t in groups_of(batches):
            blocks = t.column("block").to_numpy()
            for k in np.unique(blocks).tolist():
                sums, kinds = np.zeros(step, np.int64), np.zeros(step, np.int64)
                for row in np.flatnonzero(blocks == k).tolist():
                    at = wide(t.column("cells")[row].as_py()) - k * step
                    sums[at] += wide(t.column("sums")[row].as_py())
                    kinds[at] += wide(t.column("kinds")[row].as_py())
                at = np.flatnonzero(kinds)
                yield pack(k, at + k * step, sums[at], kinds[at])

    spec = "block long, cells binary, sums binary, kinds binary"
    added = coded.counted.where("chunk is null").select("keys", "counts").mapInArrow(add, spec)
    merged = added.repartition(min(coded.partitions, BLOCKS), "block").sortWithinPartitions("block").mapInArrow(merge, spec)
    sums, kinds = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for row in merged.toArrow().to_pylist():  # at most ``size`` cells
        at = wide(row["cells"])
        sums[at], kinds[at] = wide(row["sums"]), wide(row["kinds"])
    return sums, kinds


def all_of(cell):
    """For ``gathered``: every pair counts in the cell that ``cell`` gives."""
    return lambda before, ids: [(slice(None), cell(before, ids))]


def fit_attention(coded: Coded, seed: int = 5) -> AttentionModel:
    """Classes from the pairs of all training documents, and attention weights that have seen every place of them.

    The emissions are no part of this model: ``score_coded`` counts them over all training documents.
    """
    spark = coded.base.sparkSession
    vocab, end = coded.pairs.vocab, coded.pairs.vocab - 1
    rng = np.random.default_rng(seed)
    freq = coded.freq()
    top = seen_often(freq)
    x = gathered(coded, lambda before, ids: neighbours(before, ids, top, vocab), len(top) * 2 * (CONTEXT + 1))[0] if len(top) else np.zeros(0)
    klass = grouped(top, freq, x, vocab, rng)
    both = gathered(coded, all_of(lambda before, ids: klass[before] * CLASSES + klass[ids]), CLASSES * CLASSES)[0]
    row, p = drawn(freq, klass, both.reshape(CLASSES, CLASSES), rng)
    names = sorted(p)

    def fitted(heads: DataFrame, p: dict[str, np.ndarray], begin: bool, rate: float) -> tuple[dict[str, np.ndarray], int]:
        """Averages of the weights that the tasks come to from ``p``, and the places behind them."""
        held = spark.sparkContext.broadcast((p, row.astype(np.uint16), klass.astype(np.int16)))

        def places(batch, k):
            lengths, flags = wide(batch.column("lengths")[k].as_py()), np.frombuffer(batch.column("held")[k].as_py(), np.uint8)
            given, target = steps_of(wide(batch.column("subwords")[k].as_py()), lengths, end)
            on = np.repeat(flags == 0, lengths + 1)
            rows, klasses = held.value[1:]
            return rows[given[on]], klasses[given[on]], klasses[target[on]]

        def descend(batches):
            return_large()
            keep_top(64 << 20)
            fit, n, kept = Descent(held.value[0]), 0, []
            for batch in batches:
                for k in range(batch.num_rows):
                    got = places(batch, k)
                    n += len(got[0])
                    if begin:
                        kept.append(got)
                    else:
                        fit.once(*got, np.random.default_rng((seed, batch.column("chunk")[k].as_py())), rate)
            if kept:
                fit.start(*(np.concatenate(x) for x in zip(*kept, strict=True)), np.random.default_rng(seed))
            keep_top()
            release()
            if n:
                flat = np.concatenate([fit.p[c].reshape(-1) for c in names]).astype(float) * n
                for k, part in enumerate(np.array_split(flat, BLOCKS)):
                    yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int64()), "part": pa.array([TaskContext.get().partitionId()], pa.int64()), "n": pa.array([n], pa.int64()), "value": pa.array([part], pa.list_(pa.float64()))})

        def average(batches):
            for t in groups_of(batches):
                blocks = t.column("block").to_numpy()
                for k in np.unique(blocks).tolist():
                    at = np.flatnonzero(blocks == k).tolist()
                    total = sum(t.column("n")[j].as_py() for j in at)
                    value = sum(t.column("value").chunk(0)[j].values.to_numpy() for j in at) / total
                    yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int64()), "n": pa.array([total], pa.int64()), "value": pa.array([value], pa.list_(pa.float64()))})

        came = heads.mapInArrow(descend, "block long, part long, n long, value array<double>")
        merged = came.repartition(min(coded.partitions, BLOCKS), "block").sortWithinPartitions("block", "part").mapInArrow(average, "block long, n long, value array<double>")
        got = sorted(merged.toArrow().to_pylist(), key=lambda r: r["block"])  # the weights alone
        held.unpersist()
        if not got:
            return p, 0
        flat = np.concatenate([r["value"] for r in got]).astype(np.float32)
        cuts = np.cumsum([p[c].size for c in names])[:-1]
        return {c: x.reshape(p[c].shape) for c, x in zip(names, np.split(flat, cuts), strict=True)}, got[0]["n"]

    heads = coded.base.where("range = -1 and train_docs > 0").select("chunk", "held", "subwords", "lengths")
    begin = [r[0] for r in heads.select("chunk").orderBy(F.xxhash64("chunk"), "chunk").limit(START).collect()]
    p, _ = fitted(heads.where(F.col("chunk").isin(begin)).repartition(1).sortWithinPartitions("chunk"), p, True, 0.0)
    seen = 0
    for k in range(ROUNDS):
        turn = heads.where(F.pmod(F.xxhash64("chunk"), F.lit(ROUNDS)) == k)
        p, n = fitted(turn, p, False, RATE * (1 - 0.8 * k / max(ROUNDS - 1, 1)))
        seen += n
    return AttentionModel(p, row, klass, None, end, seen)


def train_lm(documents: DataFrame, path: str, limit: int | None = None, mod: int = 10, hold: int = 0) -> AttentionModel:
    """Classes and weights from all training documents, or from those of at most ``limit`` ids, in the order of their hash."""
    if limit is not None:
        ids = training_ids(documents.select("doc_id").distinct(), limit, mod, hold)
        documents = documents.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")
    return fit_attention(code_documents(documents, path, mod, hold))


def score_documents(documents: DataFrame, model: AttentionModel, path: str, mod: int = 10, hold: int = 0, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``documents``.

    Ranges of words of more than ``group_bytes`` are counted in parts.
    """
    return score_coded(code_documents(documents, path, mod, hold), model, group_bytes)


def score_coded(coded: Coded, model: AttentionModel, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """As ``score_documents``, of documents that are coded already."""
    base, counted, pairs, partitions, idt = coded.base, coded.counted, coded.pairs, coded.partitions, coded.idt
    spark = base.sparkSession
    vocab = pairs.vocab

    def entries(t, lo, hi):
        """Of rows ``lo`` to ``hi``: chunks, words, and of each row (documents of each word, how often, training counts)."""
        col = {c: t.column(c).slice(lo, hi - lo).to_pylist() for c in ("chunk", "words", "per", "docs", "times", "held")}
        words, parsed, seen = [hashes_of(x) for x in col["words"]], [], []
        for per, docs_, times, flags in zip(col["per"], col["docs"], col["times"], col["held"], strict=True):
            per, docs_, times, flags = np.frombuffer(per, np.uint16), wide(docs_), wide(times), np.frombuffer(flags, np.uint8)
            cuts = np.concatenate(([0], np.cumsum(per)))[:-1].astype(np.int64)
            seen.append(np.add.reduceat(times * (flags[docs_] == 0), cuts))
            parsed.append((per, docs_, times, len(flags)))
        return col["chunk"], words, parsed, seen

    def groups(t, key):
        keys = t.column(key).to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return zip(cuts.tolist(), np.append(cuts[1:], len(keys)).tolist(), strict=True)

    def count(batches):
        """Shares of chunks from groups of rows: whole ranges, which are counted here, or parts of one with its counts."""
        return_large()
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        size = 0
        tokens = distinct = 0

        def flush():
            nonlocal held, size, tokens, distinct
            keys = sorted(held)
            first = lambda n: pa.array(([n] + [0] * len(keys))[: max(len(keys), 1)], pa.int64())
            out = pa.RecordBatch.from_arrays([pa.array(keys or [None], pa.int64()), pa.array([held[k][0].tobytes() for k in keys] or [None], pa.binary()), pa.array([held[k][1].tobytes() for k in keys] or [None], pa.binary()), first(tokens), first(distinct)], names=["chunk", "share", "known", "tokens", "distinct"])
            held, size, tokens, distinct = {}, 0, 0, 0
            return out

        for t in groups_of(batches):
            for lo, hi in groups(t, "g"):
                table = next((k for k in range(lo, hi) if not t.column("chunk")[k].is_valid), None)
                if table is not None:  # it comes first: its chunk is null
                    known_words, known_counts = hashes_of(t.column("words")[table].as_py()), wide(t.column("per")[table].as_py())
                    if t.column("first")[table].as_py():
                        tokens, distinct = tokens + int(known_counts.sum()), distinct + int((known_counts > 0).sum())
                    lo += 1
                chunks, words, parsed, seen = entries(t, lo, hi)
                if not chunks:
                    continue
                if table is not None:
                    back, c = np.searchsorted(known_words, np.concatenate(words)), known_counts
                else:
                    _, back = np.unique(np.concatenate(words), return_inverse=True)
                    c = np.bincount(back, weights=np.concatenate(seen))
                    tokens, distinct = tokens + int(c.sum()), distinct + int((c > 0).sum())
                value = np.log10(c + 0.1)
                at = 0
                for chunk, w, (per, docs_, times, n) in zip(chunks, words, parsed, strict=True):
                    mine = np.repeat(back[at : at + len(w)], per)
                    at += len(w)
                    share = np.bincount(docs_, weights=times * value[mine], minlength=n)
                    known = np.bincount(docs_, weights=times * (c[mine] > 0), minlength=n).astype(np.int64)
                    if chunk in held:
                        held[chunk][0][:] += share
                        held[chunk][1][:] += known
                    else:
                        held[chunk] = (share, known)
                        size += 16 * n + 200
                if size > HELD_BYTES:
                    yield flush()
        if held or tokens:
            yield flush()

    def count_part(batches):
        """(range, words, counts) of parts of ranges."""
        return_large()
        for t in groups_of(batches):
            for lo, hi in groups(t, "g"):
                _, words, _, seen = entries(t, lo, hi)
                w, back = np.unique(np.concatenate(words), return_inverse=True)
                c = np.bincount(back, weights=np.concatenate(seen)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([t.column("range").slice(lo, 1).combine_chunks(), pa.array([narrow(np.diff(w, prepend=np.uint64(0)))], pa.binary()), pa.array([narrow(c)], pa.binary())], names=["range", "words", "counts"])

    def add_parts(batches):
        """The counts of whole ranges from those of their parts."""
        for t in groups_of(batches):
            for lo, hi in groups(t, "range"):
                w, back = np.unique(np.concatenate([hashes_of(x) for x in t.column("words").slice(lo, hi - lo).to_pylist()]), return_inverse=True)
                c = np.bincount(back, weights=np.concatenate([wide(x) for x in t.column("counts").slice(lo, hi - lo).to_pylist()])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([t.column("range").slice(lo, 1).combine_chunks(), pa.array([narrow(np.diff(w, prepend=np.uint64(0)))], pa.binary()), pa.array([narrow(c)], pa.binary())], names=["range", "words", "counts"])

    fields = ["range", "chunk", "words", "per", "docs", "times", "held"]
    rows = base.where("range >= 0").select(*fields)
    # A word that most documents hold makes its range large: ranges beyond a task's bytes are dealt out by chunk, their
    # words counted in parts, the parts added up, and the counts of the range sent back to each part.
    weight = F.octet_length("words") + F.octet_length("docs") + F.octet_length("times")
    large = rows.groupBy("range").agg(F.ceil(F.sum(weight.cast("long")) / group_bytes).cast("int").alias("salts")).where("salts > 1")
    large = written(large, "lmlarge")
    spread = lambda df: df.repartition(partitions, "g").sortWithinPartitions("g", F.col("chunk").asc_nulls_first())
    whole = join_ids(rows, large.select("range"), "range", "left_anti").withColumn("g", F.col("range")).withColumn("first", F.lit(None).cast("boolean"))
    order = ["g", "chunk", "words", "per", "docs", "times", "held", "first"]
    shares = spread(whole.select(*order)).mapInArrow(count, "chunk long, share binary, known binary, tokens long, distinct long")
    if not large.isEmpty():
        salt = F.pmod(F.xxhash64("chunk"), F.col("salts")).cast("int")
        part = join_ids(rows, large, "range", "inner").withColumn("salt", salt).withColumn("g", F.xxhash64("range", "salt"))
        parted = part.select("g", *fields).repartition(partitions, "g").sortWithinPartitions("g", "chunk").mapInArrow(count_part, "range long, words binary, counts binary")
        added = written(parted.repartition(partitions, "range").sortWithinPartitions("range").mapInArrow(add_parts, "range long, words binary, counts binary"), "lmadded")
        back = added.join(large, "range").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        none = [F.lit(None).cast("binary").alias(c) for c in ("docs", "times", "held")]
        back = back.select(F.xxhash64("range", "salt").alias("g"), F.lit(None).cast("long").alias("chunk"), "words", F.col("counts").alias("per"), *none, (F.col("salt") == 0).alias("first"))
        met = part.withColumn("first", F.lit(None).cast("boolean")).select(*order).unionByName(back)
        shares = shares.unionByName(spread(met).mapInArrow(count, "chunk long, share binary, known binary, tokens long, distinct long"))
    shares = written(shares, "lmshares")
    collect_garbage(spark, now=True)  # the words' shuffle is the largest of all

    cells = vocab * CLASSES
    klass = model.klass
    freq = coded.freq()
    sums, kinds = (x.astype(np.float32) for x in gathered(coded, all_of(lambda before, ids: before * CLASSES + klass[ids]), cells))
    model.tables()
    held_model = spark.sparkContext.broadcast(model)
    held_tables = spark.sparkContext.broadcast((alone_of(freq.astype(float), klass), sums, kinds))

    tokens, distinct = shares.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    train_docs = base.where("range = -1").agg(F.coalesce(F.sum("train_docs"), F.lit(0))).first()[0]
    total, kinds = tokens + train_docs, distinct + (train_docs > 0)
    norm = float(np.log10(total + 0.1 * (kinds + 1)))
    end = float(np.log10(train_docs + 0.1))

    def finish(batches):
        return_large()
        keep_top(64 << 20)  # the windows' arrays are used and freed hundreds of times a chunk
        alone, sums, kinds = held_tables.value
        lm = held_model.value
        for t in groups_of(batches):
            chunks = t.column(0).to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], chunks[1:] != chunks[:-1])))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(chunks)), strict=True):
                share = known = 0
                head = None
                found = {}
                for k in range(lo, hi):
                    if t.column("counts")[k].is_valid:
                        found[t.column("range")[k].as_py()] = wide(t.column("counts")[k].as_py())
                    elif t.column("share")[k].is_valid:
                        share = share + np.frombuffer(t.column("share")[k].as_py())
                        known = known + np.frombuffer(t.column("known")[k].as_py(), np.int64)
                    else:
                        head = k
                ids = t.column("ids").slice(head, 1).combine_chunks().flatten()
                n = t.column("n_words").slice(head, 1).combine_chunks().flatten().to_numpy() + 1
                flags = np.frombuffer(t.column("held")[head].as_py(), np.uint8) == 1
                zero = np.zeros(len(n))
                lengths = wide(t.column("lengths")[head].as_py())
                given, target = lm.steps(wide(t.column("subwords")[head].as_py()), lengths)
                # A chunk's pairs lie in the order of their ranges.
                pair, uses, where = paired(pairs, given, target, lengths)
                before, ids_ = pairs.ids(pair)
                count = np.concatenate([found[r] for r in sorted(found)]).astype(np.float32)
                cell = before * CLASSES + lm.klass[ids_]
                value = emission(count, alone[ids_], sums[cell], kinds[cell]) / np.log(10)
                score = lm.summed(given, target, lengths, np.zeros(len(target)))
                score += np.bincount(where, weights=np.repeat(value, uses), minlength=len(n))
                del given, target, pair, uses, where, before, ids_, count, cell, value
                release()  # what the windows took goes back before the next chunk
                yield pa.RecordBatch.from_arrays([ids, pa.array(flags), pa.array(n), pa.array((zero + known).astype(np.int64) + (train_docs > 0)), pa.array(np.full(len(n), total)), pa.array(zero + share + end - n * norm), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        keep_top()
        release()

    kept = {"chunk": "long", "range": "long", "counts": "binary", "share": "binary", "known": "binary", "held": "binary", "ids": f"array<{idt}>", "n_words": "array<long>", "subwords": "binary", "lengths": "binary"}
    take = lambda df, *have: df.select(*(c if c in have else F.lit(None).cast(kind).alias(c) for c, kind in kept.items()))
    collect_garbage(spark, now=True)
    heads = take(base.where("range = -1"), "chunk", "held", "ids", "n_words", "subwords", "lengths")
    back = take(counted.where("chunk is not null"), "chunk", "range", "counts")
    tails = take(shares.where("chunk is not null"), "chunk", "share", "known")
    met = heads.unionByName(back).unionByName(tails).repartition(partitions, "chunk").sortWithinPartitions("chunk")
    return met.mapInArrow(finish, f"doc_id {idt}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
