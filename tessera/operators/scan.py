"""The best rows of a table for a block of questions, found inside the scan.

A task multiplies its rows with all questions of a block, batch after batch, and keeps no more than k rows for each
question; what leaves a task grows with k and the questions, never with the table. Questions travel with the plan in
blocks of bounded size. Rows carry what the signals need: sparse vectors (``{signal}_t`` sorted term hashes and
``{signal}_w`` weights) or dense ones (``{signal}_v``), and the token hashes of their service's titles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import fixed
from ..functions.text import tokenize
from ..storage import stored

#: Questions whose vectors travel with one plan, those that are multiplied together, and products that one step holds.
PLAN_QUESTIONS = 2048
PLAN_BYTES = 32 << 20
TOGETHER = 256
STEP = 1 << 21
#: Rows that are multiplied together with them.
ROWS = 2048
#: Cells of a whole matrix for each entry up to which it is multiplied as such.
DENSE = 8


# --- the k best of each question -------------------------------------------------------------------------------------------


def _ranks(values: list) -> np.ndarray:
    """The place of each value in ascending order, nulls last; equal values share one."""
    known = sorted({v for v in values if v is not None})
    place = {v: i for i, v in enumerate(known)} | {None: len(known)}
    return np.array([place[v] for v in values], np.int64)


class Best:
    """The k best rows of each group, by falling score and then key; ``tag`` and ``more`` are further columns.

    With ``once`` a key stands once in a group: by its row with the largest first column of ``more``, then tag.
    """

    def __init__(self, k: int, more: int = 0, once: bool = False):
        self.k, self.once = k, once
        self.group, self.score, self.key, self.tag, self.more = np.zeros(0, np.int64), np.zeros(0), [], [], [np.zeros(0) for _ in range(more)]

    def add(self, group: np.ndarray, score: np.ndarray, key: list, tag: list | None = None, *more: np.ndarray) -> None:
        group, score, key, tag = np.concatenate((self.group, group)), np.concatenate((self.score, score)), [*self.key, *key], [*self.tag, *(tag or [None] * len(key))]
        more = [np.concatenate(c) for c in zip(self.more, more, strict=True)]
        rank = _ranks(key)
        on = np.arange(len(key))
        if self.once:
            order = np.lexsort((-_ranks(tag), -more[0], rank, group))
            g, r = group[order], rank[order]
            on = order[np.concatenate(([True], (g[1:] != g[:-1]) | (r[1:] != r[:-1])))] if len(order) else order
        order = on[np.lexsort((rank[on], -score[on], group[on]))]
        on = order[np.arange(len(order)) - np.searchsorted(group[order], group[order]) < self.k]
        self.group, self.score, self.key, self.tag, self.more = group[on], score[on], [key[i] for i in on.tolist()], [tag[i] for i in on.tolist()], [c[on] for c in more]


def _columns(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(column, row) of the k best finite scores of each column; earlier rows first where they are equal."""
    order = np.argsort(-score, axis=0, kind="stable")[:k]
    column = np.broadcast_to(np.arange(score.shape[1]), order.shape)
    on = np.isfinite(np.take_along_axis(score, order, 0))
    return column[on], order[on]


def _blocks(queries: DataFrame, size: str) -> list[DataFrame]:
    """``queries`` in parts whose vectors (``size`` bytes by an SQL expression) a plan can carry."""
    n, total = queries.agg(F.count("*"), F.coalesce(F.sum(F.expr(size)), F.lit(0))).first()
    parts = max(-(-n // PLAN_QUESTIONS), -(-int(total) // PLAN_BYTES), 1)
    return [queries if parts == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == b) for b in range(parts)]


# --- dense vectors ---------------------------------------------------------------------------------------------------------


def _matrix(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that have ``dims`` components without nulls, and those rows."""
    start, values = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False).astype(float)
    at = np.flatnonzero((np.diff(start) == dims) & vectors.is_valid().to_numpy(zero_copy_only=False))
    rows = values[start[:-1][at][:, None] + np.arange(dims)] if len(at) else np.zeros((0, dims))
    whole = ~np.isnan(rows).any(1)
    return at[whole], rows[whole]


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(1, keepdims=True))
    return np.divide(rows, norm, out=np.full_like(rows, np.nan), where=norm > 0)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, key: str = "chunk_id", cosine: bool = False, digits: int | None = None) -> DataFrame:
    """(query_id, key, score, rank): the k best rows (key, vec) of every question (query_id, qvec), ties by key.

    With ``digits``, scores are rounded before they are compared. Rows of another length than the question's vector, or
    with null or NaN components, are not compared; with ``cosine`` neither are those of length 0. Null keys stand last.
    """
    kinds = [(queries.schema["query_id"].dataType), vectors.schema[key].dataType]
    shape = f"query_id {kinds[0].simpleString()}, key {kinds[1].simpleString()}, score double"
    id_type, key_type = (to_arrow_type(t) for t in kinds)
    out = None
    for part in _blocks(queries.where("qvec is not null"), "8L * size(qvec)"):
        own = [(r.query_id, r.qvec) for r in part.select("query_id", "qvec").collect() if not any(x is None for x in r.qvec)]
        for dims in {len(v) for _, v in own}:
            ids = [i for i, v in own if len(v) == dims]
            matrix = np.array([v for _, v in own if len(v) == dims], float).reshape(len(ids), dims)
            matrix = _unit(matrix) if cosine else matrix

            def run(batches: Iterator[pa.RecordBatch], ids=ids, matrix=matrix, dims=dims) -> Iterator[pa.RecordBatch]:
                best, step = Best(k), max(1, STEP // max(len(ids), dims, 1))
                for batch in batches:
                    at, rows = _matrix(batch.column(1), dims)
                    names = batch.column(0).take(pa.array(at)).to_pylist()
                    order = np.argsort(_ranks(names), kind="stable")
                    for lo in range(0, len(at), step):
                        own = order[lo : lo + step]
                        x = _unit(rows[own]) if cosine else rows[own]
                        s = x @ matrix.T
                        s = np.where(np.isnan(s), -np.inf, s if digits is None else np.round(s, digits))
                        q, r = _columns(s, k)
                        best.add(q, s[r, q], [names[i] for i in own[r].tolist()])
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in best.group.tolist()], id_type), pa.array(best.key, key_type), pa.array(best.score)], names=["query_id", "key", "score"])

            found = vectors.select(key, "vec").mapInArrow(run, shape)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = queries.select("query_id").limit(0).select("query_id", F.lit(None).cast(kinds[1]).alias("key"), F.lit(0.0).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumnRenamed("key", key)


# --- weighted signals ------------------------------------------------------------------------------------------------------


def _of(name: str):
    return lambda x: x["s"] == name


def signal_rows(chunks: DataFrame, signals: dict[str, DataFrame], titles: DataFrame | None = None) -> DataFrame:
    """``chunks`` (chunk_id, service_id, ...) with ``{signal}_t`` and ``{signal}_w`` of each signal (chunk_id, term, w), and ``titles``.

    Signals meet in one aggregation by chunk. ``titles`` is (service_id, title), one row a variant; a service's title
    tokens are kept as arrays of hashes.
    """
    rows = None
    for name, df in signals.items():
        one = df.select("chunk_id", F.lit(name).alias("s"), F.xxhash64(F.col("term").cast("string")).alias("t"), F.col("w").cast("double").alias("w"))
        rows = one if rows is None else rows.unionByName(one)
    per = rows.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("s", "t", "w"))).alias("all"))
    for name in signals:
        own = F.filter("all", _of(name))
        per = per.withColumn(f"{name}_t", F.transform(own, lambda x: x["t"])).withColumn(f"{name}_w", F.transform(own, lambda x: x["w"]))
    out = chunks.join(per.drop("all"), "chunk_id", "left")
    if titles is None:
        return out.withColumn("titles", F.array().cast("array<array<bigint>>"))
    return out.join(title_tokens(titles), "service_id", "left")


def title_tokens(titles: DataFrame) -> DataFrame:
    """(service_id, titles): the token hashes of each title variant (service_id, title) of a service."""
    tokens = titles.select("service_id", F.array_sort(F.array_distinct(tokenize(F.col("title")))).alias("t")).where(F.size("t") > 0).distinct()
    return tokens.groupBy("service_id").agg(F.collect_list(F.transform("t", lambda x: F.xxhash64(x))).alias("titles"))


#: Rows whose terms are counted together.
COUNTED = 512
#: N-grams whose rows a task counts before it passes them on.
GRAMS_HELD = 2_000_000


def _mixed(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A 64-bit hash carried on by one more character (splitmix)."""
    h = h + c + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Grams:
    """Character n-grams (as 64-bit hashes) and trigram buckets of normalised texts, the same as ``char_ngrams`` and ``trigram_buckets`` cut.

    The words of a normalised text have one space between them, so the n-grams of its padded words are those stretches
    of the padded text that hold no space inside. All texts of a batch are cut together.
    """

    def __init__(self):
        self.known, self.bucket = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # trigrams seen and their buckets

    def cut(self, rows: list, buckets: bool = True) -> tuple[np.ndarray, ...]:
        """(row, hash) of the n-grams in order, one after another for each place, and (row, bucket) of the trigrams."""
        each = [(r, f" {t} ") for r, texts in enumerate(rows) for t in texts or ()]
        whole = "".join(t for _, t in each)
        sizes = np.array([len(t) for _, t in each], np.int64)
        owner = np.array([r for r, _ in each], np.int64)
        row = np.repeat(owner, sizes)
        c = np.frombuffer(whole.encode("utf-32-le"), np.uint32).astype(np.uint64)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(c))  # characters up to the end of the text
        h, inside, found = np.zeros(len(c), np.uint64), np.ones(len(c), bool), []
        for n in range(1, 6):
            h = _mixed(h[: max(len(c) - n + 1, 0)], c[n - 1 :])
            if n >= 3:
                inside = inside[: len(h)] & (c[n - 2 : n - 2 + len(h)] != 32)
                on = np.flatnonzero(inside & (left[: len(h)] >= n))
                found.append((row[on], h[on]))
            if n == 3 and buckets:
                on = np.flatnonzero(left[: len(h)] >= 3)
                tri = row[on], self._buckets(h[on], on, whole)
        gram_row, gram = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(gram_row.astype(np.uint32), kind="stable")
        gram_row, gram = gram_row[order], gram[order].view(np.int64)
        if not buckets:
            return gram_row, gram
        empty = owner[sizes < 3]  # nothing but the padding: one short trigram
        return gram_row, gram, np.concatenate((tri[0], empty)), np.concatenate((tri[1], np.full(len(empty), hashlib.md5(b"  ").digest()[-1], np.int64)))

    def _buckets(self, h: np.ndarray, at: np.ndarray, whole: str) -> np.ndarray:
        """The last byte of the md5 of the trigrams at some places; each trigram is digested once a task."""
        seen = np.minimum(np.searchsorted(self.known, h), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[seen] != h) if len(self.known) else np.arange(len(h))
        if len(new):
            more, first = np.unique(h[new], return_index=True)
            made = [hashlib.md5(whole[i : i + 3].encode()).digest()[-1] for i in at[new[first]].tolist()]
            known, bucket = np.concatenate((self.known, more)), np.concatenate((self.bucket, np.array(made, np.int64)))
            order = np.argsort(known)
            self.known, self.bucket = known[order], bucket[order]
            seen = np.searchsorted(self.known, h)
        return self.bucket[seen]


def _distinct(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets by row, distinct values of each row in order, how often each stands there); ``row`` is in order."""
    ends = np.searchsorted(row, np.arange(rows + 1))
    value = value.copy()
    for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        value[lo:hi].sort()
    first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])))) if len(row) else np.zeros(0, np.int64)
    return np.searchsorted(row[first], np.arange(rows + 1)).astype(np.int32), value[first], np.diff(np.append(first, len(row))).astype(np.int32)


def counted(rows: DataFrame, *lists: str, texts: str | None = None, idf: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``{list}_t``, the distinct values in order, and ``{list}_n``, how often each stands there, for every array<long> named.

    With ``texts``, an array of normalised texts, also ``char`` of their character n-grams (hashes) and ``dense`` of their
    trigrams (buckets); with ``idf`` (term, idf), which travels with the plan, also ``length``, that of the vector of
    (1 + ln ``char_n``) times idf, null without n-grams. Terms are counted within their row: nothing is exploded or shuffled.
    """
    kept = [c for c in rows.columns if c not in (*lists, texts)]
    names = [f"{x}_{y}" for x in (*lists, *(("char", "dense") if texts else ())) for y in "tn"]
    shape = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept] + [f"`{x}` array<{'int' if x.endswith('_n') else 'long'}>" for x in names] + (["length double"] if idf is not None else []))
    terms, weights = _sorted_idf(idf) if idf is not None else (None, None)

    def length(at: np.ndarray, term: np.ndarray, n: np.ndarray) -> pa.Array:
        here = np.minimum(np.searchsorted(terms, term), max(len(terms) - 1, 0))
        w = np.where(terms[here] == term, (1 + np.log(n)) * weights[here], 0.0) if len(terms) else np.zeros(len(term))
        sizes = np.diff(at)
        return pa.array(np.sqrt(np.bincount(np.repeat(np.arange(len(sizes)), sizes), w * w, len(sizes))), mask=sizes == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            for lo in range(0, batch.num_rows, COUNTED):
                part = batch.slice(lo, COUNTED)
                size = part.num_rows
                found = [_distinct(*_lists(part.column(i)), size) for i in range(len(kept), len(kept) + len(lists))]
                more = []
                if texts:
                    row, gram, tri, bucket = grams.cut(part.column(part.num_columns - 1).to_pylist())
                    n = np.bincount(tri * 256 + bucket, minlength=size * 256)
                    key = np.flatnonzero(n)
                    found += [_distinct(row, gram, size), (np.searchsorted(key, np.arange(size + 1) * 256).astype(np.int32), key % 256, n[key].astype(np.int32))]
                    more = [length(*found[-2])] if terms is not None else []
                arrays = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for at, *both in found for x in both]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), *arrays, *more], names=[*kept, *names, *(["length"] if more else [])])

    return rows.select(*kept, *lists, *([texts] if texts else [])).mapInArrow(run, shape)


def _sorted_idf(idf: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    known = idf.select("term", "idf").toArrow()
    terms, weights = (known.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(terms)
    return terms[order], weights[order]


def gram_rows(rows: DataFrame, texts: str) -> DataFrame:
    """(term, df): in how many rows of ``texts``, arrays of normalised texts, each n-gram stands; summed up within tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, held = Grams(), (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            for lo in range(0, batch.num_rows, COUNTED):
                part = batch.slice(lo, COUNTED)
                one = np.unique(_distinct(*grams.cut(part.column(0).to_pylist(), buckets=False), part.num_rows)[1], return_counts=True)
                term, n = (np.concatenate(x) for x in zip(held, one, strict=True))
                order = np.argsort(term, kind="stable")
                term, n = term[order], n[order]
                first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
                held = term[first], np.add.reduceat(n, first) if len(first) else n
                if len(first) > GRAMS_HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["term", "n"])
                    held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["term", "n"])

    return rows.select(texts).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


class Sparse:
    """Sparse vectors of a block of questions: sorted term hashes and (place, question, weight) entries."""

    def __init__(self, question: np.ndarray, term: np.ndarray, w: np.ndarray):
        self.terms, place = np.unique(term, return_inverse=True)
        self.place, self.question, self.w = place.astype(np.int32), question.astype(np.int32), w

    def matrix(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray | None, tuple]:
        """(terms, weights by term and question where that is a small matrix, its entries as lists by term) of the questions lo..hi."""
        on = np.flatnonzero((self.question >= lo) & (self.question < hi))
        on = on[np.argsort(self.place[on], kind="stable")]
        used, first, at = np.unique(self.place[on], return_index=True, return_inverse=True)
        lists = np.append(first, len(on)), self.question[on] - lo, self.w[on], hi - lo
        whole = None
        if len(used) * (hi - lo) <= STEP:
            whole = np.zeros((len(used), hi - lo))
            whole[at, lists[1]] = lists[2]
        return self.terms[used], whole, lists


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, flat values) of a list column; null lists are empty."""
    column = column.fill_null([]) if column.null_count else column
    start = column.offsets.to_numpy()
    return np.repeat(np.arange(len(column)), np.diff(start)), column.values.to_numpy(zero_copy_only=False)[start[0] : start[-1]]


def _product(row: np.ndarray, term: np.ndarray, w: np.ndarray, rows: int, terms: np.ndarray, weights: np.ndarray | None, lists: tuple | None = None) -> np.ndarray:
    """(rows x questions) sparse dot products; a term of a row stands once, rows are in order.

    ``lists`` holds the weights as lists by term: where each begins, its questions and their weights, and how many questions there are.
    """
    if lists is None:
        place, question = np.nonzero(weights)
        lists = np.searchsorted(place, np.arange(len(weights) + 1)), question, weights[place, question], weights.shape[1]
    start, question, value, many = lists
    out = np.zeros((rows, many))
    if not len(terms) or not len(term):
        return out
    at = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
    on = np.flatnonzero(terms[at] == term)
    if weights is not None and rows * len(terms) <= DENSE * len(on):  # most terms stand in most rows, as buckets do
        step = max(1, STEP // len(terms))
        for lo in range(0, rows, step):
            i = on[np.searchsorted(row[on], lo) : np.searchsorted(row[on], lo + step)]
            held = np.zeros((min(step, rows - lo), len(terms)))
            held[row[i] - lo, at[i]] = w[i]
            out[lo : lo + step] = held @ weights
        return out
    row, w, at = row[on], w[on], at[on]
    long = np.diff(start)[at]
    ends = np.cumsum(long)
    lo = 0
    while lo < len(on):  # pairs of an entry and a question that asks for its term, so many at once
        hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP, "right")), lo + 1)
        size = long[lo:hi]
        before = np.cumsum(size) - size
        entry = np.repeat(start[at[lo:hi]] - before, size) + np.arange(size.sum())
        first = row[lo]
        cell = np.repeat((row[lo:hi] - first) * many, size) + question[entry]
        span = row[hi - 1] - first + 1
        out[first : first + span] += np.bincount(cell, np.repeat(w[lo:hi], size) * value[entry], span * many).reshape(span, many)
        lo = hi
    return out


def _round(x: np.ndarray, digits: int | None) -> np.ndarray:
    return x if digits is None else np.round(x, digits)


class Questions:
    """A block of questions in memory: ids and the sparse vectors of each signal, and of the title tokens."""

    def __init__(self, ids: list, signals: dict[str, Sparse], titles: Sparse, squash: float, digits: tuple):
        self.ids, self.signals, self.titles, self.squash, self.digits = ids, signals, titles, squash, digits

    def parts(self) -> list[tuple[int, int, dict, tuple]]:
        """Questions that are multiplied together, with their matrices."""
        out = []
        for lo in range(0, len(self.ids), TOGETHER):
            hi = min(lo + TOGETHER, len(self.ids))
            out.append((lo, hi, {name: s.matrix(lo, hi) for name, s in self.signals.items()}, self.titles.matrix(lo, hi)))
        return out

    def scores(self, batch: pa.RecordBatch, matrices: dict) -> dict[str, np.ndarray]:
        out = {}
        for name, block in matrices.items():
            row, term = _lists(batch.column(batch.schema.get_field_index(f"{name}_t")))
            w = _lists(batch.column(batch.schema.get_field_index(f"{name}_w")))[1]
            s = _product(row, term, w, batch.num_rows, *block)
            out[name] = _round(s / (s + self.squash) if name == "bm25" else s, self.digits[0])
        return out

    def combined(self, scores: dict[str, np.ndarray], weights: dict[str, float]) -> np.ndarray:
        """The weighted sum, -inf where a row shares no term with a question."""
        total = sum(weights[name] * scores[name] for name in scores)
        return np.where(np.logical_or.reduce([s != 0 for s in scores.values()]), _round(total, self.digits[1]), -np.inf)

    def coverage(self, titles: list, matrix: tuple) -> np.ndarray:
        """(services x questions): the best share of a title's tokens that a question holds."""
        flat = [(i, np.array(t, np.int64)) for i, variants in enumerate(titles) for t in variants or ()]
        out = np.zeros((len(titles), matrix[2][3]))
        if flat:
            row = np.repeat(np.arange(len(flat)), [len(t) for _, t in flat])
            held = _product(row, np.concatenate([t for _, t in flat]), np.ones(len(row)), len(flat), *matrix)
            np.maximum.at(out, [i for i, _ in flat], held / np.array([[len(t)] for _, t in flat]))
        return out


def _questions(part: DataFrame, signals: dict[str, DataFrame], squash: float, digits: tuple) -> Questions:
    """The questions of a block (query_id, query) on the driver; ``signals`` holds (query_id, term or its hash t, w) of all questions."""
    ids = [r.query_id for r in part.select("query_id").distinct().orderBy("query_id").collect()]
    place = {i: k for k, i in enumerate(ids)}

    def sparse(df: DataFrame) -> Sparse:
        rows = df.join(F.broadcast(part.select("query_id").distinct()), "query_id", "left_semi").select("query_id", F.col("t") if "t" in df.columns else F.xxhash64(F.col("term").cast("string")).alias("t"), F.col("w").cast("double").alias("w")).collect()
        return Sparse(np.array([place[r.query_id] for r in rows], np.int64), np.array([r.t for r in rows], np.int64), np.array([r.w for r in rows], float))

    tokens = part.select("query_id", F.explode(F.array_distinct(tokenize(F.col("query")))).alias("term"), F.lit(1.0).alias("w"))
    return Questions(ids, {name: sparse(df) for name, df in signals.items()}, sparse(tokens), squash, digits)


class Services:
    """The rows of a batch in order of service and chunk, with the bounds of each service."""

    def __init__(self, batch: pa.RecordBatch):
        service, chunk = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        order = np.lexsort((_ranks(chunk), _ranks(service)))
        self.batch = batch.take(pa.array(order))
        self.service, self.chunk = [service[i] for i in order.tolist()], [chunk[i] for i in order.tolist()]
        code = _ranks(self.service)
        self.first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        self.own = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(code))))
        self.names = [self.service[i] for i in self.first.tolist()]


def _kinds(rows: DataFrame) -> tuple[dict, dict]:
    kinds = {c: rows.schema[c].dataType for c in ("service_id", "chunk_id")}
    return {c: to_arrow_type(t) for c, t in kinds.items()}, {c: t.simpleString() for c, t in kinds.items()}


def best_services(rows: DataFrame, questions: Questions, grid: list[dict[str, float]], k: int) -> DataFrame:
    """(config, question, service_id, score, best, chunk_id, one column a signal): the k best services of each task.

    A service's score is its best chunk's weighted sum plus ``w_tcov`` times the coverage of its title. The service's
    best chunk stands in some task, where at most k - 1 services can be before it; so no hit is lost.
    """
    kinds, id_kind = _kinds(rows)
    names = list(questions.signals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = questions.parts()
        best = {(c, lo): Best(k, 1 + len(names), once=True) for lo, *_ in parts for c in range(len(grid))}
        for part in (batch.slice(lo, ROWS) for batch in batches for lo in range(0, batch.num_rows, ROWS)):
            at = Services(part)
            titles = at.batch.column(2).take(pa.array(at.first)).to_pylist()
            for lo, _, matrices, title in parts:
                scores, cover = questions.scores(at.batch, matrices), questions.coverage(titles, title)
                for c, weights in enumerate(grid):
                    total = questions.combined(scores, weights)
                    top = np.maximum.reduceat(total, at.first, axis=0)
                    last = np.maximum.reduceat(np.where(total == top[at.own], np.arange(len(at.own))[:, None], -1), at.first, axis=0)
                    whole = _round(top + weights.get("w_tcov", 0.0) * cover, questions.digits[2])
                    q, r = _columns(whole, k)
                    row = last[r, q]
                    best[c, lo].add(q, whole[r, q], [at.names[i] for i in r.tolist()], [at.chunk[i] for i in row.tolist()], top[r, q], *(scores[s][row, q] for s in names))
        for (c, lo), b in best.items():
            columns = [pa.array(np.full(len(b.group), c, np.int32)), pa.array((b.group + lo).astype(np.int32)), pa.array(b.key, kinds["service_id"]), pa.array(b.score), pa.array(b.more[0]), pa.array(b.tag, kinds["chunk_id"])]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x) for x in b.more[1:])], names=["config", "question", "service_id", "score", "best", "chunk_id", *names])

    shape = f"config int, question int, service_id {id_kind['service_id']}, score double, best double, chunk_id {id_kind['chunk_id']}" + "".join(f", `{s}` double" for s in names)
    return rows.select("service_id", "chunk_id", "titles", *(f"{s}_{x}" for s in names for x in "tw")).mapInArrow(run, shape)


def best_chunks(rows: DataFrame, questions: Questions, weights: dict[str, float], pairs: list[tuple], n: int) -> DataFrame:
    """(question, service_id, chunk_id, combined): the n best chunks of each task for each of ``pairs`` (question, service)."""
    kinds, id_kind = _kinds(rows)
    names = list(questions.signals)
    wanted: dict = {}
    for p, (q, service) in enumerate(pairs):
        wanted.setdefault(service, []).append((q, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, best = questions.parts(), Best(n)
        for batch in batches:
            on = [i for i, s in enumerate(batch.column(0).to_pylist()) if s in wanted]
            if not on:
                continue
            at = Services(batch.take(pa.array(on)))
            row, q, pair = (np.array(c, np.int64) for c in zip(*((i, q, p) for i, s in enumerate(at.service) for q, p in wanted[s]), strict=True))
            for lo, hi, matrices, _ in parts:
                here = np.flatnonzero((q >= lo) & (q < hi))
                if not len(here):
                    continue
                score = questions.combined(questions.scores(at.batch, matrices), weights)[row[here], q[here] - lo]
                here, score = here[np.isfinite(score)], score[np.isfinite(score)]
                best.add(pair[here], score, [at.chunk[i] for i in row[here].tolist()])
        own = [pairs[p] for p in best.group.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in own], pa.int32()), pa.array([s for _, s in own], kinds["service_id"]), pa.array(best.key, kinds["chunk_id"]), pa.array(best.score)], names=["question", "service_id", "chunk_id", "combined"])

    return rows.select("service_id", "chunk_id", *(f"{s}_{x}" for s in names for x in "tw")).mapInArrow(run, f"question int, service_id {id_kind['service_id']}, chunk_id {id_kind['chunk_id']}, combined double")


def all_signals(rows: DataFrame, queries: DataFrame, signals: dict[str, DataFrame], squash: float = fixed.BM25["squash"], digits: int | None = None) -> DataFrame:
    """(query_id, chunk_id, one column a signal) of all pairs of questions and rows that share a term: as many rows as there are such pairs."""
    kind, names, out = _kinds(rows), list(signals), None
    for part in _blocks(queries, "64L * length(query)"):
        asked = _questions(part, signals, squash, (None, None, None))

        def run(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            blocks = asked.parts()
            for batch in batches:
                for at in range(0, batch.num_rows, COUNTED):
                    some = batch.slice(at, COUNTED)
                    for lo, _, matrices, _ in blocks:
                        scores = asked.scores(some, matrices)
                        r, q = np.nonzero(np.logical_or.reduce([s != 0 for s in scores.values()]))
                        yield pa.RecordBatch.from_arrays([pa.array((q + lo).astype(np.int32)), some.column(0).take(pa.array(r)), *(pa.array(_round(scores[s][r, q], digits)) for s in names)], names=["question", "chunk_id", *names])

        found = rows.select("chunk_id", *(f"{s}_{x}" for s in names for x in "tw")).mapInArrow(run, f"question int, chunk_id {kind[1]['chunk_id']}" + "".join(f", `{s}` double" for s in names))
        found = found.join(_ids(queries, asked), "question").select("query_id", "chunk_id", *names)
        out = found if out is None else out.unionByName(found)
    return out


def _ids(queries: DataFrame, asked: Questions) -> DataFrame:
    """(question, query_id) of a block."""
    kind = T.StructType([T.StructField("question", T.IntegerType()), T.StructField("query_id", queries.schema["query_id"].dataType)])
    return F.broadcast(queries.sparkSession.createDataFrame(list(enumerate(asked.ids)), kind))  # a block's questions


def hits(rows: DataFrame, queries: DataFrame, signals: dict[str, DataFrame], grid: list[dict[str, float]], k: int, n: int = 0, squash: float = fixed.BM25["squash"], digits: tuple = (None, None, None)) -> DataFrame:
    """(config, query_id, service_id, score, rank, best, chunk_id, one column a signal[, evidence]) of all questions (query_id, query).

    ``rows`` come from ``signal_rows``, ``signals`` holds the questions' vectors (query_id, term, w) by signal, ``grid``
    the weightings. ``digits`` rounds signals, sums and scores. Chunks that share no term with a question are no hits; ties by
    service, of chunks the last. With ``n`` also the n best chunks (chunk_id, combined) of each hit, for one weighting.
    """
    out, names = None, list(signals)
    for part in _blocks(queries, "64L * length(query)"):
        asked = _questions(part, signals, squash, digits)
        if not asked.ids:
            continue
        found = best_services(rows, asked, grid, k).groupBy("config", "question", "service_id").agg(F.max("score").alias("score"), F.max_by(F.struct("best", "chunk_id", *names), F.struct("best", "chunk_id")).alias("b")).select("config", "question", "service_id", "score", "b.*")
        order = Window.partitionBy("config", "question").orderBy(F.desc("score"), "service_id")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if n:
            found = stored(found, "hits")
            pairs = [(r.question, r.service_id) for r in found.select("question", "service_id").collect()]  # k for each question of a block
            best = Window.partitionBy("question", "service_id").orderBy(F.desc("combined"), "chunk_id")
            named = F.broadcast(found.select(F.col("service_id").alias("hit")).distinct())  # rows of other services are left in the scan
            own = rows.join(named, rows["service_id"].eqNullSafe(named["hit"]), "left_semi")
            chunks = best_chunks(own, asked, grid[0], pairs, n).withColumn("r", F.row_number().over(best)).where(F.col("r") <= n)
            chunks = chunks.groupBy("question", "service_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "chunk_id", "combined"))), lambda e: e.dropFields("r")).alias("evidence"))
            found = found.join(chunks, ["question", "service_id"], "left")
        found = found.join(_ids(queries, asked), "question").drop("question")
        out = found if out is None else out.unionByName(found)
    if out is None:
        none = rows.limit(0).select(F.lit(0).alias("config"), "service_id", F.lit(0.0).alias("score"), F.lit(0.0).alias("best"), "chunk_id", *(F.lit(0.0).alias(s) for s in names), F.lit(1).alias("rank"))
        more = [F.array().cast(f"array<struct<chunk_id:{_kinds(rows)[1]['chunk_id']},combined:double>>").alias("evidence")] if n else []
        out = none.select("*", F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), *more)
    return out
