"""Ranked lexical search over dual-sorted wavelet trees, one for each shard of documents.

A shard holds the inverted lists of some documents, one after another, each list by falling impact. The sequence of
local document numbers is kept as a wavelet matrix: one level for each bit of the number, from the highest. A range of
the sequence maps to its two halves of the document numbers by two ranks, and keeps its order by impact in each, so the
first element of a range bounds every document below it. Local numbers follow doc_id.

A question starts with the ranges of its terms. Nodes (an interval of documents with the ranges that are not empty in
it) are opened best bound first, many at a time and all questions of a block together; a leaf is a document with its
exact score. A node whose bound is below a question's k-th score is left out, so the k best are exact. The k best go
from shard to shard within a task, and tasks return no more than k rows for each question.

Scores are integers: a term weighs floor(1000 ln((2N + 2) / (2 df + 1))), an occurrence count tf in a document of n terms
(10^9 tf) div (1000 tf + 20 m) with m = 50 + (50 n N) div L; N documents have terms, L terms in all. Terms are told apart
by 64-bit hashes of their bytes with A-Z folded.

Cases: a null or empty text has no terms and is not counted; a question without known terms has no rows; repeated rows
are documents and questions of their own, even with equal ids; documents with a null doc_id are ranked with a null and
stand after others of an equal score; equal scores stand by doc_id; doc_id must be an integer (``TypeError`` otherwise);
very long texts are taken whole, one may be a shard of its own; extra columns are ignored; an empty table of documents
or of questions gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .shared import written
from .textarrays import ALNUM, LOWER, U64, Texts, passes, ragged, release

#: Bytes of text and documents after which a shard is full.
SHARD_BYTES = 8 << 20
SHARD_DOCS = 8192
#: Questions that are searched together, and bytes of their texts.
BLOCK_ITEMS = 1024
BLOCK_BYTES = 4 << 20
#: Nodes of each question that are opened at a time until its first documents are reached.
WIDTH = 96
#: Bits of an impact (below 10^6) and of a local document number in a sort key.
IMPACT_BITS, DOC_BITS = 20, 13


@dataclass
class LexicalIndex:
    """Shards as a written table, with the totals that their impacts come from."""

    shards: DataFrame
    documents: int
    terms: int


def counted_terms(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, tf) of all postings of a pass, and the number of terms of each document."""
    s, e, owner = texts.words(ALNUM)
    h = texts.hashes(s, e, LOWER)
    order = np.lexsort((h, owner))
    h, own = h[order], owner[order]
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])))) if len(h) else np.zeros(0, np.int64)
    return own[new], h[new], np.diff(np.append(new, len(h))), np.bincount(owner, minlength=len(texts))


def totals(documents: DataFrame) -> tuple[int, int]:
    """Documents with terms, and terms with repeats, of all texts."""

    def run(batches):
        docs = terms = 0
        for _, texts in passes(batches):
            n = np.bincount(texts.words(ALNUM)[2], minlength=len(texts))
            docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
        yield pa.RecordBatch.from_pydict({"docs": pa.array([docs], pa.int64()), "terms": pa.array([terms], pa.int64())})

    row = documents.select("text").mapInArrow(run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    m = 50 + (50 * n.astype(np.int64) * documents) // terms
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf + 20 * m)


def wavelet(sequence: np.ndarray, levels: int) -> list[np.ndarray]:
    """The bits of each level; below it, elements with a 0 stand before those with a 1, each in their order."""
    out = []
    for k in range(levels - 1, -1, -1):
        bit = (sequence >> k & 1).astype(bool)
        out.append(bit)
        sequence = np.concatenate((sequence[~bit], sequence[bit]))
    return out


def depth(documents: int) -> int:
    return max(1, (documents - 1).bit_length())


def shard(ids: pa.Array, parts: list[tuple], documents: int, terms: int) -> dict:
    """A shard's row from its documents' ids and the postings of its passes (document, term, tf, impact)."""
    order = pa.compute.sort_indices(ids, null_placement="at_end").to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    doc, h, impact = (np.concatenate([p[k] for p in parts]) for k in range(3))
    vocabulary, term = np.unique(h, return_inverse=True)
    # One key for each posting: term, falling impact, document.
    key = (term.astype(U64) << U64(IMPACT_BITS + DOC_BITS)) | ((U64((1 << IMPACT_BITS) - 1) - impact.astype(U64)) << U64(DOC_BITS)) | place[doc].astype(U64)
    key.sort()
    doc = (key & U64((1 << DOC_BITS) - 1)).astype(np.int64)
    impact = (1 << IMPACT_BITS) - 1 - (key >> U64(DOC_BITS) & U64((1 << IMPACT_BITS) - 1)).astype(np.int32)
    starts = np.searchsorted(key >> U64(IMPACT_BITS + DOC_BITS), np.arange(len(vocabulary) + 1, dtype=U64)).astype(np.int32)
    bits = [np.packbits(b).tobytes() for b in wavelet(doc, depth(len(ids)))]
    return {"doc_ids": ids.take(pa.array(order)).to_pylist(), "vocabulary": vocabulary.tobytes(), "starts": starts.tobytes(), "impacts": impact.tobytes(), "bits": bits}


SHARD = pa.schema([("doc_ids", pa.list_(pa.int64())), ("vocabulary", pa.binary()), ("starts", pa.binary()), ("impacts", pa.binary()), ("bits", pa.list_(pa.binary()))])


def build_index(documents: DataFrame) -> LexicalIndex:
    """Index of all ``documents`` (doc_id integer, text), written to the shared folder.

    Each task cuts its own rows into shards: nothing is shuffled. Documents without terms are left out.
    """
    idt = documents.schema["doc_id"].dataType
    if not isinstance(idt, IntegralType):
        raise TypeError(f"doc_id must be an integer, not {idt.simpleString()}")
    n_docs, n_terms = totals(documents)

    def run(batches):
        ids, parts, held, size = [], [], 0, 0

        def full():
            row = shard(pa.concat_arrays(ids), parts, n_docs, n_terms)
            return pa.RecordBatch.from_pylist([row], schema=SHARD)

        for batch, texts in passes(batches):
            doc, h, tf, n = counted_terms(texts)
            some = np.flatnonzero(n)
            for at in range(0, len(some), SHARD_DOCS):
                own = some[at : at + SHARD_DOCS]
                if held and (held + len(own) > SHARD_DOCS or size >= SHARD_BYTES):
                    yield full()
                    ids, parts, held, size = [], [], 0, 0
                lo, hi = np.searchsorted(doc, [own[0], own[-1] + 1])
                local = np.searchsorted(own, doc[lo:hi]) + held
                parts.append((local, h[lo:hi], impacts(tf[lo:hi], n[doc[lo:hi]], n_docs, n_terms)))
                ids.append(batch.column(0).take(pa.array(own)).cast(pa.int64()))
                held, size = held + len(own), size + int((texts.offsets[own + 1] - texts.offsets[own]).sum())
        if held:
            yield full()
        release()

    shape = "doc_ids array<long>, vocabulary binary, starts binary, impacts binary, bits array<binary>"
    return LexicalIndex(written(documents.select("doc_id", "text").mapInArrow(run, shape), "lexical"), n_docs, n_terms)


class Shard:
    """A shard in memory: ranks and impacts of every level."""

    def __init__(self, impacts: bytes, bits: list[bytes]):
        row = np.frombuffer(impacts, np.int32)
        n = len(row)
        self.levels = len(bits)
        self.ones = np.zeros((self.levels, n + 1), np.int32)
        self.zeros = np.empty(self.levels, np.int64)
        self.impact = np.empty((self.levels + 1, n), np.int32)
        self.impact[0] = row
        for k, packed in enumerate(bits):
            bit = np.unpackbits(np.frombuffer(packed, np.uint8), count=n).view(bool)
            np.cumsum(bit, out=self.ones[k, 1:])
            self.zeros[k] = n - self.ones[k, n]
            self.impact[k + 1, : self.zeros[k]] = self.impact[k][~bit]
            self.impact[k + 1, self.zeros[k] :] = self.impact[k][bit]


class Best:
    """The k best (score, doc_id) of each question so far; ties by doc_id, null ids last."""

    def __init__(self, questions: int, k: int):
        self.k, self.floor = k, np.ones(questions, np.int64)
        self.question, self.score, self.null, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, question: np.ndarray, score: np.ndarray, null: np.ndarray, doc: np.ndarray) -> None:
        q, s, z, d = (np.concatenate(c) for c in ((self.question, question), (self.score, score), (self.null, null), (self.doc, doc)))
        order = np.lexsort((d, z, -s, q))
        q, s, z, d = q[order], s[order], z[order], d[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.floor[q[last]] = s[last]
        on = place < self.k
        self.question, self.score, self.null, self.doc = q[on], s[on], z[on], d[on]


def search_shard(tree: Shard, ids: pa.Array, question: np.ndarray, weight: np.ndarray, lo: np.ndarray, hi: np.ndarray, best: Best) -> int:
    """Add a shard's documents to ``best``, from ranges (question, weight, lo, hi) in order of the question.

    Returns the number of nodes that were opened.
    """
    null = ids.is_null().to_numpy(zero_copy_only=False)
    doc_id = ids.fill_null(0).to_numpy()
    flat_ones, flat_impact, n = tree.ones.ravel(), tree.impact.ravel(), tree.impact.shape[1]

    def summed(owner, level, sp, w, nodes):
        bound = np.zeros(nodes, np.int64)
        np.add.at(bound, owner, w * flat_impact[level * n + sp])
        return bound

    # A node: its question, level, first document, bound and ranges; the ranges of node i are from first[i] on.
    asked, first = np.unique(question, return_index=True)
    count = np.diff(np.append(first, len(question)))
    owner = np.repeat(np.arange(len(asked)), count)
    q, level, base = asked, np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
    bound = summed(owner, np.zeros(len(owner), np.int64), lo, weight, len(asked))
    opened, rounds, width = 0, 0, WIDTH
    while True:
        on = np.flatnonzero(bound >= best.floor[q])
        if not len(on):
            return opened
        order = on[np.lexsort((-bound[on], q[on]))]
        place = np.arange(len(order)) - np.searchsorted(q[order], q[order])
        take, rest = order[place < width], order[place >= width]
        opened, rounds = opened + len(take), rounds + 1
        width = WIDTH if rounds <= tree.levels else width * 2
        at = ragged(first[take], count[take])
        node = np.repeat(np.arange(len(take)), count[take])
        lev = level[take][node]
        sp, ep, w = lo[at], hi[at], weight[at]
        one_sp, one_ep = flat_ones[lev * (n + 1) + sp].astype(np.int64), flat_ones[lev * (n + 1) + ep].astype(np.int64)
        sides = []
        for bit, a, b in ((0, sp - one_sp, ep - one_ep), (1, tree.zeros[lev] + one_sp, tree.zeros[lev] + one_ep)):
            some = np.flatnonzero(a < b)
            sides.append((2 * node[some] + bit, a[some], b[some], w[some]))
        child, sp, ep, w = (np.concatenate(c) for c in zip(*sides, strict=True))
        order = np.argsort(child, kind="stable")
        child, sp, ep, w = child[order], sp[order], ep[order], w[order]
        kids, owner = np.unique(child, return_inverse=True)
        parent = take[kids // 2]
        kid_level = level[parent] + 1
        kid_bound = summed(owner, kid_level[owner], sp, w, len(kids))
        kid_base = base[parent] + ((kids & 1) << (tree.levels - kid_level))
        leaf = kid_level == tree.levels
        good = kid_bound >= best.floor[q[parent]]
        done = np.flatnonzero(leaf & good)
        if len(done):
            best.add(q[parent[done]], kid_bound[done], null[kid_base[done]], doc_id[kid_base[done]])
        go = np.flatnonzero(~leaf & good)
        kid_count = np.bincount(owner, minlength=len(kids))
        kid_first = np.cumsum(kid_count) - kid_count
        # What stays in the pool: nodes not opened yet, then the children.
        old, new = ragged(first[rest], count[rest]), ragged(kid_first[go], kid_count[go])
        lo, hi, weight = np.concatenate((lo[old], sp[new])), np.concatenate((hi[old], ep[new])), np.concatenate((weight[old], w[new]))
        q, level, base, bound, count = np.concatenate((q[rest], q[parent[go]])), np.concatenate((level[rest], kid_level[go])), np.concatenate((base[rest], kid_base[go])), np.concatenate((bound[rest], kid_bound[go])), np.concatenate((count[rest], kid_count[go]))
        first = np.cumsum(count) - count


def question_terms(items: DataFrame):
    """(question, term) rows of a bounded block of numbered questions (question, text), each term once."""

    def run(batches):
        for batch, texts in passes(batches):
            doc, h, _, _ = counted_terms(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(h.view(np.int64))], names=["question", "term"])

    return items.mapInArrow(run, "question long, term long")


def document_counts(index: LexicalIndex, terms: np.ndarray) -> np.ndarray:
    """Documents that hold each of the sorted ``terms``, over all shards."""

    def run(batches):
        df = np.zeros(len(terms), np.int64)
        for batch in batches:
            for v, s in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                vocabulary, length = np.frombuffer(v, U64), np.diff(np.frombuffer(s, np.int32))
                at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
                df += np.where(vocabulary[at] == terms, length[at], 0)
        on = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(df[on])], names=["term", "df"])

    out = np.zeros(len(terms), np.int64)
    for r in index.shards.select("vocabulary", "starts").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a block's terms
        out[r.term] = r.df
    return out


def search_block(index: LexicalIndex, items: DataFrame, k: int) -> DataFrame:
    """(question, doc_id, score): the k best of each task for a block of questions (question, text)."""
    rows = question_terms(items).toPandas()
    question, term = rows["question"].to_numpy(np.int64), rows["term"].to_numpy(np.int64).view(U64)
    names, question = np.unique(question, return_inverse=True)
    terms, term = np.unique(term, return_inverse=True)
    df = document_counts(index, terms) if len(terms) else np.zeros(0, np.int64)
    weight = np.array([math.floor(1000 * math.log((2 * index.documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    order = np.lexsort((term, question))
    question, term = question[order], term[order]

    def run(batches):
        best = Best(len(names), k)
        for batch in batches:
            for row in batch.to_pylist():
                vocabulary, starts = np.frombuffer(row["vocabulary"], U64), np.frombuffer(row["starts"], np.int32).astype(np.int64)
                at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
                known = (vocabulary[at] == terms) & (weight > 0)
                on = np.flatnonzero(known[term])
                if len(on):
                    t = term[on]
                    search_shard(Shard(row["impacts"], row["bits"]), pa.array(row["doc_ids"], pa.int64()), question[on], weight[t], starts[at[t]], starts[at[t] + 1], best)
        yield pa.RecordBatch.from_arrays([pa.array(names[best.question]), pa.array(best.doc, mask=best.null), pa.array(best.score)], names=["question", "doc_id", "score"])
        release()

    return index.shards.mapInArrow(run, "question long, doc_id long, score long")


def search(index: LexicalIndex, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every row of ``items`` (item_id, text)."""
    numbered = written(items.select("item_id", "text", F.monotonically_increasing_id().alias("question")), "questions")
    n, size = numbered.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    blocks = max(-(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES), 1)
    found = None
    for b in range(blocks):  # each block's terms travel with its search
        own = numbered.select("question", "text").where(F.pmod(F.xxhash64("question"), F.lit(blocks)) == b)
        part = search_block(index, own, k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("question").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(numbered.select("question", "item_id")) if n <= 100_000 else numbered.select("question", "item_id"), "question").select("item_id", "rank", "doc_id", "score")
