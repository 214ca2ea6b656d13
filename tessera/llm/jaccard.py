"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles (ASCII case folded; fewer words form one shingle). Sets are split
recursively on sampled shared tokens: in each run a set follows every token whose hash under the path so far is below
``1 / (threshold * size)``, for ``LEVELS`` levels, so two similar sets share a path with a probability that does not
depend on the corpus, and a set has as many paths in a corpus of any size. Runs are repeated until the target recall.

Sets that share a path are a bucket. Pairs in a bucket are screened by a min-hash sketch with a wide margin and joined
into candidate components; within each component all pairs are compared exactly on the whole shingle sets. Buckets of
more than ``BLOCK`` sets are screened block by block first. Near copies then mostly stand in one component, in which
no pair needs another look; what is outside of it is compared with all the others of its bucket, in pairs of blocks.

No list of pairs is ever formed: tasks return link counts and spanning links. Equal sets are one set with a
multiplicity. Large components are cut into blocks by sets and bytes, and each pair of blocks is a group of its own.

Cases: a null or blank text has no shingles and links with nothing; a null doc_id links with nothing; a doc_id must be
an integer (``TypeError`` otherwise); repeated rows are documents of their own that share an id; of equal sets the
smallest id stands for all; very long texts are taken whole, a pass may hold one text alone; extra columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .shared import connected_components, erase, written
from .textarrays import LOWER, SOLID, Texts, mix, ngrams, passes, ragged

WORDS = 5
LEVELS = 3
SKETCH = 64
SCREEN = 0.2  # candidates have an estimated similarity of at least threshold - SCREEN: four standard errors
#: Sets of one block of a bucket, and sets and bytes of shingles of one block of a component.
BLOCK = 1024
EXACT_BLOCK = 2048
EXACT_BYTES = 8 << 20
#: Sets, and tokens of all of them, from which the order of a large component's tokens is taken; splits in a row.
ORDER_SETS = 512
ORDER_TOKENS = 1 << 18
SPLIT_ROUNDS = 4
#: Hash classes by which a component tells its common tokens (a power of two).
KINDS = 4096
#: A counted table of ids or hashes up to so many bytes is broadcast; beyond that it is joined by a shuffle.
BROADCAST_BYTES = 4 << 20
#: Rows that one task of a block comparison takes on average.
ROWS_A_TASK = 200_000
#: Hashes that one step of the path search holds.
STEP = 1 << 20
U64 = np.uint64
_LOW = U64((1 << 51) - 1)


def runs_for(recall: float, levels: int = LEVELS) -> int:
    """Runs after which a pair at the threshold shares a last-level path with probability ``recall``.

    Each shared token is followed by both with mean 1 over all shared tokens, so the chance to share a path of a given
    depth follows ``q(0) = 1, q(k) = 1 - exp(-q(k - 1))``.
    """
    q = 1.0
    for _ in range(levels):
        q = 1 - math.exp(-q)
    return math.ceil(math.log(1 - recall) / math.log(1 - q))


def shingle_sets(texts: Texts, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (51-bit hashes, sorted within a text) and the bounds of each text's set; at most 8192 texts."""
    s, e, owner = texts.words(SOLID)
    h = texts.hashes(s, e, LOWER)
    grams, own = ngrams(h, owner, words)
    count = np.bincount(owner, minlength=len(texts))[: len(texts)]
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        first = np.searchsorted(owner, short)
        extra = np.zeros(len(short), U64)
        for k in range(words - 1):
            on = count[short] > k
            extra[on] = mix(extra[on] * U64(0xD6E8FEB86659FD93) + h[first[on] + k])
        grams, own = np.concatenate([grams, extra]), np.concatenate([own, short])
    packed = np.sort((own.astype(U64) << U64(51)) | (grams & _LOW))
    if len(packed):
        packed = packed[np.concatenate(([True], packed[1:] != packed[:-1]))]
    bounds = np.searchsorted(packed, np.arange(len(texts) + 1, dtype=U64) << U64(51))
    return packed & _LOW, bounds


def fingerprints(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit order-free hashes of each set."""
    out = []
    for seed in (0x1B873593, 0x85EBCA6B):
        sums = np.concatenate((np.zeros(1, U64), np.cumsum(mix(tokens ^ U64(seed << 20)))))
        out.append((sums[bounds[1:]] - sums[bounds[:-1]]).astype(np.int64))
    return out[0], out[1]


_A = (mix(np.arange(1, SKETCH + 1, dtype=U64) * U64(0xA24BAED4963EE407)) >> U64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(1, SKETCH + 1, dtype=U64) * U64(0x9FB21C651E98DF25)) >> U64(32)).astype(np.uint32)


def sketches(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Min-hash sketch (SKETCH times 16 bits) of each set; sets must not be empty."""
    t = mix(tokens).astype(np.uint32)
    out = np.empty((len(bounds) - 1, SKETCH), np.uint32)
    for k in range(SKETCH):
        out[:, k] = np.minimum.reduceat(t * _A[k] + _B[k], bounds[:-1])
    return (mix(out.astype(U64)) & U64(0xFFFF)).astype(np.uint16)


def stir(x: np.ndarray) -> np.ndarray:
    """Hash of uint64 values in place, good in its high bits."""
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(32)
    x *= U64(0x94D049BB133111EB)
    return x


def paths(tokens: np.ndarray, bounds: np.ndarray, threshold: float, runs: int, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """(set, path) of every path of ``levels`` tokens that each set follows in every run; sets must not be empty."""
    size = np.diff(bounds)
    cut = (np.minimum(1 / (threshold * np.maximum(size, 1)), 1.0) * float(1 << 53)).astype(U64)
    who, node = np.repeat(np.arange(len(size)), runs), np.tile(mix(np.arange(1, runs + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)), len(size))
    for level in range(1, levels + 1):
        got = []
        upto = np.cumsum(size[who])
        at = 0
        while at < len(who):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEP, side="right")))
            mine, n = who[at:to], size[who[at:to]]
            h = stir(np.repeat(node[at:to], n) ^ tokens[ragged(bounds[:-1][mine], n)])
            on = np.flatnonzero((h >> U64(11)) < np.repeat(cut[mine], n))
            got.append((np.repeat(mine, n)[on], mix(h[on] + U64(level))))
            at = to
        who, node = (np.concatenate(c) for c in zip(*got, strict=True)) if got else (who[:0], node[:0])
    return who, node


def small_passes(batches, column="text"):
    """Passes of at most 8192 texts."""
    for batch, texts in passes(batches, column):
        for a in range(0, len(texts), 8192):
            b = min(a + 8192, len(texts))
            lo, hi = texts.offsets[a], texts.offsets[b]
            yield batch.slice(a, b - a), Texts(texts.buf[lo:hi], texts.offsets[a : b + 1] - lo)


def groups_of(batches, key: int = 0):
    """Tables of the rows of one or more whole keys; rows arrive sorted by the key column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if held and keys[0] != held[-1].column(key)[held[-1].num_rows - 1].as_py():
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            held.append(batch.slice(0, last))
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def spanning_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) that connect the same nodes as the pairs do."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    on = label != np.arange(len(nodes))
    return nodes[on], nodes[label[on]]


def blocked(df: DataFrame, key: Column, blocks: Column, member: Column) -> DataFrame:
    """``df`` with group ``g`` and ``side``: groups of one block whole, others once for each pair of their blocks."""
    own = F.pmod(F.xxhash64(member, F.lit(17)), blocks).cast("int")
    one = F.array(F.struct(key.alias("g"), F.lit(0).cast("byte").alias("side")))
    other = F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.struct(F.xxhash64(key, F.least(own, x), F.greatest(own, x)).alias("g"), F.when(own == x, 0).when(own < x, 1).otherwise(2).cast("byte").alias("side")))
    return exploded(df, F.when(blocks <= 1, one).otherwise(other))


def exploded(df: DataFrame, groups: Column) -> DataFrame:
    return df.withColumn("gs", F.explode(groups)).withColumn("g", F.col("gs.g")).withColumn("side", F.col("gs.side")).drop("gs")


def arranged(df: DataFrame, rows: int, *order: str) -> DataFrame:
    """``df`` with whole groups in tasks, as many as the expected number of rows asks for, and in order."""
    least = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return df.repartition(max(least, rows // ROWS_A_TASK), "g").sortWithinPartitions("g", *order)


def join_ids(df: DataFrame, ids: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """Join with a narrow table of ids or hashes: broadcast where its counted size is bounded, a shuffle join beyond."""
    return df.join(F.broadcast(ids) if ids.count() * (16 + 8 * len(ids.columns)) <= BROADCAST_BYTES else ids, on, how)


def screen(threshold: float):
    """Spanning links (a, b) of the pairs of a group whose sketches and sizes allow the threshold.

    A group is compared with its first row, then the rows that this one does not reach with all others: the others need
    no second way to each other.
    """
    need = math.ceil((threshold - SCREEN) * SKETCH)

    def run(batches):
        for t in groups_of(batches):
            g, ids, n = (t.column(c).to_numpy() for c in range(3))
            sk = np.frombuffer(b"".join(t.column(3).to_pylist()), np.uint16).reshape(-1, SKETCH)
            cuts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
            got = []

            def near(i, j):
                ok = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9
                i, j = i[ok], j[ok]
                ok = (sk[i] == sk[j]).sum(1) >= need
                return i[ok], j[ok]

            def product(left, right, later):
                """Near pairs of ``left`` and ``right``; those of ``later`` once only."""
                step = max(1, 100_000 // max(len(right), 1))
                for a in range(0, len(left), step):
                    i, j = np.repeat(left[a : a + step], len(right)), np.tile(right, len(left[a : a + step]))
                    on = (i != j) & ((i < j) | ~later[j - lo])
                    i, j = near(i[on], j[on])
                    if len(i):
                        got.append(spanning_pairs(ids[i], ids[j]))

            # Small groups meet in one sweep; larger ones one by one.
            ends = np.append(cuts[1:], len(g))
            wide = ends - cuts > 32
            small = np.repeat(~wide, ends - cuts)
            many = np.where(small, np.repeat(ends, ends - cuts) - np.arange(len(g)) - 1, 0)
            upto = np.cumsum(many)
            at = 0
            while at < len(g):
                base = upto[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(upto, base + 200_000, side="right")))
                i, j = near(np.repeat(np.arange(at, to), many[at:to]), ragged(np.arange(at, to) + 1, many[at:to]))
                at = to
                if len(i):
                    got.append(spanning_pairs(ids[i], ids[j]))
            for lo, hi in zip(cuts[wide].tolist(), ends[wide].tolist(), strict=True):
                rows = np.arange(lo, hi)
                i, j = near(np.full(hi - lo - 1, lo), rows[1:])
                if len(i):
                    got.append(spanning_pairs(ids[i], ids[j]))
                rest = np.ones(hi - lo, bool)
                rest[j - lo] = rest[0] = False
                product(rows[rest], rows, rest)
            a, b = spanning_pairs(np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])) if got else (ids[:0], ids[:0])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def dense(sets: list[np.ndarray], known: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """0/1 rows over the tokens ``known[lo:hi]`` (sorted)."""
    out = np.zeros((len(sets), hi - lo), np.float32)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    token = np.concatenate(sets)
    at = np.searchsorted(known[lo:hi], token)
    on = known[lo:hi][np.minimum(at, hi - lo - 1)] == token
    out[row[on], at[on]] = 1
    return out


def shared_counts(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of ``left`` and ``right`` sets (of all ``left`` sets where ``right`` is None).

    Products over slices of the tokens that can be shared.
    """
    if right is None:
        token, times = np.unique(np.concatenate(left), return_counts=True)
        token = token[times > 1]
    else:
        token = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(left if right is None else right)), np.float32)
    width = max(256, min(4096, (4 << 20) // max(out.shape)))
    for a in range(0, len(token), width):
        b = min(a + width, len(token))
        x = dense(left, token, a, b)
        out += x @ (x if right is None else dense(right, token, a, b)).T
    return out


def verify(threshold: float):
    """Link counts and spanning links of all pairs of a group that reach the threshold on whole sets."""

    def run(batches):
        for t in groups_of(batches):
            g = t.column(0).to_numpy()
            cuts = np.append(np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))), len(g))
            side, ids, mult = (t.column(c).to_numpy() for c in (1, 2, 3))
            who, links, src, dst = [], [], [], []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                _, once = np.unique(ids[lo:hi], return_index=True)
                at = lo + np.sort(once)
                x = at if side[lo] == 0 else at[side[at] == 1]
                y = at if side[lo] == 0 else at[side[at] == 2]
                if not len(x) or not len(y) or len(at) < 2:
                    continue
                sets = {k: np.frombuffer(t.column(4)[k].as_py(), U64) for k in at.tolist()}
                a, b = [sets[k] for k in x.tolist()], None if side[lo] == 0 else [sets[k] for k in y.tolist()]
                both = shared_counts(a, b)
                n, m = np.array([len(s) for s in a], float), np.array([len(sets[k]) for k in y.tolist()], float)
                count_x, count_y = np.zeros(len(x)), np.zeros(len(y))
                for r in range(0, len(x), 256):  # in double, a few rows at a time
                    some = both[r : r + 256].astype(float)
                    ok = some / (n[r : r + 256, None] + m[None] - some) >= threshold
                    if b is None:
                        ok &= np.arange(len(y))[None] > np.arange(r, r + len(ok))[:, None]
                    i, j = np.nonzero(ok)
                    if len(i):
                        count_x[r : r + 256] += ok @ mult[y].astype(float)
                        count_y += mult[x[r : r + 256]].astype(float) @ ok
                        p, q = spanning_pairs(ids[x[r + i]], ids[y[j]])
                        src.append(p)
                        dst.append(q)
                for z, count in ((x, count_x), (y, count_y)):
                    who.append(ids[z[count > 0]])
                    links.append(count[count > 0].astype(np.int64))
            if src:
                w, n = np.concatenate(who), np.concatenate(links)
                a, b = spanning_pairs(np.concatenate(src), np.concatenate(dst))
                null = np.concatenate([np.ones(len(w), bool), np.zeros(len(a), bool)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([w, a])), pa.array(np.concatenate([n, np.zeros(len(a), np.int64)])), pa.array(np.concatenate([w, b]), mask=null)], names=["id", "links", "root"])

    return run


def with_sets(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """Every row of ``documents`` (doc_id, text, row) as (doc_id, f1, f2, n, row) with the fingerprints of its shingle set."""

    def run(batches):
        for batch, texts in small_passes(batches):
            tokens, bounds = shingle_sets(texts, words)
            f1, f2 = fingerprints(tokens, bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f1), pa.array(f2), pa.array(np.diff(bounds).astype(np.int32)), batch.column(2)], names=["doc_id", "f1", "f2", "n", "row"])

    kinds = {c: documents.schema[c].dataType.simpleString() for c in ("doc_id", "row")}
    return documents.select("doc_id", "text", "row").mapInArrow(run, f"doc_id {kinds['doc_id']}, f1 long, f2 long, n int, row {kinds['row']}")


def candidates(reps: DataFrame, threshold: float) -> DataFrame:
    """(key, comp): components of the sets (key, n, sketch, nodes) that some bucket allows to be near.

    Pairs of a bucket of at most ``BLOCK`` sets are screened by their sketches; larger ones are linked whole, at one row
    a set, and left to ``split_large``.
    """
    here, light = reps.select("key", F.explode("nodes").alias("node")), reps.select("key", "n", "sketch")
    counts = written(here.groupBy("node").agg(F.count("*").alias("c"), F.min("key").alias("head")).where("c > 1"), "jaccardbuckets")
    rows = counts.where(F.col("c") <= BLOCK).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    met = here.join(counts, "node")
    # Paths travel as two numbers each; only those that meet others get their sketch.
    small = met.where(F.col("c") <= BLOCK).join(light, "key").select(F.col("node").alias("g"), "key", "n", "sketch")
    edges = arranged(small, rows).mapInArrow(screen(threshold), "a long, b long")
    wide = met.where((F.col("c") > BLOCK) & (F.col("key") != F.col("head"))).select(F.col("key").alias("a"), F.col("head").alias("b")).distinct()
    comps = connected_components(edges.unionByName(wide))
    erase(counts)
    return comps.select(F.col("node").alias("key"), F.col("component").alias("comp"))


def rare_first(threshold: float):
    """(key, node, inner) of the rarest tokens of each set (key, comp, tokens, common): its prefix filter.

    ``common`` tells how common the tokens of each of ``KINDS`` hash classes are in the component. Two sets of sizes
    n <= m with a similarity of the threshold t share one of the n - ceil(2 t n / (1 + t)) + 1 rarest tokens of the
    smaller (``inner``) that is also among the m - ceil(t m) + 1 rarest of the larger, whatever the order is, as long as
    both use one.
    """

    def run(batches):
        for batch in batches:
            keys, nodes, inner = [], [], []
            for key, comp, raw, common in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                tokens = np.frombuffer(raw, U64)
                n = len(tokens)
                rank = np.frombuffer(common, np.uint8)[(tokens & U64(KINDS - 1)).astype(np.int64)] if common else np.zeros(n, np.uint8)
                first = tokens[np.lexsort((tokens, rank))[: n - math.ceil(threshold * n - 1e-9) + 1]]
                nodes.append(mix(first ^ mix(np.array([comp], np.int64).view(U64))).view(np.int64))
                keys.append(np.full(len(first), key))
                inner.append(np.arange(len(first)) < n - math.ceil(2 * threshold * n / (1 + threshold) - 1e-9) + 1)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(inner))], names=["key", "node", "inner"])

    return run


def as_table(batches):
    """(comp, common): the counts by class (comp, kinds, counts) as one byte for each class."""
    for batch in batches:
        raw = []
        for kinds, counts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            table = np.zeros(KINDS, np.uint8)
            table[kinds] = np.minimum(counts, 255)
            raw.append(table.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["comp", "common"])


def component_sizes(members: DataFrame) -> DataFrame:
    """(comp, blocks, c): how many blocks the exact comparison of each component of members (key, n, comp) takes."""
    return members.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / EXACT_BLOCK), F.ceil(F.sum(F.col("n").cast("long")) * 8 / EXACT_BYTES)).cast("int").alias("blocks"), F.count("*").alias("c"))


def split_large(members: DataFrame, tokens: DataFrame, large: DataFrame, threshold: float) -> DataFrame:
    """(key, comp) of the sets in ``large`` components that may still be near others, in components anew.

    ``tokens`` is (key, comp, n, tokens) of their members. Rows of a component that shares a template are told apart by
    what is theirs: sets are linked where they share a token of their prefixes, one row for each prefix token, never in
    pairs. The order of tokens comes from some sets of each component, which costs nothing but how well it separates;
    a component that falls apart is ordered and split again, one that does not is compared as it is.
    """
    out, rounds = None, 0
    todo, sizes = tokens, large
    while True:
        n_sets = F.greatest(F.lit(2), F.least(F.lit(ORDER_SETS), F.lit(ORDER_TOKENS) / F.col("mean"))).cast("int")
        mean = todo.groupBy("comp").agg(F.avg("n").alias("mean"))
        place = F.row_number().over(Window.partitionBy("comp").orderBy(F.xxhash64("key"), "key"))
        some = todo.select("comp", "key").withColumn("place", place).where(F.col("place") <= ORDER_SETS).join(mean, "comp").where(F.col("place") <= n_sets).select("key")
        seen = join_ids(todo, some, "key", "left_semi").mapInArrow(as_rows, "comp long, token long")
        kinds = seen.groupBy("comp", "token").agg(F.count("*").alias("c")).where("c > 1").groupBy("comp", F.col("token").bitwiseAND(KINDS - 1).cast("int").alias("kind")).agg(F.max("c").cast("int").alias("c"))
        both = kinds.groupBy("comp").agg(F.array_sort(F.collect_list(F.struct("kind", "c"))).alias("k")).select("comp", F.col("k.kind").alias("kinds"), F.col("k.c").alias("counts"))
        common = written(both.mapInArrow(as_table, "comp long, common binary"), "jaccardcommon")
        ordered = todo.join(F.broadcast(common) if common.count() * KINDS <= BROADCAST_BYTES else common, "comp", "left")
        prefixes = written(ordered.select("key", "comp", "tokens", "common").mapInArrow(rare_first(threshold), "key long, node long, inner boolean"), "jaccardprefixes")
        heads = prefixes.groupBy("node").agg(F.min("key").alias("head"), F.max("key").alias("last"), F.bool_or("inner").alias("inner")).where("inner and head <> last").select("node", "head")
        links = prefixes.join(heads, "node").where(F.col("key") != F.col("head")).select(F.col("key").alias("a"), F.col("head").alias("b")).distinct()
        again = connected_components(links).select(F.col("node").alias("key"), F.col("component").alias("new"))
        found = written(todo.select("key", "comp", "n").join(again, "key"), "jaccardsplit")
        erase(common, prefixes)
        rounds += 1
        done = found.select("key", F.col("new").alias("comp"))
        out = done if out is None else out.unionByName(done)
        per = component_sizes(found.select("key", "n", F.col("new").alias("comp"))).where("blocks > 1")
        was = found.groupBy("new").agg(F.first("comp").alias("comp")).join(sizes.select("comp", F.col("c").alias("was")), "comp").select(F.col("new").alias("comp"), "was")
        next_ = written(per.join(was, "comp").where(F.col("c") < 0.9 * F.col("was")).select("comp", "blocks", "c"), "jaccardagain")
        if rounds == SPLIT_ROUNDS or next_.isEmpty():
            return out
        ids = join_ids(found, next_.select(F.col("comp").alias("new")), "new", "left_semi").select("key", F.col("new").alias("comp"))
        out = join_ids(out, ids.select("key"), "key", "left_anti")
        todo = join_ids(todo.drop("comp"), ids, "key", "inner").select("key", "comp", "n", "tokens")
        sizes = next_


def as_rows(batches):
    """(comp, token) of every token of the sets (key, comp, n, tokens)."""
    for batch in batches:
        sets = [np.frombuffer(x, np.int64) for x in batch.column(batch.schema.get_field_index("tokens")).to_pylist()]
        if sets:
            comp = np.repeat(batch.column(batch.schema.get_field_index("comp")).to_numpy(), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(comp), pa.array(np.concatenate(sets))], names=["comp", "token"])


def near_documents(documents: DataFrame, threshold: float = 0.8, recall: float = 0.995, words: int = WORDS, sets: bool = False) -> DataFrame:
    """(doc_id, n_links, class_id, set_id, kept) of every row of ``documents`` (doc_id integer, text).

    ``class_id`` is the smallest doc_id reachable by links, ``set_id`` the smallest doc_id with an equal shingle set,
    ``n_links`` the number of other rows linked directly, ``kept`` whether doc_id is class_id.
    With ``sets`` also the row's shingle set (f1, f2, n) and its group of linked sets (component, null without words),
    which tell apart rows and groups that share an id.
    """
    idt = documents.schema["doc_id"].dataType
    if not isinstance(idt, IntegralType):
        raise TypeError(f"doc_id must be an integer, not {idt.simpleString()}")
    runs = runs_for(recall)
    docs = documents.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null")

    def describe(batches):
        for batch, texts in small_passes(batches):
            tokens, bounds = shingle_sets(texts, words)
            size = np.diff(bounds)
            some = np.flatnonzero(size)
            f1, f2 = fingerprints(tokens, bounds)
            tight = np.append(bounds[:-1][some], bounds[-1])
            rows = sketches(tokens, tight) if len(some) else np.zeros((0, SKETCH), np.uint16)
            who, node = paths(tokens, tight, threshold, runs)
            order = np.argsort(who, kind="stable")
            per = np.zeros(len(size) + 1, np.int64)
            per[1 + some] = np.bincount(who, minlength=len(some))
            wide = np.concatenate(([0], np.cumsum((size > 0) * 2 * SKETCH))).astype(np.int32)
            sketch = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(wide), pa.py_buffer(np.ascontiguousarray(rows))])
            nodes = pa.ListArray.from_arrays(pa.array(np.cumsum(per).astype(np.int32)), pa.array(node[order].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size.astype(np.int32)), pa.array(f1), pa.array(f2), sketch, nodes], names=["id", "n", "f1", "f2", "sketch", "nodes"])

    base = written(docs.mapInArrow(describe, "id long, n int, f1 long, f2 long, sketch binary, nodes array<long>"), "jaccard")
    full = base.where("n > 0")
    # One id may stand for several sets where rows repeat an id with other texts; sets are told apart by fingerprint.
    reps = full.groupBy("f1", "f2", "n").agg(F.min("id").alias("id"), F.count("*").alias("mult"), F.any_value("sketch").alias("sketch"), F.any_value("nodes").alias("nodes"))
    reps = written(reps.withColumn("key", F.xxhash64("f1", "f2", "n")), "jaccardsets")
    members = candidates(reps, threshold).join(reps.select("key", "id", "mult", "f1", "f2", "n"), "key")
    members = written(members, "jaccardmembers")

    def tokenised(batches):
        seen: set[tuple[int, int, int]] = set()
        for batch, texts in small_passes(batches):
            tokens, bounds = shingle_sets(texts, words)
            f1, f2 = fingerprints(tokens, bounds)
            # Rows that repeat an id and its text are one set: a task sends them once, or again after a long while.
            fresh = []
            for k, t in enumerate(zip(batch.column(0).to_pylist(), f1.tolist(), f2.tolist(), strict=True)):
                if t not in seen:
                    seen.add(t)
                    fresh.append(k)
            if len(seen) > 100_000:
                seen.clear()
            raw = [tokens[bounds[k] : bounds[k + 1]].tobytes() for k in fresh]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(fresh, pa.int64())), pa.array(f1[fresh]), pa.array(f2[fresh]), pa.array(raw, pa.binary())], names=["id", "f1", "f2", "tokens"])

    def sets_of(some: DataFrame) -> DataFrame:
        """(key, n, mult, comp, tokens) of the members ``some``, read from the texts again."""
        raw = join_ids(docs, some.select("id").distinct(), "id", "left_semi").mapInArrow(tokenised, "id long, f1 long, f2 long, tokens binary")
        return join_ids(raw, some.select("id", "f1", "f2", "n", "key", "mult", "comp"), ["id", "f1", "f2"], "inner").select("key", "n", "mult", "comp", "tokens")

    large = written(component_sizes(members).where("blocks > 1"), "jaccardlarge")
    tokens, held = sets_of(members), []
    if not large.isEmpty():
        # The sets of large components are kept until they have been split and compared.
        own = written(sets_of(join_ids(members, large.select("comp"), "comp", "left_semi")), "jaccardlargesets")
        again = written(split_large(members, own, large, threshold), "jaccardparts")
        rest = sets_of(join_ids(members, large.select("comp"), "comp", "left_anti"))
        tokens = rest.unionByName(join_ids(own.drop("comp"), again, "key", "inner").select("key", "n", "mult", "comp", "tokens"))
        members = members.join(large.select("comp"), "comp", "left_anti").select("key", "n", "comp").unionByName(members.select("key", "n").join(again, "key").select("key", "n", "comp"))
        held = [own, again]
    # Components of more than one block are few: their number of blocks is counted, all others have one.
    sizes = written(component_sizes(members).where("blocks > 1"), "jaccardblocks")
    rows = members.count() + sizes.agg(F.coalesce(F.sum(F.col("c") * (F.col("blocks") - 1)), F.lit(0))).first()[0]
    tokens = join_ids(tokens, sizes.select("comp", "blocks"), "comp", "left")
    pairs = blocked(tokens, F.col("comp"), F.coalesce("blocks", F.lit(1)), F.col("key")).select("g", "side", "key", "mult", "tokens")
    found = written(arranged(pairs, 20 * rows, "side").mapInArrow(verify(threshold), "id long, links long, root long"), "jaccardlinks")
    erase(large, sizes, *held)
    links = found.where("root is null").groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "key")
    comp = connected_components(found.where("root is not null").select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "key")
    joined = reps.select("key", "f1", "f2", "n", "id", "mult").join(links, "key", "left").join(comp, "key", "left")
    joined = joined.withColumn("component", F.coalesce("component", "key"))
    least = joined.groupBy("component").agg(F.min("id").alias("class"))
    more = ["f1", "f2", "n", "component"] if sets else []
    classes = joined.join(least, "component").select("f1", "f2", "n", *more[3:], F.col("id").alias("set_id"), F.col("class").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    out = full.select("id", "f1", "f2", "n").join(classes, ["f1", "f2", "n"]).select("id", "n_links", "class_id", "set_id", *more)
    empty = [F.lit(0).cast("long").alias("f1"), F.lit(0).cast("long").alias("f2"), F.lit(0).alias("n"), F.lit(None).cast("long").alias("component")] if sets else []
    alone = lambda df, c: df.select(F.col(c).cast("long").alias("id"), F.lit(0).cast("long").alias("n_links"), F.col(c).cast("long").alias("class_id"), F.col(c).cast("long").alias("set_id"), *empty)
    out = out.unionByName(alone(base.where("n = 0"), "id")).unionByName(alone(documents.where("doc_id is null"), "doc_id"))
    return out.select(F.col("id").cast(idt).alias("doc_id"), "n_links", F.col("class_id").cast(idt).alias("class_id"), F.col("set_id").cast(idt).alias("set_id"), F.col("id").eqNullSafe(F.col("class_id")).alias("kept"), *more)
