"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors are rotated onto their principal directions (fitted on a bounded sample), laid on a grid of width
epsilon over the leading dimensions and sorted by cell. The sorted sequence is cut into blocks; only block pairs whose
bounding boxes are within epsilon are joined, and a block pair is joined recursively on halves of its intervals, down
to leaves. In a leaf, pairs whose leading coordinates prove them distant (the rest of two vectors adds no more than the
product of its lengths) are skipped too; the others are compared by cosine in double precision. Equal vectors are one
vector with a multiplicity first, so a vector that is very common costs one row.

Vectors without structure in their leading directions leave few blocks to skip: their work grows with the square of
the distinct vectors. A block travels once for each tile of blocks that it meets; tiles are as large as memory allows, so
that few copies travel.

Cases: vectors that are null, zero or hold null or non-finite components link with nothing and are components of their
own; vectors of different lengths never link; each row is a vector of its own, so repeated rows link with each other
and share an id, and rows that share an id but not a vector are told apart; rows with a null id link with nothing; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard import spanning_pairs
from .shared import connected_components, written

LEAD = 8
GRID = 4
#: Leading directions that the bound of a pair uses.
BOUND = 24
#: Vectors and bytes of a block.
BLOCK = 8192
BLOCK_BYTES = 4 << 20
LEAF = 512
#: Most blocks of a tile, which a task holds at once, and the most tasks that tiles are dealt to.
TILE = 4
MOST_TASKS = 100_000


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def principal(sample: np.ndarray, lead: int = BOUND) -> np.ndarray:
    """Orthonormal columns: the leading directions of the sample about its mean, at most ``lead``."""
    d = sample.shape[1]
    c = sample - sample.mean(0)
    _, vectors = np.linalg.eigh(c.T @ c + 1e-12 * np.eye(d))
    return vectors[:, ::-1][:, :lead]


def close(lo_a, hi_a, lo_b, hi_b, eps2: float) -> bool:
    """Whether two boxes are within the square root of ``eps2``."""
    gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float(gap @ gap) <= eps2


def join_intervals(x: np.ndarray, px: np.ndarray, y: np.ndarray, py: np.ndarray, least: float, same: bool, leaf: int = LEAF):
    """Index pairs (i, j) of rows of ``x`` and ``y`` with cosine >= ``least``, a leaf at a time; once each if ``same``.

    ``px`` and ``py`` are leading coordinates of the unit vectors on orthonormal directions.
    """
    eps2 = 2 - 2 * least + 1e-9
    rest = lambda p: np.sqrt(np.maximum(0, 1 - (p * p).sum(1))).astype(np.float32)[:, None]
    ax, ay = (np.concatenate([p.astype(np.float32), rest(p)], axis=1) for p in (px, py))
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if same and d <= a or a >= b or c >= d:
            continue
        if not close(px[a:b].min(0), px[a:b].max(0), py[c:d].min(0), py[c:d].max(0), eps2):
            continue
        if b - a <= leaf and d - c <= leaf:
            i, j = np.nonzero(ax[a:b] @ ay[c:d].T >= np.float32(least - 1e-4))
            i, j = i + a, j + c
            if same:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 1 << 16):
                p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                on = np.einsum("rd,rd->r", x[p], y[q]) >= least
                if on.any():
                    yield p[on], q[on]
        elif b - a >= d - c:
            m = (a + b) // 2
            todo += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            todo += [(a, b, c, m), (a, b, m, d)]


def near_vectors(embeddings: DataFrame, least: float = 0.9, sample: int = 2000, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``embeddings`` (vec_id, embedding).

    ``sample`` bounds the vectors that fit the principal directions; all rows are joined. Blocks hold at most ``block``
    rows and ``BLOCK_BYTES``, intervals of at most ``leaf`` rows are compared pair by pair.
    """
    spark = embeddings.sparkSession
    single = embeddings.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "float" if single else "double"
    # Both zeros are one value; rows meet by the hash of their vector, vectors travel once.
    vector = F.transform(F.col("embedding").cast(f"array<{kind}>"), lambda x: x + F.lit(0).cast(kind))
    rows = embeddings.select("vec_id", vector.alias("embedding"))
    stored = np.float32 if single else np.float64  # blocks carry the values as they are; cosines are double all the same
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    valid = F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull()
    rows = rows.withColumn("key", F.when(valid, F.xxhash64("embedding"))).withColumn("more", F.when(valid, F.hash("embedding")))
    good = rows.where("key is not null")
    reps = good.groupBy("key", "more").agg(F.min("vec_id").cast("long").alias("id"), F.count("*").alias("mult"), F.any_value("embedding").alias("embedding"))
    reps = written(reps, "egoreps")
    n, width = reps.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    block = max(2, min(block, BLOCK_BYTES // (width * stored().itemsize)))
    fit: dict[int, np.ndarray] = {}
    for r in reps.orderBy(F.xxhash64("key"), "key").limit(sample).groupBy(F.size("embedding").alias("d")).agg(F.collect_list("embedding").alias("v")).toLocalIterator():
        fit[r.d] = principal(unit(np.array(r.v, float)))

    def project(x: np.ndarray) -> np.ndarray:
        d = x.shape[1]
        p = x @ fit.get(d, np.eye(d)[:, :BOUND])
        return np.pad(p, ((0, 0), (0, max(0, LEAD - p.shape[1]))))

    eps = (2 - 2 * least) ** 0.5

    def cells(batches):
        for batch in batches:
            vectors = batch.column(0)
            size = np.array(vectors.value_lengths())
            grid = np.zeros((batch.num_rows, GRID), np.int64)
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                x = np.array(vectors.take(pa.array(at)).flatten(), float).reshape(-1, d)
                grid[at] = np.floor(project(unit(x))[:, :GRID] / eps)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size, pa.int32()), *(pa.array(grid[:, k]) for k in range(GRID))], names=[*batch.schema.names, "d", *(f"c{k}" for k in range(GRID))])

    order = ["d", *(f"c{k}" for k in range(GRID)), "key"]
    laid = reps.select("embedding", "key", "mult").mapInArrow(cells, f"embedding array<{kind}>, key long, mult long, d int, " + ", ".join(f"c{k} long" for k in range(GRID)))
    laid = laid.repartitionByRange(max(1, n // (4 * block)), *order).sortWithinPartitions(*order)

    def blocks(batches):
        part, serial = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        width = 0

        def flush():
            nonlocal held, serial
            keys, mult, x = (np.concatenate(c) for c in zip(*held, strict=True))
            p = project(unit(x.astype(float)))[:, :LEAD]
            grid = np.unique(np.floor(p[:, :2] / eps).astype(np.int64), axis=0)
            out = {"block": [part << 24 | serial], "d": [width], "lo": [p.min(0).tolist()], "hi": [p.max(0).tolist()], "cells": [[f"{a},{b}" for a, b in grid.tolist()]], "keys": [keys.tobytes()], "mult": [mult.tobytes()], "vectors": [x.tobytes()]}
            held, serial = [], serial + 1
            return pa.RecordBatch.from_pydict(out, schema=block_schema)

        for batch in batches:
            size = np.array(batch.column(3))
            at = 0
            while at < batch.num_rows:
                if held and size[at] != width:
                    yield flush()
                width = int(size[at])
                run = int(np.argmax(size[at:] != width)) if (size[at:] != width).any() else batch.num_rows - at
                take = min(run, block - sum(len(h[0]) for h in held))
                piece = batch.slice(at, take)
                x = np.array(piece.column(0).flatten(), stored).reshape(-1, width)
                held.append((np.array(piece.column(1)), np.array(piece.column(2)), x))
                at += take
                if sum(len(h[0]) for h in held) >= block:
                    yield flush()
        if held:
            yield flush()

    block_schema = pa.schema([("block", pa.int64()), ("d", pa.int32()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("cells", pa.list_(pa.string())), ("keys", pa.binary()), ("mult", pa.binary()), ("vectors", pa.binary())])
    spec = "block long, d int, lo array<double>, hi array<double>, cells array<string>, keys binary, mult binary, vectors binary"
    cut = written(laid.mapInArrow(blocks, spec), "egoblocks")

    meta = cut.select("block", "d", "lo", "hi", "cells")
    left = meta.select(F.col("block").alias("a"), F.col("d").alias("da"), F.col("lo").alias("la"), F.col("hi").alias("ha"), F.explode("cells").alias("cell"))
    split = F.transform(F.split("cell0", ","), lambda x: x.cast("long"))
    right = meta.select(F.col("block").alias("b"), F.col("d").alias("db"), F.col("lo").alias("lb"), F.col("hi").alias("hb"), F.explode("cells").alias("cell0")).withColumn("g", split)
    near = F.array(*(F.concat((F.col("g")[0] + i).cast("string"), F.lit(","), (F.col("g")[1] + j).cast("string")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    right = right.select("b", "db", "lb", "hb", F.explode(near).alias("cell")).dropDuplicates(["b", "cell"])
    gaps = F.zip_with(F.zip_with("la", "hb", lambda x, y: x - y), F.zip_with("lb", "ha", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    dist = F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x * x)
    pairs = left.join(right, "cell").where((F.col("a") <= F.col("b")) & (F.col("da") == F.col("db"))).where(dist <= eps * eps + 1e-9).select("a", "b").distinct()

    pairs = written(pairs, "egopairs")
    # Blocks that follow one another form a tile; a pair of tiles is a group, in which each block stands once. So a block
    # travels once for each tile that it meets, and the number of groups falls with the square of the tile.
    least_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    side = max(1, min(TILE, int(cut.count() / (4 * least_tasks) ** 0.5)))  # few blocks are not put together, or cores would idle
    tile = lambda c: F.shiftleft(F.shiftright(c, 24), 20) + F.floor(F.col(c).bitwiseAND((1 << 24) - 1) / side)
    tiled = pairs.select(tile("a").alias("ta"), tile("b").alias("tb"), "a", "b")
    first = tiled.select("ta", "tb", F.lit(0).alias("side"), F.col("a").alias("block"), F.lit(None).cast("array<bigint>").alias("mates"))
    second = tiled.select("ta", "tb", "b", F.array("a").alias("mates"))
    if side > 1:  # else each pair of blocks is a group of its own already
        first = first.dropDuplicates(["ta", "tb", "block"])
        second = tiled.groupBy("ta", "tb", "b").agg(F.sort_array(F.collect_list("a")).alias("mates"))
    second = second.select("ta", "tb", F.lit(1).alias("side"), F.col("b").alias("block"), "mates")
    parts = max(least_tasks, min(pairs.count() // (side * side), MOST_TASKS))
    tasks = first.unionByName(second).join(cut.select("block", "d", "keys", "mult", "vectors"), "block").select("ta", "tb", "side", "block", "d", "mates", "keys", "mult", "vectors")
    tasks = tasks.repartition(parts, "ta", "tb").sortWithinPartitions("ta", "tb", "side", "block")

    def link(batches):
        group, held = None, {}
        for batch in batches:
            for r in range(batch.num_rows):
                ta, tb, side, at, d = (batch.column(c)[r].as_py() for c in range(5))
                if (ta, tb) != group:
                    group, held = (ta, tb), {}
                keys, mult = (np.frombuffer(batch.column(c)[r].as_py(), np.int64) for c in (6, 7))
                v = unit(np.frombuffer(batch.column(8)[r].as_py(), stored).reshape(-1, d).astype(float))
                y = (keys, mult.astype(float), v, project(v))
                if side == 0:
                    held[at] = y
                    continue
                for mate in batch.column(5)[r].as_py():
                    x = held[mate]
                    near_x, near_y = np.zeros(len(x[0])), np.zeros(len(keys))
                    ends = []
                    for i, j in join_intervals(x[2], x[3], y[2], y[3], least, mate == at, leaf):
                        near_x += np.bincount(i, weights=y[1][j], minlength=len(near_x))
                        near_y += np.bincount(j, weights=x[1][i], minlength=len(near_y))
                        ends.append(spanning_pairs(x[0][i], keys[j]))
                    if ends:
                        who, links = np.concatenate([x[0], keys]), np.concatenate([near_x, near_y]).astype(np.int64)
                        on = links > 0
                        s, t = spanning_pairs(np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends]))
                        null = np.concatenate([np.ones(int(on.sum()), bool), np.zeros(len(s), bool)])
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([who[on], s])), pa.array(np.concatenate([links[on], np.zeros(len(s), np.int64)])), pa.array(np.concatenate([who[on], t]), mask=null)], names=["key", "links", "root"])

    found = written(tasks.mapInArrow(link, "key long, links long, root long"), "egolinks")
    links = found.where("root is null").groupBy("key").agg(F.sum("links").alias("links"))
    comp = connected_components(found.where("root is not null").select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "key")
    joined = reps.select("key", "more", "id", "mult").join(links, "key", "left").join(comp, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least_id = joined.groupBy("component").agg(F.min("id").alias("component_id"))
    classes = joined.join(least_id, "component").select("key", "more", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id")
    idt = embeddings.schema["vec_id"].dataType
    out = good.select("vec_id", "key", "more").join(classes, ["key", "more"]).select("vec_id", "n_links", F.col("component_id").cast(idt).alias("component_id"))
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
