import numpy as np
import pytest

from tessera.llm import egojoin


def brute(rows, least=0.9):
    ok = {}
    for k, (_, v) in enumerate(rows):
        if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[k] = np.array(v, float) / np.linalg.norm(v)
    links = {k: [j for j in ok if j != k and len(ok[j]) == len(ok[k]) and ok[j] @ ok[k] >= least] for k in ok}
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        c = min(rows[j][0] for j in seen)  # smallest id of the component
        out.append((i, len(links.get(k, [])), c, i == c))
    return sorted(out)


@pytest.mark.parametrize("block, leaf", [(2048, 256), (2048, 4), (16, 4)])
def test_against_brute_force(spark, block, leaf):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 8))
    rows = [(int(i), (centres[rng.integers(12)] + 0.25 * rng.standard_normal(8)).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + k, rows[0][1]) for k in range(20)] + [(230, [0.0] * 8), (231, None), (232, [float("nan")] + [1.0] * 7), (233, [None] + [1.0] * 7), (234, [1.0, 2.0]), (235, [2.0, 4.0]), (236, []), (200, rows[0][1]), (240, [float("inf")] + [0.0] * 7)]
    rows += [(250, rows[3][1]), (250, [0.0] * 7 + [1.0]), (251, [-0.0] * 7 + [1.0]), (250, [5.0, 4.0, -3.0, 2.0, -1.0, 0.5, 3.0, -7.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, n_links string")
    got = sorted(map(tuple, egojoin.near_vectors(df, block=block, leaf=leaf).collect()))
    assert got == brute(rows)


def test_empty_and_null_ids(spark):
    schema = "vec_id int, embedding array<double>"
    assert egojoin.near_vectors(spark.createDataFrame([], schema)).count() == 0
    got = egojoin.near_vectors(spark.createDataFrame([(None, [1.0]), (1, [1.0])], schema)).orderBy("vec_id").collect()
    assert [tuple(r) for r in got] == [(None, 0, None, True), (1, 0, 1, True)]


def test_provably_distant_blocks_are_skipped():
    x = np.eye(4)
    assert not list(egojoin.join_intervals(x[:1], x[:1], x[1:2], x[1:2], 0.9, False)) and not egojoin.close(np.zeros(2), np.zeros(2), np.ones(2), np.ones(2), 0.2)


def test_tiles_of_blocks(spark, monkeypatch):
    """Blocks that are put together in tiles are joined as one by one; each travels once for every tile that it meets."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(900, 12))
    x[450:] = x[:450] + rng.normal(size=(450, 12)) * 0.12
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = []
    for tile in (1, 4):
        monkeypatch.setattr(egojoin, "TILE", tile)
        got.append(sorted(map(tuple, egojoin.near_vectors(df, block=16, leaf=8).collect())))
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    links = (u @ u.T >= 0.9).sum(1) - 1
    assert got[0] == got[1] and [r[1] for r in got[0]] == links.tolist() and links.sum() > 300
