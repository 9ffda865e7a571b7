import numpy as np
import pyarrow as pa
import pytest

from ebbtide.llm import ann as A

SCHEMA = "vec_id long, embedding array<float>, label int, part int"


def exact(ids, x, k=10):
    out = {}
    for q in sorted({i for i in ids if i % 100 == 0}):
        at = min((tuple(v), p) for p, (i, v) in enumerate(zip(ids, x.tolist(), strict=True)) if i == q)[1]
        d = np.sqrt(np.square(x - x[at]).sum(1))
        order = [p for p in np.lexsort([ids, d]) if ids[p] != q][:k]
        out[q] = [(int(ids[p]), float(d[p])) for p in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def frame(spark, ids, x):
    vectors = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1), pa.float32()), x.shape[1]).cast(pa.list_(pa.float32()))
    kept = {"vec_id": pa.array(ids, pa.int64()), "embedding": vectors, "label": pa.array([0] * len(ids), pa.int32()), "part": pa.array([1] * len(ids), pa.int32())}
    return spark.createDataFrame(pa.table(kept))


def recall(got, want):
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def test_tables_with_few_candidates_give_all(spark):
    x = np.random.default_rng(0).standard_normal((300, 8)).astype(np.float32).astype(float)
    ids = np.arange(300)
    for n in (1, 2, 4, 10, 11):
        want = {q: v for q, v in exact(ids[:n], x[:n]).items() if v}
        assert found(A.nearest_neighbours(frame(spark, ids[:n], x[:n]))) == want
    got = A.nearest_neighbours(frame(spark, np.array([0] * 40 + list(range(1, 6))), np.concatenate([x[:40], x[50:55]]))).collect()
    assert sorted(r["vec_id"] for r in got) == [1, 2, 3, 4, 5]  # forty rows of the query's own id take no place
    assert recall(found(A.nearest_neighbours(frame(spark, ids, x))), exact(ids, x)) >= 0.9


def test_ties_copies_and_hot_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 4)).astype(np.float32).astype(float)
    x[50:200] = x[0]
    ids = np.arange(400)
    got, want = found(A.nearest_neighbours(frame(spark, ids, x))), exact(ids, x)
    assert got[0] == want[0] == [(i, 0.0) for i in range(50, 60)] and got[100] == want[100]
    assert recall(got, want) >= 0.9


def test_rows_that_take_no_part(spark):
    good = [1.0, 2.0]
    rows = [(0, good), (1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []), (7, [1.0, 2.0, 3.0]), (8, [2.0, 2.0]), (None, good), (100, [0.0, 0.0]), (200, None)]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA)
    assert found(A.nearest_neighbours(df)) == {0: [(8, 1.0)]}
    assert A.nearest_neighbours(df.limit(0)).count() == 0


def test_repeated_rows(spark):
    df = spark.createDataFrame([(0, [1.0], 0, 0), (0, [5.0], 0, 0), (1, [2.0], 0, 0), (1, [2.0], 0, 0)], SCHEMA)
    assert found(A.nearest_neighbours(df)) == {0: [(1, 1.0), (1, 1.0)]}


def clustered(n, width, clusters, seed=2, spread=0.3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, width))
    if clusters:
        x = spread * x + rng.standard_normal((clusters, width))[rng.integers(0, clusters, n)]
    return x.astype(np.float32).astype(float)


@pytest.mark.parametrize("clusters", [0, 40])
def test_recall_with_two_levels_of_parts_and_many_blocks(spark, monkeypatch, clusters):
    monkeypatch.setattr(A, "BLOCK_ROWS", 50)
    monkeypatch.setattr(A, "PART_ROWS", 60)
    monkeypatch.setattr(A, "TOP_PARTS", 8)
    monkeypatch.setattr(A, "SAMPLE_ROWS", 1500)
    x = clustered(6000, 16, clusters)
    ids = np.arange(6000)
    got, want = found(A.nearest_neighbours(frame(spark, ids, x))), exact(ids, x)
    assert recall(got, want) >= 0.9
    for q, near in got.items():
        assert all(s == pytest.approx(float(np.sqrt(np.square(x[i] - x[q]).sum())), abs=0) for i, s in near)


@pytest.mark.parametrize("clusters,most", [(0, 0.95), (200, 0.1)])
def test_recall_and_share_with_the_real_constants(spark, clusters, most):
    x = clustered(20_500, 64, clusters)
    ids = np.arange(len(x))
    rows = A.usable(frame(spark, ids, x)).cache()
    index = A.build_index(rows, 64, len(x), A.Scratch(spark))
    assert index.router.parts == 21 and index.sizes.sum() == len(x)
    assert index.share <= most
    assert recall(found(A.nearest_neighbours(frame(spark, ids, x))), exact(ids, x)) >= 0.9


def test_parts_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(A, "PART_ROWS", 20)
    monkeypatch.setattr(A, "TOP_PARTS", 8)
    x = clustered(4000, 4, 30)
    parts = []
    for n in (400, 1600, 4000):
        rows = A.usable(frame(spark, np.arange(n), x[:n]))
        index = A.build_index(rows, 4, n, A.Scratch(spark))
        parts.append(index.router.parts)
        assert index.sizes.sum() == n and 0 < index.share <= 1.01
    assert parts[0] >= 15 and parts[1] >= 60 and parts[2] >= 150


def test_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal((100, 4)) + 20 * np.eye(4)[k] for k in range(4)])
    part = A.balanced_parts(x, A.neighbour_graph(x), 4)
    assert np.bincount(part, minlength=4).max() <= 110
    assert (part[A.neighbour_graph(x)] == part[:, None]).mean() > 0.95


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got, want = found(A.op4_nearest_neighbours(spark, sf_dir)), exact(ids, x)
    assert recall(got, want) >= 0.9
