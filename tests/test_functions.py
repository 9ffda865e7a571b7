import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ebbtide.functions import forgetting as fg
from ebbtide.functions.grids import dct_basis, dct_lowpass, depth_to_cells, gaussian_smooth, side_of
from ebbtide.functions.names import age_in_name, extension, stem
from ebbtide.operators import metrics, sampling
from ebbtide.operators.selection import best_factor


@given(st.floats(0, 1e6))
@settings(max_examples=100)
def test_best_factor_and_its_inverse(rho):
    f = best_factor(rho)
    assert 0 < f <= 1
    if 1e-6 < rho < 1e4:
        assert (f * f + 1) / f - 2 == pytest.approx(rho, rel=1e-6)


def test_factor_columns(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 1.0), (0.5, 1.0), (1e9, 1.0)], "e double, r double")
    assert [r[0] for r in df.select(fg.factor_from_innovation(F.col("e"), F.col("r"))).collect()] == [1.0, pytest.approx(best_factor(1.0)), 1.0, 0.05]
    floor = spark.createDataFrame([([4.0, 2.0, 1.0],), ([],)], "e array<double>").select(fg.noise_floor(F.col("e")))
    assert [r[0] for r in floor.collect()] == [2.0, None]


def test_dct_basis_is_orthonormal_and_full_pass_keeps_the_grid():
    assert np.allclose(dct_basis(8, 8).T @ dct_basis(8, 8), np.eye(8))
    grid = np.arange(16.0).reshape(4, 4)
    assert np.allclose(dct_lowpass(grid, 4), grid)
    assert np.allclose(dct_lowpass(grid, 99), grid)
    assert np.allclose(dct_lowpass(grid, 0), grid.mean())


def test_gaussian_against_plain_loops():
    rng = np.random.default_rng(0)
    grid, sigma = rng.random((6, 6)), 0.8
    radius = int(np.ceil(3 * sigma))
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    w /= w.sum()
    out = np.zeros((6, 6))
    for y in range(6):
        for x in range(6):
            for a in range(-radius, radius + 1):
                for b in range(-radius, radius + 1):
                    if 0 <= y + a < 6 and 0 <= x + b < 6:
                        out[y, x] += w[a + radius] * w[b + radius] * grid[y + a, x + b]
    assert np.allclose(gaussian_smooth(grid, sigma), out * grid.sum() / out.sum())
    assert np.array_equal(gaussian_smooth(np.zeros((3, 3)), 1.0), np.zeros((3, 3)))


def test_depth_cells():
    assert np.allclose(depth_to_cells(np.full((5, 7), 2.5), 8, 16), 2.5)
    assert np.allclose(depth_to_cells(np.kron(np.arange(4.0).reshape(2, 2), np.ones((4, 4))), 8, 4), [0, 1, 2, 3])
    with pytest.raises(ValueError):
        depth_to_cells(np.ones((4, 4)), 9, 16)
    with pytest.raises(ValueError):
        side_of(10)


def test_names(spark):
    df = spark.createDataFrame([("/a/25_0_1_2017.jpg",), ("/a/x_y_30_m.JPG",), ("/a/bad.png",), ("/a/.hidden",), ("b.tar.gz",)], "p string")
    p = F.col("p")
    rows = df.select(stem(p), extension(p), age_in_name("utkface", p), age_in_name("agedb", p), age_in_name("other", p)).collect()
    assert [tuple(r) for r in rows] == [("25_0_1_2017", "jpg", 25.0, 1.0, None), ("x_y_30_m", "jpg", None, 30.0, None), ("bad", "png", None, None, None), (".hidden", "", None, None, None), ("b.tar", "gz", None, None, None)]


@pytest.mark.parametrize("n", [0, 1, 3, 7, 10, 11])
def test_tertiles_leave_the_rest_to_the_last(spark, n):
    df = spark.createDataFrame([(i, (i * 7) % 5) for i in range(n)], "id int, c int")
    bins = {r["id"]: r["bin"] for r in sampling.count_bins(df, "c", "id").collect()}
    order = sorted(range(n), key=lambda i: ((i * 7) % 5, i))
    assert bins == {i: 0 if k < n // 3 else 1 if k < 2 * n // 3 else 2 for k, i in enumerate(order)}


def test_ranks_with_ties_nulls_and_many_ranges(spark, monkeypatch):
    rows = [(None if i % 11 == 0 else i % 3, i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(5)
    monkeypatch.setattr(sampling, "ROWS_A_RANGE", 30)
    got = [tuple(r) for r in sampling.with_global_rank(df, ["a", "b"]).orderBy("rank").select("a", "b", "rank", "n").collect()]
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == [(*r, k, 500) for k, r in enumerate(want, 1)]


def test_positions_within_keys(spark):
    rows = [(None if i % 5 == 0 else i % 2, i) for i in range(101)]
    got = {(r["k"], r["v"]): r["position"] for r in sampling.with_position(spark.createDataFrame(rows, "k int, v int"), ["k"], "v").collect()}
    want = {}
    for k in (None, 0, 1):
        want |= {(k, v): p for p, v in enumerate(sorted(v for j, v in rows if j == k))}
    assert got == want


def test_chunks_drop_the_remainder(spark):
    df = spark.createDataFrame([(i,) for i in range(23)], "id int")
    rows = sampling.equal_chunks(df, ["id"], 3).orderBy("id").collect()
    assert [(r["id"], r["chunk"], r["split"]) for r in rows] == [(i, i // 7, "train" if i % 7 < 5 else "test") for i in range(21)]


def test_seeded_splits():
    import random

    train, test = sampling.share_split(100, 0.8, 42, "scores")
    order = np.random.default_rng(42).permutation(100).tolist()
    assert (test, train) == (order[:19], order[19:])  # 100 * (1 - 0.8) is below 20
    train, test = sampling.share_split(10, 0.8, 1, "quality")
    order = np.random.default_rng(1).permutation(10).tolist()
    assert (train, test) == (sorted(order[:8]), sorted(order[8:]))
    shuffled = list(range(10))
    random.Random(12345).shuffle(shuffled)
    train, test = sampling.share_split(10, 0.8, 0, "ages")
    assert test == shuffled[:1] and train == shuffled[1:]
    assert len(sampling.share_split(15, 0.7, 0, "counts")[1]) == 5
    assert sampling.sample_positions(5, 9, 0) == [0, 1, 2, 3, 4]
    assert sampling.sample_positions(9, 3, 44) == sorted(np.random.default_rng(44).choice(9, size=3, replace=False).tolist())
    with pytest.raises(ValueError):
        sampling.share_split(3, 0.5, 0, "other")


def test_picked_positions_keep_their_order(spark):
    df = spark.createDataFrame([(i, f"r{i}") for i in range(5)], "position int, v string")
    assert [r["v"] for r in sampling.pick_positions(df, [3, 0, 4]).orderBy("stream_order").collect()] == ["r3", "r0", "r4"]


def test_bands(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (float("nan"),), (None,)], "v double")
    v = F.col("v")
    assert [tuple(r) for r in df.select(sampling.band(v, 0, 2, True), sampling.band(v, 0, 2, False)).collect()] == [(True, True), (True, True), (True, False), (False, False), (None, None)]


def test_task_summary_matches_dense_matrix(spark):
    m = np.array([[2.0, np.nan, np.nan], [3.0, 1.0, np.nan], [4.0, 0.5, 6.0]])
    df = spark.createDataFrame([(t, i, float(m[t, i])) for t in range(3) for i in range(3)], "t int, i int, value double")
    r = metrics.task_summary(df).first()
    assert tuple(r) == pytest.approx((3.5, np.mean([(2 - 4) / 2, (1 - 0.5) / 1]), 4.0, 6.0))
    assert metrics.task_summary(df.where("t = 0")).first()["nbwt"] == 0.0


def test_argmin_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 0), ("a", 0.5, 1.0, 1), ("a", 0.2, 1.0, 2), ("a", 0.1, float("nan"), 3)], "k string, f double, o double, p int")
    assert metrics.argmin(df, ["k"], "f", "o", "p").first()["best_f"] == 0.5


def test_verdicts(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.48), (0.5, 0.4, 0.49), (0.5, 0.4, 0.6)], "b double, o double, a double")
    assert [r[0] for r in df.select(metrics.adaptive_verdict(F.col("b"), F.col("o"), F.col("a"))).collect()] == ["good", "far from the best fixed factor", "worse than full memory"]
