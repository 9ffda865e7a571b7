"""Experiments against a sequential version in NumPy, written from the definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.functions.grids import target_transform
from ebbtide.functions.vectors import projection_matrix
from ebbtide.operators.selection import GRID, best_factor, first_smallest
from ebbtide.plans import registry
from ebbtide.plans.experiments import Experiment, best_factors, compare_scalar, summaries, transform_targets
from ebbtide.sources.synthetic import drifting_domains

LAM, ALPHA = 10.0, 0.25


@pytest.fixture(scope="module")
def rows(spark):
    return drifting_domains(spark, domains=3, width=5, patches=9, images=12).cache()


@pytest.fixture(scope="module")
def data(rows):
    found = {}
    for r in rows.orderBy("domain_id", "split", "ord", "patch_id").collect():
        found.setdefault((r["domain_id"], r["split"]), {}).setdefault(r["ord"], []).append((r["x"], r["y"]))
    return {k: [(np.array([p[0] for p in v[o]]), np.array([p[1] for p in v[o]])) for o in sorted(v)] for k, v in found.items()}


def bias(x):
    return np.column_stack([x, np.ones(len(x))])


class Sequential:
    """R and C decayed in place at every boundary."""

    def __init__(self, d):
        self.r, self.c = np.zeros((d + 1, d + 1)), np.zeros(d + 1)

    def boundary(self, f):
        self.r *= f
        self.c *= f

    def add(self, x, y):
        a = bias(x)
        self.r += a.T @ a
        self.c += a.T @ y

    def solve(self):
        self.w = np.linalg.solve(self.r + LAM * np.eye(len(self.c)), self.c)
        return self.w


def run_sequential(data, factors, mode, norm, target="raw"):
    """(t, i) -> (mae, rel)."""
    smooth, patch, image, out = target_transform(target), Sequential(5), Sequential(5), {}
    scales = [max(np.mean([y.sum() for _, y in data[d, "train"]]), 1e-6) if norm == "mean" else 1.0 for d in range(3)]
    for t in range(3):
        patch.boundary(factors[t])
        image.boundary(factors[t])
        for x, y in data[t, "train"]:
            patch.add(x, smooth(y) / scales[t])
            image.add(x.mean(0, keepdims=True), np.array([y.sum() / scales[t]]))
        wp, wi = patch.solve(), image.solve()
        for i in range(t + 1):
            pred, truth = [], []
            for x, y in data[i, "test"]:
                p = np.maximum(bias(x) @ wp, 0).sum()
                q = max((bias(x.mean(0, keepdims=True)) @ wi)[0], 0)
                pred.append(max((ALPHA * p + (1 - ALPHA) * q) * scales[i], 0))
                truth.append(y.sum())
            mae = np.mean(np.abs(np.array(pred) - truth))
            out[t, i] = mae, mae / max(np.mean(truth), 1e-6)
    return out


def as_dict(df, *keys):
    return {tuple(r[k] for k in keys): (r["mae"], r["rel"]) for r in df.collect()}


@pytest.mark.parametrize("target", ["raw", "dct2", "gauss1.0"])
def test_sweep_from_one_scan_equals_sequential_training(rows, data, target):
    matrix = Experiment(rows, LAM, ALPHA, target).sweep((1.0, 0.5), ("none", "mean"))
    got = as_dict(matrix, "norm", "forget", "t", "i")
    for norm in ("none", "mean"):
        for f in (1.0, 0.5):
            for (t, i), want in run_sequential(data, [f] * 3, None, norm, target).items():
                assert got[norm, f, t, i] == pytest.approx(want, rel=1e-8)


def test_a_factor_for_each_boundary(rows, data):
    x = Experiment(rows, LAM, ALPHA)
    got = as_dict(x.evaluate(x.fixed([1.0, 0.3, 0.9], label="own")), "t", "i")
    assert got == {k: pytest.approx(v, rel=1e-8) for k, v in run_sequential(data, [1.0, 0.3, 0.9], None, "mean").items()}


def test_full_memory_equals_joint_training(rows, data):
    x = Experiment(rows, LAM, ALPHA)
    joint = Sequential(5)
    for d in range(3):
        for a, y in data[d, "train"]:
            joint.add(a, y)
    assert np.allclose(x.fixed(1.0, "none")[-1].patch, joint.solve())


def test_statistics_do_not_depend_on_partitions(rows):
    a, b = (Experiment(rows.repartition(n), LAM).patch_statistics("none") for n in (1, 7))
    assert all(np.allclose(p.r, q.r) and np.allclose(p.c, q.c) and p.n == q.n for p, q in zip(a, b, strict=True))


def test_held_out_selection(rows, data):
    fit, held, scales = [], [], []
    for d in range(3):
        scales.append(np.mean([y.sum() for _, y in data[d, "train"]]))
        parts = [Sequential(5), []]
        for k, (x, y) in enumerate(data[d, "train"]):
            if k % 5 == 4:
                parts[1].append((bias(x), y / scales[d]))
            else:
                parts[0].add(x, y / scales[d])
        fit.append(parts[0])
        held.append((np.concatenate([a for a, _ in parts[1]]), np.concatenate([b for _, b in parts[1]])))
    want = [1.0]
    for t in (1, 2):
        errors = []
        for f in GRID:
            r = sum(f ** (t - d) * fit[d].r for d in range(t + 1)) + LAM * np.eye(6)
            w = np.linalg.solve(r, sum(f ** (t - d) * fit[d].c for d in range(t + 1)))
            errors.append(np.mean([np.mean((held[d][0] @ w - held[d][1]) ** 2) for d in range(t + 1)]))
        want.append(first_smallest(GRID, errors)[0])
    assert Experiment(rows, LAM).held_out_selection() == want


def test_innovation_selection(rows, data):
    x = Experiment(rows, LAM)
    factors, ratios = x.innovation_selection()
    head, s = Sequential(5), x.scales
    for t in range(3):
        if t:
            own = Sequential(5)
            for a, y in data[t, "train"]:
                own.add(a, y / s[t])
            own.solve()
            energy = lambda w: np.mean([np.mean((bias(a) @ w - y / s[t]) ** 2) for a, y in data[t, "train"]])  # noqa: E731, B023
            rho = max(energy(head.w) - energy(own.w), 0) / max(energy(own.w), 1e-12)
            assert ratios[t] == pytest.approx(rho, rel=1e-6)
            assert factors[t] == pytest.approx(np.clip(best_factor(rho), 0.05, 1.0), rel=1e-6)
        head.boundary(factors[t])
        for a, y in data[t, "train"]:
            head.add(a, y / s[t])
        head.solve()


def test_noise_floor_log(rows, data):
    log, head, floor = Experiment(rows, LAM).noise_floor_selection(), Sequential(5), None
    for t, entry in enumerate(log):
        energy = lambda: np.mean(np.concatenate([(bias(a) @ head.w - y) ** 2 for a, y in data[t, "train"]]))  # noqa: E731, B023
        f = 1.0
        if t:
            assert entry["innovation"] == pytest.approx(energy(), rel=1e-8)
            f = np.clip(best_factor(max(energy() - floor, 0) / max(floor, 1e-12)), 0.05, 1.0)
        assert entry["forget"] == pytest.approx(f)
        head.boundary(f)
        for a, y in data[t, "train"]:
            head.add(a, y)
        head.solve()
        floor = energy() if floor is None else 0.5 * floor + 0.5 * energy()
        assert entry["noise_floor"] == pytest.approx(floor, rel=1e-8)


def scalar(data, split):
    return {d: (np.array([x.mean(0) for x, _ in data[d, split]]), np.array([y.sum() for _, y in data[d, split]])) for d in range(3)}


def test_full_batch_gradients_from_statistics(rows, data):
    tr, te, x = scalar(data, "train"), scalar(data, "test"), Experiment(rows, LAM)
    mean, sd = tr[0][0].mean(0), tr[0][0].std(0) + 1e-6
    w, m, v, step, want = np.zeros(6), np.zeros(6), np.zeros(6), 0, {}
    for t in range(3):
        a, y = bias((tr[t][0] - mean) / sd), tr[t][1] / x.scales[t]
        for _ in range(15):
            step += 1
            g = a.T @ (a @ w - y) / len(a) + 1e-4 * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        for i in range(t + 1):
            pred = np.maximum(bias((te[i][0] - mean) / sd) @ w * x.scales[i], 0)
            want[t, i] = np.mean(np.abs(pred - te[i][1]))
    got = as_dict(x.evaluate(x.gradient()), "t", "i")
    assert {k: g[0] for k, g in got.items()} == {k: pytest.approx(u, rel=1e-7) for k, u in want.items()}


def test_gradients_by_sample_follow_the_order(rows, data):
    x = Experiment(rows, LAM)
    patches = np.concatenate([a for a, _ in data[0, "train"]])
    mean, sd = patches.mean(0), np.sqrt(np.maximum(patches.var(0), 1e-6))
    w, m, v, step = np.zeros(6), np.zeros(6), np.zeros(6), 0
    for t in range(3):
        for _ in range(2):
            for a, y in data[t, "train"]:
                step += 1
                z = np.append((a.mean(0) - mean) / sd, 1.0)
                g = z * (z @ w - y.sum() / x.scales[t]) + 1e-4 * w
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                w = w - 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    raw = x.gradient_by_sample(epochs=2)[-1].image
    assert raw == pytest.approx(np.append(w[:-1] / sd, w[-1] - (w[:-1] * mean / sd).sum()), rel=1e-6)


def test_random_projection(rows, data):
    tr, x = scalar(data, "train"), Experiment(rows, LAM)
    models, _ = x.projected(7)
    matrix = projection_matrix(5, 7)
    r, c = np.zeros((8, 8)), np.zeros(8)
    for t in range(3):
        a = bias(np.maximum(tr[t][0] @ matrix, 0))
        r, c = r + a.T @ a, c + a.T @ (tr[t][1] / x.scales[t])
    assert models[-1].image == pytest.approx(np.linalg.solve(r + LAM * np.eye(8), c))
    both, feature = x.projected(7, factors=0.5, patches=True)
    r, c = np.zeros((8, 8)), np.zeros(8)
    for t in range(3):
        mine = x.train.where(f"domain_id = {t}").select("x", "y").collect()
        a = bias(np.maximum(np.array([m["x"] for m in mine]) @ matrix, 0))
        r, c = 0.5 * r + a.T @ a, 0.5 * c + a.T @ (np.array([m["y"] for m in mine]) / x.scales[t])
    assert both[-1].patch == pytest.approx(np.linalg.solve(r + LAM * np.eye(8), c))
    assert x.evaluate(both, feature=feature).count() == 6


def test_gathered_statistics_equal_the_cells(rows, monkeypatch):
    from ebbtide.operators import stats

    train = rows.where("split = 'train'").withColumnRenamed("domain_id", "d")
    want = stats.collect_statistics(stats.long_statistics(train, ["d"]), ["d"])
    for size in (stats.SLICE, 5):
        monkeypatch.setattr(stats, "SLICE", size)
        for got in (stats.gather_statistics(train, ["d"]), stats.collect_statistics(stats.block_statistics(train, ["d"]), ["d"])):
            assert got.keys() == want.keys()
            for k, s in got.items():
                assert s.r == pytest.approx(want[k].r) and s.c == pytest.approx(want[k].c)
                assert (s.yy, s.y, s.n) == (pytest.approx(want[k].yy), pytest.approx(want[k].y), want[k].n)
    assert stats.gather_statistics(train.limit(0), ["d"]) == {}


def test_theory_curve(rows, data):
    tr, x = scalar(data, "train"), Experiment(rows, LAM)
    mass, noise, rho, ws = [], [], [], []
    for d in range(3):
        a, y = tr[d]
        y = y / y.mean()
        held = np.arange(len(y)) % 5 == 4
        full, part = Sequential(5), Sequential(5)
        full.add(a, y)
        part.add(a[~held], y[~held])
        ws.append(full.solve())
        mass.append(np.trace(full.r) / 6)
        noise.append(np.mean((bias(a[held]) @ part.solve() - y[held]) ** 2))
        rho.append(mass[-1] / len(y) / max(y.var(), 1e-3))
    mass, noise, rho, ws, age = map(np.array, (mass, noise, rho, ws, [2, 1, 0]))
    best, curve = x.theory(gain=2.0)
    for f, j in curve:
        share = f**age * mass
        total = share.sum() + LAM
        mixed = (share / total) @ ws
        want = np.mean(rho * ((mixed - ws) ** 2).sum(1)) + 2.0 * 6 * rho.mean() * (f ** (2 * age) * noise * mass).sum() / total**2
        assert j == pytest.approx(want, rel=1e-8)
    assert best == first_smallest(*zip(*curve, strict=True))[0]
    assert x.gains()[1.0] == x.theory()[0]
    assert x.drift()[0] is None and all(v >= 0 for v in x.drift()[1:])


def test_summaries_and_best_factors(rows):
    factors = (1.0, 0.5, 0.5)
    matrix = Experiment(rows, LAM).sweep((1.0, 0.5), ("mean",), patches=False)
    last = [r["rel"] for r in matrix.where("t = 2 AND forget = 1.0").collect()]
    assert summaries(matrix, ["forget"]).where("forget = 1.0").first()["final_avg"] == pytest.approx(np.mean(last))
    assert best_factors(matrix, factors[:2]).first()["forget_by_rel"] in (1.0, 0.5)
    assert set(compare_scalar(Experiment(rows, LAM), (1.0,), width=4)) == {"full memory", "selected", "gradient", "single", "random features"}


def test_transforms_keep_sums(rows):
    totals = lambda df: {r["sample_id"]: r["s"] for r in df.groupBy("sample_id").agg(F.sum("y").alias("s")).collect()}
    assert totals(transform_targets(rows, "dct2")) == {k: pytest.approx(v) for k, v in totals(rows).items()}


def test_unknown_modes_and_ragged_grids_raise():
    for mode in ("dct", "gauss", "mean", "dct2x"):
        with pytest.raises(ValueError):
            target_transform(mode)
    with pytest.raises(ValueError):
        target_transform("dct2")([1.0, 2.0, 3.0])


def test_groups_that_lack_vectors_keep_all_rows_and_square_grids(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 302 AND vec_id <> 101")
    e.write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {}
    for r in registry.grouped_vectors(spark, str(tmp_path)).collect():
        found.setdefault((r["domain_id"], r["split"], r["sample_id"], r["ord"]), []).append(r["patch_id"])
    assert sum(map(len, found.values())) == e.count() == 301
    assert sorted(k[2] for k, v in found.items() if v == [0]) == [-302, -301, -104, -103, -101]
    assert all(sorted(v) == [0, 1, 2, 3] for k, v in found.items() if k[2] >= 0) and len(found) == 74 + 5
    out = registry.two_head_sweep(spark, str(tmp_path)).collect()
    assert len(out) == 15 and all(np.isfinite(r["final_avg"]) for r in out)
