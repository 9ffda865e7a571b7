"""Experiments on one feature of lineitem, whose solutions are closed forms that SQL can state.

A line number's lines are a sample of one patch: x = mean quantity / 50, y = total price
/ 1000, the return flags are the domains, lines whose number is divisible by 7 are test rows, and of the
others those whose number leaves 4 modulo 5 are held out by the selectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.forgetting import F_MAX, F_MIN, NOISE_FLOOR
from ..operators.selection import GAINS, GRID, VARIANCE_FLOOR
from .experiments import Experiment, best_factors
from .registry import FLAG_DOMAIN, LAM, query, table

FACTORS = (1.0, 0.8, 0.6, 0.4, 0.2)


def line_rows(spark, sf_dir) -> DataFrame:
    number, id_ = F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("sample_id")
    samples = table(spark, sf_dir, "lineitem").groupBy(F.expr(FLAG_DOMAIN).alias("domain_id"), number.alias("sample_id"))
    told = samples.agg(F.array(F.avg(F.col("l_quantity") / 50.0)).alias("x"), F.sum(F.col("l_extendedprice") / 1000.0).alias("y"))
    return told.select("domain_id", F.when(id_ % 7 == 0, "test").otherwise("train").alias("split"), "sample_id", id_.alias("ord"), F.lit(0).alias("patch_id"), "x", "y")


def experiment(spark, sf_dir) -> Experiment:
    return Experiment(line_rows(spark, sf_dir), LAM)


# -- SQL: sums of each domain, closed forms, and the steps of a sequence of three domains

_SUMS = {"a": "sum(x * x)", "b": "sum(x)", "n": "sum(1.0::DOUBLE)", "p": "sum(x * y)", "q": "sum(y)", "z": "sum(y * y)"}
BASE = f"""l AS (SELECT {FLAG_DOMAIN} AS d, l_orderkey * 10 + l_linenumber AS id, avg(l_quantity / 50.0) AS x, sum(l_extendedprice / 1000.0) AS y FROM lineitem GROUP BY 1, 2),
te AS (SELECT d, x, y FROM l WHERE id % 7 = 0), tr AS (SELECT *, id % 5 = 4 AS held FROM l WHERE id % 7 <> 0),
s AS (SELECT d, greatest(avg(y), 1e-6) AS k, {", ".join(f"{v} AS {c}, {v} FILTER (NOT held) AS f{c}, {v} FILTER (held) AS h{c}" for c, v in _SUMS.items())} FROM tr GROUP BY d)"""


def slope(a: str, b: str, n: str, p: str, q: str) -> str:
    return f"((({n}) + {LAM}) * ({p}) - ({b}) * ({q})) / ((({a}) + {LAM}) * (({n}) + {LAM}) - ({b}) * ({b}))"


def level(a: str, b: str, n: str, p: str, q: str) -> str:
    return f"((({a}) + {LAM}) * ({q}) - ({b}) * ({p})) / ((({a}) + {LAM}) * (({n}) + {LAM}) - ({b}) * ({b}))"


def squares(w1: str, w0: str, a: str, b: str, n: str, p: str, q: str, z: str) -> str:
    return f"({w1} * {w1} * {a} + 2 * {w1} * {w0} * {b} + {w0} * {w0} * {n} - 2 * ({w1} * {p} + {w0} * {q}) + {z})"


def decayed(prefix: str, k: str, f: str = "f") -> str:
    """The five sums of all domains up to t, weighted for t, targets divided by k."""
    w = f"pow({f}, t.d - s.d)"
    return ", ".join(f"sum({w} * {prefix}{c}{' / ' + k if c in 'pq' else ''}) AS {c}" for c in "abnpq")


def values(name: str, numbers) -> str:
    return f"{name}(f, place) AS (VALUES " + ", ".join(f"({float(v)!r}::DOUBLE, {i})" for i, v in enumerate(numbers)) + ")"


DOMAINS = "(SELECT d FROM s) t"
SWEEP_SQL = f"""{BASE}, {values("g", FACTORS)},
u AS (SELECT norm, s.*, CASE norm WHEN 'mean' THEN k ELSE 1.0 END AS unit FROM s CROSS JOIN (VALUES ('none'), ('mean')) v(norm)),
c AS (SELECT norm, f, place, t.d AS t, {decayed("", "unit")} FROM g CROSS JOIN {DOMAINS} JOIN u s ON s.d <= t.d GROUP BY norm, f, place, t.d),
w AS (SELECT norm, f, place, t, {slope(*"abnpq")} AS w1, {level(*"abnpq")} AS w0 FROM c),
m AS (SELECT w.norm, f, place, t, te.d AS i, avg(abs(greatest(w1 * x + w0, 0) * unit - y)) AS mae, avg(abs(greatest(w1 * x + w0, 0) * unit - y)) / greatest(avg(y), 1e-6) AS rel
      FROM w JOIN te ON te.d <= w.t JOIN u ON u.d = te.d AND u.norm = w.norm GROUP BY w.norm, f, place, t, te.d)"""


@query(f"WITH {SWEEP_SQL} SELECT norm, f AS forget, t, i, round(mae, 6) AS mae, round(rel, 6) AS rel FROM m")
def line_sweep(spark, sf_dir):
    out = experiment(spark, sf_dir).sweep(FACTORS, patches=False)
    return out.select("norm", "forget", "t", "i", F.round("mae", 6).alias("mae"), F.round("rel", 6).alias("rel"))


@query(f"""WITH {SWEEP_SQL}, e AS (SELECT norm, f, place, avg(rel) AS rel, avg(mae) AS mae FROM m WHERE t = 2 GROUP BY norm, f, place)
SELECT norm, arg_min(f, (rel, place)) AS forget_by_rel, round(min(rel), 6) AS best_rel, arg_min(f, (mae, place)) AS forget_by_mae, round(min(mae), 6) AS best_mae FROM e GROUP BY norm""")
def line_sweep_best(spark, sf_dir):
    out = best_factors(experiment(spark, sf_dir).sweep(FACTORS, patches=False), FACTORS)
    return out.select("norm", "forget_by_rel", F.round("best_rel", 6).alias("best_rel"), "forget_by_mae", F.round("best_mae", 6).alias("best_mae"))


OWN = [f"s.{c}" if c in "abn" else f"s.{c} / s.k" for c in "abnpq"]


@query(f"""WITH {BASE}, w AS (SELECT d, k, {slope(*OWN)} AS w1, {level(*OWN)} AS w0 FROM s)
SELECT te.d AS i, round(avg(abs(greatest(w1 * x + w0, 0) * k - y)), 6) AS mae, round(avg(abs(greatest(w1 * x + w0, 0) * k - y)) / greatest(avg(y), 1e-6), 6) AS rel FROM w JOIN te ON te.d = w.d GROUP BY te.d""")
def line_single_domain(spark, sf_dir):
    x = experiment(spark, sf_dir)
    return x.evaluate(x.single_domain(patches=False), own_only=True).select("i", F.round("mae", 6).alias("mae"), F.round("rel", 6).alias("rel"))


HELD = ["s.ha", "s.hb", "s.hn", "s.hp / s.k", "s.hq / s.k", "s.hz / s.k / s.k"]


@query(f"""WITH {BASE}, {values("g", GRID)},
c AS (SELECT f, place, t.d AS t, {decayed("f", "s.k", "g.f")} FROM g CROSS JOIN {DOMAINS} JOIN s ON s.d <= t.d GROUP BY f, place, t.d),
w AS (SELECT f, place, t, {slope(*"abnpq")} AS w1, {level(*"abnpq")} AS w0 FROM c),
e AS (SELECT t, f, place, avg({squares("w1", "w0", *HELD)} / greatest(s.hn, 1)) AS o FROM w JOIN s ON s.d <= w.t GROUP BY t, f, place)
SELECT t, CASE t WHEN 0 THEN 1.0 ELSE arg_min(f, (o, place)) END::DOUBLE AS factor FROM e GROUP BY t""")
def line_held_out_factors(spark, sf_dir):
    factors = experiment(spark, sf_dir).held_out_selection(patches=False)
    return spark.createDataFrame(list(enumerate(factors)), "t int, factor double")


THEORY_SQL = f"""{BASE},
w AS (SELECT d, n, k, {slope(*OWN)} AS w1, {level(*OWN)} AS w0, (a + n) / 2 AS mass, greatest(z / k / k / n - pow(q / k / n, 2), {VARIANCE_FLOOR}) AS var,
      {slope("fa", "fb", "fn", "fp / k", "fq / k")} AS v1, {level("fa", "fb", "fn", "fp / k", "fq / k")} AS v0 FROM s),
e AS (SELECT w.*, 2 - w.d AS age, mass / w.n / var AS rho, {squares("v1", "v0", *HELD)} / greatest(s.hn, 1) AS noise FROM w JOIN s ON s.d = w.d),
{values("g", GRID)},
mix AS (SELECT f, place, sum(pow(f, age) * mass) + {LAM} AS total, sum(pow(f, age) * mass * w1) AS m1, sum(pow(f, age) * mass * w0) AS m0, sum(pow(f, 2 * age) * noise * mass) AS spread FROM g CROSS JOIN e GROUP BY f, place),
j AS (SELECT f, place, avg(rho * (pow(m1 / total - w1, 2) + pow(m0 / total - w0, 2))) AS bias, 2 * avg(rho) * any_value(spread / total / total) AS variance FROM mix CROSS JOIN e GROUP BY f, place)"""


@query(f"""WITH {THEORY_SQL} SELECT f, round(bias + variance, 9) AS objective, place = (SELECT arg_min(place, (bias + variance, place)) FROM j) AS chosen FROM j""")
def line_theory_curve(spark, sf_dir):
    best, curve = experiment(spark, sf_dir).theory()
    return spark.createDataFrame([(f, j, f == best) for f, j in curve], "f double, objective double, chosen boolean").withColumn("objective", F.round("objective", 9))


@query(f"""WITH {THEORY_SQL}, k AS (SELECT f AS gain FROM ({", ".join(["VALUES " + ", ".join(f"({float(v)!r}::DOUBLE)" for v in GAINS)])}) r(f))
SELECT gain, arg_min(f, (bias + gain * variance, place)) AS f FROM k CROSS JOIN j GROUP BY gain""")
def line_gains(spark, sf_dir):
    return spark.createDataFrame(list(experiment(spark, sf_dir).gains().items()), "gain double, f double")


#: One row with the sums of all three domains: a0 .. z2, in units of the domain's mean where ``unit`` is k.
def _wide(unit: str) -> str:
    power = {"p": f" / {unit}", "q": f" / {unit}", "z": f" / {unit} / {unit}"}
    return "r AS (SELECT " + ", ".join(f"max(CASE WHEN d = {d} THEN {c}{power.get(c, '')} END) AS {c}{d}" for d in range(3) for c in "abnpqz") + " FROM s)"


def _of(d: int) -> list[str]:
    return [f"{c}{d}" for c in "abnpqz"]


def _after(last: int, factors: list[str]) -> list[str]:
    """The five sums behind domain ``last``; a factor for each boundary after the first."""
    out = [f"{c}0" for c in "abnpq"]
    for d in range(1, last + 1):
        out = [f"({factors[d]} * ({v}) + {c}{d})" for c, v in zip("abnpq", out, strict=True)]
    return out


def _factor(rho: str) -> str:
    best = f"CASE WHEN {rho} = 0 THEN 1.0 ELSE 0.5 * (2.0 + {rho} - sqrt({rho} * {rho} + 4.0 * {rho})) END"
    return f"least(greatest({best}, {F_MIN}), {F_MAX})"


def _innovation_sql() -> str:
    steps, factors = [f"WITH {BASE}, {_wide('k')}, x0 AS (SELECT * FROM r)"], ["1.0"]
    for t in (1, 2):
        old, own = _after(t - 1, factors), _of(t)[:5]
        steps.append(f"y{t} AS (SELECT *, {slope(*old)} AS o1_{t}, {level(*old)} AS o0_{t}, {slope(*own)} AS e1_{t}, {level(*own)} AS e0_{t} FROM x{t - 1})")
        energy, floor = (squares(f"{w}1_{t}", f"{w}0_{t}", *_of(t)) + f" / n{t}" for w in "oe")
        steps.append(f"z{t} AS (SELECT *, greatest({energy} - {floor}, 0) / greatest({floor}, {NOISE_FLOOR}) AS rho{t} FROM y{t})")
        steps.append(f"x{t} AS (SELECT *, {_factor(f'rho{t}')} AS f{t} FROM z{t})")
        factors.append(f"f{t}")
    return ", ".join(steps) + " SELECT 0 AS t, 1.0::DOUBLE AS factor, 0.0::DOUBLE AS ratio FROM x2 UNION ALL SELECT 1, round(f1, 8), round(rho1, 8) FROM x2 UNION ALL SELECT 2, round(f2, 8), round(rho2, 8) FROM x2"


@query(_innovation_sql())
def line_innovation_factors(spark, sf_dir):
    factors, ratios = experiment(spark, sf_dir).innovation_selection()
    rows = [(t, float(f), float(r)) for t, (f, r) in enumerate(zip(factors, ratios, strict=True))]
    return spark.createDataFrame(rows, "t int, factor double, ratio double").select("t", F.round("factor", 8).alias("factor"), F.round("ratio", 8).alias("ratio"))


def _noise_floor_sql() -> str:
    steps, factors = [f"WITH {BASE}, {_wide('1.0')}"], ["1.0"]
    for t in range(3):
        source = "r" if t == 0 else f"x{t - 1}"
        if t:
            old = _after(t - 1, factors)
            steps.append(f"o{t} AS (SELECT *, {slope(*old)} AS o1_{t}, {level(*old)} AS o0_{t} FROM {source})")
            steps.append(f"i{t} AS (SELECT *, {squares(f'o1_{t}', f'o0_{t}', *_of(t))} / n{t} AS energy{t} FROM o{t})")
            steps.append(f"h{t} AS (SELECT *, greatest(energy{t} - floor{t - 1}, 0) / greatest(floor{t - 1}, {NOISE_FLOOR}) AS rho{t} FROM i{t})")
            steps.append(f"g{t} AS (SELECT *, {_factor(f'rho{t}')} AS f{t} FROM h{t})")
            factors.append(f"f{t}")
            source = f"g{t}"
        new = _after(t, factors)
        steps.append(f"n{t} AS (SELECT *, {slope(*new)} AS w1_{t}, {level(*new)} AS w0_{t} FROM {source})")
        steps.append(f"a{t} AS (SELECT *, {squares(f'w1_{t}', f'w0_{t}', *_of(t))} / n{t} AS after{t} FROM n{t})")
        steps.append(f"x{t} AS (SELECT *, {'after0' if t == 0 else f'0.5 * floor{t - 1} + 0.5 * after{t}'} AS floor{t} FROM a{t})")
    first = "SELECT 0 AS task, 1.0::DOUBLE AS forget, NULL::DOUBLE AS innovation, NULL::DOUBLE AS rho_hat, round(after0, 6) AS postfit_residual, round(floor0, 6) AS noise_floor FROM x2"
    rest = [f"SELECT {t}, round(f{t}, 8), round(energy{t}, 6), round(rho{t}, 8), round(after{t}, 6), round(floor{t}, 6) FROM x2" for t in (1, 2)]
    return ", ".join(steps) + " " + " UNION ALL ".join([first, *rest])


@query(_noise_floor_sql())
def line_noise_floor_log(spark, sf_dir):
    log = experiment(spark, sf_dir).noise_floor_selection()
    rows = spark.createDataFrame([tuple(r.values()) for r in log], "task int, forget double, innovation double, rho_hat double, postfit_residual double, noise_floor double")
    return rows.select("task", *(F.round(c, n).alias(c) for c, n in (("forget", 8), ("innovation", 6), ("rho_hat", 8), ("postfit_residual", 6), ("noise_floor", 6))))


def _drift_sql() -> str:
    steps, rows = [f"WITH {BASE}, {_wide('k')}"], ["SELECT 0 AS domain, NULL::DOUBLE AS score"]
    for t in (1, 2):
        own, before = _of(t)[:5], _after(t - 1, ["1.0"] * 3)
        steps.append(f"y{t} AS (SELECT *, {slope(*own)} AS e1, {level(*own)} AS e0, {slope(*before)} AS o1, {level(*before)} AS o0 FROM r)")
        noise = f"greatest({squares('e1', 'e0', *_of(t))} / n{t}, {NOISE_FLOOR})"
        rows.append(f"SELECT {t}, round((a{t} + n{t}) / 2 / ({noise} / n{t}) * (pow(e1 - o1, 2) + pow(e0 - o0, 2)) / 1000, 6) FROM y{t}")
    return ", ".join(steps) + " " + " UNION ALL ".join(rows)


@query(_drift_sql())
def line_drift_scores(spark, sf_dir):
    """In thousands."""
    rows = list(enumerate(experiment(spark, sf_dir).drift()))
    return spark.createDataFrame(rows, "domain int, score double").withColumn("score", F.round(F.col("score") / 1000, 6))
