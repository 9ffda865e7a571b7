"""Run experiments from the command line.

    python -m ebbtide sweep --rows features.parquet --out results --factors 1,0.8,0.6
    python -m ebbtide all --rows a.parquet b.parquet --out results
    python -m ebbtide adaptive --config domains.json --kind counting --extractor mymodule:vectors --out results

Rows are Parquet tables of (domain_id, split, sample_id, ord, patch_id, x, y). With
``--config`` they are made from domain configurations and kept under ``--out``: the
extractor is a function from an image's bytes to its patch vectors. ``--synthetic``
takes drifting synthetic domains instead. Results are JSON, and are printed as tables.
"""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Callable
from pathlib import PurePath

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.forgetting import improvement_percent
from .operators.metrics import adaptive_verdict, forgetting_verdict, scalar_verdict
from .plans.experiments import Experiment, best_factors, compare_scalar, summaries
from .sources.configs import FIELDS
from .sources.sinks import append_rows, markdown, text_table, write_json, write_report
from .sources.streams import configured_rows
from .sources.synthetic import drifting_domains

SCALAR_KINDS = ("age", "scores", "quality")


def matrix(x: Experiment, a: argparse.Namespace) -> DataFrame:
    """Relative errors after each domain (t) on each domain seen (D0, D1, ..)."""
    told = x.sweep(a.factors, a.target_norms, a.alphas, patches=not a.scalar).withColumn("i", F.concat(F.lit("D"), "i"))
    wide = told.groupBy("norm", "alpha", "forget", "t").pivot("i", [f"D{k}" for k in range(x.domains)]).agg(F.first("rel"))
    return wide.orderBy("norm", "alpha", F.desc("forget"), "t")


def sweep(x: Experiment, a: argparse.Namespace) -> DataFrame:
    best = best_factors(x.sweep(a.factors, ("none", "mean"), a.alphas, patches=not a.scalar), a.factors)
    wide = best.groupBy("alpha").pivot("norm", ["none", "mean"]).agg(F.first("forget_by_rel"))
    verdicts = {"verdict": forgetting_verdict(F.col("none"), F.col("mean")), "scalar_verdict": scalar_verdict(F.col("mean"))}
    return best.join(wide, "alpha").withColumns(verdicts)


def adaptive(x: Experiment, a: argparse.Namespace) -> DataFrame:
    """Selected factors beside full memory and the best fixed factor, a row a method."""
    spark, patches = x.rows.sparkSession, not a.scalar
    used = {"full memory": [1.0] * x.domains}
    if a.selector != "innovation" or a.scalar:
        used["held out"] = x.held_out_selection(patches=patches, f_min=a.f_min, f_max=a.f_max)
    if a.selector != "held-out" and patches:
        used["innovation"], _ = x.innovation_selection(a.f_min, a.f_max)
    best = best_factors(x.sweep(a.factors, ("mean",), patches=patches), a.factors).first()
    used["best fixed"] = [best["forget_by_rel"]] * x.domains
    models = [m for label, factors in used.items() for m in x.fixed(factors, label=label, patches=patches)]
    found = summaries(x.evaluate(models), ["label"]).collect()  # a row a method
    final = {r["label"]: r["final_avg"] for r in found}
    rows = [(*r, used[r["label"]]) for r in found]
    out = spark.createDataFrame(rows, "label string, final_avg double, nbwt double, oldest double, newest double, factors array<double>")
    base, oracle, own = F.lit(final["full memory"]), F.lit(final["best fixed"]), F.col("final_avg")
    return out.withColumns({"improvement": improvement_percent(base, own), "to_best_fixed": own - oracle, "verdict": adaptive_verdict(base, oracle, own)})


def baselines(x: Experiment, a: argparse.Namespace) -> DataFrame:
    if a.scalar:
        return x.rows.sparkSession.createDataFrame([(k, float(v)) for k, v in compare_scalar(x, a.factors, a.width).items()], "label string, final_avg double")
    models = x.gradient_by_sample() + x.fixed(1.0, label="full memory", patches=False)
    own = x.evaluate(x.single_domain(), own_only=True).agg(F.lit("single").alias("label"), F.avg("rel").alias("final_avg"))
    return summaries(x.evaluate(models), ["label"]).select("label", "final_avg").unionByName(own)


def theory(x: Experiment, a: argparse.Namespace) -> DataFrame:
    best, curve = x.theory(gain=a.gain)
    return x.rows.sparkSession.createDataFrame([(f, j, f == best) for f, j in curve], "f double, objective double, chosen boolean")


def gains(x: Experiment, a: argparse.Namespace) -> DataFrame:
    """The predicted factor for each gain, beside the best one on the test rows and its error."""
    best = best_factors(x.sweep(a.factors, ("mean",), patches=False), a.factors).first()
    rows = [(g, f, best["forget_by_rel"], best["best_rel"]) for g, f in x.gains().items()]
    return x.rows.sparkSession.createDataFrame(rows, "gain double, f double, best_f double, best_rel double")


def report(x: Experiment, a: argparse.Namespace) -> DataFrame:
    """A row a setting of raw errors: factor, mix of heads, final average, backward transfer, oldest and newest domain."""
    told = summaries(x.sweep(a.factors, ("none",), a.alphas, patches=not a.scalar), ["forget", "alpha"], "mae")
    names = {"alpha": "alpha_patch", "final_avg": "final_avg_MAE", "nbwt": "nBwT", "oldest": "oldest_MAE", "newest": "newest_MAE"}
    setting = F.format_string("f=%.3g alpha=%.3g", "forget", "alpha")
    return told.withColumns({"setting": setting, "patch_target": F.lit(x.patch_target)}).withColumnsRenamed(names)


COMMANDS = {"matrix": matrix, "sweep": sweep, "adaptive": adaptive, "baselines": baselines, "theory": theory, "gains": gains, "report": report}


def imported(name: str) -> Callable:
    """The function module:name; executors get its module by value, so that they need not have it."""
    module, _, function = name.partition(":")
    found = importlib.import_module(module)
    cloudpickle.register_pickle_by_value(found)
    return getattr(found, function)


def numbers(s: str) -> list[float]:
    return [float(f) for f in s.split(",")]


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ebbtide", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=[*COMMANDS, "all"])
    p.add_argument("--rows", nargs="*", default=[])
    p.add_argument("--config", nargs="*", default=[], help="domain configurations; with --kind and --extractor")
    p.add_argument("--kind", choices=sorted(FIELDS), default="counting")
    p.add_argument("--extractor", help="module:function from an image's bytes to its patch vectors")
    p.add_argument("--cache", help="feature table; under --out if not given")
    p.add_argument("--cells", type=int, default=37 * 37, help="patches of an image")
    p.add_argument("--img-size", type=int, default=518)
    p.add_argument("--backbone", default="vit", help="name of the extractor in the feature table's keys")
    p.add_argument("--max-per-domain", type=int, help="training samples of a domain, drawn by seed")
    p.add_argument("--synthetic", action="store_true")
    p.add_argument("--out", required=True)
    p.add_argument("--csv", help="table to which the gains command adds a row a table of rows")
    # The factors that are swept.
    p.add_argument("--factors", type=numbers, default=[1.0, 0.8, 0.6, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1])
    p.add_argument("--lam", type=float, default=100.0)
    p.add_argument("--alphas", type=numbers, default=[0.25], help="mixes of patch and image head; the first is that of single runs")
    p.add_argument("--alpha", type=lambda s: [float(s)], dest="alphas")
    p.add_argument("--patch-targets", type=lambda s: s.split(","), default=["raw"])
    p.add_argument("--patch-target", type=lambda s: [s], dest="patch_targets")
    p.add_argument("--target-norms", type=lambda s: s.split(","), default=["none", "mean"])
    p.add_argument("--selector", choices=["held-out", "innovation", "both"], default="both")
    p.add_argument("--f-min", type=float, default=0.05)
    p.add_argument("--f-max", type=float, default=1.0)
    p.add_argument("--gain", type=float, default=1.0, help="weight of the variance in the theory's objective")
    p.add_argument("--scalar", action="store_true", help="one value a sample: no patch head")
    p.add_argument("--absolute", action="store_true", help="relative errors over the mean size of the target")
    p.add_argument("--width", type=int, default=2000, help="random features of the projection baseline")
    return p


def tables(spark: SparkSession, a: argparse.Namespace) -> dict[str, Callable[[], DataFrame]]:
    """How to read each table of rows, by the name of its results."""
    out = {f"{k}": (lambda p=path: spark.read.parquet(p)) for k, path in enumerate(a.rows)}
    if a.config:
        extractor = imported(a.extractor)

        def make(path: str, name: str) -> DataFrame:
            cache = a.cache or f"{a.out}/features"
            return configured_rows(spark, path, a.kind, extractor, cache, a.cells, f"{a.out}/{name}/rows", a.max_per_domain, a.backbone, a.img_size)

        for path in a.config:
            name = PurePath(path).stem
            name = name if name not in out else f"{name}-{len(out)}"
            out[name] = lambda p=path, n=name: make(p, n)
    return out or {"synthetic": lambda: drifting_domains(spark)}


def run(command: str, x: Experiment, a: argparse.Namespace, name: str, path: str) -> None:
    rows = COMMANDS[command](x, a)
    write_json(rows, path)
    kept = rows.sparkSession.read.schema(rows.schema).json(path)  # what was computed is printed, not computed again
    print(f"\n{name} {command} {x.patch_target}")
    print(text_table(kept) if command != "report" else markdown(kept))
    if command == "report":
        write_report(kept, f"{path}_csv")
    if command == "gains" and a.csv:
        own = kept.where("gain = 1").select(F.lit(name).alias("config"), F.lit(x.domains).alias("domains"), F.col("f").alias("f_pred"), "best_f", "best_rel")
        append_rows(own, a.csv)


def main(args: list[str] | None = None) -> int:
    p = arguments()
    a = p.parse_args(args)
    if not (a.rows or a.config or a.synthetic):
        p.error("--rows, --config or --synthetic")
    if a.config and not a.extractor:
        p.error("--config needs --extractor")
    if a.config and a.kind in SCALAR_KINDS:
        a.scalar = True
    a.absolute = a.absolute or bool(a.config) and a.kind == "quality"
    floor = {"scale_floor": None} if a.config and a.kind in SCALAR_KINDS else {}
    failed = 0
    for name, read in tables(SparkSession.builder.getOrCreate(), a).items():
        rows = None
        for target in a.patch_targets:
            for command in COMMANDS if a.command == "all" else [a.command]:
                try:
                    rows = rows if rows is not None else read()
                    x = Experiment(rows, a.lam, a.alphas[0], target, absolute=a.absolute, **floor)
                    run(command, x, a, name, "/".join([a.out, name, *([target] if len(a.patch_targets) > 1 else []), command]))
                except ValueError as e:  # one table that does not fit must not end a batch
                    failed += 1
                    print(f"{name} {command}: {e}", file=sys.stderr)
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
