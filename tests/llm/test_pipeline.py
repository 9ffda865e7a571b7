"""The pipeline stage by stage against plain versions, and its rows as a whole."""

import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, __file__.rsplit("/", 1)[0])
import corpus_pipeline  # noqa: E402
from test_packing import check_pieces  # noqa: E402
from test_quality import brute as quality  # noqa: E402
from test_secrets import brute as secrets  # noqa: E402
from test_simhash import brute_components, fingerprint  # noqa: E402

from ebbtide.llm import toxicity  # noqa: E402
from ebbtide.llm.secrets import base_dictionary, redact  # noqa: E402

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Each stage's output, written and read again."""
    out, docs = {"documents": spark.read.parquet(f"{sf_dir}/documents.parquet")}, spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stage_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "simhash_near_dedup", "secret_scan", "best_fit_packing"]
    for name in list(STAGES)[:-1]:
        assert stages[name].dtypes == stages["documents"].dtypes


def test_quality_stage(stages):
    before = texts(stages["documents"])
    assert texts(stages["quality_rules"]) == {i: t for i, t in before.items() if quality(t)[-1]}


def test_toxicity_stage(spark, sf_dir, stages):
    kept, before = texts(stages["toxicity"]), texts(stages["quality_rules"])
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(stages["quality_rules"], spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    assert kept == {i: t for i, t in before.items() if not scores[i]}
    clean = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 0").collect()} & before.keys()
    assert len(clean & kept.keys()) >= 0.95 * len(clean)


def test_dedup_stage(stages):
    before = sorted(texts(stages["toxicity"]).items())
    label = brute_components([fingerprint(t) for _, t in before])
    assert set(texts(stages["simhash_near_dedup"])) == {before[k][0] for k in set(label.tolist())}


def test_secret_stage(stages):
    before, rows = texts(stages["simhash_near_dedup"]), stages["secret_scan"].collect()
    assert {r["doc_id"] for r in rows} == before.keys()
    for r in rows:
        found = secrets(before[r["doc_id"]])
        assert (r["text"] == before[r["doc_id"]]) or "[SECRET]" in r["text"]
        assert not any(before[r["doc_id"]][s:e] in r["text"] for k, s, e in found if k != "hex" or e - s > 15)
        assert r["text"] == before[r["doc_id"]] or r["n_chars"] == len(r["text"])


def test_packing_stage(stages):
    check_pieces(stages["best_fit_packing"].collect(), texts(stages["secret_scan"]))


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    key = lambda df: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf_dir)) == key(stages["best_fit_packing"])


ODD = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "w " * 40_000, "en", "s", 80_000), (3, "twelve words stand here so that this text is long enough to stay", None, "s", 64), (3, "twelve words stand here so that this text is long enough to stay", None, "s", 64)]


def test_stages_take_odd_and_empty_tables(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, label int, __row int, root string"
    for rows in (ODD, []):
        docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            if name != "best_fit_packing":
                assert out.columns == docs.columns
            out.collect()
        docs = STAGES["quality_rules"](spark, docs, sf_dir)
        assert [r["doc_id"] for r in STAGES["simhash_near_dedup"](spark, docs, sf_dir).collect()] == ([3] if rows else [])
        assert docs.where(F.col("__row") != 2).count() == 0


def test_the_secret_stage_knows_the_names_of_long_texts(spark, sf_dir):
    long, text = "Quibbleflorp and Wobblegnash in plain words " * 2_000, "see key QuibbleflorpWobblegnash there"
    assert redact(text, base_dictionary()) != text
    docs = spark.createDataFrame([(i, f"{long}{'x' * i}") for i in range(3)] + [(9, text)], "doc_id long, text string")
    assert texts(STAGES["secret_scan"](spark, docs, sf_dir))[9] == text


def test_the_toxicity_stage_learns_from_every_labelled_document(spark, tmp_path):
    """Six toxic documents beside two held out among 90,000: of 20,000 drawn, too few would be left to learn their word."""
    number = F.col("id")
    ids = spark.range(90_000)
    ids.select(number.alias("doc_id"), F.when(number % 12_000 == 1, 1).otherwise(0).alias("toxic")).write.parquet(str(tmp_path / "labels.parquet"))
    docs = ids.select(number.alias("doc_id"), F.concat_ws(" ", F.lit("plain words"), number.cast("string"), F.when(number % 12_000 == 1, "blorkish")).alias("text"))
    kept = STAGES["toxicity"](spark, docs, str(tmp_path))
    assert kept.count() == 90_000 - 8 and kept.where("text like '%blorkish%'").count() == 0
