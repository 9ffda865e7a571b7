import json
import random
import struct

import numpy as np
import pytest
from test_sources import png, touch

from ebbtide.__main__ import main
from ebbtide.plans import builders
from ebbtide.sources import streams


def extractor():
    """Four patches; the first component tells the image's width. A local function, so that workers get it by value."""

    def vectors(data):
        return np.array([[float(streams.image_size(data)[0]), k] for k in range(4)])

    return vectors


def picture(path, w, h):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(png(np.zeros((h, w), int), bits=8))


def test_image_sizes():
    assert streams.image_size(png(np.zeros((3, 7), int), bits=8)) == (7, 3)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 30, 40) + b"\0" * 8
    assert streams.image_size(jpeg) == (40, 30)
    with pytest.raises(ValueError):
        streams.image_size(b"GIF89a")


def test_counting_rows(spark, tmp_path):
    for k, w in enumerate((10, 20, 30)):
        picture(tmp_path / f"train/images/{k}.png", w, 10)
        touch(tmp_path / f"train/gt/{k}.txt", "1 1\n9 9\n" * k)
    domain = {"kind": "jhu", "root": str(tmp_path), "train_split": "train", "test_split": "test", "include_file": ""}
    rows = streams.counting_stream(spark, domain, 1, "train", extractor(), str(tmp_path / "cache"), 4, most=2).collect()
    picked = sorted(np.random.default_rng(43).choice(3, size=2, replace=False).tolist())
    assert {r["ord"]: r["x"][0] for r in rows} == {k: float((10, 20, 30)[i]) for k, i in enumerate(picked)}
    totals = {}
    for r in rows:
        totals[r["ord"]] = totals.get(r["ord"], 0) + r["y"]
    assert totals == {k: 2.0 * i for k, i in enumerate(picked)} and len(rows) == 8
    assert streams.feature_width(spark.createDataFrame(rows)) == 2


def test_depth_rows(spark, tmp_path):
    picture(tmp_path / "rgb/a.png", 6, 6)
    (tmp_path / "depth").mkdir()
    (tmp_path / "depth/a.png").write_bytes(png(np.full((4, 4), 3000)))
    domain = {"kind": "nyu", "root": str(tmp_path), "split_file": "", "test_split_file": "", "max_depth": 10.0}
    rows = streams.depth_stream(spark, domain, 0, "train", extractor(), str(tmp_path / "cache"), 4, size=8).collect()
    assert sorted((r["patch_id"], r["y"]) for r in rows) == [(k, 3.0) for k in range(4)]


def test_scalar_rows(spark, tmp_path):
    for age in range(20, 30):
        picture(tmp_path / f"age/{age}_0.png", age, 5)
    domain = {"kind": "utkface", "root": str(tmp_path / "age"), "age_min": 0.0, "age_max": 200.0}
    order = list(range(10))
    random.Random(12345).shuffle(order)
    get = lambda split, most=None: {r["ord"]: (r["x"][0], r["y"]) for r in streams.scalar_stream(spark, "age", domain, 0, split, extractor(), str(tmp_path / "cache"), most).collect()}
    ages = [(float(20 + i), float(20 + i)) for i in order]
    assert get("test") == dict(enumerate(ages[:1])) and get("train", 3) == dict(enumerate(ages[1:4]))
    table = touch(tmp_path / "s.csv", "image_name,mean_score\n" + "".join(f"{a}_0.png,{a / 10}\n" for a in range(20, 30)))
    scores = {"root": str(tmp_path / "age"), "csv": str(table), "score_min": 0.0, "score_max": 9.0, "score_col": "mean_score", "img_col": "image_name", "train_ratio": 0.8, "split_seed": 42}
    found = {r["ord"]: r["y"] for r in streams.scalar_stream(spark, "scores", scores, 0, "test", extractor(), str(tmp_path / "cache")).collect()}
    assert found == {0: (20 + np.random.default_rng(42).permutation(10).tolist()[0]) / 10}


def test_count_domains(spark):
    rows = [(f"s{i:02d}", (i * 7) % 10) for i in range(14)]
    got = builders.count_domains(spark.createDataFrame(rows, "stem string, count int")).collect()
    ordered, generator, want = sorted(rows, key=lambda r: (r[1], r[0])), random.Random(0), set()
    for name, part in zip(("low", "mid", "high"), (ordered[:4], ordered[4:9], ordered[9:]), strict=True):
        part = list(part)
        generator.shuffle(part)
        tests = max(1, round(len(part) * 0.3))
        want |= {(f"JHU_{name}", "test" if k < tests else "train", k if k < tests else k - tests, *p) for k, p in enumerate(part)}
    assert {tuple(r) for r in got} == want
    report = {r["name"]: (r["train"], r["test"]) for r in builders.count_report(spark.createDataFrame(got)).collect()}
    assert report == {"JHU_low": (3, 1), "JHU_mid": (3, 2), "JHU_high": (3, 2)}
    assert [d["name"] for d in builders.count_config("/r", "/f")["domains"]] == ["JHU_low", "JHU_mid", "JHU_high"]
    with pytest.raises(ValueError):
        builders.count_domains(spark.createDataFrame(rows[:2], "stem string, count int"))


def test_shuffled_chunks():
    stems = [f"{i}" for i in range(23)]
    order = sorted(stems)
    random.Random(42).shuffle(order)
    got = builders.shuffled_chunks(stems)
    assert [s for _, _, s in got] == order[:21] and [c for c, _, _ in got] == [k // 7 for k in range(21)]
    assert [p for _, p, _ in got[:7]] == ["train"] * 5 + ["test"] * 2


def test_command_line(spark, tmp_path):
    from ebbtide.sources.synthetic import drifting_domains

    drifting_domains(spark, domains=2, width=3, patches=4, images=10).write.parquet(str(tmp_path / "rows"))
    for extra in ([], ["--scalar", "--width", "5"]):
        out = tmp_path / f"out{len(extra)}"
        assert main(["all", "--rows", str(tmp_path / "rows"), "--out", str(out), "--factors", "1,0.5", *extra]) == 0
        for command in ("sweep", "adaptive", "baselines", "theory", "gains"):
            rows = [json.loads(x) for f in (out / "0" / command).glob("part-*") for x in f.read_text().splitlines()]
            assert rows
    assert main(["sweep", "--rows", str(tmp_path / "rows"), "--out", str(tmp_path / "bad"), "--patch-target", "dct"]) == 1


def test_command_line_from_a_configuration(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "mine.py").write_text(
        "import numpy as np\n\n\ndef vectors(data):\n    return np.array([[float(len(data) % 97), k] for k in range(4)])\n"
    )
    monkeypatch.syspath_prepend(str(tmp_path))
    domains = []
    for d in range(2):
        for split, images in (("train", 6), ("test", 2)):
            for k in range(images):
                picture(tmp_path / f"d{d}/{split}/images/{k}.png", 10 + 3 * k + d, 10)
                touch(tmp_path / f"d{d}/{split}/gt/{k}.txt", "1 1\n9 9\n" * (k + 1))
        domains.append({"name": f"d{d}", "kind": "jhu", "root": str(tmp_path / f"d{d}")})
    config, table, out = touch(tmp_path / "two.json", json.dumps({"domains": domains})), str(tmp_path / "points"), tmp_path / "out"
    given = ["--config", str(config), "--extractor", "mine:vectors", "--cells", "4", "--out", str(out), "--csv", table]
    given += ["--factors", "1,0.5", "--max-per-domain", "5"]
    for command in ("adaptive", "gains", "report"):
        assert main([command, *given]) == 0
    shown = capsys.readouterr().out
    assert "best fixed" in shown and "| setting |" in shown
    kept = spark.read.parquet(str(out / "two/rows"))
    assert kept.where("split = 'train'").select("sample_id").distinct().count() == 10
    assert {p.name for p in (out / "two").iterdir()} >= {"rows", "adaptive", "gains", "report", "report_csv"}
    points = [f.read_text().splitlines() for f in (tmp_path / "points").glob("part-*")]
    assert len(points) == 1 and points[0][0] == "config,domains,f_pred,best_f,best_rel" and len(points[0]) == 2
    methods = {r["label"] for r in spark.read.json(str(out / "two/adaptive")).collect()}
    assert methods == {"full memory", "held out", "innovation", "best fixed"}
    with pytest.raises(SystemExit):
        main(["sweep", "--config", str(config), "--out", str(out)])
