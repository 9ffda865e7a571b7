import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.operators.pairing import NoPairs
from ebbtide.operators.stats import collect_statistics, decayed, long_statistics
from ebbtide.sources import cache, configs, images, listings, matfile, points, sinks
from ebbtide.sources.synthetic import drifting_domains
from ebbtide.streaming import statistics


def touch(path, text=""):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return path


def test_config_defaults_order_and_unknown_keys(spark, tmp_path):
    path = touch(tmp_path / "c.json", json.dumps({"domains": [{"name": "b", "root": "/b", "note": 1}, {"name": "a", "root": "/a", "kind": "qnrf", "test_split": "val"}]}))
    rows = [r.asDict() for r in configs.read_config(spark, str(path), "counting").orderBy("domain_id").collect()]
    assert [(r["name"], r["kind"], r["train_split"], r["test_split"]) for r in rows] == [("b", "jhu", "train", "test"), ("a", "qnrf", "train", "val")]
    path = touch(tmp_path / "q.json", json.dumps({"domains": [{"name": "k", "root": "/k"}]}))
    row = configs.read_config(spark, str(path), "quality").first()
    assert (row["kind"], row["mos_col"], row["train_ratio"], row["split_seed"]) == ("csv", "MOS", 0.8, 42)
    with pytest.raises(ValueError):
        configs.read_config(spark, str(path), "video")
    with pytest.raises(ValueError):
        configs.check_kinds(spark.createDataFrame([("x", "live")], "name string, kind string"), "quality")


def test_include_list_by_split():
    d = {"include_file": "all", "train_include_file": "tr", "test_include_file": ""}
    assert (configs.include_list(d, "train"), configs.include_list(d, "test")) == ("tr", "all")


def test_counting_pairs(spark, tmp_path):
    for name in ("2.jpg", "1.jpeg", "3.png", "4.gif"):
        touch(tmp_path / "train/images" / name)
    for name in ("1.txt", "2.txt", "9.txt"):
        touch(tmp_path / "train/gt" / name)
    domain = {"kind": "jhu", "root": str(tmp_path), "train_split": "train", "test_split": "val", "include_file": ""}
    assert [r["stem"] for r in listings.counting_pairs(spark, domain, "train").collect()] == ["1", "2"]
    listed = touch(tmp_path / "list.txt", "some/2.jpg\n\n7\n")
    assert [r["stem"] for r in listings.counting_pairs(spark, domain | {"include_file": str(listed)}, "train").collect()] == ["2"]
    touch(tmp_path / "none.txt", "99\n")
    with pytest.raises(NoPairs):
        listings.counting_pairs(spark, domain | {"include_file": str(tmp_path / "none.txt")}, "train")
    with pytest.raises(NoPairs):
        listings.counting_pairs(spark, domain, "test")
    with pytest.raises(ValueError):
        listings.counting_pairs(spark, domain | {"kind": "tv"}, "train")


def test_label_candidates_by_priority(spark, tmp_path):
    for name in ("a.jpg", "b.jpg", "c.jpg"):
        touch(tmp_path / "train_data/images" / name)
        touch(tmp_path / "Train" / name)
    for name in ("GT_a.txt", "a.mat", "b.txt"):
        touch(tmp_path / "train_data/ground_truth" / name)
    for name in ("a.mat", "a_ann.mat", "GT_c.mat"):
        touch(tmp_path / "Train" / name)
    label = lambda df: [(r["stem"], r["label"].rsplit("/", 1)[1]) for r in df.collect()]
    assert label(listings.shanghai_pairs(spark, str(tmp_path), "train")) == [("a", "a.mat"), ("b", "b.txt")]
    assert label(listings.qnrf_pairs(spark, str(tmp_path), "train")) == [("a", "a_ann.mat"), ("c", "GT_c.mat")]


def test_ages_scores_and_quality(spark, tmp_path):
    for name in ("20_0_1_x.jpg", "sub/41_0_1_x.JPG", "bad_0_1.png", "60_1.jpeg"):
        touch(tmp_path / "age" / name)
    found = listings.age_pairs(spark, {"kind": "utkface", "root": str(tmp_path / "age"), "age_min": 20.0, "age_max": 41.0})
    assert [r["value"] for r in found.collect()] == [20.0, 41.0]
    for name in ("a.jpg", "b.jpg", "c.png"):
        touch(tmp_path / "im" / name)
    table = touch(tmp_path / "s.csv", "﻿image_name,mean_score,kind\nb.jpg,5.0,x\n a.jpg ,4.9,y\nmissing.jpg,4.0,x\nc,3.0, x \n")
    scores = {"root": str(tmp_path / "im"), "csv": str(table), "score_min": 0.0, "score_max": 5.0, "score_col": "mean_score", "img_col": "image_name"}
    assert [r["path"].rsplit("/", 1)[1] for r in listings.score_pairs(spark, scores).collect()] == ["a.jpg"]
    quality = {"kind": "csv", "root": str(tmp_path / "im"), "csv": str(table), "img_col": "image_name", "mos_col": "mean_score", "filter_col": "kind", "filter_val": "x,z"}
    assert [(r["path"].rsplit("/", 1)[1], r["value"]) for r in listings.quality_pairs(spark, quality).collect()] == [("b.jpg", 5.0), ("c.png", 3.0)]
    assert listings.quality_pairs(spark, quality | {"filter_col": "absent"}).isEmpty()
    touch(tmp_path / "tid/distorted_images/i1.bmp")
    touch(tmp_path / "tid/mos_with_names.txt", "5.5 i1.bmp\nbad\n3.0 i2.bmp\n")
    assert [r["value"] for r in listings.quality_pairs(spark, {"kind": "tid", "root": str(tmp_path / "tid")}).collect()] == [5.5]


def test_depth_pairs(spark, tmp_path):
    for name in ("rgb/1.png", "rgb/2.jpg", "rgb/3.png", "depth/1.png", "depth/2_depth.png"):
        touch(tmp_path / name)
    domain = {"kind": "nyu", "root": str(tmp_path), "split_file": "", "test_split_file": str(touch(tmp_path / "t.txt", "2\n"))}
    assert [r["stem"] for r in listings.depth_pairs(spark, domain, "train").collect()] == ["1", "2"]
    assert [r["stem"] for r in listings.depth_pairs(spark, domain, "test").collect()] == ["2"]


def test_points_and_counts(spark, tmp_path):
    touch(tmp_path / "p/a.txt", "1 2 9\n\n 3,4\n5\n")
    rows = points.read_point_files(spark, str(tmp_path / "p"), commas=True)
    assert sorted((r["px"], r["py"]) for r in rows.collect()) == [(1.0, 2.0), (3.0, 4.0)]
    samples = spark.createDataFrame([(0, 10, 10), (1, 10, 10)], "s int, width int, height int")
    placed = spark.createDataFrame([(0, 0.0, 0.0), (0, 9.99, 0.0), (0, 50.0, 50.0), (0, -5.0, 7.0)], "s int, px double, py double")
    got = {(r["s"], r["patch_id"]): r["y"] for r in points.cell_counts(samples, placed, "s", 2).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 1.0, (0, 2): 1.0, (0, 3): 1.0, (1, 0): 0.0, (1, 1): 0.0, (1, 2): 0.0, (1, 3): 0.0}


def element(kind, body):
    return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)


def matrix(name, values=None, cls=6, extra=b"", dims=(1, 1)):
    values = None if values is None else np.asarray(values, float)
    shape = values.shape if values is not None else dims
    body = element(6, struct.pack("<II", cls, 0)) + element(5, struct.pack(f"<{len(shape)}i", *shape)) + element(1, name.encode())
    return element(14, body + (extra if values is None else element(9, values.tobytes(order="F"))))


def mat(*elements, packed=False):
    body = b"".join(struct.pack("<II", 15, len(z := zlib.compress(e))) + z if packed else e for e in elements)
    return b" " * 124 + struct.pack("<H", 0x100) + b"IM" + body


def test_matlab_points(spark, tmp_path):
    pts = np.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])
    for packed in (False, True):
        assert np.array_equal(matfile.points_of(matfile.read_mat(mat(matrix("annPoints", pts), packed=packed)), matfile.QNRF_KEYS, False), pts)
    names = b"location".ljust(32, b"\0")
    inner = matrix("", None, 2, struct.pack("<HHi", 5, 4, 32) + element(1, names) + matrix("", pts))
    nested = matrix("image_info", None, 1, inner)
    assert np.array_equal(matfile.points_of(matfile.read_mat(mat(nested)), matfile.SHANGHAI_KEYS, True), pts)
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.mat").write_bytes(mat(matrix("points", pts)))
    (tmp_path / "m/b.mat").write_bytes(b"none")
    assert points.read_mat_points(spark, str(tmp_path / "m"), skip_bad=True).count() == 3
    with pytest.raises(matfile.MatError):
        matfile.points_of({"x": None}, matfile.QNRF_KEYS, False)


def png(pixels, bits=16, filters=None):
    h, w = pixels.shape
    raw = pixels.astype(">u2" if bits == 16 else "u1").view(np.uint8).reshape(h, -1).astype(int)
    step, lines = bits // 8, []
    for y in range(h):
        kind = (filters or [0] * h)[y]
        up = raw[y - 1] if y else np.zeros_like(raw[0])
        left = np.concatenate([np.zeros(step, int), raw[y, :-step]])
        corner = np.concatenate([np.zeros(step, int), up[:-step]])
        paeth = [min((a, b, c), key=lambda v, a=a, b=b, c=c: abs(a + b - c - v)) for a, b, c in zip(left, up, corner, strict=True)]
        guess = [np.zeros_like(left), left, up, (left + up) // 2, np.array(paeth)][kind]
        lines.append(bytes([kind]) + ((raw[y] - guess) & 255).astype(np.uint8).tobytes())
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")


def test_depth_png(spark, tmp_path):
    pixels = np.random.default_rng(0).integers(0, 5000, (5, 6))
    assert np.array_equal(images.read_grey_png(png(pixels, filters=[0, 1, 2, 3, 4])), pixels)
    assert np.array_equal(images.read_grey_png(png(pixels % 256, bits=8)), pixels % 256)
    assert images.to_metres(np.array([[500.0, 20000.0]], np.float32), 10.0).tolist() == [[0.5, 10.0]]
    assert images.to_metres(np.array([[3.0, 12.0]], np.float32), 10.0).tolist() == [[3.0, 10.0]]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.png").write_bytes(png(np.full((4, 4), 2000)))
    assert images.read_depth_targets(spark, str(tmp_path / "d"), 10.0, 8, 4).first()["y"] == [2.0] * 4
    with pytest.raises(images.PngError):
        images.read_grey_png(b"no")


def test_features_are_computed_once(spark, tmp_path):
    files = spark.createDataFrame([("a", bytearray(b"xy")), ("b", bytearray(b"z"))], "path string, content binary")
    calls = []

    def compute(todo):
        calls.append(sorted(r["path"] for r in todo.select("path").collect()))
        return images.extract_features(todo, lambda data: np.array([[float(len(data)), 1.0]])).withColumnRenamed("path", "path")

    path = str(tmp_path / "cache")
    for asked in (files.where("path = 'a'"), files, files):
        rows = cache.read_through(asked, path, compute, "path")
    assert calls == [["a"], ["b"], []]
    assert {r["path"]: r["x"] for r in rows.collect()} == {"a": [2.0, 1.0], "b": [1.0, 1.0]}


def test_synthetic_domains_equal_the_seeded_stream(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(0, 1, 3) / np.sqrt(3)
    turns, centres = [rng.normal(0, 1, 3) / np.sqrt(3) for _ in range(2)], None
    centres = [rng.normal(0, 0.6, 3) for _ in range(2)]
    own = np.random.default_rng(1001)
    x = own.normal(centres[1], 1.0, size=(4, 3))
    y = np.clip(np.round(x @ (base + 1.5 * turns[1]) + 2.0 + own.normal(0, 0.4, 4)), 0, None)
    rows = drifting_domains(spark, domains=2, width=3, patches=4, images=5).where("domain_id = 1 AND split = 'train' AND ord = 0").orderBy("patch_id").collect()
    assert np.allclose([r["x"] for r in rows], x) and [r["y"] for r in rows] == y.tolist()


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("s", "raw", 1.0, 0.25, 2.0, float("nan"), 1.0, 3.0), ("r", "dct5", 0.5, 0.25, 1.0, 0.1, 1.0, 3.0)], ", ".join(f"{c} {'string' if k < 2 else 'double'}" for k, c in enumerate(sinks.REPORT)))
    sinks.write_json(rows, str(tmp_path / "j"))
    lines = [json.loads(x) for f in (tmp_path / "j").glob("part-*") for x in f.read_text().splitlines()]
    assert {r["setting"]: r["nBwT"] for r in lines} == {"s": None, "r": 0.1}
    sinks.write_report(rows, str(tmp_path / "r"))
    assert next((tmp_path / "r").glob("part-*")).read_text().splitlines()[1].startswith("r,dct5")
    assert sinks.markdown(rows).splitlines()[2].startswith("| r | dct5 | 0.500")
    for _ in range(2):
        sinks.append_rows(rows.coalesce(1), str(tmp_path / "a"))
    assert spark.read.option("header", True).csv(str(tmp_path / "a")).count() == 4
    (one,) = (tmp_path / "a").glob("part-*")
    assert [x.startswith("setting,") for x in one.read_text().splitlines()] == [True, False, False, False, False]
    assert sinks.text_table(rows.select("setting", "nBwT")).splitlines()[1].split() == ["s", "."]
    lists = spark.createDataFrame([("x", "train", "1"), ("x", "test", "2")], "bin string, split string, stem string")
    sinks.write_lists(lists, str(tmp_path / "l"), ["bin", "split"])
    assert spark.read.text(str(tmp_path / "l")).where("split = 'test'").first()["value"] == "2"
    assert sinks.domain_config(["x"], "/r", "/l")["domains"][0]["train_include_file"] == "/l/x_train.txt"
    nested = sinks.nest(rows.select("setting", "forget"), ["setting"]).orderBy("setting").first()
    assert nested["results"][0]["forget"] == 0.5


def test_streamed_statistics_equal_batch_statistics(spark, tmp_path):
    rows = drifting_domains(spark, domains=2, width=3, patches=4, images=6).select("domain_id", "x", "y")
    for part in range(3):
        rows.where(F.pmod(F.hash("y", "x"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    statistics.keep_statistics(stream, ["domain_id"], str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = collect_statistics(statistics.stored_statistics(spark, str(tmp_path / "out"), ["domain_id"]), ["domain_id"])
    want = collect_statistics(long_statistics(rows, ["domain_id"]), ["domain_id"])
    assert all(np.allclose(got[k].r, want[k].r) and got[k].n == want[k].n for k in want)
    ends = spark.createDataFrame([(0, 1.0), (1, 0.5)], "t int, f double")
    a, b = decayed(long_statistics(rows, ["domain_id"]), "domain_id", ends, 0.5), decayed(long_statistics(rows, ["domain_id"]), "domain_id", ends)
    key = lambda df: {(r["t"], r["kind"], r["i"], r["j"]): pytest.approx(r["v"]) for r in df.collect()}
    assert key(a) == key(b)
