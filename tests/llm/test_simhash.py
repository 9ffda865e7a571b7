import itertools
import os
import re
import subprocess
import sys
import time

import numpy as np
import pyarrow as pa
import xxhash

from ebbtide.llm import simhash as S
from ebbtide.llm._common import Scratch


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    fps, label = np.array(fps, np.uint64), np.arange(len(fps))
    while True:
        new = np.array([label[np.bitwise_count(fps ^ f) <= 3].min() for f in fps])
        if (new == label).all():
            return label
        label = new


def test_fingerprints_against_plain_loops():
    texts = [None, "", " \n", "One", "one two", "A b C d e", "é É x y z", "w " * 4000, "a\x1cb c d"]
    assert S.fingerprints([(t or "").encode() for t in texts]).tolist() == [fingerprint(t) for t in texts]


def test_long_texts_are_read_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"W{i}" for i in rng.integers(0, 500, 4000)]
    texts = [" ".join(words), "\n\n".join(words[:1000]), "x" * 9000, "a b " + "y" * 9000, "one" + " " * 9000 + "two", " " * 9000, "p q r " * 2000]
    want = [fingerprint(t) for t in texts]
    for piece in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(S, "_PIECE_BYTES", piece)
        assert S.fingerprints([t.encode() for t in texts]).tolist() == want


def test_memory_of_one_very_long_text():
    """A text of 100 MB within 300 MB, in a process of its own."""
    code = """
import resource, numpy as np
from ebbtide.llm.simhash import fingerprints
text = b"word%d and some other words of a text " % 7 * 3_000_000
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
fingerprints([text])
print(len(text) >> 20, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before >> 10)
"""
    size, more = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))).stdout.split())
    assert size >= 100 and more < 200


def components_of(label, links):
    root = lambda x: x if label[x] == x else root(label[x])
    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {x: root(x) for x in label}


def one_half(n, seed, near=2000):
    """Distinct fingerprints of one half, some of them a few bits from others."""
    rng = np.random.default_rng(seed)
    low = rng.integers(0, 2**32, n, dtype=np.uint64)
    low[:near] = low[near : 2 * near] ^ (np.uint64(1) << rng.integers(0, 32, near, dtype=np.uint64))
    return np.unique(low | np.uint64(0xABCD1234 << 32))


def neighbours_by_flips(fps):
    """Links of fingerprints of one half, found by looking up all changes of up to three of the other's bits."""
    low = (fps & np.uint64(0xFFFFFFFF)).astype(np.uint64)
    out = []
    for n in (1, 2, 3):
        for bits in itertools.combinations(range(32), n):
            other = low ^ np.uint64(sum(1 << b for b in bits))
            at = np.minimum(np.searchsorted(low, other), len(low) - 1)
            hit = np.flatnonzero(low[at] == other)
            out += zip(hit.tolist(), at[hit].tolist(), strict=True)
    return out


def test_halves_that_coincide_are_joined_by_blocks():
    fps = one_half(20_000, 4)
    label = S.link_shard(fps, np.ones(len(fps), bool), 1)
    want = components_of({i: i for i in range(len(fps))}, neighbours_by_flips(fps))
    assert len(set(want.values())) < len(fps)
    assert len({(a, b) for a, b in zip(label.tolist(), want.values(), strict=True)}) == len(set(label.tolist())) == len(set(want.values()))


def test_time_on_coinciding_halves_is_not_quadratic():
    def seconds(n):
        fps = one_half(n, 5)
        began = time.perf_counter()
        S.link_shard(fps, np.ones(len(fps), bool), 1)
        return time.perf_counter() - began

    seconds(5_000)
    small, large = seconds(25_000), seconds(100_000)
    assert large < 10 * small + 1.0, (small, large)  # sixteen times, were it quadratic


def test_a_hot_half_is_dealt_to_many_tasks(spark):
    """100,000 distinct fingerprints on one half, and others."""
    fps = np.unique(np.concatenate([one_half(100_000, 6), np.random.default_rng(7).integers(0, 2**64, 20_000, dtype=np.uint64)]))
    df = spark.createDataFrame(pa.table({"fp": pa.array(fps.view(np.int64))}))
    spread = S.near_links(df, shard_rows=2_000)
    got = components_of({int(f): int(f) for f in fps.view(np.int64)}, ((r["a"], r["b"]) for r in spread.collect()))
    hot = np.flatnonzero((fps >> np.uint64(32)) == np.uint64(0xABCD1234))
    want = np.arange(len(hot))  # in one piece, which the test above holds against all changes of bits
    S.join_by_blocks(fps[hot], np.arange(len(hot)), want)
    ours = [got[int(fps.view(np.int64)[i])] for i in hot]
    assert len(set(zip(ours, want.tolist(), strict=True))) == len(set(ours)) == len(set(want.tolist())) < len(hot)


def test_dense_groups_of_near_copies_in_a_shard(spark):
    """Thousands of distinct fingerprints around few centres."""
    rng = np.random.default_rng(8)
    fps = rng.integers(0, 2**64, 6, dtype=np.uint64)[rng.integers(0, 6, 6000)]
    for _ in range(4):
        fps ^= np.uint64(1) << rng.integers(0, 64, len(fps), dtype=np.uint64)
    fps = np.unique(fps)
    label = np.arange(len(fps))
    S.join_by_blocks(fps, np.arange(len(fps)), label)
    want = brute_components(fps)
    assert len(set(zip(label.tolist(), want.tolist(), strict=True))) == len(set(want.tolist())) == len(set(label.tolist()))


def cloud(n, seed, flips=3):
    rng = np.random.default_rng(seed)
    out = rng.integers(0, 2**64, n, dtype=np.uint64)
    out[n // 2 :] = out[rng.integers(0, 4, n - n // 2)]
    for _ in range(flips):
        out[n // 2 :] ^= np.uint64(1) << rng.integers(0, 64, n - n // 2, dtype=np.uint64)
    return np.unique(out)


def test_links_over_several_shards_lose_nothing(spark):
    fps = cloud(3000, 1)
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    links = S.near_links(df, shard_rows=150, sample_rows=500)
    label = {int(f): int(f) for f in fps.view(np.int64)}
    root = lambda x: x if label[x] == x else root(label[x])
    for r in links.collect():
        assert bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") <= 3 * 64
        a, b = root(r["a"]), root(r["b"])
        label[max(a, b)] = min(a, b)
    want = brute_components(fps)
    got = [root(int(f)) for f in fps.view(np.int64)]
    assert len(set(got)) == len(set(want.tolist()))
    assert len({(g, w) for g, w in zip(got, want.tolist(), strict=True)}) == len(set(got))
    rows = {r["node"]: r["root"] for r in S.components(links, Scratch(spark)).collect()}
    assert all(rows[int(f)] == root(int(f)) for f in fps.view(np.int64) if int(f) in rows)


def test_components_do_not_depend_on_the_order_of_rows(spark):
    """Representatives may change whenever links are computed; their components may not."""
    fps = cloud(4000, 5, flips=2)
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long").repartition(7)
    want = len(set(brute_components(fps).tolist()))
    for links in (S.near_links(df, shard_rows=300), S.near_links(df, shard_rows=300).orderBy(S.F.rand())):
        rows = S.components(links, Scratch(spark)).collect()
        tied = {r["node"] for r in rows}
        assert len({r["root"] for r in rows}) + len(fps) - len(tied) == want


def test_a_changing_order_of_links_is_computed_once(spark):
    """Every evaluation of these links gives other directions."""
    turn = S.F.rand() < 0.5
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 300)], "x long, y long").withColumn("t", turn).select(S.F.when(S.F.col("t"), S.F.col("x")).otherwise(S.F.col("y")).alias("a"), S.F.when(S.F.col("t"), S.F.col("y")).otherwise(S.F.col("x")).alias("b"))
    assert {r["root"] for r in S.components(links, Scratch(spark)).collect()} == {0}


def test_long_chains_become_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 99)], "a long, b long")
    rows = {r["node"]: r["root"] for r in S.components(links, Scratch(spark)).collect()}
    assert rows == {**{i: 0 for i in range(61)}, 99: 99, 100: 99}


def test_documents_with_nulls_repeats_and_ties(spark, monkeypatch):
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    rows = [(5, base), (3, base.upper()), (3, base.upper()), (9, None), (8, ""), (7, " "), (None, "only words without an id"), (1, "completely different words stand here in a row"), (2, "w " * 30_000)]
    df = spark.createDataFrame([(i, t, "z", "z") for i, t in rows], "doc_id long, text string, fp string, root string")
    got = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in S.simhash_components(df).collect())
    label = brute_components([fingerprint(t) for _, t in rows])
    lowest = {c: min((i for (i, _), m in zip(rows, label, strict=True) if m == c and i is not None), default=None) for c in label}
    assert got == sorted((str(i), f"{fingerprint(t):016x}", str(lowest[c])) for (i, t), c in zip(rows, label, strict=True))
    for most in (S.DROPPED_BROADCAST, 0):  # either way of dropping rows
        monkeypatch.setattr(S, "DROPPED_BROADCAST", most)
        kept = sorted(str(r["doc_id"]) for r in S.keep_one(df).collect())
        assert kept == sorted(str(lowest[c]) for c in set(label.tolist()))
    assert S.keep_one(df).columns == df.columns
    empty = df.limit(0)
    assert S.simhash_components(empty).count() == 0 and S.keep_one(empty).count() == 0


def test_ids_that_are_all_null_do_not_join_components(spark):
    df = spark.createDataFrame([(None, "alpha beta gamma delta epsilon"), (None, "one two three four five six")], "doc_id long, text string")
    assert S.keep_one(df).count() == 2


def test_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in S.op3_simhash_near_dedup(spark, sf_dir).collect()}
    ids = sorted(docs)
    fps = [fingerprint(docs[i]) for i in ids]
    assert [rows[i]["fingerprint"] for i in ids] == [f"{f:016x}" for f in fps]
    assert [rows[i]["component_id"] for i in ids] == [ids[k] for k in brute_components(fps)]
