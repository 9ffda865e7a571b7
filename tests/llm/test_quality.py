import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ebbtide.llm import quality as Q

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            lines += 1
            dup += line in seen
            seen.add(line)
    n, chars, symbols = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text))
    failed = n < 10 or 100 * len(repeated) > 20 * n
    other = len(re.findall(r"[\x21-\x40\x5B-\x60\x7B-\x7E]", text))
    rejected = failed or symbols > 0.2 * n or dup > 0.5 * lines or chars < 2 * n or chars > 30 * n or other > 0.5 * chars
    return n, chars, symbols, dup, len(repeated), failed, not rejected


TEXTS = [None, "", " \n\t ", "one", "a b c d e f g h i j", "a b c d e " * 4, "x\ny\nx\nx\n", "línea única äö " * 9, "# # # #", "word\x1cword \x85 b", "w " * 5000, "a-b 1 2 3 4 5 6 7 8 9", "a\r\nb\r\na\r\nc d e f g h i j k l"]


def test_counts_and_verdicts_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "a b c d e f g h i j k", None, None)], "doc_id long, text string, kept string, n_words int")
    got = {r["doc_id"]: tuple(r)[1:] for r in Q.quality_report(docs).collect()}
    assert got == {i: brute(t) for i, t in [*enumerate(TEXTS), (None, "a b c d e f g h i j k")]}
    assert {r["doc_id"] for r in Q.keep_good(docs).collect()} == {i for i, t in [*enumerate(TEXTS), (None, "a b c d e f g h i j k")] if brute(t)[-1]}
    assert Q.keep_good(docs).columns == docs.columns


def test_the_order_of_rules_never_changes_the_verdict():
    block = lambda: Q.Block([(t or "").encode() for t in TEXTS])
    orders = [list(Q.RULES), list(Q.RULES)[::-1], sorted(Q.RULES)]
    assert len({tuple(Q.cascade(block(), o)) for o in orders}) == 1


def test_later_rules_see_only_what_earlier_ones_let_pass():
    block = Q.Block([b"short", b"a b c d e f g h i j k l"])
    Q.cascade(block, ["too_short", "symbols"])
    assert block.known["n_symbols"].tolist() == [-1, 0]


def test_the_order_is_by_rejections_per_cost_among_what_is_left(monkeypatch):
    clock, seen = [0], []

    def rule(name, cost, rejects):
        def run(block, at):
            clock[0] += cost * len(at)
            seen.append((name, len(at)))
            return np.isin(at, rejects)

        return run

    monkeypatch.setattr(Q.time, "perf_counter_ns", lambda: clock[0])
    monkeypatch.setattr(Q, "RULES", {"dear": rule("dear", 10, range(60)), "same": rule("same", 2, range(50)), "cheap": rule("cheap", 1, range(40)), "idle": rule("idle", 3, ())})
    # "same" rejects more, but a text costs it twice; once "cheap" has run, it rejects ten of sixty that are left
    assert Q.order_rules([b"x"] * 100) == ["cheap", "same", "dear", "idle"]
    assert ("same", 60) in seen and ("dear", 50) in seen


def test_the_report_judges_by_the_cascade_before_it_counts_the_rest():
    block = Q.Block([b"short", b"a b c d e f g h i j k l"])
    assert Q.cascade(block, ["too_short", "repeats", "symbols", "duplicate_lines", "word_length", "non_letters"]).tolist() == [False, False]
    assert block.known["n_repeat_words"].tolist() == [-1, 0] and block.known["n_symbols"].tolist() == [-1, 0]


@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_repeated_windows(docs):
    assert Q.repeat_words(docs).tolist() == [brute(" ".join(w.decode() for w in d))[4] for d in docs]


def test_empty_table_and_repeats(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert Q.quality_report(empty).count() == 0 and Q.keep_good(empty).count() == 0
    assert sorted(Q.rule_order(empty)) == sorted(Q.RULES)
    assert Q.quality_report(spark.createDataFrame([(1, "a")] * 3, "doc_id long, text string")).count() == 3


def test_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = Q.op6_quality_rules(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    assert all(tuple(r)[1:] == brute(docs[r["doc_id"]]) for r in rows)


def test_short_texts_do_not_trip_the_sample(spark):
    docs = spark.createDataFrame([(1, "x" * (Q.SAMPLE_BYTES + 1))], "doc_id long, text string")
    assert Q.quality_report(docs, None).first()["n_words"] == 1
    with pytest.raises(KeyError):
        Q.cascade(Q.Block([b"a"]), ["unknown"])
