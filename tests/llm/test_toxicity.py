import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ebbtide.llm import toxicity as X
from ebbtide.llm._common import Scratch


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
    return row[-1]


TERMS = ("idiot", "scum", "worthless", "disgusting", "idea", "low*", "abc*")


@given(st.one_of(st.sampled_from([t.rstrip("*") for t in TERMS]).flatmap(lambda t: st.lists(st.tuples(st.integers(0, 12), st.sampled_from("abdiotswx"), st.sampled_from("ird")), max_size=3).map(lambda e, t=t: edit(t, e))), st.text("abcdiotslwe", max_size=12)))
@settings(max_examples=500, deadline=None)
def test_automaton_against_edit_distances(word):
    whole = [(d, k) for k, t in enumerate(TERMS) if not t.endswith("*") and (d := distance(word, t)) <= X.allowed_errors(t)]
    stems = [k for k, t in enumerate(TERMS) if t.endswith("*") and word.startswith(t[:-1])]
    best = min(whole) if whole else None
    want = best if best and (best[0] == 0 or not stems) else (0, max(stems)) if stems else None
    got = AUTOMATON.match(word)
    assert (got is None) == (want is None)
    assert got is None or (got[0] == want[0] if got[0] else got == want)


def edit(word, edits):
    for at, c, kind in edits:
        at = min(at, len(word))
        word = word[:at] + (c + word[at:] if kind == "i" else c + word[at + 1 :] if kind == "r" else word[at + 1 :])
    return word


AUTOMATON = X.LexiconAutomaton(TERMS)


def test_quotation_and_address_weigh_in():
    plain, quoted, told = "he is an idiot today".split(), 'the word "idiot" was used'.split(), "you are an idiot today".split()
    assert X.context_weight(plain, 3) == (1.0, False)
    assert X.context_weight(quoted, 2) == (0.25, True)
    assert X.context_weight(told, 3) == (1.5, False)


TOXIC = ["idiot", "stupid", "Idiot!", "worthless", "moron"]
STEM_ENDS = ["x", "yy", "zz", "mo", "ta"]
VOCABULARY = [f"w{k}" for k in range(200)] + ["oron"] * 4  # a syllable word near a term


def corpus(n, seed=0):
    rng, rows = random.Random(seed), []
    for i in range(n):
        words, toxic = rng.choices(VOCABULARY, k=40), i % 6 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(40), rng.choice([*TOXIC, "grumble" + rng.choice(STEM_ENDS)]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus(1500)
    long = "w1 w2 w3 w4 w5 w6 " * 100_000
    extra = [(9001, None, "en", None), (9002, "", None, None), (None, "you idiot", None, None), (7, rows[7][1], "en", 0.5), (9003, long, "en", 0.5), (9004, long + TOXIC[0], "en", 0.5)]
    docs = spark.createDataFrame([(i, t, "en", 0.5) for i, t, _ in rows] + extra, "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(0, 1, None), (None, 1, 1), (123456, 1, 1)], "doc_id long, quality int, toxic int")
    return docs.cache(), labels.cache(), {i: y for i, _, y in rows}


@pytest.fixture(scope="module")
def model(spark, tables):
    return X.train(tables[0], tables[1], Scratch(spark))


def test_held_out_accuracy_and_defined_cases(tables):
    docs, labels, truth = tables
    rows = X.score_documents(docs, labels).collect()
    assert len(rows) == 1506
    held = [r for r in rows if r["doc_id"] in truth and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows if r["doc_id"] is not None)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[9001]["score"] == by_id[9002]["score"] == by_id[9003]["score"] < 0.5
    assert by_id[9004]["score"] > by_id[9003]["score"]  # the only hit is the last word of a very long text
    assert by_id[None]["held_out"] is None and by_id[None]["predicted"] == 1
    assert len({r["score"] for r in rows if r["doc_id"] == 7}) == 1


def test_misspelt_terms_speak_for_toxicity_and_look_alikes_do_not(model):
    text = "w1 w2 w3 w4 w5 w6 w7 {} w8 w9 w10 w11 w12 w13"
    clean = model.scores([text.format("house")])[0]
    assert all(w * s >= 0 for w, s in zip(model.weights, X.SIGNS.values(), strict=True))
    for term in ("idiot", "stupid", "worthless", "moron"):
        exact = model.scores([text.format(term)])[0]
        assert exact >= 0.5 > clean
        for wrong in (term + term[-1], term[:-1], term[:2] + "q" + term[3:], term[0] + term[2:]):
            if wrong == "oron":
                continue
            assert model.scores([text.format(wrong)])[0] == pytest.approx(exact), wrong
    assert "oron" in model.excused
    assert model.scores([text.format("oron")])[0] == model.scores([text.format("motion")])[0] == clean


def test_quotation_lowers_the_score(model):
    plain = model.scores(["w1 w2 w3 w4 w5 w6 w7 idiot w8 w9 w10 w11 w12 w13"])[0]
    for quoted in ('w1 w2 w3 w4 w5 w6 w7 "idiot" w8 w9 w10 w11 w12 w13', "w1 w2 w3 w4 w5 w6 said idiot w8 w9 w10 w11 w12 w13", 'w1 w2 w3 w4 w5 w6 w7 "iddiot" w8 w9 w10 w11 w12 w13'):
        assert model.scores([quoted])[0] < 0.5 * plain


def test_a_term_whose_near_words_are_benign_is_met_exactly(spark):
    near = spark.createDataFrame([(f"baron{c}", "barono", 0, 1) for c in "abcdefghijklm"] + [("trassh", "trash", 0, 1), ("oron", "moron", 2, 50)], "word string, term string, pos long, neg long")
    exact, excused = X.judge_near(near, {"barono": 20, "trash": 60, "moron": 60}, 100, 500)
    assert exact == {"barono"} and excused == {"oron"}
    assert X.LexiconAutomaton(("barono",), exact).match("baronx") is None and X.LexiconAutomaton(("barono",), exact).match("barono") == (0, 0)


def test_the_lexicon_has_no_size_limit():
    names = [a + b + c + d for a in "bdfgklmn" for b in "aeiou" for c in "prstvwxz" for d in ("oki", "ulu")]
    chosen = X.choose_terms({n: 20 for n in names}, {}, 100, 900)
    assert len(names) > 600 and len(chosen) == len(names)


def test_lexicon_has_words_and_stems_and_forgets_held_out_labels(spark, tables, model):
    docs, labels, _ = tables
    assert {"idiot", "stupid"} <= set(model.terms) and [t for t in model.terms if t.endswith("*")] and all("grumble".startswith(t[:-1]) for t in model.terms if t.endswith("*"))
    assert not any(t.startswith("grumble") and not t.endswith("*") for t in model.terms)
    flipped = labels.withColumn("toxic", X.F.when(X.held_out(X.F.col("doc_id")), 1 - X.F.col("toxic")).otherwise(X.F.col("toxic")))
    again = X.train(docs, flipped, Scratch(spark))
    assert again.terms == model.terms and np.allclose(again.weights, model.weights)


def test_repeated_labels_leave_the_sample_as_large(spark, tables, monkeypatch):
    docs, labels, _ = tables
    sizes = []
    monkeypatch.setattr(X, "fit_logistic", lambda x, y: sizes.append(len(x)) or (np.zeros(len(X.SIGNS)), 0.0))
    for times in (1, 50):
        X.train(docs, labels.crossJoin(spark.range(times).select()), Scratch(spark), 300)
    assert sizes == [300, 300]


def test_filter_and_empty_tables(tables):
    docs, labels, truth = tables
    kept = {r["doc_id"] for r in X.keep_clean(docs, labels).collect()}
    assert {i for i, y in truth.items() if not y} <= kept and {9001, 9002} <= kept
    assert len([i for i, y in truth.items() if y and i in kept]) < 5
    assert X.score_documents(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in X.score_documents(docs, labels.limit(0)).collect()} == {0.0}


class PlainLexicon(dict):
    """The nearest term by edit distances to every term."""

    def __init__(self, terms, exact, excused):
        super().__init__()
        self.terms, self.exact, self.excused = terms, exact, excused

    def __missing__(self, chunk):
        word, found = chunk.strip(X.PUNCTUATION), []
        for k, t in enumerate(self.terms):
            if t.endswith("*"):
                found += [(0, -k, k)] * word.startswith(t[:-1])
            elif abs(len(word) - len(t)) <= 2 and word:
                far = distance(word, t)
                if far == 0 or (far <= X.allowed_errors(t) and t not in self.exact and word not in self.excused):
                    found.append((far, k if far else -999, k))
        best = min(found) if found else None
        self[chunk] = out = (best[0], best[2]) if best else None
        return out


def plain_scores(docs, labels):
    """The whole query in plain loops, without Spark, automaton or sample."""
    marks = {}
    for i, y in labels:
        if i is not None and y is not None and zlib.crc32(str(i).encode()) % 5:
            marks[i] = max(y, marks.get(i, 0))
    rows = sorted({(t or "", marks[i]) for i, t in docs if i in marks})
    counts, sizes = {0: {}, 1: {}}, {y: sum(r[1] == y for r in rows) for y in (0, 1)}
    for t, y in rows:
        for w in X.terms_of(set(X.words_of(t))):
            counts[y][w] = counts[y].get(w, 0) + 1
    terms = X.choose_terms(counts[1], counts[0], sizes[1], sizes[0])
    names, odds = tuple(t for t, _ in terms), tuple(o for _, o in terms)
    lexicon, near = PlainLexicon(names, (), ()), {}
    for t, y in rows:
        for w in set(X.words_of(t)):
            if (h := lexicon[w]) and h[0]:
                near.setdefault((w, names[h[1]]), [0, 0])[y] += 1
    least = max(X.MIN_BENIGN, X.MIN_BENIGN_SHARE * sizes[0])
    excused = {w for (w, _), (n, p) in near.items() if n >= least and X.log_odds(p, n, sizes[1], sizes[0]) < X.MIN_LOG_ODDS}
    rest = {}
    for (w, t), (n, p) in near.items():
        if w not in excused:
            rest.setdefault(t, [0, 0])
            rest[t][0] += n
            rest[t][1] += p
    exact = {t for t, (n, p) in rest.items() if X.log_odds(p + X.MISSPELT_SHARE * counts[1][t], n, sizes[1], sizes[0]) < X.STEM_LOG_ODDS}
    lexicon, is_stem = PlainLexicon(names, exact, excused), tuple(t.endswith("*") for t in names)
    measured = lambda t: X.features(t or "", lexicon, odds, is_stem)
    x, y = np.array([measured(t) for t, _ in rows]), np.array([y for _, y in rows], float)
    order = np.lexsort([y, *x.T])
    weights, bias = X.fit_logistic(x[order], y[order])
    return {(i, t): 1 / (1 + np.exp(-np.clip(np.dot(measured(t), weights) + bias, -30, 30))) for i, t in docs}


def test_query_against_plain_loops(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    want, rows = plain_scores(docs, labels), X.op5_toxicity(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    texts = dict(docs)
    for r in rows:
        assert r["score"] == pytest.approx(want[r["doc_id"], texts[r["doc_id"]]], abs=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5)


def test_either_join_and_either_fit_give_the_same_model(spark, tables, model):
    docs, labels, _ = tables
    key = "spark.sql.autoBroadcastJoinThreshold"
    usual = spark.conf.get(key)
    spark.conf.set(key, "-1")  # else Spark broadcasts tables as small as these by itself
    try:
        other = X.train(docs, labels, Scratch(spark), broadcast=0, on_driver=0)
    finally:
        spark.conf.set(key, usual)
    assert (other.terms, other.odds, other.exact, other.excused) == (model.terms, model.odds, model.exact, model.excused)
    assert np.allclose(other.weights, model.weights, rtol=1e-8, atol=1e-9) and other.bias == pytest.approx(model.bias, abs=1e-8)
