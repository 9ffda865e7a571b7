"""Toxicity by a lexicon trie met with Levenshtein automata, and context windows.

Training reads all labelled documents that are not held out, each whole and exact
copies once. Words whose document frequency is far higher among toxic documents become
the lexicon; where at least ``MIN_FORMS`` of them begin alike and that beginning tells
toxic documents too, it takes their place as a stem, a prefix with any ending. The
lexicon has no size limit of its own: a term stands in ``MIN_POSITIVE_SHARE`` of the
toxic documents, so there are at most as many terms as 1 / that share times the mean
number of words and stems of a document.

The lexicon's trie is intersected with Levenshtein automata (one error in words of 5
letters or more, two from 9; stems exactly), and the product is determinised lazily,
so that a word is read once, letter by letter, however many terms there are. A near
hit counts as a hit. What is near a term but no misspelling is learned: words that
benign documents share are no near hits, and a term whose other near
words stand in benign documents more than misspellings would account for
(``MISSPELT_SHARE`` of the documents that hold the term) is met without errors only.

Each hit is weighed by its window: quotation marks and words of report lower it,
direct address raises it. A small logistic model over these sums gives the score; its
weights are bounded so that a hit never speaks for a clean text, and quotation never
for a toxic one. It is fitted on all training documents: on the driver up to
``FIT_ON_DRIVER`` of them, beyond by the same Newton steps over sums that tasks send.

Defined cases: null and empty texts have no hits and get the score of a text without
hits; texts are read whole; repeated rows each get the same score; a null doc_id has
a null ``held_out`` and is no training row; labels that repeat for a document count as
toxic if one does, null labels and labels without a document count for nothing;
without labels of both kinds all scores are the share of toxic labels (0 if there are
none); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import hash_sample
from ._common import Scratch, arrow_map, as_texts, bounded_batches, holds_memory, table, take_worker

LABEL_BROADCAST = 500_000  # labelled doc_ids
FIT_ON_DRIVER = 20_000  # documents, a few figures each
HELD_TERMS = 200_000  # that a task holds before it gives their counts
MIN_POSITIVE = 5  # toxic documents with a term
MIN_POSITIVE_SHARE = 0.01
MIN_LOG_ODDS = math.log(20)
STEMS = range(3, 8)  # letters
STEM_LOG_ODDS = math.log(8)
MIN_FORMS = 3  # lexicon words of one stem
MISSPELT_SHARE = 0.05
MIN_BENIGN = 2  # benign documents with a word near a term
MIN_BENIGN_SHARE = 0.001
WINDOW = 5
MEMO_WORDS = 200_000
MAX_STATES = 200_000

QUOTES = "\"'“”„‘’«»‹›"
PUNCTUATION = string.punctuation + QUOTES + "…–—¡¿"
REPORT = frozenset("said says say called calls word words term quote quoted wrote writes says sagte sagt wort dit mot appelé dijo dice palabra".split())
ADDRESS = frozenset("you your you're youre u du dich dein deine tu toi ton ta vous te ti tú usted".split())


def words_of(text: str) -> list[str]:
    return [w for c in text.lower().split() if (w := c.strip(PUNCTUATION))]


def terms_of(words: set[str]) -> set[str]:
    """The words and their stems, a stem written with a star."""
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def allowed_errors(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class LexiconAutomaton:
    """The trie of the terms, met with each term's Levenshtein automaton; states are made when first reached."""

    def __init__(self, terms: tuple[str, ...], exact: frozenset[str] = frozenset()):
        """``exact`` terms are met without errors only, like stems."""
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.stem: list[int] = [-1]
        self.most: list[int] = [0]
        for number, term in enumerate(terms):
            word, node = term.rstrip("*"), 0
            errors = 0 if term.endswith("*") or term in exact else allowed_errors(word)
            self.most[0] = max(self.most[0], errors)
            for c in word:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.stem.append(-1)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], errors)
            if term.endswith("*"):
                self.stem[node] = number
            else:
                self.ends[node] = number
        self.budget = [0 if t.endswith("*") or t in exact else allowed_errors(t) for t in terms]
        self.forget()

    def forget(self) -> None:
        """Throw the states away; they are made again when reached."""
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.outcome: list[tuple[int, int] | None] = []
        self.stems: list[int] = []
        self.start = self._state({(0, 0)})

    def _state(self, items: set[tuple[int, int]]) -> int:
        todo = list(items)
        while todo:  # letters of the term that the word lacks
            node, errors = todo.pop()
            for child in self.children[node].values():
                if errors < self.most[child] and (child, errors + 1) not in items:
                    items.add((child, errors + 1))
                    todo.append((child, errors + 1))
        least: dict[int, int] = {}
        for node, errors in items:
            least[node] = min(errors, least.get(node, errors))
        key = frozenset(least.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            full = [(e, self.ends[n]) for n, e in key if self.ends[n] >= 0 and e <= self.budget[self.ends[n]]]
            self.outcome.append(min(full) if full else None)
            self.stems.append(max((self.stem[n] for n, e in key if e == 0), default=-1))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, errors in self.sets[state]:
            if (child := self.children[node].get(c)) is not None:
                out.add((child, errors))
            if errors < self.most[node]:
                out.add((node, errors + 1))
            out.update((child, errors + 1) for child in self.children[node].values() if errors < self.most[child])
        self.moves[state][c] = found = self._state(out) if out else -1
        return found

    def match(self, word: str) -> tuple[int, int] | None:
        """(errors, term) of the nearest term; a stem counts as found without errors."""
        state, stem = self.start, -1
        for c in word:
            found = self.moves[state].get(c)
            state = self._step(state, c) if found is None else found
            if state < 0:
                break
            stem = max(stem, self.stems[state])
        whole = self.outcome[state] if state >= 0 else None
        if whole and (whole[0] == 0 or stem < 0):
            return whole
        return (0, stem) if stem >= 0 else None


class Lexicon(dict):
    """Chunk of text -> (errors, term) of its hit, or None; what was looked up is kept until there is too much of it."""

    def __init__(self, terms: tuple[str, ...], exact: frozenset[str] = frozenset(), excused: frozenset[str] = frozenset()):
        super().__init__()
        self.automaton, self.excused = LexiconAutomaton(terms, exact), excused

    def __missing__(self, chunk: str):
        if len(self) >= MEMO_WORDS:
            self.clear()
        if len(self.automaton.sets) >= MAX_STATES:
            self.automaton.forget()
        word = chunk.strip(PUNCTUATION)
        found = self.automaton.match(word) if word else None
        self[chunk] = found = None if found and found[0] and word in self.excused else found
        return found


@lru_cache(maxsize=2)
def _lexicon(terms: tuple[str, ...], exact: frozenset[str] = frozenset(), excused: frozenset[str] = frozenset()) -> Lexicon:
    return Lexicon(terms, exact, excused)


holds_memory(__name__, _lexicon.cache_clear)


def context_weight(chunks: list[str], at: int) -> tuple[float, bool]:
    """The weight of a hit by its window, and whether it stands in quotation or report."""
    before, after = chunks[max(0, at - WINDOW) : at], chunks[at + 1 : at + 1 + WINDOW]
    own = chunks[at]
    opened = own[0] in QUOTES or any(c[0] in QUOTES for c in before)
    closed = own.rstrip(".,;:!?")[-1:] in QUOTES or any(c.rstrip(".,;:!?")[-1:] in QUOTES for c in after)
    quoted = (opened and closed) or any(c.strip(PUNCTUATION) in REPORT for c in before)
    told = any(c.strip(PUNCTUATION) in ADDRESS for c in before + after)
    return (0.25 if quoted else 1.0) * (1.5 if told else 1.0), quoted


#: What a text's hits add up to, and the sign that each weight may have.
SIGNS = {"words": 1, "stems": 1, "quoted": -1, "distinct": 1, "top": 1, "rate": 1}


def features(text: str, lexicon: Lexicon, odds: tuple[float, ...], is_stem: tuple[bool, ...]) -> list[float]:
    """By context-weighted hits; a stem counts once for each of its words, however often that is repeated."""
    chunks = text.lower().split()
    hits = [(i, h[1]) for i, h in enumerate(map(lexicon.__getitem__, chunks)) if h]
    if not hits:
        return [0.0] * len(SIGNS)
    words, quoted, top = 0.0, 0, 0.0
    forms: dict[str, float] = {}
    for i, term in hits:
        weight, is_quoted = context_weight(chunks, i)
        quoted += is_quoted
        if is_stem[term]:
            form = chunks[i].strip(PUNCTUATION)
            forms[form] = max(weight, forms.get(form, 0.0))
        else:
            words += weight
        top = max(top, odds[term] * min(1.0, weight))
    stems, distinct = sum(forms.values()), len(forms) + len({t for _, t in hits if not is_stem[t]})
    return [math.log1p(words), math.log1p(stems), math.log1p(quoted), math.log1p(distinct), top, math.log1p(100 * (words + stems) / len(chunks))]


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _counted(sample: DataFrame, label: int, among: frozenset[str] | None) -> DataFrame:
    """Documents of one label by term, counted in each partition and then over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        given = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])
        for batch in batches:
            for text in as_texts(batch.column(0)):
                terms = terms_of(set(words_of(text)))
                seen.update(terms if among is None else terms & among)
            if len(seen) > HELD_TERMS:
                yield given()
                seen.clear()
        yield given()

    picked = sample.where(F.col("toxic") == label).select("text")
    return picked.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def log_odds(positive: float, negative: float, n_positive: int, n_negative: int) -> float:
    return math.log((positive + 0.5) / (n_positive + 1)) - math.log((negative + 0.5) / (n_negative + 1))


def least_positive(n_positive: int) -> float:
    return max(MIN_POSITIVE, MIN_POSITIVE_SHARE * n_positive)


def choose_terms(positive: dict[str, int], negative: dict[str, int], n_positive: int, n_negative: int) -> list[tuple[str, float]]:
    """Terms far likelier in toxic documents, with their log odds, those that explain most documents first.

    A word is chosen on its own odds, a stem on its own and those of ``MIN_FORMS`` of
    its words. What a chosen stem covers goes, be it a word or a shorter or longer stem.
    """
    least = least_positive(n_positive)
    odds = {t: log_odds(n, negative.get(t, 0), n_positive, n_negative) for t, n in positive.items() if n >= least}
    words = {t for t, o in odds.items() if not t.endswith("*") and o >= MIN_LOG_ODDS}
    forms = Counter(w[:n] + "*" for w in words for n in STEMS if len(w) > n)
    worth = lambda t: (-positive[t] * odds[t], t)
    stems: list[str] = []
    for stem in sorted((t for t, n in forms.items() if n >= MIN_FORMS and odds.get(t, 0.0) >= STEM_LOG_ODDS), key=worth):
        if not any(stem.startswith(s[:-1]) or s.startswith(stem[:-1]) for s in stems):
            stems.append(stem)
    covered = set(stems)
    words = {w for w in words if not any(w[:n] + "*" in covered for n in STEMS)}
    return [(t, odds[t]) for t in sorted(words | covered, key=worth)]


def near_words(sample: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """(word, term, pos, neg): documents of the sample by word near a term, though not the term, and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker(__name__)
        lexicon, seen = _lexicon(terms), (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(as_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                found = ((w, lexicon[w]) for w in set(words_of(text)))
                seen[toxic].update((w, terms[h[1]]) for w, h in found if h and h[0])
        keys = sorted(seen[0].keys() | seen[1].keys())
        columns = [pa.array([k[i] for k in keys], pa.string()) for i in (0, 1)] + [pa.array([seen[y][k] for k in keys], pa.int64()) for y in (1, 0)]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "term", "pos", "neg"])

    counted = sample.select("text", (F.col("toxic") > 0).cast("int").alias("toxic")).mapInArrow(run, "word string, term string, pos long, neg long")
    return counted.groupBy("word", "term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def judge_near(near: DataFrame, exact: dict[str, int], n_positive: int, n_negative: int) -> tuple[frozenset[str], frozenset[str]]:
    """(terms to be met exactly, words that are no near hits).

    Each word counts for itself where benign documents share it, and so is bounded in
    number by their length; the rest is judged by term.
    """
    least = max(MIN_BENIGN, MIN_BENIGN_SHARE * n_negative)
    odds = F.log((F.col("pos") + 0.5) / (n_positive + 1)) - F.log((F.col("neg") + 0.5) / (n_negative + 1))
    benign = (F.col("neg") >= least) & (odds < MIN_LOG_ODDS)
    excused = frozenset(r["word"] for r in near.where(benign).select("word").distinct().collect())
    rest = near.where(~benign).groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()  # at most a row a term
    strict = (r["term"] for r in rest if log_odds(r["pos"] + MISSPELT_SHARE * exact.get(r["term"], 0), r["neg"], n_positive, n_negative) < STEM_LOG_ODDS)
    return frozenset(strict), excused


def newton_sums(z: np.ndarray, y: np.ndarray, n: np.ndarray | float, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the loss, summed over rows that stand for ``n`` each."""
    p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
    return z.T @ (n * (p - y)), (z * (n * (p * (1 - p) + 1e-9))[:, None]).T @ z


def solve_logistic(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], mean: np.ndarray, spread: np.ndarray, signs: Sequence[int], penalty: float) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method on scaled columns, given for the raw columns.

    A weight whose sign is not the allowed one is held at zero and the rest fitted
    again, until all agree.
    """
    ridge = np.diag([penalty] * len(mean) + [1e-6])
    free = np.ones(len(mean) + 1, bool)
    while True:
        w = np.zeros(len(mean) + 1)
        both = np.ix_(free, free)
        for _ in range(50):
            slope, curve = sums(w)
            step = np.linalg.solve(curve[both] + ridge[both], slope[free] + ridge[both] @ w[free])
            w[free] -= step
            if np.abs(step).max() < 1e-10:
                break
        wrong = np.append(w[:-1] * np.asarray(signs) < 0, False)
        if not wrong.any():
            break
        free &= ~wrong
    weights = w[:-1] / spread
    return weights, float(w[-1] - weights @ mean)


def scaled(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.column_stack([(x - mean) / spread, np.ones(len(x))])


def fit_logistic(x: np.ndarray, y: np.ndarray, signs: Sequence[int] = tuple(SIGNS.values()), penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias from rows that the driver holds."""
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread == 0] = 1
    z = scaled(x, mean, spread)
    return solve_logistic(lambda w: newton_sums(z, y, 1.0, w), mean, spread, signs, penalty)


def _summed(rows: DataFrame, fn: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of fn(x, toxic, n) over the rows (x, toxic, n); each task sends one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_worker(__name__)
        parts = [fn(b.column(0).flatten().to_numpy().reshape(b.num_rows, -1), b.column(1).to_numpy().astype(float), b.column(2).to_numpy().astype(float)) for b in batches if b.num_rows]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([np.sum(parts, axis=0).tolist()], pa.list_(pa.float64()))], names=["sums"])

    return np.sum([r["sums"] for r in rows.mapInArrow(run, "sums array<double>").collect()], axis=0)


def fit_rows(rows: DataFrame, signs: Sequence[int] = tuple(SIGNS.values()), penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """``fit_logistic`` of the rows (x, toxic, n), wherever they are: a pass over them for each step."""
    total, *first = _summed(rows, lambda x, y, n: np.append(n.sum(), n @ x))
    mean = np.array(first) / total
    spread = np.sqrt(_summed(rows, lambda x, y, n: n @ (x - mean) ** 2) / total)
    spread[spread == 0] = 1
    width = len(mean) + 1

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = _summed(rows, lambda x, y, n: np.concatenate([part.ravel() for part in newton_sums(scaled(x, mean, spread), y, n, w)]))
        return both[:width], both[width:].reshape(width, width)

    return solve_logistic(sums, mean, spread, signs, penalty)


@dataclass
class Model:
    terms: tuple[str, ...] = ()
    odds: tuple[float, ...] = ()
    exact: frozenset[str] = frozenset()
    excused: frozenset[str] = frozenset()
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(SIGNS)))
    bias: float = 0.0
    share: float | None = None  # the score of every text where nothing could be learned

    def features(self, texts: list[str]) -> np.ndarray:
        lexicon, is_stem = _lexicon(self.terms, self.exact, self.excused), tuple(t.endswith("*") for t in self.terms)
        return np.array([features(t, lexicon, self.odds, is_stem) for t in texts], float).reshape(-1, len(SIGNS))

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.share is not None:
            return np.full(len(texts), self.share)
        return 1 / (1 + np.exp(-np.clip((self.features(texts) * self.weights).sum(axis=1) + self.bias, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, train_rows: int | None = None, broadcast: int = LABEL_BROADCAST, on_driver: int = FIT_ON_DRIVER) -> Model:
    """A model of all labelled documents that are not held out; exact copies count once.

    Only if ``train_rows`` is given, at most so many labelled ids are used, drawn by a hash. Up to ``broadcast`` ids are
    sent to all executors; beyond, texts go through a shuffle to meet their labels.
    """
    bounded_batches(docs.sparkSession)
    marks = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("__id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("__id")))
    picked = marks.groupBy("__id").agg(F.max("toxic").alias("toxic"))
    total = picked.count()
    if train_rows is not None and train_rows < total:
        picked, total = hash_sample(picked, ["__id"], train_rows, total), train_rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(~held_out(F.col("doc_id")))
    told = texts.join(F.broadcast(picked) if total <= broadcast else picked, F.col("doc_id") == F.col("__id"))
    sample = scratch.save(told.select("text", "toxic").dropDuplicates(), "train")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_positive, n_negative = sizes.get(1, 0), sizes.get(0, 0)
    if not n_positive or not n_negative:
        return Model(share=n_positive / max(1, n_positive + n_negative))
    common = _counted(sample, 1, None).where(F.col("n") >= least_positive(n_positive))  # see the module's docstring for how many at most
    positive = {r["term"]: r["n"] for r in common.collect()}
    negative = {r["term"]: r["n"] for r in _counted(sample, 0, frozenset(positive)).collect()}
    terms = choose_terms(positive, negative, n_positive, n_negative)
    names, odds = tuple(t for t, _ in terms), tuple(o for _, o in terms)
    exact, excused = judge_near(scratch.save(near_words(sample, names), "near"), positive, n_positive, n_negative)
    model = Model(names, odds, exact, excused)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(model.features(as_texts(batch.column(0))).tolist(), pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    measured = arrow_map(sample, measure, "x array<double>, toxic int")
    if n_positive + n_negative > on_driver:
        model.weights, model.bias = fit_rows(scratch.save(measured.groupBy("x", "toxic").agg(F.count("*").alias("n")), "measured"))
        return model
    got = measured.collect()
    x, y = np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], float)
    order = np.lexsort([y, *x.T])
    model.weights, model.bias = fit_logistic(x[order], y[order])
    return model


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels, Scratch(docs.sparkSession))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = model.scores(as_texts(batch.column(2)))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
            names=["doc_id", "held_out", "score", "predicted"],
        )

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string"))
    return arrow_map(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    model, at = train(docs, labels, Scratch(docs.sparkSession)), docs.columns.index("text")
    return arrow_map(docs, lambda batch: batch.filter(pa.array(model.scores(as_texts(batch.column(at))) < 0.5)), docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
