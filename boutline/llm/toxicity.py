"""Toxicity by a weighted finite-state pattern grammar.

Five transducers form a cascade over the symbols of one clause.  Negation relabels the evidence in its scope, target relabels the evidence within reach
after a target, insult and threat accept patterns and emit a path for each piece of evidence, and reported speech decides at the clause's end whether the
whole clause is somebody else's.  `compose` makes one transducer of the cascade, over the product states that can be reached.

Paths: evidence is `aimed` (a target within reach, before or after it; for a threat also an insult as its object), `piled` (an insult within reach of
another) or `lone`, and each is plain, negated or reported.  A document's score is logistic in the weights that its clauses sent along each path; the
paths' weights are learned, so a lone word counts for what the labelled documents show it to be worth.  The lexicon is learned too: words and word
beginnings (stems) by their log odds over labelled documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.llm.arrows import sliced, texts_of
from boutline.llm.samples import labelled_sample
from boutline.llm.scratch import Scratch

# The grammar's own words, in the four languages of the corpus.
TARGETS = "you your youre u he she they them him her people du dich dir ihr sie er euch tu toi vous il elle ils tú usted ustedes él ella ellos".split()
NEGATIONS = "not no never isn aren wasn don doesn didn nobody none without nicht kein keine keinen nie niemals ohne ne pas jamais aucun sans ningún nunca jamás sin".split()
REPORTS = "said says say told tells called calls wrote writes claimed quoted alleged reportedly sagte sagt schrieb behauptet nannte dit disait écrit appelé selon dijo dice llamó escribió según".split()
INSULTS = "idiot moron stupid dumb loser scum trash garbage worthless pathetic disgusting clown fool imbecile dummkopf trottel arschloch abschaum crétin connard imbécile estúpido idiota basura".split()
THREATS = "kill hurt destroy die beat burn shoot stab umbringen töten sterben verletzen tuer mourir frapper matar morir golpear".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
NEGATED, AIMED = 8, 16  # marks put on an evidence symbol on its way down the cascade
REACH = 5  # tokens over which a target or another insult is in reach
SCOPE = 3  # tokens after a negation that it still reaches
KINDS = ("aimed insult", "piled insult", "lone insult", "aimed threat", "lone threat")
PATHS = tuple(f"{m}{k}" for m in ("", "negated ", "reported ") for k in KINDS)
FEATURES = len(PATHS) + 2
CLAUSE = re.compile(r"[^.!?;:\n]+")
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = range(4, 9)

#: step(state, symbol) -> (state, symbol passed on, events); an event is (held or new evidence, kind of path, negated).
Step = Callable[[tuple, int], tuple[tuple, int, tuple]]


def negation(state: tuple, symbol: int) -> tuple[tuple, int, tuple]:
    (left,) = state or (0,)
    if symbol == NEGATION:
        return (SCOPE,), symbol, ()
    marked = symbol | NEGATED if left and symbol in (INSULT, THREAT) else symbol
    return (max(0, left - 1),), marked, ()


def target(state: tuple, symbol: int) -> tuple[tuple, int, tuple]:
    (left,) = state or (0,)
    if symbol == TARGET:
        return (REACH,), symbol, ()
    marked = symbol | AIMED if left and symbol & 7 in (INSULT, THREAT) else symbol
    return (max(0, left - 1),), marked, ()


def evidence(own: int, aims: tuple[int, ...], aimed: str, lone: str, piled: str | None) -> Step:
    """Accepts evidence `own`: aimed at once or by a later aim, piled on evidence of its kind, or lone once it is out of reach.
    States: (), (tokens left, negated) for held evidence, (tokens left,) after evidence that has been emitted."""

    def step(state: tuple, symbol: int) -> tuple[tuple, int, tuple]:
        held = len(state) == 2
        if symbol & 7 == own:
            negated = bool(symbol & NEGATED)
            before = (("held", piled or lone, state[1]),) if held else ()
            if symbol & AIMED:
                return (REACH,), symbol, (*before, ("new", aimed, negated))
            if state and piled:
                return (REACH,), symbol, (*before, ("new", piled, negated))
            return (REACH, negated), symbol, before
        if held and symbol & 7 in aims:
            return (REACH,), symbol, (("held", aimed, state[1]),)
        if state and (symbol == END or state[0] == 1):
            return (), symbol, (("held", lone, state[1]),) if held else ()
        return (state[0] - 1, *state[1:]) if state else (), symbol, ()

    return step


def report(state: tuple, symbol: int) -> tuple[tuple, int, tuple]:
    told = bool(state) or symbol == REPORT
    return ((), symbol, (("clause", "reported", told),)) if symbol == END else ((1,) if told else (), symbol, ())


def cascade() -> list[Step]:
    insult = evidence(INSULT, (TARGET,), "aimed insult", "lone insult", "piled insult")
    threat = evidence(THREAT, (TARGET, INSULT), "aimed threat", "lone threat", None)
    return [negation, target, insult, threat, report]


def step_all(steps: list[Step], states: tuple, symbol: int) -> tuple[tuple, tuple]:
    """One symbol through the cascade: the new states, and the events with the machine that made them."""
    after, events = [], []
    for n, (step, q) in enumerate(zip(steps, states)):
        q, symbol, made = step(q, symbol)
        after.append(q)
        events += [(n, *e) for e in made]
    return tuple(after), tuple(events)


def compose(steps: list[Step]) -> list[list[tuple[int, tuple]]]:
    """The composed transducer: table[state][symbol] = (state, events), over the states that can be reached from state 0."""
    start = ((),) * len(steps)
    index, table, queue = {start: 0}, [], [start]
    for states in queue:
        row = []
        for s in range(7):
            after, events = step_all(steps, states, s)
            if s == END:
                after = start
            if after not in index:
                index[after] = len(index)
                queue.append(after)
            row.append((index[after], events))
        table.append(row)
    return table


class Lexicon(dict):
    """word -> (symbol, weight), by the word itself or its longest known beginning; fills itself, within a bound."""

    BOUND = 100_000

    def __init__(self, words: dict[str, float], beginnings: dict[str, float]):
        super().__init__()
        self.words, self.beginnings = words, beginnings
        self.fixed = {w: (k, 1.0) for k, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}
        self.fixed |= {w: (INSULT, 2.0) for w in INSULTS}

    def __missing__(self, word: str) -> tuple[int, float] | None:
        got = self.fixed.get(word)
        if word in self.words and (got is None or got[0] in (INSULT, THREAT)):
            got = (got[0] if got else INSULT, self.words[word])
        if got is None:
            n = next((n for n in reversed(PREFIXES) if word[:n] in self.beginnings and len(word) > n), 0)
            got = (INSULT, self.beginnings[word[:n]]) if n else None
        if len(self) >= self.BOUND:
            self.clear()
        self[word] = got
        return got


def clause_paths(symbols: list[tuple[int, float] | None], table) -> dict[str, float]:
    """The weight that one clause sends along each path.  symbols: (symbol, weight) for each token, None for other words."""
    state, held, found, told = 0, {}, [], False
    for got in (*symbols, (END, 0.0)):
        symbol, weight = got or (OTHER, 0.0)
        state, events = table[state][symbol]
        for machine, which, kind, mark in events:
            if which == "clause":
                told = mark
            else:
                found.append((kind, mark, held.get(machine, 0.0) if which == "held" else weight))
        if symbol in (INSULT, THREAT):
            held[2 if symbol == INSULT else 3] = weight
    out: dict[str, float] = {}
    for kind, negated, weight in found:
        path = ("reported " if told else "negated " if negated else "") + kind
        out[path] = out.get(path, 0.0) + weight
    return out


def document_paths(text: str, lexicon: Lexicon, table) -> tuple[dict[str, float], int, int, float]:
    """A whole text's weights by path, the number of its words, of its clauses with evidence, and the highest clause's weight."""
    paths: dict[str, float] = {}
    words = clauses = 0
    top = 0.0
    for m in CLAUSE.finditer(text):
        tokens = WORD.findall(m[0].lower())
        words += len(tokens)
        symbols = [lexicon[t] for t in tokens]
        if any(s is not None and s[0] in (INSULT, THREAT) for s in symbols):
            got = clause_paths(symbols, table)
            for path, weight in got.items():
                paths[path] = paths.get(path, 0.0) + weight
            clauses += 1
            top = max(top, sum(got.values()))
    return paths, words, clauses, top


def features(paths: dict[str, float], words: int, clauses: int) -> list[float]:
    total = sum(paths.values())
    return [*(math.log1p(paths.get(p, 0.0)) for p in PATHS), math.log1p(1000 * total / (words + 50)), math.log1p(clauses)]


class Model:
    """Lexicon and weights (intercept first)."""

    def __init__(self, words: dict[str, float], beginnings: dict[str, float], weights: list[float] | None):
        self.words, self.beginnings, self.weights = words, beginnings, weights

    def reader(self) -> Callable[[list[str]], tuple[np.ndarray, list[int], list[float]]]:
        """A function from texts to features, evidence clauses and top clause weights; it keeps its lexicon's memo."""
        lexicon, table = Lexicon(self.words, self.beginnings), compose(cascade())

        def read(texts: list[str]):
            got = [document_paths(t, lexicon, table) for t in texts]
            return np.array([features(p, n, k) for p, n, k, _ in got]).reshape(-1, FEATURES), [k for _, _, k, _ in got], [t for *_, t in got]

        return read

    def scores(self, x: np.ndarray) -> np.ndarray:
        w = np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))


def default_model() -> Model:
    """The grammar's own words with fixed weights, for corpora without labels of both kinds."""
    by_path = {"aimed insult": 1.5, "piled insult": 1.0, "lone insult": 0.3, "aimed threat": 1.5, "lone threat": 0.2}
    return Model({}, {}, [-2.0, *(by_path.get(p, 0.0) for p in PATHS), 0.0, 0.0])


TERM = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])


def _terms(batches):
    """(term, toxic, clean): in how many documents of each label a word or a word beginning (`term*`) stands, in parts of bounded size."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def counted() -> pa.RecordBatch:
        terms = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())], schema=TERM)

    for batch in sliced(batches, "text"):
        for text, y in zip(texts_of(batch, "text"), batch.column("y").to_pylist()):
            words = set(WORD.findall(text.lower()))
            counts[y].update(words)
            counts[y].update({w[:n] + "*" for w in words for n in PREFIXES if len(w) > n})
            if len(counts[0]) + len(counts[1]) > 100_000:
                yield counted()
                counts = (Counter(), Counter())
    yield counted()


def choose_terms(terms: list[tuple[str, int, int]], toxic_docs: int, clean_docs: int, *, least_odds: float, least_evidence: float) -> tuple[dict[str, float], dict[str, float]]:
    """Words and beginnings with their smoothed log odds, from (term, toxic, clean).  A term needs `least_odds` and a log-likelihood ratio of `least_evidence`.
    A beginning is kept over a longer one, and over words, that say no more than it does; one that says less than they do, or stands in one word, goes."""
    known: dict[str, tuple[float, int]] = {}
    share = toxic_docs / (toxic_docs + clean_docs)
    for term, k, m in terms:
        odds = min(8.0, math.log((k + 0.5) / (toxic_docs - k + 0.5)) - math.log((m + 0.5) / (clean_docs - m + 0.5)))
        n = k + m
        ratio = 2 * (k * math.log(k / (n * share)) + (m * math.log(m / (n * (1 - share))) if m else 0.0)) if k else 0.0
        if odds >= least_odds and ratio >= least_evidence:
            known[term] = (odds, k)
    words, beginnings = {}, {}
    for term in sorted(known, key=lambda t: (len(t), t)):
        body, stem = term.rstrip("*"), term.endswith("*")
        odds, k = known[term]
        shorter = [known[body[:n] + "*"] for n in PREFIXES if n < len(body) and body[:n] in beginnings]
        if any(o >= odds - 0.7 for o, _ in shorter):
            continue
        if stem and any(t != term and t.startswith(body) and known[t][1] >= 0.95 * k for t in known if len(t) <= len(body) + 12):
            continue
        (beginnings if stem else words)[body] = odds
    return words, beginnings


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bound: int = 20_000, least_odds: float = 2.2, least_evidence: float = 15.0) -> Model:
    """Learn lexicon and path weights from labelled rows that aren't held out.  `bound`: at most so many labelled ids, those with the smallest hashes, are
    used, with one row each."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    known = labels.select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("y")).where("key IS NOT NULL AND y IN (0, 1)").groupBy("key").agg(F.max("y").alias("y")).where(~held_out("key", 5, 0))
    rows = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = scratch.table(labelled_sample(rows, known, bound), "sample")
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        scratch.drop(sample)
        return default_model()
    terms = sample.mapInArrow(_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (F.lit(n1) - F.col("toxic") + 0.5)) - F.log((F.col("clean") + 0.5) / (F.lit(n0) - F.col("clean") + 0.5))
    some = terms.where((F.col("toxic") >= 3) & (odds >= least_odds)).collect()  # terms of a bounded sample
    words, beginnings = choose_terms([tuple(r) for r in some], n1, n0, least_odds=least_odds, least_evidence=least_evidence)
    model = Model(words, beginnings, None)

    def featured(batches):
        read = model.reader()
        for batch in sliced(batches, "text"):
            x, _, _ = read(texts_of(batch, "text"))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("y")], names=["x", "y"])

    data = sample.mapInArrow(featured, "x array<double>, y int").collect()  # numbers of a bounded sample
    scratch.drop(sample)
    model.weights = logistic(np.array([r["x"] for r in data]), np.array([r["y"] for r in data], float))
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> list[float]:
    """Ridge logistic regression by Newton steps; intercept first."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def score_documents(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, clauses, top): per row the probability of label 1, the number of clauses with evidence and the highest clause's weight.
    Null and empty texts have no clause and get the model's base score."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        read = model.reader()
        for batch in sliced(batches, "text"):
            x, clauses, top = read(texts_of(batch, "text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x)), pa.array(clauses, pa.int32()), pa.array(top, pa.float64())], names=["id", "score", "clauses", "top"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, score double, clauses int, top double")


def without_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bound: int = 20_000, limit: float = 0.5) -> DataFrame:
    """The rows of `docs`, with all their columns, that score less than `limit`.  Null texts score as empty ones, the model's base rate; repeated rows, null ids and rows that share an id are
    each judged by their own text; an empty table gives no rows."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, bound=bound)

    def run(batches) -> Iterator[pa.RecordBatch]:
        read = model.reader()
        for batch in sliced(batches, text_col):
            x, _, _ = read(texts_of(batch, text_col))
            yield batch.filter(pa.array(model.scores(x) < limit))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col, folds: int, at: int):
    """Whether crc32 of the id as text leaves `at` modulo `folds`; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == at, F.lit(True))


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bound: int = 20_000) -> DataFrame:
    """Learn from the labelled rows that aren't held out and score every row of `docs`: id, score, clauses, top.

    Null texts count as empty.  Labels other than 0 and 1 are ignored; of repeated labels of one id the largest holds.  Repeated rows, and rows that share an
    id, each come back with the score of their own text.  Equal scores are not ordered.  Without both labels the grammar's own words with fixed weights
    are used.  Other columns are never read.  Texts are read clause by clause to their end; an empty table gives no rows."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, bound=bound)
    return score_documents(docs, model, id_col=id_col, text_col=text_col)
