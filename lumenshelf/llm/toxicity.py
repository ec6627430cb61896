"""Toxicity scores from a weighted finite-state grammar (operator 3).

``learn_lexicon`` counts words and word beginnings in labelled texts and keeps those
that mark toxic ones; they and closed word classes (``CLASSES``) give each token a
role. A learned word that mostly leads to a target ("will burn you") is a threat verb,
others are insults; words of closed classes keep their role and have no weight of their
own. Five transducers over roles are composed into one machine that reads a text once:

    insult      target, copula, determiners and a few other words, insult: "you are such
                a fool"; an insult that no target leads to is a phrase by itself and
                weighs less
    threat      intent, threat verb, a few other words, target: "will hurt you"; the
                match is written at the target, a verb without one weighs little
    negation    matches after a negation are negated and weigh less
    reported    so do those after a verb of saying, up to the end of the clause, or
                between quote marks after it, up to the closing mark or the paragraph
    target      matches in a clause that has named a target weigh more

A clause's score is the sum of its matches' weights, and a document's score a
logistic function of its clauses' scores.

Learning takes at most about ``FIT_ROWS`` labelled rows of the training folds, those of
the lowest hashes of their ids, so the lexicon has no other bound than that of what it
has read: an entry is kept for its log-likelihood ratio and weight alone. The logistic
step has seven parameters and reads at most ``LOGISTIC_ROWS`` of them; a row's own label
is taken out of the lexicon's counts when its features are computed for the fit.

Edge cases: null and empty texts match nothing and get the score of a text without
matches; very long texts are read whole; repeated rows are scored alike; a document
labelled twice counts as toxic if one label says so; with no toxic or no clean label
at all every score is the share of toxic labels (0 if there are none). Null ids are
never in a training fold. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, tune

#: Labelled rows that the lexicon and that the logistic step are fitted on, at most (about).
FIT_ROWS, LOGISTIC_ROWS = 200_000, 20_000
#: An entry's log-likelihood ratio statistic, at least, and its weight (log ratio of document shares).
LEAST_G2, LEAST_WEIGHT = 22.0, 1.5
STEMS = (4, 5, 6, 7)
#: A learned entry is a threat verb if it leads to a target so often in toxic texts, in this share of its occurrences.
VERB_SEEN, VERB_SHARE = 5, 0.5
#: Terms that a task counts before it hands them on.
FLUSH_TERMS = 300_000

#: Closed word classes by role; a caller may give others.
CLASSES = {
    "t": "kill hurt destroy stab shoot beat murder bomb hunt töten umbringen erschießen tuer détruire matar golpear",
    "y": "you your yourself he she they them him her people everyone du dich dir ihr euch tu te toi vous tú usted ustedes",
    "c": "am is are was were be you're he's she's they're bist ist sind seid war es est êtes sont eres sois son",
    "d": "a an the such so very just really ein eine so sehr un une si très una tan muy",
    "v": "will shall going gonna want must should werde will soll vais veux dois voy quiero debo",
    "n": "not no never neither nor without isn't aren't nicht kein keine nie ne pas jamais sans ni nunca sin",
    "r": "said says told wrote quoted called reported claimed sagte sagt schrieb nannte dit écrit appelle dijo dice escribió llamó",
}
_TOKEN = re.compile(r"\w+(?:'\w+)?|[.!?;\n\"“”«»]")
_SIGNS = dict.fromkeys(".!?;", "e") | {"\n": "p"} | dict.fromkeys("\"“”«»", "q")


def roles_of(classes: dict[str, str]) -> dict[str, str]:
    """token -> role, for signs and closed classes; a word of several classes has the first of them."""
    out = dict(_SIGNS)
    for role, listed in classes.items():
        for word in listed.split():
            out.setdefault(word, role)
    return out


# ---- transducers -----------------------------------------------------------------


@dataclass(frozen=True)
class Transducer:
    """Deterministic weighted transducer: (state, symbol) -> (state, symbol, weight). An absent arc keeps the state and copies the symbol at weight 1."""

    arcs: dict = field(default_factory=dict)
    start: object = 0
    symbols: str = ""

    def step(self, state, symbol: str):
        return self.arcs.get((state, symbol), (state, symbol, 1.0))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """What ``a`` writes is read by ``b``; weights multiply. Only states that can be reached are made."""
    start = (a.start, b.start)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        s, t = todo.pop()
        for x in a.symbols:
            s2, y, w = a.step(s, x)
            t2, z, v = b.step(t, y)
            arcs[(s, t), x] = ((s2, t2), z, w * v)
            if (s2, t2) not in seen:
                seen.add((s2, t2))
                todo.append((s2, t2))
    return Transducer(arcs, start, a.symbols)


# roles of tokens: i insult, t threat verb, y target, c copula, d determiner, v intent, n negation, r report,
# q quote mark, w other, e end of clause, p end of paragraph
ROLES = "itycdvnrqwep"
# matches: i bare insult, a addressed insult, t threat verb, k target that completes a threat; in capitals if negated
MATCHES = "iatk"
WRITTEN = ROLES + "ak" + MATCHES.upper()


def insult(alone: float = 0.5, gap: int = 2) -> Transducer:
    """States: 0, or how many other words may still stand between target and insult, plus 1."""
    arcs = {}
    for s in range(gap + 2):
        arcs[s, "y"] = (gap + 1, "y", 1.0)
        arcs[s, "e"], arcs[s, "p"] = (0, "e", 1.0), (0, "p", 1.0)
        arcs[s, "i"] = (s, "a", 1.0) if s else (0, "i", alone)
        arcs[s, "w"] = (max(0, s - 1), "w", 1.0)
    return Transducer(arcs, 0, ROLES)


def threat(alone: float = 0.25, intent: float = 1.25, scope: int = 4, gap: int = 2) -> Transducer:
    """States: (tokens for which intent holds, words that may stand before the verb's object plus 1, was there intent)."""
    arcs = {}
    for meant in range(scope + 1):
        for open_ in range(gap + 2):
            for strong in (False, True):
                now = (meant, open_, strong)
                less = max(0, meant - 1)
                for x in ROLES + "a":
                    arcs[now, x] = ((less, max(0, open_ - 1), strong and open_ > 1), x, 1.0)
                for x in "cdr":
                    arcs[now, x] = ((less, open_, strong), x, 1.0)
                arcs[now, "v"] = ((scope, open_, strong), "v", 1.0)
                arcs[now, "t"] = ((less, gap + 1, meant > 0), "t", alone)
                if open_:
                    arcs[now, "y"] = ((less, 0, False), "k", intent if strong else 1.0)
                for x in "ep":
                    arcs[now, x] = ((0, 0, False), x, 1.0)
    return Transducer(arcs, (0, 0, False), ROLES + "a")


def negation(scope: int = 4, weight: float = 0.35) -> Transducer:
    """For ``scope`` tokens after a negation, matches are written in capitals."""
    arcs = {}
    for s in range(scope + 1):
        arcs[s, "n"], arcs[s, "e"], arcs[s, "p"] = (scope, "n", 1.0), (0, "e", 1.0), (0, "p", 1.0)
        for x in "itycdvrqwak":
            negated = s > 0 and x in MATCHES
            arcs[s, x] = (max(0, s - 1), x.upper() if negated else x, weight if negated else 1.0)
    return Transducer(arcs, 0, ROLES + "ak")


def reported(weight: float = 0.5) -> Transducer:
    """States: 1 after a verb of saying, 2 between quote marks after it; a quote that isn't closed ends with the paragraph."""
    arcs = {(0, "r"): (1, "r", 1.0), (1, "e"): (0, "e", 1.0), (1, "q"): (2, "q", 1.0), (2, "q"): (0, "q", 1.0)}
    arcs |= {(s, "p"): (0, "p", 1.0) for s in (1, 2)}
    arcs |= {(s, x): (s, x, weight) for s in (1, 2) for x in MATCHES + MATCHES.upper()}
    return Transducer(arcs, 0, WRITTEN)


def target(addressed: float = 1.25) -> Transducer:
    """State 1 from a target to the end of the clause."""
    arcs = {(0, x): (1, x, 1.0) for x in "ykK"}
    arcs |= {(1, x): (0, x, 1.0) for x in "ep"}
    arcs |= {(1, x): (1, x, addressed) for x in MATCHES + MATCHES.upper()}
    return Transducer(arcs, 0, WRITTEN)


PARTS = (insult(), threat(), negation(), reported(), target())
GRAMMAR = reduce(compose, PARTS)


# ---- lexicon ---------------------------------------------------------------------


def terms_of(text: str) -> set[str]:
    """Words, and beginnings of longer words with a star."""
    words = {w for w in _TOKEN.findall(text.lower()) if len(w) > 2}
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        terms = list(held[1].keys() | held[0].keys())
        done = pa.RecordBatch.from_arrays(
            [
                pa.array(terms, pa.string()),
                pa.array([held[1][t] for t in terms], pa.int64()),
                pa.array([held[0][t] for t in terms], pa.int64()),
            ],
            names=["term", "toxic", "clean"],
        )
        held[0].clear()
        held[1].clear()
        return done

    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held[y].update(terms_of(text or ""))
            if len(held[0]) + len(held[1]) > FLUSH_TERMS:
                yield out()
    yield out()


def log_ratio(toxic: float, clean: float, n1: float, n0: float) -> float:
    return math.log((toxic + 0.5) / (n1 + 1)) - math.log((clean + 0.5) / (n0 + 1))


def _g2(n1: int, n0: int) -> Column:
    """Twice the log-likelihood ratio of a term's split against the split of all labels."""
    a, b = F.col("toxic"), F.col("clean")
    part = lambda x, share: F.when(x > 0, x * F.log(x / ((a + b) * F.lit(share)))).otherwise(0.0)
    return 2 * (part(a, n1 / (n1 + n0)) + part(b, n0 / (n1 + n0)))


def most_specific(entries: dict[str, tuple[int, int]]) -> dict[str, tuple[int, int]]:
    """Without word beginnings of which one longer entry holds nine tenths of the toxic texts."""
    best: dict[str, int] = {}
    for term, (toxic, _) in entries.items():
        stem = term.rstrip("*")
        for k in STEMS:
            if k < len(stem) or (k == len(stem) and not term.endswith("*")):
                best[stem[:k] + "*"] = max(best.get(stem[:k] + "*", 0), toxic)
    return {t: c for t, c in entries.items() if not t.endswith("*") or best.get(t, 0) < 0.9 * c[0]}


@dataclass
class Lexicon:
    """Entries with the numbers of toxic and clean training texts that hold them, of n1 and n0."""

    entries: dict[str, tuple[int, int]]
    n1: int
    n0: int
    roles: dict[str, str] = field(default_factory=lambda: roles_of(CLASSES))
    #: entries that are threat verbs
    verbs: frozenset[str] = frozenset()

    def weights(self, own: int | None = None) -> _Weights:
        return _Weights(self, own)


class _Weights(dict):
    """word -> weight, 0.0 for most. ``own``: the label of the text being read, which is taken out of the counts.

    ``roles`` has the closed classes and the learned threat verbs among the words that were asked for.
    """

    def __init__(self, lexicon: Lexicon, own: int | None):
        super().__init__()
        self.lexicon, self.own, self.roles = lexicon, own, dict(lexicon.roles)

    def best(self, word: str) -> tuple[float, str]:
        """Weight and entry of a word; without an entry 0 and an empty text."""
        x, y, out = self.lexicon, self.own, (0.0, "")
        for term in (word, *(word[:k] + "*" for k in STEMS if len(word) > k)):
            if got := x.entries.get(term):
                w = log_ratio(got[0] - (y == 1), got[1] - (y == 0), x.n1 - (y == 1), x.n0 - (y == 0))
                if w >= LEAST_WEIGHT and w > out[0]:
                    out = (w, term)
        return out

    def __missing__(self, word: str) -> float:
        if len(self) > 500_000:
            self.clear()
        closed = self.lexicon.roles.get(word, "t")
        out, term = self.best(word) if closed == "t" else (0.0, "")
        if word in self.lexicon.roles and closed == "t":
            out = out or LEAST_WEIGHT
        elif term in self.lexicon.verbs:
            self.roles[word] = "t"
        self[word] = out
        return out


def contexts(tokens: list[str], weights: list[float], roles: dict[str, str], gap: int = 2) -> Iterator[tuple[int, bool, bool]]:
    """For each weighted token: its place, does it lead to a target, does a copula lead to it; both within the clause, with at most ``gap`` other words (and ten tokens) between."""
    after = 0
    for i, (token, weight) in enumerate(zip(tokens, weights, strict=True)):
        role = roles.get(token, "w")
        if weight:
            left, leads = gap, False
            for other in tokens[i + 1 : i + 12]:
                x = roles.get(other, "w")
                left -= x not in "ycdr"
                if x in "ep" or left < 0 or x == "y":
                    leads = x == "y"
                    break
            yield i, leads, after > 0
        after = gap + 1 if role == "c" else 0 if role in "ep" else max(0, after - (role == "w"))


def _count_contexts(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, seen = lexicon.weights(), {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                tokens = _TOKEN.findall((text or "").lower())
                for i, leads, led in contexts(tokens, [weights[t] for t in tokens], lexicon.roles):
                    if term := weights.best(tokens[i])[1]:
                        x = seen.setdefault(term, [0, 0, 0])
                        x[0] += 1
                        x[1] += leads
                        x[2] += led
        columns = [pa.array(list(seen), pa.string()), *(pa.array([x[k] for x in seen.values()], pa.int64()) for k in range(3))]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "n", "leads", "led"])

    return run


def learn_verbs(labelled: DataFrame, lexicon: Lexicon) -> frozenset[str]:
    """The entries that are threat verbs, from their places in toxic texts; at most one row per entry is collected."""
    told = labelled.filter("toxic = 1").select("text").mapInArrow(_count_contexts(lexicon), "term string, n long, leads long, led long")
    told = told.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("n", "leads", "led")))
    verbs = told.filter((F.col("leads") >= VERB_SEEN) & (F.col("leads") >= VERB_SHARE * F.col("n")) & (F.col("leads") > F.col("led")))
    return frozenset(r["term"] for r in verbs.collect())


def learn_lexicon(labelled: DataFrame, classes: dict[str, str] = CLASSES) -> Lexicon:
    """From rows (text, toxic 0/1), all of them."""
    n1, n0 = labelled.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    if not n1 or not n0:
        return Lexicon({}, n1, n0, roles_of(classes))
    counts = labelled.select("text", "toxic").mapInArrow(_count_terms, "term string, toxic long, clean long")
    counts = counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    told = counts.filter(F.col("toxic") * n0 > 4 * F.col("clean") * n1).filter(_g2(n1, n0) >= LEAST_G2).collect()
    out = Lexicon(most_specific({r["term"]: (r["toxic"], r["clean"]) for r in told}), n1, n0, roles_of(classes))
    out.verbs = learn_verbs(labelled, out)
    return out


# ---- scores ----------------------------------------------------------------------


def clause_scores(tokens: list[str], weights: list[float], roles: dict[str, str]) -> list[tuple[float, float]]:
    """(score, weight of negated matches) of each clause with a match."""
    out, state, score, lost, verb = [], GRAMMAR.start, 0.0, 0.0, 0.0
    for token, weight in zip(tokens, weights, strict=True):
        role = roles.get(token, "w")
        if weight and role == "w":
            role = "i"
        state, written, factor = GRAMMAR.step(state, role)
        if written in "kK":
            weight = verb  # the threat that this target completes
        elif role == "t":
            verb = weight
        if weight:
            score += weight * factor
            if written.isupper():
                lost += weight
        if role in "ep" and score:
            out.append((score, lost))
            score = lost = 0.0
    if score:
        out.append((score, lost))
    return out


N_FEATURES = 6


def features(text: str, weights: _Weights) -> tuple[float, ...]:
    """Best clause, sum of clauses, number of matched clauses, sum for the length, weight negated; 1 if anything matched."""
    tokens = _TOKEN.findall(text.lower())
    found = list(map(weights.__getitem__, tokens))
    if not any(found):
        return (0.0,) * N_FEATURES
    clauses = clause_scores(tokens, found, weights.roles)
    total = sum(s for s, _ in clauses)
    return max(s for s, _ in clauses), math.log1p(total), math.log1p(len(clauses)), total / math.sqrt(len(tokens) + 10), math.log1p(sum(x for _, x in clauses)), 1.0


def _features_of_labelled(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_label = {y: lexicon.weights(y) for y in (0, 1)}
        for batch in batches:
            ys = batch.column(1).to_pylist()
            rows = [features(t or "", by_label[y]) for t, y in zip(batch.column(0).to_pylist(), ys, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array([list(r) for r in rows], pa.list_(pa.float64()))], names=["toxic", "features"])

    return run


@dataclass
class Model:
    lexicon: Lexicon
    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray
    #: None, or the score of every text where there was nothing to learn from
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = self.coef[0] + ((x - self.mean) / self.scale) @ self.coef[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, scale = x.mean(0), x.std(0) + 1e-9
    scale[scale < 1e-6] = 1.0
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    coef, penalty = np.zeros(z.shape[1]), np.diag([1e-6] + [ridge] * (z.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ coef, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ coef)
        coef += step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, coef


def _lowest(rows: DataFrame, share: float) -> DataFrame:
    """About that share of the rows, those of the lowest hashes of their doc_id."""
    return rows.filter(F.xxhash64("doc_id") <= F.lit(int(-(2**63) + share * (2**64 - 1)))) if share < 1 else rows


def fit(labelled: DataFrame, logistic_rows: int = LOGISTIC_ROWS, classes: dict[str, str] = CLASSES) -> Model:
    """From rows (doc_id, text, toxic 0/1)."""
    tune(labelled.sparkSession)
    lexicon = learn_lexicon(labelled, classes)
    n1, n0 = lexicon.n1, lexicon.n0
    none = np.zeros(N_FEATURES)
    if not n1 or not n0:
        return Model(lexicon, none, none, none, n1 / (n1 + n0) if n1 + n0 else 0.0)
    # the limit only bounds the excess of the hashes' share
    low = _lowest(labelled, logistic_rows / (n1 + n0)).select("text", "toxic")
    got = low.mapInArrow(_features_of_labelled(lexicon), "toxic int, features array<double>").limit(2 * logistic_rows).toPandas()
    x, y = np.array(got["features"].tolist(), float).reshape(-1, N_FEATURES), got["toxic"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return Model(lexicon, none, none, none, n1 / (n1 + n0))
    return Model(lexicon, *fit_logistic(x, y))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.lexicon.weights()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            x = np.array([features(t or "", weights) for t in texts], float).reshape(-1, N_FEATURES)
            keep = [i for i, n in enumerate(batch.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(model.score(x))], names=[*(batch.schema.names[i] for i in keep), "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, score) per document."""
    tune(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_score(model), "doc_id long, score double")


def fold(doc_id: Column) -> Column:
    """0 for held-out documents."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def with_labels(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Labelled documents (doc_id, text, toxic) of the training folds, of about ``fit_rows`` labels at most.

    The labels are broadcast; the bound on their number is that of the fit.
    """
    usable = F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)
    one = labels.filter(usable).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    one = cut(one, "labels")
    few = cut(_lowest(one, fit_rows / max(1, one.count())), "fit-labels")
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")


def predictions(docs: DataFrame, labels: DataFrame, fit_on: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; learns from ``fit_on`` or ``docs``."""
    model = fit(with_labels(docs if fit_on is None else fit_on, labels))
    return score(docs, model).select(
        "doc_id",
        (fold(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _keep_clean(model: Model, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.lexicon.weights()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            x = np.array([features(t or "", weights) for t in texts], float).reshape(-1, N_FEATURES)
            yield batch.filter(pa.array(model.score(x) < 0.5))

    return run


def without_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted toxic."""
    model = fit(with_labels(docs, labels))
    return docs.mapInArrow(_keep_clean(model, text_col), docs.schema)
