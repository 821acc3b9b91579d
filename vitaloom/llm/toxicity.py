"""Toxicity by weak supervision.

Many voters look at a text: lexicon voters hold words that labelled texts suggest, pattern voters look for shouting,
grawlixes or second-person insults. A generative label model estimates from all documents how accurate the voters are:
with a hidden class ``y`` of share ``p``, the covariance of two independent voters is ``p (1 - p) d_i d_j``, where ``d``
is how much likelier a voter fires on toxic texts. Pairs whose covariance departs from that rank-one shape are
correlated: they are left out of the fit, and the posterior weighs by the inverse of what is left of the covariances. A linear classifier on words is
trained on labelled texts only, where the given label outweighs the clipped posterior, so the posterior smooths labels and
cannot overturn them. Its margin is calibrated on the same texts.

What is counted over the corpus are the firings of pairs of voters: a few hundred sums for each task, added up by a
partial aggregate. Lexicon and classifier are fitted on the bounded sample of ``labelled.sample``.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaloom.llm.common import map_rows, without
from vitaloom.llm.labelled import logistic, sample

LEXICON_VOTERS = 24
LEXICON_WORDS = 480
FEATURES = 1000
# Words longer than this also count by their first letters.
STEM = 4
# A word enters the lexicon when it is in so many toxic texts and so many times likelier there.
MIN_TEXTS = 3
MIN_LIFT = 3.0
# Two voters are correlated when their covariance misses the model's by more than this share of their deviations.
CORRELATED = 0.1
# How often a given label is taken to be right.
ANNOTATOR = 0.99

# Common English insults.
INSULTS = ("idiot", "stupid", "moron", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "dumb", "jerk", "imbecile",
           "filth", "vermin", "creep", "bastard", "fool")

WORD = re.compile(r"[^\W_]+")
GRAWLIX = re.compile(r"[#$%&*@]{3}")
YOU = re.compile(r"\byou(?:r|'re| are)? (?:an? |such an? |so |all )?([^\W_]+)")
PATTERNS = ("shouting", "exclaiming", "grawlix", "second person", "insult list", "no lexicon word")


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float
    prior: float


def words(text: str | None) -> set[str]:
    """Distinct words of a whole text, and how the longer ones begin."""
    found = set(WORD.findall(text.lower())) if text else set()
    return found | {w[:STEM] + "*" for w in found if len(w) > STEM}


def deal(lexicon: list[str]) -> dict[str, int]:
    """Words to lexicon voters, by turns, so that every voter gets strong and weak words."""
    return {w: i % LEXICON_VOTERS for i, w in enumerate(lexicon)}


def fired(text: str | None, voter_of: dict[str, int]) -> list[int]:
    """Indices of the voters that fire on a text."""
    found = words(text)
    hits = found & voter_of.keys()
    votes = sorted({voter_of[w] for w in hits})
    text = text or ""
    tests = (text.isupper(), "!!" in text, GRAWLIX.search(text) is not None,
             "you" in text and any(w in voter_of or w in INSULTS for w in YOU.findall(text.lower())), not found.isdisjoint(INSULTS), not hits)
    return votes + [LEXICON_VOTERS + i for i, t in enumerate(tests) if t]


def pair_counts(docs: DataFrame, text: str, voter_of: dict[str, int]) -> tuple[float, np.ndarray]:
    """Number of documents, and how often each pair of voters fires together, over all documents."""
    n = LEXICON_VOTERS + len(PATTERNS)

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, both = 0, np.zeros((n, n), np.int64)
        for batch in batches:
            for t in batch["text"]:
                votes = fired(t, voter_of)
                total += 1
                both[np.ix_(votes, votes)] += 1
        i, j = np.nonzero(both)
        yield pd.DataFrame({"i": np.append(i, -1), "j": np.append(j, -1), "n": np.append(both[i, j], total)})

    rows = (docs.select(F.col(text).alias("text")).mapInPandas(counts, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect())
    total, both = 0, np.zeros((n, n))
    for r in rows:
        if r["i"] < 0:
            total = r["n"]
        else:
            both[r["i"], r["j"]] = r["n"]
    return float(total), both


@dataclass(frozen=True)
class LabelModel:
    """Firing rates on clean and toxic texts, covariances within a class, and the posterior's weights."""

    clean: np.ndarray
    toxic: np.ndarray
    within: np.ndarray
    weights: np.ndarray
    bias: float

    def posterior(self, votes: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
        """Probability of the toxic class given which voters fire; where a text is labelled, the annotator is one more voter."""
        logit = votes @ self.weights + self.bias
        if labels is not None:
            logit = np.clip(logit, -4, 4) + (2 * labels - 1) * np.log(ANNOTATOR / (1 - ANNOTATOR))
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def label_model(total: float, both: np.ndarray, prior: float, start: np.ndarray) -> LabelModel:
    """Accuracies and correlations of the voters from how often pairs of them fire together.

    ``start`` are differences of the firing rates seen on labelled texts: they settle which class a voter speaks for, and
    count as much as all other voters together. Pairs found correlated are left out of the fit one by one, the worst
    first, because they bend it for all others. What the two classes do not explain of the covariances is the voters'
    correlation within a class; the posterior weighs them by its inverse, so voters that always agree share one weight.
    """
    n = len(both)
    rate = np.diag(both) / max(total, 1)
    cov = both / max(total, 1) - np.outer(rate, rate)
    spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-9))
    share = prior * (1 - prior)
    usable = ~np.eye(n, dtype=bool)
    for _ in range(n):
        delta = start.astype(float).copy()
        for _ in range(30):
            for i in range(n):
                weight = np.where(usable[i], delta / spread**2, 0)
                pull = max((weight * delta).sum(), 1e-9)
                delta[i] = np.clip(((cov[i] * weight).sum() / share + pull * start[i]) / (2 * pull), -1, 1)
        off = np.where(usable, np.abs(cov - share * np.outer(delta, delta)) / np.outer(spread, spread), 0)
        worst = off >= max(CORRELATED, off.max() / 2)
        if not worst.any() or ((usable & ~worst).sum(axis=1) < 3).any():
            break
        usable &= ~worst
    toxic, clean = np.clip(rate + delta * (1 - prior), 0, 1), np.clip(rate - delta * prior, 0, 1)
    within = cov - share * np.outer(delta, delta)
    values, vectors = np.linalg.eigh((within + within.T) / 2 / np.outer(spread, spread))
    inverse = (vectors / np.maximum(values, 0.05)) @ vectors.T / np.outer(spread, spread)
    weights = inverse @ (toxic - clean)
    return LabelModel(clean, toxic, within, weights, float(np.log(prior / (1 - prior)) - weights @ (toxic + clean) / 2))


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Lexicon, label model, linear classifier and calibration.

    Without labelled texts of both classes nothing can be told apart, and every text gets the smoothed share of toxic
    labels (0.1 without any label).
    """
    shares = {r[label]: r["count"] for r in labels.where(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    prior = (shares.get(1, 0) + 0.1) / (sum(shares.values()) + 1)
    nothing = Model({}, float(np.log(prior / (1 - prior))), prior)
    if len(shares) < 2:
        return nothing
    # Rows of the bounded sample: class, key and text.
    rows = sorted((r["_label"], str(r["_key"]), r["_text"]) for r in sample(docs, labels, key, text, label).toLocalIterator())
    y = np.array([r[0] for r in rows])
    if not 0 < y.sum() < len(y):
        return nothing
    # Words as numbers, each word held once.
    numbers: dict[str, int] = {}
    found = [np.array([numbers.setdefault(w, len(numbers)) for w in sorted(words(r[2]))], np.int32) for r in rows]
    sizes = np.bincount(y, minlength=2)
    seen = [np.bincount(np.concatenate([f for f, v in zip(found, y, strict=True) if v == c]), minlength=len(numbers)) for c in (0, 1)]
    table = [(w, seen[0][i] / sizes[0], seen[1][i] / sizes[1], seen[1][i]) for w, i in numbers.items() if max(seen[0][i], seen[1][i]) >= MIN_TEXTS]
    # Difference of the rates in standard deviations, with the counts smoothed by one.
    strength = lambda a, b: (b - a) / np.sqrt((a + 1 / sizes[0]) / sizes[0] + (b + 1 / sizes[1]) / sizes[1])
    ranked = sorted(((strength(a, b), w, a, b, k) for w, a, b, k in table), key=lambda r: (-r[0], r[1]))
    lexicon = [w for s, w, a, b, k in ranked if s > 2 and k >= MIN_TEXTS and b >= MIN_LIFT * (a + 0.5 / sizes[0])][:LEXICON_WORDS]
    features = sorted(sorted(ranked, key=lambda r: (-abs(r[0]), r[1]))[:FEATURES], key=lambda r: r[1])
    voter_of = deal(lexicon)
    votes = np.zeros((len(rows), LEXICON_VOTERS + len(PATTERNS)), bool)
    for i, r in enumerate(rows):
        votes[i, fired(r[2], voter_of)] = True
    start = votes[y == 1].mean(axis=0) - votes[y == 0].mean(axis=0)
    target = label_model(*pair_counts(docs, text, voter_of), prior, start).posterior(votes, y)

    at = {r[1]: i for i, r in enumerate(features)}
    column = np.full(len(numbers), -1)
    column[[numbers[w] for w in at]] = list(at.values())
    x = np.zeros((len(rows), len(at)), np.float32)
    for i, ws in enumerate(found):
        x[i, column[ws][column[ws] >= 0]] = 1
    weight = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    w, bias = logistic(x, target, weight, ridge=1e-4)
    slope, shift = logistic((x @ w + bias)[:, None], y.astype(float), weight, ridge=1e-4)
    return Model({f: float(w[i] * slope[0]) for f, i in at.items()}, float(bias * slope[0] + shift), prior)


def score(docs: DataFrame, model: Model, *, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability (0 to 1) that a text is toxic.

    Every whole text is read. Null and empty texts have no word and get the classifier's value for that; equal texts
    have equal scores. Columns of the name ``out`` are replaced; an empty table stays empty.
    """
    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = model.weights
        for batch in batches:
            margin = np.array([model.bias + sum(weights[w] for w in sorted(words(t) & weights.keys())) for t in batch], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(margin, -30, 30))))

    return without(docs, out).withColumn(out, scores(F.col(text)))
