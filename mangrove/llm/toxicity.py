"""Toxicity by weak supervision.

1. Voters. A lexicon entry (a word, or a stem written `stem*`) or a pattern of shouting, masking and stretching, each with a rate: it fires where it occurs, or occurs once in
   so many words at least, for what is common in long clean texts by chance. A bounded sample of labelled rows (`sample_rows`, lowest hash of doc_id first) picks
   the voters: those that lean to label 1, where they reach texts that are not covered three times already, so that the words of one much
   copied text don't fill the lexicon. Only the sample is bounded; every row is scored.
2. A generative label model over the voters, without any label among its votes: voters that don't fire abstain; a class prior; how often
   a text of each class has any voter fire; one firing rate per voter and class (its accuracy); and the correlations of voters left within the classes, which
   discount voters that fire together where both do. Fitted by EM, which starts from whether any voter fires and the
   sample's share of label 1 where none does.
3. A linear (logistic) classifier over the votes and the patterns' counts learns the posterior labels and scores every whole text.

Defined cases: null text counts as empty; an empty text gets the classifier's score without any evidence; without
labelled rows, or with one class only, every score is 0.0; repeated rows and null ids are scored like others.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, small_batches

THRESHOLD = 0.3
#: Pattern voters, fixed values.
PATTERNS = {
    "/shout/": r"\b[A-Z]{4,}\b",
    "/bang/": r"[!?]{2,}",
    "/masked/": r"\b[A-Za-z]+[*@$]+[A-Za-z]+\b",
    "/stretched/": r"([A-Za-z])\1{3,}",
}
_WORD = re.compile(r"[^\W\d_]+")
_PATTERNS = {name: re.compile(p) for name, p in PATTERNS.items()}
#: Letters that stems have; the first of them suffice to pass over most words of a text.
STEMS, HEAD = range(4, 10), 4
#: A voter of rate r fires where it occurs once in r words at least; 0: where it occurs. Each is stricter than the one before.
RATES = (0, 200, 100, 50)
#: Candidates that reach the driver, and of those the ones counted.
CANDIDATES, COUNTED = 20_000, 256
#: Texts whose entries a Python worker holds at once.
COUNTED_AT_ONCE = 200
#: Texts of label 1 that one of label 0 outweighs in the order of candidates.
COST = 3
#: Texts not well covered yet that a voter must reach.
NEW_TEXTS = 3


@dataclass
class LabelModel:
    """P(label 1 | which voters fire). Voters abstain where they don't fire; that none fires is evidence of its own."""

    prior: float
    any: np.ndarray = field(default_factory=lambda: np.full(2, 0.5))
    rates: np.ndarray = field(default_factory=lambda: np.zeros((2, 0)))
    correlations: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def posterior(self, fires: np.ndarray) -> np.ndarray:
        x = fires.astype(float)
        told = x * np.log(self.rates[1] / self.rates[0]) / (1 + x @ self.correlations)
        silent = math.log((1 - self.any[1]) / (1 - self.any[0]))
        z = math.log(self.prior / (1 - self.prior)) + np.where(fires.any(1), told.sum(1), silent)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_label_model(fires: np.ndarray, silent: float, rounds: int = 20) -> LabelModel:
    """EM from whether any voter fires, `silent` being the share of class 1 to start with where none does; rates are smoothed by half a count."""
    x, any_fires = fires.astype(float), fires.any(1).astype(float)
    model = LabelModel(0.5)
    q = np.where(any_fires > 0, 0.9, silent)
    for _ in range(rounds):
        classes = np.stack([1 - q, q])
        mass = classes.sum(1)
        model.prior = float((mass[1] + 0.5) / (len(x) + 1))
        model.rates = (classes @ x + 0.5) / (mass[:, None] + 1)
        model.any = (classes @ any_fires + 0.5) / (mass + 1)
        residual = x - classes.T @ model.rates
        scale = np.sqrt((residual**2).mean(0)) + 1e-9
        together = np.maximum((residual.T @ residual) / len(x) / np.outer(scale, scale), 0)
        np.fill_diagonal(together, 0)
        model.correlations = together
        new = model.posterior(fires)
        if np.abs(new - q).max() < 1e-6:
            break
        q = new
    return model


def fit_logistic(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Newton steps on soft targets; the last weight is the intercept and is not penalised."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - target) + penalty * w
        hessian = (x.T * np.maximum(p * (1 - p), 1e-6)) @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fires(n: int, rate: int, words: int) -> bool:
    return n > 0 and (not rate or n * rate >= words)


def all_entries(text: str) -> tuple[Counter, int]:
    """Counts of everything that may be an entry, and the number of words."""
    found = _WORD.findall(text.lower())
    out: Counter = Counter()
    for word, n in Counter(found).items():
        out[word] += n
        for k in STEMS:
            if k <= len(word):
                out[word[:k] + "*"] += n
    for name, pattern in _PATTERNS.items():
        out[name] = sum(1 for _ in pattern.finditer(text))
    return out, len(found)


class Voters:
    """Entries with their rates; `votes` of a text also gives the patterns' counts."""

    def __init__(self, entries: list[tuple[str, int]]) -> None:
        self.entries = entries
        self.heads = {e[:-1][:HEAD] if e.endswith("*") else e[:HEAD] for e, _ in entries if e not in PATTERNS}
        self.names = {e for e, _ in entries}

    def votes(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        text = text or ""
        found = _WORD.findall(text.lower())
        counts: Counter = Counter()
        for word, n in Counter(w for w in found if w[:HEAD] in self.heads).items():
            for entry in (word, *(word[:k] + "*" for k in STEMS if k <= len(word))):
                if entry in self.names:
                    counts[entry] += n
        for name, pattern in _PATTERNS.items():
            counts[name] = sum(1 for _ in pattern.finditer(text))
        return np.array([fires(counts[e], rate, len(found)) for e, rate in self.entries], bool), np.array([counts[p] for p in PATTERNS], float)


def features(votes: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """Columns: votes, log counts of patterns, how many voters fire and whether any does."""
    n = votes.sum(1, keepdims=True)
    return np.hstack([votes, np.log1p(patterns), np.log1p(n), n > 0])


def unnested(entries: list[tuple[str, int]], most: int = COUNTED) -> list[tuple[str, int]]:
    """The first `most` entries of which none begins like another."""
    kept: list[tuple[str, int]] = []
    whole, beginnings = set(), set()
    for entry, rate in entries:
        stem = entry.rstrip("*")
        own = {stem[:k] for k in range(1, len(stem) + 1)}
        if not own & whole and stem not in beginnings:
            kept.append((entry, rate))
            whole.add(stem)
            beginnings |= own
            if len(kept) == most:
                break
    return kept


def useful(hits: np.ndarray, least: int, most: int, cover: int = 3) -> list[int]:
    """Columns of `hits` (rows of label 1 by candidates, best first) that reach `least` or more rows not covered `cover` times yet."""
    covered, kept = np.zeros(len(hits), int), []
    for i in range(hits.shape[1]):
        if (hits[:, i] & (covered < cover)).sum() >= least:
            kept.append(i)
            covered += hits[:, i]
        if len(kept) == most:
            break
    return kept


@dataclass
class ToxicityModel:
    voters: list[tuple[str, int]]
    weights: np.ndarray | None
    label_model: LabelModel | None = None

    def scores(self, texts: pd.Series) -> np.ndarray:
        if self.weights is None or not len(texts):
            return np.zeros(len(texts))
        voters = Voters(self.voters)
        seen = [voters.votes(t) for t in texts]
        x = features(np.stack([v for v, _ in seen]), np.stack([p for _, p in seen]))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -40, 40)))


def candidates(sample: DataFrame, n: dict[int, int], min_docs: int) -> list[tuple[str, int]]:
    """Entries with rates that lean to label 1 in `sample` (label, text), best first. n: texts of each label."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), COUNTED_AT_ONCE):
                seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
                part = batch.iloc[at : at + COUNTED_AT_ONCE]
                for label, text in zip(part["label"], part["text"], strict=True):
                    found, words = all_entries(text)
                    seen[int(label)].update((e, sum(fires(k, rate, words) for rate in RATES[1:])) for e, k in found.items() if k)
                keys = list(seen[0].keys() | seen[1].keys())
                yield pd.DataFrame({"entry": [e for e, _ in keys], "strict": [r for _, r in keys], "a": [seen[1][k] for k in keys], "b": [seen[0][k] for k in keys]})

    # A text counts for the strictest rate that fires, and so for those before it.
    found = sample.mapInPandas(count, "entry string, strict int, a long, b long")
    at_least = lambda k, c: F.coalesce(F.sum(F.when(F.col("strict") >= k, F.col(c))), F.lit(0))
    by_rate = F.array(*[F.struct(F.lit(rate).alias("rate"), at_least(k, "a").alias("a"), at_least(k, "b").alias("b")) for k, rate in enumerate(RATES)])
    seen = found.groupBy("entry").agg(by_rate.alias("rates")).select("entry", F.inline("rates"))
    a, b = (F.col("a") + 0.1) / (n[1] + 0.2), (F.col("b") + 0.1) / (n[0] + 0.2)
    odds = F.log(a * (1 - b) / (b * (1 - a)))
    spread = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    order = (F.desc(F.col("a") - COST * F.col("b")), "rate", F.length("entry"), "entry")
    chosen = seen.where((F.col("a") >= min_docs) & (odds > 3) & (odds / spread > 4)).orderBy(*order).limit(CANDIDATES).collect()
    return [(r["entry"], r["rate"]) for r in chosen]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", sample_rows: int = 20_000, lexicon_words: int = 64, min_docs: int = 5, supervised: bool = False) -> ToxicityModel:
    """Model from the labelled rows given; the caller leaves held-out rows out of `labels`. `supervised` trains the classifier on the labels themselves, to compare with."""
    ids = only(labels, doc_id=id_col, label=label_col).where("doc_id is not null and label is not null")
    ids = ids.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = only(small_batches(docs), doc_id=id_col, text="text").join(F.broadcast(ids), "doc_id").select("label", F.coalesce("text", F.lit("")).alias("text"))
    sample = sample.groupBy(F.xxhash64("text").alias("h"), "label").agg(F.first("text").alias("text"))
    n = {int(r["label"]): int(r["n"]) for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return ToxicityModel([], None)
    listed = unnested(candidates(sample.select("label", "text"), n, min_docs))

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voters = Voters(listed)
        for batch in batches:
            seen = [voters.votes(t) for t in batch["text"]]
            yield pd.DataFrame({"label": batch["label"], "votes": [v.tobytes() for v, _ in seen], "patterns": [p for _, p in seen]})

    # At most sample_rows rows of COUNTED votes, no texts.
    rows = sample.select("label", "text").mapInPandas(vote, "label int, votes binary, patterns array<double>").toPandas()
    votes = np.stack([np.frombuffer(v, bool) for v in rows["votes"]])
    patterns, label = np.stack(rows["patterns"].to_list()), rows["label"].to_numpy()
    kept = useful(votes[label == 1], NEW_TEXTS, lexicon_words)
    votes = votes[:, kept]
    order = np.lexsort([*votes.T, *patterns.T, label])  # sums of floats agree between runs
    votes, patterns, label = votes[order], patterns[order], label[order]
    silent = label[~votes.any(1)]
    model = fit_label_model(votes, (silent.sum() + 0.5) / (len(silent) + 1))
    weights = fit_logistic(features(votes, patterns), label if supervised else model.posterior(votes))
    return ToxicityModel([listed[k] for k in kept], weights, model)


def _scorer(model: ToxicityModel):
    voters, weights = model.voters, model.weights

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(ToxicityModel(voters, weights).scores(texts))

    return of


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score (0 to 1) of each whole text."""
    return only(small_batches(docs), doc_id="doc_id", text="text").select("doc_id", _scorer(model)("text").alias("score"))


def reject(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose score is below `threshold`."""
    return small_batches(docs).where(_scorer(model)(docs["text"]) < threshold)
