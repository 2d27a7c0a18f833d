"""Toxicity by weak supervision.

Voters. A lexicon voter fires on a word, a pattern voter on words that begin with a stem. Words come from a short fixed
list and, like stems, from the labelled rows: those whose documents are toxic far more often than others.

Label model. Over the vote matrix of the sample a generative model with a hidden class is fitted by expectation
maximisation: the class balance, for each voter how often it fires in either class, which is its accuracy, and which
voters stay correlated once the class is known (a word and its own stem, say). These dependencies are a forest: the pairs
of the largest mutual information given the class, where that is significant, each voter with at most one that it depends
on. Such a voter's likelihood is that of its vote given the class and the other one's vote, so that one signal isn't
counted twice. Accuracies, pairs and their correlations given the class are part of the model.

Classifier. A logistic regression on the voters' votes, how many distinct ones fire, and the number of distinct words is
trained on the label model's posterior, and scores every document.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship, written
from .learning import bounded_sample, fit_logistic, held_out

#: Words that insult in most contexts.
INSULTS = ["clown", "disgusting", "dumb", "fool", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless"]
SAMPLE_BOUND = 20_000
MOST_VOTERS = 400
STEM = 4
#: A learned voter's documents: at least so many toxic ones, and so many times as often toxic as others.
LEAST_TOXIC, LEAST_LIFT = 3, 8.0
#: Of a sample row with a posterior of 0.5 or more, since toxic rows are rare and few voters fire on each.
RARE_WEIGHT = 4.0
#: Twice the logarithm of the likelihood ratio of a pair that depends on each other: with 2 degrees of freedom, and up to
#: 80,000 pairs of 400 voters, chance reaches it for one pair in 100 models.
SIGNIFICANT = 32.0
_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> set[str]:
    """Words (runs of letters, lower-cased) and stems (first letters of longer words, with a mark)."""
    words = set(_WORD.findall((text or "").lower()))
    return words | {w[:STEM] + "*" for w in words if len(w) > STEM}


@dataclass
class ToxicityModel:
    voters: list[str]
    weights: np.ndarray
    bias: float
    accuracy: dict[str, float] = field(default_factory=dict)
    #: (voter, the one it depends on): correlation of their votes among clean and among toxic documents.
    correlations: dict[tuple[str, str], tuple[float, float]] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        x = vote_row(tokens(text), self._index(), len(self.voters))
        return float(1 / (1 + math.exp(-max(-50.0, min(50.0, float(x @ self.weights) + self.bias)))))

    def _index(self) -> dict[str, int]:
        if not hasattr(self, "_at"):
            self._at = {v: i for i, v in enumerate(self.voters)}
        return self._at


def vote_row(found: set[str], index: dict[str, int], n: int) -> np.ndarray:
    """Votes, then the logarithms of one more than the number of voters that fire, and of distinct words, in tens."""
    x = np.zeros(n + 2)
    hit = [index[t] for t in found if t in index] if len(found) < n else [i for t, i in index.items() if t in found]
    x[hit] = 1
    x[n] = math.log1p(len(hit))
    x[n + 1] = math.log1p(sum(not t.endswith("*") for t in found)) / 10
    return x


@dataclass
class LabelModel:
    """What expectation maximisation estimates; probabilities have the clean class first."""

    balance: float
    fires: np.ndarray  # [class, voter]
    parent: np.ndarray  # the voter that each depends on, or -1
    given: np.ndarray  # [class, the other one's vote, voter]: how often each fires
    posterior: np.ndarray

    def correlation(self, j: int) -> tuple[float, float]:
        """Of the votes of j and of the voter it depends on, within each class."""
        out = []
        for y in range(2):
            a, b = self.fires[y, self.parent[j]], self.fires[y, j]
            out.append(float((self.given[y, 1, j] - b) * a / math.sqrt(max(1e-12, a * (1 - a) * b * (1 - b)))))
        return out[0], out[1]


def forest(votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Per voter the one it depends on, or -1: a maximum spanning forest over the mutual information of pairs given the
    class, of the pairs where it is significant (a likelihood ratio above SIGNIFICANT). weight: [class, row]."""
    m = votes.shape[1]
    gain = np.zeros((m, m))
    for w in weight:
        n = w.sum() + 1e-9
        both = (votes * w[:, None]).T @ votes
        one = np.diag(both).copy()
        for i1 in (0, 1):
            for j1 in (0, 1):
                cell = both if i1 and j1 else one[:, None] - both if i1 else one[None, :] - both if j1 else n - one[:, None] - one[None, :] + both
                want = (one if i1 else n - one)[:, None] * (one if j1 else n - one)[None, :] / n
                cell = np.maximum(cell, 0)
                gain += 2 * np.where(cell > 1e-9, cell * np.log(np.maximum(cell, 1e-12) / np.maximum(want, 1e-12)), 0)
    np.fill_diagonal(gain, 0)
    parent, group = np.full(m, -1), np.arange(m)
    linked: list[list[int]] = [[] for _ in range(m)]
    i, j = np.triu_indices(m, 1)
    strong = np.flatnonzero(gain[i, j] > SIGNIFICANT)
    for k in strong[np.argsort(-gain[i, j][strong], kind="stable")].tolist():
        a, b = int(i[k]), int(j[k])
        if group[a] != group[b]:
            group[group == group[b]] = group[a]
            linked[a].append(b), linked[b].append(a)
    seen: set[int] = set()
    for root in range(m):
        todo = [root] if root not in seen else []
        seen.update(todo)
        while todo:
            a = todo.pop()
            for b in linked[a]:
                if b not in seen:
                    seen.add(b)
                    parent[b] = a
                    todo.append(b)
    return parent


def label_model(votes: np.ndarray, balance: float, rounds: int = 60) -> LabelModel:
    """Expectation maximisation; the dependencies are looked for twice, when the class is known well enough."""
    n, m = votes.shape
    parent = np.full(m, -1)
    p = np.where(votes.any(axis=1), 0.9, balance / 4) if m else np.full(n, balance)
    fires, given = np.zeros((2, m)), np.zeros((2, 2, m))
    b = balance
    if not n or not m:
        return LabelModel(balance, fires, parent, given, p)
    prior = np.array([0.05, 0.5])  # clean documents make voters fire less often
    for r in range(rounds):
        weight = np.stack([1 - p, p])
        fires = (weight @ votes + prior[:, None]) / (weight.sum(axis=1) + 1)[:, None]
        if r in (rounds // 3, 2 * rounds // 3):
            parent = forest(votes, weight)
        own = np.flatnonzero(parent >= 0)
        above = votes[:, parent[own]]
        given = np.stack([fires, fires], axis=1)
        for y in range(2):
            for a, side in ((0, 1 - above), (1, above)):  # a prior of one observation, at the voter's own rate
                given[y, a, own] = ((weight[y][:, None] * side * votes[:, own]).sum(axis=0) + fires[y, own]) / (weight[y] @ side + 1)
        given = np.clip(given, 1e-6, 1 - 1e-6)
        b = min(max(float(p.mean()), balance / 2), min(0.9, balance * 2))
        fire, rest = np.log(given[1] / given[0]), np.log((1 - given[1]) / (1 - given[0]))  # [the other one's vote, voter]
        odds = math.log(b / (1 - b)) + votes @ (fire[0] - rest[0]) + rest[0].sum()
        odds += above @ (rest[1] - rest[0])[own] + (above * votes[:, own]) @ ((fire[1] - rest[1]) - (fire[0] - rest[0]))[own]
        p = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return LabelModel(b, fires, parent, given, p)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bound: int = SAMPLE_BOUND, most_voters: int = MOST_VOTERS) -> ToxicityModel:
    """A model from at most about ``bound`` rows of labels and their texts, which are written once to the shared folder.

    Only the counts of at most ``most_voters`` voters and the sample's votes reach the driver. Labels that are null or
    have a null id take no part; a label that is repeated counts once, and an id with both labels is a document of either
    class. A document that repeats an id is one more row of its label. Without labels of both classes the model scores
    every text alike, near 0.
    """
    ship(docs.sparkSession)
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("y")).distinct()
    sample = F.broadcast(bounded_sample(marked, id_col, bound))  # bounded: ids and labels of the sample
    known = written(docs.select(id_col, F.col(text_col).cast("string").alias("t")).join(sample, id_col).select("y", "t"), "labelled")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count: dict[tuple[str, int], int] = {}
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w in tokens(t):
                    count[w, y] = count.get((w, y), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in count], pa.string()), pa.array([v * (k[1] == 1) for k, v in count.items()], pa.int64()), pa.array([v * (k[1] != 1) for k, v in count.items()], pa.int64())], names=["w", "pos", "neg"])

    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    toxic, clean = totals.get(1, 0), sum(v for k, v in totals.items() if k != 1)
    if not toxic or not clean:
        return ToxicityModel([], np.zeros(2), -4.0)
    lift = (F.col("pos") + 0.5) / (toxic + 1) / ((F.col("neg") + 0.5) / (clean + 1))
    counts = known.mapInArrow(explode, "w string, pos long, neg long").groupBy("w").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    learned = counts.where((F.col("pos") >= LEAST_TOXIC) & (lift >= LEAST_LIFT)).orderBy((F.log(lift) * F.sqrt("pos")).desc(), "w").limit(most_voters - len(INSULTS)).collect()
    voters = sorted({r["w"] for r in learned} | set(INSULTS))
    index = {v: i for i, v in enumerate(voters)}

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [vote_row(tokens(t), index, len(index)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(x[:-2].astype(np.uint8)).tobytes() + x[-2:].astype("<f4").tobytes() for x in rows], pa.binary())], names=["x"])

    raw = sorted(known.mapInArrow(vote, "x binary").toArrow().column("x").to_pylist())
    packed = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(len(raw), -1)
    votes = np.unpackbits(packed[:, :-8], axis=1)[:, : len(voters)].astype(np.float64)
    found = label_model(votes, toxic / (toxic + clean))
    x = np.hstack([votes, np.ascontiguousarray(packed[:, -8:]).view("<f4").astype(np.float64)])
    p = found.posterior
    w, bias = fit_logistic(x, p, np.where(p >= 0.5, RARE_WEIGHT, 1.0), reg=1e-4)
    accuracy = {v: float(a / (a + z)) for v, z, a in zip(voters, *found.fires)}
    pairs = {(voters[j], voters[found.parent[j]]): found.correlation(j) for j in np.flatnonzero(found.parent >= 0).tolist()}
    return ToxicityModel(voters, w, bias, accuracy, pairs)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id, held_out, score and predicted (score >= threshold) of every row.

    Null text counts as empty, whose score is that of no votes. Null ids stay null. Empty table: no rows. Other columns
    of docs are not read.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MOST_VOTERS voters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([m.score(t) for t in b.column(2).to_pylist()], pa.float64())], names=["id", "held_out", "score"])

    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
