"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Voters are cheap signs of toxicity: a fixed word list, groups of words and groups of word beginnings that
are far more frequent in toxic training rows, and patterns of several such signs together. A voter fires or
not. The label model holds the share of toxic documents, each voter's rate of firing in either class, and
correlations among voters beyond the class. It is estimated from the voters' moments over all documents:
for voters that depend on the class alone covariances have rank one, so triples of voters give each one's
rates; what a covariance has beyond that is a correlation, and correlated voters share their weight. The
posterior labels of training rows then teach a sparse linear classifier on hashed words and word
beginnings, which scores whole texts, also by words no voter knows.

Sizes are fixed: ``per_class`` labelled rows of each class, ``TERMS`` terms in the voters, ``1 << BITS``
weights, a matrix of voters squared. Both passes over all documents have no shuffle of texts.

Nulls: a null or empty text has no words; it gets the classifier's bias. A null id is scored as other rows.
Repeated rows are each scored. Without labelled rows of both classes every score is the prior, 0, and
``keep`` keeps all. Columns other than id and text are carried by ``keep`` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steadypace.llm.common import with_package
from steadypace.llm.hashing import ALNUM, U, Words, batch_words, mix, slices
from steadypace.llm.labelled import calibrate, held_out, training_rows
from steadypace.session import materialise

BITS = 18
PREFIX = 5
TERMS = 4000
WORD_VOTERS, PREFIX_VOTERS = 5, 3
# Common English insults.
INSULTS = ("idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb jerk fool "
           "imbecile filth garbage bastard retard pig vermin").split()


def _hash(word: str) -> int:
    return int(batch_words(pa.array([word]), ALNUM).hashes[0])


def _terms(found: Words, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words and word beginnings of one document."""
    heads = found.prefixes[lo:hi]
    return np.unique(found.hashes[lo:hi]), np.unique(heads[heads != 0])


def _inside(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if len(table) == 0:
        return np.zeros(len(values), np.int64) - 1
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


@dataclass(frozen=True)
class Voters:
    """Sorted hashes of words and beginnings with the voter each belongs to."""

    words: np.ndarray
    word_voter: np.ndarray
    heads: np.ndarray
    head_voter: np.ndarray
    fixed: np.ndarray

    @property
    def count(self) -> int:
        return 1 + WORD_VOTERS + PREFIX_VOTERS + 2

    def votes(self, found: Words) -> np.ndarray:
        """One row per document, one column per voter, 1 where it fires."""
        n, owners = len(found.offsets) - 1, found.owners()
        fires = np.zeros((n, self.count), np.int8)
        fires[owners[_inside(found.hashes, self.fixed) >= 0], 0] = 1
        at = _inside(found.hashes, self.words)
        known = at >= 0
        fires[owners[known], 1 + self.word_voter[at[known]]] = 1
        head = _inside(found.prefixes, self.heads)
        begun = head >= 0
        fires[owners[begun], 1 + WORD_VOTERS + self.head_voter[head[begun]]] = 1
        signs = np.bincount(owners[known | begun], minlength=n)
        sizes = np.maximum(found.counts(), 1)
        fires[:, -2] = signs >= 2
        fires[:, -1] = signs * 400 >= sizes  # one sign in 400 words
        return fires


@dataclass(frozen=True)
class LabelModel:
    prior: float
    toxic_rate: np.ndarray
    clean_rate: np.ndarray
    correlation: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        share = 1 / np.maximum(self.correlation, 0).sum(1)  # the diagonal is 1
        yes = np.log(self.toxic_rate / self.clean_rate) * share
        no = np.log((1 - self.toxic_rate) / (1 - self.clean_rate)) * share
        odds = np.log(self.prior / (1 - self.prior)) + votes @ yes + (1 - votes) @ no
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit_label_model(n: int, sums: np.ndarray, products: np.ndarray, prior: float) -> LabelModel:
    """From how often voters fire and fire together in ``n`` documents."""
    mean = sums / n
    covariance = products / n - np.outer(mean, mean)
    k = len(mean)
    loading = np.zeros(k)
    for i in range(k):
        found = [covariance[i, a] * covariance[i, b] / covariance[a, b]
                 for a, b in combinations([j for j in range(k) if j != i], 2)
                 if covariance[a, b] > 1e-9 and covariance[i, a] * covariance[i, b] > 0]
        loading[i] = np.sqrt(min(np.median(found), mean[i] * (1 - mean[i]))) if found else 0
    gap = loading / np.sqrt(prior * (1 - prior))
    low, high = 1e-4, 1 - 1e-4
    toxic = np.clip(mean + (1 - prior) * gap, low, high)
    clean = np.clip(mean - prior * gap, low, high)
    spread = np.sqrt(np.maximum(np.diag(covariance), 1e-12))
    rest = (covariance - np.outer(loading, loading)) / np.outer(spread, spread)
    np.fill_diagonal(rest, 1)
    return LabelModel(prior, toxic, clean, np.clip(rest, -1, 1))


def learn_voters(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Voters:
    """Words and beginnings that are at least twenty times as frequent in toxic rows."""
    kept = []
    for part, least in ((0, 3), (1, 5)):
        toxic, n_toxic = np.unique(np.concatenate([b[part] for b, v in zip(bags, y) if v]), return_counts=True)
        clean, n_clean = np.unique(np.concatenate([b[part] for b, v in zip(bags, y) if not v]),
                                   return_counts=True)
        at = _inside(toxic, clean)
        other = np.where(at >= 0, n_clean[at] if len(clean) else 0, 0) / max((~y.astype(bool)).sum(), 1)
        rate = n_toxic / max(y.sum(), 1)
        ok = (n_toxic >= least) & (rate >= 20 * (other + 0.2 / len(y)))
        strongest = np.argsort(-(rate * ok), kind="stable")[: min(TERMS // 2, int(ok.sum()))]
        kept.append(np.sort(toxic[strongest]))
    deal = lambda h, n: (mix(h ^ U(0x5851F42D)) % U(n)).astype(np.int64)
    fixed = np.sort(np.array([_hash(w) for w in INSULTS], U))
    return Voters(kept[0], deal(kept[0], WORD_VOTERS), kept[1], deal(kept[1], PREFIX_VOTERS), fixed)


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray
    bias: float
    label_model: LabelModel | None = None

    def scores(self, column: pa.Array) -> np.ndarray:
        found = batch_words(column, ALNUM, prefix=PREFIX)
        owners, n = found.owners(), len(column)
        slots = np.concatenate([found.hashes, found.prefixes]) >> U(64 - BITS)
        weight = self.weights[slots.astype(np.int64)]
        weight[len(found.hashes):][found.prefixes == 0] = 0
        # Only slots with a weight matter; each counts once in a document.
        some = np.flatnonzero(weight)
        key = np.unique(np.concatenate([owners, owners])[some] << BITS | slots[some].astype(np.int64))
        margin = np.bincount(key >> BITS, self.weights[key & ((1 << BITS) - 1)], n) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def fit_linear(bags: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, weight: np.ndarray,
               rounds: int = 250, rate: float = 0.5, penalty: float = 2e-4) -> tuple[np.ndarray, float]:
    """Sparse logistic regression on soft labels: gradient steps scaled by the gradients so far, with
    soft thresholding."""
    slots = [np.unique(np.concatenate(b) >> U(64 - BITS)).astype(np.int64) for b in bags]
    sizes = np.array([len(s) for s in slots])
    column = np.concatenate(slots)
    row = np.repeat(np.arange(len(slots)), sizes)
    used, place = np.unique(column, return_inverse=True)
    w, bias = np.zeros(len(used)), 0.0
    seen, seen_bias = np.full(len(used), 1e-12), 1e-12
    for _ in range(rounds):
        margin = np.bincount(row, w[place], len(slots)) + bias
        error = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - target) * weight / len(slots)
        grad = np.bincount(place, error[row], len(used))
        seen += grad**2
        step = rate / np.sqrt(seen)
        w -= step * grad
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        seen_bias += error.sum() ** 2
        bias -= rate * error.sum() / np.sqrt(seen_bias)
    weights = np.zeros(1 << BITS)
    weights[used] = w
    return weights, float(bias)


def _bags(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = batch_words(batch.column("text"), ALNUM, prefix=PREFIX)
                bags = [_terms(found, lo, hi)
                        for lo, hi in zip(found.documents[:-1], found.documents[1:])]
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").cast(pa.int64()),
                    "y": batch.column("y").cast(pa.int32()), "weight": batch.column("weight"),
                    "text": batch.column("text"),
                    "words": pa.array([b[0].tobytes() for b in bags], pa.binary()),
                    "heads": pa.array([b[1].tobytes() for b in bags], pa.binary()),
                })

    with_package(rows.sparkSession)
    return rows.select("doc_id", "text", "y", "weight").mapInArrow(
        run, "doc_id long, y int, weight double, text string, words binary, heads binary"
    )


def _moments(docs: DataFrame, voters: Voters) -> tuple[int, np.ndarray, np.ndarray]:
    """How often voters fire and fire together, over all documents: one row per task, then one sum."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((voters.count, voters.count), np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                fires = shared.value.votes(batch_words(batch.column("text"), ALNUM, prefix=PREFIX))
                n += len(fires)
                total += fires.astype(np.int64).T @ fires.astype(np.int64)
        yield pa.record_batch({"n": pa.array([n], pa.int64()),
                               "together": pa.array([total.ravel().tolist()], pa.list_(pa.int64()))})

    k = voters.count
    rows = docs.select("text").mapInArrow(run, "n long, together array<long>")
    sums = rows.agg(F.sum("n"), *(F.sum(F.col("together")[i]) for i in range(k * k))).first()
    products = np.array([v or 0 for v in sums[1:]], float).reshape(k, k)
    return int(sums[0] or 0), np.diag(products).copy(), products


def _votes(rows: DataFrame, voters: Voters) -> DataFrame:
    """doc_id and votes (a byte each) of rows, from their whole texts."""
    shared = with_package(rows.sparkSession).sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                fires = shared.value.votes(batch_words(batch.column("text"), ALNUM, prefix=PREFIX))
                yield pa.record_batch({"doc_id": batch.column("doc_id").cast(pa.int64()),
                                       "votes": pa.array([f.tobytes() for f in fires], pa.binary())})

    return rows.select("doc_id", "text").mapInArrow(run, "doc_id long, votes binary")


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2500) -> ToxicityModel:
    """Fit on at most ``2 * per_class`` labelled documents and the voters' moments over all documents."""
    picked = materialise(training_rows(docs, labels, "toxic", per_class))
    rows = sorted(_bags(picked).drop("text").toLocalIterator(), key=lambda r: r["doc_id"])
    y = np.array([r["y"] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return ToxicityModel(np.zeros(1 << BITS), -500.0)
    bags = [(np.frombuffer(r["words"], U), np.frombuffer(r["heads"], U)) for r in rows]
    weight = np.array([r["weight"] for r in rows])
    voters = learn_voters(bags, y)
    n, sums, products = _moments(docs, voters)
    prior = float(np.clip(weight[y == 1].max() / 2, 1e-3, 1 - 1e-3))
    model = fit_label_model(max(n, 1), sums, products, prior)
    # The training rows' votes come from their whole texts, as those behind the moments do.
    cast = {r["doc_id"]: r["votes"] for r in _votes(picked, voters).toLocalIterator()}
    votes = np.array([np.frombuffer(cast[r["doc_id"]], np.int8) for r in rows])
    # Every fifth row is kept from the fit, to set slope and shift by its label.
    aside = np.arange(len(bags)) % 5 == 4
    if len(set(y[aside].tolist())) < 2 or not (~aside).any():
        aside[:] = False
    kept = np.flatnonzero(~aside)
    weights, _ = fit_linear([bags[i] for i in kept], model.posterior(votes)[kept], weight[kept])
    # Thresholding keeps weights small: margins are scaled to the labels' odds.
    slots = [np.unique(np.concatenate(b) >> U(64 - BITS)).astype(np.int64) for b in bags]
    known = np.flatnonzero(aside) if aside.any() else kept
    margin, y = np.array([weights[slots[i]].sum() for i in known]), y[known]
    even = np.where(y == 1, 1 / (y == 1).sum(), 1 / (y == 0).sum())
    slope, shift = calibrate(margin, y, even, 1e-4)
    return ToxicityModel(weights * slope, shift, model)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted (1 from 0.7 on)."""
    shared = with_package(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                yield pa.record_batch({"doc_id": batch.column("doc_id").cast(pa.int64()),
                                       "score": pa.array(shared.value.scores(batch.column("text")))})

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """``docs`` with its columns, without the rows that score from the threshold on."""
    shared = with_package(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                yield batch.filter(pa.array(shared.value.scores(batch.column("text")) < threshold))

    return docs.mapInArrow(run, docs.schema)
