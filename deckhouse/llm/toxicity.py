"""Toxicity by cumulative-link ordinal regression over sparse text features.

Grades are ordered severities 0..J-1. One weight vector is shared by all thresholds:
P(grade > j) = sigmoid(w . x - b_j) with b_0 < b_1 < ...; the score of a text is its expected
severity, the sum of those probabilities. Features are the presence of a word and of each of
its prefixes, so word families of any language count as one. An L1 penalty leaves few weights.

The model is fitted on the driver from a bounded sample of labelled rows (``sample_rows``, taken
in hash order), of which only features that tell something get there; every document is scored whole, in one Arrow pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, store, table

#: Most labelled rows that a fit uses; all fewer are used whole.
SAMPLE_ROWS = 12_000
#: Prefix lengths that count as features beside the word itself.
PREFIXES = (3, 4, 5, 6, 7)
#: A feature must occur in so many sampled texts, and depend on the grade by so large a G statistic
#: (chi-squared with one degree of freedom: chance alone reaches 20 once in 100,000 features).
LEAST_TEXTS, LEAST_G = 5, 20.0
#: Most words whose features a worker keeps; beyond, it starts anew.
CACHE_WORDS = 200_000
#: Rejected from this probability of any toxicity.
THRESHOLD = 0.25

_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    """Distinct lower-case runs of letters."""
    return set(_LETTERS.findall(text.lower()))


def features_of(word: str) -> list[int]:
    """Hashes of the word and of its proper prefixes."""
    keys = ["w" + word, *("p" + word[:n] for n in PREFIXES if len(word) > n)]
    return [xxhash.xxh32_intdigest(k) for k in keys]


@dataclass
class OrdinalModel:
    """Shared weights by feature and the ordered thresholds."""

    weights: dict[int, float]
    thresholds: list[float]

    def above(self, logit: float) -> list[float]:
        """P(grade > j) for each j."""
        return [1.0 / (1.0 + np.exp(min(700.0, b - logit))) for b in self.thresholds]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def told(dirty: Column, count: Column, bad: int, n: int) -> Column:
    """G statistic of a feature against toxicity, from its number of toxic and of all texts, of ``bad`` and ``n``."""
    share, clean = F.lit(bad / n), count - dirty

    def term(x: Column, expected: Column) -> Column:
        return F.when(x > 0, x * F.log(x / F.greatest(expected, F.lit(1e-12)))).otherwise(0.0)

    return 2 * (term(dirty, count * share) + term(clean, count * (1 - share)) + term(F.lit(bad) - dirty, (F.lit(n) - count) * share) + term(F.lit(n - bad) - clean, (F.lit(n) - count) * (1 - share)))


def fit(indptr: np.ndarray, keys: np.ndarray, grades: np.ndarray, l1: float = 1e-4, rounds: int = 1500) -> OrdinalModel:
    """Proximal gradient (FISTA) on the mean cumulative log loss of presence features, plus ``l1`` times the sum of absolute weights.

    ``keys[indptr[i]:indptr[i + 1]]`` are the features of row i. Without rows, or with a single
    grade, nothing can be learnt: all weights are zero and the thresholds state the grade.
    """
    top = int(grades.max(initial=0))
    if not len(grades) or top == int(grades.min(initial=0)):
        return OrdinalModel({}, [-10.0] * top + [10.0] * (not top))
    names, column = np.unique(keys, return_inverse=True)
    row = np.repeat(np.arange(len(grades)), np.diff(indptr))
    n, d = len(grades), len(names)
    above = (grades[:, None] > np.arange(top)[None, :]).astype(float)
    share = np.clip(above.mean(0), 1e-4, 1 - 1e-4)
    b = -np.log(share / (1 - share))
    w = np.zeros(d)
    # A step that the largest row allows: the loss has curvature of at most (features + 1) * top / 4 a row.
    step = 4.0 / (top * (1 + np.percentile(np.bincount(row, minlength=n), 90)))
    old_w, old_b, t = w, b, 1.0
    z_w, z_b = w, b
    last = np.inf
    for _ in range(rounds):
        logit = np.bincount(row, z_w[column], n)
        p = _sigmoid(logit[:, None] - z_b[None, :])
        loss = -np.mean(np.sum(above * np.log(p + 1e-12) + (1 - above) * np.log(1 - p + 1e-12), 1)) + l1 * np.abs(z_w).sum()
        if loss > last * 1.001 + 1e-9:  # overshot: smaller steps from the last good point
            step, z_w, z_b, t, last = step / 2, old_w, old_b, 1.0, np.inf
            continue
        last = loss
        error = (p - above) / n
        w = z_w - step * np.bincount(column, error.sum(1)[row], d)
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        b = np.maximum.accumulate(z_b + step * error.sum(0))
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z_w, z_b = w + (t - 1) / t_next * (w - old_w), b + (t - 1) / t_next * (b - old_b)
        old_w, old_b, t = w, b, t_next
    return OrdinalModel({int(names[i]): float(w[i]) for i in np.flatnonzero(w)}, [float(x) for x in np.maximum.accumulate(b)])


def graded(labels: DataFrame) -> DataFrame:
    """``doc_id, grade``: severities as the labels state them. Those of a column ``grade`` if there is one; else 0 for what isn't toxic, 1 for
    toxic texts of good quality and 2 for other toxic ones (a null quality is not a good one). A row with a null id or a null ``toxic`` is none; of contradicting ones the highest counts."""
    grade = F.col("grade") if "grade" in labels.columns else F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.when(F.col("quality") == 1, 1).otherwise(2)) if "quality" in labels.columns else F.col("toxic")
    return labels.select("doc_id", grade.cast("int").alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").alias("grade"))


def sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, grade, text`` of at most ``sample_rows`` labelled documents, in hash order of doc_id, stored.

    The sampled labels are bounded by ``sample_rows``, so they are broadcast. Of documents that repeat an id the smallest text counts.
    """
    chosen = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("grade").alias("grade"), F.min("text").alias("text"))
    return store(rows, "labelled")


def telling_features(rows: DataFrame) -> np.ndarray:
    """Sorted features of ``rows(grade, text)`` that are in LEAST_TEXTS texts and depend on toxicity by LEAST_G. Texts are counted where they
    are and the counts added up; only features that tell something reach the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            keys, bad = [np.empty(0, np.uint32)], [np.empty(0, bool)]
            for grade, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.array(sorted(_features(text)), np.uint32)
                keys.append(found)
                bad.append(np.full(len(found), grade > 0))
            names, at = np.unique(np.concatenate(keys), return_inverse=True)
            dirty = np.bincount(at[np.concatenate(bad)], minlength=len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(np.bincount(at, minlength=len(names)).astype(np.int64)), pa.array(dirty.astype(np.int64))], names=["key", "count", "dirty"])

    size = rows.agg(F.count("*").alias("n"), F.count_if(F.col("grade") > 0).alias("bad")).first()
    if not size.bad or size.bad == size.n:
        return np.empty(0, np.uint32)
    counts = rows.select("grade", "text").mapInArrow(run, "key long, count long, dirty long").groupBy("key").agg(F.sum("count").alias("count"), F.sum("dirty").alias("dirty"))
    found = counts.where((F.col("count") >= LEAST_TEXTS) & (told(F.col("dirty"), F.col("count"), size.bad, size.n) >= LEAST_G))
    return np.sort(found.select("key").toArrow().column(0).to_numpy().astype(np.uint32))


def _features(text: str | None) -> set[int]:
    return {k for w in words_of(text or "") for k in features_of(w)}


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """The model fitted on ``sample``. Of each text only telling features reach the driver. Without labelled rows nothing is toxic."""
    rows = sample(docs, labels, sample_rows)
    names = telling_features(rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            packed = [np.intersect1d(names, np.array(list(_features(t)), np.uint32)).astype(np.uint32).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["doc_id", "grade", "keys"])

    found = rows.select("doc_id", "grade", "text").mapInArrow(run, "doc_id long, grade int, keys binary").toArrow()  # sample_rows rows
    found = found.take(pc.sort_indices(found, [("doc_id", "ascending")]))
    sizes = pc.binary_length(found.column("keys")).to_numpy().astype(np.int64) // 4
    keys = np.frombuffer(b"".join(x.as_buffer() for x in found.column("keys")), np.uint32)
    return fit(np.concatenate([[0], np.cumsum(sizes)]), keys, found.column("grade").to_numpy().astype(np.int64))


def _scorer(model: OrdinalModel):
    """A function from texts to rows of P(grade > j); it keeps the active features of the words it has met."""
    weights = model.weights
    cache: dict[str, tuple[int, ...]] = {}

    def score_texts(texts: list[str | None]) -> list[list[float]]:
        if len(cache) > CACHE_WORDS:
            cache.clear()
        out = []
        for t in texts:
            active: set[int] = set()
            for word in words_of(t or ""):
                hit = cache.get(word)
                if hit is None:
                    hit = cache[word] = tuple(k for k in features_of(word) if k in weights)
                if hit:
                    active.update(hit)
            out.append(model.above(sum(weights[k] for k in sorted(active))))
        return out

    return score_texts


def score(docs: DataFrame, model: OrdinalModel, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, severity, p_toxic, toxic`` of every whole text; null and empty texts have no features
    and so the base rate. Rows with null or repeated ids are scored like any other. (The model is
    bounded by the sample it was fitted on; it travels with the task.)"""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_texts = _scorer(model)
        for batch in slices(batches, 1):
            above = score_texts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([float(sum(x)) for x in above]), pa.array([float(x[0]) for x in above]), pa.array([bool(x[0] >= threshold) for x in above])], names=["doc_id", "severity", "p_toxic", "toxic"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, severity double, p_toxic double, toxic boolean")


def drop_toxic(docs: DataFrame, model: OrdinalModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not toxic by ``score``; no shuffle. Null and empty texts have the base rate of the
    labels and so stay; repeated rows stay or go together; an empty table gives none."""
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_texts = _scorer(model)
        for batch in slices(batches, at):
            yield batch.filter(pa.array([x[0] < threshold for x in score_texts(batch.column(at).to_pylist())]))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored. The tables state no severity: grade 2, toxic and of bad quality, is a proxy for one, and the expected severity means as much as that does."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic", "quality")))
