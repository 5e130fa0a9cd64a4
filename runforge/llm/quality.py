"""Quality classifier: regularised quadratic discriminant over document statistics.

A pass over the texts turns each into a few transformed statistics. Class means and
covariances come from sums that Spark adds up; only these small matrices reach the driver.
Covariances shrink towards the pooled one and that towards its diagonal; a score is the
difference of the two log densities, from Mahalanobis distances by Cholesky factors that
are made once and sent with the scoring tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runforge.llm.common import cut, load, row_key

THRESHOLD = 0.3
#: Shares of the pooled covariance in each class's, and of the diagonal in the pooled one.
SHRINK_TO_POOLED = 0.1
SHRINK_TO_DIAGONAL = 0.05
#: Added to every variance: statistics that never vary in a class must not decide alone.
LEAST_VARIANCE = 0.02
#: The statistics of a document; those without words have them too.
FEATURES = (
    "log_bytes", "log_words", "word_length", "upper_words", "upper_letters", "distinct_words", "repeated_neighbours",
    "symbols", "exclamations", "bars", "digits", "stops", "distinct_lines", "words_in_line", "function_words",
)

_KIND = np.zeros(256, np.int64)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"#$%&*@^~<>{}[]\\/=+_", b"!?", b"|", b"0123456789", b".,;:"), 1):
    _KIND[list(_chars)] = _i


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text, in the order of FEATURES; null is empty."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    of = np.bincount(_KIND, np.bincount(raw, minlength=256), 8)
    _, upper, lower, symbols, excl, bars, digits, stops = of
    found = (text or "").split()
    n, lines = len(found), (text or "").split("\n")
    share = lambda x, y: np.log((x + 0.5) / (y + 1.0) + 0.02)  # noqa: E731  one scale for rare and common things
    words = max(n, 1)
    return [
        np.log1p(len(raw)),
        np.log1p(n),
        np.log1p(len(raw) / words),
        share(sum(map(str.isupper, found)), n),
        share(upper, upper + lower),
        share(len(set(found)) - 0.5 if n else 0, n / (1 + np.log1p(n / 200))),
        share(sum(map(eq, found, found[1:])), n),
        share(symbols, n),
        share(excl, n),
        share(bars, n),
        share(digits, n),
        share(stops, n),
        share(len(set(lines)), len(lines)),
        np.log1p(n / len(lines)),
        share(sum(len(w) <= 3 for w in found), n),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, x array<double>) for every row of docs; only the text is looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in range(0, b.num_rows, 1000):
                c = b.slice(part, 1000)
                x = [statistics(t) for t in c.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "row_key", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", row_key("doc_id", "text").alias("row_key"), "text").mapInArrow(run, f"doc_id {kind}, row_key bigint, x array<double>")


@dataclass
class QuadraticDiscriminant:
    """Means, inverse Cholesky factors and log determinants of class 0 and 1, and the log odds of class 1."""

    means: list[np.ndarray]
    inverse_factors: list[np.ndarray]
    log_dets: list[float]
    log_odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of x."""
        if not self.means:
            return np.full(len(x), 1 / (1 + np.exp(-self.log_odds)))
        d = [((x - m) @ f.T) for m, f in zip(self.means, self.inverse_factors, strict=True)]
        log = [-0.5 * ((z * z).sum(1) + ld) for z, ld in zip(d, self.log_dets, strict=True)]
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0] + self.log_odds, -500, 500)))


def fit(labelled: DataFrame) -> QuadraticDiscriminant:
    """From rows (label 0 or 1, x). A missing class leaves a model that scores by class shares, none at all 0.5."""
    d = len(FEATURES)
    products = F.flatten(F.transform("x", lambda a: F.transform("x", lambda b: a * b)))
    sums = labelled.select("label", F.posexplode(F.concat(F.array(F.lit(1.0)), "x", products))).groupBy("label", "pos").agg(F.sum("col").alias("s"))
    got: dict[int, np.ndarray] = {}
    for r in sums.collect():  # 2 (1 + d + d d) numbers
        got.setdefault(r["label"], np.zeros(1 + d + d * d))[r["pos"]] = r["s"]
    n = [got[c][0] if c in got else 0.0 for c in (0, 1)]
    odds = float(np.log((n[1] + 0.5) / (n[0] + 0.5)))
    if min(n) < 2:
        return QuadraticDiscriminant([], [], [], odds)
    means = [got[c][1 : 1 + d] / n[c] for c in (0, 1)]
    covs = [got[c][1 + d :].reshape(d, d) / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / sum(n)
    pooled = (1 - SHRINK_TO_DIAGONAL) * pooled + SHRINK_TO_DIAGONAL * np.diag(np.diag(pooled))
    factors = [np.linalg.cholesky((1 - SHRINK_TO_POOLED) * c + SHRINK_TO_POOLED * pooled + LEAST_VARIANCE * np.eye(d)) for c in covs]
    return QuadraticDiscriminant(means, [np.linalg.inv(f) for f in factors], [2 * float(np.log(np.diag(f)).sum()) for f in factors], odds)


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 0 when divided by 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, row_key, held_out, score, predicted) for every row of docs (doc_id, text).

    labels (doc_id, quality) teaches on the documents that are not held out; rows with null
    quality or id are passed over, of several labels of one id the largest counts. Scores
    depend on the text alone; empty, null and wordless texts are scored by the same model.
    Repeated rows are scored each. Other columns are ignored.
    """
    stats = cut(document_statistics(docs))
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("l_id")).agg(F.max("quality").cast("int").alias("label"))
    model = fit(stats.where(~held_out()).join(known, F.col("doc_id") == F.col("l_id")).select("label", "x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                score = model.score(np.array(b.column(2).flatten()).reshape(b.num_rows, -1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score)], names=["doc_id", "row_key", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = stats.select("doc_id", "row_key", "x").mapInArrow(run, f"doc_id {kind}, row_key bigint, score double")
    return scored.select("doc_id", "row_key", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier accepts, with the columns of docs."""
    good = score_quality(docs, labels, threshold).where("predicted = 1").select(F.col("doc_id").alias("g_id"), F.col("row_key").alias("g_key")).distinct()
    marked = docs.withColumn("g_row", row_key("doc_id", "text"))
    return marked.join(good, marked["doc_id"].eqNullSafe(good["g_id"]) & (marked["g_row"] == good["g_key"]), "left_semi").drop("g_row")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    scored = score_quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")
