"""Quality classifier (operator 4): kernel ridge on document statistics, with calibrated scores.

Statistics of whole texts are standardised and mapped by random Fourier features, whose inner products
approximate a Gaussian kernel. A ridge regression on them is fitted by normal equations that each
partition sums up and Spark adds; only those sums, a table of fixed size, come to the driver. An
isotonic (never falling) step function, fitted on rows that the regression didn't see, turns its
output into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoload.llm.common import annotate, map_arrow, truncate_lineage
from cartoload.llm.quality_rules import SYMBOLS, repeated_words

FEATURES = 192  # random Fourier features; the sums have about half its square of numbers
RIDGE = 1e-4  # per row
WIDTH = 3.0  # of the kernel, in standard deviations of the statistics
BINS = 2000  # of the regression's output, for the isotonic fit
THRESHOLD = 0.7
N_STATS = 16
_DIGITS, _UPPER = b"0123456789", bytes(range(65, 91))
_MARKS, _CALLS, _BLANKS = b".,;:?'\"()-", b"!", b" \t\n\r\v\f"


def statistics(text: str | None) -> list[float]:
    """``N_STATS`` numbers of a whole text, all finite, also for an empty one."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = max(len(words), 1), max(len(raw), 1)
    lines = [line for line in raw.split(b"\n") if line.strip()]

    def share(octets: bytes) -> float:
        return len(raw) - len(raw.translate(None, octets))

    symbols = share(SYMBOLS)
    longest = max(map(len, words), default=0)
    short = sum(len(w) <= 2 for w in words)
    return [
        float(np.log1p(len(words))), float(np.log1p(len(text))), sum(map(len, words)) / n, symbols / n, float(np.log1p(symbols)),
        share(_DIGITS) / size, share(_UPPER) / size, share(_MARKS) / n, share(_CALLS) / n, share(_BLANKS) / size,
        (len(lines) - len(set(lines))) / max(len(lines), 1), repeated_words(words) / n, len(set(words)) / n,
        len(lines) / n, (len(raw) - len(text)) / size, float(np.log1p(longest)) + short / n,
    ]


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with ``stats array<double>``; a null text counts as empty, a column ``stats`` is replaced."""
    return annotate(docs, ["text"], "stats array<double>", lambda texts: [[statistics(t) for t in texts.to_pylist()]])


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps_at: np.ndarray
    steps: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -6, 6)
        waves = np.cos(z @ self.frequencies + self.phases) * np.sqrt(2 / self.frequencies.shape[1])
        return np.hstack([waves, np.ones((len(stats), 1))])

    def output(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Between 0 and 1; a small part follows the output itself, so that steps keep their inner order."""
        out = self.output(stats)
        level = np.interp(out, self.steps_at, self.steps) if len(self.steps) else np.clip(out, 0, 1)
        return 0.99 * level + 0.01 / (1 + np.exp(-4 * np.clip(out - 0.5, -10, 10)))


def pool(counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Isotonic means: neighbours that fall are pooled until none does."""
    blocks: list[list[float]] = []
    for n, s in zip(counts, sums):
        blocks.append([float(s), float(n), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return np.array([s / n for s, n, k in blocks for _ in range(int(k))])


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), N_STATS)


def fit(measured: DataFrame, labelled: DataFrame, features: int = FEATURES, ridge: float = RIDGE, width: float = WIDTH, seed: int = 42) -> Model:
    """Fit on ``labelled`` (``stats label calibrate``); ``measured`` (``stats``) gives the scales.

    Rows with ``calibrate`` fit the isotonic steps, the others the regression. No bound is set on the
    rows; where there are none, every score is one half.
    """
    moments = measured.agg(*[f(F.col("stats")[k]) for k in range(N_STATS) for f in (F.avg, F.stddev_pop)]).first()
    mean = np.array([moments[2 * k] or 0.0 for k in range(N_STATS)])
    spread = np.array([max(moments[2 * k + 1] or 0.0, 1e-6) for k in range(N_STATS)])
    draw = np.random.default_rng(seed)
    model = Model(mean, spread, draw.normal(0, 1 / width, (N_STATS, features)), draw.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.zeros(0), np.zeros(0))
    size = features + 2  # the features, the constant and the label
    upper = np.triu_indices(size)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            z = model.features(matrix(batch.column(0)))
            z = np.hstack([z, batch.column(1).to_numpy(zero_copy_only=False).reshape(-1, 1)])
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]))), pa.array(total[upper])], names=["place", "total"])

    chosen = labelled.select("stats", F.col("label").cast("double").alias("label"), "calibrate")
    rows = map_arrow(chosen.where("not calibrate").select("stats", "label"), "place bigint, total double", sums).groupBy("place").agg(F.sum("total")).collect()
    total = np.zeros((size, size))
    for place, value in rows:
        total[upper[0][place], upper[1][place]] = value
    total += np.triu(total, 1).T
    gram, right = total[:-1, :-1], total[:-1, -1]
    n = gram[-1, -1]
    if n == 0:
        model.weights[-1] = 0.5
        return model
    penalty = np.full(features + 1, ridge * n)
    penalty[-1] = 1e-9 * n
    model.weights = np.linalg.solve(gram + np.diag(penalty), right)

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.floor(np.clip((model.output(matrix(batch.column(0))) + 0.5) / 2, 0, 1 - 1e-9) * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(place), batch.column(1)], names=["bin", "label"])

    bins = (map_arrow(chosen.where("calibrate").select("stats", "label"), "bin bigint, label double", outputs)
            .groupBy("bin").agg(F.count("*").alias("n"), F.sum("label").alias("s")).orderBy("bin").collect())
    if bins:
        model.steps_at = (np.array([b[0] for b in bins]) + 0.5) / BINS * 2 - 0.5
        model.steps = pool(np.array([b[1] for b in bins]), np.array([b[2] for b in bins]))
    return model


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of its id as text, modulo 4, is 2. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(measured: DataFrame, labels: DataFrame) -> Model:
    """A model from ``measured`` (``doc_id stats``) and ``labels`` (``doc_id quality``), without the held-out rows.

    Null ids and null labels teach nothing; a document labelled twice counts twice.
    """
    labelled = (measured.where(~held_out()).join(labels.where("quality is not null").select("doc_id", F.col("quality").alias("label")), "doc_id")
                .select("stats", "label", (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).alias("calibrate")))
    return fit(measured, labelled)


def apply(measured: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``measured`` with ``score`` and ``predicted``; columns of these names are replaced."""
    scored = annotate(measured, ["stats"], "score double", lambda stats: [pa.array(model.score(matrix(stats)))])
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``docs``.

    Every row gets a score, empty and null texts and repeated rows too; an empty table gives none.
    ``lang``, ``source`` and ``doc_id`` never enter a score. The statistics are written once below
    ``spark.checkpoint.dir`` and read by the three passes of the fit and by the scoring.
    """
    measured = truncate_lineage(spark, measure(docs.select("doc_id", "text")).drop("text"), "statistics")
    model = learn(measured, labels)
    return apply(measured.withColumn("held_out", held_out()), model, threshold).select("doc_id", "held_out", "score", "predicted")
