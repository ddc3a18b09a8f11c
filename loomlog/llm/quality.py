"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

Statistics of the whole text are standardised and mapped to cosines with random frequencies, whose inner products
approximate a Gaussian kernel. Tasks sum their part of the normal equations; the sums are added by matrix cell, so no
task holds more than one matrix. The ridge scores of rows kept out of that fit are binned and made monotone (pool
adjacent violators); a score is read off between the means of the pools.

Only texts and labels of the training rows matter: language, source and id are no inputs. Defined results: null and
empty texts are scored by their statistics (all 0); null labels and labels without a document are not learnt from;
without usable labels every score is 0.5; repeated rows are scored alike; an empty table gives an empty result;
columns that are not named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm.batches import slices
from loomlog.llm.text_stats import rule_counts
from loomlog.session import cut, ship_by_value

ship_by_value(__name__)

SLICE_BYTES = 4 << 20
FEATURES = 256  # cosines
GAMMA = 0.05  # of the kernel exp(-gamma * distance^2) over standardised statistics
RIDGE = 1e-3  # per training row
BINS = 1000  # per unit of the raw score
SEED = 20240501

UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
DIGITS = b"0123456789"
STOPS = b".,;:?"
SHOUTS = b"!"
MARKS = b"#*$%&|<>@_=+~^\\/{}[]"
HIGH = bytes(range(128, 256))

STATISTICS = [
    "words", "word_length", "upper", "digits", "stops", "shouts", "marks", "high", "distinct", "repeats", "windows", "lines",
    "same_lines", "line_words", "short_words", "long_words", "title_words",
]


def statistics(text: str | None) -> list[float]:
    """Bounded figures of a whole text, in the order of STATISTICS."""
    if not text or text.isspace():
        return [0.0] * len(STATISTICS)
    data = text.encode()
    words = data.split()
    n, size = len(words), len(data)
    if not n:
        return [0.0] * len(STATISTICS)
    n_words, chars, _, same_lines, in_windows = rule_counts(text)

    def share(kind: bytes) -> float:
        return (size - len(data.translate(None, kind))) / size

    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = data.count(b"\n") + 1
    upper, lower = share(UPPER), share(LOWER)
    return [
        float(np.log1p(n)), min(chars / n, 40.0), upper / (upper + lower + 1e-9), share(DIGITS), share(STOPS), share(SHOUTS), share(MARKS),
        share(HIGH), (len(set(words)) / n) ** 0.5, sum(map(bytes.__eq__, words, words[1:])) / n, in_windows / n, float(np.log1p(lines)),
        same_lines / lines, float(np.log1p(n / lines)), float((lengths <= 3).mean()), float((lengths > 15).mean()),
        sum(map(bytes.istitle, words)) / n,
    ]


def with_statistics(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, x) with x the statistics of every document."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                x = pa.array(list(map(statistics, part.column("text").to_pylist())), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), x], ["doc_id", "x"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return cut(rows.mapInArrow(run, f"doc_id {kind}, x array<double>"), "statistics")


class Cosines:
    """The random Fourier map of standardised statistics, with a constant; fixed by its seed."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.frequencies = rng.normal(0.0, np.sqrt(2 * GAMMA), (len(mean), FEATURES))
        self.phases = rng.uniform(0.0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        out = np.sqrt(2.0 / FEATURES) * np.cos(z @ self.frequencies + self.phases)
        return np.hstack([out, np.ones((len(x), 1))])


def as_matrix(column) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def normal_equations(rows: DataFrame, cosines: Cosines) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums of z z', z y and the rows; each task sends its sums once, by matrix row."""
    width = FEATURES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((width, width + 1)), 0
        for batch in batches:
            if batch.num_rows:
                z = cosines(as_matrix(batch.column("x")))
                y = batch.column("y").to_numpy(zero_copy_only=False)
                total += z.T @ np.column_stack([z, y])
                n += len(y)
        if n:
            places = np.arange(width * (width + 1))
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(total.ravel())], ["place", "value"])

    cells = rows.select("x", "y").mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros(width * (width + 1))
    total[cells["place"].to_numpy()] = cells["value"].to_numpy()
    total = total.reshape(width, width + 1)
    return total[:, :-1], total[:, -1], int(round(total[-1, -2]))  # the constant's square counts the rows


def isotonic(places: np.ndarray, counts: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ascending ``places``: the mean place and the share of ones of each pool."""
    pools: list[list[float]] = []
    for x, n, k in zip(places, counts, ones):
        pools.append([x * n, n, k])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[0] / p[1] for p in pools]), np.array([p[2] / p[1] for p in pools])


def classify(
    docs: DataFrame, labels: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
) -> DataFrame:
    """(doc_id, score, predicted) of every document.

    ``labels`` holds ``doc_id`` and a 0/1 ``label``; ``training`` (over ``doc_id``) names the rows to learn from.
    Four fifths of them, by a hash of the id, fit the ridge scores and one fifth calibrates them.
    """
    known = labels.select(F.col(doc_id).alias("l_id"), F.col(label).cast("double").alias("y")).where(F.col("y").isNotNull() & F.col("l_id").isNotNull())
    rows = with_statistics(docs, doc_id, text)
    learnt = cut(
        rows.where(training).join(known, F.col("doc_id") == F.col("l_id")).select("x", "y", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("apart")), "labelled",
    )
    moments = learnt.agg(*[f(F.col("x")[i]).alias(f"{n}{i}") for i in range(len(STATISTICS)) for f, n in ((F.avg, "m"), (F.stddev_pop, "d"))], F.count(F.lit(1)).alias("n")).first()
    if not moments["n"]:
        return rows.select("doc_id", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    cosines = Cosines(np.array([moments[f"m{i}"] for i in range(len(STATISTICS))]), np.array([moments[f"d{i}"] for i in range(len(STATISTICS))]))
    fitted = learnt.where("not apart")
    squares, products, n = normal_equations(fitted, cosines)
    if not n:
        fitted = learnt
        squares, products, n = normal_equations(learnt, cosines)
    weights = np.linalg.solve(squares + RIDGE * n * np.eye(len(products)), products)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = np.clip(cosines(as_matrix(batch.column("x"))) @ weights, -1.0, 2.0)
                yield pa.RecordBatch.from_arrays([pa.array(np.round(s * BINS).astype(np.int32)), batch.column("y")], ["bin", "y"])

    apart = learnt.where("apart")
    if apart.isEmpty():
        apart = fitted
    bins = apart.select("x", "y").mapInArrow(raw, "bin int, y double").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k")).orderBy("bin").toArrow()
    places, values = isotonic(bins["bin"].to_numpy() / BINS, bins["n"].to_numpy().astype(float), bins["k"].to_numpy())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = np.clip(cosines(as_matrix(batch.column("x"))) @ weights, -1.0, 2.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.clip(np.interp(s, places, values), 0.0, 1.0))], ["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
