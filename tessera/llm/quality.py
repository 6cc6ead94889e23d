"""Quality scores: random Fourier features over document statistics, ridge regression, isotonic calibration.

Random Fourier features approximate a Gaussian kernel over standardised statistics of the whole text. Every partition adds
up its own part of the normal equations, the parts are summed block by block on the executors, and the driver solves one
system whose size is the number of features. The ridge scores become probabilities by isotonic regression over a histogram
of scores, which has a fixed number of bins.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import materialize, slices

#: Characters that count as symbols, and as stops.
SYMBOLS, STOPS = "#$%&*@~^_=+<>/\\{}[]`", ".,;:?"
STATISTICS = ("log_chars", "log_words", "word_length", "word_spread", "distinct_words", "distinct_pairs", "top_word", "repeats", "log_lines", "distinct_lines", "line_words", "upper", "digit", "stop", "exclamation", "bar", "symbol", "space", "beyond_ascii", "caps_words", "stopped_words")
_UPPER = list(range(65, 91))
_DIGIT = list(range(48, 58))
_STOP, _SYMBOL = [[ord(c) for c in chars] for chars in (STOPS, SYMBOLS)]
_END = tuple(STOPS + "!")


def statistics(text: str) -> list[float]:
    """The numbers of STATISTICS for a whole text; all zero for an empty one."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    raw = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
    size, m = int(raw.sum()), len(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=m)
    lines = text.split("\n")
    after = words[1:]
    return [
        np.log1p(size),
        np.log1p(m),
        lengths.mean(),
        lengths.std(),
        np.log1p(len(set(words))) / np.log1p(m),
        len(set(zip(words, after, strict=False))) / m,
        Counter(words).most_common(1)[0][1] / m,
        sum(map(eq, words, after)) / m,
        np.log1p(len(lines)),
        len(set(lines)) / len(lines),
        np.log1p(m / len(lines)),
        raw[_UPPER].sum() / size,
        raw[_DIGIT].sum() / size,
        raw[_STOP].sum() / size,
        raw[33] / size,
        raw[124] / size,
        raw[_SYMBOL].sum() / size,
        (raw[32] + raw[10]) / size,
        raw[128:].sum() / size,
        sum(map(str.isupper, words)) / m,
        sum(w.endswith(_END) for w in words) / m,
    ]


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics ``x`` of every text; null texts count as empty."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, map(len, texts), 4_000_000):
                x = pa.array([statistics(t) for t in texts[a:b]], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], x], names=["doc_id", "x"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, x array<double>")


class Fourier:
    """cos(xW + b) with Gaussian W: inner products approximate a Gaussian kernel of the given width, in standard units."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int, width: float, seed: int):
        random = np.random.default_rng(seed)
        self.mean, self.scale = mean, np.where(scale > 1e-9, scale, 1.0)
        self.w = random.normal(0, 1 / width, (len(mean), features))
        self.b = random.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])


def normal_equations(rows: DataFrame, fourier: Fourier, blocks: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Sums of z z' and z y over ``rows`` (x, y): summed within partitions, then block by block on the executors."""

    def partial(batches):
        total = None
        for batch in batches:
            x = np.stack(batch.column(0).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros((0, len(fourier.mean)))
            for a in range(0, len(x), 4096):
                z = fourier(x[a : a + 4096])
                own = z.T @ np.hstack([z, batch.column(1).to_numpy()[a : a + 4096, None]])
                total = own if total is None else total + own
        if total is not None:
            for k, part in enumerate(np.array_split(total, blocks)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["block", "part"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p.as_py()) for p in table.column("part"))
        return pa.table({"block": table.column("block")[:1], "part": pa.array([total.tobytes()], pa.binary())})

    summed = rows.select("x", "y").mapInArrow(partial, "block int, part binary").groupBy("block").applyInArrow(add, "block int, part binary")
    found = {r["block"]: np.frombuffer(r["part"]) for r in summed.collect()}
    d = len(fourier.b) + 1
    if not found:
        return np.zeros((d, d)), np.zeros(d)
    total = np.concatenate([found[k] for k in range(blocks)]).reshape(d, d + 1)
    return total[:, :d], total[:, d]


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit (pool adjacent violators): mean x and value of every pool."""
    pools: list[list[float]] = []
    for a, b, w in sorted(zip(x.tolist(), y.tolist(), weight.tolist(), strict=True)):
        pools.append([a * w, b * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def score(
    docs: DataFrame,
    labels: DataFrame,
    features: int = 512,
    width: float = 3.0,
    ridge: float = 1e-4,
    seed: int = 7,
    bins: int = 1000,
) -> DataFrame:
    """Scores every document of ``docs`` (doc_id, text) by what ``labels`` (doc_id, quality 0/1) say of the others.

    Returns doc_id, held_out, score in [0, 1] and predicted (score >= 0.5). held_out marks documents whose crc32(doc_id as
    text) mod 3 is 1: their labels are never read. Of the rest, a fifth (the next digit of the checksum, in base 5) only
    calibrates. All labelled rows take part, without a bound. Other columns are ignored, so language, source and id cannot
    be inputs. Null text counts as empty; empty texts get the model's score for statistics that are all zero. Repeated rows
    are scored each, and count each when labelled; a document with several labels counts as their mean; null labels and
    null ids teach nothing (a null id is not held out). Without any label all scores are 0.5; an empty table gives no rows.
    """
    x = materialize(measure(docs), "statistics")
    key = F.crc32(F.col("doc_id").cast("string"))
    marked = labels.select("doc_id", F.col("quality").cast("double").alias("y")).dropna().filter(key % 3 != 1).groupBy("doc_id").agg(F.avg("y").alias("y"))
    taught = x.join(marked, "doc_id").withColumn("calibrates", F.floor(key / 3) % 5 == 0)
    taught = materialize(taught, "taught")
    moments = taught.agg(*[f(F.col("x")[i]).alias(f"{f.__name__}{i}") for i in range(len(STATISTICS)) for f in (F.avg, F.stddev_pop)], F.count(F.lit(1)).alias("n")).first()
    if not moments["n"]:
        curve, fourier, beta = (np.array([0.0, 1.0]), np.array([0.5, 0.5])), Fourier(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)), 1, width, seed), np.zeros(2)
    else:
        fourier = Fourier(*(np.array([moments[f"{f}{i}"] for i in range(len(STATISTICS))]) for f in ("avg", "stddev_pop")), features, width, seed)
        a, b = normal_equations(taught.filter(~F.col("calibrates")), fourier)
        beta = np.linalg.solve(a + ridge * max(1.0, a[-1, -1]) * np.eye(len(b)), b)
        raw = F.floor((F.greatest(F.lit(-0.5), F.least(F.lit(1.5), "raw")) + 0.5) / 2 * bins)
        held = _raw(taught.filter("calibrates"), fourier, beta, ["y"]).groupBy(raw.alias("bin")).agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n")).collect()
        curve = isotonic(*(np.array([r[c] for r in held], dtype=float) for c in ("raw", "y", "n"))) if held else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        # beyond its last pools the curve goes on to 0 and 1, so that scores there keep their order
        curve = np.concatenate([[curve[0][0] - 1], curve[0], [curve[0][-1] + 1]]), np.concatenate([[0.0], curve[1], [1.0]])

    def calibrated(batches):
        for batch in batches:
            found = np.interp(batch.column(1).to_numpy(), *curve)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "score"])

    scored = _raw(x, fourier, beta, []).mapInArrow(calibrated, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(key % 3 == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _raw(rows: DataFrame, fourier: Fourier, beta: np.ndarray, also: list[str]) -> DataFrame:
    """Ridge scores of ``rows`` (doc_id, x)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column(1).to_numpy(zero_copy_only=False))
                raw = np.concatenate([fourier(x[a : a + 4096]) @ beta for a in range(0, len(x), 4096)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw), *batch.columns[2:]], names=["doc_id", "raw", *also])

    return rows.select("doc_id", "x", *also).mapInArrow(run, ", ".join(["doc_id long, raw double", *(f"{c} double" for c in also)]))
