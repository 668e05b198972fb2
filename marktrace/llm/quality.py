"""Document quality by Bradley-Terry pairwise ranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marktrace.llm.common import discard, frugal, key128, portions, stored, whole_text
from marktrace.operators.ordered import order_rows, running

#: labelled rows of the commoner class that one task fits weights on at once
FIT_ROWS = 2_000
#: rows of the rarer class that a part gets at least, on average
FEW_ROWS = 50
#: scores that one task puts in order
CUT_ROWS = 10_000
PAIR_SLOTS = 2_048
FEATURES = 256 + PAIR_SLOTS + 8
#: bytes at which a text's own features weigh as much as the average of labelled documents
PRIOR_BYTES = 16
#: slot of each pair of neighbouring bytes
_SLOT = ((np.arange(65_536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(53)).astype(np.int64)
_UPPER, _LOWER, _DIGIT = (np.isin(np.arange(256), np.arange(a, b)) for a, b in ((65, 91), (97, 123), (48, 58)))


def features(text: str) -> np.ndarray:
    """Square roots of the shares of bytes and of byte pairs, and how varied words and lines are.

    Computed over the whole text; an empty text has only zeros, so its score is that of an average document.
    """
    out = np.zeros(FEATURES, dtype=np.float32)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(data):
        return out
    single = np.bincount(data, minlength=256)
    out[:256] = np.sqrt(single / len(data))
    if len(data) > 1:
        pairs = np.bincount(_SLOT[data[:-1].astype(np.int64) << 8 | data[1:]], minlength=PAIR_SLOTS)
        out[256 : 256 + PAIR_SLOTS] = np.sqrt(pairs / (len(data) - 1))
    lines = text.split("\n")
    words = text.split()
    letters = single[_UPPER | _LOWER].sum() + single[128:].sum()
    out[256 + PAIR_SLOTS :] = (
        letters / len(data),
        single[_UPPER].sum() / max(letters, 1),
        single[_DIGIT].sum() / len(data),
        len(set(lines)) / len(lines),
        len(set(words)) / max(len(words), 1),
        min(len(data) / max(len(words), 1), 40) / 40,
        min(len(words) / len(lines), 40) / 40,
        min(np.log1p(len(words)), 12) / 12,
    )
    return out


def shrunk(raw: np.ndarray, size: np.ndarray, average: float) -> np.ndarray:
    """Raw scores drawn to the average the fewer bytes a text has; an empty text has the average."""
    return average + (raw - average) * size / (size + PRIOR_BYTES)


NEUTRAL_WEIGHTS = np.zeros(FEATURES)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    #: raw score of an average labelled document
    average: float
    threshold: float
    scale: float
    #: share of the labelled documents below the threshold
    quantile: float
    cut: float

    def score(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        """0 to 1; equals ``cut`` at the threshold."""
        z = (shrunk(x @ self.weights, size, self.average) - self.threshold) / self.scale + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_pairs(good: np.ndarray, bad: np.ndarray, epochs: int = 20, step: float = 0.05, decay: float = 1e-4, seed: int = 7) -> np.ndarray:
    """Bradley-Terry weights: P(good beats bad) = sigmoid(w . (good - bad)), fitted by Adam on drawn pairs."""
    rng = np.random.default_rng(seed)
    w, m, v = (np.zeros(good.shape[1], dtype=np.float64) for _ in range(3))
    turn, batch, pairs = 0, 256, 4 * max(len(good), len(bad))
    for _ in range(epochs):
        for _ in range(-(-pairs // batch)):
            d = good[rng.integers(len(good), size=batch)] - bad[rng.integers(len(bad), size=batch)]
            lost = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
            grad = -(lost @ d) / batch + decay * w
            turn += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            w -= step * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
    return w


def choose_quantile(good: np.ndarray, bad: np.ndarray, share_bad: float, keep: float) -> tuple[float, float]:
    """Threshold and its quantile among labelled documents, both classes weighted as they occur; tests compare ``best_cut`` with it.

    The highest sum of kept good and rejected bad shares wins, among quantiles that keep at least ``keep`` of
    the good ones; within a gap that separates equally well, its middle.
    """
    scores = np.concatenate([good, bad])
    weight = np.r_[np.full(len(good), (1 - share_bad) / len(good)), np.full(len(bad), share_bad / len(bad))]
    order = np.argsort(scores, kind="stable")
    s, below = scores[order], np.cumsum(weight[order])
    lost_good = np.cumsum(order < len(good)) / len(good)
    lost_bad = np.cumsum(order >= len(good)) / len(bad)
    gain = np.where(lost_good <= 1 - keep, lost_bad - lost_good, -np.inf)
    i = int(np.argmax(gain))
    if gain[i] <= 0:
        return float(s[0]) - 1e-6, 0.0
    above = s[min(i + 1, len(s) - 1)]
    return float(s[i] + above) / 2, float(below[i])


def _fit_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights of each part of the labelled rows; rows come sorted, so copies are neighbours and a part is whole."""
    held, part, last = ([], []), None, None

    def done() -> Iterator[pa.RecordBatch]:
        if held[0] and held[1]:
            bad, good = (np.stack(x).astype(np.float64) for x in held)
            columns = [pa.array([len(bad) + len(good)], pa.int64()), pa.array([fit_pairs(good, bad)], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["n", "w"])

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "x", "y", "quality"))))
        for place, texts in portions(batch.column("text")):
            for key, text in zip(keys[place], texts):
                if key[0] != part:
                    yield from done()
                    held, part = ([], []), key[0]
                if key != last:
                    held[key[-1]].append(features(text))
                    last = key
    yield from done()


def _weights(met: DataFrame, rows: dict[int, int], fit_rows: int) -> np.ndarray | None:
    """Mean of the weights of all parts, each weighted by its rows; None if no part has both classes.

    A part has about ``fit_rows`` rows of the commoner class. Rows of the other are dealt to several parts once
    they are fewer than ``FEW_ROWS`` a part. Sums are decimal, so their order does not matter.
    """
    parts = -(-max(rows.values()) // fit_rows)
    copies = {q: min(parts, max(1, -(-parts * min(FEW_ROWS, fit_rows) // n))) for q, n in rows.items()}
    first = F.xxhash64("doc_id", "x", "y")
    turns = F.explode(F.sequence(F.lit(0), F.when(F.col("quality") == 0, copies[0]).otherwise(copies[1]) - 1))
    dealt = met.select(turns.alias("turn"), "doc_id", "x", "y", "quality", "text").withColumn("part", F.pmod(first + F.col("turn"), F.lit(parts)))
    dealt = dealt.drop("turn").repartition(parts, "part").sortWithinPartitions("part", "doc_id", "x", "y", "quality")
    fitted = stored(dealt.mapInArrow(frugal(_fit_parts), "n long, w array<double>"), "quality-weights")
    total = fitted.agg(F.sum("n")).first()[0]
    if not total:
        return None
    slots = fitted.select("n", F.posexplode("w").alias("slot", "w")).groupBy("slot").agg(F.sum((F.col("w") * F.col("n")).cast("decimal(38,15)")).alias("w"))
    found = {r["slot"]: float(r["w"]) for r in slots.collect()}  # as many as there are features
    discard(fitted)
    return np.array([found[i] for i in range(FEATURES)]) / total


def best_cut(points: DataFrame, good: int, bad: int, share_bad: float, keep: float) -> tuple[float, float]:
    """``choose_quantile`` over ``points(s double, quality int)`` on Spark; equal scores are not parted."""
    steps = points.groupBy("s").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
    run = running(order_rows(steps, [], ["s"], rows=CUT_ROWS), sums={"g": F.col("good"), "b": F.col("bad")}).plain()
    lost, gain = F.col("g") / good, F.col("b") / bad - F.col("g") / good
    best = run.where(lost <= 1 - keep).agg(F.max(F.struct(gain.alias("gain"), (-F.col("s")).alias("s"), "g", "b")).alias("top")).first()["top"]
    if best is None or best["gain"] <= 0:
        return points.agg(F.min("s")).first()[0] - 1e-6, 0.0
    at = -best["s"]
    above = points.where(F.col("s") > at).agg(F.min("s")).first()[0]
    return (at + (at if above is None else above)) / 2, (1 - share_bad) * best["g"] / good + share_bad * best["b"] / bad


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, cut: float = 0.3, keep: float = 0.98) -> Model:
    """Model from all labelled rows whose crc32 of the id as text is not divisible by 5.

    Rows are dealt by a hash to parts of about ``fit_rows`` rows of the commoner class. Tasks fit a part's weights
    each, and the model has their mean. Average, scale and threshold come from the scores of all labelled rows. A
    repeated label counts once, and so does a repeated row of one id and text.
    Without both classes every document gets the neutral score of one half.
    """
    neutral = Model(NEUTRAL_WEIGHTS, 0.0, 0.0, 1.0, 0.0, 0.5)
    learnt = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    usable = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(learnt).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    count = {r["quality"]: r["n"] for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not count.get(0) or not count.get(1):
        return neutral
    x, y = key128(F.col("text"))
    texts = docs.where(learnt).select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    met = stored(texts.join(usable.hint("merge"), "doc_id").select("doc_id", "quality", x.alias("x"), y.alias("y"), F.octet_length("text").alias("size"), "text"), "quality-labelled")
    key = ["doc_id", "quality", "x", "y"]
    rows = {r["quality"]: r["n"] for r in met.select(*key).distinct().groupBy("quality").agg(F.count("*").alias("n")).collect()}
    w = _weights(met, rows, fit_rows) if len(rows) == 2 else None
    if w is None:
        return neutral

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # one row after the other: its last digit then does not depend on its neighbours
            raw = [float(features(t).astype(np.float64) @ w) for _, texts in portions(batch.column("text")) for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*key, "size")), pa.array(raw, pa.float64())], names=[*key, "size", "raw"])

    raw = stored(met.mapInArrow(frugal(scored), "doc_id long, quality int, x long, y long, size int, raw double").dropDuplicates(key), "quality-raw")
    discard(met)
    exact = lambda v: F.sum(v.cast("decimal(38,15)"))
    mean = {r["quality"]: float(r["s"]) / rows[r["quality"]] for r in raw.groupBy("quality").agg(exact(F.col("raw")).alias("s")).collect()}
    share = count[0] / (count[0] + count[1])
    average = share * mean[0] + (1 - share) * mean[1]
    points = raw.select("quality", (F.lit(average) + (F.col("raw") - average) * F.col("size") / (F.col("size") + PRIOR_BYTES)).alias("s"))
    off = F.col("s") - average
    first, second = (float(v) / sum(rows.values()) for v in points.agg(exact(off), exact(off * off)).first())
    threshold, quantile = best_cut(points, rows[1], rows[0], share, keep)
    discard(raw)
    return Model(w, average, threshold, max(max(second - first * first, 0.0) ** 0.5, 1e-6) / 4, quantile, cut)


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """All columns of ``docs`` plus ``held_out, score, predicted``; ``predicted`` is 1 from ``cut`` on.

    Only the text is looked at; the columns pass through the scoring task as they are, so nothing is joined
    back. A null text counts as empty; a null id is not held out. Repeated rows get the same score. A label of
    another value than 0 or 1, or without document, is not used. Input columns named like a result are replaced.
    """
    model = fit(docs, labels, fit_rows, cut)
    base = docs.drop("held_out", "score", "predicted")
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in base.schema.fields), T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.zeros(0)]
            for _, texts in portions(batch.column("text")):
                size = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts])
                got.append(model.score(np.stack([features(t) for t in texts]).astype(np.float64), size))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(got))], names=schema.names)

    scored = base.mapInArrow(frugal(score), schema)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.withColumns({"held_out": held, "predicted": (F.col("score") >= cut).cast("int")})
