"""Language ID: averaged hashed subword embeddings with a linear softmax.

The model is trained by stochastic gradient descent in numpy on a bounded sample
of labelled rows; prediction runs over whole texts in Arrow batches. After
training, embeddings and softmax weights fold into one table of class scores per
subword bucket, so that a text costs one gather and one sum per subword."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm.textcols import LOWER, mix64, utf8

#: Texts are scored in slices of about so many bytes, which bounds the memory of a task.
SLICE_BYTES = 1 << 20
#: So many rows of each label are aimed at, however rare it is.
LEAST_ROWS = 50
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """``train_rows`` and ``train_bytes`` bound the sample that the driver sees: about so many
    rows (never more than twice that), of texts of at most so many bytes."""

    train_rows: int = 3000
    train_bytes: int = 20_000
    orders: tuple[int, ...] = (2, 3, 4)
    buckets: int = 1 << 16
    dimension: int = 16
    epochs: int = 4
    rate: float = 4.0
    calibration_share: float = 0.2
    max_false_reject: float = 0.001
    seed: int = 7


def subword_buckets(data: np.ndarray, offsets: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """For each byte, the bucket of the ``order`` bytes that start there; ``buckets`` where the row ends before."""
    n = len(data)
    low = LOWER[data].astype(np.uint64)
    code = np.zeros(n, np.uint64)
    for i in range(order):
        code[: n - i] = (code[: n - i] << np.uint64(8)) | low[i:] if n > i else 0
    out = (mix64(code + np.uint64(order << 40)) & np.uint64(buckets - 1)).astype(np.int32)
    for i in range(1, order):
        at = offsets[1:] - i
        out[at[at >= offsets[:-1]]] = buckets
    return out


class LanguageModel:
    """``table`` (buckets + 1, classes): class scores of each subword; its last row is zero."""

    def __init__(self, labels: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, reject_below: float, settings: Settings):
        self.labels, self.table, self.bias = labels, table, bias
        self.temperature, self.reject_below, self.settings = temperature, reject_below, settings

    def logits(self, column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), len(self.labels)))
        data, offsets = utf8(column)
        row = 0
        while row < len(column):
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
            part = offsets[row : end + 1] - offsets[row]
            chunk = data[offsets[row] : offsets[end]]
            sums = np.zeros((end - row, len(self.labels)))
            counts = np.zeros(end - row, np.int64)
            sizes = np.diff(part)
            full = np.flatnonzero(sizes)
            for order in self.settings.orders:
                counts += np.maximum(sizes - order + 1, 0)
                if len(full):
                    scores = self.table[subword_buckets(chunk, part, order, self.settings.buckets)]
                    sums[full] += np.add.reduceat(scores, part[full], axis=0, dtype=np.float64)
            out[row:end] = sums / np.maximum(counts, 1)[:, None]
            row = end
        return out + self.bias

    def probabilities(self, column: pa.Array) -> np.ndarray:
        return softmax(self.logits(column) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], settings: Settings | None = None) -> LanguageModel | None:
    """Fits the model; None without rows. Part of the rows sets the temperature and the rejection threshold."""
    s = settings or Settings()
    if not texts:
        return None
    labels = sorted(set(langs))
    target = np.array([labels.index(x) for x in langs])
    random = np.random.default_rng(s.seed)
    embed = random.normal(0, 1 / s.dimension, (s.buckets + 1, s.dimension))
    embed[-1] = 0
    weights, bias = np.zeros((s.dimension, len(labels))), np.zeros(len(labels))
    weights += random.normal(0, 1 / s.dimension, weights.shape)
    rows = []
    for text in texts:
        data, offsets = utf8(pa.array([text], pa.string()))
        found = np.concatenate([subword_buckets(data, offsets, o, s.buckets) for o in s.orders])
        ids, counts = np.unique(found[found < s.buckets], return_counts=True)
        rows.append((ids, counts / max(1, counts.sum())))
    order = random.permutation(len(texts))
    held = order[: int(len(order) * s.calibration_share)]
    fit = order[len(held) :]
    lost = ~np.isin(target[held], target[fit])  # every label is learned
    fit, held = np.append(fit, held[lost]), held[~lost]
    steps = s.epochs * len(fit)
    for step in range(steps):
        if step % len(fit) == 0:
            random.shuffle(fit)
        i = fit[step % len(fit)]
        ids, share = rows[i]
        rate = s.rate * (1 - step / steps)
        hidden = share @ embed[ids]
        error = softmax((hidden @ weights + bias)[None])[0]
        error[target[i]] -= 1
        back = weights @ error
        weights -= rate * np.outer(hidden, error)
        bias -= 0.01 * rate * error
        embed[ids] -= rate * np.outer(share, back)
    table = (embed @ weights).astype(np.float32)
    table[-1] = 0
    model = LanguageModel(labels, table, bias, 1.0, 0.0, s)
    check = held if len(held) >= 20 else order
    logits = model.logits(pa.array([texts[i] for i in check], pa.string()))
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(softmax(logits / t)[np.arange(len(check)), target[check]] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    top = np.sort(softmax(logits / model.temperature).max(axis=1))
    # the largest threshold that rejects no more than the allowed share of known rows, with a margin below it
    model.reject_below = float(min(0.5, 0.8 * top[int(s.max_false_reject * len(top))]))
    return model


def train_on(df: DataFrame, id_col: str, text_col: str, lang_col: str, usable: Column, settings: Settings | None = None) -> LanguageModel | None:
    """Trains on the rows that are ``usable`` and have a text and a label.

    The sample is drawn by a hash of the id, so that it doesn't depend on partitions. All
    labels are drawn at one rate that gives ``Settings.train_rows`` rows, but LEAST_ROWS of
    each are aimed at (fewer if those of all labels exceed half of ``train_rows``; all rows
    of a label that has no more). Of a text of over ``Settings.train_bytes``, so many bytes
    from its first letter on are learned."""
    s = settings or Settings()
    text, lang = F.col(text_col).cast("string"), F.col(lang_col).cast("string")
    known = df.where(usable & lang.isNotNull() & text.isNotNull() & text.rlike(r"\p{L}"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy(lang.alias("lang")).count().collect()}
    if not sizes:
        return None
    least = max(1, min(LEAST_ROWS, s.train_rows // (2 * len(sizes))))
    rate = s.train_rows / sum(sizes.values())
    ceilings = [(label, int(min(1.0, max(rate, least / n)) * (1 << 40))) for label, n in sorted(sizes.items())]
    ceilings = F.broadcast(df.sparkSession.createDataFrame(ceilings, "label string, ceiling long"))
    drawn = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 40)) < F.col("ceiling")
    rows = known.select(F.col(id_col).alias("id"), text.alias("text"), lang.alias("lang")).join(ceilings, F.col("lang") == F.col("label")).where(drawn)
    excerpt = F.substring(F.regexp_replace("text", r"^\P{L}++", ""), 1, s.train_bytes)
    rows = rows.select("id", F.when(F.octet_length("text") > s.train_bytes, excerpt).otherwise(F.col("text")).alias("text"), "lang").limit(2 * s.train_rows).toArrow()
    texts = [t.encode("utf-8")[: s.train_bytes].decode("utf-8", "ignore") for t in rows["text"].to_pylist()]
    rows = sorted(zip(rows["id"].to_pylist(), texts, rows["lang"].to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
    return train([r[1] for r in rows], [r[2] for r in rows], s)


def predict(spark: SparkSession, model: LanguageModel | None, text: Column) -> Column:
    """struct(lang string, score double, rejected boolean) for a text.

    A text that is null or has no letter is ``und`` with score 0 and rejected, and so
    is every text when nothing could be learned. Of equal scores the label that comes
    first in the alphabet wins. Labelled texts keep their label when rejected: their
    score is below the calibrated threshold."""
    text = text.cast("string")
    lettered = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    nothing = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    if model is None:
        return nothing
    shared = spark.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    @F.arrow_udf(kind)
    def scored(column: pa.Array) -> pa.Array:
        found = shared.value
        p = found.probabilities(column)
        best = p.argmax(axis=1) if len(p) else np.zeros(0, np.int64)
        score = np.minimum(p.max(axis=1), 1.0) if len(p) else np.zeros(0)
        lang = pa.array(found.labels, pa.string()).take(pa.array(best))
        return pa.StructArray.from_arrays([lang, pa.array(score), pa.array(score < found.reject_below)], ["lang", "score", "rejected"])

    return F.when(lettered, scored(text)).otherwise(nothing)


def held_out(id_column: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings | None = None) -> DataFrame:
    """Trains on the rows that aren't held out and predicts every row.

    Returns ``id_col``, held_out, lang_pred, score and rejected, one row per input row
    (repeated rows repeat). Other columns are never read."""
    model = train_on(df, id_col, text_col, lang_col, ~held_out(F.col(id_col)), settings)
    found = df.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), predict(df.sparkSession, model, F.col(text_col)).alias("found"))
    return found.select(id_col, "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.col("found.rejected").alias("rejected"))
