"""Substring dedup: sliding spans of consecutive sentences.

Every run of several consecutive sentences is hashed, the hashes are joined over all
texts, and the sentences that any but the first occurrence of a run covers are removed.
Where sentences are long they are cut at words that a small window picks by their own
hash, so that equal passages are cut alike whatever stands before and after them."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm.scratch import stash
from voxloom.llm.textcols import BASE, LOWER, mix64, utf8, word_hashes, words

#: A run has at least so many words.
RUN_WORDS = 24
#: In every so many consecutive words there is a cut, so that a run has three sentences or more, and every
#: passage of RUN_WORDS + 3 * CUT_WINDOW - 2 = 49 words holds a run that depends on the passage alone.
CUT_WINDOW = 9
SLICE_BYTES = 2 << 20

_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_CLOSING = np.zeros(256, bool)
_CLOSING[[ord(c) for c in "\"')]"]] = True


def _word_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A 64-bit key of each word: the first half of the MD5 digest of its bytes, A-Z lowered."""
    _, at, which = np.unique(hashes, return_index=True, return_inverse=True)
    low = LOWER[data].tobytes()
    digests = b"".join([hashlib.md5(low[a:b]).digest()[:8] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
    return np.frombuffer(digests, ">u8").astype(np.uint64)[which]


def _sliding(x: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """Minimum or maximum of each ``size`` consecutive values, in a few steps of doubled width."""
    width = 1
    while 2 * width <= size:
        x = pick(x[:-width], x[width:])
        width *= 2
    return pick(x[: len(x) - (size - width)], x[size - width :]) if size > width else x


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(word starts, word ends, first word of each sentence, first sentence of each row, word hashes).

    A sentence ends with a word that ends in ``.``, ``!`` or ``?`` (a closing quote or
    bracket may follow). Of every CUT_WINDOW consecutive words of a row without such a word,
    those of the lowest key end one too."""
    start, end, first = words(data, offsets)
    n = len(start)
    if not n:
        return start, end, np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64)
    hashes = word_hashes(data, start, end)
    last = data[end - 1]
    before = np.where(end - start > 1, data[np.maximum(end - 2, 0)], 0)
    stops = _STOP[last] | (_CLOSING[last] & _STOP[before])
    keys = _word_keys(data, start, end, hashes)
    keys[stops] = 0
    if n >= CUT_WINDOW:
        least = _sliding(keys, CUT_WINDOW, np.minimum)
        # windows that reach into the next row count for nothing
        row_end = np.repeat(first[1:], np.diff(first))
        least[np.arange(len(least)) + CUT_WINDOW > row_end[: len(least)]] = 0
        around = np.concatenate([np.zeros(CUT_WINDOW - 1, np.uint64), least, np.zeros(CUT_WINDOW - 1, np.uint64)])
        stops |= (_sliding(around, CUT_WINDOW, np.maximum) == keys) & (keys > 0)
    opens = np.zeros(n, bool)
    opens[1:] = stops[:-1]
    opens[first[:-1][first[:-1] < n]] = True
    heads = np.flatnonzero(opens)
    return start, end, heads, np.searchsorted(heads, first), hashes


def _ends(heads: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sentences that begin a run, its last sentence): the shortest run that is long enough."""
    tails = np.append(heads[1:], n)  # word after the sentence
    row = np.searchsorted(first, np.arange(len(heads)), "right") - 1
    ahead = np.searchsorted(tails, heads + RUN_WORDS)
    begin = np.flatnonzero(ahead < first[row + 1])
    return begin, ahead[begin]


def runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first sentence, hash) of the runs of sentences of a column of texts: from each sentence
    the shortest run that begins with it and is long enough.

    Of a repeated passage all sentences lie in such runs but for those within CUT_WINDOW words of
    its start and three times as many of its end, where cuts may depend on what surrounds it."""
    data, offsets = utf8(column)
    start, end, heads, first, hashes = sentences(data, offsets)
    if not len(heads):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    a, b = _ends(heads, first, len(start))
    row = np.searchsorted(first, a, "right") - 1
    power = np.full(len(hashes) + 1, BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    inverse = np.full(len(hashes) + 1, np.uint64(pow(int(BASE), -1, 1 << 64)), np.uint64)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[:-1])])
    lo, hi = heads[a], np.append(heads[1:], len(start))[b]
    value = mix64((total[hi] - total[lo]) * inverse[lo] + (hi - lo).astype(np.uint64))
    return row, a - first[row], value


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows in slices of about SLICE_BYTES of text."""
    _, offsets = utf8(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield at, end
        at = end


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, end in _slices(batch.column(2)):
            row, first, value = runs(batch.column(2).slice(at, end - at))
            pick = pa.array(row + at)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), batch.column(0).take(pick), batch.column(1).take(pick), pa.array(first.astype(np.int32))], ["run", "id", "body", "first"])


def without(column: pa.Array, begins: pa.Array) -> list[tuple[str | None, int]]:
    """Texts without the sentences that the runs which begin at ``begins`` (numbers of sentences) cover, and how
    many these are; (null, 0) where either is null."""
    data, offsets = utf8(column)
    start, _, heads, first, _ = sentences(data, offsets)
    begin, last = _ends(heads, first, len(start)) if len(heads) else (np.zeros(0, np.int64),) * 2
    end_of = np.zeros(len(heads) + 1, np.int64)
    end_of[begin] = last
    out: list[tuple[str | None, int]] = []
    for i, spans in enumerate(begins):
        if not spans.is_valid or not column[i].is_valid:
            out.append((None, 0))
            continue
        a, b = first[i], first[i + 1]
        at = spans.values.to_numpy() + a
        step = np.zeros(b - a + 1, np.int64)
        np.add.at(step, at - a, 1)
        np.add.at(step, end_of[at] + 1 - a, -1)
        kept = np.cumsum(step[:-1]) == 0
        edges = np.append(start[heads[a:b]], offsets[i + 1])
        keep = np.zeros(offsets[i + 1] - offsets[i], np.int8)
        keep[: edges[0] - offsets[i]] = 1
        keep[edges[0] - offsets[i] :] = np.repeat(kept, np.diff(edges))
        text = data[offsets[i] : offsets[i + 1]][keep.astype(bool)].tobytes().decode("utf-8", "surrogatepass")
        out.append((text.rstrip(), int((~kept).sum())))
    return out


_CUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType())])


@F.arrow_udf(_CUT)
def _cut(text: pa.Array, begins: pa.Array) -> pa.Array:
    done = [x for at, end in _slices(text) for x in without(text.slice(at, end - at), begins.slice(at, end - at))]
    return pa.StructArray.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int32())], ["text", "n"])


def remove_repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_removed") -> DataFrame:
    """Removes from every text the sentences that lie in a repeated run, except the run's first occurrence.

    The first occurrence is the one with the smallest id, then the smallest hash of the text,
    then the earliest in its text (nulls come first). Words are compared with A-Z lowered
    and white space, line ends too, ignored. All columns return, with the text cut and
    ``count_col`` added: the number of sentences removed. Text between sentences goes with
    the sentence before; a text that lost sentences has no white space at its end; if it
    lost all, it is empty.

    Null and empty texts, and texts shorter than a run, stay as they are. Rows repeated
    with one id and text (told apart by a 32-bit hash) are one document and are treated alike. Columns may have any names
    but ``count_col``; one of that name is replaced. Runs are told apart by 64-bit hashes:
    among n different runs, about n * n / 2 ** 65 pairs share one by chance (10 ** 9 runs: 0.03)."""
    own = uuid.uuid4().hex  # names that no column of df has
    me, text_hash, spans, cut = (f"{x}_{own}" for x in ("id", "hash", "spans", "cut"))
    body = F.hash(F.col(text_col).cast("string"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), body.alias("body"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = rows.mapInArrow(_run_rows, "run long, id long, body int, first int")  # made twice: cheaper than to store
    place = F.struct("id", "body", "first")
    firsts = found.groupBy("run").agg(F.min(place).alias("home"), F.count(F.lit(1)).alias("n")).where("n > 1").select("run", "home")
    firsts = stash(firsts, "repeated-runs")
    again = found.join(firsts, "run").where(place != F.col("home"))
    covered = again.groupBy(F.col("id").alias(me), F.col("body").alias(text_hash)).agg(F.collect_set("first").alias(spans))
    kept = df.drop(count_col)
    joined = kept.withColumn(f"own_{own}", body).join(covered, F.col(id_col).cast("long").eqNullSafe(F.col(me)) & (F.col(f"own_{own}") == F.col(text_hash)), "left")
    hit = F.col(spans).isNotNull()
    joined = joined.withColumn(cut, _cut(F.when(hit, F.col(text_col).cast("string")), F.col(spans)))
    out = [F.when(hit, F.col(f"{cut}.text")).otherwise(F.col(c)).alias(c) if c == text_col else F.col(f"`{c}`") for c in kept.columns]
    return joined.select(*out, F.when(hit, F.col(f"{cut}.n")).otherwise(F.lit(0)).cast("long").alias(count_col))
