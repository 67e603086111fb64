"""Packing: mixture-controlled, by deficit round-robin over source queues.

Every source is a queue of tokens. Service goes in quanta: each queue earns credit
in proportion to its target weight, and the queue whose next quantum is most overdue
is served. For fixed weights that schedule has a closed form: quantum j of queue s
is due at (2j + 1) / w_s, and what was served before it, the deficits carried from
all earlier windows, follows from counting the quanta of each queue that are due
sooner. So each task places its own documents without seeing the others' windows.
Of very many queues, whose state is too much for each task, the quanta are sorted by
when they are due: the same schedule, read off running sums."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.llm.scratch import stash

#: Weights are whole numbers up to this, which keeps the schedule's arithmetic exact in 64 bits.
WEIGHT_UNIT = 1 << 20
#: Of so many queues each task gets sizes and weights, and the closed form is used; with more, quanta are sorted instead.
CLOSED_FORM_QUEUES = 1024
#: Rows of per-task queue offsets that may be broadcast (about 32 bytes each); above, they are joined by a shuffle.
BROADCAST_ROWS = 200_000
_BATCH_TOKENS = 1 << 20


@lru_cache(maxsize=4)
def load_encoder(path: str, special_as_text: bool = False) -> Callable[[str], np.ndarray]:
    """A function from text to token ids (uint32) for a tokenizers file.

    The ids are those of the tokenizers library without added special tokens: the string of
    a special token in a text is that token, unless ``special_as_text``. A byte-level BPE
    whose ids are in merge order is run by tiktoken, which gives the same ids several times
    as fast; any other file by the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    vocab = model.get("vocab")
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model.get("merges", [])]
    ordered = isinstance(vocab, dict) and [vocab.get("".join(m), -1) for m in merges]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
    added = spec.get("added_tokens", [])
    plain = plain and all(x.get("special") and not (x.get("lstrip") or x.get("rstrip") or x.get("single_word")) for x in added)
    if model.get("type") == "BPE" and plain and merges and all(a < b for a, b in zip(ordered, ordered[1:])) and not model.get("ignore_merges"):
        import tiktoken

        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in visible]
        byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = {} if special_as_text else {x["content"]: x["id"] for x in added}
        names = {x["content"] for x in added}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in names}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        encoding = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        return lambda text: encoding.encode_to_numpy(text, allowed_special="all", disallowed_special=()) if text else np.zeros(0, np.uint32)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = special_as_text
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def tokenize(df: DataFrame, path: str, id_col: str, text_col: str, queue_col: str | None, end_id: int = 0, special_as_text: bool = False) -> DataFrame:
    """Token ids of every whole text (null: empty), ``end_id`` appended: id, queue, part,
    start (tokens of the queue before it in this part), tokens, ids (32-bit little-endian)."""
    queue = F.col(queue_col).cast("string") if queue_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("id"), queue.alias("queue"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, done = load_encoder(path, special_as_text), TaskContext.get().partitionId(), {}

        def flush() -> pa.RecordBatch:
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
            names = ["id", "queue", "start", "tokens", "ids"]
            return pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(out), pa.int64())], [*names, "part"])

        out, size = [], 0
        for batch in batches:
            ids, queues, texts = (batch.column(i) for i in range(3))
            for i, q, text in zip(ids, queues, texts, strict=True):
                i, q = i.as_py(), q.as_py()
                tokens = np.append(encode(text.as_py()), np.uint32(end_id))
                out.append((i, q, done.get(q, 0), len(tokens), tokens.astype("<u4").tobytes()))
                done[q] = done.get(q, 0) + len(tokens)
                size += len(tokens)
                if size >= _BATCH_TOKENS:
                    yield flush()
                    out, size = [], 0
        if out:
            yield flush()

    return rows.mapInArrow(run, "id long, queue string, start long, tokens long, ids binary, part long")


class Schedule:
    """Where each token of each queue goes: ``sizes`` and ``weights`` by queue number."""

    def __init__(self, sizes: np.ndarray, weights: np.ndarray, quantum: int):
        self.sizes, self.weights, self.quantum = sizes.astype(np.int64), weights.astype(np.int64), quantum

    def position(self, queue: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Tokens served before quantum ``j`` of ``queue``, arrays of equal length."""
        total = np.zeros(len(j), np.int64)
        own = self.weights[queue]
        for other, (size, weight) in enumerate(zip(self.sizes.tolist(), self.weights.tolist(), strict=True)):
            due = (2 * j + 1) * weight
            # odd numbers m with m * own < due, or equal where the other queue comes first
            most = np.where(other < queue, due // own, (due + own - 1) // own - 1)
            total += np.minimum(np.where(queue == other, j, (most + 1) // 2) * self.quantum, size)
        return total


def pieces(start: np.ndarray, length: np.ndarray, quantum: int, window: int, places: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, ...]:
    """(row, start in row, length, position) of the pieces of rows that lie at ``start`` in their queues.

    ``places(row, j)`` are the tokens served before quantum ``j`` of the row's queue, rows in
    order and the quanta that a row meets in order."""
    first, last = start // quantum, (start + length - 1) // quantum
    n = last - first + 1
    row = np.repeat(np.arange(len(n)), n)
    j = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    begin = np.maximum(j * quantum, start[row])
    end = np.minimum((j + 1) * quantum, (start + length)[row])
    at = places(row, j) + begin - j * quantum
    size = end - begin
    follows = np.zeros(len(row), bool)
    follows[1:] = (row[1:] == row[:-1]) & (at[1:] == at[:-1] + size[:-1])
    heads = np.flatnonzero(~follows)
    size = np.add.reduceat(size, heads) if len(heads) else size
    row, begin, at = row[heads], (begin - start[row])[heads], at[heads]
    cuts = (at + size - 1) // window - at // window + 1
    piece = np.repeat(np.arange(len(cuts)), cuts)
    k = np.arange(len(piece)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    lo = np.maximum(at[piece], (at[piece] // window + k) * window)
    hi = np.minimum((at + size)[piece], (at[piece] // window + k + 1) * window)
    return row[piece], begin[piece] + lo - at[piece], hi - lo, lo


def _weights(share: np.ndarray) -> np.ndarray:
    return np.maximum(1, np.rint(share / max(share.sum(), 1e-300) * WEIGHT_UNIT)).astype(np.int64)


def _targets_table(spark: SparkSession, targets: Mapping[str | None, float]) -> DataFrame:
    return spark.createDataFrame([(q, float(t)) for q, t in targets.items()], "target_queue string, target double")


def _sorted_quanta(rows: DataFrame, sizes: DataFrame, targets: Mapping[str | None, float] | None, quantum: int) -> DataFrame:
    """queue, j, place for every quantum: the tokens served before it, by sorting all quanta by when they
    are due. ``rows``: queue, start, tokens; ``sizes``: queue, size. A quantum belongs to the row it begins in."""
    spark = rows.sparkSession
    whole = sizes.agg(F.sum("size").alias("whole"))  # a single row
    shares = sizes.crossJoin(F.broadcast(whole)).withColumn("share", F.col("size") / F.col("whole"))
    if targets:
        shares = shares.join(F.broadcast(_targets_table(spark, targets)), F.col("queue").eqNullSafe(F.col("target_queue")), "left").withColumn("share", F.coalesce("target", "share"))
    shares = stash(shares.select(F.col("queue").alias("own"), "size", "share"), "queue-shares")
    unit = shares.agg(F.sum("share").alias("shares"))
    shares = shares.crossJoin(F.broadcast(unit)).select("own", "size", F.greatest(F.lit(1), F.rint(F.col("share") / F.greatest("shares", F.lit(1e-300)) * WEIGHT_UNIT)).alias("weight"))
    q = F.lit(quantum)
    first, last = F.ceil(F.col("start") / q), F.floor((F.col("start") + F.col("tokens") - 1) / q)
    quanta = rows.select("queue", first.alias("first"), last.alias("last")).where("first <= last").select("queue", F.explode(F.sequence("first", "last")).alias("j"))
    quanta = quanta.join(shares, F.col("queue").eqNullSafe(F.col("own")))
    quanta = quanta.select("queue", "j", ((2 * F.col("j") + 1) / F.col("weight")).alias("due"), F.least(q, F.col("size") - F.col("j") * q).cast("long").alias("length"))
    ranked = stash(quanta.repartitionByRange("due", "queue").select("*", F.spark_partition_id().alias("slice")), "quanta")
    sums = ranked.groupBy("slice").agg(F.sum("length").alias("total"))  # a row for each partition
    bases = sums.select(F.col("slice").alias("at"), F.coalesce(F.sum("total").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    before = Window.partitionBy("slice").orderBy("due", "queue").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranked.withColumn("within", F.coalesce(F.sum("length").over(before), F.lit(0))).join(F.broadcast(bases), F.col("slice") == F.col("at"))
    return placed.select("queue", "j", (F.col("base") + F.col("within")).alias("place"))


def pack(
    df: DataFrame,
    tokenizer_path: str,
    window: int = 1024,
    quantum: int = 128,
    targets: Mapping[str | None, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    queue_col: str | None = "source",
    end_id: int = 0,
    special_as_text: bool = False,
) -> DataFrame:
    """Packs all rows into sequences of ``window`` tokens; only the last one is padded.

    ``targets`` are the wanted token shares by source; by default each source's share
    of all tokens, so that all queues end together. A source without a target, the null
    source among them, takes its natural share. A queue that has run empty leaves its
    turns to the others, and every token is placed exactly once. There may be any number
    of sources; each is a queue of its own.

    Returns per piece: ``id_col``, start, length, ids_crc32 (of the ids as unsigned
    little-endian 32-bit numbers), doc_tokens, sequence_id, offset and queue. An empty
    or null text is the end id alone; repeated rows are packed each; an empty table gives
    no pieces. Only the columns named are read. Which place in its queue a document has
    depends on how the input is partitioned."""
    rows = stash(tokenize(df, tokenizer_path, id_col, text_col, queue_col, end_id, special_as_text), "tokens")
    parts = rows.groupBy("queue", "part").agg(F.sum("tokens").alias("tokens"))
    parts = stash(parts, "queue-parts")
    sizes = parts.groupBy("queue").agg(F.sum("tokens").alias("size"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(F.col("queue").alias("base_queue"), F.col("part").alias("base_part"), F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    if parts.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    rows = rows.join(bases, (rows["part"] == bases["base_part"]) & rows["queue"].eqNullSafe(bases["base_queue"]))
    rows = rows.select("id", "queue", (F.col("base") + F.col("start")).alias("start"), "tokens", "ids")
    few = sizes.limit(CLOSED_FORM_QUEUES + 1).collect()
    schedule, number = None, {}
    if len(few) <= CLOSED_FORM_QUEUES:
        totals = sorted(((r["queue"], r["size"]) for r in few), key=lambda r: (r[0] is not None, r[0] or ""))
        share = np.array([r[1] for r in totals], np.float64)
        share /= max(1, share.sum())
        if targets:
            share = np.array([targets.get(r[0], s) for r, s in zip(totals, share, strict=True)])
        schedule, number = Schedule(np.array([r[1] for r in totals], np.int64), _weights(share), quantum), {r[0]: i for i, r in enumerate(totals)}
        rows = rows.withColumn("places", F.lit(None).cast("array<long>"))
    else:
        # each document and the places of the quanta that it meets, in their order
        rows = stash(rows.withColumn("row", F.monotonically_increasing_id()), "queued")
        places = _sorted_quanta(rows.select("queue", "start", "tokens"), sizes, targets, quantum)
        first, last = F.floor(F.col("start") / quantum), F.floor((F.col("start") + F.col("tokens") - 1) / quantum)
        met = rows.select("row", F.col("queue").alias("own"), F.explode(F.sequence(first, last)).alias("own_j"))
        met = met.join(places, F.col("own").eqNullSafe(F.col("queue")) & (F.col("own_j") == F.col("j")))
        met = met.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "place"))), lambda x: x["place"]).alias("places"))
        rows = rows.join(met, "row").select("id", "queue", "start", "tokens", "ids", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, queues, blobs = batch.column(0), batch.column(1), batch.column(4)
            start, tokens = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            if schedule is not None:
                queue = np.array([number[q] for q in queues.to_pylist()], np.int64)
                found = pieces(start, tokens, quantum, window, lambda row, j: schedule.position(queue[row], j))
            else:
                places = batch.column(5).flatten().to_numpy()
                found = pieces(start, tokens, quantum, window, lambda row, j: places)
            row, begin, length, at = found
            view = memoryview(b"".join(x.as_buffer() for x in blobs))
            place = (np.cumsum(tokens) - tokens)[row] + begin
            crc = [zlib.crc32(view[a:b]) for a, b in zip((4 * place).tolist(), (4 * (place + length)).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(row)), pa.array(begin), pa.array(length), pa.array(crc, pa.int64()), pa.array(tokens[row]), pa.array(at // window), pa.array(at % window), queues.take(pa.array(row))],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"],
            )

    out = rows.mapInArrow(run, "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string")
    return out.withColumnRenamed("id", id_col)
