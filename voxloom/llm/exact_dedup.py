"""Exact dedup: a log-structured merge index of text digests, in DataFrame operations only.

Level 0 holds sorted runs of (digest, id), one per task's memtable, written with
Parquet bloom filters on the digest. Compaction merges all runs into one sorted
run with one entry per digest: the identifier that stays and the number of rows.
Digests with more than one row are hits; a bitmap filter, sized by their number,
picks the texts that can belong to a hit, and only these are shuffled to be compared
byte by byte with the text that stays. Later flushes are merged with the run that the
last compaction left, and single digests are looked up through the Parquet filters."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.scratch import new_folder, stash

#: The filter consists of bitmaps of 32,768 bits (4 KB), enough for FILTER_BITS bits a hit, but no more than
#: MOST_PAGES (64 MB). Beyond 67 million hits it passes more and more other texts, which costs their shuffle only.
MOST_PAGES = 16384
FILTER_BITS = 8
_PAGE_BITS = 32768


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    pure = F.octet_length(text) == F.char_length(text)
    return F.when(pure, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _bits(digest: Column, pages: int) -> tuple[Column, Column]:
    """Page and bit of a digest in a filter of so many pages, from its first fourteen hex digits."""
    number = F.conv(F.substring(digest, 1, 14), 16, 10).cast("long")
    return (number % pages).cast("int"), (F.call_function("div", number, F.lit(pages)) % _PAGE_BITS).cast("long")


class DigestIndex:
    """A log-structured merge index of digests in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None, keep: str = "min"):
        """``keep``: whether the smallest ("min") or the largest ("max") identifier of equal texts stays."""
        if keep not in ("min", "max"):
            raise ValueError("keep must be min or max")
        self.spark, self.keep, self.folder = spark, keep, folder or new_folder(spark, "digests")
        self._schema = "digest string, id long, n long"
        self._flushes = self._merges = self._merged = 0

    def flush(self, rows: DataFrame) -> None:
        """Adds (digest, id) rows as level-0 runs: each task sorts its memtable and writes it; nothing is shuffled."""
        (
            rows.select("digest", F.col("id").cast("long").alias("id"), F.lit(1).cast("long").alias("n"))
            .sortWithinPartitions("digest", "id")
            .write.option("parquet.bloom.filter.enabled#digest", "true")
            .option("parquet.bloom.filter.adaptive.enabled", "true")
            .parquet(f"{self.folder}/level0-{self._flushes}")
        )
        self._flushes += 1

    def runs(self) -> DataFrame:
        """All level-0 entries: one for each row that was ever flushed."""
        paths = [f"{self.folder}/level0-{i}" for i in range(self._flushes)]
        return self.spark.read.schema(self._schema).parquet(*paths)

    def _pending(self) -> list[str]:
        """The last compacted run, and the level-0 runs flushed since."""
        last = [f"{self.folder}/level1-{self._merges - 1}"] if self._merges else []
        return last + [f"{self.folder}/level0-{i}" for i in range(self._merged, self._flushes)]

    def compact(self) -> DataFrame:
        """Merges the last compacted run and all runs flushed since into one sorted run: digest,
        id (the one that stays), n (its rows).

        Null identifiers lose to all others. Map-side aggregation leaves at most one
        entry per task of a digest, however many rows share it."""
        best = F.min("id") if self.keep == "min" else F.max("id")
        path = f"{self.folder}/level1-{self._merges}"
        merged = self.spark.read.schema(self._schema).parquet(*self._pending()).groupBy("digest").agg(best.alias("id"), F.sum("n").alias("n"))
        merged.sortWithinPartitions("digest").write.option("parquet.bloom.filter.enabled#digest", "true").option(
            "parquet.bloom.filter.adaptive.enabled", "true"
        ).parquet(path)
        self._merges, self._merged = self._merges + 1, self._flushes
        return self.spark.read.schema(self._schema).parquet(path)

    def lookup(self, digests: Sequence[str]) -> DataFrame:
        """Entries (digest, id, n) of a few digests, compacted or not: the filters of the runs and
        their order let Parquet skip whatever holds none of them."""
        return self.spark.read.schema(self._schema).parquet(*self._pending()).where(F.col("digest").isin(list(digests)))

    @staticmethod
    def filter_pages(hits: int) -> int:
        return min(MOST_PAGES, 1 << (max(1, hits * FILTER_BITS // _PAGE_BITS) - 1).bit_length())

    @staticmethod
    def hit_filter(hits: DataFrame, pages: int) -> DataFrame:
        """page, bits: a filter of at most ``pages`` rows of 4 KB that passes every digest of ``hits``."""
        page, bit = _bits(F.col("digest"), pages)
        return hits.select(page.alias("page"), bit.alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))

    @staticmethod
    def may_hit(rows: DataFrame, bits: DataFrame, pages: int) -> DataFrame:
        """The rows whose digest passes the filter; a few others pass by chance."""
        page, bit = _bits(F.col("digest"), pages)
        rows = rows.withColumns({"page": page, "bit": bit})
        byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
        passes = F.expr("(shiftright(byte, cast(bit % 8 as int)) & 1) = 1")
        # at most MOST_PAGES rows of 4 KB: broadcasting them is bounded by 64 MB
        return rows.join(F.broadcast(bits), "page").withColumn("byte", byte).where(passes).drop("page", "bit", "bits", "byte")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """Groups rows whose texts are equal after lower-casing A-Z (null counts as empty).

    Returns one row per input row: ``id_col``, keep_id (the smallest or largest id of
    the group, as ``keep`` says), group_size, kept (whether the row has keep_id) and
    text_sha256 (lower-case hex of the normalised text). Rows repeated with one id are
    counted in group_size and share the value of kept; a null id never outlives a
    non-null one. Texts that share a digest but not their bytes would each stay alone.
    Only the two columns named are read; an empty table gives an empty result."""
    spark = df.sparkSession
    text = ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.sha2(text, 256).alias("digest"))
    index = DigestIndex(spark, keep=keep)
    index.flush(rows)
    merged = index.compact()
    hits = merged.where("n > 1")
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.sha2(text, 256).alias("digest"), text.alias("body"))
    pages = index.filter_pages(hits.count())
    texts = stash(index.may_hit(texts, index.hit_filter(hits, pages), pages), "hit-texts")
    stays = texts.join(hits.select("digest", "id"), ["digest", "id"]).select("digest", F.col("body").alias("kept_body"))
    # rows repeated with the id that stays carry one body each; equal ones collapse before the comparison
    stays = stash(stays.groupBy("digest").agg(F.min("kept_body").alias("kept_body")), "kept-texts")
    unequal = texts.join(stays, "digest").where(F.col("body") != F.col("kept_body")).select("digest", "id", F.lit(True).alias("unequal"))
    # written before it is made distinct: an aggregate on top would keep Spark from splitting a hot digest in the join
    unequal = stash(unequal, "unequal-texts").distinct()
    joined = index.runs().drop("n").join(merged.select("digest", F.col("id").alias("keep_id"), F.col("n").alias("group_size")), "digest")
    joined = joined.join(unequal, (joined["digest"] == unequal["digest"]) & joined["id"].eqNullSafe(unequal["id"]), "left").drop(unequal["digest"], unequal["id"])
    alone = F.col("unequal").isNotNull()
    return joined.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(alone, F.lit(1)).otherwise(F.col("group_size")).cast("long").alias("group_size"),
        (alone | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
