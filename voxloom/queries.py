"""Queries over tensor views of the shared test tables, with their DuckDB twins.

Views: orders as a 1-d tensor (place o_orderkey), embeddings as a dense 2-d tensor (place in
the vector, vec_id), lineitem as a sparse 2-d tensor (line number - 1, order key), events as
byte ranges and JSON attributes, pages as addresses and listings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import attrs, listing, paths, uri, versions
from voxloom.functions.grid import NestedGrid, Region, concatenate_permutations, conjugate_with_reverse, invert_permutation, is_identity, is_reversal, linear_index, num_elements
from voxloom.operators import intervals, merge
from voxloom.operators.tensor import TensorFrame
from voxloom.plans.scratch import shared_folder
from voxloom.sources import catalog
from voxloom.sources.chunkstore import delete_chunks, read_chunks, read_positions, write_chunks
from voxloom.sources.codecs import Chain
from voxloom.sources.dataset import Dataset, Shard
from voxloom.sources.store import Container
from voxloom.sources.tensors import open_tensor, update_region, write_cells
from voxloom.streaming.chunks import time_chunks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

VECTOR = 64


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its twin."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extent(df: DataFrame, column: str) -> int:
    """Size of a dimension: one more than the largest coordinate (from Parquet statistics where the scan has them)."""
    return int(df.agg(F.max(column)).first()[0] or 0) + 1


def orders_1d(spark: SparkSession, sf_dir: str, value: str = "o_custkey") -> TensorFrame:
    df = table(spark, sf_dir, "orders")
    return TensorFrame.from_table(df, [F.col("o_orderkey")], F.col(value), [extent(df, "o_orderkey")], [1000], [4000])


def embeddings_2d(spark: SparkSession, sf_dir: str) -> TensorFrame:
    df = table(spark, sf_dir, "embeddings")
    return TensorFrame.from_array_column(df, F.col("vec_id"), F.col("embedding"), [VECTOR, extent(df, "vec_id")], [16, 100], [32, 200])


def lineitem_2d(spark: SparkSession, sf_dir: str) -> TensorFrame:
    df = table(spark, sf_dir, "lineitem")
    cells = df.groupBy("l_linenumber", "l_orderkey").agg(F.sum("l_quantity").cast("long").alias("q"))
    return TensorFrame.from_table(cells, [F.col("l_linenumber") - 1, F.col("l_orderkey")], F.col("q"), [7, extent(df, "l_orderkey")], [2, 1000], [4, 4000])


EMBEDDING_CELLS = "(SELECT vec_id AS x1, unnest(range(64)) AS x0, unnest(embedding) AS value FROM embeddings)"


# --- grids and chunks


@query(
    f"""SELECT x0 // 16 AS g0, x1 // 100 AS g1, count(*) AS n, round(sum(value :: DOUBLE), 4) AS total,
               min(value) AS low, max(value) AS high FROM {EMBEDDING_CELLS} GROUP BY 1, 2"""
)
def chunk_stats_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings_2d(spark, sf_dir).chunk_stats().withColumn("total", F.round("total", 4))


@query("""SELECT o_orderkey, o_orderkey // 1000 AS chunk, (o_orderkey // 1000) % 4 AS rel, o_orderkey // 4000 AS shard,
                 (o_orderkey // 1000) * 1000 AS low, (o_orderkey // 1000 + 1) * 1000 - 1 AS high FROM orders""")
def shard_relative_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = orders_1d(spark, sf_dir)
    chunk = [F.col("chunk")]
    df = t.df.select(F.col("x0").alias("o_orderkey"), t.grid.of_pixels([F.col("x0")])[0].alias("chunk"))
    return df.select("o_orderkey", "chunk", t.grid.relative(chunk, 0, 0)[0].alias("rel"), t.grid.key(chunk)[0].alias("shard"), t.grid.pixel_min(chunk)[0].alias("low"), t.grid.pixel_max(chunk)[0].alias("high"))


@query("SELECT o_orderkey // 1000 AS g0, count(*) AS n, list(o_custkey ORDER BY o_orderkey) AS data FROM orders GROUP BY 1")
def chunk_dense_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_1d(spark, sf_dir).chunks()


@query("""WITH p(ord, g0) AS (VALUES (0 :: BIGINT, 3 :: BIGINT), (1, 0), (2, 999999), (3, 3)),
               c AS (SELECT o_orderkey // 1000 AS g0, list(o_custkey ORDER BY o_orderkey) AS data FROM orders GROUP BY 1)
          SELECT ord, p.g0 AS g0, data FROM p LEFT JOIN c USING (g0)""")
def read_chunks_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([(0, 3), (1, 0), (2, 999999), (3, 3)], "ord long, g0 long")
    return orders_1d(spark, sf_dir).read_chunks(F.broadcast(wanted)).orderBy("ord")  # four rows, a constant


@query("""WITH c AS (SELECT l_linenumber - 1 AS x0, l_orderkey AS x1, sum(l_quantity) :: BIGINT AS v FROM lineitem GROUP BY 1, 2),
               m AS (SELECT max(l_orderkey) + 1 AS d1 FROM lineitem),
               b AS (SELECT DISTINCT (x0 // 4) :: BIGINT AS g0, x1 // 4000 AS g1 FROM c),
               e AS (SELECT g0, g1, least(4, 7 - g0 * 4) AS e0, least(4000, d1 - g1 * 4000) AS e1 FROM b, m),
               s AS (SELECT g0, g1, e0, unnest(range(e0 * e1)) AS lin FROM e)
          SELECT s.g0, s.g1, list(coalesce(v, 0) ORDER BY lin) AS data
          FROM s LEFT JOIN c ON c.x0 = s.g0 * 4 + lin % e0 AND c.x1 = s.g1 * 4000 + lin // e0 GROUP BY 1, 2""")
def read_block_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_2d(spark, sf_dir).dense_blocks(fill=F.lit(0).cast("long"))


@query(f"SELECT x0 :: BIGINT AS x0, x1, value FROM {EMBEDDING_CELLS} WHERE x0 BETWEEN 10 AND 29 AND x1 BETWEEN 50 AND 179")
def region_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings_2d(spark, sf_dir).region(Region((10, 50), (20, 130))).df


@query(f"""SELECT DISTINCT x0 // 16 AS g0, x1 // 100 AS g1,
                  (x0 // 16) * 16 >= 16 AND (x0 // 16) * 16 + 15 <= 47 AND (x1 // 100) * 100 >= 50
                  AND least((x1 // 100) * 100 + 99, (SELECT max(vec_id) FROM embeddings)) <= 349 AS inside
           FROM {EMBEDDING_CELLS} WHERE x0 // 16 BETWEEN 1 AND 2 AND x1 // 100 BETWEEN 0 AND 3""")
def region_full_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, region = embeddings_2d(spark, sf_dir), Region((16, 50), (32, 300))
    g = [F.col("g0"), F.col("g1")]
    found = t.with_grid().select("g0", "g1").where(region.meets_block(g, t.grid)).distinct()
    return found.select("g0", "g1", region.fully_contains(g, t.grid).alias("inside"))


@query("""SELECT n_nationkey, a AS g0, b AS g1, c AS g2 FROM nation, (SELECT unnest(range(1, 4)) AS a), (SELECT unnest(range(0, 3)) AS b), (SELECT unnest(range(2, 6)) AS c)
          WHERE n_regionkey = 2 OR b = n_nationkey % 3""")
def grid_positions_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of a box for the rows of a table, and of a table of their own, joined on one dimension."""
    grid = NestedGrid(((5, 7, 10),), (100, 21, 1000))
    box, nations = Region((9, 0, 25), (8, 99, 30)), table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    every = box.positions(nations.where("n_regionkey = 2"), grid)
    some = nations.where("n_regionkey != 2").withColumn("g1", (F.col("n_nationkey") % 3).cast("long")).join(box.table(spark, grid), "g1")
    return every.unionByName(some).drop("n_regionkey")


@query("""WITH r AS (SELECT DISTINCT l_orderkey // 1000 AS g0 FROM lineitem WHERE l_quantity > 49.5 AND l_returnflag = 'A'),
               n AS (SELECT (max(o_orderkey) + 1 + 999) // 1000 AS n FROM orders)
          SELECT g0 // 4 AS k0, count(*) AS requested, least(4, any_value(n) - (g0 // 4) * 4) AS chunks,
                 count(*) >= least(4, any_value(n) - (g0 // 4) * 4) AS covers FROM r, n GROUP BY 1""")
def covers_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 49.5 and l_returnflag = 'A'")
    return orders_1d(spark, sf_dir).shard_coverage(lines.select(F.call_function("div", F.col("l_orderkey"), F.lit(1000)).alias("g0")))


@query(f"""WITH c AS (SELECT DISTINCT x0 // 16 AS g0, x1 // 100 AS g1 FROM {EMBEDDING_CELLS})
           SELECT g0, g1, row_number() OVER (ORDER BY g1 // 2, g0 // 2, g1 % 2, g0 % 2) AS place FROM c""")
def nested_order_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = embeddings_2d(spark, sf_dir)
    return t.nested_rank(t.with_grid().select("g0", "g1"))


@query("""SELECT o_orderkey // 4000 AS s0, o_orderkey // 1000 AS c0, count(*) AS n, sum(o_custkey) :: BIGINT AS total, min(o_custkey) AS low, max(o_custkey) AS high
          FROM orders GROUP BY GROUPING SETS ((o_orderkey // 4000, o_orderkey // 1000), (o_orderkey // 4000), ())""")
def rollup_chunk_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_1d(spark, sf_dir).rollup(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))


@query(f"SELECT x1 // 100 AS g0, x0 // 16 AS g1, count(*) AS n, list(value ORDER BY x0, x1) AS data FROM {EMBEDDING_CELLS} GROUP BY 1, 2")
def transpose_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings_2d(spark, sf_dir).transpose([1, 0]).chunks()


@query(f"""SELECT x0 // 8 AS x0, x1 // 50 AS x1, round(avg(value :: DOUBLE), 6) AS value FROM {EMBEDDING_CELLS} GROUP BY 1, 2""")
def downsample_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings_2d(spark, sf_dir).downsample([8, 50], F.round(F.avg(F.col("value").cast("double")), 6)).df


@query("""WITH p AS (SELECT vec_id AS id, list_transform(list_grade_up(embedding[1:4]), lambda i: (i - 1) :: INTEGER) AS p, list_transform(list_grade_up(embedding[5:8]), lambda i: (i - 1) :: INTEGER) AS q FROM embeddings)
          SELECT id, list_transform(range(4), lambda i: (list_position(p, i) - 1) :: INTEGER) AS inverse,
                 list_transform(q, lambda i: p[i + 1]) AS joined,
                 list_transform(list_reverse(p), lambda i: (3 - i) :: INTEGER) AS conjugate,
                 p = [0,1,2,3] AS identity, p = [3,2,1,0] AS reversal FROM p""")
def permutation_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permutations that sort the first and the next four elements of each vector."""

    def grades(start: int) -> Column:
        ranked = F.array_sort(F.transform(F.slice("embedding", start, 4), lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
        return F.transform(ranked, lambda r: r["i"])

    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), grades(1).alias("p"), grades(5).alias("q"))
    p, q = F.col("p"), F.col("q")
    return df.select("id", invert_permutation(p).alias("inverse"), concatenate_permutations(p, q).alias("joined"), conjugate_with_reverse(p).alias("conjugate"), is_identity(p).alias("identity"), is_reversal(p).alias("reversal"))


@query("SELECT vec_id, len(embedding) :: BIGINT * label AS elements, (vec_id % 100) * 16 + label % 16 AS lin FROM embeddings")
def element_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    size = F.array(F.size("embedding"), F.col("label"))
    return df.select("vec_id", num_elements(size).alias("elements"), linear_index([F.col("label") % 16, F.col("vec_id") % 100], [16, 100]).alias("lin"))


@query("SELECT o_orderkey, (CASE WHEN o_custkey % 2 = 0 THEN -o_custkey - 1 + 18446744073709551616 :: HUGEINT ELSE o_custkey END) :: DECIMAL(20,0) AS value FROM orders")
def uint64_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = F.when(F.col("o_custkey") % 2 == 0, -F.col("o_custkey") - 1).otherwise(F.col("o_custkey"))
    wide = bits.cast("decimal(20,0)")
    value = F.when(bits < 0, wide + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wide)
    return table(spark, sf_dir, "orders").select("o_orderkey", value.cast("decimal(20,0)").alias("value"))


# --- writes and deletes as merges

CHUNK_SUMS = "(SELECT o_orderkey // 1000 AS g0, sum(o_custkey) :: BIGINT AS value FROM orders GROUP BY 1)"


def _chunk_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_1d(spark, sf_dir).with_grid().groupBy("g0").agg(F.sum("value").alias("value"))


@query(f"""WITH n AS (SELECT l_orderkey // 500 AS g0, max_by(l_quantity :: BIGINT, struct_pack(a := l_partkey, b := l_quantity :: BIGINT)) AS value FROM lineitem GROUP BY 1)
           SELECT coalesce(n.g0, c.g0) AS g0, coalesce(n.value, c.value) AS value FROM {CHUNK_SUMS} c FULL JOIN n ON n.g0 = c.g0""")
def write_chunks_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    new = lines.select(F.call_function("div", F.col("l_orderkey"), F.lit(500)).alias("g0"), F.col("l_quantity").cast("long").alias("value"), F.col("l_partkey").alias("ord"))
    return merge.write_chunks(_chunk_sums(spark, sf_dir), new, ["g0"], "value", "ord")


@query(f"""WITH w AS (SELECT unnest(range(2, 21)) AS g0)
           SELECT g0, value FROM (SELECT w.g0 AS g0, CASE WHEN w.g0 % 3 <> 0 THEN coalesce(c.value, 0) + 1 END AS value FROM w LEFT JOIN {CHUNK_SUMS} c ON c.g0 = w.g0) WHERE value IS NOT NULL
           UNION ALL SELECT g0, value FROM {CHUNK_SUMS} WHERE g0 NOT BETWEEN 2 AND 20""")
def write_region_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    def supplier(pos: list[Column], old: Column) -> Column:
        return F.when(pos[0] % 3 != 0, F.coalesce(old, F.lit(0)) + 1)

    return merge.write_region(_chunk_sums(spark, sf_dir), Region((2500,), (18000,)), NestedGrid(((1000,),)), "value", supplier, ["g0"])


# chunks whose lines have a low mean quantity
DOOMED = "(SELECT l_orderkey // 1000 AS g0 FROM lineitem GROUP BY 1 HAVING 2 * sum(l_quantity) < 51 * count(*))"


def _doomed(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_chunk = table(spark, sf_dir, "lineitem").groupBy(F.call_function("div", F.col("l_orderkey"), F.lit(1000)).alias("g0"))
    return by_chunk.agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n")).where("2 * q < 51 * n").select("g0")


@query(f"SELECT c.g0, c.value FROM {CHUNK_SUMS} c WHERE NOT EXISTS (SELECT 1 FROM {DOOMED} d WHERE d.g0 = c.g0)")
def delete_chunks_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.delete_chunks(_chunk_sums(spark, sf_dir), _doomed(spark, sf_dir), ["g0"])


@query(f"SELECT DISTINCT g0 // 4 AS k0 FROM {CHUNK_SUMS} WHERE g0 // 4 NOT IN (SELECT c.g0 // 4 FROM {CHUNK_SUMS} c WHERE c.g0 NOT IN (SELECT g0 FROM {DOOMED}))")
def emptied_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _chunk_sums(spark, sf_dir)
    after = merge.delete_chunks(before, _doomed(spark, sf_dir), ["g0"])
    return merge.emptied_shards(before, after, NestedGrid(((1000,), (4000,))), ["g0"])


@query(f"""WITH d AS (SELECT DISTINCT l_partkey // 50 AS g0 FROM lineitem)
           SELECT d.g0, c.g0 IS NOT NULL AS existed FROM d LEFT JOIN {CHUNK_SUMS} c ON c.g0 = d.g0""")
def delete_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    doomed = table(spark, sf_dir, "lineitem").select(F.call_function("div", F.col("l_partkey"), F.lit(50)).alias("g0"))
    return merge.deleted(_chunk_sums(spark, sf_dir), doomed, ["g0"])


@query("SELECT DISTINCT l_orderkey // 100 AS g0 FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey // 1000 = l_orderkey // 100)")
def block_exists_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "lineitem").select(F.call_function("div", F.col("l_orderkey"), F.lit(100)).alias("g0")).distinct()
    return asked.join(_chunk_sums(spark, sf_dir), "g0", "left_semi")


@query("SELECT l_orderkey // 1000 AS g0, (l_linenumber // 2) :: BIGINT AS g1, min(l_partkey) AS ord FROM lineitem GROUP BY 1, 2")
def dedup_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "lineitem").select(F.call_function("div", F.col("l_orderkey"), F.lit(1000)).alias("g0"), F.call_function("div", F.col("l_linenumber"), F.lit(2)).cast("long").alias("g1"), F.col("l_partkey").alias("ord"))
    return merge.first_request(asked, ["g0", "g1"], "ord")


# --- byte ranges

RANGES = "(SELECT user_id, event_id, (floor(value * 10)) :: BIGINT AS off, 1 + event_id % 40 AS len, event_id % 3 = 0 AS cached FROM events)"


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = F.floor(F.col("value") * 10).cast("long")
    return table(spark, sf_dir, "events").select("user_id", "event_id", off.alias("off"), (1 + F.col("event_id") % 40).alias("len"), (F.col("event_id") % 3 == 0).alias("cached"))


@query(f"""WITH r AS (SELECT *, max(off + len) OVER (PARTITION BY user_id ORDER BY off, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {RANGES}),
                i AS (SELECT *, sum(CASE WHEN reach >= off THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY off, len ROWS UNBOUNDED PRECEDING) AS island FROM r)
           SELECT user_id, min(off) AS off, max(off + len) - min(off) AS len FROM i GROUP BY user_id, island""")
def interval_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.coalesce_ranges(_ranges(spark, sf_dir), ["user_id"])


@query(f"""SELECT user_id, event_id, off, len, EXISTS (SELECT 1 FROM {RANGES} s WHERE s.cached AND s.user_id = r.user_id AND s.off <= r.off AND s.off + s.len >= r.off + r.len) AS covered
           FROM {RANGES} r WHERE NOT cached""")
def interval_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ranges(spark, sf_dir)
    asked = r.where("not cached").select("user_id", "event_id", "off", "len")
    return intervals.covered(asked, r.where("cached"), ["user_id"])


@query(f"""SELECT user_id, event_id, off, (SELECT max(s.off) FROM {RANGES} s WHERE s.cached AND s.user_id = r.user_id AND s.off <= r.off) AS slice FROM {RANGES} r WHERE NOT cached""")
def interval_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ranges(spark, sf_dir)
    slices = r.where("cached").select("user_id", "off", F.col("off").alias("slice"))
    return intervals.floor_slice(r.where("not cached").select("user_id", "event_id", "off"), slices, ["user_id"])


@query(f"SELECT user_id, min(off) AS off, max(off + len) - min(off) AS len FROM {RANGES} GROUP BY 1")
def enclosing_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.enclosing_range(_ranges(spark, sf_dir), ["user_id"])


@query(f"""WITH d AS (SELECT DISTINCT user_id, off, len FROM {RANGES})
           SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM d o WHERE o.user_id = d.user_id AND o.off <= d.off AND o.off + o.len >= d.off + d.len AND (o.off, o.len) <> (d.off, d.len))""")
def add_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ranges(spark, sf_dir)
    return intervals.add_slices(r.where("cached"), r.where("not cached"), ["user_id"])


@query("""SELECT source, doc_id, octet_length(encode(text)) :: BIGINT AS len,
                 coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) :: BIGINT AS off FROM documents""")
def segment_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("len"))
    return intervals.segment_offsets(docs, ["source"], "doc_id", "len")


@query(f"SELECT user_id, event_id, off - 100 AS off, len FROM {RANGES} WHERE off >= 100 AND off + len <= 600")
def slice_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.slice_segments(_ranges(spark, sf_dir).drop("cached"), 100, 500)


@query("SELECT source, sum(octet_length(encode(text))) :: BIGINT AS length, bool_and(text IS NOT NULL) AS known FROM documents GROUP BY 1")
def concatenated_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.sum(F.octet_length("text")).alias("length"), F.bool_and(F.col("text").isNotNull()).alias("known"))


@query("SELECT doc_id, substr(text, 4, 10) AS part, substr(text, 1, 5) AS head FROM documents")
def slice_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 4, 10).alias("part"), F.substring("text", 1, 5).alias("head"))


# --- attributes


@query("""SELECT event_id, json_extract(props, '$.k') :: BIGINT AS k, json_extract_string(props, '$.k') AS k_text, NULL :: VARCHAR AS missing FROM events""")
def attr_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("p"))
    get = lambda path, kind="string": attrs.get_column(F.col("p"), path, kind, parsed=True)
    return e.select("event_id", get("k", "bigint").alias("k"), get("/k").alias("k_text"), get("k/missing").alias("missing"))


@query("""SELECT event_id, event_id AS first, CASE WHEN event_id % 2 = 0 THEN CASE WHEN value = floor(value) THEN 'long' ELSE 'double' END ELSE 'string' END AS second_type,
                 'boolean' AS third_type, 'object' AS a_type, 'object[]' AS b_type, CASE WHEN value = floor(value) THEN 'long[]' ELSE 'double[]' END AS c_type, event_type AS s FROM events""")
def attr_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    second = F.when(F.col("event_id") % 2 == 0, F.col("value").cast("string")).otherwise(F.lit('"x"'))
    text = F.concat(F.lit('{"a":{"b":['), F.col("event_id").cast("string"), F.lit(","), second, F.lit(',true],"c":['), F.col("event_id").cast("string"), F.lit(","), F.col("value").cast("string"), F.lit(']},"s":"'), F.col("event_type"), F.lit('","n":null}'))
    e = e.select("event_id", F.try_parse_json(text).alias("j"))
    j, kind = F.col("j"), lambda path: attrs.type_column(F.col("j"), path, parsed=True)
    return e.select(
        "event_id", attrs.get_column(j, "a/b[0]", "bigint", parsed=True).alias("first"), kind("a/b[1]").alias("second_type"), kind("/a/b[2]").alias("third_type"),
        kind("a").alias("a_type"), kind("a/b").alias("b_type"), kind("a/c").alias("c_type"), attrs.get_column(j, "s", parsed=True).alias("s"),
    )


@query("""SELECT event_id, [event_id, user_id, 7] AS longs, [7, user_id, event_id] AS reversed, 'long' AS kind, [value :: DOUBLE, 0.5] AS doubles FROM events""")
def attr_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    e = e.select("event_id", F.to_json(F.struct(F.array("event_id", "user_id", F.lit(7)).alias("l"), F.array("value", F.lit(0.5)).alias("d"))).alias("j"))
    longs = attrs.get_column(F.col("j"), "l", "array<bigint>")
    return e.select("event_id", longs.alias("longs"), F.reverse(longs).alias("reversed"), attrs.type_column(F.col("j"), "l[2]").alias("kind"), attrs.get_column(F.col("j"), "/d", "array<double>").alias("doubles"))


@query("""SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"a":{"b":[0,' || user_id || ']}}' AS deep, '{"k":{"new":"' || event_type || '"}}' AS over,
                 '[null,null,{"x":' || event_id || '}]' AS root FROM events""")
def attr_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values set at paths of JSON texts: missing parents are made, unfit ones replaced."""
    p, number = F.col("props"), lambda c: F.col(c).cast("string")
    return table(spark, sf_dir, "events").select(
        "event_id", attrs.set_column(p, "a/b[1]", number("user_id")).alias("deep"), attrs.set_column(p, "k/new", F.concat(F.lit('"'), "event_type", F.lit('"'))).alias("over"),
        attrs.set_column(F.lit("5"), "[2]/x", number("event_id")).alias("root"),
    )


@query("""WITH e AS (SELECT *, json_extract_string(props, '$.k') AS k FROM events)
          SELECT event_id, '{"a":[' || event_id || ',{"y":2}]}' AS inner_gone, '{"k":' || k || ',"a":[{"x":' || user_id || ',"y":2}]}' AS moved_up, '{"k":' || k || '}' AS top_gone,
                 '{"k":' || k || ',"a":[' || event_id || ',{"x":' || user_id || ',"y":2}]}' AS unchanged FROM e""")
def attr_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes removed from JSON texts: members at any depth, elements whose followers move up, and what isn't there."""
    text = F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"a":['), F.col("event_id").cast("string"), F.lit(',{"x":'), F.col("user_id").cast("string"), F.lit(',"y":2}]}'))
    left = attrs.remove_columns(text, {"inner_gone": ["a[1]/x", "k"], "moved_up": ["/a[0]"], "top_gone": ["a"], "unchanged": ["a[7]/x"]})
    return table(spark, sf_dir, "events").select("event_id", left.alias("left")).select("event_id", "left.*")


@query("""SELECT event_id, name, kind FROM (SELECT event_id, unnest(['k', 's', 'n', 'l', 'o']) AS name, unnest(['long', 'string', NULL, CASE WHEN value = floor(value) THEN 'long[]' ELSE 'double[]' END, 'object']) AS kind FROM events)""")
def attr_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"s":"'), "event_type", F.lit('","n":null,"l":[1,'), F.col("value").cast("string"), F.lit('],"o":{}}'))
    return table(spark, sf_dir, "events").select("event_id", F.explode(attrs.list_types_column(text)).alias("name", "kind"))


@query("SELECT (o_orderkey % 7) || '.' || (o_custkey % 3) || '.0' AS version, count(*) AS n, (o_orderkey % 7) <= 4 AS compatible, (o_custkey % 3) :: INTEGER AS minor FROM orders GROUP BY 1, 3, 4")
def version_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat((F.col("o_orderkey") % 7).cast("string"), F.lit("."), (F.col("o_custkey") % 3).cast("string"), F.lit(".0"))
    found = table(spark, sf_dir, "orders").select(text.alias("version")).groupBy("version").agg(F.count(F.lit(1)).alias("n"))
    return found.select("version", "n", versions.compatible_column(F.col("version")).alias("compatible"), versions.part_column(F.col("version"), 2).alias("minor"))


# --- addresses and catalogs


@query(r"""SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS container, CASE WHEN regexp_matches(url, '^[^#]*\?') THEN regexp_extract(url, '^[^?#]*\?([^#]*)', 1) ELSE '/' END AS grp,
                  CASE WHEN contains(url, '#') THEN regexp_extract(url, '#(.*)$', 1) ELSE '/' END AS attribute FROM pages""")
def uri_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", uri.container_column(u).alias("container"), uri.group_column(u).alias("grp"), uri.attribute_column(u).alias("attribute"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^?#]*)', 1) AS u FROM pages)
           SELECT page_id, '/x/' || list_aggregate(list_filter(string_split(u, '/'), lambda p: p <> ''), 'string_agg', '/') || '/[3]/y' AS path,
                  'https://box.org/c?a/c' AS inside, 'https://other.org/' || page_id AS away, true AS absolute, 'a b/é+' AS grp FROM p""")
def address_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute paths normalised, addresses resolved against a base, escapes decoded."""
    messy = F.concat(F.lit("/x/./"), F.regexp_extract("url", r"^https?://([^?#]*)", 1), F.lit("//q/..[3]/y/"))
    base = F.concat(F.lit("https://box.org/c?a/b#at"), F.col("page_id").cast("string"))
    other = F.concat(F.lit("https://other.org/"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select(
        "page_id", attrs.normalize_path_column(messy).alias("path"), uri.resolve_column(base, F.lit("?../c")).alias("inside"), uri.resolve_column(base, other).alias("away"),
        uri.is_absolute_column(F.col("url")).alias("absolute"), uri.decoded_group_column(F.lit("x?a%20b/%C3%A9+#c")).alias("grp"),
    )


@query(r"SELECT page_id, list_aggregate(list_filter(string_split(regexp_extract(url, '^https?://([^?#]*)', 1), '/'), lambda p: p <> ''), 'string_agg', '/') AS path FROM pages")
def group_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    messy = F.concat(F.lit("/./"), F.regexp_extract("url", r"^https?://([^?#]*)", 1), F.lit("//x/../."))
    return table(spark, sf_dir, "pages").select("page_id", attrs.normalize_group_column(messy).alias("path"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?:/(/[^?#]*)', 1) AS path FROM pages)
          SELECT page_id, list_prepend('/', list_filter(string_split(path, '/'), lambda x: x <> '')) AS parts, regexp_replace(rtrim(path, '/'), '/+[^/]*$', '') AS parent,
                 list_aggregate(list_filter(string_split(path, '/'), lambda x: x <> '')[2:], 'string_agg', '/') AS inner_path, rtrim(path, '/') || '/0/1' AS block FROM p""")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"^https?:/(/[^?#]*)", 1)
    p = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    host = F.concat(F.lit("/"), F.element_at(paths.components(F.col("path")), 2))
    bare = F.regexp_replace("path", "/+$", "")
    return p.select("page_id", paths.components(F.col("path")).alias("parts"), paths.parent(F.col("path")).alias("parent"), paths.relativize(bare, host).alias("inner_path"), paths.compose(F.col("path"), F.lit("0"), F.lit("1")).alias("block"))


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN off <= 3000 ELSE off + len <= 3000 END AS valid FROM (SELECT event_id, (floor(value * 10)) :: BIGINT AS off, 1 + event_id % 40 AS len FROM events)""")
def valid_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ranges(spark, sf_dir)
    length = F.when(F.col("event_id") % 11 == 0, -1).otherwise(F.col("len"))
    return r.select("event_id", paths.valid_bounds(F.col("off"), length, F.lit(3000)).alias("valid"))


def _url_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_extract("url", r"^https?://([^?#]*)", 1), "/+$", "")
    leaf = F.when(F.col("page_id") % 4 != 0, F.lit('{"dimensions":[1],"blockSize":[1],"dataType":"int8","compression":{"type":"raw"}}'))
    return catalog.nodes_from(table(spark, sf_dir, "pages").select(path.alias("p"), leaf.alias("a")), "p", "a")


URL_TREE = r"""
    leaf AS (SELECT rtrim(regexp_extract(url, '^https?://([^?#]*)', 1), '/') AS p, page_id % 4 <> 0 AS d FROM pages),
    part AS (SELECT string_split(p, '/') AS s, unnest(range(0, len(string_split(p, '/')) + 1)) AS depth, d FROM leaf),
    node AS (SELECT coalesce(list_aggregate(s[1:depth], 'string_agg', '/'), '') AS path, depth, max(CASE WHEN depth = len(s) AND d THEN 1 ELSE 0 END) = 1 AS is_dataset FROM part GROUP BY 1, 2)"""


@query(f"""WITH {URL_TREE} SELECT path, CASE WHEN depth > 0 THEN CASE WHEN depth = 1 THEN '' ELSE regexp_replace(path, '/[^/]*$', '') END END AS parent,
                  CASE WHEN depth > 0 THEN regexp_extract(path, '([^/]*)$', 1) END AS name, depth :: INTEGER AS depth, is_dataset FROM node""")
def catalog_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _url_tree(spark, sf_dir).drop("attributes").withColumn("depth", F.col("depth").cast("int"))


@query(f"WITH {URL_TREE} SELECT path AS name FROM node WHERE depth = 1")
def list_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.children(_url_tree(spark, sf_dir), "")


@query(f"WITH {URL_TREE} SELECT path FROM node n WHERE depth > 0 AND NOT EXISTS (SELECT 1 FROM node o WHERE o.is_dataset AND starts_with(n.path, o.path || '/'))")
def deep_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.deep_list(_url_tree(spark, sf_dir))


@query(f"WITH {URL_TREE} SELECT path FROM node n WHERE is_dataset AND contains(path, '/en/') AND NOT EXISTS (SELECT 1 FROM node o WHERE o.is_dataset AND starts_with(n.path, o.path || '/'))")
def deep_list_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.deep_list(_url_tree(spark, sf_dir), datasets_only=True, keep=F.col("path").contains("/en/"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="[^"]+">([^<]+)</a>', 1)) AS entry FROM pages""")
def listing_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(listing.any_entries(F.col("html"))).alias("entry"))


@query("SELECT c_nationkey, c_name AS entry, c_acctbal < 0 AS is_group FROM customer")
def listing_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of each nation's customers, those of 25,000 keys in each, in one of three server styles; customers in debt are directories."""
    styles, group = sorted(listing.STYLES), F.col("c_acctbal") < 0
    style = F.element_at(F.array(*map(F.lit, styles)), (F.col("c_nationkey") % 3 + 1).cast("int"))
    lines = {
        "iis": F.concat(F.when(group, F.lit("1/1/2024 &lt;dir&gt; ")).otherwise("1/1/2024 117 "), F.lit('<A HREF="/'), "c_name", F.lit('">'), "c_name", F.lit("</A><br>")),
        "apache": F.concat(F.lit('<img src="x" alt="['), F.when(group, F.lit("DIR")).otherwise("TXT"), F.lit(']"> <a href="'), "c_name", F.lit('">'), "c_name", F.lit("</a> 2024\n")),
        "python": F.concat(F.lit('<li><a href="'), "c_name", F.when(group, F.lit('/">')).otherwise('">'), "c_name", F.when(group, F.lit("/</a></li>")).otherwise("</a></li>")),
    }
    line = F.coalesce(*[F.when(style == n, x) for n, x in lines.items()])
    lot = F.call_function("div", F.col("c_custkey"), F.lit(25_000))
    pages = table(spark, sf_dir, "customer").select("c_nationkey", style.alias("style"), lot.alias("lot"), line.alias("line")).groupBy("c_nationkey", "style", "lot").agg(F.array_join(F.collect_list("line"), "").alias("html"))
    found = F.coalesce(*[F.when(F.col("style") == n, listing.typed_entries(F.col("html"), n)) for n in styles])
    return pages.select("c_nationkey", F.inline(found))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def event_time_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return time_chunks(table(spark, sf_dir, "events"), "ts", F.col("value"), "1 hour").withColumn("total", F.round("total", 4))


# --- containers: written with codecs and read back through the data source


def _stored(spark: SparkSession, chunks: DataFrame, dataset: Dataset, name: str) -> str:
    folder = shared_folder(spark, name)
    Container(folder, create=True).create_dataset("data", dataset)
    write_chunks(chunks, folder, "data", staged=False)  # the tables don't depend on the container
    return folder


def _one_d(spark: SparkSession, sf_dir: str, label: str, chain: Chain, name: str, *shards: Shard) -> tuple[str, Dataset]:
    t = orders_1d(spark, sf_dir)
    dataset = Dataset(t.dims, (1000,), label, chain, shards)
    rows = t.chunks().select("g0", F.array(F.col("n").cast("int")).alias("size"), F.col("n").cast("int").alias("num_elements"), "data")
    return _stored(spark, rows, dataset, name), dataset


def _cells_1d(df: DataFrame) -> DataFrame:
    flat = df.select("g0", F.posexplode("data").alias("i", "value"))
    return flat.select((F.col("g0") * 1000 + F.col("i")).alias("x0"), F.col("value").cast("long").alias("value"))


ORDER_CELLS = "SELECT o_orderkey AS x0, o_custkey AS value FROM orders"


def _roundtrip(label: str, chain: Chain, name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder, _ = _one_d(spark, sf_dir, label, chain, name)
        return _cells_1d(read_chunks(spark, folder, "data"))

    run.__name__ = name
    return run


for _label, _chain in (("int64", []), ("uint32", [("gzip", {})]), ("int32", [("bzip2", {})]), ("uint64", [("lz4", {})]), ("float64", [("xz", {"preset": 1})]), ("int64", [("gzip", {"useZlib": True}), ("crc32c", {})])):
    _name = "roundtrip_" + "_".join([_label, *(n for n, _ in _chain)])
    query(ORDER_CELLS)(_roundtrip(_label, _chain, _name))


#: Metadata of shards in shards: codecs of each level, and of the indexes, are nested in those of the level above.
NESTED = {
    "blockSize": [8000], "dataType": "int64",
    "codecs": [{"name": "sharding_indexed", "configuration": {
        "chunk_shape": [4000], "index_location": "start", "index_codecs": [{"name": "raw-bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}],
        "codecs": [{"name": "sharding_indexed", "configuration": {
            "chunk_shape": [1000], "index_codecs": [{"name": "raw-bytes", "configuration": {"endian": "big"}}],
            "codecs": [{"name": "raw-bytes", "configuration": {"endian": "little"}}, {"name": "gzip", "configuration": {"level": 3}}, {"name": "crc32c"}],
        }}],
    }}],
}


@query(ORDER_CELLS)
def roundtrip_nested_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = orders_1d(spark, sf_dir)
    dataset = Dataset.from_json(NESTED | {"dimensions": list(t.dims)})
    assert dataset is not None and dataset.grid.block_sizes == ((1000,), (4000,), (8000,))
    rows = t.chunks().select("g0", F.array(F.col("n").cast("int")).alias("size"), "data")
    return _cells_1d(read_chunks(spark, _stored(spark, rows, dataset, "nested"), "data"))


@query("""WITH c AS (SELECT o_orderkey // 1000 AS g0, list(o_custkey ORDER BY o_orderkey) AS data FROM orders GROUP BY 1)
          SELECT ord, p.g0 AS g0, data FROM (SELECT c_custkey AS ord, c_custkey // 5 AS g0 FROM customer WHERE c_acctbal < 0) p LEFT JOIN c ON c.g0 = p.g0""")
def read_stored_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks at the positions of a table, repeated and absent ones among them, read from a sharded dataset."""
    folder, _ = _one_d(spark, sf_dir, "int64", [("lz4", {})], "positions", Shard((4000,), [("crc32c", {})]))
    wanted = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("ord"), F.call_function("div", F.col("c_custkey"), F.lit(5)).alias("g0"))
    return read_positions(wanted, folder, "data").select("ord", "g0", "data")


@query(f"SELECT x0 :: BIGINT AS x0, x1, value FROM {EMBEDDING_CELLS}")
def roundtrip_sharded_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = embeddings_2d(spark, sf_dir)
    dataset = Dataset(t.dims, (16, 100), "float32", [("gzip", {})], (Shard((32, 200), [("crc32c", {})]),), arrays=[("transpose", {"order": [1, 0]})])
    height = F.least(F.lit(100), F.lit(t.dims[1]) - F.col("g1") * 100).cast("int")
    rows = t.chunks().select("g0", "g1", F.array(F.lit(16), height).alias("size"), F.col("n").cast("int").alias("num_elements"), "data")
    found = read_chunks(spark, _stored(spark, rows, dataset, "sharded"), "data")
    flat = found.select("g0", "g1", F.posexplode("data").alias("i", "value"))
    return flat.select((F.col("g0") * 16 + F.col("i") % 16).alias("x0"), (F.col("g1") * 100 + F.call_function("div", F.col("i"), F.lit(16))).alias("x1"), "value")


@query("SELECT o_orderkey AS x0, o_custkey AS value FROM orders WHERE o_orderkey // 1000 BETWEEN 5 AND 9")
def pruned_region_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, _ = _one_d(spark, sf_dir, "int64", [("gzip", {})], "pruned", Shard((4000,), index_at_end=False, index_little=True))
    return _cells_1d(read_chunks(spark, folder, "data", Region((5100,), (4000,))))


@query("""SELECT o_orderkey AS x0, CASE WHEN o_orderkey // 1000 % 5 = 1 THEN -o_custkey ELSE o_custkey END AS value FROM orders
          WHERE o_orderkey // 1000 NOT IN (6, 8, 9, 10, 11, 12, 13, 14, 15)""")
def store_overwrite_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, dataset = _one_d(spark, sf_dir, "int64", [("lz4", {})], "mutated", Shard((2000,)), Shard((8000,), [("crc32c", {})], index_at_end=False))
    rows = read_chunks(spark, folder, "data").where("g0 % 5 = 1").withColumn("data", F.transform("data", lambda v: -v))
    write_chunks(rows, folder, "data")
    delete_chunks(spark.createDataFrame([(8,), (9,), (10,), (11,), (12,), (13,), (14,), (15,), (6,), (777777,)], "g0 long"), folder, "data")
    assert not Container(folder).block_exists("data", (1,))  # its last chunk is gone, and so is the shard
    return _cells_1d(read_chunks(spark, folder, "data"))


@query("""WITH c AS (SELECT l_linenumber - 1 AS x0, l_orderkey AS x1, sum(l_quantity) :: BIGINT AS v FROM lineitem GROUP BY 1, 2),
               m AS (SELECT max(l_orderkey) + 1 AS d1 FROM lineitem),
               p AS (SELECT DISTINCT (x0 // 2) :: BIGINT AS g0, x1 // 1000 AS g1 FROM c),
               s AS (SELECT g0 * 2 + unnest([0, 1]) AS x0, g1 FROM p),
               t AS (SELECT x0, g1 * 1000 + unnest(range(1000)) AS x1 FROM s)
          SELECT t.x0, t.x1, coalesce(v, 0) AS value FROM t LEFT JOIN c ON c.x0 = t.x0 AND c.x1 = t.x1, m
          WHERE t.x0 BETWEEN 1 AND 6 AND t.x1 BETWEEN 2500 AND 5499 AND t.x1 < d1""")
def stored_region_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lineitem_2d(spark, sf_dir)
    folder = shared_folder(spark, "cells")
    Container(folder, create=True).create_dataset("data", Dataset(t.dims, (2, 1000), "int64", [("gzip", {})], (Shard((4, 4000)),)))
    write_cells(t, folder, "data")
    return open_tensor(spark, folder, "data", Region((1, 2500), (6, 3000))).df


@query("""SELECT o_orderkey AS x0, CASE WHEN o_orderkey // 1000 BETWEEN 2 AND 8 THEN o_custkey + 1 ELSE o_custkey END AS value FROM orders
          WHERE o_orderkey // 1000 NOT IN (3, 6)""")
def store_update_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, _ = _one_d(spark, sf_dir, "int64", [("gzip", {})], "updated", Shard((4000,)))
    # every third chunk of the region goes, the others gain one; chunks that aren't there stay absent
    update_region(spark, folder, "data", Region((2500,), (6000,)), lambda pos, old: F.when(pos[0] % 3 != 0, F.transform(old, lambda v: v + 1)))
    return _cells_1d(read_chunks(spark, folder, "data"))


@query("""WITH c AS (SELECT o_orderkey // 1000 AS g0, count(*) AS n, list(o_custkey ORDER BY o_orderkey) AS data FROM orders GROUP BY 1),
               s AS (SELECT *, data[1] <= data[n] AS stored, data[1] < data[2] AS gone FROM c)
          SELECT g0 * 1000 + i AS x0, CASE WHEN stored THEN data[i + 1] + 1 ELSE 0 END AS value FROM (SELECT *, unnest(range(n)) AS i FROM s WHERE NOT (stored AND gone))""")
def store_region_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region of which the supplier deletes some chunks, changes others, and makes those that are absent, once."""
    t = orders_1d(spark, sf_dir)
    dataset = Dataset(t.dims, (1000,), "int64", [("gzip", {})], (Shard((4000,)),))
    some = t.chunks().where(F.element_at("data", 1) <= F.element_at("data", -1))
    folder = _stored(spark, some.select("g0", F.array(F.col("n").cast("int")).alias("size"), "data"), dataset, "supplied")
    zeros = lambda g0: F.array_repeat(F.lit(0).cast("long"), F.least(F.lit(1000), F.lit(t.dims[0]) - g0 * 1000).cast("int"))
    update_region(spark, folder, "data", Region((0,), t.dims), lambda pos, old: F.when(old.isNull(), zeros(pos[0])).when(~(old[0] < old[1]), F.transform(old, lambda v: v + 1)))
    return _cells_1d(read_chunks(spark, folder, "data"))


@query("SELECT c_mktsegment AS path, NULL :: VARCHAR AS parent, 1 :: INTEGER AS depth, count(*) AS n FROM customer GROUP BY 1")
def container_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A container with a group for each market segment, its attributes read back as a table."""
    counts = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).collect()
    box = Container(shared_folder(spark, "groups"), create=True)
    for r in counts:
        box.create_group(r["c_mktsegment"])
        box.set_attribute(r["c_mktsegment"], "stats/n", r["n"])
    found = catalog.nodes(spark, box.uri).where("depth = 1")
    return found.select("path", F.nullif("parent", F.lit("")).alias("parent"), F.col("depth").cast("int").alias("depth"), attrs.get_column(F.col("attributes"), "stats/n", "bigint").alias("n"))
