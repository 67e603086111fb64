import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA, same_rows
from voxloom import queries
from voxloom.functions import listing


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_matches_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, DATA), duck.sql(queries.ORACLE_SQL[name]))


def test_every_query_has_a_twin():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_listing_entries_with_their_own_types(spark):
    pages = {
        "iis": '1/1/2024 &lt;dir&gt; <A HREF="/a">a</A><br>1/1/2024 117 <A HREF="/a">a</A><br>',
        "apache": '<img alt="[DIR]"> <a href="a">a</a>\n<img alt="[TXT]"> <a href="a">a</a>\n<img alt="[   ]"> no entry\n',
        "python": '<li><a href="a/">a/</a></li><li><a href="a">a</a></li>',
    }
    row = spark.range(1).select(*[listing.typed_entries(F.lit(html), style).alias(style) for style, html in pages.items()], listing.typed_entries(F.lit(None).cast("string"), "iis").alias("none")).first()
    for style in pages:  # a directory and a file of the same name
        assert [tuple(e) for e in row[style]] == [("a", True), ("a", False)]
    assert row["none"] is None


def test_listing_styles_compares_no_names(spark):
    # entries of a listing against all its directories: the square of a nation's customers, and a copy of the names for each
    assert "array_contains" not in queries.QUERIES["listing_styles"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


def test_listing_styles_by_entry(spark, duck, tmp_path):
    # one nation with a long listing; a name is a file's and a directory's
    customers = spark.range(0, 60_000, 1, 4).select(F.col("id").alias("c_custkey"), F.lit(4).alias("c_nationkey"), F.concat(F.lit("c"), F.col("id") % 50_000).alias("c_name"), (F.col("id") % 3 - 1.0).alias("c_acctbal"))
    customers.write.parquet(str(tmp_path / "customer.parquet"))
    sql = queries.ORACLE_SQL["listing_styles"].replace("FROM customer", f"FROM '{tmp_path}/customer.parquet/*.parquet'")
    same_rows(queries.QUERIES["listing_styles"](spark, str(tmp_path)), duck.sql(sql))
