"""File sources that refuse what does not keep their contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ODDS = "id STRING, sport_key STRING, commence_time STRING, home_team STRING, away_team STRING, bookmakers ARRAY<STRUCT<key: STRING, markets: ARRAY<STRUCT<key: STRING, last_update: STRING, outcomes: ARRAY<STRUCT<name: STRING, description: STRING, price: DOUBLE, point: DOUBLE>>>>>>"


def read_csv_feed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV feed, plain or gzip. A changed, missing, repeated or reordered header, a row of another width or bytes that are not UTF-8 fail the read.

    Spark's reader puts a mark for malformed bytes; so bytes are read as Latin-1, one character each, and texts are made of
    them again and checked. Separators are ASCII, so rows and columns are the same.
    """
    raw = T.StructType([T.StructField(f.name.encode().decode("latin-1"), f.dataType, f.nullable) for f in schema.fields])
    rows = spark.read.schema(raw).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("encoding", "ISO-8859-1").csv(path)
    bytes_of = lambda f: F.encode(F.col(f"`{f.name}`"), "ISO-8859-1").cast("string")
    texts = [f for f in raw.fields if isinstance(f.dataType, T.StringType)]
    for f in texts:
        bad = ~F.coalesce(F.is_valid_utf8(bytes_of(f)), F.lit(True))
        rows = rows.where(F.when(bad, F.raise_error(F.lit("feed-not-utf8"))).otherwise(F.lit(True)))
    return rows.select(*[(bytes_of(f) if f in texts else F.col(f"`{f.name}`")).alias(g.name) for f, g in zip(raw.fields, schema.fields, strict=True)])


def read_odds(spark: SparkSession, path: str) -> DataFrame:
    """Nested odds responses as one row for each outcome; events without outcomes keep a row."""
    raw = spark.read.schema(ODDS).option("mode", "FAILFAST").json(path)
    b = raw.select("id", "commence_time", F.explode_outer("bookmakers").alias("b"))
    m = b.select("id", "commence_time", F.col("b.key").alias("book"), F.explode_outer("b.markets").alias("m"))
    o = m.select("id", "commence_time", "book", F.col("m.key").alias("market"), F.col("m.last_update").alias("last_update"), F.explode_outer("m.outcomes").alias("o"))
    return o.select("id", "commence_time", "book", "market", "last_update", F.col("o.name").alias("side"), F.col("o.description").alias("player"), F.col("o.price").alias("price"), F.col("o.point").alias("point"))


def read_log(spark: SparkSession, path: str, schema: T.StructType, text: str = "text", digest: str = "sha256") -> DataFrame:
    """An append-only JSON lines log. A damaged line, or a text that does not have its digest, fails the read."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    bad = F.col("_corrupt").isNotNull() | (F.col(text).isNotNull() & ~F.coalesce(F.sha2(text, 256) == F.col(digest), F.lit(False)))
    check = F.when(bad, F.raise_error(F.lit("log-line-refused"))).otherwise(F.lit(True))
    return rows.where(check).drop("_corrupt")
