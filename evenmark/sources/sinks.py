"""Sinks: append by snapshot, content-addressed append, pinned datasets and reports."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.feeds import upsert
from ..operators.forecast import content_digest, field_text


def append_evidence(rows: DataFrame, path: str, version: str) -> None:
    """Normalized rows under their feed, snapshot and the normalizer's version, so that readers prune all three.

    What stands under the same three is replaced, and nothing else is touched: a snapshot written twice, by a retry too,
    stands there once. A snapshot is written whole.
    """
    keyed = rows.withColumn("normalizer_version", F.lit(version))
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feed", "snapshot_id", "normalizer_version").parquet(path)


def merge_rows(spark: SparkSession, path: str, new: DataFrame, key: list[str], order: list[str], buckets: int = 64) -> None:
    """Upserts rows by natural key into the table at `path`, which is kept in buckets of the key's hash; new rows win over stored ones, later ones in `order` over earlier.

    Only buckets that a new row falls into are read and written; the files of all others stay as they are. The merged
    buckets are written aside first, so that a failed merge leaves the table whole and can run again. The number of buckets
    belongs to the table.
    """
    rows = new.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    aside = f"{path}-aside-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs
    table = hadoop.Path(path)
    system = table.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(table):
        hit = [r.bucket for r in rows.select("bucket").distinct().collect()]  # `buckets` at most
        stored = spark.read.schema(rows.schema).parquet(path).where(F.col("bucket").isin(hit) if hit else F.lit(False))
        rows = upsert(stored, rows, key, order)
    else:
        rows = upsert(rows.limit(0), rows, key, order)
    rows.write.partitionBy("bucket").parquet(aside)
    spark.read.schema(rows.schema).parquet(aside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    system.delete(hadoop.Path(aside), True)


def quote_sets(quotes: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, content_hash, quotes): one row for each observation's set of quotes, hashed in sorted order."""
    line = field_text([F.col(c) for c in fields])
    return quotes.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("content_hash"), F.count("*").alias("quotes"))


def new_quote_sets(incoming: DataFrame, stored: DataFrame, scope: list[str], order: str) -> DataFrame:
    """Incoming sets whose hash their scope does not hold yet, each once, at its first observation."""
    w = Window.partitionBy(*scope, "content_hash").orderBy(order)
    one = incoming.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return one.join(stored.select(*scope, "content_hash"), [*scope, "content_hash"], "left_anti")


MANIFEST = "digest string, rows long, bytes long, key array<string>, fields array<string>, spec string, inputs long, inputs_digest string, exclusions map<string, long>"


def publish_dataset(rows: DataFrame, base: str, key: list[str], fields: list[str], inputs: DataFrame | None = None, exclusions: DataFrame | None = None, spec: str = "") -> str:
    """Writes rows, their inputs (one column of ids) and a manifest under base/<digest> unless they stand there; returns that folder.

    The manifest holds the content digest of the rows, their number and the files' bytes, the key and fields, the number and
    digest of the inputs, and how many rows were left out for which reason (`exclusions`: reason, rows). All is written
    aside, and only then the folder gets its name: a folder with a digest's name is whole.
    """
    spark = rows.sparkSession
    aside = f"{base}/_aside-{uuid.uuid4().hex}"
    rows.write.parquet(f"{aside}/rows")
    got = content_digest(spark.read.schema(rows.schema).parquet(f"{aside}/rows"), [F.col(c) for c in key], [F.col(c) for c in fields]).first()
    if inputs is None:
        inputs = spark.createDataFrame([], "input string")
    used = inputs.toDF("input").dropna().distinct()
    used.write.parquet(f"{aside}/inputs")
    sources = content_digest(spark.read.schema(used.schema).parquet(f"{aside}/inputs"), [F.col("input")], [F.col("input")]).first()
    left_out = {r[0]: r[1] for r in exclusions.collect()} if exclusions is not None else {}  # one row for each reason
    line = (got["digest"], got["rows"], _size(spark, f"{aside}/rows"), key, fields, spec, sources["rows"], sources["digest"], left_out)
    spark.createDataFrame([line], MANIFEST).coalesce(1).write.json(f"{aside}/manifest")
    name = hashlib.sha256("\n".join([spec, got["digest"], sources["digest"]]).encode()).hexdigest()
    hadoop = spark._jvm.org.apache.hadoop.fs
    here, there = hadoop.Path(aside), hadoop.Path(f"{base}/{name}")
    system = there.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(there) or not system.rename(here, there):
        system.delete(here, True)
    return f"{base}/{name}"


def _size(spark: SparkSession, path: str) -> int:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The stored manifest of a published dataset: one row."""
    return spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(f"{folder}/manifest")


def read_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a pinned dataset; fails if their files' bytes, their number or their digest is not the manifest's, or the inputs are others."""
    m = read_manifest(spark, folder).first()
    if _size(spark, f"{folder}/rows") != m["bytes"]:
        raise ValueError("dataset-size-changed")
    rows, used = spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/inputs")
    got = content_digest(rows, [F.col(c) for c in m["key"]], [F.col(c) for c in m["fields"]]).first()
    if (got["rows"], got["digest"]) != (m["rows"], m["digest"]):
        raise ValueError("dataset-content-changed")
    sources = content_digest(used, [F.col("input")], [F.col("input")]).first()
    if (sources["rows"], sources["digest"]) != (m["inputs"], m["inputs_digest"]):
        raise ValueError("dataset-inputs-changed")
    return rows


def encode_report(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as text with infinities by name; NaN fails."""
    for c in columns:
        x = F.col(c)
        rows = rows.withColumn(c, F.when(F.isnan(x), F.raise_error(F.lit("invalid-nonfinite-report-value"))).when(x == float("inf"), "positive-infinity").otherwise(x.cast("string")))
    return rows


def write_report(rows: DataFrame, path: str, columns: list[str]) -> None:
    encode_report(rows, columns).write.mode("errorifexists").json(path)
