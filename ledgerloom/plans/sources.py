"""Queries of the file sources and sinks: a test table is written as the files of a source and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.registry import Registry, Tables
from ledgerloom.session import shared_folder
from ledgerloom.sources import files

R = Registry()
QUERIES, SQL = R.queries, R.sql


def place(t: Tables, name: str) -> str:
    """A fresh path in the cluster's shared folder; where none is named, in a temporary folder, but only on a single machine."""
    try:
        base = shared_folder(t.spark)
    except ValueError:
        if not t.spark.sparkContext.master.startswith("local"):
            raise
        base = tempfile.mkdtemp(prefix="ledgerloom-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


@R.add("S7_filing_list", "SELECT DISTINCT rcept_no, corp_code, dart_report_name AS report_nm, true AS complete FROM filings WHERE rcept_no IS NOT NULL AND corp_code IS NOT NULL AND year IS NOT NULL AND dart_report_name IS NOT NULL")
def s7(t: Tables) -> DataFrame:
    """A filing list in pages, one JSON document a company and year."""
    rows = t.filings.select("rcept_no", "corp_code", F.col("dart_report_name").alias("report_nm"), F.date_format("rcept_dt", "yyyyMMdd").alias("rcept_dt"), "year").filter("rcept_no IS NOT NULL AND corp_code IS NOT NULL AND report_nm IS NOT NULL AND year IS NOT NULL").dropDuplicates(["rcept_no"])
    # a page holds one year's filings of one company
    numbered = rows.groupBy("corp_code", "year").agg(F.collect_list(F.struct("corp_code", "rcept_no", "report_nm", "rcept_dt")).alias("list"))
    total = numbered.agg(F.count(F.lit(1)).alias("total_page"))
    pages = numbered.join(F.broadcast(total)).select(F.lit("000").alias("status"), F.xxhash64("corp_code", "year").alias("page_no"), "total_page", "list")
    path = place(t, "filing-list")
    pages.write.option("maxRecordsPerFile", 1).json(path)
    return files.filing_list(t.spark, path).select("rcept_no", "corp_code", "report_nm", "complete")


_DAYS = "SELECT event_type AS index_name, ts::DATE AS date, round(max(value), 4)::DOUBLE AS value, count(*) AS cap FROM events WHERE value IS NOT NULL GROUP BY 1, 2"


@R.add("S9_daily_prices", _DAYS)
def s9(t: Tables) -> DataFrame:
    """Daily files of all series of a day."""
    d = t.events.filter("value IS NOT NULL").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.max("value"), 4).alias("v"), F.count(F.lit(1)).alias("n"))
    row = F.struct(F.col("event_type").alias("IDX_NM"), F.date_format("day", "yyyyMMdd").alias("BAS_DD"), F.col("v").cast("string").alias("CLSPRC_IDX"), F.format_number("n", 0).alias("MKTCAP"))
    path = place(t, "daily-prices")
    # a day holds one row a series
    d.groupBy("day").agg(F.collect_list(row).alias("output")).select("output").write.option("maxRecordsPerFile", 1).json(path)
    return files.daily_prices(t.spark, path)


@R.add("S11_json_config", "SELECT n_name AS sector, n_nationkey AS membership FROM nation")
def s11(t: Tables) -> DataFrame:
    path = place(t, "config")
    t.nation.select(F.col("n_name").alias("sector"), F.col("n_nationkey").cast("bigint").alias("membership")).write.option("maxRecordsPerFile", 1).json(path)
    return files.json_config(t.spark, path).select("sector", F.col("membership").cast("int").alias("membership"))


@R.add("S12_versioned_sink", "SELECT s_suppkey, s_name, 'v1' AS version FROM supplier")
def s12(t: Tables) -> DataFrame:
    """A published version, read back; a second writing of the version is refused."""
    path = place(t, "published")
    rows = t.supplier.select("s_suppkey", "s_name")
    files.publish(rows, path, "v1", "f")
    try:
        files.publish(rows, path, "v1", "f")
    except Exception as refused:
        if "PATH_ALREADY_EXISTS" not in str(refused):
            raise
    return t.spark.read.parquet(path).select("s_suppkey", "s_name", "version")


@R.add("S13_vector_snapshot", "SELECT DISTINCT embedding_id, index_version, len(embedding) AS numbers FROM chunk_embeddings WHERE embedding_id IS NOT NULL AND index_version IS NOT NULL")
def s13(t: Tables) -> DataFrame:
    """Vectors cached by index version with a hash of their content, read back."""
    v = t.chunk_embeddings.filter("embedding_id IS NOT NULL AND index_version IS NOT NULL").select("embedding_id", "embedding", "index_version").distinct()
    back = files.snapshot_cache(v, place(t, "vectors"))
    return back.select("embedding_id", "index_version", F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("bigint").alias("numbers")).distinct()
