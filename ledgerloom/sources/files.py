"""File sources and sinks: daily price files, filing lists, zipped documents, configuration, versioned output."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAILY = "IDX_NM string, BAS_DD string, CLSPRC_IDX string, MKTCAP string"
FILING_LIST = "status string, page_no bigint, total_page bigint, list array<struct<corp_code: string, rcept_no: string, report_nm: string, rcept_dt: string>>"


def _amount(column: str):
    return F.nullif(F.regexp_replace(column, "[, ]", ""), F.lit("-"))


def daily_prices(spark: SparkSession, path: str) -> DataFrame:
    """Cached daily index files (one JSON document a day, rows under ``output``): index_name, date, value, cap."""
    rows = spark.read.schema(f"output array<struct<{', '.join(f'{x.split()[0]}: {x.split()[1]}' for x in DAILY.split(', '))}>>").json(path, multiLine=True)
    return rows.select(F.inline("output")).select(
        F.col("IDX_NM").alias("index_name"),
        F.try_to_date("BAS_DD", "yyyyMMdd").alias("date"),
        _amount("CLSPRC_IDX").try_cast("double").alias("value"),
        _amount("MKTCAP").try_cast("bigint").alias("cap"),
    )


def filing_list(spark: SparkSession, path: str) -> DataFrame:
    """Cached pages of a filing list; a list is complete if every page up to total_page is there."""
    pages = spark.read.schema(FILING_LIST).json(path, multiLine=True).filter("status = '000'")
    whole = pages.agg(F.max("total_page").alias("t"), F.count_distinct("page_no").alias("n")).select((F.col("t") == F.col("n")).alias("complete"))
    return pages.select(F.inline("list")).dropDuplicates(["rcept_no"]).join(F.broadcast(whole))


def zipped_documents(spark: SparkSession, path: str, limit: int = 200_000_000) -> DataFrame:
    """Every .xml member of zip archives: file, member, content; members beyond ``limit`` bytes come without content."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        out += [(name, m.filename, archive.read(m) if m.file_size <= limit else None) for m in archive.infolist() if m.filename.lower().endswith(".xml")]
                except zipfile.BadZipFile:
                    out.append((name, None, None))
            yield pd.DataFrame(out, columns=["file", "member", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(scan, "file string, member string, content binary")


def json_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def publish(df: DataFrame, path: str, version: str, fingerprint: str | None = None) -> None:
    """Write a version of a result: the files of a version appear together, an existing version is an error.

    Spark's commit protocol moves task output into place on success only, and
    the version is part of the path, so readers never see half a version.
    """
    out = df if fingerprint is None else df.withColumn("fingerprint", F.lit(fingerprint))
    out.write.mode("error").parquet(f"{path}/version={version}")


def snapshot_cache(vectors: DataFrame, path: str, index_column: str = "index_version") -> DataFrame:
    """Vectors kept by index version with a hash of their content; read back, rows whose hash differs are left out."""
    hashed = vectors.withColumn("content_hash", F.xxhash64(*[c for c in vectors.columns if c != index_column]))
    hashed.write.mode("overwrite").partitionBy(index_column).parquet(path)
    back = vectors.sparkSession.read.schema(hashed.schema).parquet(path)
    return back.filter(F.col("content_hash") == F.xxhash64(*[c for c in vectors.columns if c != index_column])).drop("content_hash")


def by_parameters(spark: SparkSession, sql: str, parameters: dict | None = None, **tables: DataFrame) -> DataFrame:
    """Read-only SQL with named parameters; anything but a SELECT is refused."""
    if not sql.lstrip().upper().startswith(("SELECT ", "WITH ")):
        raise ValueError("only SELECT statements are accepted")
    return spark.sql(sql, args=parameters or {}, **tables)
