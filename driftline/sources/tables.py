"""Contract tables: strict CSV scans, appends, and all-or-nothing replacement."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftline import contract

CORRUPT = "_corrupt_row"


def scan_contract_csv(spark: SparkSession, path, fields, multiline: bool = False) -> DataFrame:
    """All-string rows of a CSV with an exact, ordered header.

    A different header fails the read.  A row with missing or extra fields
    keeps its text in ``_corrupt_row``; empty fields stay empty strings.
    """
    schema = contract.text_schema(fields).add(CORRUPT, "string")
    rows = (
        spark.read.schema(schema).option("header", True).option("enforceSchema", False)
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        .option("quote", '"').option("escape", '"').option("multiLine", multiline)
        .option("columnPruning", False)  # a pruned parse would not notice missing fields
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path))
    return rows.withColumns({name: F.coalesce(F.col(name), F.lit("")) for name in fields})


def split_quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean rows, corrupt rows with their file name and whatever fields were read)."""
    fields = [name for name in rows.columns if name != CORRUPT]
    clean = rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    broken = rows.filter(F.col(CORRUPT).isNotNull()).select(
        F.col("_metadata.file_name").alias("file_name"), F.col(CORRUPT).alias("row_text"),
        F.array(*fields).alias("fields_read"))
    return clean, broken


def scan_logger_csv(spark: SparkSession, path, channels=contract.LOGGER_CHANNELS,
                    shared: bool = False) -> DataFrame:
    """Wide logger files, one per session; the session is the file name.

    Files ``shared`` by many sessions start with a field ``session_id`` instead.
    A UTF-8 byte order mark is skipped by the line reader.
    """
    fields = ("sample_no", "elapsed_ms") + tuple(
        name for c in channels for name in (c, f"{c}_status"))
    if shared:
        return scan_contract_csv(spark, path, ("session_id", *fields))
    rows = scan_contract_csv(spark, path, fields)
    return rows.withColumn(
        "session_id", F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", ""))


def scan_session_files(present: DataFrame, configured: DataFrame, key: str = "file_name") -> DataFrame:
    """Configured files that are missing and present files nobody configured."""
    from driftline.operators.integrity import key_set_difference

    sides = key_set_difference(configured, present.select(key).distinct(), key)
    return sides.select(key, F.when(F.col("side") == "left_only", "missing")
                        .otherwise("unexpected").alias("problem"))


def files_present(spark: SparkSession, path) -> DataFrame:
    """File names and sizes under a path, without reading any content."""
    return spark.read.format("binaryFile").load(path).select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "length")


def append_table(df: DataFrame, path: str, fields, partition_by: list[str] | None = None) -> None:
    """Append rows whose columns are exactly the contract's, in order."""
    if list(df.columns) != list(fields):
        raise ValueError(f"columns {df.columns} do not match the contract {list(fields)}")
    _check_existing(df, path)
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def _check_existing(df: DataFrame, path: str) -> None:
    if not _exists(df.sparkSession, path):
        return
    stored = {(f.name, f.dataType.simpleString()) for f in df.sparkSession.read.parquet(path).schema}
    offered = {(f.name, f.dataType.simpleString()) for f in df.schema}
    if stored != offered:
        raise ValueError(f"table at {path} has another schema: {sorted(stored ^ offered)}")


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _exists(spark: SparkSession, path: str) -> bool:
    system, target = _path(spark, path)
    return system.exists(target)


def _move(spark: SparkSession, source: str, target: str) -> None:
    system, path = _path(spark, target)
    system.mkdirs(path.getParent())
    if not system.rename(_path(spark, source)[1], path):
        raise OSError(f"could not move {source} to {target}")


def write_refuse_or_replace(tables: dict[str, DataFrame], folder: str, overwrite: bool = False,
                            fmt: str = "parquet") -> None:
    """Write several outputs together: refuse if any exists, else stage all and swap.

    Nothing is visible under ``folder`` until every table has been written; a
    failed write leaves existing outputs untouched.  Old outputs are renamed aside, all new
    ones published, and only then the old ones removed; if publishing fails they come back.
    """
    spark = next(iter(tables.values())).sparkSession
    existing = [name for name in tables if _exists(spark, f"{folder}/{name}")]
    if existing and not overwrite:
        raise FileExistsError(f"output already contains {existing}; pass overwrite=True")
    stage = f"{folder}/.stage-{uuid.uuid4().hex}"
    try:
        for name, df in tables.items():
            writer = df.write.format(fmt)
            (writer.option("header", True) if fmt == "csv" else writer).save(f"{stage}/{name}")
        aside, published = [], []
        try:
            for name in existing:
                _move(spark, f"{folder}/{name}", f"{stage}/old/{name}")
                aside.append(name)
            for name in tables:
                _move(spark, f"{stage}/{name}", f"{folder}/{name}")
                published.append(name)
        except Exception:
            for name in published:
                _move(spark, f"{folder}/{name}", f"{stage}/{name}")
            for name in aside:
                _move(spark, f"{stage}/old/{name}", f"{folder}/{name}")
            raise
    finally:
        system, target = _path(spark, stage)
        system.delete(target, True)
