"""Fingerprints of files and tables, inventories, and manifests that name their inputs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

#: A row's digest is added in parts of 15 hexadecimal digits, each as three sums of 20 bits.
PARTS, DIGITS, SUM_BITS = 4, 15, 20


def row_digest(columns) -> Column:
    """SHA-256 of a row's canonical text: fields in order, null distinct from empty."""
    fields = [F.col(c) if isinstance(c, str) else c for c in columns]
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def fingerprint_sums(digest: Column) -> dict[str, Column]:
    """Row count and the sums that make up a table's fingerprint.

    Sums of 20 bits are longs, which stay in generated code and hold eight million million rows.
    """
    sums = {"rows": F.count(F.lit(1))}
    for part in range(PARTS):
        value = F.conv(F.substring(digest, 1 + DIGITS * part, DIGITS), 16, 10).cast("bigint")
        for i in range(3):
            piece = F.shiftright(value, SUM_BITS * i).bitwiseAND(F.lit((1 << SUM_BITS) - 1))
            sums[f"sum_{part}_{i}"] = F.coalesce(F.sum(piece), F.lit(0))
    return sums


def fingerprint_text(sums) -> Column:
    """The digest of `fingerprint_sums`: the parts' sums as decimal numbers."""
    def whole(part: int) -> Column:
        pieces = [sums(f"sum_{part}_{i}").cast("decimal(38,0)") * F.lit(1 << SUM_BITS * i)
                  for i in range(3)]
        return (pieces[0] + pieces[1] + pieces[2]).cast("decimal(38,0)").cast("string")

    return F.concat_ws("-", *[whole(part) for part in range(PARTS)])


def table_fingerprint(df: DataFrame, columns=None) -> DataFrame:
    """Order-free fingerprint of a table of any size: row count and summed row digests.

    240 bits of a row's digest are added as four numbers.  Equal tables have equal fingerprints
    whatever their layout; duplicates count, since digests are added, not xor-ed.  ``columns``
    are names or expressions.
    """
    rows = df.select(row_digest(columns or df.columns).alias("row"))
    sums = rows.agg(*[c.alias(n) for n, c in fingerprint_sums(F.col("row")).items()])
    return sums.select(F.col("rows").alias("row_count"), fingerprint_text(F.col).alias("digest"))


def file_fingerprints(spark: SparkSession, path) -> DataFrame:
    """SHA-256 per file of at most 2 GB, which is read as one value; a larger one fails the job.

    `file_digests` takes files of any size.
    """
    return spark.read.format("binaryFile").load(path).select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "length",
        F.sha2("content", 256).alias("sha256"))


#: Fixed values of `file_digests`: a prime of 256 bits and the base of its polynomial.
PRIME = (1 << 256) - 189
BASE = int.from_bytes(b"driftline: digest of digests....", "big")


def file_digests(spark: SparkSession, path) -> DataFrame:
    """Digest of every file, whatever its size and however Spark splits it.

    Leaves are the SHA-256 of the file's lines (bytes between line feeds).  A split folds its
    leaves in order into a polynomial, and the polynomials of consecutive splits compose, so the
    root does not show where a file was split.  Tasks hold one batch of lines.  It tells changed
    files from equal ones; against forged files use `file_fingerprints`.  Spark's scans leave
    empty files out, so they have no row.
    """
    prime, base = PRIME, BASE
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("line"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        now, count, value = None, 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{
                "file": now[0], "start": now[1], "lines": count,
                "value": value.to_bytes(32, "big")}])

        for batch in batches:
            for file, start, line in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (file, start):
                    if now is not None:
                        yield row()
                    now, count, value = (file, start), 0, 0
                leaf = int.from_bytes(hashlib.sha256(line).digest(), "big")
                value, count = (value * base + leaf) % prime, count + 1
        if now is not None:
            yield row()

    def join(table: pa.Table) -> pa.Table:
        value, count = 0, 0
        for row in sorted(table.to_pylist(), key=lambda r: r["start"]):
            value = (value * pow(base, row["lines"], prime)
                     + int.from_bytes(row["value"], "big")) % prime
            count += row["lines"]
        return pa.Table.from_pylist([{
            "file": table["file"][0].as_py(), "lines": count, "value": value.to_bytes(32, "big")}])

    splits = lines.mapInArrow(fold, "file string, start bigint, lines bigint, value binary")
    found = splits.groupBy("file").applyInArrow(join, "file string, lines bigint, value binary")
    # lengths tell whether the last line ends
    listed = spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("file"), "length")
    whole = listed.join(found, "file", "left").withColumn(
        "lines", F.coalesce("lines", F.lit(0).cast("bigint")))
    return whole.select(
        F.regexp_extract("file", r"([^/]+)$", 1).alias("file_name"), "length", "lines",
        F.sha2(F.concat_ws(":", "length", "lines", F.coalesce(F.hex("value"), F.lit("-"))), 256)
        .alias("digest"))


def inventory_check(declared: DataFrame, actual: DataFrame, key: str = "item") -> DataFrame:
    """Inventory rows that are missing, unexpected, or differ in rows or digest."""
    joined = declared.select(key, F.col("row_count").alias("declared_rows"),
                             F.col("digest").alias("declared_digest")).join(
        actual.select(key, F.col("row_count").alias("actual_rows"),
                      F.col("digest").alias("actual_digest")), key, "full_outer")
    problem = (
        F.when(F.col("actual_digest").isNull(), "MISSING")
        .when(F.col("declared_digest").isNull(), "UNEXPECTED")
        .when(F.col("declared_rows") != F.col("actual_rows"), "ROW_COUNT")
        .when(F.col("declared_digest") != F.col("actual_digest"), "DIGEST"))
    return joined.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def run_manifest(stage: str, df: DataFrame, reason: str, version: str) -> DataFrame:
    """One summary row of a stage: total, valid and excluded counts, and counts per reason."""
    by_reason = df.groupBy(reason).agg(F.count(F.lit(1)).alias("n"))
    excluded = F.col(reason) != ""
    return by_reason.agg(
        F.lit(stage).alias("stage"), F.lit(version).alias("version"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("candidate_count"),
        F.coalesce(F.sum(F.when(~excluded, F.col("n"))), F.lit(0)).alias("valid_count"),
        F.coalesce(F.sum(F.when(excluded, F.col("n"))), F.lit(0)).alias("excluded_count"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(
            excluded, F.struct(F.col(reason), F.col("n")))))).alias("exclusion_counts"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    """One JSON document; refuses to replace an existing one."""
    manifest.coalesce(1).write.mode("errorifexists").json(path)


MANIFEST = ("stage string, version string, candidate_count bigint, valid_count bigint, "
            "excluded_count bigint, exclusion_counts map<string, bigint>, columns array<string>, "
            "digest string, inputs array<struct<path: string, stage: string, digest: string>>")


def write_stage(df: DataFrame, folder: str, stage: str, version: str, inputs=(),
                reason: str | None = None, reasons=(), columns=None) -> DataFrame:
    """Write a stage's rows with a manifest that names the digests of the stages it was made from.

    Counts and digest are observed while the rows are written, so they cost no second scan.
    ``inputs`` are folders of earlier stages; ``reason`` is a column whose empty value marks valid
    rows, ``reasons`` its vocabulary (others count as ``OTHER``).  The rows lie in ``rows``, the
    document in ``manifest``; existing ones are not replaced.  Returns the stored rows.
    """
    spark, names = df.sparkSession, list(columns or df.columns)
    made_from = [{"path": path, "stage": m["stage"], "digest": m["digest"]}
                 for path in inputs for m in [read_manifest(spark, path)]]
    metrics = fingerprint_sums(row_digest(names))
    if reason is not None:
        for i, name in enumerate(reasons):
            metrics[f"reason_{i}"] = F.count_if(F.col(reason) == name)
        metrics["valid"] = F.count_if(F.col(reason) == "")
    seen = Observation()
    observed = df.observe(seen, *[c.alias(n) for n, c in metrics.items()])
    observed.write.mode("errorifexists").parquet(f"{folder}/rows")
    found = {name: int(value) for name, value in seen.get.items()}
    total, valid = found["rows"], found.get("valid", found["rows"])
    counts = {name: found[f"reason_{i}"] for i, name in enumerate(reasons) if found[f"reason_{i}"]}
    if total - valid > sum(counts.values()):
        counts["OTHER"] = total - valid - sum(counts.values())
    digest = "-".join(str(sum(found[f"sum_{p}_{i}"] << SUM_BITS * i for i in range(3)))
                      for p in range(PARTS))
    document = (stage, version, total, valid, total - valid, counts, names, digest, made_from)
    write_manifest(spark.createDataFrame([document], MANIFEST), f"{folder}/manifest")
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")


def read_manifest(spark: SparkSession, folder: str):
    rows = spark.read.schema(MANIFEST).json(f"{folder}/manifest").limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{folder} does not hold exactly one manifest")
    return rows[0]


def chain_problems(spark: SparkSession, folder: str) -> list[tuple[str, str, str]]:
    """(folder, stage, problem) of a stage and of all stages that it was made from.

    ``ROWS_CHANGED``: stored rows no longer have the digest of their manifest.  ``INPUT_REPLACED``: an
    input's manifest has another digest than the one that this stage was made from.  Every stage
    is scanned once.
    """
    problems, open_, judged = [], [folder], set()
    while open_:
        path = open_.pop()
        if path in judged:
            continue
        judged.add(path)
        manifest = read_manifest(spark, path)
        actual = table_fingerprint(spark.read.parquet(f"{path}/rows"), manifest["columns"]).first()
        if (actual["row_count"], actual["digest"]) != (
                manifest["candidate_count"], manifest["digest"]):
            problems.append((path, manifest["stage"], "ROWS_CHANGED"))
        for source in manifest["inputs"] or []:
            if read_manifest(spark, source["path"])["digest"] != source["digest"]:
                problems.append((path, manifest["stage"], "INPUT_REPLACED"))
            open_.append(source["path"])
    return sorted(problems)
