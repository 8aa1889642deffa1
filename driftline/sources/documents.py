"""JSON documents: manifests, configurations and models."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from driftline.functions.ordinal import OrdinalModel

MODEL_SCHEMA = T.StructType([
    T.StructField("model_artifact_version", T.StringType()),
    T.StructField("model_family", T.StringType()),
    T.StructField("feature_order", T.ArrayType(T.StringType())),
    T.StructField("class_order", T.ArrayType(T.StringType())),
    T.StructField("scaler", T.StructType([
        T.StructField("mean", T.ArrayType(T.DoubleType())),
        T.StructField("scale", T.ArrayType(T.DoubleType()))])),
    T.StructField("beta", T.ArrayType(T.DoubleType())),
    T.StructField("theta", T.ArrayType(T.DoubleType())),
])
ORIGIN_SCHEMA = T.StructType([T.StructField("dataset_origin", T.StringType())])


def scan_json_documents(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """One row per document; text that is no JSON object keeps ``_corrupt_row``."""
    with_corrupt = T.StructType([*schema.fields, T.StructField("_corrupt_row", T.StringType())])
    return (spark.read.schema(with_corrupt).option("multiLine", True)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_row")
            .json(path).withColumn("file_name", F.col("_metadata.file_name")))


def scan_whole_documents(spark: SparkSession, path, fields: dict[str, str],
                         shared: bool = False) -> DataFrame:
    """One row per file: its JSON as VARIANT and the required ``fields`` (name to SQL type).

    Parquet files ``shared`` by many documents have one in each row, as text in column ``value``.

    ``problem`` is ``NOT_JSON`` for text that does not parse (or is beyond what a VARIANT holds),
    ``NOT_OBJECT`` for another JSON value, ``SCHEMA`` where a field is missing, null or of another
    JSON type; typed fields are null then.  Columns of the path's partitions are kept.
    """
    files = spark.read.parquet(path) if shared else spark.read.text(path, wholetext=True)
    files = files.withColumnRenamed("value", "_body")
    others = [c for c in files.columns if c != "_body"]
    parsed = files.select(*others, F.col("_metadata.file_name").alias("file_name"),
                          F.try_parse_json("_body").alias("document"))
    kind = F.schema_of_variant("document")
    shapes = {"string": ["STRING"], "boolean": ["BOOLEAN"], "bigint": ["BIGINT"],
              "double": ["BIGINT", "DOUBLE", "DECIMAL"]}

    def fits(name: str, to: str) -> Column:
        found = F.schema_of_variant(F.try_variant_get("document", f"$.{name}", "variant"))
        return F.coalesce(F.regexp_extract(found, "^[A-Z]+", 0).isin(shapes[to]), F.lit(False))

    complete = F.lit(True)
    for name, to in fields.items():
        complete = complete & fits(name, to)
    problem = (F.when(F.col("document").isNull(), "NOT_JSON")
               .when(~kind.startswith("OBJECT<"), "NOT_OBJECT")
               .when(~complete, "SCHEMA").otherwise(""))
    judged = parsed.withColumn("problem", problem)
    return judged.select(
        *others, "file_name", "problem", "document",
        *[F.when(F.col("problem") == "", F.try_variant_get("document", f"$.{name}", to)).alias(name)
          for name, to in fields.items()])


def parse_json_rows(df: DataFrame, body: str, schema: T.StructType, name: str = "document") -> DataFrame:
    """JSON text column to a struct; null where the text is no object of that shape."""
    is_object = F.coalesce(F.json_object_keys(body).isNotNull(), F.lit(False))
    return df.withColumn(name, F.when(is_object, F.from_json(body, schema)))


def write_model(spark: SparkSession, model: OrdinalModel, path: str) -> None:
    """The model as one JSON document of ``MODEL_SCHEMA``; refuses to replace an existing one."""
    document = (model.version, "ordinal_logistic", list(model.features), list(model.classes),
                (list(model.mean), list(model.scale)), list(model.beta), list(model.theta))
    spark.createDataFrame([document], MODEL_SCHEMA).coalesce(1).write.mode("errorifexists").json(path)


def read_model(spark: SparkSession, path: str) -> OrdinalModel:
    """A model from one document; refuses several, broken ones and sizes that do not fit."""
    rows = scan_json_documents(spark, path, MODEL_SCHEMA).limit(2).collect()
    if len(rows) != 1 or rows[0]["_corrupt_row"] is not None:
        raise ValueError(f"{path} does not hold exactly one model document")
    row = rows[0]
    n, k = len(row.feature_order or []), len(row.class_order or [])
    parts = {"mean": row.scaler and row.scaler.mean, "scale": row.scaler and row.scaler.scale,
             "beta": row.beta, "theta": row.theta}
    sizes = {"mean": n, "scale": n, "beta": n, "theta": k - 1}
    wrong = [name for name, values in parts.items() if values is None or None in values
             or len(values) != sizes[name] or not all(map(math.isfinite, values))]
    if not n or k < 2 or wrong:
        raise ValueError(f"{path} is no model: {', '.join(wrong) or 'no features or classes'}")
    return OrdinalModel(**{name: tuple(values) for name, values in parts.items()},
                        features=tuple(row.feature_order), classes=tuple(row.class_order),
                        version=row.model_artifact_version)


def model_rows(documents: DataFrame) -> DataFrame:
    """Model documents as rows with array parameters."""
    return documents.select(
        F.col("file_name").alias("model_id"), F.col("scaler.mean").alias("mean"),
        F.col("scaler.scale").alias("scale"), "beta", "theta")
