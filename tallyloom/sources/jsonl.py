"""JSON-lines sources and sinks: strict typed scans with rejects, run partitions, paired manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallyloom.session import drop_path


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return bool(found)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of all matching files with their file name; a missing path is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("source_file", T.StringType())]))
    return spark.read.schema(schema).json(path).withColumn("source_file", F.col("_metadata.file_name"))


def strict_scan(spark: SparkSession, path: str, schema: T.StructType, key: str) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejects): rejects are lines that do not parse, have unknown or missing fields,
    values of another type, or a key that another line also has. Nothing is raised."""
    if not exists(spark, path):
        empty = spark.createDataFrame([], schema)
        return empty, spark.createDataFrame([], "line string, source_file string, reasons array<string>")
    known = F.array(*[F.lit(n) for n in schema.names])
    t = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("source_file")).where("trim(line) <> ''")
    t = t.withColumn("keys", F.json_object_keys("line")).withColumn("row", F.from_json("line", schema, {"mode": "PERMISSIVE"}))
    t = t.withColumn("raw", F.from_json("line", "map<string,string>"))
    wrong = [F.when(F.col("raw")[n].isNotNull() & F.col("row")[n].isNull(), F.lit(f"type:{n}")) for n in schema.names]
    reasons = F.array_compact(
        F.array(
            F.when(F.col("keys").isNull(), "not_json"),
            F.when(F.size(F.array_except("keys", known)) > 0, F.concat(F.lit("unknown_fields:"), F.array_join(F.array_sort(F.array_except("keys", known)), "|"))),
            F.when(F.size(F.array_except(known, "keys")) > 0, F.concat(F.lit("missing_fields:"), F.array_join(F.array_sort(F.array_except(known, "keys")), "|"))),
            *wrong,
        )
    )
    t = t.withColumn("reasons", reasons)
    doubles = t.where("size(reasons) = 0").groupBy(F.col("row")[key].alias("_key")).agg(F.count("*").alias("n")).where("n > 1")
    t = t.join(doubles, F.col("row")[key] == F.col("_key"), "left").withColumn("reasons", F.when(F.col("n") > 1, F.array_append("reasons", F.lit("duplicate_key"))).otherwise(F.col("reasons")))
    return t.where("size(reasons) = 0").select("row.*"), t.where("size(reasons) > 0").select("line", "source_file", "reasons")


def partition_by_run(spark: SparkSession, path: str, run_id: str) -> tuple[DataFrame, DataFrame]:
    """(kept lines, removed lines), byte for byte, by the run id inside each line."""
    t = spark.read.text(path)
    own = F.coalesce(F.get_json_object("value", "$.run_id") == run_id, F.lit(False))
    return t.where(~own), t.where(own)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_pair(body: DataFrame, manifest: DataFrame, path: str) -> None:
    """Body and manifest side by side; if the second write fails, the first is taken back."""
    body.write.mode("errorifexists").json(f"{path}/body")
    try:
        manifest.write.mode("errorifexists").json(f"{path}/manifest")
    except Exception:
        drop_path(body.sparkSession, f"{path}/body")
        raise


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)
