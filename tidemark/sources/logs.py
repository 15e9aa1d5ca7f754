"""Controller log files: schemas of each log version, batch reader, writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

RAW = "__raw"
TEXT_TIME = T.StructField("timestamp", T.StringType())


def _doubles(names) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


def _strings(names) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


SETS = ["chill_set", "severe_set", "extreme_set"]
HEATERS = ["chill_heater", "severe_heater", "extreme_heater"]


def wide_schema(probes, sets: bool = True, heaters: bool = True) -> T.StructType:
    """Schema of the wide log; older versions lack the heater states or the set points."""
    fields = [TEXT_TIME] + (_doubles(SETS) if sets else []) + (_strings(HEATERS) if heaters else [])
    return T.StructType(fields + _doubles(probes))


def mixing_schema(probes) -> T.StructType:
    """Schema of the mixing-tank log."""
    return T.StructType([TEXT_TIME] + _doubles(["temp_set"]) + _strings(["heater_status"]) + _doubles(probes))


def scan_logs(spark: SparkSession, path: str, schema: T.StructType, ragged: str = "drop_extra") -> DataFrame:
    """Read every log CSV directly under ``path`` (sub-folders are skipped), with the file as ``run_id``.

    Fields beyond the schema (a trailing comma, ragged rows) are dropped; with ``ragged="keep_raw"`` such rows
    carry their text in ``raw``. Short rows are padded with NULL.
    """
    full = T.StructType(schema.fields + [T.StructField(RAW, T.StringType())])
    df = (
        spark.read.schema(full)
        .option("header", True)
        .option("enforceSchema", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", RAW)
        .option("recursiveFileLookup", False)
        .option("pathGlobFilter", "*.csv")
        .csv(path)
    )
    named = [F.col(f.name) for f in schema.fields]
    extra = [F.col(RAW).alias("raw")] if ragged == "keep_raw" else []
    return df.select(*named, *extra, F.col("_metadata.file_name").alias("run_id"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None, mode: str = "overwrite") -> None:
    """Write one logical dataset; CSV gets a header line per file."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(fmt)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """Read back what ``write_table`` wrote."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path) if fmt == "parquet" else reader.option("header", True).csv(path)
