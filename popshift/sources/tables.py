"""Reading and writing tables: Parquet, typed CSV, reference snapshots, result sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a table whose scan has fewer partitions than there are cores is dealt out; a large one stays."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dataset(spark: SparkSession, data: DataFrame | str, schema: T.StructType | str | None = None) -> DataFrame:
    """A DataFrame as it is, or a path: .csv with a header (typed by schema, else inferred), anything else Parquet."""
    if isinstance(data, DataFrame):
        return data
    if data.rstrip("/").endswith(".csv"):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(data)
    return spark.read.parquet(data)


def typed_csv(spark: SparkSession, path: str, schema: T.StructType | str, timestamps: Mapping[str, str] = {}, renames: Mapping[str, str] = {}) -> DataFrame:
    """A CSV with declared types; text columns of `timestamps` are parsed by their format, then columns are renamed."""
    df = spark.read.option("header", True).schema(schema).csv(path)
    df = df.withColumns({c: F.try_to_timestamp(F.col(c), F.lit(f)).cast("timestamp_ntz") for c, f in timestamps.items()}) if timestamps else df
    return df.withColumnsRenamed(dict(renames))


def aligned(df: DataFrame, like: T.StructType) -> DataFrame:
    """df's columns cast to the types that columns of the same name (any case) have in `like`; text that isn't one is null."""
    kinds = {f.name.upper(): f.dataType for f in like}
    return df.select([F.col(f"`{c}`").try_cast(kinds[c.upper()]).alias(c) if c.upper() in kinds else F.col(f"`{c}`") for c in df.columns])


def save_reference(df: DataFrame, path: str) -> None:
    """A baseline is written once; a second run must not replace it."""
    df.write.mode("errorifexists").parquet(path)


def reference(spark: SparkSession, path: str, current: DataFrame, bootstrap: bool = False) -> DataFrame:
    """The saved baseline in the current table's types. With bootstrap, the first run's table becomes the baseline."""
    if bootstrap:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
            save_reference(current, path)
    return aligned(spark.read.parquet(path), current.schema)


def write_result(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Results are small tables: one CSV file with a header, or Parquet."""
    if kind == "csv":
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").parquet(path)


def publish(df: DataFrame, name: str) -> None:
    """Replace a catalog table."""
    df.write.mode("overwrite").saveAsTable(name)


def labelled(df: DataFrame, meaning: Mapping[str, str]) -> DataFrame:
    """Column meanings as metadata that sinks and catalogs keep."""
    return df.select([F.col(c).alias(c, metadata={"comment": meaning[c]}) if c in meaning else F.col(c) for c in df.columns])


def run_log(spark: SparkSession, rows: list[tuple[str, str, float]]) -> DataFrame:
    """(step, status, seconds) as a table to append."""
    return spark.createDataFrame(rows, "step string, status string, seconds double")


def kpi_row(spark: SparkSession, kpi_id: str, value: float | None) -> DataFrame:
    """A KPI with its success flag: no value, no success."""
    return spark.createDataFrame([(kpi_id, value, "Y" if value is not None else "N")], "kpi_id string, kpi_value double, success string")
