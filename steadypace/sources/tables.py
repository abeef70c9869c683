"""Tables at rest: Parquet, CSV, dictionaries and fitted models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadypace.operators.ols import StepModel


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet with a declared schema, so no file is opened to infer one."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (),
                mode: str = "overwrite") -> None:
    """Parquet. With partition columns, rows are first rebalanced on them, so that a small partition
    is one file and a hot one is split over several writers.

    ``mode="replace_partitions"`` replaces only the partitions that ``df`` has rows of, such as the days of a
    corrected extract, and leaves the files of all others as they are; written again, it gives the same table.
    """
    only_own = mode == "replace_partitions"
    if only_own and not partition_by:
        raise ValueError("replace_partitions needs partition columns")
    if partition_by:
        writer = df.hint("rebalance", *[F.col(c) for c in partition_by]).write.partitionBy(*partition_by)
        if only_own:
            writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        else:
            writer.mode(mode).option("partitionOverwriteMode", "static").parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, path: str | None = None,
                   sort_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """A catalog table hashed by ``keys`` into ``buckets`` files: windows and joins on these keys, or on more
    columns that start with them, read it without an exchange. Rows are hashed before the write, so there is one file per
    bucket and not one per task and bucket. Choose ``buckets`` so that one holds 128 to 512 MB; a hot
    key stays in one bucket, so tables with hot keys are better left unbucketed."""
    writer = df.repartition(buckets, *keys).write.mode(mode).bucketBy(buckets, *keys)
    if sort_by:
        writer = writer.sortBy(*sort_by)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def open_bucketed(spark: SparkSession, table: str, path: str, schema: str, keys: Sequence[str], buckets: int,
                  sort_by: Sequence[str] = ()) -> DataFrame:
    """A bucketed table that another session wrote to ``path``, entered in this session's catalog."""
    names = lambda columns: ", ".join(f"`{c}`" for c in columns)
    ordered = f" SORTED BY ({names(sort_by)})" if sort_by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({schema}) USING parquet "
              f"CLUSTERED BY ({names(keys)}){ordered} INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("header", header).csv(path)


def read_jdbc(spark: SparkSession, options: Mapping[str, str], table: str,
              partition_column: str | None = None, low=None, high=None,
              partitions: int = 1) -> DataFrame:
    """A warehouse table; with a partition column it is read in parallel ranges."""
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table)
    if partition_column:
        reader = reader.options(partitionColumn=partition_column, lowerBound=str(low),
                                upperBound=str(high), numPartitions=str(partitions))
    return reader.load()


def data_dictionary(df: DataFrame, table: str, descriptions: Mapping[str, str]) -> DataFrame:
    """(Field, Table, Description) of every column of ``df``, matched by name."""
    unknown = sorted(set(df.columns) - set(descriptions))
    if unknown:
        raise ValueError(f"no description for {unknown}")
    rows = [(c, table, descriptions[c]) for c in df.columns]
    return df.sparkSession.createDataFrame(rows, "Field string, Table string, Description string")


def table_dictionary(spark: SparkSession, table: str, description: str, row: str) -> DataFrame:
    return spark.createDataFrame(
        [(table, description, row)], "Table string, Description string, RowDescription string"
    )


def save_coefficients(coefficients: DataFrame, path: str) -> None:
    """Fitted coefficients, so that reports do not refit."""
    write_table(coefficients, path)


def load_coefficients(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path)


def save_step_model(spark: SparkSession, model: StepModel, path: str) -> None:
    write_table(model.table(spark), path)


def load_step_model(spark: SparkSession, path: str) -> StepModel:
    return StepModel.from_table(read_table(spark, path))
