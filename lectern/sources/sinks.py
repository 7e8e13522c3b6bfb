"""Exports: tables, delimited text, and bundles with checksums that can be validated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partitions: list[str] | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def write_delimited(df: DataFrame, path: str, separator: str = "\t", by: list[str] | None = None) -> None:
    """Delimited text with a header, a folder for each value of ``by``; arrays and structs as JSON."""
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")]
    flat = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
    writer = flat.write.mode("overwrite").option("header", True).option("sep", separator).option("emptyValue", "")
    (writer.partitionBy(*by) if by else writer).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def table_digest(df: DataFrame, name: str) -> DataFrame:
    """One row: name, rows and a checksum that doesn't depend on the rows' order, and that any engine with SHA-256 computes alike:
    the sum of the first 15 hexadecimal digits of each row's columns as text, by name, with the unit separator between."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")}
    texts = (F.to_json(c) if c in nested else F.col(c).cast("string") for c in sorted(df.columns))
    row = F.concat_ws("\x1f", *(F.coalesce(t, F.lit("\x00")) for t in texts))
    told = F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(
        F.lit(name).alias("name"), F.count("*").alias("rows"), F.coalesce(F.sum(told), F.lit(0)).cast("string").alias("checksum")
    )


def write_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """Every table as Parquet and a manifest of row counts and checksums."""
    manifest = None
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        row = table_digest(df, name)
        manifest = row if manifest is None else manifest.unionByName(row)
    if manifest is not None:
        manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def bundle_issues(spark, path: str) -> DataFrame:
    """``name, issue`` for each table of a bundle whose rows or checksum aren't those of the manifest."""
    manifest = spark.read.schema("name string, rows bigint, checksum string").json(f"{path}/manifest")
    now = None
    for r in manifest.select("name").collect():  # names of tables, a handful
        row = table_digest(spark.read.parquet(f"{path}/{r['name']}"), r["name"])
        now = row if now is None else now.unionByName(row)
    if now is None:
        return spark.createDataFrame([], "name string, issue string")
    both = manifest.join(now.select("name", F.col("rows").alias("r"), F.col("checksum").alias("c")), "name", "left")
    issue = F.when(~F.col("rows").eqNullSafe(F.col("r")), "row-count").when(~F.col("checksum").eqNullSafe(F.col("c")), "checksum")
    return both.select("name", issue.alias("issue")).filter("issue IS NOT NULL")
