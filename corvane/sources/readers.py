"""Readers for the file kinds that the analyses start from. Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def csv(spark: SparkSession, path: str | list[str], schema: str | StructType, columns: list[str] | None = None, empty_is_null: bool = True, **options) -> DataFrame:
    """CSV files with a header under a declared schema; text that doesn't fit its type raises. Columns are taken by the header's names."""
    found = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False)
    if not empty_is_null:
        found = found.option("nullValue", "\x00").option("emptyValue", "")
    out = found.options(**options).csv(path)
    return out.select(*columns) if columns else out


def delimited(spark: SparkSession, path: str | list[str], fields: list[str], glue: str = "\t") -> DataFrame:
    """Lines (gzip too) with exactly as many fields as asked for; others are skipped."""
    parts = spark.read.text(path).select(F.split("value", glue, -1).alias("p"))
    return parts.where(F.size("p") == len(fields)).select(*[F.col("p")[i].alias(f) for i, f in enumerate(fields)])


def zipped_csv(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Rows of the first CSV member of each zip archive, as text columns by the header. An archive isn't splittable: a task reads each."""
    import csv as lines
    import io
    import zipfile

    import pandas as pd

    def run(batches):
        for pdf in batches:
            for raw in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(raw)) as z, z.open(z.namelist()[0]) as f:
                    rows, held = lines.DictReader(io.TextIOWrapper(f, "utf-8")), []
                    for r in rows:
                        held.append([r.get(c) for c in fields])
                        if len(held) == 10_000:
                            yield pd.DataFrame(held, columns=fields)
                            held = []
                    if held:
                        yield pd.DataFrame(held, columns=fields)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ", ".join(f"`{c}` string" for c in fields))


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name, stem and length of the files under a folder, without reading them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return found.select(name.alias("name"), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1).alias("stem"), "length")


def numbered_lines(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """(id, line) of one small text file, ids from 0 after the skipped lines. A label file is read whole by one task."""
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("id", "line"))
    return lines.where(F.col("id") >= skip).select((F.col("id") - skip).alias("id"), "line")


def log_lines(df: DataFrame, column: str) -> DataFrame:
    """Lines of JSON logs: each value is a list of objects whose `data` strings are chunks of one text."""
    chunks = F.from_json(column, "array<struct<data:string>>")
    return df.select(F.explode(F.split(F.array_join(F.transform(chunks, lambda c: c["data"]), ""), "\n")).alias("line")).where("line <> ''")


def key_values(df: DataFrame, column: str) -> DataFrame:
    """(k, v) of lines `k=v` or `k v`; others are skipped."""
    m = r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*[= ]\s*(.*?)\s*$"
    return df.where(F.col(column).rlike(m)).select(F.regexp_extract(column, m, 1).alias("k"), F.regexp_extract(column, m, 2).alias("v"))


def after_header(df: DataFrame, column: str, order: str, header: str) -> DataFrame:
    """The lines after the first one that equals the header: warnings before a table are left out."""
    at = df.where(F.col(column) == header).agg(F.min(order).alias("__at"))
    return df.crossJoin(F.broadcast(at)).where(F.col(order) > F.col("__at")).drop("__at")


def dense(ids: DataFrame, sparse: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Counts by id with 0 where the sparse table has none."""
    return ids.join(sparse, key, "left").select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in columns])


def list_literal(text: Column) -> Column:
    """['a', 'b'] stored as text, as an array of strings."""
    return F.from_json(F.translate(text, "'", '"'), "array<string>")


def clock_seconds(text: Column) -> Column:
    """HH:MM:SS as seconds."""
    p = F.split(text, ":")
    return p[0].cast("long") * 3600 + p[1].cast("long") * 60 + p[2].cast("long")


def first_by(df: DataFrame, by: list[str], *order: str) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")
