"""CSV and JSON sources and sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Charsets every session accepts.
STANDARD_CHARSETS = ("UTF-8", "US-ASCII", "ISO-8859-1", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32")


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row per key by ``order``.

    An aggregate (min_by over the whole row) rather than a window: duplicates collapse
    on the map side, so one heavily repeated key never reaches a single task unreduced.
    """
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    return first.select(*keys, "_row.*")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, time: str, keys: list[str] | None = None,
             sep: str = ",", encodings: tuple[str, ...] = ("UTF-8", "GBK")) -> DataFrame:
    """Typed CSV scan with a second encoding when the first leaves broken characters.

    Whether the first encoding fits is decided by one scan for the replacement character.
    Duplicate (keys, time) rows keep the first in file order.
    """
    def scan(encoding: str) -> DataFrame:
        if encoding.upper() not in STANDARD_CHARSETS:
            # other Java charsets need a session that was started for them
            if spark.conf.get("spark.sql.legacy.javaCharsets", "false") != "true":
                raise ValueError(f"{encoding} needs a session with spark.sql.legacy.javaCharsets=true")
        return spark.read.csv(path, header=True, schema=schema, sep=sep, encoding=encoding,
                              ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)

    df = scan(encodings[0])
    texts = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    if texts:
        for encoding in encodings[1:]:
            broken = F.concat_ws("", *texts).contains("�")
            if df.filter(broken).isEmpty():
                break
            df = scan(encoding)
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    ordered = df.withColumn("_seq", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    return keep_first(ordered, [*(keys or []), time], "_seq").drop("_seq")


def parse_csv_lines(lines: DataFrame, text: str, schema: str) -> DataFrame:
    """CSV text already held in a column, parsed with an explicit schema."""
    rest = [c for c in lines.columns if c != text]
    return lines.select(*rest, F.from_csv(F.col(text), schema).alias("_csv")).select(*rest, "_csv.*")


def rename_columns(df: DataFrame, aliases: Mapping[str, list[str]], types: Mapping[str, str] | None = None) -> DataFrame:
    """Fixed output schema: each canonical name takes its first existing candidate, else a typed NULL."""
    types = types or {}
    lowered = {}
    for c in df.columns:
        lowered.setdefault(c.strip().lower(), c)
    cols: list[Column] = []
    for name, candidates in aliases.items():
        found = next((c for c in candidates if c in df.columns), None) or next(
            (lowered[c.lower()] for c in candidates if c.lower() in lowered), None)
        cols.append((F.col(f"`{found}`") if found else F.lit(None).cast(types.get(name, "string"))).alias(name))
    return df.select(*cols)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """CSV gets a header; every format overwrites its own folder only."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def table_exists(spark: SparkSession, path: str, fmt: str = "parquet") -> bool:
    try:
        spark.read.format(fmt).load(path)
    except AnalysisException:
        return False
    return True
