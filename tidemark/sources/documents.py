"""Documents into passages."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip


def read_documents(spark: SparkSession, path: str | list[str], scope: str = "shared", suffixes: tuple[str, ...] = (".md", ".txt")) -> DataFrame:
    """One row per text file at or below ``path``, whole: (doc_id, title, text, source).

    Files of other suffixes are left alone, and empty ones have no row. The title is the file's name without its suffix, the source its name; bytes that are no UTF-8 become replacement
    characters. Files are listed and read by the tasks, so a folder may be as large as a table.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if _plain(paths):
        files = _read_files(spark, paths, suffixes)
    else:
        wanted = "*{" + ",".join(suffixes) + "}"
        read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", wanted).text(paths, wholetext=True)
        files = read.select("value", F.col("_metadata.file_name").alias("source"))
    title = F.regexp_replace("source", r"\.[^.]*$", "")
    return files.select(F.concat(F.lit(f"{scope}:"), title).alias("doc_id"), title.alias("title"), F.col("value").alias("text"), "source")


def _plain(paths: list[str]) -> bool:
    """Existing folders or files of one store that tasks can open by themselves; other paths, patterns among them, are left to the reader of Spark."""
    if any(":" not in p.split("/")[0] or set(p) & set("*?[]{}\\%, ") for p in paths) or len({urlsplit(p)[:2] for p in paths}) != 1:
        return False
    try:
        return all(fs.FileSystem.from_uri(p)[0].get_file_info(fs.FileSystem.from_uri(p)[1]).type != fs.FileType.NotFound for p in paths)
    except (pa.ArrowInvalid, OSError):
        return False


def _written(name: str) -> str:
    """A file's name as Spark's readers tell it, quoted like the path of a URI in which other letters than those of ASCII may stand."""
    return "".join(c if ord(c) > 127 and unicodedata.category(c) not in ("Zs", "Zl", "Zp", "Cc") else quote(c, safe="!'()*,;:$&+=@") for c in name)


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata"))


def _read_files(spark: SparkSession, paths: list[str], suffixes: tuple[str, ...], most: int = 1 << 22) -> DataFrame:
    """(value, source) of files below ``paths``: folders are listed by tasks, then files are dealt to tasks by their path and read in batches of about ``most`` bytes."""
    uri, parts = paths[0], int(spark.conf.get("spark.sql.shuffle.partitions"))

    def walk(deep: bool):
        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, _ = fs.FileSystem.from_uri(uri)
            for batch in batches:
                folders, files = [], []
                for at, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    (folders if folder else files).append(at)
                below = []
                while folders:
                    for info in store.get_file_info(fs.FileSelector(folders.pop())):
                        if info.type == fs.FileType.Directory and not _hidden(info.base_name):
                            (folders if deep else below).append(info.path)
                        elif info.type == fs.FileType.File and info.size and info.base_name.endswith(suffixes) and not _hidden(info.base_name):
                            files.append(info.path)
                        if len(files) >= 10_000:
                            yield listed(files, False)
                            files = []
                yield listed(files, False)
                yield listed(below, True)

        return local

    def listed(found: list[str], folder: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([folder] * len(found), pa.bool_())], names=["at", "folder"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(uri)
        texts, names, size = [], [], 0
        for batch in batches:
            for at in batch.column(0).to_pylist():
                with store.open_input_stream(at, compression=None) as held:
                    texts.append(held.read())
                names.append(_written(at.rsplit("/", 1)[-1]))
                size += len(texts[-1])
                if size >= most or len(texts) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(names, pa.string())], names=["value", "source"])
                    texts, names, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(names, pa.string())], names=["value", "source"])

    roots = []
    for p in paths:
        store, base = fs.FileSystem.from_uri(p)
        info = store.get_file_info(base)
        if info.type == fs.FileType.Directory or info.size and info.base_name.endswith(suffixes):
            roots.append((base, info.type == fs.FileType.Directory))
    kind = "at string, folder boolean"
    first = spark.createDataFrame(roots, kind).mapInArrow(walk(False), kind)
    files = first.repartition(parts, "at").mapInArrow(walk(True), kind).repartition(parts, "at")
    # bytes are taken as they are, like the reader of Spark takes them
    return files.mapInArrow(read, "value binary, source string").select(F.col("value").cast("string").alias("value"), "source")


def write_documents(df: DataFrame, uri: str, title: str, text: str) -> DataFrame:
    """One text file ``title.txt`` per row below ``uri``, written by the tasks; (partition, n) of files when it is run.

    A null text is an empty file. A task that runs again writes the same files again; rows that share a title share a file, the last one stays.
    """
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(uri)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_output_stream(f"{base}/{quote(name, safe='')}.txt") as out:
                    out.write((body or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return df.select(F.col(title).cast("string"), F.col(text).cast("string")).mapInArrow(local, "n long").select(F.spark_partition_id().alias("partition"), "n")


def sliding_chunks(df: DataFrame, doc: str, text: str, size: int = 320, overlap: int = 60) -> DataFrame:
    """(doc, chunk_no, chunk_id, chunk): windows of ``size`` characters every ``size - overlap``; the last one reaches the end."""
    step = max(1, size - overlap)
    clean = strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))
    n = F.length("_clean")
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step)).cast("int")
    pieces = (
        df.select(F.col(doc), clean.alias("_clean")).filter(F.length("_clean") > 0)
        .select(doc, "_clean", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
        .select(doc, "chunk_no", strip(F.substring(F.col("_clean"), F.col("chunk_no") * step + 1, F.lit(size))).alias("chunk"))
        .filter(F.length("chunk") > 0)
    )
    return pieces.withColumn("chunk_id", F.concat(F.col(doc).cast("string"), F.lit("#"), F.col("chunk_no").cast("string")))


def packed_chunks(df: DataFrame, doc: str, text: str, size: int = 220) -> DataFrame:
    """(doc, chunk_no, chunk): paragraphs joined in order until the next one would pass ``size``.

    The fold keeps a length and the first paragraph of each chunk; text is only sliced
    once afterwards, so the work stays linear in the document.
    """
    paragraphs = F.filter(F.transform(F.split(F.col(text), r"\n\s*\n"), strip), lambda p: F.length(p) > 0)
    held = df.select(F.col(doc), paragraphs.alias("_p")).filter(F.size("_p") > 0)
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def place(state: Column, length: Column) -> Column:
        at = state["at"] + 1
        opens = (state["used"] == 0) | (state["used"] + length > size)
        return F.struct(
            F.when(opens, length).otherwise(state["used"] + 1 + length).alias("used"),
            at.alias("at"),
            F.when(opens, F.concat(state["starts"], F.array(at))).otherwise(state["starts"]).alias("starts"))

    marked = held.withColumn("_s", F.aggregate(F.transform("_p", lambda p: F.length(p)), start, place)["starts"])
    joined = F.transform(
        "_s", lambda s, k: F.array_join(F.slice("_p", s, F.coalesce(F.get("_s", k + 1), F.size("_p") + 1) - s), "\n"))
    return marked.select(doc, F.posexplode(joined).alias("chunk_no", "chunk"))
