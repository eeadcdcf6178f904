"""Records (entry_id, body, source, ...) from folders, pastes, batches and uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import columns as C


def decoded(content: Column) -> Column:
    """UTF-8 where the bytes are, else Latin-1, which every byte is."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def from_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Every .txt file below a folder that has a text; the id is its path below the folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(folder)
    return _records(files, folder)


def _records(files: DataFrame, folder: str) -> DataFrame:
    root = folder.rstrip("/").removeprefix("file://").removeprefix("file:")
    path = F.regexp_replace("path", r"^file:/+", "/")
    name = F.when(F.startswith(path, F.lit(root + "/")), F.substring(path, F.lit(len(root) + 2), F.length(path))).otherwise(path)
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")
    rows = files.select(name.alias("entry_id"), C.stripped(decoded(F.col("content"))).alias("body"), path.alias("source"), stem.alias("stem"), F.col("modificationTime").alias("modified"))
    return rows.where("body <> ''")


def pasted(texts: DataFrame, source: str = "paste") -> DataFrame:
    """(body[, explicit_date]): the id is of the content, so equal pastes are one entry."""
    entry_id = F.concat(F.lit(f"{source}:"), F.substring(C.content_hash(F.col("body")), 1, 16))
    explicit = F.col("explicit_date") if "explicit_date" in texts.columns else F.lit(None).cast("string")
    return texts.select(entry_id.alias("entry_id"), "body", F.lit(source).alias("source"), explicit.alias("explicit_date"))


def batch_parts(blob: Column) -> Column:
    """A pasted batch is cut at lines of dashes or equals signs and at two blank lines and more."""
    return F.filter(F.transform(F.split(blob, r"\n\s*(?:-{3,}|={3,})\s*\n|\n{3,}"), C.stripped), lambda p: p != "")


def batches(blobs: DataFrame, source: str = "batch") -> DataFrame:
    return pasted(blobs.select(F.explode(batch_parts(F.col("blob"))).alias("body")), source)


def uploads(files: DataFrame) -> DataFrame:
    """(filename, content): dated by the name, the header, or today."""
    key = F.concat(F.lit("upload:"), "filename")
    return files.select(key.alias("entry_id"), C.stripped(F.col("content")).alias("body"), key.alias("source"), F.regexp_replace("filename", r"\.[^.]*$", "").alias("stem"))
