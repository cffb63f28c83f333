"""Files of text: whole files, JSON lines, landed pages, captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stripped


def text_files(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """``path, text`` of every matching file below a folder, each file whole; a file without a character gives no row."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^\\ufeff", "").alias("text"))


def json_lines(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Records of JSON lines; a line that is no record of this schema is left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(folder)


def page_tables(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(data, included)`` of landed pages with the arrays ``data`` and ``included``: one row per entry of each."""
    return pages.select(F.explode("data").alias("r")).select("r.*"), pages.select(F.explode("included").alias("r")).select("r.*").distinct()


def cues(text: Column) -> Column:
    """The cues of a WebVTT text: start and end in seconds and the lines spoken."""
    seconds = lambda s: F.aggregate(F.split(s, ":"), F.lit(0.0), lambda a, x: a * 60 + F.coalesce(x.try_cast("double"), F.lit(0.0)))
    blocks = F.filter(F.split(F.regexp_replace(text, r"\r", ""), r"\n[ \t]*\n"), lambda b: b.contains("-->"))
    time_ = lambda b: F.regexp_extract(b, r"(?m)^(.*-->.*)$", 1)
    return F.transform(blocks, lambda b: F.struct(
        seconds(stripped(F.substring_index(time_(b), "-->", 1))).alias("start"),
        seconds(F.regexp_extract(time_(b), r"-->\s*([0-9:.]+)", 1)).alias("end"),
        stripped(F.regexp_replace(F.regexp_replace(b, r"(?s)^.*?-->[^\n]*", ""), r"\s*\n\s*", " ")).alias("spoken"),
    ))
