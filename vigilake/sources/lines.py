"""Line-based inputs: framed JSON lines and corpora of commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.sources import files
from vigilake.sources.events import MOST_LINE
from vigilake.sources.files import MOST_CONTENT

#: A line that is skipped (blank, or a comment), or a command: lines joined where one ends in an odd number of backslashes.
_LOGICAL = r"(?m)^(?:[ \t]*(?:#[^\n]*)?$|(?:(?:[^\\\n]++|\\[^\n])*+\\\n)*+(?:[^\\\n]++|\\[^\n])*+\\?$)"


def framed(raw: Column, most: int = MOST_LINE) -> Column:
    """(line, error): the line without its CR; one that is too long or no UTF-8 gives an error instead. raw is binary."""
    body = F.when(F.substring(raw, -1, 1) == F.lit(bytearray(b"\r")), F.substring(raw, F.lit(1), F.octet_length(raw) - 1)).otherwise(raw)
    error = F.when(F.octet_length(body) > most, "line too long").when(~F.is_valid_utf8(body.cast("string")), "no UTF-8")
    return F.struct(F.when(error.isNull(), body.cast("string")).alias("line"), error.alias("error"))


def commands(text: Column) -> Column:
    """The commands of a corpus file in order: blank lines and comments are skipped, continued lines joined with their backslash and line break."""
    found = F.regexp_extract_all(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit(_LOGICAL), F.lit(0))
    return F.filter(found, lambda c: ~c.rlike(r"^[ \t]*(?:#[^\n]*)?\z"))


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0) and command of the corpora at a path; a file is read whole, as its lines depend on those before."""
    read = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), commands(F.col("value")).alias("commands"))
    return read.select("file", F.posexplode("commands").alias("line", "command"))


def whole(spark: SparkSession, path: str, most: int = MOST_CONTENT) -> DataFrame:
    """file, text (its first bytes up to the limit, never cut inside a character) and cut (whether there is more) of the files at a path; no more of a file is read."""
    return files.prefixes(spark, path, most).withColumn("file", F.element_at(F.split("file", "/"), -1))
