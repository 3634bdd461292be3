"""Text files as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.text import clean_content

#: Bytes of a file at most.
LIMIT = 50 << 20
#: Extensions that are read as text.
TEXT = ["txt", "md", "csv", "html", "json"]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``path, content, error`` for each file below ``path``.

    Files that are too large, empty, or of another kind have an error and no
    content; the large ones are never read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    content = clean_content(F.decode("content", "UTF-8"))
    error = F.when(F.col("length") > LIMIT, "TOO_LARGE").when(~kind.isin(TEXT), "UNSUPPORTED").when(F.coalesce(content, F.lit("")) == "", "EMPTY")
    return files.select("path", error.alias("error"), F.when(error.isNull(), content).alias("content"))
