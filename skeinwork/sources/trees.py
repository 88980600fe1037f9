"""Files of a folder tree, and commits of a version log, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.paths import EXCLUDED, language, sensitive

#: Bytes of a file that is read, and of its beginning that is looked at for a zero byte (fixed values).
MOST_BYTES, SNIFFED_BYTES = 1 << 20, 8 << 10


def binary(content: Column) -> Column:
    """Whether the first 8 KiB have a zero byte."""
    return F.hex(F.substring(content, 1, SNIFFED_BYTES)).rlike("^(?:..)*?00")


def judged(files: DataFrame, excluded: tuple[str, ...] = EXCLUDED, most: int = MOST_BYTES) -> DataFrame:
    """files (path, content: binary) with size, hash, language and skipped: excluded, too_large, sensitive, binary, or null."""
    inside = F.exists(F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))), lambda s: s.isin(*excluded)) if excluded else F.lit(False)
    size = F.octet_length("content").cast("long")
    why = F.when(inside, "excluded").when(size > most, "too_large").when(sensitive(F.col("path")), "sensitive").when(binary(F.col("content")), "binary")
    return files.withColumn("size", size).withColumn("hash", F.sha2("content", 256)).withColumn("language", language(F.col("path"))).withColumn("skipped", why)


def tree(spark: SparkSession, folder: str, excluded: tuple[str, ...] = EXCLUDED, most: int = MOST_BYTES) -> DataFrame:
    """(path, size, hash, language, skipped, text) of all regular files under a folder; text is null where a file is skipped.

    Spark lists and reads the files, in as many tasks as their bytes ask for; contents that are too large are not read. Its listing
    leaves out names that begin with a point or an underscore, below which nothing is looked for either.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    # what Spark reports as a path may have another number of slashes after the scheme than the root
    bare = lambda p: F.regexp_replace(p, "^[a-z]+:/*", "/")
    path = F.substring(bare(F.col("path")), F.length(bare(F.lit(root))) + 2, F.length("path"))
    small, large = found.filter(F.col("length") <= most), found.filter(F.col("length") > most)
    rows = judged(small.select(path.alias("path"), "content"), excluded, most)
    rows = rows.select("path", "size", "hash", "language", "skipped", F.when(F.col("skipped").isNull(), F.decode("content", "utf-8")).alias("text"))
    none = lambda t: F.lit(None).cast(t)
    return rows.unionByName(large.select(path.alias("path"), F.col("length").alias("size"), none("string").alias("hash"), language(path).alias("language"), F.lit("too_large").alias("skipped"), none("string").alias("text")))


#: Signs that part a log's records and their fields (fixed values).
RECORD, FIELD = "\x1e", "\x1f"


def commits(spark: SparkSession, file: str) -> DataFrame:
    """(hash, author, at, subject, paths) of a version log written with RECORD before each commit and FIELD between its fields.

    A record is hash, author, seconds and subject, and the paths it touches on lines of their own after the last field.
    Records with fewer fields are left out. The file is split by its records, so a long log is read by many tasks.
    """
    rows = spark.read.text(file, lineSep=RECORD)
    f = F.split("value", FIELD, -1)
    paths = F.filter(F.transform(F.split(F.get(f, F.lit(4)), "\n", -1), lambda p: F.trim(p)), lambda p: p != "")
    at = F.expr("try_cast(trim(get(f, 2)) as long)")
    found = rows.withColumn("f", f).filter(F.size("f") >= 5)
    return found.select(F.trim(F.get("f", F.lit(0))).alias("hash"), F.get("f", F.lit(1)).alias("author"), at.alias("at"), F.get("f", F.lit(3)).alias("subject"), F.array_distinct(paths).alias("paths"))
