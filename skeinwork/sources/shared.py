"""The folder that driver and executors share, and what an operator writes in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; a temporary folder of this machine only where it is unset and Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='skeinwork-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Files:
    """Small files and folders of any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.path = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(folder)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path)) if self.fs.exists(self.path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.jvm.org.apache.hadoop.fs.Path(self.path, name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file as a whole, if there is none of that name: written beside it first, then renamed. Whether this call made it."""
        at = self.jvm.org.apache.hadoop.fs.Path(self.path, name)
        beside = self.jvm.org.apache.hadoop.fs.Path(self.path, f".{name}-{uuid.uuid4().hex}")
        stream = self.fs.create(beside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.fs.exists(at) and self.fs.rename(beside, at):
            return True
        self.fs.delete(beside, False)
        return False

    def delete(self, name: str = "") -> None:
        self.fs.delete(self.jvm.org.apache.hadoop.fs.Path(self.path, name) if name else self.path, True)


class Scratch:
    """A folder for the tables of one run of an operator: written and read back, so lineage ends and a lost executor loses nothing."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/skeinwork/{name}-{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """As write(), in buckets of the key's hash: two such tables of equal buckets are joined by their keys where they lie."""
        self.tables[name] = f"skeinwork_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, key).format("parquet").option("path", f"{self.path}/{name}").saveAsTable(self.tables[name])
        return self.spark.read.table(self.tables[name])

    def drop(self, name: str = "") -> None:
        """Delete the table of that name, or all; what reads them must have been written before."""
        for t in [name] if name else list(self.tables):
            if t in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(t)}")
        Files(self.spark, self.path).delete(name)
