"""Tables that are written to more than once: upsert, insert if missing, replace and delete, each a commit that is whole or not there."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Files


#: Names of writes that a table remembers: a batch that comes again does so long before as many others have.
KEPT_NAMES = 1000


class Table:
    """Parquet files in parts, with a log that says which files are the table's.

    A write stages the new content of the parts that it touches in a folder of its own, by Spark's own committer, so retried and
    speculative tasks leave one copy each. Then one small file is added to the log: until it is there readers see the table as it
    was, afterwards as it is now. A write that was killed is repeated from the start. One with a name (txn) that the log has
    already changes nothing, so a batch of a stream may come twice. Of two writers at once one is refused and may try again.

    A part is a bucket of the key's hash, or the value of the column `by`; the log names each, so there are some thousand at most.
    Files that the log has left behind stay until vacuum().
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: list[str], by: str | None = None, buckets: int = 32):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self.schema = spark.range(0).select(F.from_json(F.lit("{}"), schema).alias("s")).schema["s"].dataType
        self.part = F.col(by).cast("string") if by else F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("string")
        self.log = Files(spark, f"{self.folder}/log")

    def state(self) -> tuple[int, dict]:
        """(version, entry of the log): parts with their folders, and the names of the last writes."""
        names = [n for n in self.log.names() if n.endswith(".json")]
        return (int(names[-1][:-5]), json.loads(self.log.read(names[-1]))) if names else (0, {"parts": {}, "txns": []})

    def read(self, parts: list[str] | None = None) -> DataFrame:
        """The rows as of the last commit, of all parts or of some: files of others are not looked at."""
        known = self.state()[1]["parts"]
        wanted = None if parts is None else set(parts)
        paths = [path for part, path in known.items() if wanted is None or part in wanted]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _names(self, df: DataFrame) -> list[str]:
        """Distinct parts of the rows: no more than the table has."""
        return [r.p for r in df.select(self.part.alias("p")).distinct().collect()]

    def _put(self, rows: DataFrame, touched: list[str], version: int, entry: dict, txn: str | None) -> bool:
        if not touched:
            return False
        staged = f"{self.folder}/data/{uuid.uuid4().hex}"
        names = [f.name for f in self.schema.fields]
        # a part's files are written by the tasks its rows are dealt to, hot ones by several
        rows.select(*names, self.part.alias("_part")).repartition("_part", F.pmod(F.xxhash64(*self.key), F.lit(8))).write.partitionBy("_part").parquet(staged)
        unquote = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        made = {unquote(n.removeprefix("_part=")): f"{staged}/{n}" for n in Files(self.spark, staged).names() if n.startswith("_part=")}
        parts = {p: at for p, at in entry["parts"].items() if p not in touched} | made
        if not self.log.create(f"{version + 1:012d}.json", json.dumps({"parts": parts, "txns": (entry["txns"] + ([txn] if txn else []))[-KEPT_NAMES:]})):
            Files(self.spark, staged).delete()
            raise RuntimeError("another writer has committed meanwhile")
        return True

    def _begin(self, txn: str | None) -> tuple[int, dict] | None:
        version, entry = self.state()
        return None if txn and txn in entry["txns"] else (version, entry)

    def upsert(self, new: DataFrame, txn: str | None = None) -> bool:
        """Rows of new, one a key, take the place of those with their key. Whether anything was written."""
        if not (now := self._begin(txn)):
            return False
        touched = self._names(new)
        old = self.read(touched).join(new.select(*self.key).distinct(), self.key, "left_anti")
        return self._put(old.unionByName(new.select(*self.schema.fieldNames())), touched, *now, txn)

    def insert(self, new: DataFrame, order: str, txn: str | None = None) -> bool:
        """Rows whose key the table does not have; of new rows with one key the first by `order`, a column of new."""
        if not (now := self._begin(txn)):
            return False
        names, rest = self.schema.fieldNames(), [c for c in self.schema.fieldNames() if c not in self.key]
        first = new.groupBy(*self.key).agg(F.min_by(F.struct(*rest), F.struct(order, *rest)).alias("m")).select(*self.key, *[F.col("m")[c].alias(c) for c in rest])
        touched = self._names(first)
        old = self.read(touched)
        return self._put(old.unionByName(first.join(old.select(*self.key), self.key, "left_anti").select(*names)), touched, *now, txn)

    def replace(self, new: DataFrame, parts: list[str] | None = None, txn: str | None = None) -> bool:
        """New content of the parts that new has rows of, or of the parts named: one without rows is emptied."""
        if not (now := self._begin(txn)):
            return False
        touched = self._names(new) if parts is None else parts
        return self._put(new if parts is None else new.filter(self.part.isin(touched)), touched, *now, txn)

    def delete(self, condition: Column, txn: str | None = None) -> bool:
        """The table without the rows for which the condition is true; parts without such rows are left as they are."""
        if not (now := self._begin(txn)):
            return False
        touched = self._names(self.read().filter(condition))
        return self._put(self.read(touched).filter(~F.coalesce(condition, F.lit(False))), touched, *now, txn)

    def delete_dangling(self, ends: list[str], nodes: DataFrame, column: str, txn: str | None = None) -> bool:
        """The table without rows that name at one of the ends what nodes (column) does not have: what a delete of nodes takes along."""
        if not (now := self._begin(txn)):
            return False
        ids = nodes.select(F.col(column).alias("_id")).distinct()
        # what is left out, by end; few rows once the table has been cleared before
        gone = None
        for end in ends:
            part = self.read().join(ids, F.col(end) == F.col("_id"), "left_anti").select(*self.key, self.part.alias("_part"))
            gone = part if gone is None else gone.union(part)
        touched = [r.p for r in gone.select(F.col("_part").alias("p")).distinct().collect()]
        return self._put(self.read(touched).join(gone.select(*self.key).distinct(), self.key, "left_anti"), touched, *now, txn)

    def vacuum(self) -> int:
        """Delete files that the last commit does not name, how many folders; only while nobody reads or writes an older one."""
        kept, data = set(self.state()[1]["parts"].values()), Files(self.spark, f"{self.folder}/data")
        n = 0
        for staged in data.names():
            inner = Files(self.spark, f"{self.folder}/data/{staged}")
            old = [name for name in inner.names() if f"{self.folder}/data/{staged}/{name}" not in kept]
            if not any(f"{self.folder}/data/{staged}/{name}" in kept for name in inner.names()):
                inner.delete()
                n += 1
            else:
                for name in old:
                    if name.startswith("_part="):
                        inner.delete(name)
                        n += 1
        return n
