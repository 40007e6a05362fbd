"""Tables that keep their changes: Parquet files in parts by key, and versions that say which files count.

A commit reads and writes only the parts in which a changed key falls, under a path of its own, and then adds the next version: a small
file that is moved into place, which fails if another writer has made that version meanwhile; the commit then starts again from the
version that is now the last. Until that move nobody sees what was written, so a writer that dies leaves the table as it was. A batch
number that the table has seen makes a commit do nothing: a micro-batch that comes again is harmless, and numbers must grow.

Rows are dealt to parts by hash, `parts` being fixed when the table is made; the driver sees the paths of parts and never rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PART, UPDATED = "_part", "updated_at"


class Conflict(Exception):
    """Another writer has made the version meanwhile."""


class StoredTable:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = lambda p: jvm.Path(f"{self.folder}/{p}")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._files = jvm.FileContext.getFileContext(self._path("").toUri(), spark._jsc.hadoopConfiguration())
        self._replace = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0)  # never replaces

    @classmethod
    def create(cls, rows: DataFrame, folder: str, key: list[str], parts: int = 64, at: Column | None = None) -> StoredTable:
        """rows have one row a key; UPDATED is added, `at` or now."""
        table = cls(rows.sparkSession, folder)
        rows = rows.withColumn(UPDATED, F.current_timestamp() if at is None else at)
        made = {"version": 0, "batch": None, "key": key, "n_parts": parts, "schema": rows.schema.jsonValue(), "parts": {}}
        table._publish(made | {"parts": table._write(rows, made)})
        return table

    # Versions

    def versions(self) -> list[int]:
        path = self._path("versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def at(self, version: int | None = None) -> dict:
        """What a version, the last if none is given, consists of."""
        number = max(self.versions()) if version is None else version
        stream = self._fs.open(self._path(f"versions/{number:012d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _publish(self, made: dict) -> None:
        written = self._path(f"versions/{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(written)
        stream.write(json.dumps(made).encode())
        stream.close()
        try:
            self._files.rename(written, self._path(f"versions/{made['version']:012d}.json"), self._replace)
        except Exception as e:
            self._fs.delete(written, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(made["version"]) from None
            raise

    # Rows

    def _write(self, rows: DataFrame, made: dict) -> dict[str, str]:
        path = f"data/{made['version']:012d}-{uuid.uuid4().hex}"
        dealt = rows.withColumn(PART, F.pmod(F.xxhash64(*made["key"]), F.lit(made["n_parts"])))
        dealt.hint("rebalance", PART).write.partitionBy(PART).parquet(f"{self.folder}/{path}")
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(path)) if s.isDirectory()]
        return {n.removeprefix(f"{PART}="): f"{path}/{n}" for n in found if n.startswith(f"{PART}=")}

    def _rows(self, version: dict, parts: set[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(version["schema"])
        paths = [f"{self.folder}/{p}" for k, p in sorted(version["parts"].items()) if parts is None or k in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.at(version))

    def _parts(self, version: dict, keys: DataFrame) -> set[str]:
        """Those in which the keys of some rows fall: at most n_parts."""
        types = {f.name: f.dataType for f in StructType.fromJson(version["schema"])}
        part = F.pmod(F.xxhash64(*[F.col(k).cast(types[k]) for k in version["key"]]), F.lit(version["n_parts"]))
        return {str(r[0]) for r in keys.select(part).distinct().collect()}

    def read_for(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """The rows of the parts in which these keys fall; other parts are not read."""
        found = self.at(version)
        return self._rows(found, self._parts(found, keys))

    def commit(self, changes: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], batch: int | None = None, attempts: int = 5) -> int:
        """The version after change(rows of the touched parts, changes); its result has the table's columns. changes: a row a key."""
        for _ in range(attempts):
            old = self.at()
            if batch is not None and old["batch"] is not None and batch <= old["batch"]:
                return old["version"]
            touched = self._parts(old, changes)
            made = old | {"version": old["version"] + 1, "batch": old["batch"] if batch is None else batch}
            if touched:
                new = change(self._rows(old, touched), changes).select(StructType.fromJson(old["schema"]).names)
                made["parts"] = {k: p for k, p in old["parts"].items() if k not in touched} | self._write(new, made)
            try:
                self._publish(made)
                return made["version"]
            except Conflict:
                continue
        raise Conflict(f"{attempts} times")

    def sink(self, change: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        """For foreachBatch."""
        return lambda batch, number: self.commit(batch, change, number) and None

    def vacuum(self, keep: int = 2) -> None:
        """Forgets all but the last `keep` versions and deletes the files that only the others have. Not beside a writer."""
        numbers = self.versions()
        held = {p.rpartition("/")[0] for n in numbers[-keep:] for p in self.at(n)["parts"].values()}
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"versions/{n:012d}.json"), False)
        for s in self._fs.listStatus(self._path("data")):
            if f"data/{s.getPath().getName()}" not in held:
                self._fs.delete(s.getPath(), True)


def merged(key: list[str], values: dict[str, str], when: str = "true", insert: str = "false", delete: str = "false", at: Column | None = None) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """For commit(): of rows that both sides have, those for which `delete` holds go, and where `when` holds `values` are set; rows that
    only `changes` has come in where `insert` holds, with `values`. All are SQL over old and new. UPDATED is set, to `at` or now, on every
    row that is set or comes in, and on no other."""

    def change(old: DataFrame, changes: DataFrame) -> DataFrame:
        o, c = old.withColumn("_here", F.lit(True)).alias("old"), changes.withColumn("_here", F.lit(True)).alias("new")
        both = o.join(c, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in key], "full")
        has = lambda side: F.col(f"{side}._here").isNotNull()
        fresh = ~has("old") & F.expr(insert)
        set_ = fresh | (has("old") & has("new") & F.coalesce(F.expr(when), F.lit(False)))
        kept = both.where((has("old") | fresh) & ~(has("old") & has("new") & F.coalesce(F.expr(delete), F.lit(False))))
        of = {UPDATED: F.current_timestamp() if at is None else at} | {k: F.expr(v) for k, v in values.items()}
        cell = lambda f: F.coalesce(f"old.{f.name}", F.col(f"new.{f.name}").cast(f.dataType)) if f.name in key else F.when(set_, of[f.name].cast(f.dataType)).otherwise(F.col(f"old.{f.name}")) if f.name in of else F.col(f"old.{f.name}")
        return kept.select(*[cell(f).alias(f.name) for f in old.schema])

    return change
