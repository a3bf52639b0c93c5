"""Tables that only grow: rows are added, never changed or removed.

A table is a folder with data folders and a log.  A commit writes its rows in a folder of their own and then its log entry, whose file is created only if there is none of that number: of two writers
that began from the same version, the second is refused.  An entry names its folder and holds the count and the digest of its rows, so that a later edit of the data is found before anything is added to it.
A row whose key is there already is taken for a repeat if it is equal, and refused if it is not.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Refused(ValueError):
    """A write that would change what is there, or that began from an older version."""


class Tampered(ValueError):
    """Data that are not as they were committed."""


class Ledger:
    """A growing table of rows of a schema under path, a folder that all executors reach; keys tell rows apart (nulls are equal)."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str]):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, list(keys)

    def _file(self, name: str) -> tuple:
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def entries(self) -> list[dict]:
        """The log: one small entry a commit, in order."""
        place, fs = self._file("log")
        if not fs.exists(place):
            return []
        text = self.spark.read.text(f"{self.path}/log", wholetext=True).select(F.input_file_name().alias("f"), "value").collect()
        return [json.loads(r["value"]) for r in sorted(text, key=lambda r: r["f"].rsplit("/", 1)[-1])]

    def _create(self, name: str, content: str) -> bool:
        """Write a file that isn't there yet; False if it is."""
        place, fs = self._file(name)
        if fs.exists(place):
            return False
        try:
            out = fs.create(place, False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(content.encode()))
        out.close()
        return True

    def _read(self, entries: list[dict]) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{e['folder']}" for e in entries))

    def rows(self) -> DataFrame:
        """All committed rows; folders without an entry, of writers that were refused or died, are not read."""
        return self._read(self.entries())

    def content(self, df: DataFrame) -> Column:
        """A number that differs where any column differs; nulls count."""
        return F.xxhash64(*(F.coalesce(F.to_json(F.struct(F.col(f"`{c}`").alias("v"))), F.lit("")) for c in df.columns))

    def _digest(self, df: DataFrame) -> dict:
        n, total = df.select(self.content(df).cast("decimal(38,0)").alias("h")).agg(F.count("*"), F.coalesce(F.sum("h"), F.lit(0).cast("decimal(38,0)"))).first()
        return {"rows": n, "digest": str(int(total))}

    def verify(self) -> None:
        """Raise Tampered if a committed folder's rows are no longer those of its entry."""
        for e in self.entries():
            try:
                now = self._digest(self._read([e]))
            except Exception as x:
                if "PATH_NOT_FOUND" not in str(x):
                    raise
                now = None
            if now != {k: e[k] for k in ("rows", "digest")}:
                raise Tampered(f"commit {e['version']} is not as it was written")

    def append(self, rows: DataFrame, version: int | None = None) -> int:
        """Add the rows whose keys are new, once each, and return the version after; nothing is added, nor is there a new version, if all are repeats.

        version: what the caller saw, if it matters.  Refused: if there is a later version, or a row has the key of another one (committed or among rows) with other values.
        """
        entries = self.entries()
        if version is not None and version != len(entries):
            raise Refused(f"version {version} was read, but there is {len(entries)}")
        self.verify()
        chosen = self.spark.createDataFrame([], self.schema).columns
        rows = rows.select(*(F.col(f"`{c}`") for c in chosen))
        key = F.to_json(F.struct(*self.keys), {"ignoreNullFields": "false"})
        there = self._read(entries)
        both = rows.select(F.lit(1).alias("_new"), key.alias("_key"), self.content(rows).alias("_content")).unionByName(there.select(F.lit(0).alias("_new"), key.alias("_key"), self.content(there).alias("_content")))
        met = both.groupBy("_key").agg(F.max("_new").alias("_new"), F.min("_new").alias("_old"), (F.min("_content") != F.max("_content")).alias("_changed")).where("_new = 1")
        changed = met.where("_changed").limit(1).collect()
        if changed:
            raise Refused(f"a row with the key {changed[0]['_key']} is there with other values")
        folder = uuid.uuid4().hex
        fresh = rows.withColumn("_key", key).dropDuplicates(["_key"]).join(met.where("_old = 1").select("_key"), "_key", "left_semi").drop("_key")
        fresh.write.parquet(f"{self.path}/data/{folder}")
        own = self._digest(self._read([{"folder": folder}]))
        if not own["rows"]:
            return len(entries)
        entry = {"version": len(entries) + 1, "folder": folder} | own
        if not self._create(f"log/{len(entries):020d}.json", json.dumps(entry)):
            raise Refused(f"another writer has made version {len(entries) + 1}")
        return len(entries) + 1
