"""A store of immutable shards with size-tiered compaction and versioned manifests.

An arrival is written as small shards, one per task, and never changed. When a size tier (shards
of which the largest is less than ``FANOUT`` times the smallest size of the tier) holds ``FANOUT`` shards or more,
its shards are merged in bins of up to ``TARGET`` bytes. A bin is one task that reads its shards and
writes one file, so nothing is shuffled; bins go in waves of ``WAVE``. Shards near the target size are left alone.

A version is a manifest file that lists the shards. It is written under a temporary name and renamed
to its number; a rename to a number that exists fails, so of two writers one wins and the other commits what it has written on top of
the winner's version: an arrival always, a merge if the shards that it replaces are still listed, else it is planned anew. Readers see
whole versions only. Files that no kept version lists are removed by ``vacuum``, which is told how long a writer may take before it
commits. A job that dies midway leaves files that no manifest lists.

Results for odd input: any columns and types that Parquet has are kept, nulls and repeated rows too; an empty
arrival makes a version without new shards, an empty store is read as no rows.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import Scratch, small

FANOUT, SMALLEST, TARGET, WAVE = 4, 1 << 20, 32 << 20, 32
ARRIVALS = 4
#: Times that a writer tries to commit on top of others.
ATTEMPTS = 50


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class Store:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, fanout: int = FANOUT, smallest: int = SMALLEST):
        self.spark, self.root, self.target, self.fanout, self.smallest = spark, root, target, fanout, smallest
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    # manifests

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path("manifests")):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path("manifests"))]
        return sorted(int(x[1:-5]) for x in names if x.startswith("v") and x.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        rows = self.spark.read.option("wholetext", "true").text(f"{self.root}/manifests/v{version:08d}.json").collect()
        return json.loads(rows[0][0])

    def commit(self, base: dict, shards: list[dict], schema: str) -> dict:
        new = {"version": base["version"] + 1, "schema": schema, "shards": shards}
        self._fs.mkdirs(self._path("manifests"))
        temporary, final = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/v{new['version']:08d}.json")
        out = self._fs.create(temporary, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(temporary, final):
            self._fs.delete(temporary, False)
            raise Conflict(f"version {new['version']}")
        return new

    # shards

    def _written(self, df: DataFrame, folder: str) -> list[dict]:
        """Writes a file for each of df's partitions that has rows; what to say of them in the manifest."""
        df.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        back = self.spark.read.schema(df.schema).parquet(f"{self.root}/{folder}")
        files = back.groupBy(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows")).where("rows > 0").orderBy("name").collect()
        return [{"path": f"{folder}/{r['name']}", "bytes": r["bytes"], "rows": r["rows"]} for r in files]

    def append(self, arrival: DataFrame) -> dict:
        shards = [x | {"merges": 0} for x in self._written(arrival, f"shards/{uuid.uuid4().hex}")]
        return self._committed(set(), shards, arrival.schema.json())

    def _committed(self, gone: set[str], new: list[dict], schema: str | None = None) -> dict | None:
        """Commits new shards in place of some, on top of whatever version is the latest; None if one of these has been replaced meanwhile."""
        for attempt in range(ATTEMPTS):
            base = self.manifest()
            if not gone <= {x["path"] for x in base["shards"]}:
                return None
            try:
                return self.commit(base, [x for x in base["shards"] if x["path"] not in gone] + new, base["schema"] or schema)
            except Conflict:
                if attempt == ATTEMPTS - 1:
                    raise

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.smallest, self.fanout)) + 1)

    def bins(self, shards: list[dict]) -> list[list[dict]]:
        """Shards to merge: those of each tier that is full, in bins of up to the target size."""
        tiers: dict[int, list[dict]] = {}
        for x in shards:
            if 2 * x["bytes"] <= self.target:
                tiers.setdefault(self.tier(x["bytes"]), []).append(x)
        out = []
        for _, members in sorted(tiers.items()):
            if len(members) < self.fanout:
                continue
            row: list[dict] = []
            for x in sorted(members, key=lambda x: (x["bytes"], x["path"])):
                if row and sum(y["bytes"] for y in row) + x["bytes"] > self.target:
                    out.append(row)
                    row = []
                row.append(x)
            out.append(row)
        return [x for x in out if len(x) > 1]

    def compact(self) -> dict:
        """Merges until no tier is full; each wave is a version."""
        while bins := self.bins((base := self.manifest())["shards"]):
            wave = bins[:WAVE]
            merged = None
            for x in wave:
                one = self._frame(base, x).coalesce(1)
                merged = one if merged is None else merged.union(one)
            gone = {y["path"] for x in wave for y in x}
            most = 1 + max(y["merges"] for x in wave for y in x)
            new = [x | {"merges": most} for x in self._written(merged, f"shards/{uuid.uuid4().hex}")]
            if sum(x["rows"] for x in new) != sum(y["rows"] for x in wave for y in x):
                raise RuntimeError("a merge has not as many rows as its shards")
            self._committed(gone, new)
        return base

    def vacuum(self, keep: int = 1, seconds: float = 0) -> None:
        """Removes manifests but the last ones, and files that these don't list and that are older than a writer may take to commit them."""
        before = (time.time() - seconds) * 1000
        versions = self.versions()
        kept = {x["path"] for v in versions[-keep:] for x in self.manifest(v)["shards"]}
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"manifests/v{v:08d}.json"), False)
        for folder in self._fs.listStatus(self._path("shards")) if self._fs.exists(self._path("shards")) else []:
            name = folder.getPath().getName()
            for f in self._fs.listStatus(folder.getPath()):
                if f"shards/{name}/{f.getPath().getName()}" not in kept and f.getModificationTime() <= before:
                    self._fs.delete(f.getPath(), False)

    def _schema(self, manifest: dict):
        from pyspark.sql.types import StructType

        return StructType.fromJson(json.loads(manifest["schema"]))

    def _frame(self, manifest: dict, shards: list[dict]) -> DataFrame:
        return self.spark.read.schema(self._schema(manifest)).parquet(*[f"{self.root}/{x['path']}" for x in shards])

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return self._frame(m, m["shards"]) if m["shards"] else self.spark.createDataFrame([], self._schema(m))


def compacted(documents: DataFrame, arrivals: int = ARRIVALS) -> DataFrame:
    """Brings the documents into a store in so many arrivals and reads the last version back.

    doc_id, n_bytes and text_sha256 of every row, and its shard with the shard's rows, bytes and merges, and the version.
    """
    spark = documents.sparkSession
    store = Store(spark, Scratch(spark, "store").at)
    for k in range(arrivals):
        part = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(10)), F.lit(arrivals)) == k
        store.append(documents.where(part))
        store.compact()
        store.vacuum()
    m = store.manifest()
    listed = spark.createDataFrame([(x["path"], x["rows"], x["bytes"], x["merges"]) for x in m["shards"]], "shard string, shard_rows long, shard_bytes long, merges int")
    text = F.col("text").cast("string")
    rows = store.read().select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"), F.element_at(F.split(F.col("_metadata.file_path"), "/shards/"), -1).alias("name")) if m["shards"] else documents.limit(0).select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"), F.lit("").alias("name"))
    return rows.withColumn("shard", F.concat(F.lit("shards/"), "name")).join(small(listed), "shard", "left").select("doc_id", "n_bytes", "text_sha256", "shard", "shard_rows", "shard_bytes", "merges", F.lit(m["version"]).alias("version"))
