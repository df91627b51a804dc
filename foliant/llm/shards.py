"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable shards (Parquet files). Shards of similar size, those of one tier, are merged
as soon as there are FAN_IN of them, each run into one file by a job of its own, so each row is written again once a
tier, a logarithm of target over small size, until its shard has about the target size. Jobs of different runs go on
at the same time. What a table consists of is a manifest: a JSON file of its schema and its shards, written under a
temporary name and renamed to the next version's, which fails if another writer was first. Readers see one version.

The rename must not replace a file: true of HDFS and of file systems whose rename fails on a name that is taken. Stores
that copy instead of renaming need a committer of their own.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliant.llm.common import Scratch

#: Shards of a tier that are merged; bytes of a full shard; merges that go on at the same time.
FAN_IN, TARGET, MERGES = 8, 128_000_000, 16
#: A run is no longer than so many targets.
MOST_TARGETS = 1.2
#: Attempts to commit after other writers' commits; seconds after which a file that no manifest has ever named is nobody's.
ATTEMPTS, ORPHAN_S = 100, 7 * 86_400


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    arrival: int


class ShardTable:
    def __init__(self, spark: SparkSession, root: str, fan_in: int = FAN_IN, target: int = TARGET):
        self.spark, self.root, self.fan_in, self.target = spark, root.rstrip("/"), fan_in, target
        self.jvm = spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, at: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{at}" if at else self.root)

    def _list(self, at: str) -> list:
        p = self._path(at)
        return list(self.fs.listStatus(p)) if self.fs.exists(p) else []

    def version(self) -> int:
        """The latest version, 0 if there is none."""
        names = [s.getPath().getName() for s in self._list("_manifests")]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def _read(self, version: int | None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "shards": [], "schema": None}
        stream = self.fs.open(self._path(f"_manifests/v{version:012d}.json"))
        try:
            data = bytes(stream.readAllBytes())
        finally:
            stream.close()
        return json.loads(data)

    def manifest(self, version: int | None = None) -> list[Shard]:
        return [Shard(**s) for s in self._read(version)["shards"]]

    def schema(self, version: int | None = None) -> StructType | None:
        own = self._read(version)["schema"]
        return StructType.fromJson(own) if own else None

    def commit(self, shards: list[Shard], after: int, schema: StructType | None = None) -> int:
        """Version after + 1, or Conflict if there is one. The rename is atomic: readers see the whole manifest or none."""
        schema = schema or self.schema(after)
        temporary, final = self._path(f"_manifests/.{uuid.uuid4().hex}"), self._path(f"_manifests/v{after + 1:012d}.json")
        self.fs.mkdirs(self._path("_manifests"))
        stream = self.fs.create(temporary, False)
        stream.write(bytearray(json.dumps({"version": after + 1, "shards": [vars(s) for s in shards], "schema": schema and schema.jsonValue()}).encode()))
        stream.close()
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(self.fs.makeQualified(temporary), self.fs.makeQualified(final), self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            self.fs.delete(temporary, False)
            if self.fs.exists(final):
                raise Conflict(f"version {after + 1} is there already") from e
            raise
        return after + 1

    def _files(self, at: str) -> list[tuple[str, int]]:
        return sorted((f"{at}/{s.getPath().getName()}", s.getLen()) for s in self._list(at) if s.getPath().getName().endswith(".parquet"))

    def append(self, df: DataFrame, arrival: str | None = None) -> int:
        """Write df as small shards, one for each task; with arrival, a column of integers that isn't kept, each of its
        values is one commit, in order, nulls first. A commit that another writer is faster than is tried again.
        """
        at = f"data/{uuid.uuid4().hex}"
        self.fs.mkdirs(self._path(at))
        writer = df.write.mode("append").option("compression", "zstd")
        (writer.partitionBy(arrival) if arrival else writer).parquet(f"{self.root}/{at}")
        schema = df.drop(arrival).schema if arrival else df.schema
        number = lambda n: int(n.partition("=")[2]) if n.partition("=")[2].lstrip("-").isdigit() else -math.inf
        folders = [at] if not arrival else [f"{at}/{n}" for n in sorted((s.getPath().getName() for s in self._list(at) if "=" in s.getPath().getName()), key=number)]
        version = self.version()
        for files in [self._files(folder) for folder in folders] or [[]]:
            for _ in range(ATTEMPTS):
                shards = self.manifest(version)
                n = max((s.arrival for s in shards), default=-1) + 1
                try:
                    version = self.commit(shards + [Shard(p, size, n) for p, size in files], version, schema)
                    break
                except Conflict:
                    version = self.version()
            else:
                raise Conflict(f"{ATTEMPTS} attempts")
        return version

    def tier(self, size: int) -> int:
        """0 below the target over FAN_IN to some power; a full shard's is the highest."""
        steps = math.log(max(self.target, 1) / max(size, 1)) / math.log(self.fan_in)
        return -math.ceil(max(steps, 0.0) - 1e-9) if size < self.target else 1

    def plan(self, shards: list[Shard], last: bool = False) -> list[list[Shard]]:
        """Runs of shards to merge: FAN_IN neighbours of a tier, or as many as make a full shard. last: smaller runs too."""
        runs: list[list[Shard]] = []
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            tiers.setdefault(self.tier(s.bytes), []).append(s)
        for tier in sorted(tiers):
            if tier > 0:
                continue
            run: list[Shard] = []
            for s in tiers[tier]:
                if sum(x.bytes for x in run) + s.bytes > MOST_TARGETS * self.target:
                    runs += [run] if len(run) > 1 else []
                    run = []
                run.append(s)
                if len(run) == self.fan_in or sum(x.bytes for x in run) >= self.target:
                    runs.append(run)
                    run = []
            if last and len(run) > 1:
                runs.append(run)
        return runs

    def _merge(self, run: list[Shard], schema: StructType, at: str) -> Shard:
        """One job that writes a run's rows to one file; they aren't shuffled."""
        rows = self.spark.read.schema(schema).parquet(*(f"{self.root}/{s.path}" for s in run)).coalesce(1)
        rows.write.option("compression", "zstd").option("maxRecordsPerFile", 0).parquet(f"{self.root}/{at}")
        ((path, size),) = self._files(at)
        return Shard(path, size, max(s.arrival for s in run))

    def compact(self, last: bool = False) -> int:
        """Merge until no tier has a run left; each round is a commit, and a run that another writer has replaced meanwhile
        is left out of it. Old files stay for readers of older versions until vacuum(). last: runs of any length.
        """
        while True:
            own = self._read(None)
            runs = self.plan([Shard(**s) for s in own["shards"]], last)
            if not runs:
                return own["version"]
            at = f"data/{uuid.uuid4().hex}"
            schema = StructType.fromJson(own["schema"])
            with ThreadPoolExecutor(MERGES) as pool:
                done = list(pool.map(lambda x: self._merge(x[1], schema, f"{at}/{x[0]}"), enumerate(runs)))
            for _ in range(ATTEMPTS):
                version = self.version()
                shards = self.manifest(version)
                there = {s.path for s in shards}
                good = [(run, new) for run, new in zip(runs, done, strict=True) if all(s.path in there for s in run)]
                gone = {s.path for run, _ in good for s in run}
                try:
                    self.commit([s for s in shards if s.path not in gone] + [new for _, new in good], version)
                    break
                except Conflict:
                    continue
            else:
                raise Conflict(f"{ATTEMPTS} attempts")

    def vacuum(self, keep: int = 1, orphan_s: int = ORPHAN_S) -> None:
        """Forget all but the last versions, and delete the files that only forgotten ones name.

        A file that no manifest names may be an append that isn't committed yet: it stays until it is orphan_s old.
        """
        names = sorted(s.getPath().getName() for s in self._list("_manifests") if s.getPath().getName().startswith("v"))
        kept, forgotten = names[-max(keep, 1):], names[: -max(keep, 1)]
        live = {s.path for n in kept for s in self.manifest(int(n[1:-5]))}
        dead = {s.path for n in forgotten for s in self.manifest(int(n[1:-5]))} - live
        oldest = (time.time() - orphan_s) * 1000

        def sweep(at: str) -> None:
            for s in self._list(at):
                path = f"{at}/{s.getPath().getName()}"
                if s.isDirectory():
                    sweep(path)
                elif path.endswith(".parquet") and path not in live and (path in dead or s.getModificationTime() < oldest):
                    self.fs.delete(s.getPath(), False)

        sweep("data")
        for n in forgotten:
            self.fs.delete(self._path(f"_manifests/{n}"), False)

    def read(self, version: int | None = None, shard: str = "shard") -> DataFrame:
        """All rows of a version, and in a column of the given name the file that each is in. A table that nothing was appended to is an error."""
        own = self._read(version)
        if own["schema"] is None:
            raise ValueError("nothing has been appended yet")
        schema = StructType.fromJson(own["schema"])
        if not own["shards"]:
            return self.spark.createDataFrame([], schema).withColumn(shard, F.lit(None).cast("string"))
        rows = self.spark.read.schema(schema).parquet(*(f"{self.root}/{s['path']}" for s in own["shards"]))
        return rows.withColumn(shard, F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


#: Arrivals that the query deals the documents to.
ARRIVALS = 8


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", arrivals: int = ARRIVALS) -> tuple[ShardTable, DataFrame]:
    """docs as a table of shards that has taken them in arrivals parts, and its rows: doc_id, shard, version, n_chars.

    A null id is dealt by its hash; a null text is kept as null and has 0 characters; repeated rows all stay, each in one
    shard; an empty table has a version without shards and no rows. Columns of any name are kept as they are.
    """
    table = ShardTable(docs.sparkSession, f"{Scratch(docs.sparkSession, 'shards').path}/table")
    free = lambda name: name if name not in docs.columns else free(f"_{name}")
    table.append(docs.withColumn(free("__arrival"), F.pmod(F.xxhash64(id_col), F.lit(arrivals))), free("__arrival"))
    table.compact()
    table.vacuum()
    version = table.compact(last=True)
    table.vacuum()
    rows = table.read(version, free("shard"))
    return table, rows.select(F.col(id_col).alias("doc_id"), F.col(free("shard")).alias("shard"), F.lit(version).cast("long").alias("version"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n_chars"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, shard, version, n_chars of all documents, which arrive in ARRIVALS parts."""
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))[1]
