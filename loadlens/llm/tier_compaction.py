"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable shards. Shards of similar size form a tier; where a tier has enough of them,
they are merged into shards of up to the target size. What is current is told by a manifest alone: each change writes a
new version under a temporary name and renames it to a name that must not exist yet, so that readers see one version or
the next. A version says which shards came and which went, and every few versions it lists all. Of two writers of one
version the second applies its change to what the first has made of the list.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.llm.common import hadoop_fs, scratch_path

#: Merges that one job carries out side by side.
_MERGES_PER_JOB = 128
#: Every version with a number of this kind lists all shards; the others say what changed.
_LIST_EVERY = 16
_UNION = "spark.sql.unionOutputPartitioning"
#: A shard's place in the store: the write that made it, the arrival if there is one, and the file.
_PLACE = r"/data/([0-9a-f]{32}/(?:[^/]+/)?[^/]+\.parquet)$"


def _below(path: str) -> str:
    return re.search(_PLACE, path)[1]


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    tier: int


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    """A folder of shards and manifests, on any file system that Spark can write to."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 64_000_000, fanout: int = 4):
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target_bytes, fanout

    # Manifest

    def versions(self) -> list[int]:
        fs, at = hadoop_fs(self.spark, f"{self.root}/manifest")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def shards(self, version: int | None = None) -> list[Shard]:
        """The shards of a version, the latest by default; none before the first commit."""
        versions = [v for v in self.versions() if version is None or v <= version]
        if not versions:
            return []
        full = [v for v in versions if v % _LIST_EVERY == 0]
        wanted = [v for v in versions if v >= (full[-1] if full else 0)]
        texts = self.spark.read.text([f"{self.root}/manifest/v{v:08d}.json" for v in wanted], wholetext=True).collect()
        now: dict[str, Shard] = {}
        for change in sorted((json.loads(r.value) for r in texts), key=lambda c: c["version"]):
            now = {} if change["all"] else {k: s for k, s in now.items() if k not in set(change["gone"])}
            now |= {s["path"]: Shard(**s) for s in change["came"]}
        return list(now.values())

    def commit(self, version: int, came: list[Shard], gone: list[str] = (), all_: bool = False) -> None:
        """Write a version: the shards that came and the paths of those that went, or the list of all. CommitConflict if it exists."""
        jvm = self.spark.sparkContext._jvm
        name = f"{self.root}/manifest/v{version:08d}.json"
        fs, temporary = hadoop_fs(self.spark, f"{self.root}/manifest/_{uuid.uuid4().hex}")
        out = fs.create(temporary, False)
        out.write(bytearray(json.dumps({"version": version, "all": all_, "came": [asdict(s) for s in came], "gone": list(gone)}).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temporary.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(context.makeQualified(temporary), context.makeQualified(jvm.org.apache.hadoop.fs.Path(name)), none)
        except Exception as e:
            fs.delete(temporary, False)
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(name) from e
            raise

    def change(self, make: Callable[[list[Shard]], tuple[list[Shard], list[str]]], list_all: bool = False, tries: int = 20) -> int:
        """Commit what make gives for the current shards: those that come, and the paths of those that go. The version is
        taken before the shards are read, so a commit by another in between is a conflict, upon which make is asked anew."""
        for _ in range(tries):
            version = (self.versions() or [0])[-1] + 1
            now = self.shards(version - 1)
            came, gone = make(now)
            try:
                if version % _LIST_EVERY and not list_all:
                    self.commit(version, came, gone)
                else:
                    self.commit(version, [s for s in now if s.path not in set(gone)] + came, all_=True)
            except CommitConflict:
                continue
            return version
        raise CommitConflict(f"{self.root}: {tries} times")

    # Shards

    def tier(self, size: int) -> int:
        """Tiers are a fanout apart, counted down from 0 at the target size."""
        return min(0, math.floor(math.log(max(size, 1) / self.target, self.fanout) + 0.25))

    def _written(self, folder: str) -> list[Shard]:
        fs, at = hadoop_fs(self.spark, folder)
        files = [(s.getPath().toString(), s.getLen()) for s in fs.listStatus(at) if s.getPath().getName().endswith(".parquet")]
        return [Shard(p, n, self.tier(n)) for p, n in sorted(files)]

    def append(self, df: DataFrame) -> int:
        """Add the rows of df as shards, one for each of its partitions that has rows; the new version. No shuffle. Every row
        and column is kept; a table without rows adds nothing or a shard without rows."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return self.add(self._written(folder))

    def add(self, fresh: list[Shard]) -> int:
        return self.change(lambda now: (fresh, []))

    def write_arrivals(self, df: DataFrame, arrival: str) -> list[list[Shard]]:
        """Write df once, apart for each value of the column arrival, which is left out; the shards of each, uncommitted."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.partitionBy(arrival).parquet(folder)
        fs, at = hadoop_fs(self.spark, folder)
        return [self._written(s.getPath().toString()) for s in fs.listStatus(at) if s.isDirectory()]

    def plan(self, shards: list[Shard], final: bool = False) -> list[list[Shard]]:
        """Merges that are due: runs of at least fanout similarly sized shards (of two, if final), each up to the target."""
        merges, tiers = [], {}
        for s in shards:
            if s.bytes < 0.75 * self.target:
                tiers.setdefault(0 if final else s.tier, []).append(s)
        for run in tiers.values():
            if len(run) < (2 if final else self.fanout):
                continue
            bin_, filled = [], 0
            for s in sorted(run, key=lambda s: (s.bytes, s.path)):
                if filled + s.bytes > self.target and len(bin_) > 1:
                    merges.append(bin_)
                    bin_, filled = [], 0
                bin_, filled = [*bin_, s], filled + s.bytes
            if len(bin_) > 1:
                merges.append(bin_)
        return merges

    def compact(self, final: bool = False) -> int:
        """Carry out the merges that are due until none is; the current version. Each merge is one task that reads and
        writes up to the target size, and many run in one job, without a shuffle. What others append meanwhile stays; a
        merge of shards that another has merged meanwhile is dropped."""
        while merges := self.plan(self.shards(), final)[:_MERGES_PER_JOB]:
            folder = f"{self.root}/data/{uuid.uuid4().hex}"
            parts = [self.spark.read.parquet(*(s.path for s in m)).coalesce(1) for m in merges]
            self._write_apart(reduce(DataFrame.union, parts), folder)
            fresh: dict[int, list[Shard]] = {}
            for s in self._written(folder):  # the files of the n-th task are those of the n-th merge
                fresh.setdefault(int(s.path.rpartition("/")[2].split("-")[1]), []).append(s)

            def make(now: list[Shard], merges=merges, fresh=fresh) -> tuple[list[Shard], list[str]]:
                here = {s.path for s in now}
                good = [i for i, m in enumerate(merges) if all(s.path in here for s in m)]
                return [s for i in good for s in fresh.get(i, [])], [s.path for i in good for s in merges[i]]

            self.change(make, list_all=final)
            if sum(map(len, fresh.values())) >= sum(map(len, merges)):
                break
        return (self.versions() or [0])[-1]

    def _write_apart(self, merged: DataFrame, folder: str) -> None:
        """Write a union of one-partition tables as one file each. A union would otherwise put equally partitioned tables
        together, here into a single task."""
        before = self.spark.conf.get(_UNION, "true")
        self.spark.conf.set(_UNION, "false")
        try:
            merged.write.parquet(folder)
        finally:
            self.spark.conf.set(_UNION, before)

    def vacuum(self) -> int:
        """Delete the shards that older versions named and the latest does not, and older manifests; the number of shards
        deleted. Only for when no reader of an older version is left; files that no version names yet are left alone, as
        a writer may be about to commit them."""
        versions = self.versions()
        if not versions:
            return 0
        latest = self.shards(versions[-1])
        texts = self.spark.read.text([f"{self.root}/manifest/v{v:08d}.json" for v in versions], wholetext=True).collect()
        named = {p for r in texts for c in [json.loads(r.value)] for p in [*c["gone"], *(s["path"] for s in c["came"])]}
        dead = named - {s.path for s in latest}
        fs, _ = hadoop_fs(self.spark, self.root)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        gone = sum(bool(fs.delete(path(p), False)) for p in sorted(dead))
        # the latest version must list all before the changes that led to it are deleted
        if not max(((c := json.loads(r.value))["version"], c["all"]) for r in texts)[1]:
            self.change(lambda now: ([], []), list_all=True)
        for v in self.versions()[:-1]:
            fs.delete(path(f"{self.root}/manifest/v{v:08d}.json"), False)
        return gone

    def read(self, schema=None) -> DataFrame:
        paths = [s.path for s in self.shards()]
        return self.spark.read.parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def shard_documents(docs: DataFrame, arrivals: int = 4, target_bytes: int = 64_000_000, fanout: int = 4) -> tuple[ShardStore, DataFrame]:
    """Append docs in a number of arrivals (by a hash of doc_id), compacting after each; the store and its rows.

    Every row and column is kept, repeated rows, nulls and empty texts included; an empty table gives an empty store. Text
    of any length stays one row. docs are read and written once, whatever the number of arrivals.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, scratch_path(spark, "shards"), target_bytes, fanout)
    name = next(n for n in ("arrival", "arrival_", "arrival__") if n not in {c.lower() for c in docs.columns})
    for fresh in store.write_arrivals(docs.withColumn(name, F.pmod(F.xxhash64("doc_id"), F.lit(arrivals))), name):
        store.add(fresh)
        store.compact()
        store.vacuum()
    store.compact(final=True)
    store.vacuum()
    return store, store.read(docs.schema)


def shard_map(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, shard, shard_bytes, version) for each row of docs once sharded: the place of the row's shard in the manifest."""
    store, rows = shard_documents(docs, **options)
    spark = docs.sparkSession
    shards = store.shards()
    # a row per shard, about target_bytes of documents each; files of one task share their name, so the place below data/ tells
    names = spark.createDataFrame([(_below(s.path), i, s.bytes) for i, s in enumerate(shards)], "file string, shard int, shard_bytes long")
    placed = rows.select("doc_id", F.regexp_extract(F.input_file_name(), _PLACE, 1).alias("file"))
    return placed.join(names, "file", "left").select("doc_id", "shard", "shard_bytes", F.lit((store.versions() or [0])[-1]).alias("version"))
