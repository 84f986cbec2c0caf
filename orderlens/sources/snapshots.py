"""Partitioned Parquet tables as a series of snapshots.

A table is a folder with one folder for each write, in which its partitions lie, and one small
pointer file for each snapshot.  The pointer says in which write's folder the current files of
each partition are, what the schema is, and which batch of each stream came last.  A write
puts its files into a folder of its own and then creates the next pointer by a rename: until
then readers see the former snapshot, from then on the new one, never a mix, and a job that
dies half way leaves a folder that no pointer names.  Two writers that start from the same
snapshot cannot both create its successor.

A partition that a write does not touch stays where it is, so a write costs what it rewrites.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

PART, WRITE = "part", "_write"
POINTERS = "_snapshots"
#: Snapshots that stay readable behind the current one.
KEEP = 10


class ConcurrentWrite(RuntimeError):
    """Another writer has created the next snapshot first."""


@dataclass(frozen=True)
class Snapshot:
    """What a pointer file says."""

    version: int
    schema: dict  # of the rows, without the partition column
    parts: dict[str, str] = field(default_factory=dict)  # partition folder -> folder of its write
    batches: dict[str, int] = field(default_factory=dict)  # stream -> last batch

    def has(self, batch: tuple[str, int] | None) -> bool:
        """Whether a batch (stream, number) is in already; a stream's numbers only rise."""
        return batch is not None and self.batches.get(batch[0], -1) >= batch[1]


def files(spark: SparkSession, path: str):
    """The file system of a path, and its path type."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    kind = jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(conf), kind


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = files(spark, path)
    return fs.exists(at(path))


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = files(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at(path))) if fs.exists(at(path)) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """The snapshots that can be read, oldest first."""
    return [int(n[:12]) for n in _names(spark, f"{path}/{POINTERS}") if re.fullmatch(r"\d{12}\.json", n)]


def load(spark: SparkSession, path: str, version: int | None = None) -> Snapshot | None:
    """The current snapshot, or a former one; None where no table is."""
    if version is None:
        known = versions(spark, path)
        if not known:
            return None
        version = known[-1]
    fs, at = files(spark, path)
    stream = fs.open(at(f"{path}/{POINTERS}/{version:012d}.json"))
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Snapshot(**json.loads(text))


def commit(spark: SparkSession, path: str, snapshot: Snapshot) -> None:
    """Make a snapshot the current one."""
    fs, at = files(spark, path)
    final = at(f"{path}/{POINTERS}/{snapshot.version:012d}.json")
    made = at(f"{path}/{POINTERS}/.{uuid.uuid4().hex}")
    out = fs.create(made)
    try:
        out.write(bytearray(json.dumps(asdict(snapshot)).encode()))
    finally:
        out.close()
    if fs.exists(final) or not fs.rename(made, final):
        fs.delete(made, False)
        raise ConcurrentWrite(f"{path} has a snapshot {snapshot.version} already")


def read(spark: SparkSession, path: str, snapshot: Snapshot, parts: list[str] | None = None) -> DataFrame:
    """The rows of a snapshot with their partition, or those of some partition folders only."""
    schema = StructType.fromJson(snapshot.schema)
    whole = StructType([*schema.fields, StructField(PART, StringType())])
    chosen = snapshot.parts if parts is None else {p: snapshot.parts[p] for p in parts if p in snapshot.parts}
    if not chosen:
        return spark.createDataFrame([], whole)
    at = StructType([*whole.fields, StructField(WRITE, StringType())])
    return spark.read.schema(at).option("basePath", path).parquet(
        *[f"{path}/{WRITE}={write}/{part}" for part, write in chosen.items()]
    ).drop(WRITE)


def folder(spark: SparkSession, value: str) -> str:
    """The folder of a partition, its name escaped as Spark writes it."""
    utils = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return f"{PART}={utils.escapePathName(value)}"


def value(spark: SparkSession, name: str) -> str:
    """The partition that a folder holds."""
    utils = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return utils.unescapePathName(name.removeprefix(f"{PART}="))


def write(df: DataFrame, path: str, former: Snapshot | None, touched: list[str] | None, key: str,
          batch: tuple[str, int] | None = None) -> Snapshot:
    """The next snapshot: ``df`` (with its partition column) in place of the partitions ``touched``.

    ``touched`` names partition folders, None means all of the former snapshot.  Rows are stored
    by key within a file, with a Bloom filter of the key for each row group, so that a look-up by
    key reads few of them.
    """
    spark = df.sparkSession
    version = former.version + 1 if former else 0
    tag = f"{version:012d}-{uuid.uuid4().hex[:8]}"
    target = f"{path}/{WRITE}={tag}"
    out = df.hint("rebalance", PART)  # splits a hot partition's rows over several files
    if key in df.columns:
        out = out.sortWithinPartitions(PART, key)
    # the filter is as large as the keys of a row group need
    out.write.partitionBy(PART).option(f"parquet.bloom.filter.enabled#{key}", "true").option(
        "parquet.bloom.filter.adaptive.enabled", "true").parquet(target)
    stays = {} if former is None or touched is None else {p: w for p, w in former.parts.items() if p not in set(touched)}
    written = {n: tag for n in _names(spark, target) if n.startswith(f"{PART}=")}
    schema = StructType([f for f in df.schema.fields if f.name != PART])
    batches = dict(former.batches) if former else {}
    if batch is not None:
        batches[batch[0]] = batch[1]
    snapshot = Snapshot(version, json.loads(schema.json()), stays | written, batches)
    commit(spark, path, snapshot)
    return snapshot


def note(spark: SparkSession, path: str, former: Snapshot, batch: tuple[str, int]) -> Snapshot:
    """A snapshot of the same files in which a batch is known."""
    snapshot = Snapshot(former.version + 1, former.schema, former.parts, {**former.batches, batch[0]: batch[1]})
    commit(spark, path, snapshot)
    return snapshot


def forget(spark: SparkSession, path: str, keep: int = KEEP) -> None:
    """Remove snapshots older than the last ``keep`` and files that only they name."""
    known = versions(spark, path)
    old = known[:-keep] if keep else known
    if not old:
        return
    fs, at = files(spark, path)
    used = {(w, p) for v in known[len(old):] for p, w in load(spark, path, v).parts.items()}
    # pointers go first: what no pointer names may go at any time
    for v in old:
        fs.delete(at(f"{path}/{POINTERS}/{v:012d}.json"), False)
    for name in _names(spark, path):
        tag = name.removeprefix(f"{WRITE}=")
        if tag == name or int(tag[:12]) > old[-1]:
            continue  # a write under way has a later number
        parts = [n for n in _names(spark, f"{path}/{name}") if n.startswith(f"{PART}=")]
        gone = [p for p in parts if (tag, p) not in used]
        for p in [""] if len(gone) == len(parts) else gone:
            fs.delete(at(f"{path}/{name}/{p}" if p else f"{path}/{name}"), True)
