"""Copies against all earlier loads: a store of text digests that grows by one run a load.

A digest is 128 bits of a text's SHA-256, its hash bucket one of ``buckets``. A run holds its new digests by bucket, and a
Bloom filter for each bucket. A load's digests meet the filters of their bucket in one pass over sorted partitions; only those
that a filter may hold are looked up among the stored digests. Texts do not take part in any of this.

A run counts once a commit names it. Its files are written before, its commit is one small file put in place by a rename, so a
load that fails leaves no trace. Two loads that began at the same commit cannot both end: the second one is an error and is
to be repeated. ``compact`` replaces all runs by one.

Rows: the row of the smallest order stays of equal texts (rows that are equal in both stay together); a null text is no
copy of anything; an empty load makes an empty run.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voc.storage import materialize

BUCKETS, BITS_A_DIGEST, HASHES = 1024, 10, 4
_COMMIT = "number bigint, run string, buckets int, replaces array<string>"
_RUN = "bucket int, digest binary"


def digest(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _places(digests: list[bytes], bits: int) -> np.ndarray:
    """The digests' places in a filter of ``bits`` bits, one row each."""
    halves = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    steps = np.arange(HASHES, dtype=np.uint64)
    return (halves[:, :1] + steps * (halves[:, 1:] | np.uint64(1))) % np.uint64(bits)


def bloom(digests: list[bytes]) -> bytes:
    bits = np.zeros(max(64, -(-len(digests) * BITS_A_DIGEST // 64) * 64), bool)
    if digests:
        bits[_places(digests, len(bits)).ravel()] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_hold(filter_: bytes, digests: list[bytes]) -> np.ndarray:
    at = _places(digests, 8 * len(filter_))
    data = np.frombuffer(filter_, np.uint8)
    return (data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool).all(axis=1)


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A filter for each bucket of a partition sorted by bucket."""
    at, held = None, []
    for batch in batches:
        for bucket, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if bucket != at and held:
                yield pa.record_batch([pa.array([at], pa.int32()), pa.array([bloom(held)])], names=["bucket", "bits"])
                held = []
            at = bucket
            held.append(one)
    if held:
        yield pa.record_batch([pa.array([at], pa.int32()), pa.array([bloom(held)])], names=["bucket", "bits"])


def _tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``bucket, digest, first, maybe`` from rows sorted so that a bucket's filters come before its digests."""
    at, filters = None, []
    for batch in batches:
        buckets = batch.column("bucket").to_numpy()
        bits = batch.column("bits")
        begins = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
        for low, high in zip(begins, begins[1:]):
            if low == high:
                continue
            if buckets[low] != at:
                at, filters = buckets[low], []
            given = bits.slice(low, high - low)
            new = [f.as_py() for f in given if f.is_valid]
            filters += new
            low += len(new)
            if low == high:
                continue
            digests = batch.column("digest").slice(low, high - low)
            maybe = np.zeros(high - low, bool)
            for f in filters:
                maybe |= may_hold(f, digests.to_pylist())
            columns = [batch.column("bucket").slice(low, high - low), digests, batch.column("first").slice(low, high - low), pa.array(maybe)]
            yield pa.record_batch(columns, names=["bucket", "digest", "first", "maybe"])


class Loads:
    """One load against the store at ``path``: ``new_rows`` once, then ``commit`` when the caller's outputs are written."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.run = spark, path.rstrip("/"), uuid.uuid4().hex
        try:
            commits = spark.read.schema(_COMMIT).json(f"{self.path}/commits/*.json").orderBy("number").collect()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            commits = []
        self.number = commits[-1].number + 1 if commits else 1
        self.buckets = commits[0].buckets if commits else buckets
        gone = {r for c in commits for r in c.replaces}
        self.runs = [c.run for c in commits if c.run not in gone]

    def _stored(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/runs/{r}/{kind}" for r in self.runs]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _write(self, digests: DataFrame) -> None:
        """The run's digests, each bucket in one place, and its filters."""
        rows = digests.select("bucket", "digest").repartition("bucket").sortWithinPartitions("bucket", "digest")
        rows.write.parquet(f"{self.path}/runs/{self.run}/digests")
        back = self.spark.read.schema(_RUN).parquet(f"{self.path}/runs/{self.run}/digests")
        back = back.repartition("bucket").sortWithinPartitions("bucket")
        back.mapInArrow(_filters, "bucket int, bits binary").write.parquet(f"{self.path}/runs/{self.run}/filters")

    def new_rows(self, df: DataFrame, text: str = "text", order: str = "ord") -> DataFrame:
        """The rows whose text no committed run has, one of each; their digests are this load's run."""
        own = digest(F.col(text))
        digests = df.filter(F.col(text).isNotNull()).select(own.alias("digest"), F.col(order).cast("bigint").alias("first"))
        digests = digests.groupBy("digest").agg(F.min("first").alias("first"))
        digests = digests.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(self.buckets)).cast("int"))
        filters = self._stored("filters", "bucket int, bits binary")
        both = digests.withColumn("bits", F.lit(None).cast("binary")).unionByName(filters, allowMissingColumns=True)
        both = both.repartition("bucket").sortWithinPartitions("bucket", F.col("bits").isNull())
        tested = materialize(both.mapInArrow(_tested, "bucket int, digest binary, first bigint, maybe boolean"), "tested_digests")
        asked = tested.filter("maybe").select("bucket", "digest")
        known = self._stored("digests", _RUN).join(asked, ["bucket", "digest"], "left_semi")
        fresh = tested.filter("not maybe").unionByName(tested.filter("maybe").join(known, ["bucket", "digest"], "left_anti"))
        fresh = materialize(fresh.select("bucket", "digest", "first"), "new_digests")
        self._write(fresh)
        named = df.withColumns({"_digest": own, "_first": F.col(order).cast("bigint")})
        firsts = fresh.select(F.col("digest").alias("_digest"), F.col("first").alias("_first"))
        rows = named.join(firsts, (named["_digest"] == firsts["_digest"]) & named["_first"].eqNullSafe(firsts["_first"]), "left_semi")
        return rows.unionByName(named.filter(F.col(text).isNull())).drop("_digest", "_first")

    def commit(self, replaces: list[str] = ()) -> None:
        """Makes the run count, by a rename that another load may have been faster with."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/{self.number:09d}.json")
        draft = jvm.org.apache.hadoop.fs.Path(f"{self.path}/drafts/{self.run}")
        files = place.getFileSystem(conf)
        files.mkdirs(place.getParent())
        out = files.create(draft, False)
        row = {"number": self.number, "run": self.run, "buckets": self.buckets, "replaces": list(replaces)}
        out.write(bytearray(json.dumps(row).encode()))
        out.close()
        if files.exists(place) or not files.rename(draft, place):
            files.delete(draft, False)
            raise RuntimeError("another load was committed meanwhile: repeat this one")

    def compact(self) -> None:
        """All committed runs as one; their files stay until nothing reads them and they are removed by hand."""
        if self.runs:
            self._write(self._stored("digests", _RUN))
            self.commit(self.runs)
