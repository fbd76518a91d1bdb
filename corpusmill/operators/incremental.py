"""Processing only new or changed records, by Merkle trees over key ranges (problem 5).

A state is one (key, digest) per record. Its leaves are ranges of the hashed key, a node's digest is the exclusive or
of its records' digests. Two states are compared from the root down: only children of differing nodes are looked at,
and only records of differing leaves are read and compared one by one. The number of leaves follows the number of
records (``LEAF_RECORDS`` a leaf), so a few changes touch few leaves at any size.

``changed_documents`` compares, for every run, what had arrived with what was really embedded. A document's state
changes a few times over all runs; the trees are made of these changes (digest before xor digest after, and the place
in the order of runs), so they hold every run's state without a row for each run and record. Records are spread over
the runs only in leaves that differ, and only over the runs for which they differ.

``MerkleStore`` keeps published states on a shared file system: a version holds only the records of leaves that
changed, its tree names the version that holds each leaf, and one rename puts output, records and tree in force.

Aggregations combine on the map side; keys spread by hash, so no host, source or run is a hot key. Lists of leaves are
broadcast only after their rows were counted. The runs (one row a run) are the only rows the driver reads; more than
``RUNS_A_BLOCK`` are worked off in blocks.

Defined cases: null hash, document or url: no record; equal times: the largest fetch_id or run_id; repeated rows count
once; no embed row: everything that counts is changed; empty tables give an empty result.
"""

from __future__ import annotations

import dataclasses
import functools
import json
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import cut, small_side

LEAF_RECORDS = 4
FAN_BITS = 6
RUNS_A_BLOCK = 256
KEPT_VERSIONS = 16


def bits_for(records: int) -> int:
    """Bits of the leaf numbers for about ``LEAF_RECORDS`` records a leaf."""
    return max(4, min(40, math.ceil(math.log2(max(1, records) / LEAF_RECORDS))))


def leaf_of(key: Column, bits: int) -> Column:
    """The leaf whose range of hashed keys holds ``key``."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits)


def _xor(rows: Column, chosen: Column) -> Column:
    """Exclusive or of the digests of ``rows`` that ``chosen`` (a function of a row) takes."""
    return F.aggregate(F.filter(rows, chosen), F.lit(0).cast("bigint"), lambda total, x: total.bitwiseXOR(x["digest"]))


def descend(digests: DataFrame, differs: object, by: list[str], bits: int, fan_bits: int = FAN_BITS) -> DataFrame:
    """leaf and ``found``, what ``differs`` says about it, of the differing leaves, found from the root down.

    ``digests``: leaf, the columns ``by``, digest. ``differs`` makes an array column of a node's rows (struct of ``by``
    and digest); the node differs if it isn't empty.
    """
    shifts = [*range(0, bits, fan_bits), bits]
    levels = [digests.groupBy(F.col("leaf").alias("node"), *by).agg(F.bit_xor("digest").alias("digest"))]
    for low, high in zip(shifts, shifts[1:]):
        levels.append(levels[-1].groupBy(F.shiftright("node", high - low).alias("node"), *by).agg(F.bit_xor("digest").alias("digest")))

    def judged(level: DataFrame) -> DataFrame:
        rows = level.groupBy("node").agg(F.collect_list(F.struct(*by, "digest")).alias("rows"))  # as many as by-values
        return rows.select("node", differs(F.col("rows")).alias("found")).where("size(found) > 0")

    open_nodes = judged(levels[-1])
    for level, low, high in zip(reversed(levels[:-1]), reversed(shifts[:-1]), reversed(shifts[1:])):
        up = small_side(open_nodes.select(F.col("node").alias("_parent")))
        below = level.withColumn("_parent", F.shiftright("node", high - low)).join(up, "_parent", "left_semi").drop("_parent")
        open_nodes = judged(below)
    return open_nodes.withColumnRenamed("node", "leaf")


def _position(moments: list, column: Column, strictly: bool) -> Column:
    """How many of the sorted ``moments`` lie before ``column`` (or, strictly, not after it), by bisection."""
    at = column.cast("timestamp_ntz")

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        moment = F.lit(str(moments[middle])).cast("timestamp_ntz")
        return F.when(moment <= at if strictly else moment < at, among(middle + 1, high)).otherwise(among(low, middle))

    return among(0, len(moments))


def _steps(versions: Column) -> Column:
    """The states that (row, at) pairs go through: at and hash of the latest row so far, at each place in order."""
    ordered = F.array_sort(F.transform(versions, lambda v: v["at"]))
    return F.transform(ordered, lambda at: F.struct(at.alias("at"), F.array_max(F.filter(versions, lambda v: v["at"] <= at))["row"]["hash"].alias("hash")))


def _moves(key: Column, steps: Column) -> Column:
    """The digests that each step of a record's state puts in and takes out."""
    digest = lambda step: F.xxhash64(key, step["hash"])
    return F.transform(steps, lambda s, i: F.struct(s["at"].alias("at"), digest(s).bitwiseXOR(F.when(i > 0, digest(F.get(steps, i - 1))).otherwise(F.lit(0))).alias("digest")))


def _at(steps: Column, place: Column) -> Column:
    """The hash that holds at ``place``."""
    return F.try_element_at(F.filter(steps, lambda s: s["at"] <= place), F.lit(-1))["hash"]


def changed_documents(crawls: DataFrame, documents: DataFrame, embeds: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, document_id of each document that is new or changed for a run (definitions in TESTDATA.md, p5)."""
    listed = runs.select("run_id", "cutoff_at", "started_at").where("run_id is not null and cutoff_at is not null").distinct().collect()
    listed.sort(key=lambda r: (r.cutoff_at, r.run_id, str(r.started_at)))
    blocks = [_changed_in(crawls, documents, embeds, listed[k : k + RUNS_A_BLOCK]) for k in range(0, len(listed), RUNS_A_BLOCK)]
    if not blocks:
        return runs.select("run_id", F.lit(None).cast("bigint").alias("document_id")).limit(0)
    return functools.reduce(DataFrame.unionByName, blocks).distinct()


def _changed_in(crawls: DataFrame, documents: DataFrame, embeds: DataFrame, listed: list) -> DataFrame:
    cutoffs = sorted({r.cutoff_at for r in listed})
    starts = sorted({r.started_at for r in listed if r.started_at is not None})
    places = F.array(*[
        F.struct(F.lit(r.run_id).alias("run_id"), F.lit(cutoffs.index(r.cutoff_at)).alias("cut"), F.lit(-1 if r.started_at is None else starts.index(r.started_at)).alias("start"))
        for r in listed
    ])

    counting = "url is not null and status = 'success' and http_status = 200 and content_hash is not null and body_bytes > 0 and fetched_at is not null and arrived_at is not null"
    fetched = crawls.where(counting).select(
        "url", _position(cutoffs, F.col("arrived_at"), False).alias("at"), F.struct("fetched_at", "fetch_id", F.lower("content_hash").alias("hash")).alias("row")
    )
    latest = fetched.where(F.col("at") < len(cutoffs)).groupBy("url", "at").agg(F.max("row").alias("row"))
    by_url = latest.groupBy("url").agg(_steps(F.collect_list(F.struct("row", "at"))).alias("now"))
    known = documents.where("document_id is not null and url is not null").select("document_id", "url").distinct()

    done = embeds.where("skipped = false and finished_at is not null and document_id is not null").select(
        "document_id", _position(starts, F.col("finished_at"), True).alias("at"), F.struct("finished_at", "run_id", F.lower("content_hash").alias("hash")).alias("row")
    )
    saved = done.where(F.col("at") < len(starts)).groupBy("document_id", "at").agg(F.max("row").alias("row"))
    saved = saved.groupBy("document_id").agg(_steps(F.collect_list(F.struct("row", "at"))).alias("saved"))

    states = cut(by_url.join(known, "url").select("document_id", "now").join(saved, "document_id", "left"))
    bits = bits_for(states.count())
    key, leaf = F.col("document_id"), leaf_of(F.col("document_id"), bits).alias("leaf")
    moves = [states.select(leaf, F.lit(side).alias("side"), F.inline(_moves(key, F.col(side)))) for side in ("now", "saved")]

    def differs(rows: Column) -> Column:
        side = lambda name, place: _xor(rows, lambda x: (x["side"] == name) & (x["at"] <= place))
        return F.filter(places, lambda p: side("now", p["cut"]) != side("saved", p["start"]))

    leaves = small_side(descend(moves[0].unionByName(moves[1]), differs, ["side", "at"], bits))
    read = states.withColumn("leaf", leaf_of(key, bits)).join(leaves, "leaf").select("document_id", "now", "saved", F.explode("found").alias("run"))
    pair = read.select(F.col("run.run_id").alias("run_id"), "document_id", _at(F.col("now"), F.col("run.cut")).alias("now"), _at(F.col("saved"), F.col("run.start")).alias("saved"))
    return pair.where("now is not null").where(~F.col("now").eqNullSafe(F.col("saved"))).select("run_id", "document_id").distinct()


class Conflict(RuntimeError):
    """Another run has published since the changes were taken."""


@dataclass(frozen=True)
class Changes:
    """rows: key, change ('added', 'changed' or 'removed'); records: the snapshot they were taken from, with its leaves;
    leaves: the differing leaves; number: that of the commit compared with."""

    rows: DataFrame
    records: DataFrame
    leaves: DataFrame
    number: int
    bits: int
    whole: bool


class MerkleStore:
    """A published state of (key, digest) records with its tree, on a shared file system.

    ``changes`` takes a snapshot of the records and gives those to process; ``publish`` writes the output and the
    snapshot's changed leaves into a new version folder and commits them by renaming one file to the next free number.
    A failure before the rename leaves the last commit in force, so the next run finds the same changes again. Of two
    runs that started from one commit the second gets ``Conflict``. Records that arrive after ``changes`` are no part of
    the snapshot and wait for the next run.

    After ``KEPT_VERSIONS`` versions, or when the records have outgrown the leaves eightfold, all leaves are written anew.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def _commit(self) -> tuple[int, dict | None]:
        """Number and content of the commit in force."""
        at = self._path(f"{self.folder}/commits")
        if not self._fs.exists(at):
            return 0, None
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        number = max((int(n) for n in names if n.isdigit()), default=0)
        return number, json.loads(self.spark.read.text(f"{self.folder}/commits/{number:020d}").first()[0]) if number else None

    def version(self) -> str | None:
        """The version in force."""
        kept = self._commit()[1]
        return kept["version"] if kept else None

    def output(self, name: str = "output") -> DataFrame | None:
        """The output that was published last."""
        version = self.version()
        return self.spark.read.parquet(f"{self.folder}/{version}/{name}") if version else None

    def changes(self, df: DataFrame, key: str, digest: str) -> Changes:
        """The changes against the commit in force; of its records only those of differing leaves are read."""
        own = df.select(F.col(key).alias("key"), F.col(digest).cast("string").alias("digest")).where("key is not null and digest is not null")
        records = cut(own.groupBy("key").agg(F.max("digest").alias("digest")))
        fresh_bits = bits_for(records.count())
        number, last = self._commit()
        bits = last["bits"] if last else fresh_bits
        records = records.withColumn("leaf", leaf_of(F.col("key"), bits))
        now = self._tree(records).withColumn("side", F.lit("now"))
        tree = self.spark.read.parquet(f"{self.folder}/{last['version']}/tree") if last else None
        digests = now if tree is None else now.unionByName(tree.select("leaf", "digest").withColumn("side", F.lit("saved")))
        side = lambda rows, name: _xor(rows, lambda x: x["side"] == name)
        found = descend(digests, lambda rows: F.when(side(rows, "now") != side(rows, "saved"), F.array(F.lit(1))).otherwise(F.array()), ["side"], bits)
        leaves = small_side(found.select("leaf"))
        mine = records.join(leaves, "leaf", "left_semi").select("key", F.col("digest").alias("now"))
        if tree is None:
            pair = mine.withColumn("saved", F.lit(None).cast("string"))
        else:
            versions = last["versions"]
            live = tree.join(leaves, "leaf", "left_semi").select("leaf", "version")
            stored = functools.reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.folder}/{v}/records").withColumn("version", F.lit(v)) for v in versions])
            saved = stored.join(live, ["leaf", "version"], "left_semi").select("key", F.col("digest").alias("saved"))
            pair = mine.join(saved, "key", "full")
        change = F.when(F.col("saved").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
        rows = cut(pair.where(~F.col("now").eqNullSafe(F.col("saved"))).select("key", change.alias("change")))
        whole = last is None or len(last["versions"]) >= KEPT_VERSIONS or fresh_bits > bits + 3
        if whole and fresh_bits != bits:
            bits, records = fresh_bits, records.withColumn("leaf", leaf_of(F.col("key"), fresh_bits))
        return Changes(rows, records, leaves, number, bits, whole)

    @staticmethod
    def _tree(records: DataFrame) -> DataFrame:
        return records.groupBy("leaf").agg(F.bit_xor(F.xxhash64("key", "digest")).alias("digest"))

    def publish(self, changes: Changes, output: DataFrame | dict[str, DataFrame], failed: DataFrame | None = None) -> str:
        """Writes ``output`` (or several by name) and the changed leaves of the snapshot, then puts them in force together.

        ``failed``: keys that couldn't be processed; they stay changes for the next run."""
        version = f"v-{uuid.uuid4().hex}"
        at, last = f"{self.folder}/{version}", self._commit()[1]
        for name, frame in (output if isinstance(output, dict) else {"output": output}).items():
            frame.write.parquet(f"{at}/{name}")
        if failed is not None:
            marked = failed.select(F.col("key").alias("_failed")).distinct()
            joined = changes.records.join(marked, F.col("key") == F.col("_failed"), "left")
            undone = joined.withColumn("digest", F.when(F.col("_failed").isNotNull(), F.concat(F.lit("failed:"), "digest")).otherwise(F.col("digest"))).drop("_failed")
            changes = dataclasses.replace(changes, records=undone)
        records = changes.records if changes.whole else changes.records.join(changes.leaves, "leaf", "left_semi")
        records.repartitionByRange("leaf").sortWithinPartitions("leaf").write.parquet(f"{at}/records")
        tree = self._tree(self.spark.read.parquet(f"{at}/records")).withColumn("version", F.lit(version))
        if not changes.whole:
            kept = self.spark.read.parquet(f"{self.folder}/{last['version']}/tree").join(changes.leaves, "leaf", "left_anti")
            tree = tree.unionByName(kept)
        tree.write.parquet(f"{at}/tree")
        versions = [version] if changes.whole else [*last["versions"], version]
        fresh, place = self._path(f"{self.folder}/commits/pending-{version}"), self._path(f"{self.folder}/commits/{changes.number + 1:020d}")
        stream = self._fs.create(fresh, True)
        stream.write(bytearray(json.dumps({"version": version, "bits": changes.bits, "versions": versions}).encode()))
        stream.close()
        try:
            self._context.rename(fresh, place, self._no_options)  # fails if the place is taken
        except Exception as e:
            if self._fs.exists(place):
                self._fs.delete(fresh, False)
                raise Conflict(f"{self.folder} has moved on to commit {changes.number + 1}") from e
            raise
        return version
