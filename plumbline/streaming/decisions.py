"""Review decisions: a log applied once however often a batch comes, its compaction, and what decisions make of links.

A MergedTable keeps the latest row of each key, by seq, in buckets of keys. A batch rewrites the buckets that it touches
into new files, and a manifest that is renamed into place names the files that count and the last batch applied: a batch
that was replayed is passed over, and files without a manifest, of a run that broke off, are never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.scan import scratch

DECISIONS = ("approve", "reject", "reassign")
PARTS = 1024  # to which rows of one key are dealt when it is looked up


class MergedTable:
    """The latest row of each key in a folder of any file system of Spark's."""

    def __init__(self, spark: SparkSession, path: str, key: str, seq: str = "seq", buckets: int = 64):
        self.spark, self.path, self.key, self.seq, self.buckets = spark, path, key, seq, buckets
        self._jvm = spark.sparkContext._jvm
        self._fs = self._hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def manifest(self) -> dict:
        """Of the last commit: version, applied (batch id), and files: the folder of each bucket."""
        folder = self._hadoop(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        done = sorted(int(n) for n in names if n.isdigit())
        if not done:
            return {"version": 0, "applied": -1, "files": {}}
        stream = self._fs.open(self._hadoop(f"{self.path}/manifests/{done[-1]:012d}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        draft = self._hadoop(f"{self.path}/manifests/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs.rename(draft, self._hadoop(f"{self.path}/manifests/{manifest['version']:012d}")):
            raise RuntimeError("another writer has committed this version")

    def read(self) -> DataFrame | None:
        """The latest rows; None before the first batch."""
        files = sorted(set(self.manifest()["files"].values()))
        return self.spark.read.parquet(*files).drop("__bucket") if files else None

    def merge(self, batch: DataFrame, batch_id: int) -> bool:
        """Apply a batch (for foreachBatch); False if it was applied before. Of rows of a key the one of largest seq counts."""
        last = self.manifest()
        if batch_id <= last["applied"]:
            return False
        rows = batch.withColumn("__bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        latest = lambda df: df.groupBy("__bucket", self.key).agg(F.max_by(F.struct(*df.columns), self.seq).alias("r")).select("r.*")
        rows = fresh = latest(rows).persist()
        touched = [r[0] for r in rows.select("__bucket").distinct().collect()]  # at most `buckets` numbers
        files = last["files"]
        before = [files[str(b)] for b in touched if str(b) in files]
        if before:
            old = self.spark.read.parquet(*before)
            rows = latest(rows.unionByName(old.select(rows.columns)))
        if touched:
            folder = f"{self.path}/data/{batch_id:012d}-{uuid.uuid4().hex}"
            self._write(rows, folder, touched)
            files = files | {str(b): f"{folder}/b{b}" for b in touched}
        self._commit({"version": last["version"] + 1, "applied": batch_id, "files": files})
        fresh.unpersist()
        return True

    def _write(self, rows: DataFrame, folder: str, touched: list[int]) -> None:
        rows.withColumn("b", F.col("__bucket")).repartition("__bucket").write.partitionBy("b").parquet(folder)
        for b in touched:
            self._fs.rename(self._hadoop(f"{folder}/b={b}"), self._hadoop(f"{folder}/b{b}"))


def looked_up(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """rows(seq, key, ...) with the columns of table(key, ...), one row of which has a key; null where there is none.

    Rows without a key, and those of one that is named without end, are dealt to PARTS parts by seq; of the table only what
    rows name is given to these parts, once for each that has such rows."""
    rows = rows.withColumn("__part", F.pmod(F.xxhash64("seq"), F.lit(PARTS)).cast("int"))
    named = rows.where(F.col(key).isNotNull()).select(key, "__part").distinct()
    return rows.join(named.join(table, key), [key, "__part"], "left").drop("__part")


def _named(decisions: DataFrame, activities: DataFrame) -> DataFrame:
    """decisions, decision in lower case and trimmed, with whether the activity that a reassignment names is there (__known)."""
    d = decisions.withColumn("decision", F.lower(F.trim("decision"))).withColumn("__named", F.when(F.col("decision") == "reassign", F.col("activity_id")))
    return looked_up(d, "__named", activities.select(F.col("activity_id").alias("__named")).distinct().withColumn("__known", F.lit(True)))


def _matched(matches: DataFrame) -> DataFrame:
    return matches.groupBy(F.col("event_id")).agg(F.first("matched_activity_id", ignorenulls=True).alias("__match"), F.lit(True).alias("__event"))


def checked(decisions: DataFrame, matches: DataFrame, activities: DataFrame) -> DataFrame:
    """decisions(seq, event_id, decision, activity_id, ...) with the activity that counts (linked) and what is wrong (problem).

    approve takes the event's match, reassign the activity it names, reject none. Problems: unknown event, unknown
    decision, nothing to approve, reassign without activity, unknown activity; such decisions change nothing.
    """
    out = looked_up(_named(decisions, activities), "event_id", _matched(matches))
    problem = (
        F.when(F.col("__event").isNull(), "unknown event")
        .when(F.col("decision").isNull() | ~F.col("decision").isin(*DECISIONS), "unknown decision")
        .when((F.col("decision") == "approve") & F.col("__match").isNull(), "nothing to approve")
        .when((F.col("decision") == "reassign") & F.col("activity_id").isNull(), "reassign without activity")
        .when((F.col("decision") == "reassign") & F.col("__known").isNull(), "unknown activity")
    )
    linked = F.when(F.col("decision") == "approve", F.col("__match")).when(F.col("decision") == "reassign", F.col("activity_id"))
    return out.withColumn("problem", problem).withColumn("linked", F.when(problem.isNull(), linked)).select(*decisions.columns, "problem", "linked")


def review_state(decisions: DataFrame, matches: DataFrame, activities: DataFrame) -> DataFrame:
    """Of each event that was decided on: link_state, linked activity, who decided last and how often, decisions refused.

    The decision of largest seq counts among those without a problem (see checked). The last of each kind and counts meet by
    event in partial sums, and only then the event's match, so that an event decided on without end is not a hot one. An
    event with refused decisions alone keeps link_state null.
    """
    c = _named(decisions.select("seq", "event_id", "decision", "activity_id", "reviewer"), activities)
    fits = {k: F.coalesce(F.col("decision") == k, F.lit(False)) for k in DECISIONS}
    fits["reassign"] = fits["reassign"] & F.col("__known").isNotNull()
    last = [F.max_by(F.struct("seq", "reviewer", "activity_id"), F.when(f, F.col("seq"))).alias(k) for k, f in fits.items()]
    s = c.groupBy("event_id").agg(*last, *[F.count_if(f).alias(f"n_{k}") for k, f in fits.items()], F.count("*").alias("n"))
    s = s.join(_matched(matches), "event_id", "left")
    there, match = F.col("__event").isNotNull(), F.col("__match")
    take = {"approve": (there & match.isNotNull(), match), "reject": (there, F.lit(None)), "reassign": (there, F.col("reassign.activity_id"))}
    kind = F.when(F.lit(False), match).otherwise(F.col("reassign.activity_id"))  # the type that both have in common
    same = s.select(kind).schema[0].dataType
    row = lambda k, x: F.struct(F.col(f"{k}.seq").alias("seq"), F.lit(k).alias("decision"), x.cast(same).alias("linked"), F.col(f"{k}.reviewer").alias("reviewer"))
    l = F.array_max(F.array_compact(F.array(*[F.when(ok & F.col(k).isNotNull(), row(k, x)) for k, (ok, x) in take.items()])))  # noqa: E741
    good = sum((F.when(ok, F.col(f"n_{k}")).otherwise(0) for k, (ok, _) in take.items()), F.lit(0).cast("long"))
    s = s.select("event_id", l.alias("l"), good.alias("decisions"), (F.col("n") - good).alias("refused"))
    state = F.when(F.col("l.decision").isin("approve", "reassign"), "approved").when(F.col("l.decision") == "reject", "rejected")
    return s.select("event_id", state.alias("link_state"), F.col("l.linked").alias("linked_activity_id"), F.col("l.reviewer").alias("reviewer"), "decisions", "refused")


def live_heads(pointers: DataFrame) -> DataFrame:
    """(id, head, steps): the end of each chain of pointers(id, next) and how many steps lie before it, by doubling.

    A null next is an end, and so is one that no row has as id. Pointers are doubled until all stand at ends: rounds grow
    with the logarithm of the longest chain. A ring of pointers is an error, found when rounds exceed the rows' logarithm.
    """
    ids = pointers.select(F.col("id").alias("next")).distinct().withColumn("__there", F.lit(True))
    p = pointers.select("id", "next").join(ids, "next", "left").select("id", F.when(F.col("__there"), F.col("next")).alias("next"))
    p = scratch(p.select("id", F.coalesce("next", "id").alias("head"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("next").isNull().alias("done")), "heads")
    rounds, n = 0, p.count()
    while not p.where("not done").isEmpty():
        rounds += 1
        if 2 ** (rounds - 1) > 2 * max(n, 1):
            raise ValueError("pointers that lead in a ring have no end")
        ahead = p.select(F.col("id").alias("head"), F.col("head").alias("h"), F.col("steps").alias("s"), F.col("done").alias("d"))
        p = scratch(p.join(ahead, "head").select("id", F.col("h").alias("head"), (F.col("steps") + F.col("s")).alias("steps"), (F.col("done") | F.col("d")).alias("done")), "heads")
    return p.select("id", "head", "steps")
