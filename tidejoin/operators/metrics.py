"""Run metrics as rows: one record per run, and derived times and rates."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions.money import ratio

SCHEMA = "run_id string, job string, parallelism int, updates_total long, join_deltas_total long, groups_total long, snapshots_total long, wall_time_ms long, phases_ms map<string,long>"
PROCESSING = ("join", "aggregate", "topk", "sink")


def record(spark: SparkSession, **values) -> DataFrame:
    """One row of ``SCHEMA``; what isn't given is null, the run id is new."""
    names = [x.strip().split(" ")[0] for x in SCHEMA.split(", ")]
    row = spark.createDataFrame([tuple(values.get(n) for n in names)], SCHEMA)
    return row.withColumn("run_id", F.coalesce("run_id", F.uuid()))


def of_stream(spark: SparkSession, progress: list, job: str, parallelism: int = 1, join_deltas: int | None = None) -> DataFrame:
    """A run's record from the progress reports of a streaming query (``query.recentProgress``)."""
    took = [dict(p["durationMs"]) for p in progress]
    total = lambda *names: sum(int(d.get(n, 0)) for d in took for n in names)
    phases = {"load": total("latestOffset", "getBatch"), "plan": total("queryPlanning"), "join": total("addBatch"), "commit": total("walCommit", "commitOffsets")}
    return record(spark, job=job, parallelism=parallelism, updates_total=sum(int(p["numInputRows"]) for p in progress), join_deltas_total=join_deltas, snapshots_total=len(progress), wall_time_ms=total("triggerExecution"), phases_ms=phases)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def summary(runs: DataFrame) -> DataFrame:
    """Processing time (the sum of its phases), the gap to the wall time, and rates.

    Rates divide by the wall time if the run was parallel, else by the processing time; by 0 they are 0.
    """
    processing = sum((F.coalesce(F.element_at("phases_ms", F.lit(p)), F.lit(0).cast("long")) for p in PROCESSING), F.lit(0).cast("long"))
    df = runs.withColumn("processing_time_ms", processing)
    base = F.when(F.col("parallelism") > 1, F.col("wall_time_ms")).otherwise(F.col("processing_time_ms"))
    return df.withColumns({
        "cluster_gap_ms": F.greatest(F.col("wall_time_ms") - F.col("processing_time_ms"), F.lit(0).cast("long")),
        "updates_per_sec": F.round(ratio(F.col("updates_total") * 1000, base), 3),
        "join_deltas_per_sec": F.round(ratio(F.col("join_deltas_total") * 1000, base), 3),
    })


class Run:
    """A run's record, gathered while it runs: times of phases, and counts that Spark takes along with the rows."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.job, self.began = spark, job, time.time()
        self.took: dict[str, int] = {}
        self.counts: dict[str, list[Observation]] = {}

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        began = time.time()
        try:
            yield
        finally:
            self.took[name] = self.took.get(name, 0) + int(1000 * (time.time() - began))

    def counted(self, df: DataFrame, total: str, n: Column | None = None) -> DataFrame:
        """``df``, whose rows (or the sum of ``n``) add to a total when it is next computed; no pass of its own."""
        seen = Observation()
        self.counts.setdefault(total, []).append(seen)
        return df.observe(seen, F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("n") if n is not None else F.count("*").alias("n"))

    def record(self, **more) -> DataFrame:
        """The record after all that was counted has been computed."""
        totals = {k: sum(o.get["n"] for o in seen) for k, seen in self.counts.items()}
        return record(self.spark, job=self.job, parallelism=self.spark.sparkContext.defaultParallelism, wall_time_ms=int(1000 * (time.time() - self.began)), phases_ms=dict(self.took), **totals, **more)


class StreamTotals(StreamingQueryListener):
    """Sums of all progress reports of the queries that run while it listens; a query itself keeps the last hundred only."""

    def __init__(self) -> None:
        self.rows, self.batches, self.took = 0, 0, {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.rows += p.numInputRows
        self.batches += 1
        for k, ms in p.durationMs.items():
            self.took[k] = self.took.get(k, 0) + ms

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
