"""The durable task pipeline as transitions of state tables; one writer a graph.

Every transition is a pure function of the tables and the time, so a lost driver repeats it without harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Settings

QUEUED, RUNNING, SUCCEEDED, FAILED, RETRYING, PENDING, SKIPPED = "QUEUED", "RUNNING", "SUCCEEDED", "FAILED", "RETRYING", "PENDING", "SKIPPED"


def _after(now: Column, seconds: int) -> Column:
    return now + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))


def enqueue(tasks: DataFrame, asked: DataFrame, now: Column, *, max_attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """(tasks, answers (graph_no, task_no, created)): a graph has one active task; asking again names that one."""
    one = asked.dropDuplicates(["graph_no"])
    active = tasks.filter("active_key is not null").select(F.col("active_key").alias("graph_no"), F.col("task_no").alias("known"))
    joined = one.join(active, "graph_no", "left")
    fresh = joined.filter("known is null").select(
        "task_no", F.lit("INGEST").alias("task_type"), "graph_no", F.lit(QUEUED).alias("status"), "payload", F.lit(0).alias("progress_current"), F.lit(0).alias("progress_total"), F.lit(0).alias("attempts"),
        F.lit(max_attempts).alias("max_attempts"), now.alias("available_at"), now.alias("create_time"), F.lit(None).cast("timestamp_ntz").alias("lease_expires_at"), F.lit("").alias("worker_id"), F.lit(None).cast("string").alias("error"), F.col("graph_no").alias("active_key"),
    )
    return tasks.unionByName(fresh), joined.select("graph_no", F.coalesce("known", "task_no").alias("task_no"), F.col("known").isNull().alias("created"))


def claimable(tasks: DataFrame, now: Column) -> DataFrame:
    """QUEUED tasks that are due, first come first served."""
    return tasks.filter((F.col("status") == QUEUED) & (F.col("available_at") <= now)).orderBy("available_at", "create_time", "task_no")


def claim(tasks: DataFrame, now: Column, worker: str, *, lease_seconds: int = 900, count: int = 1) -> DataFrame:
    """Tasks with the next ``count`` due ones RUNNING under a lease."""
    mine = claimable(tasks, now).limit(count).select("task_no", F.lit(True).alias("mine"))
    t = tasks.join(mine, "task_no", "left")
    hit = F.coalesce("mine", F.lit(False))
    pick = lambda value, c: F.when(hit, value).otherwise(F.col(c))
    return t.withColumns({"status": pick(F.lit(RUNNING), "status"), "attempts": pick(F.col("attempts") + 1, "attempts"), "lease_expires_at": pick(_after(now, lease_seconds), "lease_expires_at"), "worker_id": pick(F.lit(worker), "worker_id")}).drop("mine")


def heartbeat(tasks: DataFrame, now: Column, worker: str, *, lease_seconds: int = 900) -> DataFrame:
    mine = (F.col("status") == RUNNING) & (F.col("worker_id") == worker)
    return tasks.withColumn("lease_expires_at", F.when(mine, _after(now, lease_seconds)).otherwise(F.col("lease_expires_at")))


def plan_steps(steps: DataFrame, wanted: DataFrame, *, max_attempts: int = 3) -> DataFrame:
    """Steps of runs after planning (run_no, step_key): new ones PENDING, unfinished ones no longer wanted SKIPPED."""
    w = wanted.select("run_no", "step_key", F.lit(True).alias("wanted")).distinct()
    runs = wanted.select("run_no").distinct().withColumn("planned", F.lit(True))
    joined = steps.withColumn("known", F.lit(True)).join(w, ["run_no", "step_key"], "full_outer").join(runs, "run_no", "left")
    obsolete = F.col("known") & F.col("planned") & F.col("wanted").isNull() & ~F.coalesce(F.col("status").isin(SUCCEEDED, SKIPPED), F.lit(False))
    return joined.select(
        F.coalesce("step_no", F.left(F.sha2(F.concat_ws("#", "run_no", "step_key"), 256), F.lit(16))).alias("step_no"), "run_no", "step_key",
        F.when(F.col("known").isNull(), PENDING).when(obsolete, SKIPPED).otherwise(F.col("status")).alias("status"),
        F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("max_attempts", F.lit(max_attempts)).alias("max_attempts"), "error", "started_at", "finished_at",
    )


def checkpoint(steps: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """Steps after events (run_no, step_key, event, error): started, succeeded, skipped (never undoes a success), failed;
    of several events of a step the last in the order started, skipped, failed, succeeded counts."""
    order = F.when(F.col("event") == "started", 0).when(F.col("event") == "skipped", 1).when(F.col("event") == "failed", 2).otherwise(3)
    last = events.groupBy("run_no", "step_key").agg(F.max_by(F.struct("event", "error"), order).alias("x"), F.count_if(F.col("event") == "started").alias("starts"))
    s = steps.join(last, ["run_no", "step_key"], "left")
    e = F.col("x.event")
    final = F.when(e == "started", RUNNING).when(e == "succeeded", SUCCEEDED).when(e == "failed", FAILED).when((e == "skipped") & (F.col("status") != SUCCEEDED), SKIPPED)
    return s.withColumns({
        "attempts": F.col("attempts") + F.coalesce("starts", F.lit(0)).cast("int"), "error": F.when(e == "failed", F.left(F.col("x.error"), F.lit(8000))).when(e == "succeeded", F.lit(None)).otherwise(F.col("error")),
        "started_at": F.when(F.coalesce("starts", F.lit(0)) > 0, now).otherwise(F.col("started_at")), "finished_at": F.when(e.isin("succeeded", "skipped", "failed"), now).otherwise(F.col("finished_at")),
        "status": F.coalesce(final, "status"),
    }).drop("x", "starts")


def reopen(steps: DataFrame, runs: DataFrame) -> DataFrame:
    """Steps with the failed ones of the runs PENDING again, their attempts counted anew."""
    mine = steps.join(runs.select("run_no", F.lit(True).alias("again")).distinct(), "run_no", "left")
    hit = F.col("again") & (F.col("status") == FAILED)
    out = mine.withColumns({"status": F.when(hit, PENDING).otherwise(F.col("status")), "attempts": F.when(hit, 0).otherwise(F.col("attempts")), "error": F.when(hit, F.lit(None)).otherwise(F.col("error"))})
    return out.select(*steps.columns)


def upsert_run(runs: DataFrame, mine: DataFrame, steps: DataFrame, status: str, error: str | None, now: Column) -> DataFrame:
    """Run table with the given runs (run_no, task_no, graph_no, base_version, target_version) in a status, their steps
    counted; a run keeps its first start, and one that is over its end."""
    over = status in (SUCCEEDED, FAILED)
    counted = mine.join(progress(steps), "run_no", "left").join(runs.select("run_no", F.col("started_at").alias("begun")), "run_no", "left")
    new = counted.select(
        "run_no", "task_no", "graph_no", "base_version", "target_version", F.lit(status).alias("status"), *[F.coalesce(c, F.lit(0)).cast("int").alias(f"{n}_steps") for c, n in (("total", "total"), ("completed", "completed"), ("failed", "failed"))],
        F.lit(error).cast("string").alias("error"), F.coalesce("begun", now).alias("started_at"), (now if over else F.lit(None).cast("timestamp_ntz")).alias("finished_at"),
    )
    return runs.join(mine.select("run_no"), "run_no", "left_anti").select(*new.columns).unionByName(new)


def progress(steps: DataFrame) -> DataFrame:
    """(run_no, total, completed, failed) in one pass; skipped steps count as completed."""
    return steps.groupBy("run_no").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status").isin(SUCCEEDED, SKIPPED)).alias("completed"), F.count_if(F.col("status") == FAILED).alias("failed"))


def finish(tasks: DataFrame, outcome: DataFrame, now: Column, *, retry_delay: int = Settings.retry_delay_seconds) -> DataFrame:
    """Tasks after outcomes (task_no, error): none is a success; a failure goes back to the queue after a delay while
    attempts are left, else it is final. Finished tasks give up their active key."""
    t = tasks.join(outcome.select("task_no", F.col("error").alias("why"), F.lit(True).alias("ended")), "task_no", "left")
    ended = F.coalesce("ended", F.lit(False))
    failed = ended & F.col("why").isNotNull()
    again = failed & (F.col("attempts") < F.col("max_attempts"))
    return t.withColumns({
        "status": F.when(again, QUEUED).when(failed, FAILED).when(ended, SUCCEEDED).otherwise(F.col("status")), "error": F.when(ended, F.left("why", F.lit(8000))).otherwise(F.col("error")),
        "available_at": F.when(again, _after(now, retry_delay)).otherwise(F.col("available_at")), "active_key": F.when(ended & ~again, F.lit(None)).otherwise(F.col("active_key")),
        "lease_expires_at": F.when(ended, F.lit(None)).otherwise(F.col("lease_expires_at")), "worker_id": F.when(ended, F.lit("")).otherwise(F.col("worker_id")),
    }).drop("why", "ended")


def recover_expired(tasks: DataFrame, now: Column) -> DataFrame:
    """RUNNING tasks without a lease or past it go back to the queue, or fail when their attempts are used up."""
    lost = (F.col("status") == RUNNING) & (F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") < now))
    spent = F.col("attempts") >= F.col("max_attempts")
    pick = lambda value, c: F.when(F.col("lost"), value).otherwise(F.col(c))
    return tasks.withColumn("lost", lost).withColumns({
        "status": pick(F.when(spent, FAILED).otherwise(QUEUED), "status"), "active_key": pick(F.when(~spent, F.col("graph_no")), "active_key"), "available_at": pick(now, "available_at"),
        "worker_id": pick(F.lit(""), "worker_id"), "error": pick(F.lit("worker lease expired"), "error"), "lease_expires_at": pick(F.lit(None), "lease_expires_at"),
    }).drop("lost")


def retry(tasks: DataFrame, asked: DataFrame, now: Column, *, max_attempts: int | None = None) -> DataFrame:
    """FAILED tasks asked for (task_no) queued afresh, unless their graph has an active task."""
    busy = tasks.filter("active_key is not null").select("graph_no", F.lit(True).alias("busy")).distinct()
    t = tasks.join(asked.select("task_no", F.lit(True).alias("asked")).distinct(), "task_no", "left").join(busy, "graph_no", "left")
    t = t.withColumn("go", F.coalesce("asked", F.lit(False)) & (F.col("status") == FAILED) & F.col("busy").isNull())
    pick = lambda value, c: F.when(F.col("go"), value).otherwise(F.col(c))
    return t.withColumns({"status": pick(F.lit(QUEUED), "status"), "attempts": pick(F.lit(0), "attempts"), "max_attempts": pick(F.lit(max_attempts) if max_attempts else F.col("max_attempts"), "max_attempts"), "available_at": pick(now, "available_at"), "error": pick(F.lit(None), "error"), "active_key": pick(F.col("graph_no"), "active_key")}).drop("go", "asked", "busy").select(*tasks.columns)


def task_list(tasks: DataFrame, runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Tasks with their run and its steps in key order, newest first."""
    parts = steps.groupBy("run_no").agg(F.array_sort(F.collect_list(F.struct("step_key", "status", "attempts", "error"))).alias("steps"))
    r = runs.select("task_no", "run_no", F.col("status").alias("run_status"), "target_version").join(parts, "run_no", "left")
    return tasks.join(r, "task_no", "left").orderBy(F.desc("create_time"), "task_no")


def due_order(tasks: DataFrame) -> DataFrame:
    """Place of every queued task in its graph's queue."""
    return tasks.filter(F.col("status") == QUEUED).withColumn("place", F.row_number().over(Window.partitionBy("graph_no").orderBy("available_at", "create_time", "task_no")))
