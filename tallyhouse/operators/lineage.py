"""Fingerprints, reuse, retention and event logs (L-series, A-18, A-20)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import scratch


def inputs_sha256(files: DataFrame, by: str, hash_col: str, version: str = "1") -> DataFrame:
    """L-01: one fingerprint per group of files, whatever their order.

    The hashes are dealt to 4,096 buckets by their first digits; each bucket is
    hashed by itself and then the buckets are, so no list holds a whole group.
    """
    bucket = F.left(hash_col, F.lit(3))
    listed = lambda c: F.array_join(F.array_sort(F.collect_list(c)), "\n")
    parts = files.groupBy(by, bucket.alias("bucket")).agg(F.sha2(listed(hash_col).cast("binary"), 256).alias("h"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda x: F.concat(x["bucket"], F.lit(":"), x["h"])), "\n")
    return parts.groupBy(by).agg(F.sha2(F.concat(F.lit(f"v{version}\n"), whole).cast("binary"), 256).alias("fingerprint"))


def new_fingerprints(incoming: DataFrame, manifest: DataFrame) -> DataFrame:
    """L-02: groups without a completed snapshot of the same inputs."""
    done = manifest.filter("status = 'completed'").select("fingerprint")
    return incoming.join(done, "fingerprint", "left_anti")


def reusable_runs(wanted: DataFrame, runs: DataFrame) -> DataFrame:
    """L-03: runs equal in every setting, null equal to null."""
    keys = ["snapshot_id", "config_hash", "engine_version", "label", "as_of"]
    a, b = wanted.alias("a"), runs.filter("status = 'completed'").alias("b")
    same = None
    for k in keys:
        one = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        same = one if same is None else same & one
    return a.join(b, same).select(*[F.col(f"a.{k}") for k in keys], F.col("b.run_id"))


def latest_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """L-04: the newest row of each group."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def list_runs(runs: DataFrame, status: str | None = None) -> DataFrame:
    """L-05: runs, newest first."""
    found = runs if status is None else runs.filter(F.col("status") == F.lit(status))
    return found.orderBy(F.desc("started_at"), "run_id")


def equality(a: DataFrame, b: DataFrame) -> DataFrame:
    """L-06: rows and order-free checksum of two tables, in one row; repeated rows count."""

    def digest(df: DataFrame, n: str) -> DataFrame:
        columns = [F.col(f"`{c}`") for c in sorted(df.columns)]
        total = F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
        return df.agg(F.count(F.lit(1)).alias(f"rows_{n}"), total.alias(f"sum_{n}"))

    both = digest(a, "a").join(digest(b, "b"))  # one row each
    return both.withColumn("equal", (F.col("rows_a") == F.col("rows_b")) & (F.col("sum_a") == F.col("sum_b")))


def trace(records: DataFrame, files: DataFrame, snapshots: DataFrame, connections: DataFrame) -> DataFrame:
    """L-07, J-11: record -> file -> snapshot -> connection."""
    return records.join(files, ["file_id"]).join(snapshots, ["snapshot_id"]).join(connections, ["connection_id"])


def trace_report(reports: DataFrame, runs: DataFrame, snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """L-07, J-12: report -> run -> snapshot -> the files it was read from, one row per file."""
    return reports.join(runs, ["run_id"]).join(snapshots, ["snapshot_id"]).join(files, ["snapshot_id"])


def retention(rows: DataFrame, policy: DataFrame, now: Column, cap: int) -> DataFrame:
    """L-08: terminal rows older than their status allows, oldest first, at most ``cap`` per status.

    ``policy`` has status and keep_days; a policy row may have a floor of its
    own, ``least_days``, below which nothing goes (audit rows are kept at least
    that long whatever is set). The cap is the feature: one sweep's size.
    """
    if "least_days" in policy.columns:
        policy = policy.withColumn("keep_days", F.greatest("keep_days", F.coalesce("least_days", F.lit(0)))).drop("least_days")
    old = rows.join(policy, "status").filter(F.col("at") < now - F.make_dt_interval(F.col("keep_days")))
    rank = F.row_number().over(W.partitionBy("status").orderBy("at", "id"))
    return old.withColumn("rank", rank).filter(F.col("rank") <= cap)


def event_filter(events: DataFrame, limit: int | None = None, **equal: object) -> DataFrame:
    """L-09: events with all given values, oldest first."""
    for column, value in equal.items():
        events = events.filter(F.col(column) == F.lit(value))
    out = events.orderBy("ts", "event_id")
    return out.limit(limit) if limit is not None else out


def rollup(events: DataFrame, a: str, b: str, at: str) -> DataFrame:
    """A-18, A-19: counts and oldest row by ``a``, by ``b`` and in all, by grouping sets."""
    sets = events.groupingSets([[F.col(a)], [F.col(b)], []], F.col(a), F.col(b))
    return sets.agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("oldest"), F.grouping_id().alias("level"))


#: Parts that the values in question are told apart in, at a pass over them.
SELECT_BINS = 1024


def percentiles(df: DataFrame, key: str, value: str) -> DataFrame:
    """A-20: median interpolated; p95 and p99 are observed values. NaN counts as no value.

    The ranks are found by selection: a pass counts the values of each part of
    the range in question, and only the part that holds the rank is looked at
    again, until it is one value. No task holds a key's values, however many
    it has; a pass shuffles at most ``SELECT_BINS`` counts for each key, rank
    and task.
    """
    v = F.col(value).cast("double")
    rows = df.select(F.col(key).alias("k"), F.when(~F.isnan(v), v).alias("v"))
    known = rows.filter("v is not null")
    stats = rows.groupBy("k").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"))
    stats = scratch.table(stats, "percentiles")
    n = F.col("n")
    whole = lambda e: e.cast("long")
    ranks = {"m1": whole(F.floor((n + 1) / 2)), "m2": whole(F.floor(n / 2) + 1), "p95": whole(F.floor((95 * n + 99) / 100)), "p99": whole(F.floor((99 * n + 99) / 100))}
    wanted = stats.filter("n > 0").select("k", F.inline(F.array(*[F.struct(F.lit(name).alias("name"), e.alias("rank")) for name, e in ranks.items()])), "low", "high")
    open_ = scratch.table(wanted, "percentiles")
    done = []
    while True:
        done.append(open_.filter("low = high").select("k", "name", F.col("low").alias("x")))
        open_ = open_.filter("low < high")
        if open_.limit(1).count() == 0:
            break
        # a row of bounds for each key; a key with very many rows can be split
        bounds = scratch.table(open_.groupBy(F.col("k").alias("b_k")).agg(F.collect_list(F.struct("name", "low", "high")).alias("b")), "percentiles")
        # halved where a difference could overflow; small values are not, since half of the least is zero
        scale = lambda b: F.when(F.greatest(F.abs(b["low"]), F.abs(b["high"])) > 1e300, 0.5).otherwise(1.0)
        width = lambda high, b: high * scale(b) - b["low"] * scale(b)
        part = lambda b: F.least(F.floor(width(F.col("v"), b) / width(b["high"], b) * SELECT_BINS), F.lit(SELECT_BINS - 1))
        hits = F.transform(F.filter("b", lambda b: F.col("v").between(b["low"], b["high"])), lambda b: F.struct(b["name"].alias("name"), part(b).alias("part")))
        placed = known.join(bounds, F.col("k").eqNullSafe(F.col("b_k"))).select("k", "v", F.inline(hits))
        counted = placed.groupBy("k", "name", "part").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        counted = counted.withColumn("upto", F.sum("c").over(W.partitionBy("k", "name").orderBy("part")))
        ranked = counted.join(open_.select(F.col("k").alias("o_k"), F.col("name").alias("o_name"), "rank"), F.col("k").eqNullSafe(F.col("o_k")) & (F.col("name") == F.col("o_name")))
        chosen = ranked.filter("upto >= rank and upto - c < rank")
        open_ = scratch.table(chosen.select("k", "name", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), "low", "high"), "percentiles")
    values = reduce(DataFrame.unionByName, done).groupBy(F.col("k").alias("v_k")).agg(*[F.max(F.when(F.col("name") == name, F.col("x"))).alias(name) for name in ranks])
    out = stats.join(values, F.col("k").eqNullSafe(F.col("v_k")), "left")
    median = F.when(F.col("m1") == F.col("m2"), F.col("m1")).otherwise(half_sum("m1", "m2"))
    return out.select(F.col("k").alias(key), "n", median.alias("median"), "p95", "p99", F.col("low").alias("min"), F.col("high").alias("max"), "mean", (F.col("p95") == F.col("high")).alias("p95_is_max"))


def half_sum(a: str, b: str) -> Column:
    return F.col(a) + (F.col(b) - F.col(a)) / 2
