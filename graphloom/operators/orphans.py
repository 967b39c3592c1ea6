"""References without a valid target at their time.

A target id is valid on the union of the intervals [start, end) of its rows. On the axis of one id the
integer instants (microseconds) at which it is valid are the parent keys; they are compressed into
contiguous runs, each a run start and a run end, and a reference is matched as-of to the preceding run
start: beyond that run's end (or before the first run) it is an orphan.

The axis of an id is cut into slices, and every slice gets its own complete list of runs: those of the
target rows that start in it, merged with what earlier slices hand over (their furthest end, from one
row per id and slice). So each (id, slice) is matched by itself. Slices are ``slice_days`` long, or as
much shorter as it takes to have at most ``ROWS_A_GROUP`` target rows in each; references of a slice
that has more than that many are spread over as many groups, each with the slice's runs. No size of an
id or of one slice of it makes a group larger.

Defined results: null, blank and ``unknown`` references are no references; a reference without a
time is an orphan only where no row has its id; a target row without start is valid from the
beginning of time, one without end for ever, one whose end is not after its start never (it still
makes the id known); repeated target rows change nothing; repeated references are reported each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.storage import materialize

FOREVER = 2**62
#: Rows of one id and slice that one group of a task may hold.
ROWS_A_GROUP = 500_000
#: Ids and slices with more references than that are listed; a group grows before the list does.
LISTED = 10_000
_MICROS_A_DAY = 86_400_000_000


def micros(column: Column) -> Column:
    """Microseconds since 1970 of a timestamp, read as UTC (the session's zone plays no part for timestamp_ntz)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), column.cast("timestamp_ntz"))


def blank(column: Column) -> Column:
    """True where a text is null or only white space."""
    return F.coalesce(F.length(F.regexp_replace(column, r"[\s\p{Z}]+", "")) == 0, F.lit(True))


def _slice(width: int) -> Column:
    """The slice that ``ts`` lies in, in whole numbers."""
    return F.expr(f"(ts - pmod(ts, {width}L)) div {width}L")


def _slots(parents: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """(key, slice, until, last_start, known, targets, refs): one row per id and slice that anything lies in."""
    slot = _slice(width).alias("slice")
    none = F.lit(None).cast("bigint")
    own = parents.select("key", slot, "until", F.when(F.col("until").isNotNull(), F.col("ts")).alias("start_ts"), F.lit(1).alias("target"))
    both = own.unionByName(asked.select("key", slot, none.alias("until"), none.alias("start_ts"), F.lit(0).alias("target")))
    return both.groupBy("key", "slice").agg(
        F.max("until").alias("until"), F.max("start_ts").alias("last_start"), F.max("target").alias("known"), F.sum("target").alias("targets"), F.sum(1 - F.col("target")).alias("refs")
    )


def compress(intervals: DataFrame, group: list[str]) -> DataFrame:
    """(group, run_start, run_end, rows): the intervals [lo, hi) of each group merged into contiguous runs."""
    rows = intervals.where("hi > lo").groupBy(*group, "lo").agg(F.max("hi").alias("hi"), F.count(F.lit(1)).alias("rows"))
    ordered = Window.partitionBy(*group).orderBy("lo")
    before = F.max("hi").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    numbered = rows.withColumn("opens", F.when(before.isNull() | (F.col("lo") > before), 1).otherwise(0)).withColumn("run", F.sum("opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*group, "run").agg(F.min("lo").alias("run_start"), F.max("hi").alias("run_end"), F.sum("rows").alias("rows")).drop("run")


def reference_states(references: DataFrame, targets: DataFrame, slice_days: int = 30) -> DataFrame:
    """The references of ``references`` that have no valid target.

    references: key string, at timestamp, any payload columns; targets: key string, start, end.
    Returns the payload, ``at`` and ``state`` (missing, late, deleted).
    """
    payload = [c for c in references.columns if c not in ("key", "at")]
    start = F.coalesce(micros(F.col("start")), F.lit(-FOREVER))
    end = F.coalesce(micros(F.col("end")), F.lit(FOREVER))
    parents = targets.where(F.col("key").isNotNull()).select("key", start.alias("ts"), end.alias("until"))
    parents = parents.withColumn("until", F.when(F.col("until") > F.col("ts"), F.col("until")))  # null: never valid, but known
    asked = references.where(F.col("key").isNotNull()).select("key", F.coalesce(micros(F.col("at")), F.lit(-FOREVER - 1)).alias("ts"), F.struct("at", *payload).alias("ref"))

    width = slice_days * _MICROS_A_DAY
    slots = materialize(_slots(parents, asked, width), "slots")
    totals = slots.agg(F.max("targets").alias("targets"), F.sum("refs").alias("refs")).first()
    while (totals.targets or 0) > ROWS_A_GROUP and width > 1_000_000:
        width //= 8
        slots = materialize(_slots(parents, asked, width), "slots")
        totals = slots.agg(F.max("targets").alias("targets"), F.sum("refs").alias("refs")).first()
    a_group = max(ROWS_A_GROUP, (totals.refs or 0) // LISTED)
    slot = _slice(width)

    earlier = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("key")
    # one row per id and slice with references; targets of slices without any count through ``carried`` only
    heads = slots.select("key", "slice", "refs", F.max("until").over(earlier).alias("carried"), F.max("last_start").over(whole).alias("last_start"), F.max("known").over(whole).alias("known"))
    heads = heads.where("refs > 0").withColumn("salts", F.ceil(F.col("refs") / F.lit(a_group)).cast("int"))
    floor_ts = F.col("slice") * F.lit(width)
    intervals = (
        parents.where("until is not null").select("key", slot.alias("slice"), F.col("ts").alias("lo"), F.col("until").alias("hi"))
        .unionByName(heads.where("carried is not null").select("key", "slice", floor_ts.alias("lo"), F.col("carried").alias("hi")))
    )
    runs = compress(intervals, ["key", "slice"])

    busy = slots.where(F.col("refs") > F.lit(a_group)).select("key", "slice", F.ceil(F.col("refs") / F.lit(a_group)).cast("int").alias("salts"))  # at most LISTED rows
    listed = F.broadcast(busy)
    salt = F.coalesce(F.pmod(F.xxhash64("ref"), F.col("salts")).cast("int"), F.lit(0)).alias("salt")
    spread = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")
    events = (
        asked.withColumn("slice", slot).join(listed, ["key", "slice"], "left").select("key", "slice", salt, "ts", F.lit(2).alias("rank"), "ref")
        .unionByName(runs.join(listed, ["key", "slice"], "left").select("key", "slice", spread, F.col("run_start").alias("ts"), F.lit(1).alias("rank"), "run_end"), allowMissingColumns=True)
        .unionByName(heads.select("key", "slice", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(-FOREVER - 2).alias("ts"), F.lit(0).alias("rank"), "last_start", "known"), allowMissingColumns=True)
    )
    so_far = Window.partitionBy("key", "slice", "salt").orderBy("ts", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    judged = events.select(
        "ref", "ts", "rank",
        F.last("run_end", ignorenulls=True).over(so_far).alias("run_end"),  # of the preceding run start
        F.last("last_start", ignorenulls=True).over(so_far).alias("last_start"),
        F.last("known", ignorenulls=True).over(so_far).alias("known"),
    ).where("rank = 2")
    untimed = F.col("ts") < F.lit(-FOREVER)
    state = (
        F.when(F.col("known") == 0, "missing")
        .when(untimed | (F.coalesce(F.col("run_end"), F.lit(-FOREVER - 1)) > F.col("ts")), F.lit(None))
        .when(F.col("last_start") > F.col("ts"), "late")
        .otherwise("deleted")
    )
    return judged.select("ref.*", state.alias("state")).where(F.col("state").isNotNull())


def validity_runs(targets: DataFrame) -> DataFrame:
    """The runs themselves, one row per id and run: run_start, run_end."""
    rows = targets.where(F.col("key").isNotNull()).select("key", F.coalesce(micros(F.col("start")), F.lit(-FOREVER)).alias("lo"), F.coalesce(micros(F.col("end")), F.lit(FOREVER)).alias("hi"))
    return compress(rows, ["key"])
