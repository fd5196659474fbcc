"""Attempt logs: outcomes, failure streaks, cool-off intervals, health.

An attempt log has few providers and very many rows, so a window per provider would put a
provider's whole history into one task. failure_streaks instead cuts the log, ordered by provider
and time, into ranges of equal size that may end in the middle of a provider, reads each range
once, and carries what is needed over the range borders. The ordering columns are unique, so no
key, however hot, makes a range large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark import rules
from tidemark.session import stage

ORDER = ["ts_s", "request_id", "chain_pos"]
LIMIT = rules.FAILURE_LIMIT
OUTCOMES = ["success", "failed", "rejected"]
_NONE = -1       # no cool-off yet
_OPENS = [f"_open{carry}" for carry in range(LIMIT + 1)]


def request_outcomes(attempts: DataFrame, last_pos: int) -> DataFrame:
    """Per request the first success in chain order, else 'none' with all errors in order.

    Position 0 is an attempt at an explicitly named model: it may succeed, but its error is not
    listed. Any status but success is an error, a skipped or missing one included. Equal errors at
    one position count once, with their number; so a request's list is as long as it has different
    errors, and attempts combine map-side before any list is made. Attempts outside 0..last_pos
    take no part; stray_attempts counts them.
    """
    inside = F.coalesce(F.col("chain_pos").between(0, last_pos), F.lit(False))
    ok = inside & F.col("status").eqNullSafe("success")
    said = F.concat(F.coalesce("provider", F.lit("None")), F.lit(": "), F.coalesce("error", F.lit("None")))
    errors = attempts.groupBy("request_id", "chain_pos", F.when(inside & ~ok & (F.col("chain_pos") > 0), said).alias("_said")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(~inside).alias("_stray"),
        F.min(F.when(ok, F.struct("chain_pos", "ts_s", "provider", "latency_ms"))).alias("_won"),
    )
    times = F.when(F.col("_n") > 1, F.concat(F.lit(" x"), F.col("_n").cast("string"))).otherwise(F.lit(""))
    listed = F.when(F.col("_said").isNotNull(), F.struct("chain_pos", F.col("_said"), F.concat("_said", times).alias("text")))
    grouped = errors.groupBy("request_id").agg(
        F.min("_won").alias("_won"), F.sum("_stray").alias("stray_attempts"), F.sort_array(F.collect_list(listed)).alias("_errors"))
    won = F.col("_won").isNotNull()
    return grouped.select(
        "request_id",
        F.when(won, F.col("_won.provider")).otherwise("none").alias("provider"),
        F.when(won, "success").otherwise("failed").alias("status"),
        F.col("_won.chain_pos").alias("chain_pos"),
        F.col("_won.latency_ms").alias("latency_ms"),
        F.when(~won, F.array_join(F.transform("_errors", lambda e: e["text"]), "; ")).alias("error"),
        "stray_attempts",
    )


def provider_outcomes(attempts: DataFrame) -> DataFrame:
    """The attempts that say something about a provider: successes, failures and rejections.

    A skipped attempt was never made, a blocked request never sent; rows without a provider or
    status say nothing either.
    """
    return attempts.filter(F.col("status").isin(OUTCOMES) & F.col("provider").isNotNull())


def _carry_forward(values: np.ndarray, valid: np.ndarray, start: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Last valid value up to each row and not before its segment's start, else before[row]."""
    index = np.arange(len(values))
    last = np.maximum.accumulate(np.where(valid, index, -1))
    return np.where(last >= start, values[np.maximum(last, 0)], before)


class _RangeReader:
    """Reads one range in order, keeping the state of the provider it is in.

    run counts the failures since the last success, or since the range began when no success was
    seen yet (closed is False); _open<c> is the cool-off end if c failures preceded the range.
    """

    def __init__(self, cool_off: int):
        self.cool_off = cool_off
        self.first = self.key = None
        self.head, self.run, self.closed = True, 0, False
        self.opens = [_NONE] * len(_OPENS)

    def read(self, rows: pa.RecordBatch) -> list[np.ndarray]:
        """Columns _head, _run, _closed and the cool-off ends before each row."""

        def numbers(name: str) -> np.ndarray:
            return rows[name].to_numpy(zero_copy_only=False)

        def flags(mask: pa.Array) -> np.ndarray:
            return mask.to_numpy(zero_copy_only=False)

        count = rows.num_rows
        index = np.arange(count)
        key, ts = rows["provider"], numbers("ts_s")
        is_state = flags(rows["_state"])
        failed = ~(flags(pc.fill_null(pc.equal(rows["status"], "success"), False)) | is_state)

        fresh = np.empty(count, bool)
        if self.first is None:
            self.first = self.key = key[0].as_py()
        fresh[0] = key[0].as_py() != self.key
        fresh[1:] = flags(pc.not_equal(key[1:], key[:-1]))
        start = np.maximum.accumulate(np.where(fresh, index, 0))
        old = ~np.maximum.accumulate(fresh)     # rows of the provider carried from the last batch
        head = self.head & old

        # A row resets the run at a success, at given state, and at a provider's first row.
        given = np.where(is_state, numbers("_streak"), 0)
        base = np.where(failed, 1, given)
        reset = fresh | ~failed
        since = np.maximum.accumulate(np.where(reset, index, -1))
        run = np.where(since >= 0, base[np.maximum(since, 0)] + index - since, self.run + index + 1)
        closed = _carry_forward(np.ones(count, bool), ~failed, start, old & self.closed)
        # Only the range's head provider may have failures before the range.
        closed |= ~head

        out = [head, run, closed]
        given_open = numbers("_open")
        for carry in range(len(_OPENS)):
            streak = run + np.where(closed, 0, carry)
            opening = failed & (streak >= LIMIT)
            value = np.where(is_state, given_open, ts + self.cool_off)
            upto = _carry_forward(
                value, opening | is_state, start, np.where(old, self.opens[carry], _NONE)
            )
            before = np.empty(count, np.int64)
            before[0] = _NONE if fresh[0] else self.opens[carry]
            before[1:] = np.where(fresh[1:], _NONE, upto[:-1])
            out.append(before)
            self.opens[carry] = int(upto[-1])
        self.key, self.head = key[-1].as_py(), bool(head[-1])
        self.run, self.closed = int(run[-1]), bool(closed[-1])
        return out


def _read_range(cool_off: int, columns: list[str]):
    names = [*columns, "_head", "_run", "_closed", *_OPENS, "_chunk", "_tail", "_first"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId()
        reader = _RangeReader(cool_off)
        types = {}
        for rows in batches:
            count = rows.num_rows
            if count == 0:
                continue
            types = {name: rows[name].type for name in columns}
            yield pa.RecordBatch.from_arrays(
                [rows[name] for name in columns]
                + [pa.array(values) for values in reader.read(rows)]
                + [pa.array(np.full(count, chunk, np.int32)), pa.array(np.zeros(count, bool)), pa.nulls(count, pa.string())],
                names,
            )
        if types:
            # One closing row with the state after the range's last attempt.
            yield pa.RecordBatch.from_arrays(
                [pa.array([reader.key if n == "provider" else None], t) for n, t in types.items()]
                + [pa.array([reader.head]), pa.array([reader.run], pa.int64()), pa.array([reader.closed])]
                + [pa.array([end], pa.int64()) for end in reader.opens]
                + [pa.array([chunk], pa.int32()), pa.array([True]), pa.array([reader.first])],
                names,
            )

    return read


def _carries(tails: DataFrame) -> DataFrame:
    """What each range inherits from the ones before it.

    tails has one row per range, so its size is the number of shuffle partitions, whatever the
    size of the log; the windows over it run in one task.
    """
    by_chunk = Window.orderBy("_chunk")
    follows = F.coalesce(F.lag("provider").over(by_chunk) == F.col("_first"), F.lit(False))
    # A range passes its inheritance on when all of it is one provider and nothing reset the run.
    linked = tails.withColumn("_follows", follows).withColumns({
        "_adds": F.col("_follows") & F.col("_head") & ~F.col("_closed"),
        "_through": F.col("_follows") & F.col("_head"),
    })

    def island(passes: str) -> Column:
        return F.sum(F.when(F.col(passes), 0).otherwise(1)).over(by_chunk)

    def upto(group: str):
        return Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)

    streaks = (
        linked.withColumn("_group", island("_adds"))
        .withColumn("_after", F.sum("_run").over(upto("_group")))
        .withColumn("_carry", F.when(F.col("_follows"), F.lag("_after").over(by_chunk)).otherwise(F.lit(0)))
    )
    level = F.when(F.col("_head"), F.least("_carry", F.lit(LIMIT))).otherwise(F.lit(0))
    own = F.element_at(F.array(*_OPENS), (level + 1).cast("int"))
    return (
        streaks.withColumn("_own", F.nullif(own, F.lit(_NONE)))
        .withColumn("_group", island("_through"))
        .withColumn("_last", F.last("_own", ignorenulls=True).over(upto("_group")))
        .withColumn("_carry_open", F.when(F.col("_follows"), F.lag("_last").over(by_chunk)))
        .select("_chunk", "_carry", "_carry_open")
    )


def failure_streaks(
    attempts: DataFrame, cool_off: int = rules.COOL_OFF_SECONDS, state: DataFrame | None = None
) -> DataFrame:
    """Every outcome of a provider (see provider_outcomes) with

    streak           failures (failed or rejected) since the provider's last success, itself included
    open_until_s     end of the cool-off in force before the attempt; a success does not clear it
    made_while_open  whether the attempt was made before that end

    state, as written by breaker_state, continues an earlier log. One range shuffle, one pass. All
    columns of attempts are carried through, so select the needed ones first: provider, the
    ordering columns and status are required.
    """
    columns = attempts.columns
    rows = provider_outcomes(attempts).withColumns({"_state": F.lit(False), "_streak": F.lit(0).cast("long"), "_open": F.lit(_NONE).cast("long")})
    if state is not None:
        given = state.select(
            "provider",
            F.lit(True).alias("_state"),
            F.lit(None).cast(attempts.schema["ts_s"].dataType).alias("ts_s"),
            F.col("streak").cast("long").alias("_streak"),
            F.coalesce(F.col("open_until_s"), F.lit(_NONE)).cast("long").alias("_open"),
        )
        rows = rows.unionByName(given, allowMissingColumns=True)
    # NULL sorts first, so a provider's given state precedes its attempts.
    ordered = rows.repartitionByRange("provider", *ORDER).sortWithinPartitions("provider", *ORDER)
    ordered = ordered.withColumn("ts_s", F.coalesce("ts_s", F.lit(0).cast(attempts.schema["ts_s"].dataType)))
    schema = T.StructType(
        [T.StructField(f.name, f.dataType) for f in attempts.schema.fields]
        + [T.StructField("_state", T.BooleanType()), T.StructField("_head", T.BooleanType()), T.StructField("_run", T.LongType())]
        + [T.StructField("_closed", T.BooleanType())]
        + [T.StructField(name, T.LongType()) for name in _OPENS]
        + [T.StructField("_chunk", T.IntegerType()), T.StructField("_tail", T.BooleanType())]
        + [T.StructField("_first", T.StringType())]
    )
    # Range borders come from a sample and may differ between two runs of the same plan, so the
    # rows are written once and both readers below see the same ranges.
    ranges = stage(ordered.mapInArrow(_read_range(cool_off, [*columns, "_state"]), schema), "ranges")
    carries = _carries(ranges.filter("_tail").select("_chunk", "provider", "_first", "_head", "_run", "_closed", *_OPENS))
    level = F.when(F.col("_head"), F.least("_carry", F.lit(LIMIT))).otherwise(F.lit(0))
    own = F.element_at(F.array(*_OPENS), (level + 1).cast("int"))
    # Bounded broadcast: one row per range.
    return (
        ranges.filter(~F.col("_tail") & ~F.col("_state"))
        .join(F.broadcast(carries), "_chunk")
        .withColumns({
            "streak": F.col("_run") + F.when(F.col("_head") & ~F.col("_closed"), F.col("_carry")).otherwise(F.lit(0)),
            "open_until_s": F.coalesce(
                F.nullif(own, F.lit(_NONE)), F.when(F.col("_head"), F.col("_carry_open"))
            ),
        })
        .withColumn("made_while_open", F.coalesce(F.col("ts_s") < F.col("open_until_s"), F.lit(False)))
        .select(*columns, "streak", "open_until_s", "made_while_open")
    )


def open_intervals(streaks: DataFrame, cool_off: int = rules.COOL_OFF_SECONDS) -> DataFrame:
    """Every opening of a provider's cool-off."""
    return streaks.filter(
        (F.col("status") != "success") & (F.col("streak") >= LIMIT)
    ).select(
        "provider", F.col("ts_s").alias("opened_s"), (F.col("ts_s") + cool_off).alias("open_until_s"), "streak"
    )


def attempts_while_open(streaks: DataFrame) -> DataFrame:
    """W4 as a report: attempts made during a cool-off, and how they ended, per provider."""
    return streaks.groupBy("provider").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.count_if("made_while_open").alias("while_open"),
        F.count_if(F.col("made_while_open") & (F.col("status") == "success")).alias("while_open_ok"),
    )


def breaker_state(streaks: DataFrame, cool_off: int = rules.COOL_OFF_SECONDS) -> DataFrame:
    """State of each provider after its last attempt: streak and end of the cool-off."""
    opens = (F.col("status") != "success") & (F.col("streak") >= LIMIT)
    after = F.when(opens, F.col("ts_s") + cool_off).otherwise(F.col("open_until_s"))
    last = F.max_by(F.struct("streak", after.alias("open_until_s")), F.struct(*ORDER))
    return streaks.groupBy("provider").agg(last.alias("_last")).select("provider", "_last.*")


def provider_health(
    attempts: DataFrame, as_of_s: int | None = None, cool_off: int = rules.COOL_OFF_SECONDS,
    providers: DataFrame | None = None,
) -> DataFrame:
    """Counts, mean latency of successes, streak and availability at as_of_s.

    All of it is one aggregate over failure_streaks, combined map-side. providers (column
    provider) are the configured ones: each gets a row, with zeros if nothing was tried.
    """
    needed = attempts.select("provider", *ORDER, "status", "latency_ms")
    streaks = failure_streaks(needed, cool_off)
    ok = F.col("status") == "success"
    opens = ~ok & (F.col("streak") >= LIMIT)
    after = F.when(opens, F.col("ts_s") + cool_off).otherwise(F.col("open_until_s"))
    now = F.unix_seconds(F.current_timestamp()) if as_of_s is None else F.lit(as_of_s)
    health = (
        streaks.groupBy("provider")
        .agg(
            F.count(F.lit(1)).alias("total_requests"),
            F.count_if(ok).alias("total_successes"),
            F.count_if(~ok).alias("total_failures"),
            F.sum(F.when(ok, F.col("latency_ms"))).alias("_latency"),
            F.max_by(F.struct("streak", after.alias("open_until_s")), F.struct(*ORDER)).alias("_last"),
        )
        .select(
            "provider", "total_requests", "total_successes", "total_failures",
            F.coalesce(
                F.round(F.col("_latency").cast("double") / F.col("total_successes"), 1), F.lit(0.0)
            ).alias("avg_latency_ms"),
            F.col("_last.streak").alias("consecutive_failures"),
            F.coalesce(now >= F.col("_last.open_until_s"), F.lit(True)).alias("available"),
        )
    )
    if providers is not None:
        counts = ["total_requests", "total_successes", "total_failures", "consecutive_failures"]
        health = providers.select("provider").distinct().join(health, "provider", "full").fillna(0, [*counts, "avg_latency_ms"]).fillna(True, ["available"])
    return health.withColumn("circuit_open", ~F.col("available"))
