"""The hourly jobs as streams: ingest, dedupe, feature refresh, lags, errors, alerts.

Every stream takes a checkpoint folder shared by the cluster, and each sink can
be replayed: file sinks commit per batch, upserts replace by key.
"""

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from aerolith.functions.bands import affected_groups, alert_level, aqi_category
from aerolith.operators import match
from aerolith.operators.buckets import SURE_ROWS, ranges
from aerolith.operators.features import CHANGE_ROWS
from aerolith.operators.quality import flag_steps, plausible, validate_ranges
from aerolith.operators.series import Layout, choose_layout
from aerolith.plans import chains
from aerolith.schema import (
    CHANGE_HOURS,
    INTERPOLATED,
    KEYS,
    LAGS,
    RAW,
    RAW_OBS,
    TIME,
)
from aerolith.session import drop_dir, shared_dir, written
from aerolith.sources import store
from aerolith.sources.event_feed import USERS_PER_STATION, hourly_values

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
HOURLY = T.StructType(RAW_OBS.fields + [T.StructField("ingest_seq", T.IntegerType())])
WATERMARK = "2 hours"


def event_stream(spark: SparkSession, folder: str, files: str = "events.parquet") -> DataFrame:
    """Events as they arrive in a folder; watermarks need a zoned time."""
    return (
        spark.readStream.schema(EVENTS)
        .option("pathGlobFilter", files)
        .parquet(folder)
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )


def hourly_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Hourly rows as they arrive in a folder, corrections with a higher ``ingest_seq``."""
    return spark.readStream.schema(HOURLY).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def to_files(stream: DataFrame, path: str, checkpoint: str):
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def for_each(stream: DataFrame, handle, checkpoint: str, mode: str = "append"):
    return (
        stream.writeStream.foreachBatch(handle)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _readings(events: DataFrame) -> DataFrame:
    return events.withColumns(
        {
            "station_id": F.expr(f"cast(user_id div {USERS_PER_STATION} as int)"),
            "c": F.round(F.col("value") * 100).cast("long"),
        }
    ).withWatermark("ts", WATERMARK)


def hourly(events: DataFrame) -> DataFrame:
    """Observations per station and hour; rows later than the watermark are dropped.

    In append mode a row comes once its hour is closed; in update mode with every change, for ``upsert_hours``.
    """
    values = [v.alias(n) for n, v in hourly_values().items()]
    closed = _readings(events).groupBy(F.window("ts", "1 hour").alias("w"), *KEYS).agg(*values)
    return closed.select(*KEYS, F.col("w.start").cast("timestamp_ntz").alias(TIME), *RAW)


def latest_reading(events: DataFrame) -> DataFrame:
    """The last reading of each station and hour so far, in update mode."""
    last = _readings(events).groupBy(F.window("ts", "1 hour").alias("w"), *KEYS).agg(
        F.max("event_id").alias("ingest_seq"),
        F.max_by(F.struct("c", "event_type"), "event_id").alias("r"),
    )
    return last.select(*KEYS, F.col("w.start").cast("timestamp_ntz").alias(TIME), "ingest_seq", "r.*")


def upsert_batches(path: str, shards: int = store.SHARDS):
    """A batch handler that upserts into a feature table."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        store.upsert(batch, path, shards)

    return handle




def upsert_hours(path: str, shards: int = store.SHARDS):
    """A batch handler for changed hours: the table has every hour that has events, open ones as known so far.

    A provisional row is replaced when more of its events arrive, so the last hours of a stream, and those of a
    station that falls silent, are there without waiting for the watermark.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        store.upsert(batch.withColumn(store.ORDER, F.lit(batch_id)), path, shards)

    return handle


def month_summary(raw: DataFrame) -> DataFrame:
    """A row per station and month of a raw table: its sure rows, which nothing that comes later changes, and the extremes
    of the columns whose range the near-duplicate flag needs."""
    whole = [F.col(c).isNotNull() for c in RAW]
    sure = F.coalesce(reduce(lambda a, b: a & b, [*whole, plausible(RAW)]), F.lit(False))
    return raw.groupBy(*KEYS, store.MONTH).agg(
        F.date_trunc("month", F.min(TIME)).cast("timestamp_ntz").alias(TIME),
        F.count_if(sure).alias("sure"),
        *[f(c).alias(f"_{n}_{c}") for c in INTERPOLATED for n, f in (("min", F.min), ("max", F.max))],
    )


def refresh_plan(months: DataFrame, touched: DataFrame) -> DataFrame:
    """Per touched station ``first``, ``last`` and the months to read: ``from_month`` and ``to_month``, NULL for no bound.

    The months before the first touched one, back to where they hold more than SURE_ROWS sure rows, settle what comes
    after; the months after the last touched one do the same for what follows.
    """
    known = months.select(*KEYS, F.col(store.MONTH).alias("m"), "sure").join(touched, list(KEYS))
    line = Window.partitionBy(*KEYS).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    month = lambda c: F.date_format(c, "yyyy-MM")
    earlier, later = F.col("m") < month("first"), F.col("m") > month("last")
    counted = known.select(
        *KEYS,
        "m",
        F.sum(F.when(earlier, F.col("sure"))).over(line.orderBy(F.col("m").desc())).alias("back"),
        F.sum(F.when(later, F.col("sure"))).over(line.orderBy("m")).alias("on"),
        earlier.alias("earlier"),
        later.alias("later"),
    )
    bounds = counted.groupBy(*KEYS).agg(
        F.max(F.when(F.col("earlier") & (F.col("back") > SURE_ROWS), F.col("m"))).alias("from_month"),
        F.min(F.when(F.col("later") & (F.col("on") > SURE_ROWS), F.col("m"))).alias("to_month"),
    )
    return touched.join(bounds, list(KEYS), "left")


def _months_of(table: DataFrame, plan: DataFrame, shards: int) -> DataFrame:
    """Rows of the months and stations of a plan; other months and shards are not read."""
    bounds = (
        plan.groupBy(F.pmod(F.xxhash64(*KEYS), F.lit(shards)).cast("int").alias("shard"))
        .agg(F.min(F.coalesce("from_month", F.lit(""))).alias("lo"), F.max(F.coalesce("to_month", F.lit("9999-12"))).alias("hi"))
        .collect()  # one row per shard
    )
    month, shard = F.col(store.MONTH).cast("string"), F.col(store.SHARD)
    read = reduce(lambda a, b: a | b, [(shard == r["shard"]) & month.between(r["lo"], r["hi"]) for r in bounds], F.lit(False))
    rows = table.filter(read).join(plan, list(KEYS))
    near = (F.col("from_month").isNull() | (month >= F.col("from_month"))) & (
        F.col("to_month").isNull() | (month <= F.col("to_month"))
    )
    return rows.filter(near)


def _edges(needed: DataFrame) -> DataFrame:
    """Per station the last sure row before what is touched, and the first that has SURE_ROWS sure rows between."""
    sure = validate_ranges(needed.dropna("any", subset=RAW))
    settled = sure.filter(F.col(TIME) < F.col("first")).groupBy(*KEYS).agg(F.max(TIME).alias("settled"))
    order = Window.partitionBy(*KEYS).orderBy(TIME)
    after = sure.filter(F.col(TIME) > F.col("last")).withColumn("_n", F.row_number().over(order))
    until = after.filter(F.col("_n") == SURE_ROWS + 1).select(*KEYS, F.col(TIME).alias("until"))
    return settled.join(until, list(KEYS), "full")


def refresh_features(raw_path: str, features_path: str, months_path: str, shards: int = store.SHARDS, layout: Layout = None):
    """A batch handler: store the hours, recompute the features they change, upsert them.

    The table at ``months_path`` has a row per station and month. Each batch renews the rows of the months it touches;
    they tell from and to which month hours must be read, so that no other partition of the raw and feature tables is.
    Features keep the steps that the near-duplicate flag is made of, since its range may grow with any batch:
    ``refreshed`` shows the table with the flag of now.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stages = [shared_dir(spark, f"refresh-{n}") for n in ("touched", "plan", "edges", "features")]
        store.upsert(batch, raw_path, shards)
        place = [store.MONTH, store.SHARD]
        touched = written(
            store.placed(batch.select(*KEYS, TIME), shards).groupBy(*KEYS, *place).agg(F.min(TIME).alias("first"), F.max(TIME).alias("last")),
            stages[0],
        )
        raw = store.read_table(spark, raw_path)
        renewed = month_summary(store.partitions_of(raw, touched))
        store.upsert(renewed.withColumn(store.ORDER, F.lit(batch_id)).drop(store.MONTH), months_path, shards)
        stations = touched.groupBy(*KEYS).agg(F.min("first").alias("first"), F.max("last").alias("last"))
        plan = written(refresh_plan(store.read_table(spark, months_path), stations), stages[1])
        needed = _months_of(raw, plan, shards)
        edges = written(_edges(needed), stages[2])
        rows = needed.select(*KEYS, TIME, *RAW)
        table = chains.features_full(rows, layout=layout or choose_layout(rows), keep_steps=True)
        changed = (F.col("settled").isNull() | (F.col(TIME) > F.col("settled"))) & (
            F.col("until").isNull() | (F.col(TIME) <= F.col("until"))
        )
        within = lambda df: df.join(edges, list(KEYS), "left").filter(changed).drop("settled", "until")
        fresh = within(written(table, stages[3])).withColumns({store.ORDER: F.lit(batch_id), store.DELETED: F.lit(False)})
        if store.exists(spark, features_path):
            # Rows that are no longer valid stay as deleted, so that replays agree.
            old = within(_months_of(store.read_table(spark, features_path), plan, shards))
            gone = (
                old.select(*KEYS, TIME)
                .join(fresh.select(*KEYS, TIME), [*KEYS, TIME], "left_anti")
                .withColumns({store.ORDER: F.lit(batch_id), store.DELETED: F.lit(True)})
            )
            fresh = fresh.unionByName(gone, allowMissingColumns=True)
        store.upsert(fresh, features_path, shards)
        for path in stages:  # the rows are committed, nothing reads these tables again
            drop_dir(spark, path)

    return handle


def refreshed(spark: SparkSession, features_path: str, months_path: str) -> DataFrame:
    """The refreshed feature table, with near-duplicates flagged by the ranges known now."""
    months = store.read_table(spark, months_path)
    return flag_steps(store.plain(store.read_table(spark, features_path)), ranges(months, INTERPOLATED), INTERPOLATED)


_BUFFERED = ("aqi", *LAGS)
LAG_OUTPUT = "station_id int, time timestamp_ntz, " + ", ".join(
    [f"{c}_lag_{n}h double" for c, ns in LAGS.items() for n in ns]
    + [f"aqi_change_{n}h double" for n in CHANGE_HOURS]
)
# Rows kept beyond those that lags reach: an hour that many rows back can still be corrected.
LATE_ROWS = 48
KEPT_ROWS = CHANGE_ROWS + LATE_ROWS
# Rows sent on at once.
SENT_ROWS = 2000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LagProcessor(StatefulProcessor):
    """Lags of one station's hours, from a map of its hours that the state store keeps.

    A trigger's rows come and go in pieces, and so do the rows sent on: of a station's trigger only the numbers of its
    hours are held, never its rows.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        values = ", ".join(f"{c} double" for c in _BUFFERED)
        self.hours = handle.getMapState("hours", "hour long", f"seq long, {values}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = sorted(k[0] for k in self.hours.keys())
        full = len(known) == KEPT_ROWS
        held, first = set(known), None
        for piece in rows:
            hours = piece[TIME].astype("datetime64[us]").astype("int64").tolist()
            for hour, seq, *values in zip(hours, piece["ingest_seq"].tolist(), *(piece[c].tolist() for c in _BUFFERED)):
                if full and hour < known[0]:
                    continue  # what came before the first kept row is no longer known
                if hour in held and self.hours.getValue((hour,))[0] > seq:
                    continue
                self.hours.updateValue((hour,), (int(seq), *(None if pd.isna(v) else float(v) for v in values)))
                held.add(hour)
                first = hour if first is None else min(first, hour)
        if first is None:
            return
        hours = sorted(held)
        begin = max(bisect_left(hours, first), CHANGE_ROWS if full else 0)
        yield from self._sent(key[0], hours, begin)
        for hour in hours[:-KEPT_ROWS]:
            self.hours.removeKey((hour,))

    def _sent(self, station: int, hours: list[int], begin: int) -> Iterator[pd.DataFrame]:
        """Lags of ``hours`` from number ``begin`` on, from a window of the values before each."""
        window = deque((self.hours.getValue((h,))[1:] for h in hours[max(0, begin - CHANGE_ROWS) : begin]), CHANGE_ROWS)
        column = {c: i for i, c in enumerate(_BUFFERED)}
        back = lambda c, n: window[-n][column[c]] if n <= len(window) else None
        out = []
        for hour in hours[begin:]:
            lags = [back(c, n) for c, ns in LAGS.items() for n in ns]
            last = back("aqi", 1)
            then = [back("aqi", 1 + n) for n in CHANGE_HOURS]
            changes = [None if last is None or v is None else last - v for v in then]
            out.append((station, hour, *lags, *changes))
            window.append(self.hours.getValue((hour,))[1:])
            if len(out) == SENT_ROWS:
                yield self._frame(out)
                out = []
        if out:
            yield self._frame(out)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=[f.split()[0] for f in LAG_OUTPUT.split(", ")])
        numbers = [c for c in frame.columns if c not in ("station_id", TIME)]
        return frame.astype(dict.fromkeys(numbers, "float64") | {TIME: "datetime64[us]"})


def lag_state(hours: DataFrame) -> DataFrame:
    """Lags over a stream of hours, in any order; a corrected hour replaces the known one.

    State per station is a map by hour of the rows that lags reach and LATE_ROWS more, kept by RocksDB, which this sets
    for the session's streams.  Of several rows for an hour the one of highest ``ingest_seq`` counts, of equal ones the
    last.  A new or corrected hour also sends the known hours after it again: put the output into a table by station and
    hour.  Hours before the rows of a full state are left out.
    """
    hours.sparkSession.conf.set(PROVIDER, ROCKSDB)
    seq = F.col("ingest_seq") if "ingest_seq" in hours.columns else F.lit(0)
    return (
        hours.select(*KEYS, TIME, seq.cast("long").alias("ingest_seq"), *_BUFFERED)
        .groupBy(*KEYS)
        .transformWithStateInPandas(LagProcessor(), LAG_OUTPUT, "append", "None")
    )


def error_monitor(hours: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each observed hour against the closest prediction within an hour, as batch evaluation matches them."""
    joined = hours.select(*KEYS, TIME, "aqi").join(match.nearest_by_hour(predictions), [*KEYS, TIME])
    return match.forecast_error(joined)


def alert_stream(hours: DataFrame) -> DataFrame:
    """Alert level and affected groups of each observed hour."""
    v = F.col("aqi")
    return hours.filter(v.isNotNull()).select(
        *KEYS,
        TIME,
        "aqi",
        aqi_category(v).alias("aqi_category"),
        alert_level(v).alias("alert_level"),
        affected_groups(v).alias("affected_groups"),
    )
