"""Streams end with what a batch job over the same rows gives."""

from pathlib import Path

from pyspark.sql import functions as F

from aerolith.catalog.base import observations
from aerolith.operators import series as S
from aerolith.plans import chains
from aerolith.schema import RAW, RAW_OBS
from aerolith.sources import store
from aerolith.streaming import jobs as J
from tests.conftest import SMALL
from tests.test_buckets import hours
from tests.test_layout import rows

COLS = [f.name for f in J.HOURLY]


def _dense(spark):
    """One station without gaps but for a few, so that most rows are valid."""
    obs = observations(spark, SMALL)
    fill = {c: F.coalesce(c, (F.hour("time") + F.dayofmonth("time")).cast("double")) for c in RAW if c != "pm10"}
    full = obs.withColumns(fill).withColumn("pm10", F.col("pm2_5") + 5)
    gap = F.dayofmonth("time") == 9
    hole = full.withColumns({c: F.when(~(gap & (F.hour("time") < 8)), F.col(c)) for c in ("temperature_2m", "aqi")})
    return hole.withColumn("temperature_2m", F.least("temperature_2m", F.lit(50.0))).withColumn("ingest_seq", F.lit(0))


def test_refresh_equals_batch_after_corrections(spark, tmp_path):
    """Corrections make rows invalid, fill a gap and move an interpolation."""
    base = _dense(spark).select(*COLS).cache()
    seq = lambda df, n: df.withColumn("ingest_seq", F.lit(n).cast("int")).select(*COLS)
    day = F.dayofmonth("time")
    arrivals = [
        base.filter(day <= 24),
        base.filter(day > 24),
        seq(base.filter((day == 20) & (F.hour("time") < 3)).withColumn("pm2_5", F.lit(900.0)), 2),
        seq(base.filter((day == 9) & (F.hour("time") == 5)).withColumns({"temperature_2m": F.lit(33.0), "aqi": F.lit(99.0)}), 3),
    ]
    folder, raw, feats, months = (str(tmp_path / n) for n in ("in", "raw", "features", "months"))
    for part in arrivals:
        part.write.mode("append").parquet(folder)
        q = J.for_each(J.hourly_stream(spark, folder), J.refresh_features(raw, feats, months, 2), str(tmp_path / "cp"))
        q.awaitTermination()
    last = S.dedupe_last(arrivals[0].unionByName(arrivals[1]).unionByName(arrivals[2]).unionByName(arrivals[3]))
    want = chains.features_full(last.drop("ingest_seq"), layout=S.Layout())
    assert want.count() > 300
    assert rows(J.refreshed(spark, feats, months)) == rows(want)


def test_refresh_reads_no_other_months(spark, tmp_path):
    """A year of hours; then one new hour, and a correction of an old one, while all months that need not be read are broken."""
    whole = hours(1, 1, 24 * 300, holes=0.02, gaps=[(24 * 40, 24 * 45)]) + hours(2, 2, 24 * 300, holes=0.02)
    slow = {c: F.when(F.col(c).isNotNull(), F.dayofyear("time") / 20.0) for c in ("temperature_2m", "pressure_msl")}
    base = spark.createDataFrame(whole, RAW_OBS).withColumns(slow).withColumn("ingest_seq", F.lit(0)).select(*COLS).cache()
    newest = base.agg(F.max("time")).first()[0]
    is_new = F.col("time") == F.lit(str(newest)).cast("timestamp_ntz")
    fixed = base.filter((F.col("station_id") == 1) & (F.date_format("time", "yyyy-MM-dd HH") == "2024-05-10 07"))
    # The correction widens the range of its column, which changes flags of all months.
    fixed = fixed.withColumns({"wind_speed_10m": F.lit(900.0), "aqi": F.lit(5.0), "ingest_seq": F.lit(2)}).select(*COLS)
    raw, feats, months = (str(tmp_path / n) for n in ("raw", "features", "months"))
    handle = J.refresh_features(raw, feats, months, 2, S.Layout())
    handle(base.filter(~is_new), 0)
    far = [*Path(raw).glob("part_month=2024-0[17]/*/*.parquet"), *Path(feats).glob("part_month=2024-0[17]/*/*.parquet")]
    kept = {f: f.read_bytes() for f in far}
    assert len(far) >= 8
    for f in far:
        f.write_bytes(b"not a table")
        f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
    handle(base.filter(is_new), 1)
    handle(fixed, 2)
    for f, content in kept.items():
        f.write_bytes(content)
    last = S.dedupe_last(base.unionByName(fixed)).drop("ingest_seq")
    want = chains.features_full(last, layout=S.Layout())
    assert want.filter("is_duplicate").count() > 10
    assert rows(J.refreshed(spark, feats, months)) == rows(want)


def test_lag_state_over_several_batches(spark, tmp_path):
    base = _dense(spark).select(*COLS).cache()
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for day in (10, 20, 40):
        before = {10: 0, 20: 10, 40: 20}[day]
        part = base.filter((F.dayofmonth("time") <= day) & (F.dayofmonth("time") > before))
        part.write.mode("append").parquet(folder)
        J.to_files(J.lag_state(J.hourly_stream(spark, folder)), out, str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(out)
    from aerolith.operators import features as X

    w = S.Layout().window()
    want = base.withColumns({**X.lag_columns(base, w), **X.change_columns(w)}).select(*got.columns)
    assert rows(got) == rows(want)


def test_late_events_are_dropped(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    event = lambda i, ts: (i, ts, 1, "click", 10.0, "")
    schema = "event_id long, ts string, user_id long, event_type string, value double, props string"
    for batch in (["2024-01-01 00:10:00", "2024-01-01 05:00:00"], ["2024-01-01 00:20:00", "2024-01-01 09:00:00"]):
        df = spark.createDataFrame([event(i, t) for i, t in enumerate(batch)], schema)
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.mode("append").parquet(folder)
        J.to_files(J.hourly(J.event_stream(spark, folder, "*.parquet")), out, str(tmp_path / "cp")).awaitTermination()
    got = {(r.time.hour, r.relative_humidity_2m) for r in spark.read.parquet(out).collect()}
    assert got == {(0, 1.0), (5, 1.0)}  # one event each: the late one at 00:20 is not counted


def test_open_hours_are_there_and_become_final(spark, tmp_path):
    """Provisional rows grow with their events; a station that falls silent keeps its last hour."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "event_id long, ts string, user_id long, event_type string, value double, props string"
    batches = [
        [(1, "2024-01-01 05:10:00", 1), (2, "2024-01-01 05:20:00", 60)],
        [(3, "2024-01-01 05:50:00", 2), (4, "2024-01-01 06:05:00", 3)],
        [(5, "2024-01-01 12:00:00", 4), (6, "2024-01-01 05:55:00", 9)],
        [(7, "2024-01-01 05:58:00", 90)],  # later than the watermark
    ]
    seen = []
    for batch in batches:
        df = spark.createDataFrame([(i, t, u, "click", 10.0, "") for i, t, u in batch], schema)
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.mode("append").parquet(folder)
        stream = J.hourly(J.event_stream(spark, folder, "*.parquet"))
        J.for_each(stream, J.upsert_hours(out, 2), str(tmp_path / "cp"), "update").awaitTermination()
        # The humidity of these observations is the sum of user ids.
        rows = store.plain(store.read_table(spark, out)).collect()
        seen.append({(r["station_id"], r["time"].hour): int(r["relative_humidity_2m"]) for r in rows})
    assert seen[0] == {(0, 5): 1, (1, 5): 60}
    assert seen[1] == {(0, 5): 3, (1, 5): 60, (0, 6): 3}
    assert seen[2] == {(0, 5): 12, (1, 5): 60, (0, 6): 3, (0, 12): 4} and seen[3] == seen[2]
