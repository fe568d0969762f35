from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.errors import ConfigError, StoreError
from tessera.operators import delta


def events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


def test_bootstrap_includes_null_cursors_delta_excludes(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 10)], "id long, c long")
    staged, adv = delta.stage_delta(df, "c", None)
    assert staged.rows == 3 and adv.new_max == 10 and adv.kind == "integer"
    staged, adv = delta.stage_delta(df, "c", 5)
    assert [r.id for r in staged.df.collect()] == [3]  # strictly greater, NULL excluded


def test_empty_delta_does_not_advance(spark):
    df = spark.createDataFrame([(1, 5)], "id long, c long")
    staged, adv = delta.stage_delta(df, "c", 9)
    assert staged.rows == 0 and adv.new_max is None


def test_typed_literal_is_pushed_to_the_scan(spark, sf):
    d = delta.delta_filter(events(spark, sf), "ts", datetime(2024, 1, 15, 12))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts,2024-01-15T12:00)]" in plan
    # the column itself is never cast
    assert "cast(ts" not in d._jdf.queryExecution().optimizedPlan().toString().lower()


def test_cursor_validation(spark, sf):
    ev = events(spark, sf)
    with pytest.raises(ConfigError, match="not found; columns are event_id"):
        delta.validate_cursor(ev, "nope")
    with pytest.raises(ConfigError, match="must be a timestamp"):
        delta.validate_cursor(ev, "event_type")
    kind, warns = delta.validate_cursor(ev, "ts")
    assert kind == "timestamp" and warns  # nullable -> warning only


def test_lookback_rules():
    with pytest.raises(ConfigError, match="integer cursor"):
        delta.validate_lookback("integer", "2h")
    with pytest.raises(ConfigError, match="whole days"):
        delta.validate_lookback("date", "36h")
    assert delta.apply_lookback(date(2024, 1, 10), "date", delta.validate_lookback("date", "2d")) == date(2024, 1, 8)
    assert delta.apply_lookback(datetime(2024, 1, 1, 6), "timestamp", delta.validate_lookback("timestamp", "30m")) == \
        datetime(2024, 1, 1, 5, 30)


def test_lookback_redelivers_late_rows(spark, sf):
    ev = events(spark, sf)
    mark = datetime(2024, 1, 15, 12)
    plain, _ = delta.stage_delta(ev, "ts", mark)
    late, _ = delta.stage_delta(ev, "ts", mark, lookback="6h")
    assert late.rows > plain.rows
    assert late.df.where(F.col("ts") <= F.lit(mark)).count() == late.rows - plain.rows


def _wm(spark, rows):
    return delta.watermarks_df(spark, rows)


def test_watermark_upsert_greatest_refresh_and_empty(spark):
    old = _wm(spark, [
        {"source": "a", "cursor_column": "ts", "mark_ts": "2024-01-10 00:00:00", "last_delta_rows": 5},
        {"source": "b", "cursor_column": "id", "mark_int": 50, "last_delta_rows": 2},
        {"source": "c", "cursor_column": "id", "mark_int": 7, "last_delta_rows": 1},
    ])
    adv = _wm(spark, [
        {"source": "a", "cursor_column": "ts", "mark_ts": "2024-01-05 00:00:00", "last_delta_rows": 9},  # older
        {"source": "b", "cursor_column": "id", "mark_int": 60, "last_delta_rows": 3},
        {"source": "c", "cursor_column": "id", "last_delta_rows": 0},  # empty delta
        {"source": "d", "cursor_column": "day", "mark_date": "2024-02-01", "last_delta_rows": 4},  # new
    ])
    got = {r.source: r for r in delta.upsert_watermarks(old, adv).collect()}
    assert got["a"].mark_ts == datetime(2024, 1, 10) and got["a"].last_delta_rows == 9
    assert got["b"].mark_int == 60 and got["c"].mark_int == 7 and got["c"].last_delta_rows == 1
    assert got["d"].mark_date == date(2024, 2, 1)
    refreshed = {r.source: r for r in delta.upsert_watermarks(old, adv, full_refresh=True).collect()}
    assert refreshed["a"].mark_ts == datetime(2024, 1, 5)


def test_duplicate_watermarks(spark):
    rows = [{"source": "a", "cursor_column": "x", "mark_int": 1}, {"source": "a", "cursor_column": "x", "mark_int": 2}]
    with pytest.raises(StoreError, match="'a'"):
        delta.assert_unique_watermarks(rows)
    assert delta.check_watermarks(_wm(spark, rows)).collect()[0].n == 2


def test_status_and_diff(spark):
    declared = spark.createDataFrame([("a", "ts"), ("z", "id")], "source string, cursor string")
    wm = _wm(spark, [{"source": "a", "cursor_column": "ts", "mark_ts": "2024-01-10 00:00:00", "last_delta_rows": 5}])
    st = {r.source: r for r in delta.watermark_status(declared, wm).collect()}
    assert st["z"].status == "next run bootstraps" and st["a"].mark == "2024-01-10 00:00:00.000000"
    cur = _wm(spark, [{"source": "a", "cursor_column": "ts", "mark_ts": "2024-01-12 00:00:00"},
                      {"source": "b", "cursor_column": "id", "mark_int": 3},
                      {"source": "c", "cursor_column": "id", "mark_int": 4}])
    tgt = _wm(spark, [{"source": "a", "cursor_column": "ts", "mark_ts": "2024-01-10 00:00:00"},
                      {"source": "c", "cursor_column": "id", "mark_int": 4},
                      {"source": "only_target", "cursor_column": "id", "mark_int": 1}])
    d = {r.source: r.change for r in delta.watermark_diff(cur, tgt).collect()}
    assert d == {"a": "rewind", "b": "absent_in_target"}


def test_file_source_delta_is_pinned_at_read(spark, tmp_path):
    """A file source's delta keeps its file list: files landing mid-run are not half-seen."""
    path = str(tmp_path / "src")
    spark.createDataFrame([(1, 10), (2, 20)], "id long, c long").write.parquet(path)
    src = spark.read.parquet(path)
    d, adv = delta.pinned_delta(src, "c", 5, source="s")
    assert adv.rows == 2 and adv.new_max == 20
    spark.createDataFrame([(3, 30)], "id long, c long").write.mode("append").parquet(path)
    d.createOrReplaceTempView("pinned_src")
    assert sorted(r.id for r in spark.sql("SELECT id FROM pinned_src").collect()) == [1, 2]
    assert d.count() == adv.rows


def test_zone_aware_cursor_marks_survive_time_zone_changes(spark):
    """A mark taken under one driver/session zone filters identically under another."""
    import os
    import time
    saved_tz, saved_session = os.environ.get("TZ"), spark.conf.get("spark.sql.session.timeZone")
    try:
        os.environ["TZ"] = "Asia/Tokyo"
        time.tzset()
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.sql("SELECT id, TIMESTAMP '2024-03-10 12:00:00' + make_interval(0, 0, 0, 0, CAST(id AS INT), 0, 0) AS ts "
                       "FROM range(10)")
        _, adv = delta.pinned_delta(df, "ts", None)
        # 12:00 in New York on 2024-03-10 (EDT) is 16:00 UTC; the latest row is nine hours later.
        assert adv.new_max == datetime(2024, 3, 11, 1, 0)
        first_max = adv.new_max
        os.environ["TZ"] = "Europe/Berlin"
        time.tzset()
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        d, adv2 = delta.pinned_delta(df, "ts", first_max)
        assert adv2.rows == 0  # nothing is past the stored mark, whatever the zones
        d, adv3 = delta.pinned_delta(df, "ts", first_max - timedelta(hours=2))
        assert adv3.rows == 2
    finally:
        if saved_tz is None:
            os.environ.pop("TZ", None)
        else:
            os.environ["TZ"] = saved_tz
        time.tzset()
        spark.conf.set("spark.sql.session.timeZone", saved_session)
