import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from signalmill.constants import RETENTION_RULES
from signalmill.operators import tables as T
from signalmill.sources import landed as L
from signalmill.sources import payloads as P
from signalmill.sources import series as S

AS_OF = dt.date(2026, 3, 30)


def payload(spark, key, rows, name="commodity"):
    body = json.dumps({"response": {"data": rows}})
    return spark.createDataFrame([(key, body)], f"{name} string, body string")


def test_spot_prices(spark):
    rows = [{"period": "2026-03-28", "value": "69.50"}, {"period": "2026-03-27", "value": "68.80"}]
    got = P.spot_prices(payload(spark, "WTI", rows), AS_OF, 5).orderBy(F.desc("timestamp")).collect()
    assert [(r.commodity, r.price, r.unit, r.source) for r in got] == [("WTI", 69.5, "USD/bbl", "eia"), ("WTI", 68.8, "USD/bbl", "eia")]


def test_bad_rows_are_skipped_after_the_limit(spark):
    rows = [{"period": "2026-03-29", "value": "n/a"}, {"period": "2026-03-28", "value": None}, {"period": "soon", "value": "1"},
            {"value": "2"}, {"period": "2026-03-27", "value": 3}, {"period": "2025-01-01", "value": "4"}]
    got = P.spot_prices(payload(spark, "WTI", rows), AS_OF, 5).collect()
    assert [r.price for r in got] == [3.0]
    got = P.spot_prices(payload(spark, "WTI", rows[:2] + rows[4:5]), AS_OF, 3).collect()
    assert [r.price for r in got] == [3.0]


def test_broken_document_gives_no_rows(spark):
    docs = spark.createDataFrame([("WTI", "not json"), ("WTI", "{}"), ("WTI", None)], "commodity string, body string")
    assert P.spot_prices(docs, AS_OF).count() == 0


def test_monthly_prices(spark):
    rows = [{"period": f"2025-{m:02d}", "value": str(m)} for m in range(1, 13)] + [{"period": "2026-01", "value": "13"}, {"period": "2026-02-01", "value": "9"}]
    got = P.monthly_prices(payload(spark, "NATGAS", rows), AS_OF, 800).orderBy("timestamp").collect()
    assert len(got) == 11 and got[-1].timestamp == dt.datetime(2026, 1, 1) and got[-1].unit == "USD/MMBtu"


@pytest.mark.parametrize("rows,expected", [
    ([{"period": "2026-03-28", "value": "440.5"}, {"period": "2026-03-21", "value": "438.2"}], (440.5, 2.3)),
    ([{"period": "2026-03-28", "value": "440.5"}], (440.5, None)),
    ([{"period": "2026-03-28"}, {"period": "2026-03-21", "value": "1.5"}], (0.0, -1.5)),
    ([{"period": "2026-03-28", "value": "x"}], None),
    ([], None),
])
def test_inventory(spark, rows, expected):
    got = P.inventory_delta(payload(spark, "s", rows, "series_id")).collect()
    assert [(r.inventory_mmbbl, r.change_mmbbl) for r in got] == ([expected] if expected else [])


def test_news_rows(spark):
    def art(title="t", url="u", at="2026-03-29T10:00:00Z", source={"name": "s"}, **more):
        return {"title": title, "url": url, "publishedAt": at, "source": source, **more}

    docs = [art(None), art(url=None), art(at="bad"), art(source=None), art("old", at="2026-01-01T00:00:00Z"), art(description="d", url="v")]
    frame = spark.createDataFrame([("q", json.dumps({"articles": docs}))], "query string, body string")
    got = P.news_rows(frame, AS_OF, 3, 20).orderBy("url").collect()
    assert [(r.title, r.url, r.description) for r in got] == [("", "u", None), ("t", "v", "d")]


def test_social_posts_limit_before_keywords(spark):
    rows = [("oil", 9, 1, "Cats", "x", "/a", 0), ("oil", 8, 2, "Big OIL spill", "", "/b", 86400), ("oil", 7, 3, "oil", "y" * 300, "/c", 0)]
    posts = spark.createDataFrame(rows, "group string, score int, post_id int, title string, body string, permalink string, created_utc bigint")
    got = P.social_posts(posts, ["oil"], limit=2).collect()
    assert [(r.title, r.description, r.url, r.source) for r in got] == [("Big OIL spill", None, "https://reddit.com/b", "reddit/r/oil")]
    assert got[0].published_at == dt.datetime(1970, 1, 2)
    assert len(P.social_posts(posts, ["oil"], limit=3).orderBy(F.desc("url")).first().description) == 200


def test_series_window_drops_missing(spark):
    rows = [("A", dt.date(2026, 3, 29), 1.0), ("A", dt.date(2026, 3, 28), float("nan")), ("A", dt.date(2026, 3, 27), None), ("A", dt.date(2025, 1, 1), 2.0)]
    obs = spark.createDataFrame(rows, "series_id string, d date, value double")
    assert [r.value for r in S.series_window(obs, AS_OF, 30).collect()] == [1.0]
    assert S.zone_prices(obs, AS_OF, 30).first().commodity == "POWER_A"


def test_bar_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "bars")
    spark.createDataFrame([("A", dt.datetime(2026, 3, 1), 1.0)], "symbol string, ts timestamp_ntz, close double").write.parquet(path)
    plan = S.scan_bars(spark.read.parquet(path), AS_OF, ["A"], 60)._jdf.queryExecution().executedPlan().toString()
    assert "In(symbol" in plan or "EqualTo(symbol,A)" in plan
    assert "GreaterThanOrEqual(ts" in plan


ROW = "date string, agent string, seq int, v string"


def test_keyed_table(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("2026-01-01", "A", 1, "old"), ("2026-01-01", "A", 2, "x"), ("2026-01-02", "B", 1, "keep")], ROW)
    later = spark.createDataFrame([("2026-01-01", "A", 1, None)], ROW)
    L.write_batch(first, path, 0)
    L.write_batch(later, path, 1)
    L.write_batch(later, path, 1)  # a retried write
    got = {tuple(r) for r in L.read_keyed(spark, path, ROW, ["date", "agent"], ["seq"]).select("date", "agent", "seq", "v").collect()}
    assert got == {("2026-01-01", "A", 1, None), ("2026-01-02", "B", 1, "keep")}


def test_merged_table_folds_folders_and_reads_a_bounded_number_of_batches(spark, tmp_path):
    table = L.KeyedTable(spark, str(tmp_path / "t"), ROW, ["date", "agent"], ["seq"], most=3)
    assert table.read().collect() == [] and table.live() == []
    want, sizes = {}, []
    for batch in range(12):
        rows = [("2026-01-01", f"A{k % 5}", batch, f"v{batch}-{k}") for k in range(batch, batch + 2)] + ([("2026-01-02", "B", batch, None)] if batch == 1 else [])
        table.merge(spark.createDataFrame(rows, ROW), batch)
        want |= {(d, a): (d, a, s, v) for d, a, s, v in rows}
        assert {tuple(r) for r in table.read().select("date", "agent", "seq", "v").collect()} == set(want.values()), batch
        sizes.append(sum(f == "2026-01-01" for f, *_ in table.live()))
    assert max(sizes) <= 3 and sizes[-1] < 12
    assert [p for p in table.live() if p[0] == "2026-01-02"] == [("2026-01-02", 1, False)]  # an untouched folder is not rewritten
    files = table.read().inputFiles()
    assert len({f.split("/batch=")[1].split("/")[0] for f in files if "2026-01-01" in f}) <= 4
    assert all("2026-01-02" in f for f in table.read(["2026-01-02"]).inputFiles())
    # a retried merge replaces itself, also one that folded
    again = spark.createDataFrame([("2026-01-01", "A9", 1, "new")], ROW)
    table.merge(again, 11)
    got = {r.agent: r.v for r in table.read(["2026-01-01"]).collect()}
    assert got["A9"] == "new" and "v11-11" not in got.values()


def test_retention_moves_folders_by_prefix_and_can_be_repeated(spark, tmp_path):
    root = str(tmp_path)
    days = {age: (AS_OF - dt.timedelta(days=age)).isoformat() for age in (0, 30, 31, 90, 91, 365, 366)}
    for prefix in ("raw", "signals", "results", "other"):
        rows = [(age, d) for age, d in days.items()]
        L.write_dated(spark.createDataFrame(rows, "age int, date string"), f"{root}/{prefix}", ["date"], "parquet")
    (tmp_path / "raw" / "notes").mkdir()
    rules = [L.Retention(*r) for r in RETENTION_RULES]
    # a move that was cut short has left a part in the archive
    half = tmp_path / "archive" / "raw" / f"date={days[91]}"
    half.mkdir(parents=True)
    (half / "part").write_text("x")
    assert L.retain(spark, root, AS_OF, rules) == {"archive": 3, "expire": 6}
    assert L.retain(spark, root, AS_OF, rules) == {"archive": 0, "expire": 0}
    ages = lambda p: sorted(r.age for r in spark.read.schema("age int, date string").parquet(f"{root}/{p}").collect())
    assert ages("raw") == [0, 30, 31, 90] and ages("archive/raw") == [91, 365, 366] and ages("signals") == [0, 30, 31, 90, 91, 365]
    assert ages("results") == [0, 30] and ages("other") == sorted(days) and (tmp_path / "raw" / "notes").is_dir()
    assert not (half / "part").exists()
    with pytest.raises(ValueError, match="burn"):
        L.retain(spark, root, AS_OF, [L.Retention("raw", 1, "burn")])
    assert L.listed_folders(spark, f"{root}/nowhere") == []


def test_reports_are_saved_and_loaded(spark, tmp_path):
    path = str(tmp_path / "reports")
    calls = spark.createDataFrame([("p", "m", 1, 5.0, True, 9), ("p", "m", 2, 7.0, False, 9)], "provider string, model string, prompt_id int, total_ms double, ok boolean, extra int")
    summary = spark.createDataFrame([("p", "m", 1, 5.0)], "provider string, model string, calls bigint, avg_ms double")
    P.save_call_report(calls, summary, path, "2026-01-01T00:00:00+00:00", {"cpu": "c", "ram_gb": 8})
    P.save_call_report(calls.limit(1), summary, path, "2026-01-02T00:00:00+00:00")
    P.save_call_report(calls, summary, path, "2026-01-01T00:00:00+00:00", {"cpu": "d"})
    rows, totals, system = P.load_call_report(spark, path)
    assert rows.groupBy("reported_at").count().orderBy("reported_at").collect() == [("2026-01-01T00:00:00+00:00", 2), ("2026-01-02T00:00:00+00:00", 1)]
    assert {r.prompt_id for r in rows.collect()} == {"1", "2"} and "extra" not in rows.columns and rows.first().error is None
    assert [tuple(r) for r in totals.select("provider", "calls", "avg_ms").collect()] == [("p", 1, 5.0)] * 2
    assert [tuple(r) for r in system.collect()] == [("cpu", "d", "2026-01-01T00:00:00+00:00")]


def test_upsert_replaces_whole_rows(spark):
    old = spark.createDataFrame([("2026-01-01", "A", 9, "full")], ROW)
    new = spark.createDataFrame([("2026-01-01", "A", 1, None)], ROW)
    got = T.upserted(old, new, ["date", "agent"], ["seq"]).collect()
    assert [tuple(r) for r in got] == [("2026-01-01", "A", 1, None)]


def test_dated_folder_is_replaced_and_others_stay(spark, tmp_path):
    path = str(tmp_path / "raw")
    schema = "symbol string, close double, date string"
    L.write_dated(spark.createDataFrame([("A", 1.0, "2026-01-01"), ("A", None, "2026-01-02")], schema), path)
    L.write_dated(spark.createDataFrame([("B", 3.0, "2026-01-02")], schema), path)
    got = {tuple(r) for r in L.read_dated(spark, path, schema).collect()}
    assert got == {("A", 1.0, "2026-01-01"), ("B", 3.0, "2026-01-02")}


def test_lookups_and_limits(spark):
    rows = [("2026-01-01", "A", i, f"{i:03d}") for i in range(150)]
    df = spark.createDataFrame(rows, ROW)
    assert T.lookup(df, {"date": "2026-01-01", "agent": "A", "seq": 7}).count() == 1
    assert T.lookup(df, {"date": "2026-01-05"}).count() == 0
    newest = T.newest_of_key(df, {"agent": "A"}, "v")
    assert newest.count() == 100 and newest.agg(F.min("v")).first()[0] == "050"
    assert T.first_rows(df, 3, "v", ["agent"]).collect()[0].seq == 149
    assert T.existing_columns(df, ["v", "nope", "date"]).columns == ["v", "date"]


def test_retention(spark):
    rows = [(dt.date(2026, 3, 30) - dt.timedelta(days=n),) for n in (0, 90, 91, 365, 366)]
    got = T.retention(spark.createDataFrame(rows, "d date"), AS_OF, "d", 90, 365).collect()
    assert [r.tier for r in got] == ["keep", "keep", "archive", "archive", "expire"]


def test_price_trend_of_an_absent_key_is_null(spark):
    df = spark.createDataFrame([("2026-01-01", "combined", {"A": 1.0})], "date string, source string, prices map<string,double>")
    assert T.price_trend_sql(df, "WTI", "combined").first().price is None
    assert T.price_trend_sql(df, "A", "combined").first().price == 1.0


def test_a_key_filter_reaches_the_folders_of_a_keyed_table(spark):
    from signalmill.operators import tables as T
    from signalmill.sources import landed as L
    from signalmill.session import scratch_path

    path = scratch_path(spark, "keyed")
    rows = spark.createDataFrame([("2024-01-01", "a", 1), ("2024-01-02", "a", 2), ("2024-01-02", "b", 3)], "date string, agent string, n int")
    L.write_batch(rows, path, 0)
    L.write_batch(rows.filter("agent = 'a' AND n = 2").withColumn("n", rows.n + 10), path, 1)
    table = L.read_keyed(spark, path, "agent string, n int, date string", ["date", "agent"])
    found = T.lookup(table, {"date": "2024-01-02", "agent": "a"})
    assert [tuple(r) for r in found.select("agent", "n").collect()] == [("a", 12)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "2024-01-02" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "agent" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_a_price_that_reads_as_nan_stays(spark):
    from signalmill.sources import payloads as P

    body = '{"response": {"data": [{"period": "2024-01-05", "value": "NaN"}, {"period": "2024-01-04", "value": "1.5"}, {"period": "2024-01-03", "value": "x"}]}}'
    got = P.spot_prices(spark.createDataFrame([("WTI", body)], "commodity string, body string"), "2024-01-10").collect()
    assert sorted(str(r.price) for r in got) == ["1.5", "nan"]


def test_rows_of_a_keyed_table_are_dealt_before_they_are_sorted(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(f"2026-01-0{1 + k % 3}", f"A{k % 7}", k, f"v{k}") for k in range(60)] + [("2026-01-01", "hot", k, f"h{k}") for k in range(40)]
    for batch in range(2):
        L.write_batch(spark.createDataFrame(rows[batch::2], ROW), path, batch)
    table = L.read_keyed(spark, path, ROW, ["date", "agent"], ["seq"])
    want = {}
    for batch in range(2):
        for d, a, s, v in sorted(rows[batch::2], key=lambda r: r[2]):
            want[d, a] = (d, a, s, v)
    assert {tuple(r) for r in table.select("date", "agent", "seq", "v").collect()} == set(want.values())
    plan = table._jdf.queryExecution().executedPlan().toString()  # from the last step down to the scan
    assert plan.count("SortAggregate") == 2  # a partial one stays, so that a hot key sends one row per task
    partial = plan.rindex("SortAggregate")
    assert "Exchange" in plan[plan.index("SortAggregate"):partial] and "REBALANCE" in plan[partial:]
