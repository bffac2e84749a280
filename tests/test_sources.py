"""Sources, results, streams and the queries' contract."""

import json

import pytest

import tickloom.functions  # noqa: F401
from tickloom import queries
from tickloom.operators.run import run
from tickloom.sources import bars, results
from tickloom.streaming.incremental import stream


def test_mock(spark):
    b = bars.mock(spark, 25).orderBy("time").collect()
    assert (b[0]["time"], b[0]["close"], b[21]["close"], b[3]["volume"]) == (1672531200.0, 95.0, 95.5, 1300.0)
    assert b[7]["open"] == pytest.approx(b[7]["close"]) and b[7]["high"] == pytest.approx(b[7]["open"] + 0.05)


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "b.csv").write_text("time,open,high,low,close\n2023-01-02,1,2,0.5,1.5\n2023-01-01 10:00:00,3,,2,3.5\n")
    got = bars.csv(spark, str(tmp_path / "b.csv")).orderBy("time").collect()
    assert [(r["time"], r["date"], r["high"]) for r in got] == [(1672567200.0, 20230101.0, None), (1672617600.0, 20230102.0, 2.0)]
    assert bars.csv(spark, str(tmp_path / "b.csv"), null_as_zero=True).orderBy("time").first()["high"] == 0.0
    (tmp_path / "n.json").write_text(json.dumps({"time": {"$date": "2023-01-01T00:00:00Z"}, "7": 1, "8": 2, "9": 0.5, "11": 1.5, "13": 9, "19": 3}) + "\n")
    r = bars.json_nested(spark, str(tmp_path / "n.json")).first()
    assert (r["time"], r["open"], r["close"], r["amount"]) == (1672531200.0, 1.0, 1.5, 3.0)
    rows = [{"code": "x", "trade_date": 20230103, "7": 1, "8": 2, "9": 0.5, "11": 1.5, "13": 9}, {"trade_date": 20230101, "7": "bad", "11": 2}]
    (tmp_path / "d.json").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "a.json").write_text(json.dumps(rows))
    for df in (bars.json_dated(spark, str(tmp_path / "d.json")), bars.json_dated(spark, str(tmp_path / "a.json"), many_lines=True), bars.json_text(spark, json.dumps(rows)), bars.json_text(spark, "".join(map(json.dumps, rows)))):
        got = df.orderBy("time").collect()
        assert [(r["date"], r["open"], r["close"]) for r in got] == [(20230101.0, None, 2.0), (20230103.0, 1.0, 1.5)]


def test_arrays(spark):
    with pytest.raises(ValueError, match="differ"):
        bars.arrays(spark, {"close": [1], "open": [1, 2]})
    assert bars.arrays(spark, {}).count() == 0
    assert bars.count(bars.arrays(spark, {"close": [1, 2]})).first()["bars"] == 2


def test_results(spark, tmp_path):
    out = run(bars.mock(spark, 12), "A: MA(C,3);")
    text = results.csv_text(out).splitlines()
    assert text[0] == "time,A" and text[1] == "2023-01-01 00:00:00,nan" and text[3] == "2023-01-01 00:02:00,95.500"
    results.write_csv(out, str(tmp_path / "o"))
    assert spark.read.csv(str(tmp_path / "o"), header=True).count() == 12
    assert results.ends(out, n=2).count() == 4
    assert results.latest(out, ["A"]).first()["A"] == pytest.approx(100.0)


def test_stream_equals_batch(spark, tmp_path):
    script = "M: MA(C,3); E: EMA(C,4); X: CROSS(C,M); R: RSI(C,3);"
    rows = [("a" if k % 3 else "b", float(k), float((k * 7) % 11)) for k in range(40)]
    src = tmp_path / "in"
    for part in range(4):
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], "symbol string, time double, close double").coalesce(1).write.mode("append").json(str(src))
    live = spark.readStream.schema("symbol string, time double, close double").option("maxFilesPerTrigger", 1).json(str(src))
    q = stream(live, script, ["M", "E", "X", "R"]).writeStream.format("memory").queryName("streamed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    want = {(r["symbol"], r["time"]): tuple(r)[2:] for r in run(spark.createDataFrame(rows, "symbol string, time double, close double"), script, symbol="symbol").collect()}
    got = {(r["symbol"], r["time"]): tuple(None if v is None or v != v else v for v in tuple(r)[2:]) for r in spark.sql("select * from streamed").collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v), k


def test_reports(spark, tmp_path):
    from tickloom.plans.report import check_file

    (tmp_path / "s.tdx").write_text("A: MA(C,5);\n\nB: NOPE(C);\nC1: C +;\n")
    r = check_file(str(tmp_path / "s.tdx"))
    assert (r.scripts, r.good, [k for k, _ in r.failures]) == (3, 1, [3, 4])


def test_queries_have_their_sql():
    assert {k for k in queries.QUERIES if k not in queries.ORACLES} == {"rand"}


@pytest.mark.parametrize("name", ["two_averages", "expmema", "extreme_bars", "find", "kdj"])
def test_queries_equal_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{sf}/events.parquet'")
    got = queries.QUERIES[name](spark, sf)
    names = sorted(got.columns)
    clean = lambda rows: sorted(tuple((v is not None and v == v, v if v is not None and v == v else 0) for v in r) for r in rows)
    assert clean(got.select(names).collect()) == clean(c.execute(f"select {', '.join(names)} from ({queries.ORACLES[name]})").fetchall())
