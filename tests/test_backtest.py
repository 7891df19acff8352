"""Portfolio timing, folds, streams and the registered queries."""

import math

from panelwise.operators import backtest, folds, joins
from panelwise.streaming import incremental

from .helpers import rows


def test_portfolio_timing(spark):
    """Three names, a signal every third date, held from two dates later; worked out by hand."""
    scores = {0: (9, 5, 1), 3: (2, 8, 6), 6: (3, 4, 7)}
    moves = {d: (0.10 + d / 100, 0.20 - d / 100, -0.05) for d in range(9)}
    data = [(d, "XYZ"[k], float(scores.get(d, (0, 0, 0))[k]), moves[d][k]) for d in range(9) for k in range(3)]
    df = spark.createDataFrame(data, "date_no int, security string, score double, ret double")
    path = {r.date_no: r for r in backtest.strategy_path(df, df, 3, 2, 1).collect()}
    # X leads from date 2 to 4, Y from 5 to 7, Z on 8; Z trails first, then X
    assert {d: round(r.top, 9) for d, r in path.items()} == {2: 0.12, 3: 0.13, 4: 0.14, 5: 0.15, 6: 0.14, 7: 0.13, 8: -0.05}
    assert {d: round(r.bottom, 9) for d, r in path.items()} == {2: -0.05, 3: -0.05, 4: -0.05, 5: 0.15, 6: 0.16, 7: 0.17, 8: 0.18}
    blocks = {(r.signal_no, r.leg): r for r in backtest.block_returns(df, df, 3, 2, 1).collect()}
    assert math.isclose(blocks[(0, "top")].block_ret, 1.12 * 1.13 * 1.14 - 1) and blocks[(0, "top")].complete
    assert math.isclose(blocks[(3, "bottom")].block_ret, 1.15 * 1.16 * 1.17 - 1) and not blocks[(6, "top")].complete


def test_strategy_summary_by_leg(spark):
    path = spark.createDataFrame([(0, 0.1, 0.0, 0.1, 1.0, 0.5), (1, -0.1, 0.1, -0.2, 0.5, 0.5), (2, 0.3, 0.1, 0.2, 1.0, 1.0)], "date_no int, top double, bottom double, spread double, cover_top double, cover_bottom double")
    events = spark.createDataFrame([("top", 0, "A"), ("top", 0, "B"), ("top", 2, "B"), ("top", 2, "C"), ("bottom", 0, "D"), ("bottom", 2, "D")], "leg string, signal_no int, security string")
    got = {r.leg: r for r in backtest.summarize_strategy(path, events, ann=2.0).collect()}
    assert math.isclose(got["top"].ann_ret, 0.2) and math.isclose(got["top"].coverage, 2.5 / 3) and math.isclose(got["spread"].coverage, 2 / 3)
    assert got["top"].rebalances == 2 and (got["top"].turnover, got["bottom"].turnover, got["spread"].turnover) == (0.5, 0.0, 0.25)
    assert got["top"].ann_turnover == 0.5 and got["spread"].ann_turnover == 0.25  # two dates are one year here


def test_quantile_portfolio(spark):
    """Six names a period, halves by rank with ties by id: turnover counts new names, costs are paid on both legs."""
    one = [("a", 1, 10.0, 0.06, 1.0), ("b", 1, 10.0, 0.03, -5.0), ("c", 1, 8.0, 0.02, 3.0), ("d", 1, 3.0, 0.01, 1.0), ("e", 1, 2.0, 0.00, 1.0), ("f", 1, 1.0, -0.01, 2.0)]
    two = [("a", 2, 9.0, 0.02, 1.0), ("b", 2, 1.0, 0.01, None), ("c", 2, 8.0, 0.04, 1.0), ("d", 2, 7.0, 0.06, 2.0), ("e", 2, 2.0, 0.03, None), ("f", 2, 3.0, 0.05, 0.0)]
    few = [("a", 3, 1.0, 0.1, 1.0), ("b", 3, 2.0, 0.2, 1.0), ("c", 3, 3.0, 0.3, 1.0)]
    df = spark.createDataFrame(one + two + few, "security string, qi int, score double, ret double, cap double")
    got = {r.qi: r for r in backtest.build_portfolio(df, "score", "ret", ["qi"], 2, tcost=0.01).collect()}
    assert sorted(got) == [1, 2]
    assert math.isclose(got[1].long, 0.11 / 3) and math.isclose(got[1].short, 0.0, abs_tol=1e-12) and got[1].turnover == 1.0
    assert math.isclose(got[2].long, 0.04) and math.isclose(got[2].short, 0.03) and math.isclose(got[2].turnover, 1 / 3) and math.isclose(got[2].net, 0.01 - 0.02 / 3)
    weighed = {r.qi: r for r in backtest.build_portfolio(df, "score", "ret", ["qi"], 2, cap="cap").collect()}
    assert math.isclose(weighed[1].long, (0.06 * 1 + 0.02 * 3) / 4) and math.isclose(weighed[2].short, 0.03)  # a leg without weights is equal


def test_daily_rule_equals_plain_portfolio(spark):
    data = [(d, s, float((d * 7 + i * 3) % 5), 0.01 * ((d + i) % 3)) for d in range(6) for i, s in enumerate("ABCDE")]
    df = spark.createDataFrame(data, "date_no int, security string, score double, ret double")
    from panelwise.operators.xsec import top_bottom

    plain = {}
    for r in top_bottom(df, "score", 2, ["date_no"], "security").collect():
        plain.setdefault((r.date_no, r.leg), []).append(r.ret)
    for r in backtest.strategy_path(df, df, 1, 0, 2).collect():
        assert math.isclose(r.top, sum(plain[(r.date_no, "top")]) / 2, rel_tol=1e-12) and math.isclose(r.bottom, sum(plain[(r.date_no, "bottom")]) / 2, rel_tol=1e-12)


def test_first_turnover_is_a_choice(spark):
    df = spark.createDataFrame([("top", 0, "A"), ("top", 0, "B"), ("top", 1, "B"), ("top", 1, "C")], "leg string, signal_no int, security string")
    assert [r.turnover for r in backtest.name_turnover(df, ["leg"], "signal_no").orderBy("signal_no").collect()] == [None, 0.5]
    assert [r.turnover for r in backtest.name_turnover(df, ["leg"], "signal_no", first=1.0).orderBy("signal_no").collect()] == [1.0, 0.5]


def test_folds_do_not_leak(spark):
    f = folds.quarter_folds(spark, 1, 40, 28, 8, 8)
    assert [(r.train_lo, r.train_hi, r.test_lo, r.test_hi) for r in f.collect()] == [(1, 20, 21, 28), (9, 28, 29, 36)]
    df = spark.createDataFrame([(q, q + 2) for q in range(1, 41)], "qi int, label_end int")
    placed = joins.assign_folds(df, f, "qi", "label_end")
    assert rows(placed.filter("role = 'train' and fold = 0").groupBy().max("qi")) == [(18,)]
    assert rows(placed.filter("role = 'test' and fold = 0").groupBy().min("qi")) == [(21,)]
    single = folds.period_folds(spark, list(range(10)), "single", 6, embargo=2).collect()[0]
    assert (single.train_hi, single.test_lo, single.test_hi) == (3, 6, 9)


def test_stream_equals_batch(spark, tmp_path):
    data = [(f"2024-01-0{d} 0{h}:00:00", "A" if h % 2 else "B", 0.01 * h) for d in (1, 2, 3, 9) for h in range(1, 6)]
    df = spark.createDataFrame(data, "ts string, security string, ret double").selectExpr("cast(ts as timestamp) as ts", "security", "ret")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = incremental.stream_compound(stream, "ts", ["security"], "ret", "30 days").writeStream.format("memory").queryName("x1").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    got = [(a, b, round(c, 9), d) for a, b, c, d in rows(spark.table("x1"))]
    want = [(a, b, round(c, 9), d) for a, b, c, d in rows(incremental.stream_compound(df, "ts", ["security"], "ret"))]
    assert got == want and len(want) == 8


def test_append_mode_emits_closed_windows(spark, tmp_path):
    df = spark.sql("select * from values (timestamp'2024-01-01 10:00:00', 'A', 0.1), (timestamp'2024-01-01 11:00:00', 'A', 0.2) as t(ts, security, ret)").selectExpr("ts", "security", "cast(ret as double) as ret")
    late = spark.sql("select timestamp'2024-01-20 10:00:00' as ts, 'A' as security, 0.5D as ret")
    for i, part in enumerate((df, late, late)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del i
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = incremental.stream_compound(stream, "ts", ["security"], "ret", "1 day").writeStream.format("memory").queryName("x1a").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert [round(r.ret, 9) for r in spark.table("x1a").collect()] == [0.32]


def test_snapshot_stream_equals_batch(spark, tmp_path):
    data = [("2024-03-01 08:00:00", 1, "A", 5.0), ("2024-03-01 09:00:00", 2, "A", 6.0), ("2024-03-01 09:00:00", 3, "A", 7.0), ("2024-03-02 01:00:00", 4, "A", 8.0), ("2024-03-01 23:00:00", 5, "B", 9.0)]
    df = spark.createDataFrame(data, "ts string, event_id long, k string, value double").selectExpr("cast(ts as timestamp) as ts", "event_id", "k", "value")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = incremental.stream_snapshot(stream, "ts", ["k"], ["value"], ["event_id"], width="1 day").writeStream.format("memory").queryName("x2").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    got = rows(spark.table("x2"), "k", "value")
    assert got == rows(incremental.stream_snapshot(df, "ts", ["k"], ["value"], ["event_id"], width="1 day"), "k", "value") == [("A", 7.0), ("A", 8.0), ("B", 9.0)]


def test_sources(spark, tmp_path):
    from panelwise.sources import io

    raw = spark.sql("select '0010001' as LgcyInvestorId, date'2024-03-30' as day, 'X' as security, 401 as InvTypeCode, '1' as isUs, 5.0D as ShsHldVal")
    raw.write.parquet(str(tmp_path / "2024.parquet"))
    got = io.read_holdings(spark, str(tmp_path), [2023, 2024], True, "401").first()
    assert (got.fund, got.is_us, got.position_value, got.shares) == ("10001", True, 5.0, None)
    csv = spark.sql("select '2024-01-02' as date, ' 007 ' as perm_id, 't' as trade_id, 's1' as signal_name, 0.5D as signal_val union all select '2024-01-02', '8', 't', 's2', 0.1D")
    io.write_results({"signals": csv}, str(tmp_path), "csv")
    assert rows(io.read_signal_csv(spark, str(tmp_path / "signals"), "s1"), "perm_id", "value") == [("7", 0.5)]
    io.write_config(spark, {"n": 5}, str(tmp_path / "config"))
    assert spark.read.text(str(tmp_path / "config")).first()[0] == '{"n": 5}'
    daily = spark.sql("select date'2024-01-02' as day, 'A' as security, -2.0D as TRET_T1D, 1.0D as turnover_21day, -5.0D as market_cap, -3.0D as prc")
    daily.write.parquet(str(tmp_path / "daily"))
    row = io.read_daily(spark, str(tmp_path / "daily")).first()
    assert row.TRET_T1D is None and row.market_cap is None and row.price == 3.0
