"""Queries of daily windows, backtests, regimes, arrays, folds, models, sources and streams."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as X
from ..functions import columns as C
from ..operators import arrays as A
from ..operators import backtest as B
from ..operators import clean, folds, joins, lags, linear, model, regime, rolling, sketches, sorts, stats, xsec
from ..operators import holdings as H
from ..sources import io
from ..streaming import incremental
from .model_sql import FOLDS, ic_sql, least_squares_sql, score_rows_sql
from .queries_signals import bucketed_sql, perf, perf_sql
from .registry import query, rounded

_N = "with d as (select day, cast(row_number() over (order by day) - 1 as int) as date_no from (select distinct day from {daily})), x as (select security, day, ret, turnover, market_cap, date_no from {daily} join d using (day))"


@query("w9_rolling_return", _N + " select security, date_no, round(case when count(ret) over w = 5 then exp(sum(ln(1 + ret)) over w) - 1 end, 8) as ret_5 from x window w as (partition by security order by date_no range between 4 preceding and current row)")
def _(p):
    return rounded(rolling.rolling_return(p.numbered, ["security"], "ret", 5).select("security", "date_no", "ret_5"), 8)


@query("w9_rolling_return_long", _N + " select security, date_no, round(case when count(ret) over w = 20 then exp(sum(ln(1 + ret)) over w) - 1 end, 6) as ret_20 from x window w as (partition by security order by date_no range between 19 preceding and current row)")
def _(p):
    return rounded(rolling.rolling_return_long(p.numbered, ["security"], "ret", 20).select("security", "date_no", "ret_20"))


@query("w10_rolling_vol", _N + " select security, date_no, round(case when count(ret) over w = 5 then stddev_pop(ret) over w end, 8) as vol_5 from x window w as (partition by security order by date_no range between 4 preceding and current row)")
def _(p):
    return rounded(rolling.rolling_vol(p.numbered, ["security"], "ret", 5).select("security", "date_no", "vol_5"), 8)


@query("w11_forward_return", _N + " select security, date_no, round(case when count(ret) over w = 5 then exp(sum(ln(1 + ret)) over w) - 1 end, 8) as fwd_5 from x window w as (partition by security order by date_no range between 1 following and 5 following)")
def _(p):
    return rounded(rolling.forward_return(p.numbered, ["security"], "ret", 5).select("security", "date_no", "fwd_5"), 8)


@query("w14_ewm", """
    with recursive m as (select day, level, row_number() over (order by day) as k from {market}),
      r as (select k, day, level, level as mean, 0.0::double as var, 1.0::double as sq from m where k = 1 union all
        select m.k, m.day, m.level, r.mean + 2 / 11 * (m.level - r.mean), (1 - 2 / 11) * (r.var + 2 / 11 * (m.level - r.mean) * (m.level - r.mean)), (1 - 2 / 11) * (1 - 2 / 11) * r.sq + 2 / 11 * (2 / 11) from r join m on m.k = r.k + 1),
      e as (select day, level, mean, case when k = 1 then 0 else sqrt(var / (1 - sq)) end + 1e-10 as std from r)
    select day, level, round(mean, 4) as level_ewm, round(std, 4) as level_ewmstd, round(greatest(least(mean / std, 5), -5), 6) as mom_ratio from e""")
def _(p):
    series = p["market"].withColumn("k", F.lit("m"))
    out = rolling.momentum_ratio(rolling.ewm(series, ["k"], "level", 10, "day"), "level_ewm", "level_ewmstd").drop("k")
    return rounded(rounded(out, 4, "level_ewm", "level_ewmstd"), 6, "mom_ratio")


@query("w15_rolling_long", """
    with a as (select day, level, avg(level) over w as m, coalesce(stddev_samp(level) over w, 0) as s, max(level) over w as x from {market} window w as (order by day rows between 251 preceding and current row))
    select day, round(m / level, 7) as mean, round(s, 3) as std, x as max, round(greatest(least((level - (m - 2 * s)) / case when s = 0 then 1e-10 else 4 * s end, 1), 0), 6) as pctb, round((level - x) / case when x = 0 then 1e-10 else x end, 6) as dd from a""")
def _(p):
    r = rolling.rolling_long(p["market"].withColumn("k", F.lit(1)), ["k"], "level", 252, "day")
    out = r.select("day", (F.col("level_mean252") / F.col("level")).alias("mean"), F.col("level_std252").alias("std"), F.col("level_max252").alias("max"), F.col("level_pctb252").alias("pctb"), F.col("level_dd252").alias("dd"))
    return rounded(rounded(rounded(out, 7, "mean"), 3, "std"), 6, "pctb", "dd")


@query("w15_rolling", """
    with a as (select day, level, avg(level) over w as m, coalesce(stddev_samp(level) over w, 0) as s, max(level) over w as x from {market} window w as (order by day rows between 4 preceding and current row))
    select day, round(m / level, 9) as mean, round(s, 4) as std, x as max, round(greatest(least((level - (m - 2 * s)) / case when s = 0 then 1e-10 else 4 * s end, 1), 0), 6) as pctb, round((level - x) / case when x = 0 then 1e-10 else x end, 6) as dd from a""")
def _(p):
    r = rolling.rolling(p["market"].withColumn("k", F.lit(1)), ["k"], "level", 5, "day")
    out = r.select("day", (F.col("level_mean5") / F.col("level")).alias("mean"), F.col("level_std5").alias("std"), F.col("level_max5").alias("max"), F.col("level_pctb5").alias("pctb"), F.col("level_dd5").alias("dd"))
    return rounded(rounded(rounded(out, 9, "mean"), 4, "std"), 6, "pctb", "dd")


@query("w16_rolling_corr", _N + " select security, date_no, round(case when count(*) over w >= 5 then corr(ret, turnover) over w end, 4) as corr_ret_turnover from x window w as (partition by security order by date_no rows between 9 preceding and current row)")
def _(p):
    x = p.numbered.withColumn("turnover", F.col("turnover").cast("double"))
    return rounded(rolling.rolling_corr(x, ["security"], "ret", "turnover", 10, "date_no").select("security", "date_no", "corr_ret_turnover"), 4)


@query("w21_wealth", """
    with m as (select day, avg(ret) as ret from {daily} group by day), g as (select day, ret, exp(sum(ln(1 + ret)) over (order by day)) as wealth, sum(ret) over (order by day) as cum from m) select day, round(wealth, 8) as wealth, round(cum, 8) as cum, round(wealth / greatest(max(wealth) over (order by day), 1) - 1, 8) as drawdown from g""")
def _(p):
    m = p["daily"].groupBy("day").agg(F.avg("ret").alias("ret")).withColumn("k", F.lit(1))
    return rounded(stats.wealth(m, ["k"], "ret", "day", peak_at_one=True).select("day", "wealth", "cum", "drawdown"), 8)


def _scores(p):
    return p.numbered.select("security", "date_no", "ret", (F.col("turnover") * 1000 + F.col("security") % 7).cast("double").alias("score"))


_SEL = _N + """, s as (select security, date_no, ret, turnover * 1000 + security % 7 as score from x), k as (select date_no, (row_number() over (order by date_no) - 1) % 3 as m from (select distinct date_no from s)),
  r as (select s.security, s.date_no, row_number() over (partition by s.date_no order by score desc, security) as t, row_number() over (partition by s.date_no order by score, security desc) as b from s join k using (date_no) where m = 0),
  e as (select date_no as signal_no, date_no + 1 as start_no, 'top' as leg, security from r where t <= 5 union all select date_no, date_no + 1, 'bottom', security from r where b <= 5)"""


@query("e21_selections", _SEL + " select signal_no, start_no, leg, security from e")
def _(p):
    return B.selections(_scores(p), 3, 1, 5)


_PATH = """h as (select e.*, start_no + i as date_no from e, range(3) q(i)), v as (select h.*, s.ret from h join (select distinct date_no from s) c using (date_no) left join s on s.security = h.security and s.date_no = h.date_no),
    path as (select cast(date_no as int) as date_no, avg(case when leg = 'top' then ret end) as top, avg(case when leg = 'bottom' then ret end) as bottom, avg(case when leg = 'top' then ret end) - avg(case when leg = 'bottom' then ret end) as spread, count(case when leg = 'top' then 1 end) as n_top, count(case when leg = 'bottom' then 1 end) as n_bottom,
      avg(case when leg = 'top' then (ret is not null)::int end) as cover_top, avg(case when leg = 'bottom' then (ret is not null)::int end) as cover_bottom from v group by date_no having cover_top >= 0.6 and cover_bottom >= 0.6)"""


@query("e21_strategy_path", _SEL + ", " + _PATH + " select date_no, round(top, 12) as top, round(bottom, 12) as bottom, round(spread, 12) as spread, n_top, n_bottom, round(cover_top, 12) as cover_top, round(cover_bottom, 12) as cover_bottom from path")
def _(p):
    s = _scores(p)
    return rounded(B.strategy_path(s, s.select("date_no", "security", "ret"), 3, 1, 5, min_share=0.6), 12)


@query("e21_block_returns", _SEL + """, h as (select e.*, start_no + i as date_no from e, range(3) q(i)), v as (select h.*, s.ret from h join (select distinct date_no from s) c using (date_no) left join s on s.security = h.security and s.date_no = h.date_no),
    n as (select signal_no, leg, security, exp(sum(ln(1 + ret))) - 1 as r, count(ret) as n from v group by all) select signal_no, leg, round(avg(r), 8) as block_ret, min(n) = 3 as complete from n group by signal_no, leg""")
def _(p):
    s = _scores(p)
    return rounded(B.block_returns(s, s.select("date_no", "security", "ret"), 3, 1, 5), 8)


@query("e22_summarize_strategy", _SEL + ", " + _PATH + """, legs as (select date_no, unnest([{'leg': 'top', 'ret': top, 'cover': cover_top}, {'leg': 'bottom', 'ret': bottom, 'cover': cover_bottom}, {'leg': 'spread', 'ret': spread, 'cover': least(cover_top, cover_bottom)}], recursive := true) from path),
    c as (select leg, avg(cover) as coverage from legs group by leg), nm as (select leg, signal_no, list(security) as names, count(*) as k from e group by leg, signal_no), lg as (select *, lag(names) over (partition by leg order by signal_no) as b from nm),
    tn as (select leg, signal_no, case when b is not null then 1 - len(list_intersect(names, b)) / k end as t from lg), t3 as (select leg, signal_no, t from tn union all select 'spread', signal_no, (max(case when leg = 'top' then t end) + max(case when leg = 'bottom' then t end)) / 2 from tn group by signal_no),
    tt as (select leg, count(*) as rebalances, avg(t) as turnover, sum(t) as total from t3 group by leg), yr as (select greatest((max(date_no) - min(date_no)) / 252, 1 / 252) as years from path), pf as (with """ + perf_sql("legs", "leg", 252.0, "date_no", 2, 2) + ") select pf.*, round(coverage, 6) as coverage, rebalances, round(turnover, 6) as turnover, round(total / years, 4) as ann_turnover from pf join c using (leg) join tt using (leg), yr")
def _(p):
    s = _scores(p)
    out = B.summarize_strategy(B.strategy_path(s, s.select("date_no", "security", "ret"), 3, 1, 5, min_share=0.6), B.selections(s, 3, 1, 5), lags=2)
    return rounded(rounded(perf(out), 6, "coverage", "turnover"), 4, "ann_turnover")


@query("a26_name_turnover", _SEL + """, h as (select leg, signal_no, list(security) as names, count(*) as k from e group by leg, signal_no), l as (select *, lag(names) over (partition by leg order by signal_no) as b from h)
    select leg, signal_no, cast(k as int) as k, round(case when b is not null then 1 - len(list_intersect(names, b)) / k end, 6) as turnover from l""")
def _(p):
    return rounded(B.name_turnover(B.selections(_scores(p), 3, 1, 5), ["leg"], "signal_no"))


@query("a27_selection_profile", _SEL + """, m as (select leg, signal_no, quantile_cont(x.ret, 0.5) as ret, quantile_cont(x.market_cap, 0.5) as market_cap from e join x on x.security = e.security and x.date_no = e.signal_no group by leg, signal_no)
    select leg, 'ret' as "column", round(avg(ret), 8) as value from m group by leg union all select leg, 'market_cap', round(avg(market_cap), 8) from m group by leg""")
def _(p):
    e = B.selections(_scores(p), 3, 1, 5).withColumnRenamed("signal_no", "date_no").join(p.numbered, ["date_no", "security"])
    return rounded(H.selection_profile(e, ["ret", "market_cap"], date="date_no"), 8)


def _portfolio_sql(source: str, keys: str, order: str, n: int, score: str, weight: str = "1.0", cost: float = 0.0) -> str:
    """CTEs that end in pf: the quantile portfolio of a relation with columns security, y and the score."""
    over, group = f"partition by {keys}", keys.replace(f", {order}", "").replace(order, "")
    legs = f"{group}, leg" if group else "leg"
    return f"""pa as (select *, row_number() over ({over} order by {score}, security) as r, count(*) over ({over}) as m from {source} where y is not null and {score} is not null),
      pl as (select *, {weight} as w, case when r >= 1 + (m - 1) * (1 - 1 / {n}) then 'long' when r <= 1 + (m - 1) * (1 / {n}) then 'short' end as leg from pa where m >= 2 * {n}),
      pg as (select {keys}, leg, coalesce(sum(w * y) / nullif(sum(w), 0), avg(y)) as ret, list(distinct security) as ids, any_value(m) as m from pl where leg is not null group by {keys}, leg),
      pt as (select *, lag(ids) over (partition by {legs} order by {order}) as b from pg), pu as (select {keys}, leg, ret, m, case when b is null then 1 else 1 - len(list_intersect(ids, b)) / len(ids) end as fresh from pt),
      pf as (select {keys}, max(case when leg = 'long' then ret end) as long, max(case when leg = 'short' then ret end) as short, avg(fresh) as turnover, any_value(m) as n, max(case when leg = 'long' then ret end) - max(case when leg = 'short' then ret end) as gross,
        max(case when leg = 'long' then ret end) - max(case when leg = 'short' then ret end) - avg(fresh) * {2 * cost} as net from pu group by {keys})"""


@query("e23_build_portfolio", "with src as (select security, qi, trades, fwd_1q as y, market_cap from {sql_panel}), " + _portfolio_sql("src", "qi", "qi", 10, "trades", "greatest(coalesce(market_cap, 0), 0)", 0.001) + " select qi, round(long, 8) as long, round(short, 8) as short, round(gross, 8) as gross, round(turnover, 8) as turnover, round(net, 8) as net, n from pf")
def _(p):
    return rounded(B.build_portfolio(p.panel, "trades", "fwd_1q", ["qi"], 10, tcost=0.001, cap="market_cap"), 8)


@query("e23_gross_returns", "with src as (select security, qi, ret, fwd_1q as y from {sql_panel}), " + _portfolio_sql("src", "qi", "qi", 10, "ret") + " select qi, round(long, 8) as long, round(short, 8) as short, round(gross, 8) as gross from pf")
def _(p):
    return rounded(B.build_portfolio(p.panel, "ret", "fwd_1q", ["qi"], 10).select("qi", "long", "short", "gross"), 8)


@query("e23_periods_per_year", "with d as (select distinct day from {market}), g as (select date_diff('day', lag(day) over (order by day), day) as g from d) select round(365.25 / quantile_cont(g, 0.5), 6) as ann from g where g is not null")
def _(p):
    return rounded(B.periods_per_year(p["market"], "day"))


@query("e24_size_groups", """with pts as (select qi, quantile_cont(market_cap, [0.2, 0.5, 0.8]) as q from {sql_panel} group by qi), sg as (select security, p.qi, ret, fwd_1q as y, case when market_cap <= q[1] then 'micro' when market_cap <= q[2] then 'small' when market_cap <= q[3] then 'mid' else 'large' end as g from {sql_panel} p join pts using (qi) where market_cap is not null),
    src as (select security, qi, ret, y, g as "group" from sg union all select security, qi, ret, y, 'all' from sg union all select security, qi, ret, y, 'non_micro' from sg where g <> 'micro'), """ + _portfolio_sql("src", '"group", qi', "qi", 5, "ret") + """, fin as (select "group", qi, gross as ret from pf), """ + perf_sql("fin", '"group"'))
def _(p):
    return perf(B.size_group_analysis(p.panel.filter("market_cap is not null"), "ret", "fwd_1q", "market_cap", ["qi"], ann=4.0))


@query("e25_beta_over_time", """
    with a as (select year(day)::varchar || case when month(day) <= 6 then 'H1' else 'H2' end as half, day, ret, turnover from {daily}), b as (select day, regr_slope(ret, turnover) as slope, regr_sxx(ret, turnover) as sxx, regr_syy(ret, turnover) as syy, regr_sxy(ret, turnover) as sxy, regr_r2(ret, turnover) as r2, regr_count(ret, turnover)::bigint as n from a group by day)
    select day, round(slope, 8) as slope, round(sqrt(greatest((syy - slope * sxy) / (n - 2), 0) / sxx), 8) as se, round(slope / sqrt(greatest((syy - slope * sxy) / (n - 2), 0) / sxx), 4) as t, round(r2, 6) as r2, n from b""")
def _(p):
    d = p["daily"].withColumn("half", C.half_year("day")).withColumn("turnover", F.col("turnover").cast("double"))
    return rounded(rounded(rounded(stats.beta_over_time(d, "turnover", "ret", ["day"]), 8, "slope", "se"), 4, "t"), 6, "r2")


@query("e26_period_diagnostics", """
    with r as (select qi, trades, fwd_1q as y, rank() over (partition by qi order by trades) + (count(*) over (partition by qi, trades) - 1) / 2 as a, rank() over (partition by qi order by fwd_1q) + (count(*) over (partition by qi, fwd_1q) - 1) / 2 as b,
        row_number() over (partition by qi order by trades desc, security) as t, row_number() over (partition by qi order by trades, security) as l, greatest(1, ceil(0.1 * count(*) over (partition by qi))) as k from {sql_panel} where fwd_1q is not null and trades is not null)
    select qi, count(*) as n, round(avg(trades), 6) as score_mean, round(stddev_samp(trades), 6) as score_sd, round(corr(a, b), 6) as rank_ic, round(corr(trades, y), 6) as pearson_ic, round(avg(case when t <= k then y end), 8) as high, round(avg(case when l <= k then y end), 8) as low,
      round(avg(case when t <= k then y end) - avg(case when l <= k then y end), 8) as long_short, round(avg(case when t <= k then (y > 0)::int end), 6) as hit_high, round(avg(case when l <= k then (y < 0)::int end), 6) as hit_low, avg(case when t <= k then y end) < avg(case when l <= k then y end) as wrong_tail
    from r group by qi having count(*) >= 20 and stddev_samp(trades) >= 1e-12""")  # fmt: skip
def _(p):
    out = regime.period_diagnostics(p.panel, "trades", "fwd_1q", "qi")
    return rounded(rounded(out, 6, "score_mean", "score_sd", "rank_ic", "pearson_ic", "hit_high", "hit_low"), 8, "high", "low", "long_short")


_GATED = """with m as (select day, level, round(level / lag(level) over (order by day) - 1, 9) as ret from {market}), g as (select day, ret, level, case when level < 140000 then 'low' when level > 152000 then 'high' else 'mid' end as regime from m where ret is not null)"""


def _gated(p):
    m = p["market"].withColumn("ret", F.round(F.col("level") / F.lag("level").over(W.orderBy("day")) - 1, 9)).filter("ret is not null")
    return regime.named_gate(m, "level", "gate_140000_152000")


@query("p22_gate", _GATED + " select day, regime, regime in ('low', 'high') as active, case when regime in ('low', 'high') then ret else 0 end as ret_gated from g")
def _(p):
    return _gated(p).select("day", "regime", "active", "ret_gated")


_GATE_PARTS = """round(avg({r}) / stddev_samp({r}) * sqrt(252), 4) as {r}_sharpe_raw, round(avg({r}2) / stddev_samp({r}2) * sqrt(252), 4) as {r}_sharpe_gated, round(pow(exp(sum(ln(1 + {r}))), 252 / count(*)) - 1, 4) as {r}_cagr_raw, round(pow(exp(sum(ln(1 + {r}2))), 252 / count(*)) - 1, 4) as {r}_cagr_gated,
      round(avg(case when active then {r} end), 6) as {r}_active, round(avg(case when not active then {r} end), 6) as {r}_inactive"""


@query("e27_summarize_gate", _GATED + """, x as (select ret, ret / 2 as long_only, regime in ('low', 'high') as active, case when regime in ('low', 'high') then ret else 0 end as ret2, case when regime in ('low', 'high') then ret / 2 else 0 end as long_only2, level from g)
    select count(*) as n, count(case when active then 1 end) as active_periods, count(case when not active then 1 end) as inactive_periods, round(avg(active::int), 6) as active_share, """ + ", ".join(_GATE_PARTS.format(r=r) for r in ("ret", "long_only")) + ", round(avg(case when active then level end), 4) as level_active, round(avg(case when not active then level end), 4) as level_inactive from x")
def _(p):
    g = _gated(p).withColumn("long_only", F.col("ret") / 2).withColumn("long_only_gated", F.when(F.col("active"), F.col("long_only")).otherwise(0.0))
    out = regime.summarize_gate(g, ["ret", "long_only"], 252.0, "level")
    fine = [c for c in out.columns if c.endswith(("active_share", "ret_active", "ret_inactive", "only_active", "only_inactive"))]
    return rounded(rounded(out, 6, *fine), 4, *[c for c, t in out.dtypes if t == "double" and c not in fine])


@query("e37_long_only", """
    with sc as (select * from {sql_panel} where trades is not null), sz as (select qi, count(*) as n from sc group by qi), lo as (select greatest(15, floor(quantile_cont(n, 0.5) / 2)) as least from sz),
      gd as (select qi, trades, fwd_1q, ret, (rank() over (partition by qi order by trades) + (count(*) over (partition by qi, trades) - 1) / 2) / count(*) over (partition by qi) as p from sc where fwd_1q is not null and ret is not null),
      mn as (select qi, count(*) as n, stddev_samp(trades) as sd, avg(case when p >= 0.9 then fwd_1q end) as f, avg(case when p >= 0.9 then ret end) as r from gd group by qi),
      src as (select qi, 'fwd_1q' as series, f as ret from mn, lo where n >= least and sd >= 1e-12 union all select qi, 'ret', r from mn, lo where n >= least and sd >= 1e-12), """ + perf_sql("src", "series"))
def _(p):
    return perf(sorts.long_only(p.panel, "trades", ["fwd_1q", "ret"], ["qi"], ann=4.0, period="qi"))


def _surface(p):
    return p["surface"].withColumn("a", F.col("embedding").cast("array<double>"))


_S = "with e as (select vec_id, label, i, embedding[i]::double as x from {embeddings}, range(1, 65) t(i))"


@query("g1_array_round_trip", _S + " select vec_id, round(sum(x), 6) as total, count(*) as n from e group by vec_id")
def _(p):
    wide = _surface(p).select("vec_id", *[F.col("a")[i].alias(f"iv_{i:03d}") for i in range(64)])
    a = X.to_array([f"iv_{i:03d}" for i in range(64)])
    return rounded(wide.select("vec_id", X.array_sum(a).alias("total"), F.size(a).cast("long").alias("n")))


@query("g2_surface_stats", _S + ", m as (select vec_id, avg(x) as m, stddev_pop(x) as s from e group by vec_id) select vec_id, round(any_value(m), 6) as level, round(any_value(s), 6) as dispersion, round(any_value(s / nullif(abs(m), 0)), 3) as cov, round(count(case when x < -0.1 or x > 0.2 then 1 end) / 64, 6) as extreme from e join m using (vec_id) group by vec_id")
def _(p):
    out = _surface(p).select("vec_id", X.surface_stats(F.col("a"), -0.1, 0.2).alias("s")).select("vec_id", "s.*")
    return rounded(rounded(out, 3, "cov"), 6, "level", "dispersion", "extreme")


_GRID = "with e as (select vec_id, (i - 1) // 8 as r, (i - 1) % 8 as c, embedding[i]::double as x from {embeddings}, range(1, 65) t(i))"


@query("g3_roughness", _GRID + """, n as (select a.vec_id, a.r, a.c, a.x, u.x as up, d.x as dn, l.x as lf, g.x as rt from e a left join e u on u.vec_id = a.vec_id and u.r = a.r - 1 and u.c = a.c left join e d on d.vec_id = a.vec_id and d.r = a.r + 1 and d.c = a.c
      left join e l on l.vec_id = a.vec_id and l.r = a.r and l.c = a.c - 1 left join e g on g.vec_id = a.vec_id and g.r = a.r and g.c = a.c + 1)
    select vec_id, round(sqrt(avg((up + dn + lf + rt - 4 * x) * (up + dn + lf + rt - 4 * x))), 6) as laplacian, round(avg(abs(rt - x)) + avg(abs(dn - x)), 6) as variation, round(sqrt(avg((up + dn - 2 * x) * (up + dn - 2 * x))), 6) as calendar from n group by vec_id""")
def _(p):
    return rounded(_surface(p).select("vec_id", X.surface_roughness(F.col("a"), 8, 8).alias("s")).select("vec_id", "s.*"))


@query("g3_strike_order", """with e as (select vec_id, (i - 1) // 8 as r, 7 - (i - 1) % 8 as c, embedding[i]::double as x from {embeddings}, range(1, 65) t(i)),
    n as (select a.vec_id, a.x, u.x as up, d.x as dn, l.x as lf, g.x as rt from e a left join e u on u.vec_id = a.vec_id and u.r = a.r - 1 and u.c = a.c left join e d on d.vec_id = a.vec_id and d.r = a.r + 1 and d.c = a.c left join e l on l.vec_id = a.vec_id and l.r = a.r and l.c = a.c - 1 left join e g on g.vec_id = a.vec_id and g.r = a.r and g.c = a.c + 1)
    select vec_id, round(sqrt(avg((up + dn + lf + rt - 4 * x) * (up + dn + lf + rt - 4 * x))), 6) as laplacian, round(avg(abs(rt - x)) + avg(abs(dn - x)), 6) as variation from n group by vec_id""")
def _(p):
    return rounded(_surface(p).select("vec_id", X.surface_roughness(F.col("a"), 8, 8, list(range(7, -1, -1))).alias("s")).select("vec_id", "s.laplacian", "s.variation"))


#: The 3 x 3 surroundings, where a place beyond the border is the nearest cell once more.
_NEAR = _GRID + """, o as (select i - 1 as dr, j - 1 as dc, case when i = 1 then 2 else 1 end * case when j = 1 then 2 else 1 end as k from range(3) a(i), range(3) b(j)),
      nb as (select a.vec_id, a.r, a.c, a.x, b.x as y, o.k from e a cross join o join e b on b.vec_id = a.vec_id and b.r = greatest(least(a.r + o.dr, 7), 0) and b.c = greatest(least(a.c + o.dc, 7), 0))"""
_MEDIANS = _NEAR + """, m as (select vec_id, r, c, any_value(x) as x, quantile_cont(y, 0.5) as m from nb group by vec_id, r, c), md as (select vec_id, quantile_cont(x, 0.5) as md from e group by vec_id), s as (select vec_id, (quantile_cont(abs(x - md), 0.5) + 1e-6) * 1.4826 as s from e join md using (vec_id) group by vec_id)"""


@query("g4_spike", _MEDIANS + " select vec_id, cast(count(case when abs(x - m) / s > 2 then 1 end) as int) as spikes, round(max(abs(x - m) / s), 6) as worst from m join s using (vec_id) group by vec_id")
def _(p):
    return rounded(_surface(p).select("vec_id", X.surface_spike(F.col("a"), 8, 8, 2.0).alias("s")).select("vec_id", "s.*"))


@query("g7_spike_repair", _MEDIANS + " select vec_id, round(sum(case when abs(x - m) > 2 * s then m else x end), 6) as total from m join s using (vec_id) group by vec_id")
def _(p):
    return rounded(_surface(p).select("vec_id", X.array_sum(X.spike_repair(F.col("a"), 8, 8, 2.0)).alias("total")))


@query("g7_smooth", _NEAR + """, k as (select vec_id, r, c, sum(k * y) / 16 as g, any_value(x) / 2 + avg(y) / 2 as box from nb group by vec_id, r, c)
    select vec_id, round(sum(abs(g)), 6) as gaussian, round(sum(abs(box)), 6) as box from k group by vec_id""")
def _(p):
    total = lambda a: X.array_sum(F.transform(a, lambda x: F.abs(x)))
    return rounded(_surface(p).select("vec_id", total(X.smooth(F.col("a"), 8, 8, 1.0, "gaussian")).alias("gaussian"), total(X.smooth(F.col("a"), 8, 8)).alias("box")))


#: The columns in the order of the strike, for the queries below, and each column's place in it.
_STRIKE = [3, 2, 1, 0, 7, 6, 5, 4]
_STRIKE_GRID = "with e as (select vec_id, (i - 1) // 8 as r, (i - 1) % 8 as m, [" + ", ".join(str(_STRIKE.index(c)) for c in range(8)) + "][(i - 1) % 8 + 1] as c, embedding[i]::double as x from {embeddings}, range(1, 65) t(i))"
_STRIKE_MEDIANS = _MEDIANS.replace(_GRID, _STRIKE_GRID)


@query("g4_spike_strike_order", _STRIKE_MEDIANS + " select vec_id, cast(count(case when abs(x - m) / s > 2 then 1 end) as int) as spikes, round(max(abs(x - m) / s), 6) as worst from m join s using (vec_id) group by vec_id")
def _(p):
    return rounded(_surface(p).select("vec_id", X.surface_spike(F.col("a"), 8, 8, 2.0, _STRIKE).alias("s")).select("vec_id", "s.*"))


@query("g7_strike_order", _STRIKE_MEDIANS + """, k as (select vec_id, r, c, sum(k * y) / 16 as g from nb group by vec_id, r, c), pl as (select distinct r, c, m as place from e)
    select m.vec_id, round(sum((r * 8 + place + 1) * case when abs(x - m) > 2 * s then m else x end), 5) as repaired, round(sum((r * 8 + place + 1) * (0.7 * x + 0.3 * g)), 5) as smoothed from m join s using (vec_id) join k using (vec_id, r, c) join pl using (r, c) group by m.vec_id""")
def _(p):
    # weighted by place, so that a cell in another place shows
    total = lambda a: X.array_sum(F.transform(a, lambda x, i: x * (i + 1)))
    out = _surface(p).select("vec_id", total(X.spike_repair(F.col("a"), 8, 8, 2.0, _STRIKE)).alias("repaired"), total(X.smooth(F.col("a"), 8, 8, 0.3, "gaussian", _STRIKE)).alias("smoothed"))
    return rounded(out, 5)


def _metrics(p):
    return _surface(p).select("vec_id", "label", X.surface_roughness(F.col("a"), 8, 8).alias("r"), X.surface_stats(F.col("a")).alias("s")).select("vec_id", "label", "r.laplacian", "r.variation", "s.dispersion")


_METRICS = _GRID + """, n as (select a.vec_id, a.x, u.x as up, d.x as dn, l.x as lf, g.x as rt from e a left join e u on u.vec_id = a.vec_id and u.r = a.r - 1 and u.c = a.c left join e d on d.vec_id = a.vec_id and d.r = a.r + 1 and d.c = a.c left join e l on l.vec_id = a.vec_id and l.r = a.r and l.c = a.c - 1 left join e g on g.vec_id = a.vec_id and g.r = a.r and g.c = a.c + 1),
    k as (select vec_id, round(sqrt(avg((up + dn + lf + rt - 4 * x) * (up + dn + lf + rt - 4 * x))), 9) as laplacian, round(avg(abs(rt - x)) + avg(abs(dn - x)), 9) as variation from n group by vec_id), mt as (select k.*, label from k join {embeddings} using (vec_id))"""


@query("g5_quality_score", _METRICS + """, md as (select quantile_cont(laplacian, 0.5) as ml, quantile_cont(variation, 0.5) as mv from mt where label < 5), sc as (select quantile_cont(abs(laplacian - ml), 0.5) * 1.4826 as sl, quantile_cont(abs(variation - mv), 0.5) * 1.4826 as sv from mt, md where label < 5),
    z as (select vec_id, label, (greatest((laplacian - ml) / sl, 0) + greatest((variation - mv) / sv, 0)) / 2 as noise from mt, md, sc), ct as (select quantile_cont(noise, 0.95) as cut from z where label < 5) select vec_id, round(noise, 5) as noise, noise > cut as noisy from z, ct""")
def _(p):
    m, names = rounded(_metrics(p), 9, "laplacian", "variation"), ["laplacian", "variation"]
    return rounded(A.score_quality(m, A.fit_quality(m.filter("label < 5"), names, exact=True), names).select("vec_id", "noise", "noisy"), 5)


@query("g6_drop_noisy", _METRICS + """, ct as (select quantile_cont(laplacian, 0.9) as l, quantile_cont(variation, 0.9) as v from mt where label < 5) select label, count(*) as n from mt, ct where label < 5 and laplacian <= l and variation <= v group by label""")
def _(p):
    return A.drop_noisy(rounded(_metrics(p), 9, "laplacian", "variation").filter("label < 5"), ["laplacian", "variation"], 0.9, exact=True).groupBy("label").agg(F.count("*").alias("n"))


@query("g8_cell_winsor", _S + ", q as (select i, quantile_cont(x, 0.05) as lo, quantile_cont(x, 0.95) as hi from e where label < 5 group by i) select vec_id, round(sum(greatest(least(x, hi), lo)), 6) as total from e join q using (i) group by vec_id")
def _(p):
    s = _surface(p)
    return rounded(A.cell_winsor(s.filter("label < 5"), s, "a", 0.05).select("vec_id", X.array_sum(F.col("a")).alias("total")))


@query("g8_winsor_folds", _S + """, folds as (select i as fold, 2 * i as train_lo, 2 * i + 3 as train_hi, 2 * i + 4 as test_lo, 2 * i + 5 as test_hi from range(3) t(i)),
    q as (select fold, i, quantile_disc(x, 0.05) as lo, quantile_disc(x, 0.95) as hi from e join folds on label between train_lo and train_hi group by fold, i)
    select vec_id, fold::int as fold, round(sum(i * greatest(least(x, hi), lo)), 6) as total from e join folds on label between test_lo and test_hi join q using (fold, i) group by vec_id, fold""")
def _(p):
    s = _surface(p).select("vec_id", F.col("label").cast("int").alias("label"), "a")
    out = sketches.winsor_folds(s, folds.period_folds(p.spark, list(range(10)), "rolling", 4, 2), "a", "label", 0.05)
    return rounded(out.select("vec_id", "fold", X.array_sum(F.transform("a", lambda x, i: x * (i + 1))).alias("total")))


@query("g6_drop_noisy_folds", _METRICS + """, folds as (select i as fold, 2 * i as train_lo, 2 * i + 3 as train_hi from range(3) t(i)), ct as (select fold, quantile_disc(laplacian, 0.9) as l, quantile_disc(variation, 0.9) as v from mt join folds on label between train_lo and train_hi group by fold)
    select fold::int as fold, label, count(*) as n from mt join folds on label between train_lo and train_hi join ct using (fold) where laplacian <= l and variation <= v group by fold, label""")
def _(p):
    m = rounded(_metrics(p), 9, "laplacian", "variation").withColumn("label", F.col("label").cast("int"))
    return sketches.drop_noisy_folds(m, folds.period_folds(p.spark, list(range(10)), "rolling", 4, 2), ["laplacian", "variation"], "label", 0.9).groupBy("fold", "label").agg(F.count("*").alias("n"))


@query("a28_describe_ranges", _METRICS + """, r as (select * from (values ('early', 0, 4), ('late', 3, 9)) t(name, lo, hi)), l as (select label, 'laplacian' as "column", laplacian as x from mt union all select label, 'variation', variation from mt)
    select name, "column", count(*) as n, quantile_disc(x, 0.25) as q25, quantile_disc(x, 0.5) as q50, quantile_disc(x, 0.99) as q99 from l join r on label between lo and hi group by name, "column\"""")
def _(p):
    m = rounded(_metrics(p), 9, "laplacian", "variation")
    ranges = p.spark.createDataFrame([("early", 0, 4), ("late", 3, 9)], "name string, lo int, hi int")
    cells = joins.melt(m, ["label"], ["laplacian", "variation"], "column")
    return sketches.range_quantiles(cells, ranges, "x", (0.25, 0.5, 0.99), "label", ["column"]).withColumnsRenamed({"q0": "q25", "q1": "q50", "q2": "q99"})


@query("g9_pca_denoise")
def _(p):
    s = _surface(p).select("vec_id", "label", "a")
    return rounded(A.pca_denoise(s.filter("label < 5"), s, "a", 5).groupBy("label").agg(F.avg("recon_rmse").alias("recon_rmse")), 4)


@query("g9_denoise_folds", """with c as (select vec_id, label, (select avg(x) from (select unnest(embedding)::double as x)) as c1, (select stddev_pop(x) from (select unnest(embedding)::double as x)) as c2 from {embeddings}),
    folds as (select i as fold, 0 as train_lo, 2 * i + 3 as train_hi, 2 * i + 4 as test_lo, 2 * i + 5 as test_hi from range(3) t(i)),
    f as (select fold, avg(c1) as m1, avg(c2) as m2, stddev_pop(c1) as s1, stddev_pop(c2) as s2, case when corr(c1, c2) < 0 then -1 else 1 end as sg from c join folds on label between train_lo and train_hi group by fold),
    z as (select vec_id, fold, c1, c2, m1, m2, s1, s2, sg, ((c1 - m1) / s1 + sg * (c2 - m2) / s2) / 2 as w from c join folds on label between test_lo and test_hi join f using (fold))
    select vec_id, fold::int as fold, round(m1 + s1 * w, 6) as level, round(m2 + s2 * sg * w, 6) as dispersion, round(sqrt(((c1 - m1 - s1 * w) ** 2 + (c2 - m2 - s2 * sg * w) ** 2) / 2), 6) as recon_rmse from z""")
def _(p):
    pairs = _surface(p).select("vec_id", F.col("label").cast("int").alias("label"), X.surface_stats(F.col("a")).alias("s")).select("vec_id", "label", F.array("s.level", "s.dispersion").alias("a"))
    schedule = folds.period_folds(p.spark, list(range(10)), "expanding", 4, 2)
    out = A.denoise_folds(pairs, schedule, "a", 2, 1, "label")
    return rounded(out.select("vec_id", "fold", F.col("a_low")[0].alias("level"), F.col("a_low")[1].alias("dispersion"), "recon_rmse"))


@query("g10_impute_cells", _S + """, h as (select vec_id, label, i, case when (vec_id + i) % 11 <> 0 then x end as x from e), m as (select label, i, quantile_cont(x, 0.5) as m from h where x is not null group by label, i) select vec_id, round(sum(coalesce(x, m)), 6) as total from h left join m using (label, i) group by vec_id""")
def _(p):
    holes = F.transform("a", lambda x, i: F.when((F.col("vec_id") + i + 1) % 11 != 0, x))
    s = _surface(p).withColumn("a", holes)
    return rounded(A.impute_cells(s, "a", "label").select("vec_id", X.array_sum(F.col("a")).alias("total")))


@query("g11_image_metrics", _GRID + """, b as (select vec_id, r, c, (x > 0.1)::int as w from e), k as (select vec_id, avg((s = 0)::int) as blank from (select vec_id, c, sum(case when r < 6 then w end) as s from b group by vec_id, c) group by vec_id), l as (select vec_id, avg((s > 0)::int) as extent from (select vec_id, r, sum(w) as s from b where r < 6 group by vec_id, r) group by vec_id)
    select vec_id, round(avg(w), 6) as white, round(sum(case when r < 6 then w end) / 48, 6) as price_white, round(any_value(blank), 6) as blank_columns, round(any_value(extent), 6) as extent, round(sum(case when r >= 6 then w end) / (sum(case when r < 6 then w end) + 1e-9), 4) as balance from b join k using (vec_id) join l using (vec_id) group by vec_id""")
def _(p):
    image = F.transform("a", lambda x: (x > 0.1).cast("int").cast("double"))
    out = _surface(p).select("vec_id", X.image_metrics(image, 8, 8, 6, 2).alias("m")).select("vec_id", "m.*")
    return rounded(rounded(out, 4, "balance"), 6, "white", "price_white", "blank_columns", "extent")


@query("g11_despeckle", _GRID + """, b as (select vec_id, r, c, (x > 0.15)::int as w from e), n as (select a.vec_id, a.r, a.c, any_value(a.w) as w, sum(b.w) - any_value(a.w) as near from b a join b b on b.vec_id = a.vec_id and abs(b.r - a.r) + abs(b.c - a.c) <= 1 group by a.vec_id, a.r, a.c)
    select vec_id, cast(sum(case when near > 0 then w else 0 end) as int) as white from n group by vec_id""")
def _(p):
    image = F.transform("a", lambda x: (x > 0.15).cast("int").cast("double"))
    return _surface(p).select("vec_id", X.array_sum(X.despeckle(image, 8, 8)).cast("int").alias("white"))


@query("g12_append_strip", """
    with sp as (select min(level) as lo, max(level) as hi from {market} where day <= date '1999-12-31'), sc as (select day, greatest(least((level - lo) / (hi - lo), 1), 0) as x from {market}, sp),
      st as (select day as strip_day, sum(x) over w as total, count(*) over w as k from sc window w as (order by day rows between 7 preceding and current row)),
      r as (select vec_id, date '1999-01-01' + cast(vec_id as int) as day from {embeddings}), j as (select vec_id, day, strip_day, total from r asof join (select * from st where k = 8) s on r.day >= s.strip_day)
    select vec_id, cast(80 as int) as n, round(2 * total, 6) as strip from j where date_diff('day', strip_day, day) <= 7""")
def _(p):
    rows = p["surface"].withColumn("a", F.col("embedding").cast("array<double>")).withColumn("day", F.date_add(F.lit("1999-01-01").cast("date"), F.col("vec_id").cast("int")))
    out = A.append_strip(rows, p["market"], "a", "day", "level", 8, 2, "1999-12-31")
    return rounded(out.select("vec_id", F.size("a").alias("n"), X.array_sum(F.slice("a", 65, 16)).alias("strip")))


@query("w22_xs_normalize", _S + ", z as (select vec_id, (x - avg(x) over w) / nullif(stddev_samp(x) over w, 0) as z from e window w as (partition by label, i)) select vec_id, round(sum(abs(z)), 5) as total from z group by vec_id")
def _(p):
    from ..operators.xsec import xs_normalize_cells

    out = xs_normalize_cells(_surface(p).select("vec_id", "label", "a"), "a", ["vec_id"], ["label"])
    return rounded(out.select("vec_id", X.array_sum(F.transform("a", lambda x: F.abs(x))).alias("total")), 5)


@query("s6_array_panel", "select vec_id, label, date '1999-01-01' + cast(vec_id % 60 as int) as day, true as is_month_end from {embeddings} where false union all select vec_id, label, day, day = max(day) over (partition by label, date_trunc('month', day)) from (select vec_id, label, date '1999-01-01' + cast(vec_id % 60 as int) as day from {embeddings}) x")
def _(p):
    rows = _surface(p).withColumn("day", F.date_add(F.lit("1999-01-01").cast("date"), (F.col("vec_id") % 60).cast("int")))
    flagged = A.read_array_panel(rows.withColumn("entity", F.concat_ws("-", "label", "vec_id")), "a", 64, "entity", "day")
    ends = flagged.select("vec_id", "label", "day").withColumn("is_month_end", F.col("day") == F.max("day").over(W.partitionBy("label", F.trunc("day", "month"))))
    return ends


def _model_panel(p):
    s = p.panel.withColumn("trades", F.col("trades").cast("double"))
    return s.select("security", "qi", "ret", "tax", "trades", "market_cap", "frac_buy", "net_buy", "fwd_1q")


def _folds(p):
    lo, hi = p["stocks"].agg(F.min("qi"), F.max("qi")).first()
    return folds.quarter_folds(p.spark, lo, hi, 16, 6, 6)


@query("m1_folds", """
    with b as (select min(qi) as lo, max(qi) as hi from {stocks}),
      q as (select 'quarter' as kind, i as fold, lo + 6 * i as train_lo, lo + 6 * i + 9 as train_hi, 1 as valid_lo, 0 as valid_hi, lo + 6 * i + 10 as test_lo, lo + 6 * i + 15 as test_hi from b, range(1000) t(i) where lo + 6 * i + 15 <= hi),
      m as (select 'month', i, 3 * lo + 12 * i, 3 * lo + 12 * i + 35, 3 * lo + 12 * i + 36, 3 * lo + 12 * i + 47, 3 * lo + 12 * i + 48, 3 * lo + 12 * i + 59 from b, range(1000) t(i) where 3 * lo + 12 * i + 59 <= 3 * hi),
      p as (select 'period', i, lo + 4 * i, lo + 4 * i + 10, 1, 0, lo + 4 * i + 12, least(lo + 4 * i + 15, hi) from b, range(1000) t(i) where lo + 4 * i + 12 <= hi)
    select kind, cast(fold as int) as fold, cast(train_lo as int) as train_lo, cast(train_hi as int) as train_hi, cast(valid_lo as int) as valid_lo, cast(valid_hi as int) as valid_hi, cast(test_lo as int) as test_lo, cast(test_hi as int) as test_hi from (select * from q union all select * from m union all select * from p) x""")
def _(p):
    lo, hi = p["stocks"].agg(F.min("qi"), F.max("qi")).first()
    months = folds.month_folds(p.spark, lo * 3, hi * 3)
    periods = folds.period_folds(p.spark, list(range(lo, hi + 1)), "rolling", 12, 4, 1)
    return joins.stack([f.withColumn("kind", F.lit(k)) for k, f in (("quarter", _folds(p)), ("month", months), ("period", periods))])


_M2 = ["trades", "tax", "frac_buy"]


@query("m2_walk_forward_ridge", f"with {FOLDS}, " + least_squares_sql("p", "{sql_panel}", "folds", _M2, "fwd_1q", 1.0) + """
    select cast(fold as int) as fold, count(*) as n, round(avg(abs(fwd_1q - y_pred)), 4) as mae, round(sqrt(avg((fwd_1q - y_pred) ** 2)), 4) as rmse, round(1 - sum((fwd_1q - y_pred) ** 2) / nullif(var_pop(fwd_1q) * count(*), 0), 4) as r2, round(stddev_pop(abs(fwd_1q - y_pred)), 4) as std_abs from p where fwd_1q is not null group by fold""")
def _(p):
    out = model.walk_forward(_model_panel(p), _folds(p), _M2, "fwd_1q")
    return rounded(stats.regression_metrics(out, "fwd_1q", "y_pred", ["fold"]), 4)


@query("m2_coefficients", f"with {FOLDS}, " + least_squares_sql("p", "{sql_panel}", "folds", _M2, "fwd_1q", 1.0) + """
    select cast(fold as int) as fold, round(w0 / s0, 9) as trades, round(w1 / s1, 6) as tax, round(w2 / s2, 7) as frac_buy, round(my - w0 * m0 / s0 - w1 * m1 / s1 - w2 * m2 / s2, 7) as intercept from p_w0 join p_m using (fold)""")
def _(p):
    fitted = linear.fit_folds(_model_panel(p), _folds(p), _M2, ["fwd_1q"])
    return fitted.select("fold", *[F.round(F.get("coef", F.lit(i)), d).alias(c) for i, (c, d) in enumerate(zip(_M2, (9, 6, 7)))], F.round("intercept", 7).alias("intercept"))


@query("m4_walk_forward_class")
def _(p):
    x = _model_panel(p).withColumn("label", C.trade_label("fwd_1q", 0.001)).withColumn("can_sell", F.col("trades") > 1)
    out = model.walk_forward_class(x, _folds(p), ["trades", "tax"], "label", "can_sell", trees=5, depth=3)
    return rounded(out.filter("label is not null").groupBy("fold").agg(F.avg((F.col("pred") == F.col("label")).cast("int")).alias("precision"), F.count("*").alias("n")), 4)


@query("m5_har", """with s as (select level, cast(day - date '1995-01-01' as int) as t from {market}),
    h as (select level, t, avg(level) over (order by t rows between 4 preceding and current row) as har_w, avg(level) over (order by t rows between 21 preceding and current row) as har_m, count(*) over (order by t) as k, lead(level, 5) over (order by t) as target, t + 5 as e from s),
    rows_ as (select level as har_d, har_w, har_m, target, t, e from h where k >= 22), edge as (select min(t) as lo, max(t) as hi from s),
    folds as (select 0 as fold, lo as train_lo, lo + (hi - lo) * 2 // 3 - 1 as train_hi, lo + (hi - lo) * 2 // 3 as test_lo, hi as test_hi from edge), """ + least_squares_sql("p", "rows_", "folds", ["har_d", "har_w", "har_m"], "target", 0.0, "t", "e") + """
    select cast(fold as int) as fold, count(*) as n, round(avg(abs(target - y_pred)), 2) as mae, round(sqrt(avg((target - y_pred) ** 2)), 2) as rmse, round(1 - sum((target - y_pred) ** 2) / nullif(var_pop(target) * count(*), 0), 2) as r2, round(stddev_pop(abs(target - y_pred)), 2) as std_abs from p where target is not null group by fold""")
def _(p):
    series = p["market"].select(F.lit("m").alias("k"), "level", F.datediff("day", F.lit("1995-01-01")).alias("t"))
    lo, hi = series.agg(F.min("t"), F.max("t")).first()
    f = folds.period_folds(p.spark, list(range(lo, hi + 1)), "single", (hi - lo) * 2 // 3)
    return rounded(stats.regression_metrics(model.har(series, ["k"], "level", "t", 5, f), "target", "y_pred", ["fold"]), 2)


def _specs_sql(specs: dict, target: str, ret: str, raw=(), alpha: float = 1.0) -> str:
    """CTEs: ``scored`` has spec, is_model, security, qi, y_pred, y and ret of every feature set and of raw characteristics."""
    fits = ", ".join(least_squares_sql(f"p{i}", "{sql_panel}", "folds", own, target, alpha) for i, own in enumerate(specs.values()))
    parts = [f"select '{name}' as spec, true as is_model, security, qi, y_pred, {target} as y, {ret} as ret from p{i}" for i, name in enumerate(specs)]
    parts += [f"select '{r}', false, security, qi, cast({r} as double), {target}, {ret} from p0" for r in raw]
    return f"{fits}, scored as ({' union all '.join(parts)})"


_SCORES = "round(ic, 4) as ic, round(ic_t, 4) as ic_t, round(spread, 4) as spread, round(spread_t, 4) as spread_t, rows, fingerprint"
_M6 = {"size": ["market_cap"], "all": ["trades", "tax", "frac_buy", "net_buy"]}


@query("m6_model_table", f"with {FOLDS}, {_specs_sql(_M6, 'fwd_1q', 'fwd_1q', ['trades'])}, " + score_rows_sql("scored", "spec, is_model") + f" select spec, is_model, {_SCORES} from scores")
def _(p):
    return rounded(model.model_table(_model_panel(p), _folds(p), _M6, "fwd_1q", "fwd_1q", ["trades"]), 4)


_M6_STRATA = ["trades", "ret"]
_SIZED = bucketed_sql("{sql_panel}", "market_cap", 2, "size", "market_cap is not null")


@query("m6_strata", f"with {FOLDS}, b as ({_SIZED}), s as (select security, qi, trades, ret, fwd_1q, cast(size as varchar) as size from b union all select security, qi, trades, ret, fwd_1q, 'all' from b), "
       + ", ".join(least_squares_sql(f"p{i}", "s", "folds", own, "fwd_1q", 1.0, by="size") for i, own in enumerate([_M6_STRATA, *[[f] for f in _M6_STRATA]]))
       + ", scored as (" + " union all ".join(["select size, 'model:all' as spec, true as is_model, security, qi, y_pred, fwd_1q as y, fwd_1q as ret, trades as t, ret as r from p0", *[f"select size, 'model:{f}', true, security, qi, y_pred, fwd_1q, fwd_1q, trades, ret from p{i + 1}" for i, f in enumerate(_M6_STRATA)], *[f"select size, 'raw:{f}', false, security, qi, cast({f} as double), fwd_1q, fwd_1q, trades, ret from p0" for f in _M6_STRATA]])
       + "), whole as (select * from scored where y is not null and t is not null and r is not null), " + score_rows_sql("whole", "size, spec, is_model") + f" select size, 'fwd_1q' as target, spec, is_model, 1 as horizon, periods, {_SCORES} from scores")
def _(p):
    sized = xsec.bucket(p.panel.filter("market_cap is not null").select("security", "qi", "trades", "ret", "market_cap", "fwd_1q"), "market_cap", 2, ["qi"], "security", name="size", complete=True)
    return rounded(model.stratified_table(sized, _folds(p), _M6_STRATA, {"fwd_1q": ("fwd_1q", 1)}, ["size"], min_train=1), 4)


_M7 = {"model": ["trades", "tax", "frac_buy"]}


@query("m7_predict_returns", f"with {FOLDS}, " + ", ".join(least_squares_sql(f"p{h}", "{sql_panel}", "folds", _M7["model"], f"fwd_{h}q", 1.0) for h in (1, 2))
       + ", scored as (" + " union all ".join(f"select 'fwd_{h}q' as target, {h} as h, 'model' as spec, true as is_model, security, qi, y_pred, fwd_{h}q as y, fwd_{h}q as ret from p{h} union all select 'fwd_{h}q', {h}, 'trades', false, security, qi, cast(trades as double), fwd_{h}q, fwd_{h}q from p{h}" for h in (1, 2))
       + "), " + score_rows_sql("scored", "target, spec, is_model", ("case when target = 'fwd_2q' then 1 else 0 end", 1), "case when target = 'fwd_2q' then 2 else 1 end") + f" select target, spec, is_model, {_SCORES} from scores")
def _(p):
    x = p.panel.withColumn("trades", F.col("trades").cast("double"))
    return rounded(model.predict_returns(x, _folds(p), _M7["model"], {"fwd_1q": 1, "fwd_2q": 2}, ["trades"]), 4)


@query("m8_permutation_importance")
def _(p):
    x = model.settled(_model_panel(p).filter("fwd_1q is not null").withColumn("__y", F.col("fwd_1q")))
    fitted = model.feature_pipeline(["trades", "tax", "frac_buy"], model.make_estimator("boosting", maxIter=5)).fit(x.filter("qi < 7995"))
    return rounded(model.permutation_importance(fitted, x.filter("qi >= 7995").drop("__y"), ["trades", "tax", "frac_buy"], "fwd_1q"), 4)


_M8_SCORE = "my + w0 * (f0 - m0) / s0 + w1 * (f1 - m1) / s1 + w2 * (f2 - m2) / s2"


@query("m8_permutation_linear", "with folds as (select 0 as fold, 0 as train_lo, 7994 as train_hi, 7995 as test_lo, 99999 as test_hi), " + least_squares_sql("p", "{sql_panel}", "folds", _M2, "fwd_1q", 1.0) + """,
    r as (select k as rep, security, qi, trades, tax, frac_buy, fwd_1q from {sql_panel}, range(2) t(k) where qi >= 7995 and fwd_1q is not null),
    o as (select *, row_number() over (partition by rep, qi order by md5((3 + rep) || 'a:' || security)) as gives, row_number() over (partition by rep, qi order by md5((3 + rep) || 'b:' || security)) as takes from r),
    d as (select o.rep, o.qi, o.security, o.fwd_1q, o.trades as t0, o.tax as t1, o.frac_buy as t2, g.trades as g0, g.tax as g1, g.frac_buy as g2 from o join o g on o.rep = g.rep and o.qi = g.qi and o.takes = g.gives),
    v as (select '' as feature, rep, qi, fwd_1q, t0 as f0, t1 as f1, t2 as f2 from d where rep = 0 union all select 'trades', rep, qi, fwd_1q, g0, t1, t2 from d union all select 'tax', rep, qi, fwd_1q, t0, g1, t2 from d union all select 'frac_buy', rep, qi, fwd_1q, t0, t1, g2 from d),
    s as (select feature, rep, qi, fwd_1q, """ + _M8_SCORE + " as y_pred from v, p_w0 join p_m using (fold)), ic as (" + ic_sql("s", "feature, rep, qi", "y_pred", "fwd_1q") + """), a as (select feature, avg(x) as ic from (select feature, rep, avg(rank_ic) as x from ic group by feature, rep) y group by feature)
    select a.feature, round(b.ic, 6) as base_ic, round(a.ic, 6) as shuffled_ic, round(b.ic - a.ic, 6) as importance from a, a b where b.feature = '' and a.feature <> ''""")
def _(p):
    x = _model_panel(p).filter("fwd_1q is not null")
    fitted = linear.fit_linear(x.filter("qi < 7995"), _M2, "fwd_1q")
    return rounded(model.permutation_importance(fitted, x.filter("qi >= 7995"), _M2, "fwd_1q", seed=3, repeats=2))


@query("m8_gain_importance")
def _(p):
    boosting = lambda: model.make_estimator("boosting", maxIter=5)
    return rounded(model.gain_importance(_model_panel(p), _folds(p), ["trades", "tax", "frac_buy"], "fwd_1q", boosting), 6)


@query("m3_estimators")
def _(p):
    x, out = model.settled(_model_panel(p)), None
    # the reference boosts by squared error at a rate of 0.06 (turnover_study.py:152, 427); Spark's step counts twice, as its gradient is twice the residual
    for kind, options in (("ridge", {}), ("linear", {}), ("huber", {}), ("boosting", {"lossType": "squared", "stepSize": 0.03}), ("forest", {})):
        scored = model.walk_forward(x, _folds(p), ["trades", "tax"], "fwd_1q", model.learner(kind, **options))
        part = stats.regression_metrics(scored, "fwd_1q", "y_pred").withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return rounded(out, 4)


@query("m3_least_squares", f"with {FOLDS}, " + ", ".join(least_squares_sql(f"p{i}", "{sql_panel}", "folds", ["trades", "tax"], "fwd_1q", alpha) for i, alpha in enumerate((1.0, 0.0)))
       + " " + " union all ".join(f"select '{kind}' as kind, count(*) as n, round(avg(abs(fwd_1q - y_pred)), 5) as mae, round(sqrt(avg((fwd_1q - y_pred) ** 2)), 5) as rmse, round(1 - sum((fwd_1q - y_pred) ** 2) / nullif(var_pop(fwd_1q) * count(*), 0), 5) as r2, round(stddev_pop(abs(fwd_1q - y_pred)), 5) as std_abs from p{i} where fwd_1q is not null" for i, kind in enumerate(("ridge", "linear"))))
def _(p):
    kinds = [stats.regression_metrics(model.walk_forward(_model_panel(p), _folds(p), ["trades", "tax"], "fwd_1q", model.learner(kind)), "fwd_1q", "y_pred").withColumn("kind", F.lit(kind)) for kind in ("ridge", "linear")]
    return rounded(joins.stack(kinds), 5)


_M9 = {"all": ["trades", "tax", "frac_buy", "net_buy", "market_cap"], "without_flow": ["trades", "tax", "market_cap"], "without_size": ["trades", "tax", "frac_buy", "net_buy"]}


@query("m9_ablate", f"with {FOLDS}, {_specs_sql(_M9, 'fwd_1q', 'fwd_1q')}, " + score_rows_sql("scored", "spec, is_model") + f" select spec, is_model, {_SCORES} from scores")
def _(p):
    groups = {"flow": ["frac_buy", "net_buy"], "size": ["market_cap"]}
    return rounded(model.ablate(_model_panel(p), _folds(p), _M9["all"], groups, "fwd_1q", "fwd_1q"), 4)


@query("m10_bucketed_walk_forward", f"with {FOLDS}, src as (select *, cast(ceil(row_number() over (partition by qi order by market_cap, security) * 2 / count(*) over (partition by qi)) - 1 as int) as model_bucket from {{sql_panel}} where fwd_1q is not null and market_cap is not null), " + least_squares_sql("p", "src", "folds", ["trades", "tax"], "fwd_1q", 1.0, by="model_bucket") + " select model_bucket, count(*) as n, round(avg(y_pred), 4) as mean from p group by model_bucket")
def _(p):
    out = model.bucketed_walk_forward(_model_panel(p).filter("fwd_1q is not null"), _folds(p), ["trades", "tax"], "fwd_1q", "market_cap", 2)
    return rounded(out.groupBy("model_bucket").agg(F.count("*").alias("n"), F.avg("y_pred").alias("mean")), 4)


@query("s1_read_holdings", "select cast(fund as varchar) as fund, security, day, cast(inv_type as varchar) as inv_type, shares, position_value, market_cap from {book} where is_us and inv_type = 401")
def _(p):
    root = io.scratch_folder(p.spark)
    raw = p["book"].select(F.concat(F.lit("00"), F.col("fund").cast("string")).alias("LgcyInvestorId"), "day", "security", F.concat(F.col("inv_type").cast("string"), F.lit(".0")).alias("InvTypeCode"), F.when(F.col("is_us"), "yes").otherwise("no").alias("isUs"), F.col("shares").alias("SharesHld"), F.col("position_value").alias("ShsHldVal"), F.col("market_cap").alias("MARKET_CAP"), "tax")
    raw.withColumn("year", F.year("day")).write.partitionBy("year").parquet(root)
    lo, hi = p.spark.read.parquet(root).agg(F.min("year"), F.max("year")).first()
    return io.read_holdings(p.spark, root, [1980, *range(lo, hi + 1)], True, "401", name="year={year}").select("fund", "security", "day", "inv_type", "shares", "position_value", "market_cap")


@query("s2_read_signal", "select make_date(qi // 4, 1, 1) + cast(qi % 4 as int) as date, security as perm_id, case when trades > 1 then tax end as value from {stocks}")
def _(p):
    path = f"{io.scratch_folder(p.spark)}/signals"
    day = F.date_add(F.make_date(F.floor(F.col("qi") / 4).cast("int"), F.lit(1), F.lit(1)), F.col("qi") % 4)
    rows = p["stocks"].select(day.alias("date"), F.concat(F.lit(" "), "security").alias("perm_id"), F.lit("t").alias("trade_id"), F.inline(F.array(F.struct(F.lit("tax").alias("signal_name"), F.when(F.col("trades") > 1, F.col("tax")).otherwise(float("nan")).alias("signal_val")), F.struct(F.lit("ret").alias("signal_name"), F.col("ret").alias("signal_val")))))
    rows.write.option("header", True).csv(path)
    return io.read_signal_csv(p.spark, path, "tax")


@query("s8_read_daily", "select day, security, case when ret * 40 >= -1 then round(ret * 40, 6) end as \"TRET_T1D\", case when turnover - 2 >= 0 then turnover - 2.0 end as turnover_21day, cast(market_cap as double) as market_cap, round(abs(ret), 9) as price from {daily}")
def _(p):
    path = f"{io.scratch_folder(p.spark)}/daily.parquet"
    raw = p["daily"].select(F.col("day").cast("string").alias("Day"), "security", (F.col("ret") * 40).cast("string").alias("tret_t1d"), (F.col("turnover") - 2).alias("turnover_21day"), F.col("market_cap").cast("string").alias("market_cap"), F.col("ret").alias("PRC"), "turnover")
    raw.write.parquet(path)
    return rounded(rounded(io.read_daily(p.spark, path), 6, "TRET_T1D"), 9, "price")


@query("s9_write_results", "select qi, 'wide.csv' as kind, count(*) as n, round(sum(ret), 6) as total from {stocks} group by qi union all select qi, 'parts', count(*), round(sum(tax), 6) from {stocks} group by qi union all select null, 'config', 2, null")
def _(p):
    root = io.scratch_folder(p.spark)
    s = p["stocks"]
    io.write_results({"wide": s.select("security", "qi", "ret")}, f"{root}/csv", "csv")
    io.write_results({"parts": s.select("security", "qi", "tax")}, f"{root}/parquet", partition_by=["qi"])
    io.write_config(p.spark, {"n": 5, "name": "run"}, f"{root}/config")
    wide = p.spark.read.csv(f"{root}/csv/wide", schema="security string, qi int, ret double", header=True).groupBy("qi").agg(F.lit("wide.csv").alias("kind"), F.count("*").alias("n"), F.sum("ret").alias("total"))
    parts = p.spark.read.parquet(f"{root}/parquet/parts").groupBy("qi").agg(F.lit("parts").alias("kind"), F.count("*").alias("n"), F.sum("tax").alias("total"))
    settings = F.from_json("value", "n int, name string")
    config = p.spark.read.text(f"{root}/config").select(F.lit(None).cast("int").alias("qi"), F.lit("config").alias("kind"), F.when((settings["n"] == 5) & (settings["name"] == "run"), F.lit(2)).cast("long").alias("n"), F.lit(None).cast("double").alias("total"))
    return rounded(joins.stack([wide, parts, config]))


@query("s9_panel_layout", "select fund, security, qi, shares, max(shares) over w as shares_lag1 from {dense} window w as (partition by fund, security order by qi range between 1 preceding and 1 preceding)")
def _(p):
    root = io.scratch_folder(p.spark)
    laid = io.write_panel(p["dense"].select("fund", "security", "qi", "shares"), f"panel_{root[-8:]}".replace("-", "_"), ["fund"], "qi", 16, f"{root}/panel")
    return lags.exact_lag(laid, ["fund", "security"], ["shares"])


@query("s3_read_mapped", "select l_orderkey as orderkey, l_linenumber as line, l_quantity as shares, cast(null as double) as market_cap from {lineitem}")
def _(p):
    return io.read_mapped(p["lineitem"], {"L_ORDERKEY": "orderkey", "L_LINENUMBER": "line", "l_quantity": "shares", "cap": "market_cap"}, ["orderkey"], {"market_cap": "double"})


@query("s5_read_glob", "select l_returnflag, count(*) as n, 'lineitem.parquet' as source_file from {lineitem} group by l_returnflag")
def _(p):
    return io.read_glob(p.spark, f"{p.sf_dir}/lineitem.parquet").groupBy("l_returnflag", "source_file").agg(F.count("*").alias("n"))


@query("p4_resolve", "select cast(l_orderkey as bigint) as k, l_quantity as x from {lineitem}")
def _(p):
    df = p["lineitem"]
    return df.select(F.col(clean.resolve(df, "order_id", "L_OrderKey")).cast("long").alias("k"), F.col(clean.resolve(df, "shares", "L_QUANTITY", "quantity")).alias("x"))


@query("w8_feasible", "select fund, security, qi, count(*) over (partition by fund, security order by qi range between 2 preceding and current row) = 3 as feasible from {dense}")
def _(p):
    return lags.feasible(p["dense"].select("fund", "security", "qi"), ["fund", "security"], 3)


@query("s7_check_coverage", "select count(*) as n, min(day) as first, max(day) as last from {market}")
def _(p):
    lo, hi = p["market"].agg(F.min("day"), F.max("day")).first()
    return io.check_coverage(p["market"], "day", str(lo), str(hi)).agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))


@query("x1_compound_windows", "select date_trunc('day', ts) as start, event_type, round(exp(sum(ln(1 + (value - 50) / 10000))) - 1, 6) as ret, count(*) as n from {events} where value is not null group by all")
def _(p):
    rows = p["events"].withColumn("r", (F.col("value") - 50) / 10000)
    return rounded(incremental.stream_compound(rows, "ts", ["event_type"], "r"))


@query("x2_snapshots", "select time_bucket(interval 1 day, ts, timestamp '1970-01-01') as start, user_id, max(ts) as last_ts, max_by(value, struct_pack(a := ts, b := event_id)) as value from {events} group by all")
def _(p):
    return incremental.stream_snapshot(p["events"], "ts", ["user_id"], ["value"], ["event_id"], width="1 day")
