"""Queries of holdings signals, portfolio sorts and inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import holdings as H
from ..operators import lags, sorts, stats, xsec
from ..sources import io
from .queries_basic import bucket_sql
from .registry import query, rounded

def nw_sql(source: str, keys: str, column: str, lags_: int | tuple[str, int] = 0, period: str = "qi") -> str:
    """A SELECT of keys, n, mean, t from a relation, with Bartlett weights; lags may be an expression, with its largest value."""
    by = f"partition by {keys}" if keys else ""
    lag_, most = lags_ if isinstance(lags_, tuple) else (str(lags_), lags_)
    products = "".join(f", (x - m) * lag(x - m, {k}) over ({by} order by {period}) as p{k}" for k in range(1, most + 1))
    total = "sum(e * e)" + "".join(f" + 2 * greatest(1 - {k} / (max(lg) + 1), 0) * coalesce(sum(p{k}), 0)" for k in range(1, most + 1))
    head = f"{keys}, " if keys else ""
    group = f" group by {keys}" if keys else ""
    return f"""select {head}count(*) as n, avg(x) as mean, case when count(*) >= 5 and ({total}) / count(*) / count(*) > 1e-18 then avg(x) / sqrt(({total}) / count(*) / count(*)) end as t
      from (select *, x - m as e{products} from (select {head}{period}, {column} as x, {lag_} as lg, avg({column}) over ({by}) as m from {source} where {column} is not null) a0) a1{group}"""


def spread_sql(panel: str, signal: str, ret: str, n: int = 5, keys: str = "", min_names: int = 20) -> str:
    """A SELECT of the top-less-bottom spread by period: the mean of the last bucket less that of the first."""
    by = f"{keys}, qi" if keys else "qi"
    return f"""select {by}, avg(case when b = {n - 1} then y end) - avg(case when b = 0 then y end) as ret, count(case when b = {n - 1} then 1 end) as n_top, count(case when b = 0 then 1 end) as n_bottom from (
      select *, {bucket_sql('r', 'm', n)} as b from (
        select {by}, {ret} as y, row_number() over (partition by {by} order by {signal}, md5('0:' || security), security) as r, count(*) over (partition by {by}) as m from {panel} where {signal} is not null and {ret} is not null) s0 where m >= {min_names}) s1
      group by {by} having avg(case when b = {n - 1} then y end) - avg(case when b = 0 then y end) is not null"""


def bucketed_sql(panel: str, column: str, n: int, name: str, where: str, keys: str = "qi", id: str = "security") -> str:
    """A SELECT of all columns and an equal-frequency bucket."""
    return f"""select *, {bucket_sql('r_' + name, 'm_' + name, n)} as {name} from (select *, row_number() over (partition by {keys} order by {column}, md5('0:' || {id}), {id}) as r_{name}, count(*) over (partition by {keys}) as m_{name} from {panel} where {where}) b0"""


@query("a1_active_weight", "select fund, security, qi, round(weight, 8) as weight, round(active_weight, 8) as active_weight from {sql_weighted}")
def _(p):
    return rounded(p.weighted.select("fund", "security", "qi", "weight", "active_weight"), 8)


@query("a2_compound_return", """
    select security, round(case when count(*) >= 10 then exp(sum(ln(1 + ret))) - 1 end, 6) as ret, count(*) as days from {daily} where ret is not null group by security""")
def _(p):
    return rounded(H.compound_returns(p["daily"], ["security"], "ret", 10))


@query("a3_forward_returns", "select security, qi, fwd_1q, fwd_2q from {sql_panel}")
def _(p):
    return H.forward_returns(p["stocks"], ["security"], "ret", (1, 2)).select("security", "qi", "fwd_1q", "fwd_2q")


@query("a4_trade_flags", """
    select fund, security, qi, held_now and aw - aw0 > 0 as buy, held_prev and aw - aw0 < 0 as sell, held_now and aw - aw0 > 0 as buy_aw, held_prev and aw - aw0 < 0 as sell_aw, held_now and w - w0 > 0 as buy_w, held_prev and w - w0 < 0 as sell_w,
      held_now and mw - mw0 > 0 as buy_mw, held_prev and mw - mw0 < 0 as sell_mw, held_now and sh - sh0 > 0 as buy_sh, held_prev and sh - sh0 < 0 as sell_sh, held_now and w > 0 as hold_w, held_now and aw > 0 as hold_aw from {sql_grid}""")  # fmt: skip
def _(p):
    flags = H.trade_flags_by(lags.union_grid(p.weighted, "fund", "security", list(H.DEFINITIONS)))
    return flags.select("fund", "security", "qi", "buy", "sell", *[f"{side}_{end}" for end in H.DEFINITIONS.values() for side in ("buy", "sell")], "hold_w", "hold_aw")


@query("a5_breadth", "select security, qi, n_funds, n_active, n_buy, n_sell, n_buy_aw, n_buy_w, n_buy_mw, n_buy_sh, n_funds_w, n_funds_aw, round(n_buy / n_active, 6) as frac_buy, n_buy - n_sell as net_buy from {sql_breadth}")
def _(p):
    return rounded(H.breadth_by_definition(p.weighted))


@query("a6_intensity", """
    with z as (select fund, security, qi, (active_weight - avg(active_weight) over (partition by fund, qi)) / nullif(stddev_samp(active_weight) over (partition by fund, qi), 0) as z from {sql_weighted})
    select security, qi, round(avg(case when z > 1 then 1 else 0 end), 6) as frac_above, sum(case when z > 1 then 1 else 0 end)::bigint as n_above, round(avg(case when abs(z) > 1 then 1 else 0 end), 6) as frac_far,
      round(avg(z), 6) as mean_z, round(sum(z), 6) as sum_z, round(avg(abs(z)), 6) as mean_abs_z, count(z) as n_defined from z group by security, qi""")  # fmt: skip
def _(p):
    return rounded(H.intensity_signals(xsec.zscore(p.weighted, ["active_weight"], ["fund", "qi"]), "active_weight_z"))


@query("a7_own_disp", """
    with b as (select fund, security, qi, market_cap, position_value / market_cap as own, position_value / sum(position_value) over f - market_cap / sum(market_cap) over f as aw from {book} where position_value > 0 and market_cap > 0 window f as (partition by fund, qi)),
      z as (select *, (aw - avg(aw) over f) / nullif(stddev_samp(aw) over f, 0) as z, row_number() over (partition by security, qi order by own desc, fund) as k from b window f as (partition by fund, qi))
    select security, qi, count(*) as n_funds, round(sum(own), 6) as inst_own, round(max(own), 6) as max_own, round(avg(own), 6) as mean_own, round(sum(case when k <= 5 then own end), 6) as top_own, round(sum(own * own), 6) as hhi_own,
      round(stddev_samp(aw), 6) as disp_aw, round(sum(abs(aw)), 6) as sum_abs_aw, round(avg(abs(aw)), 6) as mean_abs_aw, round(stddev_samp(z), 5) as disp_z_aw, max(market_cap) as market_cap, round(stddev_samp(aw) / nullif(avg(abs(aw)), 0), 5) as disp_aw_cv from z group by security, qi""")  # fmt: skip
def _(p):
    out = H.own_disp_signals(p["book"])
    return rounded(rounded(out, 5, "disp_z_aw", "disp_aw_cv"), 6, *[c for c in out.columns if c not in ("security", "qi", "n_funds", "market_cap", "disp_z_aw", "disp_aw_cv")])


@query("a8_pressure", """
    select security, qi, count(*) as n_owning, round(avg((label > 0)::int), 6) as buy_frac, round(avg((label < 0)::int), 6) as sell_frac, round(sum(dollar_flow), 6) as net, round(sum(abs(dollar_flow)), 6) as gross, round(avg(weight_chg), 6) as weight_chg, round(avg(drift_chg), 6) as drift_chg,
      round(sum(case when label > 0 then position_value else 0 end) / nullif(sum(position_value), 0), 6) as dollar_buy_frac, round(sum(dollar_flow) / nullif(abs(max(market_cap)), 0), 6) as flow_cap from {sql_changes} where label is not null group by security, qi""")  # fmt: skip
def _(p):
    return rounded(H.pressure(p.changes))


@query("a9_buy_ratios", """
    select security, qi, round(sum(greatest(dollar_flow, 0)) / nullif(sum(abs(dollar_flow)), 0), 6) as dollar_ratio, round(sum(greatest(weight_chg, 0)) / nullif(sum(abs(weight_chg)), 0), 6) as weight_ratio, count(dollar_flow) as n from {sql_changes} group by security, qi""")
def _(p):
    return rounded(H.buy_ratios(p.changes))


@query("a10_set_pressure", "select security, qi, round(avg((label > 0)::int), 6) as pressure from {sql_changes} where label is not null group by security, qi")
def _(p):
    return rounded(H.set_pressure(H.pressure(p.changes), "buy_frac").select("security", "qi", "pressure"))


@query("a11_block_panel", """
    with b as (select security, qi, fund_size, round(sum(greatest(dollar_flow, 0)) / nullif(sum(abs(dollar_flow)), 0), 6) as dollar_ratio, count(dollar_flow) as n from {sql_changes} group by security, qi, fund_size) select b.*, s.market_cap from b join {stocks} s using (security, qi)""")
def _(p):
    return rounded(H.block_panel(p.changes).select("security", "qi", "fund_size", "dollar_ratio", "n", "market_cap"))


@query("a11_block_counts", """
    select security, qi, count(case when fund_size = 0 then 1 end) as "0", count(case when fund_size = 1 then 1 end) as "1", count(case when fund_size = 2 then 1 end) as "2" from {book} group by security, qi""")
def _(p):
    return H.block_counts(p["book"], "fund_size", [0, 1, 2])


@query("a12_collective_tilt", "select security, qi, round(sum(abs(active_weight)), 6) as tilt from {sql_weighted} group by security, qi")
def _(p):
    return rounded(H.sum_abs_aw(p.weighted))


@query("a13_peer_rates", """
    with l as (select inv_type, qi, case when shares > 30 then 1 when shares < 20 then -1 else 0 end as label from {book}), r as (select inv_type, qi, avg((label = 1)::int) as b, avg((label = -1)::int) as s, avg((label = 0)::int) as h from l group by inv_type, qi),
      c as (select distinct qi from r), f as (select inv_type, min(qi) as f from r group by inv_type), g as (select inv_type, qi from f join c on qi >= f)
    select inv_type, qi + 1 as qi, round(last_value(b ignore nulls) over w, 6) as buy_rate, round(last_value(s ignore nulls) over w, 6) as sell_rate, round(last_value(h ignore nulls) over w, 6) as hold_rate from g left join r using (inv_type, qi) window w as (partition by inv_type order by qi)""")
def _(p):
    label = F.when(F.col("shares") > 30, 1).when(F.col("shares") < 20, -1).otherwise(0)
    return rounded(H.peer_rates(p["book"].withColumn("label", label), "inv_type"))


@query("a14_fund_return", """
    select fund, qi, round(sum(case when qi % 5 <> 0 or fund % 2 = 0 then weight * ret end) / nullif(sum(case when qi % 5 <> 0 or fund % 2 = 0 then weight end), 0), 6) as fund_ret, count(case when qi % 5 <> 0 or fund % 2 = 0 then ret end) as n_ret from {sql_weighted} group by fund, qi""")
def _(p):
    known = F.when((F.col("qi") % 5 != 0) | (F.col("fund") % 2 == 0), F.col("ret"))
    return rounded(H.fund_return(p.weighted.withColumn("ret", known)))


@query("a15_abnormal", "select fund, security, qi, round(ret - avg(ret) over (partition by inv_type, qi), 8) as abnormal from {book}")
def _(p):
    return rounded(stats.abnormal(p["book"], "ret", ["inv_type", "qi"]).select("fund", "security", "qi", "abnormal"), 8)


_LABELS = "select fund, security, qi, case when shares > 30 then 1 when shares < 20 then -1 else 0 end as y, case when position_value > 30000 then 1 when position_value < 15000 then -1 else 0 end as pred from {holdings}"


def _labels(p):
    return p["holdings"].select("fund", "security", "qi", F.when(F.col("shares") > 30, 1).when(F.col("shares") < 20, -1).otherwise(0).alias("y"), F.when(F.col("position_value") > 30000, 1).when(F.col("position_value") < 15000, -1).otherwise(0).alias("pred"))


@query("a16_naive_class", f"""
    with l as ({_LABELS}), c as (select fund, y, count(*) as n from l group by fund, y) select fund, y as naive from (select fund, y, row_number() over (partition by fund order by n desc, y) as k from c) where k = 1""")
def _(p):
    return stats.naive_class(_labels(p), "y", "fund")


@query("a17_precision", f"""
    with l as ({_LABELS}), f as (select qi, fund, sum((y = pred)::int) as h, count(*) as n from l group by qi, fund) select qi, round(sum(h) / sum(n), 6) as pooled, round(avg(h / n), 6) as fund_average, count(*) as funds, sum(n)::bigint as rows from f group by qi""")
def _(p):
    return rounded(stats.precision_report(_labels(p), "y", "pred", "fund", ["qi"]))


@query("a18_corr_pearson", "select 'ret' as a, 'tax' as b, round(corr(ret, tax), 6) as corr from {stocks} union all select 'ret', 'market_cap', round(corr(ret, market_cap), 6) from {stocks} union all select 'tax', 'market_cap', round(corr(tax, market_cap), 6) from {stocks}")
def _(p):
    return rounded(stats.corr_matrix(p["stocks"], ["ret", "tax", "market_cap"]))


@query("a18_corr_spearman", """
    with r as (select rank() over (order by ret) + (count(*) over (partition by ret) - 1) / 2 as a, rank() over (order by trades) + (count(*) over (partition by trades) - 1) / 2 as b, rank() over (order by tax) + (count(*) over (partition by tax) - 1) / 2 as c from {stocks})
    select 'ret' as a, 'trades' as b, round(corr(a, b), 6) as corr from r union all select 'ret', 'tax', round(corr(a, c), 6) from r union all select 'trades', 'tax', round(corr(b, c), 6) from r""")
def _(p):
    return rounded(stats.corr_matrix(p["stocks"], ["ret", "trades", "tax"], "spearman"))


@query("a19_missing_report", """
    with x as (select qi, fwd_1q, fwd_2q from {sql_panel}) select qi, count(*) as n, 'fwd_1q' as "column", count(*) - count(fwd_1q) as missing, round((count(*) - count(fwd_1q)) / count(*), 6) as share from x group by qi
    union all select qi, count(*), 'fwd_2q', count(*) - count(fwd_2q), round((count(*) - count(fwd_2q)) / count(*), 6) from x group by qi""")
def _(p):
    return rounded(stats.missing_report(H.forward_returns(p["stocks"], ["security"], "ret", (1, 2)), ["fwd_1q", "fwd_2q"], ["qi"]))


@query("a19_missing_by_bucket", "with b as (" + bucketed_sql("{sql_panel}", "trades", 10, "bucket", "trades is not null") + """), l as (select bucket, 'fwd_1q' as "column", fwd_1q as x from b union all select bucket, 'fwd_2q', fwd_2q from b)
    select bucket, "column", count(*) as n, count(*) - count(x) as missing, round((count(*) - count(x)) / count(*), 6) as share from l group by bucket, "column" """)
def _(p):
    return rounded(stats.missing_by_bucket(H.forward_returns(p["stocks"], ["security"], "ret", (1, 2)), "trades", ["fwd_1q", "fwd_2q"]))


@query("a19_partial_periods", """
    with d as (select security, year(day) * 12 + month(day) as m, count(*) as days from {daily} where ret is not null group by all)
    select quantile_cont(days, 0.5)::double as median_days, round(avg((days < 20)::int), 6) as under_stub, round(avg((days < 40)::int), 6) as under_short, count(case when days < 20 then 1 end) as stubs from d""")
def _(p):
    d = p["daily"].withColumn("m", F.year("day") * 12 + F.month("day"))
    return rounded(stats.partial_periods(H.compound_returns(d, ["security", "m"], "ret")))


@query("a20_bucket_balance", "with b as (" + bucketed_sql("{stocks}", "trades", 5, "bucket", "true") + """), k as (select qi, bucket, count(*) as k from b group by qi, bucket), d as (select qi, count(distinct trades) as distinct_values from {stocks} group by qi)
    select qi, count(*) as buckets, round(min(k) / sum(k), 6) as min_share, round(max(k) / sum(k), 6) as max_share, any_value(distinct_values) as distinct_values from k join d using (qi) group by qi""")
def _(p):
    return rounded(stats.bucket_balance(xsec.bucket(p["stocks"], "trades", 5, ["qi"], "security"), "bucket", "trades", ["qi"]))


@query("a21_period_mean", "with m as (select inv_type, qi, avg(ret) as m from {book} group by inv_type, qi), s as (" + nw_sql("m", "inv_type", "m", 2) + ") select inv_type, n, round(mean, 8) as mean, round(t, 4) as t from s")
def _(p):
    return rounded(rounded(stats.period_mean(p["book"], ["inv_type"], "ret", lags=2), 8, "mean"), 4, "t")


@query("a22_matrix", """select qi, round(avg(case when fund_size = 0 then shares end), 6) as "0", round(avg(case when fund_size = 1 then shares end), 6) as "1", round(avg(case when fund_size = 2 then shares end), 6) as "2" from {book} group by qi""")
def _(p):
    return rounded(stats.matrix(p["book"], "qi", "fund_size", [0, 1, 2], F.avg("shares")))


@query("a23_fingerprint", "select count(*) as rows, (sum(('0x' || substr(md5(fund || '|' || security || '|' || qi), 1, 8))::bigint) % 4294967296)::bigint as fingerprint from {holdings}")
def _(p):
    return stats.fingerprint(p["holdings"], ["fund", "security", "qi"])


@query("a24_bin_summary", "select (shares > 10)::int + (shares > 20)::int + (shares > 35)::int as bin, count(*) as n, round(avg(position_value), 4) as mean, round(stddev_samp(position_value), 4) as std from {holdings} group by 1")
def _(p):
    return rounded(stats.bin_summary(p["holdings"], "shares", [10, 20, 35], "position_value"), 4)


@query("a25_samples", "select 'all' as sample, count(*) as n, round(avg(ret), 8) as ret from {stocks} union all select case when qi < 7995 then 'discovery' else 'validation' end, count(*), round(avg(ret), 8) from {stocks} group by 1")
def _(p):
    return rounded(stats.with_samples(p["stocks"], F.col("qi") < 7995).groupBy("sample").agg(F.count("*").alias("n"), F.avg("ret").alias("ret")), 8)


@query("a28_describe_by", """
    with l as (select qi, 'ret' as "column", ret as x from {stocks} union all select qi, 'trades', trades from {stocks})
    select qi, "column", count(x) as count, round(count(x) / count(*), 6) as share, round(avg(x), 6) as mean, round(stddev_samp(x), 6) as sd, round(quantile_cont(x, 0.05), 6) as p5, round(quantile_cont(x, 0.5), 6) as p50, round(quantile_cont(x, 0.95), 6) as p95 from l group by qi, "column" """)
def _(p):
    return rounded(stats.describe_by(p["stocks"], ["qi"], ["ret", "trades"]))


@query("s10_data_check", """
    select count(*) as rows, count(distinct security) as entities, min(day) as first, max(day) as last, count(*) - count(distinct (security, day)) as duplicates, round(avg((ret is null)::int), 12) as ret_null, round(avg((ret < 0)::int), 12) as ret_negative, round(avg(ret), 12) as ret_mean, round(stddev_samp(ret), 12) as ret_sd,
      round(quantile_cont(ret, 0.01), 12) as ret_p1, round(quantile_cont(ret, 0.5), 12) as ret_median, round(quantile_cont(ret, 0.99), 12) as ret_p99 from {daily}""")
def _(p):
    return rounded(stats.data_check(p["daily"], "security", "day", ["ret"], exact=True), 12)


@query("s10_target_coverage", """
    with l as (select strftime(day, '%Y-%m') as m, security, 'ret' as target, case when security % 7 <> 0 then ret end as x from {daily} union all select strftime(day, '%Y-%m'), security, 'turnover', turnover::double from {daily}),
      k as (select target, m, count(distinct security) as k from l where x is not null group by target, m), b as (select min(m) as lo, max(m) as hi from l)
    select t.target, t.n, round(t.null_share, 6) as null_share, s.median_names, s.least_names, s.periods, s.enough from (select target, count(x) as n, avg((x is null)::int) as null_share from l group by target) t
      join (select target, quantile_cont(k, 0.5)::double as median_names, min(k) as least_names, count(case when m >= '1998-01' and m < '2030-01' then 1 end) as periods, count(case when m >= '1998-01' and m < '2030-01' and k >= 100 then 1 end) as enough from k group by target) s using (target)""")  # fmt: skip
def _(p):
    d = p["daily"].withColumn("ret", F.when(F.col("security") % 7 != 0, F.col("ret")))
    return rounded(stats.target_coverage(d, ["ret", "turnover"], "security", F.date_format("day", "yyyy-MM"), 50, "1998-01", "2030-01"))


@query("s10_coverage_by_month", "select strftime(day, '%Y-%m') as month, count(*) as n, count(*) >= 200 as enough from {daily} group by 1")
def _(p):
    return stats.coverage_by_month(p["daily"], "day", 100)


@query("e1_decile_spread", "with s as (" + spread_sql("{sql_panel}", "frac_buy", "fwd_1q") + ") select qi, round(ret, 8) as ret, n_top, n_bottom from s")
def flagship(p):
    return rounded(sorts.decile_spread(p.panel, "frac_buy", "fwd_1q"), 8)


@query("e1_size_neutral_spread", "with z as (" + bucketed_sql("{sql_panel}", "market_cap", 3, "sz", "net_buy is not null and fwd_1q is not null and market_cap is not null") + "), m as (select *, count(*) over (partition by qi) as names from z), s as (" + spread_sql("(select * from m where names >= 20)", "net_buy", "fwd_1q", keys="sz") + ") select qi, round(avg(ret), 8) as ret, sum(n_top)::bigint as n_top, sum(n_bottom)::bigint as n_bottom from s group by qi")
def _(p):
    return rounded(sorts.decile_spread(p.panel, "net_buy", "fwd_1q", size="market_cap"), 8)


@query("e2_newey_west", "with s as (" + spread_sql("{sql_panel}", "trades", "fwd_1q") + "), t as (" + nw_sql("s", "", "ret", 3) + ") select n, round(mean, 8) as mean, round(t, 4) as t from t")
def _(p):
    return rounded(rounded(stats.newey_west(sorts.decile_spread(p.panel, "trades", "fwd_1q"), [], "ret", 3), 8, "mean"), 4, "t")


_PERF = """select {k}n, round(mean, 8) as mean, round(t, 4) as t, round(mean / (nullif(sd, 0) / sqrt(n)), 4) as t_naive, round(hit, 6) as hit, round(mean * {ann}, 6) as ann_ret, round(sd * sqrt({ann}), 6) as ann_vol, round(mean / nullif(sd, 0) * sqrt({ann}), 4) as sharpe,
  round(case when w > 0 then pow(w, {ann} / n) - 1 end, 6) as geo, round(w - 1, 6) as cum, round(max_dd, 6) as max_dd"""


def perf_sql(source: str, keys: str, ann: float = 4.0, period: str = "qi", lags_: int | tuple[str, int] = 0, least: int = 8) -> str:
    """Common table expressions and a SELECT of the performance record of a relation with column ret (keys as column names)."""
    by, head = (f"partition by {keys}", f"{keys}, ") if keys else ("", "")
    join = f"join nw using ({keys})" if keys else ", nw"
    group = f"group by {keys}" if keys else ""
    return f"""g as (select *, exp(sum(ln(1 + ret)) over ({by} order by {period})) as wealth from {source}), d as (select *, wealth / max(wealth) over ({by} order by {period}) - 1 as dd from g),
      a as (select {head}avg((ret > 0)::int) as hit, stddev_samp(ret) as sd, exp(sum(ln(1 + ret))) as w, min(dd) as max_dd from d {group}), nw as ({nw_sql(source, keys, 'ret', lags_, period)})
    {_PERF.format(k=head, ann=ann)} from a {join} where n >= {least}"""


def perf(df):
    """The performance record rounded as its oracle is; only strategies with figures."""
    return rounded(rounded(rounded(df.filter("mean is not null"), 8, "mean"), 4, "t", "t_naive", "sharpe"), 6, "hit", "ann_ret", "ann_vol", "geo", "cum", "max_dd")


@query("e3_performance", "with s as (" + spread_sql("{sql_panel}", "frac_buy", "fwd_1q") + "), " + perf_sql("s", ""))
def _(p):
    return perf(stats.performance(sorts.decile_spread(p.panel, "frac_buy", "fwd_1q"), [], "ret", 4.0))


@query("e4_evaluate", """
    with l as (select security, qi, unnest([{'signal': 'frac_buy', 'x': frac_buy}, {'signal': 'trades', 'x': trades::double}], recursive := true), fwd_1q, fwd_2q from {sql_panel}), m as (select security, qi, signal, x, 'fwd_1q' as horizon, fwd_1q as y from l union all select security, qi, signal, x, 'fwd_2q', fwd_2q from l),
    s as (""" + spread_sql("m", "x", "y", keys="signal, horizon") + "), s2 as (select *, 'all' as sample from s union all select *, case when qi < 7995 then 'discovery' else 'validation' end from s), " + perf_sql("s2", "signal, horizon, sample", lags_=("case when horizon = 'fwd_2q' then 1 else 0 end", 1)))
def _(p):
    return perf(sorts.evaluate(p.panel, ["frac_buy", "trades"], ["fwd_1q", "fwd_2q"], F.col("qi") < 7995))


_CELLS = """with l as (select security, qi, net_buy::double as x, fwd_1q as y, market_cap as cap, tie, size_groups, nonzero, missing from {sql_panel}, (values %s) t(tie), (values (1), (3)) k(size_groups), (values (true), (false)) z(nonzero), (values ('drop'), ('zero')) m(missing)
      where net_buy is not null and (missing = 'zero' or fwd_1q is not null) and (not nonzero or net_buy <> 0)),
    c as (select security, qi, x, coalesce(y, 0) as y, case when size_groups = 1 then 0 else cap end as cap, tie, size_groups, nonzero, missing from l where size_groups = 1 or cap is not null),
    """  # fmt: skip
_CELL = "tie, size_groups, nonzero, missing"


def _split_sql(source: str, column: str, name: str, keys: str, n: str) -> str:
    order = f"order by {column}, case when tie = 'random' then md5('0:' || security) end, security"
    return f"select *, {bucket_sql('r_' + name, 'm_' + name, n)} as {name} from (select *, row_number() over (partition by {keys} {order}) as r_{name}, count(*) over (partition by {keys}) as m_{name} from {source}) q"


_SWEPT = f"""m as (select {_CELL}, qi, sz, b, avg(y) as m, count(*) as k from y group by all), gg as (select {_CELL}, qi, sz, max_by(m, b) - min_by(m, b) as ret from m group by all having count(*) >= 2 and sum(k) >= 20), s as (select {_CELL}, qi, avg(ret) as ret from gg group by all), """


@query("e5_sweep", _CELLS % "('random'), ('first')" + "x as (" + _split_sql("c", "cap", "sz", f"{_CELL}, qi", "size_groups") + "), y as (" + _split_sql("x", "x", "b", f"{_CELL}, qi, sz", "5") + "), " + _SWEPT + perf_sql("s", _CELL))
def _(p):
    return perf(sorts.sweep(p.panel, "net_buy", "fwd_1q", ties=("random", "first")))


def _average_sql(source: str, column: str, name: str, keys: str, n: int) -> str:
    """A SELECT of all columns and the bucket of average ranks, cut at their percentiles, distinct cuts only."""
    ranks = f"select *, rank() over (partition by {keys} order by {column}) + (count(*) over (partition by {keys}, {column}) - 1) / 2 as r_{name} from {source}"
    edges = f"select *, list_transform(quantile_cont(r_{name}, [{', '.join(f'{i}/{n}' for i in range(n + 1))}]) over (partition by {keys}), lambda e: round(e, 6)) as e_{name} from ({ranks}) q0"
    return f"select *, len(list_filter(list_distinct(e_{name}), lambda e: e > list_min(e_{name}) and e < list_max(e_{name}) and e < r_{name}))::int as {name} from ({edges}) q1"


@query("e5_sweep_average", _CELLS % "('average')" + "".join(f"x{k} as (" + _average_sql(f"(select * from c where size_groups = {k})", "cap", "sz", f"{_CELL}, qi", k) + "), " for k in (1, 3)) + "y as (" + _average_sql("(select * from x1 union all select * from x3)", "x", "b", f"{_CELL}, qi, sz", 5) + "), " + _SWEPT + perf_sql("s", _CELL))
def _(p):
    return perf(sorts.sweep(p.panel, "net_buy", "fwd_1q", ties=("average",)))


@query("e5_sweep_verdict", _CELLS % "('random'), ('first')" + "x as (" + _split_sql("c", "cap", "sz", f"{_CELL}, qi", "size_groups") + "), y as (" + _split_sql("x", "x", "b", f"{_CELL}, qi, sz", "5") + "), " + _SWEPT + "r as (" + nw_sql("s", _CELL, "ret") + """), v as (select t from r where n >= 8)
    select count(t) as cells, count(case when abs(t) >= 2 then 1 end) as significant, count(case when t > 0 then 1 end) as positive, count(case when t < 0 then 1 end) as negative, count(case when t > 0 then 1 end) = count(t) or count(case when t < 0 then 1 end) = count(t) as agree from v""")
def _(p):
    return sorts.sweep_verdict(sorts.sweep(p.panel, "net_buy", "fwd_1q", ties=("random", "first")))


@query("e5_sweep_definitions", """
    with l as (select b.security, b.qi, p.fwd_1q as y, d.definition, d.k / b.n_active as x from {sql_breadth} b join {sql_panel} p using (security, qi), unnest([{'definition': 'active_weight', 'k': n_buy_aw}, {'definition': 'weight', 'k': n_buy_w}, {'definition': 'market_weight', 'k': n_buy_mw}, {'definition': 'shares', 'k': n_buy_sh}]) u(d)),
    s as (""" + spread_sql("l", "x", "y", keys="definition") + "), " + perf_sql("s", "definition"))
def _(p):
    stocks = H.forward_returns(p["stocks"], ["security"], "ret", (1,)).select("security", "qi", "fwd_1q")
    return perf(sorts.sweep_definitions(p.weighted, H.DEFINITIONS, stocks, "fwd_1q"))


@query("e6_combine_signal", """
    with z as (select security, qi, (frac_buy - avg(frac_buy) over w) / nullif(stddev_samp(frac_buy) over w, 0) as a, (ret - avg(ret) over w) / nullif(stddev_samp(ret) over w, 0) as b from {sql_panel} window w as (partition by qi)) select security, qi, round(a + 0.5 * b, 6) as combined from z""")
def _(p):
    return rounded(stats.combine_signal(p.panel, {"frac_buy": 1.0, "ret": 0.5}, ["qi"]).select("security", "qi", "combined"))


@query("e6_combine_returns", "with a as (" + spread_sql("{sql_panel}", "frac_buy", "fwd_1q") + "), b as (" + spread_sql("{sql_panel}", "trades", "fwd_1q") + ") select a.qi, round(0.5 * a.ret + 0.5 * b.ret, 8) as ret from a join b using (qi)")
def _(p):
    parts = [sorts.decile_spread(p.panel, s, "fwd_1q").withColumn("strategy", F.lit(s)) for s in ("frac_buy", "trades")]
    return rounded(stats.combine_returns(parts[0].unionByName(parts[1]), "strategy", "ret", {"frac_buy": 0.5, "trades": 0.5}), 8)


@query("e8_conditional_sort", "with c as (" + bucketed_sql("{sql_panel}", "market_cap", 3, "cond", "market_cap is not null and trades is not null and fwd_1q is not null") + "), s as (" + spread_sql("c", "trades", "fwd_1q", keys="cond") + "), " + perf_sql("s", "cond"))
def _(p):
    return perf(sorts.conditional_sort(p.panel, "trades", "market_cap", "fwd_1q"))


_BUCKET_TABLE = "with b as (" + bucketed_sql("{sql_panel}", "trades", 5, "bucket", "trades is not null and fwd_1q is not null") + "), m as (select bucket, qi, avg(fwd_1q) as m from b group by bucket, qi), s as (" + nw_sql("m", "bucket", "m") + ")"


@query("e8_bucket_table", _BUCKET_TABLE + " select bucket, n, round(mean, 8) as mean, round(t, 4) as t from s")
def _(p):
    return rounded(rounded(sorts.bucket_table(p.panel, "trades", "fwd_1q"), 8, "mean"), 4, "t")


@query("e8_monotonicity", _BUCKET_TABLE + " select round(corr(a, b), 6) as rho, count(*) as n from (select rank() over (order by bucket) as a, rank() over (order by t) as b from s)")
def _(p):
    return rounded(sorts.monotonicity(sorts.bucket_table(p.panel, "trades", "fwd_1q")))


@query("e9_double_sort", "with x as (" + bucketed_sql("{sql_panel}", "trades", 3, "a", "trades is not null and ret is not null and fwd_1q is not null") + "), y as (" + bucketed_sql("x", "ret", 3, "b", "true") + """), c as (select a, b, qi, avg(fwd_1q) as m from y group by a, b, qi),
    e as (select * from c union all select -1, b, qi, max(case when a = 2 then m end) - max(case when a = 0 then m end) from c group by b, qi union all select a, -1, qi, max(case when b = 2 then m end) - max(case when b = 0 then m end) from c group by a, qi), s as (""" + nw_sql("e", "a, b", "m") + ") select a, b, n, round(mean, 8) as mean, round(t, 4) as t from s")
def _(p):
    return rounded(rounded(sorts.double_sort(p.panel, "trades", "ret", "fwd_1q"), 8, "mean"), 4, "t")


@query("e10_strategy_spread", "with c as (" + bucketed_sql("{sql_panel}", "market_cap", 3, "cond", "market_cap is not null") + "), s as (" + spread_sql("(select * from c where cond = 2)", "trades", "fwd_1q", min_names=10) + ") select qi, round(ret, 8) as ret, n_top, n_bottom from s")
def _(p):
    return rounded(sorts.strategy_spread(p.panel, "trades", "fwd_1q", "market_cap", 2), 8)


@query("e10_report_strategy", "with c as (" + bucketed_sql("{sql_panel}", "market_cap", 3, "cond", "market_cap is not null") + "), s as (" + spread_sql("(select * from c where cond = 2)", "trades", "fwd_1q", min_names=10) + "), s2 as (select *, 'all' as sample from s union all select *, case when qi < 7995 then 'discovery' else 'validation' end from s), f as (select sample, min(qi) as \"first\", max(qi) as \"last\" from s2 group by sample), r as (with " + perf_sql("s2", "sample", lags_=1) + ") select 'large' as strategy, f.*, r.* exclude (sample) from r join f using (sample)")
def _(p):
    spread = sorts.strategy_spread(p.panel, "trades", "fwd_1q", "market_cap", 2)
    return perf(sorts.report_strategy(spread, F.col("qi") < 7995, 2, "large"))


_IC = """with r as (select qi, trades, fwd_1q, rank() over (partition by qi order by trades) + (count(*) over (partition by qi, trades) - 1) / 2 as a, rank() over (partition by qi order by fwd_1q) + (count(*) over (partition by qi, fwd_1q) - 1) / 2 as b from {sql_panel} where trades is not null and fwd_1q is not null),
    ic as (select qi, count(*) as n, case when count(*) >= 10 and stddev_samp(trades) > 0 and stddev_samp(fwd_1q) > 0 then corr(a, b) end as rank_ic, case when count(*) >= 10 and stddev_samp(trades) > 0 and stddev_samp(fwd_1q) > 0 then corr(trades, fwd_1q) end as pearson_ic from r group by qi)"""


@query("e11_information_coefficient", _IC + " select qi, n, round(rank_ic, 6) as rank_ic, round(pearson_ic, 6) as pearson_ic from ic")
def _(p):
    return rounded(stats.information_coefficient(p.panel, "trades", "fwd_1q", ["qi"]))


@query("e11_ic_summary", _IC + ", s as (" + nw_sql("ic", "", "rank_ic", 1) + ") select s.n, round(mean, 6) as mean, round(t, 4) as t, round(mean / (select stddev_samp(rank_ic) from ic), 4) as icir from s")
def _(p):
    return rounded(rounded(stats.ic_summary(stats.information_coefficient(p.panel, "trades", "fwd_1q", ["qi"]), [], lags=1), 6, "mean"), 4, "t", "icir")


@query("e12_alpha_sort", """with l as (select security, qi, trades, 'fwd_1q' as timing, fwd_1q as y from {sql_panel} union all select security, qi, trades, 'fwd_2q', fwd_2q from {sql_panel}), b as (""" + bucketed_sql("l", "trades", 5, "bucket", "y is not null and trades is not null", "timing, qi") + """), m as (select timing, bucket, qi, avg(y) as m from b group by timing, bucket, qi),
    e as (select * from m union all select timing, -1, qi, max(case when bucket = 4 then m end) - max(case when bucket = 0 then m end) from m group by timing, qi), s as (""" + nw_sql("e", "timing, bucket", "m") + ") select timing, bucket, n, round(mean, 8) as mean, round(t, 4) as t from s")
def _(p):
    return rounded(rounded(sorts.alpha_sort(p.panel, "trades", ["fwd_1q", "fwd_2q"]), 8, "mean"), 4, "t")


@query("e13_score_row", _IC + ", ics as (" + nw_sql("ic", "", "rank_ic") + "), sp as (" + spread_sql("{sql_panel}", "trades", "fwd_1q") + "), sps as (" + nw_sql("sp", "", "ret") + """), f as (select count(*) as rows, (sum(('0x' || substr(md5(security || '|' || qi), 1, 8))::bigint) % 4294967296)::bigint as fingerprint from {sql_panel} where trades is not null and fwd_1q is not null)
    select round(ics.mean, 6) as ic, round(ics.t, 4) as ic_t, round(sps.mean, 8) as spread, round(sps.t, 4) as spread_t, rows, fingerprint from ics, sps, f""")
def _(p):
    return rounded(rounded(rounded(sorts.score_row(p.panel, "trades", "fwd_1q", "fwd_1q"), 6, "ic"), 8, "spread"), 4, "ic_t", "spread_t")


@query("e14_beats_naive", """
    with q as (select security, corr(trades, ret) as a, corr(trades, tax) as b from {stocks} group by security) select security as target, 'model' as best_model, round(abs(a), 6) as model_ic, 'raw' as best_raw, round(abs(b), 6) as raw_ic, abs(a) > abs(b) as beats from q where abs(a) > 0.001 and abs(b) > 0.001""")
def _(p):
    q = p["stocks"].groupBy("security").agg(F.corr("trades", "ret").alias("a"), F.corr("trades", "tax").alias("b")).filter("abs(a) > 0.001 and abs(b) > 0.001")
    t = q.select(F.col("security").alias("target"), F.inline(F.array(F.struct(F.lit("model").alias("name"), F.col("a").alias("ic"), F.lit(True).alias("is_model")), F.struct(F.lit("raw").alias("name"), F.col("b").alias("ic"), F.lit(False).alias("is_model")))))
    return rounded(stats.beats_naive(t, "target", "name", "ic", "is_model"))


_FUND_VALUE = "v as (select fund, qi, sum(position_value) as v from {holdings} group by fund, qi)"
_CUMULATIVE = """fr as (select fund, qi, sum(weight * ret) / sum(weight) as fund_ret from {sql_weighted} group by fund, qi), ab as (select fund, qi, fund_ret - avg(fund_ret) over (partition by qi) as x from fr),
    hs as (select fund, qi, case when count(x) over w1 = 1 then sum(x) over w1 end as h1, case when count(x) over w2 = 2 then sum(x) over w2 end as h2 from ab window w1 as (partition by fund order by qi range between 1 following and 1 following), w2 as (partition by fund order by qi range between 1 following and 2 following))"""
_FROZEN = """gr as (select security, qi, case when count(ret) over w1 = 1 then exp(sum(ln(1 + ret)) over w1) - 1 end as g1, case when count(ret) over w2 = 2 then exp(sum(ln(1 + ret)) over w2) - 1 end as g2 from {stocks}
      window w1 as (partition by security order by qi range between 1 following and 1 following), w2 as (partition by security order by qi range between 1 following and 2 following)),
    fz as (select fund, qi, sum(weight * g1) / nullif(sum(case when g1 is not null then weight end), 0) as r1, sum(weight * g2) / nullif(sum(case when g2 is not null then weight end), 0) as r2 from {sql_weighted} join gr using (security, qi) group by fund, qi),
    hs as (select fund, qi, r1 - avg(r1) over (partition by qi) as h1, r2 - avg(r2) over (partition by qi) as h2 from fz)"""
_SORTED_FUNDS = "j as (select * from v join hs using (fund, qi)), b as (" + bucketed_sql("j", "v", 5, "bucket", "v is not null", "qi", "fund") + """), l as (select qi, bucket, 1 as h, h1 as y from b union all select qi, bucket, 2, h2 from b), m as (select h, bucket, qi, avg(y) as m from l where y is not null group by all),
    e as (select * from m union all select h, -1, qi, max(case when bucket = 4 then m end) - max(case when bucket = 0 then m end) from m group by h, qi), s as (""" + nw_sql("e", "h, bucket", "m", ("h - 1", 1)) + "), o as (" + nw_sql("e", "h, bucket", "m") + ") select h, bucket, s.n, round(s.mean, 8) as mean, round(s.t, 4) as t, round(o.t, 4) as t_ols from s join o using (h, bucket)"


def _fund_value(p):
    return p["holdings"].groupBy("fund", "qi").agg(F.sum("position_value").alias("v"))


@query("e15_fund_sort", f"with {_FUND_VALUE}, {_CUMULATIVE}, {_SORTED_FUNDS}")
def _(p):
    out = sorts.fund_sort(_fund_value(p), "v", H.fund_return(p.weighted).select("fund", "qi", "fund_ret"), 2, 1)
    return rounded(rounded(out, 8, "mean"), 4, "t", "t_ols")


@query("e16_frozen_fund_sort", f"with {_FUND_VALUE}, {_FROZEN}, {_SORTED_FUNDS}")
def _(p):
    out = sorts.frozen_fund_sort(_fund_value(p), "v", p.weighted, p["stocks"], 2, 1)
    return rounded(rounded(out, 8, "mean"), 4, "t", "t_ols")


@query("e16_frozen_fund_return", """
    with g as (select security, qi, case when count(ret) over w = 3 then exp(sum(ln(1 + ret)) over w) - 1 end as g from {stocks} window w as (partition by security order by qi range between 1 following and 3 following))
    select fund, qi, round(sum(weight * g) / nullif(sum(case when g is not null then weight end), 0), 6) as frozen_ret from {sql_weighted} left join g using (security, qi) group by fund, qi""")
def _(p):
    return rounded(sorts.frozen_fund_return(p.weighted, p["stocks"], 3, start=1))


_HITS = "h as (select fund, security, qi, case when shares > 25 then 1 else 0 end as hit, ret, weight from {sql_weighted})"


def _hits(p):
    return p.weighted.withColumn("hit", (F.col("shares") > 25).cast("int"))


_BY_ACCURACY = "b as (" + bucketed_sql("j", "acc", 5, "bucket", "true") + """), m as (select bucket, qi, avg(y) as m from b group by bucket, qi), e as (select * from m union all select -1, qi, max(case when bucket = 0 then m end) - max(case when bucket = 4 then m end) from m group by qi), """


@query("e17_stock_sort", f"with {_HITS}, acc as (select security, qi, avg(hit) as acc from h group by security, qi), j as (select security, qi, acc, fwd_1q as y from acc join {{sql_panel}} using (security, qi) where fwd_1q is not null), {_BY_ACCURACY} s as (" + nw_sql("e", "bucket", "m") + ") select bucket, n, round(mean, 8) as mean, round(t, 4) as t from s")
def _(p):
    return rounded(rounded(sorts.stock_sort(_hits(p), p.panel, "hit", "fwd_1q"), 8, "mean"), 4, "t")


_HOLDERS = "c as (select h.security, h.qi, avg(hit) as acc, round(sum(weight * hs.h2) / sum(weight), 12) as y, count(*) as holders from h join hs using (fund, qi) where hs.h2 is not null group by h.security, h.qi), j as (select * from c where y is not null), " + _BY_ACCURACY + "s as (" + nw_sql("e", "bucket", "m", 1) + "), s0 as (" + nw_sql("e", "bucket", "m") + ") select bucket, s.n, round(s.mean, 8) as mean, round(s.t, 4) as t, round(s0.t, 4) as t_ols, (select quantile_disc(holders, 0.5) from j) as median_holders from s join s0 using (bucket)"


@query("e17_stock_sort_holders", f"with {_HITS}, {_CUMULATIVE}, {_HOLDERS}")
def _(p):
    return rounded(rounded(sorts.stock_sort_holders(_hits(p), H.fund_return(p.weighted), "hit", 2, 1), 8, "mean"), 4, "t", "t_ols")


@query("e17_stock_sort_holders_frozen", f"with {_HITS}, {_FROZEN}, {_HOLDERS}")
def _(p):
    return rounded(rounded(sorts.stock_sort_holders(_hits(p), H.fund_return(p.weighted), "hit", 2, 1, returns=p["stocks"]), 8, "mean"), 4, "t", "t_ols")


@query("e18_correct_incorrect", "with " + _HITS + """, y as (select *, max(ret) over (partition by fund, security order by qi range between 1 following and 1 following) as y from h), m as (select qi, case when hit = 1 then 'correct' else 'incorrect' end as "group", avg(y) as m from y where y is not null group by all),
    e as (select * from m union all select qi, 'difference', max(case when "group" = 'correct' then m end) - max(case when "group" = 'incorrect' then m end) from m group by qi), s as (""" + nw_sql("e", '"group"', "m") + ') select "group", n, round(mean, 8) as mean, round(t, 4) as t from s')
def _(p):
    return rounded(rounded(sorts.correct_incorrect(_hits(p), "hit", "ret", k=1), 8, "mean"), 4, "t")


def _timing_sql(name: str, k: int) -> str:
    moved = f"max(ret) over (partition by fund, security order by qi range between {k} following and {k} following)" if k else "ret"
    return f"""select '{name}' as timing, qi, case when hit = 1 then 'correct' else 'incorrect' end as "group", avg(y) as m from (select *, {moved} as y from h) z where y is not null group by all"""


@query("e19_compare_timings", f"with {_HITS}, m as (" + " union all ".join(_timing_sql(n, k) for n, k in (("same", 0), ("next", 1), ("second", 2))) + """), e as (select timing, "group", qi, m from m union all select timing, 'difference', qi, max(case when "group" = 'correct' then m end) - max(case when "group" = 'incorrect' then m end) from m group by timing, qi), s as (""" + nw_sql("e", 'timing, "group"', "m") + ') select timing, "group", n, round(mean, 8) as mean, round(t, 4) as t from s')
def _(p):
    return rounded(rounded(sorts.compare_timings(_hits(p), "hit", "ret", {"same": 0, "next": 1, "second": 2}), 8, "mean"), 4, "t")


def _evaluation_sql(universes: dict[str, str], timings: dict[str, int], hmax: int = 2) -> str:
    """SQL of ``evaluation_table``: universes are conditions on the predictions."""
    ahead = lambda by, k: f"max(ret) over (partition by {by} order by qi range between {k} following and {k} following)" if k else "ret"
    each = " union all ".join(f"select '{u}' as universe, z.* from z where {rule}" for u, rule in universes.items())
    melt = lambda source, head, c: " union all ".join(f"select {head}'{t}' as timing, {c}{i} as y from {source}" for i, t in enumerate(timings))
    cumulative = ", ".join(f"case when count(x) over w{i} = {hmax} then sum(x) over w{i} end as c{i}" for i in range(len(timings)))
    frames = ", ".join(f"w{i} as (partition by fund order by qi range between {k} following and {k + hmax - 1} following)" for i, k in enumerate(timings.values()))
    spread = lambda source, sign: f"select universe, timing, qi, {sign} * (avg(case when b = 4 then y end) - avg(case when b = 0 then y end)) as m from {source} group by all"
    return f"""with z as (select *, {', '.join(f"{ahead('fund, security', k)} as y{i}" for i, k in enumerate(timings.values()))} from (select fund, security, qi, case when shares > 25 then 1 else 0 end as hit, ret, weight, is_us from {{sql_weighted}}) h0), r as ({each}),
    g as ({melt('r', 'universe, fund, qi, hit, ', 'y')}), gm as (select universe, timing, qi, avg(case when hit = 1 then y end) - avg(case when hit <> 1 then y end) as m from g where y is not null group by all), gs as ({nw_sql('gm', 'universe, timing', 'm')}),
    a as (select universe, security, qi, avg(hit) as acc from r group by all), l as (select security, qi, {', '.join(f"{ahead('security', k)} as y{i}" for i, k in enumerate(timings.values()))} from {{stocks}}), ll as ({melt('l', 'security, qi, ', 'y')}),
    aj as (select universe, timing, a.security, qi, acc, y from a join ll using (security, qi) where y is not null), ab as ({bucketed_sql('aj', 'acc', 5, 'b', 'true', 'universe, timing, qi')}), am as ({spread('ab', -1)}), ss as ({nw_sql('am', 'universe, timing', 'm')}),
    fr as (select fund, qi, sum(weight * ret) / sum(weight) as fund_ret from {{sql_weighted}} group by fund, qi), fx as (select fund, qi, fund_ret - avg(fund_ret) over (partition by qi) as x from fr), fc as (select fund, qi, {cumulative} from fx window {frames}), fl as ({melt('fc', 'fund, qi, ', 'c')}),
    fa as (select universe, fund, qi, avg(hit) as acc from r group by all), fj as (select universe, timing, fa.fund, qi, acc, y from fa join fl using (fund, qi) where y is not null), fb as ({bucketed_sql('fj', 'acc', 5, 'b', 'true', 'universe, timing, qi', 'fund')}), fm as ({spread('fb', 1)}), fs as ({nw_sql('fm', 'universe, timing', 'm', hmax - 1)}),
    w as (select universe, count(*) as n_funds, sum(n)::bigint as n_rows, avg(p) as precision from (select universe, fund, avg(hit) as p, count(*) as n from r group by all) group by universe)
    select w.universe, t.timing, n_funds, n_rows, round(precision, 6) as precision, round(gs.mean, 8) as gap, round(gs.t, 4) as gap_t, round(ss.mean, 8) as stock_spread, round(ss.t, 4) as stock_t, round(fs.mean, 8) as fund_spread, round(fs.t, 4) as fund_t
    from w cross join (values {', '.join(f"('{t}')" for t in timings)}) t(timing) left join gs on gs.universe = w.universe and gs.timing = t.timing left join ss on ss.universe = w.universe and ss.timing = t.timing left join fs on fs.universe = w.universe and fs.timing = t.timing"""


def _evaluated(p, timings, universes=None):
    held = io.stored(_hits(p).select("fund", "security", "qi", "hit", "ret", "weight", "is_us"))
    out = sorts.evaluation_table(held, p["stocks"], H.fund_return(held).select("fund", "qi", "fund_ret"), "hit", timings, universes, 2)
    return rounded(rounded(rounded(out, 6, "precision"), 8, "gap", "stock_spread", "fund_spread"), 4, "gap_t", "stock_t", "fund_t")


@query("e19_timing_table", _evaluation_sql({"all": "true"}, {"same": 0, "next": 1, "second": 2}))
def _(p):
    return _evaluated(p, {"same": 0, "next": 1, "second": 2})


@query("e36_universe_table", _evaluation_sql({"all": "true", "us": "is_us", "heavy": "weight > 0.03"}, {"next": 1}))
def _(p):
    return _evaluated(p, {"next": 1}, {"all": F.lit(True), "us": F.col("is_us"), "heavy": F.col("weight") > 0.03})


@query("e20_pred_vs_turnover", """
    with f as (select fund, qi, avg(case when shares > 25 then 1 else 0 end) as precision, sum(abs(weight_chg)) as tv from {sql_changes} group by fund, qi), g as (select *, precision - avg(precision) over (partition by qi) as a, tv - avg(tv) over (partition by qi) as b from f where tv is not null) select round(corr(precision, tv), 6) as pooled, round(corr(a, b), 6) as "within", count(*) as n from g""")
def _(p):
    v = sorts.fund_variables(p.changes.withColumn("hit", (F.col("shares") > 25).cast("int")), "hit")
    return rounded(sorts.pred_vs_turnover(v))


@query("e28_regression_metrics", """
    select qi, count(*) as n, round(avg(abs(fwd_1q - ret)), 6) as mae, round(sqrt(avg((fwd_1q - ret) * (fwd_1q - ret))), 6) as rmse, round(1 - sum((fwd_1q - ret) * (fwd_1q - ret)) / nullif(var_pop(fwd_1q) * count(*), 0), 4) as r2, round(stddev_pop(abs(fwd_1q - ret)), 6) as std_abs from {sql_panel} where fwd_1q is not null and ret is not null group by qi""")
def _(p):
    return rounded(rounded(stats.regression_metrics(p.panel, "fwd_1q", "ret", ["qi"]), 4, "r2"), 6, "mae", "rmse", "std_abs")


@query("e29_age_buckets", """
    with i as (select fund, security, qi, qi - row_number() over (partition by fund, security order by qi) as i from {dense}), a as (select fund, security, qi, row_number() over (partition by fund, security, i order by qi) as age from i),
    y as (select fund, security, qi, ln(shares) as y from {dense}), m as (select (age > 1)::int + (age > 2)::int + (age > 4)::int + (age > 8)::int as age_bucket, qi, avg(y) as m from a join y using (fund, security, qi) group by all), s as (""" + nw_sql("m", "age_bucket", "m") + ") select age_bucket, n, round(mean, 6) as mean, round(t, 3) as t from s")
def _(p):
    d = lags.run_length(p["dense"], ["fund", "security"]).withColumn("y", F.log("shares"))
    return rounded(rounded(sorts.age_buckets(d, "run", "y"), 6, "mean"), 3, "t")


@query("e29_filter_effect", """
    with l as (select *, 'all' as "group" from {book} union all select *, case when shares > 25 then 'kept' else 'dropped' end from {book}), m as (select "group", qi, avg(ret) as m from l group by all), s as (""" + nw_sql("m", '"group"', "m") + ') select "group", n, round(mean, 8) as mean, round(t, 4) as t from s')
def _(p):
    return rounded(rounded(sorts.filter_effect(p["book"], F.col("shares") > 25, "ret"), 8, "mean"), 4, "t")


@query("e29_continuity_signal", """
    with i as (select fund, security, qi, ret, count(*) over (partition by fund, security order by qi range between 1 preceding and current row) = 2 as f, max(ret) over (partition by fund, security order by qi range between 1 following and 1 following) as fwd_1q from {book}),
    l as (select qi, f, 'same' as "window", 0 as lags, ret as y from i union all select qi, f, 'next', 1, fwd_1q from i), g as (select "window", lags, qi, avg(case when f then y end) - avg(case when not f then y end) as spread from l where y is not null group by all), k as (select * from g where spread is not null),
    s as (""" + nw_sql("k", '"window"', "spread", ("lags", 1)) + """), h as (select "window", avg((spread > 0)::int) as hit from k group by "window") select "window", n, round(mean, 8) as spread, round(t, 4) as t, round(hit, 6) as hit from s join h using ("window") where n >= 8""")
def _(p):
    d = H.forward_returns(lags.feasible(p["book"], ["fund", "security"], 2), ["fund", "security"], "ret", (1,))
    out = sorts.continuity_signal(d, "feasible", {"same": ("ret", 0), "next": ("fwd_1q", 1)})
    return rounded(rounded(rounded(out, 8, "spread"), 4, "t"), 6, "hit")


@query("e30_selling_asymmetry", """
    with r as (select distinct fund, qi - 1 as qi from {book}), n as (select fund, security, qi - 1 as qi, position_value as v from {book}), t as (select b.ret, coalesce(n.v, 0) - b.position_value as c, n.v is null as x from {book} b join r using (fund, qi) left join n using (fund, security, qi))
    select count(*) as n, round(avg((c > 0)::int), 6) as buy_rate, round(avg((c < 0)::int), 6) as sell_rate, round(avg(x::int), 6) as exit_rate, round(count(case when x then 1 end) / count(case when c < 0 then 1 end), 6) as exit_share,
      round(avg(case when c > 0 then ret end), 8) as ret_buy, round(avg(case when c < 0 then ret end), 8) as ret_sell, round(avg(case when x then ret end), 8) as ret_exit, round(avg(case when c < 0 and not x then ret end), 8) as ret_sell_kept from t""")  # fmt: skip
def _(p):
    out = sorts.selling_asymmetry(p["book"], "fund", "security", "position_value", "ret")
    return rounded(rounded(out, 6, "buy_rate", "sell_rate", "exit_rate", "exit_share"), 8, "ret_buy", "ret_sell", "ret_exit", "ret_sell_kept")


@query("e31_feasibility", """
    with x as (select fund, security, qi, 0.5 as s, 0.3 as h, 0.2 as b, count(*) over (partition by fund, security order by qi range between 1 preceding and current row) = 2 as f from {holdings}) select fund, security, qi, round(case when f then s else 0 end / (case when f then s else 0 end + h + b), 6) as s_f, round(h / (case when f then s else 0 end + h + b), 6) as h_f, round(b / (case when f then s else 0 end + h + b), 6) as b_f, case when f then -1 else 0 end as pred from x""")
def _(p):
    x = lags.feasible(p["holdings"].select("fund", "security", "qi"), ["fund", "security"], 2).withColumns({"s": F.lit(0.5), "h": F.lit(0.3), "b": F.lit(0.2)})
    return rounded(sorts.apply_feasibility(x, "s", "h", "b", "feasible").select("fund", "security", "qi", "s_f", "h_f", "b_f", "pred"))


@query("e32_importance_rollup", """
    with i as (select p_type as feature, sum(l_quantity) as importance from {lineitem} join {part} on l_partkey = p_partkey group by p_type), f as (select case when starts_with(feature, 'S') then 's' when starts_with(feature, 'E') then 'e' else 'other' end as family, * from i)
    select family, sum(importance) as total, max_by(feature, importance) as best, round(sum(importance) / (select sum(importance) from i), 6) as share from f group by family""")
def _(p):
    i = p["lineitem"].join(p["part"], F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_type").alias("feature")).agg(F.sum("l_quantity").alias("importance"))
    return rounded(stats.importance_rollup(i, {"S": "s", "E": "e"}))


@query("e33_leaderboard", "select inv_type, fund, n, place from (select inv_type, fund, count(*) as n, cast(row_number() over (partition by inv_type order by count(*) desc, fund) as int) as place from {book} group by inv_type, fund) where place <= 5")
def _(p):
    t = p["book"].groupBy("inv_type", "fund").agg(F.count("*").alias("n"))
    return stats.leaderboard(t, "inv_type", "n", "fund", 5)


@query("e33_side_by_side", """
    select inv_type, round(avg(case when fund_size = 0 then ret end), 8) as "0_ret", round(avg(case when fund_size = 0 then shares end), 6) as "0_shares", round(avg(case when fund_size = 1 then ret end), 8) as "1_ret", round(avg(case when fund_size = 1 then shares end), 6) as "1_shares",
      round(avg(case when fund_size = 1 then ret end) - avg(case when fund_size = 0 then ret end), 8) as "1_ret_diff", round(avg(case when fund_size = 1 then shares end) - avg(case when fund_size = 0 then shares end), 6) as "1_shares_diff" from {book} where inv_type = 402 or fund_size = 0 group by inv_type""")
def _(p):
    t = p["book"].filter("inv_type = 402 or fund_size = 0").groupBy("inv_type", "fund_size").agg(F.avg("ret").alias("ret"), F.avg("shares").alias("shares"))
    out = stats.side_by_side(t, "inv_type", "fund_size", [0, 1], ["ret", "shares"])
    return rounded(rounded(out, 8, *[c for c in out.columns if "_ret" in c]), 6, *[c for c in out.columns if "_shares" in c])


@query("e34_sign_flip", """
    with m as (select security, round(avg(case when qi < 7995 then ret end), 12) as discovery, round(avg(case when qi >= 7995 then ret end), 12) as validation from {stocks} group by security) select security, discovery, validation, sign(discovery) * sign(validation) > 0 as agrees from m""")
def _(p):
    m = p["stocks"].groupBy("security", F.when(F.col("qi") < 7995, "discovery").otherwise("validation").alias("sample")).agg(F.round(F.avg("ret"), 12).alias("m"))
    return stats.sign_flip(m, "security", "m")


@query("e35_blend_report", "with a as (" + spread_sql("{sql_panel}", "frac_buy", "fwd_1q") + "), b as (" + spread_sql("{sql_panel}", "trades", "fwd_1q") + """), x as (select a.ret as a, b.ret as b from a join b using (qi)), s as (select count(*) as n, corr(a, b) as rho, avg(a) / stddev_samp(a) * 2 as sa, avg(b) / stddev_samp(b) * 2 as sb, avg(a / 2 + b / 2) / stddev_samp(a / 2 + b / 2) * 2 as sc from x)
    select n, round(rho, 4) as rho, round(sa, 4) as sharpe_a, round(sb, 4) as sharpe_b, round(sc, 4) as sharpe_blend, round((sa + sb) / sqrt(2 + 2 * rho), 4) as predicted from s""")
def _(p):
    return rounded(stats.blend_report(*[sorts.decile_spread(p.panel, s, "fwd_1q") for s in ("frac_buy", "trades")], 4.0), 4)


@query("e36_compare_universes", """
    select 'us' as universe, count(*) as n, round(avg(ret), 8) as ret from {book} where is_us union all select '401', count(*), round(avg(ret), 8) from {book} where inv_type = 401 union all select 'large', count(*), round(avg(ret), 8) from {book} where position_value > 30000""")
def _(p):
    u = sorts.compare_universes(p["book"], {"us": F.col("is_us"), "401": F.col("inv_type") == 401, "large": F.col("position_value") > 30000})
    return rounded(u.groupBy("universe").agg(F.count("*").alias("n"), F.avg("ret").alias("ret")), 8)


@query("e36_universe_performance", """
    with u as (select *, 'all' as universe from {sql_panel} union all select *, 'large' from {sql_panel} where market_cap > 1500000 union all select *, 'traded' from {sql_panel} where trades > 2), s as (""" + spread_sql("u", "trades", "fwd_1q", keys="universe") + "), " + perf_sql("s", "universe"))
def _(p):
    return perf(sorts.universe_performance(p.panel, {"all": F.lit(True), "large": F.col("market_cap") > 1500000, "traded": F.col("trades") > 2}, "trades", "fwd_1q"))


@query("e36_universe_precision", f"""
    with l as ({_LABELS}), u as (select 'all' as universe, fund, (y = pred)::int as hit from l union all select 'even', fund, (y = pred)::int from l where fund % 2 = 0),
    f as (select universe, fund, avg(hit) as p, sum(hit) as h, count(*) as n from u group by all) select universe, count(*) as funds, sum(n)::bigint as n, round(sum(h) / sum(n), 6) as pooled, round(avg(p), 6) as fund_average from f group by universe""")
def _(p):
    hits = _labels(p).withColumn("hit", (F.col("y") == F.col("pred")).cast("int"))
    return rounded(sorts.universe_precision(hits, {"all": F.lit(True), "even": F.col("fund") % 2 == 0}, "hit"))


@query("e38_signal_profile", """
    with l as (select n_funds, 'n_buy' as signal, n_buy as x from {sql_panel} union all select n_funds, 'net_buy', net_buy from {sql_panel}) select signal, round(count(x) / count(*), 6) as "defined", count(distinct round(x, 9)) as distinct_values, round(count(case when x = 0 then 1 end) / count(*), 6) as zeros, round(corr(x, n_funds), 6) as corr_base from l group by signal""")
def _(p):
    return rounded(stats.signal_profile(p.panel.withColumn("net_buy", F.round("net_buy", 9)), ["n_buy", "net_buy"], "n_funds"))
