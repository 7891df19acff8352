"""Queries of cleaning, lags, joins and cross-sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import clean, joins, lags, xsec
from ..operators import presence as pres
from .registry import query, rounded

FS, SQ = ["fund", "security"], ["security", "qi"]


def bucket_sql(r: str, m: str, n: int) -> str:
    """The bucket formula over columns of rank and count."""
    return f"cast(greatest(coalesce(floor((({r} - 1) * {n} + {m} - 2) / nullif({m} - 1, 0)), 1), 1) - 1 as int)"


@query("p1_norm_id", "select distinct l_suppkey as raw, cast(l_suppkey as varchar) as from_padded, cast(l_suppkey as varchar) as from_decimal, 'AB' || cast(l_suppkey as varchar) as from_text from lineitem")
def _(p):
    raw = F.col("l_suppkey")
    padded, decimal = F.concat(F.lit(" 00"), raw.cast("string"), F.lit(" ")), F.concat(raw.cast("string"), F.lit(".0"))
    return p["lineitem"].select(raw.alias("raw"), C.norm_id(padded).alias("from_padded"), C.norm_id(decimal).alias("from_decimal"), C.norm_id(F.concat(F.lit(" AB"), raw.cast("string"))).alias("from_text")).distinct()


@query("p2_flags_and_numbers", """
    select event_type, upper(trim(event_type)) as upper_id, count(*) as n, count(case when event_type in ('true', 't', 'yes', 'y') then 1 end) as truthy,
      count(try_cast(value as double)) as numbers, sum(case when event_id % 2 <> 0 then 1 else 0 end) as odd
    from {events} group by event_type""")  # fmt: skip
def _(p):
    return p["events"].groupBy("event_type").agg(
        F.first(C.norm_text_id("event_type")).alias("upper_id"), F.count("*").alias("n"), F.count_if(C.to_bool("event_type")).alias("truthy"), F.count(C.to_num(F.col("value").cast("string"))).alias("numbers"), F.count_if(C.to_bool(F.col("event_id") % 2)).alias("odd")
    )


@query("p6_clean_domain", """
    select security, qi, case when ret * 25 >= -1 then round(ret * 25, 6) end as ret, case when tax - 0.04 >= 0 then round(tax - 0.04, 6) end as volume, case when market_cap - 1300000 > 0 then round(market_cap - 1300000, 4) end as cap,
      round(abs(ret), 6) as price from {stocks}""")  # fmt: skip
def _(p):
    s = p["stocks"].select("security", "qi", (F.col("ret") * 25).alias("x"), (F.col("tax") - 0.04).alias("volume"), (F.col("market_cap") - 1300000).alias("cap"), F.col("ret").alias("price"))
    out = clean.clean_domain(s.withColumnRenamed("x", "ret"), ["ret"], ["volume"], ["cap"], ["price"])
    return out.select("security", "qi", F.round("ret", 6).alias("ret"), F.round("volume", 6).alias("volume"), F.round("cap", 4).alias("cap"), F.round("price", 6).alias("price"))


@query("p7_universe", "select fund, inv_type, count(*) as n from {book} where is_us and inv_type = 401 and fund_size in (0, 1) group by fund, inv_type")
def _(p):
    return clean.universe(p["book"], True, ["401"], {"fund_size": [0, 1]}).groupBy("fund", "inv_type").agg(F.count("*").alias("n"))


@query("p8_dedupe_last", "select fund, security, day, qi, shares, position_value from {holdings}")
def _(p):
    rows = p["lineitem"].join(p["part"], F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("fund"), F.concat_ws("|", "p_brand", "p_type").alias("security"), F.to_date("l_shipdate").alias("day"), C.quarter_index("l_shipdate").alias("qi"), F.col("l_quantity").alias("shares"), F.col("l_extendedprice").alias("position_value"), "l_shipdate", "l_orderkey", "l_linenumber"
    )
    order = [F.col(c).desc() for c in ("l_shipdate", "l_orderkey", "l_linenumber", "position_value")]
    return clean.dedupe(rows, ["fund", "security", "qi"], order).select("fund", "security", "day", "qi", "shares", "position_value")


@query("s4_last_snapshot", """
    select user_id, cast(year(ts) * 12 + month(ts) as int) as m, max_by(value, struct_pack(a := ts, b := event_id)) as value, max(ts) as ts from {events} group by user_id, cast(year(ts) * 12 + month(ts) as int)""")
def _(p):
    rows = p["events"].select("user_id", C.month_index("ts").alias("m"), "ts", "event_id", "value")
    return clean.last_snapshot(rows, ["user_id", "m"], ["ts", "event_id"]).select("user_id", "m", "value", "ts")


@query("p9_duplicate_keys", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def _(p):
    return clean.duplicate_keys(p["lineitem"], ["l_orderkey", "l_linenumber"])


@query("p10_autoscale", """
    with m as (select quantile_cont(abs(l_discount * 100), 0.5) as med from lineitem where l_discount <> 0)
    select l_returnflag, round(avg(case when med > 1.5 then l_discount * 100 * 0.01 else l_discount * 100 end), 6) as mean_scaled, round(max(med), 6) as med from lineitem, m group by l_returnflag""")
def _(p):
    x = p["lineitem"].select("l_returnflag", (F.col("l_discount") * 100).alias("x"))
    med = x.filter("x != 0").agg(F.round(F.percentile(F.abs("x"), 0.5), 6).alias("med"))
    return clean.autoscale(x, "x").groupBy("l_returnflag").agg(F.round(F.avg("x"), 6).alias("mean_scaled")).crossJoin(F.broadcast(med))


@query("p10_turnover", """
    with r as (select security, qi, trades / nullif(market_cap / 100000, 0) as raw from {stocks}), m as (select quantile_cont(raw, 0.5) as med from r where raw > 0)
    select r.security, r.qi, round(case when med between 0.005 and 5 then raw else raw / nullif(tax, 0) end, 6) as turnover from r join {stocks} s using (security, qi), m""")
def _(p):
    s = p["stocks"].select("security", "qi", F.col("trades").cast("double").alias("volume"), (F.col("market_cap") / 100000).alias("so"), "tax")
    return rounded(clean.turnover(s, "volume", "so", "tax").select("security", "qi", "turnover"))


@query("p11_sentinel", """
    select 'rows' as mode, count(*) as n, count(x) as defined, round(sum(y), 4) as y from (select case when shares % 7 = 0 then -1 else shares / 50 end as x, position_value as y from {holdings}) where x is distinct from -1
    union all select 'mask', count(*), count(case when x <> -1 then 1 end), round(sum(case when x <> -1 then y end), 4) from (select case when shares % 7 = 0 then -1 else shares / 50 end as x, position_value as y from {holdings})""")
def _(p):
    h = p["holdings"].select(F.when(F.col("shares") % 7 == 0, -1.0).otherwise(F.col("shares") / 50).alias("x"), F.col("position_value").alias("y"))
    parts = [clean.drop_sentinel(h, "x", -1.0, m, ["y"]).agg(F.count("*").alias("n"), F.count("x").alias("defined"), F.round(F.sum("y"), 4).alias("y")).select(F.lit(m).alias("mode"), "*") for m in ("rows", "mask")]
    return parts[0].unionByName(parts[1])


@query("p12_min_group", "select fund, qi, security from {holdings} where (fund, qi) in (select (fund, qi) from {holdings} group by fund, qi having count(*) >= 22)")
def _(p):
    return clean.min_group(p["holdings"], ["fund", "qi"], 22).select("fund", "qi", "security")


@query("p13_min_history", """
    with a as (select fund, security, qi, row_number() over (partition by fund, security order by qi) as k, count(*) over (partition by fund, security order by qi range between 2 preceding and current row) as c from {holdings})
    select fund, security, qi, 'seen' as rule from a where k >= 3 union all select fund, security, qi, 'consecutive' from a where c >= 3""")
def _(p):
    h = p["holdings"].select("fund", "security", "qi")
    return clean.min_history(h, FS, 3).withColumn("rule", F.lit("seen")).unionByName(clean.min_history(h, FS, 3, consecutive=True).withColumn("rule", F.lit("consecutive")))


@query("p14_require_months", """
    with m as (select distinct o_custkey as id, cast(year(o_orderdate) * 12 + month(o_orderdate) as int) as m from {orders}),
      c as (select id, m, count(*) over (partition by id order by m range between 1 preceding and current row) as k from m)
    select id, m, count(*) as n from (select o_custkey as id, cast(year(o_orderdate) * 12 + month(o_orderdate) as int) as m from {orders}) o where (id, m) in (select (id, m) from c where k = 2) group by id, m""")
def _(p):
    o = p["orders"].select(F.col("o_custkey").alias("id"), "o_orderdate")
    return clean.require_months(o, "id", "o_orderdate", 2).groupBy("id", C.month_index("o_orderdate").alias("m")).agg(F.count("*").alias("n"))


@query("p14_require_months_expanding", """
    with m as (select distinct nation as id, m from (select n_nationkey as nation, cast(year(o_orderdate) * 12 + month(o_orderdate) as int) as m from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey)),
      c as (select id, m, count(*) over (partition by id order by m) as k, (select min(m) from m) as f from m)
    select id, m from c where k = m - f + 1""")
def _(p):
    o = p["orders"].join(p["customer"], F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").cast("int").alias("id"), "o_orderdate")
    return clean.require_months(o, "id", "o_orderdate", "exp").select("id", C.month_index("o_orderdate").alias("m")).distinct()


@query("p15_cap_rows", "select security, qi from {stocks} order by md5('3:' || security || ':' || qi), security, qi limit 200")
def _(p):
    return clean.cap_rows(p["stocks"].select("security", "qi"), 200, ["security", "qi"], 3)


@query("p16_first_entities", "select security, count(*) as n from {daily} where security in (select security from {daily} group by security having count(*) >= 26 order by security limit 20) group by security")
def _(p):
    return clean.first_n_entities(p["daily"], "security", 20, 26).groupBy("security").agg(F.count("*").alias("n"))


@query("p17_mask_labels", "select count(*) as rows, count(ret) as before, count(case when not coalesce(abs(ret) > 0.01, false) then ret end) as after, count(case when abs(ret) > 0.01 then 1 end) as masked from {daily}")
def _(p):
    return clean.mask_audit(p["daily"], "ret", F.abs("ret") > 0.01)


@query("p18_transforms", """
    select security, qi, round(ln(abs(ret) + 1), 6) as slog, round(ln(1 + abs(ret) * 1e6 / nullif(market_cap, 0)), 6) as illiq, round(least(abs(trades) / nullif(market_cap / 1e6 * 0.25, 0), 250), 6) as dtl, round(greatest(least(ret, 0.005), -0.005), 6) as clipped from {stocks}""")
def _(p):
    return rounded(p["stocks"].select("security", "qi", C.signed_log("ret").alias("slog"), C.illiquidity("ret", "market_cap").alias("illiq"), C.days_to_liquidate("trades", F.col("market_cap") / 1e6).alias("dtl"), C.clip("ret", -0.005, 0.005).alias("clipped")))


@query("p19_calendars", """
    with d as (select distinct cast(o_orderdate as date) as day from {orders})
    select day, cast(year(day) * 4 + quarter(day) as int) as qi, cast(row_number() over (order by day) - 1 as int) as date_no, year(day)::varchar || case when month(day) <= 6 then 'H1' else 'H2' end as half from d""")
def _(p):
    d = p["orders"].select(F.to_date("o_orderdate").alias("day")).distinct()
    return clean.dense_index(d, "day", "date_no").select("day", C.quarter_index("day").alias("qi"), "date_no", C.half_year("day").alias("half"))


@query("p20_trade_label", """
    with a as (select security, qi, ret, max(market_cap) over (partition by security order by qi range between 1 following and 1 following) / market_cap - 1 as chg from {stocks})
    select security, qi, case when chg > 0.01 then 1 when chg < -0.01 then -1 when chg is not null then 0 end as label from a""")
def _(p):
    lead = lags.lag_column("market_cap", ["security"], -1)
    return p["stocks"].withColumn("chg", lead / F.col("market_cap") - 1).select("security", "qi", C.trade_label("chg").alias("label"))


@query("j1_exact_lag", """
    select fund, security, qi, position_value, max(position_value) over (partition by fund, security order by qi range between 1 preceding and 1 preceding) as position_value_lag1,
      max(position_value) over (partition by fund, security order by qi range between 1 following and 1 following) as position_value_lead1 from {holdings}""")  # fmt: skip
def _(p):
    h = p["holdings"].select("fund", "security", "qi", "position_value")
    return lags.exact_lag(lags.exact_lag(h, FS, ["position_value"], 1), FS, ["position_value"], -1)


@query("j2_union_grid", """
    with n as (select fund, security, qi, position_value as v from {holdings}), b as (select fund, security, qi + 1 as qi, position_value as v from {holdings})
    select coalesce(n.fund, b.fund) as fund, coalesce(n.security, b.security) as security, coalesce(n.qi, b.qi) as qi, coalesce(n.v, 0) as position_value, coalesce(b.v, 0) as position_value_prev, n.v is not null as held_now, b.v is not null as held_prev
    from n full join b on n.fund = b.fund and n.security = b.security and n.qi = b.qi where (coalesce(n.fund, b.fund), coalesce(n.qi, b.qi)) in (select (fund, qi) from {holdings})""")
def _(p):
    return lags.union_grid(p["holdings"], "fund", "security", ["position_value"])


@query("j4_lookup_at", """
    with a as (select fund, qi, sum(position_value) as total from {holdings} group by fund, qi)
    select h.fund, h.qi, h.security, round(a.total, 4) as total_at from {holdings} h left join a on a.fund = h.fund and a.qi = h.qi - 2""")
def _(p):
    totals = p["holdings"].groupBy("fund", "qi").agg(F.sum("position_value").alias("total"))
    return rounded(lags.lookup_at(p["holdings"].select("fund", "qi", "security"), totals, ["fund"], 2), 4)


@query("j5_dense_ffill", """
    with c as (select distinct qi from {holdings}), s as (select fund, security, min(qi) as f from {holdings} group by fund, security), g as (select fund, security, qi from s join c on c.qi >= f)
    select g.fund, g.security, g.qi, last_value(h.shares ignore nulls) over (partition by g.fund, g.security order by g.qi) as shares from g left join {holdings} h on h.fund = g.fund and h.security = g.security and h.qi = g.qi""")
def _(p):
    return lags.dense_ffill(p["holdings"], FS, ["shares"])


@query("j6_coverage", """
    select h.qi, count(*) as rows, count(d.fund) as hits, round(count(d.fund) / count(*), 6) as rate from {holdings} h left join (select distinct fund, security, qi + 1 as qi from {holdings}) d on d.fund = h.fund and d.security = h.security and d.qi = h.qi group by h.qi""")
def _(p):
    before = p["holdings"].select("fund", "security", (F.col("qi") + 1).alias("qi"))
    return rounded(joins.coverage_by(p["holdings"], before, ["fund", "security", "qi"], ["qi"]))


@query("j7_asof_market", """
    with d as (select distinct cast(l_shipdate as date) as day from {lineitem}), m as (select day as at, level from {market})
    select d.day, case when date_diff('day', m.at, d.day) <= 7 then m.level end as level, case when date_diff('day', m.at, d.day) <= 7 then m.at end as level_date from d asof left join m on d.day >= m.at""")
def _(p):
    return joins.asof_series(p["lineitem"].select(F.to_date("l_shipdate").alias("day")).distinct(), p["market"], "day", "level", 7)


@query("j7_asof_keyed", """
    with e as (select event_id, user_id, ts from {events} where event_type = 'error'), v as (select user_id, ts, max(value) as value from {events} where event_type <> 'error' group by user_id, ts)
    select e.event_id, e.user_id, e.ts, v.value as value, v.ts as value_date from e asof left join v on e.user_id = v.user_id and e.ts >= v.ts""")
def _(p):
    e = p["events"].filter("event_type = 'error'").select("event_id", "user_id", "ts")
    v = p["events"].filter("event_type != 'error'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return joins.asof_join(e, v, ["user_id"], "ts", "value")


@query("j8_realised_trade", """
    with r as (select distinct fund, qi - 1 as qi from {holdings}), n as (select fund, security, qi - 1 as qi, position_value as v from {holdings})
    select h.fund, h.security, h.qi, r.fund is not null as fund_reports, case when r.fund is not null then coalesce(n.v, 0) end as next_position_value, case when r.fund is not null then n.v is null end as exits
    from {holdings} h left join r on r.fund = h.fund and r.qi = h.qi left join n on n.fund = h.fund and n.security = h.security and n.qi = h.qi""")
def _(p):
    return lags.realised_trade(p["holdings"], *FS, "position_value").select(*FS, "qi", "fund_reports", "next_position_value", "exits")


@query("j9_align_sample", """
    with a as (select security, qi, ret, max(ret) over (partition by security order by qi range between 1 preceding and 1 preceding) as l1, max(ret) over (partition by security order by qi range between 4 preceding and 4 preceding) as l4 from {stocks})
    select qi, count(*) as n, round(avg(ret), 6) as ret from a where ret is not null and l1 is not null and l4 is not null group by qi""")
def _(p):
    s = lags.named_lags(p["stocks"], ["security"], {"l1": ("ret", 1), "l4": ("ret", 4)})
    return rounded(joins.align_sample(s, ["ret", "l1", "l4"]).groupBy("qi").agg(F.count("*").alias("n"), F.avg("ret").alias("ret")))


@query("j10_held_count", """
    select fund, security, qi, count(*) over (partition by fund, security order by qi range between 3 preceding and current row) as held, count(*) over (partition by fund, security order by qi range between 3 preceding and current row) = 4 as feasible from {dense}""")
def _(p):
    d = p["dense"].select("fund", "security", "qi")
    return lags.held_count(d, FS, 4).withColumn("feasible", F.col("held") == 4)


@query("j10_presence", """
    with d as (select distinct o_custkey as id, cast(year(o_orderdate) * 12 + month(o_orderdate) as bigint) as m from {orders}), a as (select *, m - row_number() over (partition by id order by m) as i from d)
    select id, m, row_number() over (partition by id order by m) as seen, row_number() over (partition by id, i order by m) as run, count(*) over (partition by id order by m range between 2 preceding and current row) as held_3, count(*) over (partition by id order by m range between 69 preceding and current row) as held_70 from a""")
def _(p):
    o = p["orders"].select(F.col("o_custkey").alias("id"), C.month_index("o_orderdate").alias("m"))
    return pres.presence_measures(pres.presence(o, ["id"], "m"), ["id"], (3, 70), "m")


@query("p13_history_bits", """
    with a as (select fund, security, qi, row_number() over (partition by fund, security order by qi) as k, count(*) over (partition by fund, security order by qi range between 2 preceding and current row) as c from {holdings})
    select fund, security, qi, 'seen' as rule from a where k >= 3 union all select fund, security, qi, 'consecutive' from a where c >= 3 union all select fund, security, qi, 'covered' from a where c = 3""")
def _(p):
    h = p["holdings"].select("fund", "security", "qi")
    parts = {"seen": pres.with_history(h, FS, 3), "consecutive": pres.with_history(h, FS, 3, consecutive=True), "covered": pres.covered(h, FS, 3)}
    return joins.stack([x.withColumn("rule", F.lit(k)) for k, x in parts.items()])


@query("j11_merge_checked", "select h.fund, h.security, h.qi, s.market_cap from {holdings} h left join {stocks} s on s.security = h.security and s.qi = h.qi")
def _(p):
    return joins.merge_checked(p["holdings"].select("fund", "security", "qi"), p["stocks"].select("security", "qi", "market_cap"), SQ)


@query("j12_folds", """
    with b as (select min(qi) as lo, max(qi) as hi from {stocks}), f as (select i as fold, lo + 4 * i as train_lo, lo + 4 * i + 7 as train_hi, lo + 4 * i + 8 as test_lo, lo + 4 * i + 11 as test_hi from b, range(100) t(i) where lo + 4 * i + 11 <= hi)
    select cast(fold as int) as fold, case when qi <= train_hi then 'train' else 'test' end as role, count(*) as n from {stocks} join f on qi between train_lo and test_hi where qi + 1 <= train_hi or qi >= test_lo group by all""")
def _(p):
    from ..operators.folds import quarter_folds

    lo, hi = p["stocks"].agg(F.min("qi"), F.max("qi")).first()
    folds = quarter_folds(p.spark, lo, hi, 12, 4, 4)
    return joins.assign_folds(p["stocks"].withColumn("end", F.col("qi") + 1), folds, "qi", "end").groupBy("fold", "role").agg(F.count("*").alias("n"))


@query("u2_common_folds", """
    with a as (select distinct qi from {stocks} where ret > 0.004), b as (select distinct qi from {stocks} where ret < -0.004), c as (select distinct qi from {stocks} where tax > 0.042) select qi from a intersect select qi from b intersect select qi from c""")
def _(p):
    s = p["stocks"]
    return joins.common_folds({"a": s.filter("ret > 0.004"), "b": s.filter("ret < -0.004"), "c": s.filter("tax > 0.042")}, ["qi"])


@query("u1_stack", """
    select 'holdings' as part, fund, security, qi, shares, cast(null as double) as market_cap from {holdings} union all select 'stocks', null, security, qi, null, market_cap from {stocks}""")
def _(p):
    a = p["holdings"].select(F.lit("holdings").alias("part"), "fund", "security", "qi", "shares")
    return joins.stack([a, p["stocks"].select(F.lit("stocks").alias("part"), "security", "qi", "market_cap")])


@query("w1_lag_block", """
    with a as (select security, qi, """ + ", ".join(f"max(ret) over (partition by security order by qi range between {k} preceding and {k} preceding) as ret_lag{k}" for k in (1, 2, 3, 4)) + """ from {stocks})
    select *, (coalesce(ret_lag1, 0) + coalesce(ret_lag2, 0) + coalesce(ret_lag3, 0) + coalesce(ret_lag4, 0)) / nullif((ret_lag1 is not null)::int + (ret_lag2 is not null)::int + (ret_lag3 is not null)::int + (ret_lag4 is not null)::int, 0) as ret_ma, ret_lag1 - ret_lag2 as ret_chg from a""")
def _(p):
    return lags.lag_block(p["stocks"].select("security", "qi", "ret"), ["security"], ["ret"]).drop("ret")


@query("w2_observed_lag", "select fund, security, qi, coalesce(lag(shares) over (partition by fund, security order by qi), shares) as shares_obs1 from {holdings}")
def _(p):
    return lags.observed_lag(p["holdings"], FS, "shares").select("fund", "security", "qi", "shares_obs1")


@query("w3_zscore", """
    with a as (select qi, avg(ret) as m, stddev_samp(ret) as s from {stocks} group by qi) select security, qi, round((ret - m) / nullif(s, 0), 6) as ret_z from {stocks} join a using (qi)""")
def _(p):
    return rounded(xsec.zscore(p["stocks"], ["ret"], ["qi"]).select("security", "qi", "ret_z"))


@query("w4_zscore_past", """
    with a as (select security, qi, ret, count(ret) over w as n, avg(ret) over w as m, stddev_samp(ret) over w as s from {stocks} window w as (partition by security order by qi rows between unbounded preceding and 1 preceding))
    select security, qi, round(case when n >= 4 then (ret - m) / nullif(s, 0) end, 6) as ret_zp from a""")
def _(p):
    return rounded(lags.zscore_past(p["stocks"], ["security"], "ret").select("security", "qi", "ret_zp"))


@query("w5_rank_pct", """
    select fund, security, qi, round((rank() over (partition by qi, fund order by shares) + (count(*) over (partition by qi, fund, shares) - 1) / 2) / count(*) over (partition by qi, fund), 8) as shares_pct from {holdings}""")
def _(p):
    return rounded(xsec.rank_pct(p["holdings"], "shares", ["qi", "fund"]).select("fund", "security", "qi", "shares_pct"), 8)


@query("w6_run_length", """
    with a as (select fund, security, qi, qi - row_number() over (partition by fund, security order by qi) as i from {dense}) select fund, security, qi, cast(row_number() over (partition by fund, security, i order by qi) as int) as run from a""")
def _(p):
    return lags.run_length(p["dense"].select("fund", "security", "qi"), FS)


@query("w7_past_rates", """
    with c as (select fund, qi, count(*) as n, sum(case when shares > 25 then 1 else 0 end) as s from {holdings} group by fund, qi), r as (select fund, qi, coalesce(sum(n) over w, 0)::bigint as big_n, sum(s) over w as t from c window w as (partition by fund order by qi rows between unbounded preceding and 1 preceding))
    select fund, security, qi, big_n, cast(t as double) / nullif(big_n, 0) as big_rate from {holdings} join r using (fund, qi)""")
def _(p):
    h = p["holdings"].select("fund", "security", "qi", (F.col("shares") > 25).cast("int").alias("big"))
    return lags.past_rates(h, ["fund"], ["big"]).drop("big")


@query("w12_winsorize", """
    with q as (select qi, quantile_cont(ret, 0.05) as lo, quantile_cont(ret, 0.95) as hi from {stocks} group by qi) select security, qi, round(greatest(least(ret, hi), lo), 12) as ret from {stocks} join q using (qi)""")
def _(p):
    return rounded(xsec.winsorize(p["stocks"].select("security", "qi", "ret"), ["ret"], ["qi"], 0.05), 12)


@query("w13_lag_vol", """
    with a as (select security, qi, count(ret) over w as n, stddev_samp(ret) over w as s from {stocks} window w as (partition by security order by qi range between 3 preceding and current row)) select security, qi, round(case when n >= 2 then s end, 6) as ret_vol from a""")
def _(p):
    return rounded(lags.lag_vol(p["stocks"], ["security"], "ret").select("security", "qi", "ret_vol"))


@query("w17_sequences", """
    with t as (select i from range(4) x(i))
    select h.fund, h.security, h.qi, string_agg(coalesce(cast(cast(b.shares as int) as varchar), '-'), ',' order by i) as shares, cast(count(b.shares) as int) as present from {holdings} h cross join t left join {holdings} b on b.fund = h.fund and b.security = h.security and b.qi = h.qi - 3 + i group by h.fund, h.security, h.qi""")
def _(p):
    s = lags.sequences(p["holdings"], FS, ["shares"], 4)
    text = F.array_join(F.transform("seq", lambda x: F.coalesce(x["shares"].cast("int").cast("string"), F.lit("-"))), ",")
    return s.select("fund", "security", "qi", text.alias("shares"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("present"))


@query("w18_panel_template", """
    with r as (select *, row_number() over (partition by fund, qi order by position_value desc, security) as rk from {holdings}), h as (select * from r where rk <= 3), t as (select i from range(3) x(i))
    select h.fund, h.qi, cast(h.rk as int) as slot, h.security, string_agg(case when b.fund is null then '0' else '1' end, '' order by i desc) as mask, string_agg(coalesce(cast(cast(b.shares as int) as varchar), '-'), ',' order by i desc) as shares
    from h cross join t left join {holdings} b on b.fund = h.fund and b.security = h.security and b.qi = h.qi - i group by h.fund, h.qi, h.rk, h.security""")
def _(p):
    ranked = xsec.top_n(p["holdings"], "position_value", 10**6, ["fund", "qi"], "security")
    t = lags.panel_template(ranked, *FS, "rank", ["shares"], 3, 3)
    text = F.array_join(F.transform("shares", lambda x: F.coalesce(x.cast("int").cast("string"), F.lit("-"))), ",")
    return t.select("fund", "qi", "slot", "security", F.array_join(F.transform("mask", lambda x: x.cast("string")), "").alias("mask"), text.alias("shares"))


@query("w19_month_end", "select o_custkey, cast(max(o_orderdate) as date) as day, last_day(max(o_orderdate)) as month_end from {orders} group by o_custkey, date_trunc('month', o_orderdate)")
def _(p):
    o = p["orders"].select("o_custkey", F.to_date("o_orderdate").alias("day")).distinct()
    return lags.month_end(o, "o_custkey", "day")


@query("w20_fund_rank", """
    with a as (select fund, security, qi, cast(row_number() over (partition by fund, qi order by position_value desc, security) as int) as rank from {holdings})
    select *, rank - max(rank) over (partition by fund, security order by qi range between 1 preceding and 1 preceding) as rank_chg from a""")
def _(p):
    return lags.fund_rank(p["holdings"].select("fund", "security", "qi", "position_value"), *FS, "position_value").drop("position_value")


@query("t1_bucket_random", """
    with a as (select security, qi, row_number() over (partition by qi order by trades, md5('0:' || security), security) as r, count(*) over (partition by qi) as m from {stocks}) select security, qi, """ + bucket_sql("r", "m", 5) + " as bucket from a")
def _(p):
    return xsec.bucket(p["stocks"], "trades", 5, ["qi"], "security").select("security", "qi", "bucket")


@query("t1_bucket_average", """
    with a as (select security, qi, rank() over (partition by qi order by trades) + (count(*) over (partition by qi, trades) - 1) / 2 as r from {stocks}), e as (select qi, list_distinct(quantile_cont(r, [0, 0.2, 0.4, 0.6, 0.8, 1.0])) as e from a group by qi),
      s as (select qi, list_sort(e) as e from e)
    select security, qi, cast(len(list_filter(e[2:len(e) - 1], lambda x: r > x)) as int) as bucket from a join s using (qi)""")
def _(p):
    return xsec.bucket(p["stocks"], "trades", 5, ["qi"], "security", "average").select("security", "qi", "bucket")


@query("t2_top_bottom", """
    with a as (select security, day, row_number() over (partition by day order by ret desc, security) as t, row_number() over (partition by day order by ret, security desc) as b from {daily})
    select security, day, 'top' as leg from a where t <= 5 union all select security, day, 'bottom' from a where b <= 5""")
def _(p):
    return xsec.top_bottom(p["daily"], "ret", 5, ["day"], "security").select("security", "day", "leg")


@query("t3_tails", """
    with a as (select security, qi, (rank() over (partition by qi order by trades) + (count(*) over (partition by qi, trades) - 1) / 2) / count(*) over (partition by qi) as p from {stocks}) select security, qi, case when p >= 0.9 then 'high' else 'low' end as tail from a where p >= 0.9 or p <= 0.1""")
def _(p):
    return xsec.tails(p["stocks"], "trades", 0.1, ["qi"]).select("security", "qi", "tail")


@query("t3_tail_count", """
    with a as (select security, qi, row_number() over (partition by qi order by ret desc, security) as r, count(*) over (partition by qi) as n from {stocks}) select security, qi from a where r <= ceil(n * 0.1)""")
def _(p):
    return xsec.tail_count(p["stocks"], "ret", 0.1, ["qi"], "security").select("security", "qi")


@query("t4_decile_profile", """
    with a as (select tax, row_number() over (partition by qi order by ret, security) as r, count(*) over (partition by qi) as n from {stocks}), b as (select cast(least(floor(r * 10 / n) + 1, 10) as int) as decile, tax from a)
    select decile, round(avg(tax), 6) as mean, round(stddev_samp(tax), 6) as std, count(*) as count from b group by decile""")
def _(p):
    return rounded(xsec.decile_profile(p["stocks"], "ret", "tax", ["qi"], "security"))


@query("t5_quantile_legs", """
    with a as (select security, qi, row_number() over (partition by qi order by ret, security) as r, count(*) over (partition by qi) as n from {stocks})
    select security, qi, case when r >= 1 + (n - 1) * (1 - 1 / 10) then 'long' when r <= 1 + (n - 1) * (1 / 10) then 'short' end as leg from a""")
def _(p):
    return xsec.quantile_legs(p["stocks"], "ret", 10, ["qi"], "security").select("security", "qi", "leg")


@query("t6_size_groups", """
    with q as (select qi, quantile_cont(market_cap, [0.2, 0.5, 0.8]) as q from {stocks} group by qi) select security, qi, case when market_cap <= q[1] then 'micro' when market_cap <= q[2] then 'small' when market_cap <= q[3] then 'mid' else 'large' end as size_group from {stocks} join q using (qi)""")
def _(p):
    return xsec.size_groups(p["stocks"], "market_cap", ["qi"]).select("security", "qi", "size_group")


@query("t7_pct_bucket", """
    select security, qi, cast(ceil(row_number() over (partition by qi order by ret, security) * 4 / count(*) over (partition by qi)) - 1 as int) as pct_bucket from {stocks}""")
def _(p):
    return xsec.pct_bucket(p["stocks"], "ret", 4, ["qi"], "security").select("security", "qi", "pct_bucket")


@query("t8_top_n", "select fund, qi, security, cast(r as int) as rank from (select *, row_number() over (partition by fund, qi order by position_value desc, security) as r from {holdings}) where r <= 5")
def _(p):
    return xsec.top_n(p["holdings"], "position_value", 5, ["fund", "qi"], "security").select("fund", "qi", "security", "rank")


@query("e7_xs_residual", """
    with a as (select qi, regr_slope(ret, ln(trades)) as b, regr_intercept(ret, ln(trades)) as a, count(*) as n from {stocks} group by qi) select security, qi, round(case when n >= 30 then ret - a - b * ln(trades) end, 6) as resid, round(abs(case when n >= 30 then ret - a - b * ln(trades) end), 6) as abs_resid from {stocks} join a using (qi)""")
def _(p):
    s = p["stocks"].withColumn("lt", F.log("trades"))
    return rounded(xsec.xs_residual(s, "ret", "lt", ["qi"]).select("security", "qi", "resid", "abs_resid"))


@query("p21_transform_target", """
    select security, qi, round((rank() over (partition by qi order by ret) + (count(*) over (partition by qi, ret) - 1) / 2) / count(*) over (partition by qi) - 0.5, 8) as ret from {stocks}""")
def _(p):
    return rounded(xsec.transform_target(p["stocks"].select("security", "qi", "ret"), "ret", ["qi"], "rank"), 8)


@query("u3_grid", "select qi, n, flag, count(*) as rows from {stocks}, (values (3), (5)) a(n), (values (true), (false)) b(flag) group by qi, n, flag")
def _(p):
    cells = joins.grid(p.spark, n=[3, 5], flag=[True, False]).withColumn("n", F.col("n").cast("int"))
    return joins.apply_grid(p["stocks"], cells).groupBy("qi", "n", "flag").agg(F.count("*").alias("rows"))


@query("j3_attach", "select h.fund, h.qi, count(*) as n, count(s.ret) as matched, round(sum(s.ret), 9) as total from {holdings} h left join {stocks} s on s.security = h.security and s.qi = h.qi group by h.fund, h.qi")
def _(p):
    out = joins.attach(p["holdings"], p["stocks"].select("security", "qi", "ret"), SQ)
    return rounded(out.groupBy("fund", "qi").agg(F.count("*").alias("n"), F.count("ret").alias("matched"), F.sum("ret").alias("total")), 9)


@query("j13_expand_holdings", """
    with d as (select day, cast(row_number() over (order by day) - 1 as int) as date_no from (select distinct day from {daily})) select e.security, d.date_no, d.day from (select distinct security, 3 as start_no from {daily}) e join d on d.date_no between e.start_no and e.start_no + 4""")
def _(p):
    calendar = clean.dense_index(p["daily"].select("day").distinct(), "day", "date_no")
    events = p["daily"].select("security").distinct().withColumn("start_no", F.lit(3))
    return joins.expand_holdings(events, calendar, 5).select("security", "date_no", "day")
