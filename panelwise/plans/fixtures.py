"""Panels over the test tables, in SQL that Spark and DuckDB share; the queries and their oracles start from them."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    # last holding of each fund, security and quarter
    "holdings": """
        select fund, security, day, qi, shares, position_value from (
          select l_suppkey as fund, p_brand || '|' || p_type as security, cast(l_shipdate as date) as day,
            cast(year(l_shipdate) * 4 + quarter(l_shipdate) as int) as qi, l_quantity as shares, l_extendedprice as position_value,
            row_number() over (partition by l_suppkey, p_brand || '|' || p_type, year(l_shipdate) * 4 + quarter(l_shipdate)
              order by l_shipdate desc, l_orderkey desc, l_linenumber desc, l_extendedprice desc) as rn
          from {lineitem} join {part} on l_partkey = p_partkey) x where rn = 1""",
    # the same with the brand as the security: fewer gaps
    "dense": """
        select fund, security, day, qi, shares, position_value from (
          select l_suppkey as fund, p_brand as security, cast(l_shipdate as date) as day,
            cast(year(l_shipdate) * 4 + quarter(l_shipdate) as int) as qi, l_quantity as shares, l_extendedprice as position_value,
            row_number() over (partition by l_suppkey, p_brand, year(l_shipdate) * 4 + quarter(l_shipdate)
              order by l_shipdate desc, l_orderkey desc, l_linenumber desc, l_extendedprice desc) as rn
          from {lineitem} join {part} on l_partkey = p_partkey) x where rn = 1""",
    "stocks": """
        select p_brand || '|' || p_type as security, cast(year(l_shipdate) * 4 + quarter(l_shipdate) as int) as qi,
          round(1000 * avg(p_retailprice) * (1 + 0.01 * (max(year(l_shipdate) * 4 + quarter(l_shipdate)) % 7)), 6) as market_cap,
          round(avg(l_discount) - 0.05, 9) as ret, round(avg(l_tax), 9) as tax, count(*) as trades
        from {lineitem} join {part} on l_partkey = p_partkey group by p_brand || '|' || p_type, year(l_shipdate) * 4 + quarter(l_shipdate)""",
    # holdings with the figures of their security and quarter, by windows: one scan, and one shuffle by security and quarter
    "book": """
        select fund, security, day, qi, shares, position_value, market_cap, ret, tax, case when fund % 3 = 0 then 401 else 402 end as inv_type, fund % 10 <> 0 as is_us, cast(fund % 3 as int) as fund_size from (
          select fund, security, day, qi, shares, position_value,
            round(1000 * avg(price) over (partition by security, qi) * (1 + 0.01 * (qi % 7)), 6) as market_cap, round(avg(discount) over (partition by security, qi) - 0.05, 9) as ret, round(avg(tax) over (partition by security, qi), 9) as tax,
            row_number() over (partition by security, qi, fund order by day desc, l_orderkey desc, l_linenumber desc, position_value desc) as rn
          from (select l_suppkey as fund, p_brand || '|' || p_type as security, cast(l_shipdate as date) as day, cast(year(l_shipdate) * 4 + quarter(l_shipdate) as int) as qi, l_quantity as shares, l_extendedprice as position_value,
              p_retailprice as price, l_discount as discount, l_tax as tax, l_orderkey, l_linenumber from {lineitem} join {part} on l_partkey = p_partkey) x) y where rn = 1""",
    "daily": """
        select user_id as security, cast(ts as date) as day, round((avg(value) - 50) / 1000, 9) as ret, count(*) as turnover, 1 + user_id as market_cap
        from {events} group by user_id, cast(ts as date)""",
    "market": """
        select cast(o_orderdate as date) as day, round(avg(o_totalprice), 6) as level from {orders} group by cast(o_orderdate as date)""",
    # oracles only: what the operators derive from the book
    "sql_weighted": """
        select *, position_value / sum(position_value) over (partition by fund, qi) as weight, market_cap / sum(market_cap) over (partition by fund, qi) as market_weight,
          position_value / sum(position_value) over (partition by fund, qi) - market_cap / sum(market_cap) over (partition by fund, qi) as active_weight from {book}""",
    "sql_grid": """
        select coalesce(n.fund, b.fund) as fund, coalesce(n.security, b.security) as security, coalesce(n.qi, b.qi) as qi, n.fund is not null as held_now, b.fund is not null as held_prev,
          coalesce(n.aw, 0) as aw, coalesce(b.aw, 0) as aw0, coalesce(n.w, 0) as w, coalesce(b.w, 0) as w0, coalesce(n.mw, 0) as mw, coalesce(b.mw, 0) as mw0, coalesce(n.sh, 0) as sh, coalesce(b.sh, 0) as sh0
        from (select fund, security, qi, active_weight as aw, weight as w, market_weight as mw, shares as sh from {sql_weighted}) n
          full join (select fund, security, qi + 1 as qi, active_weight as aw, weight as w, market_weight as mw, shares as sh from {sql_weighted}) b on n.fund = b.fund and n.security = b.security and n.qi = b.qi
        where (coalesce(n.fund, b.fund), coalesce(n.qi, b.qi)) in (select (fund, qi) from {sql_weighted})""",
    "sql_breadth": """
        select security, qi, count(case when held_now then 1 end) as n_funds, count(*) as n_active, count(case when held_now and aw - aw0 > 0 then 1 end) as n_buy, count(case when held_prev and aw - aw0 < 0 then 1 end) as n_sell,
          count(case when held_now and aw - aw0 > 0 then 1 end) as n_buy_aw, count(case when held_now and w - w0 > 0 then 1 end) as n_buy_w, count(case when held_now and mw - mw0 > 0 then 1 end) as n_buy_mw, count(case when held_now and sh - sh0 > 0 then 1 end) as n_buy_sh,
          count(case when held_now and w > 0 then 1 end) as n_funds_w, count(case when held_now and aw > 0 then 1 end) as n_funds_aw from {sql_grid} group by security, qi""",
    "sql_panel": """
        select s.security, s.qi, s.market_cap, s.ret, s.tax, s.trades, cast(b.n_buy as double) as n_buy, b.n_funds, b.n_buy / b.n_active as frac_buy, b.n_buy - b.n_sell as net_buy,
          max(s.ret) over (partition by s.security order by s.qi range between 1 following and 1 following) as fwd_1q, max(s.ret) over (partition by s.security order by s.qi range between 2 following and 2 following) as fwd_2q
        from {stocks} s left join {sql_breadth} b on b.security = s.security and b.qi = s.qi""",
    "sql_changes": """
        select *, next_weight - weight as weight_chg, next_weight - weight * (1 + next_ret) / nullif(1 + fund_ret, 0) as drift_chg, share_chg * position_value as dollar_flow,
          case when share_chg <= -0.01 then -1 when share_chg >= 0.01 then 1 when share_chg is not null then 0 end as label from (
          select *, (next_shares - shares) / (abs(shares) + 1) as share_chg, sum(weight * next_ret) over (partition by fund, qi) / nullif(sum(case when next_ret is not null then weight end) over (partition by fund, qi), 0) as fund_ret from (
            select w.*, n.ret as next_ret, max(w.weight) over (partition by w.fund, w.security order by w.qi range between 1 following and 1 following) as next_weight,
              max(w.shares) over (partition by w.fund, w.security order by w.qi range between 1 following and 1 following) as next_shares
            from {sql_weighted} w left join {stocks} n on n.security = w.security and n.qi = w.qi + 1) x) y""",
    "surface": """
        select vec_id, label, embedding from {embeddings}""",
}
_NAME = re.compile(r"\{(\w+)\}")


class Panels:
    """The given tables and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                self._made[name] = self.spark.sql(VIEWS[name], **{n: self[n] for n in set(_NAME.findall(VIEWS[name]))})
        return self._made[name]

    @cached_property
    def weighted(self) -> DataFrame:
        """The book with weights and active weights."""
        from ..operators.holdings import active_weight

        return active_weight(self["book"])

    @cached_property
    def panel(self) -> DataFrame:
        """Securities with breadth, returns and forward returns."""
        from ..operators.holdings import buying_breadth, forward_returns

        stocks = forward_returns(self["stocks"], ["security"], "ret", (1, 2))
        return stocks.join(buying_breadth(self.weighted), ["security", "qi"], "left").withColumn("n_buy", F.col("n_buy").cast("double"))

    @cached_property
    def changes(self) -> DataFrame:
        """Positions with their changes to the next quarter."""
        from ..operators.holdings import position_changes

        following = self["stocks"].select("security", (F.col("qi") - 1).alias("qi"), F.col("ret").alias("next_ret"))
        return position_changes(self.weighted.join(following, ["security", "qi"], "left"))

    @cached_property
    def numbered(self) -> DataFrame:
        """The daily panel with market-date numbers."""
        from ..operators.rolling import number_dates

        return number_dates(self["daily"], "day")


def oracle(sql: str) -> str:
    """A statement for DuckDB: the views that ``sql`` names in braces become common table expressions ahead of it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for n in _NAME.findall(text):
            if n in VIEWS and n not in needed:
                need(VIEWS[n])
                needed.append(n)

    need(sql)
    plain = lambda text: _NAME.sub(r"\1", text)
    ctes = ",\n".join(f"{n} as ({plain(VIEWS[n])})" for n in needed)
    body = plain(sql).strip()
    if not ctes:
        return body
    for head in ("with recursive", "with"):
        if body.lower().startswith(f"{head} "):
            return f"{head} {ctes},\n{body[len(head) + 1:]}"
    return f"with {ctes}\n{body}"
