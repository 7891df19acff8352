"""SQL of walk-forward least squares: normal equations of the standardised features, solved by elimination in one SELECT a step."""

from __future__ import annotations

from collections.abc import Sequence

#: The folds of the model queries: 16 quarters of which the last 6 are tested, moved by 6.
FOLDS = "folds as (select i as fold, lo + 6 * i as train_lo, lo + 6 * i + 9 as train_hi, lo + 6 * i + 10 as test_lo, lo + 6 * i + 15 as test_hi from (select min(qi) as lo, max(qi) as hi from {stocks}) b, range(1000) t(i) where lo + 6 * i + 15 <= hi)"


def least_squares_sql(name: str, source: str, folds: str, features: Sequence[str], target: str, alpha: float, period: str = "qi", end: str | None = None, by: str = "", keep: str = "*") -> str:
    """CTEs that end in ``name``: ``keep`` of the test rows of ``source``, fold and y_pred. Features have no nulls; ``by`` is a stratum."""
    p, own = len(features), f", {by}" if by else ""
    x, both = [f"cast({f} as double)" for f in features], (f"fold, {by}" if by else "fold")
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    out = [f"{name}_t as (select f.fold{own}, " + ", ".join(f"{c} as x{i}" for i, c in enumerate(x)) + f", cast({target} as double) as y from {source} join {folds} f on {period} between train_lo and train_hi and {end or period} <= train_hi where {target} is not null)"]
    out.append(f"{name}_m as (select {both}, avg(y) as my, " + ", ".join(f"avg(x{i}) as m{i}, stddev_pop(x{i}) as s{i}" for i in range(p)) + f" from {name}_t group by {both})")
    out.append(f"{name}_g0 as (select {both}, " + ", ".join(f"sum((x{i} - m{i}) / s{i} * ((x{j} - m{j}) / s{j})) + {alpha if i == j else 0} as a{i}_{j}" for i, j in pairs) + ", " + ", ".join(f"sum((x{i} - m{i}) / s{i} * (y - my)) as b{i}" for i in range(p)) + f" from {name}_t join {name}_m using ({both}) group by {both})")
    for k in range(p - 1):
        rest = [f"a{i}_{j} - a{k}_{i} * a{k}_{j} / a{k}_{k} as a{i}_{j}" if i > k else f"a{i}_{j}" for i, j in pairs] + [f"b{i} - a{k}_{i} * b{k} / a{k}_{k} as b{i}" if i > k else f"b{i}" for i in range(p)]
        out.append(f"{name}_g{k + 1} as (select {both}, {', '.join(rest)} from {name}_g{k})")
    last = f"{name}_g{p - 1}"
    for k in reversed(range(p)):
        out.append(f"{name}_w{k} as (select *, (b{k}" + "".join(f" - a{k}_{j} * w{j}" for j in range(k + 1, p)) + f") / a{k}_{k} as w{k} from {last})")
        last = f"{name}_w{k}"
    score = "my" + "".join(f" + w{i} * ({c} - m{i}) / s{i}" for i, c in enumerate(x))
    on = f" and s.{by} = w.{by}" if by else ""
    join = f"join {name}_m m using (fold)" if not by else f"join {name}_m m on m.fold = f.fold and m.{by} = s.{by}"
    weights = f"join {last} w using (fold)" if not by else f"join {last} w on w.fold = f.fold{on}"
    picked = ", ".join(f"s.{c}" for c in keep.split(", ")) if keep != "*" else "s.*"
    out.append(f"{name} as (select {picked}, f.fold, {score} as y_pred from {source} s join {folds} f on {period} between test_lo and test_hi {weights} {join})")
    return ", ".join(out)


def ic_sql(source: str, keys: str, score: str, ret: str) -> str:
    """A SELECT of keys and rank_ic of a relation; null under 10 rows or without spread."""
    return f"""select {keys}, case when count(*) >= 10 and stddev_samp({score}) > 0 and stddev_samp({ret}) > 0 then corr(a, b) end as rank_ic from (
      select *, rank() over (partition by {keys} order by {score}) + (count(*) over (partition by {keys}, {score}) - 1) / 2 as a, rank() over (partition by {keys} order by {ret}) + (count(*) over (partition by {keys}, {ret}) - 1) / 2 as b
      from {source} where {score} is not null and {ret} is not null) r group by {keys}"""


def score_rows_sql(source: str, keys: str, lags: tuple[str, int] | int = 0, horizon: str = "1") -> str:
    """CTEs ics, sps and prints, and a SELECT of the score rows of ``source`` (keys, security, qi, y_pred, y, ret)."""
    from .queries_signals import nw_sql, spread_sql

    head = keys.split(", ")
    using = ", ".join(head)
    return f"""ic as ({ic_sql(source, f'{keys}, qi', 'y_pred', 'y')}), ics as ({nw_sql('ic', keys, 'rank_ic')}), sp as ({spread_sql(source, 'y_pred', 'ret', keys=keys)}), sps as ({nw_sql('sp', keys, 'ret', lags)}),
    prints as (select {keys}, count(*) as rows, (sum(('0x' || substr(md5(security || '|' || qi), 1, 8))::bigint) % 4294967296)::bigint as fingerprint from {source} where y_pred is not null and y is not null group by {keys}),
    scores as (select {using}, sps.n as periods, ics.mean as ic, ics.t as ic_t, sps.mean / ({horizon}) as spread, sps.t as spread_t, rows, fingerprint from prints left join ics using ({using}) left join sps using ({using}))"""
