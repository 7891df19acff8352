"""Column functions: ids, flags, numbers, calendars, labels. All stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_id(c: Column | str) -> Column:
    """Canonical id text: '10001.0', 10001 and ' 0010001 ' are '10001'; other text is trimmed.

    Whole numbers go through bigint first, so that ids above 2 ** 53 stay exact.
    """
    text = F.trim(_col(c).cast("string"))
    number = text.try_cast("double")
    whole = F.when(number == F.floor(number), number.try_cast("bigint"))
    return F.coalesce(text.try_cast("bigint").cast("string"), whole.cast("string"), text)


def to_bool(c: Column | str) -> Column:
    """True for 'true', 't', 'yes', 'y', '1' in any case and for numbers other than 0; null counts as false."""
    text = F.lower(F.trim(_col(c).cast("string")))
    return F.coalesce(text.isin("true", "t", "yes", "y") | (text.try_cast("double") != 0), F.lit(False))


def norm_text_id(c: Column | str) -> Column:
    """Trimmed, upper-case text id."""
    return F.upper(F.trim(_col(c)))


def to_num(c: Column | str) -> Column:
    """A double, null where the text is no number or not finite."""
    x = _col(c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def quarter_index(c: Column | str) -> Column:
    """year * 4 + quarter: successive quarters differ by 1 across year ends."""
    d = _col(c)
    return F.year(d) * 4 + F.quarter(d)


def month_index(c: Column | str) -> Column:
    """year * 12 + month."""
    d = _col(c)
    return F.year(d) * 12 + F.month(d)


def half_year(c: Column | str) -> Column:
    """'2024H1' for January to June, '2024H2' for the rest."""
    d = _col(c)
    return F.concat(F.year(d).cast("string"), F.when(F.month(d) <= 6, "H1").otherwise("H2"))


def trade_label(change: Column | str, band: float = 0.01) -> Column:
    """1 above the band, -1 below it, 0 inside, null for null."""
    x = _col(change)
    return F.when(x > band, 1).when(x < -band, -1).when(x.isNotNull(), 0)


def signed_log(c: Column | str) -> Column:
    """log(|x| + 1)."""
    return F.log1p(F.abs(_col(c)))


def clip(c: Column | str, low: Column | float, high: Column | float) -> Column:
    """``c`` within limits; null stays null."""
    x = _col(c)
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(x.isNotNull(), F.greatest(F.least(x, as_col(high)), as_col(low)))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0."""
    return _col(a) / F.nullif(_col(b).cast("double"), F.lit(0.0))


def illiquidity(ret: Column | str, dollar_volume: Column | str) -> Column:
    """log1p of |return| per million of dollar volume."""
    return F.log1p(F.abs(_col(ret)) * 1e6 / F.nullif(_col(dollar_volume), F.lit(0.0)))


def days_to_liquidate(shares: Column | str, volume: Column | str, share: float = 0.25, most: float = 250.0) -> Column:
    """Days to sell a position at ``share`` of daily volume, ``most`` at most."""
    return F.least(F.abs(_col(shares)) / F.nullif(_col(volume) * share, F.lit(0.0)), F.lit(most))


def log_return(c: Column | str) -> Column:
    """log(1 + r) for r above -1; null for a total loss or an invalid return, which the callers count."""
    r = _col(c)
    return F.when(r > -1, F.log1p(r))


def compounded(valid_count: Column, total_losses: Column, log_sum: Column, needed: Column | int) -> Column:
    """Compound return from its parts: null unless all ``needed`` returns are valid, -1 after a total loss."""
    n = needed if isinstance(needed, Column) else F.lit(needed)
    return F.when(valid_count == n, F.when(total_losses > 0, F.lit(-1.0)).otherwise(F.expm1(F.coalesce(log_sum, F.lit(0.0)))))


def parse_gate(name: str) -> tuple[float, float]:
    """'gate_15_25' is (15.0, 25.0); raises for other text."""
    import re

    m = re.fullmatch(r"gate_(-?\d+(?:\.\d+)?)_(-?\d+(?:\.\d+)?)", name)
    if not m or float(m[1]) > float(m[2]):
        raise ValueError(f"no gate: {name!r}")
    return float(m[1]), float(m[2])


def corr(a: Column | str, b: Column | str, over=None) -> Column:
    """Correlation of the rows where both are present, null where either has no spread; over a window on demand."""
    x, y = _col(a), _col(b)
    w = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    spread = w(F.stddev_pop(F.when(y.isNotNull(), x))) * w(F.stddev_pop(F.when(x.isNotNull(), y)))
    return w(F.covar_pop(x, y)) / F.when(spread > 0, spread)
