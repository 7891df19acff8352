"""Functions of flat array columns that hold a grid in row order: levels, roughness, spikes, smoothing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, computing ``value`` once a row although lambdas inside use it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def to_array(columns: Sequence[str]) -> Column:
    """Scalar columns as one array of doubles."""
    return F.array(*[F.col(c).cast("double") for c in columns])


def is_complete(a: Column, n: int) -> Column:
    """The array has ``n`` finite cells."""
    return F.coalesce((F.size(a) == n) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def array_sum(a: Column) -> Column:
    """Sum of the cells, nulls left out."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0)))


def array_mean(a: Column) -> Column:
    """Mean of the cells that are not null."""
    return _let(F.array_compact(a), lambda b: array_sum(b) / F.nullif(F.size(b), F.lit(0)))


def array_std(a: Column) -> Column:
    """Population deviation of the cells that are not null."""

    def of(b: Column) -> Column:
        return _let(array_mean(b), lambda m: F.sqrt(array_sum(F.transform(b, lambda x: (x - m) * (x - m))) / F.nullif(F.size(b), F.lit(0))))

    return _let(F.array_compact(a), of)


def array_median(a: Column) -> Column:
    """Median of the cells that are not null; the mean of the middle two of an even number."""

    def of(s: Column) -> Column:
        n = F.size(s)
        low, high = F.floor((n - 1) / F.lit(2)).cast("int"), F.floor(n / F.lit(2)).cast("int")
        return (F.get(s, low).cast("double") + F.get(s, high).cast("double")) / 2

    return _let(F.sort_array(F.array_compact(a)), of)


def surface_stats(a: Column, low: float = 0.02, high: float = 1.5) -> Column:
    """Struct of level (mean), dispersion (deviation), cov and extreme (share of cells outside the plausible range ``low`` to ``high``)."""

    def of(b: Column) -> Column:
        outside = F.size(F.filter(b, lambda x: (x < low) | (x > high))) / F.nullif(F.size(F.array_compact(b)), F.lit(0))
        return _let(
            F.struct(array_mean(b).alias("m"), array_std(b).alias("s")),
            lambda p: F.struct(p["m"].alias("level"), p["s"].alias("dispersion"), (p["s"] / F.nullif(F.abs(p["m"]), F.lit(0.0))).alias("cov"), outside.alias("extreme")),
        )

    return _let(a, of)


def _cells(h: int, w: int, body: Callable[[Column, Column], Column]) -> Column:
    """An array over the cells of an h x w grid: ``body(row, column)``."""
    return F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda i: body(F.floor(i / F.lit(w)).cast("int"), F.pmod(i, F.lit(w))))


def surface_roughness(a: Column, h: int, w: int, order: Sequence[int] | None = None) -> Column:
    """Struct of laplacian (root mean square of the second differences in both directions, inside the grid),
    variation (mean absolute first difference across plus that down) and calendar (root mean square second
    difference down the columns). ``order`` lists the columns in the order of the strike, for the first two."""
    of_column = (lambda c: F.array(*map(F.lit, order))[c]) if order else (lambda c: c)
    plain = lambda b, r, c: F.get(b, r * w + c).cast("double")
    at = lambda b, r, c: plain(b, r, of_column(c))
    rms = lambda cells: F.sqrt(array_mean(F.transform(cells, lambda x: x * x)))

    def of(b: Column) -> Column:
        inner = _cells(h - 2, w - 2, lambda r, c: at(b, r, c + 1) + at(b, r + 2, c + 1) + at(b, r + 1, c) + at(b, r + 1, c + 2) - 4 * at(b, r + 1, c + 1))
        across = _cells(h, w - 1, lambda r, c: F.abs(at(b, r, c + 1) - at(b, r, c)))
        down = _cells(h - 1, w, lambda r, c: F.abs(at(b, r + 1, c) - at(b, r, c)))
        bend = _cells(h - 2, w, lambda r, c: plain(b, r, c) + plain(b, r + 2, c) - 2 * plain(b, r + 1, c))
        return F.struct(rms(inner).alias("laplacian"), (array_mean(across) + array_mean(down)).alias("variation"), rms(bend).alias("calendar"))

    return _let(a, of)


def surroundings(h: int, w: int, order: Sequence[int] | None) -> list[list[int]]:
    """For each cell the places of its 3 x 3 surroundings, row by row; beyond the border the nearest cell stands again.

    ``order`` lists the columns in the order of the strike: left and right are neighbours in that order.
    """
    strike = list(order) if order is not None else list(range(w))
    if sorted(strike) != list(range(w)):
        raise ValueError("order must name every column once")
    place = {c: k for k, c in enumerate(strike)}
    inside = lambda x, n: min(max(x, 0), n - 1)
    return [[inside(r + i, h) * w + strike[inside(place[c] + j, w)] for i in (-1, 0, 1) for j in (-1, 0, 1)] for r in range(h) for c in range(w)]


def _table(rows: Sequence[Sequence[int]]) -> Column:
    """Places as a constant array of structs c0, c1, .."""
    return F.array(*[F.struct(*[F.lit(x).alias(f"c{k}") for k, x in enumerate(row)]) for row in rows])


def neighbour_median(a: Column, h: int, w: int, order: Sequence[int] | None = None) -> Column:
    """Array of the medians of each cell's 3 x 3 surroundings, the border repeated outwards, nulls left out; ``order`` lists the columns in the order of the strike."""
    near = F.array(*[F.array(*map(F.lit, n)) for n in surroundings(h, w, order)])
    cells = lambda b, p: F.transform(p, lambda i: F.get(b, i).cast("double"))

    def of(b: Column) -> Column:
        whole = F.transform(near, lambda p: F.get(F.sort_array(cells(b, p)), F.lit(4)))
        return F.when(F.forall(b, lambda x: x.isNotNull()), whole).otherwise(F.transform(near, lambda p: array_median(cells(b, p))))

    return _let(a, of)


def _robust_scale(b: Column) -> Column:
    """1.4826 times the median distance of the cells from their median, which is never 0."""
    return _let(array_median(b), lambda m: (array_median(F.transform(b, lambda x: F.abs(x - m))) + 1e-6) * 1.4826)


def surface_spike(a: Column, h: int, w: int, k: float = 4.0, order: Sequence[int] | None = None) -> Column:
    """Struct of spikes (cells further than ``k`` robust scales of the grid from the median of their surroundings) and worst (the largest such distance in scales); ``order`` as in ``neighbour_median``."""

    def of(b: Column) -> Column:
        z = _let(_robust_scale(b), lambda s: F.zip_with(b, neighbour_median(b, h, w, order), lambda x, m: F.abs(x - m) / s))
        return _let(z, lambda z: F.struct(F.size(F.filter(z, lambda x: x > k)).alias("spikes"), F.array_max(z).alias("worst")))

    return _let(a, of)


def spike_repair(a: Column, h: int, w: int, k: float = 4.0, order: Sequence[int] | None = None) -> Column:
    """The grid with spiking cells replaced by the median of their surroundings; cells keep their places, ``order`` says which are neighbours."""
    return _let(a, lambda b: _let(_robust_scale(b), lambda s: F.zip_with(b, neighbour_median(b, h, w, order), lambda x, m: F.when(F.abs(x - m) > k * s, m).otherwise(x.cast("double")))))


def smooth(a: Column, h: int, w: int, strength: float = 0.5, kernel: str = "box", order: Sequence[int] | None = None) -> Column:
    """The grid mixed with its 3 x 3 weighted mean, the border repeated outwards; kernel 'box' or 'gaussian' (1-2-1 twice); ``order`` as in ``spike_repair``."""
    weights = {"box": [1] * 9, "gaussian": [1, 2, 1, 2, 4, 2, 1, 2, 1]}[kernel]
    near = _table(surroundings(h, w, order))

    def of(b: Column) -> Column:
        value = lambda p, k: F.get(b, p[f"c{k}"]).cast("double")
        return F.transform(near, lambda p: (1 - strength) * value(p, 4) + strength * sum((value(p, k) * weights[k] for k in range(1, 9)), value(p, 0) * weights[0]) / sum(weights))

    return _let(a, of)


def image_metrics(a: Column, h: int, w: int, ph: int, vh: int) -> Column:
    """Struct for a 0/1 image with prices in its first ``ph`` rows and volume in its last ``vh``: white, price_white (shares),
    blank_columns (share of columns without a white price pixel), extent (share of price rows with one), balance (white volume over white price pixels)."""

    def of(b: Column) -> Column:
        price, volume = F.slice(b, 1, ph * w), F.slice(b, (h - vh) * w + 1, vh * w)
        rows = F.transform(F.sequence(F.lit(0), F.lit(ph - 1)), lambda r: array_sum(F.slice(b, r * w + 1, w)))
        columns = F.transform(F.sequence(F.lit(0), F.lit(w - 1)), lambda c: array_sum(F.transform(F.sequence(F.lit(0), F.lit(ph - 1)), lambda r: F.get(b, r * w + c).cast("double"))))
        return F.struct(
            (array_sum(b) / (h * w)).alias("white"), (array_sum(price) / (ph * w)).alias("price_white"), (F.size(F.filter(columns, lambda x: x <= 0)) / w).alias("blank_columns"),
            (F.size(F.filter(rows, lambda x: x > 0)) / ph).alias("extent"), (array_sum(volume) / (array_sum(price) + 1e-9)).alias("balance"),
        )

    return _let(a, of)


def despeckle(a: Column, h: int, w: int) -> Column:
    """The 0/1 image without white pixels none of whose four neighbours (above, below, left, right) is white."""
    here = [(r, c) for r in range(h) for c in range(w)]
    beside = F.array(*[F.array(*[F.lit(x * w + y) for x, y in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)) if 0 <= x < h and 0 <= y < w]) for r, c in here])

    def of(b: Column) -> Column:
        return F.zip_with(b, beside, lambda x, near: F.when((x > 0) & ~F.exists(near, lambda i: F.get(b, i) > 0), 0.0).otherwise(x.cast("double")))

    return _let(a, of)
