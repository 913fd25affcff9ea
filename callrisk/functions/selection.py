"""Exact order statistics of whole columns by bracketing, with aggregates alone.

Every pass is one aggregate over the table, all columns side by side: no unpivot, no range shuffle, no
checkpoint.  A pass asks a bounded sketch (``percentile_approx``) for values just below and above each wanted
rank, the next counts exactly how many rows lie below and at these values; so the rank is either found, or it
lies strictly between two values whose counts are known.  The few values between them are collected once the
sketch's error bound says that they are at most ``COLLECT``; otherwise the sketch looks at that interval
alone, which shrinks it by about the sketch's accuracy each time.  Results never depend on the sketch's
quality, only the number of passes does: two up to about 50 million rows, one or two more beyond.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rank error of the sketch is at most rows / ACCURACY.
ACCURACY = 10_000
#: Values of one interval that may be collected.
COLLECT = 20_000
#: Bracket half-width in rank errors.
WIDTH = 2


@dataclass
class Wanted:
    """One rank (0-based) of a column, and the open interval it lies in: the values at both ends (None: no
    bound), the rows at or below the lower end, and the rows below the upper end."""

    column: str
    rank: int
    until: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    value: float | None = None

    @property
    def interval(self) -> tuple:
        return self.column, self.low, self.high

    def shares(self) -> list[float]:
        """Places just below and above the rank, as shares of the interval's rows."""
        n = self.until - self.below
        return _around((self.rank - self.below + 0.5) / n)

    def learn(self, value: float, less: int, upto: int) -> None:
        """Take over that ``less`` rows are below ``value`` and ``upto`` at or below it."""
        if less <= self.rank < upto:
            self.value = value
        elif upto <= self.rank and upto > self.below:
            self.low, self.below = value, upto
        elif self.rank < less < self.until:
            self.high, self.until = value, less


def _around(share: float) -> list[float]:
    return [min(1.0, max(0.0, share + d * WIDTH / ACCURACY)) for d in (-1, 1)]


def _x(column: str) -> Column:
    return F.col(column).cast("double")


def _inside(column: str, low: float | None, high: float | None) -> Column:
    """The column's values in the open interval, null elsewhere."""
    cond = _x(column).isNotNull()
    if low is not None:
        cond = cond & (_x(column) > F.lit(low))
    if high is not None:
        cond = cond & (_x(column) < F.lit(high))
    return F.when(cond, _x(column))


def _sketch(interval: tuple, shares: list[float]) -> Column:
    return F.percentile_approx(_inside(*interval), [float(s) for s in shares], ACCURACY)


def _count(df: DataFrame, wanted: list[Wanted], seen: dict[tuple, tuple[list[float], list[float], int]]) -> None:
    """One pass: exact counts at all sketched values, and the values between two neighbouring ones where the
    error bound says that they are few.  ``seen``: interval -> shares, values, rows."""
    spots = sorted({(key[0], v) for key, (_, values, _) in seen.items() for v in values})
    gaps = sorted({(key[0], a, b) for key, (shares, values, n) in seen.items()
                   for s, t, a, b in zip(shares, shares[1:], values, values[1:])
                   if a < b and n * (t - s + 2 / ACCURACY) <= COLLECT})
    aggs = [f(c, v).alias(f"{name}{i}") for i, (c, v) in enumerate(spots)
            for name, f in (("l", lambda c, v: F.count_if(_x(c) < F.lit(v))), ("u", lambda c, v: F.count_if(_x(c) <= F.lit(v))))]
    row = df.agg(*aggs, *[F.sort_array(F.collect_list(_inside(*g))).alias(f"g{i}") for i, g in enumerate(gaps)]).first()
    counts = {spot: (row[f"l{i}"], row[f"u{i}"]) for i, spot in enumerate(spots)}
    for w in wanted:
        for i, (c, a, b) in enumerate(gaps):
            first, last = counts[c, a][1], counts[c, b][0]
            if c == w.column and first <= w.rank < last:
                w.value = row[f"g{i}"][w.rank - first]
        for (c, v), (less, upto) in counts.items():
            if c == w.column and w.value is None:
                w.learn(v, less, upto)


def _collect(df: DataFrame, wanted: list[Wanted]) -> None:
    """One pass: the values of intervals that hold few rows."""
    keys = list(dict.fromkeys(w.interval for w in wanted))
    row = df.agg(*[F.sort_array(F.collect_list(_inside(*k))).alias(f"g{i}") for i, k in enumerate(keys)]).first()
    for w in wanted:
        w.value = row[f"g{keys.index(w.interval)}"][w.rank - w.below]


def quantiles(df: DataFrame, columns: list[str], probs: dict[str, float], extra: list[Column] | None = None
              ) -> tuple[dict[str, dict], dict]:
    """({column: {"n": non-null rows, alias: linear-interpolated quantile}}, the ``extra`` aggregates).

    Columns without a value are left out.  Values are compared as doubles, NaN above all others.
    """
    extra = list(extra or [])
    if not columns:
        return {}, df.agg(*extra).first().asDict() if extra else {}
    # the first sketch needs no counts: its places are the probabilities themselves
    places = sorted({s for p in probs.values() for s in _around(p)})
    row = df.agg(*extra, *[F.count(_x(c)).alias(f"n_{i}") for i, c in enumerate(columns)],
                 *[_sketch((c, None, None), places).alias(f"q_{i}") for i, c in enumerate(columns)]).first()
    rows = {c: row[f"n_{i}"] for i, c in enumerate(columns) if row[f"n_{i}"]}
    wanted = {(c, r): Wanted(c, r, n) for c, n in rows.items() for p in probs.values()
              for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))}
    seen = {(c, None, None): (places, row[f"q_{i}"], rows[c]) for i, c in enumerate(columns) if c in rows}
    while wanted:
        _count(df, list(wanted.values()), seen)
        left = [w for w in wanted.values() if w.value is None]
        few = [w for w in left if w.until - w.below <= COLLECT]
        if few:
            _collect(df, few)
        left = [w for w in left if w.value is None]
        if not left:
            break
        keys = {w.interval: sorted({s for o in left if o.interval == w.interval for s in o.shares()}) for w in left}
        again = df.agg(*[_sketch(k, shares).alias(f"q_{i}") for i, (k, shares) in enumerate(keys.items())]).first()
        size = {w.interval: w.until - w.below for w in left}
        seen = {k: (shares, again[f"q_{i}"], size[k]) for i, (k, shares) in enumerate(keys.items())}
    out: dict[str, dict] = {}
    for c, n in rows.items():
        out[c] = {"n": n}
        for alias, p in probs.items():
            h = (n - 1) * float(p)
            lo, hi = wanted[c, math.floor(h)].value, wanted[c, math.ceil(h)].value
            out[c][alias] = lo + (hi - lo) * (h - math.floor(h))
    return out, {k: v for k, v in row.asDict().items() if not k.startswith(("n_", "q_"))}
