"""Mean daily correlations of all pairs of many columns, by Gram matrices of blocks.

Rows are dealt by date and pair of blocks of columns, once. A task multiplies the
values and masks of a date as matrices: their products are the sums over the
complete pairs of every two columns at once, which give that date's correlations.
What leaves a task is one row for each pair of columns, with the sum of its daily
correlations and their number. So there is one scan and one exchange of the
rows, whatever the number of columns; with more than BLOCK of them, rows are sent
once for each other block.

Sums are taken about a value near the date's mean, so they don't cancel. The
rules are those of ``pearson``: pairs with a missing value don't count, fewer
than two, no variation or an infinite value give no correlation for the date.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a block.
BLOCK = 256
#: Bytes of a date's rows that are multiplied at once.
PIECE = 32_000_000
#: Less of a column's mean square than this, among the rows of a pair, is rounding and not variation.
ROUNDING = 1e-13


class _Date:
    """Sums over the complete pairs of a date, so far."""

    def __init__(self, n: int, m: int):
        self.about: tuple[np.ndarray, np.ndarray] | None = None
        self.sums = np.zeros((6, n, m))
        self.infinite = np.zeros((n, m), bool)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        """Rows by columns of both blocks; NaN: missing."""
        if self.about is None:
            self.about = _near(x), _near(y)
        (x, there_x, bad_x), (y, there_y, bad_y) = (_centred(v, about) for v, about in zip((x, y), self.about, strict=True))
        self.sums += np.stack((there_x.T @ there_y, x.T @ there_y, there_x.T @ y, (x * x).T @ there_y, there_x.T @ (y * y), x.T @ y))
        if bad_x.any() or bad_y.any():
            self.infinite |= (bad_x.T @ (there_y + bad_y) + (there_x + bad_x).T @ bad_y) > 0

    def correlations(self) -> np.ndarray:
        n, sx, sy, sxx, syy, sxy = self.sums
        with np.errstate(all="ignore"):
            vx, vy = sxx - sx * sx / n, syy - sy * sy / n
            r = (sxy - sx * sy / n) / np.sqrt(vx * vy)
        return np.where((n >= 2) & (vx > ROUNDING * sxx) & (vy > ROUNDING * syy) & ~self.infinite, r, np.nan)


def _near(v: np.ndarray) -> np.ndarray:
    """Of each column a value about which to take sums: the mean, or the very value of a column that doesn't vary."""
    v = np.where(np.isfinite(v), v, np.nan)
    some = ~np.isnan(v)
    n = some.sum(0)
    mean = np.where(some, v, 0).sum(0) / np.maximum(n, 1)
    low = np.where(some, v, np.inf).min(0, initial=np.inf)
    return np.where((n > 0) & (low == np.where(some, v, -np.inf).max(0, initial=-np.inf)), low, mean)


def _centred(v: np.ndarray, about: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values less about, 0 where missing or infinite; which are finite; which are infinite."""
    bad, there = np.isinf(v), np.isfinite(v)
    return np.where(there, v - about, 0), there.astype(float), bad.astype(float)


def _matrix(values: pa.Array, n: int) -> np.ndarray:
    flat = values.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)


def mean_correlations(wide: DataFrame, names: list[str], block: int = BLOCK) -> DataFrame:
    """(a, b, rho) for each two of the names, a before b: the mean over dates of the columns' correlation across instruments."""
    blocks = [names[k : k + block] for k in range(0, len(names), block)]
    pairs = [(i, j) for i in range(len(blocks)) for j in range(i, len(blocks))]
    held = lambda some: F.array(*[F.col("`" + c.replace("`", "``") + "`").cast("double") for c in some])
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), held(blocks[i]).alias("x"), (held(blocks[j]) if i != j else F.lit(None).cast("array<double>")).alias("y")) for p, (i, j) in enumerate(pairs)]))
    rows = wide.select("datetime", each.alias("e")).select("datetime", "e.*").repartition("datetime", "p").sortWithinPartitions("p", "datetime")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        now: tuple | None = None
        date: _Date | None = None

        def close() -> None:
            r = date.correlations()
            known = ~np.isnan(r)
            total = totals.setdefault(now[0], np.zeros((2, *r.shape)))
            total[0] += np.where(known, r, 0)
            total[1] += known

        for batch in batches:
            days, which = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            edges = [0, *[k for k in range(1, len(days)) if days[k] != days[k - 1] or which[k] != which[k - 1]], len(days)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                i, j = pairs[int(which[a])]
                n, m = len(blocks[i]), len(blocks[j])
                if now != (int(which[a]), days[a]):
                    if date is not None:
                        close()
                    now, date = (int(which[a]), days[a]), _Date(n, m)
                step = max(1, PIECE // (8 * (n + m)))
                for c in range(a, b, step):
                    x = _matrix(batch.column(2).slice(c, min(step, b - c)), n)
                    date.add(x, x if i == j else _matrix(batch.column(3).slice(c, min(step, b - c)), m))
        if date is not None:
            close()
        for p, (total, days) in totals.items():
            i, j = pairs[p]
            left, right = np.triu_indices(len(blocks[i]), 1) if i == j else map(np.ravel, np.indices((len(blocks[i]), len(blocks[j]))))
            yield pa.RecordBatch.from_arrays([pa.array(left + i * block, pa.int32()), pa.array(right + j * block, pa.int32()), pa.array(total[left, right]), pa.array(days[left, right])], ["i", "j", "total", "days"])

    sums = rows.mapInArrow(run, "i int, j int, total double, days double").groupBy("i", "j").agg(F.sum("total").alias("total"), F.sum("days").alias("days"))
    order = F.array(*[F.lit(n) for n in names])
    name = lambda k: F.element_at(order, F.col(k) + 1)
    return sums.select(name("i").alias("a"), name("j").alias("b"), F.try_divide("total", "days").alias("rho"))
