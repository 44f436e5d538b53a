"""Trend times seasons on the natural scale: y = trend x (1 + season) + noise.

Fitted by alternating least squares: the weights of one side are solved for while the other is held. All that
the half steps need are sums of products over the distributed hours, taken in one pass; their number
depends on the form of the model alone.
"""

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peagelens.functions.calendar import epoch_days
from peagelens.operators.features import fourier_features
from peagelens.operators.numeric import (
    CHANGEPOINT_PRIOR,
    CHANGEPOINT_RANGE,
    CHANGEPOINTS,
    SEASON_PRIOR,
    ProductSums,
    held_weights,
    place_bends,
    product_sums,
)

#: Rounds of both half steps: those that may still move bends, and all.
PLACING, ROUNDS = 5, 1_000
#: The fit has settled when a round moves no weight by more than this share of the largest.
SETTLED = 1e-8

Seasons = Sequence[tuple[str, float, int]]


@dataclass(frozen=True)
class ProductModel:
    """``trend`` is level and slope over the history; ``bends`` are (place, change of slope); ``waves`` the season."""

    start: float
    length: float
    trend: tuple[float, float]
    bends: tuple[tuple[float, float], ...]
    seasons: tuple[tuple[str, float, int], ...]
    waves: tuple[float, ...]
    noise: float = 0.0

    @property
    def bend_rate(self) -> float:
        """Bends an hour in the part of the history that may have them."""
        return len(self.bends) / (self.length * 24.0 * CHANGEPOINT_RANGE)

    @property
    def bend_size(self) -> float:
        """Mean size of a bend: the change of slope, an hour."""
        if not self.bends:
            return 0.0
        return float(np.mean([abs(change) for _, change in self.bends])) / (self.length * 24.0)


def product_parts(rows: DataFrame, model: ProductModel, at: str = "ds") -> DataFrame:
    """Adds ``trend``, ``season`` (a share of the trend) and ``yhat``, as column expressions."""
    when = (epoch_days(F.col(at)) - model.start) / model.length
    level, slope = model.trend
    trend = F.lit(level) + when * slope
    for place, change in model.bends:
        trend += F.greatest(when - place, F.lit(0.0)) * change
    wide = fourier_features(rows, at, model.seasons)
    season: Column = F.lit(0.0)
    for name, weight in zip(wide.columns[len(rows.columns) :], model.waves):
        season += F.col(name) * weight
    parts = wide.withColumns({"trend": trend, "season": season})
    return parts.select(*rows.columns, "trend", "season", (F.col("trend") * (1.0 + F.col("season"))).alias("yhat"))


def fit_product(series: DataFrame, seasons: Seasons) -> ProductModel | None:
    """The model of a series ``ds, y``, gaps allowed; None without hours that have a known y.

    Priors are those of the additive models: normal on level, slope and waves, Laplace on bends. The first rounds
    choose the bends, later ones only their sizes. The hours are read twice, for their range and for the sums;
    with three seasons of 17 waves and 25 bends some 240,000 sums come to the driver, however long the series.
    Settle the series first.
    """
    known = series.where(F.col("ds").isNotNull() & F.col("y").isNotNull())
    days = epoch_days(F.col("ds"))
    shape = known.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(days).alias("start"),
        F.max(days).alias("end"),
        F.greatest(F.max(F.abs("y")).cast("double"), F.lit(1.0)).alias("scale"),
    ).first()
    if not shape.n:
        return None
    length = max(shape.end - shape.start, 1.0 / 24)
    count = min(CHANGEPOINTS, shape.n - 1)
    places = np.linspace(0, CHANGEPOINT_RANGE, count + 1)[1:]
    t = (days - shape.start) / length
    bends = [F.greatest(t - float(place), F.lit(0.0)) for place in places]
    wide = fourier_features(known.select("ds", "y"), "ds", seasons)
    n_waves = len(wide.columns) - 2
    design = wide.select(
        (F.col("y") / shape.scale).alias("y"),
        F.array(F.lit(1.0), t, *bends).alias("trend"),
        F.array(*wide.columns[2:]).cast("array<double>").alias("waves"),
    )
    parts = design.mapInPandas(product_sums, "row int, sums array<double>")
    # As decimals the sums do not depend on the order in which the tasks' shares are added.
    share = F.sum(F.col("s").cast("decimal(28,18)")).cast("double")
    cells = parts.select("row", F.posexplode("sums").alias("at", "s")).groupBy("row", "at").agg(share.alias("s"))
    sums = ProductSums(shape.n, 2 + count, n_waves)
    found = cells.toPandas()
    for row, at, s in zip(found["row"], found["at"], found["s"]):
        sums.put(row, at, s)
    trend, waves, noise = _alternate(sums, count, n_waves)
    trend = trend * shape.scale
    return ProductModel(
        shape.start,
        length,
        (float(trend[0]), float(trend[1])),
        tuple((float(p), float(b)) for p, b in zip(places, trend[2:]) if b),
        tuple(seasons),
        tuple(map(float, waves)),
        noise * shape.scale,
    )


def _alternate(sums: ProductSums, count: int, n_waves: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of both sides and the noise."""
    trend, waves, bends, noise = np.zeros(2 + count), np.zeros(n_waves), np.zeros(0, int), 0.1
    for step in range(ROUNDS):
        before = np.concatenate([trend, waves])
        gram, moment = sums.for_trend(waves)
        if step < PLACING:
            bends, noise = place_bends(gram, moment, count, 0, lambda beta: sums.noise(beta, waves))  # noqa: B023
        penalty = np.full(len(bends), noise**2 / CHANGEPOINT_PRIOR)
        trend = held_weights(gram, moment, count, 0, bends, penalty, noise)
        if n_waves:
            gram, moment = sums.for_season(trend)
            waves = np.linalg.solve(gram + np.eye(n_waves) * noise**2 / SEASON_PRIOR**2, moment)
        noise = sums.noise(trend, waves)
        now = np.concatenate([trend, waves])
        if step > PLACING and np.abs(now - before).max() <= SETTLED * np.abs(now).max():
            break
    return trend, waves, noise
