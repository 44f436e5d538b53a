"""Numeric helpers that run inside Spark functions on Arrow batches or on one hourly series."""

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle

from peagelens.schema import BAND_Z

# Sent to the workers with each function, so they need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEASON_PRIOR = 10.0
CHANGEPOINT_PRIOR = 0.15
BASE_PRIOR = 5.0
CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8


def kernel_sums(points: int):
    """Sums a Gaussian kernel of weighted values at grid points; one small frame per task."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(points)
        for rows in batches:
            grid = np.arange(points) * rows["_dz"].iloc[0] if len(rows) else 0.0
            for at in range(0, len(rows), 4096):
                part = rows.iloc[at : at + 4096]
                z = part["_z"].to_numpy()[:, None] - grid
                total += part["_c"].to_numpy(float) @ np.exp(-0.5 * z * z)
        yield pd.DataFrame({"point": np.arange(points, dtype="int32"), "s": total})

    return add


def _trend(t: np.ndarray, changepoints: np.ndarray) -> np.ndarray:
    bends = np.maximum(t[:, None] - changepoints[None, :], 0.0)
    return np.column_stack([np.ones_like(t), t, bends])


def _bends_alone(gram: np.ndarray, moment: np.ndarray, ridge: np.ndarray, bends: np.ndarray) -> tuple:
    """Gram matrix and moment of the bends with all other weights solved for, and what gives those back."""
    rest = np.setdiff1d(np.arange(len(moment)), bends)
    solved = np.linalg.solve(
        gram[np.ix_(rest, rest)] + np.diag(ridge[rest]), np.column_stack([gram[np.ix_(rest, bends)], moment[rest]])
    )
    across, level = solved[:, :-1], solved[:, -1]
    inner = gram[np.ix_(bends, bends)] - gram[np.ix_(bends, rest)] @ across
    return inner, moment[bends] - gram[np.ix_(bends, rest)] @ level, rest, across, level


def sparse_bends(
    gram: np.ndarray, moment: np.ndarray, ridge: np.ndarray, bends: np.ndarray, penalty: np.ndarray
) -> np.ndarray:
    """Weights with the least value of :func:`penalised`: an absolute penalty on the ``bends``, a square one on the rest.

    The rest is solved for exactly given the bends, which leaves a Gram matrix of the bends alone; coordinate
    descent on it sets one bend after the other to its best value until none moves, or until the
    bends found so far turn out to be those of the optimum.
    """
    inner, pull, rest, across, level = _bends_alone(gram, moment, ridge, bends)
    delta = np.zeros(len(bends))
    diagonal = np.maximum(np.diag(inner), 1e-12)
    for sweep in range(20_000):
        if sweep % 10 == 9:
            exact = _optimum(inner, pull, penalty, delta)
            if exact is not None:
                delta = exact
                break
        moved = 0.0
        for j in range(len(bends)):
            free = pull[j] - inner[j] @ delta + inner[j, j] * delta[j]
            value = np.sign(free) * max(abs(free) - penalty[j], 0.0) / diagonal[j]
            moved = max(moved, abs(value - delta[j]) * np.sqrt(diagonal[j]))
            delta[j] = value
        if moved < 1e-10:
            break
    beta = np.zeros(len(moment))
    beta[bends], beta[rest] = delta, level - across @ delta
    return beta


def _optimum(inner: np.ndarray, pull: np.ndarray, penalty: np.ndarray, delta: np.ndarray) -> np.ndarray | None:
    """The best values of the bends that are not zero now, if signs and the pull on the others show that they are
    the optimum of all; else None."""
    used = np.flatnonzero(delta)
    signs = np.sign(delta[used])
    out = np.zeros(len(delta))
    try:
        out[used] = np.linalg.solve(inner[np.ix_(used, used)], pull[used] - penalty[used] * signs)
    except np.linalg.LinAlgError:
        return None
    left = np.abs(pull - inner @ out)
    left[used] = 0.0
    held = (np.sign(out[used]) == signs).all() and (left <= penalty * (1.0 + 1e-9)).all()
    return out if held else None


def penalised(
    beta: np.ndarray, gram: np.ndarray, moment: np.ndarray, ridge: np.ndarray, bends: np.ndarray, penalty: np.ndarray
) -> float:
    """Half the squared error, but for a constant, and the penalties on the weights."""
    rest = np.setdiff1d(np.arange(len(moment)), bends)
    return float(
        0.5 * beta @ gram @ beta - moment @ beta + 0.5 * ridge[rest] @ beta[rest] ** 2 + penalty @ np.abs(beta[bends])
    )


def held_weights(
    gram: np.ndarray, moment: np.ndarray, count: int, n_waves: int, bends: np.ndarray, penalty: np.ndarray, noise: float
) -> np.ndarray:
    """Weights of level, slope, ``count`` bends and waves, where only the given bends may differ from zero."""
    prior = np.concatenate([[BASE_PRIOR] * 2, [np.inf] * count, [SEASON_PRIOR] * n_waves])
    held = np.setdiff1d(np.arange(len(moment)), np.setdiff1d(np.arange(2, 2 + count), bends))
    place = np.searchsorted(held, bends)
    ridge = noise**2 / prior**2
    beta = np.zeros(len(moment))
    beta[held] = sparse_bends(gram[np.ix_(held, held)], moment[held], ridge[held], place, penalty)
    return beta


def place_bends(gram: np.ndarray, moment: np.ndarray, count: int, n_waves: int, spread) -> tuple[np.ndarray, float]:
    """The columns of the bends that more than chance asks for, and the noise; ``spread`` is the noise of weights."""
    prior = np.concatenate([[BASE_PRIOR] * 2, [np.inf] * count, [SEASON_PRIOR] * n_waves])
    every = np.arange(2, 2 + count)
    start = np.full(count, 0.1**2 / CHANGEPOINT_PRIOR)
    noise = spread(held_weights(gram, moment, count, n_waves, every, start, 0.1))
    alone = np.maximum(np.diag(_bends_alone(gram, moment, noise**2 / prior**2, every)[0]), 0.0)
    chance = np.sqrt(2.0 * np.log(max(count, 2)) * alone)
    penalty = noise**2 / CHANGEPOINT_PRIOR + noise * chance
    first = held_weights(gram, moment, count, n_waves, every, penalty, noise)
    return every[_largest(first[every])], noise


def product_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What one task adds to the sums of a trend x (1 + season) fit, from rows of ``y, trend, waves``.

    With T the trend columns and W those of the waves behind a column of ones: for each pair of T, in the order of
    ``np.triu_indices``, the sums of its product times each pair of W; then for each T the sums of y T W;
    then that of y squared.
    """
    total = None
    for rows in batches:
        for at in range(0, len(rows), 4096):
            part = rows.iloc[at : at + 4096]
            y, trend = part["y"].to_numpy(float), np.vstack(part["trend"])
            waves = np.column_stack([np.ones(len(part)), *np.vstack(part["waves"]).T])
            (i, j), (k, m) = np.triu_indices(trend.shape[1]), np.triu_indices(waves.shape[1])
            sums = (trend[:, i] * trend[:, j]).T @ (waves[:, k] * waves[:, m])
            found = [*sums, *((trend * y[:, None]).T @ waves), np.array([y @ y])]
            total = found if total is None else [a + b for a, b in zip(total, found)]
    if total is not None:
        yield pd.DataFrame({"row": np.arange(len(total), dtype="int32"), "sums": total})


class ProductSums:
    """The summed products of all tasks, and what each half step of the alternation needs of them."""

    def __init__(self, n: int, n_trend: int, n_waves: int):
        self.n, self.n_trend, self.n_ones = n, n_trend, n_waves + 1
        self._t, self._w = np.triu_indices(n_trend), np.triu_indices(self.n_ones)
        self.pairs = np.zeros((len(self._t[0]), len(self._w[0])))
        self.crossed = np.zeros((n_trend, self.n_ones))
        self.square = 0.0

    def put(self, row: int, at: int, value: float) -> None:
        if row < len(self.pairs):
            self.pairs[row, at] = value
        elif row < len(self.pairs) + self.n_trend:
            self.crossed[row - len(self.pairs), at] = value
        else:
            self.square = value

    @staticmethod
    def _weighted(pairs: np.ndarray, places: tuple, weights: np.ndarray) -> np.ndarray:
        i, j = places
        return pairs @ (weights[i] * weights[j] * np.where(i == j, 1.0, 2.0))

    @staticmethod
    def _matrix(values: np.ndarray, places: tuple, size: int) -> np.ndarray:
        out = np.zeros((size, size))
        out[places] = values
        return out + np.triu(out, 1).T

    def for_trend(self, waves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gram matrix and moment of the trend's columns times (1 + season)."""
        ones = np.concatenate([[1.0], waves])
        gram = self._matrix(self._weighted(self.pairs, self._w, ones), self._t, self.n_trend)
        return gram, self.crossed @ ones

    def for_season(self, trend: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gram matrix and moment of the waves times the trend, against y less the trend."""
        gram = self._matrix(self._weighted(self.pairs.T, self._t, trend), self._w, self.n_ones)
        return gram[1:, 1:], trend @ self.crossed[:, 1:] - gram[0, 1:]

    def noise(self, trend: np.ndarray, waves: np.ndarray) -> float:
        """Root of the mean squared error, at least 1e-4."""
        gram, moment = self.for_trend(waves)
        return max(float(self.square - 2.0 * moment @ trend + trend @ gram @ trend) / self.n, 1e-8) ** 0.5


class AdditiveFit:
    """Piecewise linear trend plus seasonal waves on scaled time and target.

    The bends have a Laplace prior. Its penalty alone lets chance bends pass on long series, so a
    first pass raises it to what noise alone reaches among so many bends; the bends that stay, each the
    largest of its neighbours, are then fitted with the prior's own penalty.
    """

    def __init__(self, days: np.ndarray, waves: np.ndarray, y: np.ndarray):
        self.start, self.length = days[0], max(days[-1] - days[0], 1.0 / 24)
        self.scale = max(float(np.abs(y).max()), 1.0)
        count = min(CHANGEPOINTS, max(len(y) - 1, 0))
        self.changepoints = np.linspace(0, CHANGEPOINT_RANGE, count + 1)[1:]
        design = np.hstack([self._trend_part(days), waves])
        self.beta, noise = self._weights(design, y / self.scale, count, waves.shape[1])
        self.noise = noise * self.scale

    @staticmethod
    def _weights(x: np.ndarray, y: np.ndarray, count: int, n_waves: int) -> tuple[np.ndarray, float]:
        gram, moment = x.T @ x, x.T @ y

        def spread(beta: np.ndarray) -> float:
            return max(float(np.std(y - x @ beta)), 1e-4)

        bends, noise = place_bends(gram, moment, count, n_waves, spread)
        beta = held_weights(gram, moment, count, n_waves, bends, np.full(len(bends), noise**2 / CHANGEPOINT_PRIOR), noise)
        return beta, spread(beta)

    def _trend_part(self, days: np.ndarray) -> np.ndarray:
        return _trend((days - self.start) / self.length, self.changepoints)

    def trend(self, days: np.ndarray) -> np.ndarray:
        part = self._trend_part(days)
        return part @ self.beta[: part.shape[1]] * self.scale

    @property
    def bend_rate(self) -> float:
        """Bends an hour in the part of the history that may have them."""
        return np.count_nonzero(self._bends()) / (self.length * 24.0 * CHANGEPOINT_RANGE)

    @property
    def bend_size(self) -> float:
        """Mean size of a bend: the change of slope, an hour."""
        bends = np.abs(self._bends())
        return float(bends[bends > 0].mean()) * self.scale / (self.length * 24.0) if bends.any() else 0.0

    def _bends(self) -> np.ndarray:
        return self.beta[2 : 2 + len(self.changepoints)]

    def seasons(self, waves: np.ndarray) -> np.ndarray:
        """Weighted waves, one column each."""
        return waves * self.beta[2 + len(self.changepoints) :] * self.scale

    def predict(self, days: np.ndarray, waves: np.ndarray) -> np.ndarray:
        return self.trend(days) + self.seasons(waves).sum(axis=1)


def _largest(bends: np.ndarray) -> np.ndarray:
    """Of each run of neighbouring bends of one sign, the largest."""
    out, k = [], 0
    while k < len(bends):
        end = k + 1
        while end < len(bends) and np.sign(bends[end]) == np.sign(bends[k]):
            end += 1
        if bends[k]:
            out.append(k + int(np.argmax(np.abs(bends[k:end]))))
        k = end
    return np.array(out, int)


def fit_series(keys: Sequence[str], season_names: Sequence[str], train_ratio: float):
    """The grouped function: rows of one series in, the same rows with its fit out."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ds", kind="stable").reset_index(drop=True)
        season_of = {
            name: [c for c in rows.columns if c.startswith(f"{name}_")] for name in season_names
        }
        wave_names = [c for name in season_names for c in season_of[name]]
        at_days = rows["_days"].to_numpy(float)
        waves = rows[wave_names].to_numpy(float)
        known = rows["y"].notna().to_numpy()
        target = rows["y"].to_numpy(float)

        n = int(known.sum())
        n_train = int(n * train_ratio)
        held = np.full(len(rows), np.nan)
        if n_train > 0:
            past = np.flatnonzero(known)[:n_train]
            test = np.flatnonzero(known)[n_train:]
            early = AdditiveFit(at_days[past], waves[past], target[past])
            held[test] = np.maximum(early.predict(at_days[test], waves[test]), 0.0)

        model = AdditiveFit(at_days[known], waves[known], target[known])
        trend, parts = model.trend(at_days), model.seasons(waves)
        centre = trend + parts.sum(axis=1)
        out = rows[[*keys, "ds", "y"]].copy()
        out["yhat"] = centre
        out["yhat_lower"] = centre - BAND_Z * model.noise
        out["yhat_upper"] = centre + BAND_Z * model.noise
        out["yhat_holdout"] = held
        out["trend"] = trend
        out["noise"], out["bend_rate"], out["bend_size"] = model.noise, model.bend_rate, model.bend_size
        at = 0
        for name in season_names:
            width = len(season_of[name])
            out[name] = parts[:, at : at + width].sum(axis=1)
            at += width
        return out

    return fit


def roll_out(
    weights: np.ndarray,
    bias: float,
    low: float,
    high: float,
    horizon: int,
    noise_std: float,
    seed: int,
):
    """Predict hour by hour, feeding each clipped, noisy value back into the window."""
    width = (high - low) or 1.0

    def roll(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ds", kind="stable")
        window = (rows["y"].to_numpy(float) - low) / width
        rng = np.random.default_rng(seed)
        clean = np.empty(horizon)
        for i in range(horizon):
            clean[i] = window @ weights + bias
            fed_back = clean[i] + (rng.normal(0.0, noise_std) if noise_std else 0.0)
            window = np.append(window[1:], min(max(fed_back, 0.0), 1.0))
        first = rows["ds"].iloc[-1] + pd.Timedelta(hours=1)
        return pd.DataFrame(
            {
                "hour": np.arange(horizon, dtype="int32"),
                "ds": pd.date_range(first, periods=horizon, freq="h"),
                "predicted": np.maximum(clean * width + low, 0.0),
            }
        )

    return roll


@dataclass(frozen=True)
class Reservoir:
    """Fixed weights of an echo-state network; its inputs are the last value and waves of the hour to come."""

    inner: tuple[tuple[float, ...], ...]
    inputs: tuple[tuple[float, ...], ...]
    bias: tuple[float, ...]
    leak: float
    periods: tuple[float, ...] = ()

    @property
    def n_features(self) -> int:
        return 2 + 2 * len(self.periods) + len(self.bias)


def make_reservoir(units: int, periods: Sequence[float], radius: float, leak: float, links: int, seed: int) -> Reservoir:
    """A random reservoir of a given spectral radius; the seed decides all of it."""
    rng = np.random.default_rng(seed)
    inner = np.zeros((units, units))
    for row in inner:
        row[rng.choice(units, min(links, units), replace=False)] = rng.uniform(-1.0, 1.0, min(links, units))
    largest = np.abs(np.linalg.eigvals(inner)).max()
    inner *= radius / largest if largest > 0 else 0.0
    inputs = rng.uniform(-1.0, 1.0, (units, 1 + 2 * len(periods)))
    inputs[:, 1:] *= 0.3
    rows = lambda m: tuple(tuple(map(float, r)) for r in m)
    return Reservoir(rows(inner), rows(inputs), tuple(map(float, rng.uniform(-0.8, 0.8, units))), leak, tuple(map(float, periods)))


class Echo:
    """The running state of a reservoir."""

    def __init__(self, reservoir: Reservoir):
        self.inner, self.inputs = np.array(reservoir.inner), np.array(reservoir.inputs)
        self.bias, self.leak = np.array(reservoir.bias), reservoir.leak
        self.turns = 2.0 * np.pi / np.array(reservoir.periods)
        self.state = np.zeros(len(self.bias))

    def step(self, value: float, hour: int) -> np.ndarray:
        """Take in the scaled value of an hour since 1970; the features that tell the next hour's value."""
        angle = self.turns * (hour + 1)
        seen = np.concatenate([[2.0 * value - 1.0], np.sin(angle), np.cos(angle)])
        fresh = np.tanh(self.inner @ self.state + self.inputs @ seen + self.bias)
        self.state = (1.0 - self.leak) * self.state + self.leak * fresh
        return np.concatenate([[1.0], seen, self.state])


def _echo_features(rows: pd.DataFrame, reservoir: Reservoir, warm: int) -> tuple[np.ndarray, pd.DataFrame]:
    """Features and rows of the hours that ``warm`` or more hours of the piece precede."""
    rows = rows.sort_values("hour", kind="stable")
    echo, seen = Echo(reservoir), []
    for value, hour in zip(rows["u"].to_numpy(float), rows["hour"].to_numpy()):
        seen.append(echo.step(value, hour))
    ready = rows.iloc[warm:]
    return np.array(seen[max(warm, 1) - 1 : len(rows) - 1]).reshape(-1, reservoir.n_features), ready


def echo_sums(reservoir: Reservoir, warm: int):
    """Gram matrix of a piece's features, the moment with the next hour's value behind it as one more row."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        features, ready = _echo_features(rows, reservoir, warm)
        own = ready["own"].to_numpy(bool)
        features, u = features[own], ready["u"].to_numpy(float)[own]
        sums = np.vstack([features.T @ features, u @ features])
        return pd.DataFrame({"row": np.arange(len(sums), dtype="int32"), "sums": list(sums)})

    return add


def echo_predictions(reservoir: Reservoir, readout: Sequence[float], warm: int):
    """Scaled predictions of a piece's own hours."""
    weights = np.array(readout)

    def predict(rows: pd.DataFrame) -> pd.DataFrame:
        features, ready = _echo_features(rows, reservoir, warm)
        told = pd.DataFrame({"hour": ready["hour"].to_numpy(), "v": features @ weights})
        return told[ready["own"].to_numpy(bool)]

    return predict


def echo_roll_out(
    reservoir: Reservoir, readout: Sequence[float], low: float, high: float, horizon: int, noise_std: float, seed: int
):
    """Warm the state on rows ``ds, hour, y``, then go on with its own clipped, noisy predictions."""
    width, weights = (high - low) or 1.0, np.array(readout)

    def roll(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("hour", kind="stable")
        echo, rng = Echo(reservoir), np.random.default_rng(seed)
        for y, hour in zip(rows["y"].to_numpy(float), rows["hour"].to_numpy()):
            features = echo.step((y - low) / width, hour)
        clean = np.empty(horizon)
        for i in range(horizon):
            clean[i] = features @ weights
            fed_back = clean[i] + (rng.normal(0.0, noise_std) if noise_std else 0.0)
            hour += 1
            features = echo.step(min(max(fed_back, 0.0), 1.0), hour)
        first = rows["ds"].iloc[-1] + pd.Timedelta(hours=1)
        return pd.DataFrame(
            {
                "hour": np.arange(horizon, dtype="int32"),
                "ds": pd.date_range(first, periods=horizon, freq="h"),
                "predicted": np.maximum(clean * width + low, 0.0),
            }
        )

    return roll
