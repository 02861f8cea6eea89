"""Iterative forecast models of one log-price series, called by grouped tasks: y and a horizon to log paths.

Each returns the mean and the bands of every step and a map of what it found. They raise ValueError where a series can't
be fitted.
"""

from __future__ import annotations

import numpy as np

from candela import config

LEAST_BOOST_ROWS = 60


def banded(mean: np.ndarray, error: np.ndarray) -> dict[str, np.ndarray]:
    return {"mean": mean, "lo95": mean - config.Z95 * error, "lo80": mean - config.Z80 * error, "hi80": mean + config.Z80 * error, "hi95": mean + config.Z95 * error}


def minimum(f, start: np.ndarray, rounds: int = 200, step: float = 0.2) -> np.ndarray:
    """Nelder and Mead's simplex search."""
    points = [np.asarray(start, dtype=float)]
    for k in range(len(start)):
        moved = points[0].copy()
        moved[k] += step
        points.append(moved)
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        points, values = [points[k] for k in order], [values[k] for k in order]
        if abs(values[-1] - values[0]) < 1e-9 * (1 + abs(values[0])):
            break
        centre = np.mean(points[:-1], axis=0)
        tried = centre + (centre - points[-1])
        value = f(tried)
        if value < values[0]:
            further = centre + 2 * (centre - points[-1])
            better = f(further)
            points[-1], values[-1] = (further, better) if better < value else (tried, value)
        elif value < values[-2]:
            points[-1], values[-1] = tried, value
        else:
            nearer = centre + 0.5 * ((tried if value < values[-1] else points[-1]) - centre)
            closer = f(nearer)
            if closer < min(value, values[-1]):
                points[-1], values[-1] = nearer, closer
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    return points[int(np.argmin(values))]


def _unit(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def smoothed(y: np.ndarray, alpha: float, level: float) -> tuple[float, np.ndarray]:
    """Simple exponential smoothing: the last level and the one-step errors."""
    errors = np.empty(len(y))
    for k, value in enumerate(y):
        errors[k] = value - level
        level += alpha * errors[k]
    return level, errors


def theta(y: np.ndarray, h: int) -> tuple[dict, dict]:
    """The mean of the linear trend and of the series with doubled curvature, smoothed: level plus half the slope."""
    n = len(y)
    if n < 10:
        raise ValueError("Theta needs ten days")
    slope = float(np.polyfit(np.arange(n), y, 1)[0])
    loss = lambda p: float(np.mean(smoothed(y, 0.01 + 0.98 * _unit(p[0]), y[0])[1][1:] ** 2))
    alpha = 0.01 + 0.98 * _unit(minimum(loss, np.array([1.0]), 60, 1.0)[0])
    level, errors = smoothed(y, alpha, y[0])
    steps = np.arange(1, h + 1)
    mean = level + slope / 2 * (steps - 1 + 1 / alpha - (1 - alpha) ** n / alpha)
    sd = float(np.std(errors[1:], ddof=1))
    return banded(mean, sd * np.sqrt((steps - 1) * alpha**2 + 1)), {"alpha": alpha, "slope": slope}


def ets(y: np.ndarray, h: int) -> tuple[dict, dict]:
    """Additive errors, damped additive trend, no season."""
    n = len(y)
    if n < 20:
        raise ValueError("smoothing with a trend needs twenty days")
    first, drift = y[0], float(np.mean(np.diff(y[:11])))

    def run(p: np.ndarray) -> tuple[float, float, np.ndarray]:
        alpha, phi = 0.001 + 0.998 * _unit(p[0]), 0.8 + 0.18 * _unit(p[2])
        beta = alpha * _unit(p[1])
        level, trend, errors = first, drift, np.empty(n)
        for k in range(n):
            expected = level + phi * trend
            errors[k] = y[k] - expected
            level, trend = expected + alpha * errors[k], phi * trend + beta * errors[k]
        return level, trend, errors

    best = minimum(lambda p: float(np.log(np.mean(run(p)[2] ** 2) + 1e-300)), np.array([2.0, -3.0, 0.0]), 120, 1.0)
    level, trend, errors = run(best)
    alpha, phi = 0.001 + 0.998 * _unit(best[0]), 0.8 + 0.18 * _unit(best[2])
    beta = alpha * _unit(best[1])
    sums = np.cumsum(phi ** np.arange(1, h + 1))
    c = alpha + beta * np.r_[0.0, sums][:h] / max(phi, 1e-9)
    error = np.sqrt(np.r_[1.0, 1.0 + np.cumsum(c[1:] ** 2)][:h]) * float(np.std(errors, ddof=1))
    return banded(level + trend * sums, error), {"alpha": alpha, "beta": beta, "phi": phi}


def _css(x: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    """Conditional residuals of an ARMA process of up to two lags without a constant."""
    p = len(ar)
    rest = x.copy()
    for k in range(p):
        rest[k + 1 :] -= ar[k] * x[: -k - 1]
    rest[:p] = 0.0
    if not len(ma):
        return rest
    first, second = float(ma[0]), float(ma[1]) if len(ma) > 1 else 0.0
    e, before, earlier = [0.0] * p, 0.0, 0.0
    for value in rest[p:].tolist():
        before, earlier = value - first * before - second * earlier, before
        e.append(before)
    return np.array(e)


def _stable(z: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary process of up to two lags, from free numbers (by partial autocorrelations)."""
    r = np.tanh(z) * 0.98
    return r if len(r) < 2 else np.array([r[0] * (1 - r[1]), r[1]])


def _arma(x: np.ndarray, p: int, q: int, trend: bool) -> tuple[float, np.ndarray, np.ndarray, float, np.ndarray]:
    """AICc, AR and MA coefficients, mean and residuals of the best fit."""
    mu = float(x.mean()) if trend else 0.0
    centred = x - mu
    parts = lambda z: (_stable(z[:p]), _stable(z[p:]))
    sse = lambda z: float(np.log(np.mean(_css(centred, *parts(z))[p:] ** 2) + 1e-300))
    z = minimum(sse, np.full(p + q, 0.05), 40 * (p + q), 0.3) if p + q else np.zeros(0)
    ar, ma = parts(z)
    errors = _css(centred, ar, ma)[p:]
    n, k = len(errors), p + q + trend + 1
    if n - k - 1 <= 0:
        raise ValueError("ARIMA needs more days")
    log_likelihood = -n / 2 * (np.log(2 * np.pi * (errors**2).mean() + 1e-300) + 1)
    return float(-2 * log_likelihood + 2 * k + 2 * k * (k + 1) / (n - k - 1)), ar, ma, mu, errors


#: The candidate orders: p, q and whether there is a drift.
ORDERS = tuple((p, q, trend) for p in range(3) for q in range(3) for trend in (False, True))


def arima_aicc(y: np.ndarray, p: int, q: int, trend: bool) -> float:
    return _arma(np.diff(y), p, q, trend)[0]


def portmanteau(e: np.ndarray, lags: int = 10) -> float:
    """Ljung and Box's p-value with an even number of lags."""
    e, n = e - e.mean(), len(e)
    total = float((e * e).sum())
    if n <= lags or not total:
        return float("nan")
    half = n * (n + 2) * sum(((e[k:] * e[:-k]).sum() / total) ** 2 / (n - k) for k in range(1, lags + 1)) / 2
    term, tail = 1.0, 1.0
    for j in range(1, lags // 2):
        term *= half / j
        tail += term
    return float(np.exp(-half) * tail)


def arima(y: np.ndarray, h: int, order: tuple[int, int, bool] | None) -> tuple[dict, dict]:
    """ARIMA(p, 1, q) of the given order, fitted to all days."""
    if len(y) < 30 or order is None:
        raise ValueError("ARIMA needs thirty days and an order")
    p, q, trend = order
    x = np.diff(y)
    aicc, ar, ma, mu, errors = _arma(x, p, q, trend)
    past, shocks, guesses = list(x - mu), list(errors), []
    for k in range(h):
        value = sum(a * past[-1 - j] for j, a in enumerate(ar)) + sum(m * shocks[-1 - j + k] for j, m in enumerate(ma) if j >= k)
        past.append(value)
        guesses.append(value + mu)
    psi = [1.0]
    for j in range(1, h):
        psi.append((ma[j - 1] if j <= q else 0.0) + sum(ar[k] * psi[j - 1 - k] for k in range(min(p, j))))
    error = np.sqrt(np.cumsum(np.cumsum(psi) ** 2)) * float(np.sqrt((errors**2).mean()))
    return banded(y[-1] + np.cumsum(guesses), error), {"p": float(p), "q": float(q), "trend": float(trend), "aicc": aicc, "ljung_box_p": portmanteau(errors)}


def _features(y: np.ndarray) -> np.ndarray:
    """Changes some days ago, deviations, distances to averages and the share of rises, by day; NaN where too early."""
    n, r = len(y), np.r_[np.nan, np.diff(y)]
    columns = []
    for k in (1, 3, 7, 14, 30):
        columns.append(np.r_[np.full(k, np.nan), y[k:] - y[:-k]] if n > k else np.full(n, np.nan))
    windows = lambda x, k: np.lib.stride_tricks.sliding_window_view(x, k) if n >= k else np.empty((0, k))
    pad = lambda v, k: np.r_[np.full(min(k - 1, n), np.nan), v]
    columns += [pad(windows(r, k).std(axis=1, ddof=1), k) for k in (7, 30)]
    columns += [y - pad(np.log(windows(np.exp(y), k).mean(axis=1)), k) for k in (20, 50)]
    ratio = np.full(n, np.nan)
    up = down = None
    for k in range(1, n):
        rise, fall = max(r[k], 0.0), max(-r[k], 0.0)
        up, down = (rise, fall) if up is None else (up + (rise - up) / 14, down + (fall - down) / 14)
        if down:  # without any fall it is missing
            ratio[k] = up / (up + down)
    return np.c_[(*columns, ratio)]


def _tree(codes: np.ndarray, slope: np.ndarray, target: np.ndarray, rows: np.ndarray, depth: int, leaf: int):
    """A tree on binned columns that fits the gradient's signs; a leaf's value is the median of what is left there."""
    if depth and len(rows) >= 2 * leaf:
        total, count, best = slope[rows].sum(), len(rows), (1e-12, None)
        for j in range(codes.shape[1]):
            own = codes[rows, j]
            left_n = np.cumsum(np.bincount(own, minlength=33))[:-1]
            left = np.cumsum(np.bincount(own, slope[rows], minlength=33))[:-1]
            allowed = (left_n >= leaf) & (count - left_n >= leaf)
            if allowed.any():
                gain = np.where(allowed, left**2 / (left_n + 1.0) + (total - left) ** 2 / (count - left_n + 1.0) - total**2 / (count + 1.0), -1)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (j, k))
        if best[1]:
            j, k = best[1]
            there = codes[rows, j] <= k
            return j, k, _tree(codes, slope, target, rows[there], depth - 1, leaf), _tree(codes, slope, target, rows[~there], depth - 1, leaf)
    return float(np.median(target[rows]))


def _told(tree, codes: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(codes), tree)
    j, k, left, right = tree
    there, out = codes[:, j] <= k, np.empty(len(codes))
    out[there], out[~there] = _told(left, codes[there]), _told(right, codes[~there])
    return out


def boost(y: np.ndarray, h: int, rounds: int = 150, rate: float = 0.05) -> tuple[dict, dict]:
    """Gradient-boosted trees of depth 3 with absolute loss for the change over the whole horizon; the path to it is a
    straight line, the bands are those of the flat forecast."""
    x = _features(y)
    known = np.flatnonzero(~np.isnan(x).any(axis=1) & (np.arange(len(y)) < len(y) - h))
    if len(known) < LEAST_BOOST_ROWS:
        raise ValueError(f"boosting needs {LEAST_BOOST_ROWS} days with features")
    x[-1] = np.where(np.isnan(x[-1]), np.nanmedian(x, axis=0), x[-1])
    cuts = [np.unique(np.quantile(x[known, j], np.linspace(0, 1, 33)[1:-1])) for j in range(x.shape[1])]
    coded = lambda rows: np.c_[tuple(np.searchsorted(c, rows[:, j]) for j, c in enumerate(cuts))]
    codes, last, target = coded(x[known]), coded(x[-1:]), y[known + h] - y[known]
    fitted, guess = np.full(len(known), np.median(target)), float(np.median(target))
    for _ in range(rounds):
        left = target - fitted
        tree = _tree(codes, np.sign(left), left, np.arange(len(known)), 3, 20)
        fitted += rate * _told(tree, codes)
        guess += rate * float(_told(tree, last)[0])
    steps = np.arange(1, h + 1)
    sd = float(np.std(np.diff(y), ddof=1))
    return banded(y[-1] + guess * steps / h, sd * np.sqrt(steps)), {"rows": float(len(known)), "train_mae": float(np.abs(target - fitted).mean())}


def forecast(model: str, y: np.ndarray, h: int, order: tuple[int, int, bool] | None = None) -> tuple[dict, dict]:
    if len(y) < 3 or not np.isfinite(y).all():
        raise ValueError("too few prices")
    return {"theta": lambda: theta(y, h), "ets": lambda: ets(y, h), "arima": lambda: arima(y, h, order), "boost": lambda: boost(y, h)}[model]()


def dickey_fuller(y: np.ndarray) -> tuple[float | None, int | None, float]:
    """The t-statistic of the level in a regression of changes on it, a constant and lagged changes (as many as minimise
    AIC, up to Schwert's bound); the lags; the 5 percent point by MacKinnon's response surface (1996, constant only)."""
    # fixed values of the published surface
    a, b, c, d = -2.86154, -2.8903, -4.234, -40.04
    n = len(y)
    point = a + b / max(n, 1) + c / max(n, 1) ** 2 + d / max(n, 1) ** 3
    most = min(int(12 * (n / 100) ** 0.25), (n - 1) // 2 - 2)
    if most < 0 or np.ptp(y) == 0:
        return None, None, point
    x = np.diff(y)

    def fit(lags: int, skip: int) -> tuple[float, float]:
        rows = np.arange(skip, len(x))
        design = np.c_[(y[rows], np.ones(len(rows)), *(x[rows - k] for k in range(1, lags + 1)))]
        beta, *_ = np.linalg.lstsq(design, x[rows], rcond=None)
        sse = float(((x[rows] - design @ beta) ** 2).sum())
        cov = np.linalg.pinv(design.T @ design)
        spread = np.sqrt(max(sse / max(1, len(rows) - design.shape[1]) * cov[0, 0], 1e-300))
        return len(rows) * np.log(sse / len(rows) + 1e-300) + 2 * design.shape[1], float(beta[0] / spread)

    lags = min(range(most + 1), key=lambda k: fit(k, most)[0])
    return fit(lags, lags)[1], lags, point
