"""Recursive models of single series, fitted for all series and folds at once: autoregressive moving
averages, conditional variances, and dynamic correlation with the market.

The recursions run over one series' dates, so a task holds the rows of one series and fold. Their
parameters come from least squares or from a grid on which all candidates are filtered together.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from voltide.functions.features import folds
from voltide.operators.spikes import sigmoid

# The orders that the catalogue holds.
ARIMA_ORDERS = [(1, 0, 1), (2, 0, 1), (1, 0, 2), (2, 0, 2), (1, 1, 0), (0, 1, 1), (1, 1, 1), (2, 1, 1), (1, 1, 2)]
GARCH_ORDERS = [(1, 1), (2, 1), (1, 2), (2, 2), (3, 2), (2, 3), (3, 3)]


class Scaled:
    """Columns by the mean and population deviation (0 counts as 1) of the rows it was made from."""

    def __init__(self, x: np.ndarray):
        self.mean, sd = x.mean(0), x.std(0)
        self.sd = np.where(sd <= 1e-12, 1.0, sd)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.sd


def fit_logit(x: np.ndarray, y: np.ndarray, c: float, steps: int = 100) -> np.ndarray:
    """Intercept and coefficients that minimise c * loss + half their squares (the intercept is free),
    by Newton steps that are halved until the aim falls."""
    one = np.column_stack((np.ones(len(x)), x))
    penalty = np.eye(one.shape[1])
    penalty[0, 0] = 0
    b = np.zeros(one.shape[1])
    aim = lambda v: c * np.logaddexp(0, np.where(y == 1, -(one @ v), one @ v)).sum() + v[1:] @ v[1:] / 2
    now = aim(b)
    for _ in range(steps):
        p = sigmoid(one @ b)
        slope = c * one.T @ (p - y) + penalty @ b
        bend = c * (one * (p * (1 - p))[:, None]).T @ one + penalty + 1e-10 * np.eye(len(b))
        move, size = np.linalg.solve(bend, slope), 1.0
        while (then := aim(b - size * move)) > now and size > 1e-6:
            size /= 2
        b = b - size * move
        if now - then < 1e-12 * max(1.0, abs(now)):
            break
        now = then
    return b


def _lags(x: np.ndarray, n: int) -> np.ndarray:
    """Row t holds x[t-1], ..., x[t-n], for t from n on."""
    return np.column_stack([x[n - i - 1 : len(x) - i - 1] for i in range(n)]) if n else np.zeros((len(x), 0))


def _stable(a: np.ndarray) -> bool:
    """Whether 1 - a1 z - a2 z^2 - ... has all its roots outside the unit circle."""
    return not len(a) or bool(np.abs(np.roots(np.r_[1.0, -a])).max() < 0.999)


def fit_arma(y: np.ndarray, p: int, q: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray] | None:
    """Mean, coefficients of lagged values and errors, and errors, by two regressions: a long
    autoregression gives the errors, then values are regressed on both lags. None if not stable."""
    mean = y.mean()
    x = y - mean
    long = min(20, len(x) // 10) if q else 0
    if len(x) < long + p + q + 10:
        return None
    errors = np.zeros(len(x))
    if q:
        past = _lags(x, long)
        errors[long:] = x[long:] - past @ np.linalg.lstsq(past, x[long:], rcond=None)[0]
    at = long + max(p, q)
    design = np.column_stack([x[at - i - 1 : len(x) - i - 1] for i in range(p)] + [errors[at - i - 1 : len(x) - i - 1] for i in range(q)])
    b = np.linalg.lstsq(design, x[at:], rcond=None)[0]
    ar, ma = b[:p], b[p:]
    if not (_stable(ar) and _stable(-ma)):
        return None
    own = np.zeros(len(x))
    for t in range(len(x)):
        own[t] = x[t] - sum(ar[i] * x[t - i - 1] for i in range(min(p, t))) - sum(ma[i] * own[t - i - 1] for i in range(min(q, t)))
    return mean, ar, ma, own


def forecast_arima(y: np.ndarray, order: tuple[int, int, int], steps: int) -> np.ndarray:
    """`steps` values ahead of `y`; an order that gives no stable model falls back on (1, 0, 0)."""
    p, d, q = order
    x = np.diff(y) if d else y
    got = fit_arma(x, p, q)
    if got is None:
        p, d, q, x = 1, 0, 0, y
        got = fit_arma(y, 1, 0) or (y.mean(), np.zeros(1), np.zeros(0), y - y.mean())
    mean, ar, ma, errors = got
    mean = 0.0 if d else mean
    past, left = list((x - (0.0 if d else mean))[-max(p, 1) :]), list(errors[-max(q, 1) :])
    out = []
    for _ in range(steps):
        value = sum(ar[i] * past[-1 - i] for i in range(p)) + sum(ma[i] * left[-1 - i] for i in range(q))
        past.append(value)
        left.append(0.0)
        out.append(mean + value)
    return y[-1] + np.cumsum(out) if d else np.array(out)


def _each(rows: DataFrame, run, kinds: str) -> DataFrame:
    return rows.groupBy("series", "fold").applyInPandas(run, kinds)


KINDS = "series string, dt date, category string, model string, fold int, y_true double, y_pred double"


def arima_forecasts(panel: DataFrame, orders=ARIMA_ORDERS, n_splits: int = 1, test: int = 252, min_train: int = 1260) -> DataFrame:
    """Static forecasts of log_Y over the test block, on the calendar of business days (gaps take the
    value before): as many steps as the block has rows, exponentiated."""
    rows = folds(panel.dropna(subset=["log_Y", "Y_fwd"]), n_splits, test, min_train).select("series", "fold", "dt", "role", "log_Y", "Y_fwd")

    def run(key, pdf):
        pdf = pdf.sort_values("dt")
        train, own = pdf[pdf["role"] == "train"], pdf[pdf["role"] == "test"]
        y = pd.Series(train["log_Y"].to_numpy(), pd.DatetimeIndex(train["dt"])).asfreq("B").ffill().dropna().to_numpy()
        return pd.concat([pd.DataFrame({"series": key[0], "dt": own["dt"], "category": "ARIMA", "model": f"ARIMA{o}".replace(" ", ""), "fold": key[1], "y_true": own["Y_fwd"], "y_pred": np.exp(forecast_arima(y, o, len(own)))}) for o in orders])

    return _each(rows, run, KINDS)


def variance_filter(r: np.ndarray, omega: np.ndarray, alpha: np.ndarray, beta: np.ndarray, start: float) -> np.ndarray:
    """Conditional variances h[t] = omega + sum alpha_i r[t-i]^2 + sum beta_j h[t-j], one column for
    every row of alpha and beta; what lies before the first value counts as `start`. One row more
    than `r`: the last is the variance of the day to come."""
    n, (g, p), q = len(r), alpha.shape, beta.shape[1]
    h, e = np.full((n + 1 + q, g), start), np.concatenate((np.full(p, start), r**2))
    for t in range(n + 1):
        h[t + q] = omega + alpha @ e[t : t + p][::-1] + (beta * h[t : t + q][::-1].T).sum(1)
    return h[q:]


def _candidates(p: int, q: int, target: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """omega, alpha (p) and beta (q) on a grid of their sums and of how fast they fall with the lag;
    omega follows from the unconditional variance."""
    rows = []
    for a, b, fall in product((0.01, 0.02, 0.04, 0.06, 0.09, 0.13, 0.18, 0.25), (0.0, 0.3, 0.5, 0.65, 0.75, 0.82, 0.88, 0.92, 0.95, 0.97), (1.0, 0.5) if max(p, q) > 1 else (1.0,)):
        if a + b < 0.999:
            weight = lambda n: (w := fall ** np.arange(n)) / w.sum()
            rows.append((target * (1 - a - b), a * weight(p), b * weight(q)))
    return np.array([x[0] for x in rows]), np.array([x[1] for x in rows]), np.array([x[2] for x in rows])


def fit_garch(r: np.ndarray, p: int, q: int) -> tuple[float, np.ndarray, np.ndarray, float]:
    """The candidate with the greatest normal likelihood: omega, alpha, beta and the start."""
    start = float(np.mean(r**2)) or 1e-12
    omega, alpha, beta = _candidates(p, q, start)
    h = np.maximum(variance_filter(r, omega, alpha, beta, start)[:-1], 1e-12)
    best = int((np.log(h) + (r**2)[:, None] / h).sum(0).argmin())
    return float(omega[best]), alpha[best], beta[best], start


def variance_forecasts(r: np.ndarray, params: tuple, first: int, horizon: int) -> np.ndarray:
    """Row per day from `first` on: the expected variances of the `horizon` days after it, which know
    that day's return."""
    omega, alpha, beta, start = params
    p, q = len(alpha), len(beta)
    h = variance_filter(r, np.array([omega]), alpha[None], beta[None], start)[:, 0]
    known = lambda x, back, n: np.stack([x[np.maximum(back - i, 0)] for i in range(n)])
    days = np.arange(first, len(r))
    e, v = known(r**2, days, p), known(h, days + 1, q)
    out = [h[days + 1]]
    for _ in range(1, horizon):
        e = np.vstack((out[-1][None], e))[:p]
        out.append(omega + alpha @ e + beta @ v)
        v = np.vstack((out[-1][None], v))[:q]
    return np.column_stack(out)


def garch_forecasts(panel: DataFrame, orders=GARCH_ORDERS, horizon: int = 5, multiplier: float = 1.0, n_splits: int = 1, test: int = 252, min_train: int = 1260) -> DataFrame:
    """Sums of the expected variances of the next `horizon` days for every test row."""
    rows = folds(panel.dropna(subset=["Returns", "Y_fwd"]), n_splits, test, min_train).select("series", "fold", "dt", "role", "Returns", "Y_fwd")

    def run(key, pdf):
        pdf = pdf.sort_values("dt")
        r, n, own = pdf["Returns"].to_numpy(), int((pdf["role"] == "train").sum()), pdf[pdf["role"] == "test"]
        out = []
        for p, q in orders:
            value = variance_forecasts(r, fit_garch(r[:n], p, q), n, horizon).sum(1) / multiplier**2
            out.append(pd.DataFrame({"series": key[0], "dt": own["dt"], "category": "GARCH", "model": f"GARCH({p},{q})", "fold": key[1], "y_true": own["Y_fwd"], "y_pred": value}))
        return pd.concat(out)

    return _each(rows, run, KINDS)


class Correlated:
    """Dynamic conditional correlation of a series and the market: both variances first, then the two
    parameters of the correlation by likelihood on a grid."""

    def __init__(self, r: np.ndarray, market: np.ndarray, n: int):
        self.r, self.m, self.n = r, market, n
        self.one, self.two = fit_garch(r[:n], 1, 1), fit_garch(market[:n], 1, 1)
        h = [variance_filter(x, np.array([g[0]]), g[1][None], g[2][None], g[3])[:-1, 0] for x, g in ((r, self.one), (market, self.two))]
        self.z = np.column_stack((r / np.sqrt(h[0]), market / np.sqrt(h[1])))
        z = self.z[:n]
        self.base = np.cov(z.T) + 1e-8 * np.eye(2)
        grid = np.array([(a, b) for a in (0.005, 0.01, 0.02, 0.03, 0.05, 0.08) for b in (0.0, 0.5, 0.8, 0.9, 0.93, 0.95, 0.97, 0.985) if a + b < 0.999])
        q, loss = np.tile(self.base[[0, 0, 1], [0, 1, 1]][:, None], (1, len(grid))), np.zeros(len(grid))
        fresh = (1 - grid.sum(1)) * self.base[[0, 0, 1], [0, 1, 1]][:, None]
        for t in range(1, n):
            x, y = z[t - 1]
            q = fresh + grid[:, 0] * np.array([x * x, x * y, y * y])[:, None] + grid[:, 1] * q
            rho = np.clip(q[1] / np.sqrt(q[0] * q[2]), -0.999, 0.999)
            x, y = z[t]
            loss += np.log(1 - rho**2) + (x * x - 2 * rho * x * y + y * y) / (1 - rho**2) - x * x - y * y
        self.a, self.b = grid[int(loss.argmin())]

    def states(self) -> np.ndarray:
        """The matrix (three numbers) that holds before each day's return is seen."""
        base = self.base[[0, 0, 1], [0, 1, 1]]
        out = np.empty((len(self.z), 3))
        out[0] = base
        for t in range(1, len(out)):
            x, y = self.z[t - 1]
            out[t] = (1 - self.a - self.b) * base + self.a * np.array([x * x, x * y, y * y]) + self.b * out[t - 1]
        return out

    def scores(self, first: int, horizon: int, weight: float = 0.5) -> np.ndarray:
        """For every day from `first` on the sum over the next days of the series' variance, raised or
        lowered by how far the market's is from its usual level beyond the series' own deviation. The
        correlation is the one before the day's return, as variances lead it by a step."""
        v1, v2 = variance_forecasts(self.r, self.one, first, horizon), variance_forecasts(self.m, self.two, first, horizon)
        usual = [max(g[0] / max(1 - g[1].sum() - g[2].sum(), 1e-6), 1e-20) for g in (self.one, self.two)]
        base, q = self.base[[0, 0, 1], [0, 1, 1]][:, None], self.states()[first:].T
        total = np.zeros(v1.shape[0])
        for k in range(horizon):
            root = np.sqrt(np.maximum(q[0] * q[2], 1e-12))
            rho = np.clip(q[1] / root, -0.999, 0.999)
            gap = np.clip(np.log(np.maximum(v2[:, k], 1e-20) / usual[1]) - np.log(np.maximum(v1[:, k], 1e-20) / usual[0]), -1, 1)
            total += v1[:, k] * np.exp(weight * rho**2 * gap)
            q = (1 - self.a - self.b) * base + self.a * np.stack((np.ones_like(rho), rho, np.ones_like(rho))) + self.b * q
        return total


def _with_market(panel: DataFrame, n_splits: int, test: int, min_train: int) -> DataFrame:
    return folds(panel.dropna(subset=["Returns", "Market_Returns", "Y_fwd"]), n_splits, test, min_train).select("series", "fold", "dt", "role", "Returns", "Market_Returns", "Y_fwd")


def dcc_forecasts(panel: DataFrame, horizon: int = 5, multiplier: float = 1.0, n_splits: int = 1, test: int = 252, min_train: int = 1260) -> DataFrame:
    def run(key, pdf):
        pdf = pdf.sort_values("dt")
        n, own = int((pdf["role"] == "train").sum()), pdf[pdf["role"] == "test"]
        value = Correlated(pdf["Returns"].to_numpy(), pdf["Market_Returns"].to_numpy(), n).scores(n, horizon) / multiplier**2
        return pd.DataFrame({"series": key[0], "dt": own["dt"], "category": "GARCH", "model": "DCC-GARCH(1,1)", "fold": key[1], "y_true": own["Y_fwd"], "y_pred": value})

    return _each(_with_market(panel, n_splits, test, min_train), run, KINDS)


def dcc_spikes(panel: DataFrame, cs=(0.1, 1.0), quantile: float = 0.8, n_splits: int = 1, test: int = 252, min_train: int = 1260) -> DataFrame:
    """Logits on one number, the logarithm of the next day's score, which is filtered over the
    training rows once, in their own order."""

    def run(key, pdf):
        pdf = pdf.sort_values("dt")
        n, own = int((pdf["role"] == "train").sum()), pdf[pdf["role"] == "test"]
        y = pdf["Y_fwd"].to_numpy()
        label = (y > np.quantile(y[:n], quantile)).astype(int)
        out = []
        if len(np.unique(label[:n])) > 1:
            score = np.log(np.maximum(Correlated(pdf["Returns"].to_numpy(), pdf["Market_Returns"].to_numpy(), n).scores(0, 1), 1e-12))[:, None]
            scale = Scaled(score[:n])
            for c in cs:
                b = fit_logit(scale(score[:n]), label[:n], c)
                p = sigmoid(scale(score[n:]) @ b[1:] + b[0])
                out.append(pd.DataFrame({"series": key[0], "dt": own["dt"], "category": "DCC-GARCH-Logit", "model": f"DCC-GARCH-Logit (C={c})", "fold": key[1], "y_true": y[n:], "label": label[n:], "pred": (p >= 0.5).astype(int), "proba": p}))
        return pd.concat(out) if out else pd.DataFrame({n: [] for n in ("series", "dt", "category", "model", "fold", "y_true", "label", "pred", "proba")})

    return _each(_with_market(panel, n_splits, test, min_train), run, "series string, dt date, category string, model string, fold int, y_true double, label int, pred int, proba double")
