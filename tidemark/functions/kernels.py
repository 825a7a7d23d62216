"""State machines over one symbol's bars: arrays in, arrays out, NaN for missing."""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np

NAN = math.nan
#: Weights of the quadrature filter at 0, 2, 4 and 6 bars (fixed values).
QUADRATURE = (0.0962, 0.5769, -0.5769, -0.0962)


def supertrend(high, low, close, atr, multiplier):
    """The first bar's direction is that of its close against its middle."""
    out = np.full(len(close), NAN)
    middle = (high + low) / 2
    above, below = middle + multiplier * atr, middle - multiplier * atr
    up, ceiling, floor = True, NAN, NAN
    for i in np.flatnonzero(atr == atr).tolist():
        if ceiling != ceiling:
            ceiling, floor, up = above[i], below[i], close[i] > middle[i]
        else:
            ceiling = above[i] if above[i] < ceiling or close[i - 1] > ceiling else ceiling
            floor = below[i] if below[i] > floor or close[i - 1] < floor else floor
            up = close[i] >= floor if up else close[i] > ceiling
        out[i] = floor if up else ceiling
    return [out]


def psar(high, low, step, most):
    """A bar shows the stop that the bars before it left; then the stop moves up, held back by this bar's low and the one
    before.  Being held back by the bar itself it is never met, so the direction never turns, as defined."""
    out = np.full(len(high), NAN)
    factor, extreme, stop = step, high[0], low[0]
    for i in range(1, len(high)):
        out[i] = stop
        if high[i] > extreme:
            extreme, factor = high[i], min(factor + step, most)
        stop = min(stop + factor * (extreme - stop), low[i - 1], low[i])
    return [out]


def jma(close, alpha):
    out = np.array(close, float)
    for i in range(2, len(out)):
        out[i] = out[i - 1] + alpha * (close[i] - out[i - 1]) + (1 - alpha) * (out[i - 1] - out[i - 2])
    return [out]


def hurst(close, period):
    """Rescaled range of the levels over chunks of period/2, period/4, ... bars (6 sizes at most, of 8 bars at least): the
    slope of log R/S on log size, within 0 and 1."""
    n = len(close)
    out = np.full(n, NAN)
    sizes = [period >> k for k in range(1, 7) if period >> k >= 8]
    if n < period or len(sizes) < 2:
        return [out]
    windows = np.lib.stride_tricks.sliding_window_view(close, period)
    logs = np.full((len(sizes), len(windows)), NAN)
    for row, size in enumerate(sizes):
        chunks = windows[:, : period // size * size].reshape(len(windows), -1, size)
        apart = chunks - chunks.mean(axis=2, keepdims=True)
        walk, sd = np.cumsum(apart, axis=2), np.sqrt((apart**2).mean(axis=2))
        with np.errstate(divide="ignore", invalid="ignore"):
            scaled = np.where(sd > 0, (walk.max(axis=2) - walk.min(axis=2)) / sd, 0.0)
            logs[row] = np.log(scaled.sum(axis=1) / (sd > 0).sum(axis=1))
    there = np.isfinite(logs)
    x = np.where(there, np.log(sizes)[:, None], 0.0)
    y, k = np.where(there, logs, 0.0), there.sum(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = (k * (x * y).sum(axis=0) - x.sum(axis=0) * y.sum(axis=0)) / (k * (x * x).sum(axis=0) - x.sum(axis=0) ** 2)
    out[period - 1 :] = np.where(k > 1, np.clip(slope, 0.0, 1.0), NAN)
    return [out]


def _ago(x: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([np.full(min(k, len(x)), NAN), x[: max(0, len(x) - k)]])


def _phases(price, period):
    """In-phase and quadrature parts of the four-bar weighted price less itself ``period`` bars ago."""
    smooth = sum(w * _ago(price, k) for k, w in enumerate((0.4, 0.3, 0.2, 0.1)))
    trendless = smooth - _ago(smooth, period)
    return _ago(trendless, 3), 0.5 * sum(w * _ago(trendless, 2 * k) for k, w in enumerate(QUADRATURE))


def _wrapped(angle: float) -> float:
    while angle > math.pi:
        angle -= 2 * math.pi
    while angle < -math.pi:
        angle += 2 * math.pi
    return angle


def _turn(angle: float) -> float:
    """A difference of two angles, brought back by one turn at most."""
    return angle + 2 * math.pi if angle < -math.pi else angle - 2 * math.pi if angle > math.pi else angle


def hilbert_sine(close, period):
    n = len(close)
    sine, lead = np.full(n, NAN), np.full(n, NAN)
    inside, quad = _phases(close, period)
    phase = np.arctan2(quad, inside)
    alpha, cycle, angle = 2 / (period + 1), NAN, 0.0
    for i in range(1, n):
        now = NAN
        if phase[i] == phase[i] and phase[i - 1] == phase[i - 1] and (turn := _turn(phase[i] - phase[i - 1])):
            fresh = 2 * math.pi / turn
            now = min(50.0, max(6.0, fresh if cycle != cycle else alpha * fresh + (1 - alpha) * cycle))
        cycle = now
        if now == now:
            angle = _wrapped(angle + 2 * math.pi / now)
            sine[i], lead[i] = math.sin(angle), math.sin(angle + math.pi / 4)
    return [sine, lead]


def _resonator(drive, first, alpha, beta):
    """A second-order band pass from place ``first`` on, NaN before; it starts anew where it has left what a double holds."""
    out = np.full(len(drive), NAN)
    one = two = NAN
    for i, x in enumerate((0.5 * (1 - alpha) * drive[first:]).tolist(), first):
        now = x + beta * (1 + alpha) * one - alpha * two if math.isfinite(one) and math.isfinite(two) else x
        out[i], one, two = now, now, one
    return out


def mesa_sine(close, period):
    n = len(close)
    sine, cosine = np.full(n, NAN), np.full(n, NAN)
    alpha, beta = 2 / (period + 1), 2 * math.cos(2 * math.pi / (0.5 * max(period, 6.0)))
    high = np.zeros(n)
    for i in range(1, n):
        high[i] = 0.5 * (1 + alpha) * (close[i] - close[i - 1]) + alpha * high[i - 1]
    real = _resonator(high - _ago(high, 2), 2, alpha, beta)
    imaginary = _resonator(_ago(high, 1) - _ago(high, 3), 4, alpha, beta)
    both = np.isfinite(real) & np.isfinite(imaginary)
    cycle, angle = float(period), 0.0
    with np.errstate(over="ignore", invalid="ignore"):
        for i in range(period + 2, n):
            some = both[i - period + 1 : i + 1]
            x, y = real[i - period + 1 : i + 1][some], imaginary[i - period + 1 : i + 1][some]
            spread = float((period * (x @ x) - x.sum() ** 2) * (period * (y @ y) - y.sum() ** 2))
            together = float(period * (x @ y) - x.sum() * y.sum()) / math.sqrt(spread) if spread > 1e-24 else NAN
            if together == together:
                cycle = min(100.0, max(6.0, 2 * math.pi / math.acos(min(0.999, max(-0.999, together)))))
            if both[i]:
                angle = _wrapped(angle + 2 * math.pi / cycle)
                sine[i], cosine[i] = math.sin(angle), math.cos(angle)
    return [sine, cosine]


def phasor(close, period):
    """Phase, continued over whole turns by one at most a bar, and magnitude."""
    inside, quad = _phases(close, period)
    raw, phase = np.arctan2(quad, inside), np.full(len(close), NAN)
    last = NAN
    for i in np.flatnonzero(raw == raw).tolist():
        last = phase[i] = raw[i] if i == 0 or phase[i - 1] != phase[i - 1] else last + _turn(raw[i] - last)
    return [phase, np.where(raw == raw, np.hypot(quad, inside), NAN)]


def cool_down(flags, n):
    """Keeps a true value and drops those of the n - 1 bars after it."""
    out, free = np.zeros(len(flags)), 0
    for i in np.flatnonzero(flags > 0.5).tolist():
        if i >= free:
            out[i], free = 1.0, i + n
    return [out]


def sorted_window(values, n, pick):
    """pick(window) of the last n values, kept sorted: a value goes in and one goes out by binary search, nothing is sorted
    again.  An array of what pick gives, a row for each value from the n-th on."""
    window, out = sorted(values[: n - 1].tolist()), []
    for i in range(n - 1, len(values)):
        insort(window, values[i])
        out.append(pick(window))
        del window[bisect_left(window, values[i - n + 1])]
    return np.array(out)


def sliding(x, n, pick):
    """pick(i, window) at every place i: of the last n values those that are there, kept sorted as in ``sorted_window``."""
    values, window, out = x.tolist(), [], np.full(len(x), NAN)
    for i, v in enumerate(values):
        if v == v:
            insort(window, v)
        if i >= n and values[i - n] == values[i - n]:
            del window[bisect_left(window, values[i - n])]
        out[i] = pick(i, window)
    return out


def sliding_median(x, n):
    return sliding(x, n, lambda _, w: (w[(len(w) - 1) // 2] + w[len(w) // 2]) / 2 if w else NAN)


def sliding_spread(x, centre, n):
    """Mean distance from the centre of each place over n values; missing unless all of them are there."""
    def pick(i, w):
        if len(w) < n or centre[i] != centre[i]:
            return NAN
        below = bisect_left(w, centre[i])
        return (sum(w[below:]) - sum(w[:below]) + centre[i] * (2 * below - n)) / n

    return sliding(x, n, pick)
