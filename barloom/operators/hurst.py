"""Rolling rescaled-range exponent of one symbol's returns."""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view


def _rescaled_range(x: np.ndarray, lag: int) -> np.ndarray:
    """Range of cumulative deviations over the deviation, for every chunk start.

    Chunks stand in columns, so each step works along the long axis.
    """
    chunks = np.ascontiguousarray(sliding_window_view(x, lag).T)
    off = chunks - chunks.mean(axis=0)
    spread = np.sqrt((off * off).mean(axis=0))
    path = np.cumsum(off, axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(spread > 0, (path.max(axis=0) - path.min(axis=0)) / spread, np.nan)


def rolling_hurst(x: np.ndarray, window: int, max_lag: int) -> np.ndarray:
    """Exponent over each full window of ``x``, clipped to [0, 1].

    A chunk's value depends only on where it starts, so it is computed once per
    start and shared by all windows that contain the chunk.
    """
    out = np.full(len(x), np.nan)
    if len(x) < window:
        return out
    full = ~np.isnan(sliding_window_view(x, window)).any(axis=1)
    starts = np.flatnonzero(full)
    if len(starts) == 0:
        return out
    if window < 2 * max_lag:
        out[starts + window - 1] = 0.5
        return out
    values = np.nan_to_num(x)
    logs = np.full((max_lag - 2, len(starts)), np.nan)
    for row, lag in enumerate(range(2, max_lag)):
        chunk = _rescaled_range(values, lag)
        offsets = np.arange(0, window - lag, lag)
        inside = chunk[starts + offsets[:, None]]
        counted = ~np.isnan(inside)
        n = counted.sum(axis=0)
        total = np.where(counted, inside, 0.0).sum(axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            logs[row] = np.where(n > 0, np.log(total / n), np.nan)
    lags = np.log(np.arange(2, max_lag, dtype=float))[:, None]
    used = ~np.isnan(logs)
    n = used.sum(axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean_lag = np.where(used, lags, 0).sum(axis=0) / n
        mean_log = np.where(used, logs, 0).sum(axis=0) / n
        off = np.where(used, lags - mean_lag, 0)
        slope = (off * np.where(used, logs - mean_log, 0)).sum(axis=0) / (off * off).sum(axis=0)
    out[starts + window - 1] = np.where(n < 2, 0.5, np.clip(slope, 0.0, 1.0))
    return out
