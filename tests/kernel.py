"""Masked Savitzky-Golay detrending of one curve in plain NumPy: what the column expressions of ``detrend`` are held against."""

from __future__ import annotations

import numpy as np

ORDER, GAP_FACTOR, MIN_SHARE = 2, 5.0, 0.25


def coefficients(window: int, order: int = ORDER) -> np.ndarray:
    """Weights of the middle of a least-squares polynomial over an odd number of even steps."""
    x = np.arange(window) - window // 2
    return np.linalg.pinv(np.vander(x, order + 1, increasing=True))[0]


def trend(flux: np.ndarray, window: int, order: int = ORDER) -> np.ndarray:
    """The smoothed curve; near the ends the polynomial of the first and last whole window is read off."""
    n = len(flux)
    if n < window or window <= order:
        return np.full(n, np.median(flux))
    half = window // 2
    out = np.empty(n)
    out[half : n - half] = np.convolve(flux, coefficients(window, order)[::-1], "valid")
    x = np.arange(window) - half
    fit = np.vander(x, order + 1, increasing=True) @ np.linalg.pinv(np.vander(x, order + 1, increasing=True))
    out[:half] = (fit @ flux[:window])[:half]
    out[n - half :] = (fit @ flux[n - window :])[window - half :]
    return out


def flatten_group(t: np.ndarray, flux: np.ndarray, mask: np.ndarray, window: int, gap_factor: float = GAP_FACTOR, order: int = ORDER) -> tuple[np.ndarray, str]:
    """Flux over trend for one curve in time order, and a status; never raises on bad data."""
    good = np.isfinite(flux)
    flat = np.full(len(flux), np.nan)
    if len(t) < 2:
        return flat, "nodata"
    cadence = float(np.median(np.diff(t)))
    if not cadence > 0:
        return flat, "nodata"
    for part in np.split(np.arange(len(t)), np.flatnonzero(np.diff(t) > gap_factor * cadence) + 1):
        seen = part[good[part] & ~mask[part]]
        if not len(seen):
            continue
        level = trend(np.interp(t[part], t[seen], flux[seen]), window, order)
        with np.errstate(divide="ignore", invalid="ignore"):
            flat[part] = np.where(level != 0, flux[part] / level, np.nan)
    return flat, "" if np.isfinite(flat).any() else "nodata"


def rung(primary: np.ndarray, secondary: np.ndarray, sibling: np.ndarray, least: float = MIN_SHARE) -> np.ndarray | None:
    """The widest mask that leaves enough of the points, as :func:`timeseries.detrend_rung` has it; None if there is none."""
    return next((m for m in (secondary | sibling, secondary, primary) if len(m) and (~m).mean() >= least), None)
