"""Numeric fits for batches of short series, run inside Spark tasks.

Every function takes a list of 1-d arrays that end at the forecast origin and a horizon, and
returns one array per series. Series are aligned at their ends, the longest first, and all parameter
candidates of the series that have begun advance together, one period at a time and in place. What is
fitted before the search (seasons, trends, first levels) is worked out for all series of a length together.
"""

from __future__ import annotations

import numpy as np

from .fixed import ARIMA_ORDERS

_CHUNK = 256
#: Values of one state of a search, candidates times series, that advance together: they stay in a core's cache.
_BLOCK = 8192


def _align(series: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Left-padded matrix and the first valid position of each row."""
    width = max(len(y) for y in series)
    out = np.zeros((len(series), width))
    first = np.zeros(len(series), dtype=int)
    for i, y in enumerate(series):
        first[i] = width - len(y)
        out[i, first[i]:] = y
    return out, first


def _begun(first: np.ndarray, width: int) -> np.ndarray:
    """How many series have begun at each period; ``first`` never falls."""
    return np.searchsorted(first, np.arange(width), side="right")


def _by_length(y: np.ndarray, first: np.ndarray):
    """Rows of each length, and their values without padding."""
    for at in np.unique(first):
        rows = np.flatnonzero(first == at)
        yield rows, y[rows, at:]


def _blocks(n: int, candidates: int):
    size = max(1, _BLOCK // max(candidates, 1))
    return (slice(at, at + size) for at in range(0, n, size))


def _slopes(y: np.ndarray) -> np.ndarray:
    """Least squares slope of each row."""
    ticks = np.arange(y.shape[1]) - (y.shape[1] - 1) / 2.0
    return (y - y.mean(axis=1, keepdims=True)) @ ticks / (ticks @ ticks)


def _around(best: np.ndarray, width: float, low, high, n: int = 5) -> np.ndarray:
    """Product grid around each row of ``best``: (series, n ** params, params)."""
    free = np.broadcast_to(np.asarray(high) > np.asarray(low), best.shape[1])
    ticks = [np.linspace(-1, 1, n) if one else np.zeros(1) for one in free]
    offsets = np.stack(np.meshgrid(*ticks, indexing="ij"), -1).reshape(-1, best.shape[1])
    return np.clip(best[:, None, :] + width * (np.asarray(high) - low) * offsets[None], low, high)


def _search(score, grid: np.ndarray, low, high, count: int, rounds: int = 2, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Bounded search: a common grid first, then shrinking grids around each series' best."""
    cand = np.broadcast_to(grid[None], (count, *grid.shape))
    width, best, value = 0.12, None, None
    for turn in range(rounds + 1):
        loss = score(cand)
        pick = np.nanargmin(np.where(np.isfinite(loss), loss, np.inf), axis=1)
        rows = np.arange(count)
        found, found_value = cand[rows, pick], loss[rows, pick]
        if best is None:
            best, value = found, found_value
        else:
            value = loss[:, loss.shape[1] // 2]  # the middle of a grid is the best so far
            better = found_value < value
            best = np.where(better[:, None], found, best)
            value = np.where(better, found_value, value)
        if turn < rounds:
            cand = _around(best, width, low, high, n)
            width /= 3.0
    return best, value


# --- damped trend smoothing with optional additive seasons ---------------------------------


def _ets_start(y: np.ndarray, season: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First level, trend and seasons of rows of one length."""
    n, size = y.shape
    if season > 1:
        k = size // season
        cycles = y[:, : k * season].reshape(n, k, season)
        means = cycles.mean(axis=2)
        trend = (means[:, -1] - means[:, 0]) / max((k - 1) * season, 1)
        shape = (cycles - means[:, :, None]).mean(axis=1)
        return means[:, 0] - trend * (season - 1) / 2.0, trend, shape - shape.mean(axis=1, keepdims=True)
    m = min(size, 10)
    slope = _slopes(y[:, :m])
    return y[:, :m].mean(axis=1) - slope * (m - 1) / 2.0 - slope, slope, np.zeros((n, 1))


def _ets_chunk(series: list[np.ndarray], steps: int, season: int) -> np.ndarray:
    y, first = _align(series)
    n, width = y.shape
    level0, trend0 = np.zeros(n), np.zeros(n)
    # slot t % season of a column is the same for every series, because all end together
    wheel0 = np.zeros((season, n))
    for rows, own in _by_length(y, first):
        level0[rows], trend0[rows], shape = _ets_start(own, season)
        wheel0[np.ix_((first[rows[0]] + np.arange(season)) % season, rows)] = shape.T
    begun = _begun(first, width)

    def run(p: np.ndarray, part: slice = slice(None)):
        a, b, g, phi = (np.ascontiguousarray(p[..., i]) for i in range(4))
        b = a * b
        g = (1.0 - a) * g
        level = np.repeat(level0[part, None], a.shape[1], axis=1)
        trend = np.repeat(trend0[part, None], a.shape[1], axis=1)
        wheel = np.repeat(wheel0[:, part, None], a.shape[1], axis=2)
        sse, damped, base, err, made = (np.zeros(a.shape) for _ in range(5))
        now = y[part].T[:, :, None]
        live = np.clip(begun - (part.start or 0), 0, len(a))
        for t in range(width):
            k = live[t]
            if not k:
                continue
            slot = wheel[t % season, :k]
            d, at, e, m = damped[:k], base[:k], err[:k], made[:k]
            np.multiply(phi[:k], trend[:k], out=d)
            np.add(level[:k], d, out=at)
            if season > 1:
                np.subtract(now[t, :k], np.add(at, slot, out=m), out=e)
            else:
                np.subtract(now[t, :k], at, out=e)
            sse[:k] += np.multiply(e, e, out=m)
            np.add(at, np.multiply(a[:k], e, out=m), out=level[:k])
            np.add(d, np.multiply(b[:k], e, out=m), out=trend[:k])
            if season > 1:
                slot += np.multiply(g[:k], e, out=m)
        return sse, level, trend, wheel

    def score(p: np.ndarray) -> np.ndarray:
        return np.concatenate([run(p[part], part)[0] for part in _blocks(n, p.shape[1])])

    low, high = np.array([0.01, 0.0, 0.0, 0.8]), np.array([0.99, 0.99, 0.99 if season > 1 else 0.0, 0.995])
    axes = [[0.05, 0.2, 0.5, 0.8], [0.01, 0.1, 0.4], [0.01, 0.1, 0.4] if season > 1 else [0.0], [0.85, 0.98]]
    grid = np.stack(np.meshgrid(*axes, indexing="ij"), -1).reshape(-1, 4)
    best, _ = _search(score, grid, low, high, n, rounds=2, n=3)
    _, level, trend, wheel = run(best[:, None, :])
    phi = best[:, 3]
    ahead = np.cumsum(phi[:, None] ** np.arange(1, steps + 1)[None], axis=1)
    out = level[:, :1] + trend[:, :1] * ahead
    if season > 1:
        out += wheel[(width + np.arange(steps)) % season, :, 0].T
    return out


# --- small ARIMA orders by conditional least squares -----------------------------------------


def _arma_sse(w: np.ndarray, first: np.ndarray, ar: np.ndarray, ma: np.ndarray):
    """Squared one-step errors; ``ar`` and ``ma`` are (series, candidates, order), ``w`` is zero before ``first``."""
    n, width = w.shape
    p, q = ar.shape[2], ma.shape[2]
    shape = (n, ar.shape[1] if ar.size else ma.shape[1])
    ar, ma = [np.ascontiguousarray(ar[..., i]) for i in range(p)], [np.ascontiguousarray(ma[..., i]) for i in range(q)]
    e1, e2, err, guess, made, sse = (np.zeros(shape) for _ in range(6))
    now = np.ascontiguousarray(w.T)[:, :, None]
    for t, k in enumerate(_begun(first, width)):
        if not k:
            continue
        g, m, e = guess[:k], made[:k], err[:k]
        terms = [(ar[i][:k], now[t - i - 1, :k]) for i in range(p) if t - i - 1 >= 0]
        terms += [(one[:k], old[:k]) for one, old in zip(ma, (e1, e2))]
        for i, (one, old) in enumerate(terms):
            if i:
                np.add(g, np.multiply(one, old, out=m), out=g)
            else:
                np.multiply(one, old, out=g)
        if terms:
            np.subtract(now[t, :k], g, out=e)
        else:
            e[:] = now[t, :k]
        sse[:k] += np.multiply(e, e, out=m)
        e1, e2, err = err, e1, e2
    return sse, e1, e2


def _grid_sse(w: np.ndarray, first: np.ndarray, p: np.ndarray, order: tuple[int, int, int]) -> np.ndarray:
    """Squared errors of candidates that are products of AR and MA values, AR first.

    Errors are linear in the AR values: the series filtered by the MA value alone, minus its own
    past values times the AR values. So only MA values need a pass over the periods each. Series whose best
    candidates are as good as equal are scored candidate by candidate; unstable ones score infinity.
    """
    (n, width), (ar, _, ma) = w.shape, order

    def each_by_itself(rows):
        w_of, first_of, p_of = w[rows], first[rows], p[rows]
        parts = _blocks(len(w_of), p.shape[1])
        return np.concatenate([_arma_sse(w_of[part], first_of[part], *_split(p_of[part], order))[0] for part in parts])

    stable = _stable(p, order)
    if not ar or ma > 1:
        return np.where(stable, each_by_itself(slice(None)), np.inf)
    each = round(p.shape[1] ** (1.0 / p.shape[2]))
    cells = p.reshape(n, each ** ar, -1, ar + ma)
    theta = np.ascontiguousarray(cells[:, 0, :, -1]) if ma else np.zeros((n, 1))
    a = [cells[:, :, :1, i] for i in range(ar)]
    old = [np.zeros(theta.shape) for _ in range(ar)]
    new, made = np.zeros(theta.shape), np.zeros(theta.shape)
    # sums of products of the filtered series with itself 0, 1 and 2 periods earlier, and the same sums a period ago
    sums = [np.zeros(theta.shape) for _ in range(ar + 1)]
    before: list[list[np.ndarray]] = []
    now = np.ascontiguousarray(w.T)[:, :, None]
    for t, k in enumerate(_begun(first, width)):
        if t >= width - ar:
            before.append([one.copy() for one in sums])
        if not k:
            continue
        f, m = new[:k], made[:k]
        np.subtract(now[t, :k], np.multiply(theta[:k], old[0][:k], out=m), out=f)
        for one, other in zip(sums, (new, *old)):
            one[:k] += np.multiply(f, other[:k], out=m)
        new, old = old[-1], [new, *old[:-1]]
    before.append(sums)
    s = [[one[:, None, :] for one in each_time] for each_time in before[::-1]]
    sse = s[0][0] - 2.0 * a[0] * s[0][1] + a[0] * a[0] * s[1][0]
    if ar > 1:
        sse = sse - 2.0 * a[1] * s[0][2] + 2.0 * a[0] * a[1] * s[1][1] + a[1] * a[1] * s[2][0]
    out = np.where(stable, np.maximum(sse, 0.0).reshape(n, -1), np.inf)
    rounding = 1e-11 * sums[0].max(axis=1, keepdims=True)
    close = np.count_nonzero(out <= out.min(axis=1, keepdims=True) * (1.0 + 1e-9) + rounding, axis=1)
    if (close > 1).any():
        rows = np.flatnonzero(close > 1)
        out[rows] = np.where(stable[rows], each_by_itself(rows), np.inf)
    return out


def _split(p: np.ndarray, order: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    return p[..., : order[0]], p[..., order[0]: order[0] + order[2]]


def _stable(p: np.ndarray, order: tuple[int, int, int]) -> np.ndarray:
    ok = np.ones(p.shape[:-1], dtype=bool)
    for part, sign in zip(_split(p, order), (1.0, -1.0)):
        if part.shape[-1] == 2:
            a, b = sign * part[..., 0], sign * part[..., 1]
            ok &= (np.abs(b) < 0.99) & (a + b < 0.99) & (b - a < 0.99)
    return ok


def _arima_chunk(series: list[np.ndarray], steps: int) -> np.ndarray:
    y, first = _align(series)
    n = len(series)
    best_aic = np.full(n, np.inf)
    out = np.repeat(y[:, -1:], steps, axis=1)
    for order in ARIMA_ORDERS:
        p, d, q = order
        w, w_first = (np.diff(y, axis=1), first) if d else (y, first)
        if d:
            # the first difference of a padded row mixes padding with data
            w_first = first
            w = np.where(np.arange(w.shape[1])[None] >= first[:, None], w, 0.0)
        size = w.shape[1] - w_first
        k = p + q
        ticks = np.linspace(-0.95, 0.95, 39 if k == 1 else 13)
        grid = np.stack(np.meshgrid(*[ticks] * k, indexing="ij"), -1).reshape(-1, k)

        def score(c, order=order, w=w, w_first=w_first):
            return _grid_sse(w, w_first, c, order)

        best, _ = _search(score, grid, -0.98, 0.98, n, rounds=2, n=5)
        ar, ma = _split(best[:, None, :], order)
        found, e1, e2 = _arma_sse(w, w_first, ar, ma)
        sse = found[:, 0]
        sigma2 = np.maximum(sse / np.maximum(size, 1), 1e-12)
        aic = size * (np.log(2.0 * np.pi * sigma2) + 1.0) + 2.0 * (k + 1)
        past, errs = [w[:, -1], w[:, -2] if w.shape[1] > 1 else w[:, -1]], [e1[:, 0], e2[:, 0]]
        path = np.zeros((n, steps))
        for h in range(steps):
            value = sum((ar[:, 0, i] * past[i] for i in range(p)), np.zeros(n))
            value = value + sum((ma[:, 0, i] * errs[i] for i in range(q)), np.zeros(n))
            path[:, h] = value
            past, errs = [value, past[0]], [np.zeros(n), errs[0]]
        if d:
            path = y[:, -1:] + np.cumsum(path, axis=1)
        better = np.isfinite(aic) & (aic < best_aic)
        out[better] = path[better]
        best_aic = np.where(better, aic, best_aic)
    return out


# --- theta -----------------------------------------------------------------------------------


def _season_index(y: np.ndarray, season: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centred moving average decomposition of rows of one length: index, whether it is a factor, whether it counts."""
    n, size = y.shape
    dev = y - y.mean(axis=1, keepdims=True)
    var = np.einsum("ij,ij->i", dev, dev)
    acf = np.stack([np.einsum("ij,ij->i", dev[:, k:], dev[:, :-k]) for k in range(1, season + 1)], axis=1) / var[:, None]
    bound = 1.645 * np.sqrt((1.0 + 2.0 * np.sum(acf[:, :-1] ** 2, axis=1)) / size)
    counts = ~(var <= 1e-12) & ~(np.abs(acf[:, -1]) <= bound)
    kernel = np.ones(season) / season if season % 2 else np.r_[0.5, np.ones(season - 1), 0.5] / season
    half, inside = len(kernel) // 2, size - len(kernel) + 1
    trend = sum(one * y[:, k: k + inside] for k, one in enumerate(kernel))
    inner = y[:, half: half + inside]
    times = (y > 0).all(axis=1)
    ratio = np.where(times[:, None], inner / trend, inner - trend)
    slots = (np.arange(half, half + inside)) % season
    index = np.repeat(np.where(times, 1.0, 0.0)[:, None], season, axis=1)
    for s in np.unique(slots):
        index[:, s] = ratio[:, slots == s].mean(axis=1)
    middle = index.mean(axis=1, keepdims=True)
    return np.where(times[:, None], index / middle, index - middle), times, counts


def _theta_chunk(series: list[np.ndarray], steps: int, season: int) -> np.ndarray:
    y, first = _align(series)
    n, width = y.shape
    factor, shift, slope = np.ones((n, steps)), np.zeros((n, steps)), np.zeros(n)
    for rows, own in _by_length(y, first):
        if season > 1:
            index, times, counts = _season_index(own, season)
            size = own.shape[1]
            shape = index[:, np.arange(size + steps) % season]
            scale = np.where((counts & times)[:, None], shape, 1.0)
            moved = np.where((counts & ~times)[:, None], shape, 0.0)
            own = own / scale[:, :size] - moved[:, :size]
            factor[rows], shift[rows] = scale[:, size:], moved[:, size:]
            y[rows, first[rows[0]]:] = own
        slope[rows] = _slopes(own)
    start = y[np.arange(n), first]
    begun = _begun(first, width)

    def run(p: np.ndarray):
        a = p[..., 0]
        level = np.repeat(start[:, None], a.shape[1], axis=1)
        sse, err, made = (np.zeros(a.shape) for _ in range(3))
        now = y.T[:, :, None]
        for t, k in enumerate(begun):
            e, m = err[:k], made[:k]
            np.subtract(now[t, :k], level[:k], out=e)
            sse[:k] += np.multiply(e, e, out=m)
            level[:k] += np.multiply(a[:k], e, out=m)
        return sse, level

    grid = np.linspace(0.02, 0.98, 25)[:, None]
    best, _ = _search(lambda p: run(p)[0], grid, 0.01, 0.99, n, rounds=2, n=5)
    level = run(best[:, None, :])[1][:, 0]
    alpha = best[:, 0]
    size = (width - first).astype(float)
    h = np.arange(steps)[None]
    drift = 0.5 * slope[:, None] * (h + 1.0 / alpha[:, None] - ((1.0 - alpha) ** size / alpha)[:, None])
    return (level[:, None] + drift) * factor + shift


# --- public ------------------------------------------------------------------------------------


def _naive(y: np.ndarray, steps: int, season: int) -> np.ndarray:
    seen = list(y)
    for _ in range(steps):
        if len(seen) >= season:
            value = seen[-season]
        else:
            value = float(np.mean(seen[-3:])) if len(seen) >= 3 else seen[-1] if seen else 0.0
        seen.append(max(0.0, value))
    return np.array(seen[len(y):])


_SHORTEST = {"AutoETS": 5, "AutoARIMA": 8, "Theta": 8}


def _fit(kind: str, series: list[np.ndarray], steps: int, season: int) -> np.ndarray:
    if kind == "AutoETS":
        return _ets_chunk(series, steps, season)
    return _theta_chunk(series, steps, season) if kind == "Theta" else _arima_chunk(series, steps)


def forecast_batch(kind: str, series: list[np.ndarray], steps: list[int], season: int) -> list[np.ndarray]:
    """Forecast many series; short or failing ones use the seasonal naive rule."""
    out: list[np.ndarray | None] = [None] * len(series)
    longest = max(steps, default=0)
    groups: dict[int, list[int]] = {}
    for i, y in enumerate(series):
        if len(y) >= _SHORTEST[kind]:
            seasonal = season if kind != "AutoARIMA" and len(y) >= 2 * season else 1
            groups.setdefault(seasonal, []).append(i)
    for seasonal, rows in groups.items():
        rows.sort(key=lambda i: -len(series[i]))
        for at in range(0, len(rows), _CHUNK):
            part = rows[at: at + _CHUNK]
            with np.errstate(all="ignore"):
                values = _fit(kind, [series[i] for i in part], longest, seasonal)
            for i, row in zip(part, values):
                if np.isfinite(row).all():
                    out[i] = np.maximum(row, 0.0)[: steps[i]]
    return [_naive(series[i], steps[i], season) if v is None else v for i, v in enumerate(out)]
