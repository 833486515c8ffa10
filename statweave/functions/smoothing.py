"""Exponential smoothing with a multiplicative trend or season, linearised chunk by chunk.

The state is (level, slope?, the last ``period`` seasonal terms, newest first).
From a guessed start a chunk runs the recursion as it is and carries the
derivatives of its state by that start.  What comes out is the same five-part
linear map that additive smoothing has, right near the guess: chunks compose,
the best start state follows from least squares, and it gives every chunk a
better guess.  Where no guess moves any more, the map's errors are the
recursion's own.
"""

from __future__ import annotations

import numpy as np

# A positive part of the state changes by at most this factor from one pass to the next.
STRETCH = 2.0


class CurvedSmoother:
    def __init__(self, trend: str | None, seasonal: str | None, period: int):
        self.trend, self.seasonal, self.period = trend, seasonal, period
        self.slope = int(trend is not None)
        self.size = 1 + self.slope + period

    def guess(self, ys: np.ndarray) -> np.ndarray:
        """A start state from the first values of a chunk: their mean, growth and shape."""
        m = min(len(ys), self.period or 10)
        head, after = ys[:m], ys[m : 2 * m]
        level = float(head.mean())
        state = [level]
        if self.trend:
            next_ = float(after.mean()) if len(after) == m else level
            state.append((next_ / level) ** (1 / m) if self.trend == "mul" else (next_ - level) / m)
        if self.period:
            shape = head / level if self.seasonal == "mul" else head - level
            shape = np.concatenate([shape, np.full(self.period - m, float(self.seasonal == "mul"))])
            state += shape[::-1].tolist()
        return np.array(state)

    def chunk(self, ys: np.ndarray, theta: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
        """The chunk's map near one start for each candidate: end state A z + a, squared errors z'Qz - 2 r'z + c."""
        g, n, m = len(theta), self.size, self.period
        alpha, share, gamma = theta[:, 0], theta[:, 1], theta[:, 2] * (1 - theta[:, 0])
        first = 1 + self.slope
        unit = np.broadcast_to(np.eye(n), (g, n, n))
        level, d_level = start[:, 0].copy(), unit[:, 0].copy()
        slope, d_slope = (start[:, 1].copy(), unit[:, 1].copy()) if self.trend else (None, None)
        # The terms in the order in which rows use them: row i takes and renews the one at i modulo the period.
        season, d_season = start[:, first:][:, ::-1].copy(), unit[:, first:][:, ::-1].copy()
        q, r, c = np.zeros((g, n, n)), np.zeros((g, n)), np.zeros(g)

        def times(x, d):
            return x[:, None] * d

        with np.errstate(all="ignore"):
            for i, y in enumerate(ys):
                if self.trend == "mul":
                    base, d_base = level * slope, times(slope, d_level) + times(level, d_slope)
                elif self.trend:
                    base, d_base = level + slope, d_level + d_slope
                else:
                    base, d_base = level, d_level
                new, d_new = alpha * y + (1 - alpha) * base, times(1 - alpha, d_base)
                value, u = base, d_base
                if m:
                    s, d_s = season[:, i % m], d_season[:, i % m]
                    if self.seasonal == "mul":
                        value, u = base * s, times(s, d_base) + times(base, d_s)
                        new, d_new = alpha * y / s + (1 - alpha) * base, d_new - times(alpha * y / s**2, d_s)
                        s_new, d_s_new = gamma * y / base + (1 - gamma) * s, times(1 - gamma, d_s) - times(gamma * y / base**2, d_base)
                    else:
                        value, u = base + s, d_base + d_s
                        new, d_new = alpha * (y - s) + (1 - alpha) * base, d_new - times(alpha, d_s)
                        s_new, d_s_new = gamma * (y - base) + (1 - gamma) * s, times(1 - gamma, d_s) - times(gamma, d_base)
                    season[:, i % m], d_season[:, i % m] = s_new, d_s_new
                e = y - value + np.einsum("gi,gi->g", u, start)
                q += u[:, :, None] * u[:, None, :]
                r += e[:, None] * u
                c += e * e
                if self.trend == "mul":
                    d_slope = times(share / level, d_new) - times(share * new / level**2, d_level) + times(1 - share, d_slope)
                    slope = share * new / level + (1 - share) * slope
                elif self.trend:
                    d_slope = times(share, d_new - d_level) + times(1 - share, d_slope)
                    slope = share * (new - level) + (1 - share) * slope
                level, d_level = new, d_new
            if m:
                season, d_season = np.roll(season, -(len(ys) % m), axis=1), np.roll(d_season, -(len(ys) % m), axis=1)
            parts = [level[:, None]] + ([slope[:, None]] if self.trend else []) + [season[:, ::-1]]
            d_parts = [d_level[:, None]] + ([d_slope[:, None]] if self.trend else []) + [d_season[:, ::-1]]
            end, a_map = np.concatenate(parts, axis=1), np.concatenate(d_parts, axis=1)
            return a_map, end - np.einsum("gij,gj->gi", a_map, start), q, r, c

    def kept_near(self, new: np.ndarray, old: np.ndarray) -> np.ndarray:
        """New starts, whose positive parts stay within a factor of the old ones; an old one stays where the new one is no number."""
        positive = np.ones(self.size, dtype=bool)
        if self.trend == "add":
            positive[1] = False
        if self.seasonal != "mul":
            positive[1 + self.slope :] = False
        new = np.where(np.isfinite(new), new, old)
        near = np.clip(new, old / STRETCH, old * STRETCH)
        return np.where(positive & (old > 0), near, new)

    def improved(self, used: np.ndarray, q: np.ndarray, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next start state of each candidate by least squares near the used one, and the squared errors there.

        Level and season may be scaled against each other without any change in
        the values; the shortest step leaves that scale where it is.
        """
        z, sse = used.copy(), np.full(len(used), np.inf)
        for i in range(len(used)):
            if np.isfinite(q[i]).all() and np.isfinite(r[i]).all():
                step = np.linalg.pinv(q[i], hermitian=True, rcond=1e-12) @ (r[i] - q[i] @ used[i])
                z[i] = self.kept_near((used[i] + step)[None, :], used[i : i + 1])[0]
                square = z[i] @ q[i] @ z[i]
                # A candidate whose terms have left the range of its errors would look like a perfect fit: rounding counts as error.
                sse[i] = max(0.0, c[i] - 2 * r[i] @ z[i] + square) + 1e-14 * (c[i] + square)
        return z, np.where(np.isfinite(sse), sse, np.inf)

    @staticmethod
    def change(new: np.ndarray, old: np.ndarray) -> float:
        """The largest relative difference of two states; parts near zero are measured against the level."""
        return float(np.max(np.abs(new - old) / np.maximum(np.abs(old), 1e-3 * abs(old[0]) + 1e-300)))

    def settled(self, ys: np.ndarray, theta: np.ndarray, start: np.ndarray, passes: int, still: float) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        """The map of a series that is one chunk, near the start states that its own passes come to."""
        for _ in range(passes):
            parts = self.chunk(ys, theta, start)
            z, sse = self.improved(start, *parts[2:])
            best = int(np.argmin(sse))
            if self.change(z[best], start[best]) <= still:
                break
            start = z
        return parts, start

    def forecast(self, state: np.ndarray, steps: int) -> list[float]:
        out = []
        for h in range(1, steps + 1):
            value = state[0]
            if self.trend:
                value = value * state[1] ** h if self.trend == "mul" else value + h * state[1]
            if self.period:
                s = state[self.size - 1 - (h - 1) % self.period]
                value = value * s if self.seasonal == "mul" else value + s
            out.append(float(value))
        return out
