"""ARMA models in state-space form whose filter composes, and a search for the likeliest parameters.

The state is the filtered one after a row.  A run of rows is an element of a
semigroup: given the state x before it, the state after it is normal with mean
A x + b and covariance C, and its rows have the log likelihood

    -(rows log 2 pi s + ld + (ss - 2 eta'x + x'J x) / s) / 2

with s the variance of the shocks, of which all covariances are multiples.  Elements of
neighbouring runs join into that of both, in any grouping, so a long series is
filtered in parts.  The first run starts from the model's own distribution and has no x.
"""

from __future__ import annotations

import numpy as np

from statweave.functions import dist

# Variance of a start state of which nothing is known, as a multiple of the shocks' variance.
DIFFUSE = 1e6


def _coefficients(partial: np.ndarray) -> np.ndarray:
    """Autoregressive coefficients from partial autocorrelations, one row each."""
    out = np.zeros_like(partial)
    for k in range(partial.shape[1]):
        before = out[:, :k].copy()
        out[:, :k] = before - partial[:, k : k + 1] * before[:, ::-1]
        out[:, k] = partial[:, k]
    return out


class Arma:
    """phi(B) PHI(B^s) (w - mean) = theta(B) THETA(B^s) e.

    ``bounded``: parameters are searched on a scale that keeps the model stationary and
    invertible, and the series starts in its stationary distribution.  Otherwise they
    are free, the start is diffuse, and as many rows as states do not count.
    """

    def __init__(self, p: int, q: int, sp: int = 0, sq: int = 0, s: int = 1, mean: bool = False, bounded: bool = True):
        self.p, self.q, self.sp, self.sq, self.s, self.mean, self.bounded = p, q, sp, sq, s, mean, bounded
        self.states = max(p + sp * s, q + sq * s + 1)
        self.burn = 0 if bounded else self.states
        self.names = ["const"] * mean + [f"ar.L{i + 1}" for i in range(p)] + [f"ar.S.L{s * (i + 1)}" for i in range(sp)] + [f"ma.L{i + 1}" for i in range(q)] + [f"ma.S.L{s * (i + 1)}" for i in range(sq)]
        self.size = len(self.names)

    def parameters(self, x: np.ndarray) -> np.ndarray:
        """The parameters at points of the search, one row each."""
        out, at = x.copy(), int(self.mean)
        if self.bounded:
            for k, sign in ((self.p, 1), (self.sp, 1), (self.q, -1), (self.sq, -1)):
                part = x[:, at : at + k]
                out[:, at : at + k] = sign * _coefficients(part / np.sqrt(1 + part * part))
                at += k
        return out

    def lags(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean, autoregressive and moving-average coefficients by lag, padded to the states."""
        g, at, polys = len(values), int(self.mean), []
        for k, seasonal, sign in ((self.p, self.sp, -1), (self.q, self.sq, 1)):
            short, at = values[:, at : at + k], at + k
            # The seasonal coefficients follow their own kind: ar, seasonal ar, ma, seasonal ma.
            long_, at = values[:, at : at + seasonal], at + seasonal
            one = np.concatenate([np.ones((g, 1)), sign * short], axis=1)
            out = np.zeros((g, 1 + k + seasonal * self.s))
            out[:, : k + 1] = one
            for j in range(seasonal):
                out[:, self.s * (j + 1) : self.s * (j + 1) + k + 1] += sign * long_[:, j : j + 1] * one
            polys.append(sign * out[:, 1:])
        pad = lambda v, n: np.concatenate([v, np.zeros((g, n - v.shape[1]))], axis=1)
        return (values[:, 0] if self.mean else np.zeros(g)), pad(polys[0], self.states), pad(polys[1], self.states - 1)

    def start(self, phi: np.ndarray, shock: np.ndarray) -> np.ndarray:
        """Covariance of the first predicted state."""
        g, r = phi.shape
        if not self.bounded:
            return np.broadcast_to(DIFFUSE * np.eye(r), (g, r, r)).copy()
        step, total = _transition(phi), shock[:, :, None] * shock[:, None, :]
        for _ in range(60):
            more = step @ total @ np.swapaxes(step, 1, 2)
            total = total + more
            if not np.isfinite(total).all() or np.abs(more).max() <= 1e-17 * np.abs(total).max():
                break
            step = step @ step
        return total

    def element(self, x: np.ndarray, w: np.ndarray, first: bool) -> tuple[np.ndarray, ...]:
        """(A, b, C, eta, J, ld, ss) of the rows ``w`` for each point of the search."""
        mean, phi, theta = self.lags(self.parameters(x))
        g, r = phi.shape
        shock = np.concatenate([np.ones((g, 1)), theta], axis=1)
        noise = shock[:, :, None] * shock[:, None, :]
        step = _transition(phi)
        turned = np.swapaxes(step, 1, 2).copy()
        a, back = np.zeros((g, r)), np.zeros((g, r, r)) if first else np.broadcast_to(np.eye(r), (g, r, r)).copy()
        cov = np.zeros((g, r, r))
        eta, j, ld, ss = np.zeros((g, r)), np.zeros((g, r, r)), np.zeros(g), np.zeros(g)
        steady, faded, gain, f = False, first, None, None
        for t, value in enumerate(w):
            if t or not first:
                head = a[:, :1].copy()
                a[:, :-1] = a[:, 1:]
                a[:, -1] = 0.0
                a += phi * head
                if not faded:
                    back = step @ back
                if not steady:
                    cov = step @ cov @ turned + noise
            else:
                cov = self.start(phi, shock)
            if not steady:
                f = cov[:, 0, 0].copy()
                gain = cov[:, :, 0] / f[:, None]
                after = cov - gain[:, :, None] * cov[:, :1, :]
                after = (after + np.swapaxes(after, 1, 2)) / 2
                # From here on the covariance repeats itself.
                steady = t > 0 and bool((np.abs(after - last) <= 1e-15 * (1 + np.abs(after))).all())
                cov = last = after
            v = value - mean - a[:, 0]
            if not first or t >= self.burn:
                ld += np.log(f)
                ss += v * v / f
                if not faded:
                    u = back[:, 0, :]
                    eta += u * (v / f)[:, None]
                    j += u[:, :, None] * (u / f[:, None])[:, None, :]
            a += gain * v[:, None]
            if not faded:
                back = back - gain[:, :, None] * back[:, :1, :]
                faded = t % 50 == 49 and float(np.abs(back).max()) < 1e-30
        return back, a, cov, eta, j, ld, ss

    @staticmethod
    def join(one: tuple, two: tuple) -> tuple:
        """The element of two neighbouring runs."""
        a1, b1, c1, e1, j1, l1, s1 = one
        a2, b2, c2, e2, j2, l2, s2 = two
        r = a1.shape[1]
        turn = lambda m: np.swapaxes(m, 1, 2)
        times = lambda m, v: (m @ v[:, :, None])[:, :, 0]
        mixed = np.eye(r) + c1 @ j2
        back = np.linalg.inv(mixed)
        # Of what the second run says about the state between them, the first run's spread taken out.
        seen = j2 @ back
        seen = (seen + turn(seen)) / 2
        told = times(turn(back), e2)
        spread = back @ c1
        b = times(a2, times(back, b1 + times(c1, e2))) + b2
        eta = times(turn(a1), told - times(seen, b1)) + e1
        ss = s1 + s2 + (b1 * times(seen, b1)).sum(1) - 2 * (told * b1).sum(1) - (e2 * times(spread, e2)).sum(1)
        return a2 @ back @ a1, b, a2 @ spread @ turn(a2) + c2, eta, turn(a1) @ seen @ a1 + j1, l1 + l2 + np.linalg.slogdet(mixed)[1], ss

    def pack(self, parts: tuple) -> list[float]:
        g = len(parts[5])
        return np.concatenate([np.asarray(p).reshape(g, -1) for p in parts], axis=1).ravel().tolist()

    def unpack(self, flat) -> tuple:
        r = self.states
        sizes = [r * r, r, r * r, r, r * r, 1, 1]
        m = np.asarray(flat, float).reshape(-1, sum(sizes))
        a, b, c, e, j, ld, ss = np.split(m, np.cumsum(sizes)[:-1], axis=1)
        return a.reshape(-1, r, r), b, c.reshape(-1, r, r), e, j.reshape(-1, r, r), ld[:, 0], ss[:, 0]

    def likelihood(self, whole: tuple, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood at the best variance of the shocks, and that variance, of a series of so many rows."""
        n = max(rows - self.burn, 1)
        variance = np.maximum(whole[6] / n, 1e-300)
        value = -0.5 * (n * (np.log(2 * np.pi * variance) + 1) + whole[5])
        return np.where(np.isfinite(value), value, -1e300), variance

    def starts(self) -> np.ndarray:
        out = []
        for a, m in ((0.0, 0.0), (0.6, 0.4), (0.6, -0.4), (-0.4, 0.4), (1.5, -0.7)):
            out.append([0.0] * self.mean + [a] + [0.0] * (self.p - 1) if self.p else [0.0] * self.mean)
            out[-1] = out[-1] + ([0.5 * a] + [0.0] * (self.sp - 1) if self.sp else [])
            out[-1] = out[-1] + ([m] + [0.0] * (self.q - 1) if self.q else [])
            out[-1] = out[-1] + ([m if self.bounded else -0.5] + [0.0] * (self.sq - 1) if self.sq else [])
        return np.unique(np.array(out, float).reshape(len(out), self.size), axis=0)

    def forecast(self, values: np.ndarray, state: np.ndarray, cov: np.ndarray, variance: float, poly: np.ndarray, tail: list[float], steps: int) -> list[tuple[float, float, float]]:
        """Level and 95 % limits of the next rows; ``poly`` is the differencing, ``tail`` the last levels, oldest first."""
        mean, phi, theta = self.lags(values[None, :])
        step, shock = _transition(phi)[0], np.concatenate([[1.0], theta[0]])
        levels, crit, out = list(tail), dist.norm_ppf(0.975), []
        moves, weights, power, hit = [], [], np.eye(self.states), shock
        for h in range(steps):
            # How a level depends on the last state and on each shock since.
            power = step @ power
            row = power[0].copy()
            shocked = hit[0]
            for k in range(1, min(h, len(poly) - 1) + 1):
                row -= poly[k] * moves[h - k]
                shocked -= poly[k] * weights[h - k]
            moves.append(row)
            weights.append(shocked)
            hit = step @ hit
            state = step @ state
            level = float(state[0] + mean[0]) - sum(c * levels[-k] for k, c in enumerate(poly) if k)
            levels.append(level)
            half = crit * float(np.sqrt(variance * (row @ cov @ row + np.sum(np.square(weights)))))
            out.append((level, level - half, level + half))
        return out


def _transition(phi: np.ndarray) -> np.ndarray:
    g, r = phi.shape
    out = np.zeros((g, r, r))
    out[:, :, 0] = phi
    out[:, np.arange(r - 1), np.arange(1, r)] = 1.0
    return out


class Search:
    """The highest value of a function of a few parameters, by quasi-Newton steps with numerical slopes.

    ``ask`` gives the points to look at next, ``tell`` takes their values; so many points
    at a time can be looked at in one pass over the data.
    """

    STEPS = 2.0 ** -np.arange(-1.0, 13.0, 1.0)
    WIDTH = 1e-4

    def __init__(self, starts: np.ndarray, limit: int = 100):
        self.points, self.phase, self.done, self.rounds, self.limit = np.asarray(starts, float), "start", False, 0, limit
        self.x = self.points[0]
        self.value, self.slope, self.inverse, self.plain = -np.inf, None, None, True
        if self.points.shape[1] == 0:
            self.points = np.zeros((1, 0))

    def ask(self) -> np.ndarray:
        return self.points

    def _probe(self) -> None:
        k = len(self.x)
        wide = self.WIDTH * np.maximum(1.0, np.abs(self.x))
        self.wide = wide
        self.points = np.concatenate([self.x + np.diag(wide), self.x - np.diag(wide)]) if k else np.zeros((1, 0))
        self.phase = "slope"

    def _line(self) -> None:
        direction = self.inverse @ self.slope
        longest = float(np.abs(direction).max(initial=0.0))
        self.direction = direction / max(1.0, longest / 2.0)
        self.points = self.x + self.STEPS[:, None] * self.direction
        self.phase = "line"

    def tell(self, values: np.ndarray) -> None:
        values = np.asarray(values, float)
        k = len(self.x)
        if self.phase == "start":
            best = int(values.argmax())
            self.x, self.value = self.points[best], float(values[best])
            self.inverse = np.eye(k) / max(1.0, abs(self.value))
            if k == 0:
                self.done = True
            else:
                self._probe()
        elif self.phase == "slope":
            slope = (values[:k] - values[k:]) / (2 * self.wide)
            if self.slope is not None and not self.plain:
                moved, turned = self.moved, self.slope - slope
                inner = float(moved @ turned)
                if inner > 1e-12 * float(np.sqrt((moved @ moved) * (turned @ turned))):
                    left = np.eye(k) - np.outer(moved, turned) / inner
                    self.inverse = left @ self.inverse @ left.T + np.outer(moved, moved) / inner
            self.slope = slope
            self._line()
        else:
            self.rounds += 1
            best = int(values.argmax())
            gained = float(values[best]) - self.value
            if gained > 1e-11 * (1 + abs(self.value)):
                self.moved = self.points[best] - self.x
                self.x, self.value, self.plain = self.points[best], float(values[best]), False
                self.done = self.rounds >= self.limit
                self._probe()
            elif not self.plain:
                # No way up along the learned direction: once more along the slope itself.
                self.inverse, self.plain = np.eye(k) / max(1.0, float(np.abs(self.slope).max()) * 10), True
                self._line()
            else:
                self.done = True
