"""Hidden Markov chains over many keys that share an axis: one loop over places, arrays over keys, in log space throughout.

Transitions are objects that know how to take a step, so a structured chain never builds its matrices: with the chance rho
to stay, else a draw from the prior, and two phases, a step costs as many operations as there are states.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.squeeze(safe, axis) + np.log(np.exp(x - safe).sum(axis))


def safe_log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(x)


@dataclass(frozen=True)
class Dense:
    """Log transition matrices, places - 1 of them."""

    logs: np.ndarray

    def __post_init__(self):
        if np.isnan(self.logs).any() or (self.logs == np.inf).any() or not np.allclose(np.exp(self.logs).sum(-1), 1, atol=1e-10):
            raise ValueError("transition rows must be normalised")

    def forward(self, t: int, x: np.ndarray) -> np.ndarray:
        return log_sum(x[..., :, None] + self.logs[t], -2)

    def backward(self, t: int, x: np.ndarray) -> np.ndarray:
        return log_sum(self.logs[t] + x[..., None, :], -1)

    def best(self, t: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = x[..., :, None] + self.logs[t]
        return y.max(-2), y.argmax(-2)

    def into(self, low: int, high: int) -> np.ndarray:
        """Logs of the transitions from places low ... high - 1, as places x states at the next place x states."""
        return self.logs[low:high].swapaxes(1, 2)


@dataclass(frozen=True)
class Structured:
    """States x phases: stay with rho, else draw from the prior; phases switch with ``switch`` independently. State c of phase z
    has the number 2 c + z. Without phases, ``switch`` is None."""

    rho: np.ndarray
    prior: np.ndarray
    switch: np.ndarray | None = None

    @cached_property
    def _logs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
        """Of all places at once: the chance to stay, the draws from the prior, and the phases' to stay and to turn."""
        sides = (None, None) if self.switch is None else (safe_log(1 - self.switch), safe_log(self.switch))
        return safe_log(self.rho), safe_log((1 - self.rho)[:, None] * self.prior)[..., None], *sides

    def _phases(self, t: int, m: np.ndarray) -> np.ndarray:
        _, _, stay, turn = self._logs
        return m if stay is None else np.logaddexp(m + stay[t], m[..., ::-1] + turn[t])

    def _split(self, x: np.ndarray) -> np.ndarray:
        return x.reshape(*x.shape[:-1], len(self.prior), -1)

    def forward(self, t: int, x: np.ndarray) -> np.ndarray:
        m = self._phases(t, self._split(x))
        drawn = self._logs[1][t] + log_sum(m, -2)[..., None, :]
        return np.logaddexp(self._logs[0][t] + m, drawn).reshape(x.shape)

    def backward(self, t: int, x: np.ndarray) -> np.ndarray:
        m = self._split(x)
        drawn = log_sum(self._logs[1][t] + m, -2)[..., None, :]
        return self._phases(t, np.logaddexp(self._logs[0][t] + m, drawn)).reshape(x.shape)

    def matrix(self, t: int) -> np.ndarray:
        k = len(self.prior)
        cn = self.rho[t] * np.eye(k) + (1 - self.rho[t]) * self.prior[None, :]
        if self.switch is None:
            return safe_log(cn)
        s = self.switch[t]
        return safe_log(np.kron(cn, np.array([[1 - s, s], [s, 1 - s]])))

    def best(self, t: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = x[..., :, None] + self.matrix(t)
        return y.max(-2), y.argmax(-2)

    def into(self, low: int, high: int) -> np.ndarray:
        rho, k = self.rho[low:high, None, None], len(self.prior)
        cn = rho * np.eye(k) + (1 - rho) * self.prior[None, None, :]
        if self.switch is not None:
            s = self.switch[low:high]
            turns = np.stack([np.stack([1 - s, s], -1), np.stack([s, 1 - s], -1)], -2)
            cn = (cn[:, :, None, :, None] * turns[:, None, :, None, :]).reshape(-1, 2 * k, 2 * k)
        return safe_log(cn).swapaxes(1, 2)


def _checked(initial: np.ndarray, emissions: np.ndarray) -> None:
    if np.isnan(emissions).any() or (emissions == np.inf).any():
        raise ValueError("emissions must be neither NaN nor infinite")
    if abs(np.exp(initial).sum() - 1) > 1e-10:
        raise ValueError("the initial distribution must be normalised")


def filtered(initial: np.ndarray, steps, emissions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log forward variables (keys x places x states) and each key's log evidence."""
    _checked(initial, emissions)
    out = np.empty_like(emissions)
    out[:, 0] = initial + emissions[:, 0]
    for t in range(1, emissions.shape[1]):
        out[:, t] = steps.forward(t - 1, out[:, t - 1]) + emissions[:, t]
    return out, log_sum(out[:, -1], -1)


def evidence(initial: np.ndarray, steps, emissions: np.ndarray) -> np.ndarray:
    """Each key's log evidence, without keeping the chain."""
    _checked(initial, emissions)
    now = initial + emissions[:, 0]
    for t in range(1, emissions.shape[1]):
        now = steps.forward(t - 1, now) + emissions[:, t]
    return log_sum(now, -1)


def marginals(initial: np.ndarray, steps, emissions: np.ndarray, forward: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Posterior state probabilities (keys x places x states) and log evidence. forward: filtered()'s result, if it is at hand."""
    ahead, score = forward or filtered(initial, steps, emissions)
    out = np.empty_like(ahead)
    back = np.zeros_like(emissions[:, 0])
    for t in range(emissions.shape[1] - 1, -1, -1):
        joint = ahead[:, t] + back
        out[:, t] = np.exp(joint - log_sum(joint, -1)[:, None])
        if t:
            back = steps.backward(t - 1, back + emissions[:, t])
            back = back - back.max(-1, keepdims=True)
    return out / out.sum(-1, keepdims=True), score


def viterbi(initial: np.ndarray, steps, emissions: np.ndarray) -> np.ndarray:
    """Most probable paths (keys x places); of equal ones the first state."""
    _checked(initial, emissions)
    keys, places, states = emissions.shape
    from_ = np.zeros((keys, places, states), np.int32)
    score = initial + emissions[:, 0]
    for t in range(1, places):
        score, from_[:, t] = steps.best(t - 1, score)
        score = score + emissions[:, t]
    path = np.empty((keys, places), np.int64)
    path[:, -1] = score.argmax(-1)
    for t in range(places - 1, 0, -1):
        path[:, t - 1] = from_[np.arange(keys), t, path[:, t]]
    return path


def _pick(total: np.ndarray, uniform: np.ndarray) -> np.ndarray:
    """States by inversion of the distribution functions (sums so far); the last state where rounding leaves none."""
    return np.minimum((total <= uniform[..., None] * total[..., -1:]).sum(-1), total.shape[-1] - 1)


def _sums(logs: np.ndarray) -> np.ndarray:
    return np.cumsum(np.exp(logs - logs.max(-1, keepdims=True)), -1)


#: Places whose distributions are made at once for sampled(), and for sampled_back(), which has many keys.
PLACES, FEW = 1024, 64


def sampled(ahead: np.ndarray, steps, uniforms: np.ndarray) -> np.ndarray:
    """Paths (draws x places) from one key's forward variables (places x states) by filtering ahead and sampling back.
    uniforms: draws x places. A place has one distribution for each state that may follow, whatever the number of draws; those of many
    places are made at once."""
    draws, places = uniforms.shape
    path = np.empty((places, draws), np.int32)
    back = np.ascontiguousarray(uniforms.T)
    path[-1] = _pick(np.broadcast_to(_sums(ahead[-1]), (draws, ahead.shape[1])), back[-1])
    for high in range(places - 1, 0, -PLACES):
        low = max(high - PLACES, 0)
        totals = _sums(ahead[low:high, None, :] + steps.into(low, high))
        for t in range(high - 1, low - 1, -1):
            path[t] = _pick(totals[t - low].take(path[t + 1], 0), back[t])
    return path.T


def sampled_back(ahead: np.ndarray, steps, first: int, uniforms: np.ndarray, after: np.ndarray | None = None) -> np.ndarray:
    """sampled() for many keys at once and some places, from ``first`` on, of longer chains: states as places x keys x draws. ahead: keys x
    places x states; uniforms: places x keys x draws; after: the states of the next place (keys x draws), none at a chain's end."""
    keys, places, states = ahead.shape
    path = np.empty(uniforms.shape, np.int32)
    if after is None:
        places -= 1
        after = path[places] = _pick(np.broadcast_to(_sums(ahead[:, places])[:, None], (*uniforms.shape[1:], states)), uniforms[places])
    base, code = (np.arange(keys) * states)[:, None], np.dtype("u1" if states < 256 else "i8")
    for high in range(places, 0, -FEW):
        low = max(high - FEW, 0)
        totals = _sums(ahead[:, low:high, None, :] + steps.into(first + low, first + high))
        totals = np.ascontiguousarray(totals.transpose(1, 3, 0, 2)).reshape(high - low, states, -1)  # places x states x (keys x next states)
        for t in range(high - 1, low - 1, -1):
            total = totals[t - low].take((base + after).ravel(), 1)
            below = (total <= uniforms[t].ravel() * total[-1]).view("u1").sum(0, dtype=code)
            after = path[t] = np.minimum(below, states - 1).reshape(after.shape)
    return path


def constant_segments(emissions: np.ndarray, switch: np.ndarray | None, start: int, stop: int) -> np.ndarray:
    """Log likelihood of each state held over places start ... stop - 1 of one key; phases are summed over if there are any."""
    part = emissions[start:stop]
    if switch is None:
        return part.sum(0)
    part = part.reshape(len(part), -1, 2)
    now = part[0] + np.log(0.5)
    for t in range(1, len(part)):
        s = switch[start + t - 1]
        now = np.logaddexp(now + safe_log(1 - s), now[:, ::-1] + safe_log(s)) + part[t]
    return log_sum(now, -1)
