"""A gated recurrent layer in numpy: one step for scoring, and a window with backpropagation through time for training.

Inputs are numbers of symbols; the input matrix has a row of gate values for each symbol. Gates lie side by side as
update, reset, candidate. The reset gate acts on the product of the state and its matrix, so a step needs one product.
Windows are worked on gate by gate: the numbers of a gate then lie behind one another.
"""

from __future__ import annotations

import numpy as np

GROUP = 8  # rows that are added at once


def layer(symbols: int, hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Weights: W for symbols, U for the state, b inside the reset gate."""
    w = rng.normal(0, 0.3, (symbols, 3 * hidden))
    u = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
    return {"W": w.astype(np.float32), "U": u.astype(np.float32), "b": np.zeros(hidden, np.float32)}


def gates(a: np.ndarray, h: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """Update and reset gates side by side."""
    k = 2 * h.shape[1]
    zr = h @ p["U"][:, :k]
    zr += a[:, :k]
    np.negative(zr, out=zr)
    np.exp(zr, out=zr)
    zr += 1
    return np.reciprocal(zr, out=zr)


def step(a: np.ndarray, h: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """The next states; ``a`` holds the rows of W for the symbols read."""
    k = h.shape[1]
    zr = gates(a, h, p)
    n = h @ p["U"][:, 2 * k :]
    n += p["b"]
    n *= zr[:, k:]
    n += a[:, 2 * k :]
    np.tanh(n, out=n)
    out = h - n
    out *= zr[:, :k]
    out += n
    return out


def by_gate(m: np.ndarray, k: int) -> np.ndarray:
    """The columns of each gate as a matrix of its own."""
    return np.ascontiguousarray(m.reshape(len(m), -1, k).swapaxes(0, 1))


def side_by_side(m: np.ndarray) -> np.ndarray:
    return m.swapaxes(0, 1).reshape(m.shape[1], -1)


def prepared(x: np.ndarray, p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each step of a window the rows of W for the symbols read, gate by gate, and U by gate; the gates' negated."""
    k = p["b"].size
    a = p["W"].reshape(-1, k).take(x[:, None].astype(np.intp) * 3 + np.arange(3)[:, None], axis=0)
    u = by_gate(p["U"], k)
    np.negative(a[:, :2], out=a[:, :2])
    np.negative(u[:2], out=u[:2])
    return a, u


def advance(a: np.ndarray, h: np.ndarray, u: np.ndarray, b: np.ndarray):
    """The next states, then update and reset gates, the product of the state inside the reset gate and the candidates.

    ``a`` holds the inputs of a step and is overwritten.
    """
    product = np.matmul(h, u)
    zr, n, q = a[:2], a[2], product[2]
    zr += product[:2]
    np.exp(zr, out=zr)
    zr += 1
    np.reciprocal(zr, out=zr)
    z, r = zr[0], zr[1]
    q += b
    n += r * q
    np.tanh(n, out=n)
    out = h - n
    out *= z
    out += n
    return out, z, r, q, n


def states(x: np.ndarray, h: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """States after each step of a window ``x`` (steps, lanes)."""
    out = np.empty((*x.shape, h.shape[1]), h.dtype)
    a, u = prepared(x, p)
    for t in range(len(x)):
        out[t] = h = advance(a[t], h, u, p["b"])[0]
    return out


def forward(x: np.ndarray, h: np.ndarray, p: dict[str, np.ndarray], anew: np.ndarray | None = None):
    """States after each step of a window ``x`` (steps, lanes), and what the way back needs.

    ``anew`` says where a lane starts anew before a step.
    """
    out, saved = np.empty((*x.shape, h.shape[1]), h.dtype), []
    a, u = prepared(x, p)
    for t in range(len(x)):
        if anew is not None and anew[t].any():
            h = h.copy()
            h[anew[t]] = 0
        then, *own = advance(a[t], h, u, p["b"])
        saved.append((h, *own))
        out[t] = h = then
    return out, saved


def backward(x: np.ndarray, d_states: np.ndarray, saved, p: dict[str, np.ndarray], anew: np.ndarray | None = None):
    """Gradients of W, U and b from those of the states; nothing flows back beyond the window."""
    k, d_h = p["b"].size, np.zeros_like(d_states[0])
    u = by_gate(p["U"], k).swapaxes(1, 2).copy()
    # by update gate, reset gate, candidate and the product inside the reset gate; one row more, of zeros
    d = np.zeros((4, x.size + 1, k), d_states.dtype)
    before = np.empty(d_states.shape, d_states.dtype)
    for t in range(len(x) - 1, -1, -1):
        h, z, r, q, n = saved[t]
        before[t] = h
        d_z, d_r, d_n, d_q = d[:, t * len(h) : (t + 1) * len(h)]
        d_h += d_states[t]
        np.multiply(n, n, out=d_n)
        np.subtract(1, d_n, out=d_n)
        own = d_h * z  # flows on by the update gate
        d_h -= own
        d_n *= d_h
        np.multiply(d_n, r, out=d_q)
        np.subtract(h, n, out=d_z)
        d_z *= z
        d_z *= d_h
        np.subtract(1, r, out=d_r)
        d_r *= q
        d_r *= d_q
        d_h = own
        for g, v in zip((d_z, d_r, d_q), u, strict=True):
            d_h += g @ v
        if anew is not None and anew[t].any():
            d_h[anew[t]] = 0
    before = before.reshape(-1, k).T
    d_u = np.stack([before @ d[g, :-1] for g in (0, 1, 3)])
    return {"W": side_by_side(rows_summed(x.ravel(), d[:3], len(p["W"]))), "U": side_by_side(d_u), "b": d[3].sum(0)}


def rows_summed(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """In each matrix of ``rows`` the sums of rows with the same index; the last row, of zeros, has none."""
    out = np.zeros((len(rows), n, rows.shape[2]), rows.dtype)
    if not len(index):
        return out
    order = np.argsort(index.astype(np.int16) if n < 1 << 15 else index, kind="stable")  # short numbers sort faster
    keys = index[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    groups = -(-sizes // GROUP)  # filled up with the row of zeros
    ends = np.cumsum(groups)
    at = np.full(int(ends[-1]) * GROUP, len(index))
    at[np.arange(len(keys)) + np.repeat((ends - groups) * GROUP - starts, sizes)] = order
    part = rows.take(at.reshape(-1, GROUP).T, axis=1).sum(1)
    out[:, keys[starts]] = np.add.reduceat(part, ends - groups, axis=1)
    return out


class Adam:
    """Adam over a dictionary of weights, with clipped gradients."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.w, self.rate, self.t = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def update(self, grads: dict[str, np.ndarray], scale: float = 1.0) -> None:
        """Takes a step against ``grads``, which are overwritten."""
        self.t += 1
        size = float(np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values())))
        clip = min(1.0, 5.0 / (size + 1e-12))
        fix = np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            m, v = self.m[k], self.v[k]
            m *= 0.9
            m += g * (0.1 * clip)
            g *= g
            g *= 0.001 * clip * clip
            v *= 0.999
            v += g
            np.sqrt(v, out=g)
            g += 1e-8
            np.divide(m, g, out=g)
            g *= self.rate * scale * float(fix)
            self.w[k] -= g
