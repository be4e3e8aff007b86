"""A bidirectional gated recurrent network in numpy: training by backpropagation through time, and fast inference.

A cell, for input gates ``g`` and state ``h``: ``r, z = sigmoid(g_rz + h U_rz)``, ``n = tanh(g_n + r * (h U_n))``,
``h' = z h + (1 - z) n``. Arrays are time-major: input gates are ``[T, B, 3, H]``, states ``[T, B, H]``.
"""

from __future__ import annotations

import numpy as np

F32 = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(g: np.ndarray, u: np.ndarray, reverse: bool = False) -> tuple[np.ndarray, list]:
    """States of one direction and what the backward pass needs. ``u``: ``[3, H, H]``."""
    steps, batch, _, size = g.shape
    out, kept, h = np.empty((steps, batch, size), F32), [None] * steps, np.zeros((batch, size), F32)
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        a = np.matmul(h[None], u)
        r, z = sigmoid(g[t, :, 0] + a[0]), sigmoid(g[t, :, 1] + a[1])
        n = np.tanh(g[t, :, 2] + r * a[2])
        kept[t] = (h, r, z, n, a[2])
        h = n + z * (h - n)
        out[t] = h
    return out, kept


def backward(dout: np.ndarray, kept: list, u: np.ndarray, reverse: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the input gates and of ``u`` for gradients ``dout`` of all states."""
    steps, batch, size = dout.shape
    dg, du, dh = np.empty((steps, batch, 3, size), F32), np.zeros_like(u), np.zeros((batch, size), F32)
    for t in range(steps) if reverse else range(steps - 1, -1, -1):
        h, r, z, n, an = kept[t]
        dh = dh + dout[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * an * r * (1 - r)
        da = np.stack([dr, dz, dn * r])
        du += np.matmul(h.T[None], da)
        dg[t, :, 0], dg[t, :, 1], dg[t, :, 2] = dr, dz, dn
        dh = dh * z + np.matmul(da, u.transpose(0, 2, 1)).sum(0)
    return dg, du


class Adam:
    """Adam over a dict of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], clip: float = 1.0) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        scale = F32(min(1.0, clip / (norm + 1e-9)))
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            g = g * scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= (rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(F32)


def folded(table: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A table of input gates ``[rows, 3, H]`` and ``u`` with the halves of the sigmoids folded in, as :func:`scan` takes
    them: ``[3, rows, H]`` and ``[3, H, H]``."""
    half = np.array([0.5, 0.5, 1.0], F32)
    return np.ascontiguousarray(table.transpose(1, 0, 2) * half[:, None, None]), np.ascontiguousarray(u * np.array([0.5, 0.5, 0.5], F32)[:, None, None])


def scan(table: np.ndarray, u: np.ndarray, x: np.ndarray, readout: np.ndarray, reverse: bool = False):
    """Yields ``(t, h readout)`` over the rows of ``x`` (``[T, B]``, rows of ``table``); nothing else is kept."""
    steps, batch = x.shape
    size = u.shape[1]
    h, a = np.zeros((batch, size), F32), np.empty((3, batch, size), F32)
    g, n = np.empty((3, batch, size), F32), np.empty((batch, size), F32)
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        np.matmul(h[None], u, out=a)
        for k in range(3):
            np.take(table[k], x[t], axis=0, out=g[k], mode="clip")
        a[:2] += g[:2]
        np.tanh(a[:2], out=a[:2])
        a[:2] += 1.0  # twice the sigmoids; the second half is folded into u for the reset gate
        np.multiply(a[0], a[2], out=n)
        n += g[2]
        np.tanh(n, out=n)
        h -= n
        h *= a[1]
        h *= 0.5
        h += n
        yield t, h @ readout
