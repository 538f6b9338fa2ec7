"""Bidirectional recurrent layers over symbol sequences in numpy, with backpropagation through time.

Arrays are feature-major (features, sequences) so that gates are contiguous
slices; one-hot inputs make the input weights a table from which columns are
taken. Time is the first axis of stacked states. The backward direction is the
same layer over reversed time.
"""

from __future__ import annotations

import numpy as np

F32 = np.float32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place: through tanh, which numpy vectorises."""
    x *= F32(0.5)
    np.tanh(x, out=x)
    x += F32(1)
    x *= F32(0.5)
    return x


def take_columns(table: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    return np.take(table, symbols, axis=1)


def sum_by_symbol(grads: np.ndarray, symbols: np.ndarray, n: int) -> np.ndarray:
    """Sum of the columns of ``grads`` (features, k) by symbol: the gradient of a column table."""
    order = np.argsort(symbols, kind="stable")
    s = symbols[order]
    begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    out = np.zeros((len(grads), n), F32)
    out[:, s[begin]] = np.add.reduceat(grads[:, order], begin, axis=1)
    return out


class GRU:
    """Gates z, r and candidate n: h' = (1 - z) n + z h, n = tanh(x + r (U h + c))."""

    def __init__(self, symbols: int, hidden: int, rng: np.random.Generator):
        self.h = hidden
        self.p = {
            "x": (rng.normal(size=(3 * hidden, symbols)) * 0.1).astype(F32),
            "u": (rng.normal(size=(3 * hidden, hidden)) / np.sqrt(hidden)).astype(F32),
            "c": np.zeros((hidden, 1), F32),
        }

    def run(self, steps: np.ndarray, keep: bool = False):
        """steps (time, sequences) -> states (time, hidden, sequences); with ``keep`` also what backward needs."""
        h, p = self.h, self.p
        t, n = steps.shape
        out = np.empty((t, h, n), F32)
        state = np.zeros((h, n), F32)
        tape = []
        for i in range(t):
            x = take_columns(p["x"], steps[i])
            u = p["u"] @ state
            x[: 2 * h] += u[: 2 * h]
            zr = _sigmoid(x[: 2 * h])
            z, r = zr[:h], zr[h:]
            v = u[2 * h:]
            v += p["c"]
            m = r * v
            m += x[2 * h:]
            np.tanh(m, out=m)
            new = out[i]
            np.subtract(state, m, out=new)
            new *= z
            new += m
            if keep:
                tape.append((z, r, v, m, state))
            state = new
        return (out, tape) if keep else out

    def back(self, steps: np.ndarray, tape: list, d_out: np.ndarray) -> dict[str, np.ndarray]:
        h, p = self.h, self.p
        t, n = steps.shape
        d_x = np.empty((t, 3 * h, n), F32)
        grads = {"u": np.zeros_like(p["u"]), "c": np.zeros_like(p["c"])}
        d_state = np.zeros((h, n), F32)
        for i in range(t - 1, -1, -1):
            z, r, v, m, before = tape[i]
            d = d_out[i] + d_state
            d_m = d * (1 - z) * (1 - m * m)
            d_z = d * (before - m) * z * (1 - z)
            d_r = d_m * v * r * (1 - r)
            d_v = d_m * r
            d_x[i, :h], d_x[i, h:2 * h], d_x[i, 2 * h:] = d_z, d_r, d_m
            d_u = np.concatenate([d_z, d_r, d_v])
            grads["u"] += d_u @ before.T
            grads["c"] += d_v.sum(axis=1, keepdims=True)
            d_state = d * z + p["u"].T @ d_u
        grads["x"] = sum_by_symbol(d_x.transpose(1, 0, 2).reshape(3 * h, -1), steps.ravel(), p["x"].shape[1])
        return grads


class LSTM:
    """Gates i, f, o and candidate g: c' = f c + i g, h' = o tanh(c')."""

    def __init__(self, symbols: int, hidden: int, rng: np.random.Generator):
        self.h = hidden
        x = rng.normal(size=(4 * hidden, symbols)) * 0.1
        x[hidden:2 * hidden] += 1  # remember by default
        self.p = {"x": x.astype(F32), "u": (rng.normal(size=(4 * hidden, hidden)) / np.sqrt(hidden)).astype(F32)}

    def run(self, steps: np.ndarray, keep: bool = False):
        h, p = self.h, self.p
        t, n = steps.shape
        out = np.empty((t, h, n), F32)
        state, cell = np.zeros((h, n), F32), np.zeros((h, n), F32)
        tape = []
        for i in range(t):
            x = take_columns(p["x"], steps[i])
            x += p["u"] @ state
            gates = _sigmoid(x[: 3 * h])
            g = np.tanh(x[3 * h:], out=x[3 * h:])
            new = gates[h:2 * h] * cell + gates[:h] * g
            tc = np.tanh(new)
            np.multiply(gates[2 * h:], tc, out=out[i])
            if keep:
                tape.append((gates, g, cell, tc, state))
            state, cell = out[i], new
        return (out, tape) if keep else out

    def back(self, steps: np.ndarray, tape: list, d_out: np.ndarray) -> dict[str, np.ndarray]:
        h, p = self.h, self.p
        t, n = steps.shape
        d_x = np.empty((t, 4 * h, n), F32)
        d_u = np.zeros_like(p["u"])
        d_state, d_cell = np.zeros((h, n), F32), np.zeros((h, n), F32)
        for i in range(t - 1, -1, -1):
            gates, g, cell, tc, before = tape[i]
            a, f, o = gates[:h], gates[h:2 * h], gates[2 * h:]
            d = d_out[i] + d_state
            d_cell = d_cell + d * o * (1 - tc * tc)
            row = d_x[i]
            row[:h] = d_cell * g * a * (1 - a)
            row[h:2 * h] = d_cell * cell * f * (1 - f)
            row[2 * h:3 * h] = d * tc * o * (1 - o)
            row[3 * h:] = d_cell * a * (1 - g * g)
            d_u += row @ before.T
            d_state = p["u"].T @ row
            d_cell = d_cell * f
        return {"u": d_u, "x": sum_by_symbol(d_x.transpose(1, 0, 2).reshape(4 * h, -1), steps.ravel(), p["x"].shape[1])}


class Bidirectional:
    """Two layers, one over reversed time, and a linear read-out: scores (time, labels, sequences)."""

    def __init__(self, layer: type, symbols: int, hidden: int, labels: int, rng: np.random.Generator):
        self.forth, self.back_ = layer(symbols, hidden, rng), layer(symbols, hidden, rng)
        self.p = {"w": (rng.normal(size=(labels, 2 * hidden)) * 0.1).astype(F32), "b": np.zeros((labels, 1), F32)}
        self.h = hidden

    def parameters(self) -> dict[str, np.ndarray]:
        return {f"{name}.{k}": v for name, part in (("f", self.forth), ("b", self.back_), ("o", self)) for k, v in part.p.items()}

    def scores(self, steps: np.ndarray) -> np.ndarray:
        h = self.h
        one, two = self.forth.run(steps), self.back_.run(steps[::-1])[::-1]
        return self.p["w"][:, :h] @ one + self.p["w"][:, h:] @ two + self.p["b"]

    def forward(self, steps: np.ndarray):
        one, tape1 = self.forth.run(steps, keep=True)
        two, tape2 = self.back_.run(steps[::-1], keep=True)
        h = self.h
        return self.p["w"][:, :h] @ one + self.p["w"][:, h:] @ two[::-1] + self.p["b"], (one, tape1, two, tape2)

    def backward(self, steps: np.ndarray, kept, d: np.ndarray) -> dict[str, np.ndarray]:
        one, tape1, two, tape2 = kept
        h, w = self.h, self.p["w"]
        d = d.astype(F32)
        d_w = np.concatenate([np.einsum("tcn,thn->ch", d, one), np.einsum("tcn,thn->ch", d, two[::-1])], axis=1)
        g1 = self.forth.back(steps, tape1, w[:, :h].T @ d)
        g2 = self.back_.back(steps[::-1], tape2, (w[:, h:].T @ d)[::-1])
        return {"o.w": d_w, "o.b": d.sum(axis=(0, 2))[:, None], **{f"f.{k}": v for k, v in g1.items()}, **{f"b.{k}": v for k, v in g2.items()}}


class Adam:
    def __init__(self, parameters: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = parameters, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in parameters.items()}
        self.v = {k: np.zeros_like(v) for k, v in parameters.items()}

    def step(self, grads: dict[str, np.ndarray], scale: float = 1.0) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        clip = min(1.0, 5.0 / max(norm, 1e-9))
        for k, g in grads.items():
            g = g * F32(clip)
            self.m[k] = F32(0.9) * self.m[k] + F32(0.1) * g
            self.v[k] = F32(0.99) * self.v[k] + F32(0.01) * g * g
            m, v = self.m[k] / F32(1 - 0.9**self.t), self.v[k] / F32(1 - 0.99**self.t)
            self.p[k] -= (F32(self.rate * scale) * m / (np.sqrt(v) + F32(1e-8))).astype(self.p[k].dtype)
