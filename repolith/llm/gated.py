"""A bidirectional gated recurrent network with attention pooling, in numpy."""

from __future__ import annotations

import numpy as np


def _soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|): a tanh that needs no exponentials."""
    return x / (1 + np.abs(x))


def _slope(y: np.ndarray) -> np.ndarray:
    """Slope of _soft where its value is y."""
    return (1 - np.abs(y)) ** 2


class GatedNetwork:
    """Inputs are (batch, steps, size) with a mask; the output is a logit for each row of the batch."""

    def __init__(self, size: int, hidden: int = 8, attention: int = 8, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.hidden = hidden
        self.p = {
            "Wf": init(size, 3 * hidden), "Uf": init(hidden, 3 * hidden), "bf": np.zeros(3 * hidden, np.float32),
            "Wb": init(size, 3 * hidden), "Ub": init(hidden, 3 * hidden), "bb": np.zeros(3 * hidden, np.float32),
            "A": init(2 * hidden, attention), "a": np.zeros(attention, np.float32), "v": init(attention),
            "w": init(2 * hidden), "b": np.full(1, -1, np.float32),
        }

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        n, steps, _ = x.shape
        k, u = self.hidden, self.p["U" + d]
        h, out = np.zeros((n, k), np.float32), np.empty((n, steps, k), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = h @ u
            gates = 0.5 + 0.5 * _soft(x[:, t, : 2 * k] + g[:, : 2 * k])
            r, z = gates[:, :k], gates[:, k:]
            c = _soft(x[:, t, 2 * k :] + r * g[:, 2 * k :])
            m = mask[:, t, None]
            if keep is not None:
                keep.append((t, h, r, z, c, g[:, 2 * k :], m))
            h = h + m * (1 - z) * (c - h)
            out[:, t] = h
        return out

    def project(self, x: np.ndarray) -> np.ndarray:
        """What both directions take from an input; it needs computing once a word, not once a window."""
        return np.concatenate([x @ self.p["Wf"] + self.p["bf"], x @ self.p["Wb"] + self.p["bb"]], axis=-1)

    def forward(self, projected: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        k = 3 * self.hidden
        f, b = ([], []) if keep is not None else (None, None)
        s = np.concatenate([self._run(projected[..., :k], mask, "f", f), self._run(projected[..., k:], mask, "b", b)], axis=2)
        e = _soft(s @ self.p["A"] + self.p["a"])
        score = np.where(mask > 0, e @ self.p["v"], np.float32(-1e9))
        weight = np.exp(score - score.max(axis=1, keepdims=True)) * mask
        weight /= np.maximum(weight.sum(axis=1, keepdims=True), 1e-9)
        pooled = np.einsum("nt,nth->nh", weight, s)
        if keep is not None:
            keep |= {"f": f, "b": b, "s": s, "e": e, "weight": weight, "pooled": pooled, "mask": mask}
        return pooled @ self.p["w"] + self.p["b"][0]

    def backward(self, x: np.ndarray, keep: dict, d_logit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters and of the input."""
        p, k = self.p, self.hidden
        s, e, weight, mask = keep["s"], keep["e"], keep["weight"], keep["mask"]
        grad = {"w": keep["pooled"].T @ d_logit, "b": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * p["w"]
        d_weight = np.einsum("nh,nth->nt", d_pooled, s)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        grad["v"] = np.einsum("nt,nta->a", d_score, e)
        d_e = d_score[:, :, None] * p["v"] * _slope(e) * mask[:, :, None]
        grad["A"], grad["a"] = np.einsum("nth,nta->ha", s, d_e), d_e.sum(axis=(0, 1))
        d_s = weight[:, :, None] * d_pooled[:, None] + d_e @ p["A"].T
        d_x = np.zeros_like(x)
        for d, part in (("f", d_s[:, :, :k]), ("b", d_s[:, :, k:])):
            d_h = np.zeros((len(x), k), np.float32)
            d_u, d_w, d_b = np.zeros_like(p["U" + d]), np.zeros_like(p["W" + d]), np.zeros(3 * k, np.float32)
            for t, h, r, z, c, g, m in reversed(keep[d]):
                d_h = d_h + part[:, t]
                d_z, d_c = -d_h * m * (c - h), d_h * m * (1 - z)
                d_nc = d_c * _slope(c)
                d_r = d_nc * g
                gate = lambda y: 0.5 * _slope(2 * y - 1)
                d_rz = np.concatenate([d_r * gate(r), d_z * gate(z)], axis=1)
                d_g = np.concatenate([d_rz, d_nc * r], axis=1)
                d_in = np.concatenate([d_rz, d_nc], axis=1)
                d_u += h.T @ d_g
                d_w += x[:, t].T @ d_in
                d_b += d_in.sum(axis=0)
                d_x[:, t] += d_in @ p["W" + d].T
                d_h = d_h * (1 - m * (1 - z)) + d_g @ p["U" + d].T
            grad |= {"U" + d: d_u, "W" + d: d_w, "b" + d: d_b}
        return grad, d_x


class Adam:
    """With ``sparse``, rows whose gradient is zero stay as they are."""

    def __init__(self, rate: float, sparse: bool = False) -> None:
        self.rate, self.sparse, self.t, self.state = rate, sparse, 0, {}

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for name, g in grads.items():
            m, v = self.state.setdefault(name, (np.zeros_like(params[name]), np.zeros_like(params[name])))
            own = np.flatnonzero(g.any(axis=1)) if self.sparse else ...
            m[own] += 0.1 * (g[own] - m[own])
            v[own] += 0.001 * (g[own] * g[own] - v[own])
            params[name][own] -= self.rate * (m[own] / (1 - 0.9**self.t)) / (np.sqrt(v[own] / (1 - 0.999**self.t)) + 1e-8)
