"""Training of the recurrent network: loss, gradient through time, and the optimiser, in numpy.

The network is that of scorers.Network. Its loss is the negative log-likelihood of each token given
those before; gradients are sums over tokens, so those of parts of a batch add up to the batch's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lattix.functions import sequences

Weights = dict[str, np.ndarray]
#: Token positions, padding included, of one pass through the network: bounds its memory.
POSITIONS = 1 << 13


@dataclass(frozen=True)
class Shape:
    embed: int = 128
    hidden: int = 256
    layers: int = 2
    dropout: float = 0.1

    def arrays(self) -> dict[str, tuple[int, ...]]:
        """The shape of each array of the network, in the order in which they are kept."""
        v, h = len(sequences.VOCABULARY), self.hidden
        out: dict[str, tuple[int, ...]] = {"embed.weight": (v, self.embed)}
        for k in range(self.layers):
            out |= {f"gru.weight_ih_l{k}": (3 * h, h if k else self.embed), f"gru.weight_hh_l{k}": (3 * h, h), f"gru.bias_ih_l{k}": (3 * h,), f"gru.bias_hh_l{k}": (3 * h,)}
        return out | {"lm_head.weight": (v, h), "lm_head.bias": (v,)}

    @property
    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.arrays().values())


def initial(shape: Shape, seed: int) -> Weights:
    """Normal embeddings, none for padding; the rest uniform within the inverse root of the hidden size."""
    rng = np.random.default_rng(seed)
    bound = shape.hidden**-0.5
    out = {n: rng.normal(size=s) if n == "embed.weight" else rng.uniform(-bound, bound, s) for n, s in shape.arrays().items()}
    out["embed.weight"][sequences.PAD] = 0
    return out


def flat(weights: Weights) -> np.ndarray:
    return np.concatenate([w.ravel() for w in weights.values()])


def unflat(values: np.ndarray, shape: Shape) -> Weights:
    out, at = {}, 0
    for n, s in shape.arrays().items():
        size = int(np.prod(s))
        out[n] = values[at : at + size].reshape(s)
        at += size
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _forward(x: np.ndarray, w: Weights, layer: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """States of a layer over x (time, row, value) and what its gradient needs."""
    wi, wh, bi, bh = (w[f"gru.{n}_l{layer}"] for n in ("weight_ih", "weight_hh", "bias_ih", "bias_hh"))
    t, b, n = len(x), x.shape[1], wh.shape[1]
    given = x @ wi.T + bi
    h = np.zeros((t + 1, b, n), x.dtype)
    r, z, new, own = (np.empty((t, b, n), x.dtype) for _ in range(4))
    for k in range(t):
        o = h[k] @ wh.T + bh
        r[k] = _sigmoid(given[k, :, :n] + o[:, :n])
        z[k] = _sigmoid(given[k, :, n : 2 * n] + o[:, n : 2 * n])
        own[k] = o[:, 2 * n :]
        new[k] = np.tanh(given[k, :, 2 * n :] + r[k] * own[k])
        h[k + 1] = (1 - z[k]) * new[k] + z[k] * h[k]
    return h[1:], {"x": x, "h": h, "r": r, "z": z, "new": new, "own": own}


def _backward(d: np.ndarray, kept: dict[str, np.ndarray], w: Weights, layer: int, grad: Weights) -> np.ndarray:
    """Adds the layer's gradients, d being that of its states; returns that of its inputs."""
    wi, wh = w[f"gru.weight_ih_l{layer}"], w[f"gru.weight_hh_l{layer}"]
    x, h, r, z, new, own = (kept[k] for k in ("x", "h", "r", "z", "new", "own"))
    t, b, n = d.shape
    given, inner = np.empty((t, b, 3 * n), d.dtype), np.empty((t, b, 3 * n), d.dtype)
    after = np.zeros((b, n), d.dtype)
    for k in range(t - 1, -1, -1):
        dh = d[k] + after
        dn = dh * (1 - z[k]) * (1 - new[k] ** 2)
        dr = dn * own[k] * r[k] * (1 - r[k])
        dz = dh * (h[k] - new[k]) * z[k] * (1 - z[k])
        given[k] = np.concatenate((dr, dz, dn), axis=1)
        inner[k] = np.concatenate((dr, dz, dn * r[k]), axis=1)
        after = dh * z[k] + inner[k] @ wh
    rows = lambda a: a.reshape(-1, a.shape[2])
    grad[f"gru.weight_ih_l{layer}"] += rows(given).T @ rows(x)
    grad[f"gru.weight_hh_l{layer}"] += rows(inner).T @ rows(h[:-1])
    grad[f"gru.bias_ih_l{layer}"] += given.sum(axis=(0, 1))
    grad[f"gru.bias_hh_l{layer}"] += inner.sum(axis=(0, 1))
    return given @ wi


def _pass(ids: list[np.ndarray], w: Weights, shape: Shape, grad: Weights, seeds: list[int] | None) -> list[np.ndarray]:
    kind = w["embed.weight"].dtype
    longest, rows = max(map(len, ids)), len(ids)
    x, y, real = np.full((longest, rows), sequences.PAD), np.full((longest, rows), sequences.PAD), np.zeros((longest, rows), bool)
    for k, s in enumerate(ids):
        x[: len(s), k] = np.concatenate(([sequences.BOS], s[:-1]))
        y[: len(s), k] = s
        real[: len(s), k] = True
    h, kept, masks = w["embed.weight"][x], [], []
    keep = 1 - shape.dropout
    for layer in range(shape.layers):
        h, own = _forward(h, w, layer)
        kept.append(own)
        if seeds and shape.dropout and layer < shape.layers - 1:
            # each row's own mask, so that a batch may be dealt to tasks in any way
            mask = np.stack([np.random.default_rng((s, layer)).random((longest, shape.hidden)) < keep for s in seeds], axis=1) / kind.type(keep)
            h = (h * mask).astype(kind)
            masks.append(mask)
        else:
            masks.append(None)
    logits = h @ w["lm_head.weight"].T + w["lm_head.bias"]
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    total = p.sum(axis=2, keepdims=True)
    ll = np.take_along_axis(logits - np.log(total), y[:, :, None], axis=2)[:, :, 0]
    p /= total
    np.put_along_axis(p, y[:, :, None], np.take_along_axis(p, y[:, :, None], axis=2) - 1, axis=2)
    d = p * real[:, :, None]  # of the sum of negative log-likelihoods
    grad["lm_head.weight"] += d.reshape(-1, d.shape[2]).T @ h.reshape(-1, h.shape[2])
    grad["lm_head.bias"] += d.sum(axis=(0, 1))
    d = d @ w["lm_head.weight"]
    for layer in range(shape.layers - 1, -1, -1):
        if masks[layer] is not None:
            d = (d * masks[layer]).astype(kind)
        d = _backward(d, kept[layer], w, layer, grad)
    np.add.at(grad["embed.weight"], x.ravel(), d.reshape(-1, d.shape[2]))
    return [ll[: len(s), k].astype(float) for k, s in enumerate(ids)]


def gradient(ids: list[np.ndarray], weights: Weights, shape: Shape, seeds: list[int] | None = None) -> tuple[Weights, list[np.ndarray]]:
    """The gradient of the summed negative log-likelihood of sequences of vocabulary numbers, and each token's log-likelihood.

    seeds has one for each sequence and turns dropout between layers on. Padding has no gradient.
    """
    grad = {n: np.zeros(a.shape, a.dtype) for n, a in weights.items()}
    out: list[np.ndarray] = [np.zeros(0)] * len(ids)
    order = sorted((k for k in range(len(ids)) if len(ids[k])), key=lambda k: len(ids[k]))
    while order:
        n = max(1, min(len(order), POSITIONS // len(ids[order[-1]])))
        part, order = order[-n:], order[:-n]
        for k, ll in zip(part, _pass([ids[k] for k in part], weights, shape, grad, [seeds[k] for k in part] if seeds else None), strict=True):
            out[k] = ll
    grad["embed.weight"][sequences.PAD] = 0
    return grad, out


@dataclass
class Adam:
    """Adam with decoupled weight decay, over flat weights."""

    rate: float = 1e-3
    decay: float = 1e-4
    clip: float = 1.0
    betas: tuple[float, float] = (0.9, 0.999)
    steps: int = 0
    first: np.ndarray | float = 0.0
    second: np.ndarray | float = 0.0

    def step(self, weights: np.ndarray, grad: np.ndarray) -> np.ndarray:
        """The next weights; a gradient longer than ``clip`` is cut to that length."""
        grad = grad * min(1.0, self.clip / (float(np.sqrt((grad**2).sum())) + 1e-6))
        self.steps += 1
        a, b = self.betas
        self.first = a * self.first + (1 - a) * grad
        self.second = b * self.second + (1 - b) * grad**2
        rate = self.first / (1 - a**self.steps) / (np.sqrt(self.second / (1 - b**self.steps)) + 1e-8)
        return weights * (1 - self.rate * self.decay) - self.rate * rate
