"""Multinomial logistic regression on sparse rows: FTRL with elastic net, then a temperature.

Training takes a bounded list of rows and runs where it is called; predictions are made by tasks
that hold the weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Row = tuple[np.ndarray, np.ndarray]  # feature numbers, values


@dataclass
class Model:
    classes: list
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, features: np.ndarray, values: np.ndarray) -> np.ndarray:
        return values.astype(np.float32) @ self.weights[features] + self.bias

    def posterior(self, features: np.ndarray, values: np.ndarray) -> np.ndarray:
        return softmax(self.logits(features, values) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Follow-the-regularised-leader state of all weights; the last row is the bias, unpenalised."""

    def __init__(self, size: int, classes: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.asarray(at) == len(self.z) - 1, 0.0, self.l1)[:, None]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def step(self, at: np.ndarray, x: np.ndarray, target: int) -> None:
        w = self.weights(at)
        miss = softmax(x @ w)
        miss[target] -= 1.0
        g = x[:, None] * miss
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _temperature(logits: np.ndarray, targets: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(targets)), targets], 1e-12)).mean()

    low, high, ratio = -2.5, 2.5, (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(rows: list[Row], labels: list, size: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02,
        l2: float = 0.02, seed: int = 0, held: int = 5) -> Model:
    """Train on four fifths of the rows in seeded order; set the temperature on each ``held``-th row."""
    classes = sorted(set(labels))
    number = {c: k for k, c in enumerate(classes)}
    targets = np.array([number[c] for c in labels])
    order = np.random.default_rng(seed).permutation(len(rows))
    calibrating = order[::held] if len(rows) >= 2 * held else order[:0]
    training = np.setdiff1d(order, calibrating, assume_unique=True)
    state = Ftrl(size, len(classes), alpha, beta, l1, l2)
    for epoch in range(epochs):
        for k in np.random.default_rng(seed + 1 + epoch).permutation(training):
            features, values = rows[k]
            state.step(np.append(features, size), np.append(values, 1.0), targets[k])
    whole = state.weights(np.arange(size + 1)).astype(np.float32)
    model = Model(classes, whole[:size], whole[size])
    if len(calibrating):
        logits = np.array([model.logits(*rows[k]) for k in calibrating])
        model.temperature = _temperature(logits, targets[calibrating])
    return model
