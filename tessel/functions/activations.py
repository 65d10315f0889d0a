"""Activations of a layer and their derivatives: as columns over array<double>, and as numpy functions over samples in rows.

Types: linear, sigmoid, binary (a sigmoid that is sampled in training), tanh (alpha * tanh(beta * x)), ReLU, softmax, and
multinomial (a softmax). The inputs of sigmoids are clipped to +-40.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessel.functions.vectors import softmax

ALPHA_TANH, BETA_TANH = 1.7159, 2.0 / 3.0
CLIP = 40.0
TYPES = ("linear", "sigmoid", "binary", "tanh", "ReLU", "softmax", "multinomial")


def activate(kind: str, net: Column, alpha: float = ALPHA_TANH, beta: float = BETA_TANH) -> Column:
    if kind == "linear":
        return net
    if kind in ("sigmoid", "binary"):
        return F.transform(net, lambda x: 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), x)))))
    if kind == "tanh":
        return F.transform(net, lambda x: alpha * F.tanh(beta * x))
    if kind == "ReLU":
        return F.transform(net, lambda x: F.greatest(F.lit(0.0), x))
    if kind in ("softmax", "multinomial"):
        return softmax(net)
    raise ValueError(f"unknown activation {kind!r}; known: {', '.join(TYPES)}")


def activate_rows(kind: str, net: np.ndarray, alpha: float = ALPHA_TANH, beta: float = BETA_TANH) -> np.ndarray:
    if kind == "linear":
        return net
    if kind in ("sigmoid", "binary"):
        return 1.0 / (1.0 + np.exp(-np.clip(net, -CLIP, CLIP)))
    if kind == "tanh":
        return alpha * np.tanh(beta * net)
    if kind == "ReLU":
        return np.maximum(0.0, net)
    if kind in ("softmax", "multinomial"):
        e = np.exp(net - net.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)
    raise ValueError(f"unknown activation {kind!r}; known: {', '.join(TYPES)}")


def slope_rows(kind: str, act: np.ndarray, net: np.ndarray, alpha: float = ALPHA_TANH, beta: float = BETA_TANH) -> np.ndarray:
    """The derivative by the net input; 1 for linear, softmax and multinomial, whose errors are taken before the activation."""
    if kind in ("sigmoid", "binary"):
        return act * (1.0 - act)
    if kind == "tanh":
        return beta * (alpha - act * act / alpha)
    if kind == "ReLU":
        return (net > 0).astype(float)
    return np.ones_like(act)
