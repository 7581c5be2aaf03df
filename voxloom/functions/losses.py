"""Losses as column expressions: sums over a patch, to be added up over a batch and divided there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxloom.functions.arrays import sigmoid, total_of, total_pair


def l1_sum(pred: Column, target: Column) -> Column:
    return total_pair(pred, target, lambda p, t: F.abs(p - t))


def mse_sum(pred: Column, target: Column) -> Column:
    return total_pair(pred, target, lambda p, t: (p - t) * (p - t))


def charbonnier_sum(pred: Column, target: Column, eps: float = 1e-6) -> Column:
    return total_pair(pred, target, lambda p, t: F.sqrt((p - t) * (p - t) + eps * eps))


#: Reconstruction losses by name; an unknown name is a KeyError.
RECONSTRUCTION = {"l1": l1_sum, "mse": mse_sum, "charbonnier": charbonnier_sum}


def bce_sum(logits: Column, target: Column, pos_weight: float = 1.0) -> Column:
    """Binary cross-entropy of logits, in the form that doesn't overflow; targets of 1 weigh ``pos_weight``."""
    return total_pair(logits, target, lambda x, y: (1 - y) * x + (1 + (pos_weight - 1) * y) * (F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0))))


def dice(logits: Column, target: Column, smooth: float = 1.0) -> Column:
    """The soft Dice coefficient of one patch; the loss is one minus the batch's mean."""
    both = total_pair(logits, target, lambda x, y: sigmoid(x) * y)
    return (2 * both + smooth) / (total_of(logits, sigmoid) + total_of(target, lambda y: y) + smooth)


def tversky(logits: Column, target: Column, alpha: float = 0.3, beta: float = 0.7, smooth: float = 1.0) -> Column:
    """The soft Tversky index of one patch: alpha weighs false positives, beta false negatives."""
    tp = total_pair(logits, target, lambda x, y: sigmoid(x) * y)
    fp = total_pair(logits, target, lambda x, y: sigmoid(x) * (1 - y))
    fn = total_pair(logits, target, lambda x, y: (1 - sigmoid(x)) * y)
    return (tp + smooth) / (tp + alpha * fp + beta * fn + smooth)


def kl(mu: Column, logvar: Column) -> Column:
    """The Kullback-Leibler divergence from the unit normal of one latent value."""
    return 0.5 * (mu * mu + F.exp(logvar) - logvar - 1)


def beta(step: Column, warmup: int = 5000, most: float = 1.0) -> Column:
    """A linear warm-up to ``most``; without a warm-up it is ``most`` at once."""
    return F.lit(float(most)) if warmup <= 0 else F.least(F.lit(float(most)), most * step / warmup)
