"""Numbers: clamps, logits, proper scores, hashes, blends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6


def clamp(c: Column, least: float, most: float) -> Column:
    """Within bounds; null stays null, which greatest and least would skip."""
    return F.when(c.isNotNull(), F.greatest(F.lit(least), F.least(F.lit(most), c)))


def probability(c: Column, epsilon: float = EPSILON) -> Column:
    return clamp(c, epsilon, 1 - epsilon)


def sigmoid(c: Column, bound: float = 30.0) -> Column:
    return 1.0 / (1.0 + F.exp(-clamp(c, -bound, bound)))


def logit(c: Column) -> Column:
    p = probability(c)
    return F.ln(p / (1.0 - p))


def exp_logprob(c: Column) -> Column:
    return F.exp(clamp(c, -30.0, 0.0))


def log_share(value: Column, total: Column) -> Column:
    """Log of a verbal score's share; a negative score counts as zero."""
    return F.ln(F.greatest(value, F.lit(0.0)) / total + 1e-12)


def brier(confidence: Column, target: Column) -> Column:
    return F.pow(confidence - target, F.lit(2.0))


def log_loss(confidence: Column, target: Column) -> Column:
    p = probability(confidence)
    return -F.when(target == 1, F.ln(p)).otherwise(F.ln(1.0 - p))


def brier_reward(confidence: Column, target: Column) -> Column:
    """Negative squared error; -1 for a reply without a confidence."""
    return F.coalesce(-brier(confidence, target), F.lit(-1.0))


def log_reward(confidence: Column, target: Column, epsilon: float = 0.01) -> Column:
    """Log score with a floor; the floor's log for a reply without a confidence."""
    c = clamp(confidence, epsilon, 1 - epsilon)
    return F.when(c.isNull(), F.ln(F.lit(epsilon))).when(target == 1, F.ln(c)).otherwise(F.ln(1.0 - c))


def blend(**weights_and_columns: tuple[float, Column]) -> Column:
    """Weighted sum of named parts."""
    out = F.lit(0.0)
    for weight, column in weights_and_columns.values():
        out = out + F.lit(float(weight)) * column
    return out


def reward_sum(parts: dict[str, tuple[float, Column]], masked: str = "null") -> Column:
    """Weighted sum of rewards.  A masked (null) part makes the sum null, or counts as 0 with ``masked='zero'``."""
    out = F.lit(0.0)
    for weight, column in parts.values():
        out = out + F.lit(float(weight)) * (F.coalesce(column, F.lit(0.0)) if masked == "zero" else column)
    return out


def hash_int(key: Column, modulus: int) -> Column:
    """First 32 bits of SHA-256 of a string, modulo ``modulus``."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long") % modulus


def hash_unit(key: Column, steps: int = 1000) -> Column:
    """A hash-derived number in [0, 1)."""
    return hash_int(key, steps) / F.lit(float(steps))


def stable_order(seed: int | str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def other_label(labels: list[str], label: Column, key: Column) -> Column:
    """A wrong label, chosen by the key's hash."""
    names = F.array(*(F.lit(x) for x in labels))
    at = F.array_position(names, label).cast("int") - 1
    return F.get(names, ((at + hash_int(key, len(labels) - 1) + 1) % len(labels)).cast("int"))


def rounded_score(c: Column, least: int = 1, most: int = 5) -> Column:
    """Half to even, within bounds."""
    return clamp(F.bround(c, 0).cast("int"), least, most)
