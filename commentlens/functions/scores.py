"""Class-score arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from commentlens.schema import LABELS

MIN_PROBABILITY = 0.9


def softmax(scores: Column) -> Column:
    """Probabilities, shifted by the maximum so that large scores stay finite."""
    top = F.array_max(scores)
    powers = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(powers, lambda x: x / total)


def argmax(scores: Column) -> Column:
    """0-based index of the first maximum; -1 for an empty array."""
    position = F.array_position(scores, F.array_max(scores)) - 1
    return F.when(F.size(scores) == 0, F.lit(-1).cast("bigint")).otherwise(position)


def label_of(model_id: Column) -> Column:
    """Label name of a 0-based class id."""
    return F.element_at(F.array(*map(F.lit, LABELS)), (model_id + 1).cast("int"))


def model_id_of(label: Column) -> Column:
    """0-based class id of a label name; NULL for unknown names."""
    position = F.array_position(F.array(*map(F.lit, LABELS)), label) - 1
    return F.when(position >= 0, position)


def is_confident(label: Column, probability: Column, minimum: float = MIN_PROBABILITY) -> Column:
    """Worth asking a person about: not VALID and at least ``minimum``."""
    return (label != "VALID") & (probability >= minimum)
