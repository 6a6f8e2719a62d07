"""Outcome description shared by every operator.

An outcome is a categorical column with an ordered list of levels (lowest
first).  Each level has an output name (used for count columns) and a risk
weight; ``risk = sum(weight_i * count_i) / total``.  With the default weights
``(0, 1, 3)`` on three levels this is ``(mid + 3 * high) / total``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_when(cond: Column) -> Column:
    """Rows where ``cond`` is true, as ``count(CASE WHEN cond THEN 1 END)``.

    Written without ``count_if`` so identical aggregates in two branches of a
    plan canonicalise the same and their shuffle is reused.
    """
    return F.count(F.when(cond, F.lit(1)))


@dataclass(frozen=True)
class OutcomeSpec:
    column: str
    levels: tuple[str, ...]
    names: tuple[str, ...] = ()
    weights: tuple[float, ...] = ()

    def __post_init__(self):
        if len(self.levels) < 2:
            raise ValueError("an outcome needs at least two levels")
        if len(set(self.levels)) != len(self.levels):
            raise ValueError("outcome levels must be distinct")
        if not self.names:
            object.__setattr__(self, "names", tuple(f"level_{i}" for i in range(len(self.levels))))
        if not self.weights:
            default = (0, 1, 3) if len(self.levels) == 3 else tuple(range(len(self.levels)))
            object.__setattr__(self, "weights", default)
        if len(self.names) != len(self.levels) or len(self.weights) != len(self.levels):
            raise ValueError("names and weights must have one entry per level")

    # -- expressions -------------------------------------------------------
    @property
    def col(self) -> Column:
        return F.col(self.column)

    def is_level(self, i: int) -> Column:
        return self.col == F.lit(self.levels[i])

    def level_counts(self) -> list[Column]:
        """``count_if(outcome = level_i)`` for every level, aliased by name."""
        return [count_when(self.is_level(i)).alias(n) for i, n in enumerate(self.names)]

    def not_base(self) -> Column:
        """``outcome != base`` with SQL NULL semantics (NULL outcome is not counted)."""
        return self.col != F.lit(self.levels[0])

    def rank(self) -> Column:
        """Ordinal position of the outcome (P22); NULL outside the level list."""
        expr = F.lit(None).cast("short")
        for i in reversed(range(len(self.levels))):
            expr = F.when(self.is_level(i), F.lit(i).cast("short")).otherwise(expr)
        return expr

    @property
    def top(self) -> str:
        return self.names[-1]

    @property
    def second(self) -> str:
        return self.names[-2]

    def risk_numerator(self) -> Column:
        expr = None
        for name, w in zip(self.names, self.weights):
            if w == 0:
                continue
            term = F.col(name) if w == 1 else F.col(name) * F.lit(w)
            expr = term if expr is None else expr + term
        return expr if expr is not None else F.lit(0)
