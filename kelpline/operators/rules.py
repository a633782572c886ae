"""Rules as tables: first match, sums of weights, caps, reductions of evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(rules: Sequence[tuple[Column, object]], default: object) -> Column:
    """The value of the first rule whose condition holds; null conditions do not hold."""
    out = F.lit(default)
    for condition, value in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(False)), value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def score(weights: Sequence[tuple[Column, int]], low: int = 0, high: int = 100, caps: Sequence[tuple[Column, int]] = ()) -> Column:
    """Sum of the weights that hold, clamped, then cut to the least cap that holds."""
    total = F.lit(0)
    for condition, weight in weights:
        total = total + F.when(F.coalesce(condition, F.lit(False)), weight).otherwise(0)
    out = F.greatest(F.lit(low), F.least(F.lit(high), total))
    for condition, cap in caps:
        out = F.least(out, F.when(F.coalesce(condition, F.lit(False)), cap).otherwise(high))
    return out


def reasons(rules: Sequence[tuple[str, Column]]) -> Column:
    """Names of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]))


def lattice(checks: Sequence[tuple[Column, Column]]) -> Column:
    """Over (fails, unknown) pairs: fail if one fails, else check if one is unknown, else pass."""
    fails, unknown = F.lit(False), F.lit(False)
    for bad, open_ in checks:
        fails, unknown = fails | F.coalesce(bad, F.lit(False)), unknown | F.coalesce(open_, F.lit(False))
    return F.when(fails, "fail").when(unknown, "check").otherwise("pass")


def exactly_one(conditions: Sequence[tuple[str, Column]]) -> Column:
    """The name of the only condition that holds; "mixed" if several do, null if none does."""
    n = sum((F.coalesce(c, F.lit(False)).cast("int") for _, c in conditions), F.lit(0))
    return F.when(n > 1, F.lit("mixed")).when(n == 1, F.element_at(reasons(conditions), 1))


def strongest(states: Column, order: Sequence[str], default: str) -> Column:
    """Of an array of states the first in the order that occurs."""
    out = F.lit(default)
    for s in reversed(order):
        out = F.when(F.array_contains(states, s), s).otherwise(out)
    return out
