"""Mean and deviation of a detector's scores from exact integer moments.

A group's score weighs a few whole numbers of the group. For lateral movement
two weights are divided by maxima over all groups, so a new maximum changes
every score. The sums of these numbers and of their products, and the maxima, don't depend
on them: they are gathered while the groups are written (``observe``), merge in
any order, and give mean and deviation under any maxima, without another pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

WHOLE = "decimal(19,0)"          # a long; sums of products fit 38 digits


@dataclass
class Weights:
    """The whole-number columns of a score and their weights; those of the first
    ``divided`` are divided by the column's maximum."""
    numbers: list
    weights: list
    divided: int = 0


def weights(pairs, units: dict | None = None, divided: int = 0) -> Weights:
    """From ``(column, weight)``; ``units`` names a column that is another one
    divided by a constant: ``{column: (whole column, constant)}``."""
    units = units or {}
    return Weights([units.get(c, (c, 1))[0] for c, _ in pairs],
                   [Fraction(w) / units.get(c, (c, 1))[1] for c, w in pairs], divided)


def merged(a: dict | None, b: dict) -> dict:
    """Moments of two disjoint sets of groups together."""
    if not a or not a["n"]:
        return b
    if not b["n"]:
        return a
    return {"n": a["n"] + b["n"], "sums": [x + y for x, y in zip(a["sums"], b["sums"])],
            "products": [[x + y for x, y in zip(p, q)] for p, q in zip(a["products"], b["products"])],
            "maxima": [max(x, y) for x, y in zip(a["maxima"], b["maxima"])]}


def mean_and_std(w: Weights, m: dict) -> tuple:
    """Mean and sample deviation of the scores under the maxima in ``m``; None as in SQL."""
    if not m["n"] or 0 in m["maxima"][:w.divided]:
        return None, None
    each = [Fraction(v) / m["maxima"][i] if i < w.divided else v for i, v in enumerate(w.weights)]
    total = sum(a * b for a, b in zip(each, m["sums"]))
    if m["n"] == 1:
        return float(total), None
    squares = sum(each[i] * each[j] * p for i, row in enumerate(m["products"]) for j, p in enumerate(row))
    return float(total / m["n"]), math.sqrt((squares - total * total / m["n"]) / (m["n"] - 1))


def observed(groups: DataFrame, w: Weights) -> tuple[DataFrame, Observation]:
    """``groups`` that gather the moments of ``w.numbers`` when they are written."""
    obs, k = Observation("flowlens-moments"), len(w.numbers)
    all_known = F.lit(True)
    for c in w.numbers:
        all_known = all_known & F.col(c).isNotNull()
    x = [F.when(all_known, F.col(c).cast(WHOLE)) for c in w.numbers]
    metrics = [F.count_if(all_known).alias("n")]
    metrics += [F.sum(v).alias(f"s{i}") for i, v in enumerate(x)]
    metrics += [F.max(v).alias(f"m{i}") for i, v in enumerate(x)]
    metrics += [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]
    return groups.observe(obs, *metrics), obs


def gathered(obs: Observation, w: Weights) -> dict:
    """The moments that a finished job observed."""
    got, k = obs.get, len(w.numbers)
    if not got.get("n"):
        return {"n": 0, "sums": [], "products": [], "maxima": []}
    return {"n": got["n"], "sums": [int(got[f"s{i}"]) for i in range(k)], "maxima": [int(got[f"m{i}"]) for i in range(k)],
            "products": [[int(got[f"p{min(i, j)}_{max(i, j)}"]) for j in range(k)] for i in range(k)]}


class Gathered:
    """Moments of groups that are written in parts."""

    def __init__(self, w: Weights):
        self.weights = w
        self.moments = {"n": 0, "sums": [], "products": [], "maxima": []}

    def watched(self, parts: Iterable[DataFrame]) -> Iterator[DataFrame]:
        """The parts, each of which is written before the next is asked for."""
        for part in parts:
            groups, obs = observed(part, self.weights)
            yield groups
            self.moments = merged(self.moments, gathered(obs, self.weights))
