"""Exact quantiles of whole tables without a task that holds all values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many values Spark's own exact percentile counts them in one task.
FEW = 1 << 20
#: How far beside a rank a sketch is asked, as a share of the values it has seen; a sketch of this size errs by about half of that.
MARGIN, SKETCH = 0.02, 400


def quantiles(rows: DataFrame, value: Column | str, shares: list[float], few: int = FEW) -> list[float | None]:
    """The values at these shares, interpolated as ``percentile`` does; nulls are left out, no values give nulls.

    Mergeable sketches bracket the ranks that are sought, a pass of counts
    tells on which side of each bracket a rank really is, and so on inside,
    until ``few`` values are left or all are equal. So an unlucky sketch costs
    a pass, and no pass gathers more than sketches and counts.
    """
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = rows.select(x.alias("x")).where("x is not null")
    n = rows.count()
    if not n:
        return [None] * len(shares)
    if n <= few:
        return list(rows.agg(F.percentile("x", F.array(*[F.lit(float(s)) for s in shares]))).first()[0])
    places = [s * (n - 1) for s in shares]
    found = at_ranks(rows, sorted({k for p in places for k in (math.floor(p), math.ceil(p))}), few)
    return [found[math.floor(p)] + (found[math.ceil(p)] - found[math.floor(p)]) * (p - math.floor(p)) for p in places]


def at_ranks(rows: DataFrame, ranks: list[int], few: int = FEW) -> dict[int, float]:
    """The values of column ``x`` at these ranks, from 0 on."""
    low, high, n = rows.agg(F.min("x"), F.max("x"), F.count("*")).first()
    held = {k: (low, high, 0, n) for k in ranks}  # rank -> least and greatest value, values below them, values between
    while True:
        spans = sorted({(a, b, before) for a, b, before, between in held.values() if a < b and between > few})
        if not spans:
            break
        inside = [F.col("x").between(a, b) for a, b, _ in spans]
        sketches = rows.agg(*[F.kll_sketch_agg_double(F.when(on, F.col("x")), F.lit(SKETCH)).alias(f"s{i}") for i, on in enumerate(inside)])
        asked = [(k, spans.index(h[:3])) for k, h in held.items() if h[:3] in spans]
        share = lambda k, m: min(1.0, max(0.0, (k - held[k][2]) / held[k][3] + m))
        marks = sketches.select(*[F.kll_sketch_get_quantile_double(f"s{i}", F.lit(share(k, m))).alias(f"m{k}_{j}") for k, i in asked for j, m in enumerate((-MARGIN, MARGIN))]).first()
        cuts = {k: (marks[f"m{k}_0"], marks[f"m{k}_1"]) for k, _ in asked}
        counts = rows.agg(*[F.count_if(c).alias(f"{name}{k}") for k, (a, b) in cuts.items() for name, c in (("below", F.col("x") < a), ("upto", F.col("x") <= b))],
                          *[e for k, (a, b) in cuts.items() for e in (F.max(F.when(F.col("x") < a, F.col("x"))).alias(f"last{k}"), F.min(F.when(F.col("x") > b, F.col("x"))).alias(f"next{k}"))]).first()
        for k, (a, b) in cuts.items():
            low, high, before, between = held[k]
            below, upto = counts[f"below{k}"], counts[f"upto{k}"]
            if k < below:
                held[k] = (low, counts[f"last{k}"], before, below - before)
            elif k < upto:
                held[k] = (a, b, below, upto - below)
            else:
                held[k] = (counts[f"next{k}"], high, upto, before + between - upto)
    out = {k: a for k, (a, b, _, _) in held.items() if a == b}
    for span in {h[:3] for k, h in held.items() if k not in out}:
        few_values = rows.where(F.col("x").between(span[0], span[1])).groupBy("x").count().orderBy("x").collect()  # ``few`` at most
        so_far, left = span[2], iter(few_values)
        for k in sorted(k for k, h in held.items() if h[:3] == span and k not in out):
            while so_far <= k:
                row = next(left)
                so_far += row["count"]
            out[k] = row["x"]
    return out
