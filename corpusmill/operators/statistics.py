"""Paired tests, drift and intervals: aggregates in Spark, closed-form tails on one row."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corpusmill.functions import tails
from corpusmill.functions.columns import rounded
from corpusmill.functions.lineage import behind, ranged
from corpusmill.functions.quantiles import quantiles


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def pairs(one: DataFrame, two: DataFrame, keys: list[str], metrics: list[str], order: str, others: list[str] = ()) -> DataFrame:
    """Rows of one with the last row of two of the same keys, null-safely: (keys, other columns of one, m_a, m_b)."""
    right = last_of(two, keys, order).select(*[F.col(k).alias(f"{k}_r") for k in keys], *[F.col(m).alias(f"{m}_b") for m in metrics])
    left = one.select(*keys, *others, *[F.col(m).alias(f"{m}_a") for m in metrics])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_r"))
    return left.join(right, same).drop(*[f"{k}_r" for k in keys])


def signed_ranks(diffs: DataFrame, value: str = "d") -> DataFrame:
    """One row: n non-zero differences, rank sums W+ and W-, tie term; equal sizes share a mean rank."""
    real = diffs.where(F.abs(value) > 1e-12).select(F.abs(value).alias("size"), (F.col(value) > 0).alias("up"))
    by = ranged(real.groupBy("size").agg(F.count("*").alias("t"), F.count_if("up").alias("u")), "size")
    base = behind(by.groupBy("cell").agg(F.sum("t").alias("base")), "base")
    inside = F.coalesce(F.sum("t").over(Window.partitionBy("cell").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = by.withColumn("inside", inside).join(F.broadcast(base), "cell").withColumn("rank", F.col("base") + F.col("inside") + (F.col("t") + 1) / 2.0)  # a row a cell
    return ranked.agg(
        F.coalesce(F.sum("t"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.col("rank") * F.col("u")), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum(F.col("rank") * (F.col("t") - F.col("u"))), F.lit(0.0)).alias("w_minus"),
        F.coalesce(F.sum(F.pow("t", F.lit(3)) - F.col("t")), F.lit(0.0)).alias("ties"),
    )


@F.pandas_udf(DoubleType())
def wilcoxon_p(n: pd.Series, w_plus: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([tails.wilcoxon_p(int(a), b, c) for a, b, c in zip(n, w_plus, ties, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def sign_p(wins: pd.Series, losses: pd.Series) -> pd.Series:
    return pd.Series([tails.sign_test(int(a), int(b)) for a, b in zip(wins, losses, strict=True)])


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return pd.Series([tails.normal_two_sided(x) if x == x else None for x in z], dtype="float64")


@F.pandas_udf(DoubleType())
def below(z: pd.Series) -> pd.Series:
    return pd.Series([tails.normal_below(x) if x == x else None for x in z], dtype="float64")


@F.pandas_udf(DoubleType())
def ks_p(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([tails.ks_p(x, int(a), int(b)) for x, a, b in zip(d, n, m, strict=True)])


def wilcoxon(diffs: DataFrame) -> DataFrame:
    return signed_ranks(diffs).withColumn("p", wilcoxon_p("n", "w_plus", "ties"))


def bayesian_ab(diffs: DataFrame, prior: float = 1e-3) -> DataFrame:
    """Posterior mean and sd of the mean difference (b - a) and the chance that b is better; nulls under two differences.

    Differences without any spread count as if they had a variance of 1e-12.
    """
    one = diffs.agg(F.count("d").alias("n"), F.avg("d").alias("m"), F.var_samp("d").alias("v"))
    data = F.when(F.col("n") > 1, F.col("n") / F.greatest(F.col("v"), F.lit(1e-12)))
    post = one.withColumn("mean", data * F.col("m") / (data + prior)).withColumn("sd", F.sqrt(1.0 / (data + prior)))
    chance = F.when(F.col("mean").isNotNull(), below(F.coalesce(F.col("mean") / F.col("sd"), F.lit(0.0))))
    return post.select("n", rounded("mean").alias("posterior_mean"), rounded("sd", 6).alias("posterior_sd"), rounded(chance).alias("p_better"))


def meta_analysis(studies: DataFrame, inverse_variance: bool = False) -> DataFrame:
    """Pooled delta of (delta, se) studies; weights are 1 / se, or 1 / se^2 if asked for."""
    w = 1.0 / (F.pow("se", F.lit(2)) if inverse_variance else F.col("se"))
    one = studies.where("se > 0").agg(F.count("*").alias("k"), (F.sum(F.col("delta") * w) / F.sum(w)).alias("d"), F.sqrt(1.0 / F.sum(w)).alias("se"))
    return one.select("k", rounded("d", 6).alias("pooled_delta"), rounded("se", 6).alias("pooled_se"), rounded(F.col("d") / F.col("se")).alias("z"))


def win_rate(both: DataFrame, a: str, b: str, higher: bool = True, tolerance: float = 1e-9) -> DataFrame:
    """Wins, ties and losses of b over a, its Wilson bound and sign test."""
    d = (F.col(b) - F.col(a)) * (1 if higher else -1)
    real = both.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return real.agg(F.count_if(d > tolerance).alias("wins"), F.count_if(F.abs(d) <= tolerance).alias("ties"), F.count_if(d < -tolerance).alias("losses")).withColumn(
        "win_rate", rounded(F.col("wins") / F.nullif(F.col("wins") + F.col("losses"), F.lit(0)))
    )


def multiple_comparison(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Bonferroni; the threshold of each rank; and the step-up rule that carries acceptance down."""
    m = F.count("*").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy("p", "name"))  # tests of a report: few
    ranked = tests.withColumn("m", m).withColumn("rank", rank).withColumn("per_rank", F.col("p") <= F.col("rank") / F.col("m") * alpha)
    last = F.max(F.when(F.col("per_rank"), F.col("rank"))).over(Window.partitionBy())
    return ranked.select("name", "p", "rank", (F.col("p") <= alpha / F.col("m")).alias("bonferroni"), "per_rank", (F.col("rank") <= F.coalesce(last, F.lit(0))).alias("step_up"))


def psi(rows: DataFrame, value: str, current: Column, bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """Population stability of current rows against the others, by the others' quantile bins."""
    real = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), current.alias("cur"))
    edges = F.array(*[F.lit(e).cast("double") for e in quantiles(real.where(~F.col("cur")), "v", [i / bins for i in range(1, bins)])])
    at = F.size(F.filter(edges, lambda e: e <= F.col("v")))
    by = real.groupBy(at.alias("bin")).agg(F.count_if("cur").alias("c"), F.count_if(~F.col("cur")).alias("r"))
    return _stability(by, bins, floor)


def category_psi(rows: DataFrame, value: str, current: Column, floor: float = 1e-6) -> DataFrame:
    by = rows.select(F.col(value).alias("v"), current.alias("cur")).groupBy("v").agg(F.count_if("cur").alias("c"), F.count_if(~F.col("cur")).alias("r"))
    return _stability(by, None, floor)


def _stability(by: DataFrame, bins: int | None, floor: float) -> DataFrame:
    total = by.agg(F.sum("c").alias("tc"), F.sum("r").alias("tr"), F.count("*").alias("used"))
    c = F.greatest(F.col("c") / F.col("tc"), F.lit(floor))
    q = F.greatest(F.col("r") / F.col("tr"), F.lit(floor))
    return by.join(F.broadcast(total)).agg(F.first("tr").alias("n_reference"), F.first("tc").alias("n_current"), rounded(F.sum((c - q) * F.log(c / q)), 6).alias("psi"))  # one row


def ks(rows: DataFrame, value: str, current: Column) -> DataFrame:
    """Kolmogorov-Smirnov distance of current rows and the others; values are counted before they are ordered."""
    by = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count_if(current).alias("c"), F.count_if(~current).alias("r"))
    by = ranged(by, "v")
    base = behind(by.groupBy("cell").agg(F.sum("c").alias("bc"), F.sum("r").alias("br")), "bc", "br")
    inside = Window.partitionBy("cell").orderBy("v")
    total = by.agg(F.sum("c").alias("n"), F.sum("r").alias("m"))
    run = by.withColumn("ic", F.sum("c").over(inside)).withColumn("ir", F.sum("r").over(inside)).join(F.broadcast(base), "cell")
    gap = F.max(F.abs((F.col("bc") + F.col("ic")) / F.col("n") - (F.col("br") + F.col("ir")) / F.col("m")))
    return run.join(F.broadcast(total)).groupBy("n", "m").agg(rounded(gap, 6).alias("distance"))  # one row


#: Poisson(1) by inversion: a draw takes a row k times if its uniform number is below the k-th mark.
_MARKS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


def _weights(keys: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """How often each draw takes each row: Poisson(1) numbers that only depend on row, draw and seed."""
    with np.errstate(over="ignore"):
        x = keys.view(np.uint64)[:, None] + (np.arange(draws, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 20) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return np.searchsorted(_MARKS, (x >> np.uint64(11)).astype(np.float64) * 2.0**-53, side="right").astype(np.float64)


def resampled(rows: DataFrame, by: str, key: str, values: list[str], draws: int = 2000, seed: int = 0) -> DataFrame:
    """(by, draw, w_<value>, s_<value>): in each bootstrap draw, how many non-null values a group has, and their sum.

    A draw takes each row a Poisson(1) number of times, by a hash of its
    ``key``, which is how a multinomial draw behaves for all but the smallest
    groups. So every task draws for its own rows at any size of a group, and
    only sums, ``draws`` rows a group and task, are shuffled.
    """
    kind = dict(rows.dtypes)[by]
    read = rows.select(F.col(by).alias("_by"), F.xxhash64(key).alias("_key"), *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)])
    names = [f"{x}{i}" for i in range(len(values)) for x in "ws"]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for k, own in pdf.groupby("_by", dropna=False):
                k = None if pd.isna(k) else k
                total = held.setdefault(k, np.zeros((draws, len(names))))
                for at in range(0, len(own), 500):
                    part = own.iloc[at : at + 500]
                    v = part[[f"v{i}" for i in range(len(values))]].to_numpy(dtype=float)
                    real = ~np.isnan(v)
                    w = _weights(part["_key"].to_numpy(), draws, seed).T
                    total[:, 0::2] += w @ real
                    total[:, 1::2] += w @ np.where(real, v, 0.0)
        for k, total in held.items():
            yield pd.DataFrame({"_by": [k] * draws, "draw": np.arange(draws), **{n: total[:, i] for i, n in enumerate(names)}})

    drawn = read.mapInPandas(draw, f"_by {kind}, draw int, " + ", ".join(f"{n} double" for n in names))
    summed = drawn.groupBy("_by", "draw").agg(*[F.sum(n).alias(n) for n in names])
    return summed.select(F.col("_by").alias(by), "draw", *[F.col(f"{x}{i}").alias(f"{x}_{v}") for i, v in enumerate(values) for x in "ws"])


def _interval(value: Column) -> list[Column]:
    return [rounded(F.percentile(value, p)).alias(n) for n, p in (("low", 0.025), ("high", 0.975))]


def bootstrap(rows: DataFrame, by: str, key: str, value: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """n, mean and the percentile interval of each group's mean; under 3 values none."""
    real = rows.where(F.col(value).isNotNull())
    stats = real.groupBy(by).agg(F.count("*").alias("n"), rounded(F.avg(F.col(value).cast("double"))).alias("mean"))
    drawn = resampled(real, by, key, [value], draws, seed).groupBy(by).agg(*_interval(F.col(f"s_{value}") / F.nullif(f"w_{value}", F.lit(0.0))))
    few = F.col("n") < 3
    out = stats.withColumnRenamed(by, "_of").join(drawn, F.col("_of").eqNullSafe(F.col(by)))
    return out.select(by, "n", "mean", *[F.when(~few, F.col(c)).alias(c) for c in ("low", "high")])


def difference_interval(rows: DataFrame, key: str, a: str, b: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """One row: interval and mean of mean(b) - mean(a), each column resampled by itself; nulls under 3 values in either."""
    every = rows.withColumn("_all", F.lit(1))
    one, two = (resampled(every, "_all", key, [c], draws, 2 * seed + i).withColumnRenamed("draw", f"_{i}") for i, c in enumerate((a, b)))
    gap = F.col(f"s_{b}") / F.nullif(f"w_{b}", F.lit(0.0)) - F.col(f"s_{a}") / F.nullif(f"w_{a}", F.lit(0.0))
    drawn = one.join(two, F.col("_0") == F.col("_1")).agg(*_interval(gap), rounded(F.avg(gap)).alias("middle"))
    enough = (F.col("na") > 2) & (F.col("nb") > 2)
    return rows.agg(F.count(a).alias("na"), F.count(b).alias("nb")).join(drawn).select(*[F.when(enough, F.col(c)).alias(c) for c in ("low", "high", "middle")])  # one row each


def score_interval(rows: DataFrame, by: str, key: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """Each group's score (0.4 ok share, 0.3 mean clap, 0.3 fidelity) with the interval of the score of resampled rows."""
    ready = rows.withColumn("_ok", (F.col("status") == "ok").cast("double")).withColumn("_ok", F.coalesce("_ok", F.lit(0.0))).withColumn("_dev", F.abs("deviation"))

    def score(ok: Column, clap: Column, dev: Column) -> Column:
        return 0.4 * ok + 0.3 * F.coalesce(clap, F.lit(0.0)) + 0.3 * F.greatest(F.lit(0.0), 1.0 - F.coalesce(dev, F.lit(0.0)) / 0.2)

    stats = ready.groupBy(by).agg(F.count("*").alias("n"), rounded(score(F.avg("_ok"), F.avg("clap_score"), F.avg("_dev"))).alias("score"))
    means = [F.col(f"s_{c}") / F.nullif(f"w_{c}", F.lit(0.0)) for c in ("_ok", "clap_score", "_dev")]
    drawn = resampled(ready, by, key, ["_ok", "clap_score", "_dev"], draws, seed).groupBy(by).agg(*_interval(score(*means)))
    return stats.withColumnRenamed(by, "_of").join(drawn, F.col("_of").eqNullSafe(F.col(by))).select(by, "n", "score", "low", "high")


def comparison(both: DataFrame, key: str, metrics: dict[str, bool], alpha: float = 0.05, draws: int = 2000) -> DataFrame:
    """One row a metric of paired results: means, mean change with its interval, signed-rank p, posterior, verdict.

    ``metrics``: name -> whether higher is better; columns are name_a, name_b,
    and ``key`` names a row. Lower-is-better metrics compare absolute values.
    """
    out = None
    for name, higher in metrics.items():
        a, b = (F.col(f"{name}_{x}") if higher else F.abs(f"{name}_{x}") for x in "ab")
        d = both.select(F.col(key).alias("k"), a.alias("a"), b.alias("b"), (b - a).alias("d")).where("d is not null")
        test, bayes = wilcoxon(d).select("n", "p"), bayesian_ab(d).select("posterior_mean", "posterior_sd", "p_better")
        mean = d.agg(F.count("*").alias("n_paired"), rounded(F.avg("a")).alias("mean_a"), rounded(F.avg("b")).alias("mean_b"), rounded(F.avg("d")).alias("delta"))
        better = F.col("p_better") if higher else 1.0 - F.col("p_better")
        good = (F.col("delta") > 0) if higher else (F.col("delta") < 0)
        verdict = F.when(F.col("p").isNull() | (F.col("p") >= alpha), "no significant difference").when(good, "improved").otherwise("worse")
        row = test.join(bayes).join(mean).join(difference_interval(d, "k", "a", "b", draws))  # one row each
        row = row.select(
            F.lit(name).alias("metric"), "n_paired", "mean_a", "mean_b", "delta", "low", "high", "n", rounded("p", 6).alias("p"), "posterior_mean", "posterior_sd", rounded(better).alias("p_better"), verdict.alias("verdict")
        )
        out = row if out is None else out.unionByName(row)
    return out
