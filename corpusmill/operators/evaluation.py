"""Reports, ranks and gates over evaluation results.

Rows have checkpoint, prompt, section, genre, bpm_target, clap_score,
deviation and status; each mean skips its own nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.columns import adherence_score, clamp, or_else, reasons, rounded, share
from corpusmill.functions.lineage import few, first_of, ranged
from corpusmill.functions.quantiles import FEW, quantiles



def _ok() -> Column:
    return F.col("status") == "ok"


def _off() -> Column:
    return F.abs("deviation")


def leaderboard(rows: DataFrame, ratings: DataFrame) -> DataFrame:
    """Checkpoints by score: ok share, mean clap, mean deviation, listeners' mean."""
    by = (
        rows.withColumn("checkpoint", or_else("checkpoint", "(unknown)"))
        .groupBy("checkpoint")
        .agg(F.count("*").alias("runs"), rounded(share(_ok())).alias("ok_pct"), rounded(F.avg("clap_score")).alias("mean_clap"), rounded(F.avg(_off())).alias("mean_abs_deviation"))
    )
    # a prompt's ratings count once for each of its rows: sums by prompt are joined, not ratings
    prompt = ratings.groupBy("prompt").agg(F.sum("rating").alias("s"), F.count("rating").alias("n"))
    heard = (
        rows.groupBy(or_else("checkpoint", "(unknown)").alias("checkpoint"), "prompt")
        .agg(F.count("*").alias("k"))
        .join(prompt, "prompt")
        .groupBy("checkpoint")
        .agg(rounded(F.sum(F.col("s") * F.col("k")) / F.sum(F.col("n") * F.col("k"))).alias("mean_human_rating"))
    )
    scored = by.join(heard, "checkpoint", "left").withColumn(
        "score", rounded(adherence_score(F.col("ok_pct"), F.col("mean_clap"), F.col("mean_abs_deviation")))
    )
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "checkpoint")))


def seed_aggregate(rows: DataFrame, min_clap: float = 0.0, max_deviation: float = 0.0) -> DataFrame:
    """One row a (checkpoint, prompt): medians and means over seeds, majority verdict, reject reasons."""
    first = F.min_by("section", "seed_no")
    by = rows.groupBy("checkpoint", "prompt").agg(
        F.count("*").alias("n_seeds"),
        F.count_if(_ok()).alias("ok_seeds"),
        first.alias("section"),
        rounded(F.median("deviation")).alias("deviation"),
        rounded(F.avg("clap_score")).alias("clap_score"),
    )
    why = reasons(
        (F.lit(min_clap > 0) & (F.col("clap_score") < min_clap), "clap"),
        (F.lit(max_deviation > 0) & (F.abs("deviation") > max_deviation), "deviation"),
    )
    verdict = F.when((F.col("ok_seeds") >= F.expr("(n_seeds + 1) div 2")) & (F.size(why) == 0), "ok").otherwise("rejected")
    return by.withColumn("status", verdict).withColumn("notes", F.array_join(why, "; "))


def means(rows: DataFrame, by: str = "checkpoint", none_clap: float | None = None, none_deviation: float | None = None) -> DataFrame:
    """n, mean clap, mean deviation and ok share; what a mean of nothing gives is a parameter."""
    clap, off = F.avg("clap_score"), F.avg(_off())
    if none_clap is not None:
        clap = F.coalesce(clap, F.lit(none_clap))
    if none_deviation is not None:
        off = F.coalesce(off, F.lit(none_deviation))
    return rows.groupBy(by).agg(
        F.count("*").alias("n"), rounded(clap).alias("mean_clap"), rounded(off).alias("mean_abs_deviation"), rounded(share(_ok())).alias("ok_pct")
    )


def registry_summary(rows: DataFrame) -> DataFrame:
    """The leaderboard's score from means that are not rounded first."""
    by = rows.groupBy("checkpoint").agg(share(_ok()).alias("ok"), F.avg("clap_score").alias("clap"), F.avg(_off()).alias("off"))
    return by.select("checkpoint", rounded(adherence_score(F.col("ok"), F.col("clap"), F.col("off"))).alias("score"))


def section_interaction(rows: DataFrame) -> DataFrame:
    """By section: ok share, means, and the correlation of tempo and deviation from 4 varied pairs on."""
    both = (F.col("bpm_target") != 0) & F.col("deviation").isNotNull()
    bpm, off = F.when(both, F.col("bpm_target")), F.when(both, _off())
    varied = (F.count(bpm) >= 4) & (F.stddev_pop(bpm) > 0) & (F.stddev_pop(off) > 0)
    return rows.groupBy(or_else("section", "?").alias("section")).agg(
        F.count("*").alias("n"),
        rounded(share(_ok())).alias("ok_rate"),
        rounded(F.avg(_off())).alias("mean_abs_dev"),
        rounded(F.avg("clap_score")).alias("mean_clap"),
        rounded(F.when(varied, F.covar_pop(bpm, off) / F.nullif(F.stddev_pop(bpm) * F.stddev_pop(off), F.lit(0.0)))).alias("bpm_dev_corr"),
    )


def genre_gate(rows: DataFrame, gates: dict[str, tuple[float, float]]) -> DataFrame:
    """By genre: means against the genre's (least clap, most deviation), else the default's."""
    known = rows.sparkSession.createDataFrame([(g, *v) for g, v in gates.items() if g != "default"], "genre string, own_clap double, own_dev double")
    low, high = gates.get("default", (0.0, 0.2))
    by = rows.groupBy(F.trim(or_else("genre", "default")).alias("genre")).agg(
        F.count("*").alias("n"),
        rounded(F.coalesce(F.avg("clap_score"), F.lit(0.0))).alias("mean_clap"),
        rounded(F.coalesce(F.avg(_off()), F.lit(float("inf")))).alias("mean_abs_deviation"),
    )
    limits = by.join(known, "genre", "left")
    limits = limits.withColumn("min_clap", F.coalesce("own_clap", F.lit(low))).withColumn("max_dev", F.coalesce("own_dev", F.lit(high)))
    passed = (F.col("mean_clap") >= F.col("min_clap")) & (F.col("mean_abs_deviation") <= F.col("max_dev"))
    return limits.drop("own_clap", "own_dev").withColumn("passed", passed)


def alert_violations(rows: DataFrame, min_clap: float, max_deviation: float, min_ok: float) -> DataFrame:
    """(checkpoint, metric, value, limit) of each metric beyond its limit; missing ones never are."""
    by = means(rows.withColumn("checkpoint", or_else("checkpoint", "?")))
    long = by.selectExpr(
        "checkpoint",
        f"stack(3, 'clap', mean_clap, {min_clap}D, 'deviation', mean_abs_deviation, {max_deviation}D, 'ok', ok_pct, {min_ok}D) as (metric, value, limit)",
    )
    beyond = F.when(F.col("metric") == "deviation", F.col("value") > F.col("limit")).otherwise(F.col("value") < F.col("limit"))
    return long.where(beyond)


def regression_gate(rows: DataFrame, baseline: str, candidate: str, max_drop: float = 0.02, max_rise: float = 0.05) -> DataFrame:
    """Two checks of a candidate against a baseline: clap drop, deviation rise."""

    def of(name: str) -> DataFrame:
        return rows.where(F.trim("checkpoint") == name).agg(F.coalesce(F.avg("clap_score"), F.lit(0.0)).alias("c"), F.coalesce(F.avg(_off()), F.lit(float("inf"))).alias("d"))

    one, two = of(baseline).toDF("bc", "bd"), of(candidate).toDF("cc", "cd")
    both = one.join(two)  # one row each
    long = both.selectExpr(
        f"stack(2, 'clap', bc, cc, cc - bc, {max_drop}D, 'deviation', bd, cd, cd - bd, {max_rise}D) as (metric, baseline, candidate, delta, limit)"
    )
    worse = F.when(F.col("metric") == "clap", -F.col("delta")).otherwise(F.col("delta"))
    return long.select(
        F.col("metric").alias("check"), rounded("baseline").alias("baseline"), rounded("candidate").alias("candidate"), rounded("delta").alias("delta"), "limit", (worse > F.col("limit")).alias("blocking")
    )


def paraphrase_robustness(rows: DataFrame) -> DataFrame:
    """By intent: spread of the clap over its paraphrases, from two on."""
    by = rows.where(F.col("clap_score").isNotNull()).groupBy("intent").agg(
        F.count("*").alias("n"),
        rounded(F.avg("clap_score")).alias("mean_clap"),
        rounded(F.stddev_samp("clap_score")).alias("std_clap"),
        rounded(F.max("clap_score") - F.min("clap_score")).alias("spread"),
    )
    return by.where(F.col("n") >= 2)


def seed_diversity(rows: DataFrame, least: float = 0.02) -> DataFrame:
    """By prompt: how much the clap varies over seeds."""
    by = rows.groupBy("prompt").agg(F.count("clap_score").alias("n"), F.avg("clap_score").alias("m"), F.stddev_pop("clap_score").alias("s"), F.min("clap_score").alias("lo"), F.max("clap_score").alias("hi"))
    cv = F.when(F.col("m") != 0, F.col("s") / F.col("m")).otherwise(0.0)
    return by.where(F.col("n") > 0).select(
        "prompt", "n", rounded("m").alias("mean_clap"), rounded("s").alias("std_clap"), rounded(cv).alias("cv"), rounded("lo").alias("min_clap"), rounded("hi").alias("max_clap"), (F.col("s") < least).alias("collapsed")
    )


def counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def busiest(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The key of most rows; of equals, the one seen first."""
    by = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(position).alias("p"))
    return by.orderBy(F.desc("n"), "p").limit(1).select(key, "n")


def verdicts(rows: DataFrame) -> DataFrame:
    by = rows.groupBy(or_else("section", "?").alias("section")).agg(F.count_if(_ok()).alias("ok"), F.count("*").alias("total"))
    return by.withColumn("label", F.concat_ws("/", "ok", "total"))


def section_tempo_heatmap(rows: DataFrame, low: float = 60, high: float = 180, bins: int = 12) -> DataFrame:
    width = (high - low) / bins
    bin_ = F.floor((F.col("bpm_target") - low) / width).cast("int")
    return rows.where(F.col("bpm_target").between(low, high)).groupBy(or_else("section", "?").alias("section"), F.least(bin_, F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))


def melt(rows: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Long form of the metrics that are not null."""
    return rows.unpivot([key], metrics, "metric", "value").where(F.col("value").isNotNull()).withColumn("value", rounded("value"))


def metrics_lab(rows: DataFrame) -> DataFrame:
    near = F.when(F.col("deviation").isNotNull(), 1.0 - F.least(F.lit(1.0), 5.0 * _off()))
    return rows.agg(rounded(F.avg("clap_score")).alias("mean_clap"), rounded(F.avg(near)).alias("bpm_adherence"), rounded(share(_ok())).alias("ok_rate"), F.count("*").alias("n"))


def z_scores(rows: DataFrame) -> DataFrame:
    """Each clap's z-score in its section; null where it has none. Sections are aggregated, not gathered."""
    kept = rows.withColumn("section", or_else("section", "?"))
    stats = kept.groupBy("section").agg(F.avg("clap_score").alias("m"), F.nullif(F.stddev_pop("clap_score"), F.lit(0.0)).alias("s"))
    z = kept.join(stats, "section").withColumn("z", (F.col("clap_score") - F.col("m")) / F.col("s"))
    return z.select("event_id", "prompt", "section", "clap_score", rounded("z").alias("clap_z"), (F.col("z") > 0).alias("above_mean"))


def global_z(rows: DataFrame, value: str) -> DataFrame:
    """z-scores over all rows from one pass of sums; zeros if nothing varies."""
    total = rows.agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    z = F.when(F.col("s") < 1e-12, 0.0).otherwise((F.col(value) - F.col("m")) / F.col("s"))
    return rows.join(F.broadcast(total)).withColumn("z", rounded(z)).drop("m", "s")  # one row


def running_best(rows: DataFrame, by: str, order: str, value: str, patience: int = 3) -> DataFrame:
    """Best value so far, steps since it was set, and whether to stop.

    Ranges of the order go each by itself, behind what the ranges before them
    come to: how many steps, the best, and the step that set it.
    """
    if few(rows):  # one range: nothing is before it
        w = Window.partitionBy(by).orderBy(order)
        seen = rows.select(by, order, value, F.row_number().over(w).alias("step"), F.max(value).over(w).alias("best"))
        raised = F.col(value) > F.coalesce(F.lag("best").over(w), F.lit(float("-inf")))
        at = seen.withColumn("best_step", F.max(F.when(raised, F.col("step"))).over(w))
        return _stopping(at, by, value, patience)
    cells, inside = ranged(rows, order), Window.partitionBy(by, "cell").orderBy(order)
    earlier = Window.partitionBy(by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    none = F.lit(float("-inf"))
    sums = cells.groupBy(by, "cell").agg(F.count("*").alias("n"), F.max(value).alias("top"))
    sums = sums.select(by, "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("steps"), F.max("top").over(earlier).alias("was"))
    seen = cells.join(sums, [by, "cell"]).withColumn("step", F.col("steps") + F.row_number().over(inside))
    seen = seen.withColumn("best", F.greatest("was", F.max(value).over(inside)))
    raised = F.col(value) > F.coalesce(F.lag("best").over(inside), F.col("was"), none)
    seen = seen.withColumn("set", F.when(raised, F.col("step")))
    carried = seen.groupBy(by, "cell").agg(F.max("set").alias("last")).select(by, "cell", F.max("last").over(earlier).alias("held"))
    at = seen.join(carried, [by, "cell"]).withColumn("best_step", F.coalesce(F.max("set").over(inside), F.col("held")))
    return _stopping(at, by, value, patience)


def _stopping(at: DataFrame, by: str, value: str, patience: int) -> DataFrame:
    since = (F.col("step") - F.col("best_step")).cast("int")
    return at.select(by, F.col("step").cast("int").alias("step"), rounded(value).alias(value), rounded("best").alias("best"), since.alias("since_best"), (since >= patience).alias("stop"))


def difficulty(rows: DataFrame) -> DataFrame:
    """0.45 (1 - clap) + 0.35 min(deviation / 0.5, 1) + 0.2 rejected; a missing term is 1."""
    score = 0.45 * F.coalesce(1.0 - F.col("clap_score"), F.lit(1.0)) + 0.35 * F.coalesce(F.least(_off() / 0.5, F.lit(1.0)), F.lit(1.0)) + 0.20 * F.when(_ok(), 0.0).otherwise(1.0)
    return rows.select("event_id", "prompt", or_else("section", "?").alias("section"), "bpm_target", "clap_score", rounded(_off()).alias("abs_deviation"), "status", rounded(score).alias("difficulty"))


def negatives(rows: DataFrame, k: int = 10) -> DataFrame:
    """The weakest of each section, k over all sections, one each at least."""
    rows = rows.where(F.col("clap_score").isNotNull()).withColumn("section", or_else("section", "?"))
    each = rows.select("section").distinct().agg(F.greatest(F.floor(F.lit(k) / F.count("*")), F.lit(1)).alias("each"))
    first = first_of(rows, "section", ["clap_score", "event_id"], k, "event_id")
    return first.join(F.broadcast(each)).where(F.col("nth") <= F.col("each")).select("section", "clap_score", "audio_path", "prompt")  # one row


def best_candidate(rows: DataFrame, by: str) -> DataFrame:
    best = F.max_by("event_id", F.struct(F.coalesce("clap_score", F.lit(0.0)), -F.col("event_id")))
    return rows.groupBy(by).agg(best.alias("event_id"), rounded(F.max(F.coalesce("clap_score", F.lit(0.0)))).alias("clap"))


def _hardness() -> Column:
    return 0.5 * F.coalesce(1.0 - F.col("clap_score"), F.lit(1.0)) + 0.5 * F.coalesce(F.least(_off() / 0.5, F.lit(1.0)), F.lit(1.0))


def reliability_fit(rows: DataFrame) -> DataFrame:
    """One row: the least-squares line of being ok over difficulty, and how much it explains."""
    ok = F.coalesce(_ok().cast("double"), F.lit(0.0))
    one = rows.select(_hardness().alias("x"), ok.alias("y")).agg(
        F.count("*").alias("n"), F.regr_slope("y", "x").alias("k"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy")
    )
    k = F.coalesce("k", F.lit(0.0))
    r2 = F.when(F.col("syy") > 1e-12, k * k * F.col("sxx") / F.col("syy")).otherwise(0.0)
    return one.select("n", rounded(k).alias("slope"), rounded(F.col("my") - k * F.col("mx")).alias("intercept"), rounded(r2).alias("r_squared"), (r2 >= 0.5).alias("reliable"))


def reliability_curve(rows: DataFrame, bins: int = 4) -> DataFrame:
    """Ok share by equal-width bins of difficulty; empty bins are left out."""
    d = rows.withColumn("d", _hardness())
    edge = d.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.when(F.col("hi") - F.col("lo") < 1e-9, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("d") - F.col("lo")) / width)))
    by = d.join(F.broadcast(edge)).groupBy(bin_.cast("int").alias("bin"))  # one row
    return by.agg(rounded(F.avg("d")).alias("mean_difficulty"), F.count("*").alias("n"), rounded(share(_ok())).alias("ok_rate"))


def thresholds(rows: DataFrame) -> DataFrame:
    """90th percentile of deviation and 10th of clap over ok rows, and how many rows they reject."""
    ok = rows.where(_ok())
    if ok.count() <= FEW:
        both = ok.agg(rounded(F.percentile(_off(), 0.9)).alias("dev"), rounded(F.percentile("clap_score", 0.1)).alias("clap"))
        cut = rows.join(F.broadcast(both)).groupBy("dev", "clap")  # one row
    else:
        dev, clap = (F.lit(quantiles(ok, c, [s])[0]).cast("double") for c, s in ((_off(), 0.9), ("clap_score", 0.1)))
        cut = rows.withColumns({"dev": rounded(dev), "clap": rounded(clap)}).groupBy("dev", "clap")
    out = cut.agg(F.count_if(_ok()).alias("n_prompts"), F.count_if(_off() > F.col("dev")).alias("would_reject_dev"), F.count_if(F.col("clap_score") < F.col("clap")).alias("would_reject_clap"))
    return out.withColumnsRenamed({"dev": "suggested_max_abs_deviation", "clap": "suggested_min_clap_score"})


def drilldown(rows: DataFrame, within: float = 8.0) -> DataFrame:
    """Rows to look at: not ok, or detected tempo off, with what the ratio suggests."""
    detected = F.col("bpm_target") * (1.0 + F.col("deviation"))
    ratio = detected / F.nullif("bpm_target", F.lit(0.0))
    hint = F.when(ratio > 1.5, "double time").when(ratio < 0.66, "half time").otherwise("check")
    return rows.where(~_ok() | (F.abs(detected - F.col("bpm_target")) > within)).select("event_id", "prompt", "status", rounded(detected, 2).alias("detected_bpm"), F.when(ratio.isNull(), "check").otherwise(hint).alias("hint"))


def fold_tempo(detected: Column, target: Column, tolerance: float = 0.05) -> Column:
    """(factor, deviation) of the first octave or triplet factor within tolerance, else factor 1."""
    raw = (detected - target) / target
    out = F.struct(F.lit(1.0).alias("factor"), raw.alias("deviation"))
    for f in reversed((0.5, 2.0, 0.25, 4.0, 0.75, 1.5)):
        dev = (detected * f - target) / target
        out = F.when(F.abs(dev) <= tolerance, F.struct(F.lit(f).alias("factor"), dev.alias("deviation"))).otherwise(out)
    return F.when(F.abs(raw) <= tolerance, F.struct(F.lit(1.0).alias("factor"), raw.alias("deviation"))).otherwise(out)


def mos_proxy(clap: Column, clipping: Column, silence: Column, snr_db: Column) -> Column:
    clean = clamp(1.0 - clipping * 10.0) * F.coalesce(clamp(snr_db / 40.0), F.lit(1.0))
    return 0.6 * clamp(F.coalesce(clap, F.lit(0.0))) + 0.25 * clean + 0.15 * clamp(1.0 - silence)
