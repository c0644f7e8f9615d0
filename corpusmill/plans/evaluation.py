"""Queries over evaluation results, each with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.columns import rounded
from corpusmill.operators import evaluation as op
from corpusmill.sources.views import evaluation as ev
from corpusmill.sources.views import ratings

#: Gates by genre: least clap, most deviation.
GATES = {"default": (0.3, 0.2), "ambient": (0.35, 0.1), "drill": (0.4, 0.15)}

OK = "avg(case when status = 'ok' then 1e0 else 0e0 end)"
SCORE = "0.4e0 * {ok} + 0.3e0 * coalesce({clap}, 0e0) + 0.3e0 * (case when {dev} is null then 0e0 else greatest(0e0, 1e0 - {dev} / 0.2e0) end)"


def r(x: str, places: int = 4) -> str:
    return f"round({x}, {places}) + 0e0"


def cost(spark, folder):
    """kWh of a model's runs, from its size class and tokens."""
    rows = ev(spark, folder)
    params = F.when(F.col("genre").contains("trap"), 3.3e9).when(F.col("genre").contains("drill"), 1.5e9).otherwise(3e8)
    kwh = params * 2.0 * 256 * 1e-12 / 3.6e6
    return rows.withColumn("kwh", kwh).rollup("section").agg(F.count("*").alias("runs"), rounded(F.sum("kwh") * 1e9, 3).alias("nkwh"))


def window_trend(spark, folder):
    """The last 5 scored rows of each checkpoint, in order."""
    from pyspark.sql import Window

    rows = ev(spark, folder).where(F.col("clap_score").isNotNull())
    nth = F.row_number().over(Window.partitionBy("checkpoint").orderBy(F.desc("event_id")))
    return rows.withColumn("nth", nth).where("nth <= 5").groupBy("checkpoint").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "clap_score"))), lambda x: F.format_string("%.3f", x["clap_score"])), " ").alias("series")
    )


def incremental(spark, folder):
    """Prompts that did not pass for a checkpoint yet: what a rerun does."""
    rows = ev(spark, folder)
    passed = rows.where((F.col("checkpoint") == "ck1") & (F.col("status") == "ok")).select("prompt").distinct()
    return rows.select("prompt").distinct().join(passed, "prompt", "left_anti")


def folded(spark, folder):
    rows = ev(spark, folder).where("bpm_target > 0 and deviation is not null")
    detected = F.col("bpm_target") * (1.0 + F.col("deviation")) * F.element_at(F.array(*[F.lit(x) for x in (1.0, 2.0, 0.5, 1.2)]), (F.col("event_id") % 4 + 1).cast("int"))
    f = op.fold_tempo(detected, F.col("bpm_target"))
    verdict = F.when(F.abs(f["deviation"]) <= 0.05, "ok").when(F.abs(f["deviation"]) <= 0.2, "stretched").otherwise("rejected")
    return rows.select("event_id", f["factor"].alias("factor"), rounded(f["deviation"]).alias("deviation"), verdict.alias("verdict"))


_MEANS = f"count(*) as n, {r('avg(clap_score)')} as mean_clap, {r('avg(abs(deviation))')} as mean_abs_deviation, {r(OK)} as ok_pct"
_DET = "bpm_target * (1e0 + deviation) * (case event_id % 4 when 0 then 1e0 when 1 then 2e0 when 2 then 0.5e0 else 1.2e0 end)"

QUERIES = {
    "leaderboard": (
        lambda s, d: op.leaderboard(ev(s, d), ratings(s, d)),
        f"""b as (select checkpoint, count(*) as runs, {r(OK)} as ok_pct, {r('avg(clap_score)')} as mean_clap, {r('avg(abs(deviation))')} as mean_abs_deviation
              from ev group by checkpoint),
        h as (select e.checkpoint, {r('avg(q.rating)')} as mean_human_rating from ev e join ratings q on e.prompt = q.prompt group by e.checkpoint),
        s as (select b.*, h.mean_human_rating, {r(SCORE.format(ok='ok_pct', clap='mean_clap', dev='mean_abs_deviation'))} as score from b left join h on b.checkpoint = h.checkpoint)
        select *, row_number() over (order by score desc, checkpoint) as rank from s""",
    ),
    "seed_aggregate": (
        lambda s, d: op.seed_aggregate(ev(s, d), 0.2, 0.1),
        f"""a as (select checkpoint, prompt, count(*) as n_seeds, count(*) filter (status = 'ok') as ok_seeds, arg_min(section, seed_no) as section,
               {r('median(deviation)')} as deviation, {r('avg(clap_score)')} as clap_score from ev group by checkpoint, prompt),
        n as (select *, coalesce(concat_ws('; ', case when clap_score < 0.2 then 'clap' end, case when abs(deviation) > 0.1 then 'deviation' end), '') as notes from a)
        select *, case when ok_seeds >= (n_seeds + 1) // 2 and notes = '' then 'ok' else 'rejected' end as status from n""",
    ),
    "gate_aggregate": (lambda s, d: op.means(ev(s, d), "checkpoint", 0.0, float("inf")), f"select checkpoint, {_MEANS} from ev group by checkpoint"),
    "checkpoint_export": (lambda s, d: op.means(ev(s, d)), f"select checkpoint, {_MEANS} from ev group by checkpoint"),
    "registry_summary": (
        lambda s, d: op.registry_summary(ev(s, d)),
        f"""a as (select checkpoint, {OK} as ok, avg(clap_score) as clap, avg(abs(deviation)) as dev from ev group by checkpoint)
        select checkpoint, {r(SCORE.format(ok='ok', clap='clap', dev='dev'))} as score from a""",
    ),
    "section_interaction": (
        lambda s, d: op.section_interaction(ev(s, d)),
        f"""a as (select case when section = '' then '?' else section end as section, status, deviation, clap_score,
              case when bpm_target <> 0 and deviation is not null then bpm_target end as b, case when bpm_target <> 0 then abs(deviation) end as d from ev)
        select section, count(*) as n, {r(OK)} as ok_rate, {r('avg(abs(deviation))')} as mean_abs_dev, {r('avg(clap_score)')} as mean_clap,
               {r('case when count(b) >= 4 and stddev_pop(b) > 0 and stddev_pop(d) > 0 then corr(b, d) end')} as bpm_dev_corr from a group by section""",
    ),
    "genre_gate": (
        lambda s, d: op.genre_gate(ev(s, d), GATES),
        f"""a as (select genre, count(*) as n, {r('coalesce(avg(clap_score), 0e0)')} as mean_clap, {r("coalesce(avg(abs(deviation)), cast('inf' as double))")} as mean_abs_deviation,
              case genre when 'ambient' then 0.35e0 when 'drill' then 0.4e0 else 0.3e0 end as min_clap, case genre when 'ambient' then 0.1e0 when 'drill' then 0.15e0 else 0.2e0 end as max_dev
              from ev group by genre)
        select *, mean_clap >= min_clap and mean_abs_deviation <= max_dev as passed from a""",
    ),
    "alert_violations": (
        lambda s, d: op.alert_violations(ev(s, d), 0.5, 0.09, 0.5),
        f"""a as (select checkpoint, {_MEANS} from ev group by checkpoint),
        l as (select checkpoint, 'clap' as metric, mean_clap as value, 0.5e0 as "limit" from a
              union all select checkpoint, 'deviation', mean_abs_deviation, 0.09e0 from a union all select checkpoint, 'ok', ok_pct, 0.5e0 from a)
        select * from l where case when metric = 'deviation' then value > "limit" else value < "limit" end""",
    ),
    "regression_gate": (
        lambda s, d: op.regression_gate(ev(s, d), "ck0", "ck1", 0.001, 0.05),
        f"""a as (select avg(clap_score) filter (checkpoint = 'ck0') as bc, avg(clap_score) filter (checkpoint = 'ck1') as cc,
              avg(abs(deviation)) filter (checkpoint = 'ck0') as bd, avg(abs(deviation)) filter (checkpoint = 'ck1') as cd from ev)
        select 'clap' as "check", {r('bc')} as baseline, {r('cc')} as candidate, {r('cc - bc')} as delta, 0.001e0 as "limit", bc - cc > 0.001e0 as blocking from a
        union all select 'deviation', {r('bd')}, {r('cd')}, {r('cd - bd')}, 0.05e0, cd - bd > 0.05e0 from a""",
    ),
    "paraphrase_robustness": (
        lambda s, d: op.paraphrase_robustness(ev(s, d)),
        f"""select intent, count(*) as n, {r('avg(clap_score)')} as mean_clap, {r('stddev_samp(clap_score)')} as std_clap, {r('max(clap_score) - min(clap_score)')} as spread
        from ev where clap_score is not null group by intent having count(*) >= 2""",
    ),
    "seed_diversity": (
        lambda s, d: op.seed_diversity(ev(s, d)),
        f"""select prompt, count(clap_score) as n, {r('avg(clap_score)')} as mean_clap, {r('stddev_pop(clap_score)')} as std_clap,
        {r('case when avg(clap_score) <> 0 then stddev_pop(clap_score) / avg(clap_score) else 0e0 end')} as cv, {r('min(clap_score)')} as min_clap, {r('max(clap_score)')} as max_clap,
        stddev_pop(clap_score) < 0.02 as collapsed from ev group by prompt having count(clap_score) > 0""",
    ),
    "section_coverage": (lambda s, d: op.counts(ev(s, d), "checkpoint", "section"), "select checkpoint, section, count(*) as n from ev group by checkpoint, section"),
    "busiest_checkpoint": (
        lambda s, d: op.busiest(ev(s, d), "checkpoint", "event_id"),
        "select checkpoint, count(*) as n from ev group by checkpoint order by n desc, min(event_id) limit 1",
    ),
    "section_verdicts": (
        lambda s, d: op.verdicts(ev(s, d)),
        """a as (select case when section = '' then '?' else section end as section, count(*) filter (status = 'ok') as ok, count(*) as total from ev group by 1)
        select *, concat(ok, '/', total) as label from a""",
    ),
    "section_tempo_heatmap": (
        lambda s, d: op.section_tempo_heatmap(ev(s, d)),
        """select case when section = '' then '?' else section end as section, least(cast(floor((bpm_target - 60) / 10) as int), 11) as bin, count(*) as n
        from ev where bpm_target between 60 and 180 group by 1, 2""",
    ),
    "metric_melt": (
        lambda s, d: op.melt(ev(s, d).select("event_id", "clap_score", "deviation", "bpm_target"), "event_id", ["clap_score", "deviation", "bpm_target"]),
        f"""select event_id, 'clap_score' as metric, {r('clap_score')} as value from ev where clap_score is not null
        union all select event_id, 'deviation', {r('deviation')} from ev where deviation is not null union all select event_id, 'bpm_target', {r('bpm_target')} from ev""",
    ),
    "metrics_lab": (
        lambda s, d: op.metrics_lab(ev(s, d)),
        f"select {r('avg(clap_score)')} as mean_clap, {r('avg(case when deviation is not null then 1e0 - least(1e0, 5e0 * abs(deviation)) end)')} as bpm_adherence, {r(OK)} as ok_rate, count(*) as n from ev",
    ),
    "clap_z_scores": (
        lambda s, d: op.z_scores(ev(s, d)),
        f"""a as (select event_id, prompt, case when section = '' then '?' else section end as section, clap_score from ev),
        z as (select *, (clap_score - avg(clap_score) over w) / nullif(stddev_pop(clap_score) over w, 0) as z from a window w as (partition by section))
        select event_id, prompt, section, clap_score, {r('z')} as clap_z, z > 0 as above_mean from z""",
    ),
    "global_z_scores": (
        lambda s, d: op.global_z(ev(s, d).select("event_id", "value"), "value"),
        f"select event_id, value, {r('(value - avg(value) over ()) / stddev_pop(value) over ()')} as z from ev",
    ),
    "running_best": (
        lambda s, d: op.running_best(ev(s, d).where("clap_score is not null"), "checkpoint", "event_id", "clap_score"),
        f"""a as (select checkpoint, event_id, clap_score, row_number() over w as step, max(clap_score) over w as best from ev where clap_score is not null window w as (partition by checkpoint order by event_id)),
        b as (select *, lag(best) over (partition by checkpoint order by event_id) as was from a),
        c as (select *, step - max(case when was is null or clap_score > was then step end) over (partition by checkpoint order by event_id) as since from b)
        select checkpoint, step, {r('clap_score')} as clap_score, {r('best')} as best, since as since_best, since >= 3 as stop from c""",
    ),
    "prompt_difficulty": (
        lambda s, d: op.difficulty(ev(s, d)),
        f"""select event_id, prompt, case when section = '' then '?' else section end as section, bpm_target, clap_score, {r('abs(deviation)')} as abs_deviation, status,
        {r("0.45e0 * coalesce(1e0 - clap_score, 1e0) + 0.35e0 * coalesce(case when deviation is not null then least(abs(deviation) / 0.5e0, 1e0) end, 1e0) + 0.2e0 * (case when status = 'ok' then 0e0 else 1e0 end)")} as difficulty from ev""",
    ),
    "hard_negatives": (
        lambda s, d: op.negatives(ev(s, d), 12),
        """a as (select case when section = '' then '?' else section end as section, clap_score, audio_path, prompt, event_id from ev where clap_score is not null),
        n as (select *, row_number() over (partition by section order by clap_score, event_id) as nth, (select greatest(12 // count(distinct section), 1) from a) as each from a)
        select section, clap_score, audio_path, prompt from n where nth <= each""",
    ),
    "best_candidate": (
        lambda s, d: op.best_candidate(ev(s, d), "prompt"),
        f"""n as (select prompt, event_id, coalesce(clap_score, 0e0) as c, row_number() over (partition by prompt order by coalesce(clap_score, 0e0) desc, event_id) as nth from ev)
        select prompt, event_id, {r('c')} as clap from n where nth = 1""",
    ),
    "reliability_curve": (
        lambda s, d: op.reliability_curve(ev(s, d)),
        f"""a as (select status, 0.5e0 * coalesce(1e0 - clap_score, 1e0) + 0.5e0 * coalesce(case when deviation is not null then least(abs(deviation) / 0.5e0, 1e0) end, 1e0) as d from ev),
        b as (select *, min(d) over () as lo, max(d) over () as hi from a)
        select cast(least(3, floor((d - lo) / ((hi - lo) / 4))) as int) as bin, {r('avg(d)')} as mean_difficulty, count(*) as n, {r(OK)} as ok_rate from b group by 1""",
    ),
    "reliability_fit": (
        lambda s, d: op.reliability_fit(ev(s, d)),
        f"""a as (select 0.5e0 * coalesce(1e0 - clap_score, 1e0) + 0.5e0 * coalesce(case when deviation is not null then least(abs(deviation) / 0.5e0, 1e0) end, 1e0) as x, case when status = 'ok' then 1e0 else 0e0 end as y from ev)
        select count(*) as n, {r('regr_slope(y, x)')} as slope, {r('regr_intercept(y, x)')} as intercept, {r('regr_r2(y, x)')} as r_squared, regr_r2(y, x) >= 0.5 as reliable from a""",
    ),
    "calibrated_thresholds": (
        lambda s, d: op.thresholds(ev(s, d)),
        f"""t as (select count(*) as n_prompts, {r('quantile_cont(abs(deviation), 0.9)')} as dv, {r('quantile_cont(clap_score, 0.1)')} as cl from ev where status = 'ok')
        select n_prompts, dv as suggested_max_abs_deviation, cl as suggested_min_clap_score, count(*) filter (abs(deviation) > dv) as would_reject_dev,
        count(*) filter (clap_score < cl) as would_reject_clap from ev, t group by n_prompts, dv, cl""",
    ),
    "eval_drilldown": (
        lambda s, d: op.drilldown(ev(s, d)),
        f"""a as (select *, bpm_target * (1e0 + deviation) as det from ev)
        select event_id, prompt, status, {r('det', 2)} as detected_bpm,
        case when det / nullif(bpm_target, 0) > 1.5 then 'double time' when det / nullif(bpm_target, 0) < 0.66 then 'half time' else 'check' end as hint
        from a where status <> 'ok' or abs(det - bpm_target) > 8""",
    ),
    "section_filter": (
        lambda s, d: ev(s, d).where(F.col("section").isin("click", "view")).select("event_id", "section"),
        "select event_id, section from ev where section in ('click', 'view')",
    ),
    "run_costs": (
        cost,
        """a as (select section, case when genre like '%trap%' then 3.3e9 when genre like '%drill%' then 1.5e9 else 3e8 end * 2e0 * 256 * 1e-12 / 3.6e6 as kwh from ev)
        select section, count(*) as runs, round(sum(kwh) * 1e9, 3) + 0e0 as nkwh from a group by rollup (section)""",
    ),
    "recent_trend": (
        window_trend,
        """n as (select *, row_number() over (partition by checkpoint order by event_id desc) as nth from ev where clap_score is not null)
        select checkpoint, string_agg(format('{:.3f}', clap_score), ' ' order by event_id) as series from n where nth <= 5 group by checkpoint""",
    ),
    "pending_prompts": (
        incremental,
        "select distinct prompt from ev where prompt not in (select prompt from ev where checkpoint = 'ck1' and status = 'ok')",
    ),
    "folded_tempo": (
        folded,
        f"""a as (select event_id, bpm_target as t, {_DET} as x from ev where bpm_target > 0 and deviation is not null),
        f as (select *, case when abs((x - t) / t) <= 0.05 then 1e0 when abs((x * 0.5e0 - t) / t) <= 0.05 then 0.5e0 when abs((x * 2e0 - t) / t) <= 0.05 then 2e0 when abs((x * 0.25e0 - t) / t) <= 0.05 then 0.25e0
              when abs((x * 4e0 - t) / t) <= 0.05 then 4e0 when abs((x * 0.75e0 - t) / t) <= 0.05 then 0.75e0 when abs((x * 1.5e0 - t) / t) <= 0.05 then 1.5e0 else 1e0 end as factor from a)
        select event_id, factor, {r('(x * factor - t) / t')} as deviation,
        case when abs((x * factor - t) / t) <= 0.05 then 'ok' when abs((x * factor - t) / t) <= 0.2 then 'stretched' else 'rejected' end as verdict from f""",
    ),
}
