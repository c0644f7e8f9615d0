"""Queries over catalogs, names and prompts, each with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.columns import rounded
from corpusmill.operators import catalog as op
from corpusmill.sources.views import evaluation, lines, table, tracks

from .analysis import _COS
from .evaluation import r


def described(s, d):
    clips = tracks(s, d).select(F.concat("source_id", F.when(F.col("track_id") % 2 == 0, "_seg001").otherwise("")).alias("stem"))
    texts = tracks(s, d).where("track_id % 3 <> 0").select(F.when(F.col("track_id") % 8 == 4, F.concat("source_id", F.lit("_seg001"))).otherwise(F.col("source_id")).alias("k"), F.concat_ws(" ", F.lit("about"), "source_id").alias("description"))
    return op.training_pairs(clips, texts, "k")


def version(s, d):
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("at"), F.concat(F.lit("v"), "o_orderkey").alias("version"), F.col("o_orderpriority").alias("label"))
    return op.resolved(rows, "2-HIGH").select("version", "label")


def chords(s, d):
    names = ["C", "Am", "F", "G", "Dm", "Em"]
    one = [F.element_at(F.array(*[F.lit(x) for x in names]), ((F.col("event_id") * k) % 6 + 1).cast("int")) for k in (1, 2, 3, 5)]
    return evaluation(s, d).select("event_id", op.chord_mood(F.array(*one)).alias("mood"))


def _drift(continuous, discrete):
    """The SQL of the drift report: a row a feature, each by itself."""
    psi = "b as (select {bin} as bin, count(*) filter (split = 'train') as cc, count(*) filter (split <> 'train') as rr from tracks{more} group by 1), z as (select greatest(cc / sum(cc) over (), 1e-6) as c, greatest(rr / sum(rr) over (), 1e-6) as q from b), y as (select round(sum((c - q) * ln(c / q)), 6) + 0e0 as psi from z)"
    rows = [
        f"""select * from (with e as (select quantile_cont({x}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as edges from tracks where split <> 'train' and {x} is not null), {psi.format(bin=f'len(list_filter(edges, lambda x: x <= {x}))', more=f', e where {x} is not null')},
        g as (select {x} as v, count(*) filter (split = 'train') as c, count(*) filter (split <> 'train') as q from tracks where {x} is not null group by 1), f as (select sum(c) over (order by v) / sum(c) over () as fc, sum(q) over (order by v) / sum(q) over () as fr from g),
        k as (select (select sum(c) from g) as n, (select sum(q) from g) as m, round(max(abs(fc - fr)), 6) as d from f), x as (select d * sqrt(n * m / (n + m)) as x from k),
        p as (select round(case when x < 0.2 then 1e0 else greatest(0e0, least(1e0, 2 * list_sum(list_transform(range(1, 101), lambda i: case when i % 2 = 1 then 1e0 else -1e0 end * exp(-2e0 * i * i * x * x))))) end, 6) + 0e0 as p from x),
        u as (select avg({x}) filter (split <> 'train') as was, avg({x}) filter (split = 'train') as now from tracks)
        select '{x}' as feature, 'continuous' as kind, {r('was')} as reference_mean, {r('now')} as current_mean, {r('now - was')} as delta, p as ks_pvalue, psi, p < 0.05 as drifted from y, p, u)"""
        for x in continuous
    ]
    rows += [f"select * from (with {psi.format(bin=x, more='')} select '{x}' as feature, 'discrete' as kind, cast(null as double) as reference_mean, cast(null as double) as current_mean, cast(null as double) as delta, cast(null as double) as ks_pvalue, psi, psi > 0.25 as drifted from y)" for x in discrete]
    return " union all ".join(rows)


QUERIES = {
    "lines_without_banned_terms": (
        lambda s, d: op.without_banned(lines(s, d), "line", ["THE", " la ", ""]).groupBy("doc_id").agg(F.count("*").alias("n")),
        "select doc_id, count(*) as n from lines where not contains(lower(line), 'the') and not contains(lower(line), 'la') group by doc_id",
    ),
    "track_base_names": (lambda s, d: tracks(s, d).select("source_id", op.base_name("path").alias("name"), op.vibe("path").alias("vibe")),
        """select source_id, string_split(path, '/')[-1] as name, case when contains(path, 'night') then 'dark' when contains(path, 'sun') then 'bright' when contains(path, 'rain') then 'calm' when contains(path, 'train') then 'warm'
        when contains(path, 'val') then 'cool' else 'neutral' end as vibe from tracks"""),
    "training_pairs": (
        described,
        """c as (select concat(source_id, case when track_id % 2 = 0 then '_seg001' else '' end) as stem, source_id from tracks),
        t as (select case when track_id % 8 = 4 then concat(source_id, '_seg001') else source_id end as k, concat('about ', source_id) as descr from tracks where track_id % 3 <> 0)
        select stem, coalesce(a.descr, b.descr) as description from c left join t a on c.stem = a.k left join t b on c.source_id = b.k where coalesce(a.descr, b.descr) is not null""",
    ),
    "resolved_version": (version, "select concat('v', o_orderkey) as version, o_orderpriority as label from orders where o_orderpriority = '2-HIGH' order by o_orderkey limit 1"),
    "template_prompts": (
        lambda s, d: tracks(s, d).select("source_id", op.template(F.col("bpm"), F.col("musical_key"), (F.col("track_id") % 10) / 10.0).alias("prompt")),
        """select source_id, concat_ws(', ', case when bpm is not null then concat(case when bpm < 80 then 'slow' when bpm < 110 then 'mid-tempo' when bpm < 140 then 'upbeat' else 'fast' end, ' track') end,
        case when coalesce(musical_key, '') <> '' then concat('in ', musical_key) end, case when track_id % 10 > 6 then 'dense' when track_id % 10 < 3 then 'sparse' end) as prompt from tracks""",
    ),
    "custom_tokens": (
        lambda s, d: op.custom_tokens(table(s, d, "part"), "p_name"),
        "select distinct concat('<', t, '>') as token from (select regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') as t from part) where length(t) between 2 and 32",
    ),
    "chord_moods": (
        chords,
        """a as (select event_id, len(list_filter([1, 2, 3, 5], lambda k: (event_id * k) % 6 in (1, 4, 5))) / 4e0 as s from ev) select event_id, case when s >= 0.5 then 'dark' when s >= 0.25 then 'bittersweet' else 'bright' end as mood from a""",
    ),
    "structure_order": (
        lambda s, d: evaluation(s, d).groupBy(F.floor(F.col("event_id") / 20).alias("song")).agg(F.array_sort(F.collect_list(F.struct("event_id", "section"))).alias("l")).select("song", op.order_score(F.transform("l", lambda x: F.when(x["section"] == "click", "intro").when(x["section"] == "view", "outro").otherwise("verse")), F.lit("intro")).alias("score")),
        """a as (select event_id // 20 as song, list(case section when 'click' then 'intro' when 'view' then 'outro' else 'verse' end order by event_id) as l from ev group by 1)
        select song, case when not list_contains(l, 'intro') then 0e0 when l[1] = 'intro' then 1e0 else 0.5e0 end as score from a""",
    ),
    "batch_plans": (
        lambda s, d: table(s, d, "part").select("p_partkey", op.batch_plan(F.col("p_retailprice") * 10, F.lit(8000.0), F.col("p_size").cast("double") + 1).alias("x")).select("p_partkey", "x.format", "x.batch"),
        """a as (select p_partkey, p_retailprice * 10 as m, p_size + 1e0 as z, 8000e0 * (1 - 0.15e0) as f from part), b as (select *, case when m <= f then 'fp32' when m / 2 <= f then 'fp16' when m / 4 <= f then 'int8' when m / 8 <= f then 'int4' end as format from a)
        select p_partkey, format, case when format is not null then cast(greatest(1, floor((f - case format when 'fp32' then m when 'fp16' then m / 2 when 'int8' then m / 4 else m / 8 end) / z)) as bigint) end as batch from b""",
    ),
    "traffic_routes": (lambda s, d: op.routed(table(s, d, "customer").select("c_custkey"), "c_custkey", 0.3), None),
    "flows": (
        lambda s, d: tracks(s, d).where("bpm is not null").select("source_id", op.flow(F.col("bpm"), (F.col("track_id") % 10) / 10.0).alias("flow")),
        "select source_id, case when bpm >= 140 then 'triplet' when bpm >= 110 and track_id % 10 > 5 then 'staccato' when bpm < 80 then 'laid-back' else 'steady' end as flow from tracks where bpm is not null",
    ),
    "cycled_prompts": (
        lambda s, d: op.cycled_prompts(tracks(s, d), "track_id", "genre", "section").select("i", "genre", "mood", "seed"),
        """t as (select list(distinct genre order by genre) filter (genre is not null) as g, list(distinct section order by section) filter (section is not null) as m from tracks)
        select track_id as i, g[track_id % len(g) + 1] as genre, m[track_id % len(m) + 1] as mood, track_id + 42 as seed from tracks, t""",
    ),
    "perturbed_prompts": (lambda s, d: evaluation(s, d).select("event_id", op.perturbed(F.col("genre"), F.col("event_id"), 3, "trap", "house").alias("p")), None),
    "vocabulary_tags": (
        lambda s, d: op.tags_for(table(s, d, "embeddings").where("vec_id >= 20").withColumn("vec_id", F.col("vec_id").cast("long")), table(s, d, "embeddings").where("vec_id < 20").withColumn("vec_id", F.col("vec_id").cast("long")), "vec_id", "embedding", 3, 0.1),
        f"""p as (select cast(e.vec_id as bigint) as id, cast(v.vec_id as bigint) as term, round({_COS.format(a='e.embedding', b='v.embedding')}, 6) as sim from embeddings e, embeddings v where e.vec_id >= 20 and v.vec_id < 20),
        k as (select *, row_number() over (partition by id order by sim desc, term) as i from p) select id, term from k where i <= 3 and sim >= 0.1""",
    ),
    "drift_report": (lambda s, d: op.drift_report(tracks(s, d), F.col("split") == "train", ["bpm", "duration", "lufs"], ["genre", "mood", "section"]), _drift(("bpm", "duration", "lufs"), ("genre", "mood", "section"))),
    "deviation_heatmap": (
        lambda s, d: evaluation(s, d).where("deviation is not null").groupBy(F.left("prompt", F.lit(26)).alias("prompt"), "checkpoint").agg(rounded(F.avg(F.abs("deviation"))).alias("deviation")),
        f"select left(prompt, 26) as prompt, checkpoint, {r('avg(abs(deviation))')} as deviation from ev where deviation is not null group by 1, 2",
    ),
    "run_comparison": (
        lambda s, d: evaluation(s, d).where("genre = 'drill'").groupBy("checkpoint").agg(F.count_if(F.abs("deviation") <= 0.05).alias("in_tolerance"), rounded(F.avg(F.abs("deviation"))).alias("mean_abs_deviation")),
        f"select checkpoint, count(*) filter (abs(deviation) <= 0.05) as in_tolerance, {r('avg(abs(deviation))')} as mean_abs_deviation from ev where genre = 'drill' group by checkpoint",
    ),
    "segments_by_song": (
        lambda s, d: tracks(s, d).groupBy(F.coalesce(F.nullif("song_id", F.lit("")), F.col("source_id")).alias("song")).agg(F.count("*").alias("n"), F.min("track_id").alias("first")),
        "select coalesce(nullif(song_id, ''), source_id) as song, count(*) as n, min(track_id) as first from tracks group by 1",
    ),
}


def onsets(s, d):
    """Spacing of events: rate, mean gap and its variation."""
    from pyspark.sql import Window

    gap = F.col("event_id") - F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))
    by = table(s, d, "events").select("user_id", gap.alias("g")).where("g is not null").groupBy("user_id")
    return by.agg(F.count("*").alias("n"), rounded(F.avg("g")).alias("mean_gap"), rounded(F.stddev_pop("g") / F.avg("g")).alias("cv"))


def compared(s, d):
    from corpusmill.operators import statistics as st
    from corpusmill.plans.analysis import paired

    return st.comparison(paired(s, d, "event_id"), "event_id", {"clap_score": True, "deviation": False})


def labelling(s, d):
    from corpusmill.operators import vectors as ve
    from corpusmill.plans.analysis import vectors

    return ve.labelling_priority(vectors(s, d).where("vec_id % 5 = 0"), vectors(s, d).where("vec_id % 5 <> 0"), "vec_id", "embedding", "label", 20)


def axes(s, d):
    from corpusmill.operators import vectors as ve
    from corpusmill.plans.analysis import vectors

    return ve.principal_axes(vectors(s, d), "vec_id", "embedding")


QUERIES |= {
    "onset_gaps": (
        onsets,
        f"""a as (select user_id, event_id - lag(event_id) over (partition by user_id order by event_id) as g from events) select user_id, count(*) as n, {r('avg(g)')} as mean_gap, {r('stddev_pop(g) / avg(g)')} as cv from a where g is not null group by user_id""",
    ),
    "midi_notes": (
        lambda s, d: evaluation(s, d).select("event_id", F.bround(69.0 + 12.0 * F.log2((F.col("value") + 27.5) / 440.0)).cast("int").alias("note")),
        "select event_id, cast(round_even(69 + 12 * log2((value + 27.5e0) / 440e0), 0) as int) as note from ev",
    ),
    "comparison_report": (compared, None),
    "labelling_priority": (
        labelling,
        f"""p as (select q.vec_id as id, e.label, round({_COS.format(a='q.embedding', b='e.embedding')}, 6) as sim, e.vec_id as nid from embeddings q join embeddings e on e.vec_id % 5 <> 0 where q.vec_id % 5 = 0),
        k as (select *, row_number() over (partition by id order by sim desc, nid) as i from p), t as (select * from k where i <= 5), v as (select id, label, count(*) as n from t group by 1, 2),
        u as (select id, 1e0 - max(n) / sum(n) as u from v group by id), f as (select id, 1e0 - max(sim) as f from t group by id), b as (select * from u join f using (id)),
        z as (select id, case when stddev_pop(u) over () < 1e-12 then 0 else (u - avg(u) over ()) / stddev_pop(u) over () end + case when stddev_pop(f) over () < 1e-12 then 0 else (f - avg(f) over ()) / stddev_pop(f) over () end as x from b)
        select id, {r('x')} as priority from z order by priority desc, id limit 20""",
    ),
    "principal_axes": (axes, None),
}
