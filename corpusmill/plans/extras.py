"""Queries over smaller scores and plans, each with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.columns import rounded, transposed
from corpusmill.operators import evaluation as eo
from corpusmill.operators import extras as op
from corpusmill.sources.views import evaluation, lines, table, tracks

from .evaluation import r


def signal_columns(s, d):
    return tracks(s, d).select("source_id", ((F.col("track_id") % 50) / 997.0).alias("clip"), ((F.col("track_id") % 40) / 83.0).alias("silence"), "lufs")


def quality_gate(s, d):
    """Every genre passes its gate and the Fréchet distance is low enough, or missing and allowed."""
    gates = eo.genre_gate(evaluation(s, d), {"default": (0.3, 0.2)}).agg(F.bool_and("passed").alias("genres"))
    return gates.select("genres", F.lit(None).cast("double").alias("fad"), F.col("genres").alias("passed"))


def tag_means(s, d):
    """Mean clap of each tag over the rows that carry it."""
    rows = evaluation(s, d).select("checkpoint", "clap_score", F.create_map(F.lit("genre"), F.col("genre"), F.lit("section"), F.nullif("section", F.lit(""))).alias("tags"))
    long = rows.select("checkpoint", "clap_score", F.explode("tags").alias("tag", "value")).where("value is not null")
    return long.groupBy("checkpoint", "tag", "value").agg(rounded(F.avg("clap_score")).alias("mean_clap"))


def winners(s, d):
    """Votes on blind pairs, led back to checkpoints."""
    votes = evaluation(s, d).select("prompt", F.when(F.col("event_id") % 3 == 0, "X").otherwise("Y").alias("choice"), F.concat(F.lit("ck"), F.col("event_id") % 2).alias("x"), F.concat(F.lit("ck"), F.col("event_id") % 2 + 2).alias("y"))
    return votes.groupBy(F.when(F.col("choice") == "X", F.col("x")).otherwise(F.col("y")).alias("checkpoint")).agg(F.count("*").alias("wins"))


def hygiene(s, d):
    """Key figures of the corpus on one row, each aggregated by itself."""
    t = tracks(s, d)
    dup = t.groupBy(F.sha2("text", 256)).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.sum(F.col("n") - 1).alias("duplicate_files"))
    one = t.agg(F.count("*").alias("tracks"), F.count_if(~F.col("bpm").between(70, 160)).alias("out_of_domain"), F.count_if(F.col("bpm").isNull()).alias("without_tempo"))
    return one.join(dup)


def files(s, d):
    rows = tracks(s, d).select("path", F.when(F.col("track_id") % 2 == 0, "backup").otherwise("temp").alias("kind"), F.col("track_id").alias("mtime"), F.col("size_bytes").alias("size"))
    return op.removable(rows, 5, F.lit(100))


_Q = "greatest(0e0, 100e0 - 400e0 * clip - 50e0 * sil - 2e0 * greatest(0e0, abs(lufs + 14e0) - 2e0))"
_DIST = "round(list_dot_product(a.v, a.v) + list_dot_product(b.v, b.v) - 2 * list_dot_product(a.v, b.v), 6)"
_V = "v as (select cast(vec_id as bigint) as id, label % 2 as side, embedding::double[] as v from embeddings)"

QUERIES = {
    "quality_scores": (
        lambda s, d: signal_columns(s, d).select("source_id", op.quality(F.col("clip"), F.col("silence"), F.col("lufs")).alias("q")).select("source_id", "q.score", "q.grade", F.array_join("q.flags", ",").alias("flags")),
        f"""a as (select source_id, (track_id % 50) / 997e0 as clip, (track_id % 40) / 83e0 as sil, lufs from tracks), b as (select *, {_Q} as s from a)
        select source_id, {r('s', 2)} as score, case when s >= 85 then 'A' when s >= 70 then 'B' when s >= 50 then 'C' else 'F' end as grade,
        concat_ws(',', case when clip > 0.01 then 'clipping' end, case when sil > 0.3 then 'silence' end, case when lufs < -20 then 'quiet' end) as flags from b""",
    ),
    "energy_costs": (
        lambda s, d: evaluation(s, d).select("event_id", op.energy_cost(F.concat(F.lit("gen-"), F.element_at(F.array(*[F.lit(x) for x in ("large", "medium", "small", "tiny")]), (F.col("event_id") % 4 + 1).cast("int"))), F.col("seed_no") + 1).alias("c")).select("event_id", "c.params", rounded(F.col("c.kwh") * 1e9, 4).alias("nkwh")),
        f"""a as (select event_id, case event_id % 4 when 0 then 3.3e9 when 1 then 1.5e9 when 2 then 3e8 else 1e9 end as params, seed_no + 1 as n from ev)
        select event_id, params, {r('params * 2e0 * 256 * n * 1e-12 / 3.6e6 * 1e9')} as nkwh from a""",
    ),
    "learning_rate_schedule": (
        lambda s, d: evaluation(s, d).select("event_id", (F.col("event_id") % 1_000).alias("step")).select("event_id", "step", rounded(op.learning_rate(F.col("step"), 1e-4, 100, 1_000) * 1e6, 4).alias("micro")),
        f"""a as (select event_id, event_id % 1000 as step from ev) select event_id, step, {r('case when step < 100 then 1e-4 * (step + 1) / 100 else 1e-4 * 0.5 * (1 + cos(pi() * greatest(0, least(1, (step - 100) / 900e0)))) end * 1e6')} as micro from a""",
    ),
    "syllable_targets": (
        lambda s, d: tracks(s, d).where("bpm is not null").select("source_id", op.syllable_target(F.col("bpm"), F.when(F.col("track_id") % 3 == 0, "fast").when(F.col("track_id") % 3 == 1, "slow").otherwise("medium"), (F.col("track_id") % 6).cast("int")).alias("target")),
        """select source_id, cast(greatest(6, least(16, case when bpm >= 150 then 7 when bpm >= 120 then 9 when bpm >= 90 then 11 else 13 end + case track_id % 3 when 0 then 2 when 1 then -2 else 0 end + track_id % 6 - 3)) as int) as target from tracks where bpm is not null""",
    ),
    "search_grid": (
        lambda s, d: op.grid(tracks(s, d).groupBy("genre").agg(F.count("*").alias("n")), lr=[1, 3, 10], batch=[4, 8], rank=[8, 16, 32]).select("genre", "lr", "batch", "rank", F.ceil(F.col("n") / F.col("batch")).alias("steps")),
        """g as (select genre, count(*) as n from tracks group by genre) select genre, lr, batch, rank, cast(ceil(n / batch) as bigint) as steps from g, (select unnest([1, 3, 10]) as lr), (select unnest([4, 8]) as batch), (select unnest([8, 16, 32]) as rank)""",
    ),
    "provenance_defaults": (
        lambda s, d: op.provenance(tracks(s, d).select("source_id", "musical_key"), musical_key="unknown", license="unknown"),
        "select source_id, musical_key, 'unknown' as license from tracks",
    ),
    "removable_files": (
        files,
        """a as (select path, case when track_id % 2 = 0 then 'backup' else 'temp' end as kind, track_id as m, size_bytes as size from tracks), n as (select *, row_number() over (partition by kind order by m desc, path) as i from a)
        select path, size, case kind when 'backup' then 'old backup' else 'stale' end as why from n where (kind = 'backup' and i > 5) or (kind = 'temp' and m < 100)""",
    ),
    "row_gates": (
        lambda s, d: evaluation(s, d).select("event_id", F.array_join(op.row_gate(F.col("clap_score"), F.col("deviation"), F.when(F.col("genre") == "drill", 0.5).otherwise(0.3), F.lit(0.1)), "; ").alias("reasons")).where("reasons <> ''"),
        """a as (select event_id, concat_ws('; ', case when clap_score < case genre when 'drill' then 0.5e0 else 0.3e0 end then 'clap' end, case when abs(deviation) > 0.1 then 'deviation' end) as reasons from ev) select * from a where reasons <> ''""",
    ),
    "quality_gate": (
        quality_gate,
        """g as (select genre, coalesce(avg(clap_score), 0) as c, coalesce(avg(abs(deviation)), cast('inf' as double)) as v from ev group by genre)
        select bool_and(round(c, 4) >= 0.3 and round(v, 4) <= 0.2) as genres, cast(null as double) as fad, bool_and(round(c, 4) >= 0.3 and round(v, 4) <= 0.2) as passed from g""",
    ),
    "tag_means": (
        tag_means,
        f"""a as (select checkpoint, clap_score, 'genre' as tag, genre as value from ev union all select checkpoint, clap_score, 'section', section from ev)
        select checkpoint, tag, value, {r('avg(clap_score)')} as mean_clap from a where value <> '' group by checkpoint, tag, value""",
    ),
    "unblinded_wins": (winners, "select concat('ck', case when event_id % 3 = 0 then event_id % 2 else event_id % 2 + 2 end) as checkpoint, count(*) as wins from ev group by 1"),
    "hygiene_figures": (
        hygiene,
        """g as (select count(*) as n from tracks group by text)
        select (select count(*) from tracks) as tracks, (select count(*) from tracks where bpm < 70 or bpm > 160) as out_of_domain, (select count(*) from tracks where bpm is null) as without_tempo,
        count(*) filter (n > 1) as duplicate_groups, cast(sum(n - 1) as bigint) as duplicate_files from g""",
    ),
    "split_counts": (lambda s, d: tracks(s, d).groupBy("split").agg(F.count("*").alias("n")), "select split, count(*) as n from tracks group by split"),
    "duration_histogram": (
        lambda s, d: op.histogram(tracks(s, d), "duration", 20),
        """e as (select min(duration) as lo, max(duration) as hi from tracks) select cast(least(19, floor((duration - lo) / ((hi - lo) / 20))) as int) as bin, count(*) as n from tracks, e group by 1""",
    ),
    "curriculum_order": (
        lambda s, d: eo.difficulty(evaluation(s, d)).groupBy("prompt").agg(F.avg("difficulty").alias("m")).select("prompt", rounded("m").alias("difficulty")).orderBy("difficulty", "prompt").limit(50),
        f"""a as (select prompt, round(0.45e0 * coalesce(1e0 - clap_score, 1e0) + 0.35e0 * coalesce(case when deviation is not null then least(abs(deviation) / 0.5e0, 1e0) end, 1e0) + 0.2e0 * (case when status = 'ok' then 0e0 else 1e0 end), 4) as x from ev)
        select prompt, {r('avg(x)')} as difficulty from a group by prompt order by difficulty, prompt limit 50""",
    ),
    "headed_sections": (
        lambda s, d: op.headed_sections(lines(s, d)),
        """a as (select *, nullif(regexp_extract(line, '^\\[([A-Za-z ]+)\\]$', 1), '') as head from lines), b as (select *, coalesce(last_value(head ignore nulls) over (partition by doc_id order by line_no rows unbounded preceding), 'verse') as section from a)
        select doc_id, lower(section) as section, count(*) as n from b where head is null and trim(line) <> '' group by 1, 2""",
    ),
    "merged_notes": (
        lambda s, d: op.merged_notes(evaluation(s, d).select("checkpoint", "event_id", F.when(F.col("event_id") % 9 == 0, None).otherwise(F.floor(F.col("value") / 60)).alias("pitch")), "checkpoint", "event_id", "pitch"),
        """a as (select checkpoint, event_id, case when event_id % 9 = 0 then null else cast(floor(value / 60) as bigint) end as p from ev), b as (select *, case when p is not distinct from lag(p) over w and row_number() over w > 1 then 0 else 1 end as c from a window w as (partition by checkpoint order by event_id)),
        g as (select *, sum(c) over (partition by checkpoint order by event_id) as run from b) select checkpoint, min(event_id) as start, count(*) as n, max(p) as pitch from g where p is not null group by checkpoint, run""",
    ),
    "binned_medians": (
        lambda s, d: evaluation(s, d).groupBy("checkpoint", F.floor(F.col("event_id") / 100).alias("bin")).agg(rounded(F.median("value")).alias("median")),
        f"select checkpoint, cast(floor(event_id / 100) as bigint) as bin, {r('median(value)')} as median from ev group by 1, 2",
    ),
    "transposed_keys": (
        lambda s, d: tracks(s, d).where("musical_key <> ''").groupBy(transposed("musical_key", -2).alias("key")).agg(F.count("*").alias("n")),
        "select case musical_key when 'C major' then 'A# major' when 'A minor' then 'G minor' when 'F# minor' then 'E minor' when 'Eb major' then 'C# major' end as key, count(*) as n from tracks where musical_key <> '' group by 1",
    ),
    "kernel_discrepancy": (
        lambda s, d: op.kernel_discrepancy(table(s, d, "embeddings").where("label % 2 = 0"), table(s, d, "embeddings").where("label % 2 = 1"), "vec_id", "embedding"),
        _V + """, d as (select a.side as x, b.side as y, greatest(0, list_dot_product(a.v, a.v) + list_dot_product(b.v, b.v) - 2 * list_dot_product(a.v, b.v)) as d from v a, v b),
        w as (select median(sqrt(d)) as w from d where x = 0 and y = 1), k as (select x, y, avg(exp(-d / (2 * w * w))) as m from d, w group by 1, 2)
        select round(max(m) filter (x = 0 and y = 0) + max(m) filter (x = 1 and y = 1) - 2 * max(m) filter (x = 0 and y = 1), 6) + 0e0 as mmd from k""",
    ),
    "one_nn_accuracy": (
        lambda s, d: op.one_nn_accuracy(table(s, d, "embeddings").select("vec_id", "embedding", (F.col("label") % 2).cast("long").alias("side")), "vec_id", "embedding", "side"),
        _V + f""", p as (select a.id, a.side, b.side as its, row_number() over (partition by a.id order by {_DIST}, b.id) as i from v a join v b on a.id <> b.id),
        t as (select count(*) as twins from v a join v b on a.side < b.side where list_dot_product(a.v, a.v) + list_dot_product(b.v, b.v) - 2 * list_dot_product(a.v, b.v) < 1e-12)
        select count(*) as n, case when max(twins) > 0 then 0.5e0 else {r('avg(case when side = its then 1e0 else 0e0 end)')} end as accuracy from p, t where i = 1""",
    ),
    "checksum_check": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("h")).exceptAll(table(s, d, "documents").select("doc_id", F.sha2(F.when(F.col("doc_id") % 100 == 7, F.reverse("text")).otherwise(F.col("text")), 256).alias("h"))).select("doc_id"),
        "select doc_id from documents where doc_id % 100 = 7 and reverse(text) <> text",
    ),
}
