"""Queries that build datasets, each with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.columns import clamp, clock, dashed, rounded
from corpusmill.operators import corpus as co
from corpusmill.operators import datasets as op
from corpusmill.sources.views import evaluation, lines, table, tracks

from .evaluation import r


def segments(s, d):
    """Segments joined with their track's features, the segment's own values first."""
    seg = tracks(s, d).where("track_id % 4 <> 3").select("source_id", F.concat("source_id", F.lit("_seg000")).alias("segment"), F.when(F.col("track_id") % 8 == 0, "override").alias("genre"), "split")
    feats = tracks(s, d).select("source_id", "genre", "mood", "bpm")
    return op.overlaid(seg, feats, "source_id").select("segment", "split", "genre", "bpm", op.described(F.col("genre"), F.col("mood"), F.col("bpm")).alias("text"))


def refresh(s, d):
    files = tracks(s, d).where("track_id % 10 <> 0").select("path", F.col("size_bytes").alias("size"), F.col("track_id").alias("mtime"))
    cache = tracks(s, d).where("track_id % 7 <> 0").select("path", F.col("size_bytes").alias("size"), F.when(F.col("track_id") % 9 == 0, 0).otherwise(F.col("track_id")).alias("mtime"))
    return op.cache_refresh(files, cache)


def matched(s, d):
    seg = tracks(s, d).select(F.concat("song_id", F.when(F.col("track_id") % 2 == 0, "_seg").otherwise("-mix part "), (F.col("track_id") % 5).cast("string")).alias("segment")).distinct()
    return op.fuzzy_match(seg, tracks(s, d).select(F.col("song_id").alias("song")).distinct())


def songs(s, d):
    rows = lines(s, d).select(F.concat(F.lit("The "), "source").alias("artist"), F.concat(F.lit("Song #"), F.col("doc_id").cast("string")).alias("title"), F.col("line_no").alias("pos"), "line")
    return op.songs_from_lines(rows)


def curated(s, d):
    content = F.col("text")
    penalty = co.penalties(tracks(s, d), content, "track_id")
    return op.curation(tracks(s, d).select("track_id", F.col("quality").cast("double").alias("quality"), "lufs").join(penalty, "track_id", "left").withColumn("novelty", F.lit(None).cast("double")))


def beats(s, d):
    """Windows over boundaries every two seconds."""
    n = F.floor(F.col("duration") / 2).cast("int")
    rows = tracks(s, d).where("duration >= 4").select("source_id", "duration", F.posexplode(F.transform(F.sequence(F.lit(0), n), lambda i: i * 2.0)).alias("pos", "at"))
    return op.boundary_windows(rows, "source_id", 8)


def parts(s, d):
    return op.roles(evaluation(s, d).where("value is not null").select("prompt", F.col("event_id").alias("pos"), F.col("value").alias("energy")), "prompt")


def merged(s, d):
    t = table(s, d, "embeddings").select((F.col("vec_id") % 3).cast("int").alias("checkpoint"), F.floor(F.col("vec_id") / 3).cast("int").alias("name"), F.transform("embedding", lambda x: x.cast("double")).alias("values"))
    weights = s.createDataFrame([(0, 1.0), (1, 2.0), (2, 1.0)], "checkpoint int, w double")
    return op.weighted_merge(t, weights)


def changes(s, d):
    v = table(s, d, "embeddings").select(F.floor(F.col("vec_id") / 2).cast("int").alias("name"), (F.col("vec_id") % 2).alias("side"), F.transform("embedding", lambda x: x.cast("double")).alias("values"))
    return op.largest_changes(v.where("side = 0"), v.where("side = 1"), 10)


_CLEAN = "length(line) >= 2 and not regexp_matches(line, 'https?://|www[.]') and not regexp_matches(line, '^[[(].*[])]$') and " + " and ".join(
    f"not contains(lower(line), '{x}')" for x in ("produced by", "prod. by", "embed", "lyrics", "copyright", "all rights reserved")
)

QUERIES = {
    "segment_export": (
        segments,
        """a as (select concat(source_id, '_seg000') as segment, split, coalesce(case when track_id % 8 = 0 then 'override' end, genre) as genre, mood, bpm from tracks where track_id % 4 <> 3)
        select segment, split, genre, bpm, concat_ws(', ', nullif(genre, ''), nullif(mood, ''), case when bpm is not null then concat(cast(cast(bpm as bigint) as varchar), ' bpm') end) as text from a""",
    ),
    "cache_refresh": (
        refresh,
        """a as (select path, case when track_id % 10 = 0 and track_id % 7 = 0 then null when track_id % 10 = 0 then 'pruned' when track_id % 7 = 0 then 'new' when track_id % 9 = 0 and track_id <> 0 then 'changed' else 'kept' end as action from tracks)
        select * from a where action is not null""",
    ),
    "fuzzy_segments": (
        matched,
        """g as (select distinct concat(song_id, case when track_id % 2 = 0 then '_seg' else '-mix part ' end, cast(track_id % 5 as varchar)) as segment, song_id from tracks) select segment, song_id as song from g""",
    ),
    "unlabelled_tracks": (
        lambda s, d: tracks(s, d).select("track_id").join(table(s, d, "labels").select(F.col("doc_id").alias("track_id")), "track_id", "left_anti"),
        "select track_id from tracks where track_id not in (select doc_id from labels)",
    ),
    "songs_from_lines": (
        lambda s, d: songs(s, d).select("artist_id", "song_key", "title", "n_lines", F.sha2(F.array_join("lines", "\n"), 256).alias("digest")),
        f"""a as (select source, doc_id, line_no, trim(line) as line from lines), b as (select * from a where {_CLEAN})
        select concat('the-', source) as artist_id, concat('the-', source, '/song-', doc_id) as song_key, concat('Song #', doc_id) as title, cast(count(*) as int) as n_lines,
        sha256(string_agg(line, chr(10) order by line_no)) as digest from b group by source, doc_id having count(*) >= 4""",
    ),
    "artist_index": (
        lambda s, d: songs(s, d).groupBy("artist_id").agg(F.count("*").alias("songs"), F.sum("n_lines").alias("lines")),
        f"""a as (select source, doc_id, trim(line) as line from lines), b as (select source, doc_id, count(*) as n from a where {_CLEAN} group by source, doc_id having count(*) >= 4)
        select concat('the-', source) as artist_id, count(*) as songs, cast(sum(n) as bigint) as lines from b group by source""",
    ),
    "upserted_titles": (
        lambda s, d: op.upserted(tracks(s, d).where("track_id % 2 = 0").select(F.sha2("text", 256).alias("k")), tracks(s, d).where("track_id % 2 = 1").select(F.sha2("text", 256).alias("k"), "track_id"), "k", "track_id").select("track_id"),
        "select min(track_id) as track_id from tracks where track_id % 2 = 1 and text not in (select text from tracks where track_id % 2 = 0) group by text",
    ),
    "curation_scores": (
        curated,
        f"""a as (select track_id, quality, lufs, case when count(*) over (partition by text) > 1 and row_number() over (partition by text order by track_id) > 1 then 0.25e0 else 0e0 end as p from tracks)
        select track_id, {r('100e0 * greatest(0e0, least(1e0, 0.5e0 * coalesce(quality, 0.6e0) + 0.3e0 * (1e0 - least(1e0, abs(lufs + 14e0) / 20e0)) + 0.2e0 * 0.5e0 - p))', 2)} as score from a""",
    ),
    "blind_pairs": (
        lambda s, d: op.blind_pairs(evaluation(s, d), 5).select("prompt", F.least("x", "y").alias("one"), F.greatest("x", "y").alias("two")),
        """f as (select prompt, checkpoint, min(event_id) as t from ev group by prompt, checkpoint), n as (select *, row_number() over (partition by prompt order by t) as i from f)
        select prompt, min(checkpoint) as one, max(checkpoint) as two from n where i <= 2 group by prompt having count(*) = 2""",
    ),
    "boundary_windows": (
        beats,
        """b as (select source_id, duration, cast(floor(duration / 2) as int) as n from tracks where duration >= 4), p as (select source_id, duration, n, unnest(range(0, n + 1)) as pos from b)
        select source_id, pos * 2e0 as start, case when pos + 8 <= n then (pos + 8) * 2e0 else duration end as "end" from p where pos % 8 = 0 and pos < n""",
    ),
    "event_density": (
        lambda s, d: op.density(evaluation(s, d), "checkpoint", "event_id", 250.0),
        """b as (select checkpoint, cast(floor(event_id / 250.0) as int) as bin, count(*) as n from ev group by 1, 2), m as (select checkpoint, unnest(range(0, max(bin) + 1)) as bin from b group by checkpoint)
        select m.checkpoint, cast(m.bin as int) as bin, coalesce(n, 0) as n from m left join b on m.checkpoint = b.checkpoint and m.bin = b.bin""",
    ),
    "part_roles": (
        parts,
        """a as (select prompt, event_id as pos, value as energy, row_number() over (partition by prompt order by event_id) as i, row_number() over (partition by prompt order by event_id desc) as j, avg(value) over (partition by prompt) as m from ev where value is not null),
        l as (select *, first_value(case when i > 1 and j > 1 then pos end) over (partition by prompt order by case when i > 1 and j > 1 then 0 else 1 end, energy desc, pos rows between unbounded preceding and unbounded following) as loud from a),
        q as (select *, min(case when i > 1 and j > 1 and energy < m and pos <> loud then pos end) over (partition by prompt) as quiet from l)
        select prompt, pos, case when i = 1 then 'intro' when j = 1 then 'outro' when pos = loud then 'chorus' when pos = quiet then 'bridge' else 'verse' end as role from q""",
    ),
    "pruned_checkpoints": (
        lambda s, d: op.kept_newest(evaluation(s, d), "checkpoint", F.coalesce("clap_score", F.lit(0.0)), 3).where("action = 'keep'"),
        """n as (select checkpoint, event_id, row_number() over (partition by checkpoint order by coalesce(clap_score, 0) desc, event_id) as i from ev) select checkpoint, event_id, 'keep' as action from n where i <= 3""",
    ),
    "learning_rates": (
        lambda s, d: op.steepest(evaluation(s, d).select("checkpoint", F.col("event_id").alias("step"), F.col("value").alias("loss"), (F.lit(1e-6) * (F.col("event_id") + 1)).alias("lr")), "checkpoint"),
        """a as (select checkpoint, event_id as step, value as loss, ln(1e-6 * (event_id + 1)) as x from ev), b as (select *, (loss - lag(loss) over w) / nullif(x - lag(x) over w, 0) as slope from a window w as (partition by checkpoint order by step))
        select checkpoint, (list(step order by loss, step))[1] as best_step, (list(step order by coalesce(slope, cast('inf' as double)), step))[1] as steepest_step from b group by checkpoint""",
    ),
    "lineage_nodes": (
        lambda s, d: op.lineage_nodes(evaluation(s, d).select(F.col("checkpoint").alias("parent"), F.col("prompt").alias("child"))),
        "select checkpoint as node from ev union select prompt from ev",
    ),
    "prompt_texts": (
        lambda s, d: evaluation(s, d).select("event_id", op.prompt_text(F.col("section"), F.col("genre"), F.col("bpm_target"), F.lit("A minor"), F.col("clap_score")).alias("prompt_text")),
        """select event_id, array_to_string(list_filter([genre, section, case when clap_score >= 0.75 then 'high energy' when clap_score >= 0.4 then 'moderate energy' when clap_score is not null then 'low energy' else '' end,
        case when bpm_target > 0 then concat(cast(cast(bpm_target as bigint) as varchar), ' BPM') else '' end, 'A minor'], lambda x: x <> ''), ', ') as prompt_text from ev""",
    ),
    "overridden_prompts": (
        lambda s, d: evaluation(s, d).select("event_id", op.overridden(F.concat_ws(" ", "genre", F.lit("at"), F.col("bpm_target").cast("int").cast("string"), F.lit("bpm in F# Minor now")), 99, "C major").alias("p")),
        "select event_id, concat(genre, ' at 99 BPM in C major now') as p from ev",
    ),
    "duration_adherence": (
        lambda s, d: tracks(s, d).select("source_id", rounded(clamp(1.0 - F.abs(F.col("duration") - 200.0) / 200.0 / 0.3)).alias("adherence"), clock("duration").alias("shown")),
        f"""a as (select source_id, duration, cast(round(duration, 0) as bigint) as s from tracks)
        select source_id, {r('greatest(0e0, least(1e0, 1e0 - abs(duration - 200e0) / 200e0 / 0.3e0))')} as adherence,
        case when s // 3600 > 0 then format('{{}}:{{:02d}}:{{:02d}}', s // 3600, s // 60 % 60, s % 60) else format('{{}}:{{:02d}}', s // 60, s % 60) end as shown from a""",
    ),
    "merged_weights": (
        merged,
        """t as (select cast(vec_id % 3 as int) as c, cast(vec_id // 3 as int) as name, unnest(range(64)) as i, unnest(embedding::double[]) as x from embeddings where vec_id < 3 * ((select count(*) from embeddings) // 3))
        select name, cast(i as int) as i, round(sum(x * case c when 1 then 2e0 else 1e0 end) / 4e0, 6) + 0e0 as value from t group by name, i""",
    ),
    "largest_changes": (
        changes,
        """p as (select cast(a.vec_id // 2 as int) as name, list_transform(list_zip(a.embedding::double[], b.embedding::double[]), lambda z: abs(z[1] - z[2])) as g from embeddings a join embeddings b on a.vec_id % 2 = 0 and b.vec_id = a.vec_id + 1)
        select name, round(list_max(g), 6) + 0e0 as max_change, round(list_sum(g) / len(g), 6) + 0e0 as mean_change from p order by max_change desc, name limit 10""",
    ),
    "artist_slugs": (
        lambda s, d: table(s, d, "customer").select("c_custkey", dashed(F.concat_ws(" & ", "c_name", "c_mktsegment")).alias("slug")),
        "select c_custkey, regexp_replace(regexp_replace(lower(concat(c_name, ' & ', c_mktsegment)), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') as slug from customer",
    ),
    "stratum_sizes": (
        lambda s, d: tracks(s, d).groupBy(F.coalesce(F.concat((F.bround(F.col("bpm") / 10) * 10).cast("int").cast("string"), F.lit("s")), F.lit("unknown")).alias("stratum")).agg(F.count("*").alias("n")),
        "select coalesce(cast(cast(round_even(bpm / 10, 0) * 10 as int) as varchar) || 's', 'unknown') as stratum, count(*) as n from tracks group by 1",
    ),
}
