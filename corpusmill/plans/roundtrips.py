"""Queries that write the given tables as project files and read them back, each with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.columns import any_separator, multi, number, percent, rounded
from corpusmill.functions.lineage import scratch
from corpusmill.operators import evaluation as eo
from corpusmill.operators import extras as ex
from corpusmill.sources import readers, sinks
from corpusmill.sources.views import evaluation, table, tracks

from .evaluation import r


def results(s, d):
    """Evaluation rows as JSON lines, in two files."""
    path = scratch(s, "results")
    rows = evaluation(s, d).select("checkpoint", "prompt", "section", "genre", "bpm_target", "audio_path", "deviation", "clap_score", "status")
    sinks.json_lines(rows.where("checkpoint <> 'ck0'"), path)
    sinks.json_lines(rows.where("checkpoint = 'ck0'"), path, append=True)
    return readers.eval_results(s, path).select("audio_path", "checkpoint", "section", "status", rounded("clap_score", 6).alias("clap_score"))


def manifest(s, d):
    """Customers as JSON lines of which every seventh is broken."""
    path = scratch(s, "manifest")
    row = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("data/"), "c_mktsegment", F.lit("/x.wav")).alias("path")))
    table(s, d, "customer").select(F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("{broken "), row)).otherwise(row).alias("value")).write.text(path)
    return readers.tolerant_json(s, path, "id long, name string, path string").where(F.contains("path", F.lit("data/B")))


def labelled(s, d):
    """Labels as one CSV in which some tracks come twice and some have no id."""
    path = scratch(s, "labels")
    rows = tracks(s, d).select("track_id", F.when(F.col("track_id") % 31 == 0, "").otherwise(F.col("source_id")).alias("source_id"), "mood", "energy")
    again = rows.where("track_id % 10 = 0").withColumn("mood", F.lit("late|again"))
    ordered = rows.withColumn("nth", F.lit(0)).unionByName(again.withColumn("nth", F.lit(1))).select("source_id", "mood", "energy", "nth", "track_id")
    ordered.repartitionByRange(4, "nth", "track_id").sortWithinPartitions("nth", "track_id").select("source_id", "mood", "energy").write.option("header", True).csv(path)
    return readers.labels(s, path).select("source_id", F.array_join("mood", "+").alias("mood"), "energy")


def songs(s, d):
    """Texts as files named after their artist and title."""
    path = scratch(s, "songs")
    rows = table(s, d, "region").select(F.concat_ws("\n", F.lower("r_name"), F.lit(""), F.concat(F.lit("  "), "r_name", F.lit("  "))).alias("value"), "r_name")
    rows.write.partitionBy("r_name").text(path)
    return readers.song_texts(s, path).select("artist", F.size("lines").alias("n"), F.element_at("lines", 2).alias("second"))


def runs(s, d):
    """Orders as an export of tracked runs, with figures that are none here and there."""
    path = scratch(s, "runs")
    key = F.col("o_orderkey")
    rows = table(s, d, "orders").select(
        F.concat(F.lit("run-"), key, F.lit("-abcdefgh")).alias("run_id"),
        F.concat(F.lit("name "), key).alias("tags.mlflow.runName"),
        F.when(key % 2 == 0, "eval").otherwise("dataset").alias("tags.task"),
        F.when(key % 5 == 0, "n/a").otherwise((key % 90 + 60).cast("string")).alias("metrics.target_bpm"),
        (key % 9 / 8.0).alias("metrics.deviation"),
    )
    rows.write.option("header", True).csv(path)
    return readers.tracking_runs(s, path).select("run_id", "task", "verdict", "target_bpm", rounded("deviation").alias("deviation"), "n_tracks", F.length("name").alias("name_length"))


QUERIES = {
    "read_eval_results": (results, "select audio_path, checkpoint, section, status, round(clap_score, 6) + 0e0 as clap_score from ev"),
    "read_tolerant_manifest": (manifest, "select cast(c_custkey as bigint) as id, c_name as name, concat('data/', c_mktsegment, '/x.wav') as path from customer where c_custkey % 7 <> 0 and c_mktsegment like 'B%'"),
    "read_labels": (
        labelled,
        """a as (select source_id, case when track_id % 10 = 0 then 'late+again' when mood = '' then '' else regexp_replace(mood, ' *[|;,] *', '+', 'g') end as mood, try_cast(energy as double) as energy from tracks where track_id % 31 <> 0) select * from a""",
    ),
    "read_song_texts": (songs, "select 'unknown' as artist, 2 as n, r_name as second from region"),
    "read_tracking_runs": (
        runs,
        f"""select left(concat('run-', o_orderkey, '-abcdefgh'), 8) as run_id, case when o_orderkey % 2 = 0 then 'eval' else 'dataset' end as task, cast(null as varchar) as verdict,
        case when o_orderkey % 5 <> 0 then cast(o_orderkey % 90 + 60 as double) end as target_bpm, {r('o_orderkey % 9 / 8e0')} as deviation, cast(null as double) as n_tracks, cast(length(concat('name ', o_orderkey)) as int) as name_length from orders""",
    ),
    "split_values": (
        lambda s, d: tracks(s, d).select("source_id", F.array_join(multi("mood"), "+").alias("by_one"), F.array_join(any_separator("mood"), "+").alias("by_any")),
        """a as (select source_id, mood, case when contains(mood, '|') then '|' when contains(mood, ';') then ';' else ',' end as sep from tracks)
        select source_id, array_to_string(list_filter(list_transform(string_split(mood, sep), lambda x: trim(x)), lambda x: x <> ''), '+') as by_one,
        array_to_string(list_filter(list_transform(regexp_split_to_array(mood, '[|;,]'), lambda x: trim(x)), lambda x: x <> ''), '+') as by_any from a""",
    ),
    "formatted_figures": (
        lambda s, d: evaluation(s, d).select("event_id", percent("deviation").alias("deviation"), number("bpm_target", 1).alias("bpm")),
        f"""select event_id, case when deviation is null then '—' else format('{{:+.1f}}%', {r('100 * deviation', 1)}) end as deviation, format('{{:.1f}}', bpm_target) as bpm from ev""",
    ),
    "campaign_clips": (
        lambda s, d: evaluation(s, d).drop("section").select(ex.clip([c for c in evaluation(s, d).columns if c != "section"]).alias("c")).select("c.audio_path", "c.checkpoint", "c.section", "c.bpm_target"),
        "select audio_path, checkpoint, cast(null as varchar) as section, bpm_target from ev",
    ),
    "opinion_scores": (
        lambda s, d: evaluation(s, d).select("event_id", rounded(eo.mos_proxy(F.col("clap_score"), F.lit(0.01), F.lit(0.2), F.abs("deviation") * 40)).alias("mos")),
        f"select event_id, {r('0.6e0 * greatest(0e0, least(1e0, coalesce(clap_score, 0e0))) + 0.25e0 * 0.9e0 * coalesce(greatest(0e0, least(1e0, abs(deviation))), 1e0) + 0.15e0 * 0.8e0')} as mos from ev",
    ),
}
