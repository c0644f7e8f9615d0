"""Queries through files, lookups and kernels that the other modules leave out, each with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.columns import rounded
from corpusmill.functions.lineage import scratch
from corpusmill.operators import corpus as co
from corpusmill.operators import datasets as da
from corpusmill.operators import frames as fr
from corpusmill.operators import signals as sg
from corpusmill.operators import studio as st
from corpusmill.sources import pcm, readers, sinks
from corpusmill.sources.views import evaluation, lines, table, tracks
from corpusmill.streaming import logs

from .datasets import _CLEAN
from .evaluation import r
from .sounds import _S, RATE, samples, tapes
from .studio import _FR, requests, singers, sound


def wav_headers(s, d):
    folder = scratch(s, "headers")
    pcm.written(tapes(s, d), "tape", "y", RATE, folder)
    found = readers.wav_headers(s, folder)
    return found.select(F.regexp_extract("path", r"([0-9]+)\.wav$", 1).cast("long").alias("tape"), "sample_rate", "channels", "bits", "frames", rounded("duration").alias("duration"), "error")


def checksums(s, d):
    """A text file of each nation's customers; their hashes as a list, read back."""
    folder, kept = scratch(s, "files"), scratch(s, "sums")
    rows = table(s, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("value"), "c_custkey")
    rows.repartition("k").sortWithinPartitions("k", "c_custkey").select("k", "value").write.partitionBy("k").text(folder)
    sinks.checksums(readers.file_hashes(s, folder, "*.txt"), kept)
    back = s.read.text(kept).select(F.split("value", "  ").alias("p"))
    return back.select(F.regexp_extract(F.element_at("p", 2), r"k=([0-9]+)", 1).cast("long").alias("nation"), F.element_at("p", 1).alias("sha256"))


def results_csv(s, d):
    path = scratch(s, "csv")
    sinks.csv(evaluation(s, d), path, ["event_id", "checkpoint", "section", "bpm_target", "not_there"])
    back = s.read.option("header", True).csv(path)
    return back.select(F.col("event_id").cast("long").alias("event_id"), "checkpoint", "section", F.col("bpm_target").cast("double").alias("bpm_target"), "not_there")


def split_folders(s, d):
    path = scratch(s, "splits")
    sinks.splits(tracks(s, d).select("track_id", "genre", "split"), path)
    sinks.splits(tracks(s, d).where("track_id % 2 = 0").select("track_id", "genre", "split"), path)  # replaces the first
    return s.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), F.min("track_id").alias("first"), F.max("track_id").alias("last"))


def overrides(s, d):
    """Measured features with labels by hand over them, which are given for some tracks and fields only."""
    feats = tracks(s, d).select("source_id", "genre", "bpm", "path")
    manual = tracks(s, d).where("track_id % 3 = 0").select("source_id", F.when(F.col("track_id") % 2 == 0, "by hand").alias("genre"), F.lit(100.0).alias("bpm"), F.lit("note").alias("note"))
    over = da.overlaid(manual, feats.drop("path"), "source_id")
    return feats.select("source_id", "path").join(over, "source_id", "left").select("source_id", "path", "genre", "bpm", "note")


def line_songs(s, d):
    """Lines as a CSV of one line a row, read back as songs."""
    path = scratch(s, "line-songs")
    rows = lines(s, d).select(F.concat(F.lit("The "), "source").alias("artist"), F.concat(F.lit("Song #"), F.col("doc_id").cast("string")).alias("song"), F.col("line").alias("lyric"), "doc_id", "line_no")
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "line_no").select("artist", "song", "lyric").write.option("header", True).csv(path)
    return da.songs_from_lines(readers.rap_csv(s, path)).select("artist_id", "song_key", "title", "n_lines", F.sha2(F.array_join("lines", "\n"), 256).alias("digest"))


def imports(s, d):
    """One folder of songs as text files, JSON, CSV of songs and CSV of lines."""
    path = scratch(s, "imports")
    text = F.concat_ws("\n", "n_name", F.lit(""), F.concat(F.lit(" "), "n_name"))
    table(s, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("title"), F.col("n_regionkey").cast("string").alias("artist_name"), text.alias("lyrics")).write.json(f"{path}/json")
    table(s, d, "nation").where("n_nationkey % 2 = 1").select(F.col("n_name").alias("song"), F.lit("").alias("artist"), text.alias("text")).write.option("header", True).csv(f"{path}/csv")
    rows = table(s, d, "customer").select(F.col("c_mktsegment").alias("artist"), F.col("c_nationkey").cast("string").alias("song"), F.col("c_name").alias("lyric"), "c_custkey")
    rows.repartition("artist", "song").sortWithinPartitions("artist", "song", "c_custkey").select("artist", "song", "lyric").write.option("header", True).csv(f"{path}/lines")
    table(s, d, "region").select(F.col("r_name").alias("value")).repartition(5).write.text(f"{path}/txt")
    found = readers.imported_songs(s, path).where("artist <> 'unknown' or title not like 'part-%'")
    return found.select("artist", "title", F.array_join("lines", "/").alias("lines"))


def found_artists(s, d):
    return st.lookup(requests(s, d), "artist", singers(s, d), F.array("id"), F.array("name"), F.coalesce("aliases", F.array())).select("c_custkey", F.col("entry.id").alias("found"))


def artist_splits(s, d):
    rows = co.artist_split(table(s, d, "documents").select("source", "doc_id"), "source", "doc_id", 0.1, 0.05, 42)
    return rows.groupBy("source", "split").agg(F.count("*").alias("n"))


def stops(s, d):
    """The stop rule over the stream of events, by their type."""
    rows = logs.read(s, f"{d}/events.parquet").select("event_type", "event_id", F.col("value").cast("double").alias("value"))
    return logs.drained(logs.early_stop(rows, "event_type", "value", "event_id"), scratch(s, "stops"), "update", ["event_type"])


def shapes(s, d):
    frames = sound(s, d).withColumns({"rolloff": F.col("centroid") * 1.5, "bandwidth": F.col("centroid") / 2, "flatness": F.col("flux") / 101})
    return fr.spectral_shape(frames, "user_id")


def stems(s, d):
    rows = samples(s, d).groupBy("tape", "event_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "y"))), lambda x: x["y"]).alias("y"))
    mix = fr.mixed(rows, "tape", "event_type", "y", {"view": 0.5, "purchase": 2.0}, ("click",))
    return mix.select("tape", F.posexplode("y").alias("i", "y")).select("tape", "i", rounded("y", 6).alias("y"))


def kernel(row):
    """A kernel that some rows break."""
    return {"ratio": round(row["bpm"] / (row["track_id"] % 7), 4), "half": row["bpm"] / 2}


def analyses(s, d):
    rows = tracks(s, d).where("bpm is not null").select("track_id", "bpm")
    return fr.analysed(rows, kernel, "track_id long", "ratio double, half double").select("track_id", rounded("ratio").alias("ratio"), rounded("half").alias("half"), F.col("error").isNotNull().alias("failed"))


def measures(s, d):
    return tapes(s, d).select("tape", sg.measured("y").alias("m")).select("tape", *[rounded(f"m.{c}", 6).alias(c) for c in ("peak", "rms", "rms_db", "dc", "clipping_ratio", "silence_ratio", "snr_db", "clicks")])


QUERIES = {
    "wav_file_headers": (wav_headers, f"s as ({_S}) select tape, {RATE} as sample_rate, 1 as channels, 16 as bits, count(*) as frames, {r(f'count(*) / {RATE}e0')} as duration, cast(null as varchar) as error from s group by tape"),
    "file_checksums": (checksums, "select cast(c_nationkey as bigint) as nation, sha256(concat(string_agg(c_name, chr(10) order by c_custkey), chr(10))) as sha256 from customer group by 1"),
    "results_as_csv": (results_csv, "select cast(event_id as bigint) as event_id, checkpoint, nullif(section, '') as section, bpm_target, cast(null as varchar) as not_there from ev"),
    "split_folders": (split_folders, "select split, count(*) as n, min(track_id) as first, max(track_id) as last from tracks where track_id % 2 = 0 group by split"),
    "feature_overrides": (
        overrides,
        """select source_id, path, case when track_id % 3 = 0 then case when track_id % 2 = 0 then 'by hand' else genre end end as genre, case when track_id % 3 = 0 then 100e0 end as bpm,
        case when track_id % 3 = 0 then 'note' end as note from tracks""",
    ),
    "songs_from_line_table": (
        line_songs,
        f"""a as (select source, doc_id, line_no, trim(line) as line from lines), b as (select * from a where {_CLEAN})
        select concat('the-', source) as artist_id, concat('the-', source, '/song-', doc_id) as song_key, concat('Song #', doc_id) as title, cast(count(*) as int) as n_lines,
        sha256(string_agg(line, chr(10) order by line_no)) as digest from b group by source, doc_id having count(*) >= 4""",
    ),
    "imported_songs": (
        imports,
        """select cast(n_regionkey as varchar) as artist, n_name as title, concat(n_name, '/', n_name) as lines from nation where n_nationkey % 2 = 0
        union all select 'unknown', n_name, concat(n_name, '/', n_name) from nation where n_nationkey % 2 = 1
        union all select c_mktsegment, cast(c_nationkey as varchar), string_agg(c_name, '/' order by c_custkey) from customer group by 1, 2""",
    ),
    "artist_lookup": (
        found_artists,
        """select c_custkey, case when c_custkey % 4 < 3 then concat('a', c_nationkey) end as found from customer join nation on c_nationkey = n_nationkey""",
    ),
    "artist_split_sizes": (
        artist_splits,
        """a as (select source, count(*) as n from documents group by source), b as (select source, n, case when n < 10 then 0 else greatest(1, round_even(n * 0.05, 0)) end as t, case when n < 10 then 0 else greatest(1, round_even(n * 0.1, 0)) end as v from a),
        c as (select source, 'test' as split, cast(t as bigint) as n from b union all select source, 'val', cast(v as bigint) from b union all select source, 'train', cast(n - t - v as bigint) from b) select * from c where n > 0""",
    ),
    "stop_rule_stream": (
        stops,
        """a as (select event_type, value, row_number() over (partition by event_type order by event_id) as i, count(*) over (partition by event_type) as n, max(value) over (partition by event_type) as best from events where value is not null)
        select event_type, max(best) as best, max(n) - min(i) as since_best, max(n) - min(i) >= 3 as stop from a where value = best group by event_type""",
    ),
    "spectral_shapes": (
        shapes,
        f"""f as ({_FR}) select user_id, {r('avg(centroid)', 1)} as centroid, {r('avg(centroid * 1.5e0)', 1)} as rolloff, {r('avg(centroid / 2)', 1)} as bandwidth, {r('avg(flux / 101)')} as flatness,
        {r('max(peak) / (sqrt(avg(rms * rms)) + 1e-12)', 2)} as crest_factor, {r('avg(rms)', 6)} as rms_mean from f group by user_id""",
    ),
    "stem_mixes": (
        stems,
        f"""s as ({_S}), p as (select tape, event_type, y, row_number() over (partition by tape, event_type order by i) - 1 as k from s)
        select tape, cast(k as int) as i, {r("sum(case event_type when 'view' then 0.5e0 when 'purchase' then 2e0 when 'click' then 0e0 else 1e0 end * y)", 6)} as y from p group by tape, k""",
    ),
    "clip_analyses": (
        analyses,
        f"""select track_id, case when track_id % 7 > 0 then {r('round(bpm / (track_id % 7), 4)')} end as ratio, case when track_id % 7 > 0 then {r('bpm / 2')} end as half, track_id % 7 = 0 as failed from tracks where bpm is not null""",
    ),
    "tape_measures": (
        measures,
        f"""s as ({_S}), a as (select tape, count(*) as n, max(abs(y)) as peak, sqrt(avg(y * y)) as rms, avg(y) as dc, avg(case when abs(y) >= 0.999 then 1e0 else 0e0 end) as clip from s group by tape),
        f as (select tape, sqrt(avg(y * y)) as level from s join a using (tape) where i < 512 * greatest(1, floor(n / 512)) or n < 512 group by tape, case when n < 512 then 0 else floor(i / 512) end),
        q as (select tape, quantile_cont(level, 0.1) as low, quantile_cont(level, 0.9) as high, avg(case when level < 0.01 then 1e0 else 0e0 end) as silent from f group by tape),
        d as (select tape, abs(y - lag(y) over (partition by tape order by i)) as step from s), m as (select tape, median(step) as usual from d where step is not null group by tape),
        c as (select d.tape, cast(count(*) filter (usual > 0 and step > 20 * usual) as double) as clicks from d join m on d.tape = m.tape group by d.tape)
        select tape, {r('peak', 6)} as peak, {r('rms', 6)} as rms, {r('20 * log10(greatest(rms, 1e-10))', 6)} as rms_db, {r('dc', 6)} as dc, {r('clip', 6)} as clipping_ratio, {r('silent', 6)} as silence_ratio,
        case when low > 0 then {r('20 * log10(high / low)', 6)} end as snr_db, {r('clicks', 6)} as clicks from a join q using (tape) join c using (tape)""",
    ),
}
