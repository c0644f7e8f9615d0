"""Queries over sounds, nearest events and tables kept by streams, each with the SQL of the same rows where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.asof import asof_join
from corpusmill.functions.columns import rounded
from corpusmill.functions.lineage import scratch
from corpusmill.operators import signals as sg
from corpusmill.operators import sound as so
from corpusmill.sources import pcm
from corpusmill.sources.views import table
from corpusmill.streaming import logs, upserts

from .evaluation import r

#: Samples of one tape, and in a second.
TAPE, RATE = 8_000, 8_000
#: Events as samples: 8,000 in a row are a tape, so that no sound grows with the table.
SAMPLES = f"""select cast(floor(event_id / {TAPE}e0) as bigint) as tape, cast(event_id % {TAPE} as int) as i, event_type,
    (cast(floor(value * 100) as bigint) % 32768) / 32768e0 * case when event_id % 2 = 0 then 1 else -1 end as y from {{events}}"""
_S = SAMPLES.format(events="events")


def samples(s, d):
    return s.sql(SAMPLES, events=table(s, d, "events"))


def tapes(s, d):
    """A row a tape with its samples."""
    return samples(s, d).groupBy("tape").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "y"))), lambda x: x["y"]).alias("y"))


def loudness(s, d):
    """Chunks of 1,000 samples, as a long sound would come."""
    chunks = samples(s, d).groupBy("tape", F.floor(F.col("i") / 1_000).alias("c")).agg(F.min("i").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("i", "y"))), lambda x: x["y"]).alias("y"))
    return so.loudness_lufs(chunks.withColumn("channel", F.lit(0)), "tape", "channel", "first", "y", RATE)


def _loudness_sql():
    """The same filter a sample at a time, by recursion."""
    a, b, c, d = so.weighting(RATE)
    dot = lambda row: " + ".join(f"({x!r}) * x{j + 1}" for j, x in enumerate(map(float, row)) if x)
    state = ", ".join(f"{dot(row)} + ({float(w)!r}) * u as x{i + 1}" for i, (row, w) in enumerate(zip(a, b, strict=True)))
    return f"""s as ({_S}), t as (select tape, list(y order by i) as ys from s group by tape), level as (select unnest(range(1, {TAPE} + 1)) as i)
        select * from (with recursive f as (
            select tape, 0 as i, 0e0 as x1, 0e0 as x2, 0e0 as x3, 0e0 as x4, 0e0 as z from t
            union all
            select tape, i, {state}, {dot(c)} + ({float(d)!r}) * u as z
            from (select f.tape, f.i + 1 as i, x1, x2, x3, x4, t.ys[f.i + 1] as u from f join t on f.tape = t.tape where f.i < len(t.ys)) q),
        h as (select tape, floor((i - 1) / {RATE // 10}e0) as hop, sum(z * z) as p, count(*) as n from f where i > 0 group by 1, 2),
        b as (select tape, sum(p) over w / (4 * {RATE // 10}e0) as z, sum(n) over w as n from h window w as (partition by tape order by hop rows between current row and 3 following)),
        l as (select tape, z, -0.691e0 + 10 * log10(z) as l from b where n = 4 * {RATE // 10} and z > 0),
        g as (select tape, -0.691e0 + 10 * log10(avg(z)) - 10 as gate from l where l > -70 group by tape),
        v as (select l.tape, {r('-0.691e0 + 10 * log10(avg(z))', 2)} as lufs from l join g on l.tape = g.tape where l > -70 and l > gate group by l.tape)
        select t.tape, v.lufs from t left join v on t.tape = v.tape)"""


def chromas(s, d):
    return so.chroma(tapes(s, d), "tape", "y", RATE, 1_024, 256)


def fingerprints(s, d):
    return sg.mean_chroma(chromas(s, d), "tape", "chroma").withColumnRenamed("fingerprint", "chroma")


def tape_keys(s, d):
    best = fingerprints(s, d).select("tape", F.posexplode(sg.keys("chroma")).alias("nth", "best"))
    return best.select("tape", "nth", "best.key", rounded("best.share").alias("share"))


def beat_grids(s, d):
    frames = samples(s, d).select("tape", "i", F.abs("y").alias("flux"))
    return so.beat_grid(frames, "tape", 0.05).select("tape", "beat", "i", "downbeat", rounded("bpm", 2).alias("bpm"))


def changed(s, d):
    """Longer and higher tapes: how long they are, how loud, and whether as long as told."""
    rows = tapes(s, d).select("tape", F.size("y").alias("n"), so.time_stretched("y", F.lit(1.25)).alias("fast"), so.pitch_shifted("y", F.lit(2.0)).alias("high"))
    return rows.select("tape", "n", F.size("fast").alias("n_fast"), F.size("high").alias("n_high"))


def files(s, d):
    """Tapes as WAV files, read back in byte ranges: how many samples, the sums of their whole numbers."""
    folder = scratch(s, "tapes")
    pcm.written(tapes(s, d), "tape", "y", RATE, folder)
    pcm.register(s)
    back = s.read.format("pcm").option("bytes", 6_000).option("frames", 1_000).load(folder)
    name = F.regexp_extract("path", r"([0-9]+)\.wav$", 1).cast("long")
    one = F.aggregate("samples", F.lit(0).cast("long"), lambda a, x: a + F.abs(x * 32_768).cast("long"))
    return back.groupBy(name.alias("tape")).agg(F.sum(F.size("samples")).alias("n"), F.sum(one).alias("total"), F.max("rate").alias("rate"))


def events(s, d, kind):
    return table(s, d, "events").where(F.col("event_type") == kind).select("user_id", "event_id")


def last_views(s, d):
    views = events(s, d, "view").select("user_id", F.col("event_id").alias("view_id"))
    return asof_join(events(s, d, "purchase"), views, ["user_id"], "event_id", "view_id", ["view_id"])


def microtiming(s, d):
    """How far each user's purchases are from the nearest view: the median, and that of the sign."""
    views = events(s, d, "view").select("user_id", F.col("event_id").alias("view_id"))
    near = asof_join(events(s, d, "purchase"), views, ["user_id"], "event_id", "view_id", ["view_id"], "nearest").where("view_id is not null")
    off = F.col("view_id") - F.col("event_id")
    return near.groupBy("user_id").agg(F.count("*").alias("n"), rounded(F.median(F.abs(off))).alias("median_off"), F.count_if(off < 0).alias("n_early"))


def kept_events(s, d):
    """The stream of events as a table of each user's last one."""
    stream = logs.read(s, f"{d}/events.parquet").select("user_id", "event_id", "event_type")
    path = scratch(s, "kept")
    upserts.upsert_stream(stream, path, ["user_id"], "event_id").awaitTermination()
    return upserts.latest(s, path, stream.schema, ["user_id"], "event_id")


_NEAR = """p as (select user_id, event_id from events where event_type = 'purchase'), v as (select user_id, event_id as view_id from events where event_type = 'view')"""

QUERIES = {
    "tape_loudness": (loudness, _loudness_sql()),
    "tape_chroma": (lambda s, d: fingerprints(s, d).select("tape", F.posexplode("chroma").alias("i", "x")).select("tape", "i", rounded("x").alias("x")), None),
    "tape_keys": (tape_keys, None),
    "tape_beats": (beat_grids, None),
    "tape_structure": (lambda s, d: so.structure(so.chroma(tapes(s, d), "tape", "y", RATE, 512, 64), "tape", "chroma", 64 / RATE, seconds=0.25), None),
    "tape_lengths": (changed, f"s as ({_S}), n as (select tape, count(*) as n from s group by tape) select tape, cast(n as int) as n, cast(round_even(n / 1.25e0, 0) as int) as n_fast, cast(n as int) as n_high from n"),
    "tape_files": (files, f"s as ({_S}) select tape, count(*) as n, cast(sum(abs(y * 32768)) as bigint) as total, {RATE} as rate from s group by tape"),
    "last_view_before": (last_views, f"{_NEAR} select p.user_id, p.event_id, v.view_id from p asof left join v on p.user_id = v.user_id and p.event_id >= v.view_id"),
    "nearest_views": (
        microtiming,
        f"""{_NEAR}, b as (select p.user_id, p.event_id, v.view_id as back from p asof left join v on p.user_id = v.user_id and p.event_id >= v.view_id),
        f as (select b.*, v.view_id as ahead from b asof left join v on b.user_id = v.user_id and b.event_id <= v.view_id),
        o as (select user_id, case when ahead is null or event_id - back <= ahead - event_id then back else ahead end - event_id as off from f where back is not null or ahead is not null)
        select user_id, count(*) as n, {r('median(abs(off))')} as median_off, count(*) filter (off < 0) as n_early from o group by user_id""",
    ),
    "last_events_stream": (kept_events, "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by user_id"),
}
