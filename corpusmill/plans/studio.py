"""Queries over recipes, songs, checkpoints and sound frames, each with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions.columns import rounded
from corpusmill.functions.lineage import ranged
from corpusmill.operators import frames as fr
from corpusmill.operators import signals as sg
from corpusmill.operators import studio as st
from corpusmill.sources.views import evaluation, lines, table, tracks

from .corpus import SYLLABLES
from .evaluation import r

#: Events as frames of sounds: each user's of 5,000 events in a row are one, so that no sound grows with the table.
FRAMES = """select user_id, event_id, cast(row_number() over (partition by user_id order by event_id) - 1 as int) as i, value / 490e0 as rms, value / 245e0 as peak,
    cast((event_id * 37) % 4000 as double) as centroid, cast((event_id * 13) % 101 as double) as flux, value
    from (select cast(user_id as bigint) * 1000000 + cast(floor(event_id / 5000e0) as bigint) as user_id, event_id, value from {events})"""
_FR = FRAMES.format(events="events")


def sound(s, d):
    return s.sql(FRAMES, events=table(s, d, "events"))


def spectra(s, d):
    return sound(s, d).select("user_id", (F.col("i") * 100.0 + 50.0).alias("hz"), F.col("value").alias("magnitude"))


def singers(s, d):
    name = F.col("n_name")
    return table(s, d, "nation").select(
        F.concat(F.lit("a"), "n_nationkey").alias("id"), name.alias("name"), F.array(F.concat(F.lit("dj "), name)).alias("aliases"),
        F.when(F.col("n_nationkey") % 3 == 0, F.array()).otherwise(F.array(F.concat(F.lit("life in "), F.lower(name)))).cast("array<string>").alias("topics"),
        (F.col("n_nationkey") + 60).alias("bpm_low"), (F.col("n_nationkey") + 90).alias("bpm_high"))


def styles(s, d):
    return table(s, d, "region").select(F.col("r_name").alias("name"), F.array(F.concat(F.lit("mood "), "r_regionkey")).alias("moods"), F.array(F.lit("roads")).alias("topics"), F.lit(0.5).alias("energy"), F.lit(3).alias("density"))


def requests(s, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    rows = table(s, d, "customer").join(table(s, d, "nation"), n == F.col("n_nationkey")).join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    artist = F.when(k % 4 == 0, F.concat(F.lit(" A"), n)).when(k % 4 == 1, F.upper("n_name")).when(k % 4 == 2, F.concat(F.lit("DJ "), "n_name"))
    return rows.select("c_custkey", artist.alias("artist"), F.when(k % 3 > 0, F.lower("r_name")).otherwise("none").alias("genre"), F.when(k % 5 == 0, " Calm ").alias("mood"), F.when(k % 7 == 0, "").when(k % 7 == 1, "Rain").alias("topic"))


def tried(batches):
    """A pluggable scorer: what a checkpoint's mean score leaves at a guidance, every third seed being lucky."""
    for pdf in batches:
        score = pdf["clap"] * pdf["guidance"] / (pdf["guidance"] + 1) + 0.1 * (pdf["seed"] % 3 == 0)
        yield pdf[["prompt", "checkpoint", "guidance", "seed"]].assign(score=score.round(6))


def checkpoints(s, d):
    o = table(s, d, "orders")
    folder = F.concat(F.lit("checkpoints/c"), F.col("o_custkey").cast("string"))
    files = o.select(F.concat(folder, F.lit("/f"), "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, ".safetensors").otherwise(".txt")).alias("path"), F.col("o_totalprice").cast("long").alias("length"), F.col("o_orderdate").alias("modified"))
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('{"model_type": "small", "hidden_size": '), "c_custkey", F.lit(', "num_hidden_layers": 4}'))).otherwise("{broken")
    configs = table(s, d, "customer").select(F.concat(F.lit("checkpoints/c"), "c_custkey", F.lit("/config.json")).alias("path"), text.alias("text"))
    return st.checkpoint_registry(files, configs).select("name", "weight_files", "size_mb", "model_type", "n_params")


def contexts(s, d):
    part = F.struct(F.col("section").alias("role"), F.lit(None).cast("string").alias("label"), F.coalesce("clap_score", F.lit(0.0)).alias("energy"))
    song = F.floor(F.col("event_id") / 20).alias("song")
    by = evaluation(s, d).groupBy(song).agg(F.collect_list(part).alias("segments"), F.max("bpm_target").alias("bpm"))  # 20 a song
    record = F.struct(F.struct("segments").alias("structure"), F.struct(F.when(F.col("bpm") > 100, F.col("bpm")).alias("tempo")).alias("beat_grid"), F.struct(F.lit(None).cast("string").alias("key")).alias("key"), F.struct(F.lit("swung").alias("feel")).alias("swing"))
    from corpusmill.functions.columns import rounded

    rows = by.select("song", st.beat_context(record).alias("x"))
    return rows.select("song", "x.bpm", "x.key", "x.swing", rounded("x.energy").alias("energy"), F.aggregate("x.structure", F.lit(0), lambda a, p: a + p["bars"]).alias("bars"))


def verses(s, d):
    """Sixteen bars for each customer, with the rhymes and turns of phrase of the documents' own lines."""
    schemes = F.element_at(F.array(*[F.lit(x) for x in ("AABB", "ABAB", "AAAA")]), (F.col("c_custkey") % 3 + 1).cast("int"))
    asked = table(s, d, "customer").select("c_custkey", F.lit(16).alias("bars"), (F.lit(6) + F.col("c_custkey") % 6).alias("target"), schemes.alias("scheme"), F.when(F.col("c_custkey") % 2 == 0, "listen,").alias("opener"))
    said = lines(s, d)
    return st.verses(asked, "c_custkey", st.mined_templates(said, "line"), st.mined_banks(said, "line"))


def sheets(s, d):
    lines = F.split("text", r"\n")
    none = F.lit(None).cast("string")
    part = F.struct(F.coalesce("section", F.lit("verse")).alias("role"), F.lit(8).alias("bars"), F.lit("steady").alias("flow"), F.lit("medium").alias("cadence"), none.alias("artist"), F.lit("AABB").alias("rhyme"), F.array(F.lit("yeah")).alias("ad_libs"), lines.alias("lines"))
    song = F.struct(F.col("song_id").alias("artist"), F.lit("dark").alias("mood"), F.lit("roads").alias("topic"), F.col("bpm"), F.col("musical_key").alias("key"), F.lit("straight").alias("swing"), F.col("track_id").alias("seed"), F.array(part).alias("sections"))
    return tracks(s, d).where("text is not null").select("track_id", st.sheet(song).alias("sheet"))


def diffs(s, d):
    """Each text against the one before it of its source; which one that is, is found on ids alone, by ranges of them."""
    docs = table(s, d, "documents")
    ids = ranged(docs.select("source", "doc_id"), "doc_id")
    last = ids.groupBy("source", "cell").agg(F.max("doc_id").alias("last"))
    earlier = last.select(F.col("source").alias("of"), F.col("cell").alias("at"), F.lag("last").over(Window.partitionBy("source").orderBy("cell")).alias("earlier"))  # a row a range
    near = ids.withColumn("near", F.lag("doc_id").over(Window.partitionBy("source", "cell").orderBy("doc_id")))
    both = near.join(earlier, F.col("source").eqNullSafe(F.col("of")) & (F.col("cell") == F.col("at")))
    pairs = both.select("doc_id", F.coalesce("near", "earlier").alias("was"))
    rows = docs.select("doc_id", "text").join(pairs, "doc_id").join(docs.select(F.col("doc_id").alias("was"), F.col("text").alias("before")), "was", "left")
    return rows.select("doc_id", F.size(st.text_diff("before", "text", F.col("was").cast("string"), F.col("doc_id").cast("string"))).alias("n_lines"))


def magnitudes(s, d):
    return table(s, d, "embeddings").select("label", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("bands"))


def kept_distance(s, d):
    rows = table(s, d, "embeddings")
    return st.distance_from_moments(st.reference_moments(rows.where("label < 5"), "embedding"), rows.where("label >= 5"), "embedding")


def swings(s, d):
    by = sound(s, d).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "flux"))), lambda f: f["flux"]).alias("onset"))
    rows = by.withColumn("beats", F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), F.size("onset") - 1), F.lit(4)), lambda i: i * 0.125)).withColumn("bpm", F.lit(120.0))
    return fr.swing(rows, "user_id", "onset", "beats", "bpm", 0.125)


#: Keys and artifacts of vectors, in SQL.
_KEYS = f"""a as (select vec_id, list_transform(embedding[1:12]::double[], lambda x: abs(x)) as c from embeddings), b as (select vec_id, c, list_avg(c) as m, sqrt(list_avg(list_transform(c, lambda x: (x - list_avg(c)) * (x - list_avg(c))))) as s from a),
    u as (select vec_id, list_transform(c, lambda x: case when s > 0 then (x - m) / s else 0e0 end) as u from b), k as (select * from (values {', '.join(f"({i}, '{n} {mode}', {[float(x) for x in sg._PROFILES[i]]}::double[])" for i, (mode, n) in enumerate((mode, n) for mode in ('major', 'minor') for n in fr.NOTES))}) t(i, key, p)),
    e as (select vec_id, i, key, exp(6 * (list_dot_product(u, p) / 12 - 1)) as e from u, k), n as (select vec_id, key, e / sum(e) over (partition by vec_id) as share, row_number() over (partition by vec_id order by round(e, 13) desc, i) as nth from e)
    select vec_id, cast(nth - 1 as int) as nth, key, round(share, 4) as share from n where nth <= 3"""
_ARTIFACTS = f"""a as (select vec_id, embedding::double[] as y from embeddings), d as (select *, list_transform(range(1, len(y)), lambda i: abs(y[i + 1] - y[i])) as step,
    list_transform(range(0, 17), lambda j: sqrt(list_sum(list_transform(range(4 * j - 7, 4 * j + 9), lambda i: case when i >= 1 and i <= 64 then y[i] * y[i] else 0e0 end)) / 16)) as level from a),
    q as (select vec_id, least(1000, len(list_filter(step, lambda x: x > 20 * (list_median(step) + 1e-12)))) as clicks, list_avg(list_transform(y, lambda x: case when abs(x) >= 0.999 then 1e0 else 0e0 end)) as clip, abs(list_avg(y)) as dc,
        array_to_string(list_transform(level, lambda x: case when 20 * log10(greatest(x, 1e-5) / greatest(list_max(level), 1e-5)) < -50 then 's' else '-' end), '') as silent from d),
    f as (select *, len(list_filter(string_split_regex(silent, '-+'), lambda x: length(x) between 2 and 20)) as dropouts from q)
    select vec_id, cast(clicks as bigint) as clicks, {r('clip', 5)} as clipping_ratio, {r('dc', 5)} as dc_offset, cast(dropouts as bigint) as dropouts, clicks = 0 and clip < 0.001 and dc < 0.01 and dropouts = 0 as clean from f"""


QUERIES = {
    "prompt_variants": (lambda s, d: evaluation(s, d).select("prompt", "genre").distinct().select("prompt", "genre", st.variants(F.concat_ws(", ", F.concat(F.lit("slow "), "genre"), F.concat(F.lit("drums and "), "prompt")), ["slow", "calm", "fast"]).alias("v")).select("prompt", "genre", F.array_join("v", " | ").alias("variants")), None),
    "trap_prompts": (
        lambda s, d: st.prompt_set(table(s, d, "nation").select("n_nationkey", F.col("n_name").alias("description")), "n_nationkey", "adv", "adversarial", 1000, 10),
        "select concat('adv_', lpad(cast(n_nationkey as varchar), 2, '0')) as id, n_name as description, 0.5e0 as energy, n_nationkey + 1000 as seed, true as adversarial from nation where n_nationkey < 10",
    ),
    "paraphrase_prompts": (
        lambda s, d: st.paraphrases(table(s, d, "nation").select("n_nationkey", F.array(F.lower("n_name"), F.upper("n_name")).alias("says")), "n_nationkey", "says", 3000),
        """select concat('para_', lpad(cast(n_nationkey as varchar), 2, '0'), '_', k) as id, concat('para_', lpad(cast(n_nationkey as varchar), 2, '0')) as intent, case k when 0 then lower(n_name) else upper(n_name) end as description,
        3000 + n_nationkey * 10 + k as seed, true as paraphrase from nation, (values (0), (1)) t(k)""",
    ),
    "guidance_sweep": (
        lambda s, d: st.sweep(
            evaluation(s, d).where("clap_score is not null").groupBy("prompt", "checkpoint").agg(rounded(F.avg("clap_score")).alias("clap")),
            [1.0, 3.0, 5.0], [1, 2, 3, 4], tried, "prompt string, checkpoint string, guidance double, seed int, score double",
        ).select("prompt", "checkpoint", "guidance", "seed", rounded("score", 6).alias("score")),
        f"""a as (select prompt, checkpoint, {r('avg(clap_score)')} as clap from ev where clap_score is not null group by 1, 2)
        select prompt, checkpoint, g as guidance, s as seed, {r('clap * g / (g + 1) + case when s % 3 = 0 then 0.1e0 else 0e0 end', 6)} as score from a, (values (1e0), (3e0), (5e0)) b(g), (values (1), (2), (3), (4)) c(s)""",
    ),
    "normal_recipes": (
        lambda s, d: st.recipes(requests(s, d), singers(s, d), styles(s, d), "a0"),
        """a as (select c_custkey as k, c_nationkey as n, n_name, r_name, r_regionkey from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
        select k as c_custkey, case when k % 4 < 3 then concat('a', n) else 'a0' end as artist, case when k % 3 > 0 then r_name else '' end as genre,
        case when k % 5 = 0 then 'calm' when k % 3 > 0 then concat('mood ', r_regionkey) else 'dark' end as mood,
        case when k % 7 = 1 then 'rain' when k % 4 < 3 and n % 3 <> 0 then concat('life in ', lower(n_name)) when k % 3 > 0 then 'roads' else 'struggle' end as topic from a""",
    ),
    "biased_recipes": (
        lambda s, d: st.biased(requests(s, d).select("c_custkey", "genre", "mood"), table(s, d, "customer").groupBy(F.lit("mood").alias("dim"), F.col("c_mktsegment").alias("value")).agg(F.count("*").alias("score")), 0.75),
        """b as (select c_mktsegment as m from customer group by 1 order by count(*) desc, 1 limit 1)
        select c_custkey, case when c_custkey % 3 > 0 then lower(r_name) else 'none' end as genre, m as mood from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey, b""",
    ),
    "surprise_recipes": (lambda s, d: st.surprise(table(s, d, "customer"), "c_custkey", singers(s, d), styles(s, d), ["dark", "calm"], 3), None),
    "song_grid": (
        lambda s, d: st.corpus_grid(singers(s, d), 25, ["dark", "calm", "warm"], ["roads", "rain", "home", "work"], ["A minor", "C minor"], 7).drop("bpm"),
        """select concat('a', n_nationkey) as id, cast(i as int) as i, concat('[synth ', lpad(cast(i + 1 as varchar), 3, '0'), '] ', ['dark', 'calm', 'warm'][i % 3 + 1], ' ', ['roads', 'rain', 'home', 'work'][(i * 7 + 7) % 4 + 1]) as title,
        ['dark', 'calm', 'warm'][i % 3 + 1] as mood, ['roads', 'rain', 'home', 'work'][(i * 7 + 7) % 4 + 1] as topic, ['A minor', 'C minor'][(i + 7) % 2 + 1] as key, cast(i + 7 as int) as seed from nation, range(25) t(i)""",
    ),
    "beat_contexts": (
        contexts,
        f"""b as (select event_id // 20 as song, max(bpm_target) as bpm, avg(coalesce(clap_score, 0)) as e, count(*) as n from ev group by 1)
        select song, case when bpm > 100 then bpm else 140e0 end as bpm, 'A minor' as key, 'swung' as swing, {r('e')} as energy, cast(16 * n as int) as bars from b""",
    ),
    "song_sheets": (
        sheets,
        f"""b as (select doc_id, string_agg(concat('- ', line, '  _(', {SYLLABLES}, ' syll · rhyme AABB)_'), chr(10) order by line_no) as body from lines group by doc_id)
        select track_id, concat('# ', coalesce(song_id, '?'), ' — dark / roads', chr(10), '**', coalesce(cast(cast(round_even(bpm, 0) as bigint) as varchar), '0'), ' BPM · ', coalesce(musical_key, '?'), ' · swing straight · seed ', track_id, '**', chr(10), chr(10),
        '## [', upper(coalesce(section, 'verse')), '] 8 bars · steady @ medium · ', coalesce(song_id, ''), chr(10), body, chr(10), '> ad-libs: (yeah)') as sheet from tracks join b on doc_id = track_id where text is not null""",
    ),
    "section_lines": (verses, None),
    "song_diffs": (diffs, None),
    "song_split": (
        lambda s, d: st.split_summary(table(s, d, "conversations"), "conv_id", (0.8, 0.1, 0.1), 7).select("split", "songs"),
        """n as (select count(distinct conv_id) as n from conversations), v as (select n, cast(greatest(1, round_even(n * 0.1, 0)) as bigint) as v from n)
        select split, case split when 'train' then n - 2 * v else v end as songs from v, (values ('train'), ('val'), ('test')) t(split)""",
    ),
    "fold_segments": (lambda s, d: st.fold_summary(table(s, d, "conversations"), "conv_id", 5, 7), None),
    "checkpoint_registry": (
        checkpoints,
        f"""f as (select o_custkey as c, count(*) filter (o_orderkey % 3 = 0) as weight_files, sum(case when o_orderkey % 3 = 0 then cast(floor(o_totalprice) as bigint) else 0 end) / 1e6 as mb from orders group by 1)
        select concat('c', c) as name, weight_files, {r('mb', 1)} as size_mb, case when c_custkey % 2 = 0 then 'small' end as model_type, case when c_custkey % 2 = 0 then c_custkey * c_custkey * 16 end as n_params
        from f left join customer on c_custkey = c""",
    ),
    "run_table": (
        lambda s, d: st.run_table(table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("duration")), "o_orderkey"),
        """a as (select o_orderkey, case when o_orderkey % 7 <> 0 then cast(o_custkey as double) end as duration_s from orders), t as (select sum(duration_s) as total_s from a)
        select o_orderkey, duration_s, total_s from (select * from a order by o_orderkey desc limit 30), t""",
    ),
    "best_adapter": (
        lambda s, d: st.best_adapter(table(s, d, "supplier").withColumn("loss", F.when(F.col("s_suppkey") % 3 > 0, F.abs("s_acctbal"))), "s_name", "loss"),
        "select s_name from supplier order by case when s_suppkey % 3 > 0 then abs(s_acctbal) else 'infinity'::double end, s_name limit 1",
    ),
    "tag_strip": (
        lambda s, d: st.tag_strip(evaluation(s, d).where("clap_score is not null").withColumn("tags", F.when(F.col("event_id") % 5 > 0, F.map_from_arrays(F.array(F.concat(F.lit("g:"), "genre"), F.concat(F.lit("s:"), "section")), F.array("clap_score", F.col("clap_score") / 2)))), "tags"),
        f"""a as (select * from ev where clap_score is not null and event_id % 5 > 0), n as (select count(*) as n from a),
        t as (select concat('g:', genre) as tag, clap_score as x from a union all select concat('s:', section), clap_score / 2 from a) select tag, {r('sum(x) / any_value(n)')} as mean from t, n group by tag""",
    ),
    "kept_frechet": (kept_distance, None),
    "loudness_profile": (
        lambda s, d: fr.loudness(sound(s, d), "user_id"),
        f"""f as ({_FR}), l as (select user_id, peak, greatest(20 * log10(greatest(rms, 1e-5)) - 20 * log10(greatest(max(rms) over (partition by user_id), 1e-5)), -80) as level from f),
        q as (select user_id, max(peak) as p, quantile_cont(level, 0.1) as a, quantile_cont(level, 0.9) as b from l group by 1)
        select user_id, {r('20 * log10(p + 1e-12)', 2)} as peak_db, {r('a', 2)} as rms_p10_db, {r('b', 2)} as rms_p90_db, {r('b - a', 2)} as dynamic_range_db from q""",
    ),
    "masking_pairs": (
        lambda s, d: fr.masking(spectra(s, d), "user_id", 16, 1.5, 1.5),
        f"""f as ({_FR}), m as (select user_id, i * 100e0 + 50 as hz, value as v, lag(value) over w as a, lead(value) over w as b from f window w as (partition by user_id order by i)),
        p as (select * from (select *, row_number() over (partition by user_id order by v desc, hz) as n from m where v > a and v >= b) where n <= 16)
        select x.user_id, {r('x.hz', 1)} as f1_hz, {r('y.hz', 1)} as f2_hz, {r('greatest(x.v, y.v) / least(x.v, y.v)', 2)} as amplitude_ratio from p x join p y on x.user_id = y.user_id and x.hz < y.hz
        where y.hz / x.hz < 1.5e0 and greatest(x.v, y.v) / least(x.v, y.v) > 1.5e0""",
    ),
    "speaker_runs": (
        lambda s, d: fr.speakers(sound(s, d), "user_id", 0.05, 3).select("user_id", "first", "last", "centroid", "speaker"),
        f"""f as ({_FR}), a as (select *, rms > 0.05e0 as loud, bool_or(rms > 0.05e0) over (partition by user_id) as anyone from f),
        g as (select *, row_number() over (partition by user_id order by i) - row_number() over (partition by user_id, loud order by i) as isle from a where anyone),
        u as (select user_id, min(i) as first, max(i) as last, avg(centroid) as c from g where loud group by user_id, isle having count(*) >= 3),
        w as (select * from u union all select user_id, min(i), max(i), avg(centroid) from g where user_id not in (select user_id from u) group by user_id)
        select user_id, first, last, {r('c', 1)} as centroid, cast(c > median(c) over (partition by user_id) as int) as speaker from w""",
    ),
    "tempo_drift": (
        lambda s, d: fr.tempo_drift(sound(s, d).select("user_id", (F.col("i") * 2.0).alias("t"), (F.lit(90.0) + F.col("flux") / 10).alias("bpm")), "user_id", F.max("t") + 4.0),
        f"""f as ({_FR}), t as (select user_id, i * 2e0 as t, 90 + flux / 10 as bpm from f),
        b as (select user_id, avg(bpm) as m, stddev_pop(bpm) as sd, regr_slope(bpm, t) as k, regr_slope(bpm, t) * (max(t) + 4) as dr from t group by 1 having count(*) >= 2)
        select user_id, {r('m', 2)} as mean_bpm, {r('sd', 2)} as std_bpm, {r('k')} as drift_bpm_per_sec, {r('dr')} as total_drift, case when abs(dr) / m < 0.02e0 then 'steady' when k > 0 then 'rushing' else 'dragging' end as verdict from b""",
    ),
    "downbeat_phases": (
        lambda s, d: fr.downbeat_phase(sound(s, d), "user_id", "i", "flux"),
        f"""f as ({_FR}), b as (select user_id, i % 4 as phase, avg(flux) as x from f group by 1, 2) select user_id, phase as downbeat_phase from (select *, row_number() over (partition by user_id order by x desc, phase) as n from b) where n = 1""",
    ),
    "onset_alignment": (
        lambda s, d: fr.onset_alignment(sound(s, d), "user_id", F.col("i") % 4 == 0),
        f"""f as ({_FR}), b as (select user_id, avg(flux) filter (i % 4 = 0) as o, avg(flux) as a, avg(cast(i % 4 = 0 as int)) as p from f group by 1)
        select user_id, case when a > 1e-9 then {r('case when p >= 1 then 1 else greatest(0, least(1, (o / a - p) / (1 - p))) end')} end as alignment from b""",
    ),
    "instrument_bands": (
        lambda s, d: fr.instrument_presence(spectra(s, d), "user_id"),
        f"""f as ({_FR}), m as (select user_id, i * 100e0 + 50 as hz, value as v from f),
        b as (select user_id, {', '.join(f"coalesce(avg(v) filter (hz >= {a} and hz < {b}), 0) as {n}" for n, (a, b) in fr.BANDS.items())} from m group by 1), t as (select *, {' + '.join(fr.BANDS)} + 1e-9 as total from b)
        select user_id, {', '.join(f"{r(n + ' / total')} as {n}" for n in fr.BANDS)} from t""",
    ),
    "swing_feels": (
        swings,
        f"""f as ({_FR}), o as (select user_id, list(flux order by i) as s, count(*) as n from f group by 1), b as (select user_id, s, n, range(0, greatest(1, n - 1) + 1, 4) as k from o),
        x as (select user_id, len(k) as m, list_sum(list_transform(k[1:len(k) - 1], lambda i: s[i + 1])) as a, list_sum(list_transform(k[1:len(k) - 1], lambda i: s[least(i + 2, n - 1) + 1])) as b from b),
        q as (select user_id, case when m > 1 and a / (m - 1) > 1e-9 then b / a end as q from x)
        select user_id, {r('q')} as ratio, case when q is null then 'unknown' when q < 0.5 then 'straight' when q < 0.9 then 'moderate' else 'swung' end as feel from q""",
    ),
    "chord_labels": (
        lambda s, d: table(s, d, "embeddings").select("vec_id", fr.chord(F.transform(F.slice("embedding", 1, 12), lambda x: F.abs(x.cast("double")))).alias("c")).select("vec_id", "c.chord", "c.confidence"),
        f"""a as (select vec_id, list_transform(embedding[1:12]::double[], lambda x: abs(x)) as c from embeddings),
        b as (select vec_id, list_transform(range(24), lambda n: (c[n // 2 + 1] + c[(n // 2 + case when n % 2 = 0 then 4 else 3 end) % 12 + 1] + c[(n // 2 + 7) % 12 + 1]) / sqrt(3e0) / sqrt(list_dot_product(c, c))) as s from a where list_dot_product(c, c) > 0),
        m as (select vec_id, list_max(s) as x, list_position(s, list_max(s)) - 1 as n from b)
        select vec_id, concat(['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][n // 2 + 1], case when n % 2 = 1 then 'm' else '' end) as chord, {r('x')} as confidence from m""",
    ),
    "stereo_profiles": (
        lambda s, d: table(s, d, "embeddings").select("vec_id", sg.stereo(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)).alias("x")).select("vec_id", "x.*"),
        f"""a as (select vec_id, embedding[1:32]::double[] as l, embedding[33:64]::double[] as r from embeddings), b as (select vec_id, list_dot_product(l, l) / 32 as ll, list_dot_product(r, r) / 32 as rr, list_dot_product(l, r) / 32 as lr, list_avg(l) as ml, list_avg(r) as mr from a),
        c as (select vec_id, (ll + rr - 2 * lr) / 4 as s, (ll + rr + 2 * lr) / 4 as m, (lr - ml * mr) / (sqrt(ll - ml * ml) * sqrt(rr - mr * mr) + 1e-12) as p from b)
        select vec_id, {r('s / (m + s + 1e-12)')} as width, {r('p')} as phase_correlation, p > 0 as mono_compatible from c""",
    ),
    "sound_artifacts": (lambda s, d: table(s, d, "embeddings").select("vec_id", sg.artifacts(F.transform("embedding", lambda x: x.cast("double")), 4).alias("x")).select("vec_id", "x.*"), _ARTIFACTS),
    "key_candidates": (lambda s, d: table(s, d, "embeddings").select("vec_id", sg.keys(F.transform(F.slice("embedding", 1, 12), lambda x: F.abs(x.cast("double")))).alias("k")).select("vec_id", F.posexplode("k").alias("nth", "c")).select("vec_id", "nth", "c.key", F.round("c.share", 4).alias("share")), _KEYS),
    "spectral_divergence": (
        lambda s, d: sg.spectral_divergence(magnitudes(s, d).where("label < 5"), magnitudes(s, d).where("label >= 5"), "bands"),
        """a as (select label < 5 as one, vec_id, unnest(range(64)) as i, abs(unnest(embedding::double[])) as x from embeddings), t as (select *, x / sum(x) over (partition by vec_id) as sh from a),
        b as (select i, avg(sh) filter (one) + 1e-12 as p, avg(sh) filter (not one) + 1e-12 as q from t group by i) select round(sum(p * ln(p / q) + q * ln(q / p)) / 2, 6) + 0e0 as divergence from b""",
    ),
    "chroma_fingerprints": (
        lambda s, d: sg.mean_chroma(magnitudes(s, d).select("label", F.slice("bands", 1, 12).alias("c")), "label", "c").select("label", F.posexplode("fingerprint").alias("i", "x")).select("label", "i", F.round("x", 4).alias("x")),
        f"""a as (select label, unnest(range(12)) as i, abs(unnest(embedding[1:12]::double[])) as x from embeddings) select label, cast(i as int) as i, {r('avg(x)')} as x from a group by 1, 2""",
    ),
    "augmentation_plan": (lambda s, d: fr.variant_plan(tracks(s, d), "source_id", ["gain", "noise", "tilt"], 2, 5), None),
    "checked_clips": (
        lambda s, d: fr.once_a_clip(evaluation(s, d).withColumn("clip", F.when(F.col("event_id") % 9 > 0, F.concat(F.lit("c"), F.col("event_id") % 100))), "clip", "event_id").select("clip", "event_id"),
        "select concat('c', event_id % 100) as clip, min(event_id) as event_id from ev where event_id % 9 > 0 group by 1",
    ),
}
