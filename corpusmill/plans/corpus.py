"""Queries over the corpus manifest, each with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import columns as c
from corpusmill.functions.columns import rounded
from corpusmill.operators import corpus as op
from corpusmill.sources.views import evaluation, lines, table, tracks

from .evaluation import r

#: The values of a delimited cell, in SQL.
MULTI = """list_filter(list_transform(case when contains({x}, '|') then string_split({x}, '|') when contains({x}, ';') then string_split({x}, ';')
  else string_split({x}, ',') end, lambda t: trim(t)), lambda t: t <> '')"""
MOODS = MULTI.format(x="coalesce(mood, '')")


def raters(s, d):
    """Two annotators' tag sets for each labelled document."""
    one, two = F.when(F.col("quality") == 1, "good").otherwise("poor"), F.when(F.col("toxic") == 1, "poor").otherwise("good")
    rows = table(s, d, "labels").select("doc_id", F.array(one, F.concat(F.lit("k"), F.col("doc_id") % 3)).alias("a"), F.array(two, F.concat(F.lit("k"), F.col("doc_id") % 3)).alias("b"))
    return rows


def versions(s, d):
    files = table(s, d, "documents").select(F.concat(F.lit("t"), "doc_id").alias("path"), F.sha2("text", 256).alias("sha256"), "doc_id")
    old = files.where("doc_id % 7 <> 0").select("path", "sha256")
    new = files.where("doc_id % 11 <> 0").select("path", F.when(F.col("doc_id") % 13 == 0, F.sha2("path", 256)).otherwise(F.col("sha256")).alias("sha256"))
    return op.version_diff(old, new)


def structure(s, d):
    """Points and labelled intervals of each song."""
    points = tracks(s, d).select(F.col("track_id").alias("point_id"), "song_id", (F.col("track_id") % 60).cast("double").alias("at"))
    songs = tracks(s, d).select("song_id").distinct()
    cut = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(x).alias("role")) for i, (a, b, x) in enumerate(((0.0, 10.0, "intro"), (10.0, 30.0, "verse"), (25.0, 45.0, "chorus")))])
    return op.interval_role(points, songs.select("song_id", F.inline(cut)), "song_id")


def splits(s, d):
    """Checks of a stratified split: sizes by stratum, each group in one split."""
    groups = tracks(s, d).select("source_id", "genre")
    out = op.ratio_split(groups, "source_id", (0.8, 0.1, 0.1), 42, F.col("genre"))
    return out.groupBy("genre").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "val").alias("val"), F.count_if(F.col("split") == "test").alias("test"))


_W = "list_filter(string_split(regexp_replace(lower(line), '[^a-z'' ]', ' ', 'g'), ' '), lambda w: replace(w, '''', '') <> '')"
_BARE = "replace(w, '''', '')"
SYLLABLES = f"""coalesce(list_sum(list_transform({_W}, lambda w: greatest(1, len(regexp_extract_all(
  case when length({_BARE}) > 2 and {_BARE} like '%e' then left({_BARE}, length({_BARE}) - 1) else {_BARE} end, '[aeiouy]+'))))), 0)"""
_PC = """case regexp_extract(coalesce({k}, ''), '^([A-G][#b]?)', 1) when 'C' then 0 when 'C#' then 1 when 'Db' then 1 when 'D' then 2 when 'D#' then 3 when 'Eb' then 3 when 'E' then 4
  when 'F' then 5 when 'F#' then 6 when 'Gb' then 6 when 'G' then 7 when 'G#' then 8 when 'Ab' then 8 when 'A' then 9 when 'A#' then 10 when 'Bb' then 10 when 'B' then 11 end"""
_CAM = "((case when contains(lower({k}), 'minor') then (" + _PC + " + 3) % 12 else " + _PC + " end) * 7 + 7) % 12 + 1"


def manifests(s, d):
    """Each run of 200 events against the one before it."""
    run = F.floor(F.col("event_id") / 200).cast("long")
    rows = lambda shift: evaluation(s, d).select(F.concat_ws("/", run + shift, "prompt").alias("at"), "status", "section")
    return op.unified(rows(1), rows(0), "at", ["status", "section"])


QUERIES = {
    "out_of_domain": (
        lambda s, d: op.out_of_domain(tracks(s, d), 70, 160, ["es", "calm"]).select("source_id", "bpm", F.array_join("ood_reasons", "; ").alias("why")),
        f"""a as (select source_id, bpm, concat_ws('; ', case when bpm < 70 or bpm > 160 then format('bpm {{:.1f}}', bpm) end,
              case when genre = 'es' or list_contains({MOODS}, 'calm') or list_contains({MOODS}, 'es') then 'excluded tag' end) as why from tracks)
        select * from a where why <> ''""",
    ),
    "manifest_issues": (
        lambda s, d: op.manifest_issues(tracks(s, d)),
        f"""select source_id, 'mood missing' as issue from tracks where len({MOODS}) = 0 union all select source_id, 'bpm missing' from tracks where bpm is null
        union all select source_id, 'bpm out of range' from tracks where bpm > 170 union all select source_id, 'too short' from tracks where duration < 5
        union all select source_id, 'energy no number' from tracks where try_cast(energy as double) is null
        union all select source_id, 'energy out of range' from tracks where try_cast(energy as double) not between 0 and 1
        union all select source_id, 'genre missing' from tracks where coalesce(genre, '') = ''""",
    ),
    "label_issues": (
        lambda s, d: op.label_issues(tracks(s, d).withColumn("k", F.col("track_id") - F.col("track_id") % 2), "k", "track_id"),
        f"""a as (select track_id - track_id % 2 as k, * from tracks)
        select cast(k as varchar) as "key", 'duplicate id' as issue from (select k, row_number() over (partition by k order by track_id) as n from a) where n > 1
        union all select cast(k as varchar), concat('unknown mood ', t) from (select k, unnest(list_distinct({MOODS})) as t from a) where t not in ('bright', 'calm', 'dark')
        union all select cast(k as varchar), concat('unknown section ', section) from a where section is not null and section not in ('chorus', 'intro', 'outro', 'verse')""",
    ),
    "hierarchy_notes": (
        lambda s, d: op.hierarchy_notes(tracks(s, d), "source_id"),
        f"""a as (select source_id, unnest({MOODS}) as term from tracks)
        select source_id, 'mood' as dim, term, case term when 'dark' then 'brooding, tense' else 'dreamy, mellow' end as narrower from a where term in ('dark', 'calm')""",
    ),
    "browse_tracks": (
        lambda s, d: op.browse(tracks(s, d), ["E", "f"], ["DARK", "warm"], "intro", "T1").select("source_id", "genre", "mood"),
        """select source_id, genre, mood from tracks where (contains(genre, 'e') or contains(genre, 'f')) and (contains(lower(mood), 'dark') or contains(lower(mood), 'warm'))
        and section = 'intro' and contains(lower(source_id), 't1')""",
    ),
    "global_search": (
        lambda s, d: op.search_cells(tracks(s, d), ["genre", "mood", "musical_key", "path"], "AR"),
        """select 'genre' as field, count(*) filter (contains(lower(genre), 'ar')) as hits from tracks union all select 'mood', count(*) filter (contains(lower(mood), 'ar')) from tracks
        union all select 'musical_key', count(*) filter (contains(lower(musical_key), 'ar')) from tracks union all select 'path', count(*) filter (contains(lower(path), 'ar')) from tracks""",
    ),
    "value_counts": (
        lambda s, d: op.value_counts(tracks(s, d), "mood", c.multi("mood")).unionByName(op.value_counts(tracks(s, d), "key", F.array("musical_key"))),
        f"""a as (select unnest({MOODS}) as value from tracks)
        select 'mood' as dim, value, count(*) as n from a group by value union all select 'key', musical_key, count(*) from tracks where coalesce(musical_key, '') <> '' group by musical_key""",
    ),
    "tempo_histogram": (
        lambda s, d: op.tempo_histogram(tracks(s, d)),
        "b as (select unnest(range(12)) as i, unnest([" + ",".join(map(str, op.TEMPO_EDGES[:-1])) + "]) as a, unnest([" + ",".join(map(str, op.TEMPO_EDGES[1:])) + """]) as z)
        select cast(i as int) as bin, concat(a, '-', z) as label, count(t.track_id) as n from b left join tracks t on t.bpm >= a and t.bpm < z group by i, a, z""",
    ),
    "corpus_summary": (
        lambda s, d: op.corpus_summary(tracks(s, d)),
        f"select count(*) as n, {r('sum(duration)', 2)} as total_duration, count(bpm) as bpm_n, {r('avg(bpm)')} as bpm_mean, min(bpm) as bpm_min, max(bpm) as bpm_max from tracks",
    ),
    "inventory_summary": (
        lambda s, d: op.inventory_summary(tracks(s, d)),
        f"""select sample_rate, channels, count(*) as n, {r('sum(duration)', 2)} as seconds, min(duration) as shortest, max(duration) as longest, cast(sum(size_bytes) as bigint) as bytes
        from tracks group by cube (sample_rate, channels)""",
    ),
    "tag_co_occurrence": (
        lambda s, d: op.co_occurrence(tracks(s, d), ["genre", "mood", "section"]),
        f"""a as (select coalesce(nullif(genre, ''), '?') as genre, coalesce(nullif(array_to_string(list_sort({MOODS}), ','), ''), '?') as mood, coalesce(nullif(section, ''), '?') as section from tracks)
        select genre, mood, section, count(*) as "count", {r('count(*) / (sum(count(*)) over ())')} as share from a group by genre, mood, section""",
    ),
    "annotator_agreement": (
        lambda s, d: op.agreement(raters(s, d), "quality"),
        f"""a as (select ['good', 'poor'] as tags, case quality when 1 then 'good' else 'poor' end as x, case toxic when 1 then 'poor' else 'good' end as y, concat('k', doc_id % 3) as k from labels),
        t as (select x, y, k, unnest(list_distinct([x, y, k])) as tag from a),
        m as (select tag, count(*) filter (tag in (x, k) and tag in (y, k)) as yy, count(*) filter (tag in (x, k) and tag not in (y, k)) as yn, count(*) filter (tag not in (x, k) and tag in (y, k)) as ny,
              (select count(*) from a) as n from t group by tag),
        p as (select *, n - yy - yn - ny as nn, (yy + n - yy - yn - ny) / n as po, ((yy + yn) * (yy + ny) + (ny + n - yy - yn - ny) * (yn + n - yy - yn - ny)) / (n * n) as pe from m)
        select 'quality' as field, (select count(*) from a) as "rows", (select {r('avg(case when x = y then 1e0 else 0e0 end)')} from a) as exact_agreement,
               {r('avg(case when pe = 1 then 0e0 else (po - pe) / (1 - pe) end)')} as kappa, count(*) as tags from p""",
    ),
    "annotator_disagreements": (
        lambda s, d: raters(s, d).where(F.array_sort("a") != F.array_sort("b")).select("doc_id", F.element_at("a", 1).alias("a"), F.element_at("b", 1).alias("b")),
        "select doc_id, case quality when 1 then 'good' else 'poor' end as a, case toxic when 1 then 'poor' else 'good' end as b from labels where quality <> 1 - toxic",
    ),
    "campaign_agreement": (
        lambda s, d: op.majority_agreement(table(s, d, "events").select((F.col("event_id") % 50).alias("item"), "event_type", "user_id"), "item", "event_type", "user_id"),
        f"""a as (select event_id % 50 as item, event_type, count(*) as n from events group by 1, 2), b as (select item, max(n) as t, sum(n) as s from a group by item)
        select count(*) as n_items, cast(sum(s) as bigint) as n_ratings, {r('avg(t / s)')} as agreement, (select count(distinct user_id) from events) as n_raters from b""",
    ),
    "taste_profile": (
        lambda s, d: op.taste_profile(evaluation(s, d).select(F.col("clap_score").alias("score"), "genre", "section"), ["genre", "section"], "score"),
        f"""a as (select 'genre' as dim, genre as value, clap_score as score from ev union all select 'section', section, clap_score from ev)
        select dim, value, {r('sum(score) / sum(sum(score)) over (partition by dim)')} as share from a where score > 0 and value <> '' group by dim, value""",
    ),
    "genre_mood_coverage": (
        lambda s, d: tracks(s, d).select("genre", F.explode_outer(F.nullif(c.multi("mood"), F.array().cast("array<string>"))).alias("mood")).groupBy("genre", F.coalesce("mood", F.lit("unknown")).alias("mood")).agg(F.count("*").alias("n")),
        f"""a as (select genre, unnest(case when len({MOODS}) = 0 then ['unknown'] else {MOODS} end) as mood from tracks) select genre, mood, count(*) as n from a group by genre, mood""",
    ),
    "unused_terms": (
        lambda s, d: op.unused_terms(tracks(s, d)),
        f"""k as (select 'mood' as dim, unnest(['bright', 'calm', 'dark']) as term union all select 'section', unnest(['chorus', 'intro', 'outro', 'verse'])),
        u as (select 'mood' as dim, unnest({MOODS}) as term from tracks union all select 'section', section from tracks)
        select dim, term from k where not exists (select 1 from u where u.dim = k.dim and u.term = k.term)""",
    ),
    "version_diff": (
        versions,
        """f as (select concat('t', doc_id) as path, sha256(text) as h, doc_id from documents), o as (select path, h from f where doc_id % 7 <> 0),
        n as (select path, case when doc_id % 13 = 0 then sha256(path) else h end as h from f where doc_id % 11 <> 0),
        j as (select coalesce(o.path, n.path) as path, case when o.path is null then 'added' when n.path is null then 'removed' when o.h <> n.h then 'changed' end as change from o full join n on o.path = n.path)
        select * from j where change is not null""",
    ),
    "new_blobs": (
        lambda s, d: table(s, d, "documents").select(F.sha2("text", 256).alias("h"), "doc_id").where("doc_id % 2 = 1").select("h").distinct().join(
            table(s, d, "documents").where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("h")).distinct(), "h", "left_anti"
        ),
        "select distinct sha256(text) as h from documents where doc_id % 2 = 1 and sha256(text) not in (select sha256(text) from documents where doc_id % 2 = 0)",
    ),
    "run_manifest_diff": (
        manifests,
        """q as (select *, event_id // 200 as run from ev), p as (select concat(n.run, '/', n.prompt) as "at", o.status as s, n.status as t, o.section as x, n.section as y from q o join q n on n.run = o.run + 1 and n.prompt = o.prompt)
        select "at", 'status' as field, s as a, t as b from p where s is distinct from t union all select "at", 'section', x, y from p where x is distinct from y""",
    ),
    "renamed_terms": (
        lambda s, d: tracks(s, d).select("source_id", op.renamed_terms(F.col("mood"), {"dark": "gloomy", "calm": "mellow"}).alias("mood")),
        f"select source_id, array_to_string(list_transform({MOODS}, lambda t: case t when 'dark' then 'gloomy' when 'calm' then 'mellow' else t end), '|') as mood from tracks",
    ),
    "split_leaks": (
        lambda s, d: op.split_leaks(tracks(s, d).select("path", "split", F.sha2("text", 256).alias("sha256")), ["train", "val", "clean"]),
        """f as (select path, split, sha256(text) as h, case split when 'train' then 1 when 'val' then 2 else 3 end as p from tracks), m as (select h, min(p) as p from f group by h having count(distinct p) > 1)
        select path, split from f join m using (h) where f.p > m.p""",
    ),
    "exact_duplicate_files": (
        lambda s, d: op.exact_duplicates(tracks(s, d), F.col("text"), "track_id").select("canonical", "n"),
        "select min(track_id) as canonical, count(*) as n from tracks group by text having count(*) > 1",
    ),
    "duplicate_penalty": (
        lambda s, d: op.penalties(tracks(s, d), F.col("text"), "track_id"),
        "a as (select track_id, row_number() over (partition by text order by track_id) as i, count(*) over (partition by text) as n from tracks) select track_id, case when i = 1 then 0e0 else 0.25e0 end as penalty from a where n > 1",
    ),
    "segment_roles": (
        structure,
        """p as (select track_id as point_id, song_id, cast(track_id % 60 as double) as "at" from tracks)
        select point_id, song_id, "at", case when "at" < 10 then 'intro' when "at" < 30 then 'verse' when "at" < 45 then 'chorus' else 'unknown' end as role from p""",
    ),
    "fixed_windows": (
        lambda s, d: op.fixed_windows(tracks(s, d), "source_id", 30.0, 10.0, 8.0),
        f"""a as (select source_id, duration, unnest(range(0, cast(greatest(ceil((duration - 10) / 20), 1) as bigint))) * 20e0 as st from tracks where duration > 0)
        select source_id, {r('st')} as start, {r('least(st + 30, duration)')} as "end" from a where round(least(st + 30, duration), 4) - round(st, 4) >= 8 and st < duration""",
    ),
    "bar_aligned_length": (
        lambda s, d: tracks(s, d).where("bpm is not null").select("source_id", rounded(op.bar_length(F.col("bpm"), 30.0, 4, 5.0)).alias("seconds")),
        f"select source_id, {r('greatest(5e0, floor(30e0 / (60e0 * 4 / bpm)) * (60e0 * 4 / bpm))')} as seconds from tracks where bpm is not null",
    ),
    "status_runs": (
        lambda s, d: op.runs_of(evaluation(s, d), "checkpoint", "event_id", F.col("status") == "ok", 2, 20),
        """a as (select checkpoint, event_id, status = 'ok' as f, row_number() over (partition by checkpoint order by event_id) - row_number() over (partition by checkpoint, status order by event_id) as g from ev)
        select checkpoint, min(event_id) as "first", max(event_id) as "last", count(*) as n from a where f group by checkpoint, g having count(*) between 2 and 20""",
    ),
    "stratified_split_sizes": (
        splits,
        "select genre, count(*) as n, cast(greatest(1, round_even(count(*) * 0.1, 0)) as bigint) as val, cast(greatest(1, round_even(count(*) * 0.1, 0)) as bigint) as test from tracks group by genre",
    ),
    "fold_sizes": (
        lambda s, d: op.folds(tracks(s, d).select("source_id"), "source_id", 5, 7).groupBy("fold").agg(F.count("*").alias("n")),
        "select cast(f as int) as fold, (f + 1) * n // 5 - f * n // 5 as n from (select count(*) as n from tracks), range(5) t(f)",
    ),
    "balanced_sample_sizes": (
        lambda s, d: op.balanced(tracks(s, d), "genre", "source_id", 40, 3).groupBy("genre").agg(F.count("*").alias("n")),
        "select genre, cast(10 as bigint) as n from tracks group by genre",
    ),
    "slugs": (
        lambda s, d: tracks(s, d).select("source_id", c.slug(F.concat_ws(" ", "path", "genre")).alias("slug"), c.dashed("path").alias("dashed"), c.plain_name("path").alias("plain")),
        """a as (select source_id, path, concat(path, ' ', genre) as p from tracks)
        select source_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '^.*/', ''), '[.][^.]*$', ''), '[^0-9A-Za-z._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') as slug,
        regexp_replace(regexp_replace(lower(path), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') as dashed, array_to_string(regexp_extract_all(lower(path), '[a-z0-9]+'), ' ') as plain from a""",
    ),
    "syllable_counts": (
        lambda s, d: lines(s, d).groupBy("doc_id").agg(F.sum(c.syllables("line")).alias("syllables"), F.count("*").alias("n_lines")),
        f"select doc_id, cast(sum({SYLLABLES}) as bigint) as syllables, count(*) as n_lines from lines group by doc_id",
    ),
    "clean_lines": (
        lambda s, d: lines(s, d).select("doc_id", c.clean_line("line").alias("line")).where("line is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars")),
        """a as (select doc_id, trim(line) as line from lines),
        b as (select * from a where length(line) >= 2 and not regexp_matches(line, 'https?://|www[.]') and not regexp_matches(line, '^[[(].*[])]$') and not contains(lower(line), 'produced by')
          and not contains(lower(line), 'prod. by') and not contains(lower(line), 'embed') and not contains(lower(line), 'lyrics') and not contains(lower(line), 'copyright') and not contains(lower(line), 'all rights reserved'))
        select doc_id, count(*) as n, cast(sum(length(line)) as bigint) as chars from b group by doc_id""",
    ),
    "key_distance": (
        lambda s, d: tracks(s, d).where(F.col("musical_key") != "").select("source_id", c.camelot("musical_key").alias("camelot"), c.camelot_distance(F.col("musical_key"), F.lit("A minor")).alias("distance"), c.transposed("musical_key", 3).alias("up3")),
        f"""a as (select source_id, musical_key, {_CAM.format(k='musical_key')} as cam, {_PC.format(k='musical_key')} as pc from tracks where musical_key <> '')
        select source_id, cast(cam as int) as camelot, cast(least((cam - 8 + 12) % 12, (8 - cam + 12) % 12) as int) as distance,
        concat(['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][(pc + 3) % 12 + 1], ' ', regexp_extract(musical_key, ' (major|minor)$', 1)) as up3 from a""",
    ),
    "prompt_grid": (
        lambda s, d: op.missing_prompts(tracks(s, d).where("bpm is not null"), "genre", "section", op.nearest_tempo("bpm")),
        f"""p as (select * from (values {', '.join(f"({i}, '{x[0]}', '{x[1]}', '{x[2]}')" for i, x in enumerate(op.SECTION_PROMPTS))}) t(k, section, phrasing, tail)),
        g as (select k * 7 + j as i, section, phrasing, tail, {list(op.GRID_TEMPOS)}[j + 1] as bpm, {list(op.GRID_KEYS)}[j % 5 + 1] as key from p, range(7) t(j)),
        a as (select concat(section, '_', lpad(cast(bpm as varchar), 3, '0'), '_', replace(lower(key), ' ', '')) as id, section, bpm from g
        union all select id, section, bpm from (values {', '.join(repr((x[0], x[1], x[3])) for x in op.OTHER_PROMPTS)}) o(id, section, bpm)),
        n as (select genre, section, list_sort(list_transform({list(op.GRID_TEMPOS)}, lambda x: [abs(x - bpm), x]))[1][2] as bpm, count(*) as n from tracks where bpm is not null group by 1, 2, 3),
        w as (select distinct genre from tracks where bpm is not null)
        select w.genre, a.id, coalesce(n.n, 0) as n from w cross join a left join n on n.genre = w.genre and n.section = a.section and n.bpm = a.bpm""",
    ),
}
