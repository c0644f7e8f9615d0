"""Derived views: the entities of an evaluation project, from the given tables.

Each view is one portable SQL text, so that a SQL check can repeat it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: One row for each scored generation: (checkpoint, prompt, seed).
EVAL = """
select event_id, ts,
       concat('ck', cast(cast(floor(event_id / 200) as bigint) % 5 as int)) as checkpoint,
       concat('p', cast(event_id % 200 as int)) as prompt,
       concat('i', cast(event_id % 20 as int)) as intent,
       cast(floor(event_id / 1000) as int) as seed_no,
       case when event_id % 41 = 0 then '' else event_type end as section,
       case user_id % 4 when 0 then 'melodic trap' when 1 then 'ambient' when 2 then 'orchestral' else 'drill' end as genre,
       case when event_id % 53 = 0 then 0e0 else cast(70 + 10 * ((event_id % 200) % 9) as double) end as bpm_target,
       case when event_id % 17 = 0 then null else least(value / 97e0, 1e0) end as clap_score,
       case when event_id % 13 = 0 then null else (value - 50e0) / 487e0 end as deviation,
       case when event_id % 13 <> 0 and abs((value - 50e0) / 487e0) <= 0.05e0 then 'ok' else 'rejected' end as status,
       concat('data/generated/p', cast(event_id % 200 as int), '_', cast(event_id as string), '.wav') as audio_path,
       value, user_id
from {events}
"""

#: Listening scores by prompt.
RATINGS = """
select concat('p', cast(event_id % 200 as int)) as prompt, concat('u', cast(user_id as int)) as rater,
       cast(1 + event_id % 5 as double) as rating, event_id
from {events} where event_id % 11 = 0
"""

#: One row for each track of the corpus.
TRACKS = """
select d.doc_id as track_id, concat('data/', case d.doc_id % 3 when 0 then 'clean' when 1 then 'train' else 'val' end, '/t', cast(d.doc_id as string), '.wav') as path,
       concat('t', cast(d.doc_id as string)) as source_id, d.source as song_id, d.lang as genre,
       case d.doc_id % 3 when 0 then 'clean' when 1 then 'train' else 'val' end as split,
       cast(d.n_chars as double) / 10e0 as duration,
       case when d.doc_id % 19 = 0 then null else cast(60 + (d.doc_id * 7) % 120 as double) end as bpm,
       case d.doc_id % 5 when 0 then 'dark|calm' when 1 then 'calm' when 2 then 'bright; warm' when 3 then 'dark, warm' else '' end as mood,
       case d.doc_id % 4 when 0 then 'intro' when 1 then 'verse' when 2 then 'chorus' else null end as section,
       case when d.doc_id % 23 = 0 then 'loud' when d.doc_id % 29 = 0 then '1.7' else cast(cast(d.doc_id % 10 as double) / 10e0 as string) end as energy,
       -6e0 - cast(d.doc_id % 17 as double) as lufs,
       case d.doc_id % 6 when 0 then 'C major' when 1 then 'A minor' when 2 then 'F# minor' when 3 then 'Eb major' when 4 then '' else null end as musical_key,
       case when d.doc_id % 2 = 0 then 44100 else 48000 end as sample_rate, cast(1 + d.doc_id % 2 as int) as channels,
       d.n_chars as size_bytes, l.quality, l.toxic, d.text
from {documents} d left join (select doc_id, max(quality) as quality, max(toxic) as toxic from {labels} group by doc_id) l on d.doc_id = l.doc_id
"""

#: Lines of every text, from 0.
LINES = {
    "spark": "select doc_id, source, lang, pos as line_no, line from {documents} lateral view posexplode(split(text, '\\n')) x as pos, line",
    "duckdb": """select doc_id, source, lang, cast(unnest(range(len(string_split(text, chr(10))))) as int) as line_no,
        unnest(string_split(text, chr(10))) as line from documents""",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def evaluation(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(EVAL, events=table(spark, folder, "events"))


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(RATINGS, events=table(spark, folder, "events"))


def tracks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(TRACKS, documents=table(spark, folder, "documents"), labels=table(spark, folder, "labels"))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(LINES["spark"], documents=table(spark, folder, "documents"))


def duckdb_views() -> str:
    """The views as a WITH clause for DuckDB."""
    named = {"ev": EVAL, "ratings": RATINGS, "tracks": TRACKS}
    plain = {k: v.format(events="events", documents="documents", labels="labels") for k, v in named.items()} | {"lines": LINES["duckdb"]}
    return "with " + ",\n".join(f"{k} as ({v})" for k, v in plain.items())
