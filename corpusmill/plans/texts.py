"""Queries over lines, pages, chats and event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.lineage import scratch
from corpusmill.operators import text as tx
from corpusmill.sources.views import evaluation, lines, table
from corpusmill.streaming import logs

from .corpus import SYLLABLES
from .evaluation import r


def rates(s, d):
    return logs.drained(logs.rates(logs.read(s, f"{d}/events.parquet")), scratch(s, "rates"), "update", ["start", "event_type"])


def sessions(s, d):
    return logs.drained(logs.sessions(logs.read(s, f"{d}/events.parquet")), scratch(s, "sessions"))


def runlog_tail(s, d):
    """The last 20 purchases of the log, oldest first."""
    return table(s, d, "events").where("event_type = 'purchase'").orderBy(F.desc("event_id")).limit(20).select("event_id", "user_id")


_RHYME = "nullif(regexp_extract(regexp_extract(lower(line), '([a-z]+)[^a-z]*$', 1), '([aeiouy]+[^aeiouy]*)$', 1), '')"

QUERIES = {
    "page_lines": (
        lambda s, d: table(s, d, "pages").select("page_id", F.size(tx.page_lines(F.col("html"))).alias("n_lines"), F.sha2(F.array_join(tx.page_lines(F.col("html")), "\n"), 256).alias("digest")),
        r"""a as (select page_id, regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>', ' ', 'g') as t from pages),
        b as (select page_id, regexp_replace(regexp_replace(t, '(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr)>', chr(10), 'g'), '<[^>]*>', '', 'g') as t from a),
        c as (select page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') as t from b),
        e as (select page_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[\t ]+', ' ', 'g'))), lambda x: x <> '') as l from c)
        select page_id, cast(len(l) as int) as n_lines, sha256(array_to_string(l, chr(10))) as digest from e""",
    ),
    "song_chunks": (
        lambda s, d: tx.song_chunks(lines(s, d)),
        """a as (select doc_id, list(line order by line_no) as l from lines where line <> '' group by doc_id having count(*) >= 4),
        b as (select doc_id, l, unnest(range(0, cast(ceil(len(l) / 8) as bigint))) as k from a)
        select doc_id, cast(k as int) as chunk, cast(len(l[k * 8 + 1 : k * 8 + 8]) as int) as n_lines, sha256(array_to_string(l[k * 8 + 1 : k * 8 + 8], chr(10))) as digest from b""",
    ),
    "line_metrics": (
        lambda s, d: tx.line_metrics(lines(s, d)),
        f"""a as (select doc_id, line_no, {SYLLABLES} as n, {_RHYME} as rhyme from lines where trim(line) <> ''),
        b as (select *, cast(rhyme = lag(rhyme) over (partition by doc_id order by line_no) as int) as same from a)
        select doc_id, count(*) as n_lines, {r('avg(n)')} as avg_syllables, {r('stddev_pop(n)')} as std_syllables, {r('coalesce(avg(same), 0)')} as rhyme_density from b group by doc_id""",
    ),
    "timed_lines": (
        lambda s, d: tx.timed(lines(s, d), 2.5),
        """a as (select doc_id, line_no, (row_number() over (partition by doc_id order by line_no) - 1) * 2.5e0 as t from lines where line <> '')
        select doc_id, line_no, concat('[', lpad(cast(cast(floor(t / 60) as int) as varchar), cast(greatest(2, length(cast(cast(floor(t / 60) as int) as varchar))) as int), '0'), ':', lpad(format('{:.2f}', t - floor(t / 60) * 60), 5, '0'), ']') as stamp from a""",
    ),
    "line_quality_issues": (
        lambda s, d: tx.quality_issues(lines(s, d)),
        """a as (select doc_id, count(*) as n, count(distinct line) as k, count(*) filter (length(trim(line)) < 3) as short,
              count(*) filter (length(regexp_replace(line, '[^一-鿿]', '', 'g')) / greatest(length(line), 1) > 0.2) as cjk from lines where trim(line) <> '' group by doc_id)
        select doc_id, 'under 4 lines' as issue from a where n < 4 union all select doc_id, 'repeated lines' from a where 1 - k / n > 0.4
        union all select doc_id, 'short lines' from a where short > 0 union all select doc_id, 'foreign script' from a where cjk > 0""",
    ),
    "chat_examples": (
        lambda s, d: tx.chats(table(s, d, "conversations")).select("conv_id", F.size("messages").alias("n"), F.sha2(F.array_join(F.transform("messages", lambda m: F.concat_ws(": ", m["role"], m["content"])), "\n"), 256).alias("digest")),
        "select conv_id, cast(count(*) as int) as n, sha256(string_agg(concat_ws(': ', role, text), chr(10) order by turn)) as digest from conversations group by conv_id",
    ),
    "event_rates_stream": (rates, "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by 1, 2"),
    "user_sessions_stream": (
        sessions,
        """a as (select user_id, ts, lag(ts) over (partition by user_id order by ts, event_id) as was from events), b as (select *, sum(case when was is null or ts - was >= interval '30 minutes' then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as g from a)
        select user_id, min(ts) as start, count(*) as n from b group by user_id, g""",
    ),
    "run_log_tail": (runlog_tail, "select event_id, user_id from events where event_type = 'purchase' order by event_id desc limit 20"),
    "generation_cache_keys": (
        lambda s, d: evaluation(s, d).select("event_id", F.sha1(F.concat_ws("\u001f", "checkpoint", "prompt", "genre", F.col("seed_no").cast("string"))).alias("cache_key")),
        "select event_id, sha1(concat_ws(chr(31), checkpoint, prompt, genre, cast(seed_no as varchar))) as cache_key from ev",
    ),
}
