"""Operators over lines, pages and chats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.columns import rounded, syllables


def page_lines(html: Column) -> Column:
    """Text lines of a page: breaks and block ends as newlines, tags stripped, common entities resolved."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr)>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\t ]+", " "))), lambda x: x != "")


def chunks(items: Column, size: int) -> Column:
    """Slices of ``size`` items; the last may be shorter."""
    n = F.ceil(F.size(items) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(items, i * size + 1, F.lit(size)))).otherwise(F.array())


def song_chunks(lines: DataFrame, size: int = 8, least: int = 4) -> DataFrame:
    """(doc_id, chunk, n_lines, first): training examples of consecutive lines, songs of at least ``least`` lines."""
    by = lines.where("line <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("all"))  # a document's own lines
    return by.where(F.size("all") >= least).select("doc_id", F.posexplode(chunks(F.transform("all", lambda x: x["line"]), size)).alias("chunk", "part")).select("doc_id", "chunk", F.size("part").alias("n_lines"), F.sha2(F.array_join("part", "\n"), 256).alias("digest"))


def rhyme_key(line: Column) -> Column:
    """The last vowel group and what follows it in a line's last word."""
    return F.nullif(F.regexp_extract(F.lower(line), r"([aeiouy]++[b-df-hj-np-tv-xz]*+)[^a-z]*+$", 1), F.lit(""))


def line_metrics(lines: DataFrame) -> DataFrame:
    """By document: mean and spread of syllables, and the share of lines that rhyme with the line before."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    real = lines.where(F.trim("line") != "").select("doc_id", "line_no", syllables("line").alias("n"), rhyme_key(F.col("line")).alias("rhyme"))
    near = real.withColumn("same", (F.col("rhyme") == F.lag("rhyme").over(w)).cast("double"))
    return near.groupBy("doc_id").agg(F.count("*").alias("n_lines"), rounded(F.avg("n")).alias("avg_syllables"), rounded(F.stddev_pop("n")).alias("std_syllables"), rounded(F.coalesce(F.avg("same"), F.lit(0.0))).alias("rhyme_density"))


def timed(lines: DataFrame, seconds: float) -> DataFrame:
    """Lines with the time at which each starts, as [mm:ss.hh]."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1
    at = nth * F.lit(float(seconds))
    stamp = F.format_string("[%02d:%05.2f]", F.floor(at / 60).cast("int"), at - F.floor(at / 60) * 60)
    return lines.where("line <> ''").select("doc_id", "line_no", stamp.alias("stamp"))


def quality_issues(lines: DataFrame) -> DataFrame:
    """(doc_id, issue): few lines, short lines, repeated lines, foreign script."""
    real = lines.where(F.trim("line") != "")
    cjk = F.length(F.regexp_replace("line", "[^一-鿿]", "")) / F.greatest(F.length("line"), F.lit(1))
    by = real.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("line").alias("d"), F.count_if(F.length(F.trim("line")) < 3).alias("short"), F.count_if(cjk > 0.2).alias("cjk"))
    found = F.filter(
        F.array(F.when(F.col("n") < 4, F.lit("under 4 lines")), F.when(1 - F.col("d") / F.col("n") > 0.4, F.lit("repeated lines")), F.when(F.col("short") > 0, F.lit("short lines")), F.when(F.col("cjk") > 0, F.lit("foreign script"))),
        lambda x: x.isNotNull(),
    )
    return by.select("doc_id", F.explode(found).alias("issue"))


def chats(turns: DataFrame) -> DataFrame:
    """One row a conversation: its messages in order."""
    by = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))  # a conversation's own turns
    return by.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
