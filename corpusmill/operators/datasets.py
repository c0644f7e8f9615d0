"""Building datasets: joins of manifests, imports, versions, prompts and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.columns import clamp, clean_line, dashed, or_else, plain_name, rounded


def last_by(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The last row of each key: what a dictionary keeps."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(position)))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def overlaid(base: DataFrame, over: DataFrame, key: str) -> DataFrame:
    """base left join over; where both have a column, the base's value wins unless null."""
    both = [c for c in over.columns if c in base.columns and c != key]
    right = over.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") if c in both else F.col(c) for c in over.columns if c != key])
    out = base.join(right, base[key] == F.col("_k"), "left").drop("_k")
    for c in both:
        out = out.withColumn(c, F.coalesce(c, f"_{c}")).drop(f"_{c}")
    return out


def described(genre: Column, mood: Column, bpm: Column) -> Column:
    """Conditioning text of the fields that are there."""
    tempo = F.when(bpm == F.floor(bpm), F.format_string("%d bpm", bpm.cast("long"))).otherwise(F.concat(bpm.cast("string"), F.lit(" bpm")))
    return F.concat_ws(", ", F.nullif(genre, F.lit("")), F.nullif(mood, F.lit("")), tempo)


def cache_refresh(files: DataFrame, cache: DataFrame) -> DataFrame:
    """(path, action): embed new files, re-embed changed ones, prune gone ones, keep the rest."""
    have = cache.select("path", F.col("size").alias("was_size"), F.col("mtime").alias("was_mtime"), F.lit(True).alias("cached"))
    both = files.withColumn("live", F.lit(True)).join(have, "path", "full")
    action = (
        F.when(F.col("live").isNull(), "pruned").when(F.col("cached").isNull(), "new").when((F.col("size") != F.col("was_size")) | (F.col("mtime") != F.col("was_mtime")), "changed").otherwise("kept")
    )
    return both.select("path", action.alias("action"))


def fuzzy_match(segments: DataFrame, songs: DataFrame) -> DataFrame:
    """Each segment's song: one whose id starts it, else one whose plain name it contains; longest first.

    Songs are looked up by the prefixes and word runs of the segment's name,
    so that both sides meet on equal keys.
    """
    name = plain_name("segment")
    words = F.split(name, " ")
    cut = F.transform(F.sequence(F.lit(1), F.length("segment")), lambda i: F.left("segment", i))
    n = F.size(words)
    spans = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice(words, i, k), " "))))
    keys = segments.select("segment", F.explode(F.concat(F.transform(cut, lambda c: F.struct(F.lit(2).alias("how"), c.alias("k"))), F.transform(spans, lambda c: F.struct(F.lit(1).alias("how"), c.alias("k"))))).alias("x"))
    known = songs.select("song", F.explode(F.array(F.struct(F.lit(2).alias("how"), F.col("song").alias("k")), F.struct(F.lit(1).alias("how"), plain_name("song").alias("k")))).alias("y"))
    hit = keys.select("segment", "x.how", "x.k").join(known.select("song", "y.how", "y.k").where("k <> ''"), ["how", "k"])
    best = hit.groupBy("segment").agg(F.max(F.struct("how", F.length("k").alias("n"), "song")).alias("b"))
    return best.select("segment", F.col("b.song").alias("song"))


def songs_from_lines(lines: DataFrame, least: int = 4) -> DataFrame:
    """Lyric lines to songs: noise dropped, grouped by slugged artist and title, at least ``least`` lines."""
    good = lines.withColumn("line", clean_line("line")).where("line is not null")
    keyed = good.withColumn("artist_id", dashed("artist")).withColumn("song_key", F.concat_ws("/", dashed("artist"), dashed("title")))
    by = keyed.groupBy("artist_id", "song_key").agg(F.min_by("title", "pos").alias("title"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))  # a song's own lines
    return by.where(F.size("l") >= least).select("artist_id", "song_key", "title", F.transform("l", lambda x: x["line"]).alias("lines"), F.size("l").alias("n_lines"))


def upserted(existing: DataFrame, new: DataFrame, key: str, position: str) -> DataFrame:
    """New rows with keys that are neither empty nor known; the first of each key."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(position))
    first = new.where(F.nullif(key, F.lit("")).isNotNull()).withColumn("_nth", nth).where("_nth = 1").drop("_nth")
    return first.join(existing.select(key).distinct(), key, "left_anti")


def curation(rows: DataFrame) -> DataFrame:
    """0 to 100 from quality (0.6 if unknown), loudness near -14, novelty, less the duplicate penalty."""
    loud = 1.0 - F.least(F.lit(1.0), F.abs(F.col("lufs") + 14.0) / 20.0)
    score = 100.0 * clamp(0.5 * F.coalesce("quality", F.lit(0.6)) + 0.3 * loud + 0.2 * F.coalesce("novelty", F.lit(0.5)) - F.coalesce("penalty", F.lit(0.0)))
    return rows.select("track_id", rounded(score, 2).alias("score"))


def blind_pairs(rows: DataFrame, seed: int) -> DataFrame:
    """The first two checkpoints of each prompt as x and y, in an order by hash."""
    first = rows.groupBy("prompt", "checkpoint").agg(F.min("event_id").alias("at"))
    nth = F.row_number().over(Window.partitionBy("prompt").orderBy("at"))
    two = first.withColumn("nth", nth).where("nth <= 2").groupBy("prompt").pivot("nth", [1, 2]).agg(F.first("checkpoint")).toDF("prompt", "one", "two").where("two is not null")
    flip = F.pmod(F.xxhash64(F.lit(seed), "prompt"), F.lit(2)) == 1
    return two.select("prompt", F.when(flip, F.col("two")).otherwise(F.col("one")).alias("x"), F.when(flip, F.col("one")).otherwise(F.col("two")).alias("y"))


def boundary_windows(beats: DataFrame, key: str, step: int) -> DataFrame:
    """Windows from every step-th boundary to the next such one; the last ends with the track."""
    w = Window.partitionBy(key).orderBy("pos")
    later = F.lead("at", step).over(w)
    n = F.count("*").over(Window.partitionBy(key))
    end = F.coalesce(later, F.when(F.col("pos") + 1 < n, F.col("duration")))
    return beats.withColumn("end", end).where((F.col("pos") % step == 0) & F.col("end").isNotNull()).select(key, F.col("at").alias("start"), "end")


def density(events: DataFrame, key: str, at: str, width: float) -> DataFrame:
    """Events by bin of ``width``, empty bins up to the last one as 0."""
    by = events.groupBy(key, F.floor(F.col(at) / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    all_ = by.groupBy(key).agg(F.max("bin").alias("last")).select(key, F.explode(F.sequence(F.lit(0), F.col("last"))).alias("bin"))
    return all_.join(by, [key, "bin"], "left").select(key, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def roles(parts: DataFrame, key: str) -> DataFrame:
    """First part intro, last outro, loudest other one chorus, first quiet one after that bridge, rest verse."""
    w = Window.partitionBy(key)
    o = w.orderBy("pos")
    inner = (F.row_number().over(o) > 1) & (F.row_number().over(w.orderBy(F.desc("pos"))) > 1)
    base = parts.withColumn("inner", inner).withColumn("i", F.row_number().over(o))
    loud = F.max(F.when(F.col("inner"), F.struct("energy", -F.col("pos")))).over(w)
    mean = F.avg("energy").over(w)
    marked = base.withColumn("loud", -loud["col2"]).withColumn("mean", mean)
    quiet = F.min(F.when(F.col("inner") & (F.col("energy") < F.col("mean")) & (F.col("pos") != F.col("loud")), F.col("pos"))).over(w)
    role = F.when(F.col("i") == 1, "intro").when(~F.col("inner"), "outro").when(F.col("pos") == F.col("loud"), "chorus").when(F.col("pos") == quiet, "bridge").otherwise("verse")
    return marked.select(key, "pos", role.alias("role"))


def kept_newest(rows: DataFrame, group: str, order: Column, keep: int) -> DataFrame:
    """(keep or archive) by order, newest or best first."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order), "event_id"))
    return rows.select(group, "event_id", F.when(nth <= keep, "keep").otherwise("archive").alias("action"))


def steepest(curve: DataFrame, by: str) -> DataFrame:
    """Step of the least loss and of the steepest fall, by run."""
    w = Window.partitionBy(by).orderBy("step")
    slope = (F.col("loss") - F.lag("loss").over(w)) / F.nullif(F.log("lr") - F.log(F.lag("lr").over(w)), F.lit(0.0))
    return curve.withColumn("slope", slope).groupBy(by).agg(F.min_by("step", F.struct("loss", "step")).alias("best_step"), F.min_by("step", F.struct(F.coalesce("slope", F.lit(float("inf"))), "step")).alias("steepest_step"))


def lineage_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("parent").alias("node")).union(edges.select("child")).distinct()


def prompt_text(section: Column, genre: Column, bpm: Column, key: Column, energy: Column) -> Column:
    """Selections in canonical order, each once."""
    feel = F.when(energy >= 0.75, "high energy").when(energy >= 0.4, "moderate energy").when(energy.isNotNull(), "low energy")
    tempo = F.when(bpm > 0, F.concat(F.when(bpm == F.floor(bpm), bpm.cast("long").cast("string")).otherwise(bpm.cast("string")), F.lit(" BPM")))
    parts = F.array(or_else(genre, ""), or_else(section, ""), F.coalesce(feel, F.lit("")), F.coalesce(tempo, F.lit("")), or_else(key, ""))
    return F.array_join(F.array_distinct(F.filter(parts, lambda x: x != "")), ", ")


def overridden(prompt: Column, bpm: int, key: str) -> Column:
    """The prompt with another tempo and key."""
    return F.regexp_replace(F.regexp_replace(prompt, r"(?i)\b[0-9]+ ?bpm\b", f"{bpm} BPM"), r"\b[A-G][#b]? (?i:major|minor)\b", key)


def weighted_merge(tensors: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean of the tensors that all checkpoints have, by name; weights are normalised."""
    total = weights.agg(F.sum("w").alias("t"), F.count("*").alias("k"))
    by = tensors.join(F.broadcast(weights), "checkpoint").select("name", "w", F.posexplode("values").alias("i", "x"))  # one row a checkpoint
    summed = by.groupBy("name", "i").agg(F.sum(F.col("x") * F.col("w")).alias("s"), F.count("*").alias("n"))
    return summed.join(F.broadcast(total)).where("n = k").select("name", "i", rounded(F.col("s") / F.col("t"), 6).alias("value"))  # one row


def largest_changes(one: DataFrame, two: DataFrame, k: int) -> DataFrame:
    """Tensors of equal shape by their largest absolute change."""
    both = one.select("name", F.col("values").alias("a")).join(two.select("name", F.col("values").alias("b")), "name").where(F.size("a") == F.size("b"))
    gap = F.zip_with("a", "b", lambda x, y: F.abs(x - y))
    return both.select("name", rounded(F.array_max(gap), 6).alias("max_change"), rounded(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x) / F.size("a"), 6).alias("mean_change")).orderBy(F.desc("max_change"), "name").limit(k)
