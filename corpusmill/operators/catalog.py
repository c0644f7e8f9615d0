"""Lookups, naming rules, prompts and plans over catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.columns import or_else, rounded
from corpusmill.operators import statistics as st
from corpusmill.operators.vectors import blocks, matched

#: Words of a file name and the mood they stand for, in order of precedence (fixed values).
VIBES = (("night", "dark"), ("sun", "bright"), ("rain", "calm"), ("train", "warm"), ("val", "cool"))


def without_banned(rows: DataFrame, text: str, banned: list[str]) -> DataFrame:
    """Rows whose text has none of the terms, whatever the case; blank terms ban nothing."""
    terms = [t.strip().lower() for t in banned if t.strip()]
    bad = F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower(text), t)) if terms else F.lit(False)
    return rows.where(~bad)


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def vibe(path: Column | str) -> Column:
    out = F.lit("neutral")
    for word, mood in reversed(VIBES):
        out = F.when(F.contains(F.lower(path), F.lit(word)), mood).otherwise(out)
    return out


def training_pairs(audio: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Each clip's description: by its own stem, else by what stands before ``_seg``."""
    own = texts.select(F.col(key).alias("_k1"), F.col("description").alias("_d1"))
    song = texts.select(F.col(key).alias("_k2"), F.col("description").alias("_d2"))
    prefix = F.regexp_extract("stem", "^(.*?)(_seg.*)?$", 1)
    out = audio.join(own, F.col("stem") == F.col("_k1"), "left").join(song, prefix == F.col("_k2"), "left")
    return out.withColumn("description", F.coalesce("_d1", "_d2")).where("description is not null").select("stem", "description")


def resolved(versions: DataFrame, ref: str) -> DataFrame:
    """The first version of this name, else of this label."""
    hit = F.when(F.col("version") == ref, 0).when(F.col("label") == ref, 1)
    return versions.withColumn("hit", hit).where("hit is not null").orderBy("hit", "at").limit(1).drop("hit")


def template(bpm: Column, key: Column, density: Column) -> Column:
    """A prompt from features."""
    pace = F.when(bpm < 80, "slow").when(bpm < 110, "mid-tempo").when(bpm < 140, "upbeat").otherwise("fast")
    busy = F.when(density > 0.6, "dense").when(density < 0.3, "sparse")
    return F.concat_ws(", ", F.when(bpm.isNotNull(), F.concat(pace, F.lit(" track"))), F.when(or_else(key, "") != "", F.concat(F.lit("in "), key)), busy)


def custom_tokens(rows: DataFrame, column: str) -> DataFrame:
    """Normalised tokens <x>, each once: lower case, runs of other characters as _, 2 to 32 characters."""
    t = F.regexp_replace(F.regexp_replace(F.lower(column), "[^a-z0-9]+", "_"), "^_|_$", "")
    return rows.select(t.alias("t")).where(F.length("t").between(2, 32)).distinct().select(F.concat(F.lit("<"), "t", F.lit(">")).alias("token"))


def perturbed(prompt: Column, key: Column, seed: int, word: str, other: str) -> Column:
    """The prompt with the first ``word`` replaced, by a coin that a hash throws."""
    return F.when(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(2)) == 0, F.regexp_replace(prompt, f"^(.*?){word}", f"$1{other}")).otherwise(prompt)


def chord_mood(chords: Column) -> Column:
    """Dark from half minor chords on, bittersweet from a quarter, else bright."""
    share = F.size(F.filter(chords, lambda c: F.endswith(c, F.lit("m")))) / F.nullif(F.size(chords), F.lit(0))
    return F.when(share >= 0.5, "dark").when(share >= 0.25, "bittersweet").when(share.isNotNull(), "bright").otherwise("unknown")


def order_score(roles: Column, target: Column) -> Column:
    """0 if the target role is absent, 1 where it belongs (intro first, outro last, others anywhere), else 0.5."""
    there = F.array_contains(roles, target)
    fits = F.when(target == "intro", F.try_element_at(roles, F.lit(1)) == target).when(target == "outro", F.try_element_at(roles, F.lit(-1)) == target).otherwise(True)
    return F.when(~there, 0.0).when(fits, 1.0).otherwise(0.5)


def batch_plan(model_bytes: Column, memory_bytes: Column, sample_bytes: Column, headroom: float = 0.15) -> Column:
    """How many samples fit beside the model, and the widest number format that lets it fit."""
    free = memory_bytes * (1 - headroom)
    kind = F.when(model_bytes <= free, "fp32").when(model_bytes / 2 <= free, "fp16").when(model_bytes / 4 <= free, "int8").when(model_bytes / 8 <= free, "int4")
    size = F.when(kind == "fp32", model_bytes).when(kind == "fp16", model_bytes / 2).when(kind == "int8", model_bytes / 4).otherwise(model_bytes / 8)
    return F.struct(kind.alias("format"), F.when(kind.isNotNull(), F.greatest(F.lit(1), F.floor((free - size) / sample_bytes))).cast("long").alias("batch"))


def routed(rows: DataFrame, key: str, share: float) -> DataFrame:
    """Champion or challenger for each key, the same on every run."""
    part = F.pmod(F.xxhash64(key), F.lit(1_000_000)) / 1_000_000.0
    return rows.withColumn("route", F.when(part < min(1.0, max(0.0, share)), "champion").otherwise("challenger"))


def flow(bpm: Column, energy: Column) -> Column:
    return F.when(bpm >= 140, "triplet").when((bpm >= 110) & (energy > 0.5), "staccato").when(bpm < 80, "laid-back").otherwise("steady")


def cycled_prompts(rows: DataFrame, key: str, genre: str, mood: str, seed: int = 42) -> DataFrame:
    """A prompt for each row: the rows' genres and moods in turn, by the key, with tempos by hash. The terms are a vocabulary, so few."""
    terms = rows.agg(*[F.array_sort(F.collect_set(c)).alias(f"_{c}") for c in (genre, mood)])  # one row
    at = lambda c: F.element_at(f"_{c}", (F.col(key) % F.size(f"_{c}") + 1).cast("int"))
    bpm = 60 + F.pmod(F.xxhash64(F.lit(seed), key), F.lit(120))
    return rows.select(key).join(F.broadcast(terms)).select(F.col(key).alias("i"), at(genre).alias("genre"), at(mood).alias("mood"), bpm.alias("bpm"), (F.col(key) + seed).alias("seed"))


def tags_for(rows: DataFrame, vocabulary: DataFrame, key: str, vector: str, k: int, least: float) -> DataFrame:
    """Each row's k best vocabulary terms, of which those below the least similarity are then left out."""

    def top(a, b):
        import numpy as np
        import pandas as pd

        unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        out, terms = [], unit(b.x)
        for some in a.slices(b):
            sims = np.round(unit(some.x) @ terms.T, 6) + 0.0
            for q, s in zip(some.ids, sims, strict=True):
                out += [(q, b.ids[j], s[j]) for j in np.lexsort((b.ids, -s))[:k]]
        return pd.DataFrame(out, columns=["id", "term", "similarity"])

    met = matched(blocks(rows, key, vector), blocks(vocabulary, key, vector), top, "id long, term long, similarity double")
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "term"))
    return met.withColumn("nth", nth).where((F.col("nth") <= k) & (F.col("similarity") >= least)).select("id", "term")


def drift_report(rows: DataFrame, current: Column, continuous: list[str], discrete: list[str], p: float = 0.05, limit: float = 0.25) -> DataFrame:
    """One row a feature: for numbers the means and their difference, the distance's p; the stability index; whether it drifted."""
    out = None
    for name in continuous:
        far = st.ks(rows, name, current).withColumn("ks_pvalue", rounded(st.ks_p("distance", "n", "m"), 6))
        was, now = F.avg(F.when(~current, F.col(name))), F.avg(F.when(current, F.col(name)))
        means = rows.agg(rounded(was).alias("reference_mean"), rounded(now).alias("current_mean"), rounded(now - was).alias("delta"))
        one = far.join(st.psi(rows, name, current).select("psi")).join(means)  # one row each
        one = one.select(F.lit(name).alias("feature"), F.lit("continuous").alias("kind"), "reference_mean", "current_mean", "delta", "ks_pvalue", "psi", (F.col("ks_pvalue") < p).alias("drifted"))
        out = one if out is None else out.unionByName(one)
    none = [F.lit(None).cast("double").alias(c) for c in ("reference_mean", "current_mean", "delta", "ks_pvalue")]
    for name in discrete:
        one = st.category_psi(rows, name, current).select(F.lit(name).alias("feature"), F.lit("discrete").alias("kind"), *none, "psi", (F.col("psi") > limit).alias("drifted"))
        out = one if out is None else out.unionByName(one)
    return out
