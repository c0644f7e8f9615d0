"""Recipes, prompt sets, song sheets, checkpoints and runs."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import tails
from corpusmill.functions.columns import rounded, syllables
from corpusmill.functions.lineage import first_of
from corpusmill.operators import corpus, extras, vectors
from corpusmill.operators.text import rhyme_key

#: Catalogs as tables.
ARTISTS = "id string, name string, aliases array<string>, topics array<string>, bpm_low int, bpm_high int"
GENRES = "name string, moods array<string>, topics array<string>, energy double, density int"
#: Other words for a genre, its own first (fixed values).
SYNONYMS = {
    "melodic trap": ("trap", "melodic trap", "dark trap"),
    "ambient": ("ambient", "atmospheric", "cinematic ambient"),
    "orchestral": ("orchestral", "cinematic strings", "film score"),
}
#: Bars of a section (fixed values).
BARS = {"intro": 4, "verse": 16, "hook": 8, "chorus": 8, "bridge": 8, "pre-chorus": 4, "outro": 4, "full-song": 16}


# prompts


def variants(prompt: Column, energies: list[str], n: int = 4) -> Column:
    """Up to n distinct phrasings: as it is, first clause last, another genre word, the next energy word, without commas.

    The genre word is chosen by a hash of the prompt; of several genres or
    energy words the first listed one counts.
    """
    clauses = F.filter(F.transform(F.split(prompt, ","), lambda x: F.trim(x)), lambda x: x != "")
    turned = F.when(F.size(clauses) > 1, F.array_join(F.concat(F.slice(clauses, 2, F.size(clauses) - 1), F.slice(clauses, 1, 1)), ", "))
    genre, energy = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, words in reversed(SYNONYMS.items()):
        other = F.element_at(F.array(*[F.lit(w) for w in words[1:]]), (F.pmod(F.xxhash64(prompt), F.lit(len(words) - 1)) + 1).cast("int"))
        genre = F.when(F.contains(prompt, F.lit(name)), F.replace(prompt, F.lit(name), other)).otherwise(genre)
    for i, word in reversed(list(enumerate(energies))):
        energy = F.when(F.contains(prompt, F.lit(word)), F.replace(prompt, F.lit(word), F.lit(energies[(i + 1) % len(energies)]))).otherwise(energy)
    short = F.replace(F.replace(F.array_join(clauses, " "), F.lit(" and "), F.lit(" ")), F.lit(" with "), F.lit(" "))
    return F.slice(F.array_distinct(F.array_compact(F.array(prompt, turned, genre, energy, short))), 1, max(n, 1))


def prompt_set(traps: DataFrame, position: str, prefix: str, flag: str, start_seed: int, n: int) -> DataFrame:
    """The first n hand-made prompts (a short list) with an id, a seed and a flag that lets reports keep them apart."""
    nth = F.row_number().over(Window.orderBy(position)) - 1
    rows = traps.orderBy(position).limit(n).withColumn("nth", nth)
    return rows.select(F.concat(F.lit(f"{prefix}_"), F.lpad(F.col("nth").cast("string"), 2, "0")).alias("id"), *[c for c in traps.columns if c != position], F.lit(0.5).alias("energy"), (F.col("nth") + start_seed).alias("seed"), F.lit(True).alias(flag))


def paraphrases(groups: DataFrame, group: str, phrasings: str, start_seed: int) -> DataFrame:
    """A prompt for each phrasing; those of one group share an intent."""
    intent = F.concat(F.lit("para_"), F.lpad(F.col(group).cast("string"), 2, "0"))
    rows = groups.select("*", F.posexplode(phrasings).alias("nth", "description"))
    return rows.select(F.concat(intent, F.lit("_"), "nth").alias("id"), intent.alias("intent"), "description", (F.lit(start_seed) + F.col(group) * 10 + F.col("nth")).alias("seed"), F.lit(True).alias("paraphrase"))


def sweep(rows: DataFrame, guidance: list[float], seeds: list[int], scorer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """What a pluggable generator or scorer makes of each row at each guidance and seed; it gets Arrow batches of the rows' columns, guidance and seed."""
    return extras.grid(rows, guidance=guidance, seed=seeds).mapInPandas(scorer, schema)


# recipes


def lookup(rows: DataFrame, name: str, catalog: DataFrame, *names: Column) -> DataFrame:
    """Rows with the catalog entry that the name means, null if none; ids before names before aliases, whatever the case.

    names: arrays of the entry's names, in falling precedence. The catalog is
    a hand-made table and small beside the rows; of several entries of one
    name, the first by id counts.
    """

    def called(a: Column, rank: int) -> Column:
        return F.transform(a, lambda x: F.struct(F.lower(F.trim(x)).alias("called"), F.lit(rank).alias("rank")))

    known = F.flatten(F.array(*[called(a, i) for i, a in enumerate(names)]))
    entry = F.struct(*catalog.columns)
    each = catalog.select(entry.alias("entry"), F.explode(known).alias("k"), F.col(catalog.columns[0]).alias("first"))
    best = each.where("k.called <> ''").groupBy(F.col("k.called").alias("called")).agg(F.min_by("entry", F.struct("k.rank", "first")).alias("entry"))
    return rows.join(best, F.lower(F.trim(F.coalesce(F.col(name), F.lit("")))) == F.col("called"), "left").drop("called")


def recipes(requests: DataFrame, artists: DataFrame, genres: DataFrame, default_artist: str) -> DataFrame:
    """Requests (artist, genre, mood, topic) with canonical names; blanks get the genre's mood, the artist's or genre's topic."""
    found = lookup(requests, "artist", artists, F.array("id"), F.array("name"), F.coalesce("aliases", F.array())).withColumnRenamed("entry", "_artist")
    found = lookup(found, "genre", genres, F.array("name")).withColumnRenamed("entry", "_genre")
    given = lambda c: F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))
    first = lambda c: F.try_element_at(F.col(c), F.lit(1))
    made = {
        "artist": F.coalesce("_artist.id", F.lit(default_artist)),
        "genre": F.coalesce("_genre.name", F.lit("")),
        "mood": F.coalesce(given("mood"), first("_genre.moods"), F.lit("dark")),
        "topic": F.coalesce(given("topic"), first("_artist.topics"), first("_genre.topics"), F.lit("struggle")),
    }
    return found.withColumns(made).drop("_artist", "_genre")


def surprise(requests: DataFrame, key: str, artists: DataFrame, genres: DataFrame, moods: list[str], seed: int) -> DataFrame:
    """A recipe drawn from the catalogs for each key, the same on every run."""
    whole = lambda df: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias("all"))  # noqa: E731  hand-made catalogs
    draw = lambda xs, part: F.element_at(xs, (F.pmod(F.xxhash64(F.lit(seed), F.lit(part), key), F.size(xs)) + 1).cast("int"))
    rows = requests.select(key).join(F.broadcast(whole(artists).withColumnRenamed("all", "a"))).join(F.broadcast(whole(genres).withColumnRenamed("all", "g")))
    rows = rows.select(key, draw(F.col("a"), "artist").alias("x"), draw(F.col("g"), "genre").alias("y"))
    topic = F.when(F.size("x.topics") > 0, draw(F.col("x.topics"), "topic")).otherwise("struggle")
    return rows.select(key, F.col("x.id").alias("artist"), F.col("y.name").alias("genre"), draw(F.array(*[F.lit(m) for m in moods]), "mood").alias("mood"), topic.alias("topic"), F.col("y.energy").alias("energy"), F.col("y.density").alias("density"))


def biased(rows: DataFrame, profile: DataFrame, strength: float = 0.5) -> DataFrame:
    """Recipes with the best rated value of each dimension in place, from strength 0.5 on.

    profile: (dim, value, score), of which one row a dimension is used.
    """
    if strength < 0.5:
        return rows
    dims = [c for c in ("artist", "mood", "topic", "genre") if c in rows.columns]
    best = profile.groupBy().agg(*[F.min_by(F.when(F.col("dim") == c, F.col("value")), F.when(F.col("dim") == c, F.struct((-F.col("score")).alias("s"), "value"))).alias(f"_{c}") for c in dims])
    return rows.join(F.broadcast(best)).withColumns({c: F.coalesce(f"_{c}", c) for c in dims}).drop(*[f"_{c}" for c in dims])


def corpus_grid(artists: DataFrame, per_artist: int, moods: list[str], topics: list[str], keys: list[str], seed: int) -> DataFrame:
    """per_artist songs to write for each artist: moods, topics and keys in turn, tempo by hash within the artist's range."""
    at = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i % len(xs) + 1).cast("int"))
    i, span = F.col("i"), F.col("bpm_high") - F.col("bpm_low") + 1
    rows = artists.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(per_artist - 1)))).withColumns({"mood": at(moods, i), "topic": at(topics, i * 7 + seed), "key": at(keys, i + seed)})
    title = F.concat(F.lit("[synth "), F.lpad((i + 1).cast("string"), 3, "0"), F.lit("] "), "mood", F.lit(" "), "topic")
    bpm = F.col("bpm_low") + F.pmod(F.xxhash64(F.lit(seed), "id", "i"), span)
    return rows.select("id", "i", title.alias("title"), "mood", "topic", "key", bpm.cast("double").alias("bpm"), (i + seed).alias("seed"))


# songs


def beat_context(analysis: Column) -> Column:
    """Tempo, key, feel, mean energy and sections of an analysis record; what it lacks gets defaults."""
    bars = F.create_map(*[F.lit(x) for kv in BARS.items() for x in kv])
    segments = F.coalesce(analysis["structure"]["segments"], F.array())

    def section(s: Column) -> Column:
        role = F.coalesce(F.nullif(s["role"], F.lit("")), F.nullif(s["label"], F.lit("")), F.lit("verse"))
        role = F.when(F.map_contains_key(bars, role), role).otherwise("verse")
        return F.struct(role.alias("role"), bars[role].alias("bars"), F.coalesce(s["energy"], F.lit(0.0)).alias("energy"))

    usual = F.array(*[F.struct(F.lit(x).alias("role"), F.lit(BARS[x]).alias("bars"), F.lit(0.0).alias("energy")) for x in ("intro", "verse", "hook", "verse", "hook", "outro")])
    energy = F.aggregate(segments, F.lit(0.0), lambda a, s: a + F.coalesce(s["energy"], F.lit(0.0))) / F.size(segments)
    return F.struct(
        F.coalesce(analysis["beat_grid"]["tempo"], F.lit(140.0)).alias("bpm"),
        F.coalesce(analysis["key"]["key"], F.lit("A minor")).alias("key"),
        F.coalesce(analysis["swing"]["feel"], F.lit("straight")).alias("swing"),
        F.when(F.size(segments) > 0, energy).otherwise(0.5).alias("energy"),
        F.when(F.size(segments) > 0, F.transform(segments, section)).otherwise(usual).alias("structure"),
    )


def mined_banks(lines: DataFrame, line: str, banks: int = 24, words: int = 12, least: int = 4) -> DataFrame:
    """(bank, words): the words that end lines, by rhyme; of the most frequent rhymes with ``least`` words or more, the most frequent words.

    All lines are counted; only the catalog that is kept is small.
    """
    last = F.reverse(F.regexp_extract(F.reverse(F.lower(line)), r"^[^a-z]*([a-z]{2,})", 1))  # from its end: lines may be long
    counted = lines.select(last.alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n")).withColumn("bank", rhyme_key(F.col("word"))).where("bank is not null")
    kept = first_of(counted, "bank", [F.desc("n"), "word"], words, "word")
    by = kept.groupBy("bank").agg(F.sum("n").alias("total"), F.transform(F.array_sort(F.collect_list(F.struct("nth", "word"))), lambda x: x["word"]).alias("words"))  # ``words`` a rhyme
    return by.where(F.size("words") >= least).orderBy(F.desc("total"), "bank").limit(banks).select("bank", "words")


def mined_templates(lines: DataFrame, line: str, n: int = 200, shortest: int = 3, longest: int = 8) -> DataFrame:
    """(template): the n most frequent lines of a few words, with {R} for their last one."""
    text = F.trim(F.lower(F.translate(line, "{}", "")))
    of = F.size(F.split(text, r"\s+", longest + 1))  # no further than tells
    template = F.regexp_replace(text, r"[a-z]{2,}[^a-z]*$", "{R}")
    found = lines.where(of.between(shortest, longest)).select(template.alias("template")).where(F.endswith("template", F.lit(" {R}")))
    return found.groupBy("template").agg(F.count("*").alias("times")).orderBy(F.desc("times"), "template").limit(n).select("template")


def verses(requests: DataFrame, key: str, templates: DataFrame, banks: DataFrame, spread: int = 2, seed: int = 0) -> DataFrame:
    """Lines of sections: (key, i, bank, template, line, syllables).

    requests: key, bars, target (syllables a line), scheme (AABB, ABAB or
    INTERNAL; any other rhymes throughout) and opener, which starts the first
    line. templates: template, with {R} where rhyme words go, the last one at
    the end; banks: bank, words. All are drawn by hashes of seed and key: a
    bank for each rhyme group, its words in turn, and templates within
    ``spread`` of the target (all, if none is) in turn, so that four of them
    never repeat within three lines. The catalogs are small: made by hand, or
    mined from lines of a corpus (``mined_banks``, ``mined_templates``).
    """
    sorted_all = lambda df: F.broadcast(df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias("all")))  # noqa: E731  catalogs
    parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a table of few bytes is one task's file, but of many lines
    every = requests.repartition(parts, key).join(sorted_all(templates.select("template", syllables(F.replace("template", F.lit("{R}"), F.lit("line"))).alias("n"))).withColumnRenamed("all", "t"))
    every = every.join(sorted_all(banks.select("bank", "words")).withColumnRenamed("all", "b"))
    mixed = lambda xs, of, *by: F.transform(F.sort_array(F.transform(xs, lambda x: F.named_struct(F.lit("h"), F.xxhash64(F.lit(seed), key, *by, of(x)), F.lit("x"), x))), lambda s: s["x"])
    near = F.filter("t", lambda t: F.abs(t["n"] - F.col("target")) <= spread)
    every = every.withColumn("near", near).withColumn("turns", F.slice(mixed(F.when(F.size("near") > 0, F.col("near")).otherwise(F.col("t")), lambda t: t["template"]), F.lit(1), F.greatest(F.lit(1), "bars")))
    scheme = F.upper("scheme")
    crossed = scheme.isin("ABAB", "INTERNAL")

    def bar(i: Column) -> Column:
        """All that a line needs, so that neither catalogs nor turns are carried to every line or made for it again."""
        group = F.when(scheme == "AABB", F.floor(i / 2)).when(crossed, i % 2).otherwise(0).cast("int")
        nth = F.when(scheme == "AABB", i % 2).when(crossed, F.floor(i / 2)).otherwise(i).cast("int")
        bank = F.get("b", F.pmod(F.xxhash64(F.lit(seed), key, group), F.size("b")).cast("int"))
        return F.struct(i.alias("i"), group.alias("g"), nth.alias("nth"), bank.alias("bank"), F.get("turns", i % F.size("turns"))["template"].alias("template"))

    made = every.select(key, "opener", F.transform(F.sequence(F.lit(0), F.col("bars") - 1), bar).alias("lines"))
    lines = made.select(key, "opener", F.explode_outer("lines").alias("l")).where("l is not null").select(key, "opener", "l.*")  # a plain explode has the lines made once more below, to tell whether there are any
    lines = lines.withColumn("words", mixed(F.col("bank.words"), lambda w: w, F.col("g")))
    word = lambda ahead: F.get("words", (F.col("nth") + ahead) % F.size("words"))
    ended = F.regexp_replace("template", r"\{R\}(?=[^{]*$)", "{E}")
    said = F.replace(F.replace(ended, F.lit("{R}"), word(2)), F.lit("{E}"), word(0))
    said = F.when((F.col("i") == 0) & (F.coalesce("opener", F.lit("")) != ""), F.concat_ws(" ", "opener", said)).otherwise(said)
    line = F.concat(F.upper(F.left(said, F.lit(1))), F.substring(said, F.lit(2), F.length(said)))
    return lines.select(key, "i", F.col("bank.bank").alias("bank"), "template", line.alias("line")).withColumn("syllables", syllables("line"))


def annotated(section: Column) -> Column:
    """A section's lines with their syllables and rhyme scheme."""
    rhyme = F.coalesce(section["rhyme"], F.lit("free"))
    return F.transform(section["lines"], lambda x: F.struct(x.alias("line"), syllables(x).alias("syllables"), rhyme.alias("rhyme")))


def sheet(song: Column) -> Column:
    """A song as Markdown: title, tempo and key, then each section with annotated lines and its ad-libs."""
    c = lambda x, other="": F.coalesce(x.cast("string"), F.lit(other))
    j = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])

    def part(s: Column) -> Column:
        head = j("\n## [", F.upper(c(s["role"], "?")), "] ", c(s["bars"], "?"), " bars · ", c(s["flow"]), " @ ", c(s["cadence"]), " · ", c(F.coalesce(F.nullif(s["artist"], F.lit("")), song["artist"])))
        lines = F.transform(annotated(s), lambda a: j("- ", a["line"], "  _(", c(a["syllables"]), " syll · rhyme ", a["rhyme"], ")_"))
        said = F.when(F.size(s["ad_libs"]) > 0, F.array(j("> ad-libs: ", F.array_join(F.transform(s["ad_libs"], lambda a: j("(", a, ")")), ", "))))
        return F.concat(F.array(head), F.coalesce(lines, F.array()), F.coalesce(said, F.array().cast("array<string>")))

    top = F.array(
        j("# ", c(song["artist"], "?"), " — ", c(song["mood"]), " / ", c(song["topic"])),
        j("**", c(F.bround(song["bpm"]).cast("long"), "0"), " BPM · ", c(song["key"], "?"), " · swing ", c(song["swing"], "?"), " · seed ", c(song["seed"], "0"), "**"),
    )
    return F.array_join(F.concat(top, F.flatten(F.transform(F.coalesce(song["sections"], F.array()), part))), "\n")


@F.pandas_udf(T.ArrayType(T.StringType()))
def text_diff(a: pd.Series, b: pd.Series, a_name: pd.Series, b_name: pd.Series) -> pd.Series:
    """Lines of the unified diff of two texts; a null text is an empty one, equal texts have none."""
    rows = zip(a.fillna(""), b.fillna(""), a_name.fillna(""), b_name.fillna(""), strict=True)
    return pd.Series([list(difflib.unified_diff(x.splitlines(), y.splitlines(), fromfile=p, tofile=q, lineterm="")) for x, y, p, q in rows])


# splits, checkpoints and runs


def split_summary(segments: DataFrame, song: str, ratios: tuple[float, float, float], seed: int, stratum: str | None = None) -> DataFrame:
    """Songs and segments of train, val and test; a song's segments stay together."""
    by = segments.groupBy(song).agg(F.count("*").alias("n"), *([F.min(stratum).alias("_stratum")] if stratum else []))
    part = F.coalesce(F.col("_stratum").cast("string"), F.lit("unknown")) if stratum else None
    return corpus.ratio_split(by, song, ratios, seed, part).groupBy("split").agg(F.count("*").alias("songs"), F.sum("n").alias("segments"))


def fold_summary(segments: DataFrame, song: str, k: int, seed: int) -> DataFrame:
    """Songs and segments that each fold trains and validates on."""
    by = corpus.folds(segments.groupBy(song).agg(F.count("*").alias("n")), song, k, seed).groupBy("fold").agg(F.count("*").alias("val_songs"), F.sum("n").alias("val_segments"))
    every = Window.partitionBy()  # k rows
    return by.withColumns({f"train_{x}": F.sum(f"val_{x}").over(every) - F.col(f"val_{x}") for x in ("songs", "segments")})


def checkpoint_registry(files: DataFrame, configs: DataFrame, suffixes: str = r"\.(safetensors|bin|pt|pth)$") -> DataFrame:
    """One row a checkpoint folder: weight files, MB, and parameters estimated from its config.

    files: (path, length, modified); configs: (path, text) of config.json
    files, of which broken ones tell nothing.
    """
    folder = lambda c: F.regexp_extract(c, "^(.*)/[^/]*$", 1)
    weights = F.col("path").rlike(suffixes)
    by = files.groupBy(folder("path").alias("folder")).agg(F.count_if(weights).alias("weight_files"), F.coalesce(F.sum(F.when(weights, F.col("length"))), F.lit(0)).alias("bytes"), F.max("modified").alias("modified"))
    parsed = F.from_json("text", "model_type string, hidden_size long, num_hidden_layers long")
    told = configs.select(folder("path").alias("folder"), parsed.alias("c")).select("folder", "c.model_type", (F.col("c.hidden_size") * F.col("c.hidden_size") * 4 * F.col("c.num_hidden_layers")).alias("n_params"))
    return by.join(told, "folder", "left").select(F.element_at(F.split("folder", "/"), -1).alias("name"), "folder", "weight_files", rounded(F.col("bytes") / 1e6, 1).alias("size_mb"), "model_type", "n_params", "modified")


def run_table(runs: DataFrame, order: str, n: int = 30) -> DataFrame:
    """The newest n runs with their durations as numbers where they are any, and the total time of all runs."""
    seconds = F.col("duration").try_cast("double")
    total = runs.agg(F.sum(seconds).alias("total_s"))
    return runs.withColumn("duration_s", seconds).orderBy(F.desc(order)).limit(n).join(F.broadcast(total)).drop("duration")


def best_adapter(adapters: DataFrame, name: str, loss: str) -> DataFrame:
    """The adapter of least loss; one without a loss only if none has any."""
    return adapters.agg(F.min_by(name, F.struct(F.coalesce(F.col(loss), F.lit(float("inf"))), name)).alias(name))


def tag_strip(rows: DataFrame, tags: str) -> DataFrame:
    """Each tag's mean score over the rows with any tags; a row without the tag counts as 0."""
    some = rows.where(F.size(tags) > 0).select(tags)
    n = some.agg(F.count("*").alias("n"))
    by = some.select(F.explode(tags).alias("tag", "score")).groupBy("tag").agg(F.sum("score").alias("s"))
    return by.join(F.broadcast(n)).select("tag", rounded(F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("mean"))


# reference statistics that are kept


def reference_moments(rows: DataFrame, vector: str) -> DataFrame:
    """n, mean and covariance of a set of vectors as a table to be written."""
    n, mean, cov = vectors.moments(rows, vector)
    return rows.sparkSession.createDataFrame([(n, mean.tolist(), cov.tolist())], "n long, mean array<double>, cov array<array<double>>")


def distance_from_moments(kept: DataFrame, rows: DataFrame, vector: str, eps: float = 1e-6) -> DataFrame:
    """Fréchet distance of a set of vectors from kept moments; null below two vectors."""
    import numpy as np

    far = None
    if rows.limit(2).count() == 2:
        ref, (_, mean, cov) = kept.first(), vectors.moments(rows, vector)
        eye = eps * np.eye(len(mean))
        far = round(tails.frechet(np.array(ref["mean"]), np.array(ref["cov"]) + eye, mean, cov + eye), 4)
    return rows.sparkSession.createDataFrame([(far,)], "frechet double")
