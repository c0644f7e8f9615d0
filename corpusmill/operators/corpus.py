"""Validation, counts, joins, diffs, duplicates and splits of a corpus manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.columns import multi, or_else, reasons, rounded
from corpusmill.functions.lineage import with_runs

#: Controlled vocabulary, and narrower terms (fixed values).
VOCABULARY = {"mood": ("bright", "calm", "dark"), "section": ("chorus", "intro", "outro", "verse")}
NARROWER = {("mood", "dark"): ("brooding", "tense"), ("mood", "calm"): ("dreamy", "mellow")}


def out_of_domain(tracks: DataFrame, low: float, high: float, excluded: list[str]) -> DataFrame:
    """Tracks with a tempo outside the closed range or an excluded tag, with reasons."""
    tags = F.concat(F.array(or_else("genre", "")), multi("mood"))
    why = reasons(
        (~F.col("bpm").between(low, high), F.format_string("bpm %.1f", "bpm")),
        (F.arrays_overlap(tags, F.array(*[F.lit(x) for x in excluded])), "excluded tag"),
    )
    return tracks.withColumn("ood_reasons", why).where(F.size("ood_reasons") > 0)


def issues(rows: DataFrame, key: str, *rules: tuple[Column, str]) -> DataFrame:
    """One row for each rule that a row breaks."""
    return rows.select(key, F.explode(reasons(*rules)).alias("issue"))


def manifest_issues(tracks: DataFrame) -> DataFrame:
    return issues(
        tracks,
        "source_id",
        (F.nullif("genre", F.lit("")).isNull(), "genre missing"),
        (F.size(multi("mood")) == 0, "mood missing"),
        (F.col("bpm").isNull(), "bpm missing"),
        (F.col("bpm") > 170, "bpm out of range"),
        (F.col("duration") < 5, "too short"),
        (F.try_to_number("energy", F.lit("9.9")).isNull() & F.col("energy").try_cast("double").isNull(), "energy no number"),
        (~F.col("energy").try_cast("double").between(0, 1), "energy out of range"),
    )


def label_issues(tracks: DataFrame, key: str, position: str) -> DataFrame:
    """Duplicate ids, and terms outside the vocabulary."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(position))
    twice = tracks.withColumn("nth", nth).where("nth > 1").select(F.col(key).cast("string").alias("key"), F.lit("duplicate id").alias("issue"))
    out = []
    for dim, known in VOCABULARY.items():
        unknown = F.array_except(multi(dim), F.array(*[F.lit(x) for x in known]))
        out.append(tracks.select(F.col(key).cast("string").alias("key"), F.explode(unknown).alias("t")).select("key", F.concat(F.lit(f"unknown {dim} "), "t").alias("issue")))
    for part in out:
        twice = twice.unionByName(part)
    return twice


def hierarchy_notes(tracks: DataFrame, key: str) -> DataFrame:
    """Broad terms for which narrower ones exist."""
    rows = [(dim, term, ", ".join(sorted(c))) for (dim, term), c in NARROWER.items()]
    known = F.broadcast(tracks.sparkSession.createDataFrame(rows, "dim string, term string, narrower string"))  # the vocabulary
    used = tracks.select(key, F.lit("mood").alias("dim"), F.explode(multi("mood")).alias("term"))
    return used.join(known, ["dim", "term"]).select(key, "dim", "term", "narrower")


def browse(tracks: DataFrame, genres: list[str], moods: list[str], section: str | None, like: str) -> DataFrame:
    has = lambda c, xs: F.exists(F.array(*[F.lit(x) for x in xs]), lambda v: F.contains(F.lower(c), F.lower(v)))
    keep = has("genre", genres) & has("mood", moods) & F.lower("source_id").contains(like.lower())
    return tracks.where(keep & (F.col("section") == section) if section else keep)


def search_cells(tracks: DataFrame, columns: list[str], text: str) -> DataFrame:
    """How many cells of each column contain the text."""
    hit = [F.count_if(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower()))).alias(c) for c in columns]
    one = tracks.agg(*hit)
    return one.unpivot([], columns, "field", "hits")


def value_counts(rows: DataFrame, dim: str, values: Column) -> DataFrame:
    """(dim, value, n) of an array of values; falsy ones are left out."""
    return rows.select(F.explode(values).alias("value")).where(F.nullif("value", F.lit("")).isNotNull()).groupBy("value").agg(F.count("*").alias("n")).select(F.lit(dim).alias("dim"), "value", "n")


#: Lower edges of tempo bins; the last closes at 400 (fixed values).
TEMPO_EDGES = (0, 70, 80, 90, 100, 110, 120, 130, 140, 150, 160, 200, 400)


def tempo_histogram(tracks: DataFrame, edges: tuple[int, ...] = TEMPO_EDGES) -> DataFrame:
    """Half-open bins; empty ones show 0."""
    bins = tracks.sparkSession.createDataFrame([(i, f"{a}-{b}") for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, label string")
    index = F.lit(None).cast("int")
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        index = F.when((F.col("bpm") >= a) & (F.col("bpm") < b), i).otherwise(index)
    n = tracks.select(index.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    return bins.join(n, "bin", "left").select("bin", "label", F.coalesce("n", F.lit(0)).alias("n"))


def corpus_summary(tracks: DataFrame) -> DataFrame:
    bpm = F.nullif("bpm", F.lit(0.0))
    return tracks.agg(
        F.count("*").alias("n"), rounded(F.sum("duration"), 2).alias("total_duration"), F.count(bpm).alias("bpm_n"), rounded(F.avg(bpm)).alias("bpm_mean"), F.min(bpm).alias("bpm_min"), F.max(bpm).alias("bpm_max")
    )


def inventory_summary(tracks: DataFrame) -> DataFrame:
    """By sample rate and channels, with totals (a cube)."""
    return tracks.cube("sample_rate", "channels").agg(F.count("*").alias("n"), rounded(F.sum("duration"), 2).alias("seconds"), F.min("duration").alias("shortest"), F.max("duration").alias("longest"), F.sum("size_bytes").alias("bytes"))


def co_occurrence(tracks: DataFrame, dims: list[str]) -> DataFrame:
    """Combinations of values with their share; list cells by sorted values."""
    keys = [or_else(F.array_join(F.array_sort(multi(d)), ",") if d == "mood" else d, "?").alias(d) for d in dims]
    by = tracks.select(*keys).groupBy(*dims).agg(F.count("*").alias("count"))
    total = by.agg(F.sum("count").alias("total"))
    return by.join(F.broadcast(total)).select(*dims, "count", rounded(F.col("count") / F.col("total")).alias("share"))  # one row


def agreement(pairs: DataFrame, field: str) -> DataFrame:
    """Exact agreement of two annotators' tag sets a and b, and mean kappa over tags."""
    exact = pairs.agg(F.count("*").alias("rows"), rounded(F.avg(F.when(F.array_sort(F.array_distinct("a")) == F.array_sort(F.array_distinct("b")), 1.0).otherwise(0.0))).alias("exact_agreement"))
    tags = pairs.select("a", "b", F.explode(F.array_union("a", "b")).alias("tag"))
    one, two = F.array_contains("a", F.col("tag")), F.array_contains("b", F.col("tag"))
    by = tags.groupBy("tag").agg(F.count_if(one & two).alias("yy"), F.count_if(one & ~two).alias("yn"), F.count_if(~one & two).alias("ny"))
    n = F.col("rows")
    nn = n - F.col("yy") - F.col("yn") - F.col("ny")
    po = (F.col("yy") + nn) / n
    pe = ((F.col("yy") + F.col("yn")) * (F.col("yy") + F.col("ny")) + (F.col("ny") + nn) * (F.col("yn") + nn)) / (n * n)
    kappa = by.join(F.broadcast(exact)).agg(rounded(F.avg(F.when(pe == 1, 0.0).otherwise((po - pe) / (1 - pe)))).alias("kappa"), F.count("*").alias("tags"))
    return exact.join(kappa).select(F.lit(field).alias("field"), "rows", "exact_agreement", "kappa", "tags")  # one row each


def majority_agreement(votes: DataFrame, item: str, choice: str, rater: str) -> DataFrame:
    """Mean over items of the largest choice's share, and distinct raters."""
    by = votes.groupBy(item, choice).agg(F.count("*").alias("n")).groupBy(item).agg(F.max("n").alias("top"), F.sum("n").alias("all"))
    mean = by.agg(F.count("*").alias("n_items"), F.sum("all").alias("n_ratings"), rounded(F.avg(F.col("top") / F.col("all"))).alias("agreement"))
    return mean.join(votes.agg(F.count_distinct(rater).alias("n_raters")))  # one row each


def taste_profile(votes: DataFrame, dims: list[str], score: str) -> DataFrame:
    """Share of each value in its dimension, by positive scores."""
    long = votes.where(F.col(score) > 0).unpivot([score], dims, "dim", "value").where(F.nullif("value", F.lit("")).isNotNull())
    by = long.groupBy("dim", "value").agg(F.sum(score).alias("s"))
    return by.select("dim", "value", rounded(F.col("s") / F.sum("s").over(Window.partitionBy("dim"))).alias("share"))


def unused_terms(tracks: DataFrame) -> DataFrame:
    """Vocabulary terms that no track uses."""
    rows = [(d, t) for d, terms in VOCABULARY.items() for t in terms]
    known = tracks.sparkSession.createDataFrame(rows, "dim string, term string")
    used = tracks.select(F.lit("mood").alias("dim"), F.explode(multi("mood")).alias("term")).unionByName(tracks.select(F.lit("section").alias("dim"), F.col("section").alias("term"))).distinct()
    return known.join(used, ["dim", "term"], "left_anti")


def version_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, removed or changed between two (path, sha256) tables."""
    both = old.withColumnRenamed("sha256", "was").join(new.withColumnRenamed("sha256", "now"), "path", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return both.withColumn("change", change).where(F.col("change").isNotNull()).select("path", "change")


def unified(one: DataFrame, two: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, a, b) where two rows of runs differ, null-safely."""
    cells = [F.col(f).cast("string").alias(f) for f in fields]
    a, b = (df.select(key, *cells).unpivot([key], fields, "field", v) for df, v in ((one, "a"), (two, "b")))
    return a.join(b, [key, "field"]).where(~F.col("a").eqNullSafe(F.col("b")))


def renamed_terms(cell: Column, names: dict[str, str]) -> Column:
    """Terms of a cell with new names, joined by |."""
    m = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.array_join(F.transform(multi(cell), lambda t: F.coalesce(F.try_element_at(m, t), t)), "|")


def split_leaks(files: DataFrame, order: list[str]) -> DataFrame:
    """Files whose content is also in an earlier split; files have path, split, sha256."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("split"))
    first = files.withColumn("place", place).groupBy("sha256").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last").drop("last")
    return files.withColumn("place", place).join(first, "sha256").where("place > first").select("path", "split")


def exact_duplicates(files: DataFrame, content: Column, key: str) -> DataFrame:
    """(canonical, members, n) of equal contents; sums by hash are shuffled, not contents."""
    by = files.select(key, F.sha2(content, 256).alias("h")).groupBy("h").agg(F.min(key).alias("canonical"), F.count("*").alias("n"))
    return by.where("n > 1").select("canonical", "n", "h")


def penalties(files: DataFrame, content: Column, key: str, penalty: float = 0.25) -> DataFrame:
    """0 for the canonical copy, the penalty for others; counts are added up before they are joined, so that many copies are no large group."""
    hashed = files.select(key, F.sha2(content, 256).alias("hash"))
    groups = hashed.groupBy("hash").agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1")
    return hashed.join(groups, "hash").select(key, F.when(F.col(key) == F.col("first"), 0.0).otherwise(penalty).alias("penalty"))


def interval_role(points: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """The role of the first interval [start, end) of its song that holds each point, else 'unknown'."""
    spans = intervals.select(F.col(key).alias("of"), "pos", "start", "end", "role")
    inside = (F.col(key) == F.col("of")) & (F.col("at") >= F.col("start")) & (F.col("at") < F.col("end"))
    found = points.join(spans, inside, "left").groupBy("point_id", key, "at").agg(F.min_by("role", "pos").alias("role"))
    return found.withColumn("role", F.coalesce("role", F.lit("unknown")))


def fixed_windows(rows: DataFrame, key: str, length: float, overlap: float, least: float) -> DataFrame:
    """Windows over each duration, with overlap; the tail is clamped and must have the least length."""
    step = length - overlap if overlap < length else max(0.0, length - least)
    n = F.greatest(F.lit(0), F.ceil((F.col("duration") - overlap) / step)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i * F.lit(step))
    w = rows.where(F.col("duration") > 0).select(key, "duration", F.explode(starts).alias("start"))
    end = F.least(F.col("start") + length, F.col("duration"))
    return w.select(key, rounded("start").alias("start"), rounded(end).alias("end")).where((F.col("end") - F.col("start") >= least) & (F.col("start") < F.col("duration")))


def bar_length(bpm: Column, target: float, beats: int, least: float) -> Column:
    """Whole bars not longer than the target, at least the least length."""
    bar = F.lit(60.0) * beats / bpm
    return F.greatest(F.lit(least), F.floor(F.lit(target) / bar) * bar)


def runs_of(rows: DataFrame, by: str, order: str, flag: Column, low: int, high: int) -> DataFrame:
    """Runs of rows with the flag set, of low to high rows: (by, first, last, n)."""
    marked = with_runs(rows.withColumn("flag", flag), by, order, "flag")
    found = marked.where("flag").groupBy(by, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
    return found.where(F.col("n").between(low, high)).drop("run")


# splits and samples: order by hash instead of a random stream


def by_hash(seed: int, *keys: str) -> Column:
    return F.xxhash64(F.lit(seed), *keys)


def ratio_split(groups: DataFrame, key: str, ratios: tuple[float, float, float], seed: int, stratum: Column | None = None) -> DataFrame:
    """train, val or test for each group, by hash order in its stratum; val and test get one from three groups on."""
    if stratum is None:
        rows = _numbered(groups, key, seed).withColumn("stratum", F.lit(1))
        n, nth = F.col("_all"), F.col("_nth") - 1
    else:
        rows = _numbered(groups.withColumn("stratum", stratum), key, seed, "stratum")
        n, nth = F.col("_all"), F.col("_nth") - 1
    val = F.when(n < 3, 0).otherwise(F.greatest(F.lit(1), F.bround(n * ratios[1])))
    test = F.when(n < 3, 0).otherwise(F.greatest(F.lit(1), F.bround(n * ratios[2])))
    which = F.when(nth < val, "val").when(nth < val + test, "test").otherwise("train")
    return rows.withColumn("split", which).drop("_nth", "_all")


def _numbered(groups: DataFrame, key: str, seed: int, stratum: str | None = None) -> DataFrame:
    """Rows with _nth, from 1 on in hash order, and _all; of each stratum if given.

    Ranges of the hash are numbered each by itself, behind the counts of the
    1,023 others at most.
    """
    h = by_hash(seed, key)
    whole = stratum or "_whole"
    rows = groups.withColumn("_cell", F.shiftright(h, 54))
    rows = rows if stratum else rows.withColumn(whole, F.lit(0))
    counts = rows.groupBy(whole, "_cell").agg(F.count("*").alias("_n"))
    own = Window.partitionBy(whole)
    before = F.sum("_n").over(own.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    placed = counts.select(F.col(whole).alias("_of"), F.col("_cell").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(own).alias("_all"))
    nth = F.col("_before") + F.row_number().over(Window.partitionBy(whole, "_cell").orderBy(h, key))
    joined = rows.join(placed, F.col(whole).eqNullSafe(F.col("_of")) & (F.col("_cell") == F.col("_at"))).withColumn("_nth", nth)
    return joined.drop("_cell", "_before", "_of", "_at", *([] if stratum else [whole]))


def artist_split(songs: DataFrame, by: str, key: str, val: float, test: float, seed: int) -> DataFrame:
    """test, val or train for each song, by hash order among its artist's: with ten songs or more at least one each, else all train."""
    rows = _numbered(songs, key, seed, by)
    n, nth = F.col("_all"), F.col("_nth") - 1
    share = lambda p: F.when(n < 10, 0).otherwise(F.greatest(F.lit(1), F.bround(n * p)))
    which = F.when(nth < share(test), "test").when(nth < share(test) + share(val), "val").otherwise("train")
    return rows.withColumn("split", which).drop("_nth", "_all")


def folds(groups: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """Contiguous slices of the hash order, sizes one apart at most."""
    return _numbered(groups, key, seed).withColumn("fold", F.floor((F.col("_nth") * k - 1) / F.col("_all")).cast("int")).drop("_nth", "_all")


def balanced(rows: DataFrame, label: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows spread over the labels; small classes are topped up from large ones, round by round."""
    placed = _numbered(rows, key, seed, label).withColumnsRenamed({"_nth": "round", "_all": "class_size"})
    return placed.orderBy("round", F.desc("class_size"), label).limit(n)


#: Sections of the evaluation grid with what their prompts say (fixed values).
SECTION_PROMPTS = (
    ("intro", "dark piano loop, atmospheric pads", "low energy"),
    ("verse", "restrained snare, deep 808 bass", "narrative mood, medium energy"),
    ("pre-chorus", "building strings, driving snare, trap hi-hats", "building tension"),
    ("chorus", "heavy 808 bass, autotune vocals, trap hi-hats", "memorable melodic hook, high energy"),
    ("bridge", "stripped-back piano, soft strings", "reflective mood"),
    ("outro", "fading piano, reduced drums", "fading out, reflective mood"),
)
#: Tempos of the grid and the keys that its tempos cycle through (fixed values).
GRID_TEMPOS = (72, 78, 84, 96, 130, 140, 155)
GRID_KEYS = ("A minor", "C minor", "F minor", "E minor", "D minor")
#: Prompts outside of the grid's domain: id, section, genre, tempo, key, text (fixed values).
OTHER_PROMPTS = (
    ("ood_ambient_060", "full-song", "ambient", 60, "G minor", "ambient full-song, 60 BPM, G minor, slow pads, airy flute, dreamy calm atmosphere"),
    ("ood_orchestral_100", "full-song", "orchestral", 100, "D major", "orchestral full-song, 100 BPM, D major, sweeping strings, heroic brass, epic choir"),
)


def nearest_tempo(bpm: str) -> Column:
    """The grid's tempo that is nearest, the lower of two."""
    far = F.transform(F.array(*[F.lit(t) for t in GRID_TEMPOS]), lambda t: F.struct(F.abs(t - F.col(bpm)).alias("far"), t.alias("t")))
    return F.array_min(far)["t"]


def missing_prompts(rows: DataFrame, by: str, section: str, tempo: Column) -> DataFrame:
    """(by, id, n): how often each checkpoint has been tried near each prompt of the grid, 0 for those that are still to do."""
    grid = prompt_grid(rows.sparkSession)
    tried = rows.groupBy(by, F.col(section).alias("section"), tempo.alias("bpm")).agg(F.count("*").alias("n"))
    every = rows.select(by).distinct().join(F.broadcast(grid.select("id", "section", "bpm")))  # 44 prompts a checkpoint
    return every.join(tried, [by, "section", "bpm"], "left").select(by, "id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def prompt_grid(spark: SparkSession, first_seed: int = 42) -> DataFrame:
    """The fixed evaluation prompts: every section at every tempo, keys cycling with the tempos, then the two outside of the domain."""
    sections = spark.createDataFrame([(i, *x) for i, x in enumerate(SECTION_PROMPTS)], "k int, section string, phrasing string, tail string")
    tempos = spark.createDataFrame([(j, b, GRID_KEYS[j % len(GRID_KEYS)]) for j, b in enumerate(GRID_TEMPOS)], "j int, bpm int, key string")
    every = sections.join(F.broadcast(tempos))  # 6 by 7 rows
    grid = every.select(
        F.concat_ws("_", "section", F.lpad(F.col("bpm").cast("string"), 3, "0"), F.replace(F.lower("key"), F.lit(" "), F.lit(""))).alias("id"),
        "section",
        F.lit("melodic trap").alias("genre"),
        "bpm",
        "key",
        (F.col("k") * len(GRID_TEMPOS) + F.col("j") + first_seed).alias("seed"),
        F.concat_ws(", ", "section", F.concat("bpm", F.lit(" BPM")), "key", "phrasing", "tail").alias("description"),
    )
    n = len(SECTION_PROMPTS) * len(GRID_TEMPOS)
    others = spark.createDataFrame([(*x[:5], first_seed + n + i, x[5]) for i, x in enumerate(OTHER_PROMPTS)], "id string, section string, genre string, bpm int, key string, seed int, description string")
    return grid.unionByName(others)
