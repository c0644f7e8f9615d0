"""Readers of project files: JSON in any wrapping, labels, songs, logs, file hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.columns import multi
from corpusmill.functions.lineage import saved

EVAL_SCHEMA = (
    "experiment_id string, checkpoint string, adapter string, prompt string, seed int, n_seeds int, ok_seeds int, section string, genre string, key string, bpm_target double, "
    "audio_path string, detected_bpm double, deviation double, clap_score double, clap_per_tag map<string,double>, human_rating double, status string, notes string"
)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or pattern has any file, in whatever store Spark reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def eval_results(spark: SparkSession, path: str, schema: str = EVAL_SCHEMA) -> DataFrame:
    """Result rows of JSON lines; a missing file is empty, a malformed line an error."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_objects(value: str):
    """The texts of the objects of a JSON text: itself, an array's, or else those of its lines."""
    text = F.trim(F.translate(value, "\ufeff\r\n\t", "    "))
    # between brackets nothing may follow a value but another one
    listed = lambda x: F.try_parse_json(F.concat(F.lit("["), x, F.lit("]")))
    alone = lambda x: listed(x).isNotNull() & F.try_variant_get(listed(x), "$[1]", "string").isNull()
    whole = alone(F.col(value))
    is_object = lambda x: x.rlike(r"^\s*\{")
    items = F.filter(F.from_json(value, "array<string>"), is_object)
    lines = F.filter(F.split(value, "\r\n|\r|\n"), lambda x: is_object(x) & alone(x))
    return F.when(whole & F.startswith(text, F.lit("[")), items).when(whole & F.startswith(text, F.lit("{")), F.array(value)).when(~whole, lines)


def tolerant_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON object, a JSON array or JSON lines; bad lines are skipped.

    A file that is one value as a whole, however it is laid out, is that value:
    an object is a row, an array its objects. Only else its lines are read.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    kind = T._parse_datatype_string(schema)
    text = spark.read.text(path, wholetext=True).select("value")
    row = text.select(F.explode(F.transform(json_objects("value"), lambda x: F.from_json(x, kind))).alias("r"))
    return row.where("r is not null").select("r.*")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Label rows keyed by id: blank ids dropped, the last of an id kept, lists split, energies as numbers or null.

    Of several files the last one in the order of their names is the last.
    """
    read = spark.read.option("header", True).csv(path)
    key = read.columns[0]
    raw = read.select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("i")).alias("_at"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_at")))
    kept = raw.where(F.trim(F.coalesce(key, F.lit(""))) != "").withColumn("_n", nth).where("_n = 1").drop("_n", "_at")
    for c in ("mood", "instruments"):
        if c in kept.columns:
            kept = kept.withColumn(c, multi(c))
    return kept.withColumn("energy", F.col("energy").try_cast("double")) if "energy" in kept.columns else kept


def rap_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(artist, title, pos, line) of a lyric file of one line a row."""
    rows = spark.read.option("header", True).option("multiLine", True).csv(path)
    return rows.select("artist", F.col("song").alias("title"), F.monotonically_increasing_id().alias("pos"), F.col("lyric").alias("line"))


def song_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(artist, title, lines) of text files named 'Artist - Title.txt'."""
    name = F.regexp_extract(F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))), r"^(.*)\.[^.]*$", 1)
    rows = spark.read.text(path, wholetext=True).select(name.alias("name"), "value")
    title = F.when(F.contains("name", F.lit(" - ")), F.regexp_extract("name", r" - (.*)$", 1)).otherwise(F.col("name"))
    artist = F.when(F.contains("name", F.lit(" - ")), F.regexp_extract("name", r"^(.*?) - ", 1)).otherwise(F.lit("unknown"))
    return rows.select(artist.alias("artist"), title.alias("title"), F.filter(F.transform(F.split("value", "\r?\n"), lambda x: F.trim(x)), lambda x: x != "").alias("lines"))


#: Names under which song files call the same things (fixed values).
ARTIST_NAMES, TITLE_NAMES, TEXT_NAMES = ("artist", "artist_name"), ("title", "song", "name", "track_name"), ("lyrics", "lyric", "text")


def _first_of(names: tuple[str, ...], have: list[str]):
    held = [F.nullif(F.trim(F.col(f"`{n}`").cast("string")), F.lit("")) for n in names if n in have]
    return F.coalesce(*held, F.lit(None).cast("string"))


def _text_lines(text):
    return F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def _records(rows: DataFrame) -> DataFrame:
    """(artist, title, lines) of rows that have them under one of their names; rows without a text go."""
    found = rows.select(_first_of(ARTIST_NAMES, rows.columns).alias("artist"), _first_of(TITLE_NAMES, rows.columns).alias("title"), _text_lines(_first_of(TEXT_NAMES, rows.columns)).alias("lines"))
    return found.where(F.size("lines") > 0).select(F.coalesce("artist", F.lit("unknown")).alias("artist"), F.coalesce("title", F.lit("untitled")).alias("title"), "lines")


def imported_songs(spark: SparkSession, folder: str) -> DataFrame:
    """(artist, title, lines) of all song files below a folder, each read by what it is.

    Names tell text files and JSON; the header of a CSV file tells whether its
    rows are lines (``song`` and ``lyric``) or whole songs. Files of other
    kinds are passed over. A CSV file's rows of one song are put together in
    their order.
    """
    seen = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).alias("kind"), F.split(F.substring("content", 1, 4_096).cast("string"), "\r?\n")[0].alias("head"))
    header = F.transform(F.split(F.lower("head"), ","), lambda x: F.trim(F.translate(x, '"', "")))
    by_line = F.array_contains(header, "song") & F.array_contains(header, "lyric")
    kinds = seen.select("path", F.when(F.col("kind") == "csv", F.when(by_line, "lines").otherwise("csv")).when(F.col("kind").isin("json", "jsonl"), "json").when(F.col("kind") == "txt", "txt").alias("kind"))
    paths: dict[str, list[str]] = {}
    for r in kinds.where("kind is not null").collect():  # names of files, as the scans below list them
        paths.setdefault(r["kind"], []).append(r["path"])
    found = spark.createDataFrame([], "artist string, title string, lines array<string>")
    if "txt" in paths:
        found = found.unionByName(song_texts(spark, paths["txt"]))
    if "json" in paths:
        fields = ", ".join(f"`{n}` string" for n in dict.fromkeys((*ARTIST_NAMES, *TITLE_NAMES, *TEXT_NAMES)))
        whole = spark.read.text(paths["json"], wholetext=True).select("value")
        inner = whole.select(F.coalesce(F.get_json_object("value", "$.songs"), F.get_json_object("value", "$.data"), "value").alias("value"))  # a list may be wrapped
        each = inner.select(F.explode(F.transform(json_objects("value"), lambda x: F.from_json(x, fields))).alias("r"))
        found = found.unionByName(_records(each.where("r is not null").select("r.*")))
    if "csv" in paths:
        found = found.unionByName(_records(spark.read.option("header", True).option("multiLine", True).csv(paths["csv"])))
    if "lines" in paths:
        rows = rap_csv(spark, paths["lines"])
        one = rows.groupBy("artist", "title").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: F.trim(x["line"])).alias("lines"))  # a song's own lines
        found = found.unionByName(one.select("artist", "title", F.filter("lines", lambda x: x != "").alias("lines")))
    return found


def run_log(spark: SparkSession, path: str, event: str | None = None, limit: int = 200) -> DataFrame:
    """The last rows of an event log, oldest first."""
    rows = spark.read.json(path).withColumn("_at", F.monotonically_increasing_id())
    rows = rows.where(F.col("event") == event) if event else rows
    return rows.orderBy(F.desc("_at")).limit(limit).orderBy("_at").drop("_at")


def file_hashes(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, sha256, size) of all files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


#: Columns of exported runs: name, where it stands in the export, whether it is a number (fixed values).
RUN_COLUMNS = (
    ("name", "tags.mlflow.runName", False),
    ("task", "tags.task", False),
    ("verdict", "tags.status", False),
    ("model", "params.model", False),
    ("device", "tags.device", False),
    ("seed", "params.seed", False),
    ("target_bpm", "metrics.target_bpm", True),
    ("detected_bpm", "metrics.detected_bpm", True),
    ("deviation", "metrics.deviation", True),
    ("duration_s", "metrics.duration_s", True),
    ("clap_score", "metrics.clap_score", True),
    ("n_tracks", "metrics.n_tracks", True),
    ("bpm_mean", "metrics.bpm_mean", True),
)


def tracking_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs exported as CSV with a column a parameter, tag and metric: 14 columns, run ids cut to 8.

    What is no number where one belongs is null, and so is a column that the
    export lacks. A missing file is empty.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], "run_id string, " + ", ".join(f"{n} {'double' if number else 'string'}" for n, _, number in RUN_COLUMNS))
    raw = spark.read.option("header", True).csv(path)

    def column(name: str, source: str, number: bool):
        held = F.col(f"`{source}`") if source in raw.columns else F.lit(None).cast("string")
        return (held.try_cast("double") if number else held).alias(name)

    return raw.select(F.left("run_id", F.lit(8)).alias("run_id"), *[column(*c) for c in RUN_COLUMNS])


#: Of a WAV file, the bytes that are looked at first.
WAV_HEAD = 4096
_WAV = "path string, sample_rate int, channels int, bits int, frames long, duration double, error string"


def wav_headers(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sample_rate, channels, bits, frames, duration, error) of WAV files.

    The first WAV_HEAD bytes tell for most; files with longer chunks before
    their samples are read again as a whole.
    """
    import struct

    import pandas as pd

    more = "goes on"

    def probe(batches):
        for pdf in batches:
            out = []
            for path, raw, size in zip(pdf["path"], pdf["head"], pdf["length"], strict=True):
                try:
                    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
                        raise ValueError("no WAV file")
                    at, fmt, frames = 12, None, None
                    while at + 8 <= len(raw) and frames is None:
                        name, n = raw[at : at + 4], struct.unpack("<I", raw[at + 4 : at + 8])[0]
                        if name == b"fmt ":
                            fmt = struct.unpack("<HHIIHH", raw[at + 8 : at + 24])
                        elif name == b"data":
                            frames = min(n, size - at - 8) // fmt[4]
                        at += 8 + n + n % 2
                    if frames is None:
                        raise ValueError(more if len(raw) < size else "no samples")
                    out.append((path, fmt[2], fmt[1], fmt[5], frames, frames / fmt[2], None))
                except Exception as e:  # a broken file is a row with its error
                    out.append((path, None, None, None, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "sample_rate", "channels", "bits", "frames", "duration", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(folder)
    first = saved(files.select("path", F.substring("content", 1, WAV_HEAD).alias("head"), "length").mapInPandas(probe, _WAV))
    open_ = F.coalesce(F.col("error") == more, F.lit(False))
    again = files.join(first.where(open_).select("path"), "path").select("path", F.col("content").alias("head"), "length").mapInPandas(probe, _WAV)
    return first.where(~open_).unionByName(again)
