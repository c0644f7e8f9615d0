"""Column functions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: Column | str, places: int = 4) -> Column:
    """Rounded double; never a negative zero."""
    return F.round(col(c).cast("double"), places) + F.lit(0.0)


def or_else(c: Column | str, default: str) -> Column:
    """The text, or ``default`` where it is null or empty."""
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit(default))


def share(condition: Column) -> Column:
    """Share of the rows for which the condition holds; null as false."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def adherence_score(ok: Column, clap: Column, deviation: Column) -> Column:
    """0.4 ok share + 0.3 mean clap + 0.3 closeness of the mean deviation to 0; missing means give 0."""
    near = F.when(deviation.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - deviation / 0.20))
    return 0.4 * ok + 0.3 * F.coalesce(clap, F.lit(0.0)) + 0.3 * near


def reasons(*rules: tuple[Column, Column | str]) -> Column:
    """The texts of the rules that hold, in order."""
    return F.filter(F.array(*[F.when(rule, F.lit(t) if isinstance(t, str) else t) for rule, t in rules]), lambda x: x.isNotNull())


# text


def slug(c: Column | str) -> Column:
    """A file or source id: last path part without its suffix, spaces as _, other characters too, trimmed; empty as 'track'."""
    name = F.regexp_replace(F.regexp_replace(col(c), r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, " ", "_"), "[^0-9A-Za-z._-]+", "_"), "^[._-]+|[._-]+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("track"))


def dashed(c: Column | str) -> Column:
    """Lower case with runs of other characters than letters and digits as one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-|-$", "")


def plain_name(c: Column | str) -> Column:
    """Letters and digits in lower case, other runs as one space."""
    return F.array_join(F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def multi(c: Column | str) -> Column:
    """Values of a cell: split at | if it has one, else at ; , else at , ; trimmed, empty ones dropped."""
    c = F.coalesce(col(c), F.lit(""))
    parts = F.when(F.contains(c, F.lit("|")), F.split(c, "[|]")).when(F.contains(c, F.lit(";")), F.split(c, ";")).otherwise(F.split(c, ","))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def any_separator(c: Column | str) -> Column:
    """Values of a cell, split at each of | ; and , ."""
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), "[|;,]"), lambda x: F.trim(x)), lambda x: x != "")


_CONSONANT = "[b-df-hj-np-tv-xz]"
#: A word without vowels but a final e; or a vowel group that is not the final e of a longer word.
_SYLLABLE = rf"(?<![a-z]){_CONSONANT}++(?:(?<={_CONSONANT}{{2}})e)?+(?![a-z])|[aeiouy]++(?<![a-z]{_CONSONANT}e(?![a-z]))"


def syllables(c: Column | str) -> Column:
    """Syllables of a line: vowel groups of each word, one at least; a final e of words over two letters does not count.

    All words are counted in one pass over the line; apostrophes are no letters.
    """
    return F.regexp_count(F.replace(F.lower(col(c)), F.lit("'"), F.lit("")), F.lit(_SYLLABLE))


#: Lines that are no lyrics (fixed values).
NOISE = ("produced by", "prod. by", "embed", "lyrics", "copyright", "all rights reserved")


def clean_line(c: Column | str) -> Column:
    """The trimmed line; null if under 2 characters, a URL, a bracketed tag or noise."""
    line = F.trim(col(c))
    bad = (F.length(line) < 2) | line.rlike(r"https?://|www\.") | line.rlike(r"^[\[(].*[\])]$")
    for n in NOISE:
        bad = bad | F.contains(F.lower(line), F.lit(n))
    return F.when(~bad, line)


def clock(seconds: Column | str) -> Column:
    """Seconds as m:ss, or h:mm:ss from an hour on."""
    s = F.round(col(seconds)).cast("long")
    h, m, r = F.expr("0"), F.floor(s / 60) % 60, s % 60
    h = F.floor(s / 3600)
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


# music

#: Pitch names in semitone order, and flats as sharps (fixed values).
NOTES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
FLATS = {"Db": "C#", "Eb": "D#", "Gb": "F#", "Ab": "G#", "Bb": "A#"}


def pitch_class(key: Column | str) -> Column:
    """0 to 11 of a key such as 'F# minor'; null if there is none."""
    root = F.regexp_extract(F.coalesce(col(key), F.lit("")), "^([A-G][#b]?)", 1)
    for flat, sharp in FLATS.items():
        root = F.when(root == flat, sharp).otherwise(root)
    return F.nullif(F.array_position(F.array(*[F.lit(n) for n in NOTES]), root).cast("int"), F.lit(0)) - 1


def camelot(key: Column | str) -> Column:
    """The number on the Camelot wheel, 1 to 12: fifths apart are neighbours."""
    major = F.when(F.contains(F.lower(col(key)), F.lit("minor")), F.pmod(pitch_class(key) + 3, F.lit(12))).otherwise(pitch_class(key))
    return F.pmod(major * 7 + 7, F.lit(12)) + 1


def camelot_distance(a: Column | str, b: Column | str) -> Column:
    """Steps on the wheel, 0 to 6."""
    d = camelot(a) - camelot(b)
    return F.least(F.pmod(d, F.lit(12)), F.pmod(-d, F.lit(12)))


def transposed(key: Column | str, semitones: int) -> Column:
    moved = F.element_at(F.array(*[F.lit(n) for n in NOTES]), F.pmod(pitch_class(key) + semitones, F.lit(12)) + 1)
    return F.concat_ws(" ", moved, F.nullif(F.regexp_extract(col(key), " (major|minor)$", 1), F.lit("")))


# vectors


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


#: What stands for a missing number.
DASH = "—"


def percent(c: Column | str) -> Column:
    """A signed share in percent with one place, as text."""
    return F.when(col(c).isNull(), DASH).otherwise(F.format_string("%+.1f%%", rounded(F.lit(100.0) * col(c).cast("double"), 1)))


def number(c: Column | str, places: int = 2) -> Column:
    """A number with so many places, as text."""
    return F.when(col(c).isNull(), DASH).otherwise(F.format_string(f"%.{places}f", rounded(col(c).cast("double"), places)))
