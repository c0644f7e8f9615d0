"""Personal data: pattern spans, and terms that disclose them by co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import joined_hot, keyed, scoped, stored, whole_text

#: The base patterns, without backtracking (fixed values). An e-mail address
#: starts where its run of local characters does, or where the last one ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kinds in the order of results.
KINDS = (*PATTERNS, "generalise", "remove")
#: What a text must contain for a pattern to match.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TERM = r"\p{L}{3,}"
#: Most words of a broadcast bitmap, of 64 bits each.
SLOTS = 1 << 17
#: Most common terms that are broadcast; any other is in under 1 / HOT of all pairs of a document and a term.
HOT = 1024
#: A term must be seen with an entity in so many documents; with an entity of fewer, it must be seen nowhere else, and is never removed.
SUPPORT = 2
#: Stands between the words and the gaps of a marked text, where it is a blank itself.
MARK = "\x01"
#: Share of an entity's information that a term discloses, from which on it is
#: generalised, and from which on it is removed.
GENERALISE_AT, REMOVE_AT = 0.8, 0.95


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right; for 13 to 19 digits."""

    def weighed(d: Column, i: Column) -> Column:
        n = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return n - F.when(n > 9, 9).otherwise(0)

    each = F.transform(F.split(F.reverse(digits), "(?<=[0-9])(?=[0-9])"), weighed)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _counts(kind: str, match: Column) -> Column:
    """Whether a match counts."""
    digits = _digits(match)
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return ~F.exists(parts, lambda p: (F.length(p) > 3) | (F.lpad(p, 3, "0") > "255"))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _matches(rows: DataFrame) -> DataFrame:
    """A row for each match, with the length of the text between it and the last match of its kind."""
    text = F.col("text")
    found = [
        F.when(F.contains(text, F.lit(NEEDS[k])), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(k)
        for k, p in PATTERNS.items()
    ]
    each = [
        F.struct(F.lit(k).alias("kind"), F.col(k).alias("m"), F.when(F.size(k) > 0, F.split(text, p)).alias("p")) for k, p in PATTERNS.items()
    ]
    n = F.size("x.m")
    gaps = F.transform(F.slice("x.p", 1, n), F.length)
    return (
        rows.select("row", "text", *found)
        .select("row", F.explode(F.array(*each)).alias("x"))
        .where(n > 0)
        .select("row", F.col("x.kind").alias("kind"), F.posexplode(F.arrays_zip(F.col("x.m").alias("m"), gaps.alias("gap"))).alias("i", "z"))
        .select("row", "kind", "i", F.col("z.gap").cast("long").alias("gap"), F.col("z.m").alias("match"))
    )


def base_spans(rows: DataFrame) -> DataFrame:
    """The matches that count in (row, text): (row, kind, start, end, match)."""
    real = stored(_matches(rows), "matches")
    same = Window.partitionBy("row", "kind").orderBy("i")
    before = same.rowsBetween(Window.unboundedPreceding, -1)
    placed = real.withColumn(
        "start", F.sum("gap").over(same) + F.coalesce(F.sum(F.length("match")).over(before), F.lit(0))
    ).withColumn("end", F.col("start") + F.length("match"))
    ok = F.lit(False)
    for k in PATTERNS:
        ok = F.when(F.col("kind") == k, _counts(k, F.col("match"))).otherwise(ok)
    return placed.where(ok).select("row", "kind", "start", "end", "match")


def _bare() -> Column:
    """The text with blanks for its addresses, the only entities that have letters."""
    text = F.col("text")
    pairs = F.arrays_zip(F.split(text, PATTERNS["email"]).alias("p"), F.regexp_extract_all(text, F.lit(PATTERNS["email"]), F.lit(0)).alias("m"))
    blank = F.transform(pairs, lambda x: F.concat(x["p"], F.coalesce(F.repeat(F.lit(" "), F.length(x["m"])), F.lit(""))))
    return F.when(F.contains(text, F.lit(NEEDS["email"])), F.array_join(blank, "")).otherwise(text)


def _lowered(words: Column) -> Column:
    return F.when(F.size(words) > 0, F.split(F.lower(F.array_join(words, " ")), " ")).otherwise(F.array().cast("array<string>"))


def _words() -> Column:
    """The different terms of a text, outside of entities."""
    return F.array_distinct(_lowered(F.regexp_extract_all(_bare(), F.lit(TERM), F.lit(0))))


def _maybe_among(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose key may be among the keys, by a bitmap of SLOTS words."""
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(shiftright(xxhash64({key}), 32), 64) as int))")
    bitmap = keys.select(slot.alias("_slot"), bit.alias("_bit")).groupBy("_slot").agg(F.bit_or("_bit").alias("_bits"))
    met = df.withColumn("_slot", slot).join(F.broadcast(bitmap), "_slot")  # SLOTS rows at most
    return met.where(F.col("_bits").bitwiseAND(bit) != 0).drop("_slot", "_bits")


def _by_term(df: DataFrame, terms: DataFrame) -> DataFrame:
    """``df`` join ``terms`` (with t, the documents of each) on term; the most common terms are not shuffled."""
    hot = stored(terms.orderBy(F.desc("t"), "term").limit(HOT), "hot")
    rare = terms.join(F.broadcast(hot.select("term")), "term", "left_anti")  # HOT rows
    once = df.join(F.broadcast(hot), "term")
    return once.unionByName(df.join(F.broadcast(hot.select("term")), "term", "left_anti").join(rare, "term"))


def disclosing(rows: DataFrame, words: DataFrame, spans: DataFrame, n: int, support: int, generalise_at: float) -> DataFrame:
    """(term, share, sure, t): terms that disclose at least ``generalise_at`` of an entity's information.

    With N documents, an entity in d of them carries log2(N / d) bits; a term
    in t documents that is with it in c of them discloses log2(c N / (d t))
    bits, their pointwise mutual information. ``share`` is the largest share of
    an entity's bits that a term discloses, ``sure`` the largest one that
    ``support`` documents or more bear out. All documents are counted. Of
    entities in fewer documents, terms that are in no others count, so that no
    document without such an entity is changed for it; however many documents
    there are, one alone makes no term ``sure``. As c is d at most, a term in
    more than d (N / d)^(1 - share) documents stays below the share and need
    not be paired with the entity. Entities of the same documents disclose the
    same and are counted once.
    """
    value = F.when(F.col("kind") == "email", F.lower("match")).when(F.col("kind") == "ip", F.col("match")).otherwise(_digits(F.col("match")))
    of = stored(spans.select("row", F.concat_ws(":", "kind", value).alias("entity")).distinct(), "entities")
    d = of.groupBy("entity").agg(F.count("*").alias("d"), F.bit_xor(F.xxhash64("row")).alias("h"), F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("g"))
    d = stored(d.where(F.col("d") < n).groupBy("d", "h", "g").agg(F.min("entity").alias("entity")).select("entity", "d"), "differing")
    of = stored(joined_hot(of, d, "entity"), "entities")
    most = lambda d: d * F.pow(float(n) / d, F.lit(1.0 - generalise_at)) * (1 + 1e-9)
    t = words.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("t"))
    bound = of.agg(F.coalesce(F.max(most(F.col("d"))), F.lit(0.0))).first()[0]
    t = stored(t.where(F.col("t") <= bound), "terms")
    holders = of.groupBy("row").agg(F.collect_list(F.struct("entity", "d")).alias("entities"))  # a document's own
    held = _maybe_among(words, of, "row").join(holders, "row").select("entities", F.explode("terms").alias("term"))
    pairs = _by_term(_maybe_among(held, t, "term"), t).select("term", "t", F.explode("entities").alias("e")).where(F.col("t") <= most(F.col("e.d")))
    c = pairs.groupBy(F.col("e.entity").alias("entity"), "term").agg(F.count("*").alias("c"), F.first("t").alias("t"), F.first("e.d").alias("d"))
    c = c.where((F.col("c") >= support) | ((F.col("d") < support) & (F.col("c") == F.col("t"))))
    share = F.log2(F.col("c") * float(n) / (F.col("d") * F.col("t"))) / F.log2(float(n) / F.col("d"))
    told = c.select("term", "t", "c", share.alias("share")).where(F.col("share") >= generalise_at - 1e-12)
    sure = F.max(F.when(F.col("c") >= support, F.col("share")))
    return told.groupBy("term").agg(F.max("share").alias("share"), F.coalesce(sure, F.lit(0.0)).alias("sure"), F.first("t").alias("t"))


def occurrences(rows: DataFrame, words: DataFrame, telling: DataFrame) -> DataFrame:
    """(row, kind, start, end) wherever (term, kind, t) occurs outside of entities.

    Telling words are set off by marks, at which the text is cut; the places
    are running sums of the pieces' lengths, so that the time is in proportion
    to the text.
    """
    met = _by_term(_maybe_among(words.select("row", F.explode("terms").alias("term")), telling, "term"), telling)
    of = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.col("term")))
    held = stored(met.groupBy("row").agg(of("generalise").alias("some"), of("remove").alias("gone")), "held")  # a document's own terms
    bare = F.translate(_bare(), MARK, " ")
    texts = _maybe_among(rows.select("row", "text"), held, "row").join(held, "row").select("row", "some", "gone", bare.alias("bare"))
    found = F.regexp_extract_all("bare", F.lit(TERM), F.lit(0))
    each = texts.select("row", "some", "gone", found.alias("words"), F.split("bare", TERM).alias("gaps"))
    zipped = F.arrays_zip(F.col("gaps").alias("gap"), F.col("words").alias("word"), _lowered(F.col("words")).alias("term"))
    kind = lambda term: F.when(F.array_contains("gone", term), "remove").when(F.array_contains("some", term), "generalise")
    word = lambda x: F.coalesce(F.concat(F.lit(MARK), kind(x["term"]), F.lit(MARK), x["word"], F.lit(MARK)), x["word"], F.lit(""))
    marked = F.array_join(F.transform(zipped, lambda x: F.concat(x["gap"], word(x))), "")
    pieces = each.select("row", F.posexplode(F.split(marked, MARK)).alias("i", "piece"))  # text, kind, word, text, ...
    along = Window.partitionBy("row").orderBy("i")  # a document's own pieces
    shown = F.when(F.col("i") % 3 != 1, F.length("piece")).otherwise(0).cast("long")
    placed = pieces.select("row", "i", shown.alias("length"), F.sum(shown).over(along).alias("end"), F.lag("piece").over(along).alias("kind"))
    return placed.where(F.col("i") % 3 == 2).select("row", "kind", (F.col("end") - F.col("length")).alias("start"), "end")


@scoped
def find_personal(
    docs: DataFrame, support: int = SUPPORT, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT
) -> DataFrame:
    """doc_id and spans (kind, start, end; code points, by kind as in KINDS, then start).

    Takes ``doc_id`` and ``text``; other columns are ignored. Spans of the
    base kinds are leftmost, do not overlap within their kind, and count only
    if address parts, check digits and lengths are right. Words that occur in
    at least ``support`` of an entity's documents (if it has fewer: in no
    others), wherever in them but not in an address, are scored by the share of the entity's information that they
    disclose over all documents; from ``generalise_at`` on, all their
    occurrences in all documents become ``generalise`` spans; from
    ``remove_at`` on ``remove`` spans, if ``support`` documents bear it out,
    which those of an entity of fewer never do, at any number of documents. Null and empty texts have no spans;
    repeated rows are rows. An empty table gives an empty result.
    """
    named, key = keyed(docs)
    rows = named.select(F.col(key).alias("row"), "doc_id", whole_text().alias("text"))
    spans = stored(base_spans(rows.select("row", "text")), "spans", keep=True)
    words = stored(rows.select("row", _words().alias("terms")), "words")
    told = disclosing(rows, words, spans, words.count(), support, generalise_at)
    kind = F.when(F.col("sure") >= remove_at, F.lit("remove")).otherwise(F.lit("generalise"))
    telling = stored(told.select("term", kind.alias("kind"), "t"), "telling")
    added = stored(occurrences(rows, words, telling), "added", keep=True)
    every = (
        rows.select("row", "doc_id", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
        .unionByName(spans.select("row", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "kind", "start", "end"))
        .unionByName(added.select("row", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "kind", "start", "end"))
    )
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    one = F.when(F.col("kind").isNotNull(), F.struct(place.alias("place"), "start", "end", "kind"))
    listed = every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sort_array(F.collect_list(one)).alias("all"))  # a document's own spans
    return listed.select(
        "doc_id", F.transform("all", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans")
    )


def sanitised(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id and text, with entities and disclosing terms replaced.

    Entities become their kind in brackets, generalised terms ``[term]``;
    removed terms go. Of overlapping spans the one that starts first is
    replaced, and what the others add to it goes with it. doc_id must be
    unique; texts are null where they were.
    """
    found = find_personal(docs, **parameters).withColumnRenamed("doc_id", "_id")
    by_start = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("to"), s["kind"].alias("kind"))))

    def add(held: Column, s: Column) -> Column:
        mark = F.when(s["kind"] == "remove", "").when(s["kind"] == "generalise", "[term]").otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
        gap = F.substring(F.col("text"), (held["at"] + 1).cast("int"), (s["start"] - held["at"]).cast("int"))
        fresh = s["start"] >= held["at"]
        return F.struct(
            F.greatest(held["at"], -s["to"]).alias("at"),
            F.when(fresh, F.concat(held["out"], F.array(gap, mark))).otherwise(held["out"]).alias("out"),
        )

    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    ends = lambda held: F.concat(F.array_join(held["out"], ""), F.substring(F.col("text"), (held["at"] + 1).cast("int"), F.length("text")))
    return docs.select("doc_id", "text").join(found, F.col("doc_id") == F.col("_id")).select("doc_id", F.aggregate(by_start, first, add, ends).alias("text"))


def brute_force(text: str | None) -> list[tuple[str, int, int]]:
    """The base spans by Python's regex engine, for tests."""
    import re

    text = text or ""

    def digits(s: str) -> str:
        return re.sub("[^0-9]", "", s)

    def luhn(s: str) -> bool:
        d = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(s))]
        return sum(x - 9 * (x > 9) for x in d) % 10 == 0

    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text) if ok(m[0])]


def brute_force_terms(texts: list[str | None], support: int = SUPPORT, generalise_at: float = GENERALISE_AT) -> dict[str, tuple[float, float]]:
    """term -> (the largest share of an entity's information that it discloses, the largest that ``support`` documents bear out), by counting all pairs, for tests."""
    import math
    import re

    n, entities, terms = len(texts), {}, {}
    for i, text in enumerate(texts):
        spans = brute_force(text)
        for kind, a, b in spans:
            m = text[a:b]
            value = m.lower() if kind == "email" else m if kind == "ip" else re.sub("[^0-9]", "", m)
            entities.setdefault((kind, value), set()).add(i)
        bare = list(text or "")
        for kind, a, b in spans:
            if kind == "email":
                bare[a:b] = " " * (b - a)
        for term in re.findall(r"[^\W\d_]{3,}", "".join(bare)):
            terms.setdefault(term.lower(), set()).add(i)
    found: dict[str, tuple[float, float]] = {}
    for docs in entities.values():
        d = len(docs)
        for term, held in terms.items():
            c = len(docs & held)
            if d < n and c and (c >= support or d < support and c == len(held)):
                share = math.log2(c * n / (d * len(held))) / math.log2(n / d)
                if share >= generalise_at - 1e-12:
                    old = found.get(term, (0.0, 0.0))
                    found[term] = max(old[0], share), max(old[1], share if c >= support else 0.0)
    return found
