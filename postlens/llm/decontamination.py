"""Benchmark decontamination by templates: numbers, names and units become typed placeholders, windows of templates are
hash-joined, and what fills the placeholders must agree. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, LEAST_WORDS, LEAST_PERCENT = 8, 4, 50
# Units that count as such behind a number.
UNITS = (
    "mm", "cm", "m", "km", "in", "ft", "yd", "mi", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles",
    "mg", "g", "kg", "t", "oz", "lb", "lbs", "gram", "grams", "pound", "pounds", "ton", "tons",
    "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "s", "sec", "min", "h", "hr", "hrs",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "dollar", "dollars", "cent", "cents", "euro", "euros", "percent", "mph", "kmh", "degrees",
)
NAME, UNIT, NUMBER = "\x01", "\x02", "<number>"
CODES = ("_template", "_caseless", "_plain")
SPACE = r"[\x01\x02\s\x1c-\x1f\x85\p{Z}]"


def tokens(text: Column) -> Column:
    """Words and numbers of a text, in lower case and without punctuation. A name is marked with a leading NAME, a unit with
    a leading UNIT. A name is a capitalised word after a lower-case letter, digit, comma or bracket and one space."""
    # Runs of white space, and white space other than a space, count as one space; so do the marks.
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), rf"{SPACE[:-1]}]{{2,}}|{SPACE[:-1]}&&[^ ]]", " ")
    # Both begin with what is rare, so that most places of a text are passed at one look.
    marked = F.regexp_replace(marked, r"\p{Lu}(?<=[\p{Ll}\p{N},;:)] \p{Lu})\p{Ll}", NAME + "$0")
    marked = F.regexp_replace(marked, rf"(\p{{N}} ?)({'|'.join(UNITS)})(?![\p{{L}}\p{{M}}])", f"$1{UNIT}$2")
    return F.regexp_extract_all(F.lower(marked), F.lit(r"\p{N}+(?:[.,]\p{N}+)*|[\x01\x02]?[\p{L}\p{M}]+"), 0)


def template(words: Column) -> Column:
    """Placeholders for numbers, names and units; other words as they are."""

    def one(w: Column) -> Column:
        return F.when(F.startswith(w, F.lit(NAME)), NAME).when(F.startswith(w, F.lit(UNIT)), UNIT).when(w.rlike(r"^\p{N}"), NUMBER).otherwise(w)

    return F.transform(words, one)


def _number(w: Column) -> Column:
    """Whether a word of `tokens` is a number; most words begin with an ASCII letter and need no pattern."""
    return ~((w >= "a") & (w < "{")) & w.rlike(r"^\p{N}")


def _caseless(w: Column) -> Column:
    return F.xxhash64(F.when((w >= "a") & (w < "{"), w).when(w.rlike(r"^\p{N}"), NUMBER).otherwise(_bare(w)))


def _split(rows: DataFrame, key: str) -> DataFrame:
    """key, _words, _caseless: the words of each text; hashes of each word where it is no number."""
    words = rows.where(F.col(key).isNotNull()).select(key, tokens(F.col("text")).alias("_words"))
    return words.withColumn("_caseless", F.transform("_words", _caseless))


def _template_codes(words: Column) -> Column:
    return F.transform(template(words), lambda w: F.xxhash64(w))


def _plain_codes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(_bare(w)))


def _tokenised(rows: DataFrame, key: str) -> DataFrame:
    """key, _words, _template, _caseless, _plain: the words of each text; hashes of each word's template, of the word where it
    is no number, and of the word."""
    return _split(rows, key).withColumns({"_template": _template_codes(F.col("_words")), "_plain": _plain_codes(F.col("_words"))})


def _at_every_word(width: int, one: Callable[[Column], Column], kind: str, columns: tuple[str, ...], holding: Callable[[Column], Column] | None = None) -> Column:
    """Array of one(i) for each word i at which a window begins; with `holding`, of windows with a word of that kind only.
    `columns` are the arrays of which `one` reads."""
    # size() beside the use of the arrays in a lambda keeps them columns of their own: they are not built again for each window.
    last = F.least(F.size("_words"), *(F.size(c) for c in columns)) - width
    begins = F.sequence(F.lit(0), last)
    if holding is not None:
        places = F.filter(F.transform("_words", lambda w, i: F.when(holding(w), i)), lambda i: i.isNotNull())
        around = F.transform(places, lambda i: F.sequence(F.greatest(i - (width - 1), F.lit(0)), F.greatest(F.least(i, last), F.lit(0))))
        begins = F.array_distinct(F.filter(F.flatten(around), lambda i: i <= last))
    return F.when(last >= 0, F.transform(begins, one)).otherwise(F.array().cast(f"array<{kind}>"))


def _seen(width: int) -> Column:
    """Each hash of each window of _split: the template is another one only where a word is marked, the words another one
    only where there is a number."""

    def of(codes: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda i: F.xxhash64(codes(F.slice("_words", i + 1, width)))

    every = ("_words", "_caseless")
    return F.concat(
        _at_every_word(width, _hash("_caseless", width), "bigint", every),
        _at_every_word(width, of(_template_codes), "bigint", every, lambda w: w < "\x03"),
        _at_every_word(width, of(_plain_codes), "bigint", every, _number),
    )


def _hash(codes: str, width: int) -> Callable[[Column], Column]:
    return lambda i: F.xxhash64(F.slice(codes, i + 1, width))


def _windows(words: DataFrame, key: str, width: int) -> DataFrame:
    """key, words, at, template, caseless, plain, raw: a window of `width` words at every word, with its three hashes."""
    window = _at_every_word(width, lambda i: F.struct(i.alias("at"), *(_hash(c, width)(i).alias(c[1:]) for c in CODES), F.slice("_words", i + 1, width).alias("raw")), f"struct<at:int,{','.join(f'{c[1:]}:bigint' for c in CODES)},raw:array<string>>", ("_words", *CODES))
    return words.select(key, F.size("_words").alias("words"), F.explode_outer(window).alias("w")).where("w IS NOT NULL").select(key, "words", "w.*")


def _hashed(windows: DataFrame, *hashes: Column) -> DataFrame:
    """Each window once for each of its different hashes that are not null."""
    each = F.array_distinct(F.filter(F.array(*hashes), lambda h: h.isNotNull()))
    return windows.withColumn("hash", F.explode(each)).drop(*(c[1:] for c in CODES))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_words: int = LEAST_WORDS, least_percent: int = LEAST_PERCENT) -> DataFrame:
    """doc_id, item_id, item_words, covered, reparameterised: benchmark items of which a document has at least
    `least_percent` percent, as text or with other numbers, names and units.

    Windows of `window` words lie at every word of items and documents: a run of at least `window` words that both have is
    found and covered whole wherever it lies. Hits of a document and an item that have the same
    shift belong together; within a shift each filler of the item must stand for one filler of the document, each word
    that is no placeholder must be equal, and a window with other fillers needs more words than placeholders. Windows also meet by their words,
    and by their words but for numbers: equal words are equal whatever marks they have, so a copy counts in any case, setting
    and line breaks. Items shorter than a window are matched
    whole, against every place of a document; those of under `least_words` words match nothing. covered counts words
    of the item in hits, overlaps once; reparameterised is true if a filler differs.

    Null and empty texts and null ids match nothing. Repeated rows of a document count once. Other columns are not read.
    Empty tables give no rows. Each document's distinct hashes are joined first, so that words of windows are built for
    documents with a hit only. The benchmark's windows are broadcast only where Spark finds them small."""
    items = _tokenised(benchmark, "item_id")
    n = F.size("_words")
    short = [r.n for r in items.select(n.alias("n")).where(f"n >= {least_words} AND n < {window}").distinct().collect()]  # at most window - least_words
    ours = None
    for width in [window, *sorted(short)]:
        of_width = _windows(items.where(n == width if width < window else n >= width), "item_id", width)
        of_width = of_width.withColumn("rich", 2 * F.size(F.filter("raw", _filler)) >= width)
        # What stands before an item may mark its first word as a name or unit.
        marked = [F.when(F.col("at") == 0, F.xxhash64(F.concat(F.array(F.xxhash64(F.lit(mark))), F.transform(template(F.slice("raw", 2, width - 1)), lambda w: F.xxhash64(w))))) for mark in (NAME, UNIT)]
        # Windows of placeholders would meet nearly everything by template: they meet by their words only.
        of_width = _hashed(of_width, F.col("plain"), *(F.when(~F.col("rich"), h) for h in (F.col("template"), F.col("caseless"), *marked)))
        of_width = of_width.select("item_id", F.col("words").alias("item_words"), F.col("at").alias("item_at"), "hash", F.col("raw").alias("item_raw"), "rich", F.lit(width).alias("width"))
        ours = of_width if ours is None else ours.unionByName(of_width)
    seen = F.concat(*(_seen(width) for width in [window, *sorted(short)]))
    near = _split(docs, "doc_id").select("doc_id", F.explode_outer(seen).alias("hash")).join(ours.select("hash"), "hash", "left_semi").select("doc_id").distinct()
    close = _tokenised(docs.select("doc_id", "text").join(near, "doc_id", "left_semi"), "doc_id")
    theirs = None
    for width in [window, *sorted(short)]:
        of_width = _hashed(_windows(close, "doc_id", width), *(F.col(c[1:]) for c in CODES)).select("doc_id", "at", "hash", "raw", F.lit(width).alias("width"))
        theirs = of_width if theirs is None else theirs.unionByName(of_width)
    found = theirs.join(ours, ["hash", "width"]).select("doc_id", "item_id", "item_words", "item_at", (F.col("at") - F.col("item_at")).alias("shift"), F.arrays_zip(F.col("item_raw").alias("i"), F.col("raw").alias("d")).alias("pairs"), "rich", "width")
    # A hash alone is no proof: words must be equal but for their marks, or fillers of one kind.
    sound = F.forall("pairs", lambda p: (_bare(p["i"]) == _bare(p["d"])) | (~F.col("rich") & _filler(p["i"]) & F.coalesce(_kind(p["i"]) == _kind(p["d"]), F.lit(False))))
    fillers = F.transform(F.filter("pairs", lambda p: _filler(p["i"])), lambda p: F.struct(p["i"].alias("i"), _bare(p["d"]).alias("d")))
    by_shift = found.where(sound).select("doc_id", "item_id", "item_words", "shift", "item_at", "width", fillers.alias("fillers"))
    # One shift has at most one hit for each place of the item: the group is bounded by the item.
    shifts = by_shift.groupBy("doc_id", "item_id", "item_words", "shift", "width").agg(F.collect_set("item_at").alias("ats"), F.array_distinct(F.flatten(F.collect_set("fillers"))).alias("fillers"))
    agree = F.size(F.array_distinct(F.transform("fillers", lambda p: p["i"]))) == F.size("fillers")
    cells = F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + F.col("width") - 1))))
    shifts = shifts.where(agree).select("doc_id", "item_id", "item_words", cells.alias("cells"), F.exists("fillers", lambda p: _bare(p["i"]) != p["d"]).alias("changed"))
    whole = shifts.groupBy("doc_id", "item_id", "item_words").agg(F.size(F.array_distinct(F.flatten(F.collect_set("cells")))).cast("long").alias("covered"), F.max("changed").alias("reparameterised"))
    enough = 100 * F.col("covered") >= least_percent * F.col("item_words")
    return whole.where(enough).select("doc_id", "item_id", F.col("item_words").cast("long").alias("item_words"), "covered", "reparameterised")


def _bare(w: Column) -> Column:
    return F.translate(w, NAME + UNIT, "")


def _filler(w: Column) -> Column:
    return w.rlike(r"^[\x01\x02\p{N}]")


def _kind(w: Column) -> Column:
    first = F.substring(w, 1, 1)
    return F.when(first.isin(NAME, UNIT), first).when(w.rlike(r"^\p{N}"), NUMBER)
