"""Scalar functions of the transcript domain, as Column expressions.

All are native expressions: ids from URLs and file names, dates from titles,
clock texts, clip-name spans, label and token normalisation, decimal rounding.
Functions return NULL where nothing matches, never ''.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ID = "[A-Za-z0-9_-]{11}"
MONTHS = "January February March April May June July August September October November December".split()
#: A month in full or abbreviated, "Sept" included.
MONTH = "(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
FULL_MONTH = "(" + "|".join(MONTHS) + ")"
WATCH = "https://www.youtube.com/watch?v="


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extract(c, pattern: str, group: int = 1) -> Column:
    """The group of the first match; NULL without one."""
    return F.nullif(F.regexp_extract(col(c), pattern, group), F.lit(""))


# --- identity -------------------------------------------------------------


def video_id(url) -> Column:
    """``v=`` or the short host, then 11 characters."""
    return F.coalesce(extract(url, f"v=({ID})"), extract(url, rf"youtu\.be/({ID})"))


def video_id_by_host(url) -> Column:
    """By the host: the query's ``v`` on youtube.com, the last path segment on
    youtu.be, else the first run of 11 id characters anywhere."""
    u = col(url)
    # hand-made parts: a URL parser rejects texts that these still read
    host = F.lower(extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"))
    query = extract(u, r"[?&]v=([^&#]*)")
    path = extract(u, r"://[^/?#]*/(?:[^?#]*/)?([^/?#]+)/*(?:[?#]|$)")
    return (
        F.when(host.endswith("youtube.com") & query.isNotNull(), query)
        .when(host.endswith("youtu.be") & path.isNotNull(), path)
        .otherwise(extract(u, f"({ID})"))
    )


def video_id_strict(text) -> Column:
    """A watch or short URL, or the whole text is an id."""
    t = col(text)
    return F.coalesce(extract(t, rf"(?:watch\?v=|youtu\.be/)({ID})"), F.when(t.rlike(f"^{ID}$"), t))


def id_in_name(name, parent=None) -> Column:
    """11 id characters before ``__``, anywhere in the name or else its folder."""
    pattern = f"({ID})__"
    return extract(name, pattern) if parent is None else F.coalesce(extract(name, pattern), extract(parent, pattern))


def id_at_start(name) -> Column:
    return extract(name, f"^({ID})__")


def id_before_mark(name) -> Column:
    """What stands before the first ``__``, of any length."""
    n = col(name)
    return F.when(F.contains(n, F.lit("__")), F.substring_index(n, "__", 1))


def extractor(given, url) -> Column:
    """The named extractor, else ``youtube`` for its hosts, else the host's first
    label, else ``youtube``."""
    host = F.lower(extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"))
    bare = F.regexp_replace(host, r"^www\.", "")
    known = host.rlike(r"(^|\.)(youtube\.com|youtu\.be)$")
    name = F.nullif(F.lower(F.trim(col(given))), F.lit(""))
    return F.coalesce(name, F.when(known, F.lit("youtube")).otherwise(F.nullif(F.substring_index(bare, ".", 1), F.lit(""))), F.lit("youtube"))


def watch_url(id_) -> Column:
    return F.concat(F.lit(WATCH), col(id_))


# --- dates ----------------------------------------------------------------


def _month_number(name: Column) -> Column:
    names = F.array(*[F.lit(m[:3].lower()) for m in MONTHS])
    return F.array_position(names, F.lower(F.substring(name, 1, 3)))


def _date(month: Column, day: Column, year: Column) -> Column:
    text = F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    return F.when(month.isNotNull() & day.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def title_date(title) -> Column:
    """Full or short month, any case, optional comma, with or without a space on
    either side; impossible dates are NULL."""
    p = rf"(?i){MONTH}\s*([0-9]{{1,2}})\s*,?\s*([0-9]{{4}})"
    return _date(_month_number(extract(title, p, 1)), extract(title, p, 2), extract(title, p, 3))


def title_date_strict(title) -> Column:
    """Full month as written, comma and spaces required."""
    p = rf"{FULL_MONTH}\s+([0-9]{{1,2}}),\s+([0-9]{{4}})"
    return _date(_month_number(extract(title, p, 1)), extract(title, p, 2), extract(title, p, 3))


def name_date(name, prefix: str) -> Column:
    """The date in a file name behind a fixed prefix, as a DATE: spellings such
    as ``january 05`` and ``January 5`` are the same day."""
    p = rf"(?i){prefix}.*?{FULL_MONTH}\s+([0-9]{{1,2}}),?\s+([0-9]{{4}})"
    return _date(_month_number(extract(name, p, 1)), extract(name, p, 2), extract(name, p, 3))


def name_date_text(name, prefix: str) -> Column:
    """The same in its raw spelling, ``Month D, YYYY``."""
    p = rf"(?i){prefix}.*?{FULL_MONTH}\s+([0-9]{{1,2}}),?\s+([0-9]{{4}})"
    return F.when(col(name).rlike(p), F.concat(extract(name, p, 1), F.lit(" "), extract(name, p, 2), F.lit(", "), extract(name, p, 3)))


def date_text(date) -> Column:
    return F.date_format(col(date), "MMMM d, yyyy")


def iso_to_text(text) -> Column:
    return date_text(F.try_to_date(col(text), "yyyy-MM-dd"))


def compact_date(text) -> Column:
    t = col(text)
    return F.when(t.rlike("^[0-9]{8}$"), F.try_to_date(t, "yyyyMMdd"))


# --- clock ----------------------------------------------------------------


def seconds_strict(text) -> Column:
    """``HH:MM:SS.mmm`` or with a comma; anything else is 0."""
    t = col(text)
    p = r"^\s*([0-9]+):([0-9]+):([0-9]+)[.,]([0-9]{1,3})\s*$"
    whole = extract(t, p, 1).cast("double") * 3600 + extract(t, p, 2).cast("double") * 60 + extract(t, p, 3).cast("double")
    return F.coalesce(F.when(t.rlike(p), whole + F.rpad(extract(t, p, 4), 3, "0").cast("double") / 1000), F.lit(0.0))


def seconds_loose(text) -> Column:
    """Two or three parts, the last with a fraction; anything else is 0."""
    parts = F.split(F.replace(F.trim(col(text)), F.lit(","), F.lit(".")), ":")
    numbers = F.transform(parts, lambda x: x.try_cast("double"))
    value = F.aggregate(numbers, F.lit(0.0), lambda a, x: a * 60 + x)
    return F.coalesce(F.when(F.size(parts).between(2, 3), value), F.lit(0.0))


def clock(seconds, mark: str = ".") -> Column:
    """``HH:MM:SS.mmm``: the milliseconds are rounded first, so they never
    print as 1000."""
    ms = F.round(col(seconds) * 1000).cast("long")
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def millis_pad(ms) -> Column:
    return F.greatest(col(ms).cast("double") / 1000, F.lit(0.0))


def fps(text) -> Column:
    """``30000/1001`` or ``25``; 0 if unreadable or over nothing."""
    t = col(text)
    top = F.get(F.split(t, "/"), 0).try_cast("double")
    under = F.coalesce(F.get(F.split(t, "/"), 1).try_cast("double"), F.when(~F.contains(t, F.lit("/")), F.lit(1.0)))
    return F.coalesce(F.when(under != 0, top / under), F.lit(0.0))


def frame(seconds, rate, up: bool = False) -> Column:
    r = col(rate)
    value = col(seconds) * r
    return F.when(r == 0, F.lit(-1).cast("long")).otherwise((F.ceil(value) if up else F.floor(value)).cast("long"))


# --- clips ----------------------------------------------------------------


def clip_span(name) -> tuple[Column, Column]:
    """(start, end) of a name that ends in ``_S-E.ext``."""
    p = r"_([0-9]+(?:\.[0-9]+)?)-([0-9]+(?:\.[0-9]+)?)\.[A-Za-z0-9]+$"
    return extract(name, p, 1).cast("decimal(12,3)"), extract(name, p, 2).cast("decimal(12,3)")


def to_cents(value, mode: str) -> Column:
    """A DECIMAL at two digits by ``half_up``, ``floor`` or ``ceiling``."""
    v = col(value)
    out = {"half_up": lambda: F.round(v, 2), "floor": lambda: F.floor(v, F.lit(2)), "ceiling": lambda: F.ceil(v, F.lit(2))}[mode]()
    return out.cast("decimal(12,2)")


def padded(start, end, before, after) -> tuple[Column, Column]:
    s, e = col(start) - before, col(end) + after
    return F.greatest(s, F.lit(0).cast("decimal(12,3)")) if not isinstance(before, float) else F.greatest(s, F.lit(0.0)), e


def fixed_width(seconds) -> Column:
    """``%06.2f`` of a DECIMAL, rounded half up."""
    text = F.round(col(seconds), 2).cast("decimal(12,2)").cast("string")
    return F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text)  # lpad alone would cut longer texts


# --- text -----------------------------------------------------------------


def token(word) -> Column:
    """Lower-cased letters, digits and apostrophes only."""
    return F.regexp_replace(F.lower(F.trim(col(word))), "[^a-z0-9']+", "")


def plain(text) -> Column:
    """Tags out, white space to one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(col(text), "<[^>]*>", ""), r"\s+", " "))


def tokens(text) -> Column:
    return F.filter(F.split(F.trim(col(text)), r"\s+"), lambda w: w != "")


def scrub(text) -> Column:
    return F.translate(col(text), "\t\r\n", "   ")


def label(text) -> Column:
    """Only letters, digits, ``-_.`` and spaces, which become ``_``."""
    return F.translate(F.regexp_replace(col(text), "[^-A-Za-z0-9_. ]", ""), " ", "_")


def natural_key(name) -> Column:
    """A text that sorts names with their numbers as numbers."""
    parts = F.regexp_extract_all(F.lower(col(name)), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    digits = lambda x: F.when(F.length(x) < 20, F.lpad(x, 20, "0")).otherwise(x)
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), digits(x)).otherwise(x)), "")


def short_title(text, most: int) -> Column:
    return F.substring(col(text), 1, most)


def list_quote(path) -> Column:
    """Single quotes for a concatenation list."""
    return F.replace(col(path), F.lit("'"), F.lit("'\\''"))


def corrected(text, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements in the order given; each of a miss as written, in
    lower case and with every word capitalised."""

    def step(out, pair):
        miss, fix = pair
        for form in dict.fromkeys((miss, miss.lower(), miss.title())):
            out = F.replace(out, F.lit(form), F.lit(fix))
        return out

    return reduce(step, pairs, col(text))


def first_term(caption, terms: list[str]) -> Column:
    """The first listed term that the caption holds, else the first of all."""
    c = F.lower(col(caption))
    return F.coalesce(*[F.when(F.contains(c, F.lit(t.lower())), F.lit(t)) for t in terms], F.lit(terms[0]))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def ratio(part, whole) -> Column:
    w = col(whole)
    return F.when(w > 0, col(part) / w).otherwise(0.0)


# --- classification -------------------------------------------------------


def media_kind(name) -> Column:
    """``whisper`` for words of the speech model, ``yt`` for those of captions."""
    n = col(name)
    return F.when(n.endswith(".words.yt.tsv"), "yt").when(n.endswith("words.tsv"), "whisper")


def caption_language(name) -> Column:
    return F.coalesce(extract(name, r"\.transcript\.([^.]+)\.vtt$"), F.lit("en"))


def has_audio(formats) -> Column:
    return F.exists(col(formats), lambda f: F.coalesce(f["acodec"], F.lit("none")) != "none")


def _stuck(width: int = 10) -> str:
    """``width`` characters of at most two kinds, and one more behind them: k equal
    ones, another kind, and as many of both as are missing, for each k."""
    ways = [rf"(.)\1{{{width - 1}}}"]
    for k in range(1, width):
        a = 2 * k
        ways.append(rf"(.)\{a}{{{k - 1}}}(?!\{a})(.)(?:\{a}|\{a + 1}){{{width - 1 - k}}}")
    return rf"(?s)(?:{'|'.join(ways)})."


def hallucinated(text, start, end) -> Column:
    """Blank; shorter than 0.01 s; over 20 characters with 10 in a row of at most
    two kinds (the last such window is not looked at); or six words or more with
    a word trigram that comes twice.  Linear in the length of the text."""
    t = F.trim(F.coalesce(col(text), F.lit("")))
    words = tokens(F.lower(t))

    def again(ws):
        three = F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - 2, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(ws, i + 1), F.get(ws, i + 2)))
        return (F.size(ws) >= 6) & F.transform(F.array(three), lambda x: F.size(F.array_distinct(x)) < F.size(x))[0]

    # words are split once and held in a variable
    repeats = F.transform(F.array(words), again)[0]
    return (t == "") | ((col(end) - col(start)) < 0.01) | ((F.length(t) > 20) & t.rlike(_stuck())) | repeats
