"""Secret scans by a battery of randomness tests, in SQL functions only.

The *base* spans come from three fixed patterns.  The method adds spans of kind
``random``: runs of at least ``LEAST`` letters, digits and signs of base64 that
look drawn from their alphabet.  For each run the narrowest encoding that holds
it is inferred, and three tests measure it:

* chi-squared of the character counts against the uniform alphabet, and its
  part that tells most from words, the share of the letters that are rare in
  them,
* the number of runs: of lower case, upper case, digits and signs, of vowels and
  consonants, and above and below the middle of the alphabet,
* the lag-1 serial correlation of the positions in the alphabet.

As tests of uniformity they can only clear a run: one that any of the three
rejects (Bonferroni) is none.  As tests of text they give the p-value: under
plain words each statistic is a normal number with the fixed means below, whose
spread shrinks with the length; their weighted sum says how unlikely words are.
Weighted Benjamini-Hochberg over all runs of a document, each weighing as its
length, holds the share of false discoveries at ``FDR``.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flat, nested
from .quality import let

# The patterns of the base kinds, in the order of ``KINDS``.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the runs of [0-9a-f]+ that are long enough
KINDS = ("assign", "access", "hex", "random")
RUN = r"[A-Za-z0-9+/_-]{20,}"
LEAST = 20
BLOCK = 256  #: matches whose places are summed up in one go
PIECE = 1024  #: characters of a run whose positions are one array

FDR = 1e-4  #: share of false discoveries among a document's random spans
REJECT = 0.001  #: below this p-value a run is not uniform

# Plain words: changes of class per pair, changes between vowel and consonant per
# pair of letters, share of rare letters, serial correlation (of positions in an
# alphabet with the vowels first for one class, in blocks of classes for others).
CHANGES, ALTERNATION, RARE_SHARE, SERIAL_ONE, SERIAL_BLOCKS = 0.08, 0.56, 0.08, -0.15, 0.3
RARE = "[jkqvwxyz]"
WEIGHTS = (1.0, 1.0, 0.5)  #: of chi-squared, runs and serial correlation
TOGETHER = 0.6  #: correlation of the last two in words

_VOWELS, _CONSONANTS, _DIGITS = "aeiouy", "bcdfghjklmnpqrstvwxz", "0123456789"
_LOWER = _VOWELS + _CONSONANTS
# Name, letters in order, pattern, whether the letters are of one class, whether rare letters can occur.
ALPHABETS = [
    ("digits", _DIGITS, "^[0-9]+$", True, False),
    ("hex", _DIGITS + "abcdef", "^[0-9a-f]+$", False, False),
    ("HEX", _DIGITS + "ABCDEF", "^[0-9A-F]+$", False, False),
    ("lower", _LOWER, "^[a-z]+$", True, True),
    ("upper", _LOWER.upper(), "^[A-Z]+$", True, True),
    ("base32", "234567" + _LOWER.upper(), "^[A-Z2-7]+$", False, True),
    ("base36", _DIGITS + _LOWER, "^[0-9a-z]+$", False, True),
    ("BASE36", _DIGITS + _LOWER.upper(), "^[0-9A-Z]+$", False, True),
    ("base62", _DIGITS + _LOWER.upper() + _LOWER, "^[0-9A-Za-z]+$", False, True),
    ("base64", "+/" + _DIGITS + _LOWER.upper() + _LOWER, "^[0-9A-Za-z+/]+$", False, True),
    ("base64url", "-_" + _DIGITS + _LOWER.upper() + _LOWER, "^[0-9A-Za-z_-]+$", False, True),
    ("mixed", "+/-_" + _DIGITS + _LOWER.upper() + _LOWER, None, False, True),
]


def upper_tail(z: Column) -> Column:
    """P(Z >= z) of a standard normal, by its logistic approximation."""
    return let(F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0)), lambda x: 1 / (1 + F.exp(F.lit(1.5976) * x + F.lit(0.070566) * x * x * x)))


def _places(text: Column, found: Column, pattern: str) -> Column:
    """Structs (s, e) of code points of the matches ``found`` of ``pattern``."""
    pieces = F.split(text, pattern, -1)
    lengths = F.transform(F.arrays_zip(found.alias("m"), F.slice(pieces, 1, F.size(found)).alias("b")), lambda x: F.struct(F.length(x["b"]).alias("b"), F.length(x["m"]).alias("m")))

    def add(acc, x):
        s = acc["at"] + x["b"]
        return F.struct((s + x["m"]).alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), (s + x["m"]).alias("e")))).alias("out"))

    def from_offsets(p):
        sums = F.transform(p, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y["b"] + y["m"]))
        # running sums in two steps: an array that grows by one element copies itself
        offsets = _running(sums)

        def out(o):
            none = F.expr("array()").cast("array<struct<s:int,e:int>>")
            return F.flatten(F.transform(p, lambda x, i: F.aggregate(x, F.struct(F.get(o, i).alias("at"), none.alias("out")), add, lambda a: a["out"])))

        return let(offsets, out)

    return let(lengths, lambda x: let(_blocks(x), from_offsets))


def _running(numbers: Column) -> Column:
    """The sums before each of ``numbers``, by blocks."""

    def inside(x, start):
        return F.aggregate(x, F.array(start), lambda a, y: F.concat(a, F.array(F.element_at(a, -1) + y)), lambda a: F.slice(a, 1, F.size(x)))

    def of(parts):
        sums = F.transform(parts, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y))
        return let(inside(sums, F.lit(0)), lambda o: F.flatten(F.transform(parts, lambda x, i: inside(x, F.get(o, i)))))

    return let(_blocks(numbers), of)


def _blocks(array: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / BLOCK).cast("int")), lambda b: F.slice(array, b * BLOCK + 1, BLOCK))


def matches(text: Column, pattern: str, kind: str, group: int = 0, least: int = 1) -> Column:
    """The leftmost non-overlapping matches as structs (s, e, kind) of code
    points; those whose ``group`` is shorter than ``least`` are dropped."""

    def kept(found):
        judged = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        return F.transform(
            F.filter(F.arrays_zip(_places(text, found, pattern).alias("p"), judged.alias("g")), lambda x: F.length(x["g"]) >= least),
            lambda x: F.struct(x["p"]["s"].alias("s"), x["p"]["e"].alias("e"), F.lit(KINDS.index(kind)).alias("k")),
        )

    none = F.expr("array()").cast("array<struct<s:int,e:int,k:int>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, kept(found)).otherwise(none))


def _share(part: Column, whole: Column, of_text: float) -> Column:
    """How far a share is above that of words, in standard deviations; 0 if there is nothing to share."""
    x = F.least(F.greatest(part / whole, F.lit(0.0)), F.lit(1.0))
    return F.when(whole > 0, 2 * F.sqrt(whole) * (F.asin(F.sqrt(x)) - F.lit(math.asin(math.sqrt(of_text))))).otherwise(0.0)


def _tests(run: Column) -> Column:
    """Struct (uniform, p, n) of one run: whether the battery accepts it as
    uniform, its p-value as plain words, its length."""

    def by_encoding(*parts):
        out = F.struct(*[F.lit(x).alias(f"x{i}") for i, x in enumerate(parts[-1])])
        for (_, _, pattern, _, _), values in reversed([*zip(ALPHABETS[:-1], parts)]):
            out = F.when(run.rlike(pattern), F.struct(*[F.lit(x).alias(f"x{i}") for i, x in enumerate(values)])).otherwise(out)
        return out

    middle = lambda a: "".join("01"[i >= len(a) // 2] for i in range(len(a)))
    encoding = by_encoding(*[(a, middle(a), one, rare) for _, a, _, one, rare in ALPHABETS])

    def of(e):
        letters, one, rare = e["x0"], e["x2"], e["x3"]
        n, a = F.length(run).cast("double"), F.length(letters).cast("double")
        without = lambda pattern: F.length(F.regexp_replace(lower, pattern, ""))
        lower = F.lower(run)
        squares = F.aggregate(F.sequence(F.lit(1), F.length(letters)), F.lit(0.0), lambda s, i: s + F.pow(n - F.length(F.replace(run, F.substr(letters, i, F.lit(1)), F.lit(""))), F.lit(2.0)))
        # uniformity: chi-squared by Wilson and Hilferty, Wald and Wolfowitz about the middle
        chi, df = squares * a / n - n, a - 1
        z_chi = (F.cbrt(chi / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))

        def about_middle(bits):
            high = n - F.length(F.replace(bits, F.lit("1"), F.lit("")))
            low = n - high
            var = 2 * high * low * (2 * high * low - n) / (n * n * (n - 1))
            return F.when(var > 0, F.abs(F.regexp_count(bits, F.lit("0+|1+")) - (2 * high * low / n + 1)) / F.sqrt(var)).otherwise(40.0)

        z_middle = let(F.call_function("translate", run, letters, e["x1"]), about_middle)

        def correlation(sums):
            var, joint = sums["q"] / n - F.pow(sums["x"] / n, F.lit(2.0)), sums["j"] / sums["m"] - F.pow(sums["x"] / n, F.lit(2.0))
            return F.when((var > 0) & (sums["m"] > 0), joint / var).otherwise(1.0)

        def piece(acc, text):
            v = F.transform(F.filter(F.split(text, "", -1), lambda c: c != ""), lambda c: F.instr(letters, c).cast("double"))

            def add(v):
                fold = lambda values: F.aggregate(values, F.lit(0.0), lambda s, y: s + y)
                pairs = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v)), lambda x, y: x * y)
                return F.struct((acc["x"] + fold(v)).alias("x"), (acc["q"] + fold(F.transform(v, lambda y: y * y))).alias("q"), (acc["j"] + fold(pairs)).alias("j"), (acc["m"] + F.size(v) - 1).alias("m"))

            return F.when(F.length(text) > 1, let(v, add)).otherwise(acc)

        zero = F.struct(*[F.lit(0.0).alias(c) for c in "xqjm"])
        serial = let(F.aggregate(F.regexp_extract_all(run, F.lit(f".{{1,{PIECE}}}"), F.lit(0)), zero, piece), correlation)

        def verdict(r):
            worst = F.least(upper_tail(z_chi), 2 * upper_tail(z_middle), 2 * upper_tail(F.abs(r) * F.sqrt(n)))
            # words: each statistic above its mean in them, in standard deviations
            segments, known = F.regexp_count(lower, F.lit("[a-z]+")), n - without("[a-z]")
            turns = _share(F.regexp_count(run, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+")) - 1, n - 1, CHANGES)
            alternation = -_share((F.regexp_count(lower, F.lit(f"[{_VOWELS}]+|[{_CONSONANTS}]+")) - segments).cast("double"), (known - segments).cast("double"), ALTERNATION)
            runs = F.when(one, alternation).when(~rare, turns).otherwise((turns + alternation) / math.sqrt(2))
            scarce = F.when(rare, _share((n - without(RARE)).cast("double"), known.cast("double"), RARE_SHARE)).otherwise(0.0)
            z_serial = F.when(one, r - SERIAL_ONE).otherwise(F.lit(SERIAL_BLOCKS) - r) * F.sqrt(n)
            w = WEIGHTS
            spread = F.sqrt(F.when(rare, F.lit(w[0] ** 2)).otherwise(0.0) + w[1] ** 2 + w[2] ** 2 + 2 * w[1] * w[2] * TOGETHER)
            z = (w[0] * scarce + w[1] * runs + w[2] * z_serial) / spread
            return F.struct((3 * worst >= REJECT).alias("uniform"), upper_tail(z).alias("p"), n.alias("n"))

        return let(serial, verdict)

    return let(encoding, of)


def random_runs(text: Column, base: Column) -> Column:
    """All runs as structs (s, e, hit): the battery over every run, then the
    control of false discoveries over the document.  Runs that touch one of
    ``base`` (sorted spans) are no hits."""

    def judged(found):
        tests = F.transform(found, lambda r: _tests(r))

        def control(tests):
            mean = F.aggregate(tests, F.lit(0.0), lambda a, t: a + t["n"]) / F.size(tests)

            def weighted(mean):
                qs = F.transform(tests, lambda t: F.when(t["uniform"], t["p"] * mean / t["n"]).otherwise(1e300))

                def cut(qs):
                    passing = F.filter(F.transform(F.sort_array(qs), lambda q, i: F.when(q <= F.lit(FDR) * (i + 1) / F.size(tests), q)), lambda q: q.isNotNull())
                    return let(F.coalesce(F.array_max(passing), F.lit(-1.0)), lambda limit: F.transform(qs, lambda q: q <= limit))

                return let(qs, cut)

            return let(mean, weighted)

        hits = let(tests, control)
        zipped = F.arrays_zip(_places(text, found, RUN).alias("p"), hits.alias("hit"))
        return _apart(F.transform(zipped, lambda x: F.struct(x["p"]["s"].alias("s"), x["p"]["e"].alias("e"), x["hit"].alias("hit"))), base)

    none = F.expr("array()").cast("array<struct<s:int,e:int,hit:boolean>>")
    return let(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda found: F.when(F.size(found) > 0, judged(found)).otherwise(none))


def _apart(runs: Column, base: Column) -> Column:
    """``runs`` without hit where a span of ``base`` overlaps; block by block, so
    that each run meets the spans near it only."""
    touch = lambda b, s, e: (b["s"] < e) & (s < b["e"])

    def block(x):
        near = F.filter(base, lambda b: touch(b, F.element_at(x, 1)["s"], F.element_at(x, -1)["e"]))
        return let(near, lambda near: F.transform(x, lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e"), (r["hit"] & ~F.exists(near, lambda b: touch(b, r["s"], r["e"]))).alias("hit"))))

    return F.when(F.size(base) == 0, runs).otherwise(F.flatten(F.transform(_blocks(runs), block)))


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """(d, base, runs, spans): the rows of ``docs`` as a struct; ``base`` and
    ``spans`` are arrays of structs (s, e, k), k a place in ``KINDS``, in order of
    start and kind; ``runs`` are all runs with their verdict.  Random runs that
    touch a base span add nothing; equal p-values stand or fall together.  Null is
    the empty text; a very long text costs its own task, in time that grows with
    its length; equal rows have equal spans; an empty table gives an empty
    result."""
    df = nested(docs).withColumn("own", F.coalesce(F.col("d")[text], F.lit("")))
    own = F.col("own")
    base = F.concat(matches(own, ASSIGN, "assign", 1, 6), matches(own, ACCESS, "access", 0, 20), matches(own, HEX, "hex", 0, 24))
    df = df.withColumn("base", _ordered(base)).withColumn("runs", random_runs(own, F.col("base")))
    more = F.transform(F.filter("runs", lambda x: x["hit"]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(KINDS.index("random")).alias("k")))
    return df.select("d", "base", "runs", F.when(F.exists("runs", lambda x: x["hit"]), _ordered(F.concat("base", more))).otherwise(F.col("base")).alias("spans"))


def _ordered(spans: Column) -> Column:
    by_start = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    return F.transform(F.sort_array(by_start), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))


def _said(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _replaced(text: Column, pattern: str, hit, mask: str) -> Column:
    """``text`` with the i-th match replaced where ``hit(i)``."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def rebuilt(found):
        parts = F.transform(F.split(text, pattern, -1), lambda b, i: F.concat(b, F.when(i >= F.size(found), "").when(hit(i), mask).otherwise(F.get(found, i))))
        return F.when(F.size(found) > 0, F.array_join(parts, "")).otherwise(text)

    return let(found, rebuilt)


def masked(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mask``; spans that
    overlap are one.  Other columns, and texts without spans, stay as they are;
    null stays null."""
    df = scanned(docs, text)
    own = F.col("d")[text]

    def cut(spans):  # by places: only where base spans overlap
        def add(acc, x):
            fresh = x["s"] >= acc["at"]
            piece = F.substr(own, acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
            return F.struct(F.greatest(x["e"], acc["at"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.array(piece, F.lit(mask)))).otherwise(acc["out"]).alias("out"))

        zero = F.struct(F.lit(0).alias("at"), F.expr("array()").cast("array<string>").alias("out"))
        return F.aggregate(spans, zero, add, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(own, a["at"] + 1, F.length(own))))

    def by_pattern(t):
        one = _replaced(t, RUN, lambda i: F.get("runs", i)["hit"], mask)
        rest = F.lit(re.sub(r"([\\$])", r"\\\1", mask))
        both = let(one, lambda t: let(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(1)), lambda g: _replaced(t, ASSIGN, lambda i: F.length(F.get(g, i)) >= 6, mask)))
        return let(both, lambda t: F.regexp_replace(t, F.lit("AKIA[A-Z0-9]{16,}|" + HEX), rest))

    meet = F.exists(F.zip_with("base", F.slice("base", 2, F.size("base")), lambda x, y: y["s"] < x["e"]), lambda x: x)
    new = F.when(F.size("spans") == 0, own).when(meet, cut(F.col("spans"))).otherwise(by_pattern(own))
    return flat(df, docs.columns, **{text: new})


def report(docs: DataFrame) -> DataFrame:
    df = scanned(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return df.select(
        "d.doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_said(F.col("base")), 256).alias("base_sha256"),
        _said(F.col("spans")).alias("spans"),
    )
