"""Personal data: patterns, and spans that weak labellers teach a classifier.

Four kinds have patterns that decide by themselves: e-mail addresses, IP addresses,
card numbers with a right check digit, and international phone numbers.  Wider nets
catch further *candidates* (national phone numbers, spelt-out addresses, IBANs,
social security numbers, IPv6 addresses, names, streets) and much that is none.

Labellers of three sorts vote personal, not personal, or nothing on every
candidate: patterns of strict forms and check digits, gazetteers, and the context.
Matches of the four kinds, failed ones too, are voted on as well, which anchors
both classes.  Expectation-maximisation over the histogram of vote patterns of
*all* documents (at most 3**len(LABELLERS) rows a kind) estimates how reliable each
labeller is; on a bounded sample the posteriors train a hashed linear classifier
of spans (shape, neighbours, boundaries), which then decides on every candidate
that does not touch a sure span.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classifier import DIMENSIONS, fit
from .common import removed, sample_of, stage

BASE = ("email", "ip", "card", "phone")
ADDED = ("written_email", "national_phone", "iban", "ssn", "ipv6", "street", "person")
KINDS = (*BASE, *ADDED)
NOT, YES, NONE = 0, 1, 2
SAMPLE = 20_000  #: candidates that the classifier is fitted on, a sample by hash
KEEP = 0.5  #: a candidate is personal if its score is above
NEAR = 40  #: characters of context on either side
#: How often a vote is believed to be right beforehand, and the weight of that
#: belief as a share of the votes cast.
EXPECTED, BELIEF = 0.9, 0.1
LEAST = 0.55  #: a labeller is better than a coin

# Gazetteers and cue words, by what they stand for.
GIVEN_NAMES = frozenset(
    "james john robert michael william david richard joseph thomas charles mary patricia jennifer linda elizabeth barbara susan jessica sarah karen "
    "peter hans klaus jürgen wolfgang stefan andreas markus anna maria julia sabine ursula monika petra jean pierre michel philippe marie camille "
    "nathalie isabelle françois josé antonio manuel francisco juan carlos carmen lucía elena pablo giulia marco luca paolo emma olivia noah liam "
    "mohammed ahmed fatima wei ling yuki hiroshi raj priya ivan olga natasha sofia lars erik ingrid".split()
)
TITLES = frozenset("mr mrs ms miss dr prof sir herr frau monsieur madame mme señor señora sr sra".split())
NO_NAMES = frozenset(
    "the this that these those there they and but for from with when where what which who how why our your his her its new old north south east west "
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday "
    "united states kingdom union york university institute company street road avenue city county general public license version chapter section table figure "
    "der die das und ein eine les une des los las una".split()
)
MAIL_ENDS = frozenset("com org net edu gov info biz io co de fr es it uk eu us ch at nl be pl ru jp cn in br ca au".split())
STREET_WORDS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Square|Place|Way"
CUES = {
    "written_email": "mail email e-mail contact write reach", "national_phone": "phone tel telephone telefon call mobile cell fax whatsapp handy ring dial number reach",
    "iban": "iban account konto bank transfer", "ssn": "ssn social security", "ipv6": "ip ipv6 address host client server", "street": "address live lives living at street wohnt adresse visit ship",
    "person": "name named mr mrs ms dr prof herr frau dear regards sincerely signed by from contact author", "email": "mail email e-mail contact", "ip": "ip address host client",
    "card": "card visa mastercard amex credit debit payment", "phone": "phone tel telephone call mobile fax",
}
COUNTERS = frozenset("version v isbn issn order invoice page pages pp figure fig chapter section no nr id ref sku item code build release total sum price amount lot serial doi arxiv rfc article volume vol line row".split())

# Fixed patterns of the four kinds; run ends are marked so that long runs are read once.
_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_UP, _LOW = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
_MARK = r"[ \t]*+(?:\({0}\)|\[{0}\]|\{{{0}\}})[ \t]*+"
_AT, _DOT = _MARK.format("at"), rf"(?:{_MARK.format('dot')}|[ \t]++dot[ \t]++|\.)"
_NAME = rf"[{_UP}][{_LOW}]{{1,19}}+"
#: What a text must hold to be read by a net, and the net.
_nets = {
    "written_email": (lambda t: any(x in t.lower() for x in ("(at)", "[at]", "{at}", " dot ")), re.compile(rf"[\w.+-]{{1,64}}+(?:{_AT}[\w-]++(?:{_DOT}[\w-]++)++|[ \t]++at[ \t]++[\w-]++(?:[ \t]++dot[ \t]++[\w-]++)++)", re.I)),
    "ssn": (None, re.compile(r"[0-9](?<![0-9-].)[0-9]{2}[ -][0-9]{2}[ -][0-9]{4}(?![0-9-])")),
    "national_phone": (None, re.compile(r"[0-9(](?<![0-9].)(?:(?<=\()[0-9]{2,5}\)|(?<=[0-9])[0-9]{1,4}+)(?:[ ./-]{1,2}[0-9]{2,5}+){1,4}+(?![0-9])")),
    "iban": (None, re.compile(r"[A-Z](?<![A-Za-z0-9].)[A-Z][0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    "ipv6": (lambda t: t.count(":") > 1, re.compile(r"[0-9A-Fa-f:](?<![0-9A-Za-z:].)(?:(?<=:)[0-9A-Fa-f]{0,4}|[0-9A-Fa-f]{0,3}:[0-9A-Fa-f]{0,4})(?::[0-9A-Fa-f]{0,4}){1,7}(?![0-9A-Za-z:])")),
    "street": (None, re.compile(rf"[0-9](?<![0-9].)[0-9]{{0,4}}(?: {_NAME}){{1,3}} (?:{STREET_WORDS})\b|[{_UP}](?<!\w.)[{_LOW}]{{1,24}}(?:straße|strasse|weg|platz|gasse) [0-9]{{1,4}}\b|[0-9](?<![0-9].)[0-9]{{0,3}},? (?:rue|avenue|boulevard|calle) (?:d[eu] (?:la )?)?[{_UP}]\w{{1,24}}")),
    "person": (None, re.compile(rf"[{_UP}](?<!\w.)[{_LOW}]{{1,19}}+(?: [{_UP}]\.)?(?: {_NAME}){{1,2}}+(?!\w)")),
}
_words = re.compile(r"[^\W_]+(?:-[^\W_]+)*")


def luhn(digits: str) -> bool:
    own = [int(x) for x in reversed(digits)]
    return sum(own[::2]) % 10 == -sum(sum(divmod(2 * x, 10)) for x in own[1::2]) % 10


def mod97(text: str) -> bool:
    own = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part and domain, read from the signs @."""
    out, free, last = [], 0, -1
    for m in _domain.finditer(text):
        at = m.start()
        local = text[max(free, last + 1) : at]
        begin = at - len(local) + len(local.rstrip(_LOCAL))
        last = at
        if begin < at:
            out.append((begin, m.end()))
            free = m.end()
    return out


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The sure spans by kind and start, and the matches that failed."""
    kept: list = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    failed: list = []
    for kind, pattern, holds in (
        ("ip", _ip, lambda t: all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 and int(x[:-4] or 0) == 0 for x in t.split("."))),
        ("card", _card, lambda t: 13 <= len(d := digits_of(t)) <= 19 and luhn(d)),
        ("phone", _phone, lambda t: 9 <= len(digits_of(t)) <= 15),
    ):
        for m in pattern.finditer(text):
            (kept if holds(m[0]) else failed).append((kind, m.start(), m.end()))
    return kept, failed


def candidates(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Sure spans, failed matches worth a vote (as long as their kind), and what
    the nets catch apart from sure spans; of nets' catches that overlap the first
    one stays, the longer of one start, the kind listed first."""
    kept, failed = base_spans(text)
    taken = sorted((s, e) for _, s, e in kept)
    starts = np.array([s for s, _ in taken])
    ends = np.maximum.accumulate(np.array([e for _, e in taken])) if taken else starts

    def free(s: int, e: int) -> bool:
        k = int(np.searchsorted(starts, e)) if taken else 0
        return not k or ends[k - 1] <= s

    caught = sorted((m.start(), -m.end(), k, kind) for k, (kind, (needs, net)) in enumerate(_nets.items()) if not needs or needs(text) for m in net.finditer(text) if free(m.start(), m.end()))
    found, last = [], 0
    for s, e, _, kind in caught:
        if s >= last:
            found.append((kind, s, -e))
            last = -e
    return kept, [x for x in failed if len(digits_of(text[x[1] : min(x[2], x[1] + 64)])) >= 9 and free(x[1], x[2])], found


@dataclass
class Span:
    """A candidate as the labellers see it."""

    kind: str
    text: str
    before: str
    after: str
    sure: bool

    def __post_init__(self):
        self.digits = digits_of(self.text)
        self.words = [w.lower() for w in _words.findall(self.text)]
        self.near = [w.lower() for w in _words.findall(self.before)][-4:]
        self.next = [w.lower() for w in _words.findall(self.after)][:2]


def _sure(s: Span) -> int:
    """The patterns of the four kinds."""
    return NONE if s.kind not in BASE else YES if s.sure else NOT


def _check(s: Span) -> int:
    if s.kind == "card":
        return YES if 13 <= len(s.digits) <= 19 and luhn(s.digits) else NOT
    if s.kind == "iban":
        return YES if mod97(s.text) else NOT
    return NONE


def _form(s: Span) -> int:
    """Strict forms."""
    if s.kind in ("email", "written_email"):
        return YES if s.words and 2 <= len(s.words[-1]) <= 24 and s.words[-1].isalpha() else NOT
    if s.kind == "phone":
        return YES if 9 <= len(s.digits) <= 15 else NOT
    if s.kind == "ip":
        return YES if all(len(x) <= 3 and int(x) <= 255 for x in s.text.split(".")) else NOT
    if s.kind == "national_phone":
        return YES if re.fullmatch(r"\([0-9]{3}\)[ .-][0-9]{3}[ .-][0-9]{4}|0[0-9]{2,4}[ /-][0-9]{5,8}|0[0-9](?:[ .][0-9]{2}){4}", s.text) else NOT if len(s.digits) < 9 else NONE
    if s.kind == "ssn":
        return NOT if s.text[:3] in ("000", "666") or s.text[0] == "9" else YES if "-" in s.text else NONE
    if s.kind == "ipv6":
        return YES if s.text.count(":") == 7 or s.text.count("::") == 1 and len(s.digits) >= 2 else NOT
    return NONE


def _repeats(s: Span) -> int:
    """Digits that hardly vary or count up, groups like a date, a word said twice."""
    if s.kind == "person":
        return NOT if len(set(s.words)) < len(s.words) else NONE
    if len(s.digits) < 7:
        return NONE
    if len(set(s.digits)) <= 2 or s.digits in "01234567890123456789" or s.digits in "98765432109876543210":
        return NOT
    return NOT if re.fullmatch(r"(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}(?:[ -].*)?|(?:19|20)[0-9]{2}-(?:19|20)[0-9]{2}", s.text) else NONE


def _names(s: Span) -> int:
    return YES if any(w in GIVEN_NAMES for w in s.words) else NONE


def _titles(s: Span) -> int:
    return YES if s.kind == "person" and (s.words[0] in TITLES or s.near[-1:] and s.near[-1] in TITLES) else NONE


def _ordinary(s: Span) -> int:
    return NOT if s.kind in ("person", "street") and any(w in NO_NAMES for w in s.words[: -1 if s.kind == "street" else None]) else NONE


def _domains(s: Span) -> int:
    return (YES if s.words and s.words[-1] in MAIL_ENDS else NOT) if s.kind in ("email", "written_email") else NONE


def _cues(s: Span) -> int:
    return YES if set(s.near) & set(CUES[s.kind].split()) else NONE


def _counters(s: Span) -> int:
    return NOT if s.kind not in ("email", "written_email", "person") and (set(s.near[-2:]) & COUNTERS or s.before.rstrip()[-1:] in ("$", "€", "£", "#") or s.after.lstrip()[:1] in ("%", "€", "$")) else NONE


def _glued(s: Span) -> int:
    """Part of a longer token: a key, a path, a name in code."""
    a, b = s.before[-1:], s.after[:1]
    return NOT if (a.isalnum() or a in ("_", "/", "=", "\\", "-")) and s.kind not in ("email",) or b.isalnum() or b in ("_", "/", "=", "\\") else NONE


def _alone(s: Span) -> int:
    """A person's name seldom begins a sentence of running text."""
    if s.kind != "person" or s.near and s.near[-1] in TITLES:
        return NONE
    tail = s.before.rstrip(" ")
    return NOT if not tail or tail[-1] in ".!?\n" and s.after[:1] == " " and s.after[1:2].islower() else NONE


#: Patterns of form, gazetteers, and the context.
LABELLERS = {"sure patterns": _sure, "check digits": _check, "strict form": _form, "repeats": _repeats, "glued": _glued, "given names": _names, "titles": _titles, "ordinary words": _ordinary, "mail ends": _domains, "cue words": _cues, "counter words": _counters, "sentence start": _alone}


def seen(text: str, span: tuple[str, int, int], sure: bool = False) -> Span:
    kind, s, e = span
    return Span(kind, text[s : min(e, s + 400)], text[max(0, s - NEAR) : s], text[e : e + NEAR], sure)


def pattern(s: Span) -> int:
    """The votes as the digits of a number to base 3, the first labeller's last,
    and before them the kind."""
    out = KINDS.index(s.kind)
    for label in reversed(LABELLERS.values()):
        out = out * 3 + label(s)
    return out


def _shape(text: str) -> str:
    out = re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", text))
    return re.sub(r"(.)\1{4,}", r"\1\1\1\1+", out)[:40]


def features(s: Span) -> list[int]:
    """Hashed facts of a span: kind, shape, size, neighbours, boundaries."""
    kind = s.kind
    facts = [f"k {kind}", f"s {kind} {_shape(s.text)}", f"n {kind} {min(24, len(s.digits))}", f"l {kind} {min(10, len(s.text) // 5)}", f"a {kind} {_shape(s.before[-1:])}", f"b {kind} {_shape(s.after[:1])}"]
    facts += [f"w {kind} {w}" for w in s.near[-2:]] + [f"v {w}" for w in s.near[-3:]] + [f"x {kind} {w}" for w in s.next[:1]] + [f"o {kind} {w if w.isalpha() else _shape(w)}" for w in s.words[:6]]
    cast = [f"{name} {vote}" for name, label in LABELLERS.items() if label is not _sure and (vote := label(s)) != NONE]
    facts += [f"c {kind} {x}" for x in cast] + [f"g {x}" for x in cast]
    return sorted({zlib.crc32(x.encode()) % DIMENSIONS for x in facts})


class LabelModel:
    """The share of personal spans in each kind and each labeller's reliability,
    the chance that a vote it casts is right, by expectation-maximisation on a
    histogram of vote patterns.  Many labellers cast only one of the votes, so
    there is one number for both."""

    def __init__(self, patterns: dict[int, int], rounds: int = 300):
        keys = np.array(sorted(patterns), np.int64)
        weight = np.array([patterns[k] for k in keys.tolist()], float)
        m = len(LABELLERS)
        kind, digits = keys // 3**m, (keys[:, None] // 3 ** np.arange(m)) % 3
        says = np.where(digits == NONE, 0, np.where(digits == YES, 1, -1)).astype(float)  # pattern, labeller
        met = weight * (np.abs(says).sum(1) > 1)  # a labeller is judged where others vote too
        often = met @ np.abs(says)
        yes = 1 / (1 + np.exp(-2.0 * says.sum(1)))
        total = np.bincount(kind, weight, len(KINDS))
        self.prior, self.right = np.full(len(KINDS), 0.5), np.full(m, EXPECTED)
        for _ in range(rounds if len(keys) else 0):
            agree = (met * yes) @ (says > 0) + (met * (1 - yes)) @ (says < 0)
            held = BELIEF * often + 1
            self.right = np.maximum(LEAST, (agree + held * EXPECTED) / (often + held))
            self.prior = (np.bincount(kind, weight * yes, len(KINDS)) + 0.5 * BELIEF * total + 1) / ((1 + BELIEF) * total + 2)
            odds = np.log(self.prior / (1 - self.prior))[kind] + says @ np.log(self.right / (1 - self.right))
            new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
            done, yes = np.abs(new - yes).max() < 1e-9, new
            if done:
                break
        self.share = float((weight * yes).sum() / weight.sum()) if len(keys) else 0.5
        self.posterior = dict(zip(keys.tolist(), yes.tolist()))

    def reliabilities(self) -> dict[str, float]:
        return dict(zip(LABELLERS, self.right.tolist()))


@dataclass
class Model:
    """What the corpus has taught: the label model, and the weights of spans."""

    labels: LabelModel
    weights: np.ndarray
    bias: float

    def score(self, s: Span) -> float:
        own = self.weights[features(s)]
        z = own.sum() / np.sqrt(len(own)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def votes(docs: DataFrame, text: str = "text") -> DataFrame:
    """(pattern, features) of every sure span, failed match and candidate."""

    def run(batches):
        for batch in batches:
            rows = []
            for value in batch.column(0):
                own = value.as_py()
                if own:
                    for k, group in enumerate(candidates(own)):
                        for span in group:
                            s = seen(own, span, sure=k == 0)
                            rows.append((pattern(s), features(s)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], names=["pattern", "features"])

    return docs.select(F.col(f"`{text}`").alias("text")).where("text is not null").mapInArrow(run, "pattern int, features array<int>")


def learned(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    """The model of a corpus: votes are counted over all its candidates, the
    classifier is fitted on ``sample`` of them at most."""
    own, path = stage(votes(docs, text), "votes")
    labels = LabelModel({r[0]: r[1] for r in own.groupBy("pattern").count().collect()})
    some = sample_of(own, sample, "pattern", "features").collect()
    removed(docs.sparkSession, path)
    y = np.array([labels.posterior[r.pattern] for r in some], float)
    sizes = np.array([len(r.features) for r in some], np.int64)
    at = np.array([x for r in some for x in r.features], np.int64)
    return Model(labels, *fit(y, np.repeat(np.arange(len(y)), sizes), at, np.repeat(1 / np.sqrt(np.maximum(sizes, 1)), sizes)))


def spans_of(text: str, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, float]]]:
    """Sure spans by kind and start, and those that the classifier adds."""
    kept, _, found = candidates(text)
    scored = [(*x, model.score(seen(text, x))) for x in found]
    return kept, sorted((x for x in scored if x[3] > KEEP), key=lambda x: (KINDS.index(x[0]), x[1]))


SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"


def find_personal(docs: DataFrame, model: Model, text: str = "text", into: str = "personal", only: bool = False) -> DataFrame:
    """``docs`` with the column ``into``: spans (kind, start, end, score) in code
    points, sure ones first with score 1, then added ones, each by kind and start;
    ``only``: without the text.

    Null and empty texts have no spans; repeated rows have equal ones; equal scores
    need no order, as every span above the limit counts; a very long text costs its
    own task; an empty table stays empty; an existing column ``into`` is replaced.
    """
    kept = [c for c in docs.columns if c.lower() != into.lower() and not (only and c.lower() == text.lower())]
    nested = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("d"), F.col(f"`{text}`").alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            rows = []
            for value in batch.column(1):
                sure, more = spans_of(value.as_py() or "", shared.value)
                rows.append([{"kind": k, "start": s, "end": e, "score": x} for k, s, e, x in [*((*y, 1.0) for y in sure), *more]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["d", into])

    out = nested.mapInArrow(run, f"d {nested.schema['d'].dataType.simpleString()}, `{into}` {SPANS}")
    return out.select(*[F.col("d")[c].alias(c) for c in kept], F.col(f"`{into}`"))


def masked(text: str | None, model: Model) -> str | None:
    """A text with its spans replaced by their kinds in brackets."""
    if not text:
        return text
    sure, more = spans_of(text, model)
    out, at = [], 0
    for kind, s, e in sorted((x[:3] for x in [*sure, *more]), key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def report(docs: DataFrame) -> DataFrame:
    """Counts and digest of the sure spans, and all spans, of every document."""
    model = learned(docs)
    found = find_personal(docs.select("doc_id", "text"), model, only=True)
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    sure = F.filter("personal", lambda x: x["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("personal", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(said(sure), 256).alias("base_sha256"), said(F.col("personal")).alias("spans"))
