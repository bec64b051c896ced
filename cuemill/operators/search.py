"""Word and phrase search over word-level transcripts.

The three match rules differ on purpose: *substring* (every term token is held
by the word at its place), *normalised* (tokens equal after normalisation; what
normalises to nothing stays and breaks adjacency) and *exact* (one whole token,
ignoring case).

``words`` has one row per token with a file key, an order and times.  All
phrases are matched over one window per file, so the table is shuffled once,
and not at all where a file's tokens lie nested in one row.  Terms, however many,
are one automaton, by which each different word is read once a task.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import token


def _tokens(term: str, mode: str) -> list[str]:
    parts = term.strip().lower().split()
    if mode == "normalised":
        parts = ["".join(c for c in p if c.isascii() and (c.isalnum() or c == "'")) for p in parts]
    return [p for p in parts if p]


class Terms:
    """Terms as sequences of token numbers, and an automaton that reads a word once
    and tells which of all terms' tokens it holds (substring) or is (normalised).
    What is known of words is kept, as texts have far fewer of them than places."""

    KNOWN = 200_000  #: words that are kept

    def __init__(self, terms: list[str], mode: str):
        self.mode, number = mode, {}
        self.names, self.parts = [], []
        for t in terms:
            own = _tokens(t, mode)
            if own:
                self.names.append(t)
                self.parts.append([number.setdefault(p, len(number)) for p in own])
        self.number, self.longest = number, max(map(len, self.parts), default=1)
        self.by_first: dict[int, list[int]] = {}
        for k, own in enumerate(self.parts):
            self.by_first.setdefault(own[0], []).append(k)
        self.known: dict[str, frozenset] = {}
        # states of the automaton: next states, where to go on, and the tokens that end here
        self.next: list[dict[str, int]] = [{}]
        self.fail, self.ends = [0], [frozenset()]
        if mode == "substring":
            for p, k in number.items():
                at = 0
                for c in p:
                    if c not in self.next[at]:
                        self.next[at][c] = len(self.next)
                        self.next.append({})
                        self.fail.append(0)
                        self.ends.append(frozenset())
                    at = self.next[at][c]
                self.ends[at] |= {k}
            wait = list(self.next[0].values())
            for at in wait:  # breadth first, so what an ending points to is complete
                for c, to in self.next[at].items():
                    back = self.fail[at]
                    while back and c not in self.next[back]:
                        back = self.fail[back]
                    self.fail[to] = self.next[back].get(c, 0)
                    self.ends[to] |= self.ends[self.fail[to]]
                    wait.append(to)

    def tokens(self, word: str | None) -> frozenset:
        got = self.known.get(word)
        if got is None:
            if word is None:
                got = frozenset()
            elif self.mode == "normalised":
                got = frozenset({self.number[word]}) if word in self.number else frozenset()
            else:
                found, at = set(), 0
                for c in word:
                    while at and c not in self.next[at]:
                        at = self.fail[at]
                    at = self.next[at].get(c, 0)
                    found |= self.ends[at]
                got = frozenset(found)
            if len(self.known) >= self.KNOWN:
                self.known.clear()
            self.known[word] = got
        return got

    def find(self, words: pa.Array, off: np.ndarray, every: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, term) of every match in rows of words (``off``: where each row
        begins in ``words``); else of those at the rows' first places."""
        coded = words.dictionary_encode()
        place = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
        held = [self.tokens(w) for w in coded.dictionary.to_pylist()] + [frozenset()]
        begins = np.array([not x.isdisjoint(self.by_first) for x in held], bool)
        some = np.flatnonzero(begins[place]) if every else off[:-1][off[:-1] < off[1:]]
        row = np.searchsorted(off, some, side="right") - 1
        out = []
        for i, r in zip(some.tolist(), row.tolist()):
            end = int(off[r + 1])
            for first in held[place[i]]:
                for k in self.by_first.get(first, ()):
                    own = self.parts[k]
                    if i + len(own) <= end and all(p in held[place[i + j]] for j, p in enumerate(own)):
                        out.append((r, i, k))
        got = np.array(out, np.int64).reshape(-1, 3)
        return got[:, 0], got[:, 1], got[:, 2]


def phrase_hits(words: DataFrame, terms: list[str], mode: str = "substring", key: str = "ytid", order: str = "idx", keep: tuple[str, ...] = (), probability: str | None = None) -> DataFrame:
    """One row per term and match: (key, order, term, hit_start_ms, hit_end_ms,
    source_caption[, probability], *keep); the span goes from the first token's
    start to the last one's end, or its start where the end is missing.

    Blank words are taken out before windows form in substring mode only.  A word
    carries the next ones of its file, as many as the longest term has, and all terms
    are looked for in one pass, however many there are.  A word without any term's
    token is in no match and only parts its neighbours, so of it nothing but its place
    is shuffled.
    """
    own = Terms(terms, mode)
    base = words.where(F.trim("word") != "") if mode == "substring" else words
    ahead = Window.partitionBy(key).orderBy(order).rowsBetween(0, own.longest - 1)
    form = F.lower("word") if mode == "substring" else token("word")
    held = _held(form, own)
    carried = list(dict.fromkeys([key, order, *keep]))
    only = lambda c, name: F.when(held, c).alias(name)
    base = base.select(key, order, *[only(F.col(c), c) for c in carried if c not in (key, order)], *[only(c, n) for c, n in [(form, "__form"), (F.col("word"), "__word"), (F.col("start_ms"), "start_ms"), (F.coalesce("end_ms", "start_ms"), "__end")] if n not in carried], *([only(F.col(probability).cast("double"), "__p")] if probability else []))
    item = F.struct(F.col("__form").alias("form"), F.col("__word").alias("word"), F.col("__end").alias("end"), *([F.col("__p").alias("p")] if probability else []))
    wide = base.select(F.struct(*dict.fromkeys([*carried, "start_ms"])).alias("d"), F.collect_list(item).over(ahead).alias("t")).where(F.col("t")[0]["form"].isNotNull()).select("d", F.col("t.form").alias("f"), "t")
    found = wide.mapInArrow(_row_hits(own), f"d {wide.schema['d'].dataType.simpleString()}, term string, t {wide.schema['t'].dataType.simpleString()}")
    last = F.element_at("t", -1)
    extra = [(F.aggregate("t", F.lit(0.0), lambda a, x: a + x["p"]) / F.size("t")).alias("probability")] if probability else []
    return found.select(*[F.col("d")[c].alias(c) for c in carried], "term", F.col("d.start_ms").alias("hit_start_ms"), last["end"].alias("hit_end_ms"), F.array_join(F.col("t.word"), " ").alias("source_caption"), *extra)


def _held(form: Column, terms: Terms) -> Column:
    """Whether a word holds (substring) or is (normalised) a token of some term."""
    if terms.mode == "normalised":
        return F.coalesce(form.isin(*terms.number), F.lit(False))
    if not 0 < len(terms.number) <= 64:  # a pattern tries its tokens one by one: many are left to the automaton
        return form.isNotNull()
    return F.coalesce(form.rlike("|".join(map(re.escape, terms.number))), F.lit(False))


def _row_hits(terms: Terms):
    """(d, term, t) of rows (d, f, t) whose words begin with a term; ``t`` is cut to it."""

    def run(batches):
        for batch in batches:
            forms = batch.column(1)
            off = forms.offsets.to_numpy().astype(np.int64)
            row, _, term = terms.find(forms.values, off, every=False)
            items = batch.column(2)
            base = items.offsets.to_numpy().astype(np.int64)[row]
            size = np.array([len(terms.parts[k]) for k in term], np.int64)
            ends = np.concatenate(([0], np.cumsum(size)))
            at = np.repeat(base - ends[:-1], size) + np.arange(ends[-1])
            cut = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items.values.take(pa.array(at)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array([terms.names[k] for k in term], pa.string()), cut], names=["d", "term", "t"])

    return run


def nested_phrase_hits(files: DataFrame, terms: list[str], mode: str = "substring", tokens: str = "tokens", keep: tuple[str, ...] = ("ytid",)) -> DataFrame:
    """The same where ``tokens`` is an array of (word, idx, start_ms, end_ms) per
    file: matched inside the row, without a shuffle, all terms in one pass."""
    own = Terms(terms, mode)
    there = F.filter(tokens, lambda x: F.trim(x["word"]) != "") if mode == "substring" else F.col(tokens)
    form = (lambda x: F.lower(x["word"])) if mode == "substring" else (lambda x: token(x["word"]))
    base = files.select(F.struct(*keep).alias("d"), there.alias("t")).select("d", F.transform("t", form).alias("f"), "t")
    idx = base.schema["t"].dataType.elementType["idx"].dataType.simpleString()
    found = base.mapInArrow(_nested_hits(own), f"d {base.schema['d'].dataType.simpleString()}, term string, idx {idx}, hit_start_ms long, hit_end_ms long, source_caption string")
    return found.select(*[F.col("d")[c].alias(c) for c in keep], "term", "idx", "hit_start_ms", "hit_end_ms", "source_caption")


def _nested_hits(terms: Terms):
    def run(batches):
        for batch in batches:
            forms, items = batch.column(1), batch.column(2)
            off = forms.offsets.to_numpy().astype(np.int64)
            row, at, term = terms.find(forms.values, off)
            # a token has the same place in both arrays, from the row's begin on
            at = at - off[row] + items.offsets.to_numpy().astype(np.int64)[row]
            size = np.array([len(terms.parts[k]) for k in term], np.int64)
            value = lambda name, places: items.values.field(name).take(pa.array(places))
            end = pc.coalesce(value("end_ms", at + size - 1), value("start_ms", at + size - 1)) if len(at) else pa.array([], pa.int64())
            word = items.values.field("word")
            captions = [" ".join(x for x in word.slice(a, n).to_pylist() if x is not None) for a, n in zip(at.tolist(), size.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array([terms.names[k] for k in term], pa.string()), value("idx", at), value("start_ms", at), end, pa.array(captions, pa.string())],
                names=["d", "term", "idx", "hit_start_ms", "hit_end_ms", "source_caption"],
            )

    return run


def windows(hits: DataFrame, win_ms: int = 1000, before_ms: int = 0, after_ms: int = 0, exact: bool = False) -> DataFrame:
    """``hits`` with the clip window start_ms, end_ms: the hit itself if ``exact``,
    else ``win_ms`` around its middle; padded, not before 0."""
    start, end = F.col("hit_start_ms"), F.col("hit_end_ms")
    if not exact:
        middle = F.floor((start + end) / 2)
        start, end = middle - win_ms // 2, middle + win_ms // 2
    return hits.withColumns({"start_ms": F.greatest(start - before_ms, F.lit(0)).cast("long"), "end_ms": (end + after_ms).cast("long")})


def word_hits(words: DataFrame, word: str, pad_ms: int = 200) -> DataFrame:
    """Tokens that are the word, but for case and spaces, padded."""
    out = words.where(F.lower(F.trim("word")) == word.strip().lower())
    return out.withColumns({"start_ms": F.greatest(F.col("start_ms") - pad_ms, F.lit(0)), "end_ms": F.col("end_ms") + pad_ms})


def caption_hits(captions: DataFrame, terms: list[str], win_ms: int = 7000, before_ms: int = 0, after_ms: int = 0, text: str = "caption", at: str = "sec_ms") -> DataFrame:
    """Caption lines that hold any term, ignoring case (all lines without terms),
    with the first such term as label; a hit is a point."""
    from ..functions.scalars import first_term

    c = F.lower(F.col(text))
    if terms:
        captions = captions.where(reduce(lambda a, b: a | b, [F.contains(c, F.lit(t.lower())) for t in terms]))
    out = captions.withColumn("label", first_term(F.col(text), terms) if terms else F.lit("hit"))
    return out.withColumns({"start_ms": F.greatest(F.col(at) - win_ms // 2 - before_ms, F.lit(0)), "end_ms": F.col(at) + win_ms // 2 + after_ms})


def pick(matches: DataFrame, occurrence: str | int = "best", key: str = "ytid", start: str = "hit_start_ms", p: str = "probability") -> DataFrame:
    """One match per file: first, last, best or the N-th (from 1; where there is
    no such match, the best)."""
    s, v = F.col(start), F.col(p)
    orders = {"first": [s.asc(), v.desc()], "last": [s.desc(), v.desc()], "best": [v.desc(), s.asc()]}
    by = Window.partitionBy(key)
    best = F.row_number().over(by.orderBy(*orders["best"]))
    if occurrence in orders:
        return matches.withColumn("__n", F.row_number().over(by.orderBy(*orders[occurrence]))).where("__n = 1").drop("__n")
    n = int(occurrence) if str(occurrence).isdigit() else 0
    ranked = matches.withColumns({"__n": F.row_number().over(by.orderBy(s, v.desc())), "__b": best, "__m": F.count("*").over(by)})
    return ranked.where(F.when(F.lit(n).between(1, F.col("__m")), F.col("__n") == n).otherwise(F.col("__b") == 1)).drop("__n", "__b", "__m")
