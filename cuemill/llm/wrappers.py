"""Main text of web pages through wrappers inferred per host.

A wrapper is a union-free regular expression over a host's pages: tags, fixed
text, text slots, optional groups ``( )?`` and repeated groups ``( )+``.  It is
inferred by aligning the token streams of all of the host's different pages,
those of equal structure first:

* inside a page, adjacent groups of equal structure become one repeated group;
* different texts at one place become a slot;
* where tags differ, the shorter way to a common tag is skipped on either side
  and becomes an optional group.

Every page is matched against its host's wrapper.  The page's chief ``article`` or
``main`` element bounds the content where it holds a fair part of the text.  What
is fixed by the wrapper is the host's furniture if the evidence is enough: every
further page on which a text stands makes it more likely that it is, by as much as
it is rare that texts of the chief element are fixed; inside that element the odds
begin at one to ``DOUBT``, elsewhere even.  One rule holds for any number of pages.
What meets a slot or an optional or repeated group is content, unless its
element's name, class or role, or that of an inline element around the words, says
that it is a menu, advert, form, comment or the like, or it is a list of links
outside the chief element.

Names in class and id attributes tell furniture only where the element neither
holds the chief element nor, on a page without one, half of the text.
"""

from __future__ import annotations

import hashlib
import html as entities
import itertools
import json
import math
import re
from bisect import bisect_left

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

WIDTHS = (4096, 64, 1)  #: parts of a host's structures that are aligned apart, level by level, until one is left
HELD = 20_000  #: structures that a task holds before it passes them on
RARE = 64  #: an optional group that less than one in so many pages has leaves the wrapper; it decides nothing
DOUBT = 8  #: what the odds of furniture begin below inside the chief element
FAIR = 4  #: the chief element bounds the content if it has at least one in so many of the page's characters

# Element names, and words in class, id and role, by what they stand for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
DROPPED = frozenset("head title nav footer aside form button select option textarea input label fieldset dialog menu iframe object embed svg canvas audio video map noscript template frameset".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg math".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion promoted banner nav navbar navigation "
    "menu submenu breadcrumb breadcrumbs pagination pager sidebar sidenav aside rail widget widgets footer foot colophon masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices notification alert popup popover modal overlay newsletter subscribe subscription signup login search "
    "share sharing social comment comments commentlist discussion disqus replies reply respond related recommended recommendations trending popular teaser teasers "
    "tags taglist copyright legal disclaimer skip".split()
)
HEADERS = frozenset("header siteheader pageheader".split())
MAIN_WORDS = frozenset("articlebody post-body entry-content article-body post-content article-content main-content".split())

#: Elements whose furniture words are no verdict, words of state, and elements that often wrap a whole page.
NEVER = frozenset("html body article main".split())
STATES = frozenset("has no with without is not js".split())
SOFT = frozenset("form fieldset header".split())

_name = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
_rest = re.compile(r"""((?:[^=>]++|=(?:\s*+(?:"[^"]*+"|'[^']*+'))?+)*+)>""")
_attr = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))?)?""")
_split = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")
_closing = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*>?", re.I) for x in RAW}


def host(url: str | None) -> str:
    m = re.match(r"\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


class Block:
    """A run of text of one block element: whether it lies in a main element, in
    the chief one, in furniture, and whether most of it are links."""

    __slots__ = ("text", "main", "chief", "drop", "linked")

    def __init__(self, text, main, chief, drop, linked):
        self.text, self.main, self.chief, self.drop, self.linked = text, main, chief, drop, linked


def _verdict(name: str, attrs: str, inside_main: bool) -> tuple[bool, bool, bool]:
    """Whether the element is furniture for certain, whether by a word that may be
    overruled, and whether it is a main element."""
    main = name in ("article", "main")
    hard = name in DROPPED and name not in SOFT
    soft = name in SOFT and (name != "header" or not inside_main)
    if attrs:
        for m in _attr.finditer(attrs):
            key = m[1].lower()
            if key not in ("class", "id", "role", "itemprop", "hidden", "aria-hidden", "style"):
                continue
            value = m[2] or m[3] or m[4] or ""
            low = value.lower()
            if key == "role":
                main |= low == "main"
                hard |= low in ROLES
            elif key == "itemprop":
                main |= low == "articlebody"
            elif key == "hidden" or (key == "aria-hidden" and low == "true") or (key == "style" and re.search(r"display\s*+:\s*+none", low)):
                hard = True
            elif key in ("class", "id"):
                if any(c in MAIN_WORDS for c in low.split()):
                    main = True
                    continue
                for one in value.split():
                    parts = [x.lower() for x in _split.split(one) if x]
                    if parts and parts[0] not in STATES:
                        soft |= not WORDS.isdisjoint(parts) or one.lower() in WORDS or (not inside_main and not HEADERS.isdisjoint(parts))
    return hard and name not in ("html", "body"), soft and name not in NEVER, main


class _Page:
    """The elements of a page while it is read: parallel lists, parents first."""

    def __init__(self):
        self.parent, self.hard, self.soft, self.main, self.size, self.plain = [-1], [False], [False], [False], [0], [0]

    def add(self, above: int, hard: bool, soft: bool, main: bool) -> int:
        for column, value in zip((self.parent, self.hard, self.soft, self.main, self.size, self.plain), (above, hard, soft, main, 0, 0)):
            column.append(value)
        return len(self.parent) - 1

    def judged(self) -> tuple[list[bool], list[bool], int]:
        """Of each element whether it is furniture and whether it is in a main
        element; and the chief one: of the outermost main elements in the fewest
        elements of furniture words that of most text outside links (0: none)."""
        up = self.parent
        n = len(up)
        for i in range(n - 1, 0, -1):
            self.size[up[i]] += self.size[i]
            self.plain[up[i]] += self.plain[i]
        hard, worded, main = self.hard[:], list(map(int, self.soft)), self.main[:]
        first, least = 0, (0, 0)
        for i in range(1, n):
            hard[i] |= hard[up[i]]
            worded[i] += worded[up[i]]
            if main[i] and not main[up[i]] and not hard[i] and (not first or (worded[i], -self.plain[i]) < least):
                first, least = i, (worded[i], -self.plain[i])
            main[i] |= main[up[i]]
        holds, i = set(), first
        while i > 0:
            holds.add(i)
            i = up[i]
        drop = [False] * n
        for i in range(1, n):
            drop[i] = drop[up[i]] or self.hard[i] or (self.soft[i] and i not in holds and bool(first or 2 * self.size[i] < self.size[0]))
        return drop, main, first


def blocks(html: str) -> tuple[list[Block], list[str]]:
    """The text blocks of a page in order, and its token stream for alignment."""
    page = _Page()
    stream: list = []  # tokens, and numbers of the runs of text between them
    runs: list[tuple[int, list[tuple[str, int, bool]]]] = []
    stack: list[tuple[str, int, bool]] = []  # name, element, inside main
    text: list[tuple[str, int, bool]] = []
    links = 0

    def flush():
        if text:
            if any(x.strip() for x, _, _ in text):
                at = next((e for x, e, _ in reversed(stack) if x.split(".")[0] in BLOCK), 0)
                stream.append(len(runs))
                runs.append((at, text[:]))
            text.clear()

    def words(value: str):
        at = stack[-1][1] if stack else 0
        text.append((value, at, links > 0))
        size = len(value.strip())
        page.size[at] += size
        page.plain[at] += 0 if links else size

    at, n, broken = 0, len(html), False
    while at < n:
        begin = html.find("<", at)
        if begin != at:
            words(html[at : begin if begin >= 0 else n])
        if begin < 0:
            break
        m = _name.match(html, begin)
        if not m:
            if html.startswith("<!--", begin):
                end = html.find("-->", begin + 2)
                at = end + 3 if end >= 0 else n
            elif html[begin + 1 : begin + 2] in ("!", "?", "/"):
                at = html.find(">", begin) + 1 or n
            else:  # a "<" that starts no tag
                words("<")
                at = begin + 1
            continue
        whole = None if broken else _rest.match(html, m.end())
        if whole:
            attrs, at = whole[1], whole.end()
        else:  # quotes that never end: from here on a tag ends at the next ">"
            broken, end = True, html.find(">", m.end())
            if end < 0:
                break
            attrs, at = html[m.end() : end], end + 1
        name = m[2].lower()
        if m[1]:
            if name in BLOCK:
                flush()
            if name == "a":
                links = max(0, links - 1)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0].split(".")[0] == name:
                    del stack[k:]
                    if name in BLOCK:
                        stream.append(f"/{name}")
                    break
            continue
        if name == "br":
            words(" ")
            continue
        if name in BLOCK:
            flush()
            if name in ("article", "main"):
                while stack and stack[-1][0].split(".")[0] in ("nav", "ul", "li", "a", "p"):
                    stack.pop()
            for k in range(len(stack) - 1, -1, -1):  # these end where the next one begins
                open_ = stack[k][0].split(".")[0]
                if open_ == "p" or (open_ == name and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
                    del stack[k:]
                    break
                if open_ in BLOCK:
                    break
        if name == "a":
            links += 1
        _, above, inside = stack[-1] if stack else ("", 0, False)
        hard, soft, main = _verdict(name, attrs, inside)
        if name in RAW:
            end = _closing[name].search(html, at)
            at = end.end() if end else n
            continue
        if name in VOID or attrs.endswith("/"):
            continue
        if name in BLOCK:
            found = re.search(r"class\s*=\s*[\"']?([\w-]+)", attrs)
            full = f"{name}.{found[1]}" if found else name
            stream.append(full)
        else:
            full = name
        stack.append((full, page.add(above, hard, soft, main and not hard), inside or main))
    flush()

    drop, main, chief = page.judged()
    inside = [False] * len(drop)
    for i in range(1, len(drop)):
        inside[i] = bool(chief) and (i == chief or inside[page.parent[i]])
    out: list[Block] = []
    for k, (at, pieces) in enumerate(runs):
        kept = pieces if drop[at] else [x for x in pieces if not drop[x[1]]]
        gone = drop[at]
        plain = " ".join(entities.unescape("".join(x for x, _, _ in kept)).split())
        if not plain and kept is not pieces:  # all of it lies in inline furniture
            kept, gone = pieces, True
            plain = " ".join(entities.unescape("".join(x for x, _, _ in kept)).split())
        if plain:
            linked = sum(len(x.strip()) for x, _, link in kept if link)
            out.append(Block(plain, main[at], inside[at], gone, linked * 2 > len(plain)))
        runs[k] = "#" + xxhash.xxh3_64_hexdigest(plain.encode()) if plain else ""
    return out, [y for x in stream if (y := runs[x] if isinstance(x, int) else x)]


def folded(stream: list[str]) -> list:
    """Adjacent groups of equal structure as one repeated group: a list whose
    entries are tokens or ("+", tokens)."""
    return [x for x, _ in _runs(stream)]


def _runs(stream: list[str]) -> list[tuple]:
    """(item, times): the folded stream and how often each group stood there."""
    shape = ["#" if x[0] == "#" else x for x in stream]
    end: dict[int, int] = {}  # of the element that begins at a place, where it is closed
    opened: dict[str, list[int]] = {}
    for k, x in enumerate(shape):
        if x[0] == "/":
            if opened.get(x[1:]):
                end[opened[x[1:]].pop()] = k + 1
        elif x != "#":
            opened.setdefault(x.split(".")[0], []).append(k)
    out: list = []
    i = 0
    while i < len(stream):
        k = end.get(i)
        best = k - i if k else 0
        if best and shape[i:k] == shape[k : k + best]:
            group, times = list(stream[i:k]), 1
            while shape[k : k + best] == shape[i : i + best]:
                group = [a if a == b else "#" for a, b in zip(group, stream[k : k + best])]
                k += best
                times += 1
            out.append((("+", group), times))
            i = k
        else:
            out.append((stream[i], 1))
            i += 1
    return out


def _kind(x) -> str:
    if isinstance(x, tuple):
        return x[0] + " ".join("#" if t[0] == "#" else t for t in x[1])
    return "#" if x[0] == "#" else x


def spread(wrapper: list, total: int = 1) -> list[tuple]:
    """(item, pages) with the optional groups opened: how many of the ``total``
    pages have it."""
    return [(y, n) for x in wrapper for y, n in ([(v, x[2]) for v in x[1]] if x[0] == "?" else [(x, total)])]


def gathered(items: list[tuple], total: int) -> list:
    """The other way round: neighbours that as many but not all pages have become
    one optional group; what hardly a page has goes."""
    out: list = []
    for x, n in items:
        if n >= total:
            out.append(x)
        elif n * RARE < total:
            continue
        elif out and out[-1][0] == "?" and out[-1][2] == n:
            out[-1][1].append(x)
        else:
            out.append(("?", [x], n))
    return out


class Places:
    """The kinds of a list of items, and where the next of a kind is."""

    def __init__(self, items: list):
        self.kinds = [_kind(x) for x in items]
        self.parts = [tuple(map(_kind, x[1])) if isinstance(x, tuple) else () for x in items]
        self.at: dict[str, list[int]] = {}
        for k, x in enumerate(self.kinds):
            self.at.setdefault(x, []).append(k)

    def next(self, kind: str, start: int) -> int:
        at = self.at.get(kind, ())
        k = bisect_left(at, start)
        return at[k] if k < len(at) else -1

    def once(self, part: tuple, start: int) -> bool:
        return tuple(self.kinds[start : start + len(part)]) == part


def walk(a: Places, b: Places):
    """Places (i, n, j, m) of items of ``a`` and ``b`` that stand for each other,
    in order, by one pass: n items of ``a`` from i on and m of ``b`` from j on; n
    and m are 1 but where a repeated group meets a single occurrence.  Where
    kinds differ, the shorter way to a common one is skipped, however long."""
    i = j = 0
    while i < len(a.kinds) and j < len(b.kinds):
        x, y = a.kinds[i], b.kinds[j]
        if x == y:
            yield i, 1, j, 1
            i, j = i + 1, j + 1
        elif a.parts[i] and b.once(a.parts[i], j):
            yield i, 1, j, len(a.parts[i])
            i, j = i + 1, j + len(a.parts[i])
        elif b.parts[j] and a.once(b.parts[j], i):
            yield i, len(b.parts[j]), j, 1
            i, j = i + len(b.parts[j]), j + 1
        else:
            k, m = b.next(x, j), a.next(y, i)
            if k < 0 and m < 0:
                i, j = i + 1, j + 1
            elif m < 0 or (k >= 0 and k - j <= m - i):
                j = k
            else:
                i = m


def align(wrapper: list, page: list, pages: int = 1, more: int = 1) -> list:
    """The wrapper that reads what either of two wrappers reads (a folded page is
    one), the first taught by ``pages`` pages, the other by ``more``."""
    a, b = spread(wrapper, pages), spread(page, more)
    left, right = [x for x, _ in a], [x for x, _ in b]
    out: list = []
    at = to = 0
    for i, n, j, m in walk(Places(left), Places(right)):
        out += a[at:i] + b[to:j]
        have = min(x for _, x in a[i : i + n]) + min(x for _, x in b[j : j + m])
        if n == m == 1:
            out.append((_join(left[i], right[j]), have))
        elif n == 1:
            out.append((("+", [_join(x, y) for x, y in zip(left[i][1], right[j : j + m])]), have))
        else:
            out.append((("+", [_join(x, y) for x, y in zip(left[i : i + n], right[j][1])]), have))
        at, to = i + n, j + m
    return gathered(out + a[at:] + b[to:], pages + more)


def _join(a, b):
    if isinstance(a, tuple):
        return (a[0], [_join(x, y) for x, y in zip(a[1], b[1])])
    return a if a == b else "#"


def fixed(wrapper: list, optional: bool = False) -> set[str]:
    """The fixed texts of a wrapper: those of groups that every page has."""
    out: set[str] = set()
    for x in wrapper:
        if isinstance(x, tuple):
            out |= fixed(x[1], optional or x[0] == "?")
        elif not optional and x[0] == "#" and len(x) > 1:
            out.add(x)
    return out


class Matcher:
    """A host's wrapper, taught by ``pages`` different pages, to tell the fixed
    texts of its pages by place."""

    def __init__(self, wrapper: list, pages: int = 2):
        self.pages = pages
        self.items = [(x, n < pages) for x, n in spread(wrapper, pages)]
        self.places = Places([x for x, _ in self.items])

    def furniture(self, stream: list[str]) -> list[bool]:
        """Of each text of a page's stream, whether it meets equal fixed text
        that is on every page."""
        runs = _runs(stream)
        page = [x for x, _ in runs]
        known: list = [None] * len(page)  # the wrapper's tokens under each item, if it is no optional one
        for i, n, j, m in walk(self.places, Places(page)):
            if any(o for _, o in self.items[i : i + n]):
                continue
            under = [x for x, _ in self.items[i : i + n]]
            if n == 1 and isinstance(under[0], tuple):
                under = under[0][1]
            if m == 1:
                known[j] = under
            else:
                known[j : j + m] = [[x] for x in under]
        out: list[bool] = []
        at = 0
        for (x, times), under in zip(runs, known):
            size = len(x[1]) if isinstance(x, tuple) else 1
            for k in range(size * times):
                token = stream[at + k]
                if token[0] == "#":
                    out.append(under is not None and under[k % size] == token)
            at += size * times
        return out


def expression(items: list) -> str:
    """A wrapper as text."""
    say = lambda x: f"({expression(x[1])}){x[0]}" if isinstance(x, tuple) else "#text" if x == "#" else "'" + x[1:] + "'" if x[0] == "#" else f"<{x}>"
    return " ".join(map(say, items))


def loaded(items: list) -> list:
    """A wrapper from its JSON, where groups are lists."""
    return [(x[0], loaded(x[1]), *x[2:]) if isinstance(x, list) else x for x in items]


def infer(streams: list[list[str]]) -> list:
    wrapper: list = []
    for k, stream in enumerate(streams):
        page = folded(stream)
        wrapper = page if k == 0 else align(wrapper, page, k)
    return wrapper


def furniture(found: list[Block], fix: list[bool], pages: int) -> list[bool]:
    """Which blocks are the host's.  A text that is fixed on all of ``pages`` pages
    is so by chance with the power ``pages`` - 1 of how often texts of the chief
    element are fixed on this page."""
    inside = [f for b, f in zip(found, fix) if b.chief and not b.drop]
    chance = (sum(inside) + 1) / (len(inside) + 2)
    odds = min(1000.0, (pages - 1) * -math.log(chance))
    return [f and odds > (math.log(DOUBT) if b.chief else 0) for b, f in zip(found, fix)]


def extract(html: str | None, constant: frozenset | set = frozenset(), wrapper: Matcher | None = None) -> str:
    """The main text of a page.  ``wrapper``: that of its host, which tells
    furniture by place; without one, ``constant`` are texts that are furniture
    outside the chief element."""
    if not html:
        return ""
    found, stream = blocks(html)
    if wrapper:
        out = furniture(found, wrapper.furniture(stream), wrapper.pages)
    else:
        out = [not b.chief and x in constant for b, x in zip(found, (x for x in stream if x[0] == "#"))]
    left = [b for b, gone in zip(found, out) if not (b.drop or gone) and (b.chief or not b.linked)]
    bounded = FAIR * sum(len(b.text) for b in left if b.chief) >= sum(len(b.text) for b in left)
    return "\n".join(b.text for b in left if b.main or not bounded or not any(x.chief for x in left))


def _merged(a: list, b: list) -> list:
    """Two folded pages of one structure."""
    return [_join(x, y) for x, y in zip(a, b)]


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"n": pa.int64(), "n_pages": pa.int64(), "deal": pa.int64(), "fixed": pa.list_(pa.string())}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.get(x, pa.string())) for k, x in enumerate(names)], names=names)


def wrappers(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(host, n_pages, expression, fixed, wrapper) for every host: how many
    different pages it has, its wrapper as text, the texts that all of them have,
    and the wrapper as JSON.  Copies of a page and pages without tokens teach
    nothing.  Pages of one structure are joined place by place where they are read;
    then structures are aligned in parts, and these in larger ones (``WIDTHS``),
    all in an order of their own, so the wrapper does not depend on how pages lie.
    What hardly a page has leaves the wrapper, so its length keeps to a multiple of
    the pages'."""
    own = pages.select(F.col(url).alias("url"), F.col(html).alias("html"))

    def tokens(batches):
        for batch in batches:
            rows = []
            for u, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                stream = blocks(x)[1] if x else []
                if stream:
                    items = folded(stream)
                    key = hashlib.blake2b(" ".join(stream).encode(), digest_size=16).hexdigest()
                    shape = hashlib.blake2b(" ".join(map(_kind, items)).encode(), digest_size=16).hexdigest()
                    rows.append((host(u), key, shape, json.dumps(items)))
            yield _batch(rows, ["host", "key", "shape", "items"])

    listed = own.mapInArrow(tokens, "host string, key string, shape string, items string").dropDuplicates(["host", "key"])

    def shapes(batches):
        held: dict = {}

        def out():
            return _batch([(h, int(s[:8], 16) % WIDTHS[0], s, n, json.dumps(w)) for (h, s), (n, w) in held.items()], ["host", "deal", "shape", "n", "items"])

        for batch in batches:
            for h, s, x in zip(*(batch.column(c).to_pylist() for c in ("host", "shape", "items"))):
                n, w = held.get((h, s), (0, None))
                x = loaded(json.loads(x))
                held[h, s] = (n + 1, _merged(w, x) if w else x)
            if len(held) > HELD:
                yield out()
                held.clear()
        yield out()

    def grouped(batches, width):
        """(key, rows) of neighbours whose first ``width`` columns are equal."""
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        return itertools.groupby(rows, key=lambda r: r[:width])

    def structures(batches):
        for (h, d), rows in grouped(batches, 2):
            total, wrapper = 0, None
            for _, same in itertools.groupby(rows, key=lambda r: r[2]):
                n, one = 0, None
                for r in same:
                    x = loaded(json.loads(r[4]))
                    n, one = n + r[3], _merged(one, x) if one else x
                wrapper = align(wrapper, one, total, n) if wrapper else one
                total += n
            yield _batch([(h, d, total, json.dumps(wrapper))], ["host", "deal", "n", "items"])

    def parts(batches):
        for (h, d), rows in grouped(batches, 2):
            total, wrapper = 0, None
            for r in rows:
                x = loaded(json.loads(r[4]))
                wrapper = align(wrapper, x, total, r[3]) if wrapper else x
                total += r[3]
            yield _batch([(h, d, total, json.dumps(wrapper))], ["host", "deal", "n", "items"])

    def said(batches):
        for batch in batches:
            rows = [(h, n, loaded(json.loads(x)), x) for h, n, x in zip(*(batch.column(c).to_pylist() for c in ("host", "n", "items")))]
            yield _batch([(h, n, expression(w), sorted(fixed(w)), x) for h, n, w, x in rows], ["host", "n_pages", "expression", "fixed", "wrapper"])

    df = listed.mapInArrow(shapes, "host string, deal long, shape string, n long, items string")
    df = df.repartition("host", "deal").sortWithinPartitions("host", "deal", "shape").mapInArrow(structures, "host string, deal long, n long, items string")
    for width in WIDTHS[1:]:
        df = df.select("host", (F.col("deal") % width).alias("to"), "deal", "n", "items").repartition("host", "to").sortWithinPartitions("host", "to", "deal").mapInArrow(parts, "host string, deal long, n long, items string")
    return df.mapInArrow(said, "host string, n_pages long, expression string, fixed array<string>, wrapper string")


def main_text(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page.  Null html is an empty page
    with empty text; pages without a host share the host ''; repeated rows and
    pages give equal texts; elements that are never closed end with their parent or
    the page; a very long page costs its own task; an empty table stays empty; other
    columns are ignored."""
    kind = pages.schema[id_col].dataType.simpleString()
    # staged: the join sees how large the wrappers are, broadcasts them only below Spark's bound, and can split a hot host
    known = staged(wrappers(pages, id_col, url, html).select(F.col("host").alias("h"), "n_pages", "wrapper"), "wrappers")
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    pattern = r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
    own = own.withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", pattern, 1), F.lit(""))))
    joined = own.join(known, own.host == known.h, "left").select("page_id", "url", "html", "wrapper", "n_pages")

    def read(batches):
        of: dict = {}  # the wrappers of late
        for batch in batches:
            texts = []
            for x, w, n in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4))):
                if w is not None and w not in of:
                    if len(of) >= 256:
                        of.clear()
                    of[w] = Matcher(loaded(json.loads(w)), n)
                texts.append(extract(x, wrapper=of.get(w)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")


def report(pages: DataFrame) -> DataFrame:
    return main_text(pages.select("page_id", "url", "html"))
