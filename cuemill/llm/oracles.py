"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from . import licenses, mixing, quality

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACES = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _part(p: str, q: str) -> str:
    return f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0 END)"


def quality_sql() -> str:
    n = len(quality.CLASSES)
    chain = "coalesce(text, '') AS t0"
    tables = [f"t_0 AS (SELECT row_number() OVER () AS rid, doc_id, lang, {chain} FROM documents)"]
    for k, (_, pattern) in enumerate(quality.CLASSES[:-1]):
        tables.append(f"t_{k + 1} AS (SELECT *, regexp_replace(t{k}, {_quoted(pattern)}, '', 'g') AS t{k + 1} FROM t_{k})")
    sizes = ", ".join(f"(length(t{k}) - length(t{k + 1}))::DOUBLE AS c{k}" for k in range(n - 1)) + f", length(t{n - 1})::DOUBLE AS c{n - 1}"
    total = " + ".join(f"c{k}" for k in range(n))
    ref_total = " + ".join(f"sum(c{k})" for k in range(n))
    shares = ", ".join(f"sum(c{k}) / greatest({ref_total}, 1) AS r{k}" for k in range(n))
    char = " + ".join(_part(f"(c{k} / greatest({total}, 1))", f"r{k}") for k in range(n))
    return f"""WITH {', '.join(tables)},
doc AS (SELECT rid, doc_id, lang, t0, {sizes}, list_filter(string_split(translate(t0, {_SPACES}, '     '), ' '), lambda x: x <> '') AS w, length(t0) - (length(t1) - length(t2)) AS word_chars,
  length(t1) - length(regexp_replace(t1, '[#*$%&|<>]+', '', 'g')) AS n_symbols, list_filter(string_split(t0, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t_{n - 1}),
word AS (SELECT rid, lang, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM doc),
win AS (SELECT rid, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS s FROM word WINDOW o AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win WHERE s IS NOT NULL) WHERE c > 1),
rep AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + k AS p FROM twice, (SELECT unnest(range({quality.SHINGLE})) AS k)) GROUP BY rid),
bare AS (SELECT rid, lang, lower(rtrim(w, '.,;:!?')) AS w, count(*)::DOUBLE AS n FROM word WHERE lang IS NOT NULL GROUP BY ALL),
top AS (SELECT lang, w FROM (SELECT lang, w, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, w) AS place FROM bare WHERE regexp_matches(w, {_quoted(quality.LETTERS)}) GROUP BY lang, w) WHERE place <= {quality.TOP}),
common AS (SELECT rid, b.lang, b.w, n FROM bare b JOIN top ON top.lang = b.lang AND top.w = b.w),
ref AS (SELECT lang, {shares}, greatest(sum(len(w)), 1)::DOUBLE AS words FROM doc WHERE lang IS NOT NULL GROUP BY lang),
refw AS (SELECT c.lang, w, sum(n) / any_value(words) AS q FROM common c JOIN ref ON ref.lang = c.lang GROUP BY c.lang, w),
known AS (SELECT lang, sum(q) AS known FROM refw GROUP BY lang),
seen AS (SELECT c.rid, sum({_part("(n / len(d.w))", "q")} - q) AS s, sum(n) AS m FROM common c JOIN doc d ON d.rid = c.rid JOIN refw r ON r.lang = c.lang AND r.w = c.w GROUP BY c.rid),
far AS (SELECT d.*, coalesce(rep.n, 0) AS n_repeat, sqrt(greatest(({char}) / 2, 0)) AS cd,
  sqrt(greatest((coalesce(s, 0) + coalesce(known, 0) + {_part("(1 - coalesce(m, 0) / greatest(len(w), 1))", "greatest(1 - coalesce(known, 0), 0)")}) / 2, 0)) AS wd
  FROM doc d LEFT JOIN ref ON ref.lang = d.lang LEFT JOIN known ON known.lang = d.lang LEFT JOIN seen ON seen.rid = d.rid LEFT JOIN rep ON rep.rid = d.rid)
SELECT doc_id, len(w)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat::BIGINT AS n_repeat_words,
  len(w) < 10 OR 100 * n_repeat > 20 * len(w) AS base_failed,
  NOT (len(w) < 10 OR 100 * n_repeat > 20 * len(w)) AND NOT coalesce(word_chars >= {quality.MIN_CHARS} AND cd > {quality.MAX_CHAR_DISTANCE}, false) AND NOT coalesce(lang IS NOT NULL AND len(w) >= {quality.MIN_WORDS} AND wd > {quality.MAX_WORD_DISTANCE} + {quality.WORD_NOISE} / sqrt(len(w)), false) AS kept
FROM far"""


def mixing_sql(seed: str = "mix") -> str:
    key = "struct_pack(rank := {0}.rank, id := {0}.id, size := {0}.size)"
    own = "struct_pack(size := {0}.size, rank := {0}.rank, id := {0}.id)"
    rounds, last = [], "start"
    for k in range(mixing.ROUNDS):
        rounds.append(
            f"""open{k} AS (SELECT d.source, {key.format('d')} AS key, gap, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.rank, d.id, d.size RANGE UNBOUNDED PRECEDING) AS run
  FROM ranked d JOIN {last} g ON g.source IS NOT DISTINCT FROM d.source WHERE p > 0 AND d.size > 0 AND d.size <= gap AND (after IS NULL OR {key.format('d')} > after)),
stop{k} AS (SELECT source, min(key) FILTER (WHERE run > gap) AS stop, coalesce(max(run) FILTER (WHERE run <= gap), 0) AS got FROM open{k} GROUP BY source),
fill{k} AS (SELECT g.source, g.after AS a, s.stop AS b, g.gap AS size_limit FROM {last} g LEFT JOIN stop{k} s ON s.source IS NOT DISTINCT FROM g.source),
next{k} AS (SELECT g.source, g.gap - coalesce(s.got, 0) AS gap, coalesce(s.stop, struct_pack(rank := 'infinity'::DOUBLE, id := NULL::BIGINT, size := NULL::BIGINT)) AS after FROM {last} g LEFT JOIN stop{k} s ON s.source IS NOT DISTINCT FROM g.source)"""
        )
        last = f"next{k}"
    taken = " OR ".join(f"EXISTS (SELECT 1 FROM fill{k} f WHERE f.source IS NOT DISTINCT FROM r.source AND r.size <= f.size_limit AND (f.a IS NULL OR {key.format('r')} > f.a) AND (f.b IS NULL OR {key.format('r')} < f.b))" for k in range(mixing.ROUNDS))
    weights = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(mixing.WEIGHTS))
    return f"""WITH docs AS (SELECT doc_id AS id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
  (('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM documents),
classes AS (SELECT source, length(bin(size)) AS digits, sum(size)::BIGINT AS words FROM docs GROUP BY ALL),
sums AS (SELECT source, sum(words)::BIGINT AS s FROM classes GROUP BY source),
w AS (SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} {weights} END)::DOUBLE AS weight, s * {float(mixing.MOST)}::DOUBLE AS lim FROM sums),
lv AS (SELECT *, (sum(s) OVER () - coalesce(sum(lim) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS lvl, row_number() OVER (ORDER BY lim / weight, source NULLS LAST) AS rk
  FROM w WINDOW b AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fin AS (SELECT source, s, coalesce(least(lim, (SELECT arg_min(lvl, rk) FROM lv WHERE lim / weight >= lvl) * weight), lim) AS target FROM lv),
plan AS (SELECT *, CASE WHEN s > 0 THEN least(floor(target / s), {mixing.MOST}) ELSE 0 END::BIGINT AS certain FROM fin),
part AS (SELECT *, greatest(target - certain * s, 0::DOUBLE) AS gap0 FROM plan),
level AS (SELECT c.source, digits, (gap0 - coalesce(sum(words) OVER b, 0)::DOUBLE) / (sum(words * digits) OVER (PARTITION BY c.source) - coalesce(sum(words * digits) OVER b, 0))::DOUBLE AS level
  FROM classes c JOIN part ON part.source IS NOT DISTINCT FROM c.source WHERE gap0 > 0 AND words > 0 WINDOW b AS (PARTITION BY c.source ORDER BY digits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rate AS (SELECT source, coalesce(arg_max(level, digits) FILTER (WHERE level * digits <= 1), 1.0::DOUBLE) AS c FROM level GROUP BY source),
odds AS (SELECT d.id, d.source, d.size, d.u, coalesce(least(1.0::DOUBLE, c * length(bin(d.size))), 0) * (EXISTS (SELECT 1 FROM level l WHERE l.source IS NOT DISTINCT FROM d.source AND l.digits = length(bin(d.size))))::INT AS p
  FROM docs d LEFT JOIN rate ON rate.source IS NOT DISTINCT FROM d.source),
ranked AS (SELECT o.id, o.source, o.size, o.p, s, target, certain, CASE WHEN p >= 1 THEN 0 WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank FROM odds o JOIN part ON part.source IS NOT DISTINCT FROM o.source),
start AS (SELECT source, gap0 AS gap, NULL::STRUCT(rank DOUBLE, id BIGINT, size BIGINT) AS after FROM part),
{', '.join(rounds)},
drawn AS (SELECT r.*, (certain + CASE WHEN p > 0 AND size > 0 AND ({taken}) THEN 1 ELSE 0 END)::BIGINT AS n FROM ranked r),
short AS (SELECT d.source, {own.format('d')} AS own, d.size, gap, sum(d.size * ({mixing.MOST} - n)) OVER (PARTITION BY d.source ORDER BY d.size, d.rank, d.id RANGE UNBOUNDED PRECEDING) AS run
  FROM drawn d JOIN {last} g ON g.source IS NOT DISTINCT FROM d.source WHERE n < {mixing.MOST} AND d.size > 0 AND d.size <= gap),
top AS (SELECT source, any_value(gap) AS gap, min(own) FILTER (WHERE run > gap) AS stop, coalesce(max(run) FILTER (WHERE run <= gap), 0) AS got FROM short GROUP BY source)
SELECT d.id AS doc_id, d.size, d.s AS source_size, d.target, copies * d.size AS taken, copies FROM (SELECT d.*, (CASE WHEN t.source IS NOT DISTINCT FROM d.source AND t.gap IS NOT NULL AND d.size > 0 AND d.size <= t.gap AND (t.stop IS NULL OR {own.format('d')} < t.stop) THEN {mixing.MOST}
  WHEN t.gap IS NOT NULL AND {own.format('d')} = t.stop THEN n + floor((t.gap - t.got) / d.size) ELSE n END)::BIGINT AS copies FROM drawn d LEFT JOIN top t ON t.source IS NOT DISTINCT FROM d.source) d"""


def decontamination_sql(window: int = 10) -> str:
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    words = lambda c: f"regexp_extract_all({_LOWER.format(c)}, {word})"
    return f"""WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({words('text')}, []) AS w FROM documents),
item AS (SELECT item_id::VARCHAR AS item, {words('text')} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item, list_slice(w, i, i + least(len(w), {window}) - 1) AS s FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), {window}) + 2)) AS i FROM item WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(s) AS m FROM win),
pos AS (SELECT rid, i, m, list_slice(w, i, i + m - 1) AS s FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc, lens WHERE len(w) >= m)),
hit AS (SELECT rid, i, m, item FROM pos JOIN win ON win.s = pos.s),
cover AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest(range(i, i + m)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hit WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(x.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN cover c ON c.rid = doc.rid LEFT JOIN items x ON x.rid = doc.rid"""


def licenses_sql() -> str:
    def canonical(text: str) -> str:
        out = f"lower(coalesce({text}, ''))"
        out = f"array_to_string(list_filter(string_split_regex({out}, '\\r\\n|\\r|\\n'), lambda x: NOT regexp_matches(x, {_quoted(licenses._COPYRIGHT)})), chr(10))"
        for old, new in licenses.SPELLINGS:
            out = f"replace({out}, {_quoted(old)}, {_quoted(new)})"
        return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"

    notices = ", ".join(f"({_quoted(k)}, {_quoted(x)})" for k, v in licenses.NOTICES.items() for x in v)
    texts = ", ".join(f"({_quoted(k)}, {_quoted(x)})" for k, v in licenses.TEXTS.items() for x in licenses.forms(k, v))
    return f"""WITH lines AS (SELECT min(name) AS name, {canonical('t')} AS f FROM (VALUES {notices}) v(name, t) GROUP BY 2),
whole AS (SELECT min(name) AS name, {canonical('t')} AS f FROM (VALUES {notices}, {texts}) v(name, t) GROUP BY 2),
doc AS (SELECT row_number() OVER () AS rid, doc_id, text, {canonical('text')} AS f FROM documents),
hit AS (SELECT rid, lines.name FROM (SELECT rid, {canonical('line')} AS f FROM (SELECT rid, unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS line FROM doc) WHERE regexp_matches(line, {_quoted(licenses.CANDIDATE)})) c JOIN lines ON lines.f = c.f)
SELECT doc_id, CASE WHEN doc.f <> '' THEN sha256(doc.f) END AS digest, whole.name AS license, count(hit.rid) AS n_notices, coalesce(string_agg(DISTINCT hit.name, ',' ORDER BY hit.name), '') AS notices
FROM doc LEFT JOIN whole ON whole.f = doc.f LEFT JOIN hit ON hit.rid = doc.rid GROUP BY doc.rid, doc_id, doc.f, whole.name"""


def codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Plain Lloyd rounds, each over all distances."""
    far = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    near = "a{0} AS MATERIALIZED (SELECT rid, x.p, x, first(j ORDER BY {1}, j) AS j, min({1}) AS d FROM x JOIN b{0} b ON b.p = x.p GROUP BY rid, x.p, x)"
    move = """b{1} AS MATERIALIZED (SELECT b.p, b.j, coalesce(m.c, b.c) AS c FROM b{0} b LEFT JOIN (
  SELECT p, j, list(floor(s / n)::BIGINT ORDER BY i) AS c FROM (SELECT p, j, i, sum(v)::DOUBLE AS s, count(*) AS n FROM (SELECT p, j, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{0}) GROUP BY p, j, i) GROUP BY p, j) m ON m.p = b.p AND m.j = b.j)"""
    steps = [near.format(0, far)] + [part for r in range(rounds) for part in (move.format(r, r + 1), near.format(r + 1, far))]
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT rid, p, list_slice(x, p * (len(x) // {parts}) + 1, (p + 1) * (len(x) // {parts})) AS x FROM v, range({parts}) t(p)),
b0 AS (SELECT p, rid - 1 AS j, x AS c FROM x WHERE rid <= {entries}),
{", ".join(steps)},
r AS (SELECT rid, string_agg(printf('%02x', j), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(v, ',' ORDER BY p, j, i)) FROM (SELECT p, j, unnest(c)::VARCHAR AS v, generate_subscripts(c, 1) AS i FROM b{rounds})) AS codebooks_sha256
FROM r JOIN v USING (rid)"""


def search_sql(k: int = 10) -> str:
    words = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH doc AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents WHERE text IS NOT NULL),
tf AS MATERIALIZED (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM doc) GROUP BY rid, term),
num AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM doc WHERE len(w) > 0),
weight AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM tf, num GROUP BY term, n),
asked AS (SELECT DISTINCT item_id, unnest({words}) AS term FROM benchmark),
score AS (SELECT item_id, rid, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(doc.w)::BIGINT * n) // l))))::BIGINT AS score
  FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN doc USING (rid), num GROUP BY item_id, rid)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM score JOIN doc USING (rid) WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) <= {k}"""
