"""License scans by canonical digests.

A text is brought to a canonical form (lower case, copyright lines and lines
that only reserve rights dropped, equivalent spellings made one, punctuation and
spacing gone) and its SHA-256 is joined with the digests of known licences: the
whole text against whole licences, and each line against the licences' one-line
notices.  Only digests meet in the join; lines are digested and counted per
document before anything is shuffled.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Notices by which documents name their licence, and short licences as published.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "Released under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
}
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEXTS = {
    "MIT": """MIT License

Copyright (c) <year> <holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

"""
    + _WARRANTY,
    "ISC": """ISC License

Copyright (c) <year> <holders>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-3-Clause": """BSD 3-Clause License

Copyright (c) <year>, <holders>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
    + _BSD,
    "BSD-2-Clause": """BSD 2-Clause License

Copyright (c) <year>, <holders>

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
    + _BSD,
    **{x.stem: x.read_text("utf-8") for x in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))},  # as published
}

# SPDX identifiers that documents name beside those above.
SPDX = (
    "0BSD AFL-3.0 AGPL-3.0-or-later AGPL-3.0 Apache-1.1 APSL-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0 BSD-1-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 "
    "CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3-only GFDL-1.3-or-later "
    "GPL-2.0 GPL-2.0+ GPL-2.0-or-later GPL-3.0 GPL-3.0+ GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-or-later LPL-1.02 MIT-0 MPL-1.1 MS-PL MS-RL MulanPSL-2.0 NCSA "
    "ODbL-1.0 OFL-1.1 OSL-3.0 PostgreSQL PSF-2.0 Python-2.0 Ruby Unicode-3.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1"
).split()
for _id in SPDX:
    NOTICES.setdefault(_id, []).append(f"SPDX-License-Identifier: {_id}")

#: Other headings under which a text is published.
HEADINGS = {"MIT": ["The MIT License (MIT)", "The MIT License", "MIT License (MIT)"], "BSD-3-Clause": ["The 3-Clause BSD License", "BSD-3-Clause"], "BSD-2-Clause": ["The 2-Clause BSD License", "BSD-2-Clause"], "ISC": ["The ISC License", "ISC License (ISC)"]}


def forms(name: str, text: str) -> list[str]:
    """A licence as published, without its heading or under another one, without an
    appendix on how to apply it, and with bullets for numbers: what documents hold."""
    heading, _, rest = text.strip().partition("\n")
    out = [text]
    if len(heading) < 80 and re.search(r"licen[cs]e", heading, re.I):
        out += [rest, *[f"{h}\n{rest}" for h in HEADINGS.get(name, ())]]
    out += [x[: m.start()] for x in out[:] if (m := re.search(r"(?m)^\s*APPENDIX: How to apply", x))]
    out += [re.sub(r"(?m)^(\s*)\d+\.(?=\s)", r"\1*", x) for x in out[:] if name.startswith("BSD")]
    return list(dict.fromkeys(out))


# Spellings that count as one, longest first.
SPELLINGS = [
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("non-infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("licence", "license"),
    ("organisation", "organization"),
    ("version 2.0", "version 2"),
    ("version\n2.0", "version 2"),
    ("https:", "http:"),
    ("(c)", "©"),
]
#: A line that can be a notice, whatever stands between its words.
CANDIDATE = r"(?i)licen[cs]e|spdx|released[^\p{L}\p{N}]+under|subject[^\p{L}\p{N}]+to"
# Words after which "copyright" goes on as a sentence, not as a notice.
_SENTENCE = "a above all and any are as but by can claim claims disclaimer doctrine doctrines for from has holder holders if in infringement interest interests is it its law laws license licensed licenses licensor may must not notice notices of on or owned owner owners ownership patent permission policy protected protection right rights shall statement statements such term terms that the their this to treaties treaty under will with within work works you your".split()


def _none_of(words: list[str], first: bool = True) -> str:
    """A pattern for one word that is none of ``words``, without look-ahead."""
    firsts = sorted({w[0] for w in words if w})
    ways = [rf"[^{''.join(firsts)}\s.,;:)'-][^\s]*"] + [x + _none_of([w[1:] for w in words if w and w[0] == x], False) for x in firsts]
    if not first and "" not in words:
        ways.append("")
    return f"(?:{'|'.join(ways)})"


# A notice has a sign, a year (or the place for it) or a holder; lines are in lower case.
_YEAR = r"[\[<{(]*(?:\d{4}|y{2,4}\b|year\b)"
_NAMES = rf"{_none_of(_SENTENCE)}(?:[.,;:)'-]\S*)?(?:\s+\S+){{0,5}}?"
_GROUP = r"the\s.*\b(?:authors|contributors|developers|foundation|university|project|team|maintainers|regents)\b"
_HOLDER = rf"(?:by\s+)?(?:{_GROUP}|[^\s].*\b(?:inc|llc|ltd|gmbh|corp|corporation)\b|{_NAMES})"
_RESERVED = r"(?:[.,;\s]*all rights reserved)?[.\s]*"
_COPYRIGHT = rf"^[\s#*/;>-]*(?:copyright[\s:,]*(?:\(c\)|©).*|copyright[\s:,]*{_YEAR}.*|©.*|\(c\)\s*(?:copyright\b|{_YEAR}).*|(?:copyright[\s:,]|\(c\))\s*{_HOLDER}{_RESERVED}|all rights reserved\.?\s*)$"


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines, with one spelling, words only."""
    out = F.lower(F.coalesce(text, F.lit("")))
    out = F.array_join(F.filter(F.split(out, r"\r\n|\r|\n", -1), lambda x: ~x.rlike(_COPYRIGHT)), "\n")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; null if nothing is left of the text."""
    form = canonical(text)
    return F.when(form != "", F.sha2(form, 256))


def known(spark, texts: dict[str, str] | None = None, notices: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(digest, license) of whole licences, and of one-line notices."""

    def table(rows):
        df = spark.createDataFrame(rows, T.StructType([T.StructField("name", T.StringType()), T.StructField("text", T.StringType())]))
        return df.select(digest(F.col("text")).alias("digest"), "name").groupBy("digest").agg(F.min("name").alias("license"))

    lines = [(k, x) for k, v in (notices or NOTICES).items() for x in v]
    return table([*[(k, x) for k, v in (texts or TEXTS).items() for x in forms(k, v)], *lines]), table(lines)


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", texts=None, notices=None) -> DataFrame:
    """(doc_id, digest, license, n_notices, notices): the digest of the whole
    text and the licence that it is, if any; how many lines are notices, and the
    licences that they name, sorted and comma-joined.

    Null and empty texts, and texts of copyright lines only, have a null digest
    and no licence; a very long text costs its own task; of licences of one digest
    the first by name counts.  Rows are judged one by one, so repeated rows and ids give
    as many results; other columns are ignored; no rows give no rows.
    """
    whole, lines = known(docs.sparkSession, texts, notices)
    # The tables hold what this module or the caller lists, so their size is known.
    few = {r["digest"]: r["license"] for r in lines.collect()}
    all_ = F.broadcast(whole.select(F.col("digest").alias("d"), F.col("license")))
    names = F.create_map(*[F.lit(x) for pair in few.items() for x in pair]) if few else F.expr("map()").cast("map<string,string>")
    # only lines that can be notices are digested: those with a word that every notice has one of
    every = all(re.search(CANDIDATE.replace(r"\p{L}\p{N}", r"\w"), x) for v in (notices or NOTICES).values() for x in v)
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    candidates = F.filter(F.split(own, r"\r\n|\r|\n", -1), lambda x: x.rlike(CANDIDATE)) if every else F.split(own, r"\r\n|\r|\n", -1)
    hits = F.filter(F.transform(candidates, lambda x: F.try_element_at(names, F.coalesce(digest(x), F.lit("")))), lambda x: x.isNotNull())
    df = docs.select(F.col(f"`{id_col}`").alias("doc_id"), digest(F.col(f"`{text}`")).alias("digest"), hits.alias("hits"))
    joined = df.join(all_, df.digest == all_.d, "left")
    return joined.select("doc_id", "digest", "license", F.size("hits").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("hits")), ",").alias("notices"))


def report(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text"))
