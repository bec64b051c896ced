"""Whole licences in their published wrapping, and which lines are copyright notices."""

import re
import textwrap

import pytest

from cuemill.llm import licenses

ISC = """ISC License

Copyright (c) 2020 Jane Doe

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR
IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
# first and last words of the whole text
WHOLE = {
    "Apache-2.0": ("Apache License", "limitations under the License."),
    "GPL-2.0": ("GNU GENERAL PUBLIC LICENSE", "instead of this License."),
    "GPL-3.0": ("GNU GENERAL PUBLIC LICENSE", "<https://www.gnu.org/licenses/why-not-lgpl.html>."),
    "LGPL-3.0": ("GNU LESSER GENERAL PUBLIC LICENSE", "Library."),
    "MPL-2.0": ("Mozilla Public License Version 2.0", "defined by the Mozilla Public License, v. 2.0."),
    "CC0-1.0": ("Creative Commons Legal Code", "CC0 or use of the Work."),
    "BSD-2-Clause": ("BSD 2-Clause License", "POSSIBILITY OF SUCH DAMAGE."),
    "BSD-3-Clause": ("BSD 3-Clause License", "POSSIBILITY OF SUCH DAMAGE."),
    "Unlicense": ("This is free and unencumbered", "<http://unlicense.org/>"),
}


def notice(line):
    return re.search(licenses._COPYRIGHT, line.lower()) is not None


def wrapped(text, width):
    out = []
    for part in re.split(r"\n\s*\n", text.replace("<year> <holders>", "2021 Some Body")):
        lines = part.split("\n")
        if any(notice(x) for x in lines):
            out.append(part)
        else:
            out.append("\n".join(textwrap.wrap(" ".join(part.split()), width, break_long_words=False, break_on_hyphens=False)))
    return "\n\n".join(out)


def test_whole_texts(spark):
    for name, (first, last) in WHOLE.items():
        assert licenses.TEXTS[name].strip().startswith(first) and licenses.TEXTS[name].strip().endswith(last)
    names = sorted(licenses.TEXTS)
    rows = [(f"{n}/{w}", wrapped(licenses.TEXTS[n], w)) for n in names for w in (40, 60, 72, 80, 1000)] + [(f"{n}/0", licenses.TEXTS[n]) for n in names] + [("ISC/isc", ISC)]
    got = {r.doc_id: r.license for r in licenses.report(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert {k: v for k, v in got.items() if v != k.split("/")[0]} == {}


@pytest.mark.parametrize("line", [
    "copyright notice and this permission notice appear in all copies.", "copyright license to reproduce, prepare Derivative Works of,", "copyright the software, and", "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM",
    "(c) You must retain, in the Source form of any Derivative Works", "copyright law.", "COPYRIGHT AND PERMISSION NOTICE", "copyright notice, this list of conditions", "COPYRIGHT HOLDERS AND CONTRIBUTORS",
])
def test_sentences_stay(line):
    assert not notice(line)


@pytest.mark.parametrize("line", [
    "Copyright (c) 2016 Alex Crichton", "Copyright [yyyy] [name of copyright owner]", "   Copyright {yyyy} {name of copyright owner}", "Copyright Amazon.com, Inc. or its affiliates. All Rights Reserved.", "# (c) 2020 X",
    "Copyright Mozilla Foundation", "Copyright 2018 Developers of the Rand project", "Copyright the Rust project developers", "© 2021 Kornel", "Copyright Jane Doe <jane@doe.org>", "(c) Jane Doe", "All rights reserved.", "Copyright (C) <year>  <name of author>",
])
def test_notices_go(line):
    assert notice(line)


def test_notices_in_any_spacing_and_long_texts(spark):
    """What stands between the words of a notice does not matter; a text of
    millions of characters, clashing column names and ties have results."""
    mit = licenses.TEXTS["MIT"]
    rows = [(1, "Released  under CC0 1.0", "x", 1), (2, "released-under the\tMIT license", "x", 1), (3, "word " * 400_000 + "\nReleased under the MIT license", "x", 1), (4, mit, "x", 1), (4, mit, "x", 1), (5, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string, hits int")
    got = licenses.scan(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 6 and by[1].notices.startswith("CC0") and by[2].notices == by[3].notices == "MIT"
    assert by[4].license == "MIT" and by[5].digest is None


def test_forms_that_documents_hold(spark):
    """Without a heading or under another one, with bullets, without the appendix; SPDX identifiers."""
    mit, bsd, apache = licenses.TEXTS["MIT"], licenses.TEXTS["BSD-3-Clause"], licenses.TEXTS["Apache-2.0"]
    whole = {
        "MIT": [mit.replace("MIT License\n", "", 1), mit.replace("MIT License", "The MIT License (MIT)", 1)],
        "BSD-3-Clause": [bsd.partition("\n")[2], bsd.replace("1.", "*").replace("2.", "*").replace("3.", "*"), bsd.partition("\n")[2].replace("1.", "-").replace("2.", "-").replace("3.", "-")],
        "Apache-2.0": [apache[: apache.index("APPENDIX")], apache],
        "ISC": [licenses.TEXTS["ISC"].partition("\n")[2]],
    }
    rows = [(name, x) for name, texts in whole.items() for x in texts]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert all(r.license == r.doc_id for r in got), [r.doc_id for r in got if r.license != r.doc_id]
    for line, name in (("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later"), ("// SPDX-License-Identifier: ISC", "ISC"), ("SPDX-License-Identifier: MIT", "MIT"), ("# spdx-license-identifier: Zlib", "Zlib")):
        assert licenses.scan(spark.createDataFrame([(1, f"code\n{line}\nmore")], "doc_id long, text string")).first().notices == name
    own = {"House": ["Ask the owner first."]}  # a caller's notices need none of the usual words
    assert licenses.scan(spark.createDataFrame([(1, "x\nask the owner first\n")], "doc_id long, text string"), notices=own).first().notices == "House"
