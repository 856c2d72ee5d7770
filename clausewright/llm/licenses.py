"""Licence scans by canonical digests of entire texts.

A text is put in canonical form (case, copyright statements, equivalent spellings,
punctuation, spacing) and its SHA-256 is looked up among the digests of known
licence texts by a hash join. The form and the digest are built-in JVM
expressions, one narrow pass over the documents; the known table is a fixed
list, so it may be broadcast while it has at most ``BROADCAST_ROWS`` rows.

Known are the texts of ``KNOWN`` and of the files in ``license_texts`` (named by
SPDX id, what follows a ``~`` tells variants apart), each as a whole, without
its title and without what follows its terms. Whole texts are looked up: a
notice or licence inside a longer text is not found.

Defined cases: a null text counts as empty; an empty canonical form has no
licence; repeated rows are each looked up; ids may be of any type; a text of any
length is put in form whole; licences of equal digest resolve to the first name; an
empty known table leaves every licence null, an empty table gives no rows; extra columns are
left alone, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import named

BROADCAST_ROWS = 10_000

# Equivalent spellings, as the SPDX matching guidelines list them.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("catalogue", "catalog"), ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"),
    ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"),
    ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"),
    ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"),
    ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "wilfull"), ("noncommercial", "non commercial"),
    ("sublicence", "sublicense"), ("copyright owner", "copyright holder"),
)

# Texts of known licences, and the one-line notices that stand for them.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
}

#: How many lines of a file in license_texts, blank ones aside, are its title.
TITLE_LINES = {
    "Apache-2.0": 3, "Artistic-1.0-Perl": 1, "Artistic-2.0": 1, "BSL-1.0": 1, "BlueOak-1.0.0": 2, "CC0-1.0": 2, "GFDL-1.2": 2, "GFDL-1.3": 2, "GPL-1.0": 2, "GPL-2.0": 2, "GPL-3.0": 2,
    "LGPL-2.0": 2, "LGPL-2.1": 2, "LGPL-3.0": 2, "MPL-1.1": 2, "MPL-2.0": 1, "Unicode-3.0": 1, "WTFPL": 2,
}
# Titles that the licences which have none of their own are published under.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)", "MIT", "(MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng license", "The zlib/libpng License", "zlib"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD 0-Clause License", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "2-Clause BSD License", "Simplified BSD License", 'BSD 2-Clause "Simplified" License', "BSD License", "The BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "3-Clause BSD License", "New BSD License", 'BSD 3-Clause "New" or "Revised" License', "BSD License", "The BSD License"),
    "Unlicense": ("The Unlicense", "Unlicense", "The Unlicense (Unlicense)"),
}
END = "END OF TERMS AND CONDITIONS"

#: Each step is (pattern, replacement); the patterns mean the same in RE2 and in Java. The first is that of the SQL, which takes
#: any line that begins with the word or the sign (no line of the tables does); canonical() has STATEMENT in its place.
STEPS = (
    (r"(^|\n)[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*", r"\n"),
    (r"(^|\n)[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*", r"\n"),
    (r"[\x00-\x2F\x3A-\x60\x7B-\x7F‐-―‘-‟«»©]+", " "),
    *((f"(^| ){a}( |$)", f"\\1{b}\\2") for a, b in SPELLINGS),
    (r"^ +| +$", ""),
)


# What follows "copyright" in running text, where a line may break before the word.
RUNNING = (
    r"notices?|holders?|owners?|ownership|licen[cs]e[sd]?|laws?|interests?|statements?|lines?|disclaimers?|permissions?|treat(?:y|ies)|doctrines?|rights?|protect(?:ion|ed)|claims?|infringements?|materials?|works?|"
    r"patents?|trademarks?|status|acts?|terms|information|symbols?|resulting|and|or|nor|on|in|of|to|for|with|from|under|at|as|also|are|is|was|were|has|have|if|that|which|those|each|shall|may|will|must|can|"
    r"the (?:software|library|program|work|document)"
)
#: A copyright statement: the word or sign with the other, a year or a holder. "(c)" alone takes a year, since lists use it too.
STATEMENT = (
    r"(^|\n)[^a-z0-9\n]*(?:"
    r"copyright[ \t:]*(?:\(c\)|©)|copyright[^a-z0-9\n]*(?:19|20)[0-9x]{2}|(?:(?:\(c\)|©)[ \t]*)?copyright[ \t]*:?[ \t]+(?![^a-z0-9\n]*(?:" + RUNNING + r")(?![a-z0-9]))[^ \t\n]|"
    r"\(c\)[ \t]*(?:copyright[ \t]*)?[\[<{]?(?:year|yyyy|(?:19|20)[0-9x]{2})|©(?![ \t]*copyright)[ \t]*[^ \t\n]"
    r")[^\n]*"
)


def canonical(text: Column) -> Column:
    """The canonical form: lower-case words of letters and digits, one space between them."""
    out = F.lower(F.coalesce(text, F.lit("")))
    head, middle, tail = ((STATEMENT, r"\n"), *STEPS[1:3]), STEPS[3:-1], STEPS[-1]
    for pattern, by in head:
        out = F.regexp_replace(out, pattern, by.replace(r"\n", "\n"))
    # one pass for all spellings: only texts that hold one of them go through the chain
    chained = out
    for pattern, by in middle:
        # the blank after a word is left for the next one: words may follow each other
        chained = F.regexp_replace(chained, pattern.replace("( |$)", "(?= |$)"), by.replace("\\1", "$1").replace("\\2", ""))
    out = F.when(out.rlike("(^| )(" + "|".join(a for a, _ in SPELLINGS) + ")( |$)"), chained).otherwise(out)
    return F.regexp_replace(out, tail[0], tail[1])


def _variants(body: str, title_lines: int) -> set[str]:
    """The text with and without its title, what follows its terms, and list numbers (BSD); with http or https."""
    lines = body.strip().split("\n")
    filled = [i for i, x in enumerate(lines) if x.strip()]
    out = {body, "\n".join(lines[filled[title_lines] :])}
    for x in list(out):
        terms, end, _ = x.partition(END)
        out |= {terms + end, terms}
    if "Redistribution and use" in body:
        out |= {re.sub(r"(?m)^\s*[0-9]\. ", "", x) for x in out}
    return out | {x.replace("http://", "https://") for x in out} | {x.replace("https://", "http://") for x in out}


def known_texts() -> list[tuple[str, str]]:
    """(license, text): every form under which a known licence is looked up."""
    out = {(k, x) for k, v in KNOWN.items() for x in _variants(v, 0)}
    out |= {(k, x.replace("and/or distribute", "and distribute")) for k, x in out if k == "ISC"}
    for f in (resources.files(__package__) / "license_texts").iterdir():
        name = f.name.removesuffix(".txt").split("~")[0]
        out |= {(name, x) for x in _variants(f.read_text("utf-8"), TITLE_LINES.get(name, 0))}
    out |= {(k, f"{t}\n{x}") for k, x in out for t in TITLES.get(k, ())}
    return sorted(out)


def known_digests(spark: SparkSession, known: Mapping[str, str] | None = None) -> DataFrame:
    """digest, license of the given texts, or of all known ones."""
    rows = spark.createDataFrame(known_texts() if known is None else list(known.items()), "license string, body string")
    form = canonical(F.col("body"))
    return rows.where(form != "").groupBy(F.sha2(form, 256).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, canonical_words, digest, license (null: no known text), one row per row.

    ``known`` has columns digest and license, one row per digest.
    """
    rows = named(docs, doc_id=id_col, text=text_col).select("doc_id", canonical(F.col("text")).alias("form"))
    rows = rows.select("doc_id", F.when(F.col("form") == "", 0).otherwise(F.length(F.regexp_replace("form", "[^ ]+", "")) + 1).cast("long").alias("canonical_words"), F.sha2("form", 256).alias("digest"))
    small = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(known) if small else known, "digest", "left").select("doc_id", "canonical_words", "digest", "license")
