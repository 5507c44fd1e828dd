"""License scans by canonical digests.

A text is brought to a canonical form: lower case (A-Z), no copyright notices, equivalent spellings made one, everything but
letters and digits a single space, so that line wrapping, comment marks and punctuation do not count. Its SHA-256 is looked up
among the digests of known texts by a hash join; so is that of every line, for one-line notices. All of it is built-in
expressions, in one narrow pass; the known table is small and its size is checked before it is broadcast.

A notice is a line that begins with copyright, (c) or the sign and goes on with a sign, a year or a holder, and the lines that
follow after a comma at a line's end. A line of a license's body that wraps before "copyright notice" or "copyright holders" is
none; a "(c)" without a year counts only in texts without a list item "(b)".

Known are (``catalogue``): the texts in full of MIT, ISC, 0BSD and of the files in ``known_licenses``, with and without their usual
titles, the BSD ones numbered, starred or lettered, the GNU ones and Apache-2.0 with and without what follows their terms; and
one-line notices of these licenses and some Creative Commons ones in the ``PHRASES``. Other texts have license null.

Edge cases: null counts as the empty text, and the empty canonical form matches nothing known; repeated rows each get their own
result; if two known texts have one digest the first id is given; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import re
from functools import cache
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_YEAR = r"[<\[{(]?(?:\d{4}|year|yyyy|19yy|19xx)\b"
#: Words that follow "copyright" where it is no notice.
_BODY = (r"(?:and|or|of|on|if|in|is|are|as|by|to|for|under|with|from|that|this|these|those|which|shall|may|also|like|the|license[sd]?|"
         r"licensing|notices?|holders?|holder's|owners?|owner's|ownership|laws?|lines?|disclaimers?|interests?|permissions?|"
         r"resulting|patents?|statements?|doctrines?|treaty|treaties|protection|protected|rights?|status|grants?|information|material|works?)\b")
_THE = r"the(?:[ \t]+\S+){1,5}?[ \t]+(?:authors?|contributors?|developers?|projects?|foundation|team|company|university)\b"
_NOTICE = (rf"copyright[ \t]*:?[ \t]*(?:(?:\(c\)|©|&copy;)[^\n]*[a-z0-9]|{_YEAR}|(?<=[ \t])(?:{_THE}|(?!{_BODY})[a-z]))|"
           rf"(?:\(c\)|©|&copy;)[ \t]*(?:copyright[ \t]*)?{_YEAR}|(?:©|&copy;)[^\n]*[a-z]")
_GAP = r"[\s#*/;]+"
_REST = r"(?:[^\n]*,[ \t]*\n)*+[^\n]*+"

#: Pattern and replacement, in this order; the text is in lower case. The first three are notices of fixed wording inside bodies.
STEPS = [
    (rf"copyright{_GAP}\(c\){_GAP}[\d,\s]+free{_GAP}software{_GAP}foundation,?{_GAP}inc\.?,?(?:{_GAP}<?https?://(?:www\.)?fsf\.org/?>?|"
     rf"{_GAP}(?:51{_GAP}franklin|59{_GAP}temple|675{_GAP}mass)[^<>()]{{10,90}}?usa\b\.?)?", " "),
    (rf"copyright{_GAP}(?:\(c\){_GAP})?[<\[{{]?(?:year|yyyy|19yy|19xx)[>\]}}]?{_GAP}[<\[{{]?"
     rf"(?:name{_GAP}of{_GAP}(?:copyright{_GAP}owner|author)|your{_GAP}name)[>\]}}]?\.?", " "),
    (rf"copyright{_GAP}\(c\){_GAP}_+{_GAP}_+\.?", " "),
    (rf"(?:^|\n)[^a-z\n]*(?:{_NOTICE}){_REST}", "\n"),
    (r"licence", "license"),
    (r"&", " and "),
    (r"https:", "http:"),
    (r"[^a-z0-9\x{80}-\x{10FFFF}]+", " "),
    (r"sub license", "sublicense"),
    (r"non infringement", "noninfringement"),
    (r"copyright owner", "copyright holder"),
    (r"copyright holders", "copyright holder"),
    (r"acknowledgement", "acknowledgment"),
    (r"\b(organi|authori|recogni|reali|utili)s(?=ation|e[ds]? |ing )", "$1z"),
    (r"\b(fav|hon|behavi)our", "$1or"),
]
#: "(c)" and a holder without a year, in texts without "(b)".
BARE = rf"(?:^|\n)[^a-z\n]*\(c\)[^\n]*[a-z]{_REST}"

#: Most known texts that are broadcast as literals.
KNOWN_AT_MOST = 5_000

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted"""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: Public license texts and notices.
KNOWN = {
    "MIT": _MIT,
    "MIT-titled": "MIT License\n" + _MIT,
    "ISC": _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_END,
    "0BSD": _ISC_GRANT + ". " + _ISC_END,
    "notice-Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice-MIT": "Released under the MIT License.",
    "notice-GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice-CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "notice-reserved": "All rights reserved.",
    "notice-SPDX-MIT": "SPDX-License-Identifier: MIT",
    "notice-SPDX-Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
}


#: How one-line notices name a license; every name goes into every phrase.
NAMES = {
    "MIT": ["MIT License", "MIT"],
    "ISC": ["ISC License", "ISC"],
    "0BSD": ["Zero-Clause BSD License", "BSD Zero Clause License", "0BSD"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache 2.0", "Apache-2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD-3-Clause"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GNU GPLv2", "GPL v2", "GPLv2", "GPL-2.0", "GPL-2.0-only"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GNU GPLv3", "GPL v3", "GPLv3",
                "GPL-3.0", "GPL-3.0-only"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPL v2.1", "LGPLv2.1", "LGPL-2.1", "LGPL-2.1-only"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPL v3", "LGPLv3", "LGPL-3.0", "LGPL-3.0-only"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"],
    "Zlib": ["zlib License", "zlib"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0", "CC0-1.0", "CC0"],
    **{f"CC-{k.replace(' ', '-')}-{v}": [f"Creative Commons {name} {v} International License" if v == "4.0" else f"Creative Commons {name} {v} Unported License",
                                         f"CC {k} {v}", f"CC-{k}-{v}", f"CC {k} {v} License"]
       for v in ("3.0", "4.0") for k, name in {
           "BY": "Attribution", "BY SA": "Attribution-ShareAlike", "BY NC": "Attribution-NonCommercial", "BY ND": "Attribution-NoDerivatives",
           "BY NC SA": "Attribution-NonCommercial-ShareAlike", "BY NC ND": "Attribution-NonCommercial-NoDerivatives"}.items()},
}
_WORK = ["", "This work is ", "This project is ", "This software is "]
PHRASES = ["SPDX-License-Identifier: {}", "License: {}", *[
    f"{work}{verb} under {the}{{}}" for work in _WORK for verb in ("licensed", "released", "distributed") for the in ("the ", "")]]

_TITLES = {
    "MIT": ["The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "ISC"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "0BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD-3-Clause", "BSD License"],
    "Zlib": ["zlib License", "The zlib License"],
    "Unlicense": ["The Unlicense", "Unlicense", "UNLICENSE"],
}
_TITLE_ID = {"MIT": "MIT-titled"}
#: The first words of what follows the terms.
_AFTER = {"Unlicense": "For more information", "Apache-2.0": "APPENDIX: How to apply", "GPL-1.0": "Appendix: How to Apply", "GPL-2.0": "How to Apply These Terms",
          "GPL-3.0": "How to Apply These Terms", "LGPL-2.0": "How to Apply These Terms", "LGPL-2.1": "How to Apply These Terms"}


@cache
def catalogue() -> tuple[tuple[str, str], ...]:
    """(id, text) of all known texts and notices; an id has several."""
    out = list(KNOWN.items())
    texts = {k: [KNOWN[k]] for k in ("MIT", "ISC", "0BSD")}
    for file in sorted(resources.files("folderloom.llm").joinpath("known_licenses").iterdir(), key=lambda f: f.name):
        texts[file.name.removesuffix(".txt")] = [file.read_text("utf-8")]
    for k, after in _AFTER.items():
        whole = texts[k][0]
        texts[k].append(whole[:whole.rindex(after)])
    for k in ("BSD-2-Clause", "BSD-3-Clause"):
        body = texts[k][0]
        texts[k] += [re.sub(r"(?m)^\d\.", "*", body), re.sub(r"(?m)^(\d)\.", lambda m: f"({'abc'[int(m[1]) - 1]})", body)]
        texts[k] += [x.replace("name of the copyright holder", other) for x in texts[k]
                     for other in ("name of the University", "names of the copyright holders", "name of copyright holder")]
        texts[k] = [x for y in texts[k] for x in (y, "All rights reserved.\n\n" + y)]
    for k, versions in texts.items():
        for x in dict.fromkeys(versions):
            out.append((k, x))
            out += [(_TITLE_ID.get(k, k), f"{title}\n\n{x}") for title in _TITLES.get(k, [])]
    out += [(f"notice-{k}", phrase.format(name)) for k, names in NAMES.items() for name in names for phrase in PHRASES
            if not (k in ("MIT", "Apache-2.0") and phrase.startswith("SPDX"))]
    return tuple(out)


def canonical(text: Column) -> Column:
    out = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for pattern, by in STEPS[:4]:
        out = F.regexp_replace(out, pattern, by)
    out = F.when(out.contains("(c)") & ~out.contains("(b)"), F.regexp_replace(out, BARE, "\n")).otherwise(out)
    for pattern, by in STEPS[4:]:
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def scan(docs: DataFrame, known: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest of the whole canonical text, license (its known id) and notices (sorted known ids of single lines)."""
    spark = docs.sparkSession
    if known is None:
        known = spark.createDataFrame(catalogue(), "id string, text string")
    table = known.where(F.col("id").isNotNull()).select("id", digest(F.coalesce("text", F.lit(""))).alias("digest")).where(
        F.col("digest") != digest(F.lit("")))
    table = table.groupBy("digest").agg(F.min("id").alias("id"))
    rows = table.limit(KNOWN_AT_MOST + 1).collect()
    if len(rows) > KNOWN_AT_MOST:
        raise ValueError(f"more than {KNOWN_AT_MOST} known texts")
    ids = F.from_json(F.lit(json.dumps({r["digest"]: r["id"] for r in rows})), "map<string,string>")  # folded into one literal
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), digest)
    hits = F.filter(lines, lambda d: d.isin([r["digest"] for r in rows]))  # by a hash set; the map is searched from end to end
    by_line = F.transform(hits, lambda d: F.element_at(ids, d))
    found = docs.select(F.col(doc_id), digest(F.coalesce(text, F.lit(""))).alias("digest"),
                        F.array_sort(F.array_distinct(F.array_compact(by_line))).alias("notices"))
    return found.join(F.broadcast(table.withColumnRenamed("id", "license")), "digest", "left").select(doc_id, "digest", "license", "notices")
