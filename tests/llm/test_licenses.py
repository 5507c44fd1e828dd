from __future__ import annotations

import re
import textwrap

from pyspark.sql import functions as F

from folderloom.llm.licenses import KNOWN, catalogue, scan


def test_spellings_and_edges(spark, docs):
    mit = KNOWN["MIT"]
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit), (2, mit.upper().replace("SUBLICENSE", "sub-licence").replace(",", " ,")),
            (3, mit + " And more."), (4, "Hello.\n  licensed under the APACHE licence; version 2.0\nAll rights reserved\nbye"),
            (5, None), (6, ""), (6, ""), (7, "MIT License\n\n(c) me\n" + mit), (8, "x" * 3_000_000)]
    frame = docs(rows).withColumns({"digest": F.lit(1), "license": F.lit("z"), "id": F.lit(0)})
    got = {r.doc_id: (r.license, r.notices) for r in scan(frame).collect()}
    assert got == {1: ("MIT", []), 2: ("MIT", []), 3: (None, []), 4: (None, ["notice-Apache-2.0", "notice-reserved"]), 5: (None, []),
                   6: (None, []), 7: ("MIT-titled", []), 8: (None, [])}
    assert scan(frame).count() == len(rows)
    assert scan(docs([])).collect() == []
    none = spark.createDataFrame([], "id string, text string")
    assert {r.license for r in scan(frame, none).collect()} == {None}


def test_whole_texts_at_any_wrapping_and_notices_in_other_words(docs):
    known = [(k, t) for k, t in catalogue() if not k.startswith("notice-")]
    alone = re.compile(r"(?i)\s+(?=copyright\s)|(?<=copyright)\s+(?=holder|notice|owner|law)")
    header = "Copyright (c) 2012-2021 A. Person, B. Other, \nC. Third\n\n"
    rows, expected = [], {}
    for k, t in known:
        words = t.split()
        for x in (t, " ".join(words), textwrap.fill(" ".join(words), 37, break_long_words=False), textwrap.fill(" ".join(words), 79, break_on_hyphens=False),
                  alone.sub("\n", t), "\n".join("# " + y for y in t.split("\n")), header + t, "Copyright The Foo Authors\nCopyright 2020 Foo Inc.\n" + t):
            expected[len(rows)] = k
            rows.append((len(rows), x))
    for k, x in [("Apache-2.0", "This project is licensed under the Apache License 2.0."), ("MPL-2.0", "// SPDX-License-Identifier: MPL-2.0"),
                 ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"), ("GPL-3.0", "Distributed under the GNU GPLv3.")]:
        expected[len(rows)] = [f"notice-{k}"]
        rows.append((len(rows), "Hello.\n" + x + "\nbye"))
    got = {r.doc_id: r.notices if r.license is None else r.license for r in scan(docs(rows)).collect()}
    assert {k: (got[k], x, rows[k][1]) for k, x in expected.items() if got[k] != x} == {}
    ids = {k for k, _ in known}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "Unlicense", "Zlib", "ISC"} <= ids
    filled = next(t for k, t in known if k == "Apache-2.0").replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2019 Foo, Inc.")
    assert [r.license for r in scan(docs([(1, filled)])).collect()] == ["Apache-2.0"]
