import re

import duckdb
import pytest

from quirespark.llm import license_scan

FILES = [
    (1, "a/LICENSE", "Released under the MIT License."),
    (2, "a/b/code.py", "import x\nprint(1)"),
    (3, "a/b/c/own.py", "# Licensed under the Apache License, Version 2.0.\nx = 1"),
    (4, "a/b/c/deep.py", ""),
    (5, "z/none.py", None),
    (6, "z/y/COPYING", "This work is licensed under the GNU General Public License,\nversion 3."),
    (7, "z/y/w.py", "nothing here\n\nof note"),
    (8, None, "Released under the MIT License."),
    (9, "top.txt", "Licensed under CC BY-NC 4.0."),
    (10, "a/b/LICENSE.txt", "words only, no wording"),
    (11, "a/b/code.py", "another row of one path"),
    (None, "a/x.py", "no id"),
    (12, "q/many.txt", "\n".join(["filler words and more of them"] * 500 + ["Released under the BSD 3-Clause License"])),
]


@pytest.fixture(scope="module")
def files(spark):
    df = spark.createDataFrame(FILES, "doc_id long, path string, text string")
    from pyspark.sql import functions as F

    return df.withColumns({"license": F.lit("x"), "score": F.lit("y"), "own": F.lit(0), "number": F.lit(1), "directory": F.lit("")})


def test_own_and_inherited(files):
    rows = {(r.doc_id, r.path): r for r in license_scan.scan(files).collect()}
    found = {i: (r.license, r.origin, r.inherited_from) for (i, _), r in rows.items()}
    assert found[1][:2] == ("MIT", "notice") and rows[1, "a/LICENSE"].score == 1.0
    assert found[2] == ("MIT", "inherited", "a") and found[4] == ("MIT", "inherited", "a") and found[None] == ("MIT", "inherited", "a")
    assert found[3][:2] == ("Apache-2.0", "notice")
    assert found[5] == (None, "none", None) and found[8] == (None, "none", None)
    assert found[6][:2] == ("GPL-3.0", "notice") and found[7] == ("GPL-3.0", "inherited", "z/y")
    assert found[9][:2] == ("CC-BY-NC-4.0", "notice") and found[12][:2] == ("BSD-3-Clause", "notice")
    assert len(rows) == len(FILES)


def test_sql_gives_the_same_rows(files):
    got = sorted(map(str, map(tuple, license_scan.scan(files).select("doc_id", "path", "license", "score", "origin", "inherited_from").collect())))
    con = duckdb.connect()
    con.execute("CREATE TABLE f (doc_id BIGINT, path VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO f VALUES (?, ?, ?)", FILES)
    want = con.sql(license_scan.oracle_sql("SELECT * FROM f"))
    assert want.columns == ["doc_id", "path", "license", "score", "origin", "inherited_from"]
    assert got == sorted(map(str, want.fetchall()))


def test_sql_gives_the_same_rows_for_headers(spark):
    rows = [(k, f"d{k % 7}/{'LICENSE' if k % 5 == 0 else f'code{k}.c'}", text) for k, (text, _) in enumerate(HEADERS)] + [(900, None, "// SPDX-License-Identifier: MIT"), (901, "x/y", None)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = sorted(map(str, map(tuple, license_scan.scan(df).select("doc_id", "path", "license", "score", "origin", "inherited_from").collect())))
    con = duckdb.connect()
    con.execute("CREATE TABLE f (doc_id BIGINT, path VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO f VALUES (?, ?, ?)", rows)
    assert got == sorted(map(str, con.sql(license_scan.oracle_sql("SELECT * FROM f")).fetchall()))


def test_empty_table(files):
    assert license_scan.scan(files.where("false")).count() == 0


GPL = "licensed under the GNU General Public License,"
HEADERS = [
    ("# This work is licensed under the GNU General Public License,\n# version 2.\nimport x", "GPL-2.0"),
    ("// This work is licensed under the GNU General\n// Public License, version 3.\nint x;", "GPL-3.0"),
    ("/* This work is licensed\n * under the GNU General Public\n * License, version 2.\n */", "GPL-2.0"),
    ("Copyright 2020 X. Licensed under the Apache License, Version 2.0; you may not use this file except in compliance", "Apache-2.0"),
    ('" * Licensed under the Apache License, Version 2.0 (the "License");\n * you may not use this file', "Apache-2.0"),
    ("# SPDX-License-Identifier: MIT\nx = 1", "MIT"),
    ("// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
    ("# SPDX-License-Identifier: Zlib", None),
    ("All rights reserved.", "Proprietary"),
    ("Copyright 2021 Someone. All rights reserved.", "Proprietary"),
    ("GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007", "LGPL-3.0"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n", "GPL-3.0"),
    ("                                 Apache License\n                           Version 2.0, January 2004\n", "Apache-2.0"),
    ("Mozilla Public License Version 2.0\n==================================\n", "MPL-2.0"),
    ("words about a license and the public, but no notice", None),
    ("Licensed under CC BY-SA 3.0", "CC-BY-SA-3.0"),
    ("Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0"),
    ("Licensed under CC BY 3.0.", "CC-BY-3.0"),
    ("Licensed under CC BY-NC 2.0", None),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "CC-BY-3.0"),
    ("licensed under the GNU Lesser General Public License, version 2.1", "LGPL-2.1"),
    ("GNU Lesser General Public License, version 2.1", "LGPL-2.1"),
    ("licensed under the GNU Lesser General Public License, version 3", "LGPL-3.0"),
    ("                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n\n Copyright (C) 1991", "LGPL-2.1"),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n", "GPL-2.0"),
    ("GNU AFFERO GENERAL PUBLIC LICENSE\n   Version 3, 19 November 2007", "AGPL-3.0"),
    ("# SPDX-License-Identifier: MIT OR Apache-2.0", "Apache-2.0 OR MIT"),
    ("/* SPDX-License-Identifier: (GPL-2.0-only OR BSD-3-Clause) */", "BSD-3-Clause OR GPL-2.0"),
    ("// SPDX-License-Identifier: MIT AND CC-BY-4.0", "CC-BY-4.0 AND MIT"),
    ("// SPDX-License-Identifier: EPL-2.0", "EPL-2.0"),
    ("// SPDX-License-Identifier: GPL-3.0+", "GPL-3.0"),
    ("// SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note", "GPL-2.0"),
    ("// SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"),
    ("// SPDX-License-Identifier: MPL-1.1", None),
    ("// SPDX-License-Identifier:", None),
    (
        "/* This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n"
        " * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */", "GPL-3.0",
    ),
    (
        "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n"
        "# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version.", "GPL-2.0",
    ),
    (
        " * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n"
        " * License as published by the Free Software Foundation; either\n * version 2.1 of the License, or (at your option) any later version.", "LGPL-2.1",
    ),
    (
        "// it under the terms of the GNU Affero General Public License as published by\n// the Free Software Foundation, either version 3 of the License, or\n", "AGPL-3.0",
    ),
    ("modify it under the terms of the GNU General Public License version 2 as\n * published by the Free Software Foundation.", "GPL-2.0"),
    ("// Use of this source code is governed by a BSD-style license that can be\n// found in the LICENSE file.", "BSD-3-Clause"),
    ("# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:", "BSD-2-Clause"),
    (
        "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:\n#\n"
        "# 3. Neither the name of the copyright holder nor the names of its\n#    contributors may be used to endorse or promote products derived from\n"
        "#    this software without specific prior written permission.", "BSD-3-Clause",
    ),
    ("//  Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
    ("Eclipse Public License - v 2.0", "EPL-2.0"),
    ("Eclipse Public License - v 1.0", None),
    ("licensed under the Apache License, Version 1.1", None),
    ("Mozilla Public License Version 1.1", None),
    ("This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed", "MPL-2.0"),
    ("CC0 1.0 Universal, dedicated to the public domain", "CC0-1.0"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("ran on Python 3.8 and was Released under the MIT License in time", None),
    ("Released under the MIT License.", "MIT"),
    ("she had all the rights of a citizen and reserved a table", None),
]


@pytest.mark.parametrize("documents", [20, 20_000])
def test_headers_whatever_the_number_of_documents(spark, documents):
    """Headers in files of their own, with other files of plain words around them."""
    rows = [(k, f"d{k}/code.c", text) for k, (text, _) in enumerate(HEADERS)]
    plain = "under the license of this work general version public all rights".split()
    rows += [(100 + k, f"e/{k}.txt", f"some words {plain[k % len(plain)] if k % 7 == 0 else ''} here") for k in range(documents)]
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).where("doc_id < 100").collect()
    assert {r.doc_id: r.license for r in found} == {k: name for k, (_, name) in enumerate(HEADERS)}


@pytest.mark.parametrize("name, text", license_scan.TEXTS)
def test_licence_files_as_a_whole(spark, name, text):
    wrapped = "Copyright (c) 2019 The Authors\n\n" + "\n".join(text[k : k + 70] for k in range(0, len(text), 70))
    rows = [(1, "a/LICENSE", wrapped), (2, "a/b/x.py", "x = 1"), (3, "c/notes.txt", "words")]
    found = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert (found[1].license, found[1].origin) == (name, "notice") and found[1].score > 0.9
    assert (found[2].license, found[2].inherited_from) == (name, "a") and found[3].license is None


def test_repeated_ids_and_tied_licences(spark):
    rows = [(1, "a/x.c", "MIT License"), (1, "b/y.c", "ISC License"), (1, "b/y.c", "ISC License"), (2, "c/LICENSE", "MIT License\n\n\n\nISC License")]
    found = sorted((r.doc_id, r.path, r.license) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect())
    assert found == [(1, "a/x.c", "MIT"), (1, "b/y.c", "ISC"), (1, "b/y.c", "ISC"), (2, "c/LICENSE", "ISC")]


def test_terms_passed_over_can_not_reach_the_threshold():
    space = license_scan.Space({"the": 900, "under": 500, "license": 30}, 1000)
    for kind in (0, 1):
        needed = re.compile(space.needed(0.8, kind))
        for _, _, vector in space.vectors[kind]:
            rest = sum(v * v for t, v in vector.items() if not needed.search(t))
            assert rest < 0.8**2
