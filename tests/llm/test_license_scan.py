"""Licence texts as they stand in real files, wrapped and behind comment marks."""

import duckdb
import textwrap

import pytest

from larkspur.llm import license_scan

from .helpers import documents

APACHE = """Copyright 2019 Some Authors

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MIT = """MIT License

Copyright (c) 2020 A. Person
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
"""
BSD_2 = """Copyright (c) 2011, The Owner
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_3 = BSD_2 + """
3. Neither the name of Some Large Company, Inc nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
""".replace("Foundation;", "Foundation,")
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
TEXTS = {"Apache-2.0": APACHE, "MIT": MIT, "BSD-2-Clause": BSD_2, "BSD-3-Clause": BSD_3, "ISC": ISC, "GPL-3.0-or-later": GPL, "GPL-2.0-or-later": GPL.replace("version 3", "version 2"), "LGPL-2.1-or-later": LGPL, "MPL-2.0": MPL}


def commented(text, first, mark, last):
    return "\n".join([first, *(f"{mark} {line}".rstrip() for line in text.splitlines()), last])


def variants(text):
    yield text
    yield text.replace("\n", "\r\n")
    yield commented(text, "#!/bin/sh", "#", "set -e")
    yield commented(text, "/*", " *", " */\npackage x;")
    yield commented(text, "", "//", "int main() {}")
    yield "\n\n".join(textwrap.fill(p, 40, initial_indent="  ") for p in text.split("\n\n"))
    yield "Some words before it without a mark\n" + text + "and more words that follow"


@pytest.fixture(scope="module")
def scanned(spark):
    rows = [(100 * i + j, t, name, None) for i, (name, text) in enumerate(TEXTS.items()) for j, t in enumerate(variants(text))]
    out = {r["doc_id"]: r for r in license_scan.scan(documents(spark, rows)).collect()}
    return rows, out


def test_licences_as_wrapped_in_files(scanned):
    rows, out = scanned
    assert {(i, out[i]["licenses"]) for i, *_ in rows} == {(i, name) for i, _, name, _ in rows}
    assert all(out[i]["n_licenses"] == 1 for i, *_ in rows)


def test_sql_agrees_on_wrapped_licences(spark, scanned):
    import duckdb

    rows, out = scanned
    rows = rows + [(9001, "", None, None), (9002, None, None, None), (9003, "\n" * 50 + "v. 2.0\x01Released under the MIT License", None, None), (9004, "licensed\nunder the mit\nlicense\nreleased under the mit license", None, None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, t, *_ in rows])
    want = con.execute(license_scan.ORACLE).fetchall()
    got = [tuple(r) for r in license_scan.scan(documents(spark, rows)).select("doc_id", "sentence_ids", "licenses", "n_licenses").collect()]
    assert sorted(got) == sorted(want)


def test_sentences_and_rules_are_what_they_should_be():
    names = [n for n, *_ in (*license_scan.SENTENCES, *license_scan.SLOTS)]
    assert len(names) == len(set(names)) and {s for _, steps in license_scan.RULES for s in steps} <= set(names)
    assert all(w == " ".join(w.split()) and w.count(" ") < license_scan.LONGEST for _, w in license_scan.SENTENCES)


def test_odd_texts(spark):
    rows = [(1, "\n" * 300_000, None, None), (2, ". " * 100_000, None, None), (3, "word\n" * 100_000, None, None), (4, "licensed under\n" * 3_000, None, None), (5, "ü\n" * 50_000 + "Released under the MIT License", None, None)]
    got = {r["doc_id"]: r["licenses"] for r in license_scan.scan(documents(spark, rows)).collect()}
    assert got == {1: "", 2: "", 3: "", 4: "", 5: "MIT"}


def test_spdx_lines_and_headers(spark):
    bsd = (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
    )
    texts = [
        "// SPDX-License-Identifier: GPL-3.0-only\nint main;",
        "# SPDX-License-Identifier: MIT\n\nimport os",
        "Code is under the MIT License.",
        "This program and the accompanying materials are made available under the terms of the\nEclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/\n\nrest",
        bsd + "3. The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.\n",
        bsd,
        "SPDX-License-Identifier: No-Such-Licence",
        *[f"x\nSPDX-License-Identifier: {name}\ny" for name in license_scan.SPDX],
    ]
    want = ["GPL-3.0-only", "MIT", "MIT", "EPL-2.0", "BSD-3-Clause", "BSD-2-Clause", "", *license_scan.SPDX]
    got = license_scan.scan(documents(spark, [(i, t, None, None) for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    assert [r["licenses"] for r in got] == want
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    rows = con.execute(license_scan.ORACLE).fetch_df().sort_values("doc_id")
    assert rows["licenses"].tolist() == want and rows["sentence_ids"].tolist() == [r["sentence_ids"] for r in got]
