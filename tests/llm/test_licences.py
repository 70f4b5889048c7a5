import duckdb
import pytest

from lanewise.llm import licences

#: Notices of public licences as files carry them, and what they are.
APACHE = '''Copyright 2020 The Authors

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
'''
MIT = '''MIT License

Copyright (c) 2021 Some One

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
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
'''
BSD2 = '''Copyright (c) 2019, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
'''
BSD3 = BSD2.replace("\nTHIS SOFTWARE", '''
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE''').replace("1. Redis", "* Redis").replace("2. Redis", "* Redis").replace("3. Neither", "* Neither")
ISC = '''Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS.
'''
GPL = '''This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
'''
MPL = '''This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
'''
EPL = '''This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/

SPDX-License-Identifier: EPL-2.0
'''
UNLICENSE = '''This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
'''


def commented(text, mark):
    return "\n".join(f"{mark} {line}".rstrip() for line in text.splitlines())


def boxed(text):
    return "/*\n" + commented(text, " *") + "\n */\nint main() { return 0; }\n"


NOTICES = {
    "apache": (APACHE, "Apache-2.0,Apache-2.0-header"), "mit": (MIT, "MIT-text"), "bsd2": (BSD2, "BSD-2-Clause-text"), "bsd3": (BSD3, "BSD-2-Clause-text,BSD-3-Clause-text"), "isc": (ISC, "ISC"), "gpl3": (GPL, "GPL-3.0-or-later"),
    "gpl2": (GPL.replace("software: you", "software; you").replace("version 3", "version 2"), "GPL-2.0-or-later"), "lgpl": (GPL.replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1"), "LGPL-2.1-or-later"), "agpl": (GPL.replace("GNU General", "GNU Affero General"), "AGPL-3.0-or-later"),
    "mpl": (MPL, "MPL-2.0"), "epl": (EPL, "EPL-2.0"), "unlicense": (UNLICENSE, "Unlicense"),
}
LINES = {
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "words before it\nReleased under the MIT licence\n\nwords after": "MIT", "# SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0,MIT", "// SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later", "/* SPDX-License-Identifier: (BSD-3-Clause) */": "BSD-3-Clause",
    "This project is licensed under the terms of the MIT license.": "MIT", "Available under the LGPL v2.1 or later": "LGPL-2.1", "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
    "a licence to drive, with permission of the owner; copyright law": "", "The MIT people licensed a song.": "", "redistribution of wealth": "",
}


@pytest.fixture(scope="module")
def cases():
    texts = [*((t, want) for t, want in NOTICES.values()), *((commented(t, m), want) for t, want in NOTICES.values() for m in ("//", "#", "--", ";;")), *((boxed(t), want) for t, want in NOTICES.values())]
    texts += [(t.replace("\n", "\r\n"), want) for t, want in NOTICES.values()] + list(LINES.items())
    return [(k, t, want) for k, (t, want) in enumerate([*texts, (None, ""), ("", ""), ("x" * 50_000, ""), (APACHE + "z " * 50_000, "Apache-2.0,Apache-2.0-header"), ("é. licence v. 2.0\u0085\u2028Licensed under ISC.\u0085", "ISC")])]


def test_notices_are_recognised_however_they_are_laid_out(spark, cases):
    frame = spark.createDataFrame([(k, t, "x") for k, t, _ in cases], "doc_id long, text string, Text string")
    got = {r["doc_id"]: r for r in licences.find_licences(frame).collect()}
    for k, text, want in cases:
        assert got[k]["licences"] == want, (text, got[k])


def test_sql_says_the_same(spark, cases):
    d = duckdb.connect()
    d.sql("create table documents (doc_id bigint, text varchar)")
    d.executemany("insert into documents values (?, ?)", [(k, t) for k, t, _ in cases])
    frame = spark.createDataFrame([(k, t) for k, t, _ in cases], "doc_id long, text string")
    assert {tuple(r) for r in licences.find_licences(frame).collect()} == set(d.sql(licences.OP6_SQL).fetchall())


def test_lines_of_the_table(spark):
    """Every line of a licence in the documents is recognised."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    n = docs.where("lower(text) rlike 'licensed under|released under'").count()
    found = licences.find_licences(docs)
    assert n > 10 and found.where("n_licences > 0").count() == n


def test_no_python_in_the_plan(spark):
    plan = licences.op6_licences(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_empty_and_repeated_rows(spark):
    frame = spark.createDataFrame([(1, MIT), (1, MIT), (None, MIT)], "doc_id long, text string")
    assert [r["n_licences"] for r in licences.find_licences(frame).collect()] == [1, 1, 1]
    assert licences.find_licences(frame.limit(0)).count() == 0
