import re

from solvara.llm import licences

MIT = """Copyright (c) someone
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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.  IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.sentence_ids, r.licences) for r in licences.licence_scan(df).collect()}


def test_sequences_and_single_sentences(spark):
    body = MIT.split("\n", 1)[1]
    got = found(spark, [
        body,
        "Some text.\nReleased under the MIT License.",
        "no full stop before\nLicensed under the Apache License, Version 2.0.\nmore",
        "All rights reserved. Licensed under CC BY-NC 4.0. All rights reserved.",
        "Nothing here.", None, "", "The MIT License is nice.",
        "See the GNU General Public License for more details.",
    ])
    assert got[0] == (["mit-grant", "mit-condition", "mit-warranty", "mit-liability"], ["MIT"])
    assert got[1] == (["mit-notice"], ["MIT"])
    assert got[2] == (["apache-2-notice"], ["Apache-2.0"])
    assert got[3] == (["all-rights", "cc-by-nc-4-notice", "all-rights"], ["CC-BY-NC-4.0", "all-rights-reserved"])
    assert got[8] == (["gpl-details"], [])
    assert set(got) == {0, 1, 2, 3, 8}


def test_no_python_and_no_shuffle_in_the_plan(spark):
    plan = licences.licence_scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    nodes = re.findall(r"^[\s:*+()0-9-]*([A-Za-z]+)", plan, re.M)  # a licence is called Python-2.0, so names of nodes only
    assert nodes and not [n for n in nodes if re.search("Python|Pandas|Arrow|Exchange", n)] and "pythonUDF" not in plan


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(None, "All rights reserved."), (None, "All rights reserved.")], "doc_id long, text string")
    assert licences.licence_scan(df).count() == 2 and licences.licence_scan(df.limit(0)).count() == 0


def test_every_rule_names_known_sentences():
    known = set(licences.SENTENCES.values())
    assert all(i in known for _, seq in licences.RULES for i in seq)


APACHE = """Copyright 2020 Some One

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL = """Copyright (C) 2020  Some One
This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
ISC = """Copyright (c) 2020 Some One
Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def test_public_headers_after_copyright_lines_and_in_comments(spark):
    whole = {
        APACHE: (["apache-2-use", "apache-2-copy", "apache-2-basis", "apache-2-limits"], "Apache-2.0"),
        GPL: (["gpl-3-grant", "gpl-warranty", "gpl-details"], "GPL-3.0-or-later"),
        ISC: (["isc-grant"], "ISC"),
        MIT: (["mit-grant", "mit-condition", "mit-warranty", "mit-liability"], "MIT"),
        MPL: (["mpl-2-notice", "mpl-2-copy"], "MPL-2.0"),
    }
    texts, wanted = [], []
    for text, (ids, name) in whole.items():
        lines = text.split("\n")
        close = text.replace("\n\n", "\n")
        for shown in (text, close, "\r\n".join(lines), "\n".join("# " + x for x in lines), "\n".join(("# " + x).rstrip() for x in lines) + "\n\nimport os\n", "/*\n" + "\n".join(" * " + x for x in lines) + "\n */\nint x;", "\n".join("// " + x for x in lines)):
            texts.append(shown)
            wanted.append((ids, [name]))
    got = found(spark, texts)
    assert [got.get(i) for i in range(len(texts))] == wanted


def test_runs_keep_to_whole_lines(spark):
    got = found(spark, ["not\nreleased under\n#\nthe MIT\nLicense\nat all", "It is released under\nthe MIT License", "released under\nthe MIT License of\nold", "All rights\nreserved"])
    assert got == {0: (["mit-notice"], ["MIT"]), 3: (["all-rights"], ["all-rights-reserved"])}


def test_what_stands_around_a_match_is_not_neighbouring(spark):
    grant = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."
    source = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    binary = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'Software'), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions."
    got = found(spark, [f"{grant} {source} {binary}", f"{grant} {mit} {source} {binary}", f"{mit} {grant} {source} {binary}"])
    assert got[0] == (["bsd-grant", "bsd-source", "bsd-binary"], ["BSD-2-Clause"])
    assert got[1] == (["bsd-grant", "mit-grant", "bsd-source", "bsd-binary"], ["MIT"])
    assert sorted(got[2][1]) == ["BSD-2-Clause", "MIT"]


def test_identifiers_names_and_headings(spark):
    texts = {
        "// SPDX-License-Identifier: MIT": "MIT",
        "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
        "Some code\nGNU Lesser General Public License, version 2.1\nmore": "LGPL-2.1-only",
        "Released under the MIT licence.": "MIT",
        "This software is licensed under the Eclipse Public License 2.0.": "EPL-2.0",
        "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
        "CC0 1.0 Universal": "CC0-1.0",
        "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3": "AGPL-3.0-only",
    }
    got = found(spark, list(texts))
    assert {i: got[i][1] for i in got} == {i: [name] for i, name in enumerate(texts.values())}
    assert not found(spark, ["We like the MIT License a lot.", "SPDX-License-Identifier: unknown", "mit licenses"])


def test_pattern_of_all_sentences():
    pattern = re.compile(f"(?:^| ){licences.branches([s.split(' ') for s in licences.SENTENCES])}(?: |$)")
    for s in licences.SENTENCES:
        assert pattern.search(s) and pattern.search(f"a {s} b")
    assert not pattern.search("this is free") and not pattern.search("permission is hereby")


def test_a_very_long_text_and_one_evaluation(spark):
    rows = [(1, "plain words " * 200_000 + "\nAll rights reserved.\n" + "more words " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert licences.licence_scan(df).collect()[0].licences == ["all-rights-reserved"]
    plan = licences.licence_scan(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("permission is hereby granted free of charge") <= 2  # in the pattern's words, and once among the known


def recognised(text):
    """The plain way: every run of lines against every known sentence."""
    def plain(line):
        return re.sub("[^a-z0-9]+", " ", re.sub(r"([0-9])\+", r"\1 or later", line).lower()).strip()

    pieces = [p for p in map(plain, re.sub(r"([.!?])[ \t\n\r]+", r"\1\n", text).split("\n")) if p]
    ids = []
    for at, piece in enumerate(pieces):
        if piece.startswith("spdx license identifier "):
            terms = re.split(" (?:or(?! later)|and|with) ", piece.removeprefix("spdx license identifier "))
            ids += [licences.TERMS[t] for t in (t.replace(" or later", "-or-later") for t in terms) if t in licences.TERMS]
            continue
        for end in range(len(pieces), at, -1):
            ids += [licences.SENTENCES[s] for s in [" ".join(pieces[at:end])] if s in licences.SENTENCES]
    found = []
    rest = "".join(f",{i}," for i in ids)
    for name, seq in licences.RULES:
        pattern = "".join(f",{i}," for i in seq)
        if pattern in rest:
            rest = rest.replace(pattern, "|")
            found += [] if name in found else [name]
    return ids, found


def test_equals_the_plain_recogniser_and_the_sql(spark):
    import random

    import duckdb
    import pandas as pd

    rng = random.Random(4)
    whole = [*(s for s in licences.SENTENCES if len(s) < 400), *(f"SPDX-License-Identifier: {i}" for i in ("MIT", "GPL-2.0+", "Apache-2.0 OR MIT", "(GPL-3.0-or-later WITH x) AND ISC", "none"))]
    texts = [MIT, APACHE, GPL, ISC, MPL, "", None]
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 6)):
            words = rng.choice([*rng.sample(whole, 3), "other words", "the"]).split(" ")
            if rng.random() < 0.4 and len(words) > 2:
                words[rng.randrange(1, len(words))] = "\n" + rng.choice(["", "// ", "\n", "#\n"]) + words[-1]
            parts.append(rng.choice(["", "// ", " * "]) + " ".join(words) + rng.choice([".", "", "!", ". "]))
        texts.append(rng.choice(["\n", "\n\n", " ", "\n//\n"]).join(parts))
    wanted = {i: recognised(t) for i, t in enumerate(texts) if t}
    got = found(spark, texts)
    assert got == {i: w for i, w in wanted.items() if w[0]} and len(got) > 60
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    assert {r[0]: (r[1].split(","), r[2].split(",") if r[2] else []) for r in duckdb.query_df(documents, "documents", licences.OP4_SQL).fetchall()} == got


def test_comment_signs_count_nothing_twice(spark):
    lines = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
             "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
             "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."]
    got = found(spark, ["\n".join(f"//\n{x}" for x in lines), "\n".join(lines), "//\nLicensed under the MIT license."])
    assert got[0] == got[1] == (["bsd-grant", "bsd-source", "bsd-binary"], ["BSD-2-Clause"]) and got[2] == (["mit-notice"], ["MIT"])


def test_expressions_and_heads_of_whole_texts(spark):
    texts = {
        "// SPDX-License-Identifier: MIT OR Apache-2.0": ["MIT", "Apache-2.0"],
        "# SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0": ["GPL-2.0-or-later"],
        "/* SPDX-License-Identifier: GPL-2.0+ */": ["GPL-2.0-or-later"],
        "SPDX-License-Identifier: GPL-2.0": ["GPL-2.0-only"],
        "SPDX-License-Identifier: (LGPL-2.1-only AND BSD-3-Clause)": ["BSD-3-Clause", "LGPL-2.1-only"],
        "Licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.": ["CC-BY-SA-3.0"],
        "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n Copyright (C) 2007\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.": ["GPL-3.0-only"],
        "   Apache License\n   Version 2.0, January 2004\n  http://www.apache.org/licenses/\n\n TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION": ["Apache-2.0"],
        "Licensed under the GNU General Public License v3 or later.": ["GPL-3.0-or-later"],
    }
    got = found(spark, list(texts))
    assert [got[i][1] for i in range(len(texts))] == list(texts.values())
