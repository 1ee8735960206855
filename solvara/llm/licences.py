"""Licence recognition by known sentences and ordered rules over them; DataFrame functions only."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, as normalised here (lower case, runs of other characters
# than a-z and 0-9 as one space), each with its identifier.
SENTENCES = {
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "this project is licensed under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "licensed under the apache license version 2 0": "apache-2-notice",
    "this project is licensed under the apache license version 2 0": "apache-2-notice",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2-use",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-2-copy",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache-2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-2-basis",
    "see the license for the specific language governing permissions and limitations under the license": "apache-2-limits",
    "this work is licensed under the gnu general public license version 3": "gpl-3-notice",
    "licensed under the gnu general public license version 3": "gpl-3-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu general public license for more details": "gpl-details",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2-notice",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "this work is in the public domain": "public-domain",
    "licensed under cc by nc 4 0": "cc-by-nc-4-notice",
    "licensed under cc by 4 0": "cc-by-4-notice",
    "licensed under cc by sa 4 0": "cc-by-sa-4-notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4-notice",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4-notice",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4-notice",
    "all rights reserved": "all-rights",
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl-2-1-grant",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "lgpl-warranty",
    "see the gnu lesser general public license for more details": "lgpl-details",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl-3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl-3-grant",
    "see the gnu affero general public license for more details": "agpl-details",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl-2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl-2-copy",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl-2-terms",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "bsd-liability",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "isc-liability",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-liability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-freedom",
    "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law": "cc0-deed",
}

# Further sentences of public licence texts, from their heads and first sections.
SENTENCES |= {
    "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document": "apache-2-definition",
    "licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the license": "apache-2-licensor",
    "terms and conditions for use reproduction and distribution": "apache-2-terms",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "gnu-verbatim",
    "the gnu general public license is a free copyleft license for software and other kinds of works": "gpl-3-preamble",
    "the licenses for most software and other practical works are designed to take away your freedom to share and change the works": "gnu-3-freedom",
    "the licenses for most software are designed to take away your freedom to share and change it": "gnu-2-freedom",
    "by contrast the gnu general public license is intended to guarantee your freedom to share and change free software to make sure the software is free for all its users": "gpl-2-freedom",
    "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software": "agpl-3-preamble",
    "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below": "lgpl-3-preamble",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl-1-grant",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advertising",
    "you just do what the fuck you want to": "wtfpl-terms",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl-2-only-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation": "gpl-3-only-grant",
}

# Licences and the names, normalised, by which notices call them.
NAMES = {
    "MIT": ["mit license", "mit licence"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache licence version 2 0", "apache license version 2 0 january 2004", "apache license version 2 0 january 2004 http www apache org licenses"],
    "BSD-2-Clause": ["bsd 2 clause license", "simplified bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "new bsd license", "modified bsd license"],
    "ISC": ["isc license", "isc licence"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0"],
    "MPL-1.1": ["mozilla public license version 1 1", "mozilla public license 1 1"],
    "EPL-1.0": ["eclipse public license version 1 0", "eclipse public license v 1 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v 2 0"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license version 1 0 august 17th 2003"],
    "Zlib": ["zlib license"],
    "Unlicense": ["unlicense"],
    "CC0-1.0": ["creative commons zero v1 0 universal", "cc0 1 0 universal"],
    "Artistic-2.0": ["artistic license 2 0", "artistic license version 2 0"],
    "EUPL-1.2": ["european union public licence v 1 2", "european union public licence 1 2"],
    "OFL-1.1": ["sil open font license version 1 1", "sil open font license version 1 1 26 february 2007"],
    "CDDL-1.0": ["common development and distribution license version 1 0"],
    "WTFPL": ["do what the fuck you want to public license"],
    "MS-PL": ["microsoft public license"],
    "NCSA": ["university of illinois ncsa open source license"],
}
# GNU licences, their versions and the dates of their texts.
GNU = {
    "GPL": ("gnu general public license", {"2.0": "june 1991", "3.0": "29 june 2007"}),
    "LGPL": ("gnu lesser general public license", {"2.1": "february 1999", "3.0": "29 june 2007"}),
    "AGPL": ("gnu affero general public license", {"3.0": "19 november 2007"}),
}
for _short, (_name, _versions) in GNU.items():
    for _version, _date in _versions.items():
        _number = _version.replace(".", " ")
        _called = [f"{_name} {v}" for v in dict.fromkeys([f"version {_number.removesuffix(' 0')}", f"version {_number}", f"v{_number}", f"v{_number.removesuffix(' 0')}"])]
        NAMES[f"{_short}-{_version}-only"] = [*_called, f"{_called[0]} {_date}", f"{_called[0]} only"]
        NAMES[f"{_short}-{_version}-or-later"] = [f"{c} or {later}" for c in _called for later in ("later", "any later version", "at your option any later version")]
# The terms of Creative Commons licences.
COMMONS = {"BY": "attribution", "BY-SA": "attribution sharealike", "BY-NC": "attribution noncommercial", "BY-ND": "attribution noderivatives", "BY-NC-SA": "attribution noncommercial sharealike", "BY-NC-ND": "attribution noncommercial noderivatives"}
for _short, _name in COMMONS.items():
    for _version, _kind in (("3.0", "unported"), ("4.0", "international")):
        _number, _letters = _version.replace(".", " "), _short.lower().replace("-", " ")
        NAMES[f"CC-{_short}-{_version}"] = [f"creative commons {_name} {_number} {_kind} license", f"creative commons {_name} {_number} license", f"cc {_letters} {_number}", f"cc {_letters} {_number} license"]
#: What notices say of a name; a name alone is a heading.
NOTICES = ["{}", "released under the {}", "licensed under the {}", "distributed under the {}", "this project is licensed under the {}", "this work is licensed under the {}", "this software is licensed under the {}", "licensed under {}", "this work is licensed under a {}", "licensed under a {}"]
# Identifiers of expressions besides those above; older ones of GNU licences mean the version alone.
FURTHER = ["0BSD", "MIT-0", "BSD-4-Clause", "PostgreSQL", "Python-2.0", "Ruby", "OSL-3.0", "AFL-3.0", "CECILL-2.1", "LGPL-2.0-only", "LGPL-2.0-or-later", "X11", "Vim", "curl", "OpenSSL", "PHP-3.01", "W3C", "ODbL-1.0"]


def plain(name: str) -> str:
    """A name in lower case, with one space for each run of other characters than letters and digits."""
    return re.sub("[^a-z0-9]+", " ", name.lower()).strip()


def notice_of(licence: str) -> str:
    return f"{plain(licence).replace(' ', '-')}-named"


for _licence, _names in NAMES.items():
    for _notice in [n.format(name) for n in NOTICES for name in _names]:
        SENTENCES.setdefault(_notice, notice_of(_licence))

#: Terms of identifier expressions, as cut there, and their sentence identifiers.
TERMS = {plain(i).replace(" or later", "-or-later"): notice_of(i) for i in [*NAMES, *FURTHER]}
TERMS |= {t.removesuffix(" only"): i for t, i in TERMS.items() if t.endswith(" only")}
EXPRESSION = "spdx license identifier "
for _term, _id in TERMS.items():  # for one that runs over two lines
    SENTENCES.setdefault(EXPRESSION + plain(_term), _id)

# Licences and the sentence sequences that make them, in the order in which they are tried. A rule uses up
# the sentences that it matches; those around them don't become neighbours.
RULES = [
    ("MIT", ["mit-grant", "mit-condition", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("MIT", ["mit-grant"]),
    ("Apache-2.0", ["apache-2-use", "apache-2-copy", "apache-2-basis", "apache-2-limits"]),
    ("Apache-2.0", ["apache-2-use"]),
    ("GPL-3.0-or-later", ["gpl-3-grant", "gpl-warranty", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl-3-grant"]),
    ("GPL-2.0-or-later", ["gpl-2-grant", "gpl-warranty", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl-2-grant"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("ISC", ["isc-grant"]),
    ("MPL-2.0", ["mpl-2-notice"]),
    ("Unlicense", ["unlicense-grant"]),
    ("MIT", ["mit-notice"]),
    ("Apache-2.0", ["apache-2-notice"]),
    ("GPL-3.0-only", ["gpl-3-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-notice"]),
    ("CC-BY-4.0", ["cc-by-4-notice"]),
    ("public-domain", ["public-domain"]),
    ("all-rights-reserved", ["all-rights"]),
    ("LGPL-2.1-or-later", ["lgpl-2-1-grant", "lgpl-warranty", "lgpl-details"]),
    ("LGPL-2.1-or-later", ["lgpl-2-1-grant"]),
    ("LGPL-3.0-or-later", ["lgpl-3-grant"]),
    ("AGPL-3.0-or-later", ["agpl-3-grant", "gpl-warranty", "agpl-details"]),
    ("AGPL-3.0-or-later", ["agpl-3-grant"]),
    ("EPL-2.0", ["epl-2-terms"]),
    ("Zlib", ["zlib-warranty", "zlib-liability", "zlib-grant"]),
    ("CC0-1.0", ["cc0-deed"]),
]
RULES += [
    ("Apache-2.0", ["apache-2-definition"]),
    ("AGPL-3.0-only", ["agpl-3-preamble"]),
    ("LGPL-3.0-only", ["lgpl-3-preamble"]),
    ("GPL-3.0-only", ["gpl-3-preamble"]),
    ("GPL-3.0-only", ["gpl-3-only-grant"]),
    ("GPL-2.0-only", ["gpl-2-only-grant"]),
    ("GPL-2.0-only", ["gnu-2-freedom", "gpl-2-freedom"]),
    ("BSL-1.0", ["bsl-1-grant"]),
    ("0BSD", ["0bsd-grant"]),
    ("WTFPL", ["wtfpl-terms"]),
]
_BSD = next(i for i, (licence, _) in enumerate(RULES) if licence == "BSD-3-Clause")
RULES.insert(_BSD, ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising"]))
RULES += [(licence, [notice_of(licence)]) for licence in [*NAMES, *FURTHER]]

SPACE = "[ \\t\\n\\r]"


def normalised(text: Column) -> Column:
    """Lower case, one space for each run of other characters than a-z and 0-9; a plus after a digit reads "or later"."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, r"([0-9])\+", "$1 or later")), "[^a-z0-9]+", " "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def constant(value: object, schema: str) -> Column:
    """A table as one constant of the plan, which Spark reads from its text once."""
    return F.from_json(F.lit(json.dumps(value)), schema)


#: Longest first, so that of those that start on one line the whole stands before its parts.
KNOWN = sorted(SENTENCES.items(), key=lambda pair: (-len(pair[0]), pair[0]))
#: Words of the longest, the lines over which one can run at most.
LINES = max(len(s.split(" ")) for s in SENTENCES)


def branches(sentences: list[list[str]]) -> str:
    """A pattern of all sentences that branches word by word, so that few words are compared at a place of a text."""
    after: dict[str, list[list[str]]] = {}
    for words in sentences:
        if words:
            after.setdefault(words[0], []).append(words[1:])
    ways = []
    for word, rest in after.items():
        further = branches([r for r in rest if r])
        tail = f"(?: {further})" if further else ""
        ways.append(word + (f"{tail}?" if tail and [] in rest else tail))
    return f"(?:{'|'.join(ways)})" if ways else ""


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order.

    A text is cut into lines, and after a full stop, question or exclamation mark before white space. Any run of
    neighbouring pieces that reads as a known sentence counts, once; of those that start at one piece the longest comes
    first. Pieces without letters or digits, as blank lines and those of comment signs, don't stand between neighbours.
    A piece that starts as an identifier line gives the identifiers of its expression, joined by "or", "and" and "with",
    in order; unknown ones give none. Only texts that hold a known sentence or such a line at all are cut.
    """
    anywhere = f"(?:^| )(?:{EXPRESSION.strip()}|{branches([s.split(' ') for s in SENTENCES])})(?: |$)"
    pieces = F.filter(F.transform(F.split(F.regexp_replace(text, f"([.!?]){SPACE}+", "$1\n"), "\n"), normalised), lambda s: s != "")
    by_word: dict[str, list[dict]] = {}
    for s, i in KNOWN:
        by_word.setdefault(s.split(" ")[0], []).append({"s": f"{s} ", "id": i, "end": len(s) + 1})
    known = constant(by_word, "map<string, array<struct<s: string, id: string, end: int>>>")
    terms = constant(TERMS, "map<string, string>")
    none = F.array().cast("array<string>")

    def expression(piece: Column) -> Column:
        rest = F.replace(F.substring(piece, len(EXPRESSION) + 1, 2**30), F.lit(" or later"), F.lit("-or-later"))
        return F.filter(F.transform(F.split(rest, " (?:or|and|with) "), lambda t: F.try_element_at(terms, t)), lambda i: i.isNotNull())

    def starting(all_: Column, at: Column) -> Column:
        piece = F.element_at(all_, at)
        first = F.concat(piece, F.lit(" "))

        def near(group: Column) -> Column:
            def found(run: Column) -> Column:
                words = F.translate(run, "\n", " ")
                here = F.filter(group, lambda k: words.startswith(k.s) & (F.substring(run, k.end, F.lit(1)) == "\n"))
                return F.transform(here, lambda k: k.id)

            begins = F.exists(group, lambda k: k.s.startswith(first))
            return F.when(begins, let(F.concat(F.array_join(F.slice(all_, at, F.lit(LINES)), "\n"), F.lit("\n")), found)).otherwise(none)

        return F.when(piece.startswith(EXPRESSION), expression(piece)).otherwise(let(F.try_element_at(known, F.substring_index(piece, " ", 1)), near))

    def runs(all_: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(all_)), lambda at: starting(all_, at)))

    return F.when(normalised(text).rlike(anywhere), let(pieces, runs)).otherwise(none)


def licences(ids: Column) -> Column:
    """Licences of an identifier sequence, by the first rule first, each once; rules match neighbouring identifiers."""
    rules = constant([{"name": name, "seq": "".join(f",{i}," for i in seq)} for name, seq in RULES], "array<struct<name: string, seq: string>>")
    start = F.struct(F.array_join(F.transform(ids, lambda i: F.concat(F.lit(","), i, F.lit(","))), "").alias("rest"), F.array().cast("array<string>").alias("found"))

    def apply(state: Column, rule: Column) -> Column:
        return F.when(
            state.rest.contains(rule.seq),
            F.struct(F.replace(state.rest, rule.seq, F.lit("|")).alias("rest"), F.array_append(state.found, rule["name"]).alias("found")),
        ).otherwise(state)

    return F.array_distinct(F.aggregate(rules, start, apply, lambda s: s.found))


def licence_scan(docs: DataFrame) -> DataFrame:
    """Documents with known licence sentences: doc_id, sentence_ids, licences, n_sentences.

    One pass without a shuffle, so hot sources or copies don't matter. Null, blank and empty texts, and empty tables,
    give no rows; repeated rows give equal rows; a null doc_id stays null; identifiers that no rule takes give no licence.
    """
    one = F.filter(F.array(sentence_ids(F.col("text"))), lambda ids: F.size(ids) > 0)  # as a list of at most one, so that it is computed once
    found = docs.select("doc_id", F.explode(one).alias("sentence_ids"))
    return found.select("doc_id", "sentence_ids", licences(F.col("sentence_ids")).alias("licences"), F.size("sentence_ids").cast("long").alias("n_sentences"))


def op4_licence_scan(spark, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of all documents, lists joined by commas."""
    found = licence_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"), "n_sentences")


def _sql() -> str:
    known = ", ".join(f"('{s}', '{s.split(' ')[0]}', '{i}')" for s, i in SENTENCES.items())
    terms = ", ".join(f"('{t}', '{i}')" for t, i in TERMS.items())
    rest = "',' || array_to_string(ids, ',,') || ','"
    steps = [f"z0 AS (SELECT doc_id, ids, {rest} AS rest, [] :: VARCHAR[] AS found FROM seq)"]
    for n, (name, seq) in enumerate(RULES, 1):
        pattern = ",,".join(seq)
        steps.append(f"z{n} AS (SELECT doc_id, ids, replace(rest, ',{pattern},', '|') AS rest, CASE WHEN contains(rest, ',{pattern},') AND NOT list_contains(found, '{name}') THEN list_append(found, '{name}') ELSE found END AS found FROM z{n - 1})")
    return rf"""
WITH k(s, w, id) AS (VALUES {known}), x(term, id) AS (VALUES {terms}),
p AS (
  SELECT row_number() OVER () AS row, doc_id, list_filter(list_transform(
    string_split(regexp_replace(text, '([.!?])[ \t\n\r]+', '\1' || chr(10), 'g'), chr(10)),
    lambda l: trim(regexp_replace(lower(regexp_replace(l, '([0-9])\+', '\1 or later', 'g')), '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '') AS ps
  FROM documents),
c AS (SELECT row, doc_id, ps, unnest(ps) AS s, generate_subscripts(ps, 1) AS n FROM p),
r AS (
  SELECT row, doc_id, n, k.s AS known, k.id, array_to_string(ps[n : n + {LINES - 1}], chr(10)) || chr(10) AS run
  FROM c JOIN k ON k.w = split_part(c.s, ' ', 1) AND starts_with(k.s || ' ', c.s || ' ') AND NOT starts_with(c.s, '{EXPRESSION}')),
e AS (
  SELECT row, doc_id, n, unnest(ts) AS term, generate_subscripts(ts, 1) AS i
  FROM (SELECT row, doc_id, n, string_split_regex(replace(substr(s, {len(EXPRESSION) + 1}), ' or later', '-or-later'), ' (?:or|and|with) ') AS ts FROM c WHERE starts_with(s, '{EXPRESSION}'))),
hit AS (
  SELECT row, doc_id, n, -length(known) AS i, known, id FROM r
  WHERE starts_with(replace(run, chr(10), ' '), known || ' ') AND substr(run, length(known) + 1, 1) = chr(10)
  UNION ALL SELECT row, doc_id, n, i, '', x.id FROM e JOIN x ON e.term = x.term),
seq AS (SELECT row, doc_id, list(id ORDER BY n, i, known) AS ids FROM hit GROUP BY row, doc_id),
{", ".join(steps)}
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, array_to_string(found, ',') AS licences, CAST(len(ids) AS BIGINT) AS n_sentences FROM z{len(RULES)}
"""


OP4_SQL = _sql()
