"""Licence scans: sentences are normalised and mapped to identifiers, identifier sequences are matched with ordered rules.

DataFrame functions only: no Python runs on the executors. Comment marks go, wrapped lines are joined, definitions in brackets and
enumerators are dropped and spellings unified before a sentence is looked up, so a licence is known however its file is laid out.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table

#: Sentences of public licences as they stand after normalisation, by identifier.
SENTENCES = {
    "apache2-terms": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at",
    "apache2-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-disclaimer": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "gnu-free": "this program is free software",
    "mpl2-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "epl2-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at",
    "unlicense-domain": "this is free and unencumbered software released into the public domain",
    "unlicense-grant": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
}
#: What licences are called after normalisation, by identifier.
NAMES = {
    "apache2-name": ["apache license version 2 0", "apache license 2 0", "apache 2 0", "apache license v 2 0", "apache software license version 2 0"],
    "mit-name": ["mit license", "mit", "expat license"],
    "bsd2-name": ["bsd 2 clause license", "bsd 2 clause", "2 clause bsd license", "simplified bsd license"],
    "bsd3-name": ["bsd 3 clause license", "bsd 3 clause", "3 clause bsd license", "new bsd license", "modified bsd license"],
    "bsd-name": ["bsd license"],
    "isc-name": ["isc license", "isc"],
    "gpl2-name": ["gnu general public license version 2", "gnu general public license v 2", "gnu gpl v 2", "gpl v 2", "gplv2", "gpl 2 0", "gnu general public license version 2 0"],
    "gpl3-name": ["gnu general public license version 3", "gnu general public license v 3", "gnu gpl v 3", "gpl v 3", "gplv3", "gpl 3 0", "gnu general public license version 3 0"],
    "lgpl21-name": ["gnu lesser general public license version 2 1", "gnu lesser general public license v 2 1", "lgpl v 2 1", "lgplv2 1", "lgpl 2 1"],
    "lgpl3-name": ["gnu lesser general public license version 3", "gnu lesser general public license v 3", "lgpl v 3", "lgplv3", "lgpl 3 0"],
    "agpl3-name": ["gnu affero general public license version 3", "gnu affero general public license v 3", "agpl v 3", "agplv3", "agpl 3 0"],
    "mpl2-name": ["mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0", "mpl 2 0", "mpl v 2 0"],
    "epl2-name": ["eclipse public license version 2 0", "eclipse public license v 2 0", "eclipse public license 2 0", "epl 2 0"],
    "unlicense-name": ["unlicense"],
    "cc0-name": ["cc0 1 0", "cc0", "creative commons zero v 1 0", "cc0 1 0 universal"],
    "cc-by-name": ["cc by 4 0", "creative commons attribution 4 0", "creative commons attribution 4 0 international", "creative commons attribution 4 0 international license"],
    "cc-by-sa-name": ["cc by sa 4 0", "creative commons attribution sharealike 4 0", "creative commons attribution sharealike 4 0 international", "creative commons attribution sharealike 4 0 international license"],
    "cc-by-nc-name": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0", "creative commons attribution noncommercial 4 0 international", "creative commons attribution noncommercial 4 0 international license"],
}
#: Licence identifiers of the SPDX list as they stand after normalisation, and the licences themselves.
SPDX = {
    "Apache-2.0": ["apache 2 0"], "MIT": ["mit"], "BSD-2-Clause": ["bsd 2 clause"], "BSD-3-Clause": ["bsd 3 clause"], "ISC": ["isc"],
    "GPL-2.0-only": ["gpl 2 0 only", "gpl 2 0"], "GPL-2.0-or-later": ["gpl 2 0 or later"], "GPL-3.0-only": ["gpl 3 0 only", "gpl 3 0"], "GPL-3.0-or-later": ["gpl 3 0 or later"],
    "LGPL-2.1-only": ["lgpl 2 1 only", "lgpl 2 1"], "LGPL-2.1-or-later": ["lgpl 2 1 or later"], "LGPL-3.0-only": ["lgpl 3 0 only", "lgpl 3 0"], "LGPL-3.0-or-later": ["lgpl 3 0 or later"],
    "AGPL-3.0-only": ["agpl 3 0 only", "agpl 3 0"], "AGPL-3.0-or-later": ["agpl 3 0 or later"], "MPL-2.0": ["mpl 2 0"], "EPL-2.0": ["epl 2 0"], "Unlicense": ["unlicense"], "CC0-1.0": ["cc0 1 0"],
    "CC-BY-4.0": ["cc by 4 0"], "CC-BY-SA-4.0": ["cc by sa 4 0"], "CC-BY-NC-4.0": ["cc by nc 4 0"],
}
#: The GNU licences' header sentence, by family and version.
_GNU = {"gpl2": ("", "2"), "gpl3": ("", "3"), "lgpl21": ("lesser ", "2 1"), "lgpl3": ("lesser ", "3"), "agpl3": ("affero ", "3")}
for _k, (_family, _version) in _GNU.items():
    _terms = f"you can redistribute it and or modify it under the terms of the gnu {_family}general public license"
    SENTENCES[f"{_k}-later"] = f"{_terms} as published by the free software foundation either version {_version} of the license or at your option any later version"
    SENTENCES[f"{_k}-only"] = f"{_terms} as published by the free software foundation version {_version} of the license"
    SENTENCES[f"{_k}-only-2"] = f"{_terms} version {_version} as published by the free software foundation"
#: Sentences with a part that varies: who holds the copyright.
PATTERNS = {
    "bsd-names": "^neither the names? of .+ nor the names of (its|other|any|their) contributors may be used to endorse or promote products derived from this software without specific prior written permission$",
    "bsd-disclaimer": "^this software is provided by .+ as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed$",
}
#: Ordered rules: a licence is found where its identifiers occur in this order, other sentences between them or not.
RULES = {
    "Apache-2.0": [["apache2-name"], ["spdx-Apache-2.0"]],
    "Apache-2.0-header": [["apache2-name", "apache2-terms", "apache2-basis"]],
    "MIT": [["mit-name"], ["spdx-MIT"]],
    "MIT-text": [["mit-grant", "mit-notice", "as-is"]],
    "BSD-2-Clause": [["bsd2-name"], ["spdx-BSD-2-Clause"]],
    "BSD-2-Clause-text": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-disclaimer"]],
    "BSD-3-Clause": [["bsd3-name"], ["spdx-BSD-3-Clause"]],
    "BSD-3-Clause-text": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]],
    "BSD": [["bsd-name"]],
    "ISC": [["isc-name"], ["spdx-ISC"], ["isc-grant", "isc-disclaimer"]],
    "GPL-2.0": [["gpl2-name"], ["gpl2-only"], ["gpl2-only-2"], ["spdx-GPL-2.0-only"]],
    "GPL-2.0-or-later": [["gpl2-later"], ["spdx-GPL-2.0-or-later"]],
    "GPL-3.0": [["gpl3-name"], ["gpl3-only"], ["gpl3-only-2"], ["spdx-GPL-3.0-only"]],
    "GPL-3.0-or-later": [["gpl3-later"], ["spdx-GPL-3.0-or-later"]],
    "LGPL-2.1": [["lgpl21-name"], ["lgpl21-only"], ["lgpl21-only-2"], ["spdx-LGPL-2.1-only"]],
    "LGPL-2.1-or-later": [["lgpl21-later"], ["spdx-LGPL-2.1-or-later"]],
    "LGPL-3.0": [["lgpl3-name"], ["lgpl3-only"], ["lgpl3-only-2"], ["spdx-LGPL-3.0-only"]],
    "LGPL-3.0-or-later": [["lgpl3-later"], ["spdx-LGPL-3.0-or-later"]],
    "AGPL-3.0": [["agpl3-name"], ["agpl3-only"], ["agpl3-only-2"], ["spdx-AGPL-3.0-only"]],
    "AGPL-3.0-or-later": [["agpl3-later"], ["spdx-AGPL-3.0-or-later"]],
    "MPL-2.0": [["mpl2-name"], ["mpl2-notice"], ["spdx-MPL-2.0"]],
    "EPL-2.0": [["epl2-name"], ["epl2-notice"], ["spdx-EPL-2.0"]],
    "Unlicense": [["unlicense-name"], ["unlicense-domain", "unlicense-grant"], ["spdx-Unlicense"]],
    "CC0-1.0": [["cc0-name"], ["spdx-CC0-1.0"]],
    "CC-BY-4.0": [["cc-by-name"], ["spdx-CC-BY-4.0"]],
    "CC-BY-SA-4.0": [["cc-by-sa-name"], ["spdx-CC-BY-SA-4.0"]],
    "CC-BY-NC-4.0": [["cc-by-nc-name"], ["spdx-CC-BY-NC-4.0"]],
}
#: Every rule needs a sentence with one of these: texts without any are not looked at closely, and have no identifiers.
HINTS = ["licen", "permission", "redistribut", "unencumbered", "released under", "distributed under", "published under", "available under"]
#: What is done to a text in lower case before it is split, in order: comment marks, SPDX lines, line breaks before a sentence that begins a
#: notice and after a copyright line, blank lines, other line breaks, definitions in brackets, enumerators in brackets, abbreviations. Their patterns mean the same to Java and to DuckDB.
STEPS = [
    ("[\u0085\u2028\u2029]|\\r\\n?", "\n"),
    (r"(^|\n)[ \t]*(//+|/[*]+|[*]+/?|#+|;+|--+|%+|<!--+|rem |dnl )[ \t]*", "\\1"),
    (r"[*]+/|--+>", " "),
    (r"spdx-license-identifier[ \t]*:[ \t]*([^\n]*)", "\n\nspdx \\1\n\n"),
    (r"\n[ \t]*((this (work|program|project|file|software|library|package|code|source code|document|repository) (is|and|form)|licen[sc]ed under|released under|available under|permission (is|to)|redistributions? (of|in|and)|all rights reserved|copyright ?([(]c[)]|©|[0-9]{4})|neither the name|unless required) ?)", "\n\n\\1"),
    (r"((^|\n)[ \t]*(copyright ?([(]c[)]|©|[0-9]{4})|all rights reserved)[^\n]*)\n", "\\1\n\n"),
    (r"\n[ \t]*\n[ \t\n]*", " . "),
    (r"[ \t\n]+", " "),
    (r"[(] ?(the|hereinafter)? ?[\"'“”‘’]+[^()\"'“”‘’]{1,60}[\"'“”‘’]+ ?[)]", " "),
    (r"[(] ?([a-z0-9]|[ivx]+) ?[)]", " "),
    (r"(^|[^a-z0-9])(v|ver|vers)[.] ?", "\\1v "),
]
#: A sentence ends at a mark before a blank or the text's end.
SPLIT = "[.!?:;]+(?: |$)"
#: What is done to a sentence of letters and digits: spelling, enumerators.
WORDS = [("[^a-z0-9]+", " "), ("licen[cs]e", "license"), (r"\bsub ?license", "sublicense"), ("non infringement", "noninfringement"), (r"\bas is\b", "as is"), ("^ *[0-9]{1,2} ", ""), (r"\band distribute this\b", "and or distribute this"), ("non ?commercial 4 0", "noncommercial 4 0"), ("share ?alike", "sharealike"), (r"\bv([0-9])", "v \\1"), (r"([0-9]) or later\b", "\\1 orlater")]
#: A sentence that names its licence: what stands before the name, and what may stand after it.
NAMED = r"^(?:.* )?(?:licensed|released|distributed|published|available) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:a )?(.+?)(?: only| orlater| or any later version| or at your option any later version)?$"
_ID = {s: k for k, s in SENTENCES.items()} | {f"name {n}": k for k, names in NAMES.items() for n in names} | {f"spdx {n}".replace("or later", "orlater"): f"spdx-{k}" for k, names in SPDX.items() for n in names}


def _java(replacement: str) -> str:
    return replacement.replace("\\1", "$1")


def plain_sentences(text: Column) -> Column:
    """The normalised sentences of a text in lower case."""
    for pattern, by in STEPS:
        text = F.regexp_replace(text, pattern, _java(by))

    def words(s: Column) -> Column:
        for pattern, by in WORDS:
            s = F.regexp_replace(s, pattern, _java(by))
        return F.trim(s)

    return F.transform(F.split(text, SPLIT), words)


def sentence_ids(low: Column) -> Column:
    """Identifiers of the known sentences of a text in lower case, in order: whole sentences by a table, licences that a sentence names by
    theirs, those with a varying part by their pattern. An SPDX line gives one for each licence of its expression."""
    known = F.create_map(*[F.lit(x) for s, k in _ID.items() for x in (s, k)])

    def look(s: Column) -> Column:
        found = F.coalesce(F.element_at(known, s), F.element_at(known, F.concat(F.lit("name "), F.regexp_extract(s, NAMED, 1))))
        for k, pattern in PATTERNS.items():
            found = F.coalesce(found, F.when(s.rlike(pattern), F.lit(k)))
        return found

    def expression(s: Column) -> Column:
        return F.transform(F.split(F.substring(s, F.lit(6), F.length(s)), " (?:or|and) "), lambda x: F.concat(F.lit("spdx "), x))

    parts = F.flatten(F.transform(plain_sentences(low), lambda s: F.when(s.startswith("spdx "), expression(s)).otherwise(F.array(s))))
    hint = functools.reduce(Column.__or__, [low.contains(h) for h in HINTS])
    return F.when(hint, F.filter(F.transform(parts, look), lambda k: k.isNotNull())).otherwise(F.array().cast("array<string>"))


def _sequence(rule: list[str]) -> str:
    return ",(?:[^,]+,)*?" + "(?:[^,]+,)*?".join(f"{k}," for k in rule)


def rule_found(ids: Column, rules: list[list[str]]) -> Column:
    return F.concat(F.lit(","), F.concat_ws(",", ids), F.lit(",")).rlike("|".join(map(_sequence, rules)))


def find_licences(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids and licences (both joined by commas, in order and as rules are listed) and n_licences of each row's whole
    text. Null and empty texts have none; repeated rows give repeated results; other columns are not read."""
    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    ids = docs.select("doc_id", sentence_ids(F.col("low")).alias("ids"))
    found = F.filter(F.array(*[F.when(rule_found(F.col("ids"), r), F.lit(k)) for k, r in RULES.items()]), lambda k: k.isNotNull())
    found = F.when(F.size("ids") > 0, found).otherwise(F.array().cast("array<string>"))
    return ids.select("doc_id", "ids", found.alias("found")).select("doc_id", F.concat_ws(",", "ids").alias("sentence_ids"), F.concat_ws(",", "found").alias("licences"), F.size("found").cast("long").alias("n_licences"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licences(table(spark, sf_dir, "documents"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _replaced(sql: str, steps: list[tuple[str, str]]) -> str:
    for pattern, by in steps:
        sql = f"regexp_replace({sql}, {_quoted(pattern)}, {_quoted(by)}, 'g')"
    return sql


_KNOWN = ", ".join(f"{_quoted(s)}: {_quoted(k)}" for s, k in _ID.items())
_VARYING = " ".join(f"when regexp_matches(x, {_quoted(p)}) then {_quoted(k)}" for k, p in PATTERNS.items())
_RULES = ", ".join(f"case when regexp_matches(',' || array_to_string(ids, ',') || ',', {_quoted('|'.join(map(_sequence, r)))}) then {_quoted(k)} end" for k, r in RULES.items())
OP6_SQL = f"""
with t as (select doc_id, lower(coalesce(text, '')) t from documents),
s as (select doc_id, case when {' or '.join(f'contains(t, {_quoted(h)})' for h in HINTS)} then list_transform(regexp_split_to_array({_replaced("t", STEPS)}, {_quoted(SPLIT)}), lambda x: trim({_replaced("x", WORDS)})) else [] end s from t),
p as (select doc_id, flatten(list_transform(s, lambda x: case when starts_with(x, 'spdx ') then list_transform(regexp_split_to_array(substr(x, 6), ' (?:or|and) '), lambda y: 'spdx ' || y) else [x] end)) p from s),
k as (select doc_id, map {{{_KNOWN}}} known, p from p),
i as (select doc_id, list_filter(list_transform(p, lambda x: coalesce(known[x], known['name ' || regexp_extract(x, {_quoted(NAMED)}, 1)], case {_VARYING} end)), lambda x: x is not null) ids from k),
f as (select doc_id, ids, list_filter([{_RULES}], lambda x: x is not null) found from i)
select doc_id, coalesce(array_to_string(ids, ','), '') sentence_ids, coalesce(array_to_string(found, ','), '') licences, len(found)::bigint n_licences from f"""
