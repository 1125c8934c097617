"""Licence recognition: normalised sentences -> known sentence identifiers -> ordered identifier rules."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licences by their public short identifier, and the names that one-line notices call them by.
LICENSES = {
    "Apache-1.1": ["Apache License 1.1", "Apache Software License, Version 1.1"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "MIT": ["MIT License", "Expat License"],
    "ISC": ["ISC License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "2-clause BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "3-clause BSD License"],
    "0BSD": ["BSD Zero Clause License"],
    "GPL-2.0-only": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2"],
    "GPL-2.0-or-later": ["GNU General Public License, version 2 or later"],
    "GPL-3.0-only": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3"],
    "GPL-3.0-or-later": ["GNU General Public License, version 3 or later"],
    "LGPL-2.1-only": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1"],
    "LGPL-3.0-only": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3"],
    "AGPL-3.0-only": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3"],
    "MPL-1.1": ["Mozilla Public License, version 1.1", "Mozilla Public License 1.1"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "EPL-1.0": ["Eclipse Public License v1.0", "Eclipse Public License 1.0"],
    "EPL-2.0": ["Eclipse Public License v2.0", "Eclipse Public License 2.0"],
    "CDDL-1.0": ["Common Development and Distribution License 1.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "Zlib": ["zlib License"],
    "Unlicense": ["Unlicense"],
    "WTFPL": ["Do What The F*ck You Want To Public License"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "PSF-2.0": ["Python Software Foundation License 2.0"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"],
    "CC-BY-3.0": ["CC BY 3.0", "Creative Commons Attribution 3.0 Unported License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-3.0": ["CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "ODbL-1.0": ["Open Data Commons Open Database License v1.0"],
}

# What one-line notices say around a licence's name.
NOTICES = ["Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "This project is licensed under the {}.", "This software is licensed under the {}.", "License: {}"]

# Known sentences of notices and licence texts (identifier, sentence).
SENTENCES = [
    ("apache.notice.1", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("apache.notice.2", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache.notice.2", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"),
    ("apache.notice.3", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("mit.grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit.notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit.warranty", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("isc.grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc.grant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0bsd.grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("gpl2.redistribute", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl.redistribute", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl.warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("lgpl.redistribute", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl.redistribute", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mpl.notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl.copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("mpl.copy", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("bsl.grant", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    ("unlicense.domain", "This is free and unencumbered software released into the public domain."),
    ("unlicense.grant", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("bsd.redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd.source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd.binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd.endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("zlib.asis", "This software is provided 'as-is', without any express or implied warranty."),
    ("zlib.grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("public.domain", "This work is in the public domain."),
    ("rights.reserved", "All rights reserved."),
]

# Rules (licence, sentence identifiers that must follow one another among the known sentences).
RULES = [
    ("Apache-2.0", ["apache.notice.1", "apache.notice.2", "apache.notice.3"]),
    ("Apache-2.0", ["apache.notice.1", "apache.notice.2"]),
    ("Apache-2.0", ["apache.notice.1"]),
    ("MIT", ["mit.grant", "mit.notice", "mit.warranty"]),
    ("MIT", ["mit.grant", "mit.notice"]),
    ("MIT", ["mit.grant"]),
    ("ISC", ["isc.grant"]),
    ("0BSD", ["0bsd.grant"]),
    ("GPL-2.0-or-later", ["gpl2.redistribute", "gpl.warranty"]),
    ("GPL-2.0-or-later", ["gpl2.redistribute"]),
    ("GPL-3.0-or-later", ["gpl.redistribute", "gpl.warranty"]),
    ("GPL-3.0-or-later", ["gpl.redistribute"]),
    ("LGPL-2.1-or-later", ["lgpl.redistribute"]),
    ("AGPL-3.0-or-later", ["agpl.redistribute"]),
    ("MPL-2.0", ["mpl.notice", "mpl.copy"]),
    ("MPL-2.0", ["mpl.notice"]),
    ("BSL-1.0", ["bsl.grant"]),
    ("Unlicense", ["unlicense.domain", "unlicense.grant"]),
    ("Unlicense", ["unlicense.domain"]),
    ("BSD-3-Clause", ["bsd.redistribution", "bsd.source", "bsd.binary", "bsd.endorse"]),
    ("BSD-3-Clause", ["bsd.redistribution", "bsd.source", "bsd.endorse"]),
    ("BSD-2-Clause", ["bsd.redistribution", "bsd.source", "bsd.binary"]),
    ("BSD-2-Clause", ["bsd.redistribution", "bsd.source"]),
    ("Zlib", ["zlib.asis", "zlib.grant"]),
    ("Zlib", ["zlib.grant"]),
    ("LicenseRef-Public-Domain", ["public.domain"]),
]
#: Rules that only count in a document without any other licence.
LAST_RULES = [("Proprietary", ["rights.reserved"])]


def known_lines() -> list[tuple[str, str]]:
    """(identifier, sentence) of the one-line notices and headers of all LICENSES; a line's identifier is its licence's."""
    out = [(f"line:{spdx}", f"SPDX-License-Identifier: {spdx}") for spdx in LICENSES]
    return out + [(f"line:{spdx}", notice.format(name)) for spdx, names in LICENSES.items() for name in names for notice in NOTICES]


def default_sentences() -> list[tuple[str, str]]:
    return SENTENCES + known_lines()


def default_rules() -> list[tuple[str, list[str]]]:
    return RULES + [(spdx, [f"line:{spdx}"]) for spdx in LICENSES]


def normal(sentence: str) -> str:
    """What scan_licenses does to a sentence, for the table."""
    return re.sub("[^A-Za-z0-9]+", " ", sentence).strip(" ").lower()


def sentence_pattern(sentences: list[str]) -> str:
    """The pattern of known normalised sentences; of those that start alike, the longest that fits is taken."""
    return r"(?<![^\n])(?:" + "|".join(x.replace(" ", r"[ \n]+") for x in sorted(sentences, key=lambda x: (-len(x), x))) + r")(?![^\n])"


def needed_words(sentences: list[str]) -> list[str]:
    """Few words of which every one of the normalised sentences holds one at least, of six letters or more where there is one."""
    left, out = list(sentences), []
    while left:
        words = {w for s in left for w in s.split() if len(w) >= 6} or {max(s.split(), key=len) for s in left}
        out.append(max(words, key=lambda w: (sum(w in s for s in left), len(w), w)))
        left = [s for s in left if out[-1] not in s]
    return out


def scan_licenses(docs: DataFrame, sentences: list[tuple[str, str]] | None = None, rules: list[tuple[str, list[str]]] | None = None, last_rules: list[tuple[str, list[str]]] = LAST_RULES) -> DataFrame:
    """One row per document row: its columns, licenses (sorted, comma-joined, "" for none), n_sentences (known ones), rule_hits; these three replace columns of that name.

    A sentence starts and ends at a line break or after ".", "!" or "?" before white space, and is compared after
    normalisation to lower-case words. A known one may run over several lines, blank ones and comment marks included, so
    hard-wrapped notices are found too; where two fit, the longer one counts.
    A rule hits if its identifiers follow one another among the document's known sentences; unknown sentences between them
    don't matter. Longer rules go first, and what they hit is taken; equal ones in the order of their names. last_rules
    are only looked at where no rule has hit. Null and empty texts have no sentence; an empty table gives no row.

    The tables of sentences and rules are constants of the program and so bounded; each row is judged where it is. Only
    texts that hold a word which some known sentence needs are normalised at all.
    """
    sentences, rules = default_sentences() if sentences is None else sentences, default_rules() if rules is None else rules
    known: dict[str, str] = {}
    for i, t in sentences:
        known.setdefault(normal(t), i)
    # one string of normalised pieces, each between line breaks
    pieces = F.regexp_replace("text", r"[.!?]\s+", "\n")
    pieces = F.regexp_replace(F.lower(F.regexp_replace(pieces, r"[^A-Za-z0-9\n]+", " ")), r" ?\n ?", "\n")
    found = F.regexp_extract_all(F.trim(pieces), F.lit(sentence_pattern(list(known))), F.lit(0))
    sids = F.from_json(F.lit(json.dumps(known)), "map<string,string>")
    run = F.transform(found, lambda x: F.element_at(sids, F.regexp_replace(x, r"\n+", " ")))
    low, may = F.lower("text"), F.lit(False)
    for w in needed_words(list(known)):
        may = may | F.contains(low, F.lit(w))
    run = F.when(may, run).otherwise(F.array().cast("array<string>"))
    runs = docs.select(F.struct("*").alias("row__"), run.alias("run")).select("row__", F.size("run").alias("n_sentences"), _apply("run", rules, last_rules).alias("h"))
    new = {"licenses": F.array_join(F.array_sort(F.array_distinct("h")), ","), "n_sentences": F.col("n_sentences"), "rule_hits": F.size("h")}
    return runs.select(*[F.col(f"row__.`{c}`") for c in docs.columns if c not in new], *[x.alias(c) for c, x in new.items()])


def _ordered(rules: list[tuple[str, list[str]]]) -> list[tuple[str, str]]:
    """(licence, its identifiers as a run) of rules, longer ones first."""
    return [(name, "," + ",".join(ids) + ",") for name, ids in sorted(rules, key=lambda r: (-len(r[1]), r[0], r[1]))]


def _apply(run: str, rules: list[tuple[str, list[str]]], last_rules: list[tuple[str, list[str]]]) -> Column:
    """The names of the rules that hit a run of identifiers; what a rule matches is blanked, so no other counts it again."""
    none = F.array().cast("array<string>")
    table = lambda rs: F.from_json(F.lit(json.dumps([{"name": k, "needle": v} for k, v in _ordered(rs)])), "array<struct<name:string,needle:string>>")

    def step(state: Column, rule: Column) -> Column:
        hit = F.contains(state["ids"], rule["needle"])
        names = F.when(hit, F.concat(state["names"], F.array(rule["name"]))).otherwise(state["names"])
        return F.struct(F.replace(state["ids"], rule["needle"], F.lit(",-,")).alias("ids"), names.alias("names"))

    start = F.struct(F.concat(F.lit(","), F.array_join(run, ","), F.lit(",")).alias("ids"), none.alias("names"))
    first = F.aggregate(table(rules), start, step) if rules else start
    last = F.aggregate(table(last_rules), first, step)["names"] if last_rules else none
    return F.when(F.size(run) == 0, none).when(F.size(first["names"]) > 0, first["names"]).otherwise(last)


def oracle() -> str:
    """DuckDB SQL for scan_licenses over documents (doc_id, licenses, n_sentences, rule_hits)."""
    known: dict[str, str] = {}
    for i, t in default_sentences():
        known.setdefault(normal(t), i)
    quoted = ", ".join(f"('{n}', '{i}')" for n, i in known.items())
    steps, prev = [], "runs"
    for k, (name, needle) in enumerate(_ordered(default_rules())):
        steps.append(f"r{k} AS (SELECT doc_id, n_sentences, replace(ids, '{needle}', ',-,') AS ids, CASE WHEN strpos(ids, '{needle}') > 0 THEN list_append(h, '{name}') ELSE h END AS h FROM {prev})")
        prev = f"r{k}"
    for k, (name, needle) in enumerate(_ordered(LAST_RULES)):
        steps.append(f"last{k} AS (SELECT doc_id, n_sentences, ids, CASE WHEN len(h) = 0 AND strpos(ids, '{needle}') > 0 THEN ['{name}'] ELSE h END AS h FROM {prev})")
        prev = f"last{k}"
    return f"""
WITH known(norm, sid) AS (VALUES {quoted}),
cut AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)) AS s FROM documents),
each AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM cut),
found AS (SELECT doc_id, pos, sid FROM (SELECT doc_id, pos, lower(trim(regexp_replace(sentence, '[^A-Za-z0-9]+', ' ', 'g'))) AS norm FROM each) JOIN known USING (norm)),
runs AS (SELECT doc_id, count(*) AS n_sentences, ',' || string_agg(sid, ',' ORDER BY pos) || ',' AS ids, []::VARCHAR[] AS h FROM found GROUP BY doc_id),
{", ".join(steps)}
SELECT d.doc_id, coalesce(array_to_string(list_sort(list_distinct(h)), ','), '') AS licenses, CAST(coalesce(n_sentences, 0) AS INT) AS n_sentences, CAST(coalesce(len(h), 0) AS INT) AS rule_hits
FROM documents d LEFT JOIN {prev} r USING (doc_id)
"""
