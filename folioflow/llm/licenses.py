"""Licence recognition: known sentences become identifiers, and rules match the sequences of identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import table

_GNU = "you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation either version {} of the license or at your option any later version"

# Known sentences after normalisation, by name.
SENTENCES = {
    "apache": "licensed under the apache license version 2 0",
    "apache the": "licensed under the apache license version 2 0 the license",
    "apache use": "you may not use this file except in compliance with the license",
    "apache copy": "you may obtain a copy of the license at",
    "apache unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit released": "released under the mit license",
    "mit licensed": "licensed under the mit license",
    "mit title": "mit license",
    "mit the title": "the mit license",
    "mit title mark": "the mit license mit",
    "mit grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit disclaimer": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl3": "this work is licensed under the gnu general public license version 3",
    "gpl3 later": f"this program is free software {_GNU.format('general public license', '3')}",
    "gpl2 later": f"this program is free software {_GNU.format('general public license', '2')}",
    "lgpl3 later": f"this program is free software {_GNU.format('lesser general public license', '3')}",
    "lgpl21 later": f"this library is free software {_GNU.format('lesser general public license', '2 1')}",
    "agpl3 later": f"this program is free software {_GNU.format('affero general public license', '3')}",
    "cc by nc": "licensed under cc by nc 4 0",
    "cc by": "licensed under cc by 4 0",
    "cc by sa": "licensed under cc by sa 4 0",
    "cc0": "licensed under cc0 1 0",
    "cc by full": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc by sa full": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc by nc full": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc0 waiver": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "bsd grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd disclaimer": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "zlib warranty": "this software is provided as is without any express or implied warranty",
    "zlib grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "epl": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "reserved": "all rights reserved",
}
# Licences that a line "SPDX-License-Identifier: name" may name.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only",
    "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
)
SENTENCES |= {f"spdx {name}": "spdx license identifier " + re.sub("[^a-z0-9]+", " ", name.lower()) for name in SPDX}

# Rules in the order in which they are tried; each is a licence and the names of its sentences, in order.
RULES = (
    ("BSD-3-Clause", ("bsd grant", "bsd source", "bsd binary", "bsd names", "bsd disclaimer")),
    ("BSD-3-Clause", ("bsd grant", "bsd source", "bsd binary", "bsd names")),
    ("BSD-2-Clause", ("bsd grant", "bsd source", "bsd binary", "bsd disclaimer")),
    ("BSD-2-Clause", ("bsd grant", "bsd source", "bsd binary")),
    *[("MIT", (*title, "mit grant", "mit notice", *end)) for title in (("mit title",), ("mit the title",), ("mit title mark",), ()) for end in (("mit disclaimer",), ())],
    ("Apache-2.0", ("apache the", "apache use", "apache copy", "apache unless")),
    ("Apache-2.0", ("apache", "apache use", "apache copy", "apache unless")),
    ("Zlib", ("zlib warranty", "zlib grant")),
    *[
        (name, (sentence,)) for name, sentence in (
            ("Apache-2.0", "apache the"), ("Apache-2.0", "apache"), ("MIT", "mit released"), ("MIT", "mit licensed"), ("MIT", "mit grant"),
            ("MIT", "mit title"), ("MIT", "mit the title"), ("MIT", "mit title mark"), ("GPL-3.0-only", "gpl3"), ("GPL-3.0-or-later", "gpl3 later"),
            ("GPL-2.0-or-later", "gpl2 later"), ("LGPL-3.0-or-later", "lgpl3 later"), ("LGPL-2.1-or-later", "lgpl21 later"),
            ("AGPL-3.0-or-later", "agpl3 later"), ("CC-BY-NC-4.0", "cc by nc"), ("CC-BY-NC-4.0", "cc by nc full"), ("CC-BY-SA-4.0", "cc by sa"),
            ("CC-BY-SA-4.0", "cc by sa full"), ("CC-BY-4.0", "cc by"), ("CC-BY-4.0", "cc by full"), ("CC0-1.0", "cc0"), ("CC0-1.0", "cc0 waiver"),
            ("ISC", "isc grant"), ("Zlib", "zlib grant"), ("EPL-2.0", "epl"), ("MPL-2.0", "mpl"), ("Unlicense", "unlicense"),
        )
    ],
    *[(name, (f"spdx {name}",)) for name in SPDX],
)

#: A sentence's identifier is its number; in a sequence it is one character, so that sequences compare as strings.
FIRST = 0xE000
IDENTIFIERS = {name: chr(FIRST + k) for k, name in enumerate(SENTENCES)}
KNOWN = f"{chr(FIRST)}-{chr(FIRST + len(SENTENCES) - 1)}"


def _sequence(names: tuple[str, ...]) -> str:
    return "".join(IDENTIFIERS[n] for n in names)


#: Every known sentence holds one of these words or parts of words, which no line break cuts; a text without any of
#: them needs no look at its sentences.
CUES = ("licens", "permission", "copyright", "redistribut", "domain", "reserved", "warrant")
SENTENCE_END = r"[.!?;:]+[ \t\r\f]+|[\n]+|[.!?;:]+$"


#: Lines without a letter or digit end a paragraph.
BLANK_LINES = r"\n(?:[^a-z0-9\n]*+\n)+"
#: A list number or letter as a sentence of its own, as "1." is.
BULLET = r"(?:[0-9]{1,2}|[a-z]|[ivx]{2,4})"


#: A line that names the holder of the copyright; rules skip it.
HOLDER = "copyright (?:c )?[0-9]{4}[a-z0-9 ]*"


def sentence_identifiers(text: Column) -> Column:
    """One identifier per known sentence, in order; a single dot for each run of other sentences.

    A sentence begins and ends at a line break or at a mark followed by space. Normalising lower-cases it and leaves
    only a-z and 0-9, with single spaces between. A known sentence may have such ends inside too, since notices are
    wrapped and hold semicolons and "v. 2.0", but no blank line; a list number may stand before it. List numbers alone,
    lines of a year and a holder of the copyright, and the address after "obtain a copy of the license at" are no
    sentences.
    """
    s = F.translate(F.lower(text), "|#", "**")
    s = F.regexp_replace(F.regexp_replace(s, BLANK_LINES, "#"), SENTENCE_END, "|")
    s = F.regexp_replace(F.concat(F.lit("#"), s, F.lit("#")), "[^a-z0-9|#]+", " ")
    s = F.regexp_replace(F.regexp_replace(s, " ?([|#]) ?", "$1"), "[|]+", "|")
    s = F.regexp_replace(s, "[|]?#[|#]*+", "#")
    for name, sentence in SENTENCES.items():
        s = F.regexp_replace(s, rf"(?<=[|#])(?:{BULLET} )?+{sentence.replace(' ', '[ |]')}(?=[|#])", IDENTIFIERS[name])
    s = F.regexp_replace(s, rf"(?<=[|#])(?:{BULLET}|{HOLDER}+)[|#]", "")
    s = F.regexp_replace(s, f"(?<=[|#]{IDENTIFIERS['apache copy']}[|#])https?+ [a-z0-9 ]++[|#]", "")
    s = F.replace(F.translate(F.regexp_replace(s, f"[^|#{KNOWN}]+", "."), "#", "|"), F.lit("|"), F.lit(""))
    return F.regexp_replace(s, "[.]+", ".")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licences of each document by rules over its sequence of known sentences.

    Rules are tried in order; each takes its matches out of the sequence, so a short rule doesn't find a part of a
    longer one again. Known sentences that no rule takes count as fragments. The SQL for comparison knows no sentence
    with an end inside; both agree where notices are not wrapped.

    Returns id, licenses (distinct names in the order of the rules, joined by commas; null if none), n_matches,
    n_fragments. Null and empty texts have none; repeated rows and null ids are rows like others; an empty table gives
    no rows; other columns are not read. A narrow job: nothing is shuffled.
    """
    lowered = F.lower(F.col(text_col))
    cue = F.lit(False)
    for c in CUES:
        cue = cue | lowered.contains(c)
    rows = docs.select(F.col(id_col), F.when(cue, sentence_identifiers(F.col(text_col))).otherwise(F.lit("")).alias("rest"))
    found = F.lit(0)
    for k, (_, names) in enumerate(RULES):
        sequence = _sequence(names)
        rows = rows.select(
            id_col, F.replace("rest", F.lit(sequence), F.lit("#")).alias("rest"),
            *[f"n{i}" for i in range(k)], ((F.length("rest") - F.length(F.replace("rest", F.lit(sequence), F.lit("")))) / len(sequence)).cast("int").alias(f"n{k}"),
        )
        found = found + F.col(f"n{k}")
    names = F.array_distinct(F.filter(F.array(*[F.when(F.col(f"n{k}") > 0, n) for k, (n, _) in enumerate(RULES)]), lambda x: x.isNotNull()))
    return rows.select(
        id_col,
        F.when(F.size(names) > 0, F.array_join(names, ",")).alias("licenses"),
        found.cast("int").alias("n_matches"),
        F.length(F.regexp_replace("rest", "[.#]", "")).cast("int").alias("n_fragments"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def license_sql() -> str:
    """The same in DuckDB's SQL."""
    cases = " ".join(f"WHEN s = '{sentence}' THEN '{IDENTIFIERS[name]}'" for name, sentence in SENTENCES.items())
    cases += f" WHEN regexp_full_match(s, '{HOLDER}') THEN ''"
    steps, previous = [], "marked"
    for k, (_, names) in enumerate(RULES):
        sequence = _sequence(names)
        steps.append(
            f"r{k} AS (SELECT * EXCLUDE (rest), (length(rest) - length(replace(rest, '{sequence}', ''))) // {len(sequence)} AS n{k}, "
            f"replace(rest, '{sequence}', '#') AS rest FROM {previous})"
        )
        previous = f"r{k}"
    names = ", ".join(f"CASE WHEN n{k} > 0 THEN {i} END" for k, i in enumerate(_first_places()))
    order = list(dict.fromkeys(n for n, _ in RULES))
    labels = ", ".join(f"'{n}'" for n in order)
    total = " + ".join(f"n{k}" for k in range(len(RULES)))
    return f"""
WITH marked AS (
  SELECT doc_id, regexp_replace(array_to_string(list_transform(list_filter(list_transform(
      regexp_split_to_array(lower(coalesce(text, '')), '{SENTENCE_END}'),
      lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> ''),
      lambda s: CASE {cases} ELSE '.' END), ''), '[.]+', '.', 'g') AS rest
  FROM documents), {", ".join(steps)}
SELECT doc_id,
  CASE WHEN {total} > 0 THEN array_to_string(list_transform(list_sort(list_distinct(list_filter([{names}], lambda x: x IS NOT NULL))),
    lambda i: [{labels}][i]), ',') END AS licenses,
  CAST({total} AS INTEGER) AS n_matches,
  CAST(length(regexp_replace(rest, '[.#]', '', 'g')) AS INTEGER) AS n_fragments
FROM {previous}"""


def _first_places() -> list[int]:
    order = list(dict.fromkeys(n for n, _ in RULES))
    return [order.index(n) + 1 for n, _ in RULES]
