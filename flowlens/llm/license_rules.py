"""Licence scan by sentence rules (native DataFrame code).

A text is cut into sentences, each normalised sentence that is a known licence
sentence becomes its identifier and any other one ``?``, and the identifier
sequence is matched against ordered rules: the first rule's occurrences are
consumed, then the next one's, so a full licence wins over the sentences it
shares with others. Known sentences left over are reported as
``fragment:<identifier>``.

Sentences end at ``. ! ? : ;`` before white space and at line ends; a line
that starts with a lower-case letter continues the line before it, and leading
comment and list marks of a line (``1.``, ``(a)``) are dropped. Normalised: A-Z
lower-cased, every run of other characters than a-z, 0-9 one space, trimmed, and
lead-ins ("this project is released under the terms of") cut to "licensed
under". Sentences without a letter don't count.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Known licence sentences, normalised, and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache2-ref",
    "licensed under the apache license version 2 0 the license": "apache2-grant",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "apache2-obtain",
    "unless required by applicable law or agreed to in writing software distributed under the license is "
    "distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-asis",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "the mit license": "mit-title",
    "mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the "
    "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
    "persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions "
    "of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement": "mit-asis",
    "this work is licensed under the gnu general public license version 3": "gpl3-ref",
    "this program is free software": "gpl-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
    "free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
    "free software foundation either version 2 of the license or at your option any later version": "gpl2-later",
    "licensed under cc by nc 4 0": "ccbync4-ref",
    "licensed under cc by 4 0": "ccby4-ref",
    "licensed under cc by sa 4 0": "ccbysa4-ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby4-ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following "
    "disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
    "following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission": "bsd-endorse",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
    "granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "all rights reserved": "reserved",
}

# Licences by their identifier sequences, the first that matches wins.
RULES = (
    ("Apache-2.0", ("apache2-grant", "apache2-comply", "apache2-obtain")),
    ("Apache-2.0", ("apache2-grant", "apache2-comply")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-later")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl2-later")),
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-asis")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache2-ref",)),
    ("MIT", ("mit-ref",)),
    ("GPL-3.0-only", ("gpl3-ref",)),
    ("CC-BY-NC-4.0", ("ccbync4-ref",)),
    ("CC-BY-4.0", ("ccby4-ref",)),
    ("CC-BY-SA-4.0", ("ccbysa4-ref",)),
    ("all-rights-reserved", ("reserved",)),
)

# SPDX names that a licence tag may give.
SPDX = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only",
        "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only",
        "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")
TAG = "spdx license identifier"
TAGGED = r"(SPDX-License-Identifier):[ \t]*([A-Za-z0-9.+-]+)"      # a sentence of its own

LINE_START = r"[ \t\r]*\n[ \t#*/;>-]*(?:\(?(?:[0-9]{1,2}|[a-zA-Z])[.)][ \t]+)?"
LEAD_IN = (r"^(?:this (?:project|software|work|program|file|code|library|package|repository) is )?(?:dual )?"
           r"(?:licensed|released|distributed|available) under (?:the terms of )?")


def _normalised(sentence: str) -> str:
    """As :func:`sentences` normalises."""
    plain = re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip()
    return re.sub(LEAD_IN, "licensed under ", plain)


SENTENCES = SENTENCES | {_normalised(f"{TAG} {name}"): f"spdx-{_normalised(name).replace(' ', '-')}" for name in SPDX}
RULES = RULES + tuple((name, (SENTENCES[_normalised(f"{TAG} {name}")],)) for name in SPDX)


def anchors(known=SENTENCES) -> list[str]:
    """A few words of which every known sentence holds one: a text without any of
    them has no known sentence."""
    left, out = [set(_normalised(s).split()) for s in known], []
    while left:
        words = sorted({w for s in left for w in s})
        out.append(max(words, key=lambda w: (sum(w in s for s in left) * min(len(w), 6), len(w), w)))
        left = [s for s in left if out[-1] not in s]
    return out


def sentences(text: Column) -> Column:
    """Normalised sentences of a text, in order (array<string>)."""
    t = F.regexp_replace(text, TAGGED, "$1 $2.\n")
    t = F.regexp_replace(t, LINE_START, "\n")
    t = F.regexp_replace(t, r"([.!?:;])[ \t]+", "$1\n")
    t = F.regexp_replace(t, r"([^.!?:;\n])\n([a-z])", "$1 $2")
    plain = F.transform(F.split(t, r"\n+"), lambda s: F.regexp_replace(
        F.trim(F.regexp_replace(F.translate(s, UPPER, LOWER), "[^a-z0-9]+", " ")), LEAD_IN, "licensed under "))
    return F.filter(plain, lambda s: s.rlike("[a-z]"))


def _identified(known) -> dict:
    return {_normalised(s): i for s, i in known.items()}


def identifiers(text: Column, known=SENTENCES) -> Column:
    """The text's sentence identifiers as ``<id><?><id>...``."""
    ids = F.create_map(*[F.lit(x) for pair in _identified(known).items() for x in pair])
    return F.concat_ws("", F.transform(
        sentences(text), lambda s: F.concat(F.lit("<"), F.coalesce(F.element_at(ids, s), F.lit("?")), F.lit(">"))))


def pattern(ids) -> str:
    return "".join(f"<{i}>" for i in ids)


def _rule_table(rules, known) -> list[tuple[str, str]]:
    return [(name, pattern(ids)) for name, ids in rules] \
        + [(f"fragment:{i}", f"<{i}>") for i in dict.fromkeys(known.values())]


def licenses(docs: DataFrame, rules=RULES, known=SENTENCES) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per row and rule that matched: doc_id,
    license, rule (its number, from 0), matches.

    NULL and empty texts and texts without known sentences give no rows;
    repeated rows give repeated rows, a NULL doc_id stays NULL. Whole texts
    are read; other columns are ignored."""
    table = _rule_table(rules, known)
    raw = F.lower(F.col("text"))
    anchored = F.lit(False)
    for a in anchors(known):
        anchored = anchored | F.contains(raw, F.lit(a))
    found = F.aggregate(
        F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(name).alias("license"), F.lit(p).alias("p"))
                  for i, (name, p) in enumerate(table)]),
        F.struct(F.col("ids").alias("seq"),
                 F.expr("cast(array() as array<struct<rule:int,license:string,matches:bigint>>)").alias("hits")),
        lambda acc, r: F.when(
            F.contains(acc["seq"], r["p"]),
            F.struct(
                F.replace(acc["seq"], r["p"], F.lit("<#>")).alias("seq"),
                F.concat(acc["hits"], F.array(F.struct(
                    r["rule"].alias("rule"), r["license"].alias("license"),
                    ((F.length(acc["seq"]) - F.length(F.replace(acc["seq"], r["p"], F.lit(""))))
                     / F.length(r["p"])).cast("bigint").alias("matches")))).alias("hits"))).otherwise(acc),
        lambda acc: acc["hits"])
    return docs.where(anchored) \
        .select("doc_id", identifiers(F.col("text"), known).alias("ids")) \
        .select("doc_id", F.explode(found).alias("hit")) \
        .select("doc_id", "hit.license", F.col("hit.rule").alias("rule"), "hit.matches")


def oracle_sql(rules=RULES, known=SENTENCES) -> str:
    table = _rule_table(rules, known)
    keys = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in _identified(known).items()) + "}"
    steps, prev = [], "d"
    for i, (_, p) in enumerate(table):
        counts = ", ".join(f"n{j}" for j in range(i))
        steps.append(f"r{i} as (select doc_id, replace(seq, '{p}', '<#>') as seq{', ' if counts else ''}{counts}, "
                     f"(length(seq) - length(replace(seq, '{p}', ''))) // {len(p)} as n{i} from {prev})")
        prev = f"r{i}"
    rows = "\nunion all ".join(
        f"select doc_id, '{name}' as license, {i} as rule, n{i} as matches from {prev} where n{i} > 0"
        for i, (name, _) in enumerate(table))
    chain = ",\n".join(steps)
    return rf"""
with t as (
  select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{TAGGED}', '\1 \2.' || chr(10), 'g'),
    '{LINE_START}', chr(10), 'g'),
    '([.!?:;])[ \t]+', '\1' || chr(10), 'g'), '([^.!?:;\n])\n([a-z])', '\1 \2', 'g') as t
  from documents where text is not null),
n as (
  select doc_id, list_transform(regexp_split_to_array(t, '\n+'), lambda s: regexp_replace(
    trim(regexp_replace(translate(s, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')), '{LEAD_IN}', 'licensed under ')) as ss
  from t),
d as (
  select doc_id, array_to_string(list_transform(list_filter(ss, lambda s: regexp_matches(s, '[a-z]')), lambda s:
    '<' || coalesce({keys}[s], '?') || '>'), '') as seq
  from n),
{chain}
{rows}
"""
