"""Licence recognition by sentences and ordered rules, in built-in expressions only.

A text is unwrapped: its lines are joined, and it is cut at ends of sentences, at lines without a letter or digit, at
colons that end a line, and around lines that are known by themselves (titles, SPDX tags, addresses).  A
sentence is normalised (A-Z lowered, all but a-z and 0-9 to single spaces, list numbers dropped, names of
holders and programs folded to one word) and looked up among known licence sentences, which gives it an
identifier.  The text becomes the sequence of its identifiers; up to ``GAP`` unknown sentences between two are a
gap ("~"), more are a break ("=").  Ordered rules, the more specific first, are matched against that
sequence, across gaps but not across breaks; what a rule has matched is used up.  Known sentences that no rule
has used are counted as left over.

The plan is one projection over the scan: no explode, no join, no shuffle.

Null and empty texts have no sentences and no licences; texts of any length are scanned whole.  Repeated rows are
scanned each; a null doc_id stays null; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and their identifiers; names of holders are written x.
SENTENCES: dict[str, str] = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions": "MitGrant",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so": "Mit0Grant",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software": "MitNotice",
    "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software": "MitNotice",
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT": "MitAsIs",
    "IN NO EVENT SHALL x BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE": "MitLiable",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "BsdGrant",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "BsdSource",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "BsdBinary",
    "All advertising materials mentioning features or use of this software must display the following acknowledgement": "BsdAdvert",
    "Neither the name of x nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdName",
    "THIS SOFTWARE IS PROVIDED BY x AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED": "BsdAsIs",
    "IN NO EVENT SHALL x BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE": "BsdLiable",
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License": "ApacheUse",
    "The ASF licenses this file to You under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License": "ApacheUse",
    "You may obtain a copy of the License at": "ApacheCopy",
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0": "ApacheCopy",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied": "ApacheAsIs",
    "See the License for the specific language governing permissions and limitations under the License": "ApacheSee",
    "x is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE": "GnuNoWarranty",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v": "MplSubject",
    "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/": "Mpl2Copy",
    "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/": "Mpl2Copy",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "Bsd0Grant",
    "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS": "IscAsIs",
    "IN NO EVENT SHALL x BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE": "IscLiable",
    "This is free and unencumbered software released into the public domain": "Unlicense",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means": "UnlicenseFree",
    "This software is provided 'as-is', without any express or implied warranty": "ZlibAsIs",
    "In no event will the authors be held liable for any damages arising from the use of this software": "ZlibLiable",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions": "ZlibGrant",
    "Distributed under the Boost Software License, Version 1.0": "Boost",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0": "Epl2",
}
# Lines that are sentences by themselves, wherever they stand.
LINES: dict[str, str] = {
    "Apache License": "ApacheTitle",
    "Version 2.0, January 2004": "ApacheVersion",
    "http://www.apache.org/licenses/LICENSE-2.0": "ApacheUrl",
    "https://www.apache.org/licenses/LICENSE-2.0": "ApacheUrl",
    "GNU GENERAL PUBLIC LICENSE": "GplTitle",
    "GNU LESSER GENERAL PUBLIC LICENSE": "LgplTitle",
    "GNU AFFERO GENERAL PUBLIC LICENSE": "AgplTitle",
    "Version 2, June 1991": "Gnu2Version",
    "Version 2.1, February 1999": "Gnu21Version",
    "Version 3, 29 June 2007": "Gnu3Version",
    "Version 3, 19 November 2007": "Agpl3Version",
    "Mozilla Public License Version 2.0": "Mpl2Title",
    "Boost Software License - Version 1.0 - August 17th, 2003": "BoostTitle",
    "Creative Commons Legal Code": "CcTitle",
    "CC0 1.0 Universal": "Cc0Title",
}
# The GNU licences' titles and versions.
GNU = {"GPL": ("General Public License", ("2", "3")), "LGPL": ("Lesser General Public License", ("2.1", "3")), "AGPL": ("Affero General Public License", ("3",))}
# Licences by SPDX identifier, and by the names that a one-line declaration uses.
SPDX = "MIT MIT-0 Apache-2.0 BSD-2-Clause BSD-3-Clause ISC 0BSD GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 Unlicense Zlib BSL-1.0 EPL-2.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0".split()
NAMES = {
    "MIT License": "MIT",
    "Apache License, Version 2.0": "Apache-2.0",
    "BSD 2-Clause License": "BSD-2-Clause",
    "BSD 3-Clause License": "BSD-3-Clause",
    "ISC License": "ISC",
    "Mozilla Public License, Version 2.0": "MPL-2.0",
    "GNU General Public License, Version 2": "GPL-2.0",
    "GNU General Public License, Version 3": "GPL-3.0",
    "GNU Lesser General Public License, Version 3": "LGPL-3.0",
    "GNU Affero General Public License, Version 3": "AGPL-3.0",
}
LEADS = ("Licensed under {}", "Released under {}", "Distributed under {}", "This work is licensed under {}", "This project is licensed under {}", "This software is licensed under {}")
# The Creative Commons licences' elements and versions.
CREATIVE = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
CC_VERSIONS = {"3.0": "3.0 Unported", "4.0": "4.0 International"}

#: Unknown sentences that may stand between two sentences of a rule.
GAP = 3
BORDER = r"""[.!?]+["')\]]*[ \t]+|\n"""
NUMBER = r"^[ \t]*[(\[]?(?:[0-9]{1,2}|[A-Za-z]|[ivx]{1,4})[.)\]][ \t]+"
COUNTER = r"^(?:[0-9]{1,2}|[a-z]|[ivx]{1,4})$"
# What starts or marks a sentence with a name in it, and how it is folded.
FOLDS: list[tuple[str, str]] = [
    (r"^.{1,80}? is free software you can redistribute it", "x is free software you can redistribute it"),
    (r"^.{1,80}? is distributed in the hope that it will be useful", "x is distributed in the hope that it will be useful"),
    (r"general public license along with .*$", "general public license along with x"),
    (r"^neither the name of .{1,200}? nor the names of", "neither the name of x nor the names of"),
    (r"^this software is provided by .{1,200}? as is and any", "this software is provided by x as is and any"),
    (r"^in no event shall .{1,300}? be liable", "in no event shall x be liable"),
]
MARKS = ["is free software you can", "is distributed in the hope", "general public license along with", "neither the name of", "this software is provided by", "in no event shall"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain(sentence: str) -> str:
    """A sentence as the scan normalises it."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def known_sentences() -> tuple[dict[str, str], dict[str, str]]:
    """Normalised sentences and lines with their identifiers: the fixed ones and those that are made by rule."""
    whole, lines = dict(SENTENCES), dict(LINES)
    for licence, (title, versions) in GNU.items():
        for v in versions:
            free = f"x is free software: you can redistribute it and/or modify it under the terms of the GNU {title}"
            whole[f"{free} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version"] = f"{licence}{v}Later"
            whole[f"{free} version {v} as published by the Free Software Foundation"] = f"{licence}{v}Only"
            whole[f"{free} as published by the Free Software Foundation, version {v} of the License"] = f"{licence}{v}Only"
        whole[f"See the GNU {title} for more details"] = "GnuDetails"
        whole[f"You should have received a copy of the GNU {title} along with x"] = "GnuCopy"
    for name, licence in NAMES.items():
        lines |= {lead.format(f"the {name}"): f"Named:{licence}" for lead in LEADS}
    for kind, title in CREATIVE.items():
        for v, version in CC_VERSIONS.items():
            lines |= {lead.format(f"CC {kind} {v}"): f"Named:CC-{kind}-{v}" for lead in LEADS}
            lines |= {f"This work is licensed under {a} Creative Commons {title} {version} License": f"Named:CC-{kind}-{v}" for a in ("a", "the")}
    lines |= {f"SPDX-License-Identifier: {x}": f"Spdx:{x}" for x in SPDX}
    return {plain(s): i for s, i in (whole | lines).items()}, {plain(s): i for s, i in lines.items()}


def ordered_rules() -> list[tuple[str, list[str]]]:
    """Rules in the order in which they are tried; each a licence and its sequence of identifiers."""
    rules: list[tuple[str, list[str]]] = []

    def rule(licence: str, ids: str, least: int = 1) -> None:
        steps = ids.split()
        rules.extend((licence, steps[:k]) for k in range(len(steps), least - 1, -1))

    rule("MIT", "MitGrant MitNotice MitAsIs MitLiable", 2)
    rule("MIT-0", "Mit0Grant MitAsIs MitLiable", 2)
    rule("BSD-4-Clause", "BsdGrant BsdSource BsdBinary BsdAdvert BsdName BsdAsIs BsdLiable", 4)
    rule("BSD-3-Clause", "BsdGrant BsdSource BsdBinary BsdName BsdAsIs BsdLiable", 4)
    rule("BSD-2-Clause", "BsdGrant BsdSource BsdBinary BsdAsIs BsdLiable", 3)
    rule("Apache-2.0", "ApacheTitle ApacheVersion", 2)
    rule("Apache-2.0", "ApacheUse ApacheCopy ApacheUrl ApacheAsIs ApacheSee", 3)
    rule("Apache-2.0", "ApacheUse ApacheCopy ApacheAsIs ApacheSee")
    for licence, (_, versions) in GNU.items():
        for v in versions:
            full = v if "." in v else f"{v}.0"
            rule(f"{licence}-{full}-or-later", f"{licence}{v}Later GnuNoWarranty GnuDetails GnuCopy")
            rule(f"{licence}-{full}-only", f"{licence}{v}Only GnuNoWarranty GnuDetails GnuCopy")
    rule("GPL-2.0", "GplTitle Gnu2Version", 2)
    rule("GPL-3.0", "GplTitle Gnu3Version", 2)
    rule("LGPL-2.1", "LgplTitle Gnu21Version", 2)
    rule("LGPL-3.0", "LgplTitle Gnu3Version", 2)
    rule("AGPL-3.0", "AgplTitle Agpl3Version", 2)
    rule("MPL-2.0", "MplSubject Mpl2Copy", 2)
    rule("MPL-2.0", "Mpl2Copy")
    rule("MPL-2.0", "Mpl2Title")
    rule("ISC", "IscGrant IscAsIs IscLiable")
    rule("0BSD", "Bsd0Grant IscAsIs IscLiable", 2)
    rule("Unlicense", "Unlicense UnlicenseFree")
    rule("Zlib", "ZlibAsIs ZlibLiable ZlibGrant", 3)
    rule("BSL-1.0", "Boost")
    rule("BSL-1.0", "BoostTitle")
    rule("EPL-2.0", "Epl2")
    rule("CC0-1.0", "CcTitle Cc0Title", 2)
    rule("CC0-1.0", "Cc0Title")
    for i in dict.fromkeys(known_sentences()[0].values()):
        if ":" in i:
            rule(i.split(":")[1], i)
    return rules


def _pattern(ids: list[str]) -> str:
    return "".join(f"<{i}>" for i in ids)


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(sentence, UPPER, LOWER), "[^a-z0-9]+", " "))


def folded(sentence: Column) -> Column:
    """Names in the sentences that have one, as x."""
    some, out = F.lit(False), sentence
    for mark in MARKS:
        some = some | F.contains(sentence, F.lit(mark))
    for pattern, put in FOLDS:
        out = F.regexp_replace(out, pattern, put)
    return F.when(some, out).otherwise(sentence)


def scan(docs: DataFrame) -> DataFrame:
    """Per document: its sentences, known sentences, identifier sequence, licences in the rules' order, and known sentences left over."""
    sentences, lines = known_sentences()
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])

    def marked(line: Column) -> Column:
        raw, n = line["raw"], line["n"]
        return F.when(n == "", F.lit("\n")).when(n.isin(*lines), F.concat(F.lit("\n"), raw, F.lit("\n"))).when(F.rtrim(raw).endswith(":"), F.concat(raw, F.lit("\n"))).otherwise(raw)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.transform(F.split(text, "\r\n|\n|\r"), lambda x: F.struct(x.alias("raw"), normalised(x).alias("n"))).alias("lines"))
        .select("doc_id", F.split(F.array_join(F.transform("lines", marked), " "), BORDER).alias("raw"))
        .select("doc_id", F.filter(F.transform("raw", lambda s: normalised(F.regexp_replace(s, NUMBER, ""))), lambda s: (s != "") & ~F.rlike(s, F.lit(COUNTER))).alias("norm"))
        .select("doc_id", F.size("norm").cast("long").alias("n_sentences"), F.transform(F.transform("norm", folded), lambda s: F.when(s.isin(*sentences), F.try_element_at(known, s))).alias("ids"))
        .select(
            "doc_id",
            "n_sentences",
            F.size(F.filter("ids", lambda i: i.isNotNull())).cast("long").alias("n_known"),
            F.array_join(F.transform("ids", lambda i: F.coalesce(F.concat(F.lit("<"), i, F.lit(">")), F.lit("~"))), "").alias("each"),
        )
        .select("doc_id", "n_sentences", "n_known", F.regexp_replace(F.regexp_replace("each", f"~{{{GAP + 1},}}", "="), "~+", "~").alias("sequence"))
    )
    steps = F.array(*[F.struct(F.lit(name).alias("licence"), F.lit(_pattern(ids)).alias("pattern")) for name, ids in ordered_rules()])
    start = F.struct(F.replace(F.col("sequence"), F.lit("~"), F.lit("")).alias("rest"), F.lit("").alias("licences"))

    def step(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["rest"], rule["pattern"])
        return F.struct(
            F.when(hit, F.replace(acc["rest"], rule["pattern"], F.lit("*"))).otherwise(acc["rest"]).alias("rest"),
            F.when(hit & ~F.contains(F.concat(F.lit(","), acc["licences"]), F.concat(F.lit(","), rule["licence"], F.lit(","))), F.concat(acc["licences"], rule["licence"], F.lit(","))).otherwise(acc["licences"]).alias("licences"),
        )

    matched = F.when(F.col("n_known") > 0, F.aggregate(steps, start, step)).otherwise(start)
    return found.select("*", matched.alias("m")).select(
        "doc_id",
        "n_sentences",
        "n_known",
        "sequence",
        F.rtrim(F.col("m.licences"), F.lit(",")).alias("licences"),
        (F.length("m.rest") - F.length(F.replace(F.col("m.rest"), F.lit("<"), F.lit("")))).cast("long").alias("n_left_over"),
    )


def oracle() -> str:
    """The same in DuckDB's SQL, the rules as a fold over a list."""
    sentences, lines = known_sentences()
    q = lambda s: "'" + s.replace("'", "''") + "'"
    entries = ", ".join(f"{q(s)}: {q(i)}" for s, i in sentences.items())
    norm = lambda x: f"trim(regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'))"
    fold = "s"
    for pattern, put in FOLDS:
        fold = f"regexp_replace({fold}, {q(pattern)}, {q(put)})"
    some = " OR ".join(f"contains(s, {q(m)})" for m in MARKS)
    each = f"""SELECT doc_id, list_transform(string_split_regex(coalesce(text, ''), '\\r\\n|\\n|\\r'), lambda x: {{'raw': x, 'n': {norm("x")}}}) AS lines FROM documents"""
    each = f"""SELECT doc_id, string_split_regex(array_to_string(list_transform(lines, lambda x: CASE WHEN x.n = '' THEN chr(10) WHEN x.n IN ({", ".join(map(q, lines))}) THEN chr(10) || x.raw || chr(10)
  WHEN ends_with(rtrim(x.raw), ':') THEN x.raw || chr(10) ELSE x.raw END), ' '), {q(BORDER)}) AS raw FROM ({each})"""
    each = f"""SELECT doc_id, list_filter(list_transform(raw, lambda s: {norm(f"regexp_replace(s, {q(NUMBER)}, '')")}), lambda s: s <> '' AND NOT regexp_matches(s, {q(COUNTER)})) AS norm FROM ({each})"""
    each = f"""SELECT doc_id, norm, list_transform(norm, lambda s: CASE WHEN {some} THEN {fold} ELSE s END) AS folded FROM ({each})"""
    each = f"""SELECT doc_id, norm, list_transform(folded, lambda s: known[s]) AS ids FROM ({each}), (SELECT MAP {{{entries}}} AS known)"""
    each = f"""SELECT doc_id, CAST(len(norm) AS BIGINT) AS n_sentences, CAST(len(list_filter(ids, lambda i: i IS NOT NULL)) AS BIGINT) AS n_known,
  regexp_replace(regexp_replace(coalesce(array_to_string(list_transform(ids, lambda i: coalesce('<' || i || '>', '~')), ''), ''), '~{{{GAP + 1},}}', '=', 'g'), '~+', '~', 'g') AS sequence FROM ({each})"""
    rules = ", ".join(f"{{'licences': {q(n)}, 'rest': {q(_pattern(ids))}}}" for n, ids in ordered_rules())
    matched = f"""list_reduce([{{'licences': '', 'rest': replace(sequence, '~', '')}}] || [{rules}], lambda acc, r: {{
  'licences': CASE WHEN contains(acc.rest, r.rest) AND NOT contains(',' || acc.licences, ',' || r.licences || ',') THEN acc.licences || r.licences || ',' ELSE acc.licences END,
  'rest': CASE WHEN contains(acc.rest, r.rest) THEN replace(acc.rest, r.rest, '*') ELSE acc.rest END}})"""
    each = f"SELECT *, CASE WHEN n_known > 0 THEN {matched} ELSE {{'licences': '', 'rest': replace(sequence, '~', '')}} END AS m FROM ({each})"
    return f"SELECT doc_id, n_sentences, n_known, sequence, rtrim(m.licences, ',') AS licences, CAST(length(m.rest) - length(replace(m.rest, '<', '')) AS BIGINT) AS n_left_over FROM ({each})"
