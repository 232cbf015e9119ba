"""Licence scans by sentence rules.

A text is cut into sentences; each is normalised (lower case, everything but letters and digits to one space) and looked
up among known licence sentences. The text becomes a sequence of sentence identifiers, in which the ordered licence rules
are matched, leftmost first and, at one place, the first rule that fits. All of it is DataFrame functions: two passes of
regular expressions over the texts that hold a cue word, a map look-up, and one alternation over the short sequence.

Defined results: null and empty texts, and texts without a known sentence, have no licences (empty strings, 0); texts of
any length are scanned whole; of rules that fit at one place the first listed counts, and what it takes is not matched
again; repeated rows are scanned each; a null doc_id is passed on; an empty table gives an empty result; columns other than
the two named are not read, so their names cannot clash.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.llm.shared import id_of, text_of

# Known licence sentences, normalised, by identifier (two letters, one digit).
SENTENCES = {
    "MI0": "mit license",
    "MI1": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "MI2": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "MI3": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "MI4": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "MI5": "released under the mit license",
    "MI6": "licensed under the mit license",
    "MI7": "this project is licensed under the mit license",
    "AP1": "licensed under the apache license version 2 0",
    "AP2": "licensed under the apache license version 2 0 the license",
    "AP3": "you may not use this file except in compliance with the license",
    "AP4": "you may obtain a copy of the license at",
    "AP5": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "AP6": "see the license for the specific language governing permissions and limitations under the license",
    "GP1": "this work is licensed under the gnu general public license version 3",
    "GP2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "GP3": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "GP4": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "GP5": "see the gnu general public license for more details",
    "GP6": "you should have received a copy of the gnu general public license along with this program",
    "LG1": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "BS1": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "BS2": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "BS3": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "BS4": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "IS1": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "MP1": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "CC1": "licensed under cc by nc 4 0",
    "CC2": "this work is licensed under a creative commons attribution 4 0 international license",
    "CC3": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "CC4": "licensed under cc by 4 0",
    "UN1": "this is free and unencumbered software released into the public domain",
    "AR1": "all rights reserved",
    "AP7": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "AP8": "this project is licensed under the apache license 2 0",
    "AP9": "released under the apache license version 2 0",
    "GP7": "if not see https www gnu org licenses",
    "GP8": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3 of the license",
    "GP9": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "GQ1": "this project is licensed under the gnu general public license v3 0",
    "GQ2": "licensed under the gpl v3",
    "GQ3": "licensed under the gpl v2",
    "LG2": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "LG3": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "LG4": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "AG1": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "AG2": "licensed under the gnu affero general public license version 3",
    "BS5": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "BS6": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "BS7": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "BS8": "licensed under the bsd 3 clause license",
    "BS9": "licensed under the bsd 2 clause license",
    "IS2": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "ZE1": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "ZL1": "this software is provided as is without any express or implied warranty",
    "ZL2": "in no event will the authors be held liable for any damages arising from the use of this software",
    "ZL3": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "BO1": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "BO2": "distributed under the boost software license version 1 0",
    "EP1": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "EP2": "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at https www eclipse org legal epl 2 0",
    "CC5": "licensed under cc by sa 4 0",
    "CC6": "licensed under cc by nc sa 4 0",
    "CC7": "licensed under cc by nd 4 0",
    "CC8": "licensed under cc by nc nd 4 0",
    "CC9": "licensed under cc0 1 0",
    "CD1": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "CD2": "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    "CD3": "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    "CD4": "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license",
    "CD5": "this work is licensed under the creative commons attribution 4 0 international license",
    "CD6": "this work is licensed under a creative commons attribution 3 0 unported license",
    "CD7": "this work is licensed under a creative commons attribution sharealike 3 0 unported license",
    "CD8": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "CD9": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "WT1": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "WT2": "do what the fuck you want to public license terms and conditions for copying distribution and modification",
    "OF1": "this font software is licensed under the sil open font license version 1 1",
    "OD1": "this database is made available under the open database license",
    "EU1": "licensed under the eupl version 1 2",
    "SP0": "spdx license identifier",
}
# Names that may follow "SPDX-License-Identifier:".
SPDX = (
    "MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "ISC", "0BSD", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib", "Unlicense", "CC0-1.0", "CC-BY-4.0",
    "CC-BY-SA-4.0", "CC-BY-NC-4.0", "WTFPL", "OFL-1.1", "ODbL-1.0", "EUPL-1.2", "Artistic-2.0", "CDDL-1.0", "PostgreSQL", "Python-2.0", "Ruby", "Vim", "X11", "NCSA", "MS-PL", "AFL-3.0",
)
SENTENCES |= {f"S{'ABCD'[k // 10]}{k % 10}": re.sub("[^a-z0-9]+", " ", name.lower()) for k, name in enumerate(SPDX)}
#: Ordered rules: of those that fit at one place the first counts, so longer ones stand before their beginnings.
RULES = (
    ("MIT", ("MI0", "MI1", "MI2", "MI3", "MI4")),
    ("MIT", ("MI1", "MI2", "MI3", "MI4")),
    ("MIT", ("MI1", "MI2")),
    ("MIT", ("MI5",)),
    ("MIT", ("MI6",)),
    ("MIT", ("MI7",)),
    ("Apache-2.0", ("AP2", "AP3", "AP4", "AP5", "AP6")),
    ("Apache-2.0", ("AP2", "AP3")),
    ("Apache-2.0", ("AP1", "AP3")),
    ("Apache-2.0", ("AP1",)),
    ("Apache-2.0", ("AP2",)),
    ("GPL-3.0-or-later", ("GP2", "GP4", "GP5", "GP6")),
    ("GPL-3.0-or-later", ("GP2", "GP4")),
    ("GPL-3.0-or-later", ("GP2",)),
    ("GPL-2.0-or-later", ("GP3", "GP4")),
    ("GPL-2.0-or-later", ("GP3",)),
    ("GPL-3.0", ("GP1",)),
    ("LGPL-2.1-or-later", ("LG1",)),
    ("BSD-4-Clause", ("BS1", "BS2", "BS3", "BS7")),
    ("BSD-3-Clause", ("BS1", "BS2", "BS3", "BS4", "BS5", "BS6")),
    ("BSD-3-Clause", ("BS1", "BS2", "BS3", "BS4")),
    ("BSD-2-Clause", ("BS1", "BS2", "BS3", "BS5", "BS6")),
    ("BSD-2-Clause", ("BS1", "BS2", "BS3")),
    ("ISC", ("IS1",)),
    ("MPL-2.0", ("MP1",)),
    ("CC-BY-NC-4.0", ("CC1",)),
    ("CC-BY-4.0", ("CC2",)),
    ("CC-BY-SA-4.0", ("CC3",)),
    ("CC-BY-4.0", ("CC4",)),
    ("Unlicense", ("UN1",)),
    ("All-rights-reserved", ("AR1",)),
    ("Apache-2.0", ("AP7",)),
    ("Apache-2.0", ("AP8",)),
    ("Apache-2.0", ("AP9",)),
    ("GPL-3.0", ("GP8", "GP4")),
    ("GPL-3.0", ("GP8",)),
    ("GPL-2.0", ("GP9", "GP4")),
    ("GPL-2.0", ("GP9",)),
    ("GPL-3.0", ("GQ1",)),
    ("GPL-3.0", ("GQ2",)),
    ("GPL-2.0", ("GQ3",)),
    ("LGPL-3.0-or-later", ("LG2", "LG4")),
    ("LGPL-3.0-or-later", ("LG2",)),
    ("LGPL-3.0-or-later", ("LG3",)),
    ("AGPL-3.0-or-later", ("AG1", "GP4")),
    ("AGPL-3.0-or-later", ("AG1",)),
    ("AGPL-3.0", ("AG2",)),
    ("BSD-3-Clause", ("BS8",)),
    ("BSD-2-Clause", ("BS9",)),
    ("0BSD", ("ZE1", "IS2")),
    ("Zlib", ("ZL1", "ZL2", "ZL3")),
    ("Zlib", ("ZL3",)),
    ("BSL-1.0", ("BO1",)),
    ("BSL-1.0", ("BO2",)),
    ("EPL-2.0", ("EP1",)),
    ("EPL-2.0", ("EP2",)),
    ("CC-BY-SA-4.0", ("CC5",)),
    ("CC-BY-NC-SA-4.0", ("CC6",)),
    ("CC-BY-ND-4.0", ("CC7",)),
    ("CC-BY-NC-ND-4.0", ("CC8",)),
    ("CC0-1.0", ("CC9",)),
    ("CC-BY-NC-4.0", ("CD1",)),
    ("CC-BY-NC-SA-4.0", ("CD2",)),
    ("CC-BY-ND-4.0", ("CD3",)),
    ("CC-BY-NC-ND-4.0", ("CD4",)),
    ("CC-BY-4.0", ("CD5",)),
    ("CC-BY-3.0", ("CD6",)),
    ("CC-BY-SA-3.0", ("CD7",)),
    ("CC0-1.0", ("CD8",)),
    ("CC0-1.0", ("CD9",)),
    ("WTFPL", ("WT1",)),
    ("WTFPL", ("WT2",)),
    ("OFL-1.1", ("OF1",)),
    ("ODbL-1.0", ("OD1",)),
    ("EUPL-1.2", ("EU1",)),
    *((name, ("SP0", f"S{'ABCD'[k // 10]}{k % 10}")) for k, name in enumerate(SPDX)),
)
#: Every rule has a sentence that holds one of these within a word, where normalising changes no character but capitals: a text without any fits no rule.
CUES = ("licen", "permi", "redistribut", "software", "reserved", "copyright", "gnu", "warrant")
BREAK = "\u0001"
#: Replacements that mark where sentences end; groups keep what stays.
BREAKS = (
    (r"((?i:spdx-license-identifier):[ \t]+[A-Za-z0-9.+-]+)", "$1", r"\1"),
    (r"\n[ \t]*\n", "", ""),
    (r"([^\p{L}\p{N},( \t\n-])[ \t]*\n", "$1", r"\1"),
    (r"([.!?:;])[ \t\n]", "$1", r"\1"),
)
#: Marks within sentences of standard notices, which must not end them: taken out before the text is cut. Groups stay.
INNER = (
    r"(?i)(free[ \t\n]+software)[:;]([ \t\n]+you[ \t\n]+can[ \t\n])",
    r"(?i)(any[ \t\n]+warranty);([ \t\n]+without[ \t\n]+even[ \t\n])",
    r"(?i)(software[ \t\n]+foundation);([ \t\n]+either[ \t\n]+version[ \t\n])",
    r"(?i)(license,?[ \t\n]+v)\.([ \t\n]+[0-9])",
)
#: What is left of a sentence that is only the label of a list item, and such a label in front of one.
LABEL, LABELLED = "^(?:[0-9 ]*|[a-z]|[ivx]{1,4})$", "^(?:[0-9]{1,3}|[a-z]|[ivx]{1,4}) "
SEQUENCE = "|".join("".join(f"{s};" for s in rule) for _, rule in RULES)


def sentence_ids(text: Column) -> Column:
    """The sequence of the text's sentences as "id;" each, "-;" for sentences that are not known; labels of list items are no sentences."""
    cut = text
    for pattern in INNER:
        cut = F.regexp_replace(cut, pattern, "$1$2")
    for pattern, kept, _ in BREAKS:
        cut = F.regexp_replace(cut, pattern, f"{kept}{BREAK}")
    known = F.create_map(*(F.lit(x) for i, s in SENTENCES.items() for x in (s, i)))
    plain = lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))
    told = F.filter(F.transform(F.split(cut, BREAK, -1), plain), lambda s: ~F.regexp_like(s, F.lit(LABEL)))
    bare = lambda s: F.regexp_replace(s, LABELLED, "")
    return F.array_join(F.transform(told, lambda s: F.concat(F.coalesce(F.try_element_at(known, bare(s)), F.lit("-")), F.lit(";"))), "")


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, licences (distinct, in order of their first place, comma-joined), sentence_ids (known ones in order), n_matches."""
    body = text_of(text)
    lowered = F.lower(body)
    cue = F.lit(False)
    for word in CUES:
        cue = cue | F.contains(lowered, F.lit(word))
    names = F.create_map(*(F.lit(x) for name, rule in RULES for x in ("".join(f"{s};" for s in rule), name)))
    found = docs.select(id_of(doc_id).alias("doc_id"), F.when(cue, sentence_ids(body)).otherwise("").alias("ids"))
    matched = found.withColumn("matches", F.transform(F.regexp_extract_all("ids", F.lit(SEQUENCE), F.lit(0)), lambda m: F.element_at(names, m)))
    return matched.select("doc_id", F.array_join(F.array_distinct("matches"), ",").alias("licences"), F.array_join(F.regexp_extract_all("ids", F.lit("[A-Z]{2}[0-9]"), F.lit(0)), ",").alias("sentence_ids"), F.size("matches").cast("long").alias("n_matches"))


def oracle() -> str:
    """The same results in DuckDB's SQL."""
    cut = "coalesce(text, '')"
    for pattern in INNER:
        cut = f"regexp_replace({cut}, '{pattern}', '\\1\\2', 'g')"
    for pattern, _, kept in BREAKS:
        cut = f"regexp_replace({cut}, '{pattern}', '{kept}' || chr(1), 'g')"
    values = ", ".join(f"('{s}', '{i}')" for i, s in SENTENCES.items())
    cues = "(" + " OR ".join(f"contains(lower(d.text), '{c}')" for c in CUES) + ")"
    rules = ", ".join(f"('{''.join(f'{s};' for s in rule)}', '{name}')" for name, rule in RULES)
    return f"""
        WITH known(s, id) AS (VALUES {values}), rules(seq, name) AS (VALUES {rules}),
        d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split({cut}, chr(1)) AS parts FROM documents),
        p AS (SELECT r, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM d),
        t AS (SELECT r, k, trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g')) AS plain FROM p),
        i AS (SELECT r, k, regexp_replace(plain, '{LABELLED}', '') AS bare FROM t WHERE NOT regexp_matches(plain, '{LABEL}')),
        q AS (SELECT r, string_agg(coalesce(id, '-') || ';', '' ORDER BY k) AS ids FROM i LEFT JOIN known ON s = bare GROUP BY r),
        m AS (SELECT r, regexp_extract_all(ids, '{SEQUENCE}') AS seqs FROM q),
        u AS (SELECT r, unnest(seqs) AS seq, generate_subscripts(seqs, 1) AS k FROM m),
        f AS (SELECT r, name, min(k) AS k, count(*) AS n FROM u JOIN rules USING (seq) GROUP BY r, name),
        l AS (SELECT r, string_agg(name, ',' ORDER BY k) AS licences, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY r)
        SELECT d.doc_id, coalesce(l.licences, '') AS licences, CASE WHEN {cues} THEN coalesce(array_to_string(regexp_extract_all(q.ids, '[A-Z]{{2}}[0-9]'), ','), '') ELSE '' END AS sentence_ids, coalesce(l.n, 0) AS n_matches
        FROM d LEFT JOIN q USING (r) LEFT JOIN l USING (r)"""
