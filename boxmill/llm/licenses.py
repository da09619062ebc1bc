"""Operator 9, licence scans by sentence-rule recognition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, let, others, text_or_empty

#: Sentences of the public licence texts and notices and their identifiers.
SENTENCES = {
    # Apache License 2.0 and its notice
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License": "apache-2",
    "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/": "apache-2",
    "You may not use this file except in compliance with the License": "apache-2-use",
    "You may obtain a copy of the License at": "licence-at",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied": "apache-2-basis",
    "See the License for the specific language governing permissions and limitations under the License": "apache-2-see",
    # MIT
    "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit-grant",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions": "mit-grant",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software": "mit-notice",
    "The software is provided as is, without warranty of any kind": "as-is",
    "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement": "as-is",
    "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    # ISC and 0BSD
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-as-is",
    # Unlicense
    "This is free and unencumbered software released into the public domain": "unlicense-free",
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means": "unlicense-anyone",
    # Boost
    "Boost Software License - Version 1.0 - August 17th, 2003": "bsl-1",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following": "bsl-1-grant",
    # GNU licences
    "GNU General Public License Version 3, 29 June 2007": "gpl-3",
    "GNU General Public License Version 2, June 1991": "gpl-2",
    "GNU Lesser General Public License Version 3, 29 June 2007": "lgpl-3",
    "GNU Lesser General Public License Version 2.1, February 1999": "lgpl-2-1",
    "GNU Affero General Public License Version 3, 19 November 2007": "agpl-3",
    "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed": "gnu-verbatim",
    "This program is free software": "free-software",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version": "gpl-3",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version": "gpl-2",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version": "agpl-3",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version": "lgpl-2-1",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE": "gnu-hope",
    "See the GNU General Public License for more details": "gnu-see",
    # Creative Commons and the public domain
    "Dedicated to the public domain": "public-domain",
    "This work has been dedicated to the public domain": "public-domain",
    # BSD
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd-grant",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd-grant",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "as-is",
    # Mozilla and Eclipse
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0": "mpl-2",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v": "mpl-2",
    "The accompanying program is provided under the terms of this Eclipse Public License (Agreement)": "epl",
    "All rights reserved": "all-rights",
}
#: Identifier, licence, its identifiers after SPDX-License-Identifier, its names.
NAMES = (
    ("mit", "MIT", ("MIT",), ("MIT License", "Expat License")),
    ("apache-2", "Apache-2.0", ("Apache-2.0",), ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License", "Apache Software License 2.0")),
    ("gpl-2", "GPL-2.0", ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"), ("GNU General Public License version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2")),
    ("gpl-3", "GPL-3.0", ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"), ("GNU General Public License version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3")),
    ("lgpl-2-1", "LGPL-2.1", ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"), ("GNU Lesser General Public License version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1")),
    ("lgpl-3", "LGPL-3.0", ("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"), ("GNU Lesser General Public License version 3", "GNU Lesser General Public License v3.0", "LGPLv3")),
    ("agpl-3", "AGPL-3.0", ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"), ("GNU Affero General Public License version 3", "GNU Affero General Public License v3.0", "AGPLv3")),
    ("bsd", "BSD", (), ("BSD License",)),
    ("bsd-2", "BSD-2-Clause", ("BSD-2-Clause",), ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License")),
    ("bsd-3", "BSD-3-Clause", ("BSD-3-Clause",), ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License")),
    ("0bsd", "0BSD", ("0BSD",), ("Zero-Clause BSD License", "BSD Zero Clause License")),
    ("isc", "ISC", ("ISC",), ("ISC License",)),
    ("zlib", "Zlib", ("Zlib",), ("zlib License",)),
    ("unlicense", "Unlicense", ("Unlicense",), ("Unlicense", "The Unlicense")),
    ("bsl-1", "BSL-1.0", ("BSL-1.0",), ("Boost Software License, Version 1.0", "Boost Software License 1.0")),
    ("mpl-2", "MPL-2.0", ("MPL-2.0",), ("Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0", "Mozilla Public License 2.0")),
    ("epl-2", "EPL-2.0", ("EPL-2.0",), ("Eclipse Public License - v 2.0", "Eclipse Public License v2.0", "Eclipse Public License 2.0", "Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/")),
    ("artistic-2", "Artistic-2.0", ("Artistic-2.0",), ("Artistic License 2.0",)),
    ("eupl-1-2", "EUPL-1.2", ("EUPL-1.2",), ("European Union Public Licence v1.2", "European Union Public Licence 1.2", "EUPL v1.2")),
    ("public-domain", "CC0-1.0", ("CC0-1.0",), ("CC0", "CC0 1.0", "CC0 1.0 Universal", "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication", "Creative Commons Zero v1.0 Universal")),
)
#: Codes and names of the Creative Commons licences, their versions, and the forms of a name.
CC_KINDS = (
    ("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"), ("by-nd", "Attribution-NoDerivatives"),
    ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"),
)
CC_VERSIONS = (("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International"))
CC_FORMS = (
    "cc {code} {version}", "cc {code} {version} license", "cc {code} {version} {area}", "creative commons {name} {version}", "creative commons {name} {version} license", "creative commons {name} {version} {area}",
    "creative commons {name} {version} {area} license", "creative commons {name} {version} {area} cc {code} {version}", "creative commons {name} {version} {area} license cc {code} {version}", "creative commons {name} {area} {version} license",
)
#: Ordered rules (licence, sentence identifiers in their order); gaps are allowed, the first match of a rule counts. A rule for each name follows.
RULES = (
    ("Apache-2.0", ("apache-2", "apache-2-use", "licence-at")), ("Apache-2.0", ("apache-2", "licence-at", "apache-2-basis", "apache-2-see")), ("Apache-2.0", ("apache-2",)),
    ("MIT", ("mit", "mit-grant", "as-is")), ("MIT", ("mit-grant", "mit-notice", "as-is")), ("MIT", ("mit-grant", "as-is")),
    ("ISC", ("isc-grant",)), ("0BSD", ("0bsd-grant", "isc-as-is")), ("Unlicense", ("unlicense-free",)), ("BSL-1.0", ("bsl-1-grant",)), ("GPL-3.0", ("free-software", "gpl-3")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-endorse")), ("BSD", ("bsd-grant", "as-is")),
    *[(licence, (i,)) for i, licence, _, _ in NAMES],
    *[(f"CC-{code.upper()}-{v}", (f"cc-{code}-{v.removesuffix('.0').replace('.', '-')}",)) for code, _ in CC_KINDS for v, _ in CC_VERSIONS],
    ("EPL", ("epl",)), ("proprietary", ("all-rights",)),
)
#: What may stand before a licence's name, instead of SPDX-License-Identifier, and behind the name, all in normal form.
LEAD = (
    r"^((this|these|the|all) ([a-z]+ ){1,5}(is|are) )?((dual )?licensed|released|distributed|published|provided|shared|available|made available) under (the )?(terms of )?(conditions of )?(the |a |an )?"
)
SPDX = r"^(spdx )?licen[cs]e (identifier )?"
TAIL = r" see (the )?(licen[cs]e )+(md |txt )*(file )?for (the |full |more |license )*(details|information|text)$"
#: Sentences beyond which a scan refuses its table: their hashes go to each task.
MAX_SENTENCES = 100_000
#: Ends of sentences that may run over lines: a mark with white space behind, or a line without letters and digits.
END = r"[.!?]+[\x20\x09-\x0D]+|\r?\n[^A-Za-z0-9\n]*\n"
LINE_END = r"[\x0A\x0D]+"


def normal_sentence(s: Column) -> Column:
    """A-Z lowered, all that isn't a letter or digit of ASCII to one space, trimmed; without what may stand around a licence's name."""
    plain = F.trim(F.regexp_replace(ascii_lower(s), r"[^a-z0-9]+", " "))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, TAIL, ""), LEAD, ""), SPDX, "spdx ")


def known_sentences(spark: SparkSession) -> DataFrame:
    """(sentence, id): the public sentences, the names after SPDX and in notices, and those of Creative Commons."""
    rows = list(SENTENCES.items())
    rows += [(name, i) for i, _, _, names in NAMES for name in names]
    rows += [(f"SPDX-License-Identifier: {spdx}", i) for i, _, all_spdx, _ in NAMES for spdx in all_spdx]
    for code, name in CC_KINDS:
        for version, area in CC_VERSIONS:
            i = f"cc-{code}-{version.removesuffix('.0').replace('.', '-')}"
            rows += [(form.format(code=code, name=name, version=version, area=area), i) for form in (*CC_FORMS, "spdx license identifier cc {code} {version}", "https creativecommons org licenses {code} {version}")]
    return spark.createDataFrame(rows, "sentence string, id string")


def scan_licenses(docs: DataFrame, *, sentences: DataFrame | dict[str, str] | None = None, rules: tuple = RULES, text: str = "text", to: str = "licence") -> DataFrame:
    """docs with one struct column `to`: sentence_ids, licences, licence.

    `sentences` are rows (sentence, id), the public ones if none are given; they
    are brought to normal form like the texts, and of several ids of a sentence
    the least counts. More than MAX_SENTENCES are refused.
    Every text is split into sentences, whole and of any length; a sentence may
    be wrapped over lines, with the marks of a comment before each. Where it is
    not known so, each of its lines is looked up. Sentences are looked up by hash
    where the text is, then compared in full. The known ones, in text order,
    give sentence_ids. A rule matches if its identifiers are a subsequence of
    them; licences lists the licences of all matching rules in rule order, each
    once, and licence is the first, else null.

    Null, empty or unknown text: no identifiers. Repeated sentences are repeated
    identifiers, and repeated rows have equal results. Empty tables, of texts or
    of sentences, give an empty result or no identifiers. Other columns pass
    through; `to` replaces one of its name.
    """
    spark = docs.sparkSession
    table = known_sentences(spark) if sentences is None else sentences
    if isinstance(table, dict):
        table = spark.createDataFrame(list(table.items()), "sentence string, id string")
    table = table.where("sentence is not null and id is not null").groupBy(normal_sentence(F.col("sentence")).alias("s")).agg(F.min("id").alias("id")).where("s <> ''")
    known = table.select("s", "id", F.xxhash64("s").alias("h")).limit(MAX_SENTENCES + 1).collect()
    if len(known) > MAX_SENTENCES:
        raise ValueError(f"more than {MAX_SENTENCES} sentences")
    hashes, t = [r["h"] for r in known], text_or_empty(F.col(f"`{text}`"))
    ids_by_sentence = F.create_map(*[F.lit(x) for r in known for x in (r["s"], r["id"])]).cast("map<string,string>")

    def ids_of(parts: Column) -> Column:
        hit = F.filter(F.transform(parts, normal_sentence), lambda s: F.xxhash64(s).isin(hashes))
        return F.array_compact(F.transform(hit, lambda s: F.element_at(ids_by_sentence, s)))

    def found(s: Column) -> Column:
        whole = ids_of(F.array(s))
        return let(whole, lambda w: F.when((F.size(w) > 0) | ~F.contains(s, F.lit("\n")), w).otherwise(ids_of(F.split(s, LINE_END, -1))))

    ids = F.flatten(F.transform(F.split(t, END, -1), found))
    none = F.array().cast("array<string>")
    ordered = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*[F.lit(x) for x in wanted]).alias("wanted")) for name, wanted in rules])

    def matches(seq: Column, wanted: Column) -> Column:
        steps = F.aggregate(seq, F.lit(0), lambda n, s: F.when(F.get(wanted, n) == s, n + 1).otherwise(n))
        return steps == F.size(wanted)

    def struct(seq: Column) -> Column:
        hits = F.array_distinct(F.transform(F.filter(ordered, lambda r: matches(seq, r["wanted"])), lambda r: r["name"]))
        return let(F.when(F.size(seq) > 0, hits).otherwise(none), lambda h: F.struct(seq.alias("sentence_ids"), h.alias("licences"), F.when(F.size(h) > 0, h[0]).alias("licence")))

    return docs.select(*[F.col(f"`{c}`") for c in others(docs, to)], let(ids, struct).alias(to))
