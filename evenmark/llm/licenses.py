"""License scan with DataFrame functions only: TF-IDF cosine of statements to templates, then inheritance from directories."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Short forms of the notices that name each licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License",
    "CC-BY-4.0": "Licensed under CC BY 4.0, the Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "This source code form is subject to the terms of the Mozilla Public License, version 2.0",
    "Proprietary": "All rights reserved",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}
_AS_IS = "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed."
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_GNU = "it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_CC = "Creative Commons {0} 4.0 International Public License By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons {0} 4.0 International Public License (\"Public License\")."
_EPL = "Eclipse Public License - v {0} THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT."
#: Passages of published licence texts and standard headers, each from its opening words on: (licence, number of opening words, text).
BODIES = [
    ("0BSD", 8, f'{_ISC}. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE'),
    ("AGPL-3.0", 12, _GNU.format("Affero ", 3)),
    ("AGPL-3.0", 5, "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", 11, "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("Apache-2.0", 6, "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("Artistic-2.0", 4, "The Artistic License 2.0 Copyright (c) 2000-2006, The Perl Foundation. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("BSD-2-Clause", 11, f"{_BSD} {_AS_IS}"),
    ("BSD-3-Clause", 11, f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_AS_IS}"),
    ("BSD-4-Clause", 11, f"{_BSD} 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. 4. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSL-1.0", 11, 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    ("CC-BY-4.0", 5, _CC.format("Attribution")),
    ("CC-BY-NC-4.0", 5, _CC.format("Attribution-NonCommercial")),
    ("CC-BY-SA-4.0", 5, _CC.format("Attribution-ShareAlike")),
    ("CC0-1.0", 8, 'The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all, an "owner") of an original work of authorship and/or a database (each, a "Work").'),
    ("EPL-1.0", 6, _EPL.format("1.0")),
    ("EPL-2.0", 6, _EPL.format("2.0")),
    ("EPL-2.0", 9, "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EUPL-1.2", 6, "This European Union Public Licence (the 'EUPL') applies to the Work (as defined below) which is provided under the terms of this Licence. Any use of the Work, other than as authorised under this Licence is prohibited"),
    ("GPL-2.0", 11, _GNU.format("", 2)),
    ("GPL-2.0", 8, "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", 11, _GNU.format("", 3)),
    ("GPL-3.0", 7, "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", 8, f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", 12, _GNU.format("Lesser ", 2.1)),
    ("LGPL-2.1", 7, "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", 12, _GNU.format("Lesser ", 3)),
    ("LGPL-3.0", 7, "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", 14, f"""{_MIT}, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("MIT-0", 14, f'{_MIT}. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED'),
    ("MPL-2.0", 11, "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", 5, 'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.'),
    ("MS-PL", 8, "This license governs use of the accompanying software. If you use the software, you accept this license. If you do not accept the license, do not use the software."),
    ("OFL-1.1", 6, "SIL OPEN FONT LICENSE Version 1.1 - 26 February 2007 PREAMBLE The goals of the Open Font License (OFL) are to stimulate worldwide development of collaborative font projects, to support the font creation efforts of academic and linguistic communities, and to provide a free and open framework in which fonts may be shared and improved in partnership with others."),
    ("PSF-2.0", 8, 'This LICENSE AGREEMENT is between the Python Software Foundation ("PSF"), and the Individual or Organization ("Licensee") accessing and otherwise using this software ("Python") in source or binary form and its associated documentation.'),
    ("PostgreSQL", 8, "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."),
    ("Unlicense", 11, "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", 9, "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
]
#: One of these stands in each text of BODIES, near its opening; only files that hold one are read for them.
OPENERS = ("accompanying", "apache", "artistic", "compile", "compliance", "creative", "documentation", "eclipse", "european", "gnu", "granted", "jurisdictions", "mozilla", "open font", "python", "redistribution", "warranty")
#: A file's own word for its licence: identifiers, joined by AND, OR and WITH, with brackets.
SPDX = r"(?i:spdx-license-identifier):[ \t]*(\(*[A-Za-z0-9.+\-]+\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[A-Za-z0-9.+\-]+\)*)*)"
#: Identifiers of the SPDX list that are in common use; `identifiers` of scan_licenses takes another list.
IDENTIFIERS = """0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 Autoconf-exception-3.0 BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent
BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1
Classpath-exception-2.0 ECL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GCC-exception-3.1 GFDL-1.3 GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0+ GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0+ GPL-3.0-only
GPL-3.0-or-later HPND ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1+ LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later Linux-syscall-note LLVM-exception MIT MIT-0 MPL-1.1 MPL-2.0
MS-PL MS-RL MulanPSL-2.0 NCSA NONE OFL-1.1 OpenSSL OSL-3.0 PostgreSQL PSF-2.0 Python-2.0 Ruby SSPL-1.0 Unicode-3.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1""".split()
#: Short names that headers give a licence, in terms as `_short` leaves them. BSD and GPL stand for headers without a number.
NAMES = {
    "AGPL-3.0": ["agpl 3", "gnu affero general public 3"],
    "Apache-2.0": ["apache 2", "apache"],
    "Artistic-2.0": ["artistic 2"],
    "BSD": ["bsd"],
    "BSD-2-Clause": ["bsd 2", "simplified bsd"],
    "BSD-3-Clause": ["bsd 3", "new bsd", "modified bsd"],
    "BSL-1.0": ["boost 1", "boost"],
    "CC0-1.0": ["cc0 1", "cc0"],
    "EPL-1.0": ["epl 1", "eclipse public 1"],
    "EPL-2.0": ["epl 2", "eclipse public 2"],
    "GPL": ["gpl", "gnu general public"],
    "GPL-2.0": ["gpl 2", "gnu general public 2"],
    "GPL-3.0": ["gpl 3", "gnu general public 3"],
    "ISC": ["isc"],
    "LGPL-2.1": ["lgpl 2.1", "gnu lesser general public 2.1"],
    "LGPL-3.0": ["lgpl 3", "gnu lesser general public 3"],
    "MIT": ["mit", "mit x11", "expat"],
    "MPL-2.0": ["mpl 2", "mozilla public 2"],
    "Unlicense": ["unlicense"],
    "WTFPL": ["wtfpl"],
    "Zlib": ["zlib"],
}
#: Words of headers that say nothing about which licence it is.
FILLERS = """a an and at available be can clause code copying details distributed file files for found full in is it its library licence licence.md licence.txt licenced license license.md license.txt licensed
licenses more of on package please program project provided published refer released repository see software source terms text the these this to under use used version which with work""".split()
#: What a file without any other licence says.
RIGHTS = "Proprietary"
#: A statement holds one of these words, as each template does.
ANCHORS = r"(?i)licen[sc]|copyright|\brights\b|public domain|\bspdx\b"


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9.\-]+|[.\-]+(?![a-z0-9])"), lambda x: x != "")


def statements(text: Column) -> Column:
    """The sentences and lines of a text, tags taken as line ends, that hold a licence word."""
    plain = F.regexp_replace(text, r"<[^>]*>", "\n")
    found = F.filter(F.split(plain, r"\s*\n\s*|(?<=[.!?])\s+"), lambda x: x.rlike(ANCHORS))
    low = F.lower(text)  # plain searches spare most texts the patterns
    some = low.contains("licen") | low.contains("copyright") | low.contains("rights") | low.contains("public domain") | low.contains("spdx")
    return F.when(some, found)


def _dot(terms: Column, part: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + F.coalesce(part[x], F.lit(0.0)))


def _best(unit: Column, idf: dict[str, float], unknown: float, templates: dict[str, list[str]]) -> Column:
    """The best (score, license) of a statement: its TF-IDF cosine with each template."""
    weight = F.create_map(*[F.lit(x) for pair in idf.items() for x in pair])
    terms = F.array_sort(_terms(unit))
    done = F.struct(F.lit("").alias("term"), F.lit(0.0).alias("run"), F.lit(0.0).alias("total"))
    value = lambda x: F.coalesce(weight[x], F.lit(unknown))
    close = lambda a: a["total"] + F.pow(a["run"] * value(a["term"]), F.lit(2.0))

    def step(a: Column, x: Column) -> Column:
        same = a["term"] == x
        return F.struct(x.alias("term"), F.when(same, a["run"] + 1.0).otherwise(1.0).alias("run"), F.when(same, a["total"]).otherwise(close(a)).alias("total"))

    norm = F.sqrt(F.aggregate(terms, done, step, close))
    scores = []
    for name, words in sorted(templates.items()):
        count = {w: words.count(w) for w in words}
        size = math.sqrt(sum((c * idf[w]) ** 2 for w, c in count.items()))
        part = F.create_map(*[F.lit(x) for w, c in count.items() for x in (w, c * idf[w] ** 2 / size)])
        scores.append(F.struct(F.least(F.lit(1.0), _dot(terms, part) / norm).alias("score"), F.lit(name).alias("license")))
    return F.array_max(F.array(*scores))


def _short(unit: Column) -> Column:
    """The distinct terms of a header that tell its licence: names and numbers apart, numbers without v and .0, no fillers."""
    apart = F.regexp_replace(F.lower(unit), r"\b(agpl|apache|artistic|bsd|cc0|epl|gpl|lgpl|mpl)[ \-]?(?:v\.?)?(?=[0-9])|\b([0-9])-(?=clause)", "$1$2 ")
    terms = F.transform(_terms(apart), lambda x: F.regexp_replace(x, r"^v?([0-9]+(?:\.[1-9][0-9]*)?)(?:\.0)?$", "$1"))
    return F.array_distinct(F.filter(terms, lambda x: ~x.isin(FILLERS)))


def _header(units: Column, least: float) -> Column:
    """The best (score, license) of the headers among statements: the TF-IDF cosine of what they say to a short name."""
    names = [(k, x.split()) for k, xs in sorted(NAMES.items()) for x in xs]
    n, held = len(names), [set(words) for _, words in names]
    idf = {w: math.log((n + 1) / (sum(w in x for x in held) + 1)) + 1 for x in held for w in sorted(x)}
    table = [{"license": k, "norm": math.sqrt(sum(idf[w] ** 2 for w in words)), "words": {w: idf[w] ** 2 for w in words}} for k, words in names]
    known = F.from_json(F.lit(json.dumps(table)), "array<struct<license: string, norm: double, words: map<string, double>>>")
    weight = F.create_map(*[F.lit(x) for w in sorted(idf) for x in (w, idf[w] ** 2)])
    unknown = F.lit((math.log(n + 1) + 1) ** 2)

    def best(terms: Column) -> Column:
        norm = F.sqrt(F.aggregate(terms, F.lit(0.0), lambda a, x: a + F.coalesce(weight[x], unknown)))
        found = F.transform(known, lambda k: F.struct(F.least(F.lit(1.0), _dot(terms, k["words"]) / norm / k["norm"]).alias("score"), k["license"].alias("license")))
        return F.when(F.arrays_overlap(terms, F.array(*map(F.lit, sorted(idf)))), F.array_max(found))

    return F.array_max(F.filter(F.transform(F.transform(units, _short), best), lambda x: x["score"] >= least))


def _anchors(terms: list[str], idf: dict[str, float], most: int = 8) -> list[dict]:
    """The terms that stand once in a text and in fewest others, each with how many terms stand before it."""
    once = sorted((w for w in set(terms) if terms.count(w) == 1), key=lambda w: (-idf[w], w))
    return [{"term": w, "at": terms.index(w)} for w in once[:most]]


def _bodies() -> tuple[str, str, float]:
    """BODIES as JSON, with the inverse document frequencies of their words among them, and the weight of other words."""
    terms = [list(dict.fromkeys(_python_terms(text))) for _, _, text in BODIES]
    n = len(terms)
    df = {w: sum(w in t for t in terms) for t in terms for w in t}
    idf = {w: math.log((n + 1) / (k + 1)) + 1 for w, k in df.items()}
    found = [
        {"license": name, "opening": f" {' '.join(_python_terms(text)[:opening])} ", "size": len(" ".join(_python_terms(text))), "norm": math.sqrt(sum(idf[w] ** 2 for w in t)), "words": {w: idf[w] ** 2 for w in t}, "length": len(_python_terms(text)), "anchors": _anchors(_python_terms(text), idf)}
        for (name, opening, text), t in zip(BODIES, terms, strict=True)
    ]
    return json.dumps(found), json.dumps({w: x**2 for w, x in idf.items()}), (math.log(n + 1) + 1) ** 2


def _body(text: Column, least: float) -> Column:
    """The best (score, license) of the licence texts that a text holds: the TF-IDF cosine of as many words as the licence text has, from where it may begin.

    That is where its opening words stand, and where each of its rare words puts the beginning, if half of those are there: so
    texts whose wording was changed, at the beginning too, are compared.
    """
    bodies, idf, unknown = _bodies()
    known = F.from_json(F.lit(bodies), "array<struct<license: string, opening: string, size: int, norm: double, words: map<string, double>, length: int, anchors: array<struct<term: string, at: int>>>>")
    weight = F.from_json(F.lit(idf), "map<string, double>")

    def cosine(body: Column, block: Column) -> Column:
        return F.aggregate(block, F.struct(F.lit(0.0).alias("dot"), F.lit(0.0).alias("all")), lambda a, x: F.struct((a["dot"] + F.coalesce(body["words"][x], F.lit(0.0))).alias("dot"), (a["all"] + F.coalesce(weight[x], F.lit(unknown))).alias("all")), lambda a: F.least(F.lit(1.0), a["dot"] / F.sqrt(a["all"]) / body["norm"]))

    def scores(body: Column) -> Column:
        opening = F.when(F.position(body["opening"], text) > 0, F.array_distinct(F.split(F.trim(F.substr(text, F.position(body["opening"], text) + 1, body["size"])), " ")))
        terms = F.split(F.trim(text), " ")
        seen = F.filter(body["anchors"], lambda a: F.contains(text, F.concat(F.lit(" "), a["term"], F.lit(" "))))
        begins = F.when(2 * F.size(seen) >= F.size(body["anchors"]), F.array_distinct(F.transform(seen, lambda a: F.greatest(F.lit(1), (F.array_position(terms, a["term"]) - a["at"]).cast("int")))))
        blocks = F.concat(F.array_compact(F.array(opening)), F.transform(F.coalesce(begins, F.array().cast("array<int>")), lambda k: F.array_distinct(F.slice(terms, k, body["length"]))))
        return F.transform(blocks, lambda block: F.struct(cosine(body, block).alias("score"), body["license"].alias("license")))

    return F.array_max(F.filter(F.flatten(F.transform(known, scores)), lambda x: x["score"] >= least))


def _flat(text: Column) -> Column:
    """The terms of a text with an opener on one line, so that line ends, marks and tags in a licence text do not count."""
    some = F.lit(False)
    for word in OPENERS:
        some = some | F.lower(text).contains(word)
    return F.when(some, F.concat(F.lit(" "), F.array_join(_terms(F.regexp_replace(text, r"<[^>]*>", "\n")), " "), F.lit(" ")))


def scan_licenses(files: DataFrame, id_col: str = "page_id", path_col: str = "url", text_col: str = "html", least: float = 0.6, body_least: float = 0.75, header_least: float = 0.75, templates: dict[str, str] | None = None, identifiers: list[str] | None = None) -> DataFrame:
    """(id, directory, license, score, inherited_from) for each file.

    A file's own licence is its SPDX expression, whole, if all its identifiers are known (score 1; `identifiers`, and any
    LicenseRef); else the text or standard header of a licence that it holds
    (BODIES) with a cosine of `body_least` or more; else the best statement of the whole text with a cosine of `least` or
    more (ties by name, the last wins); else the best header that gives a licence's short name (NAMES) with a cosine of
    `header_least` or more; a bare rights line only if nothing names a licence. A file without one has
    that of the nearest directory upwards in which some file has its own, the best by score, then name. Term weights come from the document frequency of the templates' terms among all statements; a term of no
    template weighs as one that no statement has. A path is a URL or a file path; queries and fragments do not count.
    Null texts have no own licence; a null path is in no directory and inherits nothing. Files with equal paths or ids
    stay rows of their own. Extra columns are left out.
    """
    words = {k: _python_terms(v) for k, v in (templates or TEMPLATES).items()}
    vocabulary = sorted({w for x in words.values() for w in x})
    allowed = F.array(*[F.lit(x.lower()) for x in (identifiers or IDENTIFIERS)])
    path = F.regexp_replace(F.regexp_replace(F.col(path_col), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://", ""), r"[?#].*$", "")
    identifier = F.regexp_extract(text_col, SPDX, 1)
    whole = F.regexp_replace(F.regexp_replace(identifier, r"[ \t]+", " "), r"^\(([^()]*)\)$", "$1")
    listed = F.forall(F.split(F.lower(F.regexp_replace(whole, r"[()]", "")), " (?:and|or|with) "), lambda x: F.array_contains(allowed, x) | x.startswith("licenseref-"))
    spdx = F.when(F.lower(text_col).contains("spdx-license-identifier:") & (identifier != "") & listed, F.struct(F.lit(1.0).alias("score"), whole.alias("license")))
    small = files.select(F.col(id_col).alias("id"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("directory"), F.coalesce(statements(F.col(text_col)), F.array().cast("array<string>")).alias("units"), F.transform(F.array(_flat(F.col(text_col))), lambda t: _body(t, body_least))[0].alias("body"), spdx.alias("spdx"))
    units = small.where(F.size("units") > 0).select(F.explode("units").alias("unit"))
    known = F.array(*map(F.lit, vocabulary))
    counts = units.select(F.explode(F.concat(F.array_intersect(_terms(F.col("unit")), known), F.array(F.lit("")))).alias("term")).groupBy("term").count()
    df = {r["term"]: r["count"] for r in counts.collect()}  # at most one row for each term of the templates
    n = df.get("", 0)
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 for w in vocabulary}
    found = F.filter(F.transform("units", lambda u: _best(u, idf, math.log(n + 1) + 1, words)), lambda x: x["score"] >= least)
    named = F.array_max(F.filter("found", lambda x: x["license"] != RIGHTS))
    scored = small.withColumn("found", found).withColumn("own", F.coalesce("spdx", "body", named, _header(F.col("units"), header_least), F.array_max("found"))).drop("units", "found", "body", "spdx")
    scored = checkpointed(scored)  # a few words for each file, so texts are scored once
    placed = scored.where("own is not null and directory is not null").groupBy("directory").agg(F.max("own").alias("held")).withColumnRenamed("directory", "above")
    wanted = scored.where("own is null and directory is not null").select("directory").distinct()
    parts = F.split("directory", "/")
    upwards = wanted.select("directory", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("above")))).alias("x")).select("directory", "x.depth", "x.above")
    nearest = upwards.join(placed, "above").groupBy("directory").agg(F.max(F.struct("depth", "above", "held")).alias("near"))
    nearest = checkpointed(nearest.select("directory", "near.above", "near.held"))  # a table of its own, so that the join may split a large directory
    out = scored.join(nearest, "directory", "left")
    return out.select(F.col("id").alias(id_col), "directory", F.coalesce("own.license", F.when(F.col("own").isNull(), F.col("held.license"))).alias("license"), F.coalesce("own.score", "held.score").alias("score"), F.when(F.col("own").isNull(), F.col("above")).alias("inherited_from"))


def _python_terms(text: str) -> list[str]:
    return [x for x in re.split(r"[^a-z0-9.\-]+|[.\-]+(?![a-z0-9])", text.lower()) if x]


def op6(spark, sf_dir: str) -> DataFrame:
    """Every page with its own or inherited licence; scores to six places."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("score", F.round("score", 6))
