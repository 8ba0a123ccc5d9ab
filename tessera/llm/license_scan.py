r"""Operator 3: license scan with ordered signature rules.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z; rules match
the words joined by one space, so punctuation and line breaks don't matter.

`rule_set` puts the rules in order: exact base phrases; the signatures of
`SIGNATURES`, written by hand from the licenses' own texts, file notices and
grants, a special text before the plain one it extends; then for each license
of `LICENSES` a tag rule, grant rules and name rules made from its names. Each
rule has a label, a priority (place in the order, 0 first), a weight and a
keyword that any match must hold. A signature takes a line "all rights
reserved" right before it with it, so that line doesn't claim the text. One Aho-Corasick pass over the normalised
text finds the keywords, and only rules whose keyword is there run. Detections
are taken in order of priority, then length; one whose words lie within a
detection already taken is suppressed, unless it is a base phrase.

Work is one pass over each text within its row: documents are never shuffled.

Defined cases: null and empty texts have no words and no detection; repeated
rows each get their row; other columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# fixed values: base phrases and their labels
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# fixed values: label, names as normalised words (public license names)
LICENSES = {
    "mit": ["mit", "mit expat", "expat"],
    "apache-2": ["apache 2", "apache 2 0", "apache license 2 0", "apache version 2 0", "asl 2 0"],
    "apache-1": ["apache 1 1", "apache license version 1 1", "apache software license 1 0"],
    "bsd-2": ["bsd 2 clause", "simplified bsd", "freebsd", "two clause bsd"],
    "bsd-3": ["bsd 3 clause", "new bsd", "revised bsd", "modified bsd", "three clause bsd"],
    "bsd-4": ["bsd 4 clause", "original bsd"],
    "0bsd": ["0bsd", "zero clause bsd"],
    "isc": ["isc"],
    "gpl-1": ["gnu general public license version 1", "gpl 1 0", "gplv1"],
    "gpl-2": ["gnu general public license version 2", "gpl 2 0", "gplv2", "gnu gpl 2", "gnu gpl version 2"],
    "gpl-3": ["gnu general public license version 3", "gpl 3 0", "gplv3", "gnu gpl 3", "gnu gpl version 3"],
    "lgpl-2": ["gnu lesser general public license version 2 1", "lgpl 2 1", "lgplv2 1",
               "gnu library general public license version 2"],
    "lgpl-3": ["gnu lesser general public license version 3", "lgpl 3 0", "lgplv3"],
    "agpl-3": ["gnu affero general public license version 3", "agpl 3 0", "agplv3"],
    "gfdl": ["gnu free documentation license", "gfdl"],
    "mpl-1": ["mozilla public license version 1 1", "mpl 1 1"],
    "mpl-2": ["mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"],
    "epl-1": ["eclipse public license 1 0", "eclipse public license v 1 0", "epl 1 0"],
    "epl-2": ["eclipse public license 2 0", "eclipse public license v 2 0", "epl 2 0"],
    "cddl": ["common development and distribution license", "cddl 1 0", "cddl 1 1"],
    "cpl": ["common public license 1 0", "cpl 1 0"],
    "eupl": ["european union public licence", "eupl 1 1", "eupl 1 2"],
    "cecill": ["cecill", "cecill b", "cecill c"],
    "artistic-1": ["artistic license 1 0"],
    "artistic-2": ["artistic license 2 0"],
    "zlib": ["zlib", "zlib libpng"],
    "boost-1": ["boost software license version 1 0", "boost software license 1 0", "bsl 1 0"],
    "unlicense": ["unlicense"],
    "wtfpl": ["do what the fuck you want to public license", "wtfpl"],
    "python-2": ["python software foundation license", "psf license", "psf 2 0"],
    "openssl": ["openssl license"],
    "ofl-1": ["sil open font license", "ofl 1 1"],
    "ncsa": ["university of illinois ncsa open source license", "ncsa open source"],
    "postgresql": ["postgresql license"],
    "x11": ["x11 license", "mit x11"],
    "json": ["json license"],
    "ms-pl": ["microsoft public license", "ms pl"],
    "ms-rl": ["microsoft reciprocal license", "ms rl"],
    "afl-3": ["academic free license", "afl 3 0"],
    "osl-3": ["open software license 3 0", "osl 3 0"],
    "upl": ["universal permissive license", "upl 1 0"],
    "bsl-1.1": ["business source license 1 1", "busl 1 1"],
    "sspl": ["server side public license", "sspl 1 0"],
    "elastic-2": ["elastic license 2 0"],
    "odbl": ["open database license", "odbl 1 0"],
    "odc-by": ["open data commons attribution license", "odc by"],
    "pddl": ["public domain dedication and license", "pddl 1 0"],
    "cc0": ["cc0 1 0", "cc0", "creative commons zero"],
    "cc-by": ["cc by 2 0", "cc by 3 0", "cc by 4 0", "creative commons attribution 4 0", "creative commons attribution 3 0"],
    "cc-by-sa": ["cc by sa", "creative commons attribution share alike", "creative commons attribution sharealike"],
    "cc-by-nd": ["cc by nd", "creative commons attribution noderivatives", "creative commons attribution no derivatives"],
    "cc-by-nc": ["creative commons attribution non commercial", "creative commons attribution noncommercial"],
    "cc-by-nc-sa": ["cc by nc sa", "creative commons attribution noncommercial sharealike"],
    "cc-by-nc-nd": ["cc by nc nd", "creative commons attribution noncommercial noderivatives"],
    "proprietary": ["all rights reserved"],
    "public-domain": ["in the public domain", "dedicated to the public domain"],
}
# fixed values: label, keyword, words of the license's text, notice or grant; `{n}` stands for up to n words
SIGNATURES = [
    # permissive texts that open with the same grant, the special ones first
    ("ncsa", "associated documentation files", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files {40} redistributions of source code must retain"),
    ("json", "associated documentation files", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files {90} the software shall be used for good not evil"),
    ("json", "used for good not evil", "the software shall be used for good not evil"),
    ("x11", "associated documentation files", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files {180} except as contained in this notice the names? of {12} shall not be used in advertising"),
    ("ofl-1", "copy of the font software", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("boost-1", "accompanying documentation covered by this license", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("upl", "subject to the condition set forth below", "subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software"),
    ("mit", "associated documentation files", "permission is hereby granted free of charge to any person obtaining a copy of (?:this|the) software and (?:its )?associated documentation files(?: the software)?(?: to deal in the software without restriction)?"),
    ("mit", "shall be included in all copies", "the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software"),
    ("mit", "the mit licen", "(?:is|are) (?:free software )?(?:licensed|released|distributed|available|made available) under (?:the terms of )?the mit licen[cs]e"),
    ("mit", "mit style license", "use of this source code is governed by an? mit style license"),
    # redistribution clauses
    ("bsd-4", "all advertising materials mentioning features", "redistribution and use in source and binary forms {110} all advertising materials mentioning features or use of this software must display"),
    ("apache-1", "may not be called apache", "redistribution and use in source and binary forms {180} products derived from this software may not be called apache"),
    ("apache-1", "may not be called apache", "products derived from this software may not be called apache"),
    ("openssl", "openssl project for use in the openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("bsd-3", "to endorse or promote products", "redistribution and use in source and binary forms {130} (?:neither the names? of|the names? of) {40} (?:may|must not) (?:not )?be used to endorse or promote products(?: derived from this software)?(?: without specific prior written permission)?"),
    ("bsd-3", "to endorse or promote products", "neither the names? of {40} may be used to endorse or promote products derived from this software(?: without specific prior written permission)?"),
    ("bsd-2", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification (?:are|is) permitted provided that the following conditions are met"),
    ("bsd-3", "bsd style license", "use of this source code is governed by an? bsd style license"),
    ("bsd", "the bsd licen", "(?:is|are) (?:licensed|released|distributed|available) under (?:the terms of )?the bsd licen[cs]e"),
    # short grants
    ("0bsd", "with or without fee is hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    ("isc", "with or without fee is hereby granted", "permission to use copy modify (?:and or|and) distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("postgresql", "without a written agreement is hereby granted", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", "is hereby granted", "permission to use copy modify (?:distribute and sell|and distribute) this software and its documentation for any purpose (?:and without fee is hereby granted|is hereby granted without fee)"),
    ("zlib", "anyone to use this software for any purpose", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("zlib", "altered source versions must be plainly marked", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "do what the fuck you want to", "you just do what the fuck you want to"),
    ("beerware", "you can do whatever you want with this stuff", "as long as you retain this notice you can do whatever you want with this stuff"),
    ("fair", "usage of the works is permitted provided", "usage of the works is permitted provided that this instrument is retained with the works"),
    ("fsf-allpermissive", "are permitted in any medium without royalty", "copying and distribution of this file with or without modification are permitted in any medium without royalty provided the copyright notice and this notice are preserved"),
    ("python-2", "psf hereby grants licensee", "psf hereby grants licensee a nonexclusive royalty free world ?wide license"),
    ("python-2", "cnri hereby grants licensee", "cnri hereby grants licensee a nonexclusive royalty free world ?wide license"),
    ("ruby", "redistribute it and or modify it under either the terms", "you can redistribute it and or modify it under either the terms of the (?:2 clause bsdl|gpl)"),
    ("vim", "vim is charityware", "vim is charityware"),
    # Apache
    ("apache-2", "licensed under the apache license", "licensed under the apache license version 2(?: 0)?(?: the license)? you may not use this file except in compliance with the license"),
    ("apache-2", "unless required by applicable law", "unless required by applicable law or agreed to in writing (?:the )?software distributed under the license is distributed on an as is basis"),
    ("apache-2", "contributor license agreements", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2", "terms and conditions for use reproduction and distribution", "apache license version 2 0 january 2004 (?:https? www apache org licenses )?terms and conditions for use reproduction and distribution"),
    # GNU file notices: the version named, whether or not a later one may be taken
    ("agpl-3", "affero general public license", "(?:under the terms of )?the gnu affero general public license (?:as published by the free software foundation )?(?:either )?version 3(?: of the license)?(?: or at your option any later version)?"),
    ("lgpl-3", "lesser general public license", "(?:under the terms of )?the gnu lesser general public license (?:as published by the free software foundation )?(?:either )?version 3(?: of the license)?(?: or at your option any later version)?"),
    ("lgpl-2", "general public license", "(?:under the terms of )?the gnu (?:lesser|library) general public license (?:as published by the free software foundation )?(?:either )?version 2(?: 1)?(?: of the license)?(?: or at your option any later version)?"),
    ("gpl-3", "gnu general public license", "(?:under the terms of )?(?:version 3 of the gnu general public license|the gnu general public license (?:as published by the free software foundation )?(?:either )?version 3)(?: of the license)?(?: or at your option any later version)?"),
    ("gpl-2", "gnu general public license", "(?:under the terms of )?(?:version 2 of the gnu general public license|the gnu general public license (?:as published by the free software foundation )?(?:either )?version 2)(?: of the license)?(?: only| or at your option any later version)?"),
    ("gpl-1", "gnu general public license", "(?:under the terms of )?the gnu general public license (?:as published by the free software foundation )?(?:either )?version 1(?: of the license)?(?: or at your option any later version)?"),
    # GNU license texts
    ("gpl-2", "gnu general public license version 2 june 1991", "gnu general public license version 2 june 1991"),
    ("gpl-3", "gnu general public license version 3 29 june 2007", "gnu general public license version 3 29 june 2007"),
    ("lgpl-2", "lesser general public license version 2 1 february 1999", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3", "lesser general public license version 3 29 june 2007", "gnu lesser general public license version 3 29 june 2007"),
    ("agpl-3", "affero general public license version 3 19 november 2007", "gnu affero general public license version 3 19 november 2007"),
    ("agpl-3", "affero general public license is a free copyleft", "the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3", "gnu general public license is a free copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("lgpl-3", "incorporates the terms and conditions of version 3", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("gfdl", "gnu free documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    # file-level copyleft
    ("mpl-2", "this source code form is subject to", "this source code form is subject to the terms of the mozilla public license v ?2 0"),
    ("mpl-2", "incompatible with secondary licenses", "this source code form is incompatible with secondary licenses as defined by the mozilla public license v ?2 0"),
    ("mpl-1", "the contents of this file are subject to", "the contents of this file are subject to the mozilla public license version 1 [01]"),
    ("cddl", "the contents of this file are subject to", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("epl-1", "the accompanying materials are made available", "this program and the accompanying materials are made available under the terms of the eclipse public license v ?1 0"),
    ("epl-2", "the accompanying materials are made available", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?)?2 0"),
    ("cpl", "the accompanying materials are made available", "this program and the accompanying materials are made available under the terms of the common public license v ?1 0"),
    ("eupl", "licensed under the eupl", "licensed under the eupl(?: version)?(?: 1 [012])?"),
    ("cecill", "governed by the cecill", "this software is governed by the cecill(?: [bc])? license under french law"),
    ("artistic-1", "state the conditions under which a package may be copied", "the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2", "establishes the terms under which a given free software package", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("ms-pl", "if you bring a patent claim against any contributor", "if you bring a patent claim against any contributor over patents that you claim are infringed by the software"),
    ("afl-3", "licensed under the academic free license", "licensed under the academic free license version 3 0"),
    ("osl-3", "licensed under the open software license", "licensed under the open software license version 3 0"),
    # source-available
    ("bsl-1.1", "make non production use of the licensed work", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("elastic-2", "to third parties as a hosted or managed service", "you may not provide the software to third parties as a hosted or managed service"),
    ("sspl", "offering the program as a service", "offering the program as a service if you make the functionality of the program or a modified version available to third parties as a service"),
    ("commons-clause", "the grant of rights under the license will not include", "the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    # works and data
    ("cc-by-nc-nd", "creative commons", r"licensed under (?:a |the )?(?:terms of the )?creative commons attribution non ?commercial no ?deriv(?:atives?|s)(?: works)?(?: \d \d)?(?: international| unported| generic)?(?: licen[cs]e)?"),
    ("cc-by-nc-sa", "creative commons", r"licensed under (?:a |the )?(?:terms of the )?creative commons attribution non ?commercial share ?alike(?: \d \d)?(?: international| unported| generic)?(?: licen[cs]e)?"),
    ("cc-by-nc", "creative commons", r"licensed under (?:a |the )?(?:terms of the )?creative commons attribution non ?commercial(?: \d \d)?(?: international| unported| generic)?(?: licen[cs]e)?"),
    ("cc-by-nd", "creative commons", r"licensed under (?:a |the )?(?:terms of the )?creative commons attribution no ?deriv(?:atives?|s)(?: works)?(?: \d \d)?(?: international| unported| generic)?(?: licen[cs]e)?"),
    ("cc-by-sa", "creative commons", r"licensed under (?:a |the )?(?:terms of the )?creative commons attribution share ?alike(?: \d \d)?(?: international| unported| generic)?(?: licen[cs]e)?"),
    ("cc-by", "creative commons", r"licensed under (?:a |the )?(?:terms of the )?creative commons attribution(?: \d \d)?(?: international| unported| generic)?(?: licen[cs]e)?"),
    ("cc0", "to the public domain by waiving all", "dedicated the work to the public domain by waiving all of (?:his or her|his|her|their) rights"),
    ("cc0", "to the extent possible under law", "to the extent possible under law {20} (?:has|have) waived all copyright and related or neighboring rights"),
    ("odbl", "open database license", "is made available under the open database license"),
    ("odc-by", "open data commons attribution license", "is made available under the open data commons attribution license"),
    ("pddl", "public domain dedication and license", "is made available under the public domain dedication and license"),
    ("ogl-uk", "open government licence", r"(?:contains public sector information )?licensed under the open government licence(?: v ?\d 0)?"),
    ("public-domain", "the public domain", "(?:has been |is hereby |hereby )?(?:released|placed|put|dedicated) (?:in|into) the public domain"),
    ("public-domain", "work of the united states government", "(?:is )?a work of the united states government(?: and is)?(?: not subject to copyright protection)?"),
    # closed
    ("proprietary", "strictly prohibited", "unauthori[sz]ed (?:copying|use|reproduction|distribution) (?:of this file |or distribution |of this software )?(?:via any medium )?is strictly prohibited"),
    ("proprietary", "proprietary and confidential", "proprietary and confidential"),
    ("proprietary", "unpublished proprietary source code", "this is unpublished proprietary source code"),
]
# names that are words of their own right only beside a grant or the word license
_WEAK = {"mit", "expat", "isc", "json license", "freebsd", "zlib", "cecill", "unlicense"}

WORD = re.compile(rb"[^0-9a-z\x80-\xff]+")


class Rule(NamedTuple):
    label: str
    weight: float
    keyword: str
    pattern: re.Pattern
    base: bool


@lru_cache
def rule_set() -> tuple[Rule, ...]:
    """All rules, highest priority first."""
    def rule(label: str, weight: float, keyword: str, pattern: str, base: bool = False) -> Rule:
        return Rule(label, weight, keyword, re.compile(rf"(?<= )(?:{pattern})(?= )"), base)
    rules = [rule(label, 1.0, f" {phrase} ", re.escape(phrase), True) for phrase, label in BASE.items()]
    for label, keyword, words in SIGNATURES:
        gap = re.sub(r" \{(\d+)\} ", r" (?:[^ ]+ ){0,\1}?", words)
        rules.append(rule(label, 0.95, keyword, rf"(?:all rights reserved )?(?:{gap})"))
    by_length = sorted(((label, n) for label, names in LICENSES.items() for n in names), key=lambda x: (-len(x[1]), x))
    grant = "licensed under|released under|distributed under|available under|published under|covered by|governed by|subject to"
    for label, name in by_length:  # tags, as in a file header
        rules.append(rule(label, 1.0, f" {name} ", rf"spdx license identifier {name}"))
    for label, name in by_length:  # grants
        rules.append(rule(label, 0.9, f" {name} ", rf"(?:{grant})(?: the| a| terms of| the terms of)?(?: the)? {name}"
                                                   r"(?: (?:public )?licen[cs]e)?(?: version \d+)?(?: or later)?"))
    for label, name in by_length:  # titles
        tail = "" if "license" in name or "licence" in name else " licen[cs]e"
        if tail:
            rules.append(rule(label, 0.7, f" {name} licen", name + tail))
    for label, name in by_length:  # names alone
        if name not in _WEAK:
            rules.append(rule(label, 0.5, f" {name} ", name))
    for name, label in (("gnu general public license", "gpl"), ("gnu lesser general public license", "lgpl"),
                        ("gnu affero general public license", "agpl"), ("mozilla public license", "mpl"),
                        ("apache license", "apache"), ("bsd license", "bsd"), ("creative commons", "cc")):
        rules.append(rule(label, 0.4, f" {name} ", name))
    return tuple(rules)


@lru_cache
def _gate() -> ahocorasick.Automaton:
    by_keyword: dict[str, list[int]] = {}
    for k, r in enumerate(rule_set()):
        by_keyword.setdefault(r.keyword, []).append(k)
    gate = ahocorasick.Automaton()
    for word, rules in by_keyword.items():
        gate.add_word(word, tuple(rules))
    gate.make_automaton()
    return gate


class Detection(NamedTuple):
    start: int     # words, end exclusive
    end: int
    priority: int
    label: str
    weight: float
    base: bool


def normalised(text: bytes) -> bytes:
    """Words with one space around each: lower-casing of bytes changes A-Z alone."""
    return b" " + WORD.sub(b" ", text.lower()).strip(b" ") + b" "


def detect(words: str) -> list[Detection]:
    """Detections that stay, by place; words as from `normalised`."""
    open_rules = sorted({k for _, rules in _gate().iter(words) for k in rules})
    if not open_rules:
        return []
    begins = [m.end() for m in re.finditer(" ", words)]
    found = []
    for k in open_rules:
        r = rule_set()[k]
        at = 0
        while m := r.pattern.search(words, at):
            start = bisect_left(begins, m.start())
            found.append(Detection(start, start + m[0].count(" ") + 1, k, r.label, r.weight, r.base))
            at = m.start() + 1
    taken, reach = [], _Reach(len(begins))
    for d in sorted(found, key=lambda d: (d.priority, d.start - d.end, d.start)):
        if d.base or reach.upto(d.start) < d.end:
            taken.append(d)
            reach.add(d.start, d.end)
    return sorted(taken)


class _Reach:
    """Greatest end of the intervals that start at a place or before (a Fenwick tree of maxima)."""

    def __init__(self, n: int):
        self.most = [0] * (n + 1)

    def add(self, start: int, end: int) -> None:
        at = start + 1
        while at < len(self.most):
            self.most[at] = max(self.most[at], end)
            at += at & -at

    def upto(self, start: int) -> int:
        at, most = start + 1, 0
        while at:
            most = max(most, self.most[at])
            at &= at - 1
        return most


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, detections (array of start, end, label, weight, base)."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()),
                               ("weight", pa.float64()), ("base", pa.bool_())]))

    def run(batches):
        for batch in batches:
            counts, out = [], []
            for body in batch.column("body").to_pylist():
                words = normalised(body)
                counts.append(words.count(b" ") - 1 if len(words) > 2 else 0)
                out.append([{"start": d.start, "end": d.end, "label": d.label, "weight": d.weight, "base": d.base}
                            for d in detect(words.decode())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(out, kind)],
                                             names=["doc_id", "n_words", "detections"])
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8").alias("body")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(
        run, "doc_id long, n_words long, detections "
             "array<struct<start:int,end:int,label:string,weight:double,base:boolean>>")
