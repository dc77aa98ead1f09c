r"""License scans by ordered signature rules (operator 1); DataFrame functions only.

A text is reduced to its words (A-Z in lower case; whatever else of ASCII is no digit
or letter separates), joined by single spaces.  Rules are regular expressions over
that string, each gated by a keyword that must occur first; a cheap test on the raw
text spares all texts without any hint of a license.  Every match is an interval.  A
match that lies within one of a rule of higher priority is suppressed, so "licensed
under the GNU Lesser General Public License" doesn't also report what it contains.

The base phrases count at every place where their words stand consecutively, whatever
the rules say, and their labels stay.

Offsets and containment are worked out within a row, in time quadratic in that text's own
matches (some seconds for 5,000 of them); rows share nothing.

Null text counts as empty.  An empty text has no words, no places and empty labels.
Rows are independent: ties, repeated rows and clashing extra columns change nothing.
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"

#: The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Label, keyword, how a text names the license, its SPDX identifier's words, and
#: whether the name alone tells (else it must come with the word license or a grant).
FAMILIES = (
    ("cc-by-nc-nd", "nc nd", r"(?:cc|creative commons)(?: attribution)? by nc nd(?: [1-4] \d)?", r"cc by nc nd [1-4] \d", True),
    ("cc-by-nc-nd", "deriv", r"(?:cc|creative commons)(?: attribution)? non ?commercial no ?deriv\w*(?: [1-4] \d)?", r"cc by nc nd", True),
    ("cc-by-nc-sa", "nc sa", r"(?:cc|creative commons)(?: attribution)? by nc sa(?: [1-4] \d)?", r"cc by nc sa [1-4] \d", True),
    ("cc-by-nc-sa", "alike", r"(?:cc|creative commons)(?: attribution)? non ?commercial share ?alike(?: [1-4] \d)?", r"cc by nc sa", True),
    ("cc-by-nc", "nc", r"cc by nc(?: [1-4] \d)?", r"cc by nc [1-4] \d", True),
    ("cc-by-nc", "commercial", r"creative commons attribution (?:noncommercial|non commercial)(?: [1-4] \d)?", r"cc by nc", True),
    ("cc-by-nd", "by nd", r"(?:cc|creative commons) by nd(?: [1-4] \d)?", r"cc by nd [1-4] \d", True),
    ("cc-by-nd", "deriv", r"(?:cc|creative commons) attribution no ?deriv\w*(?: [1-4] \d)?", r"cc by nd", True),
    ("cc-by-sa", "by sa", r"cc by sa(?: [1-4] \d)?", r"cc by sa [1-4] \d", True),
    ("cc-by-sa", "alike", r"creative commons attribution share ?alike(?: [1-4] \d)?", r"cc by sa", True),
    ("cc-by", "cc by", r"cc by(?: [1-4] \d)?", r"cc by [1-4] \d", True),
    ("cc-by", "creative commons attribution", r"creative commons attribution(?: [1-4] \d)?", r"cc by", True),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?", r"cc0 1 0", True),
    ("agpl-3", "affero", r"(?:gnu )?affero general public licen[sc]e(?: version)?(?: v?3)?(?: 0)?", r"agpl 3 0(?: only| or later)?", True),
    ("agpl-3", "agpl", r"agpl ?v?3?(?: 0)?", r"agpl 3 0", True),
    ("lgpl-3", "lesser", r"(?:gnu )?lesser general public licen[sc]e (?:version |v ?)?3(?: 0)?", r"lgpl 3 0(?: only| or later)?", True),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licen[sc]e (?:version |v ?)?2 1", r"lgpl 2 1(?: only| or later)?", True),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[sc]e", r"lgpl \d(?: \d)?", True),
    ("lgpl-3", "lgpl", r"lgpl ?v?3(?: 0)?", r"lgpl 3 0", True),
    ("lgpl-2.1", "lgpl", r"lgpl ?v?2 1", r"lgpl 2 1", True),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[sc]e(?: (?:version|v) 1 \d)?", r"gfdl 1 \d", True),
    ("gpl-3", "general public", r"(?:gnu )?general public licen[sc]e (?:version |v ?)?3(?: 0)?", r"gpl 3 0(?: only| or later)?", True),
    ("gpl-2", "general public", r"(?:gnu )?general public licen[sc]e (?:version |v ?)?2(?: 0)?", r"gpl 2 0(?: only| or later)?", True),
    ("gpl-1", "general public", r"(?:gnu )?general public licen[sc]e (?:version |v ?)?1(?: 0)?", r"gpl 1 0(?: only| or later)?", True),
    ("gpl-3", "gpl", r"(?:gnu )?gpl ?v?3(?: 0)?", r"gpl 3 0", True),
    ("gpl-2", "gpl", r"(?:gnu )?gpl ?v?2(?: 0)?", r"gpl 2 0", True),
    ("gpl", "general public", r"(?:gnu )?general public licen[sc]e", r"gpl \d(?: \d)?", True),
    ("apache-2", "apache", r"apache(?: software)? licen[sc]e(?: version)? v?2(?: 0)?", r"apache 2 0", True),
    ("apache-2", "apache", r"apache ?v?2(?: 0)?", r"apache 2", True),
    ("apache-1.1", "apache", r"apache(?: software)? licen[sc]e(?: version)? v?1 1", r"apache 1 1", True),
    ("apache", "apache", r"apache", r"apache", False),
    ("mit-0", "mit", r"mit (?:no attribution|0)", r"mit 0", False),
    ("mit", "mit", r"mit(?: x11| expat)?", r"mit", False),
    ("mit", "expat", r"expat", r"expat", False),
    ("x11", "x11", r"x11", r"x11", False),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|original bsd|four clause bsd|4 clause bsd)", r"bsd 4 clause", True),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|new bsd|modified bsd|revised bsd|three clause bsd|3 clause bsd)", r"bsd 3 clause", True),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|simplified bsd|freebsd|two clause bsd|2 clause bsd)", r"bsd 2 clause", True),
    ("0bsd", "bsd", r"(?:0bsd|zero clause bsd)", r"0bsd", True),
    ("bsd", "bsd", r"bsd", r"bsd", False),
    ("isc", "isc", r"isc", r"isc", False),
    ("mpl-2", "mozilla public", r"mozilla public licen[sc]e(?: version)? v?2(?: 0)?", r"mpl 2 0", True),
    ("mpl-1.1", "mozilla public", r"mozilla public licen[sc]e(?: version)? v?1 1", r"mpl 1 1", True),
    ("mpl", "mozilla public", r"mozilla public licen[sc]e", r"mpl \d \d", True),
    ("mpl-2", "mpl", r"mpl ?v?2(?: 0)?", r"mpl 2 0", True),
    ("epl-2", "eclipse public", r"eclipse public licen[sc]e(?: version)? v?2(?: 0)?", r"epl 2 0", True),
    ("epl-1", "eclipse public", r"eclipse public licen[sc]e(?: version)? v?1(?: 0)?", r"epl 1 0", True),
    ("epl", "eclipse public", r"eclipse public licen[sc]e", r"epl \d \d", True),
    ("eupl", "european union public", r"european union public licen[sc]e(?: version)?(?: v?1 \d)?", r"eupl 1 \d", True),
    ("cddl", "common development", r"common development and distribution licen[sc]e(?: version)?(?: v?1 \d)?", r"cddl 1 \d", True),
    ("artistic-2", "artistic", r"artistic licen[sc]e(?: version)? v?2(?: 0)?", r"artistic 2 0", True),
    ("artistic", "artistic", r"artistic", r"artistic 1 0", False),
    ("bsl-1", "boost", r"boost(?: software)? licen[sc]e(?: version)?(?: v?1)?(?: 0)?", r"bsl 1 0", True),
    ("zlib", "zlib", r"zlib(?: libpng)?", r"zlib", False),
    ("unlicense", "unlicense", r"(?:the )?unlicense", r"unlicense", True),
    ("wtfpl", "wtfpl", r"wtfpl", r"wtfpl", True),
    ("psf", "python software", r"python software foundation licen[sc]e(?: version)?(?: v?2)?", r"psf 2 0", True),
    ("postgresql", "postgresql", r"postgresql", r"postgresql", False),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[sc]e(?: version)?(?: v?1 1)?", r"ofl 1 1", True),
    ("odbl", "open database", r"open database licen[sc]e(?: version)?(?: v?1 0)?", r"odbl 1 0", True),
    ("odc-by", "open data commons", r"open data commons attribution licen[sc]e", r"odc by 1 0", True),
    ("pddl", "public domain dedication", r"public domain dedication and licen[sc]e", r"pddl 1 0", True),
    ("public-domain", "public domain", r"public domain", r"cc pddc", True),
    ("openrail", "rail", r"(?:creativeml |bigscience )?open ?rail(?: m)?", r"openrail", True),
)
#: What licenses and their notices say themselves: label, a word of it (the gate), and its words.
TEXTS = (
    ("bsl-1", "organization", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("mit-0", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this (?:software|font|work)"),
    ("mit", "portions", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("x11", "advertising", r"except as contained in this notice the names? of (?:[^ ]+ ){1,12}?shall not be used in advertising or otherwise to promote"),
    ("0bsd", "hereby", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("isc", "hereby", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?! the software)"),
    ("postgresql", "hereby", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", "hereby", r"permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-3-clause", "contributors", r"neither the names? of (?:[^ ]+ ){1,12}?(?:nor|or) the names of (?:its|any|their) contributors may be used to endorse or promote products derived"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("apache-2", "compliance", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache", "compliance", r"you may not use this file except in compliance with the license"),
    ("apache-2", "agreed", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache", "foundation", r"this product includes software developed by the apache software foundation"),
    ("agpl-3", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation(?: either)? version 3"),
    ("lgpl-3", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation(?: either)? version 3"),
    ("lgpl-2.1", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation(?: either)? version 2 1"),
    ("lgpl-2", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation(?: either)? version 2"),
    ("gpl-3", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation(?: either)? version 3"),
    ("gpl-2", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation(?: either)? version 2"),
    ("gpl", "hope", r"this program is distributed in the hope that it will be useful but without any warranty"),
    ("lgpl", "hope", r"this library is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("mpl-2", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2", "mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl-2", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license(?: version| v)? 2 0"),
    ("epl-1", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license(?: version| v)? ?v?1 0"),
    ("cddl", "distribution", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("zlib", "liable", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("artistic", "package", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2", "package", r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "domain", r"(?:is|are) (?:hereby )?(?:dedicated to|placed in(?:to)?|released (?:in)?to) the public domain"),
    ("wtfpl", "want", r"do what the [^ ]+ you want to public license"),
    ("cc0", "waived", r"to the extent possible under law (?:[^ ]+ ){1,12}?(?:has|have) waived all copyright and related or neighbou?ring rights"),
    ("gfdl", "document", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font license"),
    ("ofl-1.1", "font", r"the font software may be modified altered or added to"),
    ("psf", "psf", r"psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("ncsa", "illinois", r"university of illinois ncsa open source license"),
    ("openssl", "openssl", r"redistributions of any form whatsoever must retain the following acknowledgment this product includes software developed by the openssl project"),
    ("jslint", "evil", r"the software shall be used for good not evil"),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd(?: \d \d)?"),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa(?: \d \d)?"),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc(?! nd| sa)(?: \d \d)?"),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd(?: \d \d)?"),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa(?: \d \d)?"),
    ("cc-by", "creativecommons", r"creativecommons org licenses by(?! nc| nd| sa)(?: \d \d)?"),
    ("cc0", "creativecommons", r"creativecommons org publicdomain zero(?: 1 0)?"),
    ("public-domain", "creativecommons", r"creativecommons org publicdomain mark(?: 1 0)?"),
    ("apache-2", "apache", r"apache org licenses license 2 0"),
    ("mit", "opensource", r"opensource org licenses mit"),
    ("bsd-3-clause", "opensource", r"opensource org licenses bsd 3 clause"),
    ("bsd-2-clause", "opensource", r"opensource org licenses bsd 2 clause"),
    ("isc", "opensource", r"opensource org licenses isc"),
    ("artistic-2", "opensource", r"opensource org licenses artistic 2 0"),
    ("gpl-3", "gnu", r"gnu org licenses gpl 3 0"),
    ("gpl-2", "gnu", r"gnu org licenses(?: old licenses)? gpl 2 0"),
    ("lgpl-3", "gnu", r"gnu org licenses lgpl 3 0"),
    ("lgpl-2.1", "gnu", r"gnu org licenses(?: old licenses)? lgpl 2 1"),
    ("agpl-3", "gnu", r"gnu org licenses agpl 3 0"),
    ("gfdl", "gnu", r"gnu org licenses fdl(?: 1 \d)?"),
    ("mpl-2", "mozilla", r"mozilla org mpl 2 0"),
    ("epl-2", "eclipse", r"eclipse org legal epl (?:2 0|v20)"),
    ("epl-1", "eclipse", r"eclipse org legal epl v10"),
    ("bsl-1", "boost", r"boost org license 1 0 txt"),
    ("odbl", "opendatacommons", r"opendatacommons org licenses odbl(?: 1 0)?"),
    ("odc-by", "opendatacommons", r"opendatacommons org licenses by(?: 1 0)?"),
    ("pddl", "opendatacommons", r"opendatacommons org licenses pddl(?: 1 0)?"),
)
TEXT_WEIGHT = 0.98
_DONE = r"(?:licen[sc]ed|released|distributed|available|published|provided|redistributed|covered|governed|offered|shared|free)"
_VERSION = r"(?: (?:version|v) \d(?: \d)?)?"
#: Forms in order of priority: name, weight, keyword (empty: the family's own), and the patterns around the parts of a
#: family whose name alone tells, and of one whose name doesn't: there "by" and "with" need the word license as well.
FORMS = (
    ("tag", 1.0, "spdx", "spdx licen[sc]e identifier {spdx}", "spdx licen[sc]e identifier {spdx}"),
    (
        "grant",
        0.95,
        "",
        _DONE + r" (?:[^ ]+ ){{0,3}}?(?:under|by|with|per) (?:[^ ]+ )??(?:terms (?:and conditions )?of )?(?:the |a |an )?{name}(?: public)?(?: licen[sc]e)?" + _VERSION,
        _DONE + r" (?:[^ ]+ ){{0,3}}?(?:(?:under|per) (?:the )?(?:terms (?:and conditions )?of )?(?:the |a |an )?{name}(?: (?:public )?licen[sc]e)?|(?:by|with) (?:the |a |an )?{name} (?:public )?licen[sc]e)" + _VERSION,
    ),
    ("terms", 0.9, "", *[r"(?:subject to|under|see|accept) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name} licen[sc]e"] * 2),
    ("name", 0.8, "", *[r"{name} licen[sc]e[ds]?" + _VERSION] * 2),
    ("mention", 0.5, "", "{name}", ""),
)
#: What a text must hold, in lower case, for any rule or phrase to be able to match: each family's
#: keywords need one of these in the raw text, whatever separates the words.
HINTS = ("licen", "spdx", "gpl", "cc0", "bsd", "mpl", "wtfpl", "commons", "sharealike", "openrail")
#: The texts that needn't say license: the rarest of their words, chained to the ones that gate them.
TEXT_HINTS = tuple(sorted({word for _, word, pattern in TEXTS if not any(h in pattern for h in HINTS)}))
HINT_PATTERN = r"(?<![0-9a-z])cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+(?:attribution[\x00-\x2F\x3A-\x60\x7B-\x7F]+)?by(?![0-9a-z])|public[\x00-\x2F\x3A-\x60\x7B-\x7F]+domain|open[\x00-\x2F\x3A-\x60\x7B-\x7F]+rail|apache[\x00-\x2F\x3A-\x60\x7B-\x7F]*v?2|non[\x00-\x2F\x3A-\x60\x7B-\x7F]*commercial|no[\x00-\x2F\x3A-\x60\x7B-\x7F]*deriv"
#: A grant need not say license: then it holds one of these words and the name of a family that the name alone doesn't tell.
GRANTS = tuple(w for w in _DONE[3:-1].split("|") if not w.startswith("licen"))
GRANTED = tuple(sorted({keyword for _, keyword, _, _, alone in FAMILIES if not alone}))
GRANTED_PATTERN = f"(?<![0-9a-z])(?:{'|'.join(GRANTED)})(?![0-9a-z])"


def rules() -> list[dict]:
    """All rules in order of priority: tags, notices, then the other forms; families as listed within a form."""
    found = []
    for form, weight, gate, around, guarded in FORMS:
        for label, keyword, name, spdx, alone in FAMILIES:
            if pattern := around if alone else guarded:
                found.append((gate or keyword, pattern.format(name=f"(?:{name})", spdx=f"(?:{spdx})"), label, weight))
        if form == "tag":  # whole notices come next, since they hold names of licenses
            found += [(word, pattern, label, TEXT_WEIGHT) for label, word, pattern in TEXTS]
    return [{"rank": i, "keyword": k, "pattern": f"(?<= )(?:{p})(?= )", "label": label, "weight": w} for i, (k, p, label, w) in enumerate(found)]


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def hinted(text: Column) -> Column:
    """Whether a text can match at all: a superset of every rule's and phrase's texts, read off the raw text."""
    low = F.lower(text)
    out = low.rlike(HINT_PATTERN)
    for h in (*HINTS, *TEXT_HINTS):
        out = low.contains(h) | out
    holds = lambda words: functools.reduce(lambda a, b: a | b, (low.contains(w) for w in words))
    return out | (holds(GRANTED) & holds(GRANTS) & low.rlike(GRANTED_PATTERN))


def normalised(text: Column) -> Column:
    """The words of a text, each between single spaces."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), SEPARATORS, " ")), F.lit(" "))


def _places(norm: Column, n_words: Column) -> tuple[Column, Column, Column]:
    """Count, least and largest start of the base phrases' places, counted in words.

    No phrase overlaps itself, so the pieces between its matches tell all places.
    """
    count, first, last = F.lit(0), [], []
    for phrase, _ in BASE:
        pieces = F.split(norm, f"(?<= ){phrase}(?= )", -1)
        n = F.size(pieces) - 1
        count = count + n
        first.append(F.when(n > 0, _spaces(pieces[0]) - 1))
        last.append(F.when(n > 0, n_words - (_spaces(F.element_at(pieces, -1)) - 1) - len(phrase.split())))
    return count, F.least(*first), F.greatest(*last)


def _matches(norm: Column, all_rules: Column) -> Column:
    """Every match of every rule whose keyword occurs: rank, start, end, label, weight."""

    def of(rule: Column) -> Column:
        pieces, found = F.split(norm, rule["pattern"], -1), F.regexp_extract_all(norm, rule["pattern"], F.lit(0))
        total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.length(x))
        return F.transform(
            found,
            lambda x, i: F.struct(
                rule["rank"].alias("rank"),
                (total(F.slice(pieces, 1, i + 1)) + total(F.slice(found, 1, i))).alias("start"),
                (total(F.slice(pieces, 1, i + 1)) + total(F.slice(found, 1, i + 1))).alias("end"),
                rule["label"].alias("label"),
                rule["weight"].alias("weight"),
            ),
        )

    return F.flatten(F.transform(F.filter(all_rules, lambda r: norm.contains(r["keyword"])), of))


def _unsuppressed(found: Column) -> Column:
    """Matches that no match of higher priority contains."""
    return F.filter(found, lambda d: ~F.exists(found, lambda e: (e["rank"] < d["rank"]) & (e["start"] <= d["start"]) & (e["end"] >= d["end"])))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every whole text."""
    shape = "array<struct<rank:int,keyword:string,pattern:string,label:string,weight:double>>"
    table = F.from_json(F.lit(json.dumps(rules())), shape)  # a constant of the plan
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), F.when(hinted(text), normalised(text)).alias("norm"))
    count, first, last = _places(F.col("norm"), F.col("n_words"))
    names = F.array_compact(F.array(*(F.when(F.size(F.split("norm", f"(?<= ){p}(?= )", -1)) > 1, F.lit(name)) for p, name in BASE)))
    none = F.array().cast("array<string>")
    kinds = f"array<{'struct<rank:int,start:int,end:int,label:string,weight:double>'}>"
    seen = own.select(
        "doc_id",
        "n_words",
        F.coalesce(count, F.lit(0)).cast("long").alias("n_base"),
        first.cast("long").alias("first_word"),
        last.cast("long").alias("last_word"),
        F.when(F.col("norm").isNotNull(), names).otherwise(none).alias("base"),
        F.when(F.col("norm").isNotNull(), _matches(F.col("norm"), table)).otherwise(F.array().cast(kinds)).alias("found"),
    ).withColumn("kept", _unsuppressed(F.col("found")))
    joined = lambda xs: F.array_join(F.array_sort(F.array_distinct(xs)), ",")
    return seen.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", F.transform("kept", lambda d: d["label"]))).alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform("kept", lambda d: d["weight"])), F.lit(0.0)), F.when(F.col("n_base") > 0, 0.8).otherwise(0.0)).alias("score"),
        F.size("found").cast("long").alias("n_found"),
        F.size("kept").cast("long").alias("n_kept"),
    )


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(C.table(spark, sf_dir, "documents"))
