import random
import re

import duckdb
import pandas as pd

from marginalia.llm import licenses as L
from marginalia.llm import lines as D

DDL = "doc_id long, text string, lang string, source string, n_chars long, h long, text_kept string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0 if t is None else len(t), 1, "clash") for i, t, s in rows], DDL)


def corpus():
    rnd = random.Random(3)
    rows = []
    for i in range(200):
        own = [f"own line {i} {k}" for k in range(rnd.randint(0, 6))]
        own += [f"shared {k}" for k in range(12) if rnd.random() < 0.25] + rnd.choice([[], [""], ["  "]])
        rnd.shuffle(own)
        rows.append((i, "\n".join(own), rnd.choice([f"s{rnd.randrange(20)}", f"s{rnd.randrange(3)}", None])))
    return rows + [(500, None, "s1"), (501, "", "s2"), (502, "shared 1", "s3"), (3, rows[3][1], rows[3][2])]


def norm(rows):
    return sorted((str(r[0]), str(r[1]), int(r[2]), int(r[3])) for r in rows)


def test_lines_equal_sql_by_both_ways(spark):
    rows = corpus()
    documents = pd.DataFrame([(i, t, s) for i, t, s in rows], columns=["doc_id", "text", "source"])  # noqa: F841
    want = duckdb.connect().execute(D.OP7_SQL).fetchall()
    for in_plan in (10_000, 0):
        got = D.dedup(docs(spark, rows), in_plan=in_plan).select("doc_id", "text", "n_lines", "n_removed").collect()
        assert norm(got) == norm(want)
    assert sum(r[3] for r in want) > 50


def test_boilerplate_goes_however_large_its_share(spark):
    rows = [(i, f"All rights reserved by whoever made this page and its many parts\nown {i}", f"s{i}") for i in range(12)]
    rows += [(50, "All rights reserved by whoever made this page and its many parts\n ", "s1"), (51, "\n\n", "s1"), (52, "All rights reserved by whoever made this page and its many parts\n\t", "s1")]
    got = {r.doc_id: (r.text, r.n_removed) for r in D.dedup(docs(spark, rows)).collect()}
    assert all(got[i] == (f"own {i}", 1) for i in range(12))
    assert got[50] == (rows[12][1], 0) and got[51] == ("\n\n", 0) and got[52] == ("\t", 1)


def test_rewritten_keeps_columns(spark):
    out = D.rewritten(docs(spark, corpus()))
    assert out.columns == [c.split()[0] for c in DDL.split(", ")]
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)


def test_no_rows(spark):
    assert D.dedup(docs(spark, [])).count() == 0
    assert L.scan(docs(spark, [])).count() == 0


CASES = [
    (1, "Licensed under the Apache License, Version 2.0.", "s"),
    (2, "x\nReleased under the MIT License. Released UNDER-THE mit/license", "s"),
    (3, "Licensed under CC BY-NC 4.0.", "s"),
    (4, "CC_by;nc cc by nc cc BY nc", "s"),
    (5, "This work is licensed under the GNU General Public License, version 3.", "s"),
    (6, "GNU Lesser General Public License v2.1 and SPDX-License-Identifier: BSD-3-Clause", "s"),
    (7, "mit dem Haus, apache ist nicht licensed", "s"),
    (8, "under the mit licenses; underthe mit license; aunder the mit license", "s"),
    (9, "", "s"),
    (10, None, "s"),
    (11, "ünder the mit license é2 ünder", "s"),
    (12, ("word " * 3000) + "under the MIT license " + ("end " * 500) + "cc by nc", "s"),
    (13, "under the Kit license İ cc by-nc", "s"),
    (14, "Licensed under CC BY-NC-SA 4.0 or the Mozilla Public License 2.0", "s"),
    (2, "no license here", "s"),
]


def test_scan_equals_brute_force(spark):
    rules = L.rules()
    assert 300 <= len(rules) <= 450
    lower = str.maketrans(L.UPPER, L.LOWER)
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    want = []
    for i, t, _ in CASES:
        ws = word.findall((t or "").translate(lower))
        places = [(k, label) for p, label in L.BASE for k in range(len(ws)) if ws[k : k + len(p.split())] == p.split()]
        text, found = " " + " ".join(ws) + " ", []
        for r in rules:
            if r["keyword"] in text:
                found += [(r["rank"], m.start(), m.end(), r["label"], r["weight"]) for m in re.finditer(r["pattern"], text) if m.end() > m.start()]
        kept = [d for d in found if not any(e[0] < d[0] and e[1] <= d[1] and e[2] >= d[2] for e in found)]
        base = sorted({x for _, x in places})
        want.append((i, len(ws), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(base), ",".join(sorted({*base, *(d[3] for d in kept)})), max([d[4] for d in kept] + [0.8] * bool(places) + [0.0])))
    cols = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = [tuple(r) for r in L.scan(docs(spark, CASES)).select(*cols).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_containment_suppresses(spark):
    got = {r.doc_id: r.labels for r in L.scan(docs(spark, CASES)).collect()}
    assert got[5] == "gpl-3" and "gpl" not in got[6].replace("lgpl", "").split(",") and "lgpl-2.1" in got[6] and "bsd-3-clause" in got[6]
    assert got[7] == "" and got[14].startswith("cc-by-nc,cc-by-nc-sa") and "mpl-2" in got[14]


def test_plan_has_no_python_and_no_shuffle(spark):
    for df in (L.scan(docs(spark, CASES)),):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Exchange" not in plan


def spellings(pattern):
    """Every way to write a pattern: all alternatives, options with and without, the shortest of what repeats."""
    from re import _parser as P

    def of(tokens):
        out = [""]
        for op, arg in tokens:
            if op is P.LITERAL:
                ways = [chr(arg)]
            elif op is P.IN:
                ways = [chr(v) for o, v in arg if o is P.LITERAL] or (["s"] if (P.CATEGORY, P.CATEGORY_WORD) in arg else ["2"])
            elif op is P.BRANCH:
                ways = [w for way in arg[1] for w in of(way)]
            elif op is P.SUBPATTERN:
                ways = of(arg[3])
            elif op is P.NOT_LITERAL:
                ways = ["z"]
            elif op is P.ASSERT_NOT:
                ways = [""]
            else:
                lo, hi, inner = arg
                ways = [w * n for w in of(inner) for n in {lo, min(hi, 1)}]
            out = [a + b for a in out for b in dict.fromkeys(ways)]
        return out

    return of(P.parse(pattern))


def test_hints_hold_for_every_rule(spark):
    texts = [w for _, _, name, _, alone in L.FAMILIES for x in spellings(name) for w in [f"this code is Released under {x}, see", *([f"a {x.upper()}."] if alone else [])]]
    texts += [f"SPDX-License-Identifier: {x}" for _, _, _, spdx, _ in L.FAMILIES for x in spellings(spdx)]
    df = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    assert [r.text for r in df.where(~L.hinted(df.text)).collect()] == []
    said = ["Released under MIT", "distributed under the ISC", "available under Artistic", "provided under zlib"]
    got = {r.doc_id: r.labels for r in L.scan(docs(spark, [(i, t, "s") for i, t in enumerate([*said, "mit dem Haus, free"])])).collect()}
    assert got == {0: "mit", 1: "isc", 2: "artistic", 3: "zlib", 4: ""}


def test_keywords_gate_no_spelling_of_their_own_rule(spark):
    assert [(k, x) for _, k, name, _, _ in L.FAMILIES for x in spellings(name) if k not in x] == []
    said = ["-NonCommercial-NoDerivatives 4.0", "-NonCommercial-ShareAlike 4.0", "-NoDerivatives", " Non-Commercial", " Share Alike 3.0", ""]
    got = {r.doc_id: r.labels for r in L.scan(docs(spark, [(i, f"Creative Commons Attribution{t}, so", "s") for i, t in enumerate(said)] + [(9, "zero clause BSD license", "s")])).collect()}
    assert got == {0: "cc-by-nc-nd", 1: "cc-by-nc-sa", 2: "cc-by-nd", 3: "cc-by-nc", 4: "cc-by-sa", 5: "cc-by", 9: "0bsd"}


def test_notices_are_known(spark):
    texts = [(label, word, x) for label, word, pattern in L.TEXTS for x in spellings(pattern)]
    assert [x for _, word, x in texts if f"{word}" not in x] == []
    got = {r.doc_id: r.labels.split(",") for r in L.scan(docs(spark, [(i, f"So: {x.upper().replace(' ', ', ')}.", "s") for i, (_, _, x) in enumerate(texts)])).collect()}
    assert [(label, x, got[i]) for i, (label, _, x) in enumerate(texts) if label not in got[i]] == []


def test_a_bare_name_is_no_license(spark):
    said = {
        "published by MIT Press under a commercial licence": "",
        "provided with apache kafka; to be decided": "",
        "shared with BSD users, offered by zlib": "",
        "distributed with the MIT License": "mit",
        "covered by the ISC licence": "isc",
        "distributed under the terms of Apache": "apache",
        "released under X11": "x11",
        "This code is released under MIT.": "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files": "mit",
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted": "bsd",
    }
    got = {r.doc_id: r.labels for r in L.scan(docs(spark, [(i, t, "s") for i, t in enumerate(said)])).collect()}
    assert [got[i] for i in range(len(said))] == list(said.values())
