import hashlib

from tabsmith.llm import licenses as L


def brute(rows):
    known = dict(L.known_digests())
    look = lambda t: known.get(hashlib.sha256(L.canonical(t).encode()).hexdigest())
    out = []
    for d, t in rows:
        ids = [look(x) for x in (t or "").split("\n")]
        ids = [i for i in ids if i]
        out.append((d, look(t or ""), len(ids), ",".join(sorted(set(ids)))))
    return out


def test_known_texts_under_other_spellings(spark):
    mit = next(t for n, t in L.KNOWN if n == "MIT" and t.startswith("Permission"))
    bsd = next(t for n, t in L.KNOWN if n == "BSD-3-Clause" and "Redistribution" in t)
    isc = next(t for n, t in L.KNOWN if n == "ISC")
    rows = [
        (1, "Copyright (c) 2020 Someone\n\n" + mit),
        (2, " * © 2019-2021 A, B\n" + mit.upper().replace("SUBLICENSE", "sub-licence").replace(", ", " ,  ")),
        (3, mit + " And more."),
        (4, "// All rights reserved.\n" + bsd.replace("\n\n", "\n")),
        (5, "prose\nreleased under the mit licence\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License!"),
        (6, None),
        (7, ""),
        (8, "Copyright 2020 X"),
        (9, isc.replace("and/or", "and / or")),
        (9, isc.replace("and/or", "and / or")),
        (None, "word " * 30_000 + "\nLicensed under the ISC License."),
        (11, "This work is licensed under the GNU General Public Licence, version 3."),
        (12, "licence licence licences"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string")
    got = sorted(map(tuple, L.license_report(spark, df).collect()), key=str)
    assert got == sorted(brute(rows), key=str)
    ids = {r[0]: r[1:] for r in got}
    assert ids[1][0] == ids[2][0] == "MIT" and ids[3][0] is None and ids[4][0] == "BSD-3-Clause" and ids[9][0] == "ISC"
    assert ids[5] == (None, 3, "CC-BY-NC-4.0,MIT") and ids[6] == ids[7] == ids[8] == (None, 0, "") and ids[11][0] == "GPL-3.0-only"
    assert L.canonical("licence licence licences") == "license license licenses"


def test_documents_have_notices_and_plan_is_native(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.license_report(spark, docs)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows), key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_no_rows(spark):
    assert L.license_report(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_full_texts_with_and_without_titles(spark):
    import re
    import textwrap
    from pathlib import Path

    folder = Path("/usr/share/common-licenses")
    want = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only",
            "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3-only", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause"}
    texts = {name: (folder / file).read_text() for file, name in want.items()}
    apache, mpl = texts["Apache-2.0"], texts["MPL-2.0"]
    bsd3 = next(t for n, t in L.KNOWN if n == "BSD-3-Clause" and t.startswith("Redistribution"))
    isc = next(t for n, t in L.KNOWN if n == "ISC")
    rows = [*texts.items(), ("Apache-2.0", re.sub(r"(?s)^.*?TERMS AND", "TERMS AND", apache)), ("Apache-2.0", apache[: apache.index("   APPENDIX")]),
            ("MPL-2.0", mpl[mpl.index("1. Def") :].upper()), ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, A\n\n" + bsd3),
            ("BSD-3-Clause", "The 3-Clause BSD License\n" + "\n".join(textwrap.wrap(bsd3, 60))), ("ISC", "ISC License\n\nCopyright (c) 2020 A\n\n" + isc),
            (None, apache.replace("perpetual", "short")), ("Apache-2.0", "prose\n" + " ".join(apache.split()))]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = sorted(map(tuple, L.license_report(spark, df).collect()))
    assert got == sorted(brute([(i, t) for i, (_, t) in enumerate(rows)]))
    assert [g[1] for g in got[:-1]] == [n for n, _ in rows[:-1]]


def test_copyright_lines_without_a_year(spark):
    import re
    from pathlib import Path

    mit = next(t for n, t in L.KNOWN if n == "MIT" and t.startswith("Permission"))
    heads = [
        "Copyright (c) The Regents of the University of California.", "Copyright Jane Doe", "Copyright (c) <year> <copyright holders>",
        "// Copyright [yyyy] [name of copyright owner]", "(c) Copyright 2020 X", "Copyright: 2020 X", "Copyright: Jane", "© Jane Doe", "(C) Jane Doe",
        "# Copyright © 株式会社", "COPYRIGHT by The Authors", "Copyright2020 X", "Copyright The Rust Project", "Copyright Lawrence & Orson",
        "© Copyright Ünal", "Copyright Ünal",
    ]
    wording = ["copyright notice", "Copyright holders and", "copyright", '"Copyright" also means', "(c) You must retain", "(c) the licenses granted",
               "copyright the software, and", "copyright the", "copyright-like laws", "copyright law: that", "copyrighted by X", "(c) copyright notices"]
    assert all(re.search(L.COPYRIGHT_LINE, h.lower()) for h in heads) and not any(re.search(L.COPYRIGHT_LINE, w.lower()) for w in wording)
    rows = [(i, h + "\n\n" + mit) for i, h in enumerate(heads)] + [(100 + i, w + "\n\n" + mit) for i, w in enumerate(wording)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, L.license_report(spark, df).collect()))
    assert got == sorted(brute(rows)) and [g[1] for g in got] == ["MIT"] * len(heads) + [None] * len(wording)
    # wherever a known text is broken into lines, its own wording is no copyright line
    for path in sorted(Path("/usr/share/common-licenses").iterdir()):
        lines = [x for x in path.read_text().lower().split("\n") if not re.search(L.COPYRIGHT_LINE, x)]
        words = " ".join(lines).split()
        for i, w in enumerate(words):
            if re.match(r"[^a-z0-9]*(copyright|\(c\))", w) and words[i + 1 : i + 2] != ["(c)"] and words[i - 1] != "copyright":
                assert not any(re.search(L.COPYRIGHT_LINE, " ".join(words[i : i + k])) for k in (1, 2, 3, 9)), (path, words[i : i + 9])


def test_sql_reads_copyright_lines_alike(spark):
    import duckdb

    mit = next(t for n, t in L.KNOWN if n == "MIT" and t.startswith("Permission"))
    heads = ["Copyright Jane", "Copyright the software", "(c) Copyright 2020 X", "(c) You must", "© Ünal", "Copyright: X", "copyright notice", "Copyright Ü"]
    rows = [(i, h + "\n" + mit) for i, h in enumerate(heads)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert sorted(con.execute(L.REPORT_SQL).fetchall()) == sorted(brute(rows))
