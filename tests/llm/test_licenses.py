import re
import textwrap

import duckdb

from payflow.llm import licenses as L
from payflow.llm.license_texts import BODIES


def texts(prose):
    mit = BODIES["MIT"]
    return [(1, mit), (2, mit.upper().replace("\n", "\r\n")), (3, "  " + mit.replace("<year> <holder>", "2019, 2020 Some One")),
            (4, mit.replace("sublicense", "sub-licence").replace('"', "”")), (5, mit + " extra words"), (6, BODIES["BSD-3-Clause"]),
            (7, prose(10, 1) + "\nreleased under MIT licence\n" + prose(5, 2)), (8, "Licensed under the Apache License, Version 2.0."),
            (9, "Licensed under the Apache License v2.0\nLicensed under the Apache License v2.0"), (10, prose(20_000, 3)),
            (11, "This work is licensed under the GNU General Public License, version 3.\n"), (12, "SPDX-License-Identifier: MIT")]


def test_known_texts_are_found(docs_of, prose, odd):
    got = {(r["doc_id"], r["unit"], r["line_no"], r["license"]) for r in L.license_matches(docs_of(texts(prose) + odd)).collect()}
    whole = {(d, lic) for d, unit, _, lic in got if unit == "text"}
    assert {(i, "MIT") for i in (1, 2, 3, 4)} <= whole and (6, "BSD-3-Clause") in whole and not [d for d, _ in whole if d == 5]
    assert {(7, "line", 1, "MIT"), (8, "line", 0, "Apache-2.0"), (9, "line", 0, "Apache-2.0"), (9, "line", 1, "Apache-2.0"),
            (11, "line", 0, "GPL-3.0-only"), (12, "line", 0, "MIT")} <= got
    assert not [d for d, *_ in got if d in (None, 10)]


def test_equals_oracle(spark, docs_of, prose, odd):
    rows = texts(prose) + odd
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = L.license_matches(docs_of(rows))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(con.execute(L.oracle_sql()).fetchall(), key=repr)
    own = spark.createDataFrame([("own", "One!"), (None, None)], "license string, text string")
    assert {r["license"] for r in L.license_matches(docs_of(rows), own).collect()} == {"own"}
    assert L.license_matches(docs_of([])).count() == 0


def test_no_python_in_the_plan(docs_of, prose):
    plan = L.license_matches(docs_of(texts(prose)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def rewrapped(body, width):
    """The body with its prose wrapped anew, copyright notices on lines of their own."""
    out, held = [], []

    def flush():
        if held:
            out.append(textwrap.fill(" ".join(held), width, break_long_words=False, break_on_hyphens=False))
            held.clear()

    for line in body.splitlines():
        notice = re.match(r"\W*copyright (\(c\)|\[yyyy\])", line.lower())
        if notice or not line.strip():
            flush()
            out.append(line)
        else:
            held.append(line.strip())
    flush()
    return "\n".join(out)


def test_wrapped_and_long_bodies(docs_of):
    rows, want = [], set()
    for name, body in BODIES.items():
        for width in (40, 57, 60, 64, 70, 72, 77, 79, 80, 100, 10_000):
            want.add((len(rows), name))
            rows.append((len(rows), rewrapped(body, width)))
    for liable in range(20, 120):         # a wrapped line begins with 'copyright holders be liable' for some widths
        want.add((len(rows), "MIT"))
        rows.append((len(rows), rewrapped(BODIES["MIT"], liable)))
    assert any(re.search(r"(?m)^copyright holders be", t.lower()) for _, t in rows)
    assert {"Apache-2.0", "MPL-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-3.0-only", "CC0-1.0"} <= {n for _, n in want}
    for notice in ("Copyright Some One", "Copyright (c) Some One", "© Some One", "(c) 2019 Some One", "Copyright 2019-2021, Some One",
                   "Copyright: Noël", "Copyrighted 2010 by X", "Copyrights 2010 X", "Copyright 漢字", "Copyright The Foo Authors", "copyright by Orla", "Copyright Lawson and Sons",
                   "Copyright Noti", "Copyright ACME. All rights reserved."):
        want.add((len(rows), "MIT"))
        rows.append((len(rows), BODIES["MIT"].replace("Copyright (c) <year> <holder>", notice)))
    apache = BODIES["Apache-2.0"]
    want |= {(len(rows), "Apache-2.0"), (len(rows) + 1, "Apache-2.0")}
    rows += [(len(rows), apache.replace("[yyyy] [name of copyright owner]", "2020 Some One")),
             (len(rows) + 1, apache[:apache.index("APPENDIX")])]
    got = L.license_matches(docs_of(rows)).where("unit = 'text'").select("doc_id", "license", "digest").collect()
    assert {(r[0], r[1]) for r in got} == want
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    theirs = con.execute(f"SELECT doc_id, license, digest FROM ({L.oracle_sql()}) WHERE unit = 'text'").fetchall()
    assert sorted(map(tuple, got)) == sorted(theirs)
