import re
import textwrap

from assayframe.llm import license_scan as m


def scan(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, license_id string, digest string")
    return {(r["doc_id"], r["license_id"]): (r["whole"], r["n_lines"]) for r in m.scan_licenses(docs).collect()}


def test_forms_of_a_license(spark):
    wrapped = "Copyright (c) 2020 Someone\n(c) 1999 X\n\n" + m.MIT.upper().replace("SOFTWARE", "software").replace(",", " ,") + "\n© Y"
    got = scan(spark, [(1, wrapped, None, None), (2, m.MIT.replace("permission", "permision", 1), "a", "b"), (3, "«Licenced» under the APACHE licence, version 2.0", None, None)])
    assert got[1, "MIT"][0] is True and (2, "MIT") not in got
    got = scan(spark, [(3, "licensed under the APACHE licence, v2", None, None), (4, "first\nAll rights reserved\nlast\n  all RIGHTS reserved.", None, None)])
    assert got == {(3, "Apache-2.0"): (True, 1), (4, "reserved"): (False, 2)}


def test_odd_rows(spark, odd_docs, no_docs):
    assert m.scan_licenses(odd_docs).count() == 0 and m.scan_licenses(no_docs).count() == 0
    assert scan(spark, [(None, "All rights reserved.", None, None), (5, None, None, None), (6, "", None, None)]) == {(None, "reserved"): (True, 1)}


def test_no_python_in_the_plan(spark, docs, capsys):
    m.scan_licenses(docs).explain()
    assert "Python" not in (plan := capsys.readouterr().out) and "Arrow" not in plan


def test_own_licenses(spark):
    known = spark.createDataFrame([("own", "My words.")], "license_id string, text string")
    docs = spark.createDataFrame([(1, "my WORDS")], "doc_id bigint, text string")
    assert [tuple(r) for r in m.scan_licenses(docs, known).collect()] == [(1, "own", True, 1)]


def test_every_text_matches_however_it_is_wrapped(spark):
    rows, names = [], []
    for license_id, text in m.LICENSES + m.WHOLE_TEXTS:
        for width in (20, 33, 60, 72, 79, 400):
            for sign in ("", " * ", "# ", "//  "):
                lines = [line for part in text.split("\n") for line in textwrap.wrap(part, width, break_long_words=False) or [""]]
                rows.append((len(rows), "Copyright 2020 Some One\n" + "\n".join(sign + line for line in lines), None, None))
                names.append(license_id)
    got = scan(spark, rows)
    assert [(i, n) for i, n in enumerate(names) if not got.get((i, n), (False,))[0]] == []


def test_blanks_and_notices(spark):
    texts = ["Licensed under the Apache License, Version\n# 2.0.", "Licensed under the Apache License, Version  2.0."]
    texts += [notice + "\nAll rights reserved." for notice in ("Copyright Foo Inc.", "Copyright (c) Foo", "(c) Foo", "copyright: 2020 X", "© X", "Copyright by X", "Copyright The Foo")]
    got = scan(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    assert {i for (i, _), (whole, _) in got.items() if whole} == set(range(len(texts)))
    got = scan(spark, [(1, "copyright notice\nAll rights reserved.", None, None), (2, "(c) You must\nAll rights reserved.", None, None)])
    assert got == {(1, "reserved"): (False, 1), (2, "reserved"): (False, 1)}


def test_full_texts_are_found_as_wholes(spark):
    """Long licenses in another case, spelling, indent and year, with comment signs."""
    rows, names = [], []
    for license_id, text in m.full_texts():
        for sign, change in (("", str.upper), (" * ", str.lower), ("//   ", lambda t: re.sub(r"\b([Ll])icense", r"\1icence", t))):
            rows.append((len(rows), "Copyright (C) 2031 Some Body\n" + "\n".join(sign + change(line.strip()) for line in text.split("\n")), None, None))
            names.append(license_id)
    got = scan(spark, rows)
    assert len(rows) >= 27 and [(i, n) for i, n in enumerate(names) if not got.get((i, n), (False,))[0]] == []
