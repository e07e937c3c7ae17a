"""Licences: whole texts with other holders, in comments and with other wrapping."""

from corpusloom.llm import licences


def test_whole_licence_texts_match_by_any_holder(spark):
    body = lambda name: (licences.TEXTS / f"{name}.txt").read_text()
    comment = lambda t, sign: "\n".join(f"{sign} {x}" for x in t.split("\n"))
    rows = {f.stem: (f"Copyright (c) 2031 Some Body\n\n{f.read_text()}", f.stem.split("--")[0]) for f in licences.TEXTS.glob("*.txt")}
    rows |= {
        "titled": ("The MIT License (MIT)\n\nCopyright (c) 2031 A. Nother <a@b.c>\n\n" + body("MIT"), "MIT"),
        "one line": ("MIT License\n© 2031 A. Nother\n" + " ".join(body("MIT").split()), "MIT"),
        "hash": (comment("Copyright 2031 A. Nother\n\n" + body("Apache-2.0--header"), "#"), "Apache-2.0"),
        "star": (comment("(c) 2031 A. Nother\n\n" + body("BSD-3-Clause"), " *"), "BSD-3-Clause"),
        "slash": (comment("Copyright 2031 A. Nother\n\n" + body("ISC"), "//"), "ISC"),
        "tag": ("// Copyright 2031 A. Nother\n// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
        "prose": ("no licence at all, copyright or not", None),
    }
    docs = spark.createDataFrame([(i, t, "s") for i, (t, _) in enumerate(rows.values())], "doc_id long, text string, source string")
    got = {r.doc_id: r.license_id for r in licences.scan(docs, licences.known_licences(spark)).collect()}
    assert {k: got[i] for i, k in enumerate(rows)} == {k: w for k, (_, w) in rows.items()}
