"""License scans of real licence texts, as files and as notices."""

import os

import pytest

from netweft.llm import license_texts, licenses

COMMON = "/usr/share/common-licenses"
MIT = f"MIT License\n\nCopyright (c) 2021 Jane Doe\n\n{license_texts._MIT}\n"
BSD = "Copyright (c) 2015, Some Company\nAll rights reserved.\n\n" + license_texts.WHOLE["BSD-3-Clause"][0]


def comment(text, sign):
    return "\n".join(f"{sign} {x}".rstrip() for x in text.split("\n"))


def wrapped(text, width=70):
    out, line = [], ""
    for w in text.split(" "):
        if len(line) + len(w) > width:
            out.append(line)
            line = ""
        line = f"{line} {w}".strip()
    return "\n".join([*out, line])


CASES = {
    "mit/LICENSE": (MIT, "MIT"),
    "mit2/LICENSE.txt": (MIT.split("\n", 4)[-1], "MIT"),  # without its title
    "mit3/a.py": (comment(wrapped(license_texts._MIT.split("\n")[0]), "#") + "\nimport x\n", "MIT"),
    "bsd3/LICENSE": (BSD, "BSD-3-Clause"),
    "bsd3/LICENCE": (wrapped(BSD.replace("the copyright holder nor", "Some Company nor")), "BSD-3-Clause"),
    "bsd2/LICENSE": ("Copyright (c) 2015, X\nAll rights reserved.\n\n" + license_texts.WHOLE["BSD-2-Clause"][0], "BSD-2-Clause"),
    "isc/LICENSE": ("ISC License\n\nCopyright (c) 2004-2010 by Someone\n\n" + license_texts.WHOLE["ISC"][0], "ISC"),
    "a/Main.java": ("/*\n" + comment("Copyright 2019 The Authors\n\n" + "\n\n".join(wrapped(x) for x in license_texts._APACHE.split("\n\n")), " *") + "\n */\npackage x;\n", "Apache-2.0"),
    "a/gpl.c": ("/* prog.c\n\n" + comment("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.", " *") + "\n */\n", "GPL-3.0"),
    "a/gpl2.c": ("This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.\n", "GPL-2.0"),
    "a/mpl.js": ("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */\n", "MPL-2.0"),
    "a/spdx.rs": ("// SPDX-License-Identifier: Apache-2.0\nfn main() {}\n", "Apache-2.0"),
    "a/spdx.c": ("/* SPDX-License-Identifier: GPL-2.0-only */\n", "GPL-2.0"),
    "a/spdx2.c": ("# SPDX-License-Identifier: MIT\nint x;", "MIT"),
    "u/UNLICENSE": (license_texts._UNLICENSE, "Unlicense"),
    "n/notice.txt": ("Text. Licensed under the Apache License, Version 2.0. And more text that goes on and on and says nothing at all.", "Apache-2.0"),
    "n/reserved.txt": ("Some text here.\nCopyright (c) Some Company. All rights reserved.\n", "Proprietary"),
    "n/none.txt": ("He asked for permission to use the copyright office's licence plates.\n", None),
    "n/long.txt": ("word " * 200_000 + "licence\n" * 20_000 + "\n" * 100_000, None),
}


@pytest.fixture(scope="module")
def got(spark):
    cases = {k: t for k, (t, _) in CASES.items()}
    for k, t in enumerate(x for name, texts in license_texts.STATEMENTS.items() for x in texts):
        cases[f"s{k}/x.txt"] = t
    for f in ("Apache-2.0", "GPL-2", "GPL-3", "LGPL-3", "LGPL-2.1", "MPL-2.0"):
        if os.path.exists(f"{COMMON}/{f}"):
            cases[f"{f}/COPYING"] = open(f"{COMMON}/{f}", encoding="utf-8", errors="replace").read()
    rows = [(k, p, t) for k, (p, t) in enumerate(cases.items())]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string").repartition(4)
    return {r["path"]: r for r in licenses.scan(df).collect()}


@pytest.mark.parametrize("path", sorted(CASES))
def test_real_texts(got, path):
    assert got[path]["license"] == CASES[path][1]


def test_statements_are_their_licence(got):
    for k, (name, text) in enumerate((n, x) for n, texts in license_texts.STATEMENTS.items() for x in texts):
        assert got[f"s{k}/x.txt"]["license"] == name, text


@pytest.mark.parametrize("file,name", [("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-3", "LGPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0")])
def test_licence_files_of_the_system(got, file, name):
    if f"{file}/COPYING" not in got:
        pytest.skip("the system has no such file")
    assert got[f"{file}/COPYING"]["license"] == name


def test_edges(spark):
    schema = "doc_id long, path string, text string, license string, row int, dir string, cosine double"
    rows = [(1, "d/LICENSE", "MIT License"), (1, "d/LICENSE", "MIT License"), (2, "d/LICENCE", "Apache License Version 2.0, January 2004"), (None, "d/x", None), (3, None, "MIT License"), (4, None, ""), (5, "d/e/f/y", "")]
    df = spark.createDataFrame([(*r, "clash", 1, "clash", 0.5) for r in rows], schema)
    got = sorted(((r["doc_id"], r["license"], r["inherited_from"]) for r in licenses.scan(df).collect()), key=repr)
    # Two licence files of equal cosine: the smaller name is inherited.
    want = [(1, "MIT", None), (1, "MIT", None), (2, "Apache-2.0", None), (3, "MIT", None), (4, None, None), (5, "Apache-2.0", "d"), (None, "Apache-2.0", "d")]
    assert got == sorted(want, key=repr)
    assert licenses.scan(df.where("doc_id > 99")).count() == 0
