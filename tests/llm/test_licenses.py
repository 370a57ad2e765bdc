from __future__ import annotations

import os
import textwrap

import duckdb
import oracle
import pytest

from pairloom.llm import licenses, registry


def scanned(spark, texts, known=licenses.KNOWN):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id int, text string, digest string")
    rows = licenses.scan(docs, licenses.known_digests(spark, known)).collect()
    return {r.doc_id: (r.license.license_id, r.license.notices) for r in rows}, {r.doc_id: r.license.digest for r in rows}


def test_whole_table(spark):
    assert oracle.differences(registry.op1_licenses, registry.oracle_sql()["op1_licenses"], spark) == ""


MIT = dict(licenses.KNOWN[:1])["MIT"]


def test_variants_of_a_whole_text(spark):
    texts = [
        MIT,
        "MIT License\n\nCopyright (c) 2021 Somebody\n\n" + MIT,
        "MIT License spelt otherwise\n" + MIT,
        "Copyright (c) 2021 Somebody\nAll rights reserved.\n\n" + MIT,
        "© 2020-2022 A, B\n" + MIT.upper().replace(",", " , ").replace("\n", "\r\n"),
        MIT.replace('"', "“").replace("sublicense", "sublicense  "),
        MIT[:-1] + " indeed",
        None,
        "",
        "Copyright 2020 X",
        "Released under the MIT Licence!",
        "Some prose.\n  released under the  MIT LICENSE\nmore prose\nLicensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0",
    ]
    found, digests = scanned(spark, texts)
    assert [found[k][0] for k in range(len(texts))] == ["MIT", "MIT", None, "MIT", "MIT", "MIT", None, None, None, None, "MIT", None]
    assert found[10][1] == ["MIT"] and found[11][1] == ["CC-BY-NC-4.0", "MIT"] and found[7][1] == []
    assert digests[7] == digests[8] == digests[9] and len(set(digests.values())) == 6


def test_very_long_and_empty(spark):
    found, _ = scanned(spark, ["word " * 200_000 + "\nReleased under the MIT License."])
    assert found[0] == (None, ["MIT"])
    assert scanned(spark, [])[0] == {}
    assert scanned(spark, ["Released under the MIT License."], [])[0] == {0: (None, [])}


def test_too_many_known(spark):
    with pytest.raises(ValueError):
        licenses.scan(spark.createDataFrame([(1, "a")], "doc_id int, text string"), licenses.known_digests(spark), max_known=3)


def test_only_copyright_lines_and_a_first_title_go(spark):
    texts = ["alpha\n1984 was a novel\nbeta", "alpha\nbeta", "alpha\n(c) 1984 A. Writer\nbeta", "alpha\n© Writer\nCopyright 1984\nbeta", "alpha\nCopyright law is old\nbeta", "alpha\nMIT License\nbeta", "MIT License\nalpha\nbeta"]
    _, d = scanned(spark, texts)
    assert d[1] == d[2] == d[6] and len({d[k] for k in (0, 1, 3, 4, 5)}) == 5


FILES = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(FILES), reason="no licence files")
def test_files_as_they_are_shipped(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    assert set(names) == {i for i, _ in licenses.KNOWN_DIGESTS}
    texts = [open(f"{FILES}/{f}", encoding="utf-8").read() for f in names.values()]
    apache = texts[0].replace("[yyyy] [name of copyright owner]", "2019 Some Company").replace("http:", "https:")
    bsd = "BSD 3-Clause License\n\nCopyright (c) 2020, the authors\nAll rights reserved.\n\n" + textwrap.fill(dict(licenses.KNOWN)["BSD-3-Clause"], 78)
    found, _ = scanned(spark, [*texts, apache, bsd])
    assert [found[k][0] for k in range(len(found))] == [*names, "Apache-2.0", "BSD-3-Clause"]


def test_sql_over_odd_texts(spark):
    texts = ["MIT License\n" + MIT, "© 2020 x\n" + MIT, "1984 a", None, "", "(C) Copyright 2001\nReleased under the MIT licence", "ISC License\nISC License", "a https://b"]
    con = duckdb.connect()
    con.register("documents", spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").toArrow())
    want = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, digest, license_id, notices FROM ({licenses.scan_sql()})").fetchall()}
    found, digests = scanned(spark, texts)
    assert want == {k: (digests[k], found[k][0], ",".join(found[k][1])) for k in digests}
