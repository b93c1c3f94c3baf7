from kerbflow.llm import licenses

ROWS = [
    ("/a/x.py", "Licensed under the Apache License, Version 2.0.\ncode code code " * 1 + "word " * 50),
    ("/a/LICENSE", "The MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("/a/b/c/y.py", "nothing here"), ("/a/b/c/y.py", "nothing here"), ("/a/b/COPYING", "Released under the GNU General Public License, version 3."), ("/a/bb/z.py", None), ("/q.py", ""),
    (None, "Released under the MIT License."), ("plain", "x"), ("/q/long.txt", "w " * 100_000 + ". Released under CC BY-NC 4.0. " + "w " * 10), ("/q/other.txt", "permission to enter the copyright office was late"),
]


def test_statements_and_inheritance(spark):
    df = spark.createDataFrame([(*r, "spare") for r in ROWS], "path string, text string, license string")
    got = {(r.path, r.license, r.found, r.folder) for r in licenses.scan(df).collect()}
    assert got == {
        ("/a/x.py", "Apache-2.0", "statement", None), ("/a/LICENSE", "MIT", "statement", None), ("/a/b/c/y.py", "GPL-3.0", "inherited", "/a/b"), ("/a/b/COPYING", "GPL-3.0", "statement", None),
        ("/a/bb/z.py", "MIT", "inherited", "/a"), ("/q.py", None, None, None), (None, "MIT", "statement", None), ("plain", None, None, None),
        ("/q/long.txt", "CC-BY-NC-4.0", "statement", None), ("/q/other.txt", None, None, None)}
    assert licenses.scan(df).count() == len(ROWS)


def test_templates_find_themselves(spark):
    rows = [(f"/f{i}", text) for i, (_, text) in enumerate(licenses.templates())]
    got = {r.path: r.license for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert [got[p] for p, _ in rows] == [spdx for spdx, _ in licenses.templates()]


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).collect() == []
