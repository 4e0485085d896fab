from lookout.llm.licenses import TEXTS, _values, scan


def test_full_texts_are_licence_files(spark):
    texts = dict(TEXTS)
    rows = [(k, f"p{k}/legal", f"Copyright (c) 2019-2024 Jane Doe and the Quux project\n\n{text}") for k, (_, text) in enumerate(TEXTS)]
    rows += [(100 + k, f"p{k}/src/a.txt", "nothing of it in here") for k in range(len(TEXTS))]
    rows += [(200 + k, f"q{k}/x.txt", f"other words {k} of some prose that is not about it") for k in range(100)]
    both = texts["MIT"] + "\n\n" + "unrelated words of a long story " * 60
    rows += [(300, "two/COPYING.md", both), (301, "two/in/b.c", "code")]
    got = {r.doc_id: r for r in scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    for k, (name, _) in enumerate(TEXTS):
        assert (got[k].license, got[k].is_license_file) == (name, True)
        assert (got[100 + k].inherited_license, got[100 + k].inherited_from) == (name, f"p{k}")
    assert got[300].license == "MIT" and got[300].is_license_file and got[301].inherited_license == "MIT"


def test_usual_headers(spark):
    apache = """/*
 * Copyright (C) 2020 Jane Doe. All rights reserved.
 *
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *      http://www.apache.org/licenses/LICENSE-2.0
 */
"""
    gpl = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
"""
    code = "\nint main(void) { return run(all, the, parts); }\n" * 30
    rows = [
        (1, "a/a.c", "Copyright (c) 2020 Jane Doe. All rights reserved.\n" + code),
        (2, "b/b.c", apache + code),
        (3, "c/c.py", "#!/usr/bin/x\n\n" + gpl + code),
        (4, "d/d.py", code),
    ]
    got = {r.doc_id: r for r in scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [(got[k].license, got[k].line, got[k].is_license_file) for k in (1, 2, 3, 4)] == [
        ("Proprietary", 0, False),
        ("Apache-2.0", 3, False),
        ("GPL-3.0", 2, False),
        (None, None, False),
    ]


def test_apostrophes(spark):
    rows = [(0, "X", "it's the author's licence \\ and so on")]
    assert [r.text for r in _values(spark, rows).collect()] == [rows[0][2]]
