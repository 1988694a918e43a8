"""Expressions of tag lines, and short notices."""

from tesserine.llm import licenses


def test_expressions_and_short_notices(spark):
    texts = [
        "// SPDX-License-Identifier: Apache-2.0 OR MIT", "SPDX-License-Identifier: (GPL-2.0-only AND BSD-3-Clause) OR MPL-2.0 more", "SPDX-License-Identifier: MIT or something else",
        "SPDX-License-Identifier: MIT", "Licensed under the MPL 2.0", "BSD 3-Clause License", "Creative Commons Attribution-ShareAlike 4.0 International", "Apache-2.0 OR MIT without a tag", None,
    ]
    rows = {r.i: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()}
    tags = lambda i: sorted(x for x in rows[i].labels.split(",") if x.startswith("spdx:"))
    assert tags(0) == ["spdx:apache-2.0", "spdx:mit"] and tags(1) == ["spdx:bsd-3-clause", "spdx:gpl-2.0-only", "spdx:mpl-2.0"]
    assert tags(2) == ["spdx:mit"] == tags(3) and tags(7) == [] and rows[8].labels == ""
    assert [(n.label, n.first_word) for n in rows[0].notices if n.label.startswith("spdx:")] == [("spdx:apache-2.0", 0), ("spdx:mit", 7)]
    assert [rows[i].labels.split(",").count(x) for i, x in ((4, "mpl-2.0-notice"), (5, "bsd-3-clause-notice"), (6, "cc-by-sa-4.0-notice"))] == [1, 1, 1]
