"""op6_license_scan: notices as they are published, hard-wrapped and behind comment marks."""

from __future__ import annotations

import textwrap

from palisade.llm import license_rules

TEXT = dict(license_rules.SENTENCES)


def test_wrapped_notices(spark):
    mit = "\n\n".join(textwrap.fill(TEXT[i], 70) for i in ("mit.grant", "mit.notice"))
    apache = "\n".join("# " + x for x in textwrap.wrap(TEXT["apache.notice.1"], 60))
    apache += "\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\n"
    gpl = " * " + "\n * ".join(textwrap.wrap(TEXT["gpl.redistribute"], 60)) + "\n *\n * " + "\n * ".join(textwrap.wrap(TEXT["gpl.warranty"], 60))
    rows = [(1, "Copyright (c) 2020 X\n\n" + mit), (2, apache), (3, "/*\n" + gpl + "\n */"), (4, "It was not released under the MIT\nLicense yet."), (5, "Released under the MIT\nLicense.\nAll rights reserved.")]
    got = {r.doc_id: r for r in license_rules.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[i].licenses, got[i].n_sentences) for i in range(1, 6)] == [("MIT", 2), ("Apache-2.0", 2), ("GPL-3.0-or-later", 2), ("", 0), ("MIT", 2)]
