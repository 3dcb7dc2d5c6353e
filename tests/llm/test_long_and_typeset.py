"""Very long texts in the toxicity terms, and licences as typesetting leaves them."""

import random

import numpy as np


def test_licenses_with_typeset_marks(spark):
    """Curly quotes, dashes, spaces that do not break, soft hyphens and byte order marks are punctuation."""
    from millrace.llm.license_scan import FURTHER, TEXTS, license_scan

    def curly(text):
        return text.replace(' "', " “").replace('"', "”").replace("'", "’")

    rows = [
        (curly(TEXTS["MIT"]), "MIT"), ("﻿" + TEXTS["MIT"], "MIT"), (TEXTS["ISC"].replace(" ", " ", 3), "ISC"), (TEXTS["Zlib"].replace("warranty", "war­ranty"), "Zlib"),
        (curly(TEXTS["0BSD"]).replace(", ", ", "), "0BSD"), ("Copyright © 2020 Some’one\n\n" + curly(TEXTS["MIT"]), "MIT"), (curly(FURTHER[0][1]), "BSD-2-Clause"),
        (curly(TEXTS["MIT"]) + " and more", None), ("“ ”", None), ("﻿", None),
    ]
    table = spark.createDataFrame([(k, t, 1, "x") for k, (t, _) in enumerate(rows)], "doc_id long, text string, own int, lines string")
    assert {r.doc_id: r.license for r in license_scan(table).collect()} == {k: name for k, (_, name) in enumerate(rows)}
    line = spark.createDataFrame([(1, "a\n“Released under the MIT License.”\nb")], "doc_id long, text string")
    assert [(r.line_licenses, r.n_license_lines) for r in license_scan(line).collect()] == [("MIT", 1)]


def test_terms_of_long_texts_are_those_of_short_ones(monkeypatch):
    """A long text gives the same terms in parts as at once, also where a word is longer than a part."""
    from millrace.llm import toxicity

    rng = random.Random(1)
    words = ["".join(rng.choices("abcXYé1", k=rng.randint(1, 12))) for _ in range(500)]
    texts = [(" ".join(rng.choices(words, k=120_000))).encode(), b"short one", b"", b"x" * 700_000 + b" tail " + b"y" * 300_000, b"z" * 600_000, " .,".join(rng.choices(words, k=60_000)).encode()]
    keep = np.where(np.arange(toxicity.BUCKETS) % 7 == 0, np.arange(toxicity.BUCKETS) // 7, -1)
    for kept in (None, keep):
        parts = list(toxicity.hashed_terms(texts, kept))
        with monkeypatch.context() as patch:
            patch.setattr(toxicity, "_parts", lambda text: iter([(0, len(text))]))
            whole = list(toxicity.hashed_terms(texts, kept))
        assert len(parts) == len(whole) and all((a == b).all() and len(a) == len(b) for a, b in zip(parts, whole, strict=True))
    for text in texts:
        cuts = list(toxicity._parts(text))
        assert [a for a, _ in cuts] == [0, *[b for _, b in cuts]][: len(cuts)] and (not text or cuts[-1][1] == len(text))
