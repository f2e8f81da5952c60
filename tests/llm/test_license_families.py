"""Families that differ by a word, what is calibrated, and scores against plain arithmetic."""

import math
import re

import pytest

from lifecurve.llm import licenses

PROSE = "the river was high that winter and nobody crossed it by the old bridge " * 30
CASES = {
    "This work is licensed under the GNU Lesser General Public License, version 3.": ["lgpl"],
    "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation": ["lgpl"],
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published": ["agpl"],
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published": ["gpl"],
    "Licensed under CC BY-NC-ND 4.0.": ["cc-by-nc-nd"], "Licensed under CC BY-NC 4.0.": ["cc-by-nc"], "Licensed under CC BY 4.0.": ["cc-by"], "Licensed under CC BY-ND 4.0.": ["cc-by-nd"],
    "SPDX-License-Identifier: LGPL-3.0-or-later": ["lgpl"], "SPDX-License-Identifier: AGPL-3.0-or-later": ["agpl"], "SPDX-License-Identifier: EPL-2.0": ["epl"],
    "Licensed under the GNU General Public License, version 2.": ["gpl"], "Licensed under the Eclipse Public License, version 2.0.": ["epl"],
    "This work is licensed under the GNU Strange General Public License, version 3.": [], "Licensed under the Odd Apache License, Version 2.0.": [],
    "SPDX-License-Identifier: XGPL-3.0-or-later": [], "Mit dem Haus und mit der Stadt ging er mit.": [], "you may not use any part of it": [],
    f"{PROSE} Released under the MIT License. {PROSE} All rights reserved. {PROSE}": ["mit", "reserved"],
}


@pytest.fixture(scope="module")
def model(docs):
    return licenses.fit(docs)


def test_families(spark, model):
    table = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    got = {r["doc_id"]: r["families"] for r in licenses.scan(table, model).collect()}
    assert got == dict(enumerate(CASES.values()))


def plain_words(text):
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def test_scores_equal_plain_arithmetic(spark, model):
    """Probabilities of predicted windows, from the weights of all their terms, window by window, without any shortcut."""
    texts = [*CASES, PROSE, " ".join(plain_words(" ".join(CASES)))]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = licenses.marked(table, model)
    found = {}
    ids = {r["_row"]: r["doc_id"] for r in kept.collect()}
    for r in licenses.scan_paragraphs(kept, model).collect():
        found[ids[r["_row"]], r["family"]] = r["probability"]
    for k, text in enumerate(texts):
        said = plain_words(text)
        for at in range(0, max(1, len(said)), licenses.STEP):
            part = said[at : at + licenses.WINDOW]
            terms = {*part, *(f"{a} {b}" for a, b in zip(part, part[1:], strict=False))}
            s = [i + sum(model.weights[t][c] for t in terms if t in model.weights) for c, i in enumerate(model.intercepts)]
            whole = [math.exp((x - max(s)) / model.temperature) for x in s]
            best = max(range(len(s) - 1), key=lambda c: s[c])
            p = whole[best] / sum(whole)
            if p >= model.accepted:
                assert found[k, model.classes[best]] >= p - 1e-9, (text, model.classes[best])


def test_triggers_cover_what_counts(model):
    taken = set(model.triggers())
    lightest = sum(g for w, g in model.gains().items() if w not in taken)
    assert lightest < model.lead()
    for (_, said), (need, _) in zip(model.templates, model.needed(licenses.CONFIRM_SHARE), strict=True):
        assert sum(w not in taken for w in said) < need


def test_shares_add_up_for_every_way_to_agree(model):
    """Whatever places of a template are left out, what is left reaches one."""
    import random

    rnd, shares = random.Random(2), model.shares(licenses.CONFIRM_SHARE)
    for (_, said), (need, kinds) in zip(model.templates, model.needed(licenses.CONFIRM_SHARE), strict=True):
        for _ in range(200):
            agree = {said[k] for k in rnd.sample(range(len(said)), need)}
            assert len(agree) >= kinds and all(sum(shares[w][k] for w in agree) >= 1 - 1e-9 for k in (0, 1))
