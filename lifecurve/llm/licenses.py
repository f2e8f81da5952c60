"""Licence scans by a trained paragraph classifier (operator 9).

Paragraphs are what stands between lines without words, so hard-wrapped notices and comments are whole; they are read
in overlapping windows of 64 words. Their features are the words and word pairs that occur in any template. A multinomial
logistic regression with an absolute penalty (few non-zero weights) is fitted on templates, whole, cut and
amid other words, against a bounded sample of paragraphs (``negative_docs`` documents, the first ``NEGATIVE_LINES`` lines of
each, ``NOISE`` of them as words around templates) without any licence word, and some sentences that only sound alike. The
class ``unknown`` stands for everything else. A fifth of all rows, licence rows too, is held out: there the scores are
calibrated by a temperature, and the least accepted probability is set so that no held-out unknown paragraph passes.

A template confirms a family where its words lie on the text's in one alignment: at least ``confirm_share`` of them agree,
and no unseen word (other than a number) stands among those that agree, be it put in or in place of another; so the
notice of a licence that only adds a word to a known name (Lesser, Affero, ND) is not taken for it. The family must be the predicted
one, or the alignment must hold that share of the word triples that no other family has.

Scoring is exact although sparse. A paragraph is split only if it holds one of ``triggers``: the words left out of
these are so few and light that no window of them alone can be accepted, or agree with enough of a template. Of its windows only those
go on whose words, each counted with all that it can give to any class, reach the least accepted score, or that hold enough of
a template's words; so a common word (German ``mit``) does not open a window by itself. Scores and alignments are
functions of the window's array of words: no word becomes a row, and only families that are found are grouped.

Only DataFrame functions and the JVM's fitting are used. Odd input: null and empty texts have no
paragraphs; repeated rows are repeated; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from itertools import chain

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lifecurve.llm.common import add_row, materialize

NEGATIVE_DOCS = 300
NEGATIVE_LINES = 40
NOISE = 40
CONFIRM_SHARE = 0.6
UNKNOWN = "unknown"
#: Words of a window, and how far the next one begins: a template of up to ``STEP`` words lies whole in one of them.
WINDOW, STEP = 64, 32
TEMPLATE_ARRAY = "array<struct<family: string, said: array<string>, words: array<string>, need: int, kinds: int, own: array<boolean>, n_own: int>>"
#: What parts paragraphs: lines without letters or digits, be they blank or nothing but comment marks.
BLANK = r"\n(?:[^\p{L}\p{N}\n]*+\n)++"
#: Comment marks that are words; others are no words anyway.
WORD_MARK = r"(?im)^[ \t]*(?:rem|dnl)[ \t]+"
WORD_GAP = r"[^\p{L}\p{N}]+"
TEMPERATURES = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)
#: Sentences of licence notices by family.
TEMPLATES = {
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc-by-nc-nd": [
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-ND-4.0",
    ],
    "cc-by-nc-sa": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-SA-4.0",
    ],
    "cc-by-nd": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-ND-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "epl": [
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "reserved": [
        "All rights reserved.",
        "Copyright by the authors. All rights reserved. No part of this publication may be reproduced without permission.",
    ],
}
#: Sentences with words of notices that are none.
ALIKE = [
    "The driver lost a license after the second warning.",
    "A fishing license is valid for one year.",
    "Version 2.0 of the plan is under review.",
    "The work was released to the public in May.",
    "Members of the general public are free to visit the house.",
    "It is under the table by the door.",
    "Permission to use the hall was given by the council.",
    "This is the version that I use.",
    "The terms of the contract are as follows.",
    "He works under the name of Creative Sound.",
    "All of this is licensed software from an unknown source.",
    "The source of the river is subject to change.",
    "You may obtain a copy at the office.",
    "Rights and duties of the tenant.",
    "The Apache people lived by the river under the cliffs.",
    "The commons were open to sheep and free to use.",
]


def words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), WORD_GAP), lambda w: w != "")


def terms(said: Column) -> Column:
    """Words and word pairs of an array of words."""
    pairs = F.zip_with(said, F.slice(said, 2, F.lit(2147483647)), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(said, F.filter(pairs, lambda p: p.contains(" ")))


def triples(said: Column) -> Column:
    """Distinct word triples; fewer words are one."""
    n = F.size(said)
    three = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(said, i, 3)))
    return F.array_distinct(three)


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of given values, as one literal."""
    names = [c.split(" ")[0] for c in schema.split(", ")]
    said = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    fields = ", ".join(c.replace(" ", ": ") for c in schema.split(", "))
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(said), f"array<struct<{fields}>>")))


@dataclass
class Model:
    """Weights of terms for each class, and how scores become accepted predictions.

    templates: (family, words) each; common: in how many sampled negative paragraphs a word of the vocabulary occurs.
    """

    classes: list[str]
    intercepts: list[float]
    weights: dict[str, list[float]]
    templates: list[tuple[str, list[str]]]
    common: dict[str, int]
    temperature: float
    accepted: float

    def own_triples(self) -> list[list[bool]]:
        """For each template and place in it, whether no other family has the word triple that begins there."""
        of: dict[str, set[str]] = {}
        for f, said in self.templates:
            for k in range(max(1, len(said) - 2)):
                of.setdefault(" ".join(said[k : k + 3]), set()).add(f)
        return [[k < max(1, len(said) - 2) and len(of[" ".join(said[k : k + 3])]) == 1 for k in range(len(said))] for _, said in self.templates]

    def needed(self, confirm_share: float) -> list[tuple[int, int]]:
        """For each template, how many of its places must agree, and how many different words that takes at least."""
        out = []
        for _, said in self.templates:
            need, left, words_ = math.ceil(confirm_share * len(said) - 1e-9), 0, 0
            for n in sorted(Counter(said).values(), reverse=True):
                if left < need:
                    left, words_ = left + n, words_ + 1
            out.append((need, words_))
        return out

    def shares(self, confirm_share: float) -> dict[str, tuple[float, float]]:
        """Two parts for each word of the templates; both add up to one over the words of a window that holds enough of a template.

        The first counts 1 / kinds for every word of a template of which ``kinds`` different ones are needed. The second looks
        at words that the sample does not know: of n places ``need`` must agree, so at most n - need are missing, and each
        of the k others counts 1 / k; templates without such words count all of theirs.
        """
        out: dict[str, float] = {}
        plain: dict[str, float] = {}
        for (_, said), (need, kinds) in zip(self.templates, self.needed(confirm_share), strict=True):
            rare = {w for w in said if not self.common.get(w, 0)}
            times = sorted((n for w, n in Counter(said).items() if w in rare), reverse=True)
            missing, k = len(said) - need, len(rare)
            for n in reversed(times):  # the most different words that can be missing
                if n <= missing:
                    missing, k = missing - n, k - 1
            for w in rare if k else set(said):
                out[w] = max(out.get(w, 0.0), 1 / (k or kinds))
            for w in said:
                plain[w] = max(plain.get(w, 0.0), 1 / kinds)
        return {w: (p, out.get(w, 0.0)) for w, p in sorted(plain.items())}

    def gains(self) -> dict[str, float]:
        """The most that a word can add to the lead of any class over ``unknown``, with all pairs that it is part of."""
        unknown, out = len(self.classes) - 1, {}
        for t, w in self.weights.items():
            most = max(0.0, max(w[c] - w[unknown] for c in range(unknown)))
            for word in set(t.split(" ")):
                out[word] = out.get(word, 0.0) + most
        return out

    def lead(self) -> float:
        """The least lead over ``unknown`` that is accepted."""
        unknown = len(self.classes) - 1
        odds = math.log(self.accepted / (1 - self.accepted)) * self.temperature if self.accepted < 1 else math.inf
        return min(odds - (self.intercepts[c] - self.intercepts[unknown]) for c in range(unknown)) - 1e-6

    def triggers(self, confirm_share: float = CONFIRM_SHARE) -> list[str]:
        """Words of which every window or alignment that counts holds one: all but the commonest that can be left out."""
        rare = lambda w: (self.common.get(w, 0), w)
        gains, lead = self.gains(), self.lead()
        left, taken = 0.0, set()
        for w in sorted(gains, key=rare, reverse=True):
            if left + gains[w] < lead:
                left += gains[w]
            else:
                taken.add(w)
        for (_, said), (need, _) in zip(self.templates, self.needed(confirm_share), strict=True):
            times, open_ = Counter(said), len(said) - need + 1
            open_ -= sum(n for w, n in times.items() if w in taken)
            for w in sorted(times, key=rare):
                if open_ > 0 and w not in taken:
                    taken.add(w)
                    open_ -= times[w]
        return sorted(taken)


def _training(docs: DataFrame, negative_docs: int, id_col: str, text_col: str) -> DataFrame:
    """(family, said): paragraphs as arrays of words, all of bounded number."""
    spark = docs.sparkSession
    templates = literal_rows(spark, [(f, t) for f, ts in TEMPLATES.items() for t in ts], "family string, text string")
    alike = literal_rows(spark, [(UNKNOWN, t) for t in ALIKE], "family string, text string")
    mark = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 40))
    n = docs.where(F.col(text_col).isNotNull()).count()
    rate = min(1.0, 1.5 * negative_docs / max(n, 1))
    near = docs.where(F.col(text_col).isNotNull() & (mark <= rate * (1 << 40))).select(mark.alias("mark"), F.substring(F.col(text_col), 1, NEGATIVE_LINES * 1000).alias("text"))
    sample = near.orderBy("mark", "text").limit(negative_docs)
    lines = sample.select(F.explode(F.slice(F.split("text", "\n"), 1, NEGATIVE_LINES)).alias("text"))
    plain = lines.where(~F.lower("text").rlike("licen[cs]|copyright|spdx|all rights reserved|permission|redistribut")).withColumn("family", F.lit(UNKNOWN))
    noise = plain.select(F.slice(words(F.col("text")), 1, 8).alias("near")).where("size(near) > 2").orderBy(F.xxhash64("near"), "near").limit(NOISE)
    spoken = templates.select("family", words(F.col("text")).alias("said"))
    size = F.size("said")
    halves = spoken.where("size(said) > 14").select("family", F.explode(F.array(F.slice("said", F.lit(1), F.ceil(size * 0.6).cast("int")), F.slice("said", F.floor(size * 0.4).cast("int") + 1, size))).alias("said"))
    base = spoken.union(halves)
    said_near = [r["near"] for r in noise.collect()] or [["some", "other", "words"]]
    amid = base.select("family", "said", F.explode(F.array(*[F.array(*map(F.lit, near)) for near in said_near])).alias("near"))
    amid = amid.select("family", F.explode(F.array(F.concat("said", "near"), F.concat("near", "said"))).alias("said"))
    other = plain.union(alike.select("text", "family")).select("family", words(F.col("text")).alias("said"))
    repeated = alike.select("family", words(F.col("text")).alias("said"), F.explode(F.sequence(F.lit(1), F.lit(20))).alias("k")).drop("k")
    return base.union(amid).union(other).union(repeated)


def fit(docs: DataFrame, *, negative_docs: int = NEGATIVE_DOCS, penalty: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the templates and a bounded sample of paragraphs."""
    spark = docs.sparkSession
    vocabulary = sorted({t for r in literal_rows(spark, [(t,) for t in chain(*TEMPLATES.values())], "text string").select(terms(words(F.col("text"))).alias("t")).collect() for t in r["t"]})
    classes = [*sorted(TEMPLATES), UNKNOWN]
    rows = _training(docs, negative_docs, id_col, text_col).select("family", terms(F.col("said")).alias("terms"))
    label = F.element_at(F.create_map(*[F.lit(x) for k, c in enumerate(classes) for x in (c, float(k))]), F.col("family"))
    rows = rows.select(label.alias("label"), "terms", (F.pmod(F.xxhash64("terms"), F.lit(5)) == 0).alias("held"))
    counted = CountVectorizerModel.from_vocabulary(vocabulary, "terms", "features", minTF=1.0).setBinary(True).transform(rows).select("label", "features", "held").coalesce(2)
    counted.persist()
    seen = rows.where(F.col("label") == len(classes) - 1).select(F.explode("terms").alias("w")).where(~F.col("w").contains(" ")).groupBy("w").count()
    try:
        common = {r["w"]: r["count"] for r in seen.join(F.broadcast(literal_rows(spark, [(v,) for v in vocabulary], "w string")), "w").collect()}
        found = LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=penalty, maxIter=40, standardization=False).fit(counted.where(~F.col("held")).select("label", "features"))
        raw = found.transform(counted.where("held")).select(F.col("label").cast("int").alias("y"), vector_to_array("rawPrediction").alias("s"))
        scored = raw.select("y", "s", F.explode(F.array(*map(F.lit, TEMPERATURES))).alias("t"))
        right = share(F.element_at("s", F.col("y") + 1), F.col("t"))
        best = share(F.array_max(F.slice("s", 1, len(classes) - 1)), F.col("t"))
        scored = scored.select("y", "t", right.alias("right"), best.alias("best"))
        worst = F.max(F.when(F.col("y") == len(classes) - 1, F.col("best"))).alias("worst")
        tried = scored.groupBy("t").agg(F.sum(-F.log(F.greatest("right", F.lit(1e-12)))).alias("loss"), worst)
        results = sorted((r["loss"], r["t"], r["worst"] or 0.0) for r in tried.collect())
    finally:
        counted.unpersist()
    _, temperature, worst = results[0] if results else (0.0, 1.0, 0.0)
    table = found.coefficientMatrix.toArray()
    weights = {t: table[:, k].tolist() for k, t in enumerate(vocabulary) if abs(table[:, k]).max() > 0}
    spoken = literal_rows(spark, [(k, f, t) for k, (f, t) in enumerate((f, t) for f, ts in TEMPLATES.items() for t in ts)], "k int, family string, text string")
    templates = [(r["family"], r["said"]) for r in spoken.select("k", "family", words(F.col("text")).alias("said")).orderBy("k").collect()]
    return Model(classes, found.interceptVector.toArray().tolist(), weights, templates, common, temperature, max(0.5, worst + 0.01))


def share(score: Column, temperature: Column) -> Column:
    """Calibrated probability of one of the scores in the array s."""
    top = F.array_max("s")
    whole = F.aggregate("s", F.lit(0.0), lambda total, x: total + F.exp((x - top) / temperature))
    return F.exp((score - top) / temperature) / whole


def paragraphs(text: Column) -> Column:
    """The parts of a text between blank lines, those with words."""
    return F.filter(F.split(F.regexp_replace(text, WORD_MARK, ""), BLANK), lambda p: p.rlike(r"[\p{L}\p{N}]"))


def marked(docs: DataFrame, model: Model, *, confirm_share: float = CONFIRM_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_row, doc_id, n_paragraphs, parts), written once: parts are the paragraphs that hold a trigger, with their place."""
    all_parts = F.transform(F.coalesce(paragraphs(F.col(text_col)), F.array().cast("array<string>")), lambda p, i: F.struct(i.alias("paragraph"), p.alias("part")))
    said = model.triggers(confirm_share)
    holds = r"(?<![\p{L}\p{N}])(?:" + "|".join(said) + r")(?![\p{L}\p{N}])"
    numbered = add_row(docs.select(F.col(id_col).cast("long").alias("doc_id"), all_parts.alias("all")))
    return materialize(numbered.select("_row", "doc_id", F.size("all").cast("long").alias("n_paragraphs"), F.filter("all", lambda p: F.lower(p["part"]).rlike(holds)).alias("parts")))


def _templates(model: Model, confirm_share: float) -> Column:
    """All templates: family, words, need (places that must agree), kinds (different words that takes), own (places of own triples), n_own."""
    rows = []
    for (f, said), own, (need, kinds) in zip(model.templates, model.own_triples(), model.needed(confirm_share), strict=True):
        rows.append({"family": f, "said": said, "words": sorted(set(said)), "need": need, "kinds": kinds, "own": own, "n_own": sum(own)})
    return F.from_json(F.lit(json.dumps(rows)), TEMPLATE_ARRAY)


def pieces(kept: DataFrame, model: Model, confirm_share: float) -> DataFrame:
    """(_row, paragraph, at, ws, near), written once: the words from every ``STEP``-th on that a window or a template takes.

    Only those that can be accepted, or hold enough of a template's words; near: such templates.
    """
    longest = max(len(ws) for _, ws in model.templates)
    width = max(WINDOW, STEP + longest + 3)
    said = kept.select("_row", F.inline("parts")).select("_row", "paragraph", words(F.col("part")).alias("said"))
    # Written, as the planner would put the splitting in place of every use of the words, inside the windows too.
    said = materialize(said)
    gains = {w: g for w, g in sorted(model.gains().items()) if g > 0}
    weight = F.create_map(*[F.lit(x) for wg in gains.items() for x in wg]) if gains else None
    shares, templates = model.shares(confirm_share), F.col("templates")
    # One row with all templates beside every paragraph, so that they are read once and not for each window.
    one = kept.sparkSession.range(1, numPartitions=1).select(F.lit(1).alias("one"), _templates(model, confirm_share).alias("templates"))
    said = said.withColumn("one", F.lit(1)).join(F.broadcast(one), "one")
    share_of = [F.create_map(*[x for w, p in shares.items() for x in (F.lit(w), F.lit(p[k]))]) for k in (0, 1)]

    def cut(c):
        # Word by word: a slice would copy the whole paragraph for each window.
        ws = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.get("said", c * STEP + j))
        return F.struct(c.alias("at"), F.filter(ws, lambda w: w.isNotNull()).alias("ws"))

    def can_be_accepted(ws):
        if not gains:
            return F.lit(model.lead() <= 0)
        heavy = F.array_intersect(F.slice(ws, 1, WINDOW), F.array(*map(F.lit, gains)))
        return F.aggregate(heavy, F.lit(0.0), lambda total, w: total + F.element_at(weight, w)) >= model.lead()

    def holding(ws):
        def judged(known):
            add = lambda k: F.aggregate(known, F.lit(0.0), lambda total, w: total + F.element_at(share_of[k], w))
            some = F.filter(templates, lambda t: (t["kinds"] <= F.size(known)) & (F.size(F.array_intersect(t["words"], known)) >= t["kinds"]))
            return F.when((add(0) >= 1 - 1e-9) & (add(1) >= 1 - 1e-9), some).otherwise(F.array().cast(TEMPLATE_ARRAY))

        # As an element of an array the known words are found once, not for each template.
        return F.get(F.transform(F.array(F.array_intersect(ws, F.array(*map(F.lit, shares)))), judged), 0)

    count = F.floor((F.size("said") + STEP - 1) / STEP).cast("int")
    cuts = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), cut))
    marked_cuts = F.transform(cuts, lambda p: F.struct(p["at"].alias("at"), p["ws"].alias("ws"), holding(p["ws"]).alias("near"), can_be_accepted(p["ws"]).alias("heavy")))
    some = F.filter(marked_cuts, lambda p: p["heavy"] | (F.size(p["near"]) > 0))
    # Written before it becomes rows: the planner repeats what an inline reads in the filters that it infers.
    return materialize(said.select("_row", "paragraph", some.alias("some"))).select("_row", "paragraph", F.inline("some"))


def _probabilities(each: DataFrame, model: Model) -> DataFrame:
    """(_row, paragraph, s): the calibrated probabilities of all classes in every window that can be accepted."""
    k = len(model.classes)
    if not model.weights:
        s = F.array(*map(F.lit, model.intercepts))
    else:
        table = F.create_map(*[x for t, w in sorted(model.weights.items()) for x in (F.lit(t), F.array(*map(F.lit, w)))])
        found = F.array_intersect(terms(F.slice("ws", 1, WINDOW)), F.array(*map(F.lit, sorted(model.weights))))
        s = F.aggregate(found, F.array(*map(F.lit, model.intercepts)), lambda total, t: F.zip_with(total, F.element_at(table, t), lambda a, b: a + b))
    scored = each.select("_row", "paragraph", s.alias("s"))
    heat = F.lit(model.temperature)
    return scored.select("_row", "paragraph", F.array(*[share(F.get("s", F.lit(c)), heat) for c in range(k)]).alias("s"))


def _aligned(each: DataFrame, confirm_share: float) -> DataFrame:
    """(_row, paragraph, family, template_share, own): alignments of templates that agree enough and hold no unseen word."""
    near = each.where(F.size("near") > 0).select("_row", "paragraph", "at", "ws", F.inline("near"))
    n = F.size("said")
    # Every pair of equal words votes for the place where the template would begin; the votes of a place are its agreement.
    votes = F.flatten(F.transform("ws", lambda w, i: F.filter(F.transform("said", lambda t, k: F.when(t == w, i - k)), lambda v: v.isNotNull())))
    near = near.withColumn("votes", F.filter(votes, lambda v: ((v >= 0) & (v < STEP)) | ((v < 0) & (F.col("at") == 0))))
    starts = F.filter(F.array_distinct("votes"), lambda v: F.size(F.filter("votes", lambda x: x == v)) >= F.col("need"))
    near = near.withColumn("start", F.explode(starts))
    near = near.withColumn("text", F.transform(F.sequence(F.lit(0), n + 2), lambda k: F.get("ws", F.col("start") + k)))
    same = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.coalesce(F.get("text", k) == F.get("said", k), F.lit(False)))
    near = near.withColumn("same", same).withColumn("first", F.array_position("same", F.lit(True)) - 1)

    def unseen(x, k):
        word = F.get("text", k)
        strange = (~x) & word.isNotNull() & ~F.coalesce(F.array_contains("said", word), F.lit(False)) & ~F.coalesce(word.rlike("^[0-9]+$"), F.lit(False))
        goes_on = F.exists(F.slice("same", k + 2, F.size("same")), lambda y: y)
        resumes = reduce(lambda a, y: a | y, [F.coalesce(F.get("text", k + d) == F.get("said", k), F.lit(False)) for d in (1, 2, 3)])
        return strange & (k > F.col("first")) & (goes_on | resumes)

    refused = F.exists(F.transform("same", unseen), lambda x: F.coalesce(x, F.lit(False)))
    triple = lambda x, k: x & F.coalesce(F.get("same", k + 1), F.lit(True)) & F.coalesce(F.get("same", k + 2), F.lit(True)) & F.get("own", k)
    own_hits = F.size(F.filter(F.transform("same", triple), lambda x: x))
    agreed = F.size(F.filter("same", lambda x: x)) / n
    judged = near.select("_row", "paragraph", "family", agreed.alias("template_share"), refused.alias("refused"), (own_hits >= F.lit(confirm_share) * F.greatest("n_own", F.lit(1))).alias("own"))
    return judged.where(~F.col("refused")).groupBy("_row", "paragraph", "family").agg(F.max("template_share").alias("template_share"), F.max("own").alias("own"))


def scan_paragraphs(kept: DataFrame, model: Model, *, confirm_share: float = CONFIRM_SHARE) -> DataFrame:
    """(_row, paragraph, family, probability, template_share, confirmed) of the paragraphs predicted or confirmed as a licence.

    ``kept`` is the result of ``marked``. A paragraph has a row for each of its families.
    """
    each = pieces(kept, model, confirm_share)
    scored = _probabilities(each, model)
    best = F.array_max(F.slice("s", 1, len(model.classes) - 1))
    place = F.array_position("s", best).cast("int")
    predicted = scored.where(best >= model.accepted).select("_row", "paragraph", F.get(F.array(*map(F.lit, model.classes)), place - 1).alias("family"), best.alias("probability"))
    predicted = predicted.select("*", F.lit(True).alias("predicted"), F.lit(0.0).alias("template_share"), F.lit(False).alias("own"))
    aligned = _aligned(each, confirm_share)
    of = F.create_map(*[x for c, f in enumerate(model.classes) for x in (F.lit(f), F.lit(c))])
    chances = aligned.join(scored, ["_row", "paragraph"]).groupBy("_row", "paragraph", "family", "template_share", "own").agg(F.max(F.get("s", F.element_at(of, F.col("family")))).alias("probability"))
    confirmed = chances.select("_row", "paragraph", "family", "probability", F.lit(False).alias("predicted"), "template_share", "own")
    both = predicted.unionByName(confirmed).groupBy("_row", "paragraph", "family").agg(*[F.max(c).alias(c) for c in ("probability", "predicted", "template_share", "own")])
    sure = F.col("own") | (F.col("predicted") & (F.col("template_share") >= confirm_share))
    return both.select("_row", "paragraph", "family", "probability", "template_share", sure.alias("confirmed"), "predicted").where("predicted or confirmed").drop("predicted")


def scan(docs: DataFrame, model: Model | None = None, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_paragraphs, families, n_found, n_confirmed, n_unknown, top_probability.

    families: the confirmed ones in alphabetical order; n_found: paragraphs predicted or confirmed as a licence;
    n_unknown: those that no template confirms.
    """
    model = model or fit(docs, id_col=id_col, text_col=text_col)
    kept = marked(docs, model, id_col=id_col, text_col=text_col, **options)
    found = scan_paragraphs(kept, model, **options)
    each = found.groupBy("_row", "paragraph").agg(F.collect_set(F.when(F.col("confirmed"), F.col("family"))).alias("families"), F.max("confirmed").alias("confirmed"), F.max("probability").alias("probability"))
    per_row = each.groupBy("_row").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("families")))).alias("families"),
        F.count(F.lit(1)).alias("n_found"),
        F.sum(F.col("confirmed").cast("long")).alias("n_confirmed"),
        F.max("probability").alias("top_probability"),
    )
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return kept.drop("parts").join(per_row, "_row", "left").select(
        "doc_id", "n_paragraphs", F.coalesce("families", F.array().cast("array<string>")).alias("families"), none("n_found").alias("n_found"),
        none("n_confirmed").alias("n_confirmed"), (none("n_found") - none("n_confirmed")).alias("n_unknown"), F.coalesce("top_probability", F.lit(0.0)).alias("top_probability"),
    )
