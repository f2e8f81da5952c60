"""Notices wrapped over lines, in comments, amid prose, and several in one paragraph."""

from lifecurve.llm import licenses

GPL = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation.
 */"""
BSD = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions
# are met:"""
NC = "This work is licensed under a Creative Commons\r\nAttribution-NonCommercial 4.0 International License."
PROSE = "the river was high that winter and nobody crossed it by the old bridge " * 40


def test_wrapped_and_several(spark, docs):
    texts = {
        GPL: ["gpl"], BSD: ["bsd"], NC: ["cc-by-nc"], "SPDX-License-Identifier: CC-BY-NC-4.0": ["cc-by-nc"],
        f"{PROSE}{BSD} {PROSE}": ["bsd"], f"{GPL}\n\n{BSD}": ["bsd", "gpl"], f"REM {GPL[6:50]}\nREM {GPL[50:]}": ["gpl"],
        "Licensed under the MIT License. Licensed under the Apache License, Version 2.0.": ["apache", "mit"],
        "\n" * 20_000 + "Released under the\nMIT License.": ["mit"], PROSE: [],
    }
    more = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(more, licenses.fit(docs)).collect()}
    assert {k: r["families"] for k, r in got.items()} == dict(enumerate(texts.values()))
    assert got[5]["n_paragraphs"] == 2 and got[5]["n_confirmed"] == 2 and got[0]["n_paragraphs"] == 1
