"""License scan against a plain version: words, base phrases, open gates, suppression."""

import re
import time

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from codequarry.llm import licenses
from codequarry.llm.license_rules import BASE, KINDS, Rule, signatures
from codequarry.llm.queries import op12_licenses

SF = "/root/testdata/sf0.01"
RULES = signatures()
SCANNER = licenses.Scanner(RULES)
PLAIN = [re.compile("(?<![^ ])(?:" + r.pattern + ")(?![^ ])") for r in RULES]


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_scan(text):
    """All rules without gates on the joined words; suppression by comparing all pairs."""
    words = plain_words(text)
    joined = " ".join(words)
    found = []
    for i, pattern in enumerate(PLAIN):
        for m in pattern.finditer(joined):
            a, b = m.span("at") if "at" in m.groupdict() else m.span()
            found.append((joined[:a].count(" "), joined[:b].count(" "), i))
    levels = list(KINDS)

    def beaten(d):
        for o in found:
            if o == d or not (o[0] <= d[0] and d[1] <= o[1]):
                continue
            mine, its = levels.index(RULES[d[2]].kind), levels.index(RULES[o[2]].kind)
            longer = (o[0], o[1]) != (d[0], d[1])
            if its < mine or (its == mine and (longer or o[2] < d[2])):
                return True
        return False

    return words, sorted((*d, not beaten(d)) for d in found)


def as_plain(text):
    n, rows, score = SCANNER.scan((text or "").encode())
    return n, sorted((r["first"], r["last"], r["rule"], r["kept"]) for r in rows), score


def plain_digest(text):
    words, found = plain_scan(text)
    places, base = [], set()
    for phrase, label in BASE:
        parts = phrase.split(" ")
        here = [i for i in range(len(words)) if words[i:i + len(parts)] == parts]
        places += here
        base |= {label} if here else set()
    labels = base | {RULES[i].label for _, _, i, kept in found if kept}
    return (len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)))


def test_query_equals_plain_version(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = op12_licenses(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:7] == plain_digest(texts[r["doc_id"]]), r["doc_id"]
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")


def test_there_are_hundreds_of_rules_in_order():
    assert len(RULES) >= 300
    levels = [list(KINDS).index(r.kind) for r in RULES]
    assert levels == sorted(levels) and [r.label for r in RULES[:3]] == ["mit", "apache-2", "cc-by-nc"]


@pytest.mark.parametrize("text,labels", [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")", "mit"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "apache-2"),
    ("# SPDX-License-Identifier: MIT OR Apache-2.0", "apache-2,mit"),
    ("// SPDX-License-Identifier: GPL-2.0-only", "gpl-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
    ("the GNU General Public License version 3 or (at your option) any later version", "gpl-3.0-or-later"),
    ("under the GNU Lesser General Public License version 2.1", "lgpl-2.1"),
    ("Released under the GNU Affero General Public License v3.0", "agpl-3.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"),
    ("Redistributions of source code must retain the above copyright notice", "bsd"),
    ("Distributed under the BSD 3-Clause License", "bsd-3-clause"),
    ("license = \"MIT\"", "mit"), ("License :: OSI Approved :: ISC", "isc"),
    ("see https://www.apache.org/licenses/LICENSE-2.0 for it", "apache-2"),
    ("https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa"),
    ("shared under Creative Commons Attribution-NonCommercial 4.0", "cc-by-nc"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("a CC BY-NC-ND 4.0 image", "cc-by-nc,cc-by-nc-nd"),
    ("CC0 1.0 Universal", "cc0-1.0"), ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("All rights reserved.", "all-rights-reserved"), ("Copyright (c) 2019 Someone", "copyright-notice"),
    ("Boost Software License 1.0", "boost-1.0"), ("SIL Open Font License 1.1", "ofl-1.1"),
    ("Er kam mit der Lizenz", ""), ("the license plate of the mit building", ""), ("", ""), (None, ""),
])
def test_statements(text, labels):
    _, rows, _ = SCANNER.scan((text or "").encode())
    assert ",".join(sorted({r["label"] for r in rows if r["kept"]})) == labels
    assert as_plain(text)[1] == plain_scan(text)[1]


def test_suppression_by_priority_and_containment():
    """A name within a notice goes, a base phrase within anything stays, overlap alone suppresses nothing."""
    _, rows, _ = SCANNER.scan(b"released under the MIT License or the GNU General Public License version 2 or any later version")
    assert [(r["label"], r["kind"]) for r in rows if r["kept"]] == [("mit", "base"), ("gpl-2.0-or-later", "notice")]
    rules = [Rule("a", "name", "x y", (("x",),)), Rule("b", "name", "y z", (("z",),)), Rule("c", "name", "x y", (("x",),)),
             Rule("d", "mark", "y", (("y",),)), Rule("e", "text", "z z", (("z",),))]
    _, rows, _ = licenses.Scanner(rules).scan(b"x y z z")
    assert sorted(r["label"] for r in rows if r["kept"]) == ["a", "b", "e"]


_vocabulary = sorted({w for r in RULES for w in re.findall(r"[a-z0-9é]+", r.pattern) if len(w) > 1} | {"2", "0", "3", "1", "v", "c", "x"})


@given(st.lists(st.one_of(
    st.sampled_from(_vocabulary), st.sampled_from([p for p, _ in BASE]), st.sampled_from(["Ω", "licenses", "the", "\n", "under the"]),
    st.sampled_from([re.sub(r"\(\?:([^|()]*)[^()]*\)\??", r"\1", r.pattern).replace("[sc]", "s").replace("?", "") for r in RULES if "{" not in r.pattern]),
), max_size=40))
@settings(max_examples=150, deadline=None)
def test_gates_and_slices_change_nothing(parts):
    text = " ".join(parts)
    n, found, _ = as_plain(text)
    words, plain = plain_scan(text)
    assert (n, found) == (len(words), plain)


def test_slices_do_not_cut_words(monkeypatch):
    text = "aé" * 700 + " under the MIT License! " + "x" * 5000 + " cc-by-nc " * 400 + "é"
    whole = SCANNER.scan(text.encode())
    monkeypatch.setattr(licenses, "SLICE_BYTES", 64)
    assert SCANNER.scan(text.encode()) == whole
    assert whole[0] == len(plain_words(text))


@pytest.mark.parametrize("text", [
    "released " * 200_000, "x" * 3_000_000, "licensed under the " * 100_000, "é" * 1_000_000 + " license",
    "under the mit license " * 60_000, "spdx license identifier " * 60_000, "permission is hereby granted free of charge " * 40_000,
    "gnu general public license version 2 or any later " * 20_000,
])
def test_long_texts_stay_linear(text):
    began = time.perf_counter()
    n, rows, _ = SCANNER.scan(text.encode())
    assert time.perf_counter() - began < 12 and n == len(text.split())
    if text.startswith("under"):
        assert sum(r["kind"] == "base" for r in rows) == 60_000


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "under the MIT license", "x"), (3, "CC BY NC", "x"), (3, "CC BY NC", "x"), (4, "\x00 é!", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licenses2 string").withColumn("found", F.lit(7))
    got = licenses.with_licenses(docs).select("doc_id", "found", "licenses.words", licenses.label_list(F.col("licenses.found")).alias("l"), "licenses.score").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        [(1, 7, 0, "", 0.0), (2, 7, 0, "", 0.0), (None, 7, 4, "mit", got[2][4]), (3, 7, 3, "cc-by-nc", got[3][4]),
         (3, 7, 3, "cc-by-nc", got[3][4]), (4, 7, 1, "", 0.0)], key=repr)
    assert licenses.with_licenses(docs.limit(0)).count() == 0
