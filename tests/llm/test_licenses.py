import re

import edge_data
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tunelake.llm import licenses

RULES = licenses._compiled()


def test_there_are_hundreds_of_rules_and_each_has_its_keyword():
    assert len(RULES) > 200
    for _, label, keyword, pattern in RULES:
        assert label and keyword == keyword.lower()


def plain(text):
    """Words and base phrases, word by word."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        parts = phrase.split()
        for i in range(len(words)):
            if words[i:i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    return (len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(labels)))


PARTS = st.sampled_from(["gnu", "general", "public", "license", "apache", "CC", "by", "mit", "MIT",
                         "x", "é", "-", "\n", "_", "İ", "permit", "9"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PARTS, st.sampled_from([" ", "", "\n", "-", ", "])), max_size=30))
def test_base_against_plain_search(parts):
    text = "".join(a + b for a, b in parts)
    r = licenses.detected(text, RULES)
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain(
        text)
    assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


@pytest.mark.parametrize("text, labels", [
    ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"),
    ("GNU Lesser General\nPublic License version 2.1", "lgpl-2.1"),
    ("This work: GNU General Public License, version 3.", "gpl,gpl-3.0"),
    ("SPDX-License-Identifier: MIT\n", "mit"),
    ("SPDX-License-Identifier: MIT-0\n", "mit-0"),
    ("Creative Commons Attribution-ShareAlike 4.0 International", "cc-by-sa"),
    ("submit license fees with all rights", ""),
    ("All rights reserved.", "proprietary"),
    ("mit der Zeit", ""),
])
def test_labels(text, labels):
    assert licenses.detected(text, RULES)["labels"] == labels


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(1, 8), st.integers(1, 3)), max_size=12))
def test_suppression(found):
    found = [(a, a + n, rank, f"l{i}") for i, (a, n, rank) in enumerate(found)]
    kept = licenses.resolved(found)
    taken = []
    for one in sorted(found, key=lambda d: (-d[2], d[0] - d[1], d[0], d[3])):
        if not any(t[0] <= one[0] and one[1] <= t[1] for t in taken):
            taken.append(one)
    assert kept == taken


def test_table(docs, listed):
    found = licenses.scanned(docs).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)
                  for r in found if r.n_base) == sorted(
        (r.doc_id or -1, *plain(r.text or "")) for r in listed if plain(r.text or "")[1])
    assert sorted(r.n_words for r in found) == sorted(plain(r.text or "")[0] for r in listed)
    assert all(0 <= r.score <= 1 and (r.score > 0) == (r.labels != "") for r in found)
    assert licenses.scanned(edge_data.empty(docs)).count() == 0


def ungated(text):
    low = text.encode().lower()
    found = [(*licenses._place(rank, m), rank, label) for rank, label, _, pattern in RULES
             for m in pattern.finditer(low)]
    return [(a, b, label) for a, b, _, label in sorted(licenses.resolved(found))]


@settings(max_examples=500, deadline=None)
@given(st.data())
def test_the_gate_lets_every_rule_through(data):
    rule = data.draw(st.sampled_from(RULES))
    text = data.draw(st.from_regex(rule[3], fullmatch=True)).decode(errors="replace")
    assert licenses.detected(text, RULES)["spans"] == ungated(text)


@pytest.mark.parametrize("text, labels", [
    ("GNU General\nPublic License version 3", "gpl-3.0"),
    ("Mozilla\nPublic License, v. 2.0", "mpl-2.0"),
    ("All  rights\n\treserved", "proprietary"),
    ("do\twhat the fuck you want to public license", "wtfpl"),
    ("GNU Library General Public License, version 2.1", "lgpl-2.1"),
    ("beerware license", "beerware"),
    ("BigScience Open\nRAIL-M", "openrail"),
    ("Commons\nClause", "commons-clause"),
    ("https://www.mozilla.org/MPL/2.0/", "mpl-2.0"),
    ("SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\n",
     "apache-2.0,bsd-3-clause,mit"),
    ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 OR\n MIT",
     "gpl-2.0-only,mit"),
    ("SPDX-License-Identifier: MIT\nor ISC", "mit"),
])
def test_wrapped_names_and_whole_expressions(text, labels):
    r = licenses.detected(text, RULES)
    assert set(labels.split(",")) <= set(r["labels"].split(","))
    assert r["spans"] == ungated(text)
