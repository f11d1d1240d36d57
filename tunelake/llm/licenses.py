"""Licence detection with ordered signature rules.

A rule is a label, a priority, a keyword and a regular expression. A text is first searched for a
few roots; only if one is there, for the rules' keywords; and only rules whose keyword is there run
their expression. Roots and keywords are searched in a copy whose runs of white space are one blank,
so that a name broken by a line end is found too. Detections may overlap ("GNU Lesser General Public License" holds "General Public
License"). They are taken by descending priority, then length; one that lies within the interval of
a detection already taken is suppressed.

The base phrases are counted apart: places where a phrase's words stand one after the other,
whatever stands between the words. Their labels always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelake.llm.common import batches_of, filled, small_batches

# The base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: A word: lower-case letters, digits and everything beyond ASCII.
WORD = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
GAP = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Licences by name: label, keyword, expression over lower-case text. A blank in an expression
# stands for any white space, and one with a question mark for any or none. Those of one family go from special to general; a longer detection
# wins anyway.
NAMES = r"""
agpl-3.0 | affero | (gnu )?affero general public licen[sc]e,?( (version|v\.?) ?3(\.0)?)?
lgpl-2.1 | general public | (gnu )?(library|lesser) general public licen[sc]e,? (version|v\.?) ?2(\.1)?
lgpl-3.0 | lesser | (gnu )?lesser general public licen[sc]e,? (version|v\.?) ?3(\.0)?
lgpl | lesser | (gnu )?lesser general public licen[sc]e
lgpl-2.0 | library general | (gnu )?library general public licen[sc]e
gpl-1.0 | general public | (gnu )?general public licen[sc]e,? (version|v\.?) ?1(\.0)?\b
gpl-2.0 | general public | (gnu )?general public licen[sc]e,? (version|v\.?) ?2(\.0)?\b
gpl-3.0 | general public | (gnu )?general public licen[sc]e,? (version|v\.?) ?3(\.0)?\b
gpl-2.0-or-later | any later version | either version 2 of the licen[sc]e,? or \(at your option\) any later version
gpl-3.0-or-later | any later version | either version 3 of the licen[sc]e,? or \(at your option\) any later version
gpl | gnu gpl | gnu gpl(v?[123])?\b
gpl | free software foundation | under the terms of the gnu general public licen[sc]e as published by the free software foundation
gfdl | documentation licen | (gnu )?free documentation licen[sc]e(,? (version|v\.?) ?1\.[123])?
gcc-exception | runtime library exception | gcc runtime library exception( version 3\.1)?
classpath-exception | classpath | (the )?"?classpath"? exception
apache-1.0 | apache licen | apache licen[sc]e,? (version|v\.?) ?1\.0
apache-1.1 | apache | apache (software )?licen[sc]e,? (version|v\.?) ?1\.1
apache-2.0 | apache | apache (software )?licen[sc]e,? (version|v\.?)? ?2(\.0)?\b
apache-2.0 | apache.org/licenses | https?://(www\.)?apache\.org/licenses/license-2\.0(\.txt|\.html)?
apache | apache software licen | apache software licen[sc]e
mit | mit licen | (the )?(\(?mit\)? )?(expat |x11 |x consortium )?mit licen[sc]e
mit | opensource.org/licenses/mit | https?://(www\.)?opensource\.org/licenses/mit(-license)?(\.php|\.html)?
mit | permission is hereby granted | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
mit-0 | mit no attribution | mit no attribution( licen[sc]e)?
x11 | x11 licen | x11 licen[sc]e
expat | expat licen | expat licen[sc]e
bsd-4-clause | bsd | (original|4[- ]clause|four[- ]clause) bsd( licen[sc]e)?|bsd 4[- ]clause( licen[sc]e)?
bsd-3-clause | bsd | (new|revised|modified|3[- ]clause|three[- ]clause) bsd( licen[sc]e)?|bsd 3[- ]clause( licen[sc]e)?
bsd-2-clause | bsd | (simplified|freebsd|2[- ]clause|two[- ]clause) bsd( licen[sc]e)?|bsd 2[- ]clause( licen[sc]e)?
0bsd | bsd | (zero|0)[- ]clause bsd( licen[sc]e)?|bsd zero clause( licen[sc]e)?
bsd | bsd licen | bsd licen[sc]e
bsd | redistribution and use | redistribution and use in source and binary forms,? with or without modification,? are permitted
isc | isc licen | isc licen[sc]e
isc | permission to use | permission to use, copy, modify, and(/or)? distribute this software for any purpose with or without fee is hereby granted
zlib | zlib | zlib(/libpng)? licen[sc]e
libpng | libpng licen | libpng licen[sc]e( version 2)?
boost | boost software | boost software licen[sc]e(,? (-|version|v)? ?1\.0)?
unlicense | unlicense | (the )?unlicense\b
unlicense | released into the public domain | this is free and unencumbered software released into the public domain
wtfpl | wtfpl | \bwtfpl\b
wtfpl | do what the fuck | do what the fuck you want to public licen[sc]e
mpl-1.0 | mozilla public | mozilla public licen[sc]e,? (version|v\.?) ?1\.0
mpl-1.1 | mozilla public | mozilla public licen[sc]e,? (version|v\.?) ?1\.1
mpl-2.0 | mozilla public | mozilla public licen[sc]e,? (version|v\.?)? ?2\.0
mpl | mozilla public | mozilla public licen[sc]e
mpl-2.0 | mozilla.org/mpl | https?://(www\.)?mozilla\.org/mpl/2\.0/?
epl-1.0 | eclipse public | eclipse public licen[sc]e,? (-|version|v)?\.? ?1\.0
epl-2.0 | eclipse public | eclipse public licen[sc]e,? (-|version|v)?\.? ?2\.0
epl | eclipse public | eclipse public licen[sc]e
edl-1.0 | eclipse distribution | eclipse distribution licen[sc]e(,? (-|version|v)?\.? ?1\.0)?
cpl-1.0 | common public licen | common public licen[sc]e(,? (version|v)?\.? ?1\.0)?
cddl-1.0 | common development and distribution | common development and distribution licen[sc]e(,? (version|v)?\.? ?1\.0)?
cddl-1.1 | common development and distribution | common development and distribution licen[sc]e,? (version|v)?\.? ?1\.1
eupl-1.1 | european union public | european union public licen[sc]e,? (version|v)?\.? ?1\.1
eupl-1.2 | european union public | european union public licen[sc]e,? (version|v)?\.? ?1\.2
eupl | european union public | european union public licen[sc]e
osl-3.0 | open software licen | open software licen[sc]e(,? (version|v)?\.? ?3\.0)?
afl-3.0 | academic free | academic free licen[sc]e(,? (version|v)?\.? ?3\.0)?
artistic-1.0 | artistic licen | artistic licen[sc]e,? (version|v)?\.? ?1\.0
artistic-2.0 | artistic licen | artistic licen[sc]e,? (version|v)?\.? ?2\.0
artistic | artistic licen | artistic licen[sc]e
psf-2.0 | python software foundation | python software foundation licen[sc]e(,? (version|v)?\.? ?2)?
python-2.0 | python licen | python licen[sc]e(,? (version|v)?\.? ?2\.0)?
php-3.01 | php licen | php licen[sc]e,? (version|v)?\.? ?3\.01
php-3.0 | php licen | php licen[sc]e,? (version|v)?\.? ?3\.0\b
ruby | ruby licen | ruby licen[sc]e
perl | same terms as perl | under the same terms as perl( itself)?
tcl | tcl/tk licen | tcl/tk licen[sc]e
openssl | openssl licen | openssl licen[sc]e
ssleay | ssleay licen | ssleay licen[sc]e
curl | curl licen | curl licen[sc]e
ncsa | illinois | university of illinois/ncsa open source licen[sc]e
w3c | w3c software | w3c software (notice and )?licen[sc]e
postgresql | postgresql licen | postgresql licen[sc]e
vim | vim licen | vim licen[sc]e
sleepycat | sleepycat licen | sleepycat licen[sc]e
intel | intel open source licen | intel open source licen[sc]e
ibm-public-1.0 | ibm public licen | ibm public licen[sc]e(,? (version|v)?\.? ?1\.0)?
ms-pl | microsoft public | microsoft public licen[sc]e
ms-rl | microsoft reciprocal | microsoft reciprocal licen[sc]e
apsl-2.0 | apple public source | apple public source licen[sc]e(,? (version|v)?\.? ?2\.0)?
qpl-1.0 | q public licen | q public licen[sc]e(,? (version|v)?\.? ?1\.0)?
npl | netscape public | netscape public licen[sc]e
sspl-1.0 | server side public | server side public licen[sc]e(,? (version|v)?\.? ?1)?
busl-1.1 | business source | business source licen[sc]e(,? (version|v)?\.? ?1\.1)?
elastic-2.0 | elastic licen | elastic licen[sc]e(,? (version|v)?\.? ?2\.0)?
commons-clause | commons clause | commons clause( licen[sc]e)?( condition)?
bsl-upl | universal permissive | universal permissive licen[sc]e(,? (version|v)?\.? ?1\.0)?
blueoak-1.0.0 | blue oak | blue oak model licen[sc]e(,? (version|v)?\.? ?1\.0\.0)?
ofl-1.1 | open font | (sil )?open font licen[sc]e(,? (version|v)?\.? ?1\.1)?
lppl-1.3c | latex project public | latex project public licen[sc]e(,? (version|v)?\.? ?1\.3c?)?
beerware | ware licen | beer-?ware licen[sc]e
json | json licen | json licen[sc]e
json | good, not evil | shall be used for good, not evil
cecill | cecill | cecill(-[bc])?( (free software )?licen[sc]e)?
mulan-psl-2.0 | mulan | mulan (psl|permissive software licen[sc]e)(,? (version|v)?\.? ?2)?
odbl-1.0 | database licen | open (data commons )?database licen[sc]e(,? (version|v)?\.? ?1\.0)?
odc-by-1.0 | open data commons attribution | open data commons attribution licen[sc]e(,? (version|v)?\.? ?1\.0)?
pddl-1.0 | public domain dedication | open data commons public domain dedication (and|&) licen[sc]e
cdla-permissive | community data licen | community data licen[sc]e agreement ?(-|–)? ?permissive
cdla-sharing | community data licen | community data licen[sc]e agreement ?(-|–)? ?sharing
ogl-uk-3.0 | open government licen | open government licen[sc]e(,? (version|v)?\.? ?3\.0)?
openrail | rail | (creativeml |bigscience )?open ?rail(\+\+)?(-m)?( licen[sc]e)?
llama | llama | llama [0-9.]+ community licen[sc]e( agreement)?
cc0-1.0 | cc0 | cc0( 1\.0)?( universal)?
cc0-1.0 | creative commons zero | creative commons zero(,? (version|v)?\.? ?1\.0)?( universal)?
cc-by-nc-nd | nc-nd | (cc|creative commons)[ -]by-nc-nd([ -](2\.0|2\.5|3\.0|4\.0))?
cc-by-nc-sa | nc-sa | (cc|creative commons)[ -]by-nc-sa([ -](2\.0|2\.5|3\.0|4\.0))?
cc-by-nc | by-nc | (cc|creative commons)[ -]by-nc([ -](2\.0|2\.5|3\.0|4\.0))?
cc-by-nd | by-nd | (cc|creative commons)[ -]by-nd([ -](2\.0|2\.5|3\.0|4\.0))?
cc-by-sa | by-sa | (cc|creative commons)[ -]by-sa([ -](2\.0|2\.5|3\.0|4\.0))?
cc-by | by | \bcc[ -]by\b([ -](2\.0|2\.5|3\.0|4\.0))?
cc-by-nc-nd | creative commons | creative commons attribution[- ]non-?commercial[- ]no ?deriv(ative)?s?
cc-by-nc-sa | creative commons | creative commons attribution[- ]non-?commercial[- ]share ?alike
cc-by-nc | creative commons | creative commons attribution[- ]non-?commercial
cc-by-nd | creative commons | creative commons attribution[- ]no-?deriv(ative)?s?
cc-by-sa | creative commons | creative commons attribution[- ]share-? ?alike
cc-by | creative commons | creative commons attribution( ([2345]\.\d|international|generic|unported))*
cc | creativecommons.org | https?://(www\.)?creativecommons\.org/(licenses|publicdomain)/[a-z0-9-]+/\d\.\d/?
cc | creative commons licen | creative commons licen[sc]e
public-domain | public domain | (is|are|in|into|to) (in )?the public domain
proprietary | all rights reserved | all rights reserved
proprietary | proprietary and confidential | proprietary and confidential
""".strip()

# Identifiers of the public licence list, as they stand in SPDX tags.
IDENTIFIERS = """
0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0
Artistic-1.0 Artistic-2.0 Beerware BlueOak-1.0.0 BSD-2-Clause BSD-3-Clause BSD-3-Clause-Clear
BSD-4-Clause BSL-1.0 BUSL-1.1 bzip2-1.0.6 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0
CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1
CDLA-Permissive-2.0 CDLA-Sharing-1.0 CECILL-2.1 CECILL-B CECILL-C CPL-1.0 curl ECL-2.0 EPL-1.0
EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only GPL-2.0-only
GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later GPL-2.0 GPL-3.0 HPND ICU IJG Intel IPL-1.0 ISC
JSON LGPL-2.0-only LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later LGPL-2.1
LGPL-3.0 Libpng LPPL-1.3c MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA NPL-1.1
OFL-1.1 ODbL-1.0 ODC-By-1.0 OpenSSL OSL-3.0 PDDL-1.0 PHP-3.0 PHP-3.01 PostgreSQL PSF-2.0
Python-2.0 QPL-1.0 Ruby Sleepycat SSPL-1.0 TCL Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL
X11 Zlib ZPL-2.1
""".split()

#: A text without any of these holds nothing that a rule finds.
ROOTS = (b"licen", b"copyright", b"spdx", b"gpl", b"cc0", b"cc by", b"cc-by", b"creative", b"domain",
         b"rights reserved", b"bsd", b"permission", b"redistribution", b"wtfpl", b"cecill",
         b"openrail", b"open rail", b"proprietary", b"same terms", b"evil", b"classpath", b"mulan",
         b"do what the", b"exception", b"any later", b"mit no", b"mozilla.org", b"commons clause")


#: What may stand before an identifier in the expression of a tag; a line may end after an operator.
OPERANDS = rb"((?:[a-z0-9.:+-]+[ \t)]+(?:and|or|with)[\s(]+)+)?"


def _compiled() -> list[tuple[int, str, bytes, re.Pattern]]:
    """Priority, label, keyword, expression. A tag is certain; a name outranks a mere mention."""
    rules = []
    for line in NAMES.split("\n"):
        label, keyword, pattern = (x.strip() for x in line.split(" | ", 2))
        rank = 1 if label in ("proprietary", "public-domain", "cc") else 2
        pattern = re.sub(r"\[(- | -)\]", r"[-\\s]", pattern).replace(" ?", r"\s*").replace(" ", r"\s+")
        rules.append((rank, label, keyword.encode(), re.compile(
            rb"(?<![a-z0-9])(?:" + pattern.encode() + rb")(?![a-z0-9])")))
    for name in IDENTIFIERS:
        low = name.lower()
        rules.append((3, low, low.encode(), re.compile(
            rb"spdx-license-identifier:[ \t(]*" + OPERANDS + rb"(" + re.escape(low.encode())
            + rb")(?!\+?[a-z0-9+-]|\.[a-z0-9])")))
    return rules


def _place(rank: int, m: re.Match) -> tuple[int, int]:
    """Of a detection. A tag's first identifier goes with the tag, further ones stand alone, so that
    none lies within another."""
    return m.span(2) if rank == 3 and m.group(1) else m.span()


#: What a surviving detection of a priority says about its text being under a licence.
CONFIDENCE = {1: 0.4, 2: 0.8, 3: 1.0}
BASE_CONFIDENCE = 0.7


def resolved(found: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Detections (start, end, priority, label) that survive: by priority, then length, then place;
    one within an interval already taken is dropped."""
    taken: list[tuple[int, int, int, str]] = []
    tops: list[tuple[int, int]] = []  # disjoint or nested-free cover of what is taken, by start
    from bisect import bisect_right

    for one in sorted(set(found), key=lambda d: (-d[2], d[0] - d[1], d[0], d[3])):
        # Among intervals that start no later, the furthest end decides.
        at = bisect_right(tops, (one[0], float("inf")))
        if at and tops[at - 1][1] >= one[1]:
            continue
        taken.append(one)
        # Keep starts and ends both ascending: drop intervals that the new one covers.
        first = bisect_right(tops, (one[0], -1))
        last = first
        while last < len(tops) and tops[last][1] <= one[1]:
            last += 1
        tops[first:last] = [(one[0], one[1])]
    return taken


IS_WORD = np.array([bool(re.match(WORD, bytes([i]))) for i in range(256)])
_BASE = [(re.compile(rb"(?<!" + WORD + rb")" + GAP.join(w.encode() for w in phrase.split())
                     + rb"(?!" + WORD + rb")"), phrase.split(), label) for phrase, label in BASE]


def detected(text: str, rules: list) -> dict:
    """What the rules and the base phrases find in one text."""
    low = text.encode(errors="surrogatepass").lower()  # bytes: only A-Z change
    word = IS_WORD[np.frombuffer(low, np.uint8)]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    out = {"n_words": int(starts.sum()), "n_base": 0, "first_word": None, "last_word": None}
    places, base = [], set()
    for pattern, words, label in _BASE:
        if not all(w.encode() in low for w in words):
            continue
        at = [m.start() for m in pattern.finditer(low)]
        if at:
            base.add(label)
            places += at
    if places:
        number = np.cumsum(starts) - 1
        out |= {"n_base": len(places), "first_word": int(number[min(places)]),
                "last_word": int(number[max(places)])}
    found, there = [], {}
    flat = b" ".join(low.split())  # keywords have a blank where expressions have any white space
    if any(root in flat for root in ROOTS):
        for rank, label, keyword, pattern in rules:
            if keyword not in there:
                there[keyword] = keyword in flat
            if there[keyword]:
                found += [(*_place(rank, m), rank, label) for m in pattern.finditer(low)]
    kept = resolved(found)
    score = max([*(CONFIDENCE[d[2]] for d in kept), BASE_CONFIDENCE if base else 0.0], default=0.0)
    labels = base | {d[3] for d in kept}
    return out | {"base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)),
                  "score": score,
                  "spans": [(a, b, label) for a, b, _, label in sorted(kept)]}


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, "
          "base_labels string, labels string, score double, "
          "spans array<struct<start:long,end:long,label:string>>")


def scanned(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``, with ``SCHEMA``: words, base phrases, labels, the surviving
    detections (in bytes of the UTF-8 text) and the highest confidence among them.

    Null and empty texts have no words and no labels ("" and 0.0). Repeated rows are scanned each;
    equal detections count once. Labels sort by code point. Other columns are not looked at, and an
    empty table gives an empty result. Each text is read whole, on its own, in one pass.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = _compiled()
        kind = None
        for batch in batches_of(batches, 1000):
            rows = [{"doc_id": i} | detected(t, rules)
                    for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            for row in rows:
                row["spans"] = [{"start": a, "end": b, "label": c} for a, b, c in row["spans"]]
            kind = kind or pa.schema([
                ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()),
                ("first_word", pa.int64()), ("last_word", pa.int64()),
                ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()),
                                              ("label", pa.string())])))])
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    small_batches(docs.sparkSession)
    return docs.select(F.col(row_id).cast("long").alias("doc_id"), filled(text).alias("__text")
                       ).mapInArrow(scan, SCHEMA)
