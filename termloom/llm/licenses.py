"""License scan: ordered signature rules over normalised words.

A text becomes its lower-cased words with one space between them.  Each rule is a
regular expression over that line with a keyword that must stand in it first
(the prefilter), a label and a priority.  Overlapping detections are resolved by
priority and containment: a detection whose interval lies within that of one
with a higher priority, or with the same priority and a longer interval (then an
earlier rule), is suppressed.  Three pinned rules are never suppressed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_rows, utf8

#: Word characters are 0-9, a-z (A-Z lower-cased) and all beyond ASCII; the rest separates.
WORDS = bytes(c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

#: label | words of its SPDX tag | keyword ; regex ; regex ... of names and legal text.
#: In a regex a space is one word boundary; (v) stands for an optional "version" or "v".
SIGNATURES = r"""
mit | mit | mit license ; mit licen[cs]e ; licensed under (?:the )?mit ; mit x11 licen[cs]e
mit | mit | permission is hereby ; permission is hereby granted free of charge to any person obtaining a copy
mit | mit | opensource ; opensource org licenses? mit
mit-0 | mit 0 | mit no attribution ; mit no attribution ; mit 0 licen[cs]e
apache-2.0 | apache 2 0 | apache ; apache licen[cs]e (v)2(?: 0)? ; apache 2(?: 0)? licen[cs]e ; apache org licenses license 2 0 ; licensed to the apache software foundation
apache-1.1 | apache 1 1 | apache ; apache (?:software )?licen[cs]e (v)1 1 ; apache org licenses license 1 1
apache-1.0 | apache 1 0 | apache ; apache (?:software )?licen[cs]e (v)1 0
apache | apache | apache ; apache licen[cs]e ; apache software licen[cs]e
bsd-2-clause | bsd 2 clause | bsd ; bsd 2 clause ; (?:simplified|freebsd) bsd licen[cs]e ; 2 clause bsd ; two clause bsd
bsd-3-clause | bsd 3 clause | bsd ; bsd 3 clause ; (?:new|modified|revised) bsd licen[cs]e ; 3 clause bsd ; three clause bsd
bsd-3-clause | bsd 3 clause | neither the name ; neither the name of (?:\S+ ){1,12}nor the names of
bsd-4-clause | bsd 4 clause | bsd ; bsd 4 clause ; original bsd licen[cs]e ; 4 clause bsd
bsd-4-clause | bsd 4 clause | all advertising materials ; all advertising materials mentioning features
bsd | bsd | bsd ; bsd licen[cs]e ; bsd style licen[cs]e
bsd | bsd | redistribution and use ; redistribution and use in source and binary forms with or without modification
0bsd | 0bsd | 0bsd ; 0bsd licen[cs]e ; zero clause bsd
isc | isc | isc ; isc licen[cs]e ; internet systems consortium licen[cs]e
isc | isc | permission to use ; permission to use copy modify and or distribute this software for any purpose
gpl-2.0 | gpl 2 0 | general public ; gnu general public licen[cs]e (v)2(?: 0)? ; general public licen[cs]e as published by the free software foundation either version 2
gpl-2.0 | gpl 2 0 only | gpl ; gpl ?(v)2(?: 0)? ; gplv2 ; gnu gpl (v)2
gpl-2.0 | gpl 2 0 or later | gpl ; gplv2 or later ; gpl 2 0 or later ; gpl 2 or later
gpl-3.0 | gpl 3 0 | general public ; gnu general public licen[cs]e (v)3(?: 0)? ; general public licen[cs]e as published by the free software foundation either version 3
gpl-3.0 | gpl 3 0 only | gpl ; gpl ?(v)3(?: 0)? ; gplv3 ; gnu gpl (v)3
gpl-3.0 | gpl 3 0 or later | gpl ; gplv3 or later ; gpl 3 0 or later ; gpl 3 or later
gpl-1.0 | gpl 1 0 | general public ; gnu general public licen[cs]e (v)1(?: 0)?
gpl-any | gpl | gnu ; gnu gpl ; gnu org licenses gpl ; gnu copyleft
lgpl-2.0 | lgpl 2 0 | library general ; gnu library general public licen[cs]e
lgpl-2.1 | lgpl 2 1 | lesser general ; gnu lesser general public licen[cs]e (v)2(?: 1)?
lgpl-2.1 | lgpl 2 1 or later | lgpl ; lgpl ?(v)2 1 ; lgplv2
lgpl-3.0 | lgpl 3 0 | lesser general ; gnu lesser general public licen[cs]e (v)3(?: 0)?
lgpl-3.0 | lgpl 3 0 or later | lgpl ; lgpl ?(v)3 ; lgplv3
lgpl | lgpl | lesser ; lesser general public licen[cs]e ; lesser gpl
agpl-3.0 | agpl 3 0 | affero ; gnu affero general public licen[cs]e ; affero general public licen[cs]e (v)3
agpl-3.0 | agpl 3 0 or later | agpl ; agpl ?(v)3 ; agplv3 ; gnu agpl
agpl-1.0 | agpl 1 0 | affero ; affero general public licen[cs]e (v)1
gfdl-1.3 | gfdl 1 3 | free documentation ; gnu free documentation licen[cs]e (v)1 3
gfdl-1.2 | gfdl 1 2 | free documentation ; gnu free documentation licen[cs]e (v)1 2
gfdl | gfdl | free documentation ; gnu free documentation licen[cs]e
gfdl | gfdl | gfdl ; gfdl ; gnu fdl
mpl-1.1 | mpl 1 1 | mozilla ; mozilla public licen[cs]e (v)1 1
mpl-2.0 | mpl 2 0 | mozilla ; mozilla public licen[cs]e (v)2(?: 0)? ; mozilla org mpl 2 0
mpl-2.0 | mpl 2 0 | mpl ; mpl ?(v)2(?: 0)?
mpl | mpl | mozilla ; mozilla public licen[cs]e ; subject to the terms of the mozilla public
epl-1.0 | epl 1 0 | eclipse ; eclipse public licen[cs]e (v)1(?: 0)? ; eclipse org legal epl v10
epl-2.0 | epl 2 0 | eclipse ; eclipse public licen[cs]e (v)2(?: 0)? ; eclipse org legal epl 2 0
edl-1.0 | edl 1 0 | eclipse ; eclipse distribution licen[cs]e
cddl-1.0 | cddl 1 0 | common development ; common development and distribution licen[cs]e
cddl-1.1 | cddl 1 1 | cddl ; cddl (v)1 1
cpl-1.0 | cpl 1 0 | common public ; common public licen[cs]e (v)1 0 ; common public licen[cs]e
ipl-1.0 | ipl 1 0 | ibm public ; ibm public licen[cs]e
eupl-1.2 | eupl 1 2 | european union ; european union public licen[cs]e
eupl-1.2 | eupl 1 2 | eupl ; eupl (v)1 2
eupl-1.1 | eupl 1 1 | eupl ; eupl (v)1 1
artistic-1.0 | artistic 1 0 | artistic ; artistic licen[cs]e (v)1 0
artistic-2.0 | artistic 2 0 | artistic ; artistic licen[cs]e (v)2 0
artistic | artistic | artistic ; (?:perl )?artistic licen[cs]e ; same terms as perl itself
bsl-1.0 | bsl 1 0 | boost ; boost software licen[cs]e ; boost org license 1 0
busl-1.1 | busl 1 1 | business source ; business source licen[cs]e
elastic-2.0 | elastic 2 0 | elastic ; elastic licen[cs]e (v)2(?: 0)? ; elastic licen[cs]e
sspl-1.0 | sspl 1 0 | server side ; server side public licen[cs]e
zlib | zlib | zlib ; zlib licen[cs]e ; zlib libpng licen[cs]e
zlib | zlib | as is without any ; provided as is without any express or implied warranty in no event will the authors
libpng-2.0 | libpng 2 0 | libpng ; png reference library licen[cs]e ; libpng licen[cs]e
unlicense | unlicense | unlicense ; the unlicense ; unlicense org
unlicense | unlicense | free and unencumbered ; free and unencumbered software released into the public domain
wtfpl | wtfpl | wtfpl ; wtfpl ; do what the \S+ you want to public licen[cs]e
beerware | beerware | beer ; beerware licen[cs]e ; beer ware licen[cs]e
public-domain | public domain | public domain ; (?:released|placed|dedicated) (?:in|into|to) the public domain ; in the public domain ; public domain dedication
cc0-1.0 | cc0 1 0 | cc0 ; cc0 1 0 ; cc0 ; cc0 universal
cc0-1.0 | cc0 1 0 | creativecommons ; creativecommons org publicdomain zero
cc-by-1.0 | cc by 1 0 | cc by ; cc by 1 0
cc-by-2.0 | cc by 2 0 | cc by ; cc by 2 0 ; creativecommons org licenses by 2 0
cc-by-2.5 | cc by 2 5 | cc by ; cc by 2 5
cc-by-3.0 | cc by 3 0 | cc by ; cc by 3 0
cc-by-4.0 | cc by 4 0 | cc by ; cc by 4 0
cc-by-3.0 | cc by 3 0 | creative ; creative ?commons attribution 3 0 ; creativecommons org licenses by 3 0
cc-by-4.0 | cc by 4 0 | creative ; creative ?commons attribution 4 0 ; creativecommons org licenses by 4 0
cc-by-sa-2.5 | cc by sa 2 5 | cc by sa ; cc by sa 2 5
cc-by-sa-3.0 | cc by sa 3 0 | cc by sa ; cc by sa 3 0
cc-by-sa-4.0 | cc by sa 4 0 | cc by sa ; cc by sa 4 0
cc-by-sa | cc by sa | cc by sa ; cc by sa
cc-by-sa | cc by sa | creative ; creative ?commons attribution share ?alike ; creativecommons org licenses by sa
cc-by-nc-3.0 | cc by nc 3 0 | cc by nc ; cc by nc 3 0
cc-by-nc-4.0 | cc by nc 4 0 | cc by nc ; cc by nc 4 0
cc-by-nc | cc by nc | cc by nc ; cc by nc
cc-by-nc | cc by nc | creative ; creative ?commons attribution non ?commercial ; creativecommons org licenses by nc
cc-by-nc-sa-4.0 | cc by nc sa 4 0 | cc by nc sa ; cc by nc sa 4 0
cc-by-nc-sa | cc by nc sa | cc by nc sa ; cc by nc sa
cc-by-nc-sa | cc by nc sa | creative ; creative ?commons attribution non ?commercial share ?alike ; creativecommons org licenses by nc sa
cc-by-nc-nd-4.0 | cc by nc nd 4 0 | cc by nc nd ; cc by nc nd 4 0
cc-by-nc-nd | cc by nc nd | cc by nc nd ; cc by nc nd
cc-by-nc-nd | cc by nc nd | creative ; creative ?commons attribution non ?commercial no ?deriv\S* ; creativecommons org licenses by nc nd
cc-by-nd-4.0 | cc by nd 4 0 | cc by nd ; cc by nd 4 0
cc-by-nd | cc by nd | cc by nd ; cc by nd
cc-by-nd | cc by nd | creative ; creative ?commons attribution no ?deriv\S* ; creativecommons org licenses by nd
cc-any | cc | creative ; creative ?commons licen[cs]e ; creative ?commons attribution
odbl-1.0 | odbl 1 0 | open database ; open database licen[cs]e ; opendatacommons org licenses odbl
odc-by-1.0 | odc by 1 0 | open data commons ; open data commons attribution licen[cs]e
pddl-1.0 | pddl 1 0 | open data commons ; open data commons public domain
ofl-1.1 | ofl 1 1 | open font ; sil open font licen[cs]e ; open font licen[cs]e
psf-2.0 | psf 2 0 | python ; python software foundation licen[cs]e ; psf licen[cs]e
python-2.0 | python 2 0 | python ; python licen[cs]e (v)2 0
php-3.01 | php 3 01 | php ; php licen[cs]e (v)3 01 ; php licen[cs]e
ruby | ruby | ruby ; ruby licen[cs]e ; same terms as ruby
openssl | openssl | openssl ; openssl licen[cs]e ; openssl project for use in the openssl toolkit
postgresql | postgresql | postgresql ; postgresql licen[cs]e
ncsa | ncsa | ncsa ; ncsa open source licen[cs]e ; university of illinois ncsa
ms-pl | ms pl | microsoft ; microsoft public licen[cs]e
ms-rl | ms rl | microsoft ; microsoft reciprocal licen[cs]e
upl-1.0 | upl 1 0 | universal permissive ; universal permissive licen[cs]e
vim | vim | vim ; vim licen[cs]e
w3c | w3c | w3c ; w3c software (?:notice and )?licen[cs]e
x11 | x11 | x11 ; x11 licen[cs]e
zpl-2.1 | zpl 2 1 | zope ; zope public licen[cs]e
afl-3.0 | afl 3 0 | academic ; academic free licen[cs]e
osl-3.0 | osl 3 0 | open software licen ; open software licen[cs]e (v)3 0 ; open software licen[cs]e
mulanpsl-2.0 | mulanpsl 2 0 | mulan ; mulan permissive software licen[cs]e
cecill-2.1 | cecill 2 1 | cecill ; cecill (?:free software )?licen[cs]e ; cecill
proprietary | proprietary | proprietary ; proprietary and confidential ; proprietary licen[cs]e ; commercial proprietary
proprietary | licenseref proprietary | unauthorized ; unauthorized (?:copying|use|reproduction|distribution) (?:\S+ ){0,6}prohibited
proprietary | licenseref commercial | commercial license ; commercial license agreement ; under a commercial license
eula | licenseref eula | end user ; end user licen[cs]e agreement
copyright-notice | licenseref copyright | copyright ; copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)? ; copyright c
license-reference | licenseref see | license ; see (?:the )?licen[cs]e(?: file)? for (?:details|more|the) ; licen[cs]e agreement ; licensed under ; released under ; distributed under
"""
#: phrase | label: detections that always stand.
PINNED = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: bytes
    pattern: re.Pattern
    priority: int
    pinned: bool = False


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in order.

    A tag rule and a grant rule are made of every line's SPDX words; the grant rule's keyword is the tag.  Priority:
    tag 90, address 80, grant 70, named version 60, legal text of eight words or
    more 65, other names 40, general hints 20.
    """

    def compiled(x: str) -> re.Pattern:
        return re.compile((" " + x.replace("(v)", r"(?:version |v ?)?") + "(?= )").encode())

    out = [Rule(label, p.encode(), re.compile(f"(?= {p} )".encode()), 100, True) for p, label in PINNED.items()]
    for line in SIGNATURES.strip().splitlines():
        label, tag, rest = (x.strip() for x in line.split(" | "))
        keyword, *patterns = (x.strip() for x in rest.split(" ; "))
        general = label in ("copyright-notice", "license-reference", "cc-any", "gpl-any")
        for p in patterns:
            rank = 20 if general else 80 if " org " in p else 65 if p.count(" ") >= 7 else 60 if re.search(r"\d", label) else 40
            out.append(Rule(label, keyword.encode(), compiled(p), rank))
        if not general:
            out.append(Rule(label, b"spdx", compiled(f"spdx license identifier {tag}"), 90))
            out.append(Rule(label, f" {tag} ".encode(), compiled(f"under (?:the )?(?:terms of (?:the )?)?{tag}"), 70))
    return tuple(out)


@cache
def by_keyword() -> dict[bytes, list[tuple[int, Rule]]]:
    out: dict[bytes, list] = {}
    for i, r in enumerate(rules()):
        out.setdefault(r.keyword, []).append((i, r))
    return out


def normalise(text: str | None) -> bytes:
    """' w1 w2 ... ' with a space at either end; no words: one space."""
    words = utf8(text).translate(WORDS).split()
    return b" %b " % b" ".join(words) if words else b" "


def detections(line: bytes) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) in bytes of a normalised text, after suppression, by start."""
    found, pinned = [], []
    for keyword, own in by_keyword().items():
        if keyword not in line:
            continue
        for i, r in own:
            if r.pinned:
                pinned += [(m.start() + 1, m.start() + 1 + len(keyword), r) for m in r.pattern.finditer(line)]
            else:
                found += [(m.start() + 1, m.end(), i, r) for m in r.pattern.finditer(line)]
    # Best first; one that ends no later than a better one which starts no later is contained.
    kept: list[tuple[int, int, Rule]] = []
    for rank in sorted({x[3].priority for x in found}, reverse=True):
        better, reach, k = sorted((a, b) for a, b, _ in kept), -1, 0
        level = []
        for a, b, _, r in sorted((x for x in found if x[3].priority == rank), key=lambda x: (x[0], -x[1], x[2])):
            while k < len(better) and better[k][0] <= a:
                reach, k = max(reach, better[k][1]), k + 1
            if b > reach:
                level.append((a, b, r))
                reach = b
        kept += level
    return sorted(kept + pinned, key=lambda x: (x[0], x[1], x[2].label))


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """A row for each row of docs: words, pinned places, labels and a score.

    score is the best kept priority as a share of 100, 0 where nothing is found.
    With ``spans``, a column of all detections (first word, words, label,
    priority) follows.  Null text counts as empty: no words, empty labels, null
    first and last word.  Texts are read whole; repeated ids give a row each; an
    empty table gives no rows; other columns are ignored.
    """

    def make():
        def row(x):
            line = normalise(x[1])
            got = detections(line)
            blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
            at = np.searchsorted(blanks, [s for s, _, _ in got]).tolist()  # a word has as many blanks before it as its number, from 1
            pinned = [i - 1 for i, (_, _, r) in zip(at, got, strict=True) if r.pinned]
            base = sorted({r.label for _, _, r in got if r.pinned})
            labels = sorted({r.label for _, _, r in got})
            out = x[0], len(blanks) - 1, len(pinned), min(pinned, default=None), max(pinned, default=None), ",".join(base), ",".join(labels), max((r.priority for _, _, r in got), default=0) / 100
            if spans:
                ends = np.searchsorted(blanks, [e for _, e, _ in got]).tolist()
                out = *out, [(i - 1, j - i + 1, r.label, r.priority) for i, j, (_, _, r) in zip(at, ends, got, strict=True)]
            yield out

        return row

    more = ", spans array<struct<first_word:long,n_words:long,label:string,priority:int>>" if spans else ""
    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)), make, SCHEMA + more)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    return scan(documents(spark, sf_dir))
