"""License scans with ordered signature rules.

Texts are lower-cased and reduced to words of letters, digits and non-ASCII characters, joined by one
space; every rule is a regular expression over that string, bounded by word edges. A rule runs only on texts
that hold its keyword (which each of its matches contains), and no rule at all runs on texts without one of GATES. Detections are resolved in rule
order (earlier rules have priority): one whose interval lies inside the interval of a detection of higher or
equal priority is suppressed. What is left gives labels. Three base phrases are counted at every place where
their words stand consecutively, and their labels always stay.

score: 1 minus the product of (1 - confidence) over the labels, each by its surest detection; 0.95 for full texts, 0.9 for
SPDX tags, base phrases and URLs, 0.8 for full names, 0.6 for short names; 0 without any.

Defined cases: null or empty text: no words, no places, empty labels, score 0. Repeated rows: each scanned.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.llm.common import ALNUM, arrow_map, long_ids, table, texts

BASE = ((b" under the mit license ", "mit"), (b" apache license version 2 ", "apache-2"), (b" cc by nc ", "cc-by-nc"))
#: Every keyword below contains one of these, and every match of a rule contains its keyword.
GATES = (b"licen", b"copyright", b"spdx", b"public domain", b"creative", b"cc0", b" cc by ", b"gpl", b"warrant", b"redistribut", b"permission", b"reserved", b"copying", b"eula", b"consortium", b"endorse", b"advertising", b"reproduction", b"openssl", b"retain", b"eclipse", b"sil org", b"wtfpl")

#: Sections in order of priority: (confidence, lines of `label | keyword | regex`). Words are lower case
#: with single spaces; punctuation has become spaces (`Apache-2.0` is `apache 2 0`).
_TEXTS = r"""
mit | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | permission | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: \S+){10,40} furnished to do so the software is provided as is
x11 | consortium | except as contained in this notice the name of the x consortium shall not be used
isc | permission | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
0bsd | permission | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software
hpnd | permission | permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose
bsd-2-clause | redistribut | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met(?! (?:\S+ ){0,120}neither the name)
bsd-3-clause | endorse | neither the name of (?:\S+ ){1,12}nor the names of its contributors may be used to endorse or promote products
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-1-clause | redistribut | redistributions of source code must retain the above copyright notice this list of conditions
apache-2 | licen | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2 | reproduction | terms and conditions for use reproduction and distribution 1 definitions
apache-1.1 | redistribut | the end user documentation included with the redistribution if any must include the following acknowledge?ment
gpl-2 | licen | gnu general public license version 2 june 1991
gpl-3 | licen | gnu general public license version 3 29 june 2007
lgpl-2.1 | licen | gnu lesser general public license version 2 1 february 1999
lgpl-3 | licen | gnu lesser general public license version 3 29 june 2007
agpl-3 | licen | gnu affero general public license version 3 19 november 2007
gpl-2-or-later | licen | either version 2 of the license or (?:\S+ ){0,4}any later version
gpl-3-or-later | licen | either version 3 of the license or (?:\S+ ){0,4}any later version
lgpl-2.1-or-later | licen | either version 2 1 of the license or (?:\S+ ){0,4}any later version
gpl | licen | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
lgpl | licen | this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license
gfdl-1.3 | permission | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3
gfdl-1.2 | permission | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2
gfdl | permission | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
mpl-2 | licen | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | licen | the contents of this file are subject to the mozilla public license version 1 1
cddl-1 | licen | the contents of this file are subject to the terms of the common development and distribution license
epl-2 | licen | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0
epl-1 | licen | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
unlicense | public domain | this is free and unencumbered software released into the public domain
cc0-1 | copyright | to the extent possible under law (?:\S+ ){1,12}waived all copyright and related or neighboring rights
wtfpl | licen | do what the fuck you want to public license
zlib | warrant | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
bsl-1 | permission | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
postgresql | permission | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
artistic-2 | licen | this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
openssl | openssl | this product includes software developed by the openssl project
ofl-1.1 | licen | this font software is licensed under the sil open font license version 1 1
afl-3 | licen | licensed under the academic free license version 3 0
osl-3 | licen | licensed under the open software license version 3 0
eupl-1.2 | licen | licensed under the eupl (?:version )?1 2
beerware | retain | as long as you retain this notice you can do whatever you want with this stuff
python-2 | licen | python software foundation license version 2
ms-pl | licen | this license governs use of the accompanying software if you use the software you accept this license
proprietary | reserved | all rights reserved unauthorized copying of this file via any medium is strictly prohibited
proprietary | copyright | confidential and proprietary (?:\S+ ){0,20}copyright
"""
_URLS = r"""
apache-2 | licen | apache org licenses license 2 0
apache-2 | licen | opensource org licenses? apache 2 0
mit | licen | opensource org licenses? mit(?: license)?
mit | licen | mit license org
bsd-2-clause | licen | opensource org licenses? bsd 2 clause
bsd-3-clause | licen | opensource org licenses? bsd 3 clause
gpl-3 | licen | gnu org licenses gpl 3 0
gpl-2 | licen | gnu org licenses (?:old licenses )?gpl 2 0
lgpl-3 | licen | gnu org licenses lgpl 3 0
lgpl-2.1 | licen | gnu org licenses (?:old licenses )?lgpl 2 1
agpl-3 | licen | gnu org licenses agpl 3 0
gfdl | licen | gnu org licenses fdl
gpl | licen | gnu org licenses gpl
lgpl | licen | gnu org licenses lgpl
mpl-2 | licen | mozilla org mpl 2 0(?: licen[sc]e)?
epl-2 | eclipse | eclipse org legal epl 2 0
epl-1 | eclipse | eclipse org legal epl v10
isc | licen | opensource org licenses? isc
zlib | licen | opensource org licenses? zlib
bsl-1 | licen | boost org license 1 0
unlicense | licen | unlicense org
cc-by-4 | creative | creativecommons org licenses by 4 0
cc-by-3 | creative | creativecommons org licenses by 3 0
cc-by-2.5 | creative | creativecommons org licenses by 2 5
cc-by-2 | creative | creativecommons org licenses by 2 0
cc-by-sa-4 | creative | creativecommons org licenses by sa 4 0
cc-by-sa-3 | creative | creativecommons org licenses by sa 3 0
cc-by-sa-2.5 | creative | creativecommons org licenses by sa 2 5
cc-by-sa-2 | creative | creativecommons org licenses by sa 2 0
cc-by-nd-4 | creative | creativecommons org licenses by nd 4 0
cc-by-nd-3 | creative | creativecommons org licenses by nd 3 0
cc-by-nc-4 | creative | creativecommons org licenses by nc 4 0
cc-by-nc-3 | creative | creativecommons org licenses by nc 3 0
cc-by-nc-sa-4 | creative | creativecommons org licenses by nc sa 4 0
cc-by-nc-sa-3 | creative | creativecommons org licenses by nc sa 3 0
cc-by-nc-nd-4 | creative | creativecommons org licenses by nc nd 4 0
cc-by-nc-nd-3 | creative | creativecommons org licenses by nc nd 3 0
cc0-1 | creative | creativecommons org publicdomain zero 1 0
public-domain | creative | creativecommons org publicdomain mark 1 0
odbl-1 | licen | opendatacommons org licenses odbl
odc-by-1 | licen | opendatacommons org licenses by
pddl-1 | licen | opendatacommons org licenses pddl
ofl-1.1 | sil org | scripts sil org ofl
wtfpl | wtfpl | wtfpl net
ogl-uk-3 | licen | nationalarchives gov uk doc open government licence version 3
"""
_TAGS = r"""
apache-2 | spdx | spdx license identifier apache 2 0
mit-0 | spdx | spdx license identifier mit 0
mit | spdx | spdx license identifier mit
bsd-2-clause | spdx | spdx license identifier bsd 2 clause
bsd-3-clause | spdx | spdx license identifier bsd 3 clause
bsd-4-clause | spdx | spdx license identifier bsd 4 clause
0bsd | spdx | spdx license identifier 0bsd
isc | spdx | spdx license identifier isc
zlib | spdx | spdx license identifier zlib
gpl-2-or-later | spdx | spdx license identifier gpl 2 0 or later
gpl-2 | spdx | spdx license identifier gpl 2 0(?: only)?
gpl-3-or-later | spdx | spdx license identifier gpl 3 0 or later
gpl-3 | spdx | spdx license identifier gpl 3 0(?: only)?
lgpl-2.1-or-later | spdx | spdx license identifier lgpl 2 1 or later
lgpl-2.1 | spdx | spdx license identifier lgpl 2 1(?: only)?
lgpl-3-or-later | spdx | spdx license identifier lgpl 3 0 or later
lgpl-3 | spdx | spdx license identifier lgpl 3 0(?: only)?
agpl-3-or-later | spdx | spdx license identifier agpl 3 0 or later
agpl-3 | spdx | spdx license identifier agpl 3 0(?: only)?
mpl-2 | spdx | spdx license identifier mpl 2 0
mpl-1.1 | spdx | spdx license identifier mpl 1 1
epl-1 | spdx | spdx license identifier epl 1 0
epl-2 | spdx | spdx license identifier epl 2 0
cddl-1 | spdx | spdx license identifier cddl 1 [01]
bsl-1 | spdx | spdx license identifier bsl 1 0
unlicense | spdx | spdx license identifier unlicense
cc0-1 | spdx | spdx license identifier cc0 1 0
cc-by-4 | spdx | spdx license identifier cc by 4 0
cc-by-3 | spdx | spdx license identifier cc by 3 0
cc-by-sa-4 | spdx | spdx license identifier cc by sa 4 0
cc-by-sa-3 | spdx | spdx license identifier cc by sa 3 0
cc-by-nd-4 | spdx | spdx license identifier cc by nd 4 0
cc-by-nc-4 | spdx | spdx license identifier cc by nc 4 0
cc-by-nc-sa-4 | spdx | spdx license identifier cc by nc sa 4 0
cc-by-nc-nd-4 | spdx | spdx license identifier cc by nc nd 4 0
wtfpl | spdx | spdx license identifier wtfpl
artistic-2 | spdx | spdx license identifier artistic 2 0
ofl-1.1 | spdx | spdx license identifier ofl 1 1
eupl-1.2 | spdx | spdx license identifier eupl 1 2
postgresql | spdx | spdx license identifier postgresql
python-2 | spdx | spdx license identifier (?:python|psf) 2 0
ms-pl | spdx | spdx license identifier ms pl
ms-rl | spdx | spdx license identifier ms rl
ncsa | spdx | spdx license identifier ncsa
openssl | spdx | spdx license identifier openssl
afl-3 | spdx | spdx license identifier afl 3 0
osl-3 | spdx | spdx license identifier osl 3 0
busl-1.1 | spdx | spdx license identifier busl 1 1
sspl-1 | spdx | spdx license identifier sspl 1 0
elastic-2 | spdx | spdx license identifier elastic 2 0
"""
_NAMES = r"""
mit | licen | (?:under|by|with|per) (?:the )?(?:terms of the )?mit licen[sc]e
mit | licen | the mit licen[sc]e(?: mit)?
mit | licen | mit expat licen[sc]e
mit-0 | licen | mit no attribution licen[sc]e
apache-2 | licen | apache (?:software )?licen[sc]e (?:version |v )?2(?: 0)?
apache-2 | licen | apache public licen[sc]e (?:version |v )?2(?: 0)?
apache-1.1 | licen | apache (?:software )?licen[sc]e (?:version |v )?1 1
apache-1 | licen | apache (?:software )?licen[sc]e (?:version |v )?1 0
bsd-2-clause | licen | (?:simplified|freebsd|2 clause|two clause) bsd licen[sc]e
bsd-2-clause | licen | bsd (?:2|two) clause(?: simplified)? licen[sc]e
bsd-3-clause | licen | (?:new|revised|modified|3 clause|three clause) bsd licen[sc]e
bsd-3-clause | licen | bsd (?:3|three) clause(?: new or revised)? licen[sc]e
bsd-4-clause | licen | (?:original|4 clause|four clause) bsd licen[sc]e
0bsd | licen | (?:zero clause|0 clause) bsd licen[sc]e
isc | licen | (?:the )?isc licen[sc]e
zlib | licen | zlib (?:libpng )?licen[sc]e
libpng | licen | libpng licen[sc]e
gpl-2-or-later | licen | gnu general public licen[sc]e (?:version |v )?2(?: 0)? or (?:any )?later
gpl-3-or-later | licen | gnu general public licen[sc]e (?:version |v )?3(?: 0)? or (?:any )?later
gpl-2 | licen | gnu general public licen[sc]e (?:version |v )?2(?: 0)?
gpl-3 | licen | gnu general public licen[sc]e (?:version |v )?3(?: 0)?
lgpl-2.1 | licen | gnu (?:lesser|library) general public licen[sc]e (?:version |v )?2(?: [01])?
lgpl-3 | licen | gnu (?:lesser|library) general public licen[sc]e (?:version |v )?3(?: 0)?
agpl-3 | licen | gnu affero general public licen[sc]e(?: (?:version |v )?3(?: 0)?)?
gpl | licen | gnu general public licen[sc]e
lgpl | licen | gnu (?:lesser|library) general public licen[sc]e
gfdl | licen | gnu free documentation licen[sc]e
mpl-2 | licen | mozilla public licen[sc]e (?:version |v )?2(?: 0)?
mpl-1.1 | licen | mozilla public licen[sc]e (?:version |v )?1 1
mpl | licen | mozilla public licen[sc]e
epl-2 | licen | eclipse public licen[sc]e (?:version |v )?2(?: 0)?
epl-1 | licen | eclipse public licen[sc]e (?:version |v )?1(?: 0)?
epl | licen | eclipse public licen[sc]e
cddl-1 | licen | common development and distribution licen[sc]e(?: (?:version |v )?1 [01])?
cpl-1 | licen | common public licen[sc]e(?: (?:version |v )?1 0)?
ipl-1 | licen | ibm public licen[sc]e
bsl-1 | licen | boost software licen[sc]e(?: (?:version |v )?1 0)?
busl-1.1 | licen | business source licen[sc]e(?: (?:version |v )?1 1)?
sspl-1 | licen | server side public licen[sc]e
elastic-2 | licen | elastic licen[sc]e (?:version |v )?2(?: 0)?
artistic-2 | licen | artistic licen[sc]e (?:version |v )?2(?: 0)?
artistic-1 | licen | artistic licen[sc]e (?:version |v )?1(?: 0)?
artistic | licen | (?:perl )?artistic licen[sc]e
afl-3 | licen | academic free licen[sc]e
osl-3 | licen | open software licen[sc]e
eupl-1.2 | licen | european union public licen[sc]e
cecill-2.1 | licen | cecill (?:free software )?licen[sc]e
ms-pl | licen | microsoft public licen[sc]e
ms-rl | licen | microsoft reciprocal licen[sc]e
ncsa | licen | (?:university of illinois )?ncsa open source licen[sc]e
postgresql | licen | postgresql licen[sc]e
python-2 | licen | python software foundation licen[sc]e
php-3 | licen | php licen[sc]e (?:version |v )?3(?: 0[01]?)?
ruby | licen | ruby licen[sc]e
zpl-2.1 | licen | zope public licen[sc]e
w3c | licen | w3c software (?:notice and )?licen[sc]e
ofl-1.1 | licen | sil open font licen[sc]e
openssl | licen | openssl licen[sc]e
odbl-1 | licen | open (?:data commons open )?database licen[sc]e
odc-by-1 | licen | open data commons attribution licen[sc]e
pddl-1 | licen | public domain dedication and licen[sc]e
ogl-uk-3 | licen | open government licen[sc]e
unlicense | licen | the unlicense
beerware | licen | beer ?ware licen[sc]e
wtfpl | licen | do what the f\S+ you want to public licen[sc]e
hippocratic | licen | hippocratic licen[sc]e
json | licen | the json licen[sc]e
cc-by-nc-nd-4 | creative | creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0
cc-by-nc-nd | creative | creative commons attribution non ?commercial no ?deriv(?:ative)?s
cc-by-nc-sa-4 | creative | creative commons attribution non ?commercial share ?alike 4 0
cc-by-nc-sa | creative | creative commons attribution non ?commercial share ?alike
cc-by-nc-4 | creative | creative commons attribution non ?commercial 4 0
cc-by-nc | creative | creative commons attribution non ?commercial
cc-by-nd-4 | creative | creative commons attribution no ?deriv(?:ative)?s 4 0
cc-by-nd | creative | creative commons attribution no ?deriv(?:ative)?s
cc-by-sa-4 | creative | creative commons attribution share ?alike 4 0
cc-by-sa-3 | creative | creative commons attribution share ?alike 3 0
cc-by-sa | creative | creative commons attribution share ?alike
cc-by-4 | creative | creative commons attribution 4 0
cc-by-3 | creative | creative commons attribution 3 0
cc-by | creative | creative commons attribution
cc0-1 | creative | creative commons (?:zero|cc0)
creative-commons | creative | creative commons licen[sc]e
public-domain | public domain | (?:dedicated to|released into|placed in|in) the public domain
proprietary | reserved | all rights reserved
"""
_SHORT = r"""
cc-by-nc-nd-4 | cc by | cc by nc nd 4 0
cc-by-nc-nd | cc by | cc by nc nd
cc-by-nc-sa-4 | cc by | cc by nc sa 4 0
cc-by-nc-sa | cc by | cc by nc sa
cc-by-nc-4 | cc by | cc by nc 4 0
cc-by-nc-3 | cc by | cc by nc 3 0
cc-by-nc | cc by | cc by nc
cc-by-nd-4 | cc by | cc by nd 4 0
cc-by-nd | cc by | cc by nd
cc-by-sa-4 | cc by | cc by sa 4 0
cc-by-sa-3 | cc by | cc by sa 3 0
cc-by-sa | cc by | cc by sa
cc-by-4 | cc by | cc by 4 0
cc-by-3 | cc by | cc by 3 0
cc0-1 | cc0 | cc0(?: 1 0)?
apache-2 | licen | apache 2(?: 0)? licen[sc]ed?
apache | licen | apache licen[sc]e
mit | licen | mit licen[sc]ed?
mit | licen | licen[sc]e mit
bsd | licen | bsd (?:style )?licen[sc]ed?
gpl-3-or-later | gpl | gpl ?v?3(?: 0)? or later
gpl-2-or-later | gpl | gpl ?v?2(?: 0)? or later
agpl-3 | gpl | agpl ?v?3(?: 0)?
lgpl-3 | gpl | lgpl ?v?3(?: 0)?
lgpl-2.1 | gpl | lgpl ?v?2 1
gpl-3 | gpl | gpl ?v?3(?: 0)?
gpl-2 | gpl | gpl ?v?2(?: 0)?
agpl | gpl | agpl
lgpl | gpl | lgpl
gpl | gpl | (?:gnu )?gpl
mpl-2 | licen | mpl 2 0 licen[sc]ed?
ofl-1.1 | licen | ofl licen[sc]ed?
proprietary | licen | (?:end user licen[sc]e agreement|proprietary licen[sc]e|commercial licen[sc]e)
proprietary | eula | eula
"""


def _parse() -> list[tuple[str, bytes, re.Pattern[bytes], float]]:
    rules = []
    for confidence, block in ((0.95, _TEXTS), (0.9, _URLS), (0.9, _TAGS), (0.8, _NAMES), (0.6, _SHORT)):
        for line in block.strip().splitlines():
            label, keyword, pattern = (x.strip() for x in line.split("|", 2))
            rules.append((label, keyword.encode(), re.compile(rb"(?<= )(?:" + pattern.encode() + rb")(?= )"), confidence))
    return rules


RULES = _parse()
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
)


def detect(flat: bytes) -> list[tuple[int, int, str, float]]:
    """Resolved detections (start, end, label, confidence) in b' word word '; offsets in bytes."""
    if not any(g in flat for g in GATES):
        return []
    has: dict[bytes, bool] = {}
    kept: list[tuple[int, int, str, float]] = []
    starts: list[int] = []
    reach: list[int] = []  # the furthest end of the kept detections up to each, in the order of their starts
    for label, keyword, pattern, confidence in RULES:
        if keyword not in has:
            has[keyword] = keyword in flat
        if not has[keyword]:
            continue
        new = []  # a rule's own matches do not overlap
        for m in pattern.finditer(flat):
            a, b = m.span()
            i = bisect_right(starts, a)
            if not i or reach[i - 1] < b:
                new.append((a, b, label, confidence))
        if new:
            kept += new
            kept.sort()
            starts = [x[0] for x in kept]
            reach = list(accumulate((x[1] for x in kept), max))
    return kept


def word_numbers(flat: bytes, at: list[int]) -> list[int]:
    """The words that start after the spaces at these offsets of b' word word ', counted from 0."""
    if not at:
        return []
    return np.searchsorted(np.flatnonzero(np.frombuffer(flat, np.uint8) == 32), at).tolist()


def base_places(flat: bytes) -> list[tuple[int, str]]:
    """(byte offset, label) of every place of a base phrase in b' word word '."""
    out = []
    for phrase, label in BASE:
        at = flat.find(phrase)
        while at >= 0:
            out.append((at, label))
            at = flat.find(phrase, at + 1)
    return sorted(out)


def detections(docs: DataFrame) -> DataFrame:
    """Every resolved detection: doc_id, first_word, n_words, label, confidence."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for i, t in zip(long_ids(batch).to_pylist(), texts(batch)):
            flat = b" " + b" ".join(t.translate(ALNUM).split()) + b" "
            found = detect(flat)
            first = word_numbers(flat, [a - 1 for a, *_ in found])
            last = word_numbers(flat, [b for _, b, *_ in found])
            rows += [(i, f, e - f, x, c) for f, e, (_, _, x, c) in zip(first, last, found)]
        cols = list(zip(*rows)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "first_word", "n_words", "label", "confidence"])

    return arrow_map(
        docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, first_word long, n_words long, label string, confidence double"
    )


def license_scan(docs: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(7)]
        for t in texts(batch):
            words = t.translate(ALNUM).split()
            flat = b" " + b" ".join(words) + b" "
            found = detect(flat)
            places = base_places(flat)
            base = sorted({x for _, x in places})
            sure = {label: 0.9 for label in base}
            for _, _, label, c in found:
                sure[label] = max(c, sure.get(label, 0.0))
            left = 1.0
            for label in sorted(sure):
                left *= 1.0 - sure[label]
            at = word_numbers(flat, [p[0] for p in places[:1] + places[-1:]])
            row = (len(words), len(places), at[0] if at else None, at[-1] if at else None, ",".join(base), ",".join(sorted(sure)), 1.0 - left)
            for col, value in zip(cols, row):
                col.append(value)
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([long_ids(batch), *map(pa.array, cols, kinds)], names)

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
