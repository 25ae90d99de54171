"""License notices by ordered signature rules.

Rules are regular expressions over the text's words (runs of ASCII letters, digits and anything beyond ASCII, A-Z
lower-cased) joined by single spaces, so punctuation and line breaks do not matter. Each rule has keywords, a label and
a priority. Texts without any keyword, found by the hashes of their words, are done; in the others only rules whose
keywords all occur are tried. Detections are taken by falling priority, then length: one that lies inside an already taken interval is
suppressed, so "GNU Lesser General Public License" does not also report what it contains.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from widetab.llm import textops
from widetab.llm.frames import batch, documents, schema_of

#: Phrases that always count, with their labels (fixed values).
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    priority: int  # 0 to 100, also the confidence in percent
    keywords: tuple[str, ...]
    pattern: re.Pattern


def _rule(name: str, label: str, priority: int, keywords: str, pattern: str) -> Rule:
    return Rule(name, label, priority, tuple(keywords.split()), re.compile(rf"(?<= )(?:{pattern})(?= )"))


#: Hand-written signatures of full texts and notices: label, keywords, pattern (fixed values).
SIGNATURES = """
mit | permission granted charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | permission notice substantial | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | expat license | expat license|the expat licen[cs]e
mit-0 | mit attribution | mit no attribution|mit 0 license
x11 | x11 license | x11 license|mit x11 license
isc | permission distribute fee | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
isc | isc license | isc licen[cs]e|under the isc licen[cs]e
bsd | redistribution source binary | redistribution and use in source and binary forms with or without modification are permitted
bsd | redistributions retain copyright | redistributions of source code must retain the above copyright notice
bsd | redistributions binary reproduce | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | neither endorse promote | neither the name of (?:\\S+ ){1,12}nor the names of its contributors may be used to endorse or promote products
bsd-4-clause | advertising acknowledgement software | all advertising materials mentioning features or use of this software must display the following acknowledgement
apache | apache license compliance | you may not use this file except in compliance with the license
apache-2.0 | licensed apache license | licensed under the apache license version 2 0
apache-1.1 | apache license | apache software license version 1 1
gpl | free software redistribute | this (?:program|library|file) is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl-2.0-or-later | version foundation later | version 2 of the license or at your option any later version
gpl-3.0-or-later | version foundation later | version 3 of the license or at your option any later version
lgpl | free software lesser | free software you can redistribute it and or modify it under the terms of the gnu lesser general public license
lgpl | gnu library license | gnu library general public licen[cs]e
agpl | gnu affero license | gnu affero general public licen[cs]e
gfdl | gnu free documentation | gnu free documentation licen[cs]e
mpl-2.0 | subject mozilla license | subject to the terms of the mozilla public license v 2 0|subject to the terms of the mozilla public license version 2 0
mpl | mozilla public license | mozilla public licen[cs]e
epl | eclipse public license | eclipse public licen[cs]e
cddl | common development license | common development and distribution licen[cs]e
cpl | common public license | common public licen[cs]e
eupl | european union license | european union public licen[cs]e
ecl | educational community license | educational community licen[cs]e
artistic | artistic license | artistic licen[cs]e
afl | academic free license | academic free licen[cs]e
osl | open software license | open software licen[cs]e
bsl | business source license | business source licen[cs]e
boost | boost software license | boost software licen[cs]e
python | python foundation license | python software foundation licen[cs]e
php | php license | php licen[cs]e version \\d \\d+|the php licen[cs]e
ruby | ruby license | ruby licen[cs]e
zlib | zlib license | zlib libpng licen[cs]e|zlib licen[cs]e
zlib | origin misrepresented software | the origin of this software must not be misrepresented
zlib | altered source versions | altered source versions must be plainly marked as such
unlicense | free unencumbered domain | this is free and unencumbered software released into the public domain
unlicense | unlicense | (?:the )?unlicense
public-domain | public domain | (?:released|dedicated|placed|published) (?:in|into|to) the public domain|public domain dedication
cc0 | creative zero | creative commons zero|creative commons cc0
wtfpl | fuck public license | do what the fuck you want to public licen[cs]e
ofl | open font license | (?:sil )?open font licen[cs]e
odbl | open database license | open database licen[cs]e|open data commons open database
pddl | commons public domain dedication | open data commons public domain dedication and licen[cs]e
odc-by | commons attribution license | open data commons attribution licen[cs]e
ms-pl | microsoft public license | microsoft public licen[cs]e
ms-rl | microsoft reciprocal license | microsoft reciprocal licen[cs]e
intel | intel open license | intel open source licen[cs]e
openssl | openssl license | openssl licen[cs]e
upl | universal permissive license | universal permissive licen[cs]e
vim | vim license | vim licen[cs]e
tcl | tcl license | tcl tk licen[cs]e
w3c | w3c license | w3c software (?:notice and )?licen[cs]e
ncsa | illinois ncsa license | university of illinois ncsa open source licen[cs]e
elastic | elastic license | elastic licen[cs]e(?: 2 0)?
sspl | server side license | server side public licen[cs]e
polyform | polyform license | polyform (?:noncommercial|shield|small business|strict) licen[cs]e
rail | responsible license | (?:open )?responsible ai licen[cs]e
llama | community license agreement | llama \\d? ?community licen[cs]e agreement
commons-clause | commons clause license | commons clause licen[cs]e
proprietary | copyright rights reserved | copyright (?:c |\\d{4} |\\S+ ){0,8}all rights reserved
proprietary | confidential proprietary permission | confidential and proprietary (?:\\S+ ){0,20}written permission
warranty | provided warranty kind | the software is provided as is without warranty of any kind
""".strip()

#: Families with numbered versions: label, name in words, versions (fixed values).
FAMILIES = """
apache | apache | 1.0 1.1 2.0
gpl | gnu general public;general public;gnu gpl;gpl | 1.0 2.0 3.0
lgpl | gnu lesser general public;lesser general public;gnu lgpl;lgpl | 2.0 2.1 3.0
agpl | gnu affero general public;affero general public;gnu agpl;agpl | 1.0 3.0
gfdl | gnu free documentation;gfdl | 1.1 1.2 1.3
mpl | mozilla public;mpl | 1.0 1.1 2.0
epl | eclipse public;epl | 1.0 2.0
cddl | common development and distribution;cddl | 1.0 1.1
eupl | european union public;eupl | 1.0 1.1 1.2
artistic | artistic;perl artistic | 1.0 2.0
afl | academic free;afl | 1.1 1.2 2.0 2.1 3.0
osl | open software;osl | 1.0 1.1 2.0 2.1 3.0
ecl | educational community;ecl | 1.0 2.0
ofl | sil open font;open font;ofl | 1.0 1.1
bsl | boost software | 1.0
busl | business source;busl | 1.0 1.1
zpl | zope public;zpl | 1.1 2.0 2.1
odbl | open database;odbl | 1.0
lppl | latex project public;lppl | 1.0 1.1 1.2 1.3
cecill | cecill free software;cecill | 1.0 1.1 2.0 2.1
""".strip()

#: Creative Commons: the conditions in short and in words, and the versions (fixed values).
CC_KINDS = (
    ("by", "attribution"), ("by sa", "attribution sharealike"), ("by nc", "attribution noncommercial"), ("by nd", "attribution noderivatives"),
    ("by nc sa", "attribution noncommercial sharealike"), ("by nc nd", "attribution noncommercial noderivatives"),
)
CC_VERSIONS = "1.0 2.0 2.5 3.0 4.0".split()

GRANT = r"(?:licensed|released|distributed|available|published|provided|offered|covered) (?:under|by|with) (?:the )?(?:terms of (?:the )?)?"


def build_rules() -> list[Rule]:
    """The signatures, and for every family, version and form of notice a rule of its own; by falling priority."""
    rules = []
    for i, line in enumerate(SIGNATURES.splitlines()):
        label, keywords, pattern = (x.strip() for x in line.split(" | "))
        rules.append(_rule(f"text-{i}", label, 90, _present(keywords, pattern), pattern.replace("\\\\", "\\")))
    for line in FAMILIES.splitlines():
        label, names, versions = (x.strip() for x in line.split(" | "))
        for name in names.split(";"):
            key = name.split()[-1]
            rules.append(_rule(f"grant-{name}", label, 75, key, rf"{GRANT}{name}(?: licen[cs]e)?"))
            for version in versions.split():
                number = version.replace(".", " ")
                short = number.removesuffix(" 0") if number.endswith(" 0") else number
                numbered = rf"{name}(?= )(?: licen[cs]e)?(?: version| v)? ?(?:v?{number}|v?{short}(?! \d))"
                rules.append(_rule(f"grant-{name}-{version}", f"{label}-{version}", 85, key, GRANT + numbered))
                rules.append(_rule(f"name-{name}-{version}", f"{label}-{version}", 70, key, numbered))
                for v in ("v", ""):  # name and number in one word, which is then the keyword
                    fused, word = rf"{name}{v}(?:{number}|{short}(?! \d))", f"{key}{v}{number.split()[0]}"
                    rules.append(_rule(f"grant-{name}{v}{version}", f"{label}-{version}", 85, word, GRANT + fused))
                    rules.append(_rule(f"name-{name}{v}{version}", f"{label}-{version}", 70, word, fused))
                if " " not in name:
                    rules.append(_rule(f"spdx-{name}-{version}", f"{label}-{version}", 95, f"spdx {key}", rf"spdx license identifier {name} {number}(?: or later| only)?"))
    for short, words in CC_KINDS:
        label = "cc-" + short.replace(" ", "-")
        rules.append(_rule(f"{label}-grant", label, 75, "cc", rf"{GRANT}cc {short}"))
        rules.append(_rule(f"{label}-words", label, 75, "creative commons", rf"creative commons {words}"))
        for version in CC_VERSIONS:
            number = version.replace(".", " ")
            numbered = f"{label}-{version}"
            rules.append(_rule(f"{numbered}-grant", numbered, 88, "cc", rf"{GRANT}cc {short} {number}"))
            rules.append(_rule(f"{numbered}-name", numbered, 80, "cc", rf"cc {short} {number}"))
            rules.append(_rule(f"{numbered}-words", numbered, 85, "creative commons", rf"creative commons {words} {number}"))
            rules.append(_rule(f"{numbered}-link", numbered, 92, "creativecommons", rf"creativecommons org licenses {short} {number}"))
            rules.append(_rule(f"{numbered}-spdx", numbered, 95, "spdx cc", rf"spdx license identifier cc {short} {number}"))
    for clauses, word in (("0", "zero"), ("1", "one"), ("2", "two"), ("3", "three"), ("4", "four")):
        rules.append(_rule(f"bsd-{clauses}", f"bsd-{clauses}-clause", 80, "bsd clause", rf"bsd {clauses} clause|{clauses} clause bsd|{word} clause bsd"))
    for name in ("mit", "isc", "unlicense", "zlib", "wtfpl", "postgresql", "ncsa", "x11"):
        rules.append(_rule(f"spdx-{name}", name, 95, f"spdx {name}", rf"spdx license identifier {name}"))
        rules.append(_rule(f"grant-{name}", name, 80, name, rf"{GRANT}{name}"))
    rules.append(_rule("simplified-bsd", "bsd-2-clause", 80, "bsd", r"(?:simplified|freebsd) bsd(?: licen[cs]e)?"))
    rules.append(_rule("new-bsd", "bsd-3-clause", 80, "bsd", r"(?:new|modified|revised) bsd(?: licen[cs]e)?"))
    rules.append(_rule("bsd-license", "bsd", 70, "bsd", rf"{GRANT}bsd|bsd(?: style)? licen[cs]e"))
    return sorted(rules, key=lambda r: (-r.priority, r.name))


def _present(keywords: str, pattern: str) -> str:
    """Of the hand-written keywords those that every match must hold as a word."""
    options, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            options.append("")
        else:
            options[-1] += c
    certain = [set(re.sub(r"\(\?:[^()]*(?:\([^()]*\)[^()]*)*\)(?:\?|\{[^}]*\})?", " ", o).split()) for o in options]
    return " ".join(k for k in keywords.split() if all(k in c for c in certain))


RULES = build_rules()
#: Every rule and base phrase needs one of these words; a text without them is done.
_BY_KEYWORD: dict[str, list[Rule]] = {}
for _r in RULES:
    _BY_KEYWORD.setdefault(_r.keywords[0], []).append(_r)
KEYWORDS = sorted(set(_BY_KEYWORD) | {phrase.split()[-1] for phrase, _ in BASE})
_BASE_PATTERNS = [(re.compile(rf"(?<= ){p}(?= )"), label) for p, label in BASE]


def word_starts(words: list[str]) -> list[int]:
    """Where the words begin in their text with one space before each."""
    return list(accumulate((len(w) + 1 for w in words), initial=1))[:len(words)]


class Taken:
    """Intervals; those inside others are not kept, so both ends ascend and one look-up tells whether one is covered."""

    def __init__(self):
        self.starts, self.ends = [], []

    def add(self, a: int, b: int) -> bool:
        """Take an interval unless it lies inside a taken one."""
        at = bisect_right(self.starts, a)
        if at and self.ends[at - 1] >= b:
            return False
        low = at - 1 if at and self.starts[at - 1] == a else at
        high = bisect_right(self.ends, b, low)
        self.starts[low:high], self.ends[low:high] = [a], [b]
        return True


def detections(words: list[str]) -> list[tuple[int, int, str, int]]:
    """``(first word, last word, label, priority)`` of the rules, those inside taken intervals suppressed."""
    present = set(words)
    padded, starts = f" {' '.join(words)} ", word_starts(words)
    found = []
    for first in present & _BY_KEYWORD.keys():
        for rule in _BY_KEYWORD[first]:
            if all(k in present for k in rule.keywords):
                for m in rule.pattern.finditer(padded):
                    found.append((-rule.priority, m.start() - m.end(), m.start(), m.end(), rule.label))
    found.sort()
    taken = Taken()
    out = []
    for priority, _, a, b, label in found:
        if not taken.add(a, b):
            continue
        out.append((bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1, label, -priority))
    return sorted(out)


def scan(text: bytes) -> tuple:
    """Of a text in lower case that holds a keyword: n_base, first and last word, base labels, labels, score, detections."""
    words = WORD.findall(text.decode())
    padded, starts = f" {' '.join(words)} ", word_starts(words)
    places, base = [], set()
    for pattern, label in _BASE_PATTERNS:
        for m in pattern.finditer(padded):
            places.append(bisect_right(starts, m.start()) - 1)
            base.add(label)
    found = detections(words)
    labels = sorted(base | {label for _, _, label, _ in found})
    score = max([p / 100 for *_, p in found] + [0.6 if base else 0.0])
    spans = [f"{a}-{b}:{label}" for a, b, label, _ in found]
    return len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(labels), score, spans


_SCAN = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
         "detections array<string>")
_NOTHING = (0, None, None, "", "", 0.0, [])


def _keyword_lookup() -> textops.Lookup:
    words = textops.word_hashes(*textops.utf8(pa.array(KEYWORDS)), textops.ALNUM)[0]
    return textops.Lookup(np.unique(words))


def _rows(batches):
    schema, lookup = schema_of(_SCAN), _keyword_lookup()
    for b in batches:
        data, offsets = textops.utf8(b.column("text"))
        for i, j in textops.groups(offsets):
            part, own = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
            hashes, bounds = textops.word_hashes(part, own, textops.ALNUM)
            hit = np.unique(np.searchsorted(bounds, lookup.find(hashes)[0], side="right") - 1)
            found = [_NOTHING] * (j - i)
            for k in hit.tolist():
                found[k] = scan(part[own[k]:own[k + 1]].tobytes().lower())
            yield batch(schema, b.column("doc_id").slice(i, j - i), np.diff(bounds), *map(list, zip(*found)))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections``.

    ``n_base`` counts all places of the base phrases; ``first_word`` and ``last_word`` are their smallest and largest
    start (null without any). ``labels`` adds those of the rules; ``score`` is the confidence of the best rule, 0.6 for
    base phrases alone, 0 for none. A null text is empty. Texts are handled where they are read; nothing is shuffled.
    """
    return documents(docs, id_col, text_col).mapInArrow(_rows, _SCAN)
