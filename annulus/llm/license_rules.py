"""License scans by ordered signature rules.

Rules are regular expressions over a text's words (lower-case runs of letters
and digits, one space apart): by license, its names, grants, versions and
identifiers, and written one by one, passages of license texts, notices and
exceptions. A rule is tried only where its keyword occurs, and a text without any
anchor of the keywords is not scanned at all. Every place a rule matches is a
detection, an interval of words. Intervals are ordered by start, then longer
first, then by priority; a detection contained in one of the same or a higher
priority is suppressed. Labels come from what is left; a rule without a label
says that a license doesn't hold ("not under the MIT license") and suppresses
what it contains. Rules go by the first anchor of their keywords: only the rules
of anchors that a text holds are looked at.

The four base phrases are rules too, but their places are reported in full.

One pass over each whole text with built-in functions alone, without a shuffle;
a document's detections never leave its row. Sums and maxima over a text's
detections go by blocks, so that a long list of licenses costs time in proportion
to its length. Nulls and empty texts have no words and no detections; repeated
rows get equal results; an empty table gives no rows; columns with the names of
the added ones are replaced, other names don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annulus.llm.workspace import free_name

#: What isn't part of a word; A-Z, and no other letters, are lower-cased afterwards.
_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Fixed phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Each rule's keyword contains one of these.
ANCHORS = (
    "licen", "cc by", "cc0", "gpl", "spdx", "public domain", "creative", "apache", "clause", "permission", "redistribut", "as is", "warrant",
    "liab", "reserved", "copyright", "confidential", "trade secret", "exception", "reproduce", "unauthori", "endorse", "advertising",
)

#: (label, name as a pattern over words, keyword, versions). The name is how a text refers to the license.
FAMILIES = (
    ("gpl", "gnu general public licen[cs]e", "general public licen", ("1.0", "2.0", "3.0")),
    ("gpl", "(?:gnu )?gpl", "gpl", ("1.0", "2.0", "3.0")),
    ("lgpl", "gnu (?:lesser|library) general public licen[cs]e", "general public licen", ("2.0", "2.1", "3.0")),
    ("lgpl", "(?:gnu )?lgpl", "lgpl", ("2.0", "2.1", "3.0")),
    ("agpl", "(?:gnu )?affero general public licen[cs]e", "affero general public licen", ("1.0", "3.0")),
    ("agpl", "(?:gnu )?agpl", "agpl", ("1.0", "3.0")),
    ("gfdl", "gnu free documentation licen[cs]e", "free documentation licen", ("1.1", "1.2", "1.3")),
    ("apache", "apache (?:software )?licen[cs]e", "apache", ("1.0", "1.1", "2.0")),
    ("mit", "(?:the )?mit(?: x11)? licen[cs]e", "licen", ()),
    ("x11", "x11 licen[cs]e", "x11 licen", ()),
    ("isc", "isc licen[cs]e", "isc licen", ()),
    ("bsd", "(?:original |modified |simplified |new )?bsd(?: style)? licen[cs]e", "licen", ()),
    ("bsd-2-clause", "(?:bsd )?2 clause(?: bsd)?(?: licen[cs]e)?", "2 clause", ()),
    ("bsd-3-clause", "(?:bsd )?3 clause(?: bsd)?(?: licen[cs]e)?", "3 clause", ()),
    ("bsd-4-clause", "(?:bsd )?4 clause(?: bsd)?(?: licen[cs]e)?", "4 clause", ()),
    ("0bsd", "zero clause bsd(?: licen[cs]e)?", "zero clause", ()),
    ("mpl", "mozilla public licen[cs]e", "mozilla public licen", ("1.0", "1.1", "2.0")),
    ("epl", "eclipse public licen[cs]e", "eclipse public licen", ("1.0", "2.0")),
    ("cpl", "common public licen[cs]e", "common public licen", ("1.0",)),
    ("cddl", "common development and distribution licen[cs]e", "distribution licen", ("1.0", "1.1")),
    ("eupl", "european union public licen[cs]e", "union public licen", ("1.0", "1.1", "1.2")),
    ("ecl", "educational community licen[cs]e", "community licen", ("1.0", "2.0")),
    ("afl", "academic free licen[cs]e", "academic free licen", ("1.1", "2.0", "2.1", "3.0")),
    ("osl", "open software licen[cs]e", "open software licen", ("1.0", "2.0", "2.1", "3.0")),
    ("artistic", "artistic licen[cs]e", "artistic licen", ("1.0", "2.0")),
    ("zlib", "zlib(?: libpng)? licen[cs]e", "licen", ()),
    ("libpng", "libpng licen[cs]e", "libpng licen", ("2.0",)),
    ("bsl", "boost software licen[cs]e", "boost software licen", ("1.0",)),
    ("busl", "business source licen[cs]e", "business source licen", ("1.1",)),
    ("sspl", "server side public licen[cs]e", "side public licen", ("1.0",)),
    ("elastic", "elastic licen[cs]e", "elastic licen", ("1.0", "2.0")),
    ("unlicense", "(?:the )?unlicen[cs]e", "unlicen", ()),
    ("wtfpl", "do what the fuck you want to public licen[cs]e", "public licen", ("2.0",)),
    ("python", "python software foundation licen[cs]e", "foundation licen", ("2.0",)),
    ("php", "php licen[cs]e", "php licen", ("3.0", "3.01")),
    ("ruby", "ruby licen[cs]e", "ruby licen", ()),
    ("postgresql", "postgresql licen[cs]e", "postgresql licen", ()),
    ("openssl", "openssl licen[cs]e", "openssl licen", ()),
    ("curl", "curl licen[cs]e", "curl licen", ()),
    ("ncsa", "university of illinois ncsa open source licen[cs]e", "open source licen", ()),
    ("ofl", "(?:sil )?open font licen[cs]e", "open font licen", ("1.0", "1.1")),
    ("odbl", "open (?:data commons open )?database licen[cs]e", "database licen", ("1.0",)),
    ("odc-by", "open data commons attribution licen[cs]e", "attribution licen", ("1.0",)),
    ("pddl", "public domain dedication and licen[cs]e", "public domain", ("1.0",)),
    ("ms-pl", "microsoft public licen[cs]e", "microsoft public licen", ()),
    ("ms-rl", "microsoft reciprocal licen[cs]e", "reciprocal licen", ()),
    ("upl", "universal permissive licen[cs]e", "permissive licen", ("1.0",)),
    ("cc0", "cc0", "cc0", ("1.0",)),
    ("cc0", "creative commons zero", "creative commons", ("1.0",)),
    ("cc-by", "creative commons attribution(?: licen[cs]e)?", "creative commons", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-sa", "creative commons attribution share ?alike(?: licen[cs]e)?", "creative commons", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nd", "creative commons attribution no ?deriv(?:ative|ation)?s(?: works)?", "creative commons", ("2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc", "creative commons attribution non ?commercial", "creative commons", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by", "cc by", "cc by", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-sa", "cc by sa", "cc by sa", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nd", "cc by nd", "cc by nd", ("2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc", "cc by nc", "cc by nc", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd", ("2.0", "2.5", "3.0", "4.0")),
    ("public-domain", "(?:released |dedicated |placed )?(?:in|into|to) the public domain", "public domain", ()),
    ("proprietary", "all rights reserved under licen[cs]e", "under licen", ()),
)

_LIC = "licen[cs]e"
_GNU = "gnu {} as published by the free software foundation"
_EITHER = r" ?(?:either )?version {} of the licen[cs]e,? or (?:at your option )?any later version"
#: Passages, notices and exceptions: (label, pattern over words, keyword, priority, score). Priority 4 is a whole condition or
#: grant, 3 a notice that names its license, 2 a passage that several licenses share, 1 a hint.
TEXTS = (
    # MIT and its relatives
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted", 4, 0.98),
    ("mit", "without restriction including without limitation the rights to use copy modify merge publish distribute sublicen[cs]e and or sell copies", "sublicen", 4, 0.97),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice", 4, 0.97),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "as is", 2, 0.8),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability", "copyright holders", 2, 0.8),
    ("mit-0", "permission is hereby granted free of charge to any person obtaining a copy of this software (?:[^ ]+ ){0,40}without restriction including without limitation the rights to use copy modify merge publish distribute sublicen[cs]e and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is", "permission is hereby granted", 4, 0.98),
    ("x11", "except as contained in this notice the names? of (?:[^ ]+ ){1,8}shall not be used in advertising or otherwise to promote", "advertising", 3, 0.9),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted", "permission to use", 4, 0.95),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use", 4, 0.97),
    ("isc", "the software is provided as is and (?:the author|[^ ]+) disclaims all warranties with regard to this software", "disclaims all warrant", 3, 0.85),
    ("ntp", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted", "permission to use", 4, 0.95),
    ("icu", "provided that the above copyright notice s and this permission notice appear in all copies", "this permission notice", 3, 0.9),
    # BSD
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use", 3, 0.9),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source", 3, 0.9),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", "redistributions in binary", 3, 0.9),
    ("bsd-3-clause", "neither the names? of (?:[^ ]+ ){1,12}may be used to endorse or promote products derived from this software", "endorse", 4, 0.95),
    ("bsd-3-clause", "the names? of (?:[^ ]+ ){1,12}may not be used to endorse or promote products derived from this software", "endorse", 4, 0.9),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment", "advertising", 4, 0.97),
    ("bsd", "this software is provided by the (?:copyright holders and contributors|regents and contributors|author) as is", "as is", 3, 0.85),
    ("bsd", "in no event shall the (?:copyright (?:holder|owner)s?|regents|authors?) or contributors be liable for any direct indirect incidental special exemplary or consequential damages", "liab", 2, 0.8),
    ("bsd-3-clause-clear", "no express or implied licen[cs]es to any party s patent rights are granted by this licen[cs]e", "patent rights are granted by this licen", 4, 0.95),
    ("bsd-1-clause", "redistributions of source code must retain the above copyright notice this condition and the following disclaimer", "redistributions of source", 4, 0.9),
    # Apache
    ("apache-2.0", f"licensed under the apache {_LIC} version 2 0 the {_LIC} you may not use this file except in compliance with the {_LIC}", "apache licen", 4, 0.99),
    ("apache-2.0", f"unless required by applicable law or agreed to in writing software distributed under the {_LIC} is distributed on an as is basis", "as is basis", 4, 0.95),
    ("apache-2.0", "apache org licen[cs]es licen[cs]e 2 0", "apache org", 3, 0.95),
    ("apache", "this product includes software developed by the apache (?:software foundation|group)", "apache", 3, 0.85),
    ("apache", "licensed to the apache software foundation asf under one or more contributor licen[cs]e agreements", "apache software foundation", 4, 0.95),
    ("apache-2.0", "grant of patent licen[cs]e subject to the terms and conditions of this licen[cs]e each contributor hereby grants to you", "patent licen", 4, 0.95),
    # GNU
    *((f"gpl-{v}.0-or-later", _GNU.format(f"general public {_LIC}") + _EITHER.format(f"{v}(?: 0)?"), "general public licen", 4, 0.99) for v in (1, 2, 3)),
    *((f"lgpl-{v}.0-or-later", _GNU.format(f"(?:lesser|library) general public {_LIC}") + _EITHER.format(f"{v}(?: 0)?"), "general public licen", 4, 0.99) for v in (2, 3)),
    ("lgpl-2.1-or-later", _GNU.format(f"lesser general public {_LIC}") + _EITHER.format("2 1"), "general public licen", 4, 0.99),
    ("agpl-3.0-or-later", _GNU.format(f"affero general public {_LIC}") + _EITHER.format("3(?: 0)?"), "general public licen", 4, 0.99),
    ("gpl", f"you should have received a copy of the gnu general public {_LIC} along with", "general public licen", 3, 0.9),
    ("lgpl", f"you should have received a copy of the gnu (?:lesser|library) general public {_LIC} along with", "general public licen", 3, 0.9),
    ("agpl", f"you should have received a copy of the gnu affero general public {_LIC} along with", "general public licen", 3, 0.9),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of", "redistribute it", 2, 0.8),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of", "redistribute it", 2, 0.8),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty", "without any warrant", 2, 0.75),
    ("gpl", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[cs]e", "general public licen", 3, 0.9),
    ("gpl", f"everyone is permitted to copy and distribute verbatim copies of this {_LIC} document", "licen", 4, 0.95),
    ("gpl-2.0", f"gnu general public {_LIC} version 2 june 1991", "general public licen", 4, 0.99),
    ("gpl-3.0", f"gnu general public {_LIC} version 3 29 june 2007", "general public licen", 4, 0.99),
    ("lgpl-2.1", f"gnu lesser general public {_LIC} version 2 1 february 1999", "general public licen", 4, 0.99),
    ("lgpl-3.0", f"gnu lesser general public {_LIC} version 3 29 june 2007", "general public licen", 4, 0.99),
    ("agpl-3.0", f"gnu affero general public {_LIC} version 3 19 november 2007", "general public licen", 4, 0.99),
    ("gfdl", f"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation {_LIC}", "free documentation licen", 4, 0.98),
    # exceptions
    ("classpath-exception", "(?:with (?:the )?)?classpath exception(?: 2 0)?", "classpath exception", 3, 0.9),
    ("gcc-exception", "gcc runtime library exception(?: (?:version )?3 1)?", "runtime library exception", 3, 0.9),
    ("autoconf-exception", "as a special exception to the gnu general public licen[cs]e if you distribute this file as part of a program that contains a configuration script", "general public licen", 4, 0.95),
    ("bison-exception", "as a special exception you may create a larger work that contains part or all of the bison parser skeleton", "special exception", 4, 0.95),
    ("font-exception", "(?:with (?:the )?)?font exception(?: 2 0)?", "font exception", 3, 0.85),
    ("openssl-exception", "permission to link (?:the code of )?(?:[^ ]+ ){1,8}with the openssl (?:project s )?(?:openssl )?library", "permission to link", 4, 0.9),
    ("llvm-exception", "apache (?:licen[cs]e )?(?:version )?2 0 with llvm exceptions?", "apache", 4, 0.97),
    ("linking-exception", "gpl with (?:a )?linking exception", "gpl with", 3, 0.85),
    # other software licenses
    ("mpl-2.0", f"this source code form is subject to the terms of the mozilla public {_LIC} v(?:ersion)? 2 0", "mozilla public licen", 4, 0.99),
    ("mpl-1.1", f"the contents of this file are subject to the mozilla public {_LIC} version 1 1", "mozilla public licen", 4, 0.98),
    ("mpl", f"incompatible with secondary {_LIC}s as defined by the mozilla public {_LIC}", "mozilla public licen", 4, 0.9),
    ("epl", f"this program and the accompanying materials are made available under the terms of the eclipse public {_LIC}", "eclipse public licen", 4, 0.97),
    ("cddl", f"the contents of this file are subject to the terms of the common development and distribution {_LIC}", "distribution licen", 4, 0.97),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "held liable", 4, 0.95),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "permission is hereby granted", 4, 0.98),
    ("unlicense", "this is free and unencumbered software released into the public domain", "public domain", 4, 0.99),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document and changing it is allowed", "licen", 4, 0.97),
    ("beerware", "the beer ware licen[cs]e", "beer ware licen", 4, 0.95),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder", "copyright holder", 4, 0.95),
    ("python", "psf is making python available to licensee on an as is basis", "as is basis", 4, 0.95),
    ("ofl", "this font software is licensed under the sil open font licen[cs]e", "open font licen", 4, 0.99),
    ("ncsa", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction", "permission is hereby granted", 4, 0.95),
    ("curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that", "permission to use", 4, 0.95),
    ("busl", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", "redistribute and make", 4, 0.97),
    ("commons-clause", "commons clause(?: licen[cs]e condition)?", "commons clause", 3, 0.9),
    ("afl", "licensed under the academic free licen[cs]e version 3 0", "academic free licen", 4, 0.98),
    ("ms-pl", "this licen[cs]e governs use of the accompanying software if you use the software you accept this licen[cs]e", "licen", 3, 0.85),
    # Creative Commons and data
    *((f"{label}-{major}.{minor}", f"creativecommons org licen[cs]es {code} {major} {minor}", "creativecommons org", 4, 0.99)
      for label, code in (("cc-by", "by"), ("cc-by-sa", "by sa"), ("cc-by-nd", "by nd"), ("cc-by-nc", "by nc"), ("cc-by-nc-sa", "by nc sa"), ("cc-by-nc-nd", "by nc nd"))
      for major, minor in ((2, 0), (3, 0), (4, 0))),
    ("cc0-1.0", "creativecommons org publicdomain zero 1 0", "creativecommons org", 4, 0.99),
    ("public-domain", "creativecommons org publicdomain mark 1 0", "creativecommons org", 4, 0.95),
    ("cc0-1.0", "has waived all copyright and related or neighbou?ring rights", "copyright", 4, 0.95),
    ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike(?: licen[cs]e)?", "creative commons", 2, 0.9),
    ("cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(?:ative|ation)?s(?: licen[cs]e)?", "creative commons", 2, 0.9),
    ("odbl", "made available under the open database licen[cs]e", "database licen", 3, 0.95),
    ("public-domain", "no copyright (?:restrictions|is claimed)", "copyright", 2, 0.7),
    # notices without a license
    ("all-rights-reserved", "all rights reserved", "rights reserved", 1, 0.6),
    ("copyright", "copyright (?:c )?(?:by )?[12][0-9]{3}(?: [12][0-9]{3}){0,9}", "copyright", 1, 0.5),
    ("copyright", "copyright c [^ ]+", "copyright", 1, 0.4),
    ("proprietary", "(?:proprietary and confidential|confidential and proprietary)", "confidential", 2, 0.8),
    ("proprietary", "unauthori[sz]ed (?:copying|reproduction|distribution|use)(?: or distribution)? of this (?:file|software|document|work|material)", "unauthori", 3, 0.85),
    ("proprietary", "may not be (?:copied|reproduced|redistributed)(?: or [^ ]+)? without (?:the )?(?:prior |express )*(?:written )?permission", "permission", 2, 0.75),
    ("proprietary", "no part of this (?:publication|book|work|document) may be reproduced", "may be reproduced", 3, 0.85),
    ("proprietary", "contains (?:the )?trade secrets", "trade secret", 2, 0.7),
    ("proprietary", "(?:end user|software) licen[cs]e agreement", "licen", 2, 0.8),
    ("reprint-permission", "(?:reprinted|reproduced|used) (?:with|by) permission", "permission", 2, 0.7),
    ("no-warranty", "there is no warranty(?: for the program)?(?: to the extent permitted by applicable law)?", "no warrant", 1, 0.5),
    ("no-warranty", "provided as is(?: without (?:any )?warranty(?: of any kind)?)?", "as is", 1, 0.5),
)


@dataclass(frozen=True)
class Rule:
    label: str  # empty: what the rule contains doesn't hold
    keyword: str
    pattern: str
    priority: int
    score: float


def _version(v: str) -> str:
    """How words give a version: 2.0 is also written 2."""
    major, minor = v.split(".")
    return f"(?:version |v ?)?{major}(?: {minor})?" if minor == "0" else f"(?:version |v ?)?{major} {minor}"


#: Families whose versions come as "only" and "or later".
_LATER = ("gpl", "lgpl", "agpl", "gfdl")


def rules() -> tuple[Rule, ...]:
    """The base phrases; for each family its name (priority 1), the name after a granting phrase (2), a version (3), its
    identifier after an SPDX tag (4), and the name in a denial (5); then TEXTS, whose keyword is the first of theirs that
    holds an anchor."""
    out = [Rule(label, phrase, phrase, 0, 0.7) for phrase, label in BASE]
    under = r"under (?:the )?(?:terms of )?(?:the )?"
    granted = r"(?:licen[cs]ed|released|distributed|available|provided) " + under
    denied = r"(?:not|never|neither|nor)(?: been)?(?: licen[cs]ed| released| distributed| available| provided| covered)? " + under
    for label, name, keyword, versions in FAMILIES:
        out.append(Rule(label, keyword, name, 1, 0.75))
        out.append(Rule(label, keyword, granted + name, 2, 0.9))
        out.append(Rule("", keyword, f"{denied}{name}(?: (?:version |v ?)?[0-9]+(?: [0-9]+)?)?", 5, 0.0))
        spdx = label.replace("-", " ")
        out.append(Rule(label, "spdx", f"spdx licen[cs]e identifier {spdx}", 4, 1.0))
        for v in versions:
            tag = f"spdx licen[cs]e identifier {spdx} {v.replace('.', ' ')}"
            out.append(Rule(f"{label}-{v}", keyword, f"{name} {_version(v)}", 3, 0.95))
            out.append(Rule(f"{label}-{v}", "spdx", tag, 4, 1.0))
            if label in _LATER:
                out.append(Rule(f"{label}-{v}-or-later", keyword, f"{name} {_version(v)} or (?:at your option )?(?:any )?later(?: version)?", 3, 0.95))
                out.append(Rule(f"{label}-{v}-only", keyword, f"{name} {_version(v)} only", 3, 0.95))
                out.append(Rule(f"{label}-{v}-or-later", "spdx", f"{tag} or later", 4, 1.0))
                out.append(Rule(f"{label}-{v}-only", "spdx", f"{tag} only", 4, 1.0))
    out += [Rule(label, keyword, pattern, priority, score) for label, pattern, keyword, priority, score in TEXTS]
    assert all(any(a in r.keyword for a in ANCHORS) for r in out)
    return tuple(dict.fromkeys(out))


RULES = rules()
_LEVELS = 6
#: Elements whose sums or maxima are taken together.
_BLOCK = 256
_PLACE = "array<struct<first:int,neg_end:int,neg_priority:int,rule:int>>"


def word_line(text: Column) -> Column:
    """The words of a text with one space before, between and after them; a single space without words."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.trim(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), _GAPS, " "), upper, upper.lower()))
    return F.concat(F.lit(" "), words, F.when(words == "", F.lit("")).otherwise(F.lit(" ")))


def _spaces(x: Column) -> Column:
    return F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _block(i: Column) -> Column:
    return F.floor(i / _BLOCK).cast("int")


def _blocks(x: Column, folded) -> Column:
    """`folded` of each block of an array."""
    return F.transform(F.sequence(F.lit(0), _block(F.size(x) - 1)), lambda b: folded(F.slice(x, b * _BLOCK + 1, F.lit(_BLOCK))))


def _before(x: Column) -> Column:
    """For each element of an array of integers, the sum of the elements before it: by blocks, then within the block."""
    total = lambda some: F.aggregate(some, F.lit(0), lambda a, v: a + v)

    def summed(sums):
        starts = F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b)))
        own = lambda v, i: F.slice(x, _block(i) * _BLOCK + 1, i - _block(i) * _BLOCK)
        return _let(starts, lambda at: F.transform(x, lambda v, i: F.element_at(at, _block(i) + 1) + total(own(v, i))))

    return F.when(F.size(x) > 0, _let(_blocks(x, total), summed)).otherwise(F.array().cast("array<int>"))


def _matches(line: Column, rule: Column) -> Column:
    """The places of a rule: array of (first, neg_end, neg_priority, rule), in words."""

    def placed(parts):
        def at(sums):
            def one(p, i):
                first = F.element_at(sums, i + 1) + p["before"] - 1
                return F.struct(
                    first.alias("first"),
                    (-(first + p["found"] + 1)).alias("neg_end"),
                    (-rule["priority"]).alias("neg_priority"),
                    rule["id"].alias("rule"),
                )

            return F.transform(parts, one)

        return _let(_before(F.transform(parts, lambda p: p["before"] + p["found"])), at)

    def all_(found):
        gaps = F.slice(F.split(line, rule["pattern"], -1), F.lit(1), F.size(found))
        parts = F.zip_with(gaps, found, lambda a, b: F.struct(_spaces(a).alias("before"), _spaces(b).alias("found")))
        return F.when(F.size(found) > 0, _let(parts, placed)).otherwise(F.array().cast(_PLACE))

    return _let(F.regexp_extract_all(line, rule["pattern"], F.lit(0)), all_)


def _unsuppressed(ordered: Column) -> Column:
    """Detections that none of the same or a higher priority contains; `ordered` is sorted, and is named many times."""
    levels = range(_LEVELS)
    nothing = F.struct(*(F.lit(-1).alias(f"m{p}") for p in levels))

    def reach(some):  # the largest end of each priority and those above
        wider = lambda s, d: F.struct(*(F.when(-d["neg_priority"] >= p, F.greatest(s[f"m{p}"], -d["neg_end"])).otherwise(s[f"m{p}"]).alias(f"m{p}") for p in levels))
        return F.aggregate(some, nothing, wider)

    def kept(reaches):
        joined = lambda s, t: F.struct(*(F.greatest(s[f"m{p}"], t[f"m{p}"]).alias(f"m{p}") for p in levels))
        starts = F.transform(reaches, lambda _, b: F.aggregate(F.slice(reaches, F.lit(1), b), nothing, joined))

        def free(at):
            def test(d, i):
                earlier = F.element_at(at, _block(i) + 1)
                far = earlier["m0"]
                for p in levels[1:]:
                    far = F.when(-d["neg_priority"] == p, earlier[f"m{p}"]).otherwise(far)
                beside = F.slice(ordered, _block(i) * _BLOCK + 1, i - _block(i) * _BLOCK)
                near = F.aggregate(beside, F.lit(-1), lambda a, e: F.when(e["neg_priority"] <= d["neg_priority"], F.greatest(a, -e["neg_end"])).otherwise(a))
                return -d["neg_end"] > F.greatest(far, near)

            return F.filter(ordered, test)

        return _let(starts, free)

    return F.when(F.size(ordered) > 0, _let(_blocks(ordered, reach), kept)).otherwise(F.array().cast(_PLACE))


_RULE = "array<struct<id:int,keyword:string,pattern:string,priority:int>>"


def _table(anchor: str) -> Column:
    """The rules that have this anchor as their first."""
    rows = [(i, r) for i, r in enumerate(RULES) if next(a for a in ANCHORS if a in r.keyword) == anchor]
    fields = lambda i, r: (("id", i), ("keyword", r.keyword), ("pattern", f"(?<= )(?:{r.pattern})(?= )"), ("priority", r.priority))
    return F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in fields(i, r))) for i, r in rows)).cast(_RULE)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` with n_words, base (places of base phrases) and detections (what suppression leaves),
    both arrays of (first_word, n_words, rule, label, priority, score)."""
    added = ("n_words", "base", "detections")
    own = [F.col(c) for c in docs.columns if c not in added]
    line_name, raw_name = free_name(docs, "_line"), free_name(docs, "_raw")
    lined = docs.select(*own, word_line(F.col(text)).alias(line_name))
    line, raw_ = F.col(line_name), F.col(raw_name)
    tried = F.concat(*(F.when(F.contains(line, F.lit(a)), F.filter(_table(a), lambda r: F.contains(line, r["keyword"]))).otherwise(F.array().cast(_RULE)) for a in ANCHORS))
    found = F.array_sort(F.flatten(F.transform(tried, lambda r: _matches(line, r))))
    raw = lined.withColumn(raw_name, found)
    labels = F.array(*(F.lit(r.label) for r in RULES))
    scores = F.array(*(F.lit(r.score) for r in RULES))

    def told(d):
        return F.struct(
            d["first"].alias("first_word"),
            (-d["neg_end"] - d["first"]).alias("n_words"),
            d["rule"].alias("rule"),
            F.element_at(labels, d["rule"] + 1).alias("label"),
            (-d["neg_priority"]).alias("priority"),
            F.element_at(scores, d["rule"] + 1).alias("score"),
        )

    return raw.select(
        *(F.col(c) for c in docs.columns if c not in added),
        F.greatest(_spaces(line) - 1, F.lit(0)).cast("long").alias("n_words"),
        F.transform(F.filter(raw_, lambda d: d["rule"] < len(BASE)), told).alias("base"),
        F.transform(_unsuppressed(raw_), told).alias("detections"),
    )


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    names = lambda c: F.transform(c, lambda d: d["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    starts = F.transform("base", lambda d: d["first_word"])
    return scanned.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(names("base")).alias("base_labels"),
        joined(F.filter(F.concat(names("base"), names("detections")), lambda x: x != "")).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["score"])), F.lit(0.0)).alias("score"),
    )
