"""Signature rules of licenses: patterns over the lower-cased words of a text, in order.

A pattern is a regex in which every word is followed by one space: words, (?:...) groups, alternatives, `?` and {m,n} after groups, NUM
(a word of digits) and ANY (any word). spelled() turns it into a regex for texts in which each word has a space of its own on
either side, so that a match is a run of whole words, in Spark's and in SQL's regexes alike. No pattern is unbounded.
needed() reads off a pattern which words a text must have to match it: the keywords of the prefilter.
"""

import re
from dataclasses import dataclass

#: Tiers, best first: identifiers, passages of licenses and their notices, names with a version, names alone, mere hints. With the confidence that each gives.
IDENTIFIER, NOTICE, VERSIONED, NAMED, HINT = 1, 2, 3, 4, 5
CONFIDENCE = {IDENTIFIER: 1.0, NOTICE: 0.95, VERSIONED: 0.9, NAMED: 0.7, HINT: 0.3}
#: Phrases whose places are always counted and whose labels always stay. Fixed by the contract.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Keywords that a rule asks for at most.
KEYWORDS = 3

LICENSE = "(?:license|licence) "
LEAD = "(?:(?:licensed|released|distributed|published|available|provided|covered|redistributed) (?:under|by) (?:the )?(?:terms of )?(?:the )?(?:conditions of )?(?:the )?)?"
ONLY, LATER = "(?:only )?", "(?:(?:or )?(?:at your option )?(?:any )?later (?:version )?|or (?:any )?(?:later|newer) (?:version )?)"

#: Words that too many texts have to tell a rule by.
COMMON = ("all", "and", "any", "des", "der", "for", "free", "just", "see", "the", "this", "what", "with", "without", "work", "you")

#: Families with versions: label, short name, long name, versions.
VERSIONED_FAMILIES = (
    ("apache", "apache ", "apache (?:software )?" + LICENSE, ("1.0", "1.1", "2.0")),
    ("gpl", "gpl ", "(?:gnu )?general public " + LICENSE, ("1.0", "2.0", "3.0")),
    ("lgpl", "lgpl ", "(?:gnu )?(?:lesser|library) general public " + LICENSE, ("2.0", "2.1", "3.0")),
    ("agpl", "agpl ", "(?:gnu )?affero general public " + LICENSE, ("1.0", "3.0")),
    ("gfdl", "gfdl ", "(?:gnu )?free documentation " + LICENSE, ("1.1", "1.2", "1.3")),
    ("mpl", "mpl ", "mozilla public " + LICENSE, ("1.0", "1.1", "2.0")),
    ("epl", "epl ", "eclipse public " + LICENSE, ("1.0", "2.0")),
    ("cpl", "cpl ", "common public " + LICENSE, ("1.0",)),
    ("cddl", "cddl ", "common development and distribution " + LICENSE, ("1.0", "1.1")),
    ("eupl", "eupl ", "european union public " + LICENSE, ("1.0", "1.1", "1.2")),
    ("afl", "afl ", "academic free " + LICENSE, ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("osl", "osl ", "open software " + LICENSE, ("1.0", "1.1", "2.0", "2.1", "3.0")),
    ("artistic", "artistic ", "artistic " + LICENSE, ("1.0", "2.0")),
    ("lppl", "lppl ", "latex project public " + LICENSE, ("1.0", "1.1", "1.2", "1.3")),
    ("apsl", "apsl ", "apple public source " + LICENSE, ("1.0", "1.1", "1.2", "2.0")),
    ("zpl", "zpl ", "zope public " + LICENSE, ("1.1", "2.0", "2.1")),
    ("ofl", "ofl ", "(?:sil )?open font " + LICENSE, ("1.0", "1.1")),
    ("php", "php ", "php " + LICENSE, ("3.0", "3.01")),
    ("ecl", "ecl ", "educational community " + LICENSE, ("1.0", "2.0")),
    ("cecill", "cecill ", "cecill (?:free software )?" + LICENSE, ("1.0", "1.1", "2.0", "2.1")),
    ("bsl", "bsl ", "boost software " + LICENSE, ("1.0",)),
    ("odbl", "odbl ", "(?:open data commons )?open database " + LICENSE, ("1.0",)),
    ("odc-by", "odc by ", "open data commons attribution " + LICENSE, ("1.0",)),
    ("pddl", "pddl ", "(?:open data commons )?public domain dedication and " + LICENSE, ("1.0",)),
    ("ogl", "ogl ", "open government " + LICENSE, ("1.0", "2.0", "3.0")),
    ("qpl", "qpl ", "q public " + LICENSE, ("1.0",)),
    ("busl", "busl ", "business source " + LICENSE, ("1.0", "1.1")),
    ("sspl", "sspl ", "server side public " + LICENSE, ("1.0",)),
    ("elastic", "elastic ", "elastic " + LICENSE, ("1.0", "2.0")),
    ("cc0", "cc0 ", "cc0 (?:public domain dedication )?", ("1.0",)),
    ("upl", "upl ", "universal permissive " + LICENSE, ("1.0",)),
    ("ncgl", "ncgl ", "non commercial government " + LICENSE, ("1.0", "2.0")),
)
#: Short names that mean other things too: these need the word license beside them.
AMBIGUOUS = ("apache", "php", "elastic", "artistic")
#: Licenses without versions: label, identifier, name.
SINGLE = (
    ("mit", "mit ", "(?:mit|expat) (?:style )?" + LICENSE), ("x11", "x11 ", "x11 " + LICENSE), ("isc", "isc ", "isc " + LICENSE),
    ("bsd-2-clause", "bsd 2 clause ", "(?:simplified bsd |freebsd |(?:2|two) clause bsd |bsd (?:2|two) clause )" + LICENSE),
    ("bsd-3-clause", "bsd 3 clause ", "(?:(?:new|modified|revised) bsd |(?:3|three) clause bsd |bsd (?:3|three) clause )" + LICENSE),
    ("bsd-4-clause", "bsd 4 clause ", "(?:(?:original|old) bsd |(?:4|four) clause bsd |bsd (?:4|four) clause )" + LICENSE),
    ("0bsd", "0bsd ", "(?:zero clause bsd |bsd zero clause )" + LICENSE), ("bsd", "bsd ", "bsd (?:style )?" + LICENSE),
    ("zlib", "zlib ", "zlib (?:libpng )?" + LICENSE), ("unlicense", "unlicense ", "the unlicense "), ("wtfpl", "wtfpl ", "do what the (?:fuck|f) you want to public " + LICENSE),
    ("ms-pl", "ms pl ", "microsoft public " + LICENSE), ("ms-rl", "ms rl ", "microsoft reciprocal " + LICENSE), ("ncsa", "ncsa ", "(?:university of illinois )?ncsa (?:open source )?" + LICENSE),
    ("postgresql", "postgresql ", "postgresql " + LICENSE), ("openssl", "openssl ", "openssl " + LICENSE), ("python", "psf 2 0 ", "python software foundation " + LICENSE),
    ("ruby", "ruby ", "ruby " + LICENSE), ("sleepycat", "sleepycat ", "sleepycat (?:public )?" + LICENSE), ("vim", "vim ", "vim " + LICENSE), ("curl", "curl ", "curl " + LICENSE),
    ("hpnd", "hpnd ", "historical permission notice and disclaimer "), ("beerware", "beerware ", "(?:the )?beer ware " + LICENSE), ("json", "json ", "json " + LICENSE),
    ("commons-clause", "commons clause ", "commons clause " + LICENSE), ("watcom", "watcom 1 0 ", "(?:sybase )?open watcom public " + LICENSE),
    ("intel", "intel ", "intel open source " + LICENSE), ("netscape", "npl 1 1 ", "netscape public " + LICENSE), ("ibm", "ipl 1 0 ", "ibm public " + LICENSE),
    ("nasa", "nasa 1 3 ", "nasa open source (?:agreement |" + LICENSE + ")"), ("ijg", "ijg ", "independent jpeg group " + LICENSE), ("blueoak", "blueoak 1 0 0 ", "blue oak model " + LICENSE),
    ("hippocratic", "hippocratic 2 1 ", "hippocratic " + LICENSE), ("openldap", "oldap 2 8 ", "openldap public " + LICENSE), ("w3c", "w3c ", "w3c (?:software )?(?:notice and )?" + LICENSE),
)
#: Kinds of Creative Commons licenses, as identified and as named, and their versions.
COMMONS = (
    ("by", "by ", "attribution "), ("by-sa", "by sa ", "attribution (?:sharealike |share alike )"), ("by-nd", "by nd ", "attribution (?:noderivatives |noderivs |no derivatives |no derivs )"),
    ("by-nc", "by nc ", "attribution (?:noncommercial |non commercial )"), ("by-nc-sa", "by nc sa ", "attribution (?:noncommercial |non commercial )(?:sharealike |share alike )"),
    ("by-nc-nd", "by nc nd ", "attribution (?:noncommercial |non commercial )(?:noderivatives |noderivs |no derivatives |no derivs )"),
)
COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Passages of licenses and of the notices that refer to them.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "),
    ("mit-0", "permission is hereby granted free of charge to any person obtaining a copy of this software (?:ANY ){0,4}without restriction (?:ANY ){0,6}mit no attribution "),
    ("x11", "except as contained in this notice the name of (?:ANY ){1,5}shall not be used in advertising "),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted "),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice "),
    ("bsd-3-clause", "neither the (?:name|names) of (?:ANY ){1,8}(?:nor the names of its contributors )?may be used to endorse or promote products derived from this software "),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledgement "),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable "),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software "),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software "),
    ("apache-2.0", "you may not use this file except in compliance with the " + LICENSE),
    ("apache-2.0", "you may obtain a copy of the license at (?:http |https )(?:www )?apache org licenses license 2 0 "),
    ("apache-2.0", "apache org licenses license 2 0 "),
    ("apache-2.0", "grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you "),
    ("apache-1.1", "this product includes software developed by the apache software foundation "),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "),
    ("gpl", "you should have received a copy of the gnu general public license along with (?:this program )?"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed "),
    ("gpl", "gnu org licenses gpl "), ("gpl-2.0", "gnu org licenses old licenses gpl 2 0 "), ("gpl-3.0", "gnu org licenses gpl 3 0 "),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license "),
    ("lgpl", "you should have received a copy of the gnu lesser general public license "), ("lgpl", "gnu org licenses lgpl "),
    ("agpl", "you should have received a copy of the gnu affero general public license "), ("agpl", "gnu org licenses agpl "),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license "),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license (?:v |version )?(?:2 |v2 )0 "),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1 "), ("mpl-2.0", "mozilla org mpl 2 0 "), ("mpl", "mozilla org mpl "),
    ("epl-1.0", "eclipse org legal epl v10 "), ("epl-2.0", "eclipse org legal epl 2 0 "), ("epl-2.0", "eclipse org legal epl v20 "),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license "),
    ("cddl", "the contents of this file are subject to the terms of (?:either )?(?:the gnu general public license (?:ANY ){0,6}or )?the common development and distribution license "),
    ("ofl", "this font software is licensed under the sil open font license "), ("ofl", "scripts sil org ofl "),
    ("unlicense", "this is free and unencumbered software released into the public domain "), ("unlicense", "unlicense org "),
    ("cc0", "creative commons zero (?:public domain dedication )?"), ("cc0", "to the extent possible under law (?:ANY ){1,8}waived all copyright and related or neighboring rights "), ("cc0-1.0", "creativecommons org publicdomain zero 1 0 "),
    ("public-domain", "creativecommons org publicdomain mark 1 0 "), ("public-domain", "(?:released|dedicated|placed) (?:in|into|to) the public domain "),
    ("public-domain", "this (?:work|file|software|document|text) is in the public domain "), ("wtfpl", "you just do what the (?:fuck|f) you want to "),
    ("bsl-1.0", "boost org license 1 0 "), ("bsl-1.0", "distributed under the boost software license version 1 0 "),
    ("artistic-2.0", "everyone is permitted to copy and distribute verbatim copies of this license document (?:ANY ){0,9}artistic license 2 0 "),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license "),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit "),
    ("python", "the python software foundation is making python available to licensee on an as is basis "),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee "),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer in return "),
    ("json", "the software shall be used for good not evil "), ("ijg", "this software is based in part on the work of the independent jpeg group "),
    ("hpnd", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee "),
    ("curl", "curl haxx se docs copyright "), ("commons-clause", "the grant of rights under the license will not include and the license does not grant to you the right to sell the software "),
    ("busl", "effective on the change date or the fourth anniversary of the first publicly available distribution "),
    ("proprietary", "confidential and proprietary (?:information )?(?:of|do not distribute) "), ("proprietary", "unauthorized (?:copying|reproduction|use) (?:ANY ){0,8}is strictly prohibited "),
    ("proprietary", "may not be (?:copied|reproduced|redistributed|republished) (?:ANY ){0,8}without (?:the )?(?:prior )?(?:express )?(?:written )?(?:permission|consent) "),
    ("all-rights-reserved", "all rights reserved "), ("all-rights-reserved", "alle rechte vorbehalten "), ("all-rights-reserved", "tous droits reserves "), ("all-rights-reserved", "tous droits réservés "),
    ("all-rights-reserved", "todos los derechos reservados "),
)
#: Hints that some license is meant.
HINTS = (
    ("unnamed-license", "(?:licensed|released|distributed|published) under (?:the )?(?:terms of )?(?:the )?(?:ANY ){1,4}" + LICENSE), ("unnamed-license", "see (?:the )?(?:accompanying )?license (?:file|txt|md) "),
    ("unnamed-license", "(?:dual|multi) licensed under "), ("unnamed-license", "unter der (?:ANY ){0,3}lizenz "), ("unnamed-license", "sous (?:la )?licence "), ("unnamed-license", "bajo (?:la )?licencia "),
    ("creative-commons", "creative commons (?:public )?" + LICENSE), ("creative-commons", "creativecommons org licenses "), ("gpl-compatible", "gpl compatible "), ("copyleft", "copyleft " + LICENSE),
)


@dataclass(frozen=True)
class Rule:
    tier: int
    label: str
    pattern: str
    base: bool = False


def version(number: str) -> str:
    """A version as words: '2.0' is '2 0', '2', 'v2 0', 'v2', with 'version' or 'v' before it or not."""
    major, minor = number.split(".")
    tail = f"(?:{minor} )?" if minor == "0" else f"{minor} "
    return f"(?:(?:version |v |ver )?{major} {tail}|v{major} {tail})"


def every_rule() -> tuple[Rule, ...]:
    """All rules in order: by tier, then as listed."""
    rules = [Rule(NAMED, label, phrase + " ", True) for phrase, label in BASE.items()]
    spdx = "spdx license identifier "
    for label, short, long, versions in VERSIONED_FAMILIES:
        copyleft = label in ("gpl", "lgpl", "agpl", "gfdl")
        for number in versions:
            words, full = number.replace(".", " ") + " ", f"{label}-{number}"
            rules += [Rule(IDENTIFIER, full, spdx + short + words + ONLY), Rule(VERSIONED, full, LEAD + "(?:the )?" + long + version(number)), Rule(VERSIONED, full, short + version(number) + LICENSE * (label in AMBIGUOUS))]
            if copyleft:
                later = "or later "
                rules += [Rule(IDENTIFIER, full + "-or-later", spdx + short + words + later), Rule(VERSIONED, full + "-or-later", LEAD + "(?:the )?" + long + version(number) + LATER), Rule(VERSIONED, full + "-or-later", short + version(number) + LATER)]
                rules.append(Rule(VERSIONED, full, f"{short.strip()}v{number.split('.')[0]} " if number.endswith(".0") else f"{short.strip()}v{words}"))
        rules.append(Rule(NAMED, label, LEAD + "(?:the )?" + long))
    rules += [Rule(NAMED, label, f"(?:the )?(?:gnu )?{label} ") for label in ("gpl", "lgpl", "agpl")]
    for label, short, name in SINGLE:
        rules += [Rule(IDENTIFIER, label, spdx + short), Rule(NAMED, label, LEAD + "(?:the )?" + name)]
    for kind, short, long in COMMONS:
        for number in COMMONS_VERSIONS:
            words = number.replace(".", " ") + " "
            rules += [
                Rule(IDENTIFIER, f"cc-{kind}-{number}", spdx + "cc " + short + words), Rule(VERSIONED, f"cc-{kind}-{number}", LEAD + "(?:the )?cc " + short + words),
                Rule(VERSIONED, f"cc-{kind}-{number}", LEAD + "(?:a |the )?creative commons " + long + words + "(?:international |unported |generic )?(?:public )?(?:license |licence )?"),
                Rule(NOTICE, f"cc-{kind}-{number}", "creativecommons org licenses " + short + words),
            ]
        rules += [Rule(NAMED, f"cc-{kind}", LEAD + "(?:the )?cc " + short + "(?:license |licence )?"), Rule(NAMED, f"cc-{kind}", LEAD + "(?:a |the )?creative commons " + long + "(?:public )?(?:license |licence )?")]
    rules += [Rule(NOTICE, label, pattern) for label, pattern in NOTICES] + [Rule(HINT, label, pattern) for label, pattern in HINTS]
    return tuple(sorted(dict.fromkeys(rules), key=lambda r: r.tier))


def spelled(pattern: str) -> str:
    """The regex of a pattern for texts whose words have a space on either side: each word in it gets its own."""
    wild = {"NUM": "[0-9]+", "ANY": "[^ ]+"}
    return re.sub(r"\{[^}]*\}|NUM|ANY|[^\W_]+", lambda m: m[0] if m[0][0] == "{" else " " + wild.get(m[0], m[0]), pattern)


def needed(pattern: str) -> list[list[str]]:
    """Of each list one word at least is in every text that the pattern matches: the words outside of groups that may be absent, alternatives of single words as one list. The longest ones, KEYWORDS at most; short and common words only if there is no other."""
    group = re.compile(r"\(\?:([^()]*)\)(\?|\{0,\d+\}|\{[1-9]\d*,\d+\})?")
    while found := group.search(pattern):
        inner, mark = found[1], found[2] or ""
        choices = [c.split() for c in inner.split("|")]
        if mark == "?" or mark.startswith("{0"):
            kept = " "
        elif len(choices) == 1:
            kept = f" {inner} "
        elif all(len(c) == 1 for c in choices):
            kept = " " + "/".join(c[0] for c in choices) + " "
        else:
            kept = " "
        # What stands for a group takes part in the groups around it as the words it holds.
        pattern = pattern[: found.start()] + kept + pattern[found.end() :]
    words = [sorted(w.split("/")) for w in pattern.split() if w not in ("NUM", "ANY")]
    ranked = sorted({tuple(w) for w in words}, key=lambda w: (-min(map(len, w)), w))
    telling = [w for w in ranked if all(len(x) > 2 and x not in COMMON for x in w)]
    return [list(w) for w in (telling or ranked)[:KEYWORDS]]
