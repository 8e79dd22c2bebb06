"""License scans: ordered signature rules over the words of a text.

A text is reduced to its words, lower-cased and joined by single spaces. A rule is a pattern over those
words with keywords of which one must occur for the pattern to be tried, a label and a priority. Detections
are intervals of words. One that lies within another of at least its priority is suppressed, whatever
rule found it. DataFrame functions only: everything happens within a row, without a shuffle.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """regex: over words separated by single spaces, from a word's start to a word's end. Each of its
    alternatives holds a keyword at a word's start; several keywords are a tuple."""

    label: str
    keyword: str | tuple[str, ...]
    regex: str
    priority: int
    base: bool = False


#: What priorities mean, and how sure a detection of each makes that the text has a license.
NAMED, REFERRED, NOTICE, TAGGED = 1, 2, 3, 4
SURE = {0: 0.5, NAMED: 0.6, REFERRED: 0.8, NOTICE: 0.9, TAGGED: 1.0}

#: Fixed phrases whose places are always reported, suppressed or not.
BASE = (Rule("mit", "license", "mit license", NAMED, True), Rule("apache", "license", "apache license", NAMED, True), Rule("gpl", "license", "general public license", NAMED, True))

V = r"(?: version| v| ver| release)?"
#: Families: SPDX label, keyword, pattern of the name. Each gives a rule for the name, one for a phrase
#: that puts something under it, and one for its SPDX tag.
FAMILIES = (
    ("0BSD", ("bsd", "0bsd"), r"(?:zero clause bsd|bsd zero clause|0bsd)(?: license)?"),
    ("AFL-3.0", "academic", rf"academic free license{V}(?: v?3(?: 0)?)?"),
    ("AGPL-3.0", "agpl", rf"agpl(?: ?v?3(?: 0)?|{V} v?3(?: 0)?)?"),
    ("AGPL-3.0", "affero", rf"(?:gnu )?affero general public license{V}(?: v?3(?: 0)?)?"),
    ("Apache-1.1", "apache", rf"apache(?: software)? license{V} v?1 1"),
    ("Apache-2.0", "apache", rf"apache(?: software)?(?: license)?{V} v?2(?: 0)?"),
    ("Apache", "apache", r"apache(?: software)? license"),
    ("Apache-1.0", "apache", rf"apache(?: software)? license{V} v?1 0"),
    ("APSL-2.0", "apple", rf"apple public source license{V}(?: v?2(?: 0)?)?"),
    ("Artistic-1.0", "artistic", rf"artistic license{V} v?1(?: 0)?"),
    ("Artistic-2.0", "artistic", rf"artistic license{V} v?2(?: 0)?"),
    ("BlueOak-1.0.0", "blue", rf"blue oak model license{V}(?: v?1 0 0)?"),
    ("BSD-1-Clause", "bsd", r"(?:1|one) clause bsd(?: license)?|bsd (?:1|one) clause(?: license)?"),
    ("BSD-2-Clause", ("bsd", "freebsd"), r"(?:2|two) clause bsd(?: license)?|bsd (?:2|two) clause(?: license)?|simplified bsd license|freebsd license"),
    ("BSD-3-Clause", "bsd", r"(?:3|three) clause bsd(?: license)?|bsd (?:3|three) clause(?: license)?|(?:new|modified|revised) bsd license"),
    ("BSD-4-Clause", "bsd", r"(?:4|four) clause bsd(?: license)?|bsd (?:4|four) clause(?: license)?|original bsd license"),
    ("BSL-1.0", "boost", rf"boost software license{V}(?: v?1(?: 0)?)?"),
    ("BUSL-1.1", "business", rf"business source license{V}(?: v?1(?: 1)?)?"),
    ("CAL-1.0", "cryptographic", rf"cryptographic autonomy license{V}(?: v?1(?: 0)?)?"),
    ("CC0-1.0", "cc0", rf"(?:creative commons )?cc0{V}(?: v?1(?: 0)?)?(?: universal)?"),
    ("CC-BY-4.0", "cc", r"cc by(?: license)? 4(?: 0)?"),
    ("CC-BY-3.0", "cc", r"cc by(?: license)? 3(?: 0)?"),
    ("CC-BY-SA-4.0", "cc", r"cc by sa(?: license)? 4(?: 0)?"),
    ("CC-BY-SA-3.0", "cc", r"cc by sa(?: license)? 3(?: 0)?"),
    ("CC-BY-NC-4.0", "cc", r"cc by nc(?: license)? 4(?: 0)?"),
    ("CC-BY-NC-SA-4.0", "cc", r"cc by nc sa(?: license)? 4(?: 0)?"),
    ("CC-BY-NC-ND-4.0", "cc", r"cc by nc nd(?: license)? 4(?: 0)?"),
    ("CC-BY-ND-4.0", "cc", r"cc by nd(?: license)? 4(?: 0)?"),
    ("CC-BY-4.0", "creative", r"creative commons attribution 4(?: 0)?(?: international)?"),
    ("CC-BY-3.0", "creative", r"creative commons attribution 3(?: 0)?(?: unported)?"),
    ("CC-BY-SA-4.0", "creative", r"creative commons attribution share ?alike 4(?: 0)?(?: international)?"),
    ("CC-BY-SA-3.0", "creative", r"creative commons attribution share ?alike 3(?: 0)?(?: unported)?"),
    ("CC-BY-NC-4.0", "creative", r"creative commons attribution non ?commercial 4(?: 0)?(?: international)?"),
    ("CC-BY-ND-4.0", "creative", r"creative commons attribution no ?derivatives 4(?: 0)?(?: international)?"),
    ("CDDL-1.0", "cddl", rf"cddl{V}(?: v?1(?: 0)?)?"),
    ("CDDL-1.0", "distribution", rf"common development and distribution license{V}(?: v?1(?: 0)?)?"),
    ("CECILL-2.1", "cecill", rf"cecill(?: license)?{V}(?: v?2(?: 1)?)?"),
    ("CPL-1.0", "common", rf"common public license{V}(?: v?1(?: 0)?)?"),
    ("CPAL-1.0", "attribution", rf"common public attribution license{V}(?: v?1(?: 0)?)?"),
    ("ECL-2.0", "educational", rf"educational community license{V}(?: v?2(?: 0)?)?"),
    ("EFL-2.0", "eiffel", rf"eiffel forum license{V}(?: v?2(?: 0)?)?"),
    ("Elastic-2.0", "elastic", rf"elastic license{V}(?: v?2(?: 0)?)?"),
    ("EPL-1.0", "eclipse", rf"eclipse public license{V} v?1(?: 0)?"),
    ("EPL-2.0", "eclipse", rf"eclipse public license{V}(?: v?2(?: 0)?)?"),
    ("EUPL-1.2", "eupl", rf"eupl{V}(?: v?1 2)?"),
    ("EUPL-1.2", "european", rf"european union public licen[cs]e{V}(?: v?1 2)?"),
    ("FTL", "freetype", r"freetype(?: project)? license"),
    ("GFDL-1.3", "documentation", rf"(?:gnu )?free documentation license{V}(?: v?1(?: [123])?)?"),
    ("GPL-1.0", "general", rf"(?:gnu )?general public license{V} v?1(?: 0)?"),
    ("GPL-2.0", "general", rf"(?:gnu )?general public license{V} v?2(?: 0)?"),
    ("GPL-3.0", "general", rf"(?:gnu )?general public license{V} v?3(?: 0)?"),
    ("GPL-2.0", "gpl", rf"(?:gnu )?gpl(?: ?v| version)? ?2(?: 0)?|gplv2"),
    ("GPL-3.0", "gpl", rf"(?:gnu )?gpl(?: ?v| version)? ?3(?: 0)?|gplv3"),
    ("GPL", ("general", "gpl"), r"gnu general public license|(?:gnu )?gpl"),
    ("LGPL", ("lesser", "lgpl"), r"(?:gnu )?lesser general public license|(?:gnu )?lgpl"),
    ("BSD", "bsd", r"bsd(?: style)? license"),
    ("HPND", "historical", r"historical permission notice and disclaimer"),
    ("ICU", "icu", r"icu license"),
    ("IJG", "jpeg", r"independent jpeg group(?: license)?"),
    ("IPL-1.0", "ibm", rf"ibm public license{V}(?: v?1(?: 0)?)?"),
    ("ISC", "isc", r"isc(?: license)?"),
    ("JSON", "json", r"json license"),
    ("LGPL-2.0", "library", rf"(?:gnu )?library general public license{V}(?: v?2(?: 0)?)?"),
    ("LGPL-2.1", "lesser", rf"(?:gnu )?lesser general public license{V} v?2(?: 1)?"),
    ("LGPL-3.0", "lesser", rf"(?:gnu )?lesser general public license{V} v?3(?: 0)?"),
    ("LGPL-2.1", "lgpl", rf"lgpl(?: ?v| version)? ?2(?: 1)?|lgplv2"),
    ("LGPL-3.0", "lgpl", rf"lgpl(?: ?v| version)? ?3(?: 0)?|lgplv3"),
    ("LPPL-1.3c", "latex", rf"latex project public license{V}(?: v?1 3c?)?"),
    ("Libpng", "libpng", r"libpng license"),
    ("MIT", "mit", r"(?:the )?mit(?: x11| expat)? licen[cs]e"),
    ("MIT-0", "mit", r"mit no attribution(?: license)?|mit 0(?: license)?"),
    ("MPL-1.1", "mozilla", rf"mozilla public license{V} v?1 1"),
    ("MPL-1.1", "mpl", rf"mpl{V} v?1 1"),
    ("MPL-2.0", "mpl", rf"mpl{V}(?: v?2(?: 0)?)?"),
    ("MPL-2.0", "mozilla", rf"mozilla public license{V}(?: v?2(?: 0)?)?"),
    ("MS-PL", "microsoft", r"microsoft public license"),
    ("MS-RL", "microsoft", r"microsoft reciprocal license"),
    ("MulanPSL-2.0", "mulan", rf"mulan permissive software license{V}(?: v?2)?"),
    ("NCSA", "illinois", r"university of illinois ncsa open source license"),
    ("NPL-1.1", "netscape", rf"netscape public license{V}(?: v?1 1)?"),
    ("ODbL-1.0", "database", rf"open (?:data commons open )?database license{V}(?: v?1(?: 0)?)?"),
    ("ODC-By-1.0", "commons", rf"open data commons attribution license{V}(?: v?1(?: 0)?)?"),
    ("OFL-1.1", "font", rf"(?:sil )?open font license{V}(?: v?1(?: 1)?)?"),
    ("OpenSSL", "openssl", r"openssl license"),
    ("OSL-3.0", "open", rf"open software license{V}(?: v?3(?: 0)?)?"),
    ("PDDL-1.0", "dedication", r"public domain dedication and license"),
    ("PHP-3.01", "php", rf"php license{V}(?: v?3 01)?"),
    ("PostgreSQL", "postgresql", r"postgresql licen[cs]e"),
    ("PSF-2.0", "python", rf"python software foundation license{V}(?: v?2(?: 0)?)?"),
    ("QPL-1.0", "q", rf"q public license{V}(?: v?1(?: 0)?)?"),
    ("Ruby", "ruby", r"ruby license"),
    ("SISSL", "sun", r"sun industry standards source license"),
    ("Sleepycat", "sleepycat", r"sleepycat license"),
    ("SSPL-1.0", "server", rf"server side public license{V}(?: v?1(?: 0)?)?"),
    ("TCL", "tcl", r"tcl(?: tk)? license"),
    ("Unicode-DFS-2016", "unicode", r"unicode (?:data files and software )?license(?: agreement)?"),
    ("Unlicense", "unlicense", r"(?:the )?unlicense"),
    ("UPL-1.0", "universal", rf"universal permissive license{V}(?: v?1(?: 0)?)?"),
    ("Vim", "vim", r"vim license"),
    ("W3C", "w3c", r"w3c software(?: notice and)? license"),
    ("WTFPL", ("wtfpl", "fuck"), r"wtfpl|do what the fuck you want to public license"),
    ("X11", "x11", r"x11 license"),
    ("Zlib", "zlib", r"zlib(?: libpng)? license"),
    ("ZPL-2.1", "zope", rf"zope public license{V}(?: v?2(?: 1)?)?"),
)
#: Sentences of license texts and of notices: label, keyword, pattern.
NOTICES = (
    ("MIT", "permission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("ISC", "permission", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("BSD-2-Clause", "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("BSD-2-Clause", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("BSD-3-Clause", "endorse", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD-4-Clause", "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("Zlib", "warranty", r"this software is provided as is without any express or implied warranty"),
    ("Zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("GPL", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("LGPL", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("AGPL-3.0", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("Apache-2.0", "compliance", r"you may not use this file except in compliance with the license"),
    ("Apache-2.0", "apache", r"www apache org licenses license 2 0(?: txt| html)?"),
    ("MPL-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license"),
    ("MPL-2.0", "mozilla", r"mozilla org mpl 2 0"),
    ("BSL-1.0", "boost", r"boost software license version 1 0 17 august 2003"),
    ("Unlicense", "public", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "public", r"(?:placed in|released into|dedicated to|is in) the public domain"),
    ("CC0-1.0", "creativecommons", r"creativecommons org publicdomain zero 1 0"),
    ("CC-BY-4.0", "creativecommons", r"creativecommons org licenses by 4 0"),
    ("CC-BY-SA-4.0", "creativecommons", r"creativecommons org licenses by sa 4 0"),
    ("CC-BY-NC-4.0", "creativecommons", r"creativecommons org licenses by nc 4 0"),
    ("CC-BY-ND-4.0", "creativecommons", r"creativecommons org licenses by nd 4 0"),
    ("GPL-2.0-or-later", "later", r"general public license(?: as published by the free software foundation either)? version 2(?: of the license)? or(?: at your option)? any later version"),
    ("GPL-3.0-or-later", "later", r"general public license(?: as published by the free software foundation either)? version 3(?: of the license)? or(?: at your option)? any later version"),
    ("MIT", "copyright", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("MIT", "warranty", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("MIT", "authors", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("MIT-0", "restriction", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("ISC", "author", r"the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("ISC", "special", r"in no event shall the author be liable for any special direct indirect or consequential damages"),
    ("BSD-2-Clause", "redistributions", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BSD-2-Clause", "copyright", r"this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    ("BSD-3-Clause", "neither", r"neither the name of the (?:copyright holder|university|organization|[^ ]+)(?: nor the names of its contributors)? may be used"),
    ("BSD-4-Clause", "acknowledgement", r"the following acknowledgement this product includes software developed by"),
    ("Apache-2.0", "licensed", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("Apache-2.0", "apache", r"licensed under the apache license version 2 0 the license"),
    ("Apache-2.0", "conditions", r"without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations"),
    ("Apache-2.0", "grants", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    ("GPL", "designed", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("GPL", "copyleft", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("GPL", "received", r"you should have received a copy of the gnu general public license along with this program"),
    ("GPL", "useful", r"this program is distributed in the hope that it will be useful but without any warranty"),
    ("GPL-2.0-only", "version", r"the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("GPL-2.0", "version", r"gnu general public license version 2 june 1991"),
    ("GPL-3.0", "version", r"gnu general public license version 3 29 june 2007"),
    ("LGPL-2.1", "version", r"gnu lesser general public license version 2 1 february 1999"),
    ("LGPL-3.0", "version", r"gnu lesser general public license version 3 29 june 2007"),
    ("LGPL", "received", r"you should have received a copy of the gnu lesser general public license"),
    ("LGPL", "library", r"this library is free software you can redistribute it and or modify it"),
    ("AGPL-3.0", "version", r"gnu affero general public license version 3 19 november 2007"),
    ("AGPL-3.0", "remotely", r"all users interacting with it remotely through a computer network"),
    ("MPL-2.0", "mpl", r"if a copy of the mpl was not distributed with this file you can obtain one"),
    ("MPL-1.1", "contents", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("EPL-2.0", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("CDDL-1.0", "contents", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("BSL-1.0", "boost", r"distributed under the boost software license"),
    ("Zlib", "permission", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("Zlib", "altered", r"altered source versions must be plainly marked as such"),
    ("Unlicense", "anyone", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("WTFPL", "everyone", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("CC0-1.0", "associated", r"to the extent possible under law the (?:author|person)(?: s)? who associated cc0 with this work"),
    ("CC0-1.0", "waived", r"has waived all copyright and related or neighboring rights"),
    ("CC-BY-4.0", "attribution", r"licensed under a creative commons attribution 4 0 international license"),
    ("CC-BY-SA-4.0", "attribution", r"licensed under a creative commons attribution share ?alike 4 0 international license"),
    ("OFL-1.1", "font", r"this font software is licensed under the sil open font license version 1 1"),
    ("Artistic-2.0", "artistic", r"the artistic license 2 0 copyright c 2000 2006 the perl foundation"),
    ("PSF-2.0", ("psf", "python"), r"psf is making python available to licensee on an as is basis|this license agreement is between the python software foundation"),
    ("SSPL-1.0", "mongodb", r"server side public license version 1 october 16 2018 copyright 2018 mongodb"),
    ("BUSL-1.1", "licensor", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use"),
    ("Elastic-2.0", "hosted", r"you may not provide the software to third parties as a hosted or managed service"),
    ("HPND", "supporting", r"that both that copyright notice and this permission notice appear in supporting documentation"),
    ("NCSA", "documentation", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimers in the documentation"),
    ("proprietary", "unpublished", r"unpublished(?: proprietary)? (?:work|source code)"),
    ("proprietary", "evaluation", r"for (?:internal )?evaluation (?:use|purposes) only"),
    ("non-commercial", ("non", "noncommercial"), r"for non ?commercial (?:use|purposes)(?: only)?"),
    ("research-only", "research", r"for (?:academic |educational )?research (?:use|purposes) only"),
    ("proprietary", "reserved", r"all rights reserved(?: unauthorized (?:copying|use|reproduction)[^|]{0,80}?prohibited)?"),
    ("proprietary", "confidential", r"proprietary and confidential"),
    ("copyright", "copyright", r"copyright(?: c)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?"),
    ("unspecified", "licensed", r"licensed under"),
    ("unspecified", "terms", r"under the terms of the [^ ]+(?: [^ ]+){0,4}? license"),
)


def default_rules() -> tuple[Rule, ...]:
    """The rules in their order: earlier ones go before later ones of the same priority and interval."""
    rules = list(BASE)
    under = r"(?:licen[cs]ed|released|distributed|available|published|provided)(?: to you)? under(?: the)?(?: terms of)?(?: the)? "
    for label, keyword, name in FAMILIES:
        tag = " ".join("".join(c if c.isalnum() else " " for c in label.lower()).split())
        rules += [
            Rule(label, "spdx", rf"spdx license identifier {tag}(?: only| or later)?", TAGGED),
            Rule(label, keyword, rf"{under}(?:{name})", REFERRED),
            Rule(label, keyword, rf"(?:{name})", NAMED),
        ]
    rules += [Rule(label, keyword, regex, NAMED if label in ("copyright", "unspecified", "proprietary") else NOTICE) for label, keyword, regex in NOTICES]
    # a tag is the same for all rules of a label
    return tuple(dict.fromkeys(rules))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters that aren't letters or digits stand between words.
GAPS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words_of(text: Column) -> Column:
    """The text's words, A-Z lower-cased, with a space around and between them; ' ' if there are none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), UPPER + GAPS, LOWER + " " * len(GAPS))
    return F.regexp_replace(F.concat(F.lit(" "), spaced, F.lit(" ")), " {2,}", " ")


def _needles(rule: Rule) -> list[str]:
    """The keywords as they stand among the words: at a word's start, short ones as a whole word."""
    keywords = (rule.keyword,) if isinstance(rule.keyword, str) else rule.keyword
    return [f" {k} " if rule.base or len(k) < 3 else f" {k}" for k in keywords]


def _rule_array(rules) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(r.label).alias("label"),
                F.array(*map(F.lit, _needles(r))).alias("keywords"),
                F.lit(turn).alias("turn"),
                F.lit(rf"(?<= )(?:{r.regex})(?= )").alias("regex"),
                F.lit(r.priority).alias("priority"),
                F.lit(r.base).alias("base"),
            )
            for turn, r in enumerate(rules)
        ]
    )


def _places(words: Column, rule: Column) -> Column:
    """A rule's detections: its matches are marked at their starts, and the words that carry a mark have
    their place in the word list."""
    marked = F.split(F.substring(F.regexp_replace(words, rule["regex"], F.lit("\x01$0")), 2, 2**31 - 1), " ")
    starts = F.filter(F.transform(marked, lambda w, i: F.when(F.startswith(w, F.lit("\x01")), i)), lambda i: i.isNotNull())
    found = F.regexp_extract_all(words, rule["regex"], F.lit(0))
    return F.zip_with(
        starts,
        found,
        lambda s, m: F.struct(
            s.alias("start"),
            (-(s + F.size(F.split(m, " ")))).alias("minus_end"),
            (-rule["priority"]).alias("minus_priority"),
            rule["turn"].alias("turn"),
            rule["label"].alias("label"),
            rule["base"].alias("base"),
        ),
    )


#: Kept detections are gathered in blocks of this length, so that adding one never copies all.
BLOCK = 256


def _suppress(sorted_: Column, most: int) -> Column:
    """Drop the detections that lie within another of at least their priority. In order of start, then
    of longest and highest, all that could hold a detection come before it, so the furthest end seen
    so far of each priority decides."""
    item = "struct<start:int,minus_end:int,minus_priority:int,turn:int,label:string,base:boolean>"
    start = F.struct(
        F.array(*[F.lit(-1)] * (most + 1)).alias("ends"),
        F.array().cast(f"array<{item}>").alias("block"),
        F.array().cast(f"array<array<{item}>>").alias("blocks"),
    )

    def step(acc: Column, d: Column) -> Column:
        end, priority = -d["minus_end"], -d["minus_priority"]
        held = F.exists(F.transform(acc["ends"], lambda e, p: (p >= priority) & (e >= end)), lambda x: x)
        ends = F.transform(acc["ends"], lambda e, p: F.when((p == priority) & (e < end), end).otherwise(e))
        full = F.size(acc["block"]) >= BLOCK
        block = F.when(full, F.array(d.cast(item))).otherwise(F.concat(acc["block"], F.array(d.cast(item))))
        blocks = F.when(full, F.concat(acc["blocks"], F.array(acc["block"]))).otherwise(acc["blocks"])
        return F.when(held, acc).otherwise(F.struct(ends.alias("ends"), block.alias("block"), blocks.alias("blocks")))

    return F.aggregate(sorted_, start, step, lambda a: F.concat(F.flatten(a["blocks"]), a["block"]))


def license_scan(docs: DataFrame, rules: tuple[Rule, ...] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, detections (kept ones: label, start, end in words, end exclusive, priority, in
    order), base_places (start and label of each place of a base phrase) and score (how sure the surest
    detection makes a license; 0 without one).

    A null or empty text has no words and no detections. Rows are independent: repeated ones give
    repeated results, and other columns are ignored. A detection equal to another in interval and
    priority is dropped if its rule comes later; a base phrase's place is never dropped.
    """
    rules = default_rules() if rules is None else rules
    keywords = sorted({k for r in rules for k in _needles(r)})
    most = max(r.priority for r in rules)
    base = docs.select(F.col(id_col), words_of(F.col(text_col)).alias("words"))
    base = base.withColumn("n_words", F.regexp_count("words", F.lit("[^ ]+")).cast("long"))
    present = F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.col("words"), k))
    # two steps: which keywords a text has, then the rules of those keywords
    base = base.withColumn("present", F.when(F.col("words").rlike(_gate(rules)), present).otherwise(F.array().cast("array<string>")))
    tried = F.filter(_rule_array(rules), lambda r: F.arrays_overlap(F.col("present"), r["keywords"]) & F.rlike(F.col("words"), r["regex"]))
    none = F.array().cast("array<struct<start:int,minus_end:int,minus_priority:int,turn:int,label:string,base:boolean>>")
    found = F.when(F.size("present") > 0, F.flatten(F.transform(tried, lambda r: _places(F.col("words"), r)))).otherwise(none)
    base = base.withColumn("found", found).select(id_col, "n_words", "found")
    kept = F.when(F.size("found") > 0, _suppress(F.array_sort(F.filter("found", lambda d: ~d["base"])), most)).otherwise(none)
    sure = F.create_map(*[F.lit(x) for kv in SURE.items() for x in kv])
    out = base.withColumn("kept", kept)
    return out.select(
        id_col,
        "n_words",
        F.transform("kept", lambda d: F.struct(d["label"].alias("label"), d["start"].alias("start"), (-d["minus_end"]).alias("end"), (-d["minus_priority"]).alias("priority"))).alias("detections"),
        F.transform(F.filter("found", lambda d: d["base"]), lambda d: F.struct(d["start"].alias("start"), d["label"].alias("label"))).alias("base_places"),
        F.coalesce(F.array_max(F.transform("kept", lambda d: F.element_at(sure, -d["minus_priority"]))), F.when(F.size("found") > 0, F.lit(SURE[0])), F.lit(0.0)).alias("score"),
    )


def _gate(rules) -> str:
    """One pattern for the texts that hold a keyword at all, its branches told apart by their first letter."""
    by_first: dict[str, set[str]] = {}
    for r in rules:
        for k in _needles(r):
            by_first.setdefault(k[1], set()).add(k[2:])
    return " (?:" + "|".join(f"{c}(?:{'|'.join(sorted(rest))})" for c, rest in sorted(by_first.items())) + ")"
