"""License scans: ordered signature rules behind a keyword gate, with interval containment settled by priority.

DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What parts words: ASCII but digits and small letters, after lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Rule:
    """pattern: a regex over words with one space between them; keyword: words that every match holds."""

    label: str
    priority: int
    score: float
    keyword: str
    pattern: str
    base: bool = False

    @property
    def regex(self) -> str:
        """The pattern over the spaced text, where every word has a space of its own on either side."""
        return " " + self.pattern.replace(" ", "  ") + " "


#: Phrases that are always reported.
BASE = [
    Rule("mit", 100, 1.0, "license", "under the mit license", True),
    Rule("apache-2", 100, 1.0, "license", "apache license version 2", True),
    Rule("cc-by-nc", 100, 1.0, "cc", "cc by nc", True),
]

#: Label, priority, score, keyword, pattern: wordings of notices, grants, tags, titles and texts, each written for what it is.
SIGNATURES = [
    # MIT and its kin
    ("mit", 95, 1.0, "spdx", "spdx license identifier mit"),
    ("mit", 90, 1.0, "licensed", "(?:(?:is|are) )?licensed under(?: the)?(?: terms of(?: the)?)? (?:mit|expat|x11)(?: open source)?(?: license)?"),
    ("mit", 88, 0.95, "released", "released under(?: the)?(?: terms of(?: the)?)? (?:mit|expat|x11)(?: license)?"),
    ("mit", 88, 0.95, "distributed", "distributed under(?: the)?(?: terms of(?: the)?)? (?:mit|expat|x11)(?: license)?"),
    ("mit", 80, 0.9, "available", "(?:made )?available under(?: the)?(?: terms of(?: the)?)? (?:mit|expat|x11)(?: license)?"),
    ("mit", 80, 0.9, "dual", "dual licensed under(?: the)? mit and(?: the)? apache(?: license)?(?: version)? 2(?: 0)?"),
    ("mit", 75, 0.85, "license", "the mit license mit"),
    ("mit", 72, 0.8, "license", "license(?: type)?(?: is)?(?: the)? mit"),
    ("mit", 60, 0.7, "license", "(?:mit|expat|x11)(?: style)? license"),
    ("mit", 78, 0.9, "opensource", "opensource org licenses? mit(?: license)?(?: php| html)?"),
    ("mit", 90, 0.95, "hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 70, 0.7, "notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 60, 0.6, "liable", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit-0", 95, 1.0, "spdx", "spdx license identifier mit 0"),
    ("mit-0", 85, 0.95, "license", "mit no attribution license"),
    ("mit-0", 60, 0.6, "sublicense", "without limitation the rights to use copy modify merge publish distribute sublicense"),
    ("isc", 95, 1.0, "spdx", "spdx license identifier isc"),
    ("isc", 90, 0.95, "hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 85, 0.9, "licensed", "licensed under(?: the)?(?: terms of(?: the)?)? isc(?: license)?"),
    ("isc", 60, 0.7, "license", "(?:the )?isc license"),
    ("isc", 70, 0.7, "disclaims", "the author disclaims all warranties with regard to this software"),
    # BSD
    ("bsd-2", 95, 1.0, "spdx", "spdx license identifier bsd 2 clause"),
    ("bsd-3", 95, 1.0, "spdx", "spdx license identifier bsd 3 clause"),
    ("bsd-4", 95, 1.0, "spdx", "spdx license identifier bsd 4 clause"),
    ("0bsd", 95, 1.0, "spdx", "spdx license identifier 0bsd"),
    ("bsd-2", 80, 0.8, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-2", 82, 0.85, "bsd", "(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd|freebsd bsd)(?: license)?"),
    ("bsd-3", 84, 0.9, "bsd", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: license)?"),
    ("bsd-4", 84, 0.9, "bsd", "(?:original bsd|old bsd|bsd 4 clause|4 clause bsd)(?: license)?"),
    ("bsd-3", 85, 0.9, "endorse", "may be used to endorse or promote products derived from this software"),
    ("bsd-4", 86, 0.9, "advertising", "all advertising materials mentioning features or use of this software"),
    ("bsd", 62, 0.7, "bsd", "(?:under|license) (?:the |a )?bsd(?: style)?(?: license)?"),
    ("bsd", 55, 0.6, "bsd", "bsd(?: style)? license"),
    ("bsd", 64, 0.7, "governed", "governed by a bsd style license that can be found in the license file"),
    ("bsd-2", 65, 0.6, "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd-2", 65, 0.6, "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    # Apache
    ("apache-2", 95, 1.0, "spdx", "spdx license identifier apache 2 0"),
    ("apache-2", 92, 1.0, "apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance"),
    ("apache-2", 90, 1.0, "apache", "(?:licensed|released|distributed|available) under(?: the)?(?: terms of(?: the)?)? apache(?: software)?(?: license)?(?: version| v)? ?v?2(?: 0)?(?: license)?"),
    ("apache-2", 80, 0.9, "apache", "apache org licenses license 2 0(?: txt| html)?"),
    ("apache-2", 75, 0.85, "apache", "apache(?: software)? license(?: version| v)? ?v?2(?: 0)?"),
    ("apache-2", 70, 0.8, "apache", "apache 2(?: 0)? license"),
    ("apache-2", 72, 0.8, "license", "license(?: is)?(?: the)? apache 2(?: 0)?"),
    ("apache-1.1", 95, 1.0, "spdx", "spdx license identifier apache 1 1"),
    ("apache-1.1", 76, 0.85, "apache", "apache(?: software)? license(?: version)? 1 1"),
    ("apache", 50, 0.6, "apache", "apache(?: software)? license"),
    ("apache-2", 68, 0.7, "conditions", "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions"),
    ("apache", 60, 0.6, "contributor", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    # GPL family
    ("gpl-2", 95, 1.0, "spdx", "spdx license identifier gpl 2 0(?: only)?"),
    ("gpl-2", 96, 1.0, "spdx", "spdx license identifier gpl 2 0 or later"),
    ("gpl-3", 95, 1.0, "spdx", "spdx license identifier gpl 3 0(?: only)?"),
    ("gpl-3", 96, 1.0, "spdx", "spdx license identifier gpl 3 0 or later"),
    ("gpl-1", 95, 1.0, "spdx", "spdx license identifier gpl 1 0(?: only| or later)?"),
    ("gpl-2", 90, 0.95, "gnu", "gnu general public license as published by the free software foundation either version 2"),
    ("gpl-2", 91, 0.95, "gnu", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-2", 90, 0.95, "gnu", "gnu general public license version 2 as published by the free software foundation"),
    ("gpl-3", 90, 0.95, "gnu", "gnu general public license as published by the free software foundation either version 3"),
    ("gpl-3", 91, 0.95, "gnu", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-3", 88, 0.95, "gnu", "gnu general public license(?: gpl)?(?: version| v)? ?v?3(?: 0)?"),
    ("gpl-2", 88, 0.95, "gnu", "gnu general public license(?: gpl)?(?: version| v)? ?v?2(?: 0)?"),
    ("gpl-1", 88, 0.95, "gnu", "gnu general public license(?: gpl)?(?: version| v)? ?v?1(?: 0)?"),
    ("gpl-3", 82, 0.9, "gpl", "(?:gnu )?gpl(?: version| v)? ?v?3(?: 0)?(?: license)?"),
    ("gpl-2", 82, 0.9, "gpl", "(?:gnu )?gpl(?: version| v)? ?v?2(?: 0)?(?: license)?"),
    ("gpl", 40, 0.5, "gnu", "gnu general public license"),
    ("gpl", 45, 0.55, "gpl", "(?:licensed|released|distributed) under(?: the)?(?: terms of(?: the)?)? (?:gnu )?gpl"),
    ("gpl", 35, 0.4, "gpl", "gpl(?: compatible)? license"),
    ("gpl", 50, 0.55, "merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", 55, 0.6, "gnu", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl-classpath", 85, 0.9, "exception", "gpl(?: 2 0| v2)? with(?: the)? classpath exception"),
    ("gpl-linking", 80, 0.8, "exception", "as a special exception the copyright holders give you permission to link"),
    ("lgpl-2", 95, 1.0, "spdx", "spdx license identifier lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", 95, 1.0, "spdx", "spdx license identifier lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", 95, 1.0, "spdx", "spdx license identifier lgpl 3 0(?: only| or later)?"),
    ("lgpl-2.1", 90, 0.95, "gnu", "gnu lesser general public license as published by the free software foundation either version 2 1"),
    ("lgpl-3", 90, 0.95, "gnu", "gnu lesser general public license as published by the free software foundation either version 3"),
    ("lgpl-2", 90, 0.95, "gnu", "gnu library general public license as published by the free software foundation either version 2"),
    ("lgpl-2.1", 88, 0.9, "gnu", "gnu lesser general public license(?: lgpl)?(?: version| v)? ?v?2 1"),
    ("lgpl-3", 88, 0.9, "gnu", "gnu lesser general public license(?: lgpl)?(?: version| v)? ?v?3(?: 0)?"),
    ("lgpl-2.1", 82, 0.9, "lgpl", "(?:gnu )?lgpl(?: version| v)? ?v?2 1"),
    ("lgpl-3", 82, 0.9, "lgpl", "(?:gnu )?lgpl(?: version| v)? ?v?3(?: 0)?"),
    ("lgpl", 40, 0.5, "gnu", "gnu lesser general public license"),
    ("lgpl", 45, 0.55, "lgpl", "(?:under|license)(?: the)? (?:gnu )?lgpl"),
    ("agpl-3", 95, 1.0, "spdx", "spdx license identifier agpl 3 0(?: only| or later)?"),
    ("agpl-3", 90, 0.95, "gnu", "gnu affero general public license as published by the free software foundation either version 3"),
    ("agpl-3", 88, 0.95, "gnu", "gnu affero general public license(?: version| v)? ?v?3(?: 0)?"),
    ("agpl-3", 82, 0.9, "agpl", "(?:gnu )?agpl(?: version| v)? ?v?3(?: 0)?"),
    ("agpl", 40, 0.5, "gnu", "gnu affero general public license"),
    ("gfdl-1.3", 88, 0.9, "gnu", "gnu free documentation license(?: version)? 1 3"),
    ("gfdl", 60, 0.7, "gnu", "gnu free documentation license"),
    ("gfdl", 70, 0.75, "invariant", "with no invariant sections no front cover texts and no back cover texts"),
    # Mozilla, Eclipse and other weak copyleft
    ("mpl-2", 95, 1.0, "spdx", "spdx license identifier mpl 2 0"),
    ("mpl-1.1", 95, 1.0, "spdx", "spdx license identifier mpl 1 1"),
    ("mpl-2", 90, 0.95, "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", 88, 0.9, "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2", 80, 0.9, "mozilla", "mozilla public license(?: mpl)?(?: version| v)? ?v?2(?: 0)?"),
    ("mpl-1.1", 80, 0.9, "mozilla", "mozilla public license(?: mpl)?(?: version| v)? ?v?1 1"),
    ("mpl", 50, 0.6, "mozilla", "mozilla public license"),
    ("mpl-2", 76, 0.8, "mozilla", "mozilla org mpl 2 0"),
    ("epl-2", 95, 1.0, "spdx", "spdx license identifier epl 2 0"),
    ("epl-1", 95, 1.0, "spdx", "spdx license identifier epl 1 0"),
    ("epl-2", 88, 0.9, "eclipse", "made available under the terms of the eclipse public license(?: v)? 2 0"),
    ("epl-1", 88, 0.9, "eclipse", "made available under the terms of the eclipse public license v1 0"),
    ("epl-2", 80, 0.85, "eclipse", "eclipse public license(?: version| v)? ?v?2(?: 0)?"),
    ("epl-1", 80, 0.85, "eclipse", "eclipse public license(?: version| v)? ?v?1(?: 0)?"),
    ("edl-1", 82, 0.85, "eclipse", "eclipse distribution license(?: version| v)? ?v?1(?: 0)?"),
    ("cddl-1", 95, 1.0, "spdx", "spdx license identifier cddl 1 [01]"),
    ("cddl-1", 82, 0.9, "cddl", "(?:common development and distribution license(?: version 1 0)? )?cddl(?: version| v)? ?v?1(?: 0)?"),
    ("cpl-1", 80, 0.85, "public", "common public license(?: version| v)? ?v?1(?: 0)?"),
    ("eupl-1.2", 95, 1.0, "spdx", "spdx license identifier eupl 1 2"),
    ("eupl-1.2", 82, 0.9, "eupl", "(?:licensed under the )?eupl(?: version| v)? ?v?1 2"),
    ("eupl", 70, 0.8, "public", "european union public licen[cs]e"),
    ("ms-pl", 82, 0.9, "microsoft", "microsoft public license(?: ms pl)?"),
    ("ms-rl", 82, 0.9, "microsoft", "microsoft reciprocal license(?: ms rl)?"),
    ("artistic-2", 82, 0.9, "artistic", "artistic license(?: version)? 2(?: 0)?"),
    ("artistic-1", 80, 0.85, "artistic", "artistic license(?: version)? 1(?: 0)?"),
    ("artistic", 50, 0.6, "artistic", "artistic license"),
    ("perl", 78, 0.85, "perl", "same terms as perl(?: itself)?"),
    # Other permissive ones
    ("zlib", 95, 1.0, "spdx", "spdx license identifier zlib"),
    ("zlib", 85, 0.9, "implied", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", 70, 0.8, "license", "zlib(?: libpng)? license"),
    ("bsl-1", 95, 1.0, "spdx", "spdx license identifier bsl 1 0"),
    ("bsl-1", 88, 0.9, "boost", "distributed under the boost software license version 1 0"),
    ("bsl-1", 75, 0.85, "boost", "boost software license"),
    ("unlicense", 95, 1.0, "spdx", "spdx license identifier unlicense"),
    ("unlicense", 88, 0.9, "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", 70, 0.8, "unlicense", "(?:under )?the unlicense"),
    ("wtfpl", 95, 1.0, "spdx", "spdx license identifier wtfpl"),
    ("wtfpl", 85, 0.9, "everyone", "everyone is permitted to copy and distribute verbatim or modified copies"),
    ("wtfpl", 70, 0.8, "wtfpl", "wtfpl(?: license| version 2)?"),
    ("psf-2", 95, 1.0, "spdx", "spdx license identifier psf 2 0"),
    ("psf-2", 80, 0.85, "python", "python software foundation license(?: version)?(?: 2)?"),
    ("openssl", 80, 0.85, "openssl", "openssl license"),
    ("openssl", 75, 0.8, "openssl", "this product includes software developed by the openssl project"),
    ("php-3", 80, 0.85, "php", "php license(?: version)? 3(?: 0[01])?"),
    ("ofl-1.1", 95, 1.0, "spdx", "spdx license identifier ofl 1 1"),
    ("ofl-1.1", 85, 0.9, "font", "licensed under the sil open font license(?: version)?(?: 1 1)?"),
    ("ofl-1.1", 75, 0.8, "font", "(?:sil )?open font license"),
    ("postgresql", 80, 0.85, "postgresql", "postgresql license"),
    ("ncsa", 80, 0.85, "illinois", "university of illinois(?: ncsa)? open source license"),
    ("curl", 78, 0.8, "curl", "(?:licensed under the )?curl license"),
    ("x11-doc", 60, 0.6, "dealings", "shall not be used in advertising or otherwise to promote the sale use or other dealings"),
    ("afl-3", 80, 0.85, "academic", "academic free license(?: version| v)? ?v?3(?: 0)?"),
    ("osl-3", 80, 0.85, "open", "open software license(?: version| v)? ?v?3(?: 0)?"),
    ("ecl-2", 80, 0.85, "educational", "educational community license(?: version)? 2(?: 0)?"),
    ("upl-1", 80, 0.85, "universal", "universal permissive license(?: upl)?(?: version| v)?(?: 1 0)?"),
    ("blueoak-1", 80, 0.85, "oak", "blue oak model license(?: 1 0 0)?"),
    ("mulan-2", 80, 0.85, "mulan", "mulan (?:psl|permissive software license)(?: v2| version 2)?"),
    # Creative Commons and data
    ("cc0", 95, 1.0, "spdx", "spdx license identifier cc0 1 0"),
    ("cc0", 85, 0.9, "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc0", 82, 0.9, "commons", "creative commons (?:cc )?zero(?: 1 0)?"),
    ("cc-by", 80, 0.85, "commons", "creative commons attribution(?: [1-4] 0)?(?: international| unported)?(?: license)?"),
    ("cc-by-sa", 84, 0.9, "commons", "creative commons attribution share ?alike(?: [1-4] 0)?(?: international| unported)?(?: license)?"),
    ("cc-by-nd", 84, 0.9, "commons", "creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] 0)?(?: license)?"),
    ("cc-by-nc", 84, 0.9, "commons", "creative commons attribution non ?commercial(?: [1-4] 0)?(?: international| unported)?(?: license)?"),
    ("cc-by-nc-sa", 86, 0.95, "commons", "creative commons attribution non ?commercial share ?alike(?: [1-4] 0)?(?: license)?"),
    ("cc-by-nc-nd", 86, 0.95, "commons", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] 0)?(?: license)?"),
    ("cc-by", 76, 0.8, "cc", "cc by(?: [1-4] 0)?"),
    ("cc-by-sa", 78, 0.85, "cc", "cc by sa(?: [1-4] 0)?"),
    ("cc-by-nd", 78, 0.85, "cc", "cc by nd(?: [1-4] 0)?"),
    ("cc-by-nc", 78, 0.85, "cc", "cc by nc(?: [1-4] 0)?"),
    ("cc-by-nc-sa", 79, 0.85, "cc", "cc by nc sa(?: [1-4] 0)?"),
    ("cc-by-nc-nd", 79, 0.85, "cc", "cc by nc nd(?: [1-4] 0)?"),
    ("cc-by", 82, 0.85, "creativecommons", "creativecommons org licenses by [1-4] 0"),
    ("cc-by-sa", 82, 0.85, "creativecommons", "creativecommons org licenses by sa [1-4] 0"),
    ("cc-by-nc", 82, 0.85, "creativecommons", "creativecommons org licenses by nc [1-4] 0"),
    ("cc-by-nc-sa", 83, 0.85, "creativecommons", "creativecommons org licenses by nc sa [1-4] 0"),
    ("cc-by-nc-nd", 83, 0.85, "creativecommons", "creativecommons org licenses by nc nd [1-4] 0"),
    ("cc0", 82, 0.85, "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("cc", 40, 0.4, "commons", "creative commons(?: license)?"),
    ("odbl", 82, 0.85, "open", "open (?:data commons open )?database license(?: odbl)?"),
    ("odc-by", 82, 0.85, "open", "open data commons attribution license"),
    ("pddl", 82, 0.85, "open", "open data commons public domain dedication"),
    ("cdla", 80, 0.85, "community", "community data license agreement"),
    # Public domain, source available and proprietary
    ("public-domain", 70, 0.7, "domain", "(?:dedicated|donated) to the public domain"),
    ("public-domain", 70, 0.7, "domain", "placed in(?:to)? the public domain"),
    ("public-domain", 70, 0.7, "domain", "released into the public domain"),
    ("public-domain", 65, 0.65, "domain", "this (?:file|work|code|text|document) is in the public domain"),
    ("public-domain", 60, 0.6, "domain", "public domain(?: license| dedication| mark)"),
    ("busl-1.1", 85, 0.9, "business", "business source license(?: version)?(?: 1 1)?"),
    ("sspl-1", 85, 0.9, "server", "server side public license(?: version| v)?(?: 1)?"),
    ("elastic-2", 85, 0.9, "elastic", "elastic license(?: version)?(?: 2 0)?"),
    ("commons-clause", 85, 0.9, "clause", "commons clause(?: license)?(?: condition)?"),
    ("polyform", 82, 0.85, "polyform", "polyform (?:noncommercial|shield|strict|perimeter|small business) license"),
    ("llama", 82, 0.85, "community", "(?:meta )?llama [23](?: [0-9])? community license"),
    ("openrail", 82, 0.85, "openrail", "(?:bigscience |creativeml )?openrail(?: m| plus plus m)?(?: license)?"),
    ("proprietary", 75, 0.8, "confidential", "confidential and proprietary"),
    ("proprietary", 75, 0.8, "prohibited", "unauthorized copying of this file(?: via any medium)? is strictly prohibited"),
    ("proprietary", 72, 0.75, "prohibited", "reproduction or (?:distribution|redistribution) without(?: prior)?(?: written)? permission is prohibited"),
    ("proprietary", 70, 0.7, "permission", "may not be (?:reproduced|copied|distributed) without(?: the)?(?: prior)?(?: express)?(?: written)? permission"),
    ("proprietary", 68, 0.7, "consent", "without the(?: prior)?(?: express)? written consent of"),
    ("proprietary", 60, 0.6, "agreement", "end user license agreement"),
    ("proprietary", 58, 0.6, "agreement", "subject to the terms of(?: the| a)?(?: commercial)? license agreement"),
    ("proprietary", 50, 0.5, "reserved", "all rights reserved"),
    ("non-commercial", 55, 0.6, "commercial", "(?:for )?non commercial use only"),
    ("non-commercial", 52, 0.55, "research", "for research (?:purposes|use) only"),
    ("unknown", 30, 0.3, "licensed", "licensed under"),
    ("unknown", 30, 0.3, "license", "see(?: the)? license(?: file| txt| md)?(?: for details| for more information)?"),
    ("unknown", 25, 0.25, "license", "license(?: terms)? and conditions"),
    ("unknown", 25, 0.25, "license", "under the terms of the(?: following)? license"),
]


def rules() -> list[Rule]:
    """The rules in order; of equal priority the earlier one wins."""
    return BASE + [Rule(*s) for s in SIGNATURES]


LEVELS = sorted({r.priority for r in rules()})


def _words(spaced: Column) -> Column:
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("long")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_found), one row per input row.

    A text becomes its lower-case words, each with a space on either side; rules whose keyword it holds are matched, each from left to
    right without overlaps. A detection within another's interval goes if the other has a higher priority, or the same and is longer
    or earlier in the order. labels: of what stays; score: the best of its rules' scores. Base phrases count at every place and
    are never dropped. Null and empty texts have no words, null places, empty labels and score 0. Only detections' positions are
    shuffled, by row: a text with very many of them costs sorting, not comparing each with each.
    """
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), ascii_uppercase, ascii_lowercase)
    plain = F.trim(F.regexp_replace(text, SEPARATORS, "  "))
    spaced = F.when(plain == "", "").otherwise(F.concat(F.lit(" "), plain, F.lit(" ")))
    groups: dict[str, list[tuple[int, Rule]]] = {}
    for i, r in enumerate(rules()):
        groups.setdefault(r.keyword, []).append((i, r))
    text = F.col("spaced")
    entry = lambda i, r: F.struct(F.lit(i).alias("rule"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.score).alias("score"), F.lit(r.regex).alias("regex"), F.lit(r.base).alias("base"))
    none = F.filter(F.array(entry(0, rules()[0])), lambda r: F.lit(False))
    # a keyword's rules are tried only where it stands and their alternation, one literal pattern, matches somewhere
    tried = [F.when(F.contains(text, F.lit(f" {word} ")) & F.rlike(text, F.lit("|".join(f"(?:{r.regex})" for _, r in own))), F.array(*[entry(i, r) for i, r in own])).otherwise(none) for word, own in groups.items()]
    gate = F.rlike(text, F.lit(f" (?:{'|'.join(groups)}) "))
    hits = F.when(gate, F.filter(F.concat(*tried), lambda r: F.rlike(F.col("spaced"), r["regex"])))

    def hit(r: Column) -> Column:
        gaps = F.transform(F.split(F.col("spaced"), r["regex"], -1), _words)
        lengths = F.transform(F.regexp_extract_all(F.col("spaced"), r["regex"], F.lit(0)), _words)
        return F.struct(r["rule"].alias("rule"), r["label"].alias("label"), r["priority"].alias("priority"), r["score"].alias("score"), r["base"].alias("base"), gaps.alias("gaps"), lengths.alias("lengths"))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), spaced.alias("spaced"))
    rows = rows.select("row", "doc_id", _words(text).alias("n_words"), F.transform(hits, hit).alias("hits"))
    each = rows.select("row", "doc_id", "n_words", F.explode_outer("hits").alias("hit"))
    each = each.select("row", "doc_id", "n_words", "hit.rule", "hit.label", "hit.priority", "hit.score", "hit.base", F.posexplode_outer(F.arrays_zip(F.slice("hit.gaps", F.lit(1), F.size("hit.lengths")).alias("gap"), F.col("hit.lengths").alias("length"))).alias("place", "span"))
    each = each.repartition("row")
    end = F.sum(F.col("span.gap") + F.col("span.length")).over(Window.partitionBy("row", "rule").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    each = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("span.length"))
    before = Window.partitionBy("row").orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(*[F.when(F.col("priority") == p, F.max(F.when(F.col("priority") >= p, F.col("end"))).over(before)) for p in LEVELS], F.lit(-1))
    stays = F.col("rule").isNotNull() & (F.col("base") | (reach < F.col("end")))
    each = each.withColumn("stays", stays)
    names = lambda kept: F.array_join(F.array_sort(F.collect_set(F.when(kept, F.col("label")))), ",")
    start = F.when(F.col("base"), F.col("start"))
    out = each.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.count_if(F.coalesce("base", F.lit(False))).alias("n_base"),
        F.min(start).alias("first_word"),
        F.max(start).alias("last_word"),
        names(F.col("base")).alias("base_labels"),
        names(F.col("stays")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("stays"), F.col("score"))), F.lit(0.0)).alias("score"),
        F.count_if(F.col("stays")).alias("n_found"),
    )
    return out.drop("row")


def license_scan_sql() -> str:
    """The same over the table documents, as DuckDB SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    table = ",\n".join(f"({i}, {quoted(r.label)}, {r.priority}, {r.score}::DOUBLE, {quoted(f' {r.keyword} ')}, {quoted(r.regex)}, {str(r.base).lower()})" for i, r in enumerate(rules()))
    words = "(length({0}) - length(replace({0}, ' ', ''))) // 2"
    reach = " ".join(f"WHEN priority = {p} THEN max(CASE WHEN priority >= {p} THEN \"end\" END) OVER before" for p in LEVELS)
    return rf"""
WITH rules(rule, label, priority, score, keyword, regex, base) AS (VALUES {table}),
plain AS (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g')) AS p FROM documents),
spaced AS (SELECT doc_id, CASE WHEN p = '' THEN '' ELSE ' ' || p || ' ' END AS spaced FROM plain),
hits AS (SELECT doc_id, rule, label, priority, score, base, regexp_extract_all(spaced, regex) AS found, string_split_regex(spaced, regex) AS gaps
    FROM spaced JOIN rules ON contains(spaced, keyword) AND regexp_matches(spaced, regex)),
spans AS (SELECT doc_id, rule, label, priority, score, base, unnest(generate_series(1, len(found))) AS place, found, gaps FROM hits),
sized AS (SELECT doc_id, rule, label, priority, score, base, place, {words.format("found[place]")} AS length, {words.format("gaps[place]")} AS gap FROM spans),
placed AS (SELECT *, (sum(gap + length) OVER (PARTITION BY doc_id, rule ORDER BY place))::BIGINT AS "end" FROM sized),
started AS (SELECT *, "end" - length AS start FROM placed),
reached AS (SELECT *, coalesce(CASE {reach} END, -1) AS reach FROM started
    WINDOW before AS (PARTITION BY doc_id ORDER BY start, "end" DESC, priority DESC, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
kept AS (SELECT *, base OR reach < "end" AS stays FROM reached),
found AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label) FILTER (stays)), ',') AS labels,
    max(score) FILTER (stays) AS score, count(*) FILTER (stays) AS n_found FROM kept GROUP BY doc_id)
SELECT s.doc_id, ({words.format("spaced")})::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score, coalesce(n_found, 0)::BIGINT AS n_found
FROM spaced s LEFT JOIN found USING (doc_id)
"""
