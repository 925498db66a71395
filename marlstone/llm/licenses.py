"""License scans by ordered signature rules; DataFrame functions only.

A rule is a regular expression over the text's words, with a keyword that every
match contains, a label and a rank. A rule is tried only where its keyword is.
Detections are word intervals; one that lies inside another of better rank (or of
the same rank and longer, or as long and of an earlier rule) is suppressed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases that always count, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# License families as (label, long names, short name, versions).
FAMILIES = (
    ("gpl", ("gnu general public license", "gnu gpl"), "gpl", ("1.0", "2.0", "3.0")),
    ("lgpl", ("gnu lesser general public license", "gnu library general public license", "gnu lgpl"), "lgpl", ("2.0", "2.1", "3.0")),
    ("agpl", ("gnu affero general public license", "gnu agpl"), "agpl", ("1.0", "3.0")),
    ("gfdl", ("gnu free documentation license",), "gfdl", ("1.1", "1.2", "1.3")),
    ("apache", ("apache license", "apache software license"), "apache", ("1.0", "1.1", "2.0")),
    ("mit", ("mit license", "expat license"), "mit", ()),
    ("bsd", ("bsd license", "berkeley software distribution license"), "bsd", ()),
    ("bsd-2-clause", ("bsd 2 clause license", "2 clause bsd", "two clause bsd", "simplified bsd license", "freebsd license"), "bsd 2 clause", ()),
    ("bsd-3-clause", ("bsd 3 clause license", "3 clause bsd", "three clause bsd", "new bsd license", "modified bsd license", "revised bsd license"), "bsd 3 clause", ()),
    ("isc", ("isc license", "internet systems consortium license"), "isc", ()),
    ("mpl", ("mozilla public license",), "mpl", ("1.0", "1.1", "2.0")),
    ("epl", ("eclipse public license",), "epl", ("1.0", "2.0")),
    ("cpl", ("common public license",), "cpl", ("1.0",)),
    ("cddl", ("common development and distribution license",), "cddl", ("1.0", "1.1")),
    ("eupl", ("european union public license", "european union public licence"), "eupl", ("1.0", "1.1", "1.2")),
    ("osl", ("open software license",), "osl", ("1.0", "2.1", "3.0")),
    ("afl", ("academic free license",), "afl", ("2.1", "3.0")),
    ("artistic", ("artistic license", "perl artistic license"), "artistic", ("1.0", "2.0")),
    ("bsl", ("boost software license",), "bsl", ("1.0",)),
    ("busl", ("business source license",), "busl", ("1.1",)),
    ("sspl", ("server side public license",), "sspl", ("1.0",)),
    ("ofl", ("sil open font license", "open font license"), "ofl", ("1.0", "1.1")),
    ("odbl", ("open database license", "open data commons open database license"), "odbl", ("1.0",)),
    ("odc-by", ("open data commons attribution license",), "odc by", ("1.0",)),
    ("pddl", ("public domain dedication and license",), "pddl", ("1.0",)),
    ("cc0", ("creative commons zero", "cc0 public domain dedication"), "cc0", ("1.0",)),
    ("cc-by", ("creative commons attribution", "cc by"), "cc by", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-sa", ("creative commons attribution sharealike", "creative commons attribution share alike", "cc by sa"), "cc by sa", ("2.0", "3.0", "4.0")),
    ("cc-by-nc", ("creative commons attribution noncommercial", "creative commons attribution non commercial", "cc by nc"), "cc by nc", ("2.0", "3.0", "4.0")),
    ("cc-by-nd", ("creative commons attribution noderivatives", "creative commons attribution no derivatives", "cc by nd"), "cc by nd", ("2.0", "3.0", "4.0")),
    ("cc-by-nc-sa", ("creative commons attribution noncommercial sharealike", "cc by nc sa"), "cc by nc sa", ("2.0", "3.0", "4.0")),
    ("cc-by-nc-nd", ("creative commons attribution noncommercial noderivatives", "cc by nc nd"), "cc by nc nd", ("2.0", "3.0", "4.0")),
    ("zlib", ("zlib license", "zlib libpng license"), "zlib", ()),
    ("unlicense", ("the unlicense", "unlicense org"), "unlicense", ()),
    ("wtfpl", ("do what the fuck you want to public license",), "wtfpl", ("2.0",)),
    ("python", ("python software foundation license",), "psf", ("2.0",)),
    ("ms-pl", ("microsoft public license",), "ms pl", ()),
    ("ms-rl", ("microsoft reciprocal license",), "ms rl", ()),
    ("qpl", ("q public license",), "qpl", ("1.0",)),
    ("npl", ("netscape public license",), "npl", ("1.0", "1.1")),
    ("ipl", ("ibm public license",), "ipl", ("1.0",)),
    ("apsl", ("apple public source license",), "apsl", ("1.0", "2.0")),
    ("lppl", ("latex project public license",), "lppl", ("1.2", "1.3")),
    ("ncsa", ("university of illinois ncsa open source license",), "ncsa", ()),
    ("openssl", ("openssl license",), "openssl", ()),
    ("php", ("php license",), "php", ("3.0", "3.01")),
    ("ruby", ("ruby license",), "ruby", ()),
    ("vim", ("vim license",), "vim", ()),
    ("postgresql", ("postgresql license",), "postgresql", ()),
    ("mulan", ("mulan permissive software license",), "mulanpsl", ("1.0", "2.0")),
)

# Sentences of license texts and notices as (label, keyword, words). Every match holds the keyword's words in a row.
SENTENCES = (
    # GNU family
    ("gpl", "free software foundation", r"(?:redistribute it and or modify it under the terms of the gnu general public license )?as published by the free software foundation"),
    ("gpl-or-later", "any later version", r"(?:either )?version [0-9](?: [0-9])? of the license or at your option any later version"),
    ("gpl-or-later", "any later version", r"(?:gpl|lgpl|agpl) (?:version )?v?[0-9](?: [0-9])? or any later version"),
    ("gpl", "take away your freedom", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3.0", "free copyleft license", r"is a free copyleft license for software and other kinds of works"),
    ("gpl-2.0", "does not permit incorporating", r"this general public license does not permit incorporating your program into proprietary programs"),
    ("gpl", "freedom not price", r"when we speak of free software we are referring to freedom not price"),
    ("gpl", "gnu general public license along", r"received a copy of the gnu general public license along with"),
    ("lgpl", "gnu lesser general public license along", r"received a copy of the gnu lesser general public license along with"),
    ("lgpl", "gnu library general public license along", r"received a copy of the gnu library general public license along with"),
    ("agpl", "gnu affero general public license along", r"received a copy of the gnu affero general public license along with"),
    ("agpl-3.0", "network server software", r"ensure cooperation with the community in the case of network server software"),
    ("lgpl-3.0", "incorporates the terms", r"incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("lgpl", "combined work", r"you may convey a combined work under terms of your choice"),
    ("gpl", "absolutely no warranty", r"comes with absolutely no warranty"),
    ("gpl", "verbatim copies of this license", r"permitted to copy and distribute verbatim copies of this license document"),
    ("gpl-linking-exception", "special exception", r"as a special exception (?:the copyright holders? of \S+ )?(?:give|gives|grant|grants) (?:you )?permission to link"),
    ("gpl-classpath-exception", "classpath exception", r"(?:gnu )?classpath exception"),
    ("gfdl", "invariant sections", r"with no invariant sections(?: no)?(?: and no)?(?: with no)?(?: front cover texts)?"),
    ("gpl", "copyleft", r"(?:strong|weak|free) copyleft(?: license)?"),
    # permissive family
    ("mit", "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "deal in the software", r"to deal in the software without restriction including without limitation the rights"),
    ("mit", "copies or substantial portions", r"shall be included in all copies or substantial portions of the software"),
    ("mit", "noninfringement", r"fitness for a particular purpose and noninfringement"),
    ("mit-0", "mit no attribution", r"mit no attribution"),
    ("x11", "x consortium", r"the name of the x consortium shall not be used in advertising"),
    ("isc", "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose"),
    ("isc", "with or without fee", r"for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification"),
    ("bsd", "retain the above copyright notice", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "reproduce the above copyright notice", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse or promote", r"neither the name (?:of )?(?:\S+ ){1,8}nor the names of its contributors may be used to endorse or promote"),
    ("bsd-4-clause", "acknowledgement", r"advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd", "indirect incidental special exemplary", r"be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such"),
    ("zlib", "origin of this software", r"the origin of this software must not be misrepresented"),
    ("zlib", "express or implied warranty", r"provided as is without any express or implied warranty"),
    ("bsl", "boost software license", r"distributed under the boost software license(?: version 1 0)?"),
    ("bsl", "machine executable object code", r"solely in the form of machine executable object code generated by a source language processor"),
    ("hpnd", "documentation for any purpose", r"permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("ntp", "suitability this software", r"makes no representations about the suitability this software for any purpose"),
    ("postgresql", "without a written agreement", r"without fee and without a written agreement is hereby granted"),
    ("curl", "permission to use copy modify and distribute", r"permission to use copy modify and distribute this software for any purpose with or without fee"),
    ("openssl", "openssl project", r"developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "cryptographic software", r"this product includes cryptographic software written by"),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("apache-2.0", "licenses license 2", r"(?:www )?apache org licenses license 2 0"),
    ("apache-2.0", "except in compliance", r"you may not use this (?:file|work|software) except in compliance with the license"),
    ("apache-2.0", "perpetual worldwide", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license"),
    ("apache-2.0", "unless required by applicable law", r"unless required by applicable law or agreed to in writing"),
    ("python", "python software foundation", r"this license agreement is between the python software foundation"),
    ("unicode", "unicode data files", r"permission is hereby granted (?:\S+ ){0,12}unicode data files"),
    ("beerware", "beer ware license", r"(?:the )?beer ware license(?: revision 42)?"),
    ("beerware", "buy me a beer", r"you can buy me a beer in return"),
    ("wtfpl", "want to public license", r"do what the f\S+ you want to public license"),
    ("wtfpl", "you just do what", r"you just do what the f\S+ you want to"),
    ("json", "good not evil", r"the software shall be used for good not evil"),
    ("blue-oak", "blue oak model license", r"blue oak model license(?: 1 0 0)?"),
    ("upl", "universal permissive license", r"universal permissive license(?: v 1 0)?"),
    ("afl", "licensed under the academic free", r"licensed under the academic free license"),
    ("ecl", "educational community license", r"educational community license(?: version 2 0)?"),
    ("artistic", "artistic control", r"maintains some semblance of artistic control over the development of the package"),
    ("artistic", "standard version", r"make and give away verbatim copies of the source form of the standard version of this package"),
    ("perl", "same terms as perl", r"(?:under the )?same terms as perl itself"),
    ("vim", "charityware", r"(?:vim is )?charityware"),
    # public domain and content
    ("public-domain", "public domain", r"(?:released|dedicated|placed|published|donated) (?:in|into|to) the public domain"),
    ("public-domain", "public domain", r"(?:is|are) in the public domain"),
    ("public-domain", "no copyright", r"no copyright (?:is claimed|restrictions apply)"),
    ("unlicense", "unencumbered software", r"free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0", "waived all copyright", r"(?:has|have) waived all copyright and related or neighboring rights"),
    ("cc0", "publicdomain zero", r"creativecommons org publicdomain zero 1 0"),
    ("cc-by", "licenses by", r"creativecommons org licenses by(?: [1-4] [05])?"),
    ("cc-by-sa", "licenses by sa", r"creativecommons org licenses by sa(?: [1-4] [05])?"),
    ("cc-by-nc", "licenses by nc", r"creativecommons org licenses by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "licenses by nd", r"creativecommons org licenses by nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "licenses by nc sa", r"creativecommons org licenses by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "licenses by nc nd", r"creativecommons org licenses by nc nd(?: [1-4] [05])?"),
    ("cc", "some rights reserved", r"some rights reserved"),
    ("cc", "creative commons corporation", r"creative commons corporation is not a law firm"),
    ("cc-by-sa", "share your contributions", r"(?:distribute and )?share your contributions under the same license"),
    ("odbl", "available under the open database", r"made available under the open database license"),
    ("ofl", "reserved font", r"(?:with )?reserved font names?"),
    ("ofl", "may not be sold by itself", r"may not be sold by itself"),
    # weak copyleft and others
    ("mpl-2.0", "subject to the terms", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "subject to the mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl", "incompatible with secondary licenses", r"incompatible with secondary licenses"),
    ("epl", "accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl", "recipient s acceptance", r"constitutes recipient s acceptance of this agreement"),
    ("cddl", "common development and distribution", r"subject to the terms of the common development and distribution license"),
    ("eupl", "licensed under the eupl", r"licensed under the eupl(?: version| v)?(?: 1 [0-2])?"),
    ("ms-pl", "microsoft public license", r"this license governs use of the accompanying software (?:\S+ ){0,20}microsoft public license"),
    ("cecill", "cecill", r"(?:governed by the )?cecill(?: [abc])? license(?: under french law)?"),
    ("sspl", "service source code", r"the service source code under the terms of this license|make the service source code available"),
    ("busl", "change date", r"(?:on|after) the change date"),
    ("busl", "additional use grant", r"additional use grant"),
    ("commons-clause", "commons clause", r"commons clause(?: license condition)?(?: v)?(?: 1 0)?"),
    ("elastic", "elastic license", r"elastic license(?: 2 0| v2)?"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter|free trial|internal use) license"),
    ("bigscience-rail", "openrail", r"(?:bigscience |creativeml )?openrail(?: m)?(?: license)?"),
    ("llama", "llama", r"llama(?: [23])? community license(?: agreement)?"),
    # notices
    ("dual-license", "dual licensed", r"dual licensed under"),
    ("see-license-file", "license file", r"(?:see|read|found in|in) the license file"),
    ("see-license-file", "full license", r"see (?:\S+ ){1,4}for (?:the )?full license(?: text| information| terms)?"),
    ("same-license", "same license", r"(?:under|by) the same license as"),
    ("proprietary", "all rights reserved", r"all rights reserved"),
    ("proprietary", "proprietary", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "without permission", r"(?:may not be|not to be) (?:copied|reproduced|redistributed) without permission"),
    ("proprietary", "prior written", r"without (?:the )?(?:express )?prior written (?:permission|consent)"),
    ("proprietary", "strictly prohibited", r"(?:copying|reproduction|distribution|unauthorized copying)(?: of this file)? (?:\S+ ){0,8}is strictly prohibited"),
    ("proprietary", "trade", r"(?:is a|contains) trade secrets?(?: of)?"),
    ("eula", "end user license agreement", r"end user license agreement"),
    ("noncommercial", "commercial use", r"(?:for )?non commercial use only|not for commercial use|no commercial use"),
    ("noncommercial", "personal use only", r"for personal use only"),
    ("academic", "research purposes only", r"for (?:academic |scientific |non commercial )?research purposes only"),
    ("evaluation", "evaluation purposes only", r"for evaluation purposes only"),
    ("freeware", "freeware", r"(?:this (?:software|program) is |is )freeware"),
    ("patent-grant", "additional grant of patent", r"additional grant of patent rights"),
    ("dco", "certificate of origin", r"developer certificate of origin|developer s certificate of origin"),
    ("cla", "contributor license agreement", r"(?:individual |corporate )?contributor license agreement"),
    ("warranty-disclaimer", "without warranty", r"without warranty of any kind"),
    ("warranty-disclaimer", "warranties", r"as is (?:basis )?without warranties or conditions of any kind"),
    ("warranty-disclaimer", "implied warranties", r"(?:any|all) (?:express|expressed) or implied warranties"),
    ("warranty-disclaimer", "fitness for a particular purpose", r"merchantability (?:or|and) fitness for a particular purpose"),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?"),
    ("copyright", "copyright by", r"copyright by"),
    ("copyright", "copyrighted", r"copyrighted (?:by|material)"),
)

#: Families whose short name and version are also written as one word, as in GPLv2 or LGPLv2.1.
ONE_WORD = ("gpl", "lgpl", "agpl", "gfdl", "mpl", "epl", "eupl", "ofl")
_GRANT = "(?:licensed|released|distributed|available|provided|published|covered|governed) (?:under|by) (?:the )?(?:terms of )?(?:the )?"
#: Rank of a kind of rule, and the score of a text whose best detection is of that kind.
RANKS = {"tag": (0, 1.0), "grant_version": (1, 0.95), "sentence": (2, 0.9), "version": (3, 0.8), "grant": (4, 0.75), "name": (5, 0.6), "short": (6, 0.4)}
BASE_SCORE = 0.5

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    keyword: str
    words: str

    @property
    def pattern(self) -> str:
        """Over text whose words each stand between two spaces of their own."""
        return " (" + self.words.replace(" ", "  ") + ") "


def _version(number: str) -> str:
    """4.0 as its words: 4, 4 0, v4 0, version 4 0; a last zero may be left out."""
    major, minor = number.split(".")
    return rf"(?:version |v )?v?{major}" + (rf"(?: {minor})?" if minor == "0" else rf" {minor}")


def rules() -> list[Rule]:
    """All rules in order: tags, grants, sentences, versions, names and short names of every family."""
    out = [Rule(label, "sentence", keyword, words) for label, keyword, words in SENTENCES]
    for label, names, short, versions in FAMILIES:
        tag = label.replace("-", " ")
        out.append(Rule(label, "tag", "spdx", f"spdx license identifier {tag}"))
        for number in versions:
            full = f"{label}-{number}"
            out.append(Rule(full, "tag", "spdx", f"spdx license identifier {tag} {number.replace('.', ' ')}(?: only| or later)?"))
            for name in names:
                out.append(Rule(full, "grant_version", name, f"{_GRANT}{name}(?: license)? {_version(number)}"))
                out.append(Rule(full, "version", name, f"{name}(?: license)? {_version(number)}"))
            if short not in names:
                out.append(Rule(full, "version", short, f"{short} {_version(number)}"))
            if label in ONE_WORD:
                major, minor = number.split(".")
                rest = rf"(?: {minor})?" if minor == "0" else rf" {minor}"
                out += [Rule(full, "version", joined, f"{joined}{rest}(?: only| or later)?") for joined in (f"{short}v{major}", f"{short}{major}")]
        for name in names:
            out.append(Rule(label, "grant", name, f"{_GRANT}{name}"))
            out.append(Rule(label, "name", name, name))
        out.append(Rule(label, "short", short, f"(?:{short} licensed|{short} style license|under (?:the )?{short})"))
    return out


RULES = rules()


#: Words that stand in very many texts or keywords and so tell little.
_COMMON = {"license", "licence", "licenses", "licensed", "public", "software", "general", "open", "source", "version", "copyright", "permission", "rights", "free", "common", "use", "from", "with", "without", "under"}


def gate_word(rule: Rule) -> str:
    """A word that every match of the rule holds: the longest of its keyword, a telling one if there is any."""
    words = rule.keyword.split()
    return max([w for w in words if w not in _COMMON] or words, key=len)


def gate_words(found: list[Rule]) -> list[str]:
    return sorted({gate_word(rule) for rule in found})


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spaced(text: Column) -> Column:
    """The lower-cased words, each between two spaces; without words, the empty string."""
    joined = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), SEPARATORS, "  "))
    return F.when(joined == "", F.lit("")).otherwise(F.concat(F.lit(" "), joined, F.lit(" ")))


def _spaces(of: str) -> str:
    return f"(length({of}) - length(replace({of}, ' ', '')))"


def _matching_rules(found: list[Rule]) -> str:
    """SQL for the numbers of the rules that match ``c``: of the keywords whose gate word is ``present``, those that ``c`` holds have their rules tried."""
    by_keyword: dict[str, list[int]] = {}
    for i, rule in enumerate(found):
        by_keyword.setdefault(rule.keyword, []).append(i)
    keys = []
    for keyword, numbers in by_keyword.items():
        rules_of = ", ".join(f"named_struct('i', {i}, 'p', {_quoted(found[i].pattern)})" for i in numbers)
        keys.append(f"named_struct('g', {_quoted(gate_word(found[numbers[0]]))}, 'k', {_quoted(' ' + keyword.replace(' ', '  ') + ' ')}, 'rules', array({rules_of}))")
    tried = f"filter(array({', '.join(keys)}), x -> array_contains(present, x.g) AND contains(c, x.k))"
    return f"transform(filter(flatten(transform({tried}, x -> x.rules)), r -> c RLIKE r.p), r -> r.i)"


def annotate(docs: DataFrame, found: list[Rule] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A-Z are lower-cased; words are runs of ASCII letters, digits and all that is
    not ASCII; a null text has none. ``n_base`` counts the places of the base
    phrases, first_word and last_word are their smallest and largest start (null
    if there are none). ``labels`` adds those of the detections that are not
    suppressed; both lists are distinct, sorted and comma-joined, empty if none.
    ``score`` is that of the best detection, at least 0.5 if a base phrase occurs.
    Rows that repeat return each; an empty table gives an empty result.
    """
    found = RULES if found is None else found
    rows = docs.select("doc_id", spaced(F.col("text")).alias("c"))
    places = []
    for phrase in BASE:
        wide = _quoted(" " + phrase.replace(" ", "  ") + " ")
        n = f"CAST((length(c) - length(replace(c, {wide}, ''))) / length({wide}) AS bigint)"
        before, after = f"left(c, instr(c, {wide}) - 1)", f"left(reverse(c), instr(reverse(c), reverse({wide})) - 1)"
        first = f"CAST({_spaces(before)} / 2 AS bigint)"
        last = f"CAST({_spaces('c')} / 2 - {_spaces(after)} / 2 - {phrase.count(' ') + 1} AS bigint)"
        places.append(f"CASE WHEN contains(c, {wide}) THEN named_struct('n', {n}, 'first', {first}, 'last', {last}, 'label', {_quoted(BASE[phrase])}) END")
    gates = f"array({', '.join(_quoted(w) for w in gate_words(found))})"
    rows = rows.withColumn("present", F.expr(f"array_intersect(split(trim(c), '  '), {gates})"))
    rows = rows.select(
        "doc_id", "c",
        F.expr(f"CAST({_spaces('c')} / 2 AS bigint)").alias("n_words"),
        F.expr(f"filter(array({', '.join(places)}), p -> p IS NOT NULL)").alias("base"),
        F.expr(f"CASE WHEN size(present) > 0 THEN {_matching_rules(found)} ELSE CAST(array() AS array<int>) END").alias("ids"),
    )
    pick = lambda values, kind: f"element_at(CAST(array({', '.join(values)}) AS array<{kind}>), i + 1)"
    pattern = pick([_quoted(r.pattern) for r in found], "string")
    label = pick([_quoted(r.label) for r in found], "string")
    rank = pick([str(RANKS[r.kind][0]) for r in found], "int")
    # every match gets a mark at its first and its last word; the marks' word numbers are the intervals
    words = f"split(trim(regexp_replace(c, {pattern}, ' \\u0001$1\\u0002 ')), '  ')"
    starts = f"filter(transform({words}, (w, k) -> CASE WHEN startswith(w, '\\u0001') THEN k END), k -> k IS NOT NULL)"
    ends = f"filter(transform({words}, (w, k) -> CASE WHEN endswith(w, '\\u0002') THEN k + 1 END), k -> k IS NOT NULL)"
    intervals = f"zip_with({starts}, {ends}, (a, b) -> named_struct('a', a, 'before', -b, 'rank', {rank}, 'id', i))"
    rows = rows.select("doc_id", "n_words", "base", F.expr(f"sort_array(flatten(transform(ids, i -> {intervals})))").alias("all"))
    # In this order everything that suppresses a detection stands before it: what begins earlier, ends later, or is of better rank
    # or rule over the same words. So a detection goes if one of its rank or better, seen so far, reaches its end. Kept rules are
    # gathered, not kept places, so the state stays small however many detections a text has.
    reach = f"array({', '.join(['-1'] * len(RANKS))})"
    gone = "array_max(slice(s.reach, 1, x.rank + 1)) >= -x.before"
    reached = "transform(s.reach, (r, k) -> CASE WHEN k = x.rank THEN greatest(r, -x.before) ELSE r END)"
    known = "CASE WHEN array_contains(s.ids, x.id) THEN s.ids ELSE array_append(s.ids, x.id) END"
    step = f"named_struct('reach', {reached}, 'ids', CASE WHEN {gone} THEN s.ids ELSE {known} END)"
    rows = rows.withColumn("ids", F.expr(f"aggregate(all, named_struct('reach', {reach}, 'ids', CAST(array() AS array<int>)), (s, x) -> {step}, s -> s.ids)"))
    rows = rows.withColumn("kept", F.expr(f"transform(ids, i -> named_struct('label', {label}, 'rank', {rank}))"))
    best = "array_min(transform(kept, x -> x.rank))"
    score = " ".join(f"WHEN {rank} THEN {value}D" for rank, value in RANKS.values())
    return rows.select(
        "doc_id", "n_words",
        F.expr("aggregate(base, 0L, (t, p) -> t + p.n)").alias("n_base"),
        F.expr("array_min(transform(base, p -> p.first))").alias("first_word"),
        F.expr("array_max(transform(base, p -> p.last))").alias("last_word"),
        F.expr("array_join(array_sort(array_distinct(transform(base, p -> p.label))), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(array_distinct(concat(transform(base, p -> p.label), transform(kept, x -> x.label)))), ',')").alias("labels"),
        F.expr(f"greatest(CASE {best} {score} ELSE 0D END, CASE WHEN size(base) > 0 THEN {BASE_SCORE}D ELSE 0D END)").alias("score"),
    )
