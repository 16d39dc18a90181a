"""Ordered signature rules for licenses.

Rules match normalised text: words in lower case with one blank between them, so ``CC BY-NC 4.0`` reads
``cc by nc 4 0``. A family gives the label and how its name and its short identifier are written; each form of
statement turns every family into a rule of its own. The words one of which a text must hold are read off the pattern.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from re import _constants as rc
from re import _parser

_V = r"(?: version| ver| v)?"
_L = r"(?: licen[sc]e)?"

#: label, name, short identifier (None: as no short identifier is in use)
FAMILIES = (
    ("mit", r"(?:mit|expat)(?: x11)?", r"mit"),
    ("mit-0", r"mit no attribution", r"mit 0"),
    ("apache-1", rf"apache(?: software)?{_L}{_V} 1(?: [01])?", r"apache 1 [01]"),
    ("apache-2", rf"(?:apache(?: software)?{_L}{_V} 2(?: 0)?|asl 2(?: 0)?|apache2)", r"apache 2(?: 0)?"),
    ("bsd-2-clause", r"(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)", r"bsd 2 clause"),
    ("bsd-3-clause", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)", r"bsd 3 clause"),
    ("bsd-4-clause", r"(?:original bsd|old bsd|bsd 4 clause|4 clause bsd|four clause bsd)", r"bsd 4 clause"),
    ("0bsd", r"(?:0bsd|zero clause bsd|bsd zero clause)", r"0bsd"),
    ("bsd", r"bsd(?: style| like)?", None),
    ("gpl-1", rf"(?:gnu general public{_L}{_V} 1|gnu gpl{_V} 1|gpl{_V} 1|gplv1)", r"gpl 1 0(?: only| or later)?"),
    ("gpl-2", rf"(?:gnu general public{_L}{_V} 2|gnu gpl{_V} 2|gpl{_V} 2|gplv2)", r"gpl 2 0(?: only| or later)?"),
    ("gpl-3", rf"(?:gnu general public{_L}{_V} 3|gnu gpl{_V} 3|gpl{_V} 3|gplv3)", r"gpl 3 0(?: only| or later)?"),
    ("gpl", r"(?:gnu general public|gnu gpl|gpl)", None),
    ("lgpl-2", rf"(?:gnu library general public{_L}{_V} 2|lgpl{_V} 2(?: 0)?(?! 1)|lgplv2)", r"lgpl 2 0(?: only| or later)?"),
    ("lgpl-2.1", rf"(?:gnu lesser general public{_L}{_V} 2 1|lgpl{_V} 2 1)", r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", rf"(?:gnu lesser general public{_L}{_V} 3|lgpl{_V} 3|lgplv3)", r"lgpl 3 0(?: only| or later)?"),
    ("lgpl", r"(?:gnu lesser general public|gnu lgpl|lgpl)", None),
    ("agpl-3", rf"(?:gnu affero general public{_L}{_V} 3|agpl{_V} 3|agplv3)", r"agpl 3 0(?: only| or later)?"),
    ("agpl", r"(?:gnu affero general public|affero general public|agpl)", None),
    ("gfdl", r"(?:gnu free documentation|gfdl)", r"gfdl 1 [123](?: only| or later)?"),
    ("mpl-1.1", rf"(?:mozilla public{_L}{_V} 1 1|mpl{_V} 1 1)", r"mpl 1 1"),
    ("mpl-2", rf"(?:mozilla public{_L}{_V} 2(?: 0)?|mpl{_V} 2(?: 0)?)", r"mpl 2 0"),
    ("epl-1", rf"(?:eclipse public{_L}{_V} 1(?: 0)?|epl{_V} 1(?: 0)?)", r"epl 1 0"),
    ("epl-2", rf"(?:eclipse public{_L}{_V} 2(?: 0)?|epl{_V} 2(?: 0)?)", r"epl 2 0"),
    ("cddl-1", rf"(?:common development and distribution{_L}|cddl)(?:{_V} 1 [01])?", r"cddl 1 [01]"),
    ("eupl", rf"(?:european union public|eupl)(?:{_V} 1 [12])?", r"eupl 1 [12]"),
    ("isc", r"isc", r"isc"),
    ("zlib", r"zlib(?: libpng)?", r"zlib"),
    ("boost-1", rf"boost software(?:{_L}{_V} 1(?: 0)?)?", r"bsl 1 0"),
    ("busl", rf"business source(?:{_L}{_V} 1 1)?", r"busl 1 1"),
    ("sspl", r"(?:server side public|sspl)", r"sspl 1 0"),
    ("elastic-2", rf"elastic(?:{_L}{_V} 2(?: 0)?)?", r"elastic 2 0"),
    ("unlicense", r"unlicense", r"unlicense"),
    ("wtfpl", r"(?:do what the fuck you want to public|wtfpl)", r"wtfpl"),
    ("artistic-1", rf"(?:perl )?artistic{_L}{_V} 1(?: 0)?", r"artistic 1 0"),
    ("artistic-2", rf"(?:perl )?artistic{_L}{_V} 2(?: 0)?", r"artistic 2 0"),
    ("ms-pl", r"(?:microsoft public|ms pl)", r"ms pl"),
    ("ms-rl", r"(?:microsoft reciprocal|ms rl)", r"ms rl"),
    ("osl-3", rf"(?:open software{_L}{_V} 3(?: 0)?|osl{_V} 3(?: 0)?)", r"osl 3 0"),
    ("afl-3", rf"(?:academic free{_L}{_V} 3(?: 0)?|afl{_V} 3(?: 0)?)", r"afl 3 0"),
    ("ecl-2", rf"(?:educational community{_L}{_V} 2(?: 0)?|ecl{_V} 2(?: 0)?)", r"ecl 2 0"),
    ("psf-2", r"(?:python software foundation|psf)", r"(?:psf|python) 2 0"),
    ("php-3", rf"php{_L}{_V} 3(?: 0[01])?", r"php 3 0[01]?"),
    ("ruby", r"ruby", r"ruby"),
    ("vim", r"vim", r"vim"),
    ("openssl", r"openssl", r"openssl"),
    ("postgresql", r"postgresql", r"postgresql"),
    ("ncsa", r"(?:university of illinois ncsa open source|ncsa)", r"ncsa"),
    ("ofl-1.1", rf"(?:sil open font|ofl)(?:{_L}{_V} 1 1)?", r"ofl 1 1"),
    ("odbl", r"(?:open data(?:base)? commons open database|open database|odbl)", r"odbl 1 0"),
    ("odc-by", r"(?:open data commons attribution|odc by)", r"odc by 1 0"),
    ("pddl", r"(?:public domain dedication and|pddl)", r"pddl 1 0"),
    ("cc0", r"(?:creative commons zero|cc0(?: 1 0)?|cc zero)", r"cc0 1 0"),
    ("cc-by", r"(?:creative commons attribution|cc by)(?! (?:nc|sa|nd|non|share|no))(?: \d 0)?", r"cc by \d 0"),
    ("cc-by-sa", r"(?:creative commons attribution share ?alike|cc by sa)(?: \d 0)?", r"cc by sa \d 0"),
    ("cc-by-nd", r"(?:creative commons attribution no ?deriv(?:ative)?s|cc by nd)(?: \d 0)?", r"cc by nd \d 0"),
    ("cc-by-nc", r"(?:creative commons attribution non ?commercial|cc by nc)(?! (?:sa|nd|share|no))(?: \d 0)?", r"cc by nc \d 0"),
    ("cc-by-nc-sa", r"(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: \d 0)?", r"cc by nc sa \d 0"),
    ("cc-by-nc-nd", r"(?:creative commons attribution non ?commercial no ?deriv(?:ative)?s|cc by nc nd)(?: \d 0)?", r"cc by nc nd \d 0"),
    ("openrail", r"(?:creativeml )?open ?rail(?: [mds]+)?", r"openrail"),
    ("llama", r"llama(?: \d)? community", r"llama\d?"),
    ("beerware", r"beer ?ware", r"beerware"),
)

#: name of the form, priority, pattern around a family's name ({n}) or identifier ({i}), and words one of which it needs
_LICENSE = "license licence licensed licenced"
FORMS = (
    ("identifier", 100, r"spdx license identifier {i}", "spdx"),
    ("granted", 90, r"(?:dual )?licen[sc]ed(?: to you)? under(?: the terms of)?(?: the| a)? {n}(?: public)?{l}(?:{v} \d(?: \d)?)?", "licensed licenced"),
    ("offered", 85, r"(?:released|distributed|available|provided|published|covered|redistributed|shared) under(?: the terms (?:and conditions )?of)?(?: the| a)? {n}(?: public)?{l}(?:{v} \d(?: \d)?)?", "under"),
    ("field", 70, r"licen[sc]e(?: name| type| is)? {i}", _LICENSE),
    ("named", 60, r"(?:the )?{n}(?: public)? licen[sc]e(?:{v} \d(?: \d)?)?", _LICENSE),
    ("address", 50, r"(?:opensource org licen[sc]es|spdx org licenses|choosealicense com licenses) {i}", "opensource spdx choosealicense"),
)

#: Phrases that are looked for in any text, with their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Statements without a family: label, priority, pattern, keyword.
STATEMENTS = (
    ("public-domain", 40, r"(?:released|dedicated|placed)(?: in)?(?: to| into)? the public domain", "domain"),
    ("all-rights-reserved", 30, r"all rights reserved", "reserved"),
    ("proprietary", 35, r"(?:proprietary and confidential|confidential and proprietary)", "proprietary"),
    ("permissive-notice", 45, r"permission is hereby granted free of charge to any person obtaining a copy", "permission"),
    ("warranty-disclaimer", 20, r"provided(?: by the copyright holders and contributors)? as is(?: and any express or implied warranties)?", "provided"),
    ("no-redistribution", 40, r"(?:may not|must not|do not) (?:be )?(?:copy|copied|redistributed?|reproduced?) without(?: prior)?(?: written)? (?:permission|consent)", "without"),
    ("redistribution-conditions", 45, r"redistributions? (?:and use )?(?:in|of) source (?:and binary forms|code)", "redistribution redistributions"),
    ("non-commercial", 35, r"(?:for )?non ?commercial(?: use| purposes)(?: only)?", "commercial noncommercial"),
    ("research-only", 35, r"(?:for )?(?:academic|research) (?:use|purposes) only", "academic research"),
    ("copyright", 10, r"copyright(?: c)?(?: \d{4})+", "copyright"),
)


@dataclass(frozen=True)
class Rule:
    """``needs``: sets of words; a text must hold a word of each, or the pattern is not tried."""

    name: str
    label: str
    priority: int
    pattern: re.Pattern
    needs: tuple[frozenset, ...]
    base: bool = False


def _rule(name: str, label: str, priority: int, pattern: str, *needs: str, base: bool = False) -> Rule:
    whole = re.compile(rf"(?<![^ ])(?:{pattern})(?![^ ])".encode())
    return Rule(name, label, priority, whole, tuple(frozenset(n.encode().split()) for n in needs), base)


#: Words in so many texts that another one of the same spelling is the better keyword.
COMMON = frozenset("license licence version general public open source software free commons data server community clause by no".split())


def spellings(pattern: str) -> set[str]:
    """All texts that a pattern matches, look-arounds aside; of what may come any number of times, the least and one more."""

    def chars(items: list) -> list[str]:
        out = []
        for op, arg in items:
            if op is rc.LITERAL:
                out.append(chr(arg))
            elif op is rc.CATEGORY and arg is rc.CATEGORY_DIGIT:
                out += "0123456789"
            elif op is rc.RANGE:
                out += map(chr, range(arg[0], arg[1] + 1))
            else:
                raise ValueError(f"{op} in {pattern}")
        return out

    def each(op: int, arg) -> Iterator[str] | list[str] | set[str]:
        if op is rc.LITERAL:
            return [chr(arg)]
        if op is rc.IN:
            return chars(arg)
        if op is rc.BRANCH:
            return {x for a in arg[1] for x in joined(a)}
        if op is rc.SUBPATTERN:
            return joined(arg[3])
        if op is rc.MAX_REPEAT:
            least, most, inner = arg
            return {"".join(x) for n in range(least, min(most, least + 1) + 1) for x in product(joined(inner), repeat=n)}
        if op in (rc.ASSERT, rc.ASSERT_NOT):
            return [""]
        raise ValueError(f"{op} in {pattern}")

    def joined(items) -> set[str]:
        out = {""}
        for op, arg in items:
            out = {a + b for a, b in product(out, each(op, arg))}
        return out

    return joined(_parser.parse(pattern))


def keywords(pattern: str) -> str:
    """Words of which every spelling of the pattern holds one."""
    chosen: set[str] = set()
    for words in sorted((x.split() for x in spellings(pattern)), key=lambda w: (len(w), w)):
        if not chosen.intersection(words):
            chosen.add(min(words, key=lambda w: (w.isdigit(), w in COMMON, -len(w), w)))
    return " ".join(sorted(chosen))


def rules() -> list[Rule]:
    """All rules, those of higher priority first."""
    out = [_rule(f"phrase:{label}", label, 80, phrase, phrase.split()[-1], *phrase.split()[:-1], base=True) for phrase, label in PHRASES]
    for form, priority, around, form_words in FORMS:
        for label, name, short in FAMILIES:
            if "{i}" in around and short is None:
                continue
            pattern = around.replace("{n}", name).replace("{i}", short or "").replace("{l}", _L).replace("{v}", _V)
            out.append(_rule(f"{form}:{label}", label, priority, pattern, form_words, keywords(name if "{n}" in around else short)))
    out += [_rule(f"statement:{label}", label, priority, pattern, words) for label, priority, pattern, words in STATEMENTS]
    return sorted(out, key=lambda r: -r.priority)
