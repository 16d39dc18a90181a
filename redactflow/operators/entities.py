"""Runs of text that may be personal data, and the decision on each run as a whole.

A run is as long as its characters go on: a number is never cut after so many digits, a host never after its top level
name, a quoted value never at a blank. All kinds are searched in one pass; where several could start, the first in order
takes the run. A run is then decided as a whole: it is an entity, or nothing of it is. A run longer than its kind allows
(a nine-digit house number, a fifth part of an address) is an entity too, with a lower score, so no part of it stays.
Only numbers in groups of four that are no longer than a card and fail its check digit are let go, whole.

Patterns are written in what Java and RE2 share, and Spark and the SQL of the queries decide by the same patterns.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_VALUE = r"""(?:"[^"\\\r\n]*(?:\\[^\r\n][^"\\\r\n]*)*"?|'[^'\\\r\n]*(?:\\[^\r\n][^'\\\r\n]*)*'?|[^ \t\r\n]+)"""
_QUOTE = r"""(?:\\?["'])?"""

# Patterns of runs, in order of precedence.
PATTERNS: dict[str, str] = {
    "SECRET": rf"{_QUOTE}(?i:api[_-]?key|secret|password|token|authorization){_QUOTE}[ \t]*[:=][ \t]*{_VALUE}",
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+",
    "IPV4": r"[0-9]+(?:[.][0-9]+){3,}",
    "CARD": r"[0-9]{15,}|[0-9]{4,}(?:[ -][0-9]{4,}){3}(?:[ -][0-9]+)*|[0-9]{4,}[ -][0-9]{6,}[ -][0-9]{5,}(?:[ -][0-9]+)*",
    "SSN": r"[0-9]{3,}-[0-9]{2,}-[0-9]{4,}(?:-[0-9]+)*",
    "PHONE": r"(?:[+]?[0-9]+[ ]?|[+])?[(][0-9]{3,}[)][ ]?[0-9]{3,}-[0-9]{4,}(?:-[0-9]+)*",
    "PLATE": r"(?i:plate)[ \t]+#?[A-Z0-9]+[0-9]{2}[A-Z0-9]*(?:-[A-Z0-9]+)*",
    "ACCOUNT": r"(?i:account|acct)[ \t]*[#:][ \t]*[0-9]{2,}-?[0-9]{2,}(?:-[0-9]+)*",
    "ADDRESS": r"[0-9]+ [A-Z][a-z]+ (?:Street|Avenue|Road|Blvd|Ave|St|Rd|Ln|Dr)\b(?:, Apt [0-9A-Z]+)?",
}

# What a run of each kind looks like when it is no longer than it should be.
EXACT: dict[str, str] = {
    "IPV4": r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])[.]){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$",
    "SSN": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "PHONE": r"^(?:[+]?[0-9]{1,2}[ ]?|[+])?[(][0-9]{3}[)][ ]?[0-9]{3}-[0-9]{4}$|^[0-9]{3}-[0-9]{3}-[0-9]{4}$",
    "PLATE": r"^(?i:plate)[ \t]+#?[A-Z0-9]{3,8}$",
    "ACCOUNT": r"^[^0-9]+[0-9]{2,12}-?[0-9]{2,12}$",
    "ADDRESS": r"^[0-9]{1,5} ",
}
#: A number of the form 3-3-4 is a telephone number, though it is found like a social security number.
SEVEN_TEN = r"^[0-9]{3}-[0-9]{3}-[0-9]{4}$"
CARD_DIGITS = (13, 19)
SURE, UNSURE = 1.0, 0.9

#: That a run occurs at all can be told by less than the run: how it starts, and for secrets without quotes before the
#: key and without the rest of the value.
STARTS: dict[str, str] = {"[0-9]": "(?=[0-9(+pPaA])"}
THERE: dict[str, str] = {"SECRET": rf"(?i:api[_-]?key|secret|password|token|authorization){_QUOTE}[ \t]*[:=][ \t]*[^ \t\r\n]"}

# One cheap test per kind: without such a character the pattern cannot match. Kinds of the caller need none.
NEEDS: dict[str, str] = {"SECRET": "[:=]", "EMAIL": "@"} | dict.fromkeys(
    ("IPV4", "SSN", "CARD", "PHONE", "PLATE", "ACCOUNT", "ADDRESS"), "[0-9]"
)


#: Characters that a run of each kind may start with: a search tries a kind only there. Addresses of mail start anywhere.
FIRST: dict[str, str] = {"SECRET": r"""[\\"'aApPsStT]""", "PHONE": "[0-9+(]", "PLATE": "[pP]", "ACCOUNT": "[aA]"} | dict.fromkeys(
    ("IPV4", "CARD", "SSN", "ADDRESS"), "[0-9]"
)


def any_pattern(patterns: Mapping[str, str] = PATTERNS) -> str:
    return "|".join(f"(?:{p})" for p in patterns.values())


def linear(kind: str, pattern: str) -> str:
    """The same matches in Java without recursion and without trying a run again from its middle: repeated groups, after
    which nothing has to match, are not given back, an address starts only where its run does, and other kinds are tried
    only at their first characters."""
    if pattern != PATTERNS.get(kind):
        return pattern
    held = pattern.replace(")*", ")*+").replace("){3,}", "){3,}+").replace("-]+)+", "-]+)++")
    if kind == "EMAIL":
        return rf"(?:(?<![A-Za-z0-9._%+-])|\G){held.replace(']+@', ']++@', 1)}"
    return f"(?={FIRST[kind]})(?:{held})"


def all_linear(patterns: Mapping[str, str]) -> dict[str, str]:
    return {kind: linear(kind, p) for kind, p in patterns.items()}


def digits(run: Column) -> Column:
    return F.regexp_replace(run, "[^0-9]", "")


def check_digit_holds(number: Column) -> Column:
    """Luhn's rule over a string of digits."""
    last = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, last - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), F.lit(0), add) % 10 == 0


def _is_card(run: Column) -> Column:
    """Digits alone, or grouped ones that are too many for a card or pass its check."""
    n = F.length(digits(run))
    short = n <= CARD_DIGITS[1]
    return run.rlike("^[0-9]+$") | ~short | ((n >= CARD_DIGITS[0]) & check_digit_holds(digits(run)))


def kind_of(run: Column, patterns: Mapping[str, str]) -> Column:
    """The kind of a run; null where the run as a whole is let go."""
    out = None
    for kind, pattern in all_linear(patterns).items():
        found = run.rlike(f"^(?:{pattern})")
        name = F.lit(kind)
        if pattern == linear(kind, PATTERNS.get(kind, "")):
            if kind == "CARD":
                name = F.when(_is_card(run), name)
            elif kind == "SSN" and "PHONE" in patterns:
                name = F.when(run.rlike(SEVEN_TEN), "PHONE").otherwise(name)
        out = F.when(found, name) if out is None else out.when(found, name)
    return out


def score_of(run: Column, kind: Column, patterns: Mapping[str, str]) -> Column:
    """1.0 for a run as it should be, less for one that is too long or fails its check."""
    out = F.when(F.lit(False), F.lit(SURE))
    for name, exact in EXACT.items():
        if patterns.get(name) == PATTERNS[name]:
            out = out.when((kind == name) & ~run.rlike(exact), F.lit(UNSURE))
    if patterns.get("CARD") == PATTERNS["CARD"]:
        n = F.length(digits(run))
        good = n.between(*CARD_DIGITS) & check_digit_holds(digits(run))
        out = out.when((kind == "CARD") & ~good, F.lit(UNSURE))
    return out.otherwise(F.lit(SURE))


def torn(patterns: Mapping[str, str]) -> str:
    """A letter or digit that touches a mask: part of something larger than what was masked."""
    token = rf"\[(?:{'|'.join(patterns)})(?::[0-9a-f]{{12}})?\]"
    return rf"[0-9A-Za-z]{token}|{token}[0-9A-Za-z]"
