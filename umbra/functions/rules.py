"""Recognizer rules: built-in ones, registration of more, and what a detection run uses."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import Untranslatable, check_safe, to_java

NAME = re.compile(r"[A-Z][A-Z0-9_]*")
STRATEGIES = ("replace", "redact", "mask", "hash", "surrogate")
STRICT, CONTAINED, MERGE = "strict", "contained", "merge"


@dataclass(frozen=True)
class Rule:
    """validator: a name in VALIDATORS, which then decides and `score` is the validated one. needs: a Java pattern that
    every text with a match contains, cheap to search."""

    entity: str
    pattern: str
    score: float
    validator: str | None = None
    needs: str | None = None

    def __post_init__(self):
        if not NAME.fullmatch(self.entity):
            raise ValueError(f"entity name must be UPPER_SNAKE: {self.entity!r}")
        if not 0 <= self.score <= 1:
            raise ValueError("score must lie between 0 and 1")


# ---- fixed values: patterns, scores and keywords that results depend on -------------------------------------------------
BUILT_IN = (
    Rule("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0.95, needs="@"),
    Rule("PHONE", r"(?<!\d)(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}(?!\d)", 0.85, needs=r"\p{Nd}{3}[\s\S]\p{Nd}{4}"),
    Rule("SSN", r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)", 0.95, "ssn_area", needs=r"-\p{Nd}{2}-"),
    Rule("SSN", r"(?<!\d)\d{9}(?!\d)", 0.35, "ssn_area", needs=r"\p{Nd}{9}"),
    Rule("CREDIT_CARD", r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)", 0.97, "luhn", needs=r"\p{Nd}(?:[ -]?\p{Nd}){12}"),
    Rule("IP_ADDRESS", r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b", 0.75, needs=r"\p{Nd}\.\p{Nd}+\.\p{Nd}"),
    Rule("IP_ADDRESS", r"\b(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}\b", 0.85, needs=":[A-Fa-f0-9]{1,4}:"),
    Rule("AWS_KEY", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", 0.97, needs="A[KS]IA"),
    Rule("API_KEY", r"\b(?:sk-ant-[A-Za-z0-9_-]{20,}|sk-[A-Za-z0-9_-]{20,}|gh[pousr]_[A-Za-z0-9]{20,}|xox[baprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})\b", 0.95, needs="sk-|gh[pousr]_|xox[baprs]-|AIza"),
    Rule("API_KEY", r"(?i)\b\w{0,40}(?:key|secret|token|password|credential)\w{0,40}\s*[:=]\s*['\"]?([A-Za-z0-9_\-/+]{16,})['\"]?", 0.6, needs=r"(?iu)(?:key|secret|token|password|credential)[\p{L}\p{N}_]{0,40}[\s\x1c-\x1f\x85\p{Z}]*[:=]"),
    Rule("JWT", r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", 0.9, needs="eyJ"),
    Rule("IBAN", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", 0.9, "iban", needs=r"[A-Z]{2}\p{Nd}{2}[A-Z0-9]{11}"),
    Rule("ADDRESS", r"\b\d{1,6}\s+(?:[A-Z][a-zA-Z]*\s){1,4}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Way|Place|Pl|Terrace|Ter)\.?\b(?:,?\s+(?:Apt|Suite|Ste|Unit)\.?\s*#?\w+)?", 0.7, needs=r"\p{Nd}[\s\x1c-\x1f\x85\p{Z}]+[A-Z]"),
)
KEYWORDS = {
    "PHONE": ("phone", "call", "tel", "mobile", "cell", "contact"),
    "SSN": ("ssn", "social security"),
    "CREDIT_CARD": ("card number", "credit card", "visa", "mastercard", "cc#"),
    "API_KEY": ("api key", "apikey", "secret", "token", "credential"),
    "ADDRESS": ("address", "lives at", "located at", "ship to", "mailing"),
    "PERSON_NAME": ("name is", "name:", "my name", "signed", "regards"),
    "DATE_OF_BIRTH": ("dob", "date of birth", "born on", "birthdate"),
}
#: model label -> (entity, score, threshold)
NER_LABELS = {"PERSON": ("PERSON_NAME", 0.75, 0.0), "DATE": ("DATE_OF_BIRTH", 0.3, 0.6)}
WINDOW, BOOST, MOST = 40, 0.4, 0.99
# ---- end of fixed values --------------------------------------------------------------------------------------------------


def boosted(score: float) -> float:
    return round(min(MOST, score + BOOST), 2)


def _mod97(digits_and_letters: Column) -> Column:
    return F.aggregate(
        F.split(digits_and_letters, ""),
        F.lit(0),
        lambda acc, c: F.when(c == "", acc).when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97),
    )


def rearranged_mod97(v: Column) -> Column:
    """ISO 7064 remainder of an account number, its first four characters moved to the end."""
    return _mod97(F.concat(F.substr(v, F.lit(5)), F.substr(v, F.lit(1), F.lit(4))))


#: Column -> boolean Column, and the same on a Python string.
VALIDATORS: dict[str, tuple[Callable[[Column], Column], Callable[[str], bool]]] = {}


def register_validator(name: str, native: Callable[[Column], Column], plain: Callable[[str], bool]) -> None:
    VALIDATORS[name] = (native, plain)


def _luhn(v: str) -> bool:
    d = re.sub("[ -]", "", v)
    if not (13 <= len(d) <= 19 and d.isascii() and d.isdigit()):
        return False
    pairs = [int(c) for c in reversed(d)]
    return (sum(pairs[0::2]) + sum(sum(divmod(2 * x, 10)) for x in pairs[1::2])) % 10 == 0


def _iban(v: str) -> bool:
    s = v.upper()
    return s.isascii() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


register_validator("ssn_area", lambda v: ~F.substr(v, F.lit(1), F.lit(3)).isin("000", "666") & ~F.startswith(v, F.lit("9")), lambda v: v[:3] not in ("000", "666") and v[0] != "9")
register_validator("luhn", lambda v: F.coalesce(F.regexp_replace(v, "[ -]", "").rlike("^[0-9]{13,19}$") & F.call_function("luhn_check", F.regexp_replace(v, "[ -]", "")), F.lit(False)), _luhn)
register_validator("iban", lambda v: rearranged_mod97(v) == 1, _iban)


@dataclass(frozen=True)
class Detection:
    """What one run looks for. Rules' order is the last tie-break. custom rules come after the registered ones.

    label spans come from a named-entity model if `ner` is given: text -> [(label, start, end)].
    """

    rules: tuple[Rule, ...] = BUILT_IN
    keywords: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(KEYWORDS))
    threshold: float = 0.5
    thresholds: dict[str, float] = field(default_factory=dict)
    disabled: frozenset[str] = frozenset()
    custom: tuple[Rule, ...] = ()
    exclude_values: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    overlap: str = STRICT
    overlaps: dict[str, str] = field(default_factory=dict)
    ner: Callable[[str], list[tuple[str, int, int]]] | None = None
    ner_labels: dict[str, tuple[str, float, float]] = field(default_factory=lambda: dict(NER_LABELS))

    def needed(self, entity: str) -> float:
        return self.thresholds.get(entity, self.threshold)

    def policy(self, entity: str) -> str:
        return self.overlaps.get(entity, self.overlap)

    def active(self) -> list[tuple[int, Rule]]:
        """Rules that can yield a span, with their place: disabled types and hopeless scores are left out at plan time."""
        return self._active

    @cached_property
    def _active(self) -> list[tuple[int, Rule]]:
        out = []
        for i, r in enumerate((*self.rules, *self.custom)):
            best = boosted(r.score) if self.keywords.get(r.entity) else round(r.score, 2)
            if r.entity not in self.disabled and max(best, round(r.score, 2)) >= self.needed(r.entity):
                out.append((i, r))
        return out

    def with_pattern(self, entity: str, pattern: str, score: float, validator: str | None = None, keywords: tuple[str, ...] | None = None) -> Detection:
        check_safe(pattern)
        more = {**self.keywords, entity: tuple(k.lower() for k in keywords)} if keywords else self.keywords
        return replace(self, rules=(*self.rules, Rule(entity, pattern, score, validator)), keywords=more)


def native(rule: Rule) -> str | None:
    """The Java pattern, or None if only Python's engine can run it."""
    try:
        return to_java(rule.pattern)
    except Untranslatable:
        return None
