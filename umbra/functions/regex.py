"""Python regular expressions in Java's dialect, and a static check for patterns that may backtrack without bound."""

from __future__ import annotations

import re
import subprocess
import sys
from re import _constants as sre
from re import _parser

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
BOUNDARY = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
NO_BOUNDARY = rf"(?:(?<=[{WORD}])(?=[{WORD}])|(?<![{WORD}])(?![{WORD}]))"
OUTSIDE = {"d": r"\p{Nd}", "D": r"\P{Nd}", "w": f"[{WORD}]", "W": f"[^{WORD}]", "s": f"[{SPACE}]", "S": f"[^{SPACE}]", "b": BOUNDARY, "B": NO_BOUNDARY, "Z": r"\z", "A": r"\A"}
INSIDE = {"d": r"\p{Nd}", "D": r"\P{Nd}", "w": WORD, "W": f"[^{WORD}]", "s": SPACE, "S": f"[^{SPACE}]", "b": r"\x08"}


class Untranslatable(ValueError):
    """The pattern has a construct without an equal in Java: it needs the Python path."""


class UnsafePattern(ValueError):
    """The pattern may take exponential time."""


def to_java(pattern: str) -> str:
    any_ = "." if re.compile(pattern).flags & re.S else r"[^\n]"
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            e = pattern[i + 1]
            table = INSIDE if in_class else OUTSIDE
            if e in table:
                out.append(table[e])
            elif e == "N" or (e.isdigit() and not in_class and e == "0"):
                raise Untranslatable(pattern)
            else:
                out.append(c + e)
            i += 2
            continue
        if in_class:
            if c == "]":
                in_class = False
            elif c in "[&":
                c = "\\" + c
            out.append(c)
        elif c == "[":
            in_class = True
            out.append(c)
            if pattern[i + 1] == "^":
                out.append("^")
                i += 1
            if pattern[i + 1] == "]":
                out.append("\\]")
                i += 1
        elif c == "$":
            out.append(r"(?=\n?\z)")
        elif c == "(" and pattern.startswith("(?", i):
            m = re.match(r"\(\?(?:P<(\w+)>|P=(\w+)\)|([imsu]+)\)|(:|=|!|<=|<!|>))", pattern[i:])
            if not m:
                raise Untranslatable(pattern)
            if m[1] or m[2]:
                name = (m[1] or m[2]).replace("_", "")
                out.append(f"(?<{name}>" if m[1] else rf"\k<{name}>")
            elif m[3]:
                out.append("(?" + "".join(sorted({*m[3].replace("u", ""), *("u" if "i" in m[3] else "")})) + ")" if m[3] != "u" else "")
            else:
                out.append(m[0])
            i += m.end()
            continue
        elif c == ".":
            out.append(any_)
        else:
            out.append(c)
        i += 1
    return "".join(out)


def groups(pattern: str) -> int:
    return re.compile(pattern).groups


def check_safe(pattern: str) -> None:
    """Refuse an unbounded repeat whose body holds another unbounded repeat or an alternation: either may split a text
    in exponentially many ways."""
    try:
        tree = _parser.parse(pattern)
    except (re.error, RecursionError, OverflowError) as e:
        raise UnsafePattern(f"not a valid regular expression: {e}") from e

    def walk(items, inside: bool) -> None:
        for op, arg in items:
            if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                lo, hi, body = arg
                endless = hi is sre.MAXREPEAT
                if inside and endless:
                    raise UnsafePattern("an unbounded repeat inside an unbounded repeat")
                walk(body, inside or endless)
            elif op is sre.BRANCH:
                if inside:
                    raise UnsafePattern("an alternation inside an unbounded repeat")
                for b in arg[1]:
                    walk(b, inside)
            elif op is sre.SUBPATTERN:
                walk(arg[3], inside)
            elif op in (sre.ASSERT, sre.ASSERT_NOT):
                walk(arg[1], False)
            elif op is sre.IN and inside:
                pass

    walk(_branches_kept(pattern, tree), False)
    if re.compile(pattern).match("") and re.compile(pattern).fullmatch(""):
        raise UnsafePattern("the pattern matches the empty text")


def probe(pattern: str, budget: float = 0.5) -> None:
    """Refuse a pattern that takes over `budget` seconds on one of six short texts which nearly match; each runs in a process of
    its own, which is ended then. For patterns that check_safe lets pass; on the driver, before a job."""
    for length in (20, 40, 80):
        for text in (_nearly(pattern, length) + "!", "a" * length + "!"):
            code = "import re, sys; print('ready', flush=True); sys.stdin.readline(); re.search(sys.argv[1], sys.argv[2])"
            with subprocess.Popen([sys.executable, "-c", code, pattern, text], stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True) as run:
                run.stdout.readline()  # the start of the process is not counted
                try:
                    run.communicate("\n", timeout=budget)
                except subprocess.TimeoutExpired:
                    run.kill()
                    raise UnsafePattern(f"over {budget} s on a text of {len(text)} characters") from None


def _nearly(pattern: str, length: int) -> str:
    """A text of characters that the pattern's first repeat takes."""
    def first(items):
        for op, arg in items:
            if op is sre.LITERAL:
                return chr(arg)
            if op is sre.IN:
                for kind, x in arg:
                    if kind in (sre.LITERAL, sre.RANGE):
                        return chr(x if kind is sre.LITERAL else x[0])
                    if kind is sre.CATEGORY:
                        return {sre.CATEGORY_DIGIT: "1", sre.CATEGORY_SPACE: " "}.get(x, "a")
            inner = arg[2] if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) else arg[3] if op is sre.SUBPATTERN else arg[1][0] if op is sre.BRANCH else ()
            if found := first(inner):
                return found
        return ""

    return (first(_parser.parse(pattern)) or "a") * length


def safe_match(pattern: str, value: str, most: int = 10_000) -> bool:
    """Whether the pattern is found in the value; values of over `most` characters are never searched."""
    return len(value) <= most and re.search(pattern, value) is not None


def _branches_kept(pattern: str, tree):
    """The parser joins single-character alternatives into a set; a set from `(a|a)` would look harmless."""
    for m in re.finditer(r"\((?:\?:)?([^()\[\]\\]*\|[^()\[\]\\]*)\)(?:[*+]|\{\d*,\})", pattern):
        raise UnsafePattern(f"an alternation inside an unbounded repeat: ({m[1]})")
    return tree
