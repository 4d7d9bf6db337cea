"""Path patterns, turned into one regular expression for rlike when the plan is made.

Paths begin with a slash, and those of directories end with one. mode "documented" treats a leading **
and every punctuation mark as a user would expect. mode "exact" keeps the corner cases of the
established rules: a leading ** never matches, a backslash makes the next character part of the
expression as it is, and a closing parenthesis is not escaped.
"""

from __future__ import annotations

import re

#: Names of POSIX classes in Java's notation (fixed values).
CLASSES = {n.lower(): n for n in "Alpha Digit Alnum Upper Lower Punct Graph Print Blank Cntrl XDigit Space".split()}
MODES = ("documented", "exact")


def _bracket(pattern: str, at: int) -> tuple[str, int] | None:
    """The bracket expression that begins at `at` and where it ends; None if it is not closed."""
    k = at + 1
    negated = pattern[k : k + 1] in ("!", "^") and pattern[k : k + 1] != ""
    k += negated
    members, first = "", True
    while k < len(pattern):
        if pattern[k] == "]" and not first:
            return f"[{'^' if negated else ''}{members}]", k + 1
        named = re.match(r"\[:(\w+):\]", pattern[k:])
        if named and named[1] in CLASSES:
            members += rf"\p{{{CLASSES[named[1]]}}}"
            k += named.end()
        else:
            members += "\\" + pattern[k] if pattern[k] in "\\[]&^" else pattern[k]
            k += 1
        first = False
    return None


def expression(pattern: str, mode: str = "documented") -> str:
    """The regular expression (Java's dialect, without anchors) of one pattern."""
    if mode not in MODES:
        raise ValueError(f"no mode {mode!r}")
    exact = mode == "exact"
    inner = pattern[:-1] if pattern.endswith("/") else pattern
    if "/" not in inner and not (not exact and inner == "**"):
        out, rest = "/(.*/)?", pattern
    elif pattern.startswith("/"):
        out, rest = "", pattern
    else:
        out, rest = "", "/" + pattern
    if exact and inner == "**":
        rest = "/" + rest  # never matches: two slashes in a row
    if exact and "**" in rest[:3] and not pattern.startswith("/") and "/" in inner:
        out, rest = "/", rest  # the pattern's own slash comes before that of the double star
    k = 0
    while k < len(rest):
        c = rest[k]
        if rest.startswith("/**", k) and rest[k + 3 : k + 4] in ("/", ""):
            if rest[k + 3 : k + 4] == "/":
                out += "/(.*/)?"
                k += 4
            else:
                out += "/(.*)?."
                k += 3
        elif c == "*":
            out += "[^/]*"
            k += 1
        elif c == "?":
            out += "[^/]"
            k += 1
        elif c == "[":
            found = _bracket(rest, k)
            out, k = (out + found[0], found[1]) if found else (out + r"\[", k + 1)
        elif c == "\\":
            nxt = rest[k + 1 : k + 2]
            if not nxt:
                out += r"\\"
            elif exact and nxt not in "*[?":
                out += nxt
            else:
                out += re.escape(nxt)
            k += 2
        else:
            special = ".(+{|^$" if exact else ".(+{|^$)}]"
            out += "\\" + c if c in special else c
            k += 1
    return out


def combined(patterns: list[str], mode: str = "documented") -> str:
    """One anchored expression for all patterns; without any it matches nothing. Blank lines are skipped."""
    parts = [expression(p, mode) + "/?" for p in patterns if p]
    return r"(?s)\A(?:" + "|".join(parts) + r")\z" if parts else r"(?!)"
