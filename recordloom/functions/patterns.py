"""Search patterns: when a value is one, and how Java has to spell it.

Callers write POSIX-style advanced regular expressions. Java differs in what
``.`` and ``$`` mean, in bracket classes and in some escapes; the pattern is
respelled once on the driver before it goes into the plan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession, functions as F

from recordloom.errors import BadPattern

# The characters that mark a value as a pattern.
PATTERN_MARKS = "^$(|[*+{?/"

# POSIX class names and their Java spellings.
POSIX_CLASSES = {
    "alnum": r"\p{IsAlphabetic}\p{IsDigit}",
    "alpha": r"\p{IsAlphabetic}",
    "blank": r" \t",
    "cntrl": r"\p{Cntrl}",
    "digit": r"\p{IsDigit}",
    "graph": r"\p{IsGraph}",
    "lower": r"\p{IsLowercase}",
    "print": r"\p{IsPrint}",
    "punct": r"\p{IsPunctuation}",
    "space": r"\p{IsWhite_Space}",
    "upper": r"\p{IsUppercase}",
    "xdigit": r"\p{XDigit}",
}

# Escapes that Java spells in another way.
ESCAPES = {
    "m": r"\b(?=\w)",
    "M": r"\b(?<=\w)",
    "y": r"\b",
    "Y": r"\B",
    "Z": r"\z",
    "B": r"\\",
    "b": r"\x08",
    "v": r"\x0B",
    "0": r"\x00",
}
SAME_ESCAPES = set("AdDsSwWaefnrt123456789")
GROUP_HEADS = ("(?:", "(?=", "(?!", "(?<=", "(?<!")


def looks_like_pattern(value: str) -> bool:
    return any(mark in value for mark in PATTERN_MARKS)


def looks_like_pattern_column(c: Column) -> Column:
    return c.rlike(r"[\^$(|\[*+{?/]")


def _bracket(p: str, i: int) -> tuple[str, int]:
    """Respell the bracket expression starting at ``p[i] == '['``."""
    for edge, java in (("[[:<:]]", r"\b(?=\w)"), ("[[:>:]]", r"\b(?<=\w)")):
        if p.startswith(edge, i):
            return java, i + len(edge)
    out, i = "[", i + 1
    if i < len(p) and p[i] == "^":
        out, i = out + "^", i + 1
    first = True
    while True:
        if i >= len(p):
            raise BadPattern(f"bracket is not closed: {p}")
        ch = p[i]
        if ch == "]" and not first:
            return out + "]", i + 1
        first = False
        if p.startswith("[:", i):
            end = p.find(":]", i)
            name = p[i + 2 : end] if end > 0 else ""
            if name not in POSIX_CLASSES:
                raise BadPattern(f"unknown character class: {p}")
            out, i = out + POSIX_CLASSES[name], end + 2
        elif p.startswith(("[.", "[="), i):
            raise BadPattern(f"collating elements are not supported: {p}")
        elif ch == "\\":
            if i + 1 >= len(p):
                raise BadPattern(f"trailing backslash: {p}")
            spelled, i = _escape(p, i, inside=True)
            out += spelled
        else:
            out, i = out + ("\\" + ch if ch in "[]&~^" else ch), i + 1


def _escape(p: str, i: int, inside: bool) -> tuple[str, int]:
    """Respell the escape at ``p[i] == '\\\\'``."""
    if i + 1 >= len(p):
        raise BadPattern(f"trailing backslash: {p}")
    ch = p[i + 1]
    code = re.compile(r"\\(?:x([0-9a-fA-F]+)|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8}))").match(p, i)
    if code:
        value = int(next(g for g in code.groups() if g), 16)
        if value > 0x10FFFF:
            raise BadPattern(f"no such character: {p}")
        return r"\x{%X}" % value, code.end()
    if ch == "c" and i + 2 < len(p):
        return r"\x%02X" % (ord(p[i + 2]) & 31), i + 3
    if inside and ch in "mMyYAZ":
        raise BadPattern(f"escape is not valid inside brackets: {p}")
    if ch in ESCAPES:
        return ESCAPES[ch], i + 2
    if ch in SAME_ESCAPES:
        return "\\" + ch, i + 2
    if ch.isalnum():
        raise BadPattern(f"unknown escape \\{ch}: {p}")
    return "\\" + ch, i + 2


def to_java(p: str) -> str:
    """Java spelling of a pattern; raises BadPattern where there is none."""
    if p.startswith("***="):
        return r"\Q" + p[4:].replace(r"\E", r"\E\\E\Q") + r"\E"
    if p.startswith("***:"):
        p = p[4:]
    flags = "sU"
    options = re.match(r"\(\?([a-z]+)\)", p)
    if options:
        if set(options.group(1)) - set("ics"):
            raise BadPattern(f"unsupported option: {p}")
        last = [o for o in options.group(1) if o in "ic"]
        flags += "iu" if last and last[-1] == "i" else ""
        p = p[options.end() :]
    out, i, operand = f"(?{flags})", 0, False
    while i < len(p):
        ch = p[i]
        bound = re.compile(r"\{(\d+)(,(\d*))?\}").match(p, i) if ch == "{" else None
        if ch == "\\":
            spelled, i = _escape(p, i, inside=False)
            out, operand = out + spelled, True
        elif ch == "[":
            spelled, i = _bracket(p, i)
            out, operand = out + spelled, True
        elif ch == "$":
            out, i, operand = out + r"\z", i + 1, False
        elif ch in "*+?" or bound:
            if not operand:
                raise BadPattern(f"nothing to repeat: {p}")
            if bound and any(g and int(g) > 255 for g in (bound.group(1), bound.group(3))):
                raise BadPattern(f"repeat count is over 255: {p}")
            text = bound.group(0) if bound else ch
            i += len(text)
            if i < len(p) and p[i] == "?":
                text, i = text + "?", i + 1
            out, operand = out + text, False
        elif ch == "(":
            head = next((h for h in GROUP_HEADS if p.startswith(h, i)), "(")
            if head == "(" and p.startswith("(?", i):
                raise BadPattern(f"unsupported group: {p}")
            out, i, operand = out + head, i + len(head), False
        elif ch in "|^":
            out, i, operand = out + ch, i + 1, False
        else:
            out, i, operand = out + ("\\" + ch if ch in "{}" else ch), i + 1, True
    return out


def checked_java(spark: SparkSession, p: str) -> str:
    """``to_java`` plus a compile on the driver, so that no task can fail on it."""
    java = to_java(p)
    try:
        spark._jvm.java.util.regex.Pattern.compile(java)
    except Exception as e:  # py4j wraps PatternSyntaxException
        raise BadPattern(f"not a valid pattern: {p}") from e
    return java


_PLAIN = re.compile(r"[^\\^$.\[\](){}|*+?]*")


def literal_parts(p: str) -> tuple[str, str]:
    """``(kind, text)``: kind is ``equals``, ``prefix``, ``contains``, ``head``
    (a pattern whose matches all start with text) or ``none``."""
    if p.startswith("***"):
        return "none", ""
    anchored = p.startswith("^")
    body = p[1:] if anchored else p
    run = _PLAIN.match(body).group(0)
    if run == body:
        return ("prefix" if anchored else "contains"), run
    if anchored and body == run + "$":
        return "equals", run
    if anchored and "|" not in p:
        if body[len(run)] in "*?{+":
            run = run[:-1]
        if run:
            return "head", run
    return "none", ""


def match(spark: SparkSession, c: Column, p: str) -> Column:
    """Unanchored, case-sensitive search for ``p``. Plain prefixes, whole
    values and substrings use comparisons the Parquet reader can evaluate."""
    kind, text = literal_parts(p)
    if kind == "equals":
        return c == F.lit(text)
    if kind == "prefix":
        return c.startswith(text) if text else c.isNotNull()
    if kind == "contains":
        return c.contains(text)
    found = c.rlike(checked_java(spark, p))
    return c.startswith(text) & found if kind == "head" else found
