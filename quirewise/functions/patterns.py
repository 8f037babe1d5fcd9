"""Search patterns: plan-time checks and match expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

from quirewise.functions.expr import let, prefix_sums
from quirewise.functions.geometry import blank_ranges

# The named detectors.
NAMED_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone_us": r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "credit_card": r"\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}",
}

# What every match of a named detector holds. It costs less than the detector and runs once for all that share it.
HINTS = {"email": "@", "phone_us": r"(?U)\d{3}", "ssn": r"(?U)\d{3}", "credit_card": r"(?U)\d{3}"}

_OPEN, _CLOSE = "\u0001", "\u0002"
_MARKS = "[\\x01\\x02]"
# What the named sets in brackets stand for, ASCII only.
_SETS = {
    "alnum": "0-9A-Za-z",
    "alpha": "A-Za-z",
    "ascii": r"\x00-\x7F",
    "blank": r"\t ",
    "cntrl": r"\x00-\x1F\x7F",
    "digit": "0-9",
    "graph": "!-~",
    "lower": "a-z",
    "print": " -~",
    "punct": r"!-/:-@\[-`{-~",
    "space": r"\t\n\x0B\f\r ",
    "upper": "A-Z",
    "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}
_TOKEN = re.compile(
    r"\\(?:[pPx]\{[^}]*\}|.)|\[:(\^?)(\w+):\]|\(\?(P?<[A-Za-z_]\w*>|<[=!]|P[=>]|[^)\w<-]|[\w-]+)?|\{\d+(?:,\d*)?\}|.",
    re.S,
)


def _for_java(source: str) -> str:
    """The same pattern for Spark's engine; what only that engine would take, or reads otherwise, is refused."""
    out: list[str] = []
    brackets, repeated = 0, False
    by_line = re.search(r"\(\?[a-z]*m", source) is not None
    for token in _TOKEN.finditer(source):
        part = token.group()
        named = token.group(2)
        if part[0] == "\\" and (part[1:2].isdigit() and part[1] != "0" or part[1:2] == "k"):
            raise ValueError("back-references are not supported")
        if named is not None and brackets:
            if named not in _SETS:
                raise ValueError(f"unknown set [:{named}:]")
            part = f"[^{_SETS[named]}]" if token.group(1) else _SETS[named]
        elif named is not None:
            brackets += 1
        elif brackets:
            brackets += {"[": 1, "]": -1}.get(part, 0) if not (part == "]" and out[-1] in ("[", "[^")) else 0
            if part == "]" and out[-1] in ("[", "[^"):
                part = r"\]"
            elif part == "^" and out[-1] == "[":
                out.pop()
                part = "[^"
        elif part == "[":
            brackets += 1
        elif part == "$" and not by_line:
            part = r"\z"
        elif part.startswith("(?"):
            kind = token.group(3) or ""
            if kind in ("<=", "<!", "=", "!"):
                raise ValueError("look-around is not supported")
            if kind[:1] in (">", "P") and not kind.startswith("P<"):
                raise ValueError(f"the group (?{kind} is not supported")
            if re.search("[UR]", kind) and not kind.startswith(("<", "P<")):
                raise ValueError(f"the flags in (?{kind} are not supported")
            if kind.startswith(("<", "P<")):
                part = "("
        repeats = not brackets and (part in ("*", "+", "?") or part[0] == "{" and len(part) > 1)
        if repeated and part == "+" and not brackets:
            raise ValueError("possessive repetition is not supported")
        repeated = repeats
        out.append(part)
    return "".join(out)


@dataclass(frozen=True)
class Pattern:
    """``java`` is what Spark's engine runs: digits, blanks, words and letter case mean their Unicode sets, and only a
    line feed ends a line."""

    name: str
    source: str
    java: str
    may_be_empty: bool

    def found_in(self, text: Column) -> Column:
        return text.rlike(self.java)


def by_hint(compiled: Sequence[Pattern]) -> dict[str | None, list[Pattern]]:
    """Patterns grouped by the cheap test they share."""
    groups: dict[str | None, list[Pattern]] = {}
    for pattern in compiled:
        groups.setdefault(HINTS.get(pattern.name), []).append(pattern)
    return groups


def passes(text: Column, hint: str) -> Column:
    return F.contains(text, F.lit(hint)) if hint == re.escape(hint) else text.rlike(hint)


def _checked(given: str, java: str) -> Pattern:
    """Let Spark's own engine judge a pattern, while the plan is built."""
    context = SparkContext._active_spark_context
    if context is None:
        raise ValueError("patterns need a running session")
    try:
        compiled = context._jvm.java.util.regex.Pattern.compile(java)
    except IllegalArgumentException as err:
        raise ValueError(str(err).split("\n")[0]) from err
    bare = re.sub(r"\\[^bBz]", "", java)
    may_be_empty = compiled.matcher("").find() or any(mark in bare for mark in ("\\b", "\\B", "\\z", "^", "$"))
    return Pattern(given, given.partition(":")[2], java, may_be_empty)


def compile_patterns(patterns: Sequence[str]) -> list[Pattern]:
    """Names of detectors, ``text:<literal>`` or ``regex:<pattern>``; anything else is an error.

    A pattern may have flags anywhere, Unicode classes, sets like ``[[:alpha:]]`` and named groups; look-around,
    back-references, possessive repetition and atomic groups are refused.
    """
    out = []
    for given in patterns:
        if given in NAMED_PATTERNS:
            source = NAMED_PATTERNS[given]
            out.append(Pattern(given, source, f"(?U){source}" if r"\d" in source else source, False))
        elif given.startswith("regex:"):
            try:
                out.append(_checked(given, f"(?Ud){_for_java(given.removeprefix('regex:'))}"))
            except ValueError as err:
                raise ValueError(f"invalid pattern '{given}': {err}") from err
        elif given.startswith("text:"):
            literal = given.removeprefix("text:")
            out.append(Pattern(given, re.escape(literal), re.escape(literal), not literal))
        else:
            known = ", ".join(NAMED_PATTERNS)
            raise ValueError(f"pattern '{given}' is neither one of {known} nor starts with text: or regex:")
    return out


def _cut_at_marks(text: Column, pattern: Pattern) -> Column:
    return F.split(F.regexp_replace(text, f"({pattern.java})", f"{_OPEN}$1{_CLOSE}"), _MARKS)


def pieces(text: Column, pattern: Pattern) -> Column:
    """Cut text into gap, match, gap, match, ..., gap; joined together they are the text again.

    Text that already holds the marks is cut by the pattern itself, or, if the pattern may match nothing, with
    stand-ins of the same length for the marks.
    """
    if pattern.may_be_empty:
        other = _cut_at_marks(F.translate(text, _OPEN + _CLOSE, "\ue001\ue002"), pattern)
    else:
        gaps = F.split(text, pattern.java)
        matches = F.regexp_extract_all(text, F.lit(pattern.java), F.lit(0))
        other = F.flatten(
            F.zip_with(gaps, matches, lambda g, m: F.when(m.isNull(), F.array(g)).otherwise(F.array(g, m)))
        )
    return F.when(text.rlike(_MARKS), other).otherwise(_cut_at_marks(text, pattern))


def _ranges_of(parts: Column) -> Column:
    """Character ranges of the matches among pieces, from 0, half-open; empty matches are left out."""
    starts = prefix_sums(F.transform(parts, lambda p: F.length(p)))
    ranges = F.zip_with(
        parts, starts, lambda p, s: F.struct(s.cast("int").alias("lo"), (s + F.length(p)).cast("int").alias("hi"))
    )
    return F.filter(ranges, lambda r, i: (i % 2 == 1) & (r["hi"] > r["lo"]))


def match_ranges(text: Column, pattern: Pattern) -> Column:
    """All matches of one pattern as array<struct<lo, hi>>."""
    empty = F.array().cast("array<struct<lo:int,hi:int>>")
    return F.when(pattern.found_in(text), let(pieces(text, pattern), _ranges_of)).otherwise(empty)


def blank_matches(text: Column, pattern: Pattern) -> Column:
    """The text with every match of one pattern replaced by as many spaces."""
    parts = F.transform(
        pieces(text, pattern), lambda p, i: F.when(i % 2 == 1, F.repeat(F.lit(" "), F.length(p))).otherwise(p)
    )
    blanked = F.array_join(parts, "")
    if pattern.may_be_empty:
        by_range = blank_ranges(text, match_ranges(text, pattern))
        blanked = F.when(text.rlike(_MARKS), by_range).otherwise(blanked)
    return F.when(pattern.found_in(text), blanked).otherwise(text)


def all_matches(text: Column, compiled: Sequence[Pattern]) -> Column:
    """Matches of all patterns as array<struct<pattern, lo, hi>>."""
    empty = F.array().cast("array<struct<pattern:string,parts:array<string>>>")
    cut = [empty]
    for hint, group in by_hint(compiled).items():
        named = F.array(
            *[
                F.struct(
                    F.lit(p.name).alias("pattern"),
                    F.when(p.found_in(text), pieces(text, p)).otherwise(F.array(text)).alias("parts"),
                )
                for p in group
            ]
        )
        cut.append(named if hint is None else F.when(passes(text, hint), named).otherwise(empty))

    def found(c: Column) -> Column:
        return F.transform(
            _ranges_of(c["parts"]), lambda r: F.struct(c["pattern"].alias("pattern"), r["lo"], r["hi"])
        )

    hits = F.filter(F.concat(*cut), lambda c: F.size(c["parts"]) > 1)
    return F.flatten(F.transform(hits, found))


def blank_all(text: Column, compiled: Sequence[Pattern]) -> Column:
    """Union of the blanks of all patterns, each scanning the original text."""

    def union(left: Column, right: Column) -> Column:
        both = F.array_join(
            F.zip_with(F.split(left, ""), F.split(right, ""), lambda a, b: F.when(a == " ", a).otherwise(b)), ""
        )
        return F.when(left == text, right).when(right == text, left).otherwise(both)

    def fold(masks: list[Column]) -> Column:
        return masks[0] if len(masks) == 1 else F.aggregate(F.array(*masks), text, union)

    masks = []
    for hint, group in by_hint(compiled).items():
        mask = fold([blank_matches(text, p) for p in group])
        masks.append(mask if hint is None else F.when(passes(text, hint), mask).otherwise(text))
    return fold(masks) if masks else text
