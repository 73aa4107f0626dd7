"""Text functions: token estimates, code indicators, links and paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns that speak for code; three or more make a text code. Fixed values, in the order of their origin; where Java's dialect
#: asks for it, braces are quoted, and ``[^\n]`` stands for a dot.
CODE = (
    r"function\s+\w+", r"const\s+\w+", r"import\s+[^\n]*from", r"export\s+", r"class\s+\w+", r"interface\s+\w+", r"type\s+\w+",
    r"\{\s*[^}]*\}", r"[\[\](){}]", r"=>", r"===?", r"!==?", r"//", r"/\*",
)


def code_indicators(text: Column) -> Column:
    """Number of code patterns found."""
    return sum((F.coalesce(text.rlike(p), F.lit(False)).cast("int") for p in CODE), F.lit(0))


def is_code(text: Column) -> Column:
    return code_indicators(text) >= 3


def token_estimate(text: Column) -> Column:
    """Quarter of the length with white space collapsed, times 1.2 for code and 0.9 otherwise, cut off."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\r]+", " "))
    return F.floor(F.floor(F.length(plain) / 4) * F.when(is_code(text), F.lit(1.2)).otherwise(F.lit(0.9))).cast("long")


def links(html: Column) -> Column:
    """Targets of href and src attributes in double quotes."""
    return F.regexp_extract_all(html, F.lit(r'(?:href|src)="([^"]*)"'), F.lit(1))


def braces(pattern: str) -> list[str]:
    """``a{b,c}`` as ``ab`` and ``ac``, nested ones too; braces without a partner, or with nothing to choose from, are literal."""
    depth, start = 0, -1
    for i, c in enumerate(pattern):
        if c == "{":
            depth += 1
            start = i if depth == 1 else start
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                inner, parts, level = pattern[start + 1 : i], [""], 0
                for x in inner:
                    level += (x == "{") - (x == "}")
                    if x == "," and level == 0:
                        parts.append("")
                    else:
                        parts[-1] += x
                if len(parts) == 1:
                    continue
                ends = braces(pattern[i + 1 :])
                return [pattern[:start] + p + e for part in parts for p in braces(part) for e in ends]
    return [pattern]


def glob_regex(pattern: str) -> str:
    """A file glob (``**``, ``*``, ``?``, ``[seq]``, ``{a,b}``) as a regular expression over whole paths."""
    return "^(?:" + "|".join(_one_glob(p) for p in braces(pattern)) + ")$"


def _one_glob(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        c, close = pattern[i], pattern.find("]", i + 2)
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 2
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 1
        elif c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and close > 0:
            out, i = out + char_class(pattern[i + 1 : close]), close
        else:
            out += "\\" + c if c in ".^$+()[]{}|\\" else c
        i += 1
    return out


def char_class(inside: str) -> str:
    """The inside of a glob's ``[seq]`` or ``[!seq]`` as a regular expression's class."""
    negated = inside.startswith("!")
    quoted = re.sub(r"([\\\[\]^&])", r"\\\1", inside[1:] if negated else inside)
    return f"[{'^' if negated else ''}{quoted}]"


#: What a shell pattern holds: a class, a star, a question mark, or characters that mean themselves.
SHELL = r"\[!?[^\]]+\]|\*|\?|[^*?\[]+|\["


def shell_regex(glob: Column) -> Column:
    """A column of shell patterns as regular expressions: ``*`` and ``?`` also match ``/``, ``[seq]`` and ``[!seq]`` are classes."""
    negated = lambda t: F.concat(F.lit("[^"), F.regexp_replace(F.substring(t, 3, 1 << 20), r"([\\\[^&])", r"\\$1"))
    plain = lambda t: F.concat(F.lit("["), F.regexp_replace(F.substring(t, 2, 1 << 20), r"([\\\[^&])", r"\\$1"))
    part = lambda t: (
        F.when(t == "*", ".*").when(t == "?", ".").when((F.length(t) > 2) & t.startswith("[!"), negated(t)).when((F.length(t) > 1) & t.startswith("["), plain(t))
        .otherwise(F.regexp_replace(t, r"([.^$+(){}|\[\]\\])", r"\\$1"))
    )
    return F.concat(F.lit("(?s)^"), F.array_join(F.transform(F.regexp_extract_all(glob, F.lit(SHELL), F.lit(0)), part), ""), F.lit("$"))
