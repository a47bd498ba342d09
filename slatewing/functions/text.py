"""Column functions on code texts, paths and names. All stay in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_END = r"\r\n|\n|\r"


def contains_any(c: Column, tokens: list[str]) -> Column:
    """Whether the text holds any token, ignoring case; null is the empty text."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return reduce(Column.__or__, [F.contains(low, F.lit(t.lower())) for t in tokens])


def matches(c: Column, pattern: str) -> Column:
    """Whether the pattern occurs, ignoring case and over line ends; null is the empty text."""
    return F.coalesce(c, F.lit("")).rlike(f"(?is){pattern}")


def first_match_line(c: Column, pattern: str, start_line: Column) -> Column:
    """File line of the first match, ignoring case; ``.`` stops at line ends here, so a match that needs
    to cross them falls back to the first line."""
    at = F.regexp_instr(F.coalesce(c, F.lit("")), F.lit(f"(?i){pattern}"))
    before = F.substring(F.coalesce(c, F.lit("")), F.lit(1), at - 1)
    return start_line + F.when(at > 0, newlines(before)).otherwise(0)


def newlines(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def lines(c: Column) -> Column:
    """The lines of a text; a final line end opens a last, empty one."""
    return F.split(F.coalesce(c, F.lit("")), LINE_END, -1)


def excerpt(c: Column, start_line: Column, line: Column, around: int = 2) -> Column:
    """``'<number> | <text>'`` of the lines around a file line."""
    rows = lines(c)
    first = F.greatest(line - start_line - around, F.lit(0))
    last = F.least(line - start_line + around, F.size(rows) - 1)
    part = F.slice(rows, first + 1, F.greatest(last - first + 1, F.lit(0)))
    numbered = F.transform(part, lambda x, i: F.concat((start_line + first + i).cast("string"), F.lit(" | "), x))
    return F.array_join(numbered, "\n")


def normal_path(c: Column) -> Column:
    """Forward slashes, none doubled, no leading ``./``; null is the empty path."""
    p = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\\", "/")
    return F.regexp_replace(F.regexp_replace(p, r"/+", "/"), r"^(?:\./)+", "")


def without_blanks(c: Column) -> Column:
    """White space outside of quoted runs removed."""
    return F.regexp_replace(c, r"(\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?)|\s+", "$1")


def simple_name(c: Column) -> Column:
    """Last part of a qualified symbol, without its parameters, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\(.*", ""), r"^.*[#.:]", ""))


def joined_endpoint(base: Column, path: Column) -> Column:
    """``/base/path`` without doubled or trailing slashes."""
    p = F.regexp_replace(F.concat(F.lit("/"), F.coalesce(base, F.lit("")), F.lit("/"), F.coalesce(path, F.lit(""))), r"/+", "/")
    return F.when(p == "/", p).otherwise(F.regexp_replace(p, r"/$", ""))


def enum_name(c: Column) -> Column:
    """Loose text to an enumeration's form: camel humps and other characters to ``_``, upper case."""
    humps = F.regexp_replace(F.trim(c), r"([a-z0-9])([A-Z])", "$1_$2")
    return F.upper(F.regexp_replace(F.regexp_replace(humps, r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", ""))


def tokens(c: Column) -> Column:
    """Distinct words of a text in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9_]+"), lambda t: F.length(t) > 0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token sets; two empty sets are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def glob_pattern(glob: str) -> str:
    """A path glob (``**``, ``*``, ``?``) as a regular expression for whole values."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(glob[i]) or (glob[i] if glob[i].isalnum() or glob[i] in "/_" else "\\" + glob[i]))
            i += 1
    return "^" + "".join(out) + "$"


def route_pattern(c: Column) -> Column:
    """A route pattern column (``**``, ``*``, ``{name}``) as a regular expression for whole routes."""
    p = F.regexp_replace(c, r"([.+()\[\]^$|])", r"\\$1")
    p = F.regexp_replace(p, r"\{[^}/]*\}", "\u0001")
    p = F.regexp_replace(p, r"/\*\*", "\u0002")
    p = F.regexp_replace(p, r"\*", "[^/]*")
    p = F.regexp_replace(F.regexp_replace(p, "\u0001", "[^/]+"), "\u0002", "(?:/.*)?")
    return F.concat(F.lit("^"), p, F.lit("$"))


def head_tail(c: Column, limit: int, marker: str = "\n...\n") -> Column:
    """Texts over the limit: two thirds from the start, a marker, the rest from the end."""
    room = limit - len(marker)
    head = room * 2 // 3
    cut = F.concat(F.substring(c, 1, head), F.lit(marker), F.right(c, F.lit(room - head)))
    return F.when(F.length(c) <= limit, c).otherwise(cut)


#: Literals (kept) or comments (dropped) of C-like sources; text blocks first.
LITERAL_OR_COMMENT = r"(\"\"\"[\s\S]*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|//[^\n]*|/\*[\s\S]*?\*/"


def without_comments(c: Column) -> Column:
    """Comments removed, literals and line ends outside of block comments kept."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), LITERAL_OR_COMMENT, "$1")


def json_body(c: Column) -> Column:
    """The outermost braces of a text, without a code fence around them; null where there are none."""
    body = F.regexp_extract(F.regexp_replace(F.coalesce(c, F.lit("")), r"```(?:json)?", ""), r"(?s)\{.*\}", 0)
    return F.when(body != "", body)


def any_token(c: Column, query: str) -> Column:
    """Whether any token of two or more characters of the query stands in the text, ignoring case."""
    words = [w for w in re.split(r"[^a-z0-9_$#{}./-]+", query.lower()) if len(w) >= 2]
    return contains_any(c, words) if words else F.lit(False)
