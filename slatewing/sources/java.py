"""Methods of Java sources, line differences and their rendering: per-file work in Arrow batches."""

from __future__ import annotations

import bisect
import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LEX = re.compile(
    r'(?P<skip>//[^\n]*|/\*.*?(?:\*/|\Z)|"""(?:\\.|.)*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?)|(?P<word>@?[^\W\d][\w.]*)|(?P<mark>[{}();=,])',
    re.S,
)
#: Words before a parenthesis that are no calls, and annotations of tests.
_NO_CALLS = {"if", "for", "while", "switch", "catch", "synchronized", "return", "new", "super", "this", "try", "throw", "assert", "do", "else"}
_TEST_MARKS = {"Test", "ParameterizedTest", "RepeatedTest", "TestFactory", "TestTemplate", "BeforeEach", "AfterEach", "BeforeAll", "AfterAll", "Before", "After"}


def java_methods(text: str) -> list[dict]:
    """Methods and constructors directly inside the outermost type: name, parameters, lines (1-based),
    annotations, sorted called names. Methods that carry a test annotation are left out."""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    found: list[dict] = []
    depth = parens = 0
    member: list[tuple[str, int, int]] = []
    current: dict | None = None
    opened = args = -1
    assigned = False
    owner = ""
    previous = ""
    for m in _LEX.finditer(text):
        if m.lastgroup == "skip":
            continue
        token, at = m.group(), m.start()
        if depth == 0:
            if previous in ("class", "interface", "enum", "record") and not owner:
                owner = token
            depth += token == "{"
        elif depth == 1:
            if token == "(":
                parens += 1
                if parens == 1 and args < 0 and not assigned and not previous.startswith("@"):
                    args = m.end()
                    name = previous
            elif token == ")":
                parens -= 1
                if parens == 0 and args >= 0 and opened < 0:
                    opened = at
            elif token == "=" and parens == 0:
                assigned = True
            elif parens == 0 and token in ("{", ";", "}"):
                if args >= 0 and not assigned and member and token != "}":
                    current = {
                        "owner": owner, "name": name, "parameters": " ".join(text[args:opened].split()), "begin": member[0][1],
                        "annotations": [w[1:] for w, _, _ in member if w[0] == "@" and w != "@interface"], "calls": set(),
                    }
                    if token == ";":
                        found.append(current | {"end": at})
                        current = None
                member, assigned, args, opened = [], False, -1, -1
                depth += (token == "{") - (token == "}")
            if m.lastgroup == "word" and parens == 0 and depth == 1:
                member.append((token, at, m.end()))
        else:
            depth += (token == "{") - (token == "}")
            if current is not None and token == "(" and previous[:1].isalpha() and previous not in _NO_CALLS:
                current["calls"].add(previous.rsplit(".", 1)[-1])
            if depth == 1 and current is not None:
                found.append(current | {"end": at})
                current = None
        previous = token
    out = []
    for f in found:
        if not any(a.rsplit(".", 1)[-1] in _TEST_MARKS for a in f["annotations"]):
            out.append(f | {
                "start_line": bisect.bisect_right(starts, f.pop("begin")), "end_line": bisect.bisect_right(starts, f.pop("end")), "calls": sorted(f["calls"]),
            })
    return out


def method_rows(files: DataFrame) -> DataFrame:
    """``(id, symbol_name, start_line, end_line, annotations, called_symbols)`` of ``(id, content)`` Java texts."""

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [
                (i, f"{f['owner']}#{f['name']}({f['parameters']})", f["start_line"], f["end_line"], ",".join(f["annotations"]), f["calls"])
                for i, text in zip(frame["id"], frame["content"]) for f in java_methods(text)
            ]
            yield pd.DataFrame(rows, columns=["id", "symbol_name", "start_line", "end_line", "annotations", "called_symbols"])

    rows = files.where("content is not null").select("id", "content")
    return rows.mapInPandas(extract, "id long, symbol_name string, start_line int, end_line int, annotations string, called_symbols array<string>")


#: Lines that occur more often than this in a block are no anchors of a difference.
MOST_OCCURRENCES = 64


def _anchor(a: list[str], b: list[str], block: tuple[int, int, int, int]) -> tuple[int, int, int] | None:
    """The run of equal lines ``(old first, new first, length)`` around the rarest common line of a block; the longest of equally
    rare ones."""
    i, j, k, n = block
    places: dict[str, list[int]] = {}
    for x in range(i, j):
        places.setdefault(a[x], []).append(x)
    best, y = None, k
    while y < n:
        there = places.get(b[y], ())
        beyond = y + 1
        if 0 < len(there) <= MOST_OCCURRENCES and (best is None or len(there) <= best[0]):
            for x in there:
                first, at, rare = x, y, len(there)
                while first > i and at > k and a[first - 1] == b[at - 1]:
                    first, at = first - 1, at - 1
                end = y + 1
                while x + end - y < j and end < n and a[x + end - y] == b[end]:
                    rare = min(rare, len(places[b[end]]))
                    end += 1
                beyond = max(beyond, end)
                if best is None or (rare, at - end) < best[:2]:
                    best = (rare, at - end, first, at)
        y = beyond
    return None if best is None else (best[2], best[3], -best[1])


def line_edits(old: str, new: str) -> list[tuple[int, int, int, int]]:
    """Edits as half-open line ranges ``(old first, old end, new first, new end)``, from 0, by histogram difference: equal lines at
    the ends of a block are set aside, then it is parted at its rarest common line."""
    a, b = re.split(r"\r\n|\n|\r", old), re.split(r"\r\n|\n|\r", new)
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, n = todo.pop()
        while i < j and k < n and a[i] == b[k]:
            i, k = i + 1, k + 1
        while i < j and k < n and a[j - 1] == b[n - 1]:
            j, n = j - 1, n - 1
        if i == j and k == n:
            continue
        if i < j and k < n and (found := _anchor(a, b, (i, j, k, n))):
            x, y, length = found
            todo += [(i, x, k, y), (x + length, j, y + length, n)]
        else:
            out.append((i, j, k, n))
    joined: list[tuple[int, int, int, int]] = []
    for e in sorted(out):
        if joined and joined[-1][1] == e[0] and joined[-1][3] == e[2]:
            joined[-1] = (joined[-1][0], e[1], joined[-1][2], e[3])
        else:
            joined.append(e)
    return joined


def unified(old: str, new: str, around: int = 3, limit: int = 24_000) -> str:
    """The edits with context lines and hunk headers, cut at a line end within ``limit`` characters."""
    a, b = re.split(r"\r\n|\n|\r", old), re.split(r"\r\n|\n|\r", new)
    text = "\n".join(line.rstrip("\n") for line in list(difflib.unified_diff(a, b, n=around, lineterm=""))[2:])
    if len(text) <= limit:
        return text
    return text[: text.rfind("\n", 0, limit)] + "\n..."


def line_diffs(pairs: DataFrame, old: str = "base_content", new: str = "content") -> DataFrame:
    """``(id, additions, deletions, old_ranges, new_ranges)`` of each row whose two texts differ; ranges
    are closed and count from 1. Null texts count as empty."""
    schema = "id long, additions int, deletions int, old_ranges array<struct<start:int,end:int>>, new_ranges array<struct<start:int,end:int>>"

    def diff(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, a, b in zip(frame["id"], frame[old], frame[new]):
                edits = line_edits(a or "", b or "")
                rows.append((
                    i, sum(n - k for _, _, k, n in edits), sum(j - h for h, j, _, _ in edits),
                    [{"start": h + 1, "end": j} for h, j, _, _ in edits if j > h], [{"start": k + 1, "end": n} for _, _, k, n in edits if n > k],
                ))
            yield pd.DataFrame(rows, columns=["id", "additions", "deletions", "old_ranges", "new_ranges"])

    differing = pairs.where(~F.col(old).eqNullSafe(F.col(new))).select("id", old, new)
    return differing.mapInPandas(diff, schema)
