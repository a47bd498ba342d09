"""Where units begin in Java, SQL, XML and YAML texts.

A unit is: in Java each method, constructor or nested type directly inside the outermost type; in
SQL each statement; in XML each child element of the root; in YAML each top-level key. Comment and
annotation lines directly above, with no blank line between, belong to it.
"""

from __future__ import annotations

import bisect
import re

_LINE_END = re.compile(r"\r?\n")


def line_starts(text: str) -> list[int]:
    """Offsets at which lines begin; a final line end opens no further line."""
    starts = [0]
    at = text.find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    if len(starts) > 1 and starts[-1] == len(text):
        starts.pop()
    return starts


class _Lines:
    """Line lookup and the kind of each line: blank, covered by comments or annotations, or code."""

    def __init__(self, text: str):
        self.text = text
        self.starts = line_starts(text)
        self.covers: list[tuple[int, int]] = []

    def of(self, offset: int) -> int:
        return bisect.bisect_right(self.starts, offset) - 1

    def loose(self) -> set[int]:
        """Lines that hold nothing but comments, annotations and blanks, at least one of the former."""
        code = bytearray(b"\x00") * len(self.starts)
        touched: set[int] = set()
        at = 0
        for a, b in [*self.covers, (len(self.text), len(self.text))]:
            for m in re.finditer(r"\S+", self.text[at:a]):
                code[self.of(at + m.start())] = 1
            if b > a:
                touched.update(range(self.of(a), self.of(b - 1) + 1))
            at = max(at, b)
        return {i for i in touched if not code[i]}

    def begin(self, line: int, loose: set[int]) -> int:
        while line > 0 and line - 1 in loose:
            line -= 1
        return line


_JAVA = re.compile(
    r'(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>"""(?:\\.|.)*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?)'
    r"|(?P<w>@?[^\W\d][\w$.]*)|(?P<p>[{}();=\[\]])|(?P<o>[^\s\w])|(?P<n>\d[\w.]*)",
    re.S,
)
_TYPES = {"class", "interface", "enum", "record", "@interface"}


def _java(text: str) -> list[int]:
    lines = _Lines(text)
    depth = parens = 0
    member: list[tuple[str, int]] = []  # tokens of the member that is being read
    assigned = False  # '=' seen outside parentheses
    called = False  # a parenthesis opened outside an annotation
    annotation = -1  # where an annotation began whose arguments may follow
    end = annotation_depth = 0
    decls: list[int] = []
    constants = False  # before the first ';' of an enum
    field_block = False
    for m in _JAVA.finditer(text):
        kind, tok, at = m.lastgroup, m.group(), m.start()
        if kind == "c":
            lines.covers.append((at, m.end()))
            continue
        if depth != 1:
            if kind == "p":
                if tok == "{":
                    depth += 1
                    if depth == 1:
                        constants = any(w == "enum" for w, _ in member)
                        member, assigned, called, annotation, parens = [], False, False, -1, 0
                elif tok == "}":
                    depth = max(0, depth - 1)
                    if depth == 1 and not field_block:
                        member, assigned, called, annotation, parens = [], False, False, -1, 0
                elif tok == ";" and depth == 0:
                    member = []
            if depth == 0 and kind == "w":
                member.append((tok, at))
            continue
        # directly inside the outermost type
        if annotation >= 0:
            if annotation_depth == 0 and tok != "(":
                lines.covers.append((annotation, end))
                annotation = -1
            else:
                annotation_depth += (tok == "(") - (tok == ")")
                end = m.end()
                if annotation_depth == 0:
                    lines.covers.append((annotation, end))
                    annotation = -1
                continue
        if kind == "w" and tok[0] == "@" and tok != "@interface" and parens == 0 and not assigned:
            annotation, annotation_depth, end = at, 0, m.end()
            continue
        if kind == "p":
            if tok == "(":
                parens += 1
                called = called or not assigned
            elif tok == ")":
                parens = max(0, parens - 1)
            elif tok == "=" and parens == 0:
                assigned = True
            elif tok == ";" and parens == 0:
                if called and not assigned and member and not constants:
                    decls.append(member[0][1])
                member, assigned, called, constants, field_block = [], False, False, False, False
                continue
            elif tok == "{":
                if parens or assigned:
                    field_block = True
                elif constants:
                    field_block = True
                elif member and (called or any(w in _TYPES for w, _ in member)):
                    decls.append(member[0][1])
                depth += 1
                continue
            elif tok == "}":
                depth = 0
                member = []
                continue
        if kind != "o" or tok == "<":
            member.append((tok, at))
    lines.covers.sort()
    loose = lines.loose()
    return [lines.begin(lines.of(at), loose) for at in decls]


_SQL = re.compile(
    r"(?P<c>--[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>'(?:''|[^'])*'?|\"[^\"]*\"?|`[^`]*`?|(?P<d>\$\w*\$).*?(?:(?P=d)|\Z))|(?P<e>;)|(?P<w>[^\s;'\"`/$-]+|.)",
    re.S,
)


def _sql(text: str) -> list[int]:
    lines = _Lines(text)
    firsts: list[int] = []
    fresh = True
    for m in _SQL.finditer(text):
        if m.group("c") is not None:
            lines.covers.append(m.span())
        elif m.group("e"):
            fresh = True
        elif fresh and not m.group().isspace():
            firsts.append(m.start())
            fresh = False
    loose = lines.loose()
    return [lines.begin(lines.of(at), loose) for at in firsts]


_XML = re.compile(
    r"(?P<c><!--.*?(?:-->|\Z))|(?P<x><!\[CDATA\[.*?(?:\]\]>|\Z)|<\?.*?(?:\?>|\Z)|<![A-Za-z](?:[^<>\[]|\[.*?\])*>?)"
    r"|(?P<end></[^>]*>?)|(?P<open><[A-Za-z_:](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>?)",
    re.S,
)


def _xml(text: str) -> list[int]:
    lines = _Lines(text)
    depth = 0
    opens: list[int] = []
    for m in _XML.finditer(text):
        if m.group("c") is not None:
            lines.covers.append(m.span())
        elif m.group("end") is not None:
            depth = max(0, depth - 1)
        elif m.group("open") is not None:
            if depth == 1:
                opens.append(m.start())
            depth += not m.group().endswith("/>")
    loose = lines.loose()
    return [lines.begin(lines.of(at), loose) for at in opens]


_YAML_KEY = re.compile(r"""(?:"[^"]*"|'[^']*'|[^\s#\-'"\[\]{},&*!|>%@`?:][^\r\n]*?|-[^\s][^\r\n]*?)\s*:(?=\s|$)""")


def _yaml(text: str) -> list[int]:
    starts = line_starts(text)
    rows = [text[a:b].rstrip("\r\n") for a, b in zip(starts, [*starts[1:], len(text)])]
    out = []
    quote = ""
    for i, row in enumerate(rows):
        if quote:
            if quote in row:
                quote = ""
            continue
        if row[:1] in (" ", "\t", "#", "") or not (m := _YAML_KEY.match(row)):
            continue
        value = row[m.end() :].strip()
        if value[:1] in "\"'" and value and value.count(value[0]) % 2 and "#" not in value:
            quote = value[0]
        at = i
        while at > 0 and rows[at - 1].lstrip().startswith("#"):
            at -= 1
        out.append(at)
    return out


def unit_lines(path: str | None, chunk_type: str | None, text: str) -> list[int]:
    """0-based lines at which units begin, ascending; [] for rows without units."""
    name = (path or "").lower()
    if name.endswith(".java"):
        found = [] if chunk_type == "METHOD" else _java(text)
    elif name.endswith(".sql"):
        found = _sql(text)
    elif name.endswith(".xml"):
        found = _xml(text)
    elif name.endswith((".yml", ".yaml")):
        found = _yaml(text)
    else:
        found = []
    return sorted(set(found))
