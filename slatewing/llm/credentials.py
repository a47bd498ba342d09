"""Credentials embedded in source code (problem 1): where they begin, and texts with them masked.

One automaton (see :mod:`slatewing.llm.automaton`) joins the token formats, the key armor, the
connection-string grammar and the names under which secrets are kept. It runs over overlapping chunks
of the texts; its hits, deduplicated by absolute position, name the places that are read closely:
there the value's extent is found and judged, and placeholders are spliced over the values.

The expressions of the close reading take time in proportion to the text: each begins at the first character of
a run only and none gives back what it took (``++``, ``*+``), so a line of any length is read whole.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewing.llm.automaton import Automaton
from slatewing.llm.units import line_starts
from slatewing.session import counted_broadcast

PLACEHOLDER = "MASKED_SECRET"
#: Characters of text handled at once in a worker.
BATCH_CHARS = 4_000_000

#: What leads the automaton to a place: pattern, ignore case.
ANCHORS = {
    "aws": ("A(KIA|SIA)[A-Z0-9]{2}", False),
    "github": ("(gh[pousr]|github_pat)_[A-Za-z0-9]", False),
    "gitlab": ("glpat-[A-Za-z0-9_\\-]", False),
    "dashed": ("[^A-Za-z0-9_](sk|pk|rk)-[A-Za-z0-9]{2}", False),
    "registry": ("npm_[A-Za-z0-9]", False),
    "staged": ("[a-z0-9]_(live|prod|test)_[A-Za-z0-9]", False),
    "chat": ("xox[abeoprs]-", False),
    "cloud": ("AIza[A-Za-z0-9_\\-]", False),
    "jwt": ("eyJ[A-Za-z0-9]", False),
    "mail": ("[^A-Za-z0-9_]SG\\.[A-Za-z0-9_\\-]{2}", False),
    "armor": ("-----BEGIN ([A-Z0-9]+ ){0,3}PRIVATE KEY( BLOCK)?-----", False),
    "address": ("[A-Za-z0-9+.\\-]://[^\\s/:@\"'<>]*:[^\\s@\"'<>]+@", False),
    "scheme": ("(basic|bearer) [A-Za-z0-9+/]", True),
    "password": ("passw|pwd|passphrase|passcode|kennwort|mot_?-?de_?-?passe|contrase|(pass|pw|psw|clave)[\"']?\\s?[=:(]", True),
    "short": ("[a-z_](Pass|Pw|Pwd|PASS|PW|Psw)[^A-Za-z]|[\"'](pass|pw|psw)[\"'\\\\]", False),
    "named": ("secret|credential|token", True),
    "key": (
        "(api|secret|access|private|signing|sign|auth|encryption|encrypt|crypt|salt|master|server|client|aes|hmac|shared|account|storage|jwt|license|deploy|host|rsa|session)[\\-_.]?key",
        True,
    ),
    "sql": ("identified\\s{1,3}by", True),
    "call": ("(login|logon|connect|authenticate|credentials?)\\(|decode\\(\"", True),
    "joined": ("[ \\t]{2}\\+ ?\"[A-Za-z0-9+/=_.\\-]{3}|\" ?\\+\\r?\\n", False),
}


@lru_cache(1)
def automaton() -> Automaton:
    return Automaton(ANCHORS)


_TOKEN = re.compile(
    r"(?<![A-Za-z0-9_])(?:A(?:KIA|SIA)[0-9A-Z]{12,}+|gh[pousr]_[A-Za-z0-9]{20,}+|github_pat_\w{20,}+|glpat-[\w-]{16,}+"
    r"|(?:sk|pk|rk)-[A-Za-z0-9_-]{16,}+|npm_[A-Za-z0-9]{16,}+|[a-z0-9]{2,8}_(?:live|prod|test)_[A-Za-z0-9]{16,}+"
    r"|xox[abeoprs]-[\w-]{10,}+|AIza[\w-]{30,}+|(?<!-)eyJ[\w-]{8,}+\.[\w-]{8,}+(?:\.[\w-]*+)?|SG\.[\w-]{16,}+\.[\w-]{16,}+)"
)
_ARMOR = re.compile(r"-----BEGIN (?:[A-Z0-9]++ ){0,3}PRIVATE KEY(?: BLOCK)?-----")
#: What may stand around the lines of a key's body: blanks, escaped line ends, quotes, joins, comment marks.
_ARMOR_GAP = re.compile(r"(?:\s|\\+[nrt]|\\+(?=\s)|[\"'`,#*|]|\+(?=[\s\"'])|//(?=\s)|/\*|--(?!-)|\)|\.(?:append|concat|add)\()*+")
_ARMOR_LINE = re.compile(r"([A-Za-z0-9+/=]+)(?=\s|\\+[nr]|[\"'`<]|-----END|\Z)")
_ARMOR_HEAD = re.compile(r"(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset): ?[^\n\\\"]*+")
_SEGMENT = re.compile(r"(?<![^\s@\"'<>])([^\s@\"'<>]++)@")
_ADDRESS = re.compile(r"(?<=[A-Za-z0-9+.\-])://[^\s/:]*+:")
_SCHEME = re.compile(r"(?i)\b(basic|bearer)\s++([A-Za-z0-9._~+/=-]{6,}+)")
#: A name from its first letter on; digits, dots and dashes may precede it.
_NAME = r"(?<![\w.\-])(?:(?![A-Za-z_À-ÿ])[\w.\-])*+([A-Za-z_À-ÿ][\w.\-]*+)"
_PAIR = re.compile(
    _NAME + r"(?:\\?[\"'])?\]?\s*+(?:=>|:=|[=:])\s*+(?:(\\?)([\"'`])((?>(?:(?!\2\3)(?:\\.|.))*+))\2\3|([^\s\"'`]\S*+(?: \S++)*+))?"
)
_CALL = re.compile(r"\bset([A-Z]\w*+)\(\s*+\"([^\"]*+)\"")
_LISTED = re.compile(r"[\"']([A-Za-z][\w.\-]*+)[\"']\s*+,\s*+[\"']([^\"']*+)[\"']")
_LOGIN = re.compile(r"(?i)\b\w*(?:login|logon|connect|authenticate|credentials?)\(\s*+(?:[^()\"]*,\s*+)?\"[^\"]*+\"\s*+,\s*+\"([^\"]*+)\"\s*+\)")
_EQUALS = re.compile(r"\"([^\"]++)\"\s*+\.equals(?:IgnoreCase)?\([^;\"]*+\"([\w.\-]++)\"")
_EQUALS_BACK = re.compile(r"\"([\w.\-]++)\"\)?\s*+\.equals(?:IgnoreCase)?\(\s*+\"([^\"]++)\"")
_WAS = re.compile(_NAME + r" (?:was|is|war|ist|est|était|es|era)\s*+:? ?[\"'`]([^\"'`]++)[\"'`]")
_SQL = re.compile(r"(?i)\b(?:password|identified\s++by(?:\s++password)?)\s++'((?:''|[^'])*)'")
_ELEMENT = re.compile(r"<([A-Za-z][\w.\-:]*+)(?:\s[^<>]*+)?>([^<>]++)</\1\s*+>")
_PROPERTY = re.compile(r"<\w(?>[^<>]*?\b(?:name|key)\s*+=\s*+\"([\w.\-]++)\")[^<>]*?\bvalue\s*+=\s*+\"([^\"]*+)\"")
_CHARS = re.compile(r"(?<!\w)(?:\d*+)([A-Za-z_]\w*+)\s*+(?:\[\]\s*+)?=\s*+(?:new\s++char\s*+\[\s*+\]\s*+)?\{((?:\s*+'(?:\\.|[^'\\])'\s*+,?)++)\s*+\}")
_DEFAULT = re.compile(r"\$\{([\w.\-]++):-?([^{}]*+)\}")
_DECODE = re.compile(r"\bdecode\w*+\(\s*+\"([A-Za-z0-9+/=_-]{12,}+)\"")
_DECODED = re.compile(r"(?<!\w)\d*+([A-Za-z_]\w*+)\s*+=")
_FIRST_LITERAL = re.compile(r"[=(,:]\s*+\"([^\"\s\\]{3,}+)\"\s*+(\+)?\s*+$")
_NEXT_LITERAL = re.compile(r"\s*+\+?\s*+\"([^\"\s\\]{3,}+)\"\s*+(\+)?\s*+[;,)]*+\s*+$")
_ENV_NAME = re.compile(r"\s*+-?\s*+(?:name|key)\s*+:\s*+[\"']?([\w.\-]++)[\"']?\s*+$")
_ENV_VALUE = re.compile(r"\s*+-?\s*+value\s*+:\s*+(?:\"([^\"]*+)\"\s*+$|'([^']*+)'\s*+$|(\S.*+))")
_BLOCK_MARK = re.compile(r"(?:\\|[|>][+-]?\d?)\Z")
_CONTINUED = re.compile(r"\s*+[#!]?\s*+([\w.\-]++)\s*+[=:]\s*+(\S+?)\\$")
_QUERY = re.compile(r"(?<=[;&? ,])(?:amp;)?([A-Za-z_][\w\-]*+)=([^\s;&\"'<>,]++)")
_NESTED = re.compile(r"(?<![\w.\-])(?:(?![A-Za-z_])[\w.\-])*+([A-Za-z_][\w.\-]*+)=([^\s;&\"'<>,]++)")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-zà-ÿ]+|\d+")

#: Last words of names that hold secrets; words before "key" that make it one.
_SECRET_WORDS = {
    "password", "passwd", "passwort", "pwd", "pass", "pw", "psw", "passphrase", "passcode", "kennwort", "passe",
    "secret", "secrets", "credential", "credentials", "token", "clave", "contrasena", "contraseña",
    "apikey", "secretkey", "accesskey", "authkey", "privatekey", "authtoken", "accesstoken", "dbpassword", "userpassword",
}
_KEY_WORDS = {
    "api", "secret", "access", "private", "signing", "sign", "auth", "encryption", "encrypt", "crypt", "salt", "master",
    "server", "client", "aes", "hmac", "shared", "account", "storage", "jwt", "license", "deploy", "rsa", "session", "service",
}
_NO_VALUE = re.compile(r"(?i)\W*+(?:null|none|nil|true|false|undefined|n/?a|tbd)?\W*+")
_STAND_IN_WORD = re.compile(
    r"(?i)(?<![^\W_])(?:change[-_.]?me|changeit|your|example|placeholder|dummy|redacted|masked|hidden|replace|insert|todo|fixme|sample|fake"
    r"|xxx++|none|empty|tobeset|unset|foo|bar|test)(?![^\W_])"
)
_COVERED = re.compile(r"[\W_]*+")
#: Names whose values people choose: passwords may be plain words or several words.
_CHOSEN = {"password", "passwd", "passwort", "pwd", "pass", "pw", "psw", "passphrase", "kennwort", "passe", "clave", "contrasena", "contraseña", "dbpassword", "userpassword"}
#: Words that stand under such names as kinds, states or actions, and words of which messages are made.
_NO_PASSWORDS = {
    "string", "text", "hidden", "required", "optional", "plain", "plaintext", "basic", "bearer", "bcrypt", "default", "disabled", "enabled", "encoded",
    "encrypted", "input", "label", "field", "value", "column", "varchar", "object", "reset", "forgot", "forgotten", "login", "user", "username", "account",
    "current", "confirm", "change", "missing", "invalid", "wrong", "expired", "unknown", "enter", "eingeben", "title", "error", "message", "format", "the",
    "is", "are", "was", "must", "may", "be", "not", "your", "for", "and", "or", "of", "an", "to", "too", "has", "have", "with", "in", "by", "from", "set",
    "short", "long", "der", "die", "das", "ist", "sind", "war", "muss", "darf", "nicht", "und", "oder", "ein", "eine", "zu", "im", "von", "mit", "le", "la",
    "les", "est", "et", "ou", "ne", "pas", "un", "une", "du", "de", "doit", "el", "los", "es", "debe", "no", "y", "una", "su", "read", "only", "manager",
}
_REFERENCE = re.compile(
    r"(?i)(?:\$\{|\$\(|#\{|\{\{|%\{|%\w+%|\$[A-Z_]+$|<|@[\w.]+@|\[\[|ENC\(|\{cipher\}|\{(?:vault|secret|bcrypt|sha|ssha|argon|scrypt|pbkdf)[^}]*\}|vault:|env:|ssm:|kms:|arn:|op://|sm://|file:|classpath:|secret(?:s|ref)?[:/]"
    r"|\$2[aby]\$|\$argon|\$[156]\$|System\.|process\.env|os\.environ|getenv|-----BEGIN)"
)
_CODE = (".java", ".js", ".ts", ".jsx", ".tsx", ".kt", ".scala", ".groovy", ".py", ".go", ".cs", ".php", ".rb", ".html", ".ftl", ".jsp", ".vue")


@lru_cache(65536)
def secret_name(name: str) -> bool:
    """Whether a value kept under this name is a secret: judged by the last word of its last part."""
    last = re.split(r"[.:]", name.rstrip(".-_"))[-1]
    words = [w.lower() for w in _WORDS.findall(last)]
    while words and words[-1].isdigit():
        words.pop()
    if not words:
        return False
    if words[-1] == "key":
        return len(words) > 1 and words[-2] in _KEY_WORDS
    return words[-1] in _SECRET_WORDS


def stand_in(value: str) -> bool:
    """Whether a value only stands in for one: nothing, one character throughout, a covered sample, or words like 'changeme'."""
    covered = _COVERED.match(value).group()
    tail = value[-6:].lower()
    return bool(
        _NO_VALUE.fullmatch(value)
        or len(set(value)) == 1
        or _STAND_IN_WORD.search(value)
        or any(x in covered for x in ("***", "...", "•"))
        or value[len(covered) : len(covered) + 4].lower() == "xxxx"
        or tail == "xxxxxx"
        or tail.endswith(("****", "•••", "..."))
    )


def usable(value: str) -> bool:
    """Whether a literal could be used as it stands: no stand-in, no reference, nothing encrypted."""
    v = value.strip()
    if len(v) < 4 or re.search(r"\s", v) or _REFERENCE.match(v) or stand_in(v):
        return False
    if _TOKEN.fullmatch(v):
        return True
    if v.isalpha():  # a plain word is a name or label, unless upper and lower case are mixed throughout
        return len(v) >= 12 and len(re.findall(r"[a-z][A-Z]", v)) >= 3
    return not re.fullmatch(r"[\W_]+", v)


def chosen(name: str, value: str) -> bool:
    """Whether a value under a password's name is one that people choose: a plain word in small letters, three words
    or more that make no message, or three characters with a digit."""
    words = [w.lower() for w in _WORDS.findall(re.split(r"[.:]", name.rstrip(".-_"))[-1])]
    v = value.strip()
    if not words or words[-1] not in _CHOSEN or not v or _REFERENCE.match(v) or stand_in(v):
        return False
    parts = v.split(" ")
    if any(p in _NO_PASSWORDS or secret_name(p) for p in parts):
        return False
    if len(parts) == 1:
        return len(v) >= 5 and v.isalpha() and v.islower() or len(v) == 3 and v.isalnum() and any(map(str.isdigit, v)) and any(map(str.isalpha, v))
    return len(parts) >= 3 and all(p.isalnum() and p.islower() and len(p) > 1 for p in parts)


def held(name: str, value: str) -> bool:
    """Whether a literal kept under this name is a credential."""
    return secret_name(name) and (usable(value) or chosen(name, value))


def _name_before(text: str, at: int) -> str | None:
    """The name that is given a value which begins at ``at``."""
    i = at - (at > 0 and text[at - 1] in "\"'")
    while i > 0 and text[i - 1].isspace():
        i -= 1
    if i == 0 or text[i - 1] not in "=:":
        return None
    i -= 1
    while i > 0 and text[i - 1].isspace():
        i -= 1
    i -= i > 0 and text[i - 1] in "\"'"
    j = i
    while j > 0 and (text[j - 1].isalnum() or text[j - 1] in "_.-"):
        j -= 1
    m = re.search(r"[A-Za-z_]", text[j:i])
    return text[j + m.start() : i] if m else None


def _secretive(joined: str) -> bool:
    """A joined literal that reads as a random value."""
    return (
        len(joined) >= 12
        and bool(_TOKEN.match(joined) or re.fullmatch(r"[A-Za-z0-9+/=_.\-]+", joined))
        and any(c.isdigit() for c in joined)
        and any(c.isalpha() for c in joined)
        and usable(joined)
    )


class _Text:
    def __init__(self, path: str, text: str):
        self.text = text
        self.code = path.lower().endswith(_CODE)
        self.properties = path.lower().endswith((".properties", ".env")) or "/.env" in path.replace("\\", "/").lower()
        self.starts = line_starts(text)
        self.spans: set[tuple[int, int]] = set()

    def line(self, k: int) -> str:
        stop = self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text)
        return self.text[self.starts[k] : stop].rstrip("\r\n")

    def read(self, k: int) -> None:
        """Collect the spans of the values that begin on line ``k`` or are announced there."""
        row, base = self.line(k), self.starts[k]

        def keep(a: int, b: int) -> None:
            self.spans.add((base + a, base + b))

        for m in _ARMOR.finditer(row):
            self.armor(base + m.start(), base + m.end())
        for m in _TOKEN.finditer(row):
            if not row[max(0, m.start() - 8) : m.start()].lower().endswith(("enc(", "{cipher}")) and usable(m.group()):
                keep(*m.span())
        for m in _SEGMENT.finditer(row) if "://" in row else ():
            n = _ADDRESS.search(row, m.start(), m.end(1))
            if n and n.end() < m.end(1) and usable(row[n.end() : m.end(1)]):
                keep(n.end(), m.end(1))
        for m in _SCHEME.finditer(row):
            if m.group(1).lower() == "basic":
                try:
                    user, colon, value = base64.b64decode(m.group(2) + "=" * (-len(m.group(2)) % 4)).partition(b":")
                except (binascii.Error, ValueError):
                    continue
                if colon and user and len(value) >= 3 and not stand_in(value.decode("utf-8", "replace")):
                    keep(*m.span(2))
            elif any(c.isdigit() for c in m.group(2)) and usable(m.group(2)):
                keep(*m.span(2))
        for pattern, name, value in ((_LISTED, 1, 2), (_WAS, 1, 2), (_ELEMENT, 1, 2), (_PROPERTY, 1, 2), (_EQUALS, 2, 1), (_EQUALS_BACK, 1, 2), (_CALL, 1, 2)):
            for m in pattern.finditer(row):
                if held(m.group(name), m.group(value)):
                    keep(*m.span(value))
        for m in _LOGIN.finditer(row):
            if usable(m.group(1)):
                keep(*m.span(1))
        for m in _SQL.finditer(row):
            if usable(m.group(1)) or chosen("password", m.group(1)):
                keep(*m.span(1))
        last = 0
        for m in _DECODE.finditer(row):
            begin = max(last, row.rfind(";", last, m.start()) + 1, row.rfind('"', last, m.start()) + 1)
            n = _DECODED.search(row, begin, m.start())
            last = m.end()
            words = [w.lower() for w in _WORDS.findall(n.group(1))] if n else []
            if words and (words[-1] == "key" and words[0] != "public" or secret_name(n.group(1))) and usable(m.group(1)):
                keep(*m.span(1))
        for m in _CHARS.finditer(row):
            if held(m.group(1), "".join(re.findall(r"'(\\.|[^'])'", m.group(2)))):
                keep(*m.span(2))
        self.pairs(row, keep)
        self.joined(k, row)
        self.following(k, row)

    def pairs(self, row: str, keep) -> None:
        for m in _PAIR.finditer(row):
            # a pair may begin inside the unquoted value of another
            self.pair(row, m, keep)
            inner = m.group(5) if m.group(5) is not None else m.group(4)
            if inner:
                base = m.start(5) if m.group(5) is not None else m.start(4)
                for n in _PAIR.finditer(inner):
                    self.pair(inner, n, lambda a, b, base=base: keep(base + a, base + b), nested=True)
                    if n.group(5):
                        at = base + n.start(5)
                        for o in _NESTED.finditer(n.group(5)):
                            if secret_name(o.group(1)) and usable(o.group(2)):
                                keep(at + o.start(2), at + o.end(2))
        for m in _QUERY.finditer(row):
            if secret_name(m.group(1)) and usable(m.group(2)) and (not self.code or any(c.isdigit() for c in m.group(2)) and "(" not in m.group(2)):
                keep(*m.span(2))
        for m in _DEFAULT.finditer(row):
            outer = _name_before(row, m.start())
            if held(m.group(1), m.group(2)) or outer and held(outer, m.group(2)):
                keep(*m.span(2))

    def pair(self, row: str, m: re.Match, keep, nested: bool = False) -> None:
        if not secret_name(m.group(1)):
            return
        if m.group(4) is not None:
            if held(m.group(1), m.group(4)) and not m.group(4).startswith("${"):
                keep(*m.span(4))
            return
        value = m.group(5)
        if not value:
            return
        comment = re.match(r"\s*(?://|/?\*|#|--|<!--)", row) is not None
        if self.code and not comment or nested:
            value = re.match(r"[^\s;&\"'<>,]+", value)
            value = value.group() if value else ""
            if self.code and ("(" in value or not nested or not any(c.isdigit() for c in value)):
                return
        elif value.startswith("#"):
            return
        elif not self.properties:
            value = re.split(r"\s+#|\s*-->|\s*\*/", value)[0]
        if value.endswith("\\") and self.properties:
            value = value[:-1]
        if "<" in value and not self.properties:
            value = value.split("<")[0]
        if self.code and comment and not (any(c.isdigit() for c in value) and len(value) >= 6):
            return
        if usable(value) or not self.code and chosen(m.group(1), value):
            keep(m.start(5), m.start(5) + len(value.rstrip()))

    def joined(self, k: int, row: str) -> None:
        """Literals joined over several lines: one value, where it begins."""
        first = _FIRST_LITERAL.search(row)
        if not first or k + 1 >= len(self.starts):
            return
        parts = [(self.starts[k] + first.start(1), self.starts[k] + first.end(1))]
        plus, at = first.group(2), k + 1
        while at < len(self.starts):
            following = self.line(at)
            m = _NEXT_LITERAL.match(following)
            if not m or not (plus or following.lstrip().startswith("+")):
                break
            parts.append((self.starts[at] + m.start(1), self.starts[at] + m.end(1)))
            plus, at = m.group(2), at + 1
        if len(parts) > 1 and _secretive("".join(self.text[a:b] for a, b in parts)):
            self.spans.add(parts[0])
            self.rest.update(parts[1:])

    def following(self, k: int, row: str) -> None:
        """Values announced on this line that begin on the next one."""
        if k + 1 >= len(self.starts):
            return
        following, base = self.line(k + 1), self.starts[k + 1]
        m = _ENV_NAME.match(row)
        if m and secret_name(m.group(1)) and (v := _ENV_VALUE.match(following)):
            group = next(g for g in (1, 2, 3) if v.group(g) is not None)
            if held(m.group(1), v.group(group)):
                self.spans.add((base + v.start(group), base + v.start(group) + len(v.group(group).rstrip())))
        m = _CONTINUED.match(row) if self.properties else None
        if m and secret_name(m.group(1)) and usable(m.group(2) + following.strip()):
            self.spans.add((self.starts[k] + m.start(2), self.starts[k] + m.end(2)))
            inner = len(following) - len(following.lstrip())
            self.rest.add((base + inner, base + len(following.rstrip("\\ "))))
        kept = row.rstrip()
        mark = _BLOCK_MARK.search(kept, max(0, len(kept) - 3))
        name = _name_before(kept, mark.start() if mark else len(kept))
        if name and secret_name(name):
            deeper = len(following) - len(following.lstrip()) > len(row) - len(row.lstrip())
            v = re.match(r"\s*\"([^\"]+)\"\s*[;,)]?\s*$", following) if self.code else re.match(r"\s+([^\s:]+)\s*$", following) if deeper else None
            if v and usable(v.group(1)):
                self.spans.add((base + v.start(1), base + v.end(1)))

    def armor(self, a: int, b: int) -> None:
        """The lines of a key's body behind its BEGIN line: up to its END line, or as long as they are lines of a body."""
        lines: list[tuple[int, int]] = []
        at, ended = b, False
        while True:
            at = _ARMOR_GAP.match(self.text, at).end()
            if self.text.startswith("-----END", at):
                ended = True
                break
            if m := _ARMOR_HEAD.match(self.text, at):
                at = m.end()
                continue
            m = _ARMOR_LINE.match(self.text, at)
            if not m:
                break
            lines.append(m.span())
            at = m.end()
        if not ended:  # a short word behind the last full line is no body
            while lines and lines[-1][1] - lines[-1][0] < 16 and not self.text[lines[-1][0] : lines[-1][1]].endswith("="):
                lines.pop()
        # nor is a plain word in a comment between the lines
        lines = [(x, y) for x, y in lines if y - x >= 16 or (y - x) % 4 == 0 or not (self.text[x:y].isalpha() and self.text[x:y].islower())]
        if not any(y - x >= 16 for x, y in lines):
            return
        self.spans.add((a, b))
        self.armored.append((a, b, lines[-1][1]))
        self.bodies.update(lines)

    def run(self, lines: list[int]) -> None:
        self.rest: set[tuple[int, int]] = set()
        self.armored: list[tuple[int, int, int]] = []
        self.bodies: set[tuple[int, int]] = set()
        for k in lines:
            self.read(k)

    def found(self) -> list[int]:
        """0-based lines on which values begin."""
        begins = sorted(self.armored)
        inside = [b for _, b, _ in begins]

        def body(a: int) -> bool:
            k = bisect.bisect_right(inside, a) - 1
            return k >= 0 and a < begins[k][2]

        return sorted({bisect.bisect_right(self.starts, a) - 1 for a, b in self.spans if not body(a) and (a, b) not in self.rest})

    def masked(self) -> str:
        """The text with a placeholder over each value; line ends and everything else stay."""
        spans = set(self.spans) | self.rest | self.bodies
        spans -= {(a, b) for a, b, _ in self.armored}
        out, at = [], 0
        for a, b in sorted(spans):
            if b <= at:
                continue
            out.append(self.text[at : max(a, at)])
            out.append("'*'" if self.text[a:b].lstrip().startswith("'") else PLACEHOLDER)
            at = b
        return "".join([*out, self.text[at:]])


def scan_texts(paths: list[str | None], texts: list[str | None]) -> list[_Text | None]:
    """For each text its findings, or None where the automaton finds nothing to read closely."""
    out: list[_Text | None] = [None] * len(texts)
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (size == 0 or size + len(texts[stop] or "") <= BATCH_CHARS):
            size += len(texts[stop] or "") + 1
            stop += 1
        which, ends, _ = automaton().scan([t or "" for t in texts[at:stop]])
        firsts = np.flatnonzero(np.diff(which, prepend=-1))
        for i, a in enumerate(firsts):
            b = firsts[i + 1] if i + 1 < len(firsts) else len(which)
            n = at + int(which[a])
            t = _Text(paths[n] or "", texts[n])
            lines = np.searchsorted(np.array(t.starts), ends[a:b] - 1, side="right") - 1
            hit = np.unique(lines)
            hit = np.unique(np.concatenate((hit, np.maximum(hit - 1, 0))))  # a join is hit on its second line
            t.run(hit.tolist())
            out[n] = t
        at = stop
    return out


def credential_lines(chunks: DataFrame) -> DataFrame:
    """``(id, line_no)``: each code_chunk row's lines on which a credential value begins, from 1.

    Null or empty contents give no rows; rows delivered twice give each place once; a null file_path
    is read as a configuration file's.
    """

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, nos = [], []
            for i, t in zip(frame["id"], scan_texts(list(frame["file_path"]), list(frame["content"]))):
                if t is not None:
                    for k in t.found():
                        ids.append(i)
                        nos.append(k + 1)
            yield pd.DataFrame({"id": ids, "line_no": nos})

    rows = chunks.where("id is not null and length(content) > 0").select("id", "file_path", "content")
    return rows.mapInPandas(find, "id long, line_no int").distinct()


def mask_credentials(chunks: DataFrame) -> DataFrame:
    """``(id, file_path, content, masked_values)``: contents with only the secret values masked.

    A row delivered twice (the same id, path and text) is given once, by its texts' hashes, so that only rows of
    ids delivered more than once travel. Null contents stay null, rows without an id are kept.
    """
    rows = chunks.select("id", "file_path", "content")
    twice = rows.groupBy("id").count().where("count > 1").select("id")
    # compared null-safe: rows without an id are deliveries of one unknown id
    again = F.col("id").eqNullSafe(F.col("twice_id"))
    other = counted_broadcast(twice.withColumnRenamed("id", "twice_id"))
    rows = rows.join(other, again, "left_anti").unionByName(rows.join(other, again, "left_semi").distinct())

    def mask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [t if isinstance(t, str) else None for t in frame["content"]]
            read = scan_texts(list(frame["file_path"]), texts)
            frame["masked_values"] = [len(t.found()) if t else 0 for t in read]
            frame["content"] = [t.masked() if t else x for t, x in zip(read, texts)]
            yield frame

    # ids travel as text: a null among them would turn the batch's numbers into floats
    rows = rows.withColumn("id", F.col("id").cast("string"))
    masked = rows.mapInPandas(mask, "id string, file_path string, content string, masked_values int")
    return masked.withColumn("id", F.col("id").cast("long"))
