"""Texts cut off by field limits or in transfer (problem 5).

Two passes over all texts. The first builds corpus statistics: a vocabulary trie for each source (as
a table: one row a node, with the number of words that end there and that lie below), how often a
pair of final tokens is followed by a stop, by the end of the text or by more words, and how often
open ends occur at each exact length. The second judges each value: a final token that is an unknown
proper prefix of known words, an open JSON object, a last line of code that is the beginning of a line
of the newer version, open brackets or elements, a pair of tokens that practically never ends a text,
each combined with the length evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewing.session import durable

#: A tail that ends texts in less than this share of its uses is not a place to stop.
STOP_SHARE = 0.08
#: The same at a length that is a limit.
LIMIT_SHARE = 0.5
#: A word this rare against the words that it begins does not count as known.
KNOWN_SHARE = 0.002
#: Uses of a predecessor that are needed to call what follows odd, and the share below which it is.
ODD_USES, ODD_SHARE = 200, 0.005
#: Uses of a tail that are needed to judge by it.
LEAST_USES = 4
#: Open ends at one exact length that make it a limit, and how many times the neighbours' average.
LIMIT_COUNT, LIMIT_TIMES, LIMIT_RADIUS = 5, 6, 20
#: Characters up to which the trie has a node for every beginning of a word; deeper ones are made where they are looked for.
DEEP = 80
#: Salts for joins of records with the statistics of their tails.
SALTS = 16

_TOKEN = re.compile(r"\n|[.:](?=\w)|[A-Z]\w*#\w*|[\u3400-\u9fff\u3040-\u30ff\uac00-\ud7af]|[^\W_]+(?:_[^\W_]+)*|[^\w\s]|_")
_WORD = re.compile(r"[^\W\d][\w]*")
#: Marks that close a sentence or a text.
_STOPS = frozenset(".!?。！？…：；;:)]}）】」』»”\"'`>*|~")
_CJK = re.compile(r"[\u3400-\u9fff\u3040-\u30ff\uac00-\ud7af]")


class _Shapes(dict):
    """Token to its class: numbers, mixed-case identifiers and references share one, so that tails are
    counted by their form."""

    def __missing__(self, token: str) -> str:
        if "#" in token:
            shape = "A#a"
        elif token[0].isdigit():
            shape = "0" if token.isdigit() else "0a"
        elif token == "\n":
            shape = "^"
        elif len(token) > 1 and re.search(r"[a-zß-ÿ][A-Z]", token):
            shape = "Aa"
        else:
            shape = token
        if len(self) < 200_000:
            self[token] = shape
        return shape


_SHAPES = _Shapes()


def _open_json(text: str) -> bool:
    """Whether the JSON that the text begins with or holds is still open at the end."""
    if "{" not in text and "[" not in text:
        return False
    m = re.search(r"[{\[]\s*[{\"\[]", text)
    if not m or (m.start() > 0 and text[m.start() - 1] not in " \n\t:=`>"):
        return False
    depth, quoted, i = 0, False, m.start()
    for t in re.finditer(r"\\.|[\"{}\[\]]", text[i:], re.S):
        c = t.group()
        if c == '"':
            quoted = not quoted
        elif not quoted and c in "{[":
            depth += 1
        elif not quoted and c in "}]" and depth:
            depth -= 1
    return quoted or depth > 0


def _last(pattern: re.Pattern, text: str, n: int) -> list[str]:
    """The last ``n`` matches, read from as far back as they reach; all of them if there are fewer."""
    size = 400
    while True:
        found = pattern.findall(text[-size:])
        if len(found) > n or size >= len(text):  # the one before the last n shows that they are whole
            return found[-n:]
        size *= 4


def _tail(text: str) -> tuple[str, str, str]:
    """``(final word, pair of shapes, word after its predecessor)`` of a text that ends without a stop."""
    tokens = _last(_TOKEN, text, 2)
    if not tokens:
        return "", "", ""
    before = _SHAPES[tokens[-2]] if len(tokens) > 1 else "^"
    last = tokens[-1]
    _, mark, word = last.rpartition("#")
    return word, f"{before} {_SHAPES[last]}", f"# {word}" if mark else f"{before} {word}"


#: What follows a token, by the next one; anything else means that more words follow.
_FOLLOWS = {**{c: "stop" for c in _STOPS}, "\n": "line"}


class _Counts:
    """Counters of one source: pairs of shapes with what follows them, and tokens."""

    def __init__(self):
        self.pairs: Counter = Counter()
        self.tokens: Counter = Counter()

    def prose(self, text: str) -> None:
        tokens = _TOKEN.findall(text.rstrip())
        if not tokens:
            return
        shapes = [_SHAPES[t] for t in tokens]
        follows = [_FOLLOWS.get(t, "more") for t in tokens[1:]]
        follows.append("stop" if tokens[-1] in _STOPS else "end")
        self.pairs.update(zip(["^", *shapes], shapes, follows))
        self.tokens.update(tokens[:-1])

    def code(self, text: str) -> None:
        body = text.rstrip()
        words = _WORD.findall(body)
        if words and body.endswith(words[-1]):
            words.pop()
        self.tokens.update(words)

    def rows(self, source: str) -> list[tuple[str, str, str, int]]:
        out = [(source, kind, f"{a} {b}", n) for (a, b, kind), n in self.pairs.items() if b != "^"]
        words: Counter = Counter()
        for token, n in self.tokens.items():
            owner, mark, last = token.rpartition("#")
            if last[:1].isalpha() or last[:1] == "_":
                words[last] += n
            if mark:
                words[owner] += n
                out.append((source, "more", f"# {last}", n))
        return out + [(source, "word", w, n) for w, n in words.items()]


def tail_statistics(texts: DataFrame) -> DataFrame:
    """``(source, kind, key, n)`` over ``(source, prose, text)``; counted map-side, then summed."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, _Counts] = {}

        def rows() -> pd.DataFrame:
            out = [r for s, c in totals.items() for r in c.rows(s)]
            totals.clear()
            return pd.DataFrame(out, columns=["source", "kind", "key", "n"])

        for frame in frames:
            for (source, prose), part in frame.groupby(["source", "prose"]):
                counts = totals.setdefault(source, _Counts())
                one = counts.prose if prose else counts.code
                for text in part["text"]:
                    one(text)
            if sum(len(c.pairs) + len(c.tokens) for c in totals.values()) > 300_000:
                yield rows()
        yield rows()

    return (
        texts.mapInPandas(count, "source string, kind string, key string, n long")
        .groupBy("source", "kind", "key")
        .agg(F.sum("n").alias("n"))
    )


def _trie(words: DataFrame, sought: DataFrame) -> DataFrame:
    """``(source, before, word, n)`` as nodes ``(source, node, ends, below)``: the weight of the words that end at a node,
    and of those that lie below it.

    Nodes stand for all beginnings up to ``DEEP`` characters. Deeper nodes, of which a single blob would have as many as
    characters, are made for the ``sought`` beginnings ``(source, node)`` alone.
    """
    n, size = F.col("n"), F.length("word")
    flat = words.select("source", "before", "word", "n", F.explode(F.sequence(F.lit(1), F.least(size, F.lit(DEEP)))).alias("k"))
    flat = flat.select(
        "source", F.expr("concat(before, substring(word, 1, k))").alias("node"),
        F.when(F.col("k") == size, n).otherwise(0).alias("ends"), F.when(F.col("k") == size, 0).otherwise(n).alias("below"),
    )
    head = F.concat("before", F.substring("word", 1, DEEP))
    long = words.where(size > DEEP).select("source", F.concat("before", "word").alias("whole"), head.alias("head"), "n")
    part = F.length(F.substring_index("node", " ", -1))
    asked = sought.where(part > DEEP).select("source", "node", F.substring("node", F.lit(1), F.length("node") - part + DEEP).alias("head"))
    met = asked.join(long, ["source", "head"]).where(F.startswith("whole", F.col("node")))
    ended = F.length("node") == F.length("whole")
    deep = met.select("source", "node", F.when(ended, n).otherwise(0).alias("ends"), F.when(ended, 0).otherwise(n).alias("below"))
    return flat.unionByName(deep).groupBy("source", "node").agg(F.sum("ends").alias("ends"), F.sum("below").alias("below"))


def vocabulary_trie(statistics: DataFrame, sought: DataFrame) -> DataFrame:
    """The trie of all words, and that of words after their predecessor (nodes ``'before word'``)."""
    words = statistics.where("kind = 'word' and n >= 2").select("source", F.lit("").alias("before"), F.col("key").alias("word"), "n")
    after = statistics.where("kind in ('stop', 'line', 'more')").select(
        "source",
        F.concat(F.substring_index("key", " ", 1), F.lit(" ")).alias("before"),
        F.substring_index("key", " ", -1).alias("word"),
        "n",
    ).where("length(word) > 1")
    return _trie(words.unionByName(after), sought)


def _bare(line: str) -> str:
    return re.sub(r"\d+", "0", line.strip())


_BRACES = re.compile(r"//[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[{}()]", re.S)


def _open_brackets(text: str) -> int:
    depth = 0
    for m in _BRACES.finditer(text):
        c = m.group()
        depth += (c in "{(") - (c in "})") if len(c) == 1 else 0
    return depth


def _code_end(path: str, base: str, content: str) -> str:
    """'whole', 'cut' or 'open' (only further evidence can tell) for an older version of a code piece."""
    name = path.lower()
    lines = [line for line in re.split(r"\r?\n", base)]
    last = _bare(lines[-1]) or next((_bare(x) for x in reversed(lines) if x.strip()), "")
    newer = [_bare(x) for x in re.split(r"\r?\n", content)]
    end = next((x for x in reversed(newer) if x), "")
    partial_blank = bool(lines[-1]) and not lines[-1].strip()  # ends within an indentation
    braced = name.endswith((".java", ".js", ".css", ".ts", ".kt"))
    if last == end and not partial_blank:
        return "whole"
    if braced and _open_brackets(base) > max(0, _open_brackets(content)):
        return "cut"
    if last == end:
        return "whole"
    if last and last not in newer and any(len(x) > len(last) and x.startswith(last) for x in newer):
        return "cut"
    stripped = base.rstrip()
    if braced and content.strip():
        return "whole" if stripped.endswith(("}", ";")) else "open"
    if name.endswith((".xml", ".html", ".jsp", ".ftl", ".xhtml", ".svg")):
        closing = re.search(r"</[\w:.\-]+\s*>\s*$", content)
        if closing and not stripped.endswith(re.sub(r"\s", "", closing.group())):
            return "cut" if stripped.count("<") - stripped.count(">") or not stripped.endswith(">") else "open"
        return "whole" if stripped.endswith(">") else "open"
    if name.endswith(".sql"):
        return "whole" if stripped.endswith(";") else "cut" if content.rstrip().endswith(";") else "open"
    return "open"


_JUDGED = (
    "source_table string, record_id long, kind string, length int, state string, token string, pair string, after string"
)


def _records(events: DataFrame, chunks: DataFrame) -> DataFrame:
    """All non-blank values: ``(source_table, record_id, kind, prose, text, path, newer)``."""
    none = F.lit(None).cast("string")
    a = events.select(
        F.lit("agent_event").alias("source_table"), F.col("event_id").cast("long").alias("record_id"),
        F.col("agent_type").alias("kind"), F.col("message").alias("text"), none.alias("path"), none.alias("newer"),
    )
    b = chunks.select(
        F.lit("code_chunk").alias("source_table"), F.col("id").cast("long").alias("record_id"),
        F.col("chunk_type").alias("kind"), F.col("base_content").alias("text"), F.col("file_path").alias("path"),
        # a base that ends as the newer text does is whole (see _code_end): equal ones need not go to Python
        F.col("content").alias("newer"),
    ).where(F.col("newer").isNull() | (F.rtrim("text") != F.rtrim("newer")))
    return a.unionByName(b).where(F.col("record_id").isNotNull() & F.col("text").rlike(r"\S"))


def judge_ends(records: DataFrame) -> DataFrame:
    """First judgement of each value, by the value alone: state 'whole', 'cut' or 'open'; one row for
    each that is not whole."""

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                text = r.text
                body = text.rstrip()
                state, token, pair, after = "open", "", "", ""
                if r.source_table == "code_chunk":
                    state = _code_end(r.path or "", text, r.newer or "")
                    words = _last(_WORD, body, 1)
                    token = words[-1] if words and body.endswith(words[-1]) else ""
                elif body.endswith("\ufffd"):
                    state = "cut"
                elif _open_json(body):
                    state = "cut"
                elif body[-1:] in _STOPS or body.endswith("---"):
                    state = "whole"
                else:
                    token, pair, after = _tail(body)
                    if not token[:1].isalpha() or _CJK.match(token):
                        token = after = ""
                if state != "whole":
                    rows.append((r.source_table, r.record_id, r.kind, len(text), state, token, pair, after))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _JUDGED.split(", ")])

    return records.mapInPandas(judge, _JUDGED)


def length_limits(ends: DataFrame) -> DataFrame:
    """``(source_table, kind, length)`` at which cut values pile up against the lengths around."""
    per = ends.groupBy("source_table", "kind", "length").agg(F.count("*").alias("n"))
    near = Window.partitionBy("source_table", "kind").orderBy("length").rangeBetween(-LIMIT_RADIUS, LIMIT_RADIUS)
    around = (F.sum("n").over(near) - F.col("n")) / (2 * LIMIT_RADIUS)
    return (
        per.withColumn("around", around)
        .where((F.col("n") >= LIMIT_COUNT) & (F.col("n") >= LIMIT_TIMES * F.col("around")))
        .select("source_table", "kind", "length")
    )


def cut_values(events: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(source_table, record_id)`` of every value that was cut off.

    Null and blank values are no cases; a record delivered twice is given once; rows without an id are
    left out. Vocabulary and tail statistics cover all values.
    """
    records = _records(events, chunks)
    words = events.select(F.lit("agent_event").alias("source"), F.lit(True).alias("prose"), F.col("message").alias("text")).unionByName(
        chunks.select(F.lit("code_chunk").alias("source"), F.lit(False).alias("prose"), F.col("base_content").alias("text"))
    )
    # each pass over the texts is made once: its small result goes to the checkpoint folder
    statistics = durable(tail_statistics(words.where(F.length("text") > 0)))
    ends = durable(judge_ends(records).dropDuplicates(["source_table", "record_id"]))
    open_ends = ends.where("state = 'open'").select("*", F.abs(F.hash("record_id") % SALTS).alias("salt"))

    def salted(df: DataFrame) -> DataFrame:
        return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    # only the tails that occur are looked up; a frequent tail is spread over the salts
    sought = open_ends.select("source_table", F.explode(F.array_distinct(F.array("token", "after"))).alias("node")).where("node <> ''").distinct()
    trie = vocabulary_trie(statistics, sought.withColumnRenamed("source_table", "source")).withColumnRenamed("source", "source_table")
    nodes = durable(trie.join(sought, ["source_table", "node"], "left_semi"))
    pairs = (
        statistics.where("kind <> 'word'")
        .join(open_ends.where("pair <> ''").select(F.col("pair").alias("key")).distinct(), "key", "left_semi")
        .groupBy(F.col("key").alias("pair"))
        .agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in ("stop", "line", "end", "more")])
    )
    seen = open_ends
    for column in ("token", "after"):
        named = nodes.select(
            "source_table", F.col("node").alias(column), F.col("ends").alias(column + "_ends"), F.col("below").alias(column + "_below")
        )
        seen = seen.join(salted(named), ["source_table", column, "salt"], "left")
    seen = seen.join(salted(pairs), ["pair", "salt"], "left").withColumn("before", F.substring_index("pair", " ", 1))
    befores = (
        statistics.where("kind <> 'word'")
        .groupBy(F.substring_index("key", " ", 1).alias("before"))
        .agg(F.sum("n").alias("after_before"))
        .join(seen.where("pair <> ''").select("before").distinct(), "before", "left_semi")
    )
    seen = seen.join(salted(befores), ["before", "salt"], "left")

    def rare(column: str) -> Column:
        ends, below = F.coalesce(column + "_ends", F.lit(0)), F.coalesce(column + "_below", F.lit(0))
        return (F.col(column) != "") & (below > 0) & (ends <= below * KNOWN_SHARE)

    unknown = F.when(F.col("source_table") == "code_chunk", F.coalesce("token_ends", F.lit(0)) == 0).otherwise(True) & rare("token")
    prefix = unknown | (rare("after") & (F.col("after_below") >= LEAST_USES))
    share = (F.col("stop") + F.col("line") + F.col("end")) / (F.col("stop") + F.col("line") + F.col("end") + F.col("more"))
    goes_on = F.coalesce((F.col("more") >= LEAST_USES) & (share < STOP_SHARE), F.lit(False))
    # a word that practically never stands behind its predecessor: the beginning of one that does
    worded = (F.col("token") != "") & F.col("before").rlike(r"^\p{L}{2,}$")
    odd = worded & (F.col("after_before") >= ODD_USES) & (F.col("stop") + F.col("line") + F.col("end") + F.col("more") <= ODD_SHARE * F.col("after_before"))
    sure_end = prefix | goes_on | F.coalesce(odd, F.lit(False))
    judged = durable(seen.select("source_table", "record_id", "kind", "length", sure_end.alias("sure"), "more", share.alias("share")))
    sure = ends.where("state = 'cut'").select("source_table", "record_id", "kind", "length").unionByName(
        judged.where("sure").select("source_table", "record_id", "kind", "length")
    )
    # an end that may go on, at a length at which the sure cuts of its source pile up
    weak = F.when(F.col("source_table") == "code_chunk", True).otherwise((F.col("more") >= LEAST_USES) & (F.col("share") < LIMIT_SHARE))
    limited = judged.where(~F.col("sure") & weak).join(length_limits(sure), ["source_table", "kind", "length"], "left_semi")
    return sure.select("source_table", "record_id").unionByName(limited.select("source_table", "record_id")).distinct()


def cut_shares(events: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(source_table, kind, records, cut_records, share)`` for each agent_type and chunk_type.

    Counts distinct record ids with a non-blank value; a null kind is a group of its own.
    """
    none_blank = F.col("text").rlike(r"\S")
    a = events.select(F.lit("agent_event").alias("source_table"), F.col("event_id").cast("long").alias("record_id"), F.col("agent_type").alias("kind"), F.col("message").alias("text"))
    b = chunks.select(F.lit("code_chunk").alias("source_table"), F.col("id").cast("long").alias("record_id"), F.col("chunk_type").alias("kind"), F.col("base_content").alias("text"))
    ids = a.unionByName(b).where(none_blank & F.col("record_id").isNotNull()).select("source_table", "record_id", "kind").dropDuplicates(["source_table", "record_id"])
    flagged = ids.join(cut_values(events, chunks).withColumn("is_cut", F.lit(1)), ["source_table", "record_id"], "left")
    return (
        flagged.groupBy("source_table", "kind")
        .agg(F.count("*").alias("records"), F.count("is_cut").alias("cut_records"))
        .withColumn("share", F.round(F.col("cut_records") / F.col("records"), 6))
    )
