"""Evaluation texts inside training texts (problem 7), by an FM-index for each shard of the corpus.

A shard holds the word sequences of some documents. Its suffix array gives the Burrows-Wheeler
transform, a wavelet matrix over that answers rank queries, and backward search finds all windows of
``min_words`` words of all evaluation items at once. Occurrences are located by stepping to sampled
suffix positions; those of one item in one document are merged into spans.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 12
#: Words in a shard's index; every this many suffix positions one is kept.
SHARD_WORDS, SAMPLE_EVERY = 400_000, 32
#: Items are searched in blocks of at most so many characters (what one task holds of them).
BLOCK_CHARS = 8_000_000

#: Element names whose tags count as markup.
_TAGS = (
    "a", "abbr", "article", "aside", "b", "big", "blockquote", "body", "br", "caption", "center", "cite", "code", "col", "dd",
    "del", "details", "div", "dl", "dt", "em", "figure", "font", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "header", "hr", "html", "i", "img", "input", "ins", "kbd", "label", "li", "link", "main", "mark", "meta", "nav", "ol",
    "option", "p", "pre", "q", "s", "samp", "script", "section", "select", "small", "span", "strike", "strong", "style", "sub",
    "summary", "sup", "table", "tbody", "td", "textarea", "tfoot", "th", "thead", "title", "tr", "tt", "u", "ul", "var", "wbr",
)
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufe00-\ufe0f\ufeff]")
_TAG = re.compile(rf"</?(?:{'|'.join(_TAGS)})(?:\s[^<>]*)?/?>|<!--|-->|<!\[CDATA\[|\]\]>", re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_ESCAPED = re.compile(r"\\u\{?([0-9a-fA-F]{4})\}?|\\x([0-9a-fA-F]{2})|\\+[nrtbfv0]|\\+")
_WORD = re.compile(r"[^\W_]+")


def _unescape(m: re.Match) -> str:
    code = m.group(1) or m.group(2)
    if not code:
        return " "
    char = chr(int(code, 16))
    return char if not 0xD800 <= int(code, 16) < 0xE000 else " "


def words_of(text: str) -> list[str]:
    """The words that count: markup, entities, escapes and invisible characters undone, lower case."""
    if "\\" in text:
        text = _ESCAPED.sub(_unescape, text)
    if "&" in text:
        for _ in range(2):  # entities may be escaped once more
            text = _ENTITY.sub(lambda m: html.unescape(m.group()), text)
    if "<" in text or "-->" in text or "]]>" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    return _WORD.findall(text.lower())


def _traced(pattern: re.Pattern, put: Callable[[re.Match], str], text: str, begin: np.ndarray, end: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """``pattern.sub(put, text)``, with where in the original each character begins and ends."""
    parts, begins, ends, at = [], [], [], 0
    for m in pattern.finditer(text):
        made = put(m)
        parts += [text[at : m.start()], made]
        begins += [begin[at : m.start()], np.full(len(made), begin[m.start()] if m.end() > m.start() else 0)]
        ends += [end[at : m.start()], np.full(len(made), end[m.end() - 1] if m.end() > m.start() else 0)]
        at = m.end()
    return "".join([*parts, text[at:]]), np.concatenate([*begins, begin[at:]]), np.concatenate([*ends, end[at:]])


def word_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where in the text each word of :func:`words_of` begins and ends."""
    begin, end = np.arange(len(text)), np.arange(1, len(text) + 1)
    if "\\" in text:
        text, begin, end = _traced(_ESCAPED, _unescape, text, begin, end)
    if "&" in text:
        for _ in range(2):
            text, begin, end = _traced(_ENTITY, lambda m: html.unescape(m.group()), text, begin, end)
    if "<" in text or "-->" in text or "]]>" in text:
        text, begin, end = _traced(_TAG, lambda m: " ", text, begin, end)
    if not text.isascii():
        text, begin, end = _traced(_INVISIBLE, lambda m: "", text, begin, end)
    low = text.lower()
    if len(low) != len(text):  # a few capitals have two small letters
        sizes = [len(c.lower()) for c in text]
        low, begin, end = "".join(map(str.lower, text)), np.repeat(begin, sizes), np.repeat(end, sizes)
    spans = [m.span() for m in _WORD.finditer(low)]
    return np.array([begin[a] for a, _ in spans], np.int64), np.array([end[b - 1] for _, b in spans], np.int64)


class FmIndex:
    """FM-index of a sequence of symbols 0..top, where 0 separates and never matches."""

    def __init__(self, sequence: np.ndarray, top: int, sample: int = SAMPLE_EVERY):
        n = len(sequence)
        # separators differ from each other, in text order: equal runs end at them
        zero = sequence == 0
        rank = np.where(zero, np.cumsum(zero) - 1, sequence.astype(np.int64) + int(zero.sum()))
        order = np.argsort(rank, kind="stable")
        width = 1
        while True:
            sorted_rank = rank[order]
            fresh = np.empty(n, np.int64)
            fresh[order] = np.concatenate(([0], np.cumsum(sorted_rank[1:] != sorted_rank[:-1])))
            rank = fresh
            if n == 0 or rank[order[-1]] == n - 1:
                break
            behind = np.full(n, -1, np.int64)
            behind[: n - width] = rank[width:]
            key = rank * (n + 1) + behind + 1
            order = np.argsort(key, kind="stable")
            rank = key
            width *= 2
        self.n, self.top = n, top
        bwt = sequence[order - 1]  # the symbol before the first is the last, a separator
        counts = np.bincount(sequence, minlength=top + 2)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        keep = (order % sample == 0) | (bwt == 0)
        self.kept = keep
        self.kept_before = np.concatenate(([0], np.cumsum(keep, dtype=np.int32)))
        self.positions = order[keep]
        # wavelet matrix, most significant bit first
        self.levels = max(1, int(top).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        current = bwt.astype(np.int32)
        for level in range(self.levels - 1, -1, -1):
            bits = (current >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bits, dtype=np.int32))))
            self.zeros.append(int(n - self.ones[-1][-1]))
            current = np.concatenate((current[bits == 0], current[bits == 1]))
        self.bwt = bwt

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the first ``end`` places of the transform."""
        begin, end = np.zeros_like(ends), ends.copy()
        for k in range(self.levels):
            bit = (symbols >> (self.levels - 1 - k)) & 1 == 1
            one_b, one_e = self.ones[k][begin], self.ones[k][end]
            begin = np.where(bit, self.zeros[k] + one_b, begin - one_b)
            end = np.where(bit, self.zeros[k] + one_e, end - one_e)
        return end - begin

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(pattern number, low, high)`` of the patterns (rows) that occur."""
        alive = np.arange(len(patterns))
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbols = patterns[alive, column]
            base = self.first[symbols]
            low, high = base + self.rank(symbols, low), base + self.rank(symbols, high)
            keep = low < high
            alive, low, high = alive[keep], low[keep], high[keep]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix array, by stepping back to sampled ones."""
        found = np.zeros(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            here = self.kept[at]
            found[todo[here]] = self.positions[self.kept_before[at[here]]] + steps
            todo, at = todo[~here], at[~here]
            symbols = self.bwt[at]
            at = self.first[symbols] + self.rank(symbols, at)
            steps += 1
        return found


class _Query:
    """The windows of a block of items over the items' own vocabulary."""

    def __init__(self, items: Iterable[tuple[int, str]], min_words: int):
        self.ids: dict[str, int] = {}
        windows: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            symbols = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            for k in range(len(symbols) - min_words + 1):
                windows.setdefault(tuple(symbols[k : k + min_words]), set()).add(item)
        self.patterns = np.array(list(windows), np.int64).reshape(-1, min_words)
        self.owners = [sorted(v) for v in windows.values()]
        self.min_words = min_words

    def shard(self, docs: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple[int, int, list[tuple[int, int]]]]:
        """Search one shard; docs: ``(doc_id, symbols, word numbers)``."""
        if not docs or not len(self.patterns):
            return []
        sequence = np.concatenate([np.append(s, 0) for _, s, _ in docs])
        begins = np.cumsum([0] + [len(s) + 1 for _, s, _ in docs])
        index = FmIndex(sequence, len(self.ids))
        pattern, low, high = index.search(self.patterns)
        if not len(pattern):
            return []
        sizes = high - low
        rows = np.repeat(low - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        where = index.locate(rows)
        which = np.repeat(pattern, sizes)
        hits: dict[tuple[int, int], list[int]] = {}
        for p, at, doc in zip(which, where, np.searchsorted(begins, where, side="right") - 1):
            for item in self.owners[p]:
                hits.setdefault((doc, item), []).append(int(docs[doc][2][at - begins[doc]]))
        out = []
        for (doc, item), places in hits.items():
            spans: list[tuple[int, int]] = []
            for at in sorted(set(places)):
                if spans and at <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(spans[-1][1], at + self.min_words))
                else:
                    spans.append((at, at + self.min_words))
            out.append((docs[doc][0], item, spans))
        return out

    def symbols(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of a document, runs of foreign words as one separator, runs too short to hold a
        window left out; and each symbol's word number."""
        ids = self.ids
        raw = np.array([ids.get(w, 0) for w in words_of(text)], np.int64)
        if not len(raw):
            return raw, raw
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (raw > 0).astype(np.int8), [0]))))
        starts, stops = edges[::2], edges[1::2]
        long = stops - starts >= self.min_words
        if not long.any():
            return raw[:0], raw[:0]
        numbers = np.concatenate([np.append(np.arange(a, b), b) for a, b in zip(starts[long], stops[long])])
        padded = np.append(raw, 0)
        return padded[numbers], numbers


def leaked_items(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, item_id, spans array<struct<first_word,end_word>>, places array<struct<begin,end>>, words)`` of the documents
    that hold at least ``min_words`` consecutive words of an item. ``places`` are the spans as offsets of characters in the
    document's text, from 0, so that they can be cut out of it.

    Items are the query set: they are sent to the tasks in blocks of bounded size, each block against
    all documents. Null or blank texts, and items with fewer words than the minimum, give no rows. A
    document or item delivered twice gives the same rows once.
    """
    rows = items.where("item_id is not null and length(text) > 0").select("item_id", "text").distinct()
    blocks: list[list[tuple[int, str]]] = [[]]
    size = 0
    for r in rows.toLocalIterator():
        if blocks[-1] and size + len(r.text) > BLOCK_CHARS:
            blocks.append([])
            size = 0
        blocks[-1].append((r.item_id, r.text))
        size += len(r.text)
    texts = documents.where("doc_id is not null and length(text) > 0").select("doc_id", "text")
    schema = "doc_id long, item_id long, spans array<struct<first_word:int,end_word:int>>, places array<struct<begin:int,end:int>>"

    def searcher(block: list[tuple[int, str]]):
        def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            query = _Query(block, min_words)
            docs: list[tuple[int, np.ndarray, np.ndarray]] = []
            kept: dict[int, tuple[int, str]] = {}  # only texts that may hold a passage
            held = 0

            def flush() -> pd.DataFrame:
                rows = []
                for n, item, spans in query.shard(docs):
                    doc, text = kept[n]
                    begin, end = word_places(text)
                    places = [{"begin": int(begin[a]), "end": int(end[b - 1])} for a, b in spans]
                    rows.append((doc, item, [{"first_word": a, "end_word": b} for a, b in spans], places))
                docs.clear()
                kept.clear()
                return pd.DataFrame(rows, columns=["doc_id", "item_id", "spans", "places"])

            for frame in frames:
                for doc, text in zip(frame["doc_id"], frame["text"]):
                    symbols, numbers = query.symbols(text)
                    if len(symbols):
                        docs.append((len(docs), symbols, numbers))
                        kept[len(docs) - 1] = (doc, text)
                        held += len(symbols) + 1
                    if held >= SHARD_WORDS:
                        yield flush()
                        held = 0
            yield flush()

        return search

    found = None
    for block in blocks:
        part = texts.mapInPandas(searcher(block), schema)
        found = part if found is None else found.unionByName(part)
    words = F.aggregate("spans", F.lit(0), lambda a, s: a + s["end_word"] - s["first_word"])
    return found.dropDuplicates(["doc_id", "item_id"]).withColumn("words", words)
