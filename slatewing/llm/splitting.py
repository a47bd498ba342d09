"""Splitting oversized items at natural boundaries (problem 4).

Boundaries are lines. Dynamic programming over boundary positions minimises the sum of cut penalties
(a unit begins: none; after a blank line: small; anywhere else: large) and of size imbalance,
subject to both limits and to the overlap: each piece begins with the last ``overlap_lines`` lines of
the piece before. Where these leave no room for the next lines, that one cut repeats as many whole lines as fit, and the
program pays for each line it leaves out. A line that alone exceeds the character limit is cut by
characters, with ``overlap_chars`` of them repeated.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewing.llm.units import line_starts, unit_lines

MAX_CHARS, MAX_LINES, OVERLAP_LINES, OVERLAP_CHARS = 12_000, 160, 8, 200
#: Cut penalties by kind of boundary, for each line that is not repeated though it stands before the cut, and the weight
#: of a piece's squared unused share.
UNIT_CUT, BLANK_CUT, LINE_CUT, SHORT_OVERLAP, IMBALANCE = 0.0, 2.0, 10.0, 100.0, 1.0
#: Where units and blank lines lie further apart than this, every line between is a boundary too.
SPARSE_LINES = 24


class Piece(NamedTuple):
    start: int  # 0-based first line
    end: int  # 0-based last line
    begin: int  # offset of the text
    stop: int
    repeated: int  # characters at the start that repeat the piece before


def oversized(text: str, max_chars: int = MAX_CHARS, max_lines: int = MAX_LINES) -> bool:
    return len(text) > max_chars or len(line_starts(text)) > max_lines


def _boundaries(units: set[int], blank: list[bool], first: int, last: int, chars: list[int], room: int) -> list[int]:
    """Positions in (first, last) where a cut is considered; chars are cumulated."""
    out: list[int] = []
    at = first
    marks = [i for i in range(first + 1, last) if i in units or blank[i - 1]]
    for mark in [*marks, last]:
        if mark - at > SPARSE_LINES or chars[mark] - chars[at] > room:
            out.extend(range(at + 1, mark))
        if mark < last:
            out.append(mark)
        at = mark
    return out


def split_text(
    text: str,
    units: list[int],
    max_chars: int = MAX_CHARS,
    max_lines: int = MAX_LINES,
    overlap_lines: int = OVERLAP_LINES,
    overlap_chars: int = OVERLAP_CHARS,
) -> list[Piece]:
    """Pieces within both limits; their texts without the repeated part concatenate to ``text``."""
    starts = line_starts(text)
    n = len(starts)
    offsets = [*starts, len(text)]
    if len(text) <= max_chars and n <= max_lines:
        return [Piece(0, n - 1, 0, len(text), 0)]
    blank = [not text[offsets[i] : offsets[i + 1]].strip() for i in range(n)]
    where = set(units)
    long = [i for i in range(n) if offsets[i + 1] - offsets[i] > max_chars]
    pieces: list[Piece] = []

    def repeats(first: int, begin: int, end: int, most: int) -> int:
        """Lines from ``first`` on that a piece of the lines ``begin`` to ``end`` can repeat within the limits, at most ``most``."""
        fits = bisect.bisect_left(offsets, offsets[end] - max_chars)
        return max(0, min(most, overlap_lines, max_lines - (end - begin), begin - max(first, fits)))

    def run(first: int, last: int) -> None:
        """Pieces of the lines from ``first`` to before ``last``, none of which exceeds the limit alone."""
        if first >= last:
            return
        cuts = [first, *_boundaries(where, blank, first, last, offsets, max_chars // 4), last]
        best = [0.0] + [float("inf")] * (len(cuts) - 1)
        back = [0] * len(cuts)
        behind_long = first > 0  # characters of the line before are repeated
        low = 0
        for j in range(1, len(cuts)):
            c = cuts[j]
            cut = UNIT_CUT if c == last or c in where else BLANK_CUT if blank[c - 1] else LINE_CUT
            while c - cuts[low] > max_lines or offsets[c] - offsets[cuts[low]] > max_chars:
                low += 1
            for i in range(low, j):
                a = cuts[i]
                lines = c - a
                if i == 0 and behind_long:
                    if lines + 1 > max_lines:
                        continue
                    lines, chars, short = lines + 1, min(max_chars, offsets[c] - offsets[a] + overlap_chars), 0
                else:
                    k = repeats(first, a, c, overlap_lines)
                    lines, chars, short = lines + k, offsets[c] - offsets[a - k], min(overlap_lines, a - first) - k
                unused = 1 - max(lines / max_lines, chars / max_chars)
                cost = best[i] + cut + SHORT_OVERLAP * short + IMBALANCE * unused * unused
                if cost < best[j]:
                    best[j], back[j] = cost, i
        chain, j = [], len(cuts) - 1
        while j > 0:
            chain.append((back[j], j))
            j = back[j]
        for i, j in reversed(chain):
            a, c = cuts[i], cuts[j]
            if i == 0 and behind_long:
                extra = min(overlap_chars, offsets[a] - offsets[a - 1], max_chars - (offsets[c] - offsets[a]))
                pieces.append(Piece(a - (extra > 0), c - 1, offsets[a] - extra, offsets[c], extra))
            else:
                k = repeats(max(first, pieces[-1].start if pieces else first), a, c, overlap_lines)
                pieces.append(Piece(a - k, c - 1, offsets[a - k], offsets[c], offsets[a] - offsets[a - k]))

    def run_long(line: int, first: int) -> None:
        """Pieces of one line above the limit, cut by characters; the first repeats lines from ``first`` on where they fit."""
        begin, stop = offsets[line], offsets[line + 1]
        head = line
        while head > first and line - head < min(overlap_lines, max_lines - 1) and begin - offsets[head - 1] < max_chars - overlap_chars:
            head -= 1
        lead = begin - offsets[head]
        if line > 0 and not lead:  # behind another long line, or one that does not fit
            lead = min(overlap_chars, begin - offsets[line - 1])
        room = max_chars - overlap_chars
        own = max_chars - lead  # what the first piece can hold of the line
        count = 1 + -(-max(0, stop - begin - own) // room)
        size = stop - begin
        a, b = begin, begin + max(min(own, -(-size // count)), size - (count - 1) * room)
        for k in range(count):
            repeated = lead if k == 0 else overlap_chars
            at = a - repeated
            pieces.append(Piece(bisect.bisect_right(starts, at) - 1, line, at, b, repeated))
            a = b
            b = min(stop, a + (-(-(stop - a) // max(1, count - k - 1))))

    at = 0
    for line in long:
        run(at, line)
        run_long(line, max(at, pieces[-1].start if pieces else at))
        at = line + 1
    run(at, n)
    return pieces


_PIECES = (
    "id long, task_id string, file_path string, piece_no int, start_line int, end_line int, content string, "
    "repeated_chars int, first_line_no int, unit_line_nos array<int>"
)


def split_chunks(
    chunks: DataFrame, max_chars: int = MAX_CHARS, max_lines: int = MAX_LINES,
    overlap_lines: int = OVERLAP_LINES, overlap_chars: int = OVERLAP_CHARS, texts: bool = True,
) -> DataFrame:
    """Pieces of every code_chunk row that exceeds a limit, one row a piece.

    ``start_line``/``end_line`` count in the file (the row's start_line plus the place in content; the
    row's end_line may be stale and is not used; a null start_line counts as 1). ``first_line_no`` is
    the piece's first line within the row and ``unit_line_nos`` are the lines within the row at which
    units begin in the part that the piece adds. Null or short contents and null ids give no rows; a row delivered
    twice is split once for each delivery (callers that need one drop duplicates on (id, piece_no)).
    """
    big = chunks.where(F.col("id").isNotNull()).where(
        (F.length("content") > max_chars)
        | (F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) >= max_lines)
    ).select("id", "task_id", "file_path", "chunk_type", "start_line", "content")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                text = r.content
                if not oversized(text, max_chars, max_lines):
                    continue
                units = unit_lines(r.file_path, r.chunk_type, text)
                base = 1 if pd.isna(r.start_line) else int(r.start_line)
                seen = 0
                for k, p in enumerate(split_text(text, units, max_chars, max_lines, overlap_lines, overlap_chars)):
                    mine = [u + 1 for u in units if seen <= u <= p.end]
                    seen = p.end + 1
                    rows.append((
                        r.id, r.task_id, r.file_path, k, base + p.start, base + p.end,
                        text[p.begin : p.stop] if texts else None, p.repeated, p.start + 1, mine,
                    ))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PIECES.split(", ")])

    return big.mapInPandas(cut, _PIECES)


def unit_starts(chunks: DataFrame) -> DataFrame:
    """``(id, line_no)``: line 1 and every unit's first line of the rows that :func:`split_chunks` splits."""
    pieces = split_chunks(chunks, texts=False)
    first = F.when(F.col("piece_no") == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return pieces.select("id", F.explode(F.array_union(first, "unit_line_nos")).alias("line_no")).distinct()
