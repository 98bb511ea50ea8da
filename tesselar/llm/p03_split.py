"""Problem 3: cutting oversized texts at natural boundaries, with overlap.

Lexical-cohesion segmentation. The text's sentences (and headings, paragraphs)
are its units. At each border of two units the word vectors of the blocks before
and after it are compared; a border much less similar than the hills on its two
sides is a deep valley, a likely change of topic. Within the range that the size
limit leaves for a piece, the deepest valley is cut, ends of sections and
paragraphs counting as deeper. Where a range has no sentence end (a table, a
sentence over the limit), the last line end or clause end in it is cut, and
without one the cut falls at the limit. Each next piece starts with the
last ``overlap`` tokens of the piece before.

Tokens are what white space parts. Sizes in the table are not trusted. Defined
results: null, empty and blank texts and texts within the limit give no pieces
(they need no cut); a text without any boundary is cut at the limit; repeated
rows are kept once a key and text; extra columns are ignored. Every token of the
text is in a piece, and pieces are exact substrings of the text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\S+")
SENTENCE_END = re.compile(r"[.!?…;]+[\"'”’»)\]]*$")
#: Words with a full stop that end no sentence (fixed values).
ABBREVIATIONS = frozenset(["art.", "no.", "nos.", "cf.", "i.e.", "e.g.", "etc.", "al.", "fig.", "sec.", "dr.", "prof.", "mr.", "mrs.", "ms.", "vs.", "p.", "pp.", "vol.", "nr.", "abs.", "z.b.", "bzw.", "ca.", "st."])
HEADING = re.compile(r"^\s*(?:#{1,6}\s|(?:\d+(?:\.\d+)*\.?|[IVX]+\.)\s+\S|=+\s)")


def borders(text: str, tokens: list[tuple[int, int]]) -> dict[int, int]:
    """{index of the token before which a unit starts: rank of the border}: 2 sentence, 3 paragraph, 4 section."""
    out = {}
    for i in range(1, len(tokens)):
        gap = text[tokens[i - 1][1] : tokens[i][0]]
        if "\n" in gap:
            stop = text.find("\n", tokens[i][0])
            line = text[tokens[i][0] : stop if stop >= 0 else len(text)]
            short = not SENTENCE_END.search(line.rstrip())
            if HEADING.match(line) and short or short and line[:1].isupper() and line.istitle():
                out[i] = 4
            elif gap.count("\n") > 1:
                out[i] = 3
            elif SENTENCE_END.search(text[tokens[i - 1][0] : tokens[i - 1][1]]):
                out[i] = 3
            continue
        last = text[tokens[i - 1][0] : tokens[i - 1][1]]
        if SENTENCE_END.search(last) and last.lower() not in ABBREVIATIONS and not last.endswith(";"):
            head = text[tokens[i][0]]
            if head.isupper() or head.isdigit() and not last[:-1].lower() in ("art", "no") or not head.isalnum() or head.isalpha() and not head.islower():
                out[i] = 2
    return out


def weak_border(text: str, tokens: list[tuple[int, int]], few: int, most: int) -> int | None:
    """The last token from ``few`` to ``most`` that starts a line, else one that follows a clause."""
    clause = None
    for i in range(most, few - 1, -1):
        if "\n" in text[tokens[i - 1][1] : tokens[i][0]]:
            return i
        if clause is None and text[tokens[i - 1][1] - 1] in ";:,":
            clause = i
    return clause


def cosine(a: Counter, b: Counter) -> float:
    if len(a) > len(b):
        a, b = b, a
    dot = sum(n * b[w] for w, n in a.items() if w in b)
    return dot / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values())) if dot else 0.0


def valleys(units: list[Counter], block: int) -> list[float]:
    """Depth of the similarity valley before each unit but the first (index 0 is unused)."""
    n = len(units)
    similar = [1.0] * n
    left = Counter()
    right = Counter()
    for u in units[1 : 1 + block]:
        right.update(u)
    left.update(units[0]) if n else None
    for i in range(1, n):
        similar[i] = cosine(left, right)
        left.update(units[i])
        if i - block >= 0:
            left.subtract(units[i - block])
            left = +left
        right.subtract(units[i])
        right = +right
        if i + block < n:
            right.update(units[i + block])
    depth = [0.0] * n
    hill = similar[:]
    for i in range(2, n):  # nearest hill to the left: climb while it rises
        hill[i] = hill[i - 1] if similar[i - 1] >= similar[i] and hill[i - 1] >= similar[i - 1] else similar[i]
    back = similar[:]
    for i in range(n - 2, 0, -1):
        back[i] = back[i + 1] if similar[i + 1] >= similar[i] and back[i + 1] >= similar[i + 1] else similar[i]
    for i in range(1, n):
        depth[i] = (hill[i] - similar[i]) + (back[i] - similar[i])
    return depth


def pieces(text: str, limit: int = 400, overlap: int = 40, block: int = 6, least: float = 0.4) -> list[tuple[int, int, int, int]]:
    """(start, end, tokens, rank of the border at the end) of each piece; [] if the text is within the limit.

    ``start`` and ``end`` are offsets into the text. A piece brings at least
    ``least`` of the limit in new tokens where a border allows it. Rank 0 is a
    cut without a border, 1 the end of a line or clause, 2 of a sentence, 3 of a
    paragraph, 4 of a section, 5 of the text.
    """
    tokens = [m.span() for m in TOKEN.finditer(text)]
    n = len(tokens)
    if n <= limit:
        return []
    rank = borders(text, tokens)
    starts = [0, *sorted(rank)]
    ends = [*starts[1:], n]
    lower = text.lower() if len(text.lower()) == len(text) else text
    units = [Counter(w for t in tokens[a:b] if len(w := lower[t[0] : t[1]].strip(".,;:()[]\"'")) > 3) for a, b in zip(starts, ends)]
    depth = valleys(units, block)
    out, begin = [], 0
    while True:
        new = begin + overlap if out else 0  # the first token that is not overlap
        most = begin + limit
        if n <= most:
            out.append((tokens[begin][0], tokens[n - 1][1], n - begin, 5))
            return out
        few = new + max(1, int(limit * least))
        lo, hi = bisect_left(starts, few), bisect_right(starts, most)
        if lo >= hi:  # no border far enough: any border
            lo = bisect_left(starts, new + 1)
        if lo < hi:
            best = max(range(lo, hi), key=lambda i: (depth[i] + 0.5 * (rank[starts[i]] - 2), starts[i]))
            cut, why = starts[best], rank[starts[best]]
        elif (cut := weak_border(text, tokens, few, most)) is not None:
            why = 1
        else:
            cut, why = most, 0
        out.append((tokens[begin][0], tokens[cut - 1][1], cut - begin, why))
        begin = max(cut - overlap, begin + 1)


def split_oversized(chunks: DataFrame, limit: int = 400, overlap: int = 40, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, piece, text, token_count, start, end, border) for each row whose text has more than ``limit`` tokens.

    Only texts long enough to hold that many tokens leave the JVM.
    """

    def run(batches):
        import pandas as pd

        for frame in batches:
            out = []
            for k, own in zip(frame[key], frame[text]):
                for i, (a, b, size, why) in enumerate(pieces(own, limit, overlap)):
                    out.append((k, i, own[a:b], size, a, b, why))
            yield pd.DataFrame(out, columns=[key, "piece", "text", "token_count", "start", "end", "border"])

    kind = chunks.schema[key].dataType.simpleString()
    long = chunks.select(key, text).where(F.length(text) > 2 * limit).dropDuplicates()
    return long.mapInPandas(run, f"`{key}` {kind}, piece int, text string, token_count int, start int, end int, border int")
