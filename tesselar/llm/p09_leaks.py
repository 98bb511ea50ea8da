"""Problem 9: passages of evaluation items inside a corpus.

One Aho-Corasick automaton over the normalised items. Words are the letters of
its alphabet: each different word of the items is one character, and all other
words are another one, so a normalised text is a string of one character a word
and is scanned once. The patterns are the items' consecutive blocks of half a
window: every run of ``width`` words holds one whole block of (width + 1) / 2
words that begins at a multiple of that in its item, so a hit is followed to both
sides in the item and counts if the common run has ``width`` words. That is
exact, and the automaton has a node a word instead of ``width`` of them.
Word numbers are mapped back to offsets in the text as it stands. Passages
changed between the runs still show by the runs left.

The item set is collected to the driver: it is a fixed set of held-out items,
not data that grows with the corpus. Its size is checked first; over
``most_words`` words, or with more different words than there are characters
(1.1 million), the call raises an error and nothing is left out silently. Two million words take
under 500 MB, once in each Python worker, whatever the number of its tasks.

Defined results: null, empty and wordless texts and items match nothing; items
shorter than ``width`` words match nothing; equal passages of several items give
each of them; an item with several texts gives a row for each; repeated rows give
repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar.llm.words import WORD, Memo, words

UNKNOWN = "\x00"
_BUILT: dict = {}


def _letter(n: int) -> str:
    """The n-th character that may stand for a word, surrogates left out."""
    return chr(n + 1 if n + 1 < 0xD800 else n + 1 + 0x800)


class LeakScanner:
    """The automaton over items: (item_id, text) pairs."""

    def __init__(self, items: list[tuple], width: int):
        self.width, self.block = width, (width + 1) // 2
        self.letters: dict[str, str] = {}
        self.items: list[tuple] = []  # (item id, its words as characters)
        blocks: dict[str, list[tuple[int, int]]] = {}
        for item, text in items:
            own = words(text or "")
            if len(own) < width:
                continue
            for word in own:
                if word not in self.letters:
                    if len(self.letters) >= 0x10F7FE:
                        raise ValueError("the evaluation items have more different words than there are characters; work them off in parts")
                    self.letters[word] = _letter(len(self.letters))
            coded = "".join(map(self.letters.__getitem__, own))
            for at in range(0, len(coded) - self.block + 1, self.block):
                blocks.setdefault(coded[at : at + self.block], []).append((len(self.items), at))
            self.items.append((item, coded))
        self.automaton = None
        if blocks:
            self.automaton = ahocorasick.Automaton()
            for block, places in blocks.items():
                self.automaton.add_word(block, tuple(places))
            self.automaton.make_automaton()
        self.units = Memo(lambda unit: "".join(self.letters.get(w, UNKNOWN) for w in words(unit)))

    def runs(self, flat: str):
        """(item number, start in the text, start in the item, length) of each common run of at least ``width`` words."""
        seen: dict[tuple[int, int], int] = {}
        for end, places in self.automaton.iter(flat):
            first = end - self.block + 1
            for number, at in places:
                if first < seen.get((number, first - at), 0):
                    continue  # inside a run that is known already
                own = self.items[number][1]
                i, j = first, at
                while i and j and flat[i - 1] == own[j - 1]:
                    i, j = i - 1, j - 1
                k, m = end + 1, at + self.block
                while k < len(flat) and m < len(own) and flat[k] == own[m]:
                    k, m = k + 1, m + 1
                seen[number, first - at] = k
                if k - i >= self.width:
                    yield number, i, j, k - i

    def scan(self, text: str):
        """(item, share of the item's words found, windows, start, end) with offsets into ``text``."""
        if self.automaton is None:
            return
        flat = "".join(map(self.units.__getitem__, text.split()))
        found: dict[int, list[tuple[int, int, int]]] = {}
        for number, i, j, n in self.runs(flat):
            found.setdefault(number, []).append((i, j, n))
        if not found:
            return
        lower = text.lower()
        places = [m.span() for m in WORD.finditer(lower)]
        origin = None if len(lower) == len(text) else [i for i, c in enumerate(text) for _ in c.lower()]
        for number, runs in found.items():
            item, own = self.items[number]
            covered = {p for _, j, n in runs for p in range(j, j + n)}
            start, end = places[min(i for i, _, _ in runs)][0], places[max(i + n for i, _, n in runs) - 1][1]
            if origin:
                start, end = origin[start], origin[end - 1] + 1
            yield item, len(covered) / len(own), sum(n - self.width + 1 for _, _, n in runs), start, end


def scanner_of(token: str, items: list[tuple], width: int) -> LeakScanner:
    """The worker's automaton, built once for all of its tasks."""
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = LeakScanner(items, width)
    return _BUILT[token]


def leaks(documents: DataFrame, items: DataFrame, width: int = 13, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", most_words: int = 5_000_000) -> DataFrame:
    """(key, item_key, share, windows, start, end) for each document and item that share ``width`` consecutive words.

    ``share`` is the part of the item's words that common runs cover; ``start``
    and ``end`` bound the matched span in the text.
    """
    own = items.select(item_key, item_text).where(F.col(item_text).isNotNull()).distinct()
    size = own.agg(F.sum(F.size(F.split(item_text, r"\s+")))).first()[0] or 0
    if size > most_words:
        raise ValueError(f"the evaluation items have {size} words; at most {most_words} are scanned at once")
    rows = sorted(map(tuple, own.collect()), key=lambda r: (str(r[0]), r[1]))
    shared, token = documents.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

    def run(batches):
        import pandas as pd

        scanner = scanner_of(token, shared.value, width)
        for frame in batches:
            out = [(doc, *hit) for doc, own in zip(frame[key], frame[text]) if own for hit in scanner.scan(own)]
            yield pd.DataFrame(out, columns=[key, item_key, "share", "windows", "start", "end"])

    kinds = documents.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"`{key}` {kinds[0]}, `{item_key}` {kinds[1]}, share double, windows bigint, start bigint, end bigint"
    return documents.select(key, text).where(F.col(text).isNotNull()).mapInPandas(run, schema)
