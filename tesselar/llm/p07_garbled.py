"""Problem 7: text decoded with the wrong character encoding.

Noisy-channel decoding. A channel is a pair of encodings, the true one and the
one the bytes were read with. For a word as it stands each channel gives the
bytes back as a lattice, in which a lost byte (a replacement character, a
trailing byte that white-space clean-up took) is a wildcard, and the lattice
gives the words that those bytes can spell in the true encoding. A Viterbi
search over a text's words then picks for each the channel, or none, by the
word's frequency in the corpus, with a price on entering a channel and none on
staying in it. Words that no frequency is known of are rated by a character
model of the frequent words.

The word frequencies come from all texts. Garbled words are in the corpus too,
so a word that some channel turns into a more frequent word doesn't count as a
word of the language. Only words with a character beyond ASCII matter, and of
these only those over a floor of relative frequency are kept (the parameter
``floor``), which bounds their number, 1 / floor, however large the corpus is; the
others are rated by the character model. Every kept word can fill a wildcard, and
where none fits, a beam search over letters under the character model does, if one
spelling is clearly likelier than all others.

A question mark between letters is read as a lost byte if a known word fits there
(an encoder that can't write a letter puts one); in other words of ASCII alone
nothing can be lost.

Defined results: null and empty texts are never affected, nor are pure ASCII ones
without such a question mark; a text
with a replacement character is always affected, restorable or not; ties go to
the text as it stands; rows delivered again count once in ``affected``; extra
columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar.llm.words import Memo
from tesselar.storage import written

FLOOR = 2e-6
LOST = "�"
EDGE = " !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"
#: Encodings that UTF-8 is commonly read with.
READ_AS = ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_2", "cp1251", "koi8_r", "cp866", "mac_cyrillic", "cp1253", "cp1254", "iso8859_15"]
#: (true, read as) of single-byte encodings that are commonly confused.
CONFUSED = [
    ("cp1252", "latin-1"), ("cp1252", "cp1250"), ("cp1252", "cp1251"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "koi8_r"), ("cp1252", "cp866"), ("cp1252", "cp1253"),
    ("mac_roman", "cp1252"), ("mac_roman", "latin-1"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp437", "latin-1"), ("cp850", "latin-1"),
    ("cp1250", "cp1252"), ("cp1250", "latin-1"), ("iso8859_2", "cp1252"), ("iso8859_2", "latin-1"), ("cp1250", "iso8859_2"), ("iso8859_2", "cp1250"), ("cp852", "cp1252"), ("cp852", "cp1250"), ("cp1250", "mac_roman"), ("cp1250", "cp1251"),
    ("cp1251", "cp1252"), ("cp1251", "latin-1"), ("cp1251", "koi8_r"), ("cp1251", "cp866"), ("cp1251", "mac_cyrillic"), ("cp1251", "mac_roman"), ("cp1251", "cp1250"),
    ("koi8_r", "cp1251"), ("koi8_r", "cp1252"), ("koi8_r", "latin-1"), ("koi8_r", "cp866"), ("koi8_r", "mac_roman"), ("cp866", "cp1251"), ("cp866", "cp1252"), ("cp866", "latin-1"), ("cp866", "koi8_r"), ("mac_cyrillic", "cp1251"), ("mac_cyrillic", "cp1252"),
]
#: Symbols, control and unassigned characters: no part of a word, common in garbled ones.
SYMBOL = regex.compile(r"[\p{S}\p{C}\p{No}]")
#: A question mark where a letter may have been lost.
ASKED = regex.compile(r"(?<=\p{L})\?(?=\p{L})")
ENTER, ENTER_SINGLE, STAY, LEAVE = -5.0, -9.0, -0.2, -1.0


@lru_cache(None)
def table_of(codec: str) -> dict[str, int]:
    """{character: byte}; bytes the encoding leaves open stand for the control character of their number, as decoders in the wild have it."""
    out = {}
    for b in range(256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out.setdefault(chr(b), b)
    for b in range(128, 160):
        out.setdefault(chr(b), b)
    return out


def as_bytes(word: str, codec: str) -> list[int] | None:
    """The bytes read as ``word``, -1 for a lost one; None if the encoding can't have given it."""
    get, out = table_of(codec).get, []
    for c in word:
        b = -1 if c == LOST else get(c)
        if b is None:
            return None
        out.append(b)
    return out


def lattice_utf8(raw: list[int]) -> str | None:
    """The UTF-8 text of bytes with wildcards, a character with a lost byte as a replacement character; None if there is none."""
    out, i, n = [], 0, len(raw)
    while i < n:
        b = raw[i]
        if b == -1:
            out.append(LOST)
            i += 1
            continue
        if b < 0x80:
            out.append(chr(b))
            i += 1
            continue
        size = 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
        rest = raw[i + 1 : i + size]
        if not size or any(not (r == -1 or 0x80 <= r < 0xC0) for r in rest):
            return None
        if len(rest) < size - 1 and i + 1 + len(rest) < n:
            return None
        if -1 in rest or len(rest) < size - 1:
            out.append(LOST)
        else:
            try:
                out.append(bytes([b, *rest]).decode("utf-8"))
            except UnicodeDecodeError:
                return None
        i += size
    return "".join(out)


def sane(word: str) -> bool:
    return all(c == LOST or unicodedata.category(c) not in ("Cc", "Cn", "Co", "Cs") for c in word)


class Channels:
    """All readings of a word: (channel, is UTF-8, what was meant)."""

    def __init__(self):
        self.of = Memo(self._of)

    def _of(self, word: str) -> list[tuple[int, bool, str]]:
        out, seen = [], {word}
        for i, codec in enumerate(READ_AS):
            meant = word
            for twice in range(3):
                raw = as_bytes(meant, codec)
                meant = lattice_utf8(raw) if raw is not None else None
                if meant is None or meant in seen or meant.isascii() and LOST not in meant:
                    break
                if not sane(meant):
                    continue
                seen.add(meant)
                out.append((i * 3 + twice, True, meant))
        for i, (true, wrong) in enumerate(CONFUSED):
            raw = as_bytes(word, wrong)
            if raw is None or -1 in raw:
                continue
            try:
                meant = bytes(raw).decode(true)
            except UnicodeDecodeError:
                continue
            if meant not in seen and not meant.isascii() and sane(meant):
                out.append((1000 + i, False, meant))
        return out


def core_of(token: str) -> str:
    return token.strip(EDGE)


def foreign_words(text: str) -> list[str]:
    """The words with a character beyond ASCII or a question mark between letters, without ASCII marks and digits at their ends."""
    return [c for t in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if (not t.isascii() or "?" in t and ASKED.search(t)) and (c := core_of(t))]


def plain(text: str) -> bool:
    """Whether a text can't hold anything garbled."""
    return text.isascii() and not ("?" in text and ASKED.search(text))


def mask_of(word: str) -> str:
    return "".join(c if c.isascii() else LOST for c in word)


class WordModel:
    """Log probabilities of words from their counts in the corpus."""

    def __init__(self, counts: dict[str, int]):
        self.channels = Channels()
        folded: Counter = Counter()
        counts = {w: n for w, n in counts.items() if not w.isascii()}
        for w, n in counts.items():
            folded[w.casefold()] += n
        # a word that a channel turns into a known word is that word garbled
        garbled = set()
        for w, n in counts.items():
            if LOST in w:
                garbled.add(w.casefold())
                continue
            for _, utf8, meant in self.channels.of[w]:
                m = meant.casefold()
                if utf8 and SYMBOL.search(w) and not SYMBOL.search(meant):
                    garbled.add(w.casefold())
                    break
                if LOST not in m and m != w.casefold() and folded.get(m, 0) > (n / 8 if utf8 else 4 * folded[w.casefold()] + 4):
                    garbled.add(w.casefold())
                    break
        self.counts = {w: n for w, n in folded.items() if w not in garbled}
        self.total = max(1, sum(self.counts.values()))
        pairs: dict[str, Counter] = defaultdict(Counter)
        for w, n in self.counts.items():
            weight = 1 + math.log(n)
            for a, b in zip("^" + w, w + "$"):
                pairs[a][b] += weight
        self.pairs = {a: (dict(c), sum(c.values())) for a, c in pairs.items()}
        self.masked: dict[str, list[str]] = defaultdict(list)
        for w in sorted(self.counts, key=lambda w: (-self.counts[w], w)):
            self.masked[mask_of(w)].append(w)
        self.masked = dict(self.masked)
        self.places: dict[str, dict[tuple[int, str], list[str]]] = {}

    def log(self, word: str) -> float:
        w = word.casefold()
        n = self.counts.get(w, 0)
        if n:
            return math.log(n / self.total)
        out = -3.0
        for a, b in zip("^" + w, w + "$"):
            seen, total = self.pairs.get(a, ({}, 0))
            out += math.log((seen.get(b, 0) + 0.02) / (total + 20))
        return min(out, math.log(0.5 / self.total))

    def candidates(self, w: str) -> list[str]:
        """The words of the mask of w by frequency, only those with one of its remaining characters in place if any remains."""
        mask = mask_of(w)
        words = self.masked.get(mask, [])
        left = [(i, c) for i, c in enumerate(w) if c != LOST and not c.isascii()]
        if not left or not words:
            return words
        if mask not in self.places:
            at = self.places[mask] = defaultdict(list)
            for known in words:
                for i, c in enumerate(known):
                    if not c.isascii():
                        at[i, c].append(known)
        at = self.places[mask]
        return min((at.get(x, []) for x in left), key=len)

    def fill(self, word: str, agrees=None) -> str | None:
        """The most frequent of all counted words that fits where characters were lost, and that ``agrees`` accepts."""
        w = word.casefold()
        for known in self.candidates(w):
            if all(a == b or a == LOST for a, b in zip(w, known)):
                filled = known[:1].upper() + known[1:] if word[:1].isupper() else known
                if agrees is None or agrees(filled):
                    return filled
        return None


    def spell(self, word: str, beam: int = 24, margin: float = 1.4) -> str | None:
        """The likeliest letters where characters were lost, if the next best spelling is ``margin`` less likely (natural logarithm)."""
        letters = [c for c in self.pairs if not c.isascii() and c.isalpha()]
        paths = [(0.0, "^")]
        for c in word.casefold() + "$":
            longer = []
            for score, path in paths:
                seen, total = self.pairs.get(path[-1], ({}, 0))
                longer += [(score + math.log((seen.get(x, 0) + 0.02) / (total + 20)), path + x) for x in (letters if c == LOST else c)]
            paths = sorted(longer, reverse=True)[:beam]
        if not paths or len(paths) > 1 and paths[0][0] - paths[1][0] < margin:
            return None
        found = paths[0][1][1:-1]
        return found[:1].upper() + found[1:] if word[:1].isupper() else found


class Decoder:
    """Viterbi search over the words of a text."""

    def __init__(self, model: WordModel):
        self.model = model
        self.states = Memo(self._states)

    def _states(self, word: str) -> list[tuple[int, float, str]]:
        """(channel, log probability, meant) of the readings worth a look; the first is the word as it stands."""
        clean = self.model.log(word) if LOST not in word else -60.0
        out = [(-1, clean, word)]
        if LOST in word:
            f = self.model.fill(word) or self.model.spell(word)
            out.append((-2, self.model.log(f) if f else -40.0, f or word))
        elif "?" in word and (f := self.model.fill(ASKED.sub(LOST, word))):
            out.append((-2, self.model.log(f), f))
        for channel, utf8, meant in self.model.channels.of[word]:
            if LOST in meant:
                if LOST not in word and meant.count(LOST) > 1:
                    continue
                if utf8 and (filled := self.model.fill(meant, lambda f: self._fits(f, meant) and self._spelled(f, word, channel))):
                    out.append((channel, self.model.log(filled) - 1.0, filled))
                continue
            if not utf8 and meant.casefold() not in self.model.counts:
                continue
            rated = self.model.log(meant)
            if rated > clean - (4.0 if utf8 else 0.0):
                out.append((channel, rated, meant))
        return out

    @staticmethod
    def _fits(filled: str, meant: str) -> bool:
        return len(filled) == len(meant)

    @staticmethod
    def _spelled(filled: str, word: str, channel: int) -> bool:
        """The filled word's bytes agree with those of the word as it stands wherever these are left."""
        raw = as_bytes(word, READ_AS[channel // 3])
        true = list(filled.encode("utf-8"))
        if raw is None or channel % 3:
            return False
        raw += [-1] * (len(true) - len(raw))
        return len(raw) == len(true) and all(a in (-1, b) for a, b in zip(raw, true))

    def decode(self, words: list[str]) -> list[tuple[int, str]]:
        """(channel, meant) of each word."""
        best: list[tuple[int, float]] = [(-1, 0.0)]
        back = []
        for word in words:
            states = self.states[word]
            row, pointers = [], []
            for channel, own, _ in states:
                choice, score = 0, -math.inf
                for i, (before, value) in enumerate(best):
                    if channel == before:
                        step = STAY if channel >= 0 else 0.0
                    elif channel == -1 or channel == -2:
                        step = LEAVE if before >= 0 else 0.0
                    else:
                        step = ENTER if channel < 1000 else ENTER_SINGLE
                    if value + step > score:
                        choice, score = i, value + step
                row.append((channel, score + own))
                pointers.append(choice)
            best = row
            back.append(pointers)
        at = max(range(len(best)), key=lambda i: (best[i][1], -i)) if words else 0
        out = []
        for word, pointers in zip(reversed(words), reversed(back)):
            channel, _, meant = self.states[word][at]
            out.append((channel, meant))
            at = pointers[at]
        return out[::-1]

    def suspicious(self, words: list[str]) -> bool:
        states = self.states
        return any(len(states[w]) > 1 for w in words)

    def restore(self, text: str) -> tuple[str, int, int, list[int]] | None:
        """(restored text, words restored, words with a lost character, channels), or None if the text isn't affected."""
        words = foreign_words(text)
        if not self.suspicious(words):
            return None
        decoded = self.decode(words)
        channels = sorted({c for c, _ in decoded if c >= 0})
        lost = sum(LOST in w for w in words)
        if not channels and not lost and not any(c == -2 and m != w for w, (c, m) in zip(words, decoded)):
            return None
        out, at, done = [], 0, 0
        for word, (channel, meant) in zip(words, decoded):
            if channel == -1 or meant == word:
                continue
            found = text.find(word, at)
            out += [text[at:found], meant]
            at = found + len(word)
            done += 1
        return "".join([*out, text[at:]]), done, lost, channels


def word_counts(texts: DataFrame, text: str = "text", floor: float = FLOOR, least: int = 2) -> dict[str, int]:
    """Counts over all texts of the words that make up a share of ``floor`` of them and occur ``least`` times."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for own in batch.column(0).to_pylist():
                if own and not plain(own):
                    counts.update(foreign_words(own))
            if len(counts) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["w", "n"])
                counts = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["w", "n"])

    counted = texts.select(text).mapInArrow(run, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    counted = written(counted, "words")
    total = counted.agg(F.sum("n")).first()[0] or 0
    kept = counted.where((F.col("n") >= least) & (F.col("n") >= floor * total))  # 1 / floor words at most
    return {r.w: r.n for r in kept.toLocalIterator()}


def affected(texts: DataFrame, counts: dict[str, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, restored, words_restored, words_lost, channels) for each row with a wrongly decoded passage."""
    shared = texts.sparkSession.sparkContext.broadcast(counts)
    kind = texts.schema[key].dataType.simpleString()

    def run(batches):
        import pandas as pd

        decoder = decoder_of(shared)
        for batch in batches:
            out = []
            for k, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own and not plain(own) and (fixed := decoder.restore(own)):
                    out.append((k, *fixed[:3], ",".join(name_of(c) for c in fixed[3])))
            frame = pd.DataFrame(out, columns=[key, "restored", "words_restored", "words_lost", "channels"])
            yield from pa.Table.from_pandas(frame, schema=schema, preserve_index=False).to_batches()

    from pyspark.sql.pandas.types import to_arrow_schema

    empty = texts.select(key).withColumns({"restored": F.lit(""), "words_restored": F.lit(0), "words_lost": F.lit(0), "channels": F.lit("")})
    schema = to_arrow_schema(empty.schema)
    return texts.select(key, text).where(F.col(text).isNotNull()).mapInArrow(run, f"`{key}` {kind}, restored string, words_restored int, words_lost int, channels string")


_DECODERS: dict = {}


def decoder_of(shared) -> Decoder:
    """The worker's decoder, built once for a broadcast."""
    own = id(shared.value)
    if own not in _DECODERS:
        _DECODERS.clear()
        _DECODERS[own] = Decoder(WordModel(shared.value))
    return _DECODERS[own]


def name_of(channel: int) -> str:
    if channel < 1000:
        return f"utf-8 read as {READ_AS[channel // 3]}" + " again" * (channel % 3)
    return "{} read as {}".format(*CONFUSED[channel - 1000])
