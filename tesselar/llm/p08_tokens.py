"""Problem 8: the whole corpus as token ids of a public byte-level BPE vocabulary.

Per-prefix dynamic programming. For every prefix of a pre-token exactly one
token can come last in the prefix's encoding. An automaton over the vocabulary
lists the tokens that end at a position; of these the one is stored whose pair
with the last token of the prefix before it survives merging. The stored tokens
are followed backwards from the end, which gives the exact ids without running
a merge loop over the text.

Pre-tokens repeat, so each worker keeps what it encoded (bounded). Defined
results: null and empty texts give the empty array; strings that look like
special tokens are ordinary text; repeated rows give repeated rows; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tesselar.llm.words import SPACE, Memo

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's published pre-token pattern (fixed value), its ``\s`` spelled out.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + "]+"
#: Cuts between which no pre-token reaches: a run of other characters with one space before it, or white space.
COARSE = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
NEVER = 1 << 62


class PrefixEncoder:
    """Byte-level BPE by the last token of every prefix."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.matcher = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.matcher.add_word(token.decode("latin-1"), (rank, len(token)))
        self.matcher.make_automaton()
        self.halves = Memo(self._halves, 200_000)
        self.right_spine = Memo(lambda t: self._spine(t, 1), 200_000)
        self.left_spine = Memo(lambda t: self._spine(t, 0), 200_000)
        self.compatible = Memo(self._compatible, 1_000_000)
        self.fine = regex.compile(PATTERN)
        self.units = Memo(self._unit)
        self.pretokens = Memo(self._pretoken)

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for single bytes, (-1, -1) if merging its bytes never makes it."""
        data = self.bytes_of[token]
        if len(data) == 1:
            return None
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], NEVER))
            if self.ranks.get(parts[best] + parts[best + 1], NEVER) >= token:
                return (-1, -1)
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one edge while ``token`` is built, from the whole down, each with the rank at which it is absorbed."""
        out, until = [], NEVER
        while True:
            out.append((token, until))
            half = self.halves[token]
            if half is None:
                return out
            until, token = token, half[side]

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """No merge crosses the border of two tokens while both are built. At equal ranks the left merge comes first."""
        for x, x_end in self.right_spine[pair[0]]:
            for y, y_end in self.left_spine[pair[1]]:
                rank = self.ranks.get(self.bytes_of[x] + self.bytes_of[y], NEVER)
                if rank < x_end and rank <= y_end and rank != NEVER:
                    return False
        return True

    def _pretoken(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None and self.halves[whole] != (-1, -1):
            return [whole]
        last = [-1] * (len(data) + 1)
        length = [0] * (len(data) + 1)
        for end, (token, size) in self.matcher.iter(data.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            before = last[end - size] if end > size else None
            if before == -1 or self.halves[token] == (-1, -1):
                continue
            if before is None or self.compatible[before, token]:
                last[end], length[end] = token, size
        ids, at = [], len(data)
        while at:
            ids.append(last[at])
            at -= length[at]
        return ids[::-1]

    def _unit(self, unit: str) -> bytes:
        ids: list[int] = []
        for piece in self.fine.findall(unit):
            raw = piece.encode("utf-8", "replace")
            ids += self.pretokens[raw] if len(raw) < 200 else self._pretoken(raw)
        return np.asarray(ids, "<i4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        return b"".join(map(self.units.__getitem__, COARSE.findall(text)))


def read_ranks(vocabulary: str) -> dict[bytes, int]:
    with open(vocabulary, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(2)
def encoder(vocabulary: str) -> PrefixEncoder:
    return PrefixEncoder(read_ranks(vocabulary))


_ENCODERS: dict = {}


def worker_encoder(token: str, shared) -> PrefixEncoder:
    """The worker's encoder, built once for all tasks of a call."""
    if token not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[token] = PrefixEncoder(shared.value)
    return _ENCODERS[token]


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids) for each row of ``df``; one pass, no shuffle. The vocabulary is read by the driver and sent to the workers."""
    shared, token = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary)), vocabulary  # a fixed table, under a megabyte

    def run(batches):
        own = worker_encoder(token, shared)
        for batch in batches:
            parts = [own.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(parts) + 1, "i4")
            np.cumsum([len(p) >> 2 for p in parts], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
