"""Semantic chunking of sections by sentence vectors from a pluggable model."""

from __future__ import annotations

from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar.functions import text as X


class SentenceModel(Protocol):
    """Turns sentences into unit vectors."""

    def encode(self, sentences: list[str]) -> np.ndarray: ...


class HashedWords:
    """An offline model: signed word hashes in a fixed number of dimensions."""

    def __init__(self, dim: int = 256):
        self.dim = dim

    def encode(self, sentences: list[str]) -> np.ndarray:
        import re
        import zlib

        out = np.zeros((len(sentences), self.dim))
        for i, s in enumerate(sentences):
            for w in re.findall(r"\w+", s.lower()):
                h = zlib.crc32(w.encode())
                out[i, h % self.dim] += 1 if h & 0x80000000 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def chunk_sections(sections: DataFrame, model: SentenceModel | None = None, key: str = "doc_id", threshold: float = 0.45, least: int = 3, most_tokens: int = 1500) -> DataFrame:
    """(key, section, header, part, text, sentence_count, token_count, coherence).

    ``sections`` has (key, section, header, content). Sections of up to
    ``least`` sentences are one chunk; else a chunk ends before a sentence that
    would pass the token limit, or that is unlike the one before once the chunk
    has ``least`` sentences.
    """
    model = model or HashedWords()
    split = sections.select(key, "section", "header", X.sentences(F.col("content")).alias("sentences")).where(F.size("sentences") > 0)

    def cut(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                s = list(row.sentences)
                v = model.encode(s)
                near = [float(v[i] @ v[i - 1]) if i else 1.0 for i in range(len(s))]
                size = [len(x.split()) for x in s]
                starts, tokens = [0], size[0]
                if len(s) > least:
                    for i in range(1, len(s)):
                        if tokens + size[i] > most_tokens or near[i] < threshold and i - starts[-1] >= least:
                            starts.append(i)
                            tokens = 0
                        tokens += size[i]
                for part, (a, b) in enumerate(zip(starts, [*starts[1:], len(s)])):
                    inner = near[a + 1 : b]
                    out.append((getattr(row, key), row.section, row.header, part, " ".join(s[a:b]), b - a, sum(size[a:b]), float(np.mean(inner)) if inner else 0.0))
            yield pd.DataFrame(out, columns=[key, "section", "header", "part", "text", "sentence_count", "token_count", "coherence"])

    kind = sections.schema[key].dataType.simpleString()
    return split.mapInPandas(cut, f"{key} {kind}, section bigint, header string, part int, text string, sentence_count int, token_count int, coherence double")


def quality_reason():
    """Why a chunk is left out; null if it stays."""
    c = F.col
    return (
        F.when((c("coherence") < 0.30) & (c("sentence_count") > 1), "low coherence")
        .when((c("token_count") < 15) & (c("sentence_count") == 1), "too short")
        .when((c("token_count") / c("sentence_count") < 10) & c("header").isNull(), "sparse")
    )
