"""Model calls as pluggable functions, with deterministic offline stand-ins.

Each model is an object with one method over plain values; operators run it in
Arrow batches, so a remote model gets batched requests and Spark's retries.
"""

from __future__ import annotations

import re
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Extractor(Protocol):
    """Finds (name, type, description) in a text."""

    def extract(self, text: str) -> list[tuple[str, str, str]]: ...


class RuleExtractor:
    """Capitalised runs, citations, numbered references and articles, by pattern."""

    RULES = [
        (re.compile(r"\b([A-Z][a-z]+ \(\d{4}\))"), "Citation"),
        (re.compile(r"(\[\d+\])"), "Citation"),
        (re.compile(r"\b((?:Article|Section|Annex) [\dIVX]+)\b"), "DocumentSection"),
        (re.compile(r"\b((?:[A-Z]\w+ )+(?:Act|Regulation|Directive)(?: \d{4})?)\b"), "Regulation"),
        (re.compile(r"\b((?:[A-Z]\w+ )+(?:Institute|Laboratory|Centre|Agency|Commission|Foundation|Observatory|Association)(?: (?:for|of) (?:[A-Z]\w+ ?)+)?)"), "Organization"),
    ]

    def extract(self, text: str) -> list[tuple[str, str, str]]:
        found = dict.fromkeys((m.group(1).strip(), kind) for rule, kind in self.RULES for m in rule.finditer(text))
        return [(name, kind, "") for name, kind in found]


class Judge(Protocol):
    """Says whether two names mean the same."""

    def same(self, a: str, b: str) -> bool: ...


class RuleJudge:
    """Equal words, or one the other's initials; different numbers or a negation differ."""

    def same(self, a: str, b: str) -> bool:
        x, y = re.findall(r"\w+", a.lower()), re.findall(r"\w+", b.lower())
        numbers = lambda w: {t for t in w if t.isdigit()}
        if numbers(x) != numbers(y):
            return False
        initials = lambda w: "".join(t[0] for t in w)
        return set(x) == set(y) or len(x) == 1 and len(y) > 1 and x[0] == initials(y) or len(y) == 1 and len(x) > 1 and y[0] == initials(x)


def extract_entities(chunks: DataFrame, model: Extractor | None = None, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, name, type, description) for each entity that the model finds."""
    model = model or RuleExtractor()

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(k, *e) for k, t in zip(pdf[key], pdf[text]) if t for e in model.extract(t)]
            yield pd.DataFrame(rows, columns=[key, "name", "type", "description"])

    return chunks.select(key, text).mapInPandas(run, f"{key} {chunks.schema[key].dataType.simpleString()}, name string, type string, description string")


def judge_pairs(pairs: DataFrame, model: Judge | None = None) -> DataFrame:
    """``pairs`` (name_a, name_b, ...) with same; a failing call means different."""
    model = model or RuleJudge()

    @F.pandas_udf("boolean")
    def same(a, b):
        import pandas as pd

        def one(x, y):
            try:
                return bool(x and y and model.same(x, y))
            except Exception:  # noqa: BLE001
                return False

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="bool")

    return pairs.withColumn("same", same("name_a", "name_b"))


def translate(documents: DataFrame, cache: DataFrame, key: str = "doc_id", language: str = "lang") -> DataFrame:
    """``documents`` with English text from a cache (key, language, translated); others keep theirs. was_translated says which."""
    joined = documents.join(cache.select(key, F.col("language").alias(language), "translated"), [key, language], "left")
    hit = F.col("translated").isNotNull() & (F.coalesce(language, F.lit("en")) != "en")
    return joined.withColumn("text", F.when(hit, F.col("translated")).otherwise(F.col("text"))).withColumn("was_translated", hit).drop("translated")


def missing_vectors(rows: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Rows that have no vector yet: what an embedding run still has to do."""
    return rows.join(vectors.select(key), key, "left_anti")


def support_score(answer_words, source_words):
    """Share of an answer's words that its sources have."""
    return F.when(F.size(answer_words) > 0, F.size(F.array_intersect(answer_words, source_words)) / F.size(answer_words)).otherwise(0.0)


class RelationExtractor(Protocol):
    """Finds (subject, predicate, object) among names in a text."""

    def relations(self, text: str, names: list[str]) -> list[tuple[str, str, str]]: ...


class RuleRelations:
    """Two names of one sentence with one to four words between them: these are the predicate."""

    def relations(self, text: str, names: list[str]) -> list[tuple[str, str, str]]:
        out = []
        for sentence in re.split(r"(?<=[.!?])\s+", text):
            low = sentence.lower()
            at = sorted((i, i + len(n), n) for n in names if n and (i := low.find(n.lower())) >= 0)
            for (_, end, a), (start, _, b) in zip(at, at[1:]):
                between = re.findall(r"[a-z]+", low[end:start]) if start > end else []
                if 1 <= len(between) <= 4:
                    out.append((a, "_".join(between), b))
        return out


def extract_relations(chunks: DataFrame, model: RelationExtractor | None = None, key: str = "chunk_id") -> DataFrame:
    """(key, subject, predicate, object, confidence) of chunks (key, text, names)."""
    model = model or RuleRelations()

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(k, *r, 1.0) for k, t, n in zip(pdf[key], pdf["text"], pdf["names"]) if t for r in model.relations(t, list(n))]
            yield pd.DataFrame(rows, columns=[key, "subject", "predicate", "object", "confidence"])

    return chunks.select(key, "text", "names").mapInPandas(run, f"{key} {chunks.schema[key].dataType.simpleString()}, subject string, predicate string, object string, confidence double")
