"""Problem 1: the language of each document and of each paragraph, with a confidence.

Sparse multinomial logistic regression on TF-IDF character n-grams. The n-grams
are those of single words, so a text's score is the sum of its words' scores
over the root of their number: a worker rates each word once and adds up. The
weights are trained with follow-the-regularised-leader (per-coordinate rates,
elastic net: l1 keeps them sparse, l2 small); only n-grams with a weight other than
zero are kept, each under its own number.

Training data are paragraphs of documents by the language they claim. A fifth of
them is held out before anything else. Claims may be false, so of the rest those
paragraphs that models fitted on the other thirds contradict are left out, twice
over, before the last fit. One temperature, fitted on all that was held out together
with the share of false claims among it, makes the softmax a confidence. Short
texts have small scores, so a confidence, not a number of words, decides what counts.

The sample is bounded by parameters of ``train``: at most ``per_language`` documents
for each language, of each at most ``each`` whole paragraphs. All documents are
labelled, whole.

Defined results: null, empty and wordless texts have no paragraphs; paragraphs
without letters have no row; a language that no document claims can't be found;
without any claims at all there are no rows; rows delivered again count once in
``unclaimed``; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesselar.llm.words import Memo

LANGUAGES = ["de", "en", "es", "fr", "it", "nl", "pl", "pt", "ru"]
#: Names and three-letter codes in use for the languages (fixed values).
SPELLINGS = {
    "de": ["de", "deu", "ger", "german", "deutsch"], "en": ["en", "eng", "english"], "es": ["es", "spa", "spanish", "español", "castellano"],
    "fr": ["fr", "fra", "fre", "french", "français"], "it": ["it", "ita", "italian", "italiano"], "nl": ["nl", "nld", "dut", "dutch", "nederlands"],
    "pl": ["pl", "pol", "polish", "polski"], "pt": ["pt", "por", "portuguese", "português"], "ru": ["ru", "rus", "russian", "русский"],
}
LETTERS = regex.compile(r"[\p{L}\p{M}]+")
PARTS = regex.compile(r"\n[^\S\n]*\n\s*")


def claimed(language: Column, was_translated: Column) -> Column:
    """The two-letter code that a document claims; null for none."""
    name = F.lower(F.trim(F.regexp_replace(language, r"[-_].*$", "")))
    code = F.lit(None).cast("string")
    for two, names in SPELLINGS.items():
        code = F.when(name.isin(names), F.lit(two)).otherwise(code)
    return F.when(was_translated.eqNullSafe(F.lit(True)), F.lit("en")).otherwise(code)


def paragraphs(text: str) -> list[str]:
    return [p for p in PARTS.split(text) if p.strip()] if text else []


def word_grams(word: str) -> list[str]:
    """The n-grams, n from 1 to 4, of a word between marks."""
    w = f"_{word}_"
    return [w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1) if w[i : i + n] != "_"]


class LanguageModel:
    def __init__(self, texts: list[str], labels: list[str], l1: float = 0.02, l2: float = 0.02, rate: float = 0.3, rounds: int = 2):
        self.languages = sorted(set(labels))
        numbers: dict[str, int] = {}
        features = Memo(lambda word: np.array([numbers.setdefault(g, len(numbers)) for g in word_grams(word)], np.int64))
        rows, sizes = [], []
        for t in texts:
            found = [features[w] for w in LETTERS.findall(t.lower())]
            rows.append(np.concatenate(found) if found else np.zeros(0, np.int64))
            sizes.append(max(1, len(found)))
        rng = np.random.default_rng(3)
        order = rng.permutation(len(rows))
        held, order = order[: len(order) // 5], order[len(order) // 5 :]
        frequency = np.zeros(len(numbers))
        for j in order:
            frequency[np.unique(rows[j])] += 1
        idf = np.log((1 + len(order)) / (1 + frequency)) / math.log(2 + len(order)) + 0.1
        examples = []
        for r, n in zip(rows, sizes):
            index, count = np.unique(r, return_counts=True)
            examples.append((index, count * idf[index] / math.sqrt(n)))
        y = np.array([self.languages.index(x) for x in labels])
        size = len(numbers)
        for _ in range(2):  # leave out what models fitted on the other folds contradict
            kept = []
            for fold in range(3):
                w = self._fit(size, examples, y, np.concatenate([order[f::3] for f in range(3) if f != fold]), l1, l2, rate, 1)
                kept += [j for j in order[fold::3] if (examples[j][1] @ w[examples[j][0]]).argmax() == y[j]]
            order = rng.permutation(np.array(kept, np.int64))
        w = self._fit(size, examples, y, order, l1, l2, rate, rounds)
        scores = np.array([examples[j][1] @ w[examples[j][0]] for j in held]).reshape(len(held), -1)
        self.temperature, self.false_claims = self._calibrated(scores, y[held])
        live = (w != 0).any(1)
        names = [g for g, i in numbers.items() if live[i]]  # in the order of their numbers
        self.weights = (w[live] * idf[live, None]).astype("f4")
        self.index = {g: i for i, g in enumerate(names)}

    def _fit(self, size, examples, y, train, l1, l2, rate, rounds) -> np.ndarray:
        shape = (size, len(self.languages))
        z, n, w = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        rng = np.random.default_rng(5)
        for _ in range(rounds):
            for j in rng.permutation(train):
                index, x = examples[j]
                zi, ni = z[index], n[index]
                wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((1.0 + np.sqrt(ni)) / rate + l2))
                s = x @ wi
                p = np.exp(s - s.max())
                p /= p.sum()
                p[y[j]] -= 1
                g = x[:, None] * p[None, :]
                g2 = g * g
                z[index] = zi + g - (np.sqrt(ni + g2) - np.sqrt(ni)) / rate * wi
                n[index] = ni + g2
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((1.0 + np.sqrt(n)) / rate + l2))

    @staticmethod
    def _calibrated(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        """(temperature, share of false claims) under which the claims held out are likeliest; a false claim names languages as often as claims do."""
        best = (math.inf, 1.0, 0.0)
        usual = (np.bincount(y, minlength=scores.shape[1]) / max(1, len(y)))[y]
        for t in np.geomspace(0.02, 20, 80) if len(y) else ():
            s = scores / t
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            own = p[np.arange(len(y)), y]
            for e in (0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4):
                loss = -np.mean(np.log((1 - e) * own + e * usual))
                if loss < best[0]:
                    best = (loss, float(t), e)
        return best[1:]

    def word_score(self, word: str) -> np.ndarray:
        at = [i for g in word_grams(word) if (i := self.index.get(g)) is not None]
        return self.weights[at].sum(0)


class Labeller:
    """Labels many texts at once; keeps the scores of the units it has seen (bounded)."""

    def __init__(self, model: LanguageModel, limit: int = 300_000):
        self.model, self.limit = model, limit
        self._clear()

    def _clear(self):
        self.index: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.model.languages) + 1), "f4")

    def _add(self, unit: str) -> int:
        found = LETTERS.findall(unit.lower())
        i = self.index[unit] = len(self.index)
        if i >= len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        if found:
            self.scores[i, :-1] = sum(self.model.word_score(w) for w in found)
            self.scores[i, -1] = len(found)
        return i

    def label(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language's place, confidence, words) of each text; 0 words if there are no letters."""
        p, n = self.probabilities(texts)
        return p.argmax(1), p.max(1), n

    def probabilities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(probability of each language, words) of each text."""
        if len(self.index) > self.limit:
            self._clear()
        get = self.index.get
        ids, sizes = [], []
        for t in texts:
            units = t.split()
            ids += [i if (i := get(u)) is not None else self._add(u) for u in units]
            sizes.append(len(units))
        sums = np.zeros((len(texts), self.scores.shape[1]))
        sizes = np.array(sizes, np.int64)
        if len(ids):
            full = np.flatnonzero(sizes)
            starts = (np.cumsum(sizes) - sizes)[full]
            sums[full] = np.add.reduceat(self.scores[np.array(ids)], starts, axis=0)
        n = sums[:, -1]
        s = sums[:, :-1] / np.sqrt(np.maximum(n, 1))[:, None] / self.model.temperature
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return p, n.astype(np.int64)


SENTENCES = regex.compile(r"(?<=[.!?…][\"'”’»)\]]?)\s+(?=\p{Lu}|\p{Lt}|[¿¡«“\"(\[])|\n+")


def spans_of(paragraph: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences and lines of a paragraph."""
    out, at = [], 0
    for m in SENTENCES.finditer(paragraph):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    return out + [(at, len(paragraph))] * (at < len(paragraph))


def likeliest_path(p: np.ndarray, switch: float) -> np.ndarray:
    """The language of each sentence in a row (Viterbi), a change of language costing ``switch``."""
    log = np.log(np.maximum(p, 1e-12))
    best, back = log[0], []
    for row in log[1:]:
        other = best.max() - switch
        stay = best >= other
        back.append(np.where(stay, np.arange(len(best)), best.argmax()))
        best = np.where(stay, best, other) + row
    path = [int(best.argmax())]
    for pointers in reversed(back):
        path.append(int(pointers[path[-1]]))
    return np.array(path[::-1])


def train(documents: DataFrame, claim: str = "claim", text: str = "text", per_language: int = 150, each: int = 2) -> LanguageModel | None:
    """A model from a sample of at most ``per_language`` documents a claimed language, ``each`` paragraphs of them; None without claims."""
    usable = documents.where(F.col(claim).isNotNull() & (F.length(text) > 20))
    counts = {r[0]: r[1] for r in usable.groupBy(claim).count().collect()}
    if not counts:
        return None
    # a bound on the text's hash samples each language at random, alike in every run
    share = F.lit(0.0)
    for language, n in counts.items():
        share = F.when(F.col(claim) == language, F.lit(min(1.0, 1.5 * per_language / n))).otherwise(share)
    place = F.pmod(F.xxhash64(text), F.lit(1 << 20)) / F.lit(float(1 << 20))

    def first_paragraphs(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([paragraphs(t)[:each] for t in batch.column(2).to_pylist()], pa.list_(pa.string()))], ["claim", "h", "parts"])

    sampled = usable.where(place < share).select(F.col(claim).alias("claim"), F.xxhash64(text).alias("h"), text)
    rows = sampled.mapInArrow(first_paragraphs, "claim string, h bigint, parts array<string>").distinct().orderBy("h").limit(4 * per_language * len(LANGUAGES)).collect()
    texts, labels, taken = [], [], Counter()
    for r in rows:
        if taken[r.claim] < per_language:
            taken[r.claim] += 1
            texts += r.parts
            labels += [r.claim] * len(r.parts)
    return LanguageModel(texts, labels) if texts else None


_WORKER: dict = {}


def labelled_paragraphs(documents: DataFrame, model: LanguageModel, keep: list[str], text: str = "text") -> DataFrame:
    """(the columns ``keep``, paragraph, lang, confidence, words), a row for each paragraph with letters."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    from pyspark.sql.types import StructType

    schema = StructType([documents.schema[c] for c in keep]).add("paragraph", "integer").add("lang", "string").add("confidence", "double").add("words", "long")

    def run(batches):
        value = shared.value
        if _WORKER.get("model") is not value:
            _WORKER.update(model=value, labeller=Labeller(value))
        labeller = _WORKER["labeller"]
        names = np.array(value.languages, object)
        for batch in batches:
            parts = [paragraphs(t) for t in batch.column(len(keep)).to_pylist()]
            sizes = np.array([len(p) for p in parts], np.int64)
            flat = [p for own in parts for p in own]
            if not flat:
                continue
            best, sure, n = labeller.label(flat)
            owner = np.repeat(np.arange(len(parts)), sizes)
            number = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            k = np.flatnonzero(n > 0)
            columns = [batch.column(i).take(pa.array(owner[k])) for i in range(len(keep))]
            columns += [pa.array(number[k].astype("i4")), pa.array(names[best[k]], pa.string()), pa.array(sure[k]), pa.array(n[k])]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "paragraph", "lang", "confidence", "words"])

    return documents.where(F.col(text).isNotNull()).select(*keep, text).mapInArrow(run, schema)


def with_claim(documents: DataFrame) -> DataFrame:
    return documents.withColumn("claim", claimed(F.col("original_language"), F.col("was_translated")))


def paragraph_languages(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, claim, paragraph, lang, confidence, words) of all documents; no rows where no model can be trained."""
    own = with_claim(documents)
    model = train(own)
    if model is None:
        return own.select(key, "claim", F.lit(0).alias("paragraph"), F.lit("").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(0).cast("bigint").alias("words")).where(F.lit(False))
    return labelled_paragraphs(own, model, [key, "claim"])


def segment_languages(documents: DataFrame, key: str = "doc_id", text: str = "text", switch: float = 5.0) -> DataFrame:
    """(key, paragraph, segment, start, end, lang, confidence): runs of sentences of one language within each paragraph.

    ``start`` and ``end`` are offsets within the paragraph; the confidence is the mean
    over the run's words. A change of language costs ``switch`` (natural logarithm),
    so a few foreign words make no segment. Paragraphs without letters have no row.
    """
    own = with_claim(documents)
    model = train(own)
    kind = documents.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, paragraph int, segment int, start int, `end` int, lang string, confidence double"
    if model is None:
        return documents.sparkSession.createDataFrame([], schema)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pandas as pd

        labeller = Labeller(shared.value)
        for frame in batches:
            out = []
            for k, whole in zip(frame[key], frame[text]):
                for number, paragraph in enumerate(paragraphs(whole)):
                    spans = spans_of(paragraph)
                    p, n = labeller.probabilities([paragraph[a:b] for a, b in spans])
                    kept = np.flatnonzero(n > 0)
                    if not len(kept):
                        continue
                    path = likeliest_path(p[kept], switch)
                    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(kept)]
                    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        at = kept[a:b]
                        sure = float((p[at, path[a]] * n[at]).sum() / n[at].sum())
                        out.append((k, number, i, spans[at[0]][0], spans[at[-1]][1], shared.value.languages[path[a]], sure))
            yield pd.DataFrame(out, columns=[key, "paragraph", "segment", "start", "end", "lang", "confidence"])

    return documents.where(F.col(text).isNotNull()).select(key, text).mapInPandas(run, schema)


def document_languages(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, lang, language_confidence, share): the language of most words, its mean confidence and its share of the words."""
    parts = paragraph_languages(documents, key).dropDuplicates([key, "paragraph"])
    by = parts.groupBy(key, "lang").agg(F.sum("words").alias("n"), (F.sum(F.col("confidence") * F.col("words")) / F.sum("words")).alias("c"))
    best = by.groupBy(key).agg(F.max(F.struct("n", "lang", "c")).alias("best"), F.sum("n").alias("total"))
    return best.select(key, F.col("best.lang").alias("lang"), F.col("best.c").alias("language_confidence"), (F.col("best.n") / F.col("total")).alias("share"))


def unclaimed(documents: DataFrame, least: float = 0.5, key: str = "doc_id") -> DataFrame:
    """(key, lang) for each language of a whole paragraph, of that confidence, that the document doesn't claim."""
    parts = paragraph_languages(documents, key)
    return parts.where((F.col("confidence") >= least) & ~F.col("lang").eqNullSafe(F.col("claim"))).select(key, "lang").distinct()
