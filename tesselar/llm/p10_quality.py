"""Problem 10: per-document quality statistics and outliers among them.

A pass over the texts gives each document its statistics. For each statistic the
documents are ranked exactly, those of a language among themselves and once more
all together: values are counted, the counts range-partitioned and sorted by
(group, statistic, value), and added up within each partition on top of the
partition's offset. Either empirical tail probability of a document's value is
its rank from that end over the number of documents. The negative logarithms of
these tail probabilities, weighted, add up to the outlier score, and that score
alone decides: documents over zero are found.

Weights and cut are fitted on the labelled documents, at most ``label_bound`` of
them (taken by a hash of the key): a logistic regression with a ridge around
``PRIOR``, the plain sum of the tails against prose over all documents less
``PRIOR_CUT``. So few labels leave the plain sum nearly as it is, and none leave it
alone; there is no number of labels at which the way changes. The ranks of all
documents together are needed beside those within a language because the share
of documents that are no prose differs between languages and may be zero.

Statistics are whole numbers in a bounded range: shares and log ratios in
thousandths, sizes on a log scale (a hundredth of a factor of two; any size up to
2^40 fits), so the table of ranks is bounded, whatever the corpus: statistics x
(languages + 1) x 4,001 values. It may therefore be broadcast.

Defined results: null, empty and blank texts have no statistics and are no case;
documents without a known language form one group; equal values share a rank;
repeated keys keep their rows; a document with several labels counts with their
mean; labels of one kind only, or none, leave the prior; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselar.llm.words import Memo
from tesselar.storage import written

#: Most common function words of the corpus's languages (fixed values).
COMMON = frozenset((
    "the of and to in that which is for on by with as it be are was from at this not have between who their its "
    "le la les des du et une un dans pour que qui est au aux par sur avec à en ne pas "
    "der die das und den von zu mit ein eine für im des auf ist nicht dem sich "
    "el los las del y una por con para se su al no lo como más "
    "il di che e gli della dei per un non delle con alla dal nel "
    "o a os as de um uma em do da dos não com na ao ou "
    "het een van voor met niet op te is aan dat bij om "
    "w i na z nie dla się przez po oraz za przy do ze "
    "и в не на с для по от к из о при за что без"
).split())
#: Which tail speaks against running prose: +1 large values, -1 small ones.
STATISTICS = {"other_share": 1, "symbol_share": 1, "digit_share": 1, "ended_share": -1, "common_share": -1, "repeated_share": 1, "line_words": -1, "word_length": 1, "vocabulary": -1}
#: The group of all documents, and what the fit starts from: weight 1 for the tails against prose over all documents.
ALL, PRIOR_CUT = "*", 12.0
PRIOR = [*[0.0, 0.0] * len(STATISTICS), *[1.0, 0.0] * len(STATISTICS), -PRIOR_CUT]
KNOWN = ["de", "en", "es", "fr", "it", "nl", "pl", "pt", "ru"]

BULLET = re.compile(r"(?:[-*+•·–—‣▪◦●○>»o]|\(?\d{1,3}[.):]|\(?[a-zA-Z][.)]|\([ivx]+\)|[ivx]+[.)])\s+\S")
LEADERS = re.compile(r"(?:\.\s?){4,}\s*\d*\s*$|_{4,}|-{6,}")
COLUMNS = re.compile(r"\S(?:\t+|[ ]{2,})\S")
CELLS = re.compile(r"</?(?:tr|td|th|table|tbody|thead)\b", re.I)
RULE = re.compile(r"[-=|+:_*#~.\s]+$")
PAIR = re.compile(r"[^:.!?]{2,40}:\s+\S")
ENDED = re.compile(r"[.!?…。！？؟।;:][\"'”’»)\]*]*$")
NUMBERED = re.compile(r"\[\d{1,4}\]\s")
YEAR = re.compile(r"\(\d{4}[a-z]?\)[.,:]")
PAGES = re.compile(r"\d\s*[-–]\s*\d+\.?$")
LETTERS = regex.compile(r"\p{L}")
SYMBOLS = re.compile(r"[\W_]")
DIGITS = re.compile(r"\d")
BROKEN = regex.compile(r"\p{L}+[\d|~^_=<>{}\[\]\;!,.0]+\p{L}|\p{L}+\d+|\d+\p{L}+|[|~]{2,}|^[|~;]|[|~]$")
STRIP = ".,;:!?()[]{}\"'“”‘’«»…*_#`"


def is_reference(line: str) -> bool:
    """Whether a line is an entry of a bibliography: numbered in brackets, or a year in brackets and pages at its end."""
    if line[0] == "[" and NUMBERED.match(line):
        return True
    if not (line[-1:].isdigit() or line[-2:-1].isdigit()):
        return False
    year, pages = YEAR.search(line), PAGES.search(line)
    return bool(year and pages and year.end() <= pages.start())


def structure(line: str) -> str:
    """t for a line of a table, l of a list, n for no words, empty for anything that may be prose."""
    if not line.isascii() or not line.isalpha():
        pipes = line.count("|")
        if pipes >= 2 and (line.count(" | ") >= 1 or line[0] == "|"):
            return "t"
        if "<t" in line or "</t" in line:
            if CELLS.search(line):
                return "t"
        if "\t" in line or "  " in line:
            if len(COLUMNS.findall(line)) >= (1 if "\t" in line else 2):
                return "t"
        if ".." in line or "__" in line or "--" in line or ". . " in line:
            if LEADERS.search(line):
                return "l"
        if RULE.match(line):
            return "n"
        for mark in ",;":
            n = line.count(mark)
            if n >= 2 and line.count(mark + " ") * 3 <= n:
                return "t"
    return ""


def _word(word: str) -> tuple[str, int, int, int, int]:
    """(bare lower-case form, is a function word, has letters, is damaged, length of the bare form)."""
    bare = word.strip(STRIP)
    lower = bare.lower()
    broken = not bare.isalpha() and bool(BROKEN.search(word.rstrip(".,;:!?")))
    return lower, lower in COMMON, bool(bare.isalpha() or LETTERS.search(bare)), broken, len(bare)


WORDS = Memo(_word, 200_000)


def _prose(words: list[str], text: str, lines: int) -> bool:
    """Whether a run of lines without structure reads as sentences; ``text`` is its last line."""
    n = len(words)
    if n < 4:
        return False
    lower, common, lettered, broken, sizes = zip(*map(WORDS.__getitem__, words))
    common, broken = sum(common), sum(broken)
    if sum(lettered) < 0.6 * n or n >= 8 and broken > 0.2 * n:
        return False
    if n >= 30 and len(set(lower)) < 0.18 * n and common < 0.25 * n:
        return False
    if lines > 2 and n / lines < 5.5 and common < 0.3 * n:
        return False
    if max(sizes) > 60 and sum(x for x in sizes if x > 40) > 0.3 * sum(sizes):
        return False
    ended = bool(ENDED.search(text))
    if common >= 0.1 * n and (ended or n >= 12):
        return True
    long = n >= 25 and n / lines >= 6 and common >= 0.03 * n
    return (ended and n >= 7 or long) and len(set(lower)) > min(0.5 * n, n**0.87) and sum(sizes) < 13 * n and sum(lettered) > 0.75 * n


def other_characters(lines: list[str], repeats: Counter) -> int:
    """Characters of the lines that are not running sentences."""
    other, run = 0, []

    def close() -> int:
        if not run:
            return 0
        size = sum(map(len, run))
        words = " ".join(run).split()
        if _prose(words, run[-1], len(run)):
            return 0
        if len(run) == 1:
            return size
        lost = 0
        for line in run:
            if not _prose(line.split(), line, 1):
                lost += len(line)
        return lost

    for line in lines:
        if not line:
            other += close()
            run = []
            continue
        if repeats[line] >= 3:
            kind = "r"
        else:
            kind = "l" if is_reference(line) else structure(line)
            if not kind:
                marked = BULLET.match(line)
                if marked or PAIR.match(line) and not ENDED.search(line):
                    body = line[marked.end() - 1 :] if marked else line
                    words = body.split()
                    if len(words) < 9 and not (len(words) > 5 and ENDED.search(body)) or not _prose(words, body, 1):
                        kind = "l"
        if kind:
            other += close() + len(line)
            run = []
        elif run and len(run[-1].split()) < 7 and not ENDED.search(run[-1]) and len(line.split()) < 9 and not ENDED.search(line):
            run.append(line)
        elif ENDED.search(line) and len(line) > 200 or run and ENDED.search(run[-1]) and len(run[-1]) > 200:
            other += close()
            run = [line]
        else:
            run.append(line)
    return other + close()


def statistics(text: str) -> tuple[int, ...] | None:
    """The values of STATISTICS, then the number of words; None for blank texts."""
    lines = [x.strip() for x in text.split("\n")] if text else []
    full = [x for x in lines if x]
    if not full:
        return None
    size = sum(map(len, full))
    repeats = Counter(full)
    words = text.split()
    n = len(words)
    compact = "".join(words)
    info = list(map(WORDS.__getitem__, words))
    distinct = len({w[0] for w in info})
    share = lambda a, b: round(1000 * a / b) if b else 0
    return (
        share(other_characters(lines, repeats), size),
        share(len(SYMBOLS.findall(compact)), len(compact)),
        share(len(DIGITS.findall(compact)), len(compact)),
        share(sum(1 for x in full if ENDED.search(x)), len(full)),
        share(sum(w[1] for w in info), n),
        share(sum(len(x) * c for x, c in repeats.items() if c > 1), size),
        round(100 * math.log2(1 + n / len(full))),
        round(100 * math.log2(1 + len(compact) / n)),
        share(math.log(distinct), math.log(n)) if n > 1 else 1000,
        n,
    )


def document_statistics(documents: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang") -> DataFrame:
    """(key, lang, the STATISTICS, words) of each document whose text isn't blank."""
    names = [*STATISTICS, "words"]
    kind = documents.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [statistics(t) if t else None for t in batch.column(2).to_pylist()]
            kept = np.array([i for i, r in enumerate(rows) if r], np.int64)
            values = np.array([rows[i] for i in kept], np.int64).reshape(-1, len(names))
            columns = [batch.column(i).take(pa.array(kept)) for i in (0, 1)] + [pa.array(values[:, i].astype("i4")) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, [key, "lang", *names])

    group = F.when(F.col(language).isin(KNOWN), F.col(language)).otherwise("other").alias("lang")
    return documents.select(key, group, text).where(F.col(text).isNotNull()).mapInArrow(run, f"`{key}` {kind}, lang string, " + ", ".join(f"{n} int" for n in names))


def tail_scores(stats: DataFrame) -> DataFrame:
    """(lang, statistic, value, against, with_): minus the logarithms of both exact empirical tails of every value.

    ``against`` is the tail on the side that speaks against prose. ``lang`` is a
    language, or ALL for all documents together.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(s).alias("statistic"), F.col(s).alias("value")) for s in STATISTICS)))
    own = stats.select("lang", pairs.alias("p")).groupBy("lang", "p.statistic", "p.value").agg(F.count(F.lit(1)).alias("n"))
    both = own.select(F.explode(F.array("lang", F.lit(ALL))).alias("lang"), "statistic", "value", "n").groupBy("lang", "statistic", "value").agg(F.sum("n").alias("n"))
    order = ["lang", "statistic", "value"]
    ranged = written(both.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("part", "statistic", "lang").agg(F.sum("n").alias("within"))
    group = Window.partitionBy("statistic", "lang")
    offsets = totals.select("part", "statistic", "lang", (F.sum("within").over(group.orderBy("part")) - F.col("within")).alias("offset"), F.sum("within").over(group).alias("total"))
    running = F.sum("n").over(Window.partitionBy("part", "statistic", "lang").orderBy("value"))
    ranked = ranged.withColumn("upto", running).join(offsets, ["part", "statistic", "lang"]).withColumn("upto", F.col("upto") + F.col("offset"))
    left, right = -F.log(F.col("upto") / F.col("total")), -F.log((F.col("total") - F.col("upto") + F.col("n")) / F.col("total"))
    large = F.create_map(*(x for s, d in STATISTICS.items() for x in (F.lit(s), F.lit(d))))[F.col("statistic")] > 0
    return ranked.select("lang", "statistic", "value", F.when(large, right).otherwise(left).alias("against"), F.when(large, left).otherwise(right).alias("with_"))


def tails_of(stats: DataFrame) -> DataFrame:
    """``stats`` with ``tails``: within the language, then over all documents, of each statistic both tail scores."""

    def by_value(name: str):
        known = F.map_from_entries(F.collect_list(F.when(F.col("statistic") == name, F.struct("value", F.array("against", "with_")))))
        return known.alias(f"m_{name}")

    maps = tail_scores(stats).groupBy("lang").agg(*map(by_value, STATISTICS))

    def dense_of(name: str):  # looked up by position: an array over the values from zero on
        known = F.col(f"m_{name}")
        return F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys(known))), lambda v: known[v]).alias(f"t_{name}")

    dense = maps.select("lang", *map(dense_of, STATISTICS))
    whole = F.broadcast(dense.where(F.col("lang") == ALL).select(*(F.col(f"t_{s}").alias(f"a_{s}") for s in STATISTICS)))
    tables = F.broadcast(dense.where(F.col("lang") != ALL).join(whole))  # one row on the right; at most languages x statistics x 4,001 values
    tails = F.concat(*(F.get(F.col(f"{t}_{s}"), F.col(s)) for t in "ta" for s in STATISTICS))
    return stats.join(tables, "lang").select(*stats.columns, tails.alias("tails"))


def score_of(weights) -> Column:
    return F.aggregate(F.zip_with("tails", F.array(*(F.lit(float(w)) for w in weights[:-1])), lambda x, w: x * w), F.lit(float(weights[-1])), lambda s, x: s + x)


def outlier_scores(stats: DataFrame, weights=None) -> DataFrame:
    """``stats`` with ``outlier_score``, the sum of the weighted tail scores less the cut; PRIOR unless ``weights`` are given."""
    return tails_of(stats).select(*stats.columns, score_of(PRIOR if weights is None else weights).alias("outlier_score"))


def fitted(tails: np.ndarray, share: np.ndarray, ridge: float, rounds: int = 100) -> np.ndarray:
    """Weights of the tail scores and the cut, by a logistic regression with a ridge around PRIOR (Newton steps, halved until they help)."""
    x = np.hstack([tails, np.ones((len(tails), 1))])
    prior = np.array(PRIOR)
    w = prior.copy()

    def loss(w):
        z = x @ w
        return np.sum(np.logaddexp(0, z) - share * z) + ridge / 2 * np.sum((w - prior) ** 2)

    if len(x) == 0 or share.min() == share.max():
        return w
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (p - share) + ridge * (w - prior))
        while (then := loss(w - step)) > now and np.abs(step).max() > 1e-12:
            step = step / 2
        w, done, now = w - step, now - then < 1e-9, then
        if done:
            break
    return w


def not_prose(documents: DataFrame, labels: DataFrame | None, key: str = "doc_id", ridge: float = 0.05, label_bound: int = 20_000) -> DataFrame:
    """(key) of the documents whose outlier score is over the cut.

    ``label_bound``: labelled documents that the weights are fitted on, at most.
    """
    scored = written(tails_of(written(document_statistics(documents, key), "statistics")), "tails")
    weights = np.array(PRIOR)
    if labels is not None:
        shares = labels.where(F.col("kind").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.avg((F.col("kind") != "prose").cast("double")).alias("share"))
        known = scored.select(key, "tails").join(shares, key).orderBy(F.xxhash64(key), key).limit(label_bound).collect()
        if known:
            weights = fitted(np.array([r.tails for r in known]), np.array([r.share for r in known]), ridge)
    return scored.where(score_of(weights) > 0).select(key).distinct()
