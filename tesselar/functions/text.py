"""Text cleaning and parsing as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesselar.functions import values as V


def any_of(text: Column, patterns: list[str], any_case: bool = False) -> Column:
    """Whether one of the patterns fits from the start."""
    joined = "|".join(f"(?:{p})" for p in patterns)
    return text.rlike(("(?i)" if any_case else "") + joined)


def garbage_name(name: Column, kind: Column) -> Column:
    """Whether an extracted name can't be an entity of its type."""
    text, kind = F.coalesce(name, F.lit("")), F.coalesce(kind, F.lit(""))
    documents = any_of(text, V.GARBAGE_DOCUMENTS) | any_of(text, V.GARBAGE_DOCUMENTS_ANY_CASE, True)
    return (
        (F.trim(text) == "")
        | any_of(text, V.GARBAGE)
        | any_of(text, V.GARBAGE_ANY_CASE, True)
        | ((kind != "Citation") & any_of(text, V.GARBAGE_NUMBERS))
        | ((kind == "Document") & documents)
        | ((kind == "DocumentSection") & any_of(text, V.GARBAGE_SECTIONS))
    )


def header_line(line: Column, source_type: str) -> Column:
    return any_of(line, V.HEADERS[source_type], True)


def garbage_header(header: Column) -> Column:
    """A header that names, or contains in any case, one without content."""
    bare = F.trim(F.regexp_replace(header, r"^#+\s*", ""))
    return F.exists(F.array(*(F.lit(g.lower()) for g in V.GARBAGE_HEADERS)), lambda g: F.contains(F.lower(bare), g))


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


HTML_TAG = r"<[^>]+>"
IMAGE = r"!\[[^\]]*\]\([^)]*\)"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, HTML_TAG, "")


def strip_images(text: Column) -> Column:
    return F.regexp_replace(text, IMAGE, "")


def remove_emails(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, "")


def clean_latex(text: Column) -> Column:
    for pattern, to in V.LATEX:
        text = F.regexp_replace(text, pattern, to)
    return text


def _section(names: list[str]) -> str:
    import re

    return r"(?ims)^#\s*(?:" + "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True)) + r")\s*\n.*?(?=^#\s|\z)"


def drop_sections(text: Column) -> Column:
    """Without the sections that hold no content, from their heading to the next."""
    return F.regexp_replace(text, _section(V.DROPPED_SECTIONS), "")


def reference_section(text: Column) -> Column:
    """The first bibliography with its heading, empty if there is none."""
    return F.regexp_extract(text, "(" + _section(V.REFERENCE_SECTIONS) + ")", 1)


def without_references(text: Column) -> Column:
    return F.regexp_replace(text, _section(V.REFERENCE_SECTIONS), "")


def split_references(section: Column) -> Column:
    """The entries of a bibliography over twenty characters long."""
    body = F.trim(F.regexp_replace(section, r"^#[^\n]*\n", ""))
    numbered = F.split(body, r"\n(?=\[\d+\])")
    named = F.split(body, r"\n(?=[A-Z][a-zA-Z'\-]+,?\s+[A-Z])")
    entries = F.when(body.rlike(r"(?m)^\[\d+\]"), numbered).otherwise(named)
    return F.filter(F.transform(entries, lambda r: F.trim(r)), lambda r: F.length(r) > 20)


def normalize_space(text: Column) -> Column:
    """Single blanks, at most one empty line, trimmed lines."""
    text = F.regexp_replace(F.regexp_replace(text, " +", " "), "\n{3,}", "\n\n")
    return F.trim(F.array_join(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), "\n"))


def clean_text(text: Column, is_paper: Column) -> Column:
    """All cleaning steps in their order; bibliographies leave papers only."""
    text = drop_sections(remove_emails(strip_images(clean_latex(strip_html(text)))))
    return normalize_space(F.when(is_paper, without_references(text)).otherwise(text))


def normal_name(name: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(name, r"\s+", " ")))


def normal_predicate(predicate: Column) -> Column:
    """Lower case, anything but letters, digits and blanks deleted (underscores too), blanks joined by underscores."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(predicate), r"[^a-z0-9\s]", "")), r"\s+", "_")


def match_key(text: Column) -> Column:
    """Lower case without punctuation, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", ""), r"\s+", " "))


def match_key_spaced(text: Column) -> Column:
    """Lower case, punctuation as a blank; ``Unknown`` is nothing."""
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+", " "))
    return F.when(key == "unknown", F.lit("")).otherwise(key)


def surname(name: Column) -> Column:
    """Before the comma, else the last word."""
    comma = F.trim(F.element_at(F.split(name, ","), 1))
    last = F.element_at(F.split(F.trim(name), " +"), -1)
    return F.when(F.contains(name, F.lit(",")), comma).otherwise(last)


def initial(name: Column) -> Column:
    """First letter of the given name: after the comma, else of the first word; null for a single word."""
    after = F.upper(F.substring(F.trim(F.element_at(F.split(name, ","), 2)), 1, 1))
    first = F.when(F.size(F.split(F.trim(name), " +")) > 1, F.upper(F.substring(F.trim(name), 1, 1)))
    return F.when(F.contains(name, F.lit(",")), after).otherwise(first)


def token_count(text: Column) -> Column:
    """What white space parts; 0 for blank."""
    bare = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, " ")))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")


def truncated(text: Column, most: int, suffix: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(suffix))).otherwise(text)


def cited_indices(answer: Column) -> Column:
    """The numbers in brackets, once each, in order."""
    found = F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def doc_type(chunk: Column) -> Column:
    return F.when(F.startswith(chunk, F.lit("reg_")), "regulation").when(F.startswith(chunk, F.lit("paper_")), "paper").otherwise("unknown")


def jurisdiction(chunk: Column) -> Column:
    return F.when(F.startswith(chunk, F.lit("reg_")), F.element_at(F.split(chunk, "_"), 2))


def doi(text: Column) -> Column:
    """A DOI in a link, else one in plain text if the text has just one."""
    linked = F.regexp_extract(text, r"doi\.org/(10\.\d{4,9}/[^\s\"<>\])]+)", 1)
    plain = F.regexp_extract(text, r"(10\.\d{4,9}/[^\s\"<>\])]+)", 1)
    found = F.when(linked != "", linked).when((count_matches(text, r"10\.\d{4,9}/") == 1) & (plain != ""), plain)
    return F.regexp_replace(found, r"[.,;]+$", "")


def pack(parts: Column, most: int) -> Column:
    """Consecutive parts joined by blanks into pieces of at most ``most`` characters where they allow it."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, x):
        fits = (acc["open"] == "") | (F.length(acc["open"]) + 1 + F.length(x) <= most)
        joined = F.when(acc["open"] == "", x).otherwise(F.concat(acc["open"], F.lit(" "), x))
        return F.struct(F.when(fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])).alias("done"), F.when(fits, joined).otherwise(x).alias("open"))

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))


def language(text: Column) -> Column:
    """Code of the language with most stop words in the first 5,000 characters; unknown under 20 characters or without any."""
    words = F.split(F.lower(F.substring(text, 1, 5000)), r"[^a-zà-ÿ]+")

    def hits(stop: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(stop)))

    scores = [F.struct(hits(stop).alias("n"), F.lit(code).alias("code")) for code, stop in V.STOP_WORDS.items()]
    best = F.array_max(F.array(*scores))
    return F.when((F.length(text) < 20) | (best["n"] == 0), "unknown").otherwise(best["code"])
