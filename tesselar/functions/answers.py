"""What models answer, read into columns: entities, relations and scores in JSON that may be fenced, wrapped or cut off.

Defined results: null, empty and unreadable answers give an empty list or a score
of 0; a relation without a confidence has 1.0.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITY = "array<struct<name:string,type:string,description:string>>"
RELATION = "array<struct<subject:string,predicate:string,object:string,confidence:double>>"
WRAPPER = re.compile(r'"relations"\s*:\s*\[')


def unfenced(answer: Column) -> Column:
    """Without the fence around a block of code."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(answer), r"^```[^\n]*\n?", ""), r"\s*```$", ""))


def entities(answer: Column) -> Column:
    """The entities of an answer: a list, or an object with a list of that name; an empty list for anything else."""
    body = unfenced(answer)
    whole = F.try_parse_json(body).isNotNull()
    bare = F.from_json(body, ENTITY)
    held = F.from_json(body, f"struct<entities:{ENTITY}>")["entities"]
    found = F.when(whole & F.startswith(body, F.lit("[")), bare).when(whole & F.startswith(body, F.lit("{")), held)
    return F.coalesce(found, F.array().cast(ENTITY))


def whole_relations(answer: str | None) -> list[tuple]:
    """The complete relations of an answer that may begin with other words and end anywhere."""
    if not answer:
        return []
    opened = WRAPPER.search(answer)
    at = opened.end() if opened else answer.find("{")
    decoder, out = json.JSONDecoder(), []
    while 0 <= at < len(answer):
        while at < len(answer) and (answer[at].isspace() or answer[at] == ","):
            at += 1
        try:
            value, at = decoder.raw_decode(answer, at)
        except ValueError:
            break
        if not isinstance(value, dict):
            break
        text = lambda k, own=value: None if own.get(k) is None else str(own[k])
        sure = value.get("confidence")
        out.append((text("subject"), text("predicate"), text("object"), float(sure) if isinstance(sure, int | float) else 1.0))
    return out


def relations(answer: Column) -> Column:
    """The complete relations of each answer, in Arrow batches."""

    @F.pandas_udf(RELATION)
    def read(answers):
        import pandas as pd

        return pd.Series([[dict(zip(("subject", "predicate", "object", "confidence"), r)) for r in whole_relations(a)] for a in answers], dtype=object)

    return read(answer)


def score(answer: Column) -> Column:
    """The score of a judge's answer: of the JSON object, of one within other words, of the field alone; else 0."""
    body = unfenced(answer)
    field = lambda x: F.try_variant_get(F.try_parse_json(x), "$.score", "double")
    inner = F.nullif(F.regexp_extract(body, r"(\{[\s\S]*\})", 1), F.lit(""))
    alone = F.nullif(F.regexp_extract(body, r'"score"\s*:\s*([\d.]+)', 1), F.lit(""))
    return F.coalesce(field(body), field(inner), F.expr("try_cast(NULL AS DOUBLE)"), alone.try_cast("double"), F.lit(0.0))
