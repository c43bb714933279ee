"""Parsing of model answers. Whole JSON objects are read by built-in functions; answers inside prose by an Arrow function."""

from __future__ import annotations

import difflib
import json
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType, StructField, StructType


def _objects(text: str):
    """From each { on, left to right, the text up to the } that balances it, if there is one; quoting is not looked at."""
    opened, closes = [], {}
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            opened.append(m.start())
        elif opened:
            closes[opened.pop()] = m.end()
    for start in sorted(closes):
        yield text[start : closes[start]]


@F.pandas_udf(StructType([StructField("checks", ArrayType(StringType())), StructField("valid", BooleanType())]))
def checks_anywhere(text: pd.Series) -> pd.DataFrame:
    """The string items of "checks" in the first JSON object of a text that has such a list; else invalid and empty. An object may
    lie inside another one, or after a brace that never closes."""

    def one(x: str | None) -> tuple[list[str], bool]:
        for span in _objects(x or ""):
            try:
                value = json.loads(span)
            except (ValueError, RecursionError):
                continue
            if isinstance(value, dict) and isinstance(value.get("checks"), list):
                return sorted({c for c in value["checks"] if isinstance(c, str)}), True
        return [], False

    return pd.DataFrame([one(x) for x in text], columns=["checks", "valid"])


def checks_bare(text: Column) -> Column:
    """The same for a text that is a JSON object as a whole; items that are no strings are left out."""
    raw = F.get_json_object(text, "$.checks")
    items = F.from_json(raw, "array<variant>")
    words = F.filter(F.transform(items, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))), lambda x: x.isNotNull())
    boxed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))  # the path alone is read whatever follows the object
    whole = F.try_variant_get(boxed, "$[0]", "variant").isNotNull() & F.try_variant_get(boxed, "$[1]", "variant").isNull()
    return F.when(whole & raw.startswith("["), F.array_sort(F.array_distinct(words)))


def lenient_json(text: Column) -> Column:
    """The widest {...} of a text, with trailing commas taken out; null if it is no JSON."""
    body = F.regexp_replace(F.regexp_extract(text, r"(?s)(\{.*\})", 1), r",(\s*[}\]])", "$1")
    return F.when(F.try_parse_json(body).isNotNull() & (body != ""), body)


def json_with_keys(text: Column, keys: list[str]) -> Column:
    """The first flat JSON object of a text that has all those keys; null if none has."""
    found = F.filter(F.regexp_extract_all(text, F.lit(r"(\{[^{}]*\})"), 1), lambda x: F.try_parse_json(x).isNotNull() & F.forall(F.array(*map(F.lit, keys)), lambda k: F.array_contains(F.json_object_keys(x), k)))
    return F.get(found, 0)


@F.pandas_udf(StringType())
def unified_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series(["\n".join(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), "before", "after", lineterm="")) for a, b in zip(before, after, strict=True)])


#: Names of checks, as a whole (fixed value).
CHECK_NAME = r"^[a-z][a-z0-9]*(-[A-Za-z0-9.+]+)+$"


def parsed_label(answer: Column, categories: list[str], clean: str = "No smells detected") -> Column:
    """(smells, severity, checks, reject) of an answer with exactly the keys smells, severity and explanation.

    smells are the known categories that the answer names, in the order of the vocabulary; checks are sorted. reject says why there is no
    label: no JSON, other keys, a category outside the vocabulary, a clean label that is not clean throughout, or no proper checks.
    """
    keys = F.json_object_keys(F.when(F.try_parse_json(answer).isNotNull(), answer))
    vocabulary = F.array(*map(F.lit, categories))
    named = F.from_json(F.get_json_object(answer, "$.smells"), "array<string>")
    atoms = F.array_distinct(F.flatten(F.transform(named, lambda s: F.transform(F.split(s, ",", -1), lambda x: F.btrim(x)))))
    smells = F.filter(vocabulary, lambda c: F.array_contains(atoms, c))
    severity, explanation = F.get_json_object(answer, "$.severity").cast("double"), F.get_json_object(answer, "$.explanation")
    checks = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(explanation, ",", -1), lambda x: F.btrim(x)), lambda x: x != "")))
    reject = (
        F.when(answer.isNull() | F.try_parse_json(answer).isNull(), "label is not JSON")
        .when(keys.isNull() | (F.array_sort(keys) != F.array(*map(F.lit, ("explanation", "severity", "smells")))), "unexpected label keys")
        .when(F.size(F.array_except(atoms, vocabulary)) > 0, "category outside the vocabulary")
        .when((F.size(smells) == 0) & ((severity != 0) | (explanation != clean)), "clean label with severity or checks set")
        .when((F.size(smells) > 0) & ((F.size(checks) == 0) | F.exists(checks, lambda c: ~c.rlike(CHECK_NAME))), "smelly label without valid check names")
    )
    kept = lambda c: F.when(reject.isNull(), c)
    none = F.array().cast("array<string>")
    return F.struct(kept(smells).alias("smells"), kept(severity.cast("int")).alias("severity"), kept(F.when(F.size(smells) == 0, none).otherwise(checks)).alias("checks"), reject.alias("reject"))


def _lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one row of the table as the bits of a number."""
    places: dict[str, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


@F.pandas_udf(StructType([StructField("rouge_l", DoubleType()), StructField("bleu", DoubleType())]))
def overlap_scores(reference: pd.Series, candidate: pd.Series) -> pd.DataFrame:
    """ROUGE-L F1 and smoothed BLEU-4 over white-space tokens. Smoothing of other libraries differs: figures are our own."""
    import math

    def one(ref: str, cand: str) -> tuple[float, float]:
        r, c = (ref or "").split(), (cand or "").split()
        if not r or not c:
            return 0.0, 0.0
        common = _lcs(r, c)
        rouge = 2 * common / (len(r) + len(c))
        logs = []
        for n in range(1, 5):
            grams, refs = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (c, r))
            hit, total = sum((grams & refs).values()), max(1, sum(grams.values()))
            logs.append(math.log((hit + (n > 1)) / (total + (n > 1))) if hit or n > 1 else -math.inf)
        return rouge, min(1.0, math.exp(1 - len(r) / len(c))) * math.exp(sum(logs) / 4)

    return pd.DataFrame([one(r, c) for r, c in zip(reference, candidate, strict=True)], columns=["rouge_l", "bleu"])
