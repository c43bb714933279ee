"""A small scanner of C-like source: functions with bodies, and whether a text is balanced. It knows comments, literals, directives and
nesting, not the grammar: a parser can take its place wherever these functions are used."""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

#: What holds no code: comments, raw and plain literals, directives with their continued lines.
_BLANK = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|R"([^\s()\\]{0,16})\(.*?\)\1"|"(?:\\.|[^"\\\n])*"?|(?<![0-9A-Fa-f])'(?:\\.|[^'\\\n])*'?|^[ \t]*\#(?:\\\r?\n|[^\n])*""", re.S | re.M)
_SCOPE = re.compile(r"\b(?:class|struct|union|enum|namespace)\b|\bextern\s*$")
_NAME = re.compile(r"(?:[A-Za-z_~][\w~]*(?:<[^<>()]*>)?\s*::\s*)*(?:operator\s*[^\s\w(]{1,3}|operator\s*\(\)|operator\s+[\w:&*\s]+|~?[A-Za-z_]\w*)\s*$")
#: The macros of the language's own headers (fixed values).
STANDARD_MACROS = ("assert", "va_start", "va_arg", "va_end", "va_copy", "offsetof")


def masked(code: str) -> str:
    """The text with comments, literals and directives blanked, each character by a space: places stay what they were."""
    return _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)


def _pairs(plain: str) -> tuple[dict[int, int], bool]:
    """Where each bracket closes, and whether all of them do, in order."""
    opened, closes, sound = [], {}, True
    for m in re.finditer(r"[()\[\]{}]", plain):
        c = m[0]
        if c in "([{":
            opened.append((m.start(), c))
        elif opened and {"(": ")", "[": "]", "{": "}"}[opened[-1][1]] == c:
            closes[opened.pop()[0]] = m.start()
        else:
            sound = False
    return closes, sound and not opened


def functions(code: str) -> tuple[list[tuple[int, int, str]], bool]:
    """(start, end, name) of each outermost function that has a body, template header included, in characters; and whether all is balanced."""
    plain = masked(code)
    closes, sound = _pairs(plain)
    found, begin, at, size = [], 0, 0, len(plain)
    parameters, colon = -1, False
    while at < size:
        c = plain[at]
        if c in ";}":
            begin, parameters, colon = at + 1, -1, False
        elif c == "(" and at in closes:
            if parameters < 0 and _NAME.search(plain[max(begin, at - 400) : at]):
                parameters = at
                if plain[begin:at].rstrip().endswith("operator"):
                    following = plain.find("(", closes[at])
                    parameters = following if following >= 0 else at
                    at = closes[at] + 1 if following >= 0 else at
                    continue
            at = closes[at]
        elif c == ":" and parameters >= 0 and plain[at - 1 : at + 2].count(":") == 1:
            colon = True
        elif c == "=" and parameters < 0:
            parameters = -2  # an initialiser: what follows is no function
        elif c == "{":
            end = closes.get(at)
            head = plain[begin:at]
            if parameters >= 0 and end is not None and not (colon and re.search(r"[\w>]\s*$", head) and re.match(r"\s*[,{]", plain[end + 1 :][:80])):
                start = begin + len(head) - len(head.lstrip())
                name = _NAME.search(plain[begin:parameters])
                found.append((start, end + 1, " ".join(name[0].split()) if name else ""))
                at = end
                begin, parameters, colon = at + 1, -1, False
            elif parameters >= 0 and end is not None:
                at = end  # a member's initialiser
            elif end is not None and not _SCOPE.search(head) and head.strip() and parameters == -2:
                at = end
            else:
                begin, parameters, colon = at + 1, -1, False
        at += 1
    return found, sound


_FUNCTION = StructType([StructField("name", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("start_line", IntegerType()), StructField("end_line", IntegerType()), StructField("indent", StringType()), StructField("code", StringType())])


@F.pandas_udf(ArrayType(_FUNCTION))
def functions_of(code: pd.Series) -> pd.Series:
    """The outermost functions of a file: name, bytes [start, end), lines from 1, the indentation of the first line, and the code."""

    def one(text: str | None) -> list[dict]:
        text = text or ""
        newlines = [m.start() for m in re.finditer("\n", text)]
        out = []
        for start, end, name in functions(text)[0]:
            lead = text[text.rfind("\n", 0, start) + 1 : start]
            first = len(text[:start].encode())
            out.append({"name": name, "start": first, "end": first + len(text[start:end].encode()), "start_line": bisect.bisect_left(newlines, start) + 1, "end_line": bisect.bisect_left(newlines, end - 1) + 1, "indent": "" if lead.strip() else lead, "code": text[start:end]})
        return out

    return pd.Series([one(x) for x in code])


@F.pandas_udf(StructType([StructField("parse_ok", BooleanType()), StructField("function_definitions", IntegerType()), StructField("single_function", BooleanType())]))
def syntax_of(code: pd.Series) -> pd.DataFrame:
    """Whether brackets are balanced outside literals and comments, how many functions are defined, and whether that is one."""
    rows = [functions(x or "") for x in code]
    return pd.DataFrame([(sound, len(found), len(found) == 1) for found, sound in rows], columns=["parse_ok", "function_definitions", "single_function"])


#: A macro's definition, a call, and a macro alone on its line, perhaps with a comment behind it (fixed values).
DEFINITION = r"(?md)^[ \t]*#[ \t]*define[ \t]+([A-Za-z_]\w*\(?)"
CALL = r"^([A-Za-z_]\w*)[ \t]*\("
ALONE = r"(?d)^([A-Za-z_]\w*)[ \t]*;?[ \t]*(?://[^\n]*)?\r?(?:\n|\z)"


def defined_macros(code: Column) -> Column:
    """(name, function_like) of each macro that a text defines."""
    found = F.regexp_extract_all(code, F.lit(DEFINITION), 1)
    return F.transform(found, lambda x: F.struct(F.rtrim(x, F.lit("(")).alias("name"), x.endswith("(").alias("function_like")))


def at_macro(code: Column, offset: Column, function_like: Column, object_like: Column) -> Column:
    """Whether a place, counted in characters, is a call of a function-like macro, or an object-like one alone on its line."""
    rest = F.substr(code, (offset + 1).cast("int"))
    called = F.regexp_extract(rest, CALL, 1)
    before = F.substring_index(F.substr(code, F.lit(1), offset.cast("int")), "\n", -1)
    alone = F.regexp_extract(rest, ALONE, 1)
    has = lambda names, x: (x != "") & F.coalesce(F.array_contains(names, x), F.lit(False))
    return has(function_like, called) | ((F.btrim(before, F.lit(" \t\r\f\v")) == "") & has(object_like, alone))
