"""Scalar text functions as column expressions: all run inside the JVM, none needs a Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode, as one character class that Java and RE2 read alike (fixed values).
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Line boundaries of Unicode (fixed values).
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
#: Preprocessor directives that a lost newline glues to the token before (fixed values).
DIRECTIVES = ("define", "include", "ifdef", "ifndef", "endif", "pragma", "undef")


def normalised(c: Column) -> Column:
    """White space collapsed to single blanks and trimmed."""
    return F.btrim(F.regexp_replace(c, f"{SPACE}+", " "))


def stable_id(prefix: str, c: Column) -> Column:
    """prefix and the first twelve hex digits of the normalised text's digest."""
    return F.concat(F.lit(prefix), F.substring(F.md5(normalised(c)), 1, 12))


def unified(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def dedented(code: Column, indent: Column) -> Column:
    """Newlines unified, and a known indent taken from every line but the first."""
    lines = F.split(unified(code), "\n", -1)
    cut = lambda x, i: F.when((i > 0) & (F.length(indent) > 0) & F.startswith(x, indent), F.substr(x, F.length(indent) + 1)).otherwise(x)
    return F.array_join(F.transform(lines, cut), "\n")


def unglued(code: Column) -> Column:
    """Glued directives start a line again; text is trimmed and CRLF becomes LF."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(code, r"\r\n", "\n"), f"^{SPACE}+", ""), f"{SPACE}+$", "")
    return F.regexp_replace(text, r'([A-Za-z0-9_">)])(#[ \t]*(?:' + "|".join(DIRECTIVES) + r")\b)", "$1\n$2")


def after_last(c: Column, marker: str) -> Column:
    return F.substring_index(c, marker, -1)


def last_index(c: Column, needle: str) -> Column:
    """Position from 1 of the last occurrence, 0 if there is none."""
    at = F.length(c) - F.locate(needle[::-1], F.reverse(c)) - (len(needle) - 2)
    return F.when(F.contains(c, F.lit(needle)), at).otherwise(0)


def last_head(c: Column, heads: list[str]) -> Column:
    """Which of the known heads occurs last; null if none does. Earlier ones are examples in the prompt."""
    best = F.greatest(*(last_index(c, h) for h in heads)) if len(heads) > 1 else last_index(c, heads[0])
    out = F.lit(None).cast("string")
    for h in reversed(heads):
        out = F.when((best > 0) & (last_index(c, h) == best), F.lit(h)).otherwise(out)
    return out


def user_code(content: Column) -> Column:
    """What follows the first blank line; null if there is none."""
    return F.get(F.split(content, "\n\n", 2), 1)


def comma_set(c: Column) -> Column:
    """Sorted distinct non-empty items of a comma-separated list."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(c, ",", -1), lambda x: F.btrim(x)), lambda x: x != "")))


def bin_of(edges: Column, value: Column) -> Column:
    """How many edges are at or below the value."""
    return F.size(F.filter(edges, lambda e: e <= value)).cast("bigint")


def edges_of(percentiles: Column) -> Column:
    """Interior percentiles truncated to whole numbers, without repeats; rounded first, so that float noise moves no edge."""
    return F.array_sort(F.array_distinct(F.transform(percentiles, lambda x: F.floor(F.round(x, 6)))))


def token_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(\w+)"), 1))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix, by bisection on substrings: some twenty steps for a text of a million characters."""
    least = F.least(F.length(a), F.length(b))
    steps = F.array(*(F.lit(1 << k) for k in range(24, -1, -1)))
    fits = lambda n: (n <= least) & (F.substr(a, F.lit(1), n) == F.substr(b, F.lit(1), n))
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(fits(low + step), low + step).otherwise(low))


def occurrences(c: Column, marker: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(marker), F.lit("")))) / len(marker)).cast("bigint")


def stripped(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{SPACE}+", ""), f"{SPACE}+$", "")


#: A fenced block of C or C++, or of no named language; fences stand at line starts (fixed values).
FENCE = r"(?smid)^```(?:cpp|c\+\+|c)?[ \t]*\r?\n(.*?)^```[ \t]*$"


def fenced(c: Column) -> Column:
    """The one fenced block of a text that has exactly one and no other fence, else the text itself, stripped."""
    text = stripped(c)
    blocks = F.regexp_extract_all(text, F.lit(FENCE), 1)
    return F.when((F.size(blocks) == 1) & (F.regexp_count(text, F.lit(r"(?md)^```")) == 2), stripped(F.get(blocks, 0))).otherwise(text)


def quick_ratio(a: Column, b: Column, most: int = 3000) -> Column:
    """Twice the common characters of two prefixes, counted as a multiset, over all their characters; 1 for two empty texts.

    The prefixes are part of the measure, which compares whole programs by their first `most` characters.
    """
    a, b = F.coalesce(F.left(a, F.lit(most)), F.lit("")), F.coalesce(F.left(b, F.lit(most)), F.lit(""))
    count = lambda c, x: F.length(c) - F.length(F.replace(c, x, F.lit("")))
    own = F.array_distinct(F.filter(F.split(a, ""), lambda x: x != ""))
    common = F.aggregate(own, F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    return F.when(F.length(a) + F.length(b) == 0, 1.0).otherwise(2.0 * common / (F.length(a) + F.length(b)))


def path_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\\", "/"))


def line_of(text: Column, offset: Column) -> Column:
    """Line number, from 1, of a character offset."""
    return (F.length(F.substr(text, F.lit(1), offset)) - F.length(F.replace(F.substr(text, F.lit(1), offset), F.lit("\n"), F.lit("")))).cast("bigint") + 1


def token_count(c: Column) -> Column:
    """Words and single signs: a deterministic stand-in for a model's tokenizer."""
    return F.size(F.regexp_extract_all(c, F.lit(r"(\w+|[^\w\s])"), 1)).cast("bigint")


def windows(lines: Column, n: int = 6) -> Column:
    """Digests of every n consecutive lines; none if there are fewer. The lines are bound once, or each window would split the text anew."""

    def own(v: Column) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.greatest(F.size(v) - n + 1, F.lit(1))), lambda i: F.md5(F.array_join(F.slice(v, i, n), "\n")))
        return F.when(F.size(v) >= n, F.array_distinct(some)).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(lines), own), 0)


def code_lines(code: Column, least: int = 12, comments: bool = True) -> Column:
    """Trimmed lines of at least that many characters; with comments, those that start one or an include are left out."""
    lines = F.transform(F.split(code, LINE_BREAK, -1), lambda x: F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", ""))
    long = F.filter(lines, lambda x: F.length(x) >= least)
    return F.filter(long, lambda x: ~x.rlike(r"^(//|/\*|\*|#include)")) if comments else long


def glob(pattern: str) -> str:
    """A case-sensitive shell pattern as a regular expression; * also matches a slash."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2)
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = end
        else:
            out += c if c.isalnum() or c == "_" else "\\" + c
        i += 1
    return f"(?s)^{out}$"


def matches_any(c: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(glob(p))
    return out


def selects(c: Column, include: list[str], exclude: list[str]) -> Column:
    return matches_any(c, include) & ~matches_any(c, exclude)


def conversation(system: Column, user: Column, assistant: Column) -> Column:
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(turn("system", system), turn("user", user), turn("assistant", assistant))
