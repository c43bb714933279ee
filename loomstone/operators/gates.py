"""Data-quality assertions as rows, and the gate that judges a repair by its diagnostics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.text import DIRECTIVES, code_lines, normalised, windows


def check(rows: DataFrame, name: str, value: Column, good: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row: name, ok, detail. Without `good` the value has to be 0."""
    ok = good or (lambda v: v == 0)
    return rows.agg(value.alias("_v")).select(F.lit(name).alias("name"), ok(F.col("_v")).alias("ok"), F.col("_v").cast("string").alias("detail"))


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def failed(checks: DataFrame) -> DataFrame:
    return checks.where(~F.col("ok"))


def violations(rows: DataFrame, **counts: Column) -> DataFrame:
    """One row for each count over all rows, in one pass: its name with blanks for underscores, whether it is 0, and the count."""
    one = rows.agg(*(F.coalesce(c, F.lit(0)).cast("bigint").alias(name) for name, c in counts.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(name.replace("_", " ")).alias("name"), (F.col(name) == 0).alias("ok"), F.col(name).cast("string").alias("detail")) for name in counts))))


def repeated(rows: DataFrame, name: str, *by: Column) -> DataFrame:
    """How many rows repeat another one's values: groups are counted with partial sums, so a value of any weight is no burden."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    return violations(sizes, **{name: F.sum(F.col("_n") - 1)})


def spread(rows: DataFrame, name: str, by: str, over: str = "split") -> DataFrame:
    """How many values of one column occur with several of another."""
    return violations(rows.groupBy(by).agg((F.min(over) != F.max(over)).alias("_many")), **{name: F.count_if("_many")})


def roles_fit() -> Column:
    return F.transform("messages", lambda m: m["role"]) == F.array(*map(F.lit, ("system", "user", "assistant")))


def balanced(rows: DataFrame, subset: DataFrame, name: str, positive: Column) -> DataFrame:
    """Whether a subset holds only ids of its table, and as many positive rows as others."""
    strange = subset.join(rows.select("id"), "id", "left_anti").agg(F.count("*").alias("_s"))
    both = subset.agg(F.abs(2 * F.count_if(positive) - F.count("*")).alias("_d")).crossJoin(F.broadcast(strange))  # one row each
    return violations(both, **{name: F.sum(F.col("_d") + F.col("_s"))})


def verify_built(detection: DataFrame, fixing: DataFrame, matched: dict[str, DataFrame], code: Callable[[Column], Column], vocabulary: list[str], splits: dict[str, str], markers: list[str], most: int, recount: Column) -> DataFrame:
    """The checks of a built dataset, each recomputed from its rows: (name, ok, detail).

    detection: id, engine, split, checks, findings(check, line), file_error_free, start_line, end_line, n_tokens, messages. fixing: id,
    engine, split, fixed_checks, n_tokens, messages. `code` takes the source out of a user message; `splits` names the split of an
    entity, train for the others.
    """
    checks, known = F.col("checks"), F.array(*map(F.lit, vocabulary))
    answer = F.get("messages", 2)["content"]
    listed = F.from_json(F.get_json_object(answer, "$.checks"), "array<string>")
    good = (F.json_object_keys(answer) == F.array(F.lit("checks"))) & (listed == checks) & (checks == F.array_sort(F.array_distinct(checks))) & (F.size(F.array_except(checks, known)) == 0) & roles_fit()
    own = code(F.get("messages", 1)["content"])
    home = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in splits.items() for x in pair)), F.col("engine")), F.lit("train"))
    lines = F.col("end_line") - F.col("start_line") + 1
    rows = violations(
        detection,
        rows_in_every_split=3 - F.bit_count(F.bit_or(F.when(F.col("split") == "train", 1).when(F.col("split") == "val", 2).otherwise(4))),
        answers_are_JSON_with_sorted_and_known_checks=F.count_if(~F.coalesce(good, F.lit(False))),
        one_prompt_throughout=(F.min(F.get("messages", 0)["content"]) != F.max(F.get("messages", 0)["content"])).cast("int"),
        no_markers_inside_the_code=F.count_if(reduce(lambda x, y: x | y, (F.contains(own, F.lit(m)) for m in markers))),
        rows_are_in_the_split_of_their_entity=F.count_if(F.col("split") != home),
        evaluation_rows_come_from_clean_files=F.count_if((F.col("split") != "train") & ~F.col("file_error_free")),
        findings_lie_inside_their_function=F.count_if(F.exists("findings", lambda f: (f["line"] < 1) | (f["line"] > lines))),
        findings_are_among_the_checks=F.count_if(F.exists("findings", lambda f: ~F.array_contains(checks, f["check"]))),
        token_counts_are_fresh=F.count_if(F.col("n_tokens") != recount),
        conversations_fit=F.count_if(F.col("n_tokens") > most),
    )
    target = F.get("messages", 2)["content"]
    pairs = violations(
        fixing,
        fixing_rows_are_in_the_split_of_their_entity=F.count_if(F.col("split") != home),
        fixing_conversations_fit=F.count_if(F.col("n_tokens") > most),
        targets_differ_from_inputs=F.count_if(normalised(code(F.get("messages", 1)["content"])) == normalised(target)),
        fixing_rows_name_what_was_fixed=F.count_if(F.size("fixed_checks") == 0),
    )
    return report(
        rows,
        pairs,
        repeated(detection, "no_code_appears_twice", F.md5(normalised(own)).alias("_h")),
        repeated(detection, "ids_are_unique", F.col("id")),
        spread(detection, "no_entity_in_two_splits", "engine"),
        *(balanced(detection.where(F.col("split") == name), part, f"{name}_subset_is_balanced", F.size("checks") > 0) for name, part in matched.items()),
    )


def verify_cleaned(rows: DataFrame, matched: dict[str, DataFrame], code: Callable[[Column], Column], fields: list[str], categories: list[str], markers: list[str], most: int, recount: Column, rendered: Column, end: str) -> DataFrame:
    """The checks of a cleaned dataset: (name, ok, detail). rows: id, group, split, smells, severity, checks, n_tokens, messages.

    `rendered` is a row's conversation as the model reads it, which has to end with the answer and `end`, so that it survives truncation from
    the right. Windows of six code lines may not be shared between splits.
    """
    answer, own, smells = F.get("messages", 2)["content"], code(F.get("messages", 1)["content"]), F.col("smells")
    said_smells, said_checks = (F.from_json(F.get_json_object(answer, f"$.{k}"), "array<string>") for k in ("smells", "checks"))
    clean = F.size(smells) == 0
    good = (F.json_object_keys(answer) == F.array(*map(F.lit, ("smells", "severity", "checks")))) & (said_smells == smells) & (said_checks == F.col("checks")) & (smells == F.filter(F.array(*map(F.lit, categories)), lambda c: F.array_contains(smells, c))) & (clean == (F.size("checks") == 0)) & (~clean | (F.get_json_object(answer, "$.severity") == "0"))
    extra = set(rows.columns) - {"split"} ^ set(fields)
    glued = r'[A-Za-z0-9_">)]#[ \t]*(?:' + "|".join(DIRECTIVES) + r")\b"
    per_row = violations(
        rows,
        rows_have_the_expected_fields=F.lit(len(extra)) * F.least(F.count("*"), F.lit(1)),
        messages_are_system_and_user_and_assistant=F.count_if(~roles_fit()),
        one_prompt_throughout=(F.min(F.get("messages", 0)["content"]) != F.max(F.get("messages", 0)["content"])).cast("int"),
        answers_are_JSON_in_the_one_schema=F.count_if(~F.coalesce(good, F.lit(False))),
        no_markers_inside_the_code=F.count_if(reduce(lambda x, y: x | y, (F.contains(own, F.lit(m)) for m in markers))),
        no_glued_directives_left=F.count_if(own.rlike(glued)),
        token_counts_are_fresh=F.count_if(F.col("n_tokens") != recount),
        conversations_fit=F.count_if(F.col("n_tokens") > most),
        conversations_end_with_the_answer=F.count_if(~F.endswith(rendered, F.concat(answer, F.lit(end)))),
    )
    shared = rows.select("split", F.explode(windows(code_lines(own), 6)).alias("window"))
    return report(
        per_row,
        repeated(rows, "ids_are_unique", F.col("id")),
        repeated(rows, "no_code_appears_twice", F.md5(normalised(own)).alias("_h")),
        spread(rows, "no_group_in_two_splits", "group"),
        spread(shared, "no_window_of_six_lines_in_two_splits", "window"),
        *(balanced(rows.where(F.col("split") == name), part, f"{name}_subset_is_balanced", F.size("smells") > 0) for name, part in matched.items()),
    )


def repair_gate(diagnostics: DataFrame, key: str, requested: str, witness: str | None = None) -> DataFrame:
    """key, status, added from diagnostics(key, phase, chk, message): inconclusive if the requested check was not there before, or if the
    witness, a check that every analysed function reports, is missing in either phase; rejected if the requested check is still there
    or a diagnostic was added (counted as a bag, without the witness); else passed."""
    phase = lambda name, chk: F.count_if((F.col("phase") == name) & (F.col("chk") == chk))
    own = F.lit(False) if witness is None else F.col("chk") == witness
    more = F.when(own, 0).otherwise(F.count_if(F.col("phase") == "after") - F.count_if(F.col("phase") == "before"))
    seen = {"b": phase("before", requested), "r": phase("after", requested)} | ({} if witness is None else {"x": phase("before", witness), "y": phase("after", witness)})
    counts = diagnostics.groupBy(key, "chk", "message").agg(more.alias("more"), *(c.alias(n) for n, c in seen.items()))
    sums = counts.groupBy(key).agg(F.sum(F.greatest("more", F.lit(0))).alias("added"), *(F.sum(n).alias(n) for n in seen))
    absent = (F.col("b") == 0) if witness is None else (F.col("b") == 0) | (F.col("x") == 0) | (F.col("y") == 0)
    status = F.when(absent, "inconclusive").when((F.col("r") > 0) | (F.col("added") > 0), "rejected").otherwise("passed_static_validation")
    return sums.select(key, status.alias("status"), "added")
