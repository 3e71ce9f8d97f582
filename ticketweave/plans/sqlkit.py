"""Small builders of SQL text for the twins."""

from __future__ import annotations


def q(value: str) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def items(values) -> str:
    return ", ".join(q(v) for v in values)


def any_in(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(w)})" for w in words) + ")"


def count_in(expr: str, words) -> str:
    return "(" + " + ".join(f"contains({expr}, {q(w)})::INTEGER" for w in words) + ")"


def count_re(expr: str, patterns) -> str:
    return "(" + " + ".join(f"regexp_matches({expr}, {q(p)})::INTEGER" for p in patterns) + ")"


def case(rules, default: str) -> str:
    """``rules`` are (condition, value) pairs of SQL text."""
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules) + f" ELSE {default} END"


def table_map(values) -> str:
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in values.items()) + "}"


def words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '\\s+'), lambda w: w <> '')"


def replace_all(expr: str, rules) -> str:
    for p, r in rules:
        r = r.replace("$", "\\")
        expr = f"regexp_replace({expr}, {q(p)}, {q(r)}, 'g')"
    return expr


def union_found(expr: str, patterns, upper: bool = True) -> str:
    parts = [f"regexp_extract_all({expr}, {q(p)}, {g})" for p, g in patterns]
    flat = f"flatten([{', '.join(parts)}])"
    return f"list_transform({flat}, lambda c: upper(c))" if upper else flat
