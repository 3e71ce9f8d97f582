"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license templates.

A block is a line, or a window of words that goes over line ends, as in a wrapped notice. A window is as long as the template
with as many more words as may be missing. A template is found in a block that holds at least ``threshold`` of the template's
distinct words. Words are ordered by how many blocks hold them, rarest first: a block can only qualify if it shares one of a template's rarest
words (prefix filter), has enough template words at all (length filter), and has enough of them left after the first shared
one (positional filter). Only such pairs are met in the join, and each is then verified on its full sets.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketweave.llm.common import ascii_lower, let, settle

#: Words after lower-casing: letters, digits and everything beyond ASCII.
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrases with their labels, and short public license notices.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-notice": "you may not use this file except in compliance with the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike license",
    "cc0": "to the extent possible under law the author has waived all copyright",
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "mit": "released under the mit license",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license",
    "no-rights": "all rights reserved",
}


def template_tokens(templates: Mapping[str, str]) -> dict[str, list[str]]:
    return {label: sorted(set(text.split())) for label, text in templates.items()}


def needed(size: int, threshold: float) -> int:
    return max(1, math.ceil(size * threshold - 1e-9))


def window_length(template: str, threshold: float) -> int:
    """Words of a window that goes over line ends."""
    return math.ceil(len(template.split()) / threshold - 1e-9)


def _text(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _places(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    starts = F.when(F.size(words) >= len(parts), F.sequence(F.lit(0), F.size(words) - len(parts))).otherwise(F.array().cast("array<int>"))

    def stands(i: Column) -> Column:
        ok = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            ok = ok & (F.get(words, i + k) == part)
        return ok

    return F.filter(starts, stands)


def scan_blocks(docs: DataFrame, vocabulary: Sequence[str], least: int, phrases: Mapping[str, str] = PHRASES, key: str = "doc_id", text: str = "text",
                templates: Mapping[str, str] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """One settled row per row of ``docs``: row, doc_id, n_words, places (label, starts), blocks (block, tokens, words, own).

    ``blocks`` has the distinct ``vocabulary`` words of each line with at least ``least`` of them, and no other text; its
    ``words`` are null. It also has the words around the end of each line, in order, where they hold enough of a template; ``own`` of them are the line's.
    """
    reach = max(window_length(t, threshold) for t in templates.values()) - 1
    kind = "array<struct<block:int,tokens:array<string>,words:array<string>,own:int>>"
    hint = "|".join(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+".join(p.split()) for p in phrases)

    def enough(tokens: Column) -> Column:
        found = F.lit(False)
        for ts in template_tokens(templates).values():
            found = found | (F.size(F.array_intersect(tokens, _text(ts))) >= needed(len(ts), threshold))
        return (F.size(tokens) >= least) & found

    def over_ends(found: Column) -> Column:
        """Around the end of each line: its last ``reach`` words and as many of the lines after it."""
        def around(lines: Column) -> Column:
            def one(line: Column, i: Column) -> Column:
                own = F.slice(line["w"], F.greatest(F.size(line["w"]) - reach + 1, F.lit(1)), reach)
                after = F.get(lines, i + 1)["w"]
                more = F.when(F.size(after) >= reach, F.slice(after, 1, reach)).otherwise(
                    F.slice(F.flatten(F.transform(F.slice(lines, i + 2, reach), lambda x: F.slice(x["w"], 1, reach))), 1, reach))
                return let(F.concat(own, more), lambda words: F.struct(line["i"].alias("block"), F.array_intersect(words, _text(vocabulary)).alias("tokens"), words.alias("words"), F.size(own).alias("own")))
            return F.filter(F.transform(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), one), lambda b: enough(b["tokens"]))
        return let(F.filter(F.transform(found, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: F.size(x["w"]) > 0), around)

    def read(low: Column) -> Column:
        lines = F.transform(F.split(low, "\n"), lambda line: F.regexp_extract_all(line, F.lit(TOKEN), 0))
        return let(lines, lambda found: F.struct(
            F.aggregate(found, F.lit(0).cast("long"), lambda n, w: n + F.size(w)).alias("n_words"),
            F.when(F.regexp_like(low, F.lit(hint)), let(F.flatten(found), lambda words: F.array(
                *[F.struct(F.lit(label).alias("label"), _places(words, p).alias("starts")) for p, label in phrases.items()]))).alias("places"),
            F.concat(F.filter(F.transform(found, lambda w, i: F.struct(i.alias("block"), F.array_intersect(w, _text(vocabulary)).alias("tokens"), F.lit(None).cast("array<string>").alias("words"), F.lit(None).cast("int").alias("own"))),
                              lambda b: F.size(b["tokens"]) >= least).cast(kind), over_ends(found).cast(kind)).alias("blocks")))

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), let(ascii_lower(F.coalesce(F.col(text), F.lit(""))), read).alias("r"))
    return settle(rows.select("row", "doc_id", "r.n_words", "r.places", "r.blocks"), "license-blocks")


def template_matches(scanned: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """(row, block, label, containment) of every block of ``scan_blocks`` that reaches ``threshold`` of a template."""
    tokens = template_tokens(templates)
    blocks = scanned.select("row", F.explode("blocks").alias("b")).select("row", "b.block", "b.tokens", "b.words", "b.own")
    # One row per template word, at most; the templates are a parameter.
    counted = {r[0]: r[1] for r in blocks.select(F.explode("tokens").alias("t")).groupBy("t").count().collect()}
    order = sorted({t for ts in tokens.values() for t in ts}, key=lambda t: (counted.get(t, 0), t))
    rank = {t: i for i, t in enumerate(order)}
    ranked = {label: sorted(rank[t] for t in ts) for label, ts in tokens.items()}
    heads = [(label, len(ts), needed(len(ts), threshold), i, t) for label, ts in ranked.items() for i, t in enumerate(ts[: len(ts) - needed(len(ts), threshold) + 1])]
    prefix = scanned.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(label).alias("label"), F.lit(m).alias("m"), F.lit(o).alias("o"), F.lit(i).alias("i"), F.lit(t).alias("token"), F.array(*[F.lit(x) for x in ranked[label]]).alias("wanted"),
                 _text(tokens[label]).alias("named"), F.lit(window_length(templates[label], threshold)).alias("length"))
        for label, m, o, i, t in heads])))
    ranks = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])
    rare = sorted({order[t] for _, _, _, _, t in heads})
    met = blocks.filter(F.arrays_overlap("tokens", _text(rare))).select("row", "block", "words", "own", F.array_sort(F.transform("tokens", lambda t: F.element_at(ranks, t))).alias("have"))
    met = met.select("row", "block", "words", "own", "have", F.size("have").alias("n"), F.posexplode("have").alias("j", "token"))
    met = met.join(F.broadcast(prefix), "token")  # a few rows for each template
    left = 1 + F.least(F.col("m") - F.col("i") - 1, F.col("n") - F.col("j") - 1)
    shared = F.size(F.array_intersect("have", "wanted"))
    pairs = met.filter((F.col("n") >= F.col("o")) & (left >= F.col("o")) & (shared >= F.col("o")))
    # Over line ends, the words must also stand within one window, which starts at a template word of its line.
    starts = F.filter(F.sequence(F.lit(1), F.col("own")), lambda i: F.array_contains("named", F.get("words", i - 1)))
    windows = F.transform(starts, lambda i: F.size(F.array_intersect(F.slice("words", i, F.col("length")), F.col("named"))))
    held = pairs.withColumn("held", F.when(F.col("words").isNull(), shared).otherwise(F.array_max(windows))).filter(F.col("held") >= F.col("o"))
    return held.groupBy("row", "block", "label").agg(F.max(F.col("held") / F.col("m")).alias("containment"))


def license_scan(
    docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES, threshold: float = 0.8, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    ``n_base`` counts the places where a phrase's words stand in a row; ``labels`` adds the templates found; ``blocks`` has
    (block, label, containment) of each. ``score`` is 1 where a phrase stands, else the largest containment found, else 0.
    A null or empty text has no words, no labels and score 0; rows that repeat are scanned each; an empty table gives none.
    """
    vocabulary = sorted({t for ts in template_tokens(templates).values() for t in ts})
    least = min(needed(len(ts), threshold) for ts in template_tokens(templates).values())
    scanned = scan_blocks(docs, vocabulary, least, phrases, key, text, templates, threshold)
    found = template_matches(scanned, templates, threshold).groupBy("row").agg(
        F.collect_set("label").alias("found"), F.max("containment").alias("best"), F.sort_array(F.collect_list(F.struct("block", "label", "containment"))).alias("blocks"))
    places = F.coalesce(F.col("places"), F.array().cast("array<struct<label:string,starts:array<int>>>"))
    starts = F.flatten(F.transform(places, lambda p: p["starts"]))
    base = F.array_sort(F.array_distinct(F.transform(F.filter(places, lambda p: F.size(p["starts"]) > 0), lambda p: p["label"])))
    rows = scanned.select("row", "doc_id", "n_words", starts.alias("starts"), base.alias("base")).join(found, "row", "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))))
    return rows.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.when(F.size("starts") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), "blocks")
