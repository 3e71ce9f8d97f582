"""The pipeline operators on small fixtures: brute force, exact round trips, held-out accuracy, and awkward rows."""

import glob
import hashlib
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ticketweave.llm import chat, exact_dedup, html_text, licenses, mixing, near_dedup, packing, perplexity, queries, token_files, toxicity
from ticketweave.llm.common import settle
from ticketweave.llm.tokens import ChunkEncoder
from tokenizers import Tokenizer

ROOT = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, row int"
AWKWARD = [
    (1, None, None, None, None, 1, 1), (2, "", "en", "a", 0, 1, 1), (3, " \n\t ", "en", "a", 4, 1, 1), (4, "Two words", "en", "b", 9, 1, 1), (4, "Two words", "en", "b", 9, 1, 1),
    (5, "two WORDS", "xx", "b", 9, 1, 1), (None, "two words", "en", "b", 9, 1, 1), (6, "É ünï " * 3000, "fr", "c", 18000, 1, 1), (7, "É ünï " * 3000 + "x", "fr", None, 18001, 1, 1),
    (8, "all rights reserved cc by cc by <|turn|> </s>", "en", "c", 40, 1, 1), (9, "a b c d e f g h i j " * 10, "en", "c", 200, 1, 1),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{ROOT}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_main_text_leaves_everything_else():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="with-sidebar"><header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav>
    <div class="cookie-notice">We use cookies</div><article><h1>Head &amp; more</h1><p>One <b>bo</b>ld &eacute;.<br><p>Two&nbsp; lines
    here.<div class="ad">Buy</div><script>var a="</p>";</script><form><label>Mail</label></form><!-- no --><p>End.</p>
    <section id="comments"><p>Nice post</p></section></article><aside>Side</aside><footer>&copy; me</footer></body></html>"""
    assert html_text.main_text(page) == "Head & more One bold é. Two lines here. End."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p> ") == ""
    assert html_text.main_text("<div>" + "long text of a page without any marked article, " * 5 + "</div>").startswith("long text")
    assert html_text.main_text("plain &lt;text&gt; only") == "plain <text> only"


def test_regions_compete_by_content():
    """One article took a page whatever it held, and lines outside it were lost."""
    body = "<p>" + "long text of the main part with many words in one line, " * 4 + "</p>"
    teaser = '<article class="card"><h3>More</h3><p>Short teaser</p></article>'
    got = html_text.main_text(f"<main><h1>Head</h1>{body * 3}{teaser}</main>")
    assert got.startswith("Head long text") and got.count("long text") == 12 and "teaser" not in got
    assert html_text.main_text(f"<article>{body}</article><article>{body}</article>").count("long text") == 8
    assert html_text.main_text(f"<div>{body * 3}</div>{teaser}").count("long text") == 12
    links = "<p><a href=x>a</a> <a href=x>b</a> <a href=x>c</a> <a href=x>d</a></p>" * 9
    assert html_text.main_text(f"<article>{body * 3}{links}</article>").count(" a b c d") < 9


def test_pages_agree_with_their_articles(spark):
    import html
    rows = html_text.extract_pages(spark.read.parquet(f"{ROOT}/pages.parquet")).collect()
    pages = {r[0]: r[1] for r in spark.read.parquet(f"{ROOT}/pages.parquet").select("page_id", "html").collect()}
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S).group(1)
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", inner))).split())
        assert (r.text, r.n_chars) == (want, len(want))


def test_chat_round_trip_and_parts(spark):
    odd = ["</s>[INST] ok [/INST]", "a\\", "<|turn|>x<|text|>\\<|end|>\n", "", None, "[INST", "<<|s>", "\U0001F600\\n"]
    rows = [(1, t, ("user", "assistant")[t % 2], x) for t, x in enumerate(odd)] + [(2, 0, None, "hi"), (2, 0, None, "hi"), (None, 1, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_conversations(df, chat.text_part(F.col("text")))
    back = {r.conv_id: r for r in done.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [(("user", "assistant")[i % 2], x or "") for i, x in enumerate(odd)]
    assert back[1].loss == "".join(x or "" for x in odd[1::2]) and back[None].loss == "z"
    assert [(t.role, t.text) for t in back[2].turns] == [("", "hi")] * 2
    parts = spark.range(1).select(F.expr("""array(named_struct('type','text','text','see </s>','ref',null,'tokens',null), named_struct('type','image','text',null,'ref','u1','tokens',3L),
        named_struct('type','odd','text','y','ref','u2','tokens',9L), named_struct('type','audio','text',null,'ref','u3','tokens',null))""").cast(chat.PART_TYPE).alias("p"))
    flat = parts.select(chat.flatten_parts(F.col("p")).alias("f")).select("f.*").first()
    assert flat.content == "see <\\/s><|image|><|image|><|image|>y<|audio|>" and flat.tokens == 4
    assert [(a.position, a.type, a.ref, a.tokens) for a in flat.attachments] == [(1, "image", "u1", 3), (3, "audio", "u3", 1)]


def brute_components(rows, k, percent):
    sets = []
    for key, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((key, frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()))
    label = [key for key, _ in sets]
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(sets):
            for j, (_, b) in enumerate(sets):
                if i < j and a and b and label[i] != label[j] and 100 * len(a & b) >= percent * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return Counter((key, len(s), lab) for (key, s), lab in zip(sets, label))


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, k, percent):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    rows = [(0, None), (1, ""), (2, "one two"), (3, "ONE two"), (4, " ".join(base)), (5, " ".join(base))]
    for i in range(6, 60):  # a chain of ever more edited copies, and short texts
        edited = list(base)
        for _ in range(rng.integers(0, 4)):
            edited[rng.integers(0, 60)] = f"x{rng.integers(0, 9)}"
        rows.append((i, " ".join(edited[: int(rng.integers(3, 61)) if i % 3 == 0 else 60])))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=k, percent=percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, k, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_awkward_rows(spark, awkward):
    got = near_dedup.near_duplicates(awkward).collect()
    assert len(got) == len(AWKWARD) and sum(r.component_id == 4 for r in got) == 4
    kept = near_dedup.keep_one_of_near(awkward)
    assert kept.columns == awkward.columns and near_dedup.near_duplicates(awkward.limit(0)).count() == 0


def test_near_duplicates_with_null_and_repeated_keys(spark):
    """A null key lost a link, and two texts under one key were taken for one document."""
    base = [f"w{i}" for i in range(300)]
    edit = lambda at: " ".join(["other" if i == at else w for i, w in enumerate(base)])
    far = " ".join(f"v{i}" for i in range(300))
    rows = [(5, " ".join(base), "a"), (None, edit(150), "b"), (7, edit(40), "c"), (7, far, "d"), (8, far + " more", "e"), (None, "quite alone here", "f"), (9, None, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string")
    got = {r.mark_: (r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, words=3, percent=85).withColumnRenamed("mark", "h").join(
        docs.select(F.col("mark").alias("mark_"), F.xxhash64("text").alias("h")), "h").collect()}
    assert got == {"a": (5, True), "b": (5, False), "c": (5, False), "d": (7, True), "e": (7, False), "f": (None, True), "g": (9, True)}
    kept = near_dedup.keep_one_of_near(docs, words=3, percent=85)
    assert kept.columns == docs.columns and sorted(r.mark for r in kept.collect()) == ["a", "d", "f", "g"]


def test_a_group_around_the_threshold_is_whole(spark):
    """Many copies of one text, each edited so that about a third of the pairs are links: rounds of pivots, then the rest."""
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(160):
        text = list(base)
        for _ in range(rng.integers(1, 5)):
            text[rng.integers(0, 120)] = f"x{rng.integers(0, 10_000)}"
        rows.append((i, " ".join(text)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=5, percent=80).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 5, 80)


def check_pieces(pieces, ids_of, window):
    for doc in {p.doc_id for p in pieces}:
        mine = sorted((p for p in pieces if p.doc_id == doc), key=lambda p: p.start)
        want = ids_of[doc]
        assert Counter(x for p in mine for x in p.ids) == Counter(want * (sum(p.length for p in mine) // len(want)))
        assert all(p.ids == want[p.start:p.start + p.length] and p.doc_tokens == len(want) for p in mine)
    for seq in {p.sequence_id for p in pieces}:
        at = 0
        for p in sorted((p for p in pieces if p.sequence_id == seq), key=lambda p: p.offset):
            assert p.offset == at and p.length == len(p.ids)
            at += p.length
        assert at <= window


def test_packing(spark, awkward, documents):
    path = queries.tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for df, window in ((awkward, 64), (documents, 4096)):
        ids = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [2] for r in df.collect()}
        pieces = packing.pack(df, path, window=window, open_windows=16).collect()
        check_pieces(pieces, ids, window)
        used = sum(p.length for p in pieces)
        assert used == sum(len(ids[r.doc_id]) for r in df.collect())
        assert len({p.sequence_id for p in pieces}) * window <= 1.15 * used + window
    assert packing.pack(awkward.limit(0), path).count() == 0


def test_mix_meets_targets(spark, documents, awkward):
    for df in (documents, awkward):
        rows = df.select("doc_id", "text", "source").collect()
        size = Counter()
        for r in rows:
            size[r.source] += len(words(r.text))
        order = sorted(size, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        target, open_, left = {}, set(order), 1.5 * sum(size.values())
        while open_:
            level = left / sum(weight[s] for s in open_)
            full = {s for s in open_ if level * weight[s] > 2 * size[s]}
            if not full:
                target.update({s: level * weight[s] for s in open_})
                break
            target.update({s: 2.0 * size[s] for s in full})
            left, open_ = left - sum(2 * size[s] for s in full), open_ - full
        got = mixing.mix(df).select("doc.source", "doc.text", "size", "source_size", "target", "taken").collect()
        assert len(got) == len(rows)
        taken = Counter()
        for r in got:
            assert r["size"] == len(words(r.text)) and r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r["size"]
            taken[r.source] += r.taken
        assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in order)
        again = mixing.mix(df.repartition(5)).select("id", "size", "taken").collect()
        assert Counter(map(tuple, again)) == Counter(map(tuple, mixing.mix(df).select("id", "size", "taken").collect()))
        mixed = mixing.mixed_documents(df)
        assert mixed.columns == df.columns and sum(len(words(r.text)) for r in mixed.collect()) == sum(taken.values())
    assert mixing.mix(awkward.limit(0)).count() == 0


def brute_rules(text):
    w, lines, seen, dup = words(text), (text or "").split("\n"), set(), 0
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    for line in lines:
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_rules(spark, documents, awkward):
    for df in (documents, awkward):
        texts = Counter((r.doc_id, *brute_rules(r.text)) for r in df.collect())
        got = perplexity.quality_rules(df).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == texts
        for r in got:
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
            assert r.kept == (not r.base_failed and r.band_low <= r.log_perplexity <= r.band_high)
    assert perplexity.quality_rules(awkward.limit(0)).count() == 0


def discounts(counts):
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more (index 0 is 0), from the counts of counts."""
    n1, n2, n3, n4 = (float(sum(c == k for c in counts)) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [0.0, *[min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1)]]


def brute_kneser_ney(texts, order):
    """Log perplexity of each text under the interpolated estimate of all of them, with dictionaries."""
    grams_of = lambda t: [tuple(("\0start",) * (order - 1) + tuple(t))[i:i + order] for i in range(len(t))]
    levels = [Counter(g for t in texts for g in grams_of(t))]
    for _ in range(order - 1):
        levels.append(Counter(g[1:] for g in levels[-1]))
    below = None
    for counts in reversed(levels):
        d = discounts(list(counts.values()))
        total, left = Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3)]
        below = {g: (c - d[min(c, 3)] + left[g[:-1]] * (1 / (len(counts) + 1) if below is None else below[g[1:]])) / total[g[:-1]] for g, c in counts.items()}
    return [-np.mean([np.log(below[g]) for g in grams_of(t)]) if t else None for t in texts]


def test_code_points_of_any_script_make_the_model(spark):
    """Case, marks and letters beyond ASCII were one symbol each, so texts of equal shape scored alike."""
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list(a), n)) for a, n in (("абвгд .", 900), ("абвгд .", 400), ("абвгд .", 50), ("жзик! ", 60), ("語言模型，", 80), ("aB#$ 😀", 90), ("", 0))]
    rows = spark.createDataFrame([(i, t, "ru") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r.log_perplexity for r in perplexity.quality_rules(rows, least_words=0, repeat_percent=100).collect()}
    for i, want in enumerate(brute_kneser_ney(texts, perplexity.WIDE)):
        assert got[i] is None if want is None else abs(got[i] - want) < 1e-5
    pair = ["абв" * 30, "где" * 30]
    assert len(np.intersect1d(*(perplexity.hashed(*perplexity.wide_grams([t])) for t in pair))) == 0


def test_unclosed_elements_cost_no_search():
    """Each end tag once looked through all open elements: 357 KB of these took 7 seconds."""
    import time
    page = "<article><p>Start of it.</p>" + "<li><b>one</b> word" * 100_000
    begin = time.perf_counter()
    text = html_text.main_text(page)
    assert text.startswith("Start of it.") and text.count("one word") == 100_000
    assert time.perf_counter() - begin < 30


def test_models_do_not_learn_from_failed_documents(spark, monkeypatch):
    """Perplexities of good texts are those of the good texts alone; several packs a chunk, one of a text beyond their size."""
    monkeypatch.setattr(perplexity, "PACKED", 2000)
    rng = np.random.default_rng(6)
    say = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))
    good = [say(int(n)) for n in rng.integers(25, 900, 30)]
    bad = ["#@! 12" * 5, "same words again and again " * 40, "", None]
    rows = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good + bad)], "doc_id long, text string, lang string").repartition(4)
    got = {r.doc_id: r for r in perplexity.quality_rules(rows).collect()}
    for i, want in enumerate(brute_kneser_ney(good, perplexity.WIDE)):
        assert not got[i].base_failed and abs(got[i].log_perplexity - want) < 1e-5
    assert all(got[30 + i].base_failed and got[30 + i].log_perplexity is None and not got[30 + i].kept for i in range(4))


def test_every_language_has_its_own_band(spark):
    """From the 16th language on, all shared one model and band with null."""
    rng = np.random.default_rng(4)
    say = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))
    rows = [(k, say(2000), f"l{k:02d}") for k in range(20)] + [(20, say(30), "small"), (21, say(30), None)]
    got = {r.doc_id: r for r in perplexity.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    # A language of one document has that document in the middle of its band.
    assert all(abs((got[k].band_low + got[k].band_high) / 2 - got[k].log_perplexity) < 1 / perplexity.BINS for k in range(20))
    middles = [(got[k].band_low + got[k].band_high) / 2 for k in (20, 21)]
    assert abs(middles[0] - middles[1]) < 1e-9 and len(got) == 22


def test_licenses_of_awkward_rows(spark, awkward):
    got = {r.doc_id: r for r in licenses.license_scan(awkward).collect()}
    r = got[8]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.score) == (3, 0, 5, "cc-by,reserved", 1.0) and "no-rights" in r.labels
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].labels, got[1].score) == (0, 0, None, "", 0.0)
    text = "Permission is granted, free of charge, to any person obtaining a copy of this Software hereby!"
    one = licenses.license_scan(spark.createDataFrame([(1, "x\n" + text)], "doc_id long, text string")).first()
    assert one.labels == "mit-notice" and one.base_labels == "" and 0.8 <= one.score <= 1 and one.blocks[0].block == 1
    assert licenses.license_scan(awkward.limit(0)).count() == 0


def test_licenses_wrapped_over_lines(spark):
    """Notices wrapped over lines had no label; words that are only near a line's end are still no notice."""
    bsd = ["Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that"]
    texts = ["# Copyright\n# " + "\n#\n# ".join(bsd) + "\nthe following", "\n".join(" ".join(bsd).split()), "Released under\n\nthe MIT license", "mit von vielen anderen Worten " * 3 + "\nlicensed under the apache license",
             "redistribution and use\n" + "other words of a text\n" * 9 + "in source and binary forms, with or without modification, are", "x" * 9 + "\n"]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(6)] == ["bsd", "bsd", "mit", "", "", ""]
    assert [got[i].score for i in range(3)] == [1.0, 1.0, 1.0] and got[0].blocks[0].block == 1


def test_token_files_round_trip(spark, awkward, scratch):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for mode in ("bit", "byte"):
        folder = f"file://{scratch}/{mode}"
        token_files.write_token_files(awkward, folder, path, block_ids=1000, mode=mode)
        got = sorted(token_files.read_documents(spark, folder).collect(), key=lambda r: r.start)
        at = 0
        for r in got:
            assert r.start == at and r.n_tokens == len(r.ids)
            at += r.n_tokens
        assert [r.doc_id for r in got] == sorted((r[0] for r in AWKWARD), key=lambda x: (x is not None, x or 0))
        want = Counter((r[0], tuple(library.encode(r[1] or "", add_special_tokens=False).ids + [2])) for r in AWKWARD)
        assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
        assert Counter(x for r in token_files.read_token_files(spark, folder).collect() for x in r.ids) == Counter(x for r in got for x in r.ids)
    ids = np.array([0, 1, 50256, 7], dtype="<u4")
    assert all((token_files.from_planes(token_files.to_planes(ids, m)[1], 4, m) == ids).all() for m in ("bit", "byte"))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunks_equal_whole_texts(name, documents):
    e = ChunkEncoder(queries.tokenizer_path(name), limit=500)
    odd = ["", " ", "\n\n a", "a  b\n\n c ", "\tx", "!!!a \x01b", "é x", "don't I'll 12 3,4 !?\n", "DON'T É ßSS²", "x y", "a\r\nb", "t ", "<|endoftext|> q", "İ ǅ", "\nA.\nB, c", "汉字 Σας", "a\x1cb", "a \nb\n c"]
    for text in odd + [r.text for r in documents.select("text").limit(150).collect()]:
        ids = e.tokenizer.encode(text, add_special_tokens=False).ids
        assert e.encode(text) == np.array(ids, dtype="<u4").tobytes(), text[:60]


def test_exact_duplicates(spark, awkward):
    long = "q" * 10_000
    rows = AWKWARD + [(20, long, "en", "a", 1, 1, 1), (21, long.upper(), "en", "a", 1, 1, 1), (22, long[:-1] + "r", "en", "a", 1, 1, 1), (23, "Q" + long[1:4096], "en", "a", 1, 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = exact_dedup.exact_duplicates(df, block_bytes=64).collect()
    by = {}
    for r in rows:
        by.setdefault(lower(r[1]), []).append(r[0])
    want = Counter()
    for text, keys in by.items():
        keys.sort(key=lambda k: (k is not None, k or 0))
        digest = hashlib.sha256(text.encode()).hexdigest()
        want.update((k, keys[-1], len(keys), i == len(keys) - 1, digest) for i, k in enumerate(keys))
    assert Counter(tuple(r) for r in got) == want
    kept = exact_dedup.keep_one_of_equal(df)
    assert kept.columns == df.columns and kept.count() == len(by)
    assert exact_dedup.exact_duplicates(awkward.limit(0)).count() == 0


def test_crowded_buckets_are_told_apart(spark):
    items = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "c")], "bucket long, block string")
    got = exact_dedup._places(items, ["block"], "t").collect()
    assert {(r.bucket, r.block, r.place) for r in got} == {(1, "a", 0), (1, "b", 1)}


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(2)
    e, step, start = rng.normal(size=(1, 5)), rng.normal(size=(2, 2)), rng.normal(size=2)
    total, on = 0.0, np.zeros(5)
    for path in range(32):
        y = [(path >> t) & 1 for t in range(5)]
        p = np.exp(start[y[0]] + sum(e[0, t] * y[t] for t in range(5)) + sum(step[y[t], y[t + 1]] for t in range(4)))
        total, on = total + p, on + p * np.array(y)
    assert np.allclose(toxicity.forward_backward(e, step, start)[2][0], on / total)


def test_one_chain_over_texts_of_any_length():
    rng = np.random.default_rng(7)
    step, start = np.log([[0.95, 0.05], [0.2, 0.8]]), np.log([0.9, 0.1])
    chains = [rng.normal(-1, 3, n) for n in (0, 1, 3, 4, 5, 8, 9, 64, 65, 1000, 5000)]
    for x, got in zip(chains, toxicity.chain_marginals(chains, step, start, width=4)):
        if len(x):
            assert np.allclose(got, toxicity.forward_backward(x[None, :], step, start)[2][0], atol=1e-9)
        assert len(got) == len(x)
    whole = toxicity.chain_marginals(chains, step, start)
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(whole, toxicity.chain_marginals(chains, step, start, width=7)))
    extreme = toxicity.chain_marginals([np.tile([-40.0, 40.0], 3000)], step, start)[0]
    assert np.isfinite(extreme).all() and extreme[1::2].min() > 0.99 > 0.01 > extreme[::2].max()


def test_spans_of_texts_that_change_length_in_lower_case():
    field = toxicity.Field(np.zeros(toxicity.BUCKETS), -9.0, np.zeros((2, 2)), np.zeros(2))
    field.weights[toxicity.bucket("wvile")] = 20.0
    text = "\u0130stanbul " * 100 + "VILE end"
    (score, spans), = toxicity.Scorer(field).score([text])
    assert score > 0.99 and [text[a:b] for a, b, _ in spans] == ["VILE"]


def test_toxicity_of_empty_documents(spark):
    docs, labels = (spark.read.parquet(f"{ROOT}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_documents(docs.limit(0), labels)
    assert got.count() == 0 and got.columns == ["doc_id", "held_out", "score", "predicted", "spans"]


def test_toxicity_held_out_and_awkward(spark, awkward):
    root = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for k, r in got.items())
    pairs = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if r.doc_id in got]
    assert sum(p == t for p, t in pairs) >= 0.9 * len(pairs) and sum(p and not t for p, t in pairs) <= 0.02 * len(pairs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(" " not in texts[k][s.start:s.end] for k, r in got.items() for s in r.spans)
    odd = toxicity.score_documents(awkward, labels.limit(0)).collect()
    assert len(odd) == len(AWKWARD) and all(r.score < 0.5 for r in odd)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    df = queries.QUERIES[name](spark, ROOT)
    cols = sorted(df.columns)
    cur = con.execute(queries.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert Counter(tuple(r[c] for c in cols) for r in df.collect()) == Counter(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall())


def test_pipeline_stages(spark, documents):
    labels = spark.read.parquet(f"{ROOT}/labels.parquet")
    clean = corpus_pipeline.reject_toxic(spark, documents, ROOT)
    assert clean.columns == documents.columns and labels.count() > 0
    one = corpus_pipeline.drop_copies(spark, documents, ROOT)
    assert one.count() == len({lower(r.text) for r in documents.collect()})
    near = corpus_pipeline.drop_near_copies(spark, one, ROOT)
    rows = [(r.doc_id, r.text) for r in one.collect()]
    assert Counter(r.doc_id for r in near.collect()) == Counter(k for k, _, lab in brute_components(rows, 5, 80).elements() if k == lab)
    mixed = corpus_pipeline.mix_sources(spark, near, ROOT)
    assert mixed.columns == documents.columns
    assert corpus_pipeline.run(spark, ROOT).count() > 0


def test_nodes_that_share_bands_are_one_pair(spark):
    """Two nodes that meet in many bands come out of the join once, from the first band they share."""
    rows = spark.createDataFrame([(b, [1, 2, 3, 4], [9, 2, 3, 4]) for b in range(4)], "band int, bands array<long>, bands_b array<long>")
    assert [r[0] for r in rows.filter(near_dedup._first_shared()).select("band").collect()] == [1]


def test_settled_tables_leave_no_shuffle_files(spark):
    """Shuffles of tables written long ago lay on the disk until the driver happened to collect garbage."""
    spark.sparkContext._jvm.System.gc()
    files = lambda: {f for d in re.split(",", spark.conf.get("spark.local.dir", "/tmp")) for f in glob.glob(f"{d}/blockmgr-*/*/shuffle_*.data") + glob.glob(f"{d}/spark-*/**/shuffle_*.data", recursive=True)}
    option, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", files()
    was = spark.conf.get(option)
    kept = [settle(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), f"n{i}") for i in range(3)]
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(option) == was
    assert all(sorted(r["count"] for r in t.collect()) == [142] + [143] * 6 for t in kept[:1]) and kept[1].count() == 7


@pytest.mark.parametrize("few", [1, 3, 1000])
def test_small_and_large_bands_tell_the_same_links(spark, few, monkeypatch):
    """Members of a band meet as they stand, or by their sizes if there are many; the bands are made from the registers."""
    monkeypatch.setattr(near_dedup, "FEW", few)
    monkeypatch.setattr(near_dedup, "ROUNDS", 0)
    rng, rows = np.random.default_rng(3), []
    for i in range(60):
        text = [f"w{k}" for k in range(100 + i % 12)]
        for _ in range(rng.integers(0, 4)):
            text[rng.integers(0, 100)] = f"x{rng.integers(0, 10_000)}"
        rows.append((i, " ".join(text)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=5, percent=80).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 5, 80)


def test_packed_texts_stay_in_their_buckets(spark, monkeypatch):
    """The packed texts were shuffled to their chunk's n-grams, a second copy on the disk; a task's texts are chunks of bounded size."""
    monkeypatch.setattr(perplexity, "CHUNK", 3000)
    plans, measured = [], perplexity.measure

    def watched(*args):
        out = measured(*args)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        plans.append(args[0].select("chunk").distinct().count())
        return out

    monkeypatch.setattr(perplexity, "measure", watched)
    rng = np.random.default_rng(9)
    good = [" ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(int(n))) for n in rng.integers(25, 200, 1200)]
    rows = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good)], "doc_id long, text string, lang string").repartition(1)
    before = {t.name for t in spark.catalog.listTables()}
    got = {r.doc_id: r for r in perplexity.quality_rules(rows).collect()}
    side = plans[0][plans[0].index("FlatMapCoGroups"):].split("- Exchange")[0]
    assert "Bucketed: true" in side or "SelectedBucketsCount" in side, plans[0]
    assert plans[1] == 3  # batches of 512 rows, each beyond a chunk's size
    assert {t.name for t in spark.catalog.listTables()} == before
    want = brute_kneser_ney(good, perplexity.WIDE)
    assert len(got) == 1200 and all(abs(got[i].log_perplexity - want[i]) < 1e-5 for i in range(0, 1200, 100))
