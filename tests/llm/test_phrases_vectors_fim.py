"""Phrase collocations, near-equal vectors and fill-in-middle against brute force, on awkward rows, and on empty tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ticketweave.llm import embedding_dedup, fill_in_middle, phrases, queries
from tests.llm.test_llm import AWKWARD, SCHEMA, lower


# Fill-in-middle

def told_fim(key, text):
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[8 * i:8 * i + 8], 16) for i in range(4)]
    text = text or ""
    n = len(text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    form = "plain" if not n or re.search("<[PSM]>", text) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    p, m, s = text[:low], text[low:high], text[high:]
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    return (n, form, None if form == "plain" else low, None if form == "plain" else high - low, out, text)


def test_rotation_and_its_inverse():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab<>PSM é漢😀\ń") for _ in range(rng.randrange(40)))
        if re.search("<[PSM]>", text):
            continue
        low, high = sorted(rng.randrange(len(text) + 1) for _ in range(2))
        for form in ("psm", "spm"):
            done = fill_in_middle.arrange(text, low, high, form).decode()
            p, m, s = text[:low], text[low:high], text[high:]
            assert done == (f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}")
            assert fill_in_middle.restore(done, form).decode() == text
    with pytest.raises(ValueError):
        fill_in_middle.restore("no sentinels", "psm")


def test_fill_in_middle_on_awkward_rows(spark):
    rows = AWKWARD + [(k, text, "en", "a", 0, 1, 1) for k in range(100, 140) for text in ("漢字 and <P", "a<S>b", "S>tail <", "x" * 70_000 + "é")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = fill_in_middle.restored(fill_in_middle.transform(docs)).collect()
    want = Counter((r[0], *told_fim(r[0], r[1])) for r in rows)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.restored(fill_in_middle.transform(docs.limit(0))).count() == 0


def test_fill_in_middle_with_other_names(spark):
    docs = spark.createDataFrame([("k1", "some text", "x", 5)], "output string, form string, n string, low int")
    row = fill_in_middle.restored(fill_in_middle.transform(docs, key="output", text="form")).first()
    assert row.doc_id == "k1" and row.restored == "some text"


# Phrases

def told_phrases(rows, least, absorb, top, longest=5):
    f, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for m in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= absorb * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, k = min((1000 * a * totals[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((" ".join(p), a, counts[p[:k]], counts[p[k:]], totals[lang], score))
        kept.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i, *r) for i, r in enumerate(kept[:top], 1)]
    return sorted(out)


def drawn_texts(seed, n):
    rng, words = random.Random(seed), [f"w{i}" for i in range(8)] + ["É", "漢字", "A|b", "x y", "<b>"]
    def text():
        return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "\v"]) for _ in range(rng.randrange(30))) + rng.choice(["", "New York city hall steps", "new YORK"])
    return [(text(), rng.choice(["en", "en", "fr", None, "und", ""])) for _ in range(n)] + [(None, "en"), ("", None), ("one same word " * 3000, "en")]


@pytest.mark.parametrize("least,absorb,top,longest", [(5, 100, 2000, 5), (3, 60, 7, 5), (2, 100, 50, 2), (4, 100, 40, 4)])
def test_collocations(spark, least, absorb, top, longest):
    rows = drawn_texts(least, 150)
    docs = spark.createDataFrame([(t, s, 1, "x") for t, s in rows], "text string, lang string, n int, words string").repartition(5)
    got = phrases.collocations(docs, least=least, longest=longest, absorb=absorb, top=top)
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == told_phrases(rows, least, absorb, top, longest)


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame(AWKWARD, SCHEMA)
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs.filter("text IS NULL")).count() == 0


def test_false_alarms_in_the_bit_fields_change_nothing(spark):
    rows = [(" ".join(f"{t}x{i}" for i in range(3000)), s) for t, s in (("a", "en"), ("b", "fr"), ("c", None))] * 2 + drawn_texts(1, 60)
    got = phrases.collocations(spark.createDataFrame(rows, "text string, lang string"), least=3, field_bits=15)
    assert sorted(tuple(r) for r in got.collect()) == told_phrases(rows, 3, 100, 2000)


def test_only_suffixes_of_frequent_triples_travel(spark, monkeypatch):
    """All words and pairs are frequent, most triples are rare: every suffix of three words was sent to be sorted."""
    rng, rows = random.Random(8), []
    for _ in range(40):
        rows.append((" ".join(f"w{rng.randrange(12)}" for _ in range(400)) + ". new york city hall", "en"))
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    sent, suffixes = [], phrases._suffixes

    def watched(*args):
        sent.append(docs.mapInArrow(suffixes(*args), "lang string, w0 long, w1 long, w2 long, w3 long, w4 long, n long").agg(phrases.F.count("n"), phrases.F.count_distinct("w0", "w1", "w2")).first())
        return suffixes(*args)

    monkeypatch.setattr(phrases, "_suffixes", watched)
    got = phrases.collocations(docs, least=35, field_bits=20)
    assert sorted(tuple(r) for r in got.collect()) == told_phrases(rows, 35, 100, 2000)
    assert sent[0][1] == 2 and sent[0][0] <= 8  # new york city, york city hall


def test_quicksort_counts_prefixes():
    rng = random.Random(5)
    rows = [tuple(rng.randrange(4) for _ in range(rng.randrange(1, 6))) for _ in range(800)]
    weight = np.array([rng.randrange(1, 5) for _ in rows])
    columns = [np.array([r[d] if d < len(r) else 0 for r in rows]) for d in range(5)]
    found = {}
    phrases.multikey_quicksort(columns, np.array([len(r) for r in rows]), weight, 20, lambda p, d, n: found.__setitem__(rows[p][:d], n), 1)
    want = Counter()
    for r, w in zip(rows, weight):
        for d in range(2, len(r) + 1):
            want[r[:d]] += int(w)
    assert found == {k: n for k, n in want.items() if n >= 20}


def test_scores_are_exact_beyond_64_bits(spark):
    cases = [(10**12 + 7, 9 * 10**12 + 1, 10**12 + 9, 10**12 + 11), (10**12, 10**13, 10**12, 10**12), (100, 10**13, 100, 100), (3, 7, 1000, 1000)]
    got = spark.createDataFrame(cases, "a long, n long, l long, r long").select("a", "n", "l", "r", phrases._exact_score(*(phrases.F.col(c) for c in "anlr")).alias("s")).collect()
    assert [r.s for r in got] == [1000 * r.a * r.n // (r.l * r.r) for r in got]


# Vectors

def near(rng, v, cosine):
    u = rng.standard_normal(len(v))
    u -= (u @ v) * v
    return cosine * v + np.sqrt(1 - cosine * cosine) * u / np.linalg.norm(u)


def unit(rng, d):
    v = rng.standard_normal(d)
    return v / np.linalg.norm(v)


def links_of(rows, threshold=0.95):
    """Links and components by brute force, rows as (key, vector or None)."""
    ok = [i for i, (_, v) in enumerate(rows) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {i: set() for i in range(len(rows))}
    by_size = defaultdict(list)
    for i in ok:
        by_size[len(rows[i][1])].append(i)
    for at in by_size.values():
        x = np.array([rows[i][1] for i in at], dtype=float)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for p, q in zip(*np.nonzero(x @ x.T >= threshold)):
            if p != q:
                near[at[p]].add(at[q])
    return near


def components_of(near):
    label = {}
    for i in near:
        if i not in label:
            label[i], todo = i, [i]
            while todo:
                for j in near[todo.pop()]:
                    if j not in label:
                        label[j] = i
                        todo.append(j)
    return label


def test_recall_at_the_threshold(spark):
    """Pairs right at the threshold, in the plain, with a strong common direction, and with few dimensions."""
    rng = np.random.default_rng(4)
    for d, common, pairs in ((64, 0.0, 1500), (64, 1.5, 600), (12, 0.0, 300)):
        shift = unit(rng, d) * common
        base = [unit(rng, d) + shift for _ in range(pairs)]
        base = [v / np.linalg.norm(v) for v in base]
        rows = [(2 * i + s, [float(x) for x in (v if s == 0 else near(rng, v, 0.9502))]) for i, v in enumerate(base) for s in (0, 1)]
        want = links_of(rows)
        got = {r.vec_id: r for r in embedding_dedup.near_equal_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
        found, total = sum(r.n_links for r in got.values()), sum(map(len, want.values()))
        assert all(got[k].n_links <= len(want[i]) for i, (k, _) in enumerate(rows))
        assert total >= 2 * pairs and found >= 0.97 * total


def test_crowded_buckets_lose_nothing(spark, monkeypatch):
    """A group of many near copies goes through blocks, others through the join; both ways make the brute force's links."""
    monkeypatch.setattr(embedding_dedup, "CROWD", 20)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    rng = np.random.default_rng(9)
    centre, rows = unit(rng, 32), []
    rows += [near(rng, centre, rng.uniform(0.972, 0.999)) for _ in range(400)]
    rows += [centre] * 150
    for _ in range(40):
        v = unit(rng, 32)
        rows += [near(rng, v, 0.99) for _ in range(6)]
    rows += [unit(rng, 32) for _ in range(200)]
    rows = [(int(k), [float(np.float32(x)) for x in v]) for k, v in zip(rng.permutation(len(rows)) * 3, rows)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    got = {r.vec_id: r for r in embedding_dedup.near_equal_vectors(frame).collect()}
    want = links_of(rows)
    label, low = components_of(want), {}
    for i, c in label.items():
        low[c] = min(low.get(c, 1 << 60), rows[i][0])
    found, total = sum(r.n_links for r in got.values()), sum(map(len, want.values()))
    assert 0.99 * total <= found <= total
    assert all(got[k].n_links <= len(want[i]) for i, (k, _) in enumerate(rows))
    assert all(got[k].component_id == low[label[i]] and got[k].kept == (k == low[label[i]]) for i, (k, _) in enumerate(rows))


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 0.0, 0.0]), (3, [2.0, 0.0, 0.0]), (9, [1e300, 0.0, 1e298]), (3, [0.0, 1.0, 0.0]), (None, [0.0, 1.0, 0.0]), (None, None), (1, None), (2, []), (4, [0.0, -0.0, 0.0]),
            (6, [1.0, None, 0.0]), (7, [nan, 1.0, 0.0]), (8, [inf, 0.0, 0.0]), (10, [1.0, 0.0]), (11, [1.0, 0.0]), (12, [0.0, 0.0, 1.0]), (12, [0.0, 0.0, 1.0]), (None, [-1.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(k, v, "x", 1, True) for k, v in rows], "vec_id long, embedding array<double>, label string, n_links int, kept boolean")
    got = Counter(tuple(r) for r in embedding_dedup.near_equal_vectors(frame).collect())
    assert got == Counter([
        (5, 2, 3, False), (3, 2, 3, True), (9, 2, 3, False), (3, 1, 3, True), (None, 1, 3, False), (None, 0, None, True), (1, 0, 1, True), (2, 0, 2, True), (4, 0, 4, True),
        (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (10, 1, 10, True), (11, 1, 10, False), (12, 1, 12, True), (12, 1, 12, True), (None, 0, None, True)])
    assert embedding_dedup.near_equal_vectors(frame.limit(0)).count() == 0
    assert embedding_dedup.near_equal_vectors(frame.filter("embedding IS NULL")).count() == 2


def test_vectors_of_the_given_tables(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    want = links_of(rows)
    got = {r.vec_id: r.n_links for r in queries.QUERIES["op12_embedding_dedup"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {k: len(want[i]) for i, (k, _) in enumerate(rows)}
