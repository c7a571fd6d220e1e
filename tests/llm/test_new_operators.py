"""Spelling variants, mixing and ranked search against plain definitions."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import lexical, mixing, variants

SCHEMA = "doc_id long, text string, source string, word string, n string, row string"


def frame(spark, rows):
    """Rows (doc_id, text, source) with columns whose names clash with ours."""
    return spark.createDataFrame([(*r, "w", "n", "r") for r in rows], SCHEMA)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def words_of(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 2}


def groups_of(n, times=10):
    out, by_length = {}, {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    for w, c in n.items():
        found = [x for k in (-1, 0, 1) for x in by_length.get(len(w) + k, []) if near(w, x)]
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form = best if best is not None and n[best] >= times * c else None
        out[w] = [c, len(found), form, n[form] if form else None]
    for w in out:
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w].append(root)
    return {w: tuple(v) for w, v in out.items()}


def spelled(draw, n):
    """Words with common beginnings and endings, many of them one edit apart."""
    ends = ["ación", "amente", "ation", "ß×ende"]
    words = []
    for _ in range(n):
        w = "".join(draw.choice(list("abcÀé"), int(draw.integers(2, 5)))) + ends[int(draw.integers(0, 4))]
        k = int(draw.integers(0, len(w)))
        words.append([w, w[:k] + "x" + w[k:], w[:k] + "Y" + w[k + 1 :], w.upper()][int(draw.integers(0, 4))])
    return words


@pytest.mark.parametrize("pairs", [1, 12, variants.PAIRS])
def test_variants_like_brute_force(spark, pairs):
    draw = np.random.default_rng(3)
    rows = [(i % 90, " ".join(spelled(draw, 40)), "s") for i in range(100)] + [(None, "abcdefgh " * 25 + "abcdefg abcdefg bcdefgh bcdefgh", None), (1, None, "s"), (2, "", "s"), (3, "a" * 5000 + " " + "a" * 5000, "s")]
    docs = frame(spark, rows).repartition(7)
    found = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in variants.grouped(variants.counted(docs), pairs=pairs).collect()}
    assert found == groups_of(words_of(rows))
    assert any(v[2] for v in found.values())


def test_variants_follow_forms_to_the_last(spark):
    n = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "abcdefghijk": 19999, "zbcdefgh": 20}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    found = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in variants.grouped(words).collect()}
    assert found == groups_of(n)
    assert found["abcdefg"][4] == "abcdefghij" and variants.spelling_variants(frame(spark, [])).count() == 0


def test_no_key_makes_the_pairs_of_a_large_group(spark):
    """Thousands of words with one ending: keys are refined until few words share them."""
    draw = np.random.default_rng(1)
    n = {"".join(draw.choice(list("abcdefgh"), 8)) + "commonending": 2 for _ in range(3000)}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    found = {tuple(sorted((r.a, r.b))) for r in variants.near_words(words, 64).collect()}
    wanted, less = set(), {}
    for w in n:
        for i in range(8):
            less.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
    for own in less.values():
        wanted |= {tuple(sorted((a, b))) for a in own for b in own if a < b}
    assert found == wanted and wanted


def sizes_of(rows):
    return [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for _, t, _ in rows]


def targets_of(rows):
    own = Counter()
    for (_, _, s), n in zip(rows, sizes_of(rows)):
        own[s] += n
    sources = sorted((s for s in own if s is not None)) + [None] * (None in own)
    weight, total = {s: i % 3 + 1 for i, s in enumerate(sources)}, sum(own.values())
    full = set()
    while True:
        left, w = total - sum(3 * own[s] for s in full), sum(weight[s] for s in sources if s not in full)
        over = {s for s in sources if s not in full and left * weight[s] > 3 * own[s] * w}
        if not over:
            return own, {s: 3 * own[s] if s in full else left * weight[s] / w if w else 0 for s in sources}
        full |= over


def mix_rows():
    draw = np.random.default_rng(2)
    rows, text = [], lambda n: " ".join(["w"] * int(n))
    for i in range(900):
        source = ["hot", "b", "ü", "Z", "", None, "tiny"][min(6, int(draw.integers(0, 7)) if i % 3 else 0)]
        rows.append((i, text(draw.integers(1, 4) if source == "tiny" else draw.geometric(0.01)), source))
    rows += [(i, text(50), "hot") for i in range(1000, 1700)]  # one length of one source, many copies
    rows += [(2000, text(5000), "b"), (2001, None, "b"), (2002, "", None), (2003, " \t\u00a0 x", "only"), (None, text(7), "b"), (5, text(9), "b"), (5, text(9), "b"), (2004, "", "none")]
    return rows


def test_mix_reaches_targets(spark):
    rows = mix_rows()
    docs = frame(spark, rows)
    found = mixing.mix(docs.repartition(5)).join(docs.select(F.col("doc_id").alias("d"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("k"), "source").distinct(), F.expr("d <=> doc_id AND k = h")).collect()
    own, target = targets_of(rows)
    assert Counter((r.doc_id, r.size, r.source) for r in found) == Counter((i, n, s) for (i, _, s), n in zip(rows, sizes_of(rows)))
    taken, cut = Counter(), Counter()
    for r in found:
        assert r.source_size == own[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        cut[r.source] += bool(r.size and r.taken % r.size)
        if r.size:  # copies are the rate, rounded
            assert abs(r.taken / r.size - r.rate) < 1 + 1e-9 or r.taken % r.size
    assert max(cut.values()) <= 1
    assert all(abs(taken[s] - target[s]) <= 1 for s in own), (taken, target)
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.taken)
    assert sorted(((r.doc_id, r.taken) for r in again), key=str) == sorted(((r.doc_id, r.taken) for r in found), key=str)
    assert key(found[0])


def test_rates_are_the_nearest_to_one(spark):
    """Against the same convex problem solved by bisection in numpy, source by source."""
    rows = mix_rows()
    own, target = targets_of(rows)
    found = {}
    for r in mixing.mix(frame(spark, rows)).collect():
        found.setdefault((r.source_size, r.size), r.rate)
    for source in own:
        size = np.array([n for (_, _, s), n in zip(rows, sizes_of(rows)) if s == source and n], float)
        if not len(size):
            continue
        x, low, high = size / size.mean(), -2000.0, 2000.0
        for _ in range(200):
            middle = (low + high) / 2
            if (size * np.minimum(3, np.exp(np.minimum(middle * x, 2)))).sum() < target[source]:
                low = middle
            else:
                high = middle
        for n, y in zip(size, x):
            assert math.isclose(found[own[source], int(n)], min(3, math.exp(min(high * y, 2))), rel_tol=2e-2, abs_tol=1e-3)


def test_drawn_and_empty_mixes(spark):
    rows = mix_rows()[:300]
    docs = frame(spark, rows)
    plan = mixing.mix(docs).agg(F.sum("taken")).first()[0]
    out = mixing.drawn(docs)
    assert out.columns == [*docs.columns, "copy", "words"]
    whole = out.withColumn("size", F.regexp_count("text", F.lit(mixing.WORD)))
    assert whole.agg(F.sum(F.coalesce("words", "size"))).first()[0] == plan
    assert mixing.mix(frame(spark, [])).count() == 0
    assert [r.taken for r in mixing.mix(frame(spark, [(1, None, None), (2, "", "a")])).collect()] == [0, 0]


TERM = "[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return Counter(re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))


def best_of(docs, items, k=20):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n // total
            score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, r in terms(text).items() if t in c)
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, rank, i, -less) for rank, (less, _, i) in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1)]
    return out


@pytest.mark.parametrize(("k", "block", "together"), [(20, lexical.BLOCK, lexical.TOGETHER), (3, 200, 7), (1, 1, 5)])
def test_search_like_brute_force(spark, monkeypatch, k, block, together):
    monkeypatch.setattr(lexical, "TOGETHER", together)
    draw = np.random.default_rng(9)
    vocabulary = [*(f"t{i}" for i in range(60)), "Äpfel", "äpfel", "日本", "İ", "ß"]
    weight = 1 / np.arange(1, len(vocabulary) + 1)
    text = lambda n: " ".join(draw.choice(vocabulary, int(n), p=weight / weight.sum()))
    docs = [(int(i), text(draw.integers(0, 60)).upper() if i % 5 == 0 else text(draw.integers(0, 60))) for i in range(150)]
    docs += [(7, docs[3][1]), (8, docs[3][1]), (None, docs[3][1]), (1000, None), (1001, ""), (1002, "-- !"), (1003, "t50 " * 30000), (1004, "t1" * 9000)]
    items = [(int(i), text(draw.integers(1, 25))) for i in range(25)] + [(50, None), (51, ""), (52, "nowhere"), (53, "t0"), (54, "t50 t50 t1"), (None, "t2 t3"), (53, "t9 t8")]
    items_df = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, term string")
    docs_df = spark.createDataFrame([(*x, "x") for x in docs], "doc_id long, text string, tf string").repartition(4)
    found = [tuple(r) for r in lexical.ranked(docs_df, items_df, k=k, block=block).collect()]
    # Rows of equal ids and scores may stand in either order; they are the same rows.
    assert Counter(found) == Counter(best_of(docs, items, k))


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked(docs.limit(0), items).count() == 0 == lexical.ranked(docs, items.limit(0)).count()


def test_terms_are_pruned_by_suffix_bounds():
    numbers, items = {"rare": 0, "often": 1, "common": 2}, [Counter({"rare": 1, "often": 1, "common": 2}), Counter({"common": 1})]
    best, kth = np.array([1000, 90, 4]), np.array([500, 80, 3])
    (terms_, _, lead, seed, _), (_, _, alone, low, _) = lexical.planned(items, numbers, best, kth)
    assert terms_.tolist() == [0, 1, 2] and (lead, seed) == (1, 500)  # 90 + 2 * 4 < 500
    assert (alone, low) == (1, 3)
