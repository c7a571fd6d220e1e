"""Substring and suffix-array dedup against brute force: one group, many groups, hot anchors."""

from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from brute import bytes_report, order, without_repeated_bytes, words_report
from test_operators import ROWS, SCHEMA

from weftline.llm import anchors, fmindex, suffixes
from weftline.llm.common import id_and_text


def mixed_rows():
    """Copies, near copies, a common passage, and a common line, shorter than a window, in ever other surroundings."""
    draw = np.random.default_rng(11)
    word = lambda n: [f"w{x}" for x in draw.integers(0, 5000, n)]
    passage, line, base = word(80), word(12), word(120)
    texts = []
    for i in range(120):
        kind = i % 6
        if kind == 0:
            texts.append([*word(40), *line, *word(40)])
        elif kind == 1:
            texts.append([*word(int(draw.integers(0, 60))), *passage, *word(int(draw.integers(0, 60)))])
        elif kind == 2:
            near = list(base)
            near[int(draw.integers(0, 120))] = f"x{i}"
            texts.append(near)
        elif kind == 3:
            texts.append(texts[int(draw.integers(0, len(texts)))])
        elif kind == 4:
            texts.append(word(int(draw.integers(0, 200))) * 2)
        else:
            texts.append(word(30))
    rows = [(int(i), " ".join(t)) for i, t in zip(draw.permutation(len(texts)), texts)]
    return rows + [(None, " ".join(passage)), (None, " ".join(passage)), (7, " ".join(base)), (3, None), (4, ""), (5, "é" * 400)]


#: As in production, and so small that several groups and buckets meet, anchors are hot and windows are compared in parts.
SIZES = [{}, {"group_chars": 4000, "bucket_chars": 3000, "sample": 2}, {"group_chars": 4000, "bucket_chars": 3000, "sample": 2, "hot": 3, "together": 50}, {"together": 300}]


@pytest.mark.parametrize("sizes", SIZES)
def test_like_brute_force(spark, sizes):
    rows = mixed_rows()
    docs = id_and_text(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    found = anchors.deduplicate(docs, replace(suffixes.METHOD, **sizes)).collect()
    assert sorted((order(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == bytes_report(rows)
    found = anchors.deduplicate(docs, replace(fmindex.METHOD, **sizes)).collect()
    assert sorted((order(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in found) == words_report(rows)


def test_odd_rows_like_brute_force(spark):
    docs, rows = spark.createDataFrame(ROWS, SCHEMA), [r[:2] for r in ROWS]
    found = suffixes.repeated_bytes(docs).collect()
    assert sorted((order(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == bytes_report(rows)
    found = fmindex.repeated_windows(docs).collect()
    assert sorted((order(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in found) == words_report(rows)
    empty = docs.limit(0)
    assert suffixes.repeated_bytes(empty).count() == fmindex.repeated_windows(empty).count() == suffixes.drop_repeated(empty).count() == 0


def test_rest_of_texts_and_other_columns(spark):
    names = ["doc_id", "text", "g", "a.b", "row", "n_chars"]
    rows = [(i, t, "g", "ab", i, 0) for i, t in mixed_rows()[:40]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, g string, `a.b` string, row long, n_chars long")
    out = suffixes.drop_repeated(docs)
    assert out.columns == names
    wanted = [(i, bytes(x for x, y in zip(b, g) if not y).decode("utf-8", "ignore")) for i, b, g in without_repeated_bytes([r[:2] for r in rows])]
    found = [tuple(r) for r in out.collect()]
    assert sorted(r[:2] for r in found) == sorted(wanted)
    assert all(r[2:5] == ("g", "ab", r[0]) and r[5] == len(r[1]) for r in found)


def test_index_finds_only_what_is_there():
    text = np.array([1, 2, 3, 4, 5, 6, 0, 9, 3, 4, 5, 7, 0])
    index = fmindex.FMIndex(text, np.array([8] * 7 + [3] * 6), 3)
    assert fmindex.least_documents(index, text, np.array([0, 7]), np.array([6, 5]), 3).tolist() == [8, 8, 3, 8, 3, 3, 3]
    other = np.array([2, 3, 4, 9, 9, 1, 2, 3, 11, 4, 5, 6])  # words and windows that the index does not have
    none = np.iinfo(np.int64).max
    assert fmindex.least_documents(index, other, np.array([0]), np.array([12]), 3).tolist() == [8, none, none, none, none, 8, none, none, none, 8]


def test_quicksort_orders_suffixes():
    draw = np.random.default_rng(0)
    data, start, group = draw.integers(0, 3, 5000).astype(np.uint8), draw.choice(4800, 2000), draw.integers(0, 5, 2000)
    for size in (3, 8, 21):
        keys = [(g, data[s : s + size].tobytes()) for s, g in zip(start, group)]
        turn, number = suffixes.multikey_quicksort(data, start, group, size)
        assert [keys[i] for i in turn] == sorted(keys)
        assert [sorted(set(keys))[k] for k in number] == keys


def test_anchors_alone_are_sorted(monkeypatch):
    """Windows are told apart by the order of their anchors, which are a few of them; of one document's equal windows the least start stays."""
    draw, method = np.random.default_rng(4), replace(suffixes.METHOD, window=20, gram=6)
    parts, tokens, anchor = [], [], []
    for _ in range(400):
        a = int(draw.integers(0, 15))
        n = int(draw.integers(1, a + 2))
        text = np.concatenate([draw.random(a) < 0.1, [7, 8, 9, 7, 8, int(draw.integers(4, 6))], draw.random(20) < 0.1])
        parts.append(text[: n + 19].astype(np.uint8))
        tokens.append(n + 19)
        anchor.append(a)
    doc, place = draw.integers(0, 9, 400), draw.integers(0, 50, 400)
    keys, starts = [], []
    for part, a, d, p in zip(parts, anchor, doc.tolist(), place.tolist()):
        for step in range(len(part) - 19):
            keys.append((a - step, part[step : step + 20].tobytes()))
            starts.append((d, p + step))
    least = {}
    for key, start in zip(keys, starts):
        least[key] = min(start, least.get(key, start))
    sorted_ones = []
    plain = suffixes.multikey_quicksort
    monkeypatch.setattr(suffixes, "multikey_quicksort", lambda data, start, *rest: sorted_ones.append(len(start)) or plain(data, start, *rest))
    segments = anchors.Segments(np.concatenate(parts).reshape(-1, 1), np.array(tokens, np.int32), np.array(anchor, np.int32), doc, place)
    found = suffixes.earlier_starts(segments, method)
    assert found.tolist() == [least[key] < start for key, start in zip(keys, starts)]
    assert 0 < found.sum() < len(found)
    assert sum(sorted_ones) <= 2 * len(parts) < len(keys)


def test_digests_of_equal_stretches_are_equal():
    draw = np.random.default_rng(2)
    codes = np.tile(draw.integers(0, 4, 700).astype(np.uint8), 3)
    own = anchors.Group(pa.table({"doc_id": [1], "text": [bytes(codes + 97).decode()]}), suffixes.METHOD)
    seen = {}
    for s, n, a, f in zip(own.start.tolist(), own.windows.tolist(), own.place.tolist(), own.first.tolist()):
        assert seen.setdefault((own.codes[s : s + n + 99].tobytes(), a - s), f) == f
    assert len(set(seen.values())) == len(seen)


def test_long_words_that_sums_of_powers_take_for_one(spark):
    """A word after the Thue-Morse sequence and its mirror: equal modulo 2^64 under any polynomial."""
    bits = [i.bit_count() % 2 for i in range(1024)]
    x, y = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    same = " ".join(f"s{i}" for i in range(49))
    rows = [(1, f"{same} {x}"), (2, f"{same} {y}"), (3, f"{same} {x}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = fmindex.repeated_windows(docs).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == words_report(rows)
    assert {r.doc_id: r.n_removed for r in found} == {1: 0, 2: 0, 3: 50}
    codes, _, _ = fmindex.read(pa.array([f"{x} {y}"]))
    assert codes[0] != codes[1]


def test_words_longer_than_a_stretch(spark, monkeypatch):
    monkeypatch.setattr(fmindex, "CHUNK", 16)
    same = " ".join(f"s{i}" for i in range(60))
    rows = [(1, f"{'x' * 40} {same} {'y' * 17}"), (2, f"{'x' * 40} {same}"), (3, f"{'x' * 39}z {same} é"), (4, "w" * 100)]
    codes, _, _ = fmindex.sketch(pa.array([t for _, t in rows]))
    assert codes[0] == codes[62] and codes[0] != codes[123]
    found = fmindex.repeated_windows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == words_report(rows)
