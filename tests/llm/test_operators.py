"""The corpus operators on small fixtures, against brute force, exact round trips and held-out labels."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import minhash, neighbours, packing, pieces, pii, quality, topk, toxicity

pytestmark = pytest.mark.filterwarnings("ignore")
SCHEMA = "doc_id long, text string, lang string, score string, key string"
PASSAGE = " ".join(f"w{i}" for i in range(70))
TEXTS = [
    None, "", " ", "one two", "one two", PASSAGE, f"before {PASSAGE} after", PASSAGE + " " + PASSAGE, "a" * 700, "é" * 300 + PASSAGE,
    " ".join(f"x{i % 7}" for i in range(400)), "mail a.b@c.example.com call +1 (524) 555-5024 or 4111 1111 1111 1111 at 1.2.3.4 or 1.2.3.400 +12", "日本 " * 60,
]
ROWS = [(i, t, "en", "s", "k") for i, t in enumerate(TEXTS)] + [(None, PASSAGE, None, None, None), (5, PASSAGE, "en", "s", "k")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_copies(spark, empty):
    words = [f"v{i}" for i in range(100)]
    near = words[:50] + ["changed"] + words[51:]
    far = [f"u{i}" for i in range(100)]
    rows = [(3, " ".join(words)), (1, " ".join(near)), (2, " ".join(far)), (7, " ".join(words)), (9, None), (8, ""), (4, "a b"), (5, "a b"), (None, "c d")]
    df = spark.createDataFrame([(*r, "en", "s", "k") for r in rows], SCHEMA)
    found = {r.doc_id: (r.class_id, r.kept) for r in minhash.classes(df).collect()}
    assert found == {3: (1, False), 1: (1, True), 2: (2, True), 7: (1, False), 9: (9, True), 8: (8, True), 4: (4, True), 5: (4, False), None: (None, True)}
    assert sorted(r.doc_id or 0 for r in minhash.keep_one(df).collect()) == [0, 1, 2, 4, 8, 9]
    assert minhash.classes(empty).count() == 0


def test_rows_that_repeat_an_id_are_told_by_text(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    df = spark.createDataFrame([(i, t, "en", "s", "k") for i, t in [(1, a), (5, a), (5, b), (5, b), (6, b)]], SCHEMA)
    assert sorted((r.doc_id, r.text) for r in minhash.keep_one(df).collect()) == [(1, a), (5, b), (5, b)]
    bits = [i.bit_count() % 2 for i in range(1024)]
    twins = ["one two three four " + "".join("ab"[x ^ flip] for x in bits) for flip in (0, 1)]
    df = spark.createDataFrame([(i, t, "en", "s", "k") for i, t in enumerate(twins)], SCHEMA)
    assert sorted(r.class_id for r in minhash.classes(df).collect()) == [0, 1]


def test_one_huge_labelled_text_loses_no_label(spark):
    """Very long texts come last in the bounded sample, and each label keeps its first text."""
    draw = np.random.default_rng(5)
    mild, rude = [[f"{x}{i}" for i in range(30)] for x in "mr"]
    rows = [(i, " ".join(draw.choice(rude if i % 2 else mild, 12))) for i in range(120)] + [(1001, " ".join(rude * 20)), (1003, " ".join(mild * 20))]
    docs = spark.createDataFrame([(*r, "en", "s", "k") for r in rows], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    for some in (labels, labels.where("doc_id > 1000 OR doc_id % 2 = 0")):
        scorer = toxicity.fit(docs, some, F.lit(True), most_chars=2000, steps=150)
        found = {r.doc_id: r.score for r in toxicity.score(docs, scorer).collect()}
        assert np.mean([found[i] for i in range(1, 120, 2)]) > np.mean([found[i] for i in range(0, 120, 2)]) + 0.3


def test_classes_like_brute_force(spark):
    """Edited copies of one text, many of which are near to few others: all links count, in every round."""
    draw = np.random.default_rng(7)
    base = [f"b{i}" for i in range(100)]
    texts = []
    for i in range(150):
        words = list(base)
        for k in draw.choice(100, int(draw.integers(1, 6)), replace=False):
            words[k] = f"e{i if i % 3 else i // 6}-{k}"
        texts.append(words)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in texts]
    label = list(range(len(texts)))
    for _ in texts:
        for i, x in enumerate(sets):
            for j in range(i):
                if len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in minhash.classes(df).collect()} == dict(enumerate(label))
    assert len(set(label)) > 20


def test_parities_bound_the_difference():
    draw = np.random.default_rng(3)
    for n in (1, 50, 3000):
        a = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
        b = np.union1d(a[: n // 2], draw.integers(0, 2**63, n // 3).astype(np.uint64))
        apart = len(np.setxor1d(a, b))
        odd = sum(int(x).bit_count() for x in (minhash.parities(a) ^ minhash.parities(b)).view(np.uint64))
        assert odd <= apart and odd % 2 == apart % 2


def test_darts_estimate_weighted_similarity():
    a, b = np.arange(100, dtype=np.uint64) + 1, np.arange(50, 150, dtype=np.uint64) + 1
    sets = minhash.mixed(np.concatenate([a, b]) * minhash.MULTIPLIER)
    weights = np.concatenate([np.where(a > 50, 3.0, 0.5), np.where(b <= 100, 2.0, 1.0)])
    ranks = minhash.darts(sets, weights, np.array([0, 100, 200]), 1024)
    wa, wb = dict(zip(a.tolist(), weights[:100])), dict(zip(b.tolist(), weights[100:]))
    keys = set(wa) | set(wb)
    true = sum(min(wa.get(k, 0), wb.get(k, 0)) for k in keys) / sum(max(wa.get(k, 0), wb.get(k, 0)) for k in keys)
    assert abs((ranks[0] == ranks[1]).mean() - true) < 0.06


def test_personal_data(docs, empty):
    found = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    text = TEXTS[11]
    assert (found[11].n_email, found[11].n_ip, found[11].n_card, found[11].n_phone) == (1, 1, 1, 1)
    spans = [(k, text[int(s) : int(e)]) for k, s, e in (x.split(":") for x in found[11].spans.split(","))]
    assert spans == [("email", "a.b@c.example.com"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (524) 555-5024")]
    assert found[0].spans == "" and found[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.personal_data(empty).count() == 0
    redacted = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert redacted[11] == "mail [EMAIL] call [PHONE] or [CARD] at [IP] or 1.2.3.400 +12" and redacted[3] == "one two"


def test_contexts_find_new_identifiers(spark):
    rows = [(i, f"some words contact: user{i}@mail.example.com and more") for i in range(12)] + [(99, "other words contact: user99-at-mail here")]
    found = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    start = rows[-1][1].index("user99")
    assert found[99] == f"email:{start}:{start + len('user99-at-mail')}"


def test_contexts_hold_when_rows_are_repeated(spark):
    texts = [f"some words contact: user{i}@mail.example.com and more" for i in range(12)] + ["other words contact: user99-at-mail here"]
    rows = [(i + 100 * k, t) for k in range(4) for i, t in enumerate(texts)]
    found = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    start = texts[-1].index("user99")
    assert {found[12 + 100 * k] for k in range(4)} == {f"email:{start}:{start + len('user99-at-mail')}"}


def test_contexts_of_phones_and_long_contexts(spark):
    long = "x" * 240
    texts = [f"some words dial: +1 (0{i}) 555-77{i} and more" for i in range(10, 22)] + ["other words dial: (017) 555-7713, or so"]
    texts += [f"we {long}: u{i}@mail.example.com, yes" for i in range(12)] + [f"or {long}: user99-at-mail here"]
    found = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, kind, new in ((12, "phone", "(017) 555-7713"), (25, "email", "user99-at-mail")):
        start = texts[i].index(new)
        assert found[i] == f"{kind}:{start}:{start + len(new)}"


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    found = packing.pack(docs).collect()
    for i, t in enumerate(TEXTS):
        if i == 5:
            continue  # its id is repeated
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for r in (r for r in found if r.doc_id == i):
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids)
        assert sum(r.length for r in found if r.doc_id == i) == len(ids)
    by = {}
    for r in sorted(found, key=lambda r: r.offset):
        assert by.setdefault(r.sequence_id, 0) == r.offset
        by[r.sequence_id] += r.length
    assert max(by.values()) <= 2048
    assert packing.pack(empty).count() == 0


def test_pieces_match_the_library_and_round_trip(docs, empty):
    import public_tokenizers
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    encoded = pieces.encode(docs)
    for r in encoded.collect():
        if r.doc_id is not None:
            assert r.ids == own.encode(TEXTS[r.doc_id] or "")
    assert all(r.same for r in pieces.round_trip(docs).collect())
    assert {r.doc_id: r.text for r in pieces.decode(encoded).collect()}[11] == TEXTS[11]
    assert pieces.round_trip(empty).count() == 0


def vectors(spark):
    draw = np.random.default_rng(1)
    base = draw.standard_normal((120, 8))
    near = base[:30] + 0.05 * draw.standard_normal((30, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([base, near, base[:3]]))]
    rows += [(900, None), (901, [0.0] * 8), (902, [1.0, float("nan")] + [0.0] * 6), (903, [1.0, None] + [0.0] * 6)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_near_vectors(spark):
    rows, df = vectors(spark)
    sound = {i: np.array(v) for i, v in rows if i < 900}
    found = {r.vec_id: r for r in neighbours.near_vectors(df).collect()}
    for i, v in sound.items():
        n = sum(j != i and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.9 for j, w in sound.items())
        assert found[i].n_links == n
    for i in (900, 901, 902, 903):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)
    assert neighbours.near_vectors(df.limit(0)).count() == 0


def test_vectors_of_two_lengths(spark):
    rows = [(i, [1.0, float(i), 2.0]) for i in range(5)] + [(10, [1.0, 0.0]), (11, [1.0, 0.1]), (12, [0.0, 1.0]), (13, [0.0, 1.0])]
    found = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [found[i] for i in (10, 11, 12, 13)] == [(1, 10), (1, 10), (1, 12), (1, 12)]


def test_rare_links_are_audited(spark, monkeypatch):
    """Where hardly any vector has a link and the tables find none, the audit goes on until it has seen them."""
    draw = np.random.default_rng(4)
    x = draw.standard_normal((4000, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    side = draw.standard_normal(64)
    side -= (side @ x[0]) * x[0]
    x[1] = 0.905 * x[0] + np.sqrt(1 - 0.905**2) * side / np.sqrt(side @ side)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    first, meet = neighbours.first_graph, neighbours.introduce
    monkeypatch.setattr(neighbours, "first_graph", lambda *a: first(*a).where(F.col("sim") < neighbours.LINK))
    monkeypatch.setattr(neighbours, "introduce", lambda *a: meet(*a).where(F.col("sim") < neighbours.LINK))
    assert {r.vec_id: r.n_links for r in neighbours.near_vectors(df).where("n_links > 0").collect()} == {0: 1, 1: 1}


def test_counts_in_parts(spark, monkeypatch):
    """A group of near copies that is cut into parts, beside pairs and single vectors: links and components as by brute force."""
    draw = np.random.default_rng(8)
    base = draw.standard_normal((60, 16))
    group = base[0] + 0.17 * draw.standard_normal((300, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([base, group, base[5:25] + 0.05 * draw.standard_normal((20, 16)), group[:4]]))]
    x = np.array([v for _, v in rows])
    norm = np.sqrt((x * x).sum(1))
    linked = (x @ x.T) / (norm[:, None] * norm[None, :]) >= 0.9
    np.fill_diagonal(linked, False)
    label = np.arange(len(x))
    for _ in range(20):
        label = np.minimum(label, np.where(linked, label[None, :], len(x)).min(axis=1))
    monkeypatch.setattr(neighbours, "PART", 64)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert found == {i: (int(linked[i].sum()), int(label[i]), bool(label[i] == i)) for i in range(len(x))}


def test_top_k(spark):
    rows, df = vectors(spark)
    rows += [(20, rows[3][1]), (1, [4.0] * 8)]  # ids that are there already
    df = spark.createDataFrame([(i, v, 5, "x") for i, v in rows], "vec_id long, embedding array<double>, row long, cell string")
    q = [(i, np.floor(64 * np.array(v))) for i, v in rows if i < 902 and v is not None]
    wanted = [(i, r + 1, j, int(-s)) for a, (i, x) in enumerate(q) if i % 20 == 0 for r, (s, j) in enumerate(sorted((-(x @ y), j) for b, (j, y) in enumerate(q) if a != b)[:20])]
    for found in (topk.embedding_search(df), topk.top_k(df, F.col("vec_id") % 20 == 0, 20, query_bytes=512, range_rows=50)):
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect()) == sorted(wanted)
    assert topk.embedding_search(df.limit(0)).count() == 0


def test_blocks_are_pruned():
    """Vectors in clusters: far blocks are not scored, and nothing is lost."""
    draw = np.random.default_rng(6)
    x = np.repeat(draw.integers(-60, 60, (40, 16)), 128, axis=0) + draw.integers(-3, 4, (40 * 128, 16))
    queries = x[::500]
    search = topk.Search(np.arange(len(x))[::500], queries, np.full(len(queries), topk.LOWEST), 20)
    search.add(np.arange(len(x)), np.arange(len(x)), x)
    assert search.visited < 0.5 * search.blocks
    for k, own in enumerate(range(0, len(x), 500)):
        scores = sorted((-int(queries[k] @ x[j]), j) for j in range(len(x)) if j != own)[:20]
        assert [(-s, j) for s, j in zip(search.best[k], search.who[k])] == scores


def test_classifiers(spark, docs, empty):
    data = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    for report, label, least in ((quality.quality_report, "quality", 0.9), (toxicity.toxicity_report, "toxic", 0.8)):
        rows = report(table, labels).join(labels, "doc_id").where("held_out").toPandas()
        assert (rows["predicted"] == rows[label]).mean() >= least
        assert rows["score"].between(0, 1).all()
        assert report(docs, labels.limit(0)).count() == len(ROWS)
        assert report(empty, labels).count() == 0


def test_word_ids_equal_the_library_on_odd_words():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    own = packing.WordIds(public_tokenizers.path(packing.TOKENIZER), together=3)
    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    texts = ["", "\n", " ", "A.", "A..b", "Straße!", "İstanbul", "it's don't", "<|endoftext|>x a<|startoftext|>", "é É.", "é ú.", "µª", "ÿ?"]
    texts += ["ÀÉ,;", "x\ty", "ÄÖ!?..", "日本語。 1234 a1b2", "\x00a", "one two three four five Six, seven. eight", "word " * 5000]
    for _ in range(2):  # learnt, then known
        flat, bounds = own.ids(pa.array(texts))
        for i, text in enumerate(texts):
            assert flat[bounds[i] : bounds[i + 1]].tolist() == whole.encode(text, add_special_tokens=False).ids


def test_table_finds_all_keys_and_no_other():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        table = pieces.Table(keys)
        assert table.find(keys).tolist() == list(range(len(keys)))
        assert (table.find(keys - np.uint64(1)) == -1).all() and (table.find(np.array([0, 2**64 - 2], np.uint64)) == -1).all()
