"""The pipeline on hand-made rows: each stage against brute force on what its predecessor kept."""

import numpy as np
import pytest
from brute import near_classes, order, without_repeated_bytes

import corpus_pipeline
from weftline.llm import packing, pii, quality
from weftline.llm.common import materialize

NAMES = ["doc_id", "text", "lang", "source", "n_chars", "gone", "a.b"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone string, `a.b` string"


def rows():
    draw = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in draw.integers(0, 900, n)]
    passage, texts = word(40), []
    for i in range(60):
        texts.append(word(60) if i % 3 else [*word(20), *passage, *word(20)])
    near = list(texts[1])
    near[3] = "other"
    texts += [near, texts[2], ["mail", "a.b@c.example.com", "or", "1.2.3.4"] + word(30)]
    made = [(i, " ".join(t)) for i, t in enumerate(texts)]
    made += [(i + 100, "buy now " * 40 + f"{i}") for i in range(30)] + [(None, " ".join(texts[4])), (200, None), (201, ""), (7, "b " * 20)]
    return [(i, t, "en", "s", len(t or ""), "x", "y") for i, t in made]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 100), 0) for r in rows() if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def texts_of(df):
    return sorted((order(r["doc_id"]), r["text"] or "") for r in df.collect())


def test_stages_like_brute_force(spark, folder):
    docs, stages = spark.read.parquet(f"{folder}/documents.parquet"), dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_dedup", "suffix_dedup", "pii", "packing"]
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, folder), f"test-{name}")
        out[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert docs.columns == before.columns == NAMES
        assert all(tuple(r)[2:4] == ("en", "s") and tuple(r)[5:] == ("x", "y") for r in docs.collect())
    # Rejected rows are those whose score is too low, and most of the repeated phrases are among them.
    scored = quality.quality_report(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    kept = sorted(order(r.doc_id) for r in scored.where("predicted = 1").collect())
    assert sorted(order(i) for i, _ in out["quality"]) == kept
    assert sum(100 <= order(i) < 200 for i, _ in out["quality"]) <= 3 and sum(order(i) < 63 for i, _ in out["quality"]) >= 60
    # Of each class the row with the smallest id; rows without an id or words stay.
    label = near_classes(out["quality"])
    wanted = [(order(i), t or "") for (i, t), low in zip(out["quality"], label) if i is None or order(i) == low]
    assert sorted((order(i), t or "") for i, t in out["near_dedup"]) == sorted(wanted)
    # Bytes that a 100-byte string covers which starts earlier.
    wanted = [(i, bytes(x for x, y in zip(b, g) if not y).decode("utf-8", "ignore")) for i, b, g in without_repeated_bytes(out["near_dedup"])]
    assert sorted((order(i), t) for i, t in out["suffix_dedup"]) == sorted(wanted)
    assert any(len(t) < 100 for _, t in wanted)
    # Personal data by its kind.
    redacted = dict(out["pii"])
    assert "[EMAIL] or [IP]" in redacted[62] and "@" not in redacted[62]
    # The whole run gives the same pieces as packing what the last stage kept.
    pieces = lambda df: sorted((order(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in df.collect())
    assert pieces(corpus_pipeline.run(spark, folder)) == pieces(packing.pack(docs))
    assert pii.redact(docs).columns == NAMES


def test_sequences_are_filled_well(spark):
    draw = np.random.default_rng(3)
    texts = [(i, " ".join(f"w{x}" for x in draw.integers(0, 300, int(n)))) for i, n in enumerate(draw.integers(1, 1500, 120))]
    found = packing.pack(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    sequences = {r.sequence_id for r in found}
    assert sum(r.length for r in found) / (2048 * len(sequences)) > 0.93


def test_empty_corpus(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
