"""The corpus pipeline on a small corpus, stage by stage, against a brute-force version."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from tidemark.llm import secrets
from tidemark.llm.queries import pre_token_pattern, tokenizer

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows, labels = [], []
    for k in range(240):
        toxic = k % 6 == 0
        rows.append((k, prose(80) + (" you grobian " if toxic else " ") + prose(40), "en", f"src{k % 3}", 0))
        labels.append((k, 1, int(toxic)))
    clean = [r for r in rows if r[0] % 6]
    rows += [(1000 + k, clean[k][1], "en", "copy", 0) for k in range(20)]  # exact copies
    for k in range(30, 50):  # near copies: one word of 120 replaced
        words = clean[k][1].split()
        words[60] = "zzz"
        rows.append((2000 + k, " ".join(words), "en", "near", 0))
    rows.append((3000, prose(50) + ' password = "hunter2hunter2" ' + prose(50), "en", None, 0))
    rows.append((3001, None, None, None, None))
    folder = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(i, t, lang, s, len(t) if t else None) for i, t, lang, s, _ in rows], COLUMNS)
    docs.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    return str(folder), {r[0]: r[1] for r in rows}, {k for k, _, y in labels if y}


def shingles(t, width=5):
    w = (t or "").encode().lower().split()
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def test_stages(spark, corpus):
    folder, texts, toxic = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = dict(texts)
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "secrets", "packing"]

    docs = stages["toxicity"](spark, docs, folder).cache()
    kept = {i: t for i, t in kept.items() if i not in toxic}
    assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == kept

    docs = stages["exact dedup"](spark, docs, folder).cache()
    best: dict = {}
    for i, t in kept.items():
        best[t or ""] = max(i, best.get(t or "", i))
    kept = {i: kept[i] for i in best.values()}
    assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == kept

    docs = stages["near dedup"](spark, docs, folder).cache()
    sets = {i: shingles(t) for i, t in kept.items()}
    label = {i: i for i in kept}
    for _ in range(3):
        for i in label:
            for j in label:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    kept = {i: t for i, t in kept.items() if label[i] == i}
    assert docs.columns == columns and {r.doc_id: r.text for r in docs.collect()} == kept

    docs = stages["secrets"](spark, docs, folder).cache()
    got = {r.doc_id: r for r in docs.collect()}
    with open(tokenizer("byte_bpe_50k.tiktoken"), "rb") as f:
        scanner = secrets.Scanner(f.read(), pre_token_pattern())
    want = {i: secrets.redact_text(t, scanner.spans(t), "[secret]") if t else t for i, t in kept.items()}
    assert docs.columns == columns and {i: r.text for i, r in got.items()} == want
    assert "hunter2" not in got[3000].text and got[3000].n_chars == len(got[3000].text)

    packed = stages["packing"](spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == set(want)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_stages_take_any_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, texts without words, and columns named as the stages' own."""
    clash = "gone long, _gone long, gone_id long, gone_sha string, sha string, toxicity_score double, kept boolean, node long, suspect boolean"
    rows = [(5, None), (5, ""), (6, "x"), (None, "no id"), (None, "no id"), (None, "other"), (7, "a b c d e f"), (7, "a b c d e f"), (8, " \n "), (2, "twice"), (1, "twice"), (3, "word " * 3000)]
    extra = (1, 2, 3, "s", "t", 0.5, True, 9, False)
    docs = spark.createDataFrame([(i, t, None, None, None, *extra) for i, t in rows], f"{COLUMNS}, {clash}")
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    want = {"toxicity": rows, "exact dedup": [(5, ""), (6, "x"), (None, "no id"), (None, "other"), (7, "a b c d e f"), (8, " \n "), (2, "twice"), (3, "word " * 3000)]}
    want["near dedup"] = want["secrets"] = want["exact dedup"]
    key = lambda x: (str(x[0]), x[1] or "")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        got = docs.collect()
        assert sorted(((r.doc_id, r.text or "") for r in got), key=key) == sorted(((i, t or "") for i, t in want[name]), key=key), name
        assert all(tuple(r)[5:] == extra for r in got)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in packed if r.piece == 0) == sorted(str(i) for i, _ in want["secrets"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_an_id_with_and_without_words_loses_its_near_copy_only(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(5, text + " end"), (5, ""), (2, text), (6, None)], "doc_id long, text string")
    got = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == [(2, text), (5, ""), (6, "")]
