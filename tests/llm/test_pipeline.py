"""Each stage's decisions on a small corpus, held against the operators' brute-force meaning."""

import random

import corpus_pipeline


def test_stages_in_order_and_whole(spark, tmp_path):
    rng = random.Random(1)
    plain = ["".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(500)]
    text = lambda n=80: " ".join(rng.choice(plain) for _ in range(n))
    texts, labels = [], []
    for i in range(600):
        t = text()
        if i % 6 == 0:
            t = t.replace(" ", " blockhead ", 5)
        texts.append(t)
        labels.append((i, 1, int(i % 6 == 0)))
    texts[1] = texts[2]  # exact copies
    texts[3] = texts[3] + "\npassword=abcdefghijklmnop0123"
    texts += ["too short", None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, str(tmp_path)).cache()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert set(seen["quality rules"]) == set(range(600))
    assert set(seen["toxicity"]) == {i for i in range(600) if i % 6}
    assert set(seen["simhash near-dedup"]) == set(seen["toxicity"]) - {2}
    redacted = seen["secret scans"]
    assert set(redacted) == set(seen["simhash near-dedup"])
    assert "abcdefghijklmnop0123" not in redacted[3].text and redacted[3].text.endswith("[SECRET]")
    assert all(redacted[i].text == texts[i] for i in redacted if i != 3)
    assert set(seen["best-fit packing"]) == set(redacted)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(redacted)


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
