"""The pipeline's near-dedup stage against all pairs by brute force."""

import random

import corpus_pipeline
from tessergraph.llm import neardup


def brute(texts):
    """The least index of each class of texts, by exact Jaccard similarity of five-word shingles over all pairs."""

    def cut(t):
        words = (t or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    all_sets, root = [cut(t) for t in texts], list(range(len(texts)))
    for i, x in enumerate(all_sets):
        for j, y in enumerate(all_sets[:i]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y) > 0:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def corpus():
    rng = random.Random(5)
    plain = ["".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(400)]
    passage, texts = " ".join(rng.choice(plain) for _ in range(60)), []
    for i in range(40):
        words = [rng.choice(plain) for _ in range(rng.choice([5, 8, 60, 150, 300]))] + (passage.split() if i % 4 == 0 else [])
        for k in range(rng.choice([1, 2, 4])):
            near = list(words)
            for _ in range(k * rng.choice([0, 1, 1, 2, 3])):
                near[rng.randrange(len(near))] = rng.choice(plain)
            texts.append(" ".join(near))
    chain = [rng.choice(plain) for _ in range(100)]
    for k in range(6):
        texts.append(" ".join(chain[k * 6 : k * 6 + 70]))
    texts += [passage + " " + rng.choice(plain) for _ in range(5)] + ["a b", "A  B", "a b c d", None, "", " "]
    rng.shuffle(texts)
    return texts


def test_stage_keeps_one_of_each_class_of_near_copies(spark):
    texts = corpus()
    root = brute(texts)
    assert 20 < len(set(root)) < len(set(texts)) - 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.classes(docs).collect()}
    assert got == dict(enumerate(root))
    kept = dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))


def test_pivot_tables_discard_no_similar_pair():
    rng = random.Random(8)
    np = neardup.np
    for trial in range(40):
        base = np.array([rng.getrandbits(63) for _ in range(rng.choice([3, 9, 40, 90, 400]))], dtype=np.int64)
        made = []
        for _ in range(30):
            keep = base[[rng.random() > rng.choice([0, 0.05, 0.15, 0.3]) for _ in base]]
            made.append(np.unique(np.concatenate([keep, np.array([rng.getrandbits(63) for _ in range(rng.randrange(1 + len(base) // 5))], dtype=np.int64)])))
        made = [h for h in made if len(h)]
        sizes, ids = np.array([len(h) for h in made]), np.arange(len(made))
        side = ids % 2
        want = {(i, j) for i in ids for j in ids if i < j and 5 * len(np.intersect1d(made[i], made[j])) >= 4 * len(np.union1d(made[i], made[j]))}
        bits = [neardup.fingerprint(h) for h in made]
        assert want <= set(neardup.similar_in(ids, sizes, ids, side, bits, False))
        assert {(i, j) for i, j in want if side[i] != side[j]} <= set(neardup.similar_in(ids, sizes, ids, side, bits, True))


def test_the_order_of_shingles_changes_nothing(spark, monkeypatch):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(neardup, "COMMON", 3)
    monkeypatch.setattr(neardup, "HOT", 4)
    monkeypatch.setattr(neardup, "BLOCK", 2)
    monkeypatch.setattr(neardup, "STARS", 0)
    assert {r.doc_id: r.component_id for r in neardup.classes(docs).collect()} == dict(enumerate(brute(texts)))
