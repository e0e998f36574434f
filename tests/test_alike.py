"""Texts alike by bigrams: blocks and parts against a plain loop, and what the query writes between its steps."""

import random
from collections import Counter
from itertools import combinations

from quillmark.operators import geometry as G
from quillmark.plans import catalog


def _prose(rng, n):
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 7))) for _ in range(200)]
    for _ in range(n):
        yield " ".join(rng.choices(words, k=rng.randint(3, 90)))


def _changed(rng, text):
    at = rng.randrange(len(text))
    return text[:at] + "".join(rng.choices("xyz", k=rng.randint(1, max(1, len(text) // 8)))) + text[at + rng.randint(0, len(text) // 8) :]


def test_alike_against_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    texts = [t.replace(" ", "") for t in _prose(rng, 250)]
    texts += [_changed(rng, t) for t in texts] + ["ab" * 5000, "ab" * 4000, "ba" * 4999 + "c", "ab", "abc", "a", "日本語" * 40, "日本語" * 32, "日本語" * 31, "\U0001f600x" * 9, "\U0001f600x" * 8]
    texts += [chr(i) + chr(i + 1) + "tail" * (i % 7) for i in range(0x4E00, 0x4E00 + 1100)]
    texts = sorted(set(texts))
    grams = [Counter(t[i : i + 2] for i in range(len(t) - 1)) for t in texts]
    want = {}
    for i, j in combinations(range(len(texts)), 2):
        x, y = sorted((len(texts[i]), len(texts[j])))
        if x > 1 and x / y >= 0.8:
            d = round(2 * (grams[i] & grams[j]).total() / (x + y - 2), 6)
            if d >= 0.82:
                want[i, j] = d
    rows = spark.createDataFrame(list(enumerate(texts)), "item long, k string")
    for split in (1_000_000, 500):
        monkeypatch.setattr("quillmark.operators.alike.SPLIT", split)
        found = [(*sorted((r["a"], r["b"])), r["similarity"]) for r in G.alike(rows).collect()]
        assert len(found) == len(want) and {(i, j): d for i, j, d in found} == want
    assert len(want) > 100
    assert G.alike(rows.where("k = ''")).count() == 0


def test_near_dup_dice_moves_little(spark, tmp_path):
    """Lines of one small alphabet share most bigrams, but few are alike: what is shuffled stays near their own size."""
    texts = list(_prose(random.Random(6), 3000))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return store.executorSummary("driver").totalShuffleWrite()

    before = written()
    catalog.QUERIES["near_dup_dice"](spark, str(tmp_path)).collect()
    assert written() - before < 10 * sum(map(len, texts))
