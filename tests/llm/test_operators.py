"""The training-data operators against brute force, exact round trips and held-out accuracy, on small fixtures."""

import base64
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

import __spark_entry__  # noqa: E402
from quillmark.llm import bpe, hmm, html, jaccard, packing, quality, topk, toxicity, urlfilter, warc  # noqa: E402
from quillmark.llm.text import LETTERS_ONLY, Texts, mix  # noqa: E402

from tests.compare import same  # noqa: E402

SPACES = "[\x20\x09-\x0d]+"


def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def tokens(text, lower=True):
    text = text or ""
    if lower:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return [w for w in re.split(SPACES, text) if w]


def test_op10_and_op9_match_their_sql(spark, sf):
    for name in ("op9_warc", "op10_topk"):
        same(spark, sf, __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name])


# --- 1: Jaccard join -----------------------------------------------------------------------


def shingles(text, k=5):
    w = tokens(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def groups(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    return {i: (len(sets[i]), root[i]) for i in range(len(texts))}


def test_jaccard_groups_are_exact(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = rng.choices(vocabulary, k=60)
    texts = [None, "", " \n", "one two", "ONE  two", "one two three", "a b c d e", "a b c d e"]
    for _ in range(6):
        base = rng.choices(vocabulary, k=rng.choice([30, 120, 400]))
        for _ in range(6):  # copies with ever more edits, around the threshold
            own = list(base)
            for _ in range(rng.randint(0, len(own) // 25)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    texts += [" ".join(shared + rng.choices(vocabulary, k=20)) for _ in range(25)] + [texts[9]] * 20
    got = {r["key"]: (r["n_shingles"], r["component_id"]) for r in jaccard.linked(docs(spark, texts)).collect()}
    assert got == groups(texts)


def test_prefix_tree_counts_what_pairs_share():
    rng = np.random.RandomState(1)
    pool = np.unique(rng.randint(0, 2**60, 80).astype(np.uint64))
    base = rng.choice(pool, 50, replace=False)
    sets = [np.sort(rng.choice(pool, rng.randint(1, 60), replace=False)) for _ in range(40)] + [np.unique(np.r_[base[rng.rand(50) < 0.95], rng.choice(pool, 3)]) for _ in range(40)]
    tree, t = jaccard.PrefixTree(sets), jaccard.Threshold(80, 100)
    everyone = np.arange(len(sets))
    found = tree.overlaps(everyone, everyone, t)
    links = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            want, linked = len(np.intersect1d(a, b)), t.met(len(np.intersect1d(a, b)), len(a), len(b))
            links += linked
            assert i == j or found[i, j] in ((want,) if linked else (0, want) if t.met(found[i, j], len(a), len(b)) else range(want + 1))
    assert links > 100


@pytest.mark.parametrize(("name", "value"), [("PART_SHINGLES", 150), ("LIST_ROWS", 1)])
def test_jaccard_of_divided_groups_and_lists(spark, monkeypatch, name, value):
    monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(500)]
    base, texts = rng.choices(vocabulary, k=60), []
    for _ in range(70):  # one family, of which some reach the threshold with few others only
        own = list(base)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        texts.append(" ".join(own))
    got = {r["key"]: (r["n_shingles"], r["component_id"]) for r in jaccard.linked(docs(spark, texts)).collect()}
    assert got == groups(texts) and 1 < len({c for _, c in got.values()}) < 60


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[i.bit_count() % 2] for i in range(n))


def test_jaccard_tells_long_words_apart(spark):
    texts = [f"{thue_morse(n, *ab)} b c d e" for n in (64, 1024, 4096) for ab in ("ab", "ba")] + [thue_morse(50_000) + " b c d e"] * 2
    got = {r["key"]: r["component_id"] for r in jaccard.linked(docs(spark, texts)).collect()}
    assert got == {i: min(i, 6) for i in range(8)}


def test_jaccard_of_nothing(spark):
    assert jaccard.linked(docs(spark, []).where("doc_id < 0")).count() == 0


def test_deduplicated_keeps_one_of_each_group(spark):
    df = docs(spark, ["a b c d e f", "a b c d e f", "x y z u v w"]).withColumn("block", F.lit(1))
    assert sorted(r["doc_id"] for r in jaccard.deduplicated(df.unionByName(df)).collect()) == [0, 2]
    twice = df.withColumn("n", F.lit(2)).unionByName(df.withColumn("n", F.lit(1))).unionByName(spark.createDataFrame([(None, "a b c d e f", 7, 3)], "doc_id long, text string, block int, n int"))
    for part in (1, 5):  # whichever way the rows come
        assert sorted(tuple(r)[0::3] for r in jaccard.deduplicated(twice.repartition(part)).collect() if r["doc_id"] is not None) == [(0, 1), (2, 1)]
    assert jaccard.deduplicated(twice).where("doc_id is null").count() == 1


def test_jaccard_of_rows_that_repeat_or_lack_a_key(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "z y x w v u"), (4, "z y x w v u"), (None, "a b c d e f"), (5, None), (5, None)]
    got = sorted((r["key"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["key"] is not None)
    assert got == [(1, 2, 1), (1, 2, 1), (1, 2, 1), (4, 2, 1), (5, 0, 5), (5, 0, 5)]


# --- 2: toxicity ---------------------------------------------------------------------------


def test_toxicity_learns_words_and_scores_everything(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices("the of and in to red blue tree".split(), k=30) + ["vile"] * (i % 3 == 0)) for i in range(240)] + [None, "", "VILE!"]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 200)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    df = docs(spark, texts).withColumn("score", F.lit("x"))
    model = toxicity.trained(df, labels, "toxic")
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(df, model).collect()}
    assert len(got) == 243 and all(0 <= s <= 1 for s in got.values())
    low, high = max(got[i] for i in range(240) if i % 3), min(got[i] for i in range(240) if i % 3 == 0)
    assert low < high and got[242] > low and got[240] == got[241] < 0.5
    assert {r["doc_id"] for r in toxicity.filtered(df, model, cut=high).collect()} == {i for i in range(243) if got[i] < high}


def test_toxicity_without_labels(spark):
    model = toxicity.trained(docs(spark, ["a"]), spark.createDataFrame([], "doc_id long, toxic int"), "toxic")
    assert toxicity.scored(docs(spark, ["a", None]), model).agg(F.min("score")).first()[0] == 0.5


def _toxic_features(text):
    """The hashed features of one text, word by word."""
    mask, wrap = (1 << toxicity.BITS) - 1, (1 << 64) - 1

    def mixed(x):
        return int(mix(np.array([x & wrap], np.uint64))[0])

    def of(word):
        return int(Texts(pa.array([word])).words(lower=True, between=LETTERS_ONLY).hashes[0])

    words = [w.lower() for w in re.findall(r"[A-Za-z]+", text)]
    found = {mixed(of(w) + 11) & mask for w in words}
    for size in toxicity.STEMS:
        found |= {mixed(of(w[:size]) + 100 + size) & mask for w in words if len(w) > size}
    for gap, salt in ((1, 13), (2, 17)):
        found |= {mixed(mixed(of(a) + salt) * 3 + of(b)) & mask for a, b in zip(words, words[gap:])}
    return found


def test_toxicity_against_a_plain_loop(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices("the of and in to red blue treehouse Tree, wonderful".split(), k=rng.choice([1, 9, 30])) + ["vile insult"] * (i % 3 == 0)) for i in range(60)]
    labels = [(i, int(i % 3 == 0)) for i in range(50)]
    w, n, z, bias = {}, {}, {}, 1 << toxicity.BITS

    def weight(i):
        zi, l1 = z.get(i, 0.0), 0.0 if i == bias else toxicity.L1
        if abs(zi) <= l1:
            return 0.0
        return -(zi - math.copysign(l1, zi)) / ((toxicity.BETA + math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA + toxicity.L2)

    rows = sorted((str(k), y) for k, y in labels)
    order = np.random.RandomState(5)
    for _ in range(toxicity.EPOCHS):
        for at in order.permutation(len(rows)):
            own = [*_toxic_features(texts[int(rows[at][0])]), bias]
            now = {i: weight(i) for i in own}
            slope = 1 / (1 + math.exp(-sum(now.values()))) - rows[at][1]
            if abs(slope) < 1e-3:
                continue
            for i in own:
                step = (math.sqrt(n.get(i, 0.0) + slope**2) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i], n[i] = z.get(i, 0.0) + slope - step * now[i], n.get(i, 0.0) + slope**2
    w = {i: weight(i) for i in z}
    df = docs(spark, texts)
    model = toxicity.trained(df, spark.createDataFrame(labels, "doc_id long, toxic int"), "toxic")
    assert dict(zip(model[0].tolist(), model[1].tolist())) == pytest.approx({i: x for i, x in w.items() if x})
    for r in toxicity.scored(df, model).collect():
        margin = sum(w.get(i, 0.0) for i in _toxic_features(texts[r["doc_id"]])) + w[bias]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-margin)))


# --- 3: urls -------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://A.example.COM/en/1?x#y", "a.example.com", "/en/1", "example.com/en/", "block"), ("https://www.example.com/en/2", "www.example.com", "/en/2", "www.example.com/en/", "allow"),
        ("https://b.com/de/", "b.com", "/de/", "com/", "allow"), ("http://x.net/es/3", "x.net", "/es/3", "net/es/", "block"), ("http://x.net/fr", "x.net", "/fr", None, None), ("http://notcom/en/", "notcom", "/en/", None, None),
        (None, "", "", None, None), ("example.com/en/1", "", "", None, None), ("http://h.com?q=://z", "h.com", "", None, None), ("x://://a/b", "", "", None, None),
    ],
)
def test_url_rules(spark, url, host, path, rule, verdict):
    row = urlfilter.judged(spark.createDataFrame([(1, url, "h")], "page_id int, url string, host string"), "url", [0.0] * (urlfilter.BUCKETS + 1)).first()
    if url == "x://://a/b":
        host, path = ":", "//a/b"
    assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
    assert verdict is None or row["verdict"] == verdict


def test_url_model_tells_its_classes(spark):
    weights = urlfilter.trained(urlfilter.labelled_table(spark))
    urls = [("http://www.cheap-pills.example.org/de/1", "block"), ("http://m.casino-win.example.net/en/9", "block"), ("http://free-bets.example.org/es/3", "block"), ("http://ththing.example.org/en/7", "allow"), ("http://blog.garden.example.net/de/88", "allow")]
    got = urlfilter.judged(spark.createDataFrame(urls, "url string, want string"), "url", weights).collect()
    assert [r["verdict"] for r in got] == [r["want"] for r in got]
    assert not any("Python" in line or "Arrow" in line for line in urlfilter.judged(spark.createDataFrame(urls, "url string, want string"), "url", weights)._jdf.queryExecution().executedPlan().toString().split("\n"))


def test_url_model_on_hosts_it_has_not_seen(spark):
    def host(url):
        return url.split("//")[1].split("/")[0]

    known = {host(url) for url, _ in urlfilter.LABELLED}
    fresh = [(url, y) for url, y in urlfilter.examples(2, 300) if host(url) not in known]
    got = urlfilter.judged(spark.createDataFrame(fresh, "url string, y int"), "url", urlfilter.trained(urlfilter.labelled_table(spark))).where("rule IS NULL").select("y", (F.col("score") >= 0.5).cast("int").alias("said")).collect()
    assert sum(r["y"] == r["said"] for r in got) / len(got) >= 0.9
    assert sum(r["said"] for r in got if not r["y"]) / sum(not r["y"] for r in got) <= 0.02


# --- 4: html -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def field():
    return html.trained()


def test_html_field_on_fresh_pages(field):
    right = total = 0
    for page, labels in html.labelled_pages(60, seed=77):
        got = field.viterbi(html.describe(html.blocks_of(page)))
        right, total = right + sum(a == b for a, b in zip(got, labels, strict=True)), total + len(labels)
    assert right / total > 0.97


def test_viterbi_is_the_best_labelling(field):
    page, _ = html.labelled_pages(1, seed=5)[0]
    described = html.describe(html.blocks_of(page))[:9]

    def score(labels):
        total = field.start[labels[0]]
        for i, (found, label) in enumerate(zip(described, labels, strict=True)):
            total += label * sum(field.gain.get(f, 0.0) for f in found) + (field.move[labels[i - 1]][label] if i else 0)
        return total

    best = max(itertools.product((0, 1), repeat=len(described)), key=score)
    assert abs(score(best) - score([int(x) for x in field.viterbi(described)])) < 1e-9


def test_html_cases(spark, field):
    page = "<html><head><title>no</title><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Menu</a></li></ul></nav><div class=\"ad\">Buy a thing today.</div><article><h1>T &amp;amp; &#233;</h1><p><b>One\n two.<br><p>x</p></article><footer>&copy; me</footer></body></html>"
    rows = spark.createDataFrame([(1, page, "t"), (2, None, "t"), (3, "", "t"), (4, page + "<p", "t"), (1, page, "t")], "page_id int, html string, text string")
    got = sorted((r["page_id"], r["text"]) for r in html.extracted(rows, field).collect())
    main = "T &amp; é\nOne two.\nx"
    assert got[0] == got[1] == (1, main) and got[2] == (2, "") and got[3] == (3, "") and got[4][1].startswith(main)


# --- 5: language model ---------------------------------------------------------------------


def test_hmm_base_scores_and_forward(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices("the of cat dog Sat on mat a b".split(), k=rng.randint(1, 60))) for _ in range(60)] + [None, "", "zzz the"]
    df = docs(spark, texts).withColumn("held_out", F.lit(9)).select("doc_id", "text")
    got = {r["doc_id"]: r for r in hmm.scored(df, F.col("doc_id") % 7 == 2, rounds=1).collect()}
    counts = {}
    for i, t in enumerate(texts):
        if i % 7 != 2:
            for w in [*tokens(t), None]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        own = [*tokens(t), None]
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"], got[i]["held_out"]) == (len(own), sum(w in counts for w in own), n, i % 7 == 2)
        assert got[i]["base_score"] == pytest.approx(sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in own))
        assert got[i]["score"] < 0


def test_hmm_forward_is_a_sum_over_paths_and_counts_add_up(monkeypatch):
    model = hmm.Model.first(np.ones(hmm.CLASSES, np.int64))
    text = np.array([3, 70, 3], np.uint16)
    total = sum(model.start[a] * model.emit[3, a] * model.move[a, b] * model.emit[70, b] * model.move[b, c] * model.emit[3, c] for a, b, c in itertools.product(range(hmm.STATES), repeat=3))
    assert model.log10([text, text[:1]])[0] == pytest.approx(np.log10(total))
    counts = model.expected([text, text])
    rng = np.random.RandomState(3)
    model = hmm.Model.from_counts(rng.rand(hmm.STATES * (hmm.STATES + 1) + hmm.CLASSES * hmm.STATES))
    text = rng.randint(0, 5, 3 * hmm.STRETCH + 7)
    whole, parts = model.expected([text, text[:9]]), model.expected([text[:9]])
    monkeypatch.setattr(hmm, "STRETCH", 10_000)
    assert np.allclose(whole, model.expected([text]) + parts)
    assert counts[: hmm.STATES].sum() == pytest.approx(2) and counts[hmm.STATES : hmm.STATES * (hmm.STATES + 1)].sum() == pytest.approx(4) and counts[hmm.STATES * (hmm.STATES + 1) :].sum() == pytest.approx(6)


# --- 6: byte-level BPE ---------------------------------------------------------------------


def test_bpe_equals_the_library_and_decodes(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    parts = ["a", "B", " ", "  ", "\n", "\t", "\u00a0", "'s", "'", "é", "\u3000", "12", "!", "?.", "\x1c", "\r\n", "漢字", "word", "x\u0301", "%%%", "🎉", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(300)] + [None, "", " ", "ab" * 300, "the quick brown fox, jumping. " * 50]
    for r in bpe.encoded(docs(spark, texts), path, public_tokenizers.PATTERN).collect():
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == own.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()


# --- 7: quality ----------------------------------------------------------------------------


def test_quality_counts(spark):
    texts = [None, "", "a b c a b c", "x\nx\n\n \nx y\nx", "É#é *&| a!\tB", "one"]
    got = {r["doc_id"]: r for r in quality.counted(docs(spark, texts).withColumn("n_words", F.lit("z"))).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = tokens(t, lower=False)
        three = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        covered = {j + k for j, g in enumerate(three) if three.count(g) > 1 for k in range(3)}
        held = [x for x in t.split("\n") if tokens(x)]
        assert [got[i][c] for c in quality.COUNTS[:5]] == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(held) - len(set(held)), len(covered)]


@pytest.mark.parametrize(("k", "n"), [(0, 50), (1, 40), (5, 200), (40, 400)])
def test_risk_bound_is_the_binomial_one(k, n):
    p = quality.risk_bound(k, n, 0.05)
    import math

    below = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert below == pytest.approx(0.05, abs=1e-6)


def test_cutoffs_keep_their_risk():
    good, bad = [0] * (quality.BINS + 1), [0] * (quality.BINS + 1)
    good[0], good[20], bad[90], bad[10] = 2000, 5, 50, 40
    assert quality.cutoff(good, bad, 0.01, 0.01) == 90
    assert quality.cutoff([30] + [0] * quality.BINS, bad, 0.01, 0.01) is None
    assert quality.cutoff(good, [0] * (quality.BINS + 1), 0.01, 0.01) is None


# --- 8: packing ----------------------------------------------------------------------------


def cost_of(places, costs, ends, size):
    at, total = 0, 0
    for e in ends:
        n = e - at
        total += (0 if n & (n - 1) == 0 else size - n) + (dict(zip(places, costs, strict=True)).get(e, packing.HARD_CUT) if e != places[-1] else 0)
        at = e
    return total


def test_cuts_are_the_cheapest():
    rng = random.Random(9)
    for _ in range(40):
        places = np.array([0, *itertools.accumulate(rng.randint(1, 100) for _ in range(rng.randint(1, 9)))])
        costs = np.array([rng.choice([0, 8, 48]) for _ in places])
        costs[-1] = 0
        inner = list(range(1, len(places) - 1))
        best = min(
            cost_of(places.tolist(), costs.tolist(), [int(places[i]) for i in chosen] + [int(places[-1])], 256)
            for r in range(len(inner) + 1) for chosen in itertools.combinations(inner, r)
            if all(b - a <= 256 for a, b in itertools.pairwise([0, *[int(places[i]) for i in chosen], int(places[-1])]))
        )
        ends = packing.cuts(places, costs, 256)
        assert all(b - a <= 256 for a, b in itertools.pairwise([0, *ends])) and ends[-1] == places[-1]
        assert cost_of(places.tolist(), costs.tolist(), ends, 256) <= best + packing.HARD_CUT * 8


def test_packing_holds_every_id_once(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    own = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(3)
    parts = ["the ", "Word", "\n", "é", "İ", "Σ", ".", "!! ", "<|endoftext|>", "'s", "12", "—", "e\u0301", "漢", "| ", "K"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(200)] + [None, "", "one long line " * 3000, "x" * 5000]
    pieces = {}
    windows = {}
    for r in packing.packed(docs(spark, texts), path).collect():
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"]
        pieces.setdefault(r["doc_id"], []).append((r["start"], ids, r["doc_tokens"]))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        want = own.encode(t or "", add_special_tokens=False).ids + [packing.END_ID]
        got = [x for _, ids, _ in sorted(pieces[i]) for x in ids]
        assert got == want and {n for *_, n in pieces[i]} == {len(want)}
    for held in windows.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= packing.SIZE


# --- 9: archives ---------------------------------------------------------------------------


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    records = [("http://a.b/c d", "-", b"<p>\nhttp://fake 1.1.1.1 20240101000000 text/html 5\n</p>"), ("", "-", b""), ("http://x/é", "ab", b"\r\n\r\nWARC/1.1")]
    got = [(r.version, r.url, r.payload) for r in warc.arc_records(warc.arc_bytes(records, version, "n"))]
    assert got == [(version, "http://a.b/c%20d", records[0][2]), (version, "-", b""), (version, "http://x/é", records[2][2])]


def test_bad_arc_is_told():
    with pytest.raises(ValueError):
        list(warc.arc_records(warc.arc_bytes([("u", "-", b"abc")], 1, "n")[:-3]))


def test_archive_round_trip(spark):
    big = "WARC/1.1\r\n\r\n\r\n\r\n" + "é" * 1200
    rows = [(1, "http://a", big), (2, None, big), (5, "u", "small"), (6, "u", "small"), (7, "u", None), (9, "u", big), (None, "u", "x"), (-3, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash")).select("page_id", "url", "html")
    got = {r["key"]: r for r in warc.archived(df, "page_id", "url", "html").collect()}
    assert set(got) == {1, 2, 5, 6, 7, 9, -3}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items() if k in (1, 2, 9)} == {1: ("revisit", 9), 2: ("revisit", 9), 9: ("response", None)}
    for k, _, text in rows:
        if k is not None:
            assert got[k]["payload_digest"] == hashlib.sha1((text or "").encode()).hexdigest() and got[k]["payload_bytes"] == len((text or "").encode())
            assert got[k]["record_type"] == "revisit" or got[k]["payload"] == (text or "")


def test_archives_are_read_as_streams(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS", 3)
    ends = ["", "\r", "\n", "\r\n", "\r\n\r", "\r\n\r\n", "\r\n\r\n\r\n", "\r\r\n\r\n", "\r\n\r\r\n\r\n"]
    texts = [start + body + end for start in ends for body in ("", "x", "y" * 70_000) for end in ends] + ["z" * 65_000 + "\r\n\r" * 2_000 + "\r\n\r\n" * 2_000]
    df = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").withColumn("url", F.lit("u")).repartition(3)
    got = {r["key"]: r for r in warc.archived(df, "page_id", "url", "html").collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        assert got[k]["payload_digest"] == hashlib.sha1(text.encode()).hexdigest()
        assert (got[k]["payload"] == text) if got[k]["record_type"] == "response" else (texts[got[k]["refers_to"]] == text)


def test_bad_warc_is_told():
    whole = [b"WARC/1.1\r\nContent-Length: 6", b"a", b"b"]
    assert list(warc.warc_records(whole)) == [({"Content-Length": "6"}, b"a\r\n\r\nb")]
    for bad in ([b"WARC/1.1\r\nContent-Length: 60", b"a"], [b"WARC/1.1\r\nContent-Length: 3", b"a", b"b"], [b"HTTP/1.1"]):
        with pytest.raises(ValueError):
            list(warc.warc_records(bad))


# --- 10: top k -----------------------------------------------------------------------------


def test_dual_tree_equals_brute_force():
    rng = np.random.RandomState(0)
    points = np.floor(rng.randn(700, 8) * 20)
    points[200:500] = points[0]  # many copies of one vector
    ids, own = np.arange(700), np.arange(0, 700, 50)
    kept, known = topk._thinned(points, ids, 6)
    best = topk.dual_tree_topk(points[own], own, kept, known, 5)
    for i, q in enumerate(own):
        scores = points @ points[q]
        want = sorted(((-s, j) for j, s in enumerate(scores) if j != q))[:5]
        assert [(-s, j) for s, j in zip(best.score[i], best.id[i], strict=True)] == want


def test_topk_leaves_unsound_vectors_out(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [3.0, 1.0]), (5, [float("inf"), 0.0]), (6, [1.0]), (7, []), (4, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    got = [tuple(r) for r in topk.exact_topk(df, df.where("id = 0"), 5).collect()]
    assert got == [(0, 1, 4, 5.0)]


# --- pipeline ------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    documents = spark.read.parquet(f"{sf}/documents.parquet")
    kept = documents
    for _, stage in p.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, sf).persist()
        assert kept.columns == documents.columns and kept.exceptAll(before).count() == 0
    last = p.STAGES[-1][1](spark, kept, sf)
    assert {r["doc_id"] for r in last.select("doc_id").collect()} == {r["doc_id"] for r in kept.select("doc_id").collect()}
    texts = [r["text"] for r in kept.collect()]
    assert len({i for _, i in groups(texts).values()}) == len(texts)


def test_empty_tables_and_null_rows(spark):
    none = docs(spark, ["x"]).where("doc_id < 0")
    nulls = spark.createDataFrame([(None, None), (1, None)], "doc_id long, text string")
    assert hmm.scored(none, F.lit(False)).count() == 0 and hmm.scored(nulls, F.col("doc_id") == 1).count() == 2
    assert packing.packed(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert quality.counted(none).count() == 0 and quality.counted(nulls).count() == 2
    labels = spark.createDataFrame([], "doc_id long, quality int")
    many = spark.createDataFrame([(1, "w " * 30 + " ".join(f"v{i}" for i in range(300)), "en", 777, "x")], "doc_id long, text string, lang string, n_words long, `a.b` string")
    assert [tuple(r)[3:] for r in quality.filtered(many, labels, "quality", "lang").collect()] == [(777, "x")]
    page = spark.createDataFrame([("http://h.org/a", 5, 6, "z")], "url string, __buckets int, score int, `a.b` string")
    judged = urlfilter.judged(page, "url", [0.0] * (urlfilter.BUCKETS + 1)).first()
    assert (judged["__buckets"], judged["a.b"], judged["host"], judged["score"]) == (5, "z", "h.org", 0.5)
    assert quality.filtered(nulls.withColumn("lang", F.lit(None).cast("string")), labels, "quality", "lang").count() == 0
    pages = none.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html"))
    assert warc.archived(pages, "page_id", "url", "html").count() == 0
    assert sorted(r["component_id"] for r in jaccard.linked(docs(spark, [None, "", "a"])).collect()) == [0, 1, 2]
    vectors = spark.createDataFrame([], "id long, vec array<double>")
    assert topk.exact_topk(vectors, vectors, 5).count() == 0


def test_units_are_told_apart_by_their_bytes(spark):
    """Units with equal hashes, and long words that a polynomial hash would take for one."""
    import tiktoken
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [f"x {thue_morse(1024)} {thue_morse(1024, 'b', 'a')} y", "q" * 20_000, "".join(random.Random(1).choices("etaoinshrdlu", k=3_000)), "Aa aA " * 3]
    got = {r["doc_id"]: r for r in bpe.encoded(docs(spark, texts), path, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        assert got[i]["ids"] == library.encode_ordinary(t) and bytes(got[i]["decoded"]).decode() == t
    word = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.packed(docs(spark, texts), word).collect()
    for i, t in enumerate(texts):
        own = sorted((r["start"], bytes(r["ids"])) for r in pieces if r["doc_id"] == i)
        assert np.frombuffer(b"".join(x for _, x in own), "<u4").tolist() == [*Tokenizer.from_file(word).encode(t, add_special_tokens=False).ids, 1]


def test_equal_hashes_do_not_make_units_equal():
    import pyarrow as pa
    from quillmark.llm.text import Texts
    from quillmark.llm.units import UnitIds

    units = UnitIds(lambda raw: (np.array([x[0] for x in raw], np.int32), np.ones(len(raw), np.int64)))
    for text in ("abcab", "cdbaa"):
        texts = Texts(pa.array([text]))
        at = np.arange(5)
        rows = units.look_up(texts, at, at + 1, np.full(5, 7, np.uint64))
        assert units.ids(rows).tolist() == list(text.encode())
