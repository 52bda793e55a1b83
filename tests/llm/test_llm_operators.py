"""Edge cases of the operators: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stayframe.llm import ann, chat, embedding_dedup, langid, lm, minhash, mixing, pieces, quality, sharding, textops
from stayframe.llm.common import maybe_in
from stayframe.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "the cat sat on the mat and ran home", "en", "a", 5), (2, None, None, None, None), (3, "", "en", "b", 0), (4, " \n\t ", "en", "a", 4), (5, "the cat sat on the mat and ran home", "en", "a", 5),
    (6, "ÄÖ ▁ é\x00 😀" * 3, "de", "a", 1), (7, "word " * 30_000, "de", "b", 9), (8, "x" * 5000, "en", "a", 1), (9, "12 34 --", "en", "c", 3), (9, "12 34 --", "en", "c", 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def table():
    return pieces.load()


def test_words_of_slices():
    texts = pa.array(["A b", None, " c\tD ", "", "é É x"] * 50)
    w = textops.words_of(texts.slice(3, 40))
    assert w.per_doc().tolist()[:6] == [0, 3, 2, 0, 2, 0]
    assert [w.vocabulary[int(c)].as_py() for c in w.code[:5]] == ["é", "É", "x", "a", "b"]


def test_pieces_without_dropout_are_the_librarys(table):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    texts = [t for _, t, *_ in ODD if t and "▁" not in t and "\x00" not in t] + ["  two  blanks ", "<0x41></s>", "Hello, world!\nAgain"]
    ids, counts = pieces.encode_texts(table, texts, np.zeros(len(texts), np.uint64), 0.0)
    at = np.concatenate(([0], np.cumsum(counts)))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [model.encode(t) for t in texts]


@pytest.mark.parametrize("dropout", [0.1, 0.5, 1.0])
def test_dropout_equals_the_agenda_and_decodes(table, dropout):
    texts = [t for _, t, *_ in ODD if t is not None] + ["mixed content, " * 9]
    keys = np.arange(len(texts)).astype(np.uint64) * np.uint64(77)
    ids, counts = pieces.encode_texts(table, texts, keys, dropout)
    assert pieces.decode_ids(table, ids, counts).to_pylist() == texts
    at, i = np.concatenate(([0], np.cumsum(counts))), len(texts) - 1
    start = table.char_id[np.array([ord(c) for c in " " + texts[i]])]
    assert [x for _, x in pieces.agenda(table, start, int(keys[i]), 0, dropout)] == ids[at[i] : at[i + 1]].tolist()
    other, _ = pieces.encode_texts(table, texts, keys + np.uint64(1), dropout)
    assert dropout == 1.0 or len(other) != len(ids) or (other != ids).any()


def plain_merges(model, text, key, dropout):
    """Pieces by the best score, leftmost first, in a list that is searched anew for each merge."""
    rank = {model.id_to_piece(i): -model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    parts, at = list(text), list(range(len(text)))
    one = lambda x: np.array([x], np.uint64)
    while True:
        ends, ready = [*at[1:], len(text)], []
        for i in range(len(parts) - 1):
            if (both := parts[i] + parts[i + 1]) in rank and not pieces.skipped(one(key), one(at[i]), one(at[i + 1]), one(ends[i + 1]), dropout)[0]:
                ready.append((rank[both], at[i], i))
        if not ready:
            return parts
        i = min(ready)[2]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del at[i + 1]


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.6])
def test_encoding_equals_plain_merges(table, dropout):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    texts = ["the cat sat on the mat and ran home", "internationalisation of antidisestablishmentarianism", "das wetter ist schön, heute", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "  two  blanks ", "x" * 70]
    keys = (np.arange(len(texts)).astype(np.uint64) + np.uint64(5)) * np.uint64(0x9E3779B97F4A7C15)
    ids, counts = pieces.encode_texts(table, texts, keys, dropout)
    at = np.concatenate(([0], np.cumsum(counts)))
    for i, text in enumerate(texts):
        want = plain_merges(model, (" " + text).replace(" ", pieces.BLANK), int(keys[i]), dropout)
        assert [model.id_to_piece(int(p)) for p in ids[at[i] : at[i + 1]]] == want


def test_piece_frames(docs, none, table):
    clash = docs.withColumn("piece_ids", F.lit("x")).withColumn("__key", F.lit(1))
    back = pieces.decode(pieces.encode(clash, table), table)
    assert back.where("NOT (text <=> decoded)").count() == 0 and back.count() == len(ODD)
    assert back.where("text IS NULL").first()["piece_ids"] is None and back.where("text = ''").first()["piece_ids"] == []
    assert pieces.round_trip(none, table, ["doc_id"]).count() == 0


def test_languages(docs, none, spark):
    model = langid.train(docs)
    got = {r["doc_id"]: r for r in langid.identify(docs.withColumn("lang_pred", F.lit(1)), model).collect()}
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {2, 3, 4, 9} and got[2]["lang_score"] == 0.0
    assert langid.identify(none, model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, langid.train(none)).collect()} == {"und"}
    en, de = "the weather is nice today and we walk through the park", "das wetter ist heute schön und wir gehen durch den garten"
    both = spark.createDataFrame([(en, "en"), (de, "de")], "text string, lang string")
    r = langid.identify(spark.createDataFrame([(f"{en} {de}",)], "text string"), langid.train(both)).first()
    assert sorted(r["lang_set"]) == ["de", "en"] and sum(r["lang_shares"]) == pytest.approx(1)


def test_mixtures_equal_a_plain_model(docs, spark):
    """Trigrams, mixture and the choice of the language set, by dictionaries."""
    said = {"en": "the weather is nice today and we walk", "de": "das wetter ist heute sehr gut und wir gehen", "fr": "le temps est beau et nous marchons encore"}
    model = langid.train(spark.createDataFrame([(t, k) for k, t in said.items()], "text string, lang string"))
    assert model.languages == ("de", "en", "fr")
    for text in [said["en"], f"{said['en']} {said['de']}", " ".join(said.values()), "une the und", "Wetter, 12 le!"]:
        doc, gram, count = langid.gram_counts([text])
        p = np.exp(model.log_p[gram])
        w = np.full(3, 1 / 3)
        for _ in range(12):
            r = p * w
            w = (r / r.sum(1, keepdims=True) * count[:, None]).sum(0) / count.sum()
        like = lambda x: float((count * np.log(p @ x)).sum())
        single = [like(np.eye(3)[k]) for k in range(3)]
        best, sets = max(single), {0: None}
        chosen, cost = {int(np.argmax(single))}, 3.0 * math.log(max(count.sum(), 2)) / 2
        for size in (2, 3):
            used = np.argsort(-w, kind="stable")[:size]
            x = np.zeros(3)
            x[used] = 1 / size
            for _ in range(12):
                r = p * x
                x = (r / r.sum(1, keepdims=True) * count[:, None]).sum(0) / count.sum()
            if like(x) - (size - 1) * cost > best:
                best, chosen = like(x) - (size - 1) * cost, set(used.tolist())
        lang, score, langs, shares, covered = langid.mixtures(model, [text])[0]
        assert {model.languages.index(k) for k in langs} == chosen and sum(shares) == pytest.approx(1) and sets
        assert score == pytest.approx(w[model.languages.index(lang)]) and covered == pytest.approx(min(1, w[list(chosen)].sum()))
    tie = langid.train(spark.createDataFrame([("same words", "b"), ("same words", "a")], "text string, lang string"))
    assert langid.mixtures(tie, ["same words"])[0][0] == "a"
    clash = docs.withColumns({"lang_pred": F.lit(1), "score": F.lit(2)})
    kept = langid.kept_by_language(clash, langid.train(docs), 0.3)
    assert kept.columns == clash.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 5, 6, 7, 8]
    four = langid.train(spark.createDataFrame([(c * 3 + " " + c * 5, c) for c in "abcd"], "text string, lang string"))
    even = spark.createDataFrame([(" ".join(c * 5 for c in "abcd") * 20,)], "text string")
    assert langid.kept_by_language(even, four, 0.3).count() == 1


def test_em_equals_a_plain_loop():
    rng = np.random.default_rng(0)
    p, count = rng.random((6, 3)), rng.integers(1, 5, 6).astype(float)
    doc = np.array([0, 0, 0, 1, 1, 1])
    got, _ = langid.em(p, doc, count, np.ones((2, 3)), 20)
    for d in (0, 1):
        w = np.full(3, 1 / 3)
        for _ in range(20):
            r = p[doc == d] * w
            w = (r / r.sum(1, keepdims=True) * count[doc == d, None]).sum(0) / count[doc == d].sum()
        assert got[d] == pytest.approx(w)


def test_quality(docs, none, spark):
    labels = spark.createDataFrame([(1, 1), (5, 1), (5, 0), (9, 0), (8, None), (None, 1)], "doc_id long, quality int")
    stats = quality.measured(docs, ["doc_id"])
    model = quality.train(stats, labels)
    scores = quality.scored(stats, model).collect()
    assert len(scores) == len(ODD) and all(0 <= r["score"] <= 1 for r in scores)
    odd_labels = labels.select("doc_id", F.expr("IF(doc_id = 8, double('NaN'), CAST(quality AS double))").alias("quality"))  # null for 8 above
    assert sorted(map(str, quality.scored(stats, quality.train(stats, odd_labels)).collect())) == sorted(map(str, scores))
    clash = docs.withColumns({"stats": F.lit(1), "score": F.lit("x"), "quality": F.lit(None).cast("int")})
    assert sorted(map(str, quality.kept_by_score(clash, model).select("doc_id").collect())) == sorted(map(str, quality.kept_by_score(docs, model).select("doc_id").collect()))
    unlabelled = quality.train(stats, labels.where("quality > 5"))
    assert {r["score"] for r in quality.scored(stats, unlabelled).collect()} == {0.5}
    assert quality.scored(quality.measured(none, ["doc_id"]), model).count() == 0
    assert set(quality.kept_by_score(docs, model).columns) == set(docs.columns)


def test_ridge_equals_a_direct_solution(spark):
    """The model of all folds, solved from all rows at once, and the calibration from the other folds' scores."""
    rng = np.random.default_rng(16)
    n, width = 300, len(quality.STATISTICS)
    x = rng.normal(size=(n, width))
    y = (x[:, 0] + rng.normal(size=n) > 0).astype(int)
    stats = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id long, stats array<double>").repartition(3)
    model = quality.train(stats, spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, quality int"), features=20)
    f = model.features(x)
    penalty = np.diag(np.append(np.ones(20), 1e-6))
    assert model.mean == pytest.approx(x.mean(0)) and model.scale == pytest.approx(x.std(0))
    assert model.weights == pytest.approx(np.linalg.solve(f.T @ f + penalty, f.T @ y), abs=1e-8)
    fold = {r["doc_id"]: r["f"] for r in stats.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(quality.FOLDS)).alias("f")).collect()}
    fold = np.array([fold[i] for i in range(n)])
    raw = np.zeros(n)
    for k in range(quality.FOLDS):
        rest = fold != k
        raw[~rest] = f[~rest] @ np.linalg.solve(f[rest].T @ f[rest] + penalty, f[rest].T @ y[rest])
    cell = np.floor((raw + 0.5) / model.cell_width).astype(int)
    cells = np.unique(cell)
    fitted = quality.isotonic(np.array([y[cell == c].mean() for c in cells]), np.array([(cell == c).sum() for c in cells], float))
    assert model.calibrated[cells] == pytest.approx(fitted)


def test_isotonic():
    assert quality.isotonic(np.array([1.0, 3, 2, 2, 5]), np.array([1.0, 1, 1, 2, 1])).tolist() == pytest.approx([1, 2.25, 2.25, 2.25, 5])


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 4))
    f = quality.random_features(x, rng.normal(size=(4, 20_000)) / 2.0, rng.uniform(0, 2 * np.pi, 20_000))[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * 2.0**2))
    assert np.abs(f @ f.T - exact).max() < 0.05


def test_minhash_classes(docs, none):
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicate_classes(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1, 6: 6, 7: 7, 8: 8, 9: 9}
    assert minhash.near_duplicate_classes(none).count() == 0


def plain_probability_jaccard(a, wa, b, wb):
    x, y = dict(zip(a.tolist(), wa.tolist())), dict(zip(b.tolist(), wb.tolist()))
    every = set(x) | set(y)
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in every) for d in set(x) & set(y))


def plain_classes(n, links):
    """The smallest member of each place's class."""
    label = list(range(n))
    for _ in range(n):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_probminhash_estimates_probability_jaccard():
    rng = np.random.default_rng(2)
    shared = rng.integers(1, 2**62, 80).astype(np.uint64)
    a, b = np.append(shared, rng.integers(1, 2**62, 30).astype(np.uint64)), np.append(shared, rng.integers(1, 2**62, 10).astype(np.uint64))
    wa, wb = rng.integers(1, 4, 110).astype(float), rng.integers(1, 4, 90).astype(float)
    wb[:80] = wa[:80]
    s = minhash.signatures(np.repeat([0, 1], [110, 90]), np.append(a, b), np.append(wa, wb), 2, 4000)
    exact = plain_probability_jaccard(a, wa, b, wb)
    by_a, by_b = np.argsort(a), np.argsort(b)
    assert minhash.probability_jaccard(a[by_a], wa[by_a], b[by_b], wb[by_b]) == pytest.approx(exact)
    assert (s[0] == s[1]).mean() == pytest.approx(exact, abs=0.03)


def jaccard(a, b):
    return len(np.intersect1d(a, b)) / len(np.union1d(a, b))


def test_block_classes_by_set_jaccard():
    rng = np.random.default_rng(3)
    base = rng.choice(10**6, 60, replace=False)
    sets = [np.unique(np.append(rng.choice(base, 55, replace=False), rng.integers(10**6, 2 * 10**6, k % 12))).astype(np.uint64) for k in range(30)]
    counts = [np.ones(len(s), np.int32) for s in sets]
    got = minhash.joined_by_links(sets, counts, np.arange(30), np.ones((30, 30), bool), 0.8)
    links = [(a, b) for a in range(30) for b in range(a + 1, 30) if jaccard(sets[a], sets[b]) >= 0.8]
    assert got.tolist() == plain_classes(30, links) and 1 < len(set(got.tolist())) < 30


def test_block_classes_by_probability_jaccard():
    """Also where few shingles are shared, but often."""
    one, two = np.arange(18).astype(np.uint64), np.append(np.arange(10), np.arange(100, 108)).astype(np.uint64)
    often = np.append(np.full(10, 1000), np.ones(8)).astype(np.int32)
    assert minhash.joined_by_links([one, two], [often, often], np.arange(2), np.ones((2, 2), bool), 0.8).tolist() == [0, 0]
    rng = np.random.default_rng(8)
    sets = [np.sort(rng.choice(30, 22, replace=False)).astype(np.uint64) for _ in range(40)]
    counts = [np.where(s < 9, 10 ** rng.integers(2, 5), 1).astype(np.int32) for s in sets]
    links = [
        (a, b) for a in range(40) for b in range(a + 1, 40)
        if jaccard(sets[a], sets[b]) >= 0.76 or plain_probability_jaccard(sets[a], minhash.weights(counts[a]), sets[b], minhash.weights(counts[b])) >= 0.76
    ]
    got = minhash.joined_by_links(sets, counts, np.arange(40), np.ones((40, 40), bool), 0.76)
    assert got.tolist() == plain_classes(40, links) and 1 < len(set(got.tolist())) < 40


def test_classes_of_hot_buckets_and_weighted_texts(spark):
    """Buckets of many blocks, with several classes, weighted links and extra columns, against all pairs."""
    rng = np.random.default_rng(11)
    rows, texts = [], []
    for family in range(4):
        base = [f"f{family}w{i}" for i in range(60)]
        for k in range(60):
            words = list(base)
            for at in rng.choice(60, k % 4, replace=False):
                words[at] = f"own{rng.integers(0, 5)}"
            texts.append(" ".join(words))
    texts += ["word " * 3000 + "alpha", "word " * 3000 + "beta", "word " * 3000 + "alpha beta gamma delta"]
    rows = [(3 * i, t, t, 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bands string, rep int")
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicate_classes(docs, block=8).collect()}
    doc, shingle, count = minhash.weighted_shingles(pa.array(texts))
    own = [(shingle[doc == d], minhash.weights(count[doc == d])) for d in range(len(texts))]
    sets = [set(s.tolist()) for s, _ in own]
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    weighted = lambda a, b: min(a, b) >= 240 and plain_probability_jaccard(*own[a], *own[b]) >= 0.8
    links = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if alike(a, b) or weighted(a, b)]
    want = plain_classes(len(texts), links)
    assert [got[3 * i] for i in range(len(texts))] == [3 * w for w in want]
    assert want[241] == 240 and 5 < len(set(want)) < 200


def test_repeated_line_in_a_near_copy(spark):
    """The sets are similar and the weighted shingles aren't."""
    rows = []
    for k in range(10):
        text = " ".join(f"p{k}w{i}" for i in range(64))
        rows += [(2 * k, text), (2 * k + 1, text + "".join(f" p{k}l{i}" for i in range(10)) * 1000)]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(20)}


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (8, 9), (7, 7), (None, 1), (2, 10)] + [(100 + k, 101 + k) for k in range(40)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert got == {**{i: 2 for i in (2, 3, 4, 5, 10)}, 8: 8, 9: 8, **{100 + k: 100 for k in range(41)}}
    assert connected_components(links.limit(0)).count() == 0


def test_bitmap_filter_loses_nothing(spark):
    keys = spark.range(0, 50_000, 7).select(F.col("id").alias("k"))
    kept = maybe_in(spark.range(50_000).select(F.col("id").alias("k")), "k", keys)
    assert kept.join(keys, "k").count() == keys.count() and kept.count() < 12_000


VECTORS = "vec_id long, embedding array<float>, label int"


def test_vector_links(spark):
    odd = [(1, [1.0, 0.0], 1), (2, [2.0, 0.1], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, [0.0, 0.0], 1), (6, None, 1), (7, [float("nan"), 1.0], 1), (8, [1.0, None], 1), (9, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.link_near_duplicates(spark.createDataFrame(odd, VECTORS)).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), **{i: (0, i, True) for i in range(3, 10)}}
    assert embedding_dedup.link_near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_vectors_of_several_lengths(spark):
    """Each length is compared within itself, whether the sample holds it or not."""
    rng = np.random.default_rng(13)
    x = [rng.normal(size=2 + i % 3) for i in range(90)]
    rows = [(i, v.astype(np.float32).tolist(), i % 2, "clash", 1) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, VECTORS + ", cell string, size int")
    exact = [np.array(r[1]) for r in rows]
    cos = lambda a, b: a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)
    near = [sum(i != j and i % 2 == j % 2 and len(a) == len(b) and cos(a, b) >= 0.93 for j, b in enumerate(exact)) for i, a in enumerate(exact)]
    for sample in (None, 1):
        got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.link_near_duplicates(df, sample=sample).collect()}
        assert [got[i] for i in range(90)] == near and sum(near) > 50
    found: dict = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), k=5).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q in range(0, 90, 20):
        others = sorted((-(exact[q] @ b), j) for j, b in enumerate(exact) if j != q and len(b) == len(exact[q]))
        assert [j for _, j in sorted(found[q])] == [j for _, j in others[:5]]


@pytest.mark.parametrize("shape", ["clustered", "normal"])
def test_recall_over_several_shards(spark, shape):
    rng = np.random.default_rng(14)
    x = rng.normal(size=(2400, 24)) + (4 * rng.normal(size=(12, 24)))[rng.integers(0, 12, 2400)] * (shape == "clustered")
    x = x.astype(np.float32).astype(float)
    v = spark.createDataFrame([(i, e.tolist(), 1) for i, e in enumerate([*x, x[0]])], VECTORS)
    v = v.unionByName(v.where("vec_id < 40"))  # repeated ids
    found: dict = {}
    for r in ann.nearest(v, v.where("vec_id % 20 = 0"), shard_rows=600, query_block=50).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    x, hits = np.concatenate([x, x[:1]]), 0
    for q in range(0, 2401, 20):
        score = np.where(np.arange(2401) == q, -np.inf, np.einsum("ij,j->i", x, x[q]))
        assert len(found[q]) == 20
        hits += len(found[q] & set(np.lexsort((np.arange(2401), -score))[:20].tolist()))
    assert hits >= 0.95 * 20 * len(found)


def test_vector_links_in_small_blocks(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(12, 16))
    x = (centre[rng.integers(0, 12, 400)] + rng.normal(size=(400, 16)) * 0.28).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], VECTORS)
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.link_near_duplicates(df, block=40).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (np.arange(400)[:, None] % 2 == np.arange(400) % 2) & ~np.eye(400, dtype=bool)
    assert near.sum() > 100 and [got[i] for i in range(400)] == near.sum(1).tolist()


def test_hot_zones_and_copies_of_vectors(spark, monkeypatch):
    """Half of all rows in one place, in many parts and chunks, and a text's vector a hundred times, with both zeros."""
    monkeypatch.setattr(embedding_dedup, "ROUTED", 50)
    rng = np.random.default_rng(5)
    x = np.concatenate([np.tile([1.0, 0, 0, 0, 0, 0], (250, 1)) + rng.normal(size=(250, 6)) * 0.02, np.tile([0, -1.0, 0.0, 0, 2, 0], (100, 1)), rng.normal(size=(150, 6))])
    x[300:350, 0] = -0.0
    x = x.astype(np.float32).astype(float)[rng.permutation(500)]
    df = spark.createDataFrame([(i + 7, v.tolist(), 1) for i, v in enumerate(x)], VECTORS)
    got = {r["vec_id"] - 7: (r["n_links"], r["component_id"] - 7) for r in embedding_dedup.link_near_duplicates(df, block=30).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.93
    reach = np.arange(500)
    for _ in range(500):
        reach = np.where(near, reach, 500).min(axis=1)
    assert [got[i] for i in range(500)] == list(zip((near.sum(1) - 1).tolist(), reach.tolist(), strict=True))


def test_near_lists_have_near_numbers():
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(8, 12)) * 5, 20, axis=0) + rng.normal(size=(160, 12)) * 0.1
    mixed_up = rng.permutation(x)
    ordered = embedding_dedup.by_nearness(mixed_up)
    leaps = lambda p: (np.linalg.norm(np.diff(p, axis=0), axis=1) > 3).sum()
    assert sorted(map(tuple, ordered)) == sorted(map(tuple, x)) and 5 * leaps(ordered) < leaps(mixed_up)


def test_neighbours_of_few(spark):
    odd = [(0, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [0.0, 0.0], 1), (40, None, 1), (7, [float("inf"), 1.0], 1), (2, [1.0, 0.0], 1)]
    v = spark.createDataFrame(odd, VECTORS)
    got = [tuple(r) for r in ann.nearest(v, v.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 2.0), (0, 2, 2, 1.0), (0, 3, 20, 1.0), (20, 1, 3, 2.0), (20, 2, 0, 1.0), (20, 3, 2, 1.0)]
    assert ann.nearest(v.limit(0), v).count() == 0


@pytest.mark.parametrize("copies", [30, 300])
def test_neighbours_in_groups_of_equal_vectors(spark, copies):
    rng = np.random.default_rng(7)
    x = np.repeat(rng.normal(size=(1200 // copies, 16)), copies, axis=0)
    x = np.concatenate([x, rng.normal(size=(600, 16))]).astype(np.float32).astype(float)[rng.permutation(1800)]
    v = spark.createDataFrame([(i, e.tolist(), 1) for i, e in enumerate(x)], VECTORS)
    hits, asked = 0, list(range(0, 1800, 20))
    found: dict = {}
    for r in ann.nearest(v, v.where("vec_id % 20 = 0"), shard_rows=500).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q in asked:
        score = np.where(np.arange(1800) == q, -np.inf, np.einsum("ij,j->i", x, x[q]))
        best = np.lexsort((np.arange(1800), -score))[:20].tolist()
        assert len(found[q]) == 20
        hits += len({i for _, i in found[q]} & set(best))
    assert hits >= 0.98 * 20 * len(asked)


def test_reply_trees(spark):
    m = [("r", None, "user", "q", None), ("a", "r", "assistant", "<s>", 1.0), ("b", "r", "assistant", "better\\l", 3.0), ("c", "a", "user", None, 9.0), ("d", "lost", None, "[INST]", None), (None, None, "user", "x", 1.0)]
    df = spark.createDataFrame(m, "node_id string, parent_id string, role string, text string, score double").withColumn("formatted", F.lit("clash"))
    best = {r["root_id"]: r for r in chat.read_back(chat.format_reply_trees(df)).collect()}
    assert best["r"]["texts"] == ["q", "<s>", ""] and best["r"]["loss_texts"] == ["<s>"] and best["d"]["roles"] == [""]
    both = chat.read_back(chat.format_reply_trees(df, branches=2)).where("root_id = 'r'").orderBy("branch_rank").collect()
    assert [r["leaf_id"] for r in both] == ["c", "b"] and both[1]["loss_texts"] == ["better\\l"]
    assert chat.format_reply_trees(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["\\", "\\\\", "\\l", "\\\\l", "<s>", "</s>", "[INST]", "[/INST]", "\\<s>", "[[INST]", "<<s>>", "\\b[INST]\\", "", "é\n</s>\\b"])
def test_escapes_are_reversible(spark, text):
    r = spark.createDataFrame([(text,)], "t string").select(chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u")).first()
    assert r["u"] == text and not any(c in r["e"] for c in ("<s>", "</s>", "[INST]", "[/INST]"))


@pytest.mark.parametrize("length", [1, 2, 3, 5, 8])
def test_cycles_of_replies(spark, length):
    """Nodes on a cycle or below one are left out, trees beside it stay whole."""
    rows = [(f"c{k}", f"c{(k + 1) % length}") for k in range(length)] + [("hanging", "c0"), ("deeper", "hanging")]
    rows += [("r", None), ("a", "r"), ("b", "a"), ("x", "r"), *((f"d{k}", f"d{k - 1}" if k else "b") for k in range(9))]
    got = {(r["leaf_id"], r["node_id"], r["above"]) for r in chat.root_to_leaf_paths(spark.createDataFrame(rows, "node_id string, parent_id string")).collect()}
    deep = [*(f"d{k}" for k in range(8, -1, -1)), "b", "a", "r"]
    assert got == {("d8", n, k) for k, n in enumerate(deep)} | {("x", "x", 0), ("x", "r", 1)}


def test_scores_choose_branches(spark):
    """Random trees: all paths, ranks by mean score, then length, then leaf."""
    rng = np.random.default_rng(15)
    parent = {n: (None if n < 3 else int(rng.integers(0, n))) for n in range(60)}
    score = {n: (None if n % 7 == 0 else float(rng.integers(0, 4))) for n in range(60)}
    rows = [(n, p, "assistant" if n % 2 else "user", f"t{n}", score[n]) for n, p in parent.items()]
    df = spark.createDataFrame(rows, "node_id long, parent_id long, role string, text string, score double")
    want: dict = {}
    for leaf in set(parent) - set(parent.values()):
        path = [leaf]
        while parent[path[0]] is not None:
            path.insert(0, parent[path[0]])
        want.setdefault(path[0], []).append((-sum(score[n] or 0.0 for n in path) / len(path), -len(path), leaf, path))
    got = chat.read_back(chat.format_reply_trees(df, branches=2)).collect()
    found = {(r["root_id"], r["branch_rank"]): [int(t[1:]) for t in r["texts"]] for r in got}
    assert found == {(root, k + 1): p[3] for root, paths in want.items() for k, p in enumerate(sorted(paths)[:2])}
    assert all(r["loss_texts"] == [t for t in r["texts"] if int(t[1:]) % 2] for r in got)


def test_long_conversations_are_numbered_over_tasks(spark):
    """Also repeated turns and rows, null turns and conversations, clashing columns and a very long text."""
    long = "<s>\\" * 50_000
    rows = [(1, t, "user" if t % 2 else "assistant", f"t{t}") for t in range(3000)] + [(1, 7, "user", "again"), (1, 7, "user", "again"), (1, None, None, None)]
    rows += [(None, 1, "user", long), (None, 2, "assistant", "b"), (2, 1, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"n": F.lit("clash"), "span": F.lit(1)})
    got = {r["root_id"]["conv_id"]: r for r in chat.read_back(chat.format_reply_trees(chat.conversation_messages(df))).collect()}
    order = sorted((r for r in rows if r[0] == 1), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    assert got[1]["texts"] == [r[3] or "" for r in order] and got[1]["roles"] == [r[2] or "" for r in order]
    assert got[None]["texts"] == [long, "b"] and got[None]["loss_texts"] == ["b"] and set(got) == {1, 2, None}


def test_deep_chain_of_replies(spark):
    m = spark.range(300).select(F.col("id").cast("string").alias("node_id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_id"))
    paths = chat.root_to_leaf_paths(m)
    assert paths.count() == 300 and paths.select("leaf_id").distinct().count() == 1


def test_mixing(docs, none, spark):
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("", 1.0), ("absent", 2.0)], "source string, weight double")
    clash = docs.withColumn("mix_slot", F.lit("x")).withColumn("__size", F.lit(1))
    got = mixing.mix_sources(clash, weights, quanta=10, block_bytes=100).collect()
    assert len(got) == len(ODD) and {r["source"] for r in got if r["mix_slot"] is None} == {"c"}
    assert mixing.mix_sources(none, mixing.tempered_weights(none)).count() == 0


def test_schedule_stays_within_one_block(spark):
    weights = spark.createDataFrame([(f"s{i}", float(w)) for i, w in enumerate([50, 20, 20, 7, 2, 1])], "source string, weight double")
    turns = [r.asDict() for r in mixing.edf_pattern(mixing.quanta_plan(weights)).orderBy("turn").collect()]
    q = turns[0]["q"]
    assert [t["turn"] for t in turns] == list(range(q))
    share, done = {t["source"]: t["a"] / q for t in turns}, dict.fromkeys({t["source"] for t in turns}, 0)
    for k, t in enumerate(turns, 1):
        done[t["source"]] += 1
        assert all(abs(done[s] - share[s] * k) < 1 for s in done)
    assert mixing.edf_pattern(mixing.quanta_plan(weights.limit(0))).count() == 0


def plain_edf(shares, q):
    """The sources of q slots by earliest deadline among released blocks, ties to the first source."""
    done, out = dict.fromkeys(shares, 0), []
    for t in range(q):
        ready = [(-(-(done[s] + 1) * q // a), s) for s, a in sorted(shares.items()) if done[s] < a and done[s] * q // a <= t]
        out.append(min(ready)[1])
        done[out[-1]] += 1
    return out


@pytest.mark.parametrize("weights", [[1, 1, 1, 1], [3, 3, 2, 2], [1], list(range(1, 24)), [1.5**i for i in range(40)]])
def test_schedule_equals_plain_edf(spark, weights):
    """Also with equal remainders and equal deadlines."""
    plan = mixing.quanta_plan(spark.createDataFrame([(f"s{i:02}", float(w)) for i, w in enumerate(weights)], "source string, weight double"))
    shares = {r["source"]: r["a"] for r in plan.collect()}
    turns = mixing.edf_pattern(plan).orderBy("turn").collect()
    assert sum(shares.values()) == turns[0]["q"] and max(shares.values()) - min(shares.values()) <= (1 if len(set(weights)) == 1 else 10_000)
    assert [r["source"] for r in turns] == plain_edf(shares, turns[0]["q"])


def test_mixing_by_shuffled_joins_is_the_same(docs, monkeypatch):
    both = docs.unionByName(docs.where("doc_id = 9")).withColumn("doc_id", F.expr("CASE WHEN doc_id = 8 THEN NULL ELSE doc_id END"))
    rows = lambda: sorted(map(str, mixing.mix_sources(both, mixing.tempered_weights(both), block_bytes=50).collect()))
    first = rows()
    monkeypatch.setattr(mixing, "BROADCAST_SLOTS", 0)
    assert rows() == first and len(first) == len(ODD) + 2


def test_document_vectors(docs):
    got = {r["doc_id"]: (r["size"], r["tokens"]) for r in sharding.document_vectors(docs).collect()}
    assert got[2] == (1, 0) and got[3] == (1, 0) and got[4] == (5, 0) and got[1] == (36, 9) and got[7] == (150_001, 30_000)


def test_packing_equals_a_plain_loop():
    rng = np.random.default_rng(9)
    v = np.sort(rng.lognormal(size=(200, 3)), axis=0)[::-1]
    total, left, want = v.sum(0), [[1 / 5] * 3 for _ in range(5)], []
    for row in v:
        dots = [sum(a * b / t for a, b, t in zip(r, row, total)) for r in left]
        want.append(dots.index(max(dots)))
        left[want[-1]] = [a - b / t for a, b, t in zip(left[want[-1]], row, total)]
    assert sharding.pack(v, 5).tolist() == want


def test_sharding(docs, none):
    got = sharding.shard_documents(docs.withColumn("shard", F.lit(9)), shards=3).collect()
    assert len(got) == len(ODD)
    shard = {r["doc_id"]: r["shard"] for r in got}
    assert shard[1] == shard[5] and sharding.shard_documents(none).count() == 0


def test_packing_balances_all_dimensions():
    rng = np.random.default_rng(5)
    v = np.sort(rng.lognormal(size=(4000, 3)), axis=0)[::-1]
    load = np.stack([v[sharding.pack(v, 8) == s].sum(0) for s in range(8)])
    assert (load.max(0) / load.min(0)).max() < 1.02


def test_scoring_odd_texts(docs, none, spark):
    tree = lm.train(docs)
    clash = docs.withColumns({"row": F.lit(1), "bucket": F.lit("x"), "n": F.lit(2)})
    got = lm.score(clash, tree).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["n_tokens"] == by[3]["n_tokens"] == by[4]["n_tokens"] == 1 and by[7]["n_tokens"] == 30_001
    assert len({(r["n_known"], r["base_score"], r["score"]) for r in got if r["doc_id"] == 9}) == 1
    assert lm.score(none, tree).count() == 0
    untrained = lm.score(docs, lm.train(none)).collect()
    assert {r["score"] for r in untrained} == {0.0}


def plain_model(texts, context, least=4, smoothing=2.0):
    """The log10 probability of a list of words, by dictionaries of all contexts."""
    docs = [[*t.split(), ""] for t in texts]
    n = Counter(w for d in docs for w in d)
    tokens = sum(n.values())
    root = lambda w: (n[w] + 1) / (tokens + len(n) + 1)
    seen = [Counter(tuple(d[i : i + k]) for d in docs for i in range(len(d) - k + 1)) for k in range(context + 2)]
    lifts, rests = {}, {}
    for k in range(1, context + 1):
        after = {}
        for s, c in seen[k + 1].items():
            if c >= least:
                after.setdefault(s[:-1], {})[s[-1]] = c
        for ctx, words in after.items():
            total, base = seen[k][ctx], {w: lifts[(*ctx[1:], w)] if k > 1 else 0.0 for w in words}
            parent = {w: root(w) * 10 ** base[w] for w in words}
            left, left_parent = total - sum(words.values()), max(1 - sum(parent.values()), 1e-12)
            ratio = sum(c * math.log(c / total / parent[w]) for w, c in words.items()) + (left * math.log(left / total / left_parent) if left > 0 else 0)
            p = {w: (c + smoothing * parent[w]) / (total + smoothing) for w, c in words.items()}
            if state := ratio > 0.5 * math.log(tokens) * (len(words) + 1):
                rests[ctx] = math.log10(max(1 - sum(p.values()), 1e-12) / left_parent)
            lifts |= {(*ctx, w): math.log10(p[w] / root(w)) if state else base[w] for w in words}

    def given(words, w):
        gain = 0.0
        for k in range(1, min(context, len(words)) + 1):
            ctx = tuple(words[len(words) - k :])
            if ctx in rests:
                gain = lifts[(*ctx, w)] if (*ctx, w) in lifts else gain + rests[ctx]
        return math.log10(root(w)) + gain

    for ctx in rests:  # every state predicts a distribution over the words and the unknown one
        assert sum(10 ** given(list(ctx), w) for w in [*n, "not a word"]) == pytest.approx(1)
    return lambda words: sum(given(words[:i], w) for i, w in enumerate([*words, ""])), rests


@pytest.mark.parametrize(("context", "lookup_rows"), [(2, 10**6), (3, 20), (4, 0)])
def test_scores_equal_a_plain_model(spark, context, lookup_rows, monkeypatch):
    """Also with deeper contexts, in several buckets, and whatever is looked up in the tasks or by joins."""
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 500)
    monkeypatch.setattr(lm, "LOOKUP_TOKENS", 900)
    monkeypatch.setattr(lm, "KEY_STEP", 2000)
    rng = np.random.default_rng(12)
    phrases = ["red fox runs home", "red fox runs far away today", "blue fox sits still", "the old dog sleeps", "old dog barks at the red fox", "one two three four left", "six two three four right"]
    texts = [" ".join([*rng.choice(phrases, 5), *(f"w{k}" for k in rng.integers(0, 40, 6)), *rng.choice(phrases, 3)]) for _ in range(120)]
    score, states = plain_model(texts, context)
    assert any(len(s) == context for s in states) and 20 < len(states)
    tree = lm.train(spark.createDataFrame([(t,) for t in texts], "text string"), context=context, lookup_rows=lookup_rows)
    asked = [*texts[:20], "red fox sits still", "unseen words only", "", "today red fox runs far away w1 w2 the old dog barks"]
    rows = lm.score(spark.createDataFrame([*enumerate(asked), (0, asked[0]), (0, asked[1])], "doc_id long, text string"), tree).collect()
    assert tree.buckets(0) > 3 and sorted(r["score"] for r in rows if r["doc_id"] == 0) == pytest.approx(sorted(score(asked[k].split()) for k in (0, 0, 1)))
    got = {r["doc_id"]: r["score"] for r in rows if r["doc_id"]} | {0: score(asked[0].split())}
    assert [got[i] for i in range(len(asked))] == pytest.approx([score(t.split()) for t in asked], abs=1e-9)


def test_contexts_need_a_count_and_no_share(spark):
    """A phrase that is seen 40 times is a state in a corpus of any size, and tables and lookups score alike."""
    rng = np.random.default_rng(6)
    other = [" ".join(f"w{k}" for k in rng.integers(0, 3000, 400)) for _ in range(6000)]
    texts = spark.createDataFrame([(t,) for t in other + ["quick zebra jumps gladly " * 4] * 10], "text string")
    ask = spark.createDataFrame([(1, "quick zebra jumps"), (2, "w1 quick w2")], "doc_id long, text string")
    scores = []
    for rows in (10**6, 0):
        tree = lm.train(texts, lookup_rows=rows)
        assert 40 < 2e-5 * tree.tokens
        scores.append({r["doc_id"]: (r["base_score"], r["score"]) for r in lm.score(ask, tree).collect()})
    assert scores[0][1][1] > scores[0][1][0] + 6 and scores[0][2][1] < scores[0][2][0] + 1
    for i in (1, 2):
        assert scores[0][i] == pytest.approx(scores[1][i])


def test_op10_a_small_tree_scores_many_documents_in_many_tasks(spark):
    """How many groups documents are dealt into follows from what is scored, not only from what was learned."""
    tree = lm.train(spark.createDataFrame([("a b a b a c",)] * 5, "text string"))
    before, coalesce = lm.LOOKUP_TOKENS, "spark.sql.adaptive.coalescePartitions.enabled"
    try:
        spark.conf.set(coalesce, "false")  # else Spark joins groups as small as these
        lm.LOOKUP_TOKENS = 1 << 14
        docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b new"), F.col("id"), F.lit(" word")).alias("text"))
        assert tree.buckets(0) == 1 and tree.buckets(20_000 * 4) > 4
        scores = lm.score(docs, tree)
        rows = scores.withColumn("at", F.spark_partition_id()).collect()
        assert len(rows) == 20_000 and len({r["at"] for r in rows}) > 1 and len({round(r["score"], 9) for r in rows}) == 1
    finally:
        lm.LOOKUP_TOKENS = before
        spark.conf.unset(coalesce)


def test_op10_slices_score_alike_and_leave_no_tables_of_strings(spark, tmp_path, monkeypatch):
    """Documents scored in slices, and what training leaves in the shared folder: the words and what states add, nothing else."""
    texts = spark.createDataFrame([("the old dog barks at the red fox today " * 3,)] * 30, "text string")
    asked = [(k, f"the old dog w{k % 50} barks at the red fox") for k in range(300)] + [(0, "the old dog"), (None, None), (None, None), (7, "the old dog w7 barks at the red fox")]
    docs = spark.createDataFrame(asked, "doc_id long, text string")
    monkeypatch.setattr(lm, "LOOKUP_TOKENS", 500)
    monkeypatch.setattr("stayframe.llm.common.shared_dir", lambda _: str(tmp_path))
    tree = lm.train(texts, lookup_rows=3)
    assert {p.name.split("-")[0] for p in (tmp_path / "stayframe").glob("*/*.parquet") for p in [p.parent]} == {"words", "values"}
    rows = lambda: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in lm.score(docs, tree).collect()), key=str)
    whole = rows()
    monkeypatch.setattr(lm, "SLICE_BYTES", 0)
    assert len(whole) == len(asked) and rows() == whole


def test_keys_are_found_from_their_leading_bits():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 8, 5000):
        keys = np.unique(np.concatenate([rng.integers(0, 1 << 64, n, np.uint64), np.arange(n // 50, dtype=np.uint64)]))
        asked = np.concatenate([keys, rng.integers(0, 1 << 64, 500, np.uint64), np.array([0, (1 << 64) - 1], np.uint64)])
        (found, at), (want, place) = lm._place_by_start(keys, lm._starts(keys), asked), lm._place(keys, asked)
        assert (found == want).all() and (at[found] == place[want]).all()
