"""The trained operators by held-out accuracy, gradients by finite differences, and odd rows."""

import random
import zlib

import numpy as np
import pytest

from weftline.llm import langid, quality, toxicity

TABLES = "/root/testdata/sf0.01"


def docs_of(rng, n):
    good = ["river", "house", "letter", "window", "garden", "music", "paper", "winter"]
    bad = ["scum", "idiotic", "idiots", "vermin"]
    rows, labels = [], []
    for i in range(n):
        toxic, poor = rng.random() < 0.3, rng.random() < 0.4
        words = [rng.choice(good) for _ in range(rng.randrange(8, 40))]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad)
        if poor:
            words = [w + "$$$" if rng.random() < 0.7 else w for w in words]
        rows.append((i, " ".join(words), rng.choice(["en", "de", None]), "s", 1.0))
        labels.append((i, 2 - poor - (poor and rng.random() < 0.5), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = docs_of(random.Random(1), 900)
    odd = [(10_000, None, None, None, 0.0), (10_001, "", "en", "s", 0.0), (None, "river scum", "en", "s", 0.0), (5, rows[5][1], "en", "s", 0.0), (10_002, "scum " * 30_000, "en", "s", 0.0)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, score double")
    return docs, spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (4, labels[4][1], labels[4][2])], "doc_id long, quality int, toxic int"), rows, labels


def test_toxicity(spark, tables):
    docs, labels, rows, truth = tables
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) + 5
    by_id = {r.doc_id: r for r in got}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {r.doc_id for r in got if r.held_out} >= set(held) and not by_id[None].held_out
    assert np.mean([by_id[i].predicted == truth[i][2] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert by_id[10_000].score == by_id[10_001].score and by_id[10_002].predicted == 1
    none = toxicity.toxicity(docs.limit(3), labels.limit(0)).collect()
    assert len(none) == 3 and all(r.lang_threshold == 0.5 for r in none)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_pooling_in_folds():
    rng = np.random.default_rng(0)
    table = rng.normal(size=(500, sum(toxicity.WIDTHS) * toxicity.FILTERS)).astype(np.float32)
    ids = rng.integers(0, 500, 3 * toxicity._FOLD + 5)
    biases = [np.zeros(toxicity.FILTERS, np.float32)] * 3
    whole = table[ids]
    values, _ = toxicity.pooled(len(ids), lambda a, b: whole[a:b], biases)
    column, want = 0, []
    for w in toxicity.WIDTHS:
        want += [max(sum(whole[i + k, column + k * toxicity.FILTERS + j] for k in range(w)) for i in range(len(ids) - w + 1)) for j in range(2)]
        column += w * toxicity.FILTERS
    assert np.allclose(values.reshape(3, -1)[:, :2].ravel(), want, atol=1e-5)


def test_quality(spark, tables):
    docs, labels, rows, truth = tables
    model = quality.fit(docs, labels)
    assert model.grades == [0, 1, 2] and (np.diff(model.thresholds) >= 0).all()
    got = quality.quality(docs, model).collect()
    assert len(got) == len(rows) + 5
    by_id = {r.doc_id: r for r in got}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(by_id[i].tail_probability >= 0.5) == (truth[i][1] == 2) for i in held]) > 0.97
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in got)
    kept = quality.select_quality(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.tail_probability >= 0.5 for r in got)
    assert quality.scored(docs.limit(0), labels).count() == 0
    assert quality.scored(docs, labels.limit(0)).count() == docs.count()


def test_language(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, "en"), (-2, "", "en"), (-3, "123 .. 45", "en"), (None, "the house", "en")], "doc_id long, text string, lang string")
    got = langid.language(docs.select("doc_id", "text", "lang").unionByName(odd)).collect()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(got) == len(truth) + 4
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in (-1, -2, -3)} == dict.fromkeys((-1, -2, -3), ("und", 0.0))
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    assert langid.language(docs.limit(0)).count() == 0


def test_gradients():
    rng = np.random.default_rng(0)
    n = 3
    gru = langid.Gru(rng.normal(0, 0.5, (256, 3 * n)), rng.normal(0, 0.5, (n, 3 * n)))
    x = rng.integers(0, 4, (7, 5))
    weights = rng.normal(size=(7, 5, n))

    def loss():
        return float(sum((s * w).sum() for s, w in zip(gru.states(x)[0], weights, strict=True)))

    _, kept = gru.states(x, keep=True)
    g_table, g_u = gru.backward(x, kept, list(weights))
    for own, g in ((gru.table, g_table), (gru.u, g_u)):
        for at in [(0, 1), (1, 4), (2, 8)]:
            own[at] += 1e-4
            up = loss()
            own[at] -= 2e-4
            down = loss()
            own[at] += 1e-4
            assert g[at] == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=2e-3)


def test_pooling_of_segments():
    rng = np.random.default_rng(1)
    gru = lambda: langid.Gru(rng.normal(0, 0.5, (256, 24)).astype(np.float32), rng.normal(0, 0.5, (8, 24)).astype(np.float32))
    model = langid.Model(["a", "b"], gru(), gru(), rng.normal(size=(16, 2)).astype(np.float32), np.zeros(2, np.float32))
    texts = [b"", b"x", bytes(range(32, 120)) * 7, b"hello " * 40]
    got = model.pool(texts)
    assert got[0].tolist() == [0.5, 0.5]
    for t, p in zip(texts[1:], got[1:], strict=True):
        parts = [np.pad(np.frombuffer(t[i : i + 128], np.uint8), (0, 128 - len(t[i : i + 128]))) for i in range(0, len(t), 128)]
        each = [model.label(s[None, :])[: len(t[i * 128 : (i + 1) * 128]), 0] for i, s in enumerate(parts)]
        assert np.allclose(np.concatenate(each).mean(axis=0), p, atol=1e-4)


def test_shape_of_whole_words():
    both = quality.Features()
    head = b"a" * 64
    shape = lambda word: both[word] & 0xFFFFF
    assert shape(head + b"9A=") == shape(b"a9A=") != shape(head)
    assert shape(b"x1" * 40 + b"!") == shape(b"y2" * 40 + b"!") != shape(b"x1" * 40)


def test_cnn_gradients():
    """Against finite differences of the weighted log loss; double precision, no ties of maxima."""
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 50, (n, 1 + len(toxicity.PREFIXES))) for n in (1, 2, 6, 9)]
    y, weights = np.array([1, 0, 1, 0]), np.array([2.0, 1.0, 2.0, 1.0])
    net = toxicity.Cnn(rng.normal(0, 0.5, (50, toxicity.DIM)), [rng.normal(0, 0.5, (w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS], [rng.normal(0, 0.1, toxicity.FILTERS) for _ in toxicity.WIDTHS], rng.normal(0, 0.5, toxicity.FILTERS * len(toxicity.WIDTHS)), 0.2)

    def loss():
        table, biases = net.folded()
        total = 0.0
        for t, label, weight in zip(texts, y, weights, strict=True):
            h, _ = toxicity.pooled(len(t), lambda a, b, t=t: table[t[a:b]].sum(axis=1), biases)
            z = float(h @ net.out + net.out_bias)
            total += weight * (np.log1p(np.exp(z)) - label * z)
        return total

    def slope(array, place):
        array[place] += 1e-6
        up = loss()
        array[place] -= 2e-6
        down = loss()
        array[place] += 1e-6
        return (up - down) / 2e-6

    (words, g_e), rest, g_ob = toxicity.gradients(net, texts, y, weights, net.folded())
    g_all = np.zeros_like(net.embedding)
    g_all[words] = g_e
    for array, g in [(net.embedding, g_all), *zip([*net.filters, *net.biases, net.out], rest, strict=True)]:
        for place in zip(*(rng.integers(0, n, 12) for n in array.shape), strict=True):
            assert g[place] == pytest.approx(slope(array, place), abs=1e-5)
    net.out_bias += 1e-6
    up = loss()
    net.out_bias -= 2e-6
    assert g_ob == pytest.approx((up - loss()) / 2e-6, abs=1e-5)


def test_ordinal_gradients():
    rng = np.random.default_rng(1)
    model = quality.Ordinal(rng.normal(size=20), np.array([-1.0, 0.3, 0.9]), [0, 1, 2, 3])
    at, value = np.array([2, 5, 9]), rng.random(3)
    for y in range(4):
        loss = lambda y=y: -np.log(model.probabilities(np.array([model.weights[at] @ value]))[0, y])
        g, g_t = quality.gradients(model, at, value, y)
        for array, place, want in [(model.weights, 2, g * value[0]), (model.weights, 9, g * value[2]), *((model.thresholds, j, g_t[j]) for j in range(3))]:
            array[place] += 1e-6
            up = loss()
            array[place] -= 2e-6
            down = loss()
            array[place] += 1e-6
            assert want == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_few_labels_are_enough(spark):
    """Held-out documents of the small tables: most toxic ones are found, few clean ones flagged."""
    docs, labels = (spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(truth[r.doc_id], r.predicted) for r in toxicity.toxicity(docs, labels).collect() if r.held_out and truth.get(r.doc_id) is not None]
    assert sum(p for t, p in held if t) >= 0.6 * sum(t for t, _ in held) and sum(p for t, p in held if not t) <= 0.03 * len(held)


def test_samples_have_no_length_cut(spark):
    """Labels that sit on long texts only still train; one doc_id with several texts gives the same sample each time."""
    from weftline.llm.common import labelled_sample, sample_rows

    rows = [(i, ("scum " if i % 2 else "river ") * 6_000, "en" if i % 2 else "de") for i in range(40)] + [(3, "another", "en"), (3, "again", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id != 3)
    sample = labelled_sample(docs, labels, "toxic", 100, 10**9)
    assert len(sample) == 40 and sample[3]["text"] == "again" and labelled_sample(docs.repartition(3), labels, "toxic", 100, 10**9) == sample
    assert len(labelled_sample(docs, labels, "toxic", 7, 10**9)) == 7 and sum(len(r["text"]) for r in labelled_sample(docs, labels, "toxic", 100, 100_000)) <= 100_000
    model = langid.fit(docs)
    assert model.langs == ["de", "en"]
    assert {r["lang"] for r in sample_rows(docs, "doc_id", 5, "lang", 1)} == {"en"}
    assert langid.fit(docs, train_langs=1).langs == ["en"]


def test_letters():
    assert not any(langid.has_letter(t) for t in ("", "½ ² Ⅳ ①", "12_34 .", "٣")) and all(langid.has_letter(t) for t in ("1a", "é", "日", "ª"))


def test_clashing_names(spark, tables):
    docs, labels, *_ = tables
    with pytest.raises(ValueError):
        quality.quality(docs.withColumnRenamed("score", "expected_grade"), quality.fit(docs, labels))
    extra = docs.limit(30).selectExpr("*", "1 AS lang_pred", "2 AS held_out", "3 AS predicted", "4 AS expected_grade", "5 AS tail_probability", "6 AS y", "7 AS _n", "8 AS _salt")
    found = langid.language(extra.where("doc_id < 10000"))
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"] and found.count() == extra.where("doc_id < 10000").count()
    assert quality.scored(extra, labels).count() == 30 and toxicity.toxicity(extra, labels).count() == 30
