import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fixatlas.llm import boosted, quality
from fixatlas.llm.quality import NAMES, keep_good, quality_scores, statistics, with_statistics
from fixatlas.llm.queries import QUERIES
from fixatlas.llm.ragged import utf8


def area(score, label):
    order = np.argsort(np.argsort(score, kind="stable"))
    pos = label == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


def test_statistics_against_plain_counting():
    texts = ["", None, "A b, b b\n\nA 1!", "x", " \n ", "é é", "a b\na b\nc", "!!! ### ok"]
    x = statistics(*utf8(pa.array(texts)))
    assert x.shape == (len(texts), len(NAMES)) and np.isfinite(x).all()
    for text, row in zip(texts, x):
        row, text = dict(zip(NAMES, row.tolist())), text or ""
        words, lines, n = text.split(), [line for line in text.split("\n") if line], max(len(text.encode()), 1)
        pairs = list(zip(words, words[1:]))
        close = lambda a, b: abs(a - b) < 1e-5
        assert close(row["capitals"], sum(c.isupper() and c.isascii() for c in text) / n)
        assert close(row["distinct_words"], len(set(words)) / max(len(words), 1))
        assert close(row["top_word"], max([words.count(w) for w in words], default=0) / max(len(words), 1))
        assert close(row["same_as_last"], sum(a == b for a, b in pairs) / max(len(words), 1))
        assert close(row["distinct_pairs"], len(set(pairs)) / max(len(pairs), 1))
        assert close(row["distinct_lines"], len(set(lines)) / max(len(lines), 1))


def test_a_text_has_the_same_statistics_in_any_company():
    texts = ["some words, some more", "", "B" * 50_000, "x y z\n" * 3000]
    together = statistics(*utf8(pa.array(texts)))
    for text, row in zip(texts, together):
        assert (statistics(*utf8(pa.array([text])))[0] == row).all()


def test_trees_learn_an_interaction_and_walk_as_trained():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = boosted.fit(x[:3000], y[:3000])
    assert area(trees.score(x[3000:]), y[3000:]) > 0.97

    def walk(row):
        total = trees.base
        for feature, threshold, value in zip(trees.features, trees.thresholds, trees.values):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(x[:50]), [walk(r) for r in x[:50]])
    assert np.allclose(boosted.fit(x[:10], np.ones(10)).score(x), 10.5 / 11)
    assert np.allclose(boosted.fit(x[:0], np.ones(0)).score(x), 0.5)


def test_nulls_repeats_clashes_and_empty_tables(spark):
    rows = [(1, "a", 5.0, "s"), (1, "a", 5.0, "s"), (None, None, 6.0, None), (2, "", 7.0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, stats string")
    labels = spark.createDataFrame([(1, None), (2, 7), (None, 1)], "doc_id long, quality int")
    found = quality_scores(docs, labels).collect()
    assert len(found) == 4 and {r.score for r in found} == {0.5}
    assert sorted(map(tuple, keep_good(docs, labels, 0.5).collect()), key=str) == sorted(rows, key=str)
    assert keep_good(docs, labels, 0.6).count() == 0
    assert quality_scores(docs.where("false"), labels).count() == 0
    assert with_statistics(docs).columns == ["doc_id", "text", "score", "stats"]


def test_query_on_held_out_documents(spark):
    where = "/root/testdata/sf0.1"
    found = QUERIES["op5_quality"](spark, where).toPandas()
    assert len(found) == spark.read.parquet(f"{where}/documents.parquet").count() and found.score.between(0, 1).all()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.doc_id]).all()
    assert (found.predicted == (found.score >= 0.7)).all()
    labels = spark.read.parquet(f"{where}/labels.parquet").toPandas().drop_duplicates("doc_id")
    both = found[found.held_out].merge(labels, on="doc_id")
    print(area(both.score.to_numpy(), both.quality.to_numpy()), (both.predicted == both.quality).mean(), both.groupby("quality").score.describe())
    assert area(both.score.to_numpy(), both.quality.to_numpy()) > 0.97
    assert (both.predicted == both.quality).mean() > 0.95


def test_very_short_texts_are_bounded_in_rows(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(quality, "TEXTS", 1000)
    batches = pa.Table.from_pydict({"text": ["x"] * 25_000}).to_batches(max_chunksize=7000)
    for table in quality.gathered(batches, "text", 2 << 20, quality.TEXTS):
        sizes.append(len(table))
    assert sum(sizes) == 25_000 and max(sizes) == 1000


def test_a_few_labels_more_than_the_sample_come_to_the_sort(spark):
    ids = spark.range(5000).selectExpr("id as doc_id")
    stats = ids.select("doc_id", F.array([F.col("doc_id").cast("float")] * len(quality.NAMES)).alias("stats"))
    labels = ids.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    seen = []
    fit = quality.boosted.fit
    try:
        quality.boosted.fit = lambda x, y: seen.append((len(x), sorted(x[:, 0].tolist())))
        quality.learn(stats, labels, 300)
        quality.learn(stats, labels, 300)
    finally:
        quality.boosted.fit = fit
    assert 250 <= seen[0][0] <= 300 and seen[0] == seen[1]
