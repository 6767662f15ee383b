import numpy as np

from aerolith.llm import learning, quality_classifier as Q


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = Q.quality_classifier(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    good = np.array([r["quality"] == 1 for r in got])
    kept = np.array([r["kept"] for r in got])
    assert kept[good].mean() > 0.98 and kept[~good].mean() < 0.1


def test_views_teach_each_other():
    """The metadata view has few labels of one kind; what the text view passes on shows it the other kind."""
    rng = np.random.default_rng(0)

    def rows(n, label):
        y = (rng.random(n) < 0.5).astype(float)
        t = rng.normal(0, 1, (n, len(Q.TEXT_VIEW)))
        m = rng.normal(0, 1, (n, len(Q.META_VIEW)))
        t[:, 0] += 6 * y
        m[:, 0] += 4 * y
        return Q.Rows((t, m), y if label else np.full(n, np.nan)), y

    labelled, held, pool = rows(20, True)[0], rows(300, True)[0], rows(2000, False)[0]
    test, y = rows(2000, True)
    alone, _ = Q.co_train(labelled, held, pool, rounds=0)
    taught, w = Q.co_train(labelled, held, pool)
    right = lambda v: ((v.odds(test.x[1]) > 0) == (y == 1)).mean()
    assert right(taught[1]) > right(alone[1])
    both = w[0] + w[1] * taught[0].odds(test.x[0]) + w[2] * taught[1].odds(test.x[1])
    assert ((both > 0) == (y == 1)).mean() > 0.98


def test_a_view_without_knowledge_passes_nothing_on():
    rng = np.random.default_rng(1)
    y = (rng.random(400) < 0.5).astype(float)
    view = Q.View.fit(rng.normal(size=(400, 3)), y, rng.normal(size=(400, 3)), (rng.random(400) < 0.5).astype(float))
    p = 1 / (1 + np.exp(-view.odds(rng.normal(size=(1000, 3)))))
    assert p.max() < Q.CONFIDENT and p.min() > 1 - Q.CONFIDENT


def test_odd_rows(spark, make_docs, odd_rows):
    labels = spark.createDataFrame([(1, 0, 1), (4, 1, 0), (5, None, None), (5, 1, 1), (9, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = Q.quality_classifier(make_docs(odd_rows), labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert Q.quality_classifier(make_docs([]), labels).count() == 0
    none = Q.quality_classifier(make_docs(odd_rows).drop("lang", "source", "n_chars"), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {1.0}


def test_bounded_takes_the_rows_of_smallest_hash(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "id as other")
    order = rows.selectExpr("doc_id", "other", "xxhash64(doc_id) as h").collect()
    for limit in (0, 1, 50, 999, 2999, 3000, 4000):
        got = [r["doc_id"] for r in learning.bounded(rows, limit).collect()]
        assert got == [r["doc_id"] for r in sorted(order, key=lambda r: (r["h"], r["doc_id"]))[:limit]]
    some = learning.bounded(rows.filter("doc_id != 7"), 20)
    assert some._jdf.queryExecution().toString().count("Filter") > 0
