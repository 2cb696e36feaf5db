import numpy as np

from lamina.llm import queries
from lamina.llm.ordinal import OrdinalModel, fit, likelihood, score


def labelled(spark, folder):
    grade = "case when toxic = 1 then 0 when quality = 0 then 1 else 2 end as grade"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet").selectExpr("doc_id", grade)


def test_unseen_documents(spark):
    docs, labels = labelled(spark, "/root/testdata/sf0.1")
    model = fit(docs, labels.where("doc_id % 4 <> 1"))
    rows = score(docs, model).join(labels.where("doc_id % 4 = 1"), "doc_id").collect()
    clean = np.mean([r.p_top >= 0.5 for r in rows if r.grade == 2])
    rest = np.mean([r.p_top >= 0.5 for r in rows if r.grade < 2])
    assert clean >= 0.99 and rest <= 0.3  # few toxic words recur in so few rows
    assert np.corrcoef([r.grade for r in rows], [r.expected_grade for r in rows])[0, 1] > 0.75


def test_query(spark, sf_dir):
    docs, labels = labelled(spark, sf_dir)
    got = {r.doc_id: r for r in queries.op4_quality(spark, sf_dir).collect()}
    assert len(got) == docs.count()
    assert all(0 <= r.p_top <= r.p_pass <= 1 and abs(r.expected_grade - r.p_top - r.p_pass) < 1e-9 for r in got.values())
    assert np.mean([got[r.doc_id].keep for r in labels.where("grade = 2").collect()]) >= 0.99


def test_small_table_rejects_toxic_rows(spark, sf_dir):
    docs, labels = labelled(spark, sf_dir)
    got = {r.doc_id: r.keep for r in queries.op4_quality(spark, sf_dir).collect()}
    toxic = [r.doc_id for r in labels.where("grade = 0").collect() if r.doc_id in got]
    assert toxic and not any(got[i] for i in toxic)


def test_tails_fall_with_the_cut():
    model = OrdinalModel(np.zeros(4), np.array([-1.0, 0.0, 2.0]))
    tails = model.tails(np.array([-3.0, 0.5, 9.0]))
    assert (np.diff(tails, axis=1) <= 0).all() and (np.diff(tails, axis=0) >= 0).all()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good words here", 5), (2, None, 5), (3, "", 5), (3, "", 5), (None, "bad thing", 5), (5, "bad thing " * 9000, 5)], "doc_id long, text string, grade int")
    grades = spark.createDataFrame([(1, 2), (5, 0), (5, 1), (None, 1), (2, None), (9, 1)], "doc_id long, grade int")
    out = score(docs, fit(docs, grades)).collect()
    assert len(out) == 6 and {r.doc_id for r in out} == {1, 2, 3, 5, None}
    by = {r.doc_id: r.expected_grade for r in out}
    assert by[1] > by[5]
    for empty in (grades.limit(0), grades.where("doc_id = 1")):
        model = fit(docs, empty)
        assert not model.weights.any() and score(docs, model).where("p_pass > 0.99").count() == 6
    assert score(docs.limit(0), fit(docs, grades)).count() == 0


def test_cumulative_link_likelihood():
    """Probabilities of the grades sum to one, and the slopes are those of small steps."""
    rng = np.random.default_rng(2)
    cuts, z = np.array([-1.3, 0.2, 1.1]), rng.normal(size=40) * 2
    total = sum(np.exp(likelihood(z, cuts, np.full(40, k))[0]) for k in range(4))
    assert np.allclose(total, 1)
    y, step = rng.integers(0, 4, 40), 1e-6
    _, by_score, by_cut = likelihood(z, cuts, y)
    assert np.allclose(by_score, (likelihood(z + step, cuts, y)[0] - likelihood(z - step, cuts, y)[0]) / 2 / step, atol=1e-6)
    for k in range(3):
        move = step * (np.arange(3) == k)
        assert np.allclose(by_cut[:, k], (likelihood(z, cuts + move, y)[0] - likelihood(z, cuts - move, y)[0]) / 2 / step, atol=1e-6)


def test_bounds_and_repeats(spark):
    docs = spark.createDataFrame([(i % 40, f"{'good fine' if i % 2 else 'bad awful'} w{i}") for i in range(40)] * 3, "doc_id long, text string")
    grades = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, grade int")
    model = fit(docs, grades)
    assert np.allclose(fit(docs.dropDuplicates(), grades).weights, model.weights)
    assert (np.diff(fit(docs, grades.selectExpr("doc_id", "grade * 3 as grade")).thresholds) > 0).all()
    got = {r.doc_id: r.p_top for r in score(docs, model).collect()}
    assert min(got[i] for i in got if i % 2) > max(got[i] for i in got if not i % 2)
    few = fit(docs, grades, most_features=20)
    assert 0 < np.count_nonzero(few.weights) <= 20
