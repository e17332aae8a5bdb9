from ratioscope.llm import quality
from ratioscope.llm.quality import apply_quality, fit_quality


def test_bound_holds_with_repeated_ids(spark, monkeypatch):
    docs = [(i % 2, f"text number {i} " + ("fine words here " if i % 2 else "junk !!! %%% ") * 8) for i in range(400)] + [(i, ("fine words here " if i % 2 else "junk !!! %%% ") * 8) for i in range(2, 12)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    model = fit_quality(df, labels, max_rows=10)
    other = fit_quality(df.repartition(7), labels, max_rows=10)
    assert model.weights is not None and (model.weights == other.weights).all()
    assert fit_quality(df.limit(0), labels).weights is None and fit_quality(df, labels.limit(0)).weights is None
    out = {r.doc_id: r.probability for r in apply_quality(df.where("doc_id > 1"), model).collect()}
    assert min(out[i] for i in (3, 5, 7)) > max(out[i] for i in (2, 4, 6))
    assert quality.QualityModel(None).weights is None
