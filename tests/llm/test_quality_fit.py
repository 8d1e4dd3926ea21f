"""The quality model is learned in a task."""

from narrata.llm import quality


def test_the_driver_does_not_train(spark, monkeypatch):
    """The model is that of ``train`` over the labelled texts in the order of their keys; the driver calls it only without any."""
    rows = [(k, " ".join(["good", "plain", "text"] if k % 2 else ["BAD", "###", "spam"]) + f" {k % 7}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, quality int")
    expected = quality.train([t for _, t in rows], [k % 2 for k, _ in rows])
    calls, train = [], quality.train
    monkeypatch.setattr(quality, "train", lambda *a: calls.append(1) or train(*a))
    found = quality.fit(docs, labels)
    assert not calls and found.bias == expected.bias and (found.weights == expected.weights).all()
