"""The examples have the class mix of the label table, whatever its size."""

from narrata.llm import toxicity


def test_mix_does_not_move_with_size(spark):
    ids = range(4000)
    docs = spark.createDataFrame([(i, f"plain words {i}" + " vile" * (i % 10 == 0)) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in ids], "doc_id long, toxic int")
    for sample in (600, 6000):
        index = toxicity.train(docs, labels, sample=sample)
        assert abs(index.prior - 0.1) < 0.04, (sample, index.prior)
