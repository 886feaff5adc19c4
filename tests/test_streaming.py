"""The row-wise operators run unchanged on a streaming DataFrame."""

from tabweave.operators.clean import clean_dropna, clean_sentinel, label_recode
from tabweave.operators.encode import te_fit
from tabweave.session import scratch_path


def test_clean_and_encode_a_stream(spark):
    rows = spark.createDataFrame([("a", ">50K"), ("b", "<=50K"), ("?", ">50K"), ("a", "<=50K")], "c string, y string")
    path = scratch_path(spark, "stream")
    rows.write.parquet(path)
    recode = lambda df: clean_dropna(clean_sentinel(label_recode(df, "y", {"<=50K": 0, ">50K": 1})))
    coder = te_fit(recode(rows), "y")
    stream = coder.apply(recode(spark.readStream.schema(rows.schema).parquet(path)))
    query = stream.writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("cleaned").collect())) == [(0, 0.0), (0, 0.5), (1, 0.5)]
