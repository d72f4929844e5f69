from ringloom.operators import phrases
from ringloom.streaming.phrases import dictionary_counts


def test_counts_grow_to_the_dictionary(spark, tmp_path):
    texts = ["BANANABANDANA" * 3, "ABRACADABRA" * 4, "BANANABANDANA" * 3]
    seqs = spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string")
    for i in range(2):
        seqs.filter(f"seq_id % 2 = {i}").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(seqs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = dictionary_counts(stream, 4, 10).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    want = {r.phrase: r.occ for r in phrases.dictionary(phrases.phrases(seqs, 4, 10)).collect()}
    assert {r.phrase: r.occ for r in spark.table("counts").collect()} == want != {}
