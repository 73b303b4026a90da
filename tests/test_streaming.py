from querylens.operators.evaluate import rollup, row_metrics
from querylens.streaming import read_rollup, score_stream, write_rollup, write_scores


def test_stream_gives_what_batch_gives(spark, tmp_path):
    rows = [(1, "MATCH (a) RETURN a", "match (a) return a;", 300), (2, "RETURN 1", None, None)]
    d = spark.createDataFrame(rows, "i long, cypher string, completion string, n_tokens int")
    d.write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second start finds nothing new
        write_scores(spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(str, got.select("i", "em", "bleu", "r_length").collect())) == sorted(map(str, score_stream(d).select("i", "em", "bleu", "r_length").collect()))


def test_rollup_after_a_restart_and_a_repeated_batch(spark, tmp_path):
    schema = "row_id long, data_source string, question string, schema string, cypher string, completion string, n_tokens int"
    gold = "MATCH (c:Customer) RETURN c.name"
    rows = [(k, ["a", "b", None][k % 3], "q", "Customer {name: STRING}", gold, [gold, "MATCH (c:Customer) RETURN c.id", "", None][k % 4], 9) for k in range(40)]
    make = lambda some: spark.createDataFrame(some, schema).coalesce(1)
    start = lambda: write_rollup(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    make(rows[:10]).write.mode("append").parquet(f"{tmp_path}/in")
    start()
    # the last batch failed after its folder was written and before its end was noted: it runs again
    for note in (tmp_path / "state/commits").glob("*0*"):
        note.unlink()
    start()
    for k in (10, 25):
        make(rows[k : k + 15]).write.mode("append").parquet(f"{tmp_path}/in")
    start()
    start()
    got = {(r.is_total, r.data_source): (round(r.bleu, 9), r.em, r.exec, r.n) for r in read_rollup(spark, f"{tmp_path}/out").collect()}
    want = {(r.is_total, r.data_source): (round(r.bleu, 9), r.em, r.exec, r.n) for r in rollup(row_metrics(make(rows))).collect()}
    assert got == want and len(got) == 4
