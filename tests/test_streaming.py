from skylume.streaming.edges import running_degrees, windowed_edges


def test_degrees_of_an_edge_stream(spark, tmp_path):
    folder = str(tmp_path / "edges")
    for k, rows in enumerate([[(1, 2), (2, 3)], [(2, 4), (5, 5)]]):
        spark.createDataFrame(rows, "src long, dst long").write.parquet(f"{folder}/b={k}")
    stream = spark.readStream.schema("src long, dst long, b int").parquet(folder)
    query = running_degrees(stream).writeStream.format("memory").queryName("degrees").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {r.node: r.degree for r in spark.table("degrees").collect()} == {1: 1, 2: 3, 3: 1, 4: 1}


def test_windows_count_each_edge(spark):
    rows = [(1, 2, "2024-01-01 00:05:00"), (1, 2, "2024-01-01 00:50:00"), (1, 2, "2024-01-01 01:05:00")]
    df = spark.createDataFrame(rows, "src long, dst long, ts string").selectExpr("src", "dst", "to_timestamp(ts) AS ts")
    assert sorted(r.n for r in windowed_edges(df).collect()) == [1, 2]
