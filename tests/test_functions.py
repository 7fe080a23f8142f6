"""The functions by their SQL names against the column functions."""


def test_registered_functions(spark):
    from pyspark.sql import functions as F

    from tessera import functions

    names = functions.register(spark)
    assert len(names) == len(set(names)) >= 6
    df = spark.createDataFrame([("a.b.C$D", [1.0, 2.0], [2.0, 1.0], "ﬁx"), ("Top", [1.0, 0.0], [3.0, 0.0], "x²")], "name string, a array<double>, b array<double>, t string")
    df.createOrReplaceTempView("named")
    got = spark.sql("SELECT simple_name(name) AS s, package_of(name) AS p, cosine(a, b) AS c, nfkc(t) AS n FROM named ORDER BY name").collect()
    want = df.select(functions.simple_name(F.col("name")).alias("s"), functions.package_of(F.col("name")).alias("p"), functions.cosine(F.col("a"), F.col("b")).alias("c"), functions.nfkc("t").alias("n"), "name").orderBy("name").collect()
    assert [(r.s, r.p, r.n) for r in got] == [(r.s, r.p, r.n) for r in want]
    assert all(abs(x.c - y.c) < 1e-12 for x, y in zip(got, want, strict=True))
    assert [r.n for r in got] == ["x2", "fix"] or [r.n for r in got] == ["fix", "x2"]
