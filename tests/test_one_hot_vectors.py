from pyspark.sql import functions as F

from gristmill.modelling.categories import learn_one_hot_vectors


def vectors(df, name):
    return {r["id"]: r[name] for r in df.select("id", F.col(f"`{name}`")).collect()}


def test_any_number_of_values(spark):
    i = F.col("id")
    value = F.when(i % 10 == 0, F.lit(None)).when(i % 3 == 0, F.lit("hot")).otherwise(F.format_string("v%05d", i))
    df = spark.range(6000).select("id", value.alias("a.b"), F.lit(1).alias("__text2"))
    learned = learn_one_hot_vectors(df, "a.b")
    names = sorted({r[0] for r in df.select(F.col("`a.b`")).distinct().collect()} - {None})
    assert learned.size == len(names) > 3000
    encoded = learned.apply(df)
    assert encoded.columns == df.columns
    place = {n: k for k, n in enumerate(names)}
    given = {r["id"]: r["a.b"] for r in df.collect()}
    got = vectors(encoded, "a.b")
    assert len(got) == 6000
    for key, v in got.items():
        if given[key] is None:
            assert v is None
        else:
            assert (v.size, v.indices.tolist(), v.values.tolist()) == (len(names), [place[given[key]]], [1.0])


def test_unknown_missing_and_empty(spark):
    df = spark.createDataFrame([(1, 2.5), (2, None), (3, 7.0), (3, 7.0)], "id long, x double")
    learned = learn_one_hot_vectors(df.where("id < 3"), "x")
    rows = sorted((r["id"], None if r["x"] is None else r["x"].toArray().tolist()) for r in learned.apply(df).collect() if r["id"] != 2)
    assert rows == [(1, [1.0]), (3, [0.0]), (3, [0.0])]
    assert vectors(learned.apply(df), "x")[2] is None
    nothing = learn_one_hot_vectors(df.limit(0), "x")
    assert nothing.size == 0 and set(vectors(nothing.apply(df), "x").values()) == {None}
