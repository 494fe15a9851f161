"""Codes of many texts: numbered in one range exchange, joined without sorting the rows, found without a scan."""

from pyspark.sql import functions as F

from gristmill.modelling import categories, prepare, train


def test_codes_follow_the_order_of_texts_over_many_tasks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        df = spark.range(5000).select(F.concat(F.lit("t"), F.col("id") * 7919 % 5003).alias("a"), (F.col("id") % 11).cast("string").alias("b"))
        codes, sizes = categories.code_table(df, [F.col("a"), F.col("b")])
        rows = codes.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sizes == [5000, 11]
    for feature in (0, 1):
        own = sorted((r.code, r.text) for r in rows if r.feature == feature)
        assert own == list(enumerate(sorted(t for _, t in own)))
    assert [r.hot for r in rows if r.feature == 1] == [True] * 11


def test_no_values_have_an_empty_table(spark):
    codes, sizes = categories.code_table(spark.createDataFrame([], "a string, b string"), [F.col("a"), F.col("b")])
    assert sizes == [0, 0] and codes.count() == 0


def test_rows_are_not_sorted_for_codes_of_known_number(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(4000).select("id", F.concat(F.lit("t"), "id").alias("a"))
        learned = categories.learn_one_hot_vectors(df, "a")
        plan = learned.apply(df)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_many_texts_are_proven_by_some_rows(spark, monkeypatch):
    df = spark.range(100_000).selectExpr("CAST(id AS STRING) AS t")
    with monkeypatch.context() as without:
        without.setattr(F, "approx_count_distinct", None)
        assert prepare._categories(df, ["t"], 10) == {}
    few = spark.range(1000).selectExpr("CAST(id AS STRING) AS many", "CAST(id % 10 AS STRING) AS few")
    assert prepare._categories(few, ["many", "few"], 10) == {"few": [str(i) for i in range(10)]}


def lines_of_texts(spark):
    return spark.range(3000).selectExpr("id", "concat('a', id % 700) AS a", "if(id % 4 = 0, NULL, concat('b', id % 900)) AS b", "double(id % 13) AS y", "md5(string(id)) AS extra")


def test_columns_that_only_spread_rows_are_not_exchanged(spark):
    df = lines_of_texts(spark)
    coded = prepare.learn_preparation(df, ["a", "b"], listed_categories=10).transform(df).select("id", "a__num", "b__num")
    plan = coded._jdf.queryExecution().optimizedPlan().toString()
    sought = [line for line in plan.splitlines() if "AS __sought" in line]
    assert len(sought) == 2 and not any("AS extra" in line or "extra#" in line for line in sought)


def test_codes_do_not_depend_on_what_spreads_the_rows(spark):
    rows = [(i, "t" if i % 3 else f"{i % 700:04X}") for i in range(6000)]
    df = spark.createDataFrame(rows, "id int, t string")
    learned = prepare.learn_preparation(df, ["t"], listed_categories=10)
    place = {t: float(i) for i, t in enumerate(sorted({t for _, t in rows}))}
    assert {r.id: r.t__num for r in learned.transform(df).collect()} == {i: place[t] for i, t in rows}


def test_leaky_codes_are_found_in_the_kept_rows(spark):
    df = lines_of_texts(spark).withColumn("leak", F.format_string("%05d", F.col("id"))).withColumn("y", F.col("id") * 2.0)
    data = train.training_set(df, "y", ["leak", "b"], "regression", "extra", fit_scope="all", listed_categories=10)
    assert [f for f, _ in data.leaky] == ["leak"]
    data.release()


def test_a_model_over_codes_is_learned_from_rows_joined_once_and_keeps_none(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def look(v):
        seen.add(1)
        return v

    df = lines_of_texts(spark)
    df = df.withColumn("x", F.udf(look, "double")(F.col("y") * 3))
    data = train.training_set(df, "y", ["a", "b", "x"], "regression", "extra", listed_categories=10)
    result = train.only_model(train.fit(data, "linear_regression"))
    assert result.scored is None and not result.estimator_model.hasSummary
    monkeypatch.setattr(train, "learn_preparation", lambda *_: data.preparation)
    before = seen.value
    model = train.refit_on_all(result)
    # Once for the test of a finite number, once for the number, if Spark does not share the two.
    assert seen.value - before <= 2 * 3000
    assert not model.stages[-1].hasSummary
