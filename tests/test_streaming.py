from gristmill.operators.recipe import Recipe
from gristmill.plans.tables import EVENT_RULES
from gristmill.streaming.apply import replay_stream, score_stream, write_stream
from gristmill.modelling import train as T

import pytest


def test_learned_steps_run_on_a_stream(spark, folder, tmp_path):
    path = f"{folder}/events.parquet"
    rules = [f"{EVENT_RULES[c]} AS {c}" for c in ("event_id", "value_n", "type_n", "user_id")]
    batch = spark.read.parquet(path).selectExpr(*rules)
    recipe = (
        Recipe(batch)
        .apply("fill_mean", "value_n")
        .apply("fill_mode", "type_n")
        .apply("transform", "value_n", transform="standardize", name="z")
        .apply("one_hot", "type_n")
    )
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(folder + "/events*").selectExpr(*rules)
    query = write_stream(replay_stream(recipe.steps, stream), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == batch.count() and out.exceptAll(recipe.df).count() == 0
    with pytest.raises(ValueError):
        replay_stream(Recipe(batch).apply("sort", "event_id").steps, stream)


def test_fitted_model_scores_a_stream(spark, folder, tmp_path):
    path = f"{folder}/events.parquet"
    result = T.train(spark.read.parquet(path), "value", ["user_id", "event_type"], "regression", "event_id", "linear_regression")
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(folder + "/events*")
    scored = score_stream(result.model, stream).select("event_id", "prediction")
    query = write_stream(scored, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("prediction IS NOT NULL").count() == spark.read.parquet(path).count()
