"""A replayable list of shaping steps.

Steps that depend on the data keep the constants they learned (means, bin edges, category
lists), so replaying a recipe gives the same columns on new data, on a stream, or after an
earlier step was undone.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from . import cleaning, features, shape


@dataclass(frozen=True)
class Step:
    action: str
    column: str
    detail: str
    params: Mapping[str, Any]
    learned: Mapping[str, Any] = field(default_factory=dict)


def _value(learn: Callable) -> Callable:
    return lambda df, p: {"value": learn(df, p["column"])}


def _spread(df: DataFrame, p: Mapping) -> dict:
    if p.get("transform") in ("standardize", "normalize") or "bins" in p:
        return features.learn_spread(df, p["column"]).as_dict()
    return {}


def _spread_of(learned: Mapping) -> features.Spread | None:
    return features.Spread(**learned) if learned else None


def _nothing(df: DataFrame, p: Mapping) -> dict:
    return {}


# Per action: what it learns from the data, and how it is applied with that.
ACTIONS: dict[str, tuple[Callable[[DataFrame, Mapping], dict], Callable[[DataFrame, Mapping, Mapping], DataFrame]]] = {
    "drop_column": (_nothing, lambda df, p, k: shape.drop_column(df, p["column"])),
    "rename_column": (_nothing, lambda df, p, k: shape.rename_column(df, p["column"], p["new"])),
    "cast": (_nothing, lambda df, p, k: shape.cast_columns(df, {p["column"]: p["target"]})),
    "cast_batch": (_nothing, lambda df, p, k: shape.cast_columns(df, dict(p["targets"]))),
    "filter_rows": (_nothing, lambda df, p, k: shape.filter_rows(df, p["column"], p["query"])),
    "drop_null_rows": (_nothing, lambda df, p, k: shape.drop_null_rows(df, p["column"])),
    "sort": (_nothing, lambda df, p, k: shape.sort_rows(df, p["column"], p.get("descending", False), p.get("tie_break", ()))),
    "fill_mean": (_value(cleaning.learn_mean), lambda df, p, k: cleaning.fill_value(df, p["column"], k["value"])),
    "fill_median": (_value(cleaning.learn_median), lambda df, p, k: cleaning.fill_value(df, p["column"], k["value"])),
    "fill_mode": (_value(cleaning.learn_mode), lambda df, p, k: cleaning.fill_value(df, p["column"], k["value"])),
    "fill_zero": (_nothing, lambda df, p, k: cleaning.fill_zero(df, p["column"])),
    "fill_forward": (
        _nothing,
        lambda df, p, k: cleaning.fill_forward(df, p["column"], p["order_by"], p.get("partition_by", ())),
    ),
    "one_hot": (
        lambda df, p: {"values": cleaning.learn_categories(df, p["column"])},
        lambda df, p, k: cleaning.one_hot_with(df, p["column"], k["values"]),
    ),
    "coerce_numeric": (
        lambda df, p: {"columns": cleaning.learn_numeric_text(df, p.get("columns") or [p["column"]])},
        lambda df, p, k: cleaning.text_columns_to_double(df, k["columns"]),
    ),
    "combine": (
        _nothing,
        lambda df, p, k: features.combine_columns(df, p["column"], p["other"], p["op"], p.get("name")),
    ),
    "transform": (
        _spread,
        lambda df, p, k: features.transform_with(df, p["column"], p["transform"], _spread_of(k), p.get("name")),
    ),
    "bin": (
        _spread,
        lambda df, p, k: features.bin_with(df, p["column"], p["bins"], _spread_of(k), p.get("name")),
    ),
}

LOG_SCHEMA = "step int, action string, column string, detail string"


def replay(steps: list[Step] | tuple[Step, ...], df: DataFrame) -> DataFrame:
    """Apply learned steps to any table with the columns they need."""
    return functools.reduce(lambda d, s: ACTIONS[s.action][1](d, s.params, s.learned), steps, df)


@dataclass(frozen=True)
class Recipe:
    """A source, the steps taken so far, and the table they lead to. Never changed in place:
    each call gives a new recipe, and a step that fails leaves nothing behind."""

    source: DataFrame
    steps: tuple[Step, ...] = ()
    result: DataFrame | None = None

    @property
    def df(self) -> DataFrame:
        return self.source if self.result is None else self.result

    def apply(self, action: str, column: str = "", **params) -> Recipe:
        if action not in ACTIONS:
            raise ValueError(f"unknown action: {action}")
        learn, change = ACTIONS[action]
        params = {"column": column, **params}
        learned = learn(self.df, params)
        changed = change(self.df, params, learned)
        detail = ", ".join(f"{k}={v}" for k, v in params.items() if k != "column")
        return Recipe(self.source, (*self.steps, Step(action, column, detail, params, learned)), changed)

    def undo(self) -> Recipe:
        if not self.steps:
            raise ValueError("nothing to undo")
        return self.restore(len(self.steps) - 1)

    def restore(self, step: int) -> Recipe:
        """Back to the state after ``step`` steps; 0 is the source."""
        if not 0 <= step <= len(self.steps):
            raise ValueError(f"there is no step {step}")
        if step == len(self.steps):
            return self
        kept = self.steps[:step]
        return Recipe(self.source, kept, replay(kept, self.source))

    def log(self) -> DataFrame:
        rows = [(i + 1, s.action, s.column, s.detail) for i, s in enumerate(self.steps)]
        return self.source.sparkSession.createDataFrame(rows, LOG_SCHEMA)

    def apply_to(self, other: DataFrame) -> DataFrame:
        return replay(self.steps, other)

    def to_json(self) -> str:
        return json.dumps([_as_record(s) for s in self.steps], default=str)


def _as_record(step: Step) -> dict:
    return {
        "action": step.action,
        "column": step.column,
        "detail": step.detail,
        "params": dict(step.params),
        "learned": dict(step.learned),
    }


def steps_from_json(text: str) -> list[Step]:
    return [Step(**record) for record in json.loads(text)]
