"""Declarative recipes: an ordered list of steps folded over a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from sievework.functions import schema
from sievework.functions.work import settle
from sievework.operators import dedup, encode, explore, features, knn, missing, scaling, text

ACTIONS = {
    "drop_rows": missing.drop_rows,
    "drop_cols": missing.drop_cols,
    "fill": missing.fill,
    "knn_impute": knn.knn_impute,
    "remove_duplicates": dedup.remove,
    "first_by_key": dedup.by_key,
    "scale": scaling.scale,
    "label_encode": encode.label,
    "one_hot": encode.one_hot,
    "outliers": scaling.outliers,
    "cap_upper": scaling.cap_upper,
    "standardize_text": text.standardize,
    "coerce": text.coerce,
    "feature": features.add,
    "where": explore.where,
    "standardize_names": schema.standardize_names,
}
#: Actions whose result needs a shuffle of its rows, and actions that read their input while they are added.
SHUFFLING = frozenset(("remove_duplicates", "first_by_key", "knn_impute", "label_encode"))
FITTING = frozenset(("drop_cols", "fill", "knn_impute", "scale", "label_encode", "one_hot", "outliers", "cap_upper", "feature"))


def run(df: DataFrame, steps: Sequence[Mapping[str, object]], settle_every: int | None = None,
        settle_shuffles: bool = True) -> DataFrame:
    """Apply steps ``{"action": name, **arguments}`` in order.

    Steps that fit constants read their input when they are added.  Where a
    shuffling step comes before one, its result is written first, so that no
    shuffle runs twice; a recipe that only filters and projects in between is
    scanned again, which costs less than writing it.  ``settle_every`` writes
    the intermediate table every few steps whatever they are,
    ``settle_shuffles=False`` leaves out the former.
    """
    unknown = [s.get("action") for s in steps if s.get("action") not in ACTIONS]
    if unknown:
        raise ValueError(f"Unknown action(s): {unknown}. Allowed: {', '.join(ACTIONS)}")
    shuffled = False
    for i, step in enumerate(steps):
        due = settle_every and i and i % settle_every == 0
        if due or (settle_shuffles and shuffled and step["action"] in FITTING):
            df, shuffled = settle(df), False
        shuffled = shuffled or step["action"] in SHUFFLING
        arguments = {k: v for k, v in step.items() if k != "action"}
        df = df.transform(ACTIONS[step["action"]], **arguments)
    return df


def preview(df: DataFrame, steps: Sequence[Mapping[str, object]], n: int = 20, order: Sequence[str] = ()) -> DataFrame:
    """The first rows the recipe would give in the order of some columns; without one, any rows."""
    out = run(df, steps)
    return (out.orderBy(*[schema.col(c) for c in order]) if order else out).limit(n)
