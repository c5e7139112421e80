"""Wanted values of the system, record by record: (key, column, value as text) rows beside the records.

A wish for the objective is a goal. One for another mutable column sets the state that the
record starts from; if that concept moves, the search seeks it as well. Immutable columns
and actions can't be wished for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prescriva.operators.encode import Preprocessor
from prescriva.operators.individual import normalized_value
from prescriva.operators.schema import Concept


def checked(p: Preprocessor, columns: list[str]) -> dict[str, Concept]:
    """Column -> concept; an error names all that can't be wished for."""
    concepts = {c.column: c for c in p.schema.concepts if c.category is None}
    unknown = sorted(c for c in columns if c not in concepts)
    fixed = sorted(c for c in columns if c in concepts and concepts[c].role in ("inmutable", "accion"))
    if unknown or fixed:
        parts = [f"no concepts of the model: {', '.join(unknown)}"] * bool(unknown) + [f"immutable or actions: {', '.join(fixed)}; only the objective and mutable columns can be wished for"] * bool(fixed)
        raise ValueError("; ".join(parts))
    return {c: concepts[c] for c in columns}


def normalized(p: Preprocessor, wishes: DataFrame, key: str) -> tuple[DataFrame, dict[str, str]]:
    """((key, one column for each wished concept in [0, 1]), concept -> its column); a value that is neither a number nor a category of its column, or a second wish of a record for one column, is an error."""
    columns = [r[0] for r in wishes.select("column").distinct().orderBy("column").limit(len(p.schema.concepts) + 1).collect()]
    concepts = checked(p, columns)
    value: Column = F.lit(None).cast("double")
    for c in concepts:
        value = F.when(F.col("column") == c, normalized_value(p, c, F.col("value"))).otherwise(value)
    own = wishes.select(key, "column", "value", value.alias("v"))
    bad = own.where("value is not null and v is null").select("column", "value").distinct().limit(3).collect()
    if bad:
        raise ValueError("unreadable wishes: " + ", ".join(f"{r.column} = {r.value}" for r in bad))
    names = {x.id: f"_want_{x.id}" for x in concepts.values()}
    wide = own.groupBy(key).agg(*(F.max(F.when(F.col("column") == c, F.col("v"))).alias(names[x.id]) for c, x in concepts.items()), *(F.count(F.when(F.col("column") == c, 1)).alias(f"_n_{x.id}") for c, x in concepts.items()))
    twice = wide.where(F.greatest(*(F.col(f"_n_{x.id}") for x in concepts.values()), F.lit(0)) > 1).limit(1).collect() if concepts else []
    if twice:
        raise ValueError(f"more than one wish for a column by {key} {twice[0][key]}")
    return wide.select(key, *names.values()), names


def applied(x: DataFrame, p: Preprocessor, wishes: DataFrame | None, key: str) -> tuple[DataFrame, dict[str, str], str | None]:
    """(``x`` with wishes in its states, moving concept -> column of wishes, column of wished goals).

    Records without wishes stay as they are; wishes of unknown records are left out.
    """
    if wishes is None:
        return x, {}, None
    wide, names = normalized(p, wishes, key)
    out = x.join(wide, key, "left").withColumns({i: F.coalesce(F.col(c), F.col(i)) for i, c in names.items()})
    objective = p.schema.concepts[-1].id
    moving = {c.id for c in p.schema.concepts if c.dynamic}
    return out, {i: c for i, c in names.items() if i in moving and i != objective}, names.get(objective)
