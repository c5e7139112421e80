"""python -m prescriva TABLE SCHEMA.json OUT [--option value ...]: a whole run, its results below OUT."""

from __future__ import annotations

import argparse
import dataclasses

from pyspark.sql import SparkSession

from prescriva.operators import report
from prescriva.operators.schema import Schema, problems
from prescriva.plans import prescriptive
from prescriva.sources import tables


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="prescriva", description=__doc__)
    parser.add_argument("table")
    parser.add_argument("schema")
    parser.add_argument("out")
    parser.add_argument("--key", default="row_id")
    plain = [f for f in dataclasses.fields(prescriptive.Options) if f.name != "segment" and (f.default is None or isinstance(f.default, (int, float, str)))]
    for f in plain:
        kind = str if f.default is None or isinstance(f.default, str) else type(f.default)
        parser.add_argument(f"--{f.name.replace('_', '-')}", **({"action": "store_true"} if kind is bool and not f.default else {"type": (lambda v: v.lower() in ("1", "true")) if kind is bool else kind}), default=None)
    parser.add_argument("--segment", metavar="COLUMN=VALUE")
    parser.add_argument("--exclude", metavar="SOURCE:TARGET", action="append", default=[], help="an edge that the map may not have; may be repeated")
    parser.add_argument("--balance-auto", action="store_true", help="balance levels where the rarest has less than a quarter of all rows")
    parser.add_argument("--quick", action="store_true", help="three folds, three slopes and one alpha")
    parser.add_argument("--search", metavar="NAME=NUMBER", action="append", default=[], help="an option of the genetic search; may be repeated")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("prescriva").getOrCreate()
    with open(given.schema, encoding="utf-8") as f:
        schema = Schema.from_json(f.read())
    chosen = {f.name: v for f in plain if (v := getattr(given, f.name)) is not None}
    for name in ("delta_most", "most_steps"):
        if name in chosen:
            chosen[name] = (float if name == "delta_most" else int)(chosen[name])
    if "binarize" in chosen and schema.objective.encoding == "numerica":
        chosen["binarize"] = float(chosen["binarize"])
    if given.segment:
        chosen["segment"] = tuple(given.segment.split("=", 1))
    if given.balance_auto:
        chosen["balance_levels"] = None
    chosen["excluded_edges"] = [tuple(e.split(":", 1)) for e in given.exclude]
    chosen["search"] = {k: float(v) if "." in v else int(v) for k, v in (x.split("=", 1) for x in given.search)}
    options = prescriptive.Options.of(chosen)
    options = options.quick() if given.quick else options
    df = tables.read_table(spark, given.table)
    if not schema.objective.name or given.key not in df.columns:
        raise SystemExit(f"{given.table} has no column {given.key}")
    for r in problems(df, schema, options.segment).collect():
        print(f"{r.severity}: {r.column or 'table'}: {r.kind} ({r.n})")
    model, metrics, plans = prescriptive.run(df, schema, given.key, options, print)
    selection = spark.createDataFrame(metrics["selection"]) if metrics.get("selection") else None
    tables.save_results(given.out, prescriptive.recommendations(model, plans, given.key), tables.weight_matrix(model.map.edges(spark), model.map.ids), metrics, selection)
    model.save(spark, f"{given.out}/model")
    print("\n".join(report.metric_lines(metrics)))


if __name__ == "__main__":
    main()
