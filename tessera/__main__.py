"""``python -m tessera records.jsonl "question" [--json]``: answer one question from a knowledge base."""

from __future__ import annotations

import sys


def main(args: list[str]) -> int:
    as_json = "--json" in args
    given = [a for a in args if a != "--json"]
    if len(given) != 2:
        print(__doc__)
        return 2
    from pyspark.sql import SparkSession

    from tessera.plans import engine
    from tessera.sources.records import load_services

    spark = SparkSession.builder.getOrCreate()
    records = load_services(spark, given[0]).cache()
    question = spark.createDataFrame([(1, given[1])], "query_id int, query string")
    out = engine.ask(question, engine.build_index(records), records, rerank=True)
    if as_json:
        print(out.toJSON().first())
    else:
        r = out.first()
        print(r.lead or r.status)
        for p in r.points or []:
            print(f"[{p.cite}] {p.section}: {p.label + ': ' if p.label else ''}{p.text}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
