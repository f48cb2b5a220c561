"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from functools import wraps

from corpusloom.plans import assembly, chat, composite, corpus, retrieval, scalars, upkeep
from corpusloom.workers import ship

MODULES = (scalars, corpus, upkeep, retrieval, chat, composite, assembly)


def _ready(run):
    @wraps(run)
    def shipped(spark, sf_dir):
        ship(spark)
        return run(spark, sf_dir)

    return shipped


def queries() -> dict:
    return {name: _ready(run) for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
