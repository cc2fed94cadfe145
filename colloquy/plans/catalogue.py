"""The registered queries and their SQL."""

from __future__ import annotations

from functools import wraps

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


#: Columns of results that hold a place in an order; all queries give them as long.
PLACES = ("rank", "boosted_rank", "pool_rank", "pos", "place", "miss")


def query(sql: str | None = None):
    """Register a (spark, sf_dir) function under its own name, with its SQL."""

    def add(f):
        @wraps(f)
        def run(spark, sf_dir):
            df = f(spark, sf_dir)
            return df.withColumns({c: df[c].cast("long") for c in PLACES if c in df.columns})

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _load() -> None:
    from colloquy.plans import details, dialogue, evaluating, expanding, graphs, ingest, judging, more, probing, retrieval, streams, time, whole  # noqa: F401  they register themselves


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)


def flagship(spark, sf_dir):
    return queries()["hybrid_union_candidates"](spark, sf_dir)
