"""Named queries over the tables of a store, with equivalent SQL."""

from __future__ import annotations


def _modules():
    from weftgraph.queries import bodies, codegraph, facts, pathqueries, problems, views

    return [problems, codegraph, facts, pathqueries, views, bodies]


def core_queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def core_sql() -> dict:
    return {k: q for m in _modules() for k, q in m.SQL.items()}
