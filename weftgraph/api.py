"""One store behind one object: tables, SQL, Cypher, named queries with a cache, and hooks that add columns."""

from __future__ import annotations

import re
import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.operators import graph
from weftgraph.plans.cypher import Cypher
from weftgraph.sources.tables import TABLES, table

_READS = re.compile(r"^\s*(?:--[^\n]*\n\s*|/\*.*?\*/\s*)*(?:select|with|explain|describe|show|values|from)\b", re.I | re.S)


class Graph:
    """Reads a store. ``hooks`` map the nodes table, in order; each gets and gives a DataFrame with id."""

    def __init__(self, spark: SparkSession, root: str, hooks: list[Callable[[DataFrame], DataFrame]] | None = None, cached: int = 256, ttl: float = 600.0):
        self.spark, self.root, self.hooks = spark, root, list(hooks or [])
        self.most, self.ttl = cached, ttl
        self._cache: OrderedDict[str, tuple[float, DataFrame]] = OrderedDict()

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.root, name)

    def nodes(self) -> DataFrame:
        out = graph.function_nodes(self.table("functions"))
        for hook in self.hooks:
            out = hook(out)
        return out

    def edges(self) -> DataFrame:
        return graph.all_edges(self.table("edges"))

    def sql(self, text: str) -> DataFrame:
        """A query over the tables; anything that isn't one is refused."""
        if not _READS.match(text) or ";" in text.rstrip().rstrip(";"):
            raise PermissionError("only one reading statement is allowed")
        for name in TABLES:
            if re.search(rf"\b{name}\b", text):
                self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(text.rstrip().rstrip(";"))

    def cypher(self, text: str) -> DataFrame:
        return Cypher(self.spark, self.nodes(), self.edges()).run(text)

    def query(self, name: str) -> DataFrame:
        """A named query, kept for ``ttl`` seconds; the least recently used of more than ``cached`` goes first."""
        from weftgraph.queries import core_queries

        now = time.monotonic()
        hit = self._cache.get(name)
        if hit and now - hit[0] < self.ttl:
            self._cache.move_to_end(name)
            return hit[1]
        if hit:
            hit[1].unpersist()
        out = core_queries()[name](self.spark, self.root).cache()
        self._cache[name] = (now, out)
        self._cache.move_to_end(name)
        while len(self._cache) > self.most:
            self._cache.popitem(last=False)[1][1].unpersist()
        return out

    def forget(self) -> None:
        """Drops what is kept, as after a change of the store."""
        for _, df in self._cache.values():
            df.unpersist()
        self._cache.clear()
