"""Facts read from function bodies, conditions and types, as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed patterns
_RETURN = r"\breturn\b[ \t]*([^;\n{}]*)"
_NULL_LIKE = r"^(?:NULL|nullptr|None|nil|null|0|-\d+|false|False)$"
_GUARD = r"if\s*\(\s*!?\s*([\w.>-]+)\s*(?:==\s*(?:NULL|nullptr|nil|null|None))?\s*\)\s*\{?\s*return"
_LOCK = r"(\w+)_lock\(&?([\w.>-]+)\)"
_UNLOCK = r"(\w+)_unlock\(&?([\w.>-]+)\)"


def return_expressions(body: Column) -> Column:
    """The texts behind return, trimmed, in order."""
    return F.transform(F.regexp_extract_all(body, F.lit(_RETURN), 1), lambda r: F.trim(r))


def null_like(expr: Column) -> Column:
    return expr.rlike(_NULL_LIKE)


def guarded_names(body: Column) -> Column:
    """Names that a function checks before it returns early: its preconditions."""
    return F.array_distinct(F.regexp_extract_all(body, F.lit(_GUARD), 1))


def lock_edges(functions: DataFrame) -> DataFrame:
    """id, relation, resource: LOCKS and UNLOCKS edges to virtual resource nodes."""
    of = lambda pattern, rel: functions.select("id", F.lit(rel).alias("relation"), F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(pattern), 2))).alias("r"))
    rows = of(_LOCK, "LOCKS").unionByName(of(_UNLOCK, "UNLOCKS"))
    return rows.select("id", "relation", F.concat(F.lit("resource::"), "r").alias("resource"))


def unbalanced_locks(edges: DataFrame) -> DataFrame:
    n = lambda rel: F.sum((F.col("relation") == rel).cast("bigint"))
    return edges.groupBy("id").agg(n("LOCKS").alias("n_lock"), n("UNLOCKS").alias("n_unlock")).where("n_lock <> n_unlock")


def documented(body: Column) -> Column:
    """Whether a body begins with a comment, or opens with a documentation string."""
    return body.rlike(r"(?s)^\s*(?:/\*|//|#[ #]|(?:async )?def [^\n]*\n\s*r?(?:\"\"\"|'''))")


def return_mismatch(body: Column) -> Column:
    """A documentation that promises a result of a function which returns none, or the other way round."""
    says = body.rlike(r"[@\\]returns?\b|:returns?:")
    gives = F.exists(return_expressions(body), lambda r: r != "")
    return F.when(says & ~gives, "documented_but_missing").when(~says & gives, "undocumented")


def condition_alive(condition: Column, bindings: dict[str, str]) -> Column:
    """False only where a condition is certainly false: #if 0, #ifdef of an unbound name among those given as "", #ifndef of
    a bound one, and equality with another value than the bound one. What isn't known counts as alive."""
    alive = ~condition.rlike(r"^\s*#\s*if\s+0\s*$")
    for name, value in bindings.items():
        if value == "":
            alive = alive & ~condition.rlike(rf"^\s*#\s*ifdef\s+{name}\s*$")
        else:
            alive = alive & ~condition.rlike(rf"^\s*#\s*ifndef\s+{name}\s*$")
            other = F.regexp_extract(condition, rf"\b{name}\s*==\s*(\w+)", 1)
            alive = alive & ((other == "") | (other == value))
            same = F.regexp_extract(condition, rf"\b{name}\s*!=\s*(\w+)", 1)
            alive = alive & ((same == "") | (same != value))
    return F.coalesce(alive, F.lit(True))


def macros_of(condition: Column) -> Column:
    """Configuration macros that a condition names."""
    return F.array_distinct(F.regexp_extract_all(condition, F.lit(r"\b([A-Z][A-Z0-9_]{2,})\b"), 1))


def security_flags(text: Column) -> Column:
    """What a text constant may be dangerous for."""
    flags = {
        "format_string": r"%[-+#0]*\d*[a-zA-Z]",
        "sql_injection_risk": r"(?i)\b(?:select|insert|update|delete)\b.*(?:%s|\+|\{\w*\})",
        "shell_injection_risk": r"(?i)\b(?:sh -c|system|exec|popen)\b|[;|&]\s*rm\s|\$\(",
        "path_traversal_risk": r"\.\./",
    }
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in flags.items()]), lambda f: f.isNotNull())


# fixed values: widths in bits of types under LP64 and LLP64
_WIDTHS = {"char": (8, 8), "short": (16, 16), "int": (32, 32), "long": (64, 32), "size_t": (64, 64), "ssize_t": (64, 64), "float": (32, 32), "double": (64, 64), "void *": (64, 64)}


def annotate_ranges(ranges: DataFrame, group: list[str]) -> DataFrame:
    """For each range the smallest other one of its group that holds it: group, name, byte_start, byte_end, holder. Equal sizes
    are settled by name. ranges: group columns, name, byte_start, byte_end, none of them null, each row once.

    Groups are spread by hash and sorted; a task sweeps over them in byte order and keeps only the ranges still open."""
    rows = ranges.select(*group, "name", "byte_start", "byte_end")
    names = rows.columns
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[tuple] = []  # end, start, name
        same: list[tuple] = []  # rows that begin together
        at = None

        def settle() -> list[tuple]:
            nonlocal open_
            if not same:
                return []
            start = same[0][-2]
            open_ = [o for o in open_ if o[0] >= start] + [(r[-1], r[-2], r[-3]) for r in same]
            out = []
            for r in same:
                over = [(e - s, n) for e, s, n in open_ if e >= r[-1] and n != r[-3]]
                if over:
                    out.append((*r, min(over)[1]))
            return out

        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if at is not None and (row[:-3] != at[:-3] or row[-2] != at[-2]):
                    found += settle()
                    same.clear()
                    if row[:-3] != at[:-3]:
                        open_ = []
                same.append(row)
                at = row
            yield batch_of(found)
        yield batch_of(settle())

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        types = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
        cols = list(zip(*found)) if found else [[] for _ in range(len(names) + 1)]
        return pa.RecordBatch.from_arrays([pa.array(list(c), types[k]) for c, k in zip(cols, [*(kinds[n] for n in names), "string"])], names=[*names, "holder"])

    placed = rows.repartition(*group).sortWithinPartitions(*group, "byte_start", F.desc("byte_end"), "name")
    return placed.mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names) + ", holder string")


def abi_loss(type_spelling: Column) -> Column:
    """portable, lossy if the width depends on the data model, pointer for pointers, unknown otherwise."""
    t = F.trim(F.regexp_replace(type_spelling, r"\b(?:const|volatile|struct|unsigned|signed)\b", ""))
    lossy = [k for k, (a, b) in _WIDTHS.items() if a != b]
    plain = [k for k, (a, b) in _WIDTHS.items() if a == b and "*" not in k]
    return F.when(t.isNull() | (t == ""), "unknown").when(t.endswith("*"), "pointer").when(t.isin(*lossy), "lossy").when(t.isin(*plain), "portable").otherwise("unknown")
