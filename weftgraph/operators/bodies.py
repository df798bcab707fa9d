"""Accesses and locks read from function bodies, access by access.

A body's lines are searched for locks taken and released and for fields read and written; their order in the text is the
order of events. An access holds the locks whose last event before it in the function was an acquire: a lock is held or
not, it isn't counted. Races are told between classes of accesses: those of one field that agree in writing or not, in
the function's thread model and in the set of locks held. A pair of classes stands for all pairs of their functions, and
membership lists the functions of each class, so a field that everything touches costs as many rows as it has accesses.

Functions are told by id; a null id or body gives no rows, and the same body twice counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed patterns, which SQL can use as well
TOKEN = r"\w+_(?:un)?lock\(&?[\w.>-]+\)|(?:\w+(?:->|\.))+(?:[uU]nl|[lL])ock\(\)|\w+->\w+(?:\s*(?:[-+*/|&^]?==?|\+\+|--))?"
RELEASE, ACQUIRE, WRITE = r"_unlock\(|[uU]nlock\(\)$", r"_lock\(|[lL]ock\(\)$", r"(?:\+\+|--|[^=]=)$"
LOCK_ARGUMENT, LOCK_OWNER, FIELD = r"(\w+)\)$", r"(\w+)(?:->|\.)\w+\(\)$", r"->(\w+)"
CALL, PARAMETERS, LAST_WORD = r"\w+\([^()]*\)", r"\(([^()]*)\)", r"(\w+)\s*$"
#: A line's events are numbered below this within the function's.
LINE = 1_000_000_000


def body_events(functions: DataFrame) -> DataFrame:
    """id, model, seq, kind (acquire, release, read or write), name (the lock's or field's last component).
    functions: id, body, model."""
    lines = functions.where("id is not null and body is not null").distinct().select("id", "model", F.posexplode(F.split("body", "\n")).alias("line", "t"))
    found = lines.select("id", "model", "line", F.posexplode(F.regexp_extract_all("t", F.lit(TOKEN), 0)).alias("pos", "token"))
    token = F.col("token")
    kind = F.when(token.rlike(RELEASE), "release").when(token.rlike(ACQUIRE), "acquire").when(token.rlike(WRITE), "write").otherwise("read")
    lock = F.coalesce(F.nullif(F.regexp_extract(token, LOCK_ARGUMENT, 1), F.lit("")), F.regexp_extract(token, LOCK_OWNER, 1))
    out = found.select("id", "model", (F.col("line").cast("bigint") * LINE + F.col("pos")).alias("seq"), kind.alias("kind"), "token")
    return out.select("id", "model", "seq", "kind", F.when(F.col("kind").isin("acquire", "release"), lock).otherwise(F.regexp_extract(token, FIELD, 1)).alias("name"))


def covered_accesses(events: DataFrame) -> DataFrame:
    """fn, model, seq, res, is_write, locks: every access with the locks held, in order of their names."""
    mine = Window.partitionBy("id", "name").orderBy("seq")
    held = events.where("kind in ('acquire', 'release')").withColumn("until", F.lead("seq").over(mine)).where("kind = 'acquire'").select("id", F.col("name").alias("lock"), F.col("seq").alias("since"), "until")
    accesses = events.where("kind in ('read', 'write')").select("id", "model", "seq", F.col("name").alias("res"), (F.col("kind") == "write").alias("is_write"))
    # a function's own accesses and locks: as many as its text has
    within = (F.col("since") < F.col("seq")) & (F.col("until").isNull() | (F.col("seq") < F.col("until")))
    locks = accesses.select("id", "seq").join(held, "id").where(within).groupBy("id", "seq").agg(F.array_join(F.array_sort(F.collect_set("lock")), ",").alias("locks"))
    out = accesses.join(locks, ["id", "seq"], "left")
    return out.select(F.col("id").alias("fn"), F.coalesce("model", F.lit("")).alias("model"), "seq", "res", "is_write", F.coalesce("locks", F.lit("")).alias("locks"))


def lock_coverage(accesses: DataFrame) -> DataFrame:
    """fn, res, is_write, protected, n."""
    return accesses.groupBy("fn", "res", "is_write", (F.col("locks") != "").alias("protected")).agg(F.count("*").alias("n"))


CLASS = ["res", "is_write", "model", "locks"]


def access_classes(accesses: DataFrame) -> DataFrame:
    """CLASS, n_fns, first_fn (its representative)."""
    return accesses.groupBy(*CLASS).agg(F.countDistinct("fn").alias("n_fns"), F.min("fn").alias("first_fn"))


def _conflict(a: str, b: str) -> Column:
    c = lambda side, name: F.col(f"{side}.{name}")
    models = ~((c(a, "model") == c(b, "model")) & (c(a, "model") != ""))
    apart = (c(a, "locks") == "") | (c(b, "locks") == "") | ~F.arrays_overlap(F.split(c(a, "locks"), ","), F.split(c(b, "locks"), ","))
    return (c(a, "is_write") | c(b, "is_write")) & models & apart


def race_classes(accesses: DataFrame) -> DataFrame:
    """Pairs of classes whose accesses may race: one of them writes, they share no lock, and they aren't of one known thread
    model. a_... and b_... name the classes in order, with a representative each; n_pairs counts the pairs of different
    functions they stand for. Classes per field are few: locks and models, not functions."""
    one = accesses.select("fn", *CLASS).distinct()
    k = F.struct("is_write", "model", "locks")
    classes = access_classes(one).withColumn("k", k)
    a, b = classes.alias("a"), classes.alias("b")
    pairs = a.join(b, (F.col("a.res") == F.col("b.res")) & (F.col("a.k") <= F.col("b.k"))).where(_conflict("a", "b"))
    # a function in both classes doesn't race with itself; it has few classes of a field
    keyed = one.withColumn("k", k).select("fn", "res", "k")
    both = keyed.alias("x").join(keyed.alias("y"), (F.col("x.fn") == F.col("y.fn")) & (F.col("x.res") == F.col("y.res")) & (F.col("x.k") < F.col("y.k")))
    both = both.groupBy(F.col("x.res").alias("res"), F.col("x.k").alias("ka"), F.col("y.k").alias("kb")).agg(F.count("*").alias("n_both"))
    n, m = F.col("a.n_fns"), F.col("b.n_fns")
    out = pairs.select(
        F.col("a.res").alias("res"), F.col("a.k").alias("ka"), F.col("b.k").alias("kb"), F.col("a.first_fn").alias("a_fn"), F.col("b.first_fn").alias("b_fn"),
        F.when(F.col("a.k") == F.col("b.k"), n * (n - 1) / 2).otherwise(n * m).cast("bigint").alias("n_pairs"),
    )
    out = out.join(both, ["res", "ka", "kb"], "left").withColumn("n_pairs", F.col("n_pairs") - F.coalesce("n_both", F.lit(0))).where("n_pairs > 0")
    sides = [F.col(f"k{s}.{c}").alias(f"{s}_{name}") for s in "ab" for c, name in (("is_write", "writes"), ("model", "model"), ("locks", "locks"))]
    return out.select("res", *sides, "a_fn", "b_fn", "n_pairs")


def race_members(accesses: DataFrame, races: DataFrame) -> DataFrame:
    """CLASS, fn: the functions of every class that is in a race."""
    hit = races.select("res", F.explode(F.array(*[F.struct(F.col(f"{s}_writes").alias("is_write"), F.col(f"{s}_model").alias("model"), F.col(f"{s}_locks").alias("locks")) for s in "ab"])).alias("k")).select("res", "k.*").distinct()
    return accesses.select("fn", *CLASS).distinct().join(hit, CLASS, "left_semi")


def lock_order(events: DataFrame) -> DataFrame:
    """What a release of a lock in one function happens before: its acquires in others. lock, n_release, n_acquire,
    n_edges (pairs of different functions)."""
    rows = events.where("kind in ('acquire', 'release')").groupBy(F.col("name").alias("lock"), "id").agg(F.max((F.col("kind") == "acquire").cast("bigint")).alias("a"), F.max((F.col("kind") == "release").cast("bigint")).alias("r"))
    sums = rows.groupBy("lock").agg(F.sum("r").alias("n_release"), F.sum("a").alias("n_acquire"), F.sum(F.col("a") * F.col("r")).alias("both"))
    return sums.select("lock", "n_release", "n_acquire", (F.col("n_release") * F.col("n_acquire") - F.col("both")).alias("n_edges"))


def call_arguments(functions: DataFrame) -> DataFrame:
    """fn, callee, pos, value: the arguments of calls without calls within. functions: fn, body."""
    lines = functions.where("fn is not null and body is not null").distinct()
    calls = lines.select("fn", F.explode(F.regexp_extract_all("body", F.lit(CALL), 0)).alias("call"))
    rows = calls.select("fn", F.regexp_extract("call", r"^(\w+)", 1).alias("callee"), F.posexplode(F.split(F.regexp_extract("call", PARAMETERS, 1), ",")).alias("pos", "value"))
    return rows.distinct()


def parameters(functions: DataFrame) -> DataFrame:
    """fn, pos, name: parameters by the last word of each. functions: fn, signature."""
    rows = functions.where("fn is not null and signature is not null").select("fn", F.posexplode(F.split(F.regexp_extract("signature", PARAMETERS, 1), ",")).alias("pos", "p"))
    return rows.select("fn", "pos", F.regexp_extract("p", LAST_WORD, 1).alias("name")).where("name <> ''").distinct()
