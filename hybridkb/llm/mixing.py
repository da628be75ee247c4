"""Mixing overlapping sources to target weights by min-cost flow.

A document belongs to several sources at once (here: its ``source`` and its ``lang``). Documents
are aggregated by membership pattern; a flow network sends each pattern's tokens to the quotas of
its sources, the r-th use of the same tokens costing ``repeat_costs[r]``; then documents are picked
in a seeded order so that each pattern yields the tokens routed through it.

Scale: one narrow pass over the documents (pattern, seeded key, token count), one aggregation to
(pattern, 1024 key ranges), and windows inside the few key ranges in which a cut falls. The
driver sees one row per pattern, never per document; the choice itself is a map-side comparison of
a row's key with its pattern's cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hybridkb.llm.flow import route
from hybridkb.session import materialise, pick

BUCKET_BITS = 10
#: A plan of more rows than this is joined by shuffle instead of being broadcast.
BROADCAST_ROWS = 200_000

PLAN = T.StructType(
    [
        T.StructField("pattern", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("epoch", T.IntegerType()),
        T.StructField("lo", T.LongType()),
        T.StructField("hi", T.LongType()),
    ]
)


def token_count(text: Column) -> Column:
    """Maximal runs without ASCII white space; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def _key(seed: int) -> Column:
    """Seeded place of a row in the order of selection; equal rows share it."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 1)


def _pattern(member_cols: tuple[str, ...]) -> Column:
    """The sources of a row, parted by a character that is escaped within their names."""

    def name(c: str) -> Column:
        return F.replace(F.replace(F.col(c).cast("string"), F.lit("\x1e"), F.lit("\x1e0")), F.lit("\x1f"), F.lit("\x1e1"))

    return F.concat_ws("\x1f", *[F.concat(F.lit(f"{c}="), F.coalesce(name(c), F.lit("\x00null"))) for c in member_cols])


def targets_from_shares(tokens: dict[str, int], power: float) -> dict[str, float]:
    """Weights in proportion to (tokens of a source) ** power."""
    raised = {s: float(n) ** power for s, n in tokens.items() if n > 0}
    total = sum(raised.values())
    return {s: v / total for s, v in raised.items()} if total else {}


def quotas(weights: dict[str, float], budget: int) -> dict[str, int]:
    total = sum(max(0.0, w) for w in weights.values())
    return {s: int(budget * max(0.0, w) / total) for s, w in weights.items()} if total else {}


def mixing_plan(
    docs: DataFrame,
    member_cols: tuple[str, ...] = ("source", "lang"),
    weights: dict[str, float] | None = None,
    share_power: float = 0.3,
    budget_factor: float = 1.25,
    repeat_costs: tuple[int, ...] = (0, 1, 4, 9),
    seed: int = 17,
) -> DataFrame:
    """(pattern, target, epoch, lo, hi): rows of ``pattern`` with lo <= key < hi go to ``target``
    in that epoch. ``weights`` are by 'column=value'; absent, they follow the token shares of the
    sources raised to ``share_power``. The budget is ``budget_factor`` times the corpus."""
    spark = docs.sparkSession
    rows = pick(docs, "doc_id", "text", *member_cols)
    narrow = materialise(rows.select(_pattern(member_cols).alias("pattern"), _key(seed).alias("key"), token_count(F.col("text")).alias("tokens")).where("tokens > 0"), "mixing")
    spread = narrow.groupBy("pattern", F.shiftright("key", 63 - BUCKET_BITS).alias("bucket")).agg(F.sum("tokens").alias("tokens"))
    spread = materialise(spread, "mixing-spread")
    sizes = {r.pattern: r.tokens for r in spread.groupBy("pattern").agg(F.sum("tokens").alias("tokens")).collect()}
    if not sizes:
        return spark.createDataFrame([], PLAN)
    order = sorted(sizes)
    members = [tuple(p.split("\x1f")) for p in order]
    weights = {k.replace("\x1e", "\x1e0").replace("\x1f", "\x1e1"): v for k, v in weights.items()} if weights else weights
    held: dict[str, int] = {}
    for p, m in zip(order, members):
        for s in m:
            held[s] = held.get(s, 0) + sizes[p]
    budget = int(budget_factor * sum(sizes.values()))
    quota = quotas(weights or targets_from_shares(held, share_power), budget)
    routed, _, _ = route([(m, sizes[p]) for p, m in zip(order, members)], quota, list(repeat_costs))

    pieces = []  # (pattern, target, epoch, token position from, to)
    for i, p in enumerate(order):
        start = 0
        for s in members[i]:
            n = routed.get((i, s), 0)
            a, end = start, start + n
            while a < end:
                epoch = a // sizes[p]
                b = min(end, (epoch + 1) * sizes[p])
                pieces.append((p, s, int(epoch), a - epoch * sizes[p], b - epoch * sizes[p]))
                a = b
            start = end
    cuts = sorted({(p, x) for p, _, _, a, b in pieces for x in (a, b) if 0 < x < sizes[p]})
    at = _locate(narrow, spread, cuts)
    top = (1 << 63) - 1
    bound = lambda p, x: 0 if x == 0 else top if x >= sizes[p] else at[p, x]
    return spark.createDataFrame([(p, s, e, bound(p, a), bound(p, b)) for p, s, e, a, b in pieces], PLAN)


def _locate(narrow: DataFrame, spread: DataFrame, cuts: list[tuple[str, int]]) -> dict[tuple[str, int], int]:
    """For each (pattern, token position) the least key with at least that many tokens before it."""
    if not cuts:
        return {}
    spark = narrow.sparkSession
    wanted = spark.createDataFrame(cuts, "pattern string, cut long")
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = spread.withColumn("before", before)
    hit = wanted.join(ranges, "pattern").where("cut > before AND cut <= before + tokens").select("pattern", "cut", "bucket", "before")
    inside = narrow.withColumn("bucket", F.shiftright("key", 63 - BUCKET_BITS)).join(hit.select("pattern", "bucket", "before").distinct(), ["pattern", "bucket"])
    run = F.coalesce(F.sum("tokens").over(Window.partitionBy("pattern", "bucket").orderBy("key").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = inside.select("pattern", "bucket", "key", (F.col("before") + run).alias("start"))
    found = (
        hit.select("pattern", "cut", "bucket")
        .join(placed, ["pattern", "bucket"])
        .groupBy("pattern", "cut", "bucket")
        .agg(F.min(F.when(F.col("start") >= F.col("cut"), F.col("key"))).alias("key"))
    )
    return {(r.pattern, r.cut): r.key if r.key is not None else min((1 << 63) - 1, (r.bucket + 1) << (63 - BUCKET_BITS)) for r in found.collect()}


def apply_plan(docs: DataFrame, plan: DataFrame, member_cols: tuple[str, ...] = ("source", "lang"), seed: int = 17, keep_columns: bool = False) -> DataFrame:
    """Rows of ``docs`` once for each piece of the plan that takes them."""
    if keep_columns:
        wide = docs.toDF(*[f"_o{i}" for i in range(len(docs.columns))])
        lower = [c.lower() for c in docs.columns]
        own = {c: F.col(f"_o{docs.columns.index(c) if c in docs.columns else lower.index(c.lower())}") if c.lower() in lower else F.lit(None) for c in ("doc_id", "text", *member_cols)}
        base = wide.withColumns(own)
    else:
        base = pick(docs, "doc_id", "text", *member_cols)
    base = base.withColumns({"_key": _key(seed), "_pattern": _pattern(member_cols), "_tokens": token_count(F.col("text"))}).where("_tokens > 0")
    rows = F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan
    taken = base.join(rows, (F.col("_pattern") == F.col("pattern")) & (F.col("_key") >= F.col("lo")) & (F.col("_key") < F.col("hi")))
    if keep_columns:
        return taken.select(*[F.col(f"_o{i}").alias(c) for i, c in enumerate(docs.columns)])
    shown = F.replace(F.replace(F.regexp_replace("target", "\x00null$", "(null)"), F.lit("\x1e1"), F.lit("\x1f")), F.lit("\x1e0"), F.lit("\x1e"))
    return taken.select("doc_id", shown.alias("target"), "epoch", F.col("_tokens").alias("n_tokens"))


def mix_sources(docs: DataFrame, keep_columns: bool = False, **params) -> DataFrame:
    """Documents chosen to meet the target weights.

    Result: (doc_id, target, epoch, n_tokens), one row for each use of a document; with
    ``keep_columns`` the input's own columns instead, a row for each use.

    Null ``source`` or ``lang`` is a source of its own, shown as '(null)'. Null or blank texts hold
    no tokens and are never chosen. A null ``doc_id`` stays null. Equal rows share their place and
    are chosen together. A quota that its sources can't fill even with the most repetitions is
    filled as far as possible. An empty table gives no rows; further columns are ignored or passed.
    """
    plan = mixing_plan(docs, **params)
    of = {k: params[k] for k in ("member_cols", "seed") if k in params}
    return apply_plan(docs, plan, keep_columns=keep_columns, **of)
