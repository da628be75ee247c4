import itertools

import pytest

from hybridkb.llm.flow import route
from hybridkb.llm.mixing import mix_sources

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(patterns, quotas, costs):
    """Least cost of the largest flow, by trying every split of small integer capacities."""
    links = [(i, s) for i, (m, _) in enumerate(patterns) for s in sorted(set(m)) if s in quotas]
    best = (0, 0)
    spans = [range(min(quotas[s], patterns[i][1] * len(costs)) + 1) for i, s in links]
    for xs in itertools.product(*spans):
        used, filled = [0] * len(patterns), dict.fromkeys(quotas, 0)
        for (i, s), x in zip(links, xs):
            used[i] += x
            filled[s] += x
        if any(filled[s] > quotas[s] for s in quotas) or any(u > t * len(costs) for u, (_, t) in zip(used, patterns)):
            continue
        cost = sum(costs[n // t] for u, (_, t) in zip(used, patterns) if t for n in range(u))
        best = min(best, (-sum(xs), cost))
    return -best[0], best[1]


@pytest.mark.parametrize(
    "patterns,quotas",
    [
        ([(("a", "b"), 3), (("a",), 2), (("b", "c"), 1)], {"a": 4, "b": 3, "c": 2}),
        ([(("a",), 1), (("b",), 4)], {"a": 3, "b": 2}),
        ([(("a", "b"), 2), (("b",), 2)], {"a": 5, "b": 1}),
        ([(("x",), 2)], {"y": 3}),
    ],
)
def test_flow_is_optimal(patterns, quotas):
    costs = [0, 1, 4]
    sent, flow, cost = route(patterns, quotas, costs)
    assert (flow, cost) == brute(patterns, quotas, costs)
    assert sum(sent.values()) == flow


def test_costs_must_be_convex():
    with pytest.raises(ValueError):
        route([], {}, [3, 1])


def test_quotas_are_met_and_order_is_seeded(spark):
    rows = [(i, "w " * (1 + i % 7), "en" if i % 3 else "de", f"s{i % 2}", 1) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    weights = {"source=s0": 1.0, "source=s1": 2.0, "lang=de": 3.0}
    got = mix_sources(docs, weights=weights, seed=3).collect()
    total = int(1.25 * sum(1 + i % 7 for i in range(600)))
    for s, w in weights.items():
        tokens = sum(r.n_tokens for r in got if r.target == s)
        assert abs(tokens - total * w / 6) <= 7 * 2 * 4 * 2, s
    assert sorted(got) == sorted(mix_sources(docs, weights=weights, seed=3).collect())
    assert sorted(got) != sorted(mix_sources(docs, weights=weights, seed=4).collect())
    by = {}
    for r in got:
        assert (r.doc_id, r.epoch) not in by, "a document is used once an epoch at most"
        by[r.doc_id, r.epoch] = r
    de = {i for i in range(600) if i % 3 == 0}
    assert all(r.doc_id in de for r in got if r.target == "lang=de")


def test_selection_matches_a_plain_walk(spark):
    """Pattern by pattern, pieces taken along the seeded order at token positions."""
    from pyspark.sql import functions as F

    from hybridkb.llm.mixing import _key, _pattern, mixing_plan, token_count

    rows = [(i, "x " * (1 + (i * i) % 5), "en", "a" if i % 4 else "b", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {(r.doc_id, r.target, r.epoch) for r in mix_sources(docs, weights={"source=a": 1, "source=b": 2, "lang=en": 1}).collect()}
    keyed = docs.select("doc_id", _pattern(("source", "lang")).alias("p"), _key(17).alias("k"), token_count(F.col("text")).alias("n")).collect()
    held, tokens = {}, {}
    for r in keyed:
        held.setdefault(r.p, []).append(r)
    want = set()
    from hybridkb.llm.mixing import quotas
    from hybridkb.llm.flow import route as solve

    order = sorted(held)
    sizes = {p: sum(r.n for r in held[p]) for p in order}
    q = quotas({"source=a": 1, "source=b": 2, "lang=en": 1}, int(1.25 * sum(sizes.values())))
    sent, _, _ = solve([(tuple(p.split("\x1f")), sizes[p]) for p in order], q, [0, 1, 4, 9])
    for i, p in enumerate(order):
        start = 0
        for s in p.split("\x1f"):
            n = sent.get((i, s), 0)
            at = 0
            for e in range(4):
                run = 0
                for r in sorted(held[p], key=lambda r: r.k):
                    if start <= e * sizes[p] + run < start + n:
                        want.add((r.doc_id, s, e))
                    run += r.n
            start += n
    assert got == want
    assert mixing_plan(docs).count() > 0


def test_nulls_blanks_repeats_empty_and_clashing_columns(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "one two", None, "a", 7), (4, "one two", "en", None, 7), (4, "one two", "en", None, 7), (5, "word " * 30000, "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mix_sources(docs).collect()
    ids = {r.doc_id for r in got}
    assert ids <= {None, 4, 5} and 5 in ids
    assert mix_sources(docs.limit(0)).count() == 0
    from pyspark.sql import functions as F

    clash = docs.withColumns({"epoch": F.lit(9), "target": F.lit("x"), "_key": F.lit(1), "pattern": F.lit("q"), "lo": F.lit(3)})
    assert sorted(map(str, mix_sources(clash).collect())) == sorted(map(str, got))
    kept = mix_sources(clash, keep_columns=True)
    assert kept.columns == clash.columns and kept.count() == len(got)


def test_source_names_hold_any_character(spark):
    rows = [(i, "a b c d", "en", s, 7) for i, s in enumerate(["x\x1fy", "x", "y", "x\x1ey", "x\x1e1y", None] * 20)]
    got = {r.target for r in mix_sources(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {"lang=en", "source=x\x1fy", "source=x", "source=y", "source=x\x1ey", "source=x\x1e1y", "source=(null)"}
