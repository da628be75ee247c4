import base64
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as cp
from hybridkb.llm import bpe, near_duplicates, sanitise
from hybridkb.llm.components import Unions

from .test_bpe import PATTERN
from .test_near_duplicates import brute
from .test_sanitise import brute as disclosed
from .test_toxicity import BAD

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(21)
    words = ["".join(r.choice(["ta", "re", "lo", "mi", "an", "or", "se"]) for _ in range(r.randint(1, 4))) for _ in range(700)]
    docs, labels = [], []
    for i in range(360):
        ws = [r.choice(words) for _ in range(50)]
        bad = i % 4 == 0
        if bad:
            ws[r.randrange(50)] = r.choice(BAD)
        if i % 9 == 1:
            ws[7:7] = ["wrenfold", f"ab{i}@mail.example.com"]  # a name that goes with such addresses only
        docs.append((i, " ".join(ws), "en" if i % 3 else "de", f"s{i % 3 and i % 5}", 0))
        if i % 3 < 2:
            labels.append((i, 1, int(bad)))
    for i in range(30):
        text = docs[5 + 7 * i][1].split()
        text[r.randrange(50)] = r.choice(words)
        docs.append((1000 + i, " ".join(text), "en", "s1", 0))
    docs += [(2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    return [(i, t, la, s, len(t) if t else n) for i, t, la, s, n in docs], labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs, labels = corpus()
    spark.createDataFrame(docs, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_each_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}

    clean = {i: t for i, t in rows.items() if not any(b in (t or "") for b in BAD)}
    docs = cp.drop_toxic(spark, docs, folder)
    assert {r.doc_id for r in docs.collect()} == set(clean) and docs.columns == DOCS_COLUMNS

    names = sorted(clean)
    pairs = brute([(i, clean[i]) for i in names], near_duplicates.THRESHOLD)
    u = Unions(max(names) + 1)
    u.join(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    kept = {i for i in names if u.roots(np.array([i]))[0] == i}
    docs = cp.drop_near_duplicates(spark, docs, folder)
    assert {r.doc_id for r in docs.collect()} == kept and len(kept) < len(clean) and docs.columns == DOCS_COLUMNS

    terms = {t: "" for t in disclosed([(i, clean[i]) for i in sorted(kept) if clean[i] is not None])}
    assert "wrenfold" in terms
    docs = cp.sanitise_texts(spark, docs, folder)
    held = {r.doc_id: r for r in docs.collect()}
    assert set(held) == kept and docs.columns == DOCS_COLUMNS
    for i in kept:
        want = sanitise.clean_text(clean[i], terms)[0] if clean[i] else clean[i]
        assert held[i].text == want
        assert want is None or held[i].n_chars == len(want)

    mixed = cp.mix(spark, docs, folder)
    uses = [tuple(r) for r in mixed.collect()]
    assert mixed.columns == DOCS_COLUMNS and set(uses) <= {tuple(r) for r in held.values()}
    total = sum(len((r.text or "").split()) for r in held.values())
    spent = sum(len(u[1].split()) for u in uses)
    assert abs(spent - 1.25 * total) < 0.1 * total

    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    peer = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = cp.encode(spark, mixed, folder).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == sorted((u[0], peer.encode_ordinary(u[1])) for u in uses)
    assert all(r.round_trip for r in got)


DOCS_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_run_and_odd_inputs(spark, folder):
    got = cp.run(spark, folder)
    assert got.count() > 200 and got.where("NOT round_trip").count() == 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    clash = docs.withColumns({"_o1": F.lit(1), "_tokens": F.lit("x"), "ids": F.lit(2), "component": F.lit(3), "score": F.lit(0.9)})
    for name, stage in cp.STAGES[:-1]:
        clash = stage(spark, clash, folder)
        assert clash.columns == [*DOCS_COLUMNS, "_o1", "_tokens", "ids", "component", "score"], name
    assert clash.count() == got.count()
