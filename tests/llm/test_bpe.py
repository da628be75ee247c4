import base64
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from hybridkb.llm import bpe

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def peer():
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary())


def encode(encoder, texts):
    data = "".join(texts).encode()
    edges = np.cumsum([0] + [len(t.encode()) for t in texts])
    ids, offsets, before = encoder.encode(data, edges)
    return data, [ids[a:b].tolist() for a, b in zip(before, before[1:])], offsets, ids


def test_agrees_with_the_regex_tokeniser(encoder, peer):
    rng = random.Random(5)
    for alphabet in ("ab s'tremvlld  \n\t12 é中#$ '’ ー\r🙂", "' sdtm", " \n  x.", "Don't you'll we've I'm 'TIS 's"):
        for _ in range(400):
            texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(5)]
            assert encode(encoder, texts)[1] == [peer.encode_ordinary(t) for t in texts]


def test_scan_equals_a_sequential_walk():
    rng = np.random.default_rng(2)
    for n in (1, 7, 128, 129, 5000):
        symbols = rng.integers(0, 16, n).astype(np.uint8)
        state, want = bpe.FRESH, []
        for s in symbols:
            want.append(state)
            state = bpe.GO[s * 8 + state]
        assert bpe.scan_states(symbols).tolist() == want


def test_long_slices(encoder, peer):
    for w in ("a" * 300, "ab" * 500, "#" * 999, "été" * 200, "x" * 60000, " " * 5000):
        assert encode(encoder, [w])[1] == [peer.encode_ordinary(w)]


def test_offsets_locate_tokens(encoder):
    data, _, offsets, ids = encode(encoder, ["Grüße, world's 12 ends", "", "x  y"])
    for at, t in zip(offsets, ids):
        token = encoder.v.tokens[t]
        assert data[at : at + len(token)] == token


def test_rows_round_trip(spark, peer):
    rows = [(1, "Hello world's end  \n"), (2, None), (3, ""), (None, "naïve 中文 🙂"), (3, ""), (4, "long words " * 40000), (5, "<|endoftext|>\x00")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("clash"), "n_tokens": F.lit(1)})
    enc = bpe.encode_documents(docs)
    got = {(r.doc_id, r.n_tokens): r for r in enc.collect()}
    assert len(enc.collect()) == len(rows)
    by = {r.doc_id: r for r in got.values()}
    assert by[2].ids is None and by[2].n_tokens == 0 and by[2].round_trip is None
    assert by[3].ids == [] and by[3].round_trip
    for i, t in rows:
        if t:
            assert by[i].ids == peer.encode_ordinary(t) and by[i].round_trip
    back = sorted(bpe.decode_documents(enc).collect(), key=str)
    assert back == sorted([(i, t) for i, t in rows], key=lambda r: str(back[0].__class__(doc_id=r[0], text=r[1])))
    assert bpe.encode_documents(docs.limit(0)).count() == 0


def test_runs_are_cut_at_rows():
    import pyarrow as pa

    col = pa.array(["aa", None, "bbbb", "c" * 50, ""])
    runs = list(bpe.text_runs(col, 5))
    assert b"".join(r[2] for r in runs) == b"aabbbb" + b"c" * 50
    assert [r[:2] for r in runs][0][0] == 0 and runs[-1][1] == 5
    assert [r[1] for r in runs[:-1]] == [r[0] for r in runs[1:]]
    assert list(bpe.text_runs(col.slice(2, 1), 5))[0][2] == b"bbbb"
