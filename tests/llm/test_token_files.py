import numpy as np
import pytest

from hybridkb.llm import bpe
from hybridkb.llm.token_files import count_tokens, document_token_counts, list_token_files

SEP = 9


def plain(ids):
    out, n = [], 0
    for t in ids:
        if t == SEP:
            out.append((n, True))
            n = 0
        else:
            n += 1
    return out + ([(n, False)] if n else [])


@pytest.mark.parametrize("block", [2, 6, 10, 64, 1 << 20])
def test_blocks_are_stitched(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    want = set()
    for f, (n, odds) in enumerate([(500, 0.3), (300, 0.01), (40, 0.0), (0, 0.0), (30, 1.0)]):
        ids = np.where(rng.random(n) < odds, SEP, 1).astype("<u2")
        (tmp_path / f"{f}.tok").write_bytes(ids.tobytes() + (b"\x01" if f == 2 else b""))
        want |= {(f"{f}.tok", i, k, closed) for i, (k, closed) in enumerate(plain(ids.tolist()))}
    files = list_token_files(spark, f"file://{tmp_path}")
    assert files.count() == 5
    got = {(r.file.rsplit("/", 1)[1], r.ordinal, r.n_tokens, r.closed) for r in count_tokens(files, SEP, 2, block).collect()}
    assert got == want
    twice = files.where("file LIKE '%0.tok'")
    assert count_tokens(twice.union(twice), SEP, 2, block).count() == 2 * count_tokens(twice, SEP, 2, block).count()


def test_documents(spark):
    rows = [(1, "one two three"), (2, None), (3, ""), (None, "x"), (4, "word " * 5000), (4, "word " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    v = bpe.Encoder(bpe.Vocabulary())
    size = lambda t: len(v.encode(t.encode(), np.array([0, len(t.encode())]))[0]) if t else 0
    for block in (16, 1 << 20):
        got = sorted(map(tuple, document_token_counts(docs, block_bytes=block).collect()), key=str)
        assert got == sorted([(i, size(t)) for i, t in rows], key=str)
    assert document_token_counts(docs.limit(0)).count() == 0


def test_wide_vocabularies_and_clashing_names(spark, tmp_path):
    """Over 65,536 tokens ids take four bytes, whatever the separator; a separator that is a token is refused."""
    import base64

    from pyspark.sql import functions as F

    path = tmp_path / "wide.tiktoken"
    tokens = [bytes([b]) for b in range(256)] + [b"\xff" + i.to_bytes(3, "big") for i in range(70_000)]
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(i + (i >= 300)).encode() for i, t in enumerate(tokens)))
    docs = spark.createDataFrame([(1, "abc"), (2, ""), (3, None), (4, "defgh")], "doc_id long, text string").withColumns({"file": F.lit("x"), "size": F.lit(1), "width": F.lit(9), "ordinal": F.lit(0), "doc_ids": F.lit("y")})
    got = sorted(map(tuple, document_token_counts(docs, str(path), 300).collect()))
    assert got == [(1, 3), (2, 0), (3, 0), (4, 5)]
    with pytest.raises(ValueError):
        document_token_counts(docs, str(path), 97)
