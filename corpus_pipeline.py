"""Training-corpus pipeline over ``documents``: toxic documents go, one document of each group of near
duplicates stays, personal data is sanitised, sources are mixed to target weights, and what is
left is encoded.

Every stage takes null ids and texts, empty and very long texts, repeated rows, empty tables and further
columns, whatever their names; what it does with them its docstring says. All but the last return the
columns of their input in the same order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridkb.llm import bpe, mixing, near_duplicates, sanitise, toxicity
from hybridkb.session import discard, keeping, materialise, table


def _position(docs: DataFrame, name: str) -> int:
    return docs.columns.index(name) if name in docs.columns else [c.lower() for c in docs.columns].index(name)


def _numbered(docs: DataFrame) -> DataFrame:
    """Columns by position, so that no further column can clash."""
    return docs.toDF(*[f"_o{i}" for i in range(len(docs.columns))])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores under the toxicity threshold. Null and empty texts stay, repeated
    rows are judged alike, and without labels of both outcomes all stay."""
    score = toxicity.toxicity_column(docs, table(spark, sf_dir, "labels"), text=f"_o{_position(docs, 'text')}")
    return _numbered(docs).where(score < toxicity.THRESHOLD).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least id of each group connected by pairs of a Jaccard similarity of 0.75 or more. Null texts and
    texts without words stay, as do null ids; of equal rows that repeat an id one stays."""
    return near_duplicates.keep_one_of_each(docs)


def sanitise_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Protected entities and disclosing terms generalised; ``n_chars`` follows the text. Every row stays; null
    texts stay null with their ``n_chars``."""
    at = f"_o{_position(docs, 'text')}"
    out = sanitise.sanitise_rows(_numbered(docs).withColumn(at, F.col(at).cast("string")), at)
    if "n_chars" in docs.columns:
        count = f"_o{docs.columns.index('n_chars')}"
        out = out.withColumn(count, F.coalesce(F.length(at).cast("long"), F.col(count)))
    return out.toDF(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each use of a document; documents without tokens (null, empty and blank texts) or beyond
    their quotas go. Equal rows are taken together; a null source or language is one of its own."""
    return mixing.mix_sources(docs, keep_columns=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, offsets, round_trip), the last by decoding; one row for each row. A null
    text has null ids, an empty one none."""
    return bpe.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("sanitise", sanitise_texts),
    ("mix_sources", mix),
    ("byte_bpe", encode),
]

#: Decoding, learning and flow have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each written to the shared folder and read again. What a stage has
    written besides goes when its result is there, and that when the next one's is."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with keeping(f"pipeline-{name}"):
            done = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
