"""Information-theoretic sanitisation of personal data and secrets.

Protected entities (addresses, numbers, keys, dates of birth, titled names) are found by shape and by the
words before them, and generalised to their class. Then the corpus tells which other terms give an
entity away: with N documents,

    PMI(t; e) = log(joint(t, e) * N / (df(t) * df(e))),   IC(e) = log(N / df(e)),

and a term discloses ``PMI / IC`` of the entity. Terms at or over the threshold, for one entity or for a
whole class, are generalised to their first half where the words that share it disclose less than
the threshold, and removed otherwise.

Copies of one text are no evidence: a term needs several effective contexts (inverse Simpson index
of the signatures of whole documents) beside one entity, or several distinct entities of a class.

Scale: a first map counts for each term its documents and those of them that hold any entity. As no
joint count exceeds the latter, most terms can't reach the threshold; the others are marked in a bitmap of
fixed size, and a second map emits pairs of entities and terms for marked terms alone (a term marked by chance
fails the exact test later). The terms found are broadcast up to ``MAX_TERMS`` of them; more are joined
with the documents by shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hybridkb.llm.memory import lean, small_batches
from hybridkb.session import discard, materialise, pick

ALPHA = 0.9
MIN_CONTEXTS, MIN_VALUES = 3.0, 5
#: Disclosing terms that are broadcast at most; more of them are joined.
MAX_TERMS = 200_000
FLUSH_TERMS = 250_000
#: Bits of the map of candidate terms, and of one part of it.
MAP_BITS, PART_BITS = 1 << 26, 1 << 20

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
SHAPES = {
    "KEY": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----|(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})(?![A-Za-z0-9])",
    "SECRET": r"(?<![A-Za-z])(?i:passw(?:or)?d|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|client[_-]?secret)\s*[=:]\s*(?:\"[^\"\n]+\"|'[^'\n]+'|[^\s\"',;]+)",
    "EMAIL": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}",
    "IP": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "SSN": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "IBAN": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "CARD": r"(?<![\d.-])(?:\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}|3\d{3}[ -]?\d{6}[ -]?\d{5})(?![\d-])",
    "PHONE": r"(?<![\w(+.-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])",
    "HEX": r"(?<![A-Za-z0-9])(?=[a-f]*\d)[0-9a-f]{32,}(?![A-Za-z0-9])",
}
_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’-]+"
_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
#: Shapes that count only behind words that announce them.
SHAPES |= {
    "BIRTH": rf"(?<![A-Za-z])(?i:born|birth ?date|date of birth|d\.?o\.?b\.?)(?:[ \t]*[:=]|[ \t]+(?:on|in|is|was))?[ \t]*(?:\d{{1,2}}[./ -](?:\d{{1,2}}|{_MONTH})[./ -]\d{{2,4}}|\d{{4}}-\d{{2}}-\d{{2}}|{_MONTH} \d{{1,2}},? \d{{4}})(?!\d)",
    "PASSPORT": r"(?<![A-Za-z])(?i:passport)(?:[ \t]+(?i:no\.?|nr\.?|number|id))?[ \t]*[:#=]?[ \t]*(?=[A-Z]*\d)[A-Z0-9]{6,9}(?![A-Za-z0-9])",
    "TEL": r"(?<![A-Za-z])(?i:phone|telephone|tel|mobile|cell|call|fax|sms|whatsapp|US|UK)\.?(?:[ \t]+(?i:me|us|no\.?|number|at|on))*[ \t]*[:=]?[ \t]*\+?\d{9,15}(?!\d)",
    "ADDRESS": rf"(?<![\w.,-])\d{{1,5}}[A-Za-z]? (?:{_CAP} ){{1,3}}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Boulevard|Blvd|Court|Square|Terrace)(?![A-Za-z])",
    "NAME": rf"(?<![A-Za-z])(?:(?:Mr|Mrs|Ms|Miss|Dr|Prof)\.? {_CAP}(?: {_CAP}){{0,2}}|(?i:my name is|name:) {_CAP}(?: {_CAP}){{0,2}})",
    "PERSON": rf"(?<![A-Za-z])(?:{_CAP} {_CAP}(?=, \d{{1,5}}[A-Za-z]? (?:{_CAP} ){{1,3}}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Boulevard|Blvd|Court|Square|Terrace)(?![A-Za-z])))",
}
_COMPILED = {k: re.compile(v) for k, v in SHAPES.items()}
#: The class that further shapes of it are shown as.
_SHOWN = {"TEL": "PHONE", "PERSON": "NAME"}
#: What a text must hold for a shape to be looked for: one of these pieces (of its lower-case form for the
#: second table), a pattern, or a digit.
_PIECES = {
    "KEY": ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox", "AIza", "eyJ", "-----BEGIN"),
    "EMAIL": ("@",),
    "SECRET": ("=", ":"),
}
_LOW_PIECES = {
    "SECRET": ("pass", "pwd", "token", "secret", "key"),
    "BIRTH": ("born", "birth", "dob", "d.o.b"),
    "PASSPORT": ("passport",),
    "NAME": ("mr ", "mr.", "mrs", "ms ", "ms.", "miss ", "dr ", "dr.", "prof", "name is", "name:"),
}
_DIGIT = re.compile("[0-9]")
_DIGITAL = frozenset(("IP", "SSN", "IBAN", "CARD", "PHONE", "HEX", "BIRTH", "PASSPORT", "TEL", "ADDRESS", "PERSON"))
_RUN = re.compile(r"[0-9][0-9 .()-]{5}")
_STREET = re.compile(r"[0-9][A-Za-z]? [A-ZÀ-ÖØ-Þ]")
_GATES = {"IP": _RUN, "SSN": _RUN, "CARD": _RUN, "PHONE": _RUN, "IBAN": re.compile(r"[A-Z]{2}[0-9]{2}"), "HEX": re.compile(r"[0-9a-f]{32}"), "TEL": re.compile(r"[0-9]{9}"), "ADDRESS": _STREET, "PERSON": _STREET}
EDGE = ".,;:?!\"'()[]{}<>«»“”„…$#*%&|"
PREFIXES = range(3, 9)


def _card(number: str) -> bool:
    """Whether the digits are a card's: an issuer's first digit and a right check digit."""
    d = [int(c) for c in number if c.isdigit()][::-1]
    return 2 <= d[-1] <= 6 and sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def entities(text: str) -> list[tuple[str, str, int, int]]:
    """(class, value, from, to) of the protected entities, left to right; of overlapping ones the first."""
    found, low, digit, known = [], text.lower(), _DIGIT.search(text) is not None, {}
    for rank, (kind, pattern) in enumerate(_COMPILED.items()):
        if kind in _DIGITAL and not digit:
            continue
        if (some := _PIECES.get(kind)) and not any(p in text for p in some) or (some := _LOW_PIECES.get(kind)) and not any(p in low for p in some):
            continue
        if gate := _GATES.get(kind):
            if gate not in known:
                known[gate] = gate.search(text) is not None
            if not known[gate]:
                continue
        found += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text) if kind != "CARD" or _card(m.group())]
    if not found:
        return []
    out, at = [], 0
    for a, _, b, kind in sorted(found):
        if a >= at:
            out.append((_SHOWN.get(kind, kind), text[a:b], a, b))
            at = b
    return out


def without_entities(text: str, spans: list[tuple[str, str, int, int]]) -> str:
    out, at = [], 0
    for _, _, a, b in spans:
        out.append(text[at:a])
        at = b
    return " ".join([*out, text[at:]])


def term(word: str) -> str:
    return word.strip(EDGE).lower()


def _hash(values: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(values, object)).view(np.int64) if values else np.empty(0, np.int64)


def signature(terms: list[str]) -> int:
    """Three minima of hashed terms as one number: two documents of Jaccard similarity J share it with
    a chance of J^3, so copies at 0.75 have fewer than three effective contexts, while unlike documents
    with a phrase in common differ."""
    if not terms:
        return 0
    h = _hash(terms).view(np.uint64)
    least = [int(((h ^ (h >> np.uint64(29))) * np.uint64(k)).min()) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    return int(_hash([" ".join(map(str, least))])[0])


def document_terms(text: str) -> list[str]:
    """The distinct terms of a text, entities cut out."""
    words = {term(w) for w in without_entities(text, entities(text)).split()}
    words.discard("")
    return sorted(words)


def term_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df, held): documents of ``docs`` with the term, and those of them that hold an entity; the
    term '' counts the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, held = Counter(), Counter()

        def give() -> Iterator[pa.RecordBatch]:
            names = list(every)
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(list(every.values()), pa.int64()), pa.array([held[t] for t in names], pa.int64())], names=["term", "df", "held"])
            every.clear()
            held.clear()

        for b in batches:
            for t in b.column(0).to_pylist():
                spans = entities(t)
                own = {w.strip(EDGE) for w in set((without_entities(t, spans) if spans else t).lower().split())}
                own.add("")
                every.update(own)
                if spans:
                    held.update(own)
                if len(every) > FLUSH_TERMS:
                    yield from give()
        yield from give()

    return docs.mapInArrow(lean(run), "term string, df long, held long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("held").alias("held"))


def _places(terms: list[str]) -> np.ndarray:
    return (_hash(terms).view(np.uint64) >> np.uint64(5)) % np.uint64(MAP_BITS)


def candidate_map(terms: DataFrame) -> np.ndarray:
    """A bitmap of ``MAP_BITS`` bits with those of the terms set."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_places(b.column(0).to_pylist())).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // PART_BITS), pa.array(at % PART_BITS)], names=["part", "bit"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            part, bit = b.column(0).to_numpy(), b.column(1).to_numpy()
            for p in np.unique(part).tolist():
                held.setdefault(p, np.zeros(PART_BITS, bool))[bit[part == p]] = True
        for p, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["part", "bits"])

    rows = terms.select("term").mapInArrow(places, "part long, bit long").repartition("part").mapInArrow(gather, "part long, bits binary")
    out = np.zeros((MAP_BITS // PART_BITS, PART_BITS // 8), np.uint8)
    for r in rows.collect():  # MAP_BITS bits in all
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def entity_terms(docs: DataFrame, marked: np.ndarray) -> DataFrame:
    """(kind, value, term, context, lead): one row for each entity and marked term of a document; ``lead``
    marks the first entity of its kind there. The term '' stands for the document itself."""
    schema = "kind string, value long, term string, context long, lead int"
    shared = docs.sparkSession.sparkContext.broadcast(marked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            kinds, values, names, contexts, leads = [], [], [], [], []

            def give() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.int64()), pa.array(names, pa.string()), pa.array(contexts, pa.int64()), pa.array(leads, pa.int32())], names=["kind", "value", "term", "context", "lead"])
                for x in (kinds, values, names, contexts, leads):
                    x.clear()
                return out

            for t in b.column(0).to_pylist():
                spans = entities(t)
                if not spans:
                    continue
                words = {term(w) for w in without_entities(t, spans).split()}
                words.discard("")
                words = sorted(words)
                at = _places(words)
                some = np.flatnonzero(bits[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1).tolist() if words else []
                own, context = ["", *(words[i] for i in some)], signature(words)
                pairs = list(dict.fromkeys((k, v.lower()) for k, v, _, _ in spans))
                seen = set()
                for (kind, _), value in zip(pairs, _hash([v for _, v in pairs]).tolist()):
                    n = len(own)
                    kinds += [kind] * n
                    values += [value] * n
                    names += own
                    contexts += [0] + [context] * (n - 1)
                    leads += [int(kind not in seen)] * n
                    seen.add(kind)
                    if len(kinds) > 100_000:
                        yield give()
            if kinds:
                yield give()

    return docs.mapInArrow(lean(run), schema)


FOUND = "term string, kind string, disclosure double, general string"


def disclosing_terms(docs: DataFrame, alpha: float = ALPHA, min_contexts: float = MIN_CONTEXTS, min_values: int = MIN_VALUES) -> DataFrame:
    """(term, kind, disclosure, general): terms at or over the threshold, the kind that they disclose most,
    and the generalisation to use ('' where the term must go)."""
    small_batches(docs.sparkSession)
    texts = pick(docs, "text").selectExpr("cast(text as string) text").where("text IS NOT NULL")
    frequencies = materialise(term_frequencies(texts), "term-frequencies")
    total = frequencies.where("term = ''").select(F.col("df").alias("N"))
    n = total.first()
    empty = docs.sparkSession.createDataFrame([], FOUND)
    if n is None:
        return empty
    least = min(min_contexts, min_values)
    # joint <= held and df_e >= least, so that a term beyond this bound stays under alpha
    room = max(1.0, n.N / least) ** (1 - alpha) * (1 + 1e-9)
    able = frequencies.where("term <> ''").where((F.col("held") >= least) & (F.col("df") <= F.col("held") * room))
    by_context = entity_terms(texts, candidate_map(able)).groupBy("kind", "value", "term", "context").agg(F.count(F.lit(1)).alias("n"), F.sum("lead").alias("lead"))
    by_value = by_context.groupBy("kind", "value", "term").agg(F.sum("n").alias("joint"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum("lead").alias("lead"))
    by_value = materialise(by_value, "entity-terms")
    of_value = by_value.where("term = ''").select("kind", "value", F.col("joint").alias("df_e"))
    single = by_value.where("term <> ''").where(F.col("joint") * F.col("joint") >= min_contexts * F.col("squares")).where(F.col("joint") >= min_contexts)
    single = single.join(of_value, ["kind", "value"]).select("kind", "term", "joint", "df_e")
    of_kind = by_value.where("term = ''").groupBy("kind").agg(F.sum("lead").alias("df_e"))
    whole = by_value.where("term <> ''").groupBy("kind", "term").agg(F.sum("lead").alias("joint"), F.count(F.lit(1)).alias("values")).where(F.col("values") >= min_values)
    whole = whole.join(of_kind, "kind").select("kind", "term", "joint", "df_e")
    rated = single.unionByName(whole).join(frequencies.where("term <> ''").select("term", "df"), "term").crossJoin(F.broadcast(total))
    rated = rated.where("df_e < N").withColumn("disclosure", _disclosure("joint", "df"))
    over = rated.where(F.col("disclosure") >= alpha).groupBy("term").agg(F.max(F.struct("disclosure", "kind", "joint", "df_e", "df", "N")).alias("s")).select("term", "s.*")
    half = F.ceil(F.length("term") / 2).cast("int")
    over = materialise(over.withColumn("prefix", F.when(half.between(PREFIXES[0], PREFIXES[-1]), F.substring(F.col("term"), F.lit(1), half))), "disclosing-terms")
    if over.isEmpty():
        discard(frequencies, by_value)
        return empty
    wanted = over.where("prefix IS NOT NULL").select("prefix").distinct()
    shared = (
        frequencies.where(F.length("term") >= PREFIXES[0])
        .select("df", F.explode(F.transform(F.sequence(F.lit(PREFIXES[0]), F.least(F.length("term"), F.lit(PREFIXES[-1]))), lambda k: F.substring(F.col("term"), F.lit(1), k))).alias("prefix"))
        .join(wanted, "prefix")
        .groupBy("prefix")
        .agg(F.sum("df").alias("df_p"))
    )
    joint = over.groupBy("prefix", "kind").agg(F.sum("joint").alias("joint_p"))
    over = over.join(shared, "prefix", "left").join(joint, ["prefix", "kind"], "left")
    general = F.when(F.col("df_p").isNotNull() & (_disclosure("joint_p", "df_p") < alpha), F.concat("prefix", F.lit("*"))).otherwise(F.lit(""))
    found = materialise(over.select("term", "kind", F.round("disclosure", 6).alias("disclosure"), general.alias("general")), "sanitised-terms")
    discard(frequencies, by_value)
    return found


def _disclosure(joint: str, df: str) -> Column:
    n = F.col("N").cast("double")
    return F.log(F.col(joint) * n / (F.col(df).cast("double") * F.col("df_e"))) / F.log(n / F.col("df_e"))


def clean_text(text: str, terms: dict[str, str]) -> tuple[str, int, int]:
    """(text, entities generalised, terms generalised or removed)."""
    spans = entities(text)
    if spans:
        out, at = [], 0
        for kind, _, a, b in spans:
            out += [text[at:a], f"[{kind}]"]
            at = b
        text = "".join(out) + text[at:]
    if not terms or not any(term(w) in terms for w in set(text.split())):
        return text, len(spans), 0
    n = 0

    def swap(m: re.Match) -> str:
        nonlocal n
        w = m.group()
        t = term(w)
        if t not in terms or w.strip(EDGE).upper() in SHAPES:
            return w
        n += 1
        core = w.strip(EDGE)
        a = w.find(core)
        return w[:a] + (terms[t] or "[REDACTED]") + w[a + len(core) :]

    return re.sub(r"\S+", swap, text), len(spans), n


CLEANED = "text string, n_entities int, n_terms int"


def _cleaned(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (a string column ``text`` among others) with ``text`` sanitised by the terms ``found``, and the counts."""
    spark, others = rows.sparkSession, [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    schema = f"{schema}, {CLEANED}" if others else CLEANED

    def map_(batches: Iterator[pa.RecordBatch], terms_of) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            texts = b.column(names.index("text")).to_pylist()
            got = [(None, 0, 0) if t is None else clean_text(t, x) for t, x in zip(texts, terms_of(b))]
            out = [b.column(names.index(c)) for c in others]
            yield pa.RecordBatch.from_arrays([*out, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())], names=[*others, "text", "n_entities", "n_terms"])

    if found.count() <= MAX_TERMS:
        held = spark.sparkContext.broadcast({r.term: r.general for r in found.select("term", "general").collect()})
        return rows.select(*others, "text").mapInArrow(lean(lambda batches: map_(batches, lambda b: [held.value] * b.num_rows)), schema)

    keyed = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "sanitise-rows")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [sorted(set(map(term, (clean_text(t, {})[0] if t else "").split()))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), [len(x) for x in own])), pa.array([w for x in own for w in x], pa.string())], names=["_row", "term"])

    hits = keyed.select("_row", "text").mapInArrow(lean(words), "_row long, term string").join(found.select("term", "general"), "term")
    per_row = hits.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("term", "general"))).alias("_terms"))
    joined = keyed.join(per_row, "_row", "left").select(*others, "text", "_terms")
    return joined.mapInArrow(lean(lambda batches: map_(batches, lambda b: [dict(x or ()) for x in b.column(b.schema.names.index("_terms")).to_pylist()])), schema)


def sanitise_rows(rows: DataFrame, text: str = "text", **params) -> DataFrame:
    """``rows`` with the column ``text`` (a string) sanitised by what it discloses, all else as it was."""
    found = disclosing_terms(rows.select(F.col(text).cast("string").alias("text")), **params)
    wide = rows.withColumnRenamed(text, "text") if text != "text" else rows
    return _cleaned(wide, found).drop("n_entities", "n_terms").withColumnRenamed("text", text).select(*rows.columns)


def sanitise_documents(docs: DataFrame, **params) -> DataFrame:
    """(doc_id, text, n_entities, n_terms), one row for each row of ``docs``.

    Null texts stay null with zero counts, empty ones empty; texts without entities or disclosing
    terms come back unchanged. Repeated rows and null ids keep their rows (and count as documents
    in the statistics); an empty table gives none; further columns are ignored. Texts of any length are taken whole.
    """
    rows = pick(docs, "doc_id", "text").selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return _cleaned(rows, disclosing_terms(docs, **params)).select("doc_id", "text", "n_entities", "n_terms")
