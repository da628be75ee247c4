"""Toxicity of documents behind a noisy channel.

A character trigram model is counted over all documents. A lexicon of toxic words and stems is
learned from labelled documents. A disguised token (leetspeak, symbols or spaces between letters,
repeated letters) spans a lattice of readings; Viterbi decoding under the character model and the
channel's costs restores the likeliest one, and the restored text is scored by the lexicon.

An entry of the lexicon is judged by how often a text holds it against the text's length: k places
(for a stem, k different longer words) among n words surprise by -log P(K >= k), K Poisson with the
rate of the entry in clean documents. So weak forms of one stem add up, and a long text may hold what a
short one may not.

Scale: the trigram counts are summed per task and then by cell (the alphabet is fixed, so at most
64^3 cells reach the driver). The lexicon is fitted on a bounded sample of labelled rows
(``MAX_LABELLED``). Scoring is a map over rows. A token's lattice is decoded only if some reading of it
can begin with a lexicon entry, which the token's skeleton (letters that look alike made equal, runs
made single) tells without decoding.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hybridkb.llm.memory import held, lean, small_batches, steady, tidy
from hybridkb.session import materialise, pick

#: Labelled rows used for fitting, at most; chosen by a seeded hash.
MAX_LABELLED = 20_000
THRESHOLD = 0.5
STEMS = (4, 5, 6, 7, 8)
SURPRISE, LEAST_SHARE = 17.0, 0.9
#: Nats of surprise that an entry may ask for.
LEVELS = (2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 10.0, 12.0, 15.0)
#: Places that an entry counts for in clean documents besides those seen.
UNSEEN = 0.01
#: Words of a language by which its rates are drawn to those of all.
DRAWN = 2_000
#: Known tokens a worker remembers before it starts anew; a cache alone.
CACHE_TOKENS = 200_000

ACCENTED = "àâäáãåæçèéêëìíîïñòóôöõøùúûüýÿßœšž"
SIZE = 64
EDGE_CODE, OTHER_CODE = 0, 1
CODES = {c: i + 2 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz" + ACCENTED)}

#: Readings of a disguising character besides itself, '' for none.
READINGS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "¡": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "{": "c",
}
MASKS = {"*": "aeiou", "#": "aeiou", "%": "aeiou"}
FILLERS = frozenset(".-_~'’`^·•,:;/\\=")
LEET_COST, MASK_COST, DROP_SYMBOL_COST, REPEAT_COST, KEEP_DIGIT_COST = -1.0, -2.0, -7.0, -1.0, -3.0
DROP_MASK_COST = -3.0
_TRIM = ".,;:?\"()[]{}<>«»“”„…"
_SKELETON = {ord(a): ord(b[0]) for a, b in READINGS.items()} | {ord("l"): ord("i"), ord("b"): ord("g"), ord("6"): ord("g"), ord("8"): ord("g")} | {ord(c): None for c in FILLERS}
_RUNS = re.compile(r"(.)\1+")
_SUSPECT = re.compile(r"(?=.*[^\W\d_])(?:.*[0-9@$!¡|+€£(<{*#%._~'’`^·•:/\\=-]|.*(.)\1)")
_SPACED = re.compile(r"(?:(?<=\s)|^)(?:\S[ \t]+){2,}\S(?=\s|$)")


def code_table() -> np.ndarray:
    """Code of every code point below 0x10000: letters of the alphabet, other word characters, the rest."""
    out = np.zeros(0x10000, np.uint8)
    for c in range(0x10000):
        if chr(c).isalnum():
            out[c] = CODES.get(chr(c), OTHER_CODE)
    return out


def trigram_counts(text: str, table: np.ndarray) -> np.ndarray:
    """Counts by (before last, last, next) code; a word starts and ends at the edge code."""
    points = np.frombuffer(("\n" + text.lower() + "\n").encode("utf-32-le"), np.uint32)
    codes = table[np.minimum(points, 0xFFFF)].astype(np.int32)
    a, b, c = codes[:-2].copy(), codes[1:-1], codes[2:]
    a[b == EDGE_CODE] = EDGE_CODE
    inside = (b != EDGE_CODE) | (c != EDGE_CODE)
    start = codes[1] != EDGE_CODE  # a word at the very start has no two codes before it
    out = np.bincount(((a * SIZE + b) * SIZE + c)[inside], minlength=SIZE**3)
    if start:
        out[codes[1]] += 1
    return out


def count_characters(docs: DataFrame) -> np.ndarray:
    """Trigram counts over all texts."""
    broadcast = docs.sparkSession.sparkContext.broadcast(code_table())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            held, size = [], 0
            for t in batch.column(0):
                if t.is_valid:
                    held.append(t.as_py())
                    size += len(held[-1])
                if size > 1_000_000:
                    total += trigram_counts("\n".join(held), broadcast.value)
                    held, size = [], 0
            if held:
                total += trigram_counts("\n".join(held), broadcast.value)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(total[cells], pa.int64())], names=["cell", "n"])

    rows = pick(docs, "text").selectExpr("cast(text as string) text").mapInArrow(lean(run), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SIZE**3)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out


def language_model(counts: np.ndarray, words: list[str] = ()) -> np.ndarray:
    """Log probabilities of the next code, interpolated down to single characters. ``words`` add a
    tenth of the corpus between them, so that the lexicon is part of the language."""
    n = counts.reshape(SIZE, SIZE, SIZE).copy()
    if words:
        each = max(1.0, counts.sum() / 10 / len(words))
        for w in words:
            a = b = EDGE_CODE
            for c in [*(CODES.get(x, OTHER_CODE) for x in w), EDGE_CODE]:
                n[a, b, c] += each
                a, b = b, c
    single = (n.sum((0, 1)) + 0.5) / (n.sum() + 0.5 * SIZE)
    pair = n.sum(0)
    pair = (pair + 5 * single) / (pair.sum(1, keepdims=True) + 5)
    return np.log((n + 5 * pair[None]) / (n.sum(2, keepdims=True) + 5)).reshape(-1)


class Decoder:
    """Viterbi over the lattice of a token's readings."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()

    @staticmethod
    def arcs(c: str) -> list[tuple[str, float]]:
        if c in CODES or c.isalpha():
            return [(c, 0.0)]
        if c in MASKS:
            return [(x, MASK_COST) for x in MASKS[c]] + [("", DROP_MASK_COST)]
        if c in READINGS:
            own = [(c, KEEP_DIGIT_COST)] if c.isdigit() else [("", DROP_SYMBOL_COST)]
            return [(x, LEET_COST) for x in READINGS[c]] + own
        return [("", DROP_SYMBOL_COST if c not in FILLERS else -0.5)] if not c.isalnum() else [(c, KEEP_DIGIT_COST)]

    def decode(self, token: str) -> str:
        model, states, before = self.model, {(EDGE_CODE, EDGE_CODE): (0.0, None)}, ""
        for c in token:
            arcs, found = self.arcs(c), {}
            for (a, b), (score, trail) in states.items():
                base = (a * SIZE + b) * SIZE
                for x, cost in arcs:
                    if x:
                        k = CODES.get(x, OTHER_CODE)
                        key, s, t = (b, k), score + cost + model[base + k], (trail, x)
                    else:
                        key, s, t = (a, b), score + cost, trail
                    if key not in found or s > found[key][0]:
                        found[key] = (s, t)
                if c == before:  # a repetition says nothing new
                    s = score + REPEAT_COST
                    if (a, b) not in found or s > found[a, b][0]:
                        found[a, b] = (s, trail)
            states, before = found, c
        trail = max((s + model[(a * SIZE + b) * SIZE + EDGE_CODE], i, t) for i, ((a, b), (s, t)) in enumerate(states.items()))[2]
        out = []
        while trail:
            trail, x = trail
            out.append(x)
        return "".join(reversed(out))


def skeleton(token: str) -> str:
    return _RUNS.sub(r"\1", token.translate(_SKELETON))


def surprise(k: int, mean: float) -> float:
    """-log P(K >= k) for K Poisson."""
    if k <= mean:
        return 0.0
    term = total = 1.0
    i = k
    while term > 1e-9 * total:
        i += 1
        term *= mean / i
        total += term
    return mean + math.lgamma(k + 1) - k * math.log(mean) - math.log(total)


class Scorer:
    """Scores texts by a lexicon {word or stem + '*': (probability of toxic, least surprise, rate in clean texts)}."""

    def __init__(self, lexicon: dict[str, tuple[float, float, float]], model: np.ndarray):
        self.lexicon, self.decoder = lexicon, Decoder(model)
        self.skeletons = {skeleton(w.rstrip("*")) for w in lexicon}
        self.lengths = sorted({len(s) for s in self.skeletons})
        self.known: set[str] = set()
        self.hits: dict[str, tuple[str, list[str]]] = {}

    def look_up(self, word: str) -> list[str]:
        """Its entries; a word of the lexicon is no form of a stem."""
        return [e for e in _entries(word) if e in self.lexicon][: 1 if word in self.lexicon else None]

    def restore(self, token: str) -> str:
        """The token's likeliest reading; itself where nothing disguises it."""
        return self.decoder.decode(token) if _SUSPECT.match(token) else token

    def judge(self, token: str) -> tuple[str, list[str]]:
        """The word read and its entries."""
        core = token.strip(_TRIM)
        bare = core.strip("$#*%&!")
        if bare.isalpha():
            if found := self.look_up(bare):
                return bare, found
        if _SUSPECT.match(core) and self._may_hit(core):
            word = self.decoder.decode(core)
            if found := self.look_up(word):
                return word, found
        return core, []

    def _may_hit(self, core: str) -> bool:
        if any(c in "!*#%@$|+(<{" for c in core):  # such a character may be read or dropped
            return True
        s = skeleton(core)
        return any(s[:n] in self.skeletons for n in self.lengths)

    def score(self, text: str | None) -> float:
        """1 - product of (1 - p) over the entries that the restored text holds often enough."""
        if not text or not self.lexicon:
            return 0.0
        low = text.lower()
        words = low.split()
        tokens = set(words)
        new = tokens - self.known
        if new:
            if len(self.known) > CACHE_TOKENS:
                self.known, self.hits, new = set(), {}, tokens
            for t in new:
                word, found = self.judge(t)
                if found:
                    self.hits[t] = (word, found)
            self.known |= new
        held: dict[str, list[str]] = defaultdict(list)
        hit = tokens & self.hits.keys()
        for t in hit and (w for w in words if w in hit):
            word, found = self.hits[t]
            for e in found:
                held[e].append(word)
        if any(len(t) == 1 for t in tokens):
            for m in _SPACED.finditer(low):
                for e, word in self._spaced("".join(m.group().split())):
                    held[e].append(word)
        clean = 1.0
        for e, forms in held.items():
            p, least, rate = self.lexicon[e]
            if surprise(len(set(forms) if e[-1] == "*" else forms), len(words) * rate) >= least:
                clean *= 1 - p
        return round(1 - clean, 6)

    def _spaced(self, joined: str) -> Iterator[tuple[str, str]]:
        if len(set(joined)) < 3:
            return
        read = self.decoder.decode(joined)
        for e in self.lexicon:
            if len(w := e.rstrip("*")) >= 4 and w in read:
                yield e, read


def _entries(word: str) -> list[str]:
    """The word and the stems that it is longer than."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def _words(text: str) -> tuple[int, Counter]:
    """(words, count of each that is of letters alone)."""
    words = text.lower().split()
    out: Counter = Counter()
    for t, k in Counter(words).items():
        if (w := t.strip(_TRIM + "$#*%&!")).isalpha():
            out[w] += k
    return len(words), out


def _features(words: Counter) -> dict[str, int]:
    """Places of each word and different words of each stem."""
    out = dict(words)
    for w in words:
        for e in _entries(w)[1:]:
            out[e] = out.get(e, 0) + 1
    return out


def _sketch(text: str) -> list[int]:
    """Eight minima of hashed word triples."""
    w = text.lower().split()
    h = pd.util.hash_array(np.array([" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))], object)).astype(np.uint64)
    return [int((h * np.uint64(m)).min() >> np.uint64(1)) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def drop_copies(rows: list[tuple[int, list[int]]], least: int = 6) -> list[int]:
    """Ids without those that share ``least`` minima or more with an id before them."""
    at: dict[tuple[int, int], list[int]] = {}
    kept = []
    for i, sketch in rows:
        near = Counter(j for k, h in enumerate(sketch) for j in at.get((k, h), ()))
        if near and max(near.values()) >= least:
            continue
        kept.append(i)
        for k, h in enumerate(sketch):
            at.setdefault((k, h), []).append(i)
    return kept


def evidence(a: float, b: float, base: float) -> float:
    """Log-likelihood ratio of ``a`` toxic and ``b`` clean against the share ``base``."""
    share = a / (a + b) if a else 0.0
    if share <= base:
        return 0.0
    return a * math.log(share / base) + (b * math.log((1 - share) / (1 - base)) if b else 0.0)


class Evidence:
    """What the labelled documents say of the candidate entries.

    ``toxic``: the outcome of each document; ``sizes``: its words; ``places``: (document, word) to count, for
    all words of a candidate in documents that hold it surprisingly often; ``rates``: by candidate.
    """

    def __init__(self, toxic: dict[int, int], sizes: dict[int, int], places: dict[tuple[int, str], int], rates: dict[str, float]):
        self.toxic, self.sizes, self.rates = toxic, sizes, rates
        self.base = sum(toxic.values()) / len(toxic)
        self.held: dict[str, dict[int, dict[str, int]]] = defaultdict(lambda: defaultdict(dict))
        for (i, word), k in places.items():
            for e in _entries(word):
                if e in rates:
                    self.held[e][i][word] = k

    def surprises(self, entry: str, without: set[str] = frozenset()) -> dict[int, float]:
        out = {}
        for i, words in self.held[entry].items():
            k = len(words.keys() - without) if entry[-1] == "*" else words[entry]
            s = surprise(k, self.sizes[i] * self.rates[entry]) if k else 0.0
            if s >= LEVELS[0]:
                out[i] = s
        return out

    def best(self, surprises: dict[int, float], covered: set[int] = frozenset()) -> tuple[float, float, float] | None:
        """(evidence, share, level) of the level with the most evidence in documents not covered."""
        found = None
        for level in LEVELS:
            ids = [i for i, s in surprises.items() if s >= level and i not in covered]
            a = sum(self.toxic[i] for i in ids)
            p = (a + 0.5) / (len(ids) + 1)
            ratio = evidence(a, len(ids) - a, self.base)
            if ratio >= SURPRISE and p >= LEAST_SHARE and (found is None or ratio > found[0]):
                found = (ratio, p, level)
        return found

    def words(self) -> dict[str, tuple[float, float]]:
        got = {e: self.best(self.surprises(e)) for e in self.rates if e[-1] != "*"}
        return {e: v[1:] for e, v in got.items() if v}

    def stems(self, without: set[str] = frozenset()) -> dict[str, tuple[float, float]]:
        """Stems, the strongest first, each for what it adds to those before it; words in ``without`` don't count."""
        seen = {e: self.surprises(e, without) for e in sorted(self.rates) if e[-1] == "*"}
        live = {e: v for e in seen if (v := self.best(seen[e]))}
        out, covered = {}, set()
        while live:
            e = max(live, key=lambda x: (live[x][0], len(x), x))
            before = live.pop(e)
            now = self.best(seen[e], covered)
            if now is None:
                continue
            if now[0] < before[0]:
                live[e] = now
                continue
            out[e] = now[1:]
            covered |= {i for i, s in seen[e].items() if s >= now[2]}
        return out


def choose(seen: Evidence, rounds: int = 3) -> dict[str, tuple[float, float]]:
    """{entry: (share, level)}. A stem needs evidence beside the words admitted; a word under a stem
    needs evidence in documents that the stem does not catch, as it may be one of many ordinary forms."""
    words = kept = seen.words()
    for _ in range(rounds):
        stems = seen.stems(set(kept))
        kept = {}
        for w, v in words.items():
            caught = {i for e in _entries(w)[1:] if e in stems for i, s in seen.surprises(e).items() if s >= stems[e][1]}
            if not caught or seen.best(seen.surprises(w), caught):
                kept[w] = v
    return kept | seen.stems(set(kept))


def learn_lexicon(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = 5) -> dict[str, tuple[float, float, float]]:
    """Words and stems that nearly all documents that hold them often enough are toxic for, with (that
    share, the surprise that is often enough, the rate in clean documents).

    Copies among the labelled documents count once. An entry needs a log-likelihood ratio of
    ``SURPRISE`` nats against the base rate, so that chance gives none among millions of features,
    and a share of ``LEAST_SHARE``. Rates are those of the language (column ``lang``, if there is one) where
    the entry is commonest.
    """
    spark = docs.sparkSession
    small_batches(spark)
    marked = pick(labels, "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = marked.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_labelled)
    sample = spark.createDataFrame(sample.toPandas(), marked.schema)  # bounded by max_labelled
    texts = pick(docs, "doc_id", "text", "lang").selectExpr("doc_id", "cast(text as string) text", "coalesce(cast(lang as string), '') lang").where("text IS NOT NULL").join(F.broadcast(sample), "doc_id")

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_sketch(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(got, pa.list_(pa.int64()))], names=["doc_id", "toxic", "sketch"])

    seen = texts.select("doc_id", "text", "toxic").mapInArrow(lean(sketches), "doc_id long, toxic int, sketch array<long>").collect()
    toxic_of = {r.doc_id: int(r.toxic == 1) for r in seen}
    kept = drop_copies(sorted((r.doc_id, r.sketch) for r in seen))
    toxic_of = {i: toxic_of[i] for i in kept}
    base = sum(toxic_of.values()) / len(kept) if kept else 0.0
    if not 0 < base < 1:
        return {}
    chosen = spark.createDataFrame([(i,) for i in kept], "doc_id long")
    once = materialise(texts.join(F.broadcast(chosen), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "toxicity-labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(feature, language, toxic documents, places in toxic and in clean ones); '' has the words."""
        got: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0, 0])
        for b in batches:
            for t, y, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                n, words = _words(t)
                for f, k in [("", n), *_features(words).items()]:
                    c = got[f, lang]
                    c[0] += y == 1
                    c[1 if y == 1 else 2] += k
        rows = list(got.items())
        for i in range(0, len(rows), 50_000):
            part = rows[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[0][k] for r in part], pa.string()) for k in (0, 1)] + [pa.array([r[1][k] for r in part], pa.int64()) for k in (0, 1, 2)], names=["feature", "lang", "a", "ka", "kb"])

    sums = once.select("text", "toxic", "lang").mapInArrow(lean(count), "feature string, lang string, a long, ka long, kb long").groupBy("feature", "lang").agg(*[F.sum(c).alias(c) for c in ("a", "ka", "kb")])
    sums = materialise(sums, "toxicity-features")
    total = {r.lang: (r.ka, r.kb) for r in sums.where("feature = ''").collect()}
    in_toxic, in_clean = (sum(v[k] for v in total.values()) for k in (0, 1))
    # no level can reach SURPRISE with fewer toxic documents, nor a rate that is not above the clean one
    whole = sums.where("feature <> ''").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("ka").alias("ka"), F.sum("kb").alias("kb"))
    strong = whole.where((F.col("a") >= SURPRISE / -math.log(base)) & (F.col("ka") * float(in_clean) > F.col("kb") * float(in_toxic))).select("feature")
    by_lang: dict[str, list] = defaultdict(list)
    for r in sums.join(strong, "feature", "left_semi").collect():
        by_lang[r.feature].append(r)
    rates = {}
    for f, rows in by_lang.items():
        ka, kb = sum(r.ka for r in rows), sum(r.kb for r in rows)
        if evidence(ka, kb, in_toxic / (in_toxic + in_clean)) >= SURPRISE:
            rate = (kb + UNSEEN) / (in_clean + 1)
            rates[f] = max(rate, *((r.kb + DRAWN * rate) / (total[r.lang][1] + DRAWN) for r in rows))
    if not rates:
        return {}
    shared = spark.sparkContext.broadcast(rates)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, words, word, count): the words of candidates that surprise; at least one row, '', a document."""
        rates = shared.value
        for b in batches:
            out: list[tuple[int, int, str, int]] = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n, words = _words(t)
                features = _features(words)
                good = {f for f in features.keys() & rates.keys() if surprise(features[f], n * rates[f]) >= LEVELS[0]}
                out += [(i, n, "", 0), *((i, n, w, k) for w, k in words.items() if good and not good.isdisjoint(_entries(w)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64()))], names=["doc_id", "n", "word", "k"])

    rows = once.select("doc_id", "text").mapInArrow(lean(find), "doc_id long, n long, word string, k long").toPandas()
    sizes = dict(zip(rows["doc_id"].tolist(), rows["n"].tolist()))
    places = {(i, w): k for i, w, k in zip(rows["doc_id"].tolist(), rows["word"].tolist(), rows["k"].tolist()) if k}
    found = choose(Evidence(toxic_of, sizes, places, rates))
    return {e: (round(p, 6), level, rates[e]) for e, (p, level) in found.items()}


def toxicity_column(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, text: str = "text") -> Column:
    """Score of the column ``text``, fitted on ``docs`` and ``labels``."""
    lexicon = learn_lexicon(docs, labels, max_labelled)
    whole = [w for w in sorted(lexicon) if not w.endswith("*")]
    model = language_model(count_characters(docs), whole)
    shared, name = docs.sparkSession.sparkContext.broadcast((lexicon, model)), uuid.uuid4().hex

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        steady()
        scorer = held(("toxicity", name), lambda: Scorer(*shared.value))
        for s in batches:
            yield pd.Series([scorer.score(t) for t in s], dtype="float64")
        s = None
        tidy()

    return score(F.col(text).cast("string"))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, toxicity, toxic), one row for each row of ``docs``.

    Null and empty texts score 0. Labels without an id or outcome are left out; a document with
    several labels is toxic if one says so. Without labels of both outcomes nothing is toxic.
    Repeated rows and null ids keep their rows; an empty table gives none; further columns are ignored.
    """
    rows = pick(docs, "doc_id", "text")
    column = toxicity_column(docs, labels, max_labelled)
    return rows.select("doc_id", column.alias("toxicity")).withColumn("toxic", F.col("toxicity") >= threshold)
