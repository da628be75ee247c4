import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hybridkb.llm import toxicity as tx

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"
BAD = ["grimple", "scrovel", "blatwort"]
rng = random.Random(8)
WORDS = ["".join(rng.choice(["ta", "re", "lo", "mi", "an", "or"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]


def corpus(n=400):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(WORDS) for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            words[r.randrange(60)] = r.choice(BAD)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_viterbi_is_the_best_path():
    """Against the score of every path of the lattice."""
    counts = np.zeros(tx.SIZE**3)
    for w in ["loser", "lesser", "tools", "stool"] * 5:
        counts += tx.trigram_counts(w, tx.code_table())
    model = tx.language_model(counts)
    d = tx.Decoder(model)

    def best(token):
        options = []
        for i, c in enumerate(token):
            options.append([(x, s, False) for x, s in d.arcs(c)] + ([(None, tx.REPEAT_COST, True)] if i and token[i - 1] == c else []))
        top = None
        for path in itertools.product(*options):
            a = b = 0
            score, out = 0.0, ""
            for x, s, again in path:
                score += s
                if x and not again:
                    k = tx.CODES.get(x, tx.OTHER_CODE)
                    score += model[(a * tx.SIZE + b) * tx.SIZE + k]
                    a, b, out = b, k, out + x
            score += model[(a * tx.SIZE + b) * tx.SIZE]
            if top is None or score > top[0]:
                top = (score, out)
        return top

    for token in ["l0s3r", "looser", "s+00ls", "l*ser", "t-o-o-l", "5t001", "!l", "aab"]:
        want = best(token)
        got = d.decode(token)
        assert got == want[1] or math.isclose(best(token)[0], want[0])


def test_trigram_counts_by_hand():
    n = tx.trigram_counts("ab b", tx.code_table()).reshape(tx.SIZE, tx.SIZE, tx.SIZE)
    a, b = tx.CODES["a"], tx.CODES["b"]
    assert n[0, 0, a] == 1 and n[0, a, b] == 1 and n[a, b, 0] == 1 and n[0, 0, b] == 1 and n[0, b, 0] == 1 and n.sum() == 5


@pytest.fixture(scope="module")
def scorer(spark):
    docs, labels = corpus()
    docs, labels = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    lexicon = tx.learn_lexicon(docs, labels)
    return tx.Scorer(lexicon, tx.language_model(tx.count_characters(docs), [w for w in sorted(lexicon) if w[-1] != "*"]))


def test_lexicon_holds_the_planted_words_alone(scorer):
    assert {w for w in scorer.lexicon if w[-1] != "*"} == set(BAD)


@pytest.mark.parametrize("form", ["grimple", "GRIMPLE!", "gr1mple", "gr!mp1e", "g r i m p l e", "g.r.i.m.p.l.e", "g-r-i-m-p-l-e", "griiimmple", "scr0v3l", "$crovel", "bl@twor7,", "sc*ovel"[:2] + "rov*l"])
def test_disguises_are_seen_through(scorer, form):
    assert scorer.score(f"tare lomi {form} anor") >= tx.THRESHOLD


@pytest.mark.parametrize("text", ["tare lomi anor", "", None, "12345 67", "a a a a a a a", "re+mi $$$ 0-0 !!!", "***"])
def test_clean_text_stays_clean(scorer, text):
    assert scorer.score(text) == 0.0


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame(docs, DOCS)
    half = spark.createDataFrame([x for x in labels if x[0] % 8 < 4 or x[0] % 3], LABELS)
    got = {r.doc_id: r.toxic for r in tx.score_documents(frame, half).collect()}
    assert all(got[i] == (i % 4 == 0) for i, _ in docs)


def test_odd_rows(spark):
    docs, labels = corpus()
    docs += [(None, "grimple"), (900, None), (901, ""), (0, docs[0][1]), (902, "mita " * 100000 + "scr0vel"), (903, None)]
    labels += [(None, 1, 1), (901, None, None), (1, None, None), (2, 0, 0), (2, 0, 0), (5000, 1, 1)]
    frame, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    clash = frame.withColumns({"toxic": F.lit(1), "toxicity": F.lit(0.3), "sketch": F.lit("x")})
    got = tx.score_documents(clash, marks).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r.toxic for r in got}
    assert by[None] and by[902] and not by[900] and not by[901]
    assert tx.score_documents(frame, marks.limit(0)).where("toxic").count() == 0
    assert tx.score_documents(frame.limit(0), marks).count() == 0


def test_copies_teach_once():
    a, b = list(range(8)), [0, 1, 2, 3, 4, 5, 90, 91]
    assert tx.drop_copies([(1, a), (2, a), (3, b), (4, [99] * 8)]) == [1, 4]


ENDINGS = [a + b for a in ("ta", "re", "lo", "mi", "an", "or", "") for b in ("ser", "nu", "dil", "pe", "gam", "ho")]
INFLECTED = {"x": "blunst", "y": "kveldra"}


def inflected(n=1200):
    """Toxic documents hold three forms of their language's stem, none common; many clean ones hold one."""
    r = random.Random(6)
    docs, labels = [], []
    for i in range(n):
        lang, bad = "xy"[i % 2], i % 8 < 2
        words = [r.choice(WORDS) for _ in range(60)]
        for e in r.sample(ENDINGS, 3 if bad else r.random() < 0.3):
            words[r.randrange(60)] = INFLECTED[lang] + e
        docs.append((i, " ".join(words), lang))
        labels.append((i, 1, int(bad)))
    return docs, labels


@pytest.fixture(scope="module")
def inflected_scorer(spark):
    """Fitted on the first half."""
    docs, labels = inflected()
    frame = spark.createDataFrame(docs, DOCS + ", lang string")
    lexicon = tx.learn_lexicon(frame, spark.createDataFrame(labels[:600], LABELS))
    return tx.Scorer(lexicon, tx.language_model(tx.count_characters(frame), [w for w in sorted(lexicon) if w[-1] != "*"]))


@pytest.mark.parametrize("lang", ["x", "y"])
def test_forms_of_a_stem_add_up(inflected_scorer, lang):
    """Held-out recall and precision of a language whose toxic words are inflected."""
    docs, labels = inflected()
    got = {bad: [inflected_scorer.score(t) >= tx.THRESHOLD for (_, t, g), (_, _, y) in zip(docs[600:], labels[600:]) if g == lang and y == bad] for bad in (0, 1)}
    assert np.mean(got[1]) >= 0.9 and np.mean(got[0]) <= 0.02


def test_surprise_is_the_poisson_tail():
    for k, mean in ((1, 0.01), (3, 0.5), (9, 2.0)):
        below = sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(k))
        assert math.isclose(tx.surprise(k, mean), -math.log(1 - below), rel_tol=1e-6)
    assert tx.surprise(2, 5.0) == 0.0


def test_stems_need_more_than_a_word_admitted(scorer):
    """And no stem rides in on a whole word."""
    assert set(scorer.lexicon) == set(BAD)
    assert scorer.score("tare grimpen blatter scrovan lomi") == 0.0


def test_one_ordinary_form_does_not_reject():
    """A form that chance put into toxic documents alone is judged with its stem, and by length."""
    toxic = {i: int(i < 30) for i in range(330)}
    places = {(i, "blunst" + e): 1 for i in range(30) for e in ("ta", "re", "lo")} | {(i, "blunst" + "mi"): 1 for i in range(30, 90)}
    rates = {"blunstta": 1e-6, "blunst*": 60 / 30000}
    got = tx.choose(tx.Evidence(toxic, dict.fromkeys(toxic, 100), places, rates))
    assert set(got) == {"blunst*"}
    stem = tx.Scorer({"blunst*": (*got["blunst*"], rates["blunst*"])}, np.zeros(tx.SIZE**3))
    assert stem.score("tare " * 97 + "blunstta blunstre blunstlo") >= tx.THRESHOLD
    assert stem.score("tare " * 99 + "blunstta") == 0.0
    assert stem.score("tare " * 2997 + "blunstta blunstre blunstlo") == 0.0, "three forms are no surprise in a long text"


@pytest.mark.parametrize("lang", ["x", "y"])
@pytest.mark.parametrize("size", [1, 20])
def test_clean_documents_of_any_length_stay(inflected_scorer, lang, size):
    """Held-out clean documents, alone and twenty of a language joined."""
    docs, labels = inflected()
    clean = [t for (_, t, g), (_, _, y) in zip(docs[600:], labels[600:]) if g == lang and not y]
    texts = [" ".join(clean[i : i + size]) for i in range(0, len(clean), size)]
    assert np.mean([inflected_scorer.score(t) >= tx.THRESHOLD for t in texts]) <= 0.02
