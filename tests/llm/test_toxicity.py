from __future__ import annotations

import random
import zlib

import pytest

from rowgate.llm.toxicity import (
    COMPOSED,
    THREATS,
    Grammar,
    Model,
    classes_of,
    clauses,
    drop_toxic,
    fit,
    held_out,
    op6_toxicity,
    score,
)

SF_DIR = "/root/testdata/sf0.1"
STEMS = {"moron": 2.0, "vequ": 1.5}


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        (None, []),
        ("", []),
        ("a fine day", []),
        ("what a moron", [0]),
        ("you are a moron. all is well", [1]),
        ("he is not a moron", [2]),
        ("no, they are many times over a moron", [0]),
        ("she said that moron left", [3]),
        ('they shouted "moron" then', [3]),
        ("morons and vequa", [0, 0]),
        ("i will kill you", [4]),
        ("kill the lights", []),
        ("she said i will kill you", []),
        ("moro vequ", [0]),
        ("i will beat him", [4]),
        ("i'll never hurt you", []),
        ("you should beat the eggs until they are stiff", []),
        ("going to shoot your wedding photos", []),
        ("you will beat them in the finals", []),
        ("you must destroy the old key after use", []),
        ("your moron costume", [0]),
        ("the moron spoke and all of the others listened to you", [0]),
    ],
)
def test_grammar(text, kinds):
    grammar = Grammar(STEMS)
    assert [k for c in clauses(text) for k, _ in grammar.match(c)] == kinds


def paths(transducer, word_classes):
    """All outputs of a transducer along a clause, by trying every class of every word as an arc, the first that has one."""
    state, out = transducer.start, []
    for classes in word_classes:
        arcs = [transducer.arcs[state, c] for c in classes if (state, c) in transducer.arcs] or [transducer.default[state]]
        state, given = arcs[0]
        out.append(given)
    return out


@pytest.mark.parametrize("seed", range(20))
def test_composition_equals_its_parts(seed):
    """The product machine against each transducer by itself, on random clauses."""
    rng = random.Random(seed)
    words = ["moron", "vequs", "you", "your", "him", "not", "said", '"', "will", "kill", "beat", "the", "old", "key", "je", "dich"]
    grammar = Grammar(STEMS)
    for _ in range(500):
        clause = [rng.choice(words) for _ in range(rng.randint(1, 12))]
        classes = [classes_of(w) for w in clause]
        speech, negated, target, threat = (paths(t, classes) for t in COMPOSED)
        expected = []
        for i, word in enumerate(clause):
            if weight := grammar.weight(word):
                near = target[i] or clause[i + 1 : i + 2] and "target" in classes[i + 1]
                expected.append((3 if speech[i] else 2 if negated[i] else 1 if near else 0, weight))
        expected += [(4, t) for t, s, n in zip(threat, speech, negated) if t and not s and not n]
        assert grammar.match(clause) == expected


def test_threats_by_their_definition():
    """A modal, a verb of harm and a person, none further than three words behind the one before, looked for one by one."""
    rng = random.Random(1)
    words = ["will", "must", "kill", "hurt", "him", "them", "the", "old", "a"]
    for _ in range(3000):
        clause = [rng.choice(words) for _ in range(rng.randint(1, 9))]
        kinds = [classes_of(w) for w in clause]
        found = paths(THREATS, kinds)
        for i, given in enumerate(found):
            if given:
                assert "person" in kinds[i]
                assert any("harm" in kinds[h] and any("modal" in kinds[m] for m in range(max(0, h - 3), h)) for h in range(max(0, i - 3), i))
    assert paths(THREATS, [classes_of(w) for w in "we will have to hurt the old them".split()])[-1] == 1.0
    assert paths(THREATS, [classes_of(w) for w in "we will have to be so hurt by them".split()])[-1] is None


@pytest.fixture(scope="module")
def fitted(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))


def test_ordinary_sentences(spark, fitted):
    """Harm to things, and learned words in other senses, are not toxic; no word decides alone."""
    texts = [
        "You should beat the eggs until they are stiff.",
        "We are going to shoot your wedding photos.",
        "you will beat them in the finals",
        "You must destroy the old key after use",
        "The clown took out the trash.",
        "A clown performs at the party. You are invited.",
        *(f"It was the {stem}." for stem in fitted.stems),
        *(f"{stem} {stem} {stem}" for stem in fitted.stems),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [r.text for r in score(docs, fitted).collect() if r.score >= 0.5] == []
    threat = spark.createDataFrame([(1, "I will murder you.")], "doc_id bigint, text string")
    assert score(threat, fitted).first().score >= 0.5


def test_held_out(spark):
    ids = [*range(50), -3, None]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id bigint").select("doc_id", held_out("doc_id").alias("h"))
    assert {r.doc_id: r.h for r in df.collect()} == {i: i is None or zlib.crc32(str(i).encode()) % 5 == 0 for i in ids}


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rows = op6_toxicity(spark, SF_DIR).filter("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    toxic = [r for r in rows if r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic) > 0
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.005 * len(rows)


def test_odd_rows(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    texts = [f"{words[i % 12]} {words[i // 12 % 12]} {words[i * 7 % 11]} n{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = [(i, f"{t} you moron" if i % 3 == 0 else t) for i, t in enumerate(texts)]
    odd = [(1000, None), (1001, ""), (None, "you moron"), (0, rows[0][1]), (1002, "x " * 200_000)]
    docs = spark.createDataFrame(rows + odd, "doc_id bigint, text string").selectExpr("*", "1 AS toxic", "'a' AS source")
    marks = [(i, int(i % 3 == 0)) for i in range(300)] + [(5, None), (77_777, 1), (None, 1)]
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int")
    model = fit(docs, labels)
    assert "moron" in model.stems
    scored = score(docs, model).collect()
    assert len(scored) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in scored)
    assert all((r.score >= 0.5) == ("moron" in (r.text or "")) for r in scored)
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([i for i in range(300) if i % 3] + [1000, 1001, 1002])
    assert score(docs.limit(0), model).count() == 0
    assert fit(docs, labels.limit(0)) == Model() == fit(docs, labels.filter("toxic = 1"))
    with pytest.raises(ValueError):
        score(docs, model, "source")


def test_threats_count_without_learned_stems(spark):
    docs = spark.createDataFrame([(1, "i will kill you"), (2, "a fine day")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int")
    for marks in (labels.limit(0), labels):
        assert [r.score >= 0.5 for r in score(docs, fit(docs, marks)).orderBy("doc_id").collect()] == [True, False]
    assert [r.doc_id for r in drop_toxic(docs, labels.limit(0)).collect()] == [2]


@pytest.mark.parametrize(("size", "least"), [("sf0.001", {"en": 4}), ("sf0.01", {"en": 33})])
def test_few_labels(spark, size, least):
    """Toxic labelled documents found per language; nearly no clean one."""
    folder = f"/root/testdata/{size}"
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter("toxic IS NOT NULL")
    langs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = op6_toxicity(spark, folder).join(labels, "doc_id").join(langs, "doc_id").select("predicted", "toxic", "lang", "held_out").collect()
    for lang, count in least.items():
        assert sum(r.predicted for r in rows if r.toxic and r.lang == lang) >= count
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.01 * len(rows)
