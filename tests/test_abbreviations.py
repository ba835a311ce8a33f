"""Abbreviations learnt from small corpora in four languages, and sentences marked by hand."""

import math
import random

from docloom.functions.sentences import split_sentences
from docloom.operators import abbreviations as ab

#: By language: abbreviations with words that follow them, and plain words.
LANGUAGES = {
    "en": ({"approx.": "Ten", "govt.": "Offices", "u.s.": "Army", "capt.": "Miller"}, "the ship left harbour with many people on board and nobody knew when it would come back home".split()),
    "de": ({"bzw.": "Kinder", "z.b.": "Hamburg", "str.": "Nummer", "geb.": "Schmidt"}, "der zug fuhr am morgen durch das tal und alle leute sahen aus dem fenster auf den fluss".split()),
    "fr": ({"av.": "Foch", "env.": "Trente", "m.": "Dupont", "chap.": "Deux"}, "le train passe chaque matin devant la maison et les enfants regardent par la fenetre ouverte".split()),
    "es": ({"sra.": "Lopez", "avda.": "Central", "ee.uu.": "Hoy", "tel.": "Madrid"}, "el barco sale temprano del puerto con mucha gente y nadie sabe cuando vuelve a casa".split()),
}

#: Texts with their sentences, marked by hand.
MARKED = [
    ["The ship took approx. Ten days.", "The U.S. Army waited on board.", "Nobody knew Capt. Miller."],
    ["Alle Leute sahen z.B. Hamburg am Morgen.", "Der Zug fuhr bzw. Kinder sahen ihn.", "Frau Weiss, geb. Schmidt, war in der Elbe Str. Nummer vier."],
    ["Le train passe devant l'av. Foch.", "Les enfants regardent M. Dupont.", "Le livre a env. Trente pages, voir chap. Deux."],
    ["La Sra. Lopez sale temprano.", "Nadie vuelve de EE.UU. Hoy sale el barco a casa.", "El Tel. Madrid no sirve."],
]


def corpus(seed=1, each=220):
    draw = random.Random(seed)
    out = []
    for short, words in LANGUAGES.values():
        for _ in range(each):
            chosen = [draw.choice(words) for _ in range(9)]
            name = draw.choice(list(short))
            chosen[4:4] = [name, short[name]]
            out.append(" ".join(chosen).capitalize() + ".")
    draw.shuffle(out)
    return out


def test_four_languages(spark):
    """All abbreviations and no other word are learnt, without a word of what language a text is in."""
    docs = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    known = ab.learnt(ab.abbreviations(docs))
    truth = {a.rstrip(".") for short, _ in LANGUAGES.values() for a in short}
    assert known == truth
    for sentences in MARKED:
        assert [t for _, _, t in split_sentences(" ".join(sentences), frozenset(known))] == sentences
    assert sum([t for _, _, t in split_sentences(" ".join(s))] == s for s in MARKED) < 2  # the list alone doesn't know them


def test_scores_by_hand(spark):
    rows = [(1, "Cf. Abel. cf. Kain und Abel und Kain."), (2, "Cf. die Karte. Die karte."), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = {r["word"]: (r["dotted"], r["plain"]) for r in ab.word_counts(docs).collect()}
    assert counts == {"cf": (3, 0), "abel": (1, 1), "kain": (1, 1), "und": (0, 2), "die": (0, 2), "karte": (2, 0)}
    p = 7 / 13
    score = 2 * 3 * (math.log(0.99) - math.log(p)) * math.exp(-2)
    found = {r["word"]: r["score"] for r in ab.abbreviations(docs).collect()}
    assert found == {"cf": round(score, 6)}
    assert ab.learnt(ab.abbreviations(docs), 0) == frozenset()


def test_nothing_to_learn_from(spark):
    for rows in ([], [(1, None)], [(1, "no dots here")], [(1, "All. Words. Dotted.")]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        assert ab.abbreviations(docs).collect() == []
        assert [r["text"] for r in ab.sentence_rows(docs).collect()] == [t for _, x in rows for _, _, t in split_sentences(x or "")]


def test_sentences_of_documents(spark):
    texts = corpus(2) + [" ".join(s) for s in MARKED]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in ab.sentence_rows(docs).collect():
        assert texts[r["doc_id"]][r["start"] : r["end"]] == r["text"]
        got.setdefault(r["doc_id"], []).append((r["n"], r["text"]))
    for i, sentences in enumerate(MARKED, len(texts) - len(MARKED)):
        assert [t for _, t in sorted(got[i])] == sentences
    assert all(len(got[i]) == 1 for i in range(len(texts) - len(MARKED)))
