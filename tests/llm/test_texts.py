import pytest
from pyspark.sql import functions as F

from loomery.llm import language, pii, pii_training, replies

SENTENCES = {
    "en": ["The weekly report replaces the old index for every customer.", "Please look at the shipping queue before lunch.", "This team cannot change the limit without the owner."],
    "de": ["Die Übersicht der Rechnungen ersetzt die Vorlage der Kunden.", "Bitte prüfen Sie die Lieferung vor dem Mittag.", "Das Fenster der Meldungen begrenzt die Suche während der Nacht."],
    "fr": ["Le tableau des factures remplace la règle des utilisateurs.", "Veuillez vérifier la livraison avant midi.", "La fenêtre des alertes limite la recherche pendant la nuit."],
    "es": ["La plantilla de las facturas reemplaza la norma de los usuarios.", "Revise el envío antes del mediodía por favor.", "La ventana de los avisos limita la búsqueda durante la noche."],
}


@pytest.fixture(scope="module")
def model():
    texts = [(s, lang) for lang, all_ in SENTENCES.items() for s in all_ for _ in range(8)]
    return language.fit([t for t, _ in texts], [lang for _, lang in texts], epochs=40)


def test_sentences():
    text = "user: One two three four. Five six seven!\n```\ncode here is one two.\n```\n{\"a\": 1}\n- [fact] a.b: Drei vier fünf sechs."
    assert [text[a:b] for a, b in language.sentences(text)] == ["One two three four.", "Five six seven!", "Drei vier fünf sechs."]


def test_languages(spark, model):
    mixed = " ".join(SENTENCES["en"] + SENTENCES["de"][:2])
    rows = [(0, SENTENCES["fr"][0]), (1, mixed), (2, None), (3, ""), (4, "12345 !!"), (5, SENTENCES["es"][1] * 300), (0, SENTENCES["fr"][0])]
    got = {r.id: r for r in language.detect(spark.createDataFrame([(i, t, "x") for i, t in rows], "id int, text string, main string"), "text", model).collect()}
    assert got[0].main == "fr" and got[1].main == "en" and sorted(got[1].mixed) == ["de", "en"] and got[5].main == "es"
    assert [got[i].main for i in (2, 3, 4)] == [None] * 3 and got[2].confidence == 0 and got[3].segments == []
    assert [s.lang for s in got[1].segments] == ["en", "de"] and mixed[got[1].segments[1].start_pos - 1 :].startswith(SENTENCES["de"][0])


def test_unknown_languages_are_rejected(spark):
    import random

    rng = random.Random(1)
    words = {lang: [w for x in all_ for w in x.rstrip(".").split()] for lang, all_ in SENTENCES.items()}
    texts = [(" ".join(rng.sample(words[lang], 8)), lang) for lang in words for _ in range(60)]
    model = language.fit([t for t, _ in texts], [lang for _, lang in texts], epochs=8)
    assert model.least_seen > 0.5
    rows = [(0, "Zítřek přijde každý čtvrtek žlutý kůň. Příliš žluťoučký kůň úpěl ďábelské ódy."), (1, SENTENCES["en"][0] + " " + SENTENCES["en"][1])]
    got = {r.id: r for r in language.detect(spark.createDataFrame(rows, "id int, text string"), "text", model).collect()}
    assert got[0].main is None and got[0].confidence == 0 and got[0].segments[0].lang is None and got[1].main == "en"


def test_labels(spark):
    labels = ["en", "English", " de-AT", "fr_FR", "??", "", None, "und", "spa", "Klingon"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, x string").orderBy("i").select(language.label_language(F.col("x"))).collect()
    assert [r[0] for r in got] == ["en", "en", "de", "fr", None, None, None, None, "es", "other"]


def test_replies(spark, model):
    q = "Which limits apply to the weekly report queue?"
    sentence = "The weekly report replaces the old index for every customer."
    rows = [(f"g{i}", 1, q, sentence) for i in range(8)] + [
        ("empty", 0, q, None), ("blank", 0, q, " \n"), ("filler", 0, q, "N/A"), ("copy", 0, q, "which limits apply to the weekly report queue"), ("answered", 0, q, f"{q}\n{sentence}"),
        ("refusal", 0, q, "I'm sorry, but I can't help with that."), ("german", 0, q, " ".join(SENTENCES["de"])), ("asked", 0, f"Answer in German: {q}", " ".join(SENTENCES["de"])),
        ("cut", 0, q, "The weekly report replaces the old index for every cust"), ("cut2", 0, q, "The weekly report replaces the"), ("open", 0, q, "It works.\n```json\n{\"a\": [1, "), ("nostop", 0, q, sentence[:-1]),
        ("no", 0, q, "No, it cannot be changed."), ("noquestion", 0, None, sentence), ("cut2", 0, q, "The weekly report replaces the"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "case_id string, trial int, question string, answer string, key string")
    got = {r.case_id: r.defect for r in replies.defects(df, ["case_id", "trial"], "question", "answer", model).collect()}
    assert got == {"empty": "empty", "blank": "empty", "filler": "empty", "copy": "copy", "refusal": "refusal", "german": "other_language", "cut": "truncated", "cut2": "truncated", "open": "truncated"}
    assert replies.defects(df.limit(0), ["case_id", "trial"], "question", "answer", model).count() == 0


def test_copies_of_a_reply_are_judged_like_one(spark, model):
    good = ["The weekly report replaces the old index for every customer.", *(f"The report {a}{b} replaces the plan of the team." for a in "mnprst" for b in "aeiou")]
    cut = ["The weekly report replaces the", "It works with the list (see the", "It works for the team,", "It works.\n```json\n{\"a\": [1"]
    german = "Das Fenster der Meldungen begrenzt die Suche."
    rows = [(f"g{i}", "Which limits apply to the weekly report queue?", t) for i, t in enumerate(good)]
    rows += [(f"c{k}-{n}", f"Which limits apply to the weekly report number {k}?", t) for n, t in enumerate(cut) for k in range(6)]
    rows += [(f"d{k}", f"Which limits apply to the weekly report number {k}?", german) for k in range(6)]
    df = spark.createDataFrame([(i, 0, q, t) for i, q, t in rows], "case_id string, trial int, question string, answer string")
    got = {r.case_id: r.defect for r in replies.defects(df, ["case_id", "trial"], "question", "answer", model).collect()}
    assert got == {f"c{k}-{n}": "truncated" for n in range(4) for k in range(6)} | {f"d{k}": "other_language" for k in range(6)}


def test_longer_versions_and_length_spikes_decide(spark):
    whole = [f"The team {a}{b} replaces the plan of the queue." for a in "mnprst" for b in "aeiou"] + [f"{a}{b} has a Queue." for a in "mnprst" for b in "aeiou"]
    cut = ["Every limit of this Queue", "Ask for the Queue", "Every key of this Queu"]
    longer = ["Every limit of this Queue applies to the team.", "Ask for the Queue in May.", "Every key of this Queue"]
    whole += [f"The plan {a}{b} has no Queue and no limits for the Team {'x' * k}." for a in "mnprst" for b in "aeiou" for k in (1,)]
    spikes = [f"The plan {a}{b}{c} holds for every team with the old index and the Queue" for a in "mnprst" for b in "aeiou" for c in "kl"]
    rows = [(t, 1, 1) for t in whole + longer + spikes] + [(t, k, 1) for k, t in enumerate(cut, start=1)]
    got = {r.text for r in replies._stops(spark.createDataFrame(rows, "text string, copies int, said int")).where("truncated").collect()}
    assert got == set(cut) | set(spikes)


@pytest.fixture(scope="module")
def field():
    return pii.train(count=1500, epochs=8)


HELD_OUT = [  # neither these sentences nor these names are in the training grammar
    ("Our neighbour [N:Gertrud Ollenbach] waters the plants.", ""),
    ("The lease was signed by [N:Tomislav Perkovac] last autumn.", ""),
    ("Ask [N:Wilhelmina Strand] or [N:Oleander Finch] for the spare keys.", ""),
    ("Postcards reach us at [A:17 Quince Street, Millbrook 20931].", ""),
    ("Wir wohnen jetzt in der [A:Tannenstraße 12, 80331 Oberau].", ""),
    ("You will find the shop at [A:9 Cobble Lane, Eastham].", ""),
    ("Drop a line to [E:w.strand@brieftaube.test] or dial [P:+44 7911 204455].", ""),
    ("Her pager is [P:(415) 662-9034], her passport [I:K40772519].", ""),
    ("My identity card number is [I:48213377-P].", ""),
    ("The witness gave the social security number [I:512-44-9087].", ""),
    ("Please phone [P:020 7946 0122] first.", ""),
    ("Send the minutes to [E:oleander_finch@kanzlei.test].", ""),
    ("Version 3.14.159 fixes row 271828.", ""), ("The weekly report replaces the old index for every customer.", ""), ("Das Fenster der Meldungen begrenzt die Suche während der Nacht.", ""),
]


def test_details_in_sentences_never_trained_on(field):
    import re

    texts, want = [], set()
    for i, (marked, _) in enumerate(HELD_OUT):
        text = ""
        for part in re.split(r"(\[\w:[^\]]+\])", marked):
            if part.startswith("["):
                want.add((i, len(text), part[1]))
                part = part[3:-1]
            text += part
        texts.append(text)
    have = {(i, a, k) for i, spans in enumerate(pii.find(field, texts)) for a, _, k, _ in spans}
    assert len(want & have) >= 0.8 * len(want) and len(have - want) <= 3, (sorted(want - have), sorted(have - want))


def test_personal_details_of_other_documents_of_the_grammar(field):
    documents = pii_training.documents(300, 77)
    found = pii.find(field, [t for t, _ in documents])
    want = {(i, a, k) for i, (_, spans) in enumerate(documents) for a, _, k in spans}
    have = {(i, a, k) for i, spans in enumerate(found) for a, _, k, _ in spans}
    assert len(want & have) >= 0.85 * len(want) and len(have - want) <= 0.15 * len(have), (len(want & have) / len(want), len(have - want) / len(have))


def test_redaction(spark, field):
    long = "nothing here. " * 5000 + "Write to anna.berg@mail.example first."
    rows = [(0, "My name is Anna Berg and I still wait for a reply."), (1, None), (2, ""), (3, long), (4, "Invoice 2884-14-8980 was paid."), (0, "My name is Anna Berg and I still wait for a reply.")]
    out = pii.redact(spark.createDataFrame([(i, t, "x") for i, t in rows], "id int, content string, pii string"), "content", field).collect()
    got = {r.id: r for r in out}
    assert len(out) == 6 and got[0].redacted == "My name is [NAME] and I still wait for a reply." and got[0].pii[0].start_pos == 12
    assert got[1].redacted is None and got[1].pii == [] and got[2].redacted == "" and got[4].redacted == rows[4][1]
    assert got[3].redacted.endswith("Write to [EMAIL] first.") and got[3].pii[0].start_pos == long.index("anna") + 1


def test_details_without_a_listed_cue(spark, field):
    texts = ["12 Old Mill Road, Ashton", "Thanks,\nTobias Kellner", "Tax number QQ 38 80 91 C belongs to the same account holder."]
    got = {r.content: [d.pii_type for d in r.pii] for r in pii.redact(spark.createDataFrame([(t,) for t in texts], "content string"), "content", field).collect()}
    assert [got[t] for t in texts] == [["address"], ["name"], ["id_number"]]
