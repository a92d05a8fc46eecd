from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skeinlog.llm import defects as D
from skeinlog.llm import defects_training as T

#: Questions and sound answers that occur in no training list.
SOUND = [
    ("Which port does the metrics endpoint listen on?", "It listens on 9100 unless METRICS_PORT says otherwise. Behind the proxy the path is /metrics."),
    ("How can I make the import skip blank lines?", "Pass skip_blank=True to the reader. Blank lines are then counted but not stored."),
    ("Can we delete the legacy exporter?", "Yes, nothing has called it since March. I would remove it together with its cron entry."),
    ("How large may an upload get?", "Uploads of up to 50 MB pass. Larger ones are answered with status 413."),
    ("Show me a query for the ten longest sessions.", "This gives the ten longest:\n\n```sql\nselect id from sessions order by length desc limit 10;\n```"),
    ("Wo finde ich die Protokolle des Dienstes?", "Sie liegen unter /var/log/dienst. Ältere Dateien werden nach sieben Tagen gepackt."),
    ("Comment vider la file d'attente ?", "Lance la commande purge avec le nom de la file. Les messages déjà lus ne sont pas touchés."),
    ("¿Qué hace el segundo parámetro?", "Indica cuántas veces se repite la llamada antes de darse por vencida. El valor normal es tres."),
    ("Is retry safe here?", "No, the write is not idempotent. Use the token from the first call instead."),
    ("Why is the tooltip empty?", "The label is read before the data arrives. Moving the call into the effect fixes it."),
]
#: Refusals that occur in no training list and share no whole sentence with its grammars.
REFUSED = [
    "I must respectfully decline to provide that information.", "Sorry, but helping with something like this is not something I am willing to do.", "I'm unable to assist you with that particular request.", "I can't provide instructions for that.", "As an AI model I cannot engage with this topic.",
    "I'm not comfortable answering this question.", "I won't be able to help you with this one.", "Unfortunately I am not permitted to discuss such matters.", "I have to decline this request, as it violates the usage policies.", "My apologies, but I can't go along with what you are asking me to do.",
    "Leider darf ich bei diesem Anliegen nicht behilflich sein.", "Es tut mir leid, aber diese Bitte muss ich ablehnen.", "Je suis désolé, je ne peux pas vous aider dans cette démarche.", "Lo siento, pero no puedo ayudarte con este asunto.",
]
TRUNCATED = [
    "It listens on 9100 unless METRICS_PORT says oth", "Pass skip_blank=True to the reader. Blank lines are then counted but", "Uploads of up to 50 MB pass. Larger ones are", "This gives the ten longest:\n\n```sql\nselect id from sess", "There are three causes:\n1. The cache is cold.\n2. The index is missing.\n3.",
    "Sie liegen unter /var/log/dienst. Ältere Dateien werden nach", "Lance la commande purge avec le nom de la", "Indica cuántas veces se repite la llamada antes de", "Remove it together with its cron entry, then restart the", "The label is read before the data arrives. Moving the call into the eff",
]


@pytest.fixture(scope="module")
def model():
    return D.model_at()


def test_unseen_vocabulary(model):
    text = " ".join(T.FLAT["en"] + T.HARMLESS + T.SHORT)
    assert not any(x in text for x in REFUSED + [a for _, a in SOUND])
    rows = [(q, a, None) for q, a in SOUND]
    rows += [(SOUND[k % 5][0], a, "refusal") for k, a in enumerate(REFUSED[:10])] + [(SOUND[k][0], a, "refusal") for k, a in zip((5, 5, 6, 7), REFUSED[10:], strict=True)]
    rows += [(SOUND[k][0], a, "truncated") for k, a in zip((0, 1, 3, 4, 2, 5, 6, 7, 2, 9), TRUNCATED, strict=True)]
    rows += [(q, f, "copy") for q, _ in SOUND for f in (q, f"> {q}", q.upper())]
    rows += [(q, SOUND[k][1], "language") for q, k in ((SOUND[0][0], 5), (SOUND[1][0], 6), (SOUND[3][0], 7), (SOUND[5][0], 0), (SOUND[6][0], 1), (SOUND[7][0], 5), (SOUND[8][0], 6))]
    rows += [(q + " " + ask, SOUND[k][1], None) for q, ask, k in ((SOUND[0][0], "Please answer in German.", 5), (SOUND[1][0], "Reply in French please", 6), (SOUND[3][0], "I need it in Spanish.", 7))]
    found = model.decide([(q, a) for q, a, _ in rows])
    wrong = [(w, f, a) for f, (_, a, w) in zip(found, rows, strict=True) if f != w]
    hit = sum(f == w for f, (*_, w) in zip(found, rows, strict=True) if w)
    given, wanted = sum(f is not None for f in found), sum(w is not None for *_, w in rows)
    print(f"recall {hit / wanted:.3f} precision {hit / given:.3f} of {wanted}", *wrong, sep="\n")
    assert hit / wanted >= 0.9 and hit / given >= 0.9


def test_held_out_synthesis(model):
    rows = T.synthesize(random.Random(9), SOUND * 5, [(k, k) for k in ["en"] * 5 + ["de", "fr", "es"] + ["en"] * 2] * 5)
    found = model.decide([p for p, *_ in rows])
    right = sum((d is None and want < 0) or (want >= 0 and d == D.DEFECTS[want]) for d, (_, want, _) in zip(found, rows, strict=True))
    assert right / len(rows) > 0.85


def test_batches_do_not_matter(model):
    pairs = [*SOUND, ("", ""), ("q", "\u200b \n"), (None, None), ("", "x"), ("x", "abc"), ("long", "The value is read twice. " * 3000)]
    assert model.decide(pairs) == [model.decide([p])[0] for p in pairs] and model.decide([]) == []
    assert model.decide([("q", ""), ("q", "​ \n"), (None, None)]) == ["empty"] * 3
    assert D.visible("x") and not D.visible("\ufeff \t")


def test_query_shapes(spark):
    rows = [(f"r{k}", q, a) for k, (q, a) in enumerate(SOUND)] + [("e1", "What?", None), ("e1", "What?", None), ("e2", None, "   "), (None, "q", "a"), ("big", "Why does it fail?", "The label is read before the data arrives. " * 800)]
    df = spark.createDataFrame(rows, "request_id string, question string, answer string").withColumn("defect", F.lit(1))
    found = [(r["request_id"], r["defect"]) for r in D.defective_pairs(df).collect()]
    got = dict(found)
    assert len(found) == len(got) and got["e1"] == "empty" and got["e2"] == "empty" and "big" not in got and None not in got
    assert D.defective_pairs(df.limit(0)).count() == 0


def test_versions_of_one_id_stay_pairs(spark):
    rows = [("a", *SOUND[0]), ("a", *SOUND[5])]
    df = spark.createDataFrame(rows, "request_id string, question string, answer string")
    assert D.defective_pairs(df).count() == 0


def test_answer_text(spark):
    df = spark.sql("select array(named_struct('kind', null, 'value', 'a', 'content', named_struct('value', 'no')), null, named_struct('kind', 'markdownContent', 'value', 'no', 'content', named_struct('value', 'b')), named_struct('kind', 'progressMessage', 'value', 'no', 'content', null)) as r")
    assert df.select(D.answer_text(F.col("r")).alias("t")).first()["t"] == "ab"
