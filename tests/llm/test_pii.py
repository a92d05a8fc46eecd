from __future__ import annotations

import numpy as np

from skeinlog.llm import pii, pii_training


def test_items_in_made_texts():
    maker = pii_training.Maker(77, ["please run the tests again", "Nobody noticed because make hides warnings."])
    made = [maker.text() for _ in range(400)]
    right = wrong = missed = 0
    for (text, tags), found in zip(made, pii.find_items([t for t, _ in made]), strict=True):
        want = pii.items(text, np.array(tags, np.int8))
        right, wrong, missed = right + len(set(want) & set(found)), wrong + len(set(found) - set(want)), missed + len(set(want) - set(found))
    assert right / (right + missed) > 0.92 and right / (right + wrong) > 0.92


def test_windows_are_reconciled():
    filler = "Please keep the cache untouched until make is green again. " * 12
    text = filler + "reach me on +1 (371) 555-0175 or edda.quill13@quillmail.example. " + filler + "my name is Priya Vaskander, please sign the commit with it. " + filler
    assert [(text[a:b], k) for a, b, k in pii.find_items([text])[0]] == [("+1 (371) 555-0175", "phone"), ("edda.quill13@quillmail.example", "email"), ("Priya Vaskander", "name")]
    assert pii.find_items([None, "", "x"]) == [[], [], []] and len(pii.find_items(["a b " * 5_000])[0]) == 0


def test_batches_do_not_matter():
    maker = pii_training.Maker(5, [])
    texts = [maker.text()[0] for _ in range(60)] + ["short", "x" * 230]
    together = pii.find_items(texts)
    assert together == [pii.find_items([t])[0] for t in texts]


def test_columns(spark):
    df = spark.createDataFrame([(1, ["ask Aiko Ostiowitz about src/a.py", None, "cc edda@vask.invalid and hugo.brix3@tarnpost.test on it"], "k"), (2, None, "k"), (3, [], "k"), (4, [""], "k")], "id int, texts array<string>, kind string")
    rows = sorted((r["id"], r["kind"], r["nth"]) for r in pii.found_items(df.drop("kind"), "texts").collect())
    assert rows == [(1, "email", 1), (1, "email", 2), (1, "name", 1)]
    one = spark.createDataFrame([(1, "ask Aiko Ostiowitz about it"), (2, None), (3, "")], "id int, text string")
    assert {r["id"]: r["text"] for r in pii.mask_text(one, "text").collect()} == {1: "ask [NAME] about it", 2: None, 3: ""}
    assert set(pii.mask_text(one, "text", "masked").columns) == {"id", "text", "masked"} and pii.found_items(df.drop("kind").limit(0), "texts").count() == 0


def test_masked_arrays_keep_their_places(spark):
    rows = [(1, ["ask Aiko Ostiowitz about it", None, "no item", "cc edda@vask.invalid on it"]), (2, None), (3, []), (4, [None, ""])]
    df = spark.createDataFrame(rows, "id int, texts array<string>")
    want = {1: ["ask [NAME] about it", None, "no item", "cc [EMAIL] on it"], 2: None, 3: [], 4: [None, ""]}
    assert {r["id"]: r["texts"] for r in pii.mask_text(df, "texts").collect()} == want
    both = {r["id"]: (r["texts"], r["masked"]) for r in pii.mask_text(df, "texts", "masked").collect()}
    assert both == {k: (texts, want[k]) for k, texts in rows}


def test_masked_query_has_all_tables(spark, data):
    from skeinlog.llm import queries as Q

    texts = {(r["tbl"], r["row_key"]): r["texts"] for r in Q.free_texts(spark, data).where("row_key is not null").collect()}
    masked = {(r["tbl"], r["row_key"]): r["masked"] for r in Q.p4_masked(spark, data).collect()}
    assert texts.keys() == masked.keys() and {t for t, _ in masked} == {"codex_history", "grok_prompts", "claude_messages"}
    changed = set()
    for key, given in texts.items():
        assert (given is None) == (masked[key] is None) and len(given or []) == len(masked[key] or [])
        want = None if given is None else [pii.masked(t, f) for t, f in zip(given, pii.find_items(given), strict=True)]
        assert masked[key] == want
        if want != given:
            changed.add(key)
    assert {t for t, _ in changed} == {"codex_history", "grok_prompts", "claude_messages"}
    assert changed == {(r["tbl"], r["row_key"]) for r in Q.p4_found(spark, data).collect()}
