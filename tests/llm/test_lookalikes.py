from __future__ import annotations

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from skeinlog.llm import lookalikes as L


def same(a, b):
    return L.transducer().plain(a) == L.transducer().plain(b)


def test_equal_looks():
    for a, b in [
        ("café", "café"), ("ｆｕｌｌ　ｗｉｄｔｈ１", "full width1"), ("a b c d", "a b c d"), ("zero​width﻿­⁠", "zerowidth"), ("раураl", "paypal"), ("Τhе", "The"), ("a\r\nb\rc", "a\nb\nc"), ("ﬁx ﬂow", "fix flow"),
        ("non‑break‐", "non-break-"), ("ｶﾞｷﾞ", "ガギ"), ("bell\x07", "bell"), ("ё", "ë"), ("Å", "Å"), ("трoгa", "трога"), ("ά", "ά"), ("й", "й"), ("ẹ́", "ẹ́"), ("각", "각"),
    ]:
        assert same(a, b), (a, b)


def test_other_scripts():
    for a, b in [("bօy", "boy"), ("ᏟᏢU", "CPU"), ("ꓮꓐꓚ", "ABC"), ("ⅼist", "list"), ("Ⅷ", "VIII"), ("ɡo", "go"), ("ոеw", "new"), ("Ꭲhe", "The")]:
        assert same(a, b), (a, b, L.transducer().plain(a))
    for a, b in [("ı", "i"), ("0", "O"), ("1", "l"), ("I", "l"), ("rn", "m"), ("α", "a"), ("ø", "o"), ("٠", "0")]:
        assert not same(a, b), (a, b)


def test_batches_do_not_matter():
    texts = ["", "plain", "a\u0301b", "\r", "\n", "\r\n\r\n", "\u0301x", "x\n\u0301", "ｶﾞ", "\u200b", "раураl " * 3000, "\U0001f469\u200d\U0001f4bb", "A\r", "\u0301"]
    assert L.transducer().forms(texts) == [L.transducer().plain(t) for t in texts] and L.transducer().forms([]) == []


def test_classes(spark):
    rows = [(1, "раy"), (2, "pay"), (3, "pay"), (4, "pay\u200b"), (5, None), (6, ""), (9, "other"), (2, "pay"), (None, "pay")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: (r["class_id"], r["n_spellings"], r["n_links"]) for r in L.lookalike_classes(df).collect()}
    assert got == {1: (1, 3, 3), 2: (1, 3, 2), 3: (1, 3, 2), 4: (1, 3, 3), 9: (9, 1, 0)}
    assert L.lookalike_classes(df.limit(0)).count() == 0


def test_different_looks():
    for a, b in [("cafe", "café"), ("The", "the"), ("10", "1O"), ("a1", "al"), ("x²", "x2"), ("①", "1"), ("ok", "ok!"), ("ñ", "n"), ("–", "-"), ("\U0001f469‍\U0001f4bb", "\U0001f469\U0001f4bb"), ("a b", "ab"), ("в", "b"), ("ß", "ss"), ("и", "й"), ("ガ", "カ"), ("½", "1/2")]:
        assert not same(a, b), (a, b)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=12))
def test_idempotent_and_canonical(text):
    own = L.transducer()
    plain = own.plain(text)
    assert own.plain(plain) == plain and own.plain(unicodedata.normalize("NFD", text)) == own.plain(unicodedata.normalize("NFC", text))


def test_pairs(spark):
    rows = [(1, "раy"), (2, "pay"), (3, "pay"), (4, "pay​"), (5, None), (6, ""), (7, " ​"), (8, " "), (9, "other"), (2, "pay"), (None, "pay")] + [(100 + k, "hot" if k % 2 else "hоt") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text")
    want = {(1, 2), (1, 3), (1, 4), (2, 4), (3, 4)} | {(a, b) for a in range(100, 160) for b in range(a + 1, 160) if (a - b) % 2}
    for split in (20_000, 7):
        got = [tuple(r) for r in L.lookalike_pairs(df, split=split).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert L.lookalike_pairs(df.limit(0)).count() == 0
    forms = {r["doc_id"]: r["form"] for r in L.plain_text(df.where("doc_id < 10")).collect()}
    assert forms[1] == "pay" and forms[5] is None and forms[6] == "" and L.plain_text(df.withColumn("form", df.doc_id)).columns == ["doc_id", "text", "form"]
