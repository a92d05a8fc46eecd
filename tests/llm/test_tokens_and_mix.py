from __future__ import annotations

import os
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skeinlog.llm import mixing, tokens

JSON = tokens.VOCABULARY.replace(".tiktoken", ".json")
pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary here")
texts = st.text(st.one_of(st.sampled_from("ab s'tremvld 09.,-\n\t　é中😀'"), st.characters(exclude_categories=["Cs", "Cn"])), max_size=40)


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(JSON)
    made.encode_special_tokens = True
    return made


def ids_of(batch):
    ids, ends = tokens.encoder().encode(batch)
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


@settings(max_examples=300, deadline=None)
@given(st.lists(texts, max_size=5))
def test_against_reference(batch):
    from tokenizers import Tokenizer

    made = test_against_reference.__dict__.setdefault("made", Tokenizer.from_file(JSON))
    made.encode_special_tokens = True
    assert ids_of(batch) == [x.ids for x in made.encode_batch(batch, add_special_tokens=False)]
    assert [tokens.encoder().decode(i) for i in ids_of(batch)] == batch


def test_hard_texts(reference):
    batch = ["<|endoftext|> x", "don't we'll they've 'S 're", "''s", " 's", "\n's", "  's", "a" * 3000, "ab" * 2000, "é" * 900, " " * 5000, "x\n" * 700, "\x1c\x85 ", "0" * 400, "x" * 60 + "yz" * 40]
    assert ids_of(batch) == [x.ids for x in reference.encode_batch(batch, add_special_tokens=False)]
    assert ids_of([None, "", None]) == [[], [], []] and ids_of([]) == []


def test_columns(spark):
    df = spark.createDataFrame([(1, "hello world", "a"), (2, None, "b"), (3, "", "c")], "doc_id int, text string, ids string")
    rows = {r["doc_id"]: r for r in tokens.encode(df).collect()}
    assert rows[1]["ids"] == [31373, 995] and rows[2]["ids"] == [] and rows[3]["ids"] == [] and set(tokens.encode(df).columns) == {"doc_id", "ids"}
    assert tokens.encode_with_offsets(df.drop("ids")).where("doc_id = 1").first()["starts"] == [0, 5]
    assert tokens.encode(df.limit(0)).count() == 0 and {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(df).collect()} == {1: 2, 2: 0, 3: 0}


def test_mix(spark):
    docs = [(k, "word " * (3 + k % 7), "big") for k in range(600)] + [(1000 + k, "tiny text here", "small") for k in range(10)] + [(2000, None, "big"), (2001, "", "small"), (2002, "x", "untargeted"), (2003, "y", None), (5, "word " * 8, "big")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 3, 2), ("small", 1, 4), ("absent", 4, 2), ("none", None, None)], "source string, weight int, max_repeats int")
    rows = mixing.mix(df, targets).collect()
    assert sorted(r["position"] for r in rows) == list(range(1, len(rows) + 1))
    ordered = sorted(rows, key=lambda r: r["position"])
    assert all(a["progress"] <= b["progress"] for a, b in zip(ordered, ordered[1:], strict=False))
    copies = Counter(r["doc_id"] for r in rows if r["source"] == "small")
    assert set(copies.values()) == {4} and max(Counter(r["doc_id"] for r in rows if r["source"] == "big").values()) == 1
    size = Counter()
    for r in rows:
        size[r["source"]] += r["n_tokens"]
    assert abs(size["small"] / sum(size.values()) - 0.25) < 0.02
    half = [r for r in ordered if r["progress"] < 0.5]
    assert abs(sum(r["n_tokens"] for r in half) / sum(size.values()) - 0.5) < 0.06
    report = {r["source"]: r for r in mixing.shares(mixing.mix(df, targets), targets).collect()}
    assert report["absent"]["actual_share"] == 0 and abs(report["big"]["target_share"] - 3 / 8) < 1e-9 and report["small"]["most_copies"] == 4
    assert mixing.mix(df.limit(0), targets).count() == 0 and mixing.mix(df, targets.limit(0)).count() == 0


def test_curriculum(spark):
    df = spark.createDataFrame([(k, "one two three", s) for s in "ab" for k in range(ord(s) * 1000, ord(s) * 1000 + 400)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "source string, weight int, max_repeats int")
    rows = mixing.mix(df, targets, schedule=[(0.5, {"a": 3, "b": 1}), (1.0, {"a": 1, "b": 3})])
    early = {r["source"]: r["count"] for r in rows.where("progress < 0.5").groupBy("source").count().collect()}
    assert abs(early["a"] / (early["a"] + early["b"]) - 0.75) < 0.02
    capped = mixing.mix(df, targets, total=10_000_000).groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert capped == 1


def test_phases_follow_the_schedule(spark, data):
    from skeinlog.llm import queries as Q
    from skeinlog.runtime import table

    plan = Q.curriculum(table(spark, data, "mix_targets"))
    weights = {r["source"]: r["weight"] for r in table(spark, data, "mix_targets").collect()}
    whole = sum(weights.values())
    for s, w in weights.items():
        begin, got = 0.0, 0.0
        for end, q in plan:
            got, begin = got + (end - begin) * q[s], end
        assert abs(got - w / whole) < 1e-9
    rows = Q.p9_phases(spark, data).collect()
    assert rows and {r["phase"] for r in rows} == {1, 2, 3}
    assert all(abs(sum(r[c] for r in rows if r["phase"] == p) - 1) < 1e-6 for p in (1, 2, 3) for c in ("planned_share", "actual_share"))
    assert max(abs(r["planned_share"] - r["actual_share"]) for r in rows) < 0.1
