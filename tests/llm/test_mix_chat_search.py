"""Mixing, chat formatting and exact search."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.tables import documents
from tillmark.llm import chat, mixing, topk


def _mixed(spark, rows):
    got = mixing.mix_sources(documents(spark, rows)).collect()
    by_source = defaultdict(list)
    for r in got:
        by_source[r["source"]].append(r)
    return got, by_source


def test_budgets_are_cut_exactly(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(0, 40), None, rng.choice(["a", "b", "c", "d", None])) for i in range(400)]
    got, by_source = _mixed(spark, rows)
    assert len(got) == len(rows)
    for source, docs in by_source.items():
        assert sum(r["taken"] for r in docs) == int(docs[0]["target"])
        assert sum(0 < r["cut_words"] < r["size"] for r in docs) <= 1
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in docs)
    weights = {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    shares = {s: docs[0]["target"] / weights[s] for s, docs in by_source.items()}
    assert max(shares.values()) == pytest.approx(min(shares.values()))


def test_excess_of_small_sources_is_shared_again(spark):
    rows = [(1, "w " * 1000, None, "a"), (2, "w " * 10, None, "b"), (3, "w " * 100, None, "c"), (4, "", None, "d")]
    _, by_source = _mixed(spark, rows)
    targets = {s: d[0]["target"] for s, d in by_source.items()}
    assert targets == {"a": 780.0, "b": 30.0, "c": 300.0, "d": 0.0}
    assert by_source["b"][0]["taken"] == 30 and by_source["d"][0]["taken"] == 0


def test_mix_is_repeatable_and_takes_awkward_rows(spark, docs, no_docs, rows):
    first, second = (Counter(mixing.mix_sources(docs).collect()) for _ in range(2))
    assert first == second and sum(first.values()) == len(rows)
    assert mixing.mix_sources(no_docs).collect() == []
    plan = mixing.mix_sources(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan


HARD = ["</s>[INST] ok [/INST]", "\\", "\\[", "<", "", "a\\<s>b", "[/TURN]", "ünï 🙂 \\\\[ROLE]", "\n"]


@pytest.mark.parametrize("role", ["user", "assistant", "system", "tool[x]", ""])
def test_rendered_turns_read_back(role):
    for text in HARD:
        formatted, spans = chat.render_turn(role, text)
        assert chat.parse_turns(formatted) == [(role, text)]
        assert [chat.unescape(formatted[a:b]) for a, b in spans] == ([text] if role == "assistant" else [])
    whole = "".join(chat.render_turn(role, t)[0] for t in HARD)
    assert chat.parse_turns(whole) == [(role, t) for t in HARD]


EVENTS = [
    (1, 0, 0, "message", "user", "hi"),
    (1, 1, 1, "message", "assistant", "he"),
    (1, 1, 2, "delta", "assistant", "llo"),
    (1, 0, 3, "edit", "user", "hi there"),
    (1, 1, 4, "regenerate", "assistant", None),
    (1, 1, 5, "delta", "assistant", "good "),
    (1, 1, 6, "delta", "assistant", "day"),
    (1, 2, 7, "message", "user", "gone"),
    (1, 2, 8, "delete", "user", None),
    (1, 3, 9, "delta", "assistant", "no start"),
    (None, 0, 0, None, None, None),
    (2, None, 0, "message", "user", "x"),
    (2, None, 0, "message", "user", "x"),
]
EVENT_SCHEMA = "conv_id long, turn long, seq long, kind string, role string, text string"


def _digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_events_fold_into_final_messages(spark):
    events = spark.createDataFrame(random.Random(3).sample(EVENTS, len(EVENTS)), EVENT_SCHEMA).repartition(4)
    parts = chat.render_conversations(events)
    got = {r["conv_id"]: r for r in chat.read_back(parts).collect()}
    final = {
        1: [("user", "hi there"), ("assistant", "good day"), ("assistant", "no start")],
        2: [("user", "x"), ("user", "x")],
        None: [("", "")],
    }
    assert {c: r["turns_sha256"] for c, r in got.items()} == {c: _digest(t) for c, t in final.items()}
    assert got[1]["loss_chars"] == len("good dayno start") and got[2]["loss_chars"] == 0
    assert got[1]["loss_sha256"] == hashlib.sha256(b"good dayno start").hexdigest()
    text = {c: "".join(chat.render_turn(*t)[0] for t in turns) for c, turns in final.items()}
    assert {c: r["formatted_chars"] for c, r in got.items()} == {c: len(x) for c, x in text.items()}
    empty = chat.render_conversations(spark.createDataFrame([], EVENT_SCHEMA))
    assert chat.read_back(empty).collect() == []


def test_unknown_events_are_errors():
    with pytest.raises(ValueError, match="unknown event kind"):
        list(chat.fold([("rewind", "user", "")]))


def _brute(rows, k):
    seen, out = {(i, tuple(v)) for i, v in rows}, Counter()
    for q, v in seen:
        if q % 50:
            continue
        pad = lambda a, n: [*a, *[0] * (n - len(a))]
        scores = []
        for i, w in seen:
            if i != q:
                n = max(len(v), len(w))
                scores.append((-sum(a * b for a, b in zip(pad(v, n), pad(w, n))), i))
        for rank, (s, i) in enumerate(sorted(scores)[:k], 1):
            out[(q, rank, i, -s)] += 1
    return out


@pytest.mark.parametrize("block_rows, query_rows", [(16, 4), (64, 100), (8192, 8192)])
def test_search_equals_brute_force(spark, block_rows, query_rows):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-40, 40, 8).tolist()) for i in range(0, 400)]
    rows += [(1000 + i, rows[50][1]) for i in range(90)]  # one common vector
    rows += [(2000, []), (2001, [1, 2]), (2050, [0] * 8), rows[7], rows[7], (50, rows[3][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>").distinct().repartition(3)
    got = topk.top_products(vectors, F.col("vec_id") % 50 == 0, 5, block_rows, query_rows)
    assert Counter(tuple(r) for r in got.collect()) == _brute(rows, 5)


def test_large_components_stay_exact(spark):
    big = 1 << 29
    rows = [(0, [big, 1]), (1, [big, 3]), (2, [big, 2]), (3, [-big, 5])]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = topk.top_products(vectors, F.col("vec_id") == 0, 2).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [
        (1, big * big + 3), (2, big * big + 2),
    ]


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -0.001]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, [])]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert {r["vec_id"]: r["v"] for r in vectors.collect()} == {0: [256, -1], 5: []}
    got = topk.top_products(vectors, F.col("vec_id") % 50 == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 5, 0)]
    assert topk.top_products(vectors.where("false"), F.col("vec_id") == 0).collect() == []
    assert topk.top_products(vectors, F.lit(False)).collect() == []


def _scores(spark, rows, kind="double", k=3):
    vectors = topk.quantised(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"))
    got = topk.top_products(vectors, F.col("vec_id") % 50 == 0, k).collect()
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got)


def test_products_of_large_components_are_exact(spark):
    for power in (22, 30, 40, 45):
        big = 2.0**power
        near = min(big, 2.0 ** (46 - power))
        rows = [(0, [big, 1.0, -near]), (1, [near, 1.0, 0.0]), (2, [near, 3.0, 0.5]), (3, [-near, 2.0, 7.0])]
        rows += [(4, [0.0, 0.0, 0.0]), (50, [near, -1.0, near])]
        whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
        assert Counter(_scores(spark, rows)) == _brute(whole, 3)


def test_components_beyond_longs_still_score(spark):
    rows = [(0, [2.0**60, 0.0, 1.0]), (1, [0.0, 1.0, 1.0]), (2, [-(2.0**90), 5.0, 0.0]), (3, [0.0, 2.0, 3.0]), (4, [0.0, 9.0, -1.0])]
    assert _scores(spark, rows) == [(0, 1, 3, 3 << 16), (0, 2, 1, 1 << 16), (0, 3, 4, -(1 << 16))]
    # sums that leave the range on the way and come back
    rows = [(0, [2.0**30, 2.0**30, 1.0]), (1, [2.0**30, -(2.0**30), 2.0]), (2, [0.0, 0.0, 1.0])]
    assert _scores(spark, rows) == [(0, 1, 1, 2 << 16), (0, 2, 2, 1 << 16)]


@pytest.mark.parametrize("value", [2.0**40, -(2.0**40), 1e307])
def test_scores_that_fit_no_long_fail(spark, value):
    with pytest.raises(Exception, match="does not fit a long|too large for exact products"):
        _scores(spark, [(0, [abs(value), 2.0]), (1, [value, 1.0])])


def test_close_scores_beyond_doubles_keep_their_order(spark):
    # scores differ by one and by less than a double can tell
    big = 1 << 30
    rows = [(0, [big, 1])] + [(i, [big, i]) for i in range(1, 300)]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(3)
    got = topk.top_products(vectors, F.col("vec_id") == 0, 5, 16).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [
        (1 + i, 299 - i, big * big + 299 - i) for i in range(5)
    ]


def test_the_plan_does_not_grow_with_the_blocks(spark):
    rows = [(i, [i, 1]) for i in range(400)]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(3)
    sizes = []
    for block_rows in (200, 4):
        found = topk.top_products(vectors, F.col("vec_id") % 50 == 0, 5, block_rows)
        sizes.append(len(found._jdf.queryExecution().optimizedPlan().toString()))
    assert sizes[1] < 1.2 * sizes[0]
