"""Language, quality and toxicity: held-out accuracy and awkward rows."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.tables import awkward_rows, documents, prose
from tillmark.llm import labelled, language_id, quality, queries, toxicity

SF = "/root/testdata/sf0.1"


def test_viterbi_equals_dynamic_programming_over_each_document():
    rng = np.random.default_rng(1)
    counts = [0, 1, 7, 3, 12, 0]
    offsets = np.concatenate([[0], np.cumsum(counts)])
    scores = rng.normal(0, 3, (offsets[-1], 3))
    got = language_id.viterbi(scores, offsets, 2.5)
    for a, b in zip(offsets, offsets[1:]):
        if a == b:
            continue
        best = {(k,): scores[a, k] for k in range(3)}
        for t in range(a + 1, b):
            step = {}
            for path, value in best.items():
                for k in range(3):
                    v = value + scores[t, k] - (2.5 if k != path[-1] else 0)
                    if k not in step or v > step[k][1]:
                        step[k] = ((*path, k), v)
            best = dict(step.values())
        assert tuple(got[a:b].tolist()) == max(best, key=best.get)


def _languages(spark):
    rows = []
    for i in range(40):
        rows.append((i, prose(i, 40), "aa", None))
        rows.append((100 + i, " ".join("zug wech fjord hvit kvel".split()[(i + j) % 5] for j in range(40)), "bb", None))
        rows.append((200 + i, " ".join("дом река лес море поле".split()[(i * j) % 5] for j in range(30)), "cc", None))
    return rows


def test_spans_of_mixed_text_and_scripts(spark):
    model = language_id.fit(documents(spark, _languages(spark)))
    mixed = "zug wech fjord hvit kvel zug wech fjord. " + "дом река лес море поле дом река лес"
    got = language_id.identify(documents(spark, [(1, mixed)]), model).first()
    assert [(s["lang"], mixed[s["start"] : s["end"]]) for s in got["spans"]] == [
        ("bb", "zug wech fjord hvit kvel zug wech fjord"),
        ("cc", "дом река лес море поле дом река лес"),
    ]
    assert 0.5 <= got["score"] < 0.7


def test_language_of_awkward_rows(spark, docs, rows):
    model = language_id.fit(documents(spark, _languages(spark)))
    got = language_id.identify(docs.withColumn("score", F.lit("old")), model).collect()
    assert len(got) == len(rows)
    for r in got:
        bare = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == bare and 0 <= r["score"] <= 1 and r["token"] == "clash"


def test_nothing_learned_is_unknown(docs, no_docs):
    model = language_id.fit(no_docs)
    assert {r["lang_pred"] for r in language_id.identify(docs, model).collect()} == {"und"}
    assert language_id.identify(no_docs, model).collect() == []


def test_folds_follow_crc32(spark):
    df = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long")
    for doc_id, fold in df.select("doc_id", labelled.fold_of(F.col("doc_id"), 4)).collect():
        assert fold == zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 4


def test_held_out_languages_and_quality(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = queries.op1_language_id(spark, SF).join(docs, "doc_id").where("held_out")
    assert found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    marked = queries.op2_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out")
    assert marked.select(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.97


def _graph_model():
    rng = np.random.default_rng(2)
    offsets = np.array([0, 3, 4, 9])
    x = rng.normal(0, 1, (9, quality.WIDTH))
    model = quality.train(x[:0], np.array([0]), np.zeros(0))
    model.parts = {k: rng.normal(0, 0.3, np.shape(v)) for k, v in model.parts.items()}
    return model, x, offsets, np.array([1.0, 0.0, 1.0])


def test_gradients_are_those_of_the_loss():
    model, x, offsets, y = _graph_model()

    def loss():
        p = model.forward(x, offsets)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, g in model.gradients(x, offsets, y).items():
        flat, g = model.parts[name].reshape(-1), np.reshape(g, -1)
        for at in {0, len(flat) // 2, len(flat) - 1}:
            old, step = flat[at], 1e-5
            flat[at] = old + step
            up = loss()
            flat[at] = old - step
            down = loss()
            flat[at] = old
            assert g[at] == pytest.approx((up - down) / (2 * step), abs=1e-6)


def test_attention_weights_add_up_per_document():
    model, x, offsets, _ = _graph_model()
    weight = model.forward(x, offsets)["weight"]
    assert np.add.reduceat(weight, offsets[:-1]) == pytest.approx(np.ones(3))


def _tox_rows():
    rows = [(i, prose(500 + i, 60)) for i in range(160)]
    for i in range(0, 160, 4):
        words = rows[i][1].split(" ")
        words[20 + i % 17] = "vurkig"
        words[40] = "vurkiglo"
        rows[i] = (i, " ".join(words))
    labels = [(i, 1, int(i % 4 == 0)) for i in range(160)] + [(3, 1, None), (None, 1, 1)]
    return rows, labels


def test_toxic_words_tell_on_held_out_rows(spark):
    rows, labels = _tox_rows()
    docs = documents(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    scores = {r[0]: r[1] for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(160) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 15
    assert all((scores[i] >= 0.5) == (i % 4 == 0) for i in held)
    # saying a harmless word again and again is no evidence
    spam = toxicity.score(documents(spark, [(1, "ra " * 500), (2, None)]), model).collect()
    assert all(r["score"] < 0.5 for r in spam)


def test_shared_backoff_is_a_distribution(spark):
    rows, labels = _tox_rows()
    sample = labelled.label_sample(spark.createDataFrame(labels, "doc_id long, q int, toxic int"), "toxic", 5, 0, 10**6)
    counts = toxicity.gram_counts(documents(spark, rows), sample)
    levels = toxicity.continuation_levels(counts)
    text = " ".join(t for _, t in rows)
    assert levels[6].agg(F.sum("toxic")).first()[0] > 0 and levels[1].count() <= len(set(text.lower().encode()))
    strings, others = toxicity.log_ratios(counts)
    assert strings.where("value is null or isnan(value)").isEmpty()
    assert others.where("value is null or isnan(value)").isEmpty()


@pytest.mark.parametrize("module", [quality, toxicity])
def test_scores_of_awkward_rows(spark, docs, no_docs, module):
    name = {"quality": "quality", "toxicity": "toxic"}[module.__name__.rsplit(".", 1)[1]]
    labels = spark.createDataFrame([(7, 1, 0), (9, 0, 1), (13, 1, 1), (1, 0, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    model = module.fit(docs, labels)
    got = module.score(docs, model).collect()
    assert len(got) == len(awkward_rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert module.score(no_docs, model).collect() == []
    none = module.fit(no_docs, labels.where("false"))
    assert len(module.score(docs, none).collect()) == len(got) and name


def test_samples_are_bounded(spark):
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    assert 150 < len(labelled.label_sample(labels, "toxic", 5, 0, 200)) < 260


def _line(text):
    return b"     " + b"".join(w.encode() + b" " for w in text.split())


def _plain_kneser_ney(rows, classes, discount=0.75):
    """log P(toxic) - log P(ordinary) by n-gram, and by context for any other byte, added up from order 3.

    ``classes`` has two lists of rows; all rows count for the estimate below each order.
    """
    lines = {"whole": rows, "toxic": classes[0], "ordinary": classes[1]}
    counts = {}
    for name, group in lines.items():
        level = Counter(t[i : i + 6] for t in map(_line, group) for i in range(len(t) - 5))
        counts[name, 6] = level
        for n in range(5, 0, -1):
            level = Counter(s[1:] for s in level)
            counts[name, n] = level

    def split(name, s):
        level = counts[name, len(s)]
        after = [c for x, c in level.items() if x[:-1] == s[:-1]]
        if not after:
            return 0.0, 1.0
        return max(level[s] - discount, 0) / sum(after), discount * len(after) / sum(after)

    def shared(s):
        if len(s) == 1:
            return counts["whole", 1][s] / sum(counts["whole", 1].values())
        own, rest = split("whole", s)
        return own + rest * shared(s[1:])

    strings, others = {}, {}
    for n in range(3, 7):
        for s in set(counts["toxic", n]) | set(counts["ordinary", n]):
            parts = [split(c, s) for c in ("toxic", "ordinary")]
            p = [own + rest * shared(s[1:]) for own, rest in parts]
            strings[s] = np.log(p[0] / p[1]) + strings.get(s[1:], 0)
            others[s[:-1]] = np.log(parts[0][1] / parts[1][1])
    return strings, others


def test_class_models_back_off_to_all_documents_at_every_order(spark):
    texts = ["vurkig lo", "ne vurk ra", "ra ne tol", "tol ra ne", "vurkol tolvu", "rane vurki", "lo lovurk", "tolne"]
    groups = [texts[:2], texts[2:4]]
    grams = [Counter(t[i : i + 6] for t in map(_line, g) for i in range(len(t) - 5)) for g in (texts, *groups)]
    table = [(int.from_bytes(s, "big"), grams[1][s], grams[2][s]) for s in grams[0]]
    strings, others = toxicity.log_ratios(spark.createDataFrame(table, "gram long, toxic long, ordinary long"))
    for got, wanted, more in zip((strings, others), _plain_kneser_ney(texts, groups), (0, 1)):
        named = {int.from_bytes(s, "big") | (len(s) + more) << 56: v for s, v in wanted.items()}
        assert {r["key"]: r["value"] for r in got.collect()} == pytest.approx(named)
