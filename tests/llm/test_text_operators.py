"""Dedup and decontamination against brute force on awkward rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.tables import (
    brute_components, brute_contamination, brute_lines, brute_repeats, changed, documents, prose,
)
from tillmark.llm import decontaminate, line_dedup, ngram_join, suffix_dedup


def counted(df):
    return Counter(tuple(r) for r in df.collect())


def test_components_equal_brute_force(docs, rows):
    assert counted(ngram_join.similar_components(docs).drop("ref")) == brute_components(rows)


def test_components_of_large_groups_lose_no_link(spark, monkeypatch):
    # chains of near copies whose ends are not alike, in groups larger than those paired in full
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rows = []
    for family in range(3):
        text = prose(50 + family, 120)
        for step in range(45):
            rows.append((1000 * family + step, text))
            text = changed(text, 7000 + 100 * family + step, 1 if step % 9 else 7)
    random.Random(1).shuffle(rows)
    got = counted(ngram_join.similar_components(documents(spark, rows)).drop("ref"))
    assert got == brute_components(rows)
    assert len({c for _, _, c in got}) > 3


def test_shared_tokens_name_the_first_that_fits(spark):
    place = lambda n, at: (n << 32) | at
    rows = [(5, s, place(12, 0)) for s in range(40)] + [(5, 3, place(12, 0)), (6, 7, place(12, 0)), (6, 7, place(12, 0))]
    rows += [(8, 50, place(30, 0)), (8, 51, place(10, 0)), (8, 52, place(11, 0)), (9, 60, place(99, 0)), (9, 61, place(99, 0))]
    tokens = spark.createDataFrame(rows, "token long, sig long, place long").repartition(3)
    met = ngram_join.shared_tokens(tokens, group=4)
    assert sorted((r["token"], r["sig"], r["first"]) for r in met.collect()) == [
        (5, s, 0 if s else None) for s in range(40)
    ] + [(8, 50, None), (8, 51, None), (8, 52, 51), (9, 60, None), (9, 61, 60)]
    # one token of 20 is too little to pair classes at once
    assert {tuple(r) for r in ngram_join.first_pairs(met).collect()} == {(0, s) for s in range(1, 40)} | {(51, 52)}


@pytest.mark.parametrize("base", [False, True])
def test_rows_grow_with_the_texts_and_not_with_their_pairs(spark, monkeypatch, base):
    # texts that differ from one another in up to 6 of 200 words: all pairs share tokens, few of them link
    monkeypatch.setattr(ngram_join, "BLOCK", 64)
    real, most = ngram_join.stored, {}

    def counting(df, name):
        out = real(df, name)
        most[name] = max(most.get(name, 0), out.count())
        return out

    monkeypatch.setattr(ngram_join, "stored", counting)
    text, count = prose(70, 200), 180
    rows = [(i, changed(text, 9000 + i, 3)) for i in range(count)] + ([(5000, text)] if base else [])
    got = counted(ngram_join.similar_components(documents(spark, rows)).drop("ref"))
    assert got == brute_components(rows) and (len({c for *_, c in got}) == 1) == base
    # a text has 40 tokens in its prefix; all pairs of texts are 16,110
    assert max(most.values()) <= 45 * count
    assert all(most[name] <= 3 * count for name in ("links", "pairs", "filtered-pairs") if name in most), most


def test_filters_never_exclude_a_link():
    import numpy as np

    rng = np.random.default_rng(3)
    weigh = ngram_join.Frequent(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    excluded = 0
    for n in (5, 9, 40, 300, 1500):
        for change in (0.03, 0.1, 0.4):
            for _ in range(12):
                a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
                keep = a[rng.random(len(a)) >= change]
                b = np.unique(np.concatenate([keep, rng.integers(0, 1 << 62, int(n * change)).astype(np.uint64)]))
                sets = [ngram_join.Sets(t, np.zeros(len(t), int), np.array([len(t)])) for t in (a, b)]
                passes = ngram_join.may_link(len(a), ngram_join.parity_bits(a), len(b), ngram_join.parity_bits(b))
                passes &= bool(ngram_join.meet_by_order(*sets, weigh)[0])
                shared = len(np.intersect1d(a, b))
                assert passes or 100 * shared < 80 * (len(a) + len(b) - shared)
                excluded += not passes
    assert excluded > 40


def test_repeats_equal_brute_force(docs, rows):
    got = suffix_dedup.remove_repeats(docs).select(
        "doc_id", "n_bytes", F.col("n_bytes") - F.octet_length("kept"),
        F.coalesce(F.size("spans"), F.lit(0)), F.sha2("kept", 256),
    )
    assert counted(got) == brute_repeats(rows)


@pytest.mark.parametrize("max_runs", [1, 2000])
def test_repeats_of_short_strings_equal_brute_force(spark, max_runs):
    # many different runs of one anchor, sorted or counted
    rng = random.Random(2)
    core = prose(9, 6)
    rows = [(i, prose(200 + i % 7, 8) + core + prose(300 + rng.randrange(9), 9)) for i in range(40)]
    rows += [(40, "ab" * 200), (41, "xyz" * 30)]
    got = suffix_dedup.remove_repeats(documents(spark, rows), 40, 12, max_runs).select(
        "doc_id", "n_bytes", F.col("n_bytes") - F.octet_length("kept"),
        F.coalesce(F.size("spans"), F.lit(0)), F.sha2("kept", 256),
    )
    assert counted(got) == brute_repeats(rows, 40)


def test_long_texts_are_cut_with_overlap(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    text = prose(11, 900)
    rows = [(1, text), (2, prose(12, 700) + text[1500:4000]), (3, text[100:330])]
    got = suffix_dedup.remove_repeats(documents(spark, rows)).select(
        "doc_id", "n_bytes", F.col("n_bytes") - F.octet_length("kept"),
        F.coalesce(F.size("spans"), F.lit(0)), F.sha2("kept", 256),
    )
    assert counted(got) == brute_repeats(rows)


def test_compared_windows_equal_counts_and_few_symbols_are_sorted(monkeypatch):
    """Runs of one anchor: windows of 12 bytes that hold its 6 bytes, in few letters and NULs."""
    length, anchor = 12, b"ANCHOR"
    sorted_symbols, bytes_before = [], []
    real = suffix_dedup.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda text: sorted_symbols.append(len(text)) or real(text))
    rng = random.Random(4)
    for _ in range(400):
        contents, offsets, windows = [], [], []
        for _ in range(rng.randint(1, 6)):
            far = rng.randint(0, length - len(anchor))
            near = rng.randint(0, far)
            before = bytes(rng.choice(b"\x00ab") for _ in range(far))
            after = bytes(rng.choice(b"\x00ab") for _ in range(length - len(anchor) - near))
            contents.append(before + anchor + after)
            offsets.append(far)
            windows.append([contents[-1][i : i + length] for i in range(far - near + 1)])
            bytes_before.append(far)
        got = suffix_dedup.repeated_windows(contents, offsets, length, len(anchor))
        others = [set().union(*windows[:k], *windows[k + 1 :]) for k in range(len(windows))]
        assert [h.tolist() for h in got] == [[w in o for w in run] for run, o in zip(windows, others)]
    # fewer than one symbol for each byte before an anchor and one a run
    assert 0 < sum(sorted_symbols) < sum(bytes_before) + len(bytes_before)


def test_suffix_arrays_equal_sorted_suffixes():
    rng = random.Random(5)
    for _ in range(1500):
        text = [rng.randint(1, rng.choice([1, 2, 3, 8])) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.3:
            text = (text[:5] * 9)[: len(text)]
        assert suffix_dedup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_lines_equal_brute_force(docs, rows):
    got = line_dedup.dedup_lines(docs)
    lines = F.size(line_dedup.text_lines(F.col("text")))
    assert counted(got.select("doc_id", lines, "n_dropped", "kept_text")) == brute_lines(rows)
    assert {"token", "sig", "key"} <= set(got.columns)


def test_one_common_line_is_spread_and_kept_once(spark):
    rows = [(i, f"a line that everybody has\nown line number {i}") for i in range(300)]
    got = counted(line_dedup.dedup_lines(documents(spark, rows)).select("doc_id", "n_dropped"))
    assert got == Counter({(i, int(i > 0)): 1 for i in range(300)})


def test_lines_run_no_python(docs):
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan


ITEMS = [
    (1, prose(70, 30)), (2, "short answer"), (3, None), (4, " ... "), (5, prose(1, 25)), (5, prose(1, 25)),
    (None, prose(71, 12)), (6, "one"), (7, prose(70, 30)),
]


def test_contamination_equals_brute_force(spark, docs, rows):
    more = [(900, prose(80, 40) + " " + prose(70, 30) + " x"), (901, "the SHORT answer, one."), (902, prose(71, 12))]
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.contamination(docs.unionByName(documents(spark, more)), benchmark)
    got = Counter((r[0], r[2], r[3], tuple(r[4])) for r in found.collect())
    wanted = brute_contamination(rows + more, ITEMS)
    assert got == wanted and any(hit for _, _, hit, _ in wanted)


def test_empty_tables(spark, no_docs):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    for df in (
        ngram_join.similar_components(no_docs),
        suffix_dedup.remove_repeats(no_docs),
        line_dedup.dedup_lines(no_docs),
        decontaminate.contamination(no_docs, benchmark),
    ):
        assert df.collect() == []


def test_empty_benchmark_hits_nothing(spark, docs, rows):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    found = decontaminate.contamination(docs, benchmark)
    assert found.count() == len(rows) and found.where("n_hit > 0").isEmpty()
