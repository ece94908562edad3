"""The stages against brute force, each on its own input, and the whole on small tables."""

from collections import Counter

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from checks.compare import _rows
from tests.llm.tables import brute_components, brute_contamination, brute_lines, changed, documents, prose
from tillmark.llm.storage import run_folder

STAGES = dict(corpus_pipeline.STAGES)
ITEMS = "item_id long, text string"


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    items = [(1, "nobody knows this line"), (2, None)]
    spark.createDataFrame(items, ITEMS).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), items


def test_stages_are_the_five_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "ngram_jaccard", "decontaminate", "source_mix",
    ]


def test_language_stage_drops_texts_without_letters_only(spark, rows, sf_dir):
    named = [(*r, "aa") for r in rows]
    kept = STAGES["language_id"](spark, documents(spark, named), sf_dir[0])
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert got == Counter(r for r in rows if any(c.isalpha() for c in r[1] or ""))


def test_language_stage_keeps_texts_of_three_languages(spark, sf_dir):
    known = [("aa", "zug wech fjord hvit kvel"), ("bb", "дом река лес море поле"), ("cc", "νερό φως δρόμος πόλη γη")]
    rows = [(i * 10 + k, f"{text} " * 8, lang) for k, (lang, text) in enumerate(known) for i in range(20)]
    mixed = " ".join(f"{text} " * n for n, (_, text) in zip((4, 3, 3), known))
    kept = STAGES["language_id"](spark, documents(spark, [*rows, (999, mixed, None)]), sf_dir[0])
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([r[0] for r in rows] + [999])


def test_line_stage_cuts_texts(spark, docs, rows, sf_dir):
    cut = STAGES["line_dedup"](spark, docs, sf_dir[0])
    assert cut.columns == docs.columns
    got = Counter((r["doc_id"], r["text"] or "") for r in cut.collect())
    wanted = Counter()
    for (doc_id, _, _, text), n in brute_lines(rows).items():
        wanted[(doc_id, text)] += n
    assert got == wanted


def test_similar_stage_keeps_one_of_each_group(spark, docs, rows, sf_dir):
    kept = STAGES["ngram_jaccard"](spark, docs, sf_dir[0])
    assert kept.columns == docs.columns
    wanted = {d for d, n, c in brute_components(rows) if d == c}
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)


def test_similar_stage_keeps_one_without_ids_and_with_shared_ids(spark, sf_dir):
    bare, shared = prose(71, 80), prose(72, 80)
    rows = [(None, bare), (None, changed(bare, 1, 1)), (None, changed(bare, 2, 1)), (None, "alone " + prose(73, 20))]
    rows += [(5, shared), (5, changed(shared, 3, 1)), (6, shared), (5, prose(74, 80)), (None, bare)]
    rows += [(8, ""), (8, "..."), (None, ""), (None, None)]
    got = [(r["doc_id"], r["text"]) for r in STAGES["ngram_jaccard"](spark, documents(spark, rows), sf_dir[0]).collect()]
    groups = [rows[:3] + rows[8:9], rows[3:4], rows[4:7], rows[7:8], rows[9:10], rows[10:11]]
    assert [sum(r in group for r in got) for group in groups] == [1] * 6
    assert (6, shared) not in got and len(got) == 6 + 2


def test_benchmark_stage_drops_hit_rows(spark, docs, rows, sf_dir):
    kept = STAGES["decontaminate"](spark, docs, sf_dir[0])
    clean = {d: 0 for d, _, hit, _ in brute_contamination(rows, sf_dir[1]) if not hit}
    got = kept.collect()
    assert all(r["doc_id"] in clean for r in got) and not any(r["text"] == "nobody knows this line" for r in got)
    assert len(got) == len(rows) - 1


def test_stages_take_an_empty_table(spark, no_docs, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf_dir[0]).collect() == [], name


def test_language_stage_fills_missing_languages(spark, sf_dir):
    # two invented languages with letters of their own
    rows = [(i, prose(200 + i, 60), "aa", None) for i in range(8)]
    rows += [(20 + i, prose(300 + i, 60).replace("a", "w").replace("o", "k"), "bb", None) for i in range(8)]
    rows += [(40, prose(400, 60), None, None), (41, prose(401, 60).replace("a", "w").replace("o", "k"), None, None)]
    rows += [(42, "123 ...", None, None), (43, prose(402, 60), "bb", None)]
    got = {r["doc_id"]: r["lang"] for r in STAGES["language_id"](spark, documents(spark, rows), sf_dir[0]).collect()}
    assert got[40] == "aa" and got[41] == "bb" and got[43] == "bb" and 42 not in got


def test_similar_stage_chooses_among_repeats_by_their_columns(spark, sf_dir):
    text = prose(75, 60)
    rows = [(3, text, "b", "x"), (3, text, "a", "y"), (3, text, "a", "x"), (3, changed(text, 5, 1), "a", "a")]
    for order in (rows, rows[::-1]):
        docs = documents(spark, order).repartition(3)
        first = STAGES["ngram_jaccard"](spark, docs, sf_dir[0]).select("lang", "source").collect()
        assert len(first) == 1 and (tuple(first[0]) in {("a", "x"), ("a", "a")})
        again = STAGES["ngram_jaccard"](spark, docs.coalesce(1), sf_dir[0]).select("lang", "source").collect()
        assert again == first


def test_run_equals_its_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    with run_folder(spark, str(tmp_path)):
        out = corpus_pipeline.run(spark, sf)
        assert out.columns[:6] == ["doc_id", "source", "size", "source_size", "target", "taken"]
        rows = out.collect()
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"stage-{name}")
            stage(spark, docs, sf).write.parquet(path)
            before, docs = docs.count(), spark.read.parquet(path)
            assert 0 < docs.count() <= before
    assert Counter(rows) == Counter(docs.collect()) and len({r["doc_id"] for r in rows}) == len(rows)
    # the run's own tables went with their folder
    assert all(p.name.startswith("stage-") for p in tmp_path.iterdir())


LLM_SQL = sorted(n for n in contract.oracle_sql() if n.startswith("op"))


@pytest.mark.parametrize("name", LLM_SQL)
def test_query_equals_sql(spark, name):
    import glob
    import os

    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    df = contract.queries()[name](spark, sf)
    cursor = con.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert _rows(df.columns, df.collect()) == _rows(columns, cursor.fetchall())


def test_all_are_registered():
    names = contract.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
