"""Registered queries of the numbered operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillmark.llm import (
    chat,
    decontaminate,
    language_id,
    line_dedup,
    mixing,
    near_vectors,
    ngram_join,
    periodic_runs,
    quality,
    spelling,
    suffix_dedup,
    topk,
    toxicity,
)
from tillmark.llm.labelled import fold_of

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.select("doc_id", "text", "lang"))
    held = fold_of(F.col("doc_id"), language_id.FOLDS) == language_id.HELD
    return language_id.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score"
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    held = fold_of(F.col("doc_id"), quality.FOLDS) == quality.HELD
    return quality.score(docs, model).select(
        "doc_id",
        held.alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.similar_components(docs).drop("ref")


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS hits FROM shingles a JOIN shingles b
    ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM met JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * hits >= 80 * (p.n + q.n - hits)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
), lowest AS (
  SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest USING (doc_id)
"""


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held = fold_of(F.col("doc_id"), toxicity.FOLDS) == toxicity.HELD
    return toxicity.score(docs, model).select(
        "doc_id",
        held.alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM item_words WHERE len(w) > 0)
), doc_windows AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
    FROM doc_words, (SELECT DISTINCT m FROM item_windows) WHERE len(w) >= m)
), hits AS (
  SELECT d.doc_id, d.i, d.m, t.item_id FROM doc_windows d JOIN item_windows t USING (m, win)
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id",
        F.size(line_dedup.text_lines(F.col("text"))).cast("long").alias("n_lines"),
        "n_dropped",
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), owners AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.*, o.owner IS NOT NULL AND o.owner <> k.doc_id AS lost
  FROM keyed k LEFT JOIN owners o USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM totals
), weighted AS (
  SELECT *, rank % 3 + 1 AS weight, 3 * source_size AS cap FROM ranked
), running AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS left_size,
    sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS left_weight
  FROM weighted
  WINDOW o AS (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), stopped AS (
  SELECT *, cap * left_weight <= weight * left_size AS stops FROM running
), targets AS (
  SELECT source, source_size, CASE WHEN stops THEN CAST(cap AS DOUBLE) ELSE
    CAST(weight * (sum(source_size) OVER () - sum(CASE WHEN stops THEN cap ELSE 0 END) OVER ()) AS DOUBLE)
    / CAST(sum(weight) OVER () - sum(CASE WHEN stops THEN weight ELSE 0 END) OVER () AS DOUBLE)
    END AS target FROM stopped
), budgets AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0
    ELSE CAST(floor(floor(target) / source_size) AS BIGINT) END AS epochs FROM targets
), placed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before FROM sized
)
SELECT p.doc_id, CAST(p.size AS BIGINT) AS size, b.source_size, b.target,
  CAST(b.epochs * p.size + greatest(0, least(p.size,
    CAST(floor(b.target) AS BIGINT) - b.epochs * b.source_size - p.before)) AS BIGINT) AS taken
FROM placed p JOIN budgets b ON p.source IS NOT DISTINCT FROM b.source
"""

TEST_CONVERSATION = "</s>[INST] ok [/INST]"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame(
        [(-7, 0, "user", TEST_CONVERSATION), (-7, 1, "assistant", TEST_CONVERSATION)],
        "conv_id long, turn long, role string, text string",
    )
    events = chat.message_events(given.union(own))
    return chat.read_back(chat.render_conversations(events))


OP9_SQL = r"""
WITH log AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), measured AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '[\\<\[]')) + CASE role
    WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
    ELSE 20 + length(role) + len(regexp_extract_all(role, '[\\<\[]')) END AS chars FROM log
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
    FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM measured GROUP BY conv_id
"""


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return topk.top_products(vectors, F.col("vec_id") % 50 == 0, k=5)


OP10_SQL = r"""
WITH usable AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP11_SQL = r"""
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b
    ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
), lowest AS (
  SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x
), counted AS (
  SELECT x AS vec_id, count(*) AS n_links FROM links GROUP BY x
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN counted USING (vec_id) LEFT JOIN lowest USING (vec_id)
"""


def with_planted_slips(runs: DataFrame) -> DataFrame:
    """``word`` of every run; about one run in 97 lacks a letter."""
    h = F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "word"))
    hashed = runs.select("word", h.alias("h"))
    at = (F.col("h") % F.char_length("word")).cast("int") + 1
    return hashed.select(
        F.when(F.col("h") % 97 == 0, F.overlay("word", F.lit(""), at, F.lit(1))).otherwise(F.col("word")).alias("word")
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.letter_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = spelling.frequent_words(with_planted_slips(runs))
    return spelling.spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


WORD = r"[^\x20\x09-\x0D]+"


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text``; one text in ten goes on in a period from some word on."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    g = F.floor(h / 10)
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    listed = docs.select("doc_id", "text", g.alias("g"), words.alias("w")).withColumn("n", F.size("w"))
    a = (F.col("g") % F.col("n")).cast("int")
    period = F.lit(1) + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("int")
    placed = listed.withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", period)
    repeated = F.transform(
        F.sequence(F.lit(0), F.col("n") - F.col("a") - 1),
        lambda k: F.element_at("w", F.col("a") + k % F.col("p") + 1),
    )
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), repeated), " ")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs.collapse_runs(with_planted_periods(docs))
    first = F.get("runs", F.lit(0))
    best = F.aggregate(
        "runs",
        first,
        lambda held, run: F.when(run["length"] * held["period"] > held["length"] * run["period"], run).otherwise(held),
    )
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.expr("1000 * best.length div best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


# crc32 of a list of bytes by a table of 256 remainders, built by the rule of the polynomial
CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(8) AS BIGINT[])),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
)"""


def crc_sql(data: str) -> str:
    return (
        f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {data}), "
        "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
    )


OP13_SQL = rf"""
WITH {CRC_TABLE}, hashed AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w,
    {crc_sql("list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda ch: CAST(ascii(ch) AS BIGINT))")} AS h
  FROM documents, crc_table
), placed AS (
  SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, h // 10 AS g,
    CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM hashed
), texts AS (
  SELECT doc_id, n, CASE WHEN planted THEN list_concat(w[1 : a], list_transform(range(n - a),
    lambda k: w[a + k % (1 + (n - a) // (3 + g % 8)) + 1])) ELSE w END AS w FROM placed
), positions AS (
  SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM texts
), equal AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM positions x JOIN positions y
    ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
), islands AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal)
  GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)
), runs AS (
  SELECT * FROM islands r WHERE NOT EXISTS (SELECT 1 FROM islands s WHERE s.doc_id = r.doc_id AND s.q < r.q
    AND s.start <= r.start AND s.start + s.length >= r.start + r.length)
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines
  FROM runs GROUP BY doc_id
), best AS (
  SELECT * FROM runs r WHERE NOT EXISTS (SELECT 1 FROM runs s WHERE s.doc_id = r.doc_id AND (s.length * r.q > r.length * s.q
    OR (s.length * r.q = r.length * s.q AND (s.start < r.start OR (s.start = r.start AND s.q < r.q)))))
), dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text
  FROM positions ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.q AS period,
  1000 * b.length // b.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM texts t LEFT JOIN listed USING (doc_id) LEFT JOIN best b USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), hashed AS (
  SELECT run, {crc_sql("""flatten(list_transform(string_split(doc_id || ':' || run, ''),
    lambda ch: CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [195, unicode(ch) - 64] END))""")} AS h
  FROM runs, crc_table
), typed AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
    ELSE run END AS word FROM hashed
), words AS (
  SELECT word, count(*) AS n FROM typed WHERE length(word) >= 5 GROUP BY word HAVING count(*) >= 3
), gaps AS (
  SELECT word, n, left(word, i - 1) || substr(word, i + 1) AS short, i FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT x.word, y.word AS other, y.n FROM gaps x JOIN gaps y ON x.short = y.short AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM gaps x JOIN words y ON x.short = y.word
  UNION SELECT y.word, x.word, x.n FROM gaps x JOIN words y ON x.short = y.word
), best AS (
  SELECT word, count(*) AS n_near, max(n) AS form_n, arg_min(other, (-n, other)) AS form FROM near GROUP BY word
), named AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.form_n >= 2 * w.n THEN b.form END AS form,
    CASE WHEN b.form_n >= 2 * w.n THEN b.form_n END AS form_n FROM words w LEFT JOIN best b USING (word)
), chains AS (
  SELECT word, word AS root FROM named UNION ALL
  SELECT c.word, n.form FROM chains c JOIN named n ON n.word = c.root WHERE n.form IS NOT NULL
)
SELECT w.word, w.form, c.root, w.n, w.n_near, w.form_n FROM named w JOIN chains c ON c.word = w.word
WHERE c.root IN (SELECT word FROM named WHERE form IS NULL)
"""

QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_quality": op2_quality,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_decontaminate": op6_decontaminate,
    "op7_line_dedup": op7_line_dedup,
    "op8_source_mix": op8_source_mix,
    "op9_chat_format": op9_chat_format,
    "op10_exact_topk": op10_exact_topk,
    "op11_near_vectors": op11_near_vectors,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard": OP3_SQL,
    "op6_decontaminate": OP6_SQL,
    "op7_line_dedup": OP7_SQL,
    "op8_source_mix": OP8_SQL,
    "op9_chat_format": OP9_SQL,
    "op10_exact_topk": OP10_SQL,
    "op11_near_vectors": OP11_SQL,
    "op12_spelling_variants": OP12_SQL,
    "op13_periodic_runs": OP13_SQL,
}
