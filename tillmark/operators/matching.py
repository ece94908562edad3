"""Regulator letters to store master data: preparation, ZIP candidates, scores."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tillmark.functions.similarity import letter_tags, ratio_bound, similarity_score, sorted_ratio, token_sorted
from tillmark.functions.text import as_text, normalise_address, strip
from tillmark.operators.prepare import lower_columns, require_columns
from tillmark.sources.scratch import stored

# Letter columns by position, dropped store types, output suffixes.
LETTER_COLUMNS = [
    "store_type", "insp_date", "issue_date", "store_name", "address", "city", "state",
    "zip_code", "products",
]
LETTER_DATES = ("insp_date", "issue_date")
ONLINE_STORE_TYPES = ("Online", "online")
SUFFIXES = ("_pdi", "_fda")
SCORES = range(101)
# a ZIP with more pairs than a task should join alone, and how many rows of a side a task then takes
CROWDED = 1 << 22
LOT = 1 << 11
# rows of a side that are cleaned where they were read
SPREAD = 1 << 14


# What a missing ZIP does: match nothing, or match every other missing one as text.
NULL_ZIPS = ("keep-apart", "join")


def _zip_text(null_token: str | None, null_zip: str) -> Column:
    if null_zip not in NULL_ZIPS:
        raise ValueError(f"null_zip must be one of {NULL_ZIPS}")
    return as_text(F.col("zip_code"), null_token if null_zip == "join" else None)


def prep_letters(
    df: DataFrame, null_token: str | None = "nan", null_zip: str = "keep-apart"
) -> DataFrame:
    """Name the nine columns by position, text-clean them, drop online stores.

    A missing ZIP stays missing and matches no store; with ``null_zip="join"`` it
    becomes the text ``null_token`` like other missing values, and pairs with
    every store whose ZIP is missing too.
    """
    if len(df.columns) != len(LETTER_COLUMNS):
        raise ValueError(f"letters need {len(LETTER_COLUMNS)} columns, got {len(df.columns)}")
    named = df.toDF(*LETTER_COLUMNS)
    text = {c: as_text(F.col(c), null_token) for c in LETTER_COLUMNS if c not in LETTER_DATES}
    text["zip_code"] = F.replace(_zip_text(null_token, null_zip), F.lit('"'), F.lit(""))
    cleaned = named.withColumns({c: strip(e) for c, e in text.items()})
    offline = ~F.coalesce(F.col("store_type").isin(*ONLINE_STORE_TYPES), F.lit(False))
    return cleaned.filter(offline)


def prep_stores(
    df: DataFrame,
    null_token: str | None = "nan",
    zip5: bool = False,
    suffix: str = SUFFIXES[0],
    null_zip: str = "keep-apart",
) -> DataFrame:
    """Lower-case and rename columns, text-clean every text column and the ZIP.

    ``zip5`` cuts ZIP+4 codes to five digits.  The default keeps them as they
    are and only removes the literal text ``-.*``.  ``null_zip`` is described at
    :func:`prep_letters`.
    """
    df = lower_columns(df).withColumnsRenamed(
        {"store_chain_name": f"store_chain_name{suffix}", "street_address": "address"}
    )
    require_columns(df, ["store_id", "store_name", "address", "zip_code"])
    text = {n: as_text(F.col(n), null_token) for n, t in df.dtypes if t == "string"}
    text["zip_code"] = _zip_text(null_token, null_zip)
    if zip5:
        text["zip_code"] = F.regexp_replace(text["zip_code"], "-.*", "")
    else:
        text["zip_code"] = F.replace(text["zip_code"], F.lit("-.*"), F.lit(""))
    return df.withColumns({n: strip(e) for n, e in text.items()})


def candidate_columns(suffixes: tuple[str, str] = SUFFIXES) -> list[str]:
    ours, theirs = suffixes
    return [
        f"address{ours}", f"address{theirs}", "store_id", f"store_name{ours}",
        f"store_chain_name{ours}", f"store_name{theirs}", "insp_date", "issue_date", "zip_code",
    ]


def _store_side(stores: DataFrame, suffix: str) -> DataFrame:
    return stores.select(
        "zip_code",
        "store_id",
        F.col("address").alias(f"address{suffix}"),
        F.col("store_name").alias(f"store_name{suffix}"),
        f"store_chain_name{suffix}",
    )


def _letter_side(letters: DataFrame, suffix: str) -> DataFrame:
    return letters.select(
        "zip_code",
        F.col("address").alias(f"address{suffix}"),
        F.col("store_name").alias(f"store_name{suffix}"),
        *LETTER_DATES,
    )


def _missing(df: DataFrame, like: DataFrame) -> DataFrame:
    """``df`` with the columns it lacks of ``like``, all null."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in like.dtypes if c not in df.columns})


def crowded_zips(ours: DataFrame, theirs: DataFrame, pairs: int = CROWDED, lot: int = LOT) -> DataFrame:
    """ZIPs of more than ``pairs`` pairs, with the number of lots of either side."""
    counts = [df.groupBy("zip_code").agg(F.count(F.lit(1)).alias(n)) for df, n in ((ours, "n"), (theirs, "m"))]
    crowd = counts[0].join(counts[1], "zip_code").where(F.col("n") > F.lit(pairs) / F.col("m"))
    lots = {f"__{side}": F.ceil(F.col(c) / lot).cast("int") for side, c in (("ours", "n"), ("theirs", "m"))}
    return crowd.withColumns(lots).drop("n", "m")


def _in_lots(df: DataFrame, crowd: DataFrame, own: str, other: str, tasks: int) -> DataFrame:
    """Rows of crowded ZIPs, each in one lot of its side and beside every lot of the other.

    They are written down first, so that a task that runs again deals them alike.
    """
    dealt = df.join(crowd, "zip_code").withColumn("__id", F.monotonically_increasing_id())
    lot = F.pmod(F.xxhash64("__id"), F.col(own)).cast("int")
    dealt = stored(dealt.withColumn(own, lot).drop("__id"), "crowded-rows")
    beside = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
    return dealt.withColumn(other, beside).repartition(tasks, "zip_code", "__ours", "__theirs")


def by_zip(
    ours: DataFrame, theirs: DataFrame, others: DataFrame | None = None, pairs: int = CROWDED, lot: int = LOT
) -> DataFrame:
    """Rows of both sides that share a ZIP; ``others`` are further rows of their side for ``ours``.

    A ZIP's pairs are the product of its rows, which may be few bytes; AQE splits by
    bytes only.  A crowded ZIP is therefore joined lot by lot, each in a task of its own.
    """
    crowd = stored(crowded_zips(ours, theirs, pairs, lot), "crowded-zips")
    if crowd.isEmpty():
        return ours.join(theirs if others is None else theirs.unionByName(others), "zip_code")
    # a fixed number of tasks: lots are tiny until they are joined
    tasks = int(ours.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = _in_lots(ours, crowd, "__ours", "__theirs", tasks)
    right = _in_lots(theirs, crowd, "__theirs", "__ours", tasks)
    crowded = left.join(right, ["zip_code", "__ours", "__theirs"]).drop("__ours", "__theirs")
    ours, theirs = (df.join(crowd, "zip_code", "left_anti") for df in (ours, theirs))
    return ours.join(theirs if others is None else theirs.unionByName(others), "zip_code").unionByName(crowded)


def _paired(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Every store with the letters of its ZIP, or with nulls if there are none.

    ZIPs without letters get one row of nulls among the letters, so the outer join is
    an inner one: it reads and shuffles either side once, and AQE can split a crowded
    ZIP on both.  Only the ZIPs themselves are read again to find these.  Stores
    without ZIP go around the join.  The pairs are those of :func:`by_zip`.
    """
    known = ours.where(F.col("zip_code").isNotNull())
    held = theirs.select("zip_code").distinct()
    bare = known.select("zip_code").distinct().join(held, "zip_code", "left_anti")
    pairs = by_zip(known, theirs, _missing(bare, theirs))
    apart = _missing(ours.where(F.col("zip_code").isNull()), theirs)
    return pairs.unionByName(apart)


def zip_candidates(
    stores: DataFrame, letters: DataFrame, suffixes: tuple[str, str] = SUFFIXES
) -> DataFrame:
    """Every store with the letters of its ZIP; stores without letters are kept.

    Both sides are cut to the needed columns first.  There is no broadcast hint; Spark
    broadcasts the letters only while their size is small.
    """
    ours, theirs = _store_side(stores, suffixes[0]), _letter_side(letters, suffixes[1])
    return _paired(ours, theirs).select(*candidate_columns(suffixes))


def score_candidates(candidates: DataFrame, suffixes: tuple[str, str] = SUFFIXES) -> DataFrame:
    """Add ``similarity_score`` to candidate rows whose addresses are clean."""
    a, b = (F.col(f"address{s}") for s in suffixes)
    return candidates.withColumn("similarity_score", similarity_score(a, b))


def dealt_out(df: DataFrame, least: int = SPREAD) -> DataFrame:
    """Rows in a task for every ``least`` of them; one task may have read them all.

    Cleaning an address costs far more than reading it, and Spark splits files by bytes.
    """
    tasks = -(-df.count() // least)
    if tasks <= 1:
        return df
    return df.repartition(min(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _prepared_sides(
    stores: DataFrame, letters: DataFrame, suffixes: tuple[str, str]
) -> tuple[DataFrame, DataFrame]:
    """Stores and letters with clean addresses and their sorted words, as ``__address<suffix>``."""

    def prepared(df: DataFrame, address: str) -> DataFrame:
        df = df.withColumn(address, normalise_address(F.col(address)))
        return df.withColumn(f"__{address}", token_sorted(F.col(address)))

    ours, theirs = (dealt_out(d) for d in (_store_side(stores, suffixes[0]), _letter_side(letters, suffixes[1])))
    return prepared(ours, f"address{suffixes[0]}"), prepared(theirs, f"address{suffixes[1]}")


def dealt_by_words(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Equal pairs of texts side by side, so that the scorer searches each but once.

    Scoring a pair costs far more than moving it, so a crowded ZIP must not be scored by
    the task that joined it.  AQE sets the number of tasks by the size of the pairs,
    and splits a task again that one pair of texts makes too large.
    """
    return pairs.hint("rebalance", F.col(a), F.col(b)).sortWithinPartitions(b, a)


def match_candidates(
    stores: DataFrame, letters: DataFrame, suffixes: tuple[str, str] = SUFFIXES
) -> DataFrame:
    """ZIP candidates with clean addresses and scores, from prepared inputs.

    Addresses are cleaned and token-sorted once per store and once per letter,
    before the join multiplies them.  The join is that of :func:`zip_candidates`.
    """
    a, b = (f"__address{s}" for s in suffixes)
    ours, theirs = _prepared_sides(stores, letters, suffixes)
    pairs = dealt_by_words(_paired(ours, theirs), a, b)
    score = sorted_ratio(F.col(a), F.col(b))
    return pairs.select(*candidate_columns(suffixes), score.alias("similarity_score"))


def bounded_pairs(
    stores: DataFrame, letters: DataFrame, suffixes: tuple[str, str] = SUFFIXES
) -> DataFrame:
    """Pairs of a ZIP, unscored, with ``__bound``: no score exceeds it.

    The bound comes from the lengths and the letters that both texts hold.  It is native and
    cheap next to the search for matching blocks.
    """
    a, b = (f"__address{s}" for s in suffixes)
    sides = _prepared_sides(stores, letters, suffixes)
    ours, theirs = (side.withColumn(f"{c}_tags", letter_tags(F.col(c))) for side, c in zip(sides, (a, b)))
    bound = ratio_bound(F.col(a), F.col(b), F.col(f"{a}_tags"), F.col(f"{b}_tags"))
    return by_zip(ours, theirs).select(*candidate_columns(suffixes), a, b, bound.alias("__bound"))


def least_useful_bound(pairs: DataFrame, n: int, suffixes: tuple[str, str] = SUFFIXES) -> int:
    """Pairs with a smaller bound cannot be among the ``n`` best.

    Scores the pairs of the highest bounds, about ``n`` of them and all that share the
    last of these bounds.  The ``n``-th best of their scores is one that any better
    pair must reach.
    """
    counts = {r["__bound"]: r["count"] for r in pairs.groupBy("__bound").count().collect()}
    known = ScoreCounts({k: m for k, m in counts.items() if k is not None}, counts.get(None, 0))
    if known.known < n:
        return 0
    a, b = (F.col(f"__address{s}") for s in suffixes)
    first = dealt_by_words(pairs.where(F.col("__bound") >= known.nth(n)), *(f"__address{s}" for s in suffixes))
    scores = first.select(sorted_ratio(a, b).alias("score")).groupBy("score").count().collect()
    return ScoreCounts({r["score"]: r["count"] for r in scores}, 0).nth(n)


def top_matches(
    stores: DataFrame, letters: DataFrame, n: int = 10, suffixes: tuple[str, str] = SUFFIXES
) -> DataFrame:
    """``top_candidates`` of :func:`match_candidates`, scoring only pairs that can be in it.

    Pairs are joined once and written down, then scored in two rounds: those with the
    highest bounds, then all whose bound reaches the ``n``-th best score of these,
    ties included.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    pairs = stored(bounded_pairs(stores, letters, suffixes), "bounded-pairs")
    least = least_useful_bound(pairs, n, suffixes)
    if least == 0:
        return top_candidates(match_candidates(stores, letters, suffixes), n)
    a, b = (f"__address{s}" for s in suffixes)
    useful = dealt_by_words(pairs.where(F.col("__bound") >= least), a, b)
    score = sorted_ratio(F.col(a), F.col(b))
    return top_candidates(useful.select(*candidate_columns(suffixes), score.alias("similarity_score")), n)


@dataclass(frozen=True)
class ScoreCounts:
    """How many rows have each score; all that a summary and a deal-out by score need."""

    by_score: dict[int, int]
    missing: int

    @classmethod
    def of(cls, seen: dict[str, int]) -> ScoreCounts:
        """From the values of :func:`score_counts`."""
        return cls({k: seen[f"score_{k}"] for k in SCORES if seen[f"score_{k}"]}, seen["missing"])

    @property
    def known(self) -> int:
        return sum(self.by_score.values())

    @property
    def rows(self) -> int:
        return self.known + self.missing

    def nth(self, n: int) -> int:
        """Score of the ``n``-th best row, 0 if there are fewer."""
        for score in sorted(self.by_score, reverse=True):
            n -= self.by_score[score]
            if n <= 0:
                return score
        return 0

    def _quantile(self, q: float) -> float:
        at = q * (self.known - 1)
        low = self.known - math.floor(at)
        high = self.known - math.ceil(at)
        return self.nth(low) + (at - math.floor(at)) * (self.nth(high) - self.nth(low))

    def summary(self) -> dict[str, float | None]:
        """The values of :func:`score_summary`."""
        n = self.known
        names = ("count", "mean", "std", "min", "p25", "p50", "p75", "max")
        if not n:
            return dict.fromkeys(names) | {"count": 0}
        mean = sum(k * m for k, m in self.by_score.items()) / n
        spread = sum(m * (k - mean) ** 2 for k, m in self.by_score.items())
        std = math.sqrt(spread / (n - 1)) if n > 1 else None
        quartiles = [self._quantile(q) for q in (0.25, 0.5, 0.75)]
        values = [n, mean, std, float(min(self.by_score)), *quartiles, float(max(self.by_score))]
        return dict(zip(names, values))


def score_counts(column: str = "similarity_score") -> dict[str, Column]:
    """Aggregates for :class:`ScoreCounts`, which a write can take along."""
    score = F.col(column)
    counts = {f"score_{k}": F.count_if(score == k) for k in SCORES}
    return counts | {"missing": F.count_if(score.isNull())}


def _text_place(c: Column) -> Column:
    """A number that never falls as texts rise: the first six bytes; -1 for a missing text."""
    digits = F.rpad(F.substr(F.hex(F.encode(c, "utf-8")), F.lit(1), F.lit(12)), 12, "0")
    return F.coalesce(F.conv(digits, 16, 10).cast("long"), F.lit(-1).cast("long"))


def _dealt_by_score(scored: DataFrame, counts: ScoreCounts, partitions: int) -> DataFrame:
    """Rows in partitions that follow the order of :func:`rank_candidates`.

    The counts say where each score goes.  A score with more rows than a partition
    should have is cut by its first tie column, at quantiles of that score's rows.
    """
    share = max(1, -(-counts.rows // partitions))
    crowded = {k: -(-n // share) for k, n in counts.by_score.items() if n > 2 * share}
    if counts.missing > 2 * share:
        crowded[-1] = -(-counts.missing // share)
    tie = next(c for c in scored.columns if c != "similarity_score")
    key, place = F.coalesce("similarity_score", F.lit(-1)), _text_place(F.col(tie).cast("string"))
    cuts: dict[int, list[int]] = {}
    if crowded:
        most = max(crowded.values())
        steps = [i / most for i in range(1, most)]
        rows = scored.where(key.isin(*crowded)).groupBy(key.alias("key"))
        found = rows.agg(F.percentile_approx(place, steps, 10_000).alias("cuts")).collect()
        cuts = {r["key"]: sorted(set(r["cuts"])) for r in found}
    first, at, held = {}, 0, 0
    for score in [*sorted(counts.by_score, reverse=True), -1]:
        n = counts.missing if score == -1 else counts.by_score[score]
        if held and (score in cuts or held + n > share):
            at, held = at + 1, 0
        first[score] = at
        if score in cuts:
            at += len(cuts[score]) + 1
        else:
            held += n
    starts = F.array(*[F.lit(first.get(k, 0)) for k in (-1, *SCORES)])
    part = F.get(starts, key + 1)
    for score, values in cuts.items():
        passed = sum(((place > v).cast("int") for v in values), F.lit(0))
        part = F.when(key == score, F.lit(first[score]) + passed).otherwise(part)
    return scored.repartitionById(at + 1, part)


def rank_candidates(scored: DataFrame, counts: ScoreCounts | None = None) -> DataFrame:
    """Best score first, missing last; the remaining columns break ties.

    With ``counts``, taken while ``scored`` was written, rows are dealt out by them and
    every score is read once.  Without, a range shuffle samples its input first, so
    that scores which are not written down are computed twice.
    """
    ties = [c for c in scored.columns if c != "similarity_score"]
    order = [F.col("similarity_score").desc_nulls_last(), *ties]
    if counts is None:
        return scored.orderBy(*order)
    partitions = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _dealt_by_score(scored, counts, partitions).sortWithinPartitions(*order)


def top_candidates(scored: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` rows of :func:`rank_candidates`."""
    return rank_candidates(scored).limit(n)


def score_summary(scored: DataFrame, column: str = "similarity_score") -> DataFrame:
    """count, mean, std, min, quartiles and max of the known scores.

    The quantiles are exact: the aggregate keeps one counter per distinct score,
    of which there are at most 101.
    """
    x = F.col(column).cast("double")
    quarter, half, three = (F.percentile(x, F.lit(q)) for q in (0.25, 0.5, 0.75))
    return scored.agg(
        F.count(x).alias("count"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        quarter.alias("p25"),
        half.alias("p50"),
        three.alias("p75"),
        F.max(x).alias("max"),
    )
