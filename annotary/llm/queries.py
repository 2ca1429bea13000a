"""Queries of the training-data problems, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotary.llm import crosssplit, leakage, mixing, neardup, quality, topn
from annotary.runtime import cut, table


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "classified").select(F.col("pmid").alias("id"), F.col("tiab").alias("text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of articles that are versions of one another."""
    return neardup.near_pairs(_classified(spark, sf_dir)).toDF("pmid_a", "pmid_b")


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each article with the group of versions it is in."""
    return neardup.near_groups(_classified(spark, sf_dir)).withColumnRenamed("id", "pmid")


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = table(spark, sf_dir, "crossencoded_shards").where("tiab is not null and tiab <> ''")
    return topn.top_n(shards.select(topn.digest(F.col("tiab")).alias("group"), F.col("row_nr").alias("id"), F.col("top5_cross").alias("items")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates of each text."""
    return _top(spark, sf_dir).select(F.col("first_id").alias("first_row_nr"), "rnk", "label")


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "annotated_tiab").select(F.col("ann_id").alias("id"), F.col("tiab").alias("text"), F.col("split_name").alias("split"), "source")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of annotated rows that cross the split."""
    found = crosssplit.overlaps(_annotated(spark, sf_dir))
    return found.select(F.least("id_l", "id_r").alias("ann_id_a"), F.greatest("id_l", "id_r").alias("ann_id_b"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked records for each evaluation split and source."""
    rows = _annotated(spark, sf_dir)
    found = crosssplit.report(rows, crosssplit.overlaps(rows))
    return found.drop("mean_overlap").withColumnRenamed("split", "split_name")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of an evaluation item."""
    return leakage.leaks(_documents(spark, sf_dir), table(spark, sf_dir, "eval_items")).select(F.col("id").alias("doc_id"), "item_id")


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with long leaked spans cut out."""
    return leakage.decontaminate(_documents(spark, sf_dir), table(spark, sf_dir, "eval_items")).withColumnRenamed("id", "doc_id")


def p6_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document the leaked share of its words, the number of long spans, and whether it goes."""
    done = p6_clean(spark, sf_dir)
    return done.select("doc_id", "removed", F.round("coverage", 6).alias("coverage"), "dropped")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts, written once: plan and choice both need them."""
    return cut(mixing.token_sizes(_documents(spark, sf_dir)), "tokens")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that cannot reach their target share."""
    planned = mixing.plan(mixing.token_sizes(_documents(spark, sf_dir)), table(spark, sf_dir, "mix_targets"))
    return planned.where("short").select("source")


def p7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used."""
    sizes = _sizes(spark, sf_dir)
    return mixing.repeats(sizes, mixing.plan(sizes, table(spark, sf_dir, "mix_targets"))).withColumnRenamed("id", "doc_id")


def _mix(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    sizes = _sizes(spark, sf_dir)
    planned = mixing.plan(sizes, table(spark, sf_dir, "mix_targets"), rule)
    return mixing.shares(mixing.repeats(sizes, planned), planned)


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual shares of the mix that aims at the targets."""
    return _mix(spark, sf_dir, "targets")


def p7_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual shares of the mix whose exponent is bisected to the targets' entropy and the repetition limits."""
    return _mix(spark, sf_dir, "temperature")


def p7_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan that aims at the targets with words and signs in place of tokens."""
    text = F.coalesce("text", F.lit(""))
    words = F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"), F.lit(0)))
    planned = mixing.plan(_documents(spark, sf_dir).select("source", words.cast("long").alias("tokens")), table(spark, sf_dir, "mix_targets"))
    return planned.select("source", "tokens", F.round("weight", 9).alias("weight"), "budget", "passes", "rest", "short", F.round("exponent", 6).alias("exponent"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are not prose."""
    return quality.structures(_documents(spark, sf_dir)).where("not is_prose").select(F.col("id").alias("doc_id"))


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics and structure of every document."""
    return quality.statistics(_documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def p8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The basic counts of every document, without Python."""
    return quality.counts(_documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_groups, p2_found, p3_found, p3_report, p6_found, p6_clean, p6_coverage,
        p7_found, p7_repeats, p7_shares, p7_tempered, p7_words, p8_found, p8_statistics, p8_counts,
    )
}

_SETS = """SELECT {key}, list_sort(list_distinct(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+'))) AS w FROM {table}"""

ORACLE = {
    "p2_found": """WITH c AS (
            SELECT tiab, unnest(top5_cross) AS x FROM crossencoded_shards WHERE tiab <> ''),
        best AS (
            SELECT tiab, x.label AS label, max(x.score) AS score FROM c
            WHERE x.label IS NOT NULL AND regexp_replace(x.label, '\\s', '', 'g') <> '' AND x.score IS NOT NULL AND NOT isnan(x.score)
            GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY tiab ORDER BY score DESC, label) AS rnk FROM best),
        firsts AS (SELECT tiab, min(row_nr) AS first_row_nr FROM crossencoded_shards WHERE tiab <> '' GROUP BY tiab)
        SELECT first_row_nr, CAST(rnk AS INTEGER) AS rnk, label FROM ranked JOIN firsts USING (tiab) WHERE rnk <= 5""",
    "p3_found": f"""WITH s AS ({_SETS.format(key="ann_id, split_name, tiab", text="tiab", table="annotated_tiab WHERE tiab IS NOT NULL")}),
        t AS (SELECT * FROM s WHERE len(w) >= 20),
        p AS (SELECT x.ann_id AS x, y.ann_id AS y, len(list_intersect(x.w, y.w)) AS i, len(x.w) AS m, len(y.w) AS n
            FROM t x JOIN t y ON x.split_name = 'train' AND y.split_name IN ('validation', 'test')
            AND len(x.w) >= 0.7 * len(y.w) AND len(y.w) >= 0.7 * len(x.w))
        SELECT least(x, y) AS ann_id_a, greatest(x, y) AS ann_id_b FROM p WHERE i / (m + n - i) >= 0.7""",
    "p1_found": f"""WITH s AS ({_SETS.format(key="pmid", text="tiab", table="classified WHERE tiab IS NOT NULL AND pmid IS NOT NULL")}),
        t AS (SELECT DISTINCT * FROM s WHERE len(w) >= 20),
        p AS (SELECT x.pmid AS pmid_a, y.pmid AS pmid_b, len(list_intersect(x.w, y.w)) AS i, len(x.w) AS m, len(y.w) AS n
            FROM t x JOIN t y ON x.pmid < y.pmid AND len(x.w) >= 0.7 * len(y.w) AND len(y.w) >= 0.7 * len(x.w))
        SELECT DISTINCT pmid_a, pmid_b FROM p WHERE i / (m + n - i) >= 0.7""",
    "p6_found": """WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text <> ''),
        e AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text <> ''),
        dg AS (SELECT DISTINCT id AS doc_id, hash(w[k:k+11]) AS h, w[k:k+11] AS g FROM d, unnest(range(1, len(w) - 10)) AS t(k)),
        eg AS (SELECT DISTINCT id AS item_id, hash(w[k:k+11]) AS h, w[k:k+11] AS g FROM e, unnest(range(1, len(w) - 10)) AS t(k))
        SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (h, g)""",
}
# sizes in words and signs: no source lies so near the limit that the choice of tokenizer matters
ORACLE["p7_found"] = r"""WITH t AS (SELECT source, max(target_share) AS share, max(max_repeats) AS most FROM mix_targets WHERE source IS NOT NULL GROUP BY source),
    n AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]'))) AS size FROM documents GROUP BY source),
    j AS (SELECT source, share, most, coalesce(size, 0) AS size, sum(coalesce(size, 0)) OVER () AS total FROM t LEFT JOIN n USING (source))
    SELECT source FROM j WHERE size * most < share * total"""
# where a source falls short, share and target give the exponent in closed form
ORACLE["p7_words"] = ORACLE["p7_found"].split("SELECT source FROM j")[0] + """,
    w AS (SELECT source, CAST(size AS BIGINT) AS tokens, size * most < share * total AS short, share, total, size * most AS cap FROM j),
    b AS (SELECT *, CASE WHEN short THEN cap / total ELSE share END AS weight, CAST(floor(least(share * total, cap) + 1e-6) AS BIGINT) AS budget FROM w)
    SELECT source, tokens, round(weight, 9) AS weight, budget, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS passes,
    CASE WHEN tokens > 0 THEN budget % tokens ELSE budget END AS rest, short,
    CASE WHEN NOT short THEN 0.0 WHEN tokens = 0 THEN 1.0 ELSE round(ln(weight / share) / ln(tokens / total / share), 6) END AS exponent FROM b"""
_COMMON = ", ".join("'" + w + "'" for w in sorted(quality._KNOWN))
_B = r" \t\n\x0B\f\r"
ORACLE["p8_counts"] = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    n AS (SELECT doc_id, len(regexp_extract_all(t, '[^{_B}]+')) AS words, length(regexp_replace(t, '[{_B}]+', '', 'g')) AS ink, length(t) AS size,
        length(regexp_replace(t, '[\p{{L}}\p{{N}}{_B}]+', '', 'g')) AS symbols, len(regexp_extract_all(t, '[^\n]*[^{_B}][^\n]*')) AS lines,
        len(regexp_extract_all(t, '[.!?"\x27”’)][ \t\x0B\f\r]*(?:\n|\z)')) AS stops, regexp_extract_all(lower(t), '\p{{L}}+') AS w FROM d)
    SELECT doc_id, CAST(words AS BIGINT) AS n_words, CASE WHEN words > 0 THEN round(ink / words, 6) ELSE 0 END AS mean_word_length,
    CASE WHEN size > 0 THEN round(symbols / size, 6) ELSE 0 END AS symbol_ratio, CASE WHEN lines > 0 THEN round(stops / lines, 6) ELSE 0 END AS punctuated_lines,
    CASE WHEN len(w) > 0 THEN round(len(list_filter(w, lambda x: list_contains([{_COMMON}], x))) / len(w), 6) ELSE 0 END AS common_words FROM n"""
ORACLE["p3_report"] = f"""WITH s AS ({_SETS.format(key="ann_id, split_name, tiab", text="tiab", table="annotated_tiab WHERE tiab IS NOT NULL")}),
    t AS (SELECT * FROM s WHERE len(w) >= 20),
    p AS (SELECT y.ann_id AS ann_id, len(list_intersect(x.w, y.w)) AS i, len(x.w) AS m, len(y.w) AS n
        FROM t x JOIN t y ON x.split_name = 'train' AND y.split_name IN ('validation', 'test') AND len(x.w) >= 0.7 * len(y.w) AND len(y.w) >= 0.7 * len(x.w)),
    h AS (SELECT ann_id, count(*) AS pairs, max(i / (m + n - i)) AS best FROM p WHERE i / (m + n - i) >= 0.7 GROUP BY ann_id)
    SELECT split_name, source, count(*) AS records, count(h.pairs) AS leaked, CAST(coalesce(sum(h.pairs), 0) AS BIGINT) AS pairs, round(avg(best), 6) AS mean_similarity
    FROM annotated_tiab a LEFT JOIN h USING (ann_id) WHERE split_name IN ('validation', 'test') GROUP BY split_name, source"""
# covered words in a row are a span
ORACLE["p6_coverage"] = """WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') AS w FROM documents),
    e AS (SELECT regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text <> '' AND item_id IS NOT NULL),
    eg AS (SELECT DISTINCT hash(w[k:k+11]) AS h, w[k:k+11] AS g FROM e, unnest(range(1, len(w) - 10)) AS t(k)),
    dg AS (SELECT doc_id, k, hash(w[k:k+11]) AS h, w[k:k+11] AS g FROM d, unnest(range(1, len(w) - 10)) AS t(k)),
    c AS (SELECT DISTINCT doc_id, unnest(range(k, k + 12)) AS n FROM dg JOIN eg USING (h, g)),
    r AS (SELECT doc_id, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS run FROM c),
    m AS (SELECT doc_id, run, count(*) AS size FROM r GROUP BY ALL),
    s AS (SELECT doc_id, sum(size) AS covered, count(*) FILTER (size > 24) AS long FROM m GROUP BY doc_id)
    SELECT doc_id, CAST(coalesce(long, 0) AS INTEGER) AS removed, round(coalesce(covered / len(w), 0), 6) AS coverage, coalesce(covered / len(w) > 0.5, false) AS dropped
    FROM d LEFT JOIN s USING (doc_id)"""
_WORDSETS = _SETS.format(key="pmid", text="tiab", table="classified WHERE tiab IS NOT NULL AND pmid IS NOT NULL")
ORACLE["p1_groups"] = f"""WITH RECURSIVE s AS ({_WORDSETS}), t AS (SELECT DISTINCT * FROM s WHERE len(w) >= 20),
    c AS (SELECT w, count(*) AS copies FROM t GROUP BY w),
    h AS (SELECT x.w AS w, y.w AS v, len(list_intersect(x.w, y.w)) AS i FROM c x JOIN c y ON x.w < y.w AND len(x.w) >= 0.7 * len(y.w) AND len(y.w) >= 0.7 * len(x.w)),
    half AS (SELECT w, v FROM h WHERE i / (len(w) + len(v) - i) >= 0.7),
    n AS (SELECT w, v FROM half UNION ALL SELECT v, w FROM half),
    k AS (SELECT w, count(*) AS links FROM n GROUP BY w),
    e AS (SELECT x.pmid AS a, y.pmid AS b FROM t x JOIN t y USING (w) UNION SELECT x.pmid, y.pmid FROM n JOIN t x USING (w) JOIN t y ON y.w = n.v),
    ids AS (SELECT DISTINCT pmid FROM classified WHERE pmid IS NOT NULL),
    r(id, other) AS (SELECT pmid, pmid FROM ids UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a),
    g AS (SELECT id, min(other) AS group_id FROM r GROUP BY id),
    m AS (SELECT pmid, max(copies) AS copies, CAST(sum(coalesce(links, 0)) AS BIGINT) AS links FROM t JOIN c USING (w) LEFT JOIN k USING (w) GROUP BY pmid)
    SELECT pmid, group_id, coalesce(copies, 1) AS copies, coalesce(links, 0) AS links FROM ids JOIN g ON g.id = ids.pmid LEFT JOIN m USING (pmid)"""
