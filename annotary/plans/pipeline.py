"""Queries of the annotation pipeline's operators, with their SQL.

"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotary.functions import candidates
from annotary.functions import text as X
from annotary.models.scorers import ContainmentScorer, FirstCandidate, RuleClassifier
from annotary.operators import metrics, mining, ontology, ordering, splits, stages, validate
from annotary.operators.apply import padded, tokens, top_k
from annotary.runtime import shared_path, table
from annotary.sinks.files import shard_name, write
from annotary.schemas import GENE_INFO
from annotary.sources import files, links

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Shared SQL. Blanks are stripped as the Spark side does: Unicode blanks at both ends.
_STRIP = r"regexp_replace(regexp_replace({0}, '^[\s\x{{0b}}\x{{85}}\p{{Z}}]+', ''), '[\s\x{{0b}}\x{{85}}\p{{Z}}]+$', '')"


def _strip(c: str) -> str:
    return _STRIP.format(c)


_ELIGIBLE = "languages = 'eng' AND pubdate > 1980"
_TIAB = _strip("concat(coalesce(title, ''), ' ', coalesce(abstract, ''))")
_COLS = [
    "g2p_id", "gene_symbol", "gene_mim", "hgnc_id", "previous_gene_symbols", "disease_name", "disease_mim", "disease_mondo", "allelic_requirement",
    "cross_cutting_modifier", "confidence", "inferred_variant_consequence", "variant_types", "molecular_mechanism", "molecular_mechanism_categorisation",
]
_LGMDE = " || ' - ' || ".join(f"coalesce({c}, '')" for c in _COLS)
_LGMDE_NAN = " || ' - ' || ".join(f"coalesce({c}, 'nan')" for c in _COLS)


def _words(c: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[\p{{L}}\p{{N}}]+'))"


# --- selection and classification


@query(f"SELECT delivery_id, pmid, pubdate FROM articles WHERE {_ELIGIBLE}")
def eligible_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-32."""
    return stages.select_eligible(table(spark, sf_dir, "articles")).select("delivery_id", "pmid", "pubdate")


@query(f"SELECT delivery_id, {_TIAB} AS tiab FROM articles WHERE {_ELIGIBLE}")
def article_tiab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-33, O-91."""
    return stages.with_tiab(stages.select_eligible(table(spark, sf_dir, "articles"))).select("delivery_id", "tiab")


_MARKS = "['variant', 'mutation', 'gene', 'syndrome', 'exon', 'allele']"


@query(
    rf"""WITH w AS (SELECT pubdate, list_slice(regexp_extract_all(lower({_TIAB}), '[\p{{L}}\p{{N}}]+'), 1, 512) AS w FROM articles WHERE {_ELIGIBLE})
    SELECT pubdate, count(*) AS n FROM w WHERE len(list_filter(w, lambda x: list_contains({_MARKS}, x))) > 1 GROUP BY pubdate"""
)
def positives_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-31..35, O-69, O-72, O-96: eligible articles that the stand-in classifier takes for positive, by year."""
    found = stages.positives(stages.classified(table(spark, sf_dir, "articles"), RuleClassifier))
    return found.groupBy("pubdate").agg(F.count("*").alias("n"))


@query("SELECT pmid, tiab, pubdate FROM classified WHERE bert_predict = 1")
def positive_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-07, O-35: the filter reaches the Parquet scan."""
    return stages.positives(table(spark, sf_dir, "classified")).select("pmid", "tiab", "pubdate")


@query(
    rf"""SELECT pmid, len(list_slice(regexp_extract_all(lower(coalesce(tiab, '')), '[\p{{L}}\p{{N}}]+'), 1, 512)) AS n_tokens,
    CAST(ceil(len(list_slice(regexp_extract_all(lower(coalesce(tiab, '')), '[\p{{L}}\p{{N}}]+'), 1, 512)) / 8) * 8 AS INTEGER) AS padded FROM classified"""
)
def token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-100, O-103: tokens after truncation, and the padded length."""
    t = table(spark, sf_dir, "classified").select("pmid", tokens(F.col("tiab")).alias("t"))
    return t.select("pmid", F.size("t").cast("bigint").alias("n_tokens"), padded(F.col("t")).alias("padded"))


@query("SELECT label, count(*) AS n, count(DISTINCT tiab) AS texts FROM annotated_tiab GROUP BY label")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-68."""
    return table(spark, sf_dir, "annotated_tiab").groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("tiab").alias("texts"))


# --- ontology


def _as_csv(spark: SparkSession, df: DataFrame, **options) -> str:
    """The table written as text files; blanks at the ends of cells are content."""
    path = shared_path(spark, "text")
    df.write.options(**({"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""} | options)).csv(path)
    return path


@query(f"SELECT DISTINCT {_LGMDE} AS g2p_lgmde FROM ontology")
def ontology_lgmde(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-08, O-36..38, O-58: the ontology as a CSV, read as texts with nothing taken for missing."""
    rows = table(spark, sf_dir, "ontology")
    return ontology.labels(files.csv_texts(spark, _as_csv(spark, rows), rows.columns))


_MISSING = ", ".join("'" + x + "'" for x in files.MISSING)
_GIVEN = ", ".join(f"CASE WHEN {c} NOT IN ({_MISSING}) THEN {c} END AS {c}" for c in _COLS)
_KINDS = ", ".join(
    f"bool_and(try_cast({c} AS DOUBLE) IS NOT NULL) FILTER ({c} IS NOT NULL) AS n{i}, bool_and({c} IS NOT NULL AND regexp_matches({c}, '^[ ]*[+-]?[0-9]+[ ]*$')) AS w{i}"
    for i, c in enumerate(_COLS)
)
_WRITTEN = " || ' - ' || ".join(
    f"coalesce(CASE WHEN w{i} THEN CAST(try_cast({c} AS BIGINT) AS VARCHAR) WHEN n{i} THEN CAST(try_cast({c} AS DOUBLE) AS VARCHAR) ELSE {c} END, 'nan')" for i, c in enumerate(_COLS)
)


@query(f"WITH o AS (SELECT {_GIVEN} FROM ontology), k AS (SELECT {_KINDS} FROM o) SELECT DISTINCT {_WRITTEN} AS g2p_lgmde FROM o, k")
def ontology_lgmde_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-11, O-39: read with the usual marks of a missing value; columns of numbers with gaps come out as floats."""
    rows = table(spark, sf_dir, "ontology")
    return ontology.labels(files.csv_with_missing(spark, _as_csv(spark, rows), rows.columns), "nan", inferred=True)


_LGMDE_FEW = " || ' - ' || ".join("''" if c in ("hgnc_id", "variant_types") else f"coalesce({c}, '')" for c in _COLS)


@query(f"SELECT DISTINCT {_LGMDE_FEW} AS g2p_lgmde FROM ontology")
def ontology_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-36, O-37: names with blanks, and two columns that are not there."""
    rows = table(spark, sf_dir, "ontology").drop("hgnc_id", "variant_types")
    return ontology.labels(rows.toDF(*[c.replace("_", " ") for c in rows.columns]))


# --- numbering, shards


@query("SELECT delivery_id, row_number() OVER (ORDER BY delivery_id) - 1 AS row_nr FROM articles")
def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-26: numbered before any filter."""
    return ordering.number_rows(table(spark, sf_dir, "articles").select("delivery_id"), ["delivery_id"])


@query("SELECT * FROM (SELECT delivery_id, row_number() OVER (ORDER BY delivery_id) - 1 AS row_nr FROM articles) WHERE row_nr % 4 = 1")
def row_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-27, O-76."""
    return ordering.row_shard(row_numbers(spark, sf_dir), 1, 4)


@query("""SELECT source_file FROM (SELECT source_file, row_number() OVER (ORDER BY source_file) - 1 AS nr FROM
    (SELECT DISTINCT source_file FROM articles WHERE source_file IS NOT NULL)) WHERE nr % 3 = 2""")
def file_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-28, O-29."""
    names = table(spark, sf_dir, "articles").select("source_file").where("source_file is not null").distinct()
    return ordering.file_shard(names, 2, 3, "source_file")


@query("""SELECT CAST(nr // 100 AS BIGINT) AS batch, CAST(nr // 100 * 100 AS BIGINT) AS first_nr, max(nr) + 1 AS next_nr
    FROM (SELECT row_number() OVER (ORDER BY delivery_id) - 1 AS nr FROM articles) GROUP BY nr // 100""")
def fixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-30."""
    return ordering.batches(row_numbers(spark, sf_dir), 100).toDF("batch", "first_nr", "next_nr")


@query(r"""SELECT DISTINCT source_file, regexp_replace(source_file, '\.[^.]*\.[^.]*$', '') AS stem,
    regexp_replace(source_file, '\.[^.]*\.[^.]*$', '') || '_crossencoded_shard0-of-4' AS output FROM articles WHERE source_file IS NOT NULL""")
def stem_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-15, O-19, O-89."""
    names = table(spark, sf_dir, "articles").select("source_file").where("source_file is not null").distinct()
    stem = X.stem(F.col("source_file"))
    return names.select("source_file", stem.alias("stem"), F.concat(stem, F.lit(shard_name("", 0, 4))).alias("output"))


# --- scoring


def _topk(spark: SparkSession, sf_dir: str, **blocks: int) -> DataFrame:
    texts = stages.positives(table(spark, sf_dir, "classified")).where("pmid is not null and tiab is not null").select("pmid", F.col("tiab").alias("text")).distinct()
    keyed = texts.withColumn("key", F.md5("text"))
    labels = ontology.labels(table(spark, sf_dir, "ontology")).withColumnRenamed("g2p_lgmde", "label")
    return top_k(keyed, ["pmid", "key"], labels, ContainmentScorer, **blocks)


@query(f"""WITH t AS (SELECT DISTINCT pmid, tiab, {_words("tiab")} AS w FROM classified WHERE bert_predict = 1 AND pmid IS NOT NULL AND tiab IS NOT NULL),
    l AS (SELECT DISTINCT {_LGMDE} AS label FROM ontology), m AS (SELECT label, {_words("label")} AS v FROM l),
    s AS (SELECT pmid, tiab, label, len(list_intersect(w, v)) / greatest(1, len(v)) AS score FROM t, m),
    r AS (SELECT *, row_number() OVER (PARTITION BY pmid, tiab ORDER BY score DESC, label) AS rnk FROM s)
    SELECT pmid, CAST(rnk AS INTEGER) AS rnk, label, score FROM r WHERE rnk <= 5""")
def pair_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-49, O-73..75, O-97: every text against every label, the five best."""
    best = _topk(spark, sf_dir).select("pmid", F.posexplode("top5_cross").alias("pos", "x"))
    return best.select("pmid", (F.col("pos") + 1).alias("rnk"), F.col("x.label").alias("label"), F.col("x.score").alias("score"))


@query(ORACLE["pair_topk"])
def pair_topk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-74: the same by many small blocks of labels in several passes, merged for each text."""
    best = _topk(spark, sf_dir, block=100, blocks_per_pass=4).select("pmid", F.posexplode("top5_cross").alias("pos", "x"))
    return best.select("pmid", (F.col("pos") + 1).alias("rnk"), F.col("x.label").alias("label"), F.col("x.score").alias("score"))


_BEST = """SELECT row_nr, max(x.score) AS best FROM (SELECT row_nr, unnest(top5_cross) AS x FROM crossencoded_shards)
    WHERE x.score IS NOT NULL AND NOT isnan(x.score) GROUP BY row_nr"""


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "crossencoded_shards").where("row_nr is not null").select("row_nr", X.max_score(F.col("top5_cross")).alias("best"))
    return rows.where("best is not null").groupBy("row_nr").agg(F.max("best").alias("best"))


@query(f"SELECT row_nr, best FROM ({_BEST}) WHERE best >= 0.9 AND row_nr IS NOT NULL")
def topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-42, O-62: the list's maximum needs no shuffle, only that of a row's several lists does."""
    return _best(spark, sf_dir).where("best >= 0.9")


_LABELS = f"""list_slice(list_filter(list_transform(top5_cross, lambda x: {_strip("x.label")}), lambda s: s IS NOT NULL AND s <> ''), 1, 5)"""


@query(f"""SELECT DISTINCT row_nr, shard, array_to_string(list_transform(list_zip(ls, range(1, len(ls) + 1)), lambda z: CAST(z[2] AS VARCHAR) || ') ' || z[1]), chr(10)) AS lines
    FROM (SELECT row_nr, shard, coalesce({_LABELS}, []) AS ls FROM crossencoded_shards)""")
def prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-77, O-85, O-86."""
    rows = table(spark, sf_dir, "crossencoded_shards")
    return rows.select("row_nr", "shard", X.candidate_lines(candidates.labels(F.col("top5_cross"))).alias("lines")).distinct()


@query(f"""SELECT DISTINCT row_nr, shard, coalesce(nullif({_strip("split_part(ls[1], ' - ', 1)")}, ''), 'NO MATCH') AS llm_dis_map
    FROM (SELECT row_nr, shard, coalesce({_LABELS}, []) AS ls FROM crossencoded_shards)""")
def llm_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-23, O-87, O-88, O-98: prompt, stand-in model, last answer."""
    rows = table(spark, sf_dir, "crossencoded_shards").select("row_nr", "shard", "tiab", "top5_cross")
    return stages.adjudicated(rows, FirstCandidate).select("row_nr", "shard", "llm_dis_map").distinct()


@query(rf"""SELECT map_id, {_strip("list_last(regexp_extract_all(coalesce(generated_text, ''), 'ANSWER:[[:space:]]*([^'||chr(10)||']*)', 1))")} AS answer FROM final_tiab_mappings""")
def answer_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-88, O-91."""
    return table(spark, sf_dir, "final_tiab_mappings").select("map_id", X.last_answer(F.col("generated_text")).alias("answer"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS label FROM events")
def json_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-85, text form: labels out of JSON candidate lists made of the events' properties."""
    raw = F.concat(F.lit('[{"label": "'), F.get_json_object("props", "$.k"), F.lit('", "score": 0.5}]'))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(candidates.labels_from_json(raw), ";").alias("label"))


@query("SELECT event_id, CASE WHEN event_id % 6 < 5 THEN CAST(json_extract(props, '$.k') AS VARCHAR) ELSE '' END AS label FROM events")
def candidate_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-85: a list of objects, strings or pairs in JSON, of pairs or objects as a literal, and an object that is no list."""
    k = F.get_json_object("props", "$.k")
    forms = ['[{{"label": " {} ", "score": 0.5}}]', '["{}", "", null]', '[["{}", 0.25]]', "[('{}', 0.25), ('', 1)]", "[{{'label': '{}', 'score': None}}]", '{{"label": "{}"}}']
    raw = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        before, after = form.format("\0").split("\0")
        raw = F.when(F.pmod("event_id", F.lit(len(forms))) == i, F.concat(F.lit(before), k, F.lit(after))).otherwise(raw)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(candidates.any_labels(raw), ";").alias("label"))


# --- validation

_TOKENS = f"""SELECT map_id, row_nr, pmid, pos, regexp_replace(regexp_replace({_strip("tok")}, '^[''"]+', ''), '[''"]+$', '') AS token FROM (
    SELECT map_id, row_nr, pmid, unnest(string_split(llm_dis_map, ';')) AS tok, generate_subscripts(string_split(llm_dis_map, ';'), 1) AS pos
    FROM final_tiab_mappings WHERE llm_dis_map IS NOT NULL)"""
_VALID = f"""SELECT map_id, row_nr, pmid, string_agg(token, ';' ORDER BY pos) AS llm_dis_map FROM ({_TOKENS})
    WHERE token <> '' AND token IN (SELECT g2p_id FROM ontology WHERE g2p_id IS NOT NULL) GROUP BY ALL"""


@query("SELECT map_id, llm_dis_map FROM final_tiab_mappings WHERE llm_dis_map IS NOT NULL AND starts_with(llm_dis_map, 'G2P')")
def answered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-40, O-41."""
    return table(spark, sf_dir, "final_tiab_mappings").dropna(subset=["llm_dis_map"]).where(F.col("llm_dis_map").startswith("G2P")).select("map_id", "llm_dis_map")


@query(f"SELECT map_id, llm_dis_map FROM ({_VALID})")
def valid_id_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-11, O-50, O-54, O-63, O-79, O-80."""
    rows = table(spark, sf_dir, "final_tiab_mappings").where("llm_dis_map is not null").select("map_id", "llm_dis_map")
    return validate.valid_ids(rows, ["map_id"], table(spark, sf_dir, "ontology")).select("map_id", "llm_dis_map")


_NUMBER = f"try_cast({_strip('string_split(entity_id, chr(59))[1]')} AS DOUBLE)"
_GENES = f"""SELECT pmid, string_agg(symbol, ';' ORDER BY seen, symbol) AS gene_symbols FROM (
    SELECT m.pmid, g.symbol, min(m.mention_id) AS seen FROM (SELECT pmid, mention_id, {_NUMBER} AS d FROM gene2pubtator3) m
    JOIN gene_info g ON g.tax_id = 9606 AND g.symbol IS NOT NULL AND m.d = floor(m.d) AND g.geneid = m.d
    WHERE m.pmid IS NOT NULL GROUP BY ALL) GROUP BY pmid"""


@query(f"SELECT mention_id, CASE WHEN d = floor(d) THEN CAST(d AS BIGINT) END AS geneid FROM (SELECT mention_id, {_NUMBER} AS d FROM gene2pubtator3)")
def first_token_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-44, O-81."""
    return table(spark, sf_dir, "gene2pubtator3").select("mention_id", X.first_number(F.col("entity_id")).alias("geneid"))


@query("SELECT geneid, symbol FROM gene_info WHERE tax_id = 9606 AND geneid IS NOT NULL AND symbol IS NOT NULL")
def human_gene_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-13, O-45..47: the gene table as tab-separated text with a marked header and ``-`` for null, three columns of it read."""
    rows = table(spark, sf_dir, "gene_info").toDF(*GENE_INFO.names)
    path = _as_csv(spark, rows, sep="\t", nullValue="-", quote="", escape="\\")
    return validate.human_genes(files.gene_info(spark, path, ["tax_id", "GeneID", "Symbol"]).toDF("tax_id", "geneid", "symbol"))


_FLAT = r"regexp_replace({0}, '[\t\n\r]+', ' ', 'g')"


@query(f"""SELECT mention_type AS type, source, count(*) AS n, count(DISTINCT pmid) AS articles, CAST(sum(CASE WHEN d = floor(d) THEN d END) AS BIGINT) AS ids FROM (
    SELECT mention_type, source, pmid, try_cast({_strip("string_split(" + _FLAT.format("entity_id") + ", ';')[1]")} AS DOUBLE) AS d FROM gene2pubtator3) GROUP BY ALL""")
def mention_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-12, O-44: mentions as headerless tab-separated text; a field there holds neither tab nor line break."""
    flat = lambda c: F.regexp_replace(c, r"[\t\n\r]+", " ").alias(c)
    rows = table(spark, sf_dir, "gene2pubtator3").select("pmid", "mention_type", flat("entity_id"), flat("mention"), "source")
    read = files.gene_mentions(spark, _as_csv(spark, rows, header=False, sep="\t", quote="", escape="\\"))
    return read.groupBy("type", "source").agg(
        F.count("*").alias("n"), F.countDistinct("pmid").alias("articles"), F.sum(X.first_number(F.col("entity_id"))).alias("ids")
    )


@query(_GENES)
def gene_per_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-12, O-51, O-52, O-64, O-66."""
    got = validate.genes_per_article(table(spark, sf_dir, "gene2pubtator3"), table(spark, sf_dir, "gene_info"))
    return got.select("pmid", F.array_join("gene_symbols", ";").alias("gene_symbols"))


@query(f"SELECT map_id, pmid, g.gene_symbols AS genes FROM final_tiab_mappings f LEFT JOIN ({_GENES}) g USING (pmid)")
def enriched_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-43, O-53."""
    rows = table(spark, sf_dir, "final_tiab_mappings").select("map_id", F.col("pmid").cast("bigint").alias("pmid"))
    return rows.join(gene_per_article(spark, sf_dir), "pmid", "left").select("map_id", "pmid", F.col("gene_symbols").alias("genes"))


def _names_sql(column: str) -> str:
    return f"SELECT {_strip('coalesce(g2p_id, ' + chr(39) + 'nan' + chr(39) + ')')} AS id, {_strip('coalesce(' + column + ', ' + chr(39) + 'nan' + chr(39) + ')')} AS v FROM ontology"


def _mapped_sql(column: str, source: str) -> str:
    return f"""SELECT map_id, string_agg(v, ';' ORDER BY p, v) AS names FROM (
        SELECT t.map_id, n.v, min(t.pos) AS p FROM (
            SELECT map_id, unnest(string_split(llm_dis_map, ';')) AS id, generate_subscripts(string_split(llm_dis_map, ';'), 1) AS pos FROM {source}) t
        JOIN ({_names_sql(column)}) n ON n.id = {_strip("t.id")} GROUP BY ALL) GROUP BY map_id"""


@query(f"WITH k AS ({_VALID}) {_mapped_sql('disease_name', 'k')}")
def id_to_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-10, O-55, O-65, O-82..84: names of each mapping's valid identifiers."""
    known = valid_id_join(spark, sf_dir)
    names = validate.names_per_id(table(spark, sf_dir, "ontology"), "disease_name")
    return validate.mapped_names(known, ["map_id"], names, "n").select("map_id", F.array_join("n", ";").alias("names"))


@query("""SELECT map_id, CAST(len(dis_map_gene) > 0 AND len(list_filter(dis_map_gene, lambda x: NOT coalesce(list_contains(gene_symbols, x), false))) = 0 AS INTEGER) AS ok
    FROM (SELECT map_id, coalesce(dis_map_gene, []) AS dis_map_gene, coalesce(gene_symbols, []) AS gene_symbols FROM final_tiab_mappings)""")
def subset_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-48, O-61."""
    return table(spark, sf_dir, "final_tiab_mappings").select("map_id", X.subset(F.col("dis_map_gene"), F.col("gene_symbols")).cast("int").alias("ok"))


_FLAGGED = f"""WITH best AS ({_BEST}),
    f AS (SELECT * FROM final_tiab_mappings JOIN best USING (row_nr) WHERE best >= 0.9 AND starts_with(llm_dis_map, 'G2P')),
    v AS (SELECT map_id, pmid, llm_dis_map FROM ({_VALID}) WHERE map_id IN (SELECT map_id FROM f)),
    g AS ({_mapped_sql("gene_symbol", "v")}), d AS ({_mapped_sql("disease_name", "v")}), a AS ({_GENES})
    SELECT v.map_id, v.pmid, v.llm_dis_map, a.gene_symbols AS genes, coalesce(g.names, '') AS dis_map_gene, coalesce(d.names, '') AS dis_map_name,
    CAST(g.names IS NOT NULL AND a.gene_symbols IS NOT NULL
        AND len(list_filter(string_split(g.names, ';'), lambda x: NOT list_contains(string_split(a.gene_symbols, ';'), x))) = 0 AS INTEGER) AS ok
    FROM v LEFT JOIN a USING (pmid) LEFT JOIN g USING (map_id) LEFT JOIN d USING (map_id)"""


def _final(spark: SparkSession, sf_dir: str, all_rows: bool, mentions: DataFrame | None = None, least: float = 0.9) -> DataFrame:
    answers = table(spark, sf_dir, "final_tiab_mappings").select("map_id", "row_nr", "pmid", "llm_dis_map").join(_best(spark, sf_dir), "row_nr")
    names, genes = table(spark, sf_dir, "ontology"), table(spark, sf_dir, "gene_info")
    mentions = table(spark, sf_dir, "gene2pubtator3") if mentions is None else mentions
    done = validate.final_mapping(answers, names, mentions, genes, ["map_id"], least, all_rows=all_rows)
    flat = lambda c, to: F.array_join(c, ";").alias(to)
    lists = [flat("gene_symbols", "genes"), flat("dis_map_gene", "dis_map_gene"), flat("dis_map_name", "dis_map_name")]
    return done.select("map_id", "pmid", "llm_dis_map", *lists, F.col("dis_map_correct_gene_all").alias("ok"))


@query(_FLAGGED)
def mapping_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-10..13, O-40..55, O-60..66, O-79..84 as one plan: validated answers, and whether the article mentions all their genes."""
    return _final(spark, sf_dir, True)


@query(f"SELECT * EXCLUDE (ok) FROM ({_FLAGGED}) WHERE ok = 1")
def final_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, only answers whose genes the article mentions."""
    return _final(spark, sf_dir, False).drop("ok")


_PLANTED = f"""SELECT v.pmid, CAST(1000000000 + v.map_id AS BIGINT) AS mention_id, CAST(g.geneid AS VARCHAR) AS entity_id FROM ({_VALID}) v
    JOIN ontology o ON list_contains(string_split(v.llm_dis_map, ';'), o.g2p_id) JOIN gene_info g ON g.symbol = o.gene_symbol AND g.tax_id = 9606"""
_FLAGGED_PLANTED = _FLAGGED.replace("FROM gene2pubtator3)", f"FROM (SELECT pmid, mention_id, entity_id FROM gene2pubtator3 UNION ALL {_PLANTED}))").replace("best >= 0.9", "best >= 0.5")


@query(f"SELECT * EXCLUDE (ok) FROM ({_FLAGGED_PLANTED}) WHERE ok = 1")
def final_mapping_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-48 with cases: the human genes of the answers are added to the mentions of their articles, and the least score is 0.5."""
    rows = table(spark, sf_dir, "final_tiab_mappings").where("llm_dis_map is not null").select("map_id", "pmid", "llm_dis_map")
    names = table(spark, sf_dir, "ontology")
    answers = validate.valid_ids(rows, ["map_id"], names).select("map_id", "pmid", F.explode(F.split("llm_dis_map", ";")).alias("g2p_id"))
    genes = validate.human_genes(table(spark, sf_dir, "gene_info")).withColumnRenamed("symbol", "gene_symbol")
    found = answers.join(names.select("g2p_id", "gene_symbol"), "g2p_id").join(genes, "gene_symbol")
    planted = found.select("pmid", (F.col("map_id") + 1_000_000_000).alias("mention_id"), F.col("geneid").cast("string").alias("entity_id"))
    mentions = table(spark, sf_dir, "gene2pubtator3").select("pmid", "mention_id", "entity_id").unionByName(planted)
    return _final(spark, sf_dir, False, mentions, 0.5).drop("ok")


@query("""SELECT pmid, tiab, bert_predict, NULL::VARCHAR AS title FROM classified
    UNION ALL SELECT pmid, NULL, NULL, title FROM articles""")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-10, O-34, O-60."""
    return files.union_by_name(table(spark, sf_dir, "classified").select("pmid", "tiab", "bert_predict"), table(spark, sf_dir, "articles").select("pmid", "title"))


# --- splits and training sets

_GROUPS = "SELECT tiab, max(label) AS has_pos FROM annotated_tiab WHERE tiab IS NOT NULL AND label IN (0, 1) GROUP BY tiab"
_SIDES = f"""SELECT tiab, has_pos, CASE WHEN row_number() OVER (PARTITION BY has_pos ORDER BY md5('42' || tiab), tiab)
    <= ceil(0.2 * count(*) OVER (PARTITION BY has_pos)) THEN 'test' ELSE 'train' END AS side FROM ({_GROUPS})"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.checked_labels(table(spark, sf_dir, "annotated_tiab").where("label in (0, 1)"))


@query(_GROUPS)
def group_max_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-67, O-94."""
    return splits.text_groups(_labelled(spark, sf_dir))


@query(_SIDES)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-92: member by member."""
    return splits.stratified(splits.text_groups(_labelled(spark, sf_dir)), "tiab", "has_pos").select("tiab", "has_pos", "side")


@query(f"SELECT ann_id, a.label, s.side FROM annotated_tiab a JOIN ({_SIDES}) s USING (tiab) WHERE a.label IN (0, 1)")
def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-25, O-47, O-56."""
    return splits.group_split(_labelled(spark, sf_dir)).select("ann_id", "label", "side")


@query(f"""SELECT 'given' AS split, count(*) AS texts FROM (SELECT tiab FROM annotated_tiab WHERE tiab IS NOT NULL GROUP BY tiab HAVING count(DISTINCT split_name) > 1)
    UNION ALL SELECT 'by row', count(*) FROM (SELECT tiab FROM annotated_tiab JOIN (SELECT ann_id, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42' || ann_id), ann_id)
        <= ceil(0.1 * count(*) OVER (PARTITION BY label)) THEN 'test' ELSE 'train' END AS side FROM annotated_tiab WHERE label IN (0, 1)) USING (ann_id)
        WHERE tiab IS NOT NULL GROUP BY tiab HAVING count(DISTINCT side) > 1)
    UNION ALL SELECT 'by text', count(*) FROM (SELECT tiab FROM annotated_tiab JOIN ({_SIDES}) s USING (tiab) WHERE label IN (0, 1) GROUP BY tiab HAVING count(DISTINCT side) > 1)""")
def split_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-59: texts on more than one side of the split that the table comes with, of one by row, and of one by text (none)."""
    rows = table(spark, sf_dir, "annotated_tiab").where("tiab is not null")
    by_row = _labelled(spark, sf_dir).where("tiab is not null").join(validation_split(spark, sf_dir), "ann_id")
    found = {"given": splits.overlap(rows, side="split_name"), "by row": splits.overlap(by_row), "by text": splits.overlap(splits.group_split(_labelled(spark, sf_dir)))}
    parts = [df.agg(F.count("*").alias("texts")).select(F.lit(k).alias("split"), "texts") for k, df in found.items()]
    return files.union_by_name(*parts)


@query("""SELECT ann_id, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42' || ann_id), ann_id)
    <= ceil(0.1 * count(*) OVER (PARTITION BY label)) THEN 'test' ELSE 'train' END AS side FROM annotated_tiab WHERE label IN (0, 1)""")
def validation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-93: by row, as the original does; texts may be on both sides."""
    return splits.stratified(_labelled(spark, sf_dir).select("ann_id", "label"), "ann_id", "label", 0.1).select("ann_id", "side")


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    p AS (SELECT a.vec_id AS anchor, b.vec_id AS cand, a.label = b.label AS same, list_cosine_similarity(a.e, b.e) AS sim FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
    m AS (SELECT anchor, max(sim) AS pos FROM p WHERE same GROUP BY anchor),
    r AS (SELECT anchor, cand, row_number() OVER (PARTITION BY anchor ORDER BY sim DESC, cand) AS rnk FROM p JOIN m USING (anchor) WHERE NOT same AND sim <= 0.95 AND sim <= pos * 0.99)
    SELECT anchor, cand, CAST(rnk AS INTEGER) AS rnk FROM r WHERE rnk > 5 AND rnk <= 10""")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-57, O-78, O-99: anchors are the rows whose id is divisible by 20, candidates all rows."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.col("embedding").alias("v"))
    return mining.hard_negatives(v, v.where("id % 20 = 0"))


@query(ORACLE["hard_negatives"].replace("SELECT anchor, cand, CAST(rnk AS INTEGER) AS rnk", "SELECT anchor, cand, 0 AS label")
    + """ UNION ALL SELECT anchor, cand, 1 FROM p WHERE same""")
def labeled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-95: positives of the anchors and their mined negatives."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    a = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("anchor"), "label")
    positives = a.join(v.withColumnRenamed("vec_id", "cand"), "label").where("anchor <> cand")
    return mining.labeled_pairs(positives, hard_negatives(spark, sf_dir))


@query(ORACLE["hard_negatives"].split("p AS (")[0] + """p AS (SELECT a.vec_id AS anchor, b.vec_id AS cand, a.label = b.label AND b.vec_id > a.vec_id AS own, list_cosine_similarity(a.e, b.e) AS sim
        FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
    m AS (SELECT anchor, max(sim) AS pos FROM p WHERE own GROUP BY anchor),
    r AS (SELECT anchor, cand, row_number() OVER (PARTITION BY anchor ORDER BY sim DESC, cand) AS rnk FROM p JOIN m USING (anchor) WHERE NOT own AND sim <= 0.95 AND sim <= pos * 0.99)
    SELECT anchor, cand, 0 AS label FROM r WHERE rnk > 5 AND rnk <= 10 UNION ALL SELECT anchor, cand, 1 FROM p WHERE own""")
def mined_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-57, O-78, O-95 with positives given as pairs, as the mining stage does: an anchor can have several, a vector can be one of several anchors."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    anchors = v.where("id % 20 = 0")
    own = anchors.select(F.col("id").alias("anchor"), "label").join(v.select(F.col("id").alias("cand"), "label"), "label").where("cand > anchor").select("anchor", "cand")
    return mining.labeled_pairs(own, mining.hard_negatives(v.drop("label"), anchors.drop("label"), positives=own))


# --- metrics

_PAIRS = f"""SELECT label, len(list_intersect({_words("tiab")}, {_words("g2p_lgmde")})) / greatest(1, len({_words("g2p_lgmde")})) AS score FROM annotated_tiab WHERE label IN (0, 1)"""


def _scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "annotated_tiab").where("label in (0, 1)")
    return rows.select("label", X.containment(F.col("tiab"), F.col("g2p_lgmde")).alias("score"))


@query(f"""WITH c AS (SELECT count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (NOT p AND y) AS fn, count(*) FILTER (NOT p AND NOT y) AS tn
    FROM (SELECT score >= 0.2 AS p, label = 1 AS y FROM ({_PAIRS})))
    SELECT tp, fp, fn, tn, coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS "precision",
    coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c""")
def clf_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-70: of the pairs whose label's words are in the text to a fifth or more."""
    return metrics.binary(_scored_pairs(spark, sf_dir).withColumn("pred", (F.col("score") >= 0.2).cast("int")))


_CURVE = f"""SELECT score, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp, p, sum(p) OVER () AS ap, sum(n) OVER () AS an FROM (
    SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM ({_PAIRS}) GROUP BY score) WINDOW w AS (ORDER BY score DESC)"""


@query(f"SELECT score, tp, fp FROM ({_CURVE})")
def threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-71: positives above each threshold."""
    return metrics.curve(_scored_pairs(spark, sf_dir)).select("score", "tp", "fp")


@query(f"""WITH c AS (SELECT score, p, ap, tp / (tp + fp) AS pr, 2 * tp / (tp + fp + ap) AS f1, (tp + an - fp) / (ap + an) AS acc FROM ({_CURVE}))
    SELECT round(coalesce(sum(pr * p / ap), 0), 9) AS average_precision, round(max(f1), 9) AS best_f1, arg_max(score, (f1, score)) AS f1_threshold,
    round(max(acc), 9) AS best_accuracy, arg_max(score, (acc, score)) AS accuracy_threshold FROM c""")
def pr_curve_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-71: average precision and the best thresholds."""
    got = metrics.pair_evaluation(_scored_pairs(spark, sf_dir))
    return got.withColumns({c: F.round(c, 9) for c in ("average_precision", "best_f1", "best_accuracy")})


# --- ingest


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two listings of the batch files: anchors in each kind of quotes, and to checksums; the second listing has the dated files only, and one page was not read."""
    name = F.col("source_file")
    rows = table(spark, sf_dir, "articles").where("source_file is not null").groupBy("source_file").agg(F.max("received_at").alias("last"))
    anchors = (
        F.concat(F.lit('<p><a class="f" href="'), name, F.lit("\">x</a> <a href='"), name, F.lit(".md5'>y</a></p>")),
        F.concat(F.lit("<A HREF = "), name, F.lit(" id='n'>x</A><a href="), name, F.lit(".md5>y</a>")),
    )
    base = rows.select(F.lit("https://example.org/baseline/").alias("base_url"), F.lit(200).alias("status"), anchors[0].alias("html"))
    more = rows.where("last is not null").select(F.lit("https://example.org/update/").alias("base_url"), F.lit(200).alias("status"), anchors[1].alias("html"))
    return base.unionByName(more).unionByName(more.withColumn("status", F.lit(404)))


@query("""SELECT 0 AS listing, 'https://example.org/baseline/' || source_file AS url FROM articles WHERE source_file IS NOT NULL GROUP BY source_file
    UNION ALL SELECT 1, 'https://example.org/update/' || source_file FROM articles WHERE source_file IS NOT NULL GROUP BY source_file HAVING max(received_at) IS NOT NULL""")
def link_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-01, O-03, O-90: the links of two listings, files that both have twice."""
    found = links.file_links(_pages(spark, sf_dir))
    return links.all_links(*[found.where(F.col("base_url") == f"https://example.org/{x}/") for x in ("baseline", "update")]).select("listing", "url")


@query("SELECT DISTINCT source_file AS name FROM articles WHERE source_file IS NOT NULL AND source_file NOT IN (SELECT source_file FROM classified WHERE source_file IS NOT NULL)")
def new_files_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-02, O-20: links whose file is not among those processed."""
    done = table(spark, sf_dir, "classified").where("source_file is not null").select(F.col("source_file").alias("name"))
    return links.missing_files(link_scan(spark, sf_dir), done).select("name").distinct()


@query("""SELECT source_file, count(*) AS n FROM articles WHERE source_file IS NOT NULL AND source_file NOT IN
    (SELECT source_file FROM articles WHERE source_file IS NOT NULL AND pubdate IS NULL) GROUP BY source_file""")
def good_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-21, O-22: files without a row whose year is missing; a bad row sets its whole file apart."""
    from annotary.sources.xml import quarantine

    rows = table(spark, sf_dir, "articles").where("source_file is not null").withColumn("bad_row", F.col("pubdate").isNull())
    return quarantine(rows)[0].groupBy("source_file").agg(F.count("*").alias("n"))


def _xml_folder(spark: SparkSession, sf_dir: str) -> str:
    """The articles as packed XML files."""
    rows = table(spark, sf_dir, "articles")
    date = F.struct(F.col("pubdate").cast("string").alias("Year"))
    journal = F.struct(F.col("journal").alias("Title"), F.struct(date.alias("PubDate")).alias("JournalIssue"))
    sections = F.when(F.col("abstract").isNotNull(), F.struct(F.array("abstract").alias("AbstractText")))
    article = F.struct(F.col("title").alias("ArticleTitle"), sections.alias("Abstract"), F.when(F.col("languages").isNotNull(), F.array("languages")).alias("Language"), journal.alias("Journal"))
    path = shared_path(spark, "xml")
    records = rows.select(F.struct(F.col("pmid").cast("string").alias("PMID"), article.alias("Article")).alias("MedlineCitation"))
    records.repartition(4).write.format("xml").options(rowTag="PubmedArticle", rootTag="PubmedArticleSet", compression="gzip").save(path)
    return path


_XML = ", ".join(f"nullif({_strip(c)}, '') AS {c}" for c in ("title", "abstract"))


@query(f"SELECT pmid, {_XML}, nullif(languages, '') AS languages, pubdate, nullif(journal, '') AS journal FROM articles WHERE pubdate IS NOT NULL")
def xml_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-04, O-15, O-20, O-21, O-31: packed XML through the ingest stage, twice; rows without a year are set apart, the second run adds nothing."""
    from argparse import Namespace

    from annotary.cli import to_parquet

    source, out = _xml_folder(spark, sf_dir), shared_path(spark, "ingested")
    took = [to_parquet(spark, Namespace(input=source, out=f"{out}/t", rows_only=True, skip_if_exists=True)) for _ in range(2)]
    assert took[1] is None
    empty = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    return spark.read.parquet(f"{out}/t").select("pmid", empty("title"), empty("abstract"), empty("languages"), "pubdate", empty("journal"))


@query("SELECT source_file AS batch, count(*) AS n, (SELECT count(*) FROM articles) AS written FROM articles GROUP BY source_file")
def written_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-06, O-07, O-14, O-16..18, O-24: written compressed and counted in the same pass, read back as a folder with a declared schema."""
    rows = table(spark, sf_dir, "articles").select("pmid", "title", F.col("source_file").alias("batch"))
    path = shared_path(spark, "written")
    n = write(rows, path)
    return files.parquet_dir(spark, path, rows.schema).groupBy("batch").agg(F.count("*").alias("n")).withColumn("written", F.lit(n).cast("long"))


@query("""SELECT shard, count(*) AS n, CAST(sum(row_nr) AS BIGINT) AS numbers FROM (SELECT row_nr, row_nr % 3 AS shard FROM
    (SELECT row_number() OVER (ORDER BY delivery_id) - 1 AS row_nr FROM articles)) GROUP BY shard""")
def written_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-19, O-20, O-27: each worker's output under its name; a second run leaves what is there."""
    base = shared_path(spark, "shards")
    rows = row_numbers(spark, sf_dir)
    for run in range(2):
        for i in range(3):
            done = write(ordering.row_shard(rows, i, 3), f"{base}/{shard_name('articles', i, 3)}", skip_if_exists=True)
            assert (done is None) == (run == 1)
    read = [spark.read.parquet(f"{base}/{shard_name('articles', i, 3)}").withColumn("shard", F.lit(i).cast("long")) for i in range(3)]
    return files.union_by_name(*read).groupBy("shard").agg(F.count("*").alias("n"), F.sum("row_nr").alias("numbers"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def incremental_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-05, O-20, O-23: the events through an incremental file stream; a second run adds nothing."""
    import os

    from annotary.streaming.ingest import run_new

    schema = table(spark, sf_dir, "events").schema
    base = shared_path(spark, "stream")
    # the table is one file of the data folder, or a folder of files
    one = f"{os.path.abspath(sf_dir)}/events.parquet"
    source, pattern = (one, "*.parquet") if os.path.isdir(one) else (os.path.dirname(one), "events.parquet")
    for _ in range(2):
        run_new(spark, source, schema, f"{base}/out", f"{base}/checkpoint", lambda b: b.select("event_type", "event_id"), pattern=pattern)
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"))
