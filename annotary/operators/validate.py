"""From model answers to validated mappings.

Ontology and gene tables are joined without hints: Spark broadcasts them where their size
allows. Shuffles on the large side are those of genes per pmid and the join with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annotary.functions import text as X
from annotary.runtime import cut


def confident(rows: DataFrame, least: float = 0.9, prefix: str = "G2P") -> DataFrame:
    """Rows of ``(llm_dis_map, best)`` with an answer that begins with ``prefix`` and a best score of at least ``least``.

    A null or NaN best score does not pass (Spark holds NaN for the greatest number)."""
    best = F.coalesce(~F.isnan("best") & (F.col("best") >= least), F.lit(False))
    return rows.where("llm_dis_map is not null").where(F.col("llm_dis_map").startswith(prefix) & best)


def valid_ids(rows: DataFrame, key: list[str], ontology: DataFrame) -> DataFrame:
    """``llm_dis_map`` reduced to identifiers of the ontology, order and repeats kept; rows without any go.

    The ontology's identifiers are not stripped, so one with a trailing blank is never met.
    ``key`` tells rows apart; tokens are checked row by row and put together again."""
    ids = ontology.where("g2p_id is not null and g2p_id <> ''").select(F.col("g2p_id").alias("token")).distinct()
    tokens = rows.select(*key, F.posexplode(X.id_tokens(F.col("llm_dis_map"))).alias("pos", "token"))
    kept = tokens.join(ids, "token", "left_semi").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("t"))
    return rows.drop("llm_dis_map").join(kept.select(*key, F.array_join("t.token", ";").alias("llm_dis_map")), key)


def human_genes(genes: DataFrame, tax_id: int = 9606) -> DataFrame:
    """``(geneid, symbol)`` of one species, ids and symbols given."""
    return genes.where(F.col("tax_id") == tax_id).where("geneid is not null and symbol is not null").select("geneid", "symbol")


def genes_per_article(mentions: DataFrame, genes: DataFrame, order: str = "mention_id") -> DataFrame:
    """``(pmid, gene_symbols)``: different symbols of the human genes that an article mentions, by first mention.

    The first token of ``entity_id`` counts. Semi-join, left join and the drop of null symbols
    are one inner join. Repeats go before the shuffle of an article that has very many."""
    found = mentions.select("pmid", F.col(order).alias("at"), X.first_number(F.col("entity_id")).alias("geneid")).where("pmid is not null and geneid is not null")
    firsts = found.groupBy("pmid", "geneid").agg(F.min("at").alias("at"))
    named = firsts.join(human_genes(genes), "geneid").groupBy("pmid", "symbol").agg(F.min("at").alias("at"))
    listed = named.groupBy("pmid").agg(F.sort_array(F.collect_list(F.struct("at", "symbol"))).alias("g"))
    return listed.select("pmid", F.col("g.symbol").alias("gene_symbols"))


def names_per_id(ontology: DataFrame, column: str, null_text: str | None = "nan", order: Column | None = None) -> DataFrame:
    """``(id, names)``: a column's values for each stripped identifier, repeats kept.

    Text form comes before dropping nulls in the original, so a missing value is ``nan``;
    ``null_text=None`` drops it. Values are in the order of ``order``, by default their own."""
    value = X.strip(F.coalesce(F.col(column).cast("string"), F.lit(null_text))) if null_text is not None else X.strip(F.col(column).cast("string"))
    key = X.strip(F.coalesce(F.col("g2p_id"), F.lit(null_text))) if null_text is not None else X.strip(F.col("g2p_id"))
    rows = ontology.select(key.alias("id"), value.alias("v"), (order if order is not None else value).alias("at")).where("id is not null and v is not null")
    return rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("n")).select("id", F.col("n.v").alias("names"))


def mapped_names(rows: DataFrame, key: list[str], names: DataFrame, out: str) -> DataFrame:
    """``key`` and ``out``: names of the row's identifiers in their order, each name once."""
    ids = rows.select(*key, F.posexplode(X.parse_ids(F.col("llm_dis_map"))).alias("pos", "id"))
    found = ids.join(names, "id").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", "names"))).alias("n"))
    return found.select(*key, F.array_distinct(F.flatten("n.names")).alias(out))


def final_mapping(
    answers: DataFrame, ontology: DataFrame, mentions: DataFrame, genes: DataFrame, key: list[str], least: float = 0.9, null_text: str | None = "nan", all_rows: bool = False
) -> DataFrame:
    """Answers ``(key..., pmid, llm_dis_map, best)`` with valid identifiers whose genes the article mentions.

    Adds ``gene_symbols``, ``dis_map_gene``, ``dis_map_name`` and ``dis_map_correct_gene_all``, 1 in all rows kept;
    ``all_rows`` keeps those with 0 too."""
    # written once: the lookup and the result both start from it
    known = cut(valid_ids(confident(answers, least), key, ontology), "known")
    none = F.array().cast("array<string>")
    genes_of, names_of = (names_per_id(ontology, c, null_text).withColumnRenamed("names", c) for c in ("gene_symbol", "disease_name"))
    ids = known.select(*key, F.posexplode(X.parse_ids(F.col("llm_dis_map"))).alias("pos", "id")).join(genes_of.join(names_of, "id", "full"), "id")
    found = ids.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pos", "gene_symbol", "disease_name"))).alias("n"))
    flat = lambda c: F.array_distinct(F.flatten(F.filter(c, lambda x: x.isNotNull())))
    found = found.select(*key, flat(F.col("n.gene_symbol")).alias("dis_map_gene"), flat(F.col("n.disease_name")).alias("dis_map_name"))
    full = known.join(genes_per_article(mentions, genes), "pmid", "left").join(found, key, "left")
    full = full.withColumns({c: F.coalesce(c, none) for c in ("dis_map_gene", "dis_map_name")})
    flag = X.subset(F.col("dis_map_gene"), F.col("gene_symbols")).cast("int")
    full = full.withColumn("dis_map_correct_gene_all", flag)
    return full if all_rows else full.where("dis_map_correct_gene_all = 1")
