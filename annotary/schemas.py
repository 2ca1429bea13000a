"""Declared schemas of every source. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()


def _struct(spec: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in spec])


#: The 15 ontology columns in their order in a label (fixed values).
ONTOLOGY_COLUMNS = [
    "g2p_id", "gene symbol", "gene mim", "hgnc id", "previous gene symbols", "disease name", "disease mim", "disease MONDO",
    "allelic requirement", "cross cutting modifier", "confidence", "inferred variant consequence", "variant types",
    "molecular mechanism", "molecular mechanism categorisation",
]
ARTICLE = _struct([("pmid", _L), ("title", _S), ("abstract", _S), ("languages", _S), ("pubdate", _I)])
CANDIDATES = T.ArrayType(_struct([("label", _S), ("score", _D)]))
GENE_MENTION = _struct([("pmid", _L), ("type", _S), ("entity_id", _S), ("mention", _S), ("source", _S)])
#: Columns of the gene table in file order, the first with its leading ``#`` (fixed values).
GENE_INFO = _struct(
    [
        ("#tax_id", _L), ("GeneID", _L), ("Symbol", _S), ("LocusTag", _S), ("Synonyms", _S), ("dbXrefs", _S), ("chromosome", _S),
        ("map_location", _S), ("description", _S), ("type_of_gene", _S), ("Symbol_from_nomenclature_authority", _S),
        ("Full_name_from_nomenclature_authority", _S), ("Nomenclature_status", _S), ("Other_designations", _S),
        ("Modification_date", _L), ("Feature_type", _S),
    ]
)
ANNOTATED = _struct([("tiab", _S), ("g2p_lgmde", _S), ("label", _I)])
