"""Optional tables, decisions, exports and catalog imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.functions.core import text

# Schemas of review tables a deployment may lack.
OPTIONAL_TABLES = {
    "cleaning_reviews": "listing_id string, stage string, decision string, confidence double, reason string, "
    "normalized_title string, normalized_category string",
    "verifications": "listing_id string, status string, query string, confidence double, reason string",
    "research": "listing_id string, status string, canonical_title string, canonical_brand string, "
    "canonical_model string, canonical_category string, confidence double",
    "ai_reviews": "listing_id string, status string, canonical_title string, canonical_category string, confidence double",
    "detail_reviews": "listing_id string, description_sample string",
}

DECISION_SCHEMA = (
    "listing struct<id:string,platform:string,title:string,price:double,url:string,description:string,"
    "image_url:string,extra_info:string>, decision struct<status:string,reason:string,score:int,config:string>, "
    "evidence array<struct<step:string,status:string,reason:string,score_delta:int,confidence:double,"
    "data:string,timestamp:timestamp_ntz>>"
)

IDENTIFIER = "struct<type:string,value:string,confidence:double>"
SPEC = "struct<key:string,value:string,unit:string,confidence:double>"
EVIDENCE = (
    "struct<type:string,field:string,value:string,source_type:string,source_ref:string,excerpt:string,"
    "language:string,confidence:double>"
)
VARIANT = (
    "struct<variant_key:string,variant_name:string,confidence:double,aliases:array<string>,"
    f"identifiers:array<{IDENTIFIER}>,specs:array<{SPEC}>,evidence:array<{EVIDENCE}>>"
)
REF = "struct<family_key:string,variant_key:string>"
PRODUCT = (
    "struct<family_key:string,category:string,brand:string,family_name:string,confidence:double,"
    f"aliases:array<string>,identifiers:array<{IDENTIFIER}>,specs:array<{SPEC}>,evidence:array<{EVIDENCE}>,"
    f"variants:array<{VARIANT}>>"
)
RELATION = f"struct<subject:{REF},object:{REF},type:string,relation_type:string,source:string,confidence:double>"
IMPORT_SCHEMA = (
    "source struct<key:string,name:string,type:string,reliability:double>, "
    f"products array<{PRODUCT}>, relations array<{RELATION}>"
)


def read_optional_table(spark: SparkSession, name: str, schema: str | None = None) -> DataFrame:
    """The table, or an empty one of its schema."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return spark.createDataFrame([], schema or OPTIONAL_TABLES[name])


def write_decisions(decisions: DataFrame, path: str) -> None:
    """Decisions with their evidence, one folder per rule set."""
    decisions.write.mode("append").partitionBy("rules").parquet(path)


def read_decision_reports(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per decision."""
    return spark.read.schema(DECISION_SCHEMA).json(path, multiLine=True)


def export_view(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_knowledge_import(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Catalog tables from nested import documents."""
    return split_knowledge(spark.read.schema(IMPORT_SCHEMA).json(path, multiLine=True))


def _alias_value(alias):
    """An alias is a plain text, or an object with value, language and confidence."""
    return F.coalesce(F.get_json_object(alias, "$.value"), alias)


def split_knowledge(documents: DataFrame) -> dict[str, DataFrame]:
    """families, variants, aliases, identifiers, spec_facts, evidence and relations of documents."""
    source = F.col("source.key").alias("source")
    products = documents.select(source, F.explode("products").alias("p"))
    variants = products.select("source", "p.family_key", F.explode("p.variants").alias("v"))
    half = lambda c: F.coalesce(F.col(c), F.lit(0.8))

    def children(field: str, fields: dict[str, str]) -> DataFrame:
        own = products.select(
            "source", "p.family_key", F.lit(None).cast("string").alias("variant_key"), F.explode(f"p.{field}").alias("c")
        )
        nested = variants.select("source", "family_key", "v.variant_key", F.explode(f"v.{field}").alias("c"))
        return own.unionByName(nested).select(
            "source", "family_key", "variant_key", *[F.col(f"c.{k}").alias(n) for k, n in fields.items()]
        )

    aliases = (
        products.select("source", "p.family_key", F.lit(None).cast("string").alias("variant_key"), F.explode("p.aliases").alias("c"))
        .unionByName(variants.select("source", "family_key", "v.variant_key", F.explode("v.aliases").alias("c")))
        .select(
            "source", "family_key", "variant_key", _alias_value(F.col("c")).alias("alias"),
            F.coalesce(F.get_json_object("c", "$.confidence").cast("double"), F.lit(0.8)).alias("confidence"),
        )
    )
    relations = documents.select(source, F.explode("relations").alias("r")).select(
        F.coalesce("r.source", "source").alias("source"),
        F.col("r.subject.family_key").alias("subject_family"),
        F.col("r.subject.variant_key").alias("subject_variant"),
        F.coalesce("r.type", "r.relation_type").alias("relation_type"),
        F.col("r.object.family_key").alias("object_family"),
        F.col("r.object.variant_key").alias("object_variant"),
        half("r.confidence").alias("confidence"),
    )
    return {
        "families": products.select(
            "source", "p.family_key", "p.category", text("p.brand").alias("brand"), "p.family_name", half("p.confidence").alias("confidence")
        ),
        "variants": variants.select("source", "family_key", "v.variant_key", "v.variant_name", half("v.confidence").alias("confidence")),
        "aliases": aliases,
        "identifiers": children("identifiers", {"type": "identifier_type", "value": "identifier_value", "confidence": "confidence"}),
        "spec_facts": children("specs", {"key": "spec_key", "value": "spec_value", "unit": "unit", "confidence": "confidence"}),
        "evidence": children(
            "evidence",
            {"type": "evidence_type", "field": "field_name", "value": "value_json", "source_type": "source_type",
             "source_ref": "source_ref", "excerpt": "excerpt", "language": "language", "confidence": "confidence"},
        ),
        "relations": relations,
    }
