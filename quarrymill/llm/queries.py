"""Queries on texts: p3, p4, p5, p7, p8, p9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.canonical import map_to_reference
from quarrymill.llm.encoding import decode_cells
from quarrymill.llm.glossary import glossary_of
from quarrymill.llm.mixing import mix_documents, predict_sources
from quarrymill.llm.residue import find_residue
from quarrymill.llm.subjects import assign_subjects, train_subjects
from quarrymill.llm.tokens import decode_documents, encode_documents
from quarrymill.session import table

PC = "enriched_pc_hardware_database"
HARDWARE = "enriched_computer_hardware_knowledge"
HERBS = "traditional_chinese_medicine_material_enriched"


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_cells(table(spark, sf_dir, "sample_chemicals"), ["品名", "备注"]).drop("guess")


def p3_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest reading of every garbled cell, also where bytes were lost."""
    return decode_cells(table(spark, sf_dir, "sample_chemicals"), ["品名", "备注"]).drop("restored")


def _mapped(spark: SparkSession, sf_dir: str, with_glossary: bool) -> DataFrame:
    reference = table(spark, sf_dir, "reference_items")
    pc = (table(spark, sf_dir, PC), PC, ["manufacturer", "component_type"])
    hardware = (table(spark, sf_dir, HARDWARE), HARDWARE, ["category"])
    return map_to_reference([pc, hardware], reference, glossary=glossary_of(reference) if with_glossary else None)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir, True)


def p4_without_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the reference list and names learned from the values alone."""
    return _mapped(spark, sf_dir, False)


def p4_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that stand for no entry, counted by field."""
    return p4_found(spark, sf_dir).where("ref_id = -1").groupBy("table_name", "field_name").count()


def _residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = find_residue(table(spark, sf_dir, PC), PC, ["specifications"])
    return parts.unionByName(find_residue(table(spark, sf_dir, HERBS), HERBS, ["function_effects", "modern_medical_evidence"]))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _residue(spark, sf_dir).drop("kind")


def p5_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells of each field are residue of each kind."""
    return _residue(spark, sf_dir).groupBy("table_name", "field_name", "kind").count()


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The round trip: the text that the ids of every document give, by its hash."""
    return decode_documents(p7_ids(spark, sf_dir)).select("doc_id", F.md5("text").alias("hash"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each drawn document is used."""
    return mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share each source reaches, beside its target."""
    return mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p8_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likeliest source of every document without one."""
    domains = [r["source"] for r in table(spark, sf_dir, "mix_targets").where("source is not null").orderBy("source").collect()]
    return predict_sources(table(spark, sf_dir, "documents"), domains).drop("posterior")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train_subjects(documents, table(spark, sf_dir, "doc_labels"), table(spark, sf_dir, "subject_areas"))
    return assign_subjects(documents, model)


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The make-up of the corpus: documents per subject."""
    return p9_found(spark, sf_dir).groupBy("subject").count()


QUERIES = {
    "p3_found": p3_found,
    "p3_guesses": p3_guesses,
    "p4_found": p4_found,
    "p4_unmatched": p4_unmatched,
    "p4_without_glossary": p4_without_glossary,
    "p5_found": p5_found,
    "p5_kinds": p5_kinds,
    "p7_ids": p7_ids,
    "p7_decoded": p7_decoded,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p8_unlabelled": p8_unlabelled,
    "p9_found": p9_found,
    "p9_composition": p9_composition,
}
ORACLE = {"p7_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS hash FROM documents"}
