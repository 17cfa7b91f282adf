"""Queries of the subpackage, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blattwerk.llm import chunk, encoding, langid, mix, names, pack, scan, tokens, unify
from blattwerk.session import cut, table


def marked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tabelle``, ``id``, ``text`` of all lines and emphasised phrases."""
    lines = table(spark, sf_dir, "zeilen").select(F.lit("zeilen").alias("tabelle"), F.col("zeile_id").alias("id"), "text")
    spans = table(spark, sf_dir, "hervorhebungen").select(F.lit("hervorhebungen").alias("tabelle"), F.col("hervorhebung_id").alias("id"), "text")
    return lines.unionByName(spans)


def scanned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines, documents, heads = (table(spark, sf_dir, t) for t in ("zeilen", "documents", "kopfbloecke"))
    return lines, documents, heads.select("buch_id", "titel")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with marks of the printed page and of scanning."""
    return scan.cases(*scanned(spark, sf_dir))


def p1_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running text of every book in paragraphs."""
    return scan.paragraphs(*scanned(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text stands in another form, those of problem 3 left out."""
    new = unify.changed(marked_texts(spark, sf_dir), ["tabelle", "id"]).select("tabelle", "id", "original", (F.col("tabelle") == "zeilen").alias("zeile"))
    model = encoding.fit(table(spark, sf_dir, "documents"))
    return encoding.in_order(new, model, "original", "zeile").select("tabelle", "id")


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in the one form."""
    return unify.unify(marked_texts(spark, sf_dir), ["tabelle", "id"]).select("tabelle", "id", "unified")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that show a wrong decoding."""
    model = encoding.fit(table(spark, sf_dir, "documents"))
    return encoding.examine(table(spark, sf_dir, "zeilen"), model, ["zeile_id"]).select("zeile_id")


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled lines with the chain found and the text restored."""
    model = encoding.fit(table(spark, sf_dir, "documents"))
    return encoding.examine(table(spark, sf_dir, "zeilen"), model, ["zeile_id", "text"])


def setting(spark: SparkSession, sf_dir: str, name: str) -> int:
    """A value of the table of settings, which has one row per name."""
    return table(spark, sf_dir, "vorgaben").where(F.col("name") == name).first()["wert"]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of front matter rows that name the same in different spellings."""
    return names.pairs(table(spark, sf_dir, "kopfbloecke"), "kopf_id")


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whom each front matter row names."""
    return names.links(table(spark, sf_dir, "kopfbloecke"), "kopf_id")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every page in pieces under the limit."""
    limit, overlap = (setting(spark, sf_dir, f"p5_{n}") for n in ("max_zeichen", "ueberlappung_zeichen"))
    return chunk.pieces(table(spark, sf_dir, "zeilen"), limit, overlap)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that had to be cut."""
    return p5_pieces(spark, sf_dir).groupBy("buch_id", "seite").count().where("count > 1").select("buch_id", "seite")


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(tokens.count_tokens(table(spark, sf_dir, "documents"), ["doc_id", "source"]))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in a container of the capacity."""
    return pack.pack(document_tokens(spark, sf_dir), "doc_id", setting(spark, sf_dir, "p6_kapazitaet_token"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture in their slots."""
    return mix.mixture(document_tokens(spark, sf_dir), table(spark, sf_dir, "mischziele"), setting(spark, sf_dir, "p7_gesamt_prozent"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the mixture that each source really got."""
    return mix.shares(document_tokens(spark, sf_dir), table(spark, sf_dir, "mischziele"), setting(spark, sf_dir, "p7_gesamt_prozent"))


def language_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return langid.segments(documents, langid.fit(documents))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of a document that its label doesn't name."""
    return langid.unnamed(table(spark, sf_dir, "documents"), language_segments(spark, sf_dir))


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of every document, each with its language."""
    return language_segments(spark, sf_dir).withColumn("konfidenz", F.round("konfidenz", 4))


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of every document with their shares."""
    return langid.document_languages(table(spark, sf_dir, "documents"), language_segments(spark, sf_dir)).withColumn("konfidenz", F.round("konfidenz", 4))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_text, p2_found, p2_forms, p3_found, p3_restored, p4_found, p4_links, p5_found, p5_pieces, p6_containers, p7_mixture, p7_shares, p8_found, p8_segments, p8_documents)}


def oracle_sql() -> dict[str, str]:
    """Only the size of a page can be told in SQL; the others are tested otherwise."""
    return {
        "p5_found": """with l as (select buch_id, seite, pos, arg_max(struct_pack(t := text), (gelesen_am, zeile_id)).t as text from zeilen group by all),
p as (select buch_id, seite, sum(length(text)) + count(*) - 1 as n from l where text is not null group by all)
select buch_id, seite from p where n > (select wert from vorgaben where name = 'p5_max_zeichen')"""
    }
