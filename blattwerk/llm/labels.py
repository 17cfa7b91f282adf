"""Language labels: codes and names to one of the supported languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ISO 639-1, 639-2/B, 639-2/T codes and names of the languages.
LANGUAGES = ("de", "en", "fr", "es", "it", "nl", "pl")
NAMES = {
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "en": ("en", "eng", "english", "englisch"),
    "fr": ("fr", "fra", "fre", "french", "französisch", "francais", "français"),
    "es": ("es", "spa", "spanish", "spanisch", "español", "espanol", "castilian"),
    "it": ("it", "ita", "italian", "italienisch", "italiano"),
    "nl": ("nl", "nld", "dut", "dutch", "niederländisch", "nederlands", "flemish"),
    "pl": ("pl", "pol", "polish", "polnisch", "polski"),
}


def named_language(label: Column) -> Column:
    """The language that ``label`` names, else null.

    Case, surrounding blanks and a region (``de-DE``, ``en_GB``, ``de.UTF-8``)
    don't matter. Null, empty and unknown labels give null.
    """
    head = F.regexp_extract(F.lower(F.trim(label)), r"^([\p{L}]+)", 1)
    table = F.create_map(*[F.lit(x) for lang, names in NAMES.items() for n in names for x in (n, lang)])
    return F.when(head != "", F.try_element_at(table, head))


def labelled_sample(documents: DataFrame, size: int, chars: int) -> list[tuple[str, str]]:
    """Language and text of about ``size`` labelled documents, by hash of their id.

    At most ``chars`` characters of each text. The share of hashes taken is set
    from a count, so that no task hands on more than its part of the sample.
    """
    named = documents.select("doc_id", named_language(F.col("lang")).alias("l"), "text").where("l is not null and text is not null")
    share = min(1.0, size / max(1, named.count()))
    rows = named.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= share * (1 << 30)).select("doc_id", "l", F.substring("text", 1, chars).alias("t"))
    return [(r["l"], r["t"]) for r in rows.limit(2 * size).collect()]
