"""Lists and figures for display: filters, shares, sizes, versions, repeated parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blattwerk.functions.text import normalized
from blattwerk.session import cut


def search_key(text: Column) -> Column:
    """Text as names are searched: small letters without accents. Null is empty."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike(r"[^\x00-\x7f]"), F.regexp_replace(normalized(low, "NFD"), r"[\x{300}-\x{36f}]", "")).otherwise(low)


def named_like(docs: DataFrame, name: str, wanted: str) -> DataFrame:
    """``docs`` whose ``name`` has ``wanted`` in it, whatever case and accents; an empty wish takes all."""
    return docs.where(F.contains(search_key(F.col(name)), search_key(F.lit(wanted))))


def newest_first(docs: DataFrame, name: str, time: str) -> DataFrame:
    """``docs`` in order: latest ``time`` first, then by name in small letters."""
    return docs.orderBy(F.desc(time), F.lower(name))


def shares(counts: DataFrame, row: str, value: str) -> DataFrame:
    """``counts`` with ``prozent``: the rounded share of each value in the sum of its row.

    Sums are aggregated first and joined back, as a row may have many values; a
    row that sums to 0 has null shares.
    """
    total = counts.groupBy(F.col(row).alias("__row")).agg(F.sum(value).alias("__sum"))
    j = counts.join(total, F.col(row).eqNullSafe(F.col("__row")))
    return j.withColumn("prozent", F.floor(F.try_divide(F.col(value) * 100.0, F.col("__sum")) + 0.5).cast("int")).drop("__row", "__sum")


def ratio(part: Column, whole: Column) -> Column:
    """Percent of a whole, rounded half up; null of nothing."""
    return F.floor(F.try_divide(part * 100.0, whole) + 0.5).cast("int")


def with_pace(runs: DataFrame) -> DataFrame:
    """The runs of a summary whose pages a minute are known."""
    return runs.where("seiten_je_minute is not null")


# Round steps of an axis.
STEPS = (1.0, 2.0, 2.5, 5.0, 10.0)


def axis_step(most: Column, parts: int = 4) -> Column:
    """The round step that divides an axis up to ``most`` in about ``parts``; null unless positive."""
    raw = most / parts
    base = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    return F.when(most > 0, F.coalesce(F.get(F.filter(F.array(*[base * s for s in STEPS]), lambda s: s >= raw), F.lit(0)), raw))


def axis_ticks(most: Column, parts: int = 4) -> Column:
    """The marks of an axis from 0 to the first one that reaches ``most``."""
    step = axis_step(most, parts)
    last = F.ceil(most / step - 0.001).cast("int")
    return F.when(most > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.floor(i * step * 1000 + 0.5) / 1000)).otherwise(F.array(F.lit(0.0), F.lit(1.0)))


def trimmed_text(text: Column) -> Column:
    """Text for comparison: one kind of line end, no blanks at line ends and around it."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"(?U)[^\S\n]+(?=\n)", ""), r"(?U)^\s+|\s+$", "")


def version(text: Column) -> Column:
    """``major``, ``minor``, ``patch`` of a version; null for versions before a release and other text."""
    pattern = r"^\s*[vV]?(\d{1,9})(?:\.(\d{1,9}))?(?:\.(\d{1,9}))?\s*$"
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).cast("int"), F.lit(0))
    return F.when(text.rlike(pattern), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def folder_sizes(files: DataFrame, path: str, size: str) -> DataFrame:
    """``ordner``, ``groesse``, ``dateien`` of each direct folder, the largest first."""
    folder = F.when(F.contains(F.col(path), F.lit("/")), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(".")
    return files.groupBy(F.coalesce(F.nullif(folder, F.lit("")), F.lit(".")).alias("ordner")).agg(F.sum(size).alias("groesse"), F.count("*").alias("dateien")).orderBy(F.desc("groesse"), "ordner")


def repeated_parts(parts: DataFrame, key: list[str], places: str) -> DataFrame:
    """A row per part: ``key`` and the sorted distinct ``places`` that it was found in.

    Distinct places are taken first, so a part found everywhere is shuffled once
    per place; a part's places are one row by definition.
    """
    return parts.select(*key, places).distinct().groupBy(*key).agg(F.sort_array(F.collect_set(places)).alias(places), F.count("*").alias("anzahl"))


def resolved(links: DataFrame, hops: int = 20) -> DataFrame:
    """``path``, ``target``: where a chain of links ends, after at most ``hops`` of them.

    ``links`` has a row per ``path`` with its ``to``. Each round takes chains of twice the
    length, so five joins do for twenty hops; circles stop where the hops end.
    """
    power = cut(links.select("path", F.col("to").alias("t"), F.lit(1).alias("h")))
    out = links.select("path", F.col("path").alias("at"), F.lit(hops).alias("left"))
    tables = [power]
    while 2 ** len(tables) <= hops:
        a, b = tables[-1], tables[-1]
        nxt = b.select(F.col("path").alias("t"), F.col("t").alias("t2"), F.col("h").alias("h2"))
        j = a.join(nxt, "t", "left")
        tables.append(cut(j.select("path", F.coalesce("t2", "t").alias("t"), (F.col("h") + F.coalesce("h2", F.lit(0))).alias("h"))))
    for t in reversed(tables):
        hop = t.select(F.col("path").alias("at"), "t", "h")
        out = out.join(hop, "at", "left")
        take = F.coalesce(F.col("h") <= F.col("left"), F.lit(False))
        out = out.select("path", F.when(take, F.col("t")).otherwise(F.col("at")).alias("at"), (F.col("left") - F.when(take, F.col("h")).otherwise(0)).alias("left"))
    return out.select("path", F.col("at").alias("target"))
