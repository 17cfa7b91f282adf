"""Plans as tables: what would be renamed, renewed, listed, routed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blattwerk.functions import text as T
from blattwerk.sources.readers import SUFFIXES


def target_name(title: Column, author: Column, year: Column, most: int = 120) -> Column:
    """``Title - Author - Year``; a long title loses its subtitle, then its last words."""
    a = T.short_author(author)
    a = F.when(F.length(a) > 50, F.concat(F.rtrim(F.substring(a, 1, 49)), F.lit("…"))).otherwise(a)
    end = T.file_name_safe(F.concat(a, F.lit(" - "), year))
    t = T.file_name_safe(title)
    room = F.lit(most) - F.length(end) - 3
    parts = F.split(t, " – ")
    kept = F.aggregate(
        F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), parts[0],
        lambda acc, i: F.when((i <= F.size(parts)) & (F.length(F.array_join(F.slice(parts, 1, i), " – ")) <= room), F.array_join(F.slice(parts, 1, i), " – ")).otherwise(acc),
    )
    cut = F.expr("1") * 0 + room - 1
    clipped = F.substring(kept, F.lit(1), cut)
    word = F.regexp_replace(clipped, r"[ ,][^ ,]*$", "")
    short = F.concat(F.regexp_replace(F.when(F.length(word) > room / 2, word).otherwise(clipped), r"[ ,.;:–-]+$", ""), F.lit("…"))
    return F.concat(F.when(F.length(t) <= room, t).when(F.length(kept) <= room, kept).otherwise(short), F.lit(" - "), end)


def free_names(wanted: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """``wanted`` (``stem``) with ``frei``: equal names get `` (2)``, `` (3)``, counted on from the
    names that exist; case doesn't matter. ``existing`` has ``stem``."""
    base = lambda c: F.lower(F.regexp_replace(c, r" \(\d+\)$", ""))
    number = F.coalesce(F.nullif(F.regexp_extract("stem", r" \((\d+)\)$", 1), F.lit("")).try_cast("int"), F.lit(1))
    taken = existing.select(base(F.col("stem")).alias("k"), number.alias("n")).groupBy("k").agg(F.max("n").alias("taken"))
    w = wanted.withColumn("k", F.lower("stem")).join(taken, "k", "left")
    n = F.row_number().over(Window.partitionBy("k").orderBy(order)) + F.coalesce("taken", F.lit(0))
    return w.withColumn("frei", F.when(n == 1, F.col("stem")).otherwise(F.concat("stem", F.lit(" ("), n.cast("string"), F.lit(")")))).drop("k", "taken")


def rename_plan(docs: DataFrame) -> DataFrame:
    """``docs`` (``name``, ``soll``) whose name isn't the one it should have; a number in
    parentheses, case and the form of accents don't count."""
    k = lambda c: F.lower(T.normalized(F.regexp_replace(c, r" \(\d+\)$", "")))
    return docs.where(k(F.col("name")) != k(F.col("soll")))


def with_original(markdown: DataFrame, files: DataFrame) -> DataFrame:
    """``markdown`` (``stem``) with ``original``: the file of the same stem, by the order of suffixes."""
    rank = F.array_position(F.array(*map(F.lit, SUFFIXES)), F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)))
    f = files.withColumn("r", rank).where("r > 0").withColumn("k", F.lower(F.regexp_replace("name", r"\.[^.]*$", "")))
    best = f.groupBy("k").agg(F.min_by("name", F.struct("r", "name")).alias("original"))
    return markdown.withColumn("k", F.lower("stem")).join(best, "k", "left").drop("k")


def refresh_plan(docs: DataFrame, procedure: str, style: str = "IEEE") -> DataFrame:
    """Documents made by another procedure, or cited in another style where cited at all."""
    other = F.when(F.coalesce("quellenangabe", F.lit("")) != "", F.coalesce(F.nullif("zitierstil", F.lit("")), F.lit("IEEE")) != style).otherwise(F.lit(False))
    return docs.where((F.coalesce("textquelle", F.lit("")) != procedure) | other)


def bibliography_plan(entries: DataFrame, order: str) -> DataFrame:
    """``entries`` (``key``) with ``schluessel``: unique keys, the second with b, then c, after z
    with numbers; a made key that is a natural one gets a further number."""
    n = F.row_number().over(Window.partitionBy("key").orderBy(order))
    suffix = F.when(n == 1, "").when(n <= 26, F.char(n + 96)).otherwise(n.cast("string"))
    e = entries.withColumn("made", F.concat("key", suffix))
    twin = F.row_number().over(Window.partitionBy("made").orderBy(F.length("key").desc(), order))
    return e.withColumn("schluessel", F.when(twin == 1, F.col("made")).otherwise(F.concat("made", F.lit("_"), twin.cast("string")))).drop("made")


def routed(docs: DataFrame, problems: Column) -> DataFrame:
    """``docs`` with ``pruefen`` and ``target``: complete ones are done, others in review."""
    return docs.withColumn("pruefen", problems).withColumn("target", F.when(F.col("pruefen").isNull(), "Fertig").otherwise("Prüfen"))


def renewed(old: DataFrame, new: DataFrame, fields: list[str], key: str) -> DataFrame:
    """``old`` with ``fields`` from ``new``, but for those a person filled in by hand."""
    n = new.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    by_hand = lambda f: F.startswith(F.coalesce(F.col(f"{f}_quelle"), F.lit("")), F.lit("manuell")) if f"{f}_quelle" in old.columns else F.lit(False)
    j = old.join(n, key, "left")
    return j.withColumns({f: F.when(by_hand(f), F.col(f)).otherwise(F.coalesce(f"__{f}", f)) for f in fields}).drop(*[f"__{f}" for f in fields])


def changed_files(now: DataFrame, cached: DataFrame, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Files to compute anew, and cached rows of files that are gone."""
    keys = keys or ["name", "groesse", "zeit", "verfahren"]
    return now.join(cached.select(*keys), keys, "left_anti"), cached.join(now.select("name"), "name", "left_anti")
