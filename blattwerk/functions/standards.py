"""Technical standards: numbers, headers, recognition, titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blattwerk.functions.text import strip

# Issuers, additions and the form of a number.
BODY = r"(?:DIN|EN|ISO|IEC|VDI|VDE|DVS|CEN|CLC|ASTM|SEW|VDMA|DKE|IEEE|ANSI|BS|NF|ÖNORM|OENORM|SN)"
ADDITION = r"(?:SPEC|TS|TR|PAS|ISO|IEC|EN|VDE|CEN|CLC|V|IS|DIS|FDIS)"
NUMBER = rf"{BODY}(?:[ _/]+{ADDITION})*[ _]+\d+(?:[.-]\d+)*(?:[ _]*/[ _]*A\d+)?(?:[ _]+(?:Beiblatt|Berichtigung|Blatt|Teil)[ _]+\d+)?"
HEADER = rf"^\s*(E[ _]+)?({NUMBER})[ _]*:[ _]*((?:19|20)\d\d)-([01]\d)\s*$"
REFERENCE = rf"Ref\.?[ -]?Nr\.?\s*(E[ _]+)?({NUMBER})[ _]*:[ _]*((?:19|20)\d\d)-([01]\d)\b"
FILE = rf"^()({NUMBER})_((?:19|20)\d\d)-([01]\d)-\d\d_[A-Z]{{2}}_\d+.*$"
FREE_FILE = rf"^()({NUMBER})_+((?:19|20)\d\d)[-_]([01]\d)(?:[-_].*)?$"
NO_TITLE = r"^.*(?:Deutsches Institut für Normung|Vervielfältigung|Alleinverkauf|Preisgr|Vertr\.).*$"
TITLE_END = r"^(?:Deutsche(?: und Englische)? Fassung|Englische Fassung|Identisch mit|ICS\b|Ersatz f|Vorgesehen als|Einspr|Mit DIN|Anwendungswarnvermerk|German version|Welding\b)"


def normal_number(number: Column) -> Column:
    return F.regexp_replace(strip(F.regexp_replace(number, "[ _]+", " ")), r"\s*/\s*", "/")


def issuer(number: Column) -> Column:
    """The first sign of a number: who issues the standard."""
    sign = F.regexp_extract(number, r"^[A-ZÖ]+", 0)
    return F.when(sign != "", sign).otherwise(F.split(number, " ")[0])


def matched(text: Column, pattern: str) -> Column:
    """Struct ``entwurf``, ``nummer``, ``jahr``, ``monat`` of a match, else null."""
    part = lambda k: F.regexp_extract(text, pattern, k)
    return F.when(text.rlike(pattern), F.struct((part(1) != "").alias("entwurf"), normal_number(part(2)).alias("nummer"), part(3).alias("jahr"), part(4).alias("monat")))


def header_counts(lines: DataFrame, edge: int = 3) -> DataFrame:
    """``doc``, header struct, ``pages``, ``first``: headers in the edge lines, once a page."""
    up, down = Window.partitionBy("doc", "page").orderBy("pos"), Window.partitionBy("doc", "page").orderBy(F.desc("pos"))
    near = lines.withColumn("a", F.row_number().over(up)).withColumn("b", F.row_number().over(down)).where(f"a <= {edge} or b <= {edge}")
    return near.withColumn("h", matched(F.col("line"), HEADER)).where("h is not null").groupBy("doc", "h").agg(F.countDistinct("page").alias("pages"), F.min("page").alias("first"))


# Months, a number by itself, a date on a cover, pages of a cover, share of pages.
MONTHS = ("januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember")
ALONE = rf"^({NUMBER})(?:\s+[A-Z])?\s*$"
COVER_DATE = rf"(?iU)(?:^|\s)({'|'.join(MONTHS)})\s+((?:19|20)\d\d)\b"
COVER, HEADER_SHARE = 4, 0.25


def recognised(docs: DataFrame, lines: DataFrame, outline: DataFrame | None = None) -> DataFrame:
    """``doc``, ``norm``, ``quelle``: the standard that each document is, if it is one.

    In this order: its most frequent header, if it stands on two pages and on a
    quarter of the pages with text or first on one of the cover pages; a
    reference number there; its first bookmark, by itself or with the first date
    of the first two pages; the name of its file. Of equally frequent headers
    the one that stands first counts. ``docs`` has ``doc`` and ``name``, ``outline`` ``doc``,
    ``page``, ``pos``, ``title``.
    """
    full = lines.where(strip(F.col("line")) != "").groupBy("doc").agg(F.countDistinct("page").alias("full"))
    head = header_counts(lines).groupBy("doc").agg(F.max_by(F.struct("h", "pages", "first"), F.struct("pages", -F.col("first"), "h")).alias("x")).join(full, "doc")
    often = (F.col("x.pages") >= F.greatest(F.lit(2.0), HEADER_SHARE * F.col("full"))) | ((F.col("x.pages") >= 2) & (F.col("x.first") < COVER))
    head = head.where(often).select("doc", F.col("x.h").alias("kopf"))
    ref = lines.where(F.col("page") < COVER).withColumn("r", matched(F.col("line"), REFERENCE)).where("r is not null").groupBy("doc").agg(F.min_by("r", F.struct("page", "pos")).alias("ref"))
    j = docs.join(head, "doc", "left").join(ref, "doc", "left")
    if outline is None:
        j = j.withColumn("zeichen", F.lit(None).cast("string")).withColumn("datum", F.lit(None).cast("struct<monat:string,jahr:string>"))
    else:
        date = F.struct(F.lpad(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract("line", COVER_DATE, 1))).cast("string"), 2, "0").alias("monat"), F.regexp_extract("line", COVER_DATE, 2).alias("jahr"))
        dates = lines.where((F.col("page") < 2) & F.col("line").rlike(COVER_DATE)).groupBy("doc").agg(F.min_by(date, F.struct("page", "pos")).alias("datum"))
        first = outline.groupBy("doc").agg(F.min_by("title", F.struct("page", "pos")).alias("zeichen"))
        j = j.join(first, "doc", "left").join(dates, "doc", "left")
    dated = F.when(F.col("zeichen").rlike(ALONE) & F.col("datum").isNotNull(), F.struct(F.lit(False).alias("entwurf"), normal_number(F.regexp_extract("zeichen", ALONE, 1)).alias("nummer"), F.col("datum.jahr").alias("jahr"), F.col("datum.monat").alias("monat")))
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    ways = {
        "Kopfzeile der Norm": F.col("kopf"), "Ref.-Nr. auf der Titelseite": F.col("ref"), "Lesezeichen der Norm": matched(F.col("zeichen"), HEADER),
        "Lesezeichen und Datum auf dem Deckblatt": dated, "Dateiname (Normen-Download)": matched(stem, FILE), "Dateiname": matched(stem, FREE_FILE),
    }
    hits = F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(c.alias("norm"), F.lit(q).alias("quelle"))) for q, c in ways.items()]))
    return j.select("doc", F.get(hits, F.lit(0)).alias("x")).where("x is not null").select("doc", "x.norm", "x.quelle")


def cover_titles(lines: DataFrame, tolerance: float = 0.6) -> DataFrame:
    """``doc``, ``title``: the largest lines of the first four pages after the number, of one
    size, up to where titles end. ``lines`` has ``size``."""
    c = lines.where((F.col("page") < 4) & ~F.col("line").rlike(NO_TITLE) & (strip(F.col("line")) != ""))
    number = strip(F.col("line")).rlike(rf"^{NUMBER}(?:\s+[A-Z])?$")
    w = Window.partitionBy("doc", "page").orderBy("pos")
    c = c.withColumn("after", F.sum(number.cast("int")).over(w)).withColumn("stop", F.sum(F.col("line").rlike(TITLE_END).cast("int")).over(w)).where((F.col("after") > 0) & (F.col("stop") == 0) & ~number)
    big = c.groupBy("doc").agg(F.min("page").alias("p")).join(c, "doc").where("page = p")
    top = big.groupBy("doc").agg(F.max("size").alias("m"))
    t = big.join(top, "doc").where(F.abs(F.col("size") - F.col("m")) <= tolerance)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: strip(x["line"]))
    joined = F.regexp_replace(F.array_join(parts, " "), r"\s*\((?:ISO|IEC|EN)[^()]*:\d{4}[^()]*\)\s*$", "")
    return t.groupBy("doc").agg(joined.alias("title"))
