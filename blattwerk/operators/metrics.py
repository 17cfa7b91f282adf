"""Figures of documents and of the stock, as plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blattwerk.functions.text import UNSURE, first_number, strip

# Kinds of provenance, summed figures, points of quality.
CATEGORIES = ("Crossref", "Norm", "Text", "PDF-Metadaten", "Dokument", "von Hand", "fehlt")
SUMS = ("seiten", "formelzeichen", "unsicher", "fragezeichen", "tabellen", "ueberschriften", "spaltenseiten", "hochtief", "formelteile", "gedruckt", "nur_pdf")
TABLE_TITLE = r"(?m)^[ \t]*(?:#+[ \t]*)?(?:Tabelle|Tab\.|Table)[ \t]*([A-Z]?\d+(?:[.\-–]\d+)*)"
POINTS = (
    ("Formelzeichen repariert", "Formelreparatur", "formelzeichen", "formelzeichen + fragezeichen"),
    ("Verbliebene �", "Formelreparatur", "fragezeichen", "formelzeichen + fragezeichen"),
    ("Formeln unsicher markiert", "Formelsatz", "unsicher", "formelzeilen"),
    ("Tabellen als Markdown", "Tabellen", "tabellen", "tabellentitel"),
    ("Überschriften direkt im Text", "Lesezeichen", "ueberschriften_im_text", "ueberschriften"),
    ("Spaltenseiten umsortiert", "Spaltenreihenfolge", "spaltenseiten", "seiten"),
    ("Seiten mit gedruckter Zahl", "Seitenzahlen", "gedruckt", "gedruckt + nur_pdf"),
    ("Bücher mit aktuellem Verfahren", None, "cast(aktuell as int)", "1"),
)


def provenance(source: Column) -> Column:
    """The category of a source note."""
    q = strip(F.coalesce(source, F.lit("")))
    return (
        F.when(q == "", "fehlt")
        .when(F.contains(q, F.lit("Crossref")), "Crossref")
        .when(F.contains(q, F.lit("Norm")) | F.startswith(q, F.lit("Ausgabe ")), "Norm")
        .when(F.contains(q, F.lit("im Text")) | F.contains(q, F.lit("Copyright")), "Text")
        .when(q == "PDF-Metadaten", "PDF-Metadaten")
        .when(F.startswith(q, F.lit("manuell")), "von Hand")
        .otherwise("Dokument")
    )


def text_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the figures that its text alone gives. Null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    formula = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"\$[^$\n]+\$"))
    titles = F.array_distinct(F.regexp_extract_all(t, F.lit(TABLE_TITLE), 1))
    return docs.withColumns(
        {
            "gedruckt": F.regexp_count(t, F.lit(r"<!-- Seite \S+ \(PDF \d+\) -->")),
            "nur_pdf": F.regexp_count(t, F.lit(r"<!-- PDF-Seite \d+ -->")),
            "fragezeichen": F.length(t) - F.length(F.replace(t, F.lit("�"), F.lit(""))),
            "unsicher": ((F.length(t) - F.length(F.replace(t, F.lit(UNSURE), F.lit("")))) / len(UNSURE)).cast("int"),
            "formelzeilen": F.size(formula),
            "tabellentitel": F.size(titles),
        }
    )


def head_metrics(docs: DataFrame, head: str = "kopf", current: str | None = None) -> DataFrame:
    """``docs`` with the figures of its front matter, a map of strings."""
    v = lambda k: F.try_element_at(F.col(head), F.lit(k))
    quelle = lambda f: F.when(F.coalesce(v(f), F.lit("")) != "", provenance(v(f + "_quelle"))).otherwise("fehlt")
    procedure = F.transform(F.split(F.coalesce(v("textquelle"), F.lit("")), r"\+"), strip)
    cited = F.coalesce(v("zitierdaten_quelle"), F.lit(""))
    has = lambda k: F.coalesce(v(k), F.lit("")) != ""
    return docs.withColumns(
        {
            "seiten": F.coalesce(v("seiten").try_cast("int"), F.lit(0)),
            "formelzeichen": first_number(v("formelreparatur"), r"\((\d+) Zeichen ersetzt\)"),
            "hochtief": first_number(v("formelsatz"), r"(\d+) Hoch-/Tiefstellungen"),
            "formelteile": first_number(v("formelsatz"), r"(\d+) Formelteile"),
            "tabellen": first_number(v("tabellen"), r"(\d+)"),
            "ueberschriften": first_number(v("lesezeichen"), r"(\d+)"),
            "ueberschriften_im_text": first_number(v("lesezeichen"), r"\((\d+) direkt im Text"),
            "spaltenseiten": first_number(v("spalten"), r"(\d+)"),
            "verfahren": F.slice(procedure, F.lit(2), F.greatest(F.size(procedure) - 1, F.lit(0))),
            "quellen": F.create_map(*[x for f in ("titel", "autor", "jahr") for x in (F.lit(f), quelle(f))]),
            "ieee": has("quellenangabe") & (has("norm") | (cited != "") & ~F.startswith(cited, F.lit("nur "))),
            "norm": has("norm"),
            "pruefen": F.nullif(v("pruefen"), F.lit("")),
            "format": F.coalesce(F.nullif(F.upper(F.regexp_extract(F.coalesce(v("originaldatei"), F.lit("")), r"\.([^.]*)$", 1)), F.lit("")), F.lit("?")),
            "aktuell": F.lit(current).isNotNull() & F.coalesce(v("textquelle") == F.lit(current), F.lit(False)),
        }
    )


def provenance_counts(heads: DataFrame, fields: tuple[str, ...] = ("titel", "autor", "jahr")) -> DataFrame:
    """``feld``, ``kategorie``, ``anzahl``: where the values of each field come from.

    ``heads`` has each field and its ``<field>_quelle``; a field without a value
    counts as missing.
    """
    each = F.array(*[F.struct(F.lit(f).alias("feld"), F.when(F.coalesce(F.col(f), F.lit("")) == "", "fehlt").otherwise(provenance(F.col(f + "_quelle"))).alias("kategorie")) for f in fields])
    return heads.select(F.explode(each).alias("x")).groupBy("x.feld", "x.kategorie").agg(F.count("*").alias("anzahl"))


def reasons(heads: DataFrame, column: str, order: str, n: int = 6) -> DataFrame:
    """The ``n`` most frequent reasons of a list joined by ``;``; of equally frequent
    ones the one that comes first."""
    one = heads.select(F.col(order).alias("__o"), F.posexplode(F.split(F.col(column), ";")).alias("__p", "g")).withColumn("grund", strip(F.col("g"))).where("grund <> ''")
    return one.groupBy("grund").agg(F.count("*").alias("anzahl"), F.min(F.struct("__o", "__p")).alias("__first")).orderBy(F.desc("anzahl"), "__first").limit(n).select("grund", "anzahl")


def text_sums(metrics: DataFrame) -> DataFrame:
    """One row: sums over all documents, counts, and the printed share or null."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS if c in metrics.columns]
    both = F.col("gedruckt") + F.col("nur_pdf")
    return metrics.agg(*sums, F.count("*").alias("buecher"), F.count_if(both > 0).alias("gedruckt_erfasst")).withColumn("gedruckt_anteil", F.try_divide("gedruckt", both))


def quality(metrics: DataFrame) -> DataFrame:
    """The points of quality: value and most possible value over the documents
    that the point's procedure ran on. One pass, eight pairs of sums."""
    aggs = []
    for n, (_, procedure, value, most) in enumerate(POINTS):
        on = F.lit(True) if procedure is None else F.array_contains("verfahren", procedure)
        aggs += [
            F.coalesce(F.sum(F.when(on, F.expr(value))), F.lit(0)).alias(f"v{n}"),
            F.coalesce(F.sum(F.when(on, F.expr(most))), F.lit(0)).alias(f"m{n}"),
            F.count_if(on).alias(f"b{n}"),
        ]
    one = metrics.agg(*aggs, F.count("*").alias("alle"))
    rows = [F.struct(F.lit(p[0]).alias("titel"), F.col(f"v{n}").cast("long").alias("wert"), F.col(f"m{n}").cast("long").alias("max"), F.col(f"b{n}").alias("buecher"), F.col("alle").alias("alle")) for n, p in enumerate(POINTS)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def open_spots(metrics: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` documents with most defects per 100 pages."""
    defects = F.col("fragezeichen") + F.col("unsicher") + F.col("nur_pdf")
    per = F.bround(F.col("offen") * 100 / F.greatest(F.col("seiten"), F.lit(1)), 1)
    return (
        metrics.withColumn("offen", defects).where("offen > 0").withColumn("je_100", per)
        .orderBy(F.desc("je_100"), F.desc("offen"), "name").limit(n)
        .select("name", "seiten", "fragezeichen", "unsicher", "nur_pdf", "offen", "je_100")
    )


def inventory(areas: dict[str, DataFrame]) -> DataFrame:
    """``bereich``, ``format``, ``anzahl`` over areas that each have ``name``."""
    suffix = F.coalesce(F.nullif(F.upper(F.regexp_extract("name", r"\.([^.]*)$", 1)), F.lit("")), F.lit("?"))
    parts = [df.select(F.lit(a).alias("bereich"), suffix.alias("format")) for a, df in areas.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("bereich", "format").agg(F.count("*").alias("anzahl"))


def overview(metrics: DataFrame, review: DataFrame) -> DataFrame:
    """One row of headline figures."""
    done = metrics.agg(
        F.count("*").alias("fertig"), F.coalesce(F.sum("seiten"), F.lit(0)).alias("seiten"), F.coalesce(F.sum("gedruckt"), F.lit(0)).alias("g"),
        F.coalesce(F.sum("nur_pdf"), F.lit(0)).alias("p"), F.count_if(F.col("gedruckt") + F.col("nur_pdf") > 0).alias("mit_markern"),
    )
    waiting = review.agg(F.count("*").alias("pruefen"), F.count_if("bereit").alias("bereit"))
    return done.withColumn("k", F.lit(1)).join(waiting.withColumn("k", F.lit(1)), "k").select("fertig", "pruefen", "bereit", "seiten", F.try_divide("g", F.col("g") + F.col("p")).alias("gedruckt_anteil"), "mit_markern")


def complete_citations(metrics: DataFrame) -> DataFrame:
    """``vollstaendig`` and ``alle``."""
    return metrics.agg(F.count_if("ieee").alias("vollstaendig"), F.count("*").alias("alle"))


def signature(files: DataFrame) -> DataFrame:
    """One row: 16 hex characters that change with any name, size or time."""
    line = F.concat_ws("|", "name", F.col("groesse").cast("string"), F.col("zeit").cast("string"))
    # folder listings are small; the list is one row by definition
    return files.agg(F.substring(F.sha1(F.array_join(F.array_sort(F.collect_list(line)), "\n")), 1, 16).alias("signatur"))
