"""Whole documents from lines: the stages in their order, each one a setting may switch off."""

from __future__ import annotations

import shutil
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blattwerk.config import settings
from blattwerk.functions import citations, text
from blattwerk.operators import metrics, pages
from blattwerk.session import cut, salted_left_join
from blattwerk.sources.readers import SUFFIXES


def assembled(lines: DataFrame, outline: DataFrame | None = None, labels: DataFrame | None = None, config: Mapping[str, Any] | None = None) -> DataFrame:
    """``doc``, ``page``, ``text``: cleaned pages with markers, headings and joins over page turns.

    Put together in order the rows are the document, see ``pages.whole_documents``. A stage that is switched off never enters the plan. ``outline`` has ``doc``,
    ``page``, ``pos``, ``level``, ``title``; ``labels`` ``doc``, ``page``, ``label``.
    """
    c = config or settings()
    lines = lines.withColumn("line", text.without_licence_marks(F.col("line"))).where((text.strip(F.col("line")) != "") & ~text.strip(F.col("line")).rlike(text.EMPTY_PAGE))
    # stages read their input several times: each is written once, so plans stay small
    lines = cut(pages.without_barcodes(pages.split_glued_number(lines)))
    all_pages = lines.select("doc", "page").distinct()
    printed = all_pages.withColumn("printed", F.lit(None).cast("string"))
    if c["text.gedruckte_seitenzahlen"]:
        numbers = pages.margin_numbers(all_pages, pages.number_candidates(lines, c["number.rand"]))
        none = all_pages.withColumn("label", F.lit(None).cast("string"))
        printed = pages.page_labels(numbers, labels if labels is not None else none).select("doc", "page", "printed")
        printed = cut(printed)
        lines = pages.without_running_titles(lines, printed, c["text.kolumnentitel_rand"], c["text.kolumnentitel_anteil"])
    lines = cut(pages.without_running_lines(cut(lines)))
    if outline is not None and c["text.ueberschriften_aus_lesezeichen"]:
        lines = cut(with_headings(lines, cut(pages.shifted_outline(pages.outline(outline), lines))))
    paras = pages.paragraphs(lines.withColumn("line", text.clean_lines(F.col("line"))))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("absatz", "text"))), lambda x: x["text"])
    page = paras.groupBy("doc", "page").agg(F.array_join(parts, "\n\n").alias("text")).join(printed, ["doc", "page"], "left")
    if not c["text.seitenmarker"]:
        first = page.where("text <> ''").groupBy("doc").agg(F.min("page").alias("__first"))
        lead = F.when(F.col("page") == F.col("__first"), "").otherwise("\n\n")
        return salted_left_join(page.where("text <> ''"), first, ["doc"], 16, F.col("page")).select("doc", "page", F.concat(lead, "text").alias("text"))
    return pages.join_pages(page)


def with_headings(lines: DataFrame, outline: DataFrame, only_found: bool = False) -> DataFrame:
    """``lines`` with outline titles as Markdown headings in their place.

    A title takes the line, or the lines together, that say it; a line is taken
    once. Titles that don't stand on their page go to its top unless
    ``only_found``.
    """
    at = pages.heading_lines(outline, lines)
    order = F.row_number().over(Window.partitionBy("doc", "page", "pos").orderBy("level", "title"))
    at = at.withColumn("n", F.when(F.col("pos").isNotNull(), order))
    mark = F.concat(F.repeat(F.lit("#"), F.col("level").cast("int")), F.lit(" "), F.col("title"))
    hit = at.where("n = 1").select("doc", "page", "pos", "rows", mark.alias("heading"))
    gone = hit.select("doc", "page", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("rows") - 1)).alias("pos"))
    rest = lines.join(gone, ["doc", "page", "pos"], "left_anti")
    out = rest.unionByName(hit.select("doc", "page", "pos", F.col("heading").alias("line")), allowMissingColumns=True)
    if not only_found:
        top = at.where("n is null or n > 1").join(lines.select("doc", "page").distinct(), ["doc", "page"], "left_semi")
        rank = F.row_number().over(Window.partitionBy("doc", "page").orderBy("level", "title"))
        out = out.unionByName(top.select("doc", "page", (rank - 10_000).alias("pos"), mark.alias("line")), allowMissingColumns=True)
    return out


def looked_up(docs: DataFrame, table: DataFrame) -> DataFrame:
    """``docs`` (``doc``, ``kennungen``) with ``satz``: the record of the first identifier that the
    lookup table (``kennung``, ``satz``) knows. Nothing is fetched from a network."""
    ids = docs.select("doc", F.posexplode("kennungen").alias("p", "kennung"))
    best = ids.join(table, "kennung").groupBy("doc").agg(F.min_by("satz", "p").alias("satz"))
    return docs.join(best, "doc", "left")


CROSSREF = (
    "title array<string>, subtitle array<string>, author array<struct<given:string,family:string>>, editor array<struct<given:string,family:string>>, publisher string, "
    "`publisher-location` string, `edition-number` string, `published-print` struct<`date-parts`:array<array<int>>>, issued struct<`date-parts`:array<array<int>>>, "
    "`published-online` struct<`date-parts`:array<array<int>>>, ISBN array<string>, DOI string, type string, page string"
)


def crossref_record(raw: Column) -> Column:
    """A bibliographic record from the JSON of a lookup; null where it can't be read."""
    m = F.from_json(raw, CROSSREF)
    year = F.coalesce(*[F.get(F.get(m[f]["date-parts"], F.lit(0)), F.lit(0)) for f in ("published-print", "issued", "published-online")]).cast("string")
    people = lambda f: F.filter(F.coalesce(m[f], F.array().cast("array<struct<given:string,family:string>>")), lambda p: p["family"].isNotNull())
    title = citations.full_title(citations.without_html(F.get(m["title"], F.lit(0))), citations.without_html(F.get(m["subtitle"], F.lit(0))))
    fields = F.struct(
        title.alias("titel"), people("author").alias("autoren"), people("editor").alias("herausgeber"), m["publisher"].alias("verlag"), citations.first_place(m["publisher-location"]).alias("ort"),
        m["edition-number"].alias("auflage"), year.alias("jahr"), F.get(m["ISBN"], F.lit(0)).alias("isbn"), m["DOI"].alias("doi"), m["type"].alias("typ"), m["page"].alias("seiten"),
    )
    return F.when(m.isNotNull() & title.isNotNull(), fields)


def chapter_places(texts: DataFrame) -> DataFrame:
    """``doc``, ``doi``, ``at``, ``page``: identifiers of chapters with the page marker before each."""
    dois = texts.select("doc", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(10\.\d{4,9}/[^\s\"<>()]+_\d+)(?![\w])"), 1))).alias("doi"), "text")
    at = dois.select("doc", "doi", F.expr("locate(doi, text)").cast("long").alias("at"))
    marks = texts.select("doc", F.explode(F.regexp_extract_all("text", F.lit(r"(<!-- (?:Seite \S+ \(PDF \d+\)|PDF-Seite \d+) -->)"), 1)).alias("m"), "text")
    marks = marks.select("doc", F.expr("locate(m, text)").cast("long").alias("at"), F.regexp_extract("m", r"(\d+)\)? -->", 1).cast("int").alias("page")).distinct()
    before = pages.marker_before(at.select("doc", "at").distinct(), marks)
    return at.join(before, ["doc", "at"], "left")


def with_chapter_citations(texts: DataFrame, cited: DataFrame) -> DataFrame:
    """``doc``, ``text``: each chapter's citation set after the line that has its identifier.

    ``cited`` has ``doc``, ``doi``, ``zitat``; a document's chapters are few.
    """
    own = cited.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("doi", "zitat"))).alias("z"))
    j = texts.join(own, "doc", "left")
    line = lambda t, e: F.when(F.contains(t, e["doi"]) & ~F.startswith(t, F.lit("> ")), F.concat(t, F.lit("\n> "), e["zitat"])).otherwise(t)
    each = F.transform(F.split("text", "\n"), lambda t: F.aggregate(F.coalesce("z", F.array().cast("array<struct<doi:string,zitat:string>>")), t, lambda a, e: F.when(F.contains(t, e["doi"]), line(a, e)).otherwise(a)))
    return j.select("doc", F.array_join(each, "\n").alias("text"))


def outline_agreement(contents: DataFrame, outline: DataFrame, printed: DataFrame) -> DataFrame:
    """``doc``, ``gleich``, ``anders``: pages of a printed table of contents against the outline.

    ``contents`` has ``doc``, ``line`` with a page at the end; titles that occur once count.
    """
    c = contents.withColumn("k", pages.title_key(F.regexp_replace("line", r"[\s.…]*\d+\s*$", ""))).withColumn("said", F.regexp_extract("line", r"(\d+)\s*$", 1)).where("said <> '' and k <> ''")
    o = outline.withColumn("k", pages.title_key(F.col("title"))).groupBy("doc", "k").agg(F.count("*").alias("n"), F.min("page").alias("page")).where("n = 1")
    j = c.join(o, ["doc", "k"]).join(printed, ["doc", "page"])
    return j.groupBy("doc").agg(F.count_if(F.col("said") == F.col("printed")).alias("gleich"), F.count_if(F.col("said") != F.col("printed")).alias("anders"))


def review_list(heads: DataFrame) -> DataFrame:
    """``name``, ``grund``, ``bereit``: documents in review; ready ones have no reason left."""
    return heads.select("name", text.or_null(F.col("pruefen")).alias("grund"), text.or_null(F.col("pruefen")).isNull().alias("bereit")).orderBy(F.lower("name"))


def promoted(review: DataFrame, fields: tuple[str, ...] = ("titel", "autor", "jahr")) -> DataFrame:
    """Documents of the review that are complete now; values changed by hand say so.

    ``review`` has the fields, their ``_quelle`` and ``_alt`` (the value before).
    """
    problem = text.first_problem({f: F.col(f) for f in fields}, F.lit(False), F.lit(False))
    done = review.where(problem.isNull())
    by_hand = {f"{f}_quelle": F.when(~F.col(f).eqNullSafe(F.col(f"{f}_alt")), F.lit("manuell")).otherwise(F.col(f"{f}_quelle")) for f in fields}
    return done.withColumns(by_hand).withColumn("status", F.lit("NACHGEBESSERT"))


def with_standard(docs: DataFrame) -> DataFrame:
    """``docs`` whose recognised standard gives title, author and year, and says so."""
    has = F.col("norm").isNotNull()
    over = lambda f, v: F.when(has & v.isNotNull(), v).otherwise(F.col(f))
    issuer = F.regexp_extract("norm.nummer", r"^[A-ZÖ]+", 0)
    note = lambda f, v: F.when(has & v.isNotNull(), F.lit("Norm")).otherwise(F.col(f"{f}_quelle"))
    new = {"titel": F.concat_ws(": ", "norm.nummer", "norm.titel"), "autor": issuer, "jahr": F.col("norm.jahr")}
    return docs.select(*[c for c in docs.columns if c not in new and c not in {f"{k}_quelle" for k in new}], *[over(k, v).alias(k) for k, v in new.items()], *[note(k, v).alias(f"{k}_quelle") for k, v in new.items()])


def procedure(config: Mapping[str, Any]) -> str:
    """The note of the stages that are on."""
    names = (("text.formeln_reparieren", "Formelreparatur"), ("text.formelsatz", "Formelsatz"), ("text.ueberschriften_aus_lesezeichen", "Lesezeichen"), ("text.spaltenreihenfolge", "Spaltenreihenfolge"), ("text.tabellen_erkennen", "Tabellen"), ("text.gedruckte_seitenzahlen", "Seitenzahlen"))
    return " + ".join(["Zeilen", *[n for k, n in names if config[k]]])


def usable_sentence(s: Column) -> Column:
    """Whether a sentence may be sampled: eight words, forty letters, no table or formula."""
    words = F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))
    return (words >= 8) & ~s.rlike(r"[|$�]") & ~F.startswith(s, F.lit("#")) & (F.length(F.regexp_replace(s, r"[^\p{L}\p{N}]", "")) >= 40)


def dashboard(figures: DataFrame, heads: DataFrame, review: DataFrame) -> dict[str, DataFrame]:
    """The reports over one table of figures, which should be stored or cached."""
    return {
        "herkunft": metrics.provenance_counts(heads), "zitate": metrics.complete_citations(figures), "summen": metrics.text_sums(figures),
        "qualitaet": metrics.quality(figures), "offen": metrics.open_spots(figures), "uebersicht": metrics.overview(figures, review),
    }


def copied(sources: list[str], inbox: str) -> dict[str, list[str]]:
    """Files copied to the inbox under free names; those missing, of another kind or
    there already are reported and left."""
    out: dict[str, list[str]] = {"kopiert": [], "fehlt": [], "format": [], "da": []}
    for s in map(Path, sources):
        if not s.is_file():
            out["fehlt"].append(s.name)
        elif s.suffix.lower().lstrip(".") not in SUFFIXES:
            out["format"].append(s.name)
        elif s.parent.resolve() == Path(inbox).resolve():
            out["da"].append(s.name)
        else:
            n, target = 2, Path(inbox) / s.name
            while target.exists():
                n, target = n + 1, Path(inbox) / f"{s.stem} ({n}){s.suffix}"
            shutil.copy2(s, target)
            out["kopiert"].append(target.name)
    return out
