"""Named queries of the core over whole tables, and their SQL twins for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blattwerk import oracles
from blattwerk.functions import citations, standards, text
from blattwerk.operators import layout, listing, log, metrics, pages, repair, styles
from blattwerk.plans import assembly, plans
from blattwerk.session import cut, table
from blattwerk.sources import readers


def book_lines(spark: SparkSession, d: str) -> DataFrame:
    """The latest reading of each line as ``doc``, ``page``, ``pos``, ``line``; null lines left out."""
    # laid out by page, as what follows is by page: the lines are shuffled once
    z = table(spark, d, "zeilen").select("zeile_id", "buch_id", "seite", "pos", "text", "gelesen_am").repartition("buch_id", "seite").groupBy("buch_id", "seite", "pos").agg(F.max_by("text", F.struct("gelesen_am", "zeile_id")).alias("line"))
    return z.where("line is not null").select(F.col("buch_id").alias("doc"), F.col("seite").alias("page"), "pos", "line")


_LINES = oracles.LINES


def books(spark: SparkSession, d: str) -> DataFrame:
    """The latest save of each book's front matter."""
    k = table(spark, d, "kopfbloecke")
    return k.groupBy("buch_id").agg(F.max_by(F.struct(*[c for c in k.columns if c != "buch_id"]), F.struct("geaendert_am", "kopf_id")).alias("k")).select("buch_id", "k.*")


_BOOKS = "books as (select * from kopfbloecke qualify row_number() over (partition by buch_id order by geaendert_am desc, kopf_id desc) = 1)"


def running_lines(spark: SparkSession, d: str) -> DataFrame:
    return pages.running_lines(book_lines(spark, d))


def edge_lines_removed(spark: SparkSession, d: str) -> DataFrame:
    lines = book_lines(spark, d)
    kept = pages.without_running_lines(lines).groupBy("doc").agg(F.count("*").alias("kept"))
    size = lines.groupBy("doc").agg(F.countDistinct("page").alias("pages"), F.count("*").alias("lines"))
    return size.join(kept, "doc", "left").select("doc", "pages", "lines", (F.col("lines") - F.coalesce("kept", F.lit(0))).alias("removed"))


def page_sizes(spark: SparkSession, d: str) -> DataFrame:
    return book_lines(spark, d).groupBy("doc", "page").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def sentence_breaks(spark: SparkSession, d: str) -> DataFrame:
    return pages.sentence_breaks(book_lines(spark, d))


def number_sections(spark: SparkSession, d: str) -> DataFrame:
    return pages.margin_sections(pages.number_candidates(book_lines(spark, d)))


def printed_numbers(spark: SparkSession, d: str) -> DataFrame:
    lines = book_lines(spark, d)
    return pages.margin_numbers(lines.select("doc", "page").distinct(), pages.number_candidates(lines))


def running_titles_removed(spark: SparkSession, d: str) -> DataFrame:
    lines = book_lines(spark, d)
    numbers = pages.margin_numbers(lines.select("doc", "page").distinct(), pages.number_candidates(lines))
    out = pages.without_running_titles(lines, numbers.withColumn("printed", F.col("number").cast("string")))
    return out.groupBy("doc").agg(F.count("*").alias("n_lines"))


def page_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return pages.paragraphs(book_lines(spark, d))


def outline_entries(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lesezeichen").select(F.col("buch_id").alias("doc"), F.col("seite").alias("page"), "pos", F.col("ebene").alias("level"), F.col("titel").alias("title"))
    return pages.outline(t)


def outline_shifted(spark: SparkSession, d: str) -> DataFrame:
    return pages.shifted_outline(outline_entries(spark, d), book_lines(spark, d))


def outline_lines(spark: SparkSession, d: str) -> DataFrame:
    return pages.heading_lines(outline_entries(spark, d), book_lines(spark, d))


def reading_changes(spark: SparkSession, d: str) -> DataFrame:
    """Lines gone and come between the first and the last reading of a book."""
    z = table(spark, d, "zeilen").where("text is not null").select(F.col("buch_id").alias("doc"), "seite", "pos", F.col("text").alias("line"), F.struct("gelesen_am", "zeile_id").alias("w"))
    first = z.groupBy("doc", "seite", "pos").agg(F.min_by("line", "w").alias("line"))
    last = z.groupBy("doc", "seite", "pos").agg(F.max_by("line", "w").alias("line"))
    return pages.line_difference(first, last)


def umlauts_completed(spark: SparkSession, d: str) -> DataFrame:
    """Every third word with one ``ü`` loses it; what the source's other words tell."""
    docs = table(spark, d, "documents").where("source is not null")
    w = docs.select(F.col("source").alias("doc"), F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-zäöüÄÖÜß]+)"), 1)).alias("w"), "doc_id")
    hurt = (F.col("doc_id") % 3 == 0) & (F.length("w") - F.length(F.replace("w", F.lit("ü"), F.lit(""))) == 1)
    return pages.completed_umlauts(w.select("doc", F.when(hurt, F.replace("w", F.lit("ü"), F.lit("�"))).otherwise(F.col("w")).alias("word")))


def weak_spots(spark: SparkSession, d: str) -> DataFrame:
    return pages.weaknesses(table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("doc"), "text"))


def styled(spark: SparkSession, d: str) -> DataFrame:
    """The latest reading of each line with its size, style and runs; null lines left out."""
    one = ["zeile_id", "text", "groesse", "fett", "kursiv", "laeufe"]
    z = table(spark, d, "zeilen").select("buch_id", "seite", "pos", "gelesen_am", *one).repartition("buch_id", "seite")
    z = z.groupBy("buch_id", "seite", "pos").agg(F.max_by(F.struct(*one), F.struct("gelesen_am", "zeile_id")).alias("z")).select("buch_id", "seite", "pos", "z.*").where("text is not null")
    runs = F.transform("laeufe", lambda r: F.struct(r["text"].alias("text"), F.coalesce(r["stil"], F.lit("")).alias("style")))
    return z.select("zeile_id", F.col("buch_id").alias("doc"), F.col("seite").alias("page"), "pos", "text", F.col("groesse").alias("size"), F.col("fett").alias("bold"), F.col("kursiv").alias("italic"), runs.alias("runs"))


def body_sizes(spark: SparkSession, d: str) -> DataFrame:
    return styles.body_size(styled(spark, d))


def size_headings(spark: SparkSession, d: str) -> DataFrame:
    return styles.headings(styled(spark, d))


def emphasised(spark: SparkSession, d: str) -> DataFrame:
    return styles.emphases(styled(spark, d))


def phrase_lines(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "hervorhebungen").select(F.col("hervorhebung_id").alias("id"), F.col("buch_id").alias("doc"), F.col("seite").alias("page"), "text")
    lines = book_lines(spark, d).withColumnRenamed("line", "text")
    return styles.phrase_positions(p, lines).select("id", "pos")


def paged_log(spark: SparkSession, d: str) -> DataFrame:
    size = books(spark, d).where("originaldatei is not null").groupBy(F.col("originaldatei").alias("name")).agg(F.max("seiten").alias("seiten"))
    return log.with_pages(table(spark, d, "protokoll"), size)


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    return log.run_summary(paged_log(spark, d))


def step_durations(spark: SparkSession, d: str) -> DataFrame:
    return log.step_durations(paged_log(spark, d), "eintrag_nr")


def undo_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The latest three runs are undone here, the fourth only says so in a note."""
    p = table(spark, d, "protokoll").select("eintrag_nr", "lauf", "status", "von_pfad", "nach_pfad", "hinweis")
    steps = p.where(F.col("status").isin(*log.UNDOABLE) & (F.col("von_pfad") != "") & (F.col("nach_pfad") != ""))
    last = steps.groupBy("lauf").agg(F.max("eintrag_nr").alias("nr")).orderBy(F.desc("nr")).limit(4).withColumn("k", F.row_number().over(Window.orderBy(F.desc("nr"))))
    back = steps.join(F.broadcast(last), "lauf").withColumns({"eintrag_nr": F.col("eintrag_nr") + 1_000_000_000, "hinweis": F.col("lauf"), "status": F.lit("RÜCKGÄNGIG"), "von_pfad": F.when(F.col("k") < 4, F.col("nach_pfad")).otherwise(""), "nach_pfad": F.col("von_pfad")})
    return log.undo_plan(p.unionByName(back.select(*p.columns)), "eintrag_nr")


def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    return log.latest_runs(table(spark, d, "protokoll"))


def provenance(spark: SparkSession, d: str) -> DataFrame:
    return metrics.provenance_counts(books(spark, d))


def review_reasons(spark: SparkSession, d: str) -> DataFrame:
    return metrics.reasons(books(spark, d), "pruefen", "buch_id")


def document_figures(spark: SparkSession, d: str) -> DataFrame:
    m = metrics.text_metrics(table(spark, d, "documents").select("doc_id", "text"))
    return m.drop("text")


def figure_sums(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.text_sums(document_figures(spark, d))
    return s.withColumn("gedruckt_anteil", F.round("gedruckt_anteil", 9))


def quality_points(spark: SparkSession, d: str) -> DataFrame:
    m = document_figures(spark, d)
    zero = {c: F.lit(0) for c in ("formelzeichen", "tabellen", "ueberschriften", "ueberschriften_im_text", "spaltenseiten")}
    return metrics.quality(m.withColumns(zero | {"seiten": F.col("gedruckt") + F.col("nur_pdf"), "verfahren": F.array(F.lit("Seitenzahlen"), F.lit("Formelsatz")), "aktuell": F.col("doc_id") % 2 == 0}))


def open_spots(spark: SparkSession, d: str) -> DataFrame:
    m = document_figures(spark, d).withColumn("name", F.format_string("d%09d", "doc_id")).withColumn("seiten", F.col("gedruckt") + F.col("nur_pdf"))
    return metrics.open_spots(m.withColumn("nur_pdf", F.col("formelzeilen")))


def inventory(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "protokoll")
    return metrics.inventory({a: p.where(F.col("ordner") == a).select(F.col("neuer_name").alias("name")) for a in ("Fertig", "Prüfen")} | {"Eingang": p.select(F.col("original_name").alias("name"))})


def signature(spark: SparkSession, d: str) -> DataFrame:
    return metrics.signature(books(spark, d).where("originaldatei is not null").select(F.col("originaldatei").alias("name"), F.col("seiten").alias("groesse"), F.col("buch_id").alias("zeit")))


def repeated_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce(text.repeated_lines(F.col("text")), F.lit(False)).alias("doppelt"))


def safe_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "kopfbloecke").where("titel is not null").select("kopf_id", text.file_name_safe(F.col("titel")).alias("name"), text.usable_title(F.col("titel")).alias("brauchbar"))


def short_authors(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("autor")
    return table(spark, d, "kopfbloecke").where("autor is not null").select("kopf_id", text.short_author(a).alias("kurz"), text.person_in_order(a).alias("person"))


def accepted_heads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "kopfbloecke").select("kopf_id", text.accepted_title(F.col("titel")).alias("titel"), text.accepted_author(F.col("autor")).alias("autor"))


def review_routing(spark: SparkSession, d: str) -> DataFrame:
    k = books(spark, d)
    problem = text.first_problem({c: F.col(c) for c in ("titel", "autor", "jahr")}, F.lit(False), F.coalesce("originaldatei", F.lit("")) == "")
    return plans.routed(k, problem).select("buch_id", "pruefen", "target")


def joined_words(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each page joined where a word goes on."""
    return pages.pages_to_text(book_lines(spark, d).select(F.concat_ws("/", "doc", "page").alias("doc"), F.col("pos").alias("page"), F.col("line").alias("text"))).select(
        "doc", text.join_divided(F.replace("text", F.lit("\n\n"), F.lit("\n"))).alias("text")
    )


def clean_pages(spark: SparkSession, d: str) -> DataFrame:
    p = pages.pages_to_text(book_lines(spark, d).select(F.concat_ws("/", "doc", "page").alias("doc"), F.col("pos").alias("page"), F.col("line").alias("text")))
    return p.select("doc", text.clean_lines(F.replace("text", F.lit("\n\n"), F.lit("\n"))).alias("text"))


def plain_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.length(text.without_markers(F.col("text"))).alias("n"))


def rename_candidates(spark: SparkSession, d: str) -> DataFrame:
    k = books(spark, d).where("titel is not null and autor is not null and jahr is not null and originaldatei is not null")
    stem = F.regexp_replace("originaldatei", r"\.[^.]*$", "")
    return plans.rename_plan(k.select("buch_id", stem.alias("name"), plans.target_name(F.col("titel"), F.col("autor"), F.col("jahr")).alias("soll")))


def collision_names(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "kopfbloecke").where("titel is not null").select("kopf_id", F.col("titel").alias("stem"))
    return plans.free_names(w, spark.createDataFrame([], "stem string"), "kopf_id").select("kopf_id", "frei")


def bibliography(spark: SparkSession, d: str) -> DataFrame:
    k = books(spark, d).where("titel is not null")
    people = citations.people_of(text.accepted_author(F.col("autor")))
    e = k.select("buch_id", citations.bibtex_key(people, F.regexp_extract(F.coalesce("jahr", F.lit("")), r"\d{4}", 0), F.col("titel")).alias("key"))
    return plans.bibliography_plan(e, "buch_id").select("buch_id", "schluessel")


def cited_books(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    k = books(spark, d).where("titel is not null")
    b = F.struct(
        F.col("titel"), citations.people_of(text.accepted_author(F.col("autor"))).alias("autoren"), F.array().cast("array<struct<given:string,family:string>>").alias("herausgeber"),
        none.alias("verlag"), none.alias("ort"), none.alias("auflage"), F.col("jahr"), none.alias("isbn"), F.nullif("kennung", F.lit("")).alias("doi"),
    )
    k = k.withColumn("b", b)
    c = F.col("b")
    return k.select("buch_id", citations.book(c).alias("ieee"), citations.book(c, "apa").alias("apa"), citations.book(c, "din").alias("din"), citations.bibtex_book(c).alias("bibtex"))


def merged_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of 20 days from each shipping date, merged by supplier."""
    day = F.datediff("l_shipdate", F.lit("1990-01-01").cast("date"))
    s = table(spark, d, "lineitem").select("l_suppkey", day.alias("lo"), (day + 20).alias("hi"))
    return layout.merged_intervals(s, ["l_suppkey"], near=0)


def view_before(spark: SparkSession, d: str) -> DataFrame:
    """The last view of the user before each purchase."""
    e = table(spark, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    buy = e.where("event_type = 'purchase'").select(F.col("user_id").alias("doc"), at.alias("at"))
    view = e.where("event_type = 'view'").select(F.col("user_id").alias("doc"), at.alias("at"), F.col("event_id").alias("page"))
    return pages.marker_before(buy, view)


def throttled_events(spark: SparkSession, d: str) -> DataFrame:
    """A user's events no more than once a day, but each change between errors and others."""
    e = table(spark, d, "events").withColumns({"t": F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, "phase": (F.col("event_type") == "error").cast("string")})
    return log.throttled(e, "user_id", "t", "event_id", 86400.0, "phase").select("event_id")


def events_after(spark: SparkSession, d: str) -> DataFrame:
    return log.events_after(table(spark, d, "events").select("event_id", "event_type"), "event_id", 500)


def nearest_label(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's most similar label centroid, if it leads the next."""
    v = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    e = v.select("label", F.posexplode("vec").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    refs = e.groupBy(F.col("label").cast("string").alias("char")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vec"))
    s = v.select(F.lit(0).alias("doc"), F.lit(0).alias("font"), F.col("vec_id").alias("code"), "vec")
    return layout.glyph_votes(s, refs, least=-1.0, margin=0.001).select(F.col("code").alias("vec_id"), "char", F.round("score", 6).alias("score"))


def band_join(spark: SparkSession, d: str) -> DataFrame:
    """Lines by the band of size that their part falls in."""
    bands = spark.range(10).select(F.col("id").alias("band"), (F.col("id") * 5 + 1).alias("lo"), (F.col("id") * 5 + 5).alias("hi"))
    p = table(spark, d, "part").join(F.broadcast(bands), F.expr("p_size between lo and hi")).select("p_partkey", "band")
    return table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("band").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


def assembled_text(spark: SparkSession, d: str) -> DataFrame:
    return assembly.assembled(book_lines(spark, d), outline_source(spark, d))


def outline_source(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lesezeichen").select(F.col("buch_id").alias("doc"), F.col("seite").alias("page"), "pos", F.col("ebene").alias("level"), F.col("titel").alias("title"))


def columns_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Lines laid out in two columns that the stream alternates between."""
    x = F.when(F.col("pos") % 2 == 0, 60.0).otherwise(300.0)
    y = 700.0 - 12 * F.floor(F.col("pos") / 2).cast("double")
    runs = book_lines(spark, d).select("doc", "page", F.col("pos").alias("run"), x.alias("left"), y.alias("bottom"), (x + 200).alias("right"), (y + 10).alias("top"))
    return layout.column_order(runs).select("doc", "page", "run", "rank", "moved")


def word_scripts(spark: SparkSession, d: str) -> DataFrame:
    """Digits of each outline title set as small characters over the line."""
    t = outline_source(spark, d).select("doc", "page", F.row_number().over(Window.partitionBy("doc", "page").orderBy("pos", "title")).alias("line"), F.posexplode(F.split("title", "")).alias("idx", "text")).where("text <> ''")
    digit = F.col("text").rlike("[0-9]")
    c = t.withColumn("size", F.when(digit, 7.0).otherwise(10.0)).withColumn("baseline", F.when(digit, 4.0).otherwise(0.0))
    return layout.typeset_lines(c)


def text_changes(spark: SparkSession, d: str) -> DataFrame:
    """Line changes between the first and the last document of a book and chapter."""
    t = table(spark, d, "documents").where("buch_id is not null and kapitel is not null")
    key = F.concat_ws("/", "buch_id", "kapitel").alias("doc")
    first = t.groupBy(key).agg(F.min_by("text", "doc_id").alias("text"))
    last = t.groupBy(key).agg(F.max_by("text", "doc_id").alias("text"))
    return repair.aligned_changes(first, last)


def newest_documents(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string")).alias("name"), "eingang")
    return listing.newest_first(t, "name", "eingang").select("doc_id")


def titles_found(spark: SparkSession, d: str) -> DataFrame:
    return listing.named_like(table(spark, d, "kopfbloecke").select("kopf_id", "titel"), "titel", "PRUFUNG")


def outcome_shares(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "protokoll").groupBy("lauf", "status").agg(F.count("*").alias("n"))
    return listing.shares(n, "lauf", "n")


def paced_runs(spark: SparkSession, d: str) -> DataFrame:
    return listing.with_pace(run_summary(spark, d)).select("lauf", "art", "seiten_je_minute")


def log_folders(spark: SparkSession, d: str) -> DataFrame:
    return listing.folder_sizes(table(spark, d, "protokoll").where("nach_pfad <> ''").withColumn("g", F.length("hinweis") + 1), "nach_pfad", "g")


def repeated_titles(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "kopfbloecke").select(F.lower("titel").alias("titel"), listing.trimmed_text(F.coalesce("textquelle", F.lit(""))).alias("textquelle"), F.coalesce("originaldatei", F.lit("")).alias("ort"))
    return listing.repeated_parts(k, ["titel", "textquelle"], "ort").select("titel", "textquelle", F.array_join("ort", "|").alias("orte"), "anzahl")


def trimmed_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(listing.trimmed_text(F.col("text"))).alias("md5"))


def part_versions(spark: SparkSession, d: str) -> DataFrame:
    """Versions made of each part's numbers; every seventh is one before a release."""
    v = F.concat(F.when(F.col("p_partkey") % 2 == 0, "v").otherwise(""), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"), F.when(F.col("p_partkey") % 7 == 0, "-beta").when(F.col("p_partkey") % 3 == 0, ".4").otherwise(""))
    p = table(spark, d, "part").select("p_partkey", listing.version(v).alias("v"))
    return p.select("p_partkey", "v.major", "v.minor", "v.patch")


def axis_steps(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "customer").groupBy("c_nationkey").agg(F.max("c_acctbal").alias("m"))
    return m.select("c_nationkey", listing.axis_step(F.col("m")).alias("schritt"), F.size(listing.axis_ticks(F.col("m"))).alias("marken"))


def links_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Each part links to the one of half its number, those divisible by 1,000 to nothing."""
    p = table(spark, d, "part").where("p_partkey % 1000 <> 0 and p_partkey > 1")
    return listing.resolved(p.select(F.col("p_partkey").alias("path"), F.floor(F.col("p_partkey") / 2).alias("to")))


def printed_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels that a third of the books have right, a third one off, against the margins."""
    lines = book_lines(spark, d)
    numbers = cut(pages.margin_numbers(lines.select("doc", "page").distinct(), pages.number_candidates(lines)))
    label = F.when(F.col("doc") % 3 == 0, F.coalesce("number", F.col("page")).cast("string")).when(F.col("doc") % 3 == 1, (F.col("page") + 2).cast("string")).otherwise(F.concat(F.lit("A-"), F.col("page").cast("string")))
    return pages.page_labels(numbers, numbers.select("doc", "page", label.alias("label")))


def standards_recognised(spark: SparkSession, d: str) -> DataFrame:
    """Headers of a standard put on some pages of some books, numbers into the names of others."""
    lines = book_lines(spark, d)
    header = F.concat(F.lit("DIN EN ISO "), (F.col("doc") + 100).cast("string"), F.lit(":20"), F.lpad((F.col("doc") % 30).cast("string"), 2, "0"), F.lit("-0"), (F.col("doc") % 9 + 1).cast("string"))
    made = lines.select("doc", "page").distinct().where("doc % 3 = 0 and page % (1 + doc % 7) = 1").select("doc", "page", F.lit(-1).alias("pos"), header.alias("line"))
    names = lines.select("doc").distinct().select("doc", F.when(F.col("doc") % 5 == 0, F.concat(F.lit("DIN EN "), F.col("doc").cast("string"), F.lit("_2019-10-00_DE_1.pdf"))).otherwise(F.concat(F.lit("Buch "), F.col("doc").cast("string"), F.lit(".pdf"))).alias("name"))
    got = standards.recognised(names, lines.select("doc", "page", "pos", "line").unionByName(made))
    return got.select("doc", "norm.nummer", "norm.jahr", "norm.monat", "quelle")


def heads_read(spark: SparkSession, d: str) -> DataFrame:
    """Front matter written and read again, every fifth without its end."""
    k = table(spark, d, "kopfbloecke").where("titel is not null")
    end = F.when(F.col("kopf_id") % 5 == 0, "").otherwise("---\n\n")
    t = k.select("kopf_id", F.concat(F.lit("---\ntitel: "), F.col("titel"), F.lit("\nseiten: "), F.coalesce(F.col("seiten").cast("string"), F.lit("null")), F.lit("\ntitel: "), F.col("titel"), F.lit(" 2\n"), end, F.lit("Text")).alias("text"))
    h = readers.front_matter(t)
    return h.select("kopf_id", h.kopf["titel"].alias("titel"), h.kopf["seiten"].alias("seiten"), F.length("rest").alias("rest"))


NAMES = (
    assembled_text, columns_ordered, word_scripts, text_changes,
    running_lines, edge_lines_removed, page_sizes, sentence_breaks, number_sections, printed_numbers, running_titles_removed, page_paragraphs,
    outline_entries, outline_shifted, outline_lines, reading_changes, umlauts_completed, weak_spots, body_sizes, size_headings, emphasised,
    phrase_lines, run_summary, step_durations, undo_candidates, latest_runs, provenance, review_reasons, document_figures, figure_sums,
    quality_points, open_spots, inventory, signature, repeated_text, safe_names, short_authors, accepted_heads, review_routing, joined_words,
    clean_pages, plain_text, rename_candidates, collision_names, bibliography, cited_books, merged_spans, view_before, throttled_events,
    events_after, nearest_label, band_join, newest_documents, titles_found, outcome_shares, paced_runs, log_folders, repeated_titles,
    trimmed_documents, part_versions, axis_steps, links_resolved, printed_labels, standards_recognised, heads_read,
)


def queries() -> dict:
    return {f.__name__: f for f in NAMES}


_QUELLE = """case when trim(coalesce({q}, '')) = '' then 'fehlt' when contains({q}, 'Crossref') then 'Crossref'
when contains({q}, 'Norm') or starts_with(trim({q}), 'Ausgabe ') then 'Norm' when contains({q}, 'im Text') or contains({q}, 'Copyright') then 'Text'
when trim({q}) = 'PDF-Metadaten' then 'PDF-Metadaten' when starts_with(trim({q}), 'manuell') then 'von Hand' else 'Dokument' end"""
_KIND = """case when status in ('OK', 'PRÜFEN', 'FEHLER', 'NACHGEBESSERT') then 'Umwandlung' when status = 'TEXT_ERNEUERT' then 'Text erneuert'
when status = 'UMBENANNT' then 'Umbenannt' when status = 'RÜCKGÄNGIG' then 'Rückgängig' end"""
_NAME = r"coalesce(nullif(neuer_name, ''), nullif(regexp_replace(regexp_extract(md_pfad, '([^/\\]*)$', 1), '(.)\.[^.]*$', '\1'), ''), original_name)"
_T = "try_strptime({0}, '%Y-%m-%d %H:%M:%S')"
_CONV = "status in ('OK', 'PRÜFEN', 'FEHLER', 'TEXT_ERNEUERT')"
_FIGURES = r"""figures as (select doc_id, len(regexp_extract_all(t, '<!-- Seite \S+ \(PDF \d+\) -->')) as gedruckt,
len(regexp_extract_all(t, '<!-- PDF-Seite \d+ -->')) as nur_pdf, length(t) - length(replace(t, '�', '')) as fragezeichen,
((length(t) - length(replace(t, '⚠[Formel unsicher]', ''))) / 18)::int as unsicher,
len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '\$[^$\n]+\$'))) as formelzeilen,
len(list_distinct(regexp_extract_all(t, '(?m)^[ \t]*(?:#+[ \t]*)?(?:Tabelle|Tab\.|Table)[ \t]*([A-Z]?\d+(?:[.\-–]\d+)*)', 1))) as tabellentitel
from (select doc_id, coalesce(text, '') as t from documents))"""


def oracle_sql() -> dict[str, str]:
    strip = oracles.strip
    runs = f"""with {_BOOKS}, size as (select originaldatei as name, max(seiten) as seiten from books where originaldatei is not null group by 1),
l as (select p.*, coalesce(a.seiten, b.seiten) as s, {_KIND} as art from protokoll p left join size a on a.name = {_NAME} left join size b on b.name = p.original_name),
g as (select lauf, art, count(*) filter (art not in ('Umwandlung', 'Text erneuert') or {_CONV}) as dateien, count(*) filter (status in ('OK', 'TEXT_ERNEUERT')) as ok,
count(*) filter (status = 'PRÜFEN') as pruefen, count(*) filter (status = 'FEHLER') as fehler, count(*) filter (status = 'NACHGEBESSERT') as nachgebessert,
max({_T.format("zeit")}) filter ({_CONV}) as ende, sum(coalesce(s, 0)) filter ({_CONV}) as s from l where art is not null group by all),
h as (select *, epoch(ende)::bigint - epoch({_T.format("lauf")})::bigint as d from g), i as (select *, case when d between 0 and 21600 then d::int end as sekunden, nullif(s, 0)::bigint as seiten from h)
select lauf, art, dateien, ok, pruefen, fehler, nachgebessert, sekunden, seiten, case when sekunden > 0 then round_even(seiten * 60 / sekunden, 1) end as seiten_je_minute from i"""
    return {
        "page_sizes": f"with {_LINES} select doc, page, count(*) as n_lines, sum(length(line))::bigint as n_chars from lines where line is not null group by all",
        "running_lines": rf"""with {_LINES}, filled as (select * from lines where line is not null and {strip("line")} <> ''),
ends as (select doc, page, arg_min(line, pos) as a, arg_max(line, pos) as b from filled group by all),
keys as (select distinct doc, page, unnest([regexp_replace({strip("a")}, '[0-9]+', '#', 'g'), regexp_replace({strip("b")}, '[0-9]+', '#', 'g')]) as key from ends),
need as (select doc, least(8, greatest(3, ceil(count(*) * 0.6))) as need from ends group by doc)
select doc, key from (select doc, key, count(*) as n from keys group by all) join need using (doc) where n >= need and length(key) between 5 and 300
and not regexp_matches(key, '(?i)^(?:aufgabe|beispiel|übung|abb|abbildung|tab|tabelle|lösung|figure|example|exercise|problem|gleichung)(?:[^\p{{L}}\p{{N}}_]|$)')
and not regexp_matches(key, '(?:[ \t]*\.){{4,}}|…')""",
        "sentence_breaks": rf"""with {_LINES}, n as (select *, lead(line) over (partition by doc, page order by pos) as nxt from lines where line is not null)
select doc, sum(case when length(line) >= 25 and regexp_matches(line, '[.!?]$') and length(nxt) >= 3 and regexp_matches(nxt, '^\p{{Ll}}') then 1 else 0 end)::bigint as breaks from n group by doc""",
        "outline_entries": r"""select buch_id as doc, seite as page, ebene as level, title, min(pos) as pos from (select *, left(trim(regexp_replace(titel, '\s+', ' ', 'g')), 200) as title from lesezeichen)
where length(title) >= 2 group by all""",
        "reading_changes": """with z as (select buch_id as doc, seite, pos, text as line, gelesen_am, zeile_id from zeilen where text is not null),
a as (select doc, seite, pos, arg_min(line, (gelesen_am, zeile_id)) as line from z group by all), b as (select doc, seite, pos, arg_max(line, (gelesen_am, zeile_id)) as line from z group by all)
select doc, line, 'weg' as art from a where (doc, line) not in (select doc, line from b) union all select doc, line, 'neu' from b where (doc, line) not in (select doc, line from a)""",
        "body_sizes": f"""with {oracles.STYLED}, s as (select doc, round(size * 2) / 2 as b, sum(length(text)) as n from styled where size is not null group by all)
select doc, arg_max(b, (n, b)) as body from s group by doc""",
        "run_summary": runs,
        "paced_runs": f"select lauf, art, seiten_je_minute from ({runs}) where seiten_je_minute is not null",
        "step_durations": f"""with {_BOOKS}, size as (select originaldatei as name, max(seiten) as seiten from books where originaldatei is not null group by 1),
t as (select *, {_KIND} as art, {_T.format("zeit")} as t, {_NAME} as name from protokoll where {_KIND} is not null),
w as (select *, epoch(t)::bigint - epoch(coalesce(last_value(t ignore nulls) over (partition by lauf, art order by zeit, eintrag_nr rows between unbounded preceding and 1 preceding), {_T.format("lauf")}))::bigint as d from t)
select eintrag_nr, w.name, lauf, art, status, case when d between 0 and 21600 then d::int end as sekunden, coalesce(a.seiten, b.seiten) as seiten from w
left join size a on a.name = w.name left join size b on b.name = w.original_name where {_CONV}""",
        "undo_candidates": """with s as (select * from protokoll where status in ('OK', 'PRÜFEN', 'NACHGEBESSERT', 'UMBENANNT') and von_pfad <> '' and nach_pfad <> '' and lauf <> ''),
k as (select lauf, row_number() over (order by max(eintrag_nr) desc) as k from s group by lauf qualify k <= 3), o as (select * from s where lauf not in (select lauf from k))
select eintrag_nr, lauf, status, nach_pfad as von, von_pfad as nach from o where lauf = (select arg_max(lauf, eintrag_nr) from o) order by eintrag_nr desc""",
        "latest_runs": f"select lauf, {_KIND} as art, count(*) as zeilen from protokoll where {_KIND} is not null group by all order by lauf desc, art limit 24",
        "provenance": f"with {_BOOKS}, x as (" + " union all ".join(f"select '{f}' as feld, case when coalesce({f}, '') = '' then 'fehlt' else {_QUELLE.format(q=f + '_quelle')} end as kategorie from books" for f in ("titel", "autor", "jahr")) + ") select feld, kategorie, count(*) as anzahl from x group by all",
        "review_reasons": f"""with {_BOOKS}, x as (select buch_id, unnest(string_split(pruefen, ';')) as g, generate_subscripts(string_split(pruefen, ';'), 1) as p from books where pruefen is not null)
select trim(g) as grund, count(*) as anzahl from x where trim(g) <> '' group by 1 order by anzahl desc, min((buch_id, p)) limit 6""",
        "document_figures": f"with {_FIGURES} select * from figures",
        "figure_sums": f"""with {_FIGURES} select sum(unsicher)::bigint as unsicher, sum(fragezeichen)::bigint as fragezeichen, sum(gedruckt)::bigint as gedruckt, sum(nur_pdf)::bigint as nur_pdf,
count(*) as buecher, count(*) filter (gedruckt + nur_pdf > 0) as gedruckt_erfasst, round(sum(gedruckt) / nullif(sum(gedruckt + nur_pdf), 0), 9) as gedruckt_anteil from figures""",
        "open_spots": f"""with {_FIGURES}, x as (select printf('d%09d', doc_id) as name, gedruckt + nur_pdf as seiten, fragezeichen, unsicher, formelzeilen as nur_pdf from figures)
select name, seiten, fragezeichen, unsicher, nur_pdf, fragezeichen + unsicher + nur_pdf as offen, round_even((fragezeichen + unsicher + nur_pdf) * 100 / greatest(seiten, 1), 1) as je_100
from x where fragezeichen + unsicher + nur_pdf > 0 order by je_100 desc, offen desc, name limit 10""",
        "inventory": r"""select bereich, coalesce(nullif(upper(regexp_extract(name, '\.([^.]*)$', 1)), ''), '?') as format, count(*) as anzahl from (
select ordner as bereich, neuer_name as name from protokoll where ordner in ('Fertig', 'Prüfen') union all select 'Eingang', original_name from protokoll) group by all""",
        "signature": f"""with {_BOOKS} select left(sha1(string_agg(x, chr(10) order by x)), 16) as signatur from (select concat_ws('|', originaldatei, seiten::varchar, buch_id::varchar) as x from books where originaldatei is not null)""",
        "repeated_text": r"""with l as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '[\r\n]'), lambda x: trim(x, chr(32) || chr(9) || chr(160))), lambda x: length(x) >= 8) as l from documents)
select doc_id, coalesce(len(l) >= 6 and len(l) - len(list_distinct(l)) >= 3 and len(l) - len(list_distinct(l)) >= 0.1 * len(l), false) as doppelt from l""",
        "short_authors": r"""with p as (select kopf_id, autor, list_filter(list_transform(regexp_split_to_array(autor, ';|,| und | and | & '), lambda x: trim(x)), lambda x: x <> '') as p from kopfbloecke where autor is not null)
select kopf_id, case when len(p) >= 3 then p[1] || ' et al.' else autor end as kurz, case when regexp_matches(autor, '^\s*([^,]+?),\s*([^,\d]+?)(?:,\s*[\d?\-–. ]+)?\s*$')
then regexp_replace(autor, '^\s*([^,]+?),\s*([^,\d]+?)(?:,\s*[\d?\-–. ]+)?\s*$', '\2 \1') else trim(autor) end as person from p""",
        "safe_names": r"""with n as (select kopf_id, trim(regexp_replace(regexp_replace(regexp_replace(titel, '\s*:\s+', ' – ', 'g'), '[<>:"/\\|?*\x00-\x1f]', ' ', 'g'), '\s+', ' ', 'g'), ' .') as name from kopfbloecke where titel is not null)
select kopf_id, name, regexp_matches(name, '[\p{L}\p{N}]') as brauchbar from n""",
        "plain_text": r"select doc_id, length(regexp_replace(text, ' ?<!-- (?:Seite \S+ \(PDF \d+\)|PDF-Seite \d+|Seite \d+) -->\n?', '', 'g')) as n from documents",
        "collision_names": """select kopf_id, case when n = 1 then titel else titel || ' (' || n || ')' end as frei from (
select kopf_id, titel, row_number() over (partition by lower(titel) order by kopf_id) as n from kopfbloecke where titel is not null)""",
        "merged_spans": """with s as (select l_suppkey, datediff('day', date '1990-01-01', l_shipdate::date) as lo, datediff('day', date '1990-01-01', l_shipdate::date) + 20 as hi from lineitem),
w as (select *, max(hi) over (partition by l_suppkey order by lo, hi rows between unbounded preceding and 1 preceding) as reach from s),
g as (select *, sum(case when reach is null or lo > reach then 1 else 0 end) over (partition by l_suppkey order by lo, hi rows unbounded preceding) as k from w)
select l_suppkey, min(lo) as lo, max(hi) as hi, count(*) as teile from g group by l_suppkey, k""",
        "view_before": """with v as (select user_id, epoch_us(ts) as at, max(event_id) as page from events where event_type = 'view' group by all)
select b.user_id as doc, epoch_us(b.ts) as at, v.page from events b asof left join v on v.user_id = b.user_id and v.at <= epoch_us(b.ts) where b.event_type = 'purchase'""",
        "throttled_events": """with recursive e as (select event_id, user_id, epoch_us(ts) / 1e6 as t, event_type = 'error' as p, row_number() over (partition by user_id order by ts, event_id) as k from events),
s as (select user_id, k, event_id, p, t as sent, true as send from e where k = 1 union all
select e.user_id, e.k, e.event_id, e.p, case when e.p <> s.p or e.t - s.sent >= 86400 then e.t else s.sent end, e.p <> s.p or e.t - s.sent >= 86400 from s join e on e.user_id = s.user_id and e.k = s.k + 1)
select event_id from s where send""",
        "events_after": "select event_id, event_type from events where event_id > 500",
        "band_join": """select (p_size - 1) // 5 as band, count(*) as n, round(sum(l_quantity), 2) as qty from lineitem join part on l_partkey = p_partkey where p_size between 1 and 50 group by 1""",
        "phrase_lines": rf"""with {_LINES}, p as (select hervorhebung_id as id, buch_id as doc, seite as page, regexp_replace(text, '[\s\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g') as k from hervorhebungen),
l as (select doc, page, pos, regexp_replace(line, '[\s\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g') as t from lines where line is not null),
h as (select id, count(*) as c, min(pos) as pos from p join l using (doc, page) where contains(t, k) group by id)
select p.id, case when c = 1 then h.pos end as pos from p left join h using (id)""",
        "nearest_label": """with e as (select vec_id, label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings), c as (select label, i, avg(x) as m from e group by all),
d as (select vec_id, c.label::varchar as char, sum(x * m) as s from e join c using (i) group by all), r as (select *, row_number() over w as k, lead(s) over w as nxt from d window w as (partition by vec_id order by s desc, char))
select vec_id, char, round(s, 6) as score from r where k = 1 and s >= -1 and s - coalesce(nxt, 0) >= 0.001""",
        "quality_points": f"""with {_FIGURES}, q as (select sum(unsicher)::bigint as u, sum(formelzeilen)::bigint as f, sum(gedruckt)::bigint as g, sum(gedruckt + nur_pdf)::bigint as p, count(*) as n,
count(*) filter (doc_id % 2 = 0) as e from figures) select unnest(['Formelzeichen repariert', 'Verbliebene �', 'Formeln unsicher markiert', 'Tabellen als Markdown', 'Überschriften direkt im Text',
'Spaltenseiten umsortiert', 'Seiten mit gedruckter Zahl', 'Bücher mit aktuellem Verfahren']) as titel, unnest([0, 0, u, 0, 0, 0, g, e]) as wert, unnest([0, 0, f, 0, 0, 0, p, n]) as max,
unnest([0, 0, n, 0, 0, 0, n, n]) as buecher, n as alle from q""",
        "review_routing": rf"""with {_BOOKS}, b as (select buch_id, jahr, trim(titel) as t, originaldatei, concat_ws('; ', case when trim(coalesce(titel, '')) = '' then 'titel fehlt' end,
case when trim(coalesce(autor, '')) = '' then 'autor fehlt' end, case when trim(coalesce(jahr, '')) = '' then 'jahr fehlt' end) as f from books),
p as (select buch_id, case when f <> '' then f when not regexp_matches(jahr, '^(?:1[5-9]|20)\d{{2}}$') then 'Jahr unplausibel'
when regexp_matches(t, '^(?:(?i:isbn)[\s:]*)?[\d\-\sxX]{{10,}}$|^10\.\d{{4,9}}/\S+$') then 'Titel ist eine Kennung' when coalesce(originaldatei, '') = '' then 'Original fehlt' end as pruefen from b)
select buch_id, pruefen, case when pruefen is null then 'Fertig' else 'Prüfen' end as target from p""",
        "umlauts_completed": """with w as (select source as doc, doc_id, unnest(regexp_extract_all(text, '([A-Za-zäöüÄÖÜß]+)', 1)) as w from documents where source is not null),
c as (select doc, case when doc_id % 3 = 0 and length(w) - length(replace(w, 'ü', '')) = 1 then replace(w, 'ü', '�') else w end as word, count(*) as n from w group by all),
t as (select doc, word, replace(word, '�', u) as better from c, unnest(['ä', 'ö', 'ü', 'Ä', 'Ö', 'Ü', 'ß']) as x(u) where length(word) >= 3 and length(word) - length(replace(word, '�', '')) = 1),
f as (select t.doc, t.word, better, n, row_number() over win as k, coalesce(lead(n) over win, 0) as rival from t join c on c.doc = t.doc and c.word = better window win as (partition by t.doc, t.word order by n desc, better))
select doc, word, better from f where k = 1 and n >= 2 and 3 * rival <= n""",
    } | oracles.oracles()
