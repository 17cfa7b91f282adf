import json

from pyspark.sql import functions as F

from blattwerk.config import settings
from blattwerk.operators import layout as L
from blattwerk.operators import repair as R
from blattwerk.operators.pages import whole_documents
from blattwerk.plans import assembly as A

CHARS = "doc string, page int, idx int, text string, left double, right double, bottom double, top double, size double"


def test_accents(spark):
    rows = [("d", 0, 0, "u", 0.0, 5.0, 0.0, 7.0, 10.0), ("d", 0, 1, "̈", 1.0, 4.0, 7.0, 9.0, 10.0), ("d", 0, 2, "´", 6.0, 9.0, 7.0, 9.0, 10.0), ("d", 0, 3, "e", 5.0, 10.0, 0.0, 7.0, 10.0), ("d", 0, 4, "^", 30.0, 33.0, 0.0, 7.0, 10.0)]
    got = R.with_accents(spark.createDataFrame(rows, CHARS)).orderBy("idx").collect()
    assert [r.text for r in got] == ["ü", "é", "^"]


def test_fonts(spark):
    c = spark.createDataFrame([("d", "F", "Š"), ("d", "Symbol", "a"), ("d", "G", "\uf041"), ("d", "G", "x")], "doc string, font string, text string")
    assert [r.text for r in R.recoded(c, spark.createDataFrame([("d", "F")], "doc string, font string")).orderBy("font", "text").collect()] == ["ä", "A", "x", "α"]
    p = spark.createDataFrame([("d", 1, "CMMI10"), ("d", 2, "Times")], "doc string, page int, font string")
    assert [r.page for r in R.math_pages(p).collect()] == [1]
    t = spark.createDataFrame([(f"a{R.OPEN}f/1{R.CLOSE}b{R.OPEN}f/2{R.CLOSE}", {"f/1": "α"})], "t string, m map<string,string>")
    assert t.select(R.resolved(F.col("t"), F.col("m")).alias("x")).first().x == "aαb�"


def cells(spark):
    s = [("d", 0, "h", float(y), 0.0, 100.0) for y in (0, 20, 40)] + [("d", 0, "v", x, 0.0, h) for x, h in ((0.0, 40.0), (100.0, 40.0), (50.0, 40.0))]
    st = spark.createDataFrame(s, "doc string, page int, orient string, at double, lo double, hi double")
    return st, L.grid_cells(L.grids(st))


def test_tables(spark):
    st, grid = cells(spark)
    whole = R.merged_cells(grid, st)
    assert whole.select("cell").distinct().count() == 4
    half = st.where("not (orient = 'v' and at = 50)").unionByName(spark.createDataFrame([("d", 0, "v", 50.0, 0.0, 20.0)], st.schema))
    assert R.merged_cells(grid, half).select("cell").distinct().count() == 3
    chars = spark.createDataFrame([("d", 0, i, t, x, x + 4, y, y + 8, 8.0) for i, (t, x, y) in enumerate([("A", 10.0, 25.0), ("B", 60.0, 25.0), ("c", 10.0, 5.0), ("|", 60.0, 5.0), ("z", 200.0, 5.0)])], CHARS)
    fix = R.tables_into_text(chars, grid)
    assert L.replaced(chars, fix).first().text == "| A | B |\n| --- | --- |\n| c | \\| |z"
    out = st.withColumn("table", F.lit(0)).where("not (orient = 'v' and at = 0)")
    assert R.open_sides(out).count() == 1
    rules = spark.createDataFrame([("d", 0, "h", float(y), 0.0, 200.0) for y in (0, 30, 60)], st.schema)
    none = L.grids(rules)
    assert R.rule_tables(rules, none, 400.0).first().lines == [0.0, 30.0, 60.0]
    assert R.rule_tables(rules.unionByName(spark.createDataFrame([("d", 0, "v", 50.0, -5.0, 65.0)], st.schema)), none, 400.0).count() == 0


def test_formulas(spark):
    bar = spark.createDataFrame([("d", 0, 0, 20.0, 10.0, 30.0)], "doc string, page int, bar int, at double, lo double, hi double")
    c = spark.createDataFrame([("d", 0, 0, "√", 5.0, 10.0, 10.0, 20.0, 10.0), ("d", 0, 1, "x", 12.0, 16.0, 10.0, 18.0, 10.0), ("d", 0, 2, "y", 50.0, 54.0, 10.0, 18.0, 10.0)], CHARS)
    assert R.roots(bar, c).first().latex == "\\sqrt{x}"
    s = spark.createDataFrame([("d", 0, 0, "∑", 0.0, 10.0, 10.0, 22.0, 12.0), ("d", 0, 1, "n", 3.0, 6.0, 23.0, 28.0, 7.0), ("d", 0, 2, "i", 3.0, 6.0, 3.0, 9.0, 7.0), ("d", 0, 3, "x", 12.0, 16.0, 10.0, 18.0, 12.0)], CHARS)
    assert R.limits(s).first().latex == "\\sum_{i}^{n}"


def test_assembly(spark):
    texts = [f"Wellen und Lager\nSatz {'abcdefgh'[n]} der Seite über die Welle ist hier.\n{n + 11}" for n in range(6)]
    rows = [("d", p, i, z) for p, t in enumerate(texts) for i, z in enumerate(t.split("\n"))]
    lines = spark.createDataFrame(rows, "doc string, page int, pos int, line string")
    toc = spark.createDataFrame([("d", 2, 0, 1, "Neues Kapitel")], "doc string, page int, pos int, level int, title string")
    text = whole_documents(A.assembled(lines, toc)).first().text
    assert text.count("<!-- Seite ") == 6 and "<!-- Seite 13 (PDF 3) -->\n# Neues Kapitel" in text and "Wellen und Lager" not in text
    plain = whole_documents(A.assembled(lines, None, None, settings({"text.seitenmarker": False, "text.gedruckte_seitenzahlen": False}))).first().text
    assert "<!--" not in plain and plain.count("Satz") == 6


def test_records_and_chapters(spark):
    raw = json.dumps({"title": ["Buch <i>A</i>"], "author": [{"given": "Erika", "family": "Muster"}], "publisher-location": "Berlin ; Bonn", "issued": {"date-parts": [[2016, 3]]}, "DOI": "10.1/x"})
    table = spark.createDataFrame([("10.1/x", raw), ("10.1/y", "kaputt")], "kennung string, roh string").select("kennung", A.crossref_record(F.col("roh")).alias("satz"))
    docs = spark.createDataFrame([("a", ["10.9/z", "10.1/x"]), ("b", ["10.1/y"]), ("c", [])], "doc string, kennungen array<string>")
    got = {r.doc: r.satz for r in A.looked_up(docs, table).collect()}
    assert (got["a"].titel, got["a"].jahr, got["a"].ort, got["a"].autoren[0].family) == ("Buch A", "2016", "Berlin", "Muster") and got["b"] is None and got["c"] is None
    t = spark.createDataFrame([("d", "<!-- Seite 3 (PDF 4) -->\nText doi 10.1007/abc_5 hier\nEnde")], "doc string, text string")
    assert [(r.doi, r.page) for r in A.chapter_places(t).collect()] == [("10.1007/abc_5", 4)]
    z = spark.createDataFrame([("d", "10.1007/abc_5", "Zitat")], "doc string, doi string, zitat string")
    assert A.with_chapter_citations(t, z).first().text.split("\n") == ["<!-- Seite 3 (PDF 4) -->", "Text doi 10.1007/abc_5 hier", "> Zitat", "Ende"]


def test_review_and_copies(spark, tmp_path):
    r = spark.createDataFrame([("T", "A", "2019", "q", "q", "q", "T", None, "2019"), ("T", None, "2019", "q", "q", "q", "T", None, "2019")], "titel string, autor string, jahr string, titel_quelle string, autor_quelle string, jahr_quelle string, titel_alt string, autor_alt string, jahr_alt string")
    done = A.promoted(r).collect()
    assert len(done) == 1 and (done[0].autor_quelle, done[0].titel_quelle, done[0].status) == ("manuell", "q", "NACHGEBESSERT")
    n = spark.createDataFrame([("Alt", "X", "1999", "q", "q", "q", ("DIN EN 1", "Stahl", "2020")), ("Buch", "Y", "2000", "q", "q", "q", None)], "titel string, autor string, jahr string, titel_quelle string, autor_quelle string, jahr_quelle string, norm struct<nummer:string,titel:string,jahr:string>")
    assert [(x.titel, x.autor, x.jahr, x.titel_quelle) for x in A.with_standard(n).collect()] == [("DIN EN 1: Stahl", "DIN", "2020", "Norm"), ("Buch", "Y", "2000", "q")]
    (tmp_path / "in").mkdir()
    for f in ("a.pdf", "b.txt", "in/a.pdf"):
        (tmp_path / f).write_text(f)
    got = A.copied([str(tmp_path / f) for f in ("a.pdf", "b.txt", "in/a.pdf", "c.pdf")], str(tmp_path / "in"))
    assert got == {"kopiert": ["a (2).pdf"], "fehlt": ["c.pdf"], "format": ["b.txt"], "da": ["a.pdf"]}
    d = R.aligned_changes(spark.createDataFrame([("d", "a\nb")], "doc string, text string"), spark.createDataFrame([("d", "a\nc"), ("e", None)], "doc string, text string"))
    assert sorted((x.doc, x.art, x.zeile) for x in d.collect()) == [("d", "neu", "c"), ("d", "weg", "b")]
    assert A.procedure(settings({"text.formelsatz": False})).startswith("Zeilen + Formelreparatur + Lesezeichen")
    s = spark.createDataFrame([("Dies ist ein Satz mit mehr als acht Wörtern und genug Buchstaben.",), ("kurz",)], "s string")
    assert [x.y for x in s.select(A.usable_sentence(F.col("s")).alias("y")).collect()] == [True, False]
