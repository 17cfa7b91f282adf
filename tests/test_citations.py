from pyspark.sql import functions as F

from blattwerk.functions import citations as C
from blattwerk.functions import standards as S

PEOPLE = "array<struct<given:string,family:string>>"
BOOK = f"struct<titel:string,autoren:{PEOPLE},herausgeber:{PEOPLE},verlag:string,ort:string,auflage:string,jahr:string,isbn:string,doi:string,typ:string>"


def book(spark, authors, editors=(), **kw):
    d = {"titel": "Titel", "verlag": "Verlag", "ort": "Ort", "auflage": "3., neue", "jahr": "2016", "isbn": None, "doi": "10.1/x", "typ": None} | kw
    row = (d["titel"], list(authors), list(editors), d["verlag"], d["ort"], d["auflage"], d["jahr"], d["isbn"], d["doi"], d["typ"])
    return spark.createDataFrame([(row,)], f"b {BOOK}")


def one(df, c):
    return df.select(c.alias("x")).first().x


def test_books(spark):
    b, c = book(spark, [("Hans Dieter", "Muster"), ("Sam", "Beispiel")]), F.col("b")
    assert one(b, C.book(c)) == "H. D. Muster und S. Beispiel, *Titel*, 3. Aufl. Ort: Verlag, 2016, doi: 10.1/x."
    assert one(b, C.book(c, "apa")) == "Muster, H. D., & Beispiel, S. (2016). *Titel* (3. Aufl.). Verlag. https://doi.org/10.1/x"
    assert one(b, C.book(c, "din")) == "MUSTER, Hans Dieter und Sam BEISPIEL, 2016. *Titel*. 3. Aufl. Ort: Verlag. DOI: 10.1/x"
    assert one(b, C.bibtex_book(c)).startswith("@book{muster2016titel, author = {Muster, Hans Dieter and Beispiel, Sam}, title = {{Titel}}, edition = {3}")
    none = book(spark, [], auflage="1", doi=None, verlag=None, ort=None, jahr=None)
    assert one(none, C.book(c)) == "*Titel*." and one(none, C.book(c, "din")) == "*Titel*, o. J.."
    many = book(spark, [("A", f"N{i}") for i in range(7)])
    assert one(many, C.book(c)).startswith("A. N0 et al., ")
    assert one(book(spark, [], [("E", "H")]), C.is_collection(c)) is True


def test_parts(spark):
    names = spark.createDataFrame([("Hans-Jürgen",), ("Yuri A.W.",), ("",), (None,)], "x string")
    assert [r.y for r in names.select(C.initials(F.col("x")).alias("y")).collect()] == ["H.-J.", "Y. A. W.", "", ""]
    place = spark.createDataFrame([("Berlin ; Heidelberg",), ("Wiesbaden, Germany",), (None,)], "x string")
    assert [r.y for r in place.select(C.first_place(F.col("x")).alias("y")).collect()] == ["Berlin", "Wiesbaden", None]
    n = spark.createDataFrame([(("DIN EN ISO 12345", "2023-07", "Titel", "2023", True, None),)], "n struct<bezeichnung:string,ausgabe:string,titel:string,jahr:string,entwurf:boolean,herausgeber:string>")
    assert one(n, C.standard(F.col("n"))) == "*Titel*, DIN EN ISO 12345:2023-07 (Entwurf), 2023."
    assert one(n, C.standard(F.col("n"), "apa")) == "DIN. (2023). *Titel* (DIN EN ISO 12345:2023-07, Entwurf)."
    assert one(n, C.bibtex_standard(F.col("n"))).startswith("@standard{din12345_2023, ")


def test_standards(spark):
    rows = [("d", p, 0, "E DIN EN ISO 12345:2023-07") for p in range(3)] + [("d", p, 1, "Text") for p in range(3)]
    # a book of twenty pages that quotes a standard at two page edges is none
    rows += [("b", p, 0, "DIN EN 999:2001-02" if p in (9, 12) else "Kapitel") for p in range(20)]
    rows += [("g", 1, 0, "Ausgabe"), ("g", 1, 1, "im August 2013 erschienen"), ("h", 0, 0, "Text")]
    lines = spark.createDataFrame(rows, "doc string, page int, pos int, line string")
    names = {"d": "x.pdf", "e": "DIN EN 4567-1_2019-10-00_DE_123.pdf", "f": "Buch.pdf", "b": "Buch2.pdf", "g": "y.pdf", "h": "z.pdf", "i": "DIN_EN_ISO_12345_Berichtigung_1__2013-08.pdf"}
    docs = spark.createDataFrame(list(names.items()), "doc string, name string")
    toc = spark.createDataFrame([("g", 0, 0, "DIN EN ISO 12345 Berichtigung 1"), ("h", 2, 0, "DIN EN 77:2020-03"), ("h", 3, 0, "x")], "doc string, page int, pos int, title string")
    got = {r.doc: (r.norm.nummer, r.norm.jahr, r.norm.monat, r.quelle) for r in S.recognised(docs, lines, toc).collect()}
    assert got == {
        "d": ("DIN EN ISO 12345", "2023", "07", "Kopfzeile der Norm"), "e": ("DIN EN 4567-1", "2019", "10", "Dateiname (Normen-Download)"),
        "g": ("DIN EN ISO 12345 Berichtigung 1", "2013", "08", "Lesezeichen und Datum auf dem Deckblatt"), "h": ("DIN EN 77", "2020", "03", "Lesezeichen der Norm"),
        "i": ("DIN EN ISO 12345 Berichtigung 1", "2013", "08", "Dateiname"),
    }
    assert S.recognised(docs, lines.limit(0)).count() == 2
