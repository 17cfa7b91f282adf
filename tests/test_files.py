import io
import zipfile

from pyspark.sql import functions as F

from blattwerk import config
from blattwerk.plans import plans
from blattwerk.sources import readers, sinks
from blattwerk.streaming import ingest


def zipped(**files):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return raw.getvalue()


CORE = '<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Mein Bericht</dc:title><dc:creator>Erika Muster</dc:creator></c>'
BOX = '<c><rootfiles><rootfile full-path="o.opf"/></rootfiles></c>'
OPF = '<p xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>Buch</dc:title><dc:creator>A</dc:creator><dc:creator>B</dc:creator><dc:date>2017-03</dc:date><dc:identifier>978-3-16-148410-0</dc:identifier></p>'


def test_metadata(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(zipped(docProps__core_dot_xml=CORE))
    (tmp_path / "b.epub").write_bytes(zipped(**{"META-INF__container_dot_xml": BOX, "o_dot_opf": OPF}))
    (tmp_path / "c.html").write_bytes('<title>Seite</title><meta name="citation_title" content="Größe"><meta name="dc.creator" content="Mann, Thomas, 1875-1955">'.encode("cp1252"))
    (tmp_path / "d.docx").write_bytes(b"kaputt")
    (tmp_path / "~$e.docx").write_bytes(b"x")
    assert {r.name: r.supported for r in readers.listing(spark, str(tmp_path)).collect()} == {"a.docx": True, "b.epub": True, "c.html": True, "d.docx": True, "~$e.docx": False}
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r.name: r for r in readers.metadata(files).collect()}
    assert (got["a.docx"].titel, got["a.docx"].autor) == ("Mein Bericht", "Erika Muster")
    assert (got["b.epub"].titel, got["b.epub"].autor, got["b.epub"].jahr, got["b.epub"].kennungen) == ("Buch", "A, B", "2017", ["978-3-16-148410-0"])
    assert (got["c.html"].titel, got["c.html"].autor) == ("Größe", "Thomas Mann")
    assert got["d.docx"].titel is None and got["d.docx"].fehler


def test_front_matter_round_trip(spark):
    head = spark.createDataFrame([({"titel": 'Ein "Buch"', "jahr": "2019"}, "Text\n")], "h map<string,string>, b string")
    doc = head.select(sinks.with_front_matter(F.col("h"), ["titel", "autor", "jahr"], F.col("b")).alias("text"))
    got = readers.front_matter(doc).first()
    assert got.kopf == {"titel": 'Ein "Buch"', "jahr": "2019"} and got.rest == "Text\n"
    loose = spark.createDataFrame([("---\ntitel: Mein Buch\njahr: 2019\n---\n\nx",), ("ohne",), (None,)], "text string")
    rows = readers.front_matter(loose).collect()
    assert rows[0].kopf == {"titel": "Mein Buch", "jahr": "2019"} and rows[0].rest == "x" and rows[1].kopf is None and rows[1].rest == "ohne"


def test_log_and_bibliography(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-09 12:00:00", "OK", None), ("x", "FEHLER", "a;b")], "lauf string, status string, hinweis string")
    sinks.append_log(rows, str(tmp_path / "log"))
    got = readers.read_log(spark, str(tmp_path / "log")).orderBy("status").collect()
    assert [(r.status, r.hinweis, r.titel) for r in got] == [("FEHLER", "a;b", ""), ("OK", "", "")]
    sinks.write_bibliography(spark.createDataFrame([("@b",), ("@a",)], "eintrag string"), str(tmp_path / "bib"))
    assert [r.value for r in spark.read.text(str(tmp_path / "bib")).collect()] == ["% 2 Einträge", "@a", "@b"]


def test_plans(spark):
    t = spark.createDataFrame([("Ein Titel: Untertitel", "A B", "2019"), ("Wort " * 40, "A B", "2019"), ("Kurz: " + "lang " * 40, "A, B, C", "2019")], "t string, a string, j string")
    names = [r.x for r in t.select(plans.target_name(F.col("t"), F.col("a"), F.col("j")).alias("x")).collect()]
    assert names[0] == "Ein Titel – Untertitel - A B - 2019" and len(names[1]) <= 120 and names[1].endswith("… - A B - 2019") and names[2] == "Kurz - A et al. - 2019"
    w = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "o int, stem string")
    have = spark.createDataFrame([("a (4)",)], "stem string")
    assert [r.frei for r in plans.free_names(w, have, "o").orderBy("o").collect()] == ["a (5)", "A (6)", "b"]
    e = spark.createDataFrame([(1, "k"), (2, "k"), (3, "kb")], "o int, key string")
    got = [r.schluessel for r in plans.bibliography_plan(e, "o").orderBy("o").collect()]
    assert len(set(got)) == 3 and got[0] == "k"
    md = spark.createDataFrame([("x",), ("y",)], "stem string")
    f = spark.createDataFrame([("X.docx",), ("x.pdf",), ("y.txt",)], "name string")
    assert {r.stem: r.original for r in plans.with_original(md, f).collect()} == {"x": "x.pdf", "y": None}
    new, gone = plans.changed_files(spark.createDataFrame([("a", 1), ("b", 2)], "name string, groesse int"), spark.createDataFrame([("a", 1), ("c", 3)], "name string, groesse int"), ["name", "groesse"])
    assert [r.name for r in new.collect()] == ["b"] and [r.name for r in gone.collect()] == ["c"]


def test_inbox_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text("<title>Titel</title>")
    (tmp_path / "in" / "b.txt").write_text("nein")
    q = ingest.process_inbox(ingest.inbox(spark, str(tmp_path / "in")), readers.metadata, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [r.titel for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["Titel"]


def test_settings(tmp_path):
    s = config.settings({"text.max_name_len": 999, "order.breit": "0.7000000001", "order.lang": "0,4", "unbekannt": 1, "text.bibtex": "nein", "text.bibtex2": "", "text.formelsatz": " Ein ", "text.zitierstil": "x"})
    assert s["text.max_name_len"] == 200 and s["order.breit"] == 0.7 and s["order.lang"] == 0.3 and s["text.formelsatz"] is True and s["text.bibtex"] is False and s["text.zitierstil"] == "ieee"
    config.save(str(tmp_path / "s.json"), s)
    assert config.deviations(config.load(str(tmp_path / "s.json"))) == config.deviations(s)
    assert config.load(str(tmp_path / "fehlt.json")) == config.settings() and len(config.SETTINGS) == 96
