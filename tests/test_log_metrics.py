from pyspark.sql import functions as F

from blattwerk.operators import log, metrics

ROWS = [
    (1, "2024-01-09 12:00:00", "2024-01-09 12:01:00", "OK", "a.pdf", "A.pdf", "in/a", "out/A", ""),
    (2, "2024-01-09 12:00:00", "2024-01-09 12:03:00", "PRÜFEN", "b.pdf", "", "in/b", "rev/b", ""),
    (3, "2024-01-09 12:00:00", "kaputt", "OK", "c.pdf", "C.pdf", "in/c", "out/C", ""),
    (4, "2024-01-10 12:00:00", "2024-01-10 12:00:30", "TEXT_ERNEUERT", "a.pdf", "A.pdf", "", "", ""),
    (5, "2024-01-11 12:00:00", "2024-01-12 12:00:30", "OK", "d.pdf", "D.pdf", "in/d", "out/D", ""),
    (6, "2024-01-11 12:00:00", "2024-01-12 12:00:30", "RÜCKGÄNGIG", "d.pdf", "D.pdf", "out/D", "in/d", ""),
    (7, "x", "y", "NEU", "", "", "", "", ""),
]
SCHEMA = "nr long, lauf string, zeit string, status string, original_name string, neuer_name string, von_pfad string, nach_pfad string, hinweis string"


def test_runs(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA).withColumn("md_pfad", F.lit(""))
    paged = log.with_pages(rows, spark.createDataFrame([("A.pdf", 100), ("b.pdf", 80)], "name string, seiten int"))
    got = {(r.lauf, r.art): r for r in log.run_summary(paged).collect()}
    first = got["2024-01-09 12:00:00", "Umwandlung"]
    assert (first.dateien, first.ok, first.pruefen, first.sekunden, first.seiten, first.seiten_je_minute) == (3, 2, 1, 180, 180, 60.0)
    assert got["2024-01-11 12:00:00", "Umwandlung"].sekunden is None
    steps = {r.nr: (r.name, r.sekunden, r.seiten) for r in log.step_durations(paged.withColumn("md_pfad", F.lit("x/b.x.md")), "nr").collect()}
    # a time that can't be read has no duration and stands last, as text
    assert steps == {1: ("A.pdf", 60, 100), 2: ("b.x", 120, 80), 3: ("C.pdf", None, None), 4: ("A.pdf", 30, 100), 5: ("D.pdf", None, None)}
    assert [r.nr for r in log.undo_plan(rows, "nr").collect()] == [3, 2, 1]
    empty = rows.limit(0)
    assert log.run_summary(empty.withColumn("seiten", F.lit(1))).count() == 0 and log.undo_plan(empty, "nr").count() == 0


def test_figures(spark):
    text = "<!-- Seite 3 (PDF 4) -->\n$a$ ⚠[Formel unsicher]\n�\nTabelle 3.2\nTabelle 3.2\n<!-- PDF-Seite 5 -->"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    m = {r.id: r for r in metrics.text_metrics(docs).collect()}
    assert (m[1].gedruckt, m[1].nur_pdf, m[1].fragezeichen, m[1].unsicher, m[1].formelzeilen, m[1].tabellentitel) == (1, 1, 1, 1, 1, 1)
    assert m[2].gedruckt == m[3].gedruckt == 0
    head = spark.createDataFrame([({"seiten": "12", "formelsatz": "3 Hoch-/Tiefstellungen, 4 Formelteile", "textquelle": "P + Formelsatz", "originaldatei": "a.b.PDF", "titel": "T", "titel_quelle": "Crossref"},), ({},)], "kopf map<string,string>")
    h = metrics.head_metrics(head, current="P + Formelsatz").collect()
    assert (h[0].seiten, h[0].hochtief, h[0].formelteile, h[0].verfahren, h[0].format, h[0].aktuell) == (12, 3, 4, ["Formelsatz"], "PDF", True)
    assert h[0].quellen == {"titel": "Crossref", "autor": "fehlt", "jahr": "fehlt"} and h[1].format == "?"
    src = spark.createDataFrame([(x,) for x in ("", "Norm X", "im Text", "PDF-Metadaten", "manuell", "EPUB")], "q string")
    assert [r.k for r in src.select(metrics.provenance(F.col("q")).alias("k")).collect()] == ["fehlt", "Norm", "Text", "PDF-Metadaten", "von Hand", "Dokument"]
    r = spark.createDataFrame([(1, "b; a"), (2, "a;"), (3, None)], "o int, p string")
    assert [(x.grund, x.anzahl) for x in metrics.reasons(r, "p", "o").collect()] == [("a", 2), ("b", 1)]


def test_undo(spark):
    # the last run by order of arrival, not by name; rows without paths never tell the run
    rows = [(1, "b", "OK", "x", "y"), (2, "c", "OK", "x", "y"), (3, "a", "PRÜFEN", "x", "y"), (4, "d", "OK", "", "y"), (5, "a", "UMBENANNT", "x", "z"), (6, "a", "FEHLER", "x", "z")]
    schema = "nr int, lauf string, status string, von_pfad string, nach_pfad string"
    plan = lambda r: [(x.nr, x.von, x.nach) for x in log.undo_plan(spark.createDataFrame(r, schema), "nr").collect()]
    assert plan(rows) == [(5, "z", "x"), (3, "y", "x")]
    assert plan([*rows, (7, "a", "RÜCKGÄNGIG", "z", "x")]) == [(2, "y", "x")]
    assert plan([*rows, (7, "a", "RÜCKGÄNGIG", "", "")]) == [(5, "z", "x"), (3, "y", "x")]
    assert plan([(1, "a", "RÜCKGÄNGIG", "z", "x")]) == []


def test_throttle_by_brute_force(spark):
    import random

    rng = random.Random(5)
    rows = [(n, rng.choice("ab"), rng.randint(0, 400) / 10, rng.choice(["x", "x", "x", "y"]), rng.random() < 0.05) for n in range(400)]
    rows += [(400 + n, "c", n / 10, "x", n == 9) for n in range(10)] + [(500, "c", None, "x", False)]
    want, state = [], {}
    for n, k, t, p, done in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        sent, phase = state.get(k, (None, None))
        if sent is None or p != phase or t - sent >= 0.2 - 1e-12 or done:
            state[k] = (t, p)
            want.append(n)
    df = spark.createDataFrame(rows, "n int, k string, t double, p string, done boolean")
    got = log.throttled(df.withColumn("t", F.col("t") * 10), "k", "t", "n", 2.0, "p", "done")
    assert sorted(r.n for r in got.collect()) == sorted(want) and sum(n >= 400 for n in want) == 6
    assert log.throttled(df.limit(0), "k", "t", "n").count() == 0
