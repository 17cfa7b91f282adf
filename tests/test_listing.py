from pyspark.sql import functions as F

from blattwerk.operators import listing as L
from blattwerk.plans import execution as E


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_display(spark):
    docs = spark.createDataFrame([("Prüfung É", 2), ("abc", 3), (None, 1), ("ABD", 3)], "name string, t int")
    assert [r.name for r in L.named_like(docs, "name", "prufung e").collect()] == ["Prüfung É"] and L.named_like(docs, "name", "").count() == 4
    assert [r.name for r in L.newest_first(docs, "name", "t").collect()] == ["abc", "ABD", "Prüfung É", None]
    s = spark.createDataFrame([("a", 1), ("a", 2), ("b", 0), (None, 4)], "r string, n int")
    assert sorted((str(x.r), x.n, x.prozent) for x in L.shares(s, "r", "n").collect()) == [("None", 4, 100), ("a", 1, 33), ("a", 2, 67), ("b", 0, None)]
    assert one(spark, L.ratio(F.lit(1), F.lit(8))) == 13 and one(spark, L.ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, L.axis_ticks(F.lit(7.0))) == [0.0, 2.0, 4.0, 6.0, 8.0] and one(spark, L.axis_ticks(F.lit(0.0))) == [0.0, 1.0]
    assert one(spark, L.axis_ticks(F.lit(1000.0))) == [0.0, 250.0, 500.0, 750.0, 1000.0]


def test_texts_versions_and_parts(spark):
    assert one(spark, L.trimmed_text(F.lit(" a \r\nb \r\rc\n\n"))) == "a\nb\n\nc"
    got = [one(spark, L.version(F.lit(v))) for v in ("v1.2", "1.2.3", "1.2.0-beta", "", None)]
    assert [g and tuple(g) for g in got] == [(1, 2, 0), (1, 2, 3), None, None, None]
    f = spark.createDataFrame([("a/b/x", 5), ("a/b/y", 1), ("z", 2)], "p string, n int")
    assert [tuple(r) for r in L.folder_sizes(f, "p", "n").collect()] == [("a/b", 6, 2), (".", 2, 1)]
    p = spark.createDataFrame([("k", "y"), ("k", "x"), ("k", "y")], "k string, o string")
    assert [tuple(r) for r in L.repeated_parts(p, ["k"], "o").collect()] == [("k", ["x", "y"], 2)]


def test_links(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(30)] + [("a", "b"), ("b", "a"), ("x", "y")]
    to = dict(chain)

    def follow(p):
        for _ in range(20):
            if p not in to:
                break
            p = to[p]
        return p

    df = spark.createDataFrame(chain, "path string, to string")
    assert {r.path: r.target for r in L.resolved(df).collect()} == {p: follow(p) for p in to}
    assert L.resolved(df.limit(0)).count() == 0


def test_execution(tmp_path):
    for n in ("a.pdf", "a.md", "b.pdf", "b.md", "Neu.pdf"):
        (tmp_path / n).write_text(n)
    plan = [{"md": tmp_path / f"{n}.md", "original": tmp_path / f"{n}.pdf", "neu": "Neu"} for n in ("a", "b", "weg")]
    rows = list(E.renamed("r1", plan))
    assert [r["neuer_name"] for r in rows] == ["Neu (2)", "Neu (3)"] and (tmp_path / "Neu (2).md").read_text() == "a.md"
    steps = [{"lauf": "r1", "von": r["nach_pfad"], "nach": r["von_pfad"], "md": r["md_pfad"]} for r in reversed(rows)]
    (tmp_path / "a.pdf").write_text("belegt")
    back = list(E.taken_back(steps))
    assert [r["nach_pfad"] for r in back] == [str(tmp_path / "b.pdf")] and back[0]["status"] == "RÜCKGÄNGIG"
    assert (tmp_path / "b.md").read_text() == "b.md" and (tmp_path / "a.pdf").read_text() == "belegt" and (tmp_path / "Neu (2).pdf").exists()
    assert list(E.renamed("r", plan, lambda: True)) == []
