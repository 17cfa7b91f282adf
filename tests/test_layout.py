import math

from pyspark.sql import functions as F

from blattwerk.operators import layout as L


def test_two_columns_in_order(spark):
    rows, run = [], 0
    for k in range(20):  # the stream alternates between the columns
        for x in (60.0, 300.0):
            rows.append(("d", 0, run, x, 700.0 - 12 * k, x + 200, 710.0 - 12 * k))
            run += 1
    t = spark.createDataFrame(rows, "doc string, page int, run int, left double, bottom double, right double, top double")
    got = [r for r in L.column_order(t).orderBy("rank").collect()]
    assert all(r.moved for r in got) and [r.left for r in got] == [60.0] * 20 + [300.0] * 20
    assert sorted(r.run for r in got) == list(range(40))
    one = t.where("left = 60")
    assert not any(r.moved for r in L.column_order(one).collect())


def test_runs(spark):
    text = "ab cd\nef"
    x, rows = 0.0, []
    for i, c in enumerate(text):
        if c == "\n":
            x = 0.0
        rows.append(("d", 0, i, c, x, x + 5, 0.0 if i > 5 else 20.0, 10.0 if i > 5 else 30.0))
        x += 5 if i != 2 else 60
    t = spark.createDataFrame(rows, "doc string, page int, idx int, text string, left double, right double, bottom double, top double")
    assert [r.text.strip() for r in L.runs(t).orderBy("run").collect()] == ["ab", "cd", "ef"]


def grid(spark):
    s = [("d", 0, "h", float(y), 0.0, 100.0) for y in (0, 20, 40)] + [("d", 0, "v", float(x), 0.0, 40.0) for x in (0, 50, 100)] + [("d", 0, "h", 200.0, 0.0, 50.0)]
    return spark.createDataFrame(s, "doc string, page int, orient string, at double, lo double, hi double")


def test_grids_and_cells(spark):
    g = L.grids(grid(spark))
    assert g.count() == 6
    cells = L.grid_cells(g)
    assert cells.count() == 4
    chars = spark.createDataFrame([("d", 0, 0, "a", 10.0, 14.0, 25.0, 30.0), ("d", 0, 1, "b", 60.0, 64.0, 5.0, 9.0), ("d", 0, 2, "c", 300.0, 305.0, 0.0, 5.0)], "doc string, page int, idx int, text string, left double, right double, bottom double, top double")
    got = {r.text: (r.row, r.col) for r in L.cell_of(chars, cells).collect()}
    assert got == {"a": (0, 0), "b": (1, 1), "c": (None, None)}
    text = spark.createDataFrame([("d", 0, 0, r, c, t) for r, c, t in ((0, 0, "Kopf"), (0, 1, "Wert"), (1, 0, "a"), (1, 1, "1"), (2, 0, ""), (2, 1, " "))], "doc string, page int, table int, row int, col int, text string")
    assert L.markdown_tables(text).first().markdown == "| Kopf | Wert |\n| --- | --- |\n| a | 1 |"
    assert L.real_tables(text).count() == 1
    assert L.real_tables(text.where("row = 0")).count() == 0


def test_intervals_and_strokes(spark):
    i = spark.createDataFrame([("k", 0.0, 5.0), ("k", 4.0, 9.0), ("k", 20.0, 21.0)], "k string, lo double, hi double")
    assert sorted((r.lo, r.hi, r.teile) for r in L.merged_intervals(i, ["k"]).collect()) == [(0.0, 9.0, 2), (20.0, 21.0, 1)]
    p = spark.createDataFrame([("d", 0, 0.0, 0.0, 50.0, 1.0, False), ("d", 0, 0.0, 0.0, 40.0, 30.0, True), ("d", 0, 0.0, 0.0, 40.0, 30.0, False)], "doc string, page int, left double, bottom double, right double, top double, outlined boolean")
    assert L.strokes(p).count() == 5


def test_characters(spark):
    c = spark.createDataFrame([("d", 0, i, t, 10.0 if t not in "2i" else 7.0, 0.0 if t not in "2i" else 4.0 if t == "2" else -2.5, 0) for i, t in enumerate("x2+yi")], "doc string, page int, idx int, text string, size double, baseline double, line int")
    r = L.typeset_lines(c).first()
    assert r.latex == "x^2+y_i" and r.formula
    fix = spark.createDataFrame([("d", 0, 0, "X", 1), ("d", 0, 0, "Z", 2), ("d", 0, 2, "", 1)], "doc string, page int, idx int, repl string, prio int")
    assert L.replaced(c, fix).first().text == "Z2yi"
    bar = spark.createDataFrame([("d", 0, 0, 10.0, 0.0, 20.0)], "doc string, page int, bar int, at double, lo double, hi double")
    ab = spark.createDataFrame([("d", 0, 0, "a", 8.0, 12.0, 11.0, 18.0, 7.0), ("d", 0, 1, "b", 8.0, 12.0, 2.0, 9.0, 7.0), ("d", 0, 2, "z", 50.0, 55.0, 11.0, 18.0, 7.0)], "doc string, page int, idx int, text string, left double, right double, bottom double, top double, size double")
    assert L.fractions(bar, ab).first().latex == "\\frac{a}{b}"
    d = spark.createDataFrame([("d", 0, i + 10 * k, k, t, float(i), 0.0) for k in range(2) for i, t in enumerate("abc")], "doc string, page int, idx int, pos int, text string, left double, bottom double")
    assert L.without_doubles(d).count() == 3


def test_votes(spark):
    v = lambda a: [math.cos(a), math.sin(a)]
    s = spark.createDataFrame([("d", "f", 1, v(0.1)), ("d", "f", 1, v(0.0)), ("d", "f", 2, v(0.78))], "doc string, font string, code int, vec array<double>")
    refs = spark.createDataFrame([("a", v(0.0)), ("b", v(1.57))], "char string, vec array<double>")
    assert [(r.code, r.char) for r in L.glyph_votes(s, refs).collect()] == [(1, "a")]
    e = spark.createDataFrame([("d", "f", f"w{i % 4}", True) for i in range(6)] + [("d", "g", "w", False)], "doc string, font string, word string, for boolean")
    assert [r.font for r in L.recoded_fonts(e).collect()] == ["f"]
    assert spark.range(1).select(L.font_size(F.lit(10.0), F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(2.0)).alias("s")).first().s == 20.0
