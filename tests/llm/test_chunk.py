import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blattwerk.llm import chunk as C


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400), st.integers(1, 60), st.integers(0, 40))
def test_spans(text, limit, overlap):
    got = C.spans(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(b - a <= limit for a, b in got)
    for (a, b), (c, d) in zip(got, got[1:]):
        assert a < c <= b < d and b - c <= max(0, min(overlap, limit // 2))


def rows_of(pages):
    t = dt.datetime(2024, 1, 1)
    return [(k, 1, s, p, x, t) for k, (s, p, x) in enumerate((s, p, x) for s, page in enumerate(pages) for p, x in enumerate(page))]


SCHEMA = "zeile_id long, buch_id long, seite int, pos int, text string, gelesen_am timestamp_ntz"


@pytest.mark.parametrize("limits, chunk", [(1024, 4096), (2, 4096), (1, 3), (5, 4)])
def test_pages(spark, limits, chunk, monkeypatch):
    monkeypatch.setattr(C, "LIMITS", limits)
    monkeypatch.setattr(C, "CHUNK", chunk)
    rng = random.Random(1)
    line = lambda: " ".join("wort" * rng.randint(1, 2) for _ in range(8)) + rng.choice([".", ""])
    pages = [[line() for _ in range(n)] for n in (3, 14, 30)] + [["x" * 900 + " " + "y " * 900, "", "", "z" * 2000, "1.2 a" * 90], [None, "a", None], [None]]
    rows = rows_of(pages)
    late = dt.datetime(2025, 1, 1)
    rows += [(900, 1, 0, 0, "neu gelesen", late), (901, 1, 0, 1, None, late)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("x", "x").selectExpr("*", "1 as teil", "2 as abschnitt")
    got = C.pieces(df, 300, 40).collect()
    want = {0: "\n".join(["neu gelesen", pages[0][2]])} | {s: "\n".join(x for x in p if x is not None) for s, p in enumerate(pages) if s and any(x is not None for x in p)}
    assert {r.seite for r in got} == set(want)
    for s, text in want.items():
        mine = sorted((r for r in got if r.seite == s), key=lambda r: (r.von, r.bis))
        assert all(r.text == text[r.von : r.bis] and len(r.text) <= 300 and r.umfang == len(text) for r in mine)
        assert mine[0].von == 0 and mine[-1].bis == len(text)
        assert all(a.bis - 40 <= b.von <= a.bis for a, b in zip(mine, mine[1:]))
        assert (len(mine) > 1) == (len(text) > 300)
        # the same pieces as of the whole page at once, however the work is parted
        assert [(r.teil, r.von, r.bis) for r in mine] == [(k, a, b) for k, (a, b) in enumerate(C.spans(text, 300, 40))]
    assert C.pieces(df.limit(0), 300, 40).count() == 0
    nowhere = df.selectExpr("zeile_id", "cast(null as long) as buch_id", "cast(null as int) as seite", "pos", "text", "gelesen_am").where("seite is null").limit(5)
    assert {(r.buch_id, r.seite) for r in C.pieces(nowhere, 300, 40).collect()} == {(None, None)}
