import random

import numpy as np
from pyspark.sql import functions as F

from blattwerk.llm import langid as L
from blattwerk.llm.labels import named_language

from .conftest import prose


def test_labels(spark):
    labels = ["de", "DE", "de-DE", "ger", "German", " fr_FR ", "und", "xx", "", None, "NLD"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, x string")
    got = [r.y for r in df.select("i", named_language(F.col("x")).alias("y")).orderBy("i").collect()]
    assert got == ["de", "de", "de", "de", "de", "fr", None, None, None, None, "nl"]


def test_tables_equal_the_convolution():
    rng = np.random.default_rng(0)
    net = L.Network.fresh(("de", "en"), rng)
    x = rng.integers(0, 256, (40, L.WINDOW)).astype(np.uint8)
    assert np.allclose(net.features(x, net.tables()), net.pooled(x)[0], atol=1e-4)


def test_windows_cover_all():
    for n in (1, 95, 96, 97, 200):
        raw = bytes(range(48, 48 + 50)) * 5
        w = L.windows(raw[:n].decode())
        assert all(len(x) <= L.WINDOW for x in w) and sum(map(len, w)) >= n and w[-1] == raw[:n][-len(w[-1]) :]


def test_held_out_accuracy_and_segments(spark, corpus, monkeypatch):
    rng = random.Random(9)
    noisy = [(rng.choice(["de", "en", "fr"]) if rng.random() < 0.1 else k, t) for _, t, k in corpus]
    net = L.fit_rows(noisy)
    new = [(k, prose(k, 3, rng)) for k in ("de", "en", "fr") * 20]
    got = L.classify([t for _, t in new], net)
    assert sum(g[0][2] == k for g, (k, _) in zip(got, new)) >= 58
    table = "| a | b |\n| --- | --- |\n| 1 | 2 |"
    rows = [
        (1, prose("de", 4, rng) + "\n\n" + prose("en", 3, rng) + "\n\n" + prose("de", 4, rng), "de"),
        (2, prose("fr", 4, rng), "fr-FR"), (3, table, None), (4, "", "de"), (5, None, None), (6, prose("en", 4, rng), ""),
        (7, prose("de", 5, rng) + " „short quotation in English“", "de"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as segment", "2 as konfidenz")
    seg = L.segments(df, net)
    by = {}
    for r in seg.orderBy("doc_id", "segment").collect():
        by.setdefault(r.doc_id, []).append(r.lang)
        assert 0 < r.konfidenz <= 1
    assert by == {1: ["de", "en", "de"], 2: ["fr"], 6: ["en"], 7: ["de"]}
    assert {(r.doc_id, r.lang) for r in L.unnamed(df, seg).collect()} == {(1, "en"), (6, "en")}
    share = {(r.doc_id, r.lang): r.anteil for r in L.document_languages(df, seg).collect()}
    assert abs(share[1, "de"] + share[1, "en"] - 1) < 1e-9 and share[3, "und"] == share[4, "und"] == share[5, "und"] == 0
    assert {k for k, _ in share} == set(range(1, 8))
    assert L.segments(df.limit(0), net).count() == 0


def test_prose_beside_marks_tables_and_formulas():
    prose_line = "Die Welle überträgt das Drehmoment über eine Passfeder."
    for first in ("<!-- Seite 3 (PDF 9) -->", "| a | b |\n| --- | --- |", "$F = 3$", "$$\nF = \\alpha\n$$", "## 2 Wellen", "![Bild](wellen.png)", "```\nfor word in words: print(word)\n\nreturn words\n```", "---"):
        for text in (f"{first}\n{prose_line}", f"{prose_line}\n{first}"):
            assert [(text[a:b], body) for a, b, body in L.blocks(text)] == [(prose_line, L.clean(prose_line))], text
    assert [body for _, _, body in L.blocks(f"<!-- Seite 3 --> {prose_line}")] == [L.clean(prose_line)]
    assert [body for _, _, body in L.blocks(f"$F$ {prose_line}")] == [L.clean(prose_line)]
    assert not list(L.blocks("| Welle und Nabe | Drehmoment der Passfeder |\n<!-- Seite dreihundertundfünfundzwanzig -->"))


def test_language_changes_at_a_single_newline(corpus):
    rng = random.Random(4)
    net = L.fit_rows([(k, t) for _, t, k in corpus])
    de, en, fr = (prose(k, 5, rng) for k in ("de", "en", "fr"))
    wrapped = "\n".join(de[i : i + 70] for i in range(0, len(de), 70))
    text = f"{wrapped}\n{en}\n{de}"
    cut = (text.index(en), text.index(en) + len(en))
    texts = [text, f"{fr}\n{en}", wrapped, f"{de}\n{en}\n{wrapped}\n{fr}"]
    got = L.classify(texts, net)
    assert [[g[2] for g in own] for own in got] == [["de", "en", "de"], ["fr", "en"], ["de"], ["de", "en", "de", "fr"]]
    assert got[0][1][:2] == cut
    assert text[slice(*got[0][0][:2])] == wrapped


def test_confidence_is_that_of_the_language_named():
    found = [(0, 50, "de", {"de": 0.9, "en": 0.06, "fr": 0.04}, 4), (50, 60, "en", {"de": 0.1, "en": 0.5, "fr": 0.4}, 1)]
    assert L.merge(found) == [(0, 60, "de", (0.9 * 4 + 0.1) / 5)]
