import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from blattwerk.llm import unify as U

CASES = {
    "Ｄｉｅ Welle": "Die Welle",
    "über": "über",
    "neben\xa0der　Welle": "neben der Welle",
    "Ze​hn﻿tel": "Zehntel",
    "Sсhmіеrkrаft": "Schmierkraft",
    "Τhe νalνe": "The valve",
    "Stützﬂäche": "Stützfläche",
    "DN‑3434": "DN-3434",
    "bei 17 ℃": "bei 17 °C",
    "eѕ ist ѕо": "es ist so",
}
SAME = ["nach ГОСТ 3325 (Посадки подшипников) zu wählen", "λόγος wird hier verstanden", "R = 47 Ω und φ", "N/mm² und p₀", "¼ links, ½ zurück", "軸受", "Šimrek, Převody", "Füh\xad", "Füh¬", "", "plain"]


def test_forms(spark):
    rows = [(i, t) for i, t in enumerate([*CASES, *SAME, None])]
    df = spark.createDataFrame(rows, "id int, text string").selectExpr("id", "text", "1 as unified_by", "'x' as ch", "0 as __pos")
    got = {r.id: r.unified for r in U.unify(df, ["id"]).collect()}
    assert [got[i] for i in range(len(CASES))] == list(CASES.values())
    assert [got[len(CASES) + i] for i in range(len(SAME))] == SAME
    assert got[len(rows) - 1] is None
    assert U.changed(df.limit(0), ["id"]).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_rebuild_is_stable_and_composed(text):
    m = U.mapping()

    def once(t):
        return U.rebuild(list(t), [m.get(c, c) for c in t], [U.LOOKALIKE.get(c) for c in t])

    new = once(text)
    assert unicodedata.is_normalized("NFC", new)
    assert once(new) == new or any(c in U.LOOKALIKE for c in new)


def test_long_text(spark):
    text = "wort über " * 20_000
    got = U.changed(spark.createDataFrame([(1, text)], "id int, text string"), ["id"]).first()
    assert got.unified == "wort über " * 20_000
