import datetime as dt

import pytest

from blattwerk.llm import scan as S

BODY = [
    "Die Welle überträgt das Drehmoment über eine Passfeder und läuft",
    "nach kurzer Zeit warm. Deshalb muss der Prüfer größere Kräfte ver-",
    "meiden, denn die Schmierung genügt für lange Führungen. Die Ein-",
    "und Ausgabe der Welle nach der Zeichnung TS-",
    "3955 ist vor der Prüfung zu reinigen.",
]


TOPICS = ["", "Kupplung", "Bremse", "Nabe", "Scheibe", "Kette", "Feder", "Pumpe", "Leitung"]


def build():
    """A book of eight pages with running titles, numbers and misreadings."""
    t, rows, n = dt.datetime(2024, 1, 1), [], 0
    truth = {"rand": set(), "trennung": set(), "zeichen": set()}

    def add(page, pos, text, size=10.0, bold=0.0, kind=None, when=t):
        nonlocal n
        rows.append((n, 1, page, pos, text, size, bold, when))
        for k in kind or ():
            truth[k].add(n)
        n += 1

    for page in range(1, 9):
        add(page, 0, f"{page + 40} Lagerung der Wellen", 8.0, 0.0, ["rand"])
        add(page, 1, f"2.{page} Grundlagen", 12.0, 1.0)
        for i, line in enumerate(BODY):
            if i in (0, 4):  # no page is like another
                line = f"{TOPICS[page]} {line}" if i == 0 else line.replace("zu reinigen", f"an der {TOPICS[page]} zu reinigen")
            kind = ["trennung"] if i == 1 else []
            if page == 3 and i == 0:
                line, kind = line.replace("Drehmoment", "Drehrnoment"), ["zeichen"]
            if page == 4 and i == 2:
                line, kind = line.replace("Schmierung", "Schm·ierung"), ["zeichen"]
            add(page, 2 + i, line, kind=kind)
        add(page, 7, "26" if page == 5 else "Aufgabe 3")
        add(page, 8, str(page + 40), 8.0, 0.0, ["rand"])
    add(3, 2, "Nabe " + BODY[0], when=dt.datetime(2024, 2, 1))
    add(6, 3, None, when=dt.datetime(2023, 2, 1))
    add(7, 9, "")
    return rows, truth


SCHEMA = "zeile_id long, buch_id long, seite int, pos int, text string, groesse double, fett double, gelesen_am timestamp_ntz"


def test_cases_and_text(spark):
    rows, truth = build()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as block", "'x' as art", "2 as code")
    docs = spark.createDataFrame([(i, " ".join(BODY).replace("ver- meiden", "vermeiden") + " Grundlagen Aufgabe an der " + " ".join(TOPICS), "de") for i in range(20)], "doc_id long, text string, lang string")
    titles = spark.createDataFrame([(1, None)], "buch_id long, titel string")
    got = {k: set() for k in truth}
    for r in S.cases(df, docs, titles).collect():
        got[r.art].add(r.zeile_id)
    assert got == truth
    text = "\n".join(r.text for r in S.paragraphs(df, docs, titles).orderBy("absatz").collect())
    assert "vermeiden" in text and "Ein- und Ausgabe" in text and "Lagerung der Wellen" not in text and "Drehrnoment" not in text
    assert S.cases(df.limit(0), docs, titles).count() == 0


def test_strokes_and_candidates():
    for a, b in (("warm", "warrn"), ("schmierung", "sclimierung"), ("welle", "we1le"), ("dargestellt", "clargestellt"), ("wird", "vvird"), ("prüfung", "priifung"), ("neben", "ne6en")):
        assert S.strokes(a) == S.strokes(b)
    lex = S.Lexicon({"welle": 900, "die": 5000, "prüfung": 50, "der": 9000, "dor": 1}, {("die", "welle"): 300}, {})
    assert lex.decode(["die", "we1le"], [False, True]) == ["die", "welle"]
    assert lex.decode(["dic", "we■le"], [True, True]) == ["die", "welle"]
    assert lex.decode(["unbekanntes"], [True]) == ["unbekanntes"]


def test_page_numbers():
    assert [S.page_number(x) for x in ("12", "lO3", "iv", "ix", "IV", "", "abc")] == [12, 103, -996, -991, -996, None, None]
    assert S.edge_features("48 Lagerung und Führung")[1:] == ([48], False, True)
    assert S.edge_features("– ii –")[1:] == ([-998], True, False)
    assert S.edge_features("Seite 4 von 9")[2] and not S.edge_features("0,72")[2]


def test_words_beyond_the_tier(spark, monkeypatch):
    rows, truth = build()
    df = spark.createDataFrame(rows, SCHEMA)
    docs = spark.createDataFrame([(i, " ".join(BODY).replace("ver- meiden", "vermeiden") + " Grundlagen Aufgabe an der " + " ".join(TOPICS), "de") for i in range(20)], "doc_id long, text string, lang string")
    titles = spark.createDataFrame([(1, None)], "buch_id long, titel string")
    monkeypatch.setattr(S, "TIER", 5)
    got = {(r.zeile_id, r.art) for r in S.cases(df, docs, titles).collect()}
    assert {i for i, art in got if art == "zeichen"} == truth["zeichen"]


def test_nulls_and_odd_lines(spark):
    rows, truth = build()
    t = dt.datetime(2024, 1, 1)
    odd = [(800, None, 1, 0, "Welle", 1.0, 0.0, t), (801, 1, None, 0, "Welle", None, None, None), (802, 1, 2, None, "Welle", None, None, t), (803, 1, 2, None, None, None, None, None), (804, 1, 4, 3, "x" * 50_000, 10.0, 0.0, t), (805, None, None, None, None, None, None, None), (806, 1, 2, None, "  ", None, None, t)]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    docs = spark.createDataFrame([(1, None, None), (2, "", "de"), (3, " ".join(BODY) * 30, "de")], "doc_id long, text string, lang string")
    titles = spark.createDataFrame([(1, "Wellen"), (1, None), (None, "x")], "buch_id long, titel string")
    got = {(r.zeile_id, r.art) for r in S.cases(df, docs, titles).collect()}
    assert truth["rand"] <= {i for i, art in got if art == "rand"} and not {i for i, _ in got} & {800, 803, 804, 805, 806}
    assert S.paragraphs(df, docs, titles).count() > 8
    assert S.cases(df, docs.limit(0), titles.limit(0)).count() > 0


def test_words_and_paragraphs_over_the_end_of_a_block(spark):
    t, rows = dt.datetime(2024, 1, 1), []
    texts = {  # page 16 begins a block, page 32 is missing, 33 begins one
        14: BODY, 15: [*BODY[:4], "3955 verlangt eine Zeichnung und damit genügt die lange Schmie-"], 16: ["rung der Welle über lange Führungen und", *BODY],
        31: [*BODY[:4], "3955 läuft nach kurzer Zeit über die"], 33: ["Zeichnung der Passfeder.", *BODY],
        47: [*BODY[:4], "3955 läuft nach kurzer Zeit über die"], 48: ["4 Grundlagen", *BODY],
    }
    for page, body in texts.items():
        for i, line in enumerate(body):
            head = line == "4 Grundlagen"
            rows.append((page * 100 + i, 1, page, i, line, 14.0 if head else 10.0, float(head), t))
    df = spark.createDataFrame(rows, SCHEMA)
    # "iung" has the strokes of "rung", which by itself nobody knows
    docs = spark.createDataFrame([(i, " ".join(BODY).replace("ver- meiden", "vermeiden") + " Grundlagen verlangt eine damit iung", "de") for i in range(20)], "doc_id long, text string, lang string")
    titles = spark.createDataFrame([(1, None)], "buch_id long, titel string")
    found = {(r.zeile_id, r.art) for r in S.cases(df, docs, titles).collect()}
    assert (1504, "trennung") in found and (1600, "zeichen") not in found
    got = [r.text for r in S.paragraphs(df, docs, titles).orderBy("absatz").collect()]
    assert any("genügt die lange Schmierung der Welle" in x for x in got), got
    assert any("über die Zeichnung der Passfeder" in x for x in got), got
    assert any(x.endswith("über die") for x in got) and any(x == "4 Grundlagen" for x in got), got


def test_long_footers(spark):
    rows, _ = build()
    footer = "Lagerung der Wellen und Schmierung der langen Führungen"
    assert 45 < len(footer) <= S.LONGEST
    rows += [(900 + page, 1, page, 10, footer, 8.0, 0.0, dt.datetime(2024, 1, 1)) for page in range(1, 9)]
    titles = spark.createDataFrame([(1, None)], "buch_id long, titel string")
    got = {r.zeile_id for r in S.page_marks(spark.createDataFrame(rows, SCHEMA), titles).collect()}
    assert {900 + page for page in range(1, 9)} <= got


def test_no_pair_or_word_is_left_out(spark, monkeypatch):
    """All pairs and words tell, however many there are."""
    monkeypatch.setattr(S, "TIER", 2)
    monkeypatch.setattr(S, "PAIRS", 2)
    words = spark.createDataFrame([(w, S.strokes(w), 5, 40 - k) for k, w in enumerate(["welle", "lager", "zahnrad", "feder", "buchse"])], "word string, code string, n_doc long, n_line long")
    pairs = spark.createDataFrame([("welle", "lager", 9), ("lager", "feder", 5), ("feder", "buchse", 4), ("zahnrad", "welle", 2)], "a string, b string, n long")
    with pytest.warns(UserWarning, match="5 trusted words and 4 pairs"):
        lexicon = S.build_lexicon(words, pairs)
    assert lexicon.words["buchse"] == 5 * S.CLEAN_WEIGHT + 36 and len(lexicon.words) == 5
    assert lexicon.pairs["zahnrad", "welle"] == 2 and len(lexicon.pairs) == 4 and lexicon.follow["feder"] == 4


def test_nothing_is_costed_twice():
    """Every pair of candidates is costed once, every letter too many or lost looked up once."""
    asked = []

    class Counting(S.Lexicon):
        def cost(self, before, word):
            asked.append((before, word))
            return super().cost(before, word)

    lex = Counting({"welle": 900, "die": 5000, "der": 9000, "dor": 1}, {("die", "welle"): 300}, {})
    assert lex.decode(["dic", "we■le", "die"], [True, True, False]) == ["die", "welle", "die"]
    assert len(asked) == len(set(asked))

    class Channel(dict):
        def get(self, key, default=None):
            asked.append(key)
            return super().get(key, default)

    asked.clear()
    assert S.aligned("warrn", "warm", Channel({("rn", "m"): 0.5})) == (0.5, [("rn", "m")])
    letters = [key for key in asked if "" in key]
    assert len(letters) == len("warrn") + len("warm")


def test_words_and_pairs_counted(spark):
    """Words of clean texts and of lines apart, pairs of both together; first and only words too."""
    rows = [("die Welle läuft.", True), ("Die Welle", False), ("Nabe", False), ("die Welle läuft ver-", False), (" . die (Welle) 12 Nabe", True), ("   ", False), ("Schmie-", False), (None, True)]
    words, pairs = S.lexicon_counts(spark.createDataFrame(rows, "text string, clean boolean"))
    assert {(r.word, r.n_doc, r.n_line) for r in words.collect()} == {("die", 2, 2), ("welle", 2, 2), ("läuft", 1, 1), ("nabe", 1, 1)}
    assert all(r.code == S.strokes(r.word) for r in words.collect())
    assert {(r.a, r.b, r.n) for r in pairs.collect()} == {("die", "welle", 4), ("welle", "läuft", 2)}
