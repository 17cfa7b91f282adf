import pytest

from blattwerk.llm import encoding as E

TEXT = "Deshalb muss der Prüfer größere Kräfte vermeiden und die Führungen überträgt."
CHAINS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("mac_roman", "cp1252"), ("cp850", "cp1252")]
FINE = [TEXT, "SÃO BRÁS DO CAIMBÓ (Werk III)", "ÂGE DE LA POMPE : 12 ANS", "nach ГОСТ 3325 (Посадки) zu wählen", "der Wert √2 · d² ≈ 1,41 d²", "λόγος", "軸受", "", "plain text", "ＫＶ－７７２６ breit", "auf\xa0der Welle"]


def garble(text, right, wrong):
    raw = text.encode(right)
    table = {b: (bytes([b]).decode(wrong) if _ok(b, wrong) else chr(b)) for b in range(256)}
    return "".join(table[b] for b in raw)


def _ok(b, codec):
    try:
        bytes([b]).decode(codec)
        return True
    except UnicodeDecodeError:
        return False


def test_round_trips_and_decoys(spark, documents):
    model = E.fit(documents)
    bad = [garble(TEXT, r, w) for r, w in CHAINS] + [garble(garble(TEXT, "utf-8", "cp1252"), "utf-8", "cp1252")]
    rows = [(i, t) for i, t in enumerate([*bad, *FINE, None, "Tr�gerkraft"])]
    df = spark.createDataFrame(rows, "id int, text string").selectExpr("*", "'x' as chain", "1 as __t")
    got = {r.id: r for r in E.examine(df, model, ["id"]).collect()}
    assert [got[i].restored for i in range(len(bad))] == [TEXT] * len(bad)
    assert not [FINE[i - len(bad)] for i in got if len(bad) <= i < len(bad) + len(FINE)]
    assert got[len(rows) - 1].chain == "lost"
    whole = {r.id: r.restored for r in E.restore(df.select("id", "text"), model, "id").collect()}
    assert len(whole) == len(rows) and whole[len(rows) - 2] is None and whole[len(bad)] == TEXT
    assert E.examine(df.limit(0), model, ["id"]).count() == 0
    asked = df.selectExpr("id", "text", "id % 2 = 0 as asked")
    left = {r.id for r in E.in_order(asked, model, "text", "asked").collect()}
    assert left == {i for i, _ in rows if i % 2 or i not in got}


def test_without_labels(spark, documents):
    none = E.fit(documents.limit(0))
    d = E.Decoder(none)
    assert d.examine("alles in Ordnung") is None
    assert d.examine(garble(TEXT, "utf-8", "cp1252"))[1] == TEXT


def test_garbled_into_usual_characters_only(spark, documents):
    model = E.fit(documents)
    text = "Deshalb muss der Prüfer größere Kräfte vermeiden."
    french = "le contrôleur évite des efforts élevés et la lubrification suffit après peu de temps"
    garbled = [("deshalb muss die Welle Kräfte vermeiden und das Drehmoment Kräfte", "mac_roman", "cp850"), ("le contrôleur évite des efforts élevés et la lubrification suffit", "mac_roman", "cp437")]
    bad = [(t, garble(t, r, w)) for t, r, w in garbled]
    assert all(c < "\x80" or c in E.PLAIN for _, b in bad for c in b)
    fine = [text, french, "eine Brücke bei 20 °C und 3 m² – größer", "Höchstgrößenänderungsmaß"]
    df = spark.createDataFrame(list(enumerate([b for _, b in bad] + fine)), "id int, text string")
    got = {r.id: r.restored for r in E.examine(df, model, ["id"]).collect()}
    assert got == {i: t for i, (t, _) in enumerate(bad)}


def test_every_pair_of_codecs(documents):
    d = E.Decoder(E.fit(documents))
    wrong = []
    for right, codecs in E.WRONG_FOR.items():
        for codec in codecs:
            try:
                bad = garble(TEXT, right, codec)
            except UnicodeEncodeError:
                continue
            if bad != TEXT and (hit := d.examine(bad)) is None or bad != TEXT and hit[1] != TEXT:
                wrong.append((right, codec, bad, hit))
    assert not wrong


def test_fitted_on_whole_texts_of_all_documents(spark, documents):
    """Words beyond 6,000 characters of a text, and of more documents than a sample has, count."""
    plain = "Der Werkstoff wird ohne weitere Angaben erneut beschrieben und bewertet.\n"
    late = plain * 100 + "Die Gärbehälterdeckel und die Rührflügelnaben stehen im Käsereigebäude.\n"
    rows = [(100_000 + i, late, "de") for i in range(2)] + [(200_000 + i, plain, "de") for i in range(4000)]
    rows += [(300_000 + i, f"Der Prüfling {'abcdefghij'[i % 10]} trägt die Aufschrift Hülsenführungsmaß hier.", "de") for i in range(2)]
    df = documents.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    model = E.fit(df)
    assert {"gärbehälterdeckel", "rührflügelnaben", "käsereigebäude", "hülsenführungsmaß"} <= model.words["de"]
    n = {(r.kind, r.item): r.n for r in E.text_counts(df.where("doc_id >= 100000")).collect()}
    assert n["w", "rührflügelnaben"] == 2 and n["c", "ß"] == 2 and n["r", "Der Werkstoff wird ohne "] == 4200
    assert E.fit(df.repartition(7)) == model
    bad = garble("die Gärbehälterdeckel", "mac_roman", "cp850")
    got = E.examine(spark.createDataFrame([(1, bad)], "id int, text string"), model, ["id"]).collect()
    assert [r.restored for r in got] == ["die Gärbehälterdeckel"]


def test_p2_leaves_out_what_whole_documents_tell(spark, documents, tmp_path):
    """A garbled line whose words stand behind 6,000 characters of a text is no case of problem 2."""
    from blattwerk.llm.queries import p2_found

    plain = "Der Werkstoff wird ohne weitere Angaben erneut beschrieben und bewertet.\n" * 100
    late = plain + "Die Gärbehälterdeckel und die Rührflügelnaben stehen im Käsereigebäude.\n"
    more = spark.createDataFrame([(100_000 + i, late, "de") for i in range(2)], "doc_id long, text string, lang string")
    documents.select("doc_id", "text", "lang").unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    bad = "die\u200b " + garble("Gärbehälterdeckel und die Rührflügelnaben", "cp1252", "cp850")
    spark.createDataFrame([(1, bad), (2, "die\u200b Welle"), (3, "die Welle")], "zeile_id long, text string").write.parquet(f"{tmp_path}/zeilen.parquet")
    spark.createDataFrame([(1, bad)], "hervorhebung_id long, text string").write.parquet(f"{tmp_path}/hervorhebungen.parquet")
    got = {(r.tabelle, r.id) for r in p2_found(spark, str(tmp_path)).collect()}
    assert got == {("zeilen", 2), ("hervorhebungen", 1)}


def test_short_lines_tell_what_p2_leaves_out(spark, documents, tmp_path):
    """Words that stand in lines of 20 characters or less only count as well."""
    from blattwerk.llm.queries import p2_found

    more = spark.createDataFrame([(100_000 + i, "Gärbehälterdeckel\nRührflügelnaben\n", "de") for i in range(2)], "doc_id long, text string, lang string")
    documents.select("doc_id", "text", "lang").unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    bad = "die\u200b " + garble("Gärbehälterdeckel und die Rührflügelnaben", "cp1252", "cp850")
    spark.createDataFrame([(1, bad), (2, "die\u200b Welle")], "zeile_id long, text string").write.parquet(f"{tmp_path}/zeilen.parquet")
    spark.createDataFrame([], "hervorhebung_id long, text string").write.parquet(f"{tmp_path}/hervorhebungen.parquet")
    assert {(r.tabelle, r.id) for r in p2_found(spark, str(tmp_path)).collect()} == {("zeilen", 2)}


def test_dictionary_has_what_is_frequent_in_all_documents(spark):
    """Two words that stand together in thousands of different lines are in the dictionary,
    however many longer lines there are that occur once."""
    rare = [f"{'Wellendichtring' * 2}{i} {'Passfedernut' * 2}{i} {'Kegelrad' * 3}{i} {'Gehäuse' * 4}{i}" for i in range(18_000)]
    often = [f"x{i} Kurbel wange y{i}" for i in range(3000)]
    df = spark.createDataFrame([(i, "\n".join(rare[i::6] + often[i::6]), "de") for i in range(6)], "doc_id long, text string, lang string")
    model = E.fit(df)
    assert b"Kurbel wange " in model.dictionaries["de"]
    n = {r.item: r.n for r in E.text_counts(df, runs=False).where("kind = 'p' and n > 1").collect()}
    assert n == {"Kurbel wange": 3000} and len(model.dictionaries["de"]) == E.DICT_BYTES
    assert E.fit(df.repartition(5)) == model


def test_pairs_are_chained_into_a_dictionary():
    assert E.chained(["der Welle", "auf der", "Welle dreht", "ein Rad"]) == b"ein Rad auf der der Welle dreht "
    assert E.chained([]) == b""
    many = [f"a{i} b{i}" for i in range(20_000)]
    got = E.chained(many)
    assert len(got) == E.DICT_BYTES and got.endswith(b"a1 b1 a0 b0 ") and b" a4000 b4000 " in got and b"a6000" not in got


def test_long_words_are_paired_in_parts(spark):
    df = spark.createDataFrame([(1, "kurz " + "ä" * 70 + "  Ende da", "de"), (2, None, "de"), (3, "", "de"), (4, "allein", "en")], "doc_id long, text string, lang string")
    n = {r.item: r.n for r in E.text_counts(df, runs=False).where("kind = 'p'").collect()}
    part = "ä" * E.PART
    assert n == {f"kurz {part}": 1, f"{part} {part}": 1, f"{part} {'ä' * 6}": 1, f"{'ä' * 6} Ende": 1, "Ende da": 1}
    model = E.fit(df)
    assert model.dictionaries["en"] == b"" and E.Decoder(model).examine("die Welle") is None
    assert E.Decoder(model).examine("die Kr\u0084fte") is not None


def test_nothing_is_compressed_where_only_known_words_tell(spark, documents, monkeypatch):
    decoder = E.Decoder(E.fit(documents))
    text = "die Welle kèrz warm"
    assert decoder.results("kèrz") and not decoder.known("kèrz", "de") and not decoder.plain(text)
    garbled = "die Welle lèuft warm"  # läuft, of Mac OS Roman read as code page 850
    assert decoder.examine(garbled)[1] == "die Welle läuft warm"
    monkeypatch.setattr(decoder, "shortest", lambda text: pytest.fail("compressed"))
    assert decoder.examine(text) is None
