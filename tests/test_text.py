from pyspark.sql import functions as F

from blattwerk.functions import text as T


def values(spark, f, items):
    """``f`` of each item, in order; one job for all."""
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_divided_words(spark):
    got = values(spark, T.join_divided, ["Kon-\nstruktion", "Ein-\nund Ausgabe", "Maschinenbau-\nTechniker", "a￾\nb", "2020-\nheute", None, ""])
    assert got == ["Konstruktion", "Ein- und Ausgabe", "Maschinenbau-Techniker", "ab", "2020-\nheute", None, ""]


def test_names(spark):
    assert values(spark, T.file_name_safe, ["A: B", 'x<y>:"z"?', " . ", None]) == ["A – B", "x y z", "", None]
    assert values(spark, T.usable_title, ["???:*", "A", None]) == [False, True, False]
    assert values(spark, T.short_author, ["A B, C D und E F", "A B", None]) == ["A B et al.", "A B", None]
    assert values(spark, T.person_in_order, ["Mann, Thomas, 1875-1955", "Muster, Max", "Max Muster"]) == ["Thomas Mann", "Max Muster", "Max Muster"]
    assert values(spark, T.accepted_title, ["Dokument1", "Sehr langes Dokument", "978-3-16-148410-0", "ab"]) == [None, "Sehr langes Dokument", None, None]
    assert values(spark, T.accepted_author, ["Admin", "Erika Muster", ""]) == [None, "Erika Muster", None]


def test_years_and_identifiers(spark):
    y = lambda c: T.publication_year(c, 2025)
    assert values(spark, y, ["© 2010 Verlag, 2. Auflage 2015", "3. Auflage 2019", "1999", "© 2090"]) == ["2015", "2019", None, None]
    i = lambda c: T.identifiers(F.lit(None).cast("array<string>"), c)
    assert values(spark, i, ["doi 10.1007/abc_5 und 10.1007/abc. ISBN 978-3-16-148410-0", ""]) == [["10.1007/abc", "978-3-16-148410-0"], []]


def test_predicates(spark):
    assert values(spark, T.ends_sentence, ["Ende.", "vgl.", "z. B.", "weiter", ""]) == [True, False, False, False, True]
    assert values(spark, T.balanced, ["(a)", ")(", "((", "x"]) == [True, False, False, True]
    rep = "\n".join(["Zeile eins hier", "Zeile zwei hier", "Zeile drei hier"] * 2)
    assert values(spark, T.repeated_lines, [rep, "kurz", ""]) == [True, False, False]
    assert values(spark, T.log_time, ["2024-01-09 12:00:00", "gestern", None])[1:] == [None, None]


def test_cleaning(spark):
    assert values(spark, T.clean_lines, ["Inhalt ......... 7", "über\tﬁn", "a\x01b­c", "x    y  "]) == ["Inhalt … 7", "über fin", "a�bc", "x  y"]
    assert values(spark, T.mark_unsure_formulas, ["$a�$", "$a$ �", "x"]) == ["⚠[Formel unsicher]$a�$", "$a$ �", "x"]
    assert values(spark, T.without_markers, ["a <!-- Seite 12 (PDF 14) --> b", "<!-- PDF-Seite 3 -->\nx"]) == ["a b", "x"]
    assert values(spark, T.without_licence_marks, ["Normen-Download-Beuth-X-123", "Inhalt"]) == ["", "Inhalt"]
    assert values(spark, T.letters_only, ["Größe 2!", None]) == ["große2", None]
