from blattwerk.llm import names as N

SAME = [
    ["Dietrich Lüllahixbusch", "D. Lüllahixbusch", "Lüllahixbusch, Dietrich", "Dieter Luellahixbusch", "Prof. Dr. Dietrich LÜLLAHIXBUSCH (Hrsg.)", "Dietrich Lülahixbusch", "lüllahixbusch dietrich", "Dietrihc Lüllahixbusch", "Lüllahixbusch, D., 1956-"],
    ["Susanne Pörpokomlauff", "Susi Pörpokomlauff", "Pörpokomlauff, S."],
    ["Arbeitskreis Messwesen Lasgimerallbruck", "AK Messwesen Lasgimerallbruck", "AKM Lasgimerallbruck", "Lasgimerallbrucker Arbeitskreis Messwesen", "Lasgimerallbruck, Arbeitskreis Messwesen", "ARBEITSKREIS MESSWESEN LASGIMERALLBRUCK (HRSG.)", "Arbeitskreis Messwesen in Lasgimerallbruck"],
    ["Institut für Werkstoffprüfung Bilrunierstedt", "IfW Bilrunierstedt", "Inst. f. Werkstoffprüfung Bilrunierstedt e. V."],
    ["Susanne Pörpokomlauff und Dietrich Lüllahixbusch", "Lüllahixbusch, D.; S. Pörpokomlauff", "Pörpokomlauff S., Dietrich Lüllahixbusch", "Susanne Pörpokomlauff et al."],
    ["Institut für Normung Bilrunierstedt", "IfN Bilrunierstedt"],
]
NOBODY = [None, "", "admin", "N. N.", "-", "scanner01", "unbekannt", "Windows-Benutzer"]


def rows(spark):
    items = [a for group in SAME for a in group] + NOBODY
    items += [g[0] for g in SAME] * 2  # canonical forms are frequent
    return items, spark.createDataFrame([(i, a) for i, a in enumerate(items)], "kopf_id int, autor string").selectExpr("*", "'x' as entity", "1 as n", "2 as root")


def test_links(spark):
    items, df = rows(spark)
    got = {r.kopf_id: r.entity for r in N.links(df, "kopf_id").collect()}
    k = 0
    ids = []
    for group in SAME:
        mine = {got[k + i] for i in range(len(group))}
        assert len(mine) == 1, (group, mine)
        ids.append(mine.pop())
        k += len(group)
    assert len(set(ids)) == len(ids)
    assert not set(range(k, k + len(NOBODY))) & set(got)
    pairs = {(r.kopf_id_a, r.kopf_id_b) for r in N.pairs(df, "kopf_id").collect()}
    brute = {(a, b) for a in got for b in got if a < b and got[a] == got[b] and items[a] != items[b]}
    assert pairs == brute
    assert N.pairs(df.limit(0), "kopf_id").count() == 0


def test_near_by_brute_force():
    import random

    rng = random.Random(2)
    for _ in range(3000):
        a = "".join(rng.choices("abc", k=rng.randint(0, 5)))
        b = "".join(rng.choices("abc", k=rng.randint(0, 5)))
        one = {a} | {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in "abc"}
        one |= {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in "abc"} | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
        assert N.near(a, b) == (b in one)
        if b in one:
            assert set(N.deletions(a)) & set(N.deletions(b))


def test_frequent_neighbours_stay_apart(spark):
    given = ["Anna", "Bernd", "Carla", "Dora", "Emil", "Fritz", "Gerda", "Hugo", "Ida", "Jonas"]
    items = [f"{g} {s}" for s in ("Hofmann", "Hoffmann") for g in given] + [f"{s}, {g}" for s in ("Hofmann", "Hoffmann") for g in given] + ["Hoffmnn, Anna", "Anna Hoffmannn"]
    df = spark.createDataFrame(list(enumerate(items)), "kopf_id int, autor string")
    got = {items[r.kopf_id]: r for r in N.links(df, "kopf_id").collect()}
    assert got["Anna Hofmann"].entity != got["Anna Hoffmann"].entity
    assert got["Hoffmnn, Anna"].entity == got["Anna Hoffmannn"].entity == got["Anna Hoffmann"].entity
    assert all(0 < r.posterior <= 1 for r in got.values()) and got["Hoffmnn, Anna"].links == 3


def test_learned_short_forms_and_kinds(spark):
    others = ["adelgard", "burkmar", "cunibert", "dankrad", "edelburg", "frowin", "gislind", "hartmut", "irmfried", "walburg"]
    short = [(f"s{n}", w) for n in range(30) for w in ("theodulf", "dulfi")] + [(f"t{n}", w) for n in range(100) for w in (others[n % 10], others[(n + 3) % 10])] + [(f"u{n}", w) for n in range(12) for w in ("theodulf", others[n % 10])]
    got = {(r.word, r.name) for r in N.short_forms(spark.createDataFrame(short, "root string, word string")).collect()}
    assert ("dulfi", "theodulf") in got and not any(a in others for a, _ in got)
    items = [f"Werkbund {t} {p}" for t in ("Optik", "Akustik", "Statik") for p in ("Aldorf", "Bendheim", "Cronberg")] + [f"{g} Musterfrau{n}" for n, g in enumerate(["Anna", "Bernd"] * 9)]
    df = spark.createDataFrame([(a, 1) for a in items], "autor string, n long")
    assert N.learned_kinds(df) == {"werkbund": 9}
    p = N.Parser({"werkbund": 9})
    assert p.organisation("WO Cronberg") == ("O", "cronberg", "", "wo") and p.organisation("Werkb. Optik Cronberg") == ("O", "cronberg", "werkbund optik", "wo")
    assert p.organisation("H. E. Aldorf") is None


def test_pairs_of_a_large_entity(spark):
    spellings = ["Anna Musterfrau", "Musterfrau, Anna", "A. Musterfrau"]
    df = spark.range(4500).selectExpr("id as kopf_id", f"element_at(array({', '.join(map(repr, spellings))}), cast(id % 3 as int) + 1) as autor")
    got = N.pairs(df, "kopf_id")
    assert got.count() == got.distinct().count() == 3 * 1500 * 1500


def test_short_forms_from_surnames_of_many(spark):
    """Surnames with more than eight given names tell as well, each by its size; in one with all names nothing is told."""
    others = [f"name{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    many = [(f"s{n}", w) for n in range(40) for w in ("theodulf", "dulfi", *others[10 * n % 400 : 10 * n % 400 + 10])]
    many += [(f"u{n}", w) for n in range(30) for w in ("theodulf", *others[7 * n : 7 * n + 9])]
    df = spark.createDataFrame(many, "root string, word string")
    got = {(r.word, r.name) for r in N.short_forms(df).collect()}
    assert ("dulfi", "theodulf") in got and not any(a in others for a, _ in got)
    crowd = [(f"c{n}", w) for n in range(12) for w in ("alarich", "bodo", *others)] + [(f"d{n}", w) for n in range(9) for w in ("alarich", others[n])]
    got = {(r.word, r.name) for r in N.short_forms(spark.createDataFrame(crowd, "root string, word string")).collect()}
    assert ("bodo", "alarich") not in got
