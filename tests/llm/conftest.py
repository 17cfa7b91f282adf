import random

import pytest

WORDS = {
    "de": "die Welle überträgt das Drehmoment über eine Passfeder und läuft nach kurzer Zeit warm deshalb muss der Prüfer größere Kräfte vermeiden Schmierung genügt für lange Führungen".split(),
    "en": "the shaft transmits torque through a feather key and runs warm after short time therefore the tester should avoid larger forces lubrication is enough for long guides".split(),
    "fr": "l'arbre transmet le couple par une clavette et chauffe après peu de temps donc le contrôleur évite des efforts élevés la lubrification suffit pour des guidages très longs".split(),
}


def prose(lang, n, rng):
    out = []
    for _ in range(n):
        s = rng.choices(WORDS[lang], k=rng.randint(8, 14))
        out.append(" ".join(s).capitalize() + ".")
    return " ".join(out)


@pytest.fixture(scope="session")
def corpus():
    """Labelled documents: id, text, language."""
    rng = random.Random(3)
    return [(i, "\n\n".join(prose(k, 4, rng) for _ in range(5)), k) for i in range(90) for k in [("de", "en", "fr")[i % 3]]]


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string, lang string")
