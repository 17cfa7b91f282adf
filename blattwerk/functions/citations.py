"""Citations of books, chapters and standards in three styles, and BibTeX.

Column expressions over structs. A book has ``titel``, ``autoren``, ``herausgeber``
(arrays of struct ``given``, ``family``), ``verlag``, ``ort``, ``auflage``, ``jahr``,
``isbn``, ``doi``; a chapter ``titel``, ``autoren``, ``seiten``, ``doi``; a standard
``bezeichnung``, ``ausgabe``, ``titel``, ``jahr``, ``entwurf``, ``herausgeber``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from blattwerk.functions.text import normalized, strip

# Signs to escape, spellings of umlauts, words that make no key.
ESCAPED = "&%$#_{}"
SPELLED = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue"}
FILLERS = ("der", "die", "das", "des", "dem", "den", "ein", "eine", "the", "and", "und", "von", "zur", "zum", "mit", "für", "auf", "aus", "bei", "for", "with")
NO_SUBTITLE = r"(?i)^(?:Fachlicher Träger|Herausgegeben|Hrsg\.|Mit \d+ Abbildungen|With \d+ figures)"


def _blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")) == ""


def _some(people: Column) -> Column:
    return F.coalesce(F.size(people) > 0, F.lit(False))


def opt(c: Column, before: str = "", after: str = "") -> Column:
    """``c`` between fixed text, null where it is blank."""
    return F.when(~_blank(c), F.concat(F.lit(before), c, F.lit(after)))


def glue(sep: str, *parts: Column) -> Column:
    return F.concat_ws(sep, *parts)


def initials(given: Column) -> Column:
    """``Hans-Jürgen`` as ``H.-J.``, ``Yuri A.W.`` as ``Y. A. W.``"""
    words = F.filter(F.split(strip(F.coalesce(given, F.lit(""))), r"[\s.]+"), lambda w: w != "")
    one = lambda w: F.array_join(F.transform(F.filter(F.split(w, "-"), lambda h: h != ""), lambda h: F.concat(F.substring(h, 1, 1), F.lit("."))), "-")
    return F.array_join(F.transform(words, one), " ")


def people_of(author: Column) -> Column:
    """Persons of a list in text, the last word of each as the family name."""
    names = F.transform(F.split(F.coalesce(author, F.lit("")), r",\s*|\s+und\s+|\s*;\s*"), lambda n: strip(F.regexp_replace(n, r"\bet al\.?", "")))
    person = lambda n: F.struct(F.regexp_extract(n, r"^(.*) [^ ]*$", 1).alias("given"), F.regexp_extract(n, r"([^ ]*)$", 1).alias("family"))
    return F.transform(F.filter(names, lambda n: n != ""), person)


def _first_last(p: Column) -> Column:
    return strip(F.concat(initials(p["given"]), F.lit(" "), p["family"]))


def _list(names: Column, last: str, two: str | None = None) -> Column:
    n = F.size(names)
    head = F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    many = F.concat(head, F.lit(last), F.try_element_at(names, F.lit(-1)))
    return F.when(n == 0, "").when(n == 1, names[0]).when((n == 2) & F.lit(two is not None), F.array_join(names, two or "")).otherwise(many)


def people_ieee(people: Column) -> Column:
    names = F.transform(people, _first_last)
    return F.when(F.size(names) > 6, F.concat(F.get(names, F.lit(0)), F.lit(" et al."))).otherwise(_list(names, " und "))


def people_apa(people: Column) -> Column:
    one = lambda p: F.when(initials(p["given"]) != "", F.concat(p["family"], F.lit(", "), initials(p["given"]))).otherwise(p["family"])
    names = F.transform(people, one)
    many = F.concat(F.array_join(F.slice(names, 1, 19), ", "), F.lit(", … "), F.try_element_at(names, F.lit(-1)))
    return F.when(F.size(names) > 20, many).otherwise(_list(names, ", & "))


def _editors_apa(people: Column) -> Column:
    return _list(F.transform(people, _first_last), ", & ", " & ")


def _upper_last(p: Column) -> Column:
    return strip(F.concat(F.coalesce(p["given"], F.lit("")), F.lit(" "), F.upper(p["family"])))


def people_din(people: Column) -> Column:
    p = F.get(people, F.lit(0))
    first = F.when(_blank(p["given"]), F.upper(p["family"])).otherwise(F.concat(F.upper(p["family"]), F.lit(", "), p["given"]))
    rest = F.transform(F.slice(people, F.lit(2), F.greatest(F.size(people) - 1, F.lit(0))), _upper_last)
    return F.when(F.size(people) > 3, F.concat(first, F.lit(" et al."))).otherwise(_list(F.concat(F.array(first), rest), " und "))


def _editors_din(people: Column) -> Column:
    names = F.transform(people, _upper_last)
    return F.when(F.size(names) > 3, F.concat(F.get(names, F.lit(0)), F.lit(" et al."))).otherwise(_list(names, " und "))


def edition(text: Column) -> Column:
    """The number of an edition after the first, else null."""
    n = F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*(\d+)", 1), F.lit(""))
    return F.when(n.try_cast("int") > 1, n)


def first_place(place: Column) -> Column:
    """The first place of publication, without its country."""
    p = F.regexp_replace(F.split(place, r"\s*[;/]\s*")[0], r"[\[\]]", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(p, "^[ :]+|[ :]+$", ""), r",\s*(?:Germany|Deutschland|Germany\.)$", ""), F.lit(""))


def full_title(title: Column, subtitle: Column) -> Column:
    """Title and subtitle, unless the title says it or it is none."""
    add = ~_blank(subtitle) & ~F.contains(F.lower(title), F.lower(subtitle)) & ~subtitle.rlike(NO_SUBTITLE)
    return F.when(~_blank(title) & F.coalesce(add, F.lit(False)), F.concat(title, F.lit(": "), subtitle)).otherwise(F.nullif(title, F.lit("")))


def without_html(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), r"\s+", " "))


def _imprint(d: Column) -> Column:
    return F.nullif(glue(": ", opt(d["ort"]), opt(d["verlag"])), F.lit(""))


def _pages(p: Column) -> Column:
    return F.replace(p, F.lit("-"), F.lit("–"))


def _star(c: Column) -> Column:
    return F.concat(F.lit("*"), c, F.lit("*"))


def _year(d: Column) -> Column:
    return F.when(_blank(d["jahr"]), F.lit("o. J.")).otherwise(d["jahr"])


def book(d: Column, style: str = "ieee") -> Column:
    """The citation of a book."""
    nr = edition(d["auflage"])
    if style == "apa":
        t = F.concat(_star(d["titel"]), F.coalesce(opt(nr, " (", ". Aufl.)"), F.lit("")))
        y = F.concat(F.lit("("), _year(d), F.lit(")"))
        head = (
            F.when(_some(d["autoren"]), F.concat(people_apa(d["autoren"]), F.lit(" "), y, F.lit(". "), t, F.lit(".")))
            .when(_some(d["herausgeber"]), F.concat(people_apa(d["herausgeber"]), F.lit(" (Hrsg.). "), y, F.lit(". "), t, F.lit(".")))
            .otherwise(F.concat(t, F.lit(". "), y, F.lit(".")))
        )
        return F.concat(head, F.coalesce(opt(d["verlag"], " ", "."), F.lit("")), F.coalesce(opt(d["doi"], " https://doi.org/"), F.lit("")))
    if style == "din":
        t = _star(d["titel"])
        who = F.when(_some(d["autoren"]), people_din(d["autoren"])).when(_some(d["herausgeber"]), F.concat(people_din(d["herausgeber"]), F.lit(", Hrsg.")))
        head = F.when(who.isNotNull(), F.concat(who, F.lit(", "), _year(d), F.lit(". "), t, F.lit("."))).otherwise(F.concat(t, F.lit(", "), _year(d), F.lit(".")))
        return glue(" ", head, opt(nr, "", ". Aufl."), opt(_imprint(d), "", "."), opt(d["isbn"], "ISBN ", "."), opt(d["doi"], "DOI: "))
    who = F.when(_some(d["autoren"]), F.concat(people_ieee(d["autoren"]), F.lit(", "))).when(_some(d["herausgeber"]), F.concat(people_ieee(d["herausgeber"]), F.lit(", Hrsg., ")))
    head = F.concat(F.coalesce(who, F.lit("")), _star(d["titel"]), F.coalesce(opt(nr, ", ", ". Aufl."), F.lit(".")))
    tail = F.concat(glue(", ", _imprint(d), opt(d["jahr"])), F.coalesce(opt(d["doi"], ", doi: "), F.lit("")))
    return F.concat(head, F.when(tail != "", F.concat(F.lit(" "), tail, F.lit("."))).otherwise(""))


def chapter(k: Column, b: Column, style: str = "ieee") -> Column:
    """The citation of a chapter ``k`` of the book ``b``."""
    nr = edition(b["auflage"])
    editors = lambda f, after: F.coalesce(F.when(_some(b["herausgeber"]), F.concat(f(b["herausgeber"]), F.lit(after))), F.lit(""))
    if style == "apa":
        extra = glue(", ", opt(nr, "", ". Aufl."), opt(_pages(k["seiten"]), "S. "))
        t = F.concat(_star(b["titel"]), F.when(extra != "", F.concat(F.lit(" ("), extra, F.lit(")"))).otherwise(""))
        head = F.concat(people_apa(k["autoren"]), F.lit(" ("), _year(b), F.lit("). "), k["titel"], F.lit(". In "), editors(_editors_apa, " (Hrsg.), "), t, F.lit("."))
        return F.concat(head, F.coalesce(opt(b["verlag"], " ", "."), F.lit("")), F.coalesce(opt(k["doi"], " https://doi.org/"), F.lit("")))
    if style == "din":
        place = glue(", ", _imprint(b), opt(_pages(k["seiten"]), "S. "))
        head = F.concat(people_din(k["autoren"]), F.lit(", "), _year(b), F.lit(". "), k["titel"], F.lit(". In: "), editors(_editors_din, ", Hrsg. "), _star(b["titel"]), F.lit("."))
        return glue(" ", head, opt(nr, "", ". Aufl."), opt(F.nullif(place, F.lit("")), "", "."), opt(k["doi"], "DOI: "))
    head = F.concat(people_ieee(k["autoren"]), F.lit(", „"), k["titel"], F.lit("“, in "), _star(b["titel"]))
    parts = glue(", ", head, opt(nr, "", ". Aufl."), F.when(_some(b["herausgeber"]), F.concat(people_ieee(b["herausgeber"]), F.lit(", Hrsg"))))
    tail = glue(", ", _imprint(b), opt(b["jahr"]))
    return F.concat(parts, F.lit(". "), tail, F.coalesce(opt(_pages(k["seiten"]), ", S. "), F.lit("")), F.coalesce(opt(k["doi"], ", doi: "), F.lit("")), F.lit("."))


def _issuer(n: Column) -> Column:
    return F.coalesce(F.nullif(n["herausgeber"], F.lit("")), F.split(F.regexp_replace(n["bezeichnung"], r"^E\s+", ""), r"\s+")[0])


def standard(n: Column, style: str = "ieee") -> Column:
    """The citation of a standard."""
    draft = F.coalesce(n["entwurf"], F.lit(False))
    number = F.concat(n["bezeichnung"], F.lit(":"), n["ausgabe"])
    if style == "apa":
        number = F.concat(number, F.when(draft, ", Entwurf").otherwise(""))
        head = F.concat(_issuer(n), F.lit(". ("), n["jahr"], F.lit("). "))
        return F.concat(head, F.when(_blank(n["titel"]), F.concat(_star(number), F.lit("."))).otherwise(F.concat(_star(n["titel"]), F.lit(" ("), number, F.lit(")."))))
    number = F.concat(number, F.when(draft, " (Entwurf)").otherwise(""))
    if style == "din":
        return F.concat(number, F.lit(", "), n["jahr"], F.lit("."), F.coalesce(opt(n["titel"], " *", "*."), F.lit("")))
    return F.concat(F.coalesce(opt(n["titel"], "*", "*, "), F.lit("")), number, F.lit(", "), n["jahr"], F.lit("."))


def is_collection(d: Column) -> Column:
    return F.coalesce(d["typ"].isin("edited-book", "reference-book"), F.lit(False)) | (_some(d["herausgeber"]) & ~_some(d["autoren"]))


def escaped(text: Column) -> Column:
    """``text`` with the signs escaped that BibTeX reads."""
    return F.regexp_replace(text, r"([&%$#_{}])", r"\\$1")


def key_part(text: Column) -> Column:
    t = normalized(text, "NFC")
    for a, b in SPELLED.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(F.lower(normalized(t, "NFKD")), r"[^a-z0-9-]", "")


def bibtex_key(people: Column, year: Column, title: Column) -> Column:
    """Family name, year and first telling word of the title."""
    words = F.filter(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(r"(\p{L}+)"), 1), lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(*FILLERS))
    name = F.when(_some(people), key_part(F.get(people, F.lit(0))["family"])).otherwise("")
    k = F.concat(name, F.coalesce(year, F.lit("")), F.coalesce(key_part(F.get(words, F.lit(0))), F.lit("")))
    return F.when(k == "", "eintrag").otherwise(k)


def _entry(kind: str, key: Column, fields: list[tuple[str, Column]]) -> Column:
    return F.concat(F.lit("@" + kind + "{"), key, F.lit(", "), glue(", ", *[opt(v, f"{k} = {{", "}") for k, v in fields]), F.lit("}"))


def _people_bib(people: Column) -> Column:
    one = lambda p: escaped(F.when(_blank(p["given"]), p["family"]).otherwise(F.concat(p["family"], F.lit(", "), p["given"])))
    return F.when(_some(people), F.array_join(F.transform(people, one), " and "))


def bibtex_book(d: Column) -> Column:
    people = F.when(_some(d["autoren"]), d["autoren"]).otherwise(d["herausgeber"])
    fields = [
        ("author", _people_bib(d["autoren"])), ("editor", _people_bib(d["herausgeber"])), ("title", opt(escaped(d["titel"]), "{", "}")),
        ("edition", edition(d["auflage"])), ("publisher", escaped(d["verlag"])), ("address", escaped(d["ort"])), ("year", d["jahr"]), ("isbn", d["isbn"]), ("doi", d["doi"]),
    ]
    return _entry("book", bibtex_key(people, d["jahr"], d["titel"]), fields)


def bibtex_standard(n: Column) -> Column:
    number = F.regexp_extract(n["bezeichnung"], r"\d+(?:-\d+)*", 0)
    key = F.concat(key_part(_issuer(n)), number, F.lit("_"), n["jahr"])
    fields = [
        ("title", opt(escaped(n["titel"]), "{", "}")), ("number", escaped(F.concat(n["bezeichnung"], F.lit(":"), n["ausgabe"]))),
        ("organization", escaped(_issuer(n))), ("year", n["jahr"]), ("note", F.when(F.coalesce(n["entwurf"], F.lit(False)), "Entwurf")),
    ]
    return _entry("standard", key, fields)


def merged_record(crossref: Column, dnb: Column) -> Column:
    """One record of two lookups: place, publisher and edition prefer the second."""
    both = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))
    people = lambda f: F.when(_some(crossref[f]), crossref[f]).otherwise(dnb[f])
    names = [F.when(crossref.isNotNull(), "Crossref"), F.when(dnb.isNotNull(), "DNB")]
    fields = [both(crossref[f], dnb[f]).alias(f) for f in ("titel", "jahr", "isbn", "doi")] + [both(dnb[f], crossref[f]).alias(f) for f in ("verlag", "ort", "auflage")]
    return F.when(crossref.isNotNull() | dnb.isNotNull(), F.struct(*fields, people("autoren").alias("autoren"), people("herausgeber").alias("herausgeber"), F.concat_ws(" + ", *names).alias("quelle")))
