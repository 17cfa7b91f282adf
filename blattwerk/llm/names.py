"""Spellings of persons, organisations and groups attributed to one entity each.

A noisy channel. Each distinct spelling is parsed to members of a stem (surname
or place), a full name (given name, or kind and topic of an organisation) and
initials. For every word the frequent spellings near it are candidate canonical
forms; a candidate's score is the log of the chance that its frequency gives as
many such typos, abbreviations or short forms, and the word itself competes by
the chance that it is a name of its own. The maximum of the posterior wins.
Kinds of organisation, the order of names and short forms of given names are
learned from all spellings. A group is the set of its members.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blattwerk.session import cut

#: Share of words with a typo, and the ways to misspell a letter of a word.
TYPO, VARIANTS = 0.1, 53
#: Nats of a letter in a new name, at least; the data give the rest.
LETTER = 2.0
#: Share of surnames that a second person has.
NAMESAKES = 0.3
#: A word begins organisations if it stands first in so many spellings, if such a
#: share of them has three long words, and if it begins such a share of all of
#: those. The last bounds how many kinds there are: no more than 1 / KIND_OF_ALL.
KIND_LEAST, KIND_SHARE, KIND_OF_ALL = 5, 0.8, 0.002
#: Short forms are learned from all surnames with two given names or more: how often a
#: short form stands with its full name there, beside being there by chance; what the
#: public list below counts beside the data; and the odds against two names beforehand.
TOGETHER, LISTED, UNALIKE = 0.6, 3, 1000
#: Rows of an entity, or given names of a surname, that one task pairs with the others.
PAIRED = 1000
#: Odds of "First Last" to "Last First" without a comma.
IN_ORDER = 3.0

# What stands in for a name and names nobody.
NOBODY = {
    "", "-", "--", "–", "?", "...", "admin", "administrator", "anonym", "anonymous", "anonymus", "author", "autor", "benutzer", "besitzer",
    "default", "gast", "guest", "k. a.", "k.a.", "keine angabe", "n. a.", "n.a.", "n/a", "n. n.", "n.n.", "nn", "none", "null", "o. a.", "o.a.",
    "o. v.", "o.v.", "ohne autor", "owner", "pc", "root", "scan", "scanner", "system", "test", "unbekannt", "unknown", "user", "verfasser",
    "windows user", "windows-benutzer", "windows-user", "x", "xx", "xxx", "office", "office-benutzer", "microsoft office-benutzer",
}
_NOBODY_LIKE = re.compile(r"(?:scanner|scan|admin|user|pc|benutzer|win|desktop)[-_ ]?\d+")

# Short and pet forms of given names.
NICKNAMES = {
    "bärbel": "barbara", "babsi": "barbara", "basti": "sebastian", "bastian": "sebastian", "bernd": "bernhard", "berni": "bernhard",
    "chris": "christian", "conny": "konrad", "konni": "konrad", "dieter": "dietrich", "dorle": "dorothea", "doro": "dorothea", "thea": "dorothea",
    "elli": "elisabeth", "lisa": "elisabeth", "lisbeth": "elisabeth", "sissi": "elisabeth", "ferdi": "ferdinand", "fiete": "friedrich",
    "fritz": "friedrich", "franzi": "franziska", "grete": "margarete", "gretel": "margarete", "hanna": "johanna", "hanne": "johanna",
    "hannes": "johannes", "hans": "johannes", "heiner": "heinrich", "heinz": "heinrich", "hinnerk": "heinrich", "jochen": "joachim",
    "achim": "joachim", "karo": "karoline", "line": "karoline", "kathi": "katharina", "käthe": "katharina", "katrin": "katharina",
    "leo": "leonhard", "lore": "eleonore", "nora": "eleonore", "lutz": "ludwig", "ludi": "ludwig", "matze": "matthias", "max": "maximilian",
    "michi": "michael", "michel": "michael", "rudi": "rudolf", "rolf": "rudolf", "susi": "susanne", "sanne": "susanne", "theo": "theodor",
    "tom": "thomas", "wally": "waltraud", "traudl": "waltraud", "willi": "wilhelm", "willy": "wilhelm", "wolf": "wolfgang", "wolle": "wolfgang",
    "alex": "alexander", "andi": "andreas", "sepp": "josef", "jupp": "josef", "steffi": "stefanie", "uli": "ulrich", "uwe": "uwe",
    "manni": "manfred", "gabi": "gabriele", "moni": "monika", "sabi": "sabine", "toni": "anton", "gitti": "brigitte", "hubsi": "hubert",
    "klaus": "nikolaus", "niko": "nikolaus", "jörg": "georg", "schorsch": "georg", "gustl": "august", "resi": "therese", "vroni": "veronika",
}

# Kinds of organisation known beforehand, and words that link their parts.
KINDS = ("arbeitskreis", "institut", "gesellschaft", "verein", "prüfstelle", "verband", "ausschuss", "amt", "hochschule", "universität")
PARTICLES = ("fur", "f", "in", "der", "des", "und", "zu", "er", "fr")

_ROLE = re.compile(r"(?i)[(\[]\s*(?:hrsg|hg|ed|eds|bearb|übers|red|mitarb)[^)\]]{0,8}[)\]]|\b(?:hrsg|bearb)\.")
_TITLE = re.compile(r"(?i)(?<!\w)(?:univ\.-prof|prof|dr|dipl|mag|ing|phil|habil|rer|nat|h\. ?c|med|jur|m\. ?sc|b\. ?sc)\b\.?(?:-?(?:ing|phys|math|inf|chem|kfm)\b\.?)?")
_YEARS = re.compile(r",?\s*\(?\b(?:1[5-9]|20)\d\d\s?[-–](?:\s?\d{4})?\)?")
_ET_AL = re.compile(r"(?i)(?:,?\s+et\.? al\b\.?|\s+u\. ?a\.|,?\s+und andere\b)")
_SPLIT = re.compile(r"(?i)\s*;\s*|\s+&\s+|\s+und\s+|\s+and\s+|\s+et\s+")
_UMLAUT = str.maketrans({"ä": "a", "ö": "o", "ü": "u", "ß": "s", "é": "e", "è": "e", "á": "a", "ó": "o", "ł": "l", "ø": "o", "å": "a"})


def key(name: str) -> str:
    """Letters of ``name`` in lower case; umlauts and what replaces them alike."""
    s = re.sub(r"[^\w]", "", name.lower()).translate(_UMLAUT)
    return s.replace("ae", "a").replace("oe", "o").replace("ue", "u").replace("ss", "s")


def near(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or transposition apart."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]
    return a[i:] == b[i + 1 :]


def deletions(name: str) -> list[str]:
    """``name`` and what is left of it without one letter: two names within one
    typo of each other share one."""
    return sorted({name, *(name[:i] + name[i + 1 :] for i in range(len(name)))})



def _words(text: str) -> list[str]:
    return re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", text)


def _subsequence(short: str, word: str) -> bool:
    letters = iter(word)
    return short[:1] == word[:1] and all(c in letters for c in short)


class Parser:
    """Spellings to members, with the kinds of organisation and their frequencies."""

    def __init__(self, kinds: dict[str, int]):
        self.kinds = {key(k): 0 for k in KINDS} | kinds
        self.ranked = sorted(self.kinds, key=lambda k: (-self.kinds[k], k))

    def kind(self, word: str, first: bool, others: int) -> str | None:
        """The kind of organisation that a word is, abbreviates, or misspells."""
        k = key(word)
        if k in self.kinds:
            return k
        if word.endswith(".") and len(k) > 2:
            return next((x for x in self.ranked if x.startswith(k)), None)
        if first and 1 < len(word) < 4 and word.isalpha() and word.isupper() and others > 1:
            return next((x for x in self.ranked if _subsequence(k, x)), None)
        return next((x for x in self.ranked if len(x) > 5 and near(k, x)), None) if len(k) > 4 else None

    def person(self, text: str) -> list[tuple[str, str, str, str]]:
        """Readings of a name: ``P``, surname, given name or "", initial or "".

        Two where nothing tells which end is the surname; the usual order first.
        """
        text = re.sub(r"\s+", " ", text).strip(" ,.-")
        if "," in text:
            last, _, first = text.partition(",")
            lasts = _words(last)
            return [self._named(key("".join(lasts)), re.findall(r"[^\W\d_]+", first))] if lasts else []
        words = _words(text)
        if len(words) < 2:
            return [("P", key(words[0]), "", "")] if words else []
        long = [w for w in words if len(w) > 2]
        if len(words[0]) <= 2 < len(words[-1]):
            return [self._named(key(words[-1]), words[:-1])]
        if len(words[-1]) <= 2 < len(words[0]):
            return [self._named(key(words[0]), words[1:])]
        if len(long) < 2:
            own = (long or words)[0]
            return [self._named(key(own), [w for w in words if w is not own])]
        return [self._named(key(words[-1]), words[:-1]), self._named(key(words[0]), words[1:])]

    @staticmethod
    def _named(stem: str, givens: list[str]) -> tuple[str, str, str, str]:
        full = next((k for w in givens if len(k := key(w)) > 2), "")
        return "P", stem, full, full[:1] or next((key(w)[:1] for w in givens if key(w)), "")

    def organisation(self, text: str) -> tuple[str, str, str, str] | None:
        """``O``, place, kind and topic or "", their initials."""
        text = re.sub(r"(?i),?\s*\be\.\s?v\.?", "", text).strip(" ,")
        if _TITLE.search(text):
            return None
        m = re.fullmatch(r"([A-ZÄÖÜ][A-ZÄÖÜf]{0,1}[A-ZÄÖÜ])\s+(\w[\w-]+)", text)
        if m and not m[2].isupper():  # an acronym: its first and last letters are kind and topic
            return "O", key(m[2]), "", key(m[1][0]) + key(m[1][-1])
        toks = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*\.?", text)
        rest = [w for w in toks if key(w) not in PARTICLES]
        found = next(((i, k) for i, w in enumerate(toks) if (k := self.kind(w, i == 0, len(rest) - 1))), None)
        if not found:
            return None
        at, kind = found
        words = [key(w) for i, w in enumerate(toks) if i != at and key(w) not in PARTICLES]
        if len(words) < 2:
            return None
        if at > 0:  # the place comes first, by itself or as an adjective in -er
            place, topic = words[0], words[1:]
            if "," not in text and place.endswith("er"):
                place = place[:-2]
        else:
            place, topic = words[-1], words[:-1]
        topic = "".join(topic)
        return "O", place, f"{kind} {topic}", kind[:1] + topic[:1]

    def members(self, autor: str) -> tuple[list[list[tuple[str, str, str, str]]], bool]:
        """The readings of each member of a spelling, and whether it leaves others out."""
        s = re.sub(r"\s+", " ", autor).strip()
        if s.lower() in NOBODY or _NOBODY_LIKE.fullmatch(s.lower()) or not re.search(r"[^\W\d_]{2}", s):
            return [], False
        s = _YEARS.sub("", _ROLE.sub("", s)).strip()
        bare = _ET_AL.sub("", s)
        org = self.organisation(bare)
        if org:
            return [[org]], False
        bare = _TITLE.sub("", bare)
        out = []
        for part in (p for p in _SPLIT.split(bare) if p.strip(" ,.")):
            commas = [p.strip() for p in part.split(",") if p.strip(" .")]
            # "First Last, First Last" has whole names between its commas
            whole = len(commas) > 1 and all(len(re.findall(r"[^\W\d_]+", p)) > 1 for p in commas) and not all(len(w) <= 2 for w in re.findall(r"[^\W\d_]+", commas[1]))
            for p in commas if whole else [part]:
                if (m := [x for x in self.person(p) if len(x[1]) > 1]):
                    out.append(m)
        return out, bare != s and len(out) == 1 and bool(_ET_AL.search(s))


def learned_kinds(spellings: DataFrame) -> dict[str, int]:
    """Words that organisations begin with, and how many spellings they begin. Words
    with a full stop are short for others.

    At most 1 / KIND_OF_ALL of them: each begins that share of all spellings of
    three long words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, long = [], []
            for name in batch.column(0).to_pylist():
                bare = _TITLE.sub("", _YEARS.sub("", _ROLE.sub("", name)))
                words = [w for w in _words(bare) if len(k := key(w)) > 2 and k not in PARTICLES]
                if words and "," not in bare and not _SPLIT.search(bare.strip()) and f"{words[0]}." not in bare:
                    first.append(key(words[0]))
                    long.append(int(len(words) > 2))
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.string()), pa.array(long, pa.int32())], ["first", "long"])

    by = cut(spellings.select("autor").mapInArrow(run, "first string, long int").groupBy("first").agg(F.count("*").alias("n"), F.sum("long").alias("long")))
    total = by.agg(F.coalesce(F.sum("long"), F.lit(0)).alias("x")).first()["x"]
    kept = by.where((F.col("n") >= KIND_LEAST) & (F.col("long") >= KIND_SHARE * F.col("n")) & (F.col("long") >= KIND_OF_ALL * total) & (F.length("first") > 3))
    return {r["first"]: r["long"] for r in kept.collect()}


# ---- the channel

def letter_nats(words: DataFrame, word: str) -> float:
    """Nats that a letter of a new name takes after the one before it."""
    letters = F.split(F.concat(F.lit("^"), word), "")
    two = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.struct(F.element_at(letters, i).alias("a"), F.element_at(letters, i + 1).alias("b")))).alias("x")).where(f"length({word}) > 0")
    n = two.groupBy("x.a", "x.b").agg(F.count("*").alias("n"))  # at most the square of the alphabet
    one = n.groupBy("a").agg(F.sum("n").alias("m"))
    got = n.join(one, "a").agg((F.sum(F.col("n") * F.log(F.col("m") / F.col("n"))) / F.sum("n")).alias("h")).first()["h"]
    return max(LETTER, got or 0.0)


def attributed(words: DataFrame, group: list[str], own: Column) -> DataFrame:
    """``group``, ``word``, ``target``, ``sure``: what each word is a spelling of, and the posterior of that.

    ``words`` has ``group``, ``word`` and ``n``, the number of spellings with it. Candidates are
    the words of the group with more spellings (or a higher ``rank``, if given; of
    equal ones the first) that share a deletion key: all within one edit and some within two. A candidate's score
    is the log chance that its frequency gives ``n`` times this typo; ``own`` is the log
    chance of a new name of this form, and such a name occurs n times with chance
    1 / (n (n + 1)). A key of k letters has no more words than (k + 1) times the
    alphabet, so no key is hot.
    """
    rank = "rank" if "rank" in words.columns else "n"
    w = words.select(*group, "word", "n", F.col(rank).alias("rank"), (own - F.log(F.col("n") * (F.col("n") + 1))).alias("own"))
    keyed = w.select(*group, "word", "n", "rank", F.explode(_deletions("word")).alias("k"))
    a, b = keyed.alias("a"), keyed.alias("b")
    better = (F.col("b.rank") > F.col("a.rank")) | ((F.col("b.rank") == F.col("a.rank")) & (F.col("b.word") < F.col("a.word")))
    pairs = a.join(b, [*group, "k"]).where(better & (F.col("a.word") != F.col("b.word")))
    pairs = pairs.select(*group, F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("target"), F.col("b.n").alias("m")).distinct()
    far = F.levenshtein("word", "target")
    swapped = (F.length("word") == F.length("target")) & (F.sort_array(F.split("word", "")) == F.sort_array(F.split("target", "")))
    pairs = pairs.withColumn("edits", F.when((far == 2) & swapped, 1).otherwise(far)).where("edits <= 2")
    rate = F.log(F.col("m")) + F.col("edits") * F.log(F.lit(TYPO) / (VARIANTS * F.length("target")))
    pairs = pairs.withColumn("score", F.col("n") * (rate - F.log1p(F.exp(rate))) - F.log1p(F.exp(rate)))
    best = pairs.groupBy(*group, "word").agg(F.max(F.struct("score", "m", "target")).alias("x"), F.sum(F.exp("score")).alias("all"))
    j = w.join(best, [*group, "word"], "left")
    goes = F.coalesce(F.col("x.score") > F.col("own"), F.lit(False))
    mine = F.when(goes, F.exp("x.score")).otherwise(F.exp("own"))
    sure = F.coalesce(F.try_divide(mine, F.exp("own") + F.coalesce("all", F.lit(0.0))), F.lit(1.0))
    return followed(j.select(*group, "word", F.when(goes, F.col("x.target")).otherwise(F.col("word")).alias("target"), sure.alias("sure")), group)


def followed(links: DataFrame, group: list[str]) -> DataFrame:
    """``links`` with each ``target`` one of itself. Targets ascend by frequency, so there is
    no circle; each round halves what is left of every chain."""
    out = cut(links)
    while True:
        up = out.select(*group, F.col("word").alias("target"), F.col("target").alias("next"), F.col("sure").alias("also"))
        out = cut(out.join(up, [*group, "target"]).select(*group, "word", F.col("next").alias("target"), (F.col("sure") * F.when(F.col("next") != F.col("target"), F.col("also")).otherwise(1.0)).alias("sure"), (F.col("next") != F.col("target")).alias("moved")))
        if not out.where("moved").limit(1).count():
            return out.drop("moved")
        out = out.drop("moved")


def _deletions(col: str) -> Column:
    s = F.col(col)
    cuts = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    return F.when(F.length(s) < 2, F.array(s)).otherwise(F.array_distinct(F.concat(F.array(s), cuts)))


def in_order(members: DataFrame) -> DataFrame:
    """``members`` with one reading each: surname and given name the likelier way round.

    Words count as surnames and given names by the members that have one reading
    only; a word near such a one counts a little. The public list of short forms
    counts as given names.
    """
    spark = members.sparkSession
    clear = members.where("readings = 1 and space = 'P'")
    listed = spark.createDataFrame([(key(x),) for x in sorted({*NICKNAMES, *NICKNAMES.values()})], "word string").select("word", F.lit("full").alias("role"))
    seen = clear.select(F.col("stem").alias("word"), F.lit("stem").alias("role")).unionByName(clear.select(F.col("full").alias("word"), F.lit("full").alias("role"))).unionByName(listed)
    seen = seen.where("length(word) > 2").groupBy("word", "role").agg(F.count("*").alias("n"))
    open_ = cut(members.where("readings > 1"))
    asked = open_.select(F.col("stem").alias("word"), F.lit("stem").alias("role")).unionByName(open_.select(F.col("full").alias("word"), F.lit("full").alias("role"))).distinct()
    k = F.explode(_deletions("word")).alias("k")
    hits = asked.select("word", "role", k).join(seen.select("role", F.col("word").alias("like"), "n", k), ["role", "k"]).select("word", "role", "like", "n").distinct()
    mass = hits.groupBy("word", "role").agg(F.sum(F.when(F.col("like") == F.col("word"), F.col("n")).when(F.levenshtein("word", "like") < 3, 0.02 * F.col("n")).otherwise(0.0)).alias("mass"))
    mass = asked.join(mass, ["word", "role"], "left").select("word", "role", F.log(F.coalesce("mass", F.lit(0.0)) + 0.01).alias("mass"))
    of = lambda role: mass.where(F.col("role") == role).select(F.col("word").alias(role), F.col("mass").alias(f"as_{role}"))
    o = open_.join(of("stem"), "stem").join(of("full"), "full")
    o = o.withColumn("score", F.col("as_stem") + F.col("as_full") - F.col("reading") * math.log(IN_ORDER))
    best = o.groupBy("autor", "i").agg(F.max_by("reading", F.struct("score", -F.col("reading"))).alias("reading"))
    chosen = open_.join(best, ["autor", "i", "reading"])
    return members.where("readings = 1").unionByName(chosen.select(*members.columns))


def short_forms(fulls: DataFrame) -> DataFrame:
    """``word``, ``name``, ``odds``: given names and what they are short for, with the log odds.

    ``fulls`` has ``root`` and ``word``, a row per surname and given name. A short form stands
    with its full name in the share TOGETHER of the surnames with two given names or
    more, and else by chance like any other name. The chance grows with the given
    names of the surname, so one of many persons tells little by itself. Only the more
    frequent of two names is the full one. The pairs of a surname are spread over as many
    tasks as it has thousands of given names.
    """
    spark = fulls.sparkSession
    sizes = fulls.groupBy("root").agg(F.count("*").alias("s")).where("s > 1")
    t = cut(fulls.join(sizes, "root").select("root", "word", "s"))
    size = t.groupBy("word").agg(F.count("*").alias("k"))
    places = t.count()
    # the share of all places that a name has
    name = size.select(F.col("word").alias("name"), F.col("k").alias("m"), ((F.col("k") + 1) / F.lit(places + 2.0)).alias("p"))
    here = t.withColumn("parts", F.ceil(F.col("s") / PAIRED).cast("int"))
    a = here.select("root", "word", "s", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int").alias("part"))
    b = here.select("root", F.col("word").alias("name"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(name.select("name", "p"), "name")
    chance = F.least(F.lit(0.95), 1 - F.pow(1 - F.col("p"), F.col("s")) + 0.02)
    tells = F.log((TOGETHER + (1 - TOGETHER) * chance) / chance)
    pairs = a.join(b, ["root", "part"]).where("word <> name").groupBy("word", "name").agg(F.count("*").alias("both"), F.sum(tells).alias("tells"))
    new = F.lit(math.log((TOGETHER + (1 - TOGETHER) * 0.02) / 0.02))
    listed = spark.createDataFrame([(key(a), key(b), LISTED) for a, b in NICKNAMES.items() if key(a) != key(b)], "word string, name string, both bigint")
    pairs = pairs.unionByName(listed.withColumn("tells", F.col("both") * new)).groupBy("word", "name").agg(F.sum("both").alias("both"), F.sum("tells").alias("tells"))
    known = listed.select("word", "name", F.lit(True).alias("listed"))
    j = pairs.join(known, ["word", "name"], "left").join(size, "word", "left").join(name, "name", "left").fillna(0, ["k", "m"])
    j = j.withColumn("k", F.greatest(F.col("k") + F.when(F.col("listed"), LISTED).otherwise(0), "both"))
    # without its full name: 1 - TOGETHER, and the chance is the same with both
    odds = F.col("tells") + (F.col("k") - F.col("both")) * math.log(1 - TOGETHER) - math.log(UNALIKE)
    j = j.withColumn("odds", F.when(F.col("listed"), odds + math.log(UNALIKE)).otherwise(odds))
    up = (F.col("m") > F.col("k")) | F.coalesce("listed", F.lit(False))
    return j.where((F.col("odds") > 0) & up).select("word", "name", "odds")


def settled(m: DataFrame) -> DataFrame:
    """``m`` with ``name`` and ``posterior``: the full name of each member.

    A full name is first taken for what it is a typo of among the names with its
    stem, then among all; then a short form for its full name, if that
    stands with the stem rather than another; at last initials for the name with
    the stem that has most spellings.
    """
    group = ["space", "root"]
    wide = m.where("full <> ''").select("space", F.col("full").alias("word"), F.lit(1).alias("n"))
    listed = m.sparkSession.createDataFrame([(key(x), LISTED) for x in sorted({*NICKNAMES, *NICKNAMES.values()})], "word string, n int").distinct()
    wide = cut(wide.unionByName(listed.select(F.lit("P").alias("space"), "word", "n")).groupBy("space", "word").agg(F.sum("n").alias("n")))
    sizes = wide.groupBy("space").agg(F.count("*").alias("v"))  # two rows
    nats = letter_nats(wide, "word")
    here = m.where("full <> ''").groupBy(*group, F.col("full").alias("word")).agg(F.count("*").alias("n"))
    often = here.select("space", "word", F.lit(1).alias("t")).unionByName(listed.select(F.lit("P").alias("space"), "word", F.col("n").alias("t"))).groupBy("space", "word").agg(F.sum("t").alias("t"))
    total = here.groupBy("space").agg(F.count("*").alias("total"))  # two rows
    # names that other stems have as well stand before those that only this one has
    # how likely another with this stem has this name: by its other stems, else by its letters
    here = cut(here.join(often, ["space", "word"]).join(F.broadcast(total), "space").withColumn("rank", F.when(F.col("t") > 1, F.col("t")).otherwise(0) * F.lit(1 << 32) + F.col("n")))
    own = math.log(NAMESAKES) + F.log(F.col("t") - 1 + F.exp(-nats * F.length("word"))) - F.log("total")
    m = cut(_renamed(m, attributed(here, group, own)))
    typo = attributed(wide.join(F.broadcast(sizes), "space"), ["space"], F.log("v") - nats * F.length("word"))
    m = m.join(typo.select("space", F.col("word").alias("full"), F.col("target").alias("__f"), F.col("sure").alias("__p")), ["space", "full"], "left")
    m = cut(m.withColumn("full", F.coalesce("__f", "full")).withColumn("posterior", F.col("posterior") * F.coalesce("__p", F.lit(1.0))).drop("__f", "__p"))
    given = m.where("space = 'P' and full <> ''").groupBy("root", F.col("full").alias("word")).agg(F.count("*").alias("n"))
    given = cut(given)
    short = short_forms(given).join(given.select("root", "word"), "word")
    short = short.join(given.select("root", F.col("word").alias("name"), "n"), ["root", "name"], "left")
    short = short.groupBy("root", "word").agg(F.max(F.struct((F.col("odds") + F.log(F.coalesce("n", F.lit(0.1)))).alias("score"), "odds", "name")).alias("x"))
    short = short.select(F.lit("P").alias("space"), "root", "word", F.col("x.name").alias("target"), (1 / (1 + F.exp(-F.col("x.odds")))).alias("sure"))
    m = _renamed(m, short)
    initial = F.when(F.col("space") == "P", F.substring("full", 1, 1)).otherwise(F.concat(F.substring("full", 1, 1), F.regexp_extract("full", r" (\S)", 1)))
    m = cut(m)
    counts = m.where("full <> ''").groupBy(*group, "full").agg(F.count("*").alias("fn")).withColumn("initial", initial)
    best = counts.groupBy(*group, "initial").agg(F.max_by("full", F.struct("fn", "full")).alias("likely"), (F.max("fn") / F.sum("fn")).alias("share"))
    m = m.join(best, [*group, "initial"], "left")
    guess = F.col("full") == ""
    name = F.when(guess, F.coalesce("likely", F.concat("initial", F.lit(".")))).otherwise(F.col("full"))
    return m.withColumn("name", name).withColumn("posterior", F.col("posterior") * F.when(guess, F.coalesce("share", F.lit(1.0))).otherwise(1.0))


def _renamed(m: DataFrame, table: DataFrame) -> DataFrame:
    """``m`` with its full names as ``table`` says; the posteriors are multiplied."""
    t = table.select(F.col("space").alias("__s"), F.col("root").alias("__r"), F.col("word").alias("__w"), F.col("target").alias("__f"), F.col("sure").alias("__p"))
    j = m.join(t, (F.col("space") == F.col("__s")) & (F.col("root") == F.col("__r")) & (F.col("full") == F.col("__w")), "left")
    return j.withColumn("full", F.coalesce("__f", "full")).withColumn("posterior", F.col("posterior") * F.coalesce("__p", F.lit(1.0))).drop("__s", "__r", "__w", "__f", "__p")


def entities(rows: DataFrame, row_id: str, autor: str = "autor") -> DataFrame:
    """``row_id``, ``autor``, ``entity``, ``posterior``: whom each row names, and how surely.

    Null, empty and placeholder names are left out. Equal spellings go to the
    same entity; everything is decided on distinct spellings, so a name on a
    third of all rows is one spelling, and a row that is saved again is no
    further evidence. Of equally likely names the last in order counts.
    """
    src = rows.select(F.col(f"`{row_id}`").alias("__id"), F.col(f"`{autor}`").alias("autor")).where("autor is not null")
    spellings = cut(src.groupBy("autor").agg(F.count("*").alias("n")))
    kinds = learned_kinds(spellings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(kinds)
        for batch in batches:
            out: list[list] = [[] for _ in range(11)]
            for name, n in zip(batch.column("autor").to_pylist(), batch.column("n").to_pylist()):
                members, more = parser.members(name)
                for i, readings in enumerate(members):
                    for k, (space, stem, full, initial) in enumerate(readings):
                        for col, v in zip(out, (name, n, i, len(members), more, k, len(readings), space, stem, full, initial)):
                            col.append(v)
            types = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, types)], ["autor", "n", "i", "size", "more", "reading", "readings", "space", "stem", "full", "initial"])

    schema = "autor string, n bigint, i int, size int, more boolean, reading int, readings int, space string, stem string, full string, initial string"
    members = cut(in_order(cut(spellings.mapInArrow(run, schema))))
    stems = cut(members.groupBy("space", F.col("stem").alias("word")).agg(F.count("*").alias("n")))
    sizes = stems.groupBy("space").agg(F.count("*").alias("v"))  # two rows
    roots = attributed(stems.join(F.broadcast(sizes), "space"), ["space"], F.log("v") - letter_nats(stems, "word") * F.length("word"))
    m = members.join(roots.select("space", F.col("word").alias("stem"), F.col("target").alias("root"), F.col("sure").alias("posterior")), ["space", "stem"])
    m = cut(settled(m))
    who = F.concat_ws("|", "space", "root", "name")
    whole = m.groupBy("autor", "n", "size", "more").agg(F.array_distinct(F.sort_array(F.collect_list(who))).alias("set"), F.min_by(who, "i").alias("lead"), F.exp(F.sum(F.log("posterior"))).alias("posterior"))
    whole = whole.withColumn("entity", F.array_join("set", "+"))
    # "et al." goes to the group that the one named leads, else is in, most often
    groups = whole.where(F.size("set") > 1).select("entity", "n", "lead", F.explode("set").alias("one"))
    groups = groups.groupBy("one", "entity").agg(F.sum("n").alias("n"), F.max((F.col("lead") == F.col("one")).cast("int")).alias("leads"))
    best = groups.groupBy(F.col("one").alias("lead")).agg(F.max_by("entity", F.struct("leads", "n", "entity")).alias("group"))
    more = whole.where("more").join(best, "lead", "left").select("autor", F.coalesce("group", F.concat("entity", F.lit("+..."))).alias("entity"), "posterior")
    named = whole.where("not more").select("autor", "entity", "posterior").unionByName(more)
    return src.join(named, "autor").select(F.col("__id").alias(row_id), "autor", "entity", "posterior")


def links(rows: DataFrame, row_id: str, autor: str = "autor") -> DataFrame:
    """``row_id``, ``entity``, ``canonical``, ``links``, ``posterior``: a row per named row.

    ``canonical`` is the entity's most frequent spelling, ``links`` the number
    of other rows of the entity, ``posterior`` that of the row's attribution.
    """
    e = cut(entities(rows, row_id, autor))
    spell = e.groupBy("entity", "autor").agg(F.count("*").alias("n"))
    best = spell.groupBy("entity").agg(F.max_by("autor", F.struct("n", "autor")).alias("canonical"), (F.sum("n") - 1).alias("links"))
    return e.join(best, "entity").select(row_id, "entity", "canonical", "links", "posterior")


def pairs(rows: DataFrame, row_id: str, autor: str = "autor") -> DataFrame:
    """Pairs of rows with unequal spellings of the same entity, the smaller id first.

    An entity's rows are spread over as many tasks as it has thousands of them.
    """
    e = cut(entities(rows, row_id, autor).select(row_id, "autor", "entity"))
    size = e.groupBy("entity").agg(F.ceil(F.count("*") / PAIRED).cast("int").alias("parts"), F.countDistinct("autor").alias("d")).where("d > 1").drop("d")
    e = e.join(size, "entity")
    a = e.select("entity", F.pmod(F.xxhash64(row_id), F.col("parts")).cast("int").alias("part"), F.col(row_id).alias(f"{row_id}_a"), F.col("autor").alias("x"))
    b = e.select("entity", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col(row_id).alias(f"{row_id}_b"), F.col("autor").alias("y"))
    return a.join(b, ["entity", "part"]).where((F.col(f"{row_id}_a") < F.col(f"{row_id}_b")) & (F.col("x") != F.col("y"))).select(f"{row_id}_a", f"{row_id}_b")
