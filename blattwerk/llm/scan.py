"""Scanned pages to running text: page marks off, divided words joined, characters
corrected by a noisy channel.

Lines are laid out in blocks of PAGES pages with a look at the pages before and
after, so neighbours are in one task without a book ever being one. Running
titles and page numbers are known by their book: the numbers that fit its
count, and the titles that recur at its page edges. Words are judged by a
lexicon of all documents and lines. Recognition confuses shapes that are made
of the same strokes, so a word and its misreadings have the same stroke code;
the trusted words of that code are the candidates, and Viterbi over the
candidates of a line weighs the chance of each confusion, learned from all lines,
against the likelihood of word pairs.
"""

from __future__ import annotations

import math
import re
import warnings
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby, pairwise, product

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blattwerk.llm import encoding
from blattwerk.llm.unify import fold
from blattwerk.session import cut, salted_left_join

#: Pages to a block.
PAGES = 16
#: A text of the corpus without noise counts so many times as much as a line.
CLEAN_WEIGHT = 20
#: A word is trusted from this evidence on, if no word with the same strokes
#: explains it as a misreading. A word of the clean texts is explained by one
#: that is 1/SHARE times as frequent and one edit away, and with each further
#: edit ten times that. A word of lines only is explained by as many misreadings
#: of a word as FEW and the share MISREAD of its lines, by the number of edits.
LEAST, SHARE, FEW, MISREAD = 3, 0.02, 3, (0.02, 0.008, 0.003)
#: Trusted words, and word pairs, from which on a warning tells that the lexicon, which
#: goes to every task as a whole, is larger than it was measured with.
TIER, PAIRS = 262_144, 262_144
#: Distinct words held by a counting task before it hands them on.
FLUSH = 400_000
#: Nats of a confusion before any is counted, of one never counted, and of a word
#: that nobody knows; edits between a word and its misreading, as a share of its
#: letters; and rounds of learning.
CONFUSED, UNSEEN, UNKNOWN = 2.3, 9.0, 16.0
EDITS, EDITS_SHORT, ROUNDS = 0.6, 0.5, 2
#: Weight of the pair in the language model.
PAIR_WEIGHT = 0.7

MARKS = "\xac\xad￾"
HYPHENS = "-‐‑"
# Words after which a hyphen stands for a part left out.
COORDINATION = {"und", "oder", "bzw", "sowie", "bis", "u", "and", "or", "et", "ou", "e", "y", "o", "en", "of", "i", "lub"}
#: Signs that recognition drops into a word, or puts in a letter's place.
DROPPED = "*'°|·;~^`"
REPLACED = "■€§%#$@&¢£¥"
_OUTER = ".,;:!?()[]{}\"„“”«»…‚‘’"
# Characters by the strokes they are made of.
STROKES = {
    **dict.fromkeys("iltfsrjIíìîï1!ſłŀ", "|"), **dict.fromkeys("nuhüùúûñńµ", "||"), "m": "|||", "w": "vv", "v": "v", "y": "v|",
    **dict.fromkeys("aoecäöàáâèéêëòóôçćąęø0œæ", "o"), "d": "o|", **dict.fromkeys("gq9", "g"), **dict.fromkeys("bß68", "b"), "5": "|",
    **dict.fromkeys(DROPPED + ",.:_\"", ""),
}
_ATOMS = ["|", "||", "|||", "o", "o|", "g", "b", "vv", "v", "k", "p", "z", "x", "-", ""]
_TABLE = str.maketrans({c: s for c, s in STROKES.items()})
_LETTER = re.compile(r"[^\W\d_]")
_NO_MARKS = dict.fromkeys(map(ord, MARKS))
_CODE = re.compile(r"[A-Z]{1,4}[-–]?\d[\d.,:/-]*|\d+(?:[.,:/]\d+)*[A-Za-z]{0,2}")
# numbers and codes with letters in the place of digits
_NUMBER_LIKE = re.compile(r"(?=.*\d)(?=.*[lIOo])[\dlIOo.,·]{2,}|(?=.*\d)(?=.*[lIOoBS])[\dlIOoBS]+[.,][\dlIOoBS]+|[A-Z]{1,3}-(?=\S*\d)(?=\S*[lIOoBS])[\dlIOoBS]{2,}")
_INNER_DIGIT = re.compile(r"[^\W\d_]\d+[^\W\d_]")


def strokes(word: str) -> str:
    """The stroke code of a word: what recognition takes for it has the same."""
    return word.lower().translate(_TABLE)


def cores(text: str) -> list[str]:
    """The words of a text without the punctuation around them."""
    return [c for t in text.split() if (c := t.strip(_OUTER))]


def counted(core: str) -> bool:
    """Whether the lexicon counts the word: it has letters and isn't a code."""
    return bool(_LETTER.search(core)) and not _CODE.fullmatch(core) and len(core) <= 64


def lexicon_counts(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words (``word``, ``code``, ``n_doc``, ``n_line``) and pairs (``a``, ``b``, ``n``).

    ``texts`` has ``text`` and ``clean``, whether it is free of scanning noise.
    Each task counts its rows first. The last word of a line with a mark of
    division is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            raw: tuple[dict[str, int], dict[str, int]] = ({}, {})
            for own, pairs_ in zip(raw, two):
                for (_, y), n in pairs_.items():
                    own[y] = own.get(y, 0) + n
            # punctuation is taken off the distinct words only
            core = {t: c for t in raw[0].keys() | raw[1].keys() if (c := t.strip(_OUTER)) and counted(c)}
            core = {t: c.lower() for t, c in core.items()}
            words = (Counter(), Counter())
            for count, own in zip(words, raw):
                for t, n in own.items():
                    if t in core:
                        count[core[t]] += n
            pairs: Counter = Counter()
            for pairs_ in two:
                for (x, y), n in pairs_.items():
                    if x in core and y in core:
                        pairs[core[x], core[y]] += n
            keys = list(words[0].keys() | words[1].keys())
            both = list(pairs)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([*keys, *(p[0] for p in both)], pa.string()),
                    pa.array([*[None] * len(keys), *(p[1] for p in both)], pa.string()),
                    pa.array([*map(strokes, keys), *[None] * len(both)], pa.string()),
                    pa.array([*(words[1][k] for k in keys), *[0] * len(both)], pa.int64()),
                    pa.array([*(words[0][k] for k in keys), *(pairs[p] for p in both)], pa.int64()),
                ],
                ["a", "b", "code", "n_doc", "n_line"],
            )
            two[0].clear(), two[1].clear()
            return out

        def read(texts: list[str], clean: bool) -> Iterator[Iterator[tuple[str, str]]]:
            for text in texts:
                text = fold(text)
                if not clean and text[-1:] in MARKS + HYPHENS:
                    text = text.rpartition(" ")[0]
                # every word is the second of a pair, the first one after a sign that is no word
                yield pairwise(f". {text}".split())

        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for clean, count in enumerate(two):
                count.update(chain.from_iterable(read([t for t, c in rows if c == clean], bool(clean))))
            if len(two[0]) + len(two[1]) > FLUSH:
                yield flush()
        yield flush()

    parts = texts.where("text is not null and text <> ''").select("text", "clean").mapInArrow(run, "a string, b string, code string, n_doc bigint, n_line bigint")
    both = cut(parts.groupBy("a", "b", "code").agg(F.sum("n_doc").alias("n_doc"), F.sum("n_line").alias("n_line")).where("b is null or n_line > 1"))
    return both.where("b is null").select(F.col("a").alias("word"), "code", "n_doc", "n_line"), both.where("b is not null").select("a", "b", F.col("n_line").alias("n"))


def trusted_words(words: DataFrame) -> DataFrame:
    """``word``, ``code``, ``evidence`` of the words that are no misreadings."""
    w = words.withColumn("evidence", F.col("n_doc") * CLEAN_WEIGHT + F.col("n_line")).where(F.col("evidence") >= LEAST)
    a, b = w.alias("a"), w.select("word", "code", "evidence", "n_line").alias("b")
    # words that share a code are few, and only the more frequent ones join
    rival = a.join(b, F.expr("a.code = b.code and b.evidence > a.evidence and a.word <> b.word"))
    edits = F.levenshtein("a.word", "b.word")
    misread = F.element_at(F.array(*map(F.lit, MISREAD)), F.greatest(F.lit(1), F.least(edits, F.lit(len(MISREAD)))))
    clean = F.col("a.evidence") < F.col("b.evidence") * SHARE * F.pow(F.lit(0.1), edits - 1)
    dirty = F.col("a.n_line") < FEW + F.col("b.n_line") * misread
    beaten = rival.where(F.when(F.col("a.n_doc") > 0, clean).otherwise(dirty)).select(F.col("a.word").alias("word")).distinct()
    return w.join(beaten, "word", "left_anti").select("word", "code", "evidence", "n_line")


def learned_channel(words: DataFrame, trusted: DataFrame) -> dict[tuple[str, str], float]:
    """Nats of each confusion: what was read (first) for what stands there.

    Every word that isn't trusted is aligned with the trusted words of the same
    strokes. In ROUNDS of expectation and maximisation it is shared among them by
    their evidence and the chance of the misreading, and a confusion's chance is
    its count over the occurrences of what stands there in lines. A pair of
    letters for one, or one for a pair, counts as a confusion of its own.
    """
    doubted = words.where("n_line > 0").join(trusted.select("word"), "word", "left_anti").select(F.col("word").alias("seen"), "code", F.col("n_line").alias("n"))
    pairs = doubted.join(trusted.select("code", "word", "evidence"), "code")
    near = F.least(F.lit(0.0) + EDITS * F.length("seen"), F.lit(4.0))
    pairs = pairs.where(F.levenshtein("seen", "word") <= F.greatest(near, F.lit(1.0))).groupBy("seen", "n").agg(F.collect_list(F.struct("word", "evidence")).alias("of"))
    pairs = cut(pairs)  # a row per misreading with the words of its strokes
    pieces = F.flatten(F.array(F.split("word", ""), F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))))
    stand = trusted.where("length(word) > 1 and n_line > 0").select("n_line", F.explode(pieces).alias("true")).groupBy("true").agg(F.sum("n_line").alias("stand"))
    stand = cut(stand.unionByName(trusted.agg(F.lit("").alias("true"), F.coalesce(F.sum(F.col("n_line") * F.length("word")), F.lit(0)).alias("stand"))))
    learned: dict[tuple[str, str], float] = {}
    for _ in range(ROUNDS):
        known = dict(learned)

        def run(batches: Iterator[pa.RecordBatch], known: dict = known) -> Iterator[pa.RecordBatch]:
            count: Counter = Counter()
            for batch in batches:
                for seen, n, of in zip(batch.column("seen").to_pylist(), batch.column("n").to_pylist(), batch.column("of").to_pylist()):
                    ways = [(aligned(seen, x["word"], known), x["evidence"]) for x in of]
                    chances = [e * math.exp(-cost) for (cost, _), e in ways]
                    total = sum(chances)
                    for ((_, edits), _), c in zip(ways, chances):
                        for edit in edits:
                            count[edit] += n * c / total if total else 0.0
            both = list(count)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in both], pa.string()), pa.array([b for _, b in both], pa.string()), pa.array([count[x] for x in both], pa.float64())], ["read", "true", "n"])

        counts = pairs.mapInArrow(run, "read string, true string, n double").groupBy("read", "true").agg(F.sum("n").alias("n")).join(F.broadcast(stand), "true")
        rows = counts.where("n > 0").collect()
        learned = {(r["read"], r["true"]): min(UNSEEN, max(0.05, -math.log(r["n"] / max(r["n"], r["stand"])))) for r in rows}
    return learned


@dataclass
class Lexicon:
    """The trusted words, and the pairs counted more than once: a pair seen once is that of
    the line in question, which would speak for itself."""

    words: dict[str, int]
    pairs: dict[tuple[str, str], int]
    channel: dict[tuple[str, str], float]

    def __post_init__(self) -> None:
        self.total = sum(self.words.values()) + 1
        self.follow: Counter = Counter()
        for (a, _), n in self.pairs.items():
            self.follow[a] += n
        self.by_code: dict[str, list[str]] = {}
        for w in self.words:
            self.by_code.setdefault(strokes(w), []).append(w)
        self.memo: dict[str, list[tuple[str, float]]] = {}

    def candidates(self, word: str) -> list[tuple[str, float]]:
        """Trusted words that ``word`` may be a misreading of, with their costs."""
        if word in self.memo:
            return self.memo[word]
        at = [i for i, c in enumerate(word) if c in REPLACED]
        pieces = [strokes(word[i + 1 : j]) for i, j in zip([-1, *at], [*at, len(word)])]
        if len(at) <= 2:
            codes = ("".join(x for both in zip(pieces, (*fill, "")) for x in both) for fill in product(_ATOMS, repeat=len(at)))
            found = {w for code in codes for w in self.by_code.get(code, ())}
        else:  # too many fillings to try: the codes that one of them gives
            any_atom = "(?:" + "|".join(map(re.escape, _ATOMS)) + ")"
            pattern = re.compile(any_atom.join(map(re.escape, pieces)))
            found = {w for code, own in self.by_code.items() if pattern.fullmatch(code) for w in own}
        most = max(1, (EDITS if len(word) > 4 else EDITS_SHORT) * len(word))
        ways = [(w, *aligned(word, w, self.channel)) for w in found if abs(len(w) - len(word)) <= 2 * most]
        out = sorted(((w, cost) for w, cost, edits in ways if len(edits) <= most), key=lambda x: (x[1], x[0]))
        if len(self.memo) > 200_000:
            self.memo.clear()
        self.memo[word] = out
        return out

    def cost(self, before: str | None, word: str) -> float:
        """Nats of a word after another: the pair's share of the pairs that begin so, and
        the word's share of all words."""
        single = (self.words.get(word, 0) + 0.01) / self.total
        if before is None or not (m := self.follow.get(before)):
            return -math.log(single)
        return -math.log(PAIR_WEIGHT * self.pairs.get((before, word), 0) / m + (1 - PAIR_WEIGHT) * single)

    def decode(self, words: list[str], free: list[bool]) -> list[str]:
        """The likeliest words behind ``words``; only those ``free`` may change."""
        layers = [([(w, 0.0)] if w in self.words else [(w, UNKNOWN)]) + (self.candidates(w) if f else []) for w, f in zip(words, free)]
        score: dict[str, float] = {}
        back: list[dict[str, str | None]] = []
        for layer in layers:
            new, come = {}, {}
            for w, c in layer:
                if score:
                    total, p = math.inf, None
                    for q, s in score.items():
                        if (t := s + self.cost(q, w)) < total:
                            total, p = t, q
                    total += c
                else:
                    p, total = None, self.cost(None, w) + c
                if w not in new or total < new[w]:
                    new[w], come[w] = total, p
            score, back = new, [*back, come]
        out: list[str] = []
        w: str | None = min(score, key=score.get) if score else None
        for come in reversed(back):
            out.append(w)
            w = come[w]
        return out[::-1]


def aligned(seen: str, word: str, channel: dict[tuple[str, str], float]) -> tuple[float, list[tuple[str, str]]]:
    """The least nats of reading ``seen`` for ``word``, and the confusions that make them.

    A confusion is one letter for another, too many or lost, or a letter for the
    two that have its strokes, and the other way round. An empty channel charges
    CONFUSED for each.
    """
    unseen = UNSEEN if channel else CONFUSED
    get, stroke = channel.get, STROKES.get
    # what depends on one letter is looked up once, not for every pair of letters
    add = [get(("", y), unseen) for y in word]
    ones: dict[str, list[int]] = {}
    twos: dict[str, list[int]] = {}
    for j, y in enumerate(word, 1):
        ones.setdefault(stroke(y, "!"), []).append(j)
        if j > 1:
            twos.setdefault(stroke(word[j - 2], "?") + stroke(y, "?"), []).append(j)
    swaps: dict[str, list[float]] = {}
    last = [0.0]
    for c in add:
        last.append(last[-1] + c)
    from_: list[list[tuple[int, int] | None]] = [[None, *[(0, 1)] * len(word)]]
    before: list[float] = []
    for i, x in enumerate(seen, 1):
        drop = get((x, ""), unseen)
        if x not in swaps:
            swaps[x] = [0.0 if x == y else get((x, y), unseen) for y in word]
        for_two = ones.get(stroke(seen[i - 2], "?") + stroke(x, "?"), ()) if i > 1 else ()
        for_one = twos.get(stroke(x, "!"), ())
        left = last[0] + drop
        row, come = [left], [(1, 0)]
        for j, (swap, more, over, up) in enumerate(zip(swaps[x], add, last, last[1:]), 1):
            cost, step = over + swap, (1, 1)
            if (c := up + drop) < cost:
                cost, step = c, (1, 0)
            if (c := left + more) < cost:
                cost, step = c, (0, 1)
            if for_two and j in for_two and (c := before[j - 1] + get((seen[i - 2 : i], word[j - 1]), unseen)) < cost:
                cost, step = c, (2, 1)
            if for_one and j in for_one and (c := last[j - 2] + get((x, word[j - 2 : j]), unseen)) < cost:
                cost, step = c, (1, 2)
            left = cost
            row.append(cost)
            come.append(step)
        before, last = last, row
        from_.append(come)
    i, j, edits = len(seen), len(word), []
    while i or j:
        di, dj = from_[i][j]
        if (a := seen[i - di : i]) != (b := word[j - dj : j]):
            edits.append((a, b))
        i, j = i - di, j - dj
    return last[-1], edits


# ---- what belongs to the page

_ROMAN = re.compile(r"(?i)m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_EDGE = re.compile(r"^[\W_]*(?:(seite|page|pagina|página|strona|s\.|p\.)\s*)?([\dlIOo]{1,4}|[ivxlc]{1,7})?(?:\s*(?:/|von|of)\s*([\dlIO]{1,4}))?[\W_]*$", re.I)
_FRONT = re.compile(r"^[\W_]*([\dlIO]{1,4}|[ivxlc]{1,6})(?=[\s|.–-])(?![.,]\d)")
_BACK = re.compile(r"(?<=[\s|–-])([\dlIO]{1,4}|[ivxlc]{1,6})[\W_]*$")
_DIGITS = str.maketrans("lIOoBS", "110085")


def page_number(raw: str) -> int | None:
    """The number that ``raw`` is, misread digits or a Roman numeral too.

    Roman numerals count from -1000 on, as a count of their own.
    """
    if not raw:
        return None
    s = raw.translate(_DIGITS)
    low = raw.lower()
    if s.isdigit() and (any(c.isdigit() for c in raw) or raw in ("l", "I") or "O" in raw or not _ROMAN.fullmatch(low)):
        return int(s)
    if _ROMAN.fullmatch(low):
        value = dict(i=1, v=5, x=10, l=50, c=100, d=500, m=1000)
        n = [value[c] for c in low]
        return -1000 + sum(-a if b > a else a for a, b in zip(n, [*n[1:], 0]))
    return None


def edge_features(text: str) -> tuple[str, list[int], bool, bool]:
    """Stroke code of the words, page numbers at the ends, whether it is only a
    number, and whether words follow a number."""
    s = fold(text).strip().replace("ß", "ss")
    m = _EDGE.match(s)
    if m and m[2] and (n := page_number(m[2])) is not None:
        return "", [n], True, False
    front, back = _FRONT.match(s), _BACK.search(s)
    nums = [n for f in (front, back) if f and (n := page_number(f[1])) is not None]
    if front and page_number(front[1]) is not None:
        s = s[front.end() :]
    back = _BACK.search(s)
    if back and page_number(back[1]) is not None:
        s = s[: back.start()]
    led = front is not None and page_number(front[1]) is not None and len(_LETTER.findall(s)) > 3
    return strokes("".join(re.findall(r"[\w" + re.escape(REPLACED) + "]", s))), nums, False, led


# Words that numbered parts of the text begin with.
PARTS = r"(?iU)^\W*(?:aufgabe|beispiel|übung|abb|abbildung|bild|tab|tabelle|lösung|gleichung|figure|table|example|exercise|problem|exercice|exemple|tableau)\b"
#: Lines from the top and from the bottom of a page that may belong to it, and
#: the characters that such a line has at most.
TOP, BOTTOM, LONGEST = 3, 2, 90
SMALL, LARGE, BOLD = 0.95, 1.04, 0.9


def page_marks(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """``zeile_id``, ``buch_id``, ``seite`` of running titles and page numbers.

    ``titles`` has ``buch_id`` and ``titel``; books without are fine.
    """
    cols = ["zeile_id", "buch_id", "seite", "pos", "text", "groesse", "fett"]
    src = lines.select(*cols).where("text is not null")
    pages = src.groupBy("buch_id", "seite").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    body = src.where("groesse is not null").groupBy("buch_id", "seite", "groesse").agg(F.sum(F.length("text")).alias("n"))
    body = body.groupBy("buch_id", "seite").agg(F.max_by("groesse", F.struct("n", "groesse")).alias("body"))
    pages = pages.join(body, ["buch_id", "seite"], "left")
    near = src.where(F.length("text") <= LONGEST).join(pages, ["buch_id", "seite"])
    near = near.withColumn("top", F.col("pos") < F.col("first") + TOP).where(F.col("top") | (F.col("pos") > F.col("last") - BOTTOM))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [edge_features(t) for t in batch.column("text").to_pylist()]
            extra = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.list_(pa.int32()), pa.bool_(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "code", "nums", "bare", "led"])

    schema = ", ".join(f"`{c}` {t}" for c, t in near.dtypes) + ", code string, nums array<int>, bare boolean, led boolean"
    edges = cut(near.mapInArrow(run, schema))
    heavy = (F.col("fett") >= BOLD) | (F.col("groesse") > F.col("body") * LARGE)
    tiny = F.col("groesse") < F.col("body") * SMALL
    counts = edges.groupBy("buch_id").agg(F.countDistinct("seite").alias("pages"))
    # a row per book joins the edge lines, salted by page for books of many pages
    e = salted_left_join(edges, counts, ["buch_id"], 16, F.col("seite"))
    e = e.withColumn("heavy", F.coalesce(heavy, F.lit(False))).withColumn("tiny", F.coalesce(tiny, F.lit(False)))
    shift = e.select("buch_id", "seite", "zeile_id", "heavy", "bare", "tiny", F.explode("nums").alias("n")).withColumn("d", F.col("n") - F.col("seite"))
    fits = shift.where("not heavy").groupBy("buch_id", "d").agg(F.countDistinct("seite").alias("k"))
    fits = fits.where("k >= 2").select("buch_id", "d", "k")
    # offsets and titles that recur are few beside the lines; pages spread a hot book
    strong = salted_left_join(shift, fits, ["buch_id", "d"], 8, F.col("seite")).where("k is not null").groupBy("zeile_id").agg(F.max("k").alias("fit"))
    title = titles.where("titel is not null").select("buch_id", "titel").distinct()

    def title_code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([edge_features(t)[0] for t in batch.column(1).to_pylist()], pa.string())], ["buch_id", "code"])

    named = title.mapInArrow(title_code, f"buch_id {dict(titles.dtypes)['buch_id']}, code string").distinct().withColumn("named", F.lit(True))
    e = e.join(strong, "zeile_id", "left")
    recur = e.where("not bare and code <> ''").groupBy("buch_id", "code", "top").agg(
        F.countDistinct("seite").alias("k"), F.sum(F.col("tiny").cast("int")).alias("tinies"), F.count("fit").alias("fits")
    )
    recur = recur.where("k > 1 or tinies > 0 or fits > 1")
    e = salted_left_join(salted_left_join(e, recur, ["buch_id", "code", "top"], 8, F.col("seite")), named, ["buch_id", "code"], 8, F.col("seite"))
    number = F.col("bare") & ~F.col("heavy") & (F.col("fit").isNotNull() | F.col("tiny"))
    light = ~F.col("heavy") & ~F.col("bare") & (F.col("code") != "")
    counts_on = F.col("fit").isNotNull() & (F.col("led") | (F.col("fits") > 1) | (F.col("tinies") > 0))
    often = (F.col("k") > 1) & ((F.col("tinies") > 0) | (F.col("fits") > 1) | ((F.col("k") > 2) & (F.col("k") >= 0.2 * F.col("pages"))))
    at_edge = F.col("named").isNotNull() & (F.col("pos") <= F.col("first") + 1)
    light = light & (~F.col("text").rlike(PARTS) | F.col("tiny"))
    running = light & (often | counts_on | at_edge | (F.col("tiny") & (F.length("code") > 2)))
    return e.where(number | running).select("zeile_id", "buch_id", "seite").distinct()


# ---- blocks of pages

OUT = "buch_id {b}, seite int, zeile_id bigint, art string, token string, code string, absatz int, offen boolean, weiter boolean, text string"


def open_part(text: str) -> tuple[str, str]:
    """The last word of a line without its mark of division, and the mark or ""."""
    text = text.rstrip()
    mark = text[-1:] if text[-1:] in (*MARKS, *HYPHENS) else ""
    words = text[: len(text) - len(mark)].rsplit(None, 1)
    return (words[-1].lstrip(_OUTER) if words else ""), mark


class Reader:
    """Reads the lines of a block in order; one per Python worker."""

    def __init__(self, lexicon: Lexicon, decoder: encoding.Decoder):
        self.lex, self.decoder = lexicon, decoder
        self.seen: dict[str, bool] = {}
        self.good: set[str] = set()
        self.judged: dict[str, tuple[str, bool] | None] = {}
        self.meant: dict[str, tuple[str, str] | None] = {}

    def sound(self, tok: str) -> bool:
        """Whether a token is a known word, a code, or no word at all."""
        if tok not in self.seen:
            core = tok.strip(_OUTER)
            word = core and _LETTER.search(core) and core.lower() not in self.lex.words and not _CODE.fullmatch(core)
            if len(self.seen) > 400_000:
                self.seen.clear(), self.good.clear()
            self.seen[tok] = not word and not _NUMBER_LIKE.fullmatch(core)
            if self.seen[tok]:
                self.good.add(tok)
        return self.seen[tok]

    def judge(self, core: str) -> tuple[str, bool] | None:
        """A word in small letters and whether it may change; None for no word."""
        if core not in self.judged:
            if len(self.judged) > 200_000:
                self.judged.clear()
            low = core.lower()
            free = low not in self.lex.words and not _CODE.fullmatch(core) and len(core) > 1 and not (len(core) < 4 and core.isupper())
            self.judged[core] = None if not core or not _LETTER.search(core) or _NUMBER_LIKE.fullmatch(core) else (low, free)
        return self.judged[core]

    def number(self, core: str) -> tuple[str, str] | None:
        """A number with letters in the place of digits, and the one that is meant."""
        if core not in self.meant:
            if len(self.meant) > 200_000:
                self.meant.clear()
            misread = _NUMBER_LIKE.fullmatch(core) and not re.fullmatch(r"[lIOo]\d|\d[lI]", core)
            self.meant[core] = (core, _digits(core)) if misread else None
        return self.meant[core]

    def legible(self, text: str) -> str:
        """The line in one form and, where it was garbled, restored."""
        text = fold(text)
        if not text.isascii() and not self.decoder.plain(text.translate(_NO_MARKS) if any(m in text for m in MARKS) else text) and (hit := self.decoder.examine(text)):
            text = fold(hit[1])
        return text

    def divided(self, part: tuple[str, str], after: str | None) -> bool:
        """Whether the word that a line ends with (see ``open_part``) goes on in ``after``."""
        tail = after.split(None, 1)[:1] if after else []
        if not tail:
            return False
        a, mark = part
        b = tail[0].rstrip(_OUTER)
        if not a or not b or not _LETTER.match(a[-1]):
            return False
        if not mark:  # the mark is lost: only a word that is sure tells
            known = self.lex.words
            return a.lower() not in known and b.lower() not in known and (a + b).lower() in known
        end = mark
        if not (_LETTER.match(b) or end in MARKS or b[0] in DROPPED + REPLACED or b[:1].isdigit() and _LETTER.search(b)):
            return False
        if end in MARKS:
            return True
        joined, hyphen = self.lex.words.get((a + b).lower(), 0), self.lex.words.get(f"{a}-{b}".lower(), 0)
        if joined or hyphen:
            return joined >= hyphen
        if b.lower() in COORDINATION or _CODE.fullmatch(f"{a}-{b}") or a.isupper() and len(a) <= 4:
            return False
        if b[:1].isdigit():
            return any(w for w, _ in self.lex.candidates((a + b).lower()))
        return b[:1].islower() or a.isupper() and b.isupper() or b[0] in DROPPED + REPLACED

    def wrong(self, text: str, before: str | None, after: str | None, hanging: bool = False) -> tuple[list[tuple[str, str]], str]:
        """Misread words with what they are, and the corrected line.

        ``before`` is the part of a word that the line before left open,
        ``after`` the part that the next line goes on with, both without mark.
        ``before`` is None after a hyphen that stays, ``hanging`` means that this
        line ends with one: such words are part of a compound and not judged.
        """
        toks = text.split()
        if self.good.issuperset(toks) or all(map(self.sound, toks)):
            return [], text
        spans, words, free = [], [], []
        for i, tok in enumerate(toks):
            core = tok.strip(_OUTER)
            if i == len(toks) - 1 and tok[-1:] in MARKS + HYPHENS:
                core = tok[:-1].strip(_OUTER)
            if (judged := self.judge(core)) is None:
                continue
            spans.append((i, core))
            words.append(judged[0])
            free.append(judged[1])
        numbers = [n for x in toks if (n := self.number(x.strip(_OUTER)))]
        if not any(free) and not numbers:
            return [], text
        if words and (before is None or hanging):
            free = [f and not (k == 0 and before is None or k == len(words) - 1 and hanging) for k, f in enumerate(free)]
        ends: dict[int, tuple[str, str]] = {}
        if words and before:
            ends[0] = (before.lower(), "")
        if words and after:
            ends[len(words) - 1] = (ends.get(len(words) - 1, ("", ""))[0], after.lower())
        whole = [ends[i][0] + w + ends[i][1] if i in ends else w for i, w in enumerate(words)]
        free = [f and w not in self.lex.words for f, w in zip(free, whole)]
        if not any(free) and not numbers:
            return [], text
        best = self.lex.decode(whole, free)
        found, new = [(t, n) for t, n in numbers], list(toks)
        for t, n in numbers:
            new = [x.replace(t, n) for x in new]
        for (i, core), w, old, got in zip(spans, words, whole, best):
            k = words.index(w) if w in words else 0
            at = next((p for p, s in enumerate(spans) if s[0] == i), k)
            head, tail = ends.get(at, ("", ""))
            if got != old:
                if head and got.startswith(head) and got[len(head) :] == w or tail and got.endswith(tail) and got[: -len(tail)] == w:
                    continue
                if head and not got.startswith(head) and strokes(got).endswith(strokes(w)) and got.endswith(w):
                    continue
                if tail and not got.endswith(tail) and got.startswith(w):
                    continue
                part = got
                if head or tail:
                    part = got[len(head) :] if head and got.startswith(head) else got[: -len(tail)] if tail and got.endswith(tail) else w
                if part == w and not (head or tail):
                    continue
                found.append((core, part))
                new[i] = new[i].replace(core, _cased(core, part))
            elif free[at] and self.noisy(core):
                found.append((core, ""))
        return found, " ".join(new)

    @staticmethod
    def noisy(core: str) -> bool:
        """Whether a word has signs in it that no word has, even if unknown."""
        letters = len(_LETTER.findall(core))
        if letters < 2 or core[:1] == "°" or len(core) > 40 or 2 * letters < len(core):
            return False
        inner = core[1:-1] if len(core) > 2 else ""
        return any(c in REPLACED for c in core) or any(c in "*°|·;~^,_\"" for c in inner) or bool(_INNER_DIGIT.search(core)) and core[1:].islower()


def _digits(token: str) -> str:
    """The digits that a number or the number of a code is meant to have."""
    head, dash, tail = token.rpartition("-")
    return head + dash + tail.translate(_DIGITS)


def _cased(old: str, new: str) -> str:
    """``new`` in the case of ``old``, whose first letter may be a digit now."""
    if len(old) > 1 and old.isupper():
        return new.upper()
    return new[:1].upper() + new[1:] if old[:1].isupper() or old[:1] in "8150" else new


def read_block(reader: Reader, rows: list[tuple], out: list[list], texts: bool) -> None:
    """Cases or, with ``texts``, paragraphs of one block. ``rows`` in order: page, position,
    kind (0 mark of a page line, 1 line), block, id, text, side, size, bold, book. The side is 0 for
    the block's own lines, -1 for those of the page before and 1 for those of the page after."""
    marks = {r[4] for r in rows if r[2] == 0}
    lines = [r for r in rows if r[2] == 1]
    buch = rows[0][9]
    # the valid reading of each place is the last; what it says is the text
    valid: list[tuple] = []
    for _, group in groupby(lines, key=lambda r: (r[0], r[1])):
        last = list(group)[-1]
        if last[4] not in marks and last[5] is not None and last[5].strip():
            valid.append(last)
    own = [r for r in valid if not r[6]]
    # of the pages beside, the block sees the line next to it
    valid = [*[r for r in valid if r[6] < 0][-1:], *own, *[r for r in valid if r[6] > 0][:1]]
    legible = [reader.legible(r[5]) for r in valid]
    places = [(r[0], r[1]) for r in valid]
    shows = {r[4]: k for k, r in enumerate(valid)}
    ends = [open_part(t) for t in legible]
    divides = [reader.divided(e, n) for e, n in zip(ends, [*legible[1:], None])]

    def open_before(k: int) -> str | None:
        """The part of a word that line ``k`` left open; None after a hyphen."""
        if k < 0:
            return ""
        part, mark = ends[k]
        if not divides[k]:
            return None if mark else ""
        return part

    def emit(*row) -> None:
        if texts != (row[3] == "absatz"):
            return
        for col, v in zip(out, row):
            col.append(v)

    corrected: dict[int, tuple[str, bool]] = {}
    for r in lines:
        if r[6] or r[5] is None:
            continue
        if r[4] in marks:
            emit(buch, r[0], r[4], "rand", None, None, None, None, None, None)
            continue
        k = shows.get(r[4])
        if k is not None:
            text, at, cut_here, end = legible[k], k, divides[k], ends[k]
        else:  # an earlier reading of the place, between the same neighbours
            text, at = reader.legible(r[5]), bisect_left(places, (r[0], r[1]))
            end = open_part(text)
        then = bisect_right(places, (r[0], r[1])) if k is None else k + 1
        after = legible[then] if then < len(valid) else None
        if k is None:
            cut_here = reader.divided(end, after)
        if cut_here:
            emit(buch, r[0], r[4], "trennung", None, None, None, None, None, None)
        rest = after.split()[0].rstrip(_OUTER) if cut_here else None
        found, new = reader.wrong(text, open_before(at - 1), rest, not cut_here and bool(end[1]))
        for token, better in found:
            emit(buch, r[0], r[4], "zeichen", token, strokes(token), None, None, None, better)
        if k is not None:
            corrected[r[4]] = (new, cut_here)
    if not texts:
        return
    sizes = Counter(r[7] for r in own if r[7] is not None)
    body = sizes.most_common(1)[0][0] if sizes else None
    lengths = sorted(len(r[5]) for r in own if 25 <= len(r[5]) <= 200)
    width = 0.88 * lengths[int(0.9 * (len(lengths) - 1))] if len(lengths) >= 8 else 0
    beyond = next((r for r in valid if r[6] > 0), None)
    number, para, page, started_open = 0, "", 0, False
    ended = False  # whether the paragraph is closed by its last line
    for k, r in enumerate(own):
        text, divided = corrected[r[4]]
        heading = (r[8] or 0) >= BOLD or body is not None and r[7] is not None and r[7] > body * LARGE
        if not para:
            para, page = "", r[0]
            started_open = k == 0 and not heading
        if divided:
            text = text.rstrip()
            text = text[:-1] if text[-1:] in MARKS + HYPHENS else text
        para += text if divided else text + " "
        last = k + 1 == len(own)
        after = beyond if last else own[k + 1]
        short = len(r[5]) < width and text.rstrip()[-1:] in ".!?:"
        next_heading = after is not None and ((after[8] or 0) >= BOLD or body is not None and after[7] is not None and after[7] > body * LARGE)
        ended = not divided and (heading or short or next_heading)
        if ended or last:
            # the blank at the end of what goes on tells that no word is divided there
            emit(buch, page, None, "absatz", None, None, number, started_open, not ended if last else None, para if last and not ended else para.rstrip())
            number, para = number + 1, ""


def read_pages(lines: DataFrame, marks: DataFrame, lexicon: Lexicon, model: encoding.Model, texts: bool) -> DataFrame:
    """Cases (``rand``, ``trennung``, ``zeichen``) or paragraphs of all blocks."""
    spark = lines.sparkSession
    shared = spark.sparkContext.broadcast((lexicon.words, lexicon.pairs, lexicon.channel, model))
    block = F.floor(F.col("seite") / PAGES).cast("int")
    # a line without a page or place stands before all others
    place = [F.coalesce(c, F.lit(-1)).cast("int").alias(c) for c in ("seite", "pos")]
    cols = ["buch_id", *place, F.lit(1).alias("kind"), "gelesen_am", "zeile_id", "text", "groesse", "fett"]
    src = lines.select(*cols).unionByName(
        marks.select("buch_id", "seite", F.lit(-2).alias("pos"), F.lit(0).alias("kind"), F.lit(None).cast("timestamp_ntz").alias("gelesen_am"), "zeile_id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("groesse"), F.lit(None).cast("double").alias("fett")).withColumn("gelesen_am", F.col("gelesen_am").cast(dict(lines.dtypes)["gelesen_am"]))
    )
    # the first and the last page of a block are seen by the blocks beside it; those of a book are few
    ends = lines.where("seite >= 0").groupBy("buch_id", block.alias("block")).agg(F.min("seite").alias("first"), F.max("seite").alias("last"))
    w = Window.partitionBy("buch_id").orderBy("block")
    ends = ends.select("buch_id", "first", "last", F.lag("block").over(w).alias("before"), F.lead("block").over(w).alias("after"))
    beside = F.array(F.struct(F.col("first").alias("seite"), F.col("before").alias("block"), F.lit(1).alias("side")), F.struct(F.col("last").alias("seite"), F.col("after").alias("block"), F.lit(-1).alias("side")))
    seen = ends.select("buch_id", F.explode(beside).alias("x")).where("x.block is not null")
    seen = seen.groupBy("buch_id", F.col("x.seite").cast("int").alias("seite")).agg(F.collect_list(F.struct("x.block", "x.side")).alias("beside"))
    src = src.join(seen, ["buch_id", "seite"], "left")
    here = F.array(F.struct(block.alias("block"), F.lit(0).alias("side")))
    src = src.withColumn("to", F.explode(F.concat(here, F.coalesce("beside", F.array().cast("array<struct<block:int,side:int>>"))))).select("*", "to.block", "to.side").drop("to", "beside")
    order = ["buch_id", "block", "seite", "pos", "kind", "gelesen_am", "zeile_id"]
    laid = src.repartition("buch_id", "block").sortWithinPartitions(*order)
    schema = OUT.format(b=dict(lines.dtypes)["buch_id"])
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [laid.schema["buch_id"].dataType, None]
    big = pa.int64() if kinds[0].simpleString() == "bigint" else pa.int32()
    types = [big, pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = worker_reader(shared)
        held: list[tuple] = []
        key = None
        out: list[list] = [[] for _ in names]

        def batch_out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)
            for c in out:
                c.clear()
            return got

        for batch in batches:
            c = {n: batch.column(n).to_pylist() for n in ("buch_id", "block", "seite", "pos", "kind", "zeile_id", "text", "side", "groesse", "fett")}
            for row in zip(c["seite"], c["pos"], c["kind"], c["block"], c["zeile_id"], c["text"], c["side"], c["groesse"], c["fett"], c["buch_id"]):
                if key != (row[9], row[3]):
                    if held:
                        read_block(reader, held, out, texts)
                    held, key = [], (row[9], row[3])
                held.append(row)
            if len(out[0]) > 20_000:
                yield batch_out()
        if held:
            read_block(reader, held, out, texts)
        yield batch_out()

    return laid.select("buch_id", "block", "seite", "pos", "kind", "zeile_id", "text", "side", "groesse", "fett").mapInArrow(run, schema)


_READERS: dict[int, Reader] = {}


def worker_reader(shared) -> Reader:
    """The worker's reader for a broadcast: built once, as it takes a second."""
    key = shared._jbroadcast_id if hasattr(shared, "_jbroadcast_id") else id(shared.value)
    if key not in _READERS:
        _READERS.clear()
        words, pairs, channel, model = shared.value
        _READERS[key] = Reader(Lexicon(words, pairs, channel), encoding.Decoder(model))
    return _READERS[key]


def build_lexicon(words: DataFrame, pairs: DataFrame) -> Lexicon:
    """The lexicon of every task: all trusted words, all pairs, all confusions."""
    trusted = cut(trusted_words(words))
    own = {r["word"]: r["evidence"] for r in trusted.select("word", "evidence").collect()}
    two = {(r["a"], r["b"]): r["n"] for r in pairs.collect()}
    if len(own) > TIER or len(two) > PAIRS:
        warnings.warn(f"{len(own)} trusted words and {len(two)} pairs of words go to every task", stacklevel=2)
    return Lexicon(own, two, learned_channel(words, trusted))


def corpus(lines: DataFrame, documents: DataFrame) -> DataFrame:
    return lines.select("text", F.lit(False).alias("clean")).unionByName(documents.select("text", F.lit(True).alias("clean")))


def cases(lines: DataFrame, documents: DataFrame, titles: DataFrame) -> DataFrame:
    """``zeile_id``, ``art``: a row per line and kind of case.

    Null and empty lines are no cases; each reading of a line counts for itself.
    """
    words, pairs = lexicon_counts(corpus(lines, documents))
    lexicon = build_lexicon(words, pairs)
    found = read_pages(lines, page_marks(lines, titles), lexicon, encoding.fit(documents), False)
    return cut(found.select("zeile_id", "art")).distinct()


def paragraphs(lines: DataFrame, documents: DataFrame, titles: DataFrame) -> DataFrame:
    """``buch_id``, ``seite``, ``absatz``, ``text``: the running text of each book.

    Page marks are left out, divided words joined, misread words corrected. A paragraph or word that goes on over the end of a block is joined
    with the part in the next block; ``absatz`` ascends in the book's order.
    """
    words, pairs = lexicon_counts(corpus(lines, documents))
    lexicon = build_lexicon(words, pairs)
    result = cut(read_pages(lines, page_marks(lines, titles), lexicon, encoding.fit(documents), True))
    number = F.floor(F.col("seite") / PAGES).cast("bigint")
    p = result.select("buch_id", "seite", (number * 65_536 + F.col("absatz")).alias("absatz"), (F.col("absatz") == 0).alias("erster"), "offen", "weiter", "text")
    # only the first and the last paragraph of a block are ordered by book
    edge = F.col("erster") | F.col("weiter").isNotNull()
    w = Window.partitionBy("buch_id").orderBy("absatz")
    goes_on = F.col("erster") & F.col("offen") & F.lag("weiter").over(w) & (F.lag("seite").over(w) >= 0)
    e = p.where(edge).withColumn("start", (~F.coalesce(goes_on, F.lit(False))).cast("bigint")).withColumn("chain", F.sum("start").over(w))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("absatz", "text"))), lambda x: x["text"])
    joined = e.groupBy("buch_id", "chain").agg(F.min("seite").alias("seite"), F.min("absatz").alias("absatz"), F.rtrim(F.array_join(parts, "")).alias("text"))
    columns = ["buch_id", "seite", "absatz", "text"]
    return p.where(~edge).select(*columns).unionByName(joined.select(*columns))
