"""Text garbled by a wrong decoding: found and restored by description length.

Every candidate chain of encodings is applied to a line; each result is
compressed with the zstandard dictionary of every language, and its characters
beside ASCII and its unknown words are charged what they cost in that language.
The chain and language with the least description length including its own
cost wins; if no chain saves ``MIN_GAIN`` bytes, or ``MIN_GAIN_ODD`` where the
result has no known word and no usual characters either, the line stays as it
is. Where all characters of a line are usual ones, the changed parts have to be
known words. A line that folding look-alike characters shortens as much isn't garbled,
only written otherwise.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain as all_of, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blattwerk.llm.labels import LANGUAGES, named_language
from blattwerk.session import cut

#: Bytes of a dictionary.
DICT_BYTES = 48 * 1024
#: Distinct pairs and runs held by a counting task before it hands them on.
FLUSH = 400_000
#: Characters of a word in a pair; longer words count in parts of this length.
PART = 32
LEVEL = 1
#: Bytes that a chain has to save beyond its cost, and the cost of one step.
MIN_GAIN, MIN_GAIN_ODD, STEP_COST = 1.5, 5.0, 0.5
#: Bytes charged for a character that the language's documents don't have.
UNSEEN = 2.5
#: Bytes charged for a word with such characters that isn't in the documents.
UNKNOWN = 1.0
#: Characters that the supported languages use beside ASCII.
USUAL = frozenset(
    "äöüßÄÖÜéèêëàâçîïôûùœæÉÈÊÀÂÇÎÔÛáíóúñÁÍÓÚÑ¿¡ìòÌÒąćęłńśźżĄĆĘŁŃŚŹŻĳ"
    "°²³µ§±×·½¼¾–—‘’‚“”„…«»‹›€†•øØåÅΩ\xa0\xad"
)
#: Characters that are usual in text in order. Wrong decodings give some of them
#: too ("Hènde", "schÜn"), so lines of these alone are examined as well.
PLAIN = "äöüßÄÖÜéèêàâçîïôûùœëÉ°²–"
#: Encodings that text was wrongly read with, by what it truly was in.
WRONG_FOR = {
    "utf-8": ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "iso8859_2", "koi8_r", "cp866"),
    "cp1252": ("mac_roman", "cp437", "cp850", "cp1250", "cp1251", "iso8859_2", "koi8_r", "cp866", "iso8859_7"),
    "mac_roman": ("cp1252", "cp850", "cp437"),
    "cp850": ("cp1252", "mac_roman"),
    "cp437": ("cp1252", "mac_roman"),
    "cp1250": ("cp1252", "cp850"),
    "iso8859_2": ("cp1252",),
}
CHAINS = [((w, r),) for r, ws in WRONG_FOR.items() for w in ws] + [
    ((a, "utf-8"), (b, "utf-8")) for a in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850") for b in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850")
]
NAMES = [">".join(f"{r}/{w}" for w, r in chain) for chain in CHAINS]
LOST = "\ufffd"
WORD = re.compile("[^\\W\\d_\ufffd]+(?:[-\u2013\ufffd]*[^\\W\\d_]+)*|\ufffd[^\\W\\d_\ufffd][^\\W\\d_]*(?:[-\u2013\ufffd]*[^\\W\\d_]+)*")
_SIGN_IN_WORD = re.compile(r"[°²][^\W\d_]{2}")
#: What a lost character may have been.
LOST_FOR = "äöüßÄÖÜéèêàçîôûï°²–ñóáíłżęąśćń"


def suspicious(text: Column) -> Column:
    """Rows worth examining: those with a character beside ASCII."""
    return text.rlike(r"[^\x00-\x7f]")


def byte_table(codec: str) -> dict[str, int]:
    """Character to byte; bytes that the codec leaves open stand for themselves."""
    table = {}
    for b in range(256):
        try:
            table.setdefault(bytes([b]).decode(codec), b)
        except UnicodeDecodeError:
            pass
    for b in range(128, 160):
        table.setdefault(chr(b), b)
    return table


@dataclass
class Model:
    """Dictionaries and character costs in bytes, by language."""

    dictionaries: dict[str, bytes]
    chars: dict[str, dict[str, float]]
    words: dict[str, set[str]]


class Decoder:
    """Examines single texts; built once per Python worker from the dictionaries."""

    def __init__(self, model: Model):
        import zstandard as zstd

        from blattwerk.llm.unify import fold

        self.fold, self.chars, self.words = fold, model.chars, model.words
        self.comp = {}
        for lang, raw in model.dictionaries.items():
            d = zstd.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.comp[lang] = zstd.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False)
        if not self.comp:
            self.comp["und"] = zstd.ZstdCompressor(level=LEVEL, write_content_size=False)
            self.chars, self.words = {"und": dict.fromkeys(PLAIN, 1.0)}, {"und": set()}
        self.bytes = {c: byte_table(c) for c in {w for ws in WRONG_FOR.values() for w in ws}}
        self.memo: dict[str, dict[int, str]] = {}
        self.orderly: set[str] = set()
        self.doubted: set[str] = set()
        self.odd: dict[str, bool] = {}
        self.knowing: dict[str, frozenset[str]] = {}
        self.charges: dict[str, dict[str, float]] = {lang: {} for lang in self.comp}
        self.by_length: dict[str, dict[int, list[str]]] = {}

    def plain(self, text: str) -> bool:
        """Whether ``text`` has no character beside ASCII and the plain ones
        except in known words: such text is in order."""
        toks = text.split(" ")
        if self.orderly.issuperset(toks):
            return True
        if not self.doubted.isdisjoint(toks):
            return False
        if len(self.orderly) + len(self.doubted) > 200_000:
            self.orderly.clear(), self.doubted.clear()
        for t in toks:
            if t not in self.orderly:
                if not t.isascii() and (self.odd_in(t) or _SIGN_IN_WORD.search(t) or not self.words_known(t) and self.results(t)):
                    self.doubted.add(t)
                    return False
                self.orderly.add(t)
        return True

    def odd_in(self, tok: str) -> bool:
        """Whether ``tok`` has a character that is neither ASCII nor plain."""
        if tok not in self.odd:
            if len(self.odd) > 200_000:
                self.odd.clear()
            self.odd[tok] = any(c > "\x7f" and c not in PLAIN for c in tok)
        return self.odd[tok]

    def words_known(self, tok: str) -> bool:
        """Whether every word of ``tok`` with a character beside ASCII is one of some language."""
        return all(any(w in own for own in self.words.values()) for w in WORD.findall(tok.lower()) if not w.isascii())

    def size(self, text: str, lang: str) -> float:
        """Bytes of ``text`` in a language: compressed, and what its characters beside ASCII
        and its unknown words are charged."""
        out = float(len(self.comp[lang].compress(text.encode("utf-8", "surrogatepass"))))
        for t in text.split(" "):
            if not t.isascii():
                out += self.charge(t, lang)
        return out

    def charge(self, tok: str, lang: str) -> float:
        """Bytes that the characters beside ASCII of ``tok`` and its unknown words are charged."""
        own = self.charges[lang]
        if tok not in own:
            if len(own) > 100_000:
                own.clear()
            cost = self.chars[lang]
            own[tok] = sum(cost.get(c, UNSEEN) for c in tok if c > "\x7f") + UNKNOWN * (not self.known(tok, lang))
        return own[tok]

    def known_in(self, tok: str) -> frozenset[str]:
        """The languages that know all words of ``tok`` with a character beside ASCII; none
        where it has no such word."""
        if tok not in self.knowing:
            if len(self.knowing) > 200_000:
                self.knowing.clear()
            words = [w for w in WORD.findall(tok.lower()) if not w.isascii()]
            self.knowing[tok] = frozenset(lang for lang, own in self.words.items() if words and own.issuperset(words))
        return self.knowing[tok]

    def known(self, tok: str, lang: str) -> bool:
        return lang in self.known_in(tok)

    def sound(self, changed: list[str], lang: str, chain: str) -> bool:
        """Whether the changed parts are words of the language, or a decoding as
        UTF-8, which hardly happens by chance, gave usual characters."""
        if any(lang in self.known_in(b) for b in changed):
            return True
        return "utf-8" in chain and all(c <= "\x7f" or c in self.chars[lang] or c in PLAIN or c == "\xad" for b in changed for c in b)

    def words_found(self, changed: list[str]) -> bool:
        """Whether all changed parts are words of one language now. Nothing less
        tells a wrong decoding where all characters are usual ones."""
        return bool(frozenset(self.words).intersection(*map(self.known_in, changed)))

    def shortest(self, text: str) -> tuple[float, str]:
        """The least description length of ``text`` over the languages, and which one gives it."""
        raw, odd, found = text.encode("utf-8", "surrogatepass"), [t for t in text.split(" ") if not t.isascii()], []
        for lang, comp in self.comp.items():
            out, own = float(len(comp.compress(raw))), self.charges[lang]
            for t in odd:
                out += own[t] if t in own else self.charge(t, lang)
            found.append((out, lang))
        return min(found)

    def token(self, tok: str, chain: tuple, steps: dict[tuple[str, str], bytes | str | None]) -> str | None:
        """``tok`` through ``chain``, or None where that gives nothing usable. ``steps`` holds
        what single steps gave: chains have them in common."""
        out: str | None = tok
        for wrong, right in chain:
            if (out, wrong) not in steps:
                table = self.bytes[wrong]
                raw = [table.get(ch) for ch in out]
                steps[out, wrong] = None if None in raw else bytes(raw)
            if (raw := steps[out, wrong]) is None:
                return None
            if (raw, right) not in steps:
                try:
                    steps[raw, right] = raw.decode(right)
                except UnicodeDecodeError:
                    steps[raw, right] = None
            if (out := steps[raw, right]) is None:
                return None
        if out == tok or not all(c < "\x7f" or c in USUAL or c.isalpha() and right == "utf-8" or ord(c) > 0x2000 and right == "utf-8" for c in out):
            return None
        return out

    def results(self, tok: str) -> dict[int, str]:
        """What each chain makes of ``tok``, where that is usable."""
        if tok not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            steps: dict[tuple[str, str], bytes | str | None] = {}
            self.memo[tok] = {k: s for k, chain in enumerate(CHAINS) if (s := self.token(tok, chain, steps)) is not None}
        return self.memo[tok]

    def candidates(self, text: str) -> Iterator[tuple[str, str, float, list[str]]]:
        """Name, result and cost of every chain that changes ``text``, and the parts changed."""
        toks = text.split(" ")
        by: dict[int, dict[int, str]] = {}
        odd_at = set()
        for i, t in enumerate(toks):
            if not t.isascii() and (results := self.results(t)):
                if self.odd_in(t):
                    odd_at.add(i)
                for k, s in results.items():
                    by.setdefault(k, {})[i] = s

        def put(new: dict[int, str]) -> str:
            own = toks.copy()
            for i, s in new.items():
                own[i] = s
            return " ".join(own)

        for k in sorted(by):
            new, cost = by[k], STEP_COST * len(CHAINS[k])
            yield NAMES[k], put(new), cost, list(new.values())
            if odd_at and 0 < len(odd := {i: s for i, s in new.items() if i in odd_at}) < len(new):
                yield NAMES[k], put(odd), cost + STEP_COST, list(odd.values())

    def fits(self, pattern: str, lang: str) -> bool:
        """Whether a known word of the language has the letters of ``pattern``, lost ones being any."""
        if lang not in self.by_length:
            self.by_length[lang] = {}
            for w in self.words[lang]:
                self.by_length[lang].setdefault(len(w), []).append(w)
        return any(all(x in (y, LOST) for x, y in zip(pattern, w)) for w in self.by_length[lang].get(len(pattern), ()))

    def near(self, tok: str, lang: str) -> float:
        """0 where a known word fits ``tok``, whose lost characters may be any."""
        if LOST not in tok:
            return 0.0 if self.known(tok, lang) else 10 * UNKNOWN
        for w in WORD.findall(tok.lower()):
            if LOST in w and not self.fits(w, lang):
                return 10 * UNKNOWN
        return 0.0

    def fill(self, text: str, lang: str) -> str:
        """Lost characters one by one, each by what makes its word cheapest."""
        toks = text.split(" ")
        for i, t in enumerate(toks):
            while LOST in t:
                at = t.index(LOST)
                low = at > 0 and t[at - 1].islower()
                t = min((t[:at] + c + t[at + 1 :] for c in LOST_FOR if not (low and c.isupper())), key=lambda s: self.near(s, lang) + self.size(" ".join([*toks[max(0, i - 1) : i], s, *toks[i + 1 : i + 2]]), lang))
            toks[i] = t
        return " ".join(toks)

    def examine(self, text: str) -> tuple[str, str, float] | None:
        """Chain, restored text and gain in bytes; None for text in order.

        A text with lost characters (U+FFFD) or C1 controls counts as garbled
        even where nothing restores it; the chain is then ``lost``.
        """
        if text.isascii():
            return None
        lost = LOST in text
        if not lost and self.plain(text):
            return None
        found = list(self.candidates(text))
        usual = all(c <= "\x7f" or c in PLAIN for c in text)
        if usual:  # nothing but known words tells here, so without them nothing is compressed
            found = [x for x in found if self.words_found(x[3])]
        if not found and not lost:
            return ("lost", text, 0.0) if any("\x80" <= c < "\xa0" and c != "\x85" for c in text) else None
        (old, lang), best = self.shortest(text), None
        if found and (same := self.fold(text)) != text:
            old = min(old, self.shortest(same)[0])
        seen: dict[str, tuple[float, str]] = {}
        for name, new, cost, changed in found:
            if new not in seen:
                seen[new] = self.shortest(new)
            total, own = seen[new][0] + cost, seen[new][1]
            if old - total < MIN_GAIN or best is not None and total >= best[2]:
                continue
            if old - total < MIN_GAIN_ODD and not self.sound(changed, own, name):
                continue
            best, lang = (name, new, total), own
        if best:
            new = self.fill(best[1], lang) if lost else best[1]
            return best[0], new, old - best[2]
        if lost:
            return "lost", self.fill(text, lang), 0.0
        return ("lost", text, 0.0) if any("\x80" <= c < "\xa0" and c != "\x85" for c in text) else None


#: A line in runs of up to four words, long ones in parts.
_RUN = re.compile(r"(?:\S{1,32}\s{0,2}){1,4}")


def text_counts(documents: DataFrame, runs: bool = True) -> DataFrame:
    """``lang``, ``kind``, ``item``, ``n`` of all labelled documents, whole.

    All lines count: their characters beside ASCII (``c``, under "" all characters), words
    with such characters (``w``), every two words next to each other (``p``) and, unless
    ``runs`` is false, the runs of words that a line consists of (``r``). Each task counts
    its rows first.
    """

    def line_pairs(line: str) -> Iterator[tuple[str, str]]:
        """Every word of the line after the one before, the first one after an empty one."""
        words = f" {line}".split(" ")
        if words.count("") > 1:
            words = ["", *filter(None, words)]
        return pairwise(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, rest = ({lang: Counter() for lang in LANGUAGES} for _ in range(2))

        def flush() -> pa.RecordBatch:
            out: list[tuple[str, str, str, int]] = []
            for lang in LANGUAGES:
                toks, joined, chars, words = {}, Counter(), Counter(), Counter()
                for (a, b), n in pairs[lang].items():
                    toks[b] = toks.get(b, 0) + n
                    if not a:
                        continue
                    if len(a) > PART or len(b) > PART:
                        a, b = a[(len(a) - 1) // PART * PART :], b[:PART]
                    joined[f"{a} {b}"] += n
                for t, n in toks.items():
                    chars[""] += n * len(t)
                    for i in range(PART, len(t), PART):
                        joined[f"{t[i - PART : i]} {t[i : i + PART]}"] += n
                    if not t.isascii():
                        for c in t:
                            if c > "\x7f":
                                chars[c] += n
                        for w in WORD.findall(t.lower()):
                            if not w.isascii():
                                words[w] += n
                for kind, count in (("c", chars), ("w", words), ("p", joined), ("r", rest[lang])):
                    out += [(lang, kind, x, n) for x, n in count.items()]
                pairs[lang].clear(), rest[lang].clear()
            cols = list(zip(*out)) or [()] * 4
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:3]), pa.array(cols[3], pa.int64())], ["lang", "kind", "item", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines = text.split("\n")
                pairs[lang].update(all_of.from_iterable(map(line_pairs, lines)))
                if runs:
                    rest[lang].update(all_of.from_iterable(map(_RUN.findall, lines)))
            if sum(len(c) for kind in (pairs, rest) for c in kind.values()) > FLUSH:
                yield flush()
        yield flush()

    named = documents.select(named_language(F.col("lang")).alias("l"), "text").where("l is not null and text is not null")
    return named.mapInArrow(run, "lang string, kind string, item string, n bigint").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


def chained(pairs: list[str]) -> bytes:
    """A dictionary of ``pairs``, the most frequent first: as many of them as DICT_BYTES hold.

    A pair goes on from one that ends with its first word, so that the word between stands
    there once. What holds the most frequent pairs comes last, where it is cheapest to refer to.
    """
    split, room, after = [p.split(" ") for p in pairs], DICT_BYTES, {}
    for k, (_, b) in enumerate(split):
        # a pair adds its second word and a blank at least
        room -= len(b.encode("utf-8", "surrogatepass")) + 1
        if room < 0:
            del split[k:]
            break
    for k in reversed(range(len(split))):
        after.setdefault(split[k][0], []).append(k)
    used, out, room = [False] * len(split), [], DICT_BYTES
    for k, (a, b) in enumerate(split):
        if used[k]:
            continue
        used[k], words = True, [a, b]
        while next_ := after.get(words[-1]):
            if not used[at := next_.pop()]:
                used[at] = True
                words.append(split[at][1])
        out.append(" ".join([*words, ""]).encode("utf-8", "surrogatepass"))
        room -= len(out[-1])
        if room <= 0:
            break
    return b"".join(reversed(out))[-DICT_BYTES:]


def fit(documents: DataFrame) -> Model:
    """Dictionary and character costs per language, from all labelled documents.

    Characters, words and pairs of words are counted over the whole table, and nothing
    else tells the model: a dictionary has the pairs that are most frequent there, of equally
    frequent ones the first, as many as DICT_BYTES hold. An empty table gives no dictionary,
    and then plain compression decides.
    """
    counts = cut(text_counts(documents, runs=False))
    few: dict[tuple[str, str], dict[str, int]] = {}
    for r in counts.where("kind = 'c' or kind = 'w' and n > 1").collect():
        few.setdefault((r["lang"], r["kind"]), {})[r["item"]] = r["n"]
    model = Model({}, {}, {})
    for lang in LANGUAGES:
        chars = few.get((lang, "c"), {})
        if not chars:
            continue
        # every pair takes two bytes or more, so more of them never find room
        most = counts.where((F.col("lang") == lang) & (F.col("kind") == "p")).orderBy(F.desc("n"), "item").limit(DICT_BYTES // 2)
        model.dictionaries[lang] = chained(most.select("item").toArrow()["item"].to_pylist())
        total = chars.pop("") + 1
        model.chars[lang] = {c: min(UNSEEN, math.log2(total / n) / 8) for c, n in chars.items()}
        model.words[lang] = set(few.get((lang, "w"), ()))
    return model


SCHEMA = "chain string, restored string, gain double"


def examine(rows: DataFrame, model: Model, keys: list[str], text: str = "text") -> DataFrame:
    """The garbled rows of ``rows``: ``keys``, chain, restored, gain.

    One row per garbled input row. Null and empty texts are in order; equal
    rows count each for itself; other columns are ignored.
    """
    schema = ", ".join(f"`{k}` {dict(rows.dtypes)[k]}" for k in keys) + ", " + SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model)
        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            hits = [(i, h) for i, t in enumerate(texts) if (h := decoder.examine(t)) is not None]
            at = pa.array([i for i, _ in hits], pa.int64())
            cols = [batch.column(k).take(at) for k in range(len(keys))]
            cols += [pa.array([h[n] for _, h in hits], kind) for n, kind in enumerate((pa.string(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, [*keys, "chain", "restored", "gain"])

    return (
        rows.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").alias("__t"))
        .where(F.col("__t").isNotNull() & suspicious(F.col("__t")))
        .mapInArrow(run, schema)
    )


def in_order(rows: DataFrame, model: Model, text: str, asked: str) -> DataFrame:
    """``rows`` without those that are garbled; rows where ``asked`` isn't true all stay.

    Null and empty texts are in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model)
        for batch in batches:
            keep = [not ask or not t or decoder.examine(t) is None for t, ask in zip(batch.column(text).to_pylist(), batch.column(asked).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def restore(rows: DataFrame, model: Model, key: str, text: str = "text") -> DataFrame:
    """All ``rows`` with the column ``restored``: the text, repaired where possible.

    ``key`` must be unique. Null stays null.
    """
    fixed = examine(rows, model, [key], text).select(key, F.col("restored").alias("__r"))
    return rows.join(fixed, key, "left").withColumn("restored", F.coalesce("__r", F.col(f"`{text}`"))).drop("__r")
