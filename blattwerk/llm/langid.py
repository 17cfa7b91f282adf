"""Languages of documents and of their segments, by a byte convolutional network.

Filters of several widths over embedded bytes, max pooling over a window of
fixed length, and a softmax; trained in numpy on labelled text and applied to
all windows of all texts in batches. The lines of a block of text are parted
where the language of their windows changes for good; such a part takes the mean
of its windows, and neighbouring parts of one language form a segment.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blattwerk.llm.labels import LANGUAGES, labelled_sample, named_language

WINDOW, WIDTHS, FILTERS, EMBED = 96, (2, 3, 4, 5), 16, 8
#: The network is fitted on the SAMPLE_DOCS labelled documents with the least
#: hash of their id, no more than SAMPLE_CHARS characters of each, and no more
#: than SAMPLE_WINDOWS windows of a language.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_WINDOWS = 3000, 6000, 3000
STEPS, BATCH, RATE = 500, 256, 0.006
#: Letters that a block needs to count, and the confidence that a block in a
#: language other than the main one needs.
MIN_LETTERS, MIN_CONFIDENCE = 25, 0.7
#: Nats that a change of language inside a block costs, after a line that ends a
#: sentence and after another one, and the most that one window tells.
CHANGE, CHANGE_WITHIN, WINDOW_TELLS = 2.5, 8.0, 5.0
#: Windows to a batch.
SLICE = 256

_BLOCK = re.compile(r"\n[ \t]*\n\s*")
_QUOTE = re.compile(r"[„“«»‚‘\"][^„“”«»‚‘\"\n]{1,80}[“”«»’‘\"]")
#: What is no text, over several lines too: code, formulas, marks and pictures.
_MARKUP = re.compile(
    r"(?ms)^[ \t]*(```|~~~)(?:.*?\n[ \t]*\1[^\n]*$|(?:(?!\n[ \t]*\n).)*)"
    r"|<!--(?:(?!\n[ \t]*\n).)*?-->|\$\$(?:(?!\n[ \t]*\n).)*?\$\$|!\[[^\]\n]*\]\([^)\n]*\)"
)
#: Lines without text: table rows, formulas, rules, and marks left open.
_PLAIN = re.compile(r"\s*(?:\||<!--|\$[^$\n]*(?:\$[\s.,;:]*)?$|!\[|(?:[-=*]{3,}|_+)\s*$)")
_SENTENCE_END = re.compile(r"[.!?:…][\s\"'”“«»’)\]]*$")
_HEADING = re.compile(r"(?m)^#{1,6} .*$")
_NOISE = re.compile(r"\$[^$\n]*\$|<!--.*?-->|https?://\S+|[\d|#>*_`]+")


def windows(text: str) -> list[bytes]:
    """The whole text in windows; the last one ends with the text."""
    raw = text.encode("utf-8", "ignore")
    if len(raw) <= WINDOW:
        return [raw]
    out = [raw[i : i + WINDOW] for i in range(0, len(raw) - WINDOW + 1, WINDOW)]
    if len(raw) % WINDOW:
        out.append(raw[-WINDOW:])
    return out


def clean(block: str) -> str:
    """Letters of ``block`` in lower case, short quotations and marks left out."""
    return " ".join(_NOISE.sub(" ", _QUOTE.sub(" ", block)).lower().split())


def blocks(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and cleaned text of the blocks that are text in a language."""
    for lines in block_lines(text):
        yield lines[0][0], lines[-1][1], " ".join(body for _, _, body, _ in lines)


def block_lines(text: str) -> Iterator[list[tuple[int, int, str, bool]]]:
    """Per block that is text in a language its lines: start, end, cleaned text,
    and whether the line ends a sentence.

    Blocks end at blank lines. Headings, tables, formulas and marks are left
    out line by line, and so is a block whose other lines have too few letters.
    """
    at = 0
    text = _MARKUP.sub(lambda m: re.sub(r"[^\n]", "_", m[0]), text)
    for part in _BLOCK.split(text):
        start = text.find(part, at)
        at = start + len(part)
        own, here = [], start
        for line in part.split("\n"):
            if line.strip() and not _PLAIN.match(line) and not _HEADING.match(line):
                own.append((here, here + len(line), line))
            here += len(line) + 1
        if len(own) > 1:
            lines = [(a, b, body, bool(_SENTENCE_END.search(line))) for a, b, line in own if (body := clean(line))]
        else:
            lines = [(a, b, clean(line), True) for a, b, line in own]
        if enough(body for _, _, body, _ in lines):
            yield lines


def enough(bodies: Iterator[str]) -> bool:
    """Whether texts have the letters to count."""
    n = 0
    for body in bodies:
        n += sum(map(str.isalpha, body[: 4 * MIN_LETTERS]))
        if n >= MIN_LETTERS or (n := n + sum(map(str.isalpha, body[4 * MIN_LETTERS :]))) >= MIN_LETTERS:
            return True
    return False


def matrix(raws: list[bytes]) -> np.ndarray:
    """Windows as rows of bytes, filled up with zeros."""
    return np.frombuffer(b"".join(r.ljust(WINDOW, b"\0") for r in raws), dtype=np.uint8).reshape(-1, WINDOW)


@dataclass
class Network:
    """Weights: byte embedding, a filter bank per width, and the softmax layer."""

    languages: tuple[str, ...]
    embed: np.ndarray
    banks: list[np.ndarray]  # width x EMBED x FILTERS
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: tuple[str, ...], rng: np.random.Generator) -> Network:
        f32 = np.float32
        banks = [rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)).astype(f32) for w in WIDTHS]
        n = len(WIDTHS) * FILTERS
        return cls(languages, rng.normal(0, 1, (256, EMBED)).astype(f32), banks, rng.normal(0, n**-0.5, (n, len(languages))).astype(f32), np.zeros(len(languages), f32))

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Pooled features and where each filter had its maximum.

        A filter over embedded bytes is a sum of one table per offset.
        """
        feats, where = [], []
        for bank in self.banks:
            w = len(bank)
            n = WINDOW - w + 1
            total = None
            for k in range(w):
                part = (self.embed @ bank[k])[x[:, k : k + n]]
                total = part if total is None else np.add(total, part, out=total)
            at = total.argmax(axis=1)
            where.append(at)
            feats.append(np.maximum(np.take_along_axis(total, at[:, None], 1)[:, 0], 0))
        return np.concatenate(feats, axis=1), where

    def tables(self) -> list[list[np.ndarray]]:
        """Per width a table for each pair of neighbouring bytes, and for a last odd one."""
        out = []
        for bank in self.banks:
            single = [self.embed @ m for m in bank]
            pairs = [(single[k][:, None] + single[k + 1][None]).reshape(65536, FILTERS) for k in range(0, len(bank) - 1, 2)]
            out.append(pairs + single[len(pairs) * 2 :])
        return out

    def features(self, x: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """The pooled features alone, by sums over byte pairs."""
        x = np.ascontiguousarray(x.T)  # positions first: sums and maxima run over whole rows
        pair = x[:-1].astype(np.int32) * 256 + x[1:]
        feats = []
        for w, own in zip(WIDTHS, tables):
            n, total = WINDOW - w + 1, None
            for k, table in enumerate(own):
                part = table[(pair if len(table) > 256 else x)[2 * k : 2 * k + n]]
                total = part if total is None else np.add(total, part, out=total)
            feats.append(np.maximum(total.max(axis=0), 0))
        return np.concatenate(feats, axis=1)

    def probabilities(self, x: np.ndarray, tables: list[list[np.ndarray]] | None = None) -> np.ndarray:
        if not len(x):
            return np.zeros((0, len(self.languages)), np.float32)
        out, tables = [], tables or self.tables()
        for i in range(0, len(x), SLICE):
            z = self.features(x[i : i + SLICE], tables) @ self.out + self.bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            out.append(e / e.sum(axis=1, keepdims=True))
        return np.concatenate(out)

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, rng: np.random.Generator) -> None:
        """Adam on the cross entropy; gradients pass the maxima only."""
        params = [self.embed, *self.banks, self.out, self.bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        by = [np.flatnonzero(y == k) for k in range(len(self.languages))]
        by = [b for b in by if len(b)]
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(b, BATCH // len(by)) for b in by])
            xb, yb = x[pick], y[pick]
            h, where = self.pooled(xb)
            z = h @ self.out + self.bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            g = e / e.sum(axis=1, keepdims=True)
            g[np.arange(len(yb)), yb] -= 1
            g /= len(yb)
            dh = (g @ self.out.T) * (h > 0)
            grads = [np.zeros_like(self.embed), *[np.zeros_like(b) for b in self.banks], h.T @ g, g.sum(axis=0)]
            for n, (bank, at) in enumerate(zip(self.banks, where)):
                d = dh[:, n * FILTERS : (n + 1) * FILTERS]
                for k in range(len(bank)):
                    byte = np.take_along_axis(xb, at + k, 1)
                    emb = self.embed[byte]  # rows x filters x embedding
                    grads[1 + n][k] += np.einsum("bfe,bf->ef", emb, d)
                    np.add.at(grads[0], byte.ravel(), (d[:, :, None] * bank[k].T[None]).reshape(-1, EMBED))
            for i, (p, gr) in enumerate(zip(params, grads)):
                m[i] = 0.9 * m[i] + 0.1 * gr
                v[i] = 0.999 * v[i] + 0.001 * gr * gr
                p -= (RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


_SPELLED = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "ł": "l", "ø": "o"})


def without_marks(text: str) -> str:
    """``text`` as typed on a keyboard that has no accents."""
    return "".join(c for c in unicodedata.normalize("NFD", text.replace("ł", "l")) if not unicodedata.combining(c))


def fit_rows(rows: list[tuple[str, str]], seed: int = 7) -> Network:
    """A network from pairs of language and text.

    Some windows are shown without accents, or with them spelled out. A first
    round finds windows whose label is surely wrong; they don't take part in
    the second.
    """
    rng = np.random.default_rng(seed)
    raws: dict[str, list[bytes]] = {}
    for lang, text in rows:
        for n, (_, _, body) in enumerate(blocks(text)):
            if n % 4 == 3:
                body = without_marks(body) if n % 8 == 3 else body.translate(_SPELLED)
            raws.setdefault(lang, []).extend(windows(body))
    languages = tuple(k for k in LANGUAGES if k in raws)
    x, y = [], []
    for k, lang in enumerate(languages):
        own = raws[lang]
        keep = rng.permutation(len(own))[:SAMPLE_WINDOWS]
        x += [own[i] for i in keep]
        y += [k] * len(keep)
    if len(languages) < 2:
        return Network.fresh(languages or ("und",), rng)
    xs, ys = matrix(x), np.array(y)
    first = Network.fresh(languages, rng)
    first.train(xs, ys, STEPS // 2, rng)
    p = first.probabilities(xs)
    sound = (p.argmax(axis=1) == ys) & (p.max(axis=1) > 0.5)
    net = Network.fresh(languages, rng)
    net.train(xs[sound], ys[sound], STEPS, rng)
    return net


def fit(documents: DataFrame) -> Network:
    """A network from the labelled documents of a bounded sample."""
    rows = labelled_sample(documents, SAMPLE_DOCS, SAMPLE_CHARS)
    return fit_rows(rows)


def changes(tells: np.ndarray, costs: list[float]) -> list[int]:
    """The likeliest language of each line, by Viterbi.

    ``tells`` are the nats that each line gives each language, ``costs`` those
    of a change before each line.
    """
    score, back = tells[0], []
    for own, cost in zip(tells[1:], costs[1:]):
        top = int(score.argmax())
        stay = score >= score[top] - cost
        back.append(np.where(stay, np.arange(len(score)), top))
        score = np.where(stay, score, score[top] - cost) + own
    path = [int(score.argmax())]
    for come in reversed(back):
        path.append(int(come[path[-1]]))
    return path[::-1]


def parts(lines: list[tuple[int, int, str, bool]], at: list[int], p: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Start, end, first and last window of the parts of a block in one language.

    ``at`` has the first window of each line and the end. A part with too few
    letters stays with its neighbour.
    """
    path = [0] * len(lines)
    if len(lines) > 1 and len(set(p[at[0] : at[-1]].argmax(axis=1).tolist())) > 1:
        tells = np.maximum(np.log(p[at[0] : at[-1]] + 1e-12), -WINDOW_TELLS)
        tells *= np.repeat([min(1.0, len(body.encode("utf-8", "ignore")) / WINDOW) for _, _, body, _ in lines], np.diff(at))[:, None]
        costs = [0.0, *(CHANGE if ends else CHANGE_WITHIN for _, _, _, ends in lines[:-1])]
        path = changes(np.add.reduceat(tells, np.array(at[:-1]) - at[0], axis=0), costs)
    first = 0
    for k in range(1, len(lines) + 1):
        if k == len(lines) or path[k] != path[k - 1] and enough(x[2] for x in lines[first:k]) and enough(x[2] for x in lines[k:]):
            yield lines[first][0], lines[k - 1][1], at[first], at[k]
            first = k


def classify(texts: list[str], net: Network, tables: list[list[np.ndarray]] | None = None) -> list[list[tuple[int, int, str, float]]]:
    """Per text its segments: start, end, language, confidence."""
    raws: list[bytes] = []
    spans: list[tuple[int, list[tuple[int, int, str, bool]], list[int]]] = []
    for n, text in enumerate(texts):
        for lines in block_lines(text or ""):
            at = [len(raws)]
            for _, _, body, _ in lines:
                raws += windows(body)
                at.append(len(raws))
            spans.append((n, lines, at))
    p = net.probabilities(matrix(raws), tables) if raws else None
    out: list[list] = [[] for _ in texts]
    for n, lines, at in spans:
        for a, b, i, j in parts(lines, at, p):
            mean = p[i:j].mean(axis=0)
            k = int(mean.argmax())
            out[n].append((a, b, net.languages[k], dict(zip(net.languages, mean.tolist())), j - i))
    return [merge(s) for s in out]


def merge(found: list[tuple[int, int, str, dict[str, float], int]]) -> list[tuple[int, int, str, float]]:
    """Neighbouring blocks of one language as a segment.

    A block in another language than the main one, but not surely so, counts as
    of the main language, with the probability that the network gives that one.
    """
    if not found:
        return []
    size: dict[str, int] = {}
    for a, b, lang, _, _ in found:
        size[lang] = size.get(lang, 0) + (b - a)
    main = max(size, key=lambda k: (size[k], k))
    out: list[list] = []
    for a, b, lang, mean, n in found:
        if mean[lang] < MIN_CONFIDENCE:
            lang = main
        c = mean[lang]
        if out and out[-1][2] == lang:
            out[-1][1] = b
            out[-1][3] += c * n
            out[-1][4] += n
        else:
            out.append([a, b, lang, c * n, n])
    return [(a, b, lang, c / n) for a, b, lang, c, n in out]


def segments(documents: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``segment``, ``von``, ``bis``, ``lang``, ``konfidenz``.

    A document without text in a language, null and empty ones included, has
    no segments. Whole texts are classified.
    """
    schema = f"`{key}` {dict(documents.dtypes)[key]}, segment int, von int, bis int, lang string, konfidenz double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first in range(0, len(texts), 256):
                rows: list[list] = [[] for _ in range(6)]
                for n, found in enumerate(classify(texts[first : first + 256], net, tables)):
                    for k, seg in enumerate(found):
                        for col, v in zip(rows, (first + n, k, *seg)):
                            col.append(v)
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0], pa.int64())), *[pa.array(c, t) for c, t in zip(rows[1:], kinds)]], [key, "segment", "von", "bis", "lang", "konfidenz"])

    return documents.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("__t")).where("__t is not null").mapInArrow(run, schema)


def document_languages(documents: DataFrame, segs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``lang``, ``konfidenz``, ``anteil``: a row per document and language.

    ``anteil`` is its share of the classified characters; the greatest is the
    document's main language. A document without text in a language has one row:
    ``und`` with confidence and share 0.
    """
    size = (F.col("bis") - F.col("von")).cast("double")
    by = segs.groupBy(key, "lang").agg(F.sum(size).alias("n"), (F.sum(F.col("konfidenz") * size) / F.sum(size)).alias("konfidenz"))
    total = by.groupBy(key).agg(F.sum("n").alias("alles"))
    by = by.join(total, key).select(key, "lang", "konfidenz", (F.col("n") / F.col("alles")).alias("anteil"))
    zero = F.lit(0.0)
    return documents.select(F.col(f"`{key}`").alias(key)).join(by, key, "left").select(key, F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("konfidenz", zero).alias("konfidenz"), F.coalesce("anteil", zero).alias("anteil"))


def unnamed(documents: DataFrame, segs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``lang``: languages found that the document's label doesn't name."""
    label = documents.select(F.col(f"`{key}`"), named_language(F.col("lang")).alias("__named"))
    return segs.select(key, "lang").distinct().join(label, key).where("__named is null or __named <> lang").select(key, "lang")
