"""Oversized pages cut into overlapping pieces at natural boundaries.

A page is the latest reading of each of its lines, joined by newlines. Prefix
sums of the lines' sizes give every line its offset, and lines are laid out in
blocks of characters. Within a block the boundaries are a sorted array; each
cut is the last boundary under the limit found by binary search, the next piece
steps back by the overlap, and where there is no boundary the cut is hard.
A page of several blocks is cut as if it were one: each block tells for every
place where a piece may enter it where the last piece leaves it, these jumps
are followed from block to block, and then all blocks are cut at once.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Limits to a block, and line positions to a chunk of the prefix sums. They part
#: the work, not the text: the pieces are the same for any values.
LIMITS, CHUNK = 1024, 4096
#: Characters that a block sees beside its own: a boundary is told from them.
BESIDE = 256
#: Of the limit, the part that a piece fills at least before a weaker kind of
#: boundary is preferred to a stronger one further back.
FILL = 0.5

_SENTENCE = re.compile(r"[.!?:][\"'”“»)\]]{0,8}\s+|\n\s*\n|\n(?=\d{1,9}(?:\.\d{1,9}){0,9} \w)")
_LINE = re.compile(r"\n")
_WORD = re.compile(r"\s+")


def boundaries(text: str) -> list[list[int]]:
    """Sorted offsets after sentence ends, after lines, and after words."""
    return [[m.end() for m in p.finditer(text)] for p in (_SENTENCE, _LINE, _WORD)]


def step(kinds: list[list[int]], start: int, limit: int, overlap: int) -> tuple[int, int]:
    """Where the piece from ``start`` on ends and the next one starts, if more than ``limit`` is left."""
    end = start + limit
    for least, kind in [(start + max(overlap + 1, int(limit * FILL)), k) for k in kinds] + [(start + overlap + 1, kinds[-1])]:
        at = bisect_right(kind, end) - 1
        if at >= 0 and kind[at] >= least:
            end = kind[at]
            break
    low = end - overlap
    at = bisect_left(kinds[-1], low)
    then = kinds[-1][at] if at < len(kinds[-1]) and kinds[-1][at] < end else low
    return end, then if then > start else end


def held(limit: int, overlap: int) -> int:
    """``overlap`` held from 0 to half the limit, so that every piece gets on."""
    if limit < 1:
        raise ValueError("the limit must be at least 1")
    return max(0, min(overlap, limit // 2))


def spans(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Offsets of the pieces of ``text``: none longer than ``limit``.

    They cover the text; each starts ``overlap`` characters before the end of
    the one before, or a little later at a boundary. An empty text has one
    empty piece. ``overlap`` is held below half the limit.
    """
    overlap, kinds, out, start = held(limit, overlap), boundaries(text), [], 0
    while len(text) - start > limit:
        end, then = step(kinds, start, limit, overlap)
        out.append((start, end))
        start = then
    return [*out, (start, len(text))]


def laid_out(lines: DataFrame) -> DataFrame:
    """``at`` (``buch_id``, ``seite``, chunk), ``von``, ``text``, ``umfang``, ``chunks``: the valid lines with their offsets.

    ``umfang`` is the size of the page, ``chunks`` how many it has. Of each position
    the latest reading counts, of equally late ones the greater ``zeile_id``; a
    position whose latest text is null is left out. Null pages are pages of
    their own. The lines are shuffled once; prefix sums go by chunk, then over
    the chunks.
    """
    at = F.struct("buch_id", "seite", F.floor(F.col("pos") / CHUNK).alias("chunk")).alias("at")
    latest = lines.select(at, "pos", "text", F.struct("gelesen_am", "zeile_id").alias("w")).repartition("at").groupBy("at", "pos").agg(F.max_by("text", "w").alias("text")).where("text is not null")
    latest = latest.withColumn("size", F.length("text") + 1)
    page = Window.partitionBy("at.buch_id", "at.seite")
    sums = latest.groupBy("at").agg(F.sum("size").alias("s"))
    sums = sums.select("at", (F.sum("s").over(page.orderBy("at.chunk")) - F.col("s")).alias("before"), (F.sum("s").over(page) - 1).alias("umfang"), F.count("*").over(page).alias("chunks"))
    upto = F.sum("size").over(Window.partitionBy("at").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return latest.withColumn("upto", upto).join(sums, "at").select("at", (F.col("before") + F.col("upto") - F.col("size")).alias("von"), "text", "umfang", "chunks")


def pieces(lines: DataFrame, limit: int, overlap: int) -> DataFrame:
    """``buch_id``, ``seite``, ``teil``, ``von``, ``bis``, ``text``, ``umfang``.

    Every page gives its pieces, numbered from 0; one no larger than ``limit`` is
    one piece. A piece's offsets are those on its page. Pages without any text
    give none. Pages of one chunk and block are cut where they are; of others
    no task has more than a block, whatever the lines' lengths.
    """
    overlap, block = held(limit, overlap), limit * LIMITS
    src = laid_out(lines)
    near = (F.col("chunks") == 1) & (F.col("umfang") <= block)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("von", "text"))), lambda x: x["text"])
    whole = src.where(near).groupBy("at", "umfang").agg(F.array_join(parts, "\n").alias("text"))
    small = whole.where(F.col("umfang") <= limit).select("at.buch_id", "at.seite", F.lit(0).alias("teil"), F.lit(0).cast("bigint").alias("von"), F.col("umfang").alias("bis"), "text", "umfang")
    one = whole.where(F.col("umfang") > limit).select("at.buch_id", "at.seite", F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("ab"), "text", "umfang", F.lit(0).cast("bigint").alias("eingang"), F.lit(0).alias("erster"))
    # of a page of many blocks each has its own text and what stands beside it
    far = src.where(~near).withColumn("t", F.concat("text", F.lit("\n"))).withColumn("ende", F.least(F.col("von") + F.length("t"), F.col("umfang")))
    first = F.greatest(F.lit(0).cast("bigint"), F.floor((F.col("von") - limit - BESIDE) / block))
    far = far.select("at", "von", "ende", "t", "umfang", F.explode(F.sequence(first, F.least(F.floor((F.col("ende") + BESIDE) / block), F.floor((F.col("umfang") - 1) / block)))).alias("block"))
    lo, hi = F.greatest(F.col("von"), F.col("block") * block - BESIDE), F.least(F.col("ende"), (F.col("block") + 1) * block + limit + BESIDE)
    far = far.withColumn("lo", lo).withColumn("hi", hi).where("hi > lo").withColumn("t", F.substring("t", (F.col("lo") - F.col("von") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("lo", "t"))), lambda x: x["t"])
    blocks = far.groupBy(F.struct("at.buch_id", "at.seite").alias("page"), "block").agg(F.min("lo").alias("ab"), F.array_join(texts, "").alias("text"), F.first("umfang").alias("umfang"))
    kinds = dict(lines.dtypes)
    keys = f"buch_id {kinds['buch_id']}, seite {kinds['seite']}"

    def jumps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, steps = [], []
            for n, ab, text, size in zip(*(batch.column(c).to_pylist() for c in ("block", "ab", "text", "umfang"))):
                own = Jumps(text, ab, size, limit, overlap, (n + 1) * block)
                places = range(n * block, min(n * block + limit, size)) if n else range(1)
                got = [own.leave(p) for p in places]
                out.append([x for x, _ in got])
                steps.append([x for _, x in got])
            yield pa.RecordBatch.from_arrays([batch.column("buch_id"), batch.column("seite"), batch.column("block"), pa.array(out, pa.list_(pa.int64())), pa.array(steps, pa.list_(pa.int32()))], ["buch_id", "seite", "block", "raus", "zahl"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, entry, number = None, 0, 0
        for batch in batches:
            ins, firsts = [], []
            for a, b, n, out, steps in zip(*(c.to_pylist() for c in batch.columns)):
                if page != (a, b):
                    page, entry, number = (a, b), 0, 0
                ins.append(entry)
                firsts.append(number)
                at = entry - n * block
                if 0 <= at < len(out):
                    entry, number = out[at], number + steps[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ins, pa.int64()), pa.array(firsts, pa.int32())], ["buch_id", "seite", "block", "eingang", "erster"])

    flat = blocks.select("page.*", "block", "ab", "text", "umfang")
    way = flat.mapInArrow(jumps, f"{keys}, block bigint, raus array<bigint>, zahl array<int>")
    # a row per block: a few numbers for each place of the limit
    way = way.repartition("buch_id", "seite").sortWithinPartitions("buch_id", "seite", "block").mapInArrow(follow, f"{keys}, block bigint, eingang bigint, erster int")
    way = way.select(F.struct("buch_id", "seite").alias("page"), "block", "eingang", "erster")
    many = blocks.join(way, ["page", "block"]).select("page.*", "block", "ab", "text", "umfang", "eingang", "erster")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(5)]
            cols = (batch.column(c).to_pylist() for c in ("block", "ab", "text", "umfang", "eingang", "erster"))
            for i, (n, ab, text, size, entry, number) in enumerate(zip(*cols)):
                own = Jumps(text, ab, size, limit, overlap, (n + 1) * block)
                for k, (a, b) in enumerate(own.pieces(entry)):
                    for col, v in zip(rows, (i, number + k, a, b, text[a - ab : b - ab])):
                        col.append(v)
            at = pa.array(rows[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("buch_id").take(at), batch.column("seite").take(at), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.string()), batch.column("umfang").take(at)],
                ["buch_id", "seite", "teil", "von", "bis", "text", "umfang"],
            )

    columns = ["buch_id", "seite", "block", "ab", "text", "umfang", "eingang", "erster"]
    schema = f"{keys}, teil int, von bigint, bis bigint, text string, umfang bigint"
    return small.unionByName(one.select(*columns).mapInArrow(run, schema)).unionByName(many.select(*columns).mapInArrow(run, schema))


class Jumps:
    """The pieces that start in a block: ``text`` stands from ``ab`` on its page, the block ends at ``end``."""

    def __init__(self, text: str, ab: int, size: int, limit: int, overlap: int, end: int):
        self.ab, self.size, self.limit, self.overlap, self.end = ab, size, limit, overlap, end
        self.kinds = [[ab + x for x in own] for own in boundaries(text)]
        self.left: dict[int, tuple[int, int]] = {}

    def pieces(self, start: int) -> Iterator[tuple[int, int]]:
        while start < self.end and start >= 0:
            if self.size - start <= self.limit:
                yield start, self.size
                return
            end, then = step(self.kinds, start, self.limit, self.overlap)
            yield start, end
            start = then

    def leave(self, start: int) -> tuple[int, int]:
        """Where the first piece beyond the block starts, -1 if there is none, and the pieces before it."""
        path = []
        while start not in self.left:
            if start >= self.end:
                self.left[start] = start, 0
            elif self.size - start <= self.limit:
                self.left[start] = -1, 1
            else:
                path.append(start)
                start = step(self.kinds, start, self.limit, self.overlap)[1]
        for p in reversed(path):
            out, n = self.left[start]
            self.left[p] = out, n + 1
            start = p
        return self.left[start]
