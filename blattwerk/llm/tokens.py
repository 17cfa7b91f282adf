"""Token counts by a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Byte-level BPE for many languages, by tiktoken.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The tokenizer gets no longer stretch at once; one beyond it is cut at a blank.
STRETCH = 100_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=4)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def stretches(text: str) -> Iterator[str]:
    """``text`` in stretches that end before a blank, where there is one."""
    while len(text) > STRETCH:
        at = text.rfind(" ", 1, STRETCH)
        at = at if at > 0 else STRETCH
        yield text[:at]
        text = text[at:]
    yield text


def count(text: str | None, path: str) -> int:
    return sum(len(encoding(path).encode_ordinary(s)) for s in stretches(text)) if text else 0


def count_tokens(documents: DataFrame, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the number of tokens of the whole text.

    Null and empty texts have none.
    """
    path = path or default_path()
    kinds = dict(documents.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [count(t, path) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n, pa.int64())], [*keep, "tokens"])

    return documents.select(*keep, F.col(f"`{text}`").alias("__t")).mapInArrow(run, schema)
