"""Sizes of texts in tokens of a public byte-level vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windrow.ship import map_arrow

#: Default vocabulary; another rank file of the same kind may be named instead.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how a text is split before the merges of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters after which a long text is handed on in a further part, at the next single space.
PART = 200_000

_encoders: dict[str, object] = {}


def encoder(vocabulary: str = VOCABULARY):
    """The encoder of a rank file; one per worker."""
    if vocabulary not in _encoders:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[vocabulary] = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in parts that are cut before a space between two words, where the pattern splits it too."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) - 1 and not (text[cut] == " " and text[cut - 1].isalnum() and text[cut + 1].isalnum()):
            cut += 1
        if cut >= len(text) - 1:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def count_tokens(text: str | None, vocabulary: str = VOCABULARY) -> int:
    """Tokens of the whole text; 0 for null."""
    if not text:
        return 0
    encode = encoder(vocabulary).encode_ordinary
    return sum(len(encode(x)) for x in parts(text))


def token_sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, source, tokens) of every row; source as written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [count_tokens(t, vocabulary) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("source"), pa.array(sizes, pa.int64())], names=["id", "source", "tokens"])

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, "id bigint, source string, tokens bigint")
