"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are powers of two: as many of the context length
as fit, then the binary digits of the rest. A piece is a sequence of its own, and sequences of equal
length share a bucket, so no sequence crosses documents and none needs padding. The plan is one narrow
pass: tokens are made once and nothing is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTEXT = 2048
#: Characters of text that a worker tokenizes at a time; longer texts go alone.
TEXT_BLOCK = 1 << 20
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """Byte-level BPE from the vocabulary of a tokenizer file.

    Its ids are in the order of its merges, so the ids serve as merge ranks and give the tokenizer's own
    ids several times faster; a test holds them against the tokenizer. Strings of special tokens are
    ordinary text.
    """
    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)
    added = model.get("added_tokens", [])
    if odd := [x["content"] for x in added if x.get("single_word") or x.get("lstrip") or x.get("rstrip")]:
        raise ValueError(f"added tokens that match more or less than their string: {odd}")
    special = {x["content"]: x["id"] for x in added}
    # Fixed rule of byte-level vocabularies: printable bytes stand for themselves, others for 256 and up.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in printable}
    to_byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    ranks = {bytes(to_byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def piece_lengths(n: int, context: int = CONTEXT) -> list[int]:
    """Binary lengths that add up to ``n``, longest first."""
    whole, rest = divmod(n, context)
    return [context] * whole + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _cut(vocabulary: str | None, context: int, end_id: int, added_tokens: bool):
    names = ["doc_id", "start", "length", "doc_tokens", "ids"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def flush(rows: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(vocabulary or tokenizer_path())
        encode = partial(model.encode, allowed_special="all") if added_tokens else model.encode_ordinary
        rows, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4").tobytes()
                n, start = len(ids) // 4, 0
                for length in piece_lengths(n, context):
                    rows.append((doc_id, start, length, n, ids[4 * start : 4 * (start + length)]))
                    start += length
                held += len(ids)
                if held > TEXT_BLOCK:
                    yield flush(rows)
                    rows, held = [], 0
        yield flush(rows)

    return run


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
    context: int = CONTEXT, end_id: int = 1, added_tokens: bool = False,
) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, ids, sequence_id, offset, bucket), one sequence each.

    ``ids`` is the piece's tokens as little-endian unsigned 32-bit integers; ``end_id`` closes each
    document. ``vocabulary`` is the tokenizer's file (on every executor); by default the installed one.
    With ``added_tokens`` a string of one of the file's added tokens is that token, as it is to the
    tokenizer as loaded; without, it is ordinary text.
    Null and empty texts are documents of one token. Every row is a document of its own, also if it
    repeats another or its doc_id is null; ids of sequences are unique, gaps between them mean nothing.
    Other columns are ignored; an empty table gives no pieces. ``context`` must be a power of two.
    """
    if context < 1 or context & (context - 1):
        raise ValueError("context must be a power of two")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = rows.mapInArrow(_cut(vocabulary, context, end_id, added_tokens), "doc_id long, start long, length long, doc_tokens long, ids binary")
    return pieces.withColumns(
        {"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.log2("length").cast("int")}
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Writes sequences with a folder for each length, as a loader of equal lengths reads them."""
    pieces.write.partitionBy("bucket").parquet(path)
