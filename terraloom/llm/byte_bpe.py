"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are split before encoding where no match of the pre-token pattern can cross: the pieces
then give the same ids as the whole, and few calls see more than some ten thousand characters. A long
run of white space is cut by rule, because the library's pattern engine recurses over it: the pattern
takes the run as one match, but for its last character where something follows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from terraloom.llm import common

#: Characters that a piece of a long text has at least.
PIECE = 16_384
#: A letter, then one space, then a letter: the pattern's match ends before the space, whatever
#: stands around, for no branch goes on from a letter over a space.
_SAFE = re.compile(r"[A-Za-z](?= [A-Za-z])")
#: A run of white space that is cut out of the text and encoded as the match that it is.
_LONG_SPACE = re.compile(rf"[{common.SPACE}]{{{PIECE},}}")


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """Parts of `text`, cut only at safe boundaries; a text without any stays whole."""
    start = 0
    while len(text) - start > 2 * size:
        found = _SAFE.search(text, start + size)
        if found is None:
            break
        yield text[start : found.end()]
        start = found.end()
    yield text[start:]


@lru_cache(maxsize=2)
def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file, without special tokens; once per worker."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        rank_file, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
    )


def encode(coder, text: str) -> list[int]:
    ids: list[int] = []

    def take(part: str) -> None:
        for piece in pieces(part):
            ids.extend(coder.encode_ordinary(piece))

    start = 0
    for run in _LONG_SPACE.finditer(text) if len(text) >= PIECE else ():
        take(text[start : run.start()])
        # No match goes on from other characters into white space.
        start = run.end() - (run.end() < len(text))
        ids.extend(coder._encode_single_piece(text[run.start() : start]))
    take(text[start:])
    return ids


def with_tokens(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int), decoded (binary) of every row.

    A null text is empty: no ids and no bytes. Decoding works on raw bytes, so ids that split a
    character still give the text's bytes. Whole texts of any length and content are encoded.
    Repeated rows give one row each, a null doc_id stays null, other columns are not read, and an
    empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(rank_file, pattern)
        for batch in common.arrow_rows(batches, 200):
            ids = [encode(coder, t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array([coder.decode_bytes(x) for x in ids], pa.binary()),
                ],
                ["doc_id", "ids", "decoded"],
            )

    return common.id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: `with_tokens` as digests made in the task, with
    the same results for nulls, empty and long texts, repeated rows and empty tables.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(rank_file, pattern)
        for batch in common.arrow_rows(batches, 1000):
            sizes, first, second = [], [], []
            for text in batch.column(1).to_pylist():
                ids = encode(coder, text)
                sizes.append(len(ids))
                first.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                second.append(hashlib.sha256(coder.decode_bytes(ids)).hexdigest())
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(first, pa.string()),
                    pa.array(second, pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return common.id_and_text(docs).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
