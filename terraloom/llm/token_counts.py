"""Token counts: pieces are counted once per distinct pre-token and joined to the frequencies.

Documents are read in chunks. A chunk gives one row per distinct pre-token with its postings
(document's place in the chunk, frequency). Rows of one pre-token meet in one partition, sorted, so
that the library counts its pieces once and the count is joined to all its postings; the sums
travel back per chunk, as pairs of place and sum. Token ids are never materialised. A document adds at most one posting to a
pre-token, so no pre-token holds more than its share of documents.

The rows must come in the same order when a task is rerun, as they do from a table.
"""

from __future__ import annotations

import os
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm import common

#: Documents of a chunk; bounds what a task holds.
CHUNK_DOCS = 4096
#: Characters of a chunk, after which it ends.
CHUNK_CHARS = 9 << 20
#: Counted postings that a task holds before it sums them by document and passes the sums on.
HELD = 2 << 20

#: The split of byte-level BPE before merges: fixed values of the vocabulary's format.
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{common.SPACE}\p{{L}}\p{{N}}]+|[{common.SPACE}]+(?![^{common.SPACE}])|[{common.SPACE}]+"
)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    ids: list = []
    texts: list[str] = []
    held = 0
    for batch in common.arrow_rows(batches, 256):
        for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids.append(doc_id)
            texts.append(text)
            held += len(texts[-1])
            if len(ids) >= CHUNK_DOCS or held >= CHUNK_CHARS:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _rows_of(places: np.ndarray, starts: np.ndarray, width: int) -> pa.Array:
    """One binary value per range of a typed array, without a copy of its own for each."""
    offsets = pa.py_buffer((starts * width).astype("<i4"))
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, offsets, pa.py_buffer(places)])


def _postings(special: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(SPLIT)
        apart = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        part = TaskContext.get().partitionId()
        for number, (ids, texts) in enumerate(_chunks(batches)):
            chunk = (part << 24) + number
            numbers: defaultdict = defaultdict()
            numbers.default_factory = numbers.__len__
            found, ends = array("i"), []
            for text in texts:
                if apart is None or not any(mark in text for mark in special):
                    found.extend(map(numbers.__getitem__, split.findall(text)))
                else:
                    for piece in apart.split(text):
                        own = [piece] if piece in special else split.findall(piece)
                        found.extend(map(numbers.__getitem__, own))
                ends.append(len(found))
            # In place: this is the largest array of the task.
            pairs = np.array(found, np.int64)
            del found
            pairs *= CHUNK_DOCS
            pairs += np.repeat(np.arange(len(ends), dtype=np.int16), np.diff(ends, prepend=0))
            pairs.sort()
            new = np.ones(len(pairs), bool)
            np.not_equal(pairs[1:], pairs[:-1], out=new[1:])
            first_of = np.flatnonzero(new)
            times = np.diff(first_of, append=len(pairs))
            pairs = pairs[first_of]
            # Frequencies take one byte; larger ones several postings.
            copies = (times + 254) // 255
            bounded = np.full(int(copies.sum()), 255, "<u1")
            bounded[np.cumsum(copies) - 1] = times - 255 * (copies - 1)
            pairs = np.repeat(pairs, copies)
            del times, copies, first_of
            places = (pairs % CHUNK_DOCS).astype("<u2")
            pairs //= CHUNK_DOCS
            tokens = list(numbers)
            starts = np.searchsorted(pairs, np.arange(len(tokens) + 1))
            del pairs
            for first in range(0, len(tokens), 20_000):
                some = tokens[first : first + 20_000]
                own = starts[first : first + len(some) + 1]
                low, high = own[0], own[-1]
                yield pa.record_batch(
                    [
                        pa.array(some, pa.string()),
                        pa.array(np.full(len(some), chunk)),
                        _rows_of(places[low:high], own - low, 2),
                        _rows_of(bounded[low:high], own - low, 1),
                    ],
                    ["token", "chunk", "places", "times"],
                )
            # The chunk's own row: which document stands at which place. No pre-token is empty.
            sizes = np.array([len(t.encode()) for t in texts], "<i8").tobytes()
            real = np.array([-1 if i is None else 0 for i in ids], "<i8").tobytes()
            known = np.array([i or 0 for i in ids], "<i8").tobytes()
            own_row = [[""], [chunk], [known + sizes + real], [b""]]
            kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.record_batch(
                [pa.array(v, k) for v, k in zip(own_row, kinds, strict=True)],
                ["token", "chunk", "places", "times"],
            )
            del numbers, tokens, places, bounded, starts, texts
            common.give_back_memory()

    return run


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, bytes]:
    """Length of each value, and all values in a row."""
    column = column.cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], "<i4", len(column) + 1, 4 * column.offset)
    return np.diff(ends), memoryview(column.buffers()[2] or b"")[ends[0] : ends[-1]]


def _sums(keys: np.ndarray, added: np.ndarray) -> pa.RecordBatch:
    """By chunk: the places that hold a sum, and the sums. A key is a chunk and a place in it."""
    order = np.argsort(keys)
    keys = keys[order]
    first_of = np.flatnonzero(np.diff(keys, prepend=-1))
    totals = np.add.reduceat(added[order], first_of).astype("<u4")
    keys = keys[first_of]
    places, chunks = (keys % CHUNK_DOCS).astype("<u2"), keys // CHUNK_DOCS
    cuts = np.append(np.flatnonzero(np.diff(chunks, prepend=-1)), len(chunks)).tolist()
    rows = [places[a:b].tobytes() + totals[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
    return pa.record_batch(
        [
            pa.array(chunks[cuts[:-1]], pa.int64()),
            pa.array([False] * len(rows), pa.bool_()),
            pa.array(rows, pa.binary()),
        ],
        ["chunk", "is_list", "row"],
    )


@lru_cache(maxsize=1)
def _loaded(tokenizer_file: str, changed: int, size: int):
    """The tokenizer of a file, once per worker: the library's threads keep caches of every tokenizer
    that encodes batches, some 35 MB each, also after it is gone.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _summed(tokenizer_file: str, special: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = os.stat(tokenizer_file)
        tokenizer = _loaded(tokenizer_file, state.st_mtime_ns, state.st_size)
        keys, added, held = [], [], 0
        last, pieces = None, 0
        for batch in common.arrow_rows(batches, 10_000):
            listed = np.array([t == "" for t in batch.column(0).to_pylist()], bool)
            own = batch.filter(pa.array(listed))
            lists = list(zip(own.column(1).to_pylist(), own.column(2).to_pylist(), strict=True))
            batch = batch.filter(pa.array(~listed))
            tokens = batch.column(0).to_pylist()
            new = [t for t in dict.fromkeys(tokens) if t != last]
            coded = tokenizer.encode_batch_fast(new, add_special_tokens=False)
            pieces_of = dict(zip(new, map(len, coded), strict=True))
            pieces_of.setdefault(last, pieces)
            if tokens:
                last, pieces = tokens[-1], pieces_of[tokens[-1]]
                # The join: each posting meets the count of its pre-token; sums go by place.
                sizes, flat = _bytes_of(batch.column(2))
                _, frequencies = _bytes_of(batch.column(3))
                sizes //= 2
                ends = np.cumsum(sizes)
                counted = np.array([pieces_of[t] for t in tokens], "<i8")
                chunks = np.asarray(batch.column(1)) * CHUNK_DOCS
            first = 0
            while first < len(tokens):
                # Common pre-tokens have thousands of postings a row: so many rows as there is room for.
                start = int(ends[first - 1]) if first else 0
                past = max(first + 1, int(np.searchsorted(ends, start + HELD - held, "right")))
                rows, own = slice(first, past), slice(start, int(ends[past - 1]))
                keys.append(chunks[rows].repeat(sizes[rows]) + np.frombuffer(flat, "<u2")[own])
                added.append(counted[rows].repeat(sizes[rows]) * np.frombuffer(frequencies, "<u1")[own])
                held += len(keys[-1])
                first = past
                if held >= HELD or first < len(tokens):
                    yield _sums(np.concatenate(keys), np.concatenate(added))
                    keys, added, held = [], [], 0
            if lists:
                yield pa.record_batch(
                    [
                        pa.array([c for c, _ in lists], pa.int64()),
                        pa.array([True] * len(lists), pa.bool_()),
                        pa.array([r for _, r in lists], pa.binary()),
                    ],
                    ["chunk", "is_list", "row"],
                )
        if held:
            yield _sums(np.concatenate(keys), np.concatenate(added))
        del keys, added
        common.give_back_memory()

    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a chunk follow each other: its list and its sums in any number."""

    def out(listed: bytes, total: np.ndarray) -> pa.RecordBatch:
        ids, sizes, real = np.frombuffer(listed, "<i8").reshape(3, -1)
        return pa.record_batch(
            [
                pa.array(ids, pa.int64(), mask=real < 0),
                pa.array(sizes, pa.int64()),
                pa.array(total[: len(ids)], pa.int64()),
            ],
            ["doc_id", "n_bytes", "n_tokens"],
        )

    now, listed, total = None, b"", np.zeros(CHUNK_DOCS, "<i8")
    for batch in batches:
        for chunk, is_list, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if chunk != now:
                if now is not None:
                    yield out(listed, total)
                now, listed, total = chunk, b"", np.zeros(CHUNK_DOCS, "<i8")
            if is_list:
                listed = row
            else:
                n = len(row) // 6
                total[np.frombuffer(row, "<u2", n)] += np.frombuffer(row, "<u4", n, 2 * n)
    if now is not None:
        yield out(listed, total)


def count_tokens(docs: DataFrame, tokenizer_file: str, special: list[str]) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row, as the tokenizers library counts whole texts.

    `tokenizer_file` is a byte-level BPE file; `special` lists its special strings, which the
    library takes as one token inside texts. Null texts count as empty (0 tokens); repeated rows
    and repeated or null ids give one row each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = common.tasks(spark)
    postings = common.id_and_text(docs).mapInArrow(
        _postings(special), "token string, chunk long, places binary, times binary"
    )
    # The chunks' own rows share an empty pre-token; they are dealt by chunk instead.
    dealt = F.xxhash64("token", F.when(F.col("token") == "", F.col("chunk")))
    sums = (
        postings.repartition(parts, dealt)
        .sortWithinPartitions("token")
        .mapInArrow(
            _summed(tokenizer_file, special),
            "chunk long, is_list boolean, row binary",
        )
    )
    return (
        sums.repartition(parts, "chunk")
        .sortWithinPartitions("chunk")
        .mapInArrow(_documents, "doc_id long, n_bytes long, n_tokens long")
    )
