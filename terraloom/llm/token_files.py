"""Token-id files: flat unsigned integers plus 64-bit document offsets, read by memory map.

A written set is a folder with, for each part, `part-NNNNN.ids` (little-endian ids, one after the
other), `part-NNNNN.offsets` (n + 1 little-endian 64-bit offsets into the part, in ids) and
`part-NNNNN.docs` (n 64-bit document ids). Parts hold ascending ranges of doc_id. A part's base,
the ids in all parts before it, is the prefix sum of the parts' counts; the counts are one row per
part. A task writes under a name of its own attempt and renames at the end, and only parts named by
the successful attempt are read, so lost executors and repeated tasks leave no wrong part behind.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraloom.llm import common
from terraloom.operators.storage import shared_folder

#: Distinct words of each of the two generations that a worker keeps.
KEPT_WORDS = 250_000
#: Documents of one pass over a part.
STEP = 500
#: Stands for a null doc_id in the .docs files: no id can be this one and sort first as well.
NULL_ID = -(1 << 63)

_MANIFEST = "part int, name string, n_docs long, n_tokens long, low long"


#: Words of one call to the library.
JOINED = 64
_LETTERS = re.compile(rb"[a-z]+")
#: Cases, runs of white space, accents, digits and signs: what tokenizers of other kinds treat otherwise.
_PROBE = "Hello World  again\n\tÉTÉ été's 12,345 (a-b) <x> aB\u3000c  "


class WordIds:
    """Ids of words as little-endian unsigned 32-bit integers, kept for the worker's next tasks.

    For a tokenizer that lower-cases, drops white space and never joins words over it: ASCII white
    space then splits a text where the library splits it too, so that a distinct word is encoded
    once as long as it is kept. Two generations of at most KEPT_WORDS words each are held.
    """

    def __init__(self, tokenizer_file: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        whole = self.tokenizer.encode(_PROBE, add_special_tokens=False).ids
        if self.encode(_PROBE) != np.array(whole, "<u4").tobytes():
            raise ValueError(f"{tokenizer_file} is no tokenizer of words in lower case: {_PROBE!r} differs")

    def encode(self, text: str) -> bytes:
        raw = text.encode()
        # Special strings are matched before letters are lowered, so those texts keep their case.
        words = (raw if any(m[:2] in text for m in self.special) else raw.lower()).split()
        distinct = set(words)
        if len(self.new) > KEPT_WORDS:
            self.old, self.new = self.new, {}
        new = self.new
        missing = distinct.difference(new)
        if missing:
            unknown = []
            for word in missing:
                ids = self.old.get(word)
                if ids is None:
                    unknown.append(word)
                else:
                    new[word] = ids
            self._encode(unknown)
        return b"".join(map(new.__getitem__, words))

    def _encode(self, words: list[bytes]) -> None:
        rest = []
        model = self.tokenizer.model
        for word in words:
            if _LETTERS.fullmatch(word):  # one pre-token, whose bytes stand for themselves
                ids = [t.id for t in model.tokenize(word.decode())]
                self.new[word] = np.array(ids, "<u4").tobytes()
            else:
                rest.append(word)
        for start in range(0, len(rest), JOINED):
            part = rest[start : start + JOINED]
            names = [w.decode() for w in part]
            ends = np.cumsum([len(n) + 1 for n in names])
            coded = self.tokenizer.encode(" ".join(names), add_special_tokens=False)
            ids = np.array(coded.ids, "<u4")
            at = np.array([a for a, _ in coded.offsets], "<i8")
            cuts = [0, *np.searchsorted(at, ends, "left").tolist()]
            for k, word in enumerate(part):
                self.new[word] = ids[cuts[k] : cuts[k + 1]].tobytes()


@lru_cache(maxsize=1)
def _word_ids(tokenizer_file: str) -> WordIds:
    return WordIds(tokenizer_file)


def _files(folder: str):
    """The file system and path of a folder that executors share."""
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


def _writer(tokenizer_file: str, end_id: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(tokenizer_file)
        wide = is_wide(words.tokenizer, end_id)
        files, at = _files(folder)
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{uuid4().hex[:8]}"
        path = f"{at}/{name}"
        end = np.array([end_id], "<u4").tobytes()
        total = docs = 0
        low = None
        out = None
        for batch in common.arrow_rows(batches, STEP):
            if out is None:
                files.create_dir(at)
                out = [files.open_output_stream(f"{path}.{x}") for x in ("ids", "offsets", "docs")]
                low = batch.column(0)[0].as_py()
            rows = []
            for text in batch.column(1).to_pylist():
                rows.append(words.encode(text) + end)
            sizes = np.array([len(r) // 4 for r in rows], "<i8")
            ids = np.frombuffer(b"".join(rows), "<u4")
            out[0].write(ids.tobytes() if wide else ids.astype("<u2").tobytes())
            out[1].write((total + np.cumsum(sizes) - sizes).astype("<i8").tobytes())
            out[2].write(np.asarray(batch.column(0).fill_null(NULL_ID), "<i8").tobytes())
            total += int(sizes.sum())
            docs += len(rows)
        if out is not None:
            out[1].write(np.array([total], "<i8").tobytes())
            for stream in out:
                stream.close()
            yield pa.record_batch(
                [
                    pa.array([context.partitionId()], pa.int32()),
                    pa.array([name], pa.string()),
                    pa.array([docs], pa.int64()),
                    pa.array([total], pa.int64()),
                    pa.array([low], pa.int64()),
                ],
                ["part", "name", "n_docs", "n_tokens", "low"],
            )

    return run


def write(docs: DataFrame, tokenizer_file: str, end_id: int, name: str) -> DataFrame:
    """Write the files in ascending doc_id order; the manifest with each part's base.

    Returns part, name, n_docs, n_tokens, low, base. One row per part: as many as the shuffle has
    partitions, whatever the number of documents.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/terraloom/{name}-{uuid4().hex}"
    # The second key deals copies of one id and fixes their order.
    keys = [F.col("doc_id"), F.xxhash64("text")]
    parts = (
        common.id_and_text(docs)
        .repartitionByRange(common.tasks(spark), *keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(_writer(tokenizer_file, end_id, folder), _MANIFEST)
        .collect()
    )
    base = 0
    rows = []
    for row in sorted(parts, key=lambda r: r.part):
        rows.append((*row, base, folder))
        base += row.n_tokens
    return spark.createDataFrame(rows, _MANIFEST + ", base long, folder string")


def _reader(wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, at = _files(row["folder"])
                path = f"{at}/{row['name']}"
                ids = _mapped(files, f"{path}.ids", "<u4" if wide else "<u2")
                offsets = _mapped(files, f"{path}.offsets", "<i8")
                docs = _mapped(files, f"{path}.docs", "<i8")
                for start in range(0, len(docs), STEP):
                    cut = offsets[start : start + STEP + 1]
                    crc = [
                        zlib.crc32(ids[a:b].astype("<u4").tobytes())
                        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)
                    ]
                    own = docs[start : start + STEP]
                    yield pa.record_batch(
                        [
                            pa.array(own, pa.int64(), mask=own == NULL_ID),
                            pa.array(row["base"] + cut[:-1], pa.int64()),
                            pa.array(np.diff(cut), pa.int64()),
                            pa.array(crc, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return run


def _mapped(files, path: str, kind: str) -> np.ndarray:
    """A memory map where the file system is local; else the file's bytes."""
    from pyarrow import fs

    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with files.open_input_file(path) as held:
        return np.frombuffer(held.readall(), kind)


def read_back(manifest: DataFrame, wide: bool) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files; `wide`: 32-bit ids."""
    parts = max(1, min(common.tasks(manifest.sparkSession), manifest.count()))
    return manifest.repartition(parts, "part").mapInArrow(
        _reader(wide), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def is_wide(tokenizer, end_id: int) -> bool:
    """Whether the vocabulary's largest id, or the end id, needs 32 bits."""
    return max(tokenizer.get_vocab_size(), end_id + 1) > 1 << 16


def round_trip(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """Write the token files of all rows and read every document's digest back from them.

    A null text is empty and gives the end id alone. Null ids come first; repeated ids follow each
    other, ordered by a hash of their text. An empty table writes no part and gives no rows.
    """
    from tokenizers import Tokenizer

    manifest = write(docs, tokenizer_file, end_id, "token-files")
    return read_back(manifest, is_wide(Tokenizer.from_file(tokenizer_file), end_id))
