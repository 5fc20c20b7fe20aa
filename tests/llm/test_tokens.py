"""Token files, byte-level BPE and token counts against the libraries, on whole texts."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from terraloom.llm import byte_bpe, token_counts, token_files

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def sorted_rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def test_byte_bpe_equals_the_library(docs, no_docs, library):
    expected = []
    for doc_id, text in docs.select("doc_id", "text").collect():
        ids = library.encode_ordinary(text or "")
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        expected.append((doc_id, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest()))
    found = byte_bpe.digests(docs, RANKS, public_tokenizers.PATTERN)
    assert sorted_rows(found) == sorted(expected, key=str)
    assert byte_bpe.digests(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_round_trip(docs):
    tokens = byte_bpe.with_tokens(docs, RANKS, public_tokenizers.PATTERN)
    texts = Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in tokens.collect()) == texts


def test_pieces_join_to_the_text_and_its_ids(library):
    text = "It's 5 o'clock  in   the town, isn't it? " * 500 + "x" * 3000 + " done \n\n end"
    parts = list(byte_bpe.pieces(text, 100))
    assert len(parts) > 50 and "".join(parts) == text
    assert [i for p in parts for i in library.encode_ordinary(p)] == library.encode_ordinary(text)
    assert list(byte_bpe.pieces("9" * 100_000, 100)) == ["9" * 100_000]


def plain_encode(coder, text):
    """Matches of the pattern one by one, by the rule for white space; no engine recurses here."""
    import regex

    ids, at = [], 0
    words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+")
    while at < len(text):
        match = words.match(text, at)
        end = match.end() if match else at
        if match is None:
            while end < len(text) and text[end].isspace():
                end += 1
            end -= end < len(text) and end - at > 1
        ids += coder._encode_single_piece(text[at:end])
        at = end
    return ids


@pytest.mark.parametrize("size", [16_383, 16_384, 16_385, 50_000])
@pytest.mark.parametrize("unit", [" ", "\n", " \n\t", "\u3000 "])
def test_long_white_space_equals_the_rule(library, unit, size):
    run = (unit * size)[:size]
    for text in (run, "a" + run, run + "b", "It's" + run + "5" + run + "?!" + run, run + "é" + unit):
        ids = byte_bpe.encode(library, text)
        assert ids == plain_encode(library, text) == library.encode_ordinary(text)
        assert library.decode_bytes(ids).decode() == text


@pytest.mark.parametrize("size", [1_000_000, 5_000_000])
@pytest.mark.parametrize("unit", [" ", "\n", " \t\n", "a", "7", "!", "字", " a"])
def test_very_long_texts_do_not_crash(library, unit, size):
    text = (unit * size)[:size]
    for whole in (text, "x" + text + "y"):
        assert library.decode_bytes(byte_bpe.encode(library, whole)).decode() == whole


def test_token_counts_equal_the_library(docs, no_docs, monkeypatch):
    tokenizer = Tokenizer.from_file(BYTES)
    expected = []
    for doc_id, text in docs.select("doc_id", "text").collect():
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        expected.append((doc_id, len((text or "").encode()), n))
    found = token_counts.count_tokens(docs, BYTES, ["<|endoftext|>"])
    assert sorted_rows(found) == sorted(expected, key=str)
    assert token_counts.count_tokens(no_docs, BYTES, ["<|endoftext|>"]).count() == 0


@pytest.mark.parametrize("held", [1, 50, 1 << 20])
def test_token_counts_over_chunks_and_high_frequencies(spark, monkeypatch, held):
    monkeypatch.setattr(token_counts, "HELD", held)
    tokenizer = Tokenizer.from_file(BYTES)
    texts = ["a " * n + f"tail{n}" for n in (1, 254, 255, 256, 511, 3000)] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(token_counts, "CHUNK_CHARS", 1000)
    found = token_counts.count_tokens(docs, BYTES, ["<|endoftext|>"])
    expected = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in found.collect()} == expected


def test_split_equals_the_library():
    import regex

    tokenizer = Tokenizer.from_file(BYTES)
    split = regex.compile(token_counts.SPLIT)
    for text in ["a  b c　 d", "x\x1cy \x1d z", "'ll I'LL don't", "\n\n a\t\tb ", "1² ½ é́"]:
        pieces = tokenizer.pre_tokenizer.pre_tokenize_str(text)
        assert [text[a:b] for _, (a, b) in pieces] == split.findall(text)


def test_workers_do_not_grow_with_the_tasks_that_count():
    """A task's tokenizer must not stay behind: some 35 MB did, until an executor was stopped."""

    def held():
        with open("/proc/self/smaps_rollup") as lines:
            return sum(int(x.split()[1]) for x in lines if x.startswith("Pss_Anon:")) // 1024

    numbers = range(100_000)
    words = pa.record_batch(
        [
            pa.array([f" w{hex(n * n)[2:]}" for n in numbers]),
            pa.array([0 for _ in numbers], pa.int64()),
            pa.array([b"\0\0" for _ in numbers], pa.binary()),
            pa.array([b"\1" for _ in numbers], pa.binary()),
        ],
        ["token", "chunk", "places", "times"],
    )
    sizes, results = [], set()
    for _ in range(8):
        found = [b.to_pydict() for b in token_counts._summed(BYTES, [])(iter([words]))]
        results.add(sum(np.frombuffer(r[2:], "<u4")[0] for b in found for r in b["row"]))
        sizes.append(held())
    assert len(results) == 1 and sizes[-1] - sizes[1] < 60, sizes


def test_token_files(docs, no_docs):
    tokenizer = Tokenizer.from_file(WORDS)
    found = token_files.round_trip(docs, WORDS, 1).collect()
    rows = docs.select("doc_id", "text").collect()
    expected = Counter()
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        expected[doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == expected
    # Starts follow each other in doc_id order, null ids first.
    ordered = sorted(found, key=lambda r: r.start)
    assert [r.start for r in ordered] == [0, *np.cumsum([r.n_tokens for r in ordered])[:-1].tolist()]
    known = [r.doc_id for r in ordered]
    assert known == sorted(known, key=lambda i: (i is not None, i or 0))
    assert token_files.round_trip(no_docs, WORDS, 1).count() == 0


def test_token_files_are_flat_and_narrow(docs, spark):
    manifest = token_files.write(docs, WORDS, 1, "test-files").collect()
    for part in manifest:
        path = f"{part.folder.removeprefix('file://')}/{part['name']}"
        offsets = np.memmap(f"{path}.offsets", "<i8", "r")
        ids = np.memmap(f"{path}.ids", "<u2", "r")  # 49,408 ids fit 16 bits
        assert len(offsets) == part.n_docs + 1 and offsets[0] == 0
        assert offsets[-1] == part.n_tokens == len(ids)
    assert sum(p.n_docs for p in manifest) == docs.count()


@pytest.mark.parametrize("text", ["Straße İstanbul ΣΑΣ", "<|endoftext|>", "<|ENDOFTEXT|> a", "x\x1cy", "éa"])
def test_word_ids_equal_the_library(text):
    ids = token_files.WordIds(WORDS)
    expected = Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids.encode(text), "<u4").tolist() == expected


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="no tokenizer of words"):
        token_files.WordIds(BYTES)


def test_word_ids_forget_in_generations(monkeypatch):
    monkeypatch.setattr(token_files, "KEPT_WORDS", 3)
    ids = token_files.WordIds(WORDS)
    library = Tokenizer.from_file(WORDS)
    for text in ["a b c d e", "a x y z", "b c, d. é", "a b c d e"]:
        assert np.frombuffer(ids.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
