"""Source divergence audit: how each source's use of its language's terms departs from the others'.

1. Terms of every text are counted once per document; a language keeps those in enough documents.
2. The kept terms, sorted, are cut into shards; each shard becomes a minimal acyclic transducer that
   gives a term its lexicographic ordinal in the language.
3. The terms of all texts, summed per chunk of texts, stream through their shard's transducer, which
   drops what is not kept and turns the rest into ordinals; sums by ordinal are the counts.
4. Integer shares and divergences follow from the counts; ordinals break ties in term order.

The counts must be exact, so shares p = 1 + floor(10^9 (count + 1) / (N + V)) use long division in
steps of a thousand (N + V below 9 * 10^15), and sums of floor((p - q)^2 / q) fit 64 bits while a
language keeps fewer than 10^9 terms.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm import common
from terraloom.llm.transducer import Transducer
from terraloom.operators.storage import written

#: A language keeps the terms of at least this many of its documents.
LEAST_DOCS = 3
#: Ranks that the term part reports.
TOP_TERMS = 200
#: Parts of a whole that shares are floored to.
WHOLE = 1_000_000_000

#: Terms of a shard at most, which bounds a transducer's size. Directory rows follow: one a shard.
SHARD_TERMS = 65_536
#: Terms that a task sums up before it sends the sums on, and pairs looked at together: array sizes
#: only, results do not depend on them.
CHUNK_TERMS = 4_000_000
BATCH_PAIRS = 1_000_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Letters and everything beyond ASCII: in UTF-8 all bytes from 0x80 on.
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def terms_of(text: pa.Scalar) -> list[bytes]:
    return _TERM.findall(text.as_buffer().to_pybytes().translate(_LOWER))


def _read(docs: DataFrame) -> DataFrame:
    blank = F.lit("")
    return docs.select(
        F.coalesce(docs["lang"], blank).alias("lang"),
        F.coalesce(docs["source"], blank).alias("source"),
        common.text_of(docs).alias("text"),
    )


def _numbers() -> defaultdict:
    """A dictionary that numbers its keys in the order in which they are first asked for."""
    numbers: defaultdict = defaultdict()
    numbers.default_factory = numbers.__len__
    return numbers


def kept_terms(texts: DataFrame) -> DataFrame:
    """lang, term (binary), chunks: terms of enough documents, and how many partial sums held them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, defaultdict] = defaultdict(_numbers)
        found: dict[str, array] = defaultdict(lambda: array("i"))
        held = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, own in numbers.items():
                docs = np.bincount(np.frombuffer(found[lang], np.int32), minlength=len(own))
                yield pa.record_batch(
                    [
                        pa.DictionaryArray.from_arrays(np.zeros(len(own), np.int8), [lang]).cast("string"),
                        pa.array(own.keys(), pa.binary()),
                        pa.array(docs.astype(np.int64)),
                    ],
                    ["lang", "term", "docs"],
                )

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                terms = set(terms_of(text))
                found[lang].extend(map(numbers[lang].__getitem__, terms))
                held += len(terms)
                if held >= CHUNK_TERMS:
                    yield from sent()
                    numbers.clear()
                    found.clear()
                    held = 0
        yield from sent()
        numbers.clear()
        found.clear()
        common.give_back_memory()

    partial = texts.select("lang", "text").mapInArrow(run, "lang string, term binary, docs long")
    summed = partial.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.count(F.lit(1)).alias("chunks")
    )
    return summed.filter(F.col("docs") >= LEAST_DOCS).select("lang", "term", "chunks")


def shards_of(kept: DataFrame, weight_limit: int) -> DataFrame:
    """lang, shard, weight, blob, terms: ascending ranges of a language's terms with transducers.

    A shard ends at SHARD_TERMS terms, or when its partial sums exceed `weight_limit`, so that no
    shard draws much more of the stream than another. Shard numbers ascend with the terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        lang, terms, weight = None, [], 0

        def sent() -> pa.RecordBatch:
            blob = Transducer.of(terms).to_bytes()
            return pa.record_batch(
                [
                    pa.array([lang]),
                    pa.array([number], pa.int64()),
                    pa.array([weight], pa.int64()),
                    pa.array([blob], pa.binary()),
                    pa.array([terms], pa.list_(pa.binary())),
                ],
                ["lang", "shard", "weight", "blob", "terms"],
            )

        for batch in batches:
            for own, term, chunks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if terms and (own != lang or len(terms) >= SHARD_TERMS or weight >= weight_limit):
                    yield sent()
                    number, terms, weight = number + 1, [], 0
                lang = own
                terms.append(term)
                weight += chunks
        if terms:
            yield sent()

    ordered = kept.select("lang", "term", "chunks").repartitionByRange("lang", "term")
    return ordered.sortWithinPartitions("lang", "term").mapInArrow(
        run, "lang string, shard long, weight long, blob binary, terms array<binary>"
    )


class Directory:
    """Where each shard begins, its first ordinal and the slot that its stream is dealt to.

    One entry a shard: at most one for SHARD_TERMS terms, three a task, and one a language and task.
    """

    def __init__(self, rows: list, slots: int):
        total = sum(r.weight for r in rows) or 1
        self.firsts: dict[str, list[bytes]] = defaultdict(list)
        self.shards: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.entries: list[tuple[str, int, int, int]] = []
        passed: Counter = Counter()
        weight = 0
        for r in sorted(rows, key=lambda r: (r.lang, r.shard)):
            slot = weight * slots // total
            self.firsts[r.lang].append(bytes(r.first))
            self.shards[r.lang].append((r.shard, slot))
            self.entries.append((r.lang, r.shard, slot, passed[r.lang]))
            passed[r.lang] += r.n
            weight += r.weight

    def places(self, lang: str, terms: list[bytes]) -> tuple[int, np.ndarray, np.ndarray]:
        """For ascending terms: how many precede every shard, and shard and slot of the others."""
        starts = np.array([bisect_left(terms, first) for first in self.firsts.get(lang, ())], np.int64)
        if not len(starts):
            none = np.empty(0, np.int64)
            return len(terms), none, none
        own = np.array(self.shards[lang], np.int64)
        ranges = np.repeat(own, np.diff(np.append(starts, len(terms))), axis=0)
        return int(starts[0]), ranges[:, 0], ranges[:, 1]


class _Chunk:
    """Terms of some texts of one language, numbered, with the source of each text."""

    def __init__(self):
        self.terms, self.sources = _numbers(), _numbers()
        self.found, self.texts = array("i"), []

    def add(self, source: str, terms: list[bytes]) -> None:
        self.found.extend(map(self.terms.__getitem__, terms))
        self.texts.append((self.sources[source], len(terms)))

    def rows(self, lang: str, directory: Directory) -> pa.RecordBatch:
        """A row per term that a shard may hold: its sources and their counts, terms ascending."""
        terms = list(self.terms)
        order = sorted(range(len(terms)), key=terms.__getitem__)
        terms = [terms[k] for k in order]
        rank = np.empty(len(terms), np.int64)
        rank[order] = np.arange(len(terms))
        source, sizes = np.array(self.texts, np.int32).reshape(-1, 2).T
        # Sorted in place: this is the largest array of the task.
        pairs = rank[np.frombuffer(self.found, np.int32)]
        pairs *= len(self.sources)
        pairs += np.repeat(source, sizes)
        pairs.sort()
        edges = np.flatnonzero(np.diff(pairs, prepend=-1))
        pairs, counts = pairs[edges], np.diff(edges, append=len(pairs))
        before, shard, slot = directory.places(lang, terms)
        first = int(np.searchsorted(pairs, before * len(self.sources)))
        pairs, counts, terms = pairs[first:], counts[first:], terms[before:]
        of_term = pairs // len(self.sources) - before
        offsets = pa.array(np.searchsorted(of_term, np.arange(len(terms) + 1)).astype(np.int32))
        names = pa.array(self.sources.keys(), pa.string())
        return pa.record_batch(
            [
                pa.array(slot.astype(np.int32)),
                pa.DictionaryArray.from_arrays(np.zeros(len(terms), np.int8), [lang]).cast("string"),
                pa.array(shard),
                pa.array(terms, pa.binary()),
                pa.ListArray.from_arrays(offsets, names.take(pa.array(pairs % len(self.sources)))),
                pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64))),
            ],
            ["slot", "lang", "shard", "term", "sources", "counts"],
        )


def _stream(texts: DataFrame, directory: Directory) -> DataFrame:
    """slot, lang, shard, term, sources, counts: the terms of all texts, summed per chunk of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[str, _Chunk] = defaultdict(_Chunk)
        held = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, chunk in chunks.items():
                yield from common.arrow_rows([chunk.rows(lang, directory)], 10_000)

        for batch in batches:
            langs, sources = (batch.column(k).to_pylist() for k in range(2))
            for lang, source, text in zip(langs, sources, batch.column(2), strict=True):
                terms = terms_of(text)
                chunks[lang].add(source, terms)
                held += len(terms)
                if held >= CHUNK_TERMS:
                    yield from sent()
                    chunks.clear()
                    held = 0
        yield from sent()
        chunks.clear()
        common.give_back_memory()

    return texts.select("lang", "source", "text").mapInArrow(
        run,
        "slot int, lang string, shard long, term binary, sources array<string>, counts array<long>",
    )


def _walked(stream: DataFrame) -> DataFrame:
    """lang, source, ordinal, n: rows of a shard stand together, its transducer first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer, base = None, 0
        for batch in batches:
            blobs = batch.column("blob")
            edges = [k for k in range(batch.num_rows) if blobs[k].is_valid]
            for start, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if start < batch.num_rows and blobs[start].is_valid and end > start:
                    transducer = Transducer.from_bytes(blobs[start].as_py())
                    base = batch.column("base")[start].as_py()
                    start += 1
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                term = part.column("term")
                offsets = np.frombuffer(term.buffers()[1], np.int32)[
                    term.offset : term.offset + len(term) + 1
                ]
                ordinals = transducer.ordinals(np.frombuffer(term.buffers()[2], np.uint8), offsets)
                sources, counts = part.column("sources"), part.column("counts")
                sizes = np.diff(np.asarray(sources.offsets))
                per_entry = np.repeat(ordinals, sizes)
                kept = pa.array(per_entry >= 0)
                langs = part.column("lang").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                yield pa.record_batch(
                    [
                        langs.filter(kept),
                        sources.flatten().filter(kept),
                        pa.array(per_entry + base).filter(kept),
                        counts.flatten().filter(kept),
                    ],
                    ["lang", "source", "ordinal", "n"],
                )

    return stream.mapInArrow(run, "lang string, source string, ordinal long, n long")


def recount(texts: DataFrame, shards: DataFrame, directory: Directory, slots: int) -> DataFrame:
    """lang, source, ordinal, n: occurrences of every kept term, by streaming the texts' terms
    through the transducers. A shard's transducer is dealt to its slot once and sorted before the
    terms that it reads, so a task holds one transducer at a time.
    """
    spark = texts.sparkSession
    places = spark.createDataFrame(
        directory.entries, "lang string, shard long, slot int, base long"
    )
    blobs = shards.select("lang", "shard", "blob").join(places, ["lang", "shard"])
    both = blobs.unionByName(_stream(texts, directory), allowMissingColumns=True)
    dealt = both.repartitionById(slots, F.col("slot")).sortWithinPartitions(
        "lang", "shard", F.col("blob").isNull()
    )
    return _walked(dealt).groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))


def share(count: Column, size: Column) -> Column:
    """1 + floor(WHOLE * (count + 1) / size) by long division, three decimal digits a step."""
    value, rest = F.lit(1) + F.call_function("div", count + 1, size) * WHOLE, (count + 1) % size
    for unit in (1_000_000, 1000, 1):
        value = value + F.call_function("div", rest * 1000, size) * unit
        rest = (rest * 1000) % size
    return value


def departure(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _pair_parts(postings: DataFrame) -> DataFrame:
    """lang, source, item, part, shared: over the terms that both sources hold, what their own
    shares change against the shares of an absent term; and how many such terms there are.

    Input: per term the arrays of its sources, their shares and the shares that absent terms have.
    The pairs of a term are the result's own pairs; they are summed as they arise.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column("sources").value_lengths()).astype(np.int64)
            ends = np.cumsum(sizes)
            names = batch.column("sources").flatten().dictionary_encode()
            code = np.asarray(names.indices).astype(np.int64)
            share_, absent = (np.asarray(batch.column(c).flatten()) for c in ("p", "absent"))
            langs = batch.column("lang").to_pylist()
            # Terms in parts of one language whose pairs fit.
            pairs, first = np.cumsum(sizes * sizes), 0
            while first < len(sizes):
                before = pairs[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(pairs, before + BATCH_PAIRS, "right")))
                last = next((k for k in range(first, last) if langs[k] != langs[first]), last)
                counts = sizes[first:last]
                offset = ends[first:last] - counts
                left = np.repeat(np.arange(offset[0], ends[last - 1]), np.repeat(counts, counts))
                inner = np.arange(len(left)) - np.repeat(
                    np.cumsum(np.repeat(counts, counts)) - np.repeat(counts, counts),
                    np.repeat(counts, counts),
                )
                right = np.repeat(offset, counts * counts) + inner
                other = left != right
                left, right = left[other], right[other]
                ps, pt, zs, zt = share_[left], share_[right], absent[left], absent[right]
                gain = (
                    (ps - pt) ** 2 // pt - (ps - zt) ** 2 // zt
                    - (zs - pt) ** 2 // pt + (zs - zt) ** 2 // zt
                )
                keys, group = np.unique(
                    code[left] * len(names.dictionary) + code[right], return_inverse=True
                )
                total = np.zeros(len(keys), np.int64)
                np.add.at(total, group, gain)
                yield pa.record_batch(
                    [
                        pa.array([langs[first]] * len(keys), pa.string()),
                        names.dictionary.take(pa.array(keys // len(names.dictionary))),
                        names.dictionary.take(pa.array(keys % len(names.dictionary))),
                        pa.array(total),
                    ],
                    ["lang", "source", "item", "part"],
                )
                first = last

    return postings.mapInArrow(run, "lang string, source string, item string, part long")


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) that occurs.

    Part `pair`: every other source of the language by divergence over all kept terms. Part `term`:
    the terms that the source uses more than its language, by what they add, down to rank TOP_TERMS.
    Null text, lang and source are read as ''. A group without terms gets pairs and no terms; a
    language that keeps no term gets pairs of value 0. Repeated rows are documents of their own.
    Ties rank by UTF-8 order of the item. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = _read(docs)
    slots = common.tasks(spark)
    kept = written(kept_terms(texts), "kept-terms")
    drawn = kept.agg(F.sum("chunks")).first()[0] or 0
    shards = written(shards_of(kept, max(1, drawn // slots)), "term-shards")
    rows = shards.select(
        "lang", "shard", "weight", F.element_at("terms", 1).alias("first"), F.size("terms").alias("n")
    )
    directory = Directory(rows.collect(), slots)
    counts = written(recount(texts, shards, directory, slots), "term-counts")

    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    held = counts.groupBy("lang", "source").agg(F.sum("n").alias("n_all"), F.count("n").alias("held"))
    groups = (
        texts.select("lang", "source").distinct()
        .join(held, ["lang", "source"], "left")
        .join(vocabulary, "lang", "left")
        .na.fill(0, ["n_all", "held", "v"])
    )
    groups = written(groups, "term-groups").withColumn("size", F.col("n_all") + F.col("v"))
    absent = F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("size")))
    groups = groups.withColumn("absent", absent)

    shares = counts.join(groups.select("lang", "source", "size", "absent"), ["lang", "source"])
    shares = shares.withColumn("p", share(F.col("n"), F.col("size")))
    return _pairs(groups, shares).unionByName(_terms(groups, shares, shards, directory))


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """A pair's sum over all kept terms from four kinds of terms: held by both, by either, by none.

    f(p, q) is summed as if each source's terms were absent from the other, from histograms of
    shares (a source has far fewer different shares than terms), and corrected on common terms.
    """
    of_source = groups.select("lang", "source", "held", "absent", "v")
    of_item = groups.select(
        "lang", F.col("source").alias("item"), F.col("held").alias("item_held"),
        F.col("absent").alias("item_absent"),
    )
    histogram = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times"))
    met = histogram.join(of_item, "lang").filter(F.col("source") != F.col("item"))
    alone = met.groupBy("lang", "source", "item").agg(
        F.sum(F.col("times") * departure(F.col("p"), F.col("item_absent"))).alias("own"),
        F.sum(F.col("times") * departure(F.col("item_absent"), F.col("p"))).alias("reverse"),
    )
    postings = shares.groupBy("lang", "ordinal").agg(
        F.collect_list(F.struct("source", "p", "absent")).alias("held")
    )
    postings = postings.select(
        "lang",
        F.col("held.source").alias("sources"),
        F.col("held.p").alias("p"),
        F.col("held.absent").alias("absent"),
    )
    common_part = _pair_parts(postings).groupBy("lang", "source", "item").agg(
        F.sum("part").alias("part")
    )
    pair = ["lang", "source", "item"]
    swapped = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "reverse")
    joined = (
        of_source.join(of_item, "lang").filter(F.col("source") != F.col("item"))
        .join(alone.select(*pair, "own"), pair, "left")
        .join(swapped, pair, "left")
        .join(common_part, pair, "left")
        .na.fill(0, ["own", "reverse", "part"])
    )
    neither = (F.col("v") - F.col("held") - F.col("item_held")) * departure(
        F.col("absent"), F.col("item_absent")
    )
    value = F.when(F.col("v") > 0, F.col("own") + F.col("reverse") + F.col("part") + neither)
    ranked = joined.withColumn("value", F.coalesce(value, F.lit(0).cast("long")))
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return ranked.select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value",
        F.row_number().over(place).alias("rank"),
    )


def _terms(
    groups: DataFrame, shares: DataFrame, shards: DataFrame, directory: Directory
) -> DataFrame:
    whole = groups.groupBy("lang").agg(F.sum("n_all").alias("lang_n"), F.first("v").alias("v"))
    in_lang = shares.groupBy("lang", "ordinal").agg(F.sum("n").alias("lang_count"))
    q = share(F.col("lang_count"), F.col("lang_n") + F.col("v"))
    in_lang = in_lang.join(whole, "lang").select("lang", "ordinal", q.alias("q"))
    more = shares.join(in_lang, ["lang", "ordinal"]).filter(F.col("p") > F.col("q"))
    valued = more.select(
        "lang", "source", "ordinal", departure(F.col("p"), F.col("q")).alias("value")
    )
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    top = valued.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= TOP_TERMS)
    bases = shards.sparkSession.createDataFrame(
        directory.entries, "lang string, shard long, slot int, base long"
    )
    spelled = (
        shards.select("lang", "shard", "terms")
        .join(bases, ["lang", "shard"])
        .select("lang", "base", F.posexplode("terms").alias("at", "term"))
        .select("lang", (F.col("base") + F.col("at")).alias("ordinal"), "term")
    )
    return top.join(spelled, ["lang", "ordinal"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"),
        "value", "rank",
    )
