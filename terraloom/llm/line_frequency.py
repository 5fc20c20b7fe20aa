"""Quality rules: counts per document, and line frequency across documents.

Lines are lower-cased, their white space is made single, and they are hashed. A line that stands
in more than `max_docs` distinct documents of a host (here: a source) is removed there. A document
that keeps less than half of its words is depleted and rejected.

The counts per document stay in the row. Lines of a document travel as 16-byte hashes with their
word counts; a line that stands in every document is counted with partial sums and joined with
salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraloom.llm import common
from terraloom.operators.storage import written

#: Base rules, from the contract: least words, and most repeated words in percent.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Documents of a host that may share a line, and the percentage of words a document must keep.
MAX_DOCS, LEAST_LEFT = 20, 50
SYMBOLS = r"[#*$%&|<>]"
SALTS = 32
#: Distinct repeated windows up to which positions are looked up rather than sorted.
_FEW = 48

_SPACE = r"[\x20\x09-\x0D]+"


def _windows(words: Column) -> Column:
    """Hashes of the 3-word windows, in order."""

    def made(hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(hashes) - 3),
            lambda i: F.xxhash64(
                F.get(hashes, i), F.get(hashes, i + 1), F.get(hashes, i + 2)
            ),
        )

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    none = F.array().cast("array<long>")
    return F.when(F.size(words) >= 3, common.let(hashes, made)).otherwise(none)


def _repeated(windows: Column) -> Column:
    """Sorted places of the windows that are found twice or more."""

    def twice(ordered: Column) -> Column:
        again = F.filter(ordered, lambda x, i: (i > 0) & (x == F.get(ordered, i - 1)))
        return F.array_distinct(again)

    def places(found: Column) -> Column:
        looked_up = F.transform(windows, lambda h, i: F.when(F.array_contains(found, h), i))
        return F.when(F.size(found) <= _FEW, looked_up).otherwise(_by_sorting(windows))

    marked = common.let(common.let(F.sort_array(windows), twice), places)
    return F.sort_array(F.filter(marked, lambda p: p.isNotNull()))


def _by_sorting(windows: Column) -> Column:
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def beside(ordered: Column) -> Column:
        return F.transform(
            ordered,
            lambda x, k: F.when(
                F.coalesce(x["h"] == F.get(ordered, k - 1)["h"], F.lit(False))
                | F.coalesce(x["h"] == F.get(ordered, k + 1)["h"], F.lit(False)),
                x["i"],
            ),
        )

    return common.let(pairs, beside)


def _covered(places: Column) -> Column:
    """Words in 3-word windows at these places, each counted once."""
    added = F.transform(
        places, lambda p, k: F.least(F.lit(3), F.get(places, k + 1) - p).cast("long")
    )
    return F.aggregate(added, F.lit(0).cast("long"), lambda total, x: total + x)


def base(docs: DataFrame, host: str = "source", row: str | None = None) -> DataFrame:
    """row_id, doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines.

    `lines` holds hash and word count of each line with a word. Written once. `row` names a column
    that tells equal rows apart, where there is one.
    """
    text = common.text_of(docs)
    read = docs.select(
        (F.monotonically_increasing_id() if row is None else docs[row]).alias("row_id"),
        docs["doc_id"].cast("long").alias("doc_id"),
        docs[host].cast("string").alias("host"),
        text.alias("text"),
    )
    split = read.select(
        "row_id",
        "doc_id",
        "host",
        F.regexp_extract_all("text", F.lit(common.WORD), 0).alias("words"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(common.WORD)).alias("raw"),
    )

    def repeat(windows: Column) -> Column:
        unlike = F.size(F.array_distinct(windows)) == F.size(windows)
        none = F.lit(0).cast("long")
        return F.when(unlike, none).otherwise(common.let(_repeated(windows), _covered))

    found = split.select(
        "row_id",
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate(
            "words", F.lit(0).cast("long"), lambda total, w: total + F.length(w)
        ).alias("word_chars"),
        "n_symbols",
        (F.size("raw") - F.size(F.array_distinct("raw"))).cast("long").alias("n_dup_lines"),
        common.let(_windows(F.col("words")), repeat).alias("n_repeat_words"),
        F.transform("raw", _line).alias("lines"),
    )
    return written(found, "line-base")


def _line(line: Column) -> Column:
    normal = F.trim(F.regexp_replace(F.lower(line), _SPACE, " "))
    return F.struct(
        F.unhex(F.md5(normal)).alias("hash"),
        F.regexp_count(line, F.lit(common.WORD)).cast("long").alias("words"),
    )


def frequent_lines(rows: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """host, hash of the lines in more than `max_docs` distinct documents of a host.

    Rows of one doc_id are one document; rows without an id are documents of their own.
    """
    document = F.coalesce(F.col("doc_id"), -1 - F.col("row_id"))
    lines = rows.select("host", document.alias("document"), F.explode("lines.hash").alias("hash"))
    counted = lines.distinct().groupBy("host", "hash").agg(F.count("*").alias("n_docs"))
    return counted.filter(F.col("n_docs") > max_docs).select("host", "hash")


def _hits(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """row_id, hash, words: the lines of rows that are frequent in their host."""
    lines = rows.select(
        "row_id",
        "host",
        F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int").alias("salt"),
        F.explode("lines").alias("line"),
    ).select("row_id", "host", "salt", "line.hash", "line.words")
    salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = (
        lines["host"].eqNullSafe(salted["host"])
        & (lines["hash"] == salted["hash"])
        & (lines["salt"] == salted["salt"])
    )
    return lines.join(salted, same, "left_semi")


def removed_words(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """row_id, n_removed: words in frequent lines, for rows that have any."""
    hit = _hits(rows, frequent)
    return hit.groupBy("row_id").agg(F.sum("words").alias("n_removed"))


def judge(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id, the five counts, n_removed_words, base_failed and kept of every row.

    Null texts have no words and fail the base rules; a null host is a host of its own. Repeated
    rows are judged alike, as one document. An empty table gives no rows.
    """
    rows = base(docs, host)
    return _verdicts(rows, removed_words(rows, frequent_lines(rows, max_docs))).drop("row_id")


def _verdicts(rows: DataFrame, removed: DataFrame) -> DataFrame:
    gone = F.coalesce(F.col("n_removed"), F.lit(0).cast("long"))
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )
    left = 100 * (F.col("n_words") - gone) >= LEAST_LEFT * F.col("n_words")
    return rows.join(removed, "row_id", "left").select(
        "row_id",
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & left).alias("kept"),
        gone.alias("n_removed_words"),
    )


def cleaned(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS) -> DataFrame:
    """The kept rows of `docs` without their frequent lines; all other columns stay as they are.

    Lines without a word stay, as do the line feeds between the lines that are left. Rows of null or
    empty text fail the base rules and go. Repeated rows are treated alike, columns may have any
    name, and an empty table gives an empty one.
    """
    row, gone = (common.unused_name(docs, name) for name in ("__row_id", "__gone"))
    numbered = written(docs.select("*", F.monotonically_increasing_id().alias(row)), "line-rows")
    rows = base(numbered, host, row)
    hits = written(_hits(rows, frequent_lines(rows, max_docs)), "line-hits")
    removed = hits.groupBy("row_id").agg(F.sum("words").alias("n_removed"))
    kept = _verdicts(rows, removed).filter("kept").select(F.col("row_id").alias(row))
    listed = hits.groupBy(F.col("row_id").alias(row)).agg(F.collect_set("hash").alias(gone))
    text = numbered["text"]

    def stays(line: Column) -> Column:
        return ~(line.rlike(common.WORD) & F.array_contains(gone, _line(line)["hash"]))

    left = F.array_join(F.filter(F.split(text, "\n", -1), stays), "\n")
    joined = numbered.join(kept, row, "left_semi").join(listed, row, "left")
    return joined.select(
        *[
            F.when(F.col(gone).isNull(), text).otherwise(left).alias(c) if c == "text" else numbered[c]
            for c in docs.columns
        ]
    )
