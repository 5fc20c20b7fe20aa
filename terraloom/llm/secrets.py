"""Secret scans with multipart credential linking.

Three base kinds are secrets by themselves. Three weak kinds (identifiers, keys and endpoints that
are only plausible) are reported when complementary parts of a credential stand in the same scope:
an interval join by (text, bucket of SCOPE code points) brings each weak part together with the
nearest complementary parts of its own bucket and the two beside it.

Matches have no positions in SQL, so the text between two matches is measured as well; a running
sum of gaps and matches gives the positions. Only lengths leave the scan, never the texts, and equal
texts are worked on once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm import common
from terraloom.operators.storage import written

#: Code points between two parts of one credential, at most.
SCOPE = 256
BASE = ("assign", "access", "hex")
WEAK = ("id", "key", "endpoint")

#: Fixed values of the contract: what a match is. A match that fails its test is dropped.
ASSIGN = (
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
# A run of 16 or more is the same as a whole run that passes.
HEX = r"[0-9a-f]{16,}"
#: The weak kinds: bare upper-case identifiers, long mixed strings, and hosts.
ID = r"(?<![A-Za-z0-9])[A-Z][A-Z0-9]{11,}(?![A-Za-z0-9])"
KEY = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}(?![A-Za-z0-9+/])"
#: A name is tried from its first character only, so that a long word is read once.
ENDPOINT = (
    r"https?://[^\x20\x09-\x0D\"'<>]+|(?<![a-z0-9-])[a-z0-9-]+(?:\.[a-z0-9-]+)+(?::[a-z0-9-]+)?"
)
#: An endpoint is an address, a dotted name or number with a port, a name of three parts or more
#: whose last is letters, or one of two parts with a common end.
HOST = r"^https?://|:[0-9]+$|\.[a-z0-9-]+\.[a-z]{2,}(:|$)|\.(com|net|org|io)(:|$)"


def _matches(text: Column, kind: str, pattern: str, passes) -> Column:
    """Per match: kind, length of the gap before it, its length, and whether it counts."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    made = F.zip_with(
        found,
        gaps,
        lambda m, g: F.struct(
            F.lit(kind).alias("kind"),
            F.length(g).alias("gap"),
            F.length(m).alias("len"),
            passes(m).alias("ok"),
        ),
    )
    none = F.array().cast("array<struct<kind:string,gap:int,len:int,ok:boolean>>")
    return F.when(F.size(found) > 0, made).otherwise(none)


def _mixed(match: Column) -> Column:
    return match.rlike("[0-9]") & match.rlike("[A-Za-z]")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, parts of every row; text_key is null where nothing was found. Written."""
    text = F.col("text")
    parts = F.concat(
        _matches(text, "assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 12),
        _matches(text, "access", ACCESS, lambda m: F.length(m) >= 18),
        _matches(text, "hex", HEX, lambda m: F.lit(True)),
        _matches(text, "id", ID, lambda m: m.rlike("[0-9]")),
        _matches(text, "key", KEY, _mixed),
        _matches(text, "endpoint", ENDPOINT, lambda m: m.rlike(HOST)),
    )
    found = common.id_and_text(docs).select(
        "doc_id", F.md5("text").alias("text_key"), parts.alias("parts")
    )
    keyed = F.when(F.exists("parts", lambda x: x["ok"]), F.col("text_key"))
    return written(found.withColumn("text_key", keyed), "secret-parts")


def positions(scanned: DataFrame) -> DataFrame:
    """text_key, kind, start, end of every part that counts, once per distinct text."""
    one = scanned.filter("text_key is not null").groupBy("text_key").agg(F.first("parts").alias("parts"))
    rows = one.select("text_key", F.posexplode("parts").alias("place", "part"))
    order = Window.partitionBy("text_key", "part.kind").orderBy("place")
    end = F.sum(F.col("part.gap") + F.col("part.len")).over(order)
    return (
        rows.select("text_key", "part.*", end.cast("int").alias("end"))
        .filter("ok")
        .select("text_key", "kind", (F.col("end") - F.col("len")).alias("start"), "end")
    )


def _apart(parts: DataFrame) -> DataFrame:
    """Without weak parts that overlap a base part."""
    by_start = Window.partitionBy("text_key").orderBy("start")
    base = F.col("kind").isin(*BASE)
    reach = F.max(F.when(base, F.col("end"))).over(
        by_start.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    following = F.min(F.when(base, F.col("start"))).over(
        by_start.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    )
    clear = F.coalesce(reach <= F.col("start"), F.lit(True)) & F.coalesce(
        following >= F.col("end"), F.lit(True)
    )
    return (
        parts.withColumn("__clear", base | clear).filter("__clear").drop("__clear")
    )


def _role(kind: Column) -> Column:
    """The part of a credential that a kind can be."""
    return (
        F.when(kind.isin("access", "id"), "id")
        .when(kind.isin("assign", "hex", "key"), "key")
        .otherwise("endpoint")
    )


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts to report: text_key, kind, start, end.

    An identifier needs a key in scope, a key needs an identifier or an endpoint, and an endpoint
    needs both an identifier and a key. Two parts share a scope if their starts are at most `scope`
    code points apart, and complementary parts do not overlap: a string is not its own complement.
    Matches of a kind do not overlap, so a bucket holds a bounded number of them, as one row a role,
    and a bucket full of parts is not paired out.
    """
    bucket = F.floor(F.col("start") / scope)
    clear = _apart(parts).withColumn("role", _role(F.col("kind")))
    held = clear.groupBy("text_key", bucket.alias("bucket"), F.col("role").alias("other")).agg(
        F.collect_list(F.struct("start", "end")).alias("others")
    )
    weak = clear.filter(F.col("kind").isin(*WEAK)).select(
        "*", F.explode(F.sequence(bucket - 1, bucket + 1)).alias("bucket")
    )
    beside = F.exists(
        "others",
        lambda o: (F.abs(o["start"] - F.col("start")) <= scope)
        & ((o["end"] <= F.col("start")) | (o["start"] >= F.col("end"))),
    )
    near = weak.join(held, ["text_key", "bucket"]).filter((F.col("role") != F.col("other")) & beside)
    per_part = near.groupBy("text_key", "kind", "role", "start", "end").agg(
        F.max(F.col("other") == "id").alias("has_id"),
        F.max(F.col("other") == "key").alias("has_key"),
        F.max(F.col("other") == "endpoint").alias("has_endpoint"),
    )
    complete = (
        ((F.col("role") == "id") & F.col("has_key"))
        | ((F.col("role") == "key") & (F.col("has_id") | F.col("has_endpoint")))
        | ((F.col("role") == "endpoint") & F.col("has_id") & F.col("has_key"))
    )
    return per_part.filter(complete).select("text_key", "kind", "start", "end")


def _spans_by_text(scanned: DataFrame, scope: int) -> DataFrame:
    """text_key, spans: base and reported parts of each distinct text, by start and kind."""
    parts = written(positions(scanned), "secret-positions")
    reported = parts.filter(F.col("kind").isin(*BASE)).unionByName(linked(parts, scope))
    order = F.array_position(F.array(*map(F.lit, BASE + WEAK)), F.col("kind"))
    span = F.struct("start", order.alias("turn"), "kind", "end")
    return reported.groupBy("text_key").agg(F.array_sort(F.collect_list(span)).alias("spans"))


_NO_SPANS = "array<struct<start:int,turn:bigint,kind:string,end:int>>"


def find(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id and spans (array of start, turn, kind, end; code points, end exclusive) of every row.

    Null and empty texts have no spans. Repeated rows give one row each. An empty table gives none.
    """
    scanned = scan(docs)
    spans = _spans_by_text(scanned, scope)
    nothing = F.array().cast(_NO_SPANS)
    found = (
        scanned.filter("text_key is not null")
        .select("doc_id", "text_key")
        .join(spans, "text_key", "left")
        .select("doc_id", F.coalesce("spans", nothing).alias("spans"))
    )
    return found.unionByName(
        scanned.filter("text_key is null").select("doc_id", nothing.alias("spans"))
    )


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    each = F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"]))
    return F.array_join(each, ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda x: x["kind"].isin(*kinds))


def redacted(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """`docs` with every span in `text` replaced by [kind]; rows and other columns stay.

    Spans that overlap are replaced together, under the kind of the first. Null and empty texts stay
    as they are, as do columns of any name; equal rows are treated alike; texts of any length are
    scanned whole; an empty table gives an empty one.
    """
    key, found, listed = (common.unused_name(docs, c) for c in ("__key", "__text_key", "__spans"))
    spans = _spans_by_text(scan(docs), scope).withColumnsRenamed({"text_key": found, "spans": listed})
    keyed = docs.withColumn(key, F.md5(common.text_of(docs)))
    rows = keyed.join(spans, F.col(key) == F.col(found), "left")
    return rows.select(
        *[
            _without(F.col("text"), F.col(listed)).alias(c) if c == "text" else F.col(c)
            for c in docs.columns
        ]
    )


def _without(text: Column, spans: Column) -> Column:
    """Kept pieces and marks in turn; `at` is where the text goes on."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(done: Column, span: Column) -> Column:
        kept = F.substring(text, done["at"] + 1, span["start"] - done["at"])
        fresh = F.concat(done["out"], kept, F.lit("["), span["kind"], F.lit("]"))
        return F.struct(
            F.when(span["start"] >= done["at"], fresh).otherwise(done["out"]).alias("out"),
            F.greatest(done["at"], span["end"]).alias("at"),
        )

    end = F.aggregate(
        spans, start, step, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
    )
    return F.when(F.size(spans) > 0, end).otherwise(text)
