"""Secret scan with linking of credentials in several parts. DataFrame operations only.

Spark gives the matches of a pattern and the text between them, but no places;
these are running sums of both lengths, by a window over a row per match, so a
text with very many matches costs as much as as many texts with one.

Strong spans (``assign``, ``access``, ``hex``) are reported wherever they are.
Weak candidates are parts of a credential that mean nothing alone: identifiers
(``weak_id``), short or unnamed secrets (``weak_secret``) and endpoints
(``endpoint``). A weak candidate is reported only if a complementary part,
strong ones included, lies in the same scope: within ``scope`` characters of
it. Identifiers need a secret, secrets an identifier or an endpoint, endpoints a
secret. The interval join runs over one row per part: windows over a document's parts,
in order of place, carry the nearest part of each role before and behind, so no pairs
are made. Only documents that have matches are shuffled, and only lengths of them.

Defined cases: a null text is the empty text, which has no spans; repeated rows
and identifiers are scanned one by one; overlapping spans of different kinds
are all kept; texts of any length and number of matches are scanned whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_of

#: kind: (pattern, group whose length is tested, least length). Order breaks ties of start.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
WEAK = {
    "weak_id": (r"""(?i)\b(?:user_?name|login|client_?id|account_?id|access_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{4,}""", 0, 1),
    "weak_secret": (r"""(?i)\b(?:password|passwd|pwd|pass|secret|token|auth|api_?key|private_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}""", 0, 1),
    "endpoint": (r"(?i)\b(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s?ftp|ssh|s3)://[^\x20\x09-\x0D\"'<>]{4,}", 0, 1),
}
KINDS = [*BASE, *WEAK]
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}
NEEDS = {"weak_id": ("secret",), "weak_secret": ("id", "endpoint"), "endpoint": ("secret",)}
SPAN = "struct<start:int,kind:int,end:int>"


def matches_of(text: Column, kind: str) -> Column:
    """Array of (kind, k, gap, length, tested) of the leftmost non-overlapping matches: their number, characters between the match before and this one, own length and that of the tested group."""
    pattern, group, _ = (BASE | WEAK)[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    between = F.split(text, pattern, -1)  # one more than matches
    rows = F.transform(
        F.arrays_zip(found.alias("match"), tested.alias("tested"), between.alias("gap")),
        lambda m, k: F.struct(F.lit(KINDS.index(kind)).alias("kind"), k.alias("k"), F.length(m["gap"]).alias("gap"), F.length(m["match"]).alias("length"), F.length(m["tested"]).alias("tested")),
    )
    none = F.array().cast("array<struct<kind:int,k:int,gap:int,length:int,tested:int>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), F.filter(rows, lambda m: m["length"].isNotNull())).otherwise(none)


def placed(matches: DataFrame) -> DataFrame:
    """Rows (row, kind, k, gap, length, tested, ..) with start, end and whether they are long enough; ends are running sums over the matches of a text and kind."""
    order = Window.partitionBy("row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    least = F.element_at(F.array(*[F.lit((BASE | WEAK)[k][2]) for k in KINDS]), F.col("kind") + 1)
    rows = matches.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(order).cast("int"))
    return rows.withColumns({"start": F.col("end") - F.col("length"), "whole": F.col("tested") >= least})


def written(spans: Column) -> Column:
    """kind:start:end by start, then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def linked(parts: DataFrame, scope: int = 300) -> DataFrame:
    """Rows (row, start, kind, end, whole, ..) with reported: strong ones that are long enough, and weak ones with a complementary part within ``scope`` characters.

    A weak part that begins inside of a strong one is none of its own. Running
    maxima of ends come from a text's parts in order of place, running minima of
    starts from the same parts in reverse order: a text of n parts costs n log n.
    """
    n = len(BASE)
    order = [F.col(c) for c in ("start", "kind", "end")]
    upto = Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    covered = F.max(F.when(F.col("whole") & (F.col("kind") < n), F.col("end"))).over(upto) > F.col("start")
    parts = parts.withColumn("part", F.col("whole") & ((F.col("kind") < n) | ~F.coalesce(covered, F.lit(False))))
    before = Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("row").orderBy(*[c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    role = F.element_at(F.array(*[F.lit(ROLE[k]) for k in KINDS]), F.col("kind") + 1)
    is_r = {r: F.col("part") & (role == r) for r in ("id", "secret", "endpoint")}
    parts = parts.withColumns({f"end_{r}": F.max(F.when(c, F.col("end"))).over(before) for r, c in is_r.items()})
    parts = parts.withColumns({f"start_{r}": F.min(F.when(c, F.col("start"))).over(behind) for r, c in is_r.items()})
    near = {r: F.coalesce(F.col(f"end_{r}") >= F.col("start") - scope, F.lit(False)) | F.coalesce(F.col(f"start_{r}") <= F.col("end") + scope, F.lit(False)) for r in is_r}
    keep = F.col("kind") < n
    for kind, needs in NEEDS.items():
        for r in needs:
            keep = keep | ((F.col("kind") == KINDS.index(kind)) & near[r])
    return parts.withColumn("reported", F.col("part") & keep)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 300) -> DataFrame:
    """One row per document: doc_id, base and spans (arrays of start, kind, end; kind is the place in KINDS), base within spans."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.concat(*[matches_of(text, k) for k in KINDS]).alias("matches"))
    rows = materialise(rows, "secret_matches")
    found = linked(placed(rows.filter(F.size("matches") > 0).select("doc_id", "row", F.explode("matches").alias("m")).select("doc_id", "row", "m.*")), scope)
    span, own = F.struct("start", "kind", "end"), F.col("reported") & (F.col("kind") < len(BASE))
    some = found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.when(own, span))).alias("base"), F.array_sort(F.collect_list(F.when(F.col("reported"), span))).alias("spans"))
    none = F.array().cast(f"array<{SPAN}>")
    return some.drop("row").unionByName(rows.filter(F.size("matches") == 0).select("doc_id", none.alias("base"), none.alias("spans")))


def digest(found: DataFrame) -> DataFrame:
    """Counts and texts of spans, in the form of the query's contract."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
