"""Mixing sources to target weights by nested hash-threshold histograms. DataFrame operations only.

A document's size is its number of words. Each source gets a target number of
words; whole copies of the source fill as much of it as they can, and the rest
is a budget met by a threshold on a hash of the identifier: a histogram of
words by (source, top hash bits) shows in which bucket the budget ends, and only
that bucket is split again by the next bits, until it holds a single hash. No
rows are sorted, a rerun takes the same documents, and a larger budget takes a
superset. A hot source costs a histogram of at most 2**BITS rows per task.

The document at which the threshold ends is left out, and with it up to its size
is open. That is filled by size: of the documents not taken, as many as fit of the
largest size that fits, then of the next one, until none fits. A histogram of the sizes up
to what is open decides how many of each; of a size, those of the smallest hashes are taken.

Defined cases: a null text has size 0; a null source is a source, last in
order; repeated identifiers share a hash and are taken together, or not at all; an empty table
gives an empty result; sources without words get target 0 and nothing is taken;
no document (of an identifier of its own) that would still fit is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, join_small, materialise, ranked, text_of

#: Bits of a histogram level and of the hash: five levels split it wholly.
BITS, HASH_BITS = 12, 60
KEYS = ["src_null", "src"]


def word_count(column: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D."""
    return F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size and the 60-bit hash of the identifier."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(text_of(text_col)).alias("size"),
        hash_of(id_col).alias("h"),
    ).withColumns({"src_null": F.col("source").isNull(), "src": F.coalesce("source", F.lit(""))})


def targets(rows: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, ceiling: float = 3.0) -> DataFrame:
    """A row per source: words, weight and target.

    Sources in order of name take ``weights`` in turn and divide ``share`` of all
    words by weight; a target stops at ``ceiling`` times the source and the
    excess goes to the others by weight. That is a common level per unit of
    weight, min(ceiling * words, level * weight): each step sums up the sources
    that the level has led over their ceilings and raises it for the others,
    until none is added. No task sees all sources.
    """
    sources = rows.groupBy(*KEYS).agg(F.sum("size").alias("source_size"))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    s = ranked(sources, KEYS).withColumn("weight", pick).withColumn("cap", F.col("source_size") * F.lit(float(ceiling)))
    s = materialise(s, "mix_sources")
    total = (s.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    level, over = 0.0, -1
    while True:  # sources only ever join those at their ceiling
        full = F.col("cap") < F.lit(level) * F.col("weight")
        n, capped, weight = s.agg(F.sum(full.cast("long")), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not weight or n == over:
            break
        over, level = n, (total - (capped or 0.0)) / weight
    target = F.col("cap") if not weight else F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    return s.withColumn("target", F.round(target, 6)).select(*KEYS, "source_size", "weight", "target")


def _search(rows: DataFrame, state: DataFrame, sources: int) -> DataFrame:
    """``state`` with ``cut``, for each source the largest for which the rows with h < cut have at most ``left`` words, and with what is then left."""
    state = state.withColumns({"prefix": F.lit(0).cast("long"), "cut": F.when(F.col("left") <= 0, F.lit(0).cast("long"))})
    for bits in range(BITS, HASH_BITS + 1, BITS):
        done, still = state.filter(F.col("cut").isNotNull()), state.filter(F.col("cut").isNull())
        if bits > BITS and still.isEmpty():
            break
        shift, above = HASH_BITS - bits, HASH_BITS - bits + BITS
        inside = join_small(rows, still.select(*KEYS, "prefix"), KEYS, most=sources).filter(F.shiftright("h", above) == F.col("prefix"))
        levels = inside.groupBy(*KEYS, F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
        levels = levels.withColumn("upto", F.sum("words").over(Window.partitionBy(*KEYS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
        ends = join_small(levels, still.select(*KEYS, "left"), KEYS, most=sources).filter(F.col("upto") > F.col("left")).groupBy(*KEYS).agg(F.min(F.struct("bucket", "words", "upto", "docs")).alias("end"))
        # no end: all that the bucket holds fits; a bucket of one document ends the search
        cut = F.when(F.col("end").isNull(), (F.col("prefix") + 1) * F.lit(1 << above)).when((F.col("end.docs") == 1) | F.lit(bits == HASH_BITS), F.col("end.bucket") * F.lit(1 << shift))
        step = still.drop("cut").join(ends, KEYS, "left").withColumn("cut", cut)
        step = step.withColumns({"left": F.when(F.col("end").isNotNull(), F.col("left") - (F.col("end.upto") - F.col("end.words"))).otherwise(F.col("left")), "prefix": F.coalesce("end.bucket", "prefix")})
        state = materialise(done.unionByName(step.select(*done.columns)), "mix_thresholds")
    return state.drop("prefix")


def _fill(rows: DataFrame, state: DataFrame, sources: int, slices: int = 32) -> DataFrame:
    """``state`` with ``fills`` (size, upto): what is left is met by documents of a size in it with cut <= h <= upto.

    A source's histogram has at most as many sizes as words are left, less than the document has that ended the threshold.
    """
    free = join_small(rows.filter("size > 0"), state.filter("left >= 1").select(*KEYS, "left", "cut"), KEYS, most=sources).filter((F.col("h") >= F.col("cut")) & (F.col("size") <= F.col("left")))
    sizes = free.groupBy(*KEYS, "size").agg(F.count(F.lit(1)).alias("docs"), F.first("left").alias("left"), F.first("cut").alias("cut"))
    by_size = sizes.groupBy(*KEYS).agg(F.first("left").alias("left"), F.first("cut").alias("cut"), F.sort_array(F.collect_list(F.struct("size", "docs")), asc=False).alias("sizes"))
    start = F.struct(F.col("left").alias("left"), F.array().cast("array<struct<size:long,take:long>>").alias("steps"))

    def step(a: Column, x: Column) -> Column:
        take = F.least(x["docs"], F.floor(a["left"] / x["size"]))
        more = F.concat(a["steps"], F.array(F.struct(x["size"].alias("size"), take.alias("take"))))
        return F.struct((a["left"] - take * x["size"]).alias("left"), F.when(take > 0, more).otherwise(a["steps"]).alias("steps"))

    wanted = by_size.select(*KEYS, "cut", F.explode(F.aggregate("sizes", start, step, lambda a: a["steps"])).alias("w")).select(*KEYS, "cut", "w.size", "w.take")
    wanted = materialise(wanted, "mix_fills")
    # the smallest hashes of each size: of slices first, so that no task ranks all documents of a size
    some = join_small(rows, wanted, [*KEYS, "size"]).filter(F.col("h") >= F.col("cut")).groupBy(*KEYS, "size", "take", "h").agg(F.count(F.lit(1)).alias("docs"))
    upto = lambda *keys: F.sum("docs").over(Window.partitionBy(*KEYS, "size", *keys).orderBy("h"))
    some = some.withColumn("slice", F.pmod("h", F.lit(slices))).withColumn("n", upto("slice")).filter(F.col("n") <= F.col("take"))
    some = some.withColumn("n", upto()).filter(F.col("n") <= F.col("take"))
    fills = some.groupBy(*KEYS, "size").agg(F.max("h").alias("upto")).groupBy(*KEYS).agg(F.collect_list(F.struct("size", "upto")).alias("fills"))
    return state.join(fills, KEYS, "left").withColumn("fills", F.coalesce("fills", F.array().cast("array<struct<size:long,upto:long>>")))


def times_taken(found: Column, h: Column, size: Column) -> Column:
    """How often a document is taken, by the ``copies``, ``cut`` and ``fills`` of its source."""
    once = (h < found["cut"]) | F.exists(found["fills"], lambda p: (p["size"] == size) & (h <= p["upto"]))
    return found["copies"] + once.cast("long")


def thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """A row per source with ``found``: copies of everything, and the rule (cut, fills) for documents that are taken once more."""
    state = wanted.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    state = materialise(state.withColumn("left", F.col("target") - F.col("copies") * F.col("source_size")), "mix_targets")
    sources = state.count()
    state = _fill(rows, _search(rows.select(*KEYS, "size", "h"), state, sources), sources)
    return state.select(*KEYS, "source_size", "target", F.struct("copies", "cut", "fills").alias("found"))


def hash_of(id_col: str) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, ceiling: float = 3.0) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies and taken (words, repeats counted)."""
    rows = materialise(sized(docs, id_col, text_col, source_col), "mix_sizes")
    found = materialise(thresholds(rows, targets(rows, weights, share, ceiling)), "mix_found")
    out = join_small(rows, found, KEYS).withColumn("times", times_taken(F.col("found"), F.col("h"), F.col("size")))
    return out.select("doc_id", "source", "size", "source_size", "target", F.col("times").alias("copies"), (F.col("times") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, ceiling: float = 3.0) -> DataFrame:
    """``docs`` as the mix takes them, each as often as it is taken, columns unchanged. No text is shuffled: a document's own columns and its source's row decide."""
    rows = materialise(sized(docs, id_col, text_col, source_col), "mix_sizes")
    found = materialise(thresholds(rows, targets(rows, weights, share, ceiling)), "mix_found")
    null, src, found_, h, times, n = fresh(docs, "_src_null", "_src", "_found", "_h", "_times", "_n")
    found = found.select(F.col("src_null").alias(null), F.col("src").alias(src), F.col("found").alias(found_))
    keyed = docs.withColumns({null: F.col(source_col).isNull(), src: F.coalesce(F.col(source_col).cast("string"), F.lit("")), h: hash_of(id_col)})
    again = times_taken(F.col(found_), F.col(h), word_count(text_of(text_col)))
    out = join_small(keyed, found, [null, src]).withColumn(times, again).filter(F.col(times) > 0)
    return out.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns)
