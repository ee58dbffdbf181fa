"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, linked after exact comparison.

1. Python tasks turn each text into the set of its shingles' XXH64 hashes, of
   which a key of the whole set, its SimHash fingerprint and BANDS keys of ROWS
   minima each are written. Equal sets are one from here on.
2. Fingerprints within DISTANCE bits are found by ``simhash.links``. At a
   similarity of 0.8 two fingerprints differ in 10 bits of 64 on average, a radius
   at which no pigeonhole search is selective (the README has figures); what
   lies further apart is found by minima: sets that share a key of a band meet.
   Two sets of similarity s miss each other in all bands with odds of
   (1 - s**ROWS)**BANDS: 3e-6 at 0.8, less above.
3. In a meeting of at most CROWD sets all pairs are compared, in a larger one
   each set with three of its members: the one whose own meetings are largest
   (its centre), which is the text that most others are copies of where it is
   there, and two drawn by a hash, others in each band. Pairs of fingerprints
   are compared too. Sets are compared whole; components over the links follow.
4. Crowds whose sets are not all in one component are settled exactly. Crowds
   whose centres are of one component are taken together, and c is one of these
   centres. D = s - c and c - s together is what a set s differs by, of which A
   are added and R missing. If x is not similar to c, but to y, then x and y
   share more than (5 |R| + 4 |A|) / 9 of what y differs by: similar(x, y) says
   9 |x ^ y| <= |x| + |y|, and |x ^ y| = |Dx| + |Dy| - 2 |Dx & Dy|, while
   9 |Dx| > |x| + |c|. So y's differences but for that many, the most frequent
   ones, have one that x has too. Sets of different components that meet there
   are compared whole, and so are sets similar to c.
5. Components over all links; each document takes the smallest identifier.

Every set thus has at most CROWD comparisons a band, whatever the size of its
group, and beyond those only with sets of other components that share one of
its rarer differences from the centre. No link between sets that meet is lost:
it is compared, or both ends are in one component anyway. Step 4 makes many
pairs only where a crowd has many components whose sets share differences but
are not similar; pairs of one difference are dealt in tiles of SPLIT sets.

In ``within_radius`` one set stands for each fingerprint; that adds candidates to
the meetings, in which sets of one fingerprint meet as well.

Defined cases: null and empty texts have the empty set and are copies of each
other; null identifiers are ignored when the smallest is taken; repeated rows
and ties share a component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import join_by_size, materialise, text_of
from .components import components
from .exact_dedup import digest_of, keep_firsts
from .words import majority_bits, shingle_hashes

WIDTH, BANDS, ROWS, DISTANCE, CROWD, SPLIT = 5, 32, 5, 2, 16, 1024
_DRAWN = np.random.default_rng(42).integers(0, 2**63, (2, BANDS * ROWS, 1), np.uint64)
MASKS, FACTORS = _DRAWN[0], _DRAWN[1] * np.uint64(2) + np.uint64(1)


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def set_key(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 7)).view(np.int64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key per band, of ROWS minima of the set under mixing steps that differ."""
    if not len(hashes):
        return np.zeros(BANDS, np.int64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, ((hashes[at : at + 1024] ^ MASKS) * FACTORS).min(1))
    raw = least.tobytes()
    return np.array([xxhash.xxh64_intdigest(raw[k : k + 8 * ROWS], 7) for k in range(0, len(raw), 8 * ROWS)], np.uint64).view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, digest of the text, fp (the key of the set), bits (its fingerprint), n (its size) and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py()) for text in batch.column(2)]
            bits = np.array([majority_bits(s) for s in sets], np.uint64).view(np.int64)
            rows = [batch.column(0), batch.column(1), pa.array(map(set_key, sets), pa.int64()), pa.array(bits), pa.array(map(len, sets), pa.int64()), pa.array(map(band_keys, sets), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(rows, ["doc_id", "digest", "fp", "bits", "n", "bands"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest_of(text_col).alias("digest"), text_of(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id long, digest binary, fp long, bits long, n long, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """fp and hashes of the sets in ``wanted`` (fp, least), each from the text of the row ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["fp", "hashes"])

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), digest_of(text_col).alias("_digest"), text_of(text_col).alias("text"))
    own = wanted.select("fp", "least.doc_id", "least.digest").hint("merge")
    found = texts.join(own, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_digest") == F.col("digest"))).select("fp", "text").mapInArrow(run, "fp long, hashes array<long>")
    out = materialise(found, "shingle_sets")
    # a row may be there more than once
    return out if out.count() == wanted.count() else materialise(out.dropDuplicates(["fp"]), "shingle_sets")


def within_radius(uniq: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints differ in at most DISTANCE bits: one set stands for each fingerprint."""
    bearers = materialise(uniq.groupBy("bits").agg(F.min("fp").alias("first")), "fingerprints")
    pairs = simhash.links(bearers.select(F.col("bits").alias("fp")), DISTANCE)
    near = pairs.join(bearers.select(F.col("bits").alias("a"), F.col("first").alias("x")), "a").join(bearers.select(F.col("bits").alias("b"), F.col("first").alias("y")), "b")
    return materialise(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), "within_radius")


def similar(shared: Column, n: Column, m: Column) -> Column:
    """Whether ``shared`` of sets of ``n`` and ``m`` is a Jaccard similarity of 0.8 or more, in whole numbers."""
    return 9 * shared >= 4 * (n + m)


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar."""
    left = pairs.join(sets.select(F.col("fp").alias("a"), F.col("hashes").alias("x")).hint("merge"), "a")
    both = left.join(sets.select(F.col("fp").alias("b"), F.col("hashes").alias("y")).hint("merge"), "b")
    return both.filter(similar(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))).select("a", "b")


def meetings(uniq: DataFrame) -> DataFrame:
    """fp, n, band, key and size: where sets meet others, by minima (bands from 0) and by equal fingerprints (band BANDS)."""
    keyed = uniq.select("fp", "n", F.posexplode(F.concat("bands", F.array("bits"))).alias("band", "key"))
    places = materialise(keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "meeting_places")
    return materialise(join_by_size(keyed, places, ["band", "key"], "size", uniq.count() * (BANDS + 1)), "meetings")


def crowds(met: DataFrame) -> DataFrame:
    """fp, n and centres (b, y: their fp and size) of each set in each meeting of more than CROWD; the first is its centre."""
    known = met.groupBy("fp").agg(F.sum("size").alias("known"))
    crowd = met.filter(F.col("size") > CROWD).join(known, "fp").withColumn("draw", F.xxhash64("band", "fp"))
    own = F.struct(F.col("fp").alias("b"), F.col("n").alias("y"))
    centres = crowd.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size"), F.array(F.max_by(own, F.struct("known", "fp")), F.max_by(own, F.struct("draw", "fp")), F.min_by(own, F.struct("draw", "fp"))).alias("centres"))
    return materialise(join_by_size(crowd.drop("size"), materialise(centres, "centres"), ["band", "key"], "size", met.count()).select("fp", "n", "centres"), "crowds")


def candidates(uniq: DataFrame, met: DataFrame, crowd: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of sets to compare; their sizes allow the similarity."""
    few = met.filter(F.col("size") <= CROWD).select("band", "key", F.col("fp").alias("a"), F.col("n").alias("x"))
    pairs = few.join(few.withColumnsRenamed({"a": "b", "x": "y"}), ["band", "key"]).filter("a < b")
    stars = crowd.select(F.col("fp").alias("a"), F.col("n").alias("x"), F.explode("centres").alias("c")).select("a", "x", "c.*")
    both = pairs.select("a", "x", "b", "y").unionByName(stars).filter((F.col("a") != F.col("b")) & similar(F.least("x", "y"), F.col("x"), F.col("y")))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(within_radius(uniq)).distinct()


def open_families(crowd: DataFrame, labels: DataFrame) -> DataFrame:
    """c, fp, n, label and home of the sets in crowds whose centres are of one component, home, where not all are of it; c is the one of these centres with the largest crowds."""
    own = crowd.select(F.col("centres")[0]["b"].alias("centre"), "fp", "n").distinct().join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    own = materialise(own, "crowd_members")
    sums = own.groupBy("centre").agg(F.count(F.lit(1)).alias("size"), F.max(F.when(F.col("fp") == F.col("centre"), F.col("label"))).alias("home"))
    sums = materialise(sums, "crowd_centres")
    homed = materialise(join_by_size(own, sums, ["centre"], "size", own.count()).select("home", "fp", "n", "label").distinct(), "families")
    mixed = homed.groupBy("home").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("home", "size")
    homes = materialise(mixed.join(sums.groupBy("home").agg(F.max_by("centre", F.struct("size", "centre")).alias("c")), "home"), "open_homes")
    return materialise(join_by_size(homed, homes, ["home"], "size", homed.count()).select("c", "fp", "n", "label", "home"), "open_families")


def differences(family: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``family`` with out (neither of the centre's component nor similar to it), spare (how many differences from the centre a similar set need not share with one that is out) and all of them; (c, fp, h, df), the differences that df sets have, two or more."""
    left = family.join(sets.select("fp", F.col("hashes").alias("x")).hint("merge"), "fp")
    both = left.join(sets.select(F.col("fp").alias("c"), F.col("hashes").alias("y")).hint("merge"), "c")
    parts = both.select("c", "fp", "n", "label", "home", F.size("y").alias("m"), F.array_except("x", "y").alias("more"), F.array_except("y", "x").alias("less"))
    out = (F.col("label") != F.col("home")) & ~similar(F.col("n") - F.size("more"), F.col("n"), F.col("m"))
    spare = F.floor((5 * F.size("less") + 4 * F.size("more")) / 9).cast("int")
    rows = materialise(parts.select("c", "fp", "n", "label", "home", out.alias("out"), spare.alias("spare"), F.concat("more", "less").alias("all")), "differences")
    each = rows.select("c", "fp", F.explode("all").alias("h"))
    often = materialise(each.groupBy("c", "h").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "shared_differences")
    return rows.drop("all"), join_by_size(each, often, ["c", "h"], "df", each.count())


def met_differences(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """c, fp, n, label, out, df, h and led: whether h is not among the ``spare`` most frequent differences of its set."""
    ordered = shared.groupBy("c", "fp").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("d"))
    each = rows.join(ordered, ["c", "fp"]).select("c", "fp", "n", "label", "out", (F.size("d") - F.col("spare")).alias("lead"), F.posexplode("d").alias("at", "e"))
    return materialise(each.select("c", "fp", "n", "label", "out", "e.*", (F.col("at") < F.col("lead")).alias("led")).filter("out or led"), "met_differences")


def rest_of_crowds(family: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of sets of different components to compare: those that share a difference from the centre, where one is out and the difference leads in the other one, in both if both are out; and sets with the centre."""
    rows, shared = differences(family, sets)
    met = met_differences(rows, shared)
    own = rows.filter("label <> home and not out").select(F.col("fp").alias("a"), F.col("c").alias("b"))
    parts = (F.col("df") / SPLIT).cast("int")
    left = met.filter("out").select("c", "h", F.pmod(F.xxhash64("fp"), parts + 1).cast("int").alias("tile"), F.col("fp").alias("a"), F.col("n").alias("x"), F.col("label").alias("of_a"), F.col("led").alias("led_a"))
    right = met.filter("led").select("c", "h", F.explode(F.sequence(F.lit(0), parts)).alias("tile"), F.col("fp").alias("b"), F.col("n").alias("y"), F.col("label").alias("of_b"), "out")
    both = left.join(right.hint("merge"), ["c", "h", "tile"]).filter((F.col("of_a") != F.col("of_b")) & similar(F.least("x", "y"), F.col("x"), F.col("y")) & (~F.col("out") | F.col("led_a") & (F.col("a") < F.col("b"))))
    return both.select("a", "b").unionByName(own).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def set_labels(docs: DataFrame, uniq: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """fp and label, the component, of the sets that are linked."""
    met = meetings(uniq)
    crowd = crowds(met)
    pairs = materialise(candidates(uniq, met, crowd), "candidates")
    some = pairs.select(F.explode(F.array("a", "b")).alias("fp")).unionByName(crowd.select("fp")).distinct()
    wanted = materialise(uniq.join(some, "fp", "left_semi").select("fp", "least"), "compared_documents")
    sets = sets_of(docs, wanted, id_col, text_col)
    labels = materialise(components(materialise(compared(pairs, sets), "near_links")), "components").withColumnRenamed("node", "fp")
    family = open_families(crowd, labels)
    if family.isEmpty():
        return labels
    rest = materialise(rest_of_crowds(family, sets), "rest_of_crowds")
    more = materialise(compared(rest, sets), "more_links")
    if more.isEmpty():
        return labels
    known = labels.select(F.col("fp").alias("a"), F.col("label").alias("b"))
    return materialise(components(known.unionByName(more)), "all_components").withColumnRenamed("node", "fp")


def _members(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signatures of all rows; the distinct sets with their components; a row per component with the first of its rows."""
    rows = materialise(signatures(docs, id_col, text_col), "signatures")
    # a null identifier comes last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "digest"))
    uniq = rows.groupBy("fp").agg(first.alias("least"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("bands").alias("bands"))
    uniq = materialise(uniq, "distinct_sets")
    members = uniq.select("fp", "least", "rows").join(set_labels(docs, uniq, id_col, text_col), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    members = materialise(members, "members")
    return rows, members, materialise(members.groupBy("label").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("members")), "groups")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp (of the set) and component_id, the smallest identifier reachable over links."""
    rows, members, groups = _members(docs, id_col, text_col)
    sums = groups.select("label", "members", F.col("first.doc_id").alias("component_id"))
    classes = materialise(join_by_size(members, sums, ["label"], "members", members.count()).select("fp", "rows", "component_id"), "set_classes")
    return join_by_size(rows.select("doc_id", "fp"), classes, ["fp"], "rows", rows.count()).select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group only: that of the smallest identifier (null last) and, where rows repeat that, of the smallest SHA-256 of the text."""
    rows, _, groups = _members(docs, id_col, text_col)
    return keep_firsts(docs, rows, groups, id_col, text_col)
