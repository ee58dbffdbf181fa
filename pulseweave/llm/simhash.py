"""Near duplicates: SimHash fingerprints linked by a generalised pigeonhole search.

1. Python tasks turn each whole text into a 64-bit fingerprint (majority of the
   XXH64 hashes of its word shingles); equal fingerprints are one from here on.
2. Bits that are correlated over all fingerprints go into the same part, so
   that the parts are as independent as can be.
3. If two fingerprints differ in at most d bits, and parts have thresholds t_i
   >= -1 with sum(t_i) = d - parts + 1, then in some part i they differ in at
   most t_i bits. Candidates at threshold 0 are counted over all fingerprints,
   those at 1, 2, .. follow from the bit frequencies, and dynamic programming
   picks the thresholds with the least cost (keys probed and candidates
   verified); -1 leaves a part out.
4. Probes meet the parts' values by an equi-join and candidates are verified.
   A value shared by more than ``crowd`` fingerprints would give them all as
   pairs, so these go another exact way: every such fingerprint sends itself to
   the numbers within ceil(d/2) bits of it. Two fingerprints within d bits have
   such a number in common, and whatever meets there is a chain of links, so
   one link to the smallest of each meeting is enough; a meeting has no more
   members than there are such numbers (65 for d = 2).
5. Components over the links; each document takes the smallest identifier.

Defined cases: null and empty texts have fingerprint zero and are linked like
others; null identifiers are ignored when the smallest is taken; repeated rows
and ties share fingerprint and component; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_by_size, materialise, text_of
from .components import components
from .exact_dedup import digest_of, keep_firsts
from .words import majority_bits, shingle_hashes

#: Cost of verifying a candidate pair against that of writing a probe key.
VERIFY_COST = 1.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, extra: dict[str, Column] | None = None) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, and the ``extra`` columns."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[c.alias(name) for name, c in (extra or {}).items()], text_of(text_col).alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([majority_bits(shingle_hashes(text.as_py(), width, seed)) for text in batch.column(batch.num_columns - 1)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], [*batch.schema.names[:-1], "fp"])

    return texts.mapInArrow(run, f"{kinds}, fp long")


def bit_counts(uniq: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each two bits how many have both; a task sends 64 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((64, 64), np.int64)
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(fps), 16384):
                bits = ((fps[at : at + 16384, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
                both += np.rint(bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(64)), pa.array(both.tolist())], ["bit", "both"])

    sums = uniq.select("fp").mapInArrow(run, "bit long, both array<long>").groupBy("bit").agg(*[F.sum(F.col("both")[k]).alias(f"b{k}") for k in range(64)])
    both = np.zeros((64, 64))
    for row in sums.toLocalIterator():  # 64 rows
        both[row["bit"]] = row[1:]
    return uniq.count(), both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of about equal width, each grown from the most correlated free bit by the bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    free, out = list(range(64)), []
    for k in range(parts):
        width = len(free) // (parts - k)
        group = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < width:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def match_odds(p: np.ndarray, most: int) -> np.ndarray:
    """Odds that two fingerprints differ in at most 0, 1, .. ``most`` of the bits with frequencies ``p`` (a convolution over the bits)."""
    dist = np.zeros(most + 1)
    dist[0] = 1
    for q in 2 * p * (1 - p):
        dist[1:] = dist[1:] * (1 - q) + dist[:-1] * q
        dist[0] *= 1 - q
    return np.cumsum(dist)


def allocate(costs: np.ndarray, budget: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum ``budget`` and least total ``costs[i, t_i + 1]``, by dynamic programming over the parts."""
    best = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t, more in enumerate(row, start=-1):
                if spent + t not in step or cost + more < step[spent + t][0]:
                    step[spent + t] = (cost + more, [*chosen, t])
        best = step
    return best[budget]


def probe_keys(width: int, t: int) -> int:
    return sum(comb(width, k) for k in range(t + 1))


def search_costs(n: int, both: np.ndarray, groups: list[list[int]], distance: int, same: list[float] | None = None) -> np.ndarray:
    """Cost of each part at thresholds -1 .. ``distance``; ``same``: measured pairs that agree in the part."""
    p = np.diag(both) / max(n, 1)
    out = np.zeros((len(groups), distance + 2))
    for i, bits in enumerate(groups):
        odds = match_odds(p[bits], distance)
        pairs = n * n / 2 * odds if same is None else max(same[i], 1.0) * odds / odds[0]
        out[i, 1:] = [n * probe_keys(len(bits), t) + VERIFY_COST * pairs[t] for t in range(distance + 1)]
    return out


def _mask(bits: list[int]) -> int:
    return int(np.array([sum(1 << b for b in bits)], np.uint64).view(np.int64)[0])


def _flips(bits: list[int], most: int) -> list[int]:
    return [_mask(list(c)) for k in range(most + 1) for c in combinations(bits, k)]


def links(uniq: DataFrame, distance: int = 2, crowd: int = 64) -> DataFrame:
    """Pairs (a, b) of fingerprints within ``distance`` bits whose components are those of all such pairs."""
    n, both = bit_counts(uniq)
    # how many parts: by the bit frequencies; the thresholds then by measured agreement
    plans = {parts: allocate(search_costs(n, both, group_bits(n, both, parts), distance), distance - parts + 1)[0] for parts in range(1, distance + 2)}
    parts = min(plans, key=plans.get)
    groups = group_bits(n, both, parts)
    exact = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(bits))).alias("key")) for i, bits in enumerate(groups)])
    values = materialise(uniq.select("fp", F.explode(exact).alias("e")).groupBy("e.part", "e.key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "part_values")
    agree = {r["part"]: float(r["pairs"]) for r in values.groupBy("part").agg((F.sum(F.col("size").cast("double") * (F.col("size") - 1)) / 2).alias("pairs")).collect()}  # a row per part
    _, chosen = allocate(search_costs(n, both, groups, distance, [agree.get(i, 0.0) for i in range(parts)]), distance - parts + 1)

    def keyed(most: list[int]) -> DataFrame:
        def probes(i: int, t: int) -> Column:
            own, flips = F.col("fp").bitwiseAND(F.lit(_mask(groups[i]))), F.array(*[F.lit(flip) for flip in _flips(groups[i], t)])
            return F.transform(flips, lambda flip: F.struct(F.lit(i).alias("part"), own.bitwiseXOR(flip).alias("key")))

        found = F.concat(*[probes(i, t) for i, t in enumerate(most) if t >= 0])
        return uniq.select("fp", F.explode(found).alias("e")).select("fp", "e.part", "e.key")

    used, probed = keyed([min(t, 0) for t in chosen]), keyed(chosen)
    if max(chosen) > 0:
        values = materialise(probed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "probed_values")
    busy = values.filter(F.col("size") > crowd)
    calm = values.filter(F.col("size") <= crowd).select("part", "key")
    # only values that someone shares; what meets in them is bounded by crowd
    left, right = probed.join(calm, ["part", "key"]), used.join(calm, ["part", "key"]).withColumnRenamed("fp", "other")
    near = left.join(right, ["part", "key"]).filter((F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance))
    near = near.select(F.col("fp").alias("a"), F.col("other").alias("b"))
    if busy.isEmpty():
        return near.distinct()
    crowded = join_by_size(probed, busy, ["part", "key"], "size", n).select("fp").distinct()
    ball = F.array(*[F.lit(m) for m in _flips(list(range(64)), -(-distance // 2))])
    met = crowded.select("fp", F.explode(ball).alias("flip")).groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("key")).agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    if distance % 2:  # a meeting spans one bit more than the distance: keep what is near, pairs within its bounded size
        stars = met.select(F.explode("fps").alias("a"), "fps").select("a", F.explode("fps").alias("b")).filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    return near.unionByName(stars).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2, crowd: int = 64, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, fp and component_id, the smallest identifier reachable over links."""
    rows = materialise(fingerprints(docs, id_col, text_col, width, seed), "fingerprints")
    uniq = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "distinct_fingerprints")
    labels = materialise(components(links(uniq, distance, crowd)), "components")
    members = uniq.join(labels, uniq["fp"] == labels["node"]).select("fp", "least", "rows", "label")
    sums = members.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    linked = join_by_size(members, sums, ["label"], "members", uniq.count()).select("fp", "rows", "component_id")
    alone = uniq.join(labels, uniq["fp"] == labels["node"], "left_anti").select("fp", "rows", F.col("least").alias("component_id"))
    classes = materialise(linked.unionByName(alone), "fingerprint_classes")
    return join_by_size(rows, classes, ["fp"], "rows", rows.count()).select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2, crowd: int = 64) -> DataFrame:
    """``docs`` with one row of each group only: that of the smallest identifier (null last) and, where rows repeat that, of the smallest SHA-256 of the text."""
    rows = materialise(fingerprints(docs, id_col, text_col, width, extra={"digest": digest_of(text_col)}), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "digest")).alias("first")
    uniq = materialise(rows.groupBy("fp").agg(first), "distinct_fingerprints")
    labels = components(links(uniq, distance, crowd)).withColumnRenamed("node", "fp")
    groups = uniq.join(labels, "fp", "left").groupBy(F.coalesce("label", "fp").alias("label")).agg(F.min("first").alias("first"))
    return keep_firsts(docs, rows, groups, id_col, text_col)
