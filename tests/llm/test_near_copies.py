"""The pipeline's near-dedup stage against all pairs of word-shingle sets."""

import random

import corpus_pipeline
from pulseweave.llm import near_copies, simhash
from pulseweave.llm.words import shingle_hashes


def plain_kept(rows):
    sets = [frozenset(shingle_hashes(t or "", 5).tolist()) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 10 * len(a & b) >= 8 * len(a | b):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    least = {}
    for (i, _), g in zip(rows, label, strict=True):
        least[g] = min(least.get(g, i), i)
    return sorted(least.values())


def test_near_copies_of_the_pipeline(spark):
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(500)]
    words = lambda n: [r.choice(vocab) for _ in range(n)]

    def edited(base, edits):
        out = list(base)
        for k in r.sample(range(len(out)), edits):
            out[k] = r.choice(vocab) + "x"
        return out

    texts = [words(r.randint(5, 150)) for _ in range(40)]
    texts += [edited(t, k) for t in texts[:20] if len(t) > 40 for k in (1, 2, 4)]
    hot = words(120)  # a group in which many pairs are near the similarity, on either side
    texts += [edited(hot, r.randint(0, 6)) for _ in range(120)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, " ".join(texts[3])), (903, "a b")]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted(x.doc_id for x in corpus_pipeline.near_copies(spark, docs, "").collect())
    assert found == plain_kept(rows)
    assert near_copies.near_groups(docs.limit(0)).count() == 0


def test_rows_that_are_no_copies_stay(spark):
    """Null and repeated identifiers, and columns named like those the operators use."""
    r = random.Random(5)
    a, b, c = (" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(60)) for _ in range(3))
    rows = [(None, a), (None, b), (1, c), (7, a + " one two three"), (7, b + " one two three"), (7, b + " one two three"), (8, c + " one"), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, k, "x", 1, "y") for k, (i, t) in enumerate(rows)], "doc_id long, text string, _rows int, _keep_id string, _row_digest int, _digest string").repartition(3)
    out = near_copies.drop_near_copies(docs)
    assert out.columns == docs.columns
    assert sorted((x.doc_id or 0, x.text or "") for x in out.collect()) == sorted([(1, c), (7, a + " one two three"), (7, b + " one two three"), (0, "")])
    alike = simhash.drop_near_copies(docs, distance=0)  # equal fingerprints only
    assert sorted((x.doc_id or 0, x.text or "") for x in alike.collect()) == sorted([(0, a), (0, b), (1, c), (7, a + " one two three"), (7, b + " one two three"), (8, c + " one"), (0, "")])


def test_crowds_lose_no_link(spark, monkeypatch):
    """Groups whose texts are mostly not similar to the ones that all of a crowd are compared with, but to one or two others."""
    monkeypatch.setattr(near_copies, "CROWD", 2)
    r = random.Random(8)
    new = lambda n: ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    texts = []
    for _ in range(4):
        base = new(150)
        for _ in range(30):
            at, gone = r.randrange(100), r.randint(12, 45)
            one = base[:at] + base[at + gone :]
            texts += [base, one, one[: -r.randint(3, 12)], base[:at] + new(gone) + base[at + gone :]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(x.doc_id for x in near_copies.drop_near_copies(docs).collect()) == plain_kept(rows)


def test_rest_of_crowds(spark, monkeypatch):
    """All similar pairs of different components are among those that are compared, and not all pairs are."""
    monkeypatch.setattr(near_copies, "SPLIT", 8)
    r = random.Random(9)
    near = lambda a, b: 10 * len(a & b) >= 8 * len(a | b)
    centre = frozenset(range(40))
    sets = {centre}
    while len(sets) < 300:
        gone, come = set(r.sample(range(40), r.randint(0, 14))), set(r.choices(range(40, 70 if r.random() < 0.5 else 5000), k=r.randint(0, 14)))
        one = (set(centre) - gone) | come
        sets |= {frozenset(one), frozenset(set(sorted(one)[r.randint(0, 3) :]) | {r.randrange(5000)})}
    sets = [centre, *sorted((s for s in sets if s != centre), key=sorted)]
    # some that are similar to the centre are not linked yet; a third of the others are one component
    label = [0 if near(s, centre) and (i == 0 or r.random() < 0.8) else 1 if i % 3 == 1 else i + 2 for i, s in enumerate(sets)]
    family = spark.createDataFrame([(0, i, len(s), label[i], 0) for i, s in enumerate(sets)], "c long, fp long, n long, label long, home long")
    found = {(x.a, x.b) for x in near_copies.rest_of_crowds(family, spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "fp long, hashes array<long>")).collect()}
    # a set that is similar to the centre is compared with it, which links it to all others that are
    at_home = lambda i: near(sets[i], centre) or label[i] == 0
    wanted = {(i, j) for j in range(len(sets)) for i in range(j) if label[i] != label[j] and near(sets[i], sets[j]) and (i == 0 or not (at_home(i) and at_home(j)))}
    assert len(wanted) > 100 and wanted <= found and 3 * len(found) < 300 * 299 // 2
