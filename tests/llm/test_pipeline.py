"""The pipeline's rows against a plain version of its stages, and the registered queries."""

import hashlib
import random
from collections import Counter, defaultdict

import __spark_entry__
import corpus_pipeline
from pulseweave.llm import registry

from .test_documents import WORD, plain_best_fit, plain_measures, water_fill
from .test_near_copies import plain_kept


def rows():
    r = random.Random(11)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(400)]
    out = []
    for i in range(60):
        out.append((i, " ".join(r.choice(vocab) for _ in range(r.randint(12, 200))), "en", f"s{i % 4}" if i % 5 else None, 0))
    out += [(60 + i, out[i][1], "de", "s1", 0) for i in range(8)]
    out += [(70 + i, out[20 + i][1] + " end", "de", "s2", 0) for i in range(4)]
    return [*out, (90, None, None, "s1", 0), (91, "too short", None, "s1", 0), (92, "a b c d e " * 30, "en", "s3", 0)]


def plain_pipeline(docs, ids):
    docs = [d for d in docs if (m := plain_measures(d[1]))[0] >= 10 and 100 * m[4] <= 20 * m[0]]
    best = {}
    for d in docs:
        best[d[1]] = max(best.get(d[1], -1), d[0])
    docs = [d for d in docs if best[d[1]] == d[0]]
    kept = set(plain_kept([(d[0], d[1]) for d in docs]))
    docs = [d for d in docs if d[0] in kept]
    size = {d[0]: len(WORD.findall(d[1])) for d in docs}
    sources = defaultdict(list)
    for d in docs:
        sources[d[3]].append(d[0])
    names = sorted(sources, key=lambda s: (s is None, s or ""))
    target = water_fill({s: sum(size[i] for i in own) for s, own in sources.items()}, {s: k % 3 + 1 for k, s in enumerate(names)})
    copies = {}
    for s, own in sources.items():
        total = sum(size[i] for i in own)
        whole = int(round(target[s], 6) // total)
        left = round(target[s], 6) - whole * total
        copies |= dict.fromkeys(own, whole)
        taken = set()
        number = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)
        for i in sorted(own, key=number) if left > 0 else ():
            if size[i] > left:
                break
            left -= size[i]
            taken.add(i)
        for i in sorted((i for i in own if i not in taken), key=lambda i: (-size[i], number(i))):
            if size[i] <= left:
                left -= size[i]
                taken.add(i)
        for i in taken:
            copies[i] += 1
    lengths = {d[0]: len(ids(d[1])) + 1 for d in docs}
    return Counter((i, k, start, min(2048, lengths[i] - start)) for i, n in copies.items() for _ in range(n) for k, start in enumerate(range(0, lengths[i], 2048)))


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    from pulseweave.llm.tokens import default_path

    t = Tokenizer.from_file(default_path())
    spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    expected = plain_pipeline(rows(), lambda text: t.encode(text, add_special_tokens=False).ids)
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in found) == expected
    assert len({r.sequence_id for r in found}) == len(plain_best_fit([k[3] for k, n in expected.items() for _ in range(n)], 2048))


def test_registered():
    names = list(registry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert {"pipeline", *names} <= set(__spark_entry__.queries()) and set(registry.oracle_sql()) <= set(names)
    assert [s for s, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5
