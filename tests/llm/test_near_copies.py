"""The pipeline's near copies against brute force."""

import random
import re
from itertools import combinations

import corpus_pipeline


def five_words(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*(words[i:] for i in range(5)))) if len(words) > 4 else frozenset([tuple(words)] if words else [])


def test_stage_removes_near_copies_of_five_words(table, spark, sf):
    rnd = random.Random(12)
    rows = [(900, None), (901, "")]
    for group in range(6):
        base = ["g%dw%d" % (group, rnd.randint(0, 10_000)) for _ in range(150)]
        for k in range(5):
            words = list(base)
            for at in rnd.sample(range(150), k):
                words[at] = "edit%d" % rnd.randint(0, 10_000)
            rows.append((group * 10 + k, " ".join(words)))
    docs = table(rows)
    got = sorted(r.doc_id for r in corpus_pipeline.ngram_join_stage(spark, docs, sf).collect())
    part = {i: i for i, _ in rows}

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    sets = [(i, five_words(t)) for i, t in rows if five_words(t)]
    between = 0
    for (i, a), (j, b) in combinations(sets, 2):
        if 100 * len(a & b) >= 80 * len(a | b):
            between += 100 * len(a & b) < 90 * len(a | b)
            x, y = find(i), find(j)
            part[max(x, y)] = min(x, y)
    assert between > 5 and got == sorted(i for i in part if find(i) == i)
