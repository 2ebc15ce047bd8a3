import random

from quillmill.llm import leakage
from quillmill.llm.leakage import leaks, words

ITEM = "Given the excerpt decide what the walker returns when every ledger of the quiet shard was sealed before the third beacon could be traced by another frozen lantern"
OTHER = "Given the excerpt decide what the walker returns if nobody has opened a second journal while the outer gate kept nine unread packets for the late visitor on call"


def found(spark, make_docs, docs, items=((1, ITEM), (2, OTHER)), **kw):
    i = spark.createDataFrame([(a, "s", b, "clash") for a, b in items], "item_id bigint, suite string, text string, doc_id string")
    return {(r["doc_id"], r["item_id"]) for r in leaks(make_docs(docs), i, **kw).collect()}


def test_whole_part_disguised_and_not(spark, make_docs):
    w = ITEM.split()
    half, less = " ".join(w[8:24]), " ".join(w[8:20])
    docs = [
        (1, f"before it {ITEM} and after"),
        (2, ITEM.upper().replace(" ", "\n* ") + "!"),
        (3, "x " + " ".join(f"<b>{x}</b>" for x in w)),
        (4, f"text {half} text"),
        (5, f"text {less} text"),
        (6, " ".join("changed" if i in (4, 12, 20) else x for i, x in enumerate(w))),
        (7, " ".join(w[:9]) + " something else stands in between here " + " ".join(w[14:24])),
        (8, " ".join(reversed(w))),
        (9, " ".join(w[:7]) + " and then it goes on without any of it"),
        (10, None), (11, ""), (12, "Given the excerpt decide what the walker returns"),
        (13, " ".join(x + " filler filler filler" for x in w)),
    ]
    assert found(spark, make_docs, docs) == {(i, 1) for i in (1, 2, 3, 4, 6, 7)}


def test_ties_repeats_empty(spark, make_docs):
    assert found(spark, make_docs, [(1, ITEM), (1, ITEM), (2, ITEM)], items=((1, ITEM), (3, ITEM), (4, None), (5, ""))) == {(1, 1), (2, 1), (1, 3), (2, 3)}
    assert found(spark, make_docs, []) == set()
    assert found(spark, make_docs, [(1, ITEM)], items=()) == set()
    assert found(spark, make_docs, [(1, "so a b it is"), (2, "a c b")], items=((1, "a b"),)) == {(1, 1)}


def test_item_shards_give_the_same(spark, make_docs):
    docs = [(1, ITEM + " " + OTHER)]
    assert found(spark, make_docs, docs, shard_words=10) == {(1, 1), (1, 2)}


def test_words():
    assert words("A_b **c** &nbsp; d­e ＦＵＬＬ") == ["a_b", "c", "de", "full"]


def plain(p, w, share=0.5, penalty=3.0, join=8, near=60, least=8):
    """Every diagonal compared in full, nothing ruled out before."""
    import numpy as np

    out, ids = [], np.array([p.number.get(x, 0) for x in w], np.int64)
    for i, n in enumerate(p.size.tolist()):
        own, parts = p.words[p.start[i] : p.start[i] + n], []
        for d in range(1 - n, len(ids)):
            i0, i1 = max(0, -d), min(n, len(ids) - d)
            parts += [(i0 + s, i0 + e, d + i0 + s, m) for s, e, m in leakage.segments(own[i0:i1] == ids[d + i0 : d + i1], penalty) if m >= 3]
        if n >= 3 and leakage.chained(parts, penalty, join, near, min(least, max(3, n // 4))) >= share * n:
            out.append(i)
    return out


def test_nothing_is_ruled_out_that_scoring_accepts():
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([3, 5, 7, 12, 20, 40, 120, 300])))) for i in range(40)]
    p = leakage.Patterns(items)
    scan = leakage._scan(p, 0.5, 3.0, 8, 60, 8)
    hits = 0
    for _ in range(150):
        text = r.choices(vocabulary, k=r.randint(0, 60))
        for _, item in r.sample(items, 2):
            w = item.split()
            a = r.randint(0, len(w) // 2)
            part = w[a : a + r.randint(len(w) // 3, len(w))]
            part = [r.choice(vocabulary) if r.random() < r.choice([0.0, 0.1, 0.2]) else x for x in part]
            if r.random() < 0.4:
                k = r.randint(0, len(part))
                part = part[:k] + r.choices(vocabulary, k=r.randint(1, 40)) + part[k + r.randint(0, 20) :]
            text += part + r.choices(vocabulary, k=r.randint(0, 30))
        got = sorted(i for i, _, _ in scan(text))
        assert got == plain(p, text)
        hits += len(got)
    assert hits > 100
