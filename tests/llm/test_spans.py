import random

import pytest

from quillmill.llm.hashing import codes, rolling, winnow
from quillmill.llm.spans import _called, shared_pairs, shared_runs, shared_share

WORDS = ["alpha", "beta", "gamma", "delta", "naïve", "größe", "token", "value", "λx", "end"]


def prose(seed, n):
    r = random.Random(seed)
    out = ""
    while len(out) < n:
        out += r.choice(WORDS) + str(r.randrange(1000)) + " "
    return out[:n]


def brute(rows, n):
    rows = [(i, t) for i, t in rows if i is not None and t is not None and len(t) >= n]
    grams = {}
    for i, t in rows:
        for p in range(len(t) - n + 1):
            grams.setdefault(t[p : p + n], set()).add(i)
    return {(a, b) for s in grams.values() for a in s for b in s if a < b}


def corpus():
    shared, long = prose(1, 400), prose(2, 900)
    rows = [(i, prose(100 + i, 300)) for i in range(6)]
    rows += [(10, prose(11, 200) + shared + prose(12, 50)), (11, shared), (12, prose(13, 333) + shared[:399] + "|"), (13, prose(14, 10) + long + prose(15, 5)), (14, long[100:] + prose(16, 90)), (15, long), (16, long)]
    # two runs on one diagonal, cut by a replaced character
    rows += [(17, long[:450] + "#" + long[451:])]
    rows += [(20, None), (21, ""), (None, long), (22, "x"), (11, shared)]
    rows += [(23, "ab" * 600), (24, "ab" * 500 + "c")]
    return rows


def test_equals_brute_force(make_docs):
    rows = corpus()
    got = {tuple(r) for r in shared_pairs(make_docs(rows)).collect()}
    assert got == brute(rows, 400)


def test_hot_groups_lose_no_pair(make_docs):
    """Boilerplate below the limit falls apart, groups above it stay whole, also in blocks."""
    short, long = prose(5, 350), prose(6, 410)
    rows = [(i, prose(200 + i, 60) + short + prose(300 + i, 60)) for i in range(12)] + [(50 + i, prose(400 + i, 80) + long + prose(500 + i, 40)) for i in range(9)]
    got = {tuple(r) for r in shared_pairs(make_docs(rows), hot=3, block=4).collect()}
    assert got == brute(rows, 400)


def test_hot_passage_at_its_second_place(make_docs):
    """The run holds hot boilerplate that also stands earlier in both texts, in other company."""
    short = prose(21, 350)
    rows = []
    for i in range(12):
        run = prose(700 + i, 25) + short + prose(800 + i, 25)
        for side in (0, 1):
            n = 1000 + 2 * i + side
            rows.append((n, prose(n, 90) + short + prose(2 * n, 300) + run + prose(3 * n, 70)))
    want = brute(rows, 400)
    got = {tuple(r) for r in shared_pairs(make_docs(rows), hot=3, block=4).collect()}
    assert len(want) >= 12 and got == want


def test_heavy_owners_are_split(make_docs):
    """Shards of little text give the same pairs as one shard."""
    rows = corpus() + [(60 + i, prose(61, 700) + prose(900 + i, 100)) for i in range(8)]
    want = brute(rows, 400)
    assert {tuple(r) for r in shared_pairs(make_docs(rows), shard_chars=900).collect()} == want


def test_repeated_ids_with_other_texts(make_docs):
    """Of an id's texts the one of least digest counts, in every run."""
    import hashlib

    long = prose(41, 600)
    texts = [long + " one", prose(42, 600)]
    kept = min(texts, key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    rows = [(1, texts[0]), (1, texts[1]), (1, None), (2, long), (3, texts[1][:500])]
    want = {(1, 2)} if kept == texts[0] else {(1, 3)}
    assert {tuple(r) for r in shared_pairs(make_docs(rows)).collect()} == want


def test_share_of_records(make_docs):
    long = prose(7, 500)
    out = {r["doc"]: r for r in shared_share(make_docs([(1, long + prose(8, 500)), (2, prose(9, 500) + long), (3, prose(10, 700)), (4, ""), (5, None)])).collect()}
    assert out[1]["shared_chars"] >= 500 and out[1]["partner_texts"] == 1 and abs(out[1]["shared_share"] - 0.5) < 0.01
    assert out[3]["shared_chars"] == 0 and out[4]["shared_chars"] == 0 and 5 not in out


def test_every_run_of_a_pair_counts(make_docs):
    """Two separate runs, in another order in the second text; a third text shares one of them."""
    one, two = "<" + prose(31, 448) + ">", "<" + prose(32, 598) + ">"
    rows = [(1, one + prose(33, 300) + two), (2, prose(34, 200) + two + prose(35, 100) + one), (3, prose(36, 80) + one)]
    docs = make_docs(rows)
    out = {r["doc"]: r for r in shared_share(docs).collect()}
    assert 1050 <= out[1]["shared_chars"] <= 1060 and 1050 <= out[2]["shared_chars"] <= 1060
    assert out[1]["partner_texts"] == 2 and 450 <= out[3]["shared_chars"] <= 460
    got = {tuple(r) for r in shared_runs(docs).collect()}
    text = dict(rows)
    assert len(got) == 4 and all(text[a][i : i + n] == text[b][j : j + n] for a, b, i, j, n in got)


def shuffled(spark):
    """Bytes that stages have shuffled so far."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = store.stageList(None, False, False, none, None)
    return {x.stageId(): x.shuffleWriteBytes() for x in (stages.apply(i) for i in range(stages.size()))}


def test_texts_that_share_nothing_are_not_shuffled(spark, make_docs):
    """Neither for the refinement of hot passages nor for the shards."""
    r = random.Random(51)
    noise = lambda n: "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    long = noise(450)
    rows = [(i, noise(20000)) for i in range(150)] + [(200 + i, noise(50) + long + noise(50)) for i in range(6)]
    docs = make_docs(rows)
    before = set(shuffled(spark))
    got = {tuple(r) for r in shared_pairs(docs, hot=3, block=4).collect()}
    moved = sum(n for i, n in shuffled(spark).items() if i not in before)
    assert got == {(200 + i, 200 + j) for i in range(6) for j in range(i + 1, 6)}
    assert moved < sum(len(t.encode()) for _, t in rows) / 2


@pytest.mark.parametrize("ids", [[], [7], list(range(-40, 4000, 7)), [2**62, -(2**63)]])
def test_called_texts_are_all_kept(spark, ids):
    texts = spark.createDataFrame([(i, str(i)) for i in {*range(-100, 6000), *ids}] + [(None, "x")], "doc bigint, text string")
    got = {r.doc for r in _called(texts, spark.createDataFrame([(i,) for i in ids], "doc bigint")).collect()}
    assert set(ids) <= got and len(got) < len(ids) + 1500


def test_empty_table(make_docs):
    assert shared_pairs(make_docs([])).count() == 0


def test_winnowing_keeps_one_of_every_window():
    h = rolling(codes(prose(3, 3000)), 50)
    at = winnow(h, 40)
    assert at[0] < 40 and all(b - a <= 40 for a, b in zip(at, at[1:]))
