import os
import random

import pytest
from pyspark.sql import functions as F

from quillmill.llm import mixing, packing, splitting, tokens

TOKENIZER = pytest.mark.skipif(not os.path.exists(tokens.TOKENIZERS), reason="vocabulary files are not here")


def test_best_fit_is_valid_and_tight():
    r = random.Random(3)
    items = [(i, r.randint(0, 120)) for i in range(3000)]
    out = list(packing.pack(sorted(items, key=lambda x: -x[1]), 100))
    per, whole = {}, {}
    for key, part, container, size, over in out:
        assert over == (dict(items)[key] > 100)
        per[container] = per.get(container, 0) + size
        whole.setdefault(key, []).append(size)
    assert max(per.values()) <= 100 and {k: sum(v) for k, v in whole.items()} == dict(items)
    assert all(len(whole[k]) == (2 if s > 100 else 1) for k, s in items)
    least = sum(s for _, s in items) / 100
    assert len(per) <= least * 1.1
    # few open bins and sizes in any order still leave little space
    assert len({c for _, _, c, *_ in packing.pack(items, 100, bins=64)}) <= least * 1.15


def test_best_fit_takes_the_tightest_and_closes_the_fullest():
    fit = packing.BestFit(10, bins=2)
    assert [fit.place(s) for s in (6, 7, 3, 5, 9)] == [0, 1, 1, 2, 3]
    assert fit.open == 2  # 0 was the fullest open one and closed


def test_free_space_finds_the_least_that_fits():
    r = random.Random(5)
    for most in (0, 9, 1023, 1024, 1 << 20, 1 << 33):
        space, plain = packing.FreeSpace(most), set()
        for _ in range(400):
            x = r.randint(0, most)
            if x in plain:
                space.remove(x)
                plain.remove(x)
            else:
                space.add(x)
                plain.add(x)
            y = r.randint(0, most)
            assert space.at_least(y) == min((p for p in plain if p >= y), default=-1)


def test_chunks_cost_little_space():
    """A group packed whole, and in chunks: the share of space lost stays small."""
    r = random.Random(8)
    sizes = [r.randint(1, 400) for _ in range(20_000)]
    lost = lambda n: 1 - sum(sizes) / 1000 / sum(len({c for _, _, c, *_ in packing.pack(enumerate(sizes[i : i + n]), 1000, bins=256)}) for i in range(0, len(sizes), n))
    assert lost(20_000) < 0.01 and lost(5_000) < 0.01


def items(spark, rows):
    return spark.createDataFrame(rows, "g string, k string, s bigint, c bigint, chunk string")


def test_pack_items(spark):
    rows = [("a", "x", 5, 10, "!"), ("a", "y", 6, 10, "!"), ("a", "z", 25, 10, "!"), ("a", "x", 5, 10, "!"), ("b", "n", None, 10, "!"), ("b", "m", -4, 10, "!"), (None, "q", 3, None, "!"), (None, "r", 3, 0, "!"), ("b", None, 2, 10, "!")]
    packed = packing.pack_items(items(spark, rows), "g", "k", "s", "c")
    got = packed.collect()
    assert sum(r["size"] for r in got) == 5 + 6 + 25 + 5 + 0 + 0 + 3 + 3 + 2
    fill = {}
    for r in got:
        if r["grp"]:
            fill[r["grp"], r["container"]] = fill.get((r["grp"], r["container"]), 0) + r["size"]
    assert max(fill.values()) <= 10
    assert {tuple(r) for r in packing.oversize(packed).collect()} == {("a", "z"), (None, "r")}
    assert packing.pack_items(items(spark, []), "g", "k", "s", "c").count() == 0


def test_hot_group_is_split(spark):
    rows = [("h", f"k{i}", 1 + i % 7, 50, "!") for i in range(2000)]
    got = packing.pack_items(items(spark, rows), "g", "k", "s", "c", chunk=300).groupBy("container").agg(F.sum("size").alias("n")).collect()
    total = sum(1 + i % 7 for i in range(2000))
    assert sum(r["n"] for r in got) == total and max(r["n"] for r in got) <= 50 and len(got) <= total / 50 + 10


def test_equal_rows_part_over_chunks(spark):
    rows = [("h", "same", 3, 10, "!")] * 900 + [("h", "more", 11, 10, "!")] * 2
    packed = packing.pack_items(items(spark, rows), "g", "k", "s", "c", chunk=100)
    got = packed.where("item = 'same'").collect()
    assert len(got) == 900 and len({r["container"].split("-")[1] for r in got}) > 5
    assert packed.where("over").count() == 4 and [tuple(r) for r in packing.oversize(packed).collect()] == [("h", "more")]


def least_cost(cost, limit, overlap, balance=8.0):
    """Brute force over all cuts of the same objective."""
    n, step = len(cost) - 1, limit - overlap
    size = (n - overlap) / (1 + -(-(n - limit) // step))
    best = {0: 0.0}

    def solve(e):
        if e not in best:
            options = []
            if overlap < e <= limit:
                options.append(balance * ((e - overlap - size) / step) ** 2 + 1.0)
            options += [solve(s) + balance * ((e - s - size) / step) ** 2 + 1.0 for s in range(max(overlap + 1, e - step), e)]
            best[e] = min(options, default=float("inf")) + cost[e]
        return best[e]

    return solve(n)


def test_cuts_are_optimal():
    r = random.Random(5)
    import numpy as np

    for _ in range(60):
        n, limit = r.randint(6, 40), r.randint(3, 9)
        overlap = r.randint(0, limit - 1)
        if n <= limit:
            continue
        cost = np.array([0.0] + [r.random() * 10 for _ in range(n - 1)] + [0.0])
        ends = splitting.cuts(cost, limit, overlap)
        step, size = limit - overlap, (n - overlap) / (1 + -(-(n - limit) // (limit - overlap)))
        total = sum(cost[e] + 8.0 * ((e - s - size) / step) ** 2 + 1.0 for s, e in zip([overlap, *ends], ends))
        assert abs(total - least_cost(cost, limit, overlap)) < 1e-9


@pytest.mark.parametrize("limit,overlap", [(3, 0), (10, 3), (40, 3), (5, 9), (1, 0)])
def test_split_round_trip(limit, overlap):
    r = random.Random(limit)
    text = "\n".join(r.choice(["", "def f():", "    x = 1", "}", "# note", "prose goes on."]) for _ in range(137))
    pieces = splitting.split(text, limit, overlap)
    assert splitting.joined(pieces) == text and all(p.count("\n") + 1 <= limit for _, _, p in pieces)
    o = min(overlap, limit - 1)
    assert all(b[0] == a[1] - o + 1 for a, b in zip(pieces, pieces[1:]))


def test_cuts_prefer_blank_lines():
    text = "\n".join(["def f():", "    a", "    b", "", "def g():", "    c", "    d", "", "def h():", "    e"])
    assert [p[0] for p in splitting.split(text, 5, 0)] == [1, 5, 9]


def test_split_items(spark):
    rows = [(1, 1, "a\nb\nc\nd", "!"), (2, 1, "a\nb", "!"), (3, 2, "a\nb\nc", "!"), (4, None, "a\nb\nc", "!"), (5, 1, None, "!"), (6, 1, "", "!"), (7, 1, "\n\n", "!"), (1, 1, "a\nb\nc\nd", "!")]
    df = spark.createDataFrame(rows, "proc_id bigint, config_id bigint, content string, key string")
    configs = spark.createDataFrame([(1, 2, 1), (2, 0, 0), (3, None, None)], "config_id bigint, truncate_lines int, overlap_lines int")
    out = splitting.split_items(df, configs).collect()
    assert {r["proc_id"] for r in out} == {1, 7} and sum(r["proc_id"] == 1 for r in out) == 6
    assert splitting.split_items(df.limit(0), configs).count() == 0


WORDS = "the and of is budget walker frame token quiet lens".split()


def docs(spark, n=400):
    r = random.Random(9)
    rows = [(i, " ".join(r.choices(WORDS, k=r.randint(5, 300))) + (" 12345!" * r.randint(0, 9)), r.choice(["en", "EN-us", None, "und"]), r.choice(["a", "A ", "b", "b", "b", "c", None]), r.choice(["x", None])) for i in range(n)]
    rows += [(n, None, "en", "a", "x"), (n + 1, "", None, "", "")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, domain string")


@TOKENIZER
def test_token_totals_near_the_true_ones(spark):
    d = docs(spark)
    out = {(r["by"], r["label"]): r for r in tokens.totals(d).collect()}
    count = tokens.counter(tokens.TOKENIZERS)
    true = sum(count([r["text"] or "" for r in d.collect()]))
    assert abs(out["all", "all"]["tokens"] - true) < 0.02 * true and out["all", "all"]["documents"] == 402
    assert {k for b, k in out if b == "source"} == {"a", "b", "c", "unknown"} and {k for b, k in out if b == "language"} <= {"en", "unknown"}
    assert tokens.totals(d.limit(0)).count() == 0


@TOKENIZER
def test_mixture_follows_targets(spark):
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.15, 9), ("gone", 0.05, 3)], "source string, target_share double, max_repeats int")
    selection, report = mixing.mixture(docs(spark), targets)
    got = {r["source"]: r for r in report.collect()}
    assert got["gone"]["mixed_tokens"] == 0
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert abs(got[s]["reached_share"] - share / 0.95) < 0.02
    caps = {"a": 2, "b": 1, "c": 9}
    assert all(1 <= r["copies"] <= caps[r["source"]] for r in selection.collect())
    again = {tuple(r) for r in mixing.mixture(docs(spark), targets)[0].collect()}
    assert again == {tuple(r) for r in selection.collect()}
    capped = {r["source"]: r for r in mixing.mixture(docs(spark), targets, total_tokens=10**7)[1].collect()}
    assert capped["a"]["mixed_tokens"] == 2 * capped["a"]["available_tokens"]
    assert mixing.mixture(docs(spark).limit(0), targets)[0].count() == 0


@TOKENIZER
def test_counts_of_both_libraries_agree():
    texts = ["fn main() { println!(\"größe\"); }", "", None, " " * 3000 + "x\n\n\n", "naïve 日本語 12345", " " * 1_000_000]
    other = tokens.counter(tokens.TOKENIZERS.replace(".tiktoken", ".json"))
    assert tokens.counter(tokens.TOKENIZERS)(texts) == other(texts)


def test_language_is_told_by_words():
    said = [("en", "the walker reads the file and keeps it"), ("de", "der Baum liest die Datei und behält sie"), ("en", "a file of the tree"), ("de", "eine Datei des Baums und der Rest")]
    model = tokens.LanguageModel(said * 5)
    assert model.tell("the rest of the file") == "en" and model.tell("der Rest und die Datei") == "de"
    assert model.tell("1234 !!") == "unknown" and model.tell(None) == "unknown" and tokens.LanguageModel([]).tell("the") == "unknown"


@TOKENIZER
def test_mixture_selects_by_key_within_the_budget(spark):
    """Short texts have low weights; what is selected is a head of the key order of each source."""
    from pyspark.sql import functions as F

    rows = [(i, "a b" if i % 3 else "a long text of many words " * 12, "a") for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    selection, report = mixing.mixture(d, targets, total_tokens=6000)
    u = (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keys = {r[0]: r[1] for r in d.select("doc_id", -F.log(u) / mixing.quality(F.col("text"))).collect()}
    took = {r["doc_id"]: r["tokens"] for r in selection.collect()}
    order, total, want = sorted(keys, key=lambda i: (keys[i], i)), 0, set()
    count = dict(zip([r[0] for r in rows], tokens.counter(tokens.TOKENIZERS)([r[1] for r in rows])))
    for i in order:
        total += count[i]
        if total <= 6000:
            want.add(i)
    assert set(took) == want and sum(took.values()) <= 6000
