"""Operators that look for copies, against brute force: op4, op7, op9, and the components."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from foldline.llm import decontam
from foldline.llm.components import components
from foldline.llm.debruijn import remove_repeats
from foldline.llm.jaccard import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, anchor string, rep string, token string"


def frame(spark, rows):
    """Rows with other columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "a", "r", "t") for i, t in rows], DOCS)


def some_texts(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(30, 120))] for _ in range(12)]
    out = []
    for i in range(60):
        t = list(rng.choice(base)) if rng.random() < 0.7 else [rng.choice(vocab) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 5)):
            if t:
                t[rng.randrange(len(t))] = rng.choice(vocab)
        if rng.random() < 0.3:
            t = t + rng.choice(base)
        out.append((i, rng.choice([" ", "\n", " \t "]).join(t)))
    return [*out, (100, ""), (101, " \n"), (102, "Aa"), (103, "aa"), (104, "one two three"), (105, "x " * 90), (106, "é b c d e f"), (107, "x " * 90)]


def spans(rows, window):
    count, words = collections.Counter(), [WORD.findall(t or "") for _, t in rows]
    for w in words:
        count.update(tuple(w[j : j + window]) for j in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if count[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        kept = [a for a, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("window", "k"), [(35, 8), (10, 4), (5, 5)])
def test_repeats(spark, window, k):
    rows = [*some_texts(1), (None, "q " * 40), (3, "another text of a known id " * 8), (1000, None), (5, some_texts(1)[5][1])]
    got = [tuple(r) for r in remove_repeats(frame(spark, rows), window, k).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(spans(rows, window), key=key)


def test_many_equal_rows_take_linear_time(spark):
    rng = random.Random(2)
    text = " ".join(f"t{rng.randrange(10_000)}" for _ in range(400))
    other = " ".join(f"u{rng.randrange(10_000)}" for _ in range(400))
    rows = [(7, text)] * 3000 + [(None, text)] * 1000 + [(8, other), (9, "begin " + text + " end"), (None, other + " more")]
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed) for r in remove_repeats(frame(spark, rows)).collect())
    assert got == {(7, 400, 400): 3000, (None, 400, 400): 1000, (8, 400, 400): 1, (9, 402, 400): 1, (None, 401, 400): 1}


def test_long_chains_and_long_texts(spark):
    rng = random.Random(3)
    words = [f"l{rng.randrange(3000)}" for _ in range(30_000)]
    rows = [(1, " ".join(words)), (2, " ".join(["x", *words[5000:25_000], "y"])), (3, " ".join(words[:10_000])), (4, "z " * 50_000), (5, " ".join(words[9000:9040] + ["q"] + words[9040:9100]))]
    got = sorted(tuple(r) for r in remove_repeats(frame(spark, rows)).collect())
    assert got == spans(rows, 35)


def test_words_are_compared_at_their_coordinates(spark, monkeypatch):
    from foldline.llm import debruijn

    real = debruijn.walks
    passage, other = " ".join(f"p{i}" for i in range(50)), " ".join(f"o{i}" for i in range(60))

    def confused(docs, window, k, salt):
        """One text's first step taken for another's, as if their hashes were equal at first."""
        walk = real(docs, window, k, salt)
        if salt:
            return walk
        step = walk.orderBy("start").limit(1).select("anchor", "path", "n", "before", "after")
        row = docs.filter("row_key = 3").select(*debruijn.KEY, F.lit(0).alias("start")).crossJoin(step)
        return debruijn.table(walk.unionByName(row.select(walk.columns)), "confused")

    monkeypatch.setattr(debruijn, "walks", confused)
    rows = [(1, passage), (2, "a " + passage + " b"), (3, other)]
    assert sorted(tuple(r) for r in remove_repeats(frame(spark, rows)).collect()) == spans(rows, 35)


def test_repeats_of_nothing(spark):
    assert remove_repeats(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        remove_repeats(frame(spark, []), 100, 5)


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def linked(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    comp = {i: i for i in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return sorted((i, len(sets[i]), root(i)) for i in ids)


@pytest.mark.parametrize(("seed", "k", "percent", "level"), [(1, 4, 85, 8), (2, 5, 80, 3), (3, 2, 60, 1)])
def test_near_duplicates(spark, seed, k, percent, level):
    rows = some_texts(seed)
    got = sorted(tuple(r) for r in near_duplicates(frame(spark, rows), k, percent, level).collect())
    assert got == linked(rows, k, percent)


def test_near_duplicates_of_a_group_around_its_original(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        t = list(base)
        for j in rng.sample(range(120), 3):
            t[j] = f"n{i}-{j}"
        rows.append((i, " ".join(t)))
    assert sorted(tuple(r) for r in near_duplicates(frame(spark, rows), 4, 80).collect()) == linked(rows, 4, 80)


def test_near_duplicates_edges(spark):
    assert near_duplicates(frame(spark, [])).collect() == []
    rows = [(1, None), (None, "a b c d e f g"), (2, "a b c d e f g"), (2, "z y x w v u t"), (3, "z y x w v u t")]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows)).collect()}
    assert got == {(1, 0, 1), (None, 3, 2), (2, 3, 2), (3, 3, 2)}


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(60, 50), (60, 70), (9, 9), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 60: 50, 70: 50}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


def contained(docs, items, k, percent):
    out = []
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        for i, x in items:
            v = WORD.findall((x or "").lower())
            m = min(k, len(v))
            if m:
                want = {tuple(v[j : j + m]) for j in range(len(v) - m + 1)}
                both = want & {tuple(w[j : j + m]) for j in range(len(w) - m + 1)}
                if 100 * len(both) >= percent * len(want):
                    out.append((d, i, len(want), len(both)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [8 << 20, 900])
def test_contained_items(spark, block):
    rng = random.Random(4)
    items = [(i, " ".join(f"v{rng.randrange(300)}" for _ in range(rng.randint(1, 60)))) for i in range(20)] + [(50, None), (51, ""), (52, "Single"), (53, "two words"), (0, "again an id")]
    docs = []
    for i in range(40):
        body = [f"v{rng.randrange(300)}" for _ in range(rng.randint(0, 200))]
        v = rng.choice(items)[1] or ""
        v = v.split()
        for _ in range(rng.randint(0, 2)):
            if v:
                v[rng.randrange(len(v))] = "changed"
        docs.append((i, " ".join(body[:50] + v + body[50:])))
    docs += [(90, None), (91, ""), (92, "a SINGLE thing"), (None, "two words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontam.contained_items(frame(spark, docs), bench, block_bytes=block).collect()]
    want = contained(docs, items, 5, 80)
    assert sorted(got, key=str) == want and want
    clean = decontam.remove_contaminated(frame(spark, docs), bench, block_bytes=block)
    assert clean.columns == frame(spark, docs).columns
    bad = {w[0] for w in want}
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, _ in docs if d not in bad)


def test_contained_items_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contained_items(frame(spark, [(1, "a b")]), none).collect() == []
    assert decontam.contained_items(frame(spark, []), spark.createDataFrame([(1, "a")], none.schema)).collect() == []
    assert decontam.remove_contaminated(frame(spark, [(1, "a b")]), none).count() == 1
