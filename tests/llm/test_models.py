"""Language ID, quality, personal data and nearest neighbours: op1, op2, op5, op10."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldline.llm import ann, langid, pii, qda

DOCS = "doc_id long, text string, lang string, x string, score string, held_out boolean"
TEXTS = {"en": "the house and the garden of the old teacher who was reading", "de": "das haus und der garten von dem alten lehrer der gelesen hat", "fr": "la maison et le jardin du vieux professeur qui lisait"}


def labelled(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(90):
        lang = list(TEXTS)[i % 3]
        words = TEXTS[lang].split()
        rows.append((i, " ".join(rng.permutation(words)[:8]), lang, "x", "s", True))
    return rows


def test_lattice_sums_all_segmentations():
    vocab = langid.Pieces(["▁", "▁a", "a", "b", "ab", "▁ab", "ba"])
    prob = np.random.default_rng(0).random((vocab.size, 2))
    row, number, cps, start, _ = langid._words(pa.array(["abab x", "", None, "A1ba"]))
    assert row.tolist() == [0, 0, 3, 3]
    lat = langid.Lattice(cps, start, vocab)
    w = lat.weights(prob)
    f, b = lat.forward(w), lat.backward(w)
    names = {"▁": 1, "▁a": 2, "a": 3, "b": 4, "ab": 5, "▁ab": 6, "ba": 7}
    for i, (s, e) in enumerate(zip(lat.start, lat.end, strict=True)):
        word = "".join(map(chr, cps[s:e]))
        best = [np.ones(2), *[np.zeros(2) for _ in word]]
        for j in range(1, len(word) + 1):
            for k in range(j):
                p = names.get(word[k:j], 0 if j - k == 1 else None)
                if p is not None:
                    best[j] = best[j] + best[k] * prob[p]
        assert np.allclose(f[lat.last[i]] * np.exp(-langid._GAIN * len(word)), best[-1])
        assert np.allclose(b[lat.first[i]], f[lat.last[i]])
        for short in (True, False):
            assert np.allclose(lat.log_sums(prob, short)[i], np.log(best[-1]))
    assert np.allclose(lat.log_backward(lat.log_weights(prob))[lat.first], lat.log_forward(lat.log_weights(prob))[lat.last])


def plain_log(word, logs):
    """The sum over all segmentations by its definition, in logarithms."""
    word, best = "▁" + word, [0.0]
    for j in range(1, len(word) + 1):
        x = [best[k] + logs[word[k:j] if word[k:j] in logs else None] for k in range(max(0, j - 24), j) if word[k:j] in logs or j - k == 1]
        best.append(max(x) + np.log(sum(np.exp(v - max(x)) for v in x)))
    return best[-1]


@pytest.mark.parametrize("known", [2, 400_000])
def test_classifier_equals_the_sum_for_words_of_any_length(monkeypatch, known):
    monkeypatch.setattr(langid, "KNOWN", known)
    names = ["▁", "▁the", "the", "▁d", "er", "a", "q", "qq", "aer"]
    rng = np.random.default_rng(4)
    prob = rng.dirichlet(np.ones(len(names) + 1), 2).T.copy()
    prob[0] = (2e-9, 1e-9)  # letters outside all pieces
    model = {"pieces": names, "langs": ["x", "y"], "prob": prob}
    classify = langid.Classifier(model)
    logs = [{None: np.log(prob[0, j])} | {p: np.log(prob[i + 1, j]) for i, p in enumerate(names)} for j in (0, 1)]
    texts = ["the der", "theqqaer " + "q" * 90, "ж" * 45, "ж" * 1000, "aer" * 40, "der the the", "der " * 3, None, "12"]
    for part in (texts, texts[::-1], texts[2:5]):
        best, score = classify(pa.array(part, pa.string()))
        for t, b, s in zip(part, best.tolist(), score.tolist(), strict=True):
            words = re.findall("[^\\W\\d_]+", t or "")
            if not words:
                assert (b, s) == (2, 0)
                continue
            total = np.array([sum(plain_log(w, logs[j]) for w in words) for j in (0, 1)])
            share = np.exp(total - total.max())
            assert b == total.argmax() and s == pytest.approx(share.max() / share.sum(), rel=1e-9)
    assert classify(pa.array(["ж" * 1000]))[0][0] == 0


def test_expectation_equals_a_plain_one():
    names = ["▁", "▁a", "a", "b", "ab", "ba"]
    rng = np.random.default_rng(6)
    prob = rng.dirichlet(np.ones(len(names) + 1), 2).T.copy()
    rows = [("abab ba", "x"), ("ba " + "ab" * 30, "y"), ("c ab", "x"), ("", "y"), ("1", "x")]
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows]), pa.array([g for _, g in rows])], names=["text", "lang"])
    got = np.frombuffer(next(langid._expect(names, ["x", "y"], prob)(iter([batch]))).column(0)[0].as_py()).reshape(prob.shape)
    want = np.zeros(prob.shape)
    for text, lang in rows:
        j = "xy".index(lang)
        for w in re.findall("[a-z]+", text):
            w = "▁" + w
            edges = [(a, b, names.index(w[a:b]) + 1 if w[a:b] in names else 0) for a in range(len(w)) for b in range(a + 1, min(a + 3, len(w) + 1)) if w[a:b] in names or b - a == 1]
            f, r = [1.0, *[0.0] * len(w)], [*[0.0] * len(w), 1.0]
            for a, b, p in sorted(edges, key=lambda e: e[1]):
                f[b] += f[a] * prob[p, j]
            for a, b, p in sorted(edges, key=lambda e: -e[0]):
                r[a] += prob[p, j] * r[b]
            for a, b, p in edges:
                want[p, j] += f[a] * prob[p, j] * r[b] / f[-1]
    assert np.allclose(got, want)


def test_language(spark):
    rows = labelled(spark)
    df = spark.createDataFrame(rows, DOCS)
    model = langid.fit(df)
    tests = [(1, TEXTS["de"], None), (2, TEXTS["fr"].upper(), "en"), (3, None, "en"), (4, "12 345 !!", "en"), (5, "", None), (None, TEXTS["en"], None), (6, "q" * 1000, None)]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame([(i, t, g, "x", "s", False) for i, t, g in tests], DOCS), model, ["doc_id", "held_out"]).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, None)] == ["de", "fr", "und", "und", "und", "en"]
    assert got[3].score == 0 and got[1].score > 0.9 and got[6].lang_pred in TEXTS
    kept = langid.keep_identified(df, model)
    assert kept.count() == 90 and kept.filter("lang is null").count() == 0


def test_language_without_labels(spark):
    model = langid.fit(spark.createDataFrame([(1, "a", None, "", "", True)], DOCS))
    assert langid.predict(spark.createDataFrame([(1, "abc", None, "", "", True)], DOCS), model, ["doc_id"]).first().lang_pred == "und"
    assert langid.predict(spark.createDataFrame([], DOCS), model, ["doc_id"]).count() == 0


STOPS, SIGNS = set(".,;:?'\"()-"), set("#$%&*@^~|<>{}[]\\_=+/`")


def plain_statistics(text):
    """The statistics of a text by their definitions, one by one."""
    text = text or ""
    data, k = text.encode(), qda.WEIGHT
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    size = [len(w) for w in words]
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    lines = [tuple(x) for line in data.split(b"\n") if (x := re.findall(rb"[^\x20\x09-\x0D]+", line))]
    ascii_ = [chr(c) for c in data if c < 128]
    n, chars = len(words), len(data)
    mean, square = (sum(size) + 5 * k) / (n + k), (sum(x * x for x in size) + 35 * k) / (n + k)
    upper, lower = sum("A" <= c <= "Z" for c in ascii_), sum("a" <= c <= "z" for c in ascii_)
    shares = [
        (len(set(words)), n), (len(set(triples)), len(triples)), (max((words.count(w) for w in set(words)), default=0), n), (sum(a == b for a, b in zip(words, words[1:], strict=False)), n), (upper, upper + lower),
        (sum(c in SIGNS for c in ascii_), chars), (sum(c.isdigit() for c in ascii_), chars), (sum(c in STOPS for c in ascii_), chars), (ascii_.count("!"), chars), (ascii_.count("\n"), chars), (chars - len(ascii_), chars), (sum(x <= 3 for x in size), n), (len(set(lines)), len(lines)),
    ]
    p = np.array([(a + k * u) / (b + k) for (a, b), u in zip(shares, qda.USUAL, strict=True)])
    return np.array([np.log(n + 4 * k), np.log1p(mean), np.log1p(np.sqrt(max(square - mean**2, 0))), *np.log(p / (1 - p))])


def quality_texts():
    rng = np.random.default_rng(8)
    bits = ["the", "House", "12", "a!", "$$$", "\n", "été", "and,", "READ", "x" * 30, "\t", "garden", "(so)", "the", "the"]
    return ["", None, "one", "a a a", "\n\n", " ".join(["long"] * 5000), *[" ".join(rng.choice(bits, rng.integers(1, 80), p=rng.dirichlet(np.ones(len(bits))))) for _ in range(120)]]


def test_statistics_equal_their_definitions():
    texts = quality_texts()
    assert np.allclose(qda.statistics(pa.array(texts, pa.string())), [plain_statistics(t) for t in texts])


def test_quality_equals_a_plain_discriminant(spark):
    texts = quality_texts()
    rows = [(i, t, (0, 1, 1, 7, None)[i % 5]) for i, t in enumerate(texts)]
    stats = qda.with_statistics(spark.createDataFrame(rows, "doc_id long, text string, label int"), ["doc_id", "label"])
    got = {r.doc_id: r.score for r in qda.predict(stats, qda.fit(stats, ridge=0.05)).collect()}
    x = np.array([plain_statistics(t) for t in texts])
    y = np.array([-1 if g not in (0, 1) else g for _, _, g in rows])
    used = x[y >= 0]
    z = (x - used.mean(axis=0)) / (used.std(axis=0) + 1e-6)
    d, log = z.shape[1], []
    cov = {c: np.cov(z[y == c].T, bias=True) for c in (0, 1)}
    n = {c: (y == c).sum() for c in (0, 1)}
    pooled = sum(n[c] * cov[c] for c in n) / sum(n.values())
    for c in (0, 1):
        a = d / (d + n[c])
        s = (1 - a) * cov[c] + a * pooled
        s = 0.95 * s + 0.05 * np.trace(s) / d * np.eye(d)
        m = z[y == c].mean(axis=0)
        log.append(np.array([plain_density(v, m, s) for v in z]) + np.log(n[c] / sum(n.values())))
    assert np.allclose([got[i] for i in range(len(texts))], 1 / (1 + np.exp(log[0] - log[1])), atol=1e-7)


def plain_density(x, m, s):
    d = x - m
    return -0.5 * d @ np.linalg.inv(s) @ d - 0.5 * np.linalg.slogdet(s)[1]


def test_quality(spark):
    rng = np.random.default_rng(2)
    good = [(i, " ".join(rng.choice(TEXTS["en"].split(), 40)) + ".", 1) for i in range(80)]
    bad = [(100 + i, "$$$ ".join(rng.choice(["BUY", "NOW!!", "###"], 30)), 0) for i in range(60)]
    df = spark.createDataFrame(good + bad + [(999, "x", None), (998, "y", 7)], "doc_id long, text string, label int")
    stats = qda.with_statistics(df, ["doc_id", "label"])
    model = qda.fit(stats)
    got = {r.doc_id: r.score for r in qda.predict(stats, model).collect()}
    assert all(got[i] > 0.9 for i, _, _ in good) and all(got[i] < 0.1 for i, _, _ in bad)
    x = np.array([r.x for r in stats.filter("doc_id = 5").collect()])
    z = (x[0] - model["center"]) / model["scale"]
    logs = [plain_density(z, model["mean"][c], np.linalg.inv(model["factor"][c] @ model["factor"][c].T)) + np.log((60, 80)[c] / 140) for c in (0, 1)]
    assert got[5] == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])), abs=1e-9)


def test_quality_edges(spark):
    stats = qda.with_statistics(spark.createDataFrame([(1, None, 1), (2, "", 1)], "doc_id long, text string, label int"), ["doc_id", "label"])
    model = qda.fit(stats)
    assert {r.score for r in qda.predict(stats, model).collect()} == {3 / 4}
    assert qda.predict(stats.limit(0), model).count() == 0


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in pii.EMAIL.finditer(t)] + [(m.start(), 1, m.end()) for m in pii.IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in pii.CARD.finditer(t):
        g = re.sub("[^0-9]", "", m[0])
        total = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(g[::-1]))
        if 14 <= len(g) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in pii.PHONE.finditer(t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(3)
    alphabet = list("ab.@-+ 0123456789()é_%") + ["4111 1111 1111 1111", "a@b.c", "10.0.0.255", "+1 234 567 8901", "00000012.1.1.1"]
    for _ in range(3000):
        t = "".join(rng.choice(alphabet, rng.integers(0, 30)))
        assert pii.base_spans(t) == brute_spans(t), t


def test_field_adds_repeats_and_leaves_clean_text(spark):
    rows = [(i, f"call +44 20 7946 09{i:02d} or mail user{i}@example.com on 10.1.2.{i} in 2024") for i in range(40)] + [(i, "plain words 12 and 2024 only") for i in range(50, 70)] + [(90, None), (91, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(df)
    got = {r.doc_id: r for r in pii.find(df, model, ["doc_id"]).collect()}
    assert got[5].n_email == 1 and got[5].n_phone == 1 and got[5].n_ip == 1 and got[5].spans.count(":") == 6
    assert got[60].spans == got[90].spans == got[91].spans == ""
    t = "Mail bob.smith@example.com today. Years 2024 and 1999 passed. Write to bob.smith@host again."
    base = pii.base_spans(t)
    added = pii.added_spans(t, base, model)
    assert [t[a:b] for a, _, b in added] == ["bob.smith@host"]
    assert pii.redacted(t, base + added) == "Mail <EMAIL> today. Years 2024 and 1999 passed. Write to <EMAIL> again."
    out = pii.redact(df, model)
    assert out.columns == df.columns and out.filter("doc_id = 60").first().text == rows[40 + 10][1]
    assert pii.find(df.limit(0), model, ["doc_id"]).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 50])
@pytest.mark.parametrize("last", [False, True])
def test_field_adds_every_mention_of_an_observed_entity(n, last):
    outside = pii.LABELS - 1
    chain = np.zeros((pii.LABELS, pii.LABELS))
    model = {"unary": {}, "chain": chain, "skip": 5.0 * np.eye(pii.LABELS), "accept": 0.8, "rounds": 12}
    for full, short, kind in (("bob.smith@example.com", "bob.smith@host", 0), ("+44 20 7946 0958", "7946 0958", 3), ("+44 20 7946 0958", "020-79460958", 3)):
        mentions = "".join(f"then some words and {short} again. " for _ in range(n))
        text = f"{mentions}Mail {full} now." if last else f"Mail {full} now. {mentions}"
        base = pii.base_spans(text)
        assert [k for _, k, _ in base] == [kind] and kind != outside
        added = pii.added_spans(text, base, model)
        assert [(k, text[a:b]) for a, k, b in added] == [(kind, short)] * n


def test_fit_counts_all_documents_and_decides_alike_at_every_size(spark):
    text = "Mail bob.smith@example.com today. Write to bob.smith@host again."
    for n in (0, 10, 25_000):
        docs = spark.range(n).selectExpr("concat('see any@host ', id, ' there') as text").union(spark.createDataFrame([("one +44 20 7946 0958 phone",)], "text string"))
        model = pii.fit(docs)
        assert pii.shape("+44") in model["unary"]
        assert [text[a:b] for a, _, b in pii.added_spans(text, pii.base_spans(text), model)] == ["bob.smith@host"]


def test_links_with_observed_words_count_each_pair_once():
    rng = np.random.default_rng(5)
    bits = ["bob@a.b", "bob@host", "4412345", "1234567", "123", "4567", "99-1234567", "x1234567", "bob@a1234567"]
    for _ in range(200):
        text = " ".join(rng.choice(bits, 12))
        ws = pii.words(text)
        keys, label = pii._keys(text, ws), rng.integers(-1, pii.LABELS - 1, len(ws))
        want = np.zeros((len(ws), pii.LABELS))
        for i in np.flatnonzero(label < 0):
            for j in np.flatnonzero(label >= 0):
                want[i, label[j]] += bool(set(keys[i]) & set(keys[j]))
        assert (pii._seen_links(keys, label) == want).all()


def test_find_equals_the_patterns_on_whole_texts(spark):
    rng = np.random.default_rng(11)
    bits = ["word", "a.b@example.com", "10.0.0.255", "300.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 234 567 8901", "2024", "12"]
    rows = [(i, " ".join(rng.choice(bits, rng.integers(0, 12)))) for i in range(200)] + [(900, None), (901, ""), (902, "x " * 300_000 + "a@b.c " + "y " * 300_000), (5, "a@b.c"), (None, "10.0.0.1")]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, spans string, n_ip long")
    found = sorted(pii.find(df, pii.fit(df), ["doc_id"]).collect(), key=str)
    want = []
    for i, t in rows:
        base = brute_spans(t or "")
        spelled = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        want.append((i, *(sum(k == j for _, k, _ in base) for j in range(4)), hashlib.sha256(spelled.encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in found if r.doc_id is not None) == sorted(w for w in want if w[0] is not None)
    for r in found:
        spans = [(int(a), k, int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        assert len(spans) >= r.n_email + r.n_ip + r.n_card + r.n_phone


def test_words_without_evidence_are_outside():
    strong = np.full((pii.LABELS, pii.LABELS), -3.0) + 6 * np.eye(pii.LABELS)
    strong[-1, -1] = 0
    model = {"unary": {}, "chain": strong, "skip": 5.0 * np.eye(pii.LABELS), "accept": 0.5, "rounds": 12}
    numbers = "1234567 7654321 1111222 3333444"
    assert pii.added_spans(numbers, [], model) == []
    text = f"{numbers} and then mail bob.smith@example.com or bob.smith@host now"
    assert [text[a:b] for a, _, b in pii.added_spans(text, pii.base_spans(text), model)] == ["bob.smith@host"]


def test_message_passing_on_loops_is_close_to_the_sum():
    rng = np.random.default_rng(2)
    for _ in range(20):
        n, k = 6, 3
        unary = rng.normal(size=(n, k)) * 1.5
        edges = np.array([[0, 1], [1, 2], [2, 3], [3, 4], [4, 5], [0, 3], [1, 5]])
        pot = np.stack([0.6 * rng.random() * np.eye(k) for _ in edges])
        joint = np.zeros((k,) * n)
        for i in np.ndindex(joint.shape):
            joint[i] = np.exp(sum(unary[v, y] for v, y in enumerate(i)) + sum(pot[e, i[a], i[b]] for e, (a, b) in enumerate(edges)))
        got = pii.marginals(unary, edges, pot, 60)
        for v in range(n):
            want = joint.sum(axis=tuple(x for x in range(n) if x != v))
            assert np.allclose(got[v], want / want.sum(), atol=0.03)


def test_message_passing_on_a_tree_is_exact():
    rng = np.random.default_rng(0)
    unary, pot, edges = rng.normal(size=(4, 3)), rng.normal(size=(3, 3, 3)), np.array([[0, 1], [1, 2], [1, 3]])
    joint = np.zeros((3,) * 4)
    for i in np.ndindex(joint.shape):
        joint[i] = np.exp(sum(unary[n, v] for n, v in enumerate(i)) + sum(pot[e, i[a], i[b]] for e, (a, b) in enumerate(edges)))
    got = pii.marginals(unary, edges, pot, 60)
    for n in range(4):
        want = joint.sum(axis=tuple(x for x in range(4) if x != n))
        assert np.allclose(got[n], want / want.sum(), atol=1e-6)


def test_nearest(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 24)).astype(float)
    x[50:60] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(400, None), (450, [0.0] * 24), (401, [1.0, None] * 12), (402, [float("nan")] * 24), (403, [float("inf")] * 24), (None, x[1].tolist()), (404, [1.0, 2.0]), (405, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, k=5, vector_block=100, query_block=2).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert sorted(got) == [0, 50, 100, 150, 200, 250]
    hit = 0
    for q in got:
        s = (x * x[q]).sum(axis=1) / np.sqrt(np.square(x).sum(axis=1) * np.square(x[q]).sum())
        s[q] = -9
        want = np.lexsort((np.arange(300), -np.round(s, 12)))[:5].tolist()
        hit += len({got[q][i + 1][0] for i in range(5)} & set(want))
        for v, score in got[q].values():
            assert score == pytest.approx(s[v], abs=1e-12)
    assert hit >= 0.9 * 30
    assert [got[50][i + 1][0] for i in range(5)] == [51, 52, 53, 54, 55]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def plain_nearest(rows, k):
    """Brute force over ids: the nearest of an id's vectors counts."""
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v):
            ok.setdefault(i, {})[tuple(v)] = np.array(v, float)
    out = {}
    for q in ok:
        if q % 50 == 0:
            s = {}
            for i in ok:
                pairs = [a @ b / np.sqrt((a @ a) * (b @ b)) for a in ok[q].values() for b in ok[i].values() if len(a) == len(b)]
                if i != q and pairs:
                    s[i] = max(pairs)
            out[q] = sorted(s, key=lambda i: (-round(s[i], 12), i))[:k]
    return out


@pytest.mark.parametrize("kind", ["float", "double"])
def test_nearest_counts_repeated_ids_once(spark, kind):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(160, 16)).astype(np.float32).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [rows[0]] * 3 + [rows[4]] * 40 + [(0, x[9].tolist()), (33, x[0].tolist()), (50, x[4].tolist()), (7, x[100].tolist())]
    df = spark.createDataFrame([(i, v, "c", 1.0) for i, v in rows], f"vec_id long, embedding array<{kind}>, code string, f double")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, k=5, vector_block=60, query_block=2).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = plain_nearest(rows, 5)
    assert all(len(set(v)) == 5 for v in got.values()) and sorted(got) == sorted(want)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)
    assert got[0][0] == want[0][0] and got[50][0] == want[50][0]
