"""WARC bundles, HTML, mixing and the pipeline: op3, op6, op8."""

import hashlib
import io
import random
import time
from xml.etree import ElementTree

import pytest
import zstandard

import corpus_pipeline
from foldline.llm import warc
from foldline.llm.html_extract import _blocks, extract, main_text, parse
from foldline.llm.mixing import leaf_budgets, mix

PAGES = "page_id long, url string, html string, sha string, n long, holder string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "s", 1, "h") for i, u, h in rows], PAGES)


def test_archive_round_trip(spark):
    big = "<p>" + "ü" * 5000
    rows = [(1, "http://a", big), (2, None, None), (3, "http://b", big), (4, "http://c\n", ""), (5, "x", "<p>one"), (None, "n", "no id"), (9, "http://d", big), (None, "m", "no id"), (None, None, big), (5, "again", "<p>one"), (5, "other", "<p>two"), (6, "z", "w" * 1_000_000)]
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive(pages(spark, rows), frame_bytes=3000, bundle_bytes=4000).collect()]
    largest = {}
    for i, _, h in rows:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        data, top = (h or "").encode(), largest[h or ""]
        again = top >= 0 and i != top
        want.append((i, len(data), warc.digest(data), "revisit" if again else "response", top if again else None))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.archive(pages(spark, [])).collect() == []
    few = {r.page_id: r.record_type for r in warc.archive(pages(spark, rows[:4]), dedup_from=5).collect()}
    assert few == {1: "revisit", 2: "response", 3: "response", 4: "response"}


def test_bundle_is_plain_zstandard_and_seekable():
    out = io.BytesIO()
    w = warc.BundleWriter(out, 120)
    records = [bytes([65 + i]) * (40 + 30 * i) for i in range(5)]
    at = [w.add(r) for r in records]
    w.close()
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read() == b"".join(records)
    r = warc.BundleReader(out)
    assert len(r.frames) == 4 and [r.frame(f)[o : o + len(x)] for (f, o), x in zip(at, records, strict=True)] == records
    empty = io.BytesIO()
    warc.BundleWriter(empty, 10).close()
    assert warc.BundleReader(empty).frames == []


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("just words", "just words"), ("<p>a &amp; b<p>c", "a & b c"),
        ("<nav><ul><li><a href=x>Home</a></ul></nav><article><h1>T</h1><p>first, <b>bo</b>ld\n text<br>more<p>second</article><footer>f</footer>", "T first, bold text more second"),
        ("<div class='ad'>Buy, now, please, do it</div><div id=main><p>The text, which is long enough, to be scored as the main one.</p><p>More of it</p></div><div class=comments><p>nice, very, nice, indeed</p></div>", "The text, which is long enough, to be scored as the main one. More of it"),
        ("<script>var t='<p>no</p>';</script><p>yes</p><style>p{}</style><!-- <p>no --><form><p>no</form>", "yes"),
        ("<div><p>x, y, z and a lot of other words in this paragraph</p><ul><li><a href=1>one link</a><li><a href=2>two links</a></ul></div>", "x, y, z and a lot of other words in this paragraph"),
        ("<p>unclosed <b>bold<p>next", "unclosed bold next"), ("<p>1 < 2</p>", "1 < 2"),
    ],
)
def test_main_text(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("name", ["page has-sidebar", "content with-sidebar", "no-sidebar", "post tag-python", "hentry category-news tag-eu", "legal-text", "search", "notice"])
def test_a_content_wrapper_is_not_cut_by_its_class(name):
    words = "One sentence, and then another one, long enough to count as text of the page itself."
    body = "".join(f"<p>{i} {words}</p>" for i in range(3))
    page = f'<body><p class="cookie-banner">We use cookies, many of them.</p><div class="{name}"><h1>Title</h1>{body}<div class="ad-1"><p>Buy now, buy, buy.</p></div></div><div id="comments"><p>{words * 30}</p></div></body>'
    assert main_text(page) == " ".join(["Title", *(f"{i} {words}" for i in range(3))])


WORDS = "river stone, light of the morning, and old bridge over quiet water where, people walk in winter".split()


def random_page(rng, depth=0):
    """Well-formed blocks of text and links; no block inside a paragraph."""
    def text(n):
        return " ".join(rng.choice(WORDS) for _ in range(n))

    out = []
    for _ in range(rng.randint(1, 5)):
        kind = rng.random()
        if kind < 0.45:
            out.append(f"<p>{text(rng.randint(1, 40))} <b>{text(2)}</b></p>")
        elif kind < 0.6:
            out.append("<ul>" + "".join(f'<li><a href="{i}">{text(2)}</a></li>' for i in range(rng.randint(1, 4))) + "</ul>")
        elif kind < 0.7:
            out.append(f"<blockquote>{text(rng.randint(2, 30))}</blockquote>")
        elif depth < 3:
            out.append(f"<div>{random_page(rng, depth + 1)}</div>")
    return "".join(out)


def plain_main_text(page):
    """The scoring by its definition, on another parser's tree."""
    root = ElementTree.fromstring(page)
    up = {k: n for n in root.iter() for k in n}
    pieces = lambda n: [n.text or "", *(x for k in n for x in (*([] if k.tag in BLOCKS else pieces(k)), k.tail or ""))]
    own = lambda n: sum(len(x.strip()) for x in pieces(n))
    chars = lambda n: len((n.text or "").strip()) + sum(chars(k) + len((k.tail or "").strip()) for k in n)
    linked = lambda n: chars(n) if n.tag == "a" else sum(map(linked, n))
    density = lambda n: linked(n) / chars(n) if chars(n) else 0
    points = {}
    for n in root.iter():
        if n.tag in ("p", "li", "blockquote", "div") and n in up:
            size, commas = own(n), sum(x.count(",") for x in pieces(n))
            if not size or n.tag == "div" and size < 25:
                continue
            worth = (1 + commas + min(size // 100, 3)) * (1 - density(n))
            holder = n if n.tag == "div" else up[n]
            for k, share in ((holder, 1), (up.get(holder), 0.5)):
                if k is not None:
                    points[k] = points.get(k, 0) + worth * share
    final = {n: x * (1 - density(n)) for n, x in points.items()}
    best = max((n for n in root.iter() if n in points), key=lambda n: final[n])
    bar, keep = max(10, final[best] / 5), [best]
    if best in up:
        keep = [k for k in up[best] if k is best or final.get(k, 0) >= bar or k.tag == "p" and chars(k) > 80 and density(k) < 0.25]

    def blocks(n):
        out, held = [], [n.text or ""]
        for k in n:
            if k.tag in ("ul", "div") and linked(k) and density(k) > 0.5:
                held.append(k.tail or "")
            elif k.tag in BLOCKS:
                out += ["".join(held), *blocks(k)]
                held = [k.tail or ""]
            else:
                held += ["".join(k.itertext()), k.tail or ""]
        return [*out, "".join(held)]

    return " ".join(t for k in keep for x in blocks(k) if (t := " ".join(x.split())))


BLOCKS = ("p", "li", "ul", "blockquote", "div")


def test_main_text_equals_a_plain_scoring():
    rng = random.Random(3)
    seen = 0
    for _ in range(400):
        page = f"<div>{random_page(rng)}</div>"
        if "<p>" in page:
            assert main_text(page) == plain_main_text(f"<body>{page}</body>"), page
            seen += 1
    assert seen > 200


def test_light_boxes_count_little_but_are_scored():
    long = "A sentence of the article, with a comma, that goes on for a while so that it counts."
    assert main_text(f'<div><div class="sidebar"><p>{long}</p><p>{long}</p></div><div id="x"><p>{long} one</p><p>{long} two</p><p>{long} three</p></div></div>') == f"{long} one {long} two {long} three"
    assert main_text(f'<body><div class="sidebar"><p>{long}</p></div></body>') == long


@pytest.mark.parametrize("page", ["<a " * 350_000, '<a x="' * 170_000, "<b>" * 60_000 + "</i>" * 60_000, "<b>" * 60_000 + "<li>" * 60_000, "<b>" * 60_000 + "<hr>" * 60_000, "<script/>" * 100_000, "<a x=1 " + "a" * 1_000_000 + ">", "<i><div>" + "<b>" * 60_000 + "</i>" * 60_000, "<b>" * 40_000 + "<header></header>" * 40_000, "<!--" * 200_000, "&" * 500_000])
def test_broken_pages_take_linear_time(page):
    began = time.process_time()
    main_text(page)
    assert time.process_time() - began < 15


def test_a_very_long_page_is_kept_whole():
    part = "<p>One more paragraph of the page, with a comma and a number {}.</p>"
    page = "<body><div>" + "".join(part.format(i) for i in range(80_000)) + "</div></body>"
    assert len(page) > 5_000_000
    text = main_text(page)
    assert text.startswith("One more paragraph") and text.endswith("number 79999.") and text.count("number") == 80_000


@pytest.mark.parametrize(("page", "want"), [("<p>a <b x='>'>b</b> c", "a b c"), ('<p title="1 > 0">x</p>', "x"), ("<p>it <i title=it's>is</i> so</p>", "it is so"), ("<p>one</p><a href='x>two</a>", "one two"), ("<p>tail <a", "tail <a"), ("<p>x</p><!-- never ends <p>y</p>", "x"), ("<ul><li>a<li>b</ul>", "a b"), ("<p>a<p>b</p>", "a b")])
def test_odd_tags(page, want):
    assert main_text(page) == want


def test_omitted_end_tags():
    cells = parse("<table><tr><td>a<td><i>b<tr><th>c</table><dl><dt>d<dd>e<dt>f</dl>")
    table, dl = cells.kids
    assert [[c.name for c in r.kids] for r in table.kids] == [["td", "td"], ["th"]] and [k.name for k in dl.kids] == ["dt", "dd", "dt"]
    assert _blocks(cells) == ["a", "b", "c", "d", "e", "f"]


def test_posts_in_named_parts_are_tried_again():
    words = "One sentence, and then another one, long enough to count as text of the page itself."
    parts = "".join(f'<div class="widget"><p>{i} {words}</p><p>{words}</p></div>' for i in range(3))
    assert main_text(f"<body><div>{parts}</div><p>Bye.</p></body>").count(words) == 6
    assert main_text(f'<body><div class="comments"><p>{words}</p></div></body>') == words


def test_extract_keeps_every_page(spark):
    got = {r.page_id: (r.text, r.n_chars) for r in extract(pages(spark, [(1, "u", "<p>é\U0001f600</p>"), (2, "u", None), (None, None, "<p>x")]), ["page_id", "url"]).collect()}
    assert got == {1: ("é\U0001f600", 2), 2: ("", 0), None: ("x", 1)}


def plain_shares(tree, budget):
    """tree: {name: (weight, capacity or subtree)}; shares by repeated capping."""
    cap = lambda t: t if isinstance(t, int) else sum(cap(x) for _, x in t.values())
    caps = {n: cap(t) for n, (_, t) in tree.items()}
    w = {n: x for n, (x, _) in tree.items() if x > 0 and caps[n]}
    budget, out, open_ = min(budget, sum(caps[n] for n in w)), {}, set(w)
    while True:
        rest, total = budget - sum(out.values()), sum(w[n] for n in open_)
        full = {n for n in open_ if caps[n] * total <= rest * w[n]}
        if not full:
            break
        out |= {n: caps[n] for n in full}
        open_ -= full
    base = {n: rest * w[n] // total for n in open_} if open_ else {}
    order = sorted(open_, key=lambda n: (-(rest * w[n] % total), n))
    for n in order[: rest - sum(base.values()) if open_ else 0]:
        base[n] += 1
    return out | base


def test_budgets_go_to_siblings_before_ancestors(spark):
    leaves = [("d0", "en", 100), ("d0", "fr", 1000), ("d1", "en", 5000), ("d1", "de", 7), ("d2", "en", 40)]
    df = spark.createDataFrame(leaves, "domain string, lang string, tokens long")
    for budget in (0, 1, 137, 1000, 3001, 6147, 99999):
        got = {(r.domain, r.lang): r.budget for r in leaf_budgets(df, ["domain", "lang"], {"domain": "case domain when 'd0' then 3 else 1 end", "lang": "case lang when 'en' then 2 else 1 end"}, budget, 1).collect()}
        tree = {}
        for d, g, n in leaves:
            tree.setdefault(d, (3 if d == "d0" else 1, {}))[1][g] = (2 if g == "en" else 1, n)
        top = plain_shares(tree, budget)
        want = {(d, g): x for d, b in top.items() for g, x in plain_shares(tree[d][1], b).items()}
        assert got == want and sum(got.values()) == min(budget, 6147)


def test_mix_takes_prefixes_of_seeded_epochs(spark):
    rows = [(i, "w " * (i % 7), "en" if i % 3 else None, f"src{i % 4}", "p") for i in range(200)] + [(500, None, "en", "src0", "p"), (501, "", "en", None, "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, place string")
    got = mix(df, {"lang": "lang", "source": "source"}, {}, 500, 3, keep=("text", "place")).collect()
    assert sum(r.n_taken for r in got) == 500 and all(r.n_taken <= r.n_tokens for r in got)
    for leaf in {(r.lang, r.source) for r in got}:
        docs = {i: t.count("w") for i, t, g, s, _ in rows if t and (g or "(none)", s) == leaf and t.count("w")}
        mine = [r for r in got if (r.lang, r.source) == leaf]
        last = max(r.epoch for r in mine)
        for e in range(last):
            assert {r.doc_id for r in mine if r.epoch == e} == set(docs)
        order = sorted(docs, key=lambda i: hashlib.md5(f"7:{last}:{i}".encode()).hexdigest())  # noqa: S324
        left = sum(r.n_taken for r in mine if r.epoch == last)
        want = {}
        for i in order:
            if left > 0:
                want[i] = min(docs[i], left)
                left -= want[i]
        assert {r.doc_id: r.n_taken for r in mine if r.epoch == last} in (want, dict.fromkeys(docs, 0) | docs)
    assert mix(df.limit(0), {"lang": "lang"}, {}, 0.5).count() == 0


def test_near_duplicates_stage_keeps_one_row_of_each_group(spark):
    text = lambda n: " ".join(f"{n}w{j}" for j in range(30))
    rows = [(1, text("a"), "en", "s", 1), (1, text("b"), "en", "s", 1), (None, text("a") + " more", "en", "s", 1), (None, text("c"), "en", "s", 1), (None, text("c"), "de", "s", 1), (5, text("b"), "en", "s", 1), (7, text("d"), "en", "t", 1), (7, text("d"), "en", "s", 1), (8, None, "en", "s", 1), (9, "", "en", "s", 1), (3, text("e"), None, None, None), (2, text("e"), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted([tuple(r) for r in out.collect()], key=str)
    want = [(1, text("a")), (1, text("b")), (None, text("c")), (7, text("d")), (8, None), (9, ""), (2, text("e"))]
    assert sorted([r[:2] for r in got], key=str) == sorted(want, key=str)
    assert (7, text("d"), "en", "s", 1) in got and (None, text("c"), "de", "s", 1) in got
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_pipeline(spark, tmp_path):
    base = "the house and the garden of the old teacher who was reading a long letter to all of them in the evening"
    item = "what is the answer to the question that nobody asked before in this very room"
    rows = [(i, f"{base} number{i} " + " ".join(f"word{i}x{j}" for j in range(20)), "en", f"src{i % 4}", 1) for i in range(40)]
    rows += [(100, rows[0][1] + " extra", "en", "src1", 1), (101, "123 !!!", "en", "src1", 1), (102, f"{' '.join(f'q{j}' for j in range(30))} {item}", "en", "src2", 1), (103, f"{' '.join(f'z{j}' for j in range(30))} mail a.b@example.com", "en", "src2", 1), (104, None, None, None, None)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.table(stage(spark, docs, d), name)
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert name == "mixture" or docs.columns == columns
    assert set(range(40)) <= set(kept["language_id"]) and not {101, 104} & set(kept["language_id"])
    assert set(kept["language_id"]) - set(kept["near_duplicates"]) == {100}
    assert set(kept["near_duplicates"]) - set(kept["decontamination"]) == {102}
    assert kept["personal_data"][103].text.endswith("mail <EMAIL>") and kept["personal_data"][5].text == rows[5][1]
    assert kept["mixture"]
