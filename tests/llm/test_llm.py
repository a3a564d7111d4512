"""Operators for training text against brute force, on small tables with nulls, ties, repeats, long and empty texts."""

from __future__ import annotations

import hashlib
import html as entities
import random
import re
import textwrap
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fellpath.llm import bpe, contamination, html, licenses, neardup, pii, quality, substrings, toxicity, urls
from fellpath.llm.shared import Words, strings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = "an the ing ou er es da lo mi ré schö ña 中 été of to".split()
BLANK = [None, "", " ", "\n\n", "one", "a b c d", "\t x \x0b y \x0c"]


def texts(seed: int = 1, n: int = 40) -> list:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3)))
    out = [" ".join(word() + rng.choice(["", "", ",", ".", "\n"]) for _ in range(rng.randint(5, 120))) for _ in range(n)]
    shared = " ".join(word() for _ in range(60))
    for i in range(0, n, 3):
        out[i] = out[i] + " " + shared + " " + out[i][:50]
    out += [out[0], out[0], out[1].upper(), "the " * 300, ("x" * 5000 + " ") * 3, " ".join(word() for _ in range(6000))]
    return out + BLANK


def frame(spark, rows, ids=None):
    """Documents with extra columns whose names operators use inside."""
    data = [(None if ids is None and i == 7 else (ids[i] if ids else i), t, "en", None, len(t or ""), 1) for i, t in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, n int")


def empty(spark):
    return frame(spark, ["x"]).where("false")


# --- 1 ----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_bpe_equals_the_library(tokenizer):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(tokenizer), bpe.Tokenizer.read(tokenizer)
    rng = random.Random(5)
    bits = ["'s", "'re", "'ll", "'", " ", "  ", "\n", "\t", "\xa0", "　", "a", "Z", "é", "1", "²", "中", "😀", "!", "<|endoftext|>", "<|end", "'S", "\x85", "the", " of"]
    data = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [t or "" for t in texts()]
    words = bpe.Pretokens(data[:200]).texts
    coder = bpe.Coder(own, bpe.Lexicon(np.frombuffer(bpe.compile_lexicon([w.encode() for w in words], own.merge), "<i8")))
    ids, bounds = coder.encode(data)
    decoded = coder.decode(ids, bounds)
    for k, t in enumerate(data):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids[bounds[k] : bounds[k + 1]].tolist() == want, t
        assert decoded[k].decode() == library.decode(want, skip_special_tokens=False) == t


def test_transducer_is_minimal_and_exact(tokenizer):
    own = bpe.Tokenizer.read(tokenizer)
    words = [b"tap", b"taps", b"top", b"tops", b"stop", b"stops", b""]
    data = np.frombuffer(bpe.compile_lexicon(words, own.merge), "<i8")
    lexicon = bpe.Lexicon(data)
    assert lexicon.rank(sorted(words)[1:]).tolist() == [1, 2, 3, 4, 5, 6] and lexicon.rank([b"ta", b"topss", b"x"]).tolist() == [-1, -1, -1]
    # suffix classes of the words: start, t-a/t-o, p, p's end, s's end, and the states of sto
    assert int(data[1]) == 7
    assert all(lexicon.of(int(r)) == own.merge(w) for w, r in zip(words[:-1], lexicon.rank(words[:-1]), strict=True))
    long = ("ab" * 300 + "the" * 500).encode()
    assert own.merge(long) == own._merge_long([own.start[b] for b in long])
    rng = random.Random(3)
    many = [bytes(rng.choice(b"abcdefghilnorstu e") for _ in range(rng.randint(0, 30))) for _ in range(800)] + [" the".encode(), "été中".encode(), long, b"a" * 150]
    assert own.merge_all(many) == [own._merge_long([own.start[b] for b in w]) for w in many] == [own.merge(w) for w in many] and own.merge_all([]) == []


def test_bpe_in_spark(spark, tokenizer):
    docs = frame(spark, texts())
    out = bpe.decode(bpe.encode(docs, tokenizer, bpe.build_lexicon(docs, tokenizer, 50)), tokenizer)
    assert set(docs.columns) < set(out.columns)
    assert all(r.decoded == (r.text or "") for r in out.collect())
    assert bpe.encode(empty(spark), tokenizer, bpe.build_lexicon(empty(spark), tokenizer)).count() == 0


# --- 2 ----------------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    rng = random.Random(4)
    bad = ["grubword", "vilestem", "nastyfoo"]
    rows, marks = [], []
    for _ in range(400):
        words = ["".join(rng.choice(SYLLABLES) for _ in range(2)) for _ in range(rng.randint(20, 80))]
        toxic = rng.random() < 0.3
        for _ in range(rng.randint(2, 8) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "s", ",", "ed"]))
        rows.append(" ".join(words))
        marks.append(int(toxic))
    docs = frame(spark, rows + BLANK, list(range(400)) + [None] * len(BLANK))
    labels = spark.createDataFrame([(i, marks[i]) for i in range(250)] + [(None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in toxicity.score(docs, model).where("doc_id is not null").collect()}
    held = [(got[i].is_toxic, marks[i]) for i in range(250, 400)]
    assert sum(a == bool(b) for a, b in held) >= 0.97 * len(held)
    assert not any(a and not b for a, b in held)
    assert all(0 <= r.expected_severity <= toxicity.GRADES - 1 for r in got.values())
    flat = toxicity.fit(docs, labels.where("toxic = 0"))
    assert toxicity.score(docs, flat).where("is_toxic or expected_severity > 1e-9").count() == 0
    assert toxicity.score(empty(spark), model).count() == 0 and toxicity.fit(empty(spark), labels).features.size == 0


def test_ordinal_orders_grades():
    rng = np.random.default_rng(1)
    grade = rng.integers(0, 4, 300)
    row = np.repeat(np.arange(300), 1)
    weights, theta = toxicity.ordinal(row, np.zeros(300, int), grade + rng.normal(0, 0.2, 300), grade, 1)
    assert weights[0] > 0 and (np.diff(theta) > 0).all()


# --- 3 ----------------------------------------------------------------------------------------------------------------


def test_contamination_equals_brute_force(spark):
    rng = random.Random(8)
    words = lambda n: [rng.choice(SYLLABLES) + rng.choice(SYLLABLES) for _ in range(n)]
    items = [words(n) for n in (3, 4, 5, 6, 12, 30, 64, 100)]
    docs = []
    for k in range(60):
        body = words(rng.randint(0, 200))
        item = list(items[k % len(items)])
        for _ in range(k % 4):
            if len(item) > 6:
                item[rng.randrange(len(item))] = "changed"
        docs.append(" ".join(body + item + words(30)) if k % 3 else " ".join(body))
    docs += [docs[1], "İstanbul " + " ".join(items[5]).upper() + "!!", *BLANK]
    bench = [(i, " ".join(w)) for i, w in enumerate(items)] + [(50, None), (51, ""), (52, "...")]
    table = spark.createDataFrame(bench, "item_id long, text string").withColumn("words", F.lit(1))
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_shingles) for r in contamination.contaminated(frame(spark, docs, list(range(len(docs)))), table).collect()}
    plain = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    want = {}
    for i, t in enumerate(docs):
        w = plain(t)
        for item, x in bench:
            v = plain(x)
            k = min(5, len(v))
            q = {tuple(v[j : j + k]) for j in range(len(v) - k + 1)} if k else set()
            d = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
            if q and len(q & d) >= 0.8 * len(q) - 1e-9:
                want[i, item] = (len(q & d), len(q))
    assert got == want and len(want) > 20
    assert contamination.contaminated(empty(spark), table).count() == 0
    assert contamination.contaminated(frame(spark, docs), table.where("false")).count() == 0


# --- 4 ----------------------------------------------------------------------------------------------------------------


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"][2]
    half = mit.index(" ", len(mit) // 2)
    cases = {
        0: ("ouing er.\nLicensed under the Apache License, Version 2.0.\nThe an", {("Apache-2.0", "exact")}),
        1: ("This work is licensed under the GNU General Public License, version 3. " + "er an " * 60, {("GPL-3.0", "exact")}),
        2: (mit[:half] + "\n" + mit[half + 1 :], {("MIT", "exact")}),
        3: (mit.replace("sell copies", "sell many copies").replace("without restriction, ", ""), {("MIT", "modified")}),
        4: ("All rights reserved.\nReleased under the MIT License.", {("all-rights-reserved", "exact"), ("MIT", "exact")}),
        5: ("Licensed under the Apache License, Version 3.7.", {(None, "unknown")}),
        6: ("nothing of the kind", set()),
        7: (None, set()),
        8: ("", set()),
    }
    docs = frame(spark, [t for t, _ in cases.values()], list(cases)).withColumn("license", F.lit("x"))
    got = {}
    for r in licenses.scan(docs).collect():
        got.setdefault(r.doc_id, set()).add((r.license, r.verdict))
    assert got == {k: v for k, (_, v) in cases.items() if v}
    assert licenses.scan(empty(spark)).count() == 0


def test_every_license_template_however_it_is_laid_out(spark):
    around, cases = "ouing er the and of this work to any person. " * 12, []
    for name, texts_of in licenses.TEMPLATES.items():
        for text in texts_of:
            wrap = lambda n, mark: textwrap.fill(text, n, initial_indent=mark, subsequent_indent=mark, break_long_words=False, break_on_hyphens=False)  # noqa: B023, E731
            cases += [(name, text, laid) for laid in (text, wrap(72, ""), wrap(40, ""), around + text + " " + around, "Some words.\n\n" + wrap(72, "# ") + "\n\n" + around)]
    got = {}
    for r in licenses.scan(frame(spark, [laid for _, _, laid in cases], list(range(len(cases))))).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, (name, text, laid) in enumerate(cases):
        assert [(r.license, r.verdict) for r in got[i]] == [(name, "exact")], laid
        assert licenses.words(laid[got[i][0].start : got[i][0].end]) == licenses.words(text)


def test_repeated_licenses_of_one_block(spark):
    line = "Released under the MIT License."
    text = "\n".join([line, "er an", line, "All rights reserved. " + line])
    got = licenses.scan(frame(spark, [text])).orderBy("start").collect()
    assert [(r.block, r.license, r.verdict) for r in got] == [(0, n, "exact") for n in ("MIT", "MIT", "all-rights-reserved", "MIT")]
    assert [text[r.start : r.end] for r in got if r.license == "MIT"] == [line[:-1]] * 3


def test_edited_licenses_have_a_row_each(spark):
    """Planted notices with random edits: one row for each, and what was taken out or put in is what is reported."""
    rng, rows, want = random.Random(23), [], []
    named = [(n, t) for n, ts in licenses.TEMPLATES.items() for t in ts if len(licenses.words(t)) >= 40]
    for _ in range(12):
        parts, planted = [], []
        for name, text in rng.sample(named, 3):
            own, cut, put = text.split(), [], []
            for _ in range(3):
                k = rng.randrange(5, len(own) - 5)
                if rng.random() < 0.5 and not re.search(r"[0-9]|^\W*$", own[k]):
                    cut += licenses.words(own.pop(k))
                else:
                    put.append("zq" + rng.choice("abcdef"))
                    own.insert(k, put[-1])
            parts.append(textwrap.fill(" ".join(own), 70, break_long_words=False, break_on_hyphens=False))
            planted.append((name, sorted(cut), sorted(put)))
        rows.append(("\n\n" + "ouing er the and of this work. " * 20 + "\n\n").join(parts))
        want.append(planted)
    got = {}
    for r in licenses.scan(frame(spark, rows, list(range(len(rows))))).orderBy("doc_id", "start").collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, planted in enumerate(want):
        assert [r.license for r in got[i]] == [n for n, _, _ in planted], i
        for r, (_, cut, put) in zip(got[i], planted, strict=True):
            assert set(put) <= set(r.added) and set(cut) <= set(r.missing) | set(r.added) and r.verdict == "modified"
            assert len(r.added) - len(r.missing) == len(put) - len(cut)


# --- 5 ----------------------------------------------------------------------------------------------------------------


def test_urls_equal_brute_force(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("b.example.com", "/de/x", "allow"), ("b.example.com", "/de/x", "block"), ("Example.NET", "", "block"), ("", "/all", "block")]
    rng = random.Random(3)
    hosts = ["example.org", "a.example.org", "EXAMPLE.org", "xexample.org", "b.example.com", "com", "q.com", "example.net", "example.org:80", "", "a..org", "u@example.org"]
    paths = ["", "/", "/es", "/es/", "/es/x?y#z", "/en/12", "/fr/", "/de/x/y", "?a=/es/", "#/es/", "/all/x", "/x://y/de/"]
    data = [f"{rng.choice(['http', 'https', ''])}://{h}{p}" for h in hosts for p in paths] * 2 + [None, "", "no scheme/es/", "http:/one/", "a\nb://example.org/es/"]
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate(data)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    for i, u in enumerate(data):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h) + len(p), len(h), v, h + p) for h, p, v in ((h.lower(), p, v) for h, p, v in rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, 0, "allow", None))
        assert got[i] == (host, path, best[3], best[2]), u
    assert urls.judge(pages, spark.createDataFrame([], "host string, path string, verdict string")).where("verdict <> 'allow'").count() == 0
    assert urls.judge(pages.where("false"), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


# --- 6 ----------------------------------------------------------------------------------------------------------------


def page(i: int, body: str, foot: bool = True, article: str = "article") -> str:
    return f'<!DOCTYPE html><html><head><title>t{i}</title><script>var x="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li><li>Blog</li></ul></nav><div class="ad">Buy {i}!</div><{article}><h1>Title&nbsp;{i} &amp; more</h1>{body}</{article}><section class="comments"><p>First!</p></section>' + (f"<footer>&copy; {i}</footer>" if foot else "") + "</body></html>"


def test_html(spark):
    rows, want = [], []
    for i in range(40):
        body = "".join(f"<p>Para {k} of  <b>{i}</b>\n text<br>&lt;{k}&gt;</p>" for k in range(i % 5)) + ("<ul><li>one<li>two</ul>" if i % 3 == 0 else "") + ("<form>Mail <input></form>" if i % 4 == 0 else "")
        rows.append((i, f"http://h{i % 2}.example/{i}", page(i, body, i % 2 == 0)))
        want.append("\n".join([f"Title {i} & more", *[f"Para {k} of {i} text <{k}>" for k in range(i % 5)], *(["one", "two"] if i % 3 == 0 else [])]))
    odd = [(None, ""), ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a\nb"), ("<div>x<script>1", "x"), ("<" * 50, "<" * 50), ("<p>" * 2000 + "deep", "deep")]
    odd += [("<div>" * 100_000 + "deep", "deep"), ("<a" * 300_000, "<a" * 300_000), ("<div><li></li>" * 20_000 + "x", "x"), ('<a "\'>' * 50_000, ""), ("</script " * 100_000 + ">y", "y"), ("<b class=ad>" * 20_000 + "x", "")]
    for text, out in odd:
        rows.append((len(rows), None, text))
        want.append(out)
    pages = spark.createDataFrame([(*r, "old", "h", 1) for r in rows], "page_id long, url string, html string, text string, _host string, _main int")
    got = html.main_text(pages).orderBy("page_id").collect()
    assert [r.text for r in got] == want and got[0]["_host"] == "h" and got[0]["_main"] == 1
    wrappers = {r.host: r.wrapper for r in html.host_wrappers(pages).collect()}
    assert "article(h1(#) p(#)* ul(li(#)+)? form(#)?)" in wrappers["h0.example"], wrappers["h0.example"]
    assert html.main_text(pages.where("false")).count() == 0


def site(i: int, rng: random.Random) -> tuple[str, str]:
    """A page without any telling name, and its main text: menu, notice and terms are told from the article by alignment only."""
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(3))
    paras = [" ".join(word() for _ in range(12)) for _ in range(rng.randint(1, 6))]
    menu = "".join(f"<li><a href='/{word()}'>{word()}</a></li>" for _ in range(rng.randint(3, 6)))
    texts = "".join(f"<p>{p}</p>" for p in paras)
    return f"<html><body><table><tr><td><ul>{menu}</ul></td></tr></table><h1>Title {i}</h1><section><div>Accept our terms</div>{texts}<p>All of it is ours</p></section><center>Mail {word()}</center></body></html>", "\n".join([f"Title {i}", *paras])


def test_wrapper_alone_tells_boilerplate(spark):
    rng = random.Random(4)
    made = [site(i, rng) for i in range(60)]
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.example/{i}", p) for i, (p, _) in enumerate(made)], "page_id long, url string, html string")
    want = [w for _, w in made]
    wrappers = {}
    for parts in (1, 50):
        dealt = pages.repartition(parts)
        wrappers[parts] = html.host_wrappers(dealt)
        assert [r.text for r in html.main_text(dealt, wrappers[parts]).orderBy("page_id").collect()] == want
    shown = [sorted((r.host, r.main, sorted(r.gone), r.wrapper) for r in w.collect()) for w in wrappers.values()]
    assert shown[0] == shown[1] and 'section(div(") p(#)+)' in shown[0][0][3] and "ul(li(#)+)" in shown[0][0][3]
    dummy = wrappers[1].withColumns({"main": F.lit(0).cast("long"), "gone": F.array().cast("array<bigint>")})
    plain = [r.text for r in html.main_text(pages, dummy).orderBy("page_id").collect()]
    assert all("Accept our terms" in t and "All of it is ours" in t and "Mail" in t and t != w for t, w in zip(plain, want, strict=True))


def test_wrapper_inside_articles(spark):
    body = lambda i: f"<html><body><main><header><p>By me {i}</p><h1>Story {i}</h1></header><div class=follow>Follow us</div><p class=legal>The law says {i}.</p><p>Text {i}</p><footer>x</footer><div class=related><a href=x>More {i}</a></div></main></body></html>"
    pages = spark.createDataFrame([(i, f"http://{'many' if i < 20 else i}.example/", body(i)) for i in range(22)], "page_id long, url string, html string")
    got = [r.text for r in html.main_text(pages).orderBy("page_id").collect()]
    assert got[:20] == [f"Story {i}\nText {i}" for i in range(20)]  # Follow us: one text; legal: on all pages
    assert got[20] == "Story 20\nFollow us\nThe law says 20.\nText 20"


def test_template_texts_equal_brute_force(spark):
    from xml.etree import ElementTree

    rng = random.Random(14)
    made = []
    for i in range(90):
        parts = [f"<{t}>{rng.choice(['Always here', 'Often there', 'w' + str(rng.randrange(1000))])}</{t}>" for t in ("div", "p", "p", "blockquote", "div") if rng.random() < 0.95]
        parts.insert(rng.randrange(len(parts) + 1), "<h2>Fixed</h2>")
        made.append((f"h{i % 4}", "<body>" + "".join(parts) + "</body>"))
    made += [made[0]] * 30
    blocks = [[((e.tag,), e.text) for e in ElementTree.fromstring(p)] for _, p in made]
    want = []
    for i, (host, _) in enumerate(made):
        own = [blocks[j] for j, (h, _) in enumerate(made) if h == host]
        kept = []
        for b in blocks[i]:
            held = [x for x in own if b in x]
            fixed = len(held) >= html.SHARE * len(own) and len({tuple(x) for x in held}) >= html.TEMPLATE
            kept += [] if fixed else [b[1]]
        want.append("\n".join(kept))
    pages = spark.createDataFrame([(i, f"http://{h}/{i}", p) for i, (h, p) in enumerate(made)], "page_id long, url string, html string")
    assert [r.text for r in html.main_text(pages).orderBy("page_id").collect()] == want


def test_main_parts_inside_telling_words():
    assert html.extract('<div class="layout no-sidebar"><nav>x</nav><article><h1>T</h1><p>text</p></article></div>') == "T\ntext"
    assert html.extract('<main class="with-sidebar"><p>text</p></main><div class=sidebar><article>other</article></div>') == "text"
    assert html.extract("<nav><article>no</article></nav><p>text</p>") == "text"
    assert html.extract('<div class="comments"><article class="comment">me</article></div><article>text</article>') == "text"


def test_expressions_of_wrappers():
    def wrapper(*pages: str) -> str:
        held: dict = {}
        for page in pages:
            for node, p in html.read(page)[1].items():
                held[node].add(p) if node in held else held.update({node: p})
        return html.expression(held, set())

    assert wrapper("<dl><dt>a<dd>b<dt>c<dd>d</dl>") == "page(dl((dt(#) dd(#))+))"
    assert wrapper("<h1>a</h1><p>b", "<h1>a</h1><p>b<p>c", "<p>d") == "page(h1(#)? p(#)+)"
    assert wrapper("<div><h1>a</h1><p>b</div>", "<div><p>b<p>c</div>") == "page(div(h1(#)? p(#)+))"
    assert entities.unescape("&amp") == "&"


def test_copies_and_repeats_are_no_template(spark):
    same = "<body><h1>Title</h1><div>Only text.</div><p>again</p><p>again</p><p>again</p><p>again</p><p>again</p></body>"
    plain = lambda i: f"<body><h2>Our site</h2><div>Story {i}.</div><section>All of it</section></body>"
    longer = lambda i: "<body><h1>Title</h1>" + "<p>more</p>" * i + "</body>"
    rows = [("a", same, "Title\nOnly text." + "\nagain" * 5)] * 12 + [("b", same, "Title\nOnly text." + "\nagain" * 5)]
    rows += [("c", plain(i), f"Story {i}.") for i in range(html.TEMPLATE)]
    rows += [("d", plain(i % 4), f"Our site\nStory {i % 4}.\nAll of it") for i in range(40)]
    rows += [("e", longer(i), "Title" + "\nmore" * i) for i in range(1, 9)]
    pages = spark.createDataFrame([(i, f"http://{h}.example/{i}", p) for i, (h, p, _) in enumerate(rows)], "page_id long, url string, html string").repartition(3)
    assert [r.text for r in html.main_text(pages).orderBy("page_id").collect()] == [w for _, _, w in rows]


# --- 7 ----------------------------------------------------------------------------------------------------------------


def test_quality_equals_brute_force(spark):
    rows = [*texts(2), "a b c a b c a b c", "- x\n- y\n- x", "the end...\n the end…\n", "##### && | < >", "a a a", "a a a a"]
    got = {r.doc_id: r for r in quality.quality(frame(spark, rows, list(range(len(rows)))).withColumn("kept", F.lit("old"))).collect()}
    for i, t in enumerate(rows):
        t = t or ""
        w = WORD.findall(t)
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(tri)
        covered = {k + j for k, x in enumerate(tri) if n[x] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want, t[:80]
        assert got[i].base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (got[i].kept and got[i].base_failed)
    assert quality.quality(empty(spark)).count() == 0


# --- 8 ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("ids", ["plain", "null", "huge"])
def test_substrings_equal_brute_force(spark, ids):
    rows = [*texts(3), "p q " * 40, "a b c d e f g " * 9]
    keys = list(range(len(rows)))
    random.Random(6).shuffle(keys)
    if ids == "null":
        keys[4] = None
    if ids == "huge":
        keys = [k * 2**50 - 2**55 for k in keys]
    size = 6
    got = {r.doc_id: r for r in substrings.dedup_substrings(frame(spark, rows, keys), size).collect()}
    order = sorted(range(len(rows)), key=lambda i: -(2**63) if keys[i] is None else keys[i])
    seen, gone = set(), {}
    for i in order:
        w = WORD.findall(rows[i] or "")
        gone[i] = set()
        for k in range(len(w) - size + 1):
            g = tuple(w[k : k + size])
            if g in seen:
                gone[i].update(range(k, k + size))
            seen.add(g)
    for i, t in enumerate(rows):
        w = WORD.findall(t or "")
        r = got[keys[i]]
        assert r.n_words == len(w) and r.kept_text == " ".join(x for k, x in enumerate(w) if k not in gone[i])
        assert {k for x in r.removed for k in range(x.start, x.end)} == gone[i]
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:], strict=False))
    assert substrings.dedup_substrings(empty(spark)).count() == 0


def test_word_hashes_depend_on_bytes_only():
    data = ["ab ab\tcd", "", None, "cd  " + "y" * 70 + " ab " + "y" * 70]
    words = Words(*strings(pa.array(data)))
    h = words.hashes()
    assert [bytes(words.buf[a:b]) for a, b in zip(words.start, words.end, strict=True)] == [b"ab", b"ab", b"cd", b"cd", b"y" * 70, b"ab", b"y" * 70]
    assert h[0] == h[1] == h[5] and h[2] == h[3] and h[4] == h[6] and len(set(h.tolist())) == 3


# --- 9 ----------------------------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s: str) -> bool:
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def fits(kind: str, m: str) -> bool:
    n = sum(c.isdigit() for c in m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 16 <= n <= 19 and luhn(m), "phone": 8 <= n <= 15}[kind]


def test_pii_base_equals_brute_force_and_method_adds(spark):
    rng = random.Random(9)
    card = "4539578763621486"
    bits = ["a.b@x.example.com", "@", "x@y", "1.2.3.4", "256.1.1.1", "001.02.3.4", "1.2.3.4.5.6.7.8", card, "4539 5787 6362 1486", "4539-5787-6362-1487", "+1 (017) 555-7713", "+12", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "word", "é", "中", "99999999999999999999999999.1.1.1", "me [at] mail (dot) example.com"]
    rows = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    rows += [f"see {card} {card} now", f"call +1 (499) 555-6503 {card}", "1 " * 20000, "9" * 30000, "a" * 30000 + "@b.c", *BLANK]
    docs = frame(spark, rows, list(range(len(rows)))).withColumn("base_ip", F.lit("clash"))
    out = pii.spans(docs, pii.fit(docs)).select("doc_id", "text", pii.listing("base").alias("b"), pii.listing("span").alias("s"), pii.masked(F.col("text")).alias("m")).collect()
    for r in out:
        t = r.text or ""
        want = [f"{k}:{m.start()}:{m.end()}" for k in BASE for m in re.finditer(BASE[k], t) if fits(k, m.group())]
        assert r.b == ",".join(want), t[:100]
        assert set(want) <= set(filter(None, r.s.split(",")))
    by = {r.doc_id: r for r in out}
    assert by[300].s == "card:4:20,card:21:37" and by[300].m == "see <CARD> <CARD> now"
    assert "phone:5:22" in by[301].s
    none = empty(spark)
    assert pii.spans(none, pii.fit(none)).count() == 0


def with_luhn(rng, start: str, size: int) -> str:
    body = start + "".join(rng.choice("0123456789") for _ in range(size - len(start) - 1))
    return next(body + d for d in "0123456789" if luhn(body + d))


def test_pii_finds_planted_spans_beyond_the_base(spark):
    """Added spans of all four kinds against planted ones: precision and recall on look-alikes that are none."""
    rng = random.Random(19)
    word = lambda: "".join(rng.choice("la mi do re te so".split()) for _ in range(3))
    ip6 = lambda: ":".join(f"{rng.randrange(16**4):x}" for _ in range(8))
    made = {  # personal data that the base patterns miss
        "email": lambda: f"{word()}.{word()} [at] {word()} [dot] com",
        "ip": lambda: "".join(ip6()),
        "card": lambda: (lambda c: f"{c[:4]} {c[4:10]} {c[10:]}")(with_luhn(rng, "37", 15)),
        "phone": lambda: f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}",
    }
    before = {"email": ["mail", "write to", "contact", ""], "ip": ["from host", "login from", "address", ""], "card": ["card", "payment by", "visa", ""], "phone": ["call", "phone", "tel", ""]}
    base = {"email": lambda: f"{word()}@{word()}.org", "ip": lambda: ".".join(str(rng.randint(1, 254)) for _ in range(4)), "card": lambda: with_luhn(rng, "4", 16), "phone": lambda: f"+1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"}
    fake = {"email": lambda: f"{word()} (at) {word()}.1x", "ip": lambda: "version=" + "1.2.3.300", "card": lambda: "isbn 3712 123456 12345", "phone": lambda: "order #" + f"{rng.randint(0, 99):03d}-{rng.randint(100, 999)}-{rng.randint(1000, 9999)}"}
    rows, want = [], set()
    for i in range(400):
        text, k = word() + " ", rng.choice(pii.KINDS)
        for what in rng.sample(["made", "base", "fake", "none"], 2):
            if what == "made":
                lead = rng.choice(before[k])
                text += (lead + " ") * bool(lead)
                span = made[k]()
                want.add((i, f"{k}:{len(text)}:{len(text) + len(span)}"))
                text += span + f" {word()}. "
            elif what != "none":
                text += (rng.choice(before[k]) + " " + base[k]() if what == "base" else fake[k]()) + f" {word()}. "
        rows.append(text)
    docs = frame(spark, rows, list(range(len(rows))))
    out = pii.spans(docs, pii.fit(docs)).select("doc_id", pii.listing("base").alias("b"), pii.listing("span").alias("s")).collect()
    got = {(r.doc_id, x) for r in out for x in set(r.s.split(",")) - set(r.b.split(","))} - {(r.doc_id, "") for r in out}
    for k in pii.KINDS:
        mine, theirs = {x for x in got if x[1].startswith(k)}, {x for x in want if x[1].startswith(k)}
        assert len(mine & theirs) >= 0.9 * len(theirs) > 20, (k, "recall", len(mine & theirs), len(theirs), sorted(theirs - mine)[:5])
        assert len(mine & theirs) >= 0.9 * len(mine), (k, "precision", sorted(mine - theirs)[:5])


def test_pii_takes_time_in_proportion(spark):
    """Long runs and many matches: minutes and more where a run is tried from each character or a list copied for each match."""
    n = 300_000
    rows = ["a" * n, "1" * n, "x@b.c " * (n // 6), "a [at] b [dot] c " * (n // 17), "1." * (n // 2), "a@" * (n // 2), "+1" + " " * n]
    docs = frame(spark, rows, list(range(len(rows))))
    out = {r.doc_id: r for r in pii.spans(docs, pii.fit(docs)).select("doc_id", F.size("base_email").alias("e"), F.size("span_ip").alias("i"), F.md5(pii.masked(F.col("text"))).alias("m")).collect()}
    assert out[2].e == n // 6 and out[4].i == n // 8 and out[0].e == 0
    assert out[2].m == hashlib.md5(("<EMAIL> " * (n // 6)).encode()).hexdigest()


def test_pii_vote_table_equals_brute_force(spark):
    rows = ["mail x@y.com now", "mail x@y.com now", "call +1 (234) 567-8901", "id=4539578763621486 and 4539578763621487", "", None, "1.2.3.4 1.2.3.999"]
    docs = frame(spark, rows)
    names = pii._names(docs)
    got = pii.candidates(pii.base_spans(docs, names=names), names)
    seen = Counter((k, s["found"], s["check"], s["context"], s["against"]) for r in got.collect() for k in pii.KINDS for s in r[names.loose[k]])
    assert seen == {("email", "x@y.com", 1, 1, 0): 2, ("phone", "+1 (234) 567-8901", 1, 1, 0): 1, ("card", "4539578763621486", 1, 0, -1): 1, ("card", "4539578763621487", -1, 0, 0): 1, ("ip", "1.2.3.4", 1, 0, 0): 1, ("ip", "1.2.3.999", -1, 0, 0): 1}, seen


def test_expectation_maximisation_finds_the_reliable_labelers():
    rng = random.Random(2)
    count = Counter()
    for _ in range(4000):
        truth = rng.random() < 0.4
        votes = tuple((1 if truth else -1) if rng.random() < p else (-1 if truth else 1) for p in (0.95, 0.9, 0.55))
        count[votes] += 1
    prior, q = pii.expectation_maximisation(sorted((v, float(n)) for v, n in count.items()))
    by = dict(zip(sorted(count), q, strict=True))
    assert abs(prior - 0.4) < 0.06 and by[1, 1, -1] > 0.9 and by[-1, -1, 1] < 0.1


# --- 10 ---------------------------------------------------------------------------------------------------------------


def bag(t):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a and b else 0.0


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(7)
    pairs = []
    for _ in range(30):
        a = Counter({f"s{k}": rng.randint(1, 9) for k in range(rng.randint(1, 40))})
        b = Counter({k: rng.randint(1, 9) if rng.random() < 0.5 else v for k, v in a.items() if rng.random() < 0.9}) or Counter(a)
        pairs.append((a, b))
    rows = [(i, int.from_bytes(hashlib.blake2b(k.encode(), digest_size=8).digest(), "little"), v) for i, x in enumerate([y for p in pairs for y in p]) for k, v in x.items()]
    doc, value, weight = (np.array(c) for c in zip(*rows, strict=True))
    sig = neardup.bag_min_hash(doc, value.astype(np.uint64), weight.astype(np.int64), 60, 2048)
    gaps = [(sig[2 * i] == sig[2 * i + 1]).mean() - similarity(a, b) for i, (a, b) in enumerate(pairs)]
    assert max(map(abs, gaps)) < 0.06 and abs(np.mean(gaps)) < 0.01


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(12)
    word = lambda: rng.choice(SYLLABLES) + rng.choice(SYLLABLES) + rng.choice(SYLLABLES)
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(30, 150))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rows += [rows[0], rows[0].upper(), "that it.", "that it.", "the " * 100, "the " * 110, "the " * 160, *BLANK]
    rng.shuffle(rows)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(frame(spark, rows, list(range(len(rows))))).collect()}
    up = list(range(len(rows)))
    bags = [bag(t) for t in rows]

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similarity(bags[i], bags[j]) >= 0.8 - 1e-9:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    assert got == {i: top(i) for i in range(len(rows))}
    repeats = neardup.near_duplicates(frame(spark, ["a b c d e f", "a b c d e f", None], [None, 5, 5]))
    assert sorted((r.doc_id or 0, r.class_id or 0) for r in repeats.collect()) == [(0, 0), (5, 0), (5, 5)]  # the row without a text is judged by itself
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_join_classes_within_buckets(spark):
    """Families of copies with more and more edits: many links that no bucket's smallest unit has."""
    rng = random.Random(31)
    word = lambda: rng.choice(SYLLABLES) + rng.choice(SYLLABLES) + rng.choice(SYLLABLES) + rng.choice(SYLLABLES)
    rows = []
    for _ in range(3):
        base = [word() for _ in range(90)]
        for _ in range(60):
            copy = list(base)
            for _ in range(rng.randint(1, 6)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    bags = [bag(t) for t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if similarity(bags[i], bags[j]) >= 0.8 - 1e-9]
    for i, j in pairs:
        a, b = sorted((top(i), top(j)))
        up[b] = a
    docs = frame(spark, rows, list(range(len(rows))))
    for bands, width in ((neardup.BANDS, neardup.ROWS), (6, 2)):
        assert {r.doc_id: r.class_id for r in neardup.near_duplicates(docs, bands=bands, rows=width).collect()} == {i: top(i) for i in range(len(rows))}
    # every link that crosses classes comes out of the prefix join, whatever is linked before
    texts = docs.select(F.col("doc_id").alias("key"), "text")
    alone = docs.select(F.lit(0).alias("band"), F.lit(0).alias("value"), F.col("doc_id").alias("unit"))
    none = spark.createDataFrame([], "a long, b long, similarity double")
    got = {r.key: r["class"] for r in neardup.components(neardup.crossing(alone, none, texts, 0.8)).collect()}
    assert got == {i: top(i) for i in range(len(rows)) if any(i in p for p in pairs)} and len(set(got.values())) >= 3


def test_rows_that_share_an_id_keep_their_own_links(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(SYLLABLES) + rng.choice(SYLLABLES) + rng.choice(SYLLABLES)
    a, b = ([word() for _ in range(80)] for _ in range(2))
    near = lambda t: " ".join(["other", *t[1:]])
    rows = [(9, " ".join(a)), (9, " ".join(b)), (2, near(a)), (3, near(b)), (None, None), (None, ""), (4, " ".join(b)), (4, " ".join(b))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.class_id or 0) for r in neardup.near_duplicates(docs).collect())
    assert got == [(0, 0), (0, 0), (2, 2), (3, 3), (4, 3), (4, 3), (9, 2), (9, 3)]
