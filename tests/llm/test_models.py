import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from sparkmatch.llm import html_pages, html_text, langid, quality, queries, toxicity  # noqa: E402

BIG = "/root/testdata/sf0.1"


def parts(key, n):
    return zlib.crc32(str(key).encode()) % n


def test_quality_on_held_out_rows(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    rows = [r for r in queries.op10_quality(spark, BIG).collect()]
    assert all(r.held_out == (parts(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97


def test_toxicity_on_held_out_rows(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    rows = queries.op7_toxicity(spark, BIG).collect()
    assert all(r.held_out == (parts(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_language_on_held_out_rows(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in queries.op5_language(spark, BIG).collect() if r.held_out]
    assert all(parts(r.doc_id, 3) == 1 for r in held)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_language_edge_cases():
    model = langid.fit([("the cat and the dog sat there", "en"), ("der hund und die katze", "de"), (None or "", "xx")])
    langs, score, rejected = model.predict([None, "", "12 ...!", "the dog", "die katze", "𝔘 漢"])
    assert langs[:5] == ["und", "und", "und", "en", "de"] and rejected[:3].all() and ((0 <= score) & (score <= 1)).all()
    assert langid.fit([]).predict(["a"])[0] == ["und"]


def test_toxicity_tolerates_gaps_and_handles_edges():
    clean = ["the green tree stood here and there", "some other words were written then", "nothing of note in this line"] * 20
    toxic = [c.replace("green", "green idiot").replace("other", "other moron").replace("note", "idiot note") for c in clean]
    machine = toxicity.fit(clean + toxic, [0] * 60 + [1] * 60, {0: 60, 1: 60})
    scorer = toxicity.Scorer(machine)
    p = machine.probability(scorer(["an id-iot", "an i.d.i.o.t here", "i d i o t", "an idioot", "a tree", "", "x" * 50_000]))
    assert (p[:4] > 0.5).all() and (p[4:] < 0.5).all()
    assert toxicity.fit([], [], {}).probability(np.zeros(1))[0] == 0.5
    assert toxicity.fit(["a"], [1], {1: 1}).probability(np.zeros(1))[0] > 0.5


def test_kernel_equals_its_definition():
    def plain(a, b):
        def feats(w):
            out = {}
            for i in range(len(w)):
                for j in range(i + 1, len(w)):
                    for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                        key = w[i] + w[j] + w[k]
                        out[key] = out.get(key, 0) + toxicity.LAMBDA ** (k - i + 1)
            return out

        x, y = feats(a), feats(b)
        norm = lambda f: sum(v * v for v in f.values()) ** 0.5
        return sum(v * y.get(k, 0) for k, v in x.items()) / norm(x) / norm(y)

    words, marks = ["idiot", "banana", "aaaa", "abcabc"], ["idiom", "ananas", "aaa", "abc"]
    got = toxicity.kernel(words, marks)
    assert np.allclose(got, [[plain(a, b) for b in marks] for a in words], atol=1e-5)


def test_quality_edges():
    assert all(np.isfinite(quality.features(t)).all() for t in ("", " ", "\n", "é" * 10_000, "a b " * 50_000))
    x = np.array([[0.0], [1.0], [2.0], [3.0]] * 30)
    model = quality.fit(x, (x[:, 0] > 1).astype(float), np.ones(120), pairs=0)
    assert (model.score(x) > 0.5).tolist() == (x[:, 0] > 1).tolist()
    xor = np.array([[a, b] for a in (0.0, 1.0) for b in (0.0, 1.0)] * 40)
    y = (xor[:, 0] != xor[:, 1]).astype(float)
    assert ((quality.fit(xor, y, np.ones(160), least=0.5, pair_least=0.5).score(xor) > 0.5) == (y > 0)).mean() > 0.9


def test_html_fields_on_unseen_pages_and_edges():
    field = html_text.trained()
    wrong = total = 0
    for page in html_pages.labelled_pages(60, seed=99):
        found = html_text.blocks(page, field.paths)
        want = [html_pages.MAIN in b.text for b in found]
        for b in found:
            b.text = b.text.replace(html_pages.MAIN, "").replace(html_pages.OTHER, "").strip() or "."
        got = field.decode(found)
        wrong, total = wrong + sum(a != b for a, b in zip(got, want, strict=True)), total + len(want)
    assert wrong < 0.02 * total
    for page in (None, "", "   ", "<", "<p", "<!--", "<script>x", "a" * 100_000, "<div>" * 5_000 + "x", '<a href="x>y', "</p></div>"):
        assert isinstance(field.extract(page), str)
    page = "<body><nav><a>Menu</a></nav><article><h1>A &amp; B</h1><p>One  two\nthree&nbsp;four goes here.<p>And another line of text, which ends.</article><footer>(c)</footer>"
    assert field.extract(page) == "A & B\nOne two three four goes here.\nAnd another line of text, which ends."


def test_viterbi_finds_the_best_labels():
    from itertools import product

    field = html_text.Field({"tag p": 0.7, "words 0": -1.1}, 0.2, np.array([[[0.5, -0.4], [-0.9, 0.3]], [[1.0, -1.2], [-0.7, 0.8]]]))
    page = "<p>a</p><div>some words here</div><p>b</p><p>c d e f</p><div>x</div>"
    found = html_text.blocks(page, field.paths)

    def score(labels):
        out = 0.0
        for i, (b, y) in enumerate(zip(found, labels, strict=True)):
            names = (*field.paths.features[b.path], *html_text.shape(found, i))
            out += y * (field.bias + sum(field.weights.get(f, 0) for f in names))
            if i:
                out += field.pairs[int(found[i - 1].path == b.path)][labels[i - 1]][y]
        return out

    assert [int(x) for x in field.decode(found)] == list(max(product((0, 1), repeat=len(found)), key=score))


def test_pages_query_counts_code_points(spark, sf):
    rows = queries.op4_html_text(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count() and all(r.n_chars == len(r.text) > 0 for r in rows)


def test_language_training_is_bounded_and_takes_repeated_rows_once(spark):
    rows = [(1 + i % 2, f"the text number {i} was here", "en") for i in range(400)] + [(10 + i, f"der satz {i} und das wort", "de") for i in range(50)]
    rows += [(None, "ohne kennung", "de"), (70, None, "de"), (71, "no language", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    pairs = df.where("doc_id is not null and lang is not null").selectExpr("doc_id", "lang as y")
    ids, totals = langid.C.smallest_hashes(pairs, 20)
    assert sorted(y for _, y in ids) == ["de"] * 20 + ["en"] * 2 and len(set(ids)) == 22 and totals == {"en": 400, "de": 51}
    model = langid.train(df, parts=97, part=96, per_language=20)
    assert model.predict(["the text", "das wort"])[0] == ["en", "de"]
    asked = spark.createDataFrame([(1, "the text", 7), (1, "the text", 7), (2, None, 8), (None, "12", 9)], "doc_id long, text string, SCORE int")
    got = sorted((r.lang_pred, r.rejected) for r in langid.identify(asked, model).collect())
    assert [x for x, _ in got] == ["en", "en", "und", "und"] and langid.identify(asked.limit(0), model).count() == 0
    assert langid.train(df.limit(0)).predict(["a"])[0] == ["und"]


def test_classifiers_on_nulls_repeated_rows_clashing_names_and_empty_tables(spark):
    rows = [(i, ("you idiot " if i % 3 == 0 else "some plain words ") * (1 + i % 5), int(i % 3 == 0)) for i in range(90)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, y) for i, _, y in rows] + [(None, 1, 1), (1, None, None)], "doc_id long, toxic int, quality int")
    odd = spark.createDataFrame([(1, None, 5, 1.0), (1, None, 5, 1.0), (None, "an idiot", 6, 2.0), (2, "", 7, 3.0), (2, "x" * 200_000, 7, 3.0)], "doc_id long, text string, Predicted int, `a.b` double")
    for made in (toxicity.score(odd, toxicity.train(docs, labels)), quality.score(odd, quality.train(docs, labels))):
        got = made.collect()
        assert len(got) == 5 and {"score", "predicted", "a.b", "doc_id", "text"} == set(made.columns) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if not r.text}) == 1 and made.limit(0).count() == 0
    none = labels.limit(0)
    assert {r.score for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.5}
    assert len({r.score for r in toxicity.score(docs.limit(3), toxicity.train(docs, none)).collect()}) == 1


def article(page):
    """Main text of a page of the table, found by its one article element: headings and paragraphs begin blocks."""
    import html
    import re

    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    found = [" ".join(html.unescape(re.sub("<[^>]*>", " " if "br" in inner else "", part)).split()) for part in re.split("</?(?:h1|p)>", inner)]
    return "\n".join(x for x in found if x)


def test_pages_query_equals_the_article_of_each_page(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = {r.page_id: r.text for r in queries.op4_html_text(spark, "/root/testdata/sf0.01").collect()}
    assert len(pages) > 200 and got == {k: article(v) for k, v in pages.items()}


def test_pages_by_hand():
    field = html_text.trained()
    page = (
        '<html><body class="home"><header><a href="/">Daily Paper</a></header><div id="menu"><ul><li><a href="/a">World</a><li><a href="/b">Sport</a></ul></div>'
        '<div class="cookie-notice">We use cookies. <button>OK</button></div><main><article class="post"><h1>Rain &amp; wind in the north</h1>'
        "<p>Heavy rain fell on <b>Tuesday</b> in the north, and rivers rose by two metres overnight.<p>Schools stay closed until the end of the week, the council said on Wednesday.</article></main>"
        '<aside class="sidebar"><h3>Related</h3><ul><li><a href="/c">Sun again</a></ul></aside><div id="comments"><p>Great article, thanks a lot!</div>'
        '<form><label>Mail</label><input><button>Sign up</button></form><footer>&copy; 2024 Daily Paper. All rights reserved.</footer></body></html>'
    )
    want = "Rain & wind in the north\nHeavy rain fell on Tuesday in the north, and rivers rose by two metres overnight.\nSchools stay closed until the end of the week, the council said on Wednesday."
    assert field.extract(page) == want


def test_depth_neither_loses_blocks_nor_costs_more_than_the_page():
    field = html_text.trained()
    inner = "<article><h1>A long title of an article here</h1><div><p>One full sentence stands in this paragraph, and it ends.</p></div><p>Another paragraph of words follows it, and it is as long.</p></article>"
    want = field.extract(f"<body>{inner}</body>")
    assert want.count("\n") == 2
    for depth in (30, 300, 5000):
        assert field.extract("<body>" + "<div>" * depth + inner + "</div>" * depth + "</body>") == want
    field.extract("<div class=a>" * 100_000 + "x" + "</span></b2>" * 100_000)
    assert "x + y" in field.extract("<article><p>The sum is <math><mi>x</mi> + <mi>y</mi></math> as was said in the text above.</p><p>And so it is for all of the numbers, as they say.</p></article>")


def test_pages_on_nulls_repeated_rows_clashing_names_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, "old"), (1, None, "old"), (2, "", "old"), (3, "<p>A few words stand here, as they do.</p>", None)], "page_id long, html string, TEXT string")
    got = html_text.extract(df, html_text.trained())
    assert sorted(got.columns) == ["html", "n_chars", "page_id", "text"] and sorted(r.n_chars == len(r.text) for r in got.collect()) == [True] * 4
    assert [r.text for r in got.where("page_id < 3").collect()] == [""] * 3 and html_text.extract(df.limit(0), html_text.trained()).count() == 0
