"""HTML extraction, the quality network, toxicity and the pipeline."""

from __future__ import annotations

import html
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import html_text, quality, toxicity
from llm.common import crc_mod, prepare, read_table

SF = "/root/testdata/sf0.01"


# ---- HTML -------------------------------------------------------------------------------------------------------


def test_extraction_equals_a_plain_reading_of_the_template(spark):
    prepare(spark)
    got = {r.page_id: r for r in html_text.extract(read_table(spark, SF, "pages")).collect()}
    pages = duckdb.sql(f"SELECT page_id, url, html FROM '{SF}/pages.parquet'").fetchall()
    assert len(got) == len(pages)
    for page_id, url, source in pages:
        article = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        want = "\n\n".join(b for b in blocks if b)
        assert (got[page_id].url, got[page_id].text, got[page_id].n_chars) == (url, want, len(want))


@pytest.mark.parametrize(
    "source, text",
    [
        (None, ""), ("", ""), ("<p", ""), ("plain &amp; &eacute;&nbsp;x", "plain & é x"),
        ("<p>one<p>two <a href='x'>three</a>", "one\n\ntwo three"),
        ("<body><nav>menu</nav><header>top</header><div class='post'><p>a long enough text</p><form><p>name</p></form></div><div id='sidebar'>side</div>",
         "a long enough text"),
        ("<body><article><h1>Title</h1><section><p>first words here</p></section><section>second words</section></article><footer>end</footer>",
         "Title\n\nfirst words here\n\nsecond words"),
        ("<article><p>text of it</p><div class='comment-list'><p>reader says</p></div><div class='articleAd promo'>buy</div></article>", "text of it"),
        ("<script>var a='<p>no</p>'</script><style>p{}</style><p>yes</p><!-- <p>no</p> -->", "yes"),
        ("<table><tr><td>1<td>2</table>a<b>b</b>c", "1\n\n2\n\nabc"),
        ("<p>cut off in the middle &am", "cut off in the middle &am"),
    ],
)
def test_pages(source, text):
    page = html_text.Page(source)
    assert page.text(page.best()[0]) == text


def test_hosts_vote_and_odd_rows(spark):
    prepare(spark)
    body = "<html><body><div class='c{0}'><p>{1}</p></div><div class='x'><p>{2}</p></div></body></html>"
    rows = [(i, "http://h.example/1", body.format(i, "good text " * 30, "little"), "clash") for i in range(5)]
    # Here the other container holds more, but the host's pages agree on c#.
    rows += [(5, "http://h.example/2", body.format(5, "short but right", "noise " * 60), "clash")]
    rows += [(6, None, None, "clash"), (6, None, "<p>x</p>", "clash"), (None, "no url", "<p>y</p>", "clash")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, path string")).collect()
    assert sorted((r.page_id or -1, r.text) for r in got if r.page_id is None or r.page_id >= 5) == [(-1, "y"), (5, "short but right"), (6, ""), (6, "x")]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# ---- quality ----------------------------------------------------------------------------------------------------


def test_gradients_of_the_network():
    network = quality.Network(3)
    texts, y, weight = [b"some words and some words", b"", b"AB!! CD!! " * 40], np.array([0, 1, 1], np.float32), np.full(3, 1 / 3, np.float32)
    g, _ = network.gradients(texts, y, weight)
    for name in g:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        losses = []
        for step in (0.01, -0.02):
            network.p[name][at] += step
            losses.append(network.gradients(texts, y, weight)[1])
        network.p[name][at] += 0.01
        assert (losses[0] - losses[1]) / 0.02 == pytest.approx(float(g[name][at]), rel=0.1, abs=2e-3)


def test_scores_do_not_depend_on_parts(monkeypatch):
    network = quality.Network()
    texts = [b"word " * 2000, b"", b"x", bytes(range(256)) * 30]
    whole = network.score(texts)
    monkeypatch.setattr(quality, "PART_BYTES", 256)
    assert network.score(texts) == pytest.approx(whole, rel=1e-4)


def test_quality_on_held_out_rows(spark):
    prepare(spark)
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    held_out = crc_mod(5) == 0
    got = quality.scores(docs, quality.fit(docs, labels, ~held_out)).join(labels, "doc_id").where(held_out).collect()
    good = [r.score for r in got if r.quality == 1]
    bad = [r.score for r in got if r.quality == 0]
    assert len(bad) >= 5 and np.mean([g > b for g in good for b in bad]) > 0.9
    assert all(0 <= r.score <= 1 for r in got)


def test_quality_odd_rows(spark):
    prepare(spark)
    docs = spark.createDataFrame([(1, None, 2), (None, "a b", 3), (2, "", 4), (2, "", 4)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.scores(docs, quality.fit(docs, labels, F.lit(True))).collect()
    assert len(got) == 4 and all(r.score > 0.99 for r in got)
    assert quality.scores(docs.limit(0), quality.Network()).collect() == []


@pytest.mark.parametrize(
    "source",
    [
        "<body><nav>menu</nav><div class='layout no-sidebar'><article><p>{t}</p></article></div></body>",
        "<body><div class='x'>short</div><article class='post has-comments'><p>{t}</p><div class='ad'>buy</div></article></body>",
        "<body><div class='widget'><div id='search-page'><p>{t}</p></div></div></body>",
        "<body>" + "<div class='widget'>" * 30 + "<p>{t}</p></body>",
    ],
)
def test_named_beside_the_article_but_holding_it(source):
    text = "words of a long article that is the most of the page by far " * 3
    page = html_text.Page(source.format(t=text))
    assert page.text(page.best()[0]) == text.strip()


# ---- toxicity ---------------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, last = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
    return row[-1]


def test_automaton_equals_edit_distances():
    rng = random.Random(5)
    terms = ["idiot", "moron", "worthless", "chllaú", "ab", "disgusting", "idiom"]
    automaton = toxicity.TermAutomaton(terms)
    words = list(terms)
    for _ in range(1500):
        word = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word) + 1)
            edit = rng.randrange(3)
            word[at : at + (edit > 0)] = [rng.choice("abidotmúü本")] if edit < 2 else []
        words.append("".join(word))
    words = [w for w in words if w and w == w.lower()]
    points = np.minimum(np.array([ord(c) for c in "".join(words)]), toxicity._LETTERS)
    lengths = np.array([len(w) for w in words])
    hit, edits = automaton.run(automaton.classes[points], np.cumsum(lengths) - lengths, lengths)
    for word, term, cost in zip(words, hit, edits):
        near = [distance(word, t) for t in terms if distance(word, t) <= toxicity.edits_allowed(t)]
        assert (term >= 0) == bool(near), word
        if near:
            assert cost == min(near) == distance(word, terms[term])


def test_quoted_hits_are_counted_apart():
    automaton = toxicity.TermAutomaton(["idiot", "moron"])
    weights = np.full((2, 3), 4.0)
    direct = toxicity.features(automaton, weights, "you are an idiot, a m0ron and an idiot")
    quoted = toxicity.features(automaton, weights, 'she wrote "what an idiot" in the report on the word "moron"')
    assert direct[0] > 0 and direct[1] == 0
    assert quoted[0] == 0 and quoted[1] > 0
    assert toxicity.features(automaton, weights, None) == toxicity.features(automaton, weights, "kind words") == [0, 0, 0, 0, 0]


def test_toxicity_on_held_out_rows(spark):
    prepare(spark)
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    held_out = crc_mod(3) == 1
    got = toxicity.scores(docs, toxicity.fit(docs, labels, ~held_out)).join(labels, "doc_id").where(held_out).collect()
    caught = [r.score >= toxicity.THRESHOLD for r in got if r.toxic == 1]
    accused = [r.score >= toxicity.THRESHOLD for r in got if r.toxic == 0]
    assert np.mean(caught) > 0.5 and np.mean(accused) < 0.03


def test_toxicity_odd_rows(spark):
    prepare(spark)
    rows = [(i, "what a clown you are, clown and fool" if i % 2 else f"kind words number {i} here", 1) for i in range(60)]
    rows += [(None, "clown", 1), (100, None, 1), (101, "", 1), (101, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    got = toxicity.scores(docs, model).collect()
    assert len(got) == len(rows)
    assert all((r.score >= 0.7) == (r.doc_id is not None and r.doc_id < 60 and r.doc_id % 2 == 1) for r in got if r.doc_id is not None)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {0, 2, 58, 100, 101}
    one_class = toxicity.fit(docs, labels.where("toxic = 0"), F.lit(True))
    assert all(r.score < 0.01 for r in toxicity.scores(docs, one_class).collect())
    assert toxicity.scores(docs.limit(0), model).collect() == []


def test_characters_of_every_script():
    terms = ["идиот", "ηλίθιος", "クソ野郎", "idiot"]
    automaton = toxicity.TermAutomaton(terms)
    words = toxicity.Words("Ты идиот… “idiot” ‘ηλίθιος’ クソ野郎。 идиат кот हिन्दी\u3000idiot")
    places, hit, edits = toxicity.hits_of(automaton, words)
    found = [(words.lowered[words.starts[p] : words.ends[p]], terms[t], e) for p, t, e in zip(places, hit, edits)]
    assert found == [
        ("идиот", "идиот", 0), ("idiot", "idiot", 0), ("ηλίθιος", "ηλίθιος", 0), ("クソ野郎", "クソ野郎", 0), ("идиат", "идиот", 1), ("idiot", "idiot", 0),
    ]
    assert words.quoted(places).tolist() == [False, True, False, False, False, False]
    assert "हिन्दी" in {words.lowered[a:b] for a, b in zip(words.starts, words.ends)}


def test_misspellings_that_no_labelled_text_holds(spark):
    prepare(spark)
    insults, kind = ["clown", "worthless", "disgusting"], "some kind words about the oron of the town and its clowny people in row"
    rows = [(i, f"{kind} {i}" + (f" you are {insults[i % 3]} and so {insults[(i + 1) % 3]}" if i % 2 else "")) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    new = [
        (1, "you are a cl0wn and so w0rthles"), (2, "what a clwn and what a disgustinng one"), (3, "such a wortles clovn"),
        (4, "the oron of the clowny people"), (5, "nothing in it"),
    ]
    new = spark.createDataFrame(new, "doc_id long, text string")
    model = toxicity.fit(docs, labels, F.lit(True))
    assert set(model.terms) >= set(insults)
    got = {r.doc_id: r.score >= toxicity.THRESHOLD for r in toxicity.scores(new, model).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False}
    assert {r.doc_id for r in toxicity.drop_toxic(new, model).collect()} == {4, 5}


# ---- pipeline ---------------------------------------------------------------------------------------------------


def test_pipeline_equals_its_parts_done_plainly(spark):
    import hashlib

    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from llm import mixing
    from tests.llm.test_operators import plain_components

    prepare(spark)
    docs = duckdb.sql("SELECT doc_id, text, source FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    sf_dir = "/root/testdata/sf0.001"
    tables = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.fit(*tables, crc_mod(3) != 1)
    score = model.scorer()
    kept = [d for d in docs if score(d[1]) < toxicity.THRESHOLD]
    best = {}
    for d in kept:
        best[d[1]] = max(best.get(d[1], d), d)
    kept = sorted(best.values())
    root = {i: c for i, _, c in plain_components(kept)}
    kept = [d for d in kept if root[d[0]] == d[0]]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", kept)
    copies = {r[0]: r[1] for r in con.sql(f"SELECT doc_id, copies FROM ({mixing.SQL})").fetchall()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, text, _ in kept:
        ids = library.encode(text, add_special_tokens=False).ids
        row = (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        want += [row] * copies[i]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(want)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "mixing", "bpe"]
