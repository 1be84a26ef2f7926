"""The contract queries against plain versions, on real tables and on awkward rows."""

import math
import random

import brute
import pytest
from pyspark.sql import Row

from plumbline.llm import decontaminate, html_text, licenses, line_dedup, mixing, quality, queries, sharding, simhash, substring, url_filter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, shard string, fp string, chunk int, node string"


def awkward(spark, empty=False):
    """Nulls, empty and very long texts, ties, repeated rows and columns with names that operators use."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, long = prose(60), prose(30_000)
    texts = [None, "", " \n\t", "one", "two words", prose(100), passage, passage, prose(30) + "\n" + passage + "\n" + prose(9), long, long + " x", passage.upper(), "é ü " * 30, " ".join(["w"] * 50), prose(12), "a " * 40, "Released under the MIT License.\nAll rights reserved."]
    texts += [f"{passage} {prose(3)}" for _ in range(30)]
    rows = [(i, t, [None, "en", "xx"][i % 3], [None, "src0"][i % 2], 1, "k", "s", "f", 1, "n") for i, t in enumerate(texts)]
    return spark.createDataFrame([] if empty else rows, DOCS)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_quality(spark, documents, which):
    docs = documents if which == "table" else awkward(spark)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = rows_of(quality.quality_measures(docs))
    assert len(got) == len(texts)
    for r in got:
        want = brute.quality_base(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want, r["doc_id"]
        assert not (r["kept"] and r["base_failed"])
    kept = {r["doc_id"] for r in got if r["kept"]}
    filtered = quality.quality_filter(docs)
    assert filtered.columns == docs.columns
    assert {r["doc_id"] for r in filtered.collect()} == kept


#: Published prose, of the Universal Declaration of Human Rights.
PROSE = {
    "de": [
        "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geiste der Brüderlichkeit begegnen.",
        "Jeder hat Anspruch auf die in dieser Erklärung verkündeten Rechte und Freiheiten ohne irgendeinen Unterschied, etwa nach Rasse, Hautfarbe, Geschlecht, Sprache, Religion, politischer oder sonstiger Überzeugung, nationaler oder sozialer Herkunft, Vermögen, Geburt oder sonstigem Stand.",
    ],
    "fr": [
        "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.",
        "Chacun peut se prévaloir de tous les droits et de toutes les libertés proclamés dans la présente Déclaration, sans distinction aucune, notamment de race, de couleur, de sexe, de langue, de religion, d'opinion politique ou de toute autre opinion, d'origine nationale ou sociale, de fortune, de naissance ou de toute autre situation.",
    ],
    "es": [
        "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros.",
        "Toda persona tiene todos los derechos y libertades proclamados en esta Declaración, sin distinción alguna de raza, color, sexo, idioma, religión, opinión política o de cualquier otra índole, origen nacional o social, posición económica, nacimiento o cualquier otra condición.",
    ],
}


def test_quality_keeps_real_prose(spark):
    """Paragraphs of published documentation, and of other languages, under the bands that were measured on invented prose."""
    import importlib
    import re as regex

    found = []
    for name in ("argparse", "decimal", "statistics", "random", "datetime", "typing", "collections", "inspect", "ast", "json", "csv", "logging", "re", "tarfile", "doctest", "difflib", "fractions", "textwrap"):
        module = importlib.import_module(name)
        told = [getattr(x, "__doc__", None) for x in (module, *vars(module).values())]
        found += [p for t in told if isinstance(t, str) for p in regex.split(r"\n\s*\n", t) if len(p.split()) >= 25 and ">>>" not in p]
    rows = [(k, t, "en") for k, t in enumerate(dict.fromkeys(found))]
    rows += [(10_000 + k, t, lang) for k, (lang, t) in enumerate((lang, t) for lang, ts in PROSE.items() for t in ts)]
    got = quality.quality_measures(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("NOT base_failed").collect()
    english = [r.kept for r in got if r.doc_id < 10_000]
    assert len(english) >= 40 and sum(english) >= 0.95 * len(english)
    assert [r.kept for r in got if r.doc_id >= 10_000] == [True] * 6


def test_quality_tells_junk(spark):
    """Labels are held out: the bands come of other tables of documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.quality_measures(docs).join(labels, "doc_id").where("NOT base_failed").select("quality", "kept").collect()
    good = [r.kept for r in rows if r.quality == 1]
    junk = [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.99
    assert sum(junk) / len(junk) < 0.1


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_quality_verdicts(spark, documents, which):
    """Figures and verdict of each text against one that is cut word by word."""
    docs = documents if which == "table" else awkward(spark)
    source = {r.doc_id: r for r in docs.collect()}
    f = quality.INSTALLED.load()
    told = 0
    for r in rows_of(quality.quality_measures(docs)):
        x = source[r["doc_id"]]
        figures, inside = brute.fertility(x.text, x.lang, f.model, f.byte_level, quality.LANGUAGE_BANDS, quality.SCRIPT_BANDS, quality.ENTROPY_FLOOR)
        assert {k: r[k] for k in figures} == pytest.approx(figures, abs=1e-9), r["doc_id"]
        assert r["kept"] == (inside and not r["base_failed"]), r["doc_id"]
        told += not inside and not r["base_failed"]
    assert told > 3


def test_quality_figures_each_reject(spark, documents):
    """Of a clean text, one figure at a time goes out of its band."""
    bands = quality.LANGUAGE_BANDS
    rows = [r for r in rows_of(quality.quality_measures(documents.where("lang = 'en'"))) if r["kept"]]
    text = {r.doc_id: r.text for r in documents.collect()}[max(rows, key=lambda r: r["n_words"])["doc_id"]]
    marked = "".join(c + ("%%%" if c == " " else "") for c in text)  # more tokens for each character
    capitals = text.upper()
    foreign = " ".join(w if k % 4 else "\u16a0\u16a2\u16a6" for k, w in enumerate(text.split(" ")))
    few = " ".join(brute.words(text)[k * 7 % 9] + "x" * (k % 2) for k in range(60))
    docs = spark.createDataFrame([(0, text, "en"), (1, marked, "en"), (2, capitals, "en"), (3, foreign, "en"), (4, few, "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in rows_of(quality.quality_measures(docs))}
    assert got[0]["kept"] and not any(got[k]["kept"] for k in (1, 2, 3, 4))
    for k in (1, 2):
        assert not bands["en"].byte_level.admits(got[k]["chars_per_byte_token"], got[k]["n_words"])
    assert got[3]["byte_share"] > bands["en"].max_byte_share
    assert got[4]["token_entropy"] < dict(quality.ENTROPY_FLOOR)[int(math.log2(got[4]["n_tokens"]))]


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_simhash(spark, documents, which):
    docs = documents if which == "table" else awkward(spark)
    want = brute.simhash_classes([(r["doc_id"], r["text"]) for r in docs.collect()])
    for limit in (simhash.FILE_LIMIT, 2):
        got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs, limit).collect()}
        assert got == want


def test_simhash_links_in_crowded_files(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for c in centres for _ in range(150)}
    fps |= {rng.getrandbits(64) for _ in range(100)}
    nodes = list(enumerate(sorted(fps)))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in nodes], "fp long, node long")
    root = {i: i for i, _ in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in nodes:
        for j, b in nodes[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    found = {r.node: r.root for r in simhash.components(simhash.links(df, 8)).collect()}
    assert {i: found.get(i, i) for i, _ in nodes} == {i: find(i) for i, _ in nodes}


def test_simhash_keeps_one_of_each_class(spark):
    docs = awkward(spark)
    want = brute.simhash_classes([(r["doc_id"], r["text"]) for r in docs.collect()])
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_simhash_keeps_one_row_where_ids_are_shared(spark):
    same, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    third, near = " ".join(f"u{i}" for i in range(300)), " ".join([*(f"u{i}" for i in range(299)), "x"])
    rows = [(None, same, 1), (None, same, 2), (5, same, 3), (5, same, 3), (7, same, 4), (9, other, 5), (9, third, 6), (None, near, 7), (None, "only here " * 5, 8), (None, "only here " * 5, 9), (11, other, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    fps = {t: brute.simhash(t) for _, t, _ in rows}
    assert (fps[third] ^ fps[near]).bit_count() <= 3
    for frame in (docs, docs.repartition(5)):
        kept = [tuple(r) for r in simhash.drop_near_duplicates(frame).collect()]
        assert sorted((r[0] or 0, r[1][:2]) for r in kept) == [(0, "on"), (5, "w0"), (9, "u0"), (9, "v0")]
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted([(0, 5), (0, 5), (5, 5), (5, 5), (7, 5), (9, 9), (9, 9), (0, 9), (0, 0), (0, 0), (11, 9)])


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_sharding(spark, documents, which):
    docs = documents if which == "table" else awkward(spark)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    first = rows_of(sharding.shard_digest(docs))
    brute.shard_sizes_ok(first, len(texts), texts)
    again = rows_of(sharding.shard_digest(docs.repartition(5)))
    assert sorted(map(str, first)) == sorted(map(str, again))
    carried = sharding.shard(docs, carry=("text",), rows_per_block=7)
    assert {r.doc_id: r.in_text for r in carried.collect()} == texts
    whole = sharding.shard_rows(docs)
    assert {r.doc_id: r.text for r in whole.collect()} == texts and len(set(whole.columns)) == len(whole.columns)
    brute.shard_sizes_ok([{k: r[k] for k in first[0]} for r in whole.collect()], len(texts), texts)


def test_communication_matrix():
    blocks = [7, 0, 100, 33, 1]
    m = sharding.communication_matrix(blocks, 16, 1)
    assert m.sum(axis=1).tolist() == blocks and set(m.sum(axis=0)) <= {8, 9}
    means = sum(sharding.communication_matrix([40, 40], 4, s) for s in range(200)) / 200
    assert abs(means - 10).max() < 1
    assert sharding.communication_matrix([], 16, 1).sum() == 0


def test_draws_beyond_numpys_bound():
    """The inversion against numpy's sampler where both hold, and its moments where only it does."""
    import numpy as np

    rng = np.random.default_rng(5)
    good, bad, n = 300, 700, 120
    own = np.bincount([sharding._inverted(rng, good, bad, n) for _ in range(20_000)], minlength=n + 1)
    other = np.bincount(rng.hypergeometric(good, bad, n, 200_000), minlength=n + 1) / 10
    near = other > 30
    assert ((own - other)[near] ** 2 / other[near]).sum() < 1.6 * near.sum()
    for good, bad, n in ((10**11, 15 * 10**11, 65_536), (10**10, 10**10, 10**9), (2 * 10**9, 5, 2 * 10**9 + 3)):
        total = good + bad
        mean, var = n * good / total, n * (good / total) * (bad / total) * ((total - n) / (total - 1))
        got = [sharding._draw(rng, good, bad, n) for _ in range(2000 if n < 10**6 else 300)]
        assert abs(np.mean(got) - mean) < 4 * max(var, 1) ** 0.5 / len(got) ** 0.5
        assert var < 2 or 0.75 < np.var(got) / var < 1.3
    assert sharding._inverted(rng, 3, 2, 5) == 3 and sharding._inverted(rng, 0, 9, 4) == 0


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_substring(spark, documents, which):
    docs = documents if which == "table" else awkward(spark)
    want = brute.substring([(r["doc_id"], r["text"]) for r in docs.collect()])
    for size in (substring.CHUNK_BYTES, 3000):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.digest(docs, size).collect()}
        assert got == want
    texts = {r.doc_id: r.text for r in substring.remove_duplicates(docs).collect()}
    assert all(len(brute.words(texts[i])) == n - gone for i, (n, gone, _) in want.items())
    covered = {}
    source = {r["doc_id"]: brute.words(r["text"]) for r in docs.collect()}
    for r in substring.spans(docs).collect():
        assert r.n_words >= substring.WINDOW and r.source_doc < r.doc_id
        assert source[r.doc_id][r.first_word : r.first_word + r.n_words] == source[r.source_doc][r.source_word : r.source_word + r.n_words]
        covered.setdefault(r.doc_id, set()).update(range(r.first_word, r.first_word + r.n_words))
    assert {i: len(c) for i, c in covered.items()} == {i: gone for i, (_, gone, _) in want.items() if gone}


def test_substring_factors(spark):
    """A factor is one stretch of one reference document; the next begins with the first window that it doesn't hold."""
    w = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(w[:14])), (2, " ".join(w[1:25])), (3, " ".join(w[:25])), (4, " ".join(w[30:] + w[:25]))], "doc_id long, text string")
    for size in (substring.CHUNK_BYTES, 10):
        got = sorted(tuple(r) for r in substring.spans(docs, size).where("doc_id > 2").collect())
        assert got == [(3, 0, 14, 1, 0), (3, 2, 23, 2, 1), (4, 10, 14, 1, 0), (4, 12, 23, 2, 1)]


def test_substring_of_one_id(spark):
    """All ids null, or all equal: nobody is earlier, and the rows are spread over chunks."""
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(k % 3, 40))) for i in (None, 5) for k in range(50)], "doc_id long, text string")
    got = substring.digest(docs, 500).collect()
    assert len(got) == 100
    assert {r.n_removed for r in got if r.doc_id == 5} == {0} and all(r.n_removed == r.n_words for r in got if r.doc_id is None)


def test_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    odd = ["HTTP://User@Ex.COM/en/1", "http://example.com?x=/en/", "x", "", None, "http://a.example.net/de/81#f", "://org/es/", "http://notcom/en/", "http://a.com/en/://b", "http://B.example.com/en/77?q#z", "https://com/en/"]
    extra = spark.createDataFrame([(10_000 + i, u) for i, u in enumerate(odd)], "page_id long, url string")
    both = pages.unionByName(extra)
    urls = {r.page_id: r.url for r in both.collect()}
    many = url_filter.RULES + tuple(url_filter.Rule(f"none{i}.invalid/", True) for i in range(300))
    for r in rows_of(url_filter.judge(both)):
        host, path = brute.url_parts(urls[r["page_id"]])
        rule = brute.url_rule(host, path, url_filter.RULES)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule.rule), urls[r["page_id"]]
        assert r["verdict"] == (("block" if rule.block else "allow") if rule else r["verdict"]) and r["verdict"] in ("block", "allow")
    joined = url_filter.with_rules(url_filter.parsed(both), many)
    for r in joined.collect():
        rule = brute.url_rule(r.host, r.path, url_filter.RULES)
        assert r.rule == (rule and rule.rule)


def test_url_trees_learn(spark):
    """Held out: neither trees nor suffix statistics have seen the labels that are asked for."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    known = url_filter.with_rules(url_filter.parsed(pages)).where("ruled IS NOT NULL")
    held, learnt = known.where("pmod(xxhash64(url, 9), 4) = 0"), known.where("pmod(xxhash64(url, 9), 4) <> 0")
    statistics = url_filter.suffix_statistics(known, learnt).cache()
    model = url_filter.train(learnt, statistics)
    rows, features = url_filter.with_features(held, statistics)
    r = model.transform(rows).selectExpr("avg(cast((prediction > 0.5) = (ruled = 'block') as double)) AS a", "avg(cast(ruled = 'block' as double)) AS b").first()
    assert r.a > max(r.b, 1 - r.b) + 0.1 and r.a > 0.84
    weight = dict(zip(features, model.stages[-1].featureImportances.toArray(), strict=True))
    assert sum(v for k, v in weight.items() if not k.startswith("f_suffix")) > 0.05
    # a URL's own label doesn't reach its features
    flipped = learnt.withColumn("ruled", learnt.ruled)
    some = learnt.limit(1).first().url
    turned = flipped.selectExpr("page_id", "url", "host", "path", "rule", f"if(url = '{some}', if(ruled = 'block', 'allow', 'block'), ruled) AS ruled")
    seen = [url_filter.with_features(x.where(f"url = '{some}'").limit(1), url_filter.suffix_statistics(known, x).cache(), True)[0].first().f_suffix_blocked for x in (learnt, turned)]
    assert seen[0] == seen[1]


def test_url_edge_cases(spark):
    schema = "page_id long, url string, html string, host string, path string, rule string, verdict string, _suffix string, pages long"
    long = "http://a.example.org/x/" + "y" * 100_000
    urls = [None, "", "http://", long, long, "http://tie.example.com/en/1", "http://tie.example.com/en/1", "http://m.example.net/de/1", "http://x.example.io/zz"] * 3
    pages = spark.createDataFrame([(k if k % 7 else None, u, None, "h", "p", "r", "v", "s", 1) for k, u in enumerate(urls)], schema)
    got = url_filter.judge(pages).collect()
    assert len(got) == len(urls) and got[0].__fields__ == ["page_id", "host", "path", "rule", "verdict"]
    by_id = {r.page_id: r for r in got if r.page_id is not None}
    for k, u in enumerate(urls):
        if k % 7:
            assert (by_id[k].host, by_id[k].path) == brute.url_parts(u)
            assert by_id[k].verdict in ("block", "allow")
            assert len({r.verdict for r in got if (r.host, r.path) == (by_id[k].host, by_id[k].path)}) == 1
    few = url_filter.BROADCAST_ROWS
    try:
        url_filter.BROADCAST_ROWS = 0
        assert sorted(map(str, url_filter.judge(pages).collect())) == sorted(map(str, got))
    finally:
        url_filter.BROADCAST_ROWS = few


def test_html_cases():
    page = '<body><header>Site</header><div id="sidebar">x</div><main><article><header><h1>T &amp; U</h1></header><p>One<br>two</p><div class="ad">buy</div><p>Three <a href=x>l</a></p><section class="comments"><p>nice!</p></section></article></main><footer>f</footer>'
    assert html_text.main_text(page) == "T & U\nOne two\nThree l"
    assert html_text.main_text(None) == html_text.main_text("") == ""
    assert html_text.main_text("<div><p>only  a\npara</p></div>") == "only a para"
    assert html_text.main_text("<script>var a='</p>'</script><p>x &lt;b&gt;") == "x <b>"
    plain = "<nav>a b c</nav>" + "<p>word word word</p>" * 9 + '<div class="footer">z</div>'
    assert html_text.main_text(plain) == "\n".join(["word word word"] * 9)


def test_html_keeps_what_dropped_elements_part():
    paras = [f"paragraph {k} of the article" for k in range(9)]
    whole = "\n".join(paras)
    block = lambda part: "".join(f"<p>{p}</p>" for p in part)
    for between in ('<div class="ad">buy</div>', '<div class="notice">old</div>', "<form>mail <input></form>", "<aside>see also</aside>", '<div class="share">post it</div>', "<nav>a b c</nav>"):
        page = f'<nav>a b</nav><div id="text"><div>{block(paras[:2])}{between}{block(paras[2:5])}</div>{between}<div>{block(paras[5:])}</div></div><footer>z</footer>'
        assert html_text.main_text(page) == whole
    assert html_text.main_text(f"<header>s</header><article>{block(paras[:2])}</article><nav>a</nav><article>{block(paras[2:])}</article>") == whole
    assert html_text.main_text(f"<article>{block(paras[:4])}</article><article>{block(paras[4:])}</article><div>after it</div>") == whole


def test_html_windows_decide():
    """Pages without a word on what is what: sizes over windows tell text from the rest."""
    prose = lambda n, k=3: "".join(f"<p>{f'Paragraph {i} of the running text, which has some length to it. ' * k}</p>" for i in range(n))
    text = lambda n, k=3: "\n".join(f"{f'Paragraph {i} of the running text, which has some length to it. ' * k}".strip() for i in range(n))
    menu, end = "<div><a href=/>Home</a> <a href=/b>About us</a> | Search</div>", "<div>Copyright 2020 Example Inc.</div>"
    for page, want in (
        (f"<body>{menu}<div><h1>T</h1>{prose(3)}<p>End.</p></div>{end}", f"T\n{text(3)}\nEnd."),
        (f"<body>{menu}<h1>T</h1>{prose(3)}<p>by us</p>", f"T\n{text(3)}"),
        (f"<body>{menu}<article>Read this other story</article><div>{prose(3)}</div>{end}", text(3)),
        (f"<body>{menu}<div>{prose(2)}</div><div class=ad>{prose(1)}</div><div>{prose(2)}</div>{end}", f"{text(2)}\n{text(2)}"),
        (f"<table><tr><td><a>x</a><br>menu</td><td>{prose(3)}</td></tr></table>", text(3)),
    ):
        assert html_text.main_text(page) == want
        assert html_text.main_text(page, None) != want or "ad" in page and menu not in page
    whole = f"<article><h1>T</h1><div>By X</div><section><h2>a</h2>{prose(2)}</section><section><p>short</p></section><p>Bye</p></article>"
    assert html_text.main_text(f"<body>{menu}{whole}{end}") == f"T\nBy X\na\n{text(2)}\nshort\nBye"


def test_html_names_are_believed_where_the_page_bears_them_out():
    prose, text = "<p>" + "A paragraph of the running text. " * 9 + "</p>", ("A paragraph of the running text. " * 9).strip()
    for page in (
        f'<div class="social science">{prose}</div>',
        f'<div id="social">{prose}</div>',
        f'<body class="has-sidebar"><div class="with-sidebar"><div class="content">{prose}</div><div class="sidebar">{prose}</div><div id="comments">{prose}{prose}</div></div>',
        f"<aside>See also<div>{prose}</div><footer>f</footer>",
        f"<aside>See also<article>{prose}</article>",
        f"<aside><p>See also{prose}",
        f'<form id="aspnetForm"><nav>a</nav><div>{prose}</div></form>',
        f'<div class="banner-area"><article>{prose}</article></div>',
    ):
        assert html_text.main_text(page) == text, page
    assert html_text.main_text(f'<div class="comments">{prose}</div><nav>{prose}</nav><aside>{prose}</aside>') == ""


def test_html_tags_are_one_evidence(spark):
    """The tables' pages with divs in place of articles give the same texts."""
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        assert html_text.main_text(r.html.replace("<article>", '<div id="x">').replace("</article>", "</div>")) == html_text.main_text(r.html)


def test_html_deep_nesting():
    assert html_text.main_text("<div>" * 50_000 + "<p>some words</p>" + "</div>" * 50_000) == "some words"
    assert html_text.main_text("<b>" * 5_000 + "some words") == "some words"


def test_html_long_and_repeated_pages(spark):
    page = "<nav>a</nav><article>" + "<p>word word word word</p>" * 40_000 + "</article>"
    pages = spark.createDataFrame([(1, "u", page, "t", 5)] * 3 + [(None, None, None, "t", 5)], "page_id long, url string, html string, text string, n_chars int")
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.n_chars, r.page_id) for r in got.select("n_chars", "page_id").fillna(0).collect()) == [(0, 0), *[(40_000 * 20 - 1, 1)] * 3]


def test_html_pages(spark):
    import html
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.extract(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_decontamination(spark, documents):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: r.text for r in benchmark.collect()}
    lower = lambda t: brute.words((t or "").lower())
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    rng = random.Random(8)
    for k in range(40):  # planted: a passage with up to a fifth of its words changed
        w = lower(items[k])
        for _ in range(rng.randint(0, int(0.15 * len(w)))):
            at = rng.randrange(len(w))
            w[at : at + 1] = [[], ["zz"], [w[at], "yy"]][rng.randrange(3)]
        docs.append((100_000 + k, "before " * 20 + " ".join(w) + " after" * 9))
    frame = spark.createDataFrame([*docs, (-1, None), (-2, "")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.edit_distance for r in decontaminate.leaks(frame, benchmark).collect()}
    in_blocks = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, benchmark, block_bytes=4000).collect()}
    assert in_blocks == set(got)
    want = {}
    for i, t in docs:
        for item, text in items.items():
            w = lower(text)
            if set(w) & set(lower(t)) and (d := brute.edit_distance(w, lower(t))) <= int(0.2 * len(w)):
                want[i, item] = d
    assert set(got) <= set(want)
    assert len(set(got)) >= 0.97 * len(want)
    assert all(want[k] == d for k, d in got.items())
    clean = decontaminate.drop_leaking(frame, benchmark)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in frame.collect()} - {i for i, _ in got}


@pytest.mark.parametrize("kind", ["deletions", "mixed"])
def test_decontamination_of_long_items_at_the_largest_distance(spark, kind):
    rng = random.Random(21)
    items, docs = [], []
    for k, n in enumerate((60, 80, 120, 160, 200, 250) * 5):
        w = [f"v{rng.randrange(5000)}" for _ in range(n)]
        items.append((k, " ".join(w)))
        gone = int(0.2 * n)
        for at in sorted(rng.sample(range(n), gone), reverse=True):
            w[at : at + 1] = [] if kind == "deletions" else [[], ["zz"], [w[at], "yy"]][rng.randrange(3)]
        docs.append((k, "before " * 20 + " ".join(w) + " after" * 9))
        docs.append((1000 + k, " ".join(w[: len(w) // 2])))  # half of an item is no leak
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(k, k) for k, _ in items}
    lengths = {k: len(t.split()) for k, t in items}
    assert all(r.edit_distance <= int(0.2 * lengths[r.item_id]) for r in got.values())


def test_decontamination_of_short_items(spark):
    """Items of one to six words: those within the edits that their length allows, by brute force."""
    rng = random.Random(4)
    word = lambda: f"v{rng.randrange(60)}"
    items = [(k, " ".join(word() for _ in range(1 + k % 6))) for k in range(40)] + [(90, None), (91, "")]
    docs = [(k, " ".join(word() for _ in range(rng.randint(0, 60)))) for k in range(60)]
    docs += [(100 + k, f"before {t} after") for k, t in items if t]
    for k, t in items:
        w = (t or "").split()
        if len(w) == 5:
            docs.append((200 + k, " ".join(["x", *w[:2], "zz", *w[3:], "y"])))
    want = {}
    for i, t in docs:
        for k, item in items:
            w = (item or "").split()
            if w and (d := brute.edit_distance(w, t.split())) <= int(0.2 * len(w)):
                want[i, k] = d
    got = {(r.doc_id, r.item_id): r.edit_distance for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want


def test_decontamination_tells_the_best_place(spark):
    """A copy with an edit and, before or behind it, an exact one: the exact one is told."""
    rng = random.Random(12)
    items, docs = [], []
    for k in range(30):
        w = [f"v{rng.randrange(900)}" for _ in range(30)]
        items.append((k, " ".join(w)))
        changed = [*w[:11], "other", *w[12:]]
        parts = [["before"] * rng.randint(0, 50), changed, ["between"] * rng.randint(1, 90), w, ["after"] * 5]
        if k % 2:
            parts[1], parts[3] = parts[3], parts[1]
        docs.append((k, " ".join(x for p in parts for x in p)))
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.edit_distance, r.first_word) for r in got} == {(k, k, 0, t.split().index(items[k][1].split()[0]) if k % 2 else t.split().index("between") + t.split().count("between")) for k, t in docs}


def test_decontamination_of_common_grams():
    """A gram of all items in a text that repeats it is met for a few items at a time, with the same leaks."""
    import pyarrow as pa

    items = [f"which of the following holds for case number {k} of all" for k in range(300)]
    text = pa.array(["which of the following " * 200 + items[7], "nothing here", items[250] + " x " + items[3]])
    index = decontaminate.Items(list(range(300)), items, 0.0, 0.98)
    want = [(0, 7), (2, 3), (2, 250)]
    for hits, spots in ((decontaminate.HITS, decontaminate.SPOTS), (500, 20)):
        before = decontaminate.HITS, decontaminate.SPOTS
        try:
            decontaminate.HITS, decontaminate.SPOTS = hits, spots
            assert [f[:2] for f in index.search(text)] == want
        finally:
            decontaminate.HITS, decontaminate.SPOTS = before


def test_decontamination_edge_cases(spark):
    """Repeated rows, clashing columns and a very long text."""
    item = " ".join(f"i{k}" for k in range(30))
    long = "x " * 300_000 + item + " y" * 300_000
    docs = spark.createDataFrame([(1, item, 5), (1, item, 5), (None, item, 5), (2, long, 5), (3, "x", 5)], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(1, item, "d"), (1, item, "d")], "item_id long, text string, doc_id string")
    got = sorted((r.doc_id or 0, r.item_id, r.first_word, r.edit_distance, r.item_words) for r in decontaminate.leaks(docs, items).collect())
    assert got == sorted([(0, 1, 0, 0, 30), (1, 1, 0, 0, 30), (1, 1, 0, 0, 30), (2, 1, 300_000, 0, 30)] * 2)
    assert [tuple(r) for r in decontaminate.drop_leaking(docs, items).collect()] == [(3, "x", 5)]


def test_walks_follow_the_measured_rate():
    assert decontaminate.collision_rate(20, 0) == 1 and decontaminate.repetitions(20, 0) == 1
    rates = [decontaminate.collision_rate(30, t) for t in (1, 3, 6)]
    assert rates[0] > rates[1] > rates[2] > 0
    assert decontaminate.repetitions(30, 1) < decontaminate.repetitions(30, 6) <= decontaminate.MAX_WALKS


MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
APACHE = """Copyright 2020 Somebody

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
BSD = """Copyright (c) 2020, Somebody
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."""


ISC = """Copyright (c) 2020, Somebody

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"


def test_licence_texts_in_lines(spark):
    import textwrap

    want, docs = {}, []
    lesser = GPL.replace("This program", "This library").replace("General", "Lesser General").replace("version 3", "version 2.1")
    for text, licence, ids in (
        (MIT, "mit-text", "10|11|12|13"),
        (APACHE, "apache-2.0-text", "3|41|42|43|44"),
        (APACHE.replace("at\n\n    http", "at http").replace("2.0\n\nUnless", "2.0 Unless"), "apache-2.0-text", "3|41|42|43|44"),
        (APACHE.split(" You may")[0], "apache-2.0-header", "3|41"),
        (GPL, "gpl-3.0-or-later", "103|55|105"),
        (GPL.replace("software:", "software;").replace("version 3", "version 2"), "gpl-2.0-or-later", "101|55|105"),
        (lesser, "lgpl-2.1-or-later", "107|55|111"),
        (GPL.replace("General", "Affero General"), "agpl-3.0-or-later", "117|55|119"),
        (BSD, "bsd-text", "1|30|31"),
        (ISC, "isc-text", "20|22|23"),
        (MPL, "mpl-2.0-header", "60|61"),
        (UNLICENSE, "unlicense-text", "70|71"),
        (EPL, "epl-2.0", "66"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa-4.0", "202"),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause", "306"),
    ):
        for width in (10_000, 76, 60, 31):
            for first, mark, last in (("", "", ""), ("/*\n", " * ", "\n */\nint main() {}"), ("", "// ", "\nint x;"), ("#!/bin/sh\n", "# ", "\nls"), ("", "dnl ", ""), ("<!--\r\n", "  ", "\r\n-->")):
                wrapped = "\n".join("\n".join(textwrap.wrap(line, width, break_on_hyphens=False, break_long_words=False)) for line in text.split("\n"))
                docs.append((len(docs), first + "\n".join(mark + line for line in wrapped.split("\n")) + last))
                want[len(want)] = (licence, ids)
    none = ["Nobody is\nLicensed under the MIT\n\nLicense.", "Not Licensed under CC BY\n4.0.", "Licensed under CC\nBY 4.0 or later", "SPDX-License-Identifier: Mine"]
    docs += [(1000 + k, t) for k, t in enumerate(none)]
    got = {r.doc_id: (r.licence, r.sentence_ids) for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want | {1000 + k: (None, "") for k in range(len(none))}


def test_each_known_sentence_is_found(spark):
    """Whole table of sentences: each, on a line of its own, gives its identifiers."""
    known = [(s, ids) for i, variants in licenses.SENTENCES.items() for s, ids in ((v, (i,)) for v in variants)] + licenses.JOINED
    docs = [(k, f"First line\n\n{s}\n\nlast line") for k, (s, _) in enumerate(known)]
    got = {r.doc_id: r.sentence_ids for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    by_text = licenses.known_sentences()
    assert got == {k: "|".join(map(str, by_text[licenses.normal(s)])) for k, (s, _) in enumerate(known)}
    assert len({name for name, _ in licenses.RULES}) > 50


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(300):
        a, b = [rng.randrange(4) for _ in range(rng.randint(1, 12))], [rng.randrange(4) for _ in range(rng.randint(0, 20))]
        assert decontaminate.edit_distance_within(a, b)[0] == brute.edit_distance(a, b)


def test_sql_queries_on_awkward_rows(spark):
    import duckdb

    docs = awkward(spark)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    for name, df in (("op1_line_dedup", line_dedup.line_dedup_digest(docs)), ("op7_mixing", mixing.mix(docs)), ("op10_licenses", licenses.scan(docs))):
        cols = sorted(df.columns)
        got = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
        want = sorted(str(tuple(x)) for x in con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall())
        assert got == want, name


def test_lines_of_long_lists(spark):
    """The lists of many sites meet pages by shares; the result is the same."""
    docs = awkward(spark)
    want = sorted(map(str, line_dedup.line_dedup(docs).collect()))
    few = line_dedup.BROADCAST_LINES
    try:
        line_dedup.BROADCAST_LINES = -1
        assert sorted(map(str, line_dedup.line_dedup(docs).collect())) == want
    finally:
        line_dedup.BROADCAST_LINES = few
    pages = spark.createDataFrame([(1, "s", "menu\nfirst"), (2, "s", "menu\nsecond"), (3, "t", "menu\nthird")], "doc_id long, source string, text string")
    assert {r.doc_id: r.text for r in line_dedup.line_dedup(pages, ratio=0.5).collect()} == {1: "first", 2: "second", 3: "menu\nthird"}


def test_mixing_budgets(spark):
    leaves = spark.createDataFrame([("a", "x", "s", 10), ("a", "x", "t", 1000), ("a", "y", "s", 5), ("b", "x", "s", 100)], "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang, r.source): r.given for r in mixing.leaf_budgets(leaves, 1, 2, 1, {"a": 1, "b": 1}, {}, {}).collect()}
    # 557 in all: b takes its 100, the shortage goes to a; there y takes 5 and x the rest, of which s takes 10
    assert got == {("b", "x", "s"): 100, ("a", "y", "s"): 5, ("a", "x", "s"): 10, ("a", "x", "t"): 442}


def test_mixing_takes_a_share_of_rows_without_or_with_one_id(spark):
    rows = [(None if k % 2 else 7, f"text number {k} of many " + "word " * (k % 5), "en", f"src{k % 2}", 1) for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    tokens = [len(r[1].split()) for r in rows]
    taken = mixing.mix(docs, max_epochs=1).collect()
    assert 0 <= 3 * sum(tokens) // 5 - sum(r.n_tokens for r in taken) <= 2 * max(tokens)
    kept = mixing.mix_rows(docs, 9, 10).collect()
    assert 0 <= 9 * sum(tokens) // 10 - sum(len(r.text.split()) for r in kept) <= 2 * max(tokens)


def test_mixing_rows_agree(spark, documents):
    taken = {r.doc_id for r in mixing.mix(documents, 9, 10, 1).collect()}
    rows = mixing.mix_rows(documents, 9, 10)
    assert rows.columns == documents.columns
    assert {r.doc_id for r in rows.collect()} == taken
    n = documents.count()
    assert 0.6 * n < len(taken) < n


def test_mixing_many_leaves(spark, documents):
    """Leaves that are too many to be broadcast meet rows by shares; bins grow with the rows."""
    from plumbline.llm import common

    want = sorted(map(str, mixing.mix(documents).collect())), sorted(r.doc_id for r in mixing.mix_rows(documents, 1, 2).collect())
    few = common.BROADCAST_ROWS
    try:
        common.BROADCAST_ROWS = 0
        assert (sorted(map(str, mixing.mix(documents).collect())), sorted(r.doc_id for r in mixing.mix_rows(documents, 1, 2).collect())) == want
    finally:
        common.BROADCAST_ROWS = few
    assert [mixing.bin_digits(n) for n in (0, 1000, 16**3 << 16, (16**3 << 16) * 2, 5 * 10**10)] == [3, 3, 3, 4, 5]


def test_columns_of_any_name(spark):
    """Names with dots and backticks, and those of the digest, come through all five stages."""
    docs = awkward(spark).selectExpr("*", "'x' AS `a.b`", "1 AS `tick``s`", "2 AS size", "3 AS slot", "4 AS in_slot", "5 AS law")
    want = {r.doc_id: tuple(r) for r in docs.collect()}
    for out in (quality.quality_filter(docs), simhash.drop_near_duplicates(docs), mixing.mix_rows(docs, 1, 1), decontaminate.drop_leaking(docs, spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string"))):
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(tuple(r) == want[r.doc_id] for r in rows)
    out = sharding.shard_rows(docs)
    assert {"a.b", "tick`s", "in_size", "in_in_slot", "in_slot", "in_law", "size", "slot", "law"} <= set(out.columns)
    assert {(r.doc_id, r["a.b"], r["tick`s"], r.in_size, r.in_in_slot, r.in_slot, r.in_law) for r in out.collect()} == {(k, "x", 1, 2, 3, 4, 5) for k in want}


def test_clashing_columns(spark):
    """Columns of the names that stages use inside come through unchanged."""
    docs = awkward(spark).selectExpr("*", "'c' AS _cut", "1 AS _epochs", "'d' AS __domain", "2 AS component_id", "3 AS a", "4 AS root")
    want = {r.doc_id: r for r in docs.collect()}
    for out in (quality.quality_filter(docs), simhash.drop_near_duplicates(docs), mixing.mix_rows(docs, 1, 1), decontaminate.drop_leaking(docs, spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string"))):
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r == want[r.doc_id] for r in rows)


def test_empty_tables(spark):
    docs = awkward(spark, empty=True)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    items = spark.createDataFrame([], "item_id long, text string")
    for df in (
        line_dedup.line_dedup_digest(docs),
        decontaminate.leaks(docs, items),
        decontaminate.leaks(awkward(spark), items),
        quality.quality_measures(docs),
        simhash.near_duplicates(docs),
        sharding.shard_digest(docs),
        html_text.extract(pages),
        mixing.mix(docs),
        url_filter.judge(pages),
        substring.digest(docs),
        licenses.scan(docs),
    ):
        assert df.count() == 0


def test_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([Row(doc_id=i, text=text, lang="en", source="src1") for i in (None, 5, 5, 7)], "doc_id long, text string, lang string, source string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in substring.digest(docs).collect()) == [(0, 40), (5, 0), (5, 0), (7, 40)]
    assert sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect()) == [(0, 5), (5, 5), (5, 5), (7, 5)]
    assert sharding.shard_digest(docs).count() == 4
    assert quality.quality_measures(docs).count() == 4
    assert licenses.scan(docs).count() == 4
    assert line_dedup.line_dedup_digest(docs).count() == 4
    assert mixing.mix(docs, 1, 1, 1).count() == 4
