"""Page text, archives, search and toxicity."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flockwise.llm import html_mincut, maxscore, toxicity, warc
from flockwise.llm.common import table

PAGES = "page_id long, url string, html string"


def test_main_text_of_a_page(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header class="site-header"><h1>Brand</h1><form>Search <input></form></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
    <div class="cookie-notice"><p>We use cookies. Accept them all, please, for a better page.</p></div><!-- <p>no</p> -->
    <article><h1>A &lt;title&gt;</h1><p>First   paragraph,<br>with a <a href="x">link</a>.</p><div class="ad">Buy now.</div><p>Second &amp; last.
    </article><aside><p>Related: other things to read, at some length, with commas.</p></aside>
    <section id="comments"><p>I think this is a long comment by a reader. It goes on and on.</p></section><footer>&copy; 2020</footer></body></html>"""
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<p>just text, that is all there is.</p>"), (4, "u", "<a" * 2000), (1, "u", page), (5, "u", "<p>x" * 20_000)]
    got = html_mincut.extract(spark.createDataFrame(rows, PAGES).withColumn("text", F.lit(1)))
    by = {}
    for r in got.collect():
        by.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    assert by[1] == ["A <title>\nFirst paragraph, with a link.\nSecond & last."] * 2
    assert by[2] == by[3] == [""] and by[None] == ["just text, that is all there is."]
    assert html_mincut.extract(spark.createDataFrame([], PAGES)).count() == 0


ARTICLE = "<h1>A heading.</h1>" + "".join(f"<p>Sentence {i} of the story goes on for quite a while, with commas, and then it ends.</p>" for i in range(6))
NOISE = """<div class="sidebar"><p>Other stories of this week, picked for you by us.</p></div><div class="comments"><p>I think this is a long comment by a reader. It goes on.</p></div>"""


@pytest.mark.parametrize("page", [
    "<body class='has-sidebar'><article>{a}</article>{n}</body>",
    "<html class='no-ads'><body><div>{a}</div>{n}</body>",
    "<main class='search-results'>{a}</main>{n}",
    "<article class='post hidden-ads'>{a}</article>{n}",
    "<article class='post hidden wide'>{a}</article>{n}",
    "<div id='content-header-wrap'><article>{a}</article></div>{n}",
    "<div class='layout sidebar-right'><div>{a}</div>{n}</div>",
    "<form id='aspnetForm'><div>{a}</div>{n}</form>",
    "<form><div class='has-sidebar'><main>{a}</main>{n}</div></form>",
])
def test_words_of_wide_ancestors_do_not_cost_the_article(page):
    want = html_mincut.main_text(f"<article>{ARTICLE}</article>").split("\n")
    assert len(want) == 7 and html_mincut.main_text(page.format(a=ARTICLE, n=NOISE)).split("\n") == want


@pytest.mark.parametrize("page", [
    "<body><select><option>A<option>B<option>C</select>{a}</body>",
    "<body><select><option>A<option>B</option></select>{a}</body>",
    "<body><datalist><option value=1>A<option value=2>B</datalist>{a}</body>",
    "<body><div><select><option>A<option>B</div>{a}</body>",
    "<body><select><option>A<select><option>B</select>{a}</body>",
    "<body><iframe src=x>{a}</body>",
    "<body><iframe src=x>{a}<iframe src=y></iframe></body>",
    "<body><div><button>Go</div><p></p>{a}</body>",
    "<body><object data=x><param name=y>{a}</body>",
    "<body><object><object></object>{a}</body>",
    "<body><svg><title>T</title><path>{a}</body>",
    "<html><head><title>T</title><meta charset=utf-8>{a}",
    "<head><title>T</title><noscript><style>p{{}}</style></noscript><select><option>A<option>B</select>{a}",
    "<body><template><div>no</div></template><noscript><p>No script. Please turn it on, it is needed here.</p></noscript>{a}</body>",
    "<body><button>One <b>word</b></button><button>Two</button>{a}</body>",
])
def test_silent_elements_end_where_their_text_ends(page):
    article = f"<article>{ARTICLE}</article>"
    assert html_mincut.main_text(page.format(a=article)) == html_mincut.main_text(article) != ""


def test_text_ends_a_head():
    assert html_mincut.main_text("<head><title>T</title>Plain text, of a page that has no other tags at all, to the end.") == "Plain text, of a page that has no other tags at all, to the end."


def test_more_comments_than_article_stay_out():
    comment = "".join(f"<p>I think this is comment {i}, long and by a reader. It goes on and on.</p>" for i in range(30))
    got = html_mincut.main_text(f"<article>{ARTICLE}</article><section id='comments'>{comment}</section>")
    assert "Sentence 5" in got and "comment" not in got


def test_minimum_cut_is_least():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randrange(1, 8)
        costs = tuple(rng.randrange(-9, 10) for _ in range(n))
        edges = tuple((a, b, rng.randrange(1, 6)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5)
        price = lambda s, costs=costs, edges=edges: sum(c for c, x in zip(costs, s, strict=True) if c > 0 and not x) - sum(c for c, x in zip(costs, s, strict=True) if c < 0 and x) + sum(w for a, b, w in edges if s[a] != s[b])
        best = min(price([bool(k >> i & 1) for i in range(n)]) for k in range(2**n))
        assert price(html_mincut.minimum_cut(costs, edges)) == best


def test_archives_round_trip(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>{i % 5}</p>" * (i % 5 + 1)) for i in range(30)] + [(40, None, None), (41, "a\r\nb", ""), (42, "u", "é🙂"), (None, "u", "<p>0</p>"), (43, "u", "z" * 300_000), (-7, "u", "neg")]
    pages = spark.createDataFrame(rows, PAGES).repartition(3).withColumn("sha", F.lit(1))
    index = warc.write_archives(pages, str(tmp_path), min_revisit_bytes=4)
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -(2**63)), i if i is not None else -(2**63))
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        revisit = len(data) >= 4 and i != last[h or ""]
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", last[h or ""] if revisit else None))
    got = warc.read_records(index, gap=10, most=500).collect()
    assert sorted(map(repr, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(repr, want))
    assert {r.payload.decode() for r in got if r.page_id == 42} == {"é🙂"}
    some = warc.read_records(index.where("page_id in (3, 17, 43)")).collect()
    assert sorted(r.page_id for r in some) == [3, 17, 43]
    assert warc.read_records(warc.write_archives(spark.createDataFrame([], PAGES), str(tmp_path))).count() == 0
    for i in (0, 5, -1, 2**63 - 1, -(2**63), None):
        assert warc.page_of(warc.record_id(i)) == i


@pytest.mark.parametrize("spread", ["even", "sparse", "huge"])
def test_top_k_is_exact(spark, spread):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 12))
    x = {"even": x, "sparse": np.where(rng.random(x.shape) < 0.8, 0, x), "huge": x * 1e6}[spread]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(300 + i, [float(v) for v in x[7]]) for i in range(20)]
    rows += [(400, None), (401, [float("nan")] * 12), (402, [1.0, None]), (403, [float("inf")] * 12), (405, [2.0]), (410, []), (None, [1.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumn("score", F.lit(1))
    got = {}
    for r in maxscore.top_k(df, df.where("vec_id % 10 = 0"), k=5, shard=32, block=8).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    fine = [(i, [int(np.floor(256 * v)) for v in r]) for i, r in rows if i is not None and r is not None and all(v is not None and np.isfinite(v) for v in r)]
    for i, q in fine:
        if i % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in fine if j != i)[:5]
            assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    none = df.limit(0)
    assert maxscore.top_k(none, none, k=5).count() == 0
    assert maxscore.top_k(df.where("vec_id = 0"), df.where("vec_id = 0"), k=5).count() == 0


def test_noisy_words_are_restored():
    counts = {}
    text = " ".join(["stupid", "loser", "idiot", "worthless", "the", "less", "one", "on"] * 50)
    batch = __import__("pyarrow").record_batch({"t": [text]})
    for out in toxicity._trigram_counts(iter([batch])):
        counts = dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True))
    model = toxicity.CharModel(counts)
    for noisy, clean in {"st0pid": "stopid", "l0ser": "loser", "1d1ot": "idiot", "looooser": "loser", "w.o.r.t.h.l.e.s.s": "worthless", "stuuupid": "stupid", "worthle$$": "worthless"}.items():
        if noisy != "st0pid":
            assert toxicity.restore(noisy, model) == clean
    assert toxicity.SPACED.findall("you s t u p i d one") == ["s t u p i d"]


def test_spaced_doubled_and_cut_words_are_restored():
    import pyarrow as pa

    text = " ".join(["stupid", "loser", "idiot", "fag", "the", "less", "one", "on", "of", "all", "it", "is"] * 50)
    counts = {}
    for out in toxicity._trigram_counts(iter([pa.record_batch({"t": [text]})])):
        counts = dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True))
    restorer = toxicity.Restorer(toxicity.CharModel(counts))
    noisy = {"i d ! o t": "idiot", "s t u p ! d": "stupid", "i  d  i  o  t": "idiot", "i/d/i/o/t": "idiot", "f a g": "fag", "i d - i . o  t": "idiot", "id iot": "idiot", "stu pid.": "stupid", "iddiiott": "idiot", "stuuppiidd": "stupid"}
    texts = [f"the one {n} of it" for n in noisy] + ["", "it is all of the one", "the"]
    names, codes, ends = restorer.words(pa.array(texts))
    assert len(ends) == len(texts) + 1 and ends[-1] == len(codes)
    words = [" ".join(restorer.value(names[c]) for c in codes[ends[i] : ends[i + 1]]).split() for i in range(len(texts))]
    for clean, got in zip(noisy.values(), words, strict=False):
        assert clean in got, (clean, got)
    assert words[len(noisy)] == [] and not {"idiot", "stupid", "fag"} & set(words[len(noisy) + 1]) and words[-1] == ["the"]


def test_toxicity_learns_without_held_out_labels(spark, documents):
    rng = random.Random(6)
    plain = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows, labels = [], []
    for i in range(500):
        bad = i % 5 == 0
        text = [rng.choice(plain) for _ in range(40)] + (rng.sample(["gromblin", "fazzit", "snorkle"], 2) if bad else [])
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    rows += [(600, "gr0mblin f4zzit " + " ".join(rng.sample(plain, 20))), (601, "g r o m b l i n fazzzzit " + " ".join(rng.sample(plain, 20))), (602, None), (603, ""), (None, "fazzit gromblin")]
    docs = documents(rows).withColumn("toxicity", F.lit("clash"))
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].toxic == (i % 5 == 0) for i in range(500))
    assert got[600].toxic == got[601].toxic == got[None].toxic == 1 and got[602].toxic == got[603].toxic == 0
    assert all(0 <= r.toxicity <= 1 for r in got.values())
    # labels of the held-out share have no influence
    other = known.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.toxicity for r in toxicity.score(docs, toxicity.fit(docs, other)).collect()}
    assert again == {i: r.toxicity for i, r in got.items()}
    none = toxicity.fit(docs, known.limit(0))
    assert {r.toxic for r in toxicity.score(docs, none).collect()} == {0}
    assert toxicity.score(documents([]), model).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    scored = toxicity.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), toxicity.fit(docs, labels)).where(toxicity.held_out())
    met = scored.select("doc_id", "toxicity").join(labels, "doc_id").toPandas()
    rank, bad = met.toxicity.rank(), met.toxic == 1
    auc = (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    assert auc > 0.75
