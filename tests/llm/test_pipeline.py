"""The stages on a small planted corpus."""

import random
import re
from collections import defaultdict

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 8)))
    text = lambda n: [word() for _ in range(n)]
    rows, labels = [], []
    for i in range(300):
        bad = i % 6 == 0
        rows.append((i, " ".join(text(120) + (["vilexo", "zurfit"] if bad else []))))
        labels.append((i, 0, int(bad)))
    base = text(200)
    near = list(base)
    near[50] = "changed"
    passage = " ".join(text(70))
    rows += [(400, " ".join(base)), (401, " ".join(near)), (402, " ".join(base))]
    rows += [(410 + k, " ".join(text(40)) + "\n" + passage + "\n" + " ".join(text(40))) for k in range(3)]
    rows += [(420, "clean one\npassword=abcdef0123456789 stays " + " ".join(text(30))), (421, None), (422, ""), (430, "vilexo zurfit " + " ".join(text(20)))]
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, dict(rows), passage


def test_every_stage_takes_effect(spark, planted):
    folder, rows, passage = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(corpus_pipeline.stored(stage(spark, kept[-1], folder), "t"))
        assert kept[-1].columns == docs.columns and kept[-1].dtypes == docs.dtypes
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert ids[1] == {i for i in rows if not (i < 300 and i % 6 == 0) and i != 430}
    assert ids[2] == ids[1] - {402}
    lined = {r.doc_id: r for r in kept[2].collect()}
    assert passage in lined[410].text and all(passage not in lined[i].text and len(lined[i].text.split("\n")) == 2 for i in (411, 412))
    assert all((r.text is None and r.n_chars == 0) or r.n_chars == len(r.text) for r in lined.values())
    assert ids[3] == ids[2] - {401}
    assert ids[4] == ids[3]
    last = {r.doc_id: r.text for r in kept[4].collect()}
    assert last[420].startswith("clean one\n[secret] stays")
    assert all(last[i] == rows[i] for i in ids[4] - {411, 412, 420})


def test_run(spark, planted):
    folder, _, _ = planted
    out = corpus_pipeline.run(spark, folder).collect()
    sequences = defaultdict(int)
    for r in out:
        sequences[r.sequence_id] += r.length
    assert all(n == 4096 or n & (n - 1) == 0 for n in sequences.values())
    assert not re.search("abcdef0123456789", str(out[0]))


def test_near_copies_go_by_row(spark, documents):
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(100))
    a, b, c, d, clean = text(), text(), text(), text(), text()
    rows = [(1, a), (1, a), (1, a), (2, b), (5, b + " more"), (5, clean), (None, c), (None, c + " more"), (None, d), (7, d + " more"), (8, None), (8, None), (9, "")]
    got = corpus_pipeline.drop_near_copies(spark, documents(rows), "").collect()
    kept = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in got)
    third = [t for i, t in kept if i == -1]
    assert len(third) == 1 and third[0] in (c, c + " more")
    assert [k for k in kept if k[0] != -1] == sorted([(1, a), (2, b), (5, clean), (7, d + " more"), (8, ""), (8, ""), (9, "")])


def test_columns_with_the_stages_own_names_pass_through(spark, planted):
    from pyspark.sql import functions as F

    folder, _, _ = planted
    own = ["n_lines", "n_dropped", "__t", "__row", "__spans", "__blob", "toxic", "toxicity", "component_id", "row", "rank"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id >= 290")
    for i, name in enumerate(own):
        docs = docs.withColumn(name, F.col("doc_id") * 100 + i)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), "t")
        wrong = " OR ".join(f"`{name}` <> doc_id * 100 + {i}" for i, name in enumerate(own))
        assert docs.where(wrong).count() == 0 and docs.count() > 10 and docs.columns[-len(own) :] == own
