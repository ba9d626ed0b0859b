"""The stages of the corpus pipeline on odd input, and the packing query against brute force."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from loomfact.llm import near_copies, packing, quality
from loomfact.llm.tokens import vocabulary

KIND = "doc_id long, text string, lang string, source string, n_chars long, node long, shard string"
GOOD = "A plain and clean text about rivers, hills and the weather of the year number"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    texts = [None, "", " ", GOOD + " 1 " + "and so on for a while " * 30, GOOD + " 1 " + "and so on for a while " * 30, "x" * 300_000]
    texts += [f"{GOOD} {i} " + " ".join(f"word{(i * 7 + k) % 50}" for k in range(40)) for i in range(10, 40)]
    texts += ["key password=abcdefabcdef1234 " + texts[-1][::-1]]
    rows = [(None if i == 8 else i, t, "en", "s", len(t or ""), 1, "a") for i, t in enumerate(texts)]
    rows += [rows[-2], rows[-2]]
    docs = spark.createDataFrame(rows, KIND)
    docs.write.parquet(f"{where}/documents.parquet")
    labels = [(i, int(i % 3 > 0), 0) for i in range(10, 36)] + [(None, 1, 0), (11, None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def test_every_stage_takes_odd_rows_and_keeps_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, folder), name)
        assert docs.columns == [c.split()[0] for c in KIND.split(", ")], name
        assert docs.count() <= before, name
        before = docs.count()
    texts = [r.text for r in docs.collect()]
    assert len(texts) == len(set(texts)) and not any("abcdefabcdef1234" in (t or "") for t in texts)
    pieces = corpus_pipeline.packing(spark, docs, folder).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in docs.collect()}


def test_run_on_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pieces_against_the_library(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id is not null").dropDuplicates(["doc_id"])
    lib = Tokenizer.from_file(vocabulary())
    want = {r.doc_id: [*lib.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    by_doc: dict = {}
    by_window: dict = {}
    for p in packing.pack(docs).collect():
        ids = want[p.doc_id][p.start : p.start + p.length]
        assert bytes(p.ids) == np.array(ids, "<u4").tobytes() and p.doc_tokens == len(want[p.doc_id])
        assert zlib.crc32(bytes(p.ids)) == zlib.crc32(np.array(ids, "<u4").tobytes())
        by_doc.setdefault(p.doc_id, []).append((p.start, p.length))
        by_window.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for i, ids in want.items():
        assert [s for s, _ in sorted(by_doc[i])] == np.cumsum([0, *(n for _, n in sorted(by_doc[i]))])[:-1].tolist()
        assert sum(n for _, n in by_doc[i]) == len(ids)
    for w in by_window.values():
        assert [s for s, _ in sorted(w)] == np.cumsum([0, *(n for _, n in sorted(w))])[:-1].tolist() and sum(n for _, n in w) <= 2048


def test_one_of_each_on_odd_rows(spark):
    words = [f"w{i}" for i in range(60)]
    near = [*words[:30], "other", *words[31:]]
    rows = [(5, " ".join(words)), (3, " ".join(near)), (3, " ".join(near)), (None, " ".join(words)), (9, None), (8, ""), (7, "tiny"), (6, "tiny text")]
    got = near_copies.one_of_each(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int"))
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == [3, 3, 6, 7, 8]
    assert got.columns == ["doc_id", "text", "component_id"] and sum(r.doc_id is None for r in got.collect()) == 1


def test_ordinal_fit_against_plain_gradient_descent():
    """The same likelihood and penalty, minimised by small plain steps over dense arrays, gives the same order and probabilities."""
    rng = np.random.default_rng(4)
    x = (rng.random((400, 12)) < 0.3).astype(float)
    score = x @ np.linspace(-2, 2, 12) + rng.logistic(size=400) * 0.7
    grades = np.digitize(score, [-0.8, 0.6])
    rows = [(np.flatnonzero(r), np.ones(int(r.sum()))) for r in x]
    model = quality.Ordinal.fit(rows, grades)
    scale = quality._telling(rows, grades)[:12]
    z, w, cuts = x * scale, np.zeros(12), np.array([-0.5, 0.5])
    sig = lambda v: 1 / (1 + np.exp(-v))
    for _ in range(6000):
        edge = np.concatenate([[-np.inf], cuts, [np.inf]])
        s = z @ w
        a, b = sig(edge[grades + 1] - s), sig(edge[grades] - s)
        ds = 1 - a - b
        p = np.maximum(a - b, 1e-12)
        step = np.array([np.where(grades == k, -a * (1 - a) / p, 0).sum() + np.where(grades == k + 1, b * (1 - b) / p, 0).sum() for k in range(2)])
        w, cuts = w - 0.2 * (z.T @ ds / 400 + quality.RIDGE * w), cuts - 0.2 * step / 400
    got, want = model.tails(np.array([model.weights[i] @ v for i, v in rows])), sig((z @ w)[:, None] - cuts)
    assert np.abs(got - want).max() < 0.06 and np.corrcoef(got[:, 1], want[:, 1])[0, 1] > 0.995
