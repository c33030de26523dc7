"""The pipeline against its stages done by hand, and on odd rows."""

import re

import numpy as np

import __spark_entry__
import corpus_pipeline
from weftline.llm import quality, secrets, simhash
from weftline.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    assert [k for k, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
    rows = docs.collect()
    model = quality.fit(docs, table(spark, SF, "labels"))
    features = quality.Features()
    p = model.probabilities(np.array([model.position(features.of(r.text)) for r in rows]))[:, -1]
    left = sorted((r for r, x in zip(rows, p, strict=True) if x >= 0.5), key=lambda r: r.doc_id)
    fps = [simhash.fingerprint(r.text) for r in left]
    seen, kept = [], []
    for r, f in zip(left, fps, strict=True):  # by growing doc_id: a group's first document is its smallest
        near = [g for g in seen if any(bin(f ^ x).count("1") <= 3 for x in g)]
        group = {f}.union(*near)
        seen = [g for g in seen if g not in near] + [group]
        if not near:
            kept.append(r)
    leaks = [" ".join(b.text.lower().split()) for b in table(spark, SF, "benchmark").collect()]
    kept = [r for r in kept if not any(leak in " ".join(r.text.lower().split()) for leak in leaks)]
    want = {}
    for r in kept:
        text = secrets.HEX and r.text
        for a, b in reversed(_merged(text)):
            text = text[:a] + "[SECRET]" + text[b:]
        want[r.doc_id] = (r.source, len(re.findall("[^\x20\x09-\x0d]+", text)))
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: (r.source, r["size"]) for r in got} == want
    assert all(r.taken <= 3 * r["size"] for r in got)
    __spark_entry__.queries()["pipeline"]


def _merged(text):
    spans = [(m.start(), m.end()) for m in re.finditer(secrets.ASSIGN.replace("(?i)", ""), text, re.I | re.A) if len(m[1]) >= 6]
    spans += [(m.start(), m.end()) for p in (secrets.ACCESS, secrets.HEX) for m in re.finditer(p, text)]
    out = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "same text here", "en", "a", 14), (3, "same text here", "en", "a", 14), (None, "same text here", "en", "b", 14), (4, "token=abcdefgh and so on", None, None, 24)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _row int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
    got = {r.doc_id: r.text for r in now.collect()}
    assert set(got) == {1, 3, 4} and got[4] == "[SECRET] and so on"
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 3
