"""The pipeline against its stages done plainly, one after the other, on a small table."""

import re
from collections import Counter

import corpus_pipeline
import pytest
from corvane.llm import bpe, decontam, secrets, simhash

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage was given and returned, written and read again as the driver does."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        out.append((name, docs, docs := spark.read.parquet(path)))
    return out


def test_order_and_columns(stages):
    assert [n for n, _, _ in stages] == ["toxicity", "near_duplicates", "decontamination", "secrets", "bpe"]
    assert all(after.columns == before.columns for _, before, after in stages[:-1])
    assert len({d.count() for _, d, _ in stages[:-1]}) > 2


def test_each_stage_equals_brute_force(spark, stages):
    rows = {n: ({r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in after.collect()}) for n, before, after in stages}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = rows["toxicity"]
    gone = before.keys() - after.keys()
    known = [i for i in before if i in labels]
    assert sum(labels[i] for i in known if i in gone) >= 0.9 * sum(labels[i] for i in known)
    assert sum(1 - labels[i] for i in known if i in gone) <= 0.01 * sum(1 - labels[i] for i in known)

    before, after = rows["near_duplicates"]
    import numpy as np
    import pyarrow as pa

    ids = sorted(before)
    code, size = simhash.fingerprints(*simhash.utf8(pa.array([before[i].text for i in ids])))
    words = code.view(np.uint64).reshape(-1, 2)
    up = list(range(len(ids)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(ids)):
        apart = np.bitwise_count(words ^ words[a]).sum(axis=1)
        near = (apart <= simhash.K) & (np.minimum(size, size[a]) * 10 >= np.maximum(size, size[a]) * simhash.LEAST_TENTHS)
        for b in np.flatnonzero(near):
            low, high = sorted((root(a), root(int(b))))
            up[high] = low
    assert after.keys() == {ids[i] for i in range(len(ids)) if root(i) == i or size[i] == 0}

    before, after = rows["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = decontam.Windows(items, decontam.WINDOW)
    assert after.keys() == {i for i, r in before.items() if not len(index.matches(*decontam.utf8(pa.array([r.text])))[0])}

    before, after = rows["secrets"]
    assert before.keys() == after.keys()
    for i, r in before.items():
        found = sorted((m.start(), m.end(), n, "") for n, p in secrets.RULES.items() for m in re.finditer(p, r.text, re.ASCII))
        text = secrets.redacted(r.text, found)
        assert after[i].text == text and after[i].n_chars == len(text)

    before, after = rows["bpe"]
    assert {r.doc_id: r.text for r in bpe.decode(stages[-1][2]).collect()} == {i: r.text for i, r in before.items()}
    assert all(r.round_trip for r in after.values())


def test_run_equals_the_stages(spark, stages):
    assert Counter(map(str, corpus_pipeline.run(spark, SF).collect())) == Counter(map(str, stages[-1][2].collect()))


def test_empty_table_and_extra_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, dropped int, leaked int, toxic int, hi long, cell int"
    rows = [(1, "One plain text of some words.", "en", "s", 29, 1, 2, 3, 4, 5), (1, "One plain text of some words.", "en", "s", 29, 1, 2, 3, 4, 5), (None, None, None, None, None, None, None, None, None, None), (2, "", "", "", 0, 0, 0, 0, 0, 0), (3, "word " * 30_000, "en", "s", None, 0, 0, 0, 0, 0)]
    for name, some in (("rows", rows), ("none", [])):
        docs = spark.createDataFrame(some, schema)
        for stage, f in corpus_pipeline.STAGES:
            out = f(spark, docs, SF)
            out.write.parquet(str(tmp_path / name / stage))
            docs = spark.read.parquet(str(tmp_path / name / stage))
        assert docs.count() == len(some)
