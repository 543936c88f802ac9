import numpy as np
import pyarrow as pa
import pytest
from corvane.llm import quality as Q

SCHEMA = "doc_id long, text string, lang string, source string, score string, good int"
SF = "/root/testdata/sf0.1"
TEXTS = ["One two, two three. Four!", "", "A | B\nA | B\nx", "!!! ***", "été 12 " * 50]


def machine(seed=2):
    m, rng = Q.Machine(seed), np.random.default_rng(seed)
    m.weight, m.bias = rng.normal(0, 1, m.weight.shape).astype(np.float32), 0.3
    return m


def inputs(texts):
    return Q.features(pa.array(texts, pa.string()), [pa.array(["en"] * len(texts)), pa.array([None] * len(texts), pa.string())])


def test_linear_time_scores_equal_all_pairs():
    m, f = machine(), inputs(TEXTS)
    for i, got in enumerate(m.scores(f)):
        at = range(f.first[i], f.first[i + 1])
        x, w, v = f.value[at].astype(float), m.weight[f.index[at]].astype(float), m.factor[f.index[at]].astype(float)
        pairs = sum(v[a] @ v[b] * x[a] * x[b] for a in range(len(x)) for b in range(a))
        assert got == pytest.approx(0.3 + w @ x + pairs, abs=1e-3)


def test_gradients_lower_the_loss():
    f, label = inputs(TEXTS), np.array([1, 0, 0, 0, 1], np.float32)
    m = Q.Machine()
    loss = lambda: np.mean(np.logaddexp(0, np.where(label == 1, -1, 1) * m.scores(f)))
    before = loss()
    for _ in range(5):
        m.train(f, label, np.random.default_rng(0))
    assert loss() < before / 2


def test_structure_counts():
    stats = inputs(TEXTS)
    own = {i: stats.value[stats.first[i] : stats.first[i + 1]] for i in range(len(TEXTS))}
    rows = {i: stats.index[stats.first[i] : stats.first[i + 1]] for i in range(len(TEXTS))}
    value = lambda i, k: float(own[i][rows[i] == (1 << Q.BITS) + k][0])
    assert value(0, 0) == pytest.approx(2 / 18, abs=1e-6) and value(2, 9) == pytest.approx(1 / 3, abs=1e-6) and value(4, 1) > 0
    assert value(1, 0) == 0


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    used = {r[1] for r in Q.sample(docs, labels, "quality", 400, ["text"])}
    got = [(truth[r.doc_id], r.good, r.score) for r in Q.score(docs, labels, 400).collect() if r.doc_id in truth and r.doc_id not in used]
    good, bad = [g for y, g, _ in got if y == 1], [g for y, g, _ in got if y == 0]
    assert len(good) > 500 and np.mean(good) > 0.98
    assert not bad or np.mean(bad) < 0.2


def test_rows_of_every_kind(spark):
    rows = [(i, "plain words in a row. " * 3 + str(i) if i % 2 else "BAD!! TEXT!! " * 5 + str(i), "en", "s", None, 1) for i in range(60)]
    odd = [(100, None, "en", "s", None, 1), (101, "", None, None, None, 1), (None, "x", "en", "s", None, 1), (1, rows[1][1], "en", "s", None, 1), (102, "long " * 100_000, "en", "s", None, 1)]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (5, None, 0), (7, 9, 0)], "doc_id long, quality int, toxic int")
    got = Q.score(docs, labels).collect()
    assert len(got) == 65
    by = {r.doc_id: r for r in got}
    assert by[100].score is None and not by[100].good and by[101].score is not None and by[102].score is not None
    assert all(by[i].good == bool(i % 2) for i in range(60))
    assert sum(r.doc_id == 1 for r in got) == 2 and None in by
    none = Q.score(docs, labels.where("quality = 1")).collect()
    assert all(r.score is None and not r.good for r in none)
    assert Q.score(docs.limit(0), labels).count() == 0
    assert Q.score(docs.select("doc_id", "text"), labels).count() == 65
