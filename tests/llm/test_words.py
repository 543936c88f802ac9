import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from corvane.llm import arrowtext as A
from hypothesis import given, settings
from hypothesis import strategies as st

ODD = "aZ09 \n.,-_’'“”—…·éÉßñΩωЖжİıἈ中文字かなカナー。，、！ไทย  　​‍😀𝒜𠀀½٣́٪€฿"


def single(c):
    return any(a <= ord(c) <= b for a, b in A.SINGLES)


def brute(text, solid, singles=True):
    def kind(c):
        if solid:
            return not any(a <= ord(c) <= b for a, b in A.SPACES)
        return c in "‌‍" or (c.isascii() and c.isalnum()) or not c.isascii() and unicodedata.category(c) in A._LETTERS

    out, word = [], ""
    for c in text:
        if not kind(c):
            word = ""
        elif single(c) and singles:
            out.append(c)
            word = ""
        elif word:
            word += c
            out[-1] = word
        else:
            word = c
            out.append(word)
    return out


def got(texts, solid, singles=True):
    data, offsets = A.utf8(pa.array(texts, pa.string()))
    w = A.Words(data, offsets, solid, singles)
    words = [data[a:b].tobytes().decode() for a, b in zip(w.start, w.end)]
    return [words[a:b] for a, b in zip(w.first, w.first[1:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(ODD), st.characters(exclude_categories=["Cs"])), max_size=25), max_size=6), st.booleans(), st.booleans())
def test_words_equal_brute_force(texts, solid, singles):
    assert got(texts, solid, singles) == [brute(t, solid, singles) for t in texts]


def test_words_of_many_scripts():
    assert got(["l’été — “déjà” vu…", "我们去。东京", "ΑΒΓ жизнь", ""], False) == [["l", "été", "déjà", "vu"], ["我", "们", "去", "东", "京"], ["ΑΒΓ", "жизнь"], []]
    assert got(["我们a b。c　d."], True) == [["我", "们", "a", "b。c", "d."]]


def test_fold():
    text = "ÀÉÑØ×ΑΣΩЖЯԱİ ÿ中Z"
    data, _ = A.utf8(pa.array([text]))
    assert A.fold(data).tobytes().decode() == "".join(low if len(low := c.lower()) == 1 and len(low.encode()) == len(c.encode()) else c for c in text)
    assert not len(A.fold(np.zeros(0, np.uint8)))


def test_texts_without_spaces_have_repeats_and_near_copies(spark):
    from corvane.llm import minhash, simhash, suffixes

    rng = np.random.default_rng(4)
    text = lambda n: "".join(chr(0x4E00 + x) for x in rng.integers(0, 3000, n))
    a, shared = text(400), text(60)
    rows = [(1, a), (2, a[:200] + "。" + a[201:]), (3, text(80) + shared + text(30)), (4, text(400)), (5, text(10) + shared)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {r.doc_id: r.group_id for r in simhash.groups(docs).collect()}
    assert groups == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    found = {tuple(r) for r in suffixes.repeated(docs).where("doc_id in (3, 5)").collect()}
    assert found == {(3, 80, 140, False), (5, 10, 70, True)}
    prints = {r.doc_id: r for r in minhash.fingerprints(docs).collect()}
    assert len(prints) == 5


def test_repeats_without_spaces_equal_sql(spark):
    import duckdb
    from corvane.llm import queries, suffixes

    line = "".join(ODD[i % len(ODD)] for i in range(0, 45 * len(ODD), 11))
    rows = [(i, f"{i}— {line}　x{i}") for i in range(4)] + [(9, line * 2)]
    documents = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    con = duckdb.connect()
    con.register("documents", documents)
    want = sorted(con.execute(queries.ORACLE_SQL["op2_suffixes"]).fetchall())
    names = [d[0] for d in con.description]
    got_ = sorted(tuple(r) for r in suffixes.repeated(spark.createDataFrame(rows, "doc_id long, text string")).select(*names).collect())
    assert want and got_ == want
