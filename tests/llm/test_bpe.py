import base64

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from corvane.llm import bpe
from corvane.llm.arrowtext import utf8
from hypothesis import given, settings
from hypothesis import strategies as st

PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCAB = bpe.Vocabulary.load()
ENC = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.DEFAULT_VOCABULARY, "rb"))}, special_tokens={})


def check(texts, encoder=None):
    encoder = encoder or bpe.Encoder(VOCAB)
    data, offsets = utf8(pa.array(texts, pa.string()))
    ids, first, same = encoder.encode_checked(data, offsets)
    ends = encoder.ends(ids, first, offsets)
    for i, text in enumerate(texts):
        want = ENC.encode_ordinary(text or "")
        assert ids[first[i] : first[i + 1]].tolist() == want, repr(text)
        assert ends[first[i] : first[i + 1]].tolist() == np.cumsum([len(ENC.decode_single_token_bytes(t)) for t in want]).astype(int).tolist()
    assert same.all()


def test_known_texts():
    check(["don't you'll we've 's's x''s 'sx 're're 'l 'v", "  two  spaces \n\n new\n", " ", "", "\n \n x", "a'", "'", " 's", "\t's", "été ß ñ 漢字 123४५ ½", "😀 a b　c ​d", "tabs\t\tand  \t mix ", None, "x" * 500 + " " * 90 + "ab" * 200, "a1b2 3!? ...!", "I'LL'll'"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aAsdlvermt '\n\t é1٣!?-漢😀x"), max_size=40), max_size=6))
def test_any_text(texts):
    check(texts)


def test_cache_is_reused_and_restarts(monkeypatch):
    encoder = bpe.Encoder(VOCAB)
    check(["the same words the same words"] * 3, encoder)
    size = len(encoder.pool)
    check(["words the same"], encoder)
    assert len(encoder.pool) <= size + 1
    monkeypatch.setattr(bpe, "CACHE_SLICES", 1)
    check(["others follow the same"], encoder)


def test_scan_composes():
    rng = np.random.default_rng(0)
    f = rng.integers(0, 256, 1000, dtype=np.uint8)
    got = bpe.scan(f)
    for start in range(4):
        s = start
        for i in range(1000):
            s = (int(f[i]) >> (2 * s)) & 3
            assert (int(got[i]) >> (2 * start)) & 3 == s


def test_documents_and_decoding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    extra = spark.createDataFrame([(-1, None, 1), (-2, "", 2), (None, "it's", 3), (-3, "word " * 40000, 4)], "doc_id long, text string, token_ids int")
    every = docs.select("doc_id", "text").union(extra.select("doc_id", "text")).withColumn("token_ids", docs["doc_id"] * 0)
    out = bpe.encode(every)
    rows = out.collect()
    text = {r.doc_id: r.text for r in every.collect()}
    assert len(rows) == len(text) and all(r.round_trip for r in rows)
    for r in rows:
        assert r.token_ids == (None if text[r.doc_id] is None else ENC.encode_ordinary(text[r.doc_id]))
    assert {r.doc_id: r.text for r in bpe.decode(out).collect()} == text
    assert bpe.encode(every.limit(0)).count() == 0
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [60000])], "doc_id long, token_ids array<int>")).collect()
