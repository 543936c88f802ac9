import random
import re
import unicodedata
from collections import Counter

import pytest
from corvane.llm import arrowtext as A
from corvane.llm import decontam
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def split(text):
    """[(word, start, end)] by Unicode categories; see test_words."""
    out, open_ = [], False
    for i, c in enumerate(text):
        letter = c in "\u200c\u200d" or c.isascii() and c.isalnum() or not c.isascii() and unicodedata.category(c) in A._LETTERS
        alone = any(a <= ord(c) <= b for a, b in A.SINGLES)
        if letter and open_ and not alone:
            out[-1] = (out[-1][0] + c, out[-1][1], i + 1)
        elif letter:
            out.append((c, i, i + 1))
        open_ = letter and not alone
    return out


def lower(text):
    return "".join(low if len(low := c.lower()) == 1 and len(low.encode()) == len(c.encode()) and ord(c) < 2048 else c for c in text)


def canonical(text, reading):
    """[(template word, value, is slot, number of its first word)] in one of the three readings, word by word."""
    words = split(text)
    low = [lower(w) for w, _, _ in words]
    if reading == 0:
        return [(w, w, False, i) for i, w in enumerate(low)]
    upper = lambda c: unicodedata.category(c) in ("Lu", "Lt")
    small = lambda c: unicodedata.category(c) == "Ll"
    digit = [bool(re.search("[0-9]", w)) for w in low]
    number = [d or w in decontam.NUMBERS for d, w in zip(digit, low)]
    capitals = [len(w) > 1 and upper(w[0]) and upper(w[1]) and not any(map(small, w)) and not d for (w, _, _), d in zip(words, digit)]
    out = []
    for i, (w, start, end) in enumerate(words):
        gap = text[words[i - 1][2] : start] if i else None
        begins = gap is None or bool(re.search(r'[.!?:;\n\r"|]', gap))
        alone = capitals[i] and not (i and capitals[i - 1]) and not (i + 1 < len(words) and capitals[i + 1])
        name = (len(w) > 1 and upper(w[0]) and small(w[1]) or alone) and not number[i]
        may = name
        name = name and (reading == 2 or not begins)
        value, kind = low[i], None
        if number[i]:
            value, kind = str(decontam.NUMBERS.get(low[i], low[i])), "NUMBER"
        elif name:
            kind = "NAME"
        elif low[i] in decontam.UNITS and i and number[i - 1] and not may:
            kind = "UNIT"
        spelled = kind == "NUMBER" and not digit[i]
        last = out[-1] if out else None
        if i and kind == "NUMBER" and number[i - 1] and (gap in (",", ".") and digit[i] and digit[i - 1] or gap in (" ", "-") and low[i] in decontam.NUMBERS and low[i - 1] in decontam.NUMBERS):
            out[-1] = (last[0], (*last[1], value), True, last[3])
        elif kind == "NAME" and last and last[0] == "NAME" and gap == " ":
            out[-1] = (last[0], (*last[1], value), True, last[3])
        else:
            out.append((kind or low[i], (value,), kind is not None, i))
    return out


def signs(text):
    words = split(text)
    return re.sub(r"[ \t\n\r\x0b\x0c]", "", lower(text[words[0][1] : words[-1][2]]))


def brute(docs, items, window=decontam.WINDOW):
    """Every window of every reading of a document against those of the items."""
    index = {}
    for item, text in set(items):
        for reading in range(3):
            words = canonical(text, reading)
            size = min(window, len(words))
            if size < (decontam.LEAST if reading else decontam.SHORT):
                continue
            for i in range(len(words) - size + 1):
                own = words[i : i + size]
                if reading and sum(not s for _, _, s, _ in own) < decontam.PLAIN:
                    continue
                extra = signs(text) if size < decontam.LEAST else None
                index.setdefault((reading > 0, extra, tuple(w for w, _, _, _ in own)), []).append((item, own))
    sizes = {len(k[2]) for k in index}
    found = {}
    for doc, text in set(docs):
        for reading in range(3):
            words, whole = canonical(text, reading), split(text)
            for size in sizes:
                for i in range(len(words) - size + 1):
                    own = words[i : i + size]
                    extra = signs(text[whole[i][1] : whole[i + size - 1][2]]) if size < decontam.LEAST and not reading else None
                    for item, theirs in index.get((reading > 0, extra, tuple(w for w, _, _, _ in own)), []):
                        pairs = {(a[1], b[1]) for a, b in zip(theirs, own) if b[2]}
                        if len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
                            place = doc, text, item, own[0][3]
                            found[place] = found.get(place, False) or [a[1] for a in theirs] == [b[1] for b in own]
    n, same = Counter(), Counter()
    for (doc, _, item, _), equal in found.items():
        n[doc, item] += 1
        same[doc, item] += equal
    return {(d, i, m, same[d, i]) for (d, i), m in n.items()}


BENCH = [
    (1, "A train leaves Boston at 9 with 40 people and meets Anna after 9 miles of track in the open country, says Anna."),
    (2, "too short"),
    (3, "what is the capital city here"),
    (4, None),
    (None, "a text without an id that is long enough to be a window of its own in any case"),
    (1, "A train leaves Boston at 9 with 40 people and meets Anna after 9 miles of track in the open country, says Anna."),
    (5, "Tom buys 12 apples at 3 dollars each, how much?"),
    (6, "12 + 7 * 3 = ?"),
    (7, "John Smith met Mary Jones in Paris"),
    (8, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16"),
    (9, "Мария купила 5 яблок и отдала Ивану два из них вчера"),
    (10, "Why did NASA send 2,500 units of it up there in twenty-five days"),
    (11, "我们昨天去了东京然后又回到北京了吗"),
]
DOCS = [
    (10, "Once. A train leaves Paris at 7 with 55 people and meets Karl after 7 miles of track in the open country, says Karl."),
    (11, "A train leaves Paris at 7 with 55 people and meets Karl after 8 miles of track in the open country, says Otto."),
    (12, "x " * 30000 + BENCH[0][1]),
    (13, None),
    (14, ""),
    (15, "so what is the capital city here then"),
    (15, "so what is the capital city here then"),
    (15, "what is the capital city here? Another text of that id."),
    (None, BENCH[0][1]),
    (16, "nothing of this kind is in here and it has well over thirteen words in it"),
    (17, "Nora buys twelve apples at 4 dollars each, how much?"),
    (18, "He said that Nora Lee buys 15 apples at twenty two dollars each, how much? And so on."),
    (19, "Sum: 12+7 * 3 = 33"),
    (20, "The 12, 7 and 3 are numbers; 12 7 3."),
    (21, "Yesterday John Smith met Mary Jones in Paris again"),
    (22, "Yesterday Karl met Otto in Rome again"),
    (23, "0 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17"),
    (24, "Ольга купила 7 яблок и отдала Петру два из них вчера, да"),
    (25, "Why did ESA send 12.5 units of it up there in 9 days"),
    (26, "A TRAIN LEAVES BOSTON AT 9 WITH 40 PEOPLE AND MEETS ANNA AFTER 9 MILES OF TRACK"),
    (27, "他说我们昨天去了东京然后又回到北京了吗？"),
    (28, "Why did I send 12 units to the place up there in nine days of rain"),
]


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_small_cases_both_ways(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("leaked", F.lit("x"))
    bench = spark.createDataFrame(BENCH, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = brute([(d, t) for d, t in DOCS if d is not None and t], [(i, t) for i, t in BENCH if i is not None and t])
    assert {(d, i) for d, i, *_ in want} == {(10, 1), (11, 1), (12, 1), (15, 3), (17, 5), (18, 5), (19, 6), (21, 7), (23, 8), (24, 9), (25, 10), (26, 1), (27, 11)}
    n = {d: n for d, i, n, _ in want}
    assert n[10] > n[11]  # one 9 can't be both 7 and 8 in one window
    assert rows(decontam.leaks(docs, bench)) == want
    assert rows(decontam.leaks(docs, bench, broadcast_words=0)) == want
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 13, 14, 16, 20, 22, 28]
    assert decontam.leaks(docs.limit(0), bench).count() == 0
    for words in (decontam.BROADCAST_WORDS, -1):
        assert decontam.leaks(docs, bench.limit(0), broadcast_words=words).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    some = ["Tom", "Ann", "the", "red", "5", "seven", "twenty", "km", "1,5", "NASA", "He", "été", "Éva", "中", "went", "and", "a.", "b?", "of", "to"]
    text = lambda n: " ".join(rng.choice(some) for _ in range(n))
    items = [(i, text(rng.randrange(1, 12))) for i in range(30)]
    docs = [(i, text(rng.randrange(0, 6)) + rng.choice([" ", ". ", ""]) + (rng.choice(items)[1].replace("Tom", "Ann") if i % 2 else "") + " " + text(rng.randrange(0, 40))) for i in range(60)]
    want = brute(docs, items, 6)
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert want and rows(decontam.leaks(*frames, 6)) == want
    assert rows(decontam.leaks(*frames, 6, broadcast_words=0)) == want


def test_documents_without_words(spark):
    docs = spark.createDataFrame([(1, ""), (2, "?! --"), (3, "\n"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "12 + 7 * 3 = ?"), (2, ""), (3, "?")], "item_id long, text string")
    for words in (decontam.BROADCAST_WORDS, 0):
        assert decontam.leaks(docs, items, broadcast_words=words).count() == 0
        assert decontam.clean(docs, items).count() == 4


def test_tables(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert want and rows(decontam.leaks(docs, bench)) == want
