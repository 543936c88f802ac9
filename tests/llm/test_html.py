import math
import random
import re
import statistics
from collections import Counter
from html.parser import HTMLParser

import pytest
from corvane.llm import html as X

SCHEMA = "page_id long, html string, text string, n_paths int"
NAV = "<nav><ul>" + "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(12)) + "</ul></nav>"
BODY = "".join(f"<p>Sentence number {i}, which is long enough. It has <b>marks</b>; and more, of course.</p>" for i in range(5))


def test_content_of_a_plain_page():
    text, paths, good = X.content(f"<html><head><style>p{{x:y}}</style><script>var a = '</p>';</script></head><body>{NAV}<article>{BODY}</article><!-- <p>no, not this, at all.</p> --></body></html>")
    assert text.split("\n") == [f"Sentence number {i}, which is long enough. It has marks; and more, of course." for i in range(5)]
    assert (paths, good) == (3, 2)


def brute_smoothed(value, used, parent):
    def ancestors(i):
        out = [i]
        while parent[out[-1]] >= 0:
            out.append(parent[out[-1]])
        return out

    def distance(i, j):
        a, b = ancestors(i), ancestors(j)
        common = len(set(a) & set(b))
        return len(a) + len(b) - 2 * common

    out = []
    for i in range(len(parent)):
        weights = [(X.DECAY ** distance(i, j), value[j]) for j in range(len(parent)) if used[j]]
        total = sum(w for w, _ in weights)
        out.append(sum(w * v for w, v in weights) / total if total else 0.0)
    return out


def test_smoothing_equals_all_pairs():
    rng = random.Random(5)
    for n in (1, 2, 9, 40):
        parent = [-1] + [rng.randrange(i) for i in range(1, n)]
        value, used = [rng.random() for _ in range(n)], [rng.random() < 0.7 for _ in range(n)]
        assert X.smoothed(value, used, parent) == pytest.approx(brute_smoothed(value, used, parent))


def paths(source):
    page = X.Page(source)
    return [text.strip() for _, text, _ in page.nodes]


def test_broken_markup():
    assert paths("a < b & c <b>d") == ["a < b & c", "d"]
    assert paths('<p title="x > y">one<p>two<br>three</p></div>four') == ["one", "two", "three", "four"]
    assert paths('<a href="lone>x</a> y <i>z</i>') == ["x", "y", "z"]
    assert paths("<!-- never closed <p>x") == [] and paths("<script>x") == [] and paths("<p") == []
    assert paths("<SCRIPT>a</Script >b") == ["b"]
    assert X.content("") == ("", 0, 0) and X.content("<div> </div>") == ("", 0, 0)
    assert X.content("just text")[0] == "just text" and X.content("x &amp; y.")[0] == "x & y."
    # an unclosed b ends with the next paragraph: both paragraphs share a path
    page = X.Page("<div><p><b>x<p>y</div>")
    assert page.parent == [-1, 0, 1, 2] and [p for p, _, _ in page.nodes] == [3, 2]


def test_deep_and_long_pages_take_linear_time():
    deep = "<div>" * 50_000 + "Deep text, at last." + "</div>" * 50_000
    assert X.content(deep)[0] == "Deep text, at last."
    assert X.content('<a href="' * 50_000 + "x")[0] == ""
    assert len(X.content("<p>word, </p>" * 50_000)[0].split("\n")) == 50_000


def test_unmatched_tags_take_linear_time():
    import time

    def seconds(source):
        start = time.process_time()
        X.content(source)
        return time.process_time() - start

    for unit in ("<b></i>", "<h1>", "<b></p>x", "<p><button><i>", "</div>", "<li></ul>"):
        assert seconds(unit * 60_000) < 5, unit
    assert seconds("<p><button>" + "<i>" * 60_000 + "<h1>" * 60_000) < 5


class Naive(HTMLParser):
    """Text nodes by the names of their path, with lists that are looked through."""

    def __init__(self, source):
        super().__init__(convert_charrefs=False)
        self.names, self.nodes, self.text, self.broken, self.raw = [], [], "", True, None
        self.feed(source)
        self.close()
        self.flush()

    def flush(self):
        if self.text and not self.text.isspace():
            self.nodes.append((tuple(self.names), X.html.unescape(self.text), self.broken))
            self.broken = False
        self.text = ""

    def handle_starttag(self, tag, attrs):
        self.flush()
        self.broken |= tag not in X._INLINE
        if self.raw or tag in X._VOID:
            return
        if tag in X._RAW:
            self.raw = tag
            return
        shut, within = ({"p"}, X._HOLDS) if tag in X._BLOCK else X._CLOSES.get(tag, ((), ()))
        for i in reversed(range(len(self.names))):
            if self.names[i] in shut:
                del self.names[i:]
                break
            if self.names[i] in within:
                break
        self.names.append(tag)

    def handle_endtag(self, tag):
        self.flush()
        self.broken |= tag not in X._INLINE
        if self.raw == tag:
            self.raw = None
        elif tag in self.names:
            while self.names.pop() != tag:
                pass

    def handle_comment(self, data):
        self.flush()

    handle_decl = unknown_decl = handle_pi = handle_comment

    def handle_data(self, data):
        self.text += "" if self.raw else data

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def brute_content(source):
    """The same by its definition: all pairs of paths, statistics one character at a time."""
    nodes = Naive(source).nodes
    if not nodes:
        return "", 0, 0
    chars, marks = {}, {}
    for path, text, _ in nodes:
        chars.setdefault(path, []).append(len(" ".join(text.split())))
        marks.setdefault(path, []).append(sum(c in ".,;:!?…。、，；：！？«»„“”" for c in text))

    def apart(a, b):
        common = 0
        while common < min(len(a), len(b)) and a[common] == b[common]:
            common += 1
        return len(a) + len(b) - 2 * common

    def smooth(of, at):
        weight = {p: X.DECAY ** apart(p, at) for p in of}
        return sum(weight[p] * statistics.fmean(of[p]) for p in of) / sum(weight.values())

    every = {path[:i] for path in chars for i in range(len(path) + 1)}
    plain = not any(map(any, marks.values()))
    fused = {p: math.sqrt(smooth(chars, p) * (1 if plain else smooth(marks, p))) for p in every}
    deviation = statistics.pstdev([fused[p] for p in chars for n in chars[p] for _ in range(n)])
    least = min(X.LAMBDA * deviation, max(fused[p] for p in chars)) * (1 - 1e-12)
    good = {p for p in chars if fused[p] >= least}

    def inside(path):
        return path in good or bool(path) and path[-1] in X._INLINE and inside(path[:-1])

    lines, broken = [[]], False
    for path, text, first in nodes:
        broken |= first
        if inside(path):
            if broken:
                lines.append([])
            lines[-1].append(re.sub(r"\s+", " ", text))
            broken = False
    lines = [re.sub(r"\s+", " ", "".join(line)).strip() for line in lines]
    return "\n".join(line for line in lines if line), len(chars), sum(inside(p) for p in chars)


def test_content_equals_brute_force(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    for source in [*pages, NAV + BODY, BODY, NAV, "just text", "x &amp; y."]:
        assert X.content(source) == brute_content(source)


def test_query_is_content_of_every_page(spark):
    from corvane.llm import queries

    sf = "/root/testdata/sf0.001"
    got = Counter(tuple(r) for r in queries.QUERIES["op10_html"](spark, sf).collect())
    assert got == Counter((r.page_id, *brute_content(r.html)) for r in spark.read.parquet(f"{sf}/pages.parquet").collect())


def test_extract(spark):
    rows = [(1, BODY, "t", 1), (None, "<p>Null id.</p>", None, None), (2, None, "t", 1), (3, "", "t", 1), (1, BODY, "t", 1)]
    got = X.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r.page_id, r.text is None, r.n_paths) for r in got) == Counter([(1, False, 2), (1, False, 2), (None, False, 1), (2, True, 0), (3, False, 0)])
    assert X.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_words_of_articles_are_found(spark):
    """Against the article element, which the method does not look at."""
    hit = found = wanted = 0
    for row in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        article = re.search(r"<article.*?(</article>|\Z)", row.html, re.S)
        want = Counter(re.findall(r"\w+", X.html.unescape(re.sub(r"<[^>]*>", " ", article[0]))))
        got = Counter(re.findall(r"\w+", X.content(row.html)[0]))
        hit, found, wanted = hit + sum((want & got).values()), found + sum(got.values()), wanted + sum(want.values())
    assert hit / found > 0.95 and hit / wanted > 0.95
