"""Hard negatives, main texts and the conversation trie against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import dom, gnat, trie, wrapper

# Hard negatives


def vectors(seed=5, n=700, dims=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(9)]
    rows = []
    for i in range(n):
        v = [c + rng.gauss(0, 0.3) for c in rng.choice(centres)]
        size = math.sqrt(sum(x * x for x in v)) if i % 5 else 1
        rows.append((i, rng.randrange(4), [x / size for x in v]))
    same = [0.5] * dims
    rows += [(1000 + i, i % 3, same) for i in range(200)]  # a hot vector: ties of score everywhere
    rows += [rows[3], rows[100], rows[100]]  # repeated rows
    rows += [(5000, None, same), (5001, 1, None), (5002, 1, [1.0, None]), (5003, 1, [float("nan")] * dims), (5004, 1, [float("inf")] * dims), (None, 1, same), (5100, 2, []), (5200, 9, [1.0] * dims), (5300, 2, [0.1, 0.2])]
    return rows


def brute_negatives(rows):
    held = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            held[i, label, tuple(math.floor(256 * x) for x in v)] = None
    held = list(held)
    dot = lambda a, b: sum(x * y for x, y in zip(a[2], b[2]))
    out = []
    for a in held:
        if a[0] % 100 == 0:
            near = sorted((-dot(a, b), b[0]) for b in held if b != a and b[1] == a[1])[:5]
            for low, p in near:
                far = sorted((-dot(a, b), b[0]) for b in held if b[1] != a[1] and 80 * -low <= 100 * dot(a, b) <= 100 * -low)[:5]
                out += [(a[0], p, k + 1, i, -low, -s) for k, (s, i) in enumerate(far)]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"leaf": F.lit(1), "score": F.lit("x"), "VEC": F.lit(2)}).repartition(3)
    got = gnat.hard_negatives(df, F.col("vec_id") % 100 == 0, fanout=6, sample=200).collect()
    assert sorted(tuple(r) for r in got) == brute_negatives(rows)


def test_hot_leaves_and_many_queries_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(gnat, "BLOCK", 50)
    monkeypatch.setattr(gnat, "QUERIES", 3)
    rows = vectors(seed=8)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = gnat.hard_negatives(df, F.col("vec_id") % 100 == 0, fanout=3, sample=50).collect()
    assert sorted(tuple(r) for r in got) == brute_negatives(rows)


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert gnat.hard_negatives(df, F.lit(True)).count() == 0
    one = spark.createDataFrame([(0, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    assert gnat.hard_negatives(one, F.lit(True)).count() == 0


def test_ranges_never_lose_a_row_and_do_prune(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 100, (8, 5))
    x = np.floor(centres[rng.integers(0, 8, 600)] + rng.normal(0, 3, (600, 5)))
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "vec_id long, label long, vec array<double>")
    tree, dims = gnat.fit(df, 8, 300)
    rows = gnat.index(df, tree, dims).cache()
    known, leaf = gnat.ranges(rows, tree, dims), dict(rows.select("vec_id", "leaf").collect())
    visited = 0
    for q in x[:40]:
        far = np.sqrt(np.maximum(q @ q + tree.lift - 2 * (x @ q), 0))
        low, high = np.sort(far)[[3, 12]]
        found = gnat.survivors(tree, known, np.append(q, 0.0), low, high)
        visited += len(found)
        assert {leaf[i] for i in np.nonzero((far >= low) & (far <= high))[0].tolist()} <= set(found)
    assert visited < 40 * sum(len(s) for s in tree.leaves) / 4


# Main texts


def test_parser_is_forgiving():
    text = lambda h: wrapper._text(dom.parse(h), set())
    assert text("<p>a<p>b<b>c<br>d<p>e</b>f</p>g") == "a bc d ef g"
    assert text("x &lt; y &amp;&amp &#233;&nbsp;<!-- <p>no --><!doctype x><?php no?>z") == "x < y && é z"
    assert text('<div title="a>b">t</div><a href=\'x>y\'>u</a') == "t u"
    assert text("a < b <3 </> c </p></div>d") == "a < b <3 c d"
    assert text('<p title="never closed>seen<p>too') in ("seen too", "too", "")
    assert text("wo<b>rd</b> x<td>cell</td>") == "word x cell"
    deep = dom.parse("<div>" * 5000 + "x" + "</div>" * 5000)
    shapes = dom.Shapes()
    assert len(shapes.mark(deep)) == 5001 and wrapper._text(deep, set()) == "x"


def brute_matching(x, y):
    if x.name != y.name:
        return 0
    p, q = x.inner, y.inner
    best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
    for i in range(len(p)):
        for j in range(len(q)):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute_matching(p[i], q[j]))
    return 1 + best[-1][-1]


@pytest.mark.parametrize("cells", [1 << 22, 4])
def test_alignment_is_the_largest_matching(cells, monkeypatch):
    monkeypatch.setattr(dom, "CELLS", cells)
    rng = random.Random(2)

    def tree(depth):
        tag = rng.choice(["div", "section", "span", "i"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(rng.randrange(0, 5) if depth else 0)) + "t" + f"</{tag}>"

    for _ in range(60):
        a, b = dom.parse(tree(3) + tree(2)), dom.parse(tree(3) + tree(3))
        shapes = dom.Shapes()
        shapes.mark(a), shapes.mark(b)
        pairs = dom.align(shapes, a, b)
        assert len(pairs) == brute_matching(a, b) == shapes.score(a.shape, b.shape)
        assert all(x.name == y.name for x, y in pairs)


def news(i, body):
    """No element says what the article is; the bar and the hint are alike on all pages."""
    return f'<html><body><div><a href="/">Start</a><p>All the news of the town, every day</p></div><div class="x{i}"><h1>Title {i}</h1>{body}</div><div><p>Write to the editor at the old market</p></div></body></html>'


def test_constant_nodes_are_template_and_varying_slots_content(spark):
    rows = [(i, f"https://One.example/{i}", news(i, f"<p>Story {i} of many words about {i * 7}</p><p>Same end</p>")) for i in range(9)]
    rows += [(20, "https://two.example/a", news(1, "<p>alone</p>")), (21, None, "<p>no host</p>"), (22, "https://one.example/", None), (23, "bad url", ""), (24, "https://one.example/9", rows[3][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"HOST": F.lit("h"), "Ref": F.lit(1), "text": F.lit("old"), "layout": F.lit(None).cast("int")})
    out = wrapper.main_text(df.repartition(2))
    assert out.columns == ["page_id", "url", "html", "HOST", "Ref", "layout", "text"]
    got = {r.page_id: r.text for r in out.collect()}
    assert len(got) == len(rows)
    for i in range(9):
        assert got[i].startswith(f"Title {i} Story {i} of many") and "town" not in got[i] and "editor" not in got[i]
    assert got[24] == got[3] and got[21] == "no host" and got[22] == got[23] == ""
    assert "alone" in got[20]


def test_what_isnt_the_article_goes():
    page = """<body><header><h1>Site</h1></header><nav>menu</nav><div class="cookie-notice">we use cookies</div><div id="sideBar">aside</div>
        <main><article class="no-sidebar"><header><h1>Head &amp; line</h1></header><p>One.</p><div class="advert">buy</div><form>mail <input></form><p>Two<br>three <script>x()</script></p>
        <div class="share-buttons">share</div><footer>tags</footer></article><section id="comments"><article class="comment"><p>first!</p></article></section></main><aside>more</aside><footer>&copy;</footer></body>"""
    assert wrapper.extract(page) == "Head & line One. Two three"
    assert wrapper.extract("<article><p>a</p></article><article><p>b</p></article>") == "a b"
    assert wrapper.extract("") == wrapper.extract("<nav>x</nav>") == ""
    long = "<article>" + "<p>word word</p>" * 50_000 + "</article>"
    assert wrapper.extract(long) == " ".join(["word word"] * 50_000)


def test_references_that_are_too_large_to_send_meet_by_a_shuffle(spark, monkeypatch):
    rows = [(i, f"https://h{i % 3}.example/{i}", news(i, f"<p>Story {i} of {i * 5}</p>")) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(tuple(r) for r in wrapper.main_text(df).collect())
    monkeypatch.setattr(wrapper, "SENT", -1)
    assert sorted(tuple(r) for r in wrapper.main_text(df).collect()) == want


def test_main_text_of_nothing(spark):
    assert wrapper.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# The conversation trie


def brute_trie(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs.setdefault(c, []).append(((t is not None, t or 0), hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    convs = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    member, ends = {}, {}
    for c in convs:
        h, head = zlib.crc32(str(c).encode()) % 9, c - int(math.fmod(c, 5))
        s = tuple(convs.get(head, [])[:h] + convs[c][h:])
        for d in range(len(s) + 1):
            member.setdefault(s[:d], []).append(c)
        ends.setdefault(s, []).append(c)
    kids, leaves, saved = {}, {}, {}
    for s in member:
        if s:
            kids.setdefault(s[:-1], []).append(s)
    for s in sorted(member, key=len, reverse=True):
        ks = kids.get(s, [])
        leaves[s] = sum(leaves[k] for k in ks) if ks else 1
        saved[s] = sum(saved[k] for k in ks) + ((len(member[s]) - 1) * len(s[-1][1].encode()) if s else 0)
    sha = lambda s: hashlib.sha256(",".join(map(str, sorted(ends.get(s, [])))).encode()).hexdigest()
    return sorted((min(m), len(s), min(member[s[:-1]]) if s else None, len(m), len(kids.get(s, [])), leaves[s], saved[s], sha(s)) for s, m in member.items())


def dialogues(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-6, 60), *range(200, 320)]:
        kind = rng.randrange(4)
        n = rng.choice([0, 1, 2, 3, 5, 9, 40 if c % 11 == 0 else 4])
        for t in range(n):
            text = "hi é" if kind == 0 or t == 0 and c % 3 else f"{rng.randrange(3)} same" if kind < 3 else f"own {c} {t}"
            rows.append((c, t, rng.choice(["user", "user", None]) if kind == 2 else "user", text))
    rows += [(7, None, "system", "late"), (7, None, "system", "late"), (8, 1, None, None), (8, 1, "", ""), (None, 0, "user", "nobody"), (9, 2, "user", ""), (400, 0, "user", "long " * 100_000)]
    rows += [(c, t, "user", "hot" * t) for c in range(1000, 1200) for t in range(12)]  # one conversation, many times
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed):
    rows = dialogues(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"sid": F.lit(1), "pos": F.lit("x"), "HEAD": F.lit(3)}).repartition(3)
    assert sorted((tuple(r) for r in trie.conversation_trie(df).collect()), key=str) == sorted(brute_trie(rows), key=str)


def test_handles_are_two_fattest(spark):
    cases = [(a, b) for a in range(0, 40) for b in range(a + 1, 41)]
    got = spark.createDataFrame(cases, "a int, b int").withColumn("f", trie.fattest("a", "b")).collect()
    assert all(r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x) for r in got)


def test_ids_of_a_hot_end_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 40)
    rows = [(b"a", i * 3 - 50) for i in range(300)] + [(b"b", 5)]
    got = dict(trie.id_digests(spark.createDataFrame(rows, "sid binary, conv_id long").repartition(4)).collect())
    want = {s: hashlib.sha256(",".join(str(c) for c in sorted(c for k, c in rows if k == s)).encode()).hexdigest() for s in (b"a", b"b")}
    assert {bytes(k): v for k, v in got.items()} == want


def test_trie_of_nothing(spark):
    assert trie.conversation_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
