"""Each operator against a brute-force version, and on the edge cases that its docstring defines."""

from __future__ import annotations

import math
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser
from itertools import combinations, permutations, product
from types import SimpleNamespace

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from frameloom.llm import common, decontaminate, html_extract, license_scan, line_dedup, packing, quality_classifier, quality_rules, simhash, suffix_dedup, url_filters
from frameloom.llm.components import connected_components
from frameloom.llm.queries import tokenizer_path

from .conftest import SCHEMA, rows, words


def got(df):
    return [tuple(r) for r in df.collect()]


# packing


def test_pieces_are_the_tokenizers(spark, edge_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in edge_docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want[r.doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    found = got(packing.pack_documents(edge_docs, tokenizer_path()))
    assert Counter(r[:5] for r in found) == want
    check_places(found)


def check_places(found):
    by = defaultdict(list)
    for r in found:
        by[r[5]].append((r[6], r[3]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096


def test_packing_reaches_the_bound(spark, corpus, no_docs):
    assert got(packing.pack_documents(no_docs, tokenizer_path())) == []
    found = got(packing.pack_documents(corpus, tokenizer_path()))
    check_places(found)
    assert len({r[5] for r in found}) == -(-sum(r[3] for r in found) // 4096)


@settings(deadline=None, max_examples=25)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 300), min_size=1, max_size=25))
def test_plan_holds_every_count_once(counts):
    plan = packing.plan_bins(counts, 60)
    held = Counter()
    for n, inside in plan.groups:
        assert sum(x * k for x, k in inside) <= 60
        for x, k in inside:
            held[x] += n * k
    assert held == Counter(counts)
    assert plan.by_program + plan.by_best_fit == sum(counts.values())
    assert plan.bound <= plan.bins <= max(plan.value + len(counts), 1.1 * sum(n for n, _ in packing.best_fit(counts, 60)) + 1)


@settings(deadline=None, max_examples=25)
@given(st.dictionaries(st.integers(1, 30), st.tuples(st.integers(1, 4), st.floats(0.1, 9)), min_size=1, max_size=6), st.integers(1, 40))
def test_knapsack_and_traces_against_enumeration(kinds, capacity):
    copies, price = {x: n for x, (n, _) in kinds.items()}, {x: p for x, (_, p) in kinds.items()}
    best, items, taken = packing._knapsack(price, copies, capacity)
    bags = [dict(zip(copies, ns, strict=True)) for ns in product(*(range(n + 1) for n in copies.values()))]
    for room, found in enumerate(packing._trace(items, taken, list(range(capacity + 1)))):
        want = max(sum(price[x] * n for x, n in bag.items()) for bag in bags if sum(x * n for x, n in bag.items()) <= room)
        assert best[room] == pytest.approx(want) == pytest.approx(sum(price[x] * n for x, n in found.items()))
        assert all(n <= copies[x] for x, n in found.items()) and sum(x * n for x, n in found.items()) <= room


def test_solution_covers_every_count_and_the_bound_holds():
    # 8 bins are needed: 7s go with 3s, 6s with 4s.
    counts = {7: 4, 3: 4, 6: 4, 4: 4}
    solution = packing.solve_lp(counts, 10)
    for x, n in counts.items():
        assert sum(a * dict(c).get(x, 0) for c, a in solution.amounts.items()) >= n - 1e-6
    assert solution.bound <= 8 + 1e-9 and solution.value >= 8 - 1e-9
    assert packing.plan_bins(counts, 10).bins == 8
    # Thirds of the capacity and a bit: no bin holds three, which the bound shows and the total size doesn't.
    assert packing.solve_lp({34: 90}, 100).bound == pytest.approx(45)


@pytest.mark.parametrize("pieces", [200, 1000, 10_000, 250_000])
def test_the_program_places_the_pieces(pieces):
    rng = random.Random(pieces)
    counts = Counter(min(4096, int(rng.lognormvariate(6, 1.2)) + 1) for _ in range(pieces))
    plan = packing.plan_bins(counts)
    assert plan.by_program >= (0.9 if pieces < 1000 else 0.95) * pieces
    assert plan.bins <= plan.value + len(plan.groups) and plan.bins <= 1.001 * plan.bound + 2


def test_other_tokenizers_go_through_the_whole_tokenizer(tmp_path):
    import json

    config = json.loads(open(tokenizer_path()).read())
    config["normalizer"] = None
    other = tmp_path / "other.json"
    other.write_text(json.dumps(config))
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(str(other))
    known = packing.chunk_ids(str(other))
    for text in ("Some Words, it's 12", "", " a  b\nc\t", "École ÉÀ"):
        assert packing.text_ids(known, text) == struct.pack(f"<{len(ids := whole.encode(text, add_special_tokens=False).ids)}I", *ids)


# quality rules


def brute_repeats(w):
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    return len({i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)})


@settings(deadline=None, max_examples=60)
@given(st.lists(st.sampled_from([b"a", b"b"]), max_size=60))
def test_repeated_words(w):
    assert quality_rules.repeated_words(w) == brute_repeats(w)


def test_rules(spark, edge_docs, corpus, no_docs):
    assert got(quality_rules.score_rules(no_docs)) == [] and quality_rules.keep_good(no_docs).count() == 0
    for docs in (edge_docs, corpus):
        texts = Counter((r.doc_id, r.text) for r in docs.collect())
        want = Counter()
        for (i, t), n in texts.items():
            w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
            lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), brute_repeats(w), len(w) < 20 or 100 * brute_repeats(w) > 30 * len(w)] += n
        found = quality_rules.score_rules(docs)
        assert Counter(r[:7] for r in got(found)) == want
        kept = Counter(r.doc_id for r in found.collect() if r.kept)
        good = quality_rules.keep_good(docs)
        assert Counter(r.doc_id for r in good.collect()) == kept and good.columns == docs.columns


# html


PAGE = '<html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header>Site</header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use</div>%s<aside>Side</aside><div id="comments"><p>me too</div><form>Name <input></form><footer>&copy; us</footer></body></html>'


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("<p>a<p>b", "a\nb"),
        (PAGE % "<article><h1>T &amp; U</h1><p>one <b>two<br>three<p>four &lt;b&gt;<script>x='</p>'</script></article>", "T & U\none two three\nfour <b>"),
        (PAGE % f'<main><p>{"x" * 40}</p><div class="share">tweet</div><ul><li>i<li>j</ul></main>', "x" * 40 + "\ni\nj"),
        (PAGE % f"<div><p>no article{' at all' * 9}</p></div>", "no article" + " at all" * 9),
        ("<article><p>cut off <b>he", "cut off he"),
        ("<article><p>cut off</p><di", "cut off"),
        ("<article>a <!-- b --> c<!-- <p>d", "a c"),
        ("<article>1 < 2 and 3 > 2</article>", "1 < 2 and 3 > 2"),
    ],
)
def test_main_text(html, text):
    assert html_extract.Pages().main_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<div class="layout has-sidebar"><p>The whole page</p></div>', "The whole page"),
        ('<form id="aspnetForm"><article>Text of it</article><input></form>', "Text of it"),
        ('<article><div class="entry-header"><h1>Title</h1></div><p>Text</p></article>', "Title\nText"),
        ('<article><p>Text</p><div class="related-work">Others did it too</div><p class="side">Beside</p></article>', "Text\nOthers did it too\nBeside"),
        ("<article><p title=it's>don't stop</p><p class='a>b'>x</p></article>", "don't stop\nx"),
        ('<article><p>Text</p><div class="ad">' + "long text in it " * 9 + "</div></article>", "Text\n" + ("long text in it " * 9).strip()),
        ("<article>" + "<p>Text of some length</p>" * 9 + '<div class="ad">Buy it</div></article>', "\n".join(["Text of some length"] * 9)),
        ("<form>" + "Everything is in a form. " * 9 + "<button>Go</button></form><p>Some more</p>", ("Everything is in a form. " * 9).strip() + "\nSome more"),
    ],
)
def test_markup_is_one_term(html, text):
    assert html_extract.Pages().main_text(html) == text


def test_style_tree_cuts_what_all_pages_share(spark):
    pages = [(i, "http://h.example/%d" % i, f"<body><div class=x>Same words here</div><div class=y>Text {i} of its own</div></body>") for i in range(12)]
    pages += [(90, None, "<p>alone"), (91, "http://o.example", None), (92, "no scheme", None), (None, "http://h.example/0", pages[0][2]), (0, pages[0][1], pages[0][2])]
    df = spark.createDataFrame([(*p, "clash", "clash") for p in pages], "page_id long, url string, html string, host string, stats string")
    want = Counter()
    for i, url, html in pages:
        text = "alone" if i == 90 else "" if html is None else re.search(r"Text \d+ of its own", html)[0]
        want[i, url, text, len(text)] += 1
    for limit in (html_extract.BROADCAST_NODES, -1):
        assert Counter(got(html_extract.main_texts(df, broadcast_nodes=limit))) == want
    assert html_extract.main_texts(df.limit(0)).count() == 0


def test_style_tree_cuts_inside_the_article(spark):
    page = "<body><article><p>Text %d of its own</p><div class=z1>Tell us what you think</div></article></body>"
    pages = [(i, f"http://h.example/{i}", page % i) for i in range(10)] + [(50 + i, f"http://copies.example/{i}", page % 1) for i in range(10)]
    found = {r.page_id: r.text for r in html_extract.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert found == {i: f"Text {i} of its own" for i in range(10)} | {50 + i: "Text 1 of its own\nTell us what you think" for i in range(10)}


class TreeParser(HTMLParser):
    """An independent reading of pages of nested divs: (path, children's names, own texts) of each element."""

    def __init__(self, html):
        super().__init__()
        self.top = ["", [], []]
        self.stack = [self.top]
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        element = [dict(attrs).get("class", ""), [], []]
        self.stack[-1][1].append(element)
        self.stack.append(element)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        element = [None, [], [data]]
        self.stack[-1][1].append(element)


def walk(element, path=()):
    yield path, element
    for child in element[1]:
        if child[0] is not None:
            yield from walk(child, (*path, child[0]))


def test_style_tree_against_brute_force(spark):
    rng = random.Random(8)

    def part(depth):
        name = rng.choice("abcd")
        if depth == 0 or rng.random() < 0.4:
            return f'<div class="{name}">{"same" if name in "ab" else f"own {rng.random()}"}</div>'
        return f'<div class="{name}">' + "".join(part(depth - 1) for _ in range(rng.randrange(1, 4))) + "</div>"

    pages = [(i, f"http://h{i % 2}.example/{i}", "".join(part(3) for _ in range(3))) for i in range(50)]
    found = {r.page_id: r.text for r in html_extract.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    changed = 0
    for host in (0, 1):
        trees = {i: TreeParser(html).top for i, _, html in pages if i % 2 == host}
        of_path = defaultdict(list)  # path -> for each page: layout, texts
        for tree in trees.values():
            own = defaultdict(lambda: ([], set()))
            for path, e in walk(tree):
                own[path][0].append(tuple(c[0] for c in e[1] if c[0] is not None))
                own[path][1].update(c[2][0] for c in e[1] if c[0] is None)
            for path, (layout, texts) in own.items():
                of_path[path].append((tuple(layout), texts))

        def entropy(counts, m):
            return -sum(c / sum(counts) * math.log(c / sum(counts)) / math.log(m) for c in counts)

        def composite(path, e):
            m = len(of_path[path])
            judged = m >= html_extract.MIN_PAGES
            layouts = Counter(x for x, _ in of_path[path])
            texts = Counter(t for _, ts in of_path[path] for t in ts)
            layout = entropy(layouts.values(), m) if judged else 1.0
            content = 1 - sum(entropy([1] * c, m) for c in texts.values()) / len(texts) if judged and texts else 1.0
            inside = [composite((*path, c[0]), c) for c in e[1] if c[0] is not None]
            values = [x[0] for x in inside] + [content] * any(c[0] is None for c in e[1])
            share = html_extract.DECAY ** (len(layouts) if judged else 1)
            mean = sum(values) / len(values)
            own = (1 - share) * layout + share * mean if inside else mean
            return own, max([own, *(x[1] for x in inside)])

        def texts_of(path, e):
            for c in e[1]:
                if c[0] is None:
                    yield c[2][0]
                elif composite((*path, c[0]), c)[1] >= html_extract.MIN_IMPORTANCE:
                    yield from texts_of((*path, c[0]), c)

        for i, tree in trees.items():
            want = list(texts_of((), tree))
            assert found[i] == "\n".join(want)
            changed += len(want) < sum(len([c for c in e[1] if c[0] is None]) for _, e in walk(tree))
    assert 10 < changed


# line dedup


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], min(before + (x != y), row[j] + 1, row[j + 1] + 1)
    return row[-1]


def brute_lines(texts, edits=line_dedup.EDITS, per=line_dedup.CHARS_PER_EDIT):
    strip = " \t\r\v\f"
    order = lambda i: (i is not None, i or 0)
    first = {}
    for i, t in sorted({x for x in texts if x[1] is not None}, key=lambda x: (order(x[0]), 0)):
        for k, line in enumerate(t.split("\n")):
            if line := line.strip(strip):
                first[line] = min(first.get(line, ((True, 1 << 60), 0, "")), (order(i), k, t))

    def near(a, b):
        allowed = min(edits, min(len(a), len(b)) // per) if per else edits
        return abs(len(a) - len(b)) <= allowed and levenshtein(a, b) <= allowed

    gone = {a for a, b in permutations(first, 2) if first[b][:2] < first[a][:2] and near(a, b)}
    out = Counter()
    for i, t in texts:
        if t is None:
            out[i, None] += 1
            continue
        kept = []
        for k, line in enumerate(t.split("\n")):
            core = line.strip(strip)
            if not core or first[core][:2] == (order(i), k) and core not in gone:
                kept.append(line)
        out[i, "\n".join(kept)] += 1
    return out


@pytest.mark.parametrize("bucket", [line_dedup.MAX_BUCKET, 1])
def test_line_dedup(spark, corpus, bucket):
    found = Counter((r[0], r[3]) for r in got(line_dedup.dedup_lines(corpus, bucket=bucket)))
    assert found == brute_lines([(r.doc_id, r.text) for r in corpus.collect()])


@pytest.mark.parametrize(("edits", "per", "bucket"), [(1, 20, 48), (2, 20, 6), (3, 10, 48), (3, 0, 24), (2, 0, 48)])
def test_edits_against_brute_force(spark, edits, per, bucket):
    rng = random.Random(edits)
    lines = []
    for k in range(90):
        base = "".join(rng.choice("ab c") for _ in range(rng.randrange(1, 70))) if k % 3 else "the same beginning of a line and then " + str(rng.randrange(10**4))
        for _ in range(rng.randrange(1, 4)):
            near = base
            for _ in range(rng.randrange(5)):
                i = rng.randrange(len(near) + 1)
                near = rng.choice([near[:i] + "d" + near[i:], near[:i] + near[i + 1 :], near[:i] + "a" + near[i + 1 :]])
            lines.append(near)
    rng.shuffle(lines)
    texts = [(i, "\n".join(lines[i::40])) for i in range(40)]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    assert Counter((r[0], r[3]) for r in got(line_dedup.dedup_lines(docs, edits=edits, chars_per_edit=per, bucket=bucket))) == brute_lines(texts, edits, per)


def test_hot_segments(spark):
    rng = random.Random(4)
    base = "the same beginning of a line and then the number "
    lines = {base + str(rng.randrange(10**4)).zfill(4) for _ in range(150)} | {base + str(rng.randrange(10**3)) for _ in range(40)}
    lines |= {base + " ".join(words(rng, 6)) for _ in range(120)}
    texts = list(enumerate(sorted(lines, key=lambda x: rng.random())))
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    assert Counter((r[0], r[3]) for r in got(line_dedup.dedup_lines(docs))) == brute_lines(texts)


def test_two_edits_by_default(spark):
    """Lines that differ from one text at places of their own, in four characters or, at the end, in two."""
    rng = random.Random(8)
    base = " ".join(words(rng, 12))
    at = lambda: rng.randrange(len(base) + 1)
    grown = [base[: (i := at())] + "k" + "".join(rng.choice("abcdefgh\u00e9") for _ in range(3)) + base[i:] for _ in range(70)]
    two = [x[: (i := rng.randrange(len(x)))] + "q" + x[i + 1 :][:-1] for x in grown[:12]] + ["z" + base + "z"]
    texts = list(enumerate([base, *grown, *two]))
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    found = Counter((r[0], r[3]) for r in got(line_dedup.dedup_lines(docs)))
    assert found == brute_lines(texts, 2, 20) and sum(t == "" for _, t in found) >= 10


def test_signatures_keep_near_pairs(spark):
    rng = random.Random(9)
    pairs = []
    for _ in range(400):
        a = b = "".join(rng.choice("ab \u00e9\U0001f600") for _ in range(rng.randrange(12)))
        for _ in range(2):
            i = rng.randrange(len(b) + 1)
            b = rng.choice([b, b[:i] + "c" + b[i:], b[:i] + b[i + 1 :], b[:i] + "a" + b[i + 1 :]])
        pairs.append((len(pairs), *sorted((a, b), key=len)))
    pairs = [(*p, len(p[2]) - len(p[1])) for p in pairs]
    row = "key long, h long, g long, rest string, longer int, t int, first int"
    one = spark.createDataFrame([(k, 0, 0, s, d, 2, 1) for k, _, s, d in pairs], row)
    other = spark.createDataFrame([(k, 0, 0, r, 0, 2, 0) for k, r, _, _ in pairs], row)
    assert line_dedup._pairs(line_dedup._signed(one), line_dedup._signed(other)).count() == len(pairs)
    far = spark.createDataFrame([(0, k, k, "abcdefgh" + x * 4 + "ijkl", 0, 2, k) for k, x in enumerate("mnopqrst")], row)
    assert line_dedup._pairs(far, far).count() == 28
    far = far.withColumn("rest", F.concat("rest", F.substring("rest", 9, 1), F.lit("uv"), F.col("h").cast("string"), F.chr(F.col("h") + 65), F.chr(F.col("h") + 75)))
    assert line_dedup._pairs(line_dedup._signed(far), line_dedup._signed(far)).count() < 14


@pytest.mark.parametrize("used, times", [(374, 0), (376, 1)])
def test_driver_collects_garbage(monkeypatch, used, times):
    """Beyond half of the driver's heap, and after the table is written."""
    calls = []
    heap = SimpleNamespace(totalMemory=lambda: used, maxMemory=lambda: 750)
    lang = SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: heap), System=SimpleNamespace(gc=lambda: calls.append("gc")))
    context = SimpleNamespace(_jvm=SimpleNamespace(java=SimpleNamespace(lang=lang)))
    monkeypatch.setattr(common, "written", lambda df, name: calls.append(name) or df)
    df = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context))
    assert common.materialise(df, "x") is df and calls == ["x"] + ["gc"] * times


def test_parts_of_pairs(spark):
    """Two lines that both have a key as the longer one aren't paired, and a part stays when a key is extended."""
    lines = spark.createDataFrame([(k, k, "abcdefghij" * 3 + "x" * k) for k in range(2)], "h long, g long, line string")
    cut = line_dedup._segments(lines, "line", 1, lambda n: F.lit(1))
    held = cut.select("h", "g", "k.*").withColumn("first", F.col("h")).withColumn("rest", F.lit("r"))
    pairs = line_dedup._pairs(held, held)
    both = held.join(held.select("key", F.col("h").alias("h2")), "key").where("h2 < h")
    assert pairs.count() == both.count() == 1
    longer = held.where("longer = 1")
    assert line_dedup._pairs(longer.withColumn("key", F.lit(1)), longer.withColumn("key", F.lit(1))).count() == 0
    again = line_dedup._segments(lines.withColumn("part", F.col("h").cast("int")), "line", 1, lambda n: F.lit(1), "part")
    assert [(r.h, r[1]) for r in again.select("h", "k.longer").collect()] == [(0, 0), (0, 0), (1, 1), (1, 1)]


def test_very_long_lines(spark):
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefgh ") for _ in range(100_000))
    texts = [(i, base[:50_000] + "".join(rng.choice("xyz") for _ in range(50_000)) if i % 3 else base[: 1000 + i] + "Q" + base[1000 + i :]) for i in range(60)]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    began = time.monotonic()
    found = {r[0]: r[2] for r in got(line_dedup.dedup_lines(docs, edits=2))}
    assert time.monotonic() - began < 60
    assert found == {i: int(i % 3 == 0 and i > 0) for i in range(60)}


def test_line_dedup_edges(spark, edge_docs, no_docs):
    assert got(line_dedup.dedup_lines(no_docs)) == [] and line_dedup.drop_lines(no_docs).columns == no_docs.columns
    found = line_dedup.dedup_lines(edge_docs)
    assert found.count() == edge_docs.count()
    left = line_dedup.drop_lines(edge_docs)
    ids = Counter(r.doc_id for r in left.collect())
    assert left.columns == edge_docs.columns and ids[7] == 0 and ids[1] == ids[2] == ids[3] == ids[5] == 1 and ids[None] == 2


def test_banded_distance(spark):
    rng = random.Random(1)
    for edits in (1, 2, 3):
        pairs = []
        for _ in range(1500):
            a = "".join(rng.choice("ab") for _ in range(rng.randrange(9)))
            b = a
            for _ in range(rng.randrange(edits + 3)):
                i = rng.randrange(len(b) + 1)
                b = rng.choice([b[:i] + "c" + b[i:], b[:i] + b[i + 1 :], b[:i] + "a" + b[i + 1 :]])
            if 0 <= len(b) - len(a) <= edits:
                pairs.append((a, b, min(levenshtein(a, b), edits + 1)))
        df = spark.createDataFrame(pairs, "r string, s string, d int")
        assert df.where(F.least(line_dedup.edit_distance(df.r, df.s, edits), F.lit(edits + 1)) != df.d).count() == 0


# suffix arrays


@pytest.mark.parametrize("limit", [suffix_dedup.BROADCAST_SUFFIXES, 0])
def test_repeated_spans(spark, corpus, edge_docs, no_docs, limit):
    assert got(suffix_dedup.repeated_spans(no_docs, broadcast_suffixes=limit)) == []
    rng = random.Random(17)
    passage, other = words(rng, 60), words(rng, 75)
    inside = [(0, [*passage, "x", *words(rng, 30), *passage]), (1, other), (2, [*words(rng, 20), *other[:58], "end"]), (3, ["a"] * 130), (4, [*other[10:], *other[:70]]), (5, ["b"] * 50)]
    inside = spark.createDataFrame(rows([(i, " ".join(w)) for i, w in inside]), SCHEMA)
    for docs in (corpus, edge_docs, inside):
        rows_ = {(r.doc_id, r.text) for r in docs.collect()}
        places, count = defaultdict(set), Counter()
        for r in docs.collect():
            w = (r.text or "").split()
            for s in range(len(w) - 49):
                places[tuple(w[s : s + 50])].add((r.doc_id, r.text, s))
                count[tuple(w[s : s + 50])] += 1
        want = set()
        for i, t in rows_:
            w = (t or "").split()
            hit = {s for s in range(len(w) - 49) if len(places[tuple(w[s : s + 50])]) > 1}
            for s in [s for s in hit if s - 1 not in hit]:
                e = s
                while e + 1 in hit:
                    e += 1
                windows = [tuple(w[k : k + 50]) for k in range(s, e + 1)]
                least = min((p[0] for g in windows for p in places[g] if p[0] is not None), default=None)
                want.add((i, s, e - s + 50, least, max(count[g] for g in windows), any(len({p[:2] for p in places[g]}) > 1 for g in windows)))
        found = got(suffix_dedup.repeated_spans(docs, broadcast_suffixes=limit))
        assert set(found) == want and len(found) == len(want)


# decontamination


def test_decontamination(spark, corpus, edge_docs, no_docs):
    texts = {r.doc_id: r.text for r in corpus.collect()}
    items = [(1, texts[3]), (2, texts[10].upper()), (3, "w1x"), (4, None), (5, "---"), (6, "none of these words occur"), (7, " ".join(texts[5].split()[2:9])), (7, " ".join(texts[5].split()[2:9]))]
    benchmark = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, w string")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    for docs in (corpus, edge_docs, no_docs):
        want = Counter()
        for r in docs.collect():
            w, hit, names = cut(r.text), set(), set()
            for i, t in items:
                b = cut(t)
                for s in range(max(1, len(b) - 9) if b else 0):
                    g = b[s : s + 10]
                    for p in range(len(w) - len(g) + 1):
                        if w[p : p + len(g)] == g:
                            hit |= {*range(p, p + len(g))}
                            names.add(str(i))
            want[r.doc_id, len(w), len(hit), len(names), bool(hit)] += 1
        found = decontaminate.decontaminate(docs, benchmark)
        assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in found.collect()) == want
        clean = decontaminate.drop_contaminated(docs, benchmark)
        assert clean.columns == docs.columns and Counter(r.doc_id for r in clean.collect()) == Counter(k[0] for k, n in want.items() for _ in range(n) if not k[4])
    assert decontaminate.decontaminate(corpus, benchmark.limit(0)).where("contaminated").count() == 0


def test_texts_of_one_item_are_all_looked_up(spark):
    texts = [" ".join(f"{c}{k}" for k in range(14)) for c in "abcd"]
    docs = spark.createDataFrame([(i, f"x {t} y") for i, t in enumerate(texts)] + [(9, "x y z")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(0, texts[0]), (0, texts[1]), (0, " ".join(f"n{k}" for k in range(14))), (None, texts[2]), (0, texts[0])], "item_id long, text string")
    for rows_ in (decontaminate.BROADCAST_ROWS, 0):
        before, decontaminate.BROADCAST_ROWS = decontaminate.BROADCAST_ROWS, rows_
        try:
            found = {r.doc_id: (r.n_hit, r.n_items, r.contaminated, len(r.hits)) for r in decontaminate.decontaminate(docs, benchmark).collect()}
            clean = {r.doc_id for r in decontaminate.drop_contaminated(docs, benchmark).collect()}
        finally:
            decontaminate.BROADCAST_ROWS = before
        assert found == {0: (14, 1, True, 5), 1: (14, 1, True, 5), 2: (14, 0, True, 5), 3: (0, 0, False, 0), 9: (0, 0, False, 0)} and clean == {3, 9}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x a filler b c y"), (2, "c b a"), (3, "a b"), (4, "a z z z z z z z z z b c")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(9, "a b c")], "item_id long, text string")
    assert {r[0] for r in got(decontaminate.proximity_matches(docs, benchmark, slack=2))} == {1, 2}


# simhash


def brute_print(text):
    w = [x.decode() for x in re.sub(b"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()).split()]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("tile", [4096, 3])
def test_simhash(spark, corpus, edge_docs, no_docs, tile):
    assert got(simhash.simhash_components(no_docs)) == []
    simhash.links.__defaults__, before = (simhash.RADIUS, tile), simhash.links.__defaults__
    try:
        for docs in (corpus, edge_docs):
            nodes = [(r.doc_id, brute_print(r.text)) for r in docs.collect()]
            up = list(range(len(nodes)))

            def find(i, up=up):
                while up[i] != i:
                    i = up[i]
                return i

            for a, b in combinations(range(len(nodes)), 2):
                if (nodes[a][1] ^ nodes[b][1]).bit_count() <= 3:
                    up[find(a)] = find(b)
            least = {}
            for k, (i, _) in enumerate(nodes):
                if i is not None:
                    least[find(k)] = min(least.get(find(k), i), i)
            want = Counter((i, f"{f:016x}", least.get(find(k))) for k, (i, f) in enumerate(nodes))
            assert Counter(got(simhash.simhash_components(docs))) == want
    finally:
        simhash.links.__defaults__ = before


def brute_sketch(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = []
    for i in range(max(1, len(w) - 4)):
        x = xxhash.xxh64_intdigest(" ".join(w[i : i + 5]), 42)
        y = (x + 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 % 2**64
        y = (y ^ y >> 31) * 0x94D049BB133111EB % 2**64
        h.append(x | (y ^ y >> 29) << 64)
    return sum(1 << b for b in range(128) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_ones(texts):
    """(id, text) that stay of near copies: those whose id is the least of their component."""
    nodes = [(i, t, brute_sketch(t)) for i, t in texts]
    up = list(range(len(nodes)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(range(len(nodes)), 2):
        if (nodes[a][2] ^ nodes[b][2]).bit_count() <= simhash.KEEP_RADIUS:
            up[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(nodes):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, t) for k, (i, t, _) in enumerate(nodes) if least.get(find(k)) == i]


def test_keep_one(spark, corpus, edge_docs, no_docs):
    assert simhash.keep_one(no_docs).count() == 0
    rng = random.Random(12)
    edited = []
    for i in range(12):
        w = words(rng, 120)
        edited.append((10 * i, " ".join(w)))
        for k in range(1, 4):
            for _ in range(k):
                w[rng.randrange(120)] = "edited"
            edited.append((10 * i + k, " ".join(w)))
    for docs in (corpus, edge_docs, spark.createDataFrame(rows(edited), SCHEMA)):
        one = simhash.keep_one(docs)
        assert one.columns == docs.columns
        assert Counter((r.doc_id, r.text) for r in one.collect()) == Counter(brute_ones([(r.doc_id, r.text) for r in docs.collect()]))


def test_sketch_tiles_lose_no_link(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (30, 2), dtype=np.uint64)
    near = [row ^ np.packbits(np.isin(np.arange(128), rng.choice(128, k, replace=False)), bitorder="little").view(np.uint64) for row in base for k in (5, 22, 23, 40)]
    values = np.unique(np.concatenate([base, np.array(near)]), axis=0)
    df = spark.createDataFrame([(bytearray(v.tobytes()), int(np.bitwise_count(v).sum())) for v in values], "fp binary, ones int")
    names = [v.tobytes() for v in values]
    want = {x: x for x in names}

    def join(up, a, b):
        a, b = up[a], up[b]
        return {k: min(a, b) if g in (a, b) else g for k, g in up.items()}

    for a, b in combinations(range(len(names)), 2):
        if int(np.bitwise_count(values[a] ^ values[b]).sum()) <= 22:
            want = join(want, names[a], names[b])
    found = {x: x for x in names}
    for u, v in got(simhash.sketch_links(df, 22, 10)):
        found = join(found, bytes(u), bytes(v))
    assert found == want


def test_tiles_lose_no_link():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)), base ^ np.uint64(7)]))
    u, v = (values[x] for x in simhash.tile_links(values, values, 3))
    group = {int(x): int(x) for x in values}
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        old, new = group[b], group[a]
        group = {k: new if g == old else g for k, g in group.items()}
    for a, b in combinations(values.tolist(), 2):
        if (a ^ b).bit_count() <= 3:
            assert group[a] == group[b]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201)]
    found = dict(got(connected_components(spark.createDataFrame(edges, "u long, v long"))))
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}
    assert got(connected_components(spark.createDataFrame([], "u long, v long"))) == []


# quality classifier


def test_votes_by_brute_force():
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["word", "Word", "123", "a-b", "x", "yy"]) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    labels = np.array([k % 3 == 0 for k in range(40)], np.int64)
    known = quality_classifier._Terms()
    x = np.array([quality_classifier.term_vector(t, known) for t in texts])
    model = quality_classifier.Voter(x[:40], labels, {0: 90.0, 1: 10.0}, rank=6, neighbours=7)

    def place(row):
        v = (row * model.idf) @ model.basis
        return v / max(math.sqrt(sum(float(a) ** 2 for a in v)), 1e-9)

    # The space keeps as much of the labelled vectors as the best one of its rank.
    labelled = x[:40] * model.idf
    labelled /= np.maximum(np.linalg.norm(labelled, axis=1, keepdims=True), 1e-9)
    best = np.linalg.svd(labelled, compute_uv=False)
    assert np.linalg.norm(labelled @ model.basis) ** 2 >= 0.999 * float((best[:6] ** 2).sum())
    weight = {0: 90 / int((labels == 0).sum()), 1: 10 / int((labels == 1).sum())}
    for row, score in zip(x[40:], model.score(x[40:]), strict=True):
        near = sorted(((float(place(row) @ place(o)), k) for k, o in enumerate(x[:40])), reverse=True)[:7]
        votes = [(max(c, 0.0) ** 8 * weight[labels[k]], labels[k]) for c, k in near]
        pinch = 1e-3 * (sum(weight[y] for y in labels) / 40)
        want = (sum(v for v, y in votes if y) + pinch * 0.1) / (sum(v for v, _ in votes) + pinch)
        assert abs(score - want) < 1e-3


def test_labels_that_disagree_and_ids_with_two_texts(spark):
    texts = [(i, "good words here " * 9 if i % 2 else "BAD!!! 123 $$$ " * 9) for i in range(40)]
    labels = [(i, i % 2) for i in range(40)]
    docs = spark.createDataFrame(rows(texts + [(3, "another text of 3"), (5, None)]), SCHEMA)
    frame = lambda x: spark.createDataFrame(x, "doc_id long, quality int")
    first = quality_classifier.fit(docs, frame(labels + [(1, 0), (2, 1), (4, None)]))
    again = quality_classifier.fit(docs.orderBy(F.desc("text")), frame([(4, None), (2, 1), (1, 0), *reversed(labels)]))
    assert np.array_equal(first.vectors, again.vectors) and np.array_equal(first.labels, again.labels)


def test_classifier(spark):
    rng = random.Random(2)
    texts = []
    for i in range(400):
        w = words(rng, 60, 3000)
        bad = i % 4 == 0
        texts.append((i, " ".join(x.upper() + "!!" for x in w) if bad and i % 8 else " ".join(x + "***" for x in w) if bad else " ".join(w) + "."))
    docs = spark.createDataFrame(rows([*texts, (1000, None), (1001, ""), (1001, ""), (None, "x")]), SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(300)] + [(301, None, 0), (None, 1, 0), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality_classifier.score_quality(docs, labels).collect()
    assert len(found) == 404 and all(0 <= r.score <= 1 for r in found) and all(r.predicted == (r.score >= 0.3) for r in found)
    for r in found:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
            if r.doc_id < 400:
                assert r.predicted == (r.doc_id % 4 != 0)
    assert {r.score for r in quality_classifier.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.score_quality(docs.limit(0), labels).count() == 0


# url filters


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        (None, "", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("https://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("https://a.example.net/fr/x", "a.example.net", "/fr/x", "net/", "block"),
        ("https://net/x", "net", "/x", "net/", "block"),
        ("https://planet/x", "planet", "/x", None, "allow"),
        ("https://x.example.com/de/", "x.example.com", "/de/", "example.com/de/", "block"),
        ("https://y.org/fr/casino", "y.org", "/fr/casino", "org/fr/", "allow"),
        ("https://freecasinobets.com#/de/", "freecasinobets.com", "", None, "block"),
        ("https://www.dailynews.com/en/story", "www.dailynews.com", "/en/story", None, "allow"),
        ("x://h?/en/", "h", "", None, "allow"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    model = url_filters.UrlModel()
    assert url_filters.split_url(url) == (host, path)
    fits = url_filters.fitting_rule(host, path)
    assert (fits and fits[1]) == rule
    assert (fits[0] if fits else "block" if model.score(host, path) > 0 else "allow") == verdict


def test_segmentation(spark):
    model = url_filters.UrlModel()
    assert model.segment("cheappills") == ["cheap", "pills"] and model.segment("dailynews") == ["daily", "news"]
    df = spark.createDataFrame([(1, None, "x"), (2, "http://cheappills.example.com/", "x"), (2, "http://cheappills.example.com/", "x")], "page_id long, url string, host string")
    assert sorted(r[4] for r in got(url_filters.judge_urls(df))) == ["allow", "block", "block"]
    assert url_filters.judge_urls(df.limit(0)).count() == 0


# licences


def test_licences(spark, edge_docs, no_docs):
    model = license_scan.LicenceModel()
    assert all(model.predict(t)[0] == f for f, ts in license_scan.TEMPLATES.items() for t in ts)
    lines = [t for ts in license_scan.TEMPLATES.values() for t in ts] + list(license_scan.COUNTER) + ["", "public", "Licensed under CC BY-NC 4.0. " * 3, "a line"]
    docs = spark.createDataFrame(rows([(k, f"some text\n{x}\nmore") for k, x in enumerate(lines)] + [(500, None), (0, f"some text\n{lines[0]}\nmore")]), SCHEMA)
    found = license_scan.scan_licences(docs, model=model).collect()
    want = {}
    for k, x in enumerate(lines):
        family, p = model.predict(x)
        if family != license_scan.UNKNOWN:
            want[k] = (1, family, p)
    assert {r.doc_id: (r.line_no, r.family) for r in found} == {k: v[:2] for k, v in want.items()} and len(found) == len(want)
    assert all(abs(r.probability - want[r.doc_id][2]) < 1e-4 for r in found)
    assert all(r.confirmed for r in found if r.doc_id < len(lines) - 4 - len(license_scan.COUNTER))
    for r in found:
        w = re.findall("[a-z0-9]+", r.line.lower())
        held = [set(zip(t, t[1:], strict=False)) for t in (re.findall("[a-z0-9]+", t.lower()) for t in license_scan.TEMPLATES[r.family])]
        similarity = max(len(h & set(zip(w, w[1:], strict=False))) / len(h) for h in held)
        assert abs(r.similarity - similarity) < 1e-5 and r.confirmed == (r.similarity >= license_scan.MIN_SIMILARITY)
    assert license_scan.scan_licences(edge_docs, model=model).count() == 0 and license_scan.scan_licences(no_docs, model=model).count() == 0


def test_licences_without_cues_and_wrapped(spark):
    model = license_scan.LicenceModel()
    cut = "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and associated\ndocumentation files (the \"Software\"), to deal in the\nSoftware without restriction"
    texts = [(0, "CC BY-SA 4.0"), (1, f"a title\n\n{cut}\n\nthe end"), (2, "https://creativecommons.org/licenses/by-nc/4.0/"), (3, "modification, are permitted provided that the following conditions are met"), (4, "plain words")]
    found = license_scan.scan_licences(spark.createDataFrame(texts, "doc_id long, text string"), model=model).collect()
    whole = [r for r in found if r.doc_id == 1 and r.confirmed]
    assert [(r.line_no, r.family, r.line) for r in whole] == [(2, "mit", cut.replace("\n", " "))]
    want = {i: model.predict(t)[0] for i, t in texts if i != 1}
    assert {r.doc_id: r.family for r in found if r.doc_id != 1} == {i: f for i, f in want.items() if f != license_scan.UNKNOWN}
    assert want[0] == "cc-by"


def test_other_licences_are_unknown():
    model = license_scan.LicenceModel()
    for notice in ("licensed under the EUPL", "Artistic License", "Eclipse Public License", "Licensed under the Artistic License 2.0", "Released under the Zimbra License.", "SPDX-License-Identifier: QPL-1.0"):
        assert model.predict(notice)[0] == license_scan.UNKNOWN
    for notice, family in {"MIT License": "mit", "Apache License 2.0": "apache", "GNU General Public License v3": "gpl", "Mozilla Public License": "mpl", "CC BY-SA 4.0": "cc-by"}.items():
        assert model.predict(notice)[0] == family


def test_no_named_text_lacks_a_trigger():
    model, rng = license_scan.LicenceModel(), random.Random(2)
    names, triggers = sorted({w for g in model.features for w in g.split()}), set(model.triggers())
    quiet = [w for w in names if w not in triggers]
    assert model.predict(" ".join(quiet))[0] == license_scan.UNKNOWN
    for _ in range(300):
        text = " ".join(rng.choices(names, k=rng.randrange(1, 15)))
        assert model.predict(text)[0] == license_scan.UNKNOWN or triggers & set(text.split())


# helpers


def test_written_tables_go_on_release(spark):
    from pathlib import Path

    from frameloom.llm import common

    table = common.materialise(spark.range(5), "numbers")
    assert table.count() == 5
    folder = Path(common.shared_dir(spark).removeprefix("file:"))
    assert any(folder.iterdir())
    common.release(spark)
    assert not folder.exists()
    assert common.materialise(spark.range(3), "numbers").count() == 3


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from frameloom.llm import common

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(SimpleNamespace(conf={}, sparkContext=context))
