"""Site style trees against a naive tree, and pages that wrap, copy, nest or never close."""

import math
import random
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest
from termweave.llm import _shared, pagetext
from termweave.llm.queries import QUERIES

PAGES = "page_id long, url string, html string"


def texts(spark, rows, **named):
    _shared.ship(spark)
    return {r["page_id"]: r["text"] for r in pagetext.extract(spark.createDataFrame(rows, PAGES), **named).collect()}


@pytest.mark.parametrize("depth", [3, 5, 8])
def test_deep_wrappers(spark, depth):
    page = lambda i: f"<body><p>Our shop is great</p>{'<div class=wrap>' * depth}<article><h1>Title {i}</h1><p>Story {i} of {i * 7}</p></article>{'</div>' * depth}</body>"
    got = texts(spark, [(i, f"http://h/{i}", page(i)) for i in range(60)])
    assert got == {i: f"Title {i}\nStory {i} of {i * 7}" for i in range(60)}


@pytest.mark.parametrize("copies", [30, 60])
def test_copies_are_no_template(spark, copies):
    page = lambda i: f"<body><p>Our shop is great</p><article><h1>Title {i}</h1><p>Story {i} of {i * 7}</p></article></body>"
    of = lambda i: 0 if i < copies else i
    got = texts(spark, [(i, f"http://h/{i}", page(of(i))) for i in range(90 if copies == 30 else 60)])
    seen = "Our shop is great\n" if copies == 60 else ""  # one page alone tells no template
    assert got == {i: f"{seen}Title {of(i)}\nStory {of(i)} of {of(i) * 7}" for i in got}


class Naive(HTMLParser):
    """Well-formed pages to a plain tree: [(path, text or None, children)] in order of the texts and ends of elements."""

    def __init__(self, page):
        super().__init__()
        self.path, self.children, self.seen = ("named" if "<article" in page else "",), [[]], []
        self.feed(page)
        self.seen.append((self.path, None, self.children.pop()))

    def handle_starttag(self, tag, attrs):
        name = tag + "".join("." + v.split()[0] for k, v in attrs if k == "class")
        self.children[-1].append(name)
        self.path += (name,)
        self.children.append([])

    def handle_endtag(self, tag):
        self.seen.append((self.path, None, self.children.pop()))
        self.path = self.path[:-1]

    def handle_data(self, data):
        if data.strip():
            self.seen.append((self.path, data, None))


def entropy(values):
    m = sum(values.values())
    return 1.0 if m < 2 else -sum(n / m * math.log(n / m) for n in values.values()) / math.log(m)


def naive_removed(rows):
    """(host, path) of the nodes that both trees, by the definition, find unimportant."""
    host = lambda url: url.split("/")[2]
    own, every = defaultdict(Counter), defaultdict(Counter)
    pages = {(host(url), html) for _, url, html in rows}
    for h, html in pages:
        for path, text, children in Naive(html).seen:
            own[h, path, text is None][text if text is not None else tuple(children)] += 1
    for html in {html for _, html in pages}:
        for path, text, children in Naive(html).seen:
            every[path, text is None][text if text is not None else tuple(children)] += 1
    of_all = {}
    for (path, style), values in every.items():
        if sum(values.values()) >= pagetext.SEEN:
            of_all[path, style] = entropy(values)
            parts = [v for (_, p, s), v in own.items() if (p, s) == (path, style) and sum(v.values()) > 1]
            if sum(sum(v.values()) for v in parts) >= pagetext.SEEN:
                full = sum(sum(v.values()) * math.log(sum(v.values())) for v in parts)
                within = sum(entropy(v) * sum(v.values()) * math.log(sum(v.values())) for v in parts) / full
                of_all[path, style] = min(of_all[path, style], within)

    def judged(h, path, style):
        values, outside = own[h, path, style], path[0] and "article" not in path
        mine = entropy(values) if sum(values.values()) >= pagetext.SEEN else None
        found = [x for x in (mine, of_all.get((path, style))) if x is not None]
        return (min(found) if outside else found[0]) if found else None

    removed = set()
    for h, path, style in own:
        if style or path[-1] in ("article", "", "body") or path[-1] == "h1" and "article" in path:
            continue
        content = judged(h, path, False)
        if content is not None:
            shown = judged(h, path[:-1], True)
            value = pagetext.SHARE * content + (1 - pagetext.SHARE) * (1.0 if shown is None else shown)
            bound = pagetext.LEAST_INSIDE if "article" in path else pagetext.LEAST_OUTSIDE if path[0] else pagetext.LEAST
            if value < bound - 1e-9:
                removed.add((h, path))
    return removed


def some_pages(seed=3):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice("house river winter people morning little".split()) + str(rng.randint(0, 400)) for _ in range(n))
    rows, lines = [], [say(4) for _ in range(12)]
    for i in range(260):
        h = i % 9 if i % 3 else 0
        items = "".join(f"<li>{lines[(h + k) % 12]}</li>" for k in range(rng.randint(2, 4)))
        article = f"<h1>{say(3)}</h1>" + "".join(f"<p>{say(8)}</p>" for _ in range(rng.randint(1, 4))) + f"<div class=tag>{rng.choice(lines[:2])}</div>"
        if h < 6:
            page = f"<body><div class=site>{lines[h]}<ul class=tops>{items}</ul></div><div class=note>{rng.choice(lines)}</div><article>{article}</article><div class=end>{say(2)}</div></body>"
        else:
            page = f"<body><div class=site>{lines[h]}</div><ul class=tops>{items}</ul><div class=text>{article}</div></body>"
        rows.append((i, f"http://h{h}.example/{i}", page))
    return rows + [(1000 + k, url, html) for k, (_, url, html) in enumerate(rows[:40])]


def test_naive_tree(spark):
    rows = some_pages()
    want = naive_removed(rows)
    assert len(want) > 10 and len({h for h, _ in want}) > 3
    hashed = {}
    for _, url, html in rows:
        page = pagetext.Page(html)
        for k in range(1, len(page.tags)):
            path, at = [], k
            while at > 0:
                path.insert(0, page.names[at])
                at = page.up[at]
            hashed["named" if page.named else "", *path] = page.paths[k]
    got = {(r["host"], r["path"]) for r in pagetext.trees(pagetext.styles(spark.createDataFrame(rows, PAGES).repartition(3))).collect()}
    assert got == {(h, hashed[path]) for h, path in want}


def test_the_tree_decides(spark):
    rows = some_pages(4)
    sent, joined, off = texts(spark, rows), texts(spark, rows, sent=0), texts(spark, rows, seen=10**9)
    assert sent == joined and sum(sent[k] != off[k] for k in sent) > 100
    removed = naive_removed(rows)
    for i, url, html in rows[:60]:
        want = [t for path, t, _ in Naive(html).seen if t and (url.split("/")[2], path) not in removed]
        assert sent[i] == "\n".join(want)


@pytest.mark.parametrize(
    "html",
    [
        '<div class="layout has-sidebar"><article><p>Story</p></article></div>',
        '<article class="post login howto"><p>Story</p></article>',
        '<article class="social"><p>Story</p></article>',
        '<section id="related-work"><p>Story</p></section>',
        "<form id=whole><nav>Home</nav><article><p>Story</p></article></form>",
        '<div class="site no-comments"><p>Story</p><div class="comments"><article><p>Nice!</p></article></div></div>',
        "<div role=main><p>Story</p><div hidden>No</div><div role=complementary>No</div></div>",
    ],
)
def test_words_of_a_class_remove_no_article(spark, html):
    assert texts(spark, [(1, "http://h/", f"<body>{html}</body>")]) == {1: "Story"}


@pytest.mark.parametrize("html", ["<svg>", "<div>", "<a ", '<a =">" ', "<li>x", "<p>x", "<", "<!", "</svg ", "<textarea>", "<b class='"])
def test_long_pages_take_linear_time(html):
    began = time.time()
    page = pagetext.Page(html * 100_000)
    page.text(frozenset()), page.occurrences()
    assert time.time() - began < 20


def test_query_and_clashing_columns(spark, tmp_path):
    rows = [*some_pages(5), (None, None, None), (7, "no url", "x" * 300_000), (8, "", "")]
    extra = spark.createDataFrame([(*r, "mine", "mine", "mine", "mine") for r in rows], PAGES + ", host string, payload string, removed string, text string")
    extra.write.parquet(str(tmp_path / "pages.parquet"))
    got = QUERIES["op8_pagetext"](spark, str(tmp_path))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = texts(spark, rows)
    for r in got.collect():
        assert r["n_chars"] == len(r["text"]) and (r["page_id"] in (7, 8) or r["text"] == want[r["page_id"]])
    assert got.count() == len(rows)
