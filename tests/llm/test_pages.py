"""Url rules and main text against plain Python and hand-made pages."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from groundwork.llm import host_boilerplate, queries, url_rules
from tests.llm.conftest import SF

RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
ODD_URLS = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en", "http://example.com/en/",
            "http://badexample.com/en/", "http://a.net/es/?q=http://b.com/", "http://com", "http://com/", "ftp://ÄB.net/fr/#?", "x://net?a/es/", "a://b://c.com/\n/d"]


def plain_judgement(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for rule in sorted(RULES, key=len):
        own, start = rule.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + start):
            best = rule
    return host, path, best


@pytest.fixture(scope="module")
def pages(spark):
    odd = spark.createDataFrame([(100_000 + i, u, None) for i, u in enumerate(ODD_URLS)] + [(None, ODD_URLS[5], "<p>x")] * 2, "page_id long, url string, html string")
    own = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").union(odd)
    return own.withColumns({"host": F.lit(1), "rule": F.lit(2), "tokens": F.lit(3), "text": F.lit(4), "sid": F.lit(5)})


def test_fixed_rules_equal_plain_python(pages):
    got = url_rules.judge(pages).collect()
    want = [(r.page_id, *plain_judgement(r.url)) for r in pages.collect()]
    assert sorted(map(repr, want)) == sorted(repr((r.page_id, r.host, r.path, r.rule)) for r in got)
    assert all(r.verdict == RULES[r.rule] if r.rule else r.verdict in ("allow", "block") for r in got)
    assert url_rules.judge(pages.limit(0)).count() == 0


def test_mined_rules_equal_brute_force(spark):
    baskets = [(["a", "b"], "block")] * 6 + [(["a", "c"], "allow")] * 5 + [(["b", "c"], "allow")] * 4 + [(["a", "b", "c"], "block")] * 3
    labelled = spark.createDataFrame(baskets, "tokens array<string>, verdict string")
    how = url_rules.Mining(support=0.1, confidence=0.6)
    got = {(tuple(r.left), r.verdict, round(r.confidence, 9)) for r in url_rules.mine(labelled, how).collect()}
    every = {}
    for n in (1, 2, 3):
        for left in combinations("abc", n):
            of = [v for t, v in baskets if set(left) <= set(t)]
            for verdict in ("allow", "block"):
                k = of.count(verdict)
                if k >= how.support * len(baskets) and k / len(of) >= how.confidence:
                    every[left, verdict] = k / len(of)
    want = {(left, v, round(c, 9)) for (left, v), c in every.items()
            if not any(every.get((part, v), 0) >= c for part in combinations(left, len(left) - 1))}
    assert got == want


def test_mined_rules_judge_urls_without_a_fixed_rule(spark):
    rows = [(i, f"http://ads{i % 3}.example.com/en/casino/{i}") for i in range(30)] + [(100 + i, f"http://site{i}.com/news/{i}") for i in range(30)]
    rows += [(200, "https://other.org/casino/9"), (201, "https://other.org/news/9")]
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[200] == (None, "block") and got[201] == (None, "allow")


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li>One<li>Two</ul></nav><!-- note --><div class="ad">Buy now</div>{body}
<div id="comments"><article class="comment"><p>First!</p></article></div><form>Search</form><footer>&copy; x</footer>"""


def text_of(page):
    return host_boilerplate.marked_text(host_boilerplate.blocks(page))


def test_marked_articles():
    body = """<article><header><h1>A &amp;  B</h1></header><p><b>One
      two.<br><p>Three<em>f</em>our &lt;x&gt; <aside>side</aside></p><div class="share-buttons">Share</div><ul><li>i</li><li>ii</ul></article>"""
    assert text_of(PAGE.format(body=body)) == "A & B\n\nOne two.\n\nThreefour <x>\n\ni\n\nii"
    assert text_of(PAGE.format(body="<main><p>Only main</p></main>")) == "Only main"
    assert text_of(PAGE.format(body="<p>Nothing marked</p>")) is None
    assert text_of("<article><p>cut off <b>here") == "cut off here"
    assert text_of('<article><p title="a > b">kept</p><script>x') == "kept"


def test_unmarked_pages_lose_what_their_host_repeats(spark):
    def word(i):
        return " ".join(f"w{i}x{j}" for j in range(30))
    shared = "all of our articles are free to read and to share with anyone you like"
    rows = [(i, f"http://host/p{i}", f"<div>{shared}</div><p>{word(i)}</p><div>{shared} again {i}</div>") for i in range(600)]
    rows += [(1000 + i, f"http://host/copy{i}", f"<div>{shared}</div><p>{word(9999)}</p>") for i in range(5)]
    rows += [(2000 + i, f"http://other/{i}", f"<p>{word(7777)}</p>") for i in range(2)] + [(3000, None, None), (3001, "x", ""), (None, "http://host/", "<p>a</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in host_boilerplate.main_text(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == word(i) for i in range(600)) and all(got[1000 + i] == word(9999) for i in range(5))
    assert got[2000] == got[2001] == word(7777) and got[3000] == got[3001] == "" and got[None] == "a"
    assert host_boilerplate.main_text(df.limit(0)).count() == 0


def test_runs_equal_brute_force():
    streams = [["a b c d e f g h i"], ["x a b c d e f g h i y"], ["b c d e f g h i", "a b c d e f g h"], ["short"]]
    hashes, counts = host_boilerplate.repeated_runs(streams, 8)
    want = {}
    for n, stream in enumerate(streams):
        words = [w for block in stream for w in [*block.split(), None]]
        for i in range(len(words) - 7):
            want.setdefault(tuple(words[i : i + 8]), set()).add(n)
    assert len(set(hashes.tolist())) == len(hashes) == len(want)
    assert sorted(counts.tolist()) == sorted(len(s) for s in want.values())


def test_pages_of_the_table(spark):
    got = queries.op10_main_text(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert all(r.text and r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_marked_articles_lose_what_is_boilerplate_of_their_host(spark, monkeypatch, sent):
    monkeypatch.setattr(host_boilerplate, "MAX_SENT_RUNS", sent)

    def words(i):
        return " ".join(f"w{i}x{j}" for j in range(20))
    call = "become a member today and read all of our stories without any delay"
    page = "<article><h1>{title}</h1><p>{lead}</p><div>{call}</div><p>{body}</p></article><footer>{call} page {i}</footer><aside>{teaser} more {i}</aside>"
    # every article has its own body; teasers quote the lead of article 0; a line that articles alone repeat; copies of an article
    rows = [(i, f"http://host/{i}", page.format(title=f"t{i}", lead=words(i), call=call, body=words("all"), i=i, teaser=words(0))) for i in range(6)]
    rows += [(100 + i, f"http://host/copy{i}", page.format(title="t0", lead=words(0), call=call, body=words("all"), i=i, teaser="")) for i in range(5)]
    # a host with the call in two articles only, one with the call in no stream outside
    rows += [(200 + i, f"http://two/{i}", page.format(title="t", lead=words(i % 2), call=call, body=words("all"), i=i, teaser="")) for i in range(6)]
    rows += [(300 + i, f"http://none/{i}", f"<article><p>{call}</p><p>{words(i)}</p></article>") for i in range(6)]
    got = {r.page_id: r.text for r in host_boilerplate.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    for i in range(6):
        assert got[i] == f"t{i}\n\n{words(i)}\n\n{words('all')}"
        assert got[200 + i] == f"t\n\n{words(i % 2)}\n\n{call}\n\n{words('all')}"
        assert got[300 + i] == f"{call}\n\n{words(i)}"
    assert all(got[100 + i] == f"t0\n\n{words(0)}\n\n{words('all')}" for i in range(5))
