"""URL verdicts and license scans against plain versions."""

import math
import random
import re
import textwrap

import pytest

from dialgauge.llm import licenses, queries, urls

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def rule_of(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule in sorted(RULES, key=len):
        domain, start = rule.split("/", 1)
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start):
            best = rule
    return host, path, best


def test_whole_pages(spark, small):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = queries.op7_url_filter(spark, small).collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path, rule = rule_of(pages[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == RULES.get(rule, r["verdict"])


def test_awkward_urls(spark):
    given = [None, "", "no scheme/es/", "http://", "HTTP://WWW.Example.ORG/es/", "x://a.example.org?/es/", "http://org", "http://É.com/de/x#y", "a://b://c.com/de/", "http://notexample.org/en/1"]
    pages = spark.createDataFrame([(k, u, None, "z") for k, u in enumerate(given)] * 2, "page_id long, url string, html string, verdict string")
    rows = urls.judged(pages).collect()
    assert len(rows) == 2 * len(given)
    for r in rows:
        host, path, rule = rule_of(given[r["page_id"]])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, RULES.get(rule, "allow"))
    assert urls.judged(pages.limit(0)).count() == 0


def page(url, to=None, tag='<link rel="canonical" href="%s">'):
    return url, "<html><head>" + (tag % to if to else "") + "</head></html>"


def test_decisions_reach_aliases(spark):
    refresh, og = "<META HTTP-EQUIV=refresh CONTENT='0; URL=%s'>", "<meta property='og:url' content='%s'>"
    given = [
        page("http://shop.net/a", "http://x.com/de/1"),
        page("http://mirror.net/b", "http://shop.net/a", refresh),
        page("http://third.net/c?utm_source=q", "http://mirror.net/b", og),
        page("https://www.third.net/c/#top"),
        page("http://y.com/de/2", "http://y.com/fr/2"),
        page("http://copy.net/z", "//y.com/fr/2"),
        page("http://other.net/fine", "/elsewhere"),
        page("http://other.net/elsewhere"),
    ]
    pages = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(given)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judged(pages).collect()}
    assert [got[k] for k in range(4)] == [(None, "block")] * 4
    assert got[4] == ("com/de/", "block") and got[5] == (None, "allow")
    assert got[6] == got[7] == (None, "allow")


def test_relative_addresses(spark):
    refresh = "<meta http-equiv='refresh' content='0; url=%s'>"
    given = [
        page("http://y.com/de/a/page.html", "http://s.net/d/e/q.html"),
        page("http://s.net/d/e/one", "q.html"),
        page("http://s.net/d/e/two.html?x=1", "./q.html", refresh),
        page("http://s.net/d/x/three", "../e/q.html"),
        page("http://s.net/d/x/four", "http://s.net/d/./x/../e/q.html"),
        page("http://y.com/de/b", "http://t.net/p?a=1&amp;b=2"),
        page("http://t.net/p?k=7", "?a=1&#38;b=2"),
        page("http://t.net/r", "p?a=1&amp;b=2"),
        page("http://u.net", "/../../z/"),
        page("http://y.com/de/c", "http://u.net/z"),
        page("http://v.net/m", "mailto:a@y.com"),
        page("http://v.net/n", "#top"),
        page("none", "q.html"),
        ("http://w.net/long", "<p>" * 200_000 + '<link rel="canonical" href="/../long2">'),
        page("http://y.com/de/d", "http://w.net/long2"),
    ]
    pages = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(given)], "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urls.judged(pages).collect()}
    assert [k for k, v in sorted(got.items()) if v == "allow"] == [10, 11, 12] and len(got) == len(given)


PHRASES = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}


def scan(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    at = {n: [k for k in range(len(found)) if found[k : k + len(p)] == p] for n, p in PHRASES.items()}
    starts = [k for ks in at.values() for k in ks]
    base = sorted(n for n, ks in at.items() if ks)
    own = {}
    whole = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    for at in range(0, len(whole), 16):
        held = set(whole[at : at + 32])
        for label, template in licenses.TEMPLATES.items():
            words = set(licenses.template_words(template))
            if len(words & held) >= math.ceil(0.8 * len(words) - 1e-9):
                own[label] = max(own.get(label, 0), len(words & held) / len(words))
    score = 1.0 if starts else max(own.values(), default=0.0)
    return (len(found), len(starts), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted({*base, *own})), score)


COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def check_scans(rows, texts):
    for r in rows:
        got, want = [r[c] for c in COLUMNS], scan(texts[r["doc_id"]])
        assert got[:6] == list(want[:6]) and abs(got[6] - want[6]) < 1e-9, (texts[r["doc_id"]][:200], got, want)


def test_whole_table(spark, small):
    sf = small.replace("sf0.001", "sf0.01")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op8_license_scan(spark, sf).collect()
    assert len(rows) == len(texts) and any(r["labels"] for r in rows)
    check_scans(rows, texts)


@pytest.fixture(scope="module")
def mangled():
    rng = random.Random(8)
    texts = ["MIT license, mit License; LICENSE mit", "general public license mit license", "İmit license \u212a"]
    for template in licenses.TEMPLATES.values():
        parts = template.split()
        for _ in range(25):
            kept = [p for p in parts if rng.random() < 0.85]
            rng.shuffle(kept)
            texts.append("first line\n" + " ".join(["so", *kept, "and", *rng.sample(parts, 1), "more"]))
    return texts


@pytest.mark.parametrize("width", [12, 30, 70])
def test_wrapped_notices(make_docs, width):
    """Every template over several lines with comment marks, at all places, is found; its words far apart are not."""
    texts, labels = [], []
    for label, template in licenses.TEMPLATES.items():
        for before in range(0, 40, 3):
            lines = textwrap.wrap(template, width)
            texts.append("word " * before + "\n# " + "\n#  ".join(lines) + "\nmore text " * 20)
            labels.append(label)
        texts.append((" and" * 40).join(template.split()))
        labels.append("")
    rows = licenses.scanned(make_docs(texts)).collect()
    assert all(labels[r["doc_id"]] in r["labels"].split(",") for r in rows) and len(rows) == len(texts)
    check_scans(rows, texts)


def test_mangled_notices(make_docs, mangled):
    rows = licenses.scanned(make_docs(mangled)).collect()
    assert len(rows) == len(mangled) and len({r["labels"] for r in rows}) > 8
    check_scans(rows, mangled)


def test_awkward(awkward, no_docs):
    texts = {r["doc_id"]: r["text"] for r in awkward.collect()}
    rows = licenses.scanned(awkward).collect()
    assert len(rows) == 9
    check_scans(rows, texts)
    assert licenses.scanned(no_docs).count() == 0
