"""URL aliases, licence notices and vectors of odd sizes against plain searches."""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from parcelmart.llm import licenses, near_vectors, url_aliases

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found, self.base = [], None

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if tag == "base" and self.base is None:
            self.base = own.get("href")
        if tag == "link" and "canonical" in (own.get("rel") or "").lower().split():
            self.found.append(own.get("href") or "")
        if tag == "meta" and (own.get("http-equiv") or "").lower() == "refresh":
            m = re.search(r"url\s*=\s*[\"']?([^\"']*)", own.get("content") or "", re.I)
            self.found.append(m[1] if m else "")

    handle_startendtag = handle_starttag


def address(url):
    """Host and path of the contract, and the key of an address."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0].translate(UPPER)
    path, query = re.match(r"[^?#]*", rest[len(host):])[0], re.match(r"[^?#]*(\?[^#]*)?", rest)[1] or ""
    return host, path, (re.sub(r":(80|443)$", "", host) + (path or "/") + query) if host else None


def verdicts_brute(pages, redirects=()):
    near, own, rules = defaultdict(set), defaultdict(set), {}
    for i, url, html in pages:
        host, path, key = address(url)
        fits = [r for r in url_aliases.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rules[i] = max(fits, key=lambda r: len(str(r)), default=None)
        if rules[i] and key:
            own[key].add(rules[i].verdict)
        parser = Links()
        parser.feed(html or "")
        base = urljoin(url, parser.base) if parser.base and key else url
        for target in parser.found if key else ():
            there = address(urljoin(base, target.strip()))[2] if target.strip() else None
            if there:
                near[key].add(there)
                near[there].add(key)
    for a, b in redirects:
        near[address(a)[2]].add(address(b)[2])
        near[address(b)[2]].add(address(a)[2])
    out = {}
    for i, url, _ in pages:
        key = address(url)[2]
        seen, todo = set(), [key] if key else []
        while todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                todo += near[k]
        votes = {v for k in seen for v in own[k]}
        method = "allow" if "allow" in votes else "block" if votes else "allow"
        out[i] = (rules[i].verdict if rules[i] else method, min(seen, key=str.encode) if seen else None)
    return out


def test_aliases_are_those_of_a_search(spark):
    rnd = random.Random(21)
    hosts = ["a.net", "B.net:80", "c.example.org", "d.com", "e.fr", "f.org"]
    paths = ["/", "", "/es/x", "/en/1/y", "/fr/q", "/de/z", "/p/q/r.html", "/p/?a=1&b=2", "/p?b=2#t", "/x/"]
    url = lambda: rnd.choice(["http", "https"]) + "://" + rnd.choice(hosts) + rnd.choice(paths)
    relative = ["/es/x", "q", "../up", "./same", "..", "../../../top/x", "?z=1", "#part", "//d.com/de/z", "a/./b/../c", "//e.fr", "mailto:x@y.z", ""]
    forms = [
        '<link rel="canonical" href="{}">', "<link href='{}' rel='canonical'/>", "<LINK REL=canonical HREF={}>", '<link rel="alternate canonical" href="{}" >',
        '<meta http-equiv="refresh" content="0; url={}">', "<meta content='5;URL={}' http-equiv=Refresh>", '<!-- <link rel="canonical" href="{}"> -->',
        '<link rel="alternate" href="{}">', '<a href="{}">canonical</a>', '<link data-rel="canonical" href="{}">', '<link rel="canonical" data-href="{}">',
        '<base href="{}"><link rel="canonical" href="sub/x">',
    ]
    pages = []
    for i in range(400):
        target = rnd.choice([url(), rnd.choice(relative)])
        shown = target.replace("&", rnd.choice(["&amp;", "&#38;", "&#x26;"]))
        form = rnd.choice(forms)
        html = rnd.choice(["", "<p>text</p>", None]) if rnd.random() < 0.4 else f"<head>{form.format(shown) if shown or 'HREF={}' not in form else ''}</head>"
        pages.append((i, url(), html))
    pages += [(1000, None, forms[0].format("http://a.net/")), (1001, "no scheme", forms[0].format("http://a.net/")), (1002, "http://", ""), (5, pages[5][1], pages[5][2])]
    pages += [(1003, "http://long.net/", "<link " * 200_000), (1004, "http://long2.net/", "<!-- canonical " * 100_000)]
    redirects = [("http://a.net/old", "http://d.com/de/z"), ("http://a.net/old", "https://a.net/")]
    want = verdicts_brute(pages, redirects)
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("alias", F.lit("old")).repartition(4)
    moved = spark.createDataFrame(redirects, "src string, dst string")
    got = url_aliases.judge_urls(df, redirects=moved).collect()
    assert len(got) == len(pages)
    assert {r.page_id: (r.verdict, r.alias) for r in got} == want
    assert {v for v, _ in want.values()} == {"allow", "block"}


def test_spellings_are_a_choice(spark):
    df = spark.createDataFrame([(1, "http://www.d.com/de/x.html?ref=1", ""), (2, "http://d.com/de/x", "")], "page_id long, url string, html string")
    apart, together = (len({r.alias for r in url_aliases.judge_urls(df, spellings=s).collect()}) for s in (False, True))
    assert (apart, together) == (2, 1)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def test_base_phrases_are_those_of_a_plain_search(spark):
    rnd = random.Random(22)
    pieces = ["under", "the", "MIT", "license", "License", "apache", "version", "2", "cc", "by", "nc", "under the mit license", "Apache License, Version 2", "CC-BY/NC", "é", "x9"]
    rows = [(i, "".join(rnd.choice(pieces) + rnd.choice([" ", "\n", ", ", "-", "—", "\x7f"]) for _ in range(rnd.randint(0, 60)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "cc by nc " * 30_000), (7, rows[7][1]), (None, "under the MIT license")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).repartition(3)
    want = []
    for i, text in rows:
        own, places, labels = words(text), [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            found = [k for k in range(len(own)) if own[k : k + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        want.append((i, len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def notice(label, k=0):
    return [t for t in licenses.TEMPLATES if t.label == label][k].text


def test_mandatory_phrases_stand_in_their_notice(spark):
    two, three = notice("gpl-2"), notice("gpl-3", 1)
    rows = [
        (1, f"{two} Needs OpenGL version 3", {"gpl-2"}), (2, f"version 3 of this. {two}", {"gpl-2"}), (3, f"{two}\n\n{three}", {"gpl-2", "gpl-3"}),
        (4, notice("lgpl-2.1") + " version 3", {"lgpl-2.1"}), (5, notice("lgpl-3"), {"lgpl-3"}), (6, notice("agpl-3"), {"agpl-3"}), (7, notice("isc"), {"isc"}),
        (8, notice("bsd") + " " + notice("bsd-3"), {"bsd", "bsd-3"}), (9, notice("epl-2"), {"epl-2"}), (10, notice("cc0"), {"cc0"}), (11, notice("unlicense"), {"unlicense"}),
        (12, three.replace("it under", "it, please, under"), {"gpl-3"}), (13, "All rights reserved.", {"all-rights-reserved"}), (14, three.replace("version 3", "version 4"), set()),
        (15, "gnu general public license " * 2000 + "version 3 " * 2000, set()),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(2)
    frequencies = licenses.document_frequencies(df)
    assert frequencies[0] == len(rows) and frequencies[1]["program"] == sum("program" in words(r[1]) for r in rows)
    for found in (licenses.scan(df), licenses.scan(df, frequencies=frequencies)):
        assert {r.doc_id: set(filter(None, r.labels.split(","))) for r in found.collect()} == {i: labels for i, _, labels in rows}
    assert licenses.document_frequencies(df.limit(0)) == (0, {})
    with pytest.raises(ValueError, match="does not stand"):
        licenses.scan(df, (licenses.Template("x", "some words", ("other words",)),))


def test_vectors_of_extreme_size(spark):
    for size in (1e200, 1e-200, 1.7e308, 1e-310, 1.0):
        rows = [(i, [size * math.cos(0.3 * i), size * math.sin(0.3 * i)]) for i in range(7)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = {r.vec_id: r.n_links for r in near_vectors.link_vectors(df).collect()}
        assert got == {0: 1, 1: 2, 2: 2, 3: 2, 4: 2, 5: 2, 6: 1}, size
