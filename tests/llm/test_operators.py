"""Numbered operators against brute force on small tables with NULLs, empty texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parcelmart.llm import bpe, kneser_ney, licenses, mixing, near_vectors, pii, probminhash, quality, registry, repeats, url_aliases

WORD = "[^\x20\x09-\x0d]+"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(seed: int = 5) -> list[tuple]:
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 5))) for _ in range(80)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    base = prose(160).split()
    near = base.copy()
    near[20] = "changed"
    rows = [(i, prose(rnd.randint(0, 150))) for i in range(40)]
    rows += [(100, " ".join(base)), (101, " ".join(near)), (102, " ".join(base)), (103, " ".join(base[:70]))]
    rows += [(104, None), (105, ""), (106, " \n\t "), (107, "One"), (108, prose(9) + "\n" + prose(9)), (109, "la la la " * 60)]
    rows += [(110, prose(3000)), (111, "x" * 5000), (None, prose(60)), (40, prose(30)), (40, prose(30)), (100, " ".join(base))]
    return rows


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, t, f"s{(i or 0) % 3}" if (i or 0) % 7 else None, 9, 1, "k") for i, t in texts()]
    schema = "doc_id long, text string, source string, score int, n_words int, kept string"
    return spark.createDataFrame(rows, schema).repartition(4).cache()


@pytest.fixture(scope="module")
def nothing(documents):
    return documents.limit(0)


def test_urls(spark):
    pages = [
        (1, "https://WWW.a.net/x.html?utm_a=1#t", "<p>"),
        (2, "http://a.net/x", "<link href='//b.example.org/es/q' rel=\"canonical\">"),
        (3, "http://sub.b.example.org/es/q", None),
        (4, "http://b.example.org/es/q", ""),
        (5, None, ""),
        (6, "no scheme", ""),
        (7, "http://c.net/?b=1&a=2", '<meta http-equiv="refresh" content="0; url=/x/">'),
        (8, "http://c.net/x", ""),
        (9, "http://d.com/fr/1", ""),
        (10, "http://d.com/de/1", "<link rel=canonical href=http://d.com/fr/1>"),
        (11, "http://d.com/en/1", "<link rel=canonical href=http://d.com/de/1>"),
        (1, "https://WWW.a.net/x.html?utm_a=1#t", "<p>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("verdict", F.lit("old"))
    got = {r.page_id: r for r in url_aliases.judge_urls(df).collect()}
    assert {i: r.verdict for i, r in got.items()} == {
        1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow",
        9: "allow", 10: "block", 11: "allow",
    }
    assert (got[1].host, got[1].path, got[1].rule, got[4].rule, got[5].host) == ("www.a.net", "/x.html", None, "example.org/es/", "")
    assert got[7].alias != got[5].alias and got[7].alias == got[8].alias
    assert url_aliases.judge_urls(df.limit(0)).count() == 0
    more = spark.createDataFrame([("http://c.net/x", "http://d.com/de/7")], "src string, dst string")
    pages_more = df.unionByName(spark.createDataFrame([(12, "http://d.com/de/7", "", "")], df.schema))
    assert {r.page_id: r.verdict for r in url_aliases.judge_urls(pages_more, redirects=more).collect()}[7] == "block"


def test_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 24))
    rows = [(i, (centres[i % 30] + 0.12 * rng.standard_normal(24)).astype("float32").tolist()) for i in range(240)]
    rows += [(300, rows[0][1]), (301, [2 * x for x in rows[0][1]]), (302, None), (303, [0.0] * 24), (304, [float("nan")] * 24)]
    rows += [(305, [None] * 24), (306, []), (307, [1.0, 2.0]), (308, [1.0, 2.0]), (None, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("c", F.lit(1))
    use = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    links, root = Counter(), {k: k for k in range(len(use))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(use)):
        for b in range(a + 1, len(use)):
            x, y = use[a][1], use[b][1]
            if len(x) == len(y) and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= 0.9:
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(use):
        if i is not None:
            least[find(k)] = i if least[find(k)] is None else min(i, least[find(k)])
    expected = [(i, links[k], least[find(k)]) for k, (i, _) in enumerate(use)]
    expected += [(i, 0, i) for i in (302, 303, 304, 305, 306)]
    got = [(r.vec_id, r.n_links, r.component_id) for r in near_vectors.link_vectors(df).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert near_vectors.link_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("order", [2, 3])
def test_language_model(spark, documents, nothing, order):
    rows = texts()
    model = kneser_ney.train(documents.filter("doc_id < 100"), order)
    got = Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in kneser_ney.score(documents, model).collect())
    tokens = lambda t: [w.translate(UPPER) for w in re.findall(WORD, t or "")] + ["</s>"]
    grams: list[Counter] = [Counter() for _ in range(order + 1)]
    words = Counter()
    for i, t in rows:
        if i is not None and i < 100:
            ws = tokens(t)
            words.update(ws)
            padded = ["<s>"] * (order - 1) + ws
            grams[order].update(tuple(padded[k : k + order]) for k in range(len(ws)))
    for k in range(order, 1, -1):
        grams[k - 1] = Counter(g[1:] for g in grams[k])
    discount, total, freed = {}, {}, {}
    for k in range(1, order + 1):
        n = Counter(grams[k].values())
        discount[k] = kneser_ney.discounts([n[1], n[2], n[3], n[4]])
        total[k], freed[k] = Counter(), Counter()
        for g, c in grams[k].items():
            total[k][g[:-1]] += c
            freed[k][g[:-1]] += discount[k][min(c, 3) - 1]

    def p(g):
        low = p(g[1:]) if len(g) > 1 else 1 / (len(words) + 1)
        t = total[len(g)][g[:-1]]
        c = grams[len(g)][g]
        return low if not t else (max(c - discount[len(g)][min(c, 3) - 1], 0) if c else 0) / t + freed[len(g)][g[:-1]] / t * low

    n, v = sum(words.values()), len(words)
    expected = Counter()
    for i, t in rows:
        ws = tokens(t)
        padded = ["<s>"] * (order - 1) + ws
        score = sum(math.log10(p(tuple(padded[k : k + order]))) for k in range(len(ws)))
        base = sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        expected[(i, len(ws), sum(w in words for w in ws), n, round(base, 6), round(score, 6))] += 1
    assert got == expected
    probe = [(w,) if order == 1 else ("<s>",) * (order - 2) + ("<s>", w) for w in [*words, "unseen"]]
    assert sum(p(g) for g in probe) == pytest.approx(1)
    if order == 2:
        empty = kneser_ney.train(nothing)
        assert {r.n_known for r in kneser_ney.score(documents, empty).collect()} == {0}
        assert kneser_ney.score(nothing, model).count() == 0


def test_quality(spark, documents, nothing):
    trusted = spark.createDataFrame([(3,), (4,), (5,), (None,), (4,)], "doc_id long")
    hashed = lambda w: xxhash.xxh64_intdigest(w.encode(), 42)
    signed = lambda h: h - (1 << 64) if h >> 63 else h

    def grams(ws):
        h = [hashed(w) for w in ws]
        pairs = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(h, h[1:])]
        return [signed(x) % 1000 for x in h + pairs]

    rows = texts()
    raw, target = Counter(), Counter()
    for i, t in rows:
        g = grams(re.findall(WORD, t or ""))
        raw.update(g)
        if i in (3, 4, 5):
            target.update(g)
    share = lambda c, b: (c[b] + 0.5) / (sum(c.values()) + 500)
    expected = []
    for i, t in rows:
        ws, lines = re.findall(WORD, t or ""), [x for x in (t or "").split("\n") if re.search(WORD, x)]
        seen = Counter(zip(ws, ws[1:], ws[2:]))
        covered = {k + d for k, w in enumerate(zip(ws, ws[1:], ws[2:])) if seen[w] > 1 for d in range(3)}
        g = grams(ws)
        score = sum(math.log(share(target, b) / share(raw, b)) for b in g) / len(g) if g else 0.0
        failed = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
        symbols = len(re.findall(r"[#*$%&|<>]", t or ""))
        expected.append((i, len(ws), sum(map(len, ws)), symbols, len(lines) - len(set(lines)), len(covered), failed, not failed and score >= -0.1, round(score, 9)))
    judged = quality.judge(documents, trusted, least_score=-0.1, n=1000)
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, round(r.score, 9)) for r in judged.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert judged.filter("kept").count() == sum(e[7] for e in expected)
    assert quality.judge(nothing, trusted).count() == 0
    assert {r.score for r in quality.judge(documents, trusted.limit(0)).collect()} == {0.0}


def test_licences(spark, nothing):
    header = licenses.TEMPLATES[3].text
    rows = [
        (1, "Code under the MIT-License, and Apache license version 2", 2, "apache-2,mit"),
        (2, "Ce texte: CC BY-NC 4.0. under the mit\nlicense", 2, "cc-by-nc,mit"),
        (3, "/* " + header.replace(" is free", "\n * is free") + " */", 0, "gpl-3"),
        (4, "Permission is given to copy. Free software of the foundation, any later version.", 0, ""),
        (5, None, 0, ""),
        (6, "", 0, ""),
        (7, "All rights reserved.", 0, "all-rights-reserved"),
        (8, "Copyright 2020. All rights reserved.", 0, "all-rights-reserved"),
        (9, "word " * 20000 + licenses.TEMPLATES[0].text, 0, "mit"),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").withColumn("labels", F.lit("old"))
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, _, n, labels in rows:
        assert (got[i].n_base, got[i].labels) == (n, labels), i
        assert 0 <= got[i].score <= 1
    assert (got[1].first_word, got[1].last_word, got[1].base_labels) == (1, 6, "apache-2,mit")
    assert (got[5].n_words, got[5].first_word) == (0, None)
    assert licenses.scan(df).filter("labels = 'gpl-3'").count() == 1
    assert licenses.scan(nothing).count() == 0


def test_near_duplicates(documents, nothing):
    got = Counter((r.doc_id, r.class_id) for r in probminhash.near_duplicates(documents).collect())
    rows = texts()
    bags = []
    for _, t in rows:
        ws = [w.translate(UPPER) for w in re.findall(WORD, t or "")]
        bags.append(Counter(tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))) if ws else Counter())

    def jaccard(a, b):
        return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())

    root = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            if bags[x].keys() & bags[y].keys() and jaccard(bags[x], bags[y]) >= 0.8:
                old, new = root[x], root[y]
                root = [new if r == old else r for r in root]
    ids = lambda r: [i for (i, _), q in zip(rows, root) if q == r and i is not None]
    assert got == Counter((i, min(ids(r), default=None)) for (i, _), r in zip(rows, root))
    assert probminhash.near_duplicates(nothing).count() == 0


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    common = rng.integers(1, 1 << 63, 60).astype(np.uint64)
    a = np.sort(np.concatenate([common, rng.integers(1, 1 << 63, 20).astype(np.uint64)]))
    b = np.sort(np.concatenate([common, rng.integers(1, 1 << 63, 9).astype(np.uint64)]))
    wa, wb = rng.integers(1, 5, len(a)), rng.integers(1, 5, len(b))
    exact = probminhash.probability_jaccard(a, wa, b, wb)
    slow = sum(
        1 / sum(max(dict(zip(a, wa)).get(e, 0) / x, dict(zip(b, wb)).get(e, 0) / dict(zip(b, wb))[d]) for e in {*a, *b})
        for d, x in zip(a, wa) if d in set(b)
    )
    rows = np.repeat([0, 1], [len(a), len(b)])
    s = probminhash.signatures(rows, np.concatenate([a, b]), np.concatenate([wa, wb]), 2, 4096)
    assert exact == pytest.approx(slow) and abs((s[0] == s[1]).mean() - exact) < 0.03


def test_personal_data(spark, nothing):
    rows = [
        (1, "é mail a.b@c.example.org, 10.0.0.1 and +1 (988) 555-2485."),
        (2, "card 4539 1488 0343 6467 no 4539 1488 0343 6468 v4.0. a@b 999.1.1.1"),
        (3, None),
        (4, ""),
        (5, "call (988) 555-2485 or 415-555-2671 in 2024-01-31"),
        (6, "clean words only\n" * 3000),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1))
    got = {r.doc_id: r for r in pii.find_personal_data(df, redacted=True).collect()}
    one = "email:7:24,ip:26:34,phone:39:56"
    assert (got[1].spans, got[1].base_sha256) == (one, hashlib.sha256(one.encode()).hexdigest())
    assert got[1].redacted_text == "é mail [EMAIL], [IP] and [PHONE]."
    assert (got[2].n_card, got[2].n_ip, got[2].n_email, got[2].spans) == (1, 0, 0, "card:5:24")
    assert (got[3].spans, got[3].redacted_text, got[4].spans, got[6].spans) == ("", None, "", "")
    assert got[5].n_phone == 0 and got[5].spans == "phone:5:19,phone:23:35"
    assert pii.find_personal_data(nothing).count() == 0


def test_semi_markov_field_on_held_out_examples():
    field, held_out = pii.train(), pii.examples(200, seed=11)
    right = sum(sorted(field.best(text)) == sorted(spans) for text, spans in held_out)
    assert right >= 0.95 * len(held_out)


def test_mixing(spark, documents, nothing):
    rng = random.Random(2)
    rows = [(i, f"s{i % 4}" if i % 9 else None, rng.randint(0, 60)) for i in range(9000)] + [(1, "s1", 7), (1, "s1", 7), (None, "z", 0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows) and all(0 <= r.copies <= 2 and r.taken == r.copies * r.size for r in got)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    want, open_, rest = {}, list(order), 1.5 * sum(sizes.values())
    while True:
        level = rest / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not full:
            break
        for s in full:
            want[s] = 2 * sizes[s]
            rest -= want[s]
            open_.remove(s)
    want.update({s: level * weight[s] for s in open_})
    for s in order:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= max(60, 0.02 * want[s])
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(df.repartition(7)).collect()))
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_pivotal_keeps_the_sum_and_the_chances():
    rng = np.random.default_rng(1)
    p = rng.random(7)
    total = np.zeros(7)
    for _ in range(4000):
        out, held = pivotal_all(p, rng)
        total += out
        assert abs(out.sum() - p.sum()) < 1
    assert np.abs(total / 4000 - p).max() < 0.05


def pivotal_all(p, rng):
    out, held = mixing.pivotal(p, rng.random(len(p)))
    if held >= 0:
        out[held] = float(rng.random() < out[held])
    return out, held


def test_byte_bpe(spark, documents, nothing):
    tiktoken = pytest.importorskip("tiktoken")
    path = registry.ranks_path()
    ranks = bpe.read_ranks(path)
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    extra = [(900, "I'll <|endoftext|> 日本語 \x00\x1c\x1f   ½ ²3 don'T\r\n\n  x"), (901, "▁a ▁ ﻿ é é 🙂" * 50)]
    rows = texts() + extra
    df = documents.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string")).withColumn("n_tokens", F.lit("old"))
    digest = lambda b: hashlib.sha256(b).hexdigest()
    expected = Counter()
    for i, t in rows:
        ids = other.encode_ordinary(t or "")
        expected[(i, len(ids), digest(",".join(map(str, ids)).encode()), digest((t or "").encode()))] += 1
    got = bpe.digest_documents(df, path).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == expected
    decoded = bpe.decode_documents(bpe.encode_documents(df, path), path)
    assert decoded.filter("decoded <> cast(coalesce(text, '') as binary)").count() == 0
    assert bpe.digest_documents(nothing, path).count() == 0


def brute_repeats(rows, length, keep_first):
    order = lambda i: 2**63 if i is None else i
    seen = defaultdict(list)
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]].append((order(i), p))
    out = []
    for i, b in raw:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            places = seen[b[p : p + length]]
            if len(places) > 1 and (not keep_first or (order(i), p) != min(places)):
                gone[p : p + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_longest_previous_factors():
    rng = np.random.default_rng(8)
    for n, letters in ((1, 2), (60, 2), (400, 3), (300, 1)):
        data = rng.integers(97, 97 + letters, n + 20).astype(np.uint8)
        starts = np.arange(n)
        earlier, later = repeats.previous_factors(data, starts, 20)
        text = data.tobytes()

        def shared(i, j):
            return next((k for k in range(20) if text[i + k] != text[j + k]), 20)

        assert earlier.tolist() == [max([shared(i, j) for j in range(i)], default=0) for i in range(n)]
        assert later.tolist() == [max([shared(i, j) for j in range(i + 1, n)], default=0) for i in range(n)]


@pytest.mark.parametrize("zones", [1000, 2])
@pytest.mark.parametrize("keep_first", [True, False])
def test_repeats(spark, monkeypatch, zones, keep_first):
    monkeypatch.setattr(repeats, "GROUP_ZONES", zones)
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(0, 300))) for _ in range(12)]
    rows = []
    for i in range(50):
        parts = [(s := rnd.choice(base))[(a := rnd.randint(0, len(s))) : a + rnd.randint(0, 250)] for _ in range(rnd.randint(0, 4))]
        rows.append((i, "".join(parts)))
    rows += [(500, None), (501, ""), (None, rows[3][1]), (502, "a" * 700), (503, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_bytes", F.lit("old")).repartition(4)
    got = repeats.remove_repeats(df, length=40, anchor=12, keep_first=keep_first).collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(rows, 40, keep_first)
    if zones == 2:
        assert repeats.remove_repeats(df.limit(0)).count() == 0
