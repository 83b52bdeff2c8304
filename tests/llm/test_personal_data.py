"""Personal data against the plain patterns, and the field's walk against all segmentations."""

from __future__ import annotations

import hashlib
import random
import re
import time
import tracemalloc

from pyspark.sql import functions as F

from parcelmart.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind: str, found: str) -> bool:
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        odd = sum(int(d) for d in digits[::-1][::2])
        even = sum(sum(divmod(2 * int(d), 10)) for d in digits[::-1][1::2])
        return 12 <= len(digits) <= 19 and (odd + even) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text: str):
    spans = [(m.start(), k, m.end()) for k, p in enumerate(PATTERNS.values()) for m in re.finditer(p, text) if passes(list(PATTERNS)[k], m[0])]
    return sorted(spans)


def test_patterns_are_those_of_the_contract(spark):
    rnd = random.Random(31)
    pieces = ["a.b", "@", "x-y", ".org", ".", "10", "255", "256", "4539148803436467", "4539 1488 0343 6467", "+1", "(988)", " ", "-", "555", "0", "é", "\n", "%", "+", "1.2.3.4", "word", "\u0663", "a@b.c"]
    rows = [(i, "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 60)))) for i in range(1500)]
    rows += [(2000, None), (2001, ""), (7, rows[7][1]), (None, "a@b.org 10.0.0.1"), (2002, "a@" * 20_000), (2003, "1.2.3.4 " * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_ip", F.lit("old")).repartition(3)
    got = {(r.doc_id, r.text): r for r in pii.find_personal_data(df).collect()}
    for i, text in rows:
        want, r = plain(text or ""), got[i, text]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, k, _ in want) for kind in range(4)], text
        joined = ",".join(f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        every = [tuple(s.split(":")) for s in r.spans.split(",") if s]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(",")) and every == sorted(every, key=lambda s: (int(s[1]), list(PATTERNS).index(s[0])))


def test_the_walk_finds_the_best_of_all_segmentations():
    field, rnd = pii.train(), random.Random(32)

    def total(island, atoms, spans):
        labels, at, out, known = [], 0, 0.0, {(i, j): k for i, j, k in spans}
        while at < len(atoms) - 1:
            end = next((j for (i, j) in known if i == at), None)
            labels.append(known[at, end] if end else 4)
            if end:
                out += field.score(pii._features_of(island, atoms, at, end, known[at, end]))
            at = end or at + 1
        return out + sum(field.weights.get(field.pair(a, b), 0.0) for a, b in zip([4, *labels], labels))

    def segmentations(n, found, at=0):
        if at >= n:
            yield []
            return
        yield from segmentations(n, found, at + 1)
        for i, j, k in found:
            if i == at:
                for rest in segmentations(n, found, j):
                    yield [(i, j, k), *rest]

    pieces = ["a@b.co", "10.0.0.1", "555-2485", "4539 1488 0343", "(988)", "x1", "+1", "."]
    for _ in range(60):
        island = " ".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 3)))
        atoms, found = pii.candidates(island)
        if len(found) > 22:
            continue
        place = {a: i for i, a in enumerate(atoms)}
        got = [(place[i], place[j], k) for i, k, j in field.best(island)]
        best = max(total(island, atoms, s) for s in segmentations(len(atoms) - 1, found))
        assert abs(total(island, atoms, got) - best) < 1e-9, island


def test_long_texts_take_time_and_memory_in_proportion():
    finder = pii.Finder(dict(pii.train().weights))
    digits = lambda n: " ".join(f"{i % 90 + 10}" for i in range(n))
    tracemalloc.start()
    finder.spans(digits(8_000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * 8_000 * 400  # bytes for each character
    mails = lambda n: " ".join(f"user{i}@host{i}.org" for i in range(n))
    seconds = []
    for n in (5_000, 20_000):
        start = time.process_time()
        assert len(finder.spans(mails(n))[0]) == n
        seconds.append(time.process_time() - start)
    assert seconds[1] < 8 * seconds[0]
