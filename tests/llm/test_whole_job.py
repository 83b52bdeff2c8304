"""Cases that shortcuts have lost: repeated texts, repeated rows, several notices in a file, thresholds from the data."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parcelmart.llm import bpe, licenses, mixing, pii, probminhash, quality, registry, url_aliases


def prose(rnd: random.Random, n: int) -> str:
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 8))) for _ in range(n))


def test_near_duplicates_of_a_text_written_several_times(spark):
    rnd = random.Random(6)
    once, other, passage, own = (prose(rnd, 160) for _ in range(4))
    rows = [
        (1, once), (2, f"{once} {once}"), (3, f"{once} {once} {once}"), (4, other), (5, f"{other} {once}"),
        (6, f"{passage} {passage} {passage} {own[:100]}"), (7, f"{passage} {own[:100]}"), (8, own),
    ]

    def jaccard(a, b):
        return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())

    bags = {i: Counter(zip(*(t.split()[k:] for k in range(5)))) for i, t in rows}
    group = {i: i for i in bags}
    for i in bags:
        for j in bags:
            if j < i and jaccard(bags[i], bags[j]) >= 0.8:
                group = {k: min(group[i], group[j]) if g in (group[i], group[j]) else g for k, g in group.items()}
    assert (group[2], group[3], group[7]) == (1, 1, 6)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.class_id for r in probminhash.near_duplicates(df).collect()} == group


def test_licence_notices_among_words_of_other_notices(spark):
    rnd = random.Random(5)
    common = sorted({w for t in licenses.TEMPLATES for w in licenses.template_words(t.text)})
    salad = lambda n: " ".join(rnd.choice(common) for _ in range(n))
    story = "Your work was published as a program. It is provided with an option to look at source code, either whole or by version. "
    rows, expected = [], {}
    for k, t in enumerate(licenses.TEMPLATES):
        # Each notice alone, amid ordinary prose, after words of all notices, and with the notice after it.
        after = licenses.TEMPLATES[(k + 1) % len(licenses.TEMPLATES)]
        for j, text in enumerate((t.text, story * 3 + t.text + " " + story, salad(400) + "\n" + t.text + "\n" + salad(400), t.text + "\n" + after.text)):
            rows.append((10 * k + j, text))
            expected[10 * k + j] = {t.label, after.label} if j == 3 else {t.label}
    rows.append((1000, "\n\n".join(t.text for t in licenses.TEMPLATES)))
    expected[1000] = {t.label for t in licenses.TEMPLATES}
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for i, labels in expected.items():
        assert labels <= set(got[i].labels.split(",")), (i, got[i].labels)
        assert got[i].score == 1.0 or abs(got[i].score - 1) < 1e-9
    assert licenses.scan(spark.createDataFrame([(1, story * 9 + salad(900))], "doc_id long, text string")).first().labels == ""


def test_quality_threshold_comes_from_the_trusted_documents(spark):
    rnd = random.Random(4)
    words = [prose(rnd, 1) for _ in range(300)]
    good = lambda: " ".join(rnd.choice(words) for _ in range(120))
    littered = lambda: " ".join(rnd.choice(words) + rnd.choice(["", " ###", " $$$", " %%%"]) for _ in range(120))
    rows = [(i, good()) for i in range(400)] + [(1000 + i, littered()) for i in range(40)] + [(2000, "short"), (2001, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    trusted = spark.createDataFrame([(i,) for i in range(300)] + [(2000,), (None,)], "doc_id long")
    got = {r.doc_id: r for r in quality.judge(df, trusted).collect()}
    least = min(got[i].score for i in range(300))
    assert all(got[i].kept == (not got[i].base_failed and got[i].score >= least) for i in got)
    assert all(got[i].kept for i in range(300)) and not any(got[1000 + i].kept for i in range(40))
    many = spark.range(2500).select((F.col("id") % 1250).cast("double").alias("score"))
    assert quality.threshold(many).first().least == 1.0
    assert all(r.kept != r.base_failed for r in quality.judge(df, trusted.limit(0)).collect())


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def rows_of(df) -> Counter:
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_pipeline_near_duplicates_of_repeated_ids(spark):
    rnd = random.Random(9)
    a, b, c, d, e = (prose(rnd, 120) for _ in range(5))
    near = lambda t: t + " ending"
    # Groups: rows that repeat each other, other texts of one id, near copies of a text whose id another kept row bears.
    groups = [
        [(1, a), (1, a), (1, a), (5, near(a))],
        [(1, b), (2, near(b)), (2, near(b))],
        [(2, c), (3, near(c))],
        [(3, d), (3, near(d))],
        [(None, e), (7, near(e))],
    ]
    wordless = [(8, ""), (8, ""), (9, None), (9, None)]
    rows = [(i, t, "en", f"s{len(t or '') % 2}", len(t or "")) for g in [*groups, wordless] for i, t in g]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = rows_of(corpus_pipeline.near_duplicates(spark, df, ""))
    left = Counter((i, t) for (i, t, *_), n in got.items() for _ in range(n))
    for g in groups:
        mine = [x for x in set(g) if x in left]
        least = min((i for i, _ in g if i is not None), default=None)
        assert len(mine) == 1 and left[mine[0]] == 1 and mine[0][0] == least, (g, mine)
    assert Counter({x: left[x] for x in wordless}) == Counter(wordless)
    assert sum(left.values()) == len(groups) + len(wordless)
    assert got == rows_of(corpus_pipeline.near_duplicates(spark, df.repartition(5), ""))


def test_pipeline_mixing_of_repeated_rows(spark):
    rnd = random.Random(10)
    text = prose(rnd, 40)
    rows = [(i, prose(rnd, rnd.randint(20, 60)), "en", f"s{i % 3}", 1) for i in range(300)]
    rows += [(5, text, "en", "s1", 1)] * 60 + [(5, text + " more", "en", "s1", 1)] * 20 + [(6, prose(rnd, 40), "en", "s1", 1) for _ in range(20)]
    rows += [(None, text, None, "s2", 1)] * 10 + [(None, text, "s2", None, 1)] * 10
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got, given = rows_of(corpus_pipeline.source_mixing(spark, df, "")), Counter(rows)
    assert got.keys() <= given.keys() and all(n <= 2 * given[r] for r, n in got.items())
    sized = [(k, r[3], len(r[1].split())) for k, r in enumerate(rows)]
    mixed = corpus_pipeline.mixing.mix_sources(spark.createDataFrame(sized, "doc_id long, source string, size long")).collect()
    for source, target in {r.source: r.target for r in mixed}.items():
        taken = sum(n * len(r[1].split()) for r, n in got.items() if r[3] == source)
        assert abs(taken - target) <= max(61, 0.02 * target), (source, taken, target)
    assert got == rows_of(corpus_pipeline.source_mixing(spark, df.repartition(5), ""))


def test_mixing_deals_like_rows_over_blocks(spark, monkeypatch):
    rounds, stage = [], mixing.stage

    def watched(df, name):
        out = stage(df, name)
        rounds.extend([out] if name == "mix-round-0" else [])
        return out

    monkeypatch.setattr(mixing, "stage", watched)
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.lit(10).alias("size"))
    rows = rows.unionByName(spark.range(500).select(F.col("id").alias("doc_id"), F.lit("b").alias("source"), F.lit(40).alias("size")))
    got = mixing.mix_sources(rows).collect()
    assert len(got) == 20_500
    assert rounds[0].groupBy("_source", "_block").count().agg(F.max("count")).first()[0] <= 8_000
    for source in "ab":
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 40 and max(r.copies for r in own) <= 2


def test_blocks_keep_pairs_four_deviations_under_the_similarity():
    n = probminhash.BLOCK_REGISTERS
    agree = 0.8 - 4 * (0.8 * 0.2 / n) ** 0.5
    one = np.arange(n, dtype=np.uint32)
    two = np.where(np.floor((one + 1) * agree) > np.floor(one * agree), one, one + n).astype(np.uint32)
    block = pd.DataFrame(
        [(7, 0, c, c, 0, 0, 0, bands, r.tobytes()) for c, bands, r in ((b"a", [1, 2], one), (b"b", [1, 3], two))],
        columns=["bucket", "band", "c", "component", "own", "low", "high", "bands", "registers"],
    )
    assert probminhash._block_pairs(0.8)(block).to_numpy().tolist() == [[b"a", b"b"]]
    far = block.assign(registers=[one.tobytes(), np.where(one % 2 == 0, one, one + n).astype(np.uint32).tobytes()])
    assert not len(probminhash._block_pairs(0.8)(far))


def test_refresh_counts_beside_a_canonical_link(spark):
    refresh = '<meta http-equiv="refresh" content="0; url=%s">'
    pages = [
        (1, "http://here.com/a", '<link rel="canonical" href="http://here.com/a">' + refresh % "http://b.example.org/es/q"),
        (2, "http://b.example.org/es/q", ""),
        (3, "http://here.com/c", '<link rel="canonical" href="http://here.com/d">' + refresh % "http://b.example.org/es/q"),
        (4, "http://here.com/d", None),
        (5, "http://here.com/e", '<link rel="canonical" href="http://here.com/e">'),
    ]
    got = url_aliases.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.verdict for r in got} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}


def test_trusted_texts_are_found_without_moving_the_others(spark):
    rnd = random.Random(14)
    rows = [(i, prose(rnd, 60)) for i in range(400)] + [(None, prose(rnd, 60)), (3, prose(rnd, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    trusted = spark.createDataFrame([(i,) for i in range(0, 400, 9)] + [(0,), (None,), (10**12,)], "doc_id long")
    want = sorted(t for i, t in rows if i is not None and i % 9 == 0)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for size in ("-1", threshold):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
        found = quality.trusted_texts(docs, trusted)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        assert sorted(r.text for r in found.collect()) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    keys = spark.range(0, 2000, 2).toDF("k")
    for bits in (1 << 15, 1 << 17):
        known = quality.key_filter(keys, "k", bits).first().bits
        assert len(known) == bits >> 15
        through = spark.range(20_000).withColumn("in", quality.may_hold(quality.key_filter(keys, "k", bits).select("bits").scalar(), F.col("id"), bits))
        hits = {r.id for r in through.filter("in").collect()}
        assert set(range(0, 2000, 2)) <= hits and len(hits) < 1000 + 19_000 * 0.05
    empty = quality.key_filter(keys.limit(0), "k", 1 << 15).select("bits").scalar()
    assert spark.range(100).filter(quality.may_hold(empty, F.col("id"), 1 << 15)).count() == 0


def test_pipeline_from_end_to_end(spark, tmp_path):
    """All stages over a table with NULLs, empty texts, copies, personal data and further columns, each held against plain Python."""
    tiktoken = pytest.importorskip("tiktoken")
    rnd = random.Random(41)
    words = [prose(rnd, 1) for _ in range(400)]
    good = lambda n=90: " ".join(rnd.choice(words) for _ in range(n))
    base = [good() for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, base[i] + " end", "en", "s1", 1) for i in range(8)] + [rows[3]] * 3
    rows += [(200, good() + " mail a.b@c.org or 10.0.0.1", None, "s0", None), (201, None, "en", "s0", 0), (202, "", "en", None, 0), (None, good(), "en", "s2", 5)]
    rows += [(300 + i, "too short", "de", "s0", 9) for i in range(3)] + [(400, "la la la " * 60, "en", "s1", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).withColumns({"kept": F.lit("old"), "score": F.lit(1), "_id": F.lit(2)})
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    steps, now = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, apply in corpus_pipeline.STAGES:
        now = apply(spark, now, str(tmp_path)).cache()
        steps[name] = rows_of(now) if name != "byte_level_bpe" else now.collect()
    trusted = spark.createDataFrame([(i,) for i in range(60)], "doc_id long")
    judged = quality.judge(spark.createDataFrame(rows, schema), trusted).collect()
    kept = steps["quality_rules"]
    assert kept == Counter(tuple(r[c] for c in COLUMNS) for r in judged if r.kept)
    assert not any(i in (201, 202, 300, 400) for i, *_ in kept) and sum(kept.values()) >= 60, kept
    single = steps["near_duplicates"]
    assert single.keys() <= kept.keys() and max(single.values()) == 1 and not any(100 <= (r[0] or 0) < 108 and (r[0] - 100, base[r[0] - 100]) in {(x[0], x[1]) for x in kept} for r in single)
    finder = pii.Finder(dict(pii.train().weights))
    changed = lambda t: pii.redact(t, finder.spans(t)[1])
    private = steps["personal_data"]
    assert private == Counter((i, changed(t), lang, s, len(changed(t))) for i, t, lang, s, _ in single)
    mixed = steps["source_mixing"]
    assert mixed.keys() <= private.keys() and max(mixed.values()) <= 2
    ranks = bpe.read_ranks(registry.ranks_path())
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for (i, t, _, s, _), n in mixed.items():
        ids = other.encode_ordinary(t or "")
        want[i, s, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())] += n
    assert Counter((r.doc_id, r.source, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in steps["byte_level_bpe"]) == want
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == Counter(map(tuple, steps["byte_level_bpe"]))
    spark.createDataFrame([], docs.schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
