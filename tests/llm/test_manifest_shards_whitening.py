"""Merkle manifests, hash trees of shards and whitening against brute force, on tables with NULLs, ties and odd values."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelmart.llm import merkle, registry, shard_tree, whitening

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, idx int, shard string, grp int"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents: a hot source, a source of one row, NULLs in every column, repeated ids and rows, long and empty texts."""
    rows = [(i, f"Text {i % 90} Ünï", "en", "hot" if i % 3 else f"s{i % 5}", i) for i in range(700)]
    rows += [(None, "No id", None, None, None), (None, "No id", None, None, None), (5, None, "de", "hot", 0), (5, "", "de", "hot", 0)]
    rows += [(7, "Same Row", "en", "é", 1)] * 20 + [(900, "Alone", "en", "zz", 1), (901, "A b " * 50_000, "en", "", 1)]
    rows += [(902, "\x00\n", "en", "S0", -1)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA).repartition(5).write.parquet(f"{path}/documents.parquet")
    return path, rows


def leaf_of(doc, text) -> str:
    doc_id, _, lang, source, n_chars = doc
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(map(part, (doc_id, source, lang, n_chars, text))))


def climb(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + 16])) for i in range(0, len(now), 16)])
    return levels


def steps(levels, i):
    for now in levels[:-1]:
        first = i // 16 * 16
        yield i - first, now[first:i] + now[i + 1 : first + 16]
        i //= 16


def merkle_brute(rows) -> Counter:
    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append((r[0] is not None, r[0] or 0, leaf_of(r, r[1]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = climb([trees[s][-1][0] for s in names])
    out = Counter()
    for at, s in enumerate(names):
        for i, (*_, leaf, doc) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            path = [*steps(trees[s], i), *steps(top, at)]
            hit = doc[0] is not None and zlib.crc32(str(doc[0]).encode()) % 5 == 0
            cur = leaf_of(doc, doc[1].translate(UPPER) if hit and doc[1] else doc[1])
            for pos, others in path:
                cur = sha("".join([*others[:pos], cur, *others[pos:]]))
            proof = sha("".join(x for _, others in path for x in others))
            out[doc[0], leaf, trees[s][-1][0], top[-1][0], proof, cur, cur == top[-1][0]] += 1
    return out


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_manifest_is_that_of_brute_force(spark, folder):
    path, rows = folder
    found = Counter(map(tuple, registry.op11_merkle_manifest(spark, path).select(NAMES).collect()))
    assert found == merkle_brute(rows)
    assert {k[-1] for k in found} == {True, False}


def test_manifest_over_several_tiers(spark, folder, monkeypatch):
    """With blocks of 16 leaves the same trees need three tiers, and all rows agree."""
    path, rows = folder
    monkeypatch.setattr(merkle, "HEIGHT", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    made = merkle.manifest(spark.read.parquet(f"{path}/documents.parquet"))
    assert len(made.groups.tiers) == 3
    found = Counter((r["id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in merkle.prove(made).collect())
    whole = Counter()
    for k, n in merkle_brute(rows).items():
        whole[k[:5]] += n
    assert found == whole


def test_manifest_of_nothing_and_of_one(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert merkle.prove(merkle.manifest(docs.limit(0))).collect() == []
    one = merkle.prove(merkle.manifest(docs.filter("doc_id = 900"))).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["verified"] and one["proof_sha256"] == sha("")


def test_addresses_are_a_permutation_with_subtrees_together():
    for leaves in (1, 2, 16, 17, 300, 4095, 4096):
        for levels in range(merkle.height_of(leaves) + 1, 6):
            spots = [merkle.address(h, np.arange(-(-leaves // 16**h)), leaves, levels) for h in range(levels)]
            assert sorted(np.concatenate(spots)) == list(range(merkle.node_count(leaves, levels)))
    # Four levels: the upper two first, then each parent right before its sixteen children.
    assert merkle.address(3, np.array([0]), 4096, 4)[0] == 0
    assert list(merkle.address(2, np.arange(16), 4096, 4)) == list(range(1, 17))
    parent = merkle.address(1, np.arange(256), 4096, 4)
    assert (merkle.address(0, np.arange(4096), 4096, 4) == np.repeat(parent, 16) + 1 + np.tile(np.arange(16), 256)).all()


def test_siblings_are_read_from_their_addresses():
    digests = np.random.default_rng(1).integers(0, 256, (300, 32), np.uint8)
    body = merkle.build_block(digests, 3)
    levels = climb([d.tobytes().hex() for d in digests])
    inner = merkle.block_steps(body, 300, 3)
    for i in (0, 15, 16, 255, 299):
        for h, (pos, others) in enumerate(steps(levels, i)):
            assert (pos, bytes.fromhex("".join(others))) == merkle.siblings(body, h, i // 16**h, 300, 3) == inner[h][i // 16**h]
    assert body[0].tobytes().hex() == levels[-1][0]


# Shards.


def draw(key: str, label: str, weight: float) -> float:
    u = (int(hashlib.md5((key + label).encode()).hexdigest()[: shard_tree.DIGITS], 16) + 0.5) / 16**shard_tree.DIGITS
    return -math.log(u) / weight


def descend_brute(key: str, tree) -> int:
    own, above = list(tree), ""
    for name in (lambda x: f"{x.epoch}/{x.region}", lambda x: x.rack, lambda x: str(x.shard)):
        groups = defaultdict(list)
        for x in own:
            groups[name(x)].append(x)
        best = min(groups, key=lambda g: draw(key, f"{above}/{g}", sum(x.weight for x in groups[g])))
        own, above = groups[best], f"{above}/{best}"
    return own[0].shard


def test_shards_are_those_of_brute_force(spark, folder):
    path, rows = folder
    found = registry.op12_shard_tree(spark, path).collect()
    key = lambda i: "null" if i is None else str(i)
    want = Counter()
    for doc_id, text, *_ in rows:
        body = (text or "").encode()
        now, later = (descend_brute(key(doc_id), shard_tree.tree_for(n)) for n in (8, 9))
        assert later in (now, 8)
        want[doc_id, len(body) + 1, zlib.crc32(body), "key", now, later] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in found) == want
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(8))
    again = registry.op12_shard_tree(spark, path).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))


def test_slots_of_many_like_rows(spark, monkeypatch):
    monkeypatch.setattr(shard_tree, "CELL_ROWS", 20)
    monkeypatch.setattr(shard_tree, "RUN", 7)
    rows = spark.range(0, 3000, numPartitions=6).select(F.when(F.col("id") % 3 > 0, F.lit(1)).otherwise(F.col("id")).alias("a"), F.lit(2).alias("b"))
    placed = rows.withColumn("shard", (F.col("a") % 2).cast("int"))
    found = shard_tree.slots(placed, ["a", "shard"]).toPandas()
    for _, own in found.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    assert (found["a"] == 1).sum() == 2000


def test_a_change_moves_rows_only_where_weights_change(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    old = shard_tree.base_tree(8)
    heavier = tuple(shard_tree.Leaf(x.region, x.rack, x.shard, 2.0 if x.shard == 5 else 1.0) for x in old)
    moved = {(r["from_shard"], r["to_shard"]): r["n"] for r in shard_tree.movement(rows, old, heavier).collect()}
    # Racks of other regions trade nothing; shard 5 shares rack k2 of region g1 with shard 4.
    for (a, b), n in moved.items():
        assert a == b or b in (4, 5, 6, 7) and n > 0
        assert a == b or b == 5 or b == 4 and a not in (5,) or a < 4
    assert not any(a != b and {a, b} <= {6, 7} for a, b in moved)
    grown = shard_tree.grow(shard_tree.tree_for(9), shard_tree.Leaf("g0", "k0", 9, 0.5))
    added = {(r["from_shard"], r["to_shard"]): r["n"] for r in shard_tree.movement(rows, shard_tree.tree_for(9), grown).collect()}
    assert all(a == b or b == 9 for a, b in added)
    assert abs(sum(n for (a, b), n in added.items() if b == 9) / 20_000 - 0.5 / 9.5) < 0.01
    share = Counter()
    for (a, _), n in moved.items():
        share[a] += n
    assert all(abs(n / 20_000 - 1 / 8) < 0.01 for n in share.values())


def test_shards_as_files(spark, folder, tmp_path):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    shard_tree.write_shards(docs, shard_tree.base_tree(4), str(tmp_path / "out"))
    read = spark.read.parquet(str(tmp_path / "out"))
    assert read.count() == len(rows)
    assert {r[0] for r in read.select("region").distinct().collect()} == {"g0"}
    with pytest.raises(ValueError, match="two places"):
        shard_tree.levels((*shard_tree.base_tree(4), shard_tree.Leaf("g9", "k9", 1)))
    empty = shard_tree.place(docs.limit(0), shard_tree.base_tree(2))
    assert shard_tree.slots(empty, ["doc_id", "shard"]).collect() == []


# Whitening.


def whitened_brute(vectors: np.ndarray, k: int):
    x = np.floor(1024 * vectors).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    deviation = [sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s)) for row in x]
    c = (x - s / n).astype(np.longdouble)
    cov = (c.T @ c / n).astype(float)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    return n, deviation, (c.astype(float) @ axes / np.sqrt(values))[:, :k], (values / np.trace(cov))[:k]


def long_form(out, k):
    rows = sorted(out.collect(), key=lambda r: (r["vec_id"], r["component"]))
    return rows, np.array([r["whitened"] for r in rows], float).reshape(-1, k)


def test_whitening_is_that_of_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((600, 24)) @ rng.standard_normal((24, 24))
    odd = [None, [0.5] * 23 + [None], [0.5] * 23 + [float("nan")], [0.5] * 23 + [float("inf")], [1e300] * 24, []]
    rows = [(i, v.tolist(), 1.0) for i, v in enumerate(vectors)] + [(1000 + i, v, 1.0) for i, v in enumerate(odd)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened double").repartition(5)
    found, values = long_form(whitening.whiten(data), 8)
    n, deviation, want, explained = whitened_brute(vectors, 8)
    assert len(found) == 600 * 8 and {r["n"] for r in found} == {n}
    sign = np.sign((values * want).sum(axis=0))
    np.testing.assert_allclose(values * sign, want, atol=1e-9)
    np.testing.assert_allclose([r["explained"] for r in found[:8]], explained, rtol=1e-10)
    assert [r["deviation"] for r in found[::8]] == deviation
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-10


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    assert whitening.whiten(frame([])).collect() == []
    assert whitening.whiten(frame([(1, None)])).collect() == []
    one = whitening.whiten(frame([(1, [1.0, 2.0, 3.0])])).collect()
    assert len(one) == 3 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 and r["identity_error"] is None for r in one)
    line = whitening.whiten(frame([(i, [float(i), 2.0 * i, 5.0]) for i in range(10)] * 2 + [(None, [3.0, 6.0, 5.0])])).collect()
    first = [r for r in line if r["component"] == 1]
    assert len(line) == 63 and all(r["whitened"] is not None for r in first) and first[0]["explained"] == pytest.approx(1.0)
    assert all(r["whitened"] is None for r in line if r["component"] > 1) and first[0]["identity_error"] < 1e-12
    both = whitening.whiten(frame([(i, [float(i * i % 7)] * (1 + i % 2)) for i in range(20)])).collect()
    assert len(both) == 10 + 20 and {r["n"] for r in both} == {10}
    large = whitening.whiten(spark.createDataFrame([(0, [1e15, 1.0]), (1, [-1e15, 2.0]), (2, [3e10, -5.0])], "vec_id int, embedding array<double>"))
    assert {r["deviation"] for r in large.collect()} == {None}


def test_gram_and_limbs_are_exact():
    rng = np.random.default_rng(5)
    for y in (rng.integers(-3000, 3000, (1000, 5)), rng.integers(-(2**61), 2**61, (1100, 3)), np.array([[2**70, -1], [5, -(2**64)]], object)):
        exact = y.astype(object).T @ y.astype(object)
        assert (whitening.gram(y) == exact).all()
        parts = whitening.limbs(exact)
        assert (whitening.whole(parts + parts) == 2 * exact).all()


def test_clustered_eigenvalues():
    rng = np.random.default_rng(9)
    for values in ([5, 5 + 1e-9, 5 + 2e-9, 3, 3, 3 + 1e-12, 1, 0.5], [2.0] * 8, [1 + i * 1e-8 for i in range(8)], [1e6, 1, 1 + 1e-10, 1e-3, 1e-3, 0, 0, 0]):
        q = np.linalg.qr(rng.standard_normal((8, 8)))[0]
        a = q * np.array(values) @ q.T
        a = (a + a.T) / 2
        found, x = whitening.refine([a], np.linalg.eigh((a / max(values)).astype(np.float32))[1].astype(float))
        wide = x.astype(np.longdouble)
        product = wide.T @ a.astype(np.longdouble) @ wide
        assert np.abs(wide.T @ wide - np.eye(8)).max() < 1e-15
        assert np.abs(product - np.diag(np.diag(product))).max() < 4e-16 * max(values)
        np.testing.assert_allclose(np.sort(found), np.linalg.eigvalsh(a), atol=1e-14 * max(values))
