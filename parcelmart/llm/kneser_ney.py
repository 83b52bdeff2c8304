"""Interpolated modified Kneser-Ney language model: counted by shuffles, stored as sorted hash arrays, scored from mapped files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .hash_arrays import BLOB, Tables, batches_of, grouped, new_folder, save, send, shard_count, to_shards, unpack_all
from .textbytes import LOWER, RangeHash, blocks, flat_utf8, mix, sorted_counts, words

#: Bits of a word's hash that n-grams keep: 48 of 64.
_WORD_SHIFT = np.uint64(16)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
END, BEGIN = np.uint64(1), np.uint64(2)
#: Text bytes scored together.
SCORE_BYTES = 2_000_000
#: Words gathered before a counting task sends them on.
COUNT_WORDS = 4_000_000


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    """Key of n-grams given by word columns; of one word it is the mixed word."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = mix(out * _GOLD + c + np.uint64(1))
    return out


def token_stream(data: np.ndarray, offsets: np.ndarray, hasher: RangeHash) -> tuple[np.ndarray, np.ndarray]:
    """(word, text) of all tokens of the texts: lower-cased words, then one end for each text."""
    low = LOWER[data]
    start, end, row = words(low, offsets)
    value = hasher.ranges(hasher.sums(low), start, end) >> _WORD_SHIFT
    value = np.where(value <= BEGIN, value + np.uint64(8), value)
    n = len(offsets) - 1
    every = np.concatenate([value, np.full(n, END)])
    owner = np.concatenate([row, np.arange(n)])
    order = np.argsort(owner, kind="stable")
    return every[order], owner[order]


def context_columns(token: np.ndarray, text: np.ndarray, order: int) -> list[np.ndarray]:
    """For each token the ``order`` words that end with it, as columns; before a text's first word stand begins."""
    first = np.concatenate([[True], text[1:] != text[:-1]]) if len(text) else np.zeros(0, bool)
    place = np.arange(len(token)) - np.maximum.accumulate(np.where(first, np.arange(len(token)), 0)) if len(token) else token
    columns = []
    for back in range(order - 1, -1, -1):
        shifted = np.concatenate([np.full(min(back, len(token)), BEGIN), token[: len(token) - back]]) if back else token
        columns.append(np.where(place >= back, shifted, BEGIN) if back else shifted)
    return columns


def _gram_widths(words_n: int, values_n: int) -> list[int]:
    return [6] * words_n + [8] * values_n


def _count(batches: Iterator[pa.RecordBatch], order: int, shards: int) -> Iterator[tuple]:
    """n-grams of a task's texts, added up before they are sent."""
    hasher = RangeHash()
    held: list[list[np.ndarray]] = []
    size = 0

    def flush() -> Iterator[tuple]:
        # Blocks give up their arrays one by one, so that a task holds few copies of them at a time.
        key = np.concatenate([block.pop() for block in held])
        by_key = np.argsort(key)
        key = key[by_key]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        at, count = by_key[head], np.diff(head, append=len(key))
        del by_key
        key = key[head]
        del head
        columns = [np.concatenate([block.pop() for block in held])[at] for _ in range(order)][::-1]
        yield from send(order, key, [*columns, count], _gram_widths(order, 1), shards)

    for batch in batches:
        data, offsets = flat_utf8(batch.column(0))
        for start, stop in blocks(offsets):
            cut = offsets[start : stop + 1]
            token, text = token_stream(data[cut[0] : cut[-1]], cut - cut[0], hasher)
            columns = context_columns(token, text, order)
            held.append([*columns, gram_hash(columns)])
            size += len(token)
            if size > COUNT_WORDS:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def _statistics(level: int, **sums: float) -> Iterator[tuple]:
    names = ("n1", "n2", "n3", "n4", "total", "kinds", "tokens")
    body = np.array([float(sums.get(k, 0)) for k in names]).tobytes()
    yield 100 + level, 0, 1, body


def _merge(batches: Iterator[pa.RecordBatch], shards: int, folder: str) -> Iterator[tuple]:
    """Add up n-grams and contexts, write their arrays, and send on what their suffixes and contexts need.

    Kinds: k for n-grams of k words, -k for contexts of k-grams, 100 + k for the statistics of level k.
    """
    for kind, shard, blobs in grouped(batches):
        if kind >= 100:
            for n, body in blobs:
                yield kind, shard, n, body
            continue
        words_n, values_n = (kind, 2 if _raw(kind, blobs) else 1) if kind > 0 else (-kind - 1, 4)
        arrays = unpack_all(blobs, _gram_widths(words_n, values_n))
        key, at, *sums = sorted_counts(gram_hash(arrays[:words_n]), *arrays[words_n:])
        columns = [c[at] for c in arrays[:words_n]]
        if kind < 0:
            save(folder, f"context-{-kind}", shard, key=key, sums=np.stack([s.astype(np.float64) for s in sums], axis=1))
            continue
        value, raw = sums[0], sums[-1]
        if kind == 1:
            save(folder, "gram-1", shard, key=key, value=value.astype(np.float64), raw=raw.astype(np.float64))
        else:
            save(folder, f"gram-{kind}", shard, key=key, value=np.minimum(value, np.uint64(2**32 - 1)).astype(np.uint32))
        few = np.bincount(np.minimum(value, 5).astype(np.int64), minlength=6)
        yield from _statistics(kind, n1=few[1], n2=few[2], n3=few[3], n4=few[4], total=value.sum(), kinds=len(key), tokens=raw.sum())
        if kind > 1:
            ones = np.ones(len(key), np.uint64)
            suffix, place, kinds, raws = sorted_counts(gram_hash(columns[1:]), ones, raw)
            yield from send(kind - 1, suffix, [*(c[place] for c in columns[1:]), kinds, raws], _gram_widths(kind - 1, 2), shards)
            classes = [(value == 1).astype(np.uint64), (value == 2).astype(np.uint64), (value > 2).astype(np.uint64)]
            context, place, *found = sorted_counts(gram_hash(columns[:-1]), value, *classes)
            yield from send(-kind, context, [*(c[place] for c in columns[:-1]), *found], _gram_widths(kind - 1, 4), shards)


def _raw(kind: int, blobs: list[tuple[int, bytes]]) -> bool:
    """Whether blobs of n-grams carry a second value, the number of times they stand in the corpus."""
    n, body = blobs[0]
    return len(body) == n * (6 * kind + 16)


def train(docs: DataFrame, order: int = 2, text: str = "text") -> dict:
    """Count a model over all rows of ``docs`` and write it; returns where it is and its few statistics.

    Tasks add up their texts' n-grams and send them as packed arrays to the shard, a range of n-gram hashes, that adds them up
    and writes them as sorted arrays. From there suffixes go on to the next lower level with their numbers of
    different words before them (continuation counts), contexts with their totals and numbers of words seen once, twice
    and more. Hashes spread hot words over all shards, and each task sends a hot n-gram once. Shards
    grow in number with the input. An empty table gives a model in which all words are unknown.
    """
    source = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    shards = shard_count(source)
    folder = new_folder(docs.sparkSession, "kneser-ney")
    sent = source.mapInArrow(lambda b: batches_of(_count(b, order, shards)), BLOB)
    for _ in range(order):
        sent = to_shards(sent, shards).mapInArrow(lambda b: batches_of(_merge(b, shards, folder)), BLOB)
    sums = sent.filter("kind >= 100").select("kind", "body").mapInArrow(_numbers, "level int, sums array<double>")
    per_level = sums.groupBy("level").agg(F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(7))).alias("sums")).collect()
    return {"folder": folder, "order": order, "shards": shards, "levels": {r["level"]: list(r["sums"]) for r in per_level}}


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = [np.frombuffer(b, np.float64).tolist() for b in batch.column("body").to_pylist()]
        level = pa.array([k - 100 for k in batch.column("kind").to_pylist()], pa.int32())
        yield pa.RecordBatch.from_arrays([level, pa.array(sums, pa.list_(pa.float64()))], names=["level", "sums"])


def discounts(sums: list[float]) -> tuple[float, float, float]:
    """D1, D2, D3+ of a level from its numbers of n-grams with counts 1 to 4.

    Each lies between 0.1 and its count, so that an unseen word has a probability even where the formula gives no discount.
    """
    n1, n2, n3, n4 = sums[:4]
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = (1 - 2 * y * n2 / n1 if n1 else 0.0, 2 - 3 * y * n3 / n2 if n2 else 0.0, 3 - 4 * y * n4 / n3 if n3 else 0.0)
    return tuple(min(max(d, 0.1), float(k)) for k, d in enumerate(raw, 1))


class Model:
    """A trained model as one worker sees it: mapped files, opened when first needed."""

    def __init__(self, model: dict) -> None:
        self.__dict__.update(model)
        self.tables = Tables(self.folder, self.shards)
        empty = [0.0] * 7
        self.sums = {k: self.levels.get(k, empty) for k in range(1, self.order + 1)}
        self.discount = {k: discounts(s) for k, s in self.sums.items()}
        self.tokens, self.vocabulary = self.sums[1][6], self.sums[1][5]

    def _less(self, level: int, value: np.ndarray) -> np.ndarray:
        """Counts less their discounts."""
        d = np.array([0.0, *self.discount[level]])
        return np.maximum(value - d[np.minimum(value, 3).astype(np.int64)], 0.0)

    def probabilities(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(probability of the last word after the others, its number in the training corpus).

        Level by level from single words up: the discounted share among what follows the context, plus the mass the
        discounts freed times the level below; below the first level all words and one unknown are equally likely.
        """
        _, *found = self.tables.lookup("gram-1", gram_hash(columns[-1:]), {"value": 1, "raw": 1})
        value, raw = (v[:, 0] for v in found)
        s, d = self.sums[1], self.discount[1]
        uniform = 1.0 / (self.vocabulary + 1)
        if s[4]:
            freed = (d[0] * s[0] + d[1] * s[1] + d[2] * (s[5] - s[0] - s[1])) / s[4]
            p = self._less(1, value) / s[4] + freed * uniform
        else:
            p = np.full(len(value), uniform)
        for level in range(2, self.order + 1):
            own = columns[-level:]
            _, count = self.tables.lookup(f"gram-{level}", gram_hash(own), {"value": 1})
            _, context = self.tables.lookup(f"context-{level}", gram_hash(own[:-1]), {"sums": 4})
            total = context[:, 0]
            known = total > 0
            safe = np.where(known, total, 1.0)
            freed = np.where(known, (context[:, 1:] @ np.array(self.discount[level])) / safe, 1.0)
            p = np.where(known, self._less(level, count[:, 0]) / safe, 0.0) + freed * p
        return p, raw


def _score(batches: Iterator[pa.RecordBatch], model: dict, place: int) -> Iterator[pa.RecordBatch]:
    hasher, lm = RangeHash(), Model(model)
    for batch in batches:
        data, offsets = flat_utf8(batch.column(place))
        parts = []
        for start, stop in blocks(offsets, SCORE_BYTES):
            cut = offsets[start : stop + 1]
            token, text = token_stream(data[cut[0] : cut[-1]], cut - cut[0], hasher)
            columns = context_columns(token, text, lm.order)
            key = gram_hash(columns)
            distinct, at, back = np.unique(key, return_index=True, return_inverse=True)
            p, raw = lm.probabilities([c[at] for c in columns])
            base = np.log10((raw + 0.5) / (lm.tokens + 0.5 * (lm.vocabulary + 1)))
            n = stop - start
            parts.append(
                (
                    np.bincount(text, minlength=n),
                    np.bincount(text, weights=(raw > 0)[back], minlength=n),
                    np.bincount(text, weights=base[back], minlength=n),
                    np.bincount(text, weights=np.log10(p)[back], minlength=n),
                )
            )
        n_tokens, n_known, base, score = (np.concatenate([x[i] for x in parts]) if parts else np.zeros(0) for i in range(4))
        added = [n_tokens.astype(np.int64), n_known.astype(np.int64), np.full(len(base), int(lm.tokens)), base, score]
        kept = [i for i in range(batch.num_columns) if i != place]
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in kept] + [pa.array(a) for a in added],
            names=[batch.schema.names[i] for i in kept] + ["n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_tokens, n_known, train_tokens, base_score and score (both log10), perplexity.

    One pass without a shuffle. Workers map the model's files, so the processes of a machine share their pages; a block of texts looks up its
    distinct n-grams in hash order. NULL and empty texts hold one token, their end. A text as long as a block is scored whole.
    """
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    rows = docs.drop(*(c for c in new if c != text))
    place = rows.columns.index(text)
    fields = [f for f in rows.schema if f.name != text]
    added = StructType.fromDDL("n_tokens long, n_known long, train_tokens long, base_score double, score double")
    out = rows.mapInArrow(lambda b: _score(b, model, place), StructType([*fields, *added]))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
