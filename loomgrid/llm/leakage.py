"""Evaluation passages in training documents, by winnowed fingerprints and extension of their hits."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.session import stage

#: Consecutive shared words that make a leak, and the words of one hashed gram.
SHARED = 13
GRAM = 8
#: Fingerprints of test items in one block of the query set (8 bytes each); a block is broadcast and costs one pass over the documents.
BLOCK = 4_000_000
#: Characters of documents worked on at a time.
SLICE_CHARS = 4_000_000
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, in lower case; the underscore is neither."""
    if not text:
        return []
    # lower case can split a word where a letter becomes a letter and a mark, so it comes after the split
    return _WORD.findall(text.lower()) if text.isascii() else [w.lower() for w in _WORD.findall(text)]


class _Hasher(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def array(self, ws: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), dtype=np.uint64, count=len(ws))


def winnow(codes: np.ndarray, starts: np.ndarray, gram: int = GRAM, shared: int = SHARED) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the selected grams of texts laid end to end; ``starts`` has each text's first position and the end.

    In every window of shared - gram + 1 grams the least hash, the rightmost of equals, is selected; so any two
    texts that share ``shared`` consecutive words share a selected gram within them.
    """
    window = shared - gram + 1
    n = len(codes) - shared + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes) - gram + 1, dtype=np.uint64)
        for j in range(gram):
            h = h * _BASE + codes[j : j + len(h)]
        h = (h ^ (h >> np.uint64(31))) * _MIX
        h ^= h >> np.uint64(29)
    least, at = h[:n].copy(), np.zeros(n, dtype=np.int64)
    for j in range(1, window):
        here = h[j : j + n]
        lower = here <= least
        least[lower] = here[lower]
        at[lower] = j
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    inside = owner[:n] == owner[shared - 1 : shared - 1 + n]
    picked = np.unique(np.flatnonzero(inside) + at[inside])
    return picked, h[picked]


def _fingerprints(gram: int, shared: int, block: Broadcast | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Selected grams of texts (``k, t``), or those of them in a block of fingerprints: ``k, fp, gram, before, after``.

    ``before`` (nearest first) and ``after`` are the words around the gram, as many as decide whether ``shared`` are equal.
    """
    around = shared - gram

    def of(batch: pa.RecordBatch, hasher: _Hasher) -> pa.RecordBatch:
        texts = [words(t) for t in batch.column("t").to_pylist()]
        starts = np.concatenate([[0], np.cumsum([len(ws) for ws in texts])]).astype(np.int64)
        picked, h = winnow(hasher.array([w for ws in texts for w in ws]), starts, gram, shared)
        if block is not None:
            known = block.value
            hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
            picked, h = picked[hit], h[hit]
        owner = np.searchsorted(starts, picked, side="right") - 1
        rows = {}
        for d, at, fp in zip(owner.tolist(), (picked - starts[owner]).tolist(), h.view(np.int64).tolist()):
            ws = texts[d]
            rows[(d, fp, " ".join(ws[at : at + gram]), " ".join(ws[max(0, at - around) : at][::-1]), " ".join(ws[at + gram : at + shared]))] = None
        d, fp, *context = zip(*rows) if rows else [()] * 5
        columns = [batch.column("k").take(pa.array(d, pa.int64())), pa.array(fp, pa.int64()), *[pa.array(c, pa.string()) for c in context]]
        return pa.RecordBatch.from_arrays(columns, names=["k", "fp", "gram", "before", "after"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for batch in batches:
            # whole texts, about SLICE_CHARS of them at a time
            share = np.cumsum(pc.utf8_length(batch.column("t")).to_numpy(zero_copy_only=False)) // SLICE_CHARS
            edges = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            for low, high in zip(edges, edges[1:]):
                yield of(batch.slice(low, high - low), hasher)

    return scan


def _common(a: str, b: str) -> str:
    """Equal words at the beginning of two runs of words, as SQL."""
    pairs = f"zip_with(split({a}, ' '), split({b}, ' '), (x, y) -> x <=> y AND x <> '')"
    return f"coalesce(nullif(array_position({pairs}, false), 0) - 1, size({pairs}))"


def leaks(documents: DataFrame, id: str, text: str, items: DataFrame, item_id: str, item_text: str, shared: int = SHARED, gram: int = GRAM, block_size: int = BLOCK) -> DataFrame:
    """Every pair of a document and a test item that share at least ``shared`` consecutive words: ``id, item_id``.

    Both sides are winnowed; the documents' fingerprints are joined with the items' on the hash, and each hit is extended
    word by word to both sides, so a pair comes out exactly if such a span exists.

    Distribution: the items are a query set. Their fingerprints are made and written by tasks; the hashes alone, in blocks of at most
    ``block_size``, are broadcast one after the other, and destroyed when their pass over the documents is done. In a pass
    each document is fingerprinted where it is read, and only its grams with a hash in the block are written, with the few
    words around them. These hits join the items' fingerprints on the hash, where a hash that many documents share is a skewed side
    that adaptive execution splits. No text and no other fingerprint is shuffled, none goes to the driver. More
    items cost more passes (one per ``block_size``), never more memory. A document is worked on whole, however long.

    Nulls: documents or items with a null id or text have no pairs; empty or shorter texts have none either. Repeated
    documents and items give each pair once. With no items the result is empty. Other columns are ignored.
    """
    if not 1 <= gram <= shared:
        raise ValueError("gram must be 1 to shared")
    spark = documents.sparkSession

    def prints(df: DataFrame, key: str, text: str, block: Broadcast | None) -> DataFrame:
        asked = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
        schema = asked.select("k").schema.add("fp", "long").add("gram", "string").add("before", "string").add("after", "string")
        return asked.mapInArrow(_fingerprints(gram, shared, block), schema)

    asked = stage(prints(items, item_id, item_text, None), "items").withColumnRenamed("k", "i")
    hashes = asked.select("fp").distinct()
    blocks = max(1, -(-hashes.count() // block_size))
    hits: DataFrame | None = None
    for b in range(blocks):
        part = hashes.where(F.pmod(F.xxhash64("fp"), F.lit(blocks)) == b) if blocks > 1 else hashes
        known = np.sort(part.toPandas()["fp"].to_numpy(dtype=np.int64).view(np.uint64))
        if not len(known):
            continue
        block = spark.sparkContext.broadcast(known)
        found = stage(prints(documents, id, text, block), "hits")
        block.destroy()
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = prints(documents.limit(0), id, text, None)
    hits = hits.withColumnsRenamed({"k": "d", "gram": "g", "before": "b", "after": "a"})
    both = hits.join(asked, "fp").where(F.col("g") == F.col("gram"))
    spans = both.where(F.expr(f"{gram} + {_common('b', 'before')} + {_common('a', 'after')} >= {shared}"))
    return spans.select(F.col("d").alias(id), F.col("i").alias(item_id)).distinct()
