"""Leaked passages against all runs of thirteen words."""

import random

import numpy as np
from pyspark import Broadcast, SparkContext

from loomgrid.llm.leakage import leaks, winnow, words

D = "doc_id bigint, text string, item_id string, d int"


def _leaks(spark, docs, items, **kw):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], D)
    i = spark.createDataFrame([(*r, "y") for r in items], "item_id bigint, text string, doc_id string")
    return {tuple(r) for r in leaks(d, "doc_id", "text", i, "item_id", "text", **kw).collect()}


def _brute(docs, items, n=13):
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words(t)
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ()) if None not in (d, i)}
    return out


def _cases(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("ab cd ef gh ij kl mn op qr st uv wx yz".split()) + str(rng.randrange(9)) for _ in range(n))
    items = [(i, text(rng.randrange(5, 60))) for i in range(40)] + [(50, None), (None, text(40)), (51, "")]
    items += [(52, items[3][1]), items[4]]
    docs = []
    for d in range(120):
        parts = [text(rng.randrange(0, 40))]
        for _ in range(rng.randrange(3)):
            w = words(rng.choice(items)[1])
            k = rng.randrange(10, 16)
            s = rng.randrange(max(1, len(w) - k))
            parts += [rng.choice([" ", "_", ",\n"]).join(w[s : s + k]).upper(), text(rng.randrange(4))]
        docs.append((d, " ".join(parts)))
    return docs + [(900, None), (901, ""), (None, items[0][1]), docs[0], (902, text(60_000) + " " + items[1][1] + " " + text(10))], items


def test_every_shared_span_is_found_and_nothing_else(spark):
    for seed in (1, 2):
        docs, items = _cases(seed)
        want = _brute(docs, items)
        assert want and _leaks(spark, docs, items) == want
        assert _leaks(spark, docs, items, block_size=40) == want
        assert _leaks(spark, docs, items, shared=10, gram=5) == _brute(docs, items, 10)


def test_one_block_is_broadcast_at_a_time(spark, monkeypatch):
    alive, most, sizes = set(), [0], []
    make, end = SparkContext.broadcast, Broadcast.destroy

    def broadcast(self, value):
        b = make(self, value)
        alive.add(id(b))
        most[0] = max(most[0], len(alive))
        sizes.append(len(value))
        return b

    def destroy(self, *args):
        alive.discard(id(self))
        end(self, *args)

    monkeypatch.setattr(SparkContext, "broadcast", broadcast)
    monkeypatch.setattr(Broadcast, "destroy", destroy)
    docs, items = _cases(4)
    assert _leaks(spark, docs, items, block_size=40) == _brute(docs, items)
    assert len(sizes) > 4 and most == [1] and not alive and max(sizes) < 100


def test_a_gram_that_most_documents_and_items_share(spark):
    stock = " ".join(f"stock{k}" for k in range(9))
    items = [(i, f"own{i} {stock} other{i}") for i in range(30)] + [(99, " ".join(f"stock{k}" for k in range(13)))]
    docs = [(d, f"page{d} {stock} more{d}") for d in range(300)] + [(999, items[-1][1])]
    assert _leaks(spark, docs, items) == {(999, 99)}


def test_empty_sides(spark):
    docs, items = _cases(3)
    assert _leaks(spark, docs, []) == set() and _leaks(spark, [], items) == set()


def test_winnowing_selects_in_every_window():
    codes = np.random.default_rng(1).integers(0, 5, 400).astype(np.uint64)
    at, _ = winnow(codes, np.array([0, 150, 400]), 8, 13)
    for lo, hi in ((0, 150), (150, 400)):
        for s in range(lo, hi - 12):
            assert ((at >= s) & (at <= s + 5)).any()
