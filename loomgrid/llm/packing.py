"""Filling fixed-capacity containers: best fit, then a swap-based local search over underfull containers."""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.session import stage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-tokenisation pattern of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items that one task packs at a time.
BLOCK = 20_000
#: A container filled to this share is final; the items of others take part in the next round.
CLOSED = 0.995


#: One encoding per Python worker and rank file.
_ENCODINGS: dict[str, object] = {}


def _encoding(name: str, ranks: bytes) -> object:
    if name not in _ENCODINGS:
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line.strip())
        _ENCODINGS[name] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
    return _ENCODINGS[name]


def token_counts(documents: DataFrame, id: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``id, n_tokens`` of every document, whole texts; a null text has 0 tokens.

    ``tokenizer`` is a rank file that the driver reads; its bytes (a vocabulary, about a megabyte) go to the executors with the job.
    """
    with open(tokenizer, "rb") as f:
        ranks = documents.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(tokenizer, ranks.value)
        for pdf in batches:
            yield pd.DataFrame({"i": pdf["i"], "n": [len(encoding.encode_ordinary(t)) if t else 0 for t in pdf["t"]]})

    return documents.select(F.col(id).alias("i"), F.col(text).alias("t")).mapInPandas(count, documents.select(F.col(id).alias("i")).schema.add("n", "long")).select(F.col("i").alias(id), F.col("n").alias("n_tokens"))


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Items in falling size, each into the fullest container that holds it."""
    bins: list[list[int]] = []
    free: list[tuple[int, int]] = []
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        at = bisect_left(free, (s, -1))
        if at < len(free):
            room, b = free.pop(at)
            bins[b].append(int(i))
        else:
            room, b = capacity, len(bins)
            bins.append([int(i)])
        if room - s > 0:
            insort(free, (room - s, b))
    return bins


def _exchange(src: list[int], dst: list[int], room: int, sizes: np.ndarray) -> tuple[list[int], list[int]] | None:
    """The exchange that adds most to the fuller container: items to give, items to take back."""
    a, c = sizes[src], sizes[dst]
    best, found = 0, None
    fits = np.where(a <= room, a, 0)
    if len(a) and fits.max() > best:
        best, found = int(fits.max()), ([int(fits.argmax())], [])
    gain = a[:, None] - c[None, :]
    gain = np.where(gain <= room, gain, 0)
    if gain.size and gain.max() > best:
        i, j = np.unravel_index(gain.argmax(), gain.shape)
        best, found = int(gain.max()), ([int(i)], [int(j)])
    if best < room and len(a) > 1 and len(c):
        p, q = np.triu_indices(len(a), 1)
        two = (a[p] + a[q])[:, None] - c[None, :]
        two = np.where(two <= room, two, 0)
        if two.max() > best:
            i, j = np.unravel_index(two.argmax(), two.shape)
            best, found = int(two.max()), ([int(p[i]), int(q[i])], [int(j)])
    if best < room and len(c) > 1 and len(a):
        p, q = np.triu_indices(len(c), 1)
        two = a[:, None] - (c[p] + c[q])[None, :]
        two = np.where(two <= room, two, 0)
        if two.max() > best:
            i, j = np.unravel_index(two.argmax(), two.shape)
            best, found = int(two.max()), ([int(i)], [int(p[j]), int(q[j])])
    return found


class _Takers:
    """Underfull containers by what they could take: each sum t of up to two of their items (or none) with the room above it.

    A container can take part in an exchange for a sum g of given items if t < g <= t + room; against two given items it
    gives one back. Entries of changed or removed containers stay until half are dead.
    """

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.entries: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.version: dict[int, int] = {}
        self.fresh: list[int] = []
        self._pack([])

    def _pack(self, owners: list[int]) -> None:
        self.owner, self.flat, self.alive, self.fresh = [], [np.zeros((3, 0), dtype="int64")] * 2, np.zeros(0, dtype=bool), []
        self.version = {}
        self._append(owners)

    def _append(self, owners: list[int]) -> None:
        first = len(self.owner)
        self.owner += owners
        self.alive = np.concatenate([self.alive, np.ones(len(owners), dtype=bool)])
        self.version.update(zip(owners, range(first, first + len(owners))))
        for which in (0, 1):
            parts = [np.vstack([e, np.full((1, e.shape[1]), first + i)]) for i, e in enumerate(self.entries[d][which] for d in owners)]
            self.flat[which] = np.concatenate([self.flat[which], *parts], axis=1)

    def put(self, d: int, items: np.ndarray, fill: int) -> None:
        self.drop(d)
        values, counts = np.unique(items[items > 0], return_counts=True)
        two = (values[:, None] + values[None, :])[np.triu_indices(len(values), 1)]
        sums = np.unique(np.concatenate([[0], values, two, 2 * values[counts > 1]]).astype("int64"))
        one = np.concatenate([[0], values]).astype("int64") if (items == 0).any() else values.astype("int64")
        room = self.capacity - fill
        self.entries[d] = (np.vstack([sums, sums + room]), np.vstack([one, one + room]))
        self.fresh.append(d)

    def drop(self, d: int) -> None:
        self.entries.pop(d, None)
        if d in self.version:
            self.alive[self.version.pop(d)] = False

    def find(self, given: np.ndarray) -> set[int]:
        """Containers that could take one or two of the given items."""
        new = [d for d in dict.fromkeys(self.fresh) if d in self.entries and d not in self.version]
        self.fresh = []
        if len(self.alive) > 2 * len(self.entries) + 64:
            self._pack(list(self.entries))
        elif new:
            self._append(new)
        ones, counts = np.unique(given, return_counts=True)
        pairs = np.unique(np.concatenate([(ones[:, None] + ones[None, :])[np.triu_indices(len(ones), 1)], 2 * ones[counts > 1]]))
        found: set[int] = set()
        for sums, (low, high, who) in ((ones, self.flat[0]), (pairs, self.flat[1])):
            if len(sums):
                k = np.searchsorted(sums, low, "right")
                fits = (k < len(sums)) & (sums[np.minimum(k, len(sums) - 1)] <= high)
                found.update(self.owner[v] for v in np.unique(who[fits]) if self.alive[v])
        return found


def local_search(bins: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Moves and exchanges (one for one, two for one, one for two) from the emptiest container into fuller ones.

    Each step makes a fuller container fuller at the cost of an emptier one, so the sum of squared fills grows
    and the search ends. All underfull containers are looked at, the fullest that can take something first. A container from
    which nothing more can be given is left; an emptied one is gone.
    """
    fill = [int(sizes[b].sum()) for b in bins]
    full = [i for i, f in enumerate(fill) if f >= capacity]
    queue = sorted((f, i) for i, f in enumerate(fill) if f < capacity)
    takers = _Takers(capacity)
    for _, d in queue:
        takers.put(d, sizes[bins[d]], fill[d])
    done = []
    while queue:
        f, s = queue.pop(0)
        takers.drop(s)
        while bins[s]:
            able = takers.find(sizes[bins[s]])
            if not able:
                break
            d = max(able, key=lambda i: (fill[i], i))
            step = _exchange(bins[s], bins[d], capacity - fill[d], sizes)
            give = [bins[s][x] for x in step[0]]
            take = [bins[d][x] for x in step[1]]
            queue.pop(bisect_left(queue, (fill[d], d)))
            bins[s] = [x for x in bins[s] if x not in give] + take
            bins[d] = [x for x in bins[d] if x not in take] + give
            change = int(sizes[give].sum() - (sizes[take].sum() if take else 0))
            fill[s], fill[d] = fill[s] - change, fill[d] + change
            if fill[d] < capacity:
                insort(queue, (fill[d], d))
                takers.put(d, sizes[bins[d]], fill[d])
            else:
                full.append(d)
                takers.drop(d)
        if bins[s]:
            done.append(s)
    return [bins[i] for i in full + done if bins[i]]


def _filler(capacity: int, turn: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Packs one task's pieces; containers are named by round, task and number."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "u"], ascending=[False, True], ignore_index=True)
        sizes = pdf["n"].to_numpy(dtype="int64")
        at, fills = np.zeros(len(pdf), dtype="int64"), np.zeros(len(pdf), dtype="int64")
        for b, members in enumerate(local_search(best_fit(sizes, capacity), sizes, capacity)):
            at[members], fills[members] = b, sizes[members].sum()
        name = f"r{turn}-{int(pdf['task'].iloc[0])}-"
        return pd.DataFrame({"u": pdf["u"], "n": pdf["n"], "container": [name + str(b) for b in at], "fill": fills})

    return fill


def _bar(packed: DataFrame, count: int, closed: float) -> float:
    """The fill below which containers stay open: ``closed``, or less where more than half of the pieces would stay."""
    fills = packed.where(F.col("fill") < closed).groupBy("fill").agg(F.count(F.lit(1)).alias("held")).orderBy("fill")
    held, bar = 0, 0.0
    for row in fills.toLocalIterator():  # one row per fill, of which there are no more than the capacity
        held += row.held
        if 2 * held > count:
            return float(row.fill)
        bar = closed
    return bar


def pack(items: DataFrame, id: str, size: str, capacity: int, block: int = BLOCK, closed: float = CLOSED) -> DataFrame:
    """Every item with its container: ``id, piece, piece_size, container`` (string), ``container_fill``.

    An item longer than ``capacity`` is cut into pieces of ``capacity`` and a rest, numbered from 0, each piece in
    one container; any other item is one piece, never split. Pieces are dealt by hash to tasks of about ``block`` pieces,
    packed by best fit in falling size and improved by ``local_search``. Containers filled to ``closed`` are final; the
    pieces of the others are dealt again, until one task's worth is left, whose containers are final as they are.
    Where these are over half of the pieces dealt, as with sizes that cannot fill a container, the fuller
    containers that hold at least half of them are final too, so every round halves what is left: there are at most
    log2(pieces / block) + 2 rounds. So only a few containers of the whole result are underfull by more than the sizes force.

    Distribution: only ids and sizes travel; a task holds about ``block`` pieces whatever the number of items. Full pieces are
    containers of their own and are not dealt. Containers are joined with the items once, at the end.

    Nulls: a null size counts as 0; a null id is an item like any other; a negative size is an error. Size 0
    takes no room but gets a container. Repeated rows are items of their own. Empty in, empty out.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    rows = items.select(F.col(id).alias("i"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("s"))
    rows = rows.withColumn("s", F.when(F.col("s") >= 0, F.col("s")).otherwise(F.raise_error(F.lit("negative size")).cast("bigint")))
    pieces = rows.withColumn("k", F.greatest(F.ceil(F.col("s") / capacity), F.lit(1)).cast("bigint")).withColumn("p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)))
    pieces = stage(pieces.select("i", F.col("p").cast("int").alias("piece"), F.least(F.lit(capacity).cast("bigint"), F.col("s") - F.col("p") * capacity).alias("n"), F.monotonically_increasing_id().alias("u")), "pieces")
    whole = pieces.where(F.col("n") >= capacity).select("i", "piece", "n", F.concat(F.lit("w"), F.col("u")).alias("container"), F.col("n").alias("fill"))
    rest = pieces.where(F.col("n") < capacity)
    schema = pieces.select("u", "n").schema.add("container", "string").add("fill", "long")
    placed: DataFrame | None = None
    turn, left, count = 0, rest.select("u", "n"), rest.count()
    while True:
        tasks = max(1, -(-count // block))
        dealt = left.withColumn("task", F.pmod(F.xxhash64("u", F.lit(turn)), F.lit(tasks)))
        packed = stage(dealt.groupBy("task").applyInPandas(_filler(capacity, turn), schema), "packed")
        open_below = _bar(packed, count, closed * capacity) if tasks > 1 else 0
        final = packed.where(F.col("fill") >= open_below).select("u", "container", "fill")
        placed = final if placed is None else placed.unionByName(final)
        left = packed.where(F.col("fill") < open_below).select("u", "n")
        count, turn = left.count() if open_below else 0, turn + 1
        if not count:
            break
    out = whole.unionByName(placed.join(rest, "u").select("i", "piece", "n", "container", "fill"))
    return out.select(F.col("i").alias(id), "piece", F.col("n").alias("piece_size"), "container", F.col("fill").alias("container_fill"))
