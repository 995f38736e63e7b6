"""Duplicates hidden by formatting: canonical records, range-partitioned, sorted and scanned in runs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from loomgrid.session import release, stage

_PIECES = re.compile(r"[(\[{]|[)\]}]|[,;]|[^()\[\]{},;]+")
_NAMED = re.compile(r"\s*[^\W\d]\w*\s*(?:=(?!=)|:)")
_REST = re.compile(r"[\W_]+")


def _close(frame: list[tuple[bool, list[str]]]) -> str:
    """One call's arguments: positional ones in their order, then named ones sorted."""
    args = [(named, "".join(parts)) for named, parts in frame]
    return "".join(t for named, t in args if not named) + "".join(sorted(t for named, t in args if named))


def canonical(text: str) -> str:
    """Letters and digits in lower case, with the named arguments of each call in sorted order.

    Any bracket opens a call; a comma or semicolon inside it ends an argument; ``name=value`` and
    ``name: value`` are named arguments. Brackets that close nothing are ignored, and those left open close at the end.
    """
    top: list[str] = []
    stack: list[list[tuple[bool, list[str]]]] = []
    fresh = False
    for piece in _PIECES.findall(text):
        if piece in "([{":
            stack.append([(False, [])])
            fresh = True
        elif piece in ")]}":
            if stack:
                done = _close(stack.pop())
                (stack[-1][-1][1] if stack else top).append(done)
            fresh = False
        elif piece in ",;":
            if stack:
                stack[-1].append((False, []))
                fresh = True
        else:
            plain = _REST.sub("", piece.lower())
            if stack:
                if fresh and not piece.isspace():
                    stack[-1][-1] = (bool(_NAMED.match(piece)), stack[-1][-1][1])
                    fresh = False
                stack[-1][-1][1].append(plain)
            else:
                top.append(plain)
    while stack:
        done = _close(stack.pop())
        (stack[-1][-1][1] if stack else top).append(done)
    return "".join(top)


_BORDER = ["head_kind", "head_key", "head_id", "tail_kind", "tail_key", "tail_id", "tail_first", "single"]
_SCAN = pa.schema(
    [("part", pa.int32()), ("id", pa.int64()), ("first_id", pa.int64()), ("head", pa.bool_()), ("copies", pa.int64()), ("edge", pa.bool_())]
    + [(n, pa.bool_() if n == "single" else pa.int64() if n.endswith(("id", "first")) else pa.string()) for n in _BORDER]
)


def _scanner(runs_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compares each sorted record with the one before; only the current run is kept between batches.

    Gives every record the first id of its run in this partition, or, with ``runs_only``, every run its first id and its number of
    records; then one row with the partition's borders.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        begin = last = None
        runs, held = 0, 0  # held: records of the open run
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            kind, key = (np.array(batch.column(c).to_pylist(), dtype=object) for c in ("kind", "key"))
            ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            new, again = np.ones(n, dtype=bool), np.zeros(n, dtype=bool)
            new[1:] = (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])
            again[1:] = ~new[1:] & (ids[1:] == ids[:-1])
            if begin is None:
                begin = (kind[0], key[0], int(ids[0]))
            elif last[:2] == (kind[0], key[0]):
                new[0], again[0] = False, last[2] == ids[0]
            at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            firsts = np.where(at >= 0, ids[at], 0 if last is None else last[3])
            number = np.cumsum(new) + runs
            keep = ~again
            if runs_only:
                counts = np.bincount(number[keep] - runs, minlength=int(number[-1]) - runs + 1)
                counts[0] += held  # the run that was open
                ended = np.r_[0 if last is None else last[3], firsts[new]]
                numbers = np.arange(runs, int(number[-1]) + 1)
                done = (numbers < number[-1]) & (numbers > 0)
                yield _rows(part=[part] * int(done.sum()), first_id=ended[done], copies=counts[done], head=numbers[done] == 1, edge=numbers[done] == 1)
                held = int(counts[-1])
            else:
                yield _rows(part=[part] * int(keep.sum()), id=ids[keep], first_id=firsts[keep], head=(number <= 1)[keep])
            runs, last = int(number[-1]), (kind[-1], key[-1], int(ids[-1]), int(firsts[-1]))
        if begin is not None:
            if runs_only:
                yield _rows(part=[part], first_id=[last[3]], copies=[held], head=[runs <= 1], edge=[True])
            values = (*begin, *last, runs <= 1)
            yield _rows(part=[part], **{n: [v] for n, v in zip(_BORDER, values)})

    return scan


def _rows(**columns: object) -> pa.RecordBatch:
    n = len(columns["part"])
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SCAN], schema=_SCAN)


def _scanned(records: DataFrame, id: str, kind: str, text: str, key: Callable[[str], str], runs_only: bool) -> DataFrame:
    """The scan's rows, each with what the partitions before say about its partition's first run: ``true_first, repeated``."""
    spark = records.sparkSession
    rows = records.where(F.col(id).isNotNull() & F.col(text).isNotNull()).select(F.col(id).cast("bigint").alias("id"), F.coalesce(F.concat(F.lit("="), F.col(kind)), F.lit("")).alias("kind"), F.col(text).alias("text"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = pa.array([key(t) for t in b.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("kind"), keys], names=["id", "kind", "key"])

    canon = stage(rows.mapInArrow(keyed, "id bigint, kind string, key string"), "canonical")
    ordered = canon.repartitionByRange("kind", "key", "id").sortWithinPartitions("kind", "key", "id")
    scanned = stage(ordered.mapInArrow(_scanner(runs_only), from_arrow_schema(_SCAN)), "runs")
    release(canon)
    borders = scanned.where(F.col("single").isNotNull()).orderBy("part").collect()  # one row per partition
    carried, carry = [], None
    for b in borders:
        here = (b.head_kind, b.head_key)
        if carry and carry[0] == here:
            carried.append((b.part, carry[1], b.head_id if b.head_id == carry[2] else None))
        same_run = bool(carry) and carry[0] == here and b.single
        carry = ((b.tail_kind, b.tail_key), carry[1] if same_run else b.tail_first, b.tail_id)
    fixes = spark.createDataFrame(carried, "part int, true_first bigint, repeated bigint")
    out = scanned.where(F.col("single").isNull()).join(F.broadcast(fixes), "part", "left")
    return out.withColumn("first_id", F.when(F.col("head"), F.coalesce("true_first", "first_id")).otherwise(F.col("first_id")))


def collapse(records: DataFrame, id: str, kind: str, text: str, key: Callable[[str], str] = canonical) -> DataFrame:
    """Every distinct record id with the smallest id of its group: ``id, first_id``.

    Two records are copies if their kinds are equal and their canonical texts are equal in full. Canonical
    records are range-partitioned and externally sorted by (kind, key, id); each partition is scanned once, in
    batches, comparing adjacent records. A run that crosses partitions (a hot group is split by id) gets its
    representative from the partitions before, through one row of borders per partition. No group is gathered.

    Nulls: a record with a null id or text is no record; a null kind is a kind of its own. A text without letters
    and digits has the empty key, and such texts are copies of each other. An id delivered twice with one text is
    one record. Very long texts are compared whole. Empty in, empty out. Other columns are ignored.
    """
    out = _scanned(records, id, kind, text, key, False)
    repeated = F.coalesce(F.col("head") & (F.col("id") == F.col("repeated")), F.lit(False))
    return out.where(~repeated).select("id", "first_id")


def copies(records: DataFrame, id: str, kind: str, text: str, key: Callable[[str], str] = canonical) -> DataFrame:
    """One representative per distinct record with its exact number of copies, itself included: ``first_id, n_copies``.

    The scan counts as it goes and gives one row per run; only the first and last runs of partitions are added up afterwards.
    """
    runs = _scanned(records, id, kind, text, key, True)
    runs = runs.select("first_id", (F.col("copies") - F.when(F.col("head") & F.col("repeated").isNotNull(), 1).otherwise(0)).alias("n_copies"), "edge")
    edges = runs.where("edge").groupBy("first_id").agg(F.sum("n_copies").alias("n_copies"))
    return runs.where(~F.col("edge")).select("first_id", "n_copies").unionByName(edges)
