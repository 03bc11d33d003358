"""Best-fit packing of token pieces into sequences, by bin completion with branch and bound.

Only the number of pieces of each length matters to a packing, so the search runs on that histogram: at most as many
numbers as a sequence has tokens, whatever the corpus. The search takes the largest length left, enumerates the
undominated fillings of the room around it and uses the chosen one as often as the counts allow, or once; a branch whose
waste already rules out fewer sequences than the incumbent is cut. The first incumbent is best-fit decreasing. A narrow
search comes first (few fillings a step, each as often as it goes); if it misses the lower bound, wider ones follow until
one has left nothing out, which proves the incumbent, or the work allowed is used up.

The result is a list of fillings with multiplicities. The pieces of a length are numbered across the cluster (numbers
within bounded buckets plus the buckets' offsets), and the number alone tells a piece its sequence and place.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tickloom.llm.common import map_slices
from tickloom.llm.tokens import encoded
from tickloom.session import stable

CAPACITY = 2048
END_ID = 0
#: Bounds of the narrow search: fillings tried at a step, nodes of their enumeration, steps. The wider ones try WIDER times
#: as many fillings and nodes each and have WORK nodes and lengths read in all. Any stop leaves the incumbent.
BRANCHES, FILLING_NODES, STEPS = 3, 400, 6_000
WIDER, WORK = 8, 500_000
#: Pieces of one length numbered in one window group.
BUCKET_ROWS = 50_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

Plan = list[tuple[int, tuple[int, ...]]]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The token pieces of every row of ``docs`` (doc_id, text): its ids and the end id, cut if longer than ``capacity``.

    All pieces but the first are full. Null and empty texts are one piece that holds the end id; a null doc_id stays
    null; repeated rows give repeated pieces.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        found = encoded([t or "" for t in batch.column("text").to_pylist()], tokenizer)
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), found):
            ids += end
            n, start, number = len(ids) // 4, 0, 0
            stop = n % capacity or min(n, capacity)
            while start < n:
                out.append((doc_id, number, start, stop - start, zlib.crc32(ids[4 * start:4 * stop])))
                start, stop, number = stop, stop + capacity, number + 1
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                                          names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), work, PIECES)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing needs fewer bins: total size, and items too large to share counted for every threshold."""
    size = np.array(sorted(counts), dtype=np.int64)
    if not len(size):
        return 0
    n = np.array([counts[s] for s in size], dtype=np.int64)
    best = -(-int((size * n).sum()) // capacity)
    for least in [0, *[int(s) for s in size if s <= capacity // 2]]:
        alone, half = size > capacity - least, (size <= capacity - least) & (size > capacity // 2)
        small = (size >= least) & (size <= capacity // 2)
        room = int(((capacity - size) * n)[half].sum())
        best = max(best, int(n[alone].sum() + n[half].sum()) + max(0, -(-(int((size * n)[small].sum()) - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing, equal bins at a time."""
    bins: dict[int, dict[tuple[int, ...], int]] = {}
    rooms: list[int] = []

    def put(room: int, filling: tuple[int, ...], times: int) -> None:
        if not times:
            return
        if room not in bins:
            bins[room] = {}
            insort(rooms, room)
        bins[room][filling] = bins[room].get(filling, 0) + times

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_right(rooms, size - 1)
            if at == len(rooms):
                room, filling, there = capacity, (), left
            else:
                room = rooms[at]
                filling, there = bins[room].popitem()
                if not bins[room]:
                    del bins[room]
                    rooms.pop(at)
            # The fitting bin stays the best fit until it is full, so it gets all it can hold.
            each = min(room // size, left)
            times = min(there, left // each)
            if there != left or filling:
                put(room, filling, there - times)
            put(room - each * size, filling + (size,) * each, times)
            left -= each * times
    return [(times, filling) for group in bins.values() for filling, times in group.items()]


def fillings(counts: dict[int, int], sizes: list[int], room: int, keep: int, nodes: int) -> tuple[list[tuple[int, tuple[int, ...]]], int, bool]:
    """(the best undominated fillings of ``room``: (waste, sizes), least waste first; nodes used; whether they are all).

    ``sizes``: those left, ascending."""
    found: list[tuple[int, tuple[int, ...]]] = []
    left = nodes

    def extend(rest: int, top: int, chosen: tuple[int, ...]) -> None:
        nonlocal left
        at = min(top, bisect_right(sizes, rest) - 1)
        any_fit = False
        while at >= 0:
            size = sizes[at]
            if chosen.count(size) < counts[size]:
                any_fit = True
                left -= 1
                extend(rest - size, at, chosen + (size,))
                if left <= 0 or sum(w == 0 for w, _ in found) >= keep:
                    return
            at -= 1
        if not any_fit:
            # Dominated: one size could give way to a larger one that also fits.
            for size in set(chosen):
                larger = bisect_right(sizes, size)
                if larger < len(sizes) and sizes[larger] <= size + rest and chosen.count(sizes[larger]) < counts[sizes[larger]]:
                    if found:
                        return
            found.append((rest, chosen))

    extend(room, len(sizes) - 1, ())
    whole = left > 0 and len(found) <= keep and sum(w == 0 for w, _ in found) < keep
    return sorted(found, key=lambda f: (f[0], len(f[1]), [-s for s in f[1]]))[:keep], nodes - left, whole


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, branches: int = BRANCHES, nodes: int = FILLING_NODES, steps: int = STEPS, work: int = WORK) -> Plan:
    """(times, sizes) of a packing of ``counts`` pieces of each size: the best found within ``steps`` of the narrow search
    and ``work`` of the wider ones, which is optimal if it has as few sequences as ``lower_bound`` or if a search came to its end with nothing left out."""
    counts = {s: n for s, n in counts.items() if n}
    best, bound = best_fit(counts, capacity), lower_bound(counts, capacity)
    best, _, proved = _search(counts, capacity, best, bound, branches, nodes, None, steps)
    while sum(t for t, _ in best) > bound and work > 0 and not proved:
        branches, nodes = branches * WIDER, nodes * WIDER
        best, used, proved = _search(counts, capacity, best, bound, branches, nodes, work, None)
        work -= used
    return best


def _search(counts: dict[int, int], capacity: int, best: Plan, bound: int, branches: int, nodes: int, work: int | None, steps: int | None) -> tuple[Plan, int, bool]:
    """(the better plan, work used, whether nothing was left out) of one depth-first search, bounded by ``work`` or, as the
    narrow one that uses each filling as often as it goes, by ``steps``."""
    total, fewest = sum(s * n for s, n in counts.items()), sum(t for t, _ in best)
    narrow, used, all_tried = steps is not None, 0, steps is None
    # What is left after a number of sequences: the fewest that led there. As many entries as steps.
    reached: dict[tuple, int] = {}
    frames: list[tuple[dict[int, int], int, Plan, list]] = []
    now: tuple[dict[int, int], int, Plan] | None = (counts, 0, [])
    while fewest > bound:
        if (work is not None and used >= work) or steps == 0:
            return best, used, False
        if now is not None:
            left, waste, plan = now
            now = None
            bins = sum(t for t, _ in plan)
            if not left:
                if bins < fewest:
                    best, fewest = plan, bins
                continue
            state = tuple(sorted(left.items()))
            if not narrow:
                if reached.get(state, fewest) <= bins:
                    continue
                reached[state] = bins
            large = state[-1][0]
            inner = {**left, large: left[large] - 1}
            found, cost, whole = fillings(inner, [s for s, _ in state if inner[s]], capacity - large, branches, nodes)
            used += cost + len(state)
            all_tried &= whole
            steps = steps - 1 if narrow else None
            options = []
            for lost, filling in found:
                own = (large, *filling)
                most = min(left[s] // own.count(s) for s in set(own))
                options += [(lost, own, times) for times in ([most] if narrow or most == 1 else [most, 1])]
            frames.append((left, waste, plan, options[::-1]))
        if not frames:
            break
        left, waste, plan, options = frames[-1]
        if not options:
            frames.pop()
            continue
        lost, own, times = options.pop()
        waste += lost * times
        if waste <= (fewest - 1) * capacity - total:
            rest = {s: n - times * own.count(s) for s, n in left.items()}
            now = ({s: n for s, n in rest.items() if n}, waste, [*plan, (times, own)])
    return best, used, all_tried


def places(plan: Plan) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: the first number of each run of pieces, the sequence of that number, and their offset there."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    number: dict[int, int] = {}
    base = 0
    for times, filling in plan:
        offset = 0
        for size in filling:
            first = number.get(size, 0)
            runs.setdefault(size, []).append((first, base, offset))
            number[size] = first + times
            offset += size
        base += times
    return {size: tuple(np.array(c, dtype=np.int64) for c in zip(*own)) for size, own in runs.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Sequence and offset of every piece of ``cut`` (the columns of ``pieces``). An empty table gives no rows.

    The driver sees one count a length, at most ``capacity`` of them, and the plan: its distinct fillings."""
    cut = stable(cut)
    counts = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}
    where = places(bin_completion(counts, capacity))
    buckets = -(-max(counts.values(), default=1) // bucket_rows)
    # The rows are a checkpoint's, so a row read again has the same number; its hash deals equal pieces evenly too.
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = cut.withColumn("own", F.row_number().over(within)).join(offsets, ["length", "bucket"]).withColumn("number", F.col("before") + F.col("own") - 1)

    def work(batches):
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for size in np.unique(length):
                first, base, at = where[int(size)]
                rows = np.flatnonzero(length == size)
                run = np.searchsorted(first, number[rows], side="right") - 1
                sequence[rows], offset[rows] = base[run] + number[rows] - first[run], at[run]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(work, PACKED)
