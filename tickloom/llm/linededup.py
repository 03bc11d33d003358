"""Line de-duplication with a sharded minimal perfect hash over the repeated lines.

1. One pass hashes every line key (128 bits) and writes (document, hash) arrays, a row per slice of text.
2. Hashes are counted in partial aggregates; those found in two documents or more go to shards of bounded size. A shard
   becomes arrays: the levels of a minimal perfect hash (bits and their ranks; a key rests at the first level where no
   other key hits its bit), and by index a 64-bit fingerprint, the number of documents and the smallest document.
3. The hash arrays of the documents are cut by shard and meet the shard's arrays, a bounded part of a hot shard at a
   time; numpy probes them (index, fingerprint, holder). No line is joined with a line.
4. A row meets the hashes it loses by its id and its text's hash, so rows of one id (or of none) do not gather in one
   place, and its text is cut again in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tickloom.llm.common import map_slices, raw_texts
from tickloom.session import stable

MIN_CHARS = 10
#: Hashes to a shard, and entries probed in one group.
SHARD_LINES = 200_000
GROUP_LINES = 1_000_000
#: Bits per key at a level of the perfect hash.
GAMMA = 2
#: Stands for a null doc_id: one document that sorts after all others.
NO_ID = 2**63 - 1


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The line stripped of ASCII white space, A-Z lower-cased; None if shorter than ``min_chars`` code points."""
    key = line.strip().lower()
    if len(key) < min_chars or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key


def _mixed(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    x = h1 + np.uint64(level + 1) * h2
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct (h1, h2) pairs to 0..n-1, in a few bits a key: a bit array and its ranks for each level."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.starts = np.cumsum(sizes) - sizes
        self.ranks = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)]

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        sizes, words = [], []
        while len(h1):
            size = -(-max(64, GAMMA * len(h1)) // 64) * 64
            at = (_mixed(h1, h2, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            rest = ~alone[at]
            h1, h2 = h1[rest], h2[rest]
        return cls(np.array(sizes, dtype=np.int64), np.concatenate(words) if words else np.zeros(0, dtype=np.uint64))

    def index(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The number of each pair; -1 for some that were not built in, an arbitrary number for the others of these."""
        found = np.full(len(h1), -1, dtype=np.int64)
        left = np.arange(len(h1))
        for level, (size, start) in enumerate(zip(self.sizes, self.starts)):
            if not len(left):
                break
            at = start + (_mixed(h1[left], h2[left], level) % np.uint64(size)).astype(np.int64)
            word, bit = at // 64, (at % 64).astype(np.uint64)
            here = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            number = self.ranks[word] + np.bitwise_count(below)
            found[left[here]] = number[here]
            left = left[~here]
        return found


def _fingerprint(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return h1 ^ ((h2 << np.uint64(1)) | (h2 >> np.uint64(63)))


def _hashes(batch: pa.RecordBatch, column: str, row: int) -> np.ndarray:
    return np.frombuffer(batch.column(column)[row].as_py(), dtype=np.uint64)


def _key(docs: DataFrame):
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID))


def _route(docs: DataFrame):
    """Where a row's losses go, beside its key. Rows of one key that share it lose the same lines anyway."""
    return F.xxhash64(docs["text"])


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """docs, routes, h1, h2 (arrays as binary), n: the distinct (row, line) pairs of each slice of text; copies under one key count once."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        owners, routes, digests = [], [], []
        seen: set[tuple[int, bytes]] = set()
        for key, route, text in zip(batch.column("key").to_pylist(), batch.column("route").to_pylist(), raw_texts(batch)):
            if (key, text) in seen:
                continue
            seen.add((key, text))
            keys = {k for line in text.split(b"\n") if (k := line_key(line, min_chars)) is not None}
            owners += [key] * len(keys)
            routes += [route] * len(keys)
            digests += [xxhash.xxh3_128_digest(k) for k in keys]
        if not owners:
            return None
        h = np.frombuffer(b"".join(digests), dtype=np.uint64).reshape(-1, 2)
        return pa.RecordBatch.from_pydict({"docs": [np.array(owners, dtype=np.int64).tobytes()], "routes": [np.array(routes, dtype=np.int64).tobytes()],
                                              "h1": [h[:, 0].tobytes()], "h2": [h[:, 1].tobytes()], "n": [len(owners)]})

    return map_slices(docs.select(_key(docs).alias("key"), _route(docs).alias("route"), "text"), work, "docs binary, routes binary, h1 binary, h2 binary, n long")


def repeated(packed: DataFrame) -> DataFrame:
    """h1, h2, first, n: the line hashes found in two documents or more, their smallest document and how many copies."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                h = np.stack([_hashes(batch, "h1", r), _hashes(batch, "h2", r)], axis=1)
                owner = _hashes(batch, "docs", r).view(np.int64)
                order = np.lexsort((owner, h[:, 1], h[:, 0]))
                h, owner = h[order], owner[order]
                start = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]).any(axis=1)])
                size = np.diff(np.r_[start, len(owner)])
                yield pa.RecordBatch.from_pydict({"h1": h[start, 0].view(np.int64), "h2": h[start, 1].view(np.int64),
                                                  "first": owner[start], "last": owner[start + size - 1], "n": size.astype(np.int64)})

    counted = packed.select("docs", "h1", "h2").mapInArrow(work, "h1 long, h2 long, first long, last long, n long")
    return (counted.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
            .filter("first != last").select("h1", "h2", "first", "n"))


def index(lines: DataFrame, shards: int) -> DataFrame:
    """One row a shard: the perfect hash of its lines and the fingerprint, count and holder arrays by index."""

    def build(group: pa.Table) -> pa.Table:
        h1, h2 = (group.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        perfect = PerfectHash.build(h1, h2)
        at = perfect.index(h1, h2)
        prints, holder, count = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64), np.zeros(len(at), np.uint32)
        prints[at], holder[at] = _fingerprint(h1, h2), group.column("first").to_numpy()
        count[at] = np.minimum(group.column("n").to_numpy(), 2**32 - 1)
        return pa.table({"shard": group.column("shard").slice(0, 1), "sizes": [perfect.sizes.tobytes()], "words": [perfect.words.tobytes()],
                         "prints": [prints.tobytes()], "counts": [count.tobytes()], "holders": [holder.tobytes()]})

    dealt = lines.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(build, "shard int, sizes binary, words binary, prints binary, counts binary, holders binary")


def losses(docs: DataFrame, min_chars: int = MIN_CHARS, shard_lines: int = SHARD_LINES, group_lines: int = GROUP_LINES) -> DataFrame:
    """key, route, lost (arrays of 128-bit line hashes as binary): what each row loses; rows that lose nothing have none."""
    packed = stable(hashed_lines(docs, min_chars))
    total = packed.agg(F.sum("n")).first()[0] or 0
    shards = max(8, -(-total // shard_lines))
    arrays = index(repeated(packed), shards)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                owner, route, h1, h2 = (_hashes(batch, c, r) for c in ("docs", "routes", "h1", "h2"))
                shard = h1.view(np.int64) % shards
                order = np.argsort(shard, kind="stable")
                own, start = np.unique(shard[order], return_index=True)
                parts = np.split(order, start[1:])
                yield pa.RecordBatch.from_pydict({"shard": own.astype(np.int32), "slice": pa.array([batch.column("slice")[r].as_py()] * len(own), pa.int64()), "n": [len(p) for p in parts],
                                                  **{c: [a[p].tobytes() for p in parts] for c, a in (("docs", owner), ("routes", route), ("h1", h1), ("h2", h2))}})

    # The rows are a checkpoint's, so a slice made again has the same number.
    sliced = packed.withColumn("slice", F.monotonically_increasing_id()).select("slice", "docs", "routes", "h1", "h2")
    probes = sliced.mapInArrow(cut, "shard int, slice long, n long, docs binary, routes binary, h1 binary, h2 binary")
    groups = probes.groupBy("shard").agg(F.ceil(F.sum("n") / group_lines).cast("int").alias("parts"))
    probes = probes.join(groups, "shard").withColumn("part", F.pmod(F.xxhash64("slice"), F.col("parts")).cast("int"))
    copies = arrays.join(groups, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def probe(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: dict[str, list] = {"key": [], "route": [], "lost": []}
        if held.num_rows:
            row = {c: held.column(c)[0].as_py() for c in ("sizes", "words", "prints", "counts", "holders")}
            perfect = PerfectHash(np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["words"], np.uint64))
            prints, holder, count = np.frombuffer(row["prints"], np.uint64), np.frombuffer(row["holders"], np.int64), np.frombuffer(row["counts"], np.uint32)
            for r in range(asked.num_rows):
                owner, route, h1, h2 = (np.frombuffer(asked.column(c)[r].as_py(), np.uint64) for c in ("docs", "routes", "h1", "h2"))
                owner, route, at = owner.view(np.int64), route.view(np.int64), perfect.index(h1, h2)
                known = np.flatnonzero(at >= 0)
                at = at[known]
                lost = known[(prints[at] == _fingerprint(h1[known], h2[known])) & (count[at] > 1) & (holder[at] != owner[known])]
                if len(lost):
                    # In a fixed order, so that copies of a text give equal arrays.
                    lost = lost[np.lexsort((h2[lost], h1[lost], route[lost], owner[lost]))]
                    start = np.flatnonzero(np.r_[True, (owner[lost[1:]] != owner[lost[:-1]]) | (route[lost[1:]] != route[lost[:-1]])])
                    out["key"] += owner[lost[start]].tolist()
                    out["route"] += route[lost[start]].tolist()
                    out["lost"] += [np.stack([h1[p], h2[p]], axis=1).tobytes() for p in np.split(lost, start[1:])]
        return pa.table({"key": pa.array(out["key"], pa.int64()), "route": pa.array(out["route"], pa.int64()), "lost": pa.array(out["lost"], pa.binary())})

    asked = probes.select("shard", "part", "docs", "routes", "h1", "h2").groupBy("shard", "part")
    found = asked.cogroup(copies.drop("parts").groupBy("shard", "part")).applyInArrow(probe, "key long, route long, lost binary")
    # A text loses one array a shard, however many copies of it stand under its key.
    return found.groupBy("key", "route").agg(F.collect_set("lost").alias("lost"))


def _unused(names: list[str], base: str) -> str:
    while base.lower() in {n.lower() for n in names}:
        base += "_"
    return base


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS, shard_lines: int = SHARD_LINES, group_lines: int = GROUP_LINES,
                 counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the lines dropped from text, and n_chars, if it is there, brought up to date.

    A line goes if its key (``line_key``) stands in two documents or more and this is not the one of smallest doc_id.
    Rows of one doc_id, repeated or not, are one document; null ids are one document too, after all others. A null
    text stays null and counts as one empty line. An empty table stays empty, and texts of any length are read whole.
    Further columns may have any names. ``counts`` names two more columns for lines before and dropped.
    """
    names = docs.columns
    key, route, gone_at = (_unused(names, c) for c in ("__key", "__route", "__lost"))
    marked = docs.withColumns({key: _key(docs), route: _route(docs)})
    lost = losses(docs, min_chars, shard_lines, group_lines).toDF(key, route, gone_at)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in counts or ())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, lines, gone = [], [], []
        nulls = batch.column("text").is_null().to_pylist()
        for text, null, lost in zip(raw_texts(batch), nulls, batch.column(gone_at).to_pylist()):
            own = text.split(b"\n")
            keep = own
            if lost:
                hashes = {part[at:at + 16] for part in lost for at in range(0, len(part), 16)}
                keep = [line for line in own if (k := line_key(line, min_chars)) is None or xxhash.xxh3_128_digest(k) not in hashes]
            texts.append(None if null else b"\n".join(keep))
            lines.append(len(own))
            gone.append(len(own) - len(keep))
        text = pa.array(texts, pa.binary()).cast(pa.string())
        columns = {c: batch.column(c) for c in names} | {"text": text}
        if "n_chars" in columns:
            size = pa.compute.utf8_length(text)
            columns["n_chars"] = pa.compute.coalesce(size.cast(columns["n_chars"].type), columns["n_chars"]) if pa.types.is_integer(columns["n_chars"].type) else columns["n_chars"]
        return pa.RecordBatch.from_arrays([*columns.values(), *([pa.array(lines, pa.int64()), pa.array(gone, pa.int64())] if counts else [])], names=schema.names)

    return map_slices(marked.join(lost, [key, route], "left").select(*names, gone_at), work, schema)


def report(docs: DataFrame, **limits: int) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of ``docs``, from ``deduplicated``."""
    found = deduplicated(docs.select(F.col("doc_id").cast("long"), "text"), counts=("n_lines", "n_dropped"), **limits)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
