"""Operator 4: exact repeats of long byte strings by external induced sorting of sampled suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from ..operators.scale import frozen, release
from .common import ship, utf8

SIZE = 400  # bytes of a string that counts as repeated
GRAM = 200  # bytes by which sampled suffixes are first grouped
TOGETHER = 8192  # sampled suffixes whose order is induced at a time, about
LARGE = 4096  # a group of more different suffixes than this is compared window by window
_PART = 1 << 18  # windows of a text that are looked at together

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def gram_hashes(byte: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` bytes in a row, put together from those of powers of two."""
    power = (byte.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    power ^= power >> np.uint64(32)
    length, done, out = 1, 0, None
    n = len(byte)
    while True:
        if size & length:
            if out is None:
                out, done = power, length
            else:
                many = n - done - length + 1
                shift = np.uint64(pow(_BASE, length, 1 << 64))
                out = out[:many] * shift + power[done : done + many]
                done += length
        if length * 2 > size:
            break
        many = n - 2 * length + 1
        shift = np.uint64(pow(_BASE, length, 1 << 64))
        power = power[:many] * shift + power[length : length + many]
        length *= 2
    out = (out ^ (out >> np.uint64(29))) * _MIX
    return out ^ (out >> np.uint64(32))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    n = len(values) - width + 1
    length = 1
    while length * 2 <= width:
        values = pick(values[:-length], values[length:])
        length *= 2
    return pick(values[:n], values[width - length : width - length + n])


def samples(text: bytes, size: int = SIZE, gram: int = GRAM) -> Iterator[tuple[int, int, int, int]]:
    """(gram hash, first window, last window, sampled suffix) of each run of windows of a text.

    A window is ``size`` bytes. Its sampled suffix begins at the leftmost smallest gram hash in
    it, so equal windows sample at the same offset whatever surrounds them, and each window
    belongs to one run. Long texts are taken in parts, which only cuts runs in two.
    """
    width = size - gram + 1
    for begin in range(0, len(text) - size + 1, _PART):
        byte = np.frombuffer(text, np.uint8)[begin : begin + _PART + size - 1]
        h = gram_hashes(byte, gram)
        low = _sliding(h, width, np.minimum)
        edge = np.zeros(width - 1, np.uint64)
        used = np.flatnonzero(_sliding(np.concatenate((edge, low, edge)), width, np.maximum) == h)
        places, values = used.tolist(), h[used].tolist()
        starts = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        k = 0
        for s, end, v in zip(
            starts.tolist(), [*starts[1:].tolist(), len(low)], low[starts].tolist(), strict=True
        ):
            while places[k] < s:
                k += 1
            j = k
            while s < end:
                while values[j] != v:
                    j += 1
                last = min(end - 1, places[j])
                yield v, begin + s, begin + last, begin + places[j]
                s = last + 1
                j += 1


def induced(group: np.ndarray, texts: list[bytes], at: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Which windows of each text occur in another text of its group, by their distance d.

    Text i holds a sampled suffix at ``at[i]`` and what lies ``at[i]`` bytes before it; its window
    d begins d bytes before the sample. First the sampled suffixes of a group are sorted, with the
    common prefix of each and the one before. Then the order of the suffixes one byte further left
    is induced from it, again and again: they sort by that byte and, among equal bytes, as their
    samples did; the common prefix of two that become neighbours is the least of those between
    them. Window d is repeated if a neighbour in the order of step d shares size - d bytes from
    the sample on. Those whose left contexts have parted leave the order.
    """
    m = len(texts)
    reach = int(at.max(initial=0))
    right = np.zeros((m, size), ">u2")  # bytes plus one; zero is where a text ends
    left = np.zeros((m, max(reach, 1)), np.int64)
    long = np.zeros(m, np.int64)
    for i, t in enumerate(texts):
        b = np.frombuffer(t, np.uint8).astype(np.int64) + 1
        after = b[at[i] : at[i] + size]
        long[i] = len(after)
        right[i, : len(after)] = after
        before = b[: at[i]][::-1]
        left[i, : len(before)] = before
    rank = np.unique(right.view(f"S{2 * size}").ravel(), return_inverse=True)[1]
    order = np.lexsort((rank, group))
    same = right[order[1:]] == right[order[:-1]]
    share = np.where(same.all(1), size, same.argmin(1))
    share = np.minimum(share, np.minimum(long[order[1:]], long[order[:-1]]))
    run = np.unique(group, return_inverse=True)[1][order]
    common = np.concatenate(([0], share))  # of each with the one before
    repeated = np.zeros((m, reach + 1), bool)
    for d in range(reach + 1):
        if d:
            letter = left[order, d - 1]
            key = np.where(letter > 0, run * 512 + letter, -1)
            place = np.argsort(key, kind="stable")
            place = place[np.searchsorted(key[place], 0) :]
            if len(place) < 2:
                break
            key = key[place]
            gap = np.flatnonzero((key[1:] == key[:-1]) & (place[1:] != place[:-1] + 1))
            least = common[place]
            if len(gap):
                ends = np.stack((place[gap] + 1, place[gap + 1] + 1), 1).ravel()
                padded = np.append(common, 0)
                least[gap + 1] = np.minimum.reduceat(padded, ends)[::2]
            order, common = order[place], least
            run = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
        first = np.concatenate(([True], run[1:] != run[:-1]))
        common = np.where(first, 0, common)
        enough = common >= size - d
        hit = enough | np.append(enough[1:], False)
        repeated[order[hit], d] = True
        alone = first & np.append(first[1:], True)
        if alone.any():
            stay = ~alone
            order, run, common = order[stay], run[stay], common[stay]
    return repeated


def _stretches(hit: np.ndarray, at: int, size: int) -> list[dict]:
    """The bytes, from the text's start, that the hit windows cover."""
    starts = at - np.flatnonzero(hit)[::-1]
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    lows = np.concatenate((starts[:1], starts[cut + 1]))
    highs = np.concatenate((starts[cut], starts[-1:])) + size
    return [{"a": int(a), "b": int(b)} for a, b in zip(lows, highs, strict=True)]


_STRETCH = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_PLACED = "gram long, cls long, spans array<struct<a: int, b: int>>"


def repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """``rid`` and the ``spans`` of bytes covered by repeated strings of ``size`` bytes.

    ``docs`` has ``rid`` and ``body`` (bytes). Suffixes are sampled at places that their own
    bytes decide, about one in (size - gram) / 2. Runs of windows around a sample with equal
    bytes are one class; a class with several members is repeated as a whole. Where a gram has
    several classes, one member of each brings its bytes to the task of that gram, and
    :func:`induced` finds the windows that classes share. Samples, classes and bytes travel
    through Spark's shuffles, which sort and spill on disk. A gram with more than ``LARGE``
    classes, such as a passage that stands in very many contexts, is not gathered: the windows of
    its classes are counted one by one by their 128-bit hashes. Rows are told apart and classes
    matched by 64-bit hashes.
    """

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, grams, classes, starts, runs, ats = [], [], [], [], [], []
            for rid, text in zip(batch["rid"].to_pylist(), batch["body"].to_pylist(), strict=True):
                for g, s, last, p in samples(text, size, gram):
                    rids.append(rid)
                    grams.append(g)
                    classes.append(xxh3_64_intdigest(text[s : last + size], p - s))
                    starts.append(s)
                    runs.append(last - s)
                    ats.append(p - s)
            for k in range(0, len(rids), 100_000):
                part = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.array(grams[part], np.uint64).view(np.int64)),
                        pa.array(np.array(classes[part], np.uint64).view(np.int64)),
                        pa.array(rids[part], pa.int64()),
                        pa.array(starts[part], pa.int64()),
                        pa.array(runs[part], pa.int32()),
                        pa.array(ats[part], pa.int32()),
                    ],
                    ["gram", "cls", "rid", "s", "run", "at"],
                )

    every = frozen(
        docs.mapInArrow(sample, "gram long, cls long, rid long, s long, run int, at int")
    )
    # stored, so that the join below is nothing but a join, whose hot grams Spark can split
    often = frozen(every.groupBy("gram").count().filter("count > 1").select("gram"))
    known = frozen(every.join(often, "gram"))
    release(every, often)
    classes = frozen(
        known.groupBy("gram", "cls").agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct("rid", "s", "run", "at")).alias("m"),
        )
    )
    several = frozen(
        classes.groupBy("gram").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    )
    wanted = frozen(
        classes.join(several, "gram").select(
            "gram", "cls", "classes", "m.rid", "m.s", "m.run", "m.at"
        )
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, parts in zip(
                batch["body"].to_pylist(), batch["parts"].to_pylist(), strict=True
            ):
                out += [{**p, "bytes": text[p["s"] : p["s"] + p["run"] + size]} for p in parts]
            for k in range(0, len(out), 20_000):
                table = pa.Table.from_pylist(out[k : k + 20_000], _CUT)
                yield from table.to_batches()

    _CUT = pa.schema(
        [
            ("gram", pa.int64()),
            ("cls", pa.int64()),
            ("classes", pa.int64()),
            ("at", pa.int32()),
            ("bytes", pa.binary()),
        ]
    )
    parts = wanted.groupBy("rid").agg(
        F.collect_list(F.struct("gram", "cls", "classes", "s", "run", "at")).alias("parts")
    )
    # repeated rows share their rid; one of them brings the bytes, and tasks combine before the shuffle
    pieces = frozen(
        docs.select("rid", "body")
        .dropDuplicates(["rid"])
        .join(parts, "rid")
        .select("body", "parts")
        .mapInArrow(cut, "gram long, cls long, classes long, at int, bytes binary")
    )

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list) -> pa.RecordBatch:
            at = np.array([r[2] for r in rows], np.int64)
            hit = induced(
                np.array([r[0] for r in rows], np.int64), [r[3] for r in rows], at, size
            )
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([_stretches(h, int(a), size) for h, a in zip(hit, at, strict=True)], _STRETCH),
                ],
                ["gram", "cls", "spans"],
            )

        held: list = []
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("gram", "cls", "at", "bytes")]
            for row in zip(*columns, strict=True):
                if len(held) >= TOGETHER and row[0] != held[-1][0]:
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    small = (
        pieces.filter(F.col("classes") <= LARGE)
        .repartition("gram")
        .sortWithinPartitions("gram")
        .select("gram", "cls", "at", "bytes")
        .mapInArrow(induce, _PLACED)
    )
    partial = frozen(
        small.unionByName(_by_windows(pieces.filter(F.col("classes") > LARGE), size)).filter(
            F.size("spans") > 0
        )
    )
    release(pieces, wanted)
    whole = classes.filter("n > 1").select(F.col("gram").alias("g"), F.col("cls").alias("c"))
    one = classes.filter("n = 1").select("gram", "cls").join(partial, ["gram", "cls"])
    # a repeated class covers all of its run, so it needs no spans of its own
    none = F.lit(None).cast("array<struct<a: int, b: int>>").alias("spans")
    states = frozen(whole.select("g", "c", none).union(one.select("gram", "cls", "spans")))
    found = known.join(states, (F.col("gram") == F.col("g")) & (F.col("cls") == F.col("c"))).select(
        "rid",
        F.transform(
            F.coalesce(
                "spans",
                F.array(F.struct(F.lit(0).alias("a"), (F.col("run") + size).alias("b"))),
            ),
            lambda x: F.struct((F.col("s") + x["a"]).alias("a"), (F.col("s") + x["b"]).alias("b")),
        ).alias("spans"),
    )
    return found.groupBy("rid").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def _by_windows(pieces: DataFrame, size: int) -> DataFrame:
    """Spans of classes from groups too large to gather, through counts of whole windows."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                text = row["bytes"]
                n = len(text) - size + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["gram"]] * n, pa.int64()),
                        pa.array([row["cls"]] * n, pa.int64()),
                        pa.array(range(n), pa.int32()),
                        pa.array([xxh3_128_digest(text[k : k + size]) for k in range(n)]),
                    ],
                    ["gram", "cls", "k", "window"],
                )

    windows = frozen(
        pieces.mapInArrow(spread, "gram long, cls long, k int, window binary")
    )
    twice = windows.groupBy("window").count().filter("count > 1").select("window")
    return (
        windows.join(twice, "window")
        .groupBy("gram", "cls")
        .agg(F.array_sort(F.collect_list("k")).alias("ks"))
        .select(
            "gram",
            "cls",
            F.transform(
                "ks", lambda k: F.struct(k.alias("a"), (k + size).cast("int").alias("b"))
            ).alias("spans"),
        )
    )


def removed(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """``doc_id``, ``kept`` (the bytes that stay) and figures of each row of ``docs``.

    A byte goes if a string of ``size`` bytes that covers it also starts elsewhere in the input,
    in the same text or another; equal rows are each other's elsewhere. Null texts count as
    empty; texts shorter than ``size`` stay as they are. ``n_spans`` counts maximal runs.
    """
    rows = docs.select("doc_id", utf8().alias("body")).withColumn(
        "rid", F.xxhash64("doc_id", "body")
    )
    # stored, so that the bodies of rows that come very often can be split among tasks
    found = frozen(repeats(rows.select("rid", "body"), size, gram))

    def strip(bodies: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, each in zip(bodies.to_pylist(), spans.to_pylist(), strict=True):
            kept, at, gone, runs = [], 0, 0, 0
            end = -1
            for x in sorted(each or [], key=lambda x: (x["a"], x["b"])):
                if x["a"] > end:
                    kept.append(text[at : x["a"]])
                    runs += 1
                    end = at = x["a"]
                if x["b"] > end:
                    gone += x["b"] - end
                    end = at = x["b"]
            kept.append(text[at:])
            rest = b"".join(kept)
            out.append(
                {
                    "kept": rest,
                    "n_bytes": len(text),
                    "n_removed": gone,
                    "n_spans": runs,
                    "kept_sha256": hashlib.sha256(rest).hexdigest(),
                }
            )
        kind = pa.struct(
            [
                ("kept", pa.binary()),
                ("n_bytes", pa.int64()),
                ("n_removed", pa.int64()),
                ("n_spans", pa.int64()),
                ("kept_sha256", pa.string()),
            ]
        )
        return pa.array(out, kind)

    kind = "kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return (
        rows.join(found, "rid", "left")
        .select("doc_id", F.arrow_udf(strip, kind)("body", "spans").alias("r"))
        .select("doc_id", "r.*")
    )


ship(__name__)
