"""Operator 12: a Merkle manifest of a table, with a proof of each row from one fetch per block."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import frozen, release, with_position
from .common import ship

RUN = 3  # nodes that one node above them stands for
BLOCK = 1024  # leaves whose proofs are made together
JOINED = 256  # blocks whose open nodes meet in one task
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = -1  # number of the tree over the trees of the groups


def leaf_of(columns: list[Column]) -> Column:
    """SHA-256 of the values in order: ``-`` for null, else the UTF-8 length, ``:`` and the value."""

    def field(c: Column) -> Column:
        text = c.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(
            F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
        )

    return F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256)


def _joined(parts: list[bytes]) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


def _sizes(n: int) -> list[int]:
    """How many nodes a tree of ``n`` leaves has on each level."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // RUN))
    return out


def _nodes(
    size: int, lo: int, nodes: list[bytes], every: bool
) -> Iterator[tuple[int, int, bytes, bool]]:
    """(level, index, digest, open) of the nodes over leaves lo, lo+1, ...: ``every`` one, or those
    that no node over them covers. The latter are open while the tree goes on above them."""
    a = lo
    for level, many in enumerate(_sizes(size)):
        if many == 1:
            if nodes:
                yield level, 0, nodes[0], False
            return
        b = a + len(nodes)
        up = -(-a // RUN)
        end = -(-b // RUN) if b == many else b // RUN
        above = [_joined(nodes[RUN * p - a : RUN * p + RUN - a]) for p in range(up, end)]
        for i, digest in enumerate(nodes, a):
            still = not up <= i // RUN < end
            if still or every:
                yield level, i, digest, still
        a, nodes = up, above


def _missing(size: int, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """The (level, index) of the nodes that proofs of leaves lo to hi - 1 need together and that
    can't be made from those leaves and from each other: the least set, each node once."""
    a, b = lo, hi
    for level, many in enumerate(_sizes(size)):
        first, last = a // RUN * RUN, min((b - 1) // RUN * RUN + RUN, many)
        yield from ((level, i) for i in (*range(first, a), *range(b, last)))
        a, b = first // RUN, (last - 1) // RUN + 1


class _Paths:
    """All nodes on and beside the paths of neighbouring leaves of one tree."""

    def __init__(self, size: int, lo: int, nodes: list[bytes], got: dict[tuple[int, int], bytes]):
        self.levels: list[tuple[int, list[bytes]]] = []  # first index and nodes, runs completed
        a = lo
        for level, many in enumerate(_sizes(size)):
            b = a + len(nodes)
            first, last = a // RUN * RUN, min((b - 1) // RUN * RUN + RUN, many)
            nodes = [
                *[got[level, i] for i in range(first, a)],
                *nodes,
                *[got[level, i] for i in range(b, last)],
            ]
            self.levels.append((first, nodes))
            a = first // RUN
            nodes = [_joined(nodes[k : k + RUN]) for k in range(0, len(nodes), RUN)]
        self.root = self.levels[-1][1][0]

    def siblings(self, tail: list[bytes]) -> list[list[bytes]]:
        """The proof of each leaf that stands in ``levels``, with ``tail`` at the end of each."""
        proofs, above = [tail], 0
        for first, nodes in self.levels[-2::-1]:
            proofs = [
                [
                    *(n for k, n in enumerate(nodes[j // RUN * RUN : j // RUN * RUN + RUN]) if k != j % RUN),
                    *proofs[(first + j) // RUN - above],
                ]
                for j in range(len(nodes))
            ]
            above = first
        return proofs


def folded(leaf: bytes, shape: list[tuple[int, int]], proof: list[bytes]) -> bytes:
    """The root that a leaf and its proof give; ``shape`` has the (place, length) of each run."""
    at = 0
    for place, length in shape:
        beside = proof[at : at + length - 1]
        at += length - 1
        leaf = _joined([*beside[:place], leaf, *beside[place:]])
    return leaf


def shape_of(size: int, index: int) -> list[tuple[int, int]]:
    """Place and length of the run of each node from leaf ``index`` up to below the root."""
    out = []
    for many in _sizes(size)[:-1]:
        out.append((index % RUN, min(RUN, many - index // RUN * RUN)))
        index //= RUN
    return out


_NODE = "block long, tree long, size long, level int, idx long, digest binary, open boolean"
_SPAN = "tree long, size long, lo long, n long"


def _scanned(blocks: DataFrame, trees: int | None) -> DataFrame:
    """One pass over blocks (block, digests, spans). With ``trees``, the number of groups: the
    uncovered nodes, and those that proofs miss, which have no digest. Without it, blocks of the
    tree above: every node, as blocks of rows anywhere may miss it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out, at = [], 0
                for s in row["spans"]:
                    digests = [d.hex().encode() for d in row["digests"][at : at + s["n"]]]
                    at += s["n"]
                    head = row["block"], s["tree"], s["size"]
                    for level, i, digest, still in _nodes(s["size"], s["lo"], digests, trees is None):
                        out.append((*head, level, i, bytes.fromhex(digest.decode()), still))
                    if trees is not None:
                        for level, i in _missing(s["size"], s["lo"], s["lo"] + s["n"]):
                            out.append((*head, level, i, None, False))
                if trees is not None:
                    first, last = row["spans"][0]["tree"], row["spans"][-1]["tree"]
                    for level, i in _missing(trees, first, last + 1):
                        out.append((row["block"], TOP, trees, level, i, None, False))
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(schema.names, r, strict=True)) for r in out], schema
                )

    schema = _node_schema()
    return blocks.mapInArrow(scan, _NODE)


def _node_schema() -> pa.Schema:
    return pa.schema(
        [
            ("block", pa.int64()),
            ("tree", pa.int64()),
            ("size", pa.int64()),
            ("level", pa.int32()),
            ("idx", pa.int64()),
            ("digest", pa.binary()),
            ("open", pa.bool_()),
        ]
    )


def _grown(nodes: DataFrame, blocks: int) -> DataFrame:
    """All nodes that blocks need of each other: ``nodes`` and those that come of joining blocks.

    Neighbouring blocks meet ``JOINED`` at a time and pass on what is still open, a few nodes for
    each of the at most two trees that reach beyond them, so no task ever sees a whole tree.
    """

    def join(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (tree, size), rows in part.groupby(["tree", "size"]):
            sizes = _sizes(size)
            known: list[dict[int, bytes]] = [{} for _ in sizes]
            for level, i, digest in zip(rows.level, rows.idx, rows.digest, strict=True):
                known[level][i] = digest.hex().encode()
            made: list[set[int]] = [set() for _ in sizes]
            for level, many in enumerate(sizes[:-1]):
                for p in sorted({i // RUN for i in known[level]}):
                    below = range(RUN * p, min(RUN * p + RUN, many))
                    if all(i in known[level] for i in below):
                        known[level + 1][p] = _joined([known[level][i] for i in below])
                        made[level + 1].add(p)
            for level, found in enumerate(known):
                for i, digest in found.items():
                    still = level < len(sizes) - 1 and i // RUN not in known[level + 1]
                    fresh = i in made[level]
                    if fresh or still:
                        out.append(
                            (part.up.iloc[0], tree, size, level, i, bytes.fromhex(digest.decode()), still, fresh)
                        )
        return pd.DataFrame(
            out, columns=["block", "tree", "size", "level", "idx", "digest", "open", "fresh"]
        )

    every, rest = nodes, nodes
    while blocks > 1:
        up = F.floor(F.col("block") / JOINED).alias("up")
        met = frozen(
            rest.filter("open").select("*", up).groupBy("up").applyInPandas(join, f"{_NODE}, fresh boolean")
        )
        every = every.unionByName(met.filter("fresh").drop("fresh"))
        rest = met.drop("fresh")
        blocks = -(-blocks // JOINED)
    return every


def proved(
    docs: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    key: str = "doc_id",
    group: str = "source",
    present: dict[str, Column] | None = None,
    siblings: bool = False,
) -> DataFrame:
    """Leaf, subroot, root and proof of each row, and the check of the row as it is ``present``.

    A row's leaf hashes its ``fields``. The leaves of each ``group``, ascending by ``key``, form a
    tree in which each node stands for three; the trees' roots, ordered by group, form the tree
    above. ``present`` has other values for some fields, as a copy of the table may hold them:
    ``folded_root`` is made from their leaf and the proof, and ``verified`` says whether that is
    the root. ``proof_sha256`` hashes the proof's digests as text; with ``siblings`` the digests
    themselves stand in ``proof``.

    Rows get their places by one sort over the cluster and lie in blocks of ``BLOCK`` neighbours,
    whatever the size of their group. A block makes the nodes over its own leaves, names the least
    set of other nodes that all its proofs need, fetches them with one join, and then expands the
    proofs of its rows without looking elsewhere.

    Null groups come first, as one group; null keys come first in their group; rows of one group
    and key are ordered by leaf, so repeated rows are interchangeable. The text of a row is read
    where it lies and never shuffled. An empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    now = leaf_of([(present or {}).get(f, F.col(f"`{f}`")) for f in fields])
    then = leaf_of([F.col(f"`{f}`") for f in fields])
    # null groups sort before all others and stay one group in joins
    name = F.when(F.col(f"`{group}`").isNull(), F.lit("")).otherwise(
        F.concat(F.lit("+"), F.col(f"`{group}`").cast("string"))
    )
    leaves = docs.select(
        name.alias("name"), F.col(f"`{key}`").alias("key"), then.alias("leaf"), now.alias("now")
    ).select(
        "name",
        "key",
        F.unhex("leaf").alias("leaf"),
        F.when(F.col("now") != F.col("leaf"), F.unhex("now")).alias("other"),
    )
    placed = frozen(
        with_position(leaves, F.col("name"), F.col("key"), F.col("leaf")).withColumn(
            "block", F.floor(F.col("position") / BLOCK)
        )
    )
    total = placed.count()
    out = (
        f"key {kind}, leaf string, subroot string, root string, proof_sha256 string,"
        " folded_root string, verified boolean" + (", proof array<string>" if siblings else "")
    )
    if not total:
        return spark.createDataFrame([], out)

    heads = frozen(
        placed.groupBy("name", "block").agg(
            F.min("position").alias("at"), F.count(F.lit(1)).alias("n")
        )
    )
    groups = frozen(
        with_position(
            heads.groupBy("name").agg(F.min("at").alias("start"), F.sum("n").alias("size")),
            F.col("name"),
            name="tree",
        )
    )
    trees = groups.count()
    spans = (
        heads.join(groups, "name")
        .groupBy("block")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("tree", "size", (F.col("at") - F.col("start")).alias("lo"), "n")
                )
            ).alias("spans")
        )
    )
    rows = placed.groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("position", "leaf", "other", "key"))).alias("rows")
    )
    blocks = frozen(rows.join(spans, "block"))
    release(placed)

    scanned = frozen(
        _scanned(blocks.select("block", F.col("rows.leaf").alias("digests"), "spans"), trees)
    )
    nodes = _grown(scanned.filter("digest IS NOT NULL"), -(-total // BLOCK))
    # roots of the groups' trees are the leaves of the tree above
    above = (
        nodes.filter(F.pow(F.lit(RUN), "level") >= F.col("size"))  # the roots
        .select("tree", "digest")
        .groupBy(F.floor(F.col("tree") / BLOCK).alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct("tree", "digest"))).alias("roots"))
        .select(
            "block",
            F.col("roots.digest").alias("digests"),
            F.array(
                F.struct(
                    F.lit(TOP).cast("long").alias("tree"),
                    F.lit(trees).cast("long").alias("size"),
                    (F.col("block") * BLOCK).alias("lo"),
                    F.size("roots").cast("long").alias("n"),
                )
            ).alias("spans"),
        )
    )
    top = frozen(_grown(frozen(_scanned(above, None)), -(-trees // BLOCK)))
    root = top.orderBy(F.desc("level")).first()["digest"].hex().encode()

    place = ["tree", "level", "idx"]
    fetched = (
        scanned.filter("digest IS NULL")
        .select("block", *place)
        .join(nodes.unionByName(top).select(*place, "digest"), place)
        .groupBy("block")
        .agg(F.collect_list(F.struct(*place, "digest")).alias("got"))
    )

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = batch["rows"][k].values
                spans = batch["spans"][k].as_py()
                got: dict[int, dict] = {}
                for g in batch["got"][k].as_py() or []:
                    got.setdefault(g["tree"], {})[g["level"], g["idx"]] = g["digest"].hex().encode()
                leaf = [d.hex().encode() for d in rows.field("leaf").to_pylist()]
                other = rows.field("other").to_pylist()
                paths, at = [], 0
                for s in spans:
                    own = leaf[at : at + s["n"]]
                    paths.append(_Paths(s["size"], s["lo"], own, got.get(s["tree"], {})))
                    at += s["n"]
                first = spans[0]["tree"]
                over = _Paths(trees, first, [p.root for p in paths], got.get(TOP, {}))
                tails = over.siblings([])
                skip = first - over.levels[0][0]
                proofs, back, subroots, at = [], [], [], 0
                for j, (s, p) in enumerate(zip(spans, paths, strict=True)):
                    each = p.siblings(tails[skip + j])
                    before = s["lo"] - p.levels[0][0]
                    beyond = shape_of(trees, s["tree"])
                    for i in range(s["n"]):
                        proof = each[before + i]
                        mine = leaf[at] if other[at] is None else other[at].hex().encode()
                        proofs.append(proof)
                        back.append(folded(mine, shape_of(s["size"], s["lo"] + i) + beyond, proof))
                        at += 1
                    subroots += [p.root.decode()] * s["n"]
                columns = [
                    rows.field("key"),
                    pa.array([x.decode() for x in leaf]),
                    pa.array(subroots),
                    pa.array([root.decode()] * len(leaf)),
                    pa.array([_joined(x).decode() for x in proofs]),
                    pa.array([x.decode() for x in back]),
                    pa.array([x == root for x in back]),
                ]
                if siblings:
                    columns.append(
                        pa.array([[x.decode() for x in p] for p in proofs], pa.list_(pa.string()))
                    )
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [
        *("key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"),
        *(["proof"] if siblings else []),
    ]
    return blocks.join(fetched, "block", "left").mapInArrow(expand, out)


ship(__name__)
