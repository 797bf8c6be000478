"""Operator 5: sharding by balanced label propagation."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scale import frozen, release
from .common import packed, text_of

SHARDS = 16
ROUNDS = 6  # of propagation at most; it ends earlier when nothing moves
CELLS = 64  # a group of linked documents moves in at most this many pieces
_RUN = 2_000  # rows that are numbered together, about


def _uniform(*key) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(1 << 20)) / float(1 << 20)


def _drawn(weights: list[int], *key) -> Column:
    """A shard drawn by the hash of ``key``, in proportion to its weight."""
    total = sum(weights)
    ends = [sum(weights[: i + 1]) / total for i in range(len(weights))] if total else []
    bounds = F.array(*[F.lit(float(e)) for e in ends[:-1]]).cast("array<double>")
    return F.size(F.filter(bounds, lambda e: e <= _uniform(*key)))


def _listed(spark: SparkSession, rows: list, kind: str) -> DataFrame:
    """A few rows of the driver's as a table that needs no Python on the executors."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")))


def propagate(cells: DataFrame, room: list[int], rounds: int = ROUNDS) -> DataFrame:
    """``grp``, ``cell``, ``rows`` and ``shard`` after label propagation under quotas.

    ``cells`` are pieces of groups of linked documents, with their first shard. In each round a
    group's pieces ask to move to the shard with room that holds most of the group, or to any
    with room if all of theirs are full; ties are broken anew each round. How many rows may go from
    one shard to another is set by the room of the target, counting what leaves it, and shared among
    the askers in proportion; a group moves if its hash falls below that share. A shard may end with
    an eighth more than its room, which :func:`placed` moves on as whole groups. The driver sees the
    table of askers by shards only, whose size is fixed.
    """
    n = len(room)
    state = cells
    for turn in range(rounds):
        held = state.groupBy("grp", "shard").agg(F.sum("rows").alias("r"))
        load = [0] * n
        for f in state.groupBy("shard").agg(F.sum("rows").alias("r")).collect():
            load[f["shard"]] = f["r"]
        free = [max(0, room[j] + room[j] // 8 - load[j]) for j in range(n)]
        is_open = F.get(F.array(*[F.lit(x > 0) for x in free]), F.col("shard"))
        tie = F.xxhash64("grp", "shard", F.lit(turn))
        best = held.groupBy("grp").agg(
            F.max(F.struct(is_open.alias("open"), "r", tie.alias("tie"), "shard")).alias("best"),
            F.count(F.lit(1)).alias("parts"),
        )
        stays = F.col("best.open") | (F.col("parts") == 1) | F.lit(not any(free))
        elsewhere = _drawn(free, F.lit(turn), "grp", F.lit(n)) if any(free) else F.col("best.shard")
        wish = best.select("grp", F.when(stays, F.col("best.shard")).otherwise(elsewhere).alias("wish"))
        asking = state.join(wish, "grp")
        asked = [[0] * n for _ in range(n)]
        for f in asking.groupBy("shard", "wish").agg(F.sum("rows").alias("r")).collect():
            if f["shard"] != f["wish"]:
                asked[f["shard"]][f["wish"]] += f["r"]
        share = [[0.0] * n for _ in range(n)]
        for j in range(n):
            into = sum(asked[i][j] for i in range(n))
            for i in range(n):
                if asked[i][j]:
                    swap = min(asked[i][j], asked[j][i])
                    rest = asked[i][j] - swap
                    part = free[j] * asked[i][j] / into
                    share[i][j] = min(1.0, (swap + min(rest, part)) / asked[i][j])
        if not any(map(any, asked)):
            break
        odds = F.array(*[F.array(*map(F.lit, row)) for row in share])
        moves = _uniform(F.lit(turn), "grp") < F.get(F.get(odds, F.col("shard")), F.col("wish"))
        following = frozen(
            asking.select(
                "grp", "cell", "rows", F.when(moves, F.col("wish")).otherwise(F.col("shard")).alias("shard")
            )
        )
        if state is not cells:
            release(state)
        state = following
    return state


def _fill(amount: int, gaps: list[int]) -> list[tuple[int, int]]:
    """(shard, rows) by which ``amount`` rows fill as few gaps as they can, which are then less."""
    out = []
    while amount:
        holds = [i for i, g in enumerate(gaps) if g >= amount]
        i = min(holds, key=lambda i: gaps[i]) if holds else max(range(len(gaps)), key=lambda i: gaps[i])
        take = min(amount, gaps[i])
        out.append((i, take))
        gaps[i] -= take
        amount -= take
    return out


def assigned(docs: DataFrame, *keep: str, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``keep``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of each row of ``docs``.

    Rows with equal texts are linked. Each shard gets the same number of rows, at most one apart:
    groups of more than one ``CELLS``-th of a quota, of which there are few, are placed whole by
    the driver, the largest first; the others gather by :func:`propagate` in the room left. Groups
    that no shard can hold then fill as few shards as they can, and rows without links the rest.
    Slots count from 0 without gaps in each shard. A null text has no bytes, its size is 1 and
    its checksum that of no bytes; null texts and empty ones are linked. Which of several
    identical rows gets which slot is left open. Texts are read once and never shuffled.
    """
    body = text_of()
    crc = F.crc32(body.cast("binary"))
    rows = frozen(
        docs.select(
            *[F.col(c).alias(f"keep_{c}") for c in keep],
            (F.octet_length(body) + 1).cast("long").alias("size"),
            crc.alias("text_crc32"),
            F.xxhash64(body, F.octet_length(body), crc).alias("grp"),
            # by place, as repeated rows must differ too; it is stored here and drawn only once
            F.xxhash64("doc_id", crc, F.monotonically_increasing_id()).alias("pick"),
        )
    )
    out = placed(rows, shards, rounds)
    return out.select(
        *[F.col(f"keep_{c}").alias(c) for c in keep], "size", "text_crc32", "shard", "slot"
    )


def sharded(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``row``, the columns of ``docs``, with the ``size``, ``shard`` and ``slot`` of each."""
    rows = frozen(packed(docs).select(F.monotonically_increasing_id().alias("rid"), "row"))
    found = assigned(rows.select("rid", "row.doc_id", "row.text"), "rid", shards=shards, rounds=rounds)
    return rows.select("rid", "row").join(found, "rid").select("row", "size", "shard", "slot")


def placed(rows: DataFrame, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """``rows`` (with ``grp`` and ``pick``, a hash that tells rows apart) with shard and slot."""
    spark = rows.sparkSession
    total = rows.count()
    quota = [total // shards + (i < total % shards) for i in range(shards)]
    cell = F.pmod("pick", F.lit(CELLS)).cast("int")
    pieces = frozen(
        rows.select("grp", cell.alias("cell")).groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("rows"))
    )
    per_group = frozen(pieces.groupBy("grp").agg(F.sum("rows").alias("all")).filter("all > 1"))
    is_heavy = F.col("all") * CELLS > min(quota)
    # at most about 2 * CELLS * shards
    heavy = sorted(((r["all"], r["grp"]) for r in per_group.filter(is_heavy).collect()), reverse=True)
    room, homes, split = list(quota), {}, []
    for n, g in heavy:
        fits = [i for i in range(shards) if room[i] >= n]
        if fits:
            homes[g] = min(fits, key=lambda i: room[i])
            room[homes[g]] -= n
        else:
            homes[g] = 2 * shards + len(split)  # a home of its own, dealt to the gaps below
            split.append(n)
    for n in split:
        _fill(n, room)
    linked = pieces.join(per_group.filter(~is_heavy).select("grp"), "grp").select(
        "grp", "cell", "rows", _drawn(room, "grp", "cell").alias("shard")
    )
    first = frozen(linked)
    whole = _listed(spark, [{"g": g, "h": h} for g, h in homes.items()], "g long, h int").select(
        F.col("g").alias("of_grp"),
        F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))).alias("of_cell"),
        F.col("h").alias("moved"),
        F.lit(0).alias("class"),
    )
    found = propagate(first, room, rounds).select(
        F.col("grp").alias("of_grp"),
        F.col("cell").alias("of_cell"),
        F.col("shard").alias("moved"),
        F.lit(1).alias("class"),
    )
    runs = max(1, total // (shards * _RUN))
    # small groups are numbered as wholes, so what lies beyond a quota is whole groups
    run = F.when(F.col("class") == 1, F.xxhash64("grp", F.lit(5))).otherwise(F.xxhash64("pick", F.lit(5)))
    many = F.when(F.col("moved") >= 2 * shards, runs * shards).otherwise(runs)
    labelled = rows.join(
        frozen(found.unionByName(whole)), (F.col("grp") == F.col("of_grp")) & (cell == F.col("of_cell")), "left"
    ).select(
        *rows.columns,
        # rows without links have homes of their own, from which they fill gaps
        F.coalesce("moved", F.pmod("pick", F.lit(shards)).cast("int") + shards).alias("home"),
        F.coalesce("class", F.lit(2)).alias("class"),
        F.pmod(run, many).alias("run"),
    )
    within = Window.partitionBy("home", "class", "run").orderBy("grp", "pick", "text_crc32")
    numbered = frozen(labelled.withColumn("nth", F.row_number().over(within) - 1))
    before = Window.partitionBy("home").orderBy("class", "run").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        numbered.groupBy("home", "class", "run")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("home", "class", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    counts = {r["home"]: r["n"] for r in numbered.groupBy("home").agg(F.count("*").alias("n")).collect()}
    held = [min(counts.get(i, 0), quota[i]) for i in range(shards)]
    gaps = [quota[i] - held[i] for i in range(shards)]
    # what is beyond a quota, then groups larger than one, then rows without links fill the gaps
    dealt, used = [], list(held)
    for home in [*range(shards), *range(2 * shards, 2 * shards + len(split)), *range(shards, 2 * shards)]:
        low = held[home] if home < shards else 0
        for i, n in _fill(counts.get(home, 0) - low, gaps):
            dealt.append((home, low, low + n, i, used[i]))
            used[i] += n
            low += n
    at = F.col("start") + F.col("nth")
    shard, slot = F.col("home"), at
    for home, low, high, i, begin in dealt:
        here = (F.col("home") == home) & (at >= low) & (at < high)
        shard = F.when(here, F.lit(i)).otherwise(shard)
        slot = F.when(here, at - low + begin).otherwise(slot)
    return numbered.join(starts, ["home", "class", "run"]).select(
        *[c for c in rows.columns if c not in ("grp", "pick")],
        shard.alias("shard"),
        slot.cast("long").alias("slot"),
    )
