"""Filling fixed-capacity containers with items (problem 8): bin completion by branch and bound.

A text longer than a packet is cut into full packets and a rest; every other text stays whole. Pieces are dealt by hash into
groups of about ``GROUP`` pieces, each packed by itself; packets that a group leaves poorly filled are opened again and
packed across groups, so the waste does not grow with the number of groups.

Within a group best-fit decreasing gives an incumbent. If it needs more packets than the lower bound, branch and bound
completes one packet after another: around the largest piece left, undominated fillings in order of fullness, pruned
where the waste so far already rules out a better solution, in rounds of growing width. ``NODES`` bounds the search of a group of
any size; beyond it the best solution found holds.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.llm.tokens import TOKENIZER, count_tokens
from tallyweir.session import checkpointed, ship_package

GROUP = 1_500
NODES = 4_000  # of the search in one group, over all its rounds
REOPEN = 0.97  # packets filled less are packed again across groups
MAX_LIMITS = 1_000


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Packets (lists of indexes) by best fit over decreasing sizes."""
    room: list[tuple[int, int]] = []  # (room left, packet), sorted
    packets: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = bisect.bisect_left(room, (sizes[i], -1))
        if at == len(room):
            packets.append([i])
            bisect.insort(room, (capacity - sizes[i], len(packets) - 1))
        else:
            left, packet = room.pop(at)
            packets[packet].append(i)
            bisect.insort(room, (left - sizes[i], packet))
    return packets


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Packets that any solution needs: the volume bound, raised by large items that can't share (Martello and Toth's second bound)."""
    if not sizes:
        return 0
    values = np.sort(np.asarray(sizes, dtype=np.int64))[::-1]
    sums = np.concatenate([[0], np.cumsum(values)])
    best = -(-int(sums[-1]) // capacity)
    for alpha in {0, *(int(v) for v in values if v <= capacity // 2)}:
        big = int((values > capacity - alpha).sum())
        middle = int((values > capacity / 2).sum())
        small_end = int((values >= alpha).sum())
        rest = int(sums[small_end] - sums[middle]) - ((middle - big) * capacity - int(sums[middle] - sums[big]))
        best = max(best, middle + max(0, -(-rest // capacity)))
    return best


def is_dominated(chosen: list[int], left: int, out: list[int]) -> bool:
    """Whether a piece that was left out could take the place of pieces of the filling that together are no larger, and still fit.

    ``chosen`` and ``out`` are sizes; the sums of all subsets of ``chosen`` are bits of one number.
    """
    inside = sorted(chosen)
    sums, at = 1, 0
    for v in sorted(set(out)):
        # pieces of the same size only trade places
        while at < len(inside) and inside[at] < v:
            sums |= sums << inside[at]
            at += 1
        low = max(1, v - left)
        if sums >> low & ((1 << (v - low + 1)) - 1) or v <= left:
            return True
    return False


def fillings(sizes: list[int], room: int, width: int) -> tuple[list[tuple[int, ...]], bool]:
    """(undominated sets of positions in ``sizes`` (decreasing) that fit in ``room``, fullest first; whether these are all).

    Of equal sizes the first are taken. At most ``width`` sets are returned, found in at most 40 times as many steps.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    steps, complete = width * 40, True
    # (first position to take, room left, taken so far, whether a sibling took one before)
    stack: list[tuple[int, int, tuple[int, ...], bool]] = [(0, room, (), False)]
    while stack:
        if not steps:
            complete = False
            break
        start, left, chosen, later = stack.pop()
        k = bisect.bisect_left(sizes, -left, lo=start, key=lambda v: -v)  # the first that fits: sizes fall
        if k < len(sizes):
            steps -= 1
            stack.append((bisect.bisect_right(sizes, -sizes[k], lo=k, key=lambda v: -v), left, chosen, True))
            stack.append((k + 1, left - sizes[k], (*chosen, k), False))
        elif not later:
            used = set(chosen)
            if not is_dominated([sizes[i] for i in chosen], left, [v for i, v in enumerate(sizes) if v <= room and i not in used]):
                found.append((left, chosen))
    found.sort(key=lambda x: (x[0], len(x[1]), x[1]))
    return [c for _, c in found[:width]], complete and len(found) <= width


def complete_bins(sizes: list[int], capacity: int, nodes: int = NODES) -> list[list[int]]:
    """Packets (lists of indexes), as few as the search can prove or find within ``nodes`` nodes.

    The search is widened from round to round: each node first tries its two fullest fillings, then four, and so on. A round that left
    nothing untried proves its best solution, as does one that meets the lower bound.
    """
    best = best_fit(sizes, capacity)
    bound = lower_bound(sizes, capacity)
    width = 2
    while len(best) > bound and nodes > 0:
        best, nodes, complete = _search(sizes, capacity, best, bound, width, nodes)
        if complete:
            break
        width *= 2
    return best


def _search(sizes: list[int], capacity: int, best: list[list[int]], bound: int, width: int, nodes: int) -> tuple[list[list[int]], int, bool]:
    """(best solution, nodes left, whether nothing was left untried) of one depth-first round; a stack holds the path, so any depth will do."""
    total, complete = sum(sizes), True
    order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
    # a step back is an entry without rest; the path holds the packets that are fixed
    stack: list[tuple[list[int] | None, list[int] | None, int]] = [(order, None, 0)]
    path: list[list[int]] = []
    while stack:
        rest, packet, waste = stack.pop()
        if rest is None:
            path.pop()
            continue
        if packet is not None:
            path.append(packet)
            stack.append((None, None, 0))
        if nodes <= 0:
            return best, 0, False
        nodes -= 1
        # a better solution has at most len(best) - 1 packets, hence this much waste
        if waste > (len(best) - 1) * capacity - total:
            continue
        tail = best_fit([sizes[i] for i in rest], capacity)
        if len(path) + len(tail) < len(best):
            best = [*map(list, path), *([rest[k] for k in p] for p in tail)]
            if len(best) <= bound:
                return best, nodes, True
        if not rest:
            continue
        first, others = rest[0], rest[1:]
        room = capacity - sizes[first]
        tried, every = fillings([sizes[i] for i in others], room, width)
        complete &= every
        for chosen in reversed(tried):
            used = set(chosen)
            filled = [first, *(others[k] for k in chosen)]
            left = capacity - sum(sizes[i] for i in filled)
            if waste + left <= (len(best) - 1) * capacity - total:
                stack.append(([x for k, x in enumerate(others) if k not in used], filled, waste + left))
    return best, nodes, complete


def _pack(round_no: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        limit, group = int(key[0]), int(key[1])
        pdf = pdf.sort_values(["n_tokens", "doc_id", "row_hash", "piece_no"], ascending=[False, True, True, True], ignore_index=True)
        packets = complete_bins(pdf["n_tokens"].tolist(), int(pdf["capacity"].iloc[0]))
        packet = np.empty(len(pdf), dtype=object)
        fill = np.empty(len(pdf), dtype=np.int64)
        sizes = pdf["n_tokens"].to_numpy()
        for k, members in enumerate(packets):
            packet[members] = f"{limit}-{round_no}-{group}-{k}"
            fill[members] = sizes[members].sum()
        return pdf.assign(packet_id=packet, packet_tokens=fill)

    return run


def pack_documents(documents: DataFrame, limits: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(limit_id, doc_id, piece_no, start_token, n_tokens, packet_id, packet_tokens): every non-blank text in packets, for each limit.

    Null and blank texts have no row; a text of exactly the capacity fills a packet alone. Limits that are null or below one token are
    left out. Repeated rows of a document are packed each for itself. ``piece_no`` is 0 for a whole text.
    """
    ship_package(documents.sparkSession)
    given = limits.where(F.col("capacity_tokens") >= 1).select("limit_id", "capacity_tokens").orderBy("limit_id").limit(MAX_LIMITS + 1).collect()
    if len(given) > MAX_LIMITS:
        raise ValueError(f"over {MAX_LIMITS} limits; pack them in several calls")
    hashed = documents.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    counted = count_tokens(hashed, "doc_id", "text", tokenizer, keep=("text_hash",)).where(F.col("n_tokens") > 0)
    # rows that are alike are told apart by number, so that a packet's name does not hang on how the run is partitioned
    copies = counted.groupBy("doc_id", "text_hash", "n_tokens").agg(F.count("*").alias("copies"))
    sized = checkpointed(copies.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), "copies"), lambda k: F.xxhash64("text_hash", k))).alias("row_hash"), "n_tokens"))
    total = sized.count()
    choices = F.array(*[F.struct(F.lit(r["limit_id"]).alias("limit_id"), F.lit(int(r["capacity_tokens"])).cast("long").alias("capacity")) for r in given]) if given else F.array().cast("array<struct<limit_id:int,capacity:bigint>>")
    pieces = sized.withColumn("l", F.explode(choices)).select("doc_id", "row_hash", "l.limit_id", "l.capacity", F.col("n_tokens").alias("all_tokens"))
    cuts = F.when(F.col("all_tokens") <= F.col("capacity"), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("all_tokens") - 1, F.col("capacity")))
    pieces = pieces.select("*", F.posexplode(cuts).alias("at", "start_token"))
    pieces = pieces.select(
        "limit_id", "capacity", "doc_id", "row_hash",
        F.when(F.col("all_tokens") > F.col("capacity"), F.col("at") + 1).otherwise(0).cast("int").alias("piece_no"), "start_token",
        F.least("capacity", F.col("all_tokens") - F.col("start_token")).alias("n_tokens"),
    )
    full = pieces.where(F.col("n_tokens") == F.col("capacity"))
    alone = F.concat_ws("-", "limit_id", F.lit("full"), F.col("doc_id").cast("string"), F.col("piece_no"), F.hex("row_hash"))
    full = full.withColumn("packet_id", alone).withColumn("packet_tokens", F.col("n_tokens"))
    open_pieces = pieces.where(F.col("n_tokens") < F.col("capacity"))
    schema = open_pieces.withColumn("packet_id", F.lit("")).withColumn("packet_tokens", F.lit(0).cast("long")).schema

    def packed(rows: DataFrame, count: int, round_no: int) -> DataFrame:
        groups = max(1, -(-count // GROUP))
        dealt = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "row_hash", "piece_no", F.lit(round_no)), F.lit(groups)))
        return dealt.groupBy("limit_id", "group").applyInPandas(lambda key, pdf: _pack(round_no)(key, pdf)[[f.name for f in schema]], schema)

    first = checkpointed(packed(open_pieces, total, 1))
    poor = F.col("packet_tokens") < REOPEN * F.col("capacity")
    again = first.where(poor).drop("packet_id", "packet_tokens")
    second = packed(again, max(1, again.count() // max(1, len(given))), 2)
    result = full.select(*schema.names).unionByName(first.where(~poor)).unionByName(second)
    return result.drop("capacity", "row_hash").withColumnRenamed("doc_id", doc_id)


def packing_report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit_id, packets, tokens, least_packets, fill): packets used against the volume bound."""
    used = packed.groupBy("limit_id").agg(F.count_distinct("packet_id").alias("packets"), F.sum("n_tokens").alias("tokens"))
    joined = used.join(limits.select("limit_id", "capacity_tokens"), "limit_id")
    return joined.select(
        "limit_id", "packets", "tokens", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_packets"), F.round(F.col("tokens") / (F.col("packets") * F.col("capacity_tokens")), 6).alias("fill")
    )
