"""Best-fit packing of token pieces into sequences, by bin completion.

Pieces of equal length are interchangeable, so the search runs on a histogram
of at most `capacity` lengths however large the corpus is.  Best-fit decreasing
gives the first incumbent; branch-and-bound then enumerates undominated
fillings around the largest piece left and prunes by the waste that a better
solution may still have.  Pieces find their places in the patterns by exact
distributed ranks within their length.
"""

from __future__ import annotations

import bisect
import json
import random
import sys
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, table, written

Pattern = tuple[tuple[int, int], ...]  # (length, how often), longest first
#: Fillings that a node tries, from start to start of the search; the effort of each start, and a node's share of it.
WIDTHS, EFFORT, NODE = (1, 4, 16, 2_000), 8_000, 4
#: Ways down before the search, by the share of nodes that spare small pieces.
DIVES = (1.0, 0.0, 0.5, 0.25, 0.75, 0.9)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on a histogram: (pattern, sequences that have it).

    Each length in turn goes to the fullest sequences that still take it;
    sequences of equal contents are one group, so a step handles whole groups.
    """
    rooms: list[int] = []  # sorted distinct rooms left
    groups: dict[int, dict[Pattern, int]] = {}

    def put(room: int, pattern: Pattern, n: int) -> None:
        if n:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = {}
            groups[room][pattern] = groups[room].get(pattern, 0) + n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                pattern, n = groups[room].popitem()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, pattern, n = capacity, (), -(-left // (capacity // length))
            each = room // length
            full = min(n, left // each)
            put(room - each * length, (*pattern, (length, each)), full)
            left -= full * each
            n -= full
            if n and left and left < each:
                put(room - left * length, (*pattern, (length, left)), 1)
                n, left = n - 1, 0
            if pattern:
                put(room, pattern, n)
    return [(p, n) for room in groups.values() for p, n in room.items()]


def fillings(counts: dict[int, int], room: int, waste: int, limit: int, steps: int) -> tuple[list[Pattern], bool, int]:
    """Undominated sets of the lengths left that fill `room` up to at most `waste`, whether they are all of them, and how many sets were looked at.

    Fullest first, then those of longer pieces; at most `limit` sets, of at most `steps` looked at.  Which
    sums the lengths from each on can make is known beforehand, as the bits of
    one number, so every step of the enumeration leads to a set.  Dropped:
    those that a length left still fits into, and those in which one piece, or
    two, could give way to a larger one that fits their place.
    """
    lengths = sorted((x for x, n in counts.items() if n and x <= room), reverse=True)
    mask, sums = (1 << (room + 1)) - 1, [1] * (len(lengths) + 1)
    for i in range(len(lengths) - 1, -1, -1):
        x, reach, left, step = lengths[i], sums[i + 1], min(counts[lengths[i]], room // lengths[i]), 1
        while left:
            step = min(step, left)
            reach |= reach << (step * x)
            left, step = left - step, step * 2
        sums[i] = reach & mask
    rising = lengths[::-1]

    def grow(i: int, left: int, chosen: Pattern):
        if not left:
            yield chosen
            return
        i = max(i, len(lengths) - bisect.bisect_right(rising, left))
        while i < len(lengths) and sums[i] >> left & 1:
            x = lengths[i]
            for k in range(min(counts[x], left // x), 0, -1):
                if sums[i + 1] >> (left - k * x) & 1:
                    yield from grow(i + 1, left - k * x, (*chosen, (x, k)))
            i += 1

    def dominated(left: int, chosen: Pattern) -> bool:
        used = dict(chosen)
        spare = [x for x in rising if counts[x] > used.get(x, 0)]
        if spare and spare[0] <= left:
            return True
        pieces = [x for x, k in chosen for _ in range(min(k, 2))]
        pairs = {a + b for i, a in enumerate(pieces) for b in pieces[i + 1 :]}
        places = [(bisect.bisect_right(spare, x), x) for x in used] + [(bisect.bisect_left(spare, x), x) for x in pairs]
        return any(at < len(spare) and spare[at] <= x + left for at, x in places)

    found: list[Pattern] = []
    seen = 0
    for over in range(min(waste, room) + 1):
        for c in grow(0, room - over, ()) if sums[0] >> (room - over) & 1 else ():
            seen += 1
            if not dominated(over, c):
                found.append(c)
            if len(found) == limit or seen == steps:
                return found, False, seen
    return found, True, seen


def sparing_filling(counts: dict[int, int], room: int) -> Pattern:
    """The fullest set of the lengths left in `room`, of those the one whose smallest piece is largest: small pieces are what fills sequences later."""
    lengths = sorted((x for x, n in counts.items() if n and x <= room), reverse=True)
    mask, reach, sums = (1 << (room + 1)) - 1, 1, [1]  # what the first i lengths can make
    for x in lengths:
        left, step = min(counts[x], room // x), 1
        while left:
            step = min(step, left)
            reach |= reach << (step * x)
            left, step = left - step, step * 2
        reach &= mask
        sums.append(reach)
        if reach >> room & 1:
            break
    left, chosen, i = reach.bit_length() - 1, [], len(sums) - 1
    while left:
        x, k = lengths[i - 1], 0
        while not sums[i - 1] >> (left - k * x) & 1:
            k += 1
        if k:
            chosen.append((x, k))
        left, i = left - k * x, i - 1
    return tuple(chosen)


def least_sequences(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: pieces over half a sequence are alone among themselves, and what shorter ones exceed their room needs more; the best over all cuts of what counts as short."""
    best = -(-sum(x * n for x, n in counts.items()) // capacity)
    for cut in range(capacity // 2 + 1):
        large = [(x, n) for x, n in counts.items() if 2 * x > capacity]
        over = sum(x * n for x, n in counts.items() if cut <= x and 2 * x <= capacity) - sum((capacity - x) * n for x, n in large if x <= capacity - cut)
        best = max(best, sum(n for _, n in large) + max(0, -(-over // capacity)))
    return best


class Plan(NamedTuple):
    """patterns: each with its number of sequences; least: a lower bound of all sequences; proven: none has fewer."""

    patterns: list[tuple[Pattern, int]]
    least: int
    proven: bool


def complete(counts: dict[int, int], capacity: int, effort: int = EFFORT) -> Plan:
    """Patterns that hold all pieces of the histogram in as few sequences as the search finds.

    One search for all sizes.  Incumbents come from best fit and from DIVES
    straight ways down, which fill around the longest piece left with the
    longest pieces, or with such as spare small ones, or with either by turns.
    The search then tries the undominated fillings around the longest piece,
    each as often as its lengths last and once, and turns back where the waste
    that a better solution may still have is used up; nodes along the way
    complete their partial solutions by best fit.  It starts anew with more
    fillings a node (WIDTHS), with `effort` for each start (a node costs NODE, a
    set looked at 1), until a solution meets the bound or a start has tried
    everything.  Otherwise it is a heuristic: `proven` tells.
    """
    counts = {x: n for x, n in counts.items() if n}
    best = best_fit(counts, capacity)
    size, total = sum(n for _, n in best), sum(x * n for x, n in counts.items())
    bound = least_sequences(counts, capacity)
    left_over, whole = 0, False

    def better(solution: list[tuple[Pattern, int]]) -> None:
        nonlocal best, size
        n = sum(n for _, n in solution)
        if n < size:
            best, size = list(solution), n

    def search(left: dict[int, int], used: int, wasted: int, chosen: list, width: int) -> None:
        nonlocal left_over, whole
        left_over -= NODE
        if not left:
            better(chosen)
        if size <= bound or not left:
            return
        if used + -(-sum(x * n for x, n in left.items()) // capacity) >= size:
            return
        if len(chosen) % 16 == 0:
            better([*chosen, *best_fit(left, capacity)])
        allowed = (size - 1) * capacity - total - wasted
        top = max(left)
        options, every, seen = fillings(left | {top: left[top] - 1}, capacity - top, allowed, width, max(left_over, 1))
        left_over, whole = left_over - seen, whole and every
        for c in options:
            need = dict(c)
            need[top] = need.get(top, 0) + 1
            waste = capacity - sum(x * k for x, k in need.items())
            times = min(left[x] // k for x, k in need.items())
            times = min(times, max(1, allowed // waste)) if waste else times
            pattern = tuple(sorted(need.items(), reverse=True))
            for n in dict.fromkeys((times, 1)):
                if left_over < 0:
                    whole = False
                if left_over < 0 or size <= bound:
                    return
                after = {x: m for x, m in ((x, m - need.get(x, 0) * n) for x, m in left.items()) if m}
                search(after, used + n, wasted + waste * n, [*chosen, (pattern, n)], width)

    def dive(share: float, rng: random.Random) -> list[tuple[Pattern, int]]:
        """Patterns all the way down, each as often as its lengths last; share: of nodes that spare small pieces."""
        left, chosen = dict(counts), []
        while left:
            top = max(left)
            rest = left | {top: left[top] - 1}
            found = [] if rng.random() < share else fillings(rest, capacity - top, capacity, 1, capacity)[0]
            need = dict(found[0] if found else sparing_filling(rest, capacity - top))
            need[top] = need.get(top, 0) + 1
            n = min(left[x] // k for x, k in need.items())
            chosen.append((tuple(sorted(need.items(), reverse=True)), n))
            left = {x: m for x, m in ((x, m - need.get(x, 0) * n) for x, m in left.items()) if m}
        return chosen

    for i, share in enumerate(DIVES):
        if size > bound:
            better(dive(share, random.Random(i)))
    depth = sys.getrecursionlimit()
    sys.setrecursionlimit(max(depth, 20_000))
    try:
        for width in WIDTHS if size > bound else ():
            left_over, whole = effort, True
            search(counts, 0, 0, [], width)
            if size <= bound or whole:
                break
    finally:
        sys.setrecursionlimit(depth)
    return Plan(best, bound, size <= bound or whole)


def encoder(path: str):
    """text -> ids of the byte-level BPE tokenizer file at `path`, as tokenizers gives them without added specials.

    The merges of such a vocabulary rank as its ids do, so tiktoken gives the
    same ids several times as fast; a vocabulary for which that does not hold,
    and a text that it cannot split, go to tokenizers itself.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = lambda t: slow.encode(t, add_special_tokens=False).ids
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
    in_order = all(vocab.get(a + b, -1) == 256 + i for i, (a, b) in enumerate(pairs))
    stage = spec.get("pre_tokenizer") or {}
    if not in_order or stage.get("type") != "ByteLevel" or stage.get("add_prefix_space") or not stage.get("use_regex", True) or spec.get("normalizer"):
        return plain
    import tiktoken

    split = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}
    fast = tiktoken.Encoding("vocabulary", pat_str=split, mergeable_ranks=ranks, special_tokens=special)
    allowed = set(special)

    def encode(text: str) -> list[int]:
        if len(text) > 200_000:  # very long runs of one class overflow the fast splitter
            return plain(text)
        return fast.encode(text, allowed_special=allowed, disallowed_special=())

    return encode


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches):
        encode = encoder(path)
        for b in batches:
            ids, rows = b.column(0), ([], [], [], [], [])
            for at, text in enumerate(b.column(1)):
                tokens = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                first = len(tokens) % capacity or capacity
                stops = range(first, len(tokens) + 1, capacity)
                start = 0
                for piece, stop in enumerate(stops):
                    for column, x in zip(rows, (at, piece, start, stop - start, zlib.crc32(tokens[start:stop].tobytes())), strict=True):
                        column.append(x)
                    start = stop
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the documents' ids, each closed by end_id, in pieces of at most `capacity`.

    Longer documents are cut into pieces of `capacity` ids; what is left over is the first piece.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_pieces(path, capacity, end_id), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _slots(patterns: list[tuple[Pattern, int]]) -> np.ndarray:
    """Rows length, first rank, times per sequence, first sequence, first offset; sorted by (length, rank)."""
    out, ranks, sequence = [], {}, 0
    for pattern, n in patterns:
        offset = 0
        for length, k in pattern:
            out.append((length, ranks.get(length, 0), k, sequence, offset))
            ranks[length] = ranks.get(length, 0) + k * n
            offset += length * k
        sequence += n
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def _place(slots: np.ndarray):
    def run(batches):
        keys = slots[:, 0] << 48 | slots[:, 1]
        for b in batches:
            length, place = b.column("length").to_numpy(), b.column("place").to_numpy()
            s = slots[np.searchsorted(keys, length << 48 | place, "right") - 1] if len(length) else slots[:0]
            nth = place - s[:, 1]
            sequence, offset = s[:, 3] + nth // np.maximum(s[:, 2], 1), s[:, 4] + nth % np.maximum(s[:, 2], 1) * length
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, effort: int = EFFORT) -> DataFrame:
    """Place every piece of docs(doc_id, text, ...): token_pieces()' columns, sequence_id and offset.

    A null text is empty (its only id is end_id); a very long one is tokenised
    whole, in one task; repeated rows and rows without a doc_id are packed like
    any other; other columns are not read; an empty table gives no rows.
    The driver holds one count per length and the patterns, whose number
    depends on `capacity` and not on the corpus.
    """
    pieces = written(token_pieces(docs, path, capacity, end_id), "pack-pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = _slots(complete(counts, capacity, effort).patterns)
    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = ranked(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "place")
    return placed.mapInArrow(_place(slots), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
