"""SimHash near-duplicate groups by the generalised pigeonhole principle.

Fingerprints within `radius` bits of each other are linked.  Bits are grouped
into m parts, correlated ones together; part i gets a threshold t_i >= -1 with
sum t_i = radius - m + 1, so any linked pair differs in at most t_i bits of
some part.  The thresholds are those of the least estimated cost, found by
dynamic programming over the parts.  A fingerprint is dealt to the buckets of
its part value with up to t_i zero bits set (two values within t_i bits meet in
their union); members of a bucket are verified on all 64 bits.  A bucket emits
a spanning forest of its links, shortest first, never its pairs, and buckets too
large for one task are split along further bits of their members, which keeps
every link.

near_groups() links texts by their fingerprints alone.  near_copies() takes
such links as candidates for a similarity of word shingles, which it holds
exactly.  Its buckets hold texts with a sketch each, and a link needs likeness
in the sketches before the forest is built, so that a stranger whose fingerprint
lies between two alike texts cannot stand in for their link.  Within each family
of such links the texts are compared whole, with a representative first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, table, written

#: Most fingerprints of a bucket that one call compares; larger buckets are split.
BUCKET = 8192
#: Estimated cost of dealing one row to a bucket and of comparing one pair.
ROW_COST, PAIR_COST = 1.0, 0.002
#: Shingles hashed at a time: bounds memory on very long texts.
BLOCK = 1 << 16
#: Of near copies: words of a shingle and least Jaccard similarity, as a fraction; words of a fingerprint's shingle and its radius.
SHINGLE, ALIKE, PRINT, RADIUS = 5, (4, 5), 2, 8
#: Texts that one task compares with each other, and their shingles; bits a text, and most bits, of the filter for texts that have candidates.
FAMILY, FAMILY_SHINGLES, FILTER_SHARE, FILTER_BITS = 512, 1 << 21, 16, 1 << 28
#: Lanes of a sketch, one byte of a minimal hash each, and how many of two sketches agree at least in a link.
#: Of texts with a similarity of 0.8, 3 in 100,000 pairs agree in fewer; of strangers, fewer than 1 in 10 million agrees in as many.
LANES, AGREE = 16, 6
_FACTORS = np.random.default_rng(7).integers(1, 1 << 63, LANES, dtype=np.uint64) | np.uint64(1)
_SIGN = 1 << 63


def _hashes(data: bytes, size: int, seed: int):
    """XXH64 of a text's shingles, in arrays of at most BLOCK; words and short texts as in fingerprint()."""
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    words = data.translate(lower).split()
    if not words:
        return
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: max(len(words) - size + 1, 1)].tolist()
    stops = ends[min(size, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), BLOCK):
        yield np.array([digest(text[a:b], seed) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK], strict=True)], np.uint64)


def shingles(data: bytes, size: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """Distinct XXH64 of a UTF-8 text's shingles, ascending; none without words."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_hashes(data, size, seed)]))


def fingerprint(data: bytes, size: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of a UTF-8 text.

    A-Z are lower-cased; words are runs of anything but ASCII white space;
    shingles are `size` words joined by spaces, repeats included (the whole
    sequence where there are fewer words).  Bit b is set if more than half of
    the shingles' XXH64 have it.  No words: 0.
    """
    return _read(data, size, seed, False)[0]


def _read(data: bytes, size: int, seed: int, sketched: bool) -> tuple[int, np.ndarray]:
    """The fingerprint, and the sketch of the same shingles: in each lane a byte of the least of their hashes in an order of its own."""
    n, total, least = 0, np.zeros(64, np.int64), np.full(LANES, np.iinfo(np.uint64).max, np.uint64)
    for hashes in _hashes(data, size, seed):
        n += len(hashes)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        if sketched:
            mixed = hashes ^ hashes >> np.uint64(31)
            for i, f in enumerate(_FACTORS):
                least[i] = min(least[i], (mixed * f).min())
    # The low bits of a product are poorly mixed, the high ones are small in a minimum.
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0]), (least >> np.uint64(20)).astype(np.uint8)


def fingerprints(docs: DataFrame, size: int = 3, sketched: bool = False) -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint's bits as a signed long) of every row, and s0 and s1, its sketch, if asked; a null text is empty."""

    def run(batches):
        for b in batches:
            found = [_read(t.as_py() or b"", size, 42, sketched) for t in b.column(2)]
            columns = [np.array([f for f, _ in found], np.uint64)]
            if sketched:
                columns += list(np.array([s for _, s in found], np.uint8).reshape(-1, LANES).view(np.uint64).reshape(-1, 2).T)
            columns = [pa.array(np.ascontiguousarray(c).view(np.int64), pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["doc_id", "text_hash", "fp", "s0", "s1"][: 2 + len(columns)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("data"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, fp long" + ", s0 long, s1 long" * sketched)


def _cooccurrence(batches):
    """For each bit, how often each bit is set along with it."""
    total = np.zeros((64, 64), np.int64)
    for b in batches:
        v = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        bits = np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        total += (bits.T @ bits).astype(np.int64)
    i, j = np.divmod(np.arange(4096), 64)
    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], ["i", "j", "c"])


def _disagreement(both: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of two random fingerprints: the chance that they differ in bit i, and in bits i and j at once."""
    p11 = both / max(n, 1)
    p1 = np.diag(p11)
    p10, p01 = p1[:, None] - p11, p1[None, :] - p11
    return 2 * p1 * (1 - p1), np.maximum(2 * (p11 * np.maximum(1 - p11 - p10 - p01, 0) + p10 * p01), 0)


def group_bits(dependence: np.ndarray, m: int) -> list[list[int]]:
    """m parts of about equal width: each starts at the bit most dependent on the rest and takes the one most dependent on the part."""
    left, parts = set(range(64)), []
    for k in range(m):
        width = len(left) // (m - k)
        part = [max(sorted(left), key=lambda b: dependence[b, sorted(left)].sum())]
        left.discard(part[0])
        while len(part) < width:
            part.append(max(sorted(left), key=lambda b: dependence[b, part].sum()))
            left.discard(part[-1])
        parts.append(part)
    return parts


def _near(part: list[int], one: np.ndarray, two: np.ndarray, radius: int) -> np.ndarray:
    """Estimated chance that two fingerprints differ in at most t bits of the part, t = 0..radius, by a chain along its bits."""
    state = np.zeros((2, radius + 1))
    state[0, 0] = 1 - one[part[0]]
    if radius:
        state[1, 1] = one[part[0]]
    for a, b in zip(part, part[1:], strict=False):
        on = two[a, b] / one[a] if one[a] > 0 else 0.0
        off = (one[b] - two[a, b]) / (1 - one[a]) if one[a] < 1 else 0.0
        on, off = min(max(on, 0.0), 1.0), min(max(off, 0.0), 1.0)
        nxt = np.zeros_like(state)
        nxt[0] = state[0] * (1 - off) + state[1] * (1 - on)
        nxt[1, 1:] = state[0, :-1] * off + state[1, :-1] * on
        state = nxt
    return np.cumsum(state.sum(0))


def allocate(both: np.ndarray, n: int, radius: int = 3) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part in use, of the least estimated cost over all numbers of parts."""
    one, two = _disagreement(both, n)
    dependence = np.abs(two - np.outer(one, one))
    np.fill_diagonal(dependence, 0)
    best = None
    for m in range(1, radius + 3):
        parts = group_bits(dependence, m)
        budget = radius - m + 1
        plans = {0: (0.0, [])}  # sum of thresholds so far -> least cost
        for part in parts:
            chance, zeros, nxt = _near(part, one, two, radius), len(part) / 2, {}
            for spent, (cost, chosen) in plans.items():
                for t in range(-1, radius + 1):
                    rows = sum(np.prod([(zeros - i) / (i + 1) for i in range(j)]) for j in range(t + 1))
                    more = n * rows * ROW_COST + n * n / 2 * (chance[t] if t >= 0 else 0.0) * PAIR_COST
                    if spent + t not in nxt or cost + more < nxt[spent + t][0]:
                        nxt[spent + t] = (cost + more, [*chosen, t])
            plans = nxt
        if budget in plans and (best is None or plans[budget][0] < best[0]):
            best = (plans[budget][0], [(p, t) for p, t in zip(parts, plans[budget][1], strict=True) if t >= 0])
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= _SIGN else x


def _deal(fps: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """Rows (mask, value, fp, and what else fps has): fp belongs to the bucket of the fingerprints with these values in the mask's bits."""
    dealt = []
    for part, t in plan:
        mask = F.lit(_signed(sum(1 << b for b in part))).cast("long")
        values = F.array(F.col("fp").bitwiseAND(mask))
        bits = F.array(*[F.lit(_signed(1 << b)).cast("long") for b in part])
        zero = lambda v: F.filter(bits, lambda b: v.bitwiseAND(b) == 0)  # noqa: B023, E731
        grown = values
        for _ in range(t):
            grown = F.array_distinct(F.flatten(F.transform(grown, lambda v: F.concat(F.array(v), F.transform(zero(v), lambda b: v.bitwiseOR(b))))))  # noqa: B023
        dealt.append(F.transform(grown, lambda v: F.struct(mask.alias("mask"), v.alias("value"))))  # noqa: B023
    return fps.select(*fps.columns, F.explode(F.concat(*dealt)).alias("k")).select("k.mask", "k.value", *fps.columns)


def _split(rows: DataFrame, radius: int) -> DataFrame:
    """The rows of large buckets in radius + 1 smaller ones each: links within the radius agree on one of so many groups of the bits left."""
    names = rows.columns  # mask, value, fp, and further longs

    def split(batches):
        for b in batches:
            columns = np.column_stack([x.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for x in b.columns])
            out = [np.zeros((0, len(names)), np.uint64)]
            for m in np.unique(columns[:, 0]):  # one a part at first, radius + 1 times as many at each further split
                held = columns[columns[:, 0] == m]
                left = [bit for bit in range(64) if not int(m) >> bit & 1]
                for sub in (np.uint64(sum(1 << bit for bit in left[k :: radius + 1])) for k in range(radius + 1)):
                    if sub:
                        new = held.copy()
                        new[:, 0], new[:, 1] = m | sub, held[:, 1] | (held[:, 2] & sub)
                        out.append(new)
            out = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(out[:, i]).view(np.int64)) for i in range(len(names))], names)

    return rows.mapInArrow(split, ", ".join(f"{n} long" for n in names)).distinct()


def forest(v: np.ndarray, radius: int, lanes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within `radius` bits of fingerprints, shortest links first (Prim's), as (places of ends, of other ends).

    lanes: sketches, a row each; then links agree in AGREE lanes or more, too.
    """
    a, b, n = [], [], len(v)
    far, source, out = np.full(n, 65, np.uint8), np.zeros(n, np.int64), np.zeros(n, bool)
    for _ in range(n):
        at = int(np.where(out, 66, far).argmin())
        if far[at] <= radius:  # else no link leads further: the next tree
            a.append(at)
            b.append(int(source[at]))
        out[at] = True
        d = np.bitwise_count(v ^ v[at])
        closer = np.flatnonzero(~out & (d < far) & (d <= radius))
        if lanes is not None:
            closer = closer[(lanes[closer] == lanes[at]).sum(1) >= AGREE]
        far[closer], source[closer] = d[closer], at
    return np.array(a, np.int64), np.array(b, np.int64)


def _forests(radius: int):
    """Rows of (members: structs of fp, id, and s0 and s1 if there are sketches) to links (a, b) of ids."""

    def run(batches):
        for batch in batches:
            ends = [np.zeros((0, 2), np.int64)]
            for m in batch.column(0):
                cols = {f.name: m.values.field(f.name).to_numpy(zero_copy_only=False) for f in m.values.type}
                _, first = np.unique(cols["id"], return_index=True)
                lanes = np.column_stack([cols[c][first] for c in ("s0", "s1")]).view(np.uint8) if "s0" in cols else None
                a, b = forest(cols["fp"][first].view(np.uint64), radius, lanes)
                ends.append(np.column_stack([cols["id"][first][a], cols["id"][first][b]]))
            ends = np.concatenate(ends)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ends[:, i])) for i in range(2)], ["a", "b"])

    return run


def links(nodes: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) of the ids of nodes (fp, id, and s0 and s1 for sketches), whose components are those of all links.

    A link: at most `radius` bits between the fingerprints, and AGREE lanes or
    more between the sketches, if there are any.  Pairs within a bucket are
    compared exactly; a bucket of over `bucket` members goes to smaller ones
    before it is gathered.  Without sketches, where fingerprints are distinct, it
    is split along its bits until no more than `radius` are left, when no bucket
    can hold more than a few hundred.  With sketches it is split once, by the
    values of neighbouring lanes; members of what is still larger are each tied
    to its smallest id.  That keeps every link, but for 2 in 100,000 of those of a
    similarity of 0.8, and may add some between members of such a heap.
    """
    n, sketched = nodes.count(), "s0" in nodes.columns
    counts = nodes.select("fp").mapInArrow(_cooccurrence, "i int, j int, c long").groupBy("i", "j").agg(F.sum("c").alias("c")).collect()
    both = np.zeros((64, 64))
    for r in counts:
        both[r["i"], r["j"]] = r["c"]
    rows, key, edges = _deal(nodes, allocate(both, n, radius)), ["mask", "value"], []
    while True:
        sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
        large = written(sizes.filter((F.col("n") > bucket) & (F.lit(sketched) | (F.bit_count(F.col("mask")) < 64 - radius))).drop("n"), "simhash-large")
        hot = not large.isEmpty()
        small = rows.join(large, key, "left_anti") if hot else rows
        gathered = small.groupBy(*key).agg(F.collect_list(F.struct(*nodes.columns)).alias("members")).filter(F.size("members") > 1).select("members")
        edges.append(written(gathered.mapInArrow(_forests(radius), "a long, b long").distinct(), "simhash-links"))
        if not hot:
            break
        rows = rows.join(large, key, "left_semi")
        if not sketched:
            rows = written(_split(rows, radius), "simhash-split")
        elif len(key) == 2:
            rows, key = written(rows.withColumn("band", _bands()), "simhash-split"), [*key, "band"]
        else:
            least = rows.groupBy(*key).agg(F.min("id").alias("b"))
            edges.append(written(rows.join(least, key).filter("id != b").select(F.col("id").alias("a"), "b").distinct(), "simhash-heaps"))
            break
    out = edges[0]
    for e in edges[1:]:
        out = out.union(e)
    return out


def _bands():
    """Each pair of neighbouring lanes of a sketch (the last and the first are neighbours) with its values, a row each."""
    lane = lambda i: F.shiftrightunsigned(F.col(f"s{i // 8}"), 8 * (i % 8)).bitwiseAND(F.lit(255))
    return F.explode(F.array(*[F.lit(i << 16) + lane(i) * 256 + lane((i + 1) % LANES) for i in range(LANES)]))


def near_groups(docs: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, text_hash, fp, component_id of every row of docs(doc_id, text, ...).

    component_id is the smallest doc_id of the rows reachable over links of at
    most `radius` bits; equal fingerprints are linked.  A null text is empty
    (fingerprint 0, linked like any other); very long texts are hashed whole,
    BLOCK shingles at a time.  Rows without a doc_id are linked but never name
    a component (null where no row of it has one).  Repeated rows each get a
    row; other columns are not read; an empty table gives no rows.
    """
    rows = written(fingerprints(docs), "simhash-rows")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    return _named(rows, fps, "fp", links(fps.select("fp", F.col("fp").alias("id")), radius)).select("doc_id", "text_hash", "fp", "component_id")


def _named(rows: DataFrame, nodes: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """rows with component_id: the smallest doc_id (low of nodes) of the rows whose keys the edges connect."""
    roots = written(components(edges, "simhash-components"), "simhash-roots")
    tied = nodes.join(roots, F.col(key) == F.col("node"), "left").select(key, "low", F.coalesce("root", key).alias("root"))
    least = tied.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.join(written(tied.join(least, "root").select(key, "component_id"), "simhash-named"), key)


def _whole(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """text_hash and all shingles g of the texts in wanted(text_hash, doc_id: of one row that has it).

    Texts are not shuffled: a filter of about FILTER_SHARE bits for each wanted
    text, sent to all, picks rows on the executors, and a join drops the few
    that it lets through wrongly.  Where that would be more than FILTER_BITS,
    the texts themselves are joined with those wanted before they are read.
    """
    of = wanted.select(F.xxhash64("doc_id", "text_hash").alias("key"), F.col("doc_id").alias("i"), F.col("text_hash").alias("h"))
    bits = 1 << max(wanted.count() * FILTER_SHARE, 64).bit_length()
    texts = docs.select(F.col("doc_id").alias("_i"), F.xxhash64("text").alias("_h"), F.col("text").cast("binary").alias("data"))
    texts = texts.select(F.xxhash64("_i", "_h").alias("key"), "_i", "_h", "data")
    same = (F.col("_i").eqNullSafe(F.col("i"))) & (F.col("_h") == F.col("h"))
    held = None
    if bits <= FILTER_BITS:
        bit = F.pmod("key", F.lit(bits))
        words = of.select((bit / 64).cast("int").alias("at"), F.pmod(bit, F.lit(64)).cast("int").alias("bit")).groupBy("at").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("word")).toArrow()
        held = np.zeros(bits // 64, np.int64)
        held[words["at"].to_numpy()] = words["word"].to_numpy()
        held = held.view(np.uint8)
    else:
        texts = texts.join(of, (texts["key"] == of["key"]) & same, "left_semi")

    def run(batches):
        for b in batches:
            if held is not None:
                at = b.column(0).to_numpy(zero_copy_only=False) % bits
                b = b.filter(pa.array((held[at >> 3] >> (at & 7) & 1).astype(bool)))
            sets = [shingles(t.as_py() or b"").view(np.int64) for t in b.column(3)]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))], ["key", "_i", "_h", "g"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = texts.mapInArrow(run, f"key long, _i {kind}, _h long, g array<long>")
    found = texts.join(of, (texts["key"] == of["key"]) & same)
    return written(found.select(F.col("_h").alias("text_hash"), "g").dropDuplicates(["text_hash"]), "simhash-whole")


def alike_pairs(key: np.ndarray, first: np.ndarray, second: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of a text of `first` and one of `second` (masks) that are at least ALIKE.

    sizes, flat: each text's number of shingles and all of them, end to end.
    Common shingles are counted by products of incidence matrices, column block
    by column block; shingles of one text alone cannot be common.
    """
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    own = np.repeat(np.arange(len(key)), sizes)
    own, column = own[count[column] > 1], rank[column[count[column] > 1]]
    order = np.argsort(column, kind="stable")
    own, column = own[order], column[order]
    one, two = np.flatnonzero(first), np.flatnonzero(second)
    common = np.zeros((len(one), len(two)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, (at, at + 4096))
        block = np.zeros((len(key), 4096), np.float32)
        block[own[lo:hi], column[lo:hi] - at] = 1
        common += block[one] @ block[two].T
    alike = common * (ALIKE[0] + ALIKE[1]) >= (sizes[one][:, None] + sizes[two]) * ALIKE[0]
    joined = np.zeros((len(key), len(key)), bool)
    joined[np.ix_(one, two)] = alike
    joined |= joined.T
    a, b, left = [], [], np.ones(len(key), bool)
    for root in range(len(key)):
        reached = [root] if left[root] else []
        left[root] = False
        while reached:
            at = reached.pop()
            found = np.flatnonzero(joined[at] & left)
            left[found] = False
            reached.extend(found)
            a.extend([key[at]] * len(found))
            b.extend(key[found])
    return np.array(a, np.int64), np.array(b, np.int64)


def _compare(members: pa.Table) -> pa.Table:
    """The alike pairs, as a forest, of the texts of one block that ask (first) and those of another that are asked (second)."""
    g = members["g"].combine_chunks()
    first, second = (members[c].to_numpy(zero_copy_only=False) for c in ("first", "second"))
    a, b = alike_pairs(members["text_hash"].to_numpy(), first, second, g.value_lengths().to_numpy(), g.flatten().to_numpy())
    return pa.table({"a": a, "b": b})


def _blocked(member: DataFrame) -> DataFrame:
    """member(family, text_hash, g) with side and blocks: its block among those of its family, each of at most about FAMILY texts and FAMILY_SHINGLES shingles."""
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / FAMILY), F.ceil(F.sum(F.size("g")) / FAMILY_SHINGLES)).cast("int")
    sizes = written(member.groupBy("family").agg(blocks.alias("blocks")), "simhash-blocks")
    return member.join(sizes, "family").withColumn("side", F.pmod(F.xxhash64("text_hash"), F.col("blocks")).cast("int"))


def family_links(member: DataFrame) -> DataFrame:
    """Links (a, b) of alike texts of member(family, text_hash, g), whose components are those of all alike pairs within a family.

    The smallest text hash of a family stands for it: every other text is
    compared with it, block by block.  Only what is not alike to it is compared
    with all texts of the family.  So a family of copies costs no more than its
    size, and others the number of the rest times that of all.
    """
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    member = written(_blocked(member), "simhash-members")
    low = member.groupBy("family").agg(F.min("text_hash").alias("text_hash"))
    low = written(member.join(low, ["family", "text_hash"]), "simhash-low")
    one = member.join(low.select("family", F.col("text_hash").alias("low")), "family").filter("text_hash != low").select("family", "side", "text_hash", "g", F.lit(False).alias("first"), F.lit(True).alias("second"))
    asked = one.union(low.withColumn("side", every("blocks")).select("family", "side", "text_hash", "g", F.lit(True), F.lit(False)))
    near = written(_compared(asked, "family", "side"), "simhash-near-low")
    done = near.select(F.explode(F.array("a", "b")).alias("text_hash")).union(low.select("text_hash")).distinct()
    rest = written(_blocked(member.select("family", "text_hash", "g").join(done, "text_hash", "left_anti").select("family", "text_hash", "g")), "simhash-rest")
    if rest.isEmpty():
        return near
    # A text of the rest meets every block of all, a text of all every block of the rest; in a block of each a text may stand on both sides.
    of_all, of_rest = (x.groupBy("family").agg(F.first("blocks").alias(c)) for x, c in ((member, "n_all"), (rest, "n_rest")))
    left = rest.join(of_all, "family").select("family", F.col("side").alias("one"), every("n_all").alias("two"), "text_hash", "g", F.lit(True).alias("first"), F.lit(False).alias("second"))
    right = member.join(of_rest, "family").select("family", every("n_rest").alias("one"), F.col("side").alias("two"), "text_hash", "g", F.lit(False).alias("first"), F.lit(True).alias("second"))
    return near.union(written(_compared(left.union(right), "family", "one", "two").filter("a != b"), "simhash-alike"))


def _compared(rows: DataFrame, *key: str) -> DataFrame:
    """_compare() of each group, dealt by the whole key: else Spark would make do with an earlier dealing by family, and a large one would be one task."""
    return rows.repartition(*key).groupBy(*key).applyInArrow(_compare, "a long, b long")


def near_copies(docs: DataFrame, size: int = PRINT, radius: int = RADIUS) -> DataFrame:
    """doc_id, text_hash, fp, component_id of every row of docs(doc_id, text, ...): near copies by the similarity of word shingles.

    Two texts are linked if their sets of SHINGLE-word shingles are at least
    ALIKE and a chain of candidates connects them: fingerprints of their
    `size`-word shingles within `radius` bits, and sketches of these shingles
    that agree in AGREE lanes.  Within a family of such texts the comparison is
    exact and whole, so only texts whose fingerprints lie too far apart can be
    missed (and 3 pairs in 100,000 by their sketches).  Odd rows as in
    near_groups(); texts of fewer words than a shingle are one; texts without
    words are alike.
    """
    rows = written(fingerprints(docs, size, True), "simhash-rows")
    texts = written(rows.groupBy("text_hash").agg(F.min("fp").alias("fp"), F.min("s0").alias("s0"), F.min("s1").alias("s1"), F.min("doc_id").alias("low")), "simhash-texts")
    same = ["fp", "s0", "s1"]
    nodes = written(texts.groupBy(*same).agg(F.min("text_hash").alias("id")), "simhash-distinct")
    edges = written(links(nodes.select("fp", "id", "s0", "s1"), radius), "simhash-near")
    equal = texts.join(nodes, same).filter("text_hash != id").select(F.col("id").alias("a"), F.col("text_hash").alias("b"))
    pairs = written(edges.union(equal).distinct(), "simhash-pairs")
    family = written(components(pairs, "simhash-families").select(F.col("node").alias("text_hash"), F.col("root").alias("family")), "simhash-family")
    wanted = written(texts.join(family.select("text_hash"), "text_hash").select("text_hash", F.col("low").alias("doc_id")), "simhash-wanted")
    alike = written(family_links(_whole(docs, wanted).join(family, "text_hash").select("family", "text_hash", "g")), "simhash-tied")
    return _named(rows.drop("s0", "s1"), texts.select("text_hash", "low"), "text_hash", alike).select("doc_id", "text_hash", "fp", "component_id")


def deduplicated(docs: DataFrame, radius: int = 3) -> DataFrame:
    """One row of docs for each group of near_groups(), as one_of_each() takes it."""
    return one_of_each(docs, near_groups(docs, radius), "fp")


def without_copies(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of near_copies(), as one_of_each() takes it."""
    return one_of_each(docs, near_copies(docs), "text_hash")


def one_of_each(docs: DataFrame, groups: DataFrame, same: str) -> DataFrame:
    """One row of docs, with all its columns, for each group: that with the smallest doc_id (then text hash; rows without a doc_id last).

    Where no row of a group has a doc_id, one row of each value of the column
    `same` of groups stays.  Repeated rows are one.
    """
    found = written(groups, "simhash-groups")
    alone = F.when(F.col("component_id").isNull(), F.col(same))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    keep = found.groupBy("component_id", alone.alias("alone")).agg(best.alias("k"))
    keep = written(keep.select(F.xxhash64("k.doc_id", "k.text_hash").alias("_k"), F.col("k.doc_id").alias("_i"), F.col("k.text_hash").alias("_h")), "simhash-kept")
    # Each row travels as one struct, so that no column of docs can clash with those here.
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("_hash"), F.col("doc_id").alias("_id")).withColumn("_key", F.xxhash64("_id", "_hash"))
    kept = rows.join(keep, (F.col("_key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")))
    if not found.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["_key", "_id", "_hash"])
    return kept.select("row.*")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
