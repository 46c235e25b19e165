"""Product codes of vectors by Hamerly's form of Lloyd's algorithm, in exact integers.

Vectors are cut into parts; each part position has a codebook.  Every part of
every vector keeps its entry, one upper bound of the distance to it and one
lower bound of the distance to the second nearest, in a table that each round
writes anew.  When the codebooks move, the bounds move with them; only where
the upper bound is not strictly below the lower one is the distance to the own
entry computed, and only where that does not help are all entries compared.  A
strict bound means a strictly nearest entry, so ties are always settled by a
scan, in favour of the lower index.  Bounds are floats rounded outwards;
distances, sums and entries are exact integers.  A round sends out what the
parts that changed their entry add to and take from the sums, no more.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import matrix
from .common import discard, table, written

#: Bits of a limb of a sum: so many tasks' limbs add up within a long.
LIMB = 40
#: Rows of a part that are compared with all entries at a time.
BLOCK = 8192


class Facts:
    """What the tasks need to know of all vectors: width of a part, number of limbs, whether doubles hold every squared distance."""

    def __init__(self, n: int, width: int, most: float, parts: int):
        self.parts, self.width = parts, max(-(-width // parts), 1)
        top = int(most) + 1
        self.small = 4 * top * top * self.width < 1 << 53
        bits = top.bit_length() + n.bit_length() + 1
        self.limbs = 1 if bits <= 62 else -(-bits // LIMB)


def integers(column, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows take part, their components floor(scale * x) in one array): those without null or non-finite components."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    there = ~np.isnan(lengths.astype(float))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(flat * scale)  # exact: a double holds it, however large
    own = np.repeat(np.flatnonzero(there), lengths[there].astype(np.int64))
    there[own[~np.isfinite(flat)]] = False
    return there, flat[there[own]]


def _facts(scale: int, entries: int):
    """Of each task: its number of kept rows, the longest, the largest component and the smallest ids."""

    def run(batches):
        n = width = 0
        most, ids = 0.0, np.zeros(0, np.int64)
        for b in batches:
            there, flat = integers(b.column(1), scale)
            n += int(there.sum())
            kept = b.filter(pa.array(there))
            if kept.num_rows:
                width = max(width, int(kept.column(1).value_lengths().to_numpy().max()))
                most = max(most, float(np.abs(flat).max(initial=0)))
                ids = np.unique(np.concatenate([ids, kept.column(0).drop_null().to_numpy()]))[:entries]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([width]), pa.array([most]), pa.array([ids.tolist()], pa.list_(pa.int64()))], ["n", "width", "most", "ids"])

    return run


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows and entries: exact, as both are integers within doubles or of any size (objects)."""
    if x.dtype == object:
        return np.array([[sum((a - b) ** 2 for a, b in zip(row, e)) for e in entries] for row in x], object).reshape(len(x), len(entries))
    return (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)


def roots(squares: np.ndarray, up: bool) -> np.ndarray:
    """Square roots as singles, rounded up or down."""
    if squares.dtype == object:
        r = np.array([float(math.isqrt(d)) if d < 1 << 2000 else math.inf if up else 0.0 for d in squares.ravel()]).reshape(squares.shape)
        r = r + 1 if up else r
    else:
        r = np.sqrt(squares)
    return outwards(r, up)


def outwards(r: np.ndarray, up: bool) -> np.ndarray:
    """As singles, at least (up) or at most r, the rounding of two operations before included."""
    with np.errstate(over="ignore"):
        r = (r * (1 + 1e-12 if up else 1 - 1e-12)).astype(np.float32)
    return np.nextafter(r, np.float32(np.inf if up else -np.inf))


def assign(x: np.ndarray, entries: np.ndarray, near: np.ndarray | None, upper: np.ndarray, lower: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(nearest entry, upper, lower, rows that were compared with all entries) of one part of the rows x.

    near, upper, lower: those of the entries before, which have moved by at most
    drift since; near is None in the first round.
    """
    if near is None:
        near, scan = np.zeros(len(x), np.int64), np.arange(len(x))
        upper, lower = np.zeros(len(x), np.float32), np.zeros(len(x), np.float32)
    else:
        # The second nearest may be any entry but the own: the largest drift, or the next where that is the own's.
        order = np.argsort(-drift, kind="stable")
        others = np.where(near == order[0], drift[order[1]] if len(drift) > 1 else 0.0, drift[order[0]])
        upper, lower = outwards(upper.astype(float) + drift[near], True), outwards(lower.astype(float) - others, False)
        lower = np.where(lower < 0, np.float32(0), lower)
        scan = np.flatnonzero(~(upper < lower))
        own = np.concatenate([np.zeros(0, x.dtype), *(((x[i] - entries[near[i]]) ** 2).sum(1) for i in np.array_split(scan, -(-len(scan) // BLOCK) or 1))])
        upper[scan] = roots(own, True)
        scan = scan[~(upper[scan] < lower[scan])]
        near = near.copy()
    for i in range(0, len(scan), BLOCK):
        at = scan[i : i + BLOCK]
        d = distances(x[at], entries)
        near[at] = d.argmin(1)  # the first of equals
        one = d[np.arange(len(at)), near[at]]
        upper[at] = roots(one, True)
        if len(entries) > 1:
            d[np.arange(len(at)), near[at]] = d.max() + 1
            lower[at] = roots(d.min(1), False)
        else:
            lower[at] = np.inf
    return near, upper, lower, len(scan)


def _part(flat: np.ndarray, facts: Facts, p: int) -> np.ndarray:
    x = flat[:, p * facts.width : (p + 1) * facts.width]
    return x if facts.small else np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


def _wide(column, there: np.ndarray, flat: np.ndarray, facts: Facts) -> np.ndarray:
    kept = column.filter(pa.array(there))
    ends = np.concatenate(([0], np.cumsum(kept.value_lengths().to_numpy()))).astype(np.int32)
    return matrix(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), facts.parts * facts.width)


def _books(books: list, facts: Facts) -> list[np.ndarray]:
    return [np.array(b, float if facts.small else object).reshape(len(b), facts.width) for b in books]


def _lists(rows: np.ndarray, kind) -> pa.ListArray:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows).ravel(), kind))


def _round(books: list, drift: np.ndarray, facts: Facts, scale: int, first: bool, names: list[str]):
    """Rows with their new entries and bounds; at the end of a task one further row, of what changed: (part, entry, count, limbs of the sums)."""

    def run(batches):
        tables = _books(books, facts)
        k = len(books[0])
        sums, counts, scans = np.zeros((facts.parts, k, facts.width), np.int64 if facts.small else object), np.zeros((facts.parts, k), np.int64), 0
        schema = None
        for b in batches:
            there, flat = integers(b.column(2), scale)
            kept = b.filter(pa.array(there))
            x = _wide(b.column(2), there, flat, facts)
            old = None if first else [matrix(kept.column(c), facts.parts, t) for c, t in ((3, np.int64), (4, np.float32), (5, np.float32))]
            new = [np.zeros((kept.num_rows, facts.parts), t) for t in (np.int64, np.float32, np.float32)]
            for p in range(facts.parts):
                part = _part(x, facts, p)
                before = (None, np.zeros(0), np.zeros(0)) if first else [o[:, p] for o in old]
                near, up, low, n = assign(part, tables[p], *before, drift[p])
                scans += n
                for o, v in zip(new, (near, up, low), strict=True):
                    o[:, p] = v
                moved = np.arange(len(near)) if first else np.flatnonzero(near != before[0])
                whole = part[moved].astype(np.int64) if facts.small else part[moved]
                np.add.at(sums[p], near[moved], whole)
                np.add.at(counts[p], near[moved], 1)
                if not first:
                    np.subtract.at(sums[p], before[0][moved], whole)
                    np.subtract.at(counts[p], before[0][moved], 1)
            columns = [*kept.columns[:3], _lists(new[0].astype(np.int8), pa.int8()), _lists(new[1], pa.float32()), _lists(new[2], pa.float32())]
            out = pa.RecordBatch.from_arrays([*columns, pa.nulls(kept.num_rows, DELTAS)], names)
            schema = out.schema
            yield out
        if schema is not None:
            changed = [{"part": p, "entry": e, "count": int(counts[p, e]), "sums": [x for v in sums[p, e] for x in limbs(int(v), facts.limbs)]} for p in range(facts.parts) for e in range(k) if counts[p, e] or sums[p, e].any()]
            last = {"scans": scans, "changed": changed}
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(schema)[:-1]), pa.array([last], DELTAS)], schema=schema)

    return run


DELTAS = pa.struct([("scans", pa.int64()), ("changed", pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("count", pa.int64()), ("sums", pa.list_(pa.int64()))])))])
DELTAS_SQL = "struct<scans long, changed array<struct<part int, entry int, count long, sums array<long>>>>"


def limbs(v: int, n: int) -> list[int]:
    """v in n limbs, the lowest first; the last holds the sign."""
    out = []
    for _ in range(n - 1):
        out.append(v & ((1 << LIMB) - 1))
        v >>= LIMB
    return [*out, v]


def _final(books: list, drift: np.ndarray, facts: Facts, scale: int):
    def run(batches):
        tables = _books(books, facts)
        for b in batches:
            there, flat = integers(b.column(2), scale)
            x = _wide(b.column(2), there, flat, facts)
            kept = b.filter(pa.array(there))
            old = [matrix(kept.column(c), facts.parts, t) for c, t in ((3, np.int64), (4, np.float32), (5, np.float32))]
            codes, error = np.zeros((kept.num_rows, facts.parts), np.uint8), np.zeros(kept.num_rows, np.int64 if facts.small else object)
            for p in range(facts.parts):
                part = _part(x, facts, p)
                near, _, _, _ = assign(part, tables[p], *(o[:, p] for o in old), drift[p])
                codes[:, p] = near
                own = ((part - tables[p][near]) ** 2).sum(1)
                error = error + (own.astype(np.int64) if facts.small else own)
            found = pa.array([int(e) if e < 1 << 63 else None for e in error], pa.int64())
            yield pa.RecordBatch.from_arrays([*kept.columns[:2], pa.array([c.tobytes().hex() for c in codes], pa.string()), found], ["id", "label", "code", "error"])

    return run


class Books:
    """The codebooks of the rounds: fit() leaves entries (parts x entries x width, integers), the number of scans a round, and the rows with their bounds."""

    def __init__(self, rows: DataFrame, parts: int, entries: int, rounds: int, scale: int):
        """rows: (id, label, vec)."""
        self.entries, self.scans, self.state, self.scale = [], [], None, scale
        facts = rows.select("id", "vec").mapInArrow(_facts(scale, entries), "n long, width long, most double, ids array<long>")
        seen = facts.agg(F.sum("n").alias("n"), F.max("width").alias("width"), F.max("most").alias("most")).first()
        if not seen["n"]:
            return
        self.facts = Facts(seen["n"], seen["width"], seen["most"], parts)
        low = facts.select(F.explode("ids").alias("id")).distinct().orderBy("id").limit(entries)
        low = [r["id"] for r in low.collect()]
        # Of the rows of one id the smallest vector; null where the table has no ids at all.
        vec = rows.filter(F.col("id").isin(low)).mapInArrow(_kept(scale), rows.schema).groupBy("id").agg(F.min("vec").alias("vec")).orderBy("id").collect()
        start = []
        for r in vec:
            x = [int(math.floor(float(v) * scale)) for v in r["vec"]]
            start.append(x + [0] * (parts * self.facts.width - len(x)))
        start = start or [[0] * (parts * self.facts.width)]
        w = self.facts.width
        self.entries = [[e[p * w : (p + 1) * w] for e in start] for p in range(parts)]
        self.drift = np.zeros((parts, len(start)))
        sums, counts = [[[0] * w for _ in start] for _ in range(parts)], [[0] * len(start) for _ in range(parts)]
        names = ["id", "label", "vec", "near", "upper", "lower", "delta"]
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        for r in range(rounds):
            before = self.state
            source = rows if before is None else before.filter("delta IS NULL").drop("delta")
            run = _round(self.entries, self.drift, self.facts, scale, before is None, names)
            self.state = written(source.mapInArrow(run, f"{kinds}, near array<tinyint>, upper array<float>, lower array<float>, delta {DELTAS_SQL}"), "codes-state")
            if before is not None:
                discard(before)
            self._moved(sums, counts)

    def _moved(self, sums: list, counts: list) -> None:
        """Adds up what changed, at most parts x entries x width numbers, and moves the entries."""
        changes = self.state.filter("delta IS NOT NULL").select("delta.*")
        self.scans.append(changes.agg(F.sum("scans")).first()[0])
        each = changes.select(F.explode("changed").alias("c")).select("c.*")
        for r in each.groupBy("part", "entry").agg(F.sum("count").alias("n")).collect():
            counts[r["part"]][r["entry"]] += r["n"]
        spread = each.select("part", "entry", F.posexplode("sums").alias("at", "v")).groupBy("part", "entry", "at").agg(F.sum("v").alias("v"))
        n = self.facts.limbs
        for r in spread.collect():
            sums[r["part"]][r["entry"]][r["at"] // n] += r["v"] << LIMB * (r["at"] % n)
        for p, book in enumerate(self.entries):
            for e, old in enumerate(book):
                new = [s // counts[p][e] for s in sums[p][e]] if counts[p][e] else old
                gone = np.array([sum((a - b) ** 2 for a, b in zip(new, old))], object)
                self.drift[p, e] = float(roots(gone, True)[0]) if gone[0] else 0.0
                book[e] = new

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for book in self.entries for e in book for v in e).encode()).hexdigest()

    def coded(self) -> DataFrame:
        """id, label, code, error of every kept row."""
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.state.schema if f.name in ("id", "label"))
        rows = self.state.filter("delta IS NULL").drop("delta")
        return rows.mapInArrow(_final(self.entries, self.drift, self.facts, self.scale), f"{kinds}, code string, error long")


def _kept(scale: int):
    def run(batches):
        for b in batches:
            yield b.filter(pa.array(integers(b.column(2), scale)[0]))

    return run


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that is not null and holds no null or non-finite component.

    Ids are longs; rows of one id each get a row, and of several vectors of one
    id the smallest starts an entry.  Rows without an id are coded and start
    none.  Vectors shorter than the longest, or than a multiple of `parts`,
    count as ending in zeros, empty ones too.  Fewer ids than `entries` make
    smaller codebooks; without any id the only entry starts at zero.  Components
    may be as large as doubles go (those that overflow when scaled count as
    non-finite): integers grow as needed, and an error beyond 64 bits is null, as
    is the sum over its label.  Other columns are not read; an empty table gives
    no rows.  The driver holds the codebooks and their sums.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    books = Books(rows, parts, entries, rounds, scale)
    if not books.entries:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = written(books.coded(), "codes")
    discard(books.state)
    whole = F.when(F.count(F.lit(1)) == F.count("error"), F.sum(F.col("error").cast("decimal(38,0)"))).try_cast("long")
    sums = written(coded.groupBy("label").agg(whole.alias("label_error")).withColumnRenamed("label", "of"), "codes-labels")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12_codes(spark, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The rounds one after the other: b0, a0, b1, a1 and so on are the codebooks and the parts assigned to them."""
    nearest = """
a{r} AS MATERIALIZED (SELECT vec_id, p, entry, d FROM (
  SELECT x.vec_id, x.p, b.entry, sum((x.v - b.v) * (x.v - b.v)) AS d FROM x JOIN b{r} b ON x.p = b.p AND x.i = b.i GROUP BY x.vec_id, x.p, b.entry)
  QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, entry) = 1)"""
    moved = """,
b{r} AS MATERIALIZED (SELECT b.p, b.entry, b.i, coalesce((s.t - ((s.t % s.n) + s.n) % s.n) // s.n, b.v) AS v FROM b{q} b LEFT JOIN (
  SELECT x.p, a.entry, x.i, sum(x.v) AS t, count(*) AS n FROM x JOIN a{q} a ON x.vec_id = a.vec_id AND x.p = a.p GROUP BY x.p, a.entry, x.i) s
  ON b.p = s.p AND b.entry = s.entry AND b.i = s.i),"""
    text = f"""
WITH e AS (SELECT vec_id, label, embedding, CAST(len(embedding) // {parts} AS BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
f AS (SELECT vec_id, w, unnest(embedding) AS c, generate_subscripts(embedding, 1) - 1 AS k FROM e),
x AS MATERIALIZED (SELECT vec_id, CAST(k // w AS INTEGER) AS p, CAST(k % w AS INTEGER) AS i, CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT) AS v FROM f),
m AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM e ORDER BY vec_id LIMIT {entries}),
b0 AS MATERIALIZED (SELECT x.p, m.entry, x.i, CAST(x.v AS HUGEINT) AS v FROM x JOIN m ON x.vec_id = m.vec_id),"""
    for r in range(rounds):
        text += nearest.format(r=r) + moved.format(r=r + 1, q=r)
    return text + nearest.format(r=rounds) + f""",
h AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, entry, i)) AS sha FROM b{rounds}),
c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT c.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY e.label) AS BIGINT) AS label_error, h.sha AS codebooks_sha256
FROM c JOIN e ON c.vec_id = e.vec_id, h"""


OP12_SQL = _sql()
