"""Near copies by similarity against brute force over all pairs."""

import collections
import random

import numpy as np
import pytest

from tarnwick.llm import simhash
from tests.llm.test_documents import frame, odd_rows

SCHEMA = "doc_id long, text string"


def brute_set(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def brute_kept(rows):
    """Smallest doc_id of each component of the pairs with a Jaccard similarity of at least 0.8."""
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, one in enumerate(sets):
        for j, two in enumerate(sets[:i]):
            if one == two or 5 * len(one & two) >= 4 * len(one | two):
                root[find(i)] = find(j)
    kept = {}
    for i, (k, _) in enumerate(rows):
        kept[find(i)] = min(kept.get(find(i), k), k)
    return sorted(kept.values())


def edited(rng, words, n):
    """The words with n of them replaced."""
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.randrange(10**9)}"
    return " ".join(out)


def near_rows():
    """Copies of few and many edits, chains, short texts, and a line that most rows hold."""
    rng, rows, line = random.Random(3), [], "this one line is held by most of the rows here"
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([5, 9, 40, 200, 400]))]
        rows += [edited(rng, words, min(len(words) // 2, k)) + " " + line for k in (0, 1, 2, 3, 5, 8, 13)]
        chain = words
        for _ in range(6):
            chain = edited(rng, chain, max(len(words) // 60, 1)).split()
            rows.append(" ".join(chain))
    rows += ["", "one", "One", "one two", line, f"{line} too", f"{line} and yet more"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def brute_links(rows):
    sets = [brute_set(t) for _, t in rows]
    return {(j, i) for i, one in enumerate(sets) for j, two in enumerate(sets[:i]) if one == two or 5 * len(one & two) >= 4 * len(one | two)}


def grouped(rows, groups):
    """The pairs of positions that a result puts into one group."""
    group = {r["doc_id"]: r["component_id"] for r in groups.collect()}
    return group, {(j, i) for i, (d, _) in enumerate(rows) for j, (e, _) in enumerate(rows[:i]) if group[d] == group[e]}


def closure(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        root[find(i)] = find(j)
    return {(j, i) for i in range(n) for j in range(i) if find(i) == find(j)}


def test_near_copies_are_found_and_nothing_else(spark):
    rows = near_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    group, got = grouped(rows, simhash.near_copies(docs))
    links = brute_links(rows)
    assert got <= closure(len(rows), links)
    # Short texts of few shingles may lie far apart in fingerprints.
    assert len(links & got) / len(links) > 0.9
    long = {(j, i) for j, i in links if min(len(rows[i][1].split()), len(rows[j][1].split())) > 100}
    assert len(long & got) / len(long) > 0.97
    assert {group[d] for d in group} <= set(group) and all(group[c] == c for c in group.values())


def test_near_copies_of_the_given_documents(spark):
    """Documents 6 and 145, 1 and 177 of sf0.001 are alike, 7 and 11 bits apart by three-word shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted(r["doc_id"] for r in simhash.without_copies(docs).collect())
    assert got == brute_kept(rows) and not {145, 177} & set(got)


def test_a_family_is_compared_whole_in_blocks(spark, monkeypatch):
    """One large family, most of whose texts are alike to few others: no link of it is lost, whatever the blocks."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = [(i, edited(rng, words, rng.choice([0, 1, 2, 4, 8, 16]))) for i in range(150)]
    monkeypatch.setattr(simhash, "FAMILY", 40)
    _, got = grouped(rows, simhash.near_copies(spark.createDataFrame(rows, SCHEMA)))
    want = closure(len(rows), brute_links(rows))
    assert got <= want and len(got) > 0.99 * len(want)


def test_alike_pairs_of_masks():
    rng = np.random.default_rng(5)
    for _ in range(40):
        n = int(rng.integers(1, 12))
        base = rng.integers(0, 40, 20)
        sets = [np.unique(np.concatenate([rng.choice(base, int(rng.integers(0, 20))), rng.integers(100, 110, int(rng.integers(0, 3)))])) for _ in range(n)]
        side = rng.integers(0, 2, n)
        sizes, flat = np.array([len(x) for x in sets]), np.concatenate([np.zeros(0, np.int64), *sets]).astype(np.int64)
        for first, second in ((side == 0, side == 1), (side == 0, side == 0)):
            a, b = simhash.alike_pairs(np.arange(n), first, second, sizes, flat)
            pairs = {(i, j) for i in np.flatnonzero(first) for j in np.flatnonzero(second) if i != j and 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))}
            assert set(zip(a.tolist(), b.tolist())) <= pairs | {(j, i) for i, j in pairs}
            assert closure(n, zip(a.tolist(), b.tolist())) == closure(n, pairs)


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def sketch(rng, base=None, keep=simhash.LANES):
    """Random lanes, `keep` of them those of base."""
    lanes = [rng.randrange(256) for _ in range(simhash.LANES)]
    for i in rng.sample(range(simhash.LANES), keep) if base else ():
        lanes[i] = base[i]
    return lanes


def longs(lanes):
    return tuple(signed(int.from_bytes(bytes(lanes[k : k + 8]), "little")) for k in (0, 8))


@pytest.mark.parametrize("bucket", [8192, 8])
def test_strangers_between_alike_texts_lose_no_link(spark, bucket):
    """Random fingerprints a few bits apart, some alike by their sketches and some strangers: the links are those of all pairs."""
    rng, nodes = random.Random(bucket), []
    for _ in range(12):
        centre, own = rng.getrandbits(64), [sketch(rng) for _ in range(3)]
        for _ in range(rng.randint(2, 40)):
            fp = centre
            for b in rng.sample(range(64), rng.randint(0, 6)):
                fp ^= 1 << b
            nodes.append((fp, sketch(rng, rng.choice(own), rng.choice([16, 12, 9]))))
    nodes += [(15, s := sketch(rng)), (240, s), (0, sketch(rng))]  # the third lies between the others, 8 bits apart
    df = spark.createDataFrame([(signed(fp), i, *longs(s)) for i, (fp, s) in enumerate(nodes)], "fp long, id long, s0 long, s1 long")
    want = {(j, i) for i, (p, s) in enumerate(nodes) for j, (q, t) in enumerate(nodes[:i]) if (p ^ q).bit_count() <= 8 and sum(x == y for x, y in zip(s, t)) >= simhash.AGREE}
    n = len(nodes)
    assert (n - 3, n - 2) in want
    got = closure(n, [(r["a"], r["b"]) for r in simhash.links(df, 8, bucket).collect()])
    assert want <= got and (bucket == 8 or got == closure(n, want))


def test_a_stranger_as_hub(spark, monkeypatch):
    """Three texts with set fingerprints: two that differ in one word of 100 lie 8 bits apart, a stranger 4 bits from both."""
    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, " ".join(f"x{i}" for i in range(100)))]
    set_to, read = {rows[0][1].encode(): 15, rows[1][1].encode(): 240, rows[2][1].encode(): 0}, simhash._read
    monkeypatch.setattr(simhash, "_read", lambda data, size, seed, sketched: (set_to[data], read(data, size, seed, sketched)[1]))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_sketches_agree_as_the_sets_do():
    rng = random.Random(2)
    for share in (0.5, 0.8, 0.95):
        agree = []
        for _ in range(150):
            words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
            n = round(300 * (1 - share) / (1 + share))
            one, two = (simhash._read(" ".join(w).encode(), 1, 42, True)[1] for w in (words, [*words[:-n], *(f"x{rng.randrange(10**6)}" for _ in range(n))]))
            agree.append((one == two).sum() / simhash.LANES)
        assert abs(np.mean(agree) - share) < 0.04


def test_recall_on_the_given_documents(spark):
    """Of the pairs of different texts of sf0.1 with a similarity of 0.8 or more, found by a prefix filter, at least 0.9."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r["text"], r["doc_id"])
    ids, sets = list(texts.values()), [set(simhash.shingles(t.encode()).tolist()) for t in texts]
    often = collections.Counter(g for s in sets for g in s)
    at, pairs = collections.defaultdict(list), set()
    for i, s in enumerate(sets):
        first = sorted(s, key=lambda g: (often[g], g))[: len(s) - -(-4 * len(s) // 5) + 1]
        pairs |= {(j, i) for g in first if often[g] > 1 for j in at[g] if 5 * len(sets[j] & s) >= 4 * len(sets[j] | s)}
        for g in first:
            at[g].append(i)
    group = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    found = sum(group[ids[i]] == group[ids[j]] for i, j in pairs)
    assert len(pairs) > 40 and found >= 0.9 * len(pairs)


def test_a_family_where_few_are_alike_to_the_first(spark, monkeypatch):
    """Families of several kinds of texts, so that most are not alike to the representative; blocks of few texts."""
    monkeypatch.setattr(simhash, "FAMILY", 7)
    rng, rows = random.Random(6), []
    for family in range(3):
        base = [rng.sample(range(10**6), 60) for _ in range(4)]
        for i in range(60):
            own = list(base[rng.randrange(4)])
            for k in rng.sample(range(60), rng.choice([0, 1, 3, 9])):
                own[k] = rng.randrange(10**6)
            rows.append((family, len(rows), sorted(set(own))))
    member = spark.createDataFrame(rows, "family long, text_hash long, g array<long>")
    got = closure(len(rows), [(r["a"], r["b"]) for r in simhash.family_links(member).collect()])
    sets = [set(g) for _, _, g in rows]
    want = [(j, i) for i, one in enumerate(sets) for j, two in enumerate(sets[:i]) if rows[i][0] == rows[j][0] and 5 * len(one & two) >= 4 * len(one | two)]
    assert got == closure(len(rows), want)


def test_the_filter_of_wanted_texts_and_the_way_beyond_it(spark, monkeypatch):
    rows = near_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    one = sorted(map(tuple, simhash.near_copies(docs).collect()))
    monkeypatch.setattr(simhash, "FILTER_BITS", 0)
    assert sorted(map(tuple, simhash.near_copies(docs).collect())) == one


def test_odd_rows_and_empty_table(spark):
    docs = frame(spark, odd_rows())
    got = simhash.without_copies(docs)
    rows = got.collect()
    assert got.columns == docs.columns and len({r["doc_id"] for r in rows}) == len(rows)
    assert {r["doc_id"] for r in rows} >= {100, 103, 105, 106} and not {r["doc_id"] for r in rows} & {101, 102, 104}
    assert simhash.without_copies(docs.limit(0)).count() == 0
