"""Operators on documents: brute force, edge cases and determinism."""

import collections
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer
import xxhash

from tarnwick.llm import licenses, mixing, packing, quality, simhash
from tarnwick.llm.common import components, ranked

TOKENS = public_tokenizers.path("byte_bpe_50k.json")
# Columns that the operators use within, all as extra columns here.
CLASHES = ["size", "row", "score", "fp", "rank", "place", "_hash", "_key", "_id", "_salt", "_sum", "k", "n", "data"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in CLASHES})


def odd_rows():
    rng = random.Random(7)
    vocabulary = ["alpha", "Beta", "gämma", "δ", "mit", "license", "the", "of"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, text(rng.randint(1, 60)), "en", f"s{i % 4}", 0) for i in range(40)]
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \t\n", "en", None, 3), (None, "lost words here now", None, "s1", None), (None, None, None, None, None)]
    rows += [(103, "same text here today", "en", "s1", 1), (103, "same text here today", "en", "s1", 1), (104, "same text here today", "en", "s2", 1)]
    rows += [(105, text(30_000), "en", "s3", 1), (106, "x" * 300_000, "en", "s3", 1)]
    return rows


def test_ranked_is_a_permutation_of_each_key(spark):
    df = spark.range(1000).select((F.col("id") % 3 == 0).cast("int").alias("k"), "id")
    got = collections.defaultdict(list)
    for r in ranked(df, ["k"], ["id"], salts=7).collect():
        got[r["k"]].append(r["rank"])
    assert {k: sorted(v) == list(range(len(v))) for k, v in got.items()} == {0: True, 1: True}


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    edges = spark.createDataFrame([*chain, *((5, i) for i in range(6, 30)), (-3, -2)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 5 for i in range(5, 30)} | {-3: -3, -2: -3}
    assert components(edges.limit(0)).count() == 0


# Mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        unit = (left - sum(cap * sizes[s] for s in full)) / max(sum(weight[s] for s in free), 1e-9)
        more = {s for s in free if unit * weight[s] > cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in full else unit * weight[s] for s in names}
        full |= more


def test_targets_share_the_excess(spark):
    for sizes in ({"b": 100, "a": 10, None: 1000, "c": 0}, {f"s{i}": i * i for i in range(40)}, {"é": 5, "z": 7, "Z": 9, None: 1}, {"one": 0}):
        rows = [("-" if s is None else f"+{s}", n) for s, n in sizes.items()]
        got = {None if r["skey"] == "-" else r["skey"][1:]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "skey string, source_size long")).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)


def brute_rates(sizes, target, cap=2.0):
    """Rates min(cap, exp(tilt * size)) of the documents that take target words, by bisection on the tilt."""
    low, high = -50.0, 50.0
    rate = lambda t: [min(cap, math.exp(min(t * s, 50))) for s in sizes]
    for _ in range(300):
        tilt = (low + high) / 2
        if sum(r * s for r, s in zip(rate(tilt), sizes)) < target:
            low = tilt
        else:
            high = tilt
    return rate(high)


def test_rates_are_those_of_the_dual(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.choice([1, 3, 10, 50, 400])), "en", f"s{i % 7}", 0) for i in range(300)]
    got = mixing.mix(frame(spark, rows)).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    targets = brute_targets({s: sum(r["size"] for r in rs) for s, rs in by.items()})
    assert any(len({r["rate"] for r in rs}) > 2 for rs in by.values())
    for s, rs in by.items():
        assert math.isclose(rs[0]["target"], targets[s], rel_tol=1e-9)
        assert all(math.isclose(r["rate"], want, rel_tol=1e-5) for r, want in zip(rs, brute_rates([r["size"] for r in rs], targets[s])))
        # Within half a shortest document, as there are many.
        assert abs(sum(r["taken"] for r in rs) - targets[s]) <= 1


def test_mix_of_odd_rows(spark):
    rows = odd_rows()
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter((d, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t, *_ in rows)
    taken, target, longest = collections.Counter(), {}, collections.Counter()
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 for s in target)
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda r: (str(r["doc_id"]), r["text_hash"], str(r["source"]), r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == collections.Counter(r["doc_id"] for r in got for _ in range(r["copies"]))
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0


def test_op1_query(spark):
    got = mixing.op1_mixing(spark, "/root/testdata/sf0.001").collect()
    taken, target, sizes, small = collections.Counter(), {}, collections.Counter(), collections.Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        sizes[r["source"]] += r["size"]
        target[r["source"]] = r["target"], r["source_size"]
        small[r["source"]] = max(small[r["source"]], r["size"])
    want = brute_targets(sizes)
    assert len(got) == 200 and all(math.isclose(target[s][0], want[s], rel_tol=1e-9) and target[s][1] == sizes[s] for s in want)
    assert all(abs(taken[s] - want[s]) <= small[s] / 2 for s in want)


# SimHash


def brute_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_groups(prints, radius=3):
    """The smallest position reachable from each position."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def test_fingerprints_of_odd_rows(spark):
    rows = odd_rows()
    docs = frame(spark, rows)
    got = simhash.near_groups(docs).collect()
    want = [brute_fingerprint(t) for _, t, *_ in rows]
    assert collections.Counter((r["doc_id"], r["fp"] % 2**64) for r in got) == collections.Counter((d, p) for (d, *_), p in zip(rows, want))
    groups = brute_groups(want)
    low = collections.defaultdict(list)
    for (d, *_), g in zip(rows, groups):
        low[g] += [d] if d is not None else []
    expected = collections.Counter((d, min(low[g], default=None)) for (d, *_), g in zip(rows, groups))
    assert collections.Counter((r["doc_id"], r["component_id"]) for r in got) == expected
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter(min(v, default=None) for v in low.values())
    assert simhash.near_groups(docs.limit(0)).count() == 0 and simhash.deduplicated(docs.limit(0)).count() == 0


def test_groups_without_any_id_keep_one_row(spark):
    kept = simhash.deduplicated(frame(spark, [(None, "one two three four", None, None, None)] * 2 + [(None, "other words are these", None, None, None)]))
    assert kept.count() == 2


@pytest.mark.parametrize("bucket", [8192, 6])
def test_links_of_dense_fingerprints(spark, bucket):
    rng = random.Random(bucket)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for c in centres for _ in range(60)} | {rng.getrandbits(64) for _ in range(200)}
    prints = sorted(prints)
    fps = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fp long")
    edges = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(fps.selectExpr("fp", "fp AS id"), bucket=bucket).collect()]
    at = {p: i for i, p in enumerate(prints)}
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(at[a]), find(at[b])))
        root[y] = x
    assert [find(i) for i in range(len(prints))] == brute_groups(prints)


def test_op2_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in simhash.op2_simhash(spark, "/root/testdata/sf0.001").collect()}
    ids = sorted(docs)
    prints = [brute_fingerprint(docs[i]) for i in ids]
    assert got.keys() == docs.keys() and [got[i]["fingerprint"] for i in ids] == [f"{p:016x}" for p in prints]
    assert [got[i]["component_id"] for i in ids] == [ids[g] for g in brute_groups(prints)]


@pytest.mark.parametrize("radius", [3, 8])
def test_forests_span_the_links(radius):
    rng = random.Random(radius)
    for _ in range(30):
        centres = [rng.getrandbits(64) for _ in range(3)]
        prints = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 12))) for c in centres for _ in range(rng.randint(1, 40))})
        a, b = (np.array(prints, np.uint64)[places] for places in simhash.forest(np.array(prints, np.uint64), radius))
        assert all((int(x) ^ int(y)).bit_count() <= radius and x != y for x, y in zip(a, b))
        at, root = {p: i for i, p in enumerate(prints)}, list(range(len(prints)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for x, y in zip(a, b):
            x, y = sorted((find(at[int(x)]), find(at[int(y)])))
            root[y] = x
        assert [find(i) for i in range(len(prints))] == brute_groups(prints, radius)


def test_thresholds_add_up():
    rng = np.random.default_rng(1)
    bits = (rng.random((4000, 64)) < rng.random(64)).astype(float)
    for n in (100, 10**6, 10**10):
        both = bits.T @ bits * (n / 4000)
        plan = simhash.allocate(both, n)
        used = [b for part, _ in plan for b in part]
        assert len(used) == len(set(used))
        # Parts left out count as thresholds of -1.
        assert any(sum(t for _, t in plan) - (m - len(plan)) == 3 - m + 1 for m in range(len(plan), 7))


# Packing


def exact_bins(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b + items[i] <= capacity}.values():
            bins[k] += items[i]
            go(i + 1, bins)
            bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_completion_is_optimal_on_small_instances():
    rng, better = random.Random(1), 0
    for trial in range(600):
        items = [rng.randint(1, 100) if trial % 2 else rng.randint(20, 60) for _ in range(rng.randint(0, 11))]
        counts = dict(collections.Counter(items))
        (plan, least, proven), got = packing.complete(counts, 100), collections.Counter()
        for pattern, n in plan:
            assert sum(x * k for x, k in pattern) <= 100
            for x, k in pattern:
                got[x] += k * n
        assert got == counts
        n = sum(n for _, n in plan)
        assert proven and least <= n == (exact_bins(items, 100) if items else 0)
        better += n < sum(n for _, n in packing.best_fit(counts, 100))
    assert better


@pytest.mark.parametrize("bins", [30, 66, 2000])
def test_completion_of_perfectly_filled_sequences(bins):
    """Sequences cut into three pieces each: the best solution is known."""
    for seed in range(3):
        rng, counts = random.Random(seed), collections.Counter()
        for _ in range(bins):
            a, b = sorted(rng.sample(range(1, 1024), 2))
            counts.update((a, b - a, 1024 - b))
        plan, got = packing.complete(dict(counts), 1024), collections.Counter()
        for pattern, n in plan.patterns:
            assert sum(x * k for x, k in pattern) <= 1024
            got.update({x: k * n for x, k in pattern})
        assert got == counts and plan.least == bins
        assert sum(n for _, n in plan.patterns) <= min(bins + 1, 1.005 * bins + 1)


def test_fillings_are_the_undominated_sets():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        room, waste = rng.randint(1, 60), rng.randint(0, 10)
        found, whole, _ = packing.fillings(counts, room, waste, 10_000, 100_000)
        sets = [{}]
        for x, n in counts.items():
            sets = [s | ({x: k} if k else {}) for s in sets for k in range(n + 1)]
        full = [s for s in sets if 0 <= room - sum(x * k for x, k in s.items()) <= waste and not any(counts[x] > s.get(x, 0) and x <= room - sum(y * k for y, k in s.items()) for x in counts)]
        assert whole and len(found) == len({tuple(sorted(f)) for f in found})
        assert all(dict(f) in full for f in found)
        if full:  # the fullest of all is never dominated by less
            best = min(room - sum(x * k for x, k in s.items()) for s in full)
            assert found and room - sum(x * k for x, k in found[0]) == best


def test_op6_query(spark):
    got = packing.op6_packing(spark, "/root/testdata/sf0.001").collect()
    used = collections.Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used[r["sequence_id"]]
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 1024 and len(used) <= -(-sum(used.values()) // 1024) + 1


def test_fast_encoder_gives_the_tokenizers_ids():
    encode, slow = packing.encoder(TOKENS), Tokenizer.from_file(TOKENS)
    for text in ["hello  world\n\n  x", "<|endoftext|>a <|endoftext|> b", "é ß 日本語 😀 don't  ", "", "   ", "x\x85y\u2028z", "a" * 5000, " \n" * 3000, "x" * 250_000]:
        assert encode(text) == slow.encode(text, add_special_tokens=False).ids


def test_packing_of_odd_rows(spark):
    rows = odd_rows()
    docs = frame(spark, rows)
    slow, want = Tokenizer.from_file(TOKENS), collections.Counter()
    for d, t, *_ in rows:
        ids = slow.encode(t or "", add_special_tokens=False).ids + [2]
        first, start = len(ids) % 1024 or 1024, 0
        for piece, stop in enumerate(range(first, len(ids) + 1, 1024)):
            want[d, piece, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())] += 1
            start = stop
    got = packing.pack(docs, TOKENS).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(sequences) == -(-sum(r["length"] for r in got) // 1024)
    assert packing.pack(docs.limit(0), TOKENS).count() == 0


# Licenses


def brute_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(i, label) for i in range(len(words)) for phrase, label in licenses.PHRASES.items() if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_license_scan_of_odd_rows(spark):
    texts = ["MIT License MIT license", "mit-license; the Apache License, and GNU General Public License", "permit licensed mit  license\nmit\nlicense", "Émit license", "GENERAL  PUBLIC\tLICENSE"]
    rows = odd_rows() + [(200 + i, t, None, None, None) for i, t in enumerate(texts)]
    got = licenses.license_scan(frame(spark, rows)).collect()
    fields = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    assert collections.Counter((r["doc_id"], *(r[f] for f in fields)) for r in got) == collections.Counter((d, *brute_scan(t)) for d, t, *_ in rows)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert licenses.license_scan(frame(spark, rows).limit(0)).count() == 0


def test_templates_take_exact_mandatory_wording():
    automata = {k: licenses.Automaton(t) for k, t in licenses.TEMPLATES.items()}
    phrases = {b" " + k.encode() + b" ": v for k, v in licenses.PHRASES.items()}
    scan = lambda t: licenses.scan(t.encode(), automata, phrases)
    for label, template in licenses.TEMPLATES.items():
        short = re.sub(r"<<beginOptional>>.*?<<endOptional>>", " ", template, flags=re.S)
        long = re.sub(r"<<(begin|end)Optional>>", " ", template)
        short, long = (re.sub(r"<<var;(\d+)-\d+>>", lambda m: "word " * int(m[1]), t) for t in (short, long))
        for text in (short, long):
            found = scan("Before it. " + text.upper() + " After it.")
            assert label in found[5].split(",") and found[6] == 1.0
            words = text.split()
            if text is short:
                broken = scan(" ".join([*words[:-1], "otherwise"]))
                assert label not in broken[5].split(",")
    a = licenses.Automaton("one two <<var;1-2>> three <<beginOptional>> four five <<endOptional>> six")
    w = lambda t: [x.encode() for x in t.split()]
    for text, ok in [("one two x three six", 1), ("one two x y three four five six", 1), ("one two three six", 0), ("one two x y z three six", 0), ("one two x three four six", 0), ("one two three three six", 1)]:
        assert (a.match(w(text), 0) == a.mandatory) == bool(ok), text


def brute_accepts(template, words):
    """Whether a stretch of words is what the markup allows, by a regular expression over words."""
    pattern, rest = "", template
    for part in re.split(r"(<<[^<>]*>>)", rest):
        if part == "<<beginOptional>>":
            pattern += "(?:"
        elif part == "<<endOptional>>":
            pattern += ")?"
        elif m := re.fullmatch(r"<<var;(\d+)-(\d+)>>", part):
            pattern += f"(?:[^ ]+ ){{{m[1]},{m[2]}}}"
        else:
            pattern += "".join(re.escape(w.decode()) + " " for w in licenses.words_of(part.encode()))
    return re.search("(?<![^ ])" + pattern, "".join(w.decode() + " " for w in words)) is not None


def test_templates_agree_with_a_regular_expression():
    automata = {k: licenses.Automaton(t) for k, t in licenses.TEMPLATES.items()}
    rng = random.Random(9)
    for label, template in licenses.TEMPLATES.items():
        for trial in range(4):
            text = re.sub(r"<<beginOptional>>(.*?)<<endOptional>>", lambda m: m[1] if rng.random() < 0.5 else " ", template, flags=re.S)
            text = re.sub(r"<<var;(\d+)-(\d+)>>", lambda m: " word" * rng.randint(int(m[1]), int(m[2])) + " ", text)
            words = licenses.words_of(f"before {text} after".encode())
            if trial % 2:
                words[rng.randrange(1, len(words) - 1)] = b"altered"
            found = licenses.scan(b" ".join(words), automata, {})
            assert (label in found[5].split(",")) == brute_accepts(template, words), (label, trial)


def test_altered_disclaimers_are_rejected():
    automata = {k: licenses.Automaton(t) for k, t in licenses.TEMPLATES.items()}
    isc = re.sub("<<var;1-15>>", "THE AUTHOR", re.sub(r"<<beginOptional>>.*?<<endOptional>>", "", licenses.TEMPLATES["isc"]))
    assert licenses.scan(isc.encode(), automata, {})[5:] == ("isc", 1.0)
    for altered in (isc.replace("DISCLAIMS", "GIVES"), isc[: isc.index("THE SOFTWARE IS")] + "THE SOFTWARE IS SOLD TO YOU FOR MONEY AND MAY NOT BE SHARED", isc.replace("NO EVENT", "ANY EVENT")):
        found = licenses.scan(altered.encode(), automata, {})
        assert found[5] == "" and found[6] < 1


def test_texts_that_come_with_spark_are_known():
    """License files as their authors wrote them."""
    import pyspark

    automata = {k: licenses.Automaton(t) for k, t in licenses.TEMPLATES.items()}
    folder = os.path.join(os.path.dirname(pyspark.__file__), "licenses")
    want = {"LICENSE-bootstrap.txt": "mit", "LICENSE-CC0.txt": "cc0-1.0", "LICENSE-cloudpickle.txt": "bsd-3-clause", "LICENSE-d3.min.js.txt": "isc"}
    for name in sorted(set(want) & set(os.listdir(folder) if os.path.isdir(folder) else ())):
        with open(os.path.join(folder, name), "rb") as f:
            assert want[name] in licenses.scan(f.read(), automata, {})[5].split(",")


def test_op7_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in licenses.op7_licenses(spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == docs.keys()
    for k, text in docs.items():
        r = got[k]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_scan(text)
        words = licenses.words_of((text or "").encode())
        own = {label for label, t in licenses.TEMPLATES.items() if brute_accepts(t, words)}
        assert set(r["labels"].split(",")) - {""} == own | (set(r["base_labels"].split(",")) - {""})


def test_anchors_repeated_in_a_very_long_text():
    automata = {k: licenses.Automaton(t) for k, t in licenses.TEMPLATES.items()}
    phrases = {b" " + k.encode() + b" ": v for k, v in licenses.PHRASES.items()}
    n = 100_000
    found = licenses.scan(b"filler " + b"licensed under the apache license mit license " * n, automata, phrases)
    assert found[:6] == (1 + 7 * n, 2 * n, 4, 7 * n - 1, "apache,mit", "apache,mit")


# Quality


def test_quality_learns_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.98  # by the difference alone
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.99


def brute_score(model, text):
    import zstandard

    data, sizes = (text or "").encode(), []
    for name in ("good", "bad"):
        d = zstandard.ZstdCompressionDict(model[name])
        d.precompute_compress(level=quality.LEVEL)
        c = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False)
        sizes.append(sum(len(c.compress(data[i : i + quality.BLOCK])) for i in range(0, len(data), quality.BLOCK)))
    x = (sizes[1] - sizes[0]) / len(data) if data else 0.0
    return 1 / (1 + math.exp(-(model["weights"][0] + model["weights"][1] * x)))


def test_scores_against_a_plain_rescore(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality.op10_quality(spark, "/root/testdata/sf0.01").collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert math.isclose(got[r["doc_id"]]["score"], brute_score(model, r["text"]), rel_tol=1e-9)


def test_fit_is_bounded_and_the_same_however_rows_lie(spark):
    """Each document 50 times, and two texts under each id, in 1, 3 and 7 partitions."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    other = docs.withColumn("text", F.concat("text", F.lit(" and more")))
    many = docs.union(other).withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(50)))).drop("again")
    models = [quality.fit(many.repartition(n), labels.union(labels), sample=20) for n in (1, 3, 7)]
    assert len({(m["good"], m["bad"], m["weights"]) for m in models}) == 1 and models[0]["good"]
    text = bytes(range(256)) * 40
    assert b"".join(quality.blocks_of(text, 100)) == text and len(quality.blocks_of(text, 7)) == 7


def test_conflicting_labels_count_as_bad(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * 30) for i in range(60)], "doc_id long, text string")
    one = [(i, int(i % 2)) for i in range(60)]
    twice = [*one, *((i, 1) for i, y in one if not y)]
    a, b = (quality.fit(docs, spark.createDataFrame(rows, "doc_id long, quality int")) for rows in (one, twice))
    assert a == b


def test_quality_of_odd_rows(spark):
    rows = odd_rows()
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality(docs, labels).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(d for d, *_ in rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    assert quality.quality(docs, labels.limit(0)).filter("score != 0.5").count() == 0
    assert quality.quality(docs.limit(0), labels).count() == 0
    assert quality.accepted(docs, labels).columns == docs.columns
