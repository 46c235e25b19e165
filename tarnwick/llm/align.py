"""Alignment of two tokenizers' tokens over the same bytes.

Python only tokenises.  Texts are cut before white space into stretches over
whose start neither tokenizer has a token, and the distinct stretches of a block
of texts are tokenised, and aligned, once.  What follows is Spark's array and
higher-order functions on a row for each block.  array_intersect of the two end
arrays gives the groups: the shortest stretches that both tokenizers cut alike.
Both sides' ends, each a long of (end, side, number of the token), are sorted
together; an end's place less its own number is how many tokens of the other
side end before it, and so which token of the other side it falls into.  One
transform over the sorted ends thus yields every link.  The groups and links of
a text are then those of its stretches, one after the other.
"""

from __future__ import annotations

import itertools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tarnwick.operators.skew import salted_join

from .common import spread, table, written

#: Texts tokenised at a time, and about how many bytes of them: bounds a worker's memory.
TEXTS, TEXT_BYTES = 512, 2 << 20
#: Characters of stretches that are tokenised in one call.
RUN = 1 << 14
#: A stretch: its white space, and all up to the next.  Neither tokenizer has a token over its start.
STRETCH = re.compile(r"[ \n]+[^ \n]*")
#: Longest text in characters that the fast splitter takes.
FAST = 200_000
#: Most id pairs that are sent to all executors, some 50 MB there; more are joined by a shuffle.
PAIRS = 1 << 20
#: Parts of a long that holds an end, a side and the number of a token, or an end and an id; the marks of a stretch's end (_LOW) and a group's.
_SIDE, _NUMBER, _LOW = 1 << 31, (1 << 31) - 1, (1 << 32) - 1
_GROUP = _LOW - 1


class ByteTokens:
    """Ids and token lengths in bytes of a byte-level BPE file of `tokenizers`; strings of special tokens are plain text."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = {i: t for t, i in ranks.items()}
        self.lengths = np.zeros(max(self.bytes) + 1, np.int64)
        for i, t in self.bytes.items():
            self.lengths[i] = len(t)

    def __call__(self, texts: list[str]) -> list[list[int]]:
        encode = lambda t: self.slow.encode(t, add_special_tokens=False).ids if len(t) > FAST else self.fast.encode_ordinary(t)
        return [encode(t) for t in texts]


class PieceTokens:
    """The same of a sentencepiece model, without the space that it puts before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.lead = self.model.encode("\n")  # its space and this, which no piece goes over
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces) or any("\n" in p for p in pieces):
            raise ValueError("a piece goes over the start of a stretch")
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lengths = np.array([len(b) for b in self.bytes])

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [ids[len(self.lead) :] for ids in self.model.encode(["\n" + t for t in texts], num_threads=1)]


class Numbers(dict):
    """Numbers stretches in the order in which they are first asked for."""

    def __missing__(self, stretch: str) -> int:
        self[stretch] = n = len(self)
        return n


def _blocks(batches):
    """doc_ids and texts of at most TEXTS rows and about TEXT_BYTES bytes, over the ends of batches."""
    ids, texts, size = [], [], 0
    for batch in batches:
        at = 0
        for i, t in enumerate(batch.column(1).to_pylist()):
            if texts and (len(texts) == TEXTS or size + len(t or "") > TEXT_BYTES):
                yield pa.concat_arrays([*ids, batch.column(0).slice(at, i - at)]), texts
                ids, texts, size, at = [], [], 0, i
            texts.append(t or "")
            size += len(t or "")
        ids.append(batch.column(0).slice(at))
    if texts:
        yield pa.concat_arrays(ids), texts


def _runs(stretches: list[str], spaced: list[int]) -> list[list[str]]:
    """The stretches in order, those that may follow each other in one text together, of about RUN characters; after those numbered in `spaced`, which end in white space, a text ends."""
    part = np.cumsum(np.fromiter(map(len, stretches), np.int64, len(stretches))) // RUN
    cuts = sorted({0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), *(i + 1 for i in spaced), len(stretches)})
    return [stretches[lo:hi] for lo, hi in itertools.pairwise(cuts)]


def _encoded(sides: tuple, stretches: list[str], spaced: list[int]):
    """For each side ids, and how many of them each stretch has; with them, whether both sides give it back byte by byte (else it has none)."""
    ids, counts, ok = ([], []), ([], []), []
    work = _runs(stretches, spaced)[::-1]
    while work:
        run = work.pop()
        raw, ends = "".join(run).encode(), np.cumsum(list(map(len, map(str.encode, run))))
        found = [side(["".join(run)])[0] for side in sides]
        good = all(b"".join(map(side.bytes.__getitem__, x)) == raw for side, x in zip(sides, found, strict=True))
        if not good and len(run) > 1:
            work += [[s] for s in reversed(run)]
            continue
        ok += [good] * len(run)
        for k, side in enumerate(sides):
            x = np.array(found[k] if good else (), np.int64)
            ids[k].append(x)
            counts[k].append(np.diff(np.searchsorted(np.cumsum(side.lengths[x]), ends, "right"), prepend=0))
    return [np.concatenate(x) for x in ids], [np.concatenate(x) for x in counts], ok


def _stretched(sides: tuple, texts: list[str]):
    """Numbers of each text's stretches, and what _encoded() gives for these."""
    whole = [" " + t if t else "" for t in texts]
    cut = [STRETCH.findall(t) for t in whole]
    while True:
        of = Numbers()
        numbers = [list(map(of.__getitem__, c)) for c in cut]
        stretches = list(of)
        spaced = [i for i, s in enumerate(stretches) if s[-1].isspace()]
        ids, counts, ok = _encoded(sides, stretches, spaced) if stretches else ([np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int64)] * 2, [])
        bad = {i for i, good in enumerate(ok) if not good}
        # Other white space before a stretch may belong to its own: the text is one stretch then.  It is so
        # too where a tokenizer does not give a stretch back, and is left empty if it does not give the text.
        late = {i for i in spaced if stretches[i][-1] not in " \n"}
        again = [k for k, n in enumerate(numbers) if bad and not bad.isdisjoint(n) or late and not late.isdisjoint(n[:-1])]
        if not again:
            return numbers, ids, counts
        for k in again:
            cut[k] = [whole[k]] if len(cut[k]) > 1 else []


def _tokenise(a_path: str, b_path: str):
    def run(batches):
        sides = ByteTokens(a_path), PieceTokens(b_path)
        for doc_ids, texts in _blocks(batches):
            numbers, ids, counts = _stretched(sides, texts)
            ends = [np.cumsum(side.lengths[x]) << 32 for side, x in zip(sides, ids, strict=True)]
            flat = np.fromiter(itertools.chain.from_iterable(numbers), np.int32)
            at = np.cumsum([0, *map(len, numbers)])
            totals = [np.diff(np.concatenate(([0], np.cumsum(c[flat])))[at]) for c in counts]
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))
            docs = pa.StructArray.from_arrays([doc_ids, *map(pa.array, totals), lists], ["doc_id", "n_a", "n_b", "stretches"])
            sizes = counts[0] + counts[1]
            columns = {"docs": docs, "last": ends[0][np.cumsum(counts[0]) - 1] | _LOW, "firsts": (np.cumsum(sizes) - sizes + 1).astype(np.int32), "sizes": sizes.astype(np.int32)}
            for n, x, e, side in zip("ab", ids, ends, (0, _SIDE), strict=True):
                columns |= {n: x, f"{n}_tokens": e | x, f"{n}_ends": e | _GROUP, f"{n}_numbers": e | (side + np.arange(len(e)))}
            one = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if x is docs else pa.array(x)) for x in columns.values()]
            yield pa.RecordBatch.from_arrays(one, list(columns))

    return run


def tokens(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each block of texts: docs(doc_id, n_a, n_b, numbers of its stretches); and of the block's distinct stretches, one after the
    other, both tokenizers' ids and tokens' byte ends (times 2^32) with the id, with _GROUP, and with side and number; each stretch's last end, and its part of all ends in order."""
    many = lambda of: T.ArrayType(of, False)
    doc = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, T.LongType(), False) for n in ("n_a", "n_b")), T.StructField("stretches", many(T.IntegerType()), False)])
    field = lambda n, of: T.StructField(n, many(of), False)
    longs = [field(n + x, T.LongType()) for n in "ab" for x in ("", "_tokens", "_ends", "_numbers")]
    schema = T.StructType([field("docs", doc), field("last", T.LongType()), field("firsts", T.IntegerType()), field("sizes", T.IntegerType()), *longs])
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_tokenise(a_path, b_path), schema)


def _links(a: Column, b: Column, ends: Column) -> Column:
    """Of all ends in order: the pair of a token of a and one of b that is found there, the id of a times 2^32 and that of b; -1 where both end and a has given it."""
    number = lambda v: v.bitwiseAND(F.lit(_NUMBER)).cast("int")
    pair = lambda i, j: F.shiftleft(F.get(a, i), 32).bitwiseOR(F.get(b, j))

    def one(v: Column, k: Column) -> Column:
        # Where both end, a comes first, and has given the link already.
        of_b = F.when(v - F.get(ends, k - 1) <= _LOW, None).otherwise(pair(k - number(v), number(v)))
        return F.coalesce(F.when(v.bitwiseAND(F.lit(_SIDE)) == 0, pair(number(v), k - number(v))).otherwise(of_b), F.lit(-1).cast("long"))

    return F.transform(ends, one)


def _groups(marked: Column) -> Column:
    """The ids of a side as text, one string for each group; "." follows the last of a stretch where that is marked too.  What follows the last mark is one more string."""
    row = F.when(F.size(marked) > 0, F.transform(marked, lambda x: x.bitwiseAND(F.lit(_LOW))))
    text = F.array_join(row.cast("array<string>"), ",")
    for old, new in ((f",{_GROUP},{_LOW}", ".;"), (f",{_GROUP}", ";"), (";,", ";")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.split(text, ";")


def _aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, text (the groups, `a1,a2|b1;a3|b2`), links."""
    c = F.col
    t = tokens(docs, a_path, b_path).withColumn("common", F.array_intersect("a_ends", "b_ends"))
    # What stands within a higher-order function is not compiled, and computed for each element if it is
    # not a column.  Spark keeps a column from being copied into where it is used if that is more than once.
    t = t.select(
        "docs", "a", "b", "firsts", "sizes",
        F.sort_array(F.concat("a_numbers", "b_numbers")).alias("ends"),
        F.sort_array(F.concat("a_tokens", "common")).alias("of_a"),
        F.sort_array(F.concat("b_tokens", "common", "last")).alias("of_b"),
    )
    joined = F.array_join(F.zip_with(_groups(c("of_a")), _groups(c("of_b")), lambda x, y: F.concat(x, F.lit("|"), y)), ";")
    t = t.select("docs", "firsts", "sizes", F.split(joined, r"\.;").alias("texts"), _links(c("a"), c("b"), c("ends")).alias("links"))  # the last text, after the last mark, belongs to no stretch
    cut = F.zip_with("firsts", "sizes", lambda at, n: F.slice("links", at, n))
    t = t.select("docs", "texts", F.when(F.size("links") > 0, cut).alias("links"))
    of = lambda d, x: F.transform(d["stretches"], lambda n: F.get(c(x), n)).alias(x)
    t = t.select(F.inline(F.transform("docs", lambda d: F.struct(*(d[n].alias(n) for n in ("doc_id", "n_a", "n_b")), of(d, "texts"), of(d, "links")))))
    return t.select("doc_id", "n_a", "n_b", F.array_join("texts", ";").alias("text"), F.array_remove(F.flatten("links"), F.lit(-1).cast("long")).alias("links"))


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, groups, links of every row of docs(doc_id, text, ...).

    groups: a string for each shortest stretch that both tokenizers cut alike,
    `a1,a2|b1`, in order.  links: the pairs of ids of overlapping tokens, once
    each time, in the order of the bytes, as a * 2^32 + b.
    """
    groups = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", ";"))
    return _aligned(docs, a_path, b_path).select("doc_id", "n_a", "n_b", groups.alias("groups"), "links")


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, count (rows of links(links) that hold it), best (whether no pair of its a has a higher count)."""
    counts = links.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    # A window holds at most as many rows as the other vocabulary has ids.
    top = F.max("count").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counts.withColumn("best", F.col("count") == top)


def alignment(docs: DataFrame, a_path: str, b_path: str, pairs: int = PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs(doc_id, text, ...).

    n_best: links whose pair of ids no other pair of the same a exceeds in the
    number of rows that hold it; count_sum: these numbers, summed over the links.
    Null and empty texts, and those that a tokenizer does not give back byte by
    byte (it normalises them), have no tokens: zeros and an empty digest.  Very
    long texts are tokenised whole and stay in one row.  Repeated rows, and rows
    without a doc_id, count and are returned like any other; other columns are
    not read; an empty table gives no rows.  Counts of at most `pairs` pairs are
    sent to all executors; more are joined by a shuffle, hot pairs salted.
    """
    a = _aligned(spread(docs.select("doc_id", "text")), a_path, b_path)
    n_links = F.size("links").cast("long")
    n_groups = F.col("n_a") + F.col("n_b") - n_links  # a group of p and q tokens has p + q - 1 links
    sha = F.when(F.col("text") == "", "").otherwise(F.sha2("text", 256))
    rows = a.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", n_groups.alias("n_groups"), n_links.alias("n_links"), sha.alias("groups_sha256"), "links")
    rows = written(rows, "align-rows")
    counts = written(pair_counts(rows), "align-pairs")
    each = rows.select("row", F.explode("links").alias("pair"))
    each = each.join(F.broadcast(counts), "pair") if counts.count() <= pairs else salted_join(each, counts, ["pair"])
    sums = each.groupBy("row").agg(F.count_if("best").alias("n_best"), F.sum("count").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.drop("links").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op13_align(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
