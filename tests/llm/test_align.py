"""Alignment of two tokenizers against brute force over all pairs of tokens."""

import collections
import hashlib

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tarnwick.llm import align
from tests.llm.test_documents import frame, odd_rows

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_of():
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}


class Brute:
    def __init__(self):
        self.a, self.b, self.bytes = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_of()
        self.a.encode_special_tokens = True

    def spans(self, text):
        """(id, first byte, end) of every token of both sides; none unless both give back the space and the text."""
        if not text:
            return [], []
        want, sides = b" " + text.encode(), []
        one = self.a.encode(" " + text, add_special_tokens=False)
        ids = self.b.encode(text)
        pieces = [self.b.id_to_piece(i) for i in ids]
        for side in ([(i, bytes(self.bytes[c] for c in t)) for i, t in zip(one.ids, one.tokens)], [(i, bytes([int(p[1:-1], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()) for i, p in zip(ids, pieces)]):
            at, found = 0, []
            for i, b in side:
                found.append((i, at, at + len(b)))
                at += len(b)
            if b"".join(b for _, b in side) != want:
                return [], []
            sides.append(found)
        return sides


def brute(texts):
    spans = [Brute.spans(BRUTE, t) for t in texts]
    links, counts = [], collections.Counter()
    for a, b in spans:
        # Tokens tile the same bytes, so those that overlap one are a run; no pair is left out.
        found, start = [], 0
        for i, lo, hi in a:
            while start < len(b) and b[start][2] <= lo:
                start += 1
            at = start
            while at < len(b) and b[at][1] < hi:
                found.append((i, b[at][0]))
                at += 1
        links.append(found)
        counts.update(set(found))
    best = collections.defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    out = []
    for (a, b), found in zip(spans, links):
        ends, groups = sorted({e for _, _, e in a} & {e for _, _, e in b}), []
        at = [0, 0]
        for e in ends:
            sides = []
            for k, s in enumerate((a, b)):
                first = at[k]
                while at[k] < len(s) and s[at[k]][2] <= e:
                    at[k] += 1
                sides.append(",".join(str(x[0]) for x in s[first : at[k]]))
            groups.append("|".join(sides))
        text = ";".join(groups)
        out.append((len(a), len(b), len(groups), len(found), sum(counts[x] == best[x[0]] for x in found), sum(counts[x] for x in found), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


BRUTE = Brute()
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["<|endoftext|> and <s> here", "a▁b", "two  spaces", " lead", "tail ", "\ttab\nline", "日本語のテキスト", "👩‍👩‍👧 family", "ﬁ ligature", "é", "x" * 5000, "\x00\x01", " ", "aaaaabaaab" * 300, "don't we'll <0x41>"]


def compared(df, rows):
    got = collections.Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in df.collect())
    assert got == collections.Counter((k, *x) for (k, _), x in zip(rows, brute([t for _, t in rows])))
    return got


def test_op13_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    df = align.op13_align(spark, "/root/testdata/sf0.001")
    got = compared(df, rows)
    assert df.columns == ["doc_id", *COLUMNS] and all(t == "bigint" for c, t in df.dtypes if c != "groups_sha256")
    assert sum(r[4] for r in got) > sum(r[3] for r in got)  # groups of several tokens do occur


@pytest.mark.parametrize("pairs", [align.PAIRS, 0])
def test_odd_rows_with_broadcast_and_shuffled_counts(spark, pairs):
    rows = [r[:2] for r in odd_rows()] + [(200 + i, t) for i, t in enumerate(ODD)] + [(300, ODD[0]), (300, ODD[0])]
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in rows]).repartition(3)
    got = compared(align.alignment(docs, A, B, pairs), rows)
    assert any(r[1] == 0 and r[0] == 201 for r in got)  # a text that the second tokenizer changes
    assert align.alignment(docs.limit(0), A, B, pairs).count() == 0


def test_links_lists_and_texts_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(align, "TEXT_BYTES", 1000)
    monkeypatch.setattr(align, "FAST", 2000)
    texts = ["word " * 900, "short", "", "ab " * 3000, "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in align.aligned(docs, A, B).collect():
        a, b = BRUTE.spans(texts[r["doc_id"]])
        want = [(i, j) for i, lo, hi in a for j, start, end in b if start < hi and end > lo]
        assert [(x >> 32, x & 0xFFFFFFFF) for x in r["links"]] == want
        assert ",".join(g.split("|")[0] for g in r["groups"]) == ",".join(str(x[0]) for x in a)


def test_each_stretch_of_a_block_is_tokenised_once(spark):
    rows = [(i, "alpha beta\nalpha beta") for i in range(50)]
    docs = frame(spark, [(i, t, "en", "s", 0) for i, t in rows]).coalesce(1)
    (block,) = align.tokens(docs, A, B).collect()
    a, b = BRUTE.spans("alpha beta\nalpha")
    assert len(block["docs"]) == 50 and len(block["sizes"]) == 3  # " alpha", " beta", "\nalpha"
    assert (block["a"], block["b"]) == ([x[0] for x in a], [x[0] for x in b])
    compared(align.alignment(docs, A, B), rows)


def test_white_space_at_the_start_of_stretches(spark):
    texts = ["x\t  y", "x\t\n  y z", "x\n\ny", "x \t\n y", "x\n", "x \n \n", "\n\n", "a   b c", "!\x1c !", "a▁ b", "a ▁b c", "a　 b", "x \n\ny", "it 's\n't", "q ́w \ń", "x\r\n\r\ny", "  lead\n  in"]
    rows = list(enumerate(texts * 2))
    compared(align.alignment(frame(spark, [(i, t, "en", "s", 0) for i, t in rows]).coalesce(2), A, B), rows)
