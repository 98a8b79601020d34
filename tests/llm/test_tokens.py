"""Byte BPE against tiktoken, packing against the tokenizer and its invariants."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from flockwise.llm import bpe, packing

HARD = [
    "", None, " ", "  a  b ", "\n\n x", "it's we'll I'D", "tab\tand\x0bvt\x0c", "naïve Ünïcode ß µ ÿ", "日本語 テキスト", "é combining", "x y z", "a\x1cb\x85c",
    "\x00 nul \x00", "١٢٣ ½ ²", "<|endoftext|> is text", "🙂👍🏽 ok", "A" * 5000, "ab " * 3000, "  lead\r\n", "İstanbul ΣΑΣ ς", "...!!! ??--", "3.14e10 v2.0",
]


@pytest.fixture(scope="module")
def oracle():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken_and_round_trips(documents, oracle):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(3, "repeated id"), (None, "null id")]
    docs = documents(rows).withColumn("ids", documents([(0, "x")]).limit(1).select("text").first()[0] and __import__("pyspark").sql.functions.lit(1))
    got = bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(got) == len(rows)
    want = sorted((i if i is not None else -1, hashlib.sha256(np.array(oracle.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest()) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.ids_sha256) for r in got) == want
    text = sorted((i if i is not None else -1, (t or "").encode()) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, bytes(r.decoded)) for r in got) == text


def test_every_character_splits_as_in_tiktoken(oracle):
    """Python's and the reference's character classes agree wherever both know the character."""
    model = bpe.byte_bpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    texts = [f"a{c}b {c} 1{c}\n{c}" for c in map(chr, [*range(1, 0x3100), *range(0xA000, 0xA100), *range(0xFF00, 0xFFFE)])]
    out = [None] * len(texts)
    for rows, ids, ends in model.encode(pa.array(texts)):
        for r, a, b in zip(rows, ends[:-1], ends[1:], strict=True):
            out[r] = ids[a:b].tolist()
    wrong = [t for t, o in zip(texts, out, strict=True) if o != oracle.encode_ordinary(t)]
    assert not wrong, [hex(ord(t[1])) for t in wrong[:20]]


def test_packing_covers_all_tokens_without_padding(documents):
    rng = random.Random(3)
    words = ["alpha", "Beta,", "gamma-ray", "it's", "Ünï", "42", "日本"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 30, 30, 200, 900])))) for i in range(150)]
    rows += [(i + 200, t) for i, t in enumerate(HARD)] + [(7, "same id"), (None, "no id"), (500, "word " * 5000)]
    got = packing.pack(documents(rows), P.path("word_bpe_49k.json"), window=512).collect()
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = sorted(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for _, t in rows)
    sequences, whole = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        sequences[r.sequence_id].append(r)
        if r.doc_id not in (7, None):
            whole[r.doc_id].append(r)
    for rs in whole.values():
        rs.sort(key=lambda r: r.start)
        assert [r.start for r in rs] == [sum(x.length for x in rs[:i]) for i in range(len(rs))]
        assert sum(r.length for r in rs) == rs[0].doc_tokens
    joined = [b"".join(bytes(r.ids) for r in rs) for rs in whole.values()]
    assert not set(joined) - set(want) and sum(r.length for r in got) == sum(map(len, want)) // 4
    for rs in sequences.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == [sum(x.length for x in rs[:i]) for i in range(len(rs))]
        total = sum(r.length for r in rs)
        assert total == 512 or total & (total - 1) == 0 and total < 512
    assert packing.pack(documents([]), P.path("word_bpe_49k.json")).count() == 0


def test_least_squares_meets_an_exact_histogram():
    counts = {100: 30, 156: 30, 56: 20, 200: 20}
    columns = packing.combinations(counts, 256)
    x = packing.nnls(columns, counts)
    left = dict(counts)
    for c, k in zip(columns, x, strict=True):
        for a in c:
            left[a] -= k
    assert max(map(abs, left.values())) < 0.1 and (x >= 0).all()
