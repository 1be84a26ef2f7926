"""The BPE columns against the library whose ids they must give."""

import base64
import hashlib
import random
import struct

import pytest
import tiktoken
from public_tokenizers import PATTERN, path
from pyspark.sql import functions as F

from plumbline.llm import bpe


def library(ranks=None):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks or bpe.INSTALLED.load()[0], special_tokens={})


def want(encoding, text):
    ids = encoding.encode_ordinary(text or "")
    return {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), "decoded_sha256": hashlib.sha256((text or "").encode()).hexdigest()}


def check(df, **more):
    encoding, texts = library(), {r.doc_id: r.text for r in df.collect()}
    got = bpe.digest(df, **more).collect()
    assert len(got) == df.count()
    for r in got:
        r = r.asDict()
        assert r == {"doc_id": r["doc_id"], **want(encoding, texts[r["doc_id"]])}, repr(texts[r["doc_id"]])[:80]


def test_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


@pytest.mark.parametrize("limit", [bpe.DICTIONARY, 3, 0])
def test_awkward_rows(spark, limit):
    """Nulls, empty and very long texts and words, all sorts of characters, ties, repeated rows, clashing and dotted columns."""
    rng = random.Random(11)
    letters = "abcdefgh"
    texts = [None, "", " ", "\n", "  \n\n  x  ", "it's we'll 's ''s I'd've !'s", "a b  c\u0085d ", "!", "!!!!", "<|endoftext|>", "\x00 a\x00b", "ࢗᲉ \U000105c0x \U0001ccf0", "naïve café Ünïcödé 日本語 текст ١٢٣ Ⅷ½ 🙂🙂"]
    texts += ["é" * 100_000, "a" * 5000, "ab" * 2500 + "c", "".join(rng.choice(letters) for _ in range(3000)), "word " * 20_000, " " * 1000 + "x", "\n" * 1000]
    texts += ["".join(rng.choice("ab' \n!1é 日sก́") for _ in range(200)) for _ in range(150)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(128, 0x3000), rng.randrange(0x10000, 0x20000)])) for _ in range(100)) for _ in range(100)]
    rows = [(k, t, t, 1, "x") for k, t in enumerate(texts)]
    kind = "doc_id long, text string, tokens string, n_tokens int, `a.b` string"
    check(spark.createDataFrame(rows, kind), limit=limit)
    if limit == 3:
        again = [(None, "Twice the same.", "", 1, "")] * 2
        assert {tuple(r)[1:] for r in bpe.digest(spark.createDataFrame(again, kind), limit=limit).collect()} == {tuple(want(library(), "Twice the same.").values())}
        assert bpe.digest(spark.createDataFrame([], kind)).collect() == []


def test_sampling_the_dictionary_changes_nothing(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(map(tuple, bpe.digest(df, sample_bytes=20_000).collect())) == sorted(map(tuple, bpe.digest(df, limit=0).collect()))


def test_ids_and_another_vocabulary(spark, tmp_path):
    """Ranks that don't rise with what they're made of, id 0 in use, and merges that several splits can make."""
    pieces = [b"aaa", b"ab", *(bytes([b]) for b in range(256)), b"aa", b"ba", b"bab", b"aaaa", b" a", b"abab"]
    rank_file = tmp_path / "own.tiktoken"
    rank_file.write_bytes(b"\n".join(base64.b64encode(p) + b" " + str(k).encode() for k, p in enumerate(pieces)))
    own = bpe.Vocabulary(path=str(rank_file), pattern=PATTERN)
    rng = random.Random(4)
    texts = ["".join(rng.choice("aab ") for _ in range(n)) for n in [*range(40), 200, 300] for _ in range(3)] + ["a" * 333]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoding = library({p: k for k, p in enumerate(pieces)})
    tokens, codec = bpe.encoded(df, own)
    for r in tokens.select("doc_id", codec.ids(codec.each(F.col("tokens"))).alias("ids"), codec.decode(codec.each(F.col("tokens"))).alias("bytes")).collect():
        assert r.ids == encoding.encode_ordinary(texts[r.doc_id]), texts[r.doc_id]
        assert bytes(r["bytes"]).decode() == texts[r.doc_id]


def test_vocabularies_that_cannot_be(tmp_path):
    bad = tmp_path / "bad.tiktoken"
    bad.write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError, match="no rank for 255"):
        bpe.Vocabulary(path=str(bad), pattern=PATTERN).load()
    assert path("byte_bpe_50k.tiktoken")


def test_a_join_looks_up_the_pairs_beside_it_only(spark):
    """What the other pairs of a word make is carried on from merge to merge, here shown by a rank that no pair has."""
    ranks, far = bpe.INSTALLED.load()[0], chr(bpe.IDS - 1)
    t, h, e, x, th = (chr(ranks[p]) for p in (b"t", b"h", b"e", b"x", b"th"))
    before = (bpe.END + t + h + e + x + bpe.END, bpe.NONE + th + far + far + bpe.NONE)
    state = spark.createDataFrame([before], "s string, made string").select(bpe.Codec(spark)._next(F.array("s", "made")).alias("state")).first().state
    assert state == [bpe.END + th + e + x + bpe.END, bpe.NONE + chr(ranks[b"the"]) + far + bpe.NONE]
