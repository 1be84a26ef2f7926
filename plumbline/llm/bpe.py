"""Byte-level BPE, encoding and decoding, in Spark's higher-order functions.

A text is cut into words by the vocabulary's pattern.  A word is an array of byte
tokens on which ranked merges are folded: the adjacent pair of least rank is
joined, the leftmost first, until no pair has a rank.  A token is one character
whose code point is its id, so the tokens of a word or a text are a string.  The
ranks come as a literal map from pairs to what they make; as Spark's map lookup
reads all keys, it is dealt into small maps by a hash of the pair.  A text's
tokens are its words', one after the other; decoding puts the byte pieces of the
tokens together.

Distinct words that are frequent in a bounded sample of the texts are folded
once and looked up.  That saves time and decides nothing: any other word is
folded where it stands.  Only the sample's words are shuffled, texts never.

Defined results: a null text is empty and has no ids; texts and words of any
length are encoded whole; rows are treated one by one, so ties and repeated rows
make no difference; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, text_bytes

#: Frequent words that are looked up, at most; about 60 bytes each go to every executor.
DICTIONARY = 1 << 19
#: Bytes of the texts, about, in which frequent words are looked for.
SAMPLE_BYTES = 256 << 20
#: Small maps into which the rank map and the dictionary are dealt.
BUCKETS = 1 << 18
#: Bins of the logarithm of a word's count, by which the most frequent words are found.
BINS = 16
#: Bytes from which a word is long: all places of a pair are then joined in one round where that is the same, and rounds end when no pair is left.
LONG, ROUNDS = 48, 16
#: Ids are code points below the surrogates; a byte of id 0 first takes a place beyond, as ``translate`` deletes what becomes U+0000.
IDS, ZERO = 0xD800, "\ue000"
#: What a pair without a rank makes, and what stands before the first token and behind the last; beyond all tokens.
NONE, END = "\uf8ff", "\uf8fe"

#: Letters and numbers of Unicode 14 to 16, which Java's classes lack and the pattern's library has.
NEW_LETTERS = """870-887 889-88e 8b5 8c8-8c9 c5d cdd 170d 171f 1b4c 1c89-1c8a 2c2f 2c5f 9ffd-9fff a7c0-a7c1 a7cb-a7cd a7d0-a7d1 a7d3 a7d5-a7dc
a7f2-a7f4 10570-1057a 1057c-1058a 1058c-10592 10594-10595 10597-105a1 105a3-105b1 105b3-105b9 105bb-105bc 105c0-105f3 10780-10785 10787-107b0
107b2-107ba 10d4a-10d65 10d6f-10d85 10ec2-10ec4 10f70-10f81 11071-11072 11075 1123f-11240 11380-11389 1138b 1138e 11390-113b5 113b7 113d1
113d3 11740-11746 11ab0-11abf 11bc0-11be0 11f02 11f04-11f10 11f12-11f33 12f90-12ff0 1342f 13441-13446 13460-143fa 16100-1611d 16a70-16abe
16d40-16d6c 18cff 1aff0-1aff3 1aff5-1affb 1affd-1affe 1b11f-1b122 1b132 1b155 1df00-1df1e 1df25-1df2a 1e030-1e06d 1e290-1e2ad 1e4d0-1e4eb
1e5d0-1e5ed 1e5f0 1e7e0-1e7e6 1e7e8-1e7eb 1e7ed-1e7ee 1e7f0-1e7fe 2a6de-2a6df 2b735-2b739 2ebf0-2ee5d 31350-323af"""
NEW_NUMBERS = "10d40-10d49 116d0-116e3 11bf0-11bf9 11f50-11f59 16130-16139 16ac0-16ac9 16d70-16d79 1ccf0-1ccf9 1d2c0-1d2d3 1e4f0-1e4f9 1e5f1-1e5fa"
#: Texts with a character from here on are cut by the classes with the new ones.
NEWER = r"[\x{870}-\x{10FFFF}]"


@dataclass(frozen=True)
class Vocabulary:
    """The path of a file of ranks (base64 and rank a line) and the pattern of words; None takes the installed public ones."""

    path: str | None = None
    pattern: str | None = None

    def load(self) -> tuple[dict[bytes, int], str]:
        if self.path and self.pattern:
            return _ranks(self.path), self.pattern
        import public_tokenizers

        return _ranks(self.path or str(public_tokenizers.path("byte_bpe_50k.tiktoken"))), self.pattern or public_tokenizers.PATTERN


INSTALLED = Vocabulary()


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"the vocabulary has no rank for {len(missing)} of 256 bytes")
    if max(ranks.values()) >= IDS:
        raise ValueError(f"a rank is {IDS} at least")
    return ranks


def java_patterns(pattern: str) -> tuple[str, str]:
    """The pattern in Java's syntax with Unicode's white space, without and with the newer letters and numbers."""
    span = lambda told: "".join("-".join(rf"\x{{{x}}}" for x in r.split("-")) for r in told.split())
    out, inside, at = "", False, 0
    while at < len(pattern):
        part = pattern[at : at + 5] if pattern.startswith((r"\p{L}", r"\p{N}"), at) else pattern[at : at + 2] if pattern[at] == "\\" else pattern[at]
        at += len(part)
        inside = part == "[" or inside and part != "]"
        if len(part) == 5:
            part += span(NEW_LETTERS if "L" in part else NEW_NUMBERS)
            part = part if inside else f"[{part}]"
        out += part
    return "(?U)" + pattern, "(?U)" + out


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _literal(one_row: DataFrame) -> Column:
    """The only value of a table of one row and column, as a literal: by way of a session variable, as Spark lets no subquery into a lambda."""
    spark, name = one_row.sparkSession, f"plumbline_{uuid.uuid4().hex}"
    one_row.createOrReplaceTempView(name)
    spark.sql(f"DECLARE VARIABLE {name} {one_row.schema[0].dataType.simpleString()}")
    spark.sql(f"SET VAR {name} = (SELECT * FROM {name})")
    spark.catalog.dropTempView(name)
    return F.expr(f"session.{name}")


def _bucket(word: Column) -> Column:
    return F.pmod(F.hash(word), F.lit(BUCKETS))


def _dealt(entries: DataFrame) -> Column:
    """Entries (word, tokens) as a literal array of small maps, by ``_bucket`` of the word."""
    small = entries.select(_bucket(F.col("word")).alias("b"), F.struct("word", "tokens").alias("e")).groupBy("b").agg(F.collect_list("e").alias("es"))
    all_buckets = entries.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"))
    whole = all_buckets.join(small, "b", "left").agg(F.array_sort(F.collect_list(F.struct("b", F.coalesce("es", F.array()).alias("es")))).alias("x"))
    return _literal(whole.select(F.transform("x", lambda r: F.map_from_entries(r["es"])).alias("x")))


def _listed(pairs: DataFrame) -> Column:
    """Pairs (pair, made) as a literal array of lists, by ``_bucket`` of the pair.

    A list is one string, two times ``NONE`` and then for each pair it, ``NONE``, what it makes, and ``NONE``: two tokens
    stand side by side in a pair only, and what follows a pair, or else the list, has the answer as its second character.
    """
    lists = pairs.groupBy(_bucket(F.col("pair")).alias("b")).agg(F.array_join(F.collect_list(F.concat("pair", F.lit(NONE), "made", F.lit(NONE))), "").alias("x"))
    all_buckets = pairs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"))
    whole = all_buckets.join(lists, "b", "left").agg(F.array_sort(F.collect_list(F.struct("b", F.concat(F.lit(2 * NONE), F.coalesce("x", F.lit(""))).alias("x")))).alias("x"))
    return _literal(whole.select(F.col("x.x").alias("x")))


class Codec:
    """Columns that encode and decode under a vocabulary, for one session."""

    def __init__(self, spark: SparkSession, vocabulary: Vocabulary = INSTALLED):
        ranks, pattern = vocabulary.load()
        self.patterns = java_patterns(pattern)
        pairs = []
        for piece, rank in ranks.items():
            for k in range(1, len(piece)):  # any two tokens that make the piece may be joined
                left, right = ranks.get(piece[:k]), ranks.get(piece[k:])
                if left is not None and right is not None:
                    pairs.append((chr(left) + chr(right), chr(rank)))
        pieces = [""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece.decode("latin-1")
        self.pairs = _listed(spark.createDataFrame(pairs, "pair string, made string"))
        self.pieces = _literal(spark.createDataFrame([(pieces,)], "x array<string>"))
        self.byte_chars = "".join(chr(ranks[bytes([b])]) for b in range(256)).replace("\0", ZERO)

    def words(self, text: Column) -> Column:
        """The matches of the pattern, in order."""
        plain, newer = (F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in self.patterns)
        return F.when(F.rlike(text, F.lit(NEWER)), newer).otherwise(plain)

    def _made(self, pair: Column) -> Column:
        """What a pair of tokens makes; ``NONE`` if it has no rank."""
        return F.substring(F.call_function("substring_index", F.get(self.pairs, _bucket(pair)), pair, F.lit(-1)), 2, 1)

    def _next(self, state: Column) -> Column:
        """Joins the leftmost pair of least rank, if any has one; only the two pairs that come of it are looked up."""
        s, made = F.get(state, F.lit(0)), F.get(state, F.lit(1))

        def join(z: Column, p: Column) -> Column:
            left, right = F.concat(F.substring(s, p - 1, F.lit(1)), z), F.concat(z, F.substring(s, p + 2, F.lit(1)))
            both = F.array_join(F.transform(F.array(left, right), self._made), "")
            return F.array(F.overlay(s, z, p, F.lit(2)), F.overlay(made, both, p - 1, F.lit(3)))

        return _let(F.array_min(F.split(made, "")), lambda z: F.when(z == NONE, state).otherwise(_let(F.instr(made, z), lambda p: join(z, p))))

    def _pairs(self, s: Column) -> Column:
        """For each distinct pair that makes something: what it makes, and the pair, as one string."""
        chars = F.split(s, "")
        pairs = _let(chars, lambda c: F.array_distinct(F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda x, y: F.concat(x, y))))
        return F.filter(F.transform(pairs, lambda p: F.concat(self._made(p), p)), lambda x: F.left(x, F.lit(1)) != NONE)

    def _round(self, state: Column) -> Column:
        """Joins all places of the pair of least rank at once, if no pair that comes of it on the way ranks before; else the leftmost place."""
        s, least = state["s"], F.left(F.array_min(state["made"]), F.lit(1))
        stated = lambda x: F.struct(x.alias("s"), self._pairs(x).alias("made"))
        pair = lambda x: F.substring(x, 2, 2)

        def join(z: Column, same: Column) -> Column:
            first = F.array_min(F.transform(same, lambda x: F.position(pair(x), s)))
            leftmost = _let(first, lambda p: stated(F.concat(F.substring(s, F.lit(1), p - 1), z, F.substring(s, p + 2, F.char_length(s)))))
            one = F.get(same, F.lit(0))
            between = self._made(F.concat(z, F.substring(one, 2, 1))) > z  # a joined place beside one that isn't yet
            after = lambda t: F.coalesce(F.array_min(t["made"]) > F.concat(z, F.lit(chr(IDS - 1))), F.lit(True))
            whole = _let(stated(F.replace(s, pair(one), z)), lambda t: F.when(after(t), t))
            return F.coalesce(F.when((F.size(same) == 1) & between, whole), leftmost)

        return _let(least, lambda z: _let(F.filter(state["made"], lambda x: F.left(x, F.lit(1)) == z), lambda same: join(z, same)))

    def fold(self, word: Column) -> Column:
        """Tokens of one word: ranked merges over its bytes."""
        latin = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")  # a character for each byte
        tokens = F.translate(latin, "".join(map(chr, range(256))), self.byte_chars)
        if ZERO in self.byte_chars:
            tokens = F.replace(tokens, F.lit(ZERO), F.lit("\0"))

        def short(s: Column) -> Column:
            pairs = F.transform(F.sequence(F.lit(1), F.char_length(s) - 1), lambda k: F.substring(s, k, F.lit(2)))
            begin = F.array(F.concat(F.lit(END), s, F.lit(END)), F.concat(F.lit(NONE), F.array_join(F.transform(pairs, self._made), ""), F.lit(NONE)))
            return F.aggregate(F.sequence(F.lit(2), F.char_length(s)), begin, lambda x, _: self._next(x), lambda x: F.replace(F.get(x, F.lit(0)), F.lit(END), F.lit("")))

        def long(s: Column) -> Column:
            more = lambda x, _: F.when(F.size(x["made"]) > 0, self._round(x)).otherwise(x)
            some = lambda x, _: F.when(F.size(x["made"]) > 0, F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, more)).otherwise(x)
            begin = F.struct(s.alias("s"), self._pairs(s).alias("made"))
            return F.aggregate(F.sequence(F.lit(0), F.ceil(F.char_length(s) / ROUNDS).cast("int")), begin, some, lambda x: x["s"])

        n = F.octet_length(word)
        return F.when(n < 2, tokens).when(n < LONG, _let(tokens, short)).otherwise(_let(tokens, long))

    def encode(self, text: Column, dictionary: Column | None = None) -> Column:
        """Tokens of a text, a character each, with ``dictionary`` or without."""
        found = lambda w: F.element_at(F.get(dictionary, _bucket(w)), w)
        tokens = self.fold if dictionary is None else lambda w: F.coalesce(found(w), self.fold(w))
        return F.array_join(F.transform(self.words(text), tokens), "")

    def each(self, tokens: Column) -> Column:
        """Tokens as an array of characters."""
        return F.when(tokens == "", F.array().cast("array<string>")).otherwise(F.split(tokens, ""))

    def ids(self, each: Column) -> Column:
        """Tokens, an array, as ids."""
        return F.transform(each, F.ascii)

    def packed(self, each: Column) -> Column:
        """The ids of tokens, an array, as little-endian unsigned 32-bit integers: a token is a unit of UTF-16, with an empty one behind it."""
        return F.when(F.size(each) == 0, F.lit(b"")).otherwise(F.encode(F.concat(F.array_join(each, "\0"), F.lit("\0")), "UTF-16LE"))

    def decode(self, each: Column) -> Column:
        """The bytes of tokens, an array: their pieces, one after the other."""
        return F.encode(F.array_join(F.transform(each, lambda c: F.get(self.pieces, F.ascii(c))), ""), "ISO-8859-1")

    def frequent(self, texts: DataFrame, limit: int = DICTIONARY, sample_bytes: int = SAMPLE_BYTES) -> Column | None:
        """A dictionary, small maps from words to tokens, of words that are frequent in a sample of ``texts`` (text); None if there are none.

        Texts are sampled by their hash.  A word is taken if its count is above the least bin of counts with which ``limit`` is kept.
        """
        total = text_bytes(texts, "text")
        share = min(1.0, sample_bytes / max(total, 1))
        some = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else texts
        counts = keep(some.select(F.explode(self.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n > 1"))
        level = F.floor(F.log2("n") * BINS)
        taken, lowest = 0, None
        for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():  # a row for each bin
            if taken + r.n > limit:
                break
            taken, lowest = taken + r.n, r.level
        if lowest is None:
            return None
        return _dealt(counts.where(level >= lowest).select("word", self.fold(F.col("word")).alias("tokens")))


def encoded(docs: DataFrame, vocabulary: Vocabulary = INSTALLED, limit: int = DICTIONARY, sample_bytes: int = SAMPLE_BYTES) -> tuple[DataFrame, Codec]:
    """(doc_id, tokens) of all documents, and the codec that tells their ids and decodes them."""
    codec = Codec(docs.sparkSession, vocabulary)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.select("doc_id", codec.encode(F.col("text"), codec.frequent(texts.select("text"), limit, sample_bytes)).alias("tokens")), codec


def digest(docs: DataFrame, vocabulary: Vocabulary = INSTALLED, limit: int = DICTIONARY, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, encoded and decoded whole."""
    d, codec = encoded(docs, vocabulary, limit, sample_bytes)
    d = d.select("doc_id", codec.each(F.col("tokens")).alias("each"))
    return d.select(
        "doc_id",
        F.size("each").cast("long").alias("n_tokens"),
        F.sha2(codec.packed(F.col("each")), 256).alias("ids_sha256"),
        F.sha2(codec.decode(F.col("each")), 256).alias("decoded_sha256"),
    )
