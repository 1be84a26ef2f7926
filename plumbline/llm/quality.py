"""Quality rules with tokeniser fertility.

Each text is cut by two public vocabularies: subwords with byte fallback, and a
byte-level one for many languages.  Four figures come of it: characters per
token of either, the share of tokens that are byte fallbacks, and the entropy of
the text's own token distribution.  A text outside the band of its language (or,
for an unlisted language, of its script) is rejected, as is one that fails the
base rules.

A band's characters per token are the language's own, give or take what is chance
in so few words: ``spread`` over the root of the number of words.  Its entropy has
a floor by the number of tokens, at every length.  The bands are parameters; those
given were measured on the documents labelled good (see README).

Neither vocabulary joins pieces across white space, so a text's tokens are those
of its words, each after a blank; each distinct word of a batch is cut once.

Defined results: a null or empty text has no words, fails the base rules and
isn't kept; a null language takes the band of the text's script; repeated rows
get equal verdicts; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import plain_names

#: Least entropy in bits of running text, by the binary logarithm of its tokens; between two places by a line.
ENTROPY_FLOOR = ((0, 0.0), (4, 3.0), (5, 4.0), (6, 4.9), (7, 5.35), (8, 5.75), (9, 6.0), (10, 6.2), (11, 6.32), (12, 6.38), (13, 6.42))
#: Words of which the tokens are remembered by a worker.
REMEMBERED = 100_000


@dataclass(frozen=True)
class Range:
    """From least to most, and beyond by ``spread`` over the root of the number of words."""

    least: float
    most: float
    spread: float = 0.0

    def admits(self, value: float, n_words: int) -> bool:
        more = self.spread / max(n_words, 1) ** 0.5
        return self.least - more <= value <= self.most + more


#: Characters per token that running text of the listed languages doesn't exceed; published prose has about four.
MOST_CHARACTERS = 5.5


def prose(least: float, deviation: float, width: float = 5.0) -> Range:
    """From the mean of text in made-up words, of which a vocabulary has few whole, to what real words reach, and ``width`` deviations of a word."""
    return Range(least, MOST_CHARACTERS, width * deviation)


@dataclass(frozen=True)
class Band:
    """What a text may measure: characters per token of both vocabularies, byte share, and entropy above the floor."""

    subword: Range
    byte_level: Range
    max_byte_share: float
    floor_shift: float = 0.0
    max_entropy: float = 16.0

    def admits(self, n_words: int, n_tokens: int, chars_per_token: float, chars_per_byte_token: float, byte_share: float, entropy: float) -> bool:
        if not self.subword.admits(chars_per_token, n_words) or not self.byte_level.admits(chars_per_byte_token, n_words):
            return False
        floor = self.floor_shift + np.interp(np.log2(max(n_tokens, 1)), *zip(*ENTROPY_FLOOR, strict=True))
        return byte_share <= self.max_byte_share and floor <= entropy <= self.max_entropy


#: By language, and by script for a language that isn't listed.
LANGUAGE_BANDS: dict[str, Band] = {
    "en": Band(prose(2.218, 0.612), prose(2.208, 0.636), 0.05, -0.12),
    "de": Band(prose(2.242, 0.611), prose(2.283, 0.670), 0.05, -0.12),
    "fr": Band(prose(1.981, 0.627), prose(2.018, 0.601), 0.05, -0.17),
    "es": Band(prose(1.941, 0.594), prose(2.045, 0.599), 0.05, -0.17),
}
SCRIPT_BANDS: dict[str, Band] = {
    "latin": Band(Range(1.3, 8.0), Range(1.3, 8.0), 0.10, -0.3),
    "other": Band(Range(0.2, 8.0), Range(0.2, 8.0), 0.95, -1.5),
}

BASE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SCHEMA = f"doc_id long, {BASE_SCHEMA}, base_failed boolean, kept boolean, n_tokens long, n_byte_tokens long, chars_per_token double, chars_per_byte_token double, byte_share double, token_entropy double, band string"

REPEAT_WINDOW = 8
MIN_WORDS = 20

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_LEAD = np.ones(256, np.uint8)
_LEAD[0x80:0xC0] = 0
_LATIN = np.zeros(256, np.uint8)  # ASCII letters and the lead bytes of U+00C0-U+024F
_LATIN[65:91] = _LATIN[97:123] = _LATIN[0xC3:0xCA] = 1
_FOREIGN = np.zeros(256, np.uint8)  # lead bytes of later scripts
_FOREIGN[0xCD:0xF5] = 1


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]


def repeated(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the items that another item of the same owner equals: any, and any before."""
    order = np.lexsort((np.arange(len(key)), key, owner))
    same = np.zeros(len(key), bool)
    same[1:] = (owner[order][1:] == owner[order][:-1]) & (key[order][1:] == key[order][:-1])
    later = np.zeros(len(key), bool)
    later[order] = same
    either = same.copy()
    either[:-1] |= same[1:]
    out = np.zeros(len(key), bool)
    out[order] = either
    return out, later


def covered(n: int, at: np.ndarray, size: int) -> np.ndarray:
    """Marks of the words within a window that begins at one of ``at``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + size, n), -1)
    return np.cumsum(step[:-1]) > 0


def base_measures(t: tv.Texts, words: np.ndarray) -> dict[str, np.ndarray]:
    lead = np.concatenate(([0], np.cumsum(_LEAD[t.data], dtype=np.int64)))
    chars = lead[t.ends] - lead[t.starts]
    at, row = tv.windows(t, REPEAT_WINDOW)
    twice, _ = repeated(row, tv.window_hash(words, at, REPEAT_WINDOW))
    repeat = covered(len(words), at[twice], REPEAT_WINDOW)
    # lines: from a row's begin or the byte after a line feed to the next such place
    feeds = np.flatnonzero(t.data == 0x0A)
    begins = np.concatenate((t.rows[:-1], feeds + 1))
    rows = np.concatenate((np.arange(t.n_rows), np.searchsorted(t.rows, feeds, "right") - 1))
    order = np.lexsort((rows, begins))
    begins, rows = begins[order], rows[order]
    ends = np.concatenate((begins[1:] - (rows[1:] == rows[:-1]), t.rows[-1:]))
    full = np.searchsorted(t.starts, begins) < np.searchsorted(t.starts, ends)
    begins, ends, rows = begins[full], ends[full], rows[full]
    _, later = repeated(rows, tv.span_hash(t.data, begins, ends))
    return {
        "n_words": t.n_words,
        "word_chars": row_sums(chars, t.first),
        "n_symbols": t.byte_sums(_SYMBOL),
        "n_dup_lines": np.bincount(rows[later], minlength=t.n_rows),
        "n_repeat_words": row_sums(repeat, t.first),
    }


class Fertility:
    """Token figures of texts by a sentence-piece vocabulary, and by a byte-level one given as ranks."""

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        import sentencepiece
        import tiktoken

        self.model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.byte_level = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self.held: dict[int, int] = {}

    def byte_level_counts(self, hashes: list[int], distinct: list[str]) -> np.ndarray:
        """Tokens of each word after a blank; those of earlier batches are remembered."""
        if len(self.held) > REMEMBERED:
            self.held.clear()
        out = []
        for h, word in zip(hashes, distinct, strict=True):
            n = self.held.get(h)
            if n is None:
                n = self.held[h] = len(self.byte_level.encode_ordinary(" " + word))
            out.append(n)
        return np.array(out, np.int64)

    def measure(self, t: tv.Texts, words: np.ndarray, chars: np.ndarray) -> dict[str, np.ndarray]:
        keys, some, which = np.unique(words, return_index=True, return_inverse=True)
        raw = t.data.tobytes()
        distinct = [raw[a:b].decode("utf-8", "replace") for a, b in zip(t.starts[some].tolist(), t.ends[some].tolist(), strict=True)]
        pieces = self.model.encode(distinct, num_threads=1) if distinct else []
        counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.fromiter((i for p in pieces for i in p), np.int64, int(counts.sum()))
        heads = np.concatenate(([0], np.cumsum(counts)))
        n_byte = row_sums(self.is_byte[flat], heads)
        n_tokens = row_sums(counts[which], t.first)
        byte_tokens = row_sums(n_byte[which], t.first)
        n_other = row_sums(self.byte_level_counts(keys.tolist(), distinct)[which], t.first)
        # token counts by row, for the entropy
        of_word = counts[which]
        place = np.arange(int(of_word.sum())) - np.repeat(np.cumsum(of_word) - of_word, of_word)
        ids = flat[place + np.repeat(heads[:-1][which], of_word)]
        keys, n = np.unique(np.repeat(t.owner(), of_word) * len(self.is_byte) + ids, return_counts=True)
        owner = keys // len(self.is_byte)
        share = n / n_tokens[owner]
        entropy = np.bincount(owner, weights=-share * np.log2(share), minlength=t.n_rows) + 0.0
        with np.errstate(invalid="ignore", divide="ignore"):
            return {
                "n_tokens": n_tokens,
                "n_byte_tokens": byte_tokens,
                "chars_per_token": np.where(n_tokens > 0, chars / n_tokens, 0.0),
                "chars_per_byte_token": np.where(n_other > 0, chars / n_other, 0.0),
                "byte_share": np.where(n_tokens > 0, byte_tokens / n_tokens, 0.0),
                "token_entropy": entropy,
            }


def scripts(t: tv.Texts) -> np.ndarray:
    return np.where(t.byte_sums(_LATIN) >= t.byte_sums(_FOREIGN), "latin", "other")


def within(m: dict[str, np.ndarray], k: int, band: Band) -> bool:
    return bool(band.admits(*(m[x][k] for x in ("n_words", "n_tokens", "chars_per_token", "chars_per_byte_token", "byte_share", "token_entropy"))))


def judge(text: pa.Array, lang: list, fertility: Fertility, languages: dict[str, Band], by_script: dict[str, Band]) -> dict[str, np.ndarray]:
    t = tv.scan(text)
    words = tv.word_hash(t)
    m = base_measures(t, words)
    m |= fertility.measure(t, words, m["word_chars"])
    m["base_failed"] = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    script = scripts(t)
    m["band"] = np.array([x if x in languages else script[k] for k, x in enumerate(lang)], dtype=object)
    m["kept"] = np.array([not m["base_failed"][k] and within(m, k, languages.get(b) or by_script[b]) for k, b in enumerate(m["band"])], dtype=bool)
    return m


@lru_cache(maxsize=1)
def _loaded(subword: str, byte_level: str, pattern: str) -> Fertility:
    """One set of vocabularies for each worker process, not for each of its tasks."""
    return Fertility(subword, byte_level, pattern)


@dataclass(frozen=True)
class Vocabularies:
    """Paths of the two vocabularies and the byte-level one's pattern; None takes the installed public ones."""

    subword: str | None = None
    byte_level: str | None = None
    pattern: str | None = None

    def load(self) -> Fertility:
        if self.subword and self.byte_level and self.pattern:
            return _loaded(self.subword, self.byte_level, self.pattern)
        import public_tokenizers

        return _loaded(self.subword or str(public_tokenizers.path("piece_bpe_32k.model")), self.byte_level or str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), self.pattern or public_tokenizers.PATTERN)


INSTALLED = Vocabularies()


def _judged(vocabularies: Vocabularies, languages: dict[str, Band], by_script: dict[str, Band]):
    """A function that yields the parts of a batch with their measures."""
    held: list[Fertility] = []

    def of(batch: pa.RecordBatch, text: str, lang: str) -> Iterator[tuple[pa.RecordBatch, dict[str, np.ndarray]]]:
        if not held:
            held.append(vocabularies.load())
        column = batch.column(batch.schema.get_field_index(text))
        for a, b in tv.slices(column, 2 << 20):
            part = batch.slice(a, b - a)
            yield part, judge(part.column(part.schema.get_field_index(text)), part.column(part.schema.get_field_index(lang)).to_pylist(), held[0], languages, by_script)

    return of


def quality_measures(docs: DataFrame, vocabularies: Vocabularies = INSTALLED, languages: dict[str, Band] = LANGUAGE_BANDS, by_script: dict[str, Band] = SCRIPT_BANDS) -> DataFrame:
    """One row per document with its measures and verdict; no shuffle."""
    of = _judged(vocabularies, languages, by_script)
    names = [c.split()[0] for c in SCHEMA.split(", ")][1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, m in of(batch, "text", "lang"):
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(m[x]) for x in names)], ["doc_id", *names])
                tv.release()

    return docs.select(F.col("doc_id").cast("long"), "text", "lang").mapInArrow(run, SCHEMA)


@plain_names
def quality_filter(docs: DataFrame, vocabularies: Vocabularies = INSTALLED, languages: dict[str, Band] = LANGUAGE_BANDS, by_script: dict[str, Band] = SCRIPT_BANDS) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    of = _judged(vocabularies, languages, by_script)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, m in of(batch, "text", "lang"):
                yield part.filter(pa.array(m["kept"]))
                tv.release()

    return docs.mapInArrow(run, docs.schema)
