"""Extracting answers, formats and numbers from generated text, as Column expressions.

White space is Unicode white space wherever a pattern says ``\\s``, which the
``(?U)`` flag asks of Java.  Anchored patterns end in ``\\z``, so a trailing
line feed doesn't pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\u200b]"


def strip(c: Column) -> Column:
    """Without white space at both ends, of any kind and not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def body(c: Column, prefix: str = "", limit: int = 600) -> Column:
    """A text without its source prefix, white space collapsed, cut to ``limit`` characters."""
    bare = F.when(F.startswith(c, F.lit(prefix)), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c) if prefix else c
    return F.substring(collapse(bare), 1, limit)


def all_matches(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def first(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def non_empty(items: Column) -> Column:
    return F.filter(items, lambda x: F.length(x) > 0)


def tagged(c: Column, tag: str, ignore_case: bool = False) -> Column:
    """The last non-empty body of ``<tag>...</tag>``, stripped; null if there is none."""
    flags = "(?isU)" if ignore_case else "(?sU)"
    return last(non_empty(F.transform(all_matches(c, rf"{flags}<{tag}>(.*?)</{tag}>"), strip)))


def thinking(c: Column) -> Column:
    return tagged(c, "think")


def answer_tag(c: Column) -> Column:
    return tagged(c, "answer", ignore_case=True)


def boxed(c: Column, tail: int = 1000) -> Column:
    """The last ``\\boxed{...}`` within the last ``tail`` characters, else what follows the last ``####``."""
    end = F.when(F.length(c) > tail, F.substring(c, -tail, tail)).otherwise(c)
    box = last(all_matches(end, r"\\boxed\{([^{}]*)\}"))
    marked = last(all_matches(end, r"####[ \t]*([^\n]+)"))
    return F.coalesce(strip(box), strip(marked))


def label_answer(c: Column, labels: Sequence[str]) -> Column:
    """The last boxed label, else the label mentioned last."""
    names = "|".join(sorted(labels, key=lambda x: (-len(x), x)))
    return F.coalesce(last(all_matches(c, rf"\\boxed\{{\s*({names})\s*\}}")), last(all_matches(c, rf"({names})")))


def confidence(c: Column) -> Column:
    """The first ``<confidence>`` as a number in [0, 1]; null if there is none such."""
    x = first(all_matches(c, r"(?s)<confidence>\s*(.*?)\s*</confidence>")).try_cast("double")
    return F.when(~F.isnan(x) & x.between(0.0, 1.0), x)


def strict_think_box(c: Column) -> Column:
    return c.rlike(r"(?s)^\s*<think>.+?</think>\s*\\boxed\{[^{}]+\}\s*\z")


def strict_answer(c: Column, least: int = 20, most: int = 12_000) -> Column:
    """One think block of bounded length, then one answer tag, and nothing else."""
    reason = F.regexp_extract(c, r"(?s)^\s*<think>(.*?)</think>\s*<answer>[^<]+</answer>\s*\z", 1)
    return F.length(strip(reason)).between(least, most)


def strict_box_only(c: Column) -> Column:
    return c.rlike(r"^\s*\\boxed\{[^{}]+\}\s*\z")


def normal_answer(c: Column) -> Column:
    """Upper case without commas, white space and punctuation at the ends."""
    bare = F.regexp_replace(F.upper(c), r"(?U)[\s,，]", "")
    return F.regexp_replace(bare, r"^[\.。:：;；!！?？'\"()（）]+|[\.。:：;；!！?？'\"()（）]+\z", "")


def normal_number(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[,$\s+]", "")


def decimal_of(c: Column) -> Column:
    return normal_number(c).try_cast("decimal(38,12)")


def same_number(a: Column, b: Column, tolerance: str = "0.00000001") -> Column:
    """Equal as decimals within the tolerance; as strings where either isn't a number."""
    x, y = decimal_of(a), decimal_of(b)
    return F.coalesce(F.abs(x - y) <= F.lit(tolerance).cast("decimal(38,12)"), F.trim(a) == F.trim(b))


def numbers(c: Column) -> Column:
    """Distinct numbers of a text, normalised, in order of appearance."""
    return F.array_distinct(F.transform(all_matches(c, r"([-+]?\d[\d,]*(?:\.\d+)?)"), normal_number))


def state_tokens(c: Column) -> Column:
    """Distinct CJK characters and runs of ASCII word characters, in lower case."""
    return F.array_distinct(all_matches(F.lower(c), r"([\x{4e00}-\x{9fff}]|[a-z0-9_]+)"))


def words(c: Column) -> Column:
    """ASCII words in lower case, with repeats."""
    return all_matches(F.lower(c), r"([a-z0-9_]+)")


def grams(items: Column, n: int) -> Column:
    """Adjacent items joined, n at a time."""
    count = F.size(items) - n + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda k: F.array_join(F.slice(items, k, n), ""))).otherwise(F.array().cast("array<string>"))


def search_tokens(c: Column) -> Column:
    """Latin words, whole CJK runs and CJK bigrams, with repeats."""
    latin = all_matches(F.lower(c), r"([a-z0-9_]+)")
    runs = all_matches(c, r"([\x{4e00}-\x{9fff}]+)")
    pairs = F.flatten(F.transform(runs, lambda r: grams(F.split(r, ""), 2)))
    return F.concat(latin, runs, pairs)


def feature_tokens(c: Column, concepts: dict[str, Sequence[str]]) -> Column:
    """Latin words with ``_.+-`` inside, CJK characters (from U+3400 on) and bigrams, and a concept for each synonym found."""
    low = F.lower(c)
    latin = all_matches(low, r"([a-z0-9][a-z0-9_.+-]*)")
    runs = all_matches(low, r"([\x{3400}-\x{9fff}]+)")
    each = F.flatten(F.transform(runs, lambda r: F.concat(F.split(r, ""), grams(F.split(r, ""), 2))))
    found = [F.when(mentions(low, [s.lower() for s in synonyms]), F.lit(f"concept:{name}")) for name, synonyms in concepts.items()]
    return F.concat(latin, each, F.array_compact(F.array(*found)) if found else F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def occurrences(c: Column, cue: str) -> Column:
    """How often ``cue`` occurs, without overlap."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(cue), F.lit("")))) / len(cue)).cast("long")


def coverage(c: Column, packed: Column, separator: str = "|||") -> Column:
    """Share of the packed terms that occur in a text; 0 without terms."""
    terms = non_empty(F.split(packed, "\\Q" + separator + "\\E"))
    hits = F.size(F.filter(terms, lambda t: F.contains(c, t)))
    return F.when(F.size(terms) > 0, hits / F.size(terms)).otherwise(0.0)


def grounding(question: Column, reason: Column) -> Column:
    """Share of the question's numbers that the reason uses; 0 without numbers."""
    asked = numbers(question)
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, numbers(reason))) / F.size(asked)).otherwise(0.0)


def mentions(c: Column, phrases: Sequence[str]) -> Column:
    return c.rlike("|".join(f"\\Q{p}\\E" for p in phrases))


def padded_id(prefix: str, ordinal: Column, width: int = 4) -> Column:
    return F.format_string(f"{prefix}-%0{width}d", ordinal)


def plain_number(c: Column, places: int = 6) -> Column:
    """A number without trailing zeros."""
    fixed = F.format_string(f"%.{places}f", c.cast("double"))
    return F.regexp_replace(F.regexp_replace(fixed, r"0+\z", ""), r"\.\z", "")


def first_ids(c: Column, pattern: str) -> Column:
    """Distinct identifiers of a pattern, in order of appearance."""
    return F.array_distinct(all_matches(c, f"({pattern})"))


def judge_score(c: Column) -> Column:
    """The last ``[[score]]`` from 0 to 4 as a share of 4; other numbers are no scores, and a text without any scores 0."""
    x = last(all_matches(c, r"\[\[\s*([0-4](?:\.\d+)?)\s*\]\]")).try_cast("double")
    return F.when(c.isNotNull(), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0)) / 4))
