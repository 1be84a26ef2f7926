"""Exact arithmetic, which Spark has no type for: equations in text, and binomial tails."""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction
from math import comb

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: how much an expression may hold, and the share of the score that is left if no right equation reaches the answer
MAX_NODES, MAX_VALUE, MAX_BRACKET, UNFINISHED = 64, Fraction(10**15), 80, 0.75

NUMBER, BLANK, CURRENCY = "number", "blank", "currency"
_PIECES = re.compile(r"(?P<number>\d[\d,]*(?:\.\d+)?)|(?P<blank>\s+)|(?P<currency>[$¥￥])|.", re.DOTALL)
_SIGNED = re.compile(r"[-+]?\d[\d,]*(?:\.\d+)?")
_BLANKS = re.compile(r"\s*")
_SUMS, _PRODUCTS = "+-", "*/×÷"


class Pieces:
    """A text as numbers, blanks, currency signs and single characters, each with its kind and place."""

    def __init__(self, text: str):
        found = list(_PIECES.finditer(text))
        self.text = text
        self.said = [m.group() for m in found]
        self.kind = [m.lastgroup or m.group() for m in found]
        self.at = [m.start() for m in found] + [len(text)]

    def back(self, k: int) -> int:
        """The piece at or before ``k`` that isn't blank."""
        while k >= 0 and self.kind[k] == BLANK:
            k -= 1
        return k

    def term_before(self, end: int) -> int | None:
        """Where the term begins that ends with piece ``end``: a number, or a bracket, with its currency sign."""
        if end < 0:
            return None
        begin = end
        if self.kind[end] == ")":
            depth = 1
            while depth:
                begin -= 1
                if begin < 0 or self.kind[begin] in ("=", ";", "；", "。") or "\n" in self.said[begin]:
                    return None
                depth += {")": 1, "(": -1}.get(self.kind[begin], 0)
            if not 1 <= self.at[end] - self.at[begin] - 1 <= MAX_BRACKET:
                return None
        elif self.kind[end] != NUMBER:
            return None
        return begin - 1 if begin and self.kind[begin - 1] == CURRENCY else begin

    def chain_before(self, equals: int) -> int | None:
        """Where the longest chain of terms and operators begins that ends at an equals sign and doesn't begin within a word."""
        begins: list[int] = []
        k = self.back(equals - 1)
        while (begin := self.term_before(k)) is not None:
            begins.append(begin)
            operator = self.back(begin - 1)
            if operator < 0 or self.kind[operator] not in (*_SUMS, *_PRODUCTS):
                break
            k = self.back(operator - 1)
        for begin in reversed(begins[1:]):
            if begin and self.kind[begin - 1] in (*_SUMS,) and begin == begins[-1]:
                begin -= 1  # the sign of the first term
            before = self.text[self.at[begin] - 1] if begin else " "
            if not (before == "." or before == "_" or before.isalnum()):
                return begin
        return None

    def number_after(self, equals: int) -> str | None:
        """The number behind an equals sign, with its sign."""
        begin = _BLANKS.match(self.text, self.at[equals] + 1).end()
        m = _SIGNED.match(self.text, begin + (self.text[begin : begin + 1] in ("$", "¥", "￥")))
        return m.group() if m else None


class _Parser:
    """Sums of products of numbers and brackets, from the pieces that aren't blank or a currency sign."""

    def __init__(self, pieces: Pieces):
        self.todo = [(k, s) for k, s in zip(pieces.kind, pieces.said, strict=True) if k not in (BLANK, CURRENCY)][::-1]
        self.nodes = 0

    def peek(self) -> str:
        return self.todo[-1][0] if self.todo else ""

    def total(self) -> Fraction:
        value = self.product()
        while self.peek() in _SUMS and self.todo:
            sign = 1 if self.todo.pop()[0] == "+" else -1
            value += sign * self.product()
            self.count(2)
        return value

    def product(self) -> Fraction:
        value = self.signed()
        while self.peek() in _PRODUCTS and self.todo:
            times = self.todo.pop()[0] in "*×"
            other = self.signed()
            value = value * other if times else value / other
            self.count(2)
        return value

    def signed(self) -> Fraction:
        if not self.todo:
            raise ValueError("a term is missing")
        kind, said = self.todo.pop()
        if kind in _SUMS:
            self.count(2)
            return self.signed() if kind == "+" else -self.signed()
        if kind == NUMBER:
            self.count(1)
            return Fraction(said.replace(",", ""))
        if kind == "(":
            value = self.total()
            if not self.todo or self.todo.pop()[0] != ")":
                raise ValueError("a bracket is open")
            return value
        raise ValueError(said)

    def count(self, n: int) -> None:
        self.nodes += n
        if self.nodes >= MAX_NODES:
            raise ValueError("too long")


def evaluate(expression: str) -> Fraction | None:
    """The exact value of sums, products and quotients of numbers, with currency signs and commas; None for anything else or too large."""
    parser = _Parser(Pieces(expression))
    try:
        value = parser.total()
    except (ValueError, ZeroDivisionError, RecursionError):
        return None
    return value if not parser.todo and abs(value) <= MAX_VALUE else None


def number(raw: str) -> str:
    """A number as it is compared: without commas, blanks and a plus sign."""
    return raw.replace(",", "").replace(" ", "").strip().removeprefix("+")


def numbers(text: str) -> set[str]:
    return set(map(number, _SIGNED.findall(text or "")))


def equations(text: str) -> list[tuple[str, str, bool]]:
    """Left side, right side and truth of each ``a op b ... = c`` of a text."""
    if "=" not in (text or ""):
        return []
    pieces, out = Pieces(text), []
    for k, kind in enumerate(pieces.kind):
        if kind == "=" and (right := pieces.number_after(k)) is not None and (begin := pieces.chain_before(k)) is not None:
            left = pieces.text[pieces.at[begin] : pieces.at[k]].rstrip()
            out.append((left, number(right), evaluate(left) == Fraction(number(right))))
    return out


def calculation(reason: str, question: str, answer: str) -> tuple[int, int, float]:
    """How many equations bear on the question, how many of these are right, and the reward.

    An equation bears on it if its left side uses a number of the question or its right side is the answer.  The reward
    is the share that is right, less a part if no right one has the answer on its right side.
    """
    asked, want = numbers(question), number(answer or "")
    bearing = [(right, holds) for left, right, holds in equations(reason) if right == want or not asked.isdisjoint(numbers(left))]
    if not bearing:
        return 0, 0, 0.0
    right = sum(holds for _, holds in bearing)
    arrived = any(holds and said == want for said, holds in bearing)
    return len(bearing), right, right / len(bearing) * (1.0 if arrived else UNFINISHED)


def check_equations(rows: DataFrame, key: str, reason: str, question: str, answer: str) -> DataFrame:
    """(key, n_relevant, n_right, reward).  Texts without an equals sign have no equation and stay with Spark."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [calculation(*x) for x in zip(pdf[reason], pdf[question], pdf[answer], strict=True)]
            yield pd.DataFrame({key: pdf[key], **{name: [f[k] for f in found] for k, name in enumerate(("n_relevant", "n_right", "reward"))}})

    said = F.when(F.contains(F.col(reason), F.lit("=")), F.col(reason)).alias(reason)
    return rows.select(key, said, question, answer).mapInPandas(run, f"{key} long, n_relevant long, n_right long, reward double")


def binomial_tail(rows: DataFrame, key: str) -> DataFrame:
    """P(X <= k) for X ~ Binomial(n, 1/2), exactly, then as a double."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            p = [float(Fraction(sum(comb(int(n), i) for i in range(min(int(k), int(n)) + 1)), 2 ** int(n))) for n, k in zip(pdf["n"], pdf["k"], strict=True)]
            yield pd.DataFrame({key: pdf[key], "tail": p})

    return rows.select(key, "n", "k").mapInPandas(run, f"{key} long, tail double")
