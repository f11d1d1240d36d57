"""Fill-in-the-middle: documents cut in three and put together in another order.

A text is a run of units: a run of ASCII letters is one, any other code point is one. The cuts fall
between units. To find them, the text is read in blocks of fixed length; two Fenwick trees over the
blocks hold the numbers of units that begin in them and of their code points. A cut before unit k
descends both trees by binary lifting, which leaves the block that k begins in, and the place of
that block in the text; only that block is then looked at again.

The text goes to Python once and only three numbers come back; output and restored text are
substrings and concatenations in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake.llm.common import filled, fresh, small_batches

BLOCK = 4096
#: What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def begins(block: str, after_letter: bool) -> np.ndarray:
    """For each code point whether a unit begins there. ``after_letter``: what the block follows."""
    points = np.frombuffer(block.encode("utf-32-le"), np.uint32)
    low = points | np.uint32(32)  # upper-case ASCII letters as lower-case ones
    letter = (low >= 97) & (low <= 122) & (points < 128)
    goes_on = letter.copy()
    goes_on[1:] &= letter[:-1]
    goes_on[0] &= after_letter
    return ~goes_on


class Fenwick:
    """Sums of blocks' counts, several at once, with a descent by the first of them."""

    def __init__(self, counts: np.ndarray) -> None:
        self.size = len(counts)
        self.tree = np.zeros((self.size + 1, counts.shape[1]), np.int64)
        self.tree[1:] = counts
        for i in range(1, self.size + 1):
            up = i + (i & -i)
            if up <= self.size:
                self.tree[up] += self.tree[i]
        self.steps = [1 << b for b in reversed(range(self.size.bit_length()))]
        self.rows = self.tree.tolist()

    def descend(self, k: int) -> tuple[int, list[int]]:
        """The last block before which there are no more than ``k`` (of the first count), and the
        sums of all counts before it; the number of blocks if ``k`` is the total."""
        at, sums = 0, [0] * self.tree.shape[1]
        for step in self.steps:
            if at + step <= self.size and sums[0] + self.rows[at + step][0] <= k:
                at += step
                sums = [a + b for a, b in zip(sums, self.rows[at])]
        return at, sums


class Units:
    """A text's units: their number ``n``, and where each begins."""

    def __init__(self, text: str, block: int = BLOCK) -> None:
        self.text, self.block = text, block
        counts = [(int(self._begins(i).sum()), min(block, len(text) - i))
                  for i in range(0, len(text), block)]
        self.n = sum(units for units, _ in counts)
        self.blocks = Fenwick(np.array(counts, np.int64).reshape(-1, 2))

    def _begins(self, at: int) -> np.ndarray:
        before = self.text[at - 1:at]
        return begins(self.text[at:at + self.block], before.isascii() and before.isalpha())

    def place(self, k: int) -> int:
        """Code points before unit ``k`` (from 0); the whole text's, if there are just ``k``."""
        if k >= self.n:
            return len(self.text)
        _, (units, points) = self.blocks.descend(k)
        return points + int(np.flatnonzero(self._begins(points))[k - units])


def _cuts(block: int):
    @F.pandas_udf("n long, first long, second long")
    def cut(frames: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, one, two in frames:
            out = []
            for text, h1, h2 in zip(texts, one, two):
                units = Units(text, block)
                a, b = h1 % (units.n + 1), h2 % (units.n + 1)
                out.append((units.n, units.place(min(a, b)), units.place(max(a, b))))
            yield pd.DataFrame(out, columns=["n", "first", "second"])

    return cut


def drawn(row_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the row's id; null counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transformed(
    docs: DataFrame,
    text: str = "text",
    row_id: str = "doc_id",
    rate: int = 90,
    spm_rate: int = 20,
    seed: int = 1,
    block: int = BLOCK,
) -> DataFrame:
    """``docs`` with the columns ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` (null if
    plain) and ``output``; of clashing names, longer ones are used for the input's own columns
    (a ``_`` at the end).

    ``rate`` of a hundred documents are cut, and ``spm_rate`` of a hundred of those have the suffix
    first. Empty and null texts (null is empty), and texts that hold one of the three marks, stay
    as they are. Rows of one id are cut by the same draw, each in its own text; a null id draws
    as an empty one. Repeated rows stay repeated; an empty table gives an empty result. Nothing is
    shuffled: each text is cut where it is read.
    """
    small_batches(docs.sparkSession)
    for name in ("n", "form", "prefix_chars", "middle_chars", "output"):
        if name in docs.columns:
            longer = fresh(docs, name)
            docs = docs.withColumnRenamed(name, longer)
            text, row_id = (longer if c == name else c for c in (text, row_id))
    mine = {name: fresh(docs, f"__{name}") for name in ("text", "cut", "h1", "h2", "h3", "h4")}
    whole, at = F.col(mine["text"]), F.col(mine["cut"])
    h1, h2, h3, h4 = (F.col(mine[f"h{i}"]) for i in range(1, 5))
    marked = [F.contains(whole, F.lit(mark)) for mark in (PREFIX, SUFFIX, MIDDLE)]
    plain = (whole == "") | marked[0] | marked[1] | marked[2] | (h3 % 100 >= rate)
    draws = drawn(F.col(row_id), seed)
    cut = docs.withColumn(mine["text"], filled(text)).withColumns(
        {mine[f"h{i + 1}"]: draw for i, draw in enumerate(draws)}
    ).withColumn(mine["cut"], _cuts(block)(whole, h1, h2)).withColumn(
        "form", F.when(plain, "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm"))
    prefix = F.substring(whole, F.lit(1), at["first"])
    middle = F.substring(whole, at["first"] + 1, at["second"] - at["first"])
    suffix = F.substring(whole, at["second"] + 1, F.length(whole))
    form = F.col("form")
    return cut.withColumns({
        "n": at["n"],
        "prefix_chars": F.when(form != "plain", at["first"]),
        "middle_chars": F.when(form != "plain", at["second"] - at["first"]),
        "output": F.when(form == "plain", whole).when(form == "psm", F.concat(
            F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).otherwise(
            F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)),
    }).drop(*mine.values())


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that ``transformed`` cut, from its output and form alone. Each mark's first
    occurrence is the one put there: the text holds none, and no mark begins as another ends."""
    out = F.col(output)

    def after(mark: str) -> Column:
        return F.instr(out, mark) + len(mark)

    def between(mark: str, following: str) -> Column:
        return F.substring(out, after(mark), F.instr(out, following) - after(mark))

    last = F.substring(out, after(MIDDLE), F.length(out))
    return F.when(F.col(form) == "plain", out).when(
        F.col(form) == "psm", F.concat(between(PREFIX, SUFFIX), last, between(SUFFIX, MIDDLE))
    ).otherwise(F.concat(between(PREFIX, MIDDLE), last, between(SUFFIX, PREFIX)))
