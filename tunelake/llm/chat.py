"""Transcripts to chat turns by a hidden Markov model over their lines.

A hidden state is a role together with "begins a turn" or "goes on". A line shows a speaker marker
(or none) and some features of form; the model's probabilities are counted from transcripts whose
roles are known. The Viterbi path gives each line its role, also where markers are missing, and
consecutive lines of a turn are rendered canonically.

A transcript comes in segments, in order. Long transcripts are decoded in chunks of segments: a
chunk yields, for each state before it, the best score of ending in each state (a small matrix);
from the matrices of a transcript's chunks follow the states at the chunks' borders; with those,
each chunk is decoded on its own. Scores are whole numbers, so that this gives the same path as
decoding the transcript at once. Only one matrix per chunk meets in a task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunelake.llm.common import filled, stored

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # state 2r begins a turn of role r, state 2r + 1 goes on
#: Segments of a transcript that are decoded together.
CHUNK = 4096

# Names by which transcripts call the speakers.
SPEAKERS = {
    "system": ("system", "sys", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "q", "prompter", "you"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "a", "model", "response"),
}
_ROLE_OF = {name: i for i, role in enumerate(ROLES) for name in SPEAKERS[role]}
_NAMES = "|".join(sorted(_ROLE_OF, key=len, reverse=True))
#: "User: ...", "### Human", "**Bot:** ...", "<|user|> ...", "[AGENT] ...", "Q) ..."
MARKER = re.compile(
    rf"\s*(?:#{{1,4}}\s*({_NAMES})\s*:?\s*$|\*\*({_NAMES})\s*:?\*\*:?\s*|<\|?({_NAMES})\|?>:?\s*"
    rf"|\[({_NAMES})\]:?\s*|({_NAMES})\s*[:>)]\s+|({_NAMES})\s*:\s*$)", re.I)
#: Kinds of each feature: marker, length, question, after a blank line, opening.
KINDS = (len(ROLES) + 1, 5, 2, 2, 3)


def observed(lines: list[str], after_blank: bool) -> np.ndarray:
    """A row of features per line. ``after_blank``: whether the line before the first was blank."""
    out = np.zeros((len(lines), len(KINDS)), np.int64)
    for i, line in enumerate(lines):
        marker = MARKER.match(line)
        said = line[marker.end():] if marker else line
        said = said.strip()
        n = len(said)
        out[i] = (
            1 + _ROLE_OF[next(g for g in marker.groups() if g).lower()] if marker else 0,
            0 if not n else 1 if n < 40 else 2 if n < 120 else 3 if n < 400 else 4,
            said.endswith("?"), after_blank,
            0 if not n else 1 if said[0].isupper() else 2,
        )
        after_blank = not line.strip()
    return out


@dataclass
class Model:
    """Log-probabilities in whole 2**-16ths: ``first`` state, ``step`` from state to state, and
    ``shows``, for each feature, of each kind in each state."""

    first: np.ndarray
    step: np.ndarray
    shows: list[np.ndarray]

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return sum(self.shows[f][:, features[:, f]].T for f in range(len(KINDS)))


def _logs(counts: np.ndarray, prior: np.ndarray | float = 0.5) -> np.ndarray:
    counts = counts + prior
    return np.rint(np.log(counts / counts.sum(-1, keepdims=True)) * 65536).astype(np.int64)


def model_of(counts: dict[tuple[str, int, int], int]) -> Model:
    """``counts``: ("first", 0, state), ("step", from, to) and ("show<f>", state, kind). What is known
    beforehand is only that a marker begins a turn of its own role; without any counts, all else
    is equally likely."""
    def table(name: str, rows: int, columns: int, prior: np.ndarray | float = 0.5) -> np.ndarray:
        out = np.zeros((rows, columns))
        for (what, a, b), n in counts.items():
            if what == name:
                out[a, b] += n
        return _logs(out, prior)

    markers = np.full((STATES, KINDS[0]), 1e-4)
    markers[:, 0] = 0.5
    for role in range(len(ROLES)):
        markers[2 * role, 1 + role] = 0.5
    return Model(table("first", 1, STATES)[0], table("step", STATES, STATES), [
        table(f"show{f}", STATES, kinds, 0.5 if f else markers)
        for f, kinds in enumerate(KINDS)])


def best_path(model: Model, emissions: np.ndarray, enter: int | None, leave: int | None
              ) -> list[int]:
    """Viterbi's path. ``enter``: the state before the first line (None: the transcript begins);
    ``leave``: the state of the last line, where it is known."""
    score = (model.first if enter is None else model.step[enter]) + emissions[0]
    back = np.zeros((len(emissions), STATES), np.int64)
    for i in range(1, len(emissions)):
        ways = score[:, None] + model.step
        back[i] = ways.argmax(0)
        score = ways[back[i], np.arange(STATES)] + emissions[i]
    path = [int(score.argmax()) if leave is None else leave]
    for i in range(len(emissions) - 1, 0, -1):
        path.append(int(back[i][path[-1]]))
    return path[::-1]


def transfer(model: Model, emissions: np.ndarray, begins: bool) -> np.ndarray:
    """Best score from each state before the lines (rows; all alike if the transcript begins) to
    each state of the last line."""
    score = (np.tile(model.first, (STATES, 1)) if begins else model.step) + emissions[0]
    for row in emissions[1:]:
        score = (score[:, :, None] + model.step).max(1) + row
    return score


def borders(matrices: list[np.ndarray]) -> list[int]:
    """The state of the last line of each chunk."""
    score, back = matrices[0][0], []
    for matrix in matrices[1:]:
        ways = score[:, None] + matrix
        back.append(ways.argmax(0))
        score = ways.max(0)
    out = [int(score.argmax())]
    for step in reversed(back):
        out.append(int(step[out[-1]]))
    return out[::-1]


# --- jobs -----------------------------------------------------------------------------------------


def _grouped(work: Callable[[tuple, list[dict]], list[dict]], schema: pa.Schema, keys: list[str]
             ) -> Callable:
    """For mapInArrow over sorted partitions: ``work`` gets a key and the rows that have it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, out = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if held and key != current:
                    out += work(current, held)
                    held = []
                    if len(out) >= 1000:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out = []
                current = key
                held.append(row)
        if held:
            out += work(current, held)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def segments(df: DataFrame, text: str | Column = "text", conv: str = "conv_id",
             order: str = "turn", chunk: int = CHUNK, *more: str) -> DataFrame:
    """``conv``, ``chunk``, ``place``, ``text``: all of the transcripts' pieces, numbered through in order;
    a chunk is what a transcript has among ``chunk`` consecutive numbers. Rows go to tasks by range,
    equal ones also by where they were read, so that neither a transcript nor a place is one
    task's. The numbers are this table's own: store it to use them twice."""
    body = filled(text) if isinstance(text, str) else F.coalesce(text, F.lit(""))
    rows = df.select(
        F.col(conv).cast("long").alias("conv"), F.col(order).cast("long").alias("place"),
        body.alias("text"), *more, F.monotonically_increasing_id().alias("salt"))
    by = [*rows.columns[:3], *rows.columns[3:]]
    number = F.monotonically_increasing_id()
    return rows.repartitionByRange(*by).sortWithinPartitions(*by).select(
        "conv", number.alias("place"), F.floor(number / chunk).alias("chunk"), "text",
        *rows.columns[3:-1])


def fitted(known: DataFrame, text: str = "text", role: str = "role", conv: str = "conv_id",
           order: str = "turn") -> Model:
    """A model from segments with known roles, each segment a turn. All rows count; only the sums
    (a few hundred) reach the driver. Unknown or null roles are left out. Steps from one chunk to the
    next aren't counted."""
    schema = pa.schema([("what", pa.string()), ("a", pa.int64()), ("b", pa.int64()),
                        ("n", pa.int64())])

    def count(key: tuple, rows: list[dict]) -> list[dict]:
        found: dict[tuple, int] = {}
        state, blank = None, False
        for row in rows:
            if row["role"] not in ROLES:
                continue
            lines = row["text"].split("\n")
            features = observed(lines, blank)
            blank = not lines[-1].strip()
            for i in range(len(lines)):
                now = 2 * ROLES.index(row["role"]) + (i > 0)
                step = ("first", 0, now) if state is None else ("step", state, now)
                for what in (step, *((f"show{f}", now, int(k)) for f, k in
                                     enumerate(features[i]))):
                    found[what] = found.get(what, 0) + 1
                state = now
        return [{"what": w, "a": a, "b": b, "n": n} for (w, a, b), n in found.items()]

    rows = segments(known, text, conv, order, CHUNK, F.col(role).alias("role"))
    counts = (
        rows.repartition("conv", "chunk").sortWithinPartitions("conv", "chunk", "place", "text")
        .mapInArrow(_grouped(count, schema, ["conv", "chunk"]),
                    "what string, a long, b long, n long")
        .groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()
    )
    return model_of({(r.what, r.a, r.b): r.n for r in counts})


def _lines(rows: list[dict]) -> list[str]:
    return [line for row in rows for line in row["text"].split("\n")]


def turns_of(lines: list[str], path: list[int], goes_on: bool) -> list[dict]:
    """Turns of a chunk. ``goes_on``: its first turn began in the chunk before."""
    out: list[dict] = []
    for i, (line, state) in enumerate(zip(lines, path)):
        role = state // 2
        same = out and out[-1]["role"] == role and state % 2
        if not same:
            out.append({"role": role, "lines": [], "part": bool(not out and goes_on and state % 2)})
        if not out[-1]["lines"] and not out[-1]["part"]:
            marker = MARKER.match(line)
            line = line[marker.end():] if marker else line
        out[-1]["lines"].append(line)
    return out


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def recovered(transcripts: DataFrame, model: Model, text: str | Column = "text",
              conv: str = "conv_id", order: str = "turn", chunk: int = CHUNK) -> DataFrame:
    """One row per recovered turn: conv_id, turn (from 0), role, text, n_lines and ``rendered``.

    ``transcripts`` has the segments of the transcripts in ``order``. Null text is an empty line;
    rows at the same place go by their text, and equal ones all stay; a null place comes first; rows
    without a transcript's id are one transcript. Markers are taken off
    the first line of a turn, and blank lines off its ends. An empty table gives an empty result.
    Other columns are not looked at.
    """
    rows = stored(segments(transcripts, text, conv, order, chunk), "segments")
    chunks = rows.select("conv", "chunk").distinct()
    spread = chunks.groupBy("conv").agg(F.count("*").alias("n"), F.min("chunk").alias("least"))
    # Stored, so that the joins with it can split a transcript that has a large part of all rows.
    long_ones = stored(spread.where("n > 1"), "long")

    # Whether the line before a chunk is blank: the last line of the last segment before it.
    def last_line(key: tuple, held: list[dict]) -> list[dict]:
        lines = _lines(held)
        return [{"conv": key[0], "chunk": key[1], "blank": not lines[-1].strip()}]

    def parted(df: DataFrame) -> DataFrame:
        return df.repartition("conv", "chunk").sortWithinPartitions(
            F.asc("conv"), "chunk", F.asc("place"), "text")

    tail = pa.schema([("conv", pa.int64()), ("chunk", pa.int64()), ("blank", pa.bool_())])
    same = F.expr("l.conv <=> r.conv")
    many = rows.alias("l").join(long_ones.alias("r"), same).select("l.*", "r.least")
    ends = parted(many).mapInArrow(
        _grouped(last_line, tail, ["conv", "chunk"]), "conv long, chunk long, blank boolean")
    before = Window.partitionBy("conv").orderBy("chunk")
    enter = ends.select("conv", "chunk",
                        F.coalesce(F.lag("blank").over(before), F.lit(False)).alias("blank"))
    enter = stored(enter, "chunk-ends")
    many = many.alias("l").join(
        enter.alias("r"), F.expr("l.conv <=> r.conv and l.chunk = r.chunk")
    ).select("l.*", "r.blank")

    def matrix(key: tuple, held: list[dict]) -> list[dict]:
        shown = model.emissions(observed(_lines(held), held[0]["blank"]))
        found = transfer(model, shown, key[1] == held[0]["least"])
        return [{"conv": key[0], "chunk": key[1], "m": found.ravel().tolist()}]

    matrices = parted(many).mapInArrow(
        _grouped(matrix, pa.schema([("conv", pa.int64()), ("chunk", pa.int64()),
                                    ("m", pa.list_(pa.int64()))]), ["conv", "chunk"]),
        "conv long, chunk long, m array<long>")

    def resolve(key: tuple, held: list[dict]) -> list[dict]:
        states = borders([np.array(r["m"]).reshape(STATES, STATES) for r in held])
        return [{"conv": key[0], "chunk": r["chunk"], "enter": states[i - 1] if i else None,
                 "leave": states[i]} for i, r in enumerate(held)]

    known = matrices.repartition("conv").sortWithinPartitions("conv", "chunk").mapInArrow(
        _grouped(resolve, pa.schema([(n, pa.int64()) for n in ("conv", "chunk", "enter",
                                                               "leave")]), ["conv"]),
        "conv long, chunk long, enter long, leave long")
    many = many.alias("l").join(
        known.alias("r"), F.expr("l.conv <=> r.conv and l.chunk = r.chunk")
    ).select("l.*", "r.enter", "r.leave")
    none = F.lit(None).cast("long")
    single = rows.alias("l").join(long_ones.alias("r"), same, "left_anti").select(
        "*", F.col("chunk").alias("least"), F.lit(False).alias("blank"), none.alias("enter"),
        none.alias("leave"))

    turn = pa.schema([("conv", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()),
                      ("role", pa.string()), ("part", pa.bool_()), ("text", pa.string()),
                      ("n_lines", pa.int64())])

    def decode(key: tuple, held: list[dict]) -> list[dict]:
        lines, one = _lines(held), held[0]
        path = best_path(model, model.emissions(observed(lines, one["blank"])),
                         one["enter"], one["leave"])
        goes_on = one["enter"] is not None and one["enter"] // 2 == path[0] // 2
        return [{"conv": key[0], "chunk": key[1], "n": i, "role": ROLES[t["role"]],
                 "part": t["part"], "text": "\n".join(t["lines"]), "n_lines": len(t["lines"])}
                for i, t in enumerate(turns_of(lines, path, goes_on))]

    found = parted(single.unionByName(many)).mapInArrow(
        _grouped(decode, turn, ["conv", "chunk"]),
        "conv long, chunk long, n long, role string, part boolean, text string, n_lines long")
    # Numbers run within a chunk; chunks' counts (one line each) shift them. A turn that spans
    # chunks is put together again.
    found = stored(found, "turns")
    base = found.groupBy("conv", "chunk").agg(
        F.count_if(~F.col("part")).alias("fresh")
    ).withColumn("base", F.coalesce(F.sum("fresh").over(
        before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = _numbered(found, base).groupBy("conv_id", "turn", "role").agg(
        F.sum("n_lines").alias("n_lines"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "text"))),
                                 lambda x: x["text"]), "\n").alias("text"))
    clean = F.regexp_replace("text", r"\A(?:[ \t\r]*\n)+|\s+\z", "")
    return whole.withColumn("text", clean).select(
        "conv_id", "turn", "role", "text", "n_lines",
        rendered(F.col("role"), F.col("text")).alias("rendered"))


def _numbered(found: DataFrame, base: DataFrame) -> DataFrame:
    """``turn`` counts the turns of a transcript; a part of a turn begun earlier has its number."""
    starts = found.where("n = 0").select("conv", "chunk", F.col("part").alias("continues"))
    shift = base.alias("l").join(
        starts.alias("r"), F.expr("l.conv <=> r.conv and l.chunk = r.chunk")
    ).select("l.conv", "l.chunk", "l.base", "r.continues")
    return found.alias("l").join(
        shift.alias("r"), F.expr("l.conv <=> r.conv and l.chunk = r.chunk")
    ).select(
        F.col("l.conv").alias("conv_id"), "l.chunk", "l.role", "l.text", "l.n_lines",
        (F.col("r.base") + F.col("l.n") - F.col("r.continues").cast("int")).alias("turn"),
    )


# --- raw transcripts from clean turns ---------------------------------------------------------------

# How a transcript's speakers may be written, by style.
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("### Instructions\n", "### Human\n", "### Response\n"),
    ("**Context:** ", "**Customer:** ", "**Agent:** "),
    ("<|system|> ", "<|user|> ", "<|assistant|> "),
    ("[SYSTEM] ", "[YOU] ", "[AI] "),
)


def raw_transcripts(conversations: DataFrame, miss: int = 8) -> DataFrame:
    """Clean turns as a raw transcript would have them: each transcript in a style of its own, one
    marker of ``miss`` missing (a blank line stands there instead). Column ``raw``; the others are
    kept, ``role`` as the truth to compare with."""
    role = F.array_position(F.array(*(F.lit(r) for r in ROLES)), F.col("role"))
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))).cast("int")
    table = F.array(*(F.array(*(F.lit(x) for x in s)) for s in STYLES))
    marker = F.coalesce(F.try_element_at(F.element_at(table, style + 1),
                                         F.nullif(role.cast("int"), F.lit(0))), F.lit(""))
    missing = F.pmod(F.xxhash64("conv_id", "turn", F.lit("miss")), F.lit(miss)) == 0
    return conversations.withColumn(
        "raw", F.concat(F.when(missing, F.lit("\n")).otherwise(marker), filled("text")))
