import numpy as np
import pytest

from tunelake.llm import chat, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def raw(spark):
    return chat.raw_transcripts(spark.read.parquet(f"{SF}/conversations.parquet"))


@pytest.fixture(scope="module")
def model(raw):
    return chat.fitted(raw, "raw")


def test_roles_are_recovered(spark, raw):
    """On transcripts that the model has not seen, markers partly missing."""
    seen = chat.fitted(raw.where("crc32(cast(conv_id as string)) % 5 <> 0"), "raw")
    unseen = raw.where("crc32(cast(conv_id as string)) % 5 = 0")
    found = chat.recovered(unseen, seen, "raw").collect()
    got = {}
    for r in found:
        got.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    right = total = 0
    truth = {}
    for r in unseen.collect():
        truth.setdefault(r.conv_id, []).append((r.turn, r.role, r.text.strip()))
    for conv, turns in truth.items():
        mine = [x[1:] for x in sorted(got[conv])]
        want = [x[1:] for x in sorted(turns)]
        right += sum(a == b for a, b in zip(mine, want))
        total += len(want)
    assert right / total > 0.9


def test_paths_against_all_paths(model):
    rng = np.random.default_rng(0)
    for _ in range(20):
        shown = rng.integers(-300_000, 0, (4, chat.STATES))
        best, at = None, None
        for p in np.ndindex(*[chat.STATES] * 4):
            score = model.first[p[0]] + sum(shown[i, s] for i, s in enumerate(p)) + sum(
                model.step[a, b] for a, b in zip(p, p[1:]))
            if best is None or score > best:
                best, at = score, list(p)
        path = chat.best_path(model, shown, None, None)
        assert path == at
        # The same through chunks.
        cuts = [(0, 1), (1, 3), (3, 4)]
        ends = chat.borders([chat.transfer(model, shown[a:b], a == 0) for a, b in cuts])
        joined = []
        for n, (a, b) in enumerate(cuts):
            joined += chat.best_path(model, shown[a:b], ends[n - 1] if n else None, ends[n])
        assert joined == path


@pytest.mark.parametrize("chunk", [1, 2, 3])
def test_chunks_make_no_difference(spark, raw, model, chunk):
    def turns(size):
        return sorted((r.conv_id, r.turn, r.role, r.text, r.n_lines) for r in chat.recovered(
            raw.where("conv_id < 25"), model, "raw", chunk=size).collect())
    assert turns(chunk) == turns(chat.CHUNK)


def test_edges(spark, model):
    rows = [
        # In the model's transcripts a blank line stands for a missing marker, so there is none here.
        (1, 0, "User: hi\nthere\nAssistant: yes", "x"),
        (1, 0, "User: hi\nthere\nAssistant: yes", "x"),
        (1, 1, "Human: more?", "x"), (2, 0, None, "x"), (2, 1, "", "x"), (None, 5, "User: null", "x"),
        (3, None, "System: first", "x"), (3, 7, "User: then", "x"), (3, 7, "Bot: tie", "x"),
        (4, 0, "User: " + "long " * 200_000, "x"),
        *((5, i, f"line {i}", "x") for i in range(40)),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, role string")
    for chunk in (chat.CHUNK, 4):
        found = chat.recovered(df, model, chunk=chunk).collect()
        by = {}
        for r in found:
            by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text, r.n_lines, r.rendered))
        assert [t[1:3] for t in sorted(by[1])] == [
            *[("user", "hi\nthere"), ("assistant", "yes")] * 2, ("user", "more?")]
        assert sum(t[3] for t in by[2]) == 2 and "".join(t[2] for t in by[2]) == ""
        assert by[None][0][1:3] == ("user", "null")
        assert [t[1] for t in sorted(by[3])] == ["system", "assistant", "user"]
        assert sum(len(t[2].split()) for t in by[4]) == 200_000
        assert sum(t[3] for t in by[5]) == 40
        assert by[1][0][4].startswith("<|im_start|>")
        assert all(sorted(t[0] for t in turns) == list(range(len(turns)))
                   for turns in by.values())
    assert chat.recovered(df.where("1 = 0"), model).count() == 0
    nothing = chat.fitted(df.where("1 = 0"))
    assert chat.recovered(df, nothing).count() > 0


def test_query_covers_all_lines(spark):
    rows = queries.op9_chat(spark, SF).collect()
    truth = spark.read.parquet(f"{SF}/conversations.parquet")
    assert {r.conv_id for r in rows} == {r.conv_id for r in truth.select("conv_id").collect()}
    words = sum(len(r.text.split()) for r in truth.collect())
    assert sum(len(r.text.split()) for r in rows) >= words


def test_no_turn_is_lost(spark, model):
    """Equal turns at one place, null places, and many rows without a transcript's id."""
    rows = [(1, 0, "User: hi")] * 3 + [(1, None, "User: hi")] * 2 + [(2, 5, "Bot: yes"), (2, 5, "Bot: yes")]
    rows += [(None, None, "Human: same")] * 500 + [(None, 3, "Human: same")] * 20 + [(3, 0, None)] * 2
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(5)
    got = chat.recovered(df, model, chunk=64).collect()
    assert sum(r.n_lines for r in got) == len(rows)
    numbers = sorted(r.turn for r in got if r.conv_id is None)
    assert numbers == list(range(520))
    chunks = chat.segments(df, chunk=64).groupBy("conv", "chunk").count().collect()
    assert max(r["count"] for r in chunks) <= 64
