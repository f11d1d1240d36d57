import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tunelake.llm import prefix_trie

SCHEMA = ("conv_id long, turn long, role string, text string, conv string, depth string, f1 string, "
          "n string, up string, chunk string")
CLASH = ("x",) * 6
WORD = re.compile("[^ \t-\r]+")


def said(role, text):
    role = role or ""
    return f"{len(role)}:{role}{text or ''}"


def brute(rows):
    """All rebuilt conversations written out, and every node's subtree walked."""
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            whole = said(role, text)
            digest = hashlib.sha256(whole.encode()).digest()
            own[conv].append(((turn is not None, turn or 0, digest), whole, text or ""))
    for turns in own.values():
        turns.sort(key=lambda t: t[0])
    members, ends, words = defaultdict(list), defaultdict(list), {(): 0}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        path = own.get(conv - conv % 20, [])[:h] + turns[h:]
        for d in range(len(path) + 1):
            node = tuple(t[1] for t in path[:d])
            members[node].append(conv)
            if d:
                words[node] = len(WORD.findall(path[d - 1][2]))
        ends[tuple(t[1] for t in path)].append(conv)
    out = []
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = (len(members[node]) - 1) * words[node] + sum(saved[k] for k in kids[node])
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None,
                    len(members[node]), len(kids[node]), leaves[node], saved[node],
                    hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, **options):
    return sorted((tuple(r) for r in prefix_trie.prefix_nodes(df, **options).collect()), key=str)


def edge_rows():
    rng = random.Random(5)
    rows = []
    for conv in [*range(0, 130), 1000, 1001, 10**12, 10**12 + 7]:
        if conv in (40, 60):  # some bases are absent
            continue
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, turn, rng.choice(["user", "assistant", None, ""]),
                         rng.choice(["a b", "a  b c", "", None, "é", "\n"]), *CLASH))
    rows += [(7, None, "user", "null turn", *CLASH), (7, None, None, None, *CLASH)]
    rows += [(8, 0, "user", "tie", *CLASH)] * 3 + [(8, 0, "user", "other", *CLASH)]
    rows += [(None, 0, "user", "no conversation", *CLASH)] * 4
    # Role and text must not run into each other.
    rows += [(200, 0, "us", "er", *CLASH), (200, 1, "user", "", *CLASH), (200, 2, "", "user", *CLASH)]
    rows += [(1205, 0, "user", "a turn that its head has no place for", *CLASH)]
    return rows


@pytest.fixture
def spread(spark):
    """Small tables in several tasks too."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(5)


def test_edge_cases(edges, spread):
    got, expected = found(edges), brute(edge_rows())
    assert got == expected
    assert sum(r[1] == 0 for r in got) == 1


def test_colliding_fingerprints_are_found_out(edges, spread):
    """With the base 1, the order of turns makes no difference: sequences collide until the next
    bases are taken."""
    tried = []

    def pairs(seed):
        tried.append(seed)
        return (1, 1) if len(tried) == 1 else prefix_trie.bases(seed)

    assert found(edges, base_pairs=pairs) == brute(edge_rows())
    assert len(tried) == 2


def test_one_conversation_with_most_turns_and_one_node_with_most_ends(spark, spread):
    rows = [(20, t, "user", f"turn {t % 7}", *CLASH) for t in range(5000)]
    rows += [(39, t, "user", f"turn {t % 7}", *CLASH) for t in range(4990)]
    rows += [(10_000 + c, t, "user", "same", *CLASH) for c in range(4500) for t in range(2)]
    rows += [(None, None, None, None, *CLASH)] * 1000 + [(50_000, None, "user", "", *CLASH)] * 1000
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = {(r[0], r[1]): r for r in found(df)}
    # Checked by the counts; the brute force is quadratic in the depth.
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in (20, 39)}
    assert max(d for _, d in got) == 5000
    deep = got[(20, 5000)]
    assert deep[3:6] == (1, 0, 1) and deep[7] == hashlib.sha256(b"20").hexdigest()
    assert got[(20, 4990)][3] == 2  # both read alike: heads of the same conversation
    assert got[(20, 4000)][6] == sum(2 for d in range(4000, 4991)) and h[39] <= 4990
    root = got[(min(c for c, _ in got), 0)]
    assert root[3] == 4503
    alike = [r for r in got.values() if r[1] == 2 and r[3] > 1000]
    assert len(alike) == 1
    assert root[5] == sum(r[4] == 0 for r in got.values())


def test_composition_is_that_of_the_whole_run():
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(50)]
    base = prefix_trie.bases(1)

    def fingerprint(run):
        x, p = 0, 1
        for d in run:
            x, p = (x + p * prefix_trie.value(d)[0]) % prefix_trie.PRIME, p * base[0] % prefix_trie.PRIME
        return x

    import numpy as np

    for cut in (0, 1, 20, 50):
        left, right = fingerprint(digests[:cut]), fingerprint(digests[cut:])
        assert prefix_trie.composed(np.array([left]), np.array([cut]), np.array([right]), base[0]) \
            == [fingerprint(digests)]


def test_heads_beyond_three_turns_are_refused(edges):
    from pyspark.sql import functions as F
    with pytest.raises(Exception, match="a head has 0 to 3 turns"):
        prefix_trie.prefix_nodes(edges, head_of=lambda c: F.lit(4)).collect()


def test_empty_table(edges):
    assert found(edges.where("1 = 0")) == []
    assert found(edges.where("conv_id is null")) == []
