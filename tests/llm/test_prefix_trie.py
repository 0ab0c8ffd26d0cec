import hashlib
import math
import random
import zlib

import pytest

from inkwell.llm import prefix_trie

DDL = "conv_id long, turn long, role string, text string, depth int, node string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def rebuilt(rows):
    """conv_id -> list of (role, text)."""
    convs = {}
    for c, t, r, x, *_ in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs.setdefault(c, []).append(((t is not None, t or 0), r, hashlib.sha256(f"{len(r)}:{r}:{x}".encode()).digest(), x))
    turns = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    nodes = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    kids = {}
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(members) - 1) * (len(k[-1][1]) if k else 0)
    out = []
    for k, members in nodes.items():
        ends = sorted(c for c in members if len(convs[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(kids.get(k, [])), leaves[k], saved[k], sha(",".join(map(str, ends)))))
    return sorted(out, key=str)


def run(spark, rows, size=prefix_trie.BLOCK, parts=3):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], DDL).repartition(parts)
    got = prefix_trie.trie(*prefix_trie.shared_heads(prefix_trie.turns(df)), size=size)
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("size", [3, 32])
def test_against_brute_force(spark, size):
    rng = random.Random(size)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "hello there"])) for c in [*range(100, 160), *range(205, 230), -3, -100] for t in range(rng.randrange(1, 9)) if c != 200]
    rows += [(100, None, "user", "first"), (101, 2, "user", "tied"), (101, 2, "user", "tied"), (101, 2, "bot", "tied"), (None, 0, "user", "nobody")]
    rows += [(300, t, "user", "z" * t) for t in range(3)] + [(300 + i, t, "user", "long") for i in (1, 2, 7) for t in range(40 + i)]
    rows += [(900 + i, 0, "user", "alone") for i in range(20)]  # no conversation 900 + h: some have no turn left
    rng.shuffle(rows)
    assert run(spark, rows, size) == brute(rows)


def test_long_conversations_by_joints(spark):
    """Depths that take three levels of joints."""
    rows = [(101 + i, t, "u", f"{t}" if t < 20 * (i + 1) else f"{i}-{t}") for i in range(3) for t in range(70)]
    assert run(spark, rows, 3) == brute(rows)


def test_one_conversation_in_many_tasks(spark):
    rows = [(107, t, "u", "x" if t % 2 else "y") for t in range(700)] + [(108, t, "u", "x" if t % 2 else "y") for t in range(650)]
    assert run(spark, rows, 8, parts=16) == brute(rows)


def test_empty_and_all_turnless(spark):
    assert run(spark, []) == []
    rows = [(c, 0, "u", "x") for c in range(1, 60) if zlib.crc32(str(c).encode()) % 6]
    got = run(spark, rows)
    assert got == brute(rows) and len(got) == 1 and got[0][1] == 0
