"""The trie of conversations against a plain one."""

import hashlib
import random
import zlib

import pytest

from threadloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, seq string, prefix string, n long, depth long"


def brute(rows):
    turn_digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, turn_digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    nodes = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        turns = own.get(c - c % 20, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            n = nodes.setdefault(tuple(turns[:d]), {"members": [], "ends": []})
            n["members"].append(c)
            if d == len(turns):
                n["ends"].append(c)
    out = []
    for p, n in nodes.items():
        kids = [q for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p]
        below = [q for q in nodes if q[: len(p)] == p]
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in nodes) for q in below)
        saved = sum((len(nodes[q]["members"]) - 1) * len(q[-1][1].encode().split()) for q in below if q)
        up = min(nodes[p[:-1]]["members"]) if p else None
        ends = hashlib.sha256(",".join(map(str, sorted(n["ends"]))).encode()).hexdigest()
        out.append((min(n["members"]), len(p), up, len(n["members"]), len(kids), leaves, saved, ends))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def talks():
    """Conversations with shared first turns, copies, ties, nulls, repeated rows, empty and long texts, long lists."""
    r, out = random.Random(3), []
    said = [("user", "one two"), ("user", ""), ("assistant", "three  four\nfive"), (None, None), ("system", "six " * 500), ("user", "\x1cseven \xa0eight")]
    for c in range(130):
        n = r.randint(0, 6) if c % 7 else 3
        for t in range(n):
            role, text = said[0] if t < 2 and c % 3 else r.choice(said)
            out.append((c, t if r.random() < 0.9 else None, role, text))
    out += [(c, t, "user", f"copy {t}") for c in range(200, 260) for t in range(4)]  # copies
    out += [(300, t, "user", f"long {t % 5}") for t in range(150)] + [(301, 5, "b", "x"), (301, 5, "a", "x"), (301, 5, "a", "x"), (None, 1, "user", "nobody's"), (340, 0, "user", "one two"), (341, 0, None, "x")]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("most", [None, 2])
def test_trie(spark, talks, most):
    df = spark.createDataFrame([(*x, "s", "p", 1, 2) for x in talks], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in prefix_trie.rebuilt_trie(df, most).collect()), key=repr)
    assert got == brute(talks)


def test_ids_that_end_are_joined_run_by_run(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 7)
    rows = [(c, 0, "user", "same") for c in range(1, 100) if c % 20]
    got = prefix_trie.prefix_trie(prefix_trie.lists(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).where("depth = 1").first()
    assert got["n_convs"] == 95 and got["ends_sha256"] == hashlib.sha256(",".join(str(r[0]) for r in rows).encode()).hexdigest()


def test_empty_trie(spark):
    assert prefix_trie.rebuilt_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    alone = spark.createDataFrame([(5, 0, "user", "a"), (41, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    # 5 and 41 have no start; crc32 says how many of their turns are left
    assert sorted((tuple(r) for r in prefix_trie.rebuilt_trie(alone).collect()), key=repr) == brute([tuple(r) for r in alone.collect()])
