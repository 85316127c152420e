import hashlib
import random
from collections import defaultdict
from zlib import crc32

from storyloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, block=100):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    md5 = lambda r, t: hashlib.md5(f"{len(r)}:{r}{t}".encode()).digest()
    own = {c: [(r, t) for _, _, r, t in sorted(x, key=lambda y: (y[0], y[1], md5(y[2], y[3])))] for c, x in own.items()}
    new = {}
    for c, x in own.items():
        h = crc32(str(c).encode()) % 6
        base = c - (abs(c) % block) * (1 if c >= 0 else -1)
        new[c] = own.get(base, [])[:h] + x[h:]
    members, ends = defaultdict(set), defaultdict(list)
    for c, x in new.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].add(c)
        ends[tuple(x)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    saved = {p: (len(m) - 1) * len(p[-1][1]) if p else 0 for p, m in members.items()}
    leaves = {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] += sum(saved[q] for q in children[p])
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -999, len(m), len(children[p]), leaves[p], saved[p], digest(p)) for p, m in members.items())


def test_trie_equals_brute_force(spark, monkeypatch):
    """Copies, shared openings, one long conversation, turnless ones, nulls, ties, repeated rows, negative ids, an absent first conversation and a
    clashing column; shards from single conversations to all of them, with a queue that spills and short blocks of ends."""
    monkeypatch.setattr(prefix_trie, "BLOCK_CHARS", 20)
    r = random.Random(6)
    say = lambda: r.choice(["hi", "yes", "", "no, ñandú", "x" * 9, None])
    rows = []
    for c in [*range(0, 60), *range(150, 170), 300, *range(-5, 0)]:
        for t in range(r.choice([1, 1, 2, 4, 8])):
            rows.append((c, t, r.choice(["user", "assistant", None]), say()))
    rows += [(400 + i, t, "user", "same") for i in range(40) for t in range(7)] + [(500, t, "user", f"turn {t}") for t in range(120)] + [(501, t, "user", f"turn {t}") for t in range(119)]
    rows += [(7, 1, "user", "tie"), (7, 1, "user", "tie"), (7, None, "a", "tie"), (None, 1, "user", "lost"), (301, None, None, None)]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as depth", "2 as k1")
    want = brute(rows)
    for shard, items in ((None, 500_000), (1, 2), (5, 3), (30, 2)):
        out = prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.ordered_turns(table)), shard, items)
        assert sorted(tuple(-999 if x is None else x for x in row) for row in out.collect()) == want
    assert prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.ordered_turns(table.limit(0)))).count() == 0


def test_queue_gives_out_in_order():
    r = random.Random(1)
    for limit in (2, 3, 7, 1000):
        queue, want, got = prefix_trie.SpillingQueue(limit, 2), [], []
        for i in range(3000):
            item = (r.randrange(50), i)
            queue.push(item)
            want.append(item)
            if r.random() < 0.3:
                got.append(queue.pop())
                assert got[-1] == min(want)
                want.remove(got[-1])
        while queue.peek() is not None:
            got.append(queue.pop())
        assert got[-len(want) :] == sorted(want)
