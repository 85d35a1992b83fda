"""The prefix trie against dictionaries of prefixes."""

import collections
import hashlib
import random
import zlib

from lectern.llm import prefixtrie
from lectern.llm.common import staged

SCHEMA = "conv_id long, turn long, role string, text string, pos int, none string, conv string, h1 string, n string, k1 int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(rows):
    """Turns (role, text) of each conversation, rebuilt as the query says."""
    by = collections.defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    held = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in by.items()}
    h = {c: 0 if c is None else zlib.crc32(str(c).encode()) % 4 for c in held}
    return {c: ([] if c is None else held.get(c - c % 20, [])[: h[c]]) + v[h[c] :] for c, v in held.items()}


def brute(convs):
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, totals, out = collections.defaultdict(list), {}, []
    order = lambda c: (c is None, c or 0)
    least = {k: min(m, key=order) for k, m in members.items()}
    for k in sorted(members, key=len, reverse=True):
        own = (len(members[k]) - 1) * len(k[-1][1].encode().split()) if k else 0
        totals[k] = (sum(totals[x][0] for x in kids[k]) or 1, own + sum(totals[x][1] for x in kids[k]))
        ends = sorted((c for c in members[k] if len(convs[c]) == len(k)), key=order)
        digest = hashlib.sha256(",".join("" if c is None else str(c) for c in ends).encode()).hexdigest()
        out.append((least[k], len(k), least[k[:-1]] if k else None, len(members[k]), len(kids[k]), *totals[k], digest))
        if k:
            kids[k[:-1]].append(k)
    return collections.Counter(out)


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, "a", "b", "c", "d", 2) for r in rows], SCHEMA)
    turns, convs = prefixtrie.rebuilt(staged(prefixtrie.read_turns(df)))
    return collections.Counter(tuple(x[c] for c in COLUMNS) for x in prefixtrie.trie(turns, convs).collect())


def test_query(spark, data, same):
    same(prefixtrie.query(spark, data), prefixtrie.ORACLE)


def test_many_small_conversations(spark):
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant"]), r.choice(["a b", "a", ""])) for c in range(400) for t in range(r.randrange(1, 7))]
    rows = [x for x in rows if x[0] % 60]  # some families have no first conversation
    assert found(spark, rows) == brute(conversations(rows))


def test_branches_that_hang_from_branches(spark):
    """Conversations that leave each other late: several rounds; and one of very many turns."""
    rows, way = [], [("user", f"w{i} w") for i in range(60)]
    for c in range(12):
        cut = 60 - 4 * c
        rows += [(20 * c, t, *x) for t, x in enumerate([*way[:cut], *[("user", f"{c} {k}") for k in range(3 * c)]])]
    rows += [(999 * 20, t, "user", f"long {t}") for t in range(1500)]
    assert found(spark, rows) == brute(conversations(rows))


def test_odd_rows(spark):
    rows = [(None, 1, "user", "no id"), (None, None, None, None), (0, None, "user", "null first"), (0, 0, "user", "then"), (7, 5, "user", "x"), (40, 0, None, "a  b\n"), (41, 0, "", "a  b\n"), (43, 3, "z", None), (50, 0, "u", "v"), (50, 1, "u", "v"), (50, 1, "u", "v")]
    assert found(spark, rows) == brute(conversations(rows))


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    turns, convs = prefixtrie.rebuilt(staged(prefixtrie.read_turns(df)))
    assert prefixtrie.trie(turns, convs).collect() == []


def test_a_node_of_many_members(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "PIECE", 100)
    rows = [(20 * c, 0, "user", "same") for c in range(3000)]
    assert found(spark, rows) == brute(conversations(rows))
