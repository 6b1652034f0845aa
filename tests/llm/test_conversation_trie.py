import hashlib
import random
import re
import zlib

import pytest

from ironsieve.llm import lcp_merge
from ironsieve.llm.conversation_trie import conversation_trie
from ironsieve.llm.lcp_merge import LoserTree, Record, common, merged, sorted_run

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            turns.setdefault(c, []).append((turn is not None, turn or 0, tie, (role, text)))
    turns = {c: [x[3] for x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = turns.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[h:]
    members, ends = {}, {}
    for c, t in built.items():
        ends.setdefault(tuple(t), []).append(c)
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        own = (len(m) - 1) * len(WORD.findall(node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += own
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], sha(ends.get(n, []))) for n, m in members.items()), key=repr)


def told(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=repr)


SCHEMA = "conv_id long, turn long, role string, text string, node string, key int, words string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)


def some_rows(seed, convs=120, longest=9):
    r, rows = random.Random(seed), []
    for c in r.sample(range(-40, 400), convs):
        for t in range(r.randrange(longest)):
            rows.append((c, t, r.choice(["user", "assistant"]), r.choice(["a b", "c", "d  e\nf", ""])))
    return rows


@pytest.mark.parametrize("segment,ranges", [(1024, None), (3, 7), (1, 2)])
def test_against_brute_force(spark, segment, ranges):
    rows = some_rows(segment)
    rows += [(c, t, "user", f"same {t}") for c in range(500, 560) for t in range(7)]  # copies
    rows += [(None, 1, "user", "no id"), (900, None, None, None), (900, None, "user", "b"), (900, 3, "a", "x"), (900, 3, "b", "x"), (900, 3, "b", "x"), (900, 3, "", "bx")]
    rows += [(910, 1, "1:user", "x"), (911, 1, "1", ":userx"), (912, 1, "user", "é ü \x1c z")]
    assert told(conversation_trie(frame(spark, rows), segment=segment, ranges=ranges)) == brute(rows)


def test_one_long_conversation_and_long_texts(spark):
    rows = [(7, t, "user", f"w{t % 3}") for t in range(700)] + [(8, t, "user", f"w{t % 3}") for t in range(650)] + [(9, 0, "user", "x " * 200_000), (10, 0, "user", None)]
    assert told(conversation_trie(frame(spark, rows), segment=256, ranges=3)) == brute(rows)


def test_empty_table_and_turnless_conversations(spark):
    assert conversation_trie(frame(spark, [(1, 1, "a", "b")]).limit(0)).collect() == []
    gone = [c for c in range(1, 60) if c % 20 and zlib.crc32(str(c).encode()) % 4 > 0][:5]
    rows = [(c, 0, "user", "only") for c in gone]  # the conversations that lead them are absent
    assert told(conversation_trie(frame(spark, rows))) == brute(rows)
    assert len(brute(rows)) == 1


def test_runs_and_blocks_of_any_size(spark, monkeypatch):
    r = random.Random(5)
    records = [Record(bytes(lcp_merge.UNIT) + b"".join(r.choice([b"a", b"b"]) * lcp_merge.UNIT for _ in range(r.randrange(12))), [], 1, i) for i in range(3000)]
    records = list({x.key: x for x in records}.values())
    runs = [list(sorted_run(records[i::7])) for i in range(7)]
    blocks = [(k, run[i][1].key, run[i : i + 5]) for k, run in enumerate(runs) for i in range(0, len(run), 5)]
    tree = LoserTree()
    got = list(merged(sorted(blocks, key=lambda b: b[1]), tree))
    keys = sorted(x.key for x in records)
    assert [x.key for _, x in got] == keys
    assert [lcp for lcp, _ in got] == [0] + [common(a, b) for a, b in zip(keys, keys[1:])]


def test_shared_units_are_not_compared_again():
    shared = bytes(range(16)) * 200
    runs = [list(sorted_run([Record(shared + bytes([i, k]) * 8, [], 1, 0) for i in range(250)])) for k in range(8)]
    tree = LoserTree()
    out = list(merged([(k, run[0][1].key, run) for k, run in enumerate(runs)], tree))
    assert len(out) == 2000 and tree.compared < 4 * len(out) + 8 * 201 * 8
