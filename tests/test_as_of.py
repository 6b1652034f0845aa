"""Rate limits, source maps, lookalikes and ignore rules: as-of and hash joins instead of sequential or theta work."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ironsieve.operators.dependencies import lookalikes_among
from ironsieve.operators.prefix import carried
from ironsieve.operators.rate_limits import rate_limited
from ironsieve.operators.sourcemaps import decoded, resolve_frames
from ironsieve.sources.files import ignored, ignored_by_rules


def test_carried_values_over_ranges(spark):
    r = random.Random(2)
    rows = [(r.choice(["hot", "hot", "b", None]), i, r.randrange(9) if r.random() < 0.1 else None) for i in range(600)]
    got = {x.o: x.last for x in carried(spark.createDataFrame(rows, "k string, o int, v int").repartition(4), ["k"], ["o"], {"last": F.col("v")}, 7).collect()}
    last, want = {}, {}
    for k, o, v in rows:
        last[k] = v if v is not None else last.get(k)
        want[o] = last[k]
    assert got == want


def limits_one_by_one(rows, most, window):
    state, out = {}, {}
    for p, at, seq in sorted(rows, key=lambda x: (x[0] or "anonymous", x[1], x[2])):
        p = p or "anonymous"
        count, reset = state.get(p, (0, None))
        if reset is None or at >= reset:
            count, reset = 0, at + window
        state[p] = count + 1, reset
        out[seq] = (p, count + 1 <= most, max(0, most - count - 1), reset)
    return out


def test_limits_of_a_hot_project(spark):
    r = random.Random(4)
    times, rows = 0, []
    for i in range(4000):
        times += r.choice([0, 0, 1, 3, 40])
        rows.append(("hot" if r.random() < 0.9 else r.choice(["a", None]), times, i))
    df = spark.createDataFrame(rows, "project_id string, at_ms long, seq long").repartition(5)
    want = limits_one_by_one(rows, 6, 50)
    for in_order in (0, 500, 10_000):  # all by doubling, the hot project only, none
        got = rate_limited(df, 6, 50, ranges=8, in_order=in_order)
        assert {x.seq: (x.project_id, x.allowed, x.remaining, x.reset_ms) for x in got.collect()} == want
    assert rate_limited(df.limit(0)).collect() == []


def test_no_task_has_the_whole_hot_project(spark):
    rows = spark.range(40_000).select(F.lit("one").alias("project_id"), (F.col("id") * 7).alias("at_ms"), F.col("id").alias("seq"))
    got = rate_limited(rows, 3, 100, ranges=8, in_order=1000).where("project_id = 'one'")
    sizes = [x["count"] for x in got.groupBy(F.spark_partition_id()).count().collect()]
    sizes = [x for x in sizes if x]
    assert sum(sizes) == 40_000 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]


MAP = json.dumps({"version": 3, "sources": ["node_modules/a.js", "/../src//b.ts", "c.ts"], "names": ["f", "g"], "mappings": "AAAA,UCIGA;IAIH,M;;ACAAC"})


def test_segments_of_a_map():
    assert [x[:2] + x[3:] for x in decoded(MAP)] == [
        (0, 0, "/../src//b.ts", None, None, None),
        (1, 0, "node_modules/a.js", 1, 0, None),
        (1, 10, "/../src//b.ts", 5, 3, "f"),
        (2, 4, "/../src//b.ts", 9, 0, None),
        (2, 10, None, None, None, None),
        (4, 0, "c.ts", 9, 0, "g"),
    ]
    assert list(decoded(None)) == list(decoded("x")) == list(decoded("{}")) == []
    assert [x[3] for x in decoded('{"sources":["a"],"mappings":"!"}')] == ["a"]


@pytest.mark.parametrize("ranges", [None, 6])
def test_frames_by_segments(spark, ranges):
    maps = [("p", "r", "x.js.map", MAP), ("p", "r", "x.js", "{}"), ("p", "r", "y.js", '{"sources":["node_modules/q.js"]}'), ("p", "r", "z.js", "broken"), ("p", "r", "unused.js", MAP)]
    frames = [(i, "p", "r", "x.js", line, column) for i, (line, column) in enumerate([(1, 0), (1, 9), (1, 10), (1, 500), (2, 3), (2, 5), (2, 11), (3, 0), (4, 7), (1, None)])]
    frames += [(20, "p", "r", "y.js", 3, 1), (21, "p", "r", "z.js", 4, 1), (22, "p", None, "x.js", 5, 1), (23, "q", "r", "x.js", 6, 1)] + [(100 + i, "p", "r", "x.js", 1, 11) for i in range(300)]
    f = spark.createDataFrame(frames, "id long, project_id string, release string, file string, line int, column int").repartition(3)
    got = {x.id: tuple(x[6:]) for x in resolve_frames(f, spark.createDataFrame(maps, "project_id string, release string, file_path string, content string"), ranges).collect()}
    rest = lambda line: ("src/b.ts", line, None, None)
    want = {0: rest(1), 1: rest(1), 2: ("src/b.ts", 5, 3, "f"), 3: ("src/b.ts", 5, 3, "f"), 4: rest(2), 5: ("src/b.ts", 9, 0, None), 6: rest(2), 7: rest(3), 8: ("c.ts", 9, 0, "g"), 9: rest(1)}
    want |= {20: ("y.js", 3, None, None), 21: ("z.js", 4, None, None), 22: ("x.js", 5, None, None), 23: ("x.js", 6, None, None)} | {100 + i: ("src/b.ts", 5, 3, "f") for i in range(300)}
    assert got == want


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lookalikes_among_a_registry(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcD-") for _ in range(r.randrange(0, 8)))
    known = list(dict.fromkeys(word() for _ in range(150)))
    names = [word() for _ in range(300)] + ["@s/fine", None]
    fine = ["fine", "abc"]
    df = lookalikes_among(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(list(zip(known, range(150))), "name string, place int"), spark.createDataFrame([(x,) for x in fine], "name string"))
    want = {}
    for n in set(names) - {None}:
        low = n.lower()
        if low in known or low in fine or low.split("/")[-1] in fine and low.startswith("@"):
            continue
        near = [k for k in known if 1 <= edits(low, k.lower()) <= 2]
        if near:
            want[n] = near[0]
    assert {x.name: x.similar_to for x in df.collect()} == want
    plan = df._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_ignore_rules_as_rows(spark):
    r = random.Random(8)
    parts = ["src", "a", "b.log", "node_modules", "x.min.js", "Docs", "gen1.ts", "tmp"]
    paths = list({"/".join(r.choice(parts) for _ in range(r.randrange(1, 5))) for _ in range(120)})
    lines = ["*.log", "!a/b.log", "/src/", "docs", "node_modules/", "**/tmp/*.js", "src/**", "!src/a", "gen?.ts", "# no", "", "a/*/tmp", "*.min.js", "!*", "***/x", " tmp ", "!/src/tmp/", "**", "[a].log", "x.*"]
    for trial in range(3):
        mine = {p: r.sample(lines, 8) for p in ("p", "q")}
        rules = [(p, i, x) for p, own in mine.items() for i, x in enumerate(own)]
        files = spark.createDataFrame([(p, f) for p in mine for f in paths] + [("p", None)], "project string, file string")
        got = {tuple(x) for x in ignored_by_rules(files, spark.createDataFrame(rules, "project string, no int, line string")).collect()}
        want = {(p, x.file) for p, own in mine.items() for x in files.where(f"project = '{p}' and file is not null").where(ignored(F.col("file"), own)).collect()}
        assert got == want, (trial, mine)
