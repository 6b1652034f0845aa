"""Readers and writers over real folders."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from ironsieve.functions import imports as im
from ironsieve.operators import dispatch as ds
from ironsieve.operators import events as ev
from ironsieve.operators import findings as fd
from ironsieve.operators.dependencies import recommended
from ironsieve.operators.graph import auth_findings
from ironsieve.sources import files as src
from ironsieve.sources import sinks


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("up") / "build" / "project"  # the root itself is inside a skipped name
    texts = {
        "src/a.ts": b"export const a = 1;",
        "src/lib/b.py": b"b = 1\n",
        "src/latin.js": "x = 'caf\xe9'".encode("latin-1"),
        "dist/c.ts": b"c",
        "out/d.ts": b"d",
        "node_modules/e/e.js": b"e",
        "readme.md": b"# r",
        "big.rb": b"#" * 600_000,
        "small.rb": b"puts 1",
        "maps/z.js.map": b"{}",
        "maps/a.js.map": b"{}",
        "node_modules/e/e.js.map": b"{}",
        ".git/config": b"x",
    }
    for name, data in texts.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    return str(root)


def names(df, column="file"):
    return sorted(r[column] for r in df.collect())


def test_walks(spark, folder):
    files = src.project_files(spark, folder)
    assert names(files) == ["out/d.ts", "src/a.ts", "src/lib/b.py"]
    assert {r.file: r.language for r in files.collect()}["src/lib/b.py"] == "python"
    assert names(src.project_files(spark, f"file://{folder}/", largest=7)) == ["out/d.ts", "src/lib/b.py"]
    assert names(src.call_map_files(spark, folder)) == ["src/a.ts"]
    assert names(src.audit_files(spark, folder)) == ["out/d.ts", "small.rb", "src/a.ts", "src/lib/b.py"]
    assert src.count_files(spark, folder) == 10
    assert [r.file for r in src.source_maps(spark, folder).collect()] == ["maps/a.js.map", "maps/z.js.map"]


def test_path_sets(spark):
    files = spark.createDataFrame([(x,) for x in ("a.ts", "gen/b.ts", "gen/deep/c.ts", "src/gen/d.ts")], "file string")
    ignored = spark.createDataFrame([("gen/",), ("a.tsx",), ("src/gen/d.ts",)], "file string")
    assert names(src.not_ignored(files, ignored)) == ["a.ts"]
    assert names(src.selected(files, ["**/*.ts"], ["gen/**"])) == ["a.ts", "src/gen/d.ts"]


def test_pull_requests(spark):
    packed = base64.b64encode("é = 1\n".encode()).decode()
    rows = [("a", "added", packed[:5] + "\n" + packed[5:]), ("b", "modified", "not base64!"), ("c", "removed", packed), ("d", None, ""), ("e", "added", None)]
    got = {r.file: r.text for r in src.pull_request_files(spark.createDataFrame(rows, "filename string, status string, content string")).collect()}
    assert got == {"a": "é = 1\n", "b": "not base64!", "d": "", "e": None}


def test_environment(spark):
    rows = [
        ("home/.cursor/mcp.json", "{}"), ("p/.mcp.json", "{}"), ("p/.claude/settings.json", json.dumps({"hooks": {"Stop": [{"matcher": "", "hooks": [{"type": "command", "command": "curl x"}]}]}})),
        ("p/.claude/commands/deep/x.md", "run"), ("p/CLAUDE.md", "text"), ("p/.cursorrules", "text"), ("p/src/a.ts", "x"), ("p/AGENTS.md", None), ("p/.claude/settings.local.json", "{broken"),
    ]
    found = src.environment_files(spark.createDataFrame(rows, "file string, text string"))
    kinds = {r.location: r.kind for r in found.collect()}
    assert kinds == {"home/.cursor/mcp.json": "mcp_json", "p/.mcp.json": "mcp_json", "p/.claude/settings.json": "settings_json", "p/.claude/settings.local.json": "settings_json", "p/.claude/commands/deep/x.md": "command_file", "p/CLAUDE.md": "instructions_md", "p/.cursorrules": "instructions_md"}
    assert [(r.location, r.content) for r in src.hooks(found.where("kind = 'settings_json'")).collect()] == [("p/.claude/settings.json (hooks.Stop)", "curl x")]


def test_reports(spark):
    leak = json.dumps([{"RuleID": "aws", "File": "a.ts", "StartLine": 3, "Description": "A key"}])
    got = src.gitleaks_findings(spark.createDataFrame([(leak,), ("{",), (None,)], "report string")).collect()
    assert [(r.id, r.severity, r.type, r.file, r.line, r.auto_fixable) for r in got] == [("aws", "critical", "hardcoded_secret", "a.ts", 3, True)]


def test_writers_and_baseline(spark, tmp_path):
    f = spark.createDataFrame([("R1", "high", "t", "a.ts", 1, "d", None, False), ("R2", "low", "t", "b.ts", 2, "d", "env-example", True)], "id string, severity string, type string, file string, line int, description string, context string, auto_fixable boolean")
    sinks.save_summary(f, f"{tmp_path}/summary")
    one = spark.read.json(f"{tmp_path}/summary").collect()
    assert len(one) == 1 and (one[0].high, one[0].low, one[0].score, one[0].status) == (1, 1, "D", "fail")
    assert src.baseline(spark, f"{tmp_path}/none").collect() == []
    sinks.save_baseline(f.where("id = 'R1'"), f"{tmp_path}/base")
    sinks.save_baseline(f.where("id = 'R2'"), f"{tmp_path}/base")  # overwrites
    assert names(fd.not_in_baseline(fd.fingerprinted(f), src.baseline(spark, f"{tmp_path}/base")), "id") == ["R1"]
    (tmp_path / "odd.json").write_text('{"other": 1}\n')
    assert src.baseline(spark, f"{tmp_path}/odd.json").collect() == []
    sinks.save_report(f, f"{tmp_path}/report")
    assert [r.id for r in spark.read.json(f"{tmp_path}/report").collect()] == ["R1", "R2"]
    rows = spark.createDataFrame([("p", 1), ("q", 2)], "project_id string, v int")
    sinks.append(rows, f"{tmp_path}/t")
    sinks.append(rows, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 4
    assert spark.read.parquet(sinks.replace_table(rows, f"{tmp_path}/v", "2")).count() == 2


def test_whole_scan(spark):
    one = spark.createDataFrame([("p", "R1", "a.ts", 1, "t", "d", "high"), ("p", "R2", "tests/a.ts", 1, "t", "d", "low"), ("q", "CSRF", "b.ts", 4, "t", "x", "low")], "project string, id string, file string, line int, type string, description string, severity string")
    two = one.where("id = 'R1'").withColumn("id", F.lit("COPY"))
    graph = one.where("id = 'R1'").withColumn("id", F.lit("kg"))
    assert names(fd.whole_scan([one, two], graph), "id") == ["CSRF", "R1", "R2", "kg"]  # the graph's are no copies
    gates = spark.createDataFrame([("CSRF", "nextjs")], "id string, framework string"), spark.createDataFrame([("q", "nextjs")], "project string, framework string")
    base = fd.fingerprinted(one.where("id = 'R1'"))
    got = fd.whole_scan([one, two], None, gates, ~F.startswith(F.col("file"), F.lit("tests/")), baseline=base)
    assert names(got, "id") == []
    got = fd.running_ids(one, "n-", ["file", "line"], "number")
    assert [(r.file, r.number) for r in got.orderBy("file").collect()] == [("a.ts", "n-1"), ("b.ts", "n-2"), ("tests/a.ts", "n-3")]
    many = fd.running_ids(spark.range(5000).withColumn("k", F.col("id") % 100), "", ["k", "id"], "number")
    assert many.agg(F.countDistinct("number"), F.max(F.col("number").cast("int"))).first() == (5000, 5000)
    handlers = spark.createDataFrame([("x", "handleX", "a.ts", 3)], "id string, name string, file_path string, start_line int")
    assert auth_findings(handlers).first().severity == "high"


def test_operations(spark):
    maps = [("p", "r", "a.js", "{}"), ("p", "r", "../a.js", "{}"), ("p", "", "a.js", "{}"), ("p", "r", "b.js", "x" * (11 << 20))]
    m = spark.createDataFrame(maps, "project_id string, release string, file_path string, content string")
    assert names(ds.valid_maps(m), "file_path") == ["a.js"]
    with pytest.raises(ValueError):
        ds.valid_maps(spark.range(101).select(F.lit("p").alias("project_id"), F.lit("r").alias("release"), F.lit("a").alias("file_path"), F.lit("").alias("content")))
    g = spark.createDataFrame([("e1", "p", "high", "open", "2024-01-01T00:00:00Z", 3), ("e2", "p", "low", "resolved", "2024-01-02T00:00:00Z", 1), ("e1", "q", "low", "open", "2024-01-02T00:00:00Z", 1)], "id string, project_id string, severity string, status string, last_seen string, occurrences long")
    assert names(ds.get_errors(g, "p"), "id") == ["e1"] and names(ds.get_errors(g, "p", status="all"), "id") == ["e1", "e2"]
    with pytest.raises(ValueError):
        ds.get_errors(g, "p", "odd")
    at = F.lit("2024-01-01 12:00:00").cast("timestamp")
    assert [(r.id, r.status) for r in ds.get_status(g, "p", "e1", at).collect()] == [("e1", "recurring")]
    t = spark.createDataFrame([("p", str(i), f"2024-01-0{i}", "/a" if i % 2 else "/b") for i in range(1, 6)], "project_id string, id string, timestamp string, url string")
    assert [r.id for r in ds.get_metrics(t, "p", "url", "/a", 2).collect()] == ["5", "3"]
    told = {r.key: (r.valid, r.tier, r.projects) for r in ds.licences(spark.createDataFrame([("SS-AGENCY-abcd1234",), ("XX-PRO-AAAAAAAA",), ("SS-PRO-short",), (None,)], "key string"), "2024-01-01").collect()}
    assert told == {"SS-AGENCY-abcd1234": (True, "agency", 100), "XX-PRO-AAAAAAAA": (False, None, None), "SS-PRO-short": (False, None, None), None: (False, None, None)}
    events = spark.createDataFrame([(1, "a")], "seq long, url string")
    with pytest.raises(ValueError):
        ev.before_send(events, lambda e: e.drop("url"))
    d = spark.createDataFrame([("Django==4\n",), ("import FastAPI",), (None,)], "t string").select(im.python_framework(F.col("t")).alias("f"))
    assert [r.f for r in d.collect()] == ["django", "fastapi", None]
    p = spark.createDataFrame([("a", "hono", True), ("b", "fastify", False)], "project string, framework string, kept boolean")
    have = spark.createDataFrame([("b", "@fastify/helmet")], "project string, name string")
    assert {(r.project, r.kind) for r in recommended(p, have, F.col("kept")).collect()} == {("a", "missing_cors"), ("a", "missing_csp"), ("b", "missing_cors"), ("b", "missing_rate_limit"), ("b", "missing_env_config")}
