import pytest
from pyspark.sql import functions as F

from ironsieve.functions.sourcemap import resolve, resolved, segments
from ironsieve.operators import graph as gr
from ironsieve.operators.dispatch import ask, shape
from ironsieve.sources.code import parse_python, parse_script, parsed_files

HANDLER = """
import { find, drop as gone } from './db';
import express from "express";
// function commented() { hidden() }
export async function handleGet(req, res) {
  checkInput(req);
  return find(req.id);
}
export const handleDrop = async (req) => { return db.executeRaw("x(y)"); };
class Repo {
  constructor(pool) { this.pool = pool; }
  async load(id) { return this.pool.query(id); }
}
function checkInput(x) { return validate(x); }
function validate(x) { return x; }
export { Repo };
"""
DB = """
export function find(id) { return executeQuery('select ' + id); }
export function executeQuery(sql) { return sql; }
export function executeRaw(sql) { return sql; }
function getRequestBody() { return 1; }
export function processForm() { const b = getRequestBody(); return build(b); }
function build(b) { return executeQuery(b); }
export async function routeSafe() { requireAuth(); const b = getRequestBody(); return executeRaw(b); }
function requireAuth() {}
"""


def test_script():
    p = parse_script(HANDLER)
    f = {x["name"]: x for x in p["functions"]}
    assert [x["name"] for x in p["functions"]] == ["constructor", "load", "handleGet", "checkInput", "validate", "handleDrop"]
    assert f["handleGet"]["is_async"] and f["handleGet"]["is_exported"] and f["handleGet"]["params"] == ["req", "res"] and f["handleDrop"]["is_async"]
    assert f["load"]["class_name"] == "Repo" and f["load"]["is_exported"] and not f["validate"]["is_exported"]
    calls = {(c["caller_name"], c["callee_name"], c["receiver"]) for c in p["call_sites"]}
    assert {("handleGet", "checkInput", None), ("handleGet", "find", None), ("handleDrop", "executeRaw", "db"), ("load", "query", "pool"), ("checkInput", "validate", None)} <= calls
    assert not any("hidden" in c or c[1] == "y" for c in calls)
    assert [(i["source"], i["specifiers"]) for i in p["imports"]] == [("./db", ["find", "drop"]), ("express", ["express"])]
    assert {e["name"] for e in p["exports"]} == {"handleGet", "handleDrop", "Repo"}


def test_python():
    p = parse_python("import os\nfrom .a import b\nclass C:\n    async def m(self, x):\n        os.system(x)\n        b(x)\ndef f():\n    C().m(1)\nf()\n")
    assert [(x["name"], x["class_name"], x["is_async"]) for x in p["functions"]] == [("m", "C", True), ("f", None, False)]
    assert {(c["caller_name"], c["callee_name"], c["receiver"]) for c in p["call_sites"]} == {("m", "system", "os"), ("m", "b", None), ("f", "m", None), ("f", "C", None)}
    assert [i["source"] for i in p["imports"]] == ["os", ".a"]


@pytest.fixture(scope="module")
def graph(spark):
    files = [("src/api/handler.ts", "typescript", HANDLER), ("src/db.ts", "typescript", DB), ("bad.py", "python", "def ("), ("none.py", "python", None)]
    parsed = parsed_files(spark.createDataFrame(files, "file string, language string, text string"))
    g = gr.build(parsed)
    return {k: v.cache() for k, v in g.items()}


def names(df, col="node"):
    return {r[col].rsplit("::", 1)[-1] for r in df.collect()}


def test_questions(graph):
    assert names(ask(graph, "callers", "executeQuery", 1)) == {"find", "build"}
    assert names(ask(graph, "callers", "executeQuery", 9)) == {"find", "build", "handleGet", "processForm"}
    assert names(ask(graph, "callees", "handleGet", 1)) == {"checkInput", "find"}
    radius = {r.name: r.is_entry for r in ask(graph, "blast_radius", "executeQuery").collect()}
    assert radius == {"find": False, "build": False, "processForm": False, "handleGet": True}
    paths = {(r.entry, r.sink, r.has_validation, tuple(r.path)) for r in ask(graph, "attack_paths").collect()}
    assert ("handleGet", "executeQuery", False, ("handleGet", "find", "executeQuery")) in paths
    assert ("handleDrop", "executeRaw", False, ("handleDrop", "executeRaw")) in paths
    assert names(ask(graph, "auth_chain"), "id") == {"handleGet", "handleDrop"}
    with pytest.raises(ValueError):
        ask(graph, "nothing")


def test_flows(graph):
    flows = {(r.source, r.sink): (r.path, r.has_sanitization) for r in gr.data_flows(graph["calls"], graph["functions"]).collect()}
    assert flows["getRequestBody", "executeQuery"][0] == ["getRequestBody", "processForm", "build", "executeQuery"]
    assert flows["getRequestBody", "executeRaw"] == (["getRequestBody", "routeSafe", "executeRaw"], False)


def test_shapes(graph):
    assert shape(graph, "functions", "find").count() == 1 and shape(graph, "classes").count() == 1
    assert {r.name for r in shape(graph, "has_method", "Repo").collect()} == {"constructor", "load"}
    assert {r.module for r in shape(graph, "modules").collect()} == {"./db", "express"}
    assert shape(graph, "nodes").first().total == 15 and shape(graph, "files").count() == 2
    found = gr.path_findings(ask(graph, "attack_paths"))
    assert {r.severity for r in found.collect()} == {"high"}


def test_cycles_end(spark):
    e = spark.createDataFrame([(1, "a", "a", "b", "b"), (2, "b", "b", "a", "a"), (3, "b", "b", "c", "c")], "seq long, caller_id string, caller_name string, callee_id string, callee_name string")
    f = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "c")], "id string, name string")
    assert names(gr.callees(e, f, "a", 10)) == {"b", "c"} and names(gr.callers(e, f, "c", 10)) == {"a", "b"}


def test_source_maps(spark):
    assert segments("AAIA") == [0, 0, 4, 0] and segments("gB") == [16]
    content = '{"version":3,"sources":["node_modules/a.js","src/b.ts"],"mappings":";ACIA,IAAA"}'
    assert resolve(content, 2, 0) == ("src/b.ts", 5) and resolve(content, 2, 9) == ("src/b.ts", 5)
    assert resolve(content, 2, None) == ("src/b.ts", 2) and resolve(content, 1, 5) == ("src/b.ts", 1) and resolve("{", 3, 1) == (None, 3)
    df = spark.createDataFrame([(content, 2, 0), (None, 1, None)], "c string, l int, k int").select(resolved("c", "l", "k").alias("r")).select("r.*")
    assert [tuple(r) for r in df.collect()] == [("src/b.ts", 5), (None, 1)]
    assert df.select(F.col("line")).count() == 2


def test_depth_of_the_registered_questions(spark):
    from ironsieve.plans import graph as plan

    chain = ["handleOrder", "stepB", "stepC", "stepD", "stepE", "executeRaw"]
    guarded = ["authGate", "hopB", "hopC", "hopD", "hopE", "target", "tailB", "tailC", "tailD", "tailE", "validateAll", "beyond"]
    fns = [(n, n, i, "src/api/route.ts", n == "handleOrder", True, i) for i, n in enumerate(chain + guarded)]
    calls = [(i, a, a, b, b, None) for i, (a, b) in enumerate([*zip(chain, chain[1:]), *zip(guarded, guarded[1:])])]
    f = spark.createDataFrame(fns, "id string, name string, seq long, file_path string, is_exported boolean, is_async boolean, start_line int")
    c = spark.createDataFrame(calls, "seq long, caller_id string, caller_name string, callee_id string, callee_name string, receiver string")
    assert [tuple(r) for r in plan._deep_paths(f, c).collect()] == [("handleOrder", "executeRaw", "database")]
    got = {r.name: (r.auth, r.validated) for r in plan._deep_context(f, c).collect()}
    assert got["target"] == (True, True) and got["tailB"] == (False, True) and got["hopE"] == (True, False)


def test_scripts_with_what_hides_brackets():
    from ironsieve.sources.code import blanked, parse_script

    text = "function f() { const re = /[\"'{]/; return re.test(`a ${run(`b ${deep({k: '}'})}`)} {`); }\nclass A {\n m() { g(async (a) => a / 2 / b()); }\n n() {}\n}\nconst h = async (x) => { k(x) }\n// function no() {}\n"
    got = parse_script(text)
    assert [f["name"] for f in got["functions"]] == ["m", "n", "f", "h"] and got["classes"][0]["methods"] == ["m", "n"]
    assert [(c["caller_name"], c["callee_name"]) for c in got["call_sites"]] == [("f", "test"), ("f", "run"), ("f", "deep"), ("m", "g"), ("m", "b"), ("h", "k")]
    assert len(blanked(text)) == len(text) and blanked(text).count("\n") == text.count("\n")
    assert blanked("a = `x") == "a =   " and blanked("`${a}`}") == "   a  }" and blanked("") == ""


def test_long_scripts_take_linear_time():
    import time

    from ironsieve.sources.code import parse_script

    def took(n):
        text = "\n".join(f"function f{i}(a) {{ return g{i}(a, `x ${{h(a)}}`); }}" for i in range(n))
        began = time.perf_counter()
        assert len(parse_script(text)["call_sites"]) == 2 * n
        return time.perf_counter() - began

    took(1000)
    assert took(16_000) < 8 * took(4_000)


def test_sql_put_together_with_quotes_inside(spark):
    from ironsieve.operators.rulebook import RULES
    from ironsieve.operators.rules import scan_files

    lines = {"a.ts": "q = \"SELECT * FROM t WHERE u = '\" + u + \"'\"", "b.ts": "q = \"INSERT INTO t VALUES ('\" + n + \"')\"", "c.ts": "db.run(`DELETE FROM t WHERE id = ${id}`)", "d.ts": "q = \"SELECT 'a' + 'b' FROM t\""}
    got = {(r.file, r.id) for r in scan_files(spark.createDataFrame(list(lines.items()), "file string, text string"), RULES).collect()}
    assert {("a.ts", "SQL_INJECTION_CONCAT"), ("b.ts", "SQL_INJECTION_CONCAT"), ("c.ts", "SQL_INJECTION_TEMPLATE")} <= got and ("d.ts", "SQL_INJECTION_CONCAT") not in got
