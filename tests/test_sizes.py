"""What keeps steps bounded on larger tables: how rows are dealt, what is parsed once, what is never broadcast."""

from __future__ import annotations

from ironsieve.operators import graph as gr
from ironsieve.operators import spans
from ironsieve.plans import code as pc
from ironsieve.plans import graph as pg
from ironsieve.session import spread
from ironsieve.sources.code import parsed_files


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_splits_are_spread(spark):
    few = spark.range(100).coalesce(1)
    assert spread(few).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def graph_of(spark, n: int = 3):
    text = "export function handleOne(q) {\n  return executeRaw(q);\n}\nfunction executeRaw(s) {\n  return s;\n}\n"
    files = spark.createDataFrame([(f"p{i}", f"src/h{i}.ts", "typescript", text) for i in range(n)], "project string, file string, language string, text string")
    return gr.build(parsed_files(files))


def test_files_are_parsed_once(spark):
    g = graph_of(spark)
    assert not any("MapInPandas" in plan_of(df) for df in g.values())


def test_parsed_rows_are_not_broadcast(spark):
    g = graph_of(spark)
    assert g["calls"].count() == 3
    assert "Broadcast" not in plan_of(g["calls"])


def test_tokens_are_made_once_and_dealt_by_file(spark):
    files = spark.createDataFrame([("a.ts", "f(x, [1]); // y\n", "typescript")], "file string, text string, _lang string")
    plan = plan_of(spans.code_spans(files))
    assert plan.count("Generate ") == 1
    assert "REPARTITION_BY_NUM" in plan  # which Spark joins to fewer tasks for no size


def test_composed_files_are_dealt(spark):
    sf = "/root/testdata/sf0.001"
    assert all("REPARTITION_BY_NUM" in plan_of(df) for df in (pc.code_files(spark, sf), pc.code_spans(spark, sf)))
    assert pg.parsed_parts(spark, sf)["functions"].count() == 2 * spark.read.parquet(f"{sf}/part.parquet").count() + spark.read.parquet(f"{sf}/part.parquet").select("p_brand").distinct().count()


def calls_of(spark, pairs):
    names = sorted({x for pair in pairs for x in pair})
    functions = spark.createDataFrame([(n, n, "src/api/r.ts", i, n.startswith("handle") and n.endswith("1"), True) for i, n in enumerate(names)], "id string, name string, file_path string, seq long, is_exported boolean, is_async boolean")
    rows = [(i, a, a, b, b, None) for i, (a, b) in enumerate(pairs)]
    return functions, spark.createDataFrame(rows, "seq long, caller_id string, caller_name string, callee_id string, callee_name string, receiver string")


def test_searches_follow_only_calls_that_lead_to_sinks(spark, monkeypatch):
    pairs = [("handle1", "step"), ("step", "low"), ("low", "execSync"), ("low", "step"), *[(x, f"leaf{i}") for i in range(50) for x in ("handle1", "step")]]
    functions, calls = calls_of(spark, pairs)
    given, walk = [], gr._walk
    monkeypatch.setattr(gr, "_walk", lambda starts, edges, *a: given.append(edges.count()) or walk(starts, edges, *a))
    found = [(r.entry, r.sink, r.path) for r in gr.attack_paths(calls, functions).collect()]
    assert found == [("handle1", "execSync", ["handle1", "step", "low", "execSync"])]
    assert given == [4]


def test_calls_are_kept_as_numbers(spark):
    """The checkpoint of a call graph has no text: names and ids follow from the numbers."""
    _, calls = pg.call_graph(spark, "/root/testdata/sf0.001")
    kept = plan_of(calls).split("Scan ExistingRDD")[1].split("]")[0]
    assert kept.count("#") == 3
