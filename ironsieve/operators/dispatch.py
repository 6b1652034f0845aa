"""Named questions about a code graph, and the operations of the event service, as functions of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ironsieve.functions.text import safe_path
from ironsieve.operators import events as ev
from ironsieve.operators import graph as gr

LARGEST_MAP, MAPS_AT_ONCE = 10 * 1024 * 1024, 100
# fixed values: projects by licence tier
TIERS = {"FREE": 1, "PRO": 5, "TEAM": 20, "AGENCY": 100}


def ask(graph: dict[str, DataFrame], question: str, name: str | None = None, depth: int | None = None) -> DataFrame:
    """callers, callees (3 steps), data_flow (both, 5 steps), attack_paths, blast_radius, auth_chain."""
    calls, functions = graph["calls"], graph["functions"]
    if question in ("callers", "callees"):
        return getattr(gr, question)(calls, functions, name, depth or 3)
    if question == "data_flow":
        up = gr.callers(calls, functions, name, depth or 5).withColumn("side", F.lit("caller"))
        return up.unionByName(gr.callees(calls, functions, name, depth or 5).withColumn("side", F.lit("callee")))
    if question == "attack_paths":
        return gr.attack_paths(calls, functions, depth or 5)
    if question == "blast_radius":
        return gr.blast_radius(calls, functions, name, depth or 10)
    if question == "auth_chain":
        return gr.missing_auth(calls, functions, depth or 10)
    raise ValueError(f"no such question: {question}")


def shape(graph: dict[str, DataFrame], what: str, name: str | None = None) -> DataFrame:
    """The patterns of nodes and edges that can be listed, each with an optional name."""
    f, c, e, i, m = (graph[t] for t in ("functions", "classes", "calls", "imports", "methods"))
    tables = {
        "functions": (f, "name"),
        "classes": (c, "name"),
        "files": (f.select("file_path").unionByName(c.select("file_path")).unionByName(i.select("file_path")).distinct(), "file_path"),
        "nodes": (f.select("id").unionByName(c.select("id")).agg(F.count(F.lit(1)).alias("total")), None),
        "calls": (e.select("caller_name", "callee_name", "file"), "caller_name"),
        "contains": (graph["contains"], "file_path"),
        "contains_class": (c.select("file_path", "name"), "file_path"),
        "has_method": (m, "class_name"),
        "imports": (i, "module"),
        "modules": (i.select("module").distinct(), "module"),
    }
    table, key = tables[what]
    return table if name is None or key is None else table.where(F.col(key) == name)


def get_errors(groups: DataFrame, project: str, severity: str | None = None, status: str = "open") -> DataFrame:
    if severity not in (None, "critical", "high", "medium", "low", "info") or status not in ("open", "resolved", "all"):
        raise ValueError("no such severity or status")
    return ev.list_errors(groups.where(F.col("project_id") == project), status, severity)


def get_status(groups: DataFrame, project: str, error: str, now) -> DataFrame:
    return ev.error_status(groups.where((F.col("project_id") == project) & (F.col("id") == error)), now)


def get_metrics(metrics: DataFrame, project: str, by: str | None = None, value: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest first, of one url or path, at most ``limit``."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be a positive number")
    rows = metrics.where(F.col("project_id") == project)
    return ev.newest(rows.where(F.col(by) == value) if by and value else rows, limit)


def valid_maps(maps: DataFrame) -> DataFrame:
    """Source maps that may be stored: safe paths, contents of at most 10 MiB. A batch over its limit is refused whole."""
    if maps.limit(MAPS_AT_ONCE + 1).count() > MAPS_AT_ONCE:
        raise ValueError("too many source maps at once")
    fine = safe_path(F.col("file_path")) & (F.octet_length("content") <= LARGEST_MAP)
    return maps.where(fine & (F.col("project_id") != "") & (F.col("release") != ""))


def licences(keys: DataFrame, today: str) -> DataFrame:
    """(key, valid, tier, projects, expires) of licence keys ``SS-TIER-`` and eight or more letters or digits."""
    tier = F.regexp_extract("key", r"^SS-(FREE|PRO|TEAM|AGENCY)-[A-Za-z0-9]{8,}$", 1)
    valid = F.coalesce(tier != "", F.lit(False))
    projects = F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv])
    return keys.select("key", valid.alias("valid"), F.when(valid, F.lower(tier)).alias("tier"), F.try_element_at(projects, tier).alias("projects"), F.add_months(F.lit(today).cast("date"), 12).alias("expires"))
