"""The code graph: nodes and edges from parsed files, and bounded breadth-first questions over them.

Traversals advance level by level for all roots at once: join the frontier with the edges, keep the first way to each
new node, drop what was seen. Each level is checkpointed. Discovery order is that of a queue: a node's key is the list
of edge numbers that lead to it, and lists of one level compare as the queue would have met them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ironsieve.functions.text import normal_path
from ironsieve.operators.components import hot_bar, join_by_key
from ironsieve.operators.prefix import places
from ironsieve.session import cut

# fixed values: (kind, method, receivers); no receivers: any. The first kind in this order counts.
_GATED = (
    ("database", "query", "db pool client connection knex sequelize prisma"),
    ("database", "execute", "db pool client connection cursor stmt"),
    ("database", "exec", "db connection"),
    ("database", "run", "db sqlite better-sqlite"),
    ("database", "raw", "knex db"),
    ("database", "find", "collection model db"),
    ("database", "findOne", "collection model db"),
    ("database", "insert", "collection db knex"),
    ("database", "update", "collection db knex"),
    ("database", "delete", "collection db knex"),
)
_SHELL = (
    ("shell", "exec", "child_process cp"),
    ("shell", "execSync", "child_process cp"),
    ("shell", "execSync", ""),
    ("shell", "spawn", "child_process cp"),
    ("shell", "execFile", "child_process cp"),
    ("shell", "execFileSync", ""),
    ("shell", "spawnSync", ""),
)


def _open(kind: str, methods: str) -> tuple[tuple[str, str, str], ...]:
    return tuple((kind, m, "") for m in methods.split())


TAINT_SINKS = (
    *_GATED,
    *_open("database", "executeQuery executeRaw executeSql queryRaw queryRawUnsafe runQuery"),
    *_open("filesystem", "writeFile writeFileSync createWriteStream"),
    *_SHELL,
    *_open("eval", "eval"),
)
ATTACK_SINKS = (
    *_GATED,
    *_open("database", "executeQuery executeRaw executeSql queryRaw queryRawUnsafe $queryRaw $queryRawUnsafe $executeRaw $executeRawUnsafe rawQuery runQuery"),
    *_open("filesystem", "readFile readFileSync writeFile writeFileSync createReadStream createWriteStream unlink unlinkSync"),
    *_SHELL,
    *_open("network", "fetch"),
    ("network", "get", "axios http https got request"),
    ("network", "post", "axios http https got request"),
    ("network", "request", "http https"),
    *_open("eval", "eval Function"),
    ("redirect", "redirect", "res response"),
)
#: So many nodes may be broadcast, some ten MB.
BROADCAST_NODES = 200_000
# fixed values: parts of names
SOURCES = ["parserequest", "getbody", "getrequestbody", "readinput", "parseformdata", "parseinput", "readuserinput"]
SANITIZERS = ["valid", "sanitiz", "escape", "clean", "encode", "parameteriz", "prepare", "guard", "protect"]
VALIDATORS = ["valid", "sanitiz", "escape", "clean", "verify", "auth", "protect", "guard", "middleware"]
HANDLERS = ["handle", "route", "controller", "endpoint"]
VERBS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]
# fixed values: names of guards and of validation, and the rules that they concern
AUTH_CONTEXT = r"(?i)auth|authenticate|protect|guard|verify|authorize|requireAuth|isAuthenticated|withAuth|checkAuth|middleware"
VALIDATION_CONTEXT = r"(?i)validate|sanitize|check|verify|parse|escape|purify|clean|filter|whitelist|allowlist"
AUTH_RULES = ("AUTH_MISSING_AUTH_MIDDLEWARE", "NEXT_API_NO_AUTH", "NEXT_SERVER_ACTION_NO_AUTH")
SQL_RULES = ("SQL_INJECTION_CONCAT", "SQL_INJECTION_TEMPLATE", "SQL_INJECTION_FSTRING", "SQL_INJECTION_FORMAT")
XSS_RULES = ("XSS_DANGEROUSLY_SET_INNERHTML", "XSS_EVAL", "XSS_UNESCAPED_TEMPLATE", "REACT_DANGEROUSLYSETINNERHTML_VARIABLE", "DOM_XSS_INNERHTML_ASSIGN")


def has_any(name: Column, parts: list[str]) -> Column:
    return F.rlike(F.lower(name), F.lit("|".join(parts)))


def is_source(name: Column) -> Column:
    return has_any(name, SOURCES)


def is_entry_point(name: Column, path: Column, exported: Column) -> Column:
    served = F.contains(path, F.lit("/api/")) | F.contains(path, F.lit("/app/"))
    return exported & (
        (served & name.isin(VERBS))
        | F.contains(path, F.lit("/actions/"))
        | F.contains(F.lower(name), F.lit("action"))
        | has_any(name, HANDLERS)
    )


def sink_kind(name: Column, receiver: Column, sinks=TAINT_SINKS) -> Column:
    """The kind of sink that a call is, or null."""
    low, on, out = F.lower(name), F.lower(F.coalesce(receiver, F.lit(""))), F
    for kind, method, receivers in sinks:
        hit = low == method.lower()
        out = out.when(hit & on.isin(receivers.split()) if receivers else hit, kind)
    return out.otherwise(F.lit(None).cast("string"))


def _projects(df: DataFrame) -> DataFrame:
    """With a project column; without one, all rows are of one project."""
    return df if "project" in df.columns else df.withColumn("project", F.lit(""))


def large(df: DataFrame) -> DataFrame:
    """For a join that must not broadcast this side. Spark takes what is parsed from files for as small as the files, so a
    compact table of many files would be sent whole through the driver."""
    return df.hint("merge")


def build(parsed: DataFrame) -> dict[str, DataFrame]:
    """functions, classes, calls, contains, methods, imports, exports, call_sites of parsed files (see
    schemas.PARSED_FILE, and an optional ``project``).

    A call's caller is the first function of that name in the same file; its callee the method ``receiver.callee``
    names, else the first function of that name in the project; calls to what is not defined there have no edge. First
    is by path, then by place in the file (``seq``). Files are parsed once, whatever is asked of the graph.
    """
    parsed = cut(_projects(parsed))
    seq, where = F.struct("file_path", "pos").alias("seq"), F.concat(F.when(F.col("project") != "", F.concat("project", F.lit(":"))).otherwise(""), "file_path", F.lit("::"))
    f = parsed.select("project", "file_path", "language", F.posexplode("functions").alias("pos", "f"))
    member = F.when(F.col("f.class_name").isNotNull(), F.concat(F.col("f.class_name"), F.lit("."), F.col("f.name")))
    functions = f.select(F.concat(where, F.coalesce(member, F.col("f.name"))).alias("id"), "f.*", "project", "file_path", "language", seq)
    c = parsed.select("project", "file_path", F.posexplode("classes").alias("pos", "c"))
    classes = c.select(F.concat(where, F.col("c.name")).alias("id"), "c.*", "project", "file_path", seq)
    s = parsed.select("project", "file_path", F.posexplode("call_sites").alias("pos", "s")).select(seq, "project", "file_path", "s.*")
    row = F.struct("id", "name")
    own = functions.groupBy("project", "file_path", "name").agg(F.min_by("id", "seq").alias("caller_id"))
    method = functions.where("class_name is not null").groupBy("project", "class_name", "name").agg(F.min_by(row, "seq").alias("m"))
    anywhere = functions.groupBy("project", "name").agg(F.min_by(row, "seq").alias("a"))
    calls = (
        s.join(large(own.withColumnRenamed("name", "caller_name")), ["project", "file_path", "caller_name"])
        .join(large(method.select("project", F.col("class_name").alias("receiver"), F.col("name").alias("callee_name"), "m")), ["project", "receiver", "callee_name"], "left")
        .join(large(anywhere.withColumnRenamed("name", "callee_name")), ["project", "callee_name"], "left")
        .withColumn("to", F.coalesce("m", "a"))
        .where("to is not null")
        .select("seq", "project", "caller_id", "caller_name", F.col("to.id").alias("callee_id"), F.col("to.name").alias("callee_name"), "receiver", F.col("file_path").alias("file"), "line")
    )
    imports = parsed.select("project", "file_path", F.explode("imports").alias("i")).select(
        "project", "file_path", F.col("i.source").alias("module"), F.array_join("i.specifiers", ",").alias("specifiers"), "i.line"
    )
    exports = parsed.select("project", "file_path", F.explode("exports").alias("e")).select("project", "file_path", "e.name")
    contains = functions.select("project", "file_path", "id", "name")
    methods = functions.where("class_name is not null").select(
        F.concat(where, F.col("class_name")).alias("class_id"), "class_name", "id", "name", "project"
    )
    return {"functions": functions, "classes": classes, "calls": calls, "contains": contains, "methods": methods, "imports": imports, "exports": exports, "call_sites": s}


def totals(graph: dict[str, DataFrame]) -> DataFrame:
    """One row: functions, classes, and call sites resolved or not."""
    names = ("functions", "classes", "call_sites")
    kinds = [graph[t].select(F.lit(t).alias("kind")) for t in names]
    every = kinds[0].unionAll(kinds[1]).unionAll(kinds[2])
    return every.agg(*[F.count_if(F.col("kind") == t).alias(t) for t in names])


def reach(edges: DataFrame, roots: DataFrame, depth: int, source: str, target: str) -> DataFrame:
    """(root, node, depth): nodes within ``depth`` steps of each root's start nodes, which are not in the result.

    ``roots``: (root, node); a step goes from column ``source`` to column ``target`` of the edges, which every level
    reads: give checkpointed ones.
    """
    step = edges.select(F.col(source).alias("node"), F.col(target).alias("next"))
    seen = cut(roots.select("root", "node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for level in range(1, depth + 1):
        new = _met(step, frontier, "node").select("root", F.col("next").alias("node")).distinct()
        frontier = cut(new.join(large(seen.select("root", "node")), ["root", "node"], "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return seen.where("depth > 0")


def near_other(edges: DataFrame, starts: DataFrame, depth: int, source: str, target: str) -> DataFrame:
    """(node): nodes that some start node other than themselves reaches within ``depth`` steps.

    One search from all start nodes at once: every node keeps the two nearest start nodes, which tells of each node
    whether one besides itself is near. So the work is that of two searches, whatever the number of start nodes.
    """
    step = edges.select(F.col(source).alias("node"), F.col(target).alias("next"))
    seen = cut(starts.select("node").distinct().select("node", F.col("node").alias("start")))
    frontier = seen
    for _ in range(depth):
        new = _met(step, frontier, "node").select(F.col("next").alias("node"), "start").join(large(seen), ["node", "start"], "left_anti")
        two = new.groupBy("node").agg(F.min("start").alias("a"), F.max("start").alias("b"))
        had = seen.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        kept = two.join(large(had), "node", "left").select(
            "node", F.explode(F.when(F.coalesce("n", F.lit(0)) == 0, F.array_distinct(F.array("a", "b"))).when(F.col("n") == 1, F.array("a"))).alias("start")
        )
        frontier = cut(kept)
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return seen.where(F.col("node") != F.col("start")).select("node").distinct()


def callers(graph_calls: DataFrame, functions: DataFrame, name: str, depth: int = 1) -> DataFrame:
    """(node, depth): who calls any function of the name, directly or up to ``depth`` steps away."""
    roots = functions.where(F.col("name") == name).select(F.lit(name).alias("root"), F.col("id").alias("node"))
    return reach(graph_calls, roots, depth, "callee_id", "caller_id").select("node", "depth")


def callees(graph_calls: DataFrame, functions: DataFrame, name: str, depth: int = 1) -> DataFrame:
    roots = functions.where(F.col("name") == name).select(F.lit(name).alias("root"), F.col("id").alias("node"))
    return reach(graph_calls, roots, depth, "caller_id", "callee_id").select("node", "depth")


def blast_radius(graph_calls: DataFrame, functions: DataFrame, name: str, depth: int = 10) -> DataFrame:
    """Who is affected by a change of the function: adds whether each is an entry point."""
    hit = callers(graph_calls, functions, name, depth)
    return hit.join(functions.withColumnRenamed("id", "node"), "node").select(
        "node", "name", "file_path", "start_line", "depth", is_entry_point(F.col("name"), F.col("file_path"), F.col("is_exported")).alias("is_entry")
    )


def missing_auth(graph_calls: DataFrame, functions: DataFrame, depth: int = 10) -> DataFrame:
    """Exported asynchronous handlers with nothing named auth within ``depth`` calls."""
    ends = functions.where(F.col("is_exported") & F.col("is_async") & has_any(F.col("name"), HANDLERS))
    guards = functions.where(F.contains(F.lower("name"), F.lit("auth"))).select(F.col("id").alias("node"))
    # a search starts from all functions of the handler's name: any of them that reaches a guard clears the name
    safe = near_other(graph_calls, guards, depth, "callee_id", "caller_id").withColumnRenamed("node", "id")
    ends, every = _projects(ends), _projects(functions)
    names = every.join(safe, "id", "left_semi").select("project", "name").distinct()
    return ends.join(names, ["project", "name"], "left_anti").select("id", "name", "file_path", "start_line", "seq", "project")


def _met(edges: DataFrame, frontier: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Edges that meet a checkpointed frontier: a small one is broadcast, so that the edges stay where they are."""
    return edges.join(F.broadcast(frontier) if frontier.count() <= BROADCAST_NODES else large(frontier), on, how)


def _leading(edges: DataFrame, sinks, depth: int) -> DataFrame:
    """The edges on ways of at most ``depth`` calls that end in a possible sink: all that a search for sinks can use.

    The search goes back from the names that some call makes a sink. A name takes part once, so every edge is found
    once. Names are compared by 64-bit hashes: names that share one only keep more edges than are needed.
    """
    by = lambda name: F.xxhash64("project", name)
    hashed = edges.select("project", "caller_name", "callee_name", "receiver", "seq", by("callee_name").alias("_to"))
    # the names first: most rows then need no more than one look at them
    likely = F.lower("callee_name").isin(*{method.lower() for _, method, _ in sinks})
    frontier = cut(hashed.where(likely & sink_kind(F.col("callee_name"), F.col("receiver"), sinks).isNotNull()).select("_to").distinct())
    seen, out = frontier, None
    for _ in range(depth):
        found = cut(_met(hashed, frontier, "_to", "left_semi").drop("_to"))
        out = found if out is None else out.unionAll(found)
        frontier = cut(found.select(by("caller_name").alias("_to")).distinct().join(large(seen), "_to", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return out


def _walk(starts: DataFrame, edges: DataFrame, known: DataFrame, sinks, depth: int, must_exist: bool) -> DataFrame:
    """(root, sink, kind, path, key): the first way from each root to every sink it reaches by names.

    ``starts``: (project, root, name, path, key): a root's frontier; names on its path count as seen. Sinks are not
    passed. A name is taken by the first edge that reaches it, whatever that edge's receiver.
    """
    step = edges.select("project", F.col("caller_name").alias("name"), "callee_name", "receiver", "seq")
    seen = cut(starts.select("root", F.explode("path").alias("name")).distinct())
    frontier, out = starts.select("project", "root", "name", "path", "key"), None
    for _ in range(1, depth):
        first = (
            frontier.join(step, ["project", "name"])
            .groupBy("project", "root", "callee_name")
            .agg(F.min(F.struct(F.concat("key", F.array("seq")).alias("key"), "receiver", "path")).alias("b"))
            .select("project", "root", F.col("callee_name").alias("name"), "b.*")
        )
        new = first.join(large(seen), ["root", "name"], "left_anti")
        new = new.join(large(known.withColumn("defined", F.lit(True))), ["project", "name"], "left").withColumn("kind", sink_kind(F.col("name"), F.col("receiver"), sinks))
        new = cut(new.withColumn("path", F.concat("path", F.array("name"))))
        if new.isEmpty():
            break
        hits = new.where("kind is not null" + (" and defined" if must_exist else "")).select("root", F.col("name").alias("sink"), "kind", "path", "key")
        out = hits if out is None else out.unionAll(hits)
        seen = seen.unionAll(new.select("root", "name"))
        frontier = new.where("kind is null and defined").select("project", "root", "name", "path", "key")
    if out is None:
        return starts.select("root", F.col("name").alias("sink"), F.lit("").alias("kind"), "path", "key").limit(0)
    return out


def attack_paths(edges: DataFrame, functions: DataFrame, depth: int = 5) -> DataFrame:
    """(entry, entry_file, sink, kind, path, has_validation, entry_seq, edge_seq, key): how exported handlers reach dangerous calls.

    Every direct call of an entry point is followed on its own, so one sink can be found by several ways.
    """
    edges, functions = _projects(edges), _projects(functions)
    known = functions.select("project", "name").distinct()
    edges = _leading(edges, ATTACK_SINKS, depth)
    entry = functions.where(is_entry_point(F.col("name"), F.col("file_path"), F.col("is_exported"))).select(
        "project", F.col("seq").alias("entry_seq"), F.col("name").alias("caller_name"), F.col("file_path").alias("entry_file"), _line(functions).alias("entry_line")
    )
    direct = entry.join(edges, ["project", "caller_name"]).join(large(known.withColumnRenamed("name", "callee_name")), ["project", "callee_name"])
    direct = cut(
        direct.select(
            "project",
            F.struct("project", "entry_seq", "seq").alias("root"),
            "entry_file",
            "entry_line",
            F.col("callee_name").alias("name"),
            sink_kind(F.col("callee_name"), F.col("receiver"), ATTACK_SINKS).alias("kind"),
            F.array("caller_name", "callee_name").alias("path"),
            F.array("seq").alias("key"),
        )
    )
    at_once = direct.where("kind is not null").select("root", F.col("name").alias("sink"), "kind", "path", "key")
    later = _walk(direct.where("kind is null"), edges, known, ATTACK_SINKS, depth, True)
    files = direct.select("root", "project", "entry_file", "entry_line").distinct()
    return at_once.unionAll(later).join(large(files), "root").select(
        F.element_at("path", 1).alias("entry"),
        "entry_file",
        "sink",
        "kind",
        "path",
        F.exists("path", lambda n: has_any(n, VALIDATORS)).alias("has_validation"),
        F.col("root.entry_seq").alias("entry_seq"),
        F.col("root.seq").alias("edge_seq"),
        "key",
        "project",
        "entry_line",
    )


def _line(functions: DataFrame) -> Column:
    return (F.col("start_line") if "start_line" in functions.columns else F.lit(None)).cast("int")


def data_flows(edges: DataFrame, functions: DataFrame, depth: int = 8) -> DataFrame:
    """(source, sink, kind, path, has_sanitization): the first flow from each taint source to each sink."""
    edges, functions = _projects(edges), _projects(functions)
    known = functions.select("project", "name").distinct()
    sources = functions.where(is_source(F.col("name"))).select("project", F.col("name").alias("source"), F.col("seq").alias("source_seq"), F.col("file_path").alias("source_file"), _line(functions).alias("source_line"))
    using = edges.join(sources.withColumnRenamed("source", "callee_name"), ["project", "callee_name"])
    using = using.where(F.col("caller_name") != F.col("callee_name"))
    first = using.groupBy("project", "source_seq", F.col("callee_name").alias("source"), "caller_id", "caller_name").agg(F.min("seq").alias("seq"))
    starts = cut(
        first.select(
            "project",
            F.struct("project", "source_seq", "source", "seq").alias("root"),
            F.col("caller_name").alias("name"),
            F.array("source", "caller_name").alias("path"),
            F.array("seq").alias("key"),
        )
    )
    found = _walk(starts, _leading(edges, TAINT_SINKS, depth), known, TAINT_SINKS, depth, False)
    best = found.groupBy(F.col("root.project").alias("project"), F.col("root.source").alias("source"), "sink").agg(
        F.min(F.struct("root", F.size("path").alias("hops"), "key", "kind", "path")).alias("b")
    )
    # a flow is clean if its caller, or anything that functions of the caller's name reach, is named like cleaning
    cleaners = functions.where(has_any(F.col("name"), SANITIZERS)).select(F.col("id").alias("node"))
    above = near_other(edges, cleaners, depth, "callee_id", "caller_id").withColumnRenamed("node", "id")
    clean = functions.join(above, "id", "left_semi").select("project", F.col("name").alias("caller")).distinct().withColumn("scope", F.lit(True))
    flows = best.withColumn("caller", F.element_at("b.path", 2)).join(clean, ["project", "caller"], "left")
    safe = F.coalesce("scope", F.lit(False)) | has_any(F.col("caller"), SANITIZERS)
    at = sources.select("project", "source_seq", "source_file", "source_line")
    out = flows.select("source", "sink", "b.kind", "b.path", safe.alias("has_sanitization"), "project", F.col("b.root.source_seq").alias("source_seq"), "b.key")
    return out.join(at, ["project", "source_seq"], "left").select("source", "sink", "kind", "path", "has_sanitization", "project", "source_file", "source_line", "source_seq", "key")


def path_findings(paths: DataFrame) -> DataFrame:
    """Findings of attack paths without validation; only shell commands are critical. Ids are of the content;
    ``graph_findings`` gives running ones."""
    from_, to = F.element_at("path", 1), F.col("sink")
    text = F.concat(F.lit("Unvalidated path from "), from_, F.lit(" to "), to, F.lit(" ("), F.col("kind"), F.lit(" sink): "), F.array_join("path", " -> "))
    return paths.where(~F.col("has_validation")).select(
        F.concat(F.lit("kg-attack-path-"), F.left(F.sha2(text, 256), F.lit(8))).alias("id"),
        F.lit("knowledge_graph").alias("engine"),
        F.when(F.col("kind") == "shell", "critical").otherwise("high").alias("severity"),
        F.lit("attack_path").alias("type"),
        F.col("entry_file").alias("file"),
        F.col("entry_line").alias("line"),
        text.alias("description"),
        F.concat(F.lit("Add input validation or sanitization in the call chain between "), from_, F.lit(" and "), to).alias("fix_suggestion"),
        F.lit(False).alias("auto_fixable"),
        *_order(paths, "entry_seq", "edge_seq", "key"),
    )


def auth_findings(missing: DataFrame) -> DataFrame:
    """Findings of handlers without any check among what they call."""
    name = F.col("name")
    return missing.select(
        F.concat(F.lit("kg-missing-auth-"), F.left(F.sha2("id", 256), F.lit(8))).alias("id"),
        F.lit("knowledge_graph").alias("engine"),
        F.lit("high").alias("severity"),
        F.lit("missing_auth").alias("type"),
        F.col("file_path").alias("file"),
        F.col("start_line").cast("int").alias("line"),
        F.concat(F.lit("Endpoint "), name, F.lit(" has no auth middleware in call chain")).alias("description"),
        F.concat(F.lit("Add authentication middleware (e.g., checkAuth) to the call chain for "), name).alias("fix_suggestion"),
        F.lit(False).alias("auto_fixable"),
        *_order(missing, "seq"),
    )


def flow_findings(flows: DataFrame) -> DataFrame:
    """Findings of tainted flows that nothing cleans; into a shell or code they are critical."""
    from_, to = F.col("source"), F.col("sink")
    text = F.concat(F.lit("Tainted data flows from "), from_, F.lit(" (user_input) to "), to, F.lit(" ("), F.col("kind"), F.lit(" sink): "), F.array_join("path", " -> "))
    return flows.where(~F.col("has_sanitization")).select(
        F.concat(F.lit("kg-tainted-flow-"), F.left(F.sha2(text, 256), F.lit(8))).alias("id"),
        F.lit("knowledge_graph").alias("engine"),
        F.when(F.col("kind").isin("shell", "eval"), "critical").otherwise("high").alias("severity"),
        F.lit("tainted_data_flow").alias("type"),
        F.col("source_file").alias("file"),
        F.col("source_line").alias("line"),
        text.alias("description"),
        F.concat(F.lit("Add input sanitization or parameterization between "), from_, F.lit(" and "), to).alias("fix_suggestion"),
        F.lit(False).alias("auto_fixable"),
        *_order(flows, "source_seq", "key"),
    )


def _order(rows: DataFrame, *names: str) -> list[Column]:
    """The project, and what a kind's findings are in the order of."""
    project = F.col("project") if "project" in rows.columns else F.lit("").alias("project")
    return [project, *(F.col(n).alias(f"_o{i}") for i, n in enumerate(names) if n in rows.columns)]


def graph_findings(paths: DataFrame, missing: DataFrame, flows: DataFrame) -> DataFrame:
    """All findings of a graph, by project, with running ids from 1: attack paths and missing checks share one counter,
    in this order; tainted flows have their own."""
    first, second, third = path_findings(paths), auth_findings(missing), flow_findings(flows)
    shared = first.withColumn("_kind", F.lit(0)).unionByName(second.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    order = sorted(c for c in shared.columns if c.startswith("_o"))
    prefix = F.when(F.col("type") == "attack_path", "kg-attack-path-").when(F.col("type") == "missing_auth", "kg-missing-auth-").otherwise("kg-tainted-flow-")
    out = None
    for rows, by in ((shared, ["_kind", *order]), (third, sorted(c for c in third.columns if c.startswith("_o")))):
        told = places(rows, ["project"], by, "_n").withColumn("id", F.concat(prefix, F.col("_n").cast("string")))
        told = told.drop("_n", *by)
        out = told if out is None else out.unionByName(told)
    return out


def _at_lines(findings: DataFrame, functions: DataFrame, pick: Column) -> DataFrame:
    """Findings with ``fn`` as ``pick`` tells it for each (file, line), over a window of the file's lines.

    Only distinct lines meet their functions, so what a task holds goes by the length of a file, not by its findings.
    """
    lines = findings.groupBy("file", "line").agg(F.count(F.lit(1)).alias("_n"))
    placed = functions.where("file_path is not null and start_line is not null")
    first = placed.groupBy(F.col("file_path").alias("file"), F.col("start_line").cast("int").alias("line")).agg(F.min(F.struct("seq", "id")).alias("_f"))
    both = lines.select("file", F.col("line").cast("int").alias("line"), "_n", F.lit(None).cast(first.schema["_f"].dataType).alias("_f"), F.lit(1).alias("_k"))
    both = both.unionByName(first.select("file", "line", F.lit(None).cast("long").alias("_n"), "_f", F.lit(0).alias("_k")))
    w = W.partitionBy("file").orderBy("line", "_k").rowsBetween(W.unboundedPreceding, 0)
    told = both.withColumn("fn", pick.over(w)["id"]).where("_k = 1").select("file", "line", "_n", "fn")
    return join_by_key(findings, told, ["file", "line"], "_n", hot_bar(findings.count()))


def closest_function(findings: DataFrame, functions: DataFrame) -> DataFrame:
    """Findings (file, line, ...) with ``fn``: the function of their file that starts last at or before their line; of
    equals the first. A finding without one, or without file or line, has none."""
    return _placed(findings, _at_lines(findings.where("file is not null and line is not null"), functions, F.last("_f", ignorenulls=True)))


def first_function(findings: DataFrame, functions: DataFrame) -> DataFrame:
    """Findings with ``fn``: of the functions of their file that start at or before their line, the first in walk order."""
    return _placed(findings, _at_lines(findings.where("file is not null and line is not null"), functions, F.min("_f")))


def _placed(findings: DataFrame, told: DataFrame) -> DataFrame:
    rest = findings.where("file is null or line is null")
    return told.select(*findings.columns, "fn").unionByName(rest.withColumn("fn", F.lit(None).cast(told.schema["fn"].dataType)))


def call_map_filter(findings: DataFrame, context: DataFrame) -> DataFrame:
    """Drop or downgrade findings by who calls their function: context (fn, auth, validated)."""
    f = findings.join(context, "fn", "left")
    auth, valid = (F.coalesce(c, F.lit(False)) for c in ("auth", "validated"))
    gone = (F.col("id").isin(*AUTH_RULES) & auth) | (F.col("id").isin(*XSS_RULES) & valid)
    lower = F.col("id").isin(*SQL_RULES) & valid
    return f.where(~gone).withColumn("severity", F.when(lower, "info").otherwise(F.col("severity"))).drop("auth", "validated")


def call_context(edges: DataFrame, functions: DataFrame, depth: int = 5) -> DataFrame:
    """(fn, auth, validated) of every function: whether callers up to ``depth`` away are named like guards, and whether
    callees, or the function itself, are named like validation."""
    id_ = F.col("id").alias("node")
    guards = functions.where(F.rlike("name", F.lit(AUTH_CONTEXT))).select(id_)
    checks = functions.where(F.rlike("name", F.lit(VALIDATION_CONTEXT))).select(id_)
    up = near_other(edges, guards, depth, "caller_id", "callee_id").select(F.col("node").alias("fn"), F.lit(True).alias("auth"))
    down = near_other(edges, checks, depth, "callee_id", "caller_id").select(F.col("node").alias("fn"), F.lit(True).alias("below"))
    own = functions.select(F.col("id").alias("fn"), F.rlike("name", F.lit(VALIDATION_CONTEXT)).alias("self"))
    out = own.join(up, "fn", "left").join(down, "fn", "left")
    return out.select("fn", F.coalesce("auth", F.lit(False)).alias("auth"), (F.col("self") | F.coalesce("below", F.lit(False))).alias("validated"))


def call_map(graph: dict[str, DataFrame]) -> DataFrame:
    """(caller, callee): edges by imports and inside files, a second graph beside ``calls``.

    A relative import names a file by its path, its path without extension, or its folder's index; what is imported
    must be exported there and called by the caller. Inside a file, a call of one of its functions is an edge.
    """
    named = graph["functions"].groupBy("project", "file_path", "name").agg(F.min_by("id", "seq").alias("id"))
    sites = graph["call_sites"].select("project", "file_path", "caller_name", "callee_name").distinct()
    sites = sites.join(named.select("project", "file_path", F.col("name").alias("caller_name"), F.col("id").alias("caller")), ["project", "file_path", "caller_name"])
    inside = sites.join(named.select("project", "file_path", F.col("name").alias("callee_name"), F.col("id").alias("callee")), ["project", "file_path", "callee_name"])
    imports = graph["imports"].where(F.startswith("module", F.lit(".")))
    folder = F.regexp_extract("file_path", r"^(.*/)?[^/]*$", 1)
    target = normal_path(F.concat(folder, F.col("module")))
    wanted = imports.select("project", "file_path", F.explode(F.split("specifiers", ",")).alias("callee_name"), target.alias("target"))
    bare = F.regexp_replace("file_path", r"\.(?:tsx?|jsx?|mjs|cjs)$", "")
    ways = F.array_distinct(F.array(F.col("file_path"), bare, F.regexp_replace("file_path", r"/index\.(?:ts|js)$", ""), F.concat(bare, F.lit(".js"))))
    offered = graph["exports"].select("project", "file_path", "name").distinct().join(named, ["project", "file_path", "name"])
    offered = offered.select("project", F.explode(ways).alias("target"), F.col("name").alias("callee_name"), F.col("id").alias("callee"))
    across = sites.join(wanted.distinct(), ["project", "file_path", "callee_name"]).join(offered, ["project", "target", "callee_name"])
    return inside.select("caller", "callee").unionAll(across.select("caller", "callee")).distinct()
