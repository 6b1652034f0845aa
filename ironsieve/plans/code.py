"""Queries that scan code with the whole rule book. No table holds code, so files are composed: each part is a file of two
lines chosen by its key from ``SCRIPT`` or ``PYTHON``, each supplier a project with its own package manifest."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ironsieve.functions.imports import stack
from ironsieve.operators import findings as fd
from ironsieve.operators import graph as gr
from ironsieve.operators import rulebook
from ironsieve.operators import spans
from ironsieve.operators.dependencies import recommended
from ironsieve.operators.rules import COMMENT, CONTEXTS_OFF, IMPORTS_OFF, Rule, scan_files
from ironsieve.plans.registry import Registry
from ironsieve.session import cut, read_table, spread
from ironsieve.sources import files as src
from ironsieve.sources.code import parsed_files

query = Registry()

SCRIPT = (
    "const q = \"SELECT a FROM t WHERE b = \" + b;",
    "db.query(`SELECT a FROM t WHERE b = ${b}`);",
    "const ok = sql`SELECT a FROM t WHERE b = ${b}`;",
    "el.innerHTML = sanitizeHtml(body);",
    "exec('ls ' + dir);",
    "// exec('ls ' + dir);",
    "app.use(cookieParser());",
    "res.json(process.env);",
    "const key = 'sk_live_a1B2a1B2a1B2a1B2a1B2';",
    "crypto.createHash('md5');",
    "localStorage.setItem('authToken', t);",
    "cors({ origin: '*' });",
    "const url = 'postgres://bob:hunter22@db.prod/x';",
    "new ApolloServer({ introspection: true });",
    "redis.subscribe(req.query.room);",
    "throw new GraphQLError(err.message);",
    "const seed = Date.now();",
    "{ synchronize: true }",
    "fetch('/in?password=' + p);",
    "const plain = 1;",
    "helmet({ noSniff: false });",
)
PYTHON = (
    "q.extra(where=[request.GET['w']])",
    "return redirect(request.GET.get('to'))",
    "db.session.execute(f\"SELECT {a}\")",
    "loglevel = 'debug'",
    "c.set_missing_host_key_policy(paramiko.AutoAddPolicy())",
    "ssl.SSLContext(ssl.PROTOCOL_TLSv1)",
    "pd.read_csv(request.args['p'])",
    "# pd.read_csv(request.args['p'])",
    "Image.MAX_IMAGE_PIXELS = None",
    "app = FastAPI()",
    "r = csv.reader(f)",
    "csv.field_size_limit(9)",
    "s.bind(('0.0.0.0', 1))",
    "passlib.hash.md5_crypt.hash(p)",
    "await lock.acquire()",
    "bcrypt.gensalt(rounds=5)",
    "x = 1",
)
_BEYOND_RE2 = re.compile(r"\(\?<?[!=]|\\[1-9]|[*+?}]\+")


def plain(rule: Rule) -> bool:
    """Whether RE2 can express the rule line by line, and nothing but the file's own text matters."""
    off = {i for ids in IMPORTS_OFF.values() for i in ids}
    own = (rule.pattern, rule.absent, rule.absent_file)
    return not (rule.file or rule.entropy or rule.id in off or any(_BEYOND_RE2.search(p) for p in own))


PLAIN = tuple(r.id for r in rulebook.RULES if plain(r))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _listed(lines) -> str:
    return "[" + ", ".join(map(_quoted, lines)) + "]"


def _has(text: str, rule: Rule) -> str:
    return "(" + " OR ".join(f"contains({text}, {_quoted(n)})" for n in rule.texts()) + ")"


def _rule_sql(rule: Rule) -> str:
    where = [_has("line_text", rule), f"regexp_matches(line_text, {_quoted(rule.pattern)})"]
    if rule.absent:
        where.append(f"NOT regexp_matches(line_text, {_quoted(rule.absent)})")
    if rule.type != "hardcoded_secret":
        where.append(f"NOT regexp_matches(line_text, {_quoted(COMMENT)})")
    if rule.type in CONTEXTS_OFF:
        where.append(f"NOT regexp_matches(line_text, {_quoted(CONTEXTS_OFF[rule.type])})")
    if rule.absent_file:
        where.append(f"NOT ({_has('text', rule)} AND regexp_matches(text, {_quoted(rule.absent_file)}))")
    if rule.languages:
        where.append(f"ext = '{'py' if rule.languages == ('python',) else 'ts'}'")
    return f"SELECT {_quoted(rule.id)} AS id, '{rule.severity}' AS severity, file, CAST(line AS INTEGER) AS line FROM lines WHERE " + " AND ".join(where)


_FILES = (
    f"f AS (SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN 'ts' ELSE 'py' END AS ext, CASE p_partkey % 2 WHEN 0 THEN {_listed(SCRIPT)} ELSE {_listed(PYTHON)} END AS pool FROM part), "
    "files AS (SELECT 'src/f' || p_partkey || '.' || ext AS file, ext, pool[(p_partkey // 2) % len(pool) + 1] || chr(10) || pool[(p_partkey // 7) % len(pool) + 1] AS text FROM f), "
    "lines AS (SELECT file, ext, text, unnest(s) AS line_text, generate_subscripts(s, 1) AS line FROM (SELECT *, string_split(text, chr(10)) AS s FROM files))"
)
FOUND = f"WITH {_FILES}, found AS (" + " UNION ALL ".join(_rule_sql(r) for r in rulebook.RULES if r.id in PLAIN) + ")"


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, text) of the composed files."""
    key = F.col("p_partkey")

    def pick(lines, by: int):
        pool = F.array(*[F.lit(x) for x in lines])
        return F.get(pool, (F.floor(key / by) % len(lines)).cast("int"))

    even = key % 2 == 0
    ends = F.when(even, "ts").otherwise("py")
    text = [F.when(even, pick(SCRIPT, by)).otherwise(pick(PYTHON, by)) for by in (2, 7)]
    return spread(read_table(spark, sf_dir, "part").select("p_partkey", "p_size")).select(
        F.concat(F.lit("src/f"), key.cast("string"), F.lit("."), ends).alias("file"), F.concat_ws("\n", *text).alias("text"), key.alias("p_partkey"), "p_size"
    )


@query(f"{FOUND} SELECT id, severity, file, line FROM found")
def scan_rulebook(spark, sf_dir):
    """The rules that SQL's regular expressions can state, over whole files."""
    rules = [r for r in rulebook.RULES if r.id in PLAIN]
    return scan_files(code_files(spark, sf_dir), rules).select("id", "severity", "file", "line")


@query()
def scan_rulebook_rest(spark, sf_dir):
    """The rules with look-around, back references, entropy, imports or several lines; each has paired cases in the tests."""
    rules = [r for r in rulebook.RULES if r.id not in PLAIN]
    return scan_files(code_files(spark, sf_dir), rules).select("id", "severity", "file", "line")


WHOLE = (
    f"{FOUND}, one AS (SELECT *, row_number() OVER (PARTITION BY file, line, typ ORDER BY no) AS n FROM (SELECT found.*, t.typ, t.no FROM found JOIN (VALUES "
    + ", ".join(f"({_quoted(r.id)}, {_quoted(r.type + r.description)}, {i})" for i, r in enumerate(rulebook.RULES) if r.id in PLAIN)
    + ") t(id, typ, no) USING (id))), kept AS (SELECT id, severity, file, line FROM one WHERE n = 1 AND NOT regexp_matches(file, '5[.](ts|py)$'))"
)


@query(f"{WHOLE} SELECT id, severity, file, line FROM kept")
def whole_scan(spark, sf_dir):
    """Two scanners merged, copies dropped, ignored paths left out: files whose number ends in 5."""
    files = code_files(spark, sf_dir)
    rules = [r for r in rulebook.RULES if r.id in PLAIN]
    found = cut(scan_files(files, rules))  # both scanners' findings come of one scan
    again = found.where("severity = 'critical'").withColumn("engine", F.lit("other"))  # a second scanner's copies
    kept = ~src.ignored(F.col("file"), ["*5.ts", "*5.py"])
    return fd.whole_scan([found, again], kept=kept).select("id", "severity", "file", "line")


@query(f"{WHOLE} SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, CASE WHEN count(*) FILTER (severity = 'critical') > 0 THEN 'F' ELSE '?' END AS score FROM kept")
def whole_scan_summary(spark, sf_dir):
    return fd.summary(whole_scan(spark, sf_dir).withColumns({"auto_fixable": F.lit(False), "context": F.lit(None).cast("string")})).select("critical", "high", "medium", "low", "score")


_GATED, _ACCEPTED = ("CORS_WILDCARD", "CRYPTO_MD5"), "TYPEORM_SYNCHRONIZE_PRODUCTION"


@query(
    WHOLE[: WHOLE.index(", kept AS")]
    + ", every AS (SELECT id, severity, file, CAST(line AS INTEGER) AS line, CAST(regexp_extract(file, 'f(\\d+)', 1) AS INTEGER) AS k FROM one WHERE n = 1 UNION ALL SELECT 'kg-attack-path-1', 'high', 'src/f' || p_partkey || CASE p_partkey % 2 WHEN 0 THEN '.ts' ELSE '.py' END, 1, p_partkey FROM part WHERE p_size % 5 = 0)"
    f" SELECT id, severity, file, line FROM every WHERE NOT (k % 3 = 1 AND id IN {_GATED}) AND k % 8 <> 6 AND NOT (k % 4 = 0 AND id = '{_ACCEPTED}')"
)
def whole_scan_gated(spark, sf_dir):
    """A scan with all its parts: two scanners, the graph's findings, a framework's gates, changed files, a baseline."""
    files = code_files(spark, sf_dir)
    number = F.regexp_extract("file", r"f(\d+)", 1).cast("int")
    project = F.concat(F.lit("p"), (number % 3).cast("string"))
    rules = [r for r in rulebook.RULES if r.id in PLAIN]
    found = cut(scan_files(files, rules).withColumn("project", project))
    again = found.where("severity = 'high'").withColumn("engine", F.lit("other"))
    graph = files.where("p_size % 5 = 0").select(
        F.lit("kg-attack-path-1").alias("id"), F.lit("knowledge_graph").alias("engine"), F.lit("high").alias("severity"), F.lit("attack_path").alias("type"), "file", F.lit(1).alias("line"), F.lit("d").alias("description"), project.alias("project")
    )
    gates = spark.createDataFrame([(x, "nextjs") for x in _GATED], "id string, framework string"), spark.createDataFrame([("p1", "nextjs")], "project string, framework string")
    changed = files.where("p_partkey % 8 <> 6").select("file")
    baseline = fd.fingerprinted(scan_files(files.where("p_partkey % 4 = 0"), [r for r in rules if r.id == _ACCEPTED]))
    return fd.whole_scan([found, again], graph, gates, changed=changed, baseline=baseline).select("id", "severity", "file", "line")


_HANDLERS = (
    ("export function handleOne(q) {", "  return executeRaw(q);", "}"),
    ("", "export async function handleTwo(q) {", "  return execSync(q);", "}"),
    ("export function handleThree(q) {", "  return checkInput(q);", "}"),
    ("function processForm() {", "  const b = getRequestBody();", "  return executeQuery(b);", "}", "function getRequestBody() {", "  return 1;", "}"),
)
_OWN = "handleOne|handleTwo|handleThree|processForm|getRequestBody"  # names that a file's number is added to
_SINKS = "function executeRaw(s) {\n  return s;\n}\nfunction execSync(s) {\n  return s;\n}\nfunction checkInput(s) {\n  return s;\n}\nfunction executeQuery(s) {\n  return s;\n}\n"
_PATH = "'Unvalidated path from {0} to {1} ({2} sink): {0} -> {1}', 'Add input validation or sanitization in the call chain between {0} and {1}'"
_ENDPOINT = "'Endpoint {0} has no auth middleware in call chain', 'Add authentication middleware (e.g., checkAuth) to the call chain for {0}'"
_KG = f"""(VALUES (0, 0, 0, 'kg-attack-path-', 'high', 'attack_path', 1, {_PATH.format('handleOne', 'executeRaw', 'database')}),
 (1, 0, 0, 'kg-attack-path-', 'critical', 'attack_path', 2, {_PATH.format('handleTwo', 'execSync', 'shell')}), (1, 0, 1, 'kg-missing-auth-', 'high', 'missing_auth', 2, {_ENDPOINT.format('handleTwo')}),
 (3, 1, 0, 'kg-tainted-flow-', 'high', 'tainted_data_flow', 5, 'Tainted data flows from getRequestBody (user_input) to executeQuery (database sink): getRequestBody -> processForm -> executeQuery', 'Add input sanitization or parameterization between getRequestBody and executeQuery'))
 t(form, counter, kind, prefix, severity, type, line, description, fix_suggestion)"""


@query(f"""SELECT s.s_suppkey AS project, prefix || row_number() OVER (PARTITION BY s.s_suppkey, counter ORDER BY kind, 'src/api/h' || i || '.ts') AS id, 'knowledge_graph' AS engine, severity, type, 'src/api/h' || i || '.ts' AS file, line,
 regexp_replace(description, '({_OWN})', '\\1_' || i, 'g') AS description, regexp_replace(fix_suggestion, '({_OWN})', '\\1_' || i, 'g') AS fix_suggestion FROM supplier s, generate_series(0, 3) g(i), {_KG} WHERE form = (s.s_suppkey + i * (1 + s.s_suppkey % 2)) % 4""")
def graph_findings_counted(spark, sf_dir):
    """Every supplier is a project of four files; its paths and missing checks share a counter, its flows have their own."""
    i = F.explode(F.sequence(F.lit(0), F.lit(3)))
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("project"), i.alias("i"))
    form = F.get(F.array(*[F.lit("\n".join(x) + "\n") for x in _HANDLERS]), ((F.col("project") + F.col("i") * (1 + F.col("project") % 2)) % 4).cast("int"))
    own = F.regexp_replace(form, F.lit(f"({_OWN})"), F.concat(F.lit("$1_"), F.col("i").cast("string")))
    files = s.select(F.col("project").cast("string").alias("project"), F.concat(F.lit("src/api/h"), F.col("i").cast("string"), F.lit(".ts")).alias("file"), F.lit("typescript").alias("language"), own.alias("text"))
    sinks = s.select(F.col("project").cast("string")).distinct().select("project", F.lit("src/lib/sinks.ts"), F.lit("typescript"), F.lit(_SINKS))
    g = gr.build(parsed_files(files.unionAll(sinks)))
    calls, functions = cut(g["calls"]), cut(g["functions"])
    found = gr.graph_findings(gr.attack_paths(calls, functions), gr.missing_auth(calls, functions), gr.data_flows(calls, functions))
    return found.select(F.col("project").cast("long").alias("project"), "id", "engine", "severity", "type", "file", "line", "description", "fix_suggestion")


_SNIPPETS = (
    "db.query(sql`SELECT a\n FROM t WHERE b = ${pick(b,\n 'x)')}`)\n",
    "// f(\nconst re = /[\"'{(]/; el.innerHTML = clean(\n  sanitizeAll(v, [1]),\n)\n",
    "/* g(\n */ this.redis.eval('k', a)\n",
)
# (snippet, line, last line, kind, callee, receiver, first argument literal)
_SPANS = (
    (0, 1, 3, "call", "query", "db", False), (0, 1, 3, "template", "sql", None, False), (0, 2, 3, "interpolation", None, None, False), (0, 2, 3, "call", "pick", None, False), (0, 3, 3, "string", None, None, False),
    (1, 1, 1, "comment", None, None, False), (1, 2, 2, "regex", None, None, False), (1, 2, 4, "call", "clean", None, False), (1, 3, 3, "call", "sanitizeAll", None, False), (1, 3, 3, "index", None, None, False),
    (2, 1, 2, "comment", None, None, False), (2, 2, 2, "call", "eval", "this.redis", True), (2, 2, 2, "string", None, None, False),
)
_LENGTHS = [s.count("\n") for s in _SNIPPETS]


def _spans_sql() -> str:
    rows = ", ".join(f"({s}, {a}, {b}, '{k}', {_quoted(c) if c else 'NULL'}, {_quoted(r) if r else 'NULL'}, {str(x).upper()})" for s, a, b, k, c, r, x in _SPANS)
    return (
        f"WITH v(s, a, b, kind, callee, receiver, literal) AS (VALUES {rows}), f AS (SELECT p_partkey, p_partkey % 3 AS one, p_size % 3 AS two FROM part), "
        f"x AS (SELECT p_partkey, one AS s, 0 AS skip FROM f UNION ALL SELECT p_partkey, two, {_LENGTHS}[one + 1] FROM f) "
        "SELECT 'src/f' || p_partkey || '.ts' AS file, CAST(a + skip AS INTEGER) AS line, CAST(b + skip AS INTEGER) AS last_line, kind, callee, receiver, literal FROM x JOIN v USING (s)"
    )


@query(_spans_sql())
def code_spans(spark, sf_dir):
    """Spans of files that are composed of two snippets each, with calls, templates and comments over several lines."""
    snippet = lambda k: F.get(F.array(*map(F.lit, _SNIPPETS)), k.cast("int"))
    p = spread(read_table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    name = F.concat(F.lit("src/f"), F.col("p_partkey").cast("string"), F.lit(".ts"))
    files = p.select(name.alias("file"), F.concat(snippet(F.col("p_partkey") % 3), snippet(F.col("p_size") % 3)).alias("text"), F.lit("typescript").alias("_lang"))
    return spans.code_spans(files).select("file", "line", "last_line", "kind", "callee", "receiver", "literal")


# (text, rule of a finding in it and its line, whether its context lets it stand)
_IN_CONTEXT = (
    ("el.innerHTML = value;\n", "XSS_INNERHTML", 1, True),
    ("sanitizeAll(\n  () => {\n    el.innerHTML = value;\n  },\n);\n", "XSS_INNERHTML", 3, False),
    ("sanitizeAll(x);\nel.innerHTML = value;\n", "XSS_INNERHTML", 2, True),
    ("/*\nel.innerHTML = value;\n*/\n", "XSS_INNERHTML", 2, False),
    ("/*\n*/ el.innerHTML = value;\n", "XSS_INNERHTML", 2, True),
    ("const m = myRegex.exec(`a ${b}`);\n", "CMD_INJECTION_EXEC", 1, False),
    ("cp.exec(`ls ${dir}`);\n", "CMD_INJECTION_EXEC", 1, True),
    ("eval(code);\n", "XSS_EVAL", 1, True),
    ("const q = sql`\n  ${db.query(`SELECT a FROM t WHERE b = ${b}`)}\n`;\n", "SQL_INJECTION_TEMPLATE", 2, False),
)


@query("SELECT 'src/f' || p_partkey || '.ts' AS file, id, CAST(line AS INTEGER) AS line FROM part JOIN (VALUES " + ", ".join(f"({i}, '{rule}', {line})" for i, (_, rule, line, stays) in enumerate(_IN_CONTEXT) if stays) + f") t(i, id, line) ON p_partkey % {len(_IN_CONTEXT)} = i")
def findings_in_context(spark, sf_dir):
    """Findings that nothing around them silences: wrapping calls over lines, comments, receivers, tagged templates."""
    name = F.concat(F.lit("src/f"), F.col("p_partkey").cast("string"), F.lit(".ts"))
    text = F.get(F.array(*[F.lit(t) for t, *_ in _IN_CONTEXT]), (F.col("p_partkey") % len(_IN_CONTEXT)).cast("int"))
    files = spread(read_table(spark, sf_dir, "part").select("p_partkey")).select(name.alias("file"), text.alias("text"))
    rules = [r for r in rulebook.RULES if r.id in {x[1] for x in _IN_CONTEXT}]
    return spans.in_context(scan_files(files, rules), files).select("file", "id", "line")


@query("SELECT 'kg-attack-path-' || row_number() OVER (ORDER BY p_partkey) AS id, 'src/api/h' || p_partkey || '.ts' AS file FROM part WHERE p_size % 3 = 0")
def graph_findings_numbered(spark, sf_dir):
    """Attack paths of composed handlers with running ids in the order of their files' numbers."""
    p = spread(read_table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    key = F.col("p_partkey").cast("string")
    body = F.when(F.col("p_size") % 3 == 0, "executeRaw(q)").otherwise("checkInput(q)")
    text = F.concat(F.lit("export function handleOne(q) {\n  return "), body, F.lit(";\n}\nfunction executeRaw(s) {\n  return s;\n}\nfunction checkInput(s) {\n  return s;\n}\n"))
    files = p.select(key.alias("project"), F.concat(F.lit("src/api/h"), key, F.lit(".ts")).alias("file"), F.lit("typescript").alias("language"), text.alias("text"))
    g = gr.build(parsed_files(files))
    found = gr.path_findings(gr.attack_paths(cut(g["calls"]), g["functions"]))
    found = found.withColumn("number", F.regexp_extract("file", r"h(\d+)", 1).cast("long"))
    return fd.running_ids(found.drop("id"), "kg-attack-path-", ["number"]).select("id", "file")


@query("SELECT s_suppkey AS project, CASE s_suppkey % 5 WHEN 0 THEN 'nextjs' WHEN 1 THEN 'express' WHEN 2 THEN 'fastify' WHEN 3 THEN 'hono' END AS framework, CASE WHEN s_suppkey % 2 = 0 THEN 'next-auth' ELSE 'passport' END AS auth, CASE WHEN s_suppkey % 3 = 0 THEN 'prisma' ELSE 'knex' END AS orm FROM supplier")
def project_stack(spark, sf_dir):
    """Framework, authentication and database library by a project's dependencies."""
    n = F.col("s_suppkey")
    web = F.get(F.array(*map(F.lit, ("next", "express", "fastify", "hono"))), (n % 5).cast("int"))
    names = F.array_compact(F.array(web, F.when(n % 2 == 0, "next-auth").otherwise("passport"), F.when(n % 3 == 0, "@prisma/client").otherwise("knex"), F.when(web == "next", "express")))
    deps = F.map_from_arrays(names, F.transform(names, lambda _: F.lit("1")))
    return read_table(spark, sf_dir, "supplier").select(n.alias("project"), deps.alias("d")).select("project", *stack(F.col("d")))


@query("SELECT s_suppkey AS project, kind, priority FROM supplier, (VALUES ('missing_helmet', 'high'), ('missing_cors', 'medium'), ('missing_rate_limit', 'high')) t(kind, priority) WHERE NOT (s_suppkey % 2 = 0 AND kind = 'missing_helmet') AND NOT (s_suppkey % 3 = 0 AND kind = 'missing_rate_limit')")
def recommendations(spark, sf_dir):
    """What projects on express should add, besides what they have."""
    s = read_table(spark, sf_dir, "supplier")
    have = s.where("s_suppkey % 2 = 0").select("s_suppkey", F.lit("helmet").alias("name")).unionAll(s.where("s_suppkey % 3 = 0").select("s_suppkey", F.lit("rate-limiter-flexible")))
    have = have.withColumnRenamed("s_suppkey", "project")
    return recommended(s.select(F.col("s_suppkey").alias("project"), F.lit("express").alias("framework")), have).select("project", "kind", "priority")


@query("SELECT s_suppkey AS project, name, CASE WHEN s_suppkey % 2 = 0 THEN '9' || s_suppkey ELSE '1' || s_suppkey END AS version FROM supplier, (VALUES ('a'), ('@x/b')) t(name) UNION ALL SELECT s_suppkey, 'a/node_modules/c', '3' FROM supplier")
def lock_versions(spark, sf_dir):
    """Versions of lock files; the old format's, where a file has both, override the new one's."""
    s = read_table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey").cast("string")
    new = F.concat(F.lit('"packages":{"":{"version":"0"},"node_modules/a":{"version":"1'), key, F.lit('"},"node_modules/@x/b":{"version":"1'), key, F.lit('"},"node_modules/a/node_modules/c":{"version":"3"}}'))
    old = F.concat(F.lit(',"dependencies":{"a":{"version":"9'), key, F.lit('"},"@x/b":{"version":"9'), key, F.lit('"}}'))
    text = F.concat(F.lit("{"), new, F.when(F.col("s_suppkey") % 2 == 0, old).otherwise(""), F.lit("}"))
    return src.locked_packages(s.select(F.col("s_suppkey").alias("project"), text.alias("lock_json"))).select("project", "name", "version")


@query("SELECT s_suppkey AS project, n AS name FROM supplier, (VALUES ('django'), ('requests')) t(n) WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, n FROM supplier, (VALUES ('fastapi'), ('httpx')) t(n) WHERE s_suppkey % 3 = 1 UNION ALL SELECT s_suppkey, n FROM supplier, (VALUES ('flask'), ('rich')) t(n) WHERE s_suppkey % 3 = 2")
def python_projects(spark, sf_dir):
    """The first manifest of a Python project counts: requirements, pyproject, Pipfile."""
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("project"))
    texts = {
        "requirements.txt": (0, "Django>=4 # web\nrequests[socks]==2.0\n-r more.txt\n"),
        "pyproject.toml": (1, '[project]\ndependencies = [\n  "FastAPI>=0.1",\n  "httpx",\n]\n'),
        "Pipfile": (2, '[packages]\nflask = "*"\n"rich" = "*"\n\n[requires]\npython_version = "3"\n'),
    }
    parts = [s.where(F.col("project") % 3 <= at).select("project", F.lit(kind).alias("kind"), F.lit(text).alias("text")) for kind, (at, text) in texts.items()]
    parts[0] = s.where(F.col("project") % 3 == 0).select("project", F.lit("requirements.txt").alias("kind"), F.lit(texts["requirements.txt"][1]).alias("text"))
    return src.python_manifests(parts[0].unionAll(parts[1]).unionAll(parts[2]))
