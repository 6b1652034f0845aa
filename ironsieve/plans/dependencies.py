"""Queries of the dependency checks: parts as packages, suppliers as projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ironsieve.functions import severity as sev
from ironsieve.operators import dependencies as dp
from ironsieve.operators import findings as fd
from ironsieve.operators.dispatch import licences
from ironsieve.plans.registry import Registry
from ironsieve.session import read_table
from ironsieve.sources import files as src

query = Registry()


def _listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names near well-known packages: one that a part's key chooses, cut, lengthened, changed or as it is."""
    key, size = F.col("p_partkey"), F.col("p_size") % 4
    word = F.get(F.array(*map(F.lit, dp.POPULAR)), (key % len(dp.POPULAR)).cast("int"))
    name = F.when(size == 0, F.left(word, F.length(word) - 1)).when(size == 1, F.concat(word, F.lit("x"))).when(size == 2, F.concat(F.lit("z"), F.substring(word, 2, 99))).otherwise(word)
    return read_table(spark, sf_dir, "part").select(name.alias("name"))


_NAMES = (
    f"names AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN w[:-2] WHEN 1 THEN w || 'x' WHEN 2 THEN 'z' || w[2:] ELSE w END AS name FROM (SELECT p_size, {_listed(dp.POPULAR)}[p_partkey % {len(dp.POPULAR)} + 1] AS w FROM part))"
)


def _likes(known) -> str:
    return f"k AS (SELECT unnest({_listed(known)}) AS w, generate_subscripts({_listed(known)}, 1) AS o)"


@query(f"WITH {_NAMES}, {_likes(dp.POPULAR)} SELECT name, arg_min(w, o) AS similar_to FROM names JOIN k ON levenshtein(lower(name), lower(w)) BETWEEN 1 AND 2 WHERE name NOT IN (SELECT w FROM k) AND NOT list_contains({_listed(dp.LEGITIMATE)}, name) GROUP BY 1")
def typosquat(spark, sf_dir):
    return dp.lookalikes(_names(spark, sf_dir))


@query(f"WITH {_NAMES}, {_likes(dp.CHECKED)} SELECT name, arg_min(w, o) AS similar_to FROM names JOIN k ON levenshtein(lower(name), lower(w)) BETWEEN 1 AND 2 WHERE name NOT IN (SELECT w FROM k) GROUP BY 1")
def typosquat_checked(spark, sf_dir):
    """Against the shorter list that a single package is checked with."""
    return dp.lookalikes(_names(spark, sf_dir), dp.CHECKED, [])


# (name, version, whether it is locked, why it is deprecated), and what of it is found: (kind, severity, type, description, fix)
_PINNED = (
    ("react", "^15.0.0", True, None, (("outdated", "low", "dependency-outdated", 'Dependency "react@^15.0.0" is 4 major versions behind the current release (v19). Very old versions often have unpatched security vulnerabilities.', 'Update "react" to a recent version (current major: v19). Review the changelog for breaking changes before upgrading.'),)),
    ("expresz", "*", False, None, (("wildcard", "high", "dependency-wildcard-version", 'Dependency "expresz" uses wildcard version "*". This allows arbitrary versions to be installed, including potentially malicious ones.', 'Pin "expresz" to a specific version range (e.g., "^x.y.z") instead of "*".'), ("typosquat", "critical", "dependency-typosquat", 'Dependency "expresz" looks like a typosquat of popular package "express". This could be a malicious package impersonating a legitimate one.', 'Verify that "expresz" is the intended package. If you meant "express", replace it immediately.'))),
    ("left-padding", "1.0.0", False, None, (("phantom", "medium", "dependency-phantom", 'Dependency "left-padding" is declared in package.json but has no entry in the lockfile. This may indicate the lockfile is out of date or the dependency was never installed.', 'Run "npm install" to regenerate the lockfile and ensure "left-padding" is properly resolved.'),)),
    ("old-library", "2.1.0", True, "use new-library", (("deprecated", "medium", "dependency-deprecated", 'Dependency "old-library" is deprecated: use new-library', 'Find an actively maintained alternative to "old-library" and migrate away from this package.'),)),
    ("zod", "^3.2.0", True, None, ()),
)
_COUNTED = ", ".join(f"({i}, {j}, 'dep-{f[0]}-', '{f[1]}', '{f[2]}', '{f[3]}', '{f[4]}')" for i, p in enumerate(_PINNED) for j, f in enumerate(p[4]))


@query(f"""SELECT p_partkey AS project, prefix || (row_number() OVER (PARTITION BY p_partkey ORDER BY i, j) - 1) AS id, severity, type, description, fix_suggestion FROM part
 JOIN (VALUES {_COUNTED}) t(i, j, prefix, severity, type, description, fix_suggestion) ON (p_size + i) % 3 > 0""")
def dependency_findings(spark, sf_dir):
    """Every part is a project with some of five dependencies; all kinds of findings share its counter."""
    p = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("project"), "p_size")
    has = [(F.col("p_size") + i) % 3 > 0 for i in range(len(_PINNED))]
    names = F.array_compact(F.array(*[F.when(h, F.struct(F.lit(n).alias("key"), F.lit(v).alias("value"))) for h, (n, v, *_) in zip(has, _PINNED, strict=True)]))
    packages = p.select("project", F.map_from_entries(names).alias("dependencies"), F.lit(None).cast("map<string,string>").alias("devDependencies"))
    locks = F.explode(F.array_compact(F.array(F.struct(F.lit("other").alias("name"), F.lit(None).cast("string").alias("deprecated")), *[F.when(h, F.struct(F.lit(n).alias("name"), F.lit(d).cast("string").alias("deprecated"))) for h, (n, _, there, d, _) in zip(has, _PINNED, strict=True) if there])))
    locked = p.select("project", locks.alias("l")).select("project", "l.*")
    return dp.dependency_findings(packages, locked).select("project", "id", "severity", "type", "description", "fix_suggestion")


_WORDS = "SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower({0}.text), '[a-z]+')) AS w FROM {0}) WHERE length(w) <= 20"


@query(f"WITH k AS ({_WORDS.format('benchmark')}), n AS ({_WORDS.format('conversations')}) SELECT n.w AS name, min(k.w) AS similar_to FROM n JOIN k ON abs(length(n.w) - length(k.w)) <= 2 AND levenshtein(n.w, k.w) BETWEEN 1 AND 2 WHERE n.w NOT IN (SELECT w FROM k) GROUP BY 1")
def typosquat_registry(spark, sf_dir):
    """Words of conversations as names, against those of the benchmark as a registry in alphabetical order."""

    def words(table: str) -> DataFrame:
        every = read_table(spark, sf_dir, table).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("name"))
        return every.where("length(name) <= 20").distinct()

    known = words("benchmark")
    return dp.lookalikes_among(words("conversations"), known.select("name", F.col("name").alias("place")))


_IGNORES = {
    0: ["# logs", "*.log", "!keep.log", "/build/", "src/**/gen?.ts", "  ", "secret.txt"],
    1: ["node_modules", "docs/*.md", "!docs/a.md", "**/tmp/*.bak"],
    2: ["*", "!src", "src/a.min.js"],
}
_PATHS = ("a.log", "logs/keep.log", "build/out.js", "src/x/gen1.ts", "src/gen12.ts", "lib/node_modules/m/i.js", "docs/a.md", "docs/sub/b.md", "docs/b.md", "t/tmp/x.bak", "src/a.min.js", "SRC/deep/GEN2.ts", "a/Secret.TXT/b", "x.ts")
_LEFT_OUT = (
    r"CASE g WHEN 0 THEN CASE WHEN regexp_matches(p, '(^|/)secret\.txt(/.*)?$') OR regexp_matches(p, '^src/(.*/)?gen[^/]\.ts(/.*)?$') OR regexp_matches(p, '^build(/.*)?$') THEN TRUE WHEN regexp_matches(p, '(^|/)keep\.log(/.*)?$') THEN FALSE ELSE regexp_matches(p, '(^|/)[^/]*\.log(/.*)?$') END"
    r" WHEN 1 THEN regexp_matches(p, '^(.*/)?tmp/[^/]*\.bak(/.*)?$') OR p <> 'docs/a.md' AND regexp_matches(p, '^docs/[^/]*\.md(/.*)?$') OR regexp_matches(p, '(^|/)node_modules(/.*)?$')"
    " ELSE p = 'src/a.min.js' OR NOT regexp_matches(p, '(^|/)src(/.*)?$') END"
)


@query(f"WITH f AS (SELECT p_partkey AS project, p_partkey % 3 AS g, {_listed(_PATHS)}[p_size % {len(_PATHS)} + 1] AS file FROM part), l AS (SELECT *, lower(file) AS p FROM f) SELECT project, file FROM l WHERE {_LEFT_OUT}")
def ignored_by_project(spark, sf_dir):
    """Every part is a project with a file and one of three ignore files."""
    p = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("project"), "p_size")
    files = p.select("project", F.get(F.array(*map(F.lit, _PATHS)), F.col("p_size") % len(_PATHS)).alias("file"))
    kinds = F.get(F.array(*(F.array(*map(F.lit, v)) for v in _IGNORES.values())), (F.col("project") % 3).cast("int"))
    lines = p.select("project", F.posexplode(kinds).alias("no", "line"))
    return src.ignored_by_rules(files, lines)


_FAKES = [(fake, real) for real, v in dp.FAKES.items() for fake in v]


@query("WITH f AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(_FAKES)) + f") t(i, fake, real)) SELECT p_partkey AS id, fake AS name, real FROM part JOIN f ON p_partkey % {len(_FAKES) * 2} = i")
def known_fakes(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    name = F.get(F.array(*[F.lit(a) for a, _ in _FAKES]), (F.col("p_partkey") % (2 * len(_FAKES))).cast("int"))
    named = p.select(F.col("p_partkey").alias("id"), F.coalesce(name, F.lit("express")).alias("name"))
    return named.join(F.broadcast(dp.fakes(named.select("name").distinct())), "name").select("id", "name", "real")


@query("SELECT p_partkey AS project, 'a' AS name, '1' AS spec, 'use b' AS deprecated FROM part WHERE p_size % 3 = 0")
def deprecated_dependencies(spark, sf_dir):
    p = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("project"), "p_size")
    deps = p.select("project", F.lit("a").alias("name"), F.lit("1").alias("spec"))
    locked = p.select("project", F.lit("a").alias("name"), F.when(F.col("p_size") % 3 == 0, "use b").alias("deprecated"))
    return dp.deprecated(deps, locked).select("project", "name", "spec", "deprecated")


@query("SELECT 'pkg' || p_partkey AS name, p_size % 2 = 0 AS maintained, p_size % 5 = 0 AS deprecated, p_size % 3 <> 0 AND p_size % 2 = 0 AND p_size % 5 <> 0 AND p_size % 7 <> 0 AS safe FROM part")
def package_checks(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    name, size = F.concat(F.lit("pkg"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_size")
    licence = F.when(size % 3 != 0, "MIT").otherwise("GPL-3.0")
    registry = p.where(size % 7 != 0).select(name, F.lit("1.0").alias("version"), licence.alias("license"), F.when(size % 2 == 0, "2023-05-01").otherwise("2019-01-01").alias("modified"), (size % 5 == 0).alias("deprecated"))
    gone = p.where(size % 7 == 0).select(name, F.lit(None).cast("string").alias("version"), licence.alias("license"), F.when(size % 2 == 0, "2023-05-01").otherwise("2019-01-01").alias("modified"), (size % 5 == 0).alias("deprecated"))
    return dp.package_check(p.select(name), registry.unionAll(gone), "2024-01-01").select("name", "maintained", "deprecated", "safe")


def _deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, name, spec): what suppliers ship, with a version made from the part's size."""
    l = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()  # noqa: E741
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_type")
    spec = F.when(F.col("p_size") % 10 == 0, "*").when(F.col("p_size") % 10 == 1, "latest").otherwise(F.concat(F.lit("^"), F.col("p_size").cast("string"), F.lit(".2.0")))
    return l.join(p, l["l_partkey"] == p["p_partkey"]).select(F.col("l_suppkey").cast("string").alias("project"), F.concat("p_name", F.lit("-"), F.col("p_partkey").cast("string")).alias("name"), spec.alias("spec"), F.col("p_type").alias("kind"))


_DEPS = "WITH deps AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS project, p_name || '-' || p_partkey AS name, CASE WHEN p_size % 10 = 0 THEN '*' WHEN p_size % 10 = 1 THEN 'latest' ELSE '^' || p_size || '.2.0' END AS spec, p_type AS kind, p_size FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query(f"{_DEPS} SELECT project, name, spec FROM deps WHERE spec IN ('*', 'latest', '')")
def dependency_wildcard(spark, sf_dir):
    return _deps(spark, sf_dir).where(dp.is_wildcard(F.col("spec"))).select("project", "name", "spec")


@query(f"{_DEPS} SELECT project, name, spec FROM deps WHERE spec NOT IN ('*', 'latest', '') AND project IN (SELECT project FROM deps WHERE kind = 'PROMO') AND kind <> 'PROMO'")
def dependency_phantom(spark, sf_dir):
    deps = _deps(spark, sf_dir)
    return dp.phantoms(deps, deps.where("kind = 'PROMO'")).select("project", "name", "spec")


@query(f"{_DEPS} SELECT project, kind AS name, spec, CASE kind WHEN 'PROMO' THEN 40 ELSE 20 END AS current, CASE kind WHEN 'PROMO' THEN 40 ELSE 20 END - p_size AS behind FROM deps WHERE kind IN ('PROMO', 'SMALL') AND spec LIKE '^%' AND CASE kind WHEN 'PROMO' THEN 40 ELSE 20 END - p_size >= 3")
def dependency_outdated(spark, sf_dir):
    deps = _deps(spark, sf_dir).select("project", F.col("kind").alias("name"), "spec")
    return dp.outdated(deps, {"PROMO": 40, "SMALL": 20})


@query(f"{_DEPS}, f AS (SELECT CASE kind WHEN 'PROMO' THEN 'critical' WHEN 'SMALL' THEN 'high' WHEN 'LARGE' THEN 'medium' WHEN 'ECONOMY' THEN 'low' ELSE 'info' END AS severity FROM deps) SELECT count(*) AS total, count(*) FILTER (severity='critical') AS critical, count(*) FILTER (severity='high') AS high, count(*) FILTER (severity='medium') AS moderate, count(*) FILTER (severity IN ('low','info')) AS low FROM f")
def dependency_summary(spark, sf_dir):
    kinds = {"PROMO": "critical", "SMALL": "high", "LARGE": "medium", "ECONOMY": "low"}
    return dp.summary(_deps(spark, sf_dir).select(sev.lookup(F.col("kind"), kinds, "info").alias("severity")))


@query(f"{_DEPS}, v AS (SELECT DISTINCT kind, '^' || CAST(g AS VARCHAR) || '.2.0' AS spec FROM deps, generate_series(1, 5) t(g)) SELECT d.project, d.name, d.spec AS version, 'medium' AS severity FROM deps d JOIN v ON d.kind = v.kind AND d.spec = v.spec")
def advisories(spark, sf_dir):
    deps = _deps(spark, sf_dir)
    table = deps.select(F.col("kind").alias("module_name")).distinct().select(
        "module_name", F.array(*[F.lit(f"^{i}.2.0") for i in range(1, 6)]).alias("versions"), F.lit("moderate").alias("severity")
    )
    locked = deps.select("project", F.col("kind").alias("name"), F.col("spec").alias("version"), F.col("name").alias("own"))
    named = locked.select("project", F.col("name"), "version", "own")
    hit = dp.advisory_findings(named.select("project", "name").distinct(), named, table)
    return hit.join(named, ["project", "name", "version"]).select("project", F.col("own").alias("name"), "version", "severity").distinct()


@query("SELECT p_partkey AS project, 'postinstall' AS script, 'uses curl' AS reason, 'critical' AS severity FROM part WHERE p_size % 7 = 0")
def install_scripts(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    text = F.concat(F.lit('{"scripts":{"'), F.when(F.col("p_size") % 7 == 0, "postinstall").otherwise("test"), F.lit('":"curl -s x","build":"tsc"}}'))
    return dp.install_scripts(src.packages(p.select(F.col("p_partkey").alias("project"), text.alias("package_json")))).select("project", "script", "reason", "severity")


@query("SELECT project, name, spec FROM (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS project, p_brand AS name, CASE WHEN p_size > 25 THEN '2' ELSE '1' END AS spec FROM part)")
def declared_dependencies(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    one = F.create_map("p_brand", F.lit("1"))
    two = F.when(F.col("p_size") > 25, F.create_map("p_brand", F.lit("2")))
    return dp.declared(p.select(F.col("p_partkey").cast("string").alias("project"), one.alias("dependencies"), two.alias("devDependencies")))


@query(f"{_DEPS} SELECT kind AS category, severity, count(*) AS n FROM (SELECT DISTINCT kind, CASE WHEN p_size > 25 THEN 'high' ELSE 'low' END AS severity, project, name FROM deps) GROUP BY 1, 2")
def audit_union(spark, sf_dir):
    deps = _deps(spark, sf_dir)
    size = F.regexp_extract("spec", r"(\d+)", 1).try_cast("int")
    row = deps.select(F.col("kind").alias("category"), "project", "name", "spec").distinct()
    p = read_table(spark, sf_dir, "part").select(F.concat("p_name", F.lit("-"), F.col("p_partkey").cast("string")).alias("name"), "p_size")
    sized = row.join(p, "name").withColumn("severity", F.when(F.col("p_size") > 25, "high").otherwise("low")).drop("p_size")
    two = fd.merge([sized.where(size.isNull()), sized.where(size.isNotNull())])
    return two.groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"))


_KEY = "CASE p_partkey % 6 WHEN 0 THEN 'SS-FREE-' WHEN 1 THEN 'SS-PRO-' WHEN 2 THEN 'SS-TEAM-' WHEN 3 THEN 'SS-AGENCY-' WHEN 4 THEN 'XX-PRO-' ELSE 'SS-ENTERPRISE-' END || CASE WHEN p_size % 5 = 0 THEN 'short' ELSE 'abcD1234' END || p_partkey % 10"


@query(f"SELECT p_partkey AS id, regexp_matches(k, '^SS-(FREE|PRO|TEAM|AGENCY)-[A-Za-z0-9]{{8,}}$') AS valid, CASE WHEN regexp_matches(k, '^SS-(FREE|PRO|TEAM|AGENCY)-[A-Za-z0-9]{{8,}}$') THEN lower(string_split(k, '-')[2]) END AS tier, CASE WHEN regexp_matches(k, '^SS-(FREE|PRO|TEAM|AGENCY)-[A-Za-z0-9]{{8,}}$') THEN CAST(CASE string_split(k, '-')[2] WHEN 'FREE' THEN 1 WHEN 'PRO' THEN 5 WHEN 'TEAM' THEN 20 ELSE 100 END AS INTEGER) END AS projects FROM (SELECT p_partkey, {_KEY} AS k FROM part)")
def licence_tier(spark, sf_dir):
    p = read_table(spark, sf_dir, "part")
    heads = F.get(F.array(*map(F.lit, ("SS-FREE-", "SS-PRO-", "SS-TEAM-", "SS-AGENCY-", "XX-PRO-", "SS-ENTERPRISE-"))), (F.col("p_partkey") % 6).cast("int"))
    key = F.concat(heads, F.when(F.col("p_size") % 5 == 0, "short").otherwise("abcD1234"), (F.col("p_partkey") % 10).cast("string"))
    keys = p.select(F.col("p_partkey").alias("id"), key.alias("key"))
    told = licences(keys.select("key").distinct(), "2024-01-01")
    return keys.join(told, "key").select("id", "valid", "tier", "projects")
