"""Dependency checks over manifests and lock files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ironsieve.functions import severity as sev
from ironsieve.operators.prefix import places

# fixed values: well-known packages, in the order in which a likeness is looked for
POPULAR = [
    "react", "express", "lodash", "axios", "moment", "chalk", "commander", "next", "vue", "angular", "webpack",
    "typescript", "zod", "prisma", "drizzle", "hono", "fastify", "vite", "esbuild", "rollup", "jest", "vitest",
    "mocha", "prettier", "eslint", "tailwindcss", "postcss", "dotenv", "cors", "helmet", "jsonwebtoken", "bcrypt",
    "mongoose", "sequelize", "socket.io", "redis", "bull", "passport", "multer", "sharp", "puppeteer", "playwright",
]
# fixed values: the packages that a single name is compared with before it is added
CHECKED = ["express", "react", "lodash", "axios", "chalk", "commander", "next", "typescript", "webpack", "eslint", "prettier", "jest", "vitest", "fastify", "hono", "zod", "prisma"]
# fixed values: packages that only look like misspellings
LEGITIMATE = [
    "recast", "oxlint", "biome", "bun", "esbuild", "swc", "turbopack", "rome", "deno-lint", "jose", "bcryptjs",
    "pino", "vaul", "dub", "zod", "jotai", "zustand", "immer", "luxon", "dayjs", "nanoid", "cuid", "ky", "got",
    "ora", "ink", "listr", "execa", "tempy", "meow", "yargs", "chalk", "kleur", "picocolors", "superjson", "trpc",
    "@biomejs/biome", "@swc/core", "@oxlint/core",
]
# fixed values: current major versions
MAJORS = {
    "react": 19, "express": 5, "lodash": 4, "axios": 1, "chalk": 5, "commander": 12, "next": 15, "vue": 3, "webpack": 5, "typescript": 5,
    "zod": 3, "jest": 29, "eslint": 9, "prettier": 3, "tailwindcss": 4, "postcss": 8, "vite": 6, "esbuild": 0, "rollup": 4, "vitest": 2,
    "mocha": 10, "fastify": 5, "hono": 4, "mongoose": 8, "sequelize": 6, "redis": 4, "passport": 0, "sharp": 0, "puppeteer": 23, "playwright": 1,
}
# fixed values: known fakes of packages
FAKES = {
    "express": ["expres", "expresss", "exxpress", "xpress"], "lodash": ["lodashs", "lodahs", "lod-ash", "loadash"], "axios": ["axois", "axio", "axioss"], "react": ["raect", "reactt", "reakt"],
    "chalk": ["chaulk", "chalks", "chlak"], "commander": ["comander", "comanderr"], "webpack": ["webpak", "web-pack", "webpackk"], "typescript": ["typscript", "typescipt", "tyepscript"],
}
# fixed values: what makes an install script suspicious
INSTALL_SCRIPTS = ("postinstall", "preinstall", "install", "prepare", "prepublish")
INSTALL_PATTERNS = (
    (r"\bcurl\b", "uses curl"),
    (r"\bwget\b", "uses wget"),
    (r"\bfetch\b", "uses fetch"),
    (r"\bnode\s+-e\b", "runs inline node"),
    (r"\bpython[23]?\s+-c\b", "runs inline python"),
    (r"\beval\b", "uses eval"),
    (r"\bbase64\b", "uses base64 encoding"),
    (r"\|\s*(sh|bash|zsh|node)\b", "pipes to shell/node"),
    (r"/dev/tcp/", "contains reverse shell pattern"),
)
LICENCES = [
    "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "0BSD", "Unlicense", "CC0-1.0", "MPL-2.0",
]


def declared(packages: DataFrame, *kinds: str) -> DataFrame:
    """(project, name, spec): a row for each dependency; a later kind overrides an earlier one."""
    kinds = kinds or ("dependencies", "devDependencies")
    rows = [
        packages.select("project", F.lit(i).alias("kind"), F.explode(k).alias("name", "spec")) for i, k in enumerate(kinds)
    ]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionAll(r)
    return every.groupBy("project", "name").agg(F.max_by("spec", "kind").alias("spec"))


def is_wildcard(spec: Column) -> Column:
    return F.coalesce(spec.isin("*", "latest", ""), F.lit(False))


def lookalikes(names: DataFrame, known: list[str] | None = None, legitimate: list[str] | None = None, name: str = "name") -> DataFrame:
    """(name, similar_to): names within edit distance 1 or 2 of a well-known package, the first in its list.

    The list is short and part of the plan, so no join is needed; distinct names are measured once.
    """
    known = POPULAR if known is None else known
    legitimate = LEGITIMATE if legitimate is None else legitimate
    low = F.lower(F.col(name))
    bare = F.when(F.startswith(low, F.lit("@")), F.regexp_replace(low, r"^@[^/]+/", "")).otherwise(low)
    near = F.filter(
        F.array(*[F.lit(k) for k in known]),
        lambda k: F.levenshtein(low, F.lower(k)).between(1, 2),
    )
    fine = low.isin(known) | low.isin(legitimate) | bare.isin(legitimate)
    return (
        names.select(name)
        .distinct()
        .where(~fine)
        .select(name, F.get(near, F.lit(0)).alias("similar_to"))
        .where("similar_to is not null")
    )


def _one_less(word: Column) -> Column:
    """The word without one of its characters, for each."""
    rest = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.left(word, i - 1), F.substring(word, i + 1, F.length(word))))
    return F.when(F.length(word) > 0, rest).otherwise(F.array().cast("array<string>"))


def _neighbourhood(word: Column, most: int) -> Column:
    """The word and what is left when up to ``most`` of its characters are taken away."""
    every = level = F.array(word)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, _one_less)))
        every = F.concat(every, level)
    return F.array_distinct(every)


def lookalikes_among(names: DataFrame, known: DataFrame, legitimate: DataFrame | None = None, most: int = 2, name: str = "name") -> DataFrame:
    """(name, similar_to): as ``lookalikes``, against a registry of any size, known (name, place); the first by place.

    Two words at most ``most`` edits apart have a word in common that each becomes by taking away up to ``most`` of its
    characters, so both sides' deletion neighbourhoods are joined by hash, and only words that meet are measured. A word
    of n characters has about n ** most / most! of them. Case is ignored; equal names take the lowest place; null names
    are left out.
    """
    low = F.lower(F.col(name))
    bare = F.regexp_replace(low, r"^@[^/]+/", "")
    listed = known.select(F.col("name").alias("_known"), F.lower("name").alias("_low"), "place").where("_low is not null")
    exact = known.select(F.col("name").alias("_low")).where("_low is not null").distinct()
    mine = names.select(name, low.alias("_low"), bare.alias("_bare")).where("_low is not null").distinct().join(exact, "_low", "left_anti")
    if legitimate is not None:
        fine = legitimate.select(F.col("name").alias("_fine")).where("_fine is not null").distinct()
        mine = mine.join(fine, F.col("_low") == F.col("_fine"), "left_anti").join(fine, F.col("_bare") == F.col("_fine"), "left_anti")
    left = mine.select(name, F.col("_low").alias("_mine"), F.explode(_neighbourhood(F.col("_low"), most)).alias("_part"))
    left = left.select(name, "_mine", F.xxhash64("_part").alias("_key"))
    right = listed.groupBy("_low").agg(F.min_by("_known", "place").alias("_known"), F.min("place").alias("place"))
    right = right.select("_known", "_low", "place", F.explode(_neighbourhood(F.col("_low"), most)).alias("_part")).select("_known", "_low", "place", F.xxhash64("_part").alias("_key"))
    met = left.join(right, "_key").where(F.levenshtein("_mine", "_low").between(1, most))
    return met.groupBy(name).agg(F.min_by("_known", "place").alias("similar_to"))


def fakes(names: DataFrame, name: str = "name") -> DataFrame:
    """(name, real): names on the list of known fakes."""
    real = F
    for k, v in FAKES.items():
        real = real.when(F.col(name).isin(v), k)
    return names.select(name, real.otherwise(None).alias("real")).where("real is not null")


def phantoms(deps: DataFrame, locked: DataFrame) -> DataFrame:
    """Declared but not locked, in projects that have a lock file: locked (project, name)."""
    with_lock = locked.select("project").distinct()
    return (
        deps.where(~is_wildcard(F.col("spec")))
        .join(with_lock, "project", "left_semi")
        .join(locked.select("project", "name").distinct(), ["project", "name"], "left_anti")
    )


def deprecated(deps: DataFrame, locked: DataFrame) -> DataFrame:
    return deps.join(locked.where("deprecated is not null").select("project", "name", "deprecated"), ["project", "name"])


def outdated(deps: DataFrame, majors: dict[str, int] | None = None, least: int = 3) -> DataFrame:
    """Dependencies at least ``least`` major versions behind: adds current, behind."""
    current = sev.lookup(F.col("name"), majors or MAJORS, None).cast("int")
    major = F.regexp_extract("spec", r"(\d+)", 1).try_cast("int")
    return (
        deps.withColumn("current", current).withColumn("behind", F.col("current") - major).where(F.col("behind") >= least)
    )


def in_order(packages: DataFrame) -> DataFrame:
    """(project, name, spec, place): a row for each dependency, in the order of the manifest; a name that development
    dependencies repeat keeps its place and takes their version."""
    rows = [packages.select("project", F.lit(i).alias("kind"), F.posexplode(k).alias("pos", "name", "spec")) for i, k in enumerate(("dependencies", "devDependencies"))]
    every = rows[0].unionAll(rows[1])
    return every.groupBy("project", "name").agg(F.max_by("spec", "kind").alias("spec"), F.min(F.struct("kind", "pos")).alias("place"))


# fixed values: (kind, severity, description, fix) of what is found in a manifest; {} are the columns named after them
_TEXTS = (
    ("wildcard", "wildcard-version", "high", ('Dependency "', "name", '" uses wildcard version "', "spec", '". This allows arbitrary versions to be installed, including potentially malicious ones.'), ('Pin "', "name", '" to a specific version range (e.g., "^x.y.z") instead of "', "spec", '".')),
    ("phantom", "phantom", "medium", ('Dependency "', "name", '" is declared in package.json but has no entry in the lockfile. This may indicate the lockfile is out of date or the dependency was never installed.'), ('Run "npm install" to regenerate the lockfile and ensure "', "name", '" is properly resolved.')),
    ("deprecated", "deprecated", "medium", ('Dependency "', "name", '" is deprecated: ', "deprecated", ""), ('Find an actively maintained alternative to "', "name", '" and migrate away from this package.')),
    ("typosquat", "typosquat", "critical", ('Dependency "', "name", '" looks like a typosquat of popular package "', "similar_to", '". This could be a malicious package impersonating a legitimate one.'), ('Verify that "', "name", '" is the intended package. If you meant "', "similar_to", '", replace it immediately.')),
    ("outdated", "outdated", "low", ('Dependency "', "name", "@", "spec", '" is ', "behind", " major versions behind the current release (v", "current", "). Very old versions often have unpatched security vulnerabilities."), ('Update "', "name", '" to a recent version (current major: v', "current", "). Review the changelog for breaking changes before upgrading.")),
)


def dependency_findings(packages: DataFrame, locked: DataFrame, file: str = "package.json", known: DataFrame | None = None) -> DataFrame:
    """(project and schemas.FINDING's columns) of manifests: wildcards, names missing from the lock file, deprecated ones,
    lookalikes and very old versions.

    Ids are ``dep-kind-n`` with one counter for each project, from 0, over all kinds: by the manifest's order, then in
    the order of the kinds. ``known`` (name, place) is the registry for lookalikes, by default the short list.
    """
    deps = in_order(packages)
    names = deps.select("name").distinct()
    like = lookalikes(names) if known is None else lookalikes_among(names, known)
    lock = locked.groupBy("project", "name").agg(F.first("deprecated", ignorenulls=True).alias("deprecated"))
    with_lock = locked.select("project").distinct().withColumn("has_lock", F.lit(True))
    current = sev.lookup(F.col("name"), MAJORS, None).cast("int")
    facts = (
        deps.join(lock.withColumn("in_lock", F.lit(True)), ["project", "name"], "left")
        .join(with_lock, "project", "left")
        .join(like, "name", "left")
        .withColumns({"current": current, "behind": current - F.regexp_extract("spec", r"(\d+)", 1).try_cast("int")})
    )
    loose = is_wildcard(F.col("spec"))
    holds = {
        "wildcard": loose,
        "phantom": ~loose & F.col("has_lock").isNotNull() & F.col("in_lock").isNull(),
        "deprecated": F.col("deprecated").isNotNull() & (F.col("deprecated") != ""),
        "typosquat": F.col("similar_to").isNotNull(),
        "outdated": F.col("behind") >= 3,
    }

    def told(parts: tuple[str, ...]) -> Column:
        return F.concat(*[F.col(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])

    each = []
    for i, (kind, type_, severity, text, fix) in enumerate(_TEXTS):
        one = F.struct(F.lit(i).alias("no"), F.lit(f"dep-{kind}-").alias("prefix"), F.lit(severity).alias("severity"), F.lit(f"dependency-{type_}").alias("type"), told(text).alias("description"), told(fix).alias("fix_suggestion"))
        each.append(F.when(F.coalesce(holds[kind], F.lit(False)), one))
    rows = facts.select("project", "place", F.explode(F.array_compact(F.array(*each))).alias("f")).select("project", "place", "f.*")
    numbered = places(rows, ["project"], ["place", "no"], "n")
    return numbered.select(
        "project",
        F.concat("prefix", (F.col("n") - 1).cast("string")).alias("id"),
        F.lit("pattern").alias("engine"),
        "severity",
        "type",
        F.lit(file).alias("file"),
        F.lit(0).alias("line"),
        "description",
        "fix_suggestion",
        F.lit(False).alias("auto_fixable"),
    )


def install_scripts(packages: DataFrame) -> DataFrame:
    """(project, script, reason, severity, evidence): suspicious commands in scripts that run on install."""
    rows = packages.select("project", F.explode("scripts").alias("script", "evidence")).where(
        F.col("script").isin(*INSTALL_SCRIPTS) & (F.col("evidence") != "")
    )
    found = F.array_compact(F.array(*[F.when(F.rlike("evidence", F.lit(p)), F.lit(d)) for p, d in INSTALL_PATTERNS]))
    severe = F.when(F.contains("script", F.lit("install")), "critical").otherwise("high")
    return rows.select("project", "script", F.explode(found).alias("reason"), severe.alias("severity"), "evidence")


def advisory_findings(deps: DataFrame, locked: DataFrame, advisories: DataFrame) -> DataFrame:
    """Locked versions that an advisory lists: advisories (module_name, versions, severity, title, …)."""
    have = deps.join(locked.select("project", "name", "version"), ["project", "name"])
    named = advisories.withColumn("version", F.explode("versions")).withColumnRenamed("module_name", "name")
    named = named.withColumn("severity", sev.lookup(F.col("severity"), sev.NPM, "medium"))
    return have.join(named, ["name", "version"])


def summary(findings: DataFrame) -> DataFrame:
    """One row of counts as a package manager reports them: medium is moderate, informational counts as low."""
    s = F.col("severity")
    return findings.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(s == "critical").alias("critical"),
        F.count_if(s == "high").alias("high"),
        F.count_if(s == "medium").alias("moderate"),
        F.count_if(s.isin("low", "info")).alias("low"),
    )


def package_check(names: DataFrame, registry: DataFrame, today: str) -> DataFrame:
    """Whether packages are safe to add: licence, upkeep within two years, deprecation and likeness to known names."""
    like = lookalikes(names)
    got = names.join(registry, "name", "left").join(like, "name", "left")
    fresh = F.coalesce(F.to_date("modified") >= F.add_months(F.lit(today).cast("date"), -24), F.lit(False))
    licence = F.coalesce(F.col("license").isin(LICENCES), F.lit(False))
    old = F.coalesce(F.col("deprecated"), F.lit(False))
    known = F.col("version").isNotNull()
    why = F.concat_ws(
        "; ",
        F.when(~known, "not in the registry"),
        F.when(F.col("similar_to").isNotNull(), F.concat(F.lit("looks like "), F.col("similar_to"))),
        F.when(known & ~licence, "licence needs a review"),
        F.when(known & ~fresh, "not maintained for two years"),
        F.when(old, "deprecated"),
    )
    safe = known & licence & fresh & ~old & F.col("similar_to").isNull()
    return got.select("name", "version", "license", fresh.alias("maintained"), old.alias("deprecated"), "similar_to", safe.alias("safe"), why.alias("recommendation"))


# fixed values: what a project on a framework should have: (kind, packages of which one will do, priority)
RECOMMENDED = {
    "express": (("missing_helmet", ("helmet",), "high"), ("missing_cors", ("cors",), "medium"), ("missing_rate_limit", ("express-rate-limit", "rate-limiter-flexible"), "high")),
    "nextjs": (("missing_csp", (), "high"), ("missing_rate_limit", ("rate-limiter-flexible", "@upstash/ratelimit"), "medium")),
    "fastify": (("missing_helmet", ("@fastify/helmet",), "high"), ("missing_cors", ("@fastify/cors",), "medium"), ("missing_rate_limit", ("@fastify/rate-limit",), "high")),
    "hono": (("missing_cors", (), "medium"), ("missing_csp", (), "high")),
}


def recommended(projects: DataFrame, deps: DataFrame, env_ignored: Column | None = None) -> DataFrame:
    """(project, kind, package, priority): what projects (project, framework) lack; what no package gives is always told.
    With ``env_ignored`` (a column of projects), also those whose environment files are not kept out of the repository."""
    rows = [(f, k, list(p), q) for f, kinds in RECOMMENDED.items() for k, p, q in kinds]
    table = projects.sparkSession.createDataFrame(rows, "framework string, kind string, packages array<string>, priority string")
    wanted = projects.join(F.broadcast(table), "framework").withColumn("name", F.explode_outer("packages"))
    have = deps.select("project", "name").distinct().withColumn("has", F.lit(True))
    told = wanted.join(have, ["project", "name"], "left").groupBy("project", "kind", "priority").agg(
        F.bool_or(F.coalesce("has", F.lit(False))).alias("has"), F.min(F.get("packages", F.lit(0))).alias("package")
    )
    out = told.where(~F.col("has")).select("project", "kind", "package", "priority")
    if env_ignored is None:
        return out
    bare = projects.where(~F.coalesce(env_ignored, F.lit(False)))
    return out.unionByName(bare.select("project", F.lit("missing_env_config").alias("kind"), F.lit(None).cast("string").alias("package"), F.lit("high").alias("priority")))
