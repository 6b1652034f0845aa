"""Readers: project files, manifests, scanner reports and configuration. Schemas are declared (see ironsieve.schemas)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ironsieve import schemas
from ironsieve.functions import severity as sev
from ironsieve.functions.text import language_of

# fixed values: folders that hold no source of the project
SKIPPED = "node_modules .git dist build coverage .next .nuxt __pycache__ .venv vendor".split()


CALL_MAP_SKIPPED = [*SKIPPED, "out"]
COUNT_SKIPPED = [".git", "node_modules"]
# fixed values: what an audit of code looks at
AUDIT_EXTENSIONS = ["js", "ts", "jsx", "tsx", "mjs", "cjs", "mts", "cts", "py", "rb"]
AUDIT_SKIPPED, AUDIT_LARGEST = [".git", "node_modules", "dist"], 500_000


def below(path: Column, root: str) -> Column:
    """The path below the root folder, whatever the scheme both are written with."""
    plain = lambda c: F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:/*(?=/)", "")
    start = plain(F.lit(root.rstrip("/")))
    at = F.instr(plain(path), start)
    return F.ltrim(F.substr(plain(path), at + F.length(start)), F.lit("/"))


def file_paths(spark: SparkSession, root: str, skipped: list[str] = SKIPPED, names: str | None = None) -> DataFrame:
    """(path, file, size, content) of the files under a folder; ``file`` is relative. Skipped folders are those below
    the root, so the root itself may be inside one. Contents are read only if they are used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    raw = (reader.option("pathGlobFilter", names) if names else reader).load(root)
    files = raw.select("path", below(F.col("path"), root).alias("file"), F.col("length").alias("size"), "content")
    return files.where(~F.arrays_overlap(F.split("file", "/"), F.array(*[F.lit(s) for s in skipped]))) if skipped else files


def readable(content: Column) -> Column:
    """The content as text; null if it is not UTF-8."""
    return F.try_validate_utf8(content.cast("string"))


def project_files(spark: SparkSession, root: str, largest: int | None = None, languages: list[str] | None = None, skipped: list[str] = SKIPPED) -> DataFrame:
    """(file, size, language, text) of the source files under a folder; files that are not UTF-8 are left out."""
    files = file_paths(spark, root, skipped).withColumn("language", language_of(F.col("file")))
    files = files.where("language is not null" if languages is None else F.col("language").isin(languages))
    if largest is not None:
        files = files.where(F.col("size") <= largest)
    return files.select("file", "size", "language", readable(F.col("content")).alias("text")).where("text is not null")


def call_map_files(spark: SparkSession, root: str) -> DataFrame:
    """Scripts only, with the call map's own list of skipped folders."""
    return project_files(spark, root, languages=["typescript", "javascript"], skipped=CALL_MAP_SKIPPED)


def audit_files(spark: SparkSession, root: str) -> DataFrame:
    """(file, size, text) of the files that an audit looks at: by extension, at most 500,000 bytes."""
    files = file_paths(spark, root, AUDIT_SKIPPED).where(F.col("size") <= AUDIT_LARGEST)
    files = files.where(F.lower(F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1)).isin(AUDIT_EXTENSIONS))
    return files.select("file", "size", readable(F.col("content")).alias("text")).where("text is not null")


def count_files(spark: SparkSession, root: str) -> int:
    """So many files are under a folder, installed packages and version control apart."""
    return file_paths(spark, root, COUNT_SKIPPED).count()


def source_maps(spark: SparkSession, root: str) -> DataFrame:
    """(file, content) of the source maps under a folder, by path, outside of installed packages."""
    found = file_paths(spark, root, ["node_modules"], "*.map")
    return found.select("file", readable(F.col("content")).alias("content")).where("content is not null").orderBy("file")


def not_ignored(files: DataFrame, ignored_paths: DataFrame) -> DataFrame:
    """Files that version control does not ignore: ignored_paths (file), a path or a folder ending in a slash.

    A file is looked up by its own path and by each folder above it, so the sets may be of any size.
    """
    parts = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.when(n == F.size(parts), F.col("file")).otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))))
    hit = files.select("file", F.explode(above).alias("p")).join(ignored_paths.select(F.col("file").alias("p")).distinct(), "p", "left_semi")
    return files.join(hit.select("file").distinct(), "file", "left_anti")


def pull_request_files(files: DataFrame) -> DataFrame:
    """(file, text) of a pull request's files (filename, status, content): removed ones are left out, contents are
    base64, or plain text if they are not."""
    packed = F.regexp_replace("content", r"\s", "")
    fits = F.rlike(packed, F.lit(r"^[A-Za-z0-9+/]*={0,2}$")) & (F.length(packed) % 4 == 0)
    text = F.when(fits, readable(F.unbase64(packed)))
    return files.where(F.coalesce(F.col("status") != "removed", F.lit(True))).select(F.col("filename").alias("file"), F.coalesce(text, "content").alias("text"))


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob: ``**/`` any folders, ``**`` anything, ``*`` and ``?`` inside a segment."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = [*out, "(?:.*/)?"], i + 3
        elif glob.startswith("**", i):
            out, i = [*out, ".*"], i + 2
        else:
            c = glob[i]
            out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else c if c.isalnum() or c in "_/" else "\\" + c)
            i += 1
    return "^" + "".join(out) + "$"


def selected(files: DataFrame, include: list[str] = (), exclude: list[str] = (), path: str = "file") -> DataFrame:
    for g in [include] if include else []:
        files = files.where(F.rlike(path, F.lit("|".join(map(glob_pattern, g)))))
    return files.where(~F.rlike(path, F.lit("|".join(map(glob_pattern, exclude))))) if exclude else files


def ignored(path: Column, rules: list[str]) -> Column:
    """By an ignore file's lines, whatever the case: the last one that matches decides; ``!`` takes a path back."""
    out = F.lit(False)
    for line in rules:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        back = line.startswith("!")
        line = line.lstrip("!").rstrip("/")
        body = glob_pattern(line.lstrip("/"))[1:-1]
        head = "^" if line.startswith("/") or "/" in line else "(?:^|/)"
        out = F.when(F.rlike(path, F.lit(f"(?i){head}{body}(?:/.*)?$")), F.lit(not back)).otherwise(out)
    return out


_WILD = r"[*?]"


def ignore_rules(lines: DataFrame) -> DataFrame:
    """(project, no, back, pattern, key) of ignore files' lines (project, no, line); comments and empty lines are left out.

    ``key`` is text that every path it matches has (see ``_path_keys``): a literal beginning, a literal segment or the
    extension of a segment, else the empty key.
    """
    line = F.regexp_replace("line", r"^\s+|\s+$", "")
    bare = F.regexp_replace(line, r"^!+", "")
    body = F.regexp_replace(bare, "/+$", "")
    rows = lines.where((line != "") & ~F.startswith(line, F.lit("#"))).select("project", "no", F.startswith(line, F.lit("!")).alias("back"), body.alias("body"))
    from_root = F.contains("body", F.lit("/"))
    plain = F.lower(F.regexp_replace("body", "^/+", ""))
    escaped = F.regexp_replace(F.regexp_replace("body", "^/+", ""), r"[\\.+^${}()|\[\]]", r"\\$0")
    marked = F.regexp_replace(escaped, r"\*\*/|\*\*|\*|\?", "\x01$0")
    for wild, means in ((r"\x01\*\*/", "(?:.*/)?"), (r"\x01\*\*", ".*"), (r"\x01\*", "[^/]*"), (r"\x01\?", "[^/]")):
        marked = F.regexp_replace(marked, wild, means)
    pattern = F.concat(F.lit("(?is)"), F.when(from_root, "^").otherwise("(?:^|/)"), marked, F.lit("(?:/.*)?$"))
    beginning = F.regexp_extract(plain, r"^((?:[^*?/]+/)*[^*?/]+)(?:/|$)", 1)  # whole segments without wildcards
    extension = F.regexp_extract(plain, r"\.([^*?./]+)$", 1)
    key = (
        F.when(from_root & (beginning != ""), F.concat(F.lit("p:"), beginning))
        .when(~from_root & ~F.rlike("body", F.lit(_WILD)), F.concat(F.lit("s:"), plain))
        .when(~from_root & (extension != ""), F.concat(F.lit("e:"), extension))
        .otherwise("")
    )
    return rows.select("project", "no", "back", pattern.alias("pattern"), key.alias("key"))


def _path_keys(path: Column) -> Column:
    """The empty key, a path's beginnings, its segments and their extensions."""
    parts = F.split(F.lower(path), "/")
    beginnings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("p:"), F.array_join(F.slice(parts, 1, n), "/")))
    segments = F.transform(parts, lambda s: F.concat(F.lit("s:"), s))
    extensions = F.transform(parts, lambda s: F.concat(F.lit("e:"), F.regexp_extract(s, r"\.([^.]+)$", 1)))
    return F.array_distinct(F.concat(F.array(F.lit("")), beginnings, segments, extensions))


def ignored_by_rules(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(project, file) of files (project, file) that their project's ignore file (project, no, line) leaves out.

    As ``ignored``, with rules as rows: a rule meets only paths that hold its key, by a hash join, and the glob is tried
    on these; of those that match, the line with the highest number decides. Null paths are never left out.
    """
    rules = ignore_rules(lines)
    paths = files.select("project", "file").where("file is not null").distinct()
    met = paths.select("project", "file", F.explode(_path_keys(F.col("file"))).alias("key")).join(rules, ["project", "key"])
    last = met.where(F.rlike("file", F.col("pattern"))).groupBy("project", "file").agg(F.max_by("back", "no").alias("back"))
    return last.where("not back").select("project", "file")


def _finding(**given) -> list[Column]:
    return [given[c].alias(c) if c in given else F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in schemas.FINDING.split(", "))]


def semgrep_findings(reports: DataFrame, json: str = "report") -> DataFrame:
    """Findings of semgrep reports, one JSON text a row; null and broken reports have none."""
    r = reports.select(F.explode(F.from_json(json, schemas.SEMGREP)["results"]).alias("r"))
    return r.select(
        *_finding(
            id=F.col("r.check_id"), engine=F.lit("semgrep"), severity=sev.lookup(F.col("r.extra.severity"), sev.SEMGREP, "low"), type=F.element_at(F.split("r.check_id", r"\."), -1),
            file=F.col("r.path"), line=F.col("r.start.line"), description=F.col("r.extra.message"), fix_suggestion=F.coalesce("r.extra.fix", F.lit("")), auto_fixable=F.col("r.extra.fix").isNotNull(),
        )
    )


def gitleaks_findings(reports: DataFrame, json: str = "report") -> DataFrame:
    """Every leak is critical and can be fixed by moving it out of the code."""
    r = reports.select(F.explode(F.from_json(json, f"array<struct<{schemas.GITLEAKS.replace(' ', ':').replace(',:', ',')}>>")).alias("r"))
    return r.select(
        *_finding(
            id=F.col("r.RuleID"), engine=F.lit("gitleaks"), severity=F.lit("critical"), type=F.lit("hardcoded_secret"), file=F.col("r.File"), line=F.col("r.StartLine"),
            description=F.col("r.Description"), fix_suggestion=F.lit("Move this secret to an environment variable"), auto_fixable=F.lit(True),
        )
    )


def trivy_findings(reports: DataFrame, json: str = "report") -> DataFrame:
    """Vulnerabilities of each target; targets without any are skipped. Fixable if a fixed version is named."""
    t = reports.select(F.explode(F.from_json(json, schemas.TRIVY)["Results"]).alias("t"))
    v = t.select("t.Target", F.explode("t.Vulnerabilities").alias("v"))
    fixed = F.coalesce(F.col("v.FixedVersion"), F.lit("")) != ""
    return v.select(
        *_finding(
            id=F.col("v.VulnerabilityID"), engine=F.lit("trivy"), severity=sev.lookup(F.upper("v.Severity"), sev.TRIVY, "low"), type=F.lit("vulnerable_dependency"), file=F.col("Target"), line=F.lit(0),
            description=F.concat_ws(" ", F.concat("v.PkgName", F.lit("@"), "v.InstalledVersion", F.lit(":")), F.coalesce("v.Title", "v.Description")),
            fix_suggestion=F.when(fixed, F.concat(F.lit("Upgrade to "), "v.FixedVersion")).otherwise(""), auto_fixable=fixed,
        )
    )


def packages(manifests: DataFrame, json: str = "package_json") -> DataFrame:
    """(project, name, version, dependencies, …) of package manifests; broken ones are dropped."""
    return manifests.select("project", F.from_json(json, schemas.PACKAGE).alias("p")).where("p is not null").select("project", "p.*")


def locked_packages(locks: DataFrame, json: str = "lock_json") -> DataFrame:
    """(project, name, version, deprecated) of lock files; the old format's versions override the new one's."""
    p = locks.select("project", F.from_json(json, schemas.LOCKFILE).alias("l"))
    new = p.select("project", F.explode("l.packages").alias("k", "v")).where(F.startswith("k", F.lit("node_modules/")))
    new = new.select("project", F.regexp_replace("k", "^node_modules/", "").alias("name"), "v.version", "v.deprecated", F.lit(0).alias("o"))
    old = p.select("project", F.explode("l.dependencies").alias("name", "v")).select("project", "name", "v.version", F.lit(None).cast("string").alias("deprecated"), F.lit(1).alias("o"))
    return new.unionByName(old).groupBy("project", "name").agg(F.max_by("version", "o").alias("version"), F.max("deprecated").alias("deprecated"))


def python_requirements(texts: DataFrame) -> DataFrame:
    """(project, name, spec) of requirement lists; comments and options are no requirements."""
    lines = texts.select("project", F.explode(F.split("text", "\n")).alias("x")).select("project", F.trim(F.regexp_replace("x", "#.*$", "")).alias("x"))
    lines = lines.where(F.rlike("x", F.lit(r"^[A-Za-z0-9]")))
    return lines.select("project", F.lower(F.regexp_extract("x", r"^([A-Za-z0-9._-]+)", 1)).alias("name"), F.trim(F.regexp_extract("x", r"^[A-Za-z0-9._-]+(?:\[[^\]]*\])?\s*([^;]*)", 1)).alias("spec"))


def toml_dependencies(texts: DataFrame) -> DataFrame:
    """(project, name) of the dependencies that a pyproject or Pipfile text names: in ``dependencies = [...]`` lists, and
    as keys of dependency and package sections."""
    lists = F.array_join(F.regexp_extract_all("text", F.lit(r"(?s)\bdependencies\s*=\s*\[(.*?)\n?\]"), F.lit(1)), "\n")
    listed = F.regexp_extract_all(lists, F.lit(r"[\"']([A-Za-z0-9][A-Za-z0-9._-]*)"), F.lit(1))
    sections = F.array_join(F.regexp_extract_all("text", F.lit(r"(?m)^\[(?:[\w.-]*dependencies|packages|dev-packages)\]\s*\n((?:(?!\[).*(?:\n|$))*)"), F.lit(1)), "\n")
    keyed = F.regexp_extract_all(sections, F.lit(r"(?m)^[\"']?([A-Za-z0-9][A-Za-z0-9._-]*)[\"']?\s*="), F.lit(1))
    names = F.array_distinct(F.transform(F.concat(listed, keyed), F.lower))
    return texts.select("project", F.explode(names).alias("name")).where("name != 'python'")


def python_manifests(files: DataFrame) -> DataFrame:
    """(project, name) of each project's first manifest (project, kind, text): requirements, else pyproject, else Pipfile."""
    order = F.when(F.col("kind") == "requirements.txt", 0).when(F.col("kind") == "pyproject.toml", 1).when(F.col("kind") == "Pipfile", 2)
    known = files.withColumn("o", order).where("o is not null and text is not null")
    first = known.groupBy("project").agg(F.min(F.struct("o", "text")).alias("m")).select("project", "m.*")
    lines = python_requirements(first.where("o = 0")).select("project", "name")
    return lines.unionByName(toml_dependencies(first.where("o > 0"))).distinct()


# fixed values: where editors keep what a scan of the environment reads
ENVIRONMENT = (
    ("mcp_json", r"(?:^|/)\.?mcp\.json$|(?:^|/)\.(?:cursor|vscode)/mcp\.json$|(?:^|/)claude_desktop_config\.json$|(?:^|/)\.claude\.json$"),
    ("settings_json", r"(?:^|/)\.claude/settings(?:\.local)?\.json$"),
    ("command_file", r"(?:^|/)\.claude/(?:commands|skills|agents)/.*\.md$"),
    ("instructions_md", r"(?:^|/)(?:CLAUDE|AGENTS|GEMINI)\.md$|(?:^|/)\.(?:cursorrules|windsurfrules)$|(?:^|/)copilot-instructions\.md$"),
)


def environment_files(files: DataFrame) -> DataFrame:
    """(location, kind, content) of the configuration, instruction and command files among (file, text)."""
    kind = F.coalesce(*[F.when(F.rlike("file", F.lit(p)), F.lit(k)) for k, p in ENVIRONMENT])
    return files.select(F.col("file").alias("location"), kind.alias("kind"), F.col("text").alias("content")).where("kind is not null and content is not null")


def hooks(settings: DataFrame) -> DataFrame:
    """(location, content) of the commands that settings files run on events; broken files have none."""
    schema = "hooks map<string,array<struct<matcher:string,hooks:array<struct<type:string,command:string>>>>>"
    h = settings.select("location", F.explode(F.from_json("content", schema)["hooks"]).alias("event", "groups"))
    h = h.select("location", "event", F.explode("groups").alias("g")).select("location", "event", F.explode("g.hooks").alias("h"))
    return h.where("h.command is not null").select(F.concat("location", F.lit(" (hooks."), "event", F.lit(")")).alias("location"), F.col("h.command").alias("content"))


def tool_servers(configs: DataFrame, json: str = "content") -> DataFrame:
    """(location, server, command, args, env) of tool server configuration; broken files are dropped."""
    c = configs.select("location", F.from_json(json, schemas.MCP_CONFIG)["mcpServers"].alias("m"))
    return c.select("location", F.explode("m").alias("server", "s")).select("location", "server", "s.*")


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """Accepted findings (id, file, line, type, hash) of a baseline; none if there is no such file. Rows of another
    shape have no hash and are left out."""
    schema = "id string, file string, line int, type string, hash string"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path).where("hash is not null")
