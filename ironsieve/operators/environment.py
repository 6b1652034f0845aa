"""Threats in configuration, hooks, prompts and skills: predicates over whole contents, compiled into one projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ironsieve.functions.text import shortened, strip_invisible, trimmed


@dataclass(frozen=True)
class Threat:
    """All of ``groups`` must hold, each by one of its patterns; ``never`` must not. Patterns in ``low`` test lower case."""

    id: str
    category: str
    severity: str
    groups: tuple[tuple[str, ...], ...]
    low: bool = False
    never: tuple[str, ...] = field(default=())
    raw: bool = False  # tests the content with its invisible characters


# fixed values: patterns that several threats share
PIPED = (r"curl\s[^|]*\|\s*(sh|bash|zsh|node)", r"wget\s[^|]*\|\s*(sh|bash|zsh|node)")
REVERSE = (r"/dev/tcp/", r"bash\s+-i", r"mkfifo\s")
HEXRUN = r"\\x[0-9a-fA-F]{2}(?:\\x[0-9a-fA-F]{2}){3,}"
SAFE_PACKAGES = ("@modelcontextprotocol/", "@anthropic/", "@cloudflare/", "@supabase/", "@prisma/", "@sentry/", "mcp-server-", "@smithery/", "firecrawl-mcp", "context7", "@context7/")
SAFE_HOSTS = r"(?i)github\.com|npmjs\.com|anthropic\.com|claude\.ai|vercel\.com|docs\.|stackoverflow\.com|developer\."

# fixed values: threats by category
THREATS = (
    Threat("MALICIOUS_MCP_CURL_PIPE", "mcp_server", "critical", (PIPED,)),
    Threat("MALICIOUS_MCP_ENV_SECRET", "mcp_server", "high", ((r"(?i)--(?:api[_-]?key|token|secret|password|auth)\s*[=\s]\s*(?![\$\{])\S{8,}", r"sk-[a-zA-Z0-9]{20,}|ghp_[a-zA-Z0-9]{30,}|AKIA[A-Z0-9]{16}"),)),
    Threat("MALICIOUS_MCP_REVERSE_SHELL", "mcp_server", "critical", ((*REVERSE, r"ngrok\s"),)),
    Threat("MALICIOUS_MCP_INLINE_SCRIPT", "mcp_server", "critical", ((r"\b(?:python3?|ruby|perl|node)\s+(?:-[ce]|-exec)\s",),)),
    Threat("MALICIOUS_HOOK_EXFILTRATION", "hook", "critical", ((r"\b(curl|wget)\s+.*https?://(?!localhost|127\.0\.0\.1)", r"\bnc\s+-[a-zA-Z]*\s+\S+\s+\d+"),)),
    Threat("MALICIOUS_HOOK_REVERSE_SHELL", "hook", "critical", ((*REVERSE, r"\bngrok\b"),)),
    Threat("MALICIOUS_HOOK_CREDENTIAL_THEFT", "hook", "critical", ((r"(~|\$HOME)/(\.ssh/|\.aws/credentials|\.npmrc|\.env\b)",),)),
    Threat("MALICIOUS_HOOK_OBFUSCATED", "hook", "high", ((r"base64\s+(-d|--decode)", r"eval\s*\$\(echo", HEXRUN, r"printf\s+'\\x[0-9a-fA-F]"),)),
    Threat("MALICIOUS_HOOK_PERSISTENCE", "hook", "high", ((r"\.bashrc|\.zshrc|\.bash_profile|\.profile", r"crontab\s", r"LaunchAgent|LaunchDaemon", r"/etc/cron"),)),
    Threat("PROMPT_INJECTION_OVERRIDE", "prompt_injection", "critical", ((r"ignore\s+(all\s+)?previous\s+instructions", r"disregard\s+(all\s+)?(previous\s+)?instructions", r"you\s+are\s+now\s+(a|an|the)\s", "override your instructions", "forget your instructions", "new persona"),), low=True),
    Threat("PROMPT_INJECTION_SILENT_EXEC", "prompt_injection", "critical", (("don't show the user", "do not show the user", "execute silently", "hide (the )?output", "run silently", "without the user knowing", "without user knowledge"),), low=True),
    Threat("PROMPT_INJECTION_EXFIL", "prompt_injection", "critical", (("steal", "exfiltrate", "send to"), ("credential", "token", "key", "password", "secret", "source code")), low=True),
    Threat("PROMPT_INJECTION_BASE64", "prompt_injection", "high", ((r"[A-Za-z0-9+/]{40,}={0,2}",),)),
    Threat("PROMPT_INJECTION_REMOTE_FETCH", "prompt_injection", "high", (("fetch", "load", "download"), ("instructions from", "prompt from", "config from"), (r"https?://(?!localhost|127\.0\.0\.1)",)), low=True),
    Threat("PROMPT_INJECTION_INSTALL_PACKAGES", "prompt_injection", "medium", (("always install", "must install", "secretly install"), ("npm install", "pip install", "apt install")), low=True),
    Threat("PROMPT_INJECTION_UNICODE_OBFUSCATION", "prompt_injection", "critical", ((r"[​‌‍‪-‮⁦-⁩]",),), raw=True),
    Threat("PROMPT_INJECTION_BASE64_COMMAND", "prompt_injection", "high", ((r"\|\s*base64\b", r"base64\s+-[dD]\b", r"base64\s+--decode"),)),
    Threat("MALICIOUS_SKILL_REMOTE_INSTRUCTIONS", "skill", "critical", (("fetch", "curl", "wget", "http"), ("instructions", "prompt", "system message")), low=True),
    Threat("MALICIOUS_SKILL_SHELL_INJECTION", "skill", "high", ((r"\$\{?(?:input|args?|query|user_input|params?)\}?",), (r"\b(?:exec|spawn|execSync|system)\b", r"\bBash\b.*\$\{", r"run.*command.*\$\{"))),
    Threat("MALICIOUS_SKILL_OBFUSCATED", "skill", "high", ((r"base64\s+(-d|--decode)", r"atob\(", HEXRUN, r"eval\s*\("),)),
    Threat("MALICIOUS_SKILL_CREDENTIAL_ACCESS", "skill", "critical", ((r"(read.*|cat\s+.*)(\.ssh/|\.aws/credentials)", r"read.*\.env\b", r"cat\s+.*\.npmrc"),)),
)


def holds(threat: Threat, content: Column) -> Column:
    text = content if threat.raw else strip_invisible(content)
    text = F.lower(text) if threat.low else text
    out = F.lit(True)
    for patterns in threat.groups:
        out = out & F.rlike(text, F.lit("|".join(f"(?:{p})" for p in patterns)))
    for p in threat.never:
        out = out & ~F.rlike(text, F.lit(p))
    return out


def unvetted_package(command: Column) -> Column:
    """A package run by npx that is on no list of known ones."""
    package = F.regexp_extract(command, r"npx\s+(?:-[yY]\s+)?(?:--yes\s+)?(\S+)", 1)
    known = F.lit(False)
    for p in SAFE_PACKAGES:
        known = known | F.startswith(package, F.lit(p)) | (package == p.rstrip("/"))
    return (package != "") & ~known


def unsafe_urls(content: Column) -> Column:
    """The urls outside of well-known hosts."""
    urls = F.regexp_extract_all(content, F.lit(r"(?i)https?://[^\s'\")\]]+"), F.lit(0))
    return F.filter(urls, lambda u: ~F.rlike(u, F.lit(SAFE_HOSTS)))


def evidence(threat: Threat, content: Column) -> Column:
    """The first line that shows the threat by itself, else the first line; trimmed and shortened."""
    lines = F.split(content, "\n")
    shown = F.get(F.filter(lines, lambda x: holds(threat, x)), F.lit(0))
    return shortened(trimmed(F.coalesce(shown, F.get(lines, F.lit(0)))))


def scan(contents: DataFrame, category: str | None = None, threats: Sequence[Threat] = THREATS) -> DataFrame:
    """(location, id, category, severity, evidence): threats in (location, content), each location and threat once."""
    content = F.col("content")
    hits = [
        F.when(
            holds(t, content),
            F.struct(F.lit(t.id).alias("id"), F.lit(t.category).alias("category"), F.lit(t.severity).alias("severity"), evidence(t, content).alias("evidence")),
        )
        for t in threats
        if category in (None, t.category)
    ]
    rows = contents.select("location", F.explode(F.array_compact(F.array(*hits))).alias("t"))
    return rows.groupBy("location", F.col("t.id").alias("id")).agg(F.min("t").alias("t")).select("location", "t.*")


def scan_servers(servers: DataFrame) -> DataFrame:
    """Threats of tool servers (location, server, command, args, env): their command lines and environment values."""
    where = F.concat("location", F.lit(" -> "), "server")
    command = F.concat_ws(" ", F.array("command"), F.coalesce("args", F.array().cast("array<string>")))
    lines = servers.select(where.alias("location"), command.alias("content"))
    unknown = lines.where(unvetted_package(F.col("content"))).select(
        "location",
        F.lit("MALICIOUS_MCP_NPX_UNKNOWN").alias("id"),
        F.lit("mcp_server").alias("category"),
        F.lit("high").alias("severity"),
        shortened(trimmed(F.col("content"))).alias("evidence"),
    )
    pairs = servers.select(where.alias("at"), F.explode("env").alias("k", "v")).where("v is not null")
    secret = [t for t in THREATS if t.id == "MALICIOUS_MCP_ENV_SECRET"]
    joined = pairs.groupBy(F.concat("at", F.lit(" (env)")).alias("location")).agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "k", "v"))), "\n").alias("content")
    )
    v = F.col("v")
    value_rules = (
        ("MALICIOUS_MCP_ENV_CURL_PIPE", "critical", F.rlike(v, F.lit("|".join(f"(?:{p})" for p in PIPED)))),
        ("MALICIOUS_MCP_ENV_REVERSE_SHELL", "critical", F.rlike(v, F.lit("|".join(REVERSE)))),
        ("MALICIOUS_MCP_ENV_NODE_OPTIONS", "high", (F.col("k") == "NODE_OPTIONS") & F.rlike(v, F.lit(r"--require\s+")) & ~F.rlike(v, F.lit(r"--require\s+(?:ts-node|tsconfig-paths|dotenv)"))),
        ("MALICIOUS_MCP_ENV_SUSPICIOUS_VALUE", "high", F.rlike(v, F.lit(r"\bbase64\b|\beval\b|\|.*\b(sh|bash|zsh|node)\b"))),
    )
    hits = [F.when(c, F.struct(F.lit(i).alias("id"), F.lit("mcp_server").alias("category"), F.lit(s).alias("severity"))) for i, s, c in value_rules]
    values = pairs.select(
        F.concat("at", F.lit(" (env."), "k", F.lit(")")).alias("location"),
        F.explode(F.array_compact(F.array(*hits))).alias("t"),
        shortened(F.concat_ws("=", "k", "v")).alias("evidence"),
    ).select("location", "t.*", "evidence")
    every = scan(lines, "mcp_server").unionByName(unknown).unionByName(scan(joined, threats=secret)).unionByName(values)
    return every.dropDuplicates(["location", "id"])
