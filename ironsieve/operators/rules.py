"""Rules over text, compiled into one projection per scan: no rule table is joined, so every pattern is compiled once.

A rule names text that a match must hold; that is looked for first, in whole files before they are taken apart, for all
rules at once (see ``_open_rules``), and a file's lines are tried by the rules whose needed text the file holds. Rules are
in chunks, so that a line passes over those of which none is open. Some hundred patterns are too much for one generated
class, so chunks are in a lambda's body, which Spark interprets. Line rules look at one line each, file rules at the whole
text; both may name a pattern whose presence anywhere in the file makes them silent.

Findings are suppressed by their context: comments, tagged templates and sanitising calls in the line, and packages that
the file imports (see ``IMPORTS_OFF``).
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ironsieve.functions.imports import categories
from ironsieve.functions.text import entropy, is_test_path, language_of

CHUNK = 12
PARTS = 8
_MARK = "\x01"


@dataclass(frozen=True)
class Rule:
    id: str
    pattern: str
    severity: str
    type: str
    description: str
    fix: str = ""
    auto_fixable: bool = False
    needs: str | tuple[str, ...] = ""  # text that a match holds; of several, one
    absent: str = ""  # a pattern that a matching line does not hold
    languages: tuple[str, ...] = ()  # files of other known languages are left alone
    skip_tests: bool = True
    absent_file: str = ""  # a pattern that the file does not hold
    file: bool = False  # the pattern runs over the whole text
    entropy: float = 0.0  # bits for each character that the longest quoted value has, at least

    def texts(self) -> tuple[str, ...]:
        return (self.needs,) if isinstance(self.needs, str) else self.needs


# rules that packages of a category make needless
IMPORTS_OFF = {
    "auth": ("AUTH_MISSING_AUTH_MIDDLEWARE", "NEXT_API_NO_AUTH", "NEXT_SERVER_ACTION_NO_AUTH", "VERCEL_CRON_NO_AUTH", "WEBSOCKET_UPGRADE_NO_AUTH"),
    "sanitization": ("XSS_DANGEROUSLY_SET_INNERHTML", "REACT_DANGEROUSLYSETINNERHTML_VARIABLE", "XSS_INNERHTML", "XSS_DOCUMENT_WRITE"),
    "helmet": ("CONFIG_NO_SECURITY_HEADERS",),
    "csrf": ("MISSING_CSRF_PROTECTION", "SERVER_ACTION_NO_CSRF"),
    "rate_limit": ("RATE_LIMIT_AUTH_ENDPOINT", "LOGIN_NO_LOCKOUT"),
    "validation": ("MASS_ASSIGNMENT", "SQS_MESSAGE_NO_VALIDATION"),
    "crypto": ("TWO_FA_BACKUP_CODES_UNHASHED",),
}
# what of a line's context silences findings of a type
CONTEXTS_OFF = {
    "sql_injection": r"(?:\b(?:sql|gql|Prisma\.sql)|\$queryRaw|\$executeRaw)`",
    "xss": r"(?i)\b(?:\w*sanitiz\w*|DOMPurify\.\w+|purify|escapeHtml|encodeURIComponent|JSON\.stringify)\s*\(",
}
COMMENT = r"^\s*(?://|#|\*(?:[^/]|$)|/\*)"


def _any(text: Column, needs: Sequence[str]) -> Column:
    """Whether the text holds one of the needed ones; halved again and again, as the compiler minds depth."""
    if len(needs) == 1:
        return F.contains(text, F.lit(needs[0]))
    half = len(needs) // 2
    return _any(text, needs[:half]) | _any(text, needs[half:])


def fires(rule: Rule, line: Column) -> Column:
    """Whether a line rule's own conditions hold in a line."""
    found = F.rlike(line, F.lit(rule.pattern))
    if rule.absent:
        found = found & ~F.rlike(line, F.lit(rule.absent))
    if rule.type != "hardcoded_secret":
        found = found & ~F.rlike(line, F.lit(COMMENT))
    if rule.type in CONTEXTS_OFF:
        found = found & ~F.rlike(line, F.lit(CONTEXTS_OFF[rule.type]))
    if rule.entropy:
        found = found & (entropy(F.regexp_extract(line, r"['\"]([^'\"]{8,})['\"]", 1)) >= rule.entropy)
    return _any(line, rule.texts()) & found if rule.needs else found


def lines_of(files: DataFrame, text: str = "text") -> DataFrame:
    """(…, line_no, line_text) of files, without their text; null texts have no lines."""
    keep = [c for c in files.columns if c != text]
    return files.select(*keep, F.posexplode(F.split(F.col(text), "\n")).alias("_p", "line_text")).select(
        *keep, (F.col("_p") + 1).alias("line_no"), "line_text"
    )


def _open_rule(rule: Rule) -> Column:
    """Whether a rule looks at the file at all: by language, path and what else the file holds."""
    out = F.lit(True)
    if rule.languages:
        out = F.coalesce(F.col("_lang").isin(*rule.languages), F.lit(True))
    if rule.skip_tests:
        out = out & ~F.col("_test")
    off = [c for c, ids in IMPORTS_OFF.items() if rule.id in ids]
    if off:
        out = out & ~F.arrays_overlap("_imports", F.array(*map(F.lit, off)))
    return out


def _silent(rules: Sequence[tuple[int, Rule]], text: Column) -> Column:
    """Numbers of rules that something elsewhere in the file silences."""
    hits = [F.when(F.array_contains("_open", p) & F.rlike(text, F.lit(r.absent_file)), F.lit(i)) for p, (i, r) in enumerate(rules) if r.absent_file]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<int>")


def _open_rules(rules: Sequence[tuple[int, Rule]], text: Column) -> Column:
    """Places in ``rules`` of those whose needed text the file holds, ascending.

    One linear pass looks for the texts of all rules. Files that hold any are looked at for parts of them, down to single
    rules, so a file costs a few passes and not one for every text.
    """
    needed = [r.texts() for _, r in rules]
    always = [p for p, own in enumerate(needed) if not own or not all(own)]
    some = [p for p in range(len(needed)) if p not in always]

    def find(texts: pa.Array, rows: np.ndarray, places: list[int], out: list[tuple[np.ndarray, int]]) -> None:
        pattern = "|".join(re.escape(n) for p in places for n in needed[p])
        hit = pc.match_substring_regex(texts, pattern)
        if not hit.true_count:
            return
        if hit.true_count < len(texts):
            texts, rows = texts.filter(hit), rows[hit.to_numpy(zero_copy_only=False)]
        if len(places) == 1:
            out.append((rows, places[0]))
            return
        step = -(-len(places) // PARTS)
        for i in range(0, len(places), step):
            find(texts, rows, places[i : i + step], out)

    @F.arrow_udf("array<int>")
    def held(texts: pa.Array) -> pa.Array:
        rows = np.flatnonzero(texts.is_valid().to_numpy(zero_copy_only=False))
        out = [(rows, p) for p in always]
        if some:
            find(texts.drop_null(), rows, some, out)
        at = np.concatenate([np.empty(0, np.int64), *(r for r, _ in out)])
        place = np.concatenate([np.empty(0, np.int32), *(np.full(len(r), p, np.int32) for r, p in out)])
        ends = np.cumsum(np.bincount(at, minlength=len(texts)), dtype=np.int32)
        return pa.ListArray.from_arrays(np.concatenate([np.zeros(1, np.int32), ends]), place[np.lexsort((place, at))])

    return held(text)


def _if_open(text: Column) -> Column:
    """The text of files with open rules, else null. A filter would not do: it is pushed below the expression that makes
    the text, which then is made again for every text that a rule needs, and in as few tasks as read the input."""
    return F.when(F.size("_open") > 0, text)


def _open_chunks() -> Column:
    return F.array_distinct(F.transform("_open", lambda p: F.floor(p / CHUNK).cast("int")))


def _tried(rules: Sequence[tuple[int, Rule]], text: Column, hit, kind: str) -> Column:
    """What ``hit(number, rule, text)`` gives for the open rules of the open chunks, nulls left out."""
    placed = list(enumerate(rules))

    def every(x: Column) -> Column:
        none = F.array().cast(f"array<{kind}>")
        return F.concat(
            *[
                F.when(
                    F.array_contains("_chunks", k // CHUNK),
                    F.array_compact(F.array(*[F.when(F.array_contains("_open", p), hit(i, r, x)) for p, (i, r) in placed[k : k + CHUNK]])),
                ).otherwise(none)
                for k in range(0, len(placed), CHUNK)
            ]
        )

    return F.get(F.transform(F.array(text), every), F.lit(0))


def scan_lines(files: DataFrame, rules: Sequence[tuple[int, Rule]]) -> DataFrame:
    """(file, line, rule_no) of numbered line rules over prepared files (file, text, _lang, _test, _imports)."""
    text = F.col("text")
    ready = files.withColumn("_open", _open_rules(rules, text))
    ready = ready.withColumns({"_chunks": _open_chunks(), "_silent": _silent(rules, text), "text": _if_open(text)})

    def hit(i: int, rule: Rule, line: Column) -> Column:
        found = fires(rule, line) & _open_rule(rule)
        if rule.absent_file:
            found = found & ~F.array_contains("_silent", i)
        return F.when(found, F.lit(i))

    return lines_of(ready).select("file", F.col("line_no").alias("line"), F.explode(_tried(rules, F.col("line_text"), hit, "int")).alias("rule_no"))


def scan_texts(files: DataFrame, rules: Sequence[tuple[int, Rule]]) -> DataFrame:
    """(file, line, rule_no) of numbered file rules over prepared files: every line where a match begins."""

    def begins(rule: Rule, text: Column) -> Column:
        marked = F.split(F.regexp_replace(F.translate(text, _MARK, ""), rule.pattern, f"{_MARK}$0"), "\n")
        at = F.transform(marked, lambda line, i: F.when(F.contains(line, F.lit(_MARK)), i + 1))
        return F.array_compact(at)

    def hit(i: int, rule: Rule, text: Column) -> Column:
        found = _open_rule(rule) & F.rlike(text, F.lit(rule.pattern))
        if rule.absent_file:
            found = found & ~F.rlike(text, F.lit(rule.absent_file))
        return F.when(found, F.struct(F.lit(i).alias("rule_no"), begins(rule, text).alias("lines")))

    ready = files.withColumn("_open", _open_rules(rules, F.col("text"))).withColumn("_chunks", _open_chunks())
    found = ready.select("file", F.explode(_tried(rules, F.col("text"), hit, "struct<rule_no:int,lines:array<int>>")).alias("h"))
    return found.select("file", F.explode("h.lines").alias("line"), F.col("h.rule_no").alias("rule_no"))


def scan_files(files: DataFrame, rules: Sequence[Rule], file: str = "file", text: str = "text") -> DataFrame:
    """Findings (see schemas.FINDING) of whole files, with line numbers and ``rule_no``; null texts have none."""
    path = F.col(file).cast("string")
    own = F.when(F.contains(F.col(text), F.lit("import")) | F.contains(F.col(text), F.lit("require")), categories(F.col(text)))
    ready = files.select(path.alias("file"), F.col(text).alias("text"), language_of(path).alias("_lang"), is_test_path(path).alias("_test"))
    imported = any(r.id in ids for r in rules for ids in IMPORTS_OFF.values())
    ready = ready.withColumn("_imports", F.coalesce(own, F.array().cast("array<string>")) if imported else F.array().cast("array<string>"))
    numbered = list(enumerate(rules))
    parts = [(scan_lines, [x for x in numbered if not x[1].file]), (scan_texts, [x for x in numbered if x[1].file])]
    found = [scan(ready, own_rules) for scan, own_rules in parts if own_rules]
    found = found[0] if len(found) == 1 else found[0].unionByName(found[1])

    def told(name: str) -> Column:
        return F.get(F.array(*[F.lit(getattr(r, name)) for r in rules]), F.col("rule_no"))

    return found.select(
        told("id").alias("id"),
        F.lit("pattern").alias("engine"),
        told("severity").alias("severity"),
        told("type").alias("type"),
        "file",
        "line",
        told("description").alias("description"),
        told("fix").alias("fix_suggestion"),
        told("auto_fixable").alias("auto_fixable"),
        F.when(F.rlike("file", F.lit(r"\.env\.(example|sample|template)$")), "env-example").alias("context"),
        "rule_no",
    )
