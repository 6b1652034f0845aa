"""Text functions of the scanners and of error grouping, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: what is scrubbed, in this order, and by what
SCRUB = (
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[email]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[ssn]"),
    (r"\b\d[\d -]{12,22}\d\b", "[card]"),
    (r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "[phone]"),
    (r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", "[ip]"),
    (r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", "[token]"),
)
# fixed values: zero-width marks and bidirectional controls
INVISIBLE = "​‌‍﻿‎‏‪‫‬‭‮⁦⁧⁨⁩"
# fixed values: language by file extension
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python",
}
_BOUND = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


# what a mark's pattern begins with, and text that it holds: tried first, as both cost little
_FIRST = {"[ssn]": r"(?=\d)", "[card]": r"(?=\d)", "[phone]": r"(?=[\d+(])", "[ip]": r"(?=\d)", "[token]": "(?=e)"}
_HOLDS = {"[email]": "@", "[ssn]": "-", "[ip]": ".", "[token]": "eyJ"}


def _quick(pattern: str, mark: str) -> str:
    """The same matches, found faster: word boundaries are looked at where the pattern can begin, and an address only
    where its first part begins (or the match before it ended)."""
    if mark == "[email]":
        local = r"[a-zA-Z0-9._%+-]"
        return rf"(?:(?<!{local})|\G){local}++" + pattern.removeprefix(f"{local}+")
    return _FIRST[mark] + pattern.replace(r"\b", _BOUND)


def scrub(text: Column) -> Column:
    """Personal data replaced by marks. Word boundaries are ASCII ones whatever the JVM's notion of letters."""
    for pattern, mark in SCRUB:
        done = F.regexp_replace(text, _quick(pattern, mark), mark.replace("[", r"\[").replace("]", r"\]"))
        text = F.when(F.contains(text, F.lit(_HOLDS[mark])), done).otherwise(text) if mark in _HOLDS else done
    return text


def scrub_fields(value: Column, kind: T.DataType) -> Column:
    """The value with every string in it scrubbed, in structs, arrays and maps' values, too."""
    if isinstance(kind, T.StringType):
        return scrub(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: scrub_fields(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: scrub_fields(x, kind.valueType))
    if isinstance(kind, T.StructType):
        whole = F.struct(*[scrub_fields(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), whole)
    return value


def scrub_event(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Events with all strings of all columns scrubbed but those of ``keep``."""
    return events.select(*[F.col(f.name) if f.name in keep else scrub_fields(F.col(f.name), f.dataType).alias(f.name) for f in events.schema.fields])


def strip_invisible(text: Column) -> Column:
    return F.translate(text, INVISIBLE, "")


def trimmed(text: Column) -> Column:
    """Without white space at either end, tabs and line ends included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def shortened(text: Column, size: int = 200) -> Column:
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("..."))).otherwise(text)


def finding_hash(rule: Column, path: Column, description: Column) -> Column:
    """A fingerprint that survives moved lines: 16 hexadecimal digits of rule, path and description."""
    parts = [F.coalesce(c, F.lit("")) for c in (rule, path, description)]
    return F.left(F.sha2(F.concat_ws("::", *parts), 256), F.lit(16))


def relative_path(path: Column, root: Column) -> Column:
    inside = F.startswith(path, F.concat(root, F.lit("/")))
    return F.when(inside, F.substring(path, F.length(root) + 2, F.length(path))).otherwise(path)


def language_of(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F
    for k, v in LANGUAGES.items():
        out = out.when(extension == k, v)
    return out.otherwise(F.lit(None).cast("string"))


def is_test_path(path: Column) -> Column:
    """Tests, fixtures, documentation, translations, migrations and installed packages, where rules for production code
    do not apply."""
    return F.rlike(
        F.lower(path),
        F.lit(
            r"(^|/)(tests?|__tests__|__mocks__|specs?|fixtures?|docs?|docs_src|examples?|i18n|locales?|translations?|migrations|node_modules)/"
            r"|(^|/)test_[^/]*\.py$|\.(test|spec)\.[a-z]+$|\.mdx?$"
        ),
    )


def safe_path(path: Column) -> Column:
    """Not empty, not absolute, without NUL and without a step up."""
    return F.coalesce(
        (F.length(path) > 0)
        & ~F.contains(path, F.lit("\0"))
        & ~F.contains(path, F.lit(".."))
        & ~F.startswith(path, F.lit("/"))
        & ~F.startswith(path, F.lit("\\")),
        F.lit(False),
    )


def normal_path(path: Column) -> Column:
    """Segments folded: no empty or ``.`` ones, ``..`` takes back its parent, none leads above the root."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, p: F.when(p != "..", F.concat(done, F.array(p)))
        .when(F.size(done) > 0, F.slice(done, 1, F.size(done) - 1))
        .otherwise(done),
    )
    return F.array_join(folded, "/")


def frames(stack: Column) -> Column:
    """The trimmed lines of a stack trace that are frames."""
    lines = F.transform(F.split(F.coalesce(stack, F.lit("")), "\n"), trimmed)
    return F.filter(lines, lambda x: F.startswith(x, F.lit("at ")))


def first_frame(stack: Column) -> Column:
    return F.coalesce(F.get(frames(stack), F.lit(0)), F.lit("unknown"))


def error_key(name: Column, message: Column, stack: Column) -> Column:
    """What one group of errors has in common: name, message and first frame."""
    return F.concat_ws("::", F.coalesce(name, F.lit("")), F.coalesce(message, F.lit("")), first_frame(stack))


def _place(frame: Column) -> Column:
    inside = F.regexp_extract(frame, r"\((.+?):(\d+):\d+\)", 0)
    file = F.when(inside != "", F.regexp_extract(frame, r"\((.+?):(\d+):\d+\)", 1)).otherwise(
        F.regexp_extract(frame, r"at (.+?):(\d+):\d+", 1)
    )
    line = F.when(inside != "", F.regexp_extract(frame, r"\((.+?):(\d+):\d+\)", 2)).otherwise(
        F.regexp_extract(frame, r"at (.+?):(\d+):\d+", 2)
    )
    return F.struct(file.alias("file"), F.coalesce(line.try_cast("int"), F.lit(0)).alias("line"))


def file_and_line(stack: Column) -> Column:
    """struct(file, line) of the first frame that names a place, else (unknown, 0)."""
    places = F.filter(F.transform(frames(stack), _place), lambda p: p["file"] != "")
    none = F.struct(F.lit("unknown").alias("file"), F.lit(0).alias("line"))
    first = F.get(places, F.lit(0))
    return F.when(first.isNull(), none).otherwise(F.struct(first["file"].alias("file"), first["line"].alias("line")))


def origin(stack: Column) -> Column:
    """struct(fn, file) of the first frame outside of installed packages."""
    own = F.filter(frames(stack), lambda x: ~F.contains(x, F.lit("node_modules")))
    paren, bare = r"^at\s+(.+?)\s+\((.+?):\d+:\d+\)", r"^at\s+(.+?):\d+:\d+"
    named = F.transform(
        own,
        lambda x: F.when(
            F.rlike(x, F.lit(paren)),
            F.struct(F.regexp_extract(x, paren, 1).alias("fn"), F.regexp_extract(x, paren, 2).alias("file")),
        ).when(
            F.rlike(x, F.lit(bare)),
            F.struct(F.lit("<anonymous>").alias("fn"), F.regexp_extract(x, bare, 1).alias("file")),
        ),
    )
    first = F.get(F.filter(named, lambda p: p.isNotNull()), F.lit(0))
    return F.coalesce(first, F.struct(F.lit("unknown").alias("fn"), F.lit("unknown").alias("file")))


# fixed values: sentences by kind of error
CAUSES = {
    "TypeError": "This typically indicates an operation on an undefined or null value.",
    "ReferenceError": "A variable or function was used before being defined.",
    "SyntaxError": "The code contains invalid syntax.",
    "RangeError": "A value is outside the allowed range.",
    "SecurityError": "A security policy was violated.",
}


def root_cause(name: Column, message: Column, stack: Column) -> Column:
    at = origin(stack)
    fn, file = at["fn"], at["file"]
    where = (
        F.when((fn != "unknown") & (file != "unknown"), F.concat(F.lit("in "), fn, F.lit(" ("), file, F.lit(")")))
        .when(fn != "unknown", F.concat(F.lit("in "), fn))
        .when(file != "unknown", F.concat(F.lit("in "), file))
        .otherwise("at an unknown location")
    )
    out = F
    for kind, sentence in CAUSES.items():
        out = out.when(
            name == kind, F.concat(F.lit(f"A {kind} occurred "), where, F.lit(": "), message, F.lit(f". {sentence}"))
        )
    return out.otherwise(F.concat(name, F.lit(" occurred "), where, F.lit(": "), message, F.lit(".")))


# fixed values: advice by kind of error and message
ADVICE = (
    ("TypeError", r"undefined|null", "Add a null/undefined check before accessing the property or calling the method. Consider using optional chaining (?.) or nullish coalescing (??) operators."),
    ("TypeError", r"is not a function", "Verify the value is a function before calling it. Check that the import/require is correct and the module exports the expected function."),
    ("TypeError", "", "Check that all values are the expected type before performing operations on them. Add type guards or validation at function boundaries."),
    ("ReferenceError", r"is not defined", None),
    ("ReferenceError", "", "Verify all variables and functions are properly declared and imported before use."),
    ("SyntaxError", "", "Fix the syntax error in the source code. Run a linter to catch additional syntax issues."),
    ("RangeError", "", "Add bounds checking to prevent values from exceeding the allowed range. Validate inputs before passing them to functions."),
    ("SecurityError", "", "Review the security policy configuration (CORS, CSP, etc.). Ensure the operation is allowed by the current security context."),
)


def suggested_fix(name: Column, message: Column) -> Column:
    low, out = F.lower(message), F
    variable = F.regexp_extract(message, r"(\w+) is not defined", 1)
    variable = F.when(variable != "", variable).otherwise("the variable")
    undefined = F.concat(
        F.lit("Ensure "),
        variable,
        F.lit(" is defined and imported before use. Check for typos in the variable name and verify the import path is correct."),
    )
    for kind, pattern, text in ADVICE:
        fits = (name == kind) & F.rlike(low, F.lit(pattern)) if pattern else name == kind
        out = out.when(fits, undefined if text is None else F.lit(text))
    return out.otherwise(
        F.concat(
            F.lit("Investigate the "),
            name,
            F.lit(" error. Check the stack trace for the originating function and add appropriate error handling."),
        )
    )


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for empty and null."""
    chars = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    shares = F.transform(
        F.array_sort(F.array_distinct(chars)),
        lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double") / n,
    )
    return F.aggregate(shares, F.lit(0.0), lambda s, p: s - p * F.log2(p))
