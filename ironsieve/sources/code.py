"""Functions, classes, imports, exports and calls of source files (see schemas.PARSED_FILE).

Python is read with its own syntax tree; JavaScript and TypeScript by a scan for declarations and calls with brace
depth. Files that can't be read are left out. Calls outside of any function are dropped.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ironsieve import schemas

_MARK = re.compile(r"//[^\n]*|/\*(?:[^*]|\*(?!/))*+(?:\*/)?|'(?:[^'\\\n]|\\.)*+'?|\"(?:[^\"\\\n]|\\.)*+\"?|[`/{}]", re.S)
_TEXT = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*+", re.S)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[a-z]*+")
_BEFORE_REGEX = re.compile(r"(?:^|[=(,:\[!&|?{};+*%~^-]|=>|\b(?:return|typeof|case|throw|await|yield))\s*$")
_DECLARED = re.compile(
    r"(?P<export>export\s+(?:default\s+)?)?(?:(?P<async>async\s+)?function\s*\*?\s*(?P<fn>[A-Za-z_$][\w$]*)\s*(?:<[^>(]*>)?\s*\((?P<fp>[^)]*)\)"
    r"|(?:const|let|var)\s+(?P<arrow>[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?P<aasync>async\s*)?(?:\((?P<ap>[^)]*)\)|(?P<one>[A-Za-z_$][\w$]*))\s*(?::[^={]+)?=>"
    r"|(?:abstract\s+)?class\s+(?P<cls>[A-Za-z_$][\w$]*))"
)
_METHOD = re.compile(r"^[ \t]*(?:(?:public|private|protected|static|readonly|override)\s+)*(?P<async>async\s+)?(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^>(]*>)?\((?P<p>[^)]*)\)\s*(?::[^{;]+)?\{", re.M)
_CALL = re.compile(r"(?:(?P<on>[A-Za-z_$][\w$]*)\s*\??\.\s*)?(?P<name>[A-Za-z_$][\w$]*)\s*\(")
_IMPORT = re.compile(r"import\s+(?:type\s+)?(?P<what>[\w*{}\s,$]+?)\s+from\s+(?P<q>['\"])(?P<source>[^'\"]+)(?P=q)|(?:const|let|var)\s+(?P<req>[\w{}\s,:$]+?)\s*=\s*require\(\s*['\"](?P<module>[^'\"]+)['\"]\s*\)")
_KEYWORDS = set("if for while switch catch function return typeof await async new super constructor import require".split())


def _names(text: str | None) -> list[str]:
    return re.findall(r"[A-Za-z_$][\w$]*", re.sub(r"\b(?:as\s+\w+|type)\b", "", text or ""))


def _params(text: str | None) -> list[str]:
    found = (re.match(r"\s*(?:\.\.\.)?([A-Za-z_$][\w$]*)", p) for p in (text or "").split(","))
    return [m[1] for m in found if m]


def blanked(text: str) -> str:
    """The text with comments, strings, regular expressions and templates' own text made spaces, so that places stay; what
    is in ``${…}`` is code. One pass."""
    out, last, at = [], 0, 0
    depth: list[int] = []  # for each open ``${`` the braces that are open in it

    def blank(start: int, end: int) -> None:
        nonlocal last
        out.append(text[last:start])
        out.append(re.sub(r"[^\n]", " ", text[start:end]))
        last = end

    def template(start: int) -> int:
        """Blank a template's text from ``start`` to its end or to the next part of code."""
        end = _TEXT.match(text, start).end()
        if text.startswith("${", end):
            blank(start - 1, end + 2)
            depth.append(0)
            return end + 2
        blank(start - 1, min(end + 1, len(text)))
        return end + 1

    while m := _MARK.search(text, at):
        at, c = m.end(), m[0]
        if c == "`":
            at = template(at)
        elif c == "{":
            if depth:
                depth[-1] += 1
        elif c == "}":
            if depth and not depth[-1]:
                depth.pop()
                at = template(at)
            elif depth:
                depth[-1] -= 1
        elif c == "/":
            found = _REGEX.match(text, m.start())
            if found and _BEFORE_REGEX.search("".join(out[-2:])[-24:] + text[max(last, m.start() - 24) : m.start()]):
                at = found.end()
                blank(m.start(), at)
        else:
            blank(m.start(), at)
    return "".join(out) + text[last:]


def parse_script(text: str) -> dict:
    """JavaScript or TypeScript; comments and strings are blanked first, so positions stay."""
    code = blanked(text)
    breaks = [m.start() for m in re.finditer("\n", code)]
    line = lambda at: bisect_right(breaks, at - 1) + 1
    ends, open_ = {}, []
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            ends[open_.pop()] = m.end()

    def close(at: int) -> int:
        """Where the block that begins at or after ``at`` ends; without a block the statement's end."""
        begin = code.find("{", at)
        stop = re.compile(r";|\n\s*\n").search(code, at)
        if begin < 0 or (stop and stop.start() < begin):
            return stop.start() if stop else len(code)
        return ends.get(begin, len(code))

    listed = set(_names(" ".join(re.findall(r"export\s*\{([^}]*)\}", code))))
    functions, classes, exports, spans = [], [], [], []
    for m in _DECLARED.finditer(code):
        name, end = m["fn"] or m["arrow"] or m["cls"], close(m.end())
        exported = bool(m["export"]) or name in listed
        if exported:
            exports.append({"name": name, "line": line(m.start()), "type": "class" if m["cls"] else "function"})
        if m["cls"]:
            methods = []
            for x in _METHOD.finditer(code, code.find("{", m.end()) + 1, end):
                if x["name"] not in _KEYWORDS - {"constructor"}:
                    methods.append(x["name"])
                    stop = close(x.end() - 1)
                    spans.append((x.start(), stop, x["name"]))
                    functions.append((0, x.start(), {"name": x["name"], "start_line": line(x.start("name")), "end_line": line(stop), "params": _params(x["p"]), "is_async": bool(x["async"]), "is_exported": exported, "class_name": name}))
            classes.append({"name": name, "start_line": line(m.start()), "end_line": line(end), "methods": methods, "is_exported": exported})
        else:
            spans.append((m.start(), end, name))
            params = _params(m["fp"] or m["ap"] or m["one"])
            functions.append((1 if m["fn"] else 2, m.start(), {"name": name, "start_line": line(m.start()), "end_line": line(end), "params": params, "is_async": bool(m["async"] or m["aasync"]), "is_exported": exported, "class_name": None}))
    calls, active = [], []
    declared = {f[1] for f in functions}
    waiting = sorted(spans, reverse=True)
    for m in _CALL.finditer(code):
        while waiting and waiting[-1][0] < m.start():
            active.append(waiting.pop())
        active = [s for s in active if s[1] > m.start()]  # as many as functions are nested
        if m["name"] in _KEYWORDS or re.search(r"function\s*\*?\s*$", code[max(0, m.start() - 12) : m.start("name")]):
            continue
        inside = [s for s in active if not (m.start("name") < s[0] + 200 and s[2] == m["name"] and code[s[0] : m.start("name")].strip() in ("", "async", "static", "public", "private"))]
        if inside and m.start() not in declared:
            calls.append({"caller_name": max(inside)[2], "callee_name": m["name"], "line": line(m.start()), "receiver": m["on"]})
    imports = [{"source": m["source"] or m["module"], "specifiers": _names(m["what"] or m["req"]), "line": text.count("\n", 0, m.start()) + 1} for m in _IMPORT.finditer(text)]
    return {"functions": [f for _, _, f in sorted(functions, key=lambda f: f[:2])], "classes": classes, "imports": imports, "exports": exports, "call_sites": calls}


def parse_python(text: str) -> dict:
    tree = ast.parse(text)
    functions, classes, imports, calls = [], [], [], []

    def walk(node: ast.AST, owner: str | None, inside: str | None) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.ClassDef):
                methods = [y.name for y in x.body if isinstance(y, (ast.FunctionDef, ast.AsyncFunctionDef))]
                classes.append({"name": x.name, "start_line": x.lineno, "end_line": x.end_lineno, "methods": methods, "is_exported": False})
                walk(x, x.name, inside)
            elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                functions.append({"name": x.name, "start_line": x.lineno, "end_line": x.end_lineno, "params": [a.arg for a in x.args.args], "is_async": isinstance(x, ast.AsyncFunctionDef), "is_exported": False, "class_name": owner})
                walk(x, None, x.name)
            else:
                if isinstance(x, ast.Import):
                    imports.extend({"source": a.name, "specifiers": [a.asname or a.name], "line": x.lineno} for a in x.names)
                elif isinstance(x, ast.ImportFrom):
                    imports.append({"source": "." * x.level + (x.module or ""), "specifiers": [a.name for a in x.names], "line": x.lineno})
                elif isinstance(x, ast.Call) and inside:
                    f = x.func
                    if isinstance(f, ast.Name):
                        calls.append({"caller_name": inside, "callee_name": f.id, "line": x.lineno, "receiver": None})
                    elif isinstance(f, ast.Attribute):
                        on = f.value.id if isinstance(f.value, ast.Name) else f.value.attr if isinstance(f.value, ast.Attribute) else None
                        calls.append({"caller_name": inside, "callee_name": f.attr, "line": x.lineno, "receiver": on})
                walk(x, owner if isinstance(node, ast.ClassDef) else None, inside)

    walk(tree, None, None)
    return {"functions": functions, "classes": classes, "imports": imports, "exports": [], "call_sites": calls}


def parsed_files(files: DataFrame) -> DataFrame:
    """schemas.PARSED_FILE of (file, language, text), and their project if they have that column. ``file_seq`` only tells
    files apart; order is that of paths."""
    projects = "project" in files.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            owners = b["project"] if projects else [""] * len(b)
            for project, path, language, text in zip(owners, b["file"], b["language"], b["text"], strict=True):
                try:
                    parts = parse_python(text) if language == "python" else parse_script(text)
                except (SyntaxError, ValueError, RecursionError, TypeError):
                    continue
                out.append({"project": project, "file_path": path, "language": language, **parts})
            yield pd.DataFrame(out, columns=["project", "file_path", "language", "functions", "classes", "imports", "exports", "call_sites"])

    kind = "project string, " + schemas.PARSED_FILE.removeprefix("file_seq long, ")
    parsed = files.where("language is not null and text is not null").select("file", "language", "text", *["project"] * projects).mapInPandas(run, kind)
    return parsed.select(F.pmod(F.xxhash64("file_path"), F.lit(1 << 40)).alias("file_seq"), *parsed.columns)
