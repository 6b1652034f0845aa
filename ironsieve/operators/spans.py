"""Bracket spans of source files: what call, template, comment or string a place in a file is in.

Text becomes tokens by one regular expression (comments, strings, regular expressions, templates, names, brackets), and
templates become their text parts and the tokens of their ``${…}`` parts, to NESTED levels. Offsets, lines and bracket
depth are prefix sums over a file's tokens; an opener's span ends with the next closer of its depth. So the work follows
the length of the text, and it is all Spark's own functions. Only one file's tokens meet in a task.

Brackets in JSX text after an apostrophe are hidden to the line's end, as a string would be; a regular expression is told
from a division by what stands before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

NESTED = 3
_DOUBLE, _SINGLE = r'"(?:[^"\\\n]++|\\[\s\S])*+"?', r"'(?:[^'\\\n]++|\\[\s\S])*+'?"


def _inner(depth: int) -> str:
    """Code inside of ``${…}`` with balanced braces."""
    deeper = rf"|\{{{_inner(depth - 1)}\}}" if depth else ""
    return rf"(?:[^{{}}\"'`]++|{_DOUBLE}|{_SINGLE}|{_template(depth - 1) if depth else _FLAT}{deeper})*+"


_FLAT = r"`(?:[^`\\]++|\\[\s\S])*+`"


def _template(depth: int) -> str:
    return rf"`(?:[^`\\$]++|\\[\s\S]|\$(?!\{{)|\$\{{{_inner(depth)}\}})*+`"


_PART = rf"\$\{{{_inner(NESTED)}\}}|(?:[^\\$]++|\\[\s\S]|\$(?!\{{))++"
_NAME = r"[\p{L}_$#@][\p{L}\p{N}_$]*+"
_BEFORE_REGEX = r"(?<=^|[=(,:\[!&|?{;+*%~^-]\s{0,20}|=>\s{0,20}|\b(?:return|typeof|case|throw|await|yield)\s{1,20})"
_REGEX = rf"{_BEFORE_REGEX}/(?![*/])(?:[^/\\\[\n]++|\\[^\n]|\[(?:[^\]\\\n]++|\\[^\n])*+\])++/[a-z]*+"
_REST = rf"{_NAME}|\d[\w.]*+|[()\[\]{{}}]|=>|\?\.|\s++|[\s\S]"
SCRIPT = rf"//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/)?|{_DOUBLE}|{_SINGLE}|{_template(NESTED)}|{_FLAT}|{_REGEX}|{_REST}"
_PREFIX = r"(?:\b[rRbBfFuU]{1,2})?"
PYTHON = rf'#[^\n]*+|{_PREFIX}"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"{{0,3}}|{_PREFIX}\'\'\'(?:[^\'\\]++|\\[\s\S]|\'(?!\'\'))*+\'{{0,3}}|{_PREFIX}{_DOUBLE}|{_PREFIX}{_SINGLE}|{_REST}'
# fixed values: words before a bracket that call nothing
KEYWORDS = ("if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "yield", "in", "of", "and", "or", "not", "elif", "case", "throw", "delete", "void", "with", "def", "class", "lambda", "import", "print")
_LOOK_BACK = 12
#: Code points of text for each task, about: their tokens, some hundred bytes each, are sorted in its memory.
TASK_CHARS = 2 << 20


def _unfold(parts: Column) -> Column:
    """Tokens (what, text) with the templates among them taken apart once: what is c (code), t (template), h, m, l (its parts)."""

    def token(what: str, text: Column) -> Column:
        return F.struct(F.lit(what).alias("what"), text.alias("text"))

    def coded(text: Column) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(SCRIPT), F.lit(0)), lambda t: F.struct(F.when(F.startswith(t, F.lit("`")) & (F.length(t) > 1), "t").otherwise("c").alias("what"), t.alias("text")))

    def pieces(t: Column) -> Column:
        found = F.regexp_extract_all(t["text"], F.lit(_PART), F.lit(0))
        last = F.size(found) - 1
        own = F.transform(
            found,
            lambda p, i: F.when(
                F.startswith(p, F.lit("${")),
                F.concat(F.array(token("c", F.lit("${"))), coded(F.substring(p, F.lit(3), F.length(p) - 3)), F.array(token("c", F.lit("}")))),
            ).otherwise(F.array(F.struct(F.when(i == 0, "h").when(i == last, "l").otherwise("m").alias("what"), p.alias("text")))),
        )
        return F.flatten(own)

    held = (lambda t: (t["what"] == "t") & F.contains(t["text"], F.lit("${")))
    return F.flatten(F.transform(parts, lambda t: F.when(held(t), pieces(t)).otherwise(F.array(t))))


def tokens(files: DataFrame, file: str = "file", text: str = "text", lang: str = "_lang") -> DataFrame:
    """(file, no, what, token) of all files; null texts have none. ``lang`` "python" has its own strings and comments."""
    script = F.transform(F.regexp_extract_all(F.col(text), F.lit(SCRIPT), F.lit(0)), lambda t: F.struct(F.when(F.startswith(t, F.lit("`")) & (F.length(t) > 1), "t").otherwise("c").alias("what"), t.alias("text")))
    for _ in range(NESTED):
        script = _unfold(script)
    python = F.transform(F.regexp_extract_all(F.col(text), F.lit(PYTHON), F.lit(0)), lambda t: F.struct(F.lit("c").alias("what"), t.alias("text")))
    every = F.when(F.col(lang) == "python", python).otherwise(script)
    return files.select(F.col(file).alias("file"), F.posexplode(every).alias("no", "t")).select("file", "no", F.col("t.what").alias("what"), F.col("t.text").alias("token"))


def _kind(lang_token: Column, what: Column) -> Column:
    t = lang_token
    return (
        F.when(what.isin("t", "h"), "template")
        .when(what.isin("m", "l"), "part")
        .when(t == "(", "call")
        .when(t == "[", "index")
        .when(t == "{", "block")
        .when(t == "${", "interpolation")
        .when(t.isin(")", "]", "}"), "close")
        .when(F.rlike(t, F.lit(r"^\s")), "space")
        .when(F.rlike(t, F.lit(r"^(?://|/\*|#(?![\p{L}_$])|#\s?[^\n]*\s)")) | (F.startswith(t, F.lit("#")) & (F.length(t) > 1) & ~F.rlike(t, F.lit(r"^#[\p{L}_$][\p{L}\p{N}_$]*$"))), "comment")
        .when(F.rlike(t, F.lit("^[rRbBfFuU]{0,2}['\"]")), "string")
        .when(F.rlike(t, F.lit("^/.")), "regex")
        .when(F.rlike(t, F.lit(r"^[\p{L}_$#@]")), "name")
        .otherwise("other")
    )


def _dealt(files: DataFrame) -> DataFrame:
    """Files (file, text, _lang) by file over as many tasks as their text asks for: the windows over tokens follow this
    dealing, and Spark would join small texts to few tasks, which then hold all of their tokens."""
    chars = files.agg(F.sum(F.length("text"))).first()[0] or 0
    spark = files.sparkSession
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(max(least, -(-chars // TASK_CHARS)), "file")


def code_spans(files: DataFrame, file: str = "file", text: str = "text", lang: str = "_lang") -> DataFrame:
    """(file, first, last, line, last_line, kind, callee, receiver, literal, depth, ends_line) of every span.

    ``first`` to ``last`` (exclusive) are code points from 0; kinds: call and group (round brackets with and without a
    callee), index, block, interpolation, template (``callee`` is its tag), comment, string, regex. ``callee`` is the
    last name before the bracket, ``receiver`` the dotted names before that; ``literal``: the first argument is one
    string or template; ``ends_line``: a comment that nothing follows in its last line. A span that nothing closes ends with
    the file.
    """
    raw = tokens(_dealt(files.select(F.col(file).alias("file"), F.col(text).alias("text"), F.col(lang).alias("_lang")))).withColumn("kind", _kind(F.col("token"), F.col("what")))
    in_file = W.partitionBy("file").orderBy("no")
    upto, before = in_file.rowsBetween(W.unboundedPreceding, 0), in_file.rowsBetween(W.unboundedPreceding, -1)
    opens = F.col("kind").isin("call", "index", "block", "interpolation") | (F.col("what") == "h")
    closes = (F.col("kind") == "close") | (F.col("what") == "l")
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    breaks = F.length("token") - F.length(F.translate("token", "\n", ""))
    placed = raw.withColumns({"_step": step, "_breaks": breaks, "_n": F.length("token")}).withColumns(
        {
            "first": F.coalesce(F.sum("_n").over(before), F.lit(0)),
            "line": F.coalesce(F.sum("_breaks").over(before), F.lit(0)) + 1,
            "depth": F.sum("_step").over(upto) + F.when(F.col("_step") < 0, 1).otherwise(0),
            "_end": F.sum("_n").over(W.partitionBy("file")),
            "_end_line": F.sum("_breaks").over(W.partitionBy("file")) + 1,
        }
    )
    placed = placed.withColumns({"last": F.col("first") + F.col("_n"), "last_line": F.col("line") + F.col("_breaks")})
    following = F.lead("token").over(in_file)
    ends_line = following.isNull() | F.rlike(following, F.lit(r"^\s*\n")) | (F.rlike(following, F.lit(r"^\s")) & F.lead("token", 2).over(in_file).isNull())
    comment = F.col("kind") == "comment"
    # what stands around the token, without white space and comments: each file's comments are a window of their own
    seen = placed.withColumns({"_ends_line": comment & ends_line, "_comment": comment}).where("kind <> 'space'")
    near = W.partitionBy("file", "_comment").orderBy("no")
    back = F.array_join(F.collect_list(F.when(F.col("what").isin("c"), F.col("token")).otherwise("`")).over(near.rowsBetween(-_LOOK_BACK, -1)), " ")
    plain = F.col("kind").isin("string", "template")
    next_kind, next_what = F.lead(plain).over(near), F.lead("what").over(near)
    after = F.lead("token", 2).over(near)
    literal = next_kind & ((next_what == "h") | after.isin(",", ")"))
    seen = seen.withColumns({"_back": F.when(comment, "").otherwise(back), "_literal": F.coalesce(literal, F.lit(False)) & ~comment})
    # an opener and the next closer of its depth; what opens and closes nothing is a span by itself
    whole = comment | ((F.col("what") == "t") | F.col("kind").isin("string", "regex")) & (F.col("_step") == 0)
    paired = seen.where(whole | (F.col("_step") != 0)).withColumn("_pairs", (F.col("_step") != 0) & ~comment)
    level = W.partitionBy("file", "_pairs", "depth").orderBy("no")
    closed = lambda c: F.lead(F.when(F.col("_step") < 0, F.col(c))).over(level)
    paired = paired.withColumns({"_last": closed("last"), "_last_line": closed("last_line")}).where("not _pairs or _step > 0")
    every = paired.withColumns(
        {
            "last": F.when(F.col("_pairs"), F.coalesce("_last", "_end")).otherwise(F.col("last")),
            "last_line": F.when(F.col("_pairs"), F.coalesce("_last_line", "_end_line")).otherwise(F.col("last_line")),
        }
    )
    chain = rf"((?:[\p{{L}}\p{{N}}_$#]+ \??\. )*)({_NAME})$"
    callee, receiver = F.regexp_extract("_back", chain, 2), F.translate(F.regexp_extract("_back", chain, 1), " ", "")
    named = F.col("kind").isin("call", "template") & (callee != "") & ~callee.isin(*KEYWORDS)
    return every.select(
        "file",
        F.col("first").cast("long"),
        F.col("last").cast("long"),
        F.col("line").cast("int"),
        F.col("last_line").cast("int"),
        F.when((F.col("kind") == "call") & ~named, "group").otherwise(F.col("kind")).alias("kind"),
        F.when(named, callee).alias("callee"),
        F.when(named & (receiver != ""), F.regexp_replace(receiver, r"\??\.$", "")).alias("receiver"),
        ((F.col("kind") == "call") & F.col("_literal")).alias("literal"),
        F.col("depth").cast("int"),
        F.col("_ends_line").alias("ends_line"),
    )


# what of a place's spans silences findings of a rule's type or of a rule
SANITISERS = r"(?i)^(?:\w*sanitiz\w*|\w*purify|escapeHtml|encodeURIComponent|stringify)$"
TAGS = ("sql", "gql", "$queryRaw", "$executeRaw", "graphql")
#: Receivers whose method of the same name is the dangerous one itself.
OWN_EVAL = ("window", "globalThis", "global", "self", "this")
SHELLS = r"(?i)^(?:child_?process|cp|shell|shelljs|childProcess)$"


def context_flags(spans: DataFrame, places: DataFrame) -> DataFrame:
    """``places`` (file, line, and what else) with what covers each: is_comment, wrapped, tagged, eval_of, exec_of.

    is_comment: the line lies in a comment that begins before it and no code follows it there; wrapped: a call to a sanitiser
    covers the line; tagged: a tagged SQL template covers it; eval_of, exec_of: the receivers of ``eval`` and ``exec``
    calls that cover it, the empty string for none. Files are the join key; a file's spans meet only its own places.
    """
    keys = places.select("file", "line").distinct()
    s = spans.withColumnRenamed("line", "from_line").join(keys, "file").where("from_line <= line and last_line >= line")
    is_call = F.col("kind") == "call"
    told = s.groupBy("file", "line").agg(
        F.bool_or((F.col("kind") == "comment") & (F.col("from_line") < F.col("line")) & ((F.col("line") < F.col("last_line")) | F.col("ends_line"))).alias("is_comment"),
        F.bool_or(is_call & F.rlike("callee", F.lit(SANITISERS))).alias("wrapped"),
        F.bool_or((F.col("kind") == "template") & F.col("callee").isin(*TAGS)).alias("tagged"),
        F.array_sort(F.collect_set(F.when(is_call & (F.col("callee") == "eval"), F.coalesce("receiver", F.lit(""))))).alias("eval_of"),
        F.array_sort(F.collect_set(F.when(is_call & (F.col("callee") == "exec"), F.coalesce("receiver", F.lit(""))))).alias("exec_of"),
    )
    no, none = F.lit(False), F.array().cast("array<string>")
    joined = places.join(told, ["file", "line"], "left")
    flags = {c: F.coalesce(c, no) for c in ("is_comment", "wrapped", "tagged")} | {c: F.coalesce(c, none) for c in ("eval_of", "exec_of")}
    return joined.withColumns(flags)


def in_context(findings: DataFrame, files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """Findings (id, type, file, line, …) without those that their place in the code silences.

    Commented code (except secrets), markup wrapped by a sanitiser, SQL in a tagged template, ``eval`` of another object
    than the global one, and ``exec`` of what is no shell. Only files that have findings of such types are taken apart; a
    finding without a line, or in a file that isn't there, stays.
    """
    from ironsieve.functions.text import language_of

    open_ = findings.where((F.col("type") != "hardcoded_secret") & F.col("line").isNotNull())
    path = F.col(file).cast("string")
    own = files.select(path.alias("file"), F.col(text).alias("text"), language_of(path).alias("_lang"))
    own = own.join(open_.select("file").distinct(), "file", "left_semi")
    flagged = context_flags(code_spans(own), findings)
    eval_ = F.col("id") == "XSS_EVAL"
    other_eval = (F.size("eval_of") > 0) & F.forall("eval_of", lambda r: (r != "") & ~r.isin(*OWN_EVAL))
    exec_ = F.startswith("id", F.lit("CMD_INJECTION_EXEC"))
    other_exec = (F.size("exec_of") > 0) & F.forall("exec_of", lambda r: (r != "") & ~F.rlike(r, F.lit(SHELLS)))
    secret = F.col("type") == "hardcoded_secret"
    silent = (
        F.col("is_comment")
        | ((F.col("type") == "xss") & F.col("wrapped") & ~eval_)
        | ((F.col("type") == "sql_injection") & F.col("tagged"))
        | (eval_ & other_eval)
        | (exec_ & other_exec)
    )
    return flagged.where(secret | ~silent).select(*findings.columns)
