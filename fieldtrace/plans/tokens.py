"""Java sources as a table of tokens with their scope.

One pass of regular expressions over each text, then one pass over the kinds of a file's tokens, which
tells the scope of each. A file is one row up to there, with its tokens in order in an array, so nothing is
sorted, and no more is held than one row's text gave. Tokens are shuffled once, texts never.
"""

from __future__ import annotations

import itertools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Possessive quantifiers: the matcher then loops instead of recursing, so long literals and long
# argument lists cannot overflow the stack.
STRING = r'"(?:[^"\\\n]++|\\.)*+"'
CHARACTER = r"'(?:[^'\\\n]|\\[^\n])[0-9a-fA-F]*+'"
TEXT_BLOCK = r'"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""'
LITERAL = f"{TEXT_BLOCK}|{STRING}|{CHARACTER}"
# The look-ahead rules out most positions by one character.
COMMENT_OR_LITERAL = (
    rf"(?=[\"'/])(?:({LITERAL})|//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+\*/)"
)

# Regular expressions cannot count. So each bracket of a text gets its level as a mark, and an opening
# bracket ends at the next closing one with the same mark, however deep what stands between them goes.
MARKS = r"\x01[0-9]++[\x02-\x05]"
OPEN = r"\(\x01[0-9]++\x02"
CLOSE = r"\x01[0-9]++\x03\)"
BRACKET_SIGNS = {"(": "\x02", ")": "\x03", "<": "\x04", ">": "\x05"}
# A piece of text up to its next bracket; brackets in literals and the arrow of a lambda are none.
PIECE = rf"(?:[^()<>\"'\-]++|{LITERAL}|->|[\"'\-])*+(?:[()<>]|$)"

_names = (f"b{i}" for i in itertools.count())


def _matched(opening: str, closing: str, inside: str) -> str:
    """From a marked bracket to the one that closes it; `inside` is what may stand there, marks left out."""
    name = next(_names)
    signs = f"\\x0{ord(BRACKET_SIGNS[opening])}", f"\\x0{ord(BRACKET_SIGNS[closing])}"
    end = rf"\x01\k<{name}>{signs[1]}"
    first, last = (f"\\{b}" if b in "()" else b for b in (opening, closing))
    return rf"{first}\x01(?<{name}>[0-9]++){signs[0]}(?:{inside}|(?!{end})\x01)*+{end}{last}"


def generic() -> str:
    """Type arguments, if any. Each use is a pattern of its own, as names of groups must differ."""
    return f"(?:{_matched('<', '>', r'[^\x01(){};]++')})?+"


def arguments() -> str:
    """Arguments without a semicolon outside of literals."""
    return _matched("(", ")", rf"[^\x01\"';]++|{LITERAL}")


MAPPER = rf"@Mapper\b(?:\s*+{arguments()})?+"
MAPPING = rf"@Mapping\s*+{arguments()}"
HEADER = r"@?\b(?:class|interface)\s++\w++[^{};\"@()]*+\{"
GETTER_CALL = rf"\.get\w++\s*+{OPEN}\s*+{CLOSE}(?:\s*+\.get\s*+{OPEN}[^()]*+\))?+"
# What may follow the first word of a statement or a signature.
SIGNATURE = rf"{generic()}(?:\s*+\[\])*+\s++\w++\s*+{arguments()}\s*+(?:throws\s[^;{{}}()]*+)?+[;{{]"
# Arguments of a call may hold whole blocks, as of a lambda or an anonymous class.
SETTER = rf"\.set\w++\s*+{_matched('(', ')', r'[^\x01]++')}"
ADD = rf"\.add\s*+{OPEN}\s*+\w++\s*+{CLOSE}"
INSTANCE = rf"{GETTER_CALL}\s++instanceof\s++\w++{generic()}\s++\w++"
FIELD = rf"\.\w++\s*+=\s*+\w++\.\w++(?:\s*+{OPEN}\s*+{CLOSE})?+"
LOCAL = rf"\s*+=\s*+\w++{GETTER_CALL}"

STATEMENT = rf"\b\w++(?:{SETTER}|{ADD}|{INSTANCE}|{FIELD}|{LOCAL}|{SIGNATURE})"
TOKEN = "|".join([MAPPER, MAPPING, HEADER, STATEMENT, LITERAL, "[{}]"])
UNICODE = "(?U)"

# What follows the first word of a statement, as far as it tells the kind.
SHAPE = r"^\w++(\.set\w++\s*+\(|\.add\s*+\(|\.get\w++\s*+\(|\.\w++\s*+=|\s*+=)"

# Words that may stand where a return type or a method name stands, in statements and not in
# signatures.
STATEMENT_WORDS = [
    "return", "new", "else", "throw", "assert", "yield", "case", "do", "if", "while", "for",
    "switch", "catch", "try", "instanceof",
]
# Words before the name of a constructor or a record.
MODIFIERS = [
    "public", "private", "protected", "static", "final", "abstract", "default", "synchronized",
    "native", "strictfp", "record",
]

# Every token holds one of these; a token is a row of about so many bytes in each sort.
SIGNS = "{}(=@\"'"
ROW_BYTES = 256
# What a task of the windows gets, and what is worth a task of its own, in bytes of texts and rows.
TASK_BYTES = 128 << 20
LEAST_TASK_BYTES = 4 << 20

HEADERS = ["class", "interface"]
METHODS = ["declared", "body"]
SCOPES = [*HEADERS, "body"]
BRACES = ["open", "close"]


def _part(c, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, UNICODE + pattern, group), F.lit(""))


def strip_comments(c) -> Column:
    """Comments removed; comment signs inside literals are left alone."""
    return F.regexp_replace(c, COMMENT_OR_LITERAL, "$1")


def marked(c) -> Column:
    """The text with the level of each bracket: `f(g(x))` has marks 1, 2, 2, 1.

    Parentheses count from the start of the text. Type arguments hold no parentheses, braces or semicolons,
    so levels of `<` start anew after those, and a comparison has no effect on what follows it. A closing
    bracket without an opening one has no mark. The signs of marks (U+0001 to U+0005) are dropped from the
    text first. Long texts cost in proportion.
    """
    return F.get(_marked_all.asNondeterministic()(F.array(c)), F.lit(0))


SIGNS_OF_MARKS = re.compile("[\x01-\x05]")
# As in the expressions of the engine, a dot is none of the ends of lines.
PIECES = re.compile(PIECE.replace(r"\\.", r"\\[^\n\r\x85\u2028\u2029]"))
ANEW = re.compile("[{};]")


def with_marks(text: str | None) -> str | None:
    """`marked` of one text."""
    if text is None:
        return None
    out, p, a = [], 0, 0
    for piece in PIECES.findall(SIGNS_OF_MARKS.sub("", text)):
        end = piece[-1:]
        if end == "(":
            p, a = p + 1, 0
            out.append(f"{piece}\x01{p}\x02")
        elif end == ")":
            out.append(f"{piece[:-1]}\x01{p}\x03)" if p else piece)
            p, a = max(p - 1, 0), 0
        elif end == "<" or end == ">":
            a = 0 if ANEW.search(piece) else a
            if end == "<":
                a += 1
                out.append(f"{piece}\x01{a}\x04")
            else:
                out.append(f"{piece[:-1]}\x01{a}\x05>" if a else piece)
                a = max(a - 1, 0)
        else:
            out.append(piece)
    return "".join(out)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _marked_all(texts: pa.Array) -> pa.Array:
    return pa.array([v and [with_marks(t) for t in v] for v in texts.to_pylist()], pa.list_(pa.string()))


def _with(value: Column, use) -> Column:
    """`use(value)`, with the value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def unmarked(c) -> Column:
    return F.regexp_replace(c, MARKS, "")


SCOPE = T.ArrayType(
    T.StructType([
        T.StructField("at", T.IntegerType()),
        T.StructField("type_at", T.IntegerType()),
        T.StructField("method_at", T.IntegerType()),
        T.StructField("in_mapper", T.BooleanType()),
        T.StructField("annotated", T.BooleanType()),
        T.StructField("end_at", T.IntegerType()),
    ])
)
AIMED = "aimed"  # a mapping annotation with a target


def scopes(kinds: list[str]) -> list[tuple]:
    """Of every token but braces: its place, and those of its type, its method and its block's end (null for none);
    whether the type is a mapper, and whether a mapping annotation with a target is directly before it.

    A closing brace ends what the last opening one on its level began, so levels of all braces come first, and
    then those of the scopes among them. An opening token counts as inside its own block.
    """
    level, levels, scope, depths, opened = 0, [], 0, [], {}
    for kind in kinds:
        is_scope = kind in SCOPES
        if is_scope or kind == "open":
            level += 1
            opened[level] = is_scope
            scope += is_scope
            levels.append(level)
        elif kind == "close":
            levels.append(level)
            scope -= opened.get(level, False)
            level -= 1
        else:
            levels.append(level)
        depths.append(scope)

    ends, follows, closed, ahead = [None] * len(kinds), [None] * len(kinds), {}, None
    for at in range(len(kinds) - 1, -1, -1):
        kind = kinds[at]
        if kind == "close":
            closed[levels[at]] = at
        elif kind in METHODS or kind in HEADERS:
            ahead = at
        ends[at], follows[at] = closed.get(levels[at]), ahead

    found, headers, openers, mappers, types = [], {}, {}, set(), {}
    marked = before = None
    for at, kind in enumerate(kinds):
        if kind in BRACES:
            continue
        # A body stands on the level it opens; its type is on the level below.
        depth = depths[at]
        below = depth - 1 if kind == "body" else depth
        if kind in HEADERS:
            headers[below] = at
            if marked == "mapper":
                mappers.add(at)
        types[at] = headers.get(below)
        if kind in SCOPES:
            openers[depth] = at
        found.append((at, before == AIMED))
        if kind == "mapper" or kind in HEADERS:
            marked = kind
        if kind == AIMED or kind in METHODS or kind in HEADERS:
            before = kind
        # Other statements take the opener as it is now; an annotation the method after it.
        if kind not in ("mapping", AIMED, "declared"):
            follows[at] = openers.get(depth)
        elif kind == "declared":
            follows[at] = at

    rows = []
    for at, annotated in found:
        kind, near = kinds[at], follows[at]
        method = near if near is not None and kinds[near] in METHODS else None
        if method is not None and kind in ("mapping", AIMED) and types[method] != types[at]:
            method = None
        is_own = kind in METHODS or kind in HEADERS or method is None
        of = types[at] if is_own else types[method]
        rows.append((at, of, method, of in mappers, annotated, ends[at]))
    return rows


@F.arrow_udf(SCOPE)
def _scopes(kinds: pa.Array) -> pa.Array:
    """`scopes` of the tokens of each file."""
    sizes, columns = [0], [[] for _ in SCOPE.elementType.fields]
    for file in kinds:
        for row in scopes(file.as_py() or []):
            for column, value in zip(columns, row):
                column.append(value)
        sizes.append(len(columns[0]))
    types = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int32()]
    values = pa.StructArray.from_arrays(
        [pa.array(column, kind) for column, kind in zip(columns, types)], names=SCOPE.elementType.names
    )
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values)


def _parameter_text(t: Column) -> Column:
    params = F.regexp_extract(t["token"], r"(?s)\((.*)\)\s*+(?:throws\s[^;{}()]*+)?+[;{]$", 1)
    return F.when(t["kind"].isin(METHODS), F.trim(params))


def _kind_or_aimed(t: Column) -> Column:
    aims = (t["kind"] == "mapping") & annotation_attribute("target", t["token"]).isNotNull()
    return F.when(aims, AIMED).otherwise(t["kind"])


def packed(sources: DataFrame, path_col: str = "file_path", text_col: str = "content") -> DataFrame:
    """`(file_path, tokens, params, scopes)`: of each text the tokens in order, as an array of `(pos, kind, token)`;
    the parameters of those that are methods, marked; and what `scopes` tells of them.

    `file_path` must be unique in `sources`. Kinds: mapper, mapping, class, interface, declared (method without
    body), body (method with one), setter, add, field, local, instance; open and close are braces of all
    other blocks.
    """
    # Unicode classes are slow, and make no difference to plain ASCII.
    def found(code: Column) -> Column:
        plain = F.octet_length(code) == F.char_length(code)
        return F.when(plain, F.regexp_extract_all(code, F.lit(TOKEN), F.lit(0))).otherwise(
            F.regexp_extract_all(code, F.lit(UNICODE + TOKEN), F.lit(0))
        )

    def kind(token: Column) -> Column:
        """The kind; null for what is none."""
        words = "|".join(STATEMENT_WORDS)
        literal = token.startswith('"') | token.startswith("'")
        not_mapping = token.startswith("@") & ~token.startswith("@Mapp")
        by_word = token.rlike(rf"^(?:{words})\b|^[^(]*?\b(?:{words})\s*+\(")
        opens = token.endswith("{")
        header = opens & ~token.contains("(")
        shape = F.regexp_extract(token, UNICODE + SHAPE, 1)
        statement = _with(
            shape,
            lambda call: F.when(call.endswith("="), F.when(call.startswith("."), "field").otherwise("local"))
            .when(call.startswith(".set"), "setter")
            .when(call.startswith(".add"), "add")
            .when(call.startswith(".get"), "instance")
            .when(opens, "body")
            .otherwise("declared"),
        )
        return (
            F.when(token == "}", "close")
            .when(token == "{", "open")
            .when(literal, None)
            .when(not_mapping | by_word, F.when(opens, "open"))
            .when(token.startswith("@Mapper"), "mapper")
            .when(token.startswith("@"), "mapping")
            .when(header & token.startswith("interface"), "interface")
            .when(header, "class")
            .otherwise(statement)
        )

    def named(token: Column, pos: Column) -> Column:
        return F.struct(pos.alias("pos"), kind(token).alias("kind"), token.alias("token"))

    def bare(token: Column) -> Column:
        return F.when(token.contains("\x01"), unmarked(token)).otherwise(token)

    texts = F.transform(_with(F.col("__marked"), found), bare)
    found_in = sources.select(
        F.col(path_col).alias("file_path"), marked(strip_comments(F.col(text_col))).alias("__marked")
    ).select("file_path", F.filter(F.transform(texts, named), lambda t: t["kind"].isNotNull()).alias("tokens"))
    # Of tokens only kinds go to Python, and places in the array come back. It is done ahead of the shuffle, as
    # the windows behind it would not know what a Python function leaves of a partitioning. Functions that count as
    # not deterministic are neither moved nor worked out twice.
    return found_in.select(
        "*",
        _marked_all.asNondeterministic()(F.transform("tokens", _parameter_text)).alias("params"),
        _scopes.asNondeterministic()(F.transform("tokens", _kind_or_aimed)).alias("scopes"),
    )


def tokens(sources: DataFrame, path_col: str = "file_path", text_col: str = "content") -> DataFrame:
    """`(file_path, pos, kind, token)`: `packed`, one row for each token."""
    return packed(sources, path_col, text_col).select("file_path", F.inline("tokens"))


def dealt(sources: DataFrame, path_col: str = "file_path", text_col: str = "content") -> DataFrame:
    """`packed`, dealt by file to as many tasks as they need: what a task works on does not grow with the table.

    Rows of tokens take several times the bytes of the texts' part of the shuffle, so the number of tasks follows
    the texts and their signs, which one pass ahead of it counts, and not the session's number of partitions.
    """
    text = F.col(text_col)
    size = F.octet_length(text).cast("long")
    signs = [size - F.octet_length(F.replace(text, F.lit(sign))) for sign in SIGNS]
    total = sources.agg(F.sum(size + sum(signs[1:], signs[0]) * ROW_BYTES)).first()[0] or 0
    least = min(sources.sparkSession.sparkContext.defaultParallelism, -(-total // LEAST_TASK_BYTES))
    n_tasks = max(1, least, -(-total // TASK_BYTES))
    return packed(sources, path_col, text_col).repartition(n_tasks, "file_path")


def declarations(toks: DataFrame) -> DataFrame:
    """Classes and interfaces of each file in order."""
    return toks.where(F.col("kind").isin(HEADERS)).select(
        "file_path", "kind", _part("token", r"^\w++\s++(\w++)").alias("name"), "pos"
    )


def signature_parts(token, params) -> list[Column]:
    """Return type, name, parameter text and parameters of a method token, from its marked parameters."""
    return [
        _part(token, r"^([^(]*?)\s++\w++\s*+\(").alias("return_type"),
        _part(token, r"(\w++)\s*+\(").alias("method"),
        unmarked(params).alias("params"),
        parameters(params).alias("args"),
    ]


def parameters(params) -> Column:
    """The parameters as `array<struct<type, name>>`, without annotations and `final`, of a marked text.

    Commas inside `<...>` do not part parameters.
    """
    annotation = rf"@\w++(?:\.\w++)*+(?:\s*+{arguments()})?+\s*+|\bfinal\s++"
    one = rf"(\w++(?:\.\w++)*+{generic()}(?:\s*+\[\]|\s*+\.\.\.)*+)\s*+\b(\w++)"
    return F.transform(
        F.regexp_extract_all(
            F.regexp_replace(params, UNICODE + annotation, ""), F.lit(UNICODE + one), F.lit(0)
        ),
        lambda p: F.struct(
            unmarked(F.regexp_extract(p, UNICODE + one, 1)).alias("type"),
            F.regexp_extract(p, UNICODE + one, 3).alias("name"),  # group 2 is the mark
        ),
    )


def first_parameter_type(args="args") -> Column:
    return F.get(args, F.lit(0))["type"]


def scoped(files: DataFrame) -> DataFrame:
    """Tokens of packed files with the declaration and the method they stand in or, for an annotation, before.

    Adds `decl`, `decl_pos`, `in_mapper`; of the method `method_pos`, `method_kind`, `return_type`,
    `method`, `params`, `args`; and for a method `annotated`: a mapping annotation with a target is
    directly before it. `block_end` is where the block around a token closes. Braces say where a scope ends: what
    follows a nested type or an anonymous class belongs to the method or type around it again.
    """
    def parts(t: Column, i: Column) -> Column:
        name = F.when(t["kind"].isin(HEADERS), _part(t["token"], r"^\w++\s++(\w++)"))
        signature = F.when(t["kind"].isin(METHODS), F.struct(*signature_parts(t["token"], F.get("params", i))))
        return F.struct(name.alias("name"), signature.alias("signature"))

    def placed(known: Column) -> Column:
        def one(s: Column) -> Column:
            def at(place: str) -> Column:
                return F.get("tokens", s[place])

            token = at("at")
            method, header = at("method_at"), at("type_at")
            signature = F.get(known, s["method_at"])["signature"]
            return F.struct(
                token["pos"].alias("pos"),
                token["kind"].alias("kind"),
                token["token"].alias("token"),
                at("end_at")["pos"].alias("block_end"),
                F.get(known, s["type_at"])["name"].alias("decl"),
                header["pos"].alias("decl_pos"),
                s["in_mapper"].alias("in_mapper"),
                F.when(token["kind"].isin(METHODS), s["annotated"]).alias("annotated"),
                method["pos"].alias("method_pos"),
                method["kind"].alias("method_kind"),
                *[signature[name].alias(name) for name in ("return_type", "method", "params", "args")],
            )

        return F.transform("scopes", one)

    return files.select("file_path", F.inline(_with(F.transform("tokens", parts), placed)))


def annotation_attribute(name: str, token="token") -> Column:
    """The text of `name = "..."` in an annotation."""
    return _part(token, rf'[(,]\s*+{name}\s*+=\s*+"((?:[^"\\]++|\\.)*+)"')


def annotation_ignored(token="token") -> Column:
    return F.regexp_extract(token, r"[(,]\s*+ignore\s*+=\s*+(true|false)", 1) == "true"
