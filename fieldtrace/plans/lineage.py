"""Field mappings from scoped tokens: mapper interfaces and hand-written mapping methods.

Tokens arrive partitioned by file from the windows that scoped them, and everything here is a
column rule or a window on finer keys of the same partitioning. So the whole extraction is one scan
and one shuffle, of tokens: variables are looked up by windows on (method, variable) and not by
self joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fieldtrace import fixed
from fieldtrace.functions import text as tx
from fieldtrace.plans import tokens as tk

FIELD_MAPPING_COLUMNS = [
    "file_path", "type", "interface", "method", "source_type", "target_type", "source_field",
    "target_field", "target_path", "expression", "value", "ignore", "implicit", "pos", "method_pos",
]

IDENTIFIER = r"(?U)^\w+$"
BARE_GETTER = r"(?U)^(\w+)\.get(\w+)\s*\(\s*\)$"


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _part(pattern: str, group: int = 1, token="token") -> Column:
    return F.nullif(F.regexp_extract(token, tk.UNICODE + pattern, group), F.lit(""))


# --- mapper interfaces -------------------------------------------------------------------------


def mapper_methods(scoped: DataFrame) -> DataFrame:
    """Methods without body of mapper interfaces and mapper classes."""
    return scoped.where((F.col("kind") == "declared") & F.col("in_mapper")).select(
        "file_path",
        F.col("decl").alias("interface"),
        "method",
        "return_type",
        tk.first_parameter_type().alias("source_type"),
        "annotated",
        F.col("pos").alias("method_pos"),
    )


def annotations(scoped: DataFrame) -> DataFrame:
    """Mapping annotations with their attributes and the method they belong to."""
    return scoped.where((F.col("kind") == "mapping") & F.col("in_mapper")).select(
        "file_path",
        "pos",
        F.col("decl").alias("interface"),
        "method_pos",
        "method_kind",
        "method",
        "return_type",
        "params",
        tk.annotation_attribute("source").alias("source"),
        tk.annotation_attribute("target").alias("target"),
        tk.annotation_attribute("expression").alias("expression"),
        tk.annotation_ignored().alias("ignore"),
    )


def _explicit() -> Column:
    """An annotation with a target, on a method without body."""
    target = tk.annotation_attribute("target")
    return F.when(
        (F.col("kind") == "mapping")
        & F.col("in_mapper")
        & (F.col("method_kind") == "declared")
        & target.isNotNull(),
        _mapped(
            source_field=tk.annotation_attribute("source"),
            target_field=target,
            expression=tk.annotation_attribute("expression"),
            ignore=tk.annotation_ignored(),
        ),
    )


def _implicit() -> Column:
    """A method with a parameter and no annotation."""
    return F.when(
        (F.col("kind") == "declared")
        & F.col("in_mapper")
        & ~F.col("annotated")
        & F.col("source_type").isNotNull(),
        _mapped(implicit=F.lit(True)),
    )


def _mapped(**values: Column) -> Column:
    """One found mapping."""
    kinds = {
        "source_field": "string", "target_field": "string", "target_path": "string",
        "expression": "string", "value": "string", "ignore": "boolean", "implicit": "boolean",
    }
    defaults = {"ignore": F.lit(False), "implicit": F.lit(False)}
    return F.struct(
        *[
            values.get(name, defaults.get(name, _null())).cast(kind).alias(name)
            for name, kind in kinds.items()
        ]
    )


def implicit_mappings(scoped: DataFrame) -> DataFrame:
    """Mapper methods with a parameter and no annotation."""
    return _as_field_mappings(statements(scoped), F.array(_implicit())).where("implicit")


# --- hand-written methods ----------------------------------------------------------------------


def statements(scoped: DataFrame) -> DataFrame:
    """Scoped tokens with source and target of the method, and the parts of each statement.

    `is_pojo` marks tokens of mapping methods: the name starts with one of the known prefixes and
    there is one parameter, or two of which the second is the target of a void method. Parts by
    kind: setter `var.setField(value)`; add `var.add(value)`; local and instance `var` read from
    the source parameter at `own_path`; field `var.field = ...`.
    """
    prefixes = "|".join(fixed.POJO_PREFIXES)
    args, kind = F.col("args"), F.col("kind")
    first, second = F.get(args, F.lit(0)), F.get(args, F.lit(1))
    is_pojo = (
        (F.col("method_kind") == "body")
        & F.col("method").rlike(f"^(?:{prefixes})")
        & ~F.col("return_type").isin(tk.MODIFIERS)
        & F.size(args).between(1, 2)
    )
    two = (F.col("return_type") == "void") & (F.size(args) == 2)
    read = F.when(kind == "local", _part(r"=\s*(\w+)\.")).when(
        kind == "instance", _part(r"^(\w+)\.")
    )
    marked = scoped.withColumn("is_pojo", F.coalesce(is_pojo, F.lit(False)))
    pojo = F.col("is_pojo")
    named = marked.select(
        *marked.columns,
        first["type"].alias("source_type"),
        F.when(pojo, first["name"]).alias("source_var"),
        F.when(pojo & two, second["type"]).otherwise(F.col("return_type")).alias("target_type"),
        F.when(pojo & two, second["name"]).alias("target_var"),
        F.when(
            pojo,
            F.when(kind == "instance", _part(r"(\w+)$")).when(
                kind.isin("setter", "add", "local", "field"), _part(r"^(\w+)")
            ),
        ).alias("var"),
        F.when(
            pojo,
            F.when(kind == "setter", tx.decapitalise(_part(r"^\w+\.set(\w+)"))).when(
                kind == "field", _part(r"^\w+\.(\w+)")
            ),
        ).alias("field"),
        F.when(
            pojo,
            F.when(
                kind == "setter", F.trim(F.regexp_extract("token", r"(?Us)^\w+\.set\w+\s*\((.*)\)$", 1))
            ).when(kind == "add", _part(r"\(\s*(\w+)\s*\)$")),
        ).alias("value"),
    )
    return named.withColumn(
        "own_path", F.when(pojo & (read == F.col("source_var")), source_path("token"))
    )


def pojo_statements(scoped: DataFrame) -> DataFrame:
    """Statements of mapping methods."""
    return statements(scoped).where("is_pojo")


def pojo_methods(rows: DataFrame) -> DataFrame:
    """Headers of the mapping methods."""
    return rows.where((F.col("kind") == "body") & F.col("is_pojo")).select(
        "file_path", "method_pos", "method", "return_type", "source_type", "source_var",
        "target_type", "target_var",
    )


def source_path(expression) -> Column:
    """`src.getX()` -> `x`; `src.getX().get(SOME_KEY)` -> `x.someKey`."""
    field = tx.decapitalise(F.regexp_extract(expression, r"(?U)\.get(\w+)\s*\(\s*\)", 1))
    key = F.regexp_extract(expression, r"(?U)\(\s*\)\s*\.get\s*\(\s*\"?(\w+)\"?\s*\)", 1)
    deeper = F.concat(F.lit("."), F.nullif(tx.snake_to_camel(key), F.lit("")))
    return F.concat(field, F.coalesce(deeper, F.lit("")))


def variable_sources(rows: DataFrame) -> DataFrame:
    """Local variables read from the source parameter, one row per assignment."""
    return rows.where(F.col("own_path").isNotNull()).select(
        "file_path", "method_pos", "var", F.col("own_path").alias("path"), "pos"
    )


def last_sources(variables: DataFrame) -> DataFrame:
    """What each variable of a method holds at its end; `with_sources` has what it holds at each use."""
    return variables.groupBy("file_path", "method_pos", "var").agg(
        F.max_by("path", "pos").alias("path")
    )


def list_members(rows: DataFrame) -> DataFrame:
    """`list.add(item)`: list variable and item variable."""
    return (
        rows.where(F.col("is_pojo") & (F.col("kind") == "add"))
        .select(
            "file_path", "method_pos", F.col("var").alias("list_var"),
            F.col("value").alias("item_var"),
        )
        .distinct()
    )


def _within(key: str):
    return Window.partitionBy("file_path", "method_pos", key)


def with_sources(rows: DataFrame) -> DataFrame:
    """Adds `path` to setter calls: the source path of the variable they are given, if it has one.

    The value is the one the variable has there: of the last assignment before the call in a block that is
    still open; where all of them stand in blocks that closed (branches of an `if`), of the last one.
    """
    own = F.col("own_path").isNotNull()
    key = F.when(own, F.col("var")).when(F.col("kind") == "setter", F.col("value"))
    before = _within("__key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    given = F.when(own, F.struct("own_path", F.col("block_end").alias("until")))
    open_here = F.filter("__given", lambda g: g["until"].isNull() | (g["until"] > F.col("pos")))
    last = F.coalesce(F.try_element_at(open_here, F.lit(-1)), F.try_element_at("__given", F.lit(-1)))["own_path"]
    return (
        rows.withColumn("__key", key)
        .withColumn("__given", F.collect_list(given).over(before))
        .withColumn("path", F.when((F.col("kind") == "setter") & (F.size("__given") > 0), last))
        .drop("__key", "__given")
    )


def with_places(rows: DataFrame) -> DataFrame:
    """Adds `places` to setter calls: the target fields the variable they are called on ends up in.

    An object is put there itself by `target.setField(object)`, or with others in a list by
    `list.add(object)` and `target.setField(list)`.
    """
    kind = F.col("kind")
    is_put = F.coalesce(
        (kind == "setter")
        & (F.col("var") == F.col("target_var"))
        & F.col("value").rlike(IDENTIFIER),
        F.lit(False),
    )
    is_add = kind == "add"
    lists = _within("__list")
    marked = rows.select(
        "*",
        F.when(is_put, F.col("value")).when(is_add, F.col("var")).alias("__list"),
        F.when(is_put, F.col("field")).alias("__put"),
        F.when(is_add, 1).alias("__add"),
    )
    found = marked.select(
        "*",
        F.collect_set("__put").over(lists).alias("__outer"),
        F.count("__add").over(lists).alias("__adds"),
    )
    place = "array<struct<outer:string,is_item:boolean>>"
    asks = F.struct(
        F.when(kind == "setter", F.col("var")).alias("key"), _null(place).alias("gives")
    )
    itself = F.array(F.struct(F.col("field").alias("outer"), F.lit(False).alias("is_item")))
    items = F.transform(
        "__outer", lambda o: F.struct(o.alias("outer"), F.lit(True).alias("is_item"))
    )

    def giving(places: Column) -> Column:
        return F.struct(F.col("value").alias("key"), places.cast(place).alias("gives"))

    roles = (
        F.when(F.col("__put").isNotNull() & (F.col("__adds") == 0), F.array(asks, giving(itself)))
        .when(is_add, F.array(asks, giving(items)))
        .otherwise(F.array(asks))
    )
    return (
        found.withColumn("__role", F.explode(roles))
        .withColumn("__key", F.col("__role.key"))
        .withColumn(
            "places",
            F.array_distinct(F.flatten(F.collect_list("__role.gives").over(_within("__key")))),
        )
        .where(F.col("__role.gives").isNull())
        .select(*rows.columns, F.when(kind == "setter", F.col("places")).alias("places"))
    )


def _own_path(var: Column, field: Column) -> Column:
    """The field, with its variable in front where that is not the target parameter."""
    return F.when(
        F.col("target_var").isNotNull(),
        F.when(var == F.col("target_var"), field).otherwise(F.concat_ws(".", var, field)),
    )


def _assigned(source: Column, **more: Column) -> Column:
    target_path = _own_path(F.col("var"), F.col("field"))
    return _mapped(source_field=source, target_field=F.col("field"), target_path=target_path, **more)


def _on_target() -> Column:
    return F.col("target_var").isNull() | (F.col("var") == F.col("target_var"))


def _setter() -> Column:
    """`t.setX(src.getY())` where `src` is the source parameter."""
    return F.when(_is_bare_getter(), _assigned(tx.decapitalise(F.regexp_extract("value", BARE_GETTER, 2))))


def _is_bare_getter() -> Column:
    # Most values have no getter, which is cheap to see.
    bare = F.regexp_extract("value", BARE_GETTER, 1) == F.col("source_var")
    return (F.col("kind") == "setter") & F.col("value").contains(".get") & bare


def _computed() -> Column:
    """`t.setX(f(src.getY()))` on the target: the value is computed from the source parameter.

    The text of the value is the expression; without a getter the source field is `unknown`.
    """
    computed = (F.col("kind") == "setter") & ~_is_bare_getter() & _reads_source() & _on_target()
    return F.when(computed, _assigned(value_source(), expression=F.col("value")))


def _direct() -> Column:
    """`t.x = src.y` or `t.x = src.getY()` where `src` is the source parameter."""
    right = _part(r"=\s*\w+\.(\w+)")
    getter = F.col("token").endswith(")") & right.rlike(r"(?U)^get\w")
    source = F.when(getter, tx.decapitalise(F.substring(right, 4, 1 << 30))).otherwise(right)
    return F.when(
        (F.col("kind") == "field") & (_part(r"=\s*(\w+)\.") == F.col("source_var")),
        _assigned(source),
    )


def _variable() -> Column:
    """`target.setX(v)` where `v` was read from the source: the field comes from that path."""
    return F.when(
        (F.col("kind") == "setter") & F.col("path").isNotNull() & _on_target(),
        _assigned(F.col("path"), value=F.col("value")),
    )


def _nested() -> Column:
    """Fields set on objects that are themselves set on, or added to a list set on, the target.

    `note.setKind(KIND); notes.add(note); target.setNotes(notes)` gives `notes[].kind`.
    """

    def at(place: Column) -> Column:
        field = F.concat(
            place["outer"], F.when(place["is_item"], "[].").otherwise("."), F.col("field")
        )
        return _mapped(
            source_field=F.col("__source"),
            target_field=field,
            target_path=F.concat_ws(".", "target_var", field),
            value=F.col("value"),
        )

    return F.transform(F.coalesce("places", F.array()), at)


def _reads_source(value="value", source_var="source_var") -> Column:
    """Whether a value names the source parameter, outside of literals."""
    value, var = F.col(value), F.col(source_var)
    quoted = value.contains('"') | value.contains("'")
    named = F.regexp_like(
        F.when(quoted, F.regexp_replace(value, tk.LITERAL, "")).otherwise(value),
        F.concat(F.lit(r"(?U)\b"), var, F.lit(r"\b")),
    )
    # A pattern of its own for each name is costly, and most values do not have the name's letters.
    return (quoted | value.contains(var)) & named


def value_source(value="value", path="path", source_var="source_var") -> Column:
    """Where a nested value comes from: source path, known variable, constant or literal."""
    reads = _reads_source(value, source_var)
    value, path, var = F.col(value), F.col(path), F.col(source_var)
    getter = r"\.get\w+\s*\(\s*\)(?:\s*\.get\s*\([^()]*\))?"
    call = F.regexp_substr(value, F.concat(F.lit(r"(?U)\b"), var, F.lit(getter)))
    from_source = F.coalesce(source_path(call), F.lit("unknown"))
    literal = ~value.startswith("new ")
    return (
        F.when(reads, from_source)
        .when(path.isNotNull(), path)
        .when(value.rlike("^[A-Z_][A-Z0-9_]*$"), F.concat(F.lit("constant:"), value))
        .when(value == "", F.lit("unknown"))
        .when(literal, value)
        .otherwise("constant")
    )


# --- rows --------------------------------------------------------------------------------------


def _as_field_mappings(rows: DataFrame, found: Column) -> DataFrame:
    """Rows with an array of found mappings as field mappings."""
    in_mapper = F.col("m.implicit") | (F.col("kind") == "mapping")
    source_type = F.coalesce("source_type", F.lit("Unknown"))
    return (
        rows.withColumn("m", F.explode(F.array_compact(found)))
        .select(
            "file_path",
            F.when(in_mapper, "mapstruct").otherwise("pojo").alias("type"),
            F.when(in_mapper, F.col("decl")).alias("interface"),
            "method",
            source_type.alias("source_type"),
            "target_type",
            "m.*",
            "pos",
            "method_pos",
        )
        .select(*FIELD_MAPPING_COLUMNS)
    )


def setter_assignments(rows: DataFrame) -> DataFrame:
    return _as_field_mappings(rows, F.array(_setter()))


def computed_assignments(rows: DataFrame) -> DataFrame:
    return _as_field_mappings(with_sources(rows), F.array(_computed()))


def direct_assignments(rows: DataFrame) -> DataFrame:
    return _as_field_mappings(rows, F.array(_direct()))


def variable_to_target(rows: DataFrame) -> DataFrame:
    return _as_field_mappings(with_sources(rows), F.array(_variable()))


def _with_value_source(rows: DataFrame) -> DataFrame:
    needed = F.size(F.coalesce("places", F.array())) > 0
    return rows.withColumn("__source", F.when(needed, value_source()))


def nested_assignments(rows: DataFrame) -> DataFrame:
    resolved = _with_value_source(with_places(with_sources(rows)))
    return _as_field_mappings(resolved, _nested())


def pojo_field_mappings(rows: DataFrame) -> DataFrame:
    """All field mappings of the hand-written methods; methods without any have no row."""
    resolved = _with_value_source(with_places(with_sources(rows)))
    one = F.array(_setter(), _computed(), _direct(), _variable())
    return _as_field_mappings(resolved, F.concat(one, _nested()))


def mapper_field_mappings(scoped: DataFrame) -> DataFrame:
    """One row per annotation with a target, and one per method without any (implicit mapping)."""
    return _as_field_mappings(statements(scoped), F.array(_explicit(), _implicit()))


def field_mappings(
    sources: DataFrame, path_col: str = "file_path", text_col: str = "content"
) -> DataFrame:
    """All field mappings of Java sources, one flat row each, in one pass over the texts.

    Ahead of it the texts are measured, so sources that are costly to make are best held.
    """
    # Texts with neither a mapper nor a name of a mapping method have none.
    names = "|".join(fixed.POJO_PREFIXES)
    likely = F.col(text_col).contains("@Mapper") | F.col(text_col).rlike(rf"(?U)\b(?:{names})\w*\s*(?:\(|/[/*])")
    rows = statements(tk.scoped(tk.dealt(sources.where(likely), path_col, text_col)))
    # Headers and statements of other methods give nothing.
    useful = rows.where(F.col("is_pojo") | (F.col("in_mapper") & ~F.col("kind").isin(tk.HEADERS)))
    # The text of a setter is not looked at again, and windows are cheaper without it.
    useful = useful.withColumn("token", F.when(F.col("kind") != "setter", F.col("token")))
    resolved = _with_value_source(with_places(with_sources(useful)))
    # What no kind of token but one gives is worked out for that kind alone.
    kind = F.col("kind")
    found = (
        F.when(kind == "setter", F.concat(F.array(_setter(), _computed(), _variable()), _nested()))
        .when(kind == "mapping", F.array(_explicit()))
        .when(kind == "declared", F.array(_implicit()))
        .when(kind == "field", F.array(_direct()))
    )
    return _as_field_mappings(resolved, found)
