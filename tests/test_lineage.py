"""Field lineage against rows worked out by hand."""

import pytest
from conftest import rows
from java import FLEET, FLEET_ROWS, NESTED, NESTED_ROWS
from pyspark.sql import functions as F

from fieldtrace.plans import entries as en, lineage, questions, reach, tokens as tk
from fieldtrace.sources.files import inline_source

FLAT = [
    "type", "method", "source_type", "target_type", "source_field", "target_field", "ignore",
    "implicit",
]


def extract(spark, text):
    return lineage.field_mappings(inline_source(spark, text, "a.java"))


def found(spark, text, *names):
    return rows(extract(spark, text), *names)


def test_sample(spark):
    assert found(spark, FLEET, *FLAT) == sorted(FLEET_ROWS, key=repr)


def test_entries_and_report(spark):
    source = inline_source(spark, FLEET, "a.java")
    entries = en.entries(extract(spark, FLEET))
    assert rows(en.summary(source, entries)) == [("a.java", None, 5, 3, 2)]
    report = en.text_report(source, entries).first()["report"]
    assert report.startswith(
        "File: a.java\nTotal Mappings: 5\n  - MapStruct: 3\n  - POJO: 2\n\n"
        "Mapping 1: MAPSTRUCT\n  Source Type: Truck\n  Target Type: Plate\n"
        "  Interface: TruckMapping\n  Method: plate\n  Implicit mapping (field names match)\n"
    )
    assert "    N/A -> audit\n      (IGNORED)\n" in report
    assert "    home -> depot.name\n" in report
    grouped = rows(en.grouped(extract(spark, FLEET)), "method", "n_fields")
    assert grouped == [("card", 2), ("log", 1), ("plate", 0)]


def test_nested(spark):
    got = found(spark, NESTED, "source_field", "target_field", "target_path")
    assert got == sorted(NESTED_ROWS, key=repr)


def test_header_with_braces_and_extends(spark):
    text = """
    @Mapper(uses = {A.class, B.class}) interface M extends Base<X> {
      @Mapping(source = "a", target = "b") T one(S s); }
    @Mapper public abstract class C { @Mapping(source = "c", target = "d") abstract T two(S s); }
    interface Plain { @Mapping(source = "e", target = "f") T three(S s); }
    """
    got = found(spark, text, "interface", "method", "source_field")
    assert got == [("C", "two", "c"), ("M", "one", "a")]


def test_quoted_parentheses(spark):
    text = """@Mapper interface M {
      @Mapping(expression = "java(f(x))", target = "a")
      @Mapping(target = "b", expression = "java(g(\\"q\\", y(z)))", source = "s")
      T one(S s); }"""
    got = found(spark, text, "target_field", "source_field", "expression")
    assert got == [("a", None, "java(f(x))"), ("b", "s", 'java(g(\\"q\\", y(z)))')]


def test_container_and_own_annotations_only(spark):
    text = """@Mapper interface M {
      @Mappings({ @Mapping(source = "a", target = "b"), @Mapping(source = "c", target = "d") })
      T one(S s);
      @Mapping(source = "e", target = "f") T two(S s);
      T three(S s);
      @Mapping(source = "lost") T four(S s);
      T five(); }"""
    got = found(spark, text, "method", "source_field", "implicit")
    assert got == [
        ("four", None, True), ("one", "a", False), ("one", "c", False), ("three", None, True),
        ("two", "e", False),
    ]


@pytest.mark.parametrize(
    "params, want",
    [
        ("@MappingTarget U u", "U"),
        ("final U u", "U"),
        ("Map<K, List<V>> m, U u", "Map<K, List<V>>"),
        ('@Named("x, y") @Other(a = {1, 2}) U[] u', "U[]"),
        ("a.b.U... u", "a.b.U..."),
    ],
)
def test_first_parameter(spark, params, want):
    got = found(spark, f"@Mapper interface M {{ T one({params}); }}", "source_type", "implicit")
    assert got == [(want, True)]


@pytest.mark.parametrize("name", ["map", "convertX", "transformAll", "toView"])
def test_pojo_forms(spark, name):
    text = f"""class P {{
      T {name}(S s) {{ T t = new T(); t.setA(s.getB()); t.c = s.getD(); return t; }}
      void {name}One(S s) {{ this.setA(s.getB()); }}
      void {name}Two(S s, T t) {{ t.setA(s.getB()); other.setA(s.getC()); }}
      void x{name}(S s, T t) {{ t.setA(s.getB()); }}
      T {name}None(S s) {{ return null; }}
    }}"""
    got = found(spark, text, "method", "source_type", "target_type", "source_field", "target_field", "target_path")
    assert got == sorted(
        [
            (name, "S", "T", "b", "a", None),
            (name, "S", "T", "d", "c", None),
            (f"{name}One", "S", "void", "b", "a", None),
            (f"{name}Two", "S", "T", "b", "a", "a"),
            (f"{name}Two", "S", "T", "c", "a", "other.a"),
        ],
        key=repr,
    )


def test_statements_are_no_methods(spark):
    text = """@Mapper interface M {
      default T same(S s) { if (s == null) { return f(s); } else if (g(s)) { throw new E(s); } return h(s); }
      T other(S s); }"""
    assert found(spark, text, "method", "implicit") == [("other", True)]


def test_local_variable(spark):
    text = "class P { T map(S src) { T t = new T(); String n = src.getName(); t.setTitle(n); return t; } }"
    assert found(spark, text, "source_field", "target_field") == [("name", "title")]


def test_comments_and_literals(spark):
    text = """/* @Mapper interface A { @Mapping(source = "x", target = "y") T z(S s); } */
    @Mapper interface M { // @Mapping(source = "a", target = "b")
      String URL = "http://x/*y*/"; char Q = '"';
      /* } */ @Mapping(source = "c", target = "d") T one(S s); }
    class P { String TEXT = "class Q { void mapX(S s, T t) { t.setA(s.getB()); } }"; }"""
    assert found(spark, text, "interface", "source_field") == [("M", "c")]


def test_long_literal_does_not_overflow(spark):
    long = "ab\\\\n" * 40000
    text = f'class P {{ T map(S s) {{ t.setA(s.getA()); log("{long}"); t.setB(s.getB()); return t; }} }}'
    assert found(spark, text, "source_field") == [("a",), ("b",)]


def test_non_ascii_names(spark):
    text = "class P { T map(S s) { t.setGröße(s.getLänge()); return t; } }"
    assert found(spark, text, "source_field", "target_field") == [("länge", "größe")]


def test_declarations(spark):
    toks = tk.tokens(inline_source(spark, FLEET, "a.java"))
    got = rows(tk.declarations(toks), "kind", "name")
    assert got == [("class", "Options"), ("class", "TripTools"), ("interface", "TruckMapping")]


def test_one_shuffle(spark):
    """The extraction is one scan and one exchange, whatever is joined up inside."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = extract(spark, FLEET)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_tasks_follow_the_texts(spark, monkeypatch):
    """A task of the windows gets a bounded part of the texts, whatever the number of partitions is set to."""
    monkeypatch.setattr(tk, "TASK_BYTES", 1 << 14, raising=False)
    one = "@Mapper interface M { @Mapping(source = \"a\", target = \"b\") T one(S s); } " + "{ }" * 100
    texts = spark.range(40).selectExpr("concat('f', id, '.java') as file_path", f"'{one}' as content")
    found = lineage.field_mappings(texts)
    tasks = found.withColumn("task", F.spark_partition_id())
    assert found.count() == 40 and found.select("file_path").distinct().count() == 40
    # 40 files of some 55 KB each in rows: more than the 4 partitions of the session.
    assert tasks.select("task").distinct().count() > 8


def test_questions(spark):
    mappings = extract(spark, FLEET)
    source = inline_source(spark, FLEET, "a.java")
    assert rows(questions.fields_between(mappings, "Trip", "Summary")) == [
        ("distance", "distance"), ("driver", "driver"), ("road", "route"),
    ]
    assert questions.by_types(mappings, "Truck", "Card").count() == 2
    assert rows(questions.field_usage(mappings, source, "ROAD")) == [("a.java", 1)]


def test_values_by_flow(spark):
    text = """class P { void mapX(S s, T t) {
      v = s.getA(); t.setOne(v); v = s.getB(); t.setTwo(v);
      if (c) { v = s.getC(); } else { t.setThree(v); }
      t.setFour(v); t.setEarly(w); w = s.getW(); } }"""
    assert found(spark, text, "target_field", "source_field") == [
        ("four", "b"), ("one", "a"), ("three", "b"), ("two", "b"),
    ]


def test_computed_values(spark):
    text = """class P { T mapX(S s) {
      t.setA(s.getA().trim()); t.setB((int) s.getB()); t.setC(x ? s.getC() : null); t.setD(f(s)); t.setE("s.getE()");
      return t; } }"""
    got = found(spark, text, "target_field", "source_field", "expression")
    assert got == [
        ("a", "a", "s.getA().trim()"), ("b", "b", "(int) s.getB()"), ("c", "c", "x ? s.getC() : null"),
        ("d", "unknown", "f(s)"),
    ]
    assert questions.transformed(extract(spark, text)).count() == 4


def test_comment_between_name_and_parenthesis(spark):
    text = "class P { T mapX /* two */ (S s) { t.setA(s.getB()); return t; } }"
    assert found(spark, text, "source_field", "target_field") == [("b", "a")]


def test_fields_reached(spark):
    text = """
    @Mapper interface M { @Mapping(source = "a", target = "b") B one(A x); C two(B x); @Mapping(source = "b", target = "a") A back(C x); }
    class P { D mapIt(C c) { d.setEnd(c.getB().trim()); d.setFixed(CONSTANT); return d; } }"""
    starts = spark.createDataFrame([("A", "a"), ("B", "x"), ("Z", "z"), (None, "a"), ("A", "a")], "type string, field string")
    got = rows(reach.reached(extract(spark, text), starts))
    assert got == sorted(
        [
            ("A", "a", "A", "a", 0), ("A", "a", "B", "b", 1), ("A", "a", "C", "b", 2), ("A", "a", "D", "end", 3),
            ("B", "x", "B", "x", 0), ("B", "x", "C", "x", 1), ("Z", "z", "Z", "z", 0),
        ],
        key=repr,
    )
    assert reach.reached(extract(spark, text), starts, max_hops=1).count() == 5


def test_long_chains_keep_short_plans(spark):
    n = reach.MERGE_ROUNDS + 3
    methods = " ".join(f'@Mapping(source = "f", target = "f") T{i + 1} m{i}(T{i} x);' for i in range(n))
    mappings = extract(spark, f"@Mapper interface M {{ {methods} }}")
    starts = spark.createDataFrame([("T0", "f")], "type string, field string")
    assert rows(reach.reached(mappings, starts), "hops") == [(i,) for i in sorted(range(n + 1), key=lambda i: repr((i,)))]


def test_brackets_of_any_depth(spark):
    deep, types = "f(" * 500 + "s.getA()" + ")" * 500, "List<" * 60 + "X" + ">" * 60
    text = f"""@Mapper interface M {{ T one(Map<K, {types}> in, U u); }}
    class P {{ {types} mapX(@Named(a = {"(" * 40}1{")" * 40}) {types} s) {{
      if (1 < n && m > 2) {{ t.setA({deep}); }} t.setB(s.getB()); t.setOpen(((s.getO()); }} }}"""
    got = found(spark, text, "source_type", "target_type", "source_field", "expression")
    assert got == sorted(
        [(f"Map<K, {types}>", "T", None, None), (types, types, "a", deep), (types, types, "b", None)], key=repr
    )


def test_marks(spark):
    texts = ["f(g(x))", "a < b; List<Map<K, V>> v", ")(", "", "x -> y(\"(\")", "\x01(\x02)", "(" * 1000 + ")" * 1000]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = [r[0] for r in df.select(tk.marked("t")).collect()]
    assert got[0] == "f(\x011\x02g(\x012\x02x\x012\x03)\x011\x03)"
    assert got[1] == "a <\x011\x04 b; List<\x011\x04Map<\x012\x04K, V\x012\x05>\x011\x05> v"
    assert got[2:6] == [")(\x011\x02", "", 'x -> y(\x011\x02"("\x011\x03)', "(\x011\x02\x011\x03)"]
    assert got[6].endswith("\x012\x03)\x011\x03)") and "(\x011000\x02\x011000\x03)" in got[6] and got[7] is None
    assert [r[0] for r in df.select(tk.unmarked(tk.marked("t"))).collect()][:5] == texts[:5]


def test_scopes_cost_no_windows(spark):
    """Scopes come from one pass over the kinds of a file's tokens; only values and places of variables are windows."""
    plan = extract(spark, FLEET)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") <= 3


def test_scopes_of_broken_texts():
    """Braces that open nothing or close nothing; a type that closed is still the last one of its level."""
    kinds = ["close", "mapper", "interface", "mapping", tk.AIMED, "declared", "close", "open", "body", "setter"]
    assert tk.scopes(kinds) == [
        (1, None, None, False, False, None), (2, 2, None, True, False, 6), (3, 2, 5, True, False, 6),
        (4, 2, 5, True, False, 6), (5, 2, 5, True, True, 6), (8, None, 8, False, False, None),
        (9, None, 8, False, False, None),
    ]
    assert tk.scopes([]) == []
