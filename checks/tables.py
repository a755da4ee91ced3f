"""The input tables, and the Java texts made from `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Paths and Java texts as SQL both engines read the same way. The whole text of the document stands
# in a comment. Every file has the same shape: a mapper interface with a container of annotations, an
# update method, an annotation without target, implicit and default methods; and a class with a
# constructor, a converter, a method with a list of notes, and methods that are no mappings.
JAVA_PATH = (
    "concat('src/main/java/', lang, '/', source, '/F', cast(doc_id as varchar(20)), '.java')"
)
DOC_PATH = "concat('docs/', lang, '/', source, '/', cast(doc_id as varchar(20)), '.txt')"
_CAP = "concat(upper(substring(lang, 1, 1)), substring(lang, 2, 1))"


def _n(mod: int | None = None) -> str:
    return f"cast(doc_id{f' % {mod}' if mod else ''} as varchar(20))"


JAVA_TEXT = f"""concat(
 '/* ', replace(text, '*/', '* /'), ' */', chr(10),
 '// @Mapping(source = "ghost", target = "ghost")', chr(10),
 'package shop.', lang, ';', chr(10),
 '@Mapper(uses = {{A.class}}) public interface M', {_n()}, ' extends Base<X> {{', chr(10),
 '  @Mappings({{ @Mapping(source = "', source, '", target = "', lang, '")',
 case when doc_id % 3 = 0 then ', @Mapping(target = "id", ignore = true)'
      when doc_id % 3 = 1 then ', @Mapping(target = "e", expression = "java(f(x, y))")'
      else '' end,
 ' }})', chr(10),
 '  T', {_n(7)}, ' toT(@Named("n") final S', {_n(5)}, ' in, Map<K, List<V>> more);', chr(10),
 '  @Mapping(source = "a.', lang, '", target = "b.', source, '")', chr(10),
 '  void update(@MappingTarget U', {_n(3)}, ' u);', chr(10),
 '  @Mapping(source = "lost") L lone(W w);', chr(10),
 '  U plain(V v);', chr(10), '  U nothing();', chr(10),
 '  default T same(S s) {{ return f(s); }}', chr(10), '}}', chr(10),
 'public class P', {_n()}, ' {{', chr(10),
 '  static final String TEXT = "class Fake {{ d.setX(q.getY()); }}";', chr(10),
 '  public P', {_n()}, '(Q q) {{ this.q = q.q; }}', chr(10),
 '  public D', {_n(4)}, ' convertX(Q', {_n(6)}, ' q) {{ D d = new D(); if (q != null) {{ d.set',
 {_CAP}, '(q.get', {_CAP}, '()); }} else if (q.bad()) {{ helper(q); }}', chr(10),
 '    String n = q.getName(); d.setTitle(n); d.', source, ' = q.', lang,
 '; d.kind = q.getKind(); return d; }}', chr(10),
 '  public void mapOrder(Order src, final Target t) {{', chr(10),
 '    List<Note> notes = new ArrayList<>(); Note m = new Note();', chr(10),
 '    String c = src.getComment(); c = src.getRemark(); m.setKind(NOTE_', upper(source),
 '); m.setText(c); m.setAt(src.getCreated()); m.setRank("r', {_n(9)},
 '"); m.setObj(new Thing(1, "a;b")); m.setPair(pair(src));', chr(10),
 '    if (src.getExtras().get(SPECIAL_', upper(source),
 ') instanceof String extra) {{ m.setInfo(extra); }} notes.add(m); t.setNotes(notes);', chr(10),
 '    t.setLabel(c); t.setCode(src.getCode()); t.lang = src.', lang,
 '; Place p = new Place(); p.setCity(src.getCity()); t.setPlace(p); }}', chr(10),
 '  public int count(Q q) {{ x.setY(q.getY()); return 1; }}', chr(10),
 '  public D mapNone(Q q) {{ return null; }}', chr(10), '}}', chr(10))"""

# Scopes inside scopes, 200 levels of parentheses and 40 of type arguments: the whole text stands in a text block, and every assignment after a nested type,
# an anonymous class or a lambda belongs to the method around it.
_DEEP_TYPE = "concat(repeat('List<', 40), 'A', repeat('>', 40))"
SCOPE_TEXT = f"""concat(
 'package deep;', chr(10), '@Mapper interface N', {_n()}, ' {{', chr(10),
 '  @Mapping(source = "', source, '", target = "', lang, '") T1 one(S1 s);', chr(10),
 '  class Ctx {{ int n = 1; void fill(Q q) {{ if (q.any()) {{ q.run(); }} }} }}', chr(10),
 '  @Mapping(source = "late", target = "', source, '") T2 two(S2 s);', chr(10),
 '  T3 three(S3 s);', chr(10), '}}', chr(10),
 'class O', {_n()}, ' {{', chr(10),
 '  enum Kind {{ A, B; Kind next() {{ return A; }} }}', chr(10),
 '  void mapDeep(Q q, D d) {{', chr(10),
 '    class Local {{ int size(int n) {{ return n; }} }}', chr(10),
 '    Note n = new Note(); n.setA(a(b(c(e(f(q.getDeep())))))); ',
 'n.setL(f(x -> {{ int y = 1; return q.getLam(); }})); d.setNote(n);', chr(10),
 '    if (q.n() < 2 && 3 > q.m()) {{ d.setPit(', repeat('f(x -> {{ return (', 100), 'q.getAbyss()', repeat('); }})', 100), '); }}', chr(10),
 '    d.setHandler(new Handler() {{ public void handle(E e) {{ if (e.ok()) {{ e.end(); }} }} }});', chr(10),
 '    Runnable r = new Runnable() {{ public void run() {{ q.touch("}}"); }} }};', chr(10),
 '    d.setBlock(\"\"\"', chr(10), replace(text, '"', ' '), ' ) {{ ;', chr(10), '\"\"\");', chr(10),
 '    d.setAfter(q.getAfter()); d.last = q.last;', chr(10), '  }}', chr(10),
 '  static class Inner {{ X mapInner(Y y) {{ X x = new X(); x.setIn(y.get', {_CAP}, '()); return x; }} }}', chr(10),
 '  U convertOuter(V v) {{ U u = new U(); u.setOut(v.getOut()); return u; }}', chr(10),
 '  ', {_DEEP_TYPE}, ' toList(@Named(value = (((1)))) ', {_DEEP_TYPE}, ' v) {{ u.setIn(v.getIn()); return u; }}', chr(10), '}}')"""

SCOPE_ROWS = f"""
select {JAVA_PATH} as file_path, v.type, case when v.type = 'mapstruct' then concat('N', {_n()}) end as interface,
 v.method, case v.source_type when '$deep' then {_DEEP_TYPE} else v.source_type end as source_type,
 case v.target_type when '$deep' then {_DEEP_TYPE} else v.target_type end as target_type,
 case v.source_field when '$source' then source when '$lang' then lang else v.source_field end as source_field,
 case v.target_field when '$source' then source when '$lang' then lang else v.target_field end as target_field,
 v.implicit
from documents, (values
 ('mapstruct', 'one', 'S1', 'T1', '$source', '$lang', false),
 ('mapstruct', 'two', 'S2', 'T2', 'late', '$source', false),
 ('mapstruct', 'three', 'S3', 'T3', null, null, true),
 ('pojo', 'mapDeep', 'Q', 'D', 'deep', 'note.a', false),
 ('pojo', 'mapDeep', 'Q', 'D', 'lam', 'note.l', false),
 ('pojo', 'mapDeep', 'Q', 'D', 'after', 'after', false),
 ('pojo', 'mapDeep', 'Q', 'D', 'last', 'last', false),
 ('pojo', 'mapDeep', 'Q', 'D', 'abyss', 'pit', false),
 ('pojo', 'toList', '$deep', '$deep', 'in', 'in', false),
 ('pojo', 'mapInner', 'Y', 'X', '$lang', 'in', false),
 ('pojo', 'convertOuter', 'V', 'U', 'out', 'out', false)
) v(type, method, source_type, target_type, source_field, target_field, implicit)"""


# What a variable holds where it is used, and values computed from a getter. The text of the document stands
# in a string's place, as a comment between a name and its parenthesis.
FLOW_TEXT = f"""concat(
 'class Flow', {_n()}, ' {{', chr(10),
 '  void mapFlow /* ', replace(text, '*/', '* /'), ' */ (S s, T t) {{', chr(10),
 '    String v = s.getA(); t.setOne(v); v = s.get', {_CAP}, '(); t.setTwo(v);', chr(10),
 '    if (s.ok()) {{ v = s.getC(); t.setThree(v); }} else {{ t.setFour(v); }}', chr(10),
 '    t.setFive(v); String w; t.setNone(w);', chr(10),
 '    if (s.ok()) {{ w = s.getD(); }} else {{ w = s.getE(); }} t.setSix(w);', chr(10),
 '    for (X x : xs) {{ {{ v = s.getF(); }} t.setSeven(v); v = s.getG(); {{ t.setEight(v); }} }}', chr(10),
 '    t.setTrim(s.get', {_CAP}, '().trim()); t.setCast((long) s.getN());', chr(10),
 '    t.setPick(s.getP() == null ? "s.getQ()" : other); t.setHelp(help(s)); t.setText("s.getZ()");', chr(10),
 '    t.setKey(s.getMap().get("', source, '").trim()); o.setLost(s.getO().trim());', chr(10),
 '  }}', chr(10), '}}')"""

FLOW_ROWS = f"""
select {JAVA_PATH} as file_path, v.target_field,
 replace(replace(v.source_field, '$lang', lang), '$source', source) as source_field,
 replace(replace(v.expression, '$cap', {_CAP}), '$source', source) as expression
from documents, (values
 ('one', 'a', null), ('two', '$lang', null), ('three', 'c', null), ('four', '$lang', null), ('five', '$lang', null),
 ('six', 'e', null), ('seven', '$lang', null), ('eight', 'g', null),
 ('trim', '$lang', 's.get$cap().trim()'), ('cast', 'n', '(long) s.getN()'),
 ('pick', 'p', 's.getP() == null ? "s.getQ()" : other'), ('help', 'unknown', 'help(s)'),
 ('key', 'map.$source', 's.getMap().get("$source").trim()')
) v(target_field, source_field, expression)"""


# Mappers whose target types are the source types of others, in circles too.
CHAIN_TEXT = f"""concat(
 '/* ', replace(text, '*/', '* /'), ' */ @Mapper interface C', {_n()}, ' {{ @Mapping(source = "f', {_n(7)},
 '", target = "f', cast(doc_id * 3 % 7 as varchar(20)), '") N', cast((doc_id * 7 + 1) % 40 as varchar(20)),
 ' one(N', {_n(40)}, ' s);',
 case when doc_id % 11 = 0 then concat(' N', cast((doc_id + 5) % 40 as varchar(20)), ' same(N', {_n(40)}, ' v);') else '' end,
 ' }}', chr(10), 'class D', {_n()}, ' {{ N', cast((doc_id * 3 + 2) % 40 as varchar(20)), ' convertIt(N',
 cast((doc_id * 7 + 1) % 40 as varchar(20)), ' s) {{ t.setF', cast((doc_id + 2) % 7 as varchar(20)), '(s.getF',
 cast(doc_id * 3 % 7 as varchar(20)), '().trim()); t.setF6(CONSTANT); return t; }} }}')"""

CHAIN_SQL = """
with recursive e as (
  select 'N' || doc_id % 40 as type, 'f' || doc_id % 7 as field,
    'N' || (doc_id * 7 + 1) % 40 as to_type, 'f' || doc_id * 3 % 7 as to_field from documents
  union
  select 'N' || (doc_id * 7 + 1) % 40, 'f' || doc_id * 3 % 7, 'N' || (doc_id * 3 + 2) % 40, 'f' || (doc_id + 2) % 7
  from documents
  union
  select 'N' || doc_id % 40, null, 'N' || (doc_id + 5) % 40, null from documents where doc_id % 11 = 0
), starts as (
  select distinct 'N' || doc_id % 40 as type, 'f' || doc_id % 7 as field from documents where doc_id % 40 < 3
), r as (
  select type as start_type, field as start_field, type, field, 0 as hops from starts
  union
  select start_type, start_field, e.to_type, coalesce(e.to_field, r.field), hops + 1
  from r join e on e.type = r.type and (e.field = r.field or e.field is null) where hops < 40
)
select start_type, start_field, type, field, min(hops)::int as hops from r group by all"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def java_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.expr(JAVA_PATH).alias("file_path"), F.expr(JAVA_TEXT).alias("content"))


def text_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of a tree."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.expr(DOC_PATH).alias("file_path"), F.col("text").alias("content"))


def label_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector per label: the mean of its vectors."""
    means = (
        table(spark, sf_dir, "embeddings")
        .select("label", F.posexplode("embedding").alias("at", "x"))
        .groupBy("label", "at")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("at", "x")))
    return means.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(ordered, lambda p: p["x"]).alias("embedding")
    )


def answer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as the lines a model sends: three forms of lines, some blank."""
    talk = table(spark, sf_dir, "conversations")
    done = F.col("role") == "assistant"
    plain = F.to_json(F.struct(F.col("text").alias("response"), done.alias("done")))
    wrapped = F.to_json(
        F.struct(F.struct(F.col("text").alias("content")).alias("message"), done.alias("done"))
    )
    kind = (F.col("conv_id") + F.col("turn")) % 7
    line = (
        F.when(kind == 0, F.col("text")).when(kind == 1, wrapped).when(kind == 2, F.lit("  "))
        .otherwise(plain)
    )
    return talk.select(
        F.col("conv_id").alias("question_id"), F.col("turn").alias("seq"), line.alias("line")
    )
