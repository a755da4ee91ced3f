"""SQL building blocks of the oracle queries.

The same questions asked another way: scopes by positions and joins, hashed vectors as sparse rows.
"""

from __future__ import annotations

from checks.tables import DOC_PATH, JAVA_PATH, JAVA_TEXT

# --- Java texts to field mappings --------------------------------------------------------------

_STR = r'"(?:[^"\\\n]|\\.)*"'
_ARGS = rf"\((?:[^()\"';]|{_STR}|\((?:[^()\"';]|{_STR}|\([^();]*\))*\))*\)"
_GEN = r"(?:<(?:[^<>(){};]|<[^<>(){};]*>)*>)?"
_GET = r"\w+\.get\w+\s*\(\s*\)(?:\s*\.get\s*\([^()]*\))?"
_TOKEN = "|".join(
    [
        rf"@Mapper\b(?:\s*{_ARGS})?",
        rf"@Mapping\s*{_ARGS}",
        r"\b(?:class|interface)\s+\w+[^{};\"@()]*\{",
        rf"\b\w+{_GEN}\s+\w+\s*{_ARGS}\s*[;{{]",
        rf"\b\w+\.set\w+\s*{_ARGS}",
        r"\b\w+\.add\s*\(\s*\w+\s*\)",
        rf"\b{_GET}\s+instanceof\s+\w+\s+\w+",
        r"\b\w+\.\w+\s*=\s*\w+\.\w+(?:\s*\(\s*\))?",
        rf"\b\w+\s*=\s*{_GET}",
        _STR,
        r"[{}]",
    ]
).replace("'", "''")
_COMMENT = rf"({_STR})|//[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/"
_PARAM = rf"(\w+{_GEN})\s+(\w+)"
_NOT_A_METHOD = "'return','new','else','throw','if','while','for','switch','catch'"

SRC = f"src as (select doc_id, {JAVA_PATH} as file_path, {JAVA_TEXT} as content from documents)"


def decap(x: str) -> str:
    return f"lower(left({x}, 1)) || substr({x}, 2)"


def camel(x: str) -> str:
    words = f"string_split(lower({x}), '_')"
    return (
        f"array_to_string(list_transform({words}, lambda w, i: case when i = 1 then w "
        "else upper(left(w, 1)) || substr(w, 2) end), '')"
    )


def path_of(x: str) -> str:
    key = rf"regexp_extract({x}, '\(\s*\)\s*\.get\s*\(\s*(\w+)\s*\)', 1)"
    field = rf"regexp_extract({x}, '\.get(\w+)\s*\(\s*\)', 1)"
    return f"({decap(field)}) || case when {key} <> '' then '.' || {camel(key)} else '' end"


def _attr(name: str) -> str:
    return rf"""nullif(regexp_extract(token, '[(,]\s*{name}\s*=\s*"((?:[^"\\]|\\.)*)"', 1), '')"""


TOKENS = rf"""{SRC},
found as (
  select file_path, regexp_extract_all(regexp_replace(content, '{_COMMENT}', '\1', 'g'),
                                       '{_TOKEN}') as l from src),
raw as (select file_path, unnest(l) as token, generate_subscripts(l, 1) - 1 as pos from found),
tok as (
  select file_path, pos::int as pos, token, {_attr("target")} as target,
    case when token like '"%' or token in ('{{', '}}') then null
         when token like '@Mapper%' then 'mapper'
         when token like '@Mapping%' then 'mapping'
         when regexp_matches(token, '^interface\s[^{{]*\{{$') then 'interface'
         when regexp_matches(token, '^class\s[^{{]*\{{$') then 'class'
         when regexp_matches(token, '^\w+\.set\w+\s*\(') then 'setter'
         when regexp_matches(token, '^\w+\.add\s*\(') then 'add'
         when regexp_matches(token, '\)\s+instanceof\s+\w+\s+\w+$') then 'instance'
         when regexp_matches(token, '^\w+\.\w+\s*=') then 'field'
         when regexp_matches(token, '^\w+\s*=') then 'local'
         when regexp_extract(token, '^\w+') in ({_NOT_A_METHOD})
           or regexp_extract(token, '(\w+)\s*\(', 1) in ({_NOT_A_METHOD}) then null
         when token like '%{{' then 'body' else 'declared' end as kind
  from raw),
tk as (select * from tok where kind is not null)"""

SCOPES = rf"""{TOKENS},
pst as (
  select *,
    max(case when kind in ('class','interface') then pos end) over up as decl_pos,
    max(case when kind in ('class','interface','declared','body') then pos end) over up as in_pos,
    min(case when kind in ('class','interface','declared','body') then pos end) over down as next_pos,
    max(case when kind in ('mapper','class','interface') then pos end) over before as mark_pos,
    max(case when kind in ('class','interface','declared','body')
               or (kind = 'mapping' and target is not null) then pos end) over before as near_pos
  from tk
  window up as (partition by file_path order by pos),
         down as (partition by file_path order by pos desc),
         before as (partition by file_path order by pos rows between unbounded preceding
                    and 1 preceding)),
decl as (
  select h.file_path, h.pos as decl_pos, regexp_extract(h.token, '^\w+\s+(\w+)', 1) as decl,
    coalesce(m.kind = 'mapper', false) as in_mapper
  from pst h left join tk m on m.file_path = h.file_path and m.pos = h.mark_pos
  where h.kind in ('class','interface')),
meth as (
  select m.file_path, m.pos as method_pos, m.kind as method_kind, m.decl_pos, d.decl, d.in_mapper,
    regexp_extract(m.token, '^(\w+{_GEN})', 1) as return_type,
    regexp_extract(m.token, '(\w+)\s*\(', 1) as method,
    trim(regexp_extract(m.token, '\((.*)\)\s*[;{{]$', 1, 's')) as params,
    coalesce(a.kind = 'mapping', false) as annotated
  from pst m join decl d on d.file_path = m.file_path and d.decl_pos = m.decl_pos
  left join tk a on a.file_path = m.file_path and a.pos = m.near_pos
  where m.kind in ('declared','body')),
par as (
  select *, regexp_extract_all(regexp_replace(params,
      '@\w+(?:\s*\([^()]*\))?\s*|\bfinal\s+', '', 'g'), '{_PARAM}') as ps from meth),
mth as (
  select * exclude (ps), len(ps) as n_params,
    nullif(regexp_extract(ps[1], '{_PARAM}', 1), '') as type1,
    regexp_extract(ps[1], '{_PARAM}', 2) as name1,
    regexp_extract(ps[2], '{_PARAM}', 1) as type2,
    regexp_extract(ps[2], '{_PARAM}', 2) as name2
  from par)"""

ANNOTATIONS = rf"""{SCOPES},
ann as (
  select a.file_path, a.pos, d.decl as interface, m.method_pos, m.method_kind, m.method,
    m.return_type, m.type1, {_attr("source")} as source, a.target,
    {_attr("expression")} as expression,
    regexp_extract(a.token, 'ignore\s*=\s*(true|false)', 1) = 'true' as ignore
  from pst a join decl d on d.file_path = a.file_path and d.decl_pos = a.decl_pos and d.in_mapper
  left join mth m on m.file_path = a.file_path and m.method_pos = a.next_pos
    and m.decl_pos = a.decl_pos
  where a.kind = 'mapping')"""

STATEMENTS = rf"""{ANNOTATIONS},
st as (
  select s.file_path, s.pos, s.kind, s.token, m.method_pos, m.method, m.return_type,
    m.type1 as source_type, m.name1 as source_var,
    case when m.return_type = 'void' and m.n_params = 2 then m.type2 else m.return_type end
      as target_type,
    case when m.return_type = 'void' and m.n_params = 2 then m.name2 end as target_var
  from pst s join mth m on m.file_path = s.file_path and m.method_pos = s.in_pos
  where m.method_kind = 'body' and m.n_params in (1, 2)
    and regexp_matches(m.method, '^(map|convert|transform|to)')
    and m.return_type not in ('public','private','protected')),
vars as (
  select *,
    case when kind = 'local' then regexp_extract(token, '^(\w+)', 1)
         else regexp_extract(token, '(\w+)$', 1) end as var,
    {path_of("token")} as path
  from st
  where kind in ('local','instance') and source_var =
    case when kind = 'local' then regexp_extract(token, '=\s*(\w+)\.', 1)
         else regexp_extract(token, '^(\w+)\.', 1) end),
last_vars as (
  select file_path, method_pos, var, arg_max(path, pos) as path from vars group by all),
sets as (
  select st.*, regexp_extract(token, '^(\w+)\.', 1) as var,
    {decap(r"regexp_extract(token, '^\w+\.set(\w+)', 1)")} as field,
    trim(regexp_extract(token, '^\w+\.set\w+\s*\((.*)\)$', 1, 's')) as value
  from st where kind = 'setter'),
ksets as (
  select s.*, v.path from sets s left join last_vars v
    on v.file_path = s.file_path and v.method_pos = s.method_pos and v.var = s.value)"""

_OWN = (
    "case when target_var is null then null when {var} = target_var then {field} "
    "else {var} || '.' || {field} end"
)
_KEEP = "file_path, method, source_type, target_type, method_pos, pos"

SETTERS = rf"""{STATEMENTS},
set_map as (
  select {_KEEP}, {decap(r"regexp_extract(value, '^\w+\.get(\w+)', 1)")} as source_field,
    field as target_field, {_OWN.format(var="var", field="field")} as target_path,
    null::varchar as value
  from sets where regexp_matches(value, '^\w+\.get\w+\s*\(\s*\)$')
    and regexp_extract(value, '^(\w+)\.', 1) = source_var)"""

_FIELD_SOURCE = r"regexp_extract(token, '=\s*\w+\.(\w+)', 1)"
DIRECTS = rf"""{SETTERS},
dir_map as (
  select {_KEEP},
    case when token like '%)' and regexp_matches({_FIELD_SOURCE}, '^get\w')
         then {decap(f"substr({_FIELD_SOURCE}, 4)")} else {_FIELD_SOURCE} end as source_field,
    regexp_extract(token, '^\w+\.(\w+)', 1) as target_field,
    {_OWN.format(var=r"regexp_extract(token, '^(\w+)', 1)",
                 field=r"regexp_extract(token, '^\w+\.(\w+)', 1)")} as target_path,
    null::varchar as value
  from st where kind = 'field' and regexp_extract(token, '=\s*(\w+)\.', 1) = source_var)"""

VAR_TARGETS = rf"""{DIRECTS},
var_map as (
  select {_KEEP}, path as source_field, field as target_field,
    {_OWN.format(var="var", field="field")} as target_path, value
  from ksets where path is not null and (target_var is null or var = target_var))"""

_BARE = rf"regexp_replace(value, '{_STR}', '', 'g')"
_CALL = (
    r"regexp_extract(value, '\b' || source_var || "
    r"'\.get\w+\s*\(\s*\)(?:\s*\.get\s*\([^()]*\))?')"
)
VALUE_SOURCE = rf"""case
    when regexp_matches({_BARE}, '\b' || source_var || '\b')
      then case when {_CALL} = '' then 'unknown' else {path_of(_CALL)} end
    when path is not null then path
    when regexp_matches(value, '^[A-Z_][A-Z0-9_]*$') then 'constant:' || value
    when value = '' then 'unknown'
    when value not like 'new %' then value
    else 'constant' end"""

NESTED = rf"""{VAR_TARGETS},
adds as (
  select distinct file_path, method_pos, regexp_extract(token, '^(\w+)\.', 1) as list_var,
    regexp_extract(token, '\(\s*(\w+)\s*\)$', 1) as item_var
  from st where kind = 'add'),
put as (
  select distinct file_path, method_pos, value as list_var, field as outer_field
  from ksets where var = target_var and regexp_matches(value, '^\w+$')),
chk as (
  select p.file_path, p.method_pos, p.outer_field, coalesce(a.item_var, p.list_var) as var,
    a.item_var is not null as is_item
  from put p left join adds a on a.file_path = p.file_path and a.method_pos = p.method_pos
    and a.list_var = p.list_var),
nest as (
  select k.file_path, k.method, k.source_type, k.target_type, k.method_pos, k.pos,
    {VALUE_SOURCE} as source_field,
    c.outer_field || case when is_item then '[].' else '.' end || k.field as target_field,
    k.target_var || '.' || c.outer_field || case when is_item then '[].' else '.' end || k.field
      as target_path,
    k.value as value
  from ksets k join chk c on c.file_path = k.file_path and c.method_pos = k.method_pos
    and c.var = k.var
  where k.target_var is not null)"""

_NONE = "null::varchar"
FM = f"""{NESTED},
fm as (
  select file_path, 'mapstruct' as type, interface, method, coalesce(type1, 'Unknown') as source_type,
    return_type as target_type, source as source_field, target as target_field,
    {_NONE} as target_path, expression, {_NONE} as value, ignore, false as implicit, pos, method_pos
  from ann where target is not null and method_kind = 'declared'
  union all
  select file_path, 'mapstruct', decl, method, type1, return_type, {_NONE}, {_NONE}, {_NONE},
    {_NONE}, {_NONE}, false, true, method_pos, method_pos
  from mth where method_kind = 'declared' and in_mapper and not annotated and type1 is not null
  union all
  select file_path, 'pojo', {_NONE}, method, source_type, target_type, source_field, target_field,
    target_path, {_NONE}, value, false, false, pos, method_pos
  from (select * from set_map union all select * from dir_map union all select * from var_map
        union all select * from nest))"""

_FIELD = (
    "{'expression': nullif(expression, ''), 'ignore': ignore, "
    "'source_field': coalesce(source_field, ''), 'target_field': coalesce(target_field, ''), "
    "'target_path': nullif(target_path, '')}"
)
ENTRIES = f"""{FM},
kept as (
  select * from fm where (source_field <> '' and target_field <> '') or implicit or ignore),
ent as (
  select file_path, type, interface, method, source_type, target_type,
    case when implicit then [] else [{_FIELD}] end as fields, implicit, pos
  from kept where type = 'mapstruct'
  union all
  select file_path, type, interface, method, source_type, target_type,
    list({_FIELD} order by pos, target_field) as fields, false as implicit, method_pos as pos
  from kept where type = 'pojo'
  group by file_path, type, interface, method, source_type, target_type, method_pos)"""

_ARROW = "coalesce(nullif(f.source_field, ''), 'N/A') || ' -> ' || coalesce(nullif(f.target_field, ''), 'N/A')"


def field_lines(indent: str, deeper: str, expression: bool = True, flags: bool = False) -> str:
    line = f"'{indent}' || {_ARROW}"
    if expression:
        line += f" || coalesce(chr(10) || '{deeper}Expression: ' || f.expression, '')"
    if flags:
        line += f" || case when f.ignore then chr(10) || '{deeper}(IGNORED)' else '' end"
    return f"array_to_string(list_transform(fields, lambda f: {line}), chr(10))"


def lines(*parts: str) -> str:
    return "concat_ws(chr(10), " + ", ".join(parts) + ")"


IDS = f"""{ENTRIES},
ided as (
  select *, to_json({{
    'fields': case when len(fields) > 0 then to_json(fields)::varchar else '' end,
    'file': file_path, 'interface': coalesce(interface, ''), 'method': coalesce(method, ''),
    'source_field': '', 'source_type': source_type, 'target_field': '',
    'target_type': target_type, 'type': type}})::varchar as key_json
  from ent)"""

_DOCUMENT = lines(
    "'Mapping Type: ' || type",
    "'Source Type: ' || coalesce(source_type, 'N/A')",
    "'Target Type: ' || coalesce(target_type, 'N/A')",
    "'Interface: ' || nullif(interface, '')",
    "'Method: ' || nullif(method, '')",
    f"case when len(fields) > 0 then 'Field Mappings:' || chr(10) || {field_lines('  ', '    ')} end",
)
MAPPING_RECORDS = f"""{IDS},
mrec as (
  select md5(key_json) as id, file_path, type as mapping_type, coalesce(source_type, '') as source_type,
    coalesce(target_type, '') as target_type, coalesce(interface, '') as interface,
    coalesce(method, '') as method, {_DOCUMENT} as document, pos
  from ided)"""

# --- chunks and hashed vectors -----------------------------------------------------------------


def chunk_records(src: str = "src", name: str = "crec", size: int = 2000) -> str:
    """Records of the code table from a CTE `(file_path, content)`."""
    return f"""{name} as (
  select case when total is null then md5(file_path)
              else md5(file_path) || '_chunk_' || cast(i as varchar) end as id,
    file_path, regexp_extract(file_path, '[^/]*$') as file_name,
    regexp_extract(file_path, '[^./](\\.[^./]+)$', 1) as file_type,
    case when total is not null then i::int end as chunk_index, total::int as total_chunks,
    substr(content, i * {size} + 1, {size}) as document
  from (select file_path, content, unnest(range(0, ceil(length(content) / {size}.0)::bigint)) as i,
          case when length(content) > {size} then ceil(length(content) / {size}.0)::bigint end as total
        from {src} where length(content) > 0))"""


DOC_SRC = f"src as (select doc_id, {DOC_PATH} as file_path, text as content from documents)"

_WORDS = r"regexp_extract_all({t}, '[\p{{L}}\p{{N}}_]+')"


def sparse(src: str, key: str, text: str, name: str) -> str:
    """Hashed vectors as `(key, b, n)` and their lengths as `<name>_len`."""
    words = _WORDS.format(t=text)
    return f"""{name} as (
  select {key}, (('0x' || substr(md5(w), 1, 8))::bigint % 64)::int as b, count(*) as n
  from (select {key}, unnest({words}) as w from {src}) group by all),
{name}_len as (select {key}, sqrt(sum(n * n)) as len from {name} group by all)"""


def sparse_nearest(
    rows: str, row_key: str, queries: str, query_key: str, name: str, k: int
) -> str:
    """Top `k` rows per query between two CTEs made by `sparse`."""
    return f"""{name}_d as (
  select ql.{query_key} as query_id, rl.{row_key} as id,
    round(1 - coalesce(d.dot, 0) / (ql.len * rl.len), 6) + 0.0 as distance
  from {queries}_len ql cross join {rows}_len rl
  left join (select q.{query_key} as qk, r.{row_key} as rk, sum(q.n * r.n) as dot
             from {queries} q join {rows} r on r.b = q.b group by all) d
    on d.qk = ql.{query_key} and d.rk = rl.{row_key}),
{name} as (
  select * from (select *, row_number() over (partition by query_id order by distance, id)::int
                   as rank from {name}_d) where rank <= {k})"""


# --- dense vectors -----------------------------------------------------------------------------

VECTORS = """vec as (select vec_id, label, embedding::double[] as v from embeddings),
cen as (
  select label as query_id, list(x order by p) as v
  from (select label, p, avg(x) as x
        from (select label, unnest(v) as x, generate_subscripts(v, 1) as p from vec) group by all)
  group by label)"""

COSINE = (
    "round(1 - list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * "
    "sqrt(list_dot_product({b}, {b}))), 6) + 0.0"
)


def dense_nearest(rows: str, queries: str, name: str, k: int, id_col: str = "vec_id") -> str:
    distance = COSINE.format(a="q.v", b="r.v")
    return f"""{name} as (
  select * from (
    select query_id, id, distance,
      row_number() over (partition by query_id order by distance, id)::int as rank
    from (select q.query_id, r.{id_col} as id, {distance} as distance from {queries} q, {rows} r))
  where rank <= {k})"""
