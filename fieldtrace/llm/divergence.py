"""How the sources of a language differ in their terms, by hash-consed segment trees.

Terms of a language are dealt to buckets of a bounded number of terms, sources to slices of a bounded
number of sources. Within a bucket a source's counts are the leaves of a segment tree; over all sources,
subtrees with the same counts are one node. Two trees are gone through together, from the roots down; a
pair of nodes met again is priced once. Sums over buckets are left to Spark, as the trees' upper levels.
All numbers are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fieldtrace.llm.common import blocks, table, written
from fieldtrace.session import hold, small

BILLION = 1_000_000_000
MIN_DOCS = 3
TOP_TERMS = 200
BUCKET_TERMS = 8192
SLICE_SOURCES = 64
MERGED = 16  # tasks whose terms are ranked together first
FRONTIER = 1 << 20  # node pairs of a level gone through at once
BLOCK = 4 << 20
ABSENT = -1  # the count of a leaf without a term
# Terms are runs of ASCII letters and of anything that is not ASCII; A-Z become a-z.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


# === counts ====================================================================================


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """`(lang, source, term, n, docs)`: occurrences, and rows that hold the term.

    Nulls count as ''. Every group has a row with a null term besides. Blocks of texts are counted before
    they are shuffled.
    """
    empty = F.lit("")
    given = docs.select(
        *[F.coalesce(F.col(f"`{c}`").cast("string"), empty).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))],
        F.col(f"`{text_col}`").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(batches, "text", BLOCK):
            yield _counted(rows, texts)

    found = given.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _counted(rows: pa.Table, texts: list[bytes]) -> pa.RecordBatch:
    groups = pa.StructArray.from_arrays([rows[c].combine_chunks() for c in ("lang", "source")], ["lang", "source"])
    names = groups.to_pylist()
    number: dict[tuple, int] = {}
    group = np.array([number.setdefault((g["lang"], g["source"]), len(number)) for g in names], dtype=np.int64)
    plain = pa.array([t.translate(_TERM_BYTES) for t in texts], pa.binary()).cast(pa.string())
    words = pc.ascii_split_whitespace(plain)
    codes = words.flatten().dictionary_encode()
    n_terms = len(codes.dictionary) + 1  # an empty text between spaces is a word of none
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy())
    in_row, times = np.unique(row * n_terms + codes.indices.to_numpy(), return_counts=True)
    key, at = np.unique(group[in_row // n_terms] * n_terms + in_row % n_terms, return_inverse=True)
    n = np.bincount(at, weights=times, minlength=len(key)).astype(np.int64)
    in_docs = np.bincount(at, minlength=len(key)).astype(np.int64)
    term = codes.dictionary.take(pa.array(key % n_terms))
    filled = pc.greater(pc.binary_length(term), 0)
    lang, source = (pa.array([g[i] for g in number], pa.string()) for i in (0, 1))
    of, every, none = pa.array(key // n_terms), len(number), pa.array([0] * len(number), pa.int64())
    found = pa.table(
        {"lang": lang.take(of), "source": source.take(of), "term": term, "n": n, "docs": in_docs}
    ).filter(filled)
    marks = pa.table({"lang": lang, "source": source, "term": pa.nulls(every, pa.string()), "n": none, "docs": none})
    return pa.concat_tables([found, marks]).combine_chunks().to_batches()[0]


# === trees =====================================================================================


def proportion(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / total), in three steps of a thousand so that nothing overflows."""
    rest, found = count.astype(np.int64) + 1, np.zeros(count.shape, dtype=np.int64)
    for _ in range(3):
        rest = rest * 1000
        found = found * 1000 + rest // total
        rest = rest % total
    return found + 1


class Forest:
    """Segment trees over rows of counts, hash-consed level by level: equal subtrees are one node.

    `counts` has a tree per row and a power of two of leaves. A node of the lowest level is a number of
    `values`, one of a higher level a row of `children[level]`; `roots` has the top node of each tree.
    """

    def __init__(self, counts: np.ndarray):
        self.values, nodes = np.unique(counts, return_inverse=True)
        nodes = nodes.reshape(counts.shape)
        self.children: list[np.ndarray] = []
        while nodes.shape[1] > 1:
            n = int(nodes.max(initial=0)) + 1
            made, at = np.unique(nodes[:, 0::2] * n + nodes[:, 1::2], return_inverse=True)
            self.children.append(np.stack([made // n, made % n], axis=1))
            nodes = at.reshape(len(nodes), -1)
        self.roots = nodes[:, 0]


def priced(forest: Forest, a: np.ndarray, b: np.ndarray, totals: list[int]) -> tuple[np.ndarray, np.ndarray, tuple]:
    """For pairs of trees the sums of floor((p-q)^2 / q) and floor((p-q)^2 / p) over all leaves.

    Goes down through both trees of all pairs at once; on every level a pair of nodes stands once for each
    pair of trees. Also returns what each leaf pair costs: (pair of trees, value of a, value of b, price).
    """
    pair, x, y = np.arange(len(a)), forest.roots[a], forest.roots[b]
    steps = []
    for below in reversed(forest.children):
        n = int(below.max(initial=0)) + 1
        # Children of all node pairs, each met pair once.
        both = [(pair * n + below[x, side]) * n + below[y, side] for side in (0, 1)]
        met, at = np.unique(np.concatenate(both), return_inverse=True)
        steps.append(at.reshape(2, -1))
        pair, x, y = met // (n * n), met // n % n, met % n
    # Leaves: each distinct count of a tree has one proportion.
    value = forest.values
    shares = {t: proportion(np.maximum(value, 0), totals[t]) for t in np.unique(np.concatenate([a, b]))}
    table_ = np.stack([shares[t] for t in sorted(shares)]) if shares else np.ones((0, len(value)), np.int64)
    place = {t: i for i, t in enumerate(sorted(shares))}
    of_a, of_b = (np.array([place[t] for t in side], dtype=np.int64) for side in (a, b))
    p, q = table_[of_a[pair], x], table_[of_b[pair], y]
    there = (value[x] != ABSENT).astype(np.int64)
    square = (p - q) * (p - q) * there
    ab, ba = square // q, square // p
    leaves = (pair, x, y, ab, p > q)
    for left, right in reversed(steps):
        ab, ba = ab[left] + ab[right], ba[left] + ba[right]
    return ab, ba, leaves


def _cell(rows: pa.Table, top: int) -> pa.Table:
    """Prices of one bucket of terms: pairs of sources of two slices, and terms of sources of one."""
    sa, sb = rows["sa"][0].as_py(), rows["sb"][0].as_py()
    is_mark = pc.is_null(rows["term"])
    marks, found = rows.filter(is_mark), rows.filter(pc.invert(is_mark))
    sources = marks["source"].to_pylist()
    slices = marks["slice"].to_numpy()
    term = found["term"].combine_chunks().dictionary_encode()
    source_at = pc.index_in(found["source"], marks["source"].combine_chunks()).to_numpy()
    n_terms = len(term.dictionary)
    counts = np.zeros((len(sources) + 1, n_terms), dtype=np.int64)  # the last row is the language
    code = term.indices.to_numpy()
    counts[source_at, code] = found["n"].to_numpy()
    counts[-1, code] = found["lang_n"].to_numpy()
    # Frequent terms first, so that rare ones make large empty subtrees.
    by_name = np.empty(n_terms, dtype=np.int64)
    by_name[pc.array_sort_indices(term.dictionary.cast(pa.binary())).to_numpy()] = np.arange(n_terms)
    order = np.lexsort((by_name, -counts[-1]))
    leaves = np.full((len(sources) + 1, 1 << max(0, n_terms - 1).bit_length()), ABSENT, dtype=np.int64)
    leaves[:, :n_terms] = counts[:, order]
    forest = Forest(leaves)
    v = marks["v"][0].as_py()
    totals = [n + v for n in [*marks["total"].to_pylist(), marks["lang_total"][0].as_py()]]

    parts = []
    first, second = np.flatnonzero(slices == sa), np.flatnonzero(slices == sb)
    if sa == sb:
        i, j = np.triu_indices(len(first), 1)
        a, b = first[i], first[j]
    else:
        a, b = np.repeat(first, len(second)), np.tile(second, len(first))
    if v == 0:
        totals = [1] * len(totals)  # no leaf has a price
    step = max(1, FRONTIER // leaves.shape[1])
    for at in range(0, len(a), step):
        x, y = a[at : at + step], b[at : at + step]
        ab, ba, _ = priced(forest, x, y, totals)
        parts += [("pair", x, y, ab), ("pair", y, x, ba)]
    made = {"source": [], "part": [], "item": [], "value": []}
    for part, x, y, value in parts:
        made["source"] += [sources[i] for i in x]
        made["part"] += [part] * len(x)
        made["item"] += [sources[i] for i in y]
        made["value"] += value.tolist()
    if sa == sb:
        names = term.dictionary.to_pylist()
        for at in range(0, len(first), step):
            x = first[at : at + step]
            _, _, (pair, na, nb, price, more) = priced(forest, x, np.full(len(x), len(sources)), totals)
            n_values = len(forest.values)
            keys = (pair * n_values + na) * n_values + nb
            ids = np.searchsorted(forest.values, counts)
            for i, source in enumerate(x):
                held = np.flatnonzero(counts[source] > 0)
                leaf = np.searchsorted(keys, (i * n_values + ids[source, held]) * n_values + ids[-1, held])
                held, cost = held[more[leaf]], price[leaf][more[leaf]]
                best = np.lexsort((by_name[held], -cost))[:top]
                made["source"] += [sources[source]] * len(best)
                made["part"] += ["term"] * len(best)
                made["item"] += [names[t] for t in held[best]]
                made["value"] += cost[best].tolist()
    n = len(made["value"])
    return pa.table({"lang": pa.array([rows["lang"][0].as_py()] * n, pa.string()),
                     **{c: pa.array(made[c], pa.int64() if c == "value" else pa.string()) for c in made}})


# === the operator ==============================================================================


def audit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_docs: int = MIN_DOCS,
    top: int = TOP_TERMS,
    bucket_terms: int = BUCKET_TERMS,
    slice_sources: int = SLICE_SOURCES,
) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from each other and from its language.

    Null texts, languages and sources count as ''; repeated rows count as often as they stand there. A
    language's terms are those in at least `min_docs` of its rows; without any, sources differ by 0. A
    language with one source has no pairs. One task holds a bucket of about `bucket_terms` terms for two
    slices of about `slice_sources` sources.
    """
    per_term = Window.partitionBy("lang", "term")
    counted = term_counts(docs, text_col, lang_col, source_col)
    spread = counted.withColumn("lang_docs", F.sum("docs").over(per_term)).withColumn("lang_n", F.sum("n").over(per_term))
    first = F.col("source") == F.min("source").over(per_term)
    kept = written(
        spread.withColumn("first", first)
        .where(F.col("term").isNull() | (F.col("lang_docs") >= min_docs))
        .select("lang", "source", "term", "n", "lang_n", "first"),
        "terms",
    )
    is_term = F.col("term").isNotNull()
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(
        F.sum("n").alias("lang_total"),
        F.count_if(is_term & F.col("first")).alias("v"),
        F.count_if(~is_term).alias("n_sources"),
    )
    langs = small(
        hold(
            langs.select(
                "lang", "lang_total", "v",
                F.greatest(F.lit(1), F.ceil(F.col("v") / bucket_terms)).cast("int").alias("n_buckets"),
                F.ceil(F.col("n_sources") / slice_sources).cast("int").alias("n_slices"),
            )
        )
    )

    def sliced(rows: DataFrame) -> DataFrame:
        """Rows for every pair of slices that theirs is one of."""
        own = F.pmod(F.xxhash64("source"), F.col("n_slices")).cast("int")
        with_ = F.explode(F.sequence(F.lit(0), F.col("n_slices") - 1))
        return rows.withColumn("slice", own).withColumn("other", with_).select(
            "*", F.least("slice", "other").alias("sa"), F.greatest("slice", "other").alias("sb")
        )

    columns = ["lang", "bucket", "sa", "sb", "source", "slice", "term", "n", "lang_n", "total", "lang_total", "v"]
    null = F.lit(None).cast("long")
    counts = sliced(kept.where(is_term).join(langs, "lang")).select(
        F.pmod(F.xxhash64("term"), F.col("n_buckets")).cast("int").alias("bucket"),
        "lang", "sa", "sb", "source", "slice", "term", "n", "lang_n", null.alias("total"), null.alias("lang_total"),
        null.alias("v"),
    ).select(columns)
    marks = sliced(groups.join(langs, "lang")).select(
        F.explode(F.sequence(F.lit(0), F.col("n_buckets") - 1)).alias("bucket"),
        "lang", "sa", "sb", "source", "slice", F.lit(None).cast("string").alias("term"), null.alias("n"),
        null.alias("lang_n"), "total", "lang_total", "v",
    ).select(columns)
    cells = counts.unionByName(marks).groupBy("lang", "bucket", "sa", "sb")
    priced_ = cells.applyInArrow(
        lambda rows: _cell(rows, top), "lang string, source string, part string, item string, value long"
    )
    priced_ = written(priced_, "prices")
    pairs = (
        priced_.where("part = 'pair'")
        .groupBy("lang", "source", "part", "item")
        .agg(F.sum("value").alias("value"))
        .withColumn("rank", F.row_number().over(_order("lang", "source")))
    )
    # A term is in one bucket. Buckets of some tasks are cut together first, so that the last cut of a
    # source does not grow with the tasks.
    tasks = (F.spark_partition_id() / MERGED).cast("int")
    first_cut = _cut(priced_.where("part = 'term'").withColumn("tasks", tasks), top, "lang", "source", "tasks")
    return pairs.unionByName(_cut(first_cut.drop("tasks", "rank"), top, "lang", "source"))


def _order(*keys: str):
    return Window.partitionBy(*keys).orderBy(F.desc("value"), "item")


def _cut(rows: DataFrame, top: int, *keys: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(_order(*keys))).where(F.col("rank") <= top)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = r"""
with d as (
    select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'
        ) as terms
    from documents
), t as (select id, lang, source, unnest(terms) as term from d),
k as (select lang, term, count(*) as lang_n from t group by all having count(distinct id) >= 3),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from t semi join k using (lang, term) group by all),
l as (select lang, count(*) as v, sum(lang_n)::hugeint as total from k group by lang),
s as (select g.lang, g.source, coalesce(sum(n), 0)::hugeint as total from g left join c using (lang, source) group by all),
p as (
    select s.lang, s.source, k.term, coalesce(n, 0) as n,
        1 + 1000000000::hugeint * (coalesce(n, 0) + 1) // (s.total + l.v) as p,
        1 + 1000000000::hugeint * (lang_n + 1) // (l.total + l.v) as q
    from s join l using (lang) join k using (lang) left join c on c.lang = s.lang and c.source = s.source and c.term = k.term
), pairs as (
    select a.lang, a.source, 'pair' as part, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint as value
    from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), every as (
    select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
    from g a join g b on a.lang = b.lang and a.source <> b.source
    left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
    union all
    select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint from p where n > 0 and p > q
)
select *, (row_number() over (partition by lang, source, part order by value desc, item))::integer as rank from every
qualify part = 'pair' or rank <= 200
"""
