"""Secrets in texts: patterns, and strings that look random rather than like identifiers.

Two Markov models of characters, one of random strings and one of ordinary identifiers, are counted over
the whole corpus: the values that the patterns find are the samples of the first, other long tokens
those of the second. A token is taken for a secret if the first model makes it likelier by a margin.
Only DataFrame functions touch the texts; the models are tables of a fixed size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldtrace.llm.common import table, without

# Kinds in their order, their patterns, and how long a match must be (of `assign`, its value).
KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
LEAST = {"assign": 6, "access": 20, "hex": 24}
# Runs of characters are found by their length as well: a run is matched from its start or not at all.
RUNS = {kind: PATTERNS[kind] for kind in KINDS} | {
    "hex": f"(?<![0-9a-f])[0-9a-f]{{{LEAST['hex']},}}"
}
TEXT = "\0text"
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

MODEL_KIND = "markov"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = "[A-Za-z0-9+/_=-]"
SAMPLE_CHARS, TOKEN_CHARS = 12, 16
BACKOFF = 500.0  # so that a few unlabelled secrets among the ordinary tokens do not vouch for themselves
MARGIN = 14.0  # log-likelihood ratio: odds of about a million to one

SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _run(least: int) -> str:
    return f"(?<!{TOKEN}){TOKEN}{{{least},}}"


def _may_have(text: Column, kind: str) -> Column:
    """A quick test that every text with a match of the kind passes, and few others."""
    if kind == "assign":
        low = F.lower(text)
        found = low.contains(KEYWORDS[0])
        for word in KEYWORDS[1:]:
            found = found | low.contains(word)
        return found
    return text.contains("AKIA") if kind == "access" else text.rlike(RUNS["hex"])


def _flagged(docs: DataFrame, text_col: str) -> DataFrame:
    """`docs` with the text (null as empty) and the quick tests as columns, worked out once."""
    named = docs.withColumn(TEXT, F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    return named.select("*", *[_may_have(F.col(TEXT), kind).alias(_flag(kind)) for kind in KINDS])


def _flag(kind: str) -> str:
    return f"\0may_{kind}"


# === spans =====================================================================================


def _starts(pieces: Column, matches: Column) -> Column:
    """Where the matches start, from the pieces around them, in code points."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    pairs = F.zip_with(
        F.slice(pieces, F.lit(1), F.size(matches)),
        matches,
        lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size")),
    )
    return F.aggregate(
        pairs,
        zero,
        lambda done, x: F.struct(
            (done["at"] + x["gap"] + x["size"]).alias("at"),
            F.array_append(done["starts"], done["at"] + x["gap"]).alias("starts"),
        ),
        lambda done: done["starts"],
    )


def _spans(text: Column, pattern: str, kind: str, rank: int, measure: Column, least: int) -> Column:
    """All matches whose measure (a text for each) has `least` characters."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    starts = _starts(F.split(text, pattern, -1), matches)
    rows = F.zip_with(
        F.zip_with(starts, matches, lambda s, m: F.struct(s.alias("s"), m.alias("m"))),
        measure,
        lambda x, v: F.struct(
            x["s"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
            (x["s"] + F.length(x["m"])).alias("end"), F.length(v).alias("measure"),
        ),
    )
    long = F.filter(rows, lambda x: x["measure"] >= least)
    return F.transform(
        long,
        lambda x: F.struct(
            x["start"].alias("start"), x["rank"].alias("rank"), x["kind"].alias("kind"), x["end"].alias("end")
        ),
    )


def _where(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.array().cast(SPAN))


def base_spans(kind: str) -> Column:
    """Leftmost matches of a kind in a flagged row that do not overlap; those too short are dropped."""
    text = F.col(TEXT)
    pattern, least = RUNS[kind], LEAST[kind]
    measure = F.regexp_extract_all(text, F.lit(pattern), F.lit(2 if kind == "assign" else 0))
    spans = _spans(text, pattern, kind, KINDS.index(kind), measure, least)
    return _where(F.col(_flag(kind)), spans)


# === models ====================================================================================


def _without_base() -> Column:
    rest = F.col(TEXT)
    for kind in KINDS:
        rest = F.when(F.col(_flag(kind)), F.regexp_replace(rest, RUNS[kind], " ")).otherwise(rest)
    return rest


def _samples() -> Column:
    """Tokens of a flagged row with their class: 1 random, 0 ordinary."""
    text = F.col(TEXT)
    values = [
        F.when(
            F.col(_flag(kind)),
            F.regexp_extract_all(text, F.lit(RUNS[kind]), F.lit(2 if kind == "assign" else 0)),
        )
        for kind in KINDS
    ]
    none = F.array().cast("array<string>")
    random = F.concat(*[F.coalesce(v, none) for v in values])
    random = F.filter(random, lambda v: F.length(v) >= SAMPLE_CHARS)
    ordinary = F.regexp_extract_all(_without_base(), F.lit(_run(SAMPLE_CHARS)), F.lit(0))
    label = lambda to: lambda v: F.struct(F.lit(to).alias("random"), v.alias("token"))
    return F.concat(F.transform(random, label(1)), F.transform(ordinary, label(0)))


def ratios(docs: DataFrame, text_col: str = "text") -> list[float]:
    """Log-likelihood ratios of all pairs of characters, the first of 0 for the start of a token.

    Entry (a, b) is at a * (letters + 1) + b. Counts are taken over all rows; where a first character
    was seen little, the frequencies of the second count as BACKOFF pairs more. Without samples of
    both classes all ratios are 0.
    """
    flagged = _flagged(docs.select(F.col(f"`{text_col}`").alias("text")), "text")
    # An inner explode would be guarded by a filter that works out the array once more.
    sample = flagged.select(F.explode_outer(_samples()).alias("s")).select("s.random", "s.token")
    sample = sample.where(F.col("random").isNotNull())
    pairs = F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.substring(F.concat(F.lit("^"), "token"), i, F.lit(2)))
    counts = sample.select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").count()
    n = len(ALPHABET)
    seen = [[[0.0] * (n + 1) for _ in range(n + 1)] for _ in (0, 1)]
    classes = set()
    # At most one row for each class and pair of the alphabet.
    for random, pair, count in counts.collect():
        a, b = ALPHABET.find(pair[0]) + 1, ALPHABET.find(pair[1]) + 1
        if b:
            seen[random][a][b] += count
            classes.add(random)
    if len(classes) < 2:
        return [0.0] * (n + 1) ** 2
    log = []
    for rows in seen:
        single = [1 + sum(row[b] for row in rows) for b in range(n + 1)]
        share = [x / sum(single[1:]) for x in single]
        log.append(
            [[math.log((x + BACKOFF * p) / (sum(row) + BACKOFF)) for x, p in zip(row, share, strict=True)] for row in rows]
        )
    return [log[1][a][b] - log[0][a][b] if b else 0.0 for a in range(n + 1) for b in range(n + 1)]


def score(token: Column, table_: list[float]) -> Column:
    """The log-likelihood ratio of a token of the alphabet."""
    known = F.split(F.lit(",".join(f"{x:.6f}" for x in table_)), ",").cast("array<double>")
    zero = F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("sum"))

    def add(done: Column, i: Column) -> Column:
        now = F.position(F.substring(token, i, F.lit(1)), F.lit(ALPHABET))
        return F.struct(
            now.alias("before"),
            (done["sum"] + F.element_at(known, done["before"] * (len(ALPHABET) + 1) + now + 1)).alias("sum"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.length(token)), zero, add, lambda done: done["sum"])


# === the operator ==============================================================================


def find_secrets(docs: DataFrame, text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """`docs` with spans: an array of (start, rank, kind, end) in order of start and kind.

    Places are code points, the end exclusive. Null texts count as empty and have none. Spans of the
    kind `markov` are whole tokens of at least TOKEN_CHARS characters that touch no other span. A column
    named spans gives way. Repeated rows count each time in the models.
    """
    text = F.col(TEXT)
    others = [F.col(f"`{c}`") for c in without(docs, "spans")]
    table_ = ratios(docs, text_col)
    base = F.concat(*[base_spans(kind) for kind in KINDS])
    pattern = _run(TOKEN_CHARS)
    tokens = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.zip_with(
        _starts(F.split(text, pattern, -1), tokens),
        tokens,
        lambda s, t: F.struct(s.alias("start"), (s + F.length(t)).alias("end"), t.alias("token")),
    )
    none = F.array().cast("array<struct<start:int,end:int,token:string>>")
    rows = F.when(text.rlike(pattern), rows).otherwise(none)
    found = _flagged(docs, text_col).select(*others, F.array_sort(base).alias("\0base"), rows.alias("\0tokens"))

    def free(x: Column) -> Column:
        return ~F.exists("\0base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))

    added = F.filter("\0tokens", lambda x: (score(x["token"], table_) > margin) & free(x))
    added = F.transform(
        added,
        lambda x: F.struct(
            x["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), F.lit(MODEL_KIND).alias("kind"),
            x["end"].alias("end"),
        ),
    )
    return found.select(*others, F.array_sort(F.concat("\0base", added)).alias("spans"))


def _joined(spans: Column) -> Column:
    each = F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.concat_ws(",", each)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["rank"] < len(KINDS))
    return found.select(
        "doc_id",
        *[count(kind) for kind in (*KINDS, MODEL_KIND)],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
