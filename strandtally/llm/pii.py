"""Personal data by bootstrapped contextual extraction (operator 6), in DataFrame operations only.

Base patterns find e-mail and IP addresses, card and phone numbers. Each such
span is a seed, and induces lexical patterns of three sorts: the two words
before it, the word on either side, the two words after it. Patterns and the
identifier-like tokens that stand in them form a graph, in which scores go back
and forth until they settle: a pattern is as good as the share of its
occurrences that are known or likely identifiers of a kind; a token is as
likely as its best pattern of the same sort other than the one that is being
judged, times ``trust``. So no pattern speaks for itself, neither directly nor
by another sort of pattern at the same place. Patterns with enough distinct
seeds and a high score give spans that no base pattern matches. Base spans
always stay.

Positions come from splitting a text at the matches: the lengths of what lies
between and of the matches add up to starts and ends in code points, block by
block, so that long texts with many matches take time in proportion.

Edge cases: a null text counts as empty and has no spans; repeated rows are
treated one by one; numbers of any length are matched without recursion. A
context word is what of it lies within ``reach`` characters of the token. Of
patterns equal in score the last in alphabetical order of kinds decides. An
empty table gives an empty one; columns of the input may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import free_prefix, stored

KINDS = ("email", "ip", "card", "phone")

# Each pattern matches what the plain form in its comment does. A name or a label is taken whole
# or not at all, so that a long run of such characters is read once, not once from each position.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-](?:[A-Za-z0-9.-](?<!\.(?![A-Za-z0-9-])))*+",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([ -]?[0-9])+
    "card": r"[0-9](?:[0-9 -](?<![ -](?![0-9])))++",
    # \+[0-9][ ().0-9-]+[0-9]
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must have for a pattern to be tried.
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]"}
#: A token that could be an identifier: it has a digit or an @.
_TOKEN = r"(?<![^ \t-\r])[^ \t-\r0-9@]*+[0-9@][^ \t-\r]*+"
#: How a token must look to become a span of a kind.
_SHAPES = {
    "email": r"^[^@]+@[^@]+$",
    "ip": r"^(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}$|^[0-9]{1,3}(?:[.\-][0-9]{1,3}){3}$",
    "card": r"^[0-9][0-9-]{6,22}[0-9]$",
    "phone": r"^\(?[0-9][0-9().\-/]{5,18}[0-9]$",
}


#: Texts with added spans up to which these are broadcast; more are shuffled.
MOST_BROADCAST = 20_000


@dataclass(frozen=True)
class PiiRules:
    """min_seeds: distinct seeds of a pattern that is used. least: its least score. trust: what a likely identifier
    counts for, next to a known one; as it is below 1, scores settle. settled: largest change of a score in the last round.
    reach: characters on either side of a token in which context words are looked for, below CHUNK."""

    min_seeds: int = 4
    least: float = 0.7
    trust: float = 0.5
    settled: float = 1e-4
    reach: int = 200


_NONE = "cast(array() AS array<struct<s:int,e:int,m:string>>)"
_BLOCK = 256
#: Characters of the parts that a text is cut into where places in it are looked up.
CHUNK = 1024


def _sql_string(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def blocks(array: str) -> str:
    """SQL for an array cut into blocks."""
    return f"transform(array({array}), v -> transform(sequence(0, greatest(0, (size(v) - 1) DIV {_BLOCK})), b -> slice(v, cast(b AS int) * {_BLOCK} + 1, {_BLOCK})))[0]"


def spans_of(text: str, pattern: str) -> str:
    """SQL for the matches of a pattern in a column: array of (s, e, m), positions in code points.

    Blocks are summed first, then each goes on from the sum before it, so that arrays stay short while they grow."""
    p = _sql_string(pattern)
    found = f"regexp_extract_all({text}, {p}, 0)"
    pairs = f"zip_with(slice(split({text}, {p}, -1), 1, size({found})), {found}, (g, m) -> struct(length(g) AS g, m AS m))"
    sums = "aggregate(transform(u, b -> aggregate(b, 0, (a, x) -> a + x.g + length(x.m))), array(0), (a, x) -> concat(a, array(element_at(a, -1) + x)))"
    return f"""transform(transform(array({blocks(pairs)}), u -> struct(u AS u, {sums} AS at)), w -> flatten(transform(w.u, (block, i) ->
        aggregate(block, struct(w.at[i] AS p, {_NONE} AS found),
            (c, x) -> struct(c.p + x.g + length(x.m) AS p, concat(c.found, array(struct(c.p + x.g AS s, c.p + x.g + length(x.m) AS e, x.m AS m))) AS found),
            c -> c.found))))[0]"""


def chunks_of(text: str) -> str:
    return f"regexp_extract_all({text}, '(?s).{{1,{CHUNK}}}', 0)"


def before(chunks: str, at: str, reach: int) -> str:
    """SQL for the characters before a place."""
    return f"right(concat(coalesce(get({chunks}, cast({at} DIV {CHUNK} AS int) - 1), ''), left(coalesce(get({chunks}, cast({at} DIV {CHUNK} AS int)), ''), {at} % {CHUNK})), {reach})"


def after(chunks: str, at: str, reach: int) -> str:
    """SQL for the characters from a place on."""
    return f"substr(concat(coalesce(get({chunks}, cast({at} DIV {CHUNK} AS int)), ''), coalesce(get({chunks}, cast({at} DIV {CHUNK} AS int) + 1), '')), {at} % {CHUNK} + 1, {reach})"


def piece(chunks: str, a: str, b: str) -> str:
    """SQL for the characters from a to b."""
    return f"CASE WHEN {b} > {a} THEN substr(array_join(slice({chunks}, cast({a} DIV {CHUNK} AS int) + 1, cast(({b} - 1) DIV {CHUNK} - {a} DIV {CHUNK} AS int) + 1), ''), {a} % {CHUNK} + 1, {b} - {a}) ELSE '' END"


_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
_FINE = {
    "email": "true",
    "ip": "forall(split(x.m, '[.]'), p -> length(ltrim('0', p)) <= 3 AND cast(concat('0', right(ltrim('0', p), 3)) AS int) <= 255)",
    "card": f"""length({_DIGITS}) BETWEEN 13 AND 19 AND
        aggregate(sequence(1, least(19, length({_DIGITS}))), 0L, (a, i) -> a +
            CASE WHEN i % 2 = 1 THEN cast(substr(reverse({_DIGITS}), i, 1) AS int)
                 ELSE (2 * cast(substr(reverse({_DIGITS}), i, 1) AS int)) % 10 + (2 * cast(substr(reverse({_DIGITS}), i, 1) AS int)) DIV 10 END) % 10 = 0""",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}


def base_spans(kind: str, text: str) -> Column:
    hint = f"contains({text}, '@')" if kind == "email" else f"{text} rlike {_sql_string(_HINTS[kind])}"
    return F.expr(f"CASE WHEN {hint} THEN filter({spans_of(text, PATTERNS[kind])}, x -> {_FINE[kind]}) ELSE {_NONE} END")


def patterns(chunks: str, s: str, e: str, reach: int) -> str:
    """SQL for the patterns around a token, in lower case and with digits alike; a sort that lacks a word gives none."""
    clean = lambda x: f"regexp_replace(lower({x}), '[0-9]', '9')"
    word = "[^ \\\\t-\\\\r]+"
    space = "[ \\\\t-\\\\r]"
    two_before, two_after = f"({word}){space}+({word}){space}*$", f"^{space}*({word}){space}+({word})"
    one_before, one_after = f"({word}){space}*$", f"^{space}*({word})"
    take = lambda of, pattern, k: f"regexp_extract({of}, '{pattern}', {k})"
    pair = lambda sort, a, b: f"CASE WHEN {a} <> '' AND {b} <> '' THEN concat('{sort} ', {a}, ' ', {b}) END"
    made = ", ".join([
        pair("before", take("c.l", two_before, 1), take("c.l", two_before, 2)), pair("around", take("c.l", one_before, 1), take("c.r", one_after, 1)), pair("after", take("c.r", two_after, 1), take("c.r", two_after, 2)),
    ])
    return f"transform(array(struct({clean(before(chunks, s, reach))} AS l, {clean(after(chunks, e, reach))} AS r)), c -> filter(array({made}), y -> y IS NOT NULL))[0]"


def with_base(docs: DataFrame, rules: PiiRules = PiiRules(), prefix: str = "__pii_") -> DataFrame:
    """``docs`` with a row number, the base spans of each kind, and what stands in patterns: seeds and other tokens.

    Tokens that overlap a base span are still among the others."""
    p, t = prefix, prefix + "text"
    docs = docs.withColumns({p + "row": F.monotonically_increasing_id(), t: F.coalesce(F.col("text").cast("string"), F.lit(""))})
    docs = docs.withColumns({p + k: base_spans(k, t) for k in KINDS})
    docs = docs.withColumn(p + "other", F.expr(f"CASE WHEN {t} rlike '[0-9@]' THEN {spans_of(t, _TOKEN)} ELSE {_NONE} END"))
    # a token's own punctuation at its ends isn't part of a span
    tail = "regexp_replace(x.m, '^[^0-9A-Za-z(]++', '')"
    core = f"regexp_replace({tail}, '[^0-9A-Za-z]++$', '')"
    docs = docs.withColumn(p + "other", F.expr(f"transform({p}other, x -> struct(x.e - length({tail}) AS s, x.e - length({tail}) + length({core}) AS e, {core} AS m))"))
    docs = docs.withColumn(p + "chunks", F.expr(f"CASE WHEN size({p}other) > 0 THEN {chunks_of(t)} END"))
    each = [*(f"transform({p}{k}, x -> struct('{k}' AS kind, x.s AS s, x.e AS e, x.m AS m))" for k in KINDS), f"transform({p}other, x -> struct(cast(NULL AS string) AS kind, x.s AS s, x.e AS e, x.m AS m))"]
    seen = f"transform(filter(concat({', '.join(each)}), x -> x.m <> ''), x -> struct(x.kind AS kind, x.s AS s, x.e AS e, lower(x.m) AS m, {patterns(p + 'chunks', 'x.s', 'x.e', rules.reach)} AS patterns))"
    return docs.withColumn(p + "seen", F.expr(seen)).withColumns({p + k: F.expr(f"transform({p}{k}, x -> struct(x.s AS s, x.e AS e))") for k in KINDS}).drop(t, p + "other", p + "chunks")


def scored_patterns(edges: DataFrame, rules: PiiRules) -> DataFrame:
    """(pattern, kind, p, seeds) of a graph of (pattern, m, seed, n): settled scores, none of which rests on itself.

    Each round takes the scores of the one before; as a change shrinks by ``trust`` from round to round, they settle."""
    sort = F.substring_index("pattern", " ", 1)
    total = edges.groupBy("pattern").agg(F.sum("n").alias("all"))
    own = edges.filter("seed IS NOT NULL").groupBy("pattern", F.col("seed").alias("kind")).agg(F.sum("n").alias("own"), F.count("*").alias("seeds"))
    known = edges.filter("seed IS NOT NULL").select("m", F.col("seed").alias("known")).distinct()  # identifiers seen as seeds anywhere
    fixed = edges.filter("seed IS NULL").join(known, "m")
    fixed = fixed.groupBy("pattern", F.col("known").alias("kind")).agg(F.sum("n").alias("own"), F.lit(0).cast("long").alias("seeds"))
    sure = stored(own.unionByName(fixed).groupBy("pattern", "kind").agg(F.sum("own").alias("own"), F.sum("seeds").alias("seeds")).join(total, "pattern"), "pii-sure")
    loose = stored(edges.filter("seed IS NULL").join(known.select("m").distinct(), "m", "left_anti").select("pattern", "m", "n", sort.alias("sort")), "pii-loose")
    good, change = sure.select("pattern", "kind", "seeds", (F.col("own") / F.col("all")).alias("p")), 1.0
    best = Window.partitionBy("m", "sort", "kind").orderBy(F.col("p").desc(), "pattern")
    while change > rules.settled:
        ranked = loose.join(good.select("pattern", "kind", "p"), "pattern").withColumn("rank", F.row_number().over(best)).filter("rank <= 2")
        top = ranked.groupBy("m", "sort", "kind").agg(F.max("p").alias("p1"), F.max(F.when(F.col("rank") == 2, F.col("p"))).alias("p2"), F.max(F.when(F.col("rank") == 1, F.col("pattern"))).alias("of"))
        likely = loose.join(top, ["m", "sort"]).select("pattern", "kind", (F.col("n") * rules.trust * F.when(F.col("of") == F.col("pattern"), F.coalesce("p2", F.lit(0.0))).otherwise(F.col("p1"))).alias("hit"))
        hits = likely.groupBy("pattern", "kind").agg(F.sum("hit").alias("hit"))
        both = sure.select("pattern", "kind", "own", "seeds").join(hits, ["pattern", "kind"], "full").join(total, "pattern")
        new = both.select("pattern", "kind", F.coalesce("seeds", F.lit(0)).alias("seeds"), ((F.coalesce("own", F.lit(0)) + F.coalesce("hit", F.lit(0.0))) / F.col("all")).alias("p"))
        new = stored(new.filter("p > 0"), "pii-patterns")
        was = good.select("pattern", "kind", F.col("p").alias("was"))
        change = new.join(was, ["pattern", "kind"], "left").agg(F.max(F.col("p") - F.coalesce("was", F.lit(0.0)))).first()[0] or 0.0
        good = new
    return good


def discovered(base: DataFrame, rules: PiiRules = PiiRules(), prefix: str = "__pii_") -> DataFrame:
    """(row, kind, s, e) of the spans that the graph adds; ``base`` can be read again."""
    row = prefix + "row"
    seen = base.filter(F.size(prefix + "seen") > 0).select(F.col(row).alias("row"), F.explode(prefix + "seen").alias("x")).select("row", "x.*")
    placed = seen.select("row", "kind", "s", "e", "m", F.explode("patterns").alias("pattern"))
    seeds = placed.filter("kind IS NOT NULL")
    seeded = stored(seeds.groupBy("pattern").agg(F.countDistinct("m").alias("seeds")).filter(F.col("seeds") >= rules.min_seeds).select("pattern"), "pii-seeded")
    tokens = stored(placed.filter("kind IS NULL").join(seeded, "pattern", "left_semi"), "pii-tokens")
    # tokens that overlap a base span go: the greatest end before each, and the least start after it, both by running windows
    spans = seen.filter("kind IS NOT NULL").select("row", "s", "e").join(tokens.select("row").distinct(), "row", "left_semi")
    every = spans.withColumn("base", F.lit(True)).unionByName(tokens.select("row", "s", "e").distinct().withColumn("base", F.lit(False)))
    up = Window.partitionBy("row").orderBy("s", F.col("base").desc()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("row").orderBy(F.col("s").desc(), F.col("base").desc()).rowsBetween(Window.unboundedPreceding, 0)
    every = every.withColumn("end", F.max(F.when(F.col("base"), F.col("e"))).over(up)).withColumn("start", F.min(F.when(F.col("base"), F.col("s"))).over(down))
    free = every.filter(~F.col("base") & ~F.coalesce(F.col("end") > F.col("s"), F.lit(False)) & ~F.coalesce(F.col("start") < F.col("e"), F.lit(False))).select("row", "s", "e")
    tokens = stored(tokens.join(free, ["row", "s", "e"], "left_semi"), "pii-free")
    edges = seeds.join(seeded, "pattern", "left_semi").unionByName(tokens).groupBy("pattern", "m").agg(F.max("kind").alias("seed"), F.count("*").alias("n"))
    use = scored_patterns(stored(edges, "pii-graph"), rules).filter((F.col("p") >= rules.least) & (F.col("seeds") >= rules.min_seeds)).select("pattern", "p", F.col("kind").alias("as_kind"))
    fits = F.lit(False)
    for k in KINDS:
        fits = fits | ((F.col("as_kind") == k) & F.col("m").rlike(_SHAPES[k]))
    found = tokens.join(use, "pattern").filter(fits).groupBy("row", "s", "e").agg(F.max(F.struct("p", "as_kind")).alias("best"))
    return found.select(F.col("row").alias(row), F.col("best.as_kind").alias("kind"), "s", "e")


def find_pii(docs: DataFrame, rules: PiiRules = PiiRules()) -> DataFrame:
    """One row for each text: doc_id, base counts, base_sha256 and spans (kind:start:end, comma-joined)."""
    p = "__pii_"
    base = stored(with_base(docs.select("doc_id", "text"), rules, p).drop("text"), "pii-base")
    out = _joined(base, rules, p)
    listed = lambda k: f"transform({p}{k}, x -> concat('{k}:', x.s, ':', x.e))"
    return out.select(
        "doc_id", *(F.size(p + k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.expr(f"sha2(array_join(concat({', '.join(listed(k) for k in KINDS)}), ','), 256)").alias("base_sha256"),
        F.expr(f"array_join(transform({p}spans, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')").alias("spans"),
    )


def redact(docs: DataFrame, rules: PiiRules = PiiRules()) -> DataFrame:
    """``docs`` with a tag in place of each span; n_chars, if there, follows. A null text stays null.

    Spans that overlap become one tag, that of the first."""
    p = free_prefix(docs, "__pii_")
    out = _joined(stored(with_base(docs, rules, p), "pii-base"), rules, p)
    ordered = f"array_sort({p}spans, (a, b) -> CASE WHEN a.s < b.s THEN -1 WHEN a.s > b.s THEN 1 ELSE b.e - a.e END)"
    none = "cast(array() AS array<struct<a:int,b:int,k:string>>)"
    apart = f"""aggregate({blocks(ordered)}, struct(0 AS p, {none} AS out), (a, block) -> aggregate(block, struct(a.p AS p, {none} AS out),
        (c, x) -> CASE WHEN x.s >= c.p THEN struct(x.e AS p, concat(c.out, array(struct(c.p AS a, x.s AS b, x.kind AS k))) AS out) ELSE struct(greatest(c.p, x.e) AS p, c.out AS out) END,
        c -> struct(c.p AS p, concat(a.out, c.out) AS out)))"""
    text = f"""transform(array(struct({chunks_of('text')} AS c, {apart} AS f)), w ->
        concat(array_join(transform(w.f.out, y -> concat({piece('w.c', 'y.a', 'y.b')}, '<', upper(y.k), '>')), ''), {piece('w.c', 'w.f.p', 'length(text)')}))[0]"""
    size = F.size(p + "spans")
    out = out.withColumn(p + "clean", F.when(size > 0, F.expr(text)).otherwise(F.col("text")))
    chars = F.when(size > 0, F.length(p + "clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    new = {"text": F.col(p + "clean"), "n_chars": chars}
    return out.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))


def _joined(base: DataFrame, rules: PiiRules, p: str) -> DataFrame:
    more = discovered(base, rules, p).groupBy(p + "row").agg(F.collect_set(F.struct("kind", "s", "e")).alias(p + "more"))  # of one text
    more = stored(more, "pii-found")
    out = base.join(F.broadcast(more) if more.count() <= MOST_BROADCAST else more, p + "row", "left")
    spans = []
    for k in KINDS:
        found = f"filter(coalesce({p}more, cast(array() AS array<struct<kind:string,s:int,e:int>>)), x -> x.kind = '{k}')"
        own = f"transform({p}{k}, x -> struct('{k}' AS kind, x.s AS s, x.e AS e))"
        spans.append(f"CASE WHEN size({found}) = 0 THEN {own} ELSE array_sort(concat({own}, {found}), (a, b) -> CASE WHEN a.s < b.s THEN -1 WHEN a.s > b.s THEN 1 ELSE a.e - b.e END) END")
    return out.withColumn(p + "spans", F.expr(f"concat({', '.join(spans)})")).drop(p + "more", p + "seen", p + "row")
