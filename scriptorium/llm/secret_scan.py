"""Secret scans: three patterns, and strings that a character Markov model finds more random than named.

Two first-order Markov chains over characters are counted from labelled samples: `random` from digests of numbers in several
alphabets and lengths, `ordinary` from words of documents, identifiers made of them (snake, kebab, camel and upper case, paths)
and numbers (dates, times, telephone numbers). A string's score is the log-likelihood ratio summed over its
transitions. The threshold is the logarithm of ODDS, so many ordinary strings being expected for a random one, or higher
if more than FALSE of the ordinary samples reach it: those of a quarter that the chains don't see.

Strings are runs of token characters. One that reaches the threshold is a span of kind `random`; of any other, those parts
between separators are that do, so that a secret after a path of ordinary words counts by itself. Spans that overlap a base
span are left out. There is no other rule: no need of digits, capitals or a length beyond MIN_LENGTH.

Everything runs as built-in expressions: no Python on the executors. Work is in proportion to the text's length, also for very
long strings and many matches: running sums go by chunks of CHUNK elements. The driver holds the ratios, one for each
pair of ALPHABET's classes, and the threshold.

Defined results: null and empty texts have no spans; `base_sha256` is then the hash of the empty string. Positions
count code points, end exclusive. Repeated rows are scanned each. Without documents the ordinary sample is numbers only.
Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import materialise
from .common import text_or_empty

#: The base patterns, and how long what they match must be.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LENGTH = 8
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
#: What a text with an assignment must contain, in lower case.
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CLASSES = len(ALPHABET) + 1
MIN_LENGTH = 12
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+" % MIN_LENGTH
SEPARATORS = "[/=_+-]"
#: Ordinary strings for a random one, and the share of held-out ordinary samples that may be found.
ODDS, FALSE = 1e6, 0.0005
#: Documents whose words make the ordinary sample (those of least hash, their whole texts), and random strings of each alphabet.
SAMPLE_DOCS = 200
SAMPLE_STRINGS = 3000
#: Elements over which running values are kept in one array.
CHUNK = 512

_SPANS = "array<struct<s:int,k:int,e:int>>"


@dataclass(frozen=True)
class Model:
    ratios: tuple[float, ...]
    threshold: float


def _let(name: str, value: str, body: str) -> str:
    """SQL: body, in which name stands for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _running(a: str, step: str, zero: str) -> str:
    """SQL: for each element of the int array `a` the fold of those before it; step says how p and x make the next p."""
    chunks = f"sequence(0, cast(greatest(0, size({a}) - 1) div {CHUNK} AS int))"
    part = f"slice({a}, c * {CHUNK} + 1, {CHUNK})"
    sums = f"transform({chunks}, c -> aggregate({part}, cast({zero} AS int), (p, x) -> cast({step} AS int)))"
    starts = f"aggregate({sums}, cast(array({zero}) AS array<int>), (all, x) -> array_append(all, {_let('p', 'element_at(all, -1)', f'cast({step} AS int)')}))"
    inside = f"""aggregate({part}, named_struct('p', element_at(starts, c + 1), 'out', cast(array() AS array<int>)),
        (acc, x) -> named_struct('p', {_let('p', 'acc.p', f'cast({step} AS int)')}, 'out', array_append(acc.out, acc.p)), acc -> acc.out)"""
    return _let("starts", starts, f"flatten(transform({chunks}, c -> {inside}))")


def _sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


_CODES = "cast(split('" + ",".join(str(ALPHABET.find(chr(i)) + 1) for i in range(128)) + "', ',') AS array<int>)"


def _moves(token: str) -> str:
    """SQL: the numbers of a token's transitions, from 1 on. The token is cut into characters once."""
    codes = f"transform(filter(split({token}, ''), c -> c <> ''), c -> element_at({_CODES}, ascii(c) + 1))"
    return _let("codes", codes, f"zip_with(slice(codes, 1, greatest(0, size(codes) - 1)), slice(codes, 2, greatest(0, size(codes) - 1)), (a, b) -> a * {CLASSES} + b + 1)")


def _score(token: str, ratios: str) -> str:
    """SQL: the log-likelihood ratio of a token, summed over its transitions."""
    return f"aggregate({_moves(token)}, 0D, (sum, m) -> sum + element_at({ratios}, m))"


def _ratios(model: Model) -> str:
    return "cast(split('" + ",".join(map(str, model.ratios)) + "', ',') AS array<double>)"  # folded to one constant


def labelled_samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, strings: int = SAMPLE_STRINGS) -> DataFrame:
    """(label, token): 1 for random strings, 0 for words, identifiers and numbers."""
    spark = docs.sparkSession
    texts = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    words = texts.select(F.expr(r"regexp_extract_all(text, '(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,30}(?![A-Za-z0-9+/_=-])', 0)").alias("w"))
    runs = words.select(F.explode(F.expr("transform(sequence(1, greatest(1, size(w) - 2), 3), i -> slice(w, i, 3))")).alias("r")).where("size(r) = 3")
    shapes = "array(array_join(r, '_'), array_join(r, '-'), upper(array_join(r, '_')), array_join(transform(r, x -> initcap(x)), ''), lower(array_join(r, '')), concat(array_join(r, '_'), '_', cast(pmod(hash(r[0]), 100) AS string)), r[0], r[1], r[2], concat('/', array_join(r, '/')), concat(r[0], '=', r[1]), concat(r[1], '+', r[2], '=', cast(pmod(hash(r[0]), 1000) AS string)))"
    plain = runs.select(F.explode(F.expr(shapes)).alias("token"))
    day = "date_add(DATE'1990-01-01', pmod(hash(id), 15000))"
    numbers = f"array(cast({day} AS string), date_format({day}, 'yyyyMMdd'), concat(date_format({day}, 'yyyyMMdd'), lpad(cast(pmod(hash(id, 1), 1000000) AS string), 6, '0')), cast(abs(xxhash64(id)) AS string), concat('+', cast(pmod(xxhash64(id, 2), 100000000000) AS string)), concat('0', array_join(transform(sequence(1, 4), i -> cast(10 + pmod(hash(id, i), 90) AS string)), '-')), concat('v', cast(pmod(hash(id, 3), 30) AS string), '-', cast({day} AS string)))"
    plain = plain.unionByName(spark.range(strings).select(F.explode(F.expr(numbers)).alias("token")))
    drawn = spark.range(strings).selectExpr("id", "unhex(sha2(cast(id AS string), 256)) AS d", "unhex(sha2(concat('x', id), 256)) AS e")
    clean = "translate(base64(concat(d, e)), '+/=\r\n', '')"
    mixes = f"array(lower(hex(d)), hex(d), translate(base64(d), '\r\n', ''), {clean}, upper({clean}), lower({clean}), translate({clean}, '0123456789', ''), lower(translate({clean}, '0123456789', '')), translate(base64(e), '+/=\r\n', '-_'))"
    drawn = drawn.select(F.posexplode(F.expr(mixes)), "id").selectExpr(f"substring(col, 1, {MIN_LENGTH} + pmod(hash(id, pos), 36)) AS token")
    return plain.select(F.lit(0).alias("label"), "token").unionByName(drawn.select(F.lit(1).alias("label"), "token"))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, strings: int = SAMPLE_STRINGS) -> Model:
    """The ratios of all transitions, random over ordinary, and the threshold."""
    samples = materialise(labelled_samples(docs, sample_docs, strings).distinct(), "samples")
    held = F.pmod(F.xxhash64("token"), F.lit(4)) == 0
    moves = samples.where(~held).select("label", F.explode(F.expr(_moves("token"))).alias("move"))
    seen = {(r["label"], r["move"] - 1): r["n"] for r in moves.groupBy("label", "move").agg(F.count("*").alias("n")).collect()}  # 2 x CLASSES^2 rows at most
    totals = {(label, a): sum(seen.get((label, a * CLASSES + b), 0) for b in range(CLASSES)) for label in (0, 1) for a in range(CLASSES)}
    chance = lambda label, a, b: (seen.get((label, a * CLASSES + b), 0) + 0.5) / (totals[label, a] + 0.5 * CLASSES)
    ratios = tuple(round(math.log(chance(1, a, b) / chance(0, a, b)), 4) for a in range(CLASSES) for b in range(CLASSES))
    scores = samples.where(held & (F.col("label") == 0) & (F.length("token") >= MIN_LENGTH)).select(F.expr(_score("token", _ratios(Model(ratios, 0.0)))).alias("score"))
    cut = scores.agg(F.expr(f"percentile(score, {1 - FALSE})")).first()[0]
    return Model(ratios, max(math.log(ODDS), cut if cut is not None else 0.0))


def _located(df: DataFrame, names: list[str]) -> DataFrame:
    """For each name, columns <name>_hit (matches) and <name>_between (what stands between them) become <name>_at: where the matches begin."""
    others = [c for c in df.columns if not any(c == f"{n}_between" for n in names)]
    lens = df.select(*others, *(F.expr(f"zip_with(slice({n}_between, 1, size({n}_hit)), {n}_hit, (b, h) -> length(b) + length(h))").alias(f"{n}_len") for n in names), *(F.expr(f"transform(slice({n}_between, 1, size({n}_hit)), b -> length(b))").alias(f"{n}_gap") for n in names))
    return lens.select(*others, *(F.expr(f"zip_with({_running(f'{n}_len', 'p + x', '0')}, {n}_gap, (at, g) -> at + g)").alias(f"{n}_at") for n in names))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, base and added: arrays of spans (s, k, e), sorted; k numbers KINDS."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("t")).withColumn("low", F.lower("t"))
    kinds = {"assign": (" OR ".join(f"contains(low, '{k}')" for k in KEYWORDS), ASSIGN), "access": ("contains(t, 'AKIA')", ACCESS), "hex": ("t rlike '[0-9a-f]{32}'", HEX), "random": (f"t rlike '{_sql(TOKEN)}'", TOKEN)}
    none = "cast(array() AS array<string>)"
    found = [F.expr(f"CASE WHEN {c} THEN {e} ELSE {none} END").alias(f"{n}_{what}") for n, (c, p) in kinds.items() for what, e in (("hit", f"regexp_extract_all(t, '{_sql(p)}', 0)"), ("between", f"split(t, '{_sql(p)}', -1)"))]
    out = _located(out.select("doc_id", *found), list(kinds))
    span = lambda n, k: f"transform(arrays_zip({n}_at, {n}_hit), x -> named_struct('s', x.{n}_at, 'k', {k}, 'e', x.{n}_at + length(x.{n}_hit)))"
    assigned = f"filter(arrays_zip(assign_at, assign_hit), x -> length(regexp_extract(x.assign_hit, '{_sql(ASSIGN)}', 2)) >= {ASSIGN_LENGTH})"
    assign = f"transform({assigned}, x -> named_struct('s', x.assign_at, 'k', 0, 'e', x.assign_at + length(x.assign_hit)))"
    table = _ratios(model)
    scored = f"transform(arrays_zip(random_at, random_hit), x -> named_struct('at', x.random_at, 'token', x.random_hit, 'score', {_score('x.random_hit', table)}))"
    out = out.select("doc_id", F.expr(f"array_sort(concat({assign}, {span('access', 1)}, {span('hex', 2)}))").alias("base"), F.expr(scored).alias("tokens"))

    # Of a token that doesn't reach the threshold, the parts that do.
    one = "array(named_struct('s', x.at, 'k', 3, 'e', x.at + length(x.token)))"
    offsets = _running("lens", "p + x + 1", "0")
    long = f"filter(arrays_zip(parts, offs), y -> length(y.parts) >= {MIN_LENGTH} AND length(y.parts) < length(x.token))"
    good = f"filter({long}, y -> {_score('y.parts', table)} >= {model.threshold})"
    spans = f"transform({good}, y -> named_struct('s', x.at + y.offs, 'k', 3, 'e', x.at + y.offs + length(y.parts)))"
    parts = _let("parts", f"split(x.token, '{SEPARATORS}', -1)", _let("lens", "transform(parts, q -> length(q))", _let("offs", offsets, spans)))
    added = f"cast(flatten(transform(tokens, x -> if(x.score >= {model.threshold}, {one}, if(x.token rlike '{SEPARATORS}', {parts}, cast(array() AS {_SPANS}))))) AS {_SPANS})"
    out = out.select("doc_id", "base", F.expr(added).alias("r"))

    # Base spans and added ones in order of start: an added one stays if all base spans before it end by its start and all after begin at its end.
    out = out.select("doc_id", "base", "r", F.expr("array_sort(concat(base, r))").alias("every"))
    out = out.select("doc_id", "base", "r", "every", F.expr("transform(every, x -> if(x.k < 3, x.e, 0))").alias("ends"), F.expr("reverse(transform(every, x -> if(x.k < 3, x.s, 2147483647)))").alias("starts_"))
    before, after = _running("ends", "greatest(p, x)", "0"), _running("starts_", "least(p, x)", "2147483647")
    out = out.select("doc_id", "base", "r", "every", F.expr(f"if(size(base) = 0 OR size(r) = 0, cast(array() AS array<int>), {before})").alias("before"), F.expr(f"if(size(base) = 0 OR size(r) = 0, cast(array() AS array<int>), reverse({after}))").alias("after"))
    clear = "transform(filter(arrays_zip(every, before, after), x -> x.every.k = 3 AND x.before <= x.every.s AND x.after >= x.every.e), x -> x.every)"
    return out.select("doc_id", "base", F.expr(f"if(size(base) = 0, r, if(size(r) = 0, r, {clear}))").alias("added"))


def _written(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat(element_at(array('assign', 'access', 'hex', 'random'), x.k + 1), ':', x.s, ':', x.e)), ',')")


def base_columns() -> list[Column]:
    n = lambda k: F.expr(f"cast(size(filter(base, x -> x.k = {k})) AS long)")
    return [F.col("doc_id"), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_written("base").cast("binary"), 256).alias("base_sha256")]


def secrets_query(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row for each row of docs."""
    found = scan(docs, train(docs)).withColumn("every", F.array_sort(F.concat("base", "added")))
    return found.select(*base_columns(), _written("every").alias("spans"))


def base_query(docs: DataFrame) -> DataFrame:
    """The base columns of secrets_query() alone: doc_id, n_assign, n_access, n_hex, base_sha256."""
    return scan(docs, train(docs)).select(*base_columns())


def _any_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


_ASSIGN_SQL = ASSIGN.replace("(?i)password|passwd|secret|token|api_?key", _any_case("password|passwd|secret|token|api_?key")).replace("'", "''")

BASE_ORACLE = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(f"SELECT r, {k} AS k, unnest(regexp_extract_all(t, '{p}')) AS hit, unnest(list_slice(string_split_regex(t, '{p}'), 1, len(regexp_extract_all(t, '{p}')))) AS gap, unnest(range(len(regexp_extract_all(t, '{p}')))) AS i FROM t" for k, p in enumerate((_ASSIGN_SQL, ACCESS, HEX)))}),
p AS (SELECT r, k, hit, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY r, k ORDER BY i) AS BIGINT) AS e FROM m),
f AS (SELECT r, k, e - length(hit) AS s, e FROM p WHERE k <> 0 OR length(regexp_extract(hit, '{_ASSIGN_SQL}', 2)) >= {ASSIGN_LENGTH})
SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  sha256(coalesce(string_agg(['assign', 'access', 'hex'][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k), '')) AS base_sha256
FROM t LEFT JOIN f USING (r) GROUP BY t.r, doc_id
"""
