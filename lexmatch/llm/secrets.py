"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds are reported wherever they match. Parts that are weak on their own - an identifier, a token of mixed characters, an
endpoint - are reported only if a complementary part lies within `scope` characters in the same text: an identifier needs a
secret, a token needs an identifier, an endpoint needs both. Base matches count as parts: access identifiers as identifiers,
assignments and hex runs as secrets. A weak part that overlaps a base match isn't reported again.

The linking is an interval join: every part's reach is dealt into cells of `scope` characters, parts that share a cell of one text
meet, and the gap between them decides. Matches of one kind don't overlap, so a cell of fixed width holds a bounded number of parts:
the join's rows grow with the texts, not with the square of the parts in a text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmatch.llm import _common


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
_KEYS = "|".join([_either(x) for x in ("password", "passwd", "secret", "token")] + [_either("api") + "_?" + _either("key")])
_IDS = "|".join(_either(x) for x in ("username", "user_name", "user_id", "userid", "login", "client_id", "clientid", "account_id", "accountid", "tenant_id", "access_key_id"))
_HOSTS = "|".join(_either(x) for x in ("hostname", "host", "endpoint", "server"))
#: kind: pattern of the match, pattern of the whole match that it must also fit (or none). Listed in their order among equal starts.
BASE = {
    "assign": (f"(?:{_KEYS}){_VALUE}[A-Za-z0-9+/_.=-]+", f"^(?:{_KEYS}){_VALUE}[A-Za-z0-9+/_.=-]{{8,}}$"),
    "access": ("AKIA[A-Z0-9]{12,}", None),
    "hex": ("[0-9a-f]{32,}", None),
}
WEAK = {
    "identifier": (f"(?:{_IDS}){_VALUE}[A-Za-z0-9@._+-]+", None),
    "mixed": ("[A-Za-z0-9+/_-]{20,}={0,2}", None),  # with a lower-case and an upper-case letter and two digits
    "endpoint": (f"[Hh][Tt][Tt][Pp][Ss]?://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+|(?:{_HOSTS}){_VALUE}[A-Za-z0-9.-]+", None),
}
ORDER = [*BASE, *WEAK]
SCOPE = 256
_SPAN = "array<struct<s:int,e:int,k:int>>"


def _running(values: Column, join: str) -> Column:
    """Prefix sums (join '+') or prefix maxima ('greatest') of an array by doubling: each pass is linear, and their number is log n."""
    one = (lambda a, b: a + b) if join == "+" else F.greatest
    passes = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(F.bin(F.size(values).cast("long"))) - 1))
    step = lambda acc, k: F.transform(acc, lambda x, i: F.when(i >= F.pow(F.lit(2), k).cast("int"), one(x, F.get(acc, i - F.pow(F.lit(2), k).cast("int")))).otherwise(x))
    return F.aggregate(passes, values, step)


def _whole(kind: str, match: Column) -> Column:
    """Whether a match that the pattern found counts."""
    if kind == "mixed":
        return match.rlike("[a-z]") & match.rlike("[A-Z]") & match.rlike("[0-9].*[0-9]")
    rule = {**BASE, **WEAK}[kind][1]
    return match.rlike(rule) if rule else F.lit(True)


def matches(text: Column, kind: str) -> Column:
    """Spans (s, e, k) of a kind's leftmost non-overlapping matches, in code points, end exclusive; those that don't count are dropped.

    The texts between matches and the matches are found by two passes of one pattern; sums of their lengths are the places.
    """
    pattern = {**BASE, **WEAK}[kind][0]
    between, found = F.split(text, F.lit(pattern), -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(between, i)))
    spans = F.zip_with(found, _running(steps, "+"), lambda m, e: F.struct((e - F.length(m)).alias("s"), e.alias("e"), F.lit(ORDER.index(kind)).alias("k"), m.alias("m")))
    kept = F.transform(F.filter(spans, lambda x: _whole(kind, x["m"])), lambda x: F.struct(x["s"], x["e"], x["k"]))
    return F.when(text.rlike(pattern), kept).otherwise(F.array().cast(_SPAN))


def _all(text: Column, kinds: list[str]) -> Column:
    return reduce(lambda a, b: F.concat(a, b), [matches(text, k) for k in kinds])


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(x) for x in ORDER])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _ordered(spans: Column) -> Column:
    """By start, then by the kinds' order."""
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    return F.transform(keyed, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))


_ID_KINDS, _SECRET_KINDS = [ORDER.index(x) for x in ("access", "identifier")], [ORDER.index(x) for x in ("assign", "hex", "mixed")]


def _linked(held: DataFrame, scope: int) -> DataFrame:
    """(row, linked): the weak spans of each row that have their complementary parts within the scope."""
    has = lambda kinds: F.exists("parts", lambda x: x["k"].isin(kinds))
    rows = held.where(F.size("weak") > 0).select("row", F.concat("base", "weak").alias("parts")).where(has(_ID_KINDS) & has(_SECRET_KINDS))
    parts = rows.select("row", F.explode("parts").alias("x")).select("row", "x.s", "x.e", "x.k")
    cells = lambda a, b: F.explode(F.sequence(F.expr(f"greatest(0, {a}) div {scope}"), F.expr(f"({b}) div {scope}")))
    near = parts.where(F.col("k") >= len(BASE)).select("row", "s", "e", "k", cells(f"s - {scope}", f"e + {scope}").alias("cell"))
    other = parts.select("row", F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("k").alias("k2"), cells("s", "e").alias("cell"))
    met = near.join(other, ["row", "cell"]).where((F.greatest("s", "s2") - F.least("e", "e2") <= scope) & (F.col("k") != F.col("k2")))
    over = (F.col("k2") < len(BASE)) & (F.greatest("s", "s2") < F.least("e", "e2"))
    seen = met.groupBy("row", "s", "e", "k").agg(F.max(F.col("k2").isin(_ID_KINDS)).alias("id"), F.max(F.col("k2").isin(_SECRET_KINDS)).alias("secret"), F.max(over).alias("over"))
    names = {x: ORDER.index(x) for x in WEAK}
    needs = F.when(F.col("k") == names["identifier"], F.col("secret")).when(F.col("k") == names["mixed"], F.col("id")).otherwise(F.col("id") & F.col("secret"))
    return seen.where(~F.col("over") & needs).groupBy("row").agg(F.collect_list(F.struct("s", "e", "k")).alias("linked"))


def scan(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, key (md5 of the text), base and spans (arrays of s, e, k: places in code points and the kind's number).

    A null text counts as empty; null and repeated ids stay; other columns are ignored; an empty table gives no rows. The texts are
    read in one narrow pass whose spans are written to the shared folder, so row numbers are the same for all that follows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    made = own.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.md5("text").alias("key"), _all(F.col("text"), [*BASE]).alias("base"), _all(F.col("text"), [*WEAK]).alias("weak"))
    held, _ = _common.materialize(made, "parts")
    joined = held.join(_linked(held, scope), "row", "left")
    spans = F.concat("base", F.coalesce("linked", F.array().cast(_SPAN)))
    return joined.select("doc_id", "key", _ordered(F.col("base")).alias("base"), _ordered(spans).alias("spans"))


def report(found: DataFrame) -> DataFrame:
    """scan()'s rows as counts and text: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["k"] == ORDER.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(x) for x in BASE], F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every reported span, overlapping ones joined, replaced by mark; all columns and rows stay.

    Texts without spans, null ones too, are as before. Spans meet their texts by id and the text's digest.
    """
    found = scan(docs, scope, id_col, text_col).where(F.size("spans") > 0).select("doc_id", "key", "spans").dropDuplicates(["doc_id", "key"])
    found, _ = _common.materialize(found, "spans")
    plain = docs.select(*[F.col(f"`{x}`").alias(f"c{i}") for i, x in enumerate(docs.columns)])
    at, who = f"c{docs.columns.index(text_col)}", f"c{docs.columns.index(id_col)}"
    left = plain.withColumn("_key", F.md5(F.coalesce(F.col(at).cast("string"), F.lit("")))).withColumn("_id", F.coalesce(F.col(who).cast("long"), F.lit(-1)))
    right = found.select(F.coalesce("doc_id", F.lit(-1).cast("long")).alias("_id"), F.col("key").alias("_key"), F.col("doc_id").isNull().alias("_null"), "spans")
    both = left.withColumn("_null", F.col(who).isNull()).join(right, ["_id", "_key", "_null"], "left")
    ends = both.withColumn("_ends", F.when(F.col("spans").isNotNull(), _running(F.transform("spans", lambda x: x["e"]), "greatest")))
    before = lambda i: F.coalesce(F.get("_ends", i - 1), F.lit(0))
    piece = lambda x, i: F.concat(F.col(at).substr(before(i) + 1, F.greatest(F.lit(0), x["s"] - before(i))), F.when((x["s"] >= before(i)), F.lit(mark)).otherwise(F.lit("")))
    rest = F.col(at).substr(F.get("_ends", F.size("_ends") - 1) + 1, F.length(F.col(at)))
    text = F.when(F.col("spans").isNull(), F.col(at)).otherwise(F.concat(F.array_join(F.transform("spans", piece), ""), rest))
    return ends.withColumn(at, text).select(*[F.col(f"c{i}").alias(x) for i, x in enumerate(docs.columns)])


def _sql_spans(kind: str) -> str:
    pattern = {**BASE, **WEAK}[kind][0].replace("'", "''")
    if kind == "mixed":
        rule = "regexp_matches(x.m, '[a-z]') and regexp_matches(x.m, '[A-Z]') and regexp_matches(x.m, '[0-9].*[0-9]')"
    else:
        whole = {**BASE, **WEAK}[kind][1]
        rule = f"regexp_matches(x.m, '{whole.replace(chr(39), chr(39) * 2)}')" if whole else "true"
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{pattern}')) + 1), lambda i: {{
        'e': list_sum(list_transform(string_split_regex(t, '{pattern}')[1:i], lambda y: length(y))) + list_sum(list_transform(regexp_extract_all(t, '{pattern}')[1:i], lambda y: length(y))),
        'm': regexp_extract_all(t, '{pattern}')[i]}}), lambda x: {rule})"""


def oracle() -> str:
    """report(scan(documents)) in DuckDB's SQL."""
    kinds = " union all ".join(f"select r, unnest(list_transform({_sql_spans(k)}, lambda x: {{'s': x.e - length(x.m), 'e': x.e, 'k': {i}}})) as x from d" for i, k in enumerate(ORDER))
    ids, secrets = ", ".join(map(str, _ID_KINDS)), ", ".join(map(str, _SECRET_KINDS))
    name = "[" + ", ".join(f"'{x}'" for x in ORDER) + "]"
    written = lambda where: f"coalesce(string_agg({name}[k::int + 1] || ':' || s::bigint || ':' || e::bigint, ',' order by s, k) filter ({where}), '')"
    return f"""
with d as materialized (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
p as materialized (select r, x.s::bigint as s, x.e::bigint as e, x.k::bigint as k from ({kinds})),
w as (select a.r, a.s, a.e, a.k from p a join p b on a.r = b.r and a.k <> b.k and greatest(a.s, b.s) - least(a.e, b.e) <= {SCOPE}
  where a.k >= {len(BASE)} group by all
  having not bool_or(b.k < {len(BASE)} and greatest(a.s, b.s) < least(a.e, b.e))
    and case a.k when {ORDER.index("identifier")} then bool_or(b.k in ({secrets})) when {ORDER.index("mixed")} then bool_or(b.k in ({ids})) else bool_or(b.k in ({ids})) and bool_or(b.k in ({secrets})) end),
u as (select * from p where k < {len(BASE)} union all select * from w),
g as (select r, count(*) filter (k = 0) as a, count(*) filter (k = 1) as b, count(*) filter (k = 2) as c, {written(f"k < {len(BASE)}")} as base, {written("true")} as spans from u group by r)
select doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(b, 0)::bigint as n_access, coalesce(c, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (r)"""
