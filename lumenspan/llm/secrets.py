"""Secret scans: multipart credential linking, in DataFrame functions only.

Every text yields parts, intervals of code points: strong ones (assignments of a long value, access identifiers, long hex
runs), which are always reported, and weak candidates (short or unusual assignments, secret keys, bare values of mixed
characters, user names, endpoints), which are reported only if complementary parts lie in the same scope. A scope is a
stretch of text without a blank line. No part holds a line break, so the interval join of parts with scopes is a cut of the
text at its blank lines: each scope is searched alone, and what kinds of parts it has tells which of them are linked:

* a weak secret, if the scope has an identifier or an endpoint;
* an identifier, if the scope has a secret;
* an endpoint, if the scope has an identifier and a secret.

Weak candidates are sought in what the strong ones leave: there, a strong part stands as as many mask characters, another one
for each kind, so positions stay, no candidate overlaps a strong part, and a scope's strong parts are seen by a look for their
mask. No pair of parts is made and nothing is shuffled; apart from the running sums that place parts (a pass over blocks of
them) the work is linear in the text, however many parts or scopes it has.

Defined cases: a null text is an empty one (no spans, the digest of the empty string); null and repeated ids and repeated
rows stay rows of their own; other columns of the input stay, whatever their names, but `spans` is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, prefix_sums, quoted

# The three base patterns and their least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_VALUE = 12

#: Names of weak secrets and of identifiers, and the value after one.
SECRET_NAME = r"secret[_-]?(?:access[_-]?)?key|pwd|passphrase|credential|private_?key"
SHORT_NAME = r"password|passwd|secret|token|api_?key"
IDENT_NAME = r"access_?key(?:_?id)?|client_?id|user_?(?:name|id)|login|account"
_VALUE = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=@-]+)"""
#: One alternation, so that a value under a name is no second candidate; what is under none is a bare run of characters.
NAMED = rf"(?i)(?:{SECRET_NAME}|{SHORT_NAME}|{IDENT_NAME}){_VALUE}|[A-Za-z0-9+/_.=-]{{32,}}"
SECRET_KEY = rf"(?i)^(?:{SECRET_NAME}){_VALUE}$"
SHORT = rf"(?i)^(?:{SHORT_NAME}){_VALUE}$"
IDENT = rf"(?i)^(?:{IDENT_NAME}){_VALUE}$"
BARE = r"^[A-Za-z0-9+/]{32,128}={0,2}$"
ENDPOINT = r"""(?i)(?:(?:https?|s?ftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\x00-\x20"'<>]+|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,})"""
#: Least lengths of the values under those names.
LEAST = {SECRET_KEY: 6, SHORT: 4, IDENT: 3}
BREAK = r"\n[\x20\t\r]*\n"

#: Order of kinds that start at the same place.
KINDS = ("assign", "access", "hex", "weak_secret", "ident", "endpoint")
#: What stands for a character of a strong part, by kind.
MASKS = ("\x01", "\x02", "\x03")
_HITS = "array<struct<start:bigint,end:bigint,hit:string>>"
_PARTS = "array<struct<start:bigint,rank:int,end:bigint,linked:boolean>>"


def _found(text: Column, regex: str) -> Column:
    """array<struct<start, end, hit>> of the leftmost non-overlapping matches, in code points.

    The pieces between the matches and the matches themselves give each position, as a sum of lengths.
    """

    def placed(hits: Column) -> Column:
        pieces = F.split(text, regex, -1)
        lengths = F.zip_with(F.transform(F.slice(pieces, 1, F.size(hits)), lambda p: F.length(p)), hits, lambda p, h: F.struct(p.alias("p"), F.length(h).alias("h")))

        def at(l: Column) -> Column:
            return let(prefix_sums(F.transform(l, lambda x: (x["p"] + x["h"]).cast("long"))), lambda before: F.transform(hits, lambda h, i: F.struct((F.get(before, i) + F.get(l, i)["p"]).alias("start"), (F.get(before, i) + F.get(l, i)["p"] + F.get(l, i)["h"]).alias("end"), h.alias("hit"))))

        return F.when(F.size(hits) > 0, let(lengths, at)).otherwise(F.array().cast(_HITS))

    return let(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), placed)


def _masked(text: Column, some: Column, regex: str, mask: str, strong: Callable[[Column], Column]) -> Column:
    """text with the mask in place of every character of the matches that are strong; as it is where there are not some."""

    def filled(t: Column) -> Column:
        shown = F.transform(F.regexp_extract_all(t, F.lit(regex), F.lit(0)), lambda h: F.when(strong(h), F.repeat(F.lit(mask), F.length(h))).otherwise(h))
        return F.array_join(F.zip_with(F.split(t, regex, -1), shown, lambda p, h: F.concat(p, F.coalesce(h, F.lit("")))), "")

    return let(text, lambda t: F.when(some, filled(t)).otherwise(t))


def _long(hit: Column) -> Column:
    return F.length(F.regexp_extract(hit, ASSIGN, 2)) >= LEAST_VALUE


def _part(x: Column, kind: str, shift=0, linked: bool = False) -> Column:
    return F.struct((x["start"] + shift).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (x["end"] + shift).alias("end"), F.lit(linked).alias("linked"))


def _parts(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: _part(x, kind))


def _in_scope(scope: Column, shift: Column) -> Column:
    """The linked weak parts of a scope that starts at `shift`; its strong parts are masked."""
    named = lambda x, regex: F.length(F.regexp_extract(x["hit"], regex, 1)) >= LEAST[regex]
    bare = lambda x: x["hit"].rlike(BARE) & ~F.startswith(x["hit"], F.lit("//")) & x["hit"].rlike("[a-z]") & x["hit"].rlike("[A-Z]") & x["hit"].rlike("[0-9]")

    def linked(found: Column) -> Column:
        secrets = F.transform(F.filter(found["named"], lambda x: named(x, SECRET_KEY) | named(x, SHORT) | bare(x)), lambda x: _part(x, "weak_secret", shift, True))
        idents = F.transform(F.filter(found["named"], lambda x: named(x, IDENT)), lambda x: _part(x, "ident", shift, True))
        ends = F.transform(found["ends"], lambda x: _part(x, "endpoint", shift, True))

        def kept(p: Column) -> Column:
            secret = (F.size(p["secrets"]) > 0) | F.contains(scope, F.lit(MASKS[0]))
            ident = (F.size(p["idents"]) > 0) | F.contains(scope, F.lit(MASKS[1]))
            end, none = F.size(p["ends"]) > 0, F.array().cast(_PARTS)
            return F.concat(F.when(ident | end, p["secrets"]).otherwise(none), F.when(secret, p["idents"]).otherwise(none), F.when(ident & secret, p["ends"]).otherwise(none))

        return let(F.struct(secrets.alias("secrets"), idents.alias("idents"), ends.alias("ends")), kept)

    return let(F.struct(_found(scope, NAMED).alias("named"), _found(scope, ENDPOINT).alias("ends")), linked)


def _weak(masked: Column) -> Column:
    """The linked weak parts of a masked text."""

    def by_scope(scopes: Column) -> Column:
        breaks = F.regexp_extract_all(masked, F.lit(BREAK), F.lit(0))
        lengths = F.zip_with(scopes, breaks, lambda s, b: (F.length(s) + F.coalesce(F.length(b), F.lit(0))).cast("long"))
        return let(prefix_sums(lengths), lambda before: F.flatten(F.transform(scopes, lambda s, i: let(F.get(before, i), lambda at: _in_scope(s, at)))))

    return let(F.split(masked, BREAK, -1), by_scope)


def _text_of(spans: Column) -> Column:
    name = F.element_at(F.array(*map(F.lit, KINDS)), spans["rank"] + 1)
    return F.concat_ws(":", name, spans["start"].cast("string"), spans["end"].cast("string"))


def scan_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with `spans`: array<struct<start, rank, end, linked>>, strong ones and linked weak ones, by start and kind."""
    own = [c for c in docs.columns if c.lower() != "spans"]
    text, none = F.col("__text"), F.array().cast(_HITS)
    of = lambda regex: F.when(text.rlike(regex), _found(text, regex)).otherwise(none)
    held = docs.select(F.struct(*map(quoted, own)).alias("__own"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    one = held.withColumns({"__assign": of(ASSIGN), "__access": of(ACCESS), "__hex": of(HEX)})
    two = one.withColumn("__assign", F.filter("__assign", lambda x: _long(x["hit"])))
    strong = F.concat(*(_parts(F.col(f"__{k}"), k) for k in KINDS[:3]))
    n = lambda k: F.size(f"__{k}") > 0
    # Mask characters that the text has itself become another one there; no pattern takes either.
    bare = F.when(text.rlike(r"[\x01-\x03]"), F.translate(text, "".join(MASKS), "\x04\x04\x04")).otherwise(text)
    for kind, regex, mask in zip(KINDS, (ASSIGN, ACCESS, HEX), MASKS, strict=False):
        bare = _masked(bare, n(kind), regex, mask, _long if kind == "assign" else lambda _: F.lit(True))
    # A text without a name or a bare run has nothing to link, unless an endpoint joins an identifier and a secret, both strong.
    some = text.rlike(NAMED) | (n("assign") & n("access"))
    three = two.withColumn("__weak", F.when(some, let(bare, _weak)).otherwise(F.array().cast(_PARTS)))
    return three.select("__own.*", F.array_sort(F.concat(strong, "__weak")).alias("spans"))


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    """One row per document: counts and digest of the strong spans, all spans as text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = F.filter("spans", lambda x: x["rank"] <= KINDS.index("hex"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return scan_secrets(docs).select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(F.array_join(F.transform(base, _text_of), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", _text_of), ",").alias("spans"),
        F.size(F.filter("spans", lambda x: x["linked"])).cast("long").alias("n_linked"),
    )


def _q(regex: str) -> str:
    return "'" + regex.replace("'", "''") + "'"


def _sql_parts(name: str, regex: str, of: str, keep: str = "true") -> str:
    """Matches of a pattern in the scopes (doc_id, k, pos, t) of a table, with their places."""
    return f"""{name}_m AS (SELECT doc_id, k, pos, unnest(hits) AS h, unnest(pieces[1:len(hits)]) AS p, unnest(range(len(hits))) AS i FROM (SELECT doc_id, k, pos, regexp_extract_all(t, {_q(regex)}) AS hits, string_split_regex(t, {_q(regex)}) AS pieces FROM {of})),
{name}_at AS (SELECT doc_id, k, pos, h, pos + sum(length(p) + length(h)) OVER (PARTITION BY doc_id, k ORDER BY i) - length(h) AS s FROM {name}_m),
{name} AS (SELECT doc_id, k, h, s::BIGINT AS s, (s + length(h))::BIGINT AS e FROM {name}_at WHERE {keep})"""


def _sql_masked(to: str, of: str, regex: str, mask: int, strong: str = "true") -> str:
    return f"""{to}_l AS (SELECT doc_id, regexp_extract_all(t, {_q(regex)}) AS hits, string_split_regex(t, {_q(regex)}) AS pieces FROM {of}),
{to}_u AS (SELECT doc_id, unnest(pieces) AS p, unnest(hits) AS h, unnest(range(len(pieces))) AS i FROM {to}_l),
{to} AS (SELECT doc_id, string_agg(p || CASE WHEN h IS NULL THEN '' WHEN {strong} THEN repeat(chr({mask}), length(h)) ELSE h END, '' ORDER BY i) AS t FROM {to}_u GROUP BY doc_id)"""


_SQL_LONG = f"length(regexp_extract(h, {_q(ASSIGN)}, 2)) >= {LEAST_VALUE}"
_SQL_NAMED = lambda regex: f"length(regexp_extract(h, {_q(regex)}, 1)) >= {LEAST[regex]}"
_SQL_KIND = "['" + "','".join(KINDS) + "'][r + 1] || ':' || s || ':' || e"
SQL_OP1 = "WITH d AS (SELECT doc_id, 0 AS k, 0 AS pos, coalesce(text, '') AS t FROM documents),\n" + ",\n".join([
    _sql_parts("sa", ASSIGN, "d", _SQL_LONG), _sql_parts("sk", ACCESS, "d"), _sql_parts("sh", HEX, "d"),
    "m0 AS (SELECT doc_id, translate(t, chr(1) || chr(2) || chr(3), chr(4) || chr(4) || chr(4)) AS t FROM d)",
    _sql_masked("m1", "m0", ASSIGN, 1, _SQL_LONG), _sql_masked("m2", "m1", ACCESS, 2), _sql_masked("m3", "m2", HEX, 3),
    f"bl AS (SELECT doc_id, string_split_regex(t, {_q(BREAK)}) AS scopes, regexp_extract_all(t, {_q(BREAK)}) AS breaks FROM m3)",
    "bu AS (SELECT doc_id, unnest(scopes) AS t, unnest(breaks) AS b, unnest(range(len(scopes))) AS k FROM bl)",
    "sc AS (SELECT doc_id, k, t, coalesce(sum(length(t) + coalesce(length(b), 0)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM bu)",
    _sql_parts("nm", NAMED, "sc"), _sql_parts("en", ENDPOINT, "sc"),
    f"ws AS (SELECT * FROM nm WHERE {_SQL_NAMED(SECRET_KEY)} OR {_SQL_NAMED(SHORT)} OR (regexp_matches(h, '{BARE}') AND NOT starts_with(h, '//') AND regexp_matches(h, '[a-z]') AND regexp_matches(h, '[A-Z]') AND regexp_matches(h, '[0-9]')))",
    f"wi AS (SELECT * FROM nm WHERE {_SQL_NAMED(IDENT)})",
    """f AS (SELECT doc_id, k, contains(t, chr(1)) OR (doc_id, k) IN (SELECT (doc_id, k) FROM ws) AS sec, contains(t, chr(2)) OR (doc_id, k) IN (SELECT (doc_id, k) FROM wi) AS idn, (doc_id, k) IN (SELECT (doc_id, k) FROM en) AS fin FROM sc)""",
    """al AS (SELECT doc_id, 0 AS r, s, e FROM sa UNION ALL SELECT doc_id, 1, s, e FROM sk UNION ALL SELECT doc_id, 2, s, e FROM sh
  UNION ALL SELECT doc_id, 3, s, e FROM ws JOIN f USING (doc_id, k) WHERE idn OR fin UNION ALL SELECT doc_id, 4, s, e FROM wi JOIN f USING (doc_id, k) WHERE sec
  UNION ALL SELECT doc_id, 5, s, e FROM en JOIN f USING (doc_id, k) WHERE idn AND sec)""",
]) + f"""
SELECT d.doc_id, count(*) FILTER (r = 0)::BIGINT AS n_assign, count(*) FILTER (r = 1)::BIGINT AS n_access, count(*) FILTER (r = 2)::BIGINT AS n_hex,
  sha256(coalesce(string_agg({_SQL_KIND}, ',' ORDER BY s, r, e) FILTER (r < 3), '')) AS base_sha256, coalesce(string_agg({_SQL_KIND}, ',' ORDER BY s, r, e), '') AS spans, count(*) FILTER (r > 2)::BIGINT AS n_linked
FROM d LEFT JOIN al ON d.doc_id = al.doc_id GROUP BY d.doc_id"""
