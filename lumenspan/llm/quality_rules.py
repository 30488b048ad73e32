"""Quality rules: distribution divergence, beside the base counts.

Each text gives two histograms, of character classes and of common words, and the base counts. A language's reference is
the mean of the normalised histograms of all its documents that are long enough and pass the base rules, taken a second
time without those that the first reference fails, so that junk does not shift what junk is measured by. A document's
verdict compares it with the reference of its language by the Jensen-Shannon distance (the root of the divergence in bits,
0 to 1): from MAX_CHAR_DISTANCE on in characters it fails; in words, from WORD_SHARE of the distance on that a text without
any common word has from that reference, which only depends on the reference. Documents below the least length, whose histograms would be noise, are not judged by it, nor are those of a
language with fewer than LEAST_DOCS reference documents, which are compared with the reference of all languages instead.

One pass over the texts makes the features, about 0.5 kB a document, which are written as a table; the references are means
of them, summed on the map side first, so a hot language costs no task.

Defined cases: a null text is an empty one; a null or unknown language has the reference of all; without any reference no
document is judged by distance; repeated rows and null ids are rows of their own; other columns are kept in the struct `own`,
whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, written

# Common words of four languages.
COMMON = {
    "en": "the of and to a in is that it for was on with as be by are this at from or an not have but which his they you had",
    "de": "der die und in den von zu das sich mit des auf für ist im nicht dem ein eine als auch es an werden aus er hat dass sie nach",
    "fr": "de la le et les en des un du une que est pour par dans avec qui pas sur au ce il plus ne se sont cette son elle nous",
    "es": "de la que el en y los las se del un por con no una su para es al lo como más pero sus le ya o este sí porque",
}
WORDS = sorted({w for words in COMMON.values() for w in words.split()})
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
LEAST_CHARS = 300
LEAST_DOCS = 20
#: Distances from here on fail; that of words as a share of the distance of a text without common words.
MAX_CHAR_DISTANCE = 0.3
WORD_SHARE = 0.85

#: Classes of characters: white space, lower case, upper case, digits, listed symbols, other punctuation, beyond ASCII.
_CLASSES = 7
_CLASS = np.full(256, 5, np.int64)
_CLASS[[32, *range(9, 14)]] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[list(SYMBOLS)] = 4
_CLASS[128:] = 6
_CLASS[128:192] = 7  # bytes that go on a character
_INDEX = {w.encode(): i for i, w in enumerate(WORDS)}
_STRIP = b".,;:!?\"'()[]"


def features(text: bytes | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, character classes, common words and others)."""
    text = text or b""
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=8)[:_CLASSES]
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    grams = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(grams)
    repeated = 0
    if len(counts) < len(grams):
        end = 0
        for i, g in enumerate(grams):
            if counts[g] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    common = np.zeros(len(WORDS) + 1, np.int64)
    for w, n in Counter(words).items():
        common[_INDEX.get(w.strip(_STRIP).lower(), -1)] += n
    return len(words), int(kinds.sum() - kinds[0]), int(kinds[4]), len(lines) - len(set(lines)), repeated, kinds.tolist(), common.tolist()


def _features(text: Column) -> Column:
    @F.arrow_udf("struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,chars:array<long>,common:array<long>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            cols = list(zip(*map(features, texts.cast(pa.large_binary()).to_pylist()), strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "common"])

    return run(text)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of the rows of two matrices of shares; each logarithm is of a share over the mean share."""
    m = (p + q) / 2
    part = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0.0)
    return np.sqrt(np.maximum((part(p) + part(q)).sum(axis=1) / 2, 0))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, chars, common) to (lang, n, sums): shares summed by language, and under null for all, once for each task."""
    sums: dict[str | None, list] = {}
    for batch in batches:
        if not len(batch.column(0)):
            continue
        both = np.hstack([_shares(_matrix(batch.column(1), _CLASSES)), _shares(_matrix(batch.column(2), len(WORDS) + 1))])
        langs = batch.column(0).to_pylist()
        for lang in {*langs, None}:
            rows = both if lang is None else both[np.array([x == lang for x in langs])]
            n, total = sums.get(lang, (0, 0.0))
            sums[lang] = [n + len(rows), total + rows.sum(axis=0)]
    if sums:
        yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([t.tolist() for _, t in sums.values()], pa.list_(pa.float64()))], names=["lang", "n", "sums"])


def references(used: DataFrame) -> DataFrame:
    """(lang, chars, common) to (r_lang, n, means); the row of null is of all languages."""
    parts = used.mapInArrow(_sums, "lang string, n long, sums array<double>").select("lang", "n", F.posexplode("sums").alias("k", "x"))
    means = parts.groupBy("lang", "k").agg((F.sum("x") / F.sum("n")).alias("x"), F.sum("n").alias("n"))
    return means.groupBy(F.col("lang").alias("r_lang")).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("means"))


def word_limits(others: np.ndarray) -> np.ndarray:
    """Of references by their shares of words that are not common: WORD_SHARE of the distance to a text of such words alone."""
    log = lambda x: np.log2(np.where(x > 0, x, 1))
    return WORD_SHARE * np.sqrt(np.maximum(1 - others + others * log(2 * others / (1 + others)) + log(2 / (1 + others)), 0) / 2)


def _distances(chars: Column, common: Column, means: Column) -> Column:
    @F.arrow_udf("struct<char_distance:double,word_distance:double,word_limit:double>")
    def run(chars: pa.Array, common: pa.Array, means: pa.Array) -> pa.Array:
        q = _matrix(means, _CLASSES + len(WORDS) + 1)
        near = js_distance(_shares(_matrix(chars, _CLASSES)), q[:, :_CLASSES]), js_distance(_shares(_matrix(common, len(WORDS) + 1)), q[:, _CLASSES:]), word_limits(q[:, -1])
        return pa.StructArray.from_arrays([pa.array(x, pa.float64()) for x in near], names=["char_distance", "word_distance", "word_limit"])

    return run(chars, common, means)


def _far() -> Column:
    return F.coalesce((F.col("char_distance") >= MAX_CHAR_DISTANCE) | (F.col("word_distance") >= F.col("word_limit")), F.lit(False))


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the text, with the base counts, base_failed, char_distance, word_distance, word_limit and kept."""
    own = [c for c in docs.columns if c != text_col]
    made = written(docs.select(F.struct(*map(quoted, own)).alias("own") if own else F.lit(None).cast("int").alias("own"), quoted(lang_col).alias("lang"), _features(quoted(text_col)).alias("f")).select("own", "lang", "f.*"))
    plain = made.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    long = (F.col("n_words") >= LEAST_WORDS) & (F.col("word_chars") >= LEAST_CHARS)
    used = plain.where(long & ~F.col("base_failed"))
    f = None
    for _ in range(2):  # the second time, the references are of what was near the first ones: a trimmed mean
        near = used if f is None else f.where(long & ~F.col("base_failed") & ~_far())
        refs = written(references(near.select("lang", "chars", "common")))
        of_all = refs.where("r_lang is null").select(F.col("means").alias("all_means"))  # one row, or none
        by_lang = refs.where("r_lang is not null").where(F.col("n") >= LEAST_DOCS).select("r_lang", "means")
        few = by_lang.limit(10_001).count() <= 10_000  # 1.2 kB a language
        met = plain.join(F.broadcast(by_lang) if few else by_lang, F.col("lang") == F.col("r_lang"), "left")
        met = met.join(F.broadcast(of_all), F.lit(True), "left").withColumn("means", F.coalesce("means", "all_means"))
        uniform = F.array_repeat(F.lit(0.0), _CLASSES + len(WORDS) + 1)
        d = _distances(F.col("chars"), F.col("common"), F.coalesce("means", uniform))
        told = {k: F.when(long & F.col("means").isNotNull(), F.col(f"d.{k}")) for k in ("char_distance", "word_distance", "word_limit")}
        f = met.withColumn("d", d).withColumns(told | {"word_limit": F.when(F.col("r_lang").isNotNull(), told["word_limit"])})
    return f.withColumn("kept", ~F.col("base_failed") & ~_far()).select("own", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance", "word_limit")


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return divergence(docs).select(F.col("own.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *(F.round(k, 6).alias(k) for k in ("char_distance", "word_distance", "word_limit")))


_SPACE = r"[\x20\x09-\x0D]"
_COUNT = "length(regexp_replace(t, '[^{}]', '', 'g'))"
_WORDS_SQL = ",".join("'" + w.replace("'", "''") + "'" for w in WORDS)
_JS = "sqrt(greatest(0, (coalesce(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END), 0) + coalesce(sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END), 0)) / 2))"

_LIMIT = f"{WORD_SHARE}::DOUBLE * sqrt(greatest(0, 1 - qo + CASE WHEN qo > 0 THEN qo * log2(2 * qo / (1 + qo)) ELSE 0 END + log2(2 / (1 + qo))) / 2)"


def _round_sql(k: int, used: str) -> str:
    """References of the documents in `used`, and all long documents' distances from them."""
    return f"""
n{k} AS (SELECT lang, count(*) AS n FROM {used} WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= {LEAST_DOCS}), a{k} AS (SELECT count(*) AS n FROM {used}),
r{k} AS (SELECT u.lang, h, k, sum(p) / any_value(n.n) AS q FROM {used} u JOIN n{k} n ON u.lang = n.lang JOIN shares s ON s.doc_id = u.doc_id GROUP BY u.lang, h, k),
s{k} AS (SELECT h, k, sum(p) / (SELECT n FROM a{k}) AS q FROM {used} u JOIN shares s ON s.doc_id = u.doc_id GROUP BY h, k),
e{k} AS (SELECT l.doc_id, coalesce(l.lang IN (SELECT lang FROM n{k}), false) AS own, g.h, g.k, CASE WHEN l.lang IN (SELECT lang FROM n{k}) THEN coalesce(r.q, 0) ELSE coalesce(s.q, 0) END AS q, coalesce(p.p, 0) AS p
  FROM (SELECT doc_id, lang FROM base WHERE long AND (SELECT n FROM a{k}) > 0) l CROSS JOIN keys g LEFT JOIN r{k} r ON r.lang = l.lang AND r.h = g.h AND r.k = g.k LEFT JOIN s{k} s ON s.h = g.h AND s.k = g.k LEFT JOIN shares p ON p.doc_id = l.doc_id AND p.h = g.h AND p.k = g.k),
d{k} AS (SELECT doc_id, max(CASE WHEN h = 'c' THEN js END) AS cd, max(CASE WHEN h = 'w' THEN js END) AS wd, max(CASE WHEN h = 'w' AND own THEN {_LIMIT} END) AS wl FROM (SELECT doc_id, h, bool_or(own) AS own, {_JS} AS js, coalesce(max(CASE WHEN k = '' THEN q END), 0) AS qo FROM e{k} GROUP BY doc_id, h) GROUP BY doc_id)"""


SQL_OP3 = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT doc_id, string_split_regex(t, '{_SPACE}+') AS ws FROM d)) WHERE w <> ''),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (SELECT doc_id, i, w AS a, lead(w) OVER v AS b, lead(w, 2) OVER v AS c FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY i)) WHERE c IS NOT NULL),
rep AS (SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n_repeat_words FROM g, (SELECT unnest([0, 1, 2]) AS j) WHERE n > 1 GROUP BY doc_id),
dup AS (SELECT doc_id, (count(*) - count(DISTINCT x))::BIGINT AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
num AS (SELECT doc_id, count(*)::BIGINT AS n_words FROM w GROUP BY doc_id),
c AS (SELECT doc_id, lang, {_COUNT.format(r"\x20\x09-\x0D")} AS c0, {_COUNT.format("a-z")} AS c1, {_COUNT.format("A-Z")} AS c2, {_COUNT.format("0-9")} AS c3, {_COUNT.format("#*$%&|<>")} AS c4, length(regexp_replace(t, '[\x00-\x7F]', '', 'g')) AS c6, length(t) AS n FROM d),
base AS (SELECT c.doc_id, c.lang, coalesce(n_words, 0) AS n_words, (n - c0)::BIGINT AS word_chars, c4::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  coalesce(n_words, 0) < {LEAST_WORDS} OR 100 * coalesce(n_repeat_words, 0) > 50 * coalesce(n_words, 0) AS base_failed, coalesce(n_words, 0) >= {LEAST_WORDS} AND n - c0 >= {LEAST_CHARS} AS long
  FROM c LEFT JOIN num USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)),
common AS (SELECT doc_id, CASE WHEN v IN ({_WORDS_SQL}) THEN v ELSE '' END AS k, count(*) AS n FROM (SELECT doc_id, translate(trim(w, '.,;:!?"''()[]'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS v FROM w) GROUP BY ALL),
counts AS (SELECT doc_id, 'w' AS h, k, n FROM common UNION ALL SELECT doc_id, 'c', unnest(['0', '1', '2', '3', '4', '5', '6']), unnest([c0, c1, c2, c3, c4, n - c0 - c1 - c2 - c3 - c4 - c6, c6]) FROM c),
shares AS (SELECT doc_id, h, k, n / greatest(sum(n) OVER (PARTITION BY doc_id, h), 1) AS p FROM counts), keys AS (SELECT DISTINCT h, k FROM counts),
u1 AS (SELECT doc_id, lang FROM base WHERE long AND NOT base_failed),{_round_sql(1, "u1")},
u2 AS (SELECT u1.* FROM u1 JOIN d1 USING (doc_id) WHERE cd < {MAX_CHAR_DISTANCE} AND coalesce(wd < wl, true)),{_round_sql(2, "u2")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(cd < {MAX_CHAR_DISTANCE} AND wd < wl, true) AS kept, round(cd, 6) AS char_distance, round(wd, 6) AS word_distance, round(wl, 6) AS word_limit FROM base LEFT JOIN d2 USING (doc_id)
"""
