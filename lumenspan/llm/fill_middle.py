"""Fill-in-middle transformation, in relations of units.

A text's units (its lines, by default) are exploded to (document, ordinal, length) and a window sums their lengths. Cut requests, two
for each document, made of its id's hash, meet the sums by document and ordinal; an aggregate turns the two met rows into a document's
offsets, and substrings between them are prefix, middle and suffix. Only lengths are shuffled and sorted, up to the
later cut; texts travel once, to their offsets.

Documents are told apart by 128 bits of hash of id and text. Units of repeated rows are the same and are aggregated to one before
the window, so a row repeated without end is no long window; its texts meet one row of offsets in a join that AQE can split.

Forms: plain (the text as it is), psm (prefix, suffix, middle) and spm (suffix, prefix, middle), with marks before each part. Texts that
hold a mark stay plain, so a mark in an output is always one that was put there, and restored() finds the parts again: a mark
begins with a character that occurs in no other place of it, so none can arise across the seam of a text and a mark.

Defined cases: null and empty texts have no units and stay plain, the output is the empty text; a null id is hashed as the empty
string; repeated rows are rows of their own with equal results; an empty table gives an empty result; ids other than integers
raise; other columns are kept in the struct `own`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, whole_id, written

#: A unit is a match of this; units have to cover the text, as lines and `(?s).` do.
LINES = r"[^\n]*\n|[^\n]+"
# Marks, the hash's seed, how many of a hundred are transformed, how many of those are spm.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = "7", 100, 50


def _draws(doc_id: Column, seed: str) -> list[Column]:
    """Four numbers of 32 bits, made of an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _forms(docs: DataFrame, text_col: str, id_col: str, seed: str, rate: int, spm: int) -> DataFrame:
    """docs as (own, text, k1, k2, h1, h2, form)."""
    others = [c for c in docs.columns if c != text_col]
    own = F.struct(*map(quoted, others)) if others else F.lit(None).cast("int")
    base = docs.select(own.alias("own"), F.coalesce(quoted(text_col), F.lit("")).alias("text"), whole_id(docs, id_col).alias("id"))
    h1, h2, h3, h4 = _draws(F.col("id"), seed)
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    return base.select("own", "text", F.xxhash64("id", "text").alias("k1"), F.xxhash64(F.lit(seed), "id", "text").alias("k2"), h1.alias("h1"), h2.alias("h2"), form.alias("form"))


def offsets(units: DataFrame, requests: DataFrame) -> DataFrame:
    """(k1, k2, first, second): code points before each of a document's two cuts.

    units: (k1, k2, ordinal from 1, chars), the same unit once or more; requests: (k1, k2, cut, ordinal), the number of units
    before cut 0 and cut 1."""
    key = ["k1", "k2"]
    once = units.groupBy(*key, "ordinal").agg(F.max("chars").alias("chars"))
    running = Window.partitionBy(*key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    sums = once.withColumn("end", F.sum("chars").over(running))
    met = requests.join(sums, [*key, "ordinal"])  # a cut before all units meets none
    at = [F.coalesce(F.max(F.when(F.col("cut") == k, F.col("end"))), F.lit(0)).alias(name) for k, name in enumerate(("first", "second"))]
    return met.groupBy(*key).agg(*at)


def fill_middle(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", units: str = LINES, seed: str = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """(own, n, form, prefix, middle, suffix, output): own holds the other columns of docs, n counts units; the parts are null if plain."""
    made = _forms(docs, text_col, id_col, seed, rate, spm)
    lengths = F.transform(F.regexp_extract_all("text", F.lit(units), F.lit(0)), lambda u: F.char_length(u))
    told = made.where("form <> 'plain'").select("k1", "k2", "h1", "h2", lengths.alias("lengths"))
    n = F.size("lengths") + 1
    one, two = F.col("h1") % n, F.col("h2") % n
    measured = written(told.select("k1", "k2", F.least(one, two).alias("lo"), F.greatest(one, two).alias("hi"), F.slice("lengths", F.lit(1), F.greatest(one, two).cast("int")).alias("lengths")))
    exploded = measured.select("k1", "k2", F.posexplode("lengths").alias("at", "chars")).select("k1", "k2", (F.col("at") + 1).alias("ordinal"), F.col("chars").cast("long").alias("chars"))
    requests = measured.select("k1", "k2", F.posexplode(F.array("lo", "hi")).alias("cut", "ordinal")).select("k1", "k2", "cut", F.col("ordinal").cast("int").alias("ordinal")).distinct()
    found = written(offsets(exploded, requests)).hint("shuffle_hash")
    met = made.join(found, ["k1", "k2"], "left")
    first, second = F.coalesce("first", F.lit(0)), F.coalesce("second", F.lit(0))
    part = lambda start, size: F.when(F.col("form") != "plain", F.substring("text", (start + 1).cast("int"), size.cast("int")))
    cut = met.select(
        "own", F.regexp_count("text", F.lit(units)).cast("long").alias("n"), "form", "text",
        part(F.lit(0), first).alias("prefix"), part(first, second - first).alias("middle"), part(second, F.char_length("text")).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm_ = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm_)
    return cut.select("own", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    part = lambda c, mark, k: F.split_part(c, F.lit(mark), F.lit(k))
    head = part(output, MIDDLE, 1)  # the middle is the last part in either form
    psm = F.concat(part(part(head, PREFIX, 2), SUFFIX, 1), part(output, MIDDLE, 2), part(head, SUFFIX, 2))
    spm = F.concat(part(head, PREFIX, 2), part(output, MIDDLE, 2), part(part(head, SUFFIX, 2), PREFIX, 1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op13_fill_middle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = fill_middle(docs)
    digest = lambda c: F.sha2(c, 256)
    return made.select(
        F.col("own.doc_id").alias("doc_id"), "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


SQL_OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^
]*
|[^
]+') AS units, [('0x' || substr(h, 8 * k + 1, 8))::BIGINT FOR k IN [0, 1, 2, 3]] AS g FROM d),
c AS (SELECT *, len(units)::BIGINT AS n, least(g[1] % (len(units) + 1), g[2] % (len(units) + 1)) AS a, greatest(g[1] % (len(units) + 1), g[2] % (len(units) + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR g[3] % 100 >= 100 THEN 'plain' WHEN g[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
