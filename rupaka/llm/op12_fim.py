r"""Fill-in-middle transformation with relational units.

Each text is cut into units that tile it (lines by default). Units become rows of
their length (posexplode); a window's running sum of lengths gives each unit's end;
the two cuts of a document are requests that join its units by ordinal; the offsets
are aggregated per document, and substring then takes prefix, middle and suffix.

Units, requests and offsets are rows of numbers; texts are shuffled once, to meet
their offsets, in a plain join, which Spark splits where a row repeats very often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rupaka.llm.common import table

#: A line with its end, or a last one without.
LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


def draws(id_text: Column, seed: int, count: int = 4) -> list[Column]:
    """The first 8-digit groups of the hexadecimal sha256 of ``seed:id``, as unsigned integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), id_text).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(count)]


def after(text: Column, start: Column) -> Column:
    return F.substr(text, start, F.length(text))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of: in psm and spm each sentinel stands there once."""
    first, second, third = (F.instr(output, s) for s in (PREFIX, SUFFIX, MIDDLE))
    part = lambda start, end: F.substr(output, start + 3, end - start - 3)
    psm = F.concat(part(F.lit(1), second), after(output, third + 3), part(second, third))
    spm = F.concat(part(first, third), after(output, third + 3), part(F.lit(1), first))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, unit: str = LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n (units), form, prefix, middle, suffix (null if plain) and output for every row of docs.

    ``rate`` percent of the documents are transformed, ``spm`` percent of those with the
    suffix first. ``unit`` is a pattern of units; texts that its matches don't tile, that are empty or
    hold a sentinel stay plain. Null texts count as empty, a null id as an empty one in
    the draw. Repeated rows each give a row, rows that share an id each one of their own
    text. A table without rows gives none.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    key = [F.xxhash64("doc_id", "text").alias("k"), F.length("text").alias("chars")]  # rows that share id and key are equal
    h1, h2, h3, h4 = draws(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed)
    sizes = F.transform(F.regexp_extract_all("text", F.lit(unit), F.lit(0)), lambda u: F.length(u))
    # the outer form, since the other one gets a filter that matches the pattern a second time
    units = d.select("doc_id", *key, F.posexplode_outer(sizes).alias("at", "size")).filter("at is not null")
    units = units.groupBy("doc_id", "k", "chars", "at").agg(F.max("size").alias("size"))  # rows that repeat have equal units
    so_far = Window.partitionBy("k", "chars").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = units.withColumn("end", F.sum("size").over(so_far))
    counts = units.groupBy(F.col("k").alias("own"), F.col("chars").alias("length")).agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("n"), F.sum("size").alias("tiled"))
    asked = counts.withColumn("cut", F.array_sort(F.array(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1))))
    asked = asked.select("own", "length", "n", "tiled", F.posexplode("cut").alias("which", "ordinal"))
    # the unit whose number is the ordinal, as a range: all these rows stay parted by document. A cut before the first unit meets none
    here = (F.col("at") < F.col("ordinal")) & (F.col("ordinal") <= F.col("at") + 1)
    met = asked.join(ends, (F.col("own") == F.col("k")) & (F.col("length") == F.col("chars")) & here, "left")
    sides = (F.max(F.when(F.col("which") == k, F.coalesce("end", F.lit(0)))).cast("int").alias(c) for k, c in enumerate(("low", "high")))
    offsets = met.groupBy("own", "length").agg(F.max("n").alias("n"), F.max("tiled").alias("tiled"), *sides)
    joined = d.select("*", *key).join(offsets, (F.col("k") == F.col("own")) & (F.col("chars") == F.col("length")), "left")
    text = F.col("text")
    plain = (F.coalesce("tiled", F.lit(0)) != F.col("chars")) | (text == "") | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE)) | (h3 % 100 >= rate)
    form = F.when(plain, PLAIN).when(h4 % 100 < spm, SPM).otherwise(PSM)
    out = joined.select("doc_id", "text", F.coalesce("n", F.lit(0)).cast("long").alias("n"), form.alias("form"), "low", "high")
    cut = lambda c: F.when(F.col("form") != PLAIN, c)
    out = out.select(
        "doc_id", "text", "n", "form",
        cut(F.substr("text", F.lit(1), F.col("low"))).alias("prefix"),
        cut(F.substr("text", F.col("low") + 1, F.col("high") - F.col("low"))).alias("middle"),
        cut(after(F.col("text"), F.col("high") + 1)).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm_form = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    return out.withColumn("output", F.when(F.col("form") == PSM, psm).when(F.col("form") == SPM, spm_form).otherwise(F.col("text")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS u,
             ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS i, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS j,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, n, form, text, array_to_string(u[1:i], '') AS p, array_to_string(u[i + 1:j], '') AS m, array_to_string(u[j + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p
"""

QUERIES = {"op12_fill_in_middle": op12_fill_in_middle}
ORACLES = {"op12_fill_in_middle": SQL}
