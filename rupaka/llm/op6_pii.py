r"""Personal data: patterns propose spans, checksums confirm them, context words adjust a score.

All of it is column expressions. A pattern's matches and the gaps between them
(``split`` by the same pattern) give every match's position in code points. The
patterns for addresses, numbers and so on use possessive quantifiers and start only
where a run of their characters starts (or where the last match ended), which finds
the same leftmost matches in linear time and without recursion on long runs.

Kinds and their base confidence: email 0.9, ip 0.7, card 0.9 (16 to 19 digits,
Luhn), phone 0.8 (8 to 15 digits); these always stay. The method adds iban (mod-97;
0.8 with the length of its country, else 0.4) and local_phone 0.3 (ten digits in
groups, outside other spans). A context
word of the kind within ``NEAR`` characters adds 0.2; added kinds stay from
``KEEP`` on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rupaka.llm.common import table

NEAR, KEEP, CHUNK = 40, 0.5, 512
#: Characters that an account number with spaces takes at most, and the one after it.
REACH = 34 + 33 + 1

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Where a number may start; iban_at() finds where it ends.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})"
#: Characters of the countries' numbers, spaces not counted.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
LOCAL = r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])"
BASE = ("email", "ip", "card", "phone")
#: Kind, pattern, what a text must hold for the pattern to be tried, confidence, context words.
KINDS = (
    ("email", EMAIL, lambda t: F.contains(t, F.lit("@")), 0.9, "mail|contact|write"),
    ("ip", IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), 0.7, r"\bip\b|address|host|server"),
    ("card", CARD, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), 0.9, "card|credit|visa|payment"),
    ("phone", PHONE, lambda t: F.contains(t, F.lit("+")), 0.8, "phone|call|tel|fax|mobile"),
    ("iban", IBAN, lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]"), 0.8, "iban|bank|account|konto"),
    ("local_phone", LOCAL, lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"), 0.3, "phone|call|tel|fax|mobile"),
)
SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def luhn(number: Column) -> Column:
    """Whether the digits of ``number`` pass the Luhn checksum; other characters are skipped."""
    digits = F.reverse(F.split(F.regexp_replace(number, "[^0-9]", ""), ""))
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    values = F.transform(digits, lambda d, i: F.when(i % 2 == 1, doubled(d.try_cast("int"))).otherwise(d.try_cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number, its first four characters moved to the end and letters read as 10 to 35, leaves 1 over modulo 97."""
    plain = F.replace(code, F.lit(" "), F.lit(""))
    turned = F.filter(F.split(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4)), ""), lambda c: c != "")
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(turned, F.lit(0), step) == 1


def iban_length(number: Column) -> Column:
    """The length of account numbers of a number's country, 34 if it isn't known."""
    return F.coalesce(*(F.when(F.left(number, F.lit(2)).isin(*c.split()), F.lit(n)) for n, c in IBAN_LENGTHS.items()), F.lit(34))


def iban_at(ahead: Column) -> Column:
    """The account number that ``ahead`` (68 characters at least, or up to the text's end) starts with, or null.

    Of the lengths at which no letter or digit follows, the country's own is tried
    first, then the others from the longest; the first that passes mod97() counts.
    """
    lengths = F.concat(F.array(iban_length(ahead)), F.sequence(F.lit(34), F.lit(15), F.lit(-1)))
    cut = lambda n: F.regexp_substr(ahead, F.concat(F.lit(r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){"), (n - 4).cast("string"), F.lit("}(?![A-Za-z0-9])")))
    return F.get(F.filter(F.transform(lengths, cut), lambda x: F.when(x.isNotNull(), CONFIRMS["iban"](x)).otherwise(False)), F.lit(0))


def apart(spans: Column) -> Column:
    """``spans`` without those that start within an earlier one."""
    return F.aggregate(spans, F.array().cast(SPAN), lambda acc, x: F.when((F.size(acc) == 0) | (x.start >= F.element_at(acc, -1).end), F.concat(acc, F.array(x))).otherwise(acc))


def _octets(ip: Column) -> Column:
    return F.forall(F.split(ip, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _digits_between(low: int, high: int):
    return lambda m: F.length(F.regexp_replace(m, "[^0-9]", "")).between(low, high)


#: What confirms a match. Conditions hold in order, so checksums see short strings only.
CONFIRMS = {
    "email": lambda m: F.lit(True),
    "ip": _octets,
    "card": lambda m: F.when(_digits_between(16, 19)(m), luhn(m)).otherwise(False),
    "phone": _digits_between(8, 15),
    "iban": mod97,
    "local_phone": lambda m: F.lit(True),
}


def running_starts(sizes: Column) -> Column:
    """The sum of the sizes before each element, in chunks, so that long arrays don't take quadratic time."""
    chunks = F.when(F.size(sizes) > 0, F.transform(F.sequence(F.lit(0), ((F.size(sizes) - 1) / CHUNK).cast("int")), lambda c: F.slice(sizes, c * CHUNK + 1, CHUNK))).otherwise(F.array().cast("array<array<bigint>>"))

    def before(values: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("a"))
        return F.aggregate(values, start, lambda acc, x: F.struct((acc.s + x).alias("s"), F.concat(acc.a, F.array(acc.s)).alias("a")), lambda acc: acc.a)

    totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x))
    return F.flatten(F.zip_with(chunks, before(totals), lambda c, o: F.transform(before(c), lambda v: v + o)))


def _let(value: Column, f) -> Column:
    """f(value), with ``value`` computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _joined(m: Column, g: Column, i: Column, size: int) -> Column:
    """The text from match ``i`` on, with ``size`` characters past the match as far as there are so many; a match has two characters or more."""
    one = lambda k: F.concat(F.get(m, k), F.left(F.get(g, k + 1), F.lit(size)))
    last = F.least(i + size // 2, F.size(m) - 1)
    return F.array_join(F.transform(F.sequence(i, last), one), "")


def _joined_before(m: Column, g: Column, i: Column, size: int) -> Column:
    """The text up to match ``i``, its last ``size`` characters at least as far as there are so many."""
    one = lambda k: F.concat(F.right(F.get(g, k), F.lit(size)), F.when(k < i, F.get(m, k)).otherwise(""))
    return F.array_join(F.transform(F.sequence(F.greatest(i - size // 2, F.lit(0)), i), one), "")


def _proposed(df: DataFrame, kind: str, pattern: str, tried, confidence: float, words: str) -> DataFrame:
    """Adds the column ``kind``: its confirmed and scored spans."""
    t, m, g, s = F.col("text"), f"m_{kind}", f"g_{kind}", f"s_{kind}"
    df = df.withColumn(m, F.when(tried(t), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(g, F.when(F.size(m) > 0, F.split(t, pattern, -1)).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(s, running_starts(F.transform(m, lambda x, i: (F.length(x) + F.length(F.get(F.col(g), i))).cast("long"))))

    def scored(x: Column, start: Column, before: Column, after: Column) -> Column:
        near = F.lower(F.concat(F.right(before, F.lit(NEAR)), F.lit(" "), F.left(after, F.lit(NEAR))))
        sure = F.lit(confidence) if kind != "iban" else F.when(F.length(F.replace(x, F.lit(" "), F.lit(""))) == iban_length(x), confidence).otherwise(confidence / 2)
        score = sure + F.when(near.rlike(words), 0.2).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), start.cast("long").alias("start"), (start + F.length(x)).cast("long").alias("end"), F.least(score, F.lit(1.0)).alias("score"))

    def span(x: Column, i: Column) -> Column:
        start = F.get(F.col(s), i) + F.length(F.get(F.col(g), i))
        before = _joined_before(F.col(m), F.col(g), i, NEAR)
        if kind != "iban":
            return F.when(CONFIRMS[kind](x), scored(x, start, before, F.substr(_joined(F.col(m), F.col(g), i, NEAR), F.length(x) + 1)))
        whole = lambda ahead, number: F.when(number.isNotNull(), scored(number, start, before, F.substr(ahead, F.length(number) + 1)))
        return _let(_joined(F.col(m), F.col(g), i, REACH + NEAR), lambda ahead: _let(iban_at(ahead), lambda number: whole(ahead, number)))

    found = F.filter(F.transform(m, span), lambda x: x.isNotNull())
    found = apart(found) if kind == "iban" else found
    return df.withColumn(kind, F.when(F.size(m) > 0, found).otherwise(F.array().cast(SPAN))).drop(m, g, s)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, ``spans``: array of (kind, start, end, score), by kind as listed in KINDS, then start; and the columns of docs named in ``keep``.

    Positions are in code points, the end is exclusive. Null texts are taken as
    empty; a text without matches has an empty array. Repeated rows give repeated
    results. Matches of one kind don't overlap; those of different kinds may.
    """
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    for k in KINDS:
        df = _proposed(df, *k)
    base = F.concat(*BASE)
    clear = lambda x, others: ~F.exists(others, lambda b: (x.start < b.end) & (b.start < x.end))
    added = lambda kind, others: F.filter(kind, lambda x: (F.round(x.score, 6) >= KEEP) & clear(x, others))
    df = df.withColumn("base", base).withColumn("iban", added("iban", F.array().cast(SPAN)))
    spans = F.concat("base", "iban", added("local_phone", F.concat("base", "iban")))
    return df.select("doc_id", "text", spans.alias("spans"), *(F.col(f"keep_{c}").alias(c) for c in keep))


def listed(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; spans that overlap are one, named by the one that starts first (then the longest).

    Spans are worked off in groups of CHUNK, each on its own stretch of the text.
    """
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x.start.alias("start"), (-x.end).alias("back"), x.kind.alias("kind"))))
    groups = lambda all_: F.transform(F.sequence(F.lit(0), ((F.size(all_) - 1) / CHUNK).cast("int")), lambda c: F.slice(all_, c * CHUNK + 1, CHUNK))
    state = lambda at: F.struct(at.cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))
    cut = lambda t, start, n: F.substr(t, (start + 1).cast("int"), n.cast("int"))

    def group(acc: Column, xs: Column) -> Column:
        def step(now: Column, x: Column, piece: Column) -> Column:
            fresh = F.struct((-x.back).alias("at"), F.concat(now.parts, F.array(cut(piece, now.at - acc.at, x.start - now.at), F.concat(F.lit("["), F.upper(x.kind), F.lit("]")))).alias("parts"))
            return F.when(x.start >= now.at, fresh).otherwise(F.struct(F.greatest(now.at, -x.back).alias("at"), now.parts.alias("parts")))

        end = F.greatest(acc.at, F.array_max(F.transform(xs, lambda x: -x.back)))
        done = lambda piece: F.aggregate(xs, state(acc.at), lambda now, x: step(now, x, piece), lambda now: F.struct(now.at.alias("at"), F.concat(acc.parts, F.array(F.array_join(now.parts, ""))).alias("parts")))
        return _let(cut(text, acc.at, end - acc.at), done)

    whole = lambda all_: F.aggregate(groups(all_), state(F.lit(0)), group, lambda acc: F.concat(F.array_join(acc.parts, ""), F.substr(text, (acc.at + 1).cast("int"))))
    return F.when(F.size(spans) > 0, _let(ordered, whole)).otherwise(text)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda x: x.kind.isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(of(*BASE)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _matches(kind: str, at: int, pattern: str) -> str:
    """SQL for one kind: every match's text, start and end, and where its neighbours of the kind end and start."""
    return rf"""
{kind}_m AS (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d),
{kind}_i AS (SELECT doc_id, t, m, g, unnest(range(1, len(m) + 1)) AS i FROM {kind}_m WHERE len(m) > 0),
{kind}_w AS (SELECT doc_id, t, m[i] AS w, i, list_sum(list_transform(g[1:i], lambda y: length(y)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0)::BIGINT AS s0 FROM {kind}_i),
{kind}_c AS (SELECT doc_id, t, i, trim_w AS w, s0 + instr(w, trim_w) - 1 AS s FROM (SELECT *, regexp_extract(w, '{TRIMMED.get(kind, "^(.*)$")}', 1) AS trim_w FROM {kind}_w)),
{kind} AS (SELECT doc_id, '{kind}' AS kind, {at} AS nth, w, s, s + length(w) AS e,
  lower(right(t[coalesce(lag(s + length(w)) OVER p, 0) + 1:s], {NEAR}) || ' ' || left(t[s + length(w) + 1:coalesce(lead(s) OVER p, length(t))], {NEAR})) AS near
  FROM {kind}_c WINDOW p AS (PARTITION BY doc_id ORDER BY i))"""


#: The patterns in a dialect without look-around: added kinds take the characters beside them along and drop them again.
RE2 = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?:^|[^A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?:[^A-Za-z0-9]|$)",
    "local_phone": r"(?:^|[^0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?:[^0-9A-Za-z-]|$)",
}
TRIMMED = {"iban": r"([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?:[^A-Za-z0-9]|$)", "local_phone": r"(\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4})(?:[^0-9A-Za-z-]|$)"}
_D = "regexp_replace(w, '[^0-9]', '', 'g')"
_CODE = "replace(w, ' ', '')"

SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{",".join(_matches(k, n, RE2[k]) for n, k in enumerate(RE2))},
ok AS (
SELECT * FROM email
UNION ALL SELECT * FROM ip WHERE len(list_filter(string_split(w, '.'), lambda y: NOT regexp_matches(y, '^0*([0-9]{{1,2}}|1[0-9]{{2}}|2[0-4][0-9]|25[0-5])$'))) = 0
UNION ALL SELECT * FROM card WHERE length({_D}) BETWEEN 16 AND 19 AND list_sum(list_transform(list_reverse(string_split({_D}, '')), lambda c, i:
    CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN 2 * c::INT - 9 ELSE 2 * c::INT END)) % 10 = 0
UNION ALL SELECT * FROM phone WHERE length({_D}) BETWEEN 8 AND 15
UNION ALL SELECT * FROM iban WHERE length({_CODE}) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split({_CODE}[5:] || {_CODE}[1:4], ''), lambda c:
    CASE WHEN c BETWEEN '0' AND '9' THEN unicode(c) - 48 ELSE unicode(c) - 55 END), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97, 0) = 1),
found AS (SELECT doc_id, kind, nth, s, e FROM ok
  UNION ALL SELECT doc_id, kind, nth, s, e FROM local_phone l WHERE regexp_matches(near, 'phone|call|tel|fax|mobile')
    AND NOT EXISTS (SELECT 1 FROM ok WHERE ok.doc_id = l.doc_id AND l.s < ok.e AND ok.s < l.e)),
agg AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY nth, s) FILTER (nth < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY nth, s) AS spans FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN agg USING (doc_id)
"""

QUERIES = {"op6_personal_data": op6_personal_data}
ORACLES = {"op6_personal_data": SQL}
