"""Queries over term tables and carried state, on whole conversations, documents and event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rupaka.functions import text as x
from rupaka.operators import bigram, context, disambiguate as dis, gender, vocabulary
from rupaka.operators.scan import counted
from rupaka.operators.terms import Terms, marked, marked_by_join
from rupaka.plans.registry import frame, query, table, values
from rupaka.sources import lexicons, shared, sinks

# RE2 and Java spell the same class of white space differently
WORDS = r"list_filter(string_split_regex(text, '[\s\x0b\x1c-\x1f\x{85}\pZ]+'), lambda t: t <> '')"

#: From k(sent_id, ts) and m(ord, term, len): the matches of each sentence, in the order in which they win where their words are free.
CHOSEN = """g AS (SELECT sent_id, ts, unnest(range(0, len(ts))) AS pos FROM k),
gl AS (SELECT sent_id, pos, l.len, array_to_string(ts[pos + 1:pos + l.len], ' ') AS term FROM g JOIN (SELECT DISTINCT len FROM m) l ON pos + l.len <= len(ts)),
h AS (SELECT sent_id, list({'pos': pos, 'len': gl.len, 'ord': ord} ORDER BY gl.len DESC, ord, pos) AS hs FROM gl JOIN m ON m.term = gl.term AND m.len = gl.len GROUP BY sent_id),
ch AS (SELECT sent_id, list_reduce(hs, lambda a, y: CASE WHEN len(list_filter(a, lambda b: b.pos < y.pos + y.len AND y.pos < b.pos + b.len)) = 0 THEN list_append(a, y) ELSE a END,
                                   list_filter(hs, lambda y: false)) AS c FROM h),
cu AS (SELECT sent_id, unnest(c) AS c FROM ch),
sp AS (SELECT sent_id, c.pos AS pos, c.len AS len, c.ord AS ord FROM cu)"""


def benchmark_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first one to five words of each item; a term table, in order of their text."""
    w = table(spark, sf_dir, "benchmark").select(x.tokens("text").alias("ts"))
    w = w.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda n: F.when(F.size("ts") >= n, F.array_join(F.slice("ts", 1, n), " ")))).alias("term"))
    return w.filter("term is not null").distinct().withColumn("kind", F.lit("compound"))


BENCH = f"""b AS (SELECT {WORDS} AS ts FROM benchmark), bt AS (SELECT unnest(list_transform(range(1, least(5, len(ts)) + 1), lambda n: array_to_string(ts[1:n], ' '))) AS term FROM b),
m AS (SELECT row_number() OVER (ORDER BY term) - 1 AS ord, term, len(string_split(term, ' ')) AS len FROM (SELECT DISTINCT term FROM bt))"""


@query("term_spans_documents", f"WITH k AS (SELECT doc_id AS sent_id, {WORDS} AS ts FROM documents), {BENCH}, {CHOSEN} SELECT sent_id AS doc_id, pos::BIGINT AS pos, sp.len::BIGINT AS n_words, term FROM sp JOIN m USING (ord)")
def term_spans_documents(spark, sf_dir):
    """Beginnings of benchmark items, of one to five words, in all documents: longest first, without overlaps."""
    found = Terms.read(benchmark_terms(spark, sf_dir))
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "sent_id")
    names = F.array(*map(F.lit, found.compounds)) if found.compounds else F.array().cast("array<string>")
    out = marked(docs, found).filter("starts").withColumn("term", F.get(names, F.col("term")))
    return out.select(F.col("sent_id").alias("doc_id"), F.col("pos").cast("long").alias("pos"), F.size(F.split("term", " ")).cast("long").alias("n_words"), "term")


@query("term_spans_turns", f"WITH k AS (SELECT conv_id || ':' || turn AS sent_id, {WORDS} AS ts FROM conversations), {BENCH}, {CHOSEN} SELECT sent_id, pos::BIGINT AS pos, ord::BIGINT AS term FROM sp")
def term_spans_turns(spark, sf_dir):
    """The same in conversations, by the join that serves tables too large for an automaton."""
    found = benchmark_terms(spark, sf_dir).select("term", (F.row_number().over(context.Window.orderBy("term")) - 1).alias("ord"))
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("sent_id"), "text")
    return marked_by_join(turns, found, 5).filter("starts").select("sent_id", F.col("pos").cast("long").alias("pos"), F.col("term").cast("long").alias("term"))


#: A table of Latin words: (term, kind, value, number).
LATIN = [
    *((w, "clitic", None, None) for w in ("as", "en", "er")), *((w, "postposition", None, None) for w in ("of", "in", "de", "to", "que")),
    *((w, "oblique", None, None) for w in ("of", "in", "de", "was", "la")), *((w, "singular", None, None) for w in ("a", "un", "ein", "that")),
    *((w, "plural", None, None) for w in ("is", "der", "les")), ("the", "genitive", "M", "SG"), ("la", "genitive", "F", None), ("a", "genitive", "M", "PL"), ("de", "genitive", "F", "PL"),
    ("it", "negation", "nahi", None), ("th", "negation", "mat", None), ("he", "negation", "nahi", None), ("and", "conjunction", None, None), ("und", "conjunction", None, None), ("et", "conjunction", None, None),
    *((c, "compound", None, None) for c in ("of the", "the of", "in the of", "to the of the", "la de la", "de la", "and the the of the", "the the", "it to", "der und")),
]
COMPOUNDS = list(dict.fromkeys(t for t, k, *_ in LATIN if k == "compound"))
TURNS = f"k AS (SELECT conv_id || ':' || turn AS sent_id, {WORDS} AS ts FROM conversations)"
MARKED = f"""{values('m', 'ord, term, len', [(i, c, len(c.split(' '))) for i, c in enumerate(COMPOUNDS)])}, {CHOSEN},
tk AS (SELECT sent_id, generate_subscripts(ts, 1) - 1 AS pos, unnest(ts) AS token FROM k),
mk AS (SELECT tk.*, a.pos IS NOT NULL AS starts, b.pos IS NOT NULL AS inside FROM tk LEFT JOIN sp a ON a.sent_id = tk.sent_id AND a.pos = tk.pos
       LEFT JOIN sp b ON b.sent_id = tk.sent_id AND tk.pos >= b.pos AND tk.pos < b.pos + b.len)"""


def one_of(kind: str) -> str:
    return "token IN (" + ", ".join(f"'{t}'" for t, k, *_ in LATIN if k == kind) + ")"


def given(kind: str, k: int) -> str:
    return "CASE token " + " ".join(f"WHEN '{r[0]}' THEN " + (f"'{r[k]}'" if r[k] else "NULL") for r in LATIN if r[1] == kind) + " END"


#: The nearest other token on either side, as arrays of what it signals.
SIGNALS = f"""s AS (SELECT *, NOT {one_of('clitic')} AS content, {{'c': starts, 's': NOT inside AND {one_of('oblique')}}} AS right_,
  {{'g': CASE WHEN NOT inside THEN {given('genitive', 2)} END, 'n': CASE WHEN inside THEN NULL WHEN {one_of('singular')} THEN 'SG' WHEN {one_of('plural')} THEN 'PL' ELSE {given('genitive', 3)} END}} AS left_,
  CASE WHEN inside THEN NULL WHEN suffix(token, 'ing') THEN 'F PL' WHEN suffix(token, 'ed') THEN 'M SG' END AS verb, CASE WHEN NOT inside THEN {given('negation', 2)} END AS neg FROM mk),
n AS (SELECT *, first_value(CASE WHEN content THEN right_ END IGNORE NULLS) OVER a AS r, last_value(CASE WHEN content THEN left_ END IGNORE NULLS) OVER p AS l,
  first_value(verb IGNORE NULLS) OVER a AS v, first_value(neg IGNORE NULLS) OVER w AS negation FROM s
  WINDOW a AS (PARTITION BY sent_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), p AS (PARTITION BY sent_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         w AS (PARTITION BY sent_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("sent_id"), "text")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(conversations(spark, sf_dir), Terms(LATIN))


@query("signals_turns", f"""WITH {TURNS}, {MARKED}, {SIGNALS} SELECT sent_id, pos::INT AS pos, token, starts, inside, content AND coalesce(r.c OR (r.s AND NOT {one_of('postposition')}), false) AS oblique,
CASE WHEN content THEN l.g END AS gender_signal, CASE WHEN content THEN l.n END AS number_signal, negation, split_part(v, ' ', 1) AS verb_gender, split_part(v, ' ', 2) AS verb_number FROM n""")
def signals_turns(spark, sf_dir):
    """Signals of a Latin term table in all conversations; words in -ed and -ing agree like verbs, those in -s have a reading that doesn't."""
    read = lambda *r: F.array(*(F.struct(F.lit(g).alias("gender"), F.lit(n).alias("number")) for g, n in r)).cast("array<struct<gender:string,number:string>>")
    verbs = lambda w: F.when(w.endswith("ing"), read((None, "S"), ("F", "P"), ("M", "S"))).when(w.endswith("ed"), read(("M", "S"))).when(w.endswith("s"), read((None, "P"), ("M", None))).otherwise(read())
    out = context.signals_of(conversations(spark, sf_dir), verbs, Terms(LATIN))
    return out.select("sent_id", "pos", "token", "starts", F.col("term").isNotNull().alias("inside"), "oblique", "gender_signal", "number_signal", "negation", F.col("agreement.gender").alias("verb_gender"), F.col("agreement.number").alias("verb_number"))


# ── carried state ──

#: Successors of a class: (known, all others).
MODEL = {"A": ({"B": 0.9, "C": 0.2}, 0.1), "B": ({"C": 0.8, "A": 0.3}, 0.05), "C": ({"A": 0.7, "B": 0.1}, 0.2)}
#: Classes that an event or a word may have, by its kind.
READINGS = {"view": "A", "signup": "BC", "click": "AB", "error": "", "purchase": "ABCD"}
ENDINGS = {"e": "AB", "n": "BC", "s": "AC", "t": "ABC", "d": "A", "a": "B", "o": "CD", "r": "D"}


def readings(kind, mapping: dict):
    """Candidates of the classes that a kind may have; those of class D agree with no signal."""
    one = lambda c: F.struct(*(F.lit(v).alias(k) for k, v in (("lemma", c), ("gender", "M"), ("number", "SG"), ("case", "DIR"), ("paradigm", c))))
    none = F.array().cast("array<struct<lemma:string,gender:string,number:string,case:string,paradigm:string>>")
    out = F.when(F.lit(False), none)
    for k, classes in mapping.items():
        out = out.when(kind == k, F.array(*map(one, classes)) if classes else none)
    return out.otherwise(none)


def scores(mapping: dict, kind: str, prev: str) -> str:
    """SQL: the class in force after a row of a kind, after another: the one best class, or the one before."""
    p = lambda a, b: MODEL[a][0].get(b, MODEL[a][1]) if a in MODEL else 0.0
    out = []
    for k, classes in mapping.items():
        for a in (*MODEL, "D", None):
            own = {c: (2 if c == "A" else 0) + 2 * p(a, c) for c in classes}
            top = list(classes) if all(v == 0 for v in own.values()) else [c for c in classes if own[c] == max(own.values())]
            if len(top) == 1:
                out.append(f"WHEN {kind} = '{k}' AND {prev} = '{a or ''}' THEN '{top[0]}'")
    return "CASE " + " ".join(out) + f" ELSE {prev} END"


@query("class_state_events", f"""WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, list(event_type ORDER BY i) AS k, list(event_id ORDER BY i) AS ids FROM e GROUP BY user_id),
s AS (SELECT ids, list_reduce(k, lambda a, y: list_append(a, {scores(READINGS, 'y', 'a[-1]')}), ['']) AS states FROM r)
SELECT unnest(ids) AS event_id, nullif(CASE unnest(states[1:len(ids)]) WHEN 'D' THEN '' ELSE unnest(states[1:len(ids)]) END, '') AS previous FROM s""")
def class_state_events(spark, sf_dir):
    """The class in force before every event of a user, under a bigram model of classes."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", readings(F.col("event_type"), READINGS).alias("noun_candidates"))
    e = e.withColumn("at", F.row_number().over(context.Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    out = dis.with_class_state(e.select("user_id", "at", "event_id", "noun_candidates"), MODEL, first_class, ["user_id"], "at")
    return out.select("event_id", "previous")


def first_class(c):
    return F.when(c.paradigm == "A", 2.0).otherwise(0.0)


@query("class_state_documents", f"""WITH k AS (SELECT doc_id, list_transform({WORDS}, lambda t: right(t, 1)) AS k FROM documents)
SELECT doc_id, len(k)::BIGINT AS n, nullif(replace(s.c, 'D', ''), '') AS last_class, s.a AS n_a, s.b AS n_b, s.d AS n_c FROM (SELECT doc_id, k, list_reduce(list_transform(k, lambda y: {{'c': y, 'a': 0::BIGINT, 'b': 0::BIGINT, 'd': 0::BIGINT}}),
  lambda z, y: {{'c': {scores(ENDINGS, 'y.c', 'z.c')}, 'a': z.a + (z.c = 'A')::BIGINT, 'b': z.b + (z.c = 'B')::BIGINT, 'd': z.d + (z.c = 'C')::BIGINT}},
  {{'c': '', 'a': 0::BIGINT, 'b': 0::BIGINT, 'd': 0::BIGINT}}) AS s FROM k WHERE len(k) > 0)""")
def class_state_documents(spark, sf_dir):
    """Whole documents as one sequence each: how many words stand after each class, and the class in force at the end.

    A document's words are in one row, so their state is carried within the row and no word is shuffled.
    """
    ends = frame(spark, "end string", [(e,) for e in ENDINGS]).withColumn("noun_candidates", readings(F.col("end"), ENDINGS))
    ends = ends.select("end", dis.class_step(MODEL, first_class).alias("known"))  # the words' steps go by their ends, so each is computed once
    steps = ends.agg(F.map_from_entries(F.collect_list(F.struct("end", "known"))).alias("steps"))
    docs = table(spark, sf_dir, "documents").select("doc_id", x.tokens("text").alias("ts")).filter(F.size("ts") > 0).crossJoin(F.broadcast(steps))
    named = ("A", "B", "C")  # class_states() after the first
    kinds = F.transform("ts", lambda t: F.try_element_at("steps", F.right(t, F.lit(1))))
    counts = counted(kinds, len(named) + 1).alias("c")
    n = lambda c: F.get("c.counts", F.lit(1 + named.index(c))).alias(f"n_{c.lower()}")
    return docs.select("doc_id", F.size("ts").cast("long").alias("n"), counts).select("doc_id", "n", F.get(dis.class_states(MODEL), "c.state").alias("last_class"), *map(n, named))


# ── coordination ──

CASES = {"ed": "OBL", "ing": "DIR", "e": "DIR,OBL", "n": "OBL,DIR", "s": "DIR", "t": "OBL", "on": "DIR,OBL", "and": "DIR,OBL"}


def case_of(sql: bool):
    """Cases by a word's end; the longest end counts."""
    ends = sorted(CASES.items(), key=lambda x: (-len(x[0]), x[0]))
    if sql:
        return "CASE " + " ".join(f"WHEN suffix(token, '{e}') THEN '{c}'" for e, c in ends) + " ELSE '' END"
    out = F.when(F.lit(False), F.lit(""))
    for e, c in ends:
        out = out.when(F.col("token").endswith(e), F.lit(c))
    return out.otherwise(F.lit(""))


#: A fold over each turn's conjunctions, in order, with all words' cases as the state.
COORDINATED = f"""t0 AS (SELECT sent_id, generate_subscripts(ts, 1) AS i, unnest(ts) AS token FROM k),
t1 AS (SELECT *, {case_of(True)} AS c FROM t0), t2 AS (SELECT *, CASE WHEN NOT {one_of('clitic')} AND c <> '' THEN i END AS bears FROM t1),
t3 AS (SELECT *, last_value(bears IGNORE NULLS) OVER (PARTITION BY sent_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
              first_value(bears IGNORE NULLS) OVER (PARTITION BY sent_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM t2),
o AS (SELECT sent_id, list(c ORDER BY i) AS cs, list(token ORDER BY i) AS ts FROM t3 GROUP BY sent_id),
j AS (SELECT sent_id, list({{'l': l, 'r': r}} ORDER BY i) AS js FROM t3 WHERE {one_of('conjunction')} AND l IS NOT NULL AND r IS NOT NULL GROUP BY sent_id),
f AS (SELECT sent_id, ts, cs, CASE WHEN js IS NULL THEN cs ELSE list_reduce(list_transform(js, lambda y: [y.l::VARCHAR, y.r::VARCHAR]), lambda a, y:
  CASE WHEN NOT contains(a[y[1]::BIGINT], ',') AND contains(a[y[2]::BIGINT], ',') THEN list_transform(a, lambda v, q: CASE WHEN q = y[2]::BIGINT THEN a[y[1]::BIGINT] ELSE v END)
       WHEN NOT contains(a[y[2]::BIGINT], ',') AND contains(a[y[1]::BIGINT], ',') THEN list_transform(a, lambda v, q: CASE WHEN q = y[1]::BIGINT THEN a[y[2]::BIGINT] ELSE v END) ELSE a END, cs) END AS after FROM o LEFT JOIN j USING (sent_id))"""


@query("coordination_turns", f"""WITH {TURNS}, {COORDINATED}, x AS (SELECT sent_id, generate_subscripts(ts, 1) - 1 AS pos, unnest(ts) AS token, unnest(cs) AS before, unnest(after) AS cases FROM f)
SELECT sent_id, pos::INT AS pos, token, cases, before <> cases AS passed FROM x WHERE before <> ''""")
def coordination_turns(spark, sf_dir):
    """Cases passed across the conjunctions of all conversations, among words whose ends say which cases they may have."""
    one = lambda c: F.struct(F.lit("x").alias("lemma"), c.alias("case"))
    cands = F.transform(F.filter(F.split(case_of(False), ","), lambda c: c != ""), one)
    df = turns(spark, sf_dir).withColumn("noun_candidates", cands).withColumn("signals_applied", F.array().cast("array<string>"))
    roles = Terms(LATIN).roles(spark).select(F.col("token").alias("word"), "clitic", "conjunction")
    out = dis.coordinated(df.join(roles, F.col("token") == F.col("word"), "left"), ["sent_id"])
    out = out.filter(F.size("noun_candidates") > 0)
    return out.select("sent_id", "pos", "token", F.array_join(F.transform("noun_candidates", lambda c: c["case"]), ",").alias("cases"), (F.size("signals_applied") > 0).alias("passed"))


# ── a sparse bigram model ──

def neighbours(df: DataFrame, key: str) -> DataFrame:
    """key, prev, curr: adjacent words of (key, text)."""
    ts = df.select(key, x.tokens("text").alias("ts")).filter(F.size("ts") > 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size("ts") - 1), lambda i: F.struct(F.get("ts", i - 1).alias("prev"), F.get("ts", i).alias("curr")))
    return ts.select(key, F.explode(pairs).alias("p")).select(key, "p.*")


def begun(df: DataFrame) -> DataFrame:
    """prev, total: every word of the adjacent words of (text), and how many pairs it begins."""
    ts = df.select(x.tokens("text").alias("ts")).filter(F.size("ts") > 1)
    each = F.transform("ts", lambda w, i: F.struct(w.alias("prev"), (i < F.size("ts") - 1).cast("long").alias("n")))
    return ts.select(F.explode(each).alias("w")).groupBy("w.prev").agg(F.sum("w.n").alias("total"))


PAIRS = "unnest(ts[1:len(ts) - 1]) AS prev, unnest(ts[2:]) AS curr"


@query("bigram_scores_turns", f"""WITH d AS (SELECT {WORDS} AS ts FROM documents), k AS (SELECT conv_id || ':' || turn AS sent_id, {WORDS} AS ts FROM conversations),
c AS (SELECT prev, curr, count(*) AS n FROM (SELECT {PAIRS} FROM d) GROUP BY ALL), v AS (SELECT count(*) AS v FROM (SELECT prev FROM c UNION SELECT curr FROM c)),
t AS (SELECT prev, sum(n) AS total FROM c GROUP BY prev), q AS (SELECT sent_id, {PAIRS} FROM k),
s AS (SELECT sent_id, n IS NOT NULL AS seen, CASE WHEN total IS NULL THEN 0 ELSE (coalesce(n, 0) + 0.1::DOUBLE) / (total::DOUBLE + 0.1::DOUBLE * v) END AS p FROM q LEFT JOIN c USING (prev, curr) LEFT JOIN t USING (prev) CROSS JOIN v)
SELECT sent_id, count(*)::BIGINT AS n, count(*) FILTER (seen)::BIGINT AS n_seen, count(*) FILTER (p > 0)::BIGINT AS n_known, sum(round(p, 12)::DECIMAL(24, 12))::DOUBLE AS total FROM s GROUP BY sent_id""")
def bigram_scores_turns(spark, sf_dir):
    """The adjacent words of all conversations under a model of all documents' adjacent words."""
    docs = table(spark, sf_dir, "documents")
    counts = neighbours(docs, "doc_id").groupBy("prev", "curr").agg(F.count("*").alias("n"))
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("sent_id"), "text")
    out = bigram.scored(neighbours(turns, "sent_id"), bigram.sparse_model(counts, words=begun(docs)))
    total = F.sum(F.round("p", 12).cast("decimal(24,12)")).cast("double")
    return out.groupBy("sent_id").agg(F.count("*").alias("n"), F.count_if("seen").alias("n_seen"), F.count_if(F.col("p") > 0).alias("n_known"), total.alias("total"))


# ── lines of files ──

@query("lexicon_of_lines", f"""WITH d AS (SELECT doc_id, lang, {WORDS} AS ts FROM documents), t AS (SELECT doc_id, lang, generate_subscripts(ts, 1) AS i, unnest(ts) AS word FROM d),
n AS (SELECT *, row_number() OVER (ORDER BY doc_id, i) AS n FROM t) SELECT word, count(*)::BIGINT AS times, max(n)::BIGINT AS last_line, arg_max(lang, n) AS lang FROM n GROUP BY word""")
def lexicon_of_lines(spark, sf_dir):
    """All words of the documents written as lines of text files, read back with their numbers; of a word's lines the last counts."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared.new_path(spark)
    # whole texts are shuffled, not words; the words of several texts of one id take turns
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text").repartitionByRange(n, "doc_id")
    words = docs.select("doc_id", "lang", F.posexplode(x.tokens("text")).alias("i", "word"))
    words.sortWithinPartitions("doc_id", "i").select(F.concat_ws("\t", "word", "lang")).write.text(path)
    f = F.split("line", "\t")
    lines = lexicons.ordered_lines(spark, path).select(F.get(f, F.lit(0)).alias("word"), F.get(f, F.lit(1)).alias("lang"), "n")
    return lines.groupBy("word").agg(F.count("*").alias("times"), F.max("n").alias("last_line"), F.max_by("lang", "n").alias("lang"))


@query("routes_written", """WITH p AS (SELECT vec_id::VARCHAR AS word, 1 / (1 + exp(-4 * embedding[1]::DOUBLE)) AS m FROM embeddings),
q AS (SELECT word, CASE WHEN m >= 0.5 THEN 'M2' ELSE 'F3' END AS paradigm_class, greatest(m, 1 - m) AS p FROM p),
r AS (SELECT *, CASE WHEN p >= 0.8 THEN 'high' WHEN p >= 0.65 THEN 'medium' WHEN p >= 0.55 THEN 'low' ELSE 'abstain' END AS tier FROM q)
SELECT word, paradigm_class, 'predicted_' || tier AS confidence, format('{:.4f}', p) AS probability, CASE WHEN tier IN ('high', 'medium') THEN 'predicted' WHEN tier = 'low' THEN 'review' ELSE 'abstain' END AS route FROM r""")
def routes_written(spark, sf_dir):
    """The three lists of predictions, written in one job and read back, for probabilities taken from all vectors."""
    m = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("word"), (1 / (1 + F.exp(-4 * F.get("embedding", F.lit(0)).cast("double")))).alias("m"))
    p = m.withColumn("gender", F.when(F.col("m") >= 0.5, "M").otherwise("F")).withColumn("probability", F.greatest("m", 1 - F.col("m")))
    path = shared.new_path(spark)
    sinks.write_routes(p.select("word", gender.class_of(F.col("gender")).alias("paradigm_class"), gender.tier(F.col("probability")).alias("tier"), "probability"), path)
    return sinks.read_routes(spark, path)


# ── dictionaries ──

GRAMS = f"""dw AS (SELECT DISTINCT unnest({WORDS}) AS word FROM documents),
dg AS (SELECT word, unnest(list_distinct(flatten(list_transform(range(1, 5), lambda n: list_transform(range(1, length(w) - n + 2), lambda i: w[i:i + n - 1]))))) AS gram
       FROM (SELECT word, lower(array_to_string(list_reverse(regexp_extract_all(word, '(?s).[़्]*')), '')) AS w FROM dw)),
dn AS (SELECT gram, count(*) AS n FROM dg GROUP BY gram HAVING count(*) >= 2), di AS (SELECT gram, n, row_number() OVER (ORDER BY gram) - 1 AS id FROM dn)"""


def document_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.gram_rows(table(spark, sf_dir, "documents").select(F.explode(x.tokens("text")).alias("word")))


@query("gram_dictionary", f"WITH {GRAMS} SELECT gram, n::BIGINT AS n, id::BIGINT AS id FROM di")
def gram_dictionary(spark, sf_dir):
    """Dense ids and frequencies of the n-grams of all distinct words that two words have or more."""
    return vocabulary.dictionary(document_grams(spark, sf_dir), "gram", 2)


@query("gram_ids_of_words", f"WITH {GRAMS} SELECT word, count(id)::BIGINT AS n, min(id)::BIGINT AS first_id, max(id)::BIGINT AS last_id, coalesce(sum(id), 0)::BIGINT AS total FROM dg LEFT JOIN di USING (gram) GROUP BY word")
def gram_ids_of_words(spark, sf_dir):
    """All distinct words as rows of n-gram ids."""
    rows = document_grams(spark, sf_dir)
    ids = vocabulary.encoded(rows, "word", "gram", vocabulary.dictionary(rows, "gram", 2))
    total = F.aggregate("ids", F.lit(0).cast("long"), lambda a, i: a + i)
    return ids.select("word", F.size("ids").cast("long").alias("n"), F.array_min("ids").alias("first_id"), F.array_max("ids").alias("last_id"), total.alias("total"))
