"""One text of 5 MB without spaces through the operators that split words: bounded work and whole results."""

import random

from pyspark.sql import functions as F

from rupaka.llm import op1_token_counts as op1, op4_language as op4, op5_pieces as op5, op6_pii as op6, op10_chat as op10

SIZE = 5_000_000


def text(alphabet="abcdefghijklmnopqrstuvwxyz0123456789"):
    r = random.Random(1)
    block = "".join(r.choice(alphabet) for _ in range(50_000))
    return block * (SIZE // len(block))


def test_token_counts(spark):
    t = text("etaoin shrdlu".replace(" ", ""))
    short = t[:20_000]
    df = spark.createDataFrame([(1, t), (2, short)], "doc_id long, text string")
    got = {r.doc_id: r for r in op1.token_counts(df).collect()}
    c = op1.counter(op1.vocabulary_path(op1.MODEL))
    assert got[1].n_bytes == SIZE and got[2].n_tokens == len(c.sp.encode(short)) and got[1].n_tokens > 200 * got[2].n_tokens
    c.counts([t])
    assert max(map(len, c.known)) <= op1.SHORT


def test_language(spark):
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the thing is that", "en"), ("die sache ist das", "de")] * 5)], "doc_id long, text string, lang string")
    m = op4.fit(train)
    df = spark.createDataFrame([(1, "thething" * (SIZE // 8)), (2, "the thing " * (SIZE // 10))], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in op4.predict(df, m).collect()} == {1: "en", 2: "en"}
    assert "".join(op4.parts_of("a1" * 200_000)) == "a1" * 200_000


def test_pieces(spark):
    rows = [(1, text()), (2, " " * SIZE), (3, "é☃" * 400_000)]
    got = op5.round_trip(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "lossless", F.size("ids").alias("n")).collect()
    assert all(r.lossless for r in got) and len(got) == 3 and all(r.n > 0 for r in got)
    assert max(map(len, op5.chunks(rows[0][1]))) <= op5.WIDEST and "".join(op5.chunks(rows[0][1])) == " " + rows[0][1]


def test_personal_data(spark):
    many = "".join(f"mail a{k}@b.org or +49 30 {1000000 + k} now " for k in range(8000))
    t = text("abcdefghijkl") + many
    df = spark.createDataFrame([(1, t)], "doc_id long, text string")
    found = op6.find_pii(df)
    r = found.select(F.size("spans").alias("n"), op6.redacted(F.col("text"), F.col("spans")).alias("clean")).first()
    assert r.n == 16_000 and r.clean == text("abcdefghijkl") + "mail [EMAIL] or [PHONE] now " * 8000


def test_overlaps_are_redacted_as_one(spark):
    spans = "array(named_struct('kind', 'card', 'start', 0L, 'end', 4L, 'score', 1d), named_struct('kind', 'phone', 'start', 2L, 'end', 8L, 'score', 1d), named_struct('kind', 'ip', 'start', 9L, 'end', 10L, 'score', 1d))"
    df = spark.createDataFrame([("012345678xyz",)], "text string").withColumn("spans", F.expr(spans))
    assert df.select(op6.redacted(F.col("text"), F.col("spans"))).first()[0] == "[CARD]8[IP]yz"


def test_chat(spark):
    rows = [(1, 0, "user", text()), (1, 1, "user", "again"), (2, 0, "assistant", None)]
    got = {(r.conv_id, r.turn): r for r in op10.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == 3 and SIZE < len(got[1, 0].part) < SIZE + 50


def brute(turns):
    """The least cost of any legal repair, by trying every role and merge for every turn."""
    def cost(seq):
        best = None
        todo = [(0, op10.START, 0)]
        while todo:
            k, state, c = todo.pop()
            if best is not None and c >= best:
                continue
            if k == len(seq):
                c += op10.INSERT * len(op10.closing(state))
                best = c if best is None else min(best, c)
                continue
            own = op10.ROLES.index(seq[k]) + 1 if seq[k] in op10.ROLES else 0
            for r in (1, 2, 3):
                other = 0 if r == own else op10.RELABEL if own else op10.UNKNOWN
                if state == r:
                    todo.append((k + 1, r, c + op10.MERGE + other))
                if (way := op10.inserted(state, r)) is not None:
                    todo.append((k + 1, r, c + other + op10.INSERT * len(way)))
        return best

    return cost(turns)


def test_chat_rows_cost_the_least(spark):
    """The query's rows, priced by what they say, cost what the cheapest of all repairs costs."""
    r = random.Random(6)
    convs = {i: [r.choice(["system", "user", "assistant", "tool", None]) for _ in range(r.randrange(1, 7))] for i in range(60)}
    rows = [(i, k, role, f"t{k}") for i, roles in convs.items() for k, role in enumerate(roles)]
    out = op10.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for i, roles in convs.items():
        price = 0
        for row in (x for x in out if x.conv_id == i):
            if "merge" in row.action:
                price += op10.MERGE
            if row.new_role != row.role:
                price += op10.RELABEL if row.role in op10.ROLES else op10.UNKNOWN
            price += op10.INSERT * len([x for x in row.inserted.split(",") if x])
        assert price == brute(roles), (roles, price)
