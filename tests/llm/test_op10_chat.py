import itertools
import random
import re

from rupaka.llm import op10_chat as op10


def cheapest(conv, turns):
    """The cost of the best of all repairs, one by one."""
    best = None
    for way in itertools.product(*(op10.moves(r) for _, r in turns)):
        state, cost = 0, 0
        for (turn, _), (a, b, c, action) in zip(turns, way):
            if a != state:
                break
            state, cost = b, cost + c * op10.UNIT + op10.tie(conv, turn, a, b, action)
        else:
            cost += op10.INSERT * op10.UNIT * len(op10.closing(state))
            best = min(best, cost) if best is not None else cost
    return best


def cost_of(conv, turns, actions):
    last, cost = 0, 0
    for (turn, role), (a, b, action) in zip(turns, actions):
        assert a == last
        cost += min(c for x, y, c, z in op10.moves(role) if (x, y, z) == (a, b, action)) * op10.UNIT + op10.tie(conv, turn, a, b, action)
        last = b
    return cost + op10.INSERT * op10.UNIT * len(op10.closing(last))


def test_cheapest_of_all_and_segments_agree():
    r = random.Random(6)
    for conv in range(60):
        turns = [(k, r.choice(["system", "user", "assistant", "tool", None])) for k in range(r.randrange(1, 5))]
        (ends,) = op10.segment_ends([op10.segment_matrix(conv, turns)])
        whole = op10.segment_actions(conv, turns, *ends)
        assert cost_of(conv, turns, whole) == cheapest(conv, turns)
        cut = r.randrange(1, len(turns)) if len(turns) > 1 else 1
        parts = [p for p in (turns[:cut], turns[cut:]) if p]
        ends = op10.segment_ends([op10.segment_matrix(conv, p) for p in parts])
        assert [a for p, e in zip(parts, ends) for a in op10.segment_actions(conv, p, *e)] == whole


LEGAL = re.compile(r"(<\|system\|>\n[^|]*<\|end\|>\n)?(<\|user\|>\n[^|]*<\|end\|>\n<\|assistant\|>\n[^|]*<\|end\|>\n)+")


def rendering(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.conv_id is not None, r.conv_id or 0, r.turn is not None, r.turn or 0)):
        out[r.conv_id] = out.get(r.conv_id, "") + r.part
    return out


def test_hot_conversation_is_spread_and_stays_legal(spark):
    r = random.Random(7)
    rows = [(1, k, r.choice(["user", "assistant"]), f"t{k}", 0) for k in range(3000)] + [(c, k, r.choice(["system", "user", "assistant", None, "tool"]), "x", 0) for c in range(2, 400) for k in range(r.randrange(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seg int")
    got = op10.repair(df).collect()
    assert len(got) == len(rows)
    assert all(LEGAL.fullmatch(t) for t in rendering(got).values())
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    again = op10.repair(df).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_plain_conversations_stay(spark):
    df = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b <|user|>"), (2, 0, "user", None), (2, 1, "assistant", "")], "conv_id long, turn long, role string, text string")
    got = op10.repair(df).collect()
    assert {r.action for r in got} == {"take"}
    assert rendering(got)[1] == "<|system|>\ns<|end|>\n<|user|>\na<|end|>\n<|assistant|>\nb < |user|><|end|>\n"


def test_edges(spark):
    df = spark.createDataFrame([(None, None, None, None), (3, 1, "user", "q"), (3, 1, "user", "q"), (4, 0, "system", "only")], "conv_id long, turn long, role string, text string")
    got = op10.repair(df).collect()
    assert len(got) == 4 and all(LEGAL.fullmatch(t) for t in rendering(got).values())
    assert op10.repair(df.limit(0)).count() == 0


def test_driver_table(spark, sf):
    rows = op10.repair(op10.table(spark, sf, "conversations")).collect()
    assert len(rows) == 87 and all(LEGAL.fullmatch(t) for t in rendering(rows).values() if t.count("|") == 2 * (t.count("<|")))
