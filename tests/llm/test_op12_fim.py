import hashlib
import re

from rupaka.llm import op12_fim
from tests.llm.common import same


def cut(i, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    spm_form = h[3] % 100 < spm
    return len(units), "spm" if spm_form else "psm", p, m, f"<S>{s}<P>{p}<M>{m}" if spm_form else f"<P>{p}<S>{s}<M>{m}"


CASES = [None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "é€𝄞\nß\n\n<\nS>", "<S\n", "x<P>y\nz\n", "a<M>\n", "<<S\nP>\n" * 3, "line\r\n\x85 y\n" * 40, "q" * 70_000 + "\n" + "r\n" * 30_000, "<", ">\n<"]


def test_query(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        same(op12_fim.op12_fill_in_middle(spark, sf), op12_fim.SQL, sf)


def test_cases(spark):
    rows = [(i, t, 1, "c") for i, t in enumerate(CASES * 4)] + [(None, "a\nb\n", 1, "c"), (None, "c\nd\ne", 1, "c"), (1, "a\nb\nc\n", 2, "c"), (1, "a\nb\nc\n", 2, "c"), (1, "z\ny\n", 2, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, key string")  # columns that the operator has itself
    for kw in ({}, {"rate": 40, "spm": 10, "seed": 3}):
        out = op12_fim.fill_in_middle(docs, **kw)
        out = out.withColumn("back", op12_fim.restored(out.output, out.form)).collect()
        got = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix, r.middle, r.output) for r in out), key=repr)
        want = sorted(((i, t or "", *cut(i, t, **kw)) for i, t, *_ in rows), key=repr)
        assert got == want
        assert all(r.back == r.text for r in out)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_empty(spark):
    assert op12_fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_text_shuffle(spark, sf):
    plan = op12_fim.op12_fill_in_middle(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "SinglePartition" not in plan
