"""Features of verb suffixes and irregular forms, as column expressions.

They are evaluated once for every rule or irregular form, not for every word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from rupaka.functions import tables as t

FIELDS = ("aspect", "tense", "mood", "verbal_type", "person", "number", "gender", "case")
FEATURES = "struct<" + ",".join(f"{f}:string" for f in FIELDS) + ">"


def bundle(**values: Column | str | None) -> Column:
    """A struct of all FIELDS; those not named are null."""
    as_col = lambda v: v.cast("string") if isinstance(v, Column) else F.lit(v).cast("string")
    return F.struct(*(as_col(values.get(f)).alias(f) for f in FIELDS))


def first_match(tests: list[tuple[Column, object]]) -> Column:
    """The value of the first test that holds; null if none does."""
    return reduce(lambda a, b: a.when(b[0], F.lit(b[1])), tests[1:], F.when(tests[0][0], F.lit(tests[0][1])))


def suffix_readings(suffix: Column, flags: list[tuple[str, str]] | None = None) -> Column:
    """All readings of a suffix, the first one being the one that analyses keep. flags: (morpheme, flag) in order, for suffixes in no list."""
    flags = t.SUFFIX_FLAGS if flags is None else flags
    infinitive = [(suffix == k, bundle(verbal_type="infinitive", gender=g, number=n, case=c)) for k, (g, n, c) in t.INFINITIVES.items()]
    several = [(suffix == k, F.array(*(bundle(aspect=a, mood=m, verbal_type=v, person=p, number=n, gender=g) for a, m, v, p, n, g in rows))) for k, rows in t.AMBIGUOUS.items()]
    person = first_match([((suffix == m) | suffix.endswith(m) | suffix.startswith(m), p) for p, ms in t.PERSONS for m in ms.split()])
    listed = first_match([(suffix.isin(*x.split()), k) for k, x in (("future", t.FUTURE), ("imperfective", t.IMPERFECTIVE), ("imperative", t.IMPERATIVE), ("subjunctive", t.SUBJUNCTIVE), ("perfective", t.PERFECTIVE))])

    def flagged(field: str) -> Column:
        tests = [(listed.isNull() & F.contains(suffix, F.lit(m)), t.FLAG_FEATURES[f][field]) for m, f in flags if m and field in t.FLAG_FEATURES.get(f, {})]
        return first_match(tests) if tests else F.lit(None).cast("string")

    one_of = lambda *names: F.when(listed.isin(*names), listed)
    aspect = F.coalesce(one_of("imperfective", "perfective"), flagged("aspect"))
    tense = F.coalesce(one_of("future"), flagged("tense"))
    mood = one_of("imperative", "subjunctive")
    person = F.when(mood == "imperative", F.coalesce(person, F.lit("2"))).otherwise(person)
    ending = lambda rows, k: first_match([(suffix.endswith(r[0]), r[k]) for r in rows])
    whole = lambda k: first_match([(suffix == m, v[k]) for m, v in t.IMPERFECTIVE_GN.items()])

    def agreement(k: int, field: str) -> Column:
        return F.when(tense == "future", F.coalesce(ending(t.FUTURE_GN, k + 1), flagged(field))).otherwise(
            F.when(aspect == "imperfective", F.coalesce(whole(k), flagged(field))).otherwise(F.coalesce(flagged(field), ending(t.TERMINAL_GN, k + 1)))
        )

    kind = F.coalesce(flagged("verbal_type"), F.when(tense.isNotNull() | mood.isNotNull(), "finite").when(aspect.isNotNull(), "participle"))
    plain = F.array(bundle(aspect=aspect, tense=tense, mood=mood, verbal_type=kind, person=person, number=agreement(1, "number"), gender=agreement(0, "gender"), case=flagged("case")))
    out = F.when(*[infinitive[0][0], F.array(infinitive[0][1])])
    for test, value in infinitive[1:]:
        out = out.when(test, F.array(value))
    for test, value in several:
        out = out.when(test, value)
    return out.otherwise(plain)


def irregular_features(word: Column) -> Column:
    """Features of an irregular form, from its ending."""
    future = reduce(lambda a, b: a | b, [word.endswith(m) for m, _, _ in t.FUTURE_GN])
    imperative = word.endswith("जिए") | word.endswith("जिये")
    gn = lambda rows, k: first_match([(reduce(lambda a, b: a | b, [word.endswith(m) for m in r[0].split()]), r[k]) for r in rows])
    perfective = [("ईं यीं", "F", "P"), ("ई यी", "F", "S"), ("ये ए", "M", "P"), ("या", "M", "S"), ("ी", "F", "S"), ("ीं", "F", "P")]
    return (
        F.when(future, bundle(tense="future", verbal_type="finite", gender=gn(t.FUTURE_GN, 1), number=gn(t.FUTURE_GN, 2)))
        .when(imperative, bundle(mood="imperative", person="2", verbal_type="finite"))
        .otherwise(bundle(aspect="perfective", verbal_type="participle", gender=gn(perfective, 1), number=gn(perfective, 2)))
    )


def merged(left: Column, right: Column) -> Column:
    """Two bundles as one: what the right one states counts."""
    return F.struct(*(F.coalesce(right[f], left[f]).alias(f) for f in FIELDS))


def shown(features: Column) -> Column:
    """The stated fields as ``field=value``, joined by commas."""
    return F.concat_ws(", ", *(F.when(features[f].isNotNull(), F.concat(F.lit(f"{f}="), features[f])) for f in FIELDS))
