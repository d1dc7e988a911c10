import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.llm import pii, queries


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def plain_spans(text):
    """The base spans as the contract words them."""
    only = lambda s: re.sub("[^0-9]", "", s)
    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(only(s)) <= 19 and luhn(only(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(only(s)) <= 15),
    }
    out = [(m.start(), r, k, m.end()) for r, (k, (p, ok)) in enumerate(tests.items()) for m in re.finditer(p, text) if ok(m[0])]
    return [(k, s, e) for s, _, k, e in sorted(out)]


ODD = [
    "a@b.c_d@e.f x.y@z a@b.c@d.e ..@a.b. %+-@x-y.z-w, é@ü.de \U0001f600 q@w.e",
    "1.2.3.4.5.6.7.8 999.1.1.1 01.002.0003.255 1.2.3 256.1.1.1 1.1.1.99999999999999999999",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111114111 0000000000000 4 2 4 2 4 2 4 2 4 2 4 2 4 2 4 2",
    "+1 (988) 555-2485 +1234 ++44 20 7946 0958. +1.2.3 +123456789012345678 +12 3456789)",
    "1" * 30_000 + " " + "a" * 30_000 + "@" + "b" * 10, "12-" * 20_000, "", "no digits here", "1 " * 3000,
    "x@y.z " * 300 + "\U0001f600" + " 1.2.3.4 " * 200,
]


@pytest.fixture(scope="module")
def judge(spark):
    return pii.judge_for(spark)


def spans_of(spark, texts, judge):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r["doc_id"]: r["spans"] for r in pii.find_personal_data(df, judge=judge).collect()}


def test_base_spans(spark, judge):
    got = spans_of(spark, ODD, judge)
    for i, text in enumerate(ODD):
        assert [(s["kind"], s["start"], s["end"]) for s in got[i] if s["base"]] == plain_spans(text), text[:80]


def test_query_against_brute_force(spark, small, texts):
    rows = {r["doc_id"]: r for r in queries.op9_personal_data(spark, small).collect()}
    extra = 0
    for i, text in texts.items():
        spans = plain_spans(text)
        assert [rows[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert rows[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(rows[i]["spans"].split(","))
        extra += rows[i]["spans"] != joined
    assert extra <= 3


def test_trees_add_what_the_patterns_miss(spark, judge):
    texts = ["mail bob (at) mail2 (dot) org today", "call me at (415) 555-1234 now", "card: 4111.1111.1111.1111 ok", "host 10[.]0[.]0[.]7 up", "order no. 123-456-7890 sent", "on 2024-01-15 and version 1.2.3.4567 we", "see card 4111 and 12 34"]
    got = spans_of(spark, texts, judge)
    found = [[(s["kind"], texts[i][s["start"] : s["end"]]) for s in got[i]] for i in range(len(texts))]
    assert found[:4] == [[("email", "bob (at) mail2 (dot) org")], [("phone", "(415) 555-1234")], [("card", "4111.1111.1111.1111")], [("ip", "10[.]0[.]0[.]7")]]
    assert found[4:] == [[], [], []]


def scored(spark, judge, seed, fresh):
    made = pii.examples(spark, 3200, seed, fresh)
    by = F.array()
    for kind in pii.KINDS:
        by = F.when(F.col("kind") == kind, pii.features(kind, F.struct("text", "left", "sides"))).otherwise(by)
    rows = made.select("kind", "label", by.alias("f")).select("kind", "label", judge.chosen(F.col("kind"), judge.probability(F.col("f"))).alias("chosen")).groupBy("kind", "label", "chosen").count().collect()
    return lambda **w: sum(r["count"] for r in rows if all(r[k] == v for k, v in w.items()))


@pytest.mark.parametrize("fresh", [False, True])
def test_thresholds_hold_their_precision(spark, judge, fresh):
    """On examples of other seeds, set as the learned ones and as those that only the thresholds saw."""
    n = scored(spark, judge, 99, fresh)
    for kind in pii.KINDS:
        assert n(kind=kind, chosen=True, label=1.0) >= 0.95 * n(kind=kind, chosen=True) > 0
        assert n(kind=kind, chosen=True, label=1.0) >= 0.6 * n(kind=kind, label=1.0)


def test_numbers_within_longer_runs(spark, judge):
    texts = ["pay 12 4111111111111111 now", "2020 4111111111111111", "card 4111111111111111 12", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16", "order 1234567812345670 99", "by visa 17 4111 1111 1111 1111 17 ok"]
    got = spans_of(spark, texts, judge)
    assert [[(s["kind"], texts[i][s["start"] : s["end"]]) for s in got[i]] for i in range(6)] == [[("card", "4111111111111111")]] * 3 + [[], [], [("card", "4111 1111 1111 1111")]]


def test_short_and_spelled_addresses_and_plain_numbers(spark, judge):
    texts = ["server fe80::1 is up", "write to jo at host dot org now", "tel 00441632960961 now", "order 00441632960961 now", "std::dec abc::add", "look at example.com today"]
    got = spans_of(spark, texts, judge)
    assert [[(s["kind"], texts[i][s["start"] : s["end"]]) for s in got[i]] for i in range(6)] == [[("ip", "fe80::1")], [("email", "jo at host dot org")], [("phone", "00441632960961")], [], [], []]


def test_generators_find_what_is_planted(spark):
    """Candidates before any judgement, and for cards every row of groups against brute force."""
    rng = random.Random(8)

    def card():
        body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        number = next(body + c for c in "0123456789" if luhn(body + c))
        return rng.choice([number, " ".join(number[i : i + 4] for i in (0, 4, 8, 12)), "-".join(number[i : i + 4] for i in (0, 4, 8, 12))])

    planted, texts = [], []
    for _ in range(300):
        before, inner, after = (f"{rng.randrange(10 ** rng.randint(1, 6))} " * rng.randrange(3), card(), f" {rng.randrange(10 ** rng.randint(1, 6))}" * rng.randrange(3))
        planted.append((len("é see ") + len(before), len("é see ") + len(before) + len(inner)))
        texts.append(f"é see {before}{inner}{after}, so")
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    base, _ = pii.candidates_of("card", F.col("text"))
    found = {r["i"]: r for r in df.select("i", base.alias("b")).select("i", "b.base", "b.failed").collect()}
    hits = 0
    for i, text in enumerate(texts):
        sure, tried = {(s["start"], s["end"]) for s in found[i]["base"]}, {(s["start"], s["end"]) for s in found[i]["failed"]}
        want = set()
        for m in re.finditer(r"[0-9](?:[\x20-]?[0-9])+", text):
            if (m.start(), m.end()) not in sure:
                groups = [(m.start() + g.start(), m.start() + g.end()) for g in re.finditer("[0-9]+", m[0])]
                for a in range(len(groups)):
                    for b in range(a, min(a + 19, len(groups))):
                        d = re.sub("[^0-9]", "", text[groups[a][0] : groups[b][1]])
                        if 12 <= len(d) <= 19 and luhn(d):
                            want.add((groups[a][0], groups[b][1]))
        assert tried == want, text
        hits += planted[i] in sure | tried or any(a <= planted[i][0] and planted[i][1] <= b for a, b in sure)
    assert hits == len(texts)


def test_overlaps_are_settled_as_by_brute_force(spark):
    rng = random.Random(4)
    kind = "array<struct<start:int,rank:int,end:int,kind:string,base:boolean,p:double>>"
    rows = []
    for i in range(300):
        span = lambda base: (a := rng.randrange(60), 0, a + rng.randint(1, 25), "card", base, 1.0 if base else rng.choice([0.6, 0.7, 0.8]))
        rows.append((i, sorted(span(True) for _ in range(rng.randrange(3))), [span(False) for _ in range(rng.randrange(9))]))
    got = {r["i"]: [tuple(s) for s in r["out"]] for r in spark.createDataFrame(rows, f"i int, sure {kind}, added {kind}").select("i", pii.apart(F.col("sure"), F.col("added")).alias("out")).collect()}
    for i, sure, added in rows:
        taken = []
        for x in sorted(added, key=lambda x: (-x[5], x)):
            if not any(y[0] < x[2] and x[0] < y[2] for y in sure + taken):
                taken.append(x)
        assert got[i] == taken


def test_redaction(spark, judge):
    df = spark.createDataFrame([(1, "a \U0001f600 me@x.org b +1 (988) 555-2485."), (2, None), (3, "none")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in pii.redact(df, pii.find_personal_data(df, judge=judge)).collect()}
    assert out == {1: "a \U0001f600 [email] b [phone].", 2: None, 3: "none"}


def test_awkward_rows_and_native_plan(documents, awkward, nothing, judge):
    out = pii.find_personal_data(awkward, judge=judge)
    assert out.count() == awkward.count() and pii.find_personal_data(nothing, judge=judge).count() == 0
    plan = pii.find_personal_data(documents, judge=judge)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
