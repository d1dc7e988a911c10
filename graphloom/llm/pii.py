"""Personal data: generators propose spans, boosted trees judge them, calibrated thresholds select.

Everything that touches the corpus is one projection of SQL functions over each row: no explode, no shuffle and no Python.
The trees are fitted by Spark's own gradient boosting on examples that SQL generates, then written as nested conditions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import text_or_empty, written

# The kinds in their order, and the patterns of the base spans.  Possessive quantifiers and the anchors before
# them change no match; they keep long runs of digits or letters linear in time and free of recursion.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to be worth trying.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

#: Further generators, by kind: disguised and spelled-out addresses, addresses of the longer kind, whole and shortened, numbers
#: in groups, national numbers and such without groups.
PROPOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++)",
    "ip": r"(?i)(?<![0-9a-z:.])(?:(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,5})?::[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,5}|[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3})(?![0-9a-z:])",
    "card": r"(?<![0-9A-Za-z.-])[0-9]{3,6}(?:[\x20./-]{1,2}[0-9]{3,6}){2,4}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.+-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20.-])[0-9]{2,4}(?:[\x20.-][0-9]{2,4}){1,3}(?![0-9A-Za-z])|(?<![0-9A-Za-z.+-])0[0-9]{8,16}(?![0-9A-Za-z])",
}
#: Numbers as issuers give them out, and how they are usually set in groups.
ISSUED = r"^(?:4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|6(?:011|5[0-9]{2}|4[4-9][0-9])[0-9]{12}|35[0-9]{14})$"
USUAL = r"^(?:[0-9]{12,19}|[0-9]{4}([\x20./-]{1,2})[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}[\x20./-][0-9]{6}[\x20./-][0-9]{4,5})$"
HINTS = {
    "email": r"(?i)mail|contact|write|address",
    "ip": r"(?i)\bip\b|host|server|address",
    "card": r"(?i)card|visa|credit|debit|payment",
    "phone": r"(?i)phone|tel\b|call|mobile|fax|cell",
}
AGAINST = r"(?i)order|invoice|isbn|serial|version|part|ref|date|\bno\.?\s*$|#\s*$"
CONTEXT = 32
FEATURES = ("kind", "length", "digits", "groups", "separators", "luhn", "opening", "hint", "against", "joined", "issued", "usual", "sides")
#: A span as it was found: where, its text, what precedes it, and on how many sides its digits go on.
FOUND = "array<struct<start:int,end:int,text:string,left:string,sides:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def locate(text: Column, pattern: str, step: int = 64) -> Column:
    """All matches in order: array of (start, end, text, left, sides), in code points, left being what precedes in the gap.

    A start is the length of all gaps and matches before it.  These are summed by blocks of ``step``, so the work hardly
    grows faster than the number of matches.
    """

    def starts(v: Column) -> Column:
        sizes = F.zip_with(v["gaps"], v["found"], lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0)))

        def with_sizes(s: Column) -> Column:
            blocks = F.sequence(F.lit(0), F.floor(F.size(s) / step).cast("int"))
            sums = F.transform(blocks, lambda b: total(F.slice(s, b * step + 1, F.lit(step))))
            bases = let(sums, lambda t: F.transform(blocks, lambda b: total(F.slice(t, F.lit(1), b))))

            def with_bases(base: Column) -> Column:
                def one(m: Column, j: Column) -> Column:
                    block = F.floor(j / step).cast("int")
                    gap = F.get(v["gaps"], j)
                    start = F.get(base, block) + total(F.slice(s, block * step + 1, j % step)) + F.length(gap)
                    return let(start.cast("int"), lambda a: F.struct(a.alias("start"), (a + F.length(m)).alias("end"), m.alias("text"), F.right(gap, F.lit(CONTEXT)).alias("left"), F.lit(0).alias("sides")))

                return F.transform(v["found"], one)

            return let(bases, with_bases)

        return F.when(F.size(v["found"]) > 0, let(sizes, with_sizes))

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.coalesce(let(both, starts), F.array().cast(FOUND))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check of doubled digits."""
    each = F.split(F.reverse(number), "")
    worth = lambda c, i: let(c.cast("int") * (1 + i % 2), lambda v: v - F.when(v > 9, 9).otherwise(0))
    return total(F.transform(F.filter(each, lambda c: c != ""), worth)) % 10 == 0


def valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda q: (F.length(q) <= 3) & (F.coalesce(q.try_cast("int"), F.lit(999)) <= 255)))
    if kind == "card":
        return let(digits(text), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits(text)).between(9, 15)
    return F.lit(True)


def features(kind: str, x: Column) -> Column:
    """The numbers that the trees see of a span: its format and what stands before it."""
    number = lambda c: c.cast("double")

    def of(d: Column) -> Column:
        return F.array(
            F.lit(float(KINDS.index(kind))),
            number(F.length(x["text"])),
            number(F.length(d)),
            number(F.regexp_count(x["text"], F.lit("[0-9]+"))),
            number(F.regexp_count(x["text"], F.lit("[^0-9A-Za-z]"))),
            number(F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False)),
            number(x["text"].rlike("^[+(]")),
            number(x["left"].rlike(HINTS[kind])),
            number(x["left"].rlike(AGAINST)),
            number(x["left"].rlike("[0-9A-Za-z]$")),
            number(d.rlike(ISSUED)),
            number(x["text"].rlike(USUAL)),
            number(x["sides"]),
        )

    return let(digits(x["text"]), of)


#: A text without a match of this has nothing that the further generator of the kind could find.
WORTH = {"email": r"(?i)[(\[](?:at|dot)[)\]]|@|\x20dot\x20", "ip": r"(?i)[0-9a-f]:[0-9a-f]|::|\[\.\]", "card": "[0-9]{3}", "phone": "[0-9]{2}"}
#: No number of a card has more groups than digits.
MOST_DIGITS = 19


def aligned(x: Column) -> Column:
    """Of a match of digit groups that fails as a whole, each row of its groups that has 12 to 19 digits and passes the check."""

    def of(groups: Column) -> Column:
        def from_(g: Column, i: Column) -> Column:
            def to(n: Column) -> Column:
                some = F.slice(groups, i + 1, n)
                return let(F.array_join(F.transform(some, lambda y: y["text"]), ""), lambda d: F.when(F.when(F.length(d).between(12, MOST_DIGITS), luhn(d)).otherwise(False), F.struct(g["start"].alias("start"), F.element_at(some, -1)["end"].alias("end"), (F.when(i > 0, 1).otherwise(0) + F.when(i + n < F.size(groups), 1).otherwise(0)).alias("sides"))))

            return F.filter(F.transform(F.sequence(F.lit(1), F.least(F.lit(MOST_DIGITS), F.size(groups) - i)), to), lambda y: y.isNotNull())

        return F.flatten(F.transform(groups, from_))

    def placed(y: Column) -> Column:
        before = F.when(y["start"] >= CONTEXT, F.substring(x["text"], y["start"] - CONTEXT + 1, F.lit(CONTEXT))).otherwise(F.right(F.concat(x["left"], F.substring(x["text"], F.lit(1), y["start"])), F.lit(CONTEXT)))
        return F.struct((x["start"] + y["start"]).alias("start"), (x["start"] + y["end"]).alias("end"), F.substring(x["text"], y["start"] + 1, y["end"] - y["start"]).alias("text"), before.alias("left"), y["sides"].alias("sides"))

    return F.transform(let(locate(x["text"], "[0-9]++"), of), placed)


def judged_spans(kind: str, found: Column) -> Column:
    """Spans (kind, start, end, f) with what the trees see of each."""
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), features(kind, x).alias("f")))


def candidates_of(kind: str, text: Column) -> tuple[Column, Column]:
    """(base spans, matches that failed the base test) in a struct, and the further spans of one kind."""
    none = F.array().cast(FOUND)
    needed = text.contains(NEEDS[kind]) if NEEDS[kind] else text.rlike("[0-9]")
    tried = F.transform(F.when(needed, locate(text, BASE[kind])).otherwise(none), lambda x: F.struct(x.alias("x"), valid(kind, x["text"]).alias("ok")))

    def parted(all_: Column) -> Column:
        good = F.transform(F.filter(all_, lambda t: t["ok"]), lambda t: F.struct(F.lit(kind).alias("kind"), t["x"]["start"].alias("start"), t["x"]["end"].alias("end")))
        missed = F.transform(F.filter(all_, lambda t: ~t["ok"]), lambda t: t["x"])
        if kind == "card":  # fewer than twelve digits hold no number
            missed = F.flatten(F.transform(F.filter(missed, lambda x: F.length(digits(x["text"])) >= 12), aligned))
        failed = judged_spans(kind, missed)
        return F.struct(good.alias("base"), failed.alias("failed"))

    return let(tried, parted), judged_spans(kind, F.when(text.rlike(WORTH[kind]), locate(text, PROPOSE[kind])).otherwise(none))


def candidates(text: Column) -> tuple[Column, Column]:
    """For each kind its base and failed spans, as an array of structs, and all further spans."""
    both = [candidates_of(kind, text) for kind in KINDS]
    return F.array(*[b for b, _ in both]), F.concat(*[more for _, more in both])


# --- the trees ------------------------------------------------------------------------------------------------------


def examples(spark: SparkSession, n: int, seed: int, fresh: bool = False) -> DataFrame:
    """``n`` made spans as they stand in texts: (kind, text, left, sides, label), about half of them personal data.

    ``fresh`` ones stand in other words and are set in other ways than those that the trees learn from.
    """
    draw = lambda salt, most: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(salt)), F.lit(most))
    num = lambda salt, size: F.lpad(draw(salt, 10**size).cast("string"), size, "0")
    pick = lambda salt, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), draw(salt, len(xs)).cast("int") + 1)
    with_ = lambda sep, first, *rest: F.concat(first, *[x for y in rest for x in (sep if isinstance(sep, Column) else F.lit(sep), y)])
    either = lambda old, new: new if fresh else old
    check = lambda body: F.concat(body, F.element_at(F.filter(F.array(*[F.lit(str(c)) for c in range(10)]), lambda c: luhn(F.concat(body, c))), 1))
    good = check(F.concat(pick(20, *either(("4", "4", "51", "55"), ("4", "52", "53", "6011"))), num(1, 16)).substr(F.lit(1), F.lit(15)))
    amex = check(F.concat(pick(21, "34", "37"), num(1, 12)))
    other = check(F.concat(pick(22, "9", "1", "0", "7", "8"), num(1, 15)).substr(F.lit(1), (11 + draw(23, 7)).cast("int")))
    bad = F.concat(F.substring(good, 1, 15), ((F.substring(good, 16, 1).cast("int") + 1 + draw(2, 9)) % 10).cast("string"))
    cut = lambda x, s: with_(s, F.substring(x, 1, 4), F.substring(x, 5, 4), F.substring(x, 9, 4), F.substring(x, 13, 4))
    odd = lambda x: with_(" ", F.substring(x, 1, 3), F.substring(x, 4, 2), F.substring(x, 6, 5), F.substring(x, 11, 6))
    name = F.concat(pick(3, *either(("ana", "j.doe", "li", "m_r"), ("kim", "t.roe", "uwe-x", "o_k"))), num(4, 2))
    row = lambda kind, label, text, left, sides=F.lit(0): F.struct(F.lit(kind).alias("kind"), text.alias("text"), left.alias("left"), sides.cast("int").alias("sides"), F.lit(float(label)).alias("label"))
    plain = lambda salt: pick(salt, *either(("and then of the ", "the results are ", "see ", ""), ("we went to ", "these were ", "(", "so ")))
    calls = lambda salt: pick(salt, *either(("call me at ", "phone: ", "tel ", "mobile: "), ("fax ", "my cell is ", "Telephone ", "phone me: ")))
    pays = lambda salt: pick(salt, *either(("card: ", "visa ", "credit card ", "payment by "), ("debit ", "my card is ", "Card no ", "paid with visa ")))
    writes = lambda salt: pick(salt, *either(("mail ", "write to ", "contact: ", "and "), ("e-mail me: ", "address ", "the ", "contact ")))
    hosts = lambda salt: pick(salt, *either(("host ", "ip ", "server ", "the "), ("from host ", "address: ", "at ", "servers ")))
    things = lambda salt: pick(salt, *either(("order no. ", "invoice ", "serial ", "part #"), ("ref ", "Order ", "version ", "isbn ")))
    at, dot = pick(9, *either((" (at) ", "(at)", " [at] "), ("[at]", " (AT) "))), pick(10, *either((" (dot) ", "[dot]", "."), ("(dot)", " [dot] ")))
    four = lambda s: F.lower(F.hex(draw(s, 65536)))
    near = lambda low, high: F.lit(low) + draw(24, high - low + 1)
    kinds = [
        row("phone", 1, F.concat(F.lit("("), num(5, 3), F.lit(") "), num(6, 3), F.lit("-"), num(7, 4)), F.when(draw(25, 3) == 0, plain(8)).otherwise(calls(8))),
        row("phone", 1, with_(pick(26, "-", " ", "."), num(5, 3), num(6, 3), num(7, 4)), calls(8)),
        row("phone", 1, with_(pick(26, "-", " "), F.concat(F.lit("0"), num(5, 3)), num(6, 3), num(7, 4)), calls(8)),
        row("phone", 1, F.concat(pick(27, "0044", "0049", "01", "0"), num(5, 9)), calls(8)),
        row("phone", 0, F.concat(pick(27, "0", "00", "000"), num(5, 9)), F.when(draw(25, 2) == 0, plain(8)).otherwise(things(8))),
        row("phone", 0, with_("-", num(5, 4), num(6, 2), num(7, 2)), pick(8, "date ", "on ", "since ", "")),
        row("phone", 0, with_(".", num(5, 2), num(6, 3), num(7, 3)), pick(8, "version ", "total ", "the ", "order ")),
        row("phone", 0, with_("-", num(5, 3), num(6, 3), num(7, 4)), F.when(draw(25, 2) == 0, plain(8)).otherwise(things(8))),
        row("phone", 0, F.concat(F.lit("+"), num(5, 3), F.lit("."), num(6, 2)), plain(8)),
        row("phone", 0, F.concat(F.lit("+"), num(5, 9), num(6, 9)), F.when(draw(25, 2) == 0, plain(8)).otherwise(things(8))),
        row("card", 1, cut(good, pick(28, *either((".", "  "), ("/", ". ")))), F.when(draw(25, 4) == 0, plain(8)).otherwise(pays(8))),
        row("card", 1, F.when(draw(29, 2) == 0, good).otherwise(cut(good, pick(28, " ", "-"))), F.concat(F.when(draw(25, 3) == 0, plain(8)).otherwise(pays(8)), num(30, 2), F.lit(" ")), near(1, 2)),
        row("card", 1, F.when(draw(29, 2) == 0, good).otherwise(amex), F.when(draw(25, 3) == 0, plain(8)).otherwise(pays(8)), F.lit(1)),
        row("card", 0, other, F.concat(plain(8), num(30, 3), F.lit(" ")), near(0, 2)),
        row("card", 0, odd(other), F.concat(plain(8), num(30, 3), F.lit(" ")), near(1, 2)),
        row("card", 0, odd(good), F.concat(F.when(draw(25, 2) == 0, plain(8)).otherwise(things(8)), num(30, 3), F.lit("-")), near(1, 2)),
        row("card", 0, F.when(draw(29, 2) == 0, good).otherwise(other), F.concat(things(8), F.when(draw(31, 2) == 0, F.concat(num(30, 2), F.lit(" "))).otherwise("")), near(0, 2)),
        row("card", 0, F.array_join(F.slice(F.array(*[draw(40 + i, 30).cast("string") for i in range(18)]), F.lit(1), (6 + draw(36, 13)).cast("int")), " "), F.concat(plain(8), num(30, 1), F.lit(" ")), near(0, 2)),
        row("card", 0, with_(" ", *[num(40 + i, 3) for i in range(5)]), F.concat(plain(8), num(30, 1), F.lit(" ")), near(0, 2)),
        row("card", 0, cut(bad, pick(28, ".", "/", "  ")), plain(8)),
        row("card", 0, with_(pick(28, " ", "/", "."), num(5, 4), num(6, 4), num(7, 4)), plain(8)),
        row("email", 1, F.concat(name, at, F.lit("mail"), num(5, 1), dot, F.lit("org")), writes(8)),
        row("email", 1, F.concat(name, F.lit(" at mail"), num(5, 1), F.lit(" dot "), pick(10, "org", "com", "net")), writes(8)),
        row("email", 0, F.concat(name, F.lit(" @ "), F.lit("noon"), F.lit(". "), F.lit("Then")), plain(8)),
        row("email", 0, F.concat(name, F.lit("@ "), F.lit("home. "), F.lit("We")), plain(8)),
        row("ip", 1, with_("[.]", draw(5, 256).cast("string"), draw(6, 256).cast("string"), draw(7, 256).cast("string"), draw(9, 256).cast("string")), hosts(8)),
        row("ip", 1, with_(":", *[four(s) for s in range(11, 19)]), hosts(8)),
        row("ip", 1, F.concat(pick(32, *either(("fe80", "2001:db8", "fd00:1"), ("2001:db8:5", "fe80", "64:ff9b"))), F.lit("::"), draw(33, 9999).cast("string"), F.when(draw(34, 2) == 0, "").otherwise(F.concat(F.lit(":"), four(11)))), hosts(8)),
        row("ip", 0, F.concat(pick(32, "", "abc", "fade", "dad", "c"), F.lit("::"), pick(33, "add", "feed", "cab", "dec", "ef")), plain(8)),
        row("ip", 0, with_(".", num(5, 3), num(6, 4), num(7, 3), num(9, 4)), pick(8, "version ", "the ", "section ", "ref ")),
        row("ip", 0, with_(".", *[draw(s, 30).cast("string") for s in (5, 6, 7)], (256 + draw(9, 9000)).cast("string")), F.when(draw(25, 2) == 0, plain(8)).otherwise(things(8))),
        row("ip", 0, with_(".", *[(256 + draw(s, 900)).cast("string") for s in (5, 6, 7, 9)]), F.when(draw(25, 2) == 0, plain(8)).otherwise(things(8))),
    ]
    made = F.element_at(F.array(*kinds), (F.col("id") % len(kinds)).cast("int") + 1)
    return spark.range(0, n, 1, 4).select("id", made.alias("x")).select("id", "x.*")


def tree_condition(lines: list[str], f: Column, at: int = 0) -> tuple[Column, int]:
    """A printed tree from line ``at`` on as a conditional expression, and the line after it."""
    line = lines[at].strip()
    if line.startswith("Predict:"):
        return F.lit(float(line.split(":")[1])), at + 1
    feature, value = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    low, at = tree_condition(lines, f, at + 1)
    high, at = tree_condition(lines, f, at + 1)  # skips the Else
    return F.when(F.get(f, F.lit(int(feature))) <= float(value), low).otherwise(high), at


class Judge:
    """Boosted trees as a SQL expression, and the threshold of each kind."""

    def __init__(self, trees: list[list[str]], weights: list[float], thresholds: dict[str, float]):
        self.trees, self.weights, self.thresholds = trees, weights, thresholds

    def probability(self, f: Column) -> Column:
        margin = F.lit(0.0)
        for lines, weight in zip(self.trees, self.weights, strict=True):
            margin = margin + weight * tree_condition(lines, f)[0]
        return 1 / (1 + F.exp(-2 * margin))

    def chosen(self, kind: Column, p: Column) -> Column:
        least = F.lit(2.0)
        for k, t in self.thresholds.items():
            least = F.when(kind == k, t).otherwise(least)
        return p >= least


def train(spark: SparkSession, n: int = 6400, seed: int = 11, rounds: int = 16, depth: int = 5, precision: float = 0.98) -> Judge:
    """Fits the trees on ``n`` made examples; on half as many fresh ones, which stand in words and forms that the trees never
    saw, each kind gets the least threshold at which every higher score holds at least ``precision``, or none."""
    made = examples(spark, n, seed).withColumn("fresh", F.lit(False)).unionByName(examples(spark, n // 2, seed + 1, True).withColumn("fresh", F.lit(True)))
    by_kind = F.array()
    for kind in KINDS:
        by_kind = F.when(F.col("kind") == kind, features(kind, F.struct("text", "left", "sides"))).otherwise(by_kind)
    made = written(made.select("id", "fresh", "kind", "label", by_kind.alias("f")), "examples").withColumn("features", array_to_vector("f"))
    fitted = GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=depth, seed=seed, stepSize=0.3).fit(made.where("not fresh").select("features", "label"))
    trees = [[x for x in t.toDebugString.split("\n")[1:] if x.strip()] for t in fitted.trees]
    judge = Judge(trees, list(fitted.treeWeights), {})
    scored = made.where("fresh").select("kind", "label", F.round(judge.probability(F.col("f")), 4).alias("p"))
    rows = scored.groupBy("kind", "p").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).collect()  # at most n / 2 rows
    for kind in KINDS:
        good = count = 0
        for r in sorted((r for r in rows if r["kind"] == kind), key=lambda r: -r["p"]):
            good, count = good + r["good"], count + r["n"]
            if good < precision * count:
                break
            judge.thresholds[kind] = max(r["p"], 0.5)
    return judge


_JUDGES: dict[tuple, Judge] = {}


def judge_for(spark: SparkSession, **how) -> Judge:
    """The trees of this process: fitted once for each way to fit them."""
    key = tuple(sorted(how.items()))
    if key not in _JUDGES:
        _JUDGES[key] = train(spark, **how)
    return _JUDGES[key]


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", judge: Judge | None = None) -> DataFrame:
    """One row per row of ``docs``: id and ``spans`` (kind, start, end, base, p) by start, kind and end.

    Base spans stay, with p = 1.  Of the proposed spans (what fails a base test, and what the further generators find) those
    that the trees choose are added, the most probable first, unless a base span or one added before overlaps.  Null and empty texts
    have no span; ids may be null or repeat; other columns are not read.
    """
    judge = judge or judge_for(docs.sparkSession)
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    shape = lambda s, base, p: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), base.alias("base"), p.alias("p"))
    base, proposed = candidates(F.col("_text"))
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).select("_id", base.alias("_base"), proposed.alias("_more"))
    sure = F.transform(F.flatten(F.transform("_base", lambda b: b["base"])), lambda s: shape(s, F.lit(True), F.lit(1.0)))
    tried = F.concat(F.flatten(F.transform("_base", lambda b: b["failed"])), F.col("_more"))
    scored = F.transform(tried, lambda s: shape(s, F.lit(False), judge.probability(s["f"])))
    added = F.filter(scored, lambda s: judge.chosen(s["kind"], s["p"]))
    out = rows.select("_id", F.array_sort(sure).alias("_sure"), added.alias("_added"))
    settled = F.when(F.size("_added") > 0, F.array_sort(F.concat("_sure", apart(F.col("_sure"), F.col("_added"))))).otherwise(F.col("_sure"))
    return out.select(F.col("_id").alias(id_col), F.transform(settled, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), s["p"].alias("p"))).alias("spans"))


def apart(sure: Column, added: Column) -> Column:
    """Of the added spans, from the most probable to the least, those that meet no span of ``sure`` and none taken before;
    of equally probable ones the first comes first."""
    meets = lambda x, y: (y["start"] < x["end"]) & (x["start"] < y["end"])
    free = F.filter(added, lambda x: ~F.exists(sure, lambda y: meets(x, y)))
    ranked = F.transform(F.array_sort(F.transform(free, lambda x: F.struct((-x["p"]).alias("less"), x.alias("span")))), lambda x: x["span"])
    return F.aggregate(ranked, F.slice(added, 1, 0), lambda taken, x: F.when(F.exists(taken, lambda y: meets(x, y)), taken).otherwise(F.concat(taken, F.array(x))))


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each found span replaced by its kind in brackets; ids must be unique."""
    spans = found.select(F.col(id_col).alias("_rid"), F.col("spans").alias("_spans"))
    joined = docs.join(spans, F.col(id_col).eqNullSafe(F.col("_rid")), "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col(text_col)
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out")))
    new = F.aggregate(F.coalesce("_spans", F.array().cast("array<struct<kind:string,start:int,end:int,base:boolean,p:double>>")), start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return joined.withColumn(text_col, new).drop("_rid", "_spans")
