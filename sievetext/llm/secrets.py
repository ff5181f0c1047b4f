"""Secrets: three base patterns, and long tokens that a battery of randomness
tests finds unlike text.  DataFrame functions only.

A candidate is a run of 20 or more token characters.  Its alphabet (hex, base32,
lower-case alphanumeric, alphanumeric, base64) is inferred from its characters.
Three statistics are taken: the chi-squared sum of its character counts against
a uniform alphabet, the number of runs of character classes, and the serial
correlation of neighbouring codes.  A candidate must pass all three as a random
string.  What is controlled is the opposite error, ordinary text taken for a
secret, so the p-value asks what text would give for the same statistics: the
sum of squared counts as the number of equal pairs (too few), the runs as class
changes beyond those of names (too many), joined by Stouffer's method.  The
serial correlation of words and of random strings is alike, so it can only
reject and adds no evidence.  Benjamini-Hochberg control is applied within
classes of length, because short tokens look random by chance more often.  The
counts of p-values per bin cover all candidates; only one threshold per length
class goes through the driver.

Positions come from the pieces between the matches; prefix sums run in blocks,
so a text with very many matches costs little more than linear time.

Defined cases: null and empty texts have no spans; repeated rows keep their own
spans; an empty table, or one without candidates, gives base spans only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import free_name, joined_spans

# Base kinds in output order, with their patterns.
BASE_KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{24,}",
    "random": "[A-Za-z0-9+/_=-]{20,}",
}
KINDS = (*BASE_KINDS, "random")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_VALUE, MIN_ACCESS = 6, 20
# Alphabets as (pattern, size), the first that fits is inferred.
ALPHABETS = (("[0-9a-f]+|[0-9A-F]+", 16), ("[A-Z2-7]+=*", 32), ("[a-z0-9]+", 36),
             ("[A-Za-z0-9]+", 62), ("", 64))
# Upper ends of the length classes.
LENGTH_ENDS = (28, 40, 64)
# Ordinary text: chance that two letters of a word are equal, and that one run of
# a name, capitals, digits or other characters ends after a character.
TEXT_PAIRS, TEXT_CHANGES = 0.066, 0.06
# Ordinary names: words, capitalised or not, joined by one separator each.
NAME = "(?:[-_/]?[A-Z]?[a-z]+)+"
RANDOM_Z = 3.3
FALSE_DISCOVERY = 0.01
BIN = 0.01
MAX_BIN = 5000
BLOCK = 128


def _gate(text: Column, kind: str) -> Column:
    """A cheap test that a text may hold a match."""
    if kind == "assign":
        low = F.lower(text)
        out = F.lit(False)
        for w in ASSIGN_WORDS:
            out = out | F.contains(low, F.lit(w))
        return out
    if kind == "access":
        return F.contains(text, F.lit("AKIA"))
    return text.rlike(PATTERNS[kind].replace(",}", "}"))


def _prefix_sums(steps: str) -> Column:
    """Exclusive prefix sums of an int array column, block by block."""
    col, zero = F.col(steps), F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("out"))

    def run(acc, x):
        return F.struct((acc["s"] + x).alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out"))

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(col) - 1) / BLOCK).cast("int")),
        lambda b: F.aggregate(F.slice(col, b * BLOCK + 1, BLOCK), zero, run))
    before = F.aggregate(blocks, zero, lambda acc, w: run(acc, w["s"]))["out"]
    return F.flatten(F.zip_with(
        blocks, before, lambda w, start: F.transform(w["out"], lambda v: v + start)))


def with_matches(docs: DataFrame, text_col: str, kinds=KINDS) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` plus, per kind, the array of matches ``(start, end, token, value)``
    (code points, end exclusive); returns the names of the added columns."""
    out, names, scratch = docs, {}, []
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    for kind in kinds:
        pattern = PATTERNS[kind]
        names[kind], found, gaps, steps, sums = (free_name(out, f"{kind}{x}") for x in ("", "_f", "_g", "_s", "_p"))
        scratch += [found, gaps, steps, sums]
        tokens = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else tokens
        out = out.withColumn(found, F.when(_gate(text, kind), F.arrays_zip(
            tokens.alias("token"), values.alias("value"))))
        out = out.withColumn(gaps, F.when(F.size(found) > 0, F.transform(
            F.split(text, pattern, -1), lambda g: F.length(g))))
        out = out.withColumn(steps, F.slice(F.zip_with(
            F.col(gaps), F.col(found), lambda g, f: g + F.length(f["token"])), 1, F.size(found)))
        out = out.withColumn(sums, F.when(F.size(steps) > 0, _prefix_sums(steps)))
        starts = F.zip_with(F.col(sums), F.col(gaps), lambda p, g: p + g)
        matches = F.filter(F.zip_with(starts, F.col(found), lambda s, f: F.struct(
            s.alias("start"), (s + F.length(f["token"])).alias("end"),
            f["token"].alias("token"), f["value"].alias("value"))), lambda m: m["token"].isNotNull())
        if kind == "assign":
            matches = F.filter(matches, lambda m: F.length(m["value"]) >= MIN_VALUE)
        if kind == "access":
            matches = F.filter(matches, lambda m: F.length(m["token"]) >= MIN_ACCESS)
        none = F.array().cast("array<struct<start:int,end:int,token:string,value:string>>")
        out = out.withColumn(names[kind], F.coalesce(matches, none))
    return out.drop(*scratch), names


def _upper_tail(z: Column) -> Column:
    """Normal upper tail (Börjesson and Sundberg's bound-type approximation)."""
    a = F.abs(z)
    q = F.exp(-a * a / 2) / 2.5066282746310002 / (0.661 * a + 0.339 * F.sqrt(a * a + 5.51))
    return F.when(z >= 0, q).otherwise(1 - q)


def battery(token: Column) -> Column:
    """Statistics of one candidate as a struct: ``n``, ``alphabet``, the three
    z-values as a random string, ``random`` (passes all three) and ``p``
    against ordinary text."""
    size = F.lit(ALPHABETS[-1][1])
    for pattern, k in reversed(ALPHABETS[:-1]):
        size = F.when(token.rlike(f"^(?:{pattern})$"), F.lit(k)).otherwise(size)
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        token, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0"), "[^aA0]+", "-")
    names = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        token, NAME, "a"), "[A-Z]+", "A"), "[0-9]+", "0"), "[^aA0]+", "-")
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c).cast("double"))
    one = F.array(F.struct(codes.alias("x"), F.length(token).cast("double").alias("n"),
                           size.cast("double").alias("k"), F.length(classes).cast("double").alias("runs"),
                           F.length(names).cast("double").alias("names")))

    def zero():
        return F.lit(0.0)

    def sums(r):
        x = r["x"]
        same = F.aggregate(F.transform(
            F.array_distinct(x), lambda d: F.pow(F.size(F.filter(x, lambda c: c == d)), F.lit(2.0))),
            zero(), lambda a, v: a + v)
        s1 = F.aggregate(x, zero(), lambda a, v: a + v)
        s2 = F.aggregate(x, zero(), lambda a, v: a + v * v)
        lag = F.aggregate(F.zip_with(x, F.slice(x, 2, F.size(x)), lambda u, v: F.coalesce(u * v, zero())),
                          zero(), lambda a, v: a + v)
        ends = F.element_at(x, 1) + F.element_at(x, -1)
        return F.struct(r["n"].alias("n"), r["k"].alias("k"), r["runs"].alias("runs"), r["names"].alias("names"),
                        same.alias("same"), s1.alias("s1"), s2.alias("s2"), lag.alias("lag"),
                        ends.alias("ends"))

    def tests(r):
        n, k = r["n"], r["k"]
        chi = (k / n * r["same"] - n - (k - 1)) / F.sqrt(2 * (k - 1))
        mean = r["s1"] / n
        var = r["s2"] - n * mean * mean
        lag = r["lag"] - mean * (2 * r["s1"] - r["ends"]) + (n - 1) * mean * mean
        serial = F.when(var > 0, (lag / var + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0))
        # Class changes of a uniform string over the inferred alphabet.
        change = F.when(k == 16, F.lit(0.469)).when(k == 32, F.lit(0.305)).when(k == 36, F.lit(0.401)) \
            .otherwise(F.lit(0.62))
        runs = (r["runs"] - 1 - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change))
        pairs = n * (n - 1) / 2
        equal = (r["same"] - n) / 2
        few = (pairs * TEXT_PAIRS - equal) / F.sqrt(pairs * TEXT_PAIRS * (1 - TEXT_PAIRS))
        many = (r["names"] - 1 - (n - 1) * TEXT_CHANGES) / F.sqrt((n - 1) * TEXT_CHANGES * (1 - TEXT_CHANGES))
        passed = (F.abs(chi) <= 2 * RANDOM_Z) & (F.abs(runs) <= RANDOM_Z) & (F.abs(serial) <= RANDOM_Z)
        return F.struct(n.cast("int").alias("n"), k.cast("int").alias("alphabet"), chi.alias("chi"),
                        runs.alias("runs"), serial.alias("serial"), passed.alias("random"),
                        _upper_tail((few + many) / F.sqrt(F.lit(2.0))).alias("p"))

    return F.transform(F.transform(one, sums), tests)[0]


def _length_class(n: Column) -> Column:
    out = F.lit(0)
    for e in LENGTH_ENDS:
        out = out + (n >= e).cast("int")
    return out


def _bin(p: Column) -> Column:
    """Bin of a p-value; a higher bin is a smaller p."""
    return F.least(F.lit(MAX_BIN), F.floor(-F.log10(F.greatest(p, F.lit(1e-60))) / BIN)).cast("int")


def thresholds(tests: DataFrame, rate: float = FALSE_DISCOVERY) -> dict[int, int]:
    """Least accepted bin per length class (Benjamini-Hochberg over all
    candidates; the rows are one struct ``t`` of :func:`battery` each).  A
    candidate that fails as a random string counts with p = 1."""
    bins = (tests.select(_length_class(F.col("t.n")).alias("c"),
                         F.when(F.col("t.random"), _bin(F.col("t.p"))).otherwise(F.lit(0)).alias("bin"))
            .groupBy("c", "bin").agg(F.count("*").alias("n")))
    order = Window.partitionBy("c").orderBy(F.col("bin").desc())
    ranked = bins.select("c", "bin", F.sum("n").over(order).alias("rank"),
                         F.sum("n").over(Window.partitionBy("c")).alias("m"))
    ok = ranked.where((F.pow(F.lit(10.0), -F.col("bin") * BIN) <= F.lit(rate) * F.col("rank") / F.col("m"))
                      & (F.col("bin") > 0))
    return {r["c"]: r["bin"] for r in ok.groupBy("c").agg(F.min("bin").alias("bin")).collect()}


def with_secrets(docs: DataFrame, text_col: str = "text", output: str = "secrets",
                 rate: float = FALSE_DISCOVERY, keep_text: bool = True) -> DataFrame:
    """Written ``docs`` (less the text unless ``keep_text``) plus ``output``:
    spans ``(kind, start, end, score)`` by start, then kind; base spans have
    score 1, random tokens 1 - p."""
    plain = docs.drop(output)
    found, names = with_matches(plain, text_col)
    tested = free_name(found, "tested")
    found = found.withColumn(tested, F.transform(names["random"], lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), battery(m["token"]).alias("t"))))
    if not keep_text:
        found = found.drop(text_col)
    found = materialize(found.drop(names["random"]), "secret-matches")
    least = thresholds(found.select(F.explode(tested).alias("c")).select("c.t"), rate)

    def needed(n):
        out = F.lit(MAX_BIN + 1)
        for c, b in sorted(least.items()):
            out = F.when(_length_class(n) == c, F.lit(b)).otherwise(out)
        return out

    def span(order, kind):
        return lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("order"),
                                  F.lit(kind).alias("kind"), m["end"].alias("end"),
                                  F.lit(1.0).alias("score"))

    parts = [F.transform(names[k], span(i, k)) for i, k in enumerate(BASE_KINDS)]
    chosen = F.filter(tested, lambda m: m["t"]["random"] & (_bin(m["t"]["p"]) >= needed(m["t"]["n"])))
    parts.append(F.transform(chosen, lambda m: F.struct(
        m["start"].alias("start"), F.lit(len(BASE_KINDS)).alias("order"), F.lit("random").alias("kind"),
        m["end"].alias("end"), (1 - m["t"]["p"]).alias("score"))))
    spans = F.transform(F.sort_array(F.concat(*parts)), lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))
    return found.withColumn(output, spans).drop(tested, *[names[k] for k in BASE_KINDS])


def secret_digest(docs: DataFrame) -> DataFrame:
    """The rows of the registered query."""
    found = with_secrets(docs.select("doc_id", "text"), keep_text=False)

    def kind_count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[kind_count(k) for k in KINDS],
                        F.sha2(joined_spans(base).cast("binary"), 256).alias("base_sha256"),
                        joined_spans(F.col("secrets")).alias("spans"))
