"""Quality rules per document and verdicts per host, in DataFrame functions only.

A document breaks a rule by its own counts; its *severity* is how many times it
exceeds the mild limit that it breaks most.  The share of rule-breaking
documents of a host is shrunk towards the other hosts with a beta prior fitted
to all hosts (method of moments, less the binomial noise), so a host of a few
documents needs more evidence than a large one.  That rate moves the cut-off of
the host's documents: one is rejected where its severity exceeds 1 / rate.  A
document within all limits stays on any host, an ordinary host loses those far
beyond a limit, a host of rate near 1 loses every one beyond a limit.

The counts of a text never leave its row: repeated word windows are found by
sorting (window hash, position) pairs inside the row.  Host counts combine on
the map side, so a host of a third of all documents is one partial row per
task; the verdict join is left to the adaptive planner, which broadcasts a
small host table and splits a hot host otherwise.

Defined cases: null and empty texts have no words and fail; a null host is a
host of its own; repeated rows count each; an empty table gives no rows; input
columns with names of added columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import free_name

SPACE = "[\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
SPAN = 3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Fixed values of the milder rules: share of symbols per word, share of
# repeated lines, and the range of the mean word length.
MAX_SYMBOLS_PER_WORD = 0.1
MAX_DUP_LINES = 0.3
MEAN_WORD_CHARS = (2.0, 15.0)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _hash_order(windows: str) -> Column:
    """(hash, position) pairs of the windows in hash order; null where no window
    occurs twice, which most texts settle without the sort."""
    hashes = F.col(windows)
    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(hashes) > F.size(F.array_distinct(hashes)), F.sort_array(pairs))


def counted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus the counts of :data:`COUNTS` and ``n_lines``."""
    out = docs.drop(*COUNTS, "n_lines")
    words, hashes, pairs, again = (free_name(out, n) for n in ("w", "h", "p", "r"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    out = out.withColumn(words, F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, SPACE + "+", -1)))
    # The last two positions have no whole window; their hashes are cut off.
    out = out.withColumn(hashes, F.when(F.size(words) >= SPAN, F.slice(F.transform(
        words, lambda w, i: F.xxhash64(w, *[F.get(F.col(words), i + k) for k in range(1, SPAN)])),
        1, F.size(words) - (SPAN - 1))))
    out = out.withColumn(pairs, _hash_order(hashes))
    # Neighbours in hash order with one hash are repeats; back in text order,
    # each adds the words that the repeat before it did not cover.
    row = F.col(pairs)
    repeats = F.sort_array(F.transform(
        F.filter(row, lambda p, k: (F.get(row, k - 1)["h"] == p["h"]) | (F.get(row, k + 1)["h"] == p["h"])),
        lambda p: p["i"]))
    covered = F.aggregate(
        repeats, F.struct(F.lit(-SPAN).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"),
                                (acc["n"] + F.least(F.lit(SPAN), i - acc["last"])).alias("n")),
        lambda acc: acc["n"])
    lines = F.filter(F.split(text, "\n", -1), lambda s: s.rlike("[^\\x20\\x09-\\x0D]"))
    out = out.withColumn(again, lines)
    return out.select(
        *[c for c in out.columns if c not in (words, hashes, pairs, again)],
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(again) - F.size(F.array_distinct(again))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(again).cast("long").alias("n_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def severity() -> Column:
    """By how many times the mild limit that is broken most is exceeded; 1 is at
    the limit.  Denominators are at least 1."""
    mean = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    low, high = MEAN_WORD_CHARS
    return F.greatest(F.col("n_symbols") / F.greatest(MAX_SYMBOLS_PER_WORD * F.col("n_words"), F.lit(1.0)),
                      F.col("n_dup_lines") / F.greatest(MAX_DUP_LINES * F.col("n_lines"), F.lit(1.0)),
                      mean / high, low / F.greatest(mean, F.lit(1.0)))


def host_verdicts(scored: DataFrame, host_col: str) -> DataFrame:
    """``(host, host_docs, host_failed, host_rate)`` from documents with
    ``base_failed`` and ``mild_failed``; the prior is one row of sums over all
    hosts."""
    failed = (F.col("base_failed") | F.col("mild_failed")).cast("long")
    hosts = materialize(scored.groupBy(F.col(host_col).alias("host")).agg(
        F.count("*").alias("host_docs"), F.sum(failed).alias("host_failed")), "hosts")
    rate = F.col("host_failed") / F.col("host_docs")
    m = hosts.agg(F.sum("host_docs").alias("n"), F.sum("host_failed").alias("k"),
                  F.avg(rate).alias("mean"), F.var_samp(rate).alias("var"),
                  F.avg(1.0 / F.col("host_docs")).alias("noise")).first()
    a, b = beta_prior(m["n"], m["k"], m["mean"], m["var"], m["noise"])
    shrunk = (F.col("host_failed") + F.lit(a)) / (F.col("host_docs") + F.lit(a + b))
    return hosts.select("host", "host_docs", "host_failed", shrunk.alias("host_rate"))


def beta_prior(n, k, mean, var, noise) -> tuple[float, float]:
    """Beta parameters from the hosts' rates: their mean, and their variance less
    the expected binomial noise.  Without spread the prior holds 1000 documents;
    it never holds less than one."""
    if not n:
        return 1.0, 1.0
    mean = min(max(mean, 1e-3), 1 - 1e-3)
    spread = (var or 0.0) - mean * (1 - mean) * noise
    strength = mean * (1 - mean) / spread - 1 if spread > 0 else 1000.0
    strength = min(max(strength, 1.0), 1000.0)
    return mean * strength, (1 - mean) * strength


def with_verdict(docs: DataFrame, text_col: str = "text", host_col: str = "source",
                 keep_text: bool = True) -> DataFrame:
    """``docs`` (less the text unless ``keep_text``) plus the counts,
    ``base_failed``, ``severity``, ``mild_failed``, ``host_rate`` and ``kept``.  The
    counted documents are written once and serve both the hosts and the verdicts."""
    plain = docs.drop("base_failed", "severity", "mild_failed", "host_rate", "kept")
    host = free_name(plain, "host_key")
    keyed = plain.withColumn(host, F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit("")))
    scored = counted(keyed, text_col).withColumns({"base_failed": base_failed(), "severity": severity()}).withColumn(
        "mild_failed", F.col("severity") > 1)
    scored = materialize(scored if keep_text else scored.drop(text_col), "scored")
    verdicts = host_verdicts(scored, host).select(F.col("host").alias(host), "host_rate")
    kept = ~F.col("base_failed") & (F.col("severity") * F.col("host_rate") <= 1)
    return scored.join(verdicts, host).withColumn("kept", kept).drop(host)


def reject(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that the rules keep; columns and their order stay, also
    columns that have the names of the operator's own."""
    inner = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)])
    at = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    kept = with_verdict(inner, at[text_col], at[host_col]).where("kept")
    return kept.select(*[F.col(v).alias(c) for c, v in at.items()])


def quality_digest(docs: DataFrame) -> DataFrame:
    """The rows of the registered query."""
    found = with_verdict(docs.select("doc_id", "text", "source"), keep_text=False)
    return found.select("doc_id", *COUNTS, "base_failed", "kept", F.round("severity", 9).alias("severity"),
                        F.round("host_rate", 9).alias("host_rate"))


ORACLE_SQL = f"""
with d as (
  select row_number() over () as k, doc_id, source, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)),
                lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) as lines
  from documents),
windows as (
  select k, i, array_to_string(list_slice(w, i, i + {SPAN - 1}), ' ') as gram
  from (select k, w, unnest(range(1, len(w) - {SPAN - 2})) as i from d)),
again as (select k, i from (select *, count(*) over (partition by k, gram) as n from windows) where n > 1),
repeats as (select k, count(distinct p) as n from (select k, unnest(range(i, i + {SPAN})) as p from again) group by k),
c as (
  select d.k, doc_id, coalesce('=' || source, '') as host, cast(len(w) as bigint) as n_words,
    cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) as bigint) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
    cast(coalesce(repeats.n, 0) as bigint) as n_repeat_words, len(lines) as n_lines
  from d left join repeats on repeats.k = d.k),
s as (
  select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
    word_chars / greatest(n_words, 1) as mean,
    greatest(n_symbols / greatest(cast({MAX_SYMBOLS_PER_WORD} as double) * n_words, 1),
      n_dup_lines / greatest(cast({MAX_DUP_LINES} as double) * n_lines, 1),
      mean / {MEAN_WORD_CHARS[1]}, {MEAN_WORD_CHARS[0]} / greatest(mean, 1)) as severity
  from c),
hosts as (select host, count(*) as n, count(*) filter (base_failed or severity > 1) as f from s group by host),
spread as (
  select greatest(least(avg(f / n), 0.999), 0.001) as m, coalesce(var_samp(f / n), 0) as v, avg(1.0 / n) as e from hosts),
prior as (
  select m, case when v - m * (1 - m) * e > 0
    then greatest(least(m * (1 - m) / (v - m * (1 - m) * e) - 1, 1000.0), 1.0) else 1000.0 end as a from spread),
rates as (select host, (f + m * a) / (n + a) as host_rate from hosts, prior)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and severity * host_rate <= 1 as kept, round(severity, 9) as severity,
  round(host_rate, 9) as host_rate
from s join rates using (host)
"""
