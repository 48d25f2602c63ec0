"""Quality rules as a bitmask ledger (native DataFrame expressions only).

Every rule is evaluated once per document.  The ledger keeps the raw
measurements and one bit per failed rule, so a *policy* (a versioned set of
bits) is a single bitwise AND and an ablation is one aggregation over bits;
neither looks at the text again.

Defined results: null or empty text has no words and fails ``too_short``;
null ids stay null; repeated rows are judged each on its own; an empty table
gives an empty ledger; extra columns survive, except that ledger columns
replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import UPPER, WS, text_of, words_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim")
MASK = "failed_mask"


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: Callable[[], Column]

    @property
    def flag(self) -> int:
        return 1 << self.bit


def _c(name: str) -> Column:
    return F.col(name)


#: Bits are permanent: a retired rule keeps its number.
RULES: tuple[Rule, ...] = (
    Rule(0, "too_short", lambda: _c("n_words") < 50),
    Rule(1, "repeated_words", lambda: 100 * _c("n_repeat_words") > 50 * _c("n_words")),
    Rule(2, "symbols", lambda: 10 * _c("n_symbols") > _c("n_words")),
    Rule(3, "repeated_lines", lambda: 100 * _c("n_dup_lines") > 50 * _c("n_lines")),
    Rule(4, "shouting", lambda: 100 * _c("n_upper") > 50 * _c("word_chars")),
    Rule(5, "exclaiming", lambda: 100 * _c("n_exclaim") > 30 * _c("n_words")),
    Rule(6, "long_words", lambda: _c("word_chars") > 15 * _c("n_words")),
    Rule(7, "tiny_words", lambda: _c("word_chars") < 2 * _c("n_words")),
)

BASE = RULES[0].flag | RULES[1].flag
#: Versioned policies: the rules that count.  Never edit one, add a version.
POLICIES: dict[str, int] = {
    "base-1": BASE,
    "web-1": BASE | sum(r.flag for r in RULES[2:]),
}
CURRENT = "web-1"


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _repeat_words(words: str) -> Column:
    """Words inside any 3-word window that occurs twice or more.

    Windows are hashed to 64 bits and sorted with their positions; equal
    neighbours are the repeated ones.  Covered words are the union of
    ``[p, p + 3)``, summed from the gaps of the sorted positions.
    """
    w = F.col(words)
    grams = F.slice(
        F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))
    )
    return F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns ``MEASURES`` (all long)."""
    own = [c for c in docs.columns if c not in MEASURES and c != MASK]
    t, work = F.col("_td_text"), ["_td_words", "_td_grams", "_td_pos", "_td_lines"]
    out = docs.select(*own, text_of(text).alias("_td_text"))
    out = out.withColumn("_td_words", words_of(t))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(WS)) != "")
    out = out.withColumn("_td_grams", _repeat_words("_td_words")).withColumn("_td_lines", lines)
    g = F.col("_td_grams")
    repeated = F.filter(g, lambda e, i: (F.get(g, i - 1)["h"] == e["h"]) | (F.get(g, i + 1)["h"] == e["h"]))
    out = out.withColumn("_td_pos", F.sort_array(F.transform(repeated, lambda e: e["p"])))
    p = F.col("_td_pos")
    covered = F.aggregate(
        F.transform(p, lambda v, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - v, F.lit(3)))), F.lit(0), lambda a, x: a + x
    )
    found = {
        "n_words": F.size("_td_words"),
        "word_chars": F.length(_without(t, WS)),
        "n_symbols": F.length(t) - F.length(_without(t, "#*$%&|<>")),
        "n_dup_lines": F.size("_td_lines") - F.size(F.array_distinct("_td_lines")),
        "n_repeat_words": covered,
        "n_lines": F.size("_td_lines"),
        "n_upper": F.length(t) - F.length(_without(t, UPPER)),
        "n_exclaim": F.length(t) - F.length(_without(t, "!")),
    }
    return out.select(*own, *(v.cast("long").alias(k) for k, v in found.items())).drop(*work)


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measurements and the mask of failed rules, one row per document."""
    mask = F.lit(0).cast("long")
    for r in rules:
        mask = mask.bitwiseOR(F.when(r.fails(), F.lit(r.flag)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, text).withColumn(MASK, mask)


def apply_policy(led: DataFrame, policy: str = CURRENT, kept: str = "kept") -> DataFrame:
    """The ledger with a boolean verdict under a versioned policy."""
    return led.withColumn(kept, F.col(MASK).bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0)


def ablation(led: DataFrame, policy: str = CURRENT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: documents it fails, and those only it fails.

    One pass counts documents per mask (at most ``2**len(rules)`` groups,
    combined before the shuffle); rules are then read off the masks' bits.
    """
    active = POLICIES[policy]
    masks = led.groupBy(F.col(MASK).bitwiseAND(F.lit(active).cast("long")).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    listed = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.flag).cast("long").alias("flag")) for r in rules if active & r.flag))
    each = masks.select("m", "n", F.explode(listed).alias("r"))
    hit = F.col("m").bitwiseAND(F.col("r.flag")) != 0
    return each.groupBy(F.col("r.rule").alias("rule"), F.lit(policy).alias("policy")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("m") == F.col("r.flag"), F.col("n")).otherwise(0)).alias("n_only_this"),
        F.sum("n").alias("n_docs"),
    )


def filter_documents(docs: DataFrame, text: str = "text", policy: str = CURRENT) -> DataFrame:
    """The rows of ``docs`` (its own columns) that pass the policy.

    A filter would be pushed below the measurements with their expressions
    put in place of their names, once for every use: far too large a
    predicate.  A row number that the filter reads keeps it above them, so
    everything is evaluated once.
    """
    row = docs.select(F.struct(*docs.columns).alias("_td_row"), F.col(text).alias("_td_in"))
    led = apply_policy(ledger(row, "_td_in"), policy).withColumn("_td_above", F.monotonically_increasing_id())
    return led.where("kept AND _td_above >= 0").select("_td_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the ledger of the whole ``documents`` table under the current policy."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    led = apply_policy(ledger(docs.select("doc_id", "text")))
    base = F.col(MASK).bitwiseAND(F.lit(BASE).cast("long")) != 0
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", MASK
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS ls
  FROM documents),
g AS (SELECT doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS w
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(ls)::BIGINT AS n_lines,
         (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
         (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclaim
  FROM d LEFT JOIN c USING (doc_id)),
f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
           + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
           + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
           + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
           + CASE WHEN 100 * n_upper > 50 * word_chars THEN 16 ELSE 0 END
           + CASE WHEN 100 * n_exclaim > 30 * n_words THEN 32 ELSE 0 END
           + CASE WHEN word_chars > 15 * n_words THEN 64 ELSE 0 END
           + CASE WHEN word_chars < 2 * n_words THEN 128 ELSE 0 END)::BIGINT AS failed_mask
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_mask & 3) <> 0 AS base_failed, failed_mask = 0 AS kept, failed_mask
FROM f
"""
