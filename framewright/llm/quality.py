"""Quality rules by weak supervision: rules vote or abstain, and the posterior probability of quality decides.

Each rule looks at a few counts of a text and votes good, votes bad or abstains.  Rules
differ in how far they can be trusted, so their accuracies - how often each votes good,
bad or not at all on good and on bad texts - are estimated from their agreement alone, by
expectation-maximisation for a mixture of two classes in which rules err independently.
It starts from the filter that it replaces, "no rule votes bad", held with less than
certainty; the posterior probability that a text is good then decides.

One pass over the texts makes a narrow table of counts, written once.  What the estimation
needs of all documents is how often each combination of votes occurs: one small aggregate,
at most 3 ** (number of rules) rows whatever the corpus, so the rounds run on the driver
over exact totals and the verdict is an expression with the estimated weights.

Repeated five-word windows are found inside the row: windows are hashed into numbers that
carry their position, one sort brings equal ones together, and those alone are compared as
text, so hash collisions change nothing.

A null text has no words (and fails the base rules), rows are judged one by one, so
repeated rows, null or repeated ids and extra columns don't matter; an empty table gives an
empty result.  A word of any length and a text of any length are handled whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import cut

#: White space between words, symbols.
SPACE, SYMBOL = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"
WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 5
#: Frequent function words of four languages — fixed values.
STOP_WORDS = (
    "the of and to in is that with on for at from are was it as this be "
    "der die das und in von zu mit den ist im für auf ein eine nicht "
    "le la les de des et en un une dans pour que est par au "
    "el los las y en un una por con para del se"
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_stop", "n_loud", "n_letterless")


@dataclass(frozen=True)
class Rule:
    """Conditions over COUNTS, in SQL; `bad` is asked first and neither means the rule abstains."""

    name: str
    good: str
    bad: str


#: The base rule, and the rules that vote (integer arithmetic only, so that every engine agrees).
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
RULES = (
    Rule("length", "n_words >= 50", "n_words < 20"),
    Rule("word_length", "word_chars >= 3 * n_words AND word_chars <= 10 * n_words", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule("symbols", "50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "n_lines > 1 AND 20 * n_dup_lines <= n_lines", "n_dup_lines > 1 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule("repeated_windows", "n_words >= 10 AND 50 * n_repeat_words <= n_words", "100 * n_repeat_words > 20 * n_words"),
    Rule("variety", "n_words >= 10 AND n_distinct * n_distinct >= 6 * n_words", "n_distinct * n_distinct < 2 * n_words"),
    Rule("shouting", "20 * n_loud <= n_words", "10 * n_loud > 3 * n_words"),
    Rule("stop_words", "n_words >= 10 AND 20 * n_stop >= n_words", "n_words >= 40 AND 100 * n_stop < n_words"),
    Rule("letters", "20 * n_letterless <= n_words", "5 * n_letterless > n_words"),
)
#: What the estimation starts from: the probability of a good text where no rule votes bad (one minus it elsewhere); each outcome counts as seen PSEUDO times before.
START, PSEUDO, ROUNDS, THRESHOLD = 0.9, 2.0, 25, 0.5


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """The number of words that lie in a window of words which the text holds twice or more."""

    def from_hashes(hashes: Column, high: Column) -> Column:
        """`high` masks the bits of a key that hold the hash; a position takes the others."""


        def code(x: Column, i: Column) -> Column:
            for k in range(1, window):
                x = x.bitwiseXOR(F.shiftleft(F.get(hashes, i + k), 7 * k))
            return x.bitwiseAND(high).bitwiseOR(i.cast("long"))

        return let(F.sort_array(F.transform(F.slice(hashes, 1, F.size(hashes) - window + 1), code)), lambda keys: from_keys(keys, high))

    def from_keys(keys: Column, high: Column) -> Column:
        last = lambda x: x.bitwiseOR(F.bitwise_not(high))  # of the keys with the same hash
        place = lambda x: x.bitwiseAND(F.bitwise_not(high)).cast("int")
        suspects = F.filter(keys, lambda x, k: (F.get(keys, k + 1) <= last(x)) | (x <= last(F.get(keys, k - 1))))
        texts = F.sort_array(F.transform(suspects, lambda x: F.struct(F.array_join(F.slice(words, place(x) + 1, window), " ").alias("text"), place(x).alias("at"))))
        return F.when(F.size(F.filter(keys, lambda x, k: F.get(keys, k + 1) <= last(x))) == 0, 0).otherwise(let(texts, from_texts))

    def from_texts(texts: Column) -> Column:
        twice = F.filter(texts, lambda x, k: (x["text"] == F.get(texts, k + 1)["text"]) | (x["text"] == F.get(texts, k - 1)["text"]))
        return let(F.sort_array(F.transform(twice, lambda x: x["at"])), covered)

    def covered(starts: Column) -> Column:
        return F.aggregate(F.transform(starts, lambda p, k: F.coalesce(F.least(F.lit(window), F.get(starts, k + 1) - p), F.lit(window))), F.lit(0), lambda a, b: a + b)

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    high = F.call_function("shiftleft", F.lit(-1).cast("long"), F.length(F.bin(F.size(words))))
    return F.when(F.size(words) <= window, 0).otherwise(let(high, lambda h: let(hashed, lambda x: from_hashes(x, h))))


def counts(docs: DataFrame, stop_words: str = STOP_WORDS) -> DataFrame:
    """doc_id and COUNTS (long) of each text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("__text")).withColumn("__words", F.regexp_extract_all("__text", F.lit(WORD), F.lit(0)))
    rows = rows.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike(WORD)))
    rows = rows.withColumn("__caps", F.filter("__words", lambda w: w == F.upper(w)))
    found = {
        "n_words": F.size("__words"),
        "word_chars": F.length(F.array_join("__words", "")),
        "n_symbols": F.regexp_count("__text", F.lit(SYMBOL)),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": repeated_words(F.col("__words")),
        "n_lines": F.size("__lines"),
        "n_distinct": F.size(F.array_distinct("__words")),
        "n_stop": F.size(F.filter("__words", lambda w: F.lower(w).isin(sorted(set(stop_words.split()))))),
        "n_loud": F.size(F.filter("__caps", lambda w: w != F.lower(w))),
        "n_letterless": F.size(F.filter("__caps", lambda w: w == F.lower(w))),
    }
    return rows.select("doc_id", *[found[c].cast("long").alias(c) for c in COUNTS])


def vote(rule: Rule) -> Column:
    """1: good, -1: bad, 0: the rule abstains."""
    return F.when(F.expr(rule.bad), -1).when(F.expr(rule.good), 1).otherwise(0)


@dataclass(frozen=True)
class Weights:
    """What the votes say of a text: log-odds of a good text before any vote, and what each rule's outcome (-1, 0, 1) adds."""

    before: float
    adds: tuple[dict[int, float], ...]

    def posterior(self, votes: tuple[int, ...]) -> float:
        return 1 / (1 + math.exp(-self.before - math.fsum(a[v] for a, v in zip(self.adds, votes, strict=True))))

    def column(self, rules=RULES) -> Column:
        """The posterior probability of a row of COUNTS."""
        odds = F.lit(self.before)
        for rule, a in zip(rules, self.adds, strict=True):
            odds += F.when(vote(rule) < 0, a[-1]).when(vote(rule) > 0, a[1]).otherwise(a[0])
        return 1 / (1 + F.exp(-odds))


def estimate(patterns: dict[tuple[int, ...], int], n_rules: int, rounds: int = ROUNDS) -> Weights:
    """Expectation-maximisation over vote patterns and their counts; the same weights whatever the order of the patterns."""
    own = sorted(patterns.items())
    belief = [1 - START if min(votes, default=0) < 0 else START for votes, _ in own]
    for _ in range(rounds):
        good, bad = math.fsum(n * p for (_, n), p in zip(own, belief, strict=True)), math.fsum(n * (1 - p) for (_, n), p in zip(own, belief, strict=True))

        def adds(j: int, v: int) -> float:
            seen = [(n * p, n * (1 - p)) for (votes, n), p in zip(own, belief, strict=True) if votes[j] == v]
            chance = [(math.fsum(s[side] for s in seen) + PSEUDO) / (total + 3 * PSEUDO) for side, total in enumerate((good, bad))]
            return math.log(chance[0] / chance[1])

        now = Weights(math.log((good + PSEUDO) / (bad + PSEUDO)), tuple({v: adds(j, v) for v in (-1, 0, 1)} for j in range(n_rules)))
        belief = [now.posterior(votes) for votes, _ in own]
    return now


def learned(counted: DataFrame, rules=RULES) -> Weights:
    """Weights of the rules from the votes on all rows of `counted`."""
    rows = counted.groupBy(*[vote(r).alias(f"v{j}") for j, r in enumerate(rules)]).count().collect()  # at most 3 ** len(rules) rows
    return estimate({tuple(r[:-1]): r[-1] for r in rows}, len(rules))


def judge(docs: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality (posterior probability, six digits), n_good, n_bad (votes)."""
    counted = cut(counts(docs))
    quality, failed = learned(counted, rules).column(rules), F.expr(BASE_FAILED)
    n = lambda side: F.size(F.filter(F.array(*[vote(r) for r in rules]), lambda v: v == side))
    return counted.select(
        "doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & (quality >= threshold)).alias("kept"),
        F.round(quality, 6).alias("quality"), n(1).alias("n_good"), n(-1).alias("n_bad"),
    )


def keep_good(docs: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose verdict is kept, with their own columns; the weights come from all rows."""
    counted = counts(docs.select(F.struct(*docs.columns).alias("doc_id"), "text"))
    weights = learned(counted.drop("doc_id"), rules)
    kept = ~F.expr(BASE_FAILED) & (weights.column(rules) >= threshold)
    return counted.select(F.inline(F.when(kept, F.array("doc_id"))))  # a filter would be pushed below the counts and repeat them for each use


def sql(rules=RULES, rounds: int = ROUNDS) -> str:
    """The same result in SQL: windows as rows, votes as rows, and two subqueries for each round of the estimation."""
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS.split())))
    cases = " UNION ALL ".join(f"SELECT k, {j} AS j, CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END AS v FROM c" for j, r in enumerate(rules))
    em = [f"e0 AS MATERIALIZED (SELECT m, n, CASE WHEN min(v) < 0 THEN 1 - {START}::DOUBLE ELSE {START}::DOUBLE END AS p FROM pv GROUP BY m, n)"]
    for r in range(rounds):
        em.append(f"""t{r} AS MATERIALIZED (SELECT j, v, ln((sum(e.n * p) + {PSEUDO}) / (any_value(s.good) + {3 * PSEUDO})) - ln((sum(e.n * (1 - p)) + {PSEUDO}) / (any_value(s.bad) + {3 * PSEUDO})) AS a,
      any_value(ln((s.good + {PSEUDO}) / (s.bad + {PSEUDO}))) AS o FROM pv JOIN e{r} e USING (m), (SELECT sum(n * p) AS good, sum(n * (1 - p)) AS bad FROM e{r}) s GROUP BY j, v),
e{r + 1} AS MATERIALIZED (SELECT m, n, 1 / (1 + exp(-any_value(o) - sum(a))) AS p FROM pv JOIN t{r} USING (j, v) GROUP BY m, n)""")
    em = ",\n".join(em)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT k, doc_id, t, regexp_extract_all(t, '{WORD}') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
x AS (SELECT k, unnest(range(1, len(words) - {WINDOW - 2})) AS i, words FROM w),
y AS (SELECT k, i, list_slice(words, i, i + {WINDOW - 1}) AS run FROM x),
z AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, run) AS n FROM y) WHERE n > 1),
r AS (SELECT k, sum(least({WINDOW}, coalesce(after - i, {WINDOW}))) AS n FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS after FROM z) GROUP BY k),
c AS MATERIALIZED (SELECT k, doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(regexp_extract_all(t, '{SYMBOL}')) AS n_symbols,
      len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines, len(list_distinct(words)) AS n_distinct,
      len(list_filter(words, lambda x: lower(x) IN ({stops}))) AS n_stop, len(list_filter(words, lambda x: x = upper(x) AND x <> lower(x))) AS n_loud,
      len(list_filter(words, lambda x: lower(x) = x AND upper(x) = x)) AS n_letterless FROM w LEFT JOIN r USING (k)),
v AS MATERIALIZED ({cases}),
q AS MATERIALIZED (SELECT k, string_agg(v::VARCHAR, ',' ORDER BY j) AS m FROM v GROUP BY k),
pn AS MATERIALIZED (SELECT m, count(*) AS n, min(k) AS k FROM q GROUP BY m),
pv AS MATERIALIZED (SELECT pn.m, pn.n, v.j, v.v FROM pn JOIN v USING (k)),
{em},
s AS (SELECT k, count(*) FILTER (WHERE v > 0) AS n_good, count(*) FILTER (WHERE v < 0) AS n_bad FROM v GROUP BY k)
SELECT c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_FAILED}) AS base_failed, NOT ({BASE_FAILED}) AND p >= {THRESHOLD} AS kept,
       round(p, 6) AS quality, n_good::INTEGER AS n_good, n_bad::INTEGER AS n_bad
FROM c JOIN q USING (k) JOIN e{rounds} USING (m) JOIN s USING (k)"""
