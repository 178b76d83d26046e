"""Quality rules by weak supervision (operator 2), with DataFrame and SQL functions only.

Each rule looks at a document's counts and votes good (1), bad (-1) or abstains (0). Rules
are neither all required nor equally trusted: expectation-maximisation over all documents
estimates, for each rule, how often it votes bad, votes good or abstains on good and on bad
documents, and the share of good documents. A document is kept if its posterior probability of being good
reaches ``keep_at``.

Votes depend on the document alone, so EM needs only how often each vector of votes occurs:
at most 3 ** len(RULES) rows whatever the corpus size. Those counts are aggregated before the
shuffle and the iterations are one SQL expression over them; only the fitted parameters (a
few numbers a rule) reach the driver, to become literals. The counts of each document are
computed once and checkpointed (some longs a row), so texts are read once and never shuffled.

Three-word windows of a text are compared by 64-bit hashes of the three words.

Defined cases: null or empty text: no words, all counts 0, base_failed; null doc_id and
repeated rows are scored like others; equal documents get equal results; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, cut, hidden

#: Space and the five ASCII controls that end a word, as a Java character class.
_SPACE = r"[ \t-\r]"
MIN_WORDS = 50

#: name, condition for a bad vote, condition for a good vote (bad first; else the rule abstains).
#: Most rules know one defect: its absence says little, so they abstain there.
RULES = [
    ("symbols", "n_symbols > 0.04 * word_chars", "false"),
    ("letters", "n_letters < 0.80 * word_chars", "n_letters > 0.93 * word_chars"),
    ("shouting", "n_upper > 0.3 * n_letters", "false"),
    ("exclaiming", "n_exclaim > 0.1 * n_words", "false"),
    ("repeated_words", "n_repeat_words > 0.35 * n_words", "false"),
    ("repeated_lines", "n_dup_lines > 0.5 * n_lines", "false"),
    ("vocabulary", "n_distinct < 1.5 * sqrt(n_words)", "n_distinct > 4 * sqrt(n_words)"),
    ("word_length", "word_chars < 2.2 * n_words or word_chars > 16 * n_words", "false"),
    ("prose", "false", "n_upper < 0.15 * n_letters and n_symbols < 0.02 * word_chars and n_stops between 0.01 * n_words and 0.4 * n_words"),
]
#: Where EM starts: share of good documents; probability of a bad and of a good vote on good and on
#: bad documents; and the weight of that belief, in documents.
PRIOR, GOOD, BAD, WEIGHT = 0.8, (0.01, 0.6), (0.25, 0.3), 20.0


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeats(w: Column) -> Column:
    """Words covered by three-word windows that occur at least twice; w: array of words."""
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            twin = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
            return F.sort_array(F.transform(twin, lambda x: x["i"]))

        # each marked window adds the words that the next one doesn't hold
        gaps = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(3)), F.lit(3))), F.lit(0), lambda a, x: a + x)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(_let(placed, marked), gaps))

    return F.when(n < 4, F.lit(0)).otherwise(_let(hashes, covered))


def text_counts(docs: DataFrame) -> DataFrame:
    """Adds the counts that the base checks and the rules use (all long)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, _SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).alias("n_words"),
            F.length(F.array_join(w, "")).alias("word_chars"),
            _repeats(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).alias("n_distinct"),
        )

    of_lines = lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))
    less = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    minus = lambda s: F.length(text) - F.length(F.replace(text, F.lit(s), F.lit("")))
    chars = {"n_symbols": less(r"[#*$%&|<>]+"), "n_upper": less(r"\p{Lu}+"), "n_letters": less(r"\p{L}+"), "n_exclaim": minus("!"), "n_stops": minus(".")}
    one = F.struct(_let(words, of_words).alias("w"), _let(lines, of_lines).alias("l"), *[v.alias(k) for k, v in chars.items()])
    own = [F.col(f"`{c}`") for c in docs.columns]
    # a column that isn't deterministic keeps the optimizer from copying the counts into filters and further columns
    out = docs.select(*own, one.alias("_c"), F.monotonically_increasing_id().alias("_at"))
    names = [*chars, "w.n_words", "w.word_chars", "w.n_repeat_words", "w.n_distinct", "l.n_lines", "l.n_dup_lines"]
    return out.where("_at >= 0").select(*own, *[F.col(f"_c.{c}").cast("long").alias(c.split(".")[-1]) for c in names])


def votes() -> Column:
    """array<int> of the rules' votes, from the counts."""
    return F.array(*[F.expr(f"CASE WHEN n_words = 0 THEN 0 WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END") for _, bad, good in RULES])


def _posterior(votes_col: str, s: str) -> str:
    """SQL for P(good | votes); ``s``: pi and for every rule gn, gp, bn, bp, the chance of a bad (n) or good (p) vote on good and bad documents."""
    llr = (
        f"aggregate(sequence(1, {len(RULES)}), 0D, (z, j) -> z + CASE {votes_col}[j - 1] WHEN -1 THEN ln({s}.gn[j - 1] / {s}.bn[j - 1])"
        f" WHEN 1 THEN ln({s}.gp[j - 1] / {s}.bp[j - 1]) ELSE ln((1 - {s}.gn[j - 1] - {s}.gp[j - 1]) / (1 - {s}.bn[j - 1] - {s}.bp[j - 1])) END)"
    )
    return f"1D / (1D + exp(-(ln({s}.pi / (1 - {s}.pi)) + {llr})))"


def fit(patterns: DataFrame, iterations: int = 40) -> DataFrame:
    """One row m of parameters from columns v (votes) and n: EM as one expression over at most 3 ** rules rows."""
    k, w = len(RULES), WEIGHT
    total = lambda what: f"aggregate(q, 0D, (z, x) -> z + {what})"
    share = lambda p, vote, start: (
        f"transform(sequence(1, {k}), j -> greatest(0.0005D, 0.999D * ({w * start} + {total(f'CASE WHEN x.v[j - 1] = {vote} THEN x.n * {p} ELSE 0D END')}) / ({w} + {total(f'x.n * {p}')})))"
    )
    pi = f"least(0.999D, greatest(0.001D, ({w * PRIOR} + {total('x.n * x.p')}) / ({w} + {total('x.n')})))"
    names = [("gn", "x.p", -1, GOOD[0]), ("gp", "x.p", 1, GOOD[1]), ("bn", "(1 - x.p)", -1, BAD[0]), ("bp", "(1 - x.p)", 1, BAD[1])]
    start = f"named_struct('pi', {PRIOR}D, {', '.join(f"'{n}', array_repeat({x}D, {k})" for n, _, _, x in names)})"
    expect = f"transform(ps, x -> named_struct('v', x.v, 'n', CAST(x.n AS DOUBLE), 'p', {_posterior('x.v', 's')}))"
    update = ", ".join(f"'{n}', {share(p, v, x)}" for n, p, v, x in names)
    step = f"element_at(transform(array({expect}), q -> named_struct('pi', {pi}, {update})), 1)"
    rows = patterns.agg(F.sort_array(F.collect_list(F.struct("v", "n"))).alias("ps"))
    return rows.select(F.expr(f"aggregate(sequence(1, {int(iterations)}), {start}, (s, t) -> {step})").alias("m"))


def estimate(counted: DataFrame, iterations: int = 40) -> dict:
    """The parameters fitted to all rows of ``text_counts`` columns: 4 * len(RULES) + 1 numbers."""
    patterns = counted.groupBy(votes().alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return fit(patterns, iterations).first()["m"].asDict()


def score(counted: DataFrame, m: dict, keep_at: float = 0.5) -> DataFrame:
    """Adds base_failed, quality (posterior), n_bad_votes and kept to rows with ``text_counts`` columns."""
    arrays = ", ".join(f"'{n}', array({', '.join(f'{x!r}D' for x in m[n])})" for n in ("gn", "gp", "bn", "bp"))
    literal = f"named_struct('pi', {m['pi']!r}D, {arrays})"
    p = F.expr(f"element_at(transform(array({literal}), s -> {_posterior('_v', 's')}), 1)")
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    out = counted.withColumn("_v", votes()).withColumn("base_failed", failed).withColumn("quality", p)
    out = out.withColumn("n_bad_votes", F.size(F.filter("_v", lambda x: x == -1)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_at)).drop("_v")


def judge(docs: DataFrame, iterations: int = 40, keep_at: float = 0.5) -> DataFrame:
    """doc_id, counts, base_failed, quality, n_bad_votes and kept for every document."""
    counted = cut(text_counts(columns(docs, "doc_id", "text")).drop("text"))
    return score(counted, estimate(counted, iterations), keep_at)


def keep_good(docs: DataFrame, iterations: int = 40, keep_at: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns. Rows are checkpointed with their counts, so that each text
    is counted once; the checkpoint goes when the result is no longer referred to."""
    plain, back = hidden(docs, "text")
    counted = cut(text_counts(plain.withColumn("text", F.col("text").cast("string"))))
    return back(score(counted, estimate(counted, iterations), keep_at).where("kept"))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"), "n_bad_votes")
