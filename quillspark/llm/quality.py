"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Every rule votes good (1), bad (0) or abstains (null); most know only one side, as the absence of
one defect says little for a document. A two-class latent model in which rules are independent
given the class has one prior and, for each rule and class, the probabilities of a good and of a
bad vote; a vote counts by the ratio of its two probabilities, an abstention not at all. The ratios
are held on the side that the rule means (MARGIN), which keeps the classes from changing places.
Documents with equal votes are alike to the model, so EM runs over counts of vote patterns (at most
3 to the number of rules, 6,561), all inside one SQL expression; the posterior of each pattern goes back to the documents by a join on the pattern.
Only DataFrame functions are used.

Odd rows: a null text is an empty one, has no words and fails the base rule; rows come back one for
one, ids as they are; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, Tables

#: Frequent function words of the four languages.
STOPWORDS = (
    "the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "with", "as", "was", "on", "be", "are", "this", "by", "from", "at", "or", "an",
    "der", "die", "das", "und", "ist", "von", "den", "mit", "ein", "eine", "nicht", "auf", "für", "im", "dem", "des", "zu", "auch",
    "le", "la", "les", "de", "du", "et", "est", "un", "une", "que", "qui", "dans", "pour", "par", "sur", "pas", "avec", "en", "au",
    "el", "los", "las", "y", "es", "una", "por", "con", "para", "su", "se", "no", "lo", "del", "al",
)
WINDOW, ROUNDS, THRESHOLD = 8, 30, 0.5
PRIOR, LOW, HIGH = 0.7, 0.001, 0.999
#: Where EM begins: the probability of a good vote in the good and the bad class, of a bad vote in the bad and the good class.
GOOD_GOOD, GOOD_BAD, BAD_BAD, BAD_GOOD = 0.6, 0.3, 0.5, 0.05
#: Least ratio of a bad vote's probabilities, and of a good vote's.
MARGIN_BAD, MARGIN_GOOD = 4, 1.25

#: Rules over the counts; integer arithmetic only, so that every engine votes alike.
RULES = {
    "length": "case when n_words < 20 then 0 when n_words >= 50 then 1 end",
    "symbols": "case when 100 * n_symbols > 30 * n_words then 0 end",
    "repeats": "case when 100 * n_repeat_words > 20 * n_words then 0 end",
    "lines": "case when 100 * n_dup_lines > 30 * n_lines then 0 end",
    "capitals": "case when 100 * n_upper > 40 * word_chars then 0 end",
    "word_size": "case when 10 * word_chars < 25 * n_words or word_chars > 12 * n_words then 0 end",
    "function_words": "case when n_words < 30 then null when 100 * n_stop < 3 * n_words then 0 when 100 * n_stop >= 8 * n_words then 1 end",
    "ending": "case when n_ended = 1 then 1 end",
}


def with_counts(docs: DataFrame, text: Column, pre: str = "") -> DataFrame:
    """docs with the counts that the rules need, in columns whose names begin with pre."""
    c = lambda n: F.col(f"{pre}{n}")
    body = F.coalesce(text, F.lit(""))
    df = docs.withColumn(f"{pre}body", body)
    df = df.withColumn(f"{pre}words", F.filter(F.split(c("body"), SPACE_CLASS + "+"), lambda w: w != ""))
    df = df.withColumn(f"{pre}lines", F.filter(F.split(c("body"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn(f"{pre}hashes", F.transform(c("words"), lambda w: F.xxhash64(w)))
    # a window's 64-bit hash is built by doubling; counts are exact unless two of a text's windows collide
    for j in (1, 2, 4):
        df = df.withColumn(f"{pre}hashes", F.expr(f"transform({pre}hashes, (h, i) -> xxhash64(h, get({pre}hashes, i + {j})))"))
    windows = F.slice(c("hashes"), 1, F.greatest(F.size(c("hashes")) - (WINDOW - 1), F.lit(0)))
    df = df.withColumn(f"{pre}windows", windows)
    twice = F.size(F.array_distinct(c("windows"))) < F.size(c("windows"))
    ranked = F.sort_array(F.transform(c("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn(f"{pre}ranked", F.when(twice, ranked))
    s = f"{pre}ranked"
    found = F.expr(f"sort_array(transform(filter({s}, (x, k) -> coalesce(get({s}, k - 1).h = x.h, false) or coalesce(get({s}, k + 1).h = x.h, false)), x -> x.i))")
    df = df.withColumn(f"{pre}at", found)
    covered = F.expr(f"aggregate({pre}at, named_struct('p', {-WINDOW}, 'n', 0L), (a, x) -> named_struct('p', x, 'n', a.n + least({WINDOW}, x - a.p)), a -> a.n)")
    return df.select(
        *docs.columns,
        # a row number that a filter refers to keeps Catalyst from copying these counts into the filter
        F.monotonically_increasing_id().alias(f"{pre}row"),
        F.size(c("words")).cast("bigint").alias(f"{pre}n_words"),
        F.aggregate(c("words"), F.lit(0).cast("bigint"), lambda a, w: a + F.length(w)).alias(f"{pre}word_chars"),
        F.regexp_count(c("body"), F.lit(r"[#*$%&|<>]")).cast("bigint").alias(f"{pre}n_symbols"),
        (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("bigint").alias(f"{pre}n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias(f"{pre}n_repeat_words"),
        F.size(c("lines")).cast("bigint").alias(f"{pre}n_lines"),
        F.regexp_count(c("body"), F.lit("[A-Z]")).cast("bigint").alias(f"{pre}n_upper"),
        F.size(F.filter(c("words"), lambda w: F.lower(w).isin(*STOPWORDS))).cast("bigint").alias(f"{pre}n_stop"),
        F.right(c("body"), F.lit(1)).isin(".", "!", "?", '"').cast("bigint").alias(f"{pre}n_ended"),
    )


def with_votes(counted: DataFrame, pre: str = "") -> DataFrame:
    """Adds the vote pattern: one character a rule, 1, 0 or - for none."""
    import re

    names = "n_words|word_chars|n_symbols|n_dup_lines|n_repeat_words|n_lines|n_upper|n_stop|n_ended"
    votes = [F.coalesce(F.expr(re.sub(rf"\b({names})\b", rf"{pre}\1", r)).cast("string"), F.lit("-")) for r in RULES.values()]
    return counted.withColumn(f"{pre}votes", F.concat(*votes))


def posteriors(patterns: DataFrame) -> DataFrame:
    """patterns (votes, n) to (votes, quality): EM as one expression over the sorted pattern counts."""
    k = len(RULES)
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("pats"))
    names = {"gg": GOOD_GOOD, "gb": GOOD_BAD, "bb": BAD_BAD, "bg": BAD_GOOD}
    start = f"named_struct('pi', {PRIOR}D, " + ", ".join(f"'{x}', array_repeat({v}D, {k})" for x, v in names.items()) + ")"
    odds = (
        f"ln(s.pi / (1 - s.pi)) + aggregate(sequence(0, {k - 1}), 0D, (t, j) -> t + case substring(p.votes, j + 1, 1) "
        f"when '1' then ln(greatest({MARGIN_GOOD}D, s.gg[j] / s.gb[j])) when '0' then -ln(greatest({MARGIN_BAD}D, s.bb[j] / s.bg[j])) else 0D end)"
    )
    e_step = f"transform(pats, p -> named_struct('votes', p.votes, 'n', p.n, 'q', 1 / (1 + exp(-({odds})))))"
    total = lambda x: f"aggregate(e, 0D, (t, p) -> t + {x})"
    hold = lambda x: f"least({HIGH}D, greatest({LOW}D, {x}))"
    good, bad = "p.n * p.q", "p.n * (1 - p.q)"
    part = lambda w, hit: f"transform(sequence(1, {k}), j -> " + hold(f"({total(f"if(substring(p.votes, j, 1) = '{hit}', {w}, 0D)")} + 0.5D) / ({total(w)} + 1D)") + ")"
    m_step = f"named_struct('pi', {hold(f'{total(good)} / {total("p.n")}')}, 'gg', {part(good, 1)}, 'gb', {part(bad, 1)}, 'bb', {part(bad, 0)}, 'bg', {part(good, 0)})"
    fitted = f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> transform(array({e_step}), e -> {m_step})[0])"
    done = one.where("size(pats) > 0").withColumn("s", F.expr(fitted))
    return done.select(F.explode(F.expr(e_step)).alias("p")).select(F.col("p.votes").alias("votes"), F.col("p.q").alias("quality"))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the posterior probability of quality."""
    tables = Tables(docs.sparkSession, "quality")
    rows = tables.write(with_votes(with_counts(docs.select("doc_id", "text"), F.col("text")).drop("text", "row")), "votes")
    quality = tables.write(posteriors(rows.groupBy("votes").agg(F.count("*").alias("n"))), "patterns")
    failed = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    out = rows.join(F.broadcast(quality), "votes")  # at most 6,561 rows
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("quality") >= THRESHOLD)).alias("kept"), "quality")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, all their columns, whose text passes the base rule and the posterior threshold.
    The rows are written once with their votes, so that no text is counted twice."""
    tables, pre = Tables(docs.sparkSession, "quality"), "__quill_"
    passed = F.expr(f"{pre}n_words >= 20 and 100 * {pre}n_repeat_words <= 30 * {pre}n_words").alias(f"{pre}passed")
    rows = tables.write(with_votes(with_counts(docs, docs["text"], pre), pre).select(*docs.columns, f"{pre}votes", passed), "votes")
    quality = tables.write(posteriors(rows.groupBy(F.col(f"{pre}votes").alias("votes")).agg(F.count("*").alias("n"))), "patterns")
    good = quality.where(F.col("quality") >= THRESHOLD).select(F.col("votes").alias(f"{pre}votes"))
    return rows.where(F.col(f"{pre}passed")).join(F.broadcast(good), f"{pre}votes", "left_semi").select(*docs.columns)


def oracle() -> str:
    """DuckDB SQL for score() without the posterior column."""
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    js = range(len(RULES))
    votes = ", ".join(f"{r} as v{j}" for j, r in enumerate(RULES.values()))
    vs = ", ".join(f"v{j}" for j in js)
    odds = "ln(pi / (1 - pi))" + "".join(f" + case v{j} when 1 then ln(greatest({MARGIN_GOOD}, gg{j} / gb{j})) when 0 then -ln(greatest({MARGIN_BAD}, bb{j} / bg{j})) else 0 end" for j in js)
    hold = lambda x: f"least({HIGH}::double, greatest({LOW}::double, {x}))"
    good, bad = "n * q", "n * (1 - q)"
    new = ", ".join(hold(f"(coalesce(sum({w}) filter (v{j} = {hit}), 0) + 0.5) / (sum({w}) + 1)") + f" as {x}{j}" for j in js for x, w, hit in (("gg", good, 1), ("gb", bad, 1), ("bb", bad, 0), ("bg", good, 0)))
    first = ", ".join(f"{v}::double as {x}{j}" for j in js for x, v in (("gg", GOOD_GOOD), ("gb", GOOD_BAD), ("bb", BAD_BAD), ("bg", BAD_GOOD)))
    return f"""
with recursive base as (select doc_id, coalesce(text, '') as body from documents),
toks as (select doc_id, body, list_filter(regexp_split_to_array(body, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words,
  list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from base),
wins as (select doc_id, i, array_to_string(list_slice(words, i, i + {WINDOW - 1}), ' ') as w
  from toks, lateral (select unnest(range(1, greatest(1, len(words) - {WINDOW - 2}))) as i)),
dups as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, w) as c from wins) where c > 1),
reps as (select doc_id, sum(least({WINDOW}, coalesce(i - p, {WINDOW})))::bigint as n from (select doc_id, i, lag(i) over (partition by doc_id order by i) as p from dups) group by doc_id),
counts as (select doc_id, len(words)::bigint as n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::bigint as word_chars,
  (length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(reps.n, 0)::bigint as n_repeat_words, len(lines)::bigint as n_lines,
  (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g')))::bigint as n_upper,
  len(list_filter(words, lambda w: lower(w) in ({stop})))::bigint as n_stop,
  case when right(body, 1) in ('.', '!', '?', '"') then 1 else 0 end as n_ended
  from toks left join reps using (doc_id)),
voted as (select *, {votes} from counts),
pats as (select {vs}, count(*)::double as n from voted group by all),
em as (select 0 as it, {PRIOR}::double as pi, {first}
  union all
  select it + 1, {hold('sum(n * q) / sum(n)')} as pi, {new}
  from (select em.it, pats.*, 1 / (1 + exp(-({odds}))) as q from em, pats where em.it < {ROUNDS}) group by it),
post as (select {vs}, 1 / (1 + exp(-({odds}))) as q from pats, em where em.it = {ROUNDS})
select v.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and p.q >= {THRESHOLD} as kept
from voted v join post p on {' and '.join(f'v.v{j} is not distinct from p.v{j}' for j in js)}
"""
