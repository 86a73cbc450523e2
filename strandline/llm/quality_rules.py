"""Quality rules by weak supervision: rules vote or abstain, and expectation-maximisation weighs them (operator 4).

Each rule says 1 (good), -1 (bad) or 0 (abstains) on the whole text of a document. A rule has two accuracies: the chances
that its vote is right on a good document and on a bad one. They differ, as a bad document is bad in one way and most
rules find nothing in it. Documents are grouped by their votes, which leaves at most 3^rules rows whatever the corpus, and
expectation-maximisation over these counts estimates the prior and the accuracies. A document's posterior probability of
being good then decides, instead of asking that it pass every rule.

Only DataFrame functions are used; one row of parameters comes to the driver.

Words are [^\\x20\\x09-\\x0D]+. Defined results: a null text has no words; documents under MIN_WORDS words or with more than
half of their words in repeated 3-word windows fail the base rules whatever the votes; rows with one id or a null id, and
repeated rows, each count; texts of 2^20 words and more are measured whole on a path of their own; an empty table gives no
rows; columns other than those named are ignored, and those in keep are handed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import ready, stored

_BLANKS = " \t\n\x0b\f\r"
MIN_WORDS, ROUNDS = 50, 20
#: Where estimation begins: the share of good documents, and a rule's accuracies on good and bad ones; and the bounds of accuracies.
PRIOR, ON_GOOD, ON_BAD, LOW, HIGH = 0.8, 0.9, 0.3, 0.02, 0.999
#: A place in a text of under 2^20 words shares a 64-bit number with 44 bits of a hash.
_PLACE_BITS = 20

#: Frequent words of English, German, French and Spanish, as they stand in running text.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "that", "is", "was", "for", "it", "with", "as", "on", "be", "at", "by", "this", "had", "not", "are", "but", "from", "or", "have", "an", "they", "which", "you", "were",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es", "werden", "aus", "er", "hat", "dass", "sie", "nach",
    "le", "la", "les", "et", "du", "un", "une", "que", "pour", "qui", "dans", "ce", "il", "au", "sur", "se", "ne", "pas", "plus", "par", "je", "avec", "tout", "faire", "son",
    "de", "el", "y", "a", "en", "los", "las", "por", "con", "no", "su", "para", "al", "lo", "como", "más", "pero", "sus", "si", "me",
)

#: Rules by name: when it votes good, and when bad, as SQL on the columns of measured(). Each looks at something else, as the estimation takes them to be independent.
RULES = {
    "length": ("n_words >= 80", "n_words < 50"),
    "symbols": ("100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    "duplicate_lines": ("n_lines > 3 and n_dup_lines = 0", "n_dup_lines > 2 and 10 * n_dup_lines > 3 * n_lines"),
    "repeated_words": ("20 * n_repeat_words <= n_words", "10 * n_repeat_words > 3 * n_words"),
    "word_length": ("word_chars >= 3 * n_words and word_chars <= 12 * n_words", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    "characters": ("20 * n_digits <= word_chars and 100 * n_letters >= 75 * word_chars", "4 * n_digits > word_chars or 100 * n_letters < 60 * word_chars"),
    "stop_words": ("20 * n_stop_words >= n_words", "100 * n_stop_words < n_words"),
    "line_ends": ("2 * n_ended_lines >= n_lines", "n_lines > 3 and 5 * n_ended_lines < n_lines"),
    "capitals": ("10 * n_capitals <= n_letters", "3 * n_capitals > n_letters"),
}


def _windows(hashes: str) -> Column:
    """The 3-word windows as numbers, of the high bits of their hash and the place."""
    triple = F.expr(f"transform(sequence(0, size({hashes}) - 3), i -> (xxhash64({hashes}[i], {hashes}[i + 1], {hashes}[i + 2]) & {-1 << _PLACE_BITS}L) | i)")
    return F.when(F.size(hashes) >= 3, triple).otherwise(F.array().cast("array<bigint>"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep, and what the rules need of each whole text.

    Words in repeated windows: windows are sorted by hash and place, so equal ones stand together. Neighbours with equal hash
    bits are compared by their words; where hashes alone agree, and in texts too long for the place bits, windows are
    compared as strings.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), *keep, text.alias("_t"))
    trimmed = base.withColumn("_b", F.btrim("_t", F.lit(_BLANKS)))
    split = trimmed.withColumn("_w", F.when(F.col("_b") == "", F.array().cast("array<string>")).otherwise(F.split("_b", "[\\x20\\x09-\\x0D]+")))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")
    counted = split.select(
        "doc_id",
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("_t", F.lit("[0-9]")).cast("long").alias("n_digits"),
        F.regexp_count("_t", F.lit(r"[\p{L}\p{M}]")).cast("long").alias("n_letters"),
        F.regexp_count("_t", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.size(F.filter("_w", lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter(lines, lambda x: F.substring(F.rtrim(x, F.lit(_BLANKS)), -1, 1).isin(".", "!", "?"))).cast("long").alias("n_ended_lines"),
        lines.alias("_l"),
        F.col("_w"),
        F.expr("transform(_w, w -> xxhash64(w))").alias("_h"),
    )
    counted = counted.select("*", F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines")).drop("_l")
    keyed = counted.withColumn("_k", _windows("_h")).drop("_h")
    ordered = keyed.withColumn("_s", F.sort_array("_k"))
    place = (1 << _PLACE_BITS) - 1
    same = f"(shiftright(_s[i], {_PLACE_BITS}) = shiftright(_s[i - 1], {_PLACE_BITS}))"
    pairs = ordered.withColumn("_d", F.expr(f"filter(sequence(1, greatest(1, size(_s) - 1)), i -> i < size(_s) and {same})"))
    at, before = f"cast(_s[i] & {place}L as int)", f"cast(_s[i - 1] & {place}L as int)"
    words_same = " and ".join(f"_w[{at} + {k}] = _w[{before} + {k}]" for k in range(3))
    checked = pairs.withColumn("_clash", F.expr(f"exists(_d, i -> not ({words_same}))")).withColumn(
        "_p", F.sort_array(F.array_distinct(F.expr(f"flatten(transform(_d, i -> array({before}, {at})))")))
    )
    count = "aggregate({0}, named_struct('n', 0, 'end', 0), (a, p) -> named_struct('n', a.n + p + 3 - greatest(a.end, p), 'end', p + 3), a -> a.n)"
    strings = "sort_array(transform(sequence(0, size(_w) - 3), i -> named_struct('g', concat_ws(' ', _w[i], _w[i + 1], _w[i + 2]), 'i', i)))"
    places = "sort_array(array_distinct(flatten(transform(filter(sequence(1, size(s) - 1), i -> s[i].g = s[i - 1].g), i -> array(s[i - 1].i, s[i].i)))))"
    covered, exact = count.format("_p"), f"element_at(transform(array({strings}), s -> {count.format(places)}), 1)"
    whole = F.when(F.col("_clash") | (F.col("n_words") > place), F.expr(exact)).otherwise(F.expr(covered))
    return checked.withColumn("n_repeat_words", whole.cast("long")).drop("_t", "_b", "_w", "_k", "_s", "_d", "_clash", "_p")


def votes(measures: DataFrame, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """measures with a column votes: a number of two bits a rule (0 abstains, 1 good, 2 bad)."""
    out = F.lit(0)
    for k, (good, bad) in enumerate(rules.values()):
        out = out + F.when(F.expr(bad), 2).when(F.expr(good), 1).otherwise(0) * (1 << 2 * k)
    return measures.withColumn("votes", out.cast("long"))


def votes_of(n_rules: int) -> str:
    """SQL for the votes as an array of 1, -1 and 0."""
    return f"transform(sequence(0, {n_rules - 1}), k -> element_at(array(0, 1, -1), cast(shiftright(votes, 2 * k) & 3 as int) + 1))"


def log_odds(prior: float, on_good: list[float], on_bad: list[float]) -> Column:
    """The logarithm of the odds that a document with these votes is good."""
    import math

    out = F.lit(math.log(prior / (1 - prior)))
    for k, (a, b) in enumerate(zip(on_good, on_bad, strict=True)):
        code = F.shiftright("votes", 2 * k).bitwiseAND(F.lit(3))
        out = out + F.when(code == 1, math.log(a / (1 - b))).when(code == 2, math.log((1 - a) / b)).otherwise(0.0)
    return out


def estimate(voted: DataFrame, n_rules: int, rounds: int = ROUNDS) -> tuple[float, list[float], list[float]]:
    """Prior (within [0.01, 0.99]) and accuracies on good and on bad documents (within [LOW, HIGH]) by expectation-maximisation.

    A vote is never evidence for its opposite: both accuracies of a rule add up to 1 at least. All rounds are one
    aggregate() over an array of the vote patterns and their counts, at most 3^n_rules of them.
    """
    counts = voted.groupBy("votes").agg(F.count("*").alias("n"))
    table = counts.select("votes", "n", F.expr(votes_of(n_rules)).alias("v")).agg(F.array_sort(F.collect_list(F.struct("votes", "n", "v"))).alias("c"))
    start = f"named_struct('prior', {PRIOR}D, 'a', array_repeat({ON_GOOD}D, {n_rules}), 'b', array_repeat({ON_BAD}D, {n_rules}))"
    weight = "zip_with(s.a, s.b, (a, b) -> named_struct('good', ln(a / (1 - b)), 'bad', ln((1 - a) / b)))"
    odds = "aggregate(zip_with(x.v, w, (v, l) -> case v when 1 then l.good when -1 then l.bad else 0D end), ln(s.prior / (1 - s.prior)), (t, y) -> t + y)"
    expect = f"element_at(transform(array({weight}), w -> transform(c, x -> named_struct('n', x.n, 'v', x.v, 'p', 1 / (1 + exp(-({odds})))))), 1)"
    part = "aggregate(q, 0D, (t, x) -> t + x.n * {0} * if({1}, 1D, 0D))"
    share = lambda p, vote: f"try_divide({part.format(p, f'x.v[k] = {vote}')}, {part.format(p, 'x.v[k] != 0')})"
    each = lambda p, vote, first: f"transform(sequence(0, {n_rules - 1}), k -> coalesce(least({HIGH}D, greatest({LOW}D, {share(p, vote)})), {first}D))"
    prior = "least(0.99D, greatest(0.01D, aggregate(q, 0D, (t, x) -> t + x.n * x.p) / aggregate(q, 0D, (t, x) -> t + x.n)))"
    fit = f"element_at(transform(array({expect}), q -> named_struct('prior', {prior}, 'a', {each('x.p', 1, ON_GOOD)}, 'b', {each('(1 - x.p)', -1, ON_BAD)})), 1)"
    step = f"element_at(transform(array({fit}), f -> named_struct('prior', f.prior, 'a', f.a, 'b', zip_with(f.a, f.b, (a, b) -> greatest(b, 1 - a)))), 1)"
    fitted = table.select(F.expr(f"if(size(c) > 0, aggregate(sequence(1, {rounds}), {start}, (s, i) -> {step}), {start})").alias("s")).first()["s"]
    return fitted["prior"], list(fitted["a"]), list(fitted["b"])


def judge(docs: DataFrame, rules: dict[str, tuple[str, str]] | None = None, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Measures, votes, base_failed, posterior and kept for every row of docs."""
    rules = rules or RULES
    ready(docs.sparkSession)
    voted = stored(votes(measured(docs, id_col, text_col, keep), rules), "measures")
    odds = log_odds(*estimate(voted, len(rules)))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = voted.withColumn("base_failed", base).withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of the weighed rules on every text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle(rules: dict[str, tuple[str, str]] = RULES, rounds: int = ROUNDS) -> str:
    """The same measures by unnesting, and the estimation as a recursive query."""
    m = len(rules)
    vote = ", ".join(f"case when {bad} then -1 when {good} then 1 else 0 end as v{k}" for k, (good, bad) in enumerate(rules.values()))
    vs = [f"v{k}" for k in range(m)]
    odds = lambda e: f"ln({e}.prior / (1 - {e}.prior)) + " + " + ".join(f"case v{k} when 1 then ln({e}.a{k} / (1 - {e}.b{k})) when -1 then ln((1 - {e}.a{k}) / {e}.b{k}) else 0 end" for k in range(m))
    part = lambda k, p, vote, first: f"case when sum(n * {p} * abs(v{k})) > 0 then least({HIGH}, greatest({LOW}, sum(n * {p}) filter (v{k} = {vote}) / sum(n * {p} * abs(v{k})), {LOW})) else {first} end"
    fit = ", ".join(f"{part(k, 'p', 1, ON_GOOD)} as a{k}, greatest({part(k, '(1 - p)', -1, ON_BAD)}, 1 - a{k}) as b{k}" for k in range(m))
    step = [f"e0 as (select cast({PRIOR} as double) as prior, " + ", ".join(f"cast({ON_GOOD} as double) as a{k}, cast({ON_BAD} as double) as b{k}" for k in range(m)) + ")"]
    for r in range(rounds):
        step.append(f"e{r + 1} as materialized (select least(0.99, greatest(0.01, sum(n * p) / sum(n))) as prior, {fit} from (select c.*, 1 / (1 + exp(-({odds(f'e{r}')}))) as p from c, e{r}))")
    ws = r"[^\x20\x09-\x0D]+"
    return f"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t from documents
), w as materialized (
  select r, unnest(list) as w, generate_subscripts(list, 1) as i from (select r, regexp_extract_all(t, '{ws}') as list from d)
), g as (
  select r, i, w || ' ' || lead(w) over o || ' ' || lead(w, 2) over o as g from w window o as (partition by r order by i)
), again as (
  select r, i from (select r, i, count(*) over (partition by r, g) as n from g where g is not null) where n > 1
), rep as (
  select r, count(distinct i + k) as n_repeat_words from again, (values (0), (1), (2)) as x(k) group by r
), per as (
  select r, count(*) as n_words, sum(length(w)) as word_chars, count(*) filter (w in ({", ".join(f"'{w}'" for w in STOP_WORDS)})) as n_stop_words from w group by r
), l as (
  select r, count(*) as n_lines, count(*) - count(distinct x) as n_dup_lines, count(*) filter (regexp_matches(x, '[.!?][\\x20\\x09-\\x0D]*$')) as n_ended_lines
  from (select r, unnest(string_split(t, chr(10))) as x from d) where regexp_matches(x, '{ws}') group by r
), f as materialized (
  select d.r, doc_id, coalesce(n_words, 0) as n_words, cast(coalesce(word_chars, 0) as bigint) as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, len(regexp_extract_all(t, '[0-9]')) as n_digits,
    coalesce(n_stop_words, 0) as n_stop_words, coalesce(n_ended_lines, 0) as n_ended_lines, len(regexp_extract_all(t, '\\p{{Lu}}')) as n_capitals, len(regexp_extract_all(t, '[\\p{{L}}\\p{{M}}]')) as n_letters,
    coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from d left join per using (r) left join l using (r) left join rep using (r)
), v as materialized (select *, {vote} from f),
c as materialized (select {", ".join(vs)}, count(*) as n from v group by {", ".join(vs)}),
{", ".join(step)}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words) as base_failed,
  not (n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words) and 1 / (1 + exp(-({odds(f"e{rounds}")}))) >= 0.5 as kept
from v, e{rounds}
"""


QUERIES = {"op4_quality_rules": op4_quality_rules}
ORACLES = {"op4_quality_rules": _oracle()}
