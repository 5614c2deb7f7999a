"""Quality rules as a ledger of failure bits.

Each rule is evaluated once per document: its measurements and one bit are
stored. A policy is a versioned set of rules; a document is kept under it if
none of the policy's bits is set, so a new policy, or one without a rule, is a
mask over the stored ledger and never reads the text again: the queries write
the ledger as Parquet to the shared folder and work on what they read back.
Ablations count masks first and then apply every policy to the few distinct
masks.

Only Spark's own functions are used, within one row: no document is exploded
into rows, so nothing but the ledger is ever shuffled.

Defined results. Null text has no words: all counts are 0 and the rules of
length and base fail. Null or repeated ids are kept as they are, one ledger
row for each input row. Columns other than the two named are ignored. An
empty table gives an empty ledger, and an ablation with no masks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_GAP, documents, let, scratch

SYMBOLS = r"[#*$%&|<>]"


def _nonblank(array: Column) -> Column:
    return F.filter(array, lambda x: x != "")


def _repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window which the text has twice or more."""

    def covered(grams: Column) -> Column:
        ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def starts(s: Column) -> Column:
            last = F.size(s) - 1
            same = lambda x, k: ((k > 0) & (x["g"] == F.get(s, k - 1)["g"])) | ((k < last) & (x["g"] == F.get(s, k + 1)["g"]))
            return F.transform(F.filter(s, lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"])

        places = let(let(ordered, starts), lambda at: F.concat(at, F.transform(at, lambda i: i + 1), F.transform(at, lambda i: i + 2)))
        return F.size(F.array_distinct(places))

    def counted(w: Column) -> Column:
        n = F.size(w) - 2
        windows = F.arrays_zip(F.slice(w, 1, n).alias("a"), F.slice(w, 2, n).alias("b"), F.slice(w, 3, n).alias("c"))
        grams = F.transform(windows, lambda x: F.concat_ws(" ", x["a"], x["b"], x["c"]))
        return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == n, 0).otherwise(covered(g)))

    return F.when(F.size(words) < 4, 0).otherwise(let(words, counted))


def measure(text: Column) -> Column:
    """A struct of all measurements of a text; the text is split once into words and once into lines."""
    text = F.coalesce(text.cast("string"), F.lit(""))

    def lines(kept: Column) -> Column:
        return F.struct(F.size(kept).cast("long").alias("n_lines"), (F.size(kept) - F.size(F.array_distinct(kept))).cast("long").alias("n_dup_lines"))

    def all_of(w: Column) -> Column:
        letters = F.array_join(w, "")
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(letters).cast("long").alias("word_chars"),
            (F.size(F.split(letters, SYMBOLS, -1)) - 1).cast("long").alias("n_symbols"),
            (F.size(F.split(letters, "!!", -1)) - 1).cast("long").alias("n_shouts"),
            _repeated_words(w).cast("long").alias("n_repeat_words"),
            let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lines).alias("lines"),
        )

    return let(_nonblank(F.split(text, WORD_GAP, -1)), all_of)


@dataclass(frozen=True)
class Rule:
    """fails: SQL over the measurements; true sets the rule's bit."""

    name: str
    bit: int
    fails: str


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...] = field(default_factory=tuple)


#: A bit never changes its meaning; a changed rule gets a new bit.
RULES = (
    Rule("too_few_words", 0, "n_words < 50"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > n_words"),
    Rule("duplicate_lines", 3, "100 * n_dup_lines > 35 * n_lines"),
    Rule("word_length", 4, "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule("shouting", 5, "4 * n_shouts > n_words"),
)
BASE = Policy("base", ("too_few_words", "repeated_words"))
POLICY = Policy("v1", tuple(r.name for r in RULES))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """id_col, the measurements and `failures` (long): bit r.bit is set if rule r fails."""
    if len({r.bit for r in rules}) != len(rules) or any(not 0 <= r.bit < 63 for r in rules):
        raise ValueError("each rule needs a bit of its own from 0 to 62")
    flat = docs.select(F.col(id_col).alias("__id"), measure(F.col(text_col)).alias("__m")).select("__id", "__m.*").select("*", "lines.n_lines", "lines.n_dup_lines").drop("lines")
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(0).cast("long"))
    return flat.withColumn("failures", bits).withColumnRenamed("__id", id_col)


def stored(book: DataFrame) -> DataFrame:
    """The ledger, written once and read back."""
    path = scratch(book.sparkSession, "ledger")
    book.write.parquet(path)
    return book.sparkSession.read.schema(book.schema).parquet(path)


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: 1 << r.bit for r in rules}
    return sum(bits[name] for name in set(policy.rules))


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    return F.col("failures").bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0


def ablate(book: DataFrame, policy: Policy = POLICY, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: rows that fail it, that only it rejects, and that stay without it."""
    masks = book.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    whole = mask(policy, rules)
    each = [(r.name, 1 << r.bit, whole & ~(1 << r.bit)) for r in rules if r.name in policy.rules]
    spark = book.sparkSession
    crossed = masks.withColumn("r", F.explode(F.array(*[F.struct(F.lit(a).alias("rule"), F.lit(b).cast("long").alias("bit"), F.lit(c).cast("long").alias("rest")) for a, b, c in each]))) if each else spark.createDataFrame([], "failures long, n long, r struct<rule string, bit long, rest long>")
    failed = F.expr("failures & r.bit") != 0
    rest = F.expr("failures & r.rest") == 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return crossed.groupBy(F.col("r.rule").alias("rule")).agg(total(failed)("n_failed"), total(failed & rest)("n_only"), total(rest)("n_kept_without"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = stored(ledger(documents(spark, sf_dir)))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes(BASE)).alias("base_failed"), passes(POLICY).alias("kept"), "failures", "n_lines", "n_shouts")


def op4_rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablate(stored(ledger(documents(spark, sf_dir))))


_BOOK_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, [x FOR x IN regexp_split_to_array(t, '[\x20\x09-\x0D]+') IF x <> ''] AS ws,
             [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
g AS (SELECT k, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
      FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT k, count(DISTINCT i + j) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS j) GROUP BY k),
m AS (SELECT w.k, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(string_split(array_to_string(ws, ''), '!!')) - 1 AS BIGINT) AS n_shouts,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines
      FROM w LEFT JOIN c ON w.k = c.k),
b AS (SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
             + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 35 * n_lines THEN 8 ELSE 0 END)
             + (CASE WHEN word_chars < 2 * n_words OR word_chars > 14 * n_words THEN 16 ELSE 0 END)
             + (CASE WHEN 4 * n_shouts > n_words THEN 32 ELSE 0 END) AS BIGINT) AS failures FROM m)
"""
OP4_SQL = (
    _BOOK_SQL
    + """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, failures, n_lines, n_shouts FROM b"""
)
OP4_ABLATION_SQL = (
    _BOOK_SQL
    + """SELECT rule, CAST(coalesce(sum(CASE WHEN failures & bit <> 0 THEN 1 END), 0) AS BIGINT) AS n_failed,
       CAST(coalesce(sum(CASE WHEN failures = bit THEN 1 END), 0) AS BIGINT) AS n_only,
       CAST(coalesce(sum(CASE WHEN failures & (63 - bit) = 0 THEN 1 END), 0) AS BIGINT) AS n_kept_without
FROM b, (VALUES ('too_few_words', 1), ('repeated_words', 2), ('symbols', 4), ('duplicate_lines', 8), ('word_length', 16), ('shouting', 32)) r(rule, bit)
GROUP BY rule"""
)
