"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule has a reject condition and the work that it takes, in characters touched.
One aggregate over a sample gives each rule's cost and share of rejects; rules then run
in order of rejects per cost inside one CASE expression, so a document that an early
rule rejects never pays for the later ones.  The order changes the cost only: the
verdict is the same for any order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.native import count_of, has_word, words

#: Fixed value: what counts as a symbol.
SYMBOLS = "#*$%&|<>"
#: Share of the rows that costs and selectivities are estimated on.
SAMPLE = 0.01
_P = "_quality_"


@dataclass(frozen=True)
class Rule:
    """reject and work read the prepared columns of `prepare`; work is in characters touched."""

    name: str
    reject: Column
    work: Column


def _c(name: str) -> Column:
    return F.col(_P + name)


def default_rules(min_words: int = 50, repeat_pct: int = 50, symbol_pct: int = 10, dup_line_pct: int = 50, mean_low: float = 2.0, mean_high: float = 12.0, shout_pct: int = 30) -> list[Rule]:
    """Few words; words in repeated windows; symbols; repeated lines; mean word length; shouting."""
    n, size = F.size(_c("words")), F.char_length(_c("text"))
    return [
        Rule("few_words", n < min_words, n),
        Rule("repeated_windows", 100 * repeat_words(_c("words"), _c("windows")) > repeat_pct * n, 20 * size),
        Rule("symbols", 100 * count_of(_c("text"), SYMBOLS) > symbol_pct * n, size),
        Rule("repeated_lines", 100 * dup_lines(_c("lines")) > dup_line_pct * F.size(_c("lines")), 2 * size),
        Rule("word_length", (word_chars(_c("words")) < mean_low * n) | (word_chars(_c("words")) > mean_high * n), size),
        Rule("shouting", 100 * count_of(_c("text"), "!") > shout_pct * n, size),
    ]


def word_chars(word: Column) -> Column:
    return F.char_length(F.array_join(word, ""))


def dup_lines(lines: Column) -> Column:
    """Lines that equal an earlier one."""
    return F.size(lines) - F.size(F.array_distinct(lines))


def windows(word: Column) -> Column:
    """Hashes of the 3-word windows, in order."""
    return F.when(
        F.size(word) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(word) - 3), lambda i: F.xxhash64(F.get(word, i), F.get(word, i + 1), F.get(word, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(word: Column, window: Column) -> Column:
    """Words inside 3-word windows that stand in the text twice or more, the first included.

    Equal windows become neighbours by sorting (hash, position); the words covered by
    the marked positions are counted in one pass over them.
    """

    def covered(s: Column) -> Column:
        marked = F.filter(
            F.transform(s, lambda x, i: F.when((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["i"])), lambda p: p.isNotNull()
        )
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(F.sort_array(marked), start, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    ranked = F.sort_array(F.transform(window, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(window)) == F.size(window), F.lit(0)).otherwise(_let(ranked, covered))


def prepare(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the columns that rules read, each computed once for a row."""
    out = docs.withColumn(_P + "text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    lines = F.filter(F.split(_c("text"), "\n"), has_word)
    out = out.withColumns({_P + "words": words(_c("text")), _P + "lines": lines})
    return out.withColumn(_P + "windows", windows(_c("words")))


def order_rules(prepared: DataFrame, rules: list[Rule], sample: float = SAMPLE, seed: int = 7) -> list[Rule]:
    """Rules by share of rejects per unit of work on a sample; the given order on an empty one."""
    few = prepared.sample(fraction=sample, seed=seed)
    figures = few.agg(
        F.count("*").alias("n"),
        *[F.avg(F.coalesce(r.reject, F.lit(False)).cast("double")).alias(f"reject_{i}") for i, r in enumerate(rules)],
        *[F.avg(r.work.cast("double")).alias(f"work_{i}") for i, r in enumerate(rules)],
    ).first()
    if not figures["n"]:
        return list(rules)
    gain = {i: figures[f"reject_{i}"] / max(1.0, figures[f"work_{i}"]) for i in range(len(rules))}
    return [rules[i] for i in sorted(gain, key=lambda i: (-gain[i], i))]


def verdict(ordered: list[Rule]) -> Column:
    """Name of the first rule that rejects, else null; later conditions are not evaluated."""
    out = None
    for r in ordered:
        hit = F.coalesce(r.reject, F.lit(False))
        out = F.when(hit, F.lit(r.name)) if out is None else out.when(hit, F.lit(r.name))
    return F.lit(None).cast("string") if out is None else out


def filter_documents(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """The rows of docs that no rule rejects, columns unchanged.

    A null text is an empty one (and so has too few words).  Repeated rows, ties and null
    ids are judged row by row; an empty table gives an empty one.  Columns stay whatever their names.
    """
    row = _P + "row"
    prepared = prepare(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(row)), f"{row}.{text_col}")
    ordered = order_rules(prepared, default_rules() if rules is None else rules)
    # the partition id is not deterministic to the optimizer, which thus cannot push the filter below the
    # prepared columns and compute them again for every use
    judged = prepared.withColumn(_P + "verdict", F.when(F.spark_partition_id() >= 0, verdict(ordered)))
    return judged.where(_c("verdict").isNull()).select(row + ".*")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for each row.

    base_failed: fewer than 50 words, or over half of them in repeated windows.  kept:
    not base_failed, and no rule of the cascade rejects.  A null text has no words.  Repeated rows and null ids are judged row by
    row; an empty table gives no rows.  Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prepared = prepare(rows)
    rest = [r for r in default_rules() if r.name not in ("few_words", "repeated_windows")]
    ordered = order_rules(prepared, rest)
    n = F.size(_c("words"))
    base = prepared.withColumns({_P + "n_words": n, _P + "n_repeat_words": repeat_words(_c("words"), _c("windows"))})
    failed = (_c("n_words") < 50) | (100 * _c("n_repeat_words") > 50 * _c("n_words"))
    return base.select(
        "doc_id",
        _c("n_words").cast("long").alias("n_words"),
        word_chars(_c("words")).cast("long").alias("word_chars"),
        count_of(_c("text"), SYMBOLS).cast("long").alias("n_symbols"),
        dup_lines(_c("lines")).cast("long").alias("n_dup_lines"),
        _c("n_repeat_words").cast("long").alias("n_repeat_words"),
        failed.alias("base_failed"),
        F.when(failed, F.lit(False)).otherwise(verdict(ordered).isNull()).alias("kept"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (
  SELECT r, doc_id, text, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(text) - length(replace(text, '!', '')) AS n_loud,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, w
  FROM d),
v AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM v) WHERE c > 1),
p AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM m, (VALUES (0), (1), (2)) AS o(j) GROUP BY r),
s AS (
  SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         len(lines) AS n_lines, n_loud
  FROM b LEFT JOIN p USING (r)),
t AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 50 * n_lines
            OR word_chars < 2.0 * n_words OR word_chars > 12.0 * n_words OR 100 * n_loud > 30 * n_words) AS kept
FROM t
"""
