"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` measures every text once and evaluates every rule once: rule i that fails sets bit i. A
policy is a named, versioned mask of the rules that count; applying one, or comparing many, needs the
bits alone. ``ablations`` counts, in one aggregation over the bits, how many documents each rule drops
and how many only it drops.

Measurements (words are ``[^\\x20\\x09-\\x0D]+``): n_words; word_chars, code points in words; n_symbols,
characters of ``[#*$%&|<>]``; n_dup_lines, lines with a word that equal an earlier line; n_repeat_words,
words inside 5-word windows that the text holds twice or more; n_upper, n_marks, n_distinct.

Nothing is shuffled: a row is measured where it lies. Windows are compared as 64-bit hashes; only texts
with a repeated window sort them.

Defined cases: a null text counts as empty; it has no words and fails the base rule. Repeated rows are
rated each, extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 5
#: Rules by bit; each is true for a text that fails it. 0 and 1 are the base rules.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "n_symbols > 0.1 * n_words"),
    ("duplicate_lines", "n_dup_lines > 0.3 * greatest(n_lines, 1)"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("upper_case", "n_upper > 0.5 * word_chars"),
    ("exclamations", "n_marks > 0.2 * n_words"),
    ("few_distinct", "n_distinct < 0.1 * n_words"),
]
#: Policies by version: the rules that drop a document.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_words"],
    "v1": [name for name, _ in RULES],
    "v2": [name for name, _ in RULES if name not in ("symbols", "upper_case", "exclamations")],
}


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(hashes: Column) -> Column:
    """Words inside the windows that occur twice or more, from the windows' hashes in order."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = _let(placed, lambda p: F.filter(p, lambda x, j: (F.get(p, j - 1)["h"] == x["h"]) | (F.get(p, j + 1)["h"] == x["h"])))
    at = F.sort_array(F.transform(again, lambda x: x["i"]))
    return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-WIDTH).alias("last")), lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WIDTH), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"].cast("long"))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the measurements; the intermediate columns carry names that start with ``__``."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    solid = F.filter(F.split(F.col("__t"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    d = docs.withColumn("__t", t).withColumn("__w", solid)
    d = d.withColumn("n_words", F.size("__w").cast("long"))
    d = d.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    windows = F.when(F.col("n_words") >= WIDTH, F.transform(F.slice("__h", 1, F.greatest(F.col("n_words") - WIDTH + 1, F.lit(0)).cast("int")), lambda h, i: F.xxhash64(h, *[F.get(F.col("__h"), i + k) for k in range(1, WIDTH)]))).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("__win", windows)
    lines = F.filter(F.split(F.col("__t"), "\n"), lambda x: F.regexp_replace(x, r"[\x20\x09-\x0D]", "") != "")
    d = d.withColumn("__lines", F.transform(lines, lambda x: F.xxhash64(x)))
    length = F.length("__t")
    return d.withColumns({
        "word_chars": F.coalesce(F.aggregate(F.transform("__w", F.length), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long"),
        "n_symbols": (length - F.length(F.translate("__t", "#*$%&|<>", ""))).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.when(F.size(F.array_distinct("__win")) < F.size("__win"), _covered(F.col("__win"))).otherwise(F.lit(0)).cast("long"),
        "n_upper": (length - F.length(F.translate("__t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
        "n_marks": (length - F.length(F.translate("__t", "!", ""))).cast("long"),
        "n_distinct": F.size(F.array_distinct("__h")).cast("long"),
    }).drop("__t", "__w", "__h", "__win", "__lines")


def mask(names: list[str]) -> int:
    """The bits of the named rules."""
    bit = {name: 1 << i for i, (name, _) in enumerate(RULES)}
    return sum(bit[n] for n in names)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and ``failed``, the bits of the rules that a text fails."""
    d = measure(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).drop("text")
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return d.withColumn("failed", total.cast("long"))


def apply_policy(led: DataFrame, policy: str) -> DataFrame:
    """``led`` with base_failed and kept: no rule of the policy, and no base rule, fails."""
    base, own = F.lit(mask(POLICIES["base"])), F.lit(mask(POLICIES["base"] + [r for r in POLICIES[policy] if r not in POLICIES["base"]]))
    return led.withColumns({"base_failed": F.col("failed").bitwiseAND(base) != 0, "kept": F.col("failed").bitwiseAND(own) == 0})


def ablations(led: DataFrame, policies: list[str]) -> DataFrame:
    """For each rule of each policy: documents that fail it, and those that would stay without it.

    The ledger is counted once by its bits, of which there are at most 2 to the number of rules; all policies read those counts.
    """
    counts = led.groupBy("failed").agg(F.count(F.lit(1)).alias("docs"))
    rules = [F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask([r])).alias("bit"), F.lit(mask(POLICIES[p])).alias("mask")) for p in policies for r in POLICIES[p]]
    each = counts.select("failed", "docs", F.explode(F.array(*rules)).alias("r")).select("failed", "docs", "r.*")
    hit, alone = F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("failed").bitwiseAND(F.col("mask")) == F.col("bit")
    return each.groupBy("policy", "rule").agg(F.sum(F.when(hit, F.col("docs")).otherwise(0)).alias("fails"), F.sum(F.when(alone, F.col("docs")).otherwise(0)).alias("only_this"))
