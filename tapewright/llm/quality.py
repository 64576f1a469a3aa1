"""Host-level quality rules, in DataFrame functions only.

Every document gets counts and rule failures from its own text; the failures
are aggregated by host, each host's rates are shrunk towards an empirical beta
prior, and the verdict of a host is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import SPACE_RUN, WORD, cut, let, others, split_words

#: Words of a window whose repeats count.
WINDOW = 5
#: Hosts up to this number are broadcast to the documents; more are joined by shuffle.
BROADCAST_HOSTS = 20_000
#: The rules whose failures are aggregated by host.
RULES = ("base_failed", "symbol_heavy", "line_heavy")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words covered by windows that the array holds twice or more.

    Windows are compared by a 64-bit hash within one document. Documents without
    a repeat, nearly all, cost one pass; the others sort their windows once.
    """

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda e, j: same(e, j - 1) | same(e, j + 1)), lambda e: e["i"]))

        def length(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window))))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(let(ordered, positions), length)
        )

    def hashed(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - window)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))

    return let(words, lambda w: F.when(F.size(w) <= window, F.lit(0)).otherwise(let(hashed(w), covered))).cast("long")


def rule_columns(text: Column) -> dict[str, Column]:
    """The counts of one text. A null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = split_words(text)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, SPACE_RUN, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long"),
        "n_repeat_words": repeat_words(words),
    }


def rule_failures(n_words: Column, n_symbols: Column, n_lines: Column, n_dup_lines: Column, n_repeat_words: Column) -> dict[str, Column]:
    return {
        "base_failed": (n_words < 10) | (100 * n_repeat_words > 20 * n_words),
        "symbol_heavy": 10 * n_symbols > n_words,
        "line_heavy": 10 * n_dup_lines > 3 * n_lines,
    }


def host_rates(failures: DataFrame, host: str = "host") -> DataFrame:
    """One row a host: documents, failures and the shrunk rate of each rule.

    The prior of a rule is the beta distribution with the mean failure rate of
    all documents and the between-host variance by the method of moments: with
    weights n over H hosts and N documents, S the weighted variance of the host
    rates and m the mean, rho = (S - m(1-m)H/N) / (m(1-m)(1 - H/N)), held within
    0.000001 and 1, and prior size 1/rho - 1.
    """
    by_host = failures.groupBy(host).agg(
        F.count(F.lit(1)).alias("n_docs"), *[F.sum(F.col(r).cast("long")).alias(f"x_{r}") for r in RULES]
    )
    by_host = cut(by_host, "hosts")
    total = by_host.agg(
        F.sum("n_docs").alias("N"), F.count(F.lit(1)).alias("H"),
        *[F.sum(f"x_{r}").alias(f"x_{r}") for r in RULES],
        *[F.sum(F.col(f"x_{r}").cast("double") * F.col(f"x_{r}") / F.col("n_docs")).alias(f"q_{r}") for r in RULES],
    ).first()  # one row of sums
    n_all = total["N"] or 0
    out = by_host
    for r in RULES:
        m = (total[f"x_{r}"] or 0) / n_all if n_all else 0.0
        spread = max((total[f"q_{r}"] or 0.0) / n_all - m * m, 0.0) if n_all else 0.0
        share, unit = (total["H"] / n_all if n_all else 1.0), m * (1 - m)
        rho = (spread - unit * share) / (unit * (1 - share)) if unit > 0 and share < 1 else 1e-6
        size = 1 / min(max(rho, 1e-6), 1.0) - 1
        out = out.withColumn(f"rate_{r}", (F.col(f"x_{r}") + size * m) / (F.col("n_docs") + size))
    return out


def host_quality(docs: DataFrame, text: str = "text", host: str = "source", carry: list[str] | None = None, max_rate: float = 0.5) -> DataFrame:
    """Counts, rule failures and the verdict of every row of ``docs``.

    carry: columns of ``docs`` to keep, all by default; without the text among
    them, the counts are made once and kept as a narrow table, else they are
    made for the host rates and again for the result.

    Returns the carried columns, the counts, the three rules, ``host_rejected``
    and ``kept``: false if the row's base rule fails, or if a shrunk failure rate
    of its host is over ``max_rate``.

    Cases: a null text is empty and fails the base rule; a null host is a host
    of its own; repeated rows each count and each get a row; an empty table gives
    an empty result; carried columns named like a made one are replaced by it.
    """
    made = [*COUNTS, *RULES, "host_rejected", "kept"]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in made]
    counts = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{host}`").cast("string").alias("__host"), *[c.alias(n) for n, c in rule_columns(F.col(f"`{text}`").cast("string")).items()])
    counts = counts.withColumns(rule_failures(*[F.col(c) for c in ("n_words", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")]))
    if text not in carry:
        counts = cut(counts, "rules")
    bad = F.lit(False)
    rates = host_rates(counts, "__host")
    for r in RULES:
        bad = bad | (F.col(f"rate_{r}") > max_rate)
    rates = rates.select(F.col("__host").alias("__verdict_host"), bad.alias("host_rejected"))
    n_hosts = rates.count()
    side = F.broadcast(rates) if n_hosts <= BROADCAST_HOSTS else rates.hint("merge")
    out = counts.join(side, F.col("__host").eqNullSafe(F.col("__verdict_host")), "left")
    out = out.withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    out = out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
    return out.select(*[F.col(f"`{c}`") for c in carry], *made)


__all__ = ["host_quality", "host_rates", "others", "repeat_words", "rule_columns"]
