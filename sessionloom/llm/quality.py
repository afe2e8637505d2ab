"""Quality rules with host-level verdicts (operator 5), in DataFrame functions only.

Every document is measured by itself; each rule says whether it fails. The failures are summed by host (map-side first,
so a host with a third of all rows is one row of each task's result), a host's rate for each rule is shrunk towards the
corpus with a beta prior whose mean and strength are fitted to the spread of the hosts' rates (method of moments), and
a host is rejected if a shrunk rate exceeds `host_limit`. Host verdicts are joined back: as a broadcast if there are at
most `broadcast_hosts` of them, otherwise by host and salt, each host repeated for every salt.

Null texts have no words and fail; a null host is the host "". Rows that repeat count as documents of their own. A
host that is seen once is pulled to the prior and is never rejected by one bad page in a clean corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Limits of the rules, as shares of a document's words or lines.
LIMITS = {"min_words": 50, "repeat_percent": 50, "symbols_per_word": 0.2, "exclamations_per_word": 0.3, "dup_line_share": 0.5}
_BLANK = " \t\n\x0b\x0c\r"


def with_signals(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_exclamations and n_lines (long)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    p = f"__sessionloom_{prefix}"
    words, windows, order, at = f"{p}words", f"{p}windows", f"{p}order", f"{p}at"
    split = F.array_remove(F.split(text, common.WHITE, -1), "")
    # a window's hash stands at its first word; within one text two of 64 bits meet by chance in under 1e-11 of 20,000 words
    hashed = F.slice(F.transform(words, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2))), 1, F.greatest(F.size(words) - 2, F.lit(0)))
    pairs = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    twice = F.filter(order, lambda x, k: F.coalesce(F.get(order, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(order, k + 1)["h"] == x["h"], F.lit(False)))
    covered = F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    # always 0; not deterministic, so that no filter on the signals moves below the steps and copies one into another's lambda
    barrier = F.pmod(F.monotonically_increasing_id(), F.lit(1))
    chars = lambda kept: F.length(text) - F.length(F.translate(text, kept, ""))
    return (
        docs.withColumn(words, split)
        .withColumn(windows, hashed)
        .withColumn(order, F.when(F.size(F.array_distinct(windows)) < F.size(windows), pairs))
        .withColumn(at, F.sort_array(F.transform(twice, lambda x: x["i"])))
        .withColumn(f"{p}lines", lines)
        .withColumns({
            f"{prefix}n_words": F.size(words).cast("long") + barrier,
            f"{prefix}word_chars": F.length(F.translate(text, _BLANK, "")).cast("long"),
            f"{prefix}n_symbols": chars("#*$%&|<>").cast("long"),
            f"{prefix}n_dup_lines": (F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines"))).cast("long"),
            f"{prefix}n_repeat_words": F.when(F.col(order).isNull(), 0).otherwise(covered).cast("long"),
            f"{prefix}n_exclamations": chars("!").cast("long"),
            f"{prefix}n_lines": F.size(f"{p}lines").cast("long"),
        })
        .drop(words, windows, order, at, f"{p}lines")
    )


def rules(prefix: str = "", limits: dict = LIMITS) -> dict[str, Column]:
    """For each rule, whether a document fails it."""
    c = lambda name: F.col(prefix + name)
    return {
        "short": c("n_words") < limits["min_words"],
        "repetitive": 100 * c("n_repeat_words") > limits["repeat_percent"] * c("n_words"),
        "symbols": c("n_symbols") > limits["symbols_per_word"] * c("n_words"),
        "shouting": c("n_exclamations") > limits["exclamations_per_word"] * c("n_words"),
        "copied_lines": c("n_dup_lines") > limits["dup_line_share"] * c("n_lines"),
    }


def host_verdicts(measured: DataFrame, host: Column, prefix: str = "", host_limit: float = 0.5, limits: dict = LIMITS) -> DataFrame:
    """(host, n_docs, <rule>_rate for each rule, host_kept): shrunk failure rates and the verdict of each host."""
    names = list(rules(prefix, limits))
    fails = [F.sum(rule.cast("long")).alias(name) for name, rule in rules(prefix, limits).items()]
    hosts = measured.groupBy(F.coalesce(host, F.lit("")).alias("host")).agg(F.count("*").alias("n_docs"), *fails)
    share = {name: F.col(name) / F.col("n_docs") for name in names}
    # one row for the whole corpus
    spread = hosts.agg(F.sum("n_docs").alias("n"), *(F.sum(name).alias(f"{name}_n") for name in names), *(F.var_pop(share[name]).alias(f"{name}_v") for name in names)).first()
    rates = {}
    for name in names:
        mean = (spread[f"{name}_n"] or 0) / (spread["n"] or 1)
        variance = spread[f"{name}_v"] or 0.0
        strength = min(1e6, max(1.0, mean * (1 - mean) / variance - 1)) if variance > 0 else 1e6
        rates[f"{name}_rate"] = (F.col(name) + mean * strength) / (F.col("n_docs") + strength)
    rated = hosts.select("host", "n_docs", *(rate.alias(name) for name, rate in rates.items()))
    return rated.withColumn("host_kept", F.greatest(*rates) <= host_limit)


def join_hosts(docs: DataFrame, hosts: DataFrame, host: Column, row: Column, broadcast_hosts: int = 10_000, salts: int = 32) -> DataFrame:
    """docs with the columns of hosts; every host of docs is in hosts. row numbers the rows: it deals a host's over the salts."""
    key, salt = "__sessionloom_host", "__sessionloom_salt"
    named = hosts.withColumnRenamed("host", key)
    keyed = docs.withColumn(key, F.coalesce(host, F.lit("")))
    if hosts.limit(broadcast_hosts + 1).count() <= broadcast_hosts:
        return keyed.join(F.broadcast(named), key).drop(key)
    keyed = keyed.withColumn(salt, F.pmod(row, F.lit(salts)).cast("int"))
    named = named.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return keyed.join(named, [key, salt]).drop(key, salt)


def judge(docs: DataFrame, host_col: str = "source", id_col: str = "doc_id", text_col: str = "text", host_limit: float = 0.5, limits: dict = LIMITS) -> DataFrame:
    """One row per document: id, host, the signals, base_failed, failed (names of failed rules), host_kept, kept."""
    row = "__sessionloom_row"
    slim = docs.select(F.monotonically_increasing_id().alias(row), F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    measured = common.materialise(with_signals(slim).drop("text"), "quality-signals")
    hosts = common.materialise(host_verdicts(measured, F.col("host"), "", host_limit, limits).select("host", "host_kept"), "quality-hosts")
    failed = F.filter(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules("", limits).items())), lambda x: x.isNotNull())
    joined = join_hosts(measured, hosts, F.col("host"), F.col(row)).drop(row)
    return joined.withColumns({"failed": failed, "base_failed": rules("", limits)["short"] | rules("", limits)["repetitive"]}).withColumn("kept", (F.size("failed") == 0) & F.col("host_kept"))


def keep_good(docs: DataFrame, host_col: str = "source", text_col: str = "text", host_limit: float = 0.5, limits: dict = LIMITS) -> DataFrame:
    """The documents that judge() keeps, with the columns of docs unchanged. docs must be a stored table, read again by row."""
    row = "__sessionloom_row"
    common.pin_splits(docs.sparkSession)
    keyed = docs.withColumn(row, F.monotonically_increasing_id())
    slim = keyed.select(row, F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    measured = common.materialise(with_signals(slim).drop("text"), "quality-signals")
    hosts = common.materialise(host_verdicts(measured, F.col("host"), "", host_limit, limits).select("host", "host_kept"), "quality-hosts")
    passed = F.lit(True)
    for rule in rules("", limits).values():
        passed = passed & ~rule
    good = join_hosts(measured.where(passed).select(row, "host"), hosts, F.col("host"), F.col(row)).where("host_kept").select(row)
    # as many rows as documents: never a broadcast
    return keyed.join(common.materialise(good, "quality-good").hint("merge"), row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
