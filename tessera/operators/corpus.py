"""Corpus preparation (A1-A12): instruction formatting, filtering, exact
stratified / random validation splits, token budgets, prompt and chat
rendering. All operators are lazy DataFrame -> DataFrame transforms.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import word_count
from tessera.operators.paging import HEAP_ROWS, page
from tessera.session import ensure_checkpoint_dir

col = F.col
lit = F.lit

# ---------------------------------------------------------------- fixed values
INSTRUCTION_HEAD = "You are an expert SQL query generator for the "
INSTRUCTION_MID = (" domain. \nGenerate an accurate SQL query based on the given database schema "
                   "and natural language request.\nComplexity level: ")
BASIC_INSTRUCTION = "Convert the following natural language query to SQL:"
RESPONSE_MARK = "\n\n### Response:\n"
DEFAULT_DOMAIN = "general"
DEFAULT_COMPLEXITY = "basic"
MAX_LENGTH = 512
# max_length of the training profiles: default, then the smaller / larger ones
LENGTH_BUDGETS = [512, 384, 256, 128, 1024]
VALIDATION_SPLIT = 0.1
SPLIT_SEED = 42
# Prompt variants: (name, template parts in order; s = schema, q = request, d = domain)
PROMPT_VARIANTS = [
    ("schema_request", ["Database Schema:\n", "s", "\n\nRequest: ", "q"]),
    ("bare_request", ["s", "\n\nRequest: ", "q"]),
    ("bare_query", ["s", "\n\nQuery: ", "q"]),
    ("domain_request", ["Domain: ", "d", "\n\n", "s", "\n\nRequest: ", "q"]),
    ("inline", ["Database Schema: ", "s", "; Request: ", "q"]),
    ("context_query", ["Context: ", "s", "\nQuery: ", "q"]),
]
CHAT_START = "<|im_start|>"
CHAT_END = "<|im_end|>"
# -----------------------------------------------------------------------------


def _txt(c: str) -> Column:
    return F.coalesce(col(c), lit(""))


def _output_text() -> Column:
    return F.concat(lit("```sql\n"), _txt("sql"), lit("\n```\n\nExplanation: "), _txt("sql_explanation"))


def limit_samples(df: DataFrame, n: int | None, key: str = "sample_id", heap_rows: int = HEAP_ROWS) -> DataFrame:
    """The first ``n`` samples in dataset order (``key``); a falsy ``n``
    (None / 0) keeps all. Few are TakeOrdered (per-partition top-n, no global
    sort); more than ``heap_rows`` are found by rank (``paging``), so no task
    merges them. The reference raises when n exceeds the size; here the whole
    input is returned instead (checking would cost a count pass)."""
    if not n:
        return df
    return page(df, [(key, True)], 0, int(n), heap_rows)


def format_samples(df: DataFrame) -> DataFrame:
    """A1: raw sample -> instruction / input / output (+ domain, complexity).
    Missing (NULL) fields take the reference defaults."""
    domain = F.coalesce(col("domain"), lit(DEFAULT_DOMAIN))
    cx = F.coalesce(col("sql_complexity"), lit(DEFAULT_COMPLEXITY))
    return df.select(
        "sample_id",
        F.concat(lit(INSTRUCTION_HEAD), domain, lit(INSTRUCTION_MID), cx).alias("instruction"),
        F.concat(lit("Database Schema:\n"), _txt("sql_context"), lit("\n\nRequest: "),
                 _txt("sql_prompt")).alias("input"),
        _output_text().alias("output"), domain.alias("domain"), cx.alias("complexity"))


def format_samples_basic(df: DataFrame) -> DataFrame:
    """A2: guide variant with a fixed instruction."""
    return df.select(
        "sample_id", lit(BASIC_INSTRUCTION).alias("instruction"),
        F.concat(lit("Context: "), _txt("sql_context"), lit("\n\nQuery: "), _txt("sql_prompt")).alias("input"),
        _output_text().alias("output"))


def format_samples_enhanced(df: DataFrame) -> DataFrame:
    """A3: guide variant with Domain / Complexity header lines."""
    d, c = _txt("domain"), _txt("sql_complexity")
    return df.select(
        "sample_id",
        F.concat(lit("Generate SQL query for the "), d, lit(" domain.")).alias("instruction"),
        F.concat(lit("Domain: "), d, lit("\nComplexity: "), c, lit("\n\nContext: "), _txt("sql_context"),
                 lit("\n\nQuery: "), _txt("sql_prompt")).alias("input"),
        _output_text().alias("output"))


def is_formattable(df: DataFrame) -> Column:
    """A4 rule: a sample needs its key and both the question and the SQL."""
    return col("sample_id").isNotNull() & col("sql_prompt").isNotNull() & col("sql").isNotNull()


def skip_bad_samples(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A4: (formattable rows, quarantined rows) — two filters of one input."""
    ok = is_formattable(df)
    return df.filter(ok), df.filter(~ok | ok.isNull())


def split_key(id_col: str, seed: int = SPLIT_SEED) -> Column:
    """Deterministic, partition-independent pseudo-random order key."""
    return F.md5(F.concat(col(id_col).cast("string"), lit(f"-{seed}")))


EVERY = "__all__"
SMALL_ROWS = 100_000  # rows of a per-label table that may be broadcast (about 100 bytes each)


def _quotas(counts: DataFrame, frac: float) -> DataFrame:
    """(_l, stratum, quota) from the per-label counts (_l, n_c).

    Stratified when the reference guard holds (smallest class >= 2, n > 20)
    and the validation / train sizes can hold one row per class (else the
    reference's stratified call raises and it falls back); otherwise every
    label maps to one stratum '__all__' with quota ceil(n * frac).
    Quotas: floor(n_c * val_n / n), remainder handed out one each by largest
    fractional part, ties by label (exact decimal arithmetic).
    """
    total = counts.agg(F.sum("n_c").alias("n"), F.count(lit(1)).alias("n_classes"), F.min("n_c").alias("min_c")).first()
    n = total["n"] or 0
    val_n = math.ceil(n * frac)
    guard = bool(n) and total["min_c"] >= 2 and n > 20 and total["n_classes"] <= min(val_n, n - val_n)
    c = counts.withColumn("stratum", col("_l") if guard else lit(EVERY))
    share = col("n_s").cast("decimal(18,0)") * lit(val_n).cast("decimal(18,0)")
    s = c.groupBy("stratum").agg(F.sum("n_c").alias("n_s")) \
        .withColumn("base_q", F.floor(share / lit(max(n, 1)).cast("decimal(18,0)")).cast("bigint")) \
        .withColumn("rem_num", share % lit(max(n, 1)).cast("decimal(18,0)"))
    rem = val_n - (s.agg(F.sum("base_q")).first()[0] or 0)      # fewer than the strata
    # the strata with the largest remainders: a bounded top-k, no global ranking
    extra = s.orderBy(col("rem_num").desc(), "stratum").limit(int(rem)).select("stratum", lit(1).alias("one"))
    s = s.join(extra, "stratum", "left").withColumn("quota", col("base_q") + F.coalesce("one", lit(0)))
    return c.select("_l", "stratum").join(s.select("stratum", "quota"), "stratum")


def quota_split(df: DataFrame, id_col: str, label: str | None, frac: float = VALIDATION_SPLIT,
                seed: int = SPLIT_SEED, bucket_hex: int = 4) -> DataFrame:
    """A5 + A6: exact-size validation split, class-proportional when the
    guard allows, adding a ``split`` column ('train' / 'validation'). A NULL
    label is a class of its own; ``label=None`` is the plain random split.

    Membership: per stratum, the ``quota`` rows with the smallest
    md5(id || '-seed'). A per-stratum ``row_number`` would sort a hot stratum
    (or, for the random split, the whole table) in one task. Instead one
    aggregation counts rows per label and leading ``bucket_hex`` hex digits of
    the key; it is written to the shared folder (at most 16^bucket_hex rows per
    label), so that the plans below know its size. The bucket where the
    cumulative count crosses the quota is located, every row below it is
    taken, and only rows inside that one bucket are ranked. The rows themselves
    are never shuffled or sorted: they meet the per-label table in a broadcast
    while it is small, and the random split has only literals.
    """
    spark = df.sparkSession
    name = lit(EVERY) if label is None else F.coalesce(F.concat(lit("="), col(label).cast("string")), lit("null"))
    keyed = df.withColumn("_l", name).withColumn("_k", split_key(id_col, seed)) \
        .withColumn("_b", F.conv(F.substring("_k", 1, bucket_hex), 16, 10).cast("int"))
    hist_dir = f"{ensure_checkpoint_dir(spark)}/split-{uuid.uuid4().hex}"
    keyed.groupBy("_l", "_b").agg(F.count(lit(1)).alias("c")).write.parquet(hist_dir)
    hist = spark.read.schema("_l string, _b int, c bigint").parquet(hist_dir)
    counts = hist.groupBy("_l").agg(F.sum("c").alias("n_c"))
    if label is None:
        n = counts.agg(F.sum("n_c")).first()[0] or 0
        quotas = spark.createDataFrame([(EVERY, EVERY, math.ceil(n * frac))], "_l string, stratum string, quota bigint")
    else:
        quotas = _quotas(counts, frac)
    by_stratum = hist.join(quotas, "_l").groupBy("stratum", "_b").agg(F.sum("c").alias("c"), F.first("quota").alias("quota"))
    w = Window.partitionBy("stratum").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    cut = (by_stratum.withColumn("cum", F.sum("c").over(w)).withColumn("prev", col("cum") - col("c"))
           .filter((col("prev") < col("quota")) & (col("cum") >= col("quota")))
           .select("stratum", col("_b").alias("cut_b"), (col("quota") - col("prev")).alias("need")))
    table_dir = f"{hist_dir}-cuts"
    quotas.select("_l", "stratum").join(cut, "stratum").write.parquet(table_dir)
    cuts = spark.read.schema("stratum string, _l string, cut_b int, need bigint").parquet(table_dir)

    def meet(rows: DataFrame, table: DataFrame, n_rows: int, how: str) -> DataFrame:
        return rows.join(F.broadcast(table) if n_rows <= SMALL_ROWS else table, "_l", how)

    def literals(rows: DataFrame, table: DataFrame) -> DataFrame:
        row = table.drop("_l").first()
        kinds = dict(table.dtypes)
        return rows.withColumns({c: lit(row[c] if row else None).cast(kinds[c]) for c in kinds if c != "_l"})

    n_cuts = cuts.count()
    # Inside the cut bucket (about n_s / 16^bucket_hex rows) find the key of
    # the need-th row; everything at or below it is in validation.
    inside = literals(keyed, cuts) if label is None else meet(keyed, cuts, n_cuts, "inner")
    wb = Window.partitionBy("stratum").orderBy("_k", id_col)
    thr = (inside.filter(col("_b") == col("cut_b")).withColumn("_rn", F.row_number().over(wb)).filter(col("_rn") == col("need"))
           .select("stratum", col("_k").alias("t_k"), col(id_col).alias("t_id")))
    last_dir = f"{hist_dir}-last"
    cuts.join(thr, "stratum").select("_l", "cut_b", "t_k", "t_id").write.parquet(last_dir)
    last = spark.read.schema(f"_l string, cut_b int, t_k string, t_id {df.schema[id_col].dataType.simpleString()}").parquet(last_dir)
    j = literals(keyed, last) if label is None else meet(keyed, last, n_cuts, "left")
    at_or_below = (col("_k") < col("t_k")) | ((col("_k") == col("t_k")) & (col(id_col) <= col("t_id")))
    is_val = (col("_b") < col("cut_b")) | ((col("_b") == col("cut_b")) & at_or_below)
    return (j.withColumn("split", F.when(F.coalesce(is_val, lit(False)), lit("validation")).otherwise(lit("train")))
            .drop("_l", "_k", "_b", "cut_b", "t_k", "t_id"))


def split_balance(split_df: DataFrame, label: str) -> DataFrame:
    """Class counts per split."""
    return split_df.groupBy("split", label).agg(F.count(lit(1)).alias("n_samples"))


def filter_by_values(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Keep rows whose ``column`` is one of ``values``."""
    return df.filter(col(column).isin(list(values)))


def word_count_literal(s: str) -> int:
    return len(s.split())


def supervised_spans(formatted: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """A9 (re-aimed): token accounting of the causal-LM example with a
    portable whitespace tokenizer. Sequence = prompt + output + eos."""
    # instruction + "\n\n" + input + marker: the separators are whitespace and
    # the marker is two words, so counting the parts avoids building the
    # concatenated (whole-document) prompt string.
    n_prompt = word_count(col("instruction")) + word_count(col("input")) + lit(word_count_literal(RESPONSE_MARK))
    m = lit(max_length)
    staged = formatted.select("sample_id", n_prompt.alias("n_prompt"), word_count(col("output")).alias("_n_out"))
    return (staged.select("sample_id", "n_prompt", (col("n_prompt") + col("_n_out") + lit(1)).alias("n_total"))
            .withColumn("n_kept", F.least(col("n_total"), m))
            .withColumn("n_supervised", F.greatest(lit(0), col("n_kept") - F.least(col("n_prompt"), m)))
            .withColumn("is_truncated", col("n_total") > m))


def length_budget_report(spans: DataFrame, budgets: Sequence[int] = LENGTH_BUDGETS) -> DataFrame:
    """A10: share of samples that overflow each max_length budget, in one
    aggregation pass (conditional sums), then unpivoted."""
    aggs = [F.count(lit(1)).alias("n")] + [
        F.sum(F.when(col("n_total") > b, 1).otherwise(0)).cast("bigint").alias(f"t{b}") for b in budgets]
    wide = spans.agg(*aggs)
    stack = ", ".join(f"{b}, t{b}" for b in budgets)
    long = wide.selectExpr("n", f"stack({len(budgets)}, {stack}) AS (max_length, n_truncated)")
    return long.select(col("max_length").cast("int"), col("n").alias("n_samples"), "n_truncated",
                       F.round(col("n_truncated") / F.nullif(col("n"), lit(0)), 6).alias("truncated_share"))


def render_prompts(df: DataFrame, schema: str = "sql_context", request: str = "sql_prompt",
                   domain: str = "domain", key: str = "sample_id") -> DataFrame:
    """Every prompt variant per row (row count x number of variants)."""
    ref = {"s": _txt(schema), "q": _txt(request), "d": _txt(domain)}
    variants = [F.struct(lit(name).alias("variant"),
                         F.concat(*[ref[p] if p in ref else lit(p) for p in parts]).alias("prompt"))
                for name, parts in PROMPT_VARIANTS]
    return df.select(key, F.inline(F.array(*variants)))


def chat_turns(conv: DataFrame, block: int = 1024) -> DataFrame:
    """ChatML rendering, one segment per turn:
    ``<|im_start|>{role}\n{text}<|im_end|>\n``. A conversation's text is the
    concatenation of its segments in ``turn`` order; ``char_offset`` gives
    each segment's start, so a writer can lay them out without gathering a
    conversation into one row.

    The running offset is a two-level prefix sum so that no window holds a
    whole (possibly huge) conversation: turns are cut into blocks of
    ``block`` consecutive turn numbers; block totals (a partial aggregation)
    give each block's start, and the running sum inside a block covers at
    most ``block`` rows."""
    seg = F.concat(lit(CHAT_START), col("role"), lit("\n"), F.coalesce(col("text"), lit("")),
                   lit(CHAT_END + "\n"))
    t = (conv.select("conv_id", "turn", "role", seg.alias("segment"))
         .withColumn("_blk", F.floor(col("turn") / lit(block)))
         .withColumn("_len", F.length("segment").cast("bigint")))
    totals = t.groupBy("conv_id", "_blk").agg(F.sum("_len").alias("_tot"))
    wb = Window.partitionBy("conv_id").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("_start", F.coalesce(F.sum("_tot").over(wb), lit(0))).drop("_tot")
    wi = Window.partitionBy("conv_id", "_blk").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    inner = t.withColumn("_in", F.coalesce(F.sum("_len").over(wi), lit(0)))
    return (inner.join(starts, ["conv_id", "_blk"])
            .select("conv_id", "turn", "role", "segment", (col("_start") + col("_in")).cast("bigint").alias("char_offset")))
