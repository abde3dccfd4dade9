"""Bindings for corpus preparation (S1, S2, S6, A1-A12) on the derived
``samples`` / ``chat`` views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import corpus as C
from tessera.plans import register
from tessera.plans import fixtures as FX
from tessera.plans.sqltext import lit_text as L
from tessera.plans.sqltext import word_count as WC

col = F.col


def cat(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


def _instr(domain: str, cx: str) -> str:
    return cat(L(C.INSTRUCTION_HEAD), domain, L(C.INSTRUCTION_MID), cx)


OUT_SQL = cat(L("```sql\n"), "coalesce(sql, '')", L("\n```\n\nExplanation: "), "coalesce(sql_explanation, '')")
DOM = f"coalesce(domain, '{C.DEFAULT_DOMAIN}')"
CX = f"coalesce(sql_complexity, '{C.DEFAULT_COMPLEXITY}')"
FORMAT_SQL = f"""SELECT sample_id, {_instr(DOM, CX)} AS instruction,
 {cat(L('Database Schema:' + chr(10)), "coalesce(sql_context, '')", L(chr(10) * 2 + 'Request: '), "coalesce(sql_prompt, '')")} AS input,
 {OUT_SQL} AS output, {DOM} AS domain, {CX} AS complexity FROM samples"""


@register("load_samples", FX.with_views("samples") + "SELECT * FROM samples")
def load_samples(spark, d):
    # A Parquet corpus read through the loader (explicit schema)
    from tessera.sources.sinks import scratch_path
    from tessera.sources.tables import load_samples as load
    path = scratch_path(spark, "corpus")
    FX.samples(spark, d).write.parquet(path)
    return load(spark, path).select("sample_id", "domain", "sql_complexity", "sql_context", "sql_prompt", "sql", "sql_explanation")


@register("limit_samples", FX.with_views("samples") + "SELECT * FROM samples ORDER BY sample_id LIMIT 100")
def limit_samples(spark, d):
    # first N in dataset order: an order key is mandatory (bare limit is nondeterministic)
    return C.limit_samples(FX.samples(spark, d), 100)


@register("limit_samples_large", FX.with_views("samples") + """
SELECT sample_id, domain, sql_complexity, sql FROM samples ORDER BY sample_id LIMIT (SELECT count(*) // 2 FROM samples)""")
def limit_samples_large(spark, d):
    # half of the corpus: cut by rank, merged in no task
    s = FX.samples(spark, d).select("sample_id", "domain", "sql_complexity", "sql")
    return C.limit_samples(s, s.count() // 2, heap_rows=0)


@register("format_samples", FX.with_views("samples") + FORMAT_SQL)
def format_samples(spark, d):
    return C.format_samples(FX.samples(spark, d))


@register("format_samples_basic", FX.with_views("samples") + f"""
SELECT sample_id, {L(C.BASIC_INSTRUCTION)} AS instruction,
 {cat(L('Context: '), "coalesce(sql_context, '')", L(chr(10) * 2 + 'Query: '), "coalesce(sql_prompt, '')")} AS input,
 {OUT_SQL} AS output FROM samples""")
def format_samples_basic(spark, d):
    return C.format_samples_basic(FX.samples(spark, d))


@register("format_samples_enhanced", FX.with_views("samples") + f"""
SELECT sample_id, {cat(L('Generate SQL query for the '), "coalesce(domain, '')", L(' domain.'))} AS instruction,
 {cat(L('Domain: '), "coalesce(domain, '')", L(chr(10) + 'Complexity: '), "coalesce(sql_complexity, '')",
      L(chr(10) * 2 + 'Context: '), "coalesce(sql_context, '')", L(chr(10) * 2 + 'Query: '),
      "coalesce(sql_prompt, '')")} AS input,
 {OUT_SQL} AS output FROM samples""")
def format_samples_enhanced(spark, d):
    return C.format_samples_enhanced(FX.samples(spark, d))


@register("skip_bad_samples", FX.with_views("raw_samples") + """
SELECT count(*) AS n_total,
 count(*) FILTER (WHERE sample_id IS NOT NULL AND sql_prompt IS NOT NULL AND sql IS NOT NULL) AS n_formatted,
 count(*) FILTER (WHERE NOT (sample_id IS NOT NULL AND sql_prompt IS NOT NULL AND sql IS NOT NULL)) AS n_skipped
FROM raw_samples""")
def skip_bad_samples(spark, d):
    s = FX.raw_samples(spark, d)
    ok = C.is_formattable(s)
    return s.agg(F.count(F.lit(1)).alias("n_total"),
                 F.count(F.when(ok, 1)).alias("n_formatted"),
                 F.count(F.when(~ok, 1)).alias("n_skipped"))


def _split_sql(label_expr: str, frac: float = C.VALIDATION_SPLIT, force_random: bool = False) -> str:
    guard = "FALSE" if force_random else \
        "g.min_c >= 2 AND g.n > 20 AND g.val_n >= g.n_classes AND g.n - g.val_n >= g.n_classes"
    return f""",
base AS (SELECT sample_id, {label_expr} AS label,
         md5(concat(CAST(sample_id AS VARCHAR), '-{C.SPLIT_SEED}')) AS k FROM samples),
cnt AS (SELECT label, count(*) AS n_c FROM base GROUP BY label),
g AS (SELECT sum(n_c) AS n, count(*) AS n_classes, min(n_c) AS min_c,
             CAST(ceil(sum(n_c) * {frac}) AS BIGINT) AS val_n FROM cnt),
strat AS (SELECT c.label, CASE WHEN {guard} THEN c.label ELSE '__all__' END AS stratum FROM cnt c, g),
scnt AS (SELECT s.stratum, sum(c.n_c) AS n_s FROM strat s JOIN cnt c USING (label) GROUP BY s.stratum),
q0 AS (SELECT stratum, (n_s * g.val_n) // g.n AS base_q, (n_s * g.val_n) % g.n AS rem_num, g.val_n FROM scnt, g),
q1 AS (SELECT *, row_number() OVER (ORDER BY rem_num DESC, stratum) AS fr_rank,
              val_n - sum(base_q) OVER () AS rem FROM q0),
quota AS (SELECT stratum, base_q + CASE WHEN fr_rank <= rem THEN 1 ELSE 0 END AS quota FROM q1),
ranked AS (SELECT b.sample_id, b.label, s.stratum,
           row_number() OVER (PARTITION BY s.stratum ORDER BY b.k, b.sample_id) AS rn
           FROM base b JOIN strat s USING (label)),
split AS (SELECT r.sample_id, r.label AS complexity,
          CASE WHEN r.rn <= q.quota THEN 'validation' ELSE 'train' END AS split
          FROM ranked r JOIN quota q USING (stratum))
"""


SPLIT_CTE = FX.with_views("samples")[:-1] + _split_sql(CX)


@register("stratified_split", SPLIT_CTE + "SELECT * FROM split")
def stratified_split(spark, d):
    f = C.format_samples(FX.samples(spark, d))
    return C.quota_split(f, "sample_id", "complexity").select("sample_id", "complexity", "split")


@register("random_split", FX.with_views("samples")[:-1] + _split_sql("'all'", force_random=True) +
          "SELECT sample_id, split FROM split")
def random_split(spark, d):
    # One stratum -> exactly ceil(0.1 n) rows with the smallest keys.
    return C.quota_split(FX.samples(spark, d).select("sample_id"), "sample_id", None).select("sample_id", "split")


# labels as they come: a NULL one is a class of its own, no row is lost
@register("split_null_labels", FX.with_views("raw_samples")[:-1] + _split_sql("coalesce(domain, '~')").replace(
    "FROM samples", "FROM raw_samples WHERE sample_id IS NOT NULL") + "SELECT sample_id, nullif(complexity, '~') AS domain, split FROM split")
def split_null_labels(spark, d):
    s = FX.raw_samples(spark, d).filter("sample_id IS NOT NULL").select("sample_id", "domain")
    return C.quota_split(s, "sample_id", "domain").select("sample_id", "domain", "split")


@register("split_balance", SPLIT_CTE + """
SELECT split, complexity, count(*) AS n_samples FROM split GROUP BY split, complexity""")
def split_balance(spark, d):
    return C.split_balance(stratified_split(spark, d), "complexity")


@register("filter_by_complexity", FX.with_views("samples") +
          "SELECT sample_id, sql_complexity FROM samples WHERE sql_complexity IN ('de', 'fr')")
def filter_by_complexity(spark, d):
    return C.filter_by_values(FX.samples(spark, d), "sql_complexity", ["de", "fr"]) \
        .select("sample_id", "sql_complexity")


@register("filter_by_domain", FX.with_views("samples") +
          "SELECT sample_id, domain FROM samples WHERE domain IN ('src1', 'src2', 'src3')")
def filter_by_domain(spark, d):
    return C.filter_by_values(FX.samples(spark, d), "domain", ["src1", "src2", "src3"]) \
        .select("sample_id", "domain")


SPANS_CTE = FX.with_views("samples", extra=f"""fmt AS ({FORMAT_SQL}),
spans0 AS (SELECT sample_id,
  {WC(cat('instruction', L(chr(10) * 2), 'input', L(C.RESPONSE_MARK)))} AS n_prompt,
  {WC(cat('instruction', L(chr(10) * 2), 'input', L(C.RESPONSE_MARK)))} + {WC('output')} + 1 AS n_total FROM fmt),
spans AS (SELECT sample_id, n_prompt, n_total, least(n_total, {C.MAX_LENGTH}) AS n_kept,
  greatest(0, least(n_total, {C.MAX_LENGTH}) - least(n_prompt, {C.MAX_LENGTH})) AS n_supervised,
  n_total > {C.MAX_LENGTH} AS is_truncated FROM spans0)""")


@register("supervised_spans", SPANS_CTE + "SELECT * FROM spans")
def supervised_spans(spark, d):
    return C.supervised_spans(C.format_samples(FX.samples(spark, d)))


@register("length_budget_report", SPANS_CTE + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT {b} AS max_length, count(*) AS n_samples, CAST(count(*) FILTER (WHERE n_total > {b}) AS BIGINT)"
    f" AS n_truncated, round(count(*) FILTER (WHERE n_total > {b}) / count(*), 6) AS truncated_share FROM spans"
    for b in C.LENGTH_BUDGETS) + ")")
def length_budget_report(spark, d):
    return C.length_budget_report(supervised_spans(spark, d))


def _variant_sql(name, parts):
    ref = {"s": "coalesce(sql_context, '')", "q": "coalesce(sql_prompt, '')", "d": "coalesce(domain, '')"}
    return (f"SELECT sample_id, '{name}' AS variant, "
            f"{cat(*[ref[p] if p in ref else L(p) for p in parts])} AS prompt FROM samples")


@register("render_prompts", FX.with_views("samples") +
          " UNION ALL ".join(_variant_sql(n, p) for n, p in C.PROMPT_VARIANTS))
def render_prompts(spark, d):
    return C.render_prompts(FX.samples(spark, d))


@register("chat_template", FX.with_views("chat") + f"""
SELECT conv_id, turn, role, segment,
  CAST(coalesce(sum(length(segment)) OVER (PARTITION BY conv_id ORDER BY turn
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_offset
FROM (SELECT conv_id, turn, role,
  {cat(L(C.CHAT_START), 'role', L(chr(10)), "coalesce(text, '')", L(C.CHAT_END + chr(10)))} AS segment FROM chat)""")
def chat_template(spark, d):
    return C.chat_turns(FX.chat(spark, d))


@register("load_custom_samples", FX.with_views("samples") + f"""
SELECT sample_id, {_instr("'general'", "'basic'")} AS instruction,
 {cat(L('Database Schema:' + chr(10)), "coalesce(sql_context, '')", L(chr(10) * 2 + 'Request: '), "coalesce(sql_prompt, '')")} AS input,
 {cat(L("```sql" + chr(10)), "coalesce(sql, '')", L(chr(10) + "```" + chr(10) * 2 + "Explanation: "))} AS output,
 'general' AS domain, 'basic' AS complexity FROM samples""")
def load_custom_samples(spark, d):
    # A user file holding only sql_context / sql_prompt / sql (JSON lines);
    # the loader's explicit schema reads the other fields as NULL and A1
    # applies the defaults.
    from tessera.sources.sinks import scratch_path
    from tessera.sources.tables import load_samples as load
    path = scratch_path(spark, "custom_samples")
    FX.samples(spark, d).select("sample_id", "sql_context", "sql_prompt", "sql").write.json(path)
    return C.format_samples(load(spark, path, fmt="json"))


# Ten kinds of damage, one sample in eleven whole (doc_id % 11): what becomes of each line.
_DAMAGE = [
    ("sample", 0), ("sample", 1), ("not json", 0), ("not json", 0), ("blank line", 0), ("not an object", 0),
    ("wrong type: sql", 0), ("wrong type: sample_id, sql_context", 0), ("not utf-8", 0), ("not json", 0), ("sample", 0),
]


@register("load_quarantine", "WITH " + FX.values_sql("damage", "k, reason, rescued", [(k, *r) for k, r in enumerate(_DAMAGE)]) + """
SELECT reason, count(*) AS n, sum(rescued)::BIGINT AS n_rescued FROM documents JOIN damage ON doc_id % 11 = k GROUP BY reason""")
def load_quarantine(spark, d):
    # A JSON-lines corpus with damaged lines, each accounted for
    from tessera.sources import quarantine as Q
    from tessera.sources.sinks import scratch_path

    s = FX.samples(spark, d)
    whole = F.to_json(F.struct("sample_id", "sql_prompt", "sql", "domain"))
    sql = F.to_json(F.struct("sql"))
    lines = [whole, F.to_json(F.struct("sample_id", "sql", F.lit("mysql").alias("dialect"))), F.expr("left(w, length(w) - 1)"),
             F.concat("w", F.lit(" "), "w"), F.lit("  "), F.concat(F.lit("["), "w", F.lit("]")),
             F.to_json(F.struct("sample_id", F.col("sample_id").alias("sql"))),
             F.to_json(F.struct(F.col("domain").alias("sample_id"), F.array("sql").alias("sql_context"))),
             F.concat(F.lit("{\"sql\": \"\ufffd\"} "), F.lit("")), F.concat(F.lit("{"), F.expr("substring(q, 2, length(q) - 2)"), F.lit(","),
                                                                           F.expr("substring(q, 2, length(q) - 2)"), F.lit("}")),
             F.lit("{}")]
    line = None
    for k, x in enumerate(lines):
        hit = F.col("sample_id") % 11 == k
        line = F.when(hit, x) if line is None else line.when(hit, x)
    path = scratch_path(spark, "damaged")
    s.withColumn("w", whole).withColumn("q", sql).select(line.alias("value")).write.text(path)
    return Q.account(Q.load_lines(spark, path))
