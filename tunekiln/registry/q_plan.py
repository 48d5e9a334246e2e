"""Corpus planning (§2.10) and the override join (§2.4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formats as fm
from ..functions import text as tx
from ..operators import audit as au
from ..plans import catalog as cat
from ..plans import corpus_plan as pl
from ..plans import rules as ru
from ..sources import fixtures as fx
from .common import D_PAIRS, d_np_quantile, d_tokens_f, register

TASKS = ["chat", "code", "math", "roleplay", "cpt"]


def plan_corpus(spark, sf) -> DataFrame:
    parts = [fx.reply_records(spark, sf), fx.messages_records(spark, sf),
             fx.pair_records(spark, sf).drop("conv_id", "turn")]
    return reduce(lambda a, b: a.unionByName(b), parts)


# DuckDB: A's per-row token estimate for the same slices.
D_PLAN_ROWS = D_PAIRS + f""",
pa AS (
  SELECT source AS slice, {d_tokens_f("coalesce(lang, '') || ' ' || coalesce(text, '')")} AS tokens_f FROM documents
  UNION ALL
  SELECT 'conversations', {d_tokens_f('t')} FROM (
    SELECT string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
  UNION ALL
  SELECT 'pairs', {d_tokens_f("coalesce(instruction, '') || ' ' || coalesce(output, '')")} FROM pairs),
ps0 AS (SELECT slice, count(*) AS n, list_sort(list(tokens_f)) AS st FROM pa GROUP BY slice),
ps AS (SELECT slice, n, CAST(trunc(""" + d_np_quantile('st', 'n', 0.95) + """) AS BIGINT) AS p95_tokens FROM ps0),
psl AS (
  SELECT *, CASE WHEN raw_len > 8192 THEN least(raw_len, 16384) ELSE raw_len END AS seq_len FROM (
    SELECT *, greatest(512, (p95_tokens // 512 + 1) * 512) AS raw_len FROM ps))
"""


@register("plan_seq_len", sql="WITH " + D_PLAN_ROWS + """
SELECT psl.slice, psl.n, psl.p95_tokens, psl.seq_len,
       count(*) FILTER (WHERE pa.tokens_f > psl.seq_len) AS over_count,
       round_even(count(*) FILTER (WHERE pa.tokens_f > psl.seq_len) / psl.n, 4) AS over_share
FROM psl JOIN pa ON psl.slice IS NOT DISTINCT FROM pa.slice GROUP BY psl.slice, psl.n, psl.p95_tokens, psl.seq_len""")
def plan_seq_len(spark, sf):
    """Max sequence length per slice from A's token P95, and the rows it would truncate."""
    return pl.seq_len_plan(plan_corpus(spark, sf), ["slice"])


def _d_rules(n: str, task: str, model: str, gpu: str) -> str:
    """R2-R9 as DuckDB expressions (written from the rule text, independently of the Spark code)."""
    base = f"(CASE WHEN {n} < 1000 THEN 4 WHEN {n} < 5000 THEN 8 WHEN {n} < 20000 THEN 16 ELSE 32 END)"
    ceil = f"(CASE WHEN {n} < 500 THEN 4 WHEN {n} < 1000 THEN 8 WHEN {n} < 5000 THEN 16 WHEN {n} < 20000 THEN 32 ELSE 999 END)"
    cceil = f"(CASE WHEN {n} < 500 THEN 8 WHEN {n} < 1000 THEN 16 WHEN {n} < 5000 THEN 32 ELSE 64 END)"
    rank = (f"(CASE WHEN {task} = 'cpt' THEN (CASE WHEN {cceil} > {ceil} THEN {cceil} ELSE least({ceil}, 64) END) "
            f"WHEN {task} IN ('code', 'math') THEN (CASE WHEN 16 > {ceil} THEN {ceil} WHEN {base} < 16 THEN 16 ELSE {base} END) "
            f"WHEN {task} = 'roleplay' THEN least({base}, 8) ELSE {base} END)")
    return rank


def _d_hyper_select(src: str) -> str:
    """SELECT list computing the plan columns from a relation with n, task, model, gpu_gb."""
    rank = _d_rules("n", "task", "model", "gpu_gb")
    size = ("(CASE WHEN regexp_matches(replace(lower(model), 'b', ''), '^\\s*[+-]?[0-9]+\\s*$') "
            "THEN TRY_CAST(trim(replace(lower(model), 'b', '')) AS INT) ELSE 7 END)")
    mods = ("(CASE task WHEN 'cpt' THEN ['q_proj','k_proj','v_proj','o_proj','up_proj','down_proj','gate_proj'] "
            "WHEN 'code' THEN ['q_proj','k_proj','v_proj','o_proj'] "
            "WHEN 'math' THEN ['q_proj','v_proj','up_proj','down_proj','gate_proj'] "
            "WHEN 'roleplay' THEN ['v_proj'] ELSE ['q_proj','v_proj'] END)")
    return f"""
  r1 AS (SELECT *, {rank} AS rank, {mods} AS mods0, {size} AS size_b FROM {src}),
  r2 AS (SELECT *,
    CASE WHEN task = 'roleplay' THEN rank * 4 WHEN task = 'math' THEN rank ELSE rank * 2 END AS alpha,
    CASE WHEN size_b IN (13, 14, 20, 34, 67, 70, 72, 123, 405) AND NOT list_contains(mods0, 'o_proj')
         THEN list_append(mods0, 'o_proj') ELSE mods0 END AS mods,
    CASE WHEN task = 'cpt' THEN 0.05 WHEN n < 500 THEN 0.15 WHEN n < 1000 THEN 0.1 WHEN n < 10000 THEN 0.05 ELSE 0.0 END::DOUBLE AS dropout,
    (CASE WHEN rank <= 4 THEN 1e-4 WHEN rank <= 8 THEN 2e-4 WHEN rank <= 16 THEN 3e-4 ELSE 5e-4 END)::DOUBLE AS lr0,
    CASE WHEN task = 'cpt' THEN 1 WHEN n < 500 THEN 5 WHEN n < 5000 THEN 3 WHEN n < 20000 THEN 2 ELSE 1 END AS epochs,
    CASE WHEN gpu_gb < 8 THEN 1 WHEN gpu_gb < 16 THEN 2 WHEN gpu_gb < 24 THEN 4 WHEN gpu_gb < 48 THEN 8 ELSE 16 END AS batch_size,
    CASE WHEN task = 'cpt' THEN 32 WHEN n < 200 THEN 8 WHEN n > 50000 THEN 32 ELSE 16 END AS target_batch
    FROM r1),
  r3 AS (SELECT *,
    round_even((CASE WHEN task = 'cpt' THEN greatest(5e-5::DOUBLE, least(lr0, 1e-4::DOUBLE))
                     WHEN task = 'roleplay' THEN lr0 * 1.5::DOUBLE WHEN task = 'math' THEN lr0 * 0.75::DOUBLE ELSE lr0 END)
               * (CASE WHEN n > 20000 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END), 6) AS learning_rate,
    greatest(1, target_batch // batch_size) AS gradient_accumulation FROM r2),
  r4 AS (SELECT *, batch_size * gradient_accumulation AS effective_batch,
    greatest(1, (n // (batch_size * gradient_accumulation)) * epochs) AS total_steps FROM r3),
  hp AS (SELECT *, least(greatest(10, total_steps // 10), greatest(1, total_steps - 1)) AS warmup_steps,
    least(500, greatest(50, total_steps // 5)) AS save_steps,
    CASE task WHEN 'cpt' THEN 'constant_with_warmup' WHEN 'roleplay' THEN 'linear' ELSE 'cosine' END AS scheduler,
    CASE WHEN task = 'cpt' THEN 0 ELSE 5 END AS neftune_alpha FROM r4)"""


D_HYPER = D_PLAN_ROWS + """,
ph AS (SELECT ps.slice, ps.n, t.task, m.model, 24.0::DOUBLE AS gpu_gb FROM ps,
       (VALUES ('chat'), ('code'), ('math'), ('roleplay'), ('cpt')) AS t(task),
       (VALUES ('qwen2-7b'), ('Qwen/Qwen2-7B-Instruct'), ('7b'), ('llama3_8b'), ('13b'), ('72B')) AS m(model)),
""" + _d_hyper_select("ph")


@register("plan_hyperparams", sql="WITH " + D_HYPER + """
SELECT slice, task, model, n, rank, alpha, array_to_string(mods, ',') AS target_modules, dropout, learning_rate,
       epochs, batch_size, gradient_accumulation, effective_batch, total_steps, warmup_steps, save_steps,
       scheduler, neftune_alpha
FROM hp""")
def plan_hyperparams(spark, sf):
    """One row per slice × task × model request: rank, alpha, modules, dropout, learning rate,
    epochs, batch, accumulation, steps, warmup, save steps, scheduler, NEFTune (rules R2-R9)."""
    stats = pl.slice_stats(plan_corpus(spark, sf), ["slice"])
    req = stats.select("slice", "n", F.explode(F.array(*[F.lit(t) for t in TASKS])).alias("task"))
    req = req.select("*", F.explode(F.array(*[F.lit(m) for m in pl.PLAN_MODELS])).alias("model"),
                     F.lit(ru.DEFAULT_GPU_GB).alias("gpu_gb"))
    hp = ru.hyperparams(req)
    return hp.select("slice", "task", "model", "n", "rank", "alpha",
                     F.array_join("target_modules", ",").alias("target_modules"), "dropout", "learning_rate",
                     "epochs", "batch_size", "gradient_accumulation", "effective_batch", "total_steps",
                     "warmup_steps", "save_steps", "scheduler", "neftune_alpha")


D_REASONS = D_PLAN_ROWS + """,
rq AS (SELECT ps.slice, ps.n, t.task FROM ps,
       (VALUES ('chat'), ('code'), ('math'), ('roleplay'), ('cpt')) AS t(task)),
""" + _d_hyper_select("(SELECT *, 'qwen2-7b' AS model, 24.0::DOUBLE AS gpu_gb FROM rq)") + """,
rr AS (SELECT *,
  CASE WHEN n < 500 THEN '极小数据集（<500），使用 r=4 防止严重过拟合' WHEN n < 1000 THEN '小数据集（<1k），使用 r=4 防止过拟合'
       WHEN n < 5000 THEN '中等数据集（1k-5k），r=8 平衡学习能力与泛化' WHEN n < 20000 THEN '大数据集（5k-20k），r=16 充分学习新知识'
       ELSE '超大数据集（>20k），r=32 捕获复杂模式' END AS base_reason,
  CASE WHEN n < 500 THEN 4 WHEN n < 1000 THEN 8 WHEN n < 5000 THEN 16 WHEN n < 20000 THEN 32 ELSE 999 END AS ceil_r,
  CASE WHEN n < 500 THEN 8 WHEN n < 1000 THEN 16 WHEN n < 5000 THEN 32 ELSE 64 END AS cpt_r,
  CASE WHEN n < 1000 THEN 4 WHEN n < 5000 THEN 8 WHEN n < 20000 THEN 16 ELSE 32 END AS base_r FROM hp)
"""


@register("plan_hyper_reasons", sql="WITH " + D_REASONS + """
SELECT slice, task, base_reason || CASE
    WHEN task = 'cpt' THEN CASE WHEN cpt_r > ceil_r THEN printf('；CPT 需要更强 rank 注入领域知识，r=%d', cpt_r)
                                ELSE printf('；CPT 模式，r=%d', least(ceil_r, 64)) END
    WHEN task = 'code' THEN CASE WHEN 16 > ceil_r THEN printf('；代码任务建议 r=16，但数据仅 %d 条，降为 r=%d 防止过拟合', n, ceil_r)
                                 WHEN base_r < 16 THEN '；代码任务需要更高 rank 学习语法结构' ELSE '' END
    WHEN task = 'math' THEN CASE WHEN 16 > ceil_r THEN printf('；数学推理建议 r=16，但数据仅 %d 条，降为 r=%d 防止过拟合', n, ceil_r)
                                 WHEN base_r < 16 THEN '；数学推理需要更高 rank 学习推理链' ELSE '' END
    WHEN task = 'roleplay' THEN '；角色扮演用较小 rank 保留更多基础语言能力' ELSE '' END AS rank_reason,
  CASE task WHEN 'cpt' THEN printf('CPT：alpha=%d（2×rank），标准比例', alpha)
            WHEN 'roleplay' THEN printf('角色扮演：alpha=%d（4×rank），增强风格学习强度', alpha)
            WHEN 'code' THEN printf('代码任务：alpha=%d（2×rank），标准比例', alpha)
            WHEN 'math' THEN printf('数学推理：alpha=%d（1×rank），保守更新，保留推理链', alpha)
            ELSE printf('通用对话：alpha=%d（2×rank），标准比例', alpha) END AS alpha_reason,
  CASE task WHEN 'cpt' THEN 'CPT（继续预训练）：训练全 7 层，最大化领域知识注入' WHEN 'code' THEN '代码任务：训练 Q/K/V/O 全部注意力层'
            WHEN 'math' THEN '数学推理：注意力层 + 前馈网络层（需要更强的表示能力）' WHEN 'roleplay' THEN '角色扮演：仅训练 V 投影层，最大限度保留基础语言能力'
            ELSE '通用对话：标准 Q/V 配置' END AS modules_reason,
  CASE WHEN task = 'cpt' THEN 'CPT 数据量通常较大，低 dropout (0.05)' WHEN n < 500 THEN '极小数据集，高 dropout (0.15) 强力防过拟合'
       WHEN n < 1000 THEN '小数据集，较高 dropout (0.1) 防过拟合' WHEN n < 10000 THEN '中等数据集，中等 dropout (0.05)'
       ELSE '大数据集，dropout=0，充分利用数据' END AS dropout_reason,
  CASE WHEN rank <= 4 THEN printf('小 rank (%d)，较低学习率 (1e-4) 防止震荡', rank) WHEN rank <= 8 THEN printf('标准 rank (%d)，标准学习率 (2e-4)', rank)
       WHEN rank <= 16 THEN printf('较大 rank (%d)，较高学习率 (3e-4)', rank) ELSE printf('大 rank (%d)，高学习率 (5e-4) 加速收敛', rank) END
  || CASE task WHEN 'cpt' THEN '；CPT 降低学习率 (5e-5~1e-4) 保护预训练知识' WHEN 'roleplay' THEN '；角色扮演提高学习率增强风格学习'
               WHEN 'math' THEN '；数学推理降低学习率保护推理链' ELSE '' END
  || CASE WHEN n > 20000 THEN '；大数据集适当提高' ELSE '' END AS learning_rate_reason,
  CASE WHEN task = 'cpt' THEN 'CPT 数据量大，1 轮足够注入知识，多轮可能过拟合' WHEN n < 500 THEN '极小数据集，5 轮充分学习'
       WHEN n < 1000 THEN '小数据集，3 轮' WHEN n < 5000 THEN '中等数据集，3 轮' WHEN n < 20000 THEN '大数据集，2 轮即可'
       ELSE '超大数据集，1 轮避免过拟合' END AS epochs_reason,
  CASE WHEN gpu_gb < 8 THEN '显存较小，batch_size=1' WHEN gpu_gb < 16 THEN '中等显存，batch_size=2' WHEN gpu_gb < 24 THEN '显存充裕，batch_size=4'
       WHEN gpu_gb < 48 THEN '大显存，batch_size=8' ELSE '超大显存，batch_size=16' END AS batch_size_reason
FROM rr""")
def plan_hyper_reasons(spark, sf):
    """Reason strings of rank, alpha, modules, dropout, learning rate, epochs and batch per slice and task."""
    stats = pl.slice_stats(plan_corpus(spark, sf), ["slice"])
    req = stats.select("slice", "n", F.explode(F.array(*[F.lit(t) for t in TASKS])).alias("task"),
                       F.lit("qwen2-7b").alias("model"), F.lit(ru.DEFAULT_GPU_GB).alias("gpu_gb"))
    return ru.hyperparams(req).select("slice", "task", "rank_reason", "alpha_reason", "modules_reason", "dropout_reason",
                                      "learning_rate_reason", "epochs_reason", "batch_size_reason")


def _models_sql(alias):
    return cat.sql_values([(i, m[0], m[1], m[2], m[3]) for i, m in enumerate(cat.MODELS)],
                          ["pos", "name", "params", "hidden", "layers"], alias)


def _gpus_sql(alias):
    return cat.sql_values(cat.GPUS, ["gpu", "gpu_gb"], alias)

D_MATCH = f"""
req AS (SELECT DISTINCT d.source AS slice, r.request FROM documents d,
        (VALUES ('qwen2-7b'), ('Qwen/Qwen2-7B-Instruct'), ('7b'), ('llama3_8b'), ('unknown-x')) AS r(request)),
cand AS (
  SELECT req.slice, req.request, c.* FROM req, {_models_sql('c')}
  WHERE req.request <> '' AND (
    position(replace(c.name, '-', '') IN replace(replace(lower(req.request), '-', ''), '_', '')) > 0
    OR position(replace(replace(lower(req.request), '-', ''), '_', '') IN replace(c.name, '-', '')) > 0)),
best AS (SELECT slice, request, arg_min(name, (abs(params - 7e9::DOUBLE), pos)) AS matched,
                arg_min(params, (abs(params - 7e9::DOUBLE), pos)) AS params,
                arg_min(hidden, (abs(params - 7e9::DOUBLE), pos)) AS hidden,
                arg_min(layers, (abs(params - 7e9::DOUBLE), pos)) AS layers
         FROM cand GROUP BY slice, request),
matched AS (
  SELECT req.slice, req.request, coalesce(b.matched, 'default-7b') AS matched,
         coalesce(b.params, 7e9::DOUBLE) AS params, CAST(coalesce(b.hidden, 4096) AS BIGINT) AS hidden,
         CAST(coalesce(b.layers, 32) AS BIGINT) AS layers
  FROM req LEFT JOIN best b ON req.slice IS NOT DISTINCT FROM b.slice AND req.request = b.request)
"""


@register("plan_match_models", sql="WITH " + D_MATCH + "SELECT * FROM matched")
def plan_match_models(spark, sf):
    """Model request → catalogue row: substring either way after dropping '-' (and '_' in the
    request); closest to 7e9 parameters wins, catalogue order breaks ties; no match → 7B default."""
    srcs = fx.table(spark, sf, "documents").select(F.col("source").alias("slice")).distinct()
    req = srcs.select("slice", F.explode(F.array(*[F.lit(m) for m in fx.MODEL_REQUESTS])).alias("request"))
    m = pl.match_models(req, "request")
    return m.select("slice", "request", F.col("matched_model.name").alias("matched"),
                    F.col("matched_model.params").alias("params"), F.col("matched_model.hidden").alias("hidden"),
                    F.col("matched_model.layers").alias("layers"))


D_FIT = D_PLAN_ROWS + f""",
fit0 AS (
  SELECT psl.slice, psl.n, psl.seq_len, m.name AS model, m.params, m.hidden, m.layers, g.gpu, g.gpu_gb,
         CASE WHEN psl.n < 1000 THEN 4 WHEN psl.n < 5000 THEN 8 WHEN psl.n < 20000 THEN 16 ELSE 32 END AS rank,
         CASE WHEN g.gpu_gb < 8 THEN 1 WHEN g.gpu_gb < 16 THEN 2 WHEN g.gpu_gb < 24 THEN 4 WHEN g.gpu_gb < 48 THEN 8 ELSE 16 END AS batch_size,
         CASE WHEN regexp_matches(replace(lower(m.name), 'b', ''), '^\\s*[+-]?[0-9]+\\s*$')
              AND TRY_CAST(trim(replace(lower(m.name), 'b', '')) AS INT) IN (13, 14, 20, 34, 67, 70, 72, 123, 405)
              THEN 3 ELSE 2 END AS modules
  FROM psl, {_models_sql('m')}, {_gpus_sql('g')}),
fit1 AS (
  SELECT *, params * 0.5::DOUBLE / 1e9::DOUBLE + (layers * (2 * rank * hidden * modules) * 2) / 1e9::DOUBLE AS w,
         (batch_size * seq_len * hidden * 2) / 1e9::DOUBLE * layers * 0.3::DOUBLE AS a,
         (layers * modules * (2 * rank * hidden)) * 8 / 1e9::DOUBLE AS o FROM fit0),
fit2 AS (SELECT *, (w + a + o) * 0.15::DOUBLE AS ov FROM fit1),
fit AS (SELECT *, w + a + o + ov AS tot0, round_even(w + a + o + ov, 2) AS tot FROM fit2)
"""


@register("plan_fit", sql="WITH " + D_FIT + """
SELECT slice, model, gpu, seq_len, rank, batch_size, modules,
       round_even(w, 2) AS model_weight, round_even(a, 2) AS activation, round_even(o, 2) AS optimizer,
       round_even(ov, 2) AS overhead, tot AS total,
       round_even(gpu_gb - tot, 2) AS headroom_gb,
       CASE WHEN gpu_gb - tot >= 4 THEN 'Yes' WHEN gpu_gb - tot >= 0 THEN 'Tight' ELSE 'No' END AS fits,
       CASE WHEN (gpu_gb - tot) / gpu_gb > 0.30 THEN 'safe' WHEN (gpu_gb - tot) / gpu_gb >= 0.10 THEN 'possible'
            WHEN (gpu_gb - tot) / gpu_gb >= 0 THEN 'risky' ELSE 'over' END AS headroom_band,
       CASE WHEN tot < 6 THEN 6 WHEN tot < 8 THEN 8 WHEN tot < 12 THEN 12 WHEN tot < 16 THEN 16
            WHEN tot < 24 THEN 24 WHEN tot < 48 THEN 48 END AS card_gb,
       CASE WHEN tot < 24 THEN 'OK' WHEN tot < 48 THEN 'WARN' ELSE 'FAIL' END AS status,
       CASE WHEN tot < 6 THEN '[OK] 可在 6GB 显卡上运行（QLoRA 4-bit，如 RTX 3060/4060 笔记本）'
            WHEN tot < 8 THEN '[OK] 可在 8GB 显卡上运行（QLoRA 4-bit，如 RTX 3070/4060Ti）'
            WHEN tot < 12 THEN '[OK] 可在 12GB 显卡上运行（QLoRA 4-bit，如 RTX 3080/4070）'
            WHEN tot < 16 THEN '[OK] 可在 16GB 显卡上运行（QLoRA 4-bit，如 RTX 4080）'
            WHEN tot < 24 THEN '[OK] 可在 24GB 显卡上运行（QLoRA 4-bit，如 RTX 3090/4090）'
            WHEN tot < 48 THEN '[WARN] 需要 48GB 显存（QLoRA 4-bit，如 A6000）建议减小 batch size 或序列长度'
            ELSE '[FAIL] 显存不足！请：1) 降低 seq_length  2) 减小 batch_size  3) 换更小的模型' END AS advice
FROM fit""")
def plan_fit(spark, sf):
    """Slice × catalogue model × card: QLoRA memory parts (R10), headroom and verdicts (R11)."""
    seq = pl.seq_len_plan(plan_corpus(spark, sf), ["slice"]).select("slice", "n", "seq_len")
    return pl.fit(seq)


PLAN_OVERRIDE = '{"config": {"rank": {"value": 16}, "learning_rate": {"value": 0.0005}, "batch_size": {"value": 2}}, "max_seq_length": 1024}'


@register("plan_full", sql="WITH " + D_PLAN_ROWS + """,
req AS (SELECT slice, n, 'chat' AS task, 'qwen2-7b' AS model, 24.0::DOUBLE AS gpu_gb, p95_tokens, seq_len FROM psl),
""" + _d_hyper_select("req") + """,
ov AS (SELECT source AS slice, true AS given FROM documents GROUP BY source HAVING min(doc_id) % 2 = 0),
dq AS (SELECT slice, round_even((count(*) - count(DISTINCT k)) / count(*), 4) AS duplicate_ratio FROM (
  SELECT source AS slice, md5(coalesce(lang, '') || ' ' || coalesce(text, '')) AS k FROM documents UNION ALL
  SELECT 'conversations', md5(string_agg(coalesce(text, ''), ' ' ORDER BY turn)) FROM conversations GROUP BY conv_id UNION ALL
  SELECT 'pairs', md5(coalesce(instruction, '') || ' ' || coalesce(output, '')) FROM pairs) GROUP BY slice),
ho AS (
  SELECT hp.slice, n, p95_tokens, alpha, epochs, gradient_accumulation, mods, coalesce(ov.given, false) AS given, duplicate_ratio,
         CASE WHEN ov.given THEN 16 ELSE rank END AS r, CASE WHEN ov.given THEN 0.0005::DOUBLE ELSE learning_rate END AS lr,
         CASE WHEN ov.given THEN 2 ELSE batch_size END AS bs, CASE WHEN ov.given THEN 1024 ELSE seq_len END AS len,
         CASE WHEN n < 500 THEN '极小数据集（<500），使用 r=4 防止严重过拟合' WHEN n < 1000 THEN '小数据集（<1k），使用 r=4 防止过拟合'
              WHEN n < 5000 THEN '中等数据集（1k-5k），r=8 平衡学习能力与泛化' WHEN n < 20000 THEN '大数据集（5k-20k），r=16 充分学习新知识'
              ELSE '超大数据集（>20k），r=32 捕获复杂模式' END || CASE WHEN ov.given THEN ' [用户覆盖]' ELSE '' END AS rank_reason
  FROM hp LEFT JOIN ov ON hp.slice IS NOT DISTINCT FROM ov.slice JOIN dq ON hp.slice IS NOT DISTINCT FROM dq.slice),
hs AS (SELECT *, greatest(1, (n // (bs * gradient_accumulation)) * epochs) AS steps FROM ho),
mem AS (
  SELECT *, 7e9::DOUBLE * 0.5::DOUBLE / 1e9::DOUBLE + (28 * (2 * r * 3584 * len(mods)) * 2) / 1e9::DOUBLE AS w,
         (bs * len * 3584 * 2) / 1e9::DOUBLE * 28 * 0.3::DOUBLE AS a,
         (28 * len(mods) * (2 * r * 3584)) * 8 / 1e9::DOUBLE AS o FROM hs),
mem2 AS (SELECT *, w + a + o + (w + a + o) * 0.15::DOUBLE AS tot FROM mem)
SELECT slice, n, p95_tokens, len AS seq_len, CASE WHEN slice = 'conversations' THEN 'messages' ELSE 'instruction-output' END AS data_format,
       r AS rank, rank_reason, alpha, lr AS learning_rate, epochs, bs AS batch_size, gradient_accumulation, steps AS total_steps,
       least(greatest(10, steps // 10), greatest(1, steps - 1)) AS warmup_steps, duplicate_ratio, round_even(tot, 2) AS memory_total_gb
FROM mem2""")
def plan_full(spark, sf):
    """Per slice one document: config with reasons, data summary, sequence length, schedule and memory of the chat plan
    for qwen2-7b on a 24 GB card, after the override documents of the sources whose smallest doc_id is even;
    the values are read back from the documents."""
    ov = (fx.table(spark, sf, "documents").groupBy(F.col("source").alias("slice")).agg(F.min("doc_id").alias("m"))
          .filter(F.pmod("m", F.lit(2)) == 0).select("slice", F.lit(PLAN_OVERRIDE).alias("document")))
    plan = pl.full_plan(plan_corpus(spark, sf), ["slice"], task="chat", model="qwen2-7b", gpu_gb=24.0, overrides=ov)
    d = pl.plan_document(plan, ["slice"]).select("slice", F.from_json("document", pl.DOCUMENT_SCHEMA).alias("d"))
    value = lambda c: F.col(f"d.config.{c}.value").alias(c)
    return d.select("slice", F.col("d.data_summary.num_samples").alias("n"), "d.data_summary.p95_tokens", F.col("d.max_seq_length").alias("seq_len"),
                    F.col("d.data_summary.format").alias("data_format"), value("rank"), F.col("d.config.rank.reason").alias("rank_reason"), value("alpha"),
                    value("learning_rate"), value("epochs"), value("batch_size"), value("gradient_accumulation"), "d.schedule.total_steps",
                    "d.schedule.warmup_steps", "d.data_summary.quality.duplicate_ratio", F.col("d.memory.total").alias("memory_total_gb"))


D_OVR = D_PLAN_ROWS + """,
req AS (SELECT slice, n, 'chat' AS task, 'qwen2-7b' AS model, 24.0::DOUBLE AS gpu_gb FROM ps),
""" + _d_hyper_select("req") + """,
ov AS (SELECT source AS slice, 16 AS rank, 0.0005::DOUBLE AS learning_rate FROM documents
       GROUP BY source HAVING min(doc_id) % 2 = 0)
"""


@register("jn_overrides", sql="WITH " + D_OVR + """
SELECT hp.slice, coalesce(ov.rank, hp.rank) AS rank, ov.rank IS NOT NULL AS rank_overridden,
       coalesce(ov.learning_rate, hp.learning_rate) AS learning_rate,
       CASE WHEN n < 500 THEN '极小数据集（<500），使用 r=4 防止严重过拟合' WHEN n < 1000 THEN '小数据集（<1k），使用 r=4 防止过拟合'
            WHEN n < 5000 THEN '中等数据集（1k-5k），r=8 平衡学习能力与泛化' WHEN n < 20000 THEN '大数据集（5k-20k），r=16 充分学习新知识'
            ELSE '超大数据集（>20k），r=32 捕获复杂模式' END || CASE WHEN ov.rank IS NOT NULL THEN ' [用户覆盖]' ELSE '' END AS rank_reason
FROM hp LEFT JOIN ov ON hp.slice IS NOT DISTINCT FROM ov.slice""")
def jn_overrides(spark, sf):
    """A per-slice override table (rank 16, lr 5e-4 for sources whose smallest doc_id is even)
    wins over the recommended values; the reason gains the override tag."""
    stats = pl.slice_stats(plan_corpus(spark, sf), ["slice"])
    req = stats.select("slice", "n", F.lit("chat").alias("task"), F.lit("qwen2-7b").alias("model"),
                       F.lit(24.0).alias("gpu_gb"))
    hp = ru.hyperparams(req)
    ov = (fx.table(spark, sf, "documents").groupBy(F.col("source").alias("slice"))
          .agg(F.min("doc_id").alias("m")).filter(F.pmod("m", F.lit(2)) == 0)
          .select("slice", F.lit(16).alias("rank"), F.lit(5e-4).alias("learning_rate")))
    j = pl.apply_overrides(hp, ov, ["rank", "learning_rate"])
    return j.select("slice", "rank", F.col("rank_overridden"), "learning_rate", "rank_reason")
