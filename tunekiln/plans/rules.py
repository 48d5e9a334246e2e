"""Training-plan rules R2-R11 as column expressions over per-slice statistics.

Inputs are columns: ``n`` (sample count), ``task`` (chat|code|math|roleplay|cpt),
``model`` (model name or size text), ``gpu_gb``. The recommended values have a ``*_reason``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# ---------------------------------------------------------------------------
# Fixed values of the rules (thresholds, choices and reason texts).
# ---------------------------------------------------------------------------
RANK_BANDS = [(500, 4, "极小数据集（<500），使用 r=4 防止严重过拟合"),
              (1000, 4, "小数据集（<1k），使用 r=4 防止过拟合"),
              (5000, 8, "中等数据集（1k-5k），r=8 平衡学习能力与泛化"),
              (20000, 16, "大数据集（5k-20k），r=16 充分学习新知识")]
RANK_TOP = (32, "超大数据集（>20k），r=32 捕获复杂模式")
CEILING_BANDS = [(500, 4), (1000, 8), (5000, 16), (20000, 32)]
CEILING_TOP = 999
CPT_CEILING_BANDS = [(500, 8), (1000, 16), (5000, 32)]
CPT_CEILING_TOP = 64
TASK_RANK_TARGET = 16  # code and math
ROLEPLAY_RANK_MAX = 8
REASON_CPT_UP = "；CPT 需要更强 rank 注入领域知识，r=%d"
REASON_CPT = "；CPT 模式，r=%d"
REASON_CODE_DOWN = "；代码任务建议 r=16，但数据仅 %d 条，降为 r=%d 防止过拟合"
REASON_CODE_UP = "；代码任务需要更高 rank 学习语法结构"
REASON_MATH_DOWN = "；数学推理建议 r=16，但数据仅 %d 条，降为 r=%d 防止过拟合"
REASON_MATH_UP = "；数学推理需要更高 rank 学习推理链"
REASON_ROLEPLAY = "；角色扮演用较小 rank 保留更多基础语言能力"
ALPHA_REASONS = {"cpt": "CPT：alpha=%d（2×rank），标准比例",
                 "roleplay": "角色扮演：alpha=%d（4×rank），增强风格学习强度",
                 "code": "代码任务：alpha=%d（2×rank），标准比例",
                 "math": "数学推理：alpha=%d（1×rank），保守更新，保留推理链",
                 "chat": "通用对话：alpha=%d（2×rank），标准比例"}
MODULES = {"cpt": ["q_proj", "k_proj", "v_proj", "o_proj", "up_proj", "down_proj", "gate_proj"],
           "code": ["q_proj", "k_proj", "v_proj", "o_proj"],
           "math": ["q_proj", "v_proj", "up_proj", "down_proj", "gate_proj"],
           "roleplay": ["v_proj"],
           "chat": ["q_proj", "v_proj"]}
LARGE_SIZES = [13, 14, 20, 34, 67, 70, 72, 123, 405]
DEFAULT_SIZE_B = 7
DROPOUT_CPT = 0.05
DROPOUT_BANDS = [(500, 0.15), (1000, 0.1), (10000, 0.05)]
DROPOUT_TOP = 0.0
LR_BANDS = [(4, 1e-4), (8, 2e-4), (16, 3e-4)]
LR_TOP = 5e-4
LR_CPT_MIN, LR_CPT_MAX = 5e-5, 1e-4
LR_ROLEPLAY, LR_MATH, LR_LARGE_DATA = 1.5, 0.75, 1.2
LR_LARGE_N = 20000
EPOCH_CPT = 1
EPOCH_BANDS = [(500, 5), (1000, 3), (5000, 3), (20000, 2)]
EPOCH_TOP = 1
BATCH_BANDS = [(8, 1), (16, 2), (24, 4), (48, 8)]
BATCH_TOP = 16
TARGET_BATCH_CPT, TARGET_BATCH_SMALL, TARGET_BATCH_LARGE, TARGET_BATCH = 32, 8, 32, 16
SMALL_N_BATCH, LARGE_N_BATCH = 200, 50000
DEFAULT_GPU_GB = 24.0
SCHEDULERS = {"cpt": "constant_with_warmup", "roleplay": "linear"}
SCHEDULER_DEFAULT = "cosine"
NEFTUNE_CPT, NEFTUNE_DEFAULT = 0, 5
OVERRIDE_TAG = " [用户覆盖]"
# Reason texts of R4-R8 (fixed values, in the order of the bands above)
MODULES_REASONS = {
    "cpt": "CPT（继续预训练）：训练全 7 层，最大化领域知识注入",
    "code": "代码任务：训练 Q/K/V/O 全部注意力层",
    "math": "数学推理：注意力层 + 前馈网络层（需要更强的表示能力）",
    "roleplay": "角色扮演：仅训练 V 投影层，最大限度保留基础语言能力",
    "chat": "通用对话：标准 Q/V 配置",
}
MODULES_REASON_LARGE = "；大模型增加输出投影层"
DROPOUT_REASON_CPT = "CPT 数据量通常较大，低 dropout (0.05)"
DROPOUT_REASONS = [(500, "极小数据集，高 dropout (0.15) 强力防过拟合"), (1000, "小数据集，较高 dropout (0.1) 防过拟合"),
                   (10000, "中等数据集，中等 dropout (0.05)")]
DROPOUT_REASON_TOP = "大数据集，dropout=0，充分利用数据"
LR_REASONS = [(4, "小 rank (%d)，较低学习率 (1e-4) 防止震荡"), (8, "标准 rank (%d)，标准学习率 (2e-4)"),
              (16, "较大 rank (%d)，较高学习率 (3e-4)")]
LR_REASON_TOP = "大 rank (%d)，高学习率 (5e-4) 加速收敛"
LR_REASON_TASKS = {"cpt": "；CPT 降低学习率 (5e-5~1e-4) 保护预训练知识", "roleplay": "；角色扮演提高学习率增强风格学习",
                   "math": "；数学推理降低学习率保护推理链"}
LR_REASON_LARGE = "；大数据集适当提高"
EPOCH_REASON_CPT = "CPT 数据量大，1 轮足够注入知识，多轮可能过拟合"
EPOCH_REASONS = [(500, "极小数据集，5 轮充分学习"), (1000, "小数据集，3 轮"), (5000, "中等数据集，3 轮"), (20000, "大数据集，2 轮即可")]
EPOCH_REASON_TOP = "超大数据集，1 轮避免过拟合"
BATCH_REASONS = [(8, "显存较小，batch_size=1"), (16, "中等显存，batch_size=2"), (24, "显存充裕，batch_size=4"), (48, "大显存，batch_size=8")]
BATCH_REASON_TOP = "超大显存，batch_size=16"
THROUGHPUT_TOKENS_PER_S = 2000
TIME_BAND = (0.7, 1.3)
# Memory rule R10
BYTES_4BIT, BYTES_FP16 = 0.5, 2.0
CHECKPOINT_ACTIVATION_SHARE = 0.3
OVERHEAD_SHARE = 0.15
CARD_STEPS = [6, 8, 12, 16, 24, 48]
HEADROOM_YES_GB = 4.0
MODE_4BIT, MODE_FP16 = "QLoRA 4-bit", "LoRA FP16"
CARD_ADVICE = [
    (6, "[OK] 可在 6GB 显卡上运行（%s，如 RTX 3060/4060 笔记本）"),
    (8, "[OK] 可在 8GB 显卡上运行（%s，如 RTX 3070/4060Ti）"),
    (12, "[OK] 可在 12GB 显卡上运行（%s，如 RTX 3080/4070）"),
    (16, "[OK] 可在 16GB 显卡上运行（%s，如 RTX 4080）"),
]
CARD_ADVICE_24_4BIT = "[OK] 可在 24GB 显卡上运行（%s，如 RTX 3090/4090）"
CARD_ADVICE_24_FP16 = "[WARN] 需要 24GB 显存（%s，如 RTX 3090/4090）建议开启 QLoRA"
CARD_ADVICE_48 = "[WARN] 需要 48GB 显存（%s，如 A6000）建议减小 batch size 或序列长度"
CARD_ADVICE_FAIL_FP16 = "[FAIL] 显存不足！请：1) 开启 QLoRA 4-bit 量化  2) 降低 seq_length  3) 减小 batch_size  4) 换更小的模型"
CARD_ADVICE_FAIL_4BIT = "[FAIL] 显存不足！请：1) 降低 seq_length  2) 减小 batch_size  3) 换更小的模型"
# ---------------------------------------------------------------------------


def _band(x: Column, bands, top) -> Column:
    out = F.lit(top)
    for lim, v in reversed(bands):
        out = F.when(x < lim, F.lit(v)).otherwise(out)
    return out


def rank(n: Column, task: Column) -> tuple[Column, Column]:
    base = F.lit(RANK_TOP[0])
    reason = F.lit(RANK_TOP[1])
    for lim, r, why in reversed(RANK_BANDS):
        base = F.when(n < lim, F.lit(r)).otherwise(base)
        reason = F.when(n < lim, F.lit(why)).otherwise(reason)
    ceil = _band(n, CEILING_BANDS, CEILING_TOP)
    cpt_ceil = _band(n, CPT_CEILING_BANDS, CPT_CEILING_TOP)
    tgt = F.lit(TASK_RANK_TARGET)
    r = (
        F.when(task == "cpt", F.when(cpt_ceil > ceil, cpt_ceil).otherwise(F.least(ceil, F.lit(64))))
        .when(task.isin("code", "math"), F.when(tgt > ceil, ceil).when(base < tgt, tgt).otherwise(base))
        .when(task == "roleplay", F.least(base, F.lit(ROLEPLAY_RANK_MAX)))
        .otherwise(base)
    )
    suffix = (
        F.when(task == "cpt", F.when(cpt_ceil > ceil, F.format_string(REASON_CPT_UP, cpt_ceil))
               .otherwise(F.format_string(REASON_CPT, F.least(ceil, F.lit(64)))))
        .when(task == "code", F.when(tgt > ceil, F.format_string(REASON_CODE_DOWN, n, ceil))
              .when(base < tgt, F.lit(REASON_CODE_UP)).otherwise(F.lit("")))
        .when(task == "math", F.when(tgt > ceil, F.format_string(REASON_MATH_DOWN, n, ceil))
              .when(base < tgt, F.lit(REASON_MATH_UP)).otherwise(F.lit("")))
        .when(task == "roleplay", F.lit(REASON_ROLEPLAY))
        .otherwise(F.lit(""))
    )
    return r, F.concat(reason, suffix)


def alpha(r: Column, task: Column) -> tuple[Column, Column]:
    a = F.when(task == "roleplay", r * 4).when(task == "math", r).otherwise(r * 2)
    why = F.format_string(ALPHA_REASONS["chat"], a)
    for t in ("cpt", "roleplay", "code", "math"):
        why = F.when(task == t, F.format_string(ALPHA_REASONS[t], a)).otherwise(why)
    return a, why


def model_size_b(model: Column) -> Column:
    """int(model.lower().replace('b', '')), 7 when that fails (so '1.5b' or 'qwen2-72b' give 7)."""
    s = F.replace(F.lower(model), F.lit("b"), F.lit(""))
    return F.when(s.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(s).cast("int")).otherwise(F.lit(DEFAULT_SIZE_B))


def target_modules(task: Column, model: Column, strict_doc: bool = False) -> Column:
    """Modules by task; ``o_proj`` is added for large models: the listed sizes (the rule as coded)
    or, with ``strict_doc``, any size of at least 13B (the rule as documented)."""
    mods = F.array(*[F.lit(m) for m in MODULES["chat"]])
    for t in ("cpt", "code", "math", "roleplay"):
        mods = F.when(task == t, F.array(*[F.lit(m) for m in MODULES[t]])).otherwise(mods)
    size = model_size_b(model)
    large = (size >= 13) if strict_doc else size.isin(*LARGE_SIZES)
    return F.when(large & ~F.array_contains(mods, "o_proj"), F.array_append(mods, F.lit("o_proj"))).otherwise(mods)


def dropout(n: Column, task: Column) -> Column:
    return F.when(task == "cpt", F.lit(DROPOUT_CPT)).otherwise(_band(n, DROPOUT_BANDS, DROPOUT_TOP))


def learning_rate(r: Column, n: Column, task: Column) -> Column:
    lr = F.lit(LR_TOP)
    for lim, v in reversed(LR_BANDS):
        lr = F.when(r <= lim, F.lit(v)).otherwise(lr)
    lr = (F.when(task == "cpt", F.greatest(F.lit(LR_CPT_MIN), F.least(lr, F.lit(LR_CPT_MAX))))
          .when(task == "roleplay", lr * F.lit(LR_ROLEPLAY))
          .when(task == "math", lr * F.lit(LR_MATH)).otherwise(lr))
    lr = F.when(n > LR_LARGE_N, lr * F.lit(LR_LARGE_DATA)).otherwise(lr)
    return tx.round_even(lr, 6).cast("double")


def epochs(n: Column, task: Column) -> Column:
    return F.when(task == "cpt", F.lit(EPOCH_CPT)).otherwise(_band(n, EPOCH_BANDS, EPOCH_TOP))


def batch_size(gpu_gb: Column) -> Column:
    return _band(gpu_gb, BATCH_BANDS, BATCH_TOP)


def modules_reason(task: Column, model: Column) -> Column:
    """Reason of ``target_modules``; large models say that the output projection was added."""
    why, has = F.lit(MODULES_REASONS["chat"]), F.lit("o_proj" in MODULES["chat"])
    for t in ("cpt", "code", "math", "roleplay"):
        why = F.when(task == t, F.lit(MODULES_REASONS[t])).otherwise(why)
        has = F.when(task == t, F.lit("o_proj" in MODULES[t])).otherwise(has)
    added = model_size_b(model).isin(*LARGE_SIZES) & ~has
    return F.concat(why, F.when(added, F.lit(MODULES_REASON_LARGE)).otherwise(F.lit("")))


def dropout_reason(n: Column, task: Column) -> Column:
    return F.when(task == "cpt", F.lit(DROPOUT_REASON_CPT)).otherwise(_band(n, DROPOUT_REASONS, DROPOUT_REASON_TOP))


def learning_rate_reason(r: Column, n: Column, task: Column) -> Column:
    why = F.format_string(LR_REASON_TOP, r)
    for lim, text in reversed(LR_REASONS):
        why = F.when(r <= lim, F.format_string(text, r)).otherwise(why)
    own = F.lit("")
    for t, text in LR_REASON_TASKS.items():
        own = F.when(task == t, F.lit(text)).otherwise(own)
    return F.concat(why, own, F.when(n > LR_LARGE_N, F.lit(LR_REASON_LARGE)).otherwise(F.lit("")))


def epochs_reason(n: Column, task: Column) -> Column:
    return F.when(task == "cpt", F.lit(EPOCH_REASON_CPT)).otherwise(_band(n, EPOCH_REASONS, EPOCH_REASON_TOP))


def batch_size_reason(gpu_gb: Column) -> Column:
    return _band(gpu_gb, BATCH_REASONS, BATCH_REASON_TOP)


def target_batch(n: Column, task: Column) -> Column:
    return (F.when(task == "cpt", F.lit(TARGET_BATCH_CPT)).when(n < SMALL_N_BATCH, F.lit(TARGET_BATCH_SMALL))
            .when(n > LARGE_N_BATCH, F.lit(TARGET_BATCH_LARGE)).otherwise(F.lit(TARGET_BATCH)))


def hyperparams(df: DataFrame, n="n", task="task", model="model", gpu_gb="gpu_gb") -> DataFrame:
    """Add R2-R9 columns to a per-slice frame."""
    n_, t_, m_, g_ = F.col(n), F.col(task), F.col(model), F.col(gpu_gb)
    r, r_why = rank(n_, t_)
    df = df.withColumn("rank", r).withColumn("rank_reason", r_why)
    a, a_why = alpha(F.col("rank"), t_)
    df = df.withColumn("alpha", a).withColumn("alpha_reason", a_why)
    df = df.withColumn("target_modules", target_modules(t_, m_))
    df = df.withColumn("dropout", dropout(n_, t_))
    df = df.withColumn("learning_rate", learning_rate(F.col("rank"), n_, t_))
    df = df.withColumn("epochs", epochs(n_, t_))
    df = df.withColumn("batch_size", batch_size(g_))
    df = df.withColumn("modules_reason", modules_reason(t_, m_)).withColumn("dropout_reason", dropout_reason(n_, t_))
    df = df.withColumn("learning_rate_reason", learning_rate_reason(F.col("rank"), n_, t_))
    df = df.withColumn("epochs_reason", epochs_reason(n_, t_)).withColumn("batch_size_reason", batch_size_reason(g_))
    df = df.withColumn("target_batch", target_batch(n_, t_))
    df = df.withColumn("gradient_accumulation", F.greatest(F.lit(1), F.floor(F.col("target_batch") / F.col("batch_size")).cast("int")))
    return schedule(df, n)


def schedule(df: DataFrame, n="n", task="task") -> DataFrame:
    """R9: total steps, warmup, save steps, scheduler, NEFTune alpha."""
    eff = F.col("batch_size") * F.col("gradient_accumulation")
    steps = F.greatest(F.lit(1), F.floor(F.col(n) / eff) * F.col("epochs")).cast("bigint")
    df = df.withColumn("effective_batch", eff).withColumn("total_steps", steps)
    s = F.col("total_steps")
    df = df.withColumn("warmup_steps", F.least(F.greatest(F.lit(10), F.floor(s / 10)), F.greatest(F.lit(1), s - 1)).cast("bigint"))
    df = df.withColumn("save_steps", F.least(F.lit(500), F.greatest(F.lit(50), F.floor(s / 5))).cast("bigint"))
    t = F.col(task)
    sched = F.lit(SCHEDULER_DEFAULT)
    for k, v in SCHEDULERS.items():
        sched = F.when(t == k, F.lit(v)).otherwise(sched)
    df = df.withColumn("scheduler", sched)
    return df.withColumn("neftune_alpha", F.when(t == "cpt", F.lit(NEFTUNE_CPT)).otherwise(F.lit(NEFTUNE_DEFAULT)))


def train_time(df: DataFrame, n="n", avg="avg_tokens", ep="epochs", eff="eff_batch") -> DataFrame:
    """Minutes = lines × mean tokens × epochs / (2000 × effective batch), ×0.7 and ×1.3 band."""
    m = F.col(n) * F.col(avg) * F.col(ep) / (F.lit(THROUGHPUT_TOKENS_PER_S) * F.col(eff))
    return (df.withColumn("_m", m)
            .withColumn("minutes", tx.round_even("_m", 4))
            .withColumn("minutes_low", tx.round_even(F.col("_m") * F.lit(TIME_BAND[0]), 4))
            .withColumn("minutes_high", tx.round_even(F.col("_m") * F.lit(TIME_BAND[1]), 4)).drop("_m"))


def memory(params: Column, hidden: Column, layers: Column, seq: Column, batch: Column, r: Column,
           modules: Column, quantized: bool = True, checkpointing: bool = True) -> Column:
    """R10 memory parts in GB (each rounded to 2 decimals), as a struct."""
    bpp = F.lit(BYTES_4BIT if quantized else BYTES_FP16)
    h = hidden.cast("bigint")
    lora_per_layer = F.lit(2) * r.cast("bigint") * h * modules.cast("bigint")
    weight = params * bpp / F.lit(1e9) + (layers.cast("bigint") * lora_per_layer * 2) / F.lit(1e9)
    act = (batch.cast("bigint") * seq.cast("bigint") * h * 2) / F.lit(1e9) * layers.cast("double")
    if checkpointing:
        act = act * F.lit(CHECKPOINT_ACTIVATION_SHARE)
    if quantized:
        optim = (layers.cast("bigint") * modules.cast("bigint") * (F.lit(2) * r.cast("bigint") * h)) * 8 / F.lit(1e9)
    else:
        optim = params * 2 * 2 / F.lit(1e9)
    overhead = (weight + act + optim) * F.lit(OVERHEAD_SHARE)
    total = weight + act + optim + overhead
    return F.struct(tx.round_even(weight, 2).alias("model_weight"), tx.round_even(act, 2).alias("activation"),
                    tx.round_even(optim, 2).alias("optimizer"), tx.round_even(overhead, 2).alias("overhead"),
                    tx.round_even(total, 2).alias("total"))


def card_verdict(total: Column, quantized: bool = True) -> Column:
    """Advice band on the (rounded) total: smallest card step above it, OK/WARN/FAIL, advice text."""
    step = F.lit(None).cast("int")
    for s in reversed(CARD_STEPS):
        step = F.when(total < s, F.lit(s)).otherwise(step)
    status = (F.when(total < 16, F.lit("OK"))
              .when(total < 24, F.lit("OK" if quantized else "WARN"))
              .when(total < 48, F.lit("WARN")).otherwise(F.lit("FAIL")))
    mode = MODE_4BIT if quantized else MODE_FP16
    advice = F.lit(CARD_ADVICE_FAIL_4BIT if quantized else CARD_ADVICE_FAIL_FP16)
    advice = F.when(total < 48, F.lit(CARD_ADVICE_48 % mode)).otherwise(advice)
    advice = F.when(total < 24, F.lit((CARD_ADVICE_24_4BIT if quantized else CARD_ADVICE_24_FP16) % mode)).otherwise(advice)
    for lim, text in reversed(CARD_ADVICE):
        advice = F.when(total < lim, F.lit(text % mode)).otherwise(advice)
    return F.struct(step.alias("card_gb"), status.alias("status"), advice.alias("advice"))


def headroom_verdict(total: Column, gpu_gb: Column) -> Column:
    room = gpu_gb - total
    share = room / gpu_gb
    fits = F.when(room >= HEADROOM_YES_GB, F.lit("Yes")).when(room >= 0, F.lit("Tight")).otherwise(F.lit("No"))
    band = (F.when(share > 0.30, F.lit("safe")).when(share >= 0.10, F.lit("possible"))
            .when(share >= 0, F.lit("risky")).otherwise(F.lit("over")))
    return F.struct(tx.round_even(room, 2).alias("headroom_gb"), fits.alias("fits"), band.alias("headroom_band"))
