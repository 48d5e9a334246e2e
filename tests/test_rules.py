"""Plan rules R2-R10 at every boundary against a plain-Python version of the rule text."""
from pyspark.sql import functions as F

from tunekiln.plans import rules as ru

NS = [199, 200, 499, 500, 999, 1000, 4999, 5000, 9999, 10000, 19999, 20000, 20001, 50000, 50001]
TASKS = ["chat", "code", "math", "roleplay", "cpt"]
GPUS = [7.9, 8.0, 16.0, 24.0, 48.0]


def py_plan(n, task, model, gb):
    base = 4 if n < 1000 else 8 if n < 5000 else 16 if n < 20000 else 32
    ceil = 4 if n < 500 else 8 if n < 1000 else 16 if n < 5000 else 32 if n < 20000 else 999
    r = base
    if task == "cpt":
        cc = 8 if n < 500 else 16 if n < 1000 else 32 if n < 5000 else 64
        r = cc if cc > ceil else min(ceil, 64)
    elif task in ("code", "math"):
        r = ceil if 16 > ceil else (16 if base < 16 else base)
    elif task == "roleplay":
        r = min(base, 8)
    alpha = r * 4 if task == "roleplay" else r if task == "math" else r * 2
    lr = 1e-4 if r <= 4 else 2e-4 if r <= 8 else 3e-4 if r <= 16 else 5e-4
    if task == "cpt":
        lr = max(5e-5, min(lr, 1e-4))
    elif task == "roleplay":
        lr *= 1.5
    elif task == "math":
        lr *= 0.75
    if n > 20000:
        lr *= 1.2
    lr = round(lr, 6)
    drop = 0.05 if task == "cpt" else 0.15 if n < 500 else 0.1 if n < 1000 else 0.05 if n < 10000 else 0.0
    ep = 1 if task == "cpt" else 5 if n < 500 else 3 if n < 5000 else 2 if n < 20000 else 1
    bs = 1 if gb < 8 else 2 if gb < 16 else 4 if gb < 24 else 8 if gb < 48 else 16
    tgt = 32 if task == "cpt" else 8 if n < 200 else 32 if n > 50000 else 16
    ga = max(1, tgt // bs)
    steps = max(1, (n // (bs * ga)) * ep)
    warm = min(max(10, steps // 10), max(1, steps - 1))
    save = min(500, max(50, steps // 5))
    mods = {"cpt": 7, "code": 4, "math": 5, "roleplay": 1, "chat": 2}[task]
    try:
        size = int(model.lower().replace("b", ""))
    except ValueError:
        size = 7
    has_o = task in ("cpt", "code")
    if size in {13, 14, 20, 34, 67, 70, 72, 123, 405} and not has_o:
        mods += 1
    return (r, alpha, lr, drop, ep, bs, ga, steps, warm, save, mods)


def test_rules_boundaries(spark):
    grid = [(n, t, m, g) for n in NS for t in TASKS for m in ["7b", "13b", "qwen2-72b", "72B"] for g in GPUS]
    df = spark.createDataFrame(grid, "n long, task string, model string, gpu_gb double")
    hp = ru.hyperparams(df)
    got = hp.select("n", "task", "model", "gpu_gb", "rank", "alpha", "learning_rate", "dropout", "epochs",
                    "batch_size", "gradient_accumulation", "total_steps", "warmup_steps", "save_steps",
                    F.size("target_modules").alias("m")).collect()
    assert len(got) == len(grid)
    for r in got:
        exp = py_plan(r.n, r.task, r.model, r.gpu_gb)
        assert (r.rank, r.alpha, r.learning_rate, r.dropout, r.epochs, r.batch_size, r.gradient_accumulation,
                r.total_steps, r.warmup_steps, r.save_steps, r.m) == exp, (r, exp)


def test_memory_check_value(spark):
    # qwen2-7b, S=2048, B=4, r=8, two modules, 4-bit with checkpointing: about 4.6 GB
    df = spark.createDataFrame([(7e9, 3584, 28, 2048, 4, 8, 2)], "p double, h long, l long, s long, b long, r long, m long")
    mem = df.select(ru.memory(F.col("p"), F.col("h"), F.col("l"), F.col("s"), F.col("b"), F.col("r"), F.col("m")).alias("x"))
    x = mem.collect()[0].x
    w = 7e9 * 0.5 / 1e9 + 28 * (2 * 8 * 3584 * 2) * 2 / 1e9
    a = (4 * 2048 * 3584 * 2 / 1e9) * 28 * 0.3
    o = 28 * 2 * (2 * 8 * 3584) * 8 / 1e9
    ov = (w + a + o) * 0.15
    assert x.total == round(w + a + o + ov, 2) == 4.63
    assert x.model_weight == round(w, 2) and x.activation == round(a, 2)


def test_target_modules_strict_doc(spark):
    df = spark.createDataFrame([("32b",), ("13b",), ("7b",), ("qwen2-72b",)], "model string")
    coded = [len(r[0]) for r in df.select(ru.target_modules(F.lit("chat"), F.col("model"))).collect()]
    prose = [len(r[0]) for r in df.select(ru.target_modules(F.lit("chat"), F.col("model"), strict_doc=True)).collect()]
    assert coded == [2, 3, 2, 2] and prose == [3, 3, 2, 2]


def test_large_models_say_that_a_module_was_added(spark):
    df = spark.createDataFrame([("chat", "72B"), ("code", "72B"), ("chat", "7b")], "task string, model string")
    got = [(r.m, r.w) for r in df.select(ru.target_modules(F.col("task"), F.col("model")).alias("m"),
                                         ru.modules_reason(F.col("task"), F.col("model")).alias("w")).collect()]
    assert ["o_proj" in m for m, _ in got] == [True, True, False]
    assert [w.endswith(ru.MODULES_REASON_LARGE) for _, w in got] == [True, False, False]
