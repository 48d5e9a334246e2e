"""Sample sets derived from the driver tables (documents, conversations, events, benchmark).

Each builder reads whole tables; the oracle SQL repeats the same derivation in DuckDB.
Modulo rules below inject defects into some rows; no row is dropped by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import land
from .lines import number_rows
from .records import conversation_turn, message_turn, parse_lines, samples_from_columns, to_samples

# ---------------------------------------------------------------------------
# Fixed values of the fixtures (shared with the oracle SQL).
# ---------------------------------------------------------------------------
CJK_SNIPPETS = {1: "中文测试", 2: "カタカナ", 3: "한국어", 4: "\U00020000\U00020001", 5: "汉字文本"}
MODEL_REQUESTS = ["qwen2-7b", "Qwen/Qwen2-7B-Instruct", "7b", "llama3_8b", "unknown-x"]
# metric of each event type in the log fixture
EVENT_METRIC = {"view": "train_loss", "purchase": "eval_loss", "click": "memory_gb", "signup": "utilisation"}
# error lines of the log fixture, chosen by event_id % 12 (the last one matches no signature)
ERROR_LINES = [
    "RuntimeError: CUDA out of memory. Tried to allocate 2.00 GiB",
    "ModuleNotFoundError: No module named 'torch'",
    "ModuleNotFoundError: No module named 'transformers'",
    "ModuleNotFoundError: No module named 'bitsandbytes'",
    "RuntimeError: CUDA error: no kernel image is available for execution on the device",
    "ValueError: tokenizer.pad_token is None",
    "TypeError: expected str instance, NoneType found",
    "ValueError: Target modules ['q_proj'] not found in the base model (target_modules not found)",
    "RuntimeError: DataLoader worker died unexpectedly",
    "RuntimeError: CUDA error: device-side assert triggered",
    "RuntimeError: expected scalar type Half but found Float",
    "Warning: step took longer than expected",
]
ARRIVAL_FILES = 5
# ---------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read as it is."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_records(spark, sf_dir) -> DataFrame:
    """documents as CPT ``text`` records; slice = source."""
    d = table(spark, sf_dir, "documents").select(
        F.col("source").alias("slice"), F.col("doc_id").alias("sample_id"), "text", "lang")
    return samples_from_columns(d, text="text", keep=["slice", "sample_id", "lang"])


def reply_records(spark, sf_dir) -> DataFrame:
    """documents as instruction/output records (instruction = lang, output = text); slice = source."""
    d = table(spark, sf_dir, "documents").select(
        F.col("source").alias("slice"), F.col("doc_id").alias("sample_id"), "text", "lang")
    return samples_from_columns(d, instruction="lang", output="text", keep=["slice", "sample_id"])


def fold_turns(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text") -> DataFrame:
    """Long turn table → one ordered ``turns`` array per conversation (bounded per conversation)."""
    return df.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
                                             F.col(text_col).alias("text")))).alias("turns"))


def messages_records(spark, sf_dir, slice_value: str = "conversations") -> DataFrame:
    folded = fold_turns(table(spark, sf_dir, "conversations"))
    msgs = F.transform("turns", lambda t: message_turn(t["role"], t["text"]))
    d = folded.select(F.lit(slice_value).alias("slice"), F.col("conv_id").alias("sample_id"), msgs.alias("messages"))
    return samples_from_columns(d, messages="messages", keep=["slice", "sample_id"])


def conversations_records(spark, sf_dir, slice_value: str = "conversations") -> DataFrame:
    """``{from, value}`` turns; ``assistant`` becomes ``bot`` when conv_id is odd."""
    folded = fold_turns(table(spark, sf_dir, "conversations"))
    odd = F.pmod(F.col("conv_id"), F.lit(2)) == 1

    def conv(t):
        who = F.when(odd & (t["role"] == "assistant"), F.lit("bot")).otherwise(t["role"])
        return conversation_turn(who, t["text"])
    d = folded.select(F.lit(slice_value).alias("slice"), F.col("conv_id").alias("sample_id"),
                      F.transform("turns", conv).alias("conversations"))
    return samples_from_columns(d, conversations="conversations", keep=["slice", "sample_id"])


def pair_turns(turns: DataFrame, id_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """Each assistant turn whose previous turn is a user turn → (instruction, output): one window over
    the turns of a conversation."""
    w = Window.partitionBy(id_col).orderBy(turn_col)
    t = turns.select(id_col, turn_col, role_col, text_col, F.lag(role_col).over(w).alias("_role"),
                     F.lag(text_col).over(w).alias("instruction"))
    return t.filter((F.col(role_col) == "assistant") & (F.col("_role") == "user")).select(
        id_col, turn_col, "instruction", F.col(text_col).alias("output"))


def pairs(spark, sf_dir) -> DataFrame:
    return pair_turns(table(spark, sf_dir, "conversations"))


def pair_records(spark, sf_dir, slice_value: str = "pairs", pairs_df: DataFrame | None = None) -> DataFrame:
    p = (pairs_df if pairs_df is not None else pairs(spark, sf_dir)).select(F.lit(slice_value).alias("slice"),
                                    (F.col("conv_id") * 1000 + F.col("turn")).alias("sample_id"),
                                    "conv_id", "turn", "instruction", "output")
    return samples_from_columns(p, instruction="instruction", output="output",
                                keep=["slice", "sample_id", "conv_id", "turn"])


def to_json(c):
    """JSON text in which a null value stands as null, not left out."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def jsonl_lines(spark, sf_dir) -> DataFrame:
    """documents as JSON lines with mixed formats and injected defects.

    kind by doc_id % 3: 0 ``{"text"}``, 1 ``{"instruction": lang, "output": text}``,
    2 ``{"messages": [user: source, assistant: text]}``. Defects (first that applies):
    % 11 = 0 last character cut, % 13 = 0 trailing `` x``, % 17 = 0 blank line, % 19 = 0 ``[1]``.
    One line per document; ``line_no`` = position by doc_id inside the slice (source).
    """
    d = table(spark, sf_dir, "documents")
    k = F.pmod(F.col("doc_id"), F.lit(3))
    rec_text = to_json(F.struct(F.col("text").alias("text")))
    rec_io = to_json(F.struct(F.col("lang").alias("instruction"), F.col("text").alias("output")))
    rec_msg = to_json(F.struct(F.array(
        F.struct(F.lit("user").alias("role"), F.col("source").alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content"))).alias("messages")))
    good = F.when(k == 0, rec_text).when(k == 1, rec_io).otherwise(rec_msg)
    i = F.col("doc_id")
    raw = (
        F.when(F.pmod(i, F.lit(11)) == 0, good.substr(F.lit(1), F.length(good) - 1))
        .when(F.pmod(i, F.lit(13)) == 0, F.concat(good, F.lit(" x")))
        .when(F.pmod(i, F.lit(17)) == 0, F.lit(""))
        .when(F.pmod(i, F.lit(19)) == 0, F.lit("[1]"))
        .otherwise(good)
    )
    lines = d.select(F.col("source").alias("slice"), F.col("doc_id").alias("sample_id"), raw.alias("raw"))
    return number_rows(lines, "sample_id", by=["slice"], out="line_no")


def jsonl_samples(spark, sf_dir, with_nb: bool = False) -> DataFrame:
    """Parsed canonical rows of ``jsonl_lines`` (blank lines dropped, every other line kept)."""
    from ..functions.text import is_blank
    lines = jsonl_lines(spark, sf_dir).filter(~is_blank(F.col("raw")))
    if with_nb:
        lines = number_rows(lines, "sample_id", by=["slice"], out="nb_no")
    parsed = parse_lines(lines)
    keep = ["slice", "sample_id", "line_no", "raw"] + (["nb_no"] if with_nb else [])
    return to_samples(parsed, keep=keep)


def alias_lines(spark, sf_dir) -> DataFrame:
    """documents as alias-keyed records: pair by doc_id % 4 (prompt/completion, question/answer,
    input/target, text/summary); values lang and text."""
    from .records import ALIAS_PAIRS
    d = table(spark, sf_dir, "documents")
    k = F.pmod(F.col("doc_id"), F.lit(4))
    raw = None
    for idx, (a, b) in enumerate(ALIAS_PAIRS):
        js = to_json(F.struct(F.col("lang").alias(a), F.col("text").alias(b)))
        raw = F.when(k == idx, js) if raw is None else raw.when(k == idx, js)
    return d.select(F.col("doc_id").alias("sample_id"), raw.alias("raw"))


def defects(spark, sf_dir, pairs_df: DataFrame | None = None) -> DataFrame:
    """pairs with output '' (conv_id % 7 = 0), 'ok' (% 11), null (% 13); '\\t' added to the
    instruction when % 5 = 0."""
    p = pairs_df if pairs_df is not None else pairs(spark, sf_dir)
    c = F.col("conv_id")
    out = (F.when(F.pmod(c, F.lit(7)) == 0, F.lit("")).when(F.pmod(c, F.lit(11)) == 0, F.lit("ok"))
           .when(F.pmod(c, F.lit(13)) == 0, F.lit(None).cast("string")).otherwise(F.col("output")))
    ins = F.when(F.pmod(c, F.lit(5)) == 0, F.concat(F.col("instruction"), F.lit("\t"))).otherwise(F.col("instruction"))
    d = p.select(F.lit("defects").alias("slice"), (c * 1000 + F.col("turn")).alias("sample_id"), "conv_id", "turn",
                 ins.alias("instruction"), out.alias("output"))
    return samples_from_columns(d, instruction="instruction", output="output",
                                keep=["slice", "sample_id", "conv_id", "turn"])


def cjk_mix(spark, sf_dir) -> DataFrame:
    """documents with CJK added by doc_id % 6: 0 none, 1 Han, 2 kana, 3 hangul, 4 Ext-B, 5 Han only."""
    d = table(spark, sf_dir, "documents")
    k = F.pmod(F.col("doc_id"), F.lit(6))
    t = F.col("text")
    for idx in (1, 2, 3, 4):
        t = F.when(k == idx, F.concat(F.col("text"), F.lit(CJK_SNIPPETS[idx]))).otherwise(t)
    t = F.when(k == 5, F.lit(CJK_SNIPPETS[5])).otherwise(t)
    return d.select(F.col("source").alias("slice"), F.col("doc_id").alias("sample_id"), t.alias("text"))


def near_dup_docs(spark, sf_dir) -> DataFrame:
    """documents plus, for doc_id % 10 = 0, a copy with blanks doubled and a leading tab
    (same fingerprint); the copy's id is doc_id + 1e9."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    copies = d.filter(F.pmod(F.col("doc_id"), F.lit(10)) == 0).select(
        (F.col("doc_id") + F.lit(1_000_000_000)).alias("doc_id"), "source",
        F.concat(F.lit("\t"), F.regexp_replace("text", " ", "  ")).alias("text"))
    return d.unionByName(copies)


def holdout(spark, sf_dir) -> DataFrame:
    """The held-out eval set: the exact 10 % test part of each source (md5 split)."""
    from ..operators import prep
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("slice"), "doc_id", "text")
    return prep.split(d, "doc_id", ["slice"]).filter(F.col("split") == "test")


def eval_outputs(spark, sf_dir) -> DataFrame:
    """benchmark as eval cases: base output = text, tuned output = prompt + text."""
    from ..functions.formats import prompt
    b = table(spark, sf_dir, "benchmark")
    p = prompt(F.lit("instruction-output"), F.col("text"))
    return b.select("item_id", F.col("text").alias("instruction"), F.col("text").alias("expected"),
                    p.alias("formatted_prompt"),
                    F.col("text").alias("base_raw"), F.concat(p, F.col("text")).alias("tuned_raw"))


def log_lines(spark, sf_dir) -> DataFrame:
    """events as training-log points: run_id = user_id, step = order in run by (ts, event_id),
    metric by event type, error rows carry a log line chosen by event_id % 12."""
    e = table(spark, sf_dir, "events")
    metric = F.lit(None).cast("string")
    for k, v in EVENT_METRIC.items():
        metric = F.when(F.col("event_type") == k, F.lit(v)).otherwise(metric)
    err = F.element_at(F.array(*[F.lit(x) for x in ERROR_LINES]), (F.pmod(F.col("event_id"), F.lit(12)) + 1).cast("int"))
    line = F.when(F.col("event_type") == "error", err)
    pts = e.select(F.col("user_id").alias("run_id"), "event_id", "ts", "event_type", metric.alias("metric"),
                   "value", line.alias("line"))
    # rank by (ts, event_id) inside a run; a run may be hot, so no single-group window
    pts = land(pts, "log-points").withColumn("_ord", F.struct("ts", "event_id"))  # the events are read once
    return number_rows(pts, "_ord", by=["run_id"], out="step",
                       bucket_key=F.unix_micros(F.col("ts").cast("timestamp"))).drop("_ord")


def event_arrivals(spark, sf_dir, very_late: bool = False) -> DataFrame:
    """events with ``file``, the number of the file they arrive in.

    An event arrives up to an hour after its time (by event_id), so the ARRIVAL_FILES files overlap in time;
    with ``very_late`` those with event_id % 97 = 0 arrive two days later."""
    e = table(spark, sf_dir, "events")
    delay = F.col("event_id") * 7919 % 3600
    if very_late:
        delay = delay + F.when(F.col("event_id") % 97 == 0, 2 * 86400).otherwise(0)
    at = F.unix_micros(F.col("ts").cast("timestamp")) + delay * 1_000_000
    e = land(e.withColumn("_at", F.struct(at.alias("at"), "event_id")), "arrivals")
    e = number_rows(e, "_at", out="_n", bucket_key=F.col("_at.at"))
    return land(e.withColumn("file", F.floor((F.col("_n") - 1) * ARRIVAL_FILES / F.lit(e.count())).cast("int")).drop("_at", "_n"), "arrivals")


def event_line() -> Column:
    """An event as a JSON line {ts, instruction, output}; the last character is cut where event_id % 23 = 0."""
    line = to_json(F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), F.col("event_type").alias("instruction"), F.col("props").alias("output")))
    return F.when(F.col("event_id") % 23 == 0, line.substr(F.lit(1), F.length(line) - 1)).otherwise(line)
