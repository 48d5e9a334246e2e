"""Evaluation sets: prompts, first-N cases, side-by-side outputs, Q/A text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formats as fm
from ..functions import text as tx

# Case limits of the evaluation step.
EVAL_MAX_CASES = 100
COMPARE_MAX_CASES = 50
QA_BLOCK = "Q%d: %s\nA%d: %s\n\n"


def prompt_text(fmt: str, compat: bool = False):
    """Text placed in an eval prompt. Instruction data: ``instruction``. Chat data: the last user
    turn; with ``compat=True`` the original behaviour, which reads ``instruction`` from chat
    records and so leaves the prompt body empty."""
    if fmt in ("messages", "conversations") and not compat:
        col = "messages" if fmt == "messages" else "conversations"
        last_user = F.try_element_at(F.filter(col, lambda m: F.coalesce(m["role"], m["from"]).isin("user", "human")),
                                     F.lit(-1))
        return F.coalesce(last_user["content"], last_user["value"], F.lit(""))
    return F.coalesce(F.col("instruction"), F.lit(""))


def eval_cases(cases: DataFrame, order: str, fmt: str, limit: int = EVAL_MAX_CASES,
               prompt_col: str = "instruction") -> DataFrame:
    """First ``limit`` cases by line order with their formatted prompts (TakeOrderedAndProject)."""
    c = cases.orderBy(order).limit(limit)
    return c.withColumn("formatted_prompt", fm.prompt(F.lit(fmt), F.col(prompt_col)))


def eval_metrics(cases: DataFrame) -> DataFrame:
    """Case count and mean formatted-prompt length (1 decimal)."""
    return cases.agg(F.count(F.lit(1)).alias("total_test_cases"),
                     tx.round_even(F.avg(F.length("formatted_prompt")), 1).alias("avg_instruction_length"))


def side_by_side(cases: DataFrame, base: DataFrame, tuned: DataFrame, key: str) -> DataFrame:
    """Case ⋈ base output ⋈ tuned output on the case key, responses stripped of their prompt."""
    j = cases.join(base, key).join(tuned, key)
    return j.select(key, "instruction", "formatted_prompt", F.col("expected"),
                    fm.strip_prompt(F.col("base_raw"), F.col("formatted_prompt")).alias("base_model_output"),
                    fm.strip_prompt(F.col("tuned_raw"), F.col("formatted_prompt")).alias("lora_model_output"))


def qa_blocks(questions: DataFrame, q_no: str, question: str, answer: str) -> DataFrame:
    """``Q{i}: …\\nA{i}: …\\n\\n`` per numbered question."""
    return questions.select(q_no, F.format_string(QA_BLOCK, F.col(q_no), F.col(question), F.col(q_no),
                                                  F.col(answer)).alias("block"))
