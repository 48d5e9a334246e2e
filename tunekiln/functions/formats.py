"""Format detection, text extraction and templates over canonical sample columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import py_strip

# ---------------------------------------------------------------------------
# Format labels and templates that must equal the reference's.
# ---------------------------------------------------------------------------
FMT_A_CHAT = "chat"
FMT_IO = "instruction-output"
FMT_CONV = "conversations"
FMT_UNKNOWN = "unknown"
FMT_MESSAGES = "messages"
FMT_V_TEXT = "text (CPT/pretraining)"
FMT_T_TEXT = "cpt (text)"
# A label -> pipeline label (anything else -> instruction-output)
FORMAT_MAP = {"chat": "messages", "conversations": "conversations", "instruction-output": "instruction-output"}
TPL_INSTRUCTION_HEAD = "### Instruction:\n"
TPL_RESPONSE_HEAD = "\n\n### Response:\n"
CHAT_ROLE_OPEN = "<|"
CHAT_ROLE_CLOSE = "|>\n"
CHAT_TURN_SEP = "\n"
PROMPT_CHAT_HEAD = "<|user|>\n"
PROMPT_CHAT_TAIL = "\n<|assistant|>\n"
DEFAULT_ROLE = "user"
ASSISTANT_ROLES_CONV = ("assistant", "bot")
KNOWN_KEYS = ("messages", "instruction", "output", "conversations", "text", "input")
# ---------------------------------------------------------------------------

def _E() -> Column:
    return F.lit("")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fmt_a() -> Column:
    """A: chat if messages is a list; instruction-output if both keys; conversations; unknown."""
    return (
        F.when(F.col("messages").isNotNull(), F.lit(FMT_A_CHAT))
        .when(F.col("k_instruction") & F.col("k_output"), F.lit(FMT_IO))
        .when(F.col("k_conversations"), F.lit(FMT_CONV))
        .otherwise(F.lit(FMT_UNKNOWN))
    )


def _fmt_vt(text_label: str) -> Column:
    return (
        F.when(F.col("k_messages"), F.lit(FMT_MESSAGES))
        .when(F.col("k_instruction") & F.col("k_output"), F.lit(FMT_IO))
        .when(F.col("k_conversations"), F.lit(FMT_CONV))
        .when(F.col("k_text"), F.lit(text_label))
        .otherwise(F.lit(FMT_UNKNOWN))
    )


def fmt_v() -> Column:
    """V: key presence only; messages → instruction-output → conversations → text → unknown."""
    return _fmt_vt(FMT_V_TEXT)


def fmt_t() -> Column:
    return _fmt_vt(FMT_T_TEXT)


def fmt_canonical() -> Column:
    """Short per-row label: messages | instruction-output | conversations | text | unknown."""
    return _fmt_vt("text")


def map_format(fmt_a_col) -> Column:
    c = _c(fmt_a_col)
    out = F.lit(FMT_IO)
    for k, v in reversed(list(FORMAT_MAP.items())):
        out = F.when(c == F.lit(k), F.lit(v)).otherwise(out)
    return out


def key_fields_v(fmt_v_col, first_keys: Column | None = None) -> Column:
    """Fields V checks: by format, else all keys of record one (``first_keys``)."""
    c = _c(fmt_v_col)
    return (
        F.when(c == FMT_MESSAGES, F.array(F.lit("messages")))
        .when(c == FMT_IO, F.array(F.lit("instruction"), F.lit("output")))
        .when(c == FMT_CONV, F.array(F.lit("conversations")))
        .when(c == FMT_V_TEXT, F.array(F.lit("text")))
        .otherwise(first_keys if first_keys is not None else F.array().cast("array<string>"))
    )


# ---- text extraction -------------------------------------------------------

def full_text_a() -> Column:
    """A: turns joined by one space (messages: content only); else instruction + ' ' + output."""
    msgs = F.array_join(F.transform("messages", lambda m: F.coalesce(m["content"], _E())), " ")
    conv = F.array_join(F.transform("conversations", lambda m: F.coalesce(m["content"], m["value"], _E())), " ")
    io = F.concat(F.coalesce(F.col("instruction"), _E()), F.lit(" "), F.coalesce(F.col("output"), _E()))
    return (
        F.when(F.col("messages").isNotNull(), msgs)
        .when(F.col("conversations").isNotNull(), conv)
        .otherwise(io)
    )


def _list_text_v(arr: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(arr, lambda m: F.when(
        m["is_obj"], F.coalesce(m["content"], m["value"], _E())).otherwise(F.coalesce(m["as_str"], _E()))), ""), _E())


def odd(k: str | Column) -> Column:
    """Kind of key ``k``'s value where it has no typed column (an unknown key, or an unusual type), else null."""
    return F.col("kinds")[k]


def field_value(k: Column) -> Column:
    """V's text of top-level key ``k``: ``fields`` where its value stands there, else the typed column."""
    return (F.when(odd(k).isNotNull(), F.col("fields")[k]).when(k == "instruction", F.col("instruction")).when(k == "output", F.col("output"))
            .when(k == "input", F.col("input")).when(k == "text", F.col("text"))
            .when(k == "messages", _list_text_v(F.col("messages"))).when(k == "conversations", _list_text_v(F.col("conversations"))))


def full_text_v(key_fmt, first_keys: Column | None = None) -> Column:
    """V: key fields concatenated with nothing; list items give content, else value; a value that is
    neither a string nor a list gives nothing."""
    c = _c(key_fmt)
    one = lambda k: F.coalesce(field_value(F.lit(k)), _E())
    unknown = _E()
    if first_keys is not None:
        unknown = F.array_join(F.transform(first_keys, lambda k: F.coalesce(field_value(k), _E())), "")
    return (
        F.when(c == FMT_MESSAGES, one("messages"))
        .when(c == FMT_IO, F.concat(one("instruction"), one("output")))
        .when(c == FMT_CONV, one("conversations"))
        .when(c == FMT_V_TEXT, one("text"))
        .otherwise(unknown)
    )


def _scalar_text_t(k: str) -> Column:
    # str(val): a present null becomes 'None', a missing key ''
    return F.when(F.col("k_" + k), F.coalesce(F.col(k), F.lit("None"))).otherwise(_E())


def full_text_t(key_fmt) -> Column:
    """T: like V, but a non-list value is ``str(val)``."""
    c = _c(key_fmt)
    lst = lambda a: F.coalesce(F.array_join(F.transform(a, lambda m: F.coalesce(m["content"], m["value"], _E())), ""), _E())
    return (
        F.when(c == FMT_MESSAGES, lst(F.col("messages")))
        .when(c == FMT_IO, F.concat(_scalar_text_t("instruction"), _scalar_text_t("output")))
        .when(c == FMT_CONV, lst(F.col("conversations")))
        .when(c == FMT_T_TEXT, _scalar_text_t("text"))
        .otherwise(_E())
    )


def output_text_a() -> Column:
    """A: last assistant turn (conversations: role or from in assistant/bot), '' if none; else output."""
    last_msg = F.try_element_at(F.filter("messages", lambda m: m["role"] == F.lit("assistant")), F.lit(-1))
    last_conv = F.try_element_at(
        F.filter("conversations", lambda m: F.coalesce(m["role"], m["from"]).isin(*ASSISTANT_ROLES_CONV)), F.lit(-1))
    return (
        F.when(F.col("messages").isNotNull(), F.coalesce(last_msg["content"], _E()))
        .when(F.col("conversations").isNotNull(), F.coalesce(last_conv["content"], last_conv["value"], _E()))
        .otherwise(F.coalesce(F.col("output"), _E()))
    )


# ---- templates -------------------------------------------------------------

def tpl_instruction(i, o) -> Column:
    return F.concat(F.lit(TPL_INSTRUCTION_HEAD), F.coalesce(_c(i), _E()), F.lit(TPL_RESPONSE_HEAD), F.coalesce(_c(o), _E()))


def tpl_chatml(turns, conversations: bool = False) -> Column:
    """``<|role|>\\ncontent`` per turn joined by newline; role defaults to ``user``."""
    def one(m):
        if conversations:
            role = F.coalesce(m["role"], m["from"], F.lit(DEFAULT_ROLE))
            content = F.coalesce(m["content"], m["value"], _E())
        else:
            role = F.coalesce(m["role"], F.lit(DEFAULT_ROLE))
            content = F.coalesce(m["content"], _E())
        return F.concat(F.lit(CHAT_ROLE_OPEN), role, F.lit(CHAT_ROLE_CLOSE), content)
    return F.array_join(F.transform(_c(turns), one), CHAT_TURN_SEP)


def tpl_auto() -> Column:
    """Per-row template: messages → instruction-output → conversations; else null (unsupported)."""
    return (
        F.when(F.col("messages").isNotNull(), tpl_chatml("messages"))
        .when(F.col("k_instruction") & F.col("k_output"), tpl_instruction("instruction", "output"))
        .when(F.col("conversations").isNotNull(), tpl_chatml("conversations", conversations=True))
    )


def tpl_cpt() -> Column:
    return F.col("text")


def prompt(fmt, p) -> Column:
    """Inference/eval prompt: chat formats get the chat wrapper, others the instruction one."""
    chat = F.concat(F.lit(PROMPT_CHAT_HEAD), F.coalesce(_c(p), _E()), F.lit(PROMPT_CHAT_TAIL))
    instr = F.concat(F.lit(TPL_INSTRUCTION_HEAD), F.coalesce(_c(p), _E()), F.lit(TPL_RESPONSE_HEAD))
    return F.when(_c(fmt).isin(FMT_MESSAGES, FMT_CONV), chat).otherwise(instr)


def strip_prompt(resp, prompt_col) -> Column:
    """If the response contains the prompt, drop its first len(prompt) characters and strip."""
    r, p = _c(resp), _c(prompt_col)
    return F.when(F.instr(r, p) > 0, py_strip(r.substr(F.length(p) + 1, F.lit(2147483647)))).otherwise(r)
