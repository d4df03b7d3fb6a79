"""Text expressions: tokens, sentences, prompts, names."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = re.compile(r"[ \t\r\n]+")
WORD = r"[\p{L}\p{N}]+"


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def tokenize(df: DataFrame, text: str = "text", name: str = "tokens",
             tokenizer: Callable[[list[str]], list[list[str]]] | None = None) -> DataFrame:
    """Add the token array; ``tokenizer`` maps a batch of texts to their tokens."""
    if tokenizer is None:
        return df.withColumn(name, tokens(text))

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[str(t) for t in ts] for ts in tokenizer(texts.fillna("").tolist())])

    return df.withColumn(name, run(F.col(text)))


def token_id(token: Column, vocab_size: int) -> Column:
    """Numeric id of a token by hashing: no dictionary, hence no join on hot words."""
    return F.pmod(F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("bigint"),
                  F.lit(vocab_size))


def sentences(text: Column | str) -> Column:
    """Trimmed, non-empty pieces ending in . ! ? or a line break."""
    c = F.col(text) if isinstance(text, str) else text
    pieces = F.split(c, r"(?<=[.!?\n])")
    trimmed = F.transform(pieces, lambda s: F.regexp_replace(s, r"^[ \t\r\n]+|[ \t\r\n]+$", ""))
    return F.filter(trimmed, lambda s: s != "")


def snake_case(name: Column) -> Column:
    """CamelCase to snake_case; a run of capitals breaks before its last letter."""
    steps = F.regexp_replace(name, r"(?<=[a-z])(?=[0-9])", "_")
    steps = F.regexp_replace(steps, r"(?<=[a-z0-9])(?=[A-Z])", "_")
    return F.lower(F.regexp_replace(steps, r"(?<=[A-Z])(?=[A-Z][a-z])", "_"))


def normal_form(texts: pd.Series) -> pd.Series:
    """Compatibility form, no accents, lower case, single blanks, trimmed; '' stays itself."""

    def one(text: str) -> str:
        folded = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text))
        folded = "".join(ch for ch in folded if unicodedata.category(ch) != "Mn").lower()
        blank = BLANKS.sub(" ", folded)
        return " " if blank == " " else (blank.strip() or text)

    return texts.map(one)


def compress_vocabulary(vocab: DataFrame, order: str = "token_id", text: str = "token") -> DataFrame:
    """Tokens with the same normal form share one id: (token_id, token, form, new_id).

    New ids are dense in the order of the first token of each form.  Normalising runs once
    per distinct token, in Arrow batches; a token with a replacement character is its own form.
    """
    from .ordering import global_index

    fold = F.pandas_udf(normal_form, "string")
    keyed = vocab.select(order, text, F.when(F.col(text).contains("�"), F.col(text))
                         .otherwise(fold(F.col(text))).alias("form"))
    firsts = keyed.groupBy("form").agg(F.min(order).alias("_first"))
    numbered = global_index(firsts, ["_first"], "new_id").select("form", "new_id")
    return keyed.join(numbered, "form").select(order, text, "form", "new_id")


# ---- prompts: fixed wording ---------------------------------------------------------

QUESTION_HEAD = "Based on the following context, answer the question.\n\nContext:\n"
QUESTION_MID = "\n\nQuestion: "
QUESTION_TAIL = "\n\nAnswer:"
SYSTEM_TEXT = ("You are a helpful assistant that answers questions based on the provided context. "
               "Be concise and accurate.")
MORE_HEAD = "\n\n[Additional Context from Retrieval]\n"
MORE_TAIL = "\n\n[Continue Answer]\n"
CONTEXT_CHARS = 1000
MORE_CHARS = 500


def numbered_context(docs: Column, label: str = "Document", chars: int = CONTEXT_CHARS,
                     glue: str = "\n\n") -> Column:
    """``[label i] text`` of each document of a rank-ordered string array."""
    parts = F.transform(docs, lambda d, i: F.concat(
        F.lit(f"[{label} "), (i + 1).cast("string"), F.lit("] "), F.substring(d, 1, chars)))
    return F.array_join(parts, glue)


def question_prompt(context: Column, question: Column,
                    template: Callable[[Column, Column], Column] | None = None) -> Column:
    """Prompt around the context; ``template(system, user)`` replaces the plain layout."""
    user = F.concat(F.lit(QUESTION_HEAD), context, F.lit(QUESTION_MID), question)
    if template is not None:
        return template(F.lit(SYSTEM_TEXT), user)
    return F.concat(user, F.lit(QUESTION_TAIL))


def continuation_prompt(prompt: Column, written: Column, docs: Column) -> Column:
    more = numbered_context(docs, "Doc", MORE_CHARS, "\n")
    return F.concat(prompt, written, F.lit(MORE_HEAD), more, F.lit(MORE_TAIL))


# ---- operator counts of source lines ------------------------------------------------

# Fixed names: functions counted per class.
MATH_CALLS = {
    "exp": ["exp", "expf"],
    "log": ["log", "logf", "log2", "log2f", "log10", "log10f"],
    "sqrt": ["sqrt", "sqrtf"],
    "pow": ["pow", "powf"],
    "trig": ["sin", "sinf", "cos", "cosf", "tan", "tanf"],
    "other": ["abs", "fabs", "fabsf", "floor", "floorf", "ceil", "ceilf", "round", "roundf"],
    "fma": ["fma", "fmaf"],
}
ARITHMETIC = {"add": "+", "sub": "-", "mul": "*", "div": "/"}
# What a source line is read as: strings, words, signs of two characters, and any other sign.
LEXEME = r"""\"[^\"]*\"|'[^']*'|\w+|[-+*/]=|->|\+\+|--|\S"""
BEFORE, AFTER = r"[\w)\]]$", r"^[\w(\[]"   # how an operand ends, and how one begins


def is_comment(line: Column) -> Column:
    return line.rlike(r"^\s*//")


def arithmetic_counts(line: Column) -> dict[str, Column]:
    """Arithmetic operators of one source line, by class; comment lines and strings left out.

    An assignment counts as its operator, and an operator counts between two operands, each of which
    may stand beside other operators as well; arrows, steps and signs do not count.
    """
    def count(op: str) -> Column:
        lexemes = F.array(F.regexp_extract_all(line, F.lit(LEXEME), F.lit(0)))   # bound once below

        def hits(all_: Column) -> Column:
            return F.size(F.filter(all_, lambda x, i: (x == op + "=") | (
                (x == op) & F.get(all_, i - 1).rlike(BEFORE) & F.get(all_, i + 1).rlike(AFTER))))

        return F.when(is_comment(line), F.lit(0)).otherwise(F.get(F.transform(lexemes, hits), 0))

    return {name: count(op) for name, op in ARITHMETIC.items()}


def math_call_counts(line: Column) -> dict[str, Column]:
    code = F.when(is_comment(line), F.lit("")).otherwise(line)
    return {name: F.regexp_count(code, F.lit(rf"\b({'|'.join(calls)})\s*\("))
            for name, calls in MATH_CALLS.items()}
