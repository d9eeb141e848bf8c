"""Rule-based rewards as columns over a reply, its extracted answer and the true answer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.answers import extract_answer, is_integer_like, safe_float, same_number
from tallyloom.functions.text import n_words, strip

# fixed values: the reply formats
STRICT = {
    "reasoning": r"(?sU)\A<reasoning>\s*.*?\s*</reasoning>\s*<answer>\s*.*?\s*</answer>\s*\z",
    "think": r"(?sU)\A<think>\s*.*?\s*</think>.*?<answer>\s*.*?\s*</answer>\s*\z",
    "answer": r"(?sU)<answer>\s*.*?\s*</answer>\s*\z",
}
SOFT = r"(?sU)<reasoning>.*?</reasoning>\s*<answer>.*?</answer>"
ANSWER_PAIR = r"(?s)<answer>.*?</answer>"
FORMAT_TAGS = ("<reasoning>", "</reasoning>", "<answer>", "</answer>")


@dataclass(frozen=True)
class Scored:
    """What a reward may look at. ``found`` and ``truth`` are extracted answers as text."""

    reply: Column
    found: Column
    truth: Column


def _pay(amount: float, condition: Column) -> Column:
    return F.when(condition, F.lit(amount)).otherwise(F.lit(0.0))


def correctness(row: Scored) -> Column:
    return _pay(2.0, same_number(safe_float(row.found), safe_float(row.truth)))


def integer(row: Scored) -> Column:
    return _pay(0.5, is_integer_like(row.found))


def strict_format(shape: str = "reasoning") -> Callable[[Scored], Column]:
    return lambda row: _pay(0.5, row.reply.rlike(STRICT[shape]))


def soft_format(row: Scored) -> Column:
    return _pay(0.5, row.reply.rlike(SOFT))


def xml_count(row: Scored) -> Column:
    total = F.lit(0.0)
    for tag in FORMAT_TAGS:
        total = total + _pay(0.125, row.reply.contains(tag))
    return total


def starts_with(tag: str) -> Callable[[Scored], Column]:
    return lambda row: _pay(1.0, strip(row.reply).startswith(tag))


def has_think_tags(row: Scored) -> Column:
    return _pay(0.5, row.reply.contains("<think>") & row.reply.contains("</think>"))


def has_answer_tag(row: Scored) -> Column:
    return _pay(0.5, row.reply.rlike(ANSWER_PAIR))


def overlong(max_seq: int, max_prompt: int) -> Callable[[Scored], Column]:
    limit = int(0.9 * (max_seq - max_prompt))
    return lambda row: _pay(-0.5, n_words(row.reply) > limit)


REWARDS: dict[str, Callable[[Scored], Column]] = {
    "correctness": correctness,
    "integer": integer,
    "strict_reasoning": strict_format("reasoning"),
    "strict_think": strict_format("think"),
    "strict_answer": strict_format("answer"),
    "soft": soft_format,
    "xml_count": xml_count,
    "starts_reasoning": starts_with("<reasoning>"),
    "starts_think": starts_with("<think>"),
    "has_think": has_think_tags,
    "has_answer": has_answer_tag,
    "overlong": overlong(1536, 384),
}

# fixed values: which rewards a training run adds up
REWARD_SETS: dict[str, tuple[str, ...]] = {
    "full": ("starts_reasoning", "xml_count", "soft", "strict_reasoning", "integer", "correctness"),
    "no_start": ("xml_count", "soft", "strict_reasoning", "integer", "correctness"),
    "think": ("starts_think", "has_think", "has_answer", "strict_think", "integer", "correctness"),
    "dapo": ("starts_reasoning", "xml_count", "soft", "strict_reasoning", "integer", "correctness", "overlong"),
    "answer_only": ("has_answer", "strict_answer", "integer", "correctness"),
    "soft_only": ("xml_count", "soft", "integer", "correctness"),
    "smoke": ("has_answer", "correctness"),
}


def register_reward(name: str, reward: Callable[[Scored], Column]) -> None:
    """Add a reward of your own: a column function, or one that calls a pandas UDF."""
    REWARDS[name] = reward


def add_rewards(df: DataFrame, names: list[str] | tuple[str, ...], *, reply: str = "completion",
                truth: str = "answer", mixed: bool = True) -> DataFrame:
    """One column ``reward_<name>`` per reward; the answer is extracted once per reply."""
    df = extract_answer(df, reply, "found", mixed=mixed)
    row = Scored(F.col(reply), F.col("found"), F.col(truth))
    return df.select("*", *[REWARDS[n](row).alias(f"reward_{n}") for n in names])


def total_reward(df: DataFrame, reward_set: str, *, out: str = "reward", **kw) -> DataFrame:
    """Sum of the rewards of a set."""
    names = REWARD_SETS[reward_set]
    scored = add_rewards(df, names, **kw)
    total = sum((F.col(f"reward_{n}") for n in names[1:]), F.col(f"reward_{names[0]}"))
    return scored.withColumn(out, total).drop(*[f"reward_{n}" for n in names])
