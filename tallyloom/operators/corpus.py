"""Text corpora: counts, lengths, padding and prompts."""

from __future__ import annotations

import re
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.text import n_words, pretokens, words

#: Words of one text that are objects at a time
WORDS_AT_ONCE = 1 << 16


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Corpus histogram of pre-tokens. Counts combine on the map side, so a frequent word is no hot key."""
    return df.select(F.explode(pretokens(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def word_freq(df: DataFrame, top: int, text: str = "text") -> DataFrame:
    """Most frequent words, case folded and without punctuation; ties in alphabetical order."""
    bare = F.regexp_replace(F.lower(F.col(text)), r"(?U)[^\w\s]+", " ")
    counts = df.select(F.explode(words(bare)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "word").limit(top)


def truncate_pad(ids: Column, size: int, pad: Column) -> Column:
    """Exactly ``size`` ids: cut, or filled up on the right."""
    return F.concat(F.slice(ids, 1, size), F.array_repeat(pad, F.greatest(F.lit(size) - F.size(ids), F.lit(0))))


def attention_mask(ids: Column, size: int) -> Column:
    """1 for real tokens and 0 for padding, from the length before padding."""
    kept = F.least(F.size(ids), F.lit(size))
    return F.concat(F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), F.lit(size) - kept))


def lm_pairs(ids: Column, start: int, end: int) -> tuple[Column, Column]:
    """Input and target of next-token training."""
    whole = F.concat(F.array(F.lit(start)), ids, F.array(F.lit(end)))
    n = F.size(ids) + 1
    return F.slice(whole, F.lit(1), n), F.slice(whole, F.lit(2), n)


def length_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Word-count statistics. The exact percentiles run over the histogram of lengths, not over the rows."""
    hist = df.select(n_words(F.col(text)).alias("len")).groupBy("len").agg(F.count(F.lit(1)).alias("freq"))

    def pct(p: float) -> Column:
        return F.percentile("len", F.lit(p), F.col("freq"))

    total, squares, n = F.sum(F.col("len") * F.col("freq")), F.sum(F.col("len") * F.col("len") * F.col("freq")), F.sum("freq")
    return hist.agg(
        n.alias("n"), (total / n).alias("mean"), pct(0.5).alias("median"), pct(0.95).alias("p95"), pct(0.99).alias("p99"),
        F.max("len").cast("long").alias("max_len"), F.min("len").cast("long").alias("min_len"),
        F.sqrt(squares / n - F.pow(total / n, F.lit(2))).alias("std"))


def length_histogram(df: DataFrame, bins: int, text: str = "text") -> DataFrame:
    """Equal-width bins between the shortest and the longest text; the last one is closed on the right."""
    hist = df.select(n_words(F.col(text)).cast("double").alias("len")).groupBy("len").agg(F.count(F.lit(1)).alias("freq"))
    # two numbers, whatever the size of the corpus
    low, high = hist.agg(F.min("len"), F.max("len")).first()
    if low is None:
        return hist.select(F.lit(0).cast("long").alias("bin"), F.col("freq").alias("n"))
    place = F.least(F.floor((F.col("len") - low) * bins / max(high - low, 1e-12)), F.lit(bins - 1))
    return hist.groupBy(place.alias("bin")).agg(F.sum("freq").alias("n"))


def length_ablation(df: DataFrame, lengths: list[int], text: str = "text") -> DataFrame:
    """Per candidate length: share cut off, share of padding, words kept. Works on the length histogram."""
    hist = df.select(n_words(F.col(text)).cast("long").alias("len")).groupBy("len").agg(F.count(F.lit(1)).alias("freq"))
    each = hist.select("len", "freq", F.explode(F.array(*[F.lit(x).cast("long") for x in lengths])).alias("max_len"))
    kept = F.least("len", "max_len") * F.col("freq")
    out = each.groupBy("max_len").agg(
        F.sum("freq").alias("n"), F.sum(F.when(F.col("len") > F.col("max_len"), F.col("freq")).otherwise(0)).alias("n_cut"),
        F.sum(kept).alias("kept"))
    return out.select("max_len", "n_cut", "kept", (F.col("n_cut") / F.col("n")).alias("cut_share"),
                      (1 - F.col("kept") / (F.col("n") * F.col("max_len"))).alias("pad_share"))


def recommend_length(results: DataFrame, by: list[str]) -> DataFrame:
    """First length in stored order that trades time against memory well; NULL when none does."""
    w = Window.partitionBy(*by)
    good = F.col("secs") * F.max("mem").over(w) / F.col("mem") < F.max("secs").over(w)
    marked = results.select(*by, "ord", "len", good.alias("_good"))
    return marked.groupBy(*by).agg(F.min_by("len", F.when(F.col("_good"), F.col("ord"))).alias("recommended"))


def check_lengths(df: DataFrame, max_prompt: int, max_seq: int, text: str = "text", by: list[str] | None = None) -> DataFrame:
    n = n_words(F.col(text))
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(n > max_prompt).alias("over_prompt"), F.count_if(n > max_seq).alias("over_seq"))


def locate_words(texts: pa.Array) -> pa.Array:
    """What ``word_positions`` finds in a batch; it goes into Arrow a slice of a text at a time, since an object per word takes a hundred times the text."""
    shape = re.compile(r"\w+|[^\w\s]")
    kind = pa.struct([("word", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    made, ends = [pa.array([], kind)], [0]
    for text in texts:
        found, n = shape.finditer(text.as_py() or ""), ends[-1]
        while hits := list(islice(found, WORDS_AT_ONCE)):
            columns = [pa.array([m.group() for m in hits], pa.string()), *(pa.array(map(at, hits), pa.int32()) for at in (re.Match.start, re.Match.end))]
            made.append(pa.StructArray.from_arrays(columns, fields=list(kind)))
            n += len(hits)
        ends.append(n)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(made))


def word_positions(text: Column) -> Column:
    """Words and punctuation with start and end offsets (from 0), found left to right.

    Spark's regex functions return the matches but not where they are; summing piece lengths with a
    lambda copies the growing array at each step. One linear Arrow pass per text is the fast way.
    """
    return F.arrow_udf(locate_words, "array<struct<word:string,start:int,end:int>>")(text)


# "tags" is a fixed value; the other four wordings are our own, and more can be added
SYSTEM_TAGS = "You are a helpful assistant that always responds using <reasoning> and <answer> tags."
TEMPLATES: dict[str, tuple[str | None, str, str]] = {
    "tags": (SYSTEM_TAGS,
             "Please solve the following problem and respond in this format:\n<reasoning>...</reasoning>\n<answer>...</answer>\n\n"
             "Start your response with the <reasoning> tag and include all calculation steps inside it.\nProblem:\n", ""),
    "think": ("Think inside <think> tags, then give the number inside <answer> tags.", "Problem:\n", ""),
    "answer": (None, "Solve the problem and end with <answer>number</answer>.\n", ""),
    "no_think": (None, "", "\nEnd with <answer>number</answer>. /no_think"),
    "plain": ("You solve math problems.", "", ""),
}


def chat_prompt(question: Column, template: str) -> Column:
    """Messages of a prompt: an array of (role, content)."""
    system, before, after = TEMPLATES[template]
    user = F.struct(F.lit("user").alias("role"), F.concat(F.lit(before), question, F.lit(after)).alias("content"))
    if system is None:
        return F.array(user)
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), user)


def render_chat(messages: Column, add_generation_prompt: bool = True) -> Column:
    """Messages as one text in our own fixed layout."""
    turns = F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("<|end|>\n")))
    body = F.array_join(turns, "")
    return F.concat(body, F.lit("<|assistant|>\n")) if add_generation_prompt else body


def half_up_discount(cents: Column, pct: Column) -> Column:
    """Percentage off in whole cents, halves rounded up."""
    return F.floor((cents * (F.lit(100) - pct) * 2 + 100) / 200).cast("long")
