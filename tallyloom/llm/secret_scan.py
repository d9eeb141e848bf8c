"""Secret scans by Spark expressions only: known forms, and high entropy in a sliding window over long runs of key characters.

Where a pattern matches comes from cutting the text at its matches: the lengths of the pieces and of the matches add up to places.
The entropy of a window of W characters is log2 W - S / W, with S the sum of c log2 c over the counts c. Moving the window on changes
two counts, so S is carried along; it is held in whole billionths, which makes it exact however long the run is.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import free_name

# fixed values: the forms that every scan reports
ASSIGN_WORDS = "password|passwd|secret|token|api_?key"
ASSIGN_REST = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # 16 or more characters
HEX = r"[0-9a-f]{32,}"
ASSIGN = "(" + "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in ASSIGN_WORDS) + ")" + ASSIGN_REST
ASSIGN_LEAST = 8

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW
UNIT = 10**9
LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: kind, pattern of the whole run, alphabet, least entropy in bits; the first that fits is taken
CLASSES = (
    ("entropy_hex", r"^[0-9a-fA-F]+$", DIGITS + "abcdef", 3.0),
    ("entropy_alnum", r"^[A-Za-z0-9]+$", DIGITS + LETTERS.upper() + LETTERS, 3.6),
    ("entropy_base64", r"^", DIGITS + LETTERS.upper() + LETTERS + "+/_=-", 3.7),
)
#: runs that are no secrets: words, numbers and rules; words or numbers joined by marks; universal ids; samples; one character on and on
ALLOWED = (
    r"^[A-Za-z]+$",
    r"^[0-9+/_=-]+$",
    r"^[A-Za-z]+([+/_=-]+([A-Za-z]+|[0-9]+))*[+/_=-]*$",
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"EXAMPLE|example|xxxxxxxx|XXXXXXXX",
    r"(.)\1{9}",
    r"0123456789|abcdefghij|ABCDEFGHIJ",
)
#: Samples inside a run: they are cut out, what is left is looked at. All have a fixed length.
SAMPLES = tuple(p for p in ALLOWED if not p.startswith("^"))
KINDS = ("assign", "access", "hex", *(c[0] for c in CLASSES))
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"
FOUND = "array<struct<start:int,end:int,s:string>>"


def _none(kind: str) -> Column:
    return F.expr(f"CAST(array() AS {kind})")


def found(text: Column, pattern: str) -> Column:
    """Leftmost matches that don't overlap, as array of (start, end, s) in code points."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, lambda gap, s: F.struct(F.length(gap).alias("gap"), s.alias("s")))
    zero = F.struct(F.lit(0).alias("at"), _none(FOUND).alias("out"))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["s"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["s"].alias("s")))).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(pairs, zero, step)["out"]).otherwise(_none(FOUND))


def _spans(places: Column, kind: str) -> Column:
    return F.transform(places, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))


#: Counts of a window need five bits each; a long holds twelve
BITS, PER_LONG = 5, 12


def _windows(s: Column, alphabet: str, least: float) -> Column:
    """From the start of the first window of enough entropy to the end of the last one; (-1, -1) if there is none.

    The counts of the alphabet lie in a few longs, so that moving on is two additions.
    """
    weight = F.array(*(F.lit(round(UNIT * c * log2(c)) if c else 0).cast("long") for c in range(WINDOW + 2)))
    most = int(UNIT * WINDOW * (log2(WINDOW) - least))
    longs = [f"c{i}" for i in range(-(-len(alphabet) // PER_LONG))]
    codes = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    steps = F.transform(codes, lambda c, i: F.struct(c.alias("new"), F.when(i >= WINDOW, F.get(codes, i - WINDOW)).otherwise(-1).alias("old"), i.alias("i")))
    none = F.lit(0).cast("long")
    zero = F.struct(*[none.alias(c) for c in longs], none.alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    place = lambda code: (code % PER_LONG) * BITS
    part = lambda code: F.floor(code / PER_LONG)

    def step(acc, x):
        old, new = x["old"], x["new"]

        def count(code):
            held = acc[longs[0]]
            for i, c in enumerate(longs[1:], 1):
                held = F.when(part(code) == i, acc[c]).otherwise(held)
            return F.call_function("shiftright", held, place(code)).bitwiseAND(F.lit((1 << BITS) - 1).cast("long")).cast("int")

        one = lambda code: F.call_function("shiftleft", F.lit(1).cast("long"), place(code))
        was = count(F.greatest(old, F.lit(0)))
        gone = F.when(old < 0, none).otherwise(weight[was] - weight[F.greatest(was - 1, F.lit(0))])
        before = count(new) - F.when(old == new, 1).otherwise(0)
        total = acc["sum"] - gone + weight[before + 1] - weight[before]
        counts = [acc[c] + F.when(part(new) == i, one(new)).otherwise(none) - F.when((old >= 0) & (part(old) == i), one(old)).otherwise(none) for i, c in enumerate(longs)]
        high = (x["i"] >= WINDOW - 1) & (total <= most)
        return F.struct(
            *[v.alias(c) for c, v in zip(longs, counts)], total.alias("sum"),
            F.when(high & (acc["first"] < 0), x["i"] - WINDOW + 1).otherwise(acc["first"]).alias("first"),
            F.when(high, x["i"] + 1).otherwise(acc["last"]).alias("last"),
        )

    return F.aggregate(steps, zero, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _entropy_spans(candidates: Column) -> Column:
    """Runs of (start, end, s) to spans of high entropy."""

    def span(x, kind):
        place = lambda w: F.struct((x["start"] + w["first"]).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (x["start"] + w["last"]).alias("end"), F.lit(kind).alias("kind"))
        return lambda w: F.when(w["first"] >= 0, place(w))

    def scan(x):
        of = F.lit(None).cast("struct<start:int,rank:int,end:int,kind:string>")
        for kind, whole, alphabet, least in reversed(CLASSES):
            windows = _windows(F.lower(x["s"]) if kind == "entropy_hex" else x["s"], alphabet, least)
            of = F.when(x["s"].rlike(whole), F.transform(F.array(windows), span(x, kind))[0]).otherwise(of)
        return of

    return F.filter(F.transform(candidates, scan), lambda x: x.isNotNull())


def _left_over(x, base: Column) -> Column:
    """The parts of a run outside base spans and samples, as runs of their own."""

    def blanked(acc, b):
        start, end = F.greatest(b["start"], x["start"]) - x["start"], F.least(b["end"], x["end"]) - x["start"]
        return F.concat(F.substring(acc, 1, start), F.repeat(F.lit(" "), end - start), F.substring(acc, end + 1, F.length(acc)))

    touching = F.filter(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    rest = F.aggregate(touching, x["s"], blanked)
    for pattern in SAMPLES:
        for one in pattern.split("|"):
            rest = F.regexp_replace(rest, one, " " * (10 if "\\1" in one else len(one)))
    shift = lambda y: F.struct((x["start"] + y["start"]).alias("start"), (x["start"] + y["end"]).alias("end"), y["s"].alias("s"))
    return F.transform(found(rest, CANDIDATE), shift)


def find_secrets(docs: DataFrame, text: str = "text", base_name: str = "_base", spans_name: str = "_spans") -> DataFrame:
    """The columns of ``docs`` with two added: base spans and all spans, arrays of (start, rank, end, kind) by start, then kind.

    Code points, the end is exclusive. A null or empty text has none. Of a run of key characters, base spans and samples are
    left out, and the rest of it is looked at in full. Rows that are alike all stay; an empty table gives no rows. Columns of
    ``docs`` may have any other names.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    held = free_name("_found", [*docs.columns, base_name, spans_name])
    of = lambda name: F.col(held)[name]
    places = docs.withColumn(held, F.struct(*[found(whole, p).alias(n) for n, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("runs", CANDIDATE))]))
    long_enough = F.filter(of("assign"), lambda x: F.length(F.regexp_extract(x["s"], ASSIGN, 2)) >= ASSIGN_LEAST)
    based = places.withColumn(base_name, F.array_sort(F.concat(_spans(long_enough, "assign"), _spans(of("access"), "access"), _spans(of("hex"), "hex"))))

    def unlike_words(x):
        keep = F.lit(True)
        for pattern in ALLOWED:
            if pattern not in SAMPLES:
                keep = keep & ~x["s"].rlike(pattern)
        return keep

    parts = F.flatten(F.transform(F.filter(of("runs"), unlike_words), lambda x: _left_over(x, F.col(base_name))))
    more = _entropy_spans(F.filter(parts, unlike_words))
    spans = F.when(F.size(of("runs")) > 0, F.array_sort(F.concat(base_name, more))).otherwise(F.col(base_name))
    return based.withColumn(spans_name, spans).drop(held)


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def digests(docs: DataFrame) -> DataFrame:
    """Documents to (doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    got = find_secrets(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("_base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return got.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(written(F.col("_base")), 256).alias("base_sha256"), written(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """The same rows and columns, whatever their names; each secret in ``text`` gives way to ``mask``, and ``n_chars`` of such a row is counted anew.

    A text without secrets, null included, stays as it is. Spans that overlap give way to one mask.
    """
    names = docs.columns
    base, spans = free_name("_base", names), free_name("_spans", names)
    got = find_secrets(docs, base_name=base, spans_name=spans)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        gap = F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"])
        return F.when(x["start"] >= acc["at"], F.struct(x["end"].alias("at"), F.concat(acc["out"], gap, F.lit(mask)).alias("out"))).otherwise(
            F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))
        )

    clean = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    put = got.withColumn("text", F.when(F.size(spans) > 0, clean).otherwise(F.col("text")))
    if "n_chars" in names:
        put = put.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return put.select(*names)
