"""Secret scans in DataFrame functions: patterns, and sliding-window Shannon entropy of candidate strings."""

from __future__ import annotations

import math
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, in the order of their kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIN_VALUE = 12


class CharClass(NamedTuple):
    """A class of characters, the least length of its candidate strings (the window) and the entropy that marks a window."""

    kind: str
    alphabet: str
    window: int
    bits: float

    @property
    def pattern(self) -> str:
        """Candidates: runs of the class, cut where a part of them (between ``/ _ -``) holds a word of examples."""
        inner = "".join(c for c in self.alphabet if c not in PARTS)
        part = f"(?<![{inner}])(?![{inner}]*(?i:{WORDS}))[{inner}]"
        ends = "".join(c for c in PARTS if c in self.alphabet)
        return f"(?=[{inner}{ends}]{{{self.window}}})(?:{part}++|[{ends}])++" if ends else f"{part}{{{self.window},}}"


#: What parts a candidate, and words of parts that are no secrets.
PARTS, WORDS = "/_-", "example|sample|dummy|placeholder"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Windows of one class of characters; each threshold is about 0.75 of the most that its window can hold.
CLASSES = (
    CharClass("entropy_hex", DIGITS + "abcdefABCDEF", 20, 3.0),
    CharClass("entropy_upper", DIGITS + UPPER, 16, 3.0),
    CharClass("entropy_base64", DIGITS + LOWER + UPPER + "+/_-", 24, 3.9),
)

# Spans that are no secrets (patterns of the whole span): numbers, UUIDs, digests of the empty input.
ALLOW = (
    r"[0-9]*",
    r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    r"(?i)d41d8cd98f00b204e9800998ecf8427e",
    r"(?i)da39a3ee5e6b4b0d3255bfef95601890afd80709",
    r"(?i)e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
)


def wordy(span: Column) -> Column:
    """No digit, and capitals are less than a third or more than two thirds: words, names in camel case, constants."""
    capitals, n = 3 * F.regexp_count(span, F.lit("[A-Z]")), F.char_length(span)
    return ~span.rlike("[0-9]") & ((capitals < n) | (capitals > 2 * n))


SPAN = "struct<s:int,e:int,k:int,kind:string>"
CHUNK = 256


def _running(parts: Column, found: Column, keep, to_span) -> Column:
    """Spans of ``found`` from the lengths of the ``parts`` between them, in code points.

    Runs over chunks of matches, so that a text of n matches costs about n * CHUNK copies, not n * n.
    """

    def step(acc: Column, i: Column) -> Column:
        start = acc.pos + F.char_length(F.get(parts, i))
        end = start + F.char_length(F.get(found, i))
        return F.struct(end.alias("pos"), F.when(keep(i), F.concat(acc.out, F.array(to_span(start, end, i)))).otherwise(acc.out).alias("out"))

    none = F.array().cast(f"array<{SPAN}>")
    begin = lambda pos: F.struct(pos.alias("pos"), none.alias("out"))
    n = F.size(found)

    def chunk(acc: Column, c: Column) -> Column:
        inner = F.aggregate(F.sequence(c * CHUNK, F.least(c * CHUNK + CHUNK, n) - 1), begin(acc.pos), step)
        return F.struct(inner.pos.alias("pos"), F.concat(acc.out, inner.out).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), begin(F.lit(0)), chunk, lambda acc: acc.out)


def _spans(df: DataFrame, text: str, pattern: str, out: str, keep, to_span) -> DataFrame:
    """Add column ``out``: the spans of all leftmost matches of ``pattern`` for which ``keep`` holds."""
    hit = F.col(text).rlike(pattern)
    found, value, parts = (f"{out}_{x}" for x in ("m", "v", "p"))
    df = df.withColumns({found: F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))})
    df = df.withColumns({
        value: F.when(F.col(found).isNotNull(), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))) if pattern == ASSIGN else F.lit(None).cast("array<string>"),
        parts: F.when(F.col(found).isNotNull(), F.split(text, pattern, -1)),
    })
    at = lambda name: lambda i: F.get(F.col(name), i)
    spans = F.when(F.size(found) > 0, _running(F.col(parts), F.col(found), lambda i: keep(at(found)(i), at(value)(i)), lambda s, e, i: to_span(s, e, at(found)(i))))
    return df.withColumn(out, F.coalesce(spans, F.array().cast(f"array<{SPAN}>"))).drop(found, value, parts)


def windows(candidate: Column, c: CharClass) -> Column:
    """First start and last end (offsets, end exclusive) of windows of more than ``c.bits``; null if none.

    One pass: a step adds the entering character to its count and takes the leaving one off, and the sum
    of n log2 n over the counts changes by two tabulated differences.
    """
    w = c.window
    alphabet = c.alphabet.replace("ABCDEF", "") if c.kind == "entropy_hex" else c.alphabet
    text = F.lower(candidate) if c.kind == "entropy_hex" else candidate
    codes = F.transform(F.regexp_extract_all(text, F.lit("."), F.lit(0)), lambda x: F.position(x, F.lit(alphabet)) - 1)
    table = F.array(*[F.lit(float(n * math.log2(n)) if n else 0.0) for n in range(w + 2)])
    most = math.log2(w)

    def both(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            come, gone = F.get(codes, i), F.when(i >= w, F.get(codes, i - w)).otherwise(F.lit(-1))
            n_in = F.get(acc.n, come)
            n_out = F.when(gone >= 0, F.get(acc.n, gone) + F.when(gone == come, 1).otherwise(0)).otherwise(F.lit(1))
            total = acc.s + F.get(table, n_in + 1) - F.get(table, n_in) + F.when(gone >= 0, F.get(table, n_out - 1) - F.get(table, n_out)).otherwise(F.lit(0.0))
            counts = F.transform(acc.n, lambda v, k: v + F.when(k == come, 1).otherwise(0) - F.when(k == gone, 1).otherwise(0))
            high = (i >= w - 1) & (F.lit(most) - total / w > c.bits)
            return F.struct(counts.alias("n"), total.alias("s"), F.coalesce(acc.first, F.when(high, i - (w - 1))).alias("first"), F.coalesce(F.when(high, i + 1), acc.last).alias("last"))

        zero = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("n"), F.lit(0.0).alias("s"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))

    return F.element_at(F.transform(F.array(codes), both), 1)


def scan(docs: DataFrame, text_col: str = "text", out: str = "secrets", classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """Add ``out``: array of structs (s, e, k, kind), code points, end exclusive, by start and then kind.

    Kinds 0 to 2 are the base ones (assign, access, hex), further ones the classes whose candidate strings
    hold a window of high entropy; the span goes from the first such window to the end of the last. Parts of a run
    that hold a word of examples are left out (what stands beside them is not), spans that match the allow-list whole or
    consist of words are suppressed. Base spans are never suppressed. Null and
    empty text give an empty array, and an empty table gives an empty one. A column named ``out`` is replaced, all
    others stay as they are; repeated rows are judged one by one, texts of any length whole. Everything is row-wise: no shuffle, whatever the distribution of sources or copies.
    """
    own = f"_{uuid.uuid4().hex}"  # a name that no column has
    text, base = f"{own}_text", ["assign", "access", "hex"]
    df = docs.withColumn(text, F.coalesce(docs[text_col].cast("string"), F.lit("")))
    span = lambda k, kind: lambda s, e, m: F.struct(s.alias("s"), e.alias("e"), F.lit(k).alias("k"), F.lit(kind).alias("kind"))
    cols = []
    for k, (kind, pattern) in enumerate(zip(base, (ASSIGN, ACCESS, HEX), strict=True)):
        cols.append(f"{own}_{k}")
        df = _spans(df, text, pattern, cols[-1], lambda m, v, kind=kind: F.char_length(v) >= MIN_VALUE if kind == "assign" else F.lit(True), span(k, kind))
    for k, c in enumerate(classes, len(base)):
        cols.append(f"{own}_{k}")
        listed_ = lambda m: m.rlike("^(?:" + "|".join(f"(?:{a})" for a in allow) + ")$") if allow else F.lit(False)

        def narrowed(s: Column, e: Column, m: Column, k: int = k, c: CharClass = c, listed_=listed_) -> Column:
            """From the first high window to the end of the last; null without one, and where that span is no secret."""

            def span_of(x: Column) -> Column:
                found = F.substring(m, x["first"] + 1, x["last"] - x["first"])
                return F.when(x["first"].isNotNull() & ~listed_(found) & ~wordy(found), F.struct((s + x["first"]).alias("s"), (s + x["last"]).alias("e"), F.lit(k).alias("k"), F.lit(c.kind).alias("kind")))

            return F.element_at(F.transform(F.array(windows(m, c)), span_of), 1)

        df = _spans(df, text, c.pattern, cols[-1], lambda m, v, c=c: F.char_length(m) >= c.window, narrowed)
        df = df.withColumn(cols[-1], F.filter(cols[-1], lambda x: x.isNotNull()))
    return df.withColumn(out, F.transform(F.array_sort(F.transform(F.concat(*cols), lambda x: F.struct(x.s.alias("s"), x.k.alias("k"), x.e.alias("e"), x.kind.alias("kind")))), lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), x.k.alias("k"), x.kind.alias("kind")))).drop(text, *cols)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.s, x.e)), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace every span that ``scan`` finds (overlapping ones as one) by ``mark``; the columns stay."""
    own = f"_{uuid.uuid4().hex}"
    found = scan(docs, text_col, own)
    text = F.col(text_col)

    def step(acc: Column, x: Column) -> Column:
        lead = F.when(x.s >= acc.pos, F.concat(F.substring(text, acc.pos + 1, x.s - acc.pos), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc.pos, x.e).alias("pos"), F.concat(acc.out, F.array(lead)).alias("out"))

    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(own, zero, step, lambda a: F.concat(F.array_join(a.out, ""), F.substring(text, a.pos + 1, F.char_length(text))))
    return found.withColumn(text_col, F.when(F.size(own) > 0, clean).otherwise(text)).drop(own)
