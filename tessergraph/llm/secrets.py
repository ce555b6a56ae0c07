"""Operator 2 [native]: secret scan with multipart credential linking.

Everything is DataFrame functions inside one projection: no Python, no shuffle, so the
plan is a scan, a project and a write at any size.

Base findings, leftmost and non-overlapping per kind: ``assign`` (a keyword, = or :, and
a value of 12 or more), ``access`` (an access-key id), ``hex`` (a run of 16 or more).

Linking.  A text is cut into scopes, blocks of lines between blank lines.  Weak parts are
account identifiers (``user=``, ``client_id:``, e-mail addresses), weak secrets (an
assigned value of 6 to 11, a base64-like run of 32 or more with upper, lower and digit) and
endpoints (URLs with a host, host:port, IPv4 addresses).  A scope's weak parts are
reported only if complementary parts share the scope: a secret, strong or weak, with an
identifier (strong or weak) or an endpoint.  The interval join of parts
to scopes is by containment, done inside the row, scope by scope, so no pairs are formed.

Cost.  Matches, gaps and scopes of a text are each found once and bound to a name (``bound``); places are running
sums over them in blocks, n * sqrt(n) additions for n matches.  Redaction takes what stays from blocks of ``LETTERS`` code
points, so a piece costs its own length and a block, wherever it lies.

Defined cases.  A null text counts as empty: no spans, the hash of the empty string.
Rows keep their order of columns; null or repeated ids and repeated rows are rows of
their own.  An empty table gives an empty result.  Texts of any length are scanned
whole; positions are code points, end exclusive.  ``scan`` replaces a column ``secrets``; ``redact`` keeps every other column,
whatever its name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: The method's own kinds; values are the whole match.
IDENTIFIER = r"""(?i:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+_.@-]{3,}|(?<![A-Za-z0-9_.+-])[A-Za-z0-9_.+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"""
OPAQUE = r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[0-9])[A-Za-z0-9+/]{32,}={0,2}"
ENDPOINT = r"(?i:https?|wss?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9.-]+(?::[0-9]+)?|(?<![0-9A-Za-z_.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?::[0-9]+)?(?![0-9A-Za-z_])"
#: A hex run that is long enough, and has a letter, to be the secret part.
SECRET_HEX = r"(?<![0-9a-f])(?=[0-9]*+[a-f])[0-9a-f]{20,}"
SCOPE = r"\n[ \t\r]*\n"
KINDS = ("assign", "access", "hex", "identifier", "weak_assign", "opaque", "endpoint")
PART = "array<struct<start:int,k:int,end:int>>"
#: Code points of a block that redaction cuts from.
LETTERS = 512


def _none() -> Column:
    return F.array().cast(PART)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being computed once for each row however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, zero: Column, add: Callable[[Column, Column], Column]) -> Column:
    """What the elements before each one add up to, in blocks, so that n elements cost n * sqrt(n) steps."""
    side = F.ceil(F.sqrt(F.size(values).cast("double"))).cast("int")
    total = lambda xs: F.aggregate(xs, zero, add)
    before = lambda xs: F.transform(xs, lambda _, i: total(F.slice(xs, F.lit(1), i)))

    def placed(blocks: Column) -> Column:
        sums = bound(F.transform(blocks, total), before)
        return F.flatten(F.zip_with(blocks, sums, lambda b, s: F.transform(before(b), lambda x: add(x, s))))

    return bound(F.transform(F.sequence(F.lit(0), side - 1), lambda b: F.slice(values, b * side + 1, side)), placed)


def running(values: Column, zero: Column | None = None, add: Callable[[Column, Column], Column] = lambda a, x: a + x) -> Column:
    """Sums, or what else ``add`` makes from ``zero`` on, before each element; of no elements none."""
    zero = F.lit(0) if zero is None else zero
    return bound(values, lambda v: F.when(F.size(v) > 0, _running(v, zero, add)).otherwise(F.array().cast("array<int>")))


def matches(text: Column, pattern: str, k: int, keep=None) -> Column:
    """(start, k, end) of a pattern's matches; keep(match) drops failing ones afterwards."""

    def placed(x: Column) -> Column:
        both = F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["found"])), x["found"], lambda g, m: F.struct(g.alias("g"), F.length(m).alias("n"), m.alias("m")))
        spans = bound(both, lambda b: F.zip_with(running(F.transform(b, lambda e: e["g"] + e["n"])), b, lambda at, e: F.struct((at + e["g"]).alias("start"), (at + e["g"] + e["n"]).alias("end"), e["m"].alias("m"))))
        kept = F.filter(spans, lambda e: keep(e["m"])) if keep else spans
        return F.transform(kept, lambda e: F.struct(e["start"].alias("start"), F.lit(k).alias("k"), e["end"].alias("end"))).cast(PART)

    found = F.struct(F.transform(F.split(text, pattern, -1), lambda g: F.length(g)).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(F.regexp_like(text, F.lit(pattern)), bound(found, placed)).otherwise(_none())


def _value(m: Column) -> Column:
    return F.length(F.regexp_extract(m, ASSIGN, 2))


def strong(text: Column) -> tuple[Column, Column, Column]:
    return matches(text, ASSIGN, 0, lambda m: _value(m) >= 12), matches(text, ACCESS, 1), matches(text, HEX, 2)


def _any(text: Column, *patterns: str) -> Column:
    found = F.regexp_like(text, F.lit(patterns[0]))
    for p in patterns[1:]:
        found = found | F.regexp_like(text, F.lit(p))
    return found


def _linked(scope: Column) -> Column:
    """A scope's weak parts, or none if complementary parts don't meet in it."""

    def complete(parts: Column) -> Column:
        # a run of digits alone, such as a card number, is no secret
        strong_value = F.exists(F.regexp_extract_all(scope, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 12)
        has_secret = F.exists(parts, lambda p: p["k"].isin(4, 5)) | _any(scope, SECRET_HEX) | strong_value
        has_other = F.exists(parts, lambda p: p["k"].isin(3, 6)) | _any(scope, ACCESS)
        return F.when(has_secret & has_other, parts).otherwise(_none())

    weak_assigned = matches(scope, ASSIGN, 4, lambda m: _value(m).between(6, 11))
    parts = F.concat(matches(scope, IDENTIFIER, 3), weak_assigned, matches(scope, OPAQUE, 5), matches(scope, ENDPOINT, 6))
    return F.when(_any(scope, ASSIGN, OPAQUE, SECRET_HEX) & _any(scope, ACCESS, IDENTIFIER, ENDPOINT), bound(parts, complete)).otherwise(_none())


def weak(text: Column) -> Column:
    """Weak parts of complete scopes, at their places in the whole text."""

    def placed(x: Column) -> Column:
        sizes = F.zip_with(F.transform(x["scopes"], lambda s: F.length(s)), x["gaps"], lambda n, g: n + F.coalesce(F.length(g), F.lit(0)))
        return F.flatten(F.zip_with(F.transform(x["scopes"], _linked), running(sizes), lambda ps, at: F.transform(ps, lambda p: F.struct((p["start"] + at).alias("start"), p["k"].alias("k"), (p["end"] + at).alias("end"))))).cast(PART)

    cut = F.struct(F.split(text, SCOPE, -1).alias("scopes"), F.regexp_extract_all(text, F.lit(SCOPE), F.lit(0)).alias("gaps"))
    some = _any(text, ASSIGN, OPAQUE, SECRET_HEX) & _any(text, ACCESS, IDENTIFIER, ENDPOINT)
    return F.when(some, bound(cut, placed)).otherwise(_none())


def shown(parts: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(parts, lambda p: F.concat_ws(":", F.element_at(kinds, p["k"] + 1), p["start"].cast("string"), p["end"].cast("string"))), ",")


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with a column ``secrets``: struct of the arrays assign, access, hex, and of all spans, by start, then kind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    a, b, c = strong(text)
    return df.withColumn("secrets", F.struct(a.alias("assign"), b.alias("access"), c.alias("hex"), weak(text).alias("weak")))


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from start to end of a text that is cut into blocks of LETTERS."""
    a, b = F.floor(start / LETTERS).cast("int"), F.floor(end / LETTERS).cast("int")
    block = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
    within = F.substring(block(a), start % LETTERS + 1, end - start)
    across = F.concat(F.substring(block(a), start % LETTERS + 1, F.lit(LETTERS)), F.array_join(F.slice(blocks, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.substring(block(b), F.lit(1), end % LETTERS))
    return F.when(end <= start, F.lit("")).when(a == b, within).otherwise(across)


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """The text with the mark for every run of overlapping or touching spans, which are sorted by start."""

    def joined(x: Column) -> Column:
        # fresh spans begin a run: no earlier one reaches them; a run ends where those before the next fresh one reach
        fresh = F.filter(F.zip_with(x["spans"], x["reach"], lambda p, r: F.struct(p["start"].alias("start"), r.alias("reach"))), lambda p: p["start"] > p["reach"])
        last = F.array_max(F.transform(x["spans"], lambda p: p["end"]))

        def pieces(f: Column) -> Column:
            gaps = F.transform(f, lambda p, i: _between(x["blocks"], F.when(i == 0, F.lit(0)).otherwise(p["reach"]), p["start"]))
            return F.concat(F.array_join(F.transform(gaps, lambda g: F.concat(g, F.lit(mark))), ""), _between(x["blocks"], last, F.length(text)))

        return bound(fresh, pieces)

    reach = running(F.transform(spans, lambda p: p["end"]), F.lit(-1), lambda a, e: F.greatest(a, e))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{LETTERS}}}"), F.lit(0))
    return bound(F.struct(spans.alias("spans"), reach.alias("reach"), blocks.alias("blocks")), joined)


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with every span replaced by the mark; overlapping and touching spans become one. Nulls stay null."""
    text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    a, b, c = strong(text)
    found = df.select(F.struct("*").alias("row")).withColumn("spans", F.array_sort(F.concat(a, b, c, weak(text))))
    new = F.when(F.size("spans") > 0, bound(F.col("spans"), lambda spans: redacted(text, spans, mark))).otherwise(F.col("row")[text_col])
    return found.select(*[(new if x == text_col else F.col("row")[x]).alias(x) for x in df.columns])


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    s = F.col("secrets")
    base = F.array_sort(F.concat(s["assign"], s["access"], s["hex"]))
    return scan(docs.select("doc_id", "text")).select(
        "doc_id",
        F.size(s["assign"]).cast("long").alias("n_assign"),
        F.size(s["access"]).cast("long").alias("n_access"),
        F.size(s["hex"]).cast("long").alias("n_hex"),
        F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"),
        shown(F.array_sort(F.concat(base, s["weak"]))).alias("spans"),
    )
