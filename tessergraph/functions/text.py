"""Text: chunking, punctuation repair, parsing of model replies, prices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values, in the order in which they are tried.
SEPARATORS = (". ", "? ", "! ", "\n\n", "\n", " ")
#: Fixed values. Dollars per 1,000 tokens: model, input, output.
PRICES = (("gpt-4o-mini", 0.00015, 0.0006), ("gpt-4o", 0.0025, 0.01), ("o3-mini", 0.0011, 0.0022))
#: Fixed values. The texts that an item can be chunked by.
GETTERS = ("full_text", "clean_full_text", "sections", "clean_sections")


def word_count(text: str) -> int:
    return len(text.split())


def _pieces(text: str, size: int, length: Callable[[str], int], separators: tuple[str, ...]) -> list[str]:
    """Parts of at most ``size`` where a separator allows it; a separator stays with what follows it."""
    if length(text) <= size or not separators:
        return [text] if text else []
    at = next((i for i, s in enumerate(separators) if s in text), None)
    if at is None:
        return [text]
    sep, rest = separators[at], separators[at + 1 :]
    first, *others = text.split(sep)
    out: list[str] = []
    for part in [first, *(sep + x for x in others)]:
        if part:
            out += _pieces(part, size, length, rest) if length(part) > size else [part]
    return out


def fixed_chunks(text: str | None, size: int = 1000, overlap: int = 100, length: Callable[[str], int] = word_count) -> list[str]:
    """Greedy merge of a text's pieces into chunks of at most ``size``, the tail of each, up to ``overlap``, repeated in the next."""
    if not text:
        return []
    chunks: list[str] = []
    held: list[tuple[str, int]] = []
    total = 0
    for piece in _pieces(text, size, length, SEPARATORS):
        n = length(piece)
        if held and total + n > size:
            chunks.append("".join(p for p, _ in held).strip())
            while held and (total > overlap or total + n > size):
                total -= held.pop(0)[1]
        held.append((piece, n))
        total += n
    if held:
        chunks.append("".join(p for p, _ in held).strip())
    return repaired([c for c in chunks if c])


def repaired(chunks: list[str]) -> list[str]:
    """A leading ., ? or ! belongs to the chunk before."""
    out = list(chunks)
    for i in range(1, len(out)):
        if out[i][:1] in (".", "?", "!"):
            out[i - 1] += out[i][0]
            out[i] = out[i][1:].lstrip()
    return out


def repair(chunks: Column) -> Column:
    """The same on an array column: each chunk takes its successor's mark and gives its own away."""
    mark = lambda x: F.regexp_extract(x, r"^[.?!]", 0)

    def one(x: Column, i: Column) -> Column:
        own = F.when((i > 0) & (mark(x) != ""), F.ltrim(F.substring(x, 2, 1_000_000_000))).otherwise(x)
        return F.concat(own, F.coalesce(mark(F.get(chunks, i + 1)), F.lit("")))

    return F.transform(chunks, one)


def chunk_fixed(items: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 100, length: Callable[[str], int] = word_count) -> DataFrame:
    """(item_id, pos, chunk_id, text): chunk ids are the item's id and a running number.

    A worker holds the batch that Spark sends it (64 MB or so) and the chunks of one text, or of several short ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((item, pos, chunk) for batch in batches for item, t in scalars(batch) for pos, chunk in enumerate(fixed_chunks(t, size, overlap, length)))
        return flushed(rows, ("item_id", "pos", "text"), ("string", "int32", "string"))

    found = items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text")).mapInArrow(run, "item_id string, pos int, text string")
    return found.select("item_id", "pos", F.concat_ws("_", "item_id", F.col("pos").cast("string")).alias("chunk_id"), "text")


def scalars(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The batch's rows, as Python values one at a time."""
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in batch.columns)


def flushed(rows: Iterator[tuple], names: tuple[str, ...], kinds: tuple[str, ...], characters: int = 1 << 20, most: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about so many characters, and of no more than ``most``."""

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], list(names))

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if size >= characters or len(held) >= most:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def chunk_arrays(items: DataFrame) -> DataFrame:
    """Chunks that are an array column already, such as sections, or array(text) for a single one."""
    rows = items.select("item_id", F.posexplode("chunks").alias("pos", "text"))
    return rows.select("item_id", "pos", F.concat_ws("_", "item_id", F.col("pos").cast("string")).alias("chunk_id"), "text")


def chosen_text(items: DataFrame, getter: str = "full_text", id_col: str = "item_id") -> DataFrame:
    """(item_id, chunks) by one of GETTERS: a text is one chunk, a column of sections is as many."""
    if getter not in GETTERS:
        raise ValueError(f"unknown text {getter!r}; known: {', '.join(GETTERS)}")
    own = F.col(getter)
    own = own if getter.endswith("sections") else F.when(own.isNotNull(), F.array(own))
    return items.select(F.col(id_col).cast("string").alias("item_id"), own.alias("chunks"))


#: Fixed value: how byte-level vocabularies cut a text before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counter(ranks_path: str, pattern: str = SPLIT) -> Callable[[str], int]:
    """A length function that counts the tokens of a rank file's vocabulary; it travels to the executors as the file's bytes."""
    import base64

    with open(ranks_path, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f.read().splitlines() if x)}
    made: list = []

    def count(text: str) -> int:
        if not made:
            import tiktoken

            made.append(tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}))
        return len(made[0].encode_ordinary(text))

    return count


def sections(text: Column) -> Column:
    """Non-empty blocks between blank lines."""
    return F.filter(F.transform(F.split(text, r"\n[ \t]*\n"), lambda x: F.trim(x)), lambda x: x != "")


def rating(reply: Column) -> tuple[Column, Column]:
    """(score, justification): the number after rating=, and the reply without that."""
    return F.nullif(F.regexp_extract(reply, r"rating=(\d+)", 1), F.lit("")).try_cast("int"), F.trim(F.regexp_replace(reply, r"rating=\d+", ""))


def unit_score(reply: Column) -> Column:
    """The first number of a reply, held to 0..1; 0 without one."""
    found = F.nullif(F.regexp_extract(reply, r"(\d+\.\d+|\d+)", 1), F.lit(""))
    return F.least(F.greatest(F.coalesce(found.try_cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def statement(reply: Column) -> Column:
    return F.trim(F.regexp_extract(reply, r"(?s)Hypothesis Statement:(.+?)$", 1))


def title(reply: Column, default: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(reply, r"(?m)^\W*Title:\W*(.+?)\W*$", 1)), F.lit("")), default)


def references(reply: Column) -> Column:
    """Lines after References: that begin with a digit or a dash."""
    tail = F.element_at(F.split(reply, "References:", 2), -1)
    lines = F.filter(F.transform(F.split(tail, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^(\d|- )"))
    return F.when(F.contains(reply, F.lit("References:")), lines).otherwise(F.array().cast("array<string>"))


def decision(reply: Column) -> Column:
    return F.when(F.contains(reply, F.lit("ACCEPT")), F.lit("ACCEPT")).otherwise(F.lit("REVISE"))


def message_cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Dollars, to four places; 0 for a model without a price. What follows -20 in a model's name is its date."""
    cost, name = F.lit(0.0), F.substring_index(model, "-20", 1)
    for known, price_in, price_out in PRICES:
        cost = F.when(name == known, F.round(tokens_in / 1000 * price_in + tokens_out / 1000 * price_out, 4)).otherwise(cost)
    return cost
