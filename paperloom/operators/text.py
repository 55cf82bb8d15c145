"""Text assembly, excerpts, caps and counts, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.constants import CHUNK, CHUNK_OVERLAP, EXCERPT, FILE_TYPES

_SPACE = "[ \\t\\n\\f\\r]+"


def excerpt(text: Column, size: int = EXCERPT) -> Column:
    """The whole text up to `size` characters, else its first and last half with dots between. Null stays null."""
    half = size // 2
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.left(text, F.lit(half)), F.lit("\n...\n"), F.right(text, F.lit(half))))


def words(text: Column) -> Column:
    """The words between white space; none for blank and null texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")


def statistics(text: Column) -> list[Column]:
    """chars, words and lines; null counts as empty: 0, 0 and 1."""
    full = F.coalesce(text, F.lit(""))
    return [F.length(full).alias("chars"), F.size(words(text)).alias("words"), (F.length(full) - F.length(F.translate(full, "\n", "")) + 1).alias("lines")]


def normalised(text: Column) -> Column:
    """Lower case with single spaces and none at the ends."""
    return F.lower(F.trim(F.regexp_replace(text, _SPACE, " ")))


def cap_words(text: Column, most: int) -> Column:
    """The first `most` words, joined by single spaces."""
    return F.array_join(F.slice(words(text), 1, most), " ")


def strides(text: Column, size: int = CHUNK, overlap: int = CHUNK_OVERLAP) -> Column:
    """ARRAY<STRING>: pieces of `size` characters that begin every size - overlap characters, to the end of the text.

    A text within `size` is one piece, the empty text none.
    """
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step).cast("int"))
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def assemble(pages: Column) -> Column:
    """Pages joined by blank lines, blank ones left out; with a heading that counts all pages if there are several."""
    kept = F.transform(pages, lambda p, i: F.struct(F.trim(F.regexp_replace(p, "^[ \\t\\n\\f\\r]+|[ \\t\\n\\f\\r]+$", "")).alias("text"), (i + 1).alias("no")))
    kept = F.filter(kept, lambda p: p["text"] != "")
    headed = F.transform(kept, lambda p: F.when(F.size(pages) > 1, F.concat(F.lit("--- Page/Section "), p["no"].cast("string"), F.lit(" ---\n"), p["text"])).otherwise(p["text"]))
    return F.array_join(headed, "\n\n")


def file_type(path: Column) -> Column:
    """Loader type by extension in any letter case; "unknown" for other paths."""
    extension = F.regexp_extract(F.lower(path), r"([.][^./]+)$", 1)
    table = F.create_map(*[F.lit(x) for pair in FILE_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension), F.lit("unknown"))


def exploded_strides(df: DataFrame, key: str, text: str, size: int = CHUNK, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """key, chunk_no, chunk of every text."""
    return df.select(F.col(key), F.posexplode(strides(F.col(text), size, overlap)).alias("chunk_no", "chunk"))


def lines_of_blocks(blocks: DataFrame, key: str) -> DataFrame:
    """key, text of recognised blocks (key, block_no, block_type, text): the LINE blocks that say something, in order, one a
    line. A page has a bounded number of blocks; keys without lines give the empty text."""
    line = F.when((F.col("block_type") == "LINE") & (F.col("text") != ""), F.struct("block_no", "text"))
    ordered = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["text"])
    return blocks.groupBy(key).agg(F.trim(F.array_join(ordered, "\n")).alias("text"))


def recognition_statistics(tokens: DataFrame, key: str) -> DataFrame:
    """key, word_count, avg_confidence of recognised tokens (key, text, conf): tokens that are not blank, and the mean
    confidence without -1, which stands for no text; 0 where there is none."""
    conf = F.avg(F.when(F.col("conf") != -1, F.col("conf")))
    return tokens.groupBy(key).agg(F.count_if(F.trim("text") != "").alias("word_count"), F.coalesce(conf, F.lit(0.0)).alias("avg_confidence"))
