"""Sources: lines, blocks, chunks, byte sniffing and decoding.

Order is data: every row carries ``source_id`` and ``line_no`` (from 1), and byte offsets count from 0.
"""

from __future__ import annotations

import json
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import scan

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SNIFF = 8192


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """ING-01: whole files with their metadata; text decoding is a separate step."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(F.col("path").alias("source_id"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def strings(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """ING-02: in-memory texts."""
    return spark.createDataFrame(list(texts.items()), "source_id string, text string")


def line_array(text: Column) -> Column:
    """A text's lines without their ends: one trailing empty element and one trailing carriage return a line go."""
    parts = F.split(text, "\n")
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(parts, lambda x: F.regexp_replace(x, r"\r\z", ""))


def lines(df: DataFrame, source: str, text: str = "text") -> DataFrame:
    """ING-05: (source_id, line_no, line). No shuffle."""
    return df.select(F.col(source).alias("source_id"), F.posexplode(line_array(F.coalesce(F.col(text), F.lit(""))))).select(
        "source_id", (F.col("pos") + 1).cast("bigint").alias("line_no"), F.col("col").alias("line"))


def lines_with_offsets(df: DataFrame, source: str, text: str = "text") -> DataFrame:
    """ING-05 with the byte offset of each line in its source."""
    parts = df.select(F.col(source).alias("source_id"), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("p"))
    raw = parts.select("source_id", (F.size("p") - 1).alias("end"), F.posexplode("p")).where((F.col("pos") < F.col("end")) | (F.col("col") != ""))
    size = F.octet_length("col") + 1
    out = scan.running_sum(raw, size, "through", ["source_id"], "pos")
    return out.select("source_id", (F.col("pos") + 1).cast("bigint").alias("line_no"), (F.col("through") - size).cast("bigint").alias("offset"), F.regexp_replace("col", r"\r\z", "").alias("line"))


def blocks(df: DataFrame, source: str, size: int, text: str = "text") -> DataFrame:
    """ING-06: blocks of at most ``size`` characters; a size of zero is an error."""
    if size <= 0:
        raise ValueError("block size must be positive")
    n = F.length(text)
    return df.where(n > 0).select(F.col(source).alias("source_id"), F.posexplode(F.transform(F.sequence(F.lit(1), n, F.lit(size)), lambda i: F.substring(F.col(text), i, F.lit(size))))).select(
        "source_id", F.col("pos").cast("bigint").alias("block_no"), F.col("col").alias("block"))


def is_anchor(line: Column) -> Column:
    """A line before which a text may be cut: blank, beginning with a digit or ``[``, or not indented."""
    return (F.trim(line) == "") | line.rlike(r"^[0-9\[]") | ~line.rlike(r"^[ \t]")


# The least and the greatest size of a chunk.
MIN_CHUNK, MAX_CHUNK = 256 * 1024, 5 * 1024 * 1024


def chunk_target(total: int, workers: int) -> int:
    """ING-07: a worker's share of the bytes, within the bounds; 0 for nothing."""
    return min(max(total // max(workers, 1), MIN_CHUNK), MAX_CHUNK) if total else 0


def chunks(df: DataFrame, target: int) -> DataFrame:
    """ING-07: (source_id, line_no, line) -> chunk_no, so that no indented continuation is cut from its head.

    A chunk ends at the first anchor after each multiple of ``target`` bytes. Anchors own the lines up to the next one,
    so that the running sums go over records and not over characters."""
    size = F.octet_length("line") + 1
    sums = scan.running_sum(df, size, "_through", ["source_id"])
    heads = scan.forward_fill(sums, F.when(is_anchor(F.col("line")), F.col("_through") - size), "_head", ["source_id"])
    return heads.withColumn("chunk_no", F.floor(F.coalesce("_head", F.lit(0)) / target).cast("bigint")).drop("_through", "_head")


def is_binary(data: Column) -> Column:
    """ING-08: a NUL in the first 8192 bytes."""
    return F.contains(F.hex(F.substring(data, 1, SNIFF)), F.lit("00")) & F.regexp(F.hex(F.substring(data, 1, SNIFF)), F.lit("^(..)*?00"))


def bom(data: Column) -> Column:
    """ING-09: the byte order mark; the four-byte ones are tested first."""
    h = F.hex(F.substring(data, 1, 4))
    return (
        F.when(h == "FFFE0000", "utf-32le").when(h == "0000FEFF", "utf-32be").when(h.startswith("EFBBBF"), "utf-8")
        .when(h.startswith("FFFE"), "utf-16le").when(h.startswith("FEFF"), "utf-16be")
    )


#: Encodings that are tried when a text is neither Unicode nor marked, most specific first.
CANDIDATES = ("gb18030", "shift_jis", "euc_kr", "big5", "cp1251", "cp1252")


def decode_bytes(data: bytes | None) -> tuple[str, str]:
    """ING-10: (text, encoding): marked Unicode, UTF-8, UTF-16 by its pattern of NULs, else the candidate with the best score."""
    data = bytes(data or b"")
    for mark, name in ((b"\xff\xfe\0\0", "utf-32-le"), (b"\0\0\xfe\xff", "utf-32-be"), (b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark):].decode(name, "replace"), name
    head = data[:SNIFF]
    if len(head) >= 4:
        even, odd = head[0::2].count(0), head[1::2].count(0)
        if odd > 0.3 * len(head) / 2 and even < 0.05 * len(head):
            return data.decode("utf-16-le", "replace"), "utf-16-le"
        if even > 0.3 * len(head) / 2 and odd < 0.05 * len(head):
            return data.decode("utf-16-be", "replace"), "utf-16-be"
    try:
        return data.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        pass
    best: tuple[float, str, str] | None = None
    for rank, name in enumerate(CANDIDATES):
        try:
            text = data.decode(name)
        except UnicodeDecodeError:
            continue
        score = _plausible(text) - 0.01 * rank
        if best is None or score > best[0]:
            best = (score, text, name)
    return (best[1], best[2]) if best else (data.decode("utf-8", "replace"), "lossy")


def _plausible(text: str) -> float:
    """The share of characters that running text has: letters of one script, digits, blanks and usual signs."""
    if not text:
        return 0.0
    good = sum(c.isalnum() or c in " \t\r\n.,;:!?-_()[]{}'\"/\\=<>|+*&%#@" or "　" <= c <= "〿" or "＀" <= c <= "￯" for c in text)
    odd = sum("\x80" <= c <= "\x9f" or "" <= c <= "" or c == "�" or "｡" <= c <= "ﾟ" for c in text)
    common = sum("一" <= c <= "龥" for c in text)
    # a letter of another script inside a Latin word is a sign of the wrong code page
    foreign = sum(a.isascii() and a.isalpha() and b.isalpha() and b > "\u024f" or b.isascii() and b.isalpha() and a.isalpha() and a > "\u024f" for a, b in zip(text, text[1:], strict=False))
    return (good + 0.2 * common - 2 * odd - 2 * foreign) / len(text)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType())]))
def decode(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode_bytes(x) for x in data], columns=["text", "encoding"])


def binary_ratios(data: bytes | None) -> bool:
    """ING-11: NULs from 20 % or control characters from 22 % of the first 8192 bytes; UTF-16 shapes with 30 % NULs are text."""
    head = bytes(data or b"")[:SNIFF]
    if not head:
        return False
    nul = head.count(0)
    control = sum(b < 32 and b not in (9, 10, 13) and b != 0 for b in head)
    if nul >= 0.3 * len(head):
        even, odd = head[0::2].count(0), head[1::2].count(0)
        if min(even, odd) < 0.05 * len(head) and max(even, odd) > 0.3 * len(head) / 2:
            return False
    return nul >= 0.20 * len(head) or control >= 0.22 * len(head)


@F.pandas_udf(T.BooleanType())
def is_probable_binary(data: pd.Series) -> pd.Series:
    return data.map(binary_ratios)


#: Characters that UTF-8 read in a one-byte code page leaves behind.
MOJIBAKE = "[ÃÂâ€™œžÐÑåæçèéäïð锟斤拷]"
MARKERS = "Ã|Â|â€|ï¿½|Ð|Ñ|锟|斤|拷|烫|鈥|銆|鏂|绋"


def is_mojibake(text: Column) -> Column:
    """ING-12: two replacement characters, or two markers that are 8 % of the characters or more."""
    n, lost, marks = F.length(text), F.regexp_count(text, F.lit("�")), F.regexp_count(text, F.lit(MARKERS))
    return (lost >= 2) | ((marks >= 2) & (marks / F.greatest(n, F.lit(1)) >= 0.08))


def repair_text(text: str | None) -> str:
    """ING-13: up to three passes of re-encoding, each taken only if it leaves fewer marks and loses nothing."""
    import re

    marks = lambda t: len(re.findall(MARKERS, t)) + 2 * t.count("�")
    text = text or ""
    for _ in range(3):
        best, gain = None, 0
        for name in ("cp1252", "gbk", "gb18030", "shift_jis", "latin-1"):
            try:
                other = text.encode(name).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            if marks(text) - marks(other) > gain:
                best, gain = other, marks(text) - marks(other)
        if best is None:
            return text
        text = best
    return text


@F.pandas_udf(T.StringType())
def repair(text: pd.Series) -> pd.Series:
    return text.map(repair_text)


def repair_confidence(before: Column, after: Column) -> Column:
    """ING-14: by the marks that went: five or more high, two or more medium, else low."""
    marks = lambda c: F.regexp_count(c, F.lit(MARKERS)) + 2 * F.regexp_count(c, F.lit("�"))
    gain = marks(before) - marks(after)
    return F.when(gain >= 5, "high").when(gain >= 2, "medium").otherwise("low")


def repair_files(spark: SparkSession, source: str, target: str, glob: str | None = None) -> DataFrame:
    """ING-15: decodes and repairs files under source; writes (source_id, encoding, confidence, text) to a new place."""
    df = files(spark, source, glob).where(~is_probable_binary("content")).withColumn("d", decode("content"))
    df = df.withColumn("text", repair(F.col("d.text"))).select("source_id", F.col("d.encoding").alias("encoding"), repair_confidence(F.col("d.text"), F.col("text")).alias("confidence"), "text")
    df.write.mode("errorifexists").parquet(target)
    return spark.read.parquet(target)


def session_commands_of(text: str | None) -> list[dict]:
    """ING-16: shell commands in an agent's session: a list of commands, messages with tool calls, or any nesting."""
    found: list[dict] = []

    def walk(x) -> None:
        if isinstance(x, dict):
            command = x.get("command") or x.get("cmd")
            if isinstance(command, str) and command.strip():
                found.append({"command": command, **{k: x[k] for k in ("input_bytes", "output_bytes", "input_tokens", "output_tokens") if isinstance(x.get(k), int)}, "timestamp": x.get("timestamp") if isinstance(x.get("timestamp"), str) else None})
            for v in x.values():
                walk(v)
        elif isinstance(x, list):
            for v in x:
                walk(v)

    for piece in [text] if text and text.lstrip()[:1] in "[{" else []:
        try:
            walk(json.loads(piece))
        except ValueError:
            for line in piece.splitlines():
                try:
                    walk(json.loads(line))
                except ValueError:
                    continue
    return found


COMMAND = T.StructType([T.StructField("command", T.StringType()), *[T.StructField(k, T.LongType()) for k in ("input_bytes", "output_bytes", "input_tokens", "output_tokens")], T.StructField("timestamp", T.StringType())])


def session_commands(df: DataFrame, source: str, text: str = "text") -> DataFrame:
    """One row for each command of a session."""

    @F.pandas_udf(T.ArrayType(COMMAND))
    def commands(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{f.name: c.get(f.name) for f in COMMAND.fields} for c in session_commands_of(t)])

    return df.select(F.col(source).alias("source_id"), F.posexplode(commands(text))).select("source_id", (F.col("pos") + 1).alias("seq"), "col.*")
