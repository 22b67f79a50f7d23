"""Cutting documents into sections, symbols, line windows and bounded pieces."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import paths as px
from lodestone.functions import text as tx
from lodestone.session import small_batches

# Sizes and patterns.
KINDS = ("markdown_section", "code_symbol", "line_window")
WINDOW_LINES = 100
MAX_CHARS = 6000
OVERLAP_LINES = 8
#: Characters that a task holds before it hands its pieces over, about.
HELD = 1 << 22
BLANKS = " \t\n\r\x0b\x0c"
HEADING = r"^(#{1,6})\s+(.+?)\s*$"
SYMBOL_1 = r"^\s*(?:export\s+)?(?:async\s+)?(?:def|function|class|interface|type|fn)\s+([A-Za-z_]\w*)"
SYMBOL_2 = r"^\s*(?:public|private|protected|static|async|\s)*(?:[\w<>\[\],?]+\s+)+([A-Za-z_]\w*)\s*\([^;]*\)\s*(?:\{|:)"

CHUNK = ["chunk_index", "chunk_type", "heading_path", "symbol_name", "start_line", "end_line", "content"]


def numbered_lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, n, line): lines from 1."""
    return docs.select(key, F.posexplode(tx.lines(F.col(text))).alias("p", "line")).select(key, (F.col("p") + 1).alias("n"), "line")


def line_windows(docs: DataFrame, key: str, text: str = "text", size: int = WINDOW_LINES) -> DataFrame:
    """Blocks of `size` lines, cut inside one row's array: no shuffle. Empty text gives none."""
    rows = docs.select(key, tx.lines(F.col(text)).alias("all")).where(F.size("all") > 0)
    rows = rows.select(key, "all", F.posexplode(F.sequence(F.lit(1), F.size("all"), F.lit(size))).alias("chunk_index", "start_line"))
    block = F.slice("all", F.col("start_line"), F.lit(size))
    return rows.select(key, "chunk_index", F.lit(KINDS[2]).alias("chunk_type"), F.lit(None).cast("string").alias("heading_path"), F.lit(None).cast("string").alias("symbol_name"), "start_line", (F.col("start_line") + F.size(block) - 1).alias("end_line"), F.array_join(block, "\n").alias("content"))


def markdown_sections(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Sections that begin at headings, with the titles of their ancestors.

    A heading of level k is still open where it is the last of its level and no heading of a lower
    level came later; so six running values give every section's path.
    """
    rows = numbered_lines(docs, key, text).withColumn("level", F.char_length(F.regexp_extract("line", HEADING, 1)))
    rows = rows.withColumn("level", F.when(F.col("level") > 0, F.col("level"))).withColumn("title", F.when(F.col("level").isNotNull(), F.regexp_extract("line", HEADING, 2)))
    upto = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.count("level").over(upto))
    for k in range(1, 7):
        rows = rows.withColumn(f"_h{k}", F.last(F.when(F.col("level") == k, F.struct("n", "title")), ignorenulls=True).over(upto))
    at = lambda k: F.coalesce(F.col(f"_h{k}.n"), F.lit(0))
    open_ = [F.when((at(k) > 0) & (at(k) > (F.greatest(F.lit(-1), *[at(j) for j in range(1, k)]) if k > 1 else F.lit(0))), F.col(f"_h{k}.title")) for k in range(1, 7)]
    rows = rows.withColumn("path", F.array_join(F.array_compact(F.array(*open_)), " / "))
    parts = rows.groupBy(key, "section").agg(F.min("n").alias("start_line"), F.max("n").alias("end_line"), F.min_by("path", "n").alias("path"), F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    content = F.btrim(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit(BLANKS))
    parts = parts.withColumn("content", content).where(F.col("content") != "")
    index = F.row_number().over(Window.partitionBy(key).orderBy("section")) - 1
    return parts.select(key, index.alias("chunk_index"), F.lit(KINDS[0]).alias("chunk_type"), F.when(F.col("section") > 0, F.col("path")).alias("heading_path"), F.lit(None).cast("string").alias("symbol_name"), "start_line", "end_line", "content")


def symbol_of(line: Column) -> Column:
    first, second = (F.regexp_extract(line, "(?U)" + p, 1) for p in (SYMBOL_1, SYMBOL_2))
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")))


def code_symbols(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """A section from each symbol's line to the next; lines before the first are dropped.

    Without a symbol the whole text is one chunk called `file`; empty text gives one empty chunk.
    """
    lined = docs.select(key, F.when(F.size(tx.lines(F.col(text))) > 0, tx.lines(F.col(text))).otherwise(F.array(F.lit(""))).alias("all"))
    marks = F.filter(F.transform("all", lambda x, i: F.struct((i + 1).alias("n"), symbol_of(x).alias("s"))), lambda m: m["s"].isNotNull())
    whole = F.array(F.struct(F.lit(1).alias("n"), F.lit("file").alias("s")))
    rows = lined.withColumn("m", marks).withColumn("m", F.when(F.size("m") > 0, F.col("m")).otherwise(whole))
    nexts = F.concat(F.transform(F.slice("m", F.lit(2), F.size("m")), lambda x: x["n"]), F.array(F.size("all") + 1))
    rows = rows.select(key, "all", F.posexplode(F.arrays_zip(F.col("m"), nexts.alias("after"))).alias("chunk_index", "z"))
    start, end = F.col("z.m.n"), F.greatest(F.col("z.m.n"), F.col("z.after") - 1)
    return rows.select(key, "chunk_index", F.lit(KINDS[1]).alias("chunk_type"), F.lit(None).cast("string").alias("heading_path"), F.col("z.m.s").alias("symbol_name"), start.alias("start_line"), end.alias("end_line"), F.array_join(F.slice("all", start, end - start + 1), "\n").alias("content"))


def windows_of(lengths: list[int], max_chars: int = MAX_CHARS, overlap: int = OVERLAP_LINES, cascade: bool = True) -> list[tuple[int, int]]:
    """(first, past last) line of each bounded piece of lines with these lengths.

    A piece takes lines while their lengths plus one each stay within max_chars, but one at least;
    the next begins `overlap` lines before its end, but later than it. cascade: pieces go on until
    the beginning passes the end, which repeats short tails; without it the last line ends the list.
    """
    sums = [0]
    for n in lengths:
        sums.append(sums[-1] + n + 1)
    out, at = [], 0
    while at < len(lengths):
        end = max(at + 1, bisect_right(sums, sums[at] + max_chars) - 1)
        out.append((at, end))
        if end == len(lengths) and not cascade:
            break
        at = max(end - overlap, at + 1)
    return out


def split_long(chunks: DataFrame, keys: list[str], max_chars: int = MAX_CHARS, cascade: bool = True) -> DataFrame:
    """Chunks over max_chars in overlapping pieces: keys, piece, start_line, end_line, content.

    chunks: keys, start_line, content. Short chunks stay JVM-side; only long ones go to Python.
    """
    short = chunks.where(F.char_length("content") <= max_chars)
    short = short.select(*keys, F.lit(0).alias("piece"), "start_line", (F.col("start_line") + F.greatest(F.size(tx.lines(F.col("content"))), F.lit(1)) - 1).alias("end_line"), "content")
    schema = ", ".join(f"{k} {dict(chunks.dtypes)[k]}" for k in keys) + ", piece int, start_line int, end_line int, content string"

    def handed(batch: pa.RecordBatch, rows: list[int], pieces: list[tuple]) -> pa.RecordBatch:
        own = [batch.column(k).take(pa.array(rows, pa.int64())) for k in keys]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([*own, *[pa.array(c, k) for c, k in zip(zip(*pieces), kinds, strict=True)]], names=[*keys, "piece", "start_line", "end_line", "content"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pieces, held = [], [], 0
            for r in range(len(batch)):
                start, lines = batch.column("start_line")[r].as_py(), batch.column("content")[r].as_py().splitlines()
                for i, (a, b) in enumerate(windows_of([len(x) for x in lines], max_chars, OVERLAP_LINES, cascade)):
                    rows.append(r)
                    pieces.append((i, start + a, start + b - 1, "\n".join(lines[a:b])))
                    held += len(pieces[-1][3])
                    if held >= HELD:
                        yield handed(batch, rows, pieces)
                        rows, pieces, held = [], [], 0
            if rows:
                yield handed(batch, rows, pieces)

    small_batches(chunks.sparkSession)
    long_ = chunks.where(F.char_length("content") > max_chars).select(*keys, F.col("start_line").cast("int").alias("start_line"), "content")
    return short.unionByName(long_.mapInArrow(cut, schema))


def chunk_documents(docs: DataFrame, key: str, path: str = "path", text: str = "text") -> DataFrame:
    """Each document by its suffix: Markdown sections, code symbols (both bounded) or line windows.

    language is a code file's suffix, metadata what is known of the symbol. A null path counts as one without suffix.
    """
    kind = F.coalesce(px.suffix(F.col(path)), F.lit(""))
    marked = docs.select(key, F.col(text).alias("text"), kind.alias("suffix"))
    is_md, is_code = F.col("suffix").isin(px.MARKDOWN), F.col("suffix").isin([s for s in px.SUPPORTED if s not in px.NOT_CODE])
    parts = markdown_sections(marked.where(is_md), key).unionByName(code_symbols(marked.where(is_code), key))
    names = parts.select(key, "chunk_index", "chunk_type", "heading_path", "symbol_name")
    bounded = split_long(parts.select(key, "chunk_index", "start_line", "content"), [key, "chunk_index"]).join(names, [key, "chunk_index"])
    order = Window.partitionBy(key).orderBy("chunk_index", "piece")
    bounded = bounded.withColumn("chunk_index", F.row_number().over(order) - 1).select(key, *CHUNK)
    out = bounded.unionByName(line_windows(marked.where(~is_md & ~is_code), key).select(key, *CHUNK))
    code = F.col("chunk_type") == KINDS[1]
    out = out.join(marked.where(is_code).select(F.col(key).alias("_key"), F.ltrim("suffix", F.lit(".")).alias("language")), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    out = out.withColumn("metadata", F.when(code, F.create_map(F.lit("symbol_type"), F.lit("symbol"))).otherwise(F.create_map().cast("map<string,string>")))
    return out.withColumn("content_hash", F.sha2("content", 256)).withColumn("token_estimate", tx.token_estimate(F.col("content")))


def frontmatter(text: Column) -> Column:
    """A map of the `key: value` lines between --- lines at the start; empty without them.

    Of YAML: plain and quoted scalars, `[a, b]` lists and `- item` lists below a key; a list is kept as a JSON array.
    """
    head = F.regexp_extract(text, r"^---[ \t]*\r?\n([\s\S]*?)\n---[ \t]*(?:\r?\n|$)", 1)
    joined = F.regexp_replace(head, r"\r?\n[ \t]*- +", "\x01")  # items of a block list come behind their key
    pairs = F.filter(F.split(joined, r"\r?\n"), lambda x: x.rlike(r"^[^\s#:][^:]*:"))

    def plain(x: Column) -> Column:
        return F.regexp_replace(F.trim(x), "^(['\"])(.*)\\1$", "$2")

    def value(x: Column) -> Column:
        items = F.when(x.startswith("\x01"), F.split(F.substring(x, F.lit(2), F.length(x)), "\x01"))
        items = F.coalesce(items, F.when(x.rlike(r"^\[.*\]$"), F.filter(F.split(F.regexp_extract(x, r"^\[(.*)\]$", 1), ","), lambda i: F.trim(i) != "")))
        return F.when(items.isNotNull(), F.to_json(F.transform(items, plain))).otherwise(plain(x))

    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.trim(F.split(x, ":", 2)[0]), value(F.trim(F.split(x, ":", 2)[1])))))
