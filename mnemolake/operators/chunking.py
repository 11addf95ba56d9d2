"""Chunkers as column expressions: a document's lines are an array, its sections are slices of it, so nothing is shuffled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, OVERLAP = 500, 50
TYPE_LINES = 50

# Patterns of section starts in command output, and what tells its type.
BOUNDARIES = {
    "test_result": r"^(---- .+ ----|FAIL|test .+\.\.\.)",
    "build_error": r"^(error\[|warning\[|error:)",
    "diff": r"^diff --git",
}
LOG_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"
TYPES = {
    "build_error": r"^\s*(error\[E|error:)",
    "diff": r"^\s*diff --git",
    "test_result": r"^\s*(test result:|FAIL|---- .* ----$)",
    "log": r"^\s*" + LOG_TIME[1:],
}
HEADING = r"^#{1,6}\s+(.+)$"
ERROR_CHARS = 80


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), body)[0]


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _lines(c: Column) -> Column:
    return F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r?\n\z", ""), r"\r?\n", -1)


def _words(c: Column) -> Column:
    return F.array_remove(F.split(c, r"\s+"), F.lit(""))


def _windows(words: Column, size: int, overlap: int) -> Column:
    """Texts of ``size`` words, each ``size - overlap`` words after the one before; the last ends with the words."""
    step = max(1, size - overlap)
    n = F.when(F.size(words) <= size, F.least(F.size(words), F.lit(1))).otherwise(F.ceil((F.size(words) - size) / step) + 1).cast("int")
    return F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i < n), lambda i: F.array_join(F.slice(words, i * step + 1, size), " "))


def _fitted(sections: Column, most: int) -> Column:
    """array<struct<content, heading>> without blank sections, those of more than ``most`` words in windows."""

    def parts(s: Column) -> Column:
        return _let(_words(s["content"]), lambda w: F.when(F.size(w) > most, F.transform(_windows(w, most, most // 10), lambda x: F.struct(x.alias("content"), s["heading"].alias("heading")))).otherwise(F.array(s)))

    return F.flatten(F.transform(F.filter(sections, lambda s: s["content"].rlike(r"\S")), parts))


def _sections(lines: Column, starts, of) -> Column:
    """``of(slice)`` for the lines before the first start and from each start on; ``starts(lines, i)`` tells whether line ``i`` (from 1) is one."""

    def cut(x: Column) -> Column:
        at = F.array_union(F.array(F.lit(1)), F.filter(F.sequence(F.lit(1), F.size(x)), lambda i: starts(x, i)))
        return _let(at, lambda a: F.transform(a, lambda p, k: of(F.slice(x, p, F.coalesce(F.get(a, k + 1), F.size(x) + 1) - p))))

    return _let(lines, cut)


def _chunks(docs: DataFrame, id: str, sections: Column, name: str) -> DataFrame:
    return docs.select(F.col(id).alias("document_id"), F.posexplode(sections).alias("chunk_index", "s")).select("document_id", "chunk_index", "s.*", F.lit(name).alias("chunk_strategy"))


def window_chunks(docs: DataFrame, size: int = WINDOW, overlap: int = OVERLAP, id: str = "id", content: str = "content") -> DataFrame:
    """Windows of ``size`` words that overlap; a document's last window ends with it."""
    keep = [c for c in docs.columns if c not in (id, content)]
    d = docs.select(F.col(id).alias("document_id"), *keep, F.posexplode(_let(_words(F.col(content)), lambda w: _windows(w, size, overlap))).alias("chunk_index", "content"))
    return d.select(F.concat_ws(":", "document_id", F.col("chunk_index").cast("string")).alias("id"), "document_id", *keep, "chunk_index", "content", F.lit("sliding_window").alias("chunk_strategy"))


def _blocks(content: Column) -> Column:
    return F.filter(F.transform(F.split(content, "\n\n", -1), _strip), lambda b: b != "")


def block_chunks(docs: DataFrame, id: str = "id", content: str = "content") -> DataFrame:
    """Blocks between blank lines, trimmed, without empty ones."""
    return docs.select(F.col(id).alias("document_id"), F.posexplode(_blocks(F.col(content))).alias("chunk_index", "content")).withColumn("chunk_strategy", F.lit("by_function"))


def strategy(docs: DataFrame) -> DataFrame:
    kind = F.when(F.col("source_type") == "markdown", "by_heading").when(F.col("source_type") == "code", "by_ast").otherwise("sliding_window")
    return docs.withColumn("chunk_strategy", kind)


def heading_chunks(docs: DataFrame, most: int = WINDOW, id: str = "id", content: str = "content") -> DataFrame:
    """Sections of markdown below their headings; a text before the first heading has none."""

    def section(s: Column) -> Column:
        head = F.get(s, F.lit(0))
        titled = head.rlike(HEADING)
        body = F.when(titled, F.slice(s, F.lit(2), F.size(s))).otherwise(s)
        return F.struct(_strip(F.array_join(body, "\n")).alias("content"), F.when(titled, F.regexp_extract(head, HEADING, 1)).alias("heading"))

    cut = _sections(_lines(F.col(content)), lambda x, i: F.get(x, i - 1).rlike(HEADING), section)
    return _chunks(docs, id, _fitted(cut, most), "by_heading")


def output_type(content: Column) -> Column:
    """What the first of a command output's first fifty lines that tells anything shows it to be."""

    def told(line: Column) -> Column:
        return F.coalesce(*[F.when(line.rlike(p), kind) for kind, p in TYPES.items()])

    first = F.filter(F.transform(F.slice(_lines(content), 1, TYPE_LINES), told), lambda k: k.isNotNull())
    return F.coalesce(F.get(first, F.lit(0)), F.lit("generic"))


def _output_heading(kind: Column, s: Column) -> Column:
    """The heading that a section's lines give it: a path, an error code, a test, or the first time stamp."""
    head = F.get(s, F.lit(0))
    line = _strip(head)
    path = F.regexp_extract(line, r"^diff --git \S+ (?:b/)?(\S+)", 1)
    code = F.regexp_extract(line, r"^[^\]]*\]", 0)
    test = F.coalesce(*[F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in (r"^---- (.*) ----$", r"^test (.*?)\s*\.\.\.", r"^(FAIL.*)$")])
    stamps = F.filter(F.transform(s, lambda x: F.regexp_substr(x, F.lit(LOG_TIME))), lambda x: x.isNotNull())
    by = F.when(kind == "diff", F.coalesce(F.nullif(path, F.lit("")), line)).when(kind == "build_error", F.coalesce(F.nullif(code, F.lit("")), F.left(line, F.lit(ERROR_CHARS)))).when(kind == "test_result", test)
    starts = reduce(lambda a, b: a | b, [(kind == k) & head.rlike(p) for k, p in BOUNDARIES.items()])
    return F.when(kind == "log", F.get(stamps, F.lit(0))).when(starts, by)


def output_chunks(docs: DataFrame, most: int = WINDOW, id: str = "id", content: str = "content") -> DataFrame:
    """Sections of command output by its type: tests, errors, files of a diff, runs of log lines; windows for any other."""
    kind = F.col("_kind")

    def starts(x: Column, i: Column) -> Column:
        line = F.get(x, i - 1)
        marked = reduce(lambda a, b: a | b, [(kind == k) & line.rlike(p) for k, p in BOUNDARIES.items()])
        return marked | (kind == "log") & line.rlike(r"\S") & ~F.coalesce(F.get(x, i - 2).rlike(r"\S"), F.lit(False))

    def section(s: Column) -> Column:
        held = F.when(kind == "log", F.filter(s, lambda x: x.rlike(r"\S"))).otherwise(s)
        return F.struct(F.array_join(held, "\n").alias("content"), _output_heading(kind, s).alias("heading"))

    size = min(most, WINDOW)
    text = F.coalesce(F.col(content), F.lit(""))
    plain = F.transform(_let(_words(text), lambda w: _windows(w, size, size // 10)), lambda x: F.struct(x.alias("content"), F.lit(None).cast("string").alias("heading")))
    cut = F.when(kind == "generic", plain).otherwise(_sections(_lines(text), starts, section))
    return _chunks(docs.withColumn("_kind", output_type(text)), id, _fitted(cut, most), "structured_output")


def parse_symbols(lines: DataFrame, line: str = "line") -> DataFrame:
    """(kind, name, line_start, line_end) from a symbol listing; indented lines are members and left out."""
    p = r"^(\S+) (.+?) ?\[(\d+):\d+-(\d+):\d+\]"
    x = lines.where(~F.col(line).rlike(r"^\s") & F.col(line).rlike(p))
    return x.select("*", *[F.regexp_extract(line, p, i + 1).cast("int" if i > 1 else "string").alias(n) for i, n in enumerate(("kind", "name", "line_start", "line_end"))])


def symbol_chunks(docs: DataFrame, symbols: DataFrame, id: str = "id", content: str = "content") -> DataFrame:
    """Chunks along symbols (id, kind, name, line_start, line_end), and what stands before, between and after them; documents without symbols fall back to blocks.

    What stands before a symbol begins after the last line of any earlier symbol that isn't blank.
    """
    s = symbols.groupBy(F.col(id).alias("_id")).agg(F.array_sort(F.collect_list(F.struct("line_start", "line_end", "kind", "name"))).alias("_symbols"))
    d = docs.select(F.col(id).alias("id"), _lines(F.col(content)).alias("_l"), F.col(content).alias("_text")).join(s, F.col("id") == F.col("_id"), "left")
    n = F.size("_l")
    text = lambda a, b: _strip(F.array_join(F.slice(F.col("_l"), a, F.greatest(b - a + 1, F.lit(0))), "\n"))
    ranges = F.transform("_symbols", lambda x: F.struct(F.greatest(x["line_start"], F.lit(1)).alias("a"), F.least(x["line_end"], n).alias("b"), F.concat_ws(" ", x["kind"], x["name"]).alias("heading"), x["line_start"].alias("first"), x["line_end"].alias("last")))
    solid = F.filter(ranges, lambda r: (r["a"] <= n) & (r["a"] <= r["b"]))
    d = d.withColumn("_r", F.transform(solid, lambda r: F.struct(*[r[c].alias(c) for c in ("a", "b", "heading", "first", "last")], text(r["a"], r["b"]).alias("content"))))
    d = d.withColumn("_ends", F.transform("_r", lambda r: F.when(r["content"] != "", r["b"]).otherwise(0)))
    done = lambda k: F.coalesce(F.array_max(F.slice("_ends", F.lit(1), k)), F.lit(0))
    piece = lambda content, heading, a, b: F.struct(content.alias("content"), heading.cast("string").alias("heading"), a.cast("int").alias("line_start"), b.cast("int").alias("line_end"))
    none = F.lit(None)
    around = F.flatten(F.transform("_r", lambda r, k: F.array(piece(text(done(k) + 1, r["a"] - 1), none, done(k) + 1, r["a"] - 1), piece(r["content"], r["heading"], r["first"], r["last"]))))
    tail = done(F.size("_r"))
    along = F.concat(around, F.array(piece(text(tail + 1, n), none, tail + 1, n)))
    blocks = F.transform(_blocks(F.col("_text")), lambda b: piece(b, none, none, none))
    return _chunks(d, "id", F.filter(F.when(F.col("_symbols").isNull(), blocks).otherwise(along), lambda x: x["content"] != ""), "by_ast")
