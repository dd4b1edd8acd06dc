"""Corpus sources: law JSON, Markdown and HTML documents, snapshots and evaluation cases."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausegraph.functions import text as tx

LAW_SCHEMA = """law_name string, law_abbr string, authority string, document_no string, issued_date string,
  effective_date string, status string, source_url string, mirror_url string, notes string, retrieved_date string,
  chapters array<struct<chapter_title:string, articles:array<struct<num:string, title:string, text:string>>>>"""
CASE_SCHEMA = """id string, category string, question string, previous_question string, intent string,
  expected_articles array<string>, must_conclusions array<string>, forbidden_conclusions array<string>,
  should_refuse boolean, review_notes string"""
# Default status and the header patterns of the text dialects.
IN_FORCE = "现行"
CHAPTER_HEAD = "^#{1,6}\\s*(第[一二三四五六七八九十百零]+章.*)$"
ARTICLE_HEAD = "^\\s*(第[一二三四五六七八九十百零]+条(?:之[一二三四五六七八九十])?)[\\s　]*(.*)$"
SKIP_LINE = "^(>|---|# |<!--|（\\d{4}年|\\(\\d{4}年)"
TIGHT_ENDS = "：，；、"


def split_paths(spark: SparkSession, paths: list[str] | str) -> tuple[list[str], list[str]]:
    """Paths and globs that hold something, and those that do not, as the file system of each tells."""
    found, absent = [], []
    for path in [paths] if isinstance(paths, str) else paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        hits = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
        (found if hits else absent).append(path)
    return found, absent


def _scan_laws(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    found, _ = split_paths(spark, paths)
    schema = f"{LAW_SCHEMA}, _corrupt_record string"
    if not found:
        return spark.createDataFrame([], schema).withColumn("path", F.lit(""))
    return spark.read.schema(schema).option("multiLine", True).json(found).withColumn("path", F.input_file_name())


def read_laws(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Law documents with defaults.  Catalogue entries that do not exist are skipped (``split_paths`` names them);
    files without chapters or with broken JSON are left to ``rejected_laws``."""
    laws = _scan_laws(spark, paths)
    blank = F.lit("")
    status = F.trim(F.coalesce("status", blank))
    named = laws.where(F.col("chapters").isNotNull()).withColumn("source_file", F.substring_index("path", "/", -1))
    return named.drop("_corrupt_record", "path").withColumns({
        "law_name": F.coalesce("law_name", "law_abbr"), "status": F.when(status == "", IN_FORCE).otherwise(status),
        **{c: F.coalesce(c, blank) for c in ("notes", "issued_date", "effective_date", "document_no", "authority", "source_url")}})


def rejected_laws(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``(path, law_abbr, record)`` of the files that ``read_laws`` cannot use."""
    laws = _scan_laws(spark, paths).where(F.col("chapters").isNull())
    return laws.select("path", "law_abbr", F.col("_corrupt_record").alias("record"))


def source_catalog(laws: DataFrame) -> DataFrame:
    return laws.select("law_abbr", "law_name", "authority", "effective_date", "source_url")


def articles(laws: DataFrame) -> DataFrame:
    """One row per article; of equal keys the last one counts, in the order of file names, then of the law."""
    file = F.col("source_file") if "source_file" in laws.columns else F.lit("").alias("source_file")
    rows = laws.select(file, F.col("law_abbr").alias("law"), "law_name", "authority", "effective_date", "status", "notes", "source_url",
                       "issued_date", "document_no", F.posexplode("chapters").alias("_c", "ch"))
    rows = rows.select("*", F.posexplode("ch.articles").alias("_a", "art")).withColumn(
        "item_id", F.concat_ws("·", "law", "art.num"))
    flat = rows.select("item_id", "law", "law_name", "authority", "effective_date", "status", "notes", "source_url", "issued_date",
                       "document_no", F.col("ch.chapter_title").alias("chapter"), F.col("art.title").alias("title"),
                       F.col("art.text").alias("text"), F.struct("source_file", "_c", "_a").alias("_seq"))
    rest = [c for c in flat.columns if c not in ("item_id", "_seq")]
    return flat.groupBy("item_id").agg(F.max_by(F.struct(*rest), "_seq").alias("r")).select("item_id", "r.*")


def law_of(item_id: Column | str) -> Column:
    """The law of an item key ``law·number``; a key without a number is a law itself."""
    return F.substring_index(item_id, "·", 1)


def chunks(articles_: DataFrame, delimiters: str = tx.CJK_DELIMITERS) -> DataFrame:
    """Sentence chunks with the metadata of their article."""
    return articles_.select("*", F.posexplode(tx.sentences("text", delimiters)).alias("unit_no", "unit")).withColumns({
        "id": F.concat_ws("#", "item_id", "unit_no"), "parent_id": F.col("item_id"), "parent_text": F.col("text"),
        "chunk_level": F.lit("sentence")})


def join_lines(parts: Column) -> Column:
    """Continuation lines: no blank after ：，；、, one blank elsewhere."""
    def step(acc, part):
        tight = (acc == "") | F.right(acc, F.lit(1)).isin(*TIGHT_ENDS)
        return F.when(tight, F.concat(acc, part)).otherwise(F.concat_ws(" ", acc, part))

    return F.aggregate(parts, F.lit(""), step)


def parse_markdown(docs: DataFrame, key: str, text: str = "text", chapter: str = CHAPTER_HEAD, article: str = ARTICLE_HEAD,
                   skip: str = SKIP_LINE, min_text: int = 0) -> DataFrame:
    """``(key, chapter_no, chapter, num, article_no, body)`` of line-oriented documents.

    Header lines open groups and later lines belong to them.  The text is cut at
    its headers inside the row, so no shuffle and no window is needed.
    """
    lines = F.filter(F.transform(F.split(text, "\\n"), lambda s: tx.normalize_space(s)), lambda s: (s != "") & ~s.rlike(skip))
    rows = docs.select(key, lines.alias("lines"))
    n = F.size("lines")
    heads = F.filter(F.transform("lines", lambda s, i: F.when(s.rlike(chapter), i)), lambda i: i.isNotNull())
    starts = F.transform(heads, lambda i: i)
    bounds = rows.select(key, "lines", starts.alias("starts"), n.alias("n")).where(F.size("starts") > 0)
    chapters = bounds.select(key, "lines", "n", "starts", F.posexplode("starts").alias("chapter_no", "at"))
    end = F.coalesce(F.get("starts", F.col("chapter_no") + 1), F.col("n"))
    chapters = chapters.select(key, "chapter_no", F.regexp_extract(F.get("lines", F.col("at")), chapter, 1).alias("chapter"),
                               F.slice("lines", F.col("at") + 2, F.greatest(end - F.col("at") - 1, F.lit(0))).alias("body_lines"))
    arts = F.filter(F.transform("body_lines", lambda s, i: F.when(s.rlike(article), i)), lambda i: i.isNotNull())
    opened = chapters.select("*", arts.alias("starts"), F.size("body_lines").alias("n"))
    parts = opened.select("*", F.posexplode("starts").alias("article_no", "at"))
    stop = F.coalesce(F.get("starts", F.col("article_no") + 1), F.col("n"))
    first = F.get("body_lines", F.col("at"))
    tail = F.slice("body_lines", F.col("at") + 2, F.greatest(stop - F.col("at") - 1, F.lit(0)))
    pieces = F.filter(F.concat(F.array(F.regexp_extract(first, article, 2)), tail), lambda s: s != "")
    return parts.select(key, "chapter_no", "chapter", "article_no", F.regexp_extract(first, article, 1).alias("num"),
                        join_lines(pieces).alias("body")).where(F.char_length("body") >= min_text)


SECTION_MARK = "\x01"


def parse_sections(docs: DataFrame, key: str, text: str = "text", min_text: int = 20, max_top: int = 20,
                   skip_top: tuple[int, ...] = (2,)) -> DataFrame:
    """Inline numbered sections ``n.n`` / ``n.n.n`` as ``(key, num, body)``.

    Sections of skipped chapters, with a top number above ``max_top`` or with a
    body shorter than ``min_text`` are left out.
    """
    marked = F.regexp_replace(text, "(?<![\\d.])(\\d{1,2}(?:\\.\\d{1,3}){1,2})(?![\\d.])", SECTION_MARK + "$1 ")
    pieces = docs.select(key, F.posexplode(F.split(marked, SECTION_MARK)).alias("pos", "piece")).where(F.col("pos") > 0)
    num = F.regexp_extract("piece", "^(\\d+(?:\\.\\d+){1,2})", 1)
    body = tx.normalize_space(F.regexp_replace("piece", "^\\d+(?:\\.\\d+){1,2}", ""))
    top = F.substring_index(num, ".", 1).cast("int")
    return pieces.select(key, "pos", num.alias("num"), body.alias("body"), top.alias("top")).where(
        (F.char_length("body") >= min_text) & (F.col("top") <= max_top) & ~F.col("top").isin(*skip_top)).drop("top")


class _Lines(HTMLParser):
    HIDDEN = ("script", "style", "noscript")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.lines = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.HIDDEN

    def handle_endtag(self, tag):
        if tag in self.HIDDEN and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        line = " ".join(data.split())
        if line and not self.depth:
            self.lines.append(line)


@F.pandas_udf(T.ArrayType(T.StringType()))
def html_lines(pages: pd.Series) -> pd.Series:
    """Visible text nodes of a page, one line each."""
    def lines(page):
        parser = _Lines()
        parser.feed(page or "")
        parser.close()
        return parser.lines

    return pages.map(lines)


def html_lines_sql(page: Column | str) -> Column:
    """Same for pages without unusual markup, as built-in expressions."""
    c = F.col(page) if isinstance(page, str) else page
    c = F.regexp_replace(c, "(?is)<(script|style|noscript)\\b.*?</\\1\\s*>", "\x01")
    c = F.regexp_replace(F.regexp_replace(c, "(?s)<!--.*?-->", "\x01"), "(?s)<[^>]*>", "\x01")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"),
                         ("&middot;", "·"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return F.filter(F.transform(F.split(c, "\x01"), lambda s: tx.normalize_space(s)), lambda s: s != "")


def slice_body(lines: Column, start: Column, stop: Column) -> Column:
    """Lines from the first one equal to ``start`` up to the first later one equal to ``stop``; NULL if either is missing."""
    at = F.array_position(lines, start)
    rest = F.slice(lines, F.greatest(at, F.lit(1)).cast("int"), F.greatest(F.size(lines), F.lit(1)))
    end = F.array_position(rest, stop)
    return F.when((at > 0) & (end > 0), F.slice(rest, 1, (end - 1).cast("int")))


def write_laws(laws: DataFrame, path: str, minimum: int = 10) -> None:
    """Write law documents; collections with fewer than ``minimum`` articles are rejected."""
    count = F.aggregate("chapters", F.lit(0), lambda acc, c: acc + F.size(c.articles))
    small = laws.where(count < minimum).select("law_abbr").limit(5).collect()
    if small:
        raise ValueError(f"too few articles: {[r[0] for r in small]}")
    laws.withColumn("retrieved_date", F.date_format(F.current_date(), "yyyy-MM-dd")).write.mode("overwrite").json(path)


def read_cases(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    reader = spark.read.schema(CASE_SCHEMA)
    return (reader if lines else reader.option("multiLine", True)).json(path).where(F.col("question").isNotNull())


def write_snapshot(frames: dict[str, DataFrame], root: str, version: str) -> None:
    """Immutable snapshot ``root/version/name``; readers switch by version, nothing is changed in place."""
    for name, df in frames.items():
        df.write.mode("errorifexists").parquet(f"{root}/{version}/{name}")


def read_snapshot(spark: SparkSession, root: str, version: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{version}/{name}")
