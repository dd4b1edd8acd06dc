"""Parsers that need the next line or the chapter of the moment: laws of web pages and numbered sections.

Each line gets one mark in a fold over the lines of its row, in which a mark may depend on the one before; the rest
is array functions on the marks.  Nothing is shuffled, and a document never leaves its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegraph.functions import text as tx

# Head patterns and default names of chapters.
WEB_CHAPTER = "^(第[一二三四五六七八九十百零]+章)\\s*(.*)$"
WEB_ARTICLE = "^(第[一二三四五六七八九十百零]+条)\\s*(.*)$"
DEFAULT_CHAPTER, NUMBERED_CHAPTER = "正文", " 条款"
SECTION_NAMES = ("范围|规范性引用文件|术语和定义|一般要求|总则|场地消防技术要求|场地防火技术要求|充电设施要求|消防安全管理|"
                 "消防安全责任|消防组织|消防安全制度和管理|消防措施|灭火和应急疏散预案编制和演练|档案")
TITLE_LINE = "^#.*?(?=<!-- INFO END -->|1\\s+范围|4\\s+)"
REFERENCE_LIST = "^(下列文件|下列术语)|^(GB/T|GB|XF/T|XF|DB)(?![A-Za-z0-9_])"
REFERENCES = "2"


def line_marks(lines: Column, chapter: str, article: str) -> Column:
    """One letter a line: ``c`` chapter with its title, ``b`` chapter whose title stands on the next line, ``t`` that title, ``a`` article, ``.`` text.

    The line after a ``b`` is its title whatever it looks like.
    """
    def step(marks: Column, line: Column) -> Column:
        head = line.rlike(chapter)
        bare = head & (F.trim(F.regexp_extract(line, chapter, 2)) == "")
        own = F.when(bare, "b").when(head, "c").when(line.rlike(article), "a").otherwise(".")
        return F.concat(marks, F.when(F.right(marks, F.lit(1)) == "b", "t").otherwise(own))

    return F.aggregate(lines, F.lit(""), step)


def _places(marks: Column, letters: str) -> Column:
    """0-based places of the given marks."""
    numbers = F.transform(F.split(marks, ""), lambda m, i: F.when(m.isin(*letters), i))
    return F.filter(numbers, lambda i: i.isNotNull())


def parse_web_law(docs: DataFrame, key: str, lines: str = "lines", chapter: str = WEB_CHAPTER, article: str = WEB_ARTICLE,
                  default: str = DEFAULT_CHAPTER) -> DataFrame:
    """``(key, article_no, chapter, num, title, body)`` of ``docs(key, lines)``, lines being the visible texts of a page.

    A chapter without a title takes the next line as one.  Articles before the first chapter belong to ``default``.
    Further lines of an article are joined without blanks.  Text between a chapter head and its first article belongs
    to nothing.  Rows without lines give nothing.
    """
    marked = docs.select(key, F.col(lines).alias("_lines"), line_marks(F.col(lines), chapter, article).alias("_marks"))
    cut = marked.select("*", _places(F.col("_marks"), "abc").alias("_starts"), _places(F.col("_marks"), "bc").alias("_heads"))
    rows = cut.select("*", F.posexplode(_places(F.col("_marks"), "a")).alias("article_no", "_at"))
    stop = F.coalesce(F.array_min(F.filter("_starts", lambda s: s > F.col("_at"))), F.size("_lines"))
    head = F.array_max(F.filter("_heads", lambda h: h < F.col("_at")))
    rows = rows.withColumns({"_stop": stop, "_head": head, "_first": F.get("_lines", F.col("_at"))})
    line = F.get("_lines", F.col("_head"))
    own = F.trim(F.regexp_extract(line, chapter, 2))
    title = F.when(own == "", F.coalesce(F.get("_lines", F.col("_head") + 1), F.lit(""))).otherwise(own)
    name = F.when(F.col("_head").isNull(), default).otherwise(F.concat(F.regexp_extract(line, chapter, 1), F.lit(" "), title))
    tail = F.slice("_lines", F.col("_at") + 2, F.greatest(F.col("_stop") - F.col("_at") - 1, F.lit(0)))
    body = tx.normalize_space(F.concat(F.regexp_extract("_first", article, 2), F.array_join(tail, "")))
    return rows.select(key, "article_no", name.alias("chapter"), F.regexp_extract("_first", article, 1).alias("num"), body.alias("body")).select(
        key, "article_no", "chapter", "num", tx.derive_title("body").alias("title"), "body")


SECTION, HEAD = "^(\\d+(?:\\.\\d+)+)\\s+(.*)$", "^(\\d+)\\s+([^\\d].{0,40})$"


def section_lines(text: Column | str, names: str = SECTION_NAMES) -> Column:
    """Lines of a text in which every section number and every known chapter head begins one."""
    flat = F.replace(F.regexp_replace(tx.normalize_space(text), TITLE_LINE, ""), F.lit("<!-- INFO END -->"), F.lit(" "))
    flat = F.regexp_replace(flat, "(?<!\\d)(\\d+(?:\\.\\d+)+)\\s+", "\n$1 ")
    flat = F.regexp_replace(flat, f"(?U)(?<!\\d)(\\d+)\\s+({names})\\b", "\n$1 $2")
    return F.filter(F.transform(F.split(flat, "\n"), lambda s: tx.normalize_space(s)), lambda s: s != "")


def parse_section_chapters(docs: DataFrame, key: str, text: str = "text", names: str = SECTION_NAMES, min_text: int = 20, max_top: int = 20) -> DataFrame:
    """``(key, article_no, chapter_no, chapter, num, title, body)`` of numbered sections with the chapter of the moment.

    A chapter head (``4 name``) opens a chapter.  A section whose first number is not that of the chapter of the moment
    opens one named after its number.  Left out are short bodies, first numbers above ``max_top``, lists of referenced
    documents and terms, and everything while the chapter of the moment is the one of references.
    """
    def step(acc: Column, line: Column) -> Column:
        num, body = F.regexp_extract(line, SECTION, 1), F.trim(F.regexp_extract(line, SECTION, 2))
        head = F.regexp_extract(line, HEAD, 1)
        top = F.substring_index(num, ".", 1)
        fits = ((num != "") & (F.char_length(body) >= min_text) & (F.length(top) <= 9) & (F.coalesce(top.try_cast("int"), F.lit(99)) <= max_top)
                & ~body.rlike(REFERENCE_LIST) & (acc["now"] != REFERENCES))
        mark = F.when(head != "", "h").when(fits & (acc["now"] == top), "s").when(fits, "n").otherwise("x")
        return F.struct(F.when(head != "", head).when(fits, top).otherwise(acc["now"]).alias("now"), F.concat(acc["marks"], mark).alias("marks"))

    lines = docs.select(key, section_lines(text, names).alias("_lines"))
    start = F.struct(F.lit("").alias("now"), F.lit("").alias("marks"))
    marked = lines.select(key, "_lines", F.aggregate("_lines", start, step)["marks"].alias("_marks"))
    cut = marked.select("*", _places(F.col("_marks"), "hn").alias("_heads"))
    rows = cut.select("*", F.posexplode(_places(F.col("_marks"), "sn")).alias("article_no", "_at"))
    place = F.array_max(F.filter("_heads", lambda h: h <= F.col("_at")))
    rows = rows.withColumns({"_head": F.get("_lines", place), "_line": F.get("_lines", F.col("_at")), "chapter_no": F.array_position("_heads", place) - 1})
    num = F.regexp_extract("_line", SECTION, 1)
    named = F.concat_ws(" ", F.regexp_extract("_head", HEAD, 1), F.regexp_extract("_head", HEAD, 2))
    chapter = F.when(F.regexp_extract("_head", HEAD, 1) != "", named).otherwise(F.concat(F.substring_index(num, ".", 1), F.lit(NUMBERED_CHAPTER)))
    body = F.trim(F.regexp_extract("_line", SECTION, 2))
    return rows.select(key, "article_no", "chapter_no", chapter.alias("chapter"), num.alias("num"), tx.derive_title(body).alias("title"), body.alias("body"))
